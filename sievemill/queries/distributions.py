"""Logits and distillation over embeddings: a row's vector as a student's logits, the next row's as the teacher's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logits as L
from ..session import table
from .base import query, r

_K = 4
_ROWS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
    m AS (SELECT *, list_max(z) AS top FROM e),
    l AS (SELECT *, top + ln(list_sum(list_transform(z, lambda x: exp(x - top)))) AS lse FROM m),
    p AS (SELECT vec_id, label, z, lse, list_transform(z, lambda x: x - lse) AS lp FROM l)"""


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.pmod("label", F.lit(64)).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("z"))


query("logit_scalars", f"WITH {_ROWS} SELECT vec_id, {r('z[label % 64 + 1]', 'picked')}, {r('lp[label % 64 + 1]', 'logp')}, {r('-list_sum(list_transform(lp, lambda x: exp(x) * x))', 'entropy')}, {r('list_sum(list_transform(lp, lambda x: exp(2 * x)))', 'sum_pi_sq')} FROM p")(
    lambda s, d: _vectors(s, d).select("vec_id", L.pick(F.col("z"), F.col("label")).alias("picked"), L.label_log_prob(F.col("z"), F.col("label")).alias("logp"), L.entropy(F.col("z")).alias("entropy"), L.sum_pi_squared(F.col("z")).alias("sum_pi_sq"))
)


def _pairs(s, d):
    v = _vectors(s, d).withColumn("lp", L.log_softmax(F.col("z")))
    t = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lp").alias("t")).withColumn("teacher_ids", L.top_ids(F.col("t"), _K))
    t = t.withColumn("teacher_logp", F.transform("teacher_ids", lambda i: F.get(F.col("t"), i.cast("int")))).drop("t")
    return v.select("vec_id", F.col("z").alias("logits"), (F.col("label") % 2).alias("mask")).join(t, "vec_id")


_TOP = f"""
    , x AS (SELECT vec_id, generate_subscripts(lp, 1) AS i, unnest(lp) AS v FROM p)
    , k AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM x)
    , j AS (SELECT s.vec_id, t.i, t.v AS tp, s.v AS sp, s.n <= {_K} AS own FROM k t JOIN k s ON s.vec_id = t.vec_id - 1 AND s.i = t.i WHERE t.n <= {_K})"""
_FORWARD = _TOP + """
    , f AS (SELECT vec_id, sum(exp(tp) * (tp - sp)) AS loss, sum(exp(sp)) AS student_mass, sum(exp(tp)) AS teacher_mass, CAST(count(*) FILTER (own) AS INTEGER) AS overlap_count,
        coalesce(-sum(exp(tp) * (tp - sp)) FILTER (own), 0) / greatest(count(*) FILTER (own), 1) AS gain FROM j GROUP BY vec_id)"""
_REVERSE = _TOP + """
    , o AS (SELECT vec_id, sum(exp(sp)) AS sm, sum(exp(tp)) AS tm FROM j GROUP BY vec_id)
    , a AS (SELECT vec_id, own, greatest(exp(sp), exp(-20)) AS a, greatest(exp(tp), exp(-20)) AS b FROM j UNION ALL SELECT vec_id, NULL, greatest(1 - sm, exp(-20)), greatest(1 - tm, exp(-20)) FROM o)
    , n AS (SELECT vec_id, own, a / sum(a) OVER g AS a, b / sum(b) OVER g AS b FROM a WINDOW g AS (PARTITION BY vec_id))
    , f AS (SELECT n.vec_id, sum(n.a * (ln(n.a) - ln(n.b))) AS loss, max(sm) AS student_mass, max(tm) AS teacher_mass, CAST(count(*) FILTER (own) AS INTEGER) AS overlap_count,
        coalesce(-sum(n.a * (ln(n.a) - ln(n.b))) FILTER (own), 0) / greatest(count(*) FILTER (own), 1) AS gain FROM n JOIN o USING (vec_id) GROUP BY n.vec_id)"""
for _name, _sql in (("forward_kl_topk", _FORWARD), ("reverse_kl_topk", _REVERSE)):
    query(_name, f"WITH {_ROWS} {_sql} SELECT vec_id, {r('loss', 'loss')}, {r('student_mass', 'student_mass')}, {r('teacher_mass', 'teacher_mass')}, overlap_count, {r('gain', 'overlap_token_advantage')} FROM f")(
        lambda s, d, n=_name: L.DISTILLATION.get(n)(_pairs(s, d), _K).select("vec_id", "loss", "student_mass", "teacher_mass", "overlap_count", "overlap_token_advantage")
    )
query(
    "distillation_metrics",
    f"""WITH {_ROWS} {_FORWARD}, g AS (SELECT f.*, label % 64 % 2 AS mask FROM f JOIN p USING (vec_id))
        SELECT {r('avg(student_mass)', 'student_mass')}, {r('min(student_mass)', 'student_mass_min')}, {r('max(student_mass)', 'student_mass_max')}, {r('avg(teacher_mass)', 'teacher_mass')}, {r('min(teacher_mass)', 'teacher_mass_min')}, {r('max(teacher_mass)', 'teacher_mass_max')},
            {r(f'avg(overlap_count) / {_K}', 'overlap_ratio')}, {r('coalesce(avg(gain) FILTER (overlap_count > 0), 0)', 'overlap_token_advantage')}, {r('min(loss)', 'loss_min')}, {r('max(loss)', 'loss_max')} FROM g WHERE mask = 1""",
)(lambda s, d: L.distillation_metrics(L.forward_kl_topk(_pairs(s, d), _K), _K))
query("distillation_loss_topk", f"WITH {_ROWS} {_REVERSE}, g AS (SELECT f.*, label % 64 % 2 AS mask FROM f JOIN p USING (vec_id)) SELECT {r('avg(least(greatest(loss, 0), 0.1))', 'loss')}, {r('avg(abs(loss))', 'abs_loss')} FROM g WHERE mask = 1")(
    lambda s, d: L.distillation_loss(L.reverse_kl_topk(_pairs(s, d), _K), clamp=0.1, floor=True)
)
query("distillation_loss_sampled", f"WITH {_ROWS}, q AS (SELECT a.vec_id, a.label % 64 % 2 AS mask, a.lp[a.label % 64 + 1] AS s, b.lp[a.label % 64 + 1] AS t FROM p a JOIN p b ON b.vec_id = a.vec_id + 1), f AS (SELECT *, greatest(least(exp(t - s) - (t - s) - 1, 10), -10) AS loss FROM q) SELECT {r('avg(greatest(least(loss, 2), -2))', 'loss')}, {r('avg(abs(loss))', 'abs_loss')} FROM f WHERE mask = 1")(
    lambda s, d: L.distillation_loss(
        L.estimator_loss(
            (v := _vectors(s, d).withColumn("lp", L.log_softmax(F.col("z")))).select("vec_id", "label", (F.col("label") % 2).alias("mask"), F.get("lp", F.col("label")).alias("logp"))
            .join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lp").alias("t")), "vec_id").withColumn("teacher_logp", F.get("t", F.col("label")))
        ),
        clamp=2.0,
    )
)
query("teacher_route", "SELECT doc_id, coalesce(lang, 'other') AS teacher FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", L.teacher_of(F.coalesce("lang", F.lit("other")), ["en", "fr", "de", "es", "other"]).alias("teacher")))
