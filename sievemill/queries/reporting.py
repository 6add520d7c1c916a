"""Reports over events as metric rows and sampled answers, batches as tables, and a judge's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import flow as X
from ..operators import judging as J
from ..operators import reports as R
from ..plans.views import sequences, trajectories, validation, with_sql
from ..session import table
from .base import query, r

_NAMES = ["perf/time_per_step", "training/global_step", "timing_s/gen", "actor/loss_mean", "global_seqlen/max", "critic/minimum", "num/total", "actor/lr"]
_NAMED = "e AS (SELECT event_id, [" + ", ".join(f"'{n}'" for n in _NAMES) + "][event_id % 8 + 1] AS name, value, event_id // 400 AS w FROM events)"


def _metrics(s, d):
    return table(s, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int")).alias("name"), "value", F.expr("event_id div 400").alias("w"))


query("metric_rules", f"WITH {_NAMED} SELECT w, name, {r('CASE event_id % 8 WHEN 0 THEN sum(value) WHEN 1 THEN arg_max(value, event_id) WHEN 2 THEN sum(value) WHEN 3 THEN avg(value) WHEN 4 THEN max(value) WHEN 5 THEN min(value) WHEN 6 THEN sum(value) ELSE avg(value) END', 'value')} FROM e GROUP BY w, name, event_id % 8")(
    lambda s, d: R.aggregate_metrics(_metrics(s, d), ["w"], order="event_id")
)
query("derived_metrics", f"SELECT {r('max(value) - min(value)', 'spread')}, {r('sum(value) / (count(*) * 8)', 'speed')}, {r('min(value) / max(value)', 'idle')} FROM events")(
    lambda s, d: R.derived_metrics(table(s, d, "events").agg(F.max("value").alias("global_seqlen/max"), F.min("value").alias("global_seqlen/min"), F.lit(0.0).alias("global_seqlen/minmax_diff"), F.lit(0.0).alias("perf/throughput"), F.sum("value").alias("perf/total_num_tokens"), F.count("*").alias("perf/time_per_step"), F.min("value").alias("timing_s/gen"), F.max("value").alias("timing_s/step")), 8)
    .selectExpr("`global_seqlen/minmax_diff` AS spread", "`perf/throughput` AS speed", "`fully_async/trainer/idle_ratio` AS idle")
)
query("table_statistics", f"SELECT {r('avg(value)', 'mean')}, {r('max(value)', 'max')}, {r('min(value)', 'min')}, {r('stddev_samp(value)', 'std')} FROM events")(lambda s, d: R.table_statistics(table(s, d, "events"), "value"))
query("masked_table_mean", f"SELECT {r('sum(value * (user_id % 2)) / sum(user_id % 2)', 'mean')} FROM events")(lambda s, d: R.masked_mean(table(s, d, "events").withColumn("m", F.col("user_id") % 2), "value", "m"))
for _how, _sql in (("sum", "sum(v)"), ("mean", "avg(v)")):
    query(f"over_ranks_{_how}", f"WITH e AS (SELECT event_type AS name, user_id % 4 AS rank, event_id // 40 AS place, value FROM events), f AS (SELECT name, place, avg(value) AS v FROM e GROUP BY 1, 2) SELECT name, {r(_sql, 'value')} FROM f GROUP BY 1")(
        lambda s, d, how=_how: R.over_ranks(table(s, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("rank"), F.expr("event_id div 40").alias("place"), "value"), "rank", "name", "value", how, "place")
    )
query("performance_report", "SELECT " + ", ".join(f"{r(f'{f}({c})', f'{n}_{k}')}" for n, c in (("quantity", "l_quantity"), ("tax", "l_tax"), ("line", "l_linenumber")) for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + ", " + ", ".join(r(f"arg_max({c}, struct_pack(t := CAST(l_quantity AS DOUBLE) + l_tax, o := -(l_orderkey * 10 + l_linenumber)))", f"slowest_{n}") for n, c in (("quantity", "l_quantity"), ("tax", "l_tax"), ("line", "l_linenumber"))) + " FROM lineitem")(
    lambda s, d: R.performance(table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax"), F.col("l_linenumber").cast("double").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), ["quantity", "tax"], ["line"], "o")
)
query("dense_codes", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders")(lambda s, d: R.dense_codes(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "code"))
query(
    "sampled_accuracy",
    with_sql("val", body=f""", v AS (SELECT source, uid, n, value > 50 AS h, pred % 2 = 0 AS s, value > 30 AS f FROM val WHERE n <= 4), k AS (SELECT source, uid FROM v GROUP BY 1, 2 HAVING count(*) = 4)
        , g AS (SELECT source, uid, arg_min(h, n) AS first, bool_or(h) AS a, bool_or(f) AS af, bool_or(s) AS ss, bool_or(h AND s) AS b, sum(h::INT) AS nh, sum(s::INT) AS ns FROM v JOIN k USING (source, uid) GROUP BY 1, 2)
        SELECT source, count(*) AS groups, CAST(4 AS BIGINT) AS samples, {r('avg(first::INT)', 'exact_at_1')}, {r('avg(a::INT)', 'pass_exact')}, {r('avg(af::INT)', 'pass_f1')}, {r('sum(nh) / (4.0 * count(*))', 'trajectory_exact')}, {r('sum(ns) / (4.0 * count(*))', 'trajectory_strategy')}, {r('avg(ss::INT)', 'pass_strategy')}, {r('avg(b::INT)', 'pass_both')} FROM g GROUP BY GROUPING SETS ((source), ())"""),
)(
    lambda s, d: R.sampled_accuracy(
        (v := validation(s, d).where("n <= 4").withColumn("g", F.concat_ws("|", "source", "uid"))).join(v.groupBy("g").count().where("count = 4").select("g"), "g"),
        "g", "n", F.col("value") > 50, F.col("pred") % 2 == 0, "source", F.col("value"), 30.000001,
    )
)
query("first_k_rate", with_sql("val", body=f"SELECT {r('avg(CASE WHEN pred % 2 = 0 THEN 1.0 ELSE 0 END)', 'rate')} FROM val WHERE n <= 3"))(lambda s, d: R.first_k_rate(validation(s, d), ["source", "uid"], "n", 3, F.col("pred") % 2 == 0))
query("numbered_groups", "SELECT event_id, dense_rank() OVER (ORDER BY f, user_id) - 1 AS group_no, place FROM (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS f, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place FROM events)")(
    lambda s, d: R.numbered_groups(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "group_no", "place")
)
query("token_difference", with_sql("tokens", body="SELECT traj_id, CAST(sum(CASE WHEN mask = 1 AND t % 2 <> t % 3 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM tokens GROUP BY traj_id"))(
    lambda s, d: sequences(s, d).select("traj_id", R.token_difference(F.transform("tok", lambda x: x["t"] % 2), F.transform("tok", lambda x: x["t"] % 3), F.transform("tok", lambda x: x["mask"])).alias("n"))
)
query("dense_flops", with_sql("traj", body=f"SELECT {r('(6.0 * ((3 * 64 * 256 + 64 * (2 * 8 + 2 * 2) * 8) * 4 + 2 * 1000 * 64) * sum(len) + 6.0 * 8 * 8 * 4 * sum(CAST(len AS DOUBLE) * len)) / 10 / 1e12', 'teraflops')} FROM traj"))(lambda s, d: R.dense_flops(trajectories(s, d), "len", 10, 64, 4, 8, 2, 256, 1000))
query("schema_report", "SELECT unnest(['r_regionkey', 'both']) AS \"column\", unnest([CASE WHEN typeof(min(r_regionkey)) = 'BIGINT' THEN 'bigint' ELSE 'int' END, 'array<struct<a:string>>']) AS type FROM region")(lambda s, d: R.schema_report(table(s, d, "region").select("r_regionkey", F.array(F.struct(F.col("r_name").alias("a"))).alias("both"))))
query("size_report", "SELECT unnest(['doc_id', 'lang']) AS \"column\", unnest([sum(length(CAST(doc_id AS VARCHAR))), sum(strlen(lang))]) ::BIGINT AS bytes FROM documents")(lambda s, d: R.size_report(table(s, d, "documents").select("doc_id", "lang")))
query("consistent_batch", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey AS k FROM orders")(lambda s, d: R.consistent(B.with_row_index(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), "k").withColumns({"a": F.array("k"), "b": F.array("k")}), ["a", "b"]).select("row_idx", "k"))
query("rows_and_columns", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s FROM orders")(
    lambda s, d: R.columns_of(R.rows_of(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("s")), ["c", "s"]), "values", ["c", "s"])
)
query("prefixed_names", "SELECT event_id, CASE WHEN event_type LIKE 'cl%' THEN event_type ELSE 'cl' || event_type END AS name FROM events")(lambda s, d: table(s, d, "events").select("event_id", R.prefixed(F.col("event_type"), "cl").alias("name")))
query("side_by_side", "SELECT o_orderkey, o_custkey AS base_c, o_custkey + 1 AS tuned_c FROM orders")(
    lambda s, d: R.side_by_side({"base": (o := table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))), "tuned": o.withColumn("c", F.col("c") + 1)}, "o_orderkey", ["c"]).select("o_orderkey", F.col("base.c").alias("base_c"), F.col("tuned.c").alias("tuned_c"))
)
query("changed_cases", "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_totalprice > 100000")(
    lambda s, d: R.changed(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2 == 0).alias("ok")), table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("ok")), "o_orderkey", F.col("before.ok") & F.col("after.ok"))
)

# A judge that answers by the order's customer; some answers are malformed.
_GOOD = '{"direct_answerable": false, "single_document_sufficient": %s, "needs_both_documents": true, "minimum_evidence_documents": %s, "ideal_search_calls": 2, "search_pattern": "sequential", "reason": " r%s "}'


def _answers(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = F.col("o_custkey")
    text = F.format_string(_GOOD, F.when(c % 3 == 0, "1").otherwise("true"), F.when(c % 5 == 0, "true").when(c % 5 == 1, "4").otherwise("2"), F.col("o_orderkey").cast("string"))
    return o.withColumn("text", F.when(c % 7 == 0, F.lit("no JSON")).otherwise(text))


_OK = "o_custkey % 7 <> 0 AND o_custkey % 3 <> 0 AND o_custkey % 5 > 1"
def _judge(row):
    if row["o_custkey"] % 11 == 0:
        raise ValueError("busy")
    return f"asked {row['o_custkey']}"


query("judge_decision", f"SELECT o_orderkey, CASE WHEN {_OK} THEN 'r' || o_orderkey END AS reason, CAST(CASE WHEN {_OK} THEN 2 END AS INTEGER) AS evidence FROM orders")(
    lambda s, d: _answers(s, d).withColumn("x", J.decision(F.col("text"), ["parallel", "sequential"])).select("o_orderkey", F.col("x.reason").alias("reason"), F.col("x.minimum_evidence_documents").alias("evidence"))
)
query("judge_cache", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'cached' WHEN o_custkey % 11 = 0 THEN NULL ELSE 'asked ' || o_custkey END AS answer, CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 11 = 0 THEN 'ValueError: busy' END AS error FROM orders")(
    lambda s, d: J.with_cache(
        (o := table(s, d, "orders").select("o_orderkey", "o_custkey")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("cached").alias("answer")), ["o_orderkey"], _judge
    ).select("o_orderkey", "answer", "error")
)
query("judge_quotas", "SELECT unnest(['F', 'O']) AS kind, unnest([20, 30]) ::BIGINT AS n, true AS apart")(
    lambda s, d: J.fill_quotas(J.candidates(_answers(s, d), 7, "o_orderkey", F.col("o_custkey") % 2 == 0), "o_orderstatus", {"F": 20, "O": 30}, 7, "o_orderkey").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"), (F.countDistinct("place") == F.count("*")).alias("apart"))
)
query("route_check", "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'bridge' ELSE 'compare' END AS route, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: J.check_routes(table(s, d, "orders").withColumn("route", F.when(F.col("o_custkey") % 2 == 0, "bridge").otherwise("compare")), "route", F.when(F.col("o_custkey") % 2 == 0, "bridge").otherwise("compare"), ["bridge", "compare"], True)
)

query("sync_windows", f"WITH {_NAMED} SELECT event_id // 32 AS version, name, {r('CASE event_id % 8 WHEN 0 THEN sum(value) WHEN 1 THEN arg_max(value, event_id) WHEN 2 THEN sum(value) WHEN 3 THEN avg(value) WHEN 4 THEN max(value) WHEN 5 THEN min(value) WHEN 6 THEN sum(value) ELSE avg(value) END', 'value')} FROM e GROUP BY 1, 2, event_id % 8")(
    lambda s, d: X.sync_windows(_metrics(s, d).select(F.col("event_id").alias("step"), "name", "value"), 32)
)
query("epoch_feed", "WITH o AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_regionkey AS k, count(*) OVER () AS n FROM region) SELECT CAST(e AS INTEGER) AS epoch, k, e * n + i AS place FROM o, range(3) t(e) WHERE e * n + i < 13")(
    lambda s, d: X.feed(B.with_row_index(table(s, d, "region").select(F.col("r_regionkey").alias("k")), "k"), 13).select("epoch", "k", "place")
)
query("replay_view", "SELECT user_id, k, event_id FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")(
    lambda s, d: X.replay(table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id", "event_type"), ["user_id", "k"], F.col("event_type") == "error", "event_id").select("user_id", "k", "event_id")
)
query("keyed_dump", "SELECT user_id, event_id FROM events WHERE user_id % 3 = 0")(lambda s, d: X.rows_of_keys(table(s, d, "events").select("user_id", "event_id"), table(s, d, "events").select("user_id").where("user_id % 3 = 0").distinct(), "user_id"))
query("corpus_build", "SELECT row_number() OVER (ORDER BY lower(coalesce(url, '')), page_id) AS id, page_id FROM pages")(lambda s, d: X.numbered_corpus(table(s, d, "pages").select("page_id", F.col("url").alias("title")), "title", "page_id").select("id", "page_id"))
query("collated_batches", with_sql("traj", body="SELECT uid, array_to_string(list(traj_id ORDER BY traj_id), ',') AS ids, sum(len)::BIGINT AS n, count(*) AS size FROM traj GROUP BY uid"))(
    lambda s, d: X.collated(trajectories(s, d).select("uid", "traj_id", F.array_repeat(F.col("len"), 1).alias("part"), F.transform(F.sequence(F.lit(1), F.col("len")), lambda x: x).alias("many")), "uid", "traj_id", ["traj_id"], ["many"])
    .select("uid", F.array_join("traj_id", ",").alias("ids"), F.size("many_values").cast("long").alias("n"), (F.size("many_offsets") - 1).cast("long").alias("size"))
)
query("sample_log", "SELECT 5 AS step, event_id AS sample, 'value' AS field, CAST(user_id AS VARCHAR) AS text FROM events WHERE event_id < 10 UNION ALL SELECT 5, event_id, 'type', event_type FROM events WHERE event_id < 10")(
    lambda s, d: X.sample_log(table(s, d, "events").where("event_id < 10").select("event_id", F.col("user_id").cast("string").alias("value"), F.col("event_type").alias("type")), 5, "event_id")
)
