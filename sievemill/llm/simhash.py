"""SimHash near-duplicates: meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a value within half the radius of both. Every distinct fingerprint therefore
emits all variants of up to half the radius, and fingerprints that share a variant are linked. The shuffle is on the
variants, but a variant is not a row: a fingerprint is sent once to each prefix that any of its variants has, and the
task of a prefix makes the variants with that prefix, sorts them, and links the owners of equal ones. As all owners of
one variant are within the radius of each other (for an odd radius: of those that are nearer to it), they are linked to
the smallest owner, so a large ball costs a star, not all pairs. The number of prefixes follows the number of
fingerprints; a prefix with too many variants is split by its next bits, where a fingerprint goes only to those
continuations that its variants have, so that no variant is made twice.

keep_one() takes documents as near-duplicates whose sets of NEAR_WORDS-word shingles have a Jaccard similarity of NEAR or
more. Links of fingerprints, over shingles as long, are its first candidates, but a ball cannot hold that similarity (at 0.8
fingerprints are some ten bits apart, and a ball of ten has 10**8 variants). Further candidates therefore share one of BANDS
bands of ROWS minima of the hashed shingles: first each text with the first of its band, then, across the
components that those links make, all texts of a band whose sketches (four bits of each minimum) agree as far as similar
texts' do. No candidate is cut off; each is verified on its whole sets. Of pairs at 0.8, one in 5,000 shares no band and
one in 30,000 has sketches too far apart. A band of very many texts that are not similar is compared sketch by sketch.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other, and are near-duplicates of each
other; rows with equal fingerprints are one component; rows with a null doc_id keep their component but never name
it (a component of none but such rows has a null component_id); repeated rows are each returned by near_duplicates() and
once by keep_one(); a very long text is hashed whole, a megabyte-sized one as a run of its own; an empty table gives no
rows; extra columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a prefix whose variants fit in about 64 MB, and variants that a task makes.
PREFIX_FINGERPRINTS, TASK_VARIANTS = 4000, 8_000_000
#: Bits by which a prefix with more variants is made longer, and the most bits of one: 256 fingerprints can then agree in all of them.
MORE_BITS, MOST_BITS = 8, 56

#: Similarity 4/5, and minima (of BANDS * ROWS) whose four bits may differ in sketches of candidates: four deviations over the mean at 0.8.
NEAR_WORDS, NEAR, BANDS, ROWS, SKETCH_APART = 5, (4, 5), 36, 7, 72
_rng = np.random.default_rng(SEED)
_TIMES, _PLUS = _rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES |= np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of an ASCII-lower-cased text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    w = min(width, len(words)) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(words) - w].tolist(), ends[w:].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    full = len(bits) // 255 * 255
    if full:
        total += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    total += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text, as a signed long."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            text, o = data.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(text[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, weight: int) -> np.ndarray:
    """All values below 2**bits with at most `weight` bits set."""
    return np.array([sum(1 << b for b in c) for w in range(weight + 1) for c in combinations(range(bits), w)], np.uint64)


def ball_links(fps: np.ndarray, names: np.ndarray, prefix: int, bits: int, radius: int) -> np.ndarray:
    """Rows (name, fingerprint, name, fingerprint): owners of equal variants with this prefix (their lowest bits) and the least of them by name."""
    half, near = (radius + 1) // 2, radius // 2
    low = np.uint64((1 << bits) - 1)
    by = np.lexsort((fps, names))
    fps, names = fps[by].astype(np.uint64), names[by]
    apart = np.bitwise_count((fps & low) ^ np.uint64(prefix))
    found = []
    for k in range(half + 1):
        # The rest of each variant: the flips that the prefix leaves, in the upper bits.
        high = _masks(64 - bits, half - k) << np.uint64(bits)
        close = np.bitwise_count(high) + k <= near
        at = np.flatnonzero(apart == k)
        for a in range(0, len(at), PREFIX_FINGERPRINTS):
            own = at[a : a + PREFIX_FINGERPRINTS]
            made = (((fps[own] & ~low) | np.uint64(prefix))[:, None] ^ high[None, :]).ravel()
            found.append((made, np.repeat(own.astype(np.int32), len(high)), np.tile(close, len(own))))
    variants, owners, closes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 3
    # Only values that occur twice matter; one plain sort finds them.
    values = np.sort(variants)
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    if not len(twice):
        return np.zeros((0, 4), np.int64)
    slot = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    held = np.flatnonzero(twice[slot] == variants)
    slot, owner, is_close = slot[held], owners[held], closes[held].astype(bool)
    least = np.full(len(twice), len(fps), np.int64)
    np.minimum.at(least, slot[is_close], owner[is_close])
    pairs = np.stack([owner, least[slot]], 1)[least[slot] < len(fps)]
    b, a = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0).T
    within = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    a, b = a[within], b[within]
    signed = fps.view(np.int64)
    return np.stack([names[a], signed[a], names[b], signed[b]], 1)


def _longer(rows: DataFrame, held: int, more: int, half: int) -> DataFrame:
    """rows(fp, name, k, prefix: `held` bits, k of them flipped) under each prefix of `more` further bits that one of their variants has."""
    flips = F.array(*[F.lit(int(m)) for m in _masks(more, half)])
    wide = rows.select("*", F.explode(F.filter(flips, lambda m: F.bit_count(m) + F.col("k") <= half)).alias("flip"))
    own = F.shiftrightunsigned("fp", held).bitwiseAND((1 << more) - 1)
    return wide.select("fp", "name", (F.col("k") + F.bit_count("flip")).alias("k"), F.col("prefix").bitwiseOR(F.shiftleft(own.bitwiseXOR(F.col("flip")), held)).alias("prefix"))


def prefixes(distinct: DataFrame, radius: int, bits: int) -> DataFrame:
    """(fp, name, bits, prefix): every fingerprint under each prefix of its variants, those with too many variants made longer."""
    half = (radius + 1) // 2
    rows, held, more, ready = distinct.select("fp", "name", F.lit(0).alias("k"), F.lit(0).cast("long").alias("prefix")), 0, bits, None
    while True:
        rows, held = _longer(rows, held, more, half), held + more
        made = F.element_at(F.array(*[F.lit(len(_masks(64 - held, half - k))) for k in range(half + 1)]), F.col("k") + 1)
        hot = common.written(rows.groupBy("prefix").agg(F.sum(made).alias("variants")).where(F.col("variants") > TASK_VARIANTS).select("prefix"), "hot-prefixes")
        more = min(MORE_BITS, MOST_BITS - held)
        last = more <= 0 or hot.isEmpty()
        whole = (rows if last else rows.join(hot, "prefix", "left_anti")).select("fp", "name", F.lit(held).alias("bits"), "prefix")
        ready = whole if ready is None else ready.unionByName(whole)
        if last:
            return ready
        rows = rows.join(hot, "prefix", "left_semi").select("fp", "name", "k", "prefix")


def link(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (src, dst) that connect every two fingerprints within `radius` bits.

    distinct(fp, name): every fingerprint once, with a number; src and dst: structs of name and fp, src the greater one.
    """
    n = distinct.count()
    bits = min(24, max(6, ceil(log2(max(1, n) / PREFIX_FINGERPRINTS)) if n > PREFIX_FINGERPRINTS else 0))

    def run(key, frame):
        pairs = ball_links(frame["fp"].to_numpy().view(np.uint64), frame["name"].to_numpy(), int(key[1]), int(key[0]), radius)
        return pd.DataFrame(dict(zip(("a", "a_fp", "b", "b_fp"), pairs.T, strict=True)))

    found = prefixes(distinct, radius, bits).repartition(min(1 << bits, 4096), "bits", "prefix").groupBy("bits", "prefix").applyInPandas(run, "a long, a_fp long, b long, b_fp long")
    ends = [F.struct(F.col(c).alias("name"), F.col(f"{c}_fp").alias("fp")) for c in ("a", "b")]
    return found.select(ends[0].alias("src"), ends[1].alias("dst"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text); component_id: the smallest doc_id that can be reached."""
    fps = common.written(fingerprints(docs), "fingerprints")
    # A class of equal fingerprints goes by its least doc_id, and so does a component: the least of its classes is its root.
    none = (1 << 63) - 1
    classes = common.written(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(none)).alias("name"), F.count("*").alias("n")), "classes")
    parts = common.components(link(classes.select("fp", "name"), radius), "simhash")
    roots = parts.select(F.col("id.fp").alias("fp"), F.col("root.name").alias("root"))
    named = classes.join(roots, "fp", "left").select("fp", "n", F.nullif(F.coalesce("root", "name"), F.lit(none)).alias("component_id"))
    total = fps.count()
    return common.split_join(fps, named, "fp", "n", total).select("doc_id", "fp", "component_id")


def fingerprint_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of every text, text after text, how many each has); a shorter text is one shingle."""
    starts, ends = common.runs(~_SPACE[data], offsets)
    per = np.diff(np.searchsorted(starts, offsets))
    words = common.slice_hashes(_LOWER[data], starts, ends)
    width = np.minimum(per, NEAR_WORDS)
    count = np.where(per > 0, per - width + 1, 0)
    doc = np.repeat(np.arange(len(per)), count)
    at = np.arange(len(doc)) + np.repeat(np.cumsum(per) - per - np.cumsum(count) + count, count)
    w = width[doc]
    h = w.astype(np.uint64)
    for k in range(NEAR_WORDS):
        on = np.flatnonzero(w > k)
        h[on] = common.mix(h[on] * np.uint64(3) + words[at[on] + k])
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(per))


def minima(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set that is not empty a row of band keys, and a sketch of four bits of each minimum."""
    heads = (np.cumsum(count) - count)[count > 0]
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(heads), 1))
    sketch = np.zeros((len(heads), -(-BANDS * ROWS // 16)), np.uint64)
    if len(heads):
        for k in range(BANDS * ROWS):
            least = common.mix(np.minimum.reduceat(h * _TIMES[k] + _PLUS[k], heads))
            keys[:, k // ROWS] = common.mix(keys[:, k // ROWS] * np.uint64(3) + least)
            sketch[:, k // 16] |= (least & np.uint64(15)) << np.uint64(k % 16 * 4)
    return keys, sketch


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, row, fp, n, bands, sketch) of every row: keys of its text and of itself, fingerprint, shingles, their bands and sketch."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(3))
            for a, b in common.pieces(offsets):
                part, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, cut = part.tobytes(), o.tolist()
                fps = np.array([fingerprint(text[x:y], NEAR_WORDS) for x, y in zip(cut[:-1], cut[1:], strict=True)], np.uint64).view(np.int64)
                h, count = shingle_sets(part, o)
                some = np.append(0, np.cumsum(count > 0)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(some * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in minima(h, count)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(fps), pa.array(count.astype(np.int32)), *lists], names=["doc_id", "th", "row", "fp", "n", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("th"), common.row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, row long, fp long, n int, bands array<long>, sketch array<long>")


def set_table(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(th, set): the distinct shingles of the texts of rows(row), one row for each text."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets):
                h, count = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(h.view(np.int64)))], names=["th", "set"])

    texts = docs.select(common.row_key().alias("row"), common.text_key().alias("th"), F.col("text").cast("string").alias("text")).join(rows, "row", "left_semi").dropDuplicates(["row"])
    return common.written(texts.select("th", "text").mapInArrow(run, "th long, set array<long>"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (src, dst) whose sets are similar; two empty sets are."""
    near, of = NEAR
    both = pairs.join(sets.select(F.col("th").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("th").alias("dst"), F.col("set").alias("b")), "dst")
    # i / (|a| + |b| - i) >= near / of, in whole numbers.
    return both.where((near + of) * F.size(F.array_intersect("a", "b")) >= near * (F.size("a") + F.size("b"))).select("src", "dst")


def similar_texts(docs: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """(id, root): components of the texts (th) of classes(th, row, fp, n, bands, sketch) that are near-duplicates of others."""
    near, of = NEAR
    fits = of * F.least("n", "m") >= near * F.greatest("n", "m")
    ordered = lambda df: df.select(F.greatest("th", "o").alias("src"), F.least("th", "o").alias("dst"))
    by_fp = common.written(classes.groupBy("fp").agg(F.min("th").alias("name")), "fingerprints")
    balls = link(by_fp, radius).select(F.col("src.name").alias("src"), F.col("dst.name").alias("dst"))
    equal = ordered(classes.select("th", "fp").join(by_fp.select("fp", F.col("name").alias("o")), "fp").where("th <> o"))
    # Rows of bands that several texts share, with the first of each.
    shared = classes.select("th", "n", F.explode("bands").alias("band"))
    first = common.written(shared.groupBy("band").agg(F.min(F.struct("n", "th")).alias("f"), F.max("th").alias("l"), F.min("th").alias("e")).where("l <> e").select("band", F.col("f.n").alias("m"), F.col("f.th").alias("o")), "bands")
    members = common.written(shared.join(first, "band"), "band-members")
    pairs = common.written(ordered(members.where("th <> o").where(fits)).unionByName(balls).unionByName(equal).distinct(), "candidates")
    nodes = members.select("th").unionByName(pairs.select(F.col("src").alias("th"))).unionByName(pairs.select(F.col("dst").alias("th"))).distinct()
    sets = set_table(docs, classes.join(nodes, "th").select("row"))
    links = common.written(verified(pairs, sets), "links")
    parts = common.components(links, "near")
    # What is left: pairs of a band across components, each in the first band that it shares.
    whole = classes.select("th", "bands", "sketch")
    named = members.select("band", "th", "n").join(parts.withColumnRenamed("id", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    mixed = named.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    named = common.written(named.join(mixed, "band", "left_semi").join(whole, "th"), "mixed-bands")
    other = named.select(*[F.col(c).alias(f"other_{c}") for c in named.columns]).withColumnsRenamed({"other_n": "m", "other_th": "o"})
    differ = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x1111111111111111)))
    apart = F.aggregate(F.zip_with("sketch", "other_sketch", lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, x: s + differ(x))
    shares = F.element_at(F.filter(F.zip_with("bands", "other_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
    rest = named.join(other, (named.band == other.other_band) & (F.col("th") > F.col("o")) & (F.col("root") != F.col("other_root")) & fits & (apart <= SKETCH_APART) & (shares == F.col("band")))
    more = common.written(ordered(rest).distinct(), "candidates")
    if more.isEmpty():
        return parts
    return common.components(links.unionByName(verified(more, sets)), "near")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs of each component of near-duplicates: that with the least doc_id, one without doc_id only if none has one."""
    rows = common.written(signatures(docs), "signatures")
    classes = rows.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "bands", "sketch")])
    classes = common.written(classes.select("th", "first", F.col("first.row").alias("row"), "fp", "n", "bands", "sketch"), "texts")
    parts = similar_texts(docs, classes, radius)
    roots = classes.join(parts, classes.th == parts.id, "left").select(F.coalesce("root", "th").alias("root"), "first")
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return docs.select(common.row_key().alias("row"), common.whole_row(docs).alias("doc")).join(kept, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
