"""Line deduplication by pairwise alignment of documents that share lines.

A text's elements are its runs: the shortest runs of lines of MIN_WORDS words, forwards and backwards from each line. They
make up every longer block of lines, and a run that two documents share is a block that is contiguous in both. Single
short lines, which very many documents share, nominate nothing; that is the rarity asked of a line hash. A run that
several documents hold nominates one pair for each later document: the one with the run's first holder (the least
doc_id), so that even a run of a third of all documents makes a star and never all pairs, and no frequency limit is needed.

Each pair is aligned once by patience diff, over the runs that nominated it: runs that are unique in both documents are
anchors, a longest chain of anchors in the order of both documents is kept, and the gaps between them are aligned the
same way; a gap without anchors is aligned from its beginning in order. The lines of aligned runs are deleted from the
later document. Runs that cross the alignment stay: a header that comes again as a footer, or blocks in another order.

Defined results: null texts stay null; blank lines are in no run, and stay; a text of which nothing is left but them has
only them; rows without doc_id are left as they are; rows that repeat doc_id and text are treated alike, and rows that
repeat doc_id alone count as documents in the order of their texts' hashes; a very long text is one row as any other (its
arrays are a few times its size); an empty table gives no rows; extra columns stay, and one named removed_lines is replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

RUNS = "doc_id long, th long, h long, size int, n_lines int, at array<int>"


def runs(docs: DataFrame) -> DataFrame:
    """A row for each distinct run of each text: its hash, its bytes, its lines, and at: the numbers of its lines, place after place."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for a, b in common.pieces(offsets):
                yield _batch_runs(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, RUNS)


def _runs(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the shortest runs of lines of one document with MIN_WORDS words, forwards and backwards from each line."""
    total = np.append(0, np.cumsum(words))
    line = np.arange(len(doc))
    last = np.searchsorted(total, total[:-1] + MIN_WORDS) - 1
    first = np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1
    a, b = np.concatenate([line, first]), np.concatenate([last, line])
    ok = (a >= 0) & (b < len(doc))
    ok[ok] = doc[a[ok]] == doc[b[ok]]
    # A run of one line is found both ways; it has at most MIN_WORDS lines.
    key = np.unique(a[ok] * (MIN_WORDS + 1) + b[ok] - a[ok])
    return key // (MIN_WORDS + 1), key // (MIN_WORDS + 1) + key % (MIN_WORDS + 1)


def _batch_runs(batch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    # An offset and the end of a feed can be the same place; both start a line, the first of them an empty one.
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    per = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    doc = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    w_start, _ = common.runs(~_SPACE[data], offsets)
    words = np.searchsorted(w_start, ends) - np.searchsorted(w_start, starts)
    keep = words > 0
    starts, ends, doc, number, words = (x[keep] for x in (starts, ends, doc, number, words))
    line, total = common.slice_hashes(data, starts, ends), np.append(0, np.cumsum(ends - starts))
    at, last = _runs(doc, words)
    n, size, doc = last - at + 1, total[last + 1] - total[at], doc[at]
    h = np.zeros(len(at), np.uint64)
    for k in range(MIN_WORDS):
        on = np.flatnonzero(n > k)
        h[on] = common.mix(h[on] * np.uint64(3) + line[at[on] + k])
    h = h.view(np.int64)
    by = np.lexsort((at, h, doc))
    doc, h, at, size, n = doc[by], h[by], at[by], size[by], n[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)
    ends = np.append(0, np.cumsum(n))
    at = number[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
    owner = pa.array(doc[head])
    return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(h[head]), pa.array(size[head].astype(np.int32)), pa.array(n[head].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends[np.append(head, len(n))].astype(np.int32)), pa.array(at.astype(np.int32)))], names=["doc_id", "th", "h", "size", "n_lines", "at"])


def _longest_rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence."""
    tails, tops, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            tails.append(i)
        else:
            tops[k], tails[k] = v, i
        back.append(tails[k - 1] if k else -1)
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(shared: list[tuple[list[int], list[int]]]) -> set[tuple[int, int]]:
    """Places (in the later document, in the earlier one) that a patience diff aligns, in the order of both.

    shared: for each common run, its places in the later and in the earlier document, rising. Ranges (of both documents)
    are worked off on a stack.
    """
    got: set[tuple[int, int]] = set()
    top = 1 << 60
    work = [([(bs, as_) for bs, as_ in shared if bs and as_], -1, top, -1, top)]
    while work:
        inside, b0, b1, a0, a1 = work.pop()
        if not inside:
            continue
        single = [len(bs) == len(as_) == 1 for bs, as_ in inside]
        # Of anchors with one place in the later document, the chain can hold one: they come with falling places in the other.
        anchors = sorted({(bs[0], -as_[0]) for (bs, as_), one in zip(inside, single, strict=True) if one})
        if not anchors:
            at = (-1, a0)
            for b, as_ in sorted((b, as_) for bs, as_ in inside for b in bs):
                k = bisect_left(as_, at[1] + 1)
                if b > at[0] and k < len(as_):
                    at = (b, as_[k])
                    got.add(at)
            continue
        chain = [(anchors[k][0], -anchors[k][1]) for k in _longest_rising([-a for _, a in anchors])]
        got.update(chain)
        # Each of the other runs goes to the gaps that it has places in, with these alone, so a level costs no more than its places.
        edges = [(b0, a0), *chain, (b1, a1)]
        begins = [b for b, _ in edges]
        gaps: dict[int, list] = {}
        for (bs, as_), one in zip(inside, single, strict=True):
            if not one:
                at = 0
                while at < len(bs):
                    g = bisect_left(begins, bs[at]) - 1
                    end = bisect_left(bs, edges[g + 1][0], at)
                    held = as_[bisect_left(as_, edges[g][1] + 1) : bisect_left(as_, edges[g + 1][1])]
                    inner = bs[at + (bs[at] == edges[g + 1][0]) : end]
                    if inner and held:
                        gaps.setdefault(g, []).append((inner, held))
                    at = max(end, at + 1)
        work += [(p, edges[g][0], edges[g + 1][0], edges[g][1], edges[g + 1][1]) for g, p in gaps.items()]
    return got


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    return column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy())).astype(np.int64)


def _aligned(table: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (doc_id, th, f, n_lines, at, f_at) of whole documents, ordered by the first three -> (doc_id, th, drop) of each document."""
    doc_id, th, f, n = (table.column(k).to_numpy() for k in range(4))
    n = n.astype(np.int64)
    (at, b_off), (f_at, a_off) = _lists(table.column(4)), _lists(table.column(5))
    rows = len(n)
    new_doc, new_pair = np.ones(rows, bool), np.ones(rows, bool)
    new_doc[1:] = (doc_id[1:] != doc_id[:-1]) | (th[1:] != th[:-1])
    new_pair[1:] = new_doc[1:] | (f[1:] != f[:-1])
    pair = np.cumsum(new_pair) - 1
    # Where each run has one place in both documents and their orders agree, all runs of the pair are aligned.
    b, a = at[b_off[:-1]], f_at[a_off[:-1]]
    plain = (np.diff(b_off) == n) & (np.diff(a_off) == n)
    by = np.lexsort((a, b, pair))
    sb, sa, sp = b[by], a[by], pair[by]
    rising = (sp[1:] != sp[:-1]) | ((sb[1:] > sb[:-1]) & (sa[1:] > sa[:-1])) | ((sb[1:] == sb[:-1]) & (sa[1:] == sa[:-1]))
    bad = np.zeros(pair[-1] + 1, bool)
    bad[pair[~plain]] = True
    bad[sp[1:][~rising]] = True
    good = np.repeat(~bad[pair], np.diff(b_off))
    edges = np.append(np.flatnonzero(new_pair), rows)
    for p in np.flatnonzero(bad).tolist():
        x, y = int(edges[p]), int(edges[p + 1])
        shared = [(at[b_off[i] : b_off[i + 1] : n[i]].tolist(), f_at[a_off[i] : a_off[i + 1] : n[i]].tolist()) for i in range(x, y)]
        to: dict[int, int] = dict(patience(shared))
        for i, (bs, as_) in zip(range(x, y), shared, strict=True):
            places = set(as_)
            for k, place in enumerate(bs):
                if to.get(place, -1) in places:
                    good[b_off[i] + k * n[i] : b_off[i] + (k + 1) * n[i]] = True
    doc = np.repeat(np.cumsum(new_doc) - 1, np.diff(b_off))[good]
    line = at[good].astype(np.int64)
    size = np.zeros(int(new_doc.sum()), np.int64)
    np.maximum.at(size, doc, line + 1)
    ends = np.append(0, np.cumsum(size))
    flags = np.zeros(int(ends[-1]), bool)
    flags[ends[doc] + line] = True
    head = pa.array(np.flatnonzero(new_doc))
    return pa.RecordBatch.from_arrays([table.column(0).take(head), table.column(1).take(head), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flags))], names=["doc_id", "th", "drop"])


def _align(batches):
    """_aligned() over a stream, of which it holds one batch and the rows of one document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc_id, th = (batch.column(k).to_numpy() for k in (0, 1))
        last = np.flatnonzero((doc_id != doc_id[-1]) | (th != th[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if not cut and held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (doc_id[-1], th[-1]):
            yield _aligned(pa.concat_batches(held))
            held = []
        elif cut:
            yield _aligned(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _aligned(pa.concat_batches(held))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, drop): true at the lines to delete, of each document that shares some; th is xxhash64(text)."""
    table = common.written(runs(docs), "runs")
    # The first holder of each shared run with its places; a table of its own, so that the join can split a hot run.
    first = table.groupBy("h", "size").agg(F.min(F.struct("doc_id", "th", "at")).alias("f"), F.max(F.struct("doc_id", "th")).alias("l")).where("f.doc_id <> l.doc_id or f.th <> l.th").select("h", "size", F.col("f.doc_id").alias("f_id"), F.col("f.th").alias("f_th"), F.col("f.at").alias("f_at"))
    pairs = table.join(common.written(first, "first-holders"), ["h", "size"]).where("doc_id <> f_id or th <> f_th")
    # Rows with equal doc_id and text have the same runs; distinct() leaves one of each before they meet in a task.
    pairs = pairs.select("doc_id", "th", F.xxhash64("f_id", "f_th").alias("f"), "n_lines", "at", "f_at").distinct()
    return pairs.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "f").mapInArrow(_align, "doc_id long, th long, drop array<boolean>")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated blocks of lines deleted from text; the columns of docs, and removed_lines (int)."""
    drops = repeated_lines(docs).select(F.col("doc_id").alias("id"), "th", "drop")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = keyed.join(drops, ["id", "th"], "left")
    kept = F.filter(F.split("doc.text", "\n", -1), lambda x, i: ~F.coalesce(F.get("drop", i), F.lit(False)))
    text = F.when(F.col("drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("doc.text"))
    removed = F.when(F.col("drop").isNull(), 0).otherwise(F.size(F.filter("drop", lambda x: x)))
    return joined.select(*[(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c != "removed_lines"], removed.alias("removed_lines"))
