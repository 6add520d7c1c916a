"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task takes its share of the documents in shards of bounded size, builds a suffix array over the words of each
shard, and binary-searches every suffix of the test items in it, word by word. The interval of a suffix at a window's
length gives all places of that window; chained along their diagonals they give the longest verbatim matches (those
of fewer words than a window are none). No document text is shuffled. The test set is prepared in tasks, as blocks of a
fixed size that are written to the shared folder; a single block goes along with the tasks, more are read by them.

Defined results: ids are whole numbers; null or wordless texts have no words and no hits; an item without words, text or
id is ignored; repeated rows each get their own result; a very long text makes a shard of its own; an empty benchmark
or table gives rows without hits or no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a window, words in a shard (about 200 MB of arrays), bytes of text in a block of test items (its arrays take some ten times that).
WINDOW, SHARD_WORDS, BLOCK_BYTES = 10, 1_000_000, 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, longest_words long, longest_start long, longest_item long, longest_item_start long"


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text)."""
    low = _LOWER[data]
    starts, ends = common.runs(_IS_WORD[low], offsets)
    return common.slice_hashes(low, starts, ends), np.diff(np.searchsorted(starts, offsets))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes in the order of their suffixes' first `depth` codes, by prefix doubling of unsettled groups."""
    n = len(codes)
    order = np.argsort(codes, kind="stable").astype(np.int64)
    rank = np.zeros(n + 1, np.int64)
    active, keys, k = np.arange(n), codes[order], 1
    while True:
        new = np.ones(len(active), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank[order[active]] = active[start] + 1
        last = np.ones(len(active), bool)
        last[:-1] = new[1:]
        active = active[~(new & last)]
        if k >= depth or not len(active):
            return order
        at = order[active]
        keys = rank[at] * (n + 2) + rank[np.minimum(at + k, n)]
        by = np.argsort(keys, kind="stable")
        order[active], keys = at[by], keys[by]
        k *= 2


def search(codes: np.ndarray, order: np.ndarray, tests: np.ndarray, begin: np.ndarray, length: np.ndarray, want: np.ndarray):
    """Binary search of test suffixes, all at once: (lo, hi) of each at its wanted length; lo == hi if it is not there.

    begin, length: place of each suffix in tests; want: words after which its interval is kept.
    """
    n = len(order)
    padded = np.append(codes, np.zeros(int(want.max(initial=0)) + 1, np.uint64))
    lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), n, np.int64)
    live = np.flatnonzero(length >= want)
    lo[length < want] = hi[length < want] = 0
    for j in range(int(want.max(initial=0))):
        live = live[want[live] > j]
        if not len(live):
            break
        target = tests[begin[live] + j]
        for side in (0, 1):
            a, b = lo[live], hi[live]
            if side:
                b = top
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                here = padded[order[np.minimum(mid, n - 1)] + j]
                right = open_ & ((here < target) if side == 0 else (here <= target))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            if side == 0:
                top, found = hi[live], a
        lo[live], hi[live] = found, a
        gone = found >= a
        lo[live[gone]] = hi[live[gone]] = 0
        live = live[~gone]
    return lo, hi


class Tests:
    """A block of test items as one array of word codes with the windows to look for."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int):
        codes, counts = word_codes(data, offsets)
        first = np.cumsum(counts) - counts
        # Items of equal words are one class, of which the smallest id stands for all.
        classes: dict[bytes, int] = {}
        of = np.array([classes.setdefault(codes[a : a + n].tobytes(), len(classes)) for a, n in zip(first.tolist(), counts.tolist(), strict=True)], np.int64)
        by = np.lexsort((ids, of))
        self.class_ids, self.class_from = ids[by], np.searchsorted(of[by], np.arange(len(classes) + 1))
        one = by[self.class_from[:-1]]
        ids, first, counts = ids[one], first[one], counts[one]
        width = np.minimum(counts, window)
        n_win = np.where(counts > 0, counts - width + 1, 0)
        self.ids = ids
        item = np.repeat(np.arange(len(ids)), n_win)
        place = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        self.codes = codes
        begin, size = first[item] + place, width[item]
        # Equal windows are looked for once: of each length, they are grouped by their words.
        self.of = np.zeros(len(begin), np.int64)
        groups = 0
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            words = np.ascontiguousarray(codes[begin[at][:, None] + np.arange(w)]).view(f"V{8 * w}").ravel()
            _, inverse = np.unique(words, return_inverse=True)
            self.of[at] = groups + inverse
            groups += int(inverse.max()) + 1
        one = np.unique(self.of, return_index=True)[1] if len(begin) else np.zeros(0, np.int64)
        self.begin, self.want, self.item, self.place = begin[one], size[one], item, place
        self.length = self.want.copy()


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all values in [lo, hi), interval after interval."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


#: Matches, of a window's place in a text with its place in an item, that are held at once.
MATCHES = 1 << 20


def _matches(t: Tests, win: np.ndarray, where: np.ndarray, size: int):
    """(class, place in it, place in the line, width) of all matches, class by class; one with very many by ranges of diagonals.

    win, where: the windows found and their places, sorted; size: more than any place.
    """
    edge = np.searchsorted(win, np.arange(len(t.want) + 1))
    n = np.diff(edge)[t.of]
    held = np.flatnonzero(n)
    item, place, of, n = t.item[held], t.place[held], t.of[held], n[held]
    from_ = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    to, total = np.append(from_[1:], len(item)), np.append(0, np.cumsum(n))
    at = 0
    while at < len(from_):
        # As many classes as stay below MATCHES, or one.
        end = max(at + 1, int(np.searchsorted(total[to], total[from_[at]] + MATCHES, "right")))
        a, b = int(from_[at]), int(to[end - 1])
        if total[b] - total[a] <= MATCHES:
            row, spot = _spans(edge[of[a:b]], edge[of[a:b] + 1])
            yield item[a:b][row], place[a:b][row], where[spot], t.want[of[a:b]][row]
        else:  # a diagonal holds one match at most for each place of the item
            key, step = win * size + where, max(1, MATCHES // (b - a))
            base, shift = of[a:b] * size, place[a:b]
            for d in range(-int(shift.max()), size, step):
                lo, hi = (np.searchsorted(key, base + np.clip(x + shift, 0, size - 1)) for x in (d, d + step))
                row, spot = _spans(lo, hi)
                if len(row):
                    yield item[a:b][row], shift[row], where[spot], t.want[of[a:b]][row]
        at = end


def shard_hits(codes: np.ndarray, counts: np.ndarray, blocks, window: int = WINDOW) -> dict[str, list]:
    """What blocks of tests, of windows of at most `window` words, find in the texts of a shard: a row for each text."""
    n_docs, total = len(counts), int(counts.sum())
    # A zero between two texts, which no test word equals, keeps matches inside a text.
    first = np.cumsum(counts) - counts + np.arange(n_docs)
    line = np.zeros(total + n_docs + 1, np.uint64)
    line[np.arange(total) + np.repeat(np.arange(n_docs), counts)] = codes
    cover = np.zeros(len(line) + 1, np.int64)
    pairs, best = [], [(np.zeros(0, np.int64),) * 5]
    order = None
    for t in blocks:
        if order is None:
            order = suffix_array(line, window)
        lo, hi = search(line, order, t.codes, t.begin, t.length, t.want)
        win, slot = _spans(lo, hi)
        where = order[slot]
        by = np.lexsort((where, win))
        win, where = win[by], where[by]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + t.want[win], -1)
        found = []
        for item, place, at, width in _matches(t, win, where, len(line) + 1):
            doc = np.searchsorted(first, at, "right") - 1
            found.append(np.unique(doc * len(t.ids) + item))
            # Windows that follow each other on a diagonal make one longest match.
            by = np.lexsort((at, at - place, item))
            item, at, place, width, doc = item[by], at[by], place[by], width[by], doc[by]
            new = np.ones(len(by), bool)
            new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(by))) - 1 + width[head]
            best.append(_leaders((doc[head], size, at[head] - first[doc[head]], t.ids[item[head]], place[head])))
        # Each class of a text once, then all its items.
        doc, item = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), max(len(t.ids), 1))
        row, member = _spans(t.class_from[item], t.class_from[item + 1])
        pairs.append((doc[row], t.class_ids[member]))
    hit = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
    n_hit = hit[first + counts] - hit[first]
    doc, items = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    by = np.lexsort((items, doc))
    doc, items = doc[by], items[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (items[1:] != items[:-1]))[: len(doc)]
    doc, items = doc[new], items[new]
    edge = np.searchsorted(doc, np.arange(n_docs + 1))
    b = _leaders([np.concatenate(x) for x in zip(*best, strict=True)])
    longest = [np.full(n_docs, fill, np.int64) for fill in (0, -1, -1, -1)]
    for out, x in zip(longest, b[1:], strict=True):
        out[b[0]] = x
    return {"n_words": counts, "n_hit": n_hit, "items": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(items, pa.int64())), "longest": longest}


def _leaders(b) -> list[np.ndarray]:
    """Of (text, length, start, item, start in it) the longest match of each text; of equals that with the smallest numbers."""
    by = np.lexsort((b[4], b[3], b[2], -b[1], b[0]))
    by = by[np.append(True, np.diff(b[0][by]) != 0)[: len(by)]]
    return [x[by] for x in b]


def _blocks(bench: DataFrame, window: int) -> list:
    """The test items as blocks of bounded size: a single one in memory, more as files of the shared folder."""
    base = common.work_dir(bench.sparkSession, "tests")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root)
        held, size = [], 0

        def put():
            nonlocal held, size
            if held:
                ids, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
                name = f"{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(pickle.dumps(Tests(ids.to_numpy(), *common.utf8(texts), window)))
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])
                held, size = [], 0

        for batch in batches:
            _, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets, BLOCK_BYTES):
                if size + int(offsets[b] - offsets[a]) > BLOCK_BYTES:
                    yield from put()
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
        yield from put()

    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(10_000, size // BLOCK_BYTES + 1)
    # Only names of blocks come to the driver; a file that a lost task left is not among them.
    names = [r[0] for r in items.repartition(parts).mapInArrow(run, "block string").collect()]
    paths = [f"{base}/{name}" for name in names]
    return [_load(paths[0])] if len(paths) == 1 else paths


def _load(block):
    if not isinstance(block, str):
        return block
    fs, path = pafs.FileSystem.from_uri(block)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs(doc_id, text): hit words, the items with occurring windows, the longest match and its places.

    A window is `window` consecutive words of an item of bench(item_id, text), or all words of a shorter item.
    longest_start and longest_item_start count words; -1 where there is no match.
    """
    common.prepare(docs.sparkSession)
    blocks = _blocks(bench, window)

    def run(batches):
        ids, codes, counts, n = [], [], [], 0

        def flush():
            nonlocal ids, codes, counts, n
            if ids:
                r = shard_hits(np.concatenate(codes), np.concatenate(counts), map(_load, blocks), window)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(r["n_words"]), pa.array(r["n_hit"]), r["items"], *map(pa.array, r["longest"])], schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), *((f"longest_{k}", pa.int64()) for k in ("words", "start", "item", "item_start"))]))
            ids, codes, counts, n = [], [], [], 0

        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets, 2 << 20):
                c, k = word_codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids.append(batch.column(0).slice(a, b - a))
                codes.append(c)
                counts.append(k)
                n += len(c)
                if n >= SHARD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def contamination_digest(found: DataFrame) -> DataFrame:
    """find_contamination's rows with the items as a digest."""
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_words", "longest_start", "longest_item")


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, with their columns; each row is judged by its own text."""
    rows = docs.select(common.row_key().alias("doc_id"), "text")
    return common.without(docs, find_contamination(rows, bench, window).where("n_hit > 0").select(F.col("doc_id").alias("row")).distinct())
