"""Order MinHash, conversation repair and importance resampling against plain versions."""

import heapq
import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sievemill.llm import conversation_repair as repair
from sievemill.llm import fingerprints as prints
from sievemill.llm import queries as llm
from sievemill.llm import resampling

SF = "/root/testdata/sf0.001"
M64 = 2**64 - 1


def documents(spark, texts, ids=None):
    rows = list(zip(ids if ids is not None else range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string")


# 11 ------------------------------------------------------------------------------------------------------------------


def mix(h):
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & M64
    h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 32)


def plain_run_hash(run):
    if len(run) == 1:
        return mix((ord(run) + 0xC2B2AE3D27D4EB4F) & M64)
    half = len(run) // 2
    return mix((plain_run_hash(run[:half]) * 0x9FB21C651E98DF25 + plain_run_hash(run[half:])) & M64)


def plain_fingerprint(text):
    if not text:
        return "0" * 4 * prints.SIZE
    k = min(prints.K, len(text))
    runs = [text[i : i + k] for i in range(len(text) - k + 1)]
    seen, elements = {}, []
    for i, r in enumerate(runs):
        nth = seen.get(r, 0)
        seen[r] = nth + 1
        elements.append((i, mix((plain_run_hash(r) + nth * 0xC2B2AE3D27D4EB4F) & M64)))
    out = ""
    for s in range(prints.SIZE):
        odd = mix((s + 1) * 0x9E3779B97F4A7C15 & M64) | 1
        least = sorted(elements, key=lambda e: (e[1] * odd & M64, e[0]))[: prints.TUPLE]
        t = 0
        for i in sorted(i for i, _ in least):
            t = mix((t * 0x9FB21C651E98DF25 + plain_run_hash(runs[i])) & M64)
        out += f"{t >> 48:04x}"
    return out


def plain_trial(rows):
    """rows in descending order."""
    out = []
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        a, b, c = plain_fingerprint(text), plain_fingerprint(new), plain_fingerprint(nxt)
        share = lambda x, y: sum(x[4 * j : 4 * j + 4] == y[4 * j : 4 * j + 4] for j in range(prints.SIZE)) / prints.SIZE
        out.append((i, len(text), sha256(new.encode()).hexdigest(), a, b, share(a, b), share(a, c)))
    return out


TEXTS = [None, "", "a", "abc", "abcdefgh", "abcdefghi", "ß" * 40, "ab" * 60, "日本語のテキスト😀は短い" * 3, "The cat. " * 30, "x" * 3000]


@pytest.mark.parametrize("cells", [1 << 17, 1])
def test_edit_trial(spark, monkeypatch, cells):
    monkeypatch.setattr(prints, "CELLS", cells)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts += texts[-3:]
    ids = rng.sample(range(1000), len(texts))
    got = sorted((tuple(r) for r in prints.edit_trial(documents(spark, texts, ids).repartition(5).withColumn("part", F.lit("clash"))).collect()), reverse=True)
    want = plain_trial(sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), reverse=True))
    assert got == want


def test_edit_trial_edges(spark):
    assert prints.edit_trial(documents(spark, [])).count() == 0
    (one,) = prints.edit_trial(documents(spark, ["abcdefghij"], [3])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha256(b"abcdeabcde").hexdigest()
    rows = prints.edit_trial(documents(spark, ["same text of some length"] * 30 + ["another one"] * 2, [7] * 30 + [None] * 2)).collect()
    assert len(rows) == 32 and sorted(r["near_next"] for r in rows)[2:] == [1.0] * 30


def test_order_counts():
    """Blocks that change places leave the set of runs nearly as it is, but not the fingerprint; an edit costs little."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = " ".join(words)
    blocks = [" ".join(words[k : k + 60]) for k in range(0, 900, 60)]
    rng.shuffle(blocks)
    few = words[:]
    for k in rng.sample(range(900), 9):
        few[k] = "zzz"
    near = lambda a, b: (prints.sketch(a) == prints.sketch(b)).mean()
    assert near(text, " ".join(few)) > 0.7
    assert 0.3 < near(text, " ".join(blocks)) < 0.7
    assert near(text, " ".join(reversed(words))) < 0.15


def test_likeness_and_long_text(spark):
    texts = ["some words of a text that is here", "some words of a text that was here", "quite another text, with nothing shared"]
    made = prints.fingerprints(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in made] == [plain_fingerprint(t) for t in texts]
    df = spark.createDataFrame([(made[a]["fingerprint"], made[b]["fingerprint"]) for a, b in ((0, 0), (0, 1), (0, 2))], "a string, b string")
    share = [(prints.sketch(texts[0]) == prints.sketch(t)).mean() for t in texts]
    assert [r[0] for r in df.select(prints.likeness(F.col("a"), F.col("b"))).collect()] == share
    long = np.random.default_rng(1).integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode()
    assert (prints.sketch(long) == prints.sketch(long[:-1])).all()


def test_edit_trial_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in llm.op11_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    want = sorted(((r["doc_id"], r["text"] or "") for r in rows), reverse=True)
    for k in range(0, len(want), 40):  # the plain version is slow; every row's text and pair is checked below
        text, nxt = want[k][1][:2000], want[(k + 1) % len(want)][1][:2000]
        assert "".join(f"{x:04x}" for x in prints.sketch(text)) == plain_fingerprint(text)
        assert (prints.sketch(text) == prints.sketch(nxt)).mean() <= 1
    for k, (i, text) in enumerate(want):
        nxt, half = want[(k + 1) % len(want)][1], len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(new.encode()).hexdigest())
        assert r["near_edited"] == (prints.sketch(text) == prints.sketch(new)).mean()
        assert r["near_next"] == (prints.sketch(text) == prints.sketch(nxt)).mean()
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.05


# 12 ------------------------------------------------------------------------------------------------------------------


def is_blank(text):
    return not regex.search(r"[^\x20\x09-\x0D]", text)


def plain_repair(rows):
    """Cheapest (cost, audit, text) by a search through all edits, least audit first among equals."""
    first, wrong = set(), []
    for role, text in rows:
        body = regex.sub(r"[\x20\x09-\x0D]+$", "", text)
        wrong.append("blank" if is_blank(text) else "duplicate" if (role, text) in first else "truncated" if body[-1] not in ".!?" else "")
        first.add((role, text))
    heap, done = [(0, "", 0, "0", "")], set()
    follow = {"0": "su", "s": "u", "u": "a", "a": "u"}
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in "0a":
            counts = [wrong.count(k) for k in ("blank", "duplicate", "truncated")]
            pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
            return (*counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256(out[:-1].encode()).hexdigest())
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in follow[q]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, f"{out}{name}:\n"))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if wrong[i] in ("", "truncated"):
                extra = 5 if wrong[i] else 0
                if role[:1] and role[:1] in follow[q]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], f"{out}{role}:{text}\n"))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follow[q]:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, r, f"{out}{name}:{text}\n"))


def plain_gaps(turns):
    held = [t for t in turns if t is not None]
    return max(held) - min(held) + 1 - len(set(held)) if held else 0


def conversations(rng, n, longest=9):
    rows = []
    for c in range(n):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"])
            text = rng.choice(["Yes.", "No", "Why?", "", " \t\n", "Fine!  ", None, "So", "A.", f"Text {rng.randrange(99)}.", f"cut {rng.randrange(99)}"])
            rows.append((c, turn if rng.random() > 0.1 else None, role, text))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def sorted_rows(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.mark.parametrize("block", [10_000, 3, 1])
def test_repair(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rng = random.Random(12 + block)
    rows = conversations(rng, 250) + [(None, 0, "user", "Hi."), (None, 1, "tool", "Is it?")]
    blocks = repair.repair(spark.createDataFrame(rows, TURNS).withColumn("block", F.lit("clash")))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(blocks).collect()}
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    assert len(got) == len(by)
    for c, held in by.items():
        held = sorted_rows(held)
        assert got[c] == (plain_gaps([r[0] for r in held]), *plain_repair([r[1:] for r in held])), (c, held)
    if block == 1:
        texts = {}
        for r in sorted(repair.repaired_turns(blocks).collect(), key=lambda r: (r["block"], r["at"])):
            texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert all(sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == r[7] for c, r in got.items())


def test_repair_of_one_large_conversation(spark, monkeypatch):
    """A conversation over several tasks and many blocks equals the plain version; its hash runs through the blocks."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 50)
    rng = random.Random(3)
    rows = [(5, k, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t {k}.", "again.", "cut", ""])) for k in range(900)] + [(6, 0, "user", "x" * 3_000_000 + ".")]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(repair.repair(spark.createDataFrame(rows, TURNS).repartition(6))).collect()}
    assert got[5] == (0, *plain_repair([r[2:] for r in rows[:-1]]))
    assert got[6][5:7] == (2, "D")


def test_repair_edges(spark):
    assert repair.report(repair.repair(spark.createDataFrame([], TURNS))).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], TURNS).withColumn("dropped", F.lit(True))
    assert [tuple(r) for r in repair.report(repair.repair(rows)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def plain_damage(rows):
    out = {}
    for c, t, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        held = out.setdefault(c, [])
        role, text = s(role), s(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = regex.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            held.extend([(t, role, text)] * (2 if kind == 3 else 1))
    return out


def test_repair_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in llm.op12_repair(spark, SF).collect()}
    want = plain_damage(rows)
    assert set(got) == set(want)
    for c, held in want.items():
        held = sorted_rows(held)
        assert got[c] == (plain_gaps([r[0] for r in held]), *plain_repair([r[1:] for r in held])) if held else (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


# 13 ------------------------------------------------------------------------------------------------------------------


def plain_resample(docs, bench, longest=1, buckets=10_000):
    def states(text):
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    found, s, t = [], [0] * buckets, [0] * buckets
    for i, text in docs:
        n, b = states(text)
        found.append((i, n, b))
        for k in b:
            s[k] += 1
    for text in bench:
        for k in states(text)[1]:
            t[k] += 1
    S, T = sum(s), sum(t)  # noqa: N806
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    rows = []
    for i, n, b in found:
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "CHUNK", 16)
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["The", "cat,", "é-x", "sat!", "9a", "日本", "Zoo", "\x7f", "on\nmat"]) + str(rng.randrange(30)) for _ in range(n))
    texts = [None, "", "...", "Ünï"] + [words(rng.randrange(1, 90)) for _ in range(200)] + [words(5000)]
    docs = list(enumerate(texts)) + [(None, texts[20])]
    bench = [words(40) for _ in range(9)] + [None, ""]
    out = resampling.resample(documents(spark, [t for _, t in docs], [i for i, _ in docs]).withColumn("bucket", F.lit(1)), documents(spark, bench).repartition(3), longest, 500)
    assert key(tuple(r) for r in out.collect()) == key(plain_resample(docs, bench, longest, 500))


def test_resample_edges(spark):
    none = documents(spark, [])
    assert resampling.resample(none, documents(spark, ["a"])).count() == 0
    docs = documents(spark, ["w " * 25] * 40, [1] * 20 + [2] * 20)
    rows = resampling.resample(docs, none).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4] and len({r["doc_id"] for r in rows if r["rank"]}) == 1
    assert resampling.drawn(docs.withColumn("rank", F.lit(0)), resampling.resample(docs, none)).count() == 20


def test_resample_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert key(tuple(r) for r in llm.op13_resample(spark, SF).collect()) == key(plain_resample(docs, bench))


# Faults of earlier operators ----------------------------------------------------------------------------------------------


def test_contamination_by_many_equal_items(spark):
    """Ten thousand items of one word, and items that repeat a word, against a long text of that word, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    from sievemill.llm import common, decontaminate

    items = [(i, "a") for i in range(10_000)] + [(20_000 + i, "a " * 300) for i in range(3)]
    texts = ["a " * 100_000, "b", "x a y", None]
    rows = decontaminate.find_contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [(r["n_hit"], len(r["item_ids"])) for r in rows] == [(100_000, 10_003), (0, 0), (1, 10_000), (0, 0)]
    assert (rows[0]["longest_words"], rows[0]["longest_start"], rows[0]["longest_item"]) == (300, 0, 20_000)
    tests = decontaminate.Tests(np.array([i for i, _ in items]), *common.utf8(pa.array([t for _, t in items])), 10)
    tracemalloc.start()
    decontaminate.shard_hits(*decontaminate.word_codes(*common.utf8(pa.array(texts))), [tests])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_matches_by_ranges_of_diagonals(monkeypatch):
    import pyarrow as pa

    from sievemill.llm import common, decontaminate

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abb") for _ in range(rng.randrange(0, 90))) for _ in range(12)]
    items = [" ".join(rng.choice("abb") for _ in range(rng.randrange(1, 30))) for _ in range(15)]
    items += items[:3]
    d, k = decontaminate.word_codes(*common.utf8(pa.array(texts)))
    found = []
    for most in (1 << 20, 40, 3):
        monkeypatch.setattr(decontaminate, "MATCHES", most)
        tests = decontaminate.Tests(np.arange(len(items)), *common.utf8(pa.array(items)), 10)
        r = decontaminate.shard_hits(d, k, [tests])
        found.append((r["n_hit"].tolist(), r["items"].to_pylist(), [x.tolist() for x in r["longest"]]))
    assert found[0] == found[1] == found[2] and max(found[0][0]) > 10


def test_patience_is_linear_in_places():
    import time

    from sievemill.llm.line_dedup import patience

    n, start = 40_000, time.time()
    got = patience([([2 * i], [2 * i]) for i in range(n)] + [([2 * i + 1 for i in range(n)], [2 * i + 1 for i in range(n)])])
    assert got == {(i, i) for i in range(2 * n)} and time.time() - start < 5


def test_record_ids_with_other_line_breaks(spark, tmp_path):
    """Next line, line separator and form feed in a record id end no line of the sidecar."""
    import gzip

    from sievemill.llm import warc

    def record(k, body):
        block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode()
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a\u0085b c\x0c{k}>\r\nWARC-Target-URI: http://x/{k}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    index = b"".join(f"{at}\t{n}\t<urn:a\u0085b c\x0c{k}>\n".encode() for k, (at, n) in enumerate(_members(tmp_path / "own.warc.gz", [record(k, "body " * (k + 1)) for k in range(3)])))
    (tmp_path / "own.idx").write_bytes(index)
    rows = warc.read(spark.createDataFrame([("own",)], "archive string"), f"file://{tmp_path}").collect()
    assert sorted(r["payload"] for r in rows) == sorted(("body " * (k + 1)).encode() for k in range(3))
    with pytest.raises(ValueError, match="header"):
        list(warc.split_records([b"WARC/1.0\r\n" + b"x" * (1 << 20)] * 10))


def _members(path, records):
    """Write each record as a gzip member; (offset, length) of each."""
    import gzip

    out, places = b"", []
    for raw in records:
        member = gzip.compress(raw)
        places.append((len(out), len(member)))
        out += member
    path.write_bytes(out)
    return places


# 7 -------------------------------------------------------------------------------------------------------------------


def test_hot_prefix_makes_no_variant_twice(spark, monkeypatch):
    """All fingerprints agree in their lowest 16 bits; longer prefixes part them, and each variant has one prefix."""
    from sievemill.llm import simhash

    monkeypatch.setattr(simhash, "TASK_VARIANTS", 40_000)
    rng = random.Random(4)
    fps = [rng.getrandbits(48) << 16 | 0xBEEF for _ in range(1500)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = simhash.prefixes(spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, name long"), 4, 6).collect()
    variants, by_prefix = {}, {}
    for r in rows:
        k = (((r["fp"] % 2**64) & ((1 << r["bits"]) - 1)) ^ r["prefix"]).bit_count()
        made = sum(math.comb(64 - r["bits"], w) for w in range(2 - k + 1))
        variants[r["name"]] = variants.get(r["name"], 0) + made
        by_prefix[r["bits"], r["prefix"]] = by_prefix.get((r["bits"], r["prefix"]), 0) + made
    assert set(variants.values()) == {1 + 64 + 64 * 63 // 2}
    assert max(by_prefix.values()) <= 40_000 and max(b for b, _ in by_prefix) >= 22
