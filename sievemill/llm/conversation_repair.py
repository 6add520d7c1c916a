"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`, by their initials.

A dynamic programme over the turns that stay (kept or reroled). The turns between two that stay are deleted, which a
prefix sum prices; the least cost of going on with a turn in a role is one running minimum for each role, so that a turn
takes constant time; which turns have to be inserted in a gap follows from the pair of roles at its ends. Turns are taken
from the last to the first, and equal costs are settled by the audit, the initials of Delete, Insert, Keep and Rerole in
order: a longer run of deletions is less, then more inserts, then keeping. That is a local choice; no audits are compared.

Rows are dealt out by ranges of (conv_id, turn, role, text), so that a conversation of any size lies in blocks of at most
BLOCK_ROWS rows or BLOCK_BYTES bytes over many tasks. One that is whole in its task is done there. For the others one byte a
turn runs through a task in order, once from the end (running minima) and once from the start (which turn stays next);
their texts stay where they are, and are repaired block by block.

Defined results: null roles and texts count as one space; rows are taken by turn, nulls first, equal turns by role and by
text; a role that does not start with s, u or a, an empty one too, can only be reroled or deleted; a text of white space alone
is blank; repeated rows are duplicates; a very long text is part of one block; rows without conv_id form one
conversation; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, BLOCK_BYTES = 10_000, 4 << 20
#: Prices of the edits; a truncated turn that stays costs CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5

#: A turn as a byte: its role, and what is wrong with it.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
END = 3
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
_ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Roles to insert between a turn that stays and the next one, or the end; START stands before the first.
START = 4
_BETWEEN = {
    START: {SYSTEM: (), USER: (), ASSISTANT: (USER,), END: ()},
    SYSTEM: {USER: (), ASSISTANT: (USER,), END: (USER, ASSISTANT)},
    USER: {USER: (ASSISTANT,), ASSISTANT: (), END: (ASSISTANT,)},
    ASSISTANT: {USER: (), ASSISTANT: (USER,), END: ()},
}
_OFTEN = {q: [(t, len(x)) for t, x in to.items()] for q, to in _BETWEEN.items()}
_FAR = 1 << 60
#: What lies behind the last turn: least costs of going on with a turn in a role, or the end; where those turns are.
NOTHING = [_FAR, _FAR, _FAR, 0, _FAR, _FAR, _FAR, _FAR]


def solve(codes: bytes, after: list[int]) -> tuple[list[int], list]:
    """(what lies before the block, for each turn and role in which it may stay: the next role and place).

    after, and what is returned: four costs and four places, counted from the edge of the block.
    """
    n, now, steps = len(codes), list(after), [None] * len(codes)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        if c & (BLANK | DUPLICATE):
            continue
        extra, step, value = CUT if c & TRUNCATED else 0, {}, []
        for q in (SYSTEM, USER, ASSISTANT):
            if q == SYSTEM and c & 3 != SYSTEM:
                continue
            cost, place, _, t = min((now[t] + INSERT * k, -now[4 + t], -k, t) for t, k in _OFTEN[q])
            step[q] = (t, -place)
            value.append((q, extra + (REROLE if c & 3 != q else 0) + cost - DELETE))
        steps[i] = step
        for q, v in value:
            if v < now[q]:
                now[q], now[4 + q] = v, i - n
    return [now[k] + DELETE * n for k in range(4)] + [min(now[k] + n, _FAR) for k in range(4, 8)], steps


def begin(before: list[int]) -> tuple[int, tuple]:
    """How a conversation starts: the role of the first turn that stays, and the roles inserted before it."""
    t = min((before[t] + INSERT * k, -before[4 + t], -k, t) for t, k in _OFTEN[START])[3]
    return t, _BETWEEN[START][t]


def trace(codes: bytes, before: list[int], steps: list, entry: tuple, last: bool) -> tuple[str, list, tuple]:
    """(edits of the block, turns that result: (role, place or None where inserted), how the next block is entered)."""
    (t, pending), n, at, edits, out = entry, len(codes), 0, [], []
    j = before[4 + t] if t != END else _FAR
    while t != END and j < n:
        edits.append("D" * (j - at) + "I" * len(pending) + ("K" if codes[j] & 3 == t else "R"))
        out += [(r, None) for r in pending] + [(t, j)]
        at = j + 1
        to, j = steps[j][t]
        pending, t, j = _BETWEEN[t][to], to, j + n
    edits.append("D" * (n - at))
    if last:
        edits.append("I" * len(pending))
        out += [(r, None) for r in pending]
    return "".join(edits), out, (t, pending)


ROWS = "conv_id long, block long, whole boolean, turn_low long, turn_high long, n_turns long, turn_first long, turn_last long, codes binary, blank long, duplicate long, truncated long, illegal long, cost long, edits string, repaired array<struct<role string, text string>>, digests array<binary>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in ("turn_low", "turn_high", "n_turns", "turn_first", "turn_last")], ("codes", pa.binary()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("edits", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("digests", pa.list_(pa.binary()))])
_SPACE = " \t\n\x0b\x0c\r"


def _digest(role: str, text: str) -> bytes:
    return blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _counts(codes: bytes) -> dict:
    """How many turns have each fault first, and adjacent roles that may not follow each other."""
    fault = {"blank": 0, "duplicate": 0, "truncated": 0}
    for c in codes:
        if c & BLANK:
            fault["blank"] += 1
        elif c & DUPLICATE:
            fault["duplicate"] += 1
        elif c & TRUNCATED:
            fault["truncated"] += 1
    return fault | {"illegal": sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:], strict=False))}


def _repaired(rows: list[tuple[str, str]], out: list) -> list[dict]:
    named = lambda r, j: rows[j][0] if _ROLE.get(rows[j][0][:1], OTHER) == r else _NAME[r]
    return [{"role": _NAME[r], "text": ""} if j is None else {"role": named(r, j), "text": rows[j][1]} for r, j in out]


def _cost(codes: bytes, edits: str) -> int:
    turns = iter(codes)
    return sum(INSERT if e == "I" else ((c := next(turns)) and 0) + (DELETE if e == "D" else (REROLE if e == "R" else 0) + (CUT if c & TRUNCATED else 0)) for e in edits)


def _block(key, number: int, rows: list[tuple], whole: bool, seen: set) -> dict:
    """One block of a conversation's (turn, role, text, wrong) rows; what depends on its other blocks stays open unless it is whole."""
    turns = [r[0] for r in rows if r[0] is not None]
    codes, digests = bytearray(), []
    for _, role, text, wrong in rows:
        digest = _digest(role, text)
        codes.append(_ROLE.get(role[:1], OTHER) | wrong | (DUPLICATE if digest in seen else 0))
        if digest not in seen:
            seen.add(digest)
            digests.append(digest)
    texts, codes = [r[1:3] for r in rows], bytes(codes)
    out = {"conv_id": key, "block": number, "whole": whole, "turn_low": min(turns, default=None), "turn_high": max(turns, default=None), "n_turns": len(set(turns)), "turn_first": turns[0] if turns else None, "turn_last": turns[-1] if turns else None, "codes": codes}
    if not whole:
        return out | {"repaired": [{"role": a, "text": b} for a, b in texts], "digests": digests}
    before, steps = solve(codes, NOTHING)
    edits, turns, _ = trace(codes, before, steps, begin(before), True)
    return out | _counts(codes) | {"cost": _cost(codes, edits), "edits": edits, "repaired": _repaired(texts, turns)}


def _batched(rows, schema: pa.Schema):
    """Rows (dicts) as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x["text"]) for x in row.get("repaired") or ())
        if len(held) >= common.BATCH_ROWS or size >= common.BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _blocks(batches):
    """Sorted rows of a task as blocks. The task's first and last conversation may go on elsewhere, so they stay open."""
    part, number, first = TaskContext.get().partitionId() << 33, 0, True
    key, rows, size, seen, cut, any_row = None, [], 0, set(), False, False
    for batch in batches:
        for conv_id, turn, role, text, wrong, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if any_row and conv_id != key:
                yield _block(key, part + number, rows, not first and not cut, seen)
                number, rows, size, seen, cut, first = number + 1, [], 0, set(), False, False
            elif rows and (len(rows) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                yield _block(key, part + number, rows, False, seen)
                number, rows, size, seen, cut = number + 1, [], 0, set(), True
            key, any_row = conv_id, True
            if not dropped:
                rows.append((turn, role, text, wrong))
                size += len(text) + len(role)
    if any_row:
        yield _block(key, part + number, rows, False, seen)


def repair(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) as repaired blocks, one for most conversations, in the order of `block`.

    Columns: conv_id, block, whole (whether it is all of its conversation), counts of faults, cost, edits (initials), repaired
    (role and text of each turn that results). A boolean column `dropped` may mark rows that are no turns, but keep
    their conversation in the result.
    """
    spark = turns.sparkSession
    common.prepare(spark)
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    body = F.rtrim(text, F.lit(_SPACE))
    wrong = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), wrong.alias("wrong"), dropped.alias("dropped"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    ordered = rows.repartitionByRange(*keys, F.xxhash64("text")).sortWithinPartitions(*keys, "text")
    made = common.written(ordered.mapInArrow(lambda batches: _batched(_blocks(batches), _ARROW), ROWS), "turn-blocks")
    done = made.where("whole").drop("digests")
    return done.unionByName(_join_up(made.where("NOT whole")).drop("digests"))


def _in_order(blocks: DataFrame, down: bool) -> DataFrame:
    """Blocks of a conversation in one task, in order or from the last."""
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc() if down else F.col("block"))


def _backward(batches):
    key, after, any_row = None, NOTHING, False
    for batch in batches:
        out = []
        for conv_id, block, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = not any_row or conv_id != key
            if last:
                key, after, any_row = conv_id, NOTHING, True
            out.append((conv_id, block, codes, after, last))
            after = solve(codes, after)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_())], names=["conv_id", "block", "codes", "after", "last"])


def _forward(batches):
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    key, entry, held, any_row = None, None, OTHER, False
    for batch in batches:
        out = []
        for conv_id, block, codes, after, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            before, steps = solve(codes, after)
            if not any_row or conv_id != key:
                key, entry, held, any_row = conv_id, begin(before), None, True
            out.append((conv_id, block, codes, after, last, entry[0], list(entry[1]), held))
            entry = trace(codes, before, steps, entry, last)[2]
            held = codes[-1] & 3 if codes else held
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(8)], names=["conv_id", "block", "codes", "after", "last", "role", "pending", "held"])


def _finish(batches):
    """Blocks (ROWS, then final codes, after, last, role, pending, held) to repaired ones."""

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                codes, raw = r.pop("final"), [(x["role"], x["text"]) for x in r["repaired"]]
                after, last, entry, held = r.pop("after"), r.pop("last"), (r.pop("role"), tuple(r.pop("pending"))), r.pop("held")
                before, steps = solve(codes, after)
                edits, turns, _ = trace(codes, before, steps, entry, last)
                counts = _counts(codes)
                if held is not None and codes and (held, codes[0] & 3) not in _LEGAL:
                    counts["illegal"] += 1
                yield r | counts | {"codes": codes, "edits": edits, "cost": _cost(codes, edits), "repaired": _repaired(raw, turns), "digests": None}

    return _batched(rows(), _ARROW)


def _join_up(blocks: DataFrame) -> DataFrame:
    """Open blocks, repaired by what their conversation's other blocks hold."""
    # A turn that an earlier block has is a duplicate: at most one row for each block and digest, and partial minima.
    found = blocks.select("conv_id", "block", F.explode("digests").alias("digest"))
    first = found.groupBy("conv_id", "digest").agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    again = found.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("block > first").groupBy("block").agg(F.collect_list("digest").alias("again"))
    codes = blocks.join(again, "block", "left")

    def mark(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again, code = set(r["again"] or ()), bytearray(r["codes"])
                if again:
                    for i, x in enumerate(r["repaired"]):
                        if _digest(x["role"], x["text"]) in again:
                            code[i] |= DUPLICATE
                out.append((r["conv_id"], r["block"], bytes(code)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["conv_id", "block", "codes"])

    marked = codes.select("conv_id", "block", "codes", "repaired", "again").mapInArrow(mark, "conv_id long, block long, codes binary")
    down = _in_order(marked, True).mapInArrow(_backward, "conv_id long, block long, codes binary, after array<long>, last boolean")
    up = _in_order(down, False).mapInArrow(_forward, "conv_id long, block long, codes binary, after array<long>, last boolean, role long, pending array<long>, held long")
    plan = up.select("block", F.col("codes").alias("final"), "after", "last", "role", "pending", "held")
    return blocks.join(plan, "block").mapInArrow(_finish, ROWS)


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """The repaired turns of repair()'s blocks: conv_id, block, at (place in the block), role, text."""
    return blocks.select("conv_id", "block", F.posexplode("repaired").alias("at", "x")).select("conv_id", "block", "at", "x.role", "x.text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches):
    """Blocks in the order of their conversations to a row for each."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in REPORT.split(", ")]
    now = None

    def row():
        gaps = now["high"] - now["low"] + 1 - now["n"] if now["n"] else 0
        return (now["key"], gaps, *now["sums"], "".join(now["audit"]), now["sha"].hexdigest())

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now["key"] != r["conv_id"]:
                if now is not None:
                    out.append(row())
                now = {"key": r["conv_id"], "n": 0, "low": None, "high": None, "end": None, "sums": [0] * 5, "audit": [], "sha": sha256(), "any": False}
            if r["n_turns"]:
                now["low"] = r["turn_low"] if now["low"] is None else min(now["low"], r["turn_low"])
                now["high"] = r["turn_high"] if now["high"] is None else max(now["high"], r["turn_high"])
                now["n"] += r["n_turns"] - (now["end"] is not None and now["end"] == r["turn_first"])
                now["end"] = r["turn_last"]
            now["sums"] = [a + r[c] for a, c in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
            now["audit"].append(r["edits"])
            for x in r["repaired"]:
                now["sha"].update(f"{chr(10) if now['any'] else ''}{x['role']}:{x['text']}".encode())
                now["any"] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(9)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kinds[k]) for k, x in enumerate(row())], names=names)


def report(blocks: DataFrame) -> DataFrame:
    """A row for each conversation of repair()'s blocks: REPORT. A hash of a whole conversation runs through its blocks one by one."""
    done = blocks.where("whole").mapInArrow(_report, REPORT)
    return done.unionByName(_in_order(blocks.where("NOT whole"), False).mapInArrow(_report, REPORT))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults made by a checksum of `conv_id:turn` modulo 20, for trials of repair().

    0 drops a turn (marked in `dropped`), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats
    it, 4 makes it the user's. Nulls count as one space.
    """
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn"))) % 20
    rows = turns.select("conv_id", "turn", held("role").alias("role"), held("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
