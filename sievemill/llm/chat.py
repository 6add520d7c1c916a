"""Chat formatting by columnar byte assembly.

Turns of a batch become one Arrow buffer: the lengths of all segments give cumulative offsets, those give the places to
copy to, and marks, roles and texts are scattered into one preallocated buffer. A turn is

    <|im_start|>role, line feed, text, <|im_end|>, line feed

and no text can forge a mark: between "<" and "|" a text gets one backslash more than it has there, which reading back
takes away again. Roles also have backslashes doubled and line feeds written as \\n. The loss mask covers the texts of assistant turns.

Defined results: null texts and roles count as empty; turns with equal numbers are ordered by role and text; a null
turn comes first; repeated rows are a turn each; rows without conv_id form one conversation; an empty table gives no rows;
extra columns are ignored. One conversation is one output row, so its rows meet in one task and it has to fit in memory, a
very long text too; beyond 2 GB, the most that a value can hold, it raises. The rows of others are only passed through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
SCHEMA = "conv_id long, formatted string, loss_start array<long>, loss_length array<long>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of conversations, start of each turn's text in its conversation, its length).

    first: the row at which each conversation starts.
    """
    fixed = np.frombuffer((START + "\n" + END).encode(), np.uint8)
    r_data, r_off = common.utf8(escape_roles(roles))
    t_data, t_off = common.utf8(escape(texts))
    n = len(roles)
    a, b = len(START), len(END)
    # Five segments a turn: mark, role, line feed, text, mark.
    size = np.stack([np.full(n, a), np.diff(r_off), np.full(n, 1), np.diff(t_off), np.full(n, b)], 1)
    ends = np.cumsum(size.ravel()).reshape(n, 5)
    to = ends - size
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (source, begin) in enumerate(((fixed, np.zeros(n, np.int64)), (r_data, r_off[:-1]), (fixed, np.full(n, a)), (t_data, t_off[:-1]), (fixed, np.full(n, a + 1)))):
        length = size[:, k]
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to[:, k], length) + step] = source[np.repeat(begin, length) + step]
    begins = to[first, 0] if n else np.zeros(0, np.int64)
    of = np.searchsorted(first, np.arange(n), "right") - 1
    return out, np.append(begins, len(out)), to[:, 3] - begins[of], size[:, 3]


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns(conv_id, turn, role, text).

    loss_start, loss_length: the spans under the loss mask, in bytes of the UTF-8 text `formatted`.
    """
    common.prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def emit(t: pa.RecordBatch) -> pa.RecordBatch:
        ids = t.column(0)
        key = pc.fill_null(ids, 0).to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
        first = np.flatnonzero(new)
        data, offsets, at, length = assemble(t.column(1), t.column(2), first)
        loss = np.flatnonzero(pc.equal(t.column(1), "assistant").to_numpy(zero_copy_only=False))
        edges = pa.array(np.searchsorted(loss, np.append(first, len(key))).astype(np.int32))
        formatted = common.binary_array(data, offsets).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, pa.ListArray.from_arrays(edges, pa.array(at[loss])), pa.ListArray.from_arrays(edges, pa.array(length[loss]))], names=["conv_id", "formatted", "loss_start", "loss_length"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last conversation, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1]
            same = pc.equal(batch.column(0), last) if last.is_valid else batch.column(0).is_null()
            goes_on = pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            cut = batch.num_rows - int(np.argmin(goes_on[::-1])) if not goes_on.all() else 0
            if cut == 0 and held and held[-1].column(0)[0] != last:
                cut = -1
            if cut:
                whole = [*held, batch.slice(0, cut)] if cut > 0 else held
                yield emit(pa.concat_batches(whole))
                held = []
            held.append(batch.slice(max(cut, 0)))
        if held:
            yield emit(pa.concat_batches(held))

    return rows.mapInArrow(run, SCHEMA)


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chat_digest(chats: DataFrame) -> DataFrame:
    """What reading format_chats' rows back gives, as digests."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            out = []
            for conv_id, text, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_chat(text)
                raw = text.encode()
                loss = "".join(unescape(raw[a : a + n].decode()) for a, n in zip(starts, lengths, strict=True))
                out.append((conv_id, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names=names)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
