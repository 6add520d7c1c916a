"""Chats as token ids with loss masks, and pairs of answers for reward models.

An encoder turns an array<string> into an array<array<long>>, the ids of each text. A turn is the opening mark of its role,
its content and the closing mark; the loss covers an assistant's content and closing mark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..session import ship

Encoder = Callable[[Column], Column]


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's content; {role} is its role."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"

    def opening(self, role: Column) -> Column:
        before, _, after = self.open.partition("{role}")
        return F.concat(F.lit(before), role, F.lit(after))


def code_points(texts: Column) -> Column:
    """An encoder without a vocabulary: the characters' numbers."""
    return F.transform(texts, lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")))


def library_encoder(path: str) -> Encoder:
    """An encoder with a vocabulary file of the tokenizers library, which each worker loads once."""
    held: list = []

    @F.pandas_udf("array<array<bigint>>")
    def run(texts: pd.Series) -> pd.Series:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return pd.Series([None if t is None else [e.ids for e in held[0].encode_batch(list(t), add_special_tokens=False)] for t in texts], dtype=object)

    def encode(texts: Column) -> Column:
        ship(SparkSession.getActiveSession())
        return run(texts)

    return encode


def turn_ids(chats: DataFrame, encode: Encoder, template: Template = Template(), messages: str = "messages") -> DataFrame:
    """chats with input_ids and loss_mask of all turns, one after the other. Null contents count as empty."""
    content = lambda m: F.coalesce(m["content"], F.lit(""))
    whole = F.transform(messages, lambda m: F.concat(template.opening(m["role"]), content(m), F.lit(template.close)))
    opened = F.transform(messages, lambda m: template.opening(m["role"]))
    df = chats.withColumns({"_ids": encode(whole), "_open": encode(opened)})
    pairs = F.transform(F.arrays_zip(F.col("_ids").alias("ids"), F.col("_open").alias("open"), F.col(messages).alias("m")), lambda z: F.transform(z["ids"], lambda _, i: F.when((z["m"]["role"] == "assistant") & (i >= F.size(z["open"])), 1).otherwise(0)))
    return df.withColumns({"loss_mask": F.flatten(pairs), "input_ids": F.flatten("_ids")}).drop("_ids", "_open")


def agrees(chats: DataFrame, encode: Encoder, template: Template = Template(), messages: str = "messages") -> DataFrame:
    """chats with agrees: whether the turns' ids, put together, are those of the whole chat."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(template.opening(m["role"]), F.coalesce(m["content"], F.lit("")), F.lit(template.close))), "")
    df = turn_ids(chats, encode, template, messages).withColumn("_whole", encode(F.array(text)))
    return df.withColumn("agrees", F.col("input_ids") == F.element_at("_whole", 1)).drop("_whole", "input_ids", "loss_mask")


def fit_rows(samples: DataFrame, most: int, pad_id: int = 0, truncation: str = "error", pad: bool = True) -> DataFrame:
    """samples (input_ids, loss_mask) cut to `most` ids, with attention_mask and position_ids; filled up on the right if pad.

    Without padding, what is too long is cut on the right, or fails with truncation "error".
    """
    own = samples.withColumns({"attention_mask": F.transform("input_ids", lambda x: F.lit(1)), "position_ids": F.transform("input_ids", lambda x, i: i.cast("int"))})
    fill = {"input_ids": F.lit(pad_id).cast("long"), "loss_mask": F.lit(0), "attention_mask": F.lit(0), "position_ids": F.lit(0)}
    if pad:
        return own.withColumns({c: T.fit_length(F.col(c), most, f, left_pad=False, truncation=truncation) for c, f in fill.items()})
    cut = (lambda c: T.fit_length(c, most, F.lit(0), truncation="error")) if truncation == "error" else (lambda c: F.slice(c, 1, most))
    return own.withColumns({c: F.when(F.size(c) > most, cut(F.col(c))).otherwise(F.col(c)) for c in fill})


def short_prompts(samples: DataFrame, encode: Encoder, most: int, template: Template = Template(), prompt: str = "prompt") -> DataFrame:
    """The samples whose prompt, with an assistant's opening mark, has at most `most` ids; one that cannot be measured goes."""
    text = F.array_join(F.transform(prompt, lambda m: F.concat(template.opening(m["role"]), m["content"], F.lit(template.close))), "")
    broken = F.exists(prompt, lambda m: m["content"].isNull() | m["role"].isNull())
    size = F.size(F.element_at(encode(F.array(F.concat(F.coalesce(text, F.lit("")), template.opening(F.lit("assistant"))))), 1))
    return samples.withColumn("_n", F.when(F.col(prompt).isNotNull() & ~broken, size)).where(F.col("_n") <= most).drop("_n")


def answer_pairs(rows: DataFrame, encode: Encoder, most: int, end_id: int, pad_id: int = 0, truncation: str = "right", add_end: bool = True) -> DataFrame:
    """rows(prompt, chosen, rejected) with input_ids and attention_mask: of either answer the prompt's ids, its own and the end id."""
    ids = encode(F.array("prompt", "chosen", "rejected"))
    df = rows.withColumn("_ids", ids)
    end = F.array(F.lit(end_id).cast("long")) if add_end else F.array().cast("array<bigint>")
    both = {k: F.concat(F.get("_ids", 0), F.get("_ids", k), end) for k in (1, 2)}
    fit = lambda a, f: T.fit_length(a, most, f, left_pad=False, truncation=truncation)
    one = lambda a: F.transform(a, lambda x: F.lit(1))
    return df.withColumns({"input_ids": F.array(*[fit(a, F.lit(pad_id).cast("long")) for a in both.values()]), "attention_mask": F.array(*[fit(one(a), F.lit(0)) for a in both.values()])}).drop("_ids")
