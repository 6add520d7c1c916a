"""Texts folded to their ASCII letters and digits: case, accents, widths and ligatures gone, in column functions.

A character folds to its case-folded compatibility decomposition without combining marks. Characters whose fold is one letter
or digit, and marks, go in one `translate`; those whose fold is longer (ß, ½, ﬁ) are replaced, each once, in the few rows that
hold any. Null counts as empty; a character without a letter or digit in its fold only parts words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_character(c: str) -> str:
    """Its fold; what is neither a letter nor a digit of ASCII in it becomes a blank."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
    return re.sub("[^a-z0-9]", " ", plain)


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """(characters, their single folds with those of marks, which go, last; folds of several characters), by the rule above."""
    one, gone, more = {}, [], {}
    for k in (k for k in range(0x110000) if not 0xD800 <= k < 0xE000):
        to = folded_character(chr(k))
        if not to:
            gone.append(chr(k))
        elif to.strip() and to != chr(k):
            (one if len(to) == 1 else more)[chr(k)] = to
    return "".join([*one, *gone]), "".join(one.values()), more


def folded(text: Column) -> Column:
    """The text with every character folded."""
    characters, to, more = _tables()
    several = F.lit(f"[{''.join(more)}]")
    folds = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    # A class of so many characters is slow, so it is tried on what is not ASCII only, and plain texts only lose their capitals.
    strange = lambda t: F.regexp_replace(t, r"[\x00-\x7f]+", "")
    whole = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(strange(t), several, F.lit(0))), t, lambda s, c: F.replace(s, c, folds[c]))
    # In arrays of one, so that each step is done once and not wherever it is named.
    other = lambda t: F.transform(F.array(F.translate(t, characters, to)), whole)[0]
    return F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.when(F.rlike(t, F.lit(r"[^\x00-\x7f]")), other(t)).otherwise(F.lower(t)))[0]


def folded_words(text: Column) -> Column:
    """The runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0))
