"""One scan of a text for tags, and the spans that opening and closing tags of one name make."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass


@dataclass(frozen=True)
class Tag:
    """A tag's place: start of its "<", end after its ">" (None if it has none), and whether it has no attributes."""

    start: int
    end: int | None
    name: str
    closing: bool
    bare: bool


@dataclass(frozen=True)
class Span:
    """An opening tag with the next closing tag of its name: start, end, and first and last of what is between."""

    start: int
    first: int
    last: int
    end: int
    name: str


class Tags:
    """The tags of a text whose names are among `names`; case counts only if `exact`."""

    def __init__(self, text: str, names: tuple[str, ...], exact: bool = False):
        self.text = text
        marks = re.compile(rf"<(/?)({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(>|\s)", 0 if exact else re.IGNORECASE)
        self.all: list[Tag] = []
        for m in marks.finditer(text):
            bare = m[3] == ">"
            close = m.end() if bare else text.find(">", m.end()) + 1
            self.all.append(Tag(m.start(), close or None, m[2] if exact else m[2].lower(), bool(m[1]), bare))

    def opened(self, name: str) -> list[Tag]:
        return [t for t in self.all if t.name == name and not t.closing]

    def spans(self, *names: str, attributes: tuple[str, ...] = ()) -> list[Span]:
        """Spans of these names, which don't overlap each other; only names in `attributes` may have some."""
        ends = {n: [t.start for t in self.all if t.name == n and t.closing and t.bare] for n in names}
        out, at = [], 0
        for t in self.all:
            if t.name not in names or t.closing or t.start < at or t.end is None or not (t.bare or t.name in attributes):
                continue
            k = bisect_left(ends[t.name], t.end)
            if k < len(ends[t.name]):
                last = ends[t.name][k]
                at = last + len(t.name) + 3
                out.append(Span(t.start, t.end, last, at, t.name))
        return out


class Hidden:
    """Places of a text that lie in given spans."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s in sorted(spans, key=lambda s: s.start):
            if self.ends and s.start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and self.ends[k] > start
