"""Spans of patterns in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def joined(kinds: list[str], spans, only_base: bool):
    """kind:start:end of the spans by start, then kind in the order of kinds, then end, comma-joined."""
    if only_base:
        spans = F.filter(spans, lambda s: s["base"])
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


class Taken:
    """Parts of a text that spans cover."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        """Whether start..end overlaps none of them."""
        k = bisect_left(self.starts, end)
        return k == 0 or self.ends[k - 1] <= start

    def gaps(self, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of start..end that none of them covers."""
        out, k = [], bisect_right(self.ends, start)
        while k < len(self.starts) and self.starts[k] < end:
            if self.starts[k] > start:
                out.append((start, self.starts[k]))
            start, k = self.ends[k], k + 1
        return [*out, (start, end)] if start < end else out
