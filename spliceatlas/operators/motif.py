"""Motif maps: regions around splice sites, their sequences, matches of regular expressions and their scatter over window positions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.scalars import steps_between
from ..shipping import session_of
from ..sources.genome import slices
from ..specs import Event


#: A motif table goes to every task.
MOST_MOTIFS = 100_000
#: Strings that an expression may stand for to be looked for with others, and expressions from which that pays.
MOST_LITERALS, LEAST_TOGETHER = 4096, 8


@dataclass(frozen=True)
class Shape:
    """Lengths in bases: exon and intron parts that are mapped, window and step."""

    exon: int = 50
    intron: int = 250
    window: int = 50
    step: int = 1

    def length(self, letter: str) -> int:
        return self.exon if letter == "e" else self.intron


def regions(coords: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, fasta_region, chr, start, end (0-based, end exclusive) and reverse; the minus strand is '-' or '-1'."""
    reverse = F.coalesce(F.col("strand").isin("-", "-1"), F.lit(False))
    reach = shape.intron + shape.window
    parts = []
    for name, a, b, c, d in event.motif_regions():
        plus_start, plus_end, minus_start, minus_end = (F.expr(x.format(L=reach)) for x in (a, b, c, d))
        parts.append(F.struct(F.lit(name).alias("fasta_region"), F.when(reverse, minus_start).otherwise(plus_start).alias("start"), F.when(reverse, minus_end).otherwise(plus_end).alias("end")))
    return coords.withColumn("r", F.explode(F.array(*parts))).select("grp", "exon_idx", "r.fasta_region", "chr", "r.start", "r.end", reverse.alias("reverse"))


def sequences(coords: DataFrame, genome: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """regions with their sequence."""
    return slices(regions(coords, event, shape), genome)


def matches(seqs: DataFrame, motifs: DataFrame, id_cols: list[str], shape: Shape | None = None) -> DataFrame:
    """id_cols, motif, regex, p (0-based start), m_len (of the first match) and seq_len of all leftmost non-overlapping matches.

    One pass over the sequences for all expressions that stand for bounded lists of strings (characters, classes, alternatives), as motifs do, and
    a search for each of the others. Places come from the matches themselves, so a sequence of any number of matches takes linear time. The motif table goes along with the function: MOST_MOTIFS rows at most, more raise ValueError.
    Sequences without a match, null ones and null expressions leave no row. With shape, matches out of its reach are left out
    and a sequence too long to have one within reach is only searched for its first match.
    """
    session_of(seqs)
    table = [(r["motif"], r["regex"]) for r in motifs.where("regex is not null").select("motif", "regex").limit(MOST_MOTIFS + 1).collect()]
    if len(table) > MOST_MOTIFS:
        raise ValueError(f"more than {MOST_MOTIFS} motifs")
    reach = None if shape is None else max(shape.intron, shape.exon) + shape.window
    slim = seqs.select(*id_cols, "seq")
    ids = slim.schema[: len(id_cols)]
    out = StructType([*ids, StructField("motif", StringType()), StructField("regex", StringType()), StructField("seq_len", IntegerType()), StructField("m_len", IntegerType()), StructField("p", IntegerType())])

    def run(batches):
        scan = _Scan([rx for _, rx in table])
        names = pa.array([m for m, _ in table], pa.string()), pa.array([rx for _, rx in table], pa.string())
        for batch in batches:
            for rows, which, length, first, at in _found(batch["seq"].to_pylist(), scan, reach):
                own = [batch.column(k).take(pa.array(rows)) for k in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*own, *(x.take(pa.array(which)) for x in names), *(pa.array(x, pa.int32()) for x in (length, first, at))], names=out.names)

    return slim.mapInArrow(run, out)


def literals(expression: str, most: int = MOST_LITERALS) -> set[str] | None:
    """All strings that an expression matches, if it is made of characters, classes, alternatives and fixed repeats of one total length
    and matches at most `most` strings; None otherwise (anchors, references, open repeats, classes by exclusion, several lengths)."""

    def strings(parsed) -> list[str] | None:
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                own = [chr(arg)]
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
                spans = [(x, x) if str(o) == "LITERAL" else x for o, x in arg]
                own = [chr(c) for lo, hi in spans for c in range(lo, hi + 1)] if sum(hi - lo + 1 for lo, hi in spans) <= most else None
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                own = strings(arg[3])
            elif name == "BRANCH":
                parts = [strings(x) for x in arg[1]]
                own = None if None in parts else [x for part in parts for x in part]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] <= 64:
                one = strings(list(arg[2]) * int(arg[0]))
                own = one
            else:
                own = None
            if own is None or len(out) * len(own) > most:
                return None
            out = [x + y for x in out for y in own]
        return out

    flags = re.compile(expression).flags & ~re.UNICODE.value
    found = None if flags else strings(re._parser.parse(expression))
    return set(found) if found and len({len(x) for x in found}) == 1 and found[0] else None


class _Scan:
    """All matches of a table of expressions. Those that stand for a bounded list of strings are looked for together, in one pass by an automaton
    of all their strings; the others one by one."""

    def __init__(self, expressions: list[str]):
        lists = {e: x for e, x in ((e, literals(rx)) for e, rx in enumerate(expressions)) if x}
        if len(lists) < LEAST_TOGETHER:
            lists = {}
        self.single = [(e, re.compile(rx)) for e, rx in enumerate(expressions) if e not in lists]
        self.size = {e: len(next(iter(x))) for e, x in lists.items()}
        owners: dict[str, list[int]] = {}
        for e, x in lists.items():
            for text in x:
                owners.setdefault(text, []).append(e)
        self.automaton = ahocorasick.Automaton() if owners else None
        for text, own in owners.items():
            self.automaton.add_word(text, (len(text), tuple(own)))
        if owners:
            self.automaton.make_automaton()

    def __call__(self, text: str, reach: int | None):
        """(expression, length of its first match, starts of its leftmost non-overlapping matches), of expressions that match."""
        n = len(text)
        near = lambda size: None if reach is None else (n - reach - size + 1, reach)
        for e, expression in self.single:
            if (one := expression.search(text)) is None:
                continue
            size = one.end() - one.start()
            bounds = near(size)
            if bounds is None:
                yield e, size, [m.start() for m in expression.finditer(text)]
            elif bounds[0] < bounds[1]:
                yield e, size, [p for p in (m.start() for m in expression.finditer(text)) if bounds[0] <= p < bounds[1]]
        if self.automaton is None or (reach is not None and n - reach - max(self.size.values()) + 1 >= reach):
            return
        found: dict[int, list[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            start = end - size + 1
            for e in own:
                at = found.setdefault(e, [])
                if not at or start >= at[-1] + size:
                    at.append(start)
        for e, at in found.items():
            bounds = near(self.size[e])
            yield e, self.size[e], at if bounds is None else [p for p in at if bounds[0] <= p < bounds[1]]


def _found(texts: list[str | None], scan: _Scan, reach: int | None):
    """Lists of row, expression, sequence length, length of the first match, and start, some matches at a time."""
    rows: list[list[int]] = [[], [], [], [], []]
    for k, text in enumerate(texts):
        if text is None:
            continue
        for e, size, at in scan(text, reach):
            for column, values in zip(rows, ([k] * len(at), [e] * len(at), [len(text)] * len(at), [size] * len(at), at), strict=True):
                column += values
            if len(at) and len(rows[0]) >= 1 << 16:
                yield rows
                rows = [[], [], [], [], []]
    if rows[0]:
        yield rows


def within_reach(p: Column, n: Column, shape: Shape) -> Column:
    """Matches that count at all: both the start from the left and the end from the right must lie in reach, so none does in long sequences."""
    reach = max(shape.intron, shape.exon) + shape.window
    return (p < reach) & (n >= -reach)


def forward_positions(p: Column, window: Column, length: int, shape: Shape) -> Column:
    """Window positions a match at p adds to, seen from the left end. The bound is min(P, p // s) - 1, exclusive."""
    low = F.floor(F.greatest(F.lit(0), p - window + 1) / shape.step).cast("int")
    high = F.least(F.lit(length // shape.step), F.floor(p / shape.step).cast("int")) - 2
    return F.when(p < length + window, steps_between(low, high))


def backward_positions(n: Column, length: int, shape: Shape) -> Column:
    """Window positions a match whose end is n from the right end (n below 0) adds to. Bounds divide rounding down, also below zero."""
    x = n + length + shape.window - 1
    low = F.floor(F.greatest(F.lit(0), x - shape.window + 1) / shape.step).cast("int")
    high = F.least(F.lit(length // shape.step), F.floor(x / shape.step).cast("int") + 1) - 1
    return F.when(n >= -length - shape.window, steps_between(low, high))


def _in_region(k: int):
    return lambda pos: F.struct(F.lit(k).alias("region"), pos.alias("pos"))


def scatter(found: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """Adds map region (an index) and pos for each window position a match falls into; found has fasta_region, p, m_len, seq_len."""
    p, n = F.col("p"), F.col("p") + F.col("m_len") - 1 - F.col("seq_len")
    near = found.where(within_reach(p, n, shape))
    by_region: dict[str, list] = {}
    for k, (name, side, letter) in enumerate(event.wiring):
        length = shape.length(letter)
        if side == "P":
            at = forward_positions(p, F.lit(shape.window), length, shape)
        elif side == "N":
            at = backward_positions(n, length, shape)
        else:  # scaled to the mapped intron length
            scaled = F.floor(p / F.col("seq_len") * length).cast("int")
            at = forward_positions(scaled, F.floor(F.lit(float(shape.window)) / F.col("seq_len") * length).cast("int"), length, shape)
        by_region.setdefault(name, []).append(F.transform(F.coalesce(at, F.array().cast("array<int>")), _in_region(k)))
    places = F.array().cast("array<struct<region:int,pos:int>>")
    for name, parts in by_region.items():
        places = F.when(F.col("fasta_region") == name, F.concat(*parts)).otherwise(places)
    return near.withColumn("h", F.explode(places)).select(*[c for c in found.columns if c not in ("p", "m_len", "seq_len", "fasta_region")], "h.region", "h.pos")


def hits(seqs: DataFrame, motifs: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """motif, regex, grp, exon_idx, region, pos, cnt (1): a row for each window position of each match. Sums that need no exons are taken
    from these rows, which are added up where they arise, instead of from counts of exons, which are shuffled."""
    found = matches(seqs, motifs, ["grp", "exon_idx", "fasta_region"], shape)
    return scatter(found, event, shape).withColumn("cnt", F.lit(1).cast("bigint"))


def hit_counts(seqs: DataFrame, motifs: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """motif, regex, grp, region, pos, exon_idx, cnt: sparse counts, without zeros."""
    return hits(seqs, motifs, event, shape).groupBy("motif", "regex", "grp", "region", "pos", "exon_idx").agg(F.sum("cnt").alias("cnt"))


def mean_score(total: Column, exons: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(total, F.lit(0)) / F.greatest(F.lit(1), exons))


def positions(event: Event, shape: Shape, clip: bool = False) -> list[tuple[int, int]]:
    """(region, number of window positions) of the map."""
    if clip:
        return [(k, max(0, 1 + (shape.length(c) - shape.window) // shape.step)) for k, c in enumerate(event.lengths)]
    return [(k, shape.length(letter) // shape.step) for k, (_, _, letter) in enumerate(event.wiring)]
