"""Operators of every event type, p-values of the tests and the remaining summaries on the driver's tables, each with its SQL.

The SQL states the formulas of each event type in full, on the coordinate columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import classify as K
from ..operators import isoforms, motif, overlap, summary
from ..operators.motif import Shape
from ..scratch import root
from ..sources import results, sinks
from ..specs import EVENTS, GROUPS
from .queries import _COUNTED, _MOTIFS, _RANKS, _SPARSE, QUERIES, SQL, _coords, _coords_sql, _counted, _motifs, _samples, _t

#: Motif regions (name; start and end on plus; on minus), an intron reaching 300 bases.
REGIONS = {
    "A3SS": (("FlankingExon", "c6", "c7", "c6", "c7"), ("FirstIntron", "c7", "c7 + 300", "c6 - 300", "c6"), ("secondIntron", "c2 - 300", "c2", "c3", "c3 + 300"), ("SplicingRegion", "c2", "c4", "c5", "c3"), ("downstreamExon", "c4", "c3", "c2", "c5")),
    "A5SS": (("LongExon", "c2", "c5", "c4", "c3"), ("SplicingRegion", "c5", "c3", "c2", "c4"), ("FirstIntron", "c3", "c3 + 300", "c2 - 300", "c2"), ("FlankinfExonIntron", "c6 - 300", "c6", "c7", "c7 + 300"), ("FlankingExon", "c6", "c7", "c6", "c7")),
    "RI": (("UpstreamExon", "c4", "c5", "c6", "c7"), ("Intron", "c5", "c6", "c5", "c6"), ("downstreamExon", "c6", "c7", "c4", "c5")),
    "MXE": (
        ("UpstreamExon", "c6", "c7", "c8", "c9"), ("FirstIntron", "c7", "c7 + 300", "c8 - 300", "c8"), ("SecondIntron", "c2 - 300", "c2", "c5", "c5 + 300"), ("FirstExon", "c2", "c3", "c4", "c5"), ("thirdIntron", "c3", "c3 + 300", "c4 - 300", "c4"),
        ("fourthIntron", "c4 - 300", "c4", "c3", "c3 + 300"), ("SecondExon", "c4", "c5", "c2", "c3"), ("fifthIntron", "c5", "c5 + 300", "c2 - 300", "c2"), ("sixthIntron", "c8 - 300", "c8", "c7", "c7 + 300"), ("downstreamExon", "c8", "c9", "c6", "c7"),
    ),
}
#: First base of each map region on plus, last base on minus, for 50 exonic and 250 intronic bases; and which it is.
ANCHORS = {
    "A3SS": (("c6 + 1", "c7 - 49", "c7", "c2 - 248", "c2 + 1", "c4 - 49", "c4 + 1", "c5 - 49"), ("c7", "c6 + 50", "c6", "c3 + 250", "c3", "c5 + 49", "c5", "c2 + 50"), "eeiieeee"),
    "A5SS": (("c2 + 1", "c5 - 49", "c5 + 1", "c3 - 49", "c3 + 1", "c6 - 249", "c6 + 1", "c7 - 49"), ("c5", "c4 + 50", "c4", "c2 + 50", "c2", "c7 + 249", "c7 - 1", "c6 + 50"), "eeeeiiee"),
    "RI": (("c4 + 1", "c5 - 49", None, "c6 + 1", "c7 - 49"), ("c7", "c6 + 50", None, "c5 - 1", "c4 + 50"), "eeiee"),
    "MXE": (
        ("c7 - 49", "c7", "c2 - 248", "c2 + 1", "c3 - 49", "c3", "c4 - 248", "c4 + 1", "c5 - 49", "c5", "c8 - 248", "c8 + 1"),
        ("c8 + 51", "c8", "c5 + 250", "c5 - 1", "c4 + 51", "c4", "c3 + 250", "c3 - 1", "c2 + 51", "c2", "c7 + 250", "c7 - 1"), "eiieeiieeiie",
    ),
}
#: Motif region, side and length of each map region (P from the left, N from the right, S scaled).
WIRING = {
    "SE": (("UpstreamExon", "N", 50), ("UpstreamExonIntron", "P", 250), ("UpstreamIntron", "N", 250), ("TargetExon", "P", 50), ("TargetExon", "N", 50), ("DownstreamIntron", "P", 250), ("DownstreamExonIntron", "N", 250), ("DownstreamExon", "P", 50)),
    "A3SS": (("FlankingExon", "P", 50), ("FlankingExon", "N", 50), ("FirstIntron", "P", 250), ("secondIntron", "N", 250), ("SplicingRegion", "P", 50), ("SplicingRegion", "N", 50), ("downstreamExon", "P", 50), ("downstreamExon", "N", 50)),
    "A5SS": (("LongExon", "P", 50), ("LongExon", "N", 50), ("SplicingRegion", "P", 50), ("SplicingRegion", "N", 50), ("FirstIntron", "P", 250), ("FlankinfExonIntron", "N", 250), ("FlankingExon", "P", 50), ("FlankingExon", "N", 50)),
    "RI": (("UpstreamExon", "P", 50), ("UpstreamExon", "N", 50), ("Intron", "S", 250), ("downstreamExon", "P", 50), ("downstreamExon", "N", 50)),
    "MXE": (
        ("UpstreamExon", "N", 50), ("FirstIntron", "P", 250), ("SecondIntron", "N", 250), ("FirstExon", "P", 50), ("FirstExon", "N", 50), ("thirdIntron", "P", 250),
        ("fourthIntron", "N", 250), ("SecondExon", "P", 50), ("SecondExon", "N", 50), ("fifthIntron", "P", 250), ("sixthIntron", "N", 250), ("downstreamExon", "P", 50),
    ),
}
#: Coordinates c2.. of a converted isoform, on plus and on minus, for parts at fixed distances from k.
CONVERTED = {
    "A3SS": ((199, 300, 229, 300, -1, 100), (298, 230, 298, 200, -1, 100)),
    "A5SS": ((-1, 100, -1, 80, 199, 300), (79, 0, 99, 0, 199, 300)),
    "RI": ((-1, 300, -1, 100, 199, 300), (298, 0, 298, 200, 99, 0)),
    "MXE": ((199, 300, 399, 500, -1, 100, 599, 700), (399, 500, 199, 300, 599, 700, -1, 100)),
}
#: Isoform strings of these events; {s} is the strand.
ISOFORMS = {
    "A3SS": "chr1:{0}:{100}:{s}@chr1:{200}|{230}:{300}:{s}",
    "A5SS": "chr1:{0}:{80}|{100}:{s}@chr1:{200}:{300}:{s}",
    "RI": "chr1:{0}-{100}:{s}@chr1:{200}-{300}:{s}",
    "MXE": "chr1:{0}:{100}:{s}@chr1:{200}:{300}:{s}@chr1:{400}:{500}:{s}@chr1:{600}:{700}:{s}",
}


def _register(name: str, sql: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], SQL[name] = f, sql


def _regions(kind: str):
    return lambda spark, sf_dir: motif.regions(_coords(spark, sf_dir, kind), EVENTS[kind], Shape()).select("grp", "exon_idx", "fasta_region", "start", "end")


def _regions_sql(kind: str) -> str:
    parts = [f"select grp, exon_idx, '{n}' as fasta_region, case when strand = '-' then {c} else {a} end as start, case when strand = '-' then {d} else {b} end as \"end\" from coords" for n, a, b, c, d in REGIONS[kind]]
    return f"with {_coords_sql(kind)} " + " union all ".join(parts)


def _windows(kind: str):
    return lambda spark, sf_dir: overlap.windows(_coords(spark, sf_dir, kind), EVENTS[kind], _SPARSE)


def _windows_sql(kind: str) -> str:
    plus, minus, lengths = ANCHORS[kind]
    parts = [
        f"select grp, exon_idx, chr, {k} as region, cast(n as int) as pos, case when strand = '+' then {a} + n * 120 else {b} - n * 120 - 9 end as w_start from coords, range({1 if letter == 'e' else 3}) r(n)"
        for k, (a, b, letter) in enumerate(zip(plus, minus, lengths, strict=True)) if a
    ]
    return f"with {_coords_sql(kind)}, w as ({' union all '.join(parts)}) select *, w_start + 9 as w_end from w"


def _overlaps(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        peaks = _t(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("event_id") % 5 + 1).cast("int")).alias("chr"), (F.col("event_id") * 6 + 1).alias("p_start"), (F.col("event_id") * 6 + 20).alias("p_end"), F.floor("value").cast("bigint").alias("height"))
        return overlap.region_overlaps(_coords(spark, sf_dir, kind), peaks, EVENTS[kind], _SPARSE).groupBy("grp", "region", "pos").agg(F.sum("height").alias("total"))

    return run


def _overlaps_sql(kind: str) -> str:
    return f"""with w as ({_windows_sql(kind)}),
p as (select case event_id % 5 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM' when 3 then '4-NOT SPECIFIED' else '5-LOW' end as chr, event_id * 6 + 1 as p_start, event_id * 6 + 20 as p_end, cast(floor(value) as bigint) as height from events)
select w.grp, w.region, w.pos, cast(sum(p.height) as bigint) as total from w join p on w.chr = p.chr and p.p_start <= w.w_end and p.p_end >= w.w_start group by all"""


def _pieces(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Whole documents, cut at full stops and line ends, as sequences of the regions of an event type, in turn."""
    names = F.array(*[F.lit(r[0]) for r in EVENTS[kind].motif_regions()])
    d = _t(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "[.\n]")).alias("k", "seq"))
    region = F.element_at(names, ((F.col("doc_id") + F.col("k")) % len(EVENTS[kind].regions) + 1).cast("int"))
    return d.select(F.col("lang").alias("grp"), F.struct("doc_id", "k").alias("exon_idx"), region.alias("fasta_region"), "seq")


def _scatter(kind: str):
    return lambda spark, sf_dir: motif.hits(_pieces(spark, sf_dir, kind), _motifs(spark), EVENTS[kind], Shape()).groupBy("motif", "grp", "region", "pos").agg(F.sum("cnt").alias("cnt"))


def _scatter_sql(kind: str) -> str:
    order = REGIONS.get(kind) or [(n,) for n in ("UpstreamExon", "UpstreamExonIntron", "UpstreamIntron", "TargetExon", "DownstreamIntron", "DownstreamExonIntron", "DownstreamExon")]
    named = "case " + " ".join(f"when (doc_id + j) % {len(order)} = {k} then '{r[0]}'" for k, r in enumerate(order)) + " end"
    starts = " union all ".join(
        f"select motif, lang, region, n, m_len, cast(sum(len(piece)) over (partition by doc_id, j order by k rows unbounded preceding) as bigint) as p, k, last_k from (select *, '{name}' as motif, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k, len(pieces) as last_k from (select doc_id, lang, j, {named} as region, length(t) as n, length(regexp_extract(t, '{rx}')) as m_len, string_split(regexp_replace(t, '{rx}', chr(1) || '\\0', 'g'), chr(1)) as pieces from cut))"
        for name, rx in _MOTIFS)
    hits = []
    for k, (name, side, m) in enumerate(WIRING[kind]):
        if side == "P":
            hits.append(f"select motif, grp, {k} as region, unnest(range(greatest(0, p - 49), least({m}, p) - 1)) as pos from near where region = '{name}' and p < {m + 50}")
        elif side == "N":
            hits.append(f"select motif, grp, {k} as region, unnest(range(greatest(0, q + {m}), least({m}, q + {m + 50}))) as pos from near where region = '{name}' and q >= -{m + 50}")
        else:
            hits.append(f"select motif, grp, {k} as region, unnest(range(greatest(0, x - w + 1), least({m}, x) - 1)) as pos from (select *, cast(floor(p / n * {m}) as bigint) as x, cast(floor(50.0 / n * {m}) as bigint) as w from near where region = '{name}') where x < {m} + w")
    return f"""with cut as (select doc_id, lang, unnest(s) as t, generate_subscripts(s, 1) - 1 as j from (select doc_id, lang, string_split_regex(text, '[.\\n]') as s from documents)),
starts as ({starts}), near as (select motif, lang as grp, region, n, p, p + m_len - 1 - n as q from starts where k < last_k and p < 300 and p + m_len - 1 - n >= -300),
hits as ({' union all '.join(hits)}) select motif, grp, region, cast(pos as int) as pos, count(*) as cnt from hits group by all"""


def _converted(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k, x = F.col("p_partkey"), F.lit("0")
        strand = F.when(k % 2 == 0, "+").otherwise("-")
        parts = []
        for piece in ISOFORMS[kind].replace("}", "{").split("{"):
            parts.append(strand if piece == "s" else (k + int(piece)).cast("string") if piece.isdigit() else F.lit(piece))
        rows = _t(spark, sf_dir, "part").select(k.alias("line"), F.array(x, F.lit("0.5"), x, x, F.lit("0.4"), x, x, F.lit("0.1"), F.col("p_size").cast("string"), F.concat(*parts), x, F.concat(F.lit("0:3,1:"), (k % 5).cast("string")), x, F.lit("0:4"), F.lit("chr1"), strand, x, x).alias("f"))
        f, n = F.col("f"), EVENTS[kind].coordinates
        return isoforms.convert(rows, EVENTS[kind], 10, 40).select(F.col("line").alias("p_partkey"), f[4].alias("strand"), *[f[5 + j].cast("bigint").alias(f"c{2 + j}") for j in range(n)], *[f[6 + n + j].cast("int").alias(c) for j, c in enumerate(("ic1", "sc1", "ic2", "sc2"))], f[13 + n].cast("double").alias("fdr"))

    return run


def _converted_sql(kind: str) -> str:
    plus, minus = CONVERTED[kind]
    at = ", ".join(f"case when p_partkey % 2 = 0 then p_partkey + {a} else p_partkey + {b} end as c{2 + j}" for j, (a, b) in enumerate(zip(plus, minus, strict=True)))
    return f"""select p_partkey, case when p_partkey % 2 = 0 then '+' else '-' end as strand, {at}, cast(3 as int) as ic1, cast(p_partkey % 5 as int) as sc1, cast(4 as int) as ic2, cast(0 as int) as sc2,
  case when p_size >= 40 then 0.01 when p_size <= 10 then 1.0 else 0.4 end::double as fdr from part"""


for _kind in ("A3SS", "A5SS", "RI", "MXE"):
    _register(f"motif_regions_{_kind.lower()}", _regions_sql(_kind), _regions(_kind))
    _register(f"anchored_windows_{_kind.lower()}", _windows_sql(_kind), _windows(_kind))
    _register(f"region_overlap_totals_{_kind.lower()}", _overlaps_sql(_kind), _overlaps(_kind))
    _register(f"isoform_parse_{_kind.lower()}", _converted_sql(_kind), _converted(_kind))
for _kind in EVENTS:
    _register(f"motif_wiring_{_kind.lower()}", _scatter_sql(_kind), _scatter(_kind))


def query(sql: str):
    def add(f):
        _register(f.__name__, sql, f)
        return f

    return add


def _above(z: str) -> str:
    """SQL of the upper tail of the normal distribution, by midpoints."""
    return f"(0.5 - ({z}) / 4000 * list_sum(list_transform(range(4000), lambda i: exp(-0.5 * power(({z}) * (i + 0.5) / 4000, 2)))) / sqrt(2 * pi()))"


def _columns(spark: SparkSession, sf_dir: str, method: str, clip: bool, name: str) -> DataFrame:
    p = stats.rank_column(method, clip)("v_click", "c_click", "v_view", "c_view")
    return _samples(spark, sf_dir).select("bucket", F.round(p, 5).alias(name))


@query(f"""with {_RANKS}, n as (select bucket, count(*) filter (one) as a, count(*) filter (not one) as b, sum(pooled) filter (one) as r1 from r group by bucket),
t as (select bucket, sum(c * c * c - c) as ties from (select bucket, v, cast(count(*) as double) as c from s group by all) group by bucket),
z as (select bucket, (r1 - a * (a + 1) / 2.0 - a * b / 2.0 - 0.5) / sqrt(a * b / 12.0 * ((a + b + 1) - ties / ((a + b) * (a + b - 1.0)))) as z from n join t using (bucket))
select bucket, round({_above('z')}, 5) as p from z""")
def mannwhitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir, "mannwhitney_greater", True, "p")


@query(f"""with {_RANKS}, m as (select bucket, one, avg(pooled) as mp, avg(own) as mo, count(*) as n from r group by all),
v as (select r.bucket, r.one, sum((pooled - own - mp + mo) ** 2) / (any_value(n) - 1) as s, any_value(n) as n, any_value(mp) as mp from r join m on r.bucket = m.bucket and r.one = m.one group by all),
w as (select x.bucket, x.n * y.n * (y.mp - x.mp) / ((x.n + y.n) * sqrt(x.n * x.s + y.n * y.s)) as w from v x join v y on x.bucket = y.bucket and x.one and not y.one)
select bucket, round(1 - {_above('w')}, 5) as p from w""")
def brunner_munzel_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir, "brunnermunzel_greater", True, "p")


_SMALL = """v as (select c_custkey // 11 as g, row_number() over (partition by c_custkey // 11 order by c_custkey) as n, c_acctbal + c_custkey * 1e-4 as x from customer),
s as (select g, n <= 3 as one, x from v)"""


def _small_samples(spark: SparkSession, sf_dir: str, first: Column, value: Column) -> DataFrame:
    """Customers in groups of eleven: in each the first ones against the others, as histograms."""
    c = _t(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 11).alias("g"), "c_custkey", value.alias("v"))
    c = c.withColumn("one", F.row_number().over(Window.partitionBy("g").orderBy("c_custkey")) <= first)
    bars = c.groupBy("g", "one", "v").agg(F.count("*").cast("double").alias("c"))
    lists = bars.groupBy("g").agg(*[F.array_sort(F.collect_list(F.when(F.col("one") == one, F.struct("v", "c")))).alias(n) for one, n in ((True, "a"), (False, "b"))])
    return lists.select("g", F.col("a.v").alias("v1"), F.col("a.c").alias("c1"), F.col("b.v").alias("v2"), F.col("b.c").alias("c2"))


@query(f"""with {_SMALL}, r as (select *, rank() over (partition by g order by x) as k, count(*) over (partition by g) as n from s),
o as (select g, n, sum(k) filter (one) as got from r group by all),
ways as (select n.n, a.i + b.i + c.i as total from range(4, 12) n(n), range(1, 12) a(i), range(1, 12) b(i), range(1, 12) c(i) where a.i < b.i and b.i < c.i and c.i <= n.n)
select o.g, coalesce(round(count(*) filter (total >= got) / cast(nullif(count(total), 0) as double), 6), 1.0) as p from o left join ways on o.n = ways.n group by o.g""")
def mannwhitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three against up to eight without ties: the exact form; 1 without a second sample."""
    p = stats.rank_column("mannwhitney_greater", False)("v1", "c1", "v2", "c2")
    return _small_samples(spark, sf_dir, F.lit(3), F.col("c_acctbal") + F.col("c_custkey") * 1e-4).select("g", F.round(p, 6).alias("p"))


@query(f"""with v as (select c_custkey // 11 as g, row_number() over (partition by c_custkey // 11 order by c_custkey) <= (c_custkey // 11) % 6 as one, case when (c_custkey // 11) % 4 = 0 then 5.0 else floor(c_acctbal / 3000) end as x from customer),
r as (select *, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0 as pooled, rank() over (partition by g, one order by x) + (count(*) over (partition by g, one, x) - 1) / 2.0 as own from v),
m as (select g, one, avg(pooled) as mp, avg(own) as mo, count(*) as n, count(distinct x) as d from r group by all),
t as (select r.g, r.one, sum((pooled - own - mp + mo) ** 2) / nullif(any_value(n) - 1, 0) as s, any_value(n) as n, any_value(d) as d, any_value(mp) as mp from r join m on r.g = m.g and r.one = m.one group by all),
w as (select g.g, x.n as n1, y.n as n2, x.d as d1, y.d as d2, x.n * y.n * (y.mp - x.mp) as top, (x.n + y.n) * sqrt(x.n * x.s + y.n * y.s) as below
  from (select distinct g from v) g left join t x on x.g = g.g and x.one left join t y on y.g = g.g and not y.one),
z as (select *, case when below > 1e-9 then top / below end as z from w)
select g, case when coalesce(n1, 0) < 2 or coalesce(n2, 0) < 2 or d1 < 2 or d2 < 2 then 1.0 when z is null then case when top >= 0 then 1.0 else 0.0 end else round(1 - {_above('z')}, 5) + 0.0 end as p_guarded from z""")
def brunner_munzel_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of none, one and more, of equal and of varied values: the guarded form gives 1 where there is nothing to compare."""
    g = F.floor(F.col("c_custkey") / 11)
    value = F.when(g % 4 == 0, 5.0).otherwise(F.floor(F.col("c_acctbal") / 3000).cast("double"))
    rows = _small_samples(spark, sf_dir, F.col("g") % 6, value)
    return rows.select("g", F.round(stats.rank_column("brunnermunzel_greater", True)("v1", "c1", "v2", "c2"), 5).alias("p_guarded"))


@query("""with c as (select p_type, p_size, sum(case when l_returnflag = 'R' then 1 else 0 end) as a, count(*) as m from lineitem join part on l_partkey = p_partkey group by all),
t as (select sum(a) as ta, sum(m) as tm from c),
f as (select p_type, p_size, ceil(a / 10.0) as a, ceil((m - a) / 10.0) as b, ceil((ta - a) / 10.0) as c, ceil((tm - m - ta + a) / 10.0) as d from c, t)
select p_type, p_size, case when least(a + b, c + d, a + c, b + d) <= 0 then 1.0 else round(least(1.0, (select sum(exp(lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - a - b + x + 1)
  - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))) from range(cast(a as bigint), cast(least(a + b, a + c) as bigint) + 1) r(x))), 6) end as p from f""")
def fisher_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's test with cells divided by a window of 10 and rounded up."""
    joined = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    own = joined.groupBy("p_type", "p_size").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("n"))
    table = own.crossJoin(F.broadcast(own.agg(F.sum("a").alias("ta"), F.sum("n").alias("tn"))))  # one row
    return table.select("p_type", "p_size", F.round(stats.fisher_column("a", "n", F.col("ta") - F.col("a"), F.col("tn") - F.col("n"), F.lit(10)), 6).alias("p"))


_FEW = "few as (select case l_returnflag when 'A' then 'up' when 'R' then 'dn' else 'bg' end as grp, l_linenumber - 1 as region, l_suppkey % 5 as pos, l_orderkey % 40 as exon_idx, cast(sum(l_quantity) as bigint) as cnt from lineitem group by all)"


@query(f"""with {_FEW}, cells as (select a.region, b.pos, e.k from range(7) a(region), range(5) b(pos), range(40) e(k)),
l as (select c.region, c.pos, k, coalesce(cnt, 0) as cnt from cells c left join few f on f.grp = 'up' and f.region = c.region and f.pos = c.pos and f.exon_idx = k)
select cast(region as int) as region, cast(pos as int) as pos, cast(sum(cnt) as bigint) as sum, '[' || string_agg(cast(cnt as varchar), ',' order by k) || ']' as values from l group by all""")
def value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists of the counts of all exons of a group."""
    grp = F.when(F.col("l_returnflag") == "A", "up").when(F.col("l_returnflag") == "R", "dn").otherwise("bg")
    counts = _t(spark, sf_dir, "lineitem").groupBy(grp.alias("grp"), (F.col("l_linenumber") - 1).cast("int").alias("region"), (F.col("l_suppkey") % 5).cast("int").alias("pos"), (F.col("l_orderkey") % 40).alias("exon_idx")).agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    return summary.value_lists(counts, summary.grid(spark, [(k, 5) for k in range(7)]), dict.fromkeys(GROUPS, 40), "up", [])


_TESTED = f"""{_COUNTED}, cells as (select a.region, b.pos from range(7) a(region), range(50) b(pos)),
t as (select region, pos, {', '.join(f"coalesce(cast(sum(cnt) filter (grp = '{g}') as bigint), 0) as {g}" for g in GROUPS)}, (region * 50 + pos + 1) / 400.0 as p_up, 1 - (region * 50 + pos + 1) / 400.0 as p_dn from cells left join counted using (region, pos) group by all),
d as (select *, {', '.join(f"least(1.0, {g} / {n}.0) as mean_{g}" for g, n in zip(GROUPS, (4000, 5000, 6000), strict=True))}, 0 - log10(p_up) as nlp_up, 0 - log10(p_dn) as nlp_dn from t)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("region") * 50 + F.col("pos") + 1) / 400.0
    total = summary.totals(_counted(spark, sf_dir), summary.grid(spark, [(k, 50) for k in range(7)]), [])
    return summary.draw_points(total.withColumn("p_up", p).withColumn("p_dn", 1 - p), {"up": 4000, "dn": 5000, "bg": 6000})


@query(f"with {_TESTED} select cast(region as int) as region, cast(pos as int) as pos, {', '.join(f'round(mean_{g}, 6) as mean_{g}' for g in GROUPS)}, round(nlp_up, 6) as nlp_up, round(nlp_dn, 6) as nlp_dn from d")
def draw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("region", "pos", *[F.round(c, 6).alias(c) for c in ("mean_up", "mean_dn", "mean_bg", "nlp_up", "nlp_dn")])


@query(f"with {_TESTED} select cast(region as int) as region, round(greatest(1e-52, max(greatest(mean_up, mean_dn, mean_bg))), 6) as max_mean, round(greatest(1e-65, max(greatest(nlp_up, nlp_dn))), 6) as max_nlp from d group by region")
def peak_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest mean score and -log10 p, here by region."""
    found = summary.peak_values(_points(spark, sf_dir), ["region"])
    return found.select("region", *[F.round(c, 6).alias(c) for c in ("max_mean", "max_nlp")])


_KEYED = """k as (select o_orderkey as n, case o_orderstatus when 'O' then 'up' when 'F' then 'dn' else 'bg' end as grp, o_orderpriority as chr, case when o_custkey % 3 = 0 then '-' else '+' end as strand, o_custkey * 10 as c2, o_custkey * 10 + 5 as c3, o_orderkey + 1 as c4, o_orderkey + 2 as c5, o_orderkey + 3 as c6, o_orderkey + 4 as c7 from orders)"""


@query(f"""with {_KEYED}, g as (select grp, chr, strand, c2, c3, min(n) as first, max(n) as last from k group by all)
select grp, row_number() over (partition by grp order by first) - 1 as exon_idx, chr, strand, c2, c3, last + 1 as c4, last + 2 as c5, last + 3 as c6, last + 4 as c7 from g""")
def rekeyed_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exon for each key, the last row's flanks in the first row's place, numbered within its group."""
    grp = F.when(F.col("o_orderstatus") == "O", "up").when(F.col("o_orderstatus") == "F", "dn").otherwise("bg")
    c, k = F.col("o_custkey") * 10, F.col("o_orderkey")
    coords = _t(spark, sf_dir, "orders").select(grp.alias("grp"), k.alias("exon_idx"), F.col("o_orderpriority").alias("chr"), F.when(F.col("o_custkey") % 3 == 0, "-").otherwise("+").alias("strand"), c.alias("c2"), (c + 5).alias("c3"), *[(k + j).alias(f"c{3 + j}") for j in range(1, 5)])
    return K.rekeyed(coords, EVENTS["SE"])


_RUNS = """o as (select 'run_' || o_orderstatus as run, 'c' || (o_custkey % 500) || '.' || o_orderpriority as RBP, o_orderkey % 8 as region, ((o_orderkey * 7919) % 100003 + 1) / 100004.0 as p from orders),
s as (select run, RBP, region, min(p) as up, min(1 - p) as dn from o group by all)"""


@query(f"""with {_RUNS}, b as (select run, RBP, min(up) as u, min(dn) as d from s group by all),
r as (select *, row_number() over (partition by run order by u, RBP) as rank from b)
select run, RBP, round(u, 9) as pval_up_vs_bg, round(d, 9) as pval_dn_vs_bg, round(0 - log10(u), 6) as log_pval_up, round(0 - log10(d), 6) as log_pval_dn, cast(rank as int) as rank from r where rank <= 20""")
def result_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the summaries of three runs and, in a fourth, p-values by position under the same file names; then takes the top of each run from the folders."""
    folder = f"{root(spark)}/runs-{uuid.uuid4().hex}"
    p = ((F.col("o_orderkey") * 7919) % 100003 + 1) / 100004.0
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("c"), (F.col("o_custkey") % 500).cast("string")).alias("motif"), F.col("o_orderpriority").alias("regex"), (F.col("o_orderkey") % 8).cast("int").alias("region"), p.alias("p_up"), (1 - p).alias("p_dn"))
    for status in ("F", "O", "P"):
        for g in ("up", "dn"):
            sinks.write_report(summary.min_p_summary(o.where(F.col("o_orderstatus") == status), EVENTS["SE"], g), f"{folder}/run_{status}/pVal.{g}.vs.bg.RNAmap.txt")
    sinks.write_report(o.groupBy(F.col("region").alias("Region"), F.lit(0).alias("position")).agg(F.min("p_up").alias("fisher.exact.pVal")), f"{folder}/peaks/pVal.up.vs.bg.RNAmap.txt")
    found = results.top_of_runs(spark, folder)
    return found.select("run", "RBP", *[F.round(c, 9).alias(c) for c in ("pval_up_vs_bg", "pval_dn_vs_bg")], *[F.round(c, 6).alias(c) for c in ("log_pval_up", "log_pval_dn")], "rank")


__all__ = ["QUERIES", "SQL"]
