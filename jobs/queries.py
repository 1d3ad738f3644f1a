"""The jobs as registered queries: run twice into one new folder, whose output is the result; with the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceatlas.scratch import root
from spliceatlas.specs import GROUPS

from . import motif_map, peak_map


def job1_motif_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{root(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        result = motif_map.run(spark, sf_dir, f"{folder}/output", f"{folder}/checkpoint")
    return result.withColumn("p", F.round("p", 6))


def job2_peak_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{root(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        result = peak_map.run(spark, sf_dir, f"{folder}/output")
    return result.select(*result.columns[:5], *[F.round(c, 6).alias(c) for c in result.columns[5:]])


def _fisher(a: str, b: str, c: str, d: str) -> str:
    """SQL of P(X >= a) for the table [[a, b], [c, d]] with fixed margins; 1 if a margin is 0."""
    return f"""case when least({a} + {b}, {c} + {d}, {a} + {c}, {b} + {d}) <= 0 then 1.0 else round(least(1.0, (select sum(exp(lgamma({a} + {c} + 1) - lgamma(x + 1) - lgamma({a} + {c} - x + 1)
  + lgamma({b} + {d} + 1) - lgamma({a} + {b} - x + 1) - lgamma({b} + {d} - {a} - {b} + x + 1) - lgamma({a} + {b} + {c} + {d} + 1) + lgamma({a} + {b} + 1) + lgamma({c} + {d} + 1)))
  from range(cast({a} as bigint), cast(least({a} + {b}, {a} + {c}) as bigint) + 1) r(x))), 6) end"""


def _motif_map_sql() -> str:
    config = motif_map.read_config()
    bins = config["bins"]
    cut = []
    for name, rx in config["motifs"].items():
        if name == "double":  # DuckDB's expressions have no references to groups
            rx = "|".join(c * 2 for c in "lmnst")
        mark = f"regexp_replace(t, '{rx}', chr(1) || '\\0', 'g')"
        cut.append(f"select '{name}' as motif, grp, r, length(t) as n, string_split({mark}, chr(1)) as pieces from d")
    return f"""with d as (select coalesce(lang, '') as grp, row_number() over () as r, coalesce(text, '') as t from documents),
cut as ({' union all '.join(cut)}),
pieces as (select motif, grp, r, n, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k, len(pieces) as last_k from cut),
starts as (select motif, grp, r, n, k, last_k, cast(sum(len(piece)) over (partition by motif, r order by k rows unbounded preceding) as bigint) as p from pieces),
one as (select motif, grp, r, least(p * {bins} // greatest(n, 1), {bins - 1}) as bin, count(*) as hits from starts where k < last_k group by all),
own as (select motif, grp, bin, cast(sum(hits) as bigint) as hits, count(*) as sequences from one group by all),
every as (select motif, bin, count(*) as w from one group by all),
sizes as (select grp, count(*) as n from d group by grp), whole as (select count(*) as n from d),
cells as (select m.motif, s.grp, cast(b.bin as int) as bin, s.n, whole.n - s.n as rest_n from sizes s, whole, (select unnest({list(config['motifs'])}) as motif) m, range({bins}) b(bin)),
t as (select motif, grp, bin, coalesce(hits, 0) as hits, coalesce(sequences, 0) as sequences, n, coalesce(w, 0) - coalesce(sequences, 0) as rest_sequences, rest_n
  from cells left join own using (motif, grp, bin) left join every using (motif, bin)),
f as (select *, sequences as a, n - sequences as b, rest_sequences as c, rest_n - rest_sequences as d from t)
select motif, grp, bin, hits, sequences, n, rest_sequences, rest_n, case when n = 0 or rest_n = 0 then 1.0 else {_fisher('a', 'b', 'c', 'd')} end as p from f"""


def _peak_map_sql() -> str:
    #: First base of each region on plus, last base on minus, for 50 exonic and 250 intronic bases, and the number of windows.
    anchors = (
        ("UpstreamExon_3prime", "c5 - 49", "c6 + 50", 3), ("UpstreamExonIntron", "c5 + 1", "c6", 13), ("UpstreamIntron", "c2 + 1 - 250", "c3 + 250", 13), ("TargetExon_5prime", "c2 + 1", "c3", 3),
        ("TargetExon-3prime", "c3 - 49", "c2 + 50", 3), ("DownstreamIntron", "c3 + 1", "c2", 13), ("DownstreamExonIntron", "c6 + 1 - 250", "c6", 13), ("DownstreamExon_5prime", "c6 + 1", "c6 + 50", 3),
    )
    windows = " union all ".join(f"select grp, chr, '{label}' as region, cast(k as int) as pos, case when strand = '+' then {a} + k * 20 else {b} - k * 20 - 9 end as w from x, range({n}) r(k)" for label, a, b, n in anchors)
    cells = " union all ".join(f"select '{label}' as region, cast(k as int) as pos from range({n}) r(k)" for label, _, _, n in anchors)
    sums = ", ".join(f"coalesce(cast(sum(height) filter (grp = '{g}') as bigint), 0) as {g}" for g in GROUPS)
    return f"""with e as (select (l_orderkey * 10 + l_linenumber) * 1000000000 + cast(round(l_extendedprice * 100) as bigint) as line, 'chr' || (l_partkey % 5) as chr,
  case when l_suppkey % 3 = 0 then '-' else '+' end as strand, l_orderkey * 37 + 2000 as c2, l_orderkey * 37 + 2150 as c3, l_orderkey * 37 + 1000 - l_linenumber as c4, l_orderkey * 37 + 1100 as c5,
  l_orderkey * 37 + 3000 as c6, l_orderkey * 37 + 3120 + l_linenumber as c7, l_tax * 10 as fdr, (l_quantity - 25) / 25 as delta, l_discount * 10 as psi1, l_quantity / 50 as psi2 from lineitem),
g as (select *, case when fdr < 0.05 and delta >= 0.05 then 'up' when fdr < 0.05 and delta <= -0.05 then 'dn'
  when not fdr < 0.05 and fdr > 0.3 and least(psi1, psi2) < 0.95 and greatest(psi1, psi2) > 0.05 then 'bg' end as grp from e),
u as (select grp, chr, strand, c2, c3, arg_max(c4, line) as c4, arg_max(c5, line) as c5, arg_max(c6, line) as c6, arg_max(c7, line) as c7 from g where grp is not null group by all),
x as (select * from u qualify count(*) over (partition by chr, strand, c2, c3) = 1),
p as (select chr, p_start, p_end, arg_max(height, event_id) as height from (select event_id, 'chr' || (event_id % 5) as chr, event_id * 56 + 1 - event_id % 3 as p_start, event_id * 56 + 20 + user_id % 40 as p_end,
  1 + cast(floor(value / 100) as bigint) as height from events) group by all),
windows as ({windows}), cells as ({cells}),
met as (select grp, region, pos, height from windows join p on windows.chr = p.chr and p.p_start <= w + 9 and p.p_end >= w),
t as (select region, pos, {sums} from cells left join met using (region, pos) group by all),
s as (select {', '.join(f"count(*) filter (grp = '{g}') as n_{g}" for g in GROUPS)} from x),
f as (select t.*, s.*, {', '.join(f"ceil({g} / 10.0) as a_{g}, ceil(greatest(0, n_{g} - {g}) / 10.0) as b_{g}" for g in GROUPS)} from t, s)
select region, pos, up, dn, bg, {', '.join(f"round({g} / cast(n_{g} as double), 6) as mean_{g}" for g in GROUPS)}, {', '.join(f"{_fisher(f'a_{g}', f'b_{g}', 'a_bg', 'b_bg')} as p_{g}" for g in ('up', 'dn'))} from f"""


QUERIES = {f.__name__: f for f in (job1_motif_map, job2_peak_map)}
SQL = {"job1_motif_map": _motif_map_sql(), "job2_peak_map": _peak_map_sql()}
