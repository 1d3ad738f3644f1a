"""Sums over groups are not put together by exon first; tiles, long peaks and dense tiles give what plain Python gives; folders as tables."""

import itertools
import random
import re
import shutil

import pytest

from jobs import motif_map
from jobs.queries import QUERIES as JOBS
from spliceatlas.operators import motif, numbering, overlap
from spliceatlas.operators.motif import Shape
from spliceatlas.plans.event_queries import QUERIES
from spliceatlas.specs import EVENTS
from test_operators import restated_scan

SUMS = [f"{q}{k}" for q in ("region_overlap_totals",) for k in ("", "_a3ss", "_a5ss", "_ri", "_mxe")]
SCATTERED = [f"motif_wiring_{k}" for k in ("se", "a3ss", "a5ss", "ri", "mxe")] + ["motif_scatter", "mean_score"]


def by_exon(df) -> list[str]:
    """Shuffles by exon and position."""
    return re.findall(r"hashpartitioning\([^)]*exon_idx[^)]*\)", re.sub(r"hashpartitioning\(exon_idx#\d+L?, \d+\)", "", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", SUMS)
def test_peak_totals_without_sums_of_exons(spark, small, name):
    assert not by_exon(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", SCATTERED)
def test_motif_totals_without_counts_of_exons(spark, small, name):
    assert not by_exon(QUERIES[name](spark, small))


@pytest.mark.parametrize("most", [20_000, 2])
def test_tiles_against_plain_python(spark, monkeypatch, most):
    """Introns of very different lengths, peaks over tile borders, of many tiles and with ends exchanged, negative places, nulls."""
    monkeypatch.setattr(overlap, "MOST_IN_BIN", most)
    exons = [("up", 0, "c", "+", 8190, 8300, 4000, 4100, 90_000, 90_100), ("up", 1, "c", "-", 8190, 8300, 4000, 4100, 90_000, 90_100), ("bg", 0, "c", ".", 100, 200, -400, -300, 300, 400), ("dn", 0, None, "+", 100, 200, 10, 20, 300, 400), ("dn", 1, "c", "+", None, 200, 10, 20, 300, 400)]
    coords = spark.createDataFrame(exons, "grp string, exon_idx bigint, chr string, strand string, " + ", ".join(f"c{k} bigint" for k in range(2, 8)))
    peaks = [("c", 8191, 8192, 1), ("c", 4050, 4200, 2), ("c", -100_000, 100_000, 4), ("c", 8150, 8320, 8), ("c", 8200, 8100, 16), ("c", 89_990, 90_020, 32), ("c", -420, -380, 64), ("d", 0, 9000, 128), ("c", None, 9000, 256), ("c", 0, 500_000, 512)]
    frame = spark.createDataFrame(peaks, "chr string, p_start bigint, p_end bigint, height bigint")
    kind, shape = EVENTS["SE"], Shape(20, 60, 10, 7)
    got = {(r.grp, r.exon_idx, r.region, r.pos): r.total for r in overlap.region_overlap_sum(coords, frame, kind, shape).collect()}
    want = {}
    for w in overlap.windows(coords, kind, shape).where("w_start is not null").collect():
        own = [h for c, a, b, h in peaks if c == w.chr and a is not None and a <= w.w_end and b >= w.w_start]
        if own:
            want[w.grp, w.exon_idx, w.region, w.pos] = sum(own)
    assert got == want and len(got) > 40


def test_scaled_introns_are_not_put_together(spark, small):
    """No shuffle by exon behind the join, no window, and nothing that names bins is sorted."""
    plan = QUERIES["retained_intron_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"hashpartitioning\([^)]*exon_idx", plan)


@pytest.mark.parametrize("most", [20_000, 2])
@pytest.mark.parametrize("step", [1, 3])
def test_scaled_introns_against_plain_python(spark, monkeypatch, step, most):
    """Introns of very different lengths, at negative places and over chunks; peaks over tile borders, of many tiles, repeated and with ends exchanged; nulls."""
    monkeypatch.setattr(overlap, "MOST_IN_BIN", most)
    rnd, kind, shape = random.Random(step), EVENTS["RI"], Shape(20, 60, 10, step)
    places = list(itertools.product("cd", "+-", (-700, 9_900), (3, 40, 900, 5000, 40_000)))
    exons = [("up", k, c, strand, 0, 0, 0, a, a + n, 0) for k, (c, strand, a, n) in enumerate(places)]
    nothing = [("up", 90, None, "+", 0, 0, 0, 10, 900, 0), ("up", 91, "c", "+", 0, 0, 0, None, 900, 0), ("up", 92, "c", None, 0, 0, 0, 10, None, 0)]
    coords = spark.createDataFrame(exons + nothing, "grp string, exon_idx bigint, chr string, strand string, " + ", ".join(f"c{k} bigint" for k in range(2, 8)))
    peaks = [(c, s, s + rnd.choice([0, 5, 60]), rnd.randint(0, 9)) for c in "cd" for s in (rnd.randint(-900, 45_000) for _ in range(20))]
    peaks += [("c", 1020, 1030, 1), ("c", 9_995, 10_005, 2), ("d", 2_047, 2_048, 3), ("d", 3_005, 3_000, 4), ("c", -100_000, 300, 5), ("c", 20_000, 900_000, 6), ("c", 31_000, 60_000, 7), (*peaks[0][:3], 8)]
    frame = spark.createDataFrame([(*p, k) for k, p in enumerate([*peaks, ("d", None, 9000, 1), ("d", 0, None, 1), (None, 0, 9000, 1)])], "chr string, p_start bigint, p_end bigint, height bigint, line bigint")
    found = overlap.scaled_overlap(coords, frame, kind, shape).collect()
    got, want = {(r.exon_idx, r.pos): r.total for r in found}, {}
    bins = next(n for (_, n), letter in zip(motif.positions(kind, shape, True), kind.lengths) if letter == "i")
    for _, k, chrom, strand, _, _, _, a, b, _ in exons:
        totals = restated_scan(a, b - a + 1, strand == "+", 10, step, bins, [p[1:] for p in peaks if p[0] == chrom])
        want |= {(k, place): v for place, v in enumerate(totals) if v}
    assert got == want and len(got) == len(found) > 100


def test_orders_repeated_count_once(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    orders.union(orders).write.parquet(str(tmp_path / "orders.parquet"))
    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
    got, want = (sorted(map(tuple, QUERIES["retained_intron_scan"](spark, str(p)).collect())) for p in (tmp_path, small))
    assert got == want and got


def test_motif_map_of_a_folder_of_part_files(spark, small, tmp_path):
    """A table may be a folder, with other tables beside it."""
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{small}/labels.parquet", tmp_path / "labels.parquet")
    spark.read.parquet(f"{small}/pages.parquet").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = (sorted(map(tuple, JOBS["job1_motif_map"](spark, str(p)).collect())) for p in (tmp_path, small))
    assert got == want and len(got) == len(want) > 0
    assert len(motif_map.read_config()["motifs"]) == len({r[0] for r in got})


def test_numbers_of_sparse_places(spark):
    """No window takes the rows of a group, however far places lie apart."""
    rows = [("a" if k % 3 else "b", (k * 7919 % 1009) * 1_000_000_000, k) for k in range(1009)]
    df = spark.createDataFrame(rows, "grp string, first bigint, id int").repartition(4)
    out = numbering.numbered(df, "grp", ["first"], "n")
    got = {r.id: (r.grp, r.n) for r in out.collect()}
    for g in "ab":
        own = [k for _, k in sorted((place, k) for grp, place, k in rows if grp == g)]
        assert [got[k] for k in own] == [(g, n) for n in range(len(own))]
    assert "row_number" not in out._jdf.queryExecution().executedPlan().toString()
