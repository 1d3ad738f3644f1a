"""The jobs: two runs over growing input, reruns, other settings, and results against plain Python."""

import logging
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobs import motif_map, peak_map
from jobs.queries import QUERIES, SQL
from spliceatlas.functions.stats import fisher_greater

TEXTS = [
    ("en", "the hand and the other band"), ("en", ""), ("en", None), ("de", "und oder onkel"), (None, "eaten nothing"), ("de", "letter otter"), ("en", "the " * 2000), ("fr", "qqq"),
]
LATER = [("de", "the end"), ("it", "ancora nord sud"), ("en", "the hand and the other band")]


def put(folder: Path, name: str, rows) -> None:
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array(range(len(rows))), "lang": pa.array([g for g, _ in rows], pa.string()), "text": pa.array([t for _, t in rows], pa.string()), "bin": pa.array(["x"] * len(rows)), "batch": pa.array([7] * len(rows))}), folder / f"documents-{name}.parquet")


def expected(rows, config):
    bins, hits, some, n = config["bins"], Counter(), Counter(), Counter(g or "" for g, _ in rows)
    for g, text in rows:
        for name, rx in config["motifs"].items():
            found = Counter(min(m.start() * bins // max(1, len(text)), bins - 1) for m in re.finditer(rx, text or ""))
            for b, c in found.items():
                hits[name, g or "", b] += c
                some[name, g or "", b] += 1
    out = set()
    for name in config["motifs"]:
        for g in n:
            for b in range(bins):
                a, rest, rest_n = some[name, g, b], sum(some[name, o, b] for o in n if o != g), len(rows) - n[g]
                p = fisher_greater(a, n[g] - a, rest, rest_n - rest) if rest_n else 1.0
                out.add((name, g, b, hits[name, g, b], a, n[g], rest, rest_n, round(p, 9)))
    return out


def rows_of(df):
    return {(*r[:8], round(r[8], 9)) for r in df.collect()}


def test_motif_map_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    config = motif_map.read_config() | {"bins": 5, "files_per_batch": 1}
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(source, "1", TEXTS[:4])
    put(source, "2", TEXTS[4:])
    put(source, "3", [])
    (source / "other.parquet").write_bytes(b"not for this job")
    assert rows_of(motif_map.run(spark, str(source), out, check, config)) == expected(TEXTS, config)
    assert rows_of(motif_map.run(spark, str(source), out, check, config)) == expected(TEXTS, config)
    assert "read 0 new sequences" in caplog.text
    put(source, "4", LATER)
    assert rows_of(motif_map.run(spark, str(source), out, check, config)) == expected(TEXTS + LATER, config)
    assert "read 3 new sequences in 1 batches" in caplog.text
    # a batch that is done again replaces itself
    batch = spark.read.parquet(str(source / "documents-4.parquet"))
    motif_map.count_batch(batch, 3, config, out)
    done = spark.read.schema(motif_map.SIZES).parquet(f"{out}/sizes")
    assert done.groupBy().sum("n").first()[0] == len(TEXTS + LATER)
    with pytest.raises(ValueError, match="other settings"):
        motif_map.run(spark, str(source), out, check, config | {"bins": 6})


def test_motif_map_of_no_sequences(spark, tmp_path):
    put(tmp_path / "in", "1", [])
    assert motif_map.map_of(spark.createDataFrame([], motif_map.COUNTS), spark.createDataFrame([], motif_map.SIZES), motif_map.read_config()).count() == 0


PEAKS = {"line": "n", "chr": "c", "p_start": "a", "p_end": "b", "height": "h"}
EVENTS = {"line": "n", "chr": "c", "strand": "s", "positions": ["p0", "p0 + 100", "p0 - 500", "p0 - 400", "p0 + 500", "p0 + 600"], "fdr": "fdr", "delta": "delta", "psi1": "psi1", "psi2": "psi2"}


def small_tables(folder: Path, events) -> dict:
    folder.mkdir(exist_ok=True)
    names = ["n", "c", "s", "p0", "fdr", "delta", "psi1", "psi2"]
    pq.write_table(pa.table({k: [e[j] for e in events] for j, k in enumerate(names)} | {"grp": ["x"] * len(events), "key": [1] * len(events)}), folder / "e.parquet")
    peaks = [(1, "chr1", 1000, 1003, 2), (2, "chr1", 1000, 1003, 5), (3, "chr1", 1090, 1200, 1), (4, "chr2", 1001, 1001, 9)]
    pq.write_table(pa.table({k: [p[j] for p in peaks] for j, k in enumerate("ncabh")}), folder / "p.parquet")
    return {"tables": {"events": "e.parquet", "peaks": "p.parquet"}, "event": "SE", "method": "fisher", "shape": {"exon": 20, "intron": 20, "window": 10, "step": 10}, "cuts": peak_map.read_config()["cuts"], "events": EVENTS, "peaks": PEAKS}


def test_peak_map_classifies_and_sums(spark, tmp_path):
    up, dn, bg = (0.01, 0.5, 0.2, 0.5), (0.01, -0.5, 0.2, 0.5), (0.9, 0.0, 0.2, 0.5)
    events = [(1, "chr1", "+", 1000, *up), (2, "chr1", "+", 1000, *up), (3, "chr1", "-", 1000, *dn), (4, "chr2", "+", 1000, *bg), (5, "chr3", "+", 5, *bg), (6, "chr1", "+", 7, *up), (7, "chr1", "+", 7, *dn), (8, None, "+", 9, *up), (9, "chr1", "+", 11, float("nan"), 0.5, 0.1, 0.2), (10, "chr1", "+", 13, None, None, None, None)]
    config = small_tables(tmp_path / "in", events)
    first = peak_map.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config)
    got = {tuple(r) for r in first.collect()}
    # windows run from the first base on plus, from the last on minus; the background exon of chr2 has a peak of its own
    table = {(r[0], r[1]): r[2:5] for r in got}
    assert table["TargetExon_5prime", 0] == (5, 1, 9) and table["TargetExon-3prime", 1] == (1, 5, 0) and table["DownstreamIntron", 0][0] == 1
    assert {(r.grp, r["count"]) for r in spark.read.parquet(str(tmp_path / "out" / "exons")).groupBy("grp").count().collect()} == {("up", 1), ("dn", 1), ("bg", 2)}
    again = peak_map.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config)
    assert {tuple(r) for r in again.collect()} == got and again.columns == peak_map.MAP
    with pytest.raises(ValueError, match="no exons"):
        peak_map.run(spark, str(tmp_path / "in"), str(tmp_path / "out2"), small_tables(tmp_path / "in", events[3:5]))


def test_registered_jobs(spark, small):
    assert set(QUERIES) == set(SQL) == {"job1_motif_map", "job2_peak_map"}
    for name, f in QUERIES.items():
        df = f(spark, small)
        assert df.count() == len(df.distinct().collect()) > 0, name


def test_command_line(tmp_path):
    put(tmp_path / "in", "1", TEXTS)
    for _ in range(2):
        subprocess.run([sys.executable, "-m", "jobs.motif_map", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "check")], cwd=Path(__file__).parent.parent, check=True, timeout=300, capture_output=True)
    assert set(pq.read_table(tmp_path / "out" / "map").column("motif").to_pylist()) == set(motif_map.read_config()["motifs"])
