"""Sources, whole analyses, the command line, streaming, and the registered queries against their SQL."""

import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spliceatlas import cli, streaming
from spliceatlas.functions import stats
from spliceatlas.operators import summary
from spliceatlas.operators.motif import Shape
from spliceatlas.paths import user_path
from spliceatlas.plans import maps
from spliceatlas.plans.queries import QUERIES, SQL
from spliceatlas.sources import genome, results, text, workbook
from spliceatlas.specs import EVENTS

ROOT = Path(__file__).resolve().parent.parent


def event_line(k, fdr, psi1, psi2, delta, strand="+"):
    return "\t".join(["id", "gene", "sym", "chr1", strand, str(1000 + 97 * k), str(1080 + 97 * k), str(700 + 97 * k), str(800 + 97 * k), str(1300 + 97 * k), str(1400 + 97 * k), "id", *["1"] * 6, "0.01", fdr, psi1, psi2, delta])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    import random

    top, rnd = tmp_path_factory.mktemp("in"), random.Random(4)
    lines = ["\t".join(["header"] * 23)]
    for k in range(30):
        kind = k % 3
        lines.append(event_line(k, "0.9" if kind == 2 else "0.001", "0.5,NA", "0.4" if kind == 2 else "0.1", ("0.5", "-0.5", "0.0")[kind], "+-"[k % 2]) + ("\t\r" if k % 5 == 0 else ""))
    lines.append("too\tshort")
    (top / "events.txt").write_text("\n".join(lines) + "\n")
    (top / "genome.fa").write_text(">chr1\n" + "\n".join("".join(rnd.choice("ACGTacgt") for _ in range(60)) for _ in range(90)) + "\n")
    (top / "motifs.txt").write_text("name\tregex\nm1\tA[CG]T\nm2\tTT[AG]\nm2\tTT[AG]\n")
    peaks = ["# comment"]
    for _ in range(400):
        a = rnd.randint(400, 4500)
        peaks.append(f"chr1\t{a}\t{a + rnd.randint(5, 30)}\tp\t{rnd.randint(1, 9)}.7\t+")
    (top / "peaks.bed").write_text("\n".join(peaks) + "\n")
    return top


def written(folder):
    """Lines of a folder of part files, in order, with the header of the first."""
    parts = [f.read_text().splitlines() for f in sorted(folder.glob("part-*"))]
    return parts[0][:1] + [line for p in parts for line in p[1:]]


def test_sources(spark, files, tmp_path):
    events = text.read_events(spark, str(files / "events.txt"), EVENTS["SE"])
    assert events.count() == 30 and all(len(r.f) == 23 for r in events.collect())
    peaks = text.read_peaks(spark, str(files / "peaks.bed"))
    assert peaks.count() == 400 and peaks.where("height > 9 or p_start < 401").count() == 0
    assert text.read_motifs(spark, str(files / "motifs.txt")).count() == 2
    bad = tmp_path / "bad.bed"
    bad.write_text("chr1\t1\t2\n")
    with pytest.raises(Exception, match="six columns"):
        text.read_peaks(spark, str(bad)).collect()
    book = tmp_path / "b.XLSX"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>h</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert workbook.is_workbook(str(book)) and [r.f for r in workbook.read_workbook(spark, str(book)).collect()] == [["ab", "", "2.5"], ["", "x", ""]]


@pytest.mark.parametrize("method", ["fisher", "mannwhitney", "brunnermunzel"])
def test_clip_map_and_its_replay(spark, files, tmp_path, method):
    coords = maps.load_coordinates(spark, EVENTS["SE"], "clip", events=str(files / "events.txt"))
    peaks = text.read_peaks(spark, str(files / "peaks.bed"))
    shape = Shape(20, 60, 10, 5)
    one = maps.clip_map(coords, peaks, "SE", shape, method)
    assert one.sizes == {"up": 10, "dn": 10, "bg": 10}
    tested = one.tested.orderBy("region", "pos").collect()
    assert len(tested) == one.cells.count() and all(0 <= r.p_up <= 1 and 0 <= r.p_dn <= 1 for r in tested)
    assert sum(r.up for r in tested) > 0
    paths = {}
    for g in ("up", "dn", "bg"):
        paths[g] = str(tmp_path / f"{g}.coord.txt")
        rows = coords.where(F.col("grp") == g).orderBy("exon_idx").drop("grp", "exon_idx").collect()
        Path(paths[g]).write_text("\n".join(["header", *["\t".join(map(str, r)) for r in rows]]) + "\n")
    again = maps.clip_map(maps.load_coordinates(spark, EVENTS["SE"], "clip", **paths), peaks, "SE", shape, method)
    assert again.tested.orderBy("region", "pos").collect() == tested
    assert one.combined().count() == len(tested)


def test_clip_map_needs_all_groups(spark, files):
    coords = maps.load_coordinates(spark, EVENTS["SE"], "clip", events=str(files / "events.txt")).where("grp <> 'dn'")
    with pytest.raises(ValueError, match="no exons"):
        maps.clip_map(coords, text.read_peaks(spark, str(files / "peaks.bed")), "SE")
    with pytest.raises(ValueError, match="needed"):
        maps.load_coordinates(spark, EVENTS["SE"], "clip", events="NA")


def test_motif_map(spark, files):
    coords = maps.load_coordinates(spark, EVENTS["SE"], "motif", events=str(files / "events.txt"), cuts=maps.Cuts(bg_fdr=0.5, min_psi=0.85, max_psi=0.15))
    result = maps.motif_map(coords, genome.read_fasta(spark, str(files / "genome.fa")), text.read_motifs(spark, str(files / "motifs.txt")), "SE", Shape(20, 60, 10, 1))
    assert result.tested.count() == 2 * sum((20, 60)[c == "i"] for c in "eiieeiie")
    totals = result.tested.agg(F.sum("up"), F.sum("dn"), F.sum("bg")).first()
    counted = {r.grp: r.n for r in result.counts.groupBy("grp").agg(F.sum("cnt").alias("n")).collect()}
    assert tuple(totals) == tuple(counted[g] for g in ("up", "dn", "bg")) and totals[0] > 0
    summary_rows = result.min_p("up").collect()
    assert [r[0] for r in sorted(summary_rows)] == ["m1.A[CG]T", "m2.TT[AG]"] and result.min_p("up").columns[1] == "smallest_p_in_upstreamExon-3prime"
    assert result.top().count() == 2 and result.points().where("mean_up > 1 or nlp_up < 0").count() == 0
    assert result.values("up").count() == result.cells.count()


def test_command_line(spark, files, tmp_path):
    args = ["clip-map", "se", "--events", str(files / "events.txt"), "--peak", str(files / "peaks.bed"), "--output", str(tmp_path / "c"), "--exon", "20", "--intron", "30", "--plots"]
    assert cli.main(args) == 0
    assert (tmp_path / "c/SE.RNA.map.svg").read_text().count("<polyline") == 40
    assert "Upregulated (" in (tmp_path / "c/SE.RNA.map.svg").read_text() and "-log10 p" in (tmp_path / "c/SE.RNA.map.svg").read_text()
    assert "start: clip-map se" in (tmp_path / "c/log.clip-map.txt").read_text()
    names = {p.name for p in (tmp_path / "c").iterdir()}
    assert {"upregulated.RNAmap.txt", "combined.RNAmap.txt", "count.dist.background.RNAmap.txt", "pVal.up.vs.bg.RNAmap.txt"} <= names
    head = (tmp_path / "c/pVal.up.vs.bg.RNAmap.txt").read_text().split("\n")
    assert head[0] == f"Region\tposition\t{stats.HEADERS['fisher']}" and head[1].startswith("UpstreamExon_3prime\t0\t")
    assert cli.main(["motif-map", "se", "--events", str(files / "events.txt"), "--known-motifs", str(files / "motifs.txt"), "--fasta", str(files / "genome.fa"), "--output", str(tmp_path / "m"), "--exon", "10", "--intron", "10", "--window", "5", "--keep-tables", "--plots"]) == 0
    assert len(list((tmp_path / "m/maps").glob("SE.m*.svg"))) == 2
    assert list((tmp_path / "m/fasta").glob("part-*"))
    for d in ("countDist.up", "pVal.dn.vs.bg"):  # a folder for each motif
        assert {p.name.split(".")[0] for p in (tmp_path / "m" / d).glob("RBP=*")} == {"RBP=m1", "RBP=m2"}
    paths = {g: str(tmp_path / f"c/exon/{g}.coord.txt") for g in ("up", "dn", "bg")}
    assert maps.load_coordinates(spark, EVENTS["SE"], "clip", **paths).groupBy("grp").count().count() == 3
    assert (tmp_path / "m/pVal.up.vs.bg.RNAmap.txt").read_text().startswith("RBP\tsmallest_p_in")
    iso = tmp_path / "iso.txt"
    iso.write_text("\t".join(["h"] * 18) + "\n" + "\t".join(["e", "0.3", "x", "x", "0.2", "x", "x", "0.1", "100", "c:11:20:+@c:31:40:+@c:51:60:+", "x", "0:1", "x", "1:2", "chr1", "+", "x", "x"]) + "\n")
    assert cli.main(["convert", "se", "--input", str(iso), "--output", str(tmp_path / "o.txt")]) == 0
    assert written(tmp_path / "o.txt")[1].startswith("NA\tNA\tNA\tchr1\t+\t30\t40\t10\t20\t50\t60\tNA")
    with pytest.raises(ValueError, match="underscore"):
        cli.main([*args, "--label", "a_b"])


def test_stream_of_event_files(spark, files, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    os.link(files / "events.txt", folder / "a.txt") if hasattr(os, "link") else None
    found = streaming.classify_stream(streaming.stream_events(spark, str(folder)), EVENTS["SE"])
    query = found.writeStream.format("memory").queryName("classified").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.grp: r.n for r in spark.table("classified").groupBy("grp").agg(F.count("*").alias("n")).collect()} == {"up": 10, "dn": 10, "bg": 10}


def test_summaries_drop_zero(spark):
    up = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.2, 0.1), ("c", 0.0, 0.0)], "RBP string, R1 double, R2 double")
    dn = spark.createDataFrame([("b", 0.3, 1.0), ("d", 0.01, 1.0)], "RBP string, R1 double, R2 double")
    assert [(r.RBP, r.pval_up_vs_bg, r.pval_dn_vs_bg) for r in summary.top_motifs(up, dn).collect()] == [("b", 0.1, 0.3), ("a", 0.5, 1.0), ("d", 1.0, 0.01)]


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    got = QUERIES[name](spark, small)
    if name not in SQL:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for file in os.listdir(small):
        db.execute(f"create view {file[:-8]} as select * from '{small}/{file}'")
    expected = db.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(expected.fetchall())


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    """The package and the entry import without spliceatlas.llm and corpus_pipeline."""
    import shutil

    shutil.copytree(ROOT / "spliceatlas", tmp_path / "spliceatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, spliceatlas.cli, spliceatlas.streaming; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_the_permutation_query_takes_all_permutations(spark, small):
    rows = QUERIES["permutation"](spark, small).collect()
    counts = [p * (stats.PERMUTATIONS + 1) for r in rows for p in (r.p_up, r.p_dn)]
    assert any(c < stats.PERMUTATIONS for c in counts)
    assert counts == pytest.approx([round(c) for c in counts], abs=1e-3)  # p-values come rounded to six places


def test_user_paths(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/someone")
    base = str(tmp_path.resolve())
    assert user_path("NA", base) == "NA" and user_path("results/../out", base) == f"{base}/out"
    assert user_path("~/x", base) == "/home/someone/x" and user_path("/a/b", base) == "/a/b"
    assert user_path("s3a://bucket/x", base) == "s3a://bucket/x" and user_path("file:/x", base) == "file:/x"
    monkeypatch.chdir(tmp_path)
    assert user_path("y") == f"{base}/y"


def test_permutation_settings(monkeypatch):
    for given, expected in ((("80", "7"), (80, 7)), (("49", "-1"), (500, 1337)), (("many", ""), (500, 1337)), ((" 50 ", "0"), (50, 0))):
        monkeypatch.setenv("SPLICEATLAS_STAT_PERMUTATIONS", given[0])
        monkeypatch.setenv("SPLICEATLAS_STAT_SEED", given[1])
        assert stats.permutation_settings() == expected


def test_results_of_many_runs(spark, tmp_path):
    files = {
        "a/pVal.up.vs.bg.RNAmap.txt": "RBP\tR1\tR2\nm1\t0.5\t0.01\nm2\t0\t0.2\nm3\tNA\t2\n", "a/pVal.dn.vs.bg.RNAmap.txt": "RBP\tR1\tR2\nm1\t0.04\t1\nm4\t0.3\t0.9\n",
        "b/pVal.up.vs.bg.RNAmap.txt": "Region\tposition\tfisher.exact.pVal\nR1\t0\t0.25\nR1\t1\tNA\n", "b/pVal.dn.vs.bg.RNAmap.txt": "RBP\tR1\n", "deep/c/pVal.up.vs.bg.RNAmap.txt": "RBP\tR1\nm1\t0.2\nm9\t0.2\n", "a/other.txt": "RBP\tR1\nm7\t0.1\n",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    top = results.top_of_runs(spark, str(tmp_path)).collect()
    assert {(r.run, r.rank, r.RBP, r.pval_up_vs_bg, r.pval_dn_vs_bg) for r in top} == {("a", 1, "m1", 0.01, 0.04), ("a", 2, "m2", 0.2, 1.0), ("a", 3, "m4", 1.0, 0.3), ("c", 1, "m1", 0.2, 1.0), ("c", 2, "m9", 0.2, 1.0)}
    assert {(r.run, r.rank, r.RBP) for r in results.top_of_runs(spark, str(tmp_path), 1).collect()} == {("a", 1, "m1"), ("c", 1, "m1")}
    assert [tuple(r) for r in results.read_positions(spark, str(tmp_path)).orderBy("position").collect()] == [("b", "up", "R1", 0, 0.25), ("b", "up", "R1", 1, None)]


def test_output_folders_may_be_uris(spark, files, tmp_path):
    out = (tmp_path / "u").as_uri()
    assert cli.main(["clip-map", "se", "--events", str(files / "events.txt"), "--peak", str(files / "peaks.bed"), "--output", out, "--exon", "20", "--intron", "30", "--plots"]) == 0
    names = {f.name for f in (tmp_path / "u").iterdir()}
    assert {"SE.RNA.map.svg", "log.clip-map.txt", "combined.RNAmap.txt", "exon", "count.dist.background.RNAmap.txt"} <= names
    assert "end" in (tmp_path / "u/log.clip-map.txt").read_text()
    assert written(tmp_path / "u/exon/up.coord.txt")[0].startswith("chr\tstrand") and len(written(tmp_path / "u/exon/up.coord.txt")) > 1
