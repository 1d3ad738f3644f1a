"""Operators against plain restatements of their definitions, on small inputs."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceatlas.functions import scalars, stats
from spliceatlas.operators import classify as K
from spliceatlas.operators import isoforms, motif, numbering, overlap, summary
from spliceatlas.operators.motif import Shape
from spliceatlas.sources import genome
from spliceatlas.specs import EVENTS, event, event_description, list_supported_events


def fields_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line bigint, f array<string>")


def row(key, fdr, psi1, psi2, delta, flank="1"):
    return ["id", "gene", "sym", *key.split(":"), flank, "2", "3", "4", "pad", fdr, psi1, psi2, delta]


ROWS = [
    row("c:+:1:9", "0.01", "0.9", "0.1", "0.8"), row("c:+:2:9", "0.01", "0.1", "0.9", "-0.8"), row("c:+:3:9", "0.9", '"0.5,NA,0.7"', "0.1", "0.4"),
    row("c:+:4:9", "NA", "0.5", "0.1", "0.4"), row("c:+:5:9", "0.01", "0.5", "0.1", "NA"), row("c:+:6:9", "nan", "0.5", "0.1", "nan"),
    row("c:+:7:9", "0.05", "0.9", "0.1", "0.8"), row("c:+:8:9", "0.04", "0.9", "0.1", "0.05"), row("c:+:1:9", "0.02", "0.9", "0.1", "0.7", "77"),
    row("c:+:2:9", "0.9", "0.5", "0.3", "0.01"), row("c:+:11:9", "0.9", "NA", "NA", "0.01"), row("c:+:12:9", "0.6", "0.9", "0.95", "0.01"),
]


def test_classes_and_deduplication(spark):
    got = {(r.grp, r.key): r.coords[4] for r in K.classify(fields_of(spark, ROWS), EVENTS["SE"], K.MOTIF_CUTS).collect()}
    # key 2 is down and background; of key 1 the last row's flanks stay
    assert got == {("up", "c:+:1:9"): "77", ("up", "c:+:8:9"): "1", ("bg", "c:+:3:9"): "1"}
    coords = K.coordinates(K.classify(fields_of(spark, ROWS), EVENTS["SE"], K.MOTIF_CUTS), EVENTS["SE"]).orderBy("grp", "exon_idx").collect()
    assert [(r.grp, r.exon_idx, r.c2, r.c4) for r in coords] == [("bg", 0, 3, 1), ("up", 0, 1, 77), ("up", 1, 8, 1)]


@pytest.mark.parametrize("analysis,n", [("motif", 4), ("clip", 2)])
def test_fallback_background(spark, analysis, n):
    rows = [row("c:+:1:9", "0.01", "0.9", "0.1", "0.8"), row("c:+:2:9", "0.01", "0.9", "0.1", "0.9"), *[row(f"c:+:{10 + k}:9", "0.2", "0.9", "0.9", str(d)) for k, d in enumerate((0.3, -0.1, 0.2, 0.1))], row("c:+:1:9", "0.2", "1", "1", "0.0"), row("c:+:50:9", "0.2", "1", "1", "NA")]
    got = K.classify(fields_of(spark, rows), EVENTS["SE"], K.MOTIF_CUTS if analysis == "motif" else K.CLIP_CUTS, analysis).where("grp = 'bg'").orderBy("pos").collect()
    assert [r.key for r in got] == ["c:+:11:9", "c:+:13:9", "c:+:12:9", "c:+:10:9"][:n]


def test_rekeying_counts_an_exon_once(spark):
    rows = [("up", k, "c", "+", *v) for k, v in enumerate([(1, 9, 5, 6, 7, 8), (2, 9, 5, 6, 7, 8), (1, 9, 50, 60, 70, 80)])]
    coords = spark.createDataFrame(rows, "grp string, exon_idx bigint, chr string, strand string, c2 bigint, c3 bigint, c4 bigint, c5 bigint, c6 bigint, c7 bigint")
    assert [(r.exon_idx, r.c2, r.c4) for r in K.rekeyed(coords, EVENTS["SE"]).orderBy("exon_idx").collect()] == [(0, 1, 50), (1, 2, 5)]


def restated_scatter(sequence, regex, name, kind, shape):
    spans = [m.span() for m in re.finditer(regex, sequence)]
    out = {}
    if not spans:
        return out
    size, most = spans[0][1] - spans[0][0], max(shape.intron, shape.exon) + shape.window
    w, s, total = shape.window, shape.step, len(sequence)
    for start, _ in spans:
        end = start + size - 1 - total
        if start >= most or end < -most:
            continue
        for k, (region, side, letter) in enumerate(kind.wiring):
            if region != name:
                continue
            length = shape.length(letter)
            p, width = start, w
            if side == "S":
                p, width = int(start / total * length), int(w / total * length)
            if side in "PS" and p < length + width:
                places = range(max(0, p - width + 1) // s, min(length // s, p // s) - 1)
            elif side == "N" and end >= -length - w:
                x = end + length + w - 1
                places = range(max(0, x - w + 1) // s, min(length // s, x // s + 1))
            else:
                continue
            for place in places:
                out[(k, place)] = out.get((k, place), 0) + 1
    return out


@pytest.mark.parametrize("name", list(EVENTS))
@pytest.mark.parametrize("shape", [Shape(10, 20, 6, 1), Shape(12, 30, 5, 3)])
def test_scatter(spark, name, shape):
    kind, rnd = EVENTS[name], random.Random(name)
    seqs = [(k, r[0], "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 70)))) for k, r in enumerate(kind.motif_regions() * 12)]
    motifs = [("a", "A[CG]"), ("b", "TT+"), ("c", "GGGGGGGG")]
    frame = spark.createDataFrame([("up", *x) for x in seqs], "grp string, exon_idx bigint, fasta_region string, seq string")
    got = {(r.motif, r.exon_idx, r.region, r.pos): r.cnt for r in motif.hit_counts(frame, spark.createDataFrame(motifs, "motif string, regex string"), kind, shape).collect()}
    expected = {(m, k, *at): n for m, rx in motifs for k, region, s in seqs for at, n in restated_scatter(s, rx, region, kind, shape).items()}
    assert got == expected


def test_matches(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 40))) for _ in range(30)] + ["", None, "é" * 3 + "AA漢A"]
    expressions = ["A", "AA", "[AC]G", "T{2,3}", "^A", "N"]
    seqs = spark.createDataFrame(list(enumerate(texts)), "k bigint, seq string")
    motifs = spark.createDataFrame([("m", rx) for rx in expressions] + [("none", None)], "motif string, regex string")
    got = sorted((r.k, r.regex, r.p, r.m_len, r.seq_len) for r in motif.matches(seqs, motifs, ["k"]).collect())
    expected = []
    for k, text in enumerate(texts):
        for rx in expressions:
            spans = [m.span() for m in re.finditer(rx, text or "")]
            expected += [(k, rx, a, spans[0][1] - spans[0][0], len(text)) for a, _ in spans]
    assert got == sorted(expected)


def test_many_matches_in_one_sequence_take_linear_time(spark):
    began = time.time()
    list(motif._found(["AC" * 32_000], motif._Scan(["A"]), None))
    assert time.time() - began < 1
    rows = list(motif._found(["AC" * 100_000, "A"], motif._Scan(["A", "C"]), None))
    assert sum(len(r[0]) for r in rows) == 200_001 and len(rows) > 1
    assert list(motif._found(["AC" * 32_000], motif._Scan(["A"]), 300)) == []  # too long to have a match within reach of both ends


def test_a_motif_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(motif, "MOST_MOTIFS", 2)
    motifs = spark.createDataFrame([("a", "A"), ("b", "C"), ("c", "G")], "motif string, regex string")
    with pytest.raises(ValueError, match="motifs"):
        motif.matches(spark.createDataFrame([(1, "A")], "k bigint, seq string"), motifs, ["k"])


def test_numbering_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BUCKET_BITS", 3)
    rnd = random.Random(8)
    rows = [("ab"[rnd.randrange(2)], k, rnd.randrange(9)) for k in rnd.sample(range(1000), 200)] + [("a", None, 5), ("a", None, 4)]
    df = spark.createDataFrame(rows, "grp string, first bigint, pos bigint").repartition(4)
    got = {(r.grp, r.first, r.pos): r.n for r in numbering.numbered(df, "grp", ["first", "pos"], "n").collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r] for r in own] == list(range(len(own)))
    lines = spark.createDataFrame([("a", (f, s, r)) for f in ("x", "y") for s in (0, 7) for r in rnd.sample(range(100), 20)], "grp string, line struct<file:string,split:bigint,row:bigint>")
    found = numbering.numbered(lines, "grp", ["line"], "n").orderBy("line").collect()
    assert [r.n for r in found] == list(range(80))


def test_genome_slices(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(genome, "CHUNK", 7)
    monkeypatch.setattr(numbering, "BUCKET_BITS", 2)
    rnd = random.Random(1)
    chromosomes = {"c1": "".join(rnd.choice("acgtN") for _ in range(83)), "c2": "ACGT" * 5}
    fasta = tmp_path / "g.fa"
    fasta.write_text("".join(f">{n} about\n" + "\n".join(s[k : k + 10] for k in range(0, len(s), 10)) + "\n" for n, s in chromosomes.items()))
    table = genome.read_fasta(spark, str(fasta))
    asked = [(c, a, b, r) for c in ("c1", "c2", "c9") for a, b in ((0, 5), (3, 40), (70, 95), (6, 7), (9, 9), (12, 4), (200, 210), (-4, 6)) for r in (False, True)]
    for r in genome.slices(spark.createDataFrame(asked, "chr string, start bigint, end bigint, reverse boolean"), table).collect():
        s = chromosomes.get(r.chr, "").upper()[r.start : r.end] if 0 <= r.start < r.end else ""
        s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if r.reverse else s
        assert r.seq == s + "N" * (max(0, r.end - r.start) - len(s)), r


def some_exons(rnd, n, columns):
    return [(rnd.choice(["up", "dn", "bg"]), k, rnd.choice(["c1", "c2"]), rnd.choice("+-."), *sorted(rnd.randint(300, 30_000) for _ in range(columns))) for k in range(n)]


@pytest.mark.parametrize("name", ["SE", "A3SS", "A5SS", "RI", "MXE"])
def test_overlap_sums(spark, name):
    kind, rnd, shape = EVENTS[name], random.Random(name), Shape(20, 60, 10, 4)
    exons = some_exons(rnd, 12, kind.coordinates)
    coords = spark.createDataFrame(exons, "grp string, exon_idx bigint, chr string, strand string, " + ", ".join(f"c{2 + k} bigint" for k in range(kind.coordinates)))
    spots = [c + rnd.randint(-80, 80) for e in exons for c in e[4:]]
    peaks = [(rnd.choice(["c1", "c2", "c3"]), max(1, s), max(1, s) + rnd.choice([0, 5, 40, 12_000]), rnd.randint(1, 9), k) for k, s in enumerate(spots * 2)]
    table = spark.createDataFrame(peaks, "chr string, p_start bigint, p_end bigint, height bigint, line bigint")
    unique = {(c, a, b): h for c, a, b, h, _ in peaks}
    wins = overlap.windows(coords, kind, shape)
    expected = {}
    for w in wins.collect():
        total = sum(h for (c, a, b), h in unique.items() if c == w.chr and a <= w.w_end and b >= w.w_start)
        if total:
            expected[(w.exon_idx, w.region, w.pos)] = total
    distinct = overlap.distinct_peaks(table)
    plain = {(r.exon_idx, r.region, r.pos): r.total for r in overlap.overlap_sum(wins, distinct, ["exon_idx", "region", "pos"]).collect()}
    spans = {(r.exon_idx, r.region, r.pos): r.total for r in overlap.region_overlap_sum(coords, distinct, kind, shape).collect()}
    assert plain == expected and spans == expected


def restated_scan(start, length, plus, window, step, bins, peaks):
    out, done, last, before = [0] * bins, [0] * bins, 100_000, False
    for o in range(length):
        at = int(o / length * bins)
        low = start + o * step if plus else start + length - 1 - o * step - window + 1
        seen = {}
        for chunk in (low // 10_000, (low + window - 1) // 10_000):
            for a, b, h in peaks:
                if a // 10_000 <= chunk <= b // 10_000 and a <= low + window - 1 and b >= low:
                    seen[(a, b)] = h
        for h in seen.values():
            if not done[at]:
                if not before:
                    out[at] += h
                elif plus:
                    for j in range(last + 1, at + 1):
                        out[j] += h
            done[at] += 1
        before, last = bool(seen), at
    return out


def test_fisher():
    for a, b, c, d in itertools.product((0, 1, 3, 8), (0, 2, 7), (0, 1, 5), (0, 4)):
        row_, col, total = a + b, a + c, a + b + c + d
        if min(row_, col, total - row_, total - col) == 0:
            expected = 1.0
        else:
            expected = sum(math.comb(col, x) * math.comb(total - col, row_ - x) for x in range(a, min(row_, col) + 1)) / math.comb(total, row_)
        assert stats.fisher_greater(a, b, c, d) == pytest.approx(expected, abs=1e-12)
    assert stats.fisher_greater(8, 2, 1, 5) == pytest.approx(0.0244755, abs=1e-7)


def bars(x):
    v, c = np.unique(np.asarray(sorted(x), float), return_counts=True)
    return v, c.astype(float)


def test_rank_tests():
    rnd = random.Random(6)
    for _ in range(60):
        x, y = ([rnd.randint(0, 6) for _ in range(rnd.randint(2, 12))] for _ in range(2))
        u, mean, _, _ = stats.mann_whitney_parts(*bars(x), *bars(y))
        assert u == sum((a > b) + 0.5 * (a == b) for a in x for b in y) and mean == len(x) * len(y) / 2
        z = sorted(x + y)
        rank = lambda v, w: sum(q < v for q in w) + (sum(q == v for q in w) + 1) / 2
        mx, my = np.mean([rank(v, z) for v in x]), np.mean([rank(v, z) for v in y])
        sx = sum((rank(v, z) - rank(v, x) - mx + (len(x) + 1) / 2) ** 2 for v in x) / (len(x) - 1)
        sy = sum((rank(v, z) - rank(v, y) - my + (len(y) + 1) / 2) ** 2 for v in y) / (len(y) - 1)
        w = stats.brunner_munzel_statistic(*bars(x), *bars(y))
        assert w[1] == pytest.approx(len(x) * len(y) * (my - mx)) and w[2] == pytest.approx(len(z) * math.sqrt(len(x) * sx + len(y) * sy))
    # exact: 3 against 3 without ties
    pool = list(range(6))
    sums = [sum((a > b) for a in s for b in set(pool) - set(s)) for s in itertools.combinations(pool, 3)]
    for s in itertools.combinations(pool, 3):
        u = sum((a > b) for a in s for b in set(pool) - set(s))
        assert stats.mann_whitney_greater(*bars(s), *bars(set(pool) - set(s))) == pytest.approx(sum(k >= u for k in sums) / len(sums))
    assert stats.brunner_munzel_greater(*bars([1, 1]), *bars([0, 0]), True) == 1.0
    assert stats.brunner_munzel_greater(*bars([1, 1]), *bars([0, 0]), False) == 0.0


def test_permutation_and_names():
    first, second = np.array([3.0, 4.0, 5.0]), np.array([0.0, 1.0, 0.0, 1.0])
    rng = np.random.default_rng(5)
    reached = sum(np.mean((q := rng.permutation(np.r_[first, second]))[:3]) - np.mean(q[3:]) >= 3.5 for _ in range(60))
    assert stats.permutation_greater(first, second, 60, np.random.default_rng(5)) == (reached + 1) / 61
    assert [stats.method_name(x) for x in (None, " Fisher", "MannWhitney", "permutation", "other")] == ["fisher", "fisher", "mannwhitney_greater", "permutation_one_sided", "fisher"]


def test_histograms_equal_dense_values(spark):
    rnd = random.Random(3)
    dense = {g: [[rnd.choice([0, 0, 0, 1, 2]) for _ in range(n)] for _ in range(4)] for g, n in (("up", 9), ("dn", 11), ("bg", 15))}
    rows = [(g, 0, p, k, v) for g, d in dense.items() for p, values in enumerate(d) for k, v in enumerate(values) if v]
    counts = spark.createDataFrame(rows, "grp string, region int, pos int, exon_idx bigint, cnt bigint")
    sizes, cells = {"up": 9, "dn": 11, "bg": 15}, summary.grid(spark, [(0, 5)])
    for method, f in (("mannwhitney_greater", stats.mann_whitney_greater), ("brunnermunzel_greater", lambda *a: stats.brunner_munzel_greater(*a, True))):
        for r in summary.rank_test(summary.histograms(counts, cells, [], sizes), method, True).collect():
            for g in ("up", "dn"):
                one, two = (dense[x][r.pos] if r.pos < 4 else [0] * sizes[x] for x in (g, "bg"))
                assert r[f"p_{g}"] == pytest.approx(stats.bounded(f(*bars(one), *bars(two)), True))
    total = {r.pos: (r.up, r.p_up) for r in summary.fisher(summary.totals(counts, cells, []), sizes).collect()}
    assert total[4] == (0, 1.0) and total[0][0] == sum(dense["up"][0])
    lists = {r.pos: r["values"] for r in summary.value_lists(counts, cells, sizes, "up", []).collect()}
    assert lists[1] == "[" + ",".join(map(str, dense["up"][1])) + "]"
    for shared in (False, True):
        keyed = counts.withColumn("motif", F.lit("m")), summary.grid(spark, [(0, 5)], spark.createDataFrame([("m",)], "motif string"))
        got = {r.pos: r.p_up for r in summary.permutation_test(*keyed, ["motif"], sizes, 50, 7, shared).collect()}
        rng = np.random.default_rng(7)
        for p in range(5):
            one, two = (np.array(dense[x][p] if p < 4 else [0] * sizes[x], float) for x in ("up", "bg"))
            assert got[p] == stats.permutation_greater(one, two, 50, rng if shared else np.random.default_rng(7))


ISO = {
    "SE": ("c:101:200:{s}@c:301:400:{s}@c:501:600:{s}", "300 400 100 200 500 600", "300 400 500 600 100 200"),
    "A3SS": ("c:101:200:{s}@c:301|351:400:{s}", "300 400 350 400 100 200", "398 351 398 301 100 200"),
    "A5SS": ("c:101:150|200:{s}@c:301:400:{s}", "100 200 100 150 300 400", "149 101 199 101 300 400"),
    "RI": ("c:101-200:{s}@c:301-400:{s}", "100 400 100 200 300 400", "398 101 398 301 199 101"),
    "MXE": ("c:101:110:{s}@c:201:210:{s}@c:301:310:{s}@c:401:410:{s}", "200 210 300 310 100 110 400 410", "300 310 200 210 400 410 100 110"),
}


@pytest.mark.parametrize("name", list(ISO))
def test_isoform_conversion(spark, name):
    iso, plus, minus = ISO[name]
    rows = [["e", "0.3", "x", "x", "0.2", "x", "x", "0.1", bf, iso.format(s=s), "x", "0:12,1:7", "x", "1:3", "chr1", s, "x", "x"] for s, bf in (("+", "100"), ("-", "1"), ("+", "5"), (".", "5"))]
    got = [r.f for r in isoforms.convert(fields_of(spark, rows), EVENTS[name]).orderBy("line").collect()]
    width = EVENTS[name].coordinates
    assert got[0][5 : 5 + width] == plus.split() and got[1][5 : 5 + width] == minus.split() and len(got[3]) == len(got[0]) - width
    assert [x[-4] for x in got] == ["0.01", "1.0", "0.4", "0.4"] and got[0][-11:-7] == ["12", "7", "0", "3"]
    assert len(isoforms.header(EVENTS[name])) == len(got[0])
    bad = [*rows[0]]
    bad[11] = "2:5"
    with pytest.raises(Exception, match="isoform 0 or 1"):
        isoforms.convert(fields_of(spark, [bad]), EVENTS[name]).collect()


def test_exon_sets(spark):
    def exon(key, fdr, psi1, psi2, delta, fpkm="9"):
        return ["id", "g", "s", *key.split(":"), "1", "2", "3", "4", *["x"] * 8, fdr, psi1, psi2, delta, fpkm, "9", "a", "b", "c", "d"]

    rows = [exon("c:+:1:2", "0.01", "1", "1", "0.5"), exon("c:+:2:2", "0.01", "1", "1", "-0.5"), exon("c:+:3:2", "0.9", "NA", "0.9", "0"), exon("c:+:4:2", "0.9", "0.1", "0.9", "0", "5"), exon("c:+:1:2", "0.9", "0.1", "0.9", "0")]
    assert {(r.set, r.key, len(r.cols)) for r in isoforms.exon_sets(fields_of(spark, rows)).collect()} == {("dn", "c:+:2:2", 10), ("bg", "c:+:3:2", 10)}


def test_event_lists():
    assert list_supported_events() == ["SE", "A3SS", "A5SS", "RI", "MXE"] and event("ri").labels == ("R1", "R2", "R3", "R4", "R5")
    assert event_description("se") == "Skipped exon"
    with pytest.raises(ValueError):
        event("xx")
    loci = lambda clip, shape: [sum(n for _, n in motif.positions(e, shape, clip)) for e in EVENTS.values()]
    assert loci(False, Shape()) == [1200, 800, 800, 450, 1800] and loci(True, Shape(window=10)) == [1128, 728, 728, 405, 1692]


@pytest.mark.parametrize(("step", "window", "intron"), [(1, 10, 60), (1, 1, 60), (3, 10, 90), (2, 25, 300)])
def test_scaled_overlap(spark, step, window, intron):
    """Introns shorter and longer than the map, at chunk edges, with peaks that repeat, touch and overlap."""
    rnd, shape, kind = random.Random(step * 100 + window), Shape(30, intron, window, step), EVENTS["RI"]
    exons = [("up", k, "c1", rnd.choice("+-"), 0, 0, 900, a := rnd.choice([1000, 9_900]) + k, a + rnd.choice([0, 1, 5, 40, 120, 300, 500]), 99_999) for k in range(120)]
    coords = spark.createDataFrame(exons, "grp string, exon_idx bigint, chr string, strand string, " + ", ".join(f"c{2 + k} bigint" for k in range(6)))
    peaks = [(f"c{rnd.choice('112')}", s := rnd.choice([990, 9_890]) + rnd.randint(0, 630), s + rnd.choice([0, 6, 40]), rnd.randint(0, 9), k) for k in range(90)]
    peaks += [(*rnd.choice(peaks)[:3], rnd.randint(1, 9), 90 + k) for k in range(20)]
    table = spark.createDataFrame(peaks, "chr string, p_start bigint, p_end bigint, height bigint, line bigint")
    found = overlap.scaled_overlap(coords, table, kind, shape).collect()
    got = {(r.exon_idx, r.pos): r.total for r in found}
    assert len(got) == len(found) > 0
    bins, expected = next(n for (_, n), c in zip(motif.positions(kind, shape, True), kind.lengths) if c == "i"), {}
    for _, k, _, strand, _, _, _, c5, c6, _ in exons:
        totals = restated_scan(c5, c6 - c5 + 1, strand == "+", window, step, bins, [(a, b, h) for c, a, b, h, _ in peaks if c == "c1"])
        expected |= {(k, p): v for p, v in enumerate(totals) if v}
    assert got == expected
    with pytest.raises(ValueError, match="bases at most"):
        overlap.scaled_overlap(coords, table, kind, Shape(30, 300, 20_000, 1))


def test_retained_introns_end_to_end(spark):
    from spliceatlas.plans import maps

    rnd = random.Random(5)
    exons = [(g, k, "c1", rnd.choice("+-"), 0, 0, 500 + 40 * k, 600 + 40 * k, 760 + 40 * k, 900 + 40 * k) for k, g in enumerate(["up", "dn", "bg"] * 6)]
    coords = spark.createDataFrame(exons, "grp string, exon_idx bigint, chr string, strand string, " + ", ".join(f"c{2 + k} bigint" for k in range(6)))
    coords = coords.withColumn("c2", F.col("c4")).withColumn("c3", F.col("c7"))
    peaks = spark.createDataFrame([("c1", s, s + 8, rnd.randint(1, 9), k) for k, s in enumerate(rnd.randint(450, 1700) for _ in range(150))], "chr string, p_start bigint, p_end bigint, height bigint, line bigint")
    result = maps.clip_map(coords, peaks, "RI", Shape(20, 60, 10, 2))
    rows = result.tested.collect()
    assert len(rows) == 4 * 6 + 26 and {r.region for r in rows if r.up + r.dn + r.bg} == {0, 1, 2, 3, 4}


def interval_tables(spark, rnd, lengths, n=250):
    left = [(k, rnd.choice(["a", "b", None]), s, s + rnd.choice(lengths) - 1) for k in range(n) for s in [rnd.randint(-3000, 3000)]]
    right = sorted({(rnd.choice(["a", "b", None]), s, s + rnd.choice(lengths) - 1) for _ in range(n) for s in [rnd.randint(-3000, 3000)]}, key=str)
    return left, right, spark.createDataFrame(left, "k int, chr string, w_start bigint, w_end bigint"), spark.createDataFrame([(*r, 2, 9) for r in right], "chr string, p_start bigint, p_end bigint, height bigint, line bigint")


@pytest.mark.parametrize("most", [20_000, 3])
def test_intervals_of_any_length_meet_once(spark, most, monkeypatch):
    monkeypatch.setattr(overlap, "MOST_IN_BIN", most)  # 3: nearly every bin is split on both sides
    rnd = random.Random(most)
    left, right, one, two = interval_tables(spark, rnd, [1, 2, 20, 31, 32, 33, 64, 65, 500, 2500, 0, -3])
    got = sorted((r.k, r.chr, r.p_start, r.p_end) for r in overlap.overlapping(one, two).collect())
    assert got == sorted((k, c, a, b) for k, c, x, y in left for d, a, b in right if c == d and c and a <= y and b >= x)
    assert overlap.overlapping(one.limit(0), two).count() == overlap.overlapping(one, two.limit(0)).count() == 0


def test_bins_follow_the_lengths(spark):
    """Pairs that meet in a bin are at most about three times those that overlap, for short and for long intervals."""
    for length in (40, 700, 20_000):
        rnd = random.Random(length)
        left = [(k, "a", s, s + length - 1) for k in range(400) for s in [rnd.randint(0, 60 * length)]]
        right = [("a", s, s + length // 2) for _ in range(400) for s in [rnd.randint(0, 60 * length)]]
        one = overlap._binned(spark.createDataFrame(left, "k int, chr string, w_start bigint, w_end bigint"), F.col("w_start"), F.col("w_end"), [(length // 2).bit_length()])
        two = overlap._binned(spark.createDataFrame(right, "chr string, p_start bigint, p_end bigint"), F.col("p_start"), F.col("p_end"), [(length - 1).bit_length()])
        met = one.select("chr", "level", "bin").join(two.select("chr", "level", "bin"), ["chr", "level", "bin"]).count()
        found = sum(a <= y and b >= x for _, _, x, y in left for _, a, b in right)
        assert met <= 3.5 * found


def test_first_rows_of_many(spark, monkeypatch):
    from spliceatlas.operators import numbering

    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), "id")
    order = [F.col("a"), F.col("id")]
    expected = sorted((r.a, r.id) for r in rows.collect())[:300]
    for most in (10_000, 10):
        monkeypatch.setattr(numbering, "MOST_AT_ONCE", most)
        got = sorted((r.pos, r.a, r.id) for r in numbering.first_rows(rows, order, 300, "pos").collect())
        assert [g[1:] for g in got] == expected and [g[0] for g in got] == list(range(1, 301))
    assert numbering.first_rows(rows.limit(0), order, 300, "pos").count() == 0


def test_literals_of_expressions():
    assert motif.literals("[AC]G(T|A)") == {"AGT", "AGA", "CGT", "CGA"} and motif.literals("A{3}") == {"AAA"} and motif.literals("[A-C]{2}", 9) == {x + y for x in "ABC" for y in "ABC"}
    for other in ("A+", "A|CC", "[^A]", "^A", "A$", "(A)\\1", "A?", ".", "", "(?i)a", "[A-C]{3}x" * 9, r"\d", "A(?=C)"):
        assert motif.literals(other) is None, other


def test_scanning_together_equals_each_expression():
    rnd = random.Random(4)
    table = ["".join(rnd.choice(["A", "C", "G", "T", "[AC]", "[GT]", "[ACGT]", "[CT]"]) for _ in range(rnd.randint(1, 7))) for _ in range(60)] + ["A+C", "(AC|CA)G", "AA", "T{2}", "(C|CC)A", "é[AT]", "G$"]
    scan = motif._Scan(table)
    assert scan.automaton is not None and len(scan.single) == 3
    for n in (0, 1, 5, 80, 400, 3000):
        text = "".join(rnd.choice("ACGTACGTNé") for _ in range(n))
        for reach in (None, 60, 1600):
            got = {e: (size, at) for e, size, at in scan(text, reach) if at}
            expected = {}
            for e, rx in enumerate(table):
                found = list(re.finditer(rx, text))
                if found:
                    size = found[0].end() - found[0].start()
                    at = [m.start() for m in found if reach is None or (m.start() < reach and m.start() + size - 1 - n >= -reach)]
                    expected |= {e: (size, at)} if at else {}
            assert got == expected


def test_time_hardly_grows_with_motifs():
    rnd = random.Random(6)
    text = "".join(rnd.choice("ACGT") for _ in range(400_000))
    table = ["".join(rnd.choice(["A", "C", "G", "T", "[AC]"]) for _ in range(9)) for _ in range(114)]

    def seconds(expressions):
        scan, began = motif._Scan(expressions), time.process_time()
        assert sum(len(at) for _, _, at in scan(text, None)) > 0
        return time.process_time() - began

    few, many = (min(seconds(x) for _ in range(3)) for x in (table[:8], table))
    assert many < 4 * few


def test_fisher_in_the_jvm(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, n1), n1, rnd.randint(0, n2), n2) for hi in (3, 40, 900, 60_000, 3_000_000) for _ in range(60) for n1 in [rnd.randint(0, hi)] for n2 in [rnd.randint(0, hi)]]
    rows += [(0, 5, 0, 5), (5, 5, 5, 5), (5, 5, 0, 9), (0, 5, 9, 9), (7, 5, 3, 5), (1_000_000, 1_000_000, 0, 1_000_000)]
    df = spark.createDataFrame(rows, "a bigint, m bigint, c bigint, n bigint")
    for scale in (1, 10):
        tested = df.select("*", stats.fisher_column("a", "m", "c", "n", F.lit(scale)).alias("p"))
        assert "Python" not in tested._jdf.queryExecution().toString()
        for r in tested.collect():
            cells = [math.ceil(x / scale) for x in (r.a, max(0, r.m - r.a), r.c, max(0, r.n - r.c))]
            expected = 1.0 if not r.m or not r.n else stats.fisher_greater(*cells) if max(cells) < 100_000 else None
            assert expected is None and 0 <= r.p <= 1 or r.p == pytest.approx(expected, rel=1e-7, abs=1e-12), r
