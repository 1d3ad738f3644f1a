"""Command line: motif-map, clip-map, convert and exon-sets."""

from __future__ import annotations

import argparse
import io
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import stats
from .operators.classify import CLIP_A5SS_CUTS, CLIP_CUTS, MOTIF_CUTS, Cuts
from .operators.isoforms import convert, exon_sets, header
from .operators.motif import Shape, sequences
from .paths import user_path
from .plans import maps
from .sources import genome, sinks, text
from .specs import EVENTS, event


def _inputs(parser: argparse.ArgumentParser, window: int) -> None:
    parser.add_argument("event", choices=[e.lower() for e in EVENTS])
    parser.add_argument("--output", required=True)
    for name in ("events", "isoforms", "up", "down", "background"):
        parser.add_argument(f"--{name}", default=maps.MISSING)
    parser.add_argument("--label", default="RBP")
    parser.add_argument("--intron", type=int, default=250)
    parser.add_argument("--exon", type=int, default=50)
    parser.add_argument("--window", type=int, default=window)
    parser.add_argument("--step", type=int, default=1)
    parser.add_argument("--sig-fdr", type=float)
    parser.add_argument("--sig-delta-psi", type=float)
    parser.add_argument("--stat-method", default="fisher")
    parser.add_argument("--stat-permutations", type=int)
    parser.add_argument("--stat-seed", type=int)
    parser.add_argument("--plots", action="store_true", help="also draw the maps as SVG")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spliceatlas")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    motif = commands.add_parser("motif-map", help="count motifs around splice sites")
    _inputs(motif, 50)
    motif.add_argument("--known-motifs", required=True)
    motif.add_argument("--motifs", default=maps.MISSING)
    motif.add_argument("--fasta", required=True)
    motif.add_argument("--keep-tables", action="store_true", help="also write counts, p-values and sequences of all positions")
    clip = commands.add_parser("clip-map", help="sum peak heights around splice sites")
    _inputs(clip, 10)
    clip.add_argument("--peak", required=True)
    conversion = commands.add_parser("convert", help="isoform table to event table")
    conversion.add_argument("event", choices=[e.lower() for e in EVENTS])
    conversion.add_argument("--input", required=True)
    conversion.add_argument("--output", required=True)
    conversion.add_argument("--bayes-low", type=float, default=1)
    conversion.add_argument("--bayes-high", type=float, default=100)
    sets = commands.add_parser("exon-sets", help="up, down and background exons by expression")
    sets.add_argument("--input", required=True)
    sets.add_argument("--sample1", required=True)
    sets.add_argument("--sample2", required=True)
    sets.add_argument("--output", required=True)
    return top


def cuts_of(args: argparse.Namespace, analysis: str) -> Cuts:
    base = MOTIF_CUTS if analysis == "motif" else CLIP_A5SS_CUTS if args.event == "a5ss" else CLIP_CUTS
    fdr = base.sig_fdr if args.sig_fdr is None else args.sig_fdr
    delta = base.sig_delta if args.sig_delta_psi is None else args.sig_delta_psi
    if analysis == "clip":
        if "_" in args.label:
            raise ValueError("a label must not contain an underscore")
        if args.event in ("se", "a3ss", "a5ss") and not 0 <= fdr <= 1:
            raise ValueError("the false discovery rate must lie between 0 and 1")
    return Cuts(fdr, delta, base.bg_fdr, base.min_psi, base.max_psi)


#: Arguments that are paths.
PATHS = ("output", "events", "isoforms", "up", "down", "background", "known_motifs", "motifs", "fasta", "peak", "input")
LOG = logging.getLogger("spliceatlas")


def main(argv: list[str] | None = None) -> int:
    """Relative paths are taken from the folder the command is called from. A run is logged, at its end, in log.<command>.txt of its output folder."""
    args = parser().parse_args(argv)
    for name in PATHS:
        if getattr(args, name, None) is not None:
            setattr(args, name, user_path(getattr(args, name)))
    lines = io.StringIO()
    handler = logging.StreamHandler(lines)
    handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    LOG.info("start: %s", " ".join(sys.argv[1:] if argv is None else argv))
    spark = SparkSession.builder.appName(f"spliceatlas {args.command}").getOrCreate()
    try:
        code = _run(spark, args)
        LOG.info("end")
        return code
    except Exception:
        LOG.exception("failed")
        raise
    finally:
        LOG.removeHandler(handler)
        folder = args.output.rstrip("/").rpartition("/")[0] if args.command == "convert" else args.output
        sinks.write_text(spark, f"{folder}/log.{args.command}.txt", lines.getvalue())


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command in ("motif-map", "clip-map"):
        analysis = "motif" if args.command == "motif-map" else "clip"
        kind = event(args.event)
        coords = maps.load_coordinates(spark, kind, analysis, events=args.events, isoforms=args.isoforms, up=args.up, dn=args.down, bg=args.background, cuts=cuts_of(args, analysis))
        maps.write_coordinates(coords, kind, args.output)
        LOG.info("coordinates written")
        shape = Shape(args.exon, args.intron, args.window, args.step)
        how = {"method": args.stat_method, "permutations": args.stat_permutations, "seed": args.stat_seed}
        if analysis == "motif":
            motifs = text.read_motifs(spark, args.known_motifs)
            if maps.given(args.motifs):
                motifs = motifs.union(text.read_motifs(spark, args.motifs)).distinct()
            sequence = genome.read_fasta(spark, args.fasta)
            result = maps.motif_map(coords, sequence, motifs, kind.name, shape, **how)
            maps.write_motif_map(result, args.output, args.stat_method, args.keep_tables, args.plots)
            if args.keep_tables:
                sinks.write_fasta(sequences(coords, sequence, kind, shape).drop("reverse"), f"{args.output}/fasta")
        else:
            result = maps.clip_map(coords, text.read_peaks(spark, args.peak), kind.name, shape, **how)
            maps.write_clip_map(result, args.output, stats.method_name(args.stat_method), args.plots)
    elif args.command == "convert":
        kind = event(args.event)
        rows = convert(text.read_isoforms(spark, args.input), kind, args.bayes_low, args.bayes_high)
        sinks.write_lines(rows.orderBy("line").select(F.array_join("f", "\t").alias("\t".join(header(kind)))), args.output)
    else:
        found = exon_sets(text.fields(text.lines(spark, args.input)))
        for name, grp in ((f"highIn{args.sample1}", "up"), (f"highIn{args.sample2}", "dn"), ("background", "bg")):
            titles = ["GeneID", "geneSymbol", "chr", "strand", *header(event("se"))[5:11]]
            sinks.write_table(found.where(F.col("set") == grp).orderBy("first").select(*[F.get("cols", F.lit(k)).alias(t) for k, t in enumerate(titles)]), f"{args.output}/{name}.txt")
    return 0


if __name__ == "__main__":
    sys.exit(main())
