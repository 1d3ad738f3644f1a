"""Windows around splice sites and the interval join of windows with peaks.

Intervals meet by chromosome, level and bin, an equi-join, and an overlap test on what meets. The level of an interval is the least
power of two that holds its length, so it touches two bins of its level at most, and a pair meets at the higher of its two levels: bins
follow the lengths in the data, whatever they are. A pair that shares two bins is taken in the first of them, so no pass removes
duplicates. Bins with very many intervals are split on both sides.

Exons meet peaks by tiles: an exon goes once to each tile in which regions of it start, with these regions, and a peak to the tiles
whose regions may reach it, one or two; windows follow where they meet. Peaks of very many tiles take the way by levels. Scaled introns
meet stretches of starts of windows, made from the peaks, in tiles that are larger for longer introns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import steps_between
from ..specs import Event
from .motif import Shape, positions

#: Fixed value: windows see the peaks of the chunks of this many bases at their two ends; wider windows miss those between.
BIN = 10_000
#: Intervals shorter than two to the power of this share a level; and rows of one side of a bin that meet in one place.
LEAST_LEVEL, MOST_IN_BIN = 5, 20_000
#: Tiles hold two to the power of this bases at least; peaks of up to two to the power of MOST_TILES tiles are sent to each.
TILE_LEVEL, MOST_TILES = 12, 4
#: Scaled introns are scanned in tiles of two to the power of this starts of windows at least; tiles see two to the power of NEAR_BITS less on either side.
SCAN_LEVEL, NEAR_BITS = 10, 3


def distinct_peaks(peaks: DataFrame, keys: list[str] | None = None, order: str = "line") -> DataFrame:
    """One peak for each chromosome, start and end: of repeated ones the height of the last."""
    keys = keys or ["chr", "p_start", "p_end"]
    return peaks.groupBy(*keys).agg(F.max_by("height", order).alias("height"))


def _regions_of(coords: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, chr, by (from one window's start to the next's) and regions, an array of region, n (number of windows) and first (start of the first window)."""
    named = coords.select("*", *[F.expr(x).alias(n) for n, x in event.names.items()])
    lengths = {"e": shape.exon, "i": shape.intron}
    minus, plus = F.coalesce(F.col("strand") == "-", F.lit(False)), F.coalesce(F.col("strand") == "+", F.lit(False))
    parts = []
    for (k, n), letter in zip(positions(event, shape, clip=True), event.lengths, strict=True):
        if n < 1 or (event.name == "RI" and letter == "i"):
            continue
        start, end = F.expr(event.plus[k].format(**lengths)), F.expr(event.minus[k].format(**lengths))
        last = F.when(minus, end).otherwise(start + lengths[letter] - 1)
        parts.append(F.struct(F.lit(k).alias("region"), F.lit(n).alias("n"), F.when(plus, start).otherwise(last - shape.window + 1).alias("first")))
    by = F.when(plus, shape.step).otherwise(-shape.step)
    return named.select("grp", "exon_idx", "chr", by.alias("by"), F.array(*parts).alias("regions"))


def _regions(coords: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, chr, by and a row for each of the regions."""
    return _regions_of(coords, event, shape).select("grp", "exon_idx", "chr", F.explode("regions").alias("r"), "by").select("grp", "exon_idx", "chr", "r.*", "by")


def windows(coords: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, chr, region, pos, w_start, w_end (1-based, inclusive). The scaled region of retained introns is not among them.

    Regions follow the minus formulas on '-'; windows run from the region's end on every strand but '+'.
    """
    placed = _regions(coords, event, shape).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("first") + F.col("pos") * F.col("by")
    return placed.select("grp", "exon_idx", "chr", "region", "pos", start.alias("w_start"), (start + shape.window - 1).alias("w_end"))


def _level(lo: Column, hi: Column) -> Column:
    return F.greatest(F.length(F.bin(F.greatest(hi - lo, F.lit(0)))), F.lit(LEAST_LEVEL))


def _binned(df: DataFrame, lo: Column, hi: Column, levels: list[int]) -> DataFrame:
    """df with own (its level) and a row for each level and bin at which it can meet intervals of these levels."""
    first, last = F.least(lo, hi), F.greatest(lo, hi)
    higher = F.filter(F.array(*map(F.lit, levels)), lambda x: x > F.col("own"))
    at = F.when(F.col("own") >= min(levels), F.concat(F.array("own"), higher)).otherwise(higher)
    df = df.withColumn("own", _level(first, last)).withColumn("level", F.explode(at))
    low, high = F.call_function("shiftright", first, F.col("level")), F.call_function("shiftright", last, F.col("level"))
    return df.withColumn("low", low).withColumn("bin", F.explode(F.sequence("low", high)))


def overlapping(left: DataFrame, right: DataFrame, ends: tuple[str, str] = ("w_start", "w_end"), lengths: set[int] | None = None) -> DataFrame:
    """Pairs of rows of left (chr, interval `ends`) and right (chr, p_start, p_end) on one chromosome whose closed intervals overlap.

    An interval whose end lies before its start counts as the bases between, but overlaps only what holds start <= end of the other and end >= start.
    lengths: of the intervals on the left, where they are known; they are looked for otherwise.
    """
    lo, hi = (F.col(c) for c in ends)
    start, end = F.col("p_start"), F.col("p_end")
    levels = [] if lengths is None else [sorted({max(LEAST_LEVEL, (n - 1).bit_length()) for n in lengths})]
    for df, a, b in ((left, lo, hi), (right, start, end))[len(levels) :]:
        met = df.agg(F.collect_set(_level(F.least(a, b), F.greatest(a, b)))).first()[0]  # 64 levels at most
        levels.append(sorted(met) or [LEAST_LEVEL])
    one = _binned(left, lo, hi, levels[1]).withColumnsRenamed({"own": "own_l", "low": "low_l"})
    two = _binned(right.withColumnRenamed("chr", "chr_r"), start, end, levels[0]).withColumnsRenamed({"own": "own_r", "low": "low_r"}).withColumnRenamed("chr_r", "chr")
    met = _meet(one, two).where((F.col("level") == F.greatest("own_l", "own_r")) & (F.col("bin") == F.greatest("low_l", "low_r")) & (start <= hi) & (end >= lo))
    return met.drop("level", "bin", "own_l", "own_r", "low_l", "low_r")


def _meet(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of rows with equal chr, level and bin; bins of more than MOST_IN_BIN rows are split on both sides."""
    keys = ["chr", "level", "bin"]
    parts = [F.greatest(F.ceil(F.count_if(F.col("left") == here) / MOST_IN_BIN), F.lit(1)).cast("int").alias(n) for here, n in ((True, "parts_l"), (False, "parts_r"))]
    rows = one.select(*keys, F.lit(True).alias("left")).union(two.select(*keys, F.lit(False)))
    dense = rows.groupBy(*keys).agg(*parts).where("parts_l > 1 or parts_r > 1")
    if not dense.isEmpty():
        one, two = _split(one, dense, "l", "r"), _split(two, dense, "r", "l")
        keys += ["part_l", "part_r"]
    return one.join(two, keys).drop("parts_l", "parts_r", "part_l", "part_r")


def _split(df: DataFrame, dense: DataFrame, own: str, other: str) -> DataFrame:
    """A row of a dense bin goes to one part of its own side, and to all parts of the other's."""
    df = df.join(dense, ["chr", "level", "bin"], "left").fillna(1, ["parts_l", "parts_r"])
    df = df.withColumn(f"part_{own}", F.pmod(F.xxhash64(*df.columns), F.col(f"parts_{own}")).cast("int"))
    return df.withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1))).drop("parts_l", "parts_r")


def overlap_sum(wins: DataFrame, peaks: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Summed heights of the peaks that overlap each window: keys and total, windows without a peak left out.

    wins: keys, chr, w_start, w_end; peaks: chr, p_start, p_end, height. Windows see the peaks of the chunks of `width` bases at their
    two ends only, which are all their chunks unless they are wider than one.
    """
    met = overlapping(wins, peaks.select("chr", "p_start", "p_end", "height"))
    first, last = F.floor(F.col("p_start") / width), F.floor(F.col("p_end") / width)
    seen = F.floor(F.col("w_start") / width).between(first, last) | F.floor(F.col("w_end") / width).between(first, last)
    return met.where(seen).groupBy(*keys).agg(F.sum("height").alias("total"))


def region_overlap_sum(coords: DataFrame, peaks: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, region, pos, total of all plain regions: a region meets a peak once, and the windows a peak touches follow by arithmetic.

    So each peak is joined with an exon, not with each of its hundreds of windows.
    """
    return region_overlaps(coords, peaks, event, shape).groupBy("grp", "exon_idx", "region", "pos").agg(F.sum("height").alias("total"))


def region_overlaps(coords: DataFrame, peaks: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, region, pos, height: a row for each window of a plain region and peak that overlap. Sums that need no exons are taken from
    these rows, which are added up where they arise, instead of from sums of exons, which are shuffled."""
    peaks = peaks.select("chr", "p_start", "p_end", "height")
    reach = {(n - 1) * shape.step + shape.window for _, n in positions(event, shape, clip=True) if n > 0}
    level = max(TILE_LEVEL, *((n - 1).bit_length() for n in reach))
    length = F.greatest("p_start", "p_end") - F.least("p_start", "p_end")
    long = F.shiftright(length, level + MOST_TILES) > 0
    met = _by_tiles(coords, peaks.where(~long), event, shape, level, max(reach))
    out = _touched(met, shape)
    far = peaks.where(long)
    if far.isEmpty():
        return out
    last = F.col("first") + (F.col("n") - 1) * F.col("by")
    spans = _regions(coords, event, shape).select("grp", "exon_idx", "chr", "region", F.least("first", last).alias("lo"), (F.greatest("first", last) + shape.window - 1).alias("hi"), "n", "first", last.alias("last"))
    return out.unionByName(_touched(overlapping(spans, far, ("lo", "hi"), reach), shape))


def _by_tiles(coords: DataFrame, peaks: DataFrame, event: Event, shape: Shape, level: int, reach: int) -> DataFrame:
    """grp, exon_idx, region, n, first, last, p_start, p_end, height of the regions and peaks that overlap. Regions have `reach` bases at most."""
    spans = _regions_of(coords, event, shape)
    sizes = dict(positions(event, shape, clip=True))
    counts = F.array(*[F.lit(sizes[k]) for k in range(len(sizes))])
    here = F.transform("regions", lambda r: F.struct(r["region"].alias("region"), r["first"].alias("first"), F.least(r["first"], r["first"] + (r["n"] - 1) * F.col("by")).alias("lo"), (F.greatest(r["first"], r["first"] + (r["n"] - 1) * F.col("by")) + shape.window - 1).alias("hi")))
    one = spans.withColumn("here", here).withColumn("tiles", F.transform("here", lambda r: F.shiftright(r["lo"], level))).withColumn("bin", F.explode(F.array_distinct("tiles")))
    one = one.withColumn("own", F.filter("here", lambda r: F.shiftright(r["lo"], level) == F.col("bin")))
    bounds = F.array_min(F.transform("own", lambda r: r["lo"])).alias("lo"), F.array_max(F.transform("own", lambda r: r["hi"])).alias("hi")
    one = one.select("grp", "exon_idx", "chr", "by", F.lit(level).alias("level"), "bin", *bounds, F.transform("own", lambda r: F.struct(r["region"].alias("region"), r["first"].alias("first"))).alias("own"))
    start, end = F.col("p_start"), F.col("p_end")
    low, high = F.shiftright(F.least(start, end) - (reach - 1), level), F.shiftright(F.greatest(start, end), level)
    two = peaks.select("chr", start, end, "height", F.lit(level).alias("level"), F.explode(F.sequence(low, high)).alias("bin"))
    met = _meet(one, two).where((start <= F.col("hi")) & (end >= F.col("lo")))
    met = met.select("grp", "exon_idx", "by", start, end, "height", F.explode("own").alias("r")).select("grp", "exon_idx", "by", start, end, "height", "r.*")
    met = met.withColumn("n", F.element_at(counts, F.col("region") + 1)).withColumn("last", F.col("first") + (F.col("n") - 1) * F.col("by"))
    return met.where((start <= F.greatest("first", "last") + shape.window - 1) & (end >= F.least("first", "last")))


def _touched(met: DataFrame, shape: Shape) -> DataFrame:
    """grp, exon_idx, region, pos, height: the windows that a peak touches, of regions and peaks that overlap (n, first, last: the starts of the first and last window)."""
    s, w = shape.step, shape.window
    # window k covers [first + k s, first + k s + w - 1], or the same counted down from first
    up = F.col("last") >= F.col("first")
    low = F.when(up, F.ceil((F.col("p_start") - F.col("first") - (w - 1)) / s)).otherwise(F.ceil((F.col("first") - F.col("p_end")) / s))
    high = F.when(up, F.floor((F.col("p_end") - F.col("first")) / s)).otherwise(F.floor((F.col("first") + w - 1 - F.col("p_start")) / s))
    touched = steps_between(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.col("n") - 1).cast("int"))
    return met.select("grp", "exon_idx", "region", F.explode(touched).alias("pos"), "height")


def scaled_overlap(coords: DataFrame, peaks: DataFrame, event: Event, shape: Shape) -> DataFrame:
    """grp, exon_idx, region, pos, total of the scaled region of retained introns: peak heights along an intron of any length, folded to bins.

    Offsets 0..length-1 step along the intron, offset o belonging to bin floor(o / length * bins). Only the first offset of a bin whose
    window touches peaks counts, with the height of the first peak it sees: at this bin alone if the offset before touches none; else on
    the plus strand at all bins after that offset's, and on the minus strand at none. Peaks keep their file order in `line`; repeated
    intervals count once, in their first place with their last height; a window sees the peaks of its first chunk of BIN bases before others.
    An exon is a row of coords with its own grp and exon_idx.

    What a window sees depends on its start alone, so peaks are made into stretches of starts once, and an intron meets these: it goes to
    each tile in which windows of it start, a stretch to the tiles it lies in or near. A bin belongs to the tile of its first offset, and
    tiles hold eight bins of the intron at least, so all it needs is there and no exon is put together. In a run of touched offsets each
    stretch gives bins in a row with one height. Windows of more than BIN bases raise ValueError.
    """
    if shape.window > BIN:
        raise ValueError(f"windows of scaled regions have {BIN} bases at most")
    region, bins = next((k, n) for (k, n), letter in zip(positions(event, shape, clip=True), event.lengths, strict=True) if letter == "i")
    named = coords.select("grp", "exon_idx", "chr", "strand", *[F.expr(x).alias(n) for n, x in event.names.items()])
    plus = F.coalesce(F.col("strand") == "+", F.lit(False))
    spans = named.select("grp", "exon_idx", "chr", plus.alias("plus"), F.col("uE").cast("bigint").alias("a"), (F.col("dS") - F.col("uE")).cast("bigint").alias("n")).where((F.col("n") > 0) & F.lit(bins > 0))
    s, w = shape.step, shape.window
    plus, n, level, bin_ = F.col("plus"), F.col("n"), F.col("level"), F.col("bin")
    most = F.ceil(n / max(bins, 1))  # offsets of a bin
    # origin: start of the window of offset 0; those of offset o start o steps on, on the minus strand back
    origin = F.when(plus, F.col("a")).otherwise(F.col("a") + n - w)
    spans = spans.select("grp", "exon_idx", "chr", "plus", "n", origin.alias("origin"), F.greatest(F.length(F.bin((most + 2) * s)) + NEAR_BITS, F.lit(SCAN_LEVEL)).alias("level"))
    origin = F.col("origin")
    final = origin + F.when(plus, n - 1).otherwise(1 - n) * s
    low, high = (F.call_function("shiftright", x, level) for x in (F.least(origin, final), F.greatest(origin, final)))
    places = spans.withColumn("bin", F.explode(F.sequence(low, high)))
    seen = _seen(places, peaks, w)

    def bin_of(o: Column) -> Column:
        return F.floor(o.cast("double") / n * bins).cast("int")

    up, down = (lambda x: F.ceil(x / s)), (lambda x: F.floor(x / s))
    least, last = F.call_function("shiftleft", bin_, level), F.call_function("shiftleft", bin_ + 1, level) - 1
    one = F.greatest(F.when(plus, up(least - origin)).otherwise(up(origin - last)), F.lit(0))
    two = F.least(F.when(plus, down(last - origin)).otherwise(down(origin - least)), n - 1)
    seen = seen.withColumns({"one": one, "two": two})
    # bins that begin at these offsets, or are passed over there
    seen = seen.withColumns({"from": F.when(F.col("one") > 0, bin_of(F.col("one") - 1) + 1).otherwise(0), "to": bin_of(F.col("two"))})
    one, two = F.greatest(F.col("one") - 1, F.lit(0)) * s, F.least(F.col("two") + most + 1, n - 1) * s
    seen = seen.withColumns({"least": origin + F.when(plus, one).otherwise(-two), "last": origin + F.when(plus, two).otherwise(-one)})
    least, last = F.col("least"), F.col("last")

    def here(r: Column) -> Column:
        found = (r["hi"] >= least) & (r["lo"] <= last)
        return found if s == 1 else found & (up(F.greatest(r["lo"], least) - origin) <= down(F.least(r["hi"], last) - origin))

    seen = seen.select("grp", "exon_idx", "plus", "n", "origin", "from", "to", "least", "last", F.filter("seen", here).alias("near"))
    # outer, as Spark would work out the lists, and below the bins, once more to leave out empty ones
    runs = seen.select("*", F.posexplode_outer("near").alias("i", "r"))
    low, high = up(F.greatest(F.col("r.lo"), least) - origin), down(F.least(F.col("r.hi"), last) - origin)
    prev = F.when(plus, down(F.get("near", F.col("i") - 1)["hi"] - origin)).otherwise(-up(F.get("near", F.col("i") + 1)["lo"] - origin))
    runs = runs.select("grp", "exon_idx", "plus", "n", "from", "to", F.when(plus, low).otherwise(-high).alias("x"), F.when(plus, high).otherwise(-low).alias("y"), prev.alias("prev"), "r.height").where("height <> 0")
    x, y, prev = F.col("x"), F.col("y"), F.col("prev")
    done = F.coalesce(bin_of(prev), F.lit(-1)) + 1
    begin = F.when(prev == x - 1, F.when(plus, done).otherwise(bins)).otherwise(F.greatest(bin_of(x), done))
    runs = runs.withColumns({"from": F.greatest(begin, "from"), "to": F.least(bin_of(F.when(plus, y).otherwise(x)), "to")})
    touched = F.when(F.col("from") <= F.col("to"), F.sequence("from", "to"))
    return runs.select("grp", "exon_idx", F.lit(region).alias("region"), F.explode_outer(touched).alias("pos"), F.col("height").cast("bigint").alias("total")).where("pos is not null")


def _seen(places: DataFrame, peaks: DataFrame, w: int) -> DataFrame:
    """places (chr, level, bin: a tile of starts of windows) with seen, the sorted stretches in or near the tile; places that see nothing are left out.

    Lists are bounded by the bases of a tile, whatever lies there; the places of a tile are split where they are many.
    """
    keys = ["chr", "level", "bin"]
    tally = places.groupBy(*keys).agg(F.count("*").alias("n"))
    levels, most = tally.agg(F.sort_array(F.collect_set("level")), F.max("n")).first()  # 64 levels at most
    low, high = F.col("lo"), F.col("hi")

    def tiles(k: int) -> Column:
        reach = 1 << (k - NEAR_BITS)
        return F.transform(F.sequence(F.shiftright(low - reach, k), F.shiftright(high + reach, k)), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin")))

    at = [tiles(k) for k in levels or [SCAN_LEVEL]]
    stretches = _stretches(_marks(peaks, w, tally)).select("chr", low, high, "height", F.explode(F.concat(*at)).alias("at"))
    lists = stretches.groupBy("chr", "at.level", "at.bin").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "height"))).alias("seen"))
    if (most or 0) > MOST_IN_BIN:
        dense = tally.select(*keys, F.ceil(F.col("n") / MOST_IN_BIN).cast("int").alias("parts_l"), F.lit(1).alias("parts_r")).where("parts_l > 1")
        places, lists = _split(places, dense, "l", "r"), _split(lists, dense, "r", "l")
        keys += ["part_l", "part_r"]
    return places.join(lists, keys).drop("part_l", "part_r")


def _marks(peaks: DataFrame, w: int, tally: DataFrame) -> DataFrame:
    """chr, lo, hi, peak: each peak with the starts of the windows that touch it, in parts if it is first in its chunk for some only (the least `peak`
    at a start is the first). Peaks of very many tiles come cut to the tiles of tally, or what lies near them."""
    once = peaks.where("p_start is not null and p_end is not null").groupBy("chr", "p_start", "p_end").agg(F.max_by("height", "line").alias("height"), F.min("line").alias("line"))
    start, end = F.col("p_start").cast("bigint"), F.col("p_end").cast("bigint")
    chunk = start - F.pmod(start, F.lit(BIN))
    part = lambda far, lo, hi: F.struct(F.lit(far).alias("far"), lo.alias("lo"), hi.alias("hi"))
    parts = F.filter(F.array(part(False, F.greatest(start - w + 1, chunk), end), part(True, start - w + 1, F.least(end, chunk - 1))), lambda r: r["lo"] <= r["hi"])
    marks = once.select("chr", "line", "height", F.explode(parts).alias("r")).select("chr", "r.lo", "r.hi", F.struct("r.far", "line", "height").alias("peak"))
    long = lambda length: F.shiftright(length, SCAN_LEVEL + MOST_TILES) > 0
    if peaks.where(long(end - start + w)).isEmpty():
        return marks
    first, reach = F.call_function("shiftleft", F.col("bin"), F.col("level")), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level") - NEAR_BITS)
    tiles = tally.select("chr", (first - reach).alias("w_start"), (F.call_function("shiftleft", F.col("bin") + 1, F.col("level")) - 1 + reach).alias("w_end"))
    far = overlapping(tiles, marks.where(long(F.col("hi") - F.col("lo"))).withColumnsRenamed({"lo": "p_start", "hi": "p_end"}))
    return marks.where(~long(F.col("hi") - F.col("lo"))).unionByName(far.select("chr", F.greatest("p_start", "w_start").alias("lo"), F.least("p_end", "w_end").alias("hi"), "peak"))


def _stretches(marks: DataFrame) -> DataFrame:
    """chr, lo, hi, height: stretches without common starts, each with the height of its least peak. Tiles of one size, whose lists hold different parts of a tile only."""
    low, high = F.col("lo"), F.col("hi")
    parts = marks.withColumn("tile", F.explode(F.sequence(F.shiftright(low, SCAN_LEVEL), F.shiftright(high, SCAN_LEVEL))))
    first = F.shiftleft("tile", SCAN_LEVEL)
    parts = parts.select("chr", "tile", F.greatest(low, first).alias("lo"), F.least(high, first + ((1 << SCAN_LEVEL) - 1)).alias("hi"), "peak")
    lists = parts.groupBy("chr", "tile", "lo", "hi").agg(F.min("peak").alias("peak")).groupBy("chr", "tile").agg(F.collect_list(F.struct("lo", "hi", "peak")).alias("parts"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("parts", lambda r: r["lo"]), F.transform("parts", lambda r: r["hi"] + 1))))
    least = lambda c: F.array_min(F.transform(F.filter("parts", lambda r: (r["lo"] <= c) & (r["hi"] >= c)), lambda r: r["peak"]))
    found = F.transform("cuts", lambda c, i: F.struct(c.alias("lo"), (F.get("cuts", i + 1) - 1).alias("hi"), least(c).alias("peak")))
    found = lists.withColumn("cuts", cuts).select("chr", F.explode(F.filter(found, lambda r: r["peak"].isNotNull())).alias("r"))
    return found.select("chr", "r.lo", "r.hi", "r.peak.height")
