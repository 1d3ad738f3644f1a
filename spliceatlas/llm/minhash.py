"""Near-duplicate detection by min-max hashing of word shingles, banding and exact confirmation.

Each permutation of the shingle hashes is evaluated once and gives two values, the minimum and the maximum, so 64
evaluations give 128 signature values. Bands take four values of four different permutations: a pair at a threshold of 0.8
shares none of the 32 bands with a probability of 5e-8, at 0.85 of 6e-11.

Equal sets collapse to one node first. The hub of a bucket is its smallest node, so the many buckets that a group of near copies
shares fall together into few groups of one hub, and a pair that meets in several bands is looked at once. Candidates are
compared in two rounds. Round one compares every member with its hubs and joins what is confirmed to components. Round two
looks at hubs whose members still are in several components: members fill blocks of bounded rows and bytes, a tile compares two
blocks by exact set intersections and only the edges that join components leave the task. Texts are sent once to
each tile; most groups are one tile. Blocks of one component are never compared with each other. Every candidate
pair of different components is decided on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import at_all_salts, components, salted
from ._store import Scratch, session_of, shuffle_partitions
from ._text import U64, buffers, give_back, mix64, ragged, rolling, slices, split_words, window_starts, word_hashes

ROWS, BANDS = 4, 32
PERMUTATIONS = ROWS * BANDS // 2
#: Most rows and bytes of text of a block (a longer text is a block of its own). A group of more than LEAST_ROWS rows is cut into
#: SHARES blocks before blocks grow, so that its tiles are compared side by side.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS, SHARES = 2048, 2 << 20, 160, 16
#: Text of the tiles that a task takes at once.
LOT_BYTES = 8 << 20
VERIFY_BYTES = 4 << 20
#: Pairs of one hub that are confirmed together.
HUB_PAIRS = 128
#: Groups that rows of one id are spread over.
SALTS = 16
_ODD = mix64(np.arange(101, 101 + PERMUTATIONS, dtype=U64)) | U64(1)
_ROW = mix64(np.arange(501, 501 + ROWS, dtype=U64)) | U64(1)
SIGNATURES = "id bigint, n bigint, size bigint, fp bigint, fp2 bigint, bands array<bigint>"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and n + 1 offsets. A text of fewer words than width has one."""
    words = split_words(texts)
    hashes, counts = word_hashes(words, lower=True), words.counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.r_[0, np.cumsum(sizes)]
    values = np.zeros(first[-1], U64)
    at = window_starts(counts, width)
    if len(at):
        owner = words.text_of[at]
        values[first[owner] + at - words.first[owner]] = rolling(hashes, width)[at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        values[first[i]] = rolling(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] ^ U64(int(counts[i]))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        values[lo:hi].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][sizes > 0]] = True
    return values[new], np.r_[0, np.cumsum(new)][first]


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                values, first = shingle_sets(part["text"], width)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes > 0)
                low, high = np.zeros((PERMUTATIONS, len(full)), U64), np.zeros((PERMUTATIONS, len(full)), U64)
                prints = np.zeros((2, len(sizes)), U64)
                if len(full):
                    at = first[:-1][full]
                    for k in range(PERMUTATIONS):
                        turned = values * _ODD[k]
                        low[k], high[k] = np.minimum.reduceat(turned, at), np.maximum.reduceat(turned, at)
                    for k in (0, 1):
                        prints[k, full] = np.add.reduceat(mix64(values + U64(k + 1)), at)
                signature = np.concatenate([low, high])
                keys = mix64((signature.reshape(BANDS, ROWS, -1) * _ROW[None, :, None]).sum(1, dtype=U64) + np.arange(BANDS, dtype=U64)[:, None] * U64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((sizes > 0) * BANDS)].astype(np.int32)), pa.array(keys.T.reshape(-1).view(np.int64)))
                size = np.diff(buffers(part["text"])[1])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(sizes, pa.int64()), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists], ["id", "n", "size", "fp", "fp2", "bands"])
            give_back()

    return run


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Pairs meet in groups by a; an a with many partners is spread over several."""
    total = pairs.count()
    groups = max(1, total * 2 * 4096 // VERIFY_BYTES, min(total, 2 * shuffle_partitions(scratch.spark)))
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > HUB_PAIRS)
    sized = salted(pairs, "b").join(at_all_salts(many), ["a", "salt"], "left")
    dealt = scratch.save(sized.select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b", F.lit(1)), F.ceil(F.col("c") / HUB_PAIRS))), F.lit(groups)).cast("int").alias("g")), f"{name}-dealt")
    wanted = dealt.select(F.col("g").alias("lot"), F.col("a").alias("id")).union(dealt.select("g", "b")).distinct()
    texts = docs.join(wanted.hint("merge"), "id").select("lot", "id", "text")

    def check(table: pa.Table, links: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                values, first = shingle_sets(part["text"], width)
                for i, k in enumerate(part["id"].to_pylist()):
                    sets.setdefault(k, []).append(values[first[i] : first[i + 1]])
        left, right = links["a"].to_pylist(), links["b"].to_pylist()
        good = [any(_linked(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ())) for a, b in zip(left, right, strict=True)]
        del sets
        give_back()
        return links.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return scratch.save(texts.groupBy("lot").cogroup(dealt.groupBy("g")).applyInArrow(check, "a bigint, b bigint"), f"{name}-links")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right.

    Members of many sets are counted by products of incidence matrices, the others by the pairs of sets they are in.
    """
    m, k = len(left), len(right)
    out = np.zeros((m, k), np.float32)
    size = np.array([len(x) for x in (*left, *right)])
    _, code, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m + k), size)
    common = count >= max(3, (m + k) // 16)
    if common.any():
        column = np.cumsum(common) - 1
        at = np.flatnonzero(common[code])
        at = at[np.argsort(column[code[at]], kind="stable")]
        columns, rows = column[code[at]], owner[at]
        for lo in range(0, int(columns[-1]) + 1, 1024):
            x, y = np.searchsorted(columns, [lo, lo + 1024])
            block = np.zeros((m + k, 1024), np.float32)
            block[rows[x:y], columns[x:y] - lo] = 1
            out += block[:m] @ block[m:].T
    at = np.flatnonzero(((count > 1) & ~common)[code])
    at = at[np.argsort(code[at], kind="stable")]
    codes, rows = code[at], owner[at]
    ours = rows < m
    tokens, a, b = codes[ours], rows[ours], rows[~ours] - m
    first, last = np.searchsorted(codes[~ours], tokens, "left"), np.searchsorted(codes[~ours], tokens, "right")
    for lo in range(0, len(tokens), 1 << 16):
        n = (last - first)[lo : lo + (1 << 16)]
        np.add.at(out.reshape(-1), np.repeat(a[lo : lo + (1 << 16)], n) * k + ragged(b, first[lo : lo + (1 << 16)], n), 1)
    return out


def _similar(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, of sizes left and right, are similar; some rows at a time."""
    out = np.empty(shared.shape, bool)
    for lo in range(0, len(left), 256):
        own = shared[lo : lo + 256].astype(np.int64)
        out[lo : lo + 256] = (100 + percent) * own >= percent * (left[lo : lo + 256, None] + right[None, :])
    return out


def _joining(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of ok that join components; left and right: component numbers of rows and columns."""
    _, number = np.unique(np.concatenate([left, right]), return_inverse=True)
    label, out = number.copy(), []
    for i in np.flatnonzero(ok.any(1)):
        near = np.flatnonzero(ok[i])
        roots, where = np.unique(label[len(left) + near], return_index=True)
        other = roots != label[i]
        if other.any():
            out += [(int(i), int(j)) for j in near[where[other]]]
            label[np.isin(label, roots[other])] = label[i]
    return out


def _tiles(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tiles, sides = table["tile"].to_numpy(), table["side"].to_numpy()
        order = np.lexsort((sides, tiles))
        edges = np.flatnonzero(np.r_[True, tiles[order][1:] != tiles[order][:-1], True])
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = table.take(pa.array(order[lo:hi])).combine_chunks()
            sets: list[np.ndarray] = []
            for batch in own.to_batches():
                for part in slices(batch, "text"):
                    values, first = shingle_sets(part["text"], width)
                    sets += [values[a:b].copy() for a, b in zip(first[:-1], first[1:], strict=True)]
            size = np.array([len(x) for x in sets], np.int64)
            ids, comps = own["id"].to_numpy(), own["comp"].to_numpy()
            cut = int((own["side"].to_numpy() == 0).sum())
            a, b = (slice(0, cut), slice(cut, None)) if 0 < cut < len(sets) else (slice(None), slice(None))
            ok = _similar(_intersections(sets[a], sets[b]), size[a], size[b], percent)
            ok &= comps[a][:, None] != comps[b][None, :]
            out += [(ids[a][i], ids[b][j]) for i, j in _joining(ok, comps[a], comps[b])]
            del sets, ok
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    Words are maximal runs outside space and 0x09-0x0D, with A-Z lowered; a set holds the distinct runs of `width` words, or
    the whole sequence of a shorter text. Returns id_col, n_shingles, component_id (smallest id reachable) and kept
    (id equals component_id), one row per input row. Null and blank texts have no shingles and are linked with nothing.
    The integer id names a document: rows that repeat an id are one document, linked to whatever any of them is
    linked to. percent is 80 or more. A null id is in no component: component_id null, kept true. Other columns are ignored; an
    empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    spark = session_of(docs)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(_signatures(width), SIGNATURES), "signed")
    named = signed.where("n > 0 and id is not null")
    nodes = scratch.save(named.groupBy("fp", "fp2").agg(F.min(F.struct("id", "size", "bands")).alias("s")).select("fp", "fp2", "s.*"), "nodes")
    members = nodes.select(F.explode("bands").alias("key"), "id", "size")
    hubs = members.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1").select("key", "hub")
    hubs = scratch.save(hubs, "hubs")  # a plain exchange in the join, so that Spark can split a common bucket
    seats = scratch.save(members.join(hubs, "key").where("id <> hub").groupBy("hub", "id").agg(F.max("size").alias("size")), "seats")

    # a row that repeats its id and set is compared once: such rows are looked for among the signatures, and are few or none
    again = scratch.save(named.groupBy("id", "fp", "fp2").agg(F.count("*").alias("c")).where("c > 1").select("id").distinct(), "again")
    if not again.isEmpty():
        docs = docs.join(again, "id", "left_anti").union(docs.join(again, "id", "left_semi").distinct())

    # Texts of candidates, once: the list of candidates grows with the corpus, so it is joined by a shuffle at every size.
    candidates = seats.select("id").union(seats.select("hub")).distinct()
    docs = scratch.save(docs.join(candidates.hint("merge"), "id"), "texts")

    links = _confirm(docs, seats.select(F.col("hub").alias("a"), F.col("id").alias("b")), width, percent, scratch, "stars")
    first = components(links, scratch, "first")

    # hubs have been compared with all their members; what is left are the members of different components
    placed = scratch.save(seats.join(first.withColumnRenamed("node", "id"), "id", "left").select("hub", "id", "size", F.coalesce("root", "id").alias("comp")), "placed")
    open_hubs = placed.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("hub")
    left = scratch.save(salted(placed, "id").join(at_all_salts(open_hubs), ["hub", "salt"]).drop("salt"), "left")

    # members of a component with many of them fill blocks of their own, the others mixed blocks
    shares = left.groupBy("hub", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    own = (F.col("c") >= min(LEAST_ROWS, BLOCK_ROWS)) | (F.col("size") >= BLOCK_BYTES // 2)
    shares = shares.withColumn("kind", F.when(own, F.col("comp")).otherwise(F.lit(-1)))
    count = F.greatest(F.least(F.ceil(F.sum("c") / LEAST_ROWS), F.lit(SHARES)), F.ceil(F.sum("c") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    kinds = scratch.save(shares.groupBy("hub", "kind").agg(count.alias("blocks")), "kinds")
    # only what is cut needs to be looked up: the common components and the groups of several blocks
    common = kinds.where("kind <> -1").select("hub", F.col("kind").alias("comp"), "blocks")
    several = kinds.where("kind = -1 and blocks > 1").select("hub", F.col("blocks").alias("mixed"))
    cut = salted(left, "id").join(at_all_salts(common), ["hub", "comp", "salt"], "left").join(at_all_salts(several), ["hub", "salt"], "left")
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", "mixed", F.lit(1))).cast("int").alias("block")
    cut = cut.select("hub", "id", "comp", "size", F.when(F.col("blocks").isNotNull(), F.col("comp")).otherwise(F.lit(-1)).alias("kind"), block)
    blocks = kinds.select("hub", "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    facing = blocks.select("hub", F.col("kind").alias("kind2"), F.col("block").alias("block2"))
    tiles = blocks.join(facing, "hub").where("(kind < kind2 or (kind = kind2 and block <= block2)) and (kind <> kind2 or kind = -1)")
    tile = F.xxhash64("hub", "kind", "block", "kind2", "block2").alias("tile")
    one, two = (F.struct(F.lit(k).alias("side"), F.col("kind" + x).alias("kind"), F.col("block" + x).alias("block")) for k, x in ((0, ""), (1, "2")))
    both = F.when(F.expr("kind <> kind2 or block <> block2"), F.array(one, two)).otherwise(F.array(one))
    sides = tiles.select(tile, "hub", F.explode(both).alias("s")).select("tile", "hub", "s.*")
    faced = scratch.save(cut.join(sides, ["hub", "kind", "block"]).select("tile", "side", "id", "comp", "size"), "faced")
    lots = max(2 * shuffle_partitions(spark), (faced.agg(F.sum("size")).first()[0] or 0) // LOT_BYTES)
    lot = F.pmod(F.xxhash64("tile"), F.lit(lots)).cast("int").alias("lot")
    tiled = scratch.save(docs.join(faced.hint("merge"), "id").select(lot, "tile", "side", "id", "comp", "text").groupBy("lot").applyInArrow(_tiles(width, percent), "a bigint, b bigint"), "tiled")

    roots = components(links.union(tiled), scratch, "all")
    # rows of one id and several texts are one document
    tops = nodes.select("fp", "fp2", F.col("id").alias("node")).join(roots, "node", "left").select("fp", "fp2", F.coalesce("root", "node").alias("top"))
    tops = scratch.save(tops, "tops")
    # the result reads signed and tops only
    scratch.drop("nodes", "again", "hubs", "seats", "texts", "placed", "left", "kinds", "faced", "tiled", "stars-dealt", "stars-links")
    found = signed.select("id", "n", "fp", "fp2").join(tops, ["fp", "fp2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("top", "id")).otherwise(F.col("id")).alias("top"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("top")).alias("component_id"), F.coalesce(F.col("id") == F.col("top"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the near-duplicates: of each component the document with the smallest id stays, once.

    Of rows that repeat an id the one with the longest text stays, ties to the smallest row. Rows with null ids all stay, and so do
    null and blank texts, which have no duplicates. All columns are kept, whatever their names; an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (F.spark_partition_id() % SALTS).alias("salt"), F.struct(*docs.columns).alias("row"))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).select(F.col(id_col).alias("id"), "kept").where("id is not null")
    found = found.groupBy("id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    found = Scratch(docs.sparkSession).save(found, "found")
    once = rows.join(found, "id", "left_anti")
    # of the rows of one id each salt keeps its best first
    salted = found.where("kept").select("id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    order = F.struct(-F.coalesce(F.length(F.col("row")[text_col]), F.lit(-1)), F.to_json("row"))
    best = rows.join(salted, ["id", "salt"]).select("id", "salt", "row", order.alias("order"))
    for by in (["id", "salt"], ["id"]):
        best = best.groupBy(*by).agg(F.min_by("row", "order").alias("row"), F.min("order").alias("order"))
    return once.select("row.*").union(best.select("row.*"))
