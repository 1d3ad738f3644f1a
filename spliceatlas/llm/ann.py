"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are rotated at random and projected to a few dimensions; each of several orderings puts the projections, shifted by
an offset of its own, on a Hilbert curve and sorts all rows by their keys (range-partitioned by Spark). A query's candidates are the
rows within a window around it in each ordering. Sorted rows fall into blocks; a query visits the blocks its windows touch,
is compared there with the rows of its window only, and the lists of all orderings merge to the final ranking, in double
precision on the original vectors.

Equal vectors are indexed once, by their smallest id, and searched once. A list of k + 1 vectors, each with its k + 1 smallest ids, holds
the best k rows for every copy that asks: lists are expanded by ids at the end, so that copies are found exactly.

The window is measured, not set: a bounded sample of queries (SAMPLE of them, those with the smallest hashes of their ids) is
compared with all rows, and the window is the smallest that holds TARGET of their neighbours in one ordering at least. Clusters
give windows of the size of a cluster, however many rows there are. Vectors without clusters, as random directions are, have
neighbours hardly nearer than the rest, and no ordering brings them close: there windows are a share of the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, session_of, shuffle_partitions
from ._vectors import best, matrix, usable

ORDERINGS, DIMENSIONS, BITS = 12, 4, 10
#: Queries that the window is measured by, the share of their neighbours that it holds, and the least of it.
SAMPLE, TARGET, LEAST_WINDOW = 256, 0.92, 256
BLOCK, STRIP = 8192, 128
#: Keys that are sorted in one partition.
KEYS = 1 << 20
#: Scores of products are taken to be right to this part of 1; what is nearer to the last place is compared exactly.
MARGIN = 1e-9
#: Rows that the sampled queries are compared with at once.
STEP = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (n by d, below 2**bits, d * bits at most 62)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & high) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _normal_share(z: np.ndarray) -> np.ndarray:
    """About the share of a normal distribution below z (logistic approximation): spreads projections over the grid."""
    return 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each id divisible by `every`, up to k other rows of largest inner product found: query_id, rank (from 1), vec_id, score.

    The score is the inner product in double precision; ties go to the smaller id. Rows with null ids, and
    vectors that are null, zero, empty or hold null or non-finite components take no part. Repeated ids count once, with
    their smallest vector. Vectors are compared with those of their own length, and each length has an index of its
    own; lengths of at most LEAST_WINDOW rows, which a window holds whole, are searched exhaustively together. Every row takes part. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = session_of(vectors)
    scratch = Scratch(spark)
    rows = scratch.save(usable(vectors, id_col, vector_col, zero=False), "rows")
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy("length").collect()
    long_lists = [r["length"] for r in lengths if r["count"] > LEAST_WINDOW]
    found = [_indexed(rows.where(F.size("v") == n), n, k, every, seed, _all_float(vectors, vector_col)) for n in long_lists]
    if len(found) < len(lengths) or not lengths:
        few = rows.where(~F.size("v").isin(long_lists)) if long_lists else rows
        found.append(few.groupBy(F.size("v").alias("length")).applyInArrow(_exhaustive(k, every), "query_id bigint, rank int, vec_id bigint, score double"))
    return reduce(DataFrame.union, found)


def _exhaustive(k: int, every: int):
    """Neighbours within a table of few rows of one length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, m = table["id"].to_numpy(), matrix(table["v"]).astype(float)
        asked = np.flatnonzero(ids % every == 0)
        scores = np.array([(m * m[q]).sum(1) for q in asked]).reshape(len(asked), len(ids))
        scores[np.arange(len(asked)), asked] = -np.inf
        row, column = best(scores, ids, k)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pa.table({"query_id": ids[asked[row]], "rank": pa.array(rank.astype(np.int32)), "vec_id": ids[column], "score": scores[row, column]})

    return run


def _indexed(rows: DataFrame, width: int, k: int, every: int, seed: int, single: bool) -> DataFrame:
    """Neighbours among rows of one length, by the orderings; single: components are single precision."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # Spark cuts a numbering with a limit before the shuffle, so a common vector travels as a few rows
    copies = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = scratch.save(copies.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")), "distinct")
    members = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").join(distinct.select("id", "v"), "v")
    members = scratch.save(members.select("query_id", "id"), "members")
    rows, total = distinct.select("id", "v"), distinct.count()

    def moments(batches):
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            m = matrix(batch["v"])
            if len(m):
                n, one, two = n + len(m), one + m.sum(0), two + (m * m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([one.tolist()]), pa.array([two.tolist()])], ["n", "one", "two"])

    # one row for each partition, summed pairwise; the result is as wide as a vector
    sums = rows.mapInArrow(moments, "n bigint, one array<double>, two array<double>").select("n", F.posexplode(F.arrays_zip("one", "two")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x.one").alias("one"), F.sum("x.two").alias("two")).orderBy("i").collect()
    n = np.array([max(r["n"], 1) for r in sums] or [1] * width, float)
    mean = np.array([r["one"] for r in sums] or [0.0] * width) / n
    spread = float(np.sqrt(max(np.mean(np.array([r["two"] for r in sums] or [1.0] * width) / n - mean**2), 1e-24)))
    dims = min(DIMENSIONS, width)
    random = np.random.default_rng(seed)
    turns = [np.linalg.qr(random.normal(size=(width, width)))[0][:, :dims] for _ in range(ORDERINGS)]
    shifts = random.uniform(0, 0.25, size=(ORDERINGS, dims))

    def keys(batches):
        for batch in batches:
            m = (matrix(batch["v"]) - mean) / spread if batch.num_rows else np.zeros((0, width))
            for o in range(ORDERINGS):
                cells = np.minimum((0.75 * _normal_share(m @ turns[o]) + shifts[o]) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.full(len(m), o, np.int32)), pa.array(hilbert_keys(cells, BITS))], ["id", "o", "key"])

    parts = max(shuffle_partitions(spark), ORDERINGS * total // KEYS)
    keyed = rows.mapInArrow(keys, "id bigint, o int, key bigint").repartitionByRange(parts, "o", "key", "id").sortWithinPartitions("o", "key", "id")
    keyed = scratch.save(keyed.select("id", "o", "key", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "keyed")
    # a row's place in its ordering: its index in its partition, less the rows of earlier orderings there, plus those of earlier partitions
    chunks = keyed.groupBy("o", "p").agg(F.count("*").alias("c"), F.min("i").alias("i0"))
    chunks = scratch.save(chunks.withColumn("ahead", F.coalesce(F.sum("c").over(Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("o", "p", "i0", "ahead"), "chunks")
    ranked = scratch.save(keyed.join(chunks, ["o", "p"]).select("id", "o", (F.col("i") - F.col("i0") + F.col("ahead")).alias("rank")), "ranked")
    queries = members.select("id").distinct().join(rows, "id")
    window = max(LEAST_WINDOW, _measured_window(rows, queries, ranked, k))
    v = F.transform("v", lambda x: x.cast("float")) if single else F.col("v")
    right = rows.select("id", v.alias("v")).join(ranked, "id").withColumn("b", F.floor(F.col("rank") / BLOCK).cast("int"))
    first, last = F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / BLOCK), F.floor(F.least(F.col("rank") + window, F.lit(max(total - 1, 0))) / BLOCK)
    left = queries.select("id", v.alias("v")).join(ranked, "id").withColumn("b", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    left = left.select(*[F.col(c).alias(c) for c in ("id", "v", "o", "rank", "b")])  # columns of their own, as both sides come from the same tables

    def visit(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and candidates.num_rows:
            queries, candidates = queries.sort_by("rank"), candidates.sort_by("rank")
            qi, ci = queries["id"].to_numpy(), candidates["id"].to_numpy()
            qr, cr = queries["rank"].to_numpy(), candidates["rank"].to_numpy()
            qm, cm = matrix(queries["v"]).astype(float), matrix(candidates["v"]).astype(float)
            lo = 0
            while lo < len(qi):
                # queries near each other in the ordering, so that their windows are nearly the same
                hi = min(lo + STRIP, int(np.searchsorted(qr, qr[lo] + max(window // 8, 1), "right")))
                a, b = np.searchsorted(cr, [qr[lo] - window, qr[hi - 1] + window + 1])
                row, column, exact = _nearest_of(qm[lo:hi], cm[a:b], ci[a:b], k + 1)
                out.append((qi[lo:hi], np.bincount(row, minlength=hi - lo), -exact, ci[a:b][column]))
                lo = hi
        asked_, sizes, minus, near = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        tops = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(minus), pa.array(near)], ["m", "i"]))
        return pa.table({"query_id": asked_, "o": pa.array(np.full(len(asked_), key[0].as_py(), np.int32)), "top": tops})

    # one short list for each query and block; larger scores first, then smaller ids
    tops = left.groupBy("o", "b").cogroup(right.groupBy("o", "b")).applyInArrow(visit, "query_id bigint, o int, top array<struct<m:double,i:bigint>>")
    for by in (["query_id", "o"], ["query_id"]):
        tops = tops.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k + 1).alias("top"))
    # vectors become rows: at most (k + 1)^2 for each list, and for each query all but itself
    wide = tops.select(F.col("query_id").alias("asking"), F.explode("top").alias("t")).select("asking", F.col("t.m").alias("m"), F.col("t.i").alias("id")).join(distinct.select("id", "ids"), "id")
    near = wide.select("asking", F.transform("ids", lambda i: F.struct(F.col("m").alias("m"), i.alias("i"))).alias("top")).groupBy(F.col("asking").alias("id")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top"))
    near = scratch.save(near, "near")  # a plain exchange in the join, so that Spark can split the queries of a common vector
    out = members.join(near, "id").select("query_id", F.slice(F.filter("top", lambda t: t["i"] != F.col("query_id")), 1, k).alias("top"))
    out = out.select("query_id", F.posexplode("top").alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.i").alias("vec_id"), (0 - F.col("t.m")).alias("score"))


def _nearest_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (query, row) of each query's k best rows, and their scores summed in one order, by score and then smaller id."""
    scores = queries @ rows.T
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        low = np.where(np.isfinite(cut), cut - MARGIN * np.maximum(1, np.abs(cut)), cut)
        row, column = np.nonzero(scores >= low[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, bool))
    exact = (queries[row] * rows[column]).sum(1)
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(queries)))[row] < k
    return row[keep], column[keep], exact[keep]


def _measured_window(rows: DataFrame, queries: DataFrame, ranked: DataFrame, k: int) -> int:
    """The window that holds TARGET of the k nearest rows of the sampled queries in the ordering where they are nearest."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded: SAMPLE vectors
    if not sample:
        return 0
    asked, matrix_ = np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample], float)

    def best_of_part(batches):
        held: list[list[tuple[float, int]]] = [[] for _ in asked]
        for batch in batches:
            m = matrix(batch["v"])
            for lo in range(0, len(m), STEP):
                row, column, exact = _nearest_of(matrix_, m[lo : lo + STEP], batch["id"].to_numpy()[lo : lo + STEP], k + 1)
                near = batch["id"].to_numpy()[lo : lo + STEP][column]
                for q in range(len(asked)):
                    own = row == q
                    held[q] = sorted(held[q] + list(zip((-exact[own]).tolist(), near[own].tolist(), strict=True)))[: k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array([[{"m": m, "i": i} for m, i in h] for h in held], pa.list_(pa.struct([("m", pa.float64()), ("i", pa.int64())])))], ["query_id", "top"])

    tops = rows.mapInArrow(best_of_part, "query_id bigint, top array<struct<m:double,i:bigint>>").withColumn("part", F.spark_partition_id() % 64)
    for by in (["query_id", "part"], ["query_id"]):
        tops = tops.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top"))
    near = tops.select("query_id", F.explode("top.i").alias("id")).where("id <> query_id")
    # at most SAMPLE times k + 1 pairs, each with ORDERINGS places
    own = ranked.select(F.col("id").alias("asking"), F.col("o").alias("o2"), F.col("rank").alias("at"))
    apart = near.join(ranked, "id").join(own, F.expr("query_id = asking and o = o2")).groupBy("query_id", "id").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("d"))
    found = sorted(r["d"] for r in apart.select("d").collect())
    return int(found[min(len(found) - 1, int(TARGET * len(found)))]) if found else 0


def _all_float(df: DataFrame, column: str) -> bool:
    """Whether components are single precision: they then travel as such and lose nothing."""
    return df.schema[column].dataType.elementType.simpleString() == "float"
