"""Exact top-k search by integer inner product: tiles of query blocks and shards, and tree merging of partial lists.

Queries and candidates are dealt by hashes into blocks of bounded size; a tile multiplies one query block with one
shard and keeps each query's k best. Partial lists merge in rounds of at most FAN lists. Nothing is broadcast or collected. The products
are as many as queries times candidates, which an exact search over all rows needs; the rows moved are tiles times block size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, session_of
from ._vectors import best, matrix, usable

QUERY_BLOCK, SHARD, STRIP, FAN = 2048, 4096, 256, 8


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they are exact there, else in 64-bit or, at last, unbounded integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    if bound < 2**63:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in candidates], object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _floored(x: Column) -> Column:
    """floor of a double, as a double. floor alone goes through 64-bit integers; from 2 to the 53rd on a double is whole anyway."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each id divisible by `every`, its k best other rows: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x), whatever their size (those that overflow a double then take no part); the score is their integer
    inner product (scores beyond 64 bits are held at the largest that fits); ties go to the smaller id. Rows with null ids, and vectors that are null, empty or hold null or
    non-finite components take no part; zero vectors do. Repeated ids count once, with their smallest vector. Vectors of
    other lengths than the query's are not its candidates. Fewer candidates give fewer ranks; none give none. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = session_of(vectors)
    scratch = Scratch(spark)
    rows = scratch.save(usable(vectors, id_col, vector_col).select("id", F.transform("v", lambda x: _floored(x * scale)).alias("v"), F.size("v").alias("d")).where(F.forall("v", lambda x: F.abs(x) != float("inf"))), "rows")
    total = rows.count()
    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = max(1, -(-total // SHARD))
    left = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for d in np.unique(queries["d"].to_numpy()):
            q, c = (t.filter(pa.compute.equal(t["d"], int(d))).sort_by("id") for t in (queries, candidates))
            qi, ci = q["id"].to_numpy(), c["id"].to_numpy()
            if not len(ci):
                continue
            qm, cm = matrix(q["v"]), matrix(c["v"])
            for lo in range(0, len(qi), STRIP):
                scores = _products(qm[lo : lo + STRIP], cm)
                low = np.iinfo(np.int64).min
                own = np.searchsorted(ci, qi[lo : lo + STRIP])
                mine = np.flatnonzero((own < len(ci)) & (ci[np.minimum(own, len(ci) - 1)] == qi[lo : lo + STRIP]))
                scores[mine, own[mine]] = low
                row, column = best(scores, ci, k)
                keep = scores[row, column] > low
                row, column = row[keep], column[keep]
                out.append((qi[lo + row], ci[column], scores[row, column]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": parts[0], "s": pa.array(np.full(len(parts[0]), key[1].as_py(), np.int32)), "vec_id": parts[1], "score": parts[2]})

    partial = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(tile, "query_id bigint, s int, vec_id bigint, score bigint")
    # larger scores first, then smaller ids
    lists = partial.groupBy("query_id", "s").agg(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("vec_id").alias("i"))).alias("top"))
    width = shards
    while True:
        width = -(-width // FAN)
        lists = lists.groupBy("query_id", F.floor(F.col("s") / FAN).cast("int").alias("s")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if width <= 1:
            break
    out = lists.select("query_id", F.posexplode("top").alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.i").alias("vec_id"), (-F.col("t.m")).alias("score"))
