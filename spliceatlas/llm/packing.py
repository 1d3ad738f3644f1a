"""Best-fit packing of tokenized documents into sequences of bounded length, by large-item matching.

Lengths are integers from 1 to the capacity, so the packing is planned over the histogram of lengths, of at most `capacity`
entries whatever the corpus: pieces above a third of the capacity are matched greedily, at most two to a
sequence, the longest with the longest that still fits; then shorter pieces, longest first, go into the smallest gap that
holds them. The plan is a short list of runs of equal sequences. A piece finds its place by its rank among the pieces of
its length; ranks come from counts of small groups that rows fall into by their number, so neither a common length nor repeated rows are
sorted in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, session_of, shuffle_partitions
from ._text import gathered
from .bpe import GROUP, encode_batch, vocabulary

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
GROUP_ROWS = 100_000


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and end_id, cut into pieces of at most `capacity` only where they are more. Null texts are empty: one
    piece, the end_id. Returns id_col, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids).

    Rows, repeated ones and null ids too, are cut independently; other columns are ignored; an empty table gives no pieces."""
    session_of(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in gathered(batches, GROUP):
            for lo, hi, ids, first in encode_batch(batch["text"], vocab):
                raw, rows = ids.astype("<u4").tobytes(), []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = raw[4 * a : 4 * b] + end
                    total = b - a + 1
                    for p in range(0, total, capacity):
                        rows.append((k, p // capacity, p, min(capacity, total - p), zlib.crc32(own[4 * p : 4 * (p + capacity)])))
                table = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo).take(pa.array(table[0])), pa.array(table[1].astype(np.int32)), *(pa.array(c) for c in table[2:])], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {PIECES}").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs of equal sequences: ([(length, how many in each sequence), ...], number of sequences), for counts by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    present = 0

    def put(gap: int, content: list[tuple[int, int]], number: int) -> None:
        nonlocal present
        gaps[gap].append((content, number))
        present |= 1 << gap

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if left[n] and left[m] and m <= n and n + m <= capacity:
                k = left[n] // 2 if m == n else min(left[n], left[m])
                if k:
                    left[n] -= k
                    left[m] -= k
                    put(capacity - n - m, [(n, 2)] if m == n else [(n, 1), (m, 1)], k)
        if left[n]:
            put(capacity - n, [(n, 1)], left[n])
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            fitting = present >> n
            if not fitting:
                each = capacity // n
                for number, k in ((left[n] // each, each), (1, left[n] % each)):
                    if number and k:
                        put(capacity - k * n, [(n, k)], number)
                left[n] = 0
                break
            gap = n + (fitting & -fitting).bit_length() - 1
            content, number = gaps[gap].pop()
            if not gaps[gap]:
                present &= ~(1 << gap)
            each = gap // n
            full = min(number, left[n] // each)
            rest = left[n] - full * each if full < number else 0
            rest = min(rest, each - 1)
            if full:
                put(gap - each * n, [*content, (n, each)], full)
            if rest:
                put(gap - rest * n, [*content, (n, rest)], 1)
            if number - full - (rest > 0):
                put(gap, content, number - full - (rest > 0))
            left[n] -= full * each + rest
    return [run for runs in gaps for run in runs]


def places(runs: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, sequence, each, offset): the pieces of that length and of ranks lo..hi-1 fill sequences from
    `sequence` on, `each` to one, from `offset` on."""
    out, used, sequence = [], {}, 0
    for content, number in runs:
        offset = 0
        for n, each in content:
            lo = used.get(n, 0)
            used[n] = lo + each * number
            out.append((n, lo, used[n], sequence, each, offset))
            offset += each * n
        sequence += number
    return out


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id_col, piece, start, length, ids_crc32).

    Every row, repeated ones included, gets a place of its own; null ids are allowed; an empty table stays empty.
    """
    spark = session_of(cut)
    scratch = Scratch(spark)
    cut = scratch.save(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")  # written, so a row keeps its number
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    groups = max(shuffle_partitions(spark), sum(counts.values()) // GROUP_ROWS)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "part").agg(F.count("*").alias("c")).select("length", "part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(id_col, "piece", "row")) - 1)
    ranked = ranked.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    # bounded: at most one row for each run and distinct length in it
    lookup = spark.createDataFrame(table, "length bigint, lo bigint, hi bigint, seq bigint, each bigint, off bigint")
    placed = ranked.join(F.broadcast(lookup), "length").where("rank >= lo and rank < hi")
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", F.expr("seq + (rank - lo) div each").alias("sequence_id"), F.expr("off + (rank - lo) % each * length").alias("offset"))
