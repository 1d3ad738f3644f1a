"""Exact substring deduplication by fixed-block anchors.

Any window of `window` words contains, wherever it starts, one whole block of ceil(window / 2) words that begins at a
multiple of the block length in its own text. So the non-overlapping reference blocks of all texts are indexed, every
rolling run of that length probes the index, and only windows around a hit can repeat. Hits are extended to whole windows,
equal extended windows are counted, and runs of repeated windows merge into maximal exact repeats.

No pairs are formed: index and probes travel as sorted, delta-friendly hash lists, once per group of texts and hash
bucket, with repeats inside a group counted before they are sent. A passage that a third of all texts share is
one entry per group. The texts are shuffled once and that exchange is reused by the three passes over them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import parts_for, session_of, shuffle_partitions
from ._text import U64, Words, give_back, rolling, slices, split_words, window_starts, word_hashes

GROUP_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
PACKED = "bucket int, gid int, high binary, low binary, second binary, flags binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("gid", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("second", pa.binary()), ("flags", pa.binary())])
_MASK40 = U64((1 << 40) - 1)


def _pack(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as a plane of high bytes, nearly constant and so compressible, and one of the low 24 bits."""
    raw = keys.view(np.uint8).reshape(-1, 8)
    return raw[:, 3:].T.tobytes(), raw[:, :3].T.tobytes()


def _unpack(high: bytes, low: bytes) -> np.ndarray:
    n = len(low) // 3
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :3] = np.frombuffer(low, np.uint8).reshape(3, n).T
    raw[:, 3:] = np.frombuffer(high, np.uint8).reshape(5, n).T
    return raw.reshape(-1).view(U64)


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PACKED)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _PACKED.types, strict=True)], schema=_PACKED)


def _lean(result: pa.Table) -> pa.Table:
    give_back()
    return result


def _ordered(keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys with their second hashes (if there are any), and where new ones begin in it."""
    order = np.lexsort((second, keys)) if len(second) else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    if len(second):
        new[1:] |= second[order][1:] != second[order][:-1]
    return order, np.flatnonzero(new)


def _send(gid: int, buckets: int, route: np.ndarray, keys: np.ndarray, second: np.ndarray, flags: np.ndarray) -> pa.Table:
    """One row for each bucket that gets keys; of equal keys one is sent, with bit 2 if there were several."""
    if not len(keys):
        return _table([])
    order, new = _ordered(keys, second)
    flags = np.bitwise_or.reduceat(flags[order], new) | (np.diff(np.r_[new, len(keys)]) > 1).astype(np.uint8) * np.uint8(2)
    at = order[new]
    bucket = (route[at] % U64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    at, flags, bucket = at[by], flags[by], bucket[by]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return _table([(int(bucket[lo]), gid, *_pack(keys[at[lo:hi]]), second[at[lo:hi]].tobytes() if len(second) else b"", flags[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])


def _seconds(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table["second"]), np.uint32)


def _repeated(table: pa.Table, need_block: bool) -> pa.Table:
    """For one bucket: each group's keys that occur at least twice, and, with need_block, once as a reference block."""
    keys = [_unpack(h.as_py(), x.as_py()) for h, x in zip(table["high"], table["low"], strict=True)]
    sizes = np.array([len(k) for k in keys])
    flat, second = np.concatenate(keys), _seconds(table)
    flags = np.frombuffer(b"".join(x.as_py() for x in table["flags"]), np.uint8)
    order, new = _ordered(flat, second)
    count = np.add.reduceat(1 + (flags[order] >> 1).astype(np.int64), new)
    good = count >= 2
    if need_block:
        good &= np.bitwise_or.reduceat(flags[order] & 1, new).astype(bool)
    hit = np.empty(len(flat), bool)
    hit[order] = np.repeat(good, np.diff(np.r_[new, len(flat)]))
    rows, edges = [], np.r_[0, np.cumsum(sizes)]
    for gid, k, lo, hi in zip(table["gid"].to_pylist(), keys, edges[:-1], edges[1:], strict=True):
        h = hit[lo:hi]
        if h.any():
            rows.append((0, gid, *_pack(k[h]), second[lo:hi][h].tobytes() if len(second) else b"", b""))
    return _lean(_table(rows))


def _hits(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and second hashes (if there are any) of all buckets, in order."""
    found = [_unpack(h.as_py(), x.as_py()) for h, x in zip(table["high"], table["low"], strict=True)]
    keys, second = np.concatenate(found) if found else np.zeros(0, U64), _seconds(table)
    order, _ = _ordered(keys, second)
    return keys[order], second[order] if len(second) else second


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys


def _among_both(keys: np.ndarray, second: np.ndarray, found: np.ndarray, found_second: np.ndarray) -> np.ndarray:
    """Which keys are among those found with their second hash."""
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    at = np.searchsorted(found, keys)
    while len(left):
        left = left[at[left] < len(found)]
        left = left[found[at[left]] == keys[left]]
        same = found_second[at[left]] == second[left]
        out[left[same]] = True
        left = left[~same]  # another window of the same first hash
        at[left] += 1
    return out


class _Runs:
    """Rolling anchors and windows of the texts of one slice that are long enough to hold a window."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = split_words(texts)
        self.block, self.window = (window + 1) // 2, window
        self.hashes = word_hashes(self.words)
        counts = self.words.counts
        self.long = np.repeat(counts >= window, counts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all rolling runs of a block's length, and their 64-bit hashes."""
        at = window_starts(self.words.counts, self.block)
        at = at[self.long[at]]
        return at, rolling(self.hashes, self.block)[at] if len(at) else np.zeros(0, U64)

    def windows(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows, or of those wanted (by start), their 64-bit hashes, and 32 bits of another hash of their words."""
        at = window_starts(self.words.counts, self.window)
        at = at if wanted is None else at[wanted[at]]
        if not len(at):
            return at, np.zeros(0, U64), np.zeros(0, np.uint32)
        other = rolling(word_hashes(self.words, other=True), self.window)[at] >> U64(32)
        return at, rolling(self.hashes, self.window)[at], other.astype(np.uint32)


def _texts(table: pa.Table, column: str):
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch, column):
            yield part


def cut_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with repeated words cut from the texts as remove_repeats finds them. A text that loses words becomes its
    remaining words joined by one space; the others stay verbatim, null ones included. length_col, if there is one, follows the text.
    Repeated rows are texts of their own and so lose their long passages; null ids are texts like others; an empty table stays empty."""
    rest = [c for c in docs.columns if c != text_col]
    found = remove_repeats(docs, window, id_col, text_col, carry=F.struct(*[F.col(c) for c in rest]))
    out = found.select(*[F.col("carried")[c].alias(c) for c in rest], F.col("kept").alias(text_col)).select(*docs.columns)
    if length_col in docs.columns:
        out = out.select(*[F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(c)).alias(c) if c == length_col else c for c in docs.columns])
    return out


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry=None) -> DataFrame:
    """Words covered by a window of `window` words whose sequence also starts elsewhere in docs are removed.

    Returns id_col, n_words, n_removed, kept (remaining words joined by one space) and repeats (array of start, end word
    offsets of the maximal repeats, end exclusive), one row per input row. Null and blank texts have no words and an
    empty kept text; texts shorter than a window lose nothing. Repeated rows, equal ids included, are texts of their own, so
    their long passages repeat. A null id stays null. Other columns are ignored. An empty table gives an empty result.
    Windows are compared by 96 bits: two independent hashes of the bytes of their words. With carry, a column to take
    along, the result is that column as `carried` and the text as `kept`, verbatim where nothing was removed.
    """
    spark, carried = session_of(docs), carry is not None
    least = 2 * shuffle_partitions(spark)
    slim = docs.select((F.col(id_col) if carry is None else carry).alias("id"), F.col(id_col).alias("route"), F.col(text_col).alias("text"))
    groups, buckets = parts_for(slim, GROUP_BYTES, least), parts_for(slim, BUCKET_BYTES, shuffle_partitions(spark))
    texts = slim.select(F.pmod(F.xxhash64("route", "text"), F.lit(groups)).cast("int").alias("gid"), "id", "text")

    def probe(table: pa.Table) -> pa.Table:
        gid, routes, blocks = table["gid"][0].as_py(), [], []
        for part in _texts(table, "text"):
            runs = _Runs(part["text"], window)
            at, keys = runs.anchors()
            routes.append(keys)
            blocks.append(((at - runs.words.first[:-1][runs.words.text_of[at]]) % runs.block == 0).astype(np.uint8) if len(at) else np.zeros(0, np.uint8))
        keys = np.concatenate(routes) >> U64(24)
        del routes
        return _lean(_send(gid, buckets, keys >> U64(8), keys, np.zeros(0, np.uint32), np.concatenate(blocks)))

    def extend(key, table: pa.Table, found: pa.Table) -> pa.Table:
        hits, out = _hits(found)[0], []
        if not len(hits) or not table.num_rows:
            return _PACKED.empty_table()
        for part in _texts(table, "text"):
            runs = _Runs(part["text"], window)
            at, keys = runs.anchors()
            sums = np.zeros(len(runs.hashes) + window + 1, np.int32)
            sums[at[_among(keys >> U64(24), hits)] + 1] = 1
            np.cumsum(sums, out=sums)
            out.append(runs.windows(sums[window - runs.block + 1 :] > sums[: len(sums) - (window - runs.block + 1)])[1:])
        keys, second = (np.concatenate(x) for x in zip(*out, strict=True))
        del out
        return _lean(_send(key[0].as_py(), buckets, keys, keys, second, np.zeros(len(keys), np.uint8)))

    def finish(key, table: pa.Table, found: pa.Table) -> pa.Table:
        (hits, second), out = _hits(found), []
        for part in _texts(table, "text"):
            runs = _Runs(part["text"], window)
            gone = np.zeros(len(runs.hashes) + 1, np.int32)
            if len(hits):
                at, keys, other = runs.windows()
                at = at[_among_both(keys, other, hits, second)]
                gone[at] += 1
                gone[at + window] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            made = _result(part["id"], runs.words, gone)
            out.append(pa.table({"carried": part["id"], "kept": pc.if_else(pc.greater(made["n_removed"], 0), made["kept"], part["text"].cast(pa.string()))}) if carried else made)
        return _lean(pa.concat_tables(out))

    id_type = slim.schema["id"].dataType.simpleString()
    probes = texts.groupBy("gid").applyInArrow(probe, PACKED)
    anchors = probes.groupBy("bucket").applyInArrow(lambda t: _repeated(t, True), PACKED)
    extended = texts.groupBy("gid").cogroup(anchors.groupBy("gid")).applyInArrow(extend, PACKED)
    repeats = extended.groupBy("bucket").applyInArrow(lambda t: _repeated(t, False), PACKED)
    shape = f"id {id_type}, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:bigint,end:bigint>>" if not carried else f"carried {id_type}, kept string"
    result = texts.groupBy("gid").cogroup(repeats.groupBy("gid")).applyInArrow(finish, shape)
    return result if carried else result.withColumnRenamed("id", id_col)


def _result(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
    n = len(words.first) - 1
    edges = np.zeros(len(gone) + 1, np.int64)
    edges[1:] = np.cumsum(gone)
    removed = edges[words.first[1:]] - edges[words.first[:-1]]
    # kept text: the bytes of kept words, each but a text's last with the byte after it made a space
    keep = np.flatnonzero(~gone)
    owner = words.text_of[keep]
    follow = np.r_[owner[1:] == owner[:-1], False] if len(keep) else np.zeros(0, bool)
    data = words.data.copy()
    data[words.end[keep[follow]]] = 0x20
    step = np.zeros(len(data) + 2, np.int8)
    step[words.start[keep]] += 1
    step[words.end[keep] + follow] -= 1
    kept = data[np.cumsum(step, dtype=np.int8)[: len(data)].astype(bool)]
    sizes = np.zeros(n, np.int64)
    np.add.at(sizes, owner, words.end[keep] - words.start[keep] + follow)
    texts = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(kept)])
    # spans: runs of removed words within a text
    first = np.zeros(len(gone) + 1, bool)
    first[words.first[:-1][words.counts > 0]] = True
    last = np.r_[first[1:], True][: len(gone)]
    begin = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | first[:-1])) if len(gone) else np.zeros(0, int)
    end = np.flatnonzero(gone & (np.r_[~gone[1:], True] | last)) + 1 if len(gone) else np.zeros(0, int)
    base = words.first[:-1][words.text_of[begin]] if len(begin) else begin
    spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first).astype(np.int32)), spans)
    return pa.table({"id": ids, "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": texts, "repeats": lists})
