"""Language-model scoring by Katz backoff over n-gram counts with Good-Turing discounts.

Texts are cut into units of a few MB, which are written once as dictionary and codes. Each unit asks for the training counts of its distinct
n-grams: keys go to buckets of the hash range, a bucket adds up what all units know and answers each of them, and keeps how
many n-grams occur once, twice and so on, from which the discounts follow. The answers are the table of n-gram counts, by bucket, level
and unit; one unit owns each n-gram of the training texts. Owners add up, for each history, the mass that the discounts free
and the mass that the next lower level gives to what was seen; both sums make the backoff weight, so that the probabilities of a
history, unknown words as one more outcome, add up to 1. Weights are written too. Tokens are then evaluated from the
highest level down: a seen n-gram ends the descent, an unseen one multiplies by its history's weight.

A key is one n-gram, so no bucket gathers a frequent word; histories are summed within lots of units before they meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, session_of, shuffle_partitions
from ._text import U64, gathered, give_back, mix64, split_words, word_hashes

#: Words of an n-gram at most. Every further level asks for nearly all of its n-grams, 8 bytes each.
ORDER = 2
#: Counts up to this are discounted by Good-Turing; larger ones lose TAIL, so that every history has mass for the unseen.
MOST, TAIL = 5, 0.01
#: Bytes of text of a unit, units of a lot, and keys of a bucket.
UNIT_BYTES, LOT_UNITS, BUCKET_KEYS = 6 << 20, 8, 2 << 20
END, *STARTS = mix64(np.arange(901, 911, dtype=U64))
_ODD = U64(0x9E3779B97F4A7C15)
#: Rows of texts (key: unit, level: place in it, a: tokens, b: known ones, x: base, y: score), of sums of a history (level, key, x: freed, y: covered) and of
#: descents from a history (level, key, a: unit, b: place, x: how often).
TEXT, SUMS, DESCENTS = range(3)
FOUND = "kind int, level int, key bigint, a bigint, b bigint, x double, y double"


def held_out(id_col: str, of: int = 10) -> Column:
    """Whether crc32 of the id as text is divisible by `of`; never for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == 0, F.lit(False))


def _packed(values: np.ndarray) -> bytes:
    """Bytes of like significance side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpacked(blob: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _packed(np.diff(keys, prepend=U64(0)))


def _unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, U64), dtype=U64)


def _units(batches):
    part, number = TaskContext.get().partitionId(), 0
    for batch in gathered(batches, UNIT_BYTES):
        words = split_words(batch["text"])
        tokens = np.insert(word_hashes(words, lower=True), words.first[1:], END)
        keys, codes = np.unique(tokens, return_inverse=True)
        sizes = (words.counts + 1).astype(np.int32)
        whole = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, batch[c]) for c in ("id", "held")]
        blobs = [pa.array([b], pa.binary()) for b in (_packed(sizes), _packed_keys(keys), _packed(codes.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([len(tokens)]), *lists, *blobs], ["unit", "tokens", "ids", "held", "sizes", "words", "codes"])
        number += 1
        give_back()


class _Unit:
    """The n-grams of a unit. For each level (from 0): keys, sorted; code of each token's n-gram; first place of each key; histories' keys."""

    def __init__(self, row: dict, order: int):
        self.sizes = _unpacked(row["sizes"], np.int32).astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        held = np.array(row["held"], bool)
        self.learned = np.repeat(~held, self.sizes)
        words, codes = _unpacked_keys(row["words"]), _unpacked(row["codes"], np.int32)
        tokens = words[codes]
        first = np.zeros(len(words), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.keys, self.codes, self.first, self.history = [words], [codes], [first], [None]
        grams = tokens
        for k in range(1, order):
            history = np.empty_like(grams)
            history[1:] = grams[:-1]
            history[self.start] = STARTS[k - 1]
            grams = mix64(history * _ODD + tokens)
            keys, first, codes = np.unique(grams, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.codes.append(codes.astype(np.int32))
            self.first.append(first)
            self.history.append(history)

    def learned_counts(self, level: int) -> np.ndarray:
        return np.bincount(self.codes[level][self.learned], minlength=len(self.keys[level]))


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of the hash range each key is in; sorted keys lie in consecutive parts."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _asked(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                unit = _Unit(row, order)
                del unit.history
                for level, keys in enumerate(unit.keys):
                    counts = unit.learned_counts(level).astype(np.int64)
                    edges = np.searchsorted(_buckets(keys, buckets), np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(edges))
                    for at in np.array_split(full, max(1, len(full) // 256)):
                        cuts = [slice(edges[b], edges[b + 1]) for b in at]
                        blobs = [pa.array([f(x[c]) for c in cuts], pa.binary()) for f, x in ((_packed_keys, keys), (_packed, counts))]
                        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), level, np.int32)), pa.array(np.full(len(at), row["unit"])), *blobs], ["bucket", "level", "unit", "keys", "counts"])
                del unit
            give_back()

    return run


def _answered(table: pa.Table) -> pa.Table:
    """For each unit, 2 * (count of all units) + (whether it owns the n-gram); and a row of statistics of the bucket for each level."""
    out = []
    for level in table["level"].unique().to_pylist():
        own = table.filter(pc.equal(table["level"], level)).sort_by("unit")
        keys = [_unpacked_keys(x) for x in own["keys"].to_pylist()]
        cuts, counts = np.cumsum([len(x) for x in keys])[:-1], np.concatenate([_unpacked(x, np.int64) for x in own["counts"].to_pylist()])
        _, code = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.zeros(int(code.max()) + 1, np.int64)
        np.add.at(total, code, counts)
        some = np.flatnonzero(counts)
        _, first = np.unique(code[some], return_index=True)
        values = 2 * total[code]
        values[some[first]] += 1
        bucket = own["bucket"][0].as_py()
        out += [(unit, level, bucket, _packed(x), None) for unit, x in zip(own["unit"].to_pylist(), np.split(values, cuts), strict=True)]
        total = total[total > 0]
        out.append((None, level, bucket, None, [*np.bincount(total[total <= MOST + 1], minlength=MOST + 2)[1:].tolist(), len(total), int(total.sum())]))
    give_back()
    columns = list(zip(*out, strict=True))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["unit", "level", "bucket", "counts", "stats"])


def discounts(often: list[int]) -> np.ndarray:
    """Factors d_1..d_MOST of counts, from how many n-grams occur once, twice, .. MOST + 1 times.

    Katz's form of Good-Turing; where that gives no factors between 0 and 1 (few data, or counts of many copies), each count loses one amount.
    """
    n = np.array(often, float)
    r = np.arange(1, MOST + 1)
    if n.min() > 0:
        common = (MOST + 1) * n[MOST] / n[0]
        if common < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
            if d.min() > 0 and d.max() < 1:
                return d
    return 1 - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5) / r


class Model:
    """Discounts and totals of each level; small, and sent with the functions that score."""

    def __init__(self, stats: list[list[int]]):
        self.factors = [discounts(s[: MOST + 1]) for s in stats]
        *often, self.types, self.tokens = stats[0]
        below = [k * c for k, c in enumerate(often[:MOST], 1)]
        lost = sum((1 - d) * c for d, c in zip(self.factors[0], below, strict=True)) + TAIL * (self.types - sum(often[:MOST]))
        #: Probability of an unknown word.
        self.unknown = lost / self.tokens if self.tokens else 1.0

    def kept(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Counts after the discount."""
        small = self.factors[level][np.clip(counts, 1, MOST) - 1] * counts
        return np.where(counts <= MOST, small, counts - TAIL)


def _scored(model: Model, order: int):
    def one(row: dict, answers: list[list[bytes]]) -> tuple[list[np.ndarray], list[tuple], list[tuple]]:
        unit = _Unit(row, order)
        values = [np.concatenate([_unpacked(b, np.int64) for b in blobs]) for blobs in answers]
        counts = [(v >> 1)[code] for v, code in zip(values, unit.codes, strict=True)]
        texts = counts[0][unit.start + unit.sizes - 1]  # of the end: how many texts were learned from
        before = [np.full(len(counts[0]), model.tokens)]
        for k in range(1, order):
            h = np.empty_like(counts[k - 1])
            h[1:] = counts[k - 1][:-1]
            h[unit.start] = texts
            before.append(h)
        log, todo, backs = np.zeros(len(counts[0])), np.arange(len(counts[0])), []
        doc_of = np.repeat(np.arange(len(unit.sizes)), unit.sizes)
        for k in range(order - 1, 0, -1):
            seen = counts[k][todo] > 0
            at = todo[seen]
            log[at] += np.log10(model.kept(k, counts[k][at]) / before[k][at])
            todo = todo[~seen]
            at = todo[before[k][todo] > 0]
            doc, key = doc_of[at], unit.history[k][at]
            by = np.lexsort((key, doc))
            doc, key = doc[by], key[by]
            new = np.flatnonzero(np.r_[len(doc) > 0, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else by
            backs.append((k, doc[new], key[new], np.diff(new, append=len(doc))))
        known = counts[0][todo] > 0
        at = todo[known]
        log[at] += np.log10(model.kept(0, counts[0][at]) / max(1, model.tokens))
        log[todo[~known]] += math.log10(model.unknown)
        base = np.log10((counts[0] + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        docs = [unit.sizes, np.add.reduceat((counts[0] > 0).astype(np.int64), unit.start), np.add.reduceat(base, unit.start), np.add.reduceat(log, unit.start)]
        parts = []
        for k in range(1, order):
            at = unit.first[k][(values[k] & 1) == 1]
            c, h = counts[k][at], before[k][at]
            parts.append((k, unit.history[k][at], (c - model.kept(k, c)) / h, model.kept(k - 1, counts[k - 1][at]) / before[k - 1][at]))
        return docs, backs, parts

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        blobs: dict[int, list[list[bytes]]] = {}
        for u, level, blob in zip(*(answers.sort_by([("unit", "ascending"), ("bucket", "ascending")])[c].to_pylist() for c in ("unit", "level", "counts")), strict=True):
            blobs.setdefault(u, [[] for _ in range(order)])[level].append(blob)
        out, sums = [], []
        for k in range(units.num_rows):
            row = units.slice(k, 1).to_pylist()[0]
            u = row["unit"]
            docs, backs, parts = one(row, blobs.pop(u))
            n = len(docs[0])
            out.append(_rows(n, TEXT, np.arange(n), np.full(n, u), docs[0], docs[1], docs[2], docs[3]))
            for level, doc, key, times in backs:
                out.append(_rows(len(key), DESCENTS, level, key, np.full(len(key), u), doc, times, 0))
            sums = [_summed([a, b]) for a, b in zip(sums, parts, strict=True)] if sums else [_summed([p]) for p in parts]
            give_back()
        for level, key, freed, covered in sums:
            out.append(_rows(len(key), SUMS, level, key, 0, 0, freed, covered))
        return pa.concat_tables(out)

    return run


def _summed(parts: list[tuple]) -> tuple:
    keys, code = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    return (parts[0][0], keys, *(np.bincount(code, np.concatenate([p[j] for p in parts]), len(keys)) for j in (2, 3)))


_TYPES = (np.int32, np.int32, np.int64, np.int64, np.int64, np.float64, np.float64)


def _rows(n: int, *columns) -> pa.Table:
    """A table of FOUND; numbers are the same in all rows."""
    columns = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == U64 else c for c in columns]
    filled = [np.full(n, c, t) if np.isscalar(c) else c.astype(t, copy=False) for c, t in zip(columns, _TYPES, strict=True)]
    return pa.table([pa.array(c) for c in filled], [f.split(" ")[0] for f in FOUND.split(", ")])


def katz_scores(docs: DataFrame, held: Column | None = None, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Tokens are maximal runs outside space and 0x09-0x0D, with A-Z lowered, and one end. The model learns from the rows where
    `held` is not true; n_known counts tokens that occur there, train_tokens is their number N there, V how many differ. base_score is the
    sum of log10((c + 0.1) / (N + 0.1 (V + 1))), score the model's log10 probability of the text, an unknown word being one event. The first
    token's history is the start of the text.

    Null and blank texts are one end. Rows are texts of their own, repeated ones too and whatever their ids; a null id stays null.
    Texts of any length are read whole (a text is part of one unit, so it must fit in a task). Without training rows every
    token has probability 1. Other columns are ignored; an empty table gives an empty result. Words are compared by 64-bit hashes.
    """
    spark = session_of(docs)
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held if held is not None else F.lit(False), F.lit(False)).alias("held"))
    units = scratch.save(docs.mapInArrow(_units, f"unit bigint, tokens bigint, ids array<{kind}>, held array<boolean>, sizes binary, words binary, codes binary"), "units")
    number, tokens = units.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = max(2 * shuffle_partitions(spark), tokens * order // BUCKET_KEYS)
    asked = units.select("unit", "held", "sizes", "words", "codes").mapInArrow(_asked(order, buckets), "bucket int, level int, unit bigint, keys binary, counts binary")
    counts = scratch.save(asked.groupBy("bucket").applyInArrow(_answered, "unit bigint, level int, bucket int, counts binary, stats array<bigint>"), "counts")
    sums = [F.sum(F.col("stats")[j]) for j in range(MOST + 3)]
    stats = {r[0]: list(r[1:]) for r in counts.where("stats is not null").groupBy("level").agg(*sums).collect()}  # one row for each level
    model = Model([stats.get(k, [0] * (MOST + 3)) for k in range(order)])
    lot = F.pmod(F.xxhash64("unit"), F.lit(max(min(number, shuffle_partitions(spark)), number // LOT_UNITS, 1))).cast("int")
    left = units.select(lot.alias("lot"), "unit", "held", "sizes", "words", "codes").groupBy("lot")
    right = counts.where("unit is not null").select(lot.alias("lot"), "unit", "level", "bucket", "counts").groupBy("lot")
    found = scratch.save(left.cogroup(right).applyInArrow(_scored(model, order), FOUND), "found")

    left_open = F.sum("x") / (1 - F.sum("y"))
    weights = scratch.save(found.where(F.col("kind") == SUMS).groupBy("level", "key").agg(F.log10(left_open).alias("weight")), "weights")
    backed = F.sum(F.col("x") * F.col("weight")).alias("backed")
    backs = found.where(F.col("kind") == DESCENTS).join(weights.hint("merge"), ["level", "key"]).groupBy(F.col("a").alias("unit"), F.col("b").cast("int").alias("at")).agg(backed)
    ids = units.select("unit", F.posexplode(F.arrays_zip("ids", "held")).alias("at", "d")).select("unit", "at", F.col("d.ids").alias(id_col), F.col("d.held").alias("held_out"))
    texts = found.where(F.col("kind") == TEXT).select(F.col("key").alias("unit"), F.col("level").alias("at"), F.col("a").alias("n_tokens"), F.col("b").alias("n_known"), F.col("x").alias("base_score"), F.col("y").alias("score"))
    rows = ids.join(texts, ["unit", "at"]).join(backs, ["unit", "at"], "left")
    return rows.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"))
