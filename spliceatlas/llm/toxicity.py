"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and their stems, pairs of neighbours and pairs that skip one or two words of a text, hashed
into 2**20 slots. Training
takes a bounded sample of labelled rows, the same for any order and partitioning of the input, in one task; FTRL keeps a
learning rate for each coordinate and its L1 term leaves few weights, which are sent to all tasks with the
scoring function (bounded by the number of slots).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import session_of
from ._text import U64, Words, give_back, mix64, slices, split_words, window_starts, word_hashes

SLOTS = 1 << 20
#: Bound on the labelled rows that are learned from: those with the smallest hashes of their ids.
TRAINING_ROWS = 16_000
SKIPS = (1, 2, 3)
#: Bytes of text whose features are held at once; they take about fifty times as much.
PART = 1 << 20
#: Longer words also count by their first bytes, so that inflected forms share features.
STEMS = (4, 5, 6, 7, 8)
EPOCHS, ALPHA, BETA, L1, L2 = 6, 1.0, 1.0, 8.0, 0.0
#: Texts are split at anything in ASCII that is neither letter nor digit.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features, repeated ones too, and the text each belongs to."""
    words = split_words(texts, SEPARATORS)
    hashes, owner = word_hashes(words, lower=True), words.text_of
    slots, owners = [hashes], [owner]
    length = words.end - words.start
    for stem in STEMS:
        long = np.flatnonzero(length > stem)
        if len(long):
            cut = Words(words.data, words.start[long], words.start[long] + stem, words.first)
            slots.append(mix64(word_hashes(cut, lower=True) + U64(7)))
            owners.append(owner[long])
    for skip in SKIPS:
        at = window_starts(words.counts, skip + 1)
        if len(at):
            slots.append(mix64(hashes[at] * U64(3) + hashes[at + skip] * U64(5) + U64(skip)))
            owners.append(owner[at])
    return (np.concatenate(slots) & U64(SLOTS - 1)).astype(np.int64), np.concatenate(owners)


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    positive = float(labels.sum())
    bias, bias_n = np.log((positive + 0.5) / (len(labels) - positive + 4.5)), 1.0
    for _ in range(EPOCHS):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            bias_n += g * g
            bias -= ALPHA * g / np.sqrt(bias_n)
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias.

    Rows whose crc32(id as text) mod 5 is 0 are held out. Rows with a null id, label or text are left out; of repeated
    ids the largest label counts. Texts of any length are read whole, and count once each; the bound is on rows, so all features of the sample are held by one
    worker. Other columns are ignored. Without labelled rows there are no weights and a low bias.
    """
    session_of(docs)
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(wanted), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))  # an id counts once, so the bound holds

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "text", PART):
                slot, owner = features(part["text"])
                key = np.unique(owner * SLOTS + slot)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key // SLOTS, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array((key % SLOTS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part["id"], part["y"], lists], ["id", "y", "slots"])
                del slot, owner, key, lists
            give_back()

    def fit(batches):
        found = []
        for batch in batches:
            flat, at = batch["slots"].values.to_numpy(), batch["slots"].offsets.to_numpy()
            found += [(i, y, flat[a:b].copy()) for i, y, a, b in zip(batch["id"].to_pylist(), batch["y"].to_pylist(), at[:-1], at[1:], strict=True)]
        found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
        weights, bias = _fit([r[2] for r in found], np.array([r[1] for r in found], float))
        at = np.flatnonzero(weights)
        del found
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([weights[at].tolist()], pa.list_(pa.float64())), pa.array([float(bias)])], ["at", "w", "bias"])

    id_type = docs.schema[id_col].dataType.simpleString()
    extracted = sample.mapInArrow(extract, f"id {id_type}, y int, slots array<int>")
    row = extracted.repartition(1).mapInArrow(fit, "at array<bigint>, w array<double>, bias double").first()
    return np.array(row["at"], np.int64), np.array(row["w"], float), row["bias"]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function from an array of texts to their scores."""
    at, weights, bias = model
    dense = np.zeros(SLOTS)
    dense[at] = weights

    def scores(texts: pa.Array) -> np.ndarray:
        slot, owner = features(texts)
        hit = dense[slot] != 0
        key = np.unique(owner[hit] * SLOTS + slot[hit])
        total = np.bincount(key // SLOTS, weights=dense[key % SLOTS], minlength=len(texts)) + bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every text, from its words alone. Null and empty texts get the score of no features.

    Rows, repeated ones too, are scored independently; a null id stays null; other columns are ignored.
    """
    session_of(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        scores = scorer(model)
        for batch in batches:
            for part in slices(batch, "text", PART):
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(scores(part["text"]))], ["id", "score"])
            give_back()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score at least `threshold`.

    Null and empty texts get the score of no features, which is low, and so stay; rows with null ids and repeated rows are scored
    one by one. Without labels the model has no weights and nothing goes; an empty table stays empty.
    """
    model = train(docs, labels, id_col, text_col)

    def run(batches):
        scores = scorer(model)
        for batch in batches:
            for part in slices(batch, text_col, PART):
                yield part.filter(pa.array(scores(part[text_col]) < threshold))
            give_back()

    return docs.mapInArrow(run, docs.schema)
