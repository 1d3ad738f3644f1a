"""Personal data by weak supervision.

Patterns propose candidates: strict ones, which are always reported, and loose ones (spelled-out addresses, phones without a plus,
cards in unusual groups). Labelers of three families vote on each candidate: shape rules, gazetteers (mail domains, country and
area codes, card issuers) and the words around it. Expectation-maximisation over the table of vote patterns estimates, for each
kind of its own, every labeler's reliability and every pattern's probability. A logistic span classifier learns these
probabilities from the span itself and the text around it (its shape, the characters at its ends, the words before and after), beside
the votes, and decides on the loose candidates: what the votes leave open, like contexts settle. The vote table is counted over all
documents in Spark and has at most a few hundred rows, whatever the corpus; the classifier is fitted on TRAINING_SPANS spans at most.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spans import SPANS, Taken
from ._store import Scratch, session_of
from ._text import give_back, slices

KINDS = ["email", "ip", "card", "phone"]
#: The shapes of the base kinds. (A digit run that fails fails from each of its digits, hence the lookbehind.)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{2,63}|\.[A-Za-z]{2,24})+"),
    "card": re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
}
#: Gazetteers.
MAIL_ENDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "us", "info", "example", "test"}
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
#: Words near a candidate that speak for its kind, and words that speak against any.
NEAR = {
    "email": ("mail", "contact", "write", "reach", "address", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "from", "client"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "contact", "ruf"),
}
AGAINST = ("version", "release", "isbn", "serial", "order", "invoice", "section", "build", "part no", "model")
LABELERS = ("shape", "gazetteer", "context", "against")
REACH = 40
#: Slots of the classifier's hashed features, and the most spans it is fitted on: those with the smallest hashes of their places.
SLOTS, TRAINING_SPANS = 4096, 20_000
ROUNDS, RATE, RIDGE = 150, 0.5, 2.0
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"(.)\1+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of all kinds, each kind leftmost and non-overlapping."""
    out: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose candidates that overlap no base span."""
    taken, out = Taken(base), []
    for kind, pattern in LOOSE.items():
        if kind == "email" and not (("at" in text) and ("[" in text or "(" in text)):
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if taken.free(*m.span())]
    return out


def votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for none."""
    body, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - REACH) : start].lower()
    if kind == "email":
        shape = 1 if "@" in body or re.search(r"[\[(] ?at", body) else -1
        gazetteer = 1 if re.split(r"[^A-Za-z]+", body.lower().rstrip(")] "))[-1] in MAIL_ENDS else -1
    elif kind == "ip":
        first = int(body.split(".")[0].lstrip("0")[:3] or 0)
        shape, gazetteer = (1 if body.count(".") == 3 else -1), (1 if 1 <= first <= 223 else -1)
    elif kind == "card":
        shape, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    else:
        shape = 1 if body.startswith("+") or (len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01") else -1
        gazetteer = (1 if digits.startswith(COUNTRY_CODES) else -1) if body.startswith("+") else 0
    return [shape, gazetteer, 1 if any(w in before for w in NEAR[kind]) else 0, -1 if any(w in before for w in AGAINST) else 0]


def estimate(table: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern by expectation-maximisation, with smoothed vote rates of each labeler under both classes."""
    rows = np.array([*table], int).reshape(len(table), -1)
    n = np.array([*table.values()], float)
    p = np.clip(0.5 + 0.2 * rows.sum(1), 0.05, 0.95)  # starts from the majority
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        odds = np.full(len(rows), np.log(prior / (1 - prior)))
        for k in range(rows.shape[1]):
            for vote in (-1, 0, 1):
                on = rows[:, k] == vote
                # a labeler is taken to be better than chance before it has been seen
                lean = {-1: (0.5, 2.0), 0: (1.0, 1.0), 1: (2.0, 0.5)}[vote]
                yes = ((n * p)[on].sum() + lean[0]) / ((n * p).sum() + 3.5)
                no = ((n * (1 - p))[on].sum() + lean[1]) / ((n * (1 - p)).sum() + 3.5)
                odds[on] += np.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(map(tuple, rows.tolist()), p.tolist(), strict=True))


def features(text: str, kind: str, start: int, end: int, vote: list[int]) -> list[int]:
    """Slots of the span's votes, its shape, the characters at its ends and the words around it, each with its kind."""
    body = text[start:end]
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in body)
    items = [f"vote {k} {v}" for k, v in enumerate(vote)]
    items += ["shape " + _RUN.sub(lambda m: m[1] + ("+" if m[1] == "a" else str(len(m[0]))), shape), f"digits {min(len(_digits(body)), 20)}"]
    items += [f"before {_class_of(text[start - 1 : start])}", f"after {_class_of(text[end : end + 1])}"]
    items += [f"left {w.lower()}" for w in _WORD.findall(text[max(0, start - REACH) : start])[-4:]]
    items += [f"right {w.lower()}" for w in _WORD.findall(text[end : end + REACH])[:2]]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % SLOTS for x in [*items, "kind"]})


def _class_of(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def fit_classifier(rows: list[tuple[list[int], float]]) -> np.ndarray:
    """Weights of a ridge logistic regression on (slots, probability), by gradient steps with a rate for each weight; bias last.

    Without rows every span is unlikely.
    """
    w = np.zeros(SLOTS + 1)
    w[SLOTS] = -3.0 if not rows else 0.0
    if not rows:
        return w
    sizes = np.array([len(x) for x, _ in rows])
    slot, owner = np.concatenate([np.asarray(x, np.int64) for x, _ in rows]), np.repeat(np.arange(len(rows)), sizes)
    y, seen = np.array([p for _, p in rows]), np.zeros(SLOTS + 1)
    for _ in range(ROUNDS):
        wrong = _likely(w, slot, owner, len(rows)) - y
        slope = np.append(np.bincount(slot, weights=wrong[owner], minlength=SLOTS), wrong.sum()) + RIDGE * np.append(w[:SLOTS], 0)
        seen += slope**2
        w -= RATE * slope / np.sqrt(np.maximum(seen, 1e-12))
    return w


def _likely(w: np.ndarray, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[slot], minlength=n) + w[SLOTS], -30, 30)))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int8())), ("features", pa.list_(pa.int16()))]))
FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<tinyint>,features:array<smallint>>>"


def find_personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans (kind, start, end, base, score) of every whole text, in code points.

    Base spans always stay, with the classifier's score; loose candidates are added from `threshold` on. Null and
    empty texts have none. Rows, repeated ones too, are scanned independently; a null id stays null; other columns are ignored;
    an empty table gives an empty result.
    """
    spark = session_of(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def propose(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part["text"].to_pylist():
                    text = text or ""
                    base, spans = base_spans(text), []
                    for strict, some in ((True, base), (False, candidates(text, base))):
                        for kind, a, b in some:
                            vote = votes(text, kind, a, b)
                            spans.append({"kind": kind, "start": a, "end": b, "base": strict, "votes": vote, "features": features(text, kind, a, b, vote)})
                    rows.append(spans)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(rows, _FOUND)], ["id", "found"])
            give_back()

    found = Scratch(spark).save(docs.mapInArrow(propose, f"id {id_type}, found {FOUND}"), "found")
    spans = found.select("id", F.explode("found").alias("f"))
    counts = spans.groupBy("f.kind", "f.votes").count().collect()  # bounded: kinds times vote patterns
    tables: dict[str, dict[tuple[int, ...], int]] = {}
    for r in counts:
        tables.setdefault(r["kind"], {})[tuple(r["votes"])] = r["count"]
    likely = {kind: estimate(table) for kind, table in tables.items()}
    # bounded: TRAINING_SPANS rows of a few dozen numbers, the same for any order and partitioning of the input
    place = F.xxhash64(F.col("id").cast("string"), "f.kind", "f.start", "f.end")
    sample = spans.select(place.alias("place"), "f.kind", "f.votes", "f.features").orderBy("place", "kind", "features").limit(TRAINING_SPANS).collect()
    weights = fit_classifier([(r["features"], likely[r["kind"]][tuple(r["votes"])]) for r in sample])

    def decide(batches):
        for batch in batches:
            lists = batch["found"]
            flat = lists.flatten()
            slots = flat.field("features").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.list_value_length(flat.field("features")).to_numpy(zero_copy_only=False)
            score = _likely(weights, slots, np.repeat(np.arange(len(flat)), sizes), len(flat)) if len(flat) else np.zeros(0)
            base = flat.field("base").to_numpy(zero_copy_only=False).astype(bool)
            keep = base | (score >= threshold)
            per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            kept = np.bincount(np.repeat(np.arange(len(lists)), per_text)[keep], minlength=len(lists))
            some = flat.filter(pa.array(keep))
            structs = pa.StructArray.from_arrays([*(some.field(n) for n in ("kind", "start", "end", "base")), pa.array(score[keep])], ["kind", "start", "end", "base", "score"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), structs)], ["id", "spans"])

    return found.mapInArrow(decide, f"id {id_type}, spans {SPANS}").withColumnRenamed("id", id_col)
