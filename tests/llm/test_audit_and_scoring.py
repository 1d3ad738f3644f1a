"""Source divergence and language-model scoring against brute force, with hard cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spliceatlas.llm import divergence, katz

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, g int, rank int"  # clashing names on purpose


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def audited(rows, least=3, most=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERMS.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in seen[lang].items() if c >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((own[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def test_divergences_match_brute_force(spark):
    rnd = random.Random(3)
    words = ["w" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)] + ["É", "é", "İx", "漢字", "𝒳y", "naïve"]
    rows = [(k, " ".join(rnd.choice(words[: 20 + 3 * (k % 9)]).title() + rnd.choice(["", ",", " 12", "\n", "_"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None]), f"s{k % 4}") for k in range(120)]
    rows += [(200, None, "en", "empty"), (201, "", "en", None), (202, "only once here", "xx", "a"), (203, None, "xx", "b"), (204, "alone", "yy", "a")]
    rows += [(300, "same row " * 5, "en", "s1")] * 4 + [(301, "\x00z\x7fz " * 30_000, "de", "s2"), (None, "wa WA", "de", "s2")]
    found = divergence.divergences(table(spark, rows))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows)
    assert {tuple(r) for r in divergence.divergences(table(spark, rows), least=5, most=2).collect()} == audited(rows, 5, 2)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(table(spark, [])).count() == 0
    assert divergence.divergences(table(spark, [(1, None, None, None)])).count() == 0


class Katz:
    """The model with dictionaries, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for tokens in texts:
            for i in range(len(tokens)):
                for k in range(order):
                    self.counts[k][self.gram(tokens, i, k)] += 1
        self.texts = len(texts)
        self.total = sum(self.counts[0].values())
        self.factors = [katz.discounts([sum(c == r for c in level.values()) for r in range(1, katz.MOST + 2)]) for level in self.counts]
        self.after = defaultdict(list)
        for level in self.counts[1:]:
            for gram in level:
                self.after[gram[:-1]].append(gram[-1])

    @staticmethod
    def gram(tokens, i, k):
        return tuple(tokens[j] if j >= 0 else "<s>" for j in range(i - k, i + 1))

    def kept(self, k, gram):
        c = self.counts[k][gram]
        return c - katz.TAIL if c > katz.MOST else self.factors[k][c - 1] * c if c else 0.0

    def p(self, history, word):
        k = len(history)
        if k == 0:
            return self.kept(0, (word,)) / self.total if self.counts[0][word,] else 1 - sum(self.kept(0, g) for g in self.counts[0]) / self.total
        seen = self.after[history]
        if not seen:
            return self.p(history[1:], word)
        n = sum(self.counts[k][*history, w] for w in seen)
        if self.counts[k][*history, word]:
            return self.kept(k, (*history, word)) / n
        free = 1 - sum(self.kept(k, (*history, w)) for w in seen) / n
        return free / (1 - sum(self.p(history[1:], w) for w in seen)) * self.p(history[1:], word)


@pytest.mark.parametrize(("order", "unit", "keys"), [(1, 1 << 20, 1 << 20), (2, 500, 50), (3, 2000, 300)])
def test_scores_match_plain_katz(spark, order, unit, keys, monkeypatch):
    monkeypatch.setattr(katz, "UNIT_BYTES", unit)
    monkeypatch.setattr(katz, "BUCKET_KEYS", keys)
    monkeypatch.setattr(katz, "LOT_UNITS", 3)
    rnd = random.Random(order)
    words = ["the", "The", "É", "é"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(words[min(int(rnd.expovariate(0.15)), len(words) - 1)] for _ in range(n))
    rows = [(k, text(rnd.randint(0, 40)) + rnd.choice(["", " new%d" % k, "\n"]), "en", "s") for k in range(80)]
    rows += [(90, None, "en", "s"), (91, "", "en", "s"), (92, " \t", "en", "s"), (93, "the " * 3000, "en", "s"), (None, "the w1", "en", "s"), (5, "the w1 w2", "en", "s"), (5, "the w1 w2", "en", "s")]
    df = table(spark, rows)
    got = sorted(map(tuple, katz.katz_scores(df, katz.held_out("doc_id", 4), order).collect()), key=str)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"] for _, t, _, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 0 for d, *_ in rows]
    model = Katz([t for t, h in zip(tokens, held, strict=True) if not h], order)
    total, types = model.total, len(model.counts[0])
    outcomes = [w for (w,) in model.counts[0]] + ["never"]
    for history in [(), *list(model.after)[::7]]:  # what a history leaves open adds up to 1
        assert abs(sum(model.p(history, w) for w in outcomes) - 1) < 1e-9
    expected = []
    for (d, *_), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((model.counts[0][w,] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        score = sum(math.log10(model.p(model.gram(t, i, order - 1)[:-1], w)) for i, w in enumerate(t))
        expected.append((d, h, len(t), sum(model.counts[0][w,] > 0 for w in t), total, base, score))
    expected.sort(key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert abs(g[5] - e[5]) < 1e-6 and abs(g[6] - e[6]) < 1e-6, (g, e)
    assert {h for _, h, *_ in got} == {True, False}


def test_scores_without_training_rows_or_rows(spark):
    assert katz.katz_scores(table(spark, [])).count() == 0
    rows = katz.katz_scores(table(spark, [(1, "a b", "", ""), (2, None, "", "")]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(rows)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_discounts_are_factors_whatever_the_counts():
    for often in ([0] * 6, [9, 0, 0, 0, 0, 0], [100, 40, 22, 14, 10, 7], [5, 5, 5, 5, 5, 5], [1, 9, 9, 9, 9, 900]):
        assert all(0 < d < 1 for d in katz.discounts(often))
    n = [1000, 400, 220, 140, 100, 70]
    common = 6 * n[5] / n[0]
    assert abs(katz.discounts(n)[1] - (3 * n[2] / (2 * n[1]) - common) / (1 - common)) < 1e-12
