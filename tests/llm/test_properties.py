"""Properties over generated texts."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceatlas.llm import bpe, packing, pii, secret_scan
from spliceatlas.llm._text import split_words
from spliceatlas.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
pieces = st.lists(st.sampled_from(["a", "B", "7", "07", "255", " ", "\n", "@", ".", "-", "+", "(", ")", "x@y.z", "1.2.3.4", "é", "secret", ":", "=", "'", "AKIA", "deadbeef", "token", "  "]), max_size=60).map("".join)


@given(st.lists(st.one_of(st.text(max_size=30), pieces), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    words = split_words(pa.array(texts, pa.string()))
    got = [[words.data[a:b].tobytes().decode() for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t) for t in texts]


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_email_spans_equal_the_pattern(text):
    expected = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(a, b) for k, a, b in pii.base_spans(text) if k == "email"] == expected
    expected = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    assert [(a, b) for k, a, b in pii.base_spans(text) if k == "ip"] == expected


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_secret_spans_equal_the_patterns(text):
    got = secret_scan.base_spans(text)
    assert [(a, b) for k, a, b in got if k == "hex"] == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert [(a, b) for k, a, b in got if k == "access"] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_byte_ids_decode_to_the_text(texts):
    vocab = bpe.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    got = [bpe.decode_bytes(ids[a:b], vocab).tobytes().decode() for _, _, ids, first in bpe.encode_batch(pa.array(texts, pa.string()), vocab) for a, b in zip(first[:-1], first[1:])]
    assert got == texts


@given(st.dictionaries(st.integers(1, 50), st.integers(0, 20)), st.integers(50, 60))
@settings(max_examples=200, deadline=None)
def test_plan_holds_everything_once(counts, capacity):
    runs = packing.plan(counts, capacity)
    placed = {}
    for length, lo, hi, _, each, offset in packing.places(runs):
        assert lo == placed.get(length, 0) and offset + each * length <= capacity
        placed[length] = hi
    assert placed == {n: c for n, c in counts.items() if c}
