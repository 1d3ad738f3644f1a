"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct chunks of a batch of texts lie in one symbol array. An index maps the rank of each mergeable pair to all its
positions there; active ranks are taken in ascending order from a heap, each is applied at all its positions at once, and
the lists of the neighbouring pairs are updated. A pair that a merge creates contains the new token, so its rank is higher:
taking ranks in ascending order gives what merging chunk by chunk gives.

A chunk is a run of white space with the word after it. Splitting before white space that follows a visible ASCII
character never changes how the tokenizer splits, so chunks can be encoded once each and texts put together from them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import session_of
from ._text import buffers, gathered, give_back, ragged, slices, split_words

#: Bytes of text whose distinct chunks are merged at once, and that are split into chunks at once.
GROUP, SLICE = 12 << 20, 2 << 20
SLOT_BITS = 20
#: Positions that enter the index at once at the start.
FIRST = 1 << 19
#: Characters of distinct chunks that are split into pieces at once.
PART = 1 << 19
#: Unicode White_Space, as \s means it in the tokenizers' pattern language.
WHITE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: The split patterns of the two public vocabularies, with white space spelled out.
BYTE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
#: White space outside ASCII: chunks that hold it are split on their own.
_ODD_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the kind BPE: base symbols, ranked merges, special tokens and, for decoding, each id's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_characters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word_end = model.get("end_of_word_suffix") or ""
        self.words = bool(self.word_end)
        self.split = regex.compile(WORD_SPLIT if self.words else BYTE_SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.base = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + self.word_end] for c in letters], np.int32)
        self.size = max(*ids.values(), *self.special.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left, self.right = keys // self.size, keys % self.size
        self.rank_type = np.uint16 if len(keys) < 1 << 16 else np.int64
        # a table with one slot for each hash; of keys that meet, the later ones go to a short sorted list
        slot = self._slot(keys)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, -1, np.int32)
        _, firsts = np.unique(slot, return_index=True)
        self.slot_key[slot[firsts]], self.slot_rank[slot[firsts]] = keys[firsts], firsts
        rest = np.setdiff1d(np.arange(len(keys)), firsts)
        self.rest_rank = rest[np.argsort(keys[rest])]
        self.rest_keys = keys[self.rest_rank]
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slot[rest]] = True
        code = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.token_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.token_size = np.array([len(b) for b in self.bytes], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        decimals = [b"%d," % i for i in range(self.size)]
        self.decimal_data = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_size = np.array([len(d) for d in decimals], np.int64)
        self.decimal_first = np.cumsum(self.decimal_size) - self.decimal_size

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        rank = np.where(self.slot_key[slot] == key, self.slot_rank[slot], -1)
        again = np.flatnonzero(self.crowded[slot] & (rank < 0))
        if len(again):
            at = np.searchsorted(self.rest_keys, key[again])
            at[at == len(self.rest_keys)] = 0
            rank[again] = np.where(self.rest_keys[at] == key[again], self.rest_rank[at], -1)
        return rank

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Applies all merges to pieces that end (exclusive) at `ends`. Returns the ids left and where each stood."""
        n = len(symbols)
        sym = np.append(symbols, np.int32(-1))
        del symbols
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            keep = rank >= 0
            if not keep.any():
                return
            at, rank = at[keep], rank[keep].astype(self.rank_type)
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.r_[0, cut]].tolist()
            edges = [0, *cut.tolist(), len(at)]
            for k, r in enumerate(firsts):
                if r in index:
                    index[r].append(at[edges[k] : edges[k + 1]])
                else:
                    index[r] = [at[edges[k] : edges[k + 1]]]
                    heapq.heappush(heap, r)

        for lo in range(0, n, FIRST):
            add((np.flatnonzero(after[lo : min(lo + FIRST, n)] < n) + lo).astype(np.int32))
        fresh = np.zeros(n + 1, bool)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:
                at = _apart(np.sort(at), after)
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            sym[at], sym[gone] = self.made[rank], -1
            after[at] = follow
            before[follow] = at
            before[n] = n
            fresh[at] = True
            left = before[at]
            right = at[(follow < n) & ~fresh[follow]]  # a fresh follower's left pair is this pair
            fresh[at] = False
            add(np.concatenate([left[left < n], right]))
        stay = np.flatnonzero(sym[:n] >= 0)
        return sym[stay], stay


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping positions, in ascending order, the leftmost that do not overlap."""
    keep, blocked = [], -1
    for x, y in zip(at.tolist(), after[at].tolist(), strict=True):
        if x != blocked:
            keep.append(x)
            blocked = y
    return np.array(keep, np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(texts: pa.Array, vocab: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """Chunks of the texts as one binary array, and n + 1 indices of each text's first chunk."""
    words = split_words(texts)
    if vocab.words:
        starts, first = words.start, words.first
        ends = words.end
    else:
        data, offsets = buffers(texts)
        # a chunk starts at each text's begin and where white space follows a visible ASCII character
        at = words.end[words.end < len(data)]
        solid = (data[at - 1] > 0x20) & (data[at - 1] < 0x7F)
        inside = np.ones(len(data) + 1, bool)
        inside[offsets] = False
        at = at[solid & inside[at]]
        full = offsets[:-1][np.diff(offsets) > 0]
        starts = np.sort(np.concatenate([at, full]))
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        first = np.searchsorted(starts, offsets)
    size = ends - starts
    body = words.data if not vocab.words else ragged(words.data, starts, size)
    made = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(body if body.flags.c_contiguous else body.copy())])
    return made, first


def _folded(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()


def _pieces(text: str, vocab: Vocabulary) -> tuple[list[int], list[int]]:
    """Symbols and piece sizes of one chunk of any kind."""
    symbols, sizes = [], []
    for k, part in enumerate(vocab.special_split.split(text)):
        if k % 2:
            symbols.append(vocab.special[part])
            sizes.append(1)
            continue
        if vocab.words:
            part = _folded(part)
        for piece in vocab.split.findall(part):
            raw = piece.encode()
            symbols += vocab.base[list(raw)].tolist()
            symbols[-1] = int(vocab.last[raw[-1]])
            sizes.append(len(raw))
    return symbols, sizes


def _split_at_once(text: str, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all pieces of a text, and the ends (exclusive) of the pieces among the symbols and among the characters of the pieces."""
    at, codes = [], []
    lo, upto = 0, 0
    while lo < len(text):
        # parts end where a chunk does: at the space between chunks, or before white space after a visible character
        hi = len(text) if len(text) - lo <= PART else _cut(text, lo + PART, vocab)
        pieces = vocab.split.findall(text[lo:hi])
        sizes = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) + upto
        upto = int(sizes[-1]) if len(sizes) else upto
        at.append(sizes)
        codes.append(np.frombuffer("".join(pieces).encode(), np.uint8))
        lo = hi
    at, codes = np.concatenate(at), np.concatenate(codes)
    head = (codes & 0xC0) != 0x80
    end = np.r_[np.flatnonzero(head).astype(np.int32), np.int32(len(codes))][at]
    made = vocab.base[codes]
    made[end - 1] = vocab.last[codes[end - 1]]
    return made, end, at


_CUT = regex.compile(r"(?<=[!-~])[ \t\n\r\f\v]")


def _cut(text: str, at: int, vocab: Vocabulary) -> int:
    """A place from `at` on where the split of the text does not change if it is cut there."""
    found = text.find(" ", at) if vocab.words else (m.start() if (m := _CUT.search(text, at)) else -1)
    return found if found >= 0 else len(text)


def _encode_chunks(chunks: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct chunks: the ids of chunk i are ids[first[i] : first[i] + size[i]]."""
    data, offsets = buffers(chunks)
    plain = np.ones(len(chunks), bool)
    if not vocab.words and len(chunks):
        lead, tail = data[offsets[:-1]], data[offsets[1:] - 1]
        plain &= (lead <= 0x20) & (lead >= 0x09) & ((lead <= 0x0D) | (lead == 0x20)) & (tail > 0x20)
    readable = chunks.cast(pa.string())
    special, odd_space = pc.match_substring(readable, "<|"), pc.match_substring_regex(readable, _ODD_SPACE)
    plain &= ~pc.or_(special, odd_space).to_numpy(zero_copy_only=False)
    symbols, ends, owner = [], [], []
    if plain.any():
        parts = chunks if plain.all() else chunks.filter(pa.array(plain))
        if vocab.words:
            text = _folded(" ".join(parts.cast(pa.string()).to_pylist()))
            upto = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(parts)))
        else:
            own, at = buffers(parts)
            text = own.tobytes().decode()
            upto = np.cumsum(np.add.reduceat(((own & 0xC0) != 0x80).astype(np.int64), at[:-1]))
        made, end, at = _split_at_once(text, vocab)
        owner.append(np.flatnonzero(plain)[np.searchsorted(upto, at)].astype(np.int32))
        symbols.append(made)
        ends.append(end)
        del text, upto, at, made, end, parts
    odd = np.flatnonzero(~plain)
    rest = dict(zip(odd.tolist(), chunks.take(pa.array(odd)).cast(pa.string()).to_pylist(), strict=True))
    for i in rest:
        got, sizes = _pieces(rest[i], vocab)
        base = int(ends[-1][-1]) if ends else 0
        if sizes:
            symbols.append(np.array(got, np.int32))
            ends.append(base + np.cumsum(sizes))
            owner.append(np.full(len(sizes), i, np.int32))
    if not symbols:
        none = np.zeros(len(chunks), np.int64)
        return none[:0], none, none
    end, owner = np.concatenate(ends), np.concatenate(owner)
    symbols.append(np.concatenate([symbols.pop(0) for _ in range(len(symbols))]))
    ids, stood = vocab.merge(symbols.pop(), end)
    holder = owner[np.searchsorted(end, stood, "right")]
    size = np.bincount(holder, minlength=len(chunks))
    first = np.zeros(len(chunks), np.int64)
    change = np.flatnonzero(np.r_[True, holder[1:] != holder[:-1]])
    first[holder[change]] = change
    return ids, first, size


def encode_batch(texts: pa.Array, vocab: Vocabulary):
    """Yields (lo, hi, ids, first): ids of the texts lo..hi, text k of them at ids[first[k] : first[k + 1]]."""
    lo = 0
    for group in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t", GROUP):
        coded, spans = [], []
        for part in slices(group, "t", SLICE):
            chunks, first = _chunks(part.column(0), vocab)
            coded.append(chunks.dictionary_encode())
            spans.append((lo, lo + part.num_rows, first))
            lo += part.num_rows
            del chunks
        whole = pa.chunked_array(coded).unify_dictionaries()
        del coded
        ids, at, size = _encode_chunks(whole.chunk(0).dictionary, vocab)
        ids = ids.astype(np.int32)
        for k, (begin, end, first) in enumerate(spans):
            codes = whole.chunk(k).indices.to_numpy()
            sizes = size[codes]
            yield begin, end, ragged(ids, at[codes], sizes), np.r_[0, np.cumsum(sizes)][first]
        del whole, ids, at, size, codes, sizes, spans
        give_back()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each text. A null or empty text has no ids; special tokens are recognised in texts.

    Rows, repeated ones too, are encoded independently; a null id stays null; other columns are ignored.
    """
    session_of(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in gathered(batches, GROUP):
            for lo, hi, ids, first in encode_batch(batch["text"], vocab):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_bytes(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    return ragged(vocab.token_data, vocab.token_first[ids], vocab.token_size[ids])


def _valid(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text: the bytes of all ids, special tokens included; malformed UTF-8 becomes U+FFFD. Null ids: empty text."""
    session_of(encoded)
    encoded = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [_valid(decode_bytes(np.asarray(x.values, np.int64), vocab).tobytes()).decode() for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])

    return encoded.mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass, with digests in place of ids and texts: id_col, n_tokens, ids_sha256 (of the decimal
    ids joined by commas), decoded_sha256 (of the decoded text in UTF-8). Cases are as in encode."""
    session_of(docs)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in gathered(batches, GROUP):
            for lo, hi, ids, first in encode_batch(batch["text"], vocab):
                said, heard = [], []
                size = vocab.decimal_size[ids]
                at, digits = np.r_[0, np.cumsum(size)][first], ragged(vocab.decimal_data, vocab.decimal_first[ids], size)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    said.append(hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest())
                at, raw = np.r_[0, np.cumsum(vocab.token_size[ids])][first], decode_bytes(ids, vocab)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    heard.append(hashlib.sha256(_valid(raw[a:b].tobytes())).hexdigest())
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(said, pa.string()), pa.array(heard, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
