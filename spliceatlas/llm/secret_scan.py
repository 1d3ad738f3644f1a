"""Secret scanning: patterns of known shapes, and novelty under dictionary-primed zstandard.

A candidate is a long token shortly after a sensitive word. Its novelty is what it adds to compressed text that is primed with a
dictionary, over what random strings of its length and alphabet add. It is measured twice, and the smaller value counts: against the pieces
that names and words are made of (public vocabularies of tokenizers, some 300 KB, lower case), and against the code around it. Names,
paths and words of many languages consist of such pieces, whether or not they occur themselves; random keys of any alphabet and
length do not. Other occurrences of the token are no surroundings, so that a key stays novel where it is repeated.
Candidates that stay incompressible are reported as `novel`. Long ones are measured in consecutive parts, and one novel part is enough.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import session_of
from ._spans import SPANS, Taken
from ._text import give_back, slices
from ._vocabularies import tokenizer_file

KINDS = ["assign", "access", "hex", "novel"]
#: The shapes of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as a run of the class always is
SENSITIVE = re.compile(r"(password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|auth|bearer|credential)[A-Za-z_-]{0,12}[\"']?[\x20:=>\"']{1,8}([A-Za-z0-9+/_=.~-]{16,})", re.A | re.I)
_WORDS = ("passw", "passp", "pwd", "secret", "token", "api", "key", "auth", "bearer", "credential")
_KEYED = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT = 256
#: Longest part of a candidate that is measured at once.
PART = 512
#: A level that finds matches of three bytes.
LEVEL = 19
#: Marginal compressed bytes of a candidate, over those of random strings of its alphabet, from which it counts as incompressible. Chosen on a list of
#: names and random keys; the README has figures for others.
NOVELTY = 0.945
#: Random strings that a candidate is held against.
DRAWS = 4
#: Vocabularies whose pieces prime the measure: a rank file of a byte-level tokenizer each. Shorter pieces cost as much as a match.
VOCABULARIES, LEAST_PIECE = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"), 4
#: Characters that are drawn together if a candidate has one of them.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz")
#: Order-0 entropy of a candidate below which its characters in another order are no yardstick, as in rulers; 16 random digits have about 46.
LEAST_BITS = 32
#: Identifiers and words that sensitive contexts are made of; the dictionary every context is compressed with.
#: Fixed list, of bounded size.
IDENTIFIERS = " ".join("/usr/local/lib/python3/site-packages/ /usr/bin/env /home/user/.config/ /etc/ssl/certs/ /var/lib/ /opt/share/include/ https://www.example.com/ access account admin api app application auth authorization aws base64 bearer build bucket cache client cloud code com commit config connection content credential data database date debug default deploy development dev document documentation endpoint env environment error example field file folder get github header host http https id image import index info input internal invalid item json key kubernetes lib license link list local localhost log login main manager message method module name network node null number object org output package page parameter password path placeholder port prefix private production profile project property provider public read refresh region registry release repository request required reset resource response role root sample scope secret server service session set settings source src stage staging standard status storage string system table tag target temp test token true type undefined update upload url user username usr utils value var variable version web www your_api_key_here your_token_here changeme abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789".split()).encode()


def own_bits(token: str) -> float:
    """Order-0 entropy of the whole token."""
    return sum(c * math.log2(len(token) / c) for c in Counter(token).values())


def pieces(files: list[str]) -> bytes:
    """The dictionary of names: pieces of letters of rank files, in lower case, once each, the commonest last, where they are cheapest to refer to."""
    rank: dict[bytes, int] = {}
    for file in files:
        for line in Path(file).read_bytes().splitlines():
            piece, _, place = line.partition(b" ")
            piece = base64.b64decode(piece).strip().lower()
            if len(piece) >= LEAST_PIECE and re.fullmatch(rb"[a-z\x80-\xff]+", piece):
                rank[piece] = min(rank.get(piece, 1 << 62), int(place))
    return b" ".join([*sorted(rank, key=lambda x: (-rank[x], x)), IDENTIFIERS.lower()])


def alphabet(token: str) -> str:
    """The characters of the classes it has characters of, and its others; letters beyond f make a-f likely too."""
    own = set(token)
    met = [c for c in CLASSES if own & set(c)]
    if CLASSES[2] in met and CLASSES[1] not in met:
        met.append(CLASSES[1])
    return "".join(sorted(own.union(*met)))


class _Primed:
    """Compressed bytes that strings add behind a text of one match and of all byte values, which leave a dictionary's matches as the only gain."""

    def __init__(self, dictionary: bytes, often: bool = False):
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if often:
            content.precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.before = dictionary[-1500:-1100] + bytes(random.Random(5).sample(range(256), 256))
        self.size = len(self.press.compress(self.before))

    def added(self, text: str) -> int:
        return len(self.press.compress(self.before + text.encode())) - self.size


class Novelty:
    """What a string adds, over what random strings of its alphabet add: the smaller of the values under the pieces and under its surroundings.

    Letters count in lower case. Strings of less than LEAST_BITS have none (0).
    """

    def __init__(self, dictionary: bytes):
        self.names = _Primed(dictionary, often=True)

    def __call__(self, before: str, token: str, after: str) -> float:
        if own_bits(token) < LEAST_BITS:
            return 0.0
        token, drawn, of = token.lower(), random.Random(0), alphabet(token.lower())
        draws = ["".join(drawn.choices(of, k=len(token))) for _ in range(DRAWS)]
        around = (before + "\n" + after).lower().encode(errors="replace")
        found = []
        for primed in (self.names, _Primed(around + b"\n" + IDENTIFIERS.lower())):
            found.append(primed.added(token) * DRAWS / sum(map(primed.added, draws)))
            if found[-1] < NOVELTY:
                break
        return min(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _KEYED):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[int, int, float]]:
    """Incompressible tokens in sensitive contexts, less what base spans cover of them: start, end and novelty (of the first novel part)."""
    lowered = text.lower()
    if not any(w in lowered for w in _WORDS):
        return []
    taken, out = Taken(base), []
    for m in SENSITIVE.finditer(text):
        a, b = m.span(2)
        token = m[2]
        if not (free := taken.gaps(a, b)):
            continue
        before, after = _around(text, token, a, b)
        parts = -(-len(token) // PART)
        cuts = [len(token) * k // parts for k in range(parts + 1)]
        scores = (novelty((before + token[max(0, x - CONTEXT) : x])[-CONTEXT:], token[x:y], after) for x, y in zip(cuts, cuts[1:], strict=False))
        n = next((score for score in scores if score >= NOVELTY), None)
        if n is not None:
            out += [(*gap, n) for gap in free]
    return out


def _around(text: str, token: str, a: int, b: int) -> tuple[str, str]:
    """CONTEXT characters before a and after b, with line feeds for other occurrences of the token, those that reach in from outside too."""
    wide, blank = CONTEXT + len(token), "\n" * len(token)
    return text[max(0, a - wide) : a].replace(token, blank)[-CONTEXT:], text[b : b + wide].replace(token, blank)[:CONTEXT]


def _batch_spans(texts: pa.Array, novelty: Novelty) -> list[list[dict]]:
    found = []
    for text in texts.to_pylist():
        text = text or ""
        base = base_spans(text)
        spans = [{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k, a, b in base]
        spans += [{"kind": "novel", "start": a, "end": b, "base": False, "score": n} for a, b, n in novel_spans(text, base, novelty)]
        found.append(spans)
    return found


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def _dictionary(vocabularies: list[str] | None) -> bytes:
    """Read by the driver and sent with the function: a few hundred KB."""
    return pieces([tokenizer_file(v) for v in VOCABULARIES] if vocabularies is None else vocabularies)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: list[str] | None = None) -> DataFrame:
    """id_col and spans (kind, start, end, base, score) of every whole text, in code points.

    Base spans always stay; `novel` spans come from the novelty measure, which alone decides on candidates of 16 characters or
    more, whatever they are made of. vocabularies: paths of rank files (those of VOCABULARIES, if not given). Null and empty texts have
    none. Rows, repeated ones too, are scanned independently; a null id stays null; other columns are ignored.
    """
    session_of(docs)
    dictionary = _dictionary(vocabularies)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(_batch_spans(part["text"], novelty), _TYPE)], ["id", "spans"])
            give_back()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", vocabularies: list[str] | None = None) -> DataFrame:
    """docs, all columns, with each secret replaced by [SECRET]; length_col, if there is one, is brought up to date.

    Spans that overlap are replaced together. Null texts stay null, empty ones empty, and texts without secrets as they are; rows, repeated ones
    too, are scanned independently; an empty table stays empty.
    """
    session_of(docs)
    dictionary = _dictionary(vocabularies)
    names = docs.columns

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part[text_col].to_pylist()
                changed = False
                for i, spans in enumerate(_batch_spans(part[text_col], novelty)):
                    if spans:
                        changed, texts[i] = True, _without(texts[i], [(s["start"], s["end"]) for s in spans])
                if changed:
                    at = names.index(text_col)
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part
            give_back()

    out = docs.mapInArrow(run, docs.schema)
    if length_col in names:
        out = out.select(*[F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(c)).alias(c) if c == length_col else c for c in names])
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, upto = [], 0
    for a, b in sorted(spans):
        if b <= upto:
            continue
        if a >= upto:
            out += [text[upto:a], "[SECRET]"]
        upto = b
    return "".join([*out, text[upto:]])
