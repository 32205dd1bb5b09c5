"""Operator 1: secret scan with dictionary-primed zstandard novelty.

Base spans come from three fixed patterns. The method then looks at further
long strings that stand in a sensitive context (a word such as *key* or
*bearer* shortly before them, or before the long strings they adjoin, as in the
lines of a key block) and asks how many bytes each one adds when it is
compressed after its surroundings and a dictionary of common identifiers. A
name, a path or a repeated constant is nearly free; a random credential costs
close to the entropy of its alphabet, and is reported as kind ``novel``. Copies
of the string in a sensitive context or in a base span are no surroundings;
copies elsewhere are, as they show that the string is no secret. A string without
digits that reads as words is a name; one without letters is no candidate.

Work per row is linear in the text; nothing is shuffled.

Defined cases: null text counts as empty; empty text has no span; repeated
rows, ties and null ids give one result row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PLAIN = re.compile(r"[^A-Za-z]*")
_DIGIT = re.compile(r"[0-9]")
_APART = re.compile(r"[A-Za-z0-9]")
_PIECE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
#: Letters that do not follow each other in words.
_UNREAD = re.compile(r"[^aeiouy]{5}|[aeiouy]{5}|q[^u]|j[^aeiou]|[fghkmpvwz][xjq]|[bc]x|v[bcdfghjkmnpqstwxz]|^[^aeiouy]*$")
#: The rest of a key block that is too short to be a long string.
_LAST = re.compile(r"(?:\s|\\[nr])+([A-Za-z0-9+/=]{1,15}?)(?:\s|\\[nr])*-----END")
_CONTEXT = re.compile(r"key|secret|token|passw|pwd|auth|bearer|credential|private|signature|session|cookie|access", re.I | re.A)
IDENTIFIERS = (
    "const static public private return import from class def self this null None true false string integer "
    "function value name user username account password secret token api_key apikey access_key secret_key client_id "
    "client_secret authorization bearer basic session cookie signature certificate https http www com org net example "
    "localhost config settings environment database connection host port path index version default request response "
    "header content type json application utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)
SPAN = "array<struct<kind:string,start:int,stop:int>>"


class Novelty:
    """Marginal compressed size of a string after its surroundings, as a share of what random text would need."""

    def __init__(self, identifiers: str, surroundings: int) -> None:
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda data: len(self.compressor.compress(data))
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
        self.around = surroundings

    def share(self, text: str, start: int, stop: int, apart: list[tuple[int, int]]) -> float:
        """``apart``: disjoint spans in order; copies of the string inside them are left out of its surroundings."""
        found = text[start:stop]

        def kept(lo: int, hi: int) -> str:
            parts, at = [], lo
            copy = text.find(found, max(0, lo - len(found)), hi + len(found))
            while copy >= 0 and copy < hi:
                end, k = copy + len(found), bisect_right(apart, (copy, len(text))) - 1
                if k >= 0 and end <= apart[k][1]:
                    parts.append(text[at : max(at, copy)])
                    at = max(at, end)
                copy = text.find(found, end, hi + len(found))
            return "".join([*parts, text[at:hi]])

        near = (kept(max(0, start - self.around), start) + "\n" + kept(stop, min(len(text), stop + self.around)) + "\n").encode("utf-8", "replace")
        extra = self.size(near + found.encode()) - self.size(near)
        alphabet = sum(n for n, p in ((10, r"[0-9]"), (26, r"[a-z]"), (26, r"[A-Z]")) if re.search(p, found))
        if re.fullmatch(r"[0-9a-fA-F]+", found):
            alphabet = 16
        return 8 * extra / (len(found) * math.log2(max(2, alphabet)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the three fixed patterns, in order of start."""
    found = []
    if _HINT.search(text.lower()):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def reads_as_words(found: str) -> bool:
    """Whether nearly all letters belong to pieces that can be words."""
    letters = sum(map(str.isalpha, found))
    return sum(len(w) for w in _PIECE.findall(found) if not _UNREAD.search(w.lower())) >= 0.8 * letters


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, reach: int, share: float) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that no base span overlaps."""
    told, free, k, covered, before, linked = [], [], 0, 0, 0, False
    for m in _LONG.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] < b:
            covered = max(covered, base[k][2])
            k += 1
        linked = linked and not _APART.search(text, before, a) or _CONTEXT.search(text, max(0, a - reach), a) is not None
        before = b
        if linked:
            told.append((a, b))
            if covered <= a and not _PLAIN.fullmatch(m[0]) and (_DIGIT.search(m[0]) or not reads_as_words(m[0])):
                free.append((a, b))
    if not free:
        return []
    apart: list[tuple[int, int]] = []
    for a, b in sorted(told + [(a, b) for a, _, b in base]):
        if apart and a < apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    out = []
    for a, b in free:
        if novelty.share(text, a, b, apart) >= share:
            out.append((a, 3, b))
            if last := _LAST.match(text, b):
                out.append((last.start(1), 3, last.end(1)))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", identifiers: str = IDENTIFIERS, surroundings: int = 256, reach: int = 48, share: float = 0.75) -> DataFrame:
    """Per row: ``doc_id``, counts of base kinds, digest of the base spans, all ``spans`` as text and as ``found`` structs.

    ``surroundings``: characters on each side that prime the compressor;
    ``reach``: how far before a string its sensitive word may stand;
    ``share``: least marginal bytes as a share of a random string's.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers, surroundings)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty, reach, share))
                n = [sum(s[1] == kind for s in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    given = columns(docs, **{id_col: "long", text_col: "string"})
    return given.mapInArrow(scan, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {SPAN}")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]", identifiers: str = IDENTIFIERS, surroundings: int = 256, reach: int = 48, share: float = 0.75) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (overlapping spans by one mark); null text stays null."""
    schema = docs.schema
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers, surroundings)
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                base = base_spans(text or "")
                at, parts = 0, []
                for a, _, b in sorted(base + novel_spans(text or "", base, novelty, reach, share)):
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(clean, schema)


def redact_counted(docs: DataFrame, **options) -> DataFrame:
    """``redact`` for tables that also carry ``n_chars``: the count follows the new text."""
    out = redact(docs, **options)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
