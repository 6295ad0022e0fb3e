"""Secrets in texts: fixed patterns, and strings that compression finds new.

Beyond the base spans, each long run of key-like characters in a sensitive context (a word
such as key, auth or credential close before it) is a candidate, whole, of any length. Long
runs joined by dots are one: the context before the first holds for all, and if any is new
all are reported, as one span; base spans are cut out of it. A candidate's novelty is the marginal
number of bytes zstandard needs for it, when primed with a dictionary of identifiers and the
text around the candidate, divided by its length. Words, identifiers and repeats of the
surroundings cost few bytes; random keys cost what random strings of their alphabet and length
do, and are reported from NOVELTY of that on.

Spans are code points, end exclusive. An added span has the kind it is most like: `hex` for
lower-case hexadecimal, `access` for capitals and digits, else `assign`. Null texts are
empty and have no spans. Rows are independent; other columns are ignored by `scan` and kept
by `redacted`.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.pii import redact, written
from fluxweave.llm.textkit import modest_batches

KINDS = ("assign", "access", "hex")
LEVEL = 19
NOVELTY = 0.8
LEAST = 16
BEFORE = 48
AROUND = 512

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{16,})*")
_CUES = ("key", "secret", "token", "passw", "pwd", "auth", "bearer", "credential", "private", "signature", "session", "cookie", "connection")
#: Words and identifiers that prime the dictionary, fixed.
_IDENTIFIERS = (
    "public static void class import return function const let var def self this null none true false "
    "string integer boolean float double array list map dict object value name type index count size length "
    "http https www com org net localhost example config settings environment production development staging "
    "Configuration Settings Controller Manager Factory Service Handler Session Connection Signature Certificate Provider "
    "Request Response Database Customer Account Context Builder Repository Application Component Listener Parameter "
    "username password token secret access private public key api auth bearer session cookie header request response "
    "client server database connection host port user admin default create update delete select insert where from "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxxxxxxxxxx 0000000000000000"
).encode()


@lru_cache(1)
def _frame_bytes() -> int:
    import zstandard

    return len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b""))


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes for each byte of the candidate, given identifiers and surroundings."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(_IDENTIFIERS + b"\n" + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = candidate.encode()
    return (len(packer.compress(data)) - _frame_bytes()) / max(1, len(data))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of keys, the smallest first; a candidate has the first that holds its letters and digits.
_ALPHABETS = tuple(map(frozenset, (_DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _DIGITS + _LOWER[:6] + _UPPER[:6], _UPPER + "234567", _LOWER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER)))
_SIGNS = frozenset("+/_=-")


@lru_cache(4096)
def _random_novelty(letters: str, length: int) -> float:
    """Mean novelty of a few random strings, the same ones each time."""
    rng = random.Random(f"{letters} {length}")
    return sum(novelty("".join(rng.choices(letters, k=length)), "", "") for _ in range(4)) / 4


def bar(candidate: str) -> float:
    """Novelty from which a candidate is reported. It falls with the length, so that is rounded up to a few steps."""
    used = set(candidate)
    letters = next(a for a in _ALPHABETS if used - _SIGNS <= a) | used & _SIGNS
    length = LEAST
    while length < min(len(candidate), 4096):
        length += max(1, length // 8)
    return NOVELTY * min(1.0, _random_novelty("".join(sorted(letters)), length))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _sensitive(before: str) -> bool:
    before = before.lower()
    return any(c in before for c in _CUES)


def _outside(start: int, end: int, base: list[tuple[int, int, int]]):
    """The pieces of text[start:end] that no base span meets."""
    for _, a, b in base:
        if a < end and b > start:
            if a > start:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of enough novelty, without what base spans meet."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if not any(c in low for c in _CUES):
        return out
    for m in _RUN.finditer(text):
        led = _sensitive(text[max(0, m.start() - BEFORE) : m.start()])
        for start, end in _outside(m.start(), m.end(), base):
            parts = [(start + p.start(), start + p.end()) for p in re.finditer(r"[^.]+", text[start:end])]
            found = [(a, b) for a, b in parts if (led or _sensitive(text[max(0, a - BEFORE) : a])) and _new(text, a, b)]
            if found:
                a, b = (parts[0][0], parts[-1][1]) if led else (found[0][0], parts[-1][1])
                s = text[a:b]
                out.append((2 if re.fullmatch("[0-9a-f]+", s) else 1 if re.fullmatch("[A-Z0-9]+", s) else 0, a, b))
    return out


def _new(text: str, a: int, b: int) -> bool:
    s = text[a:b]
    if len(s) < LEAST or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
        return False
    new = novelty(s, text[max(0, a - AROUND) : a], text[b : b + AROUND])
    return new >= NOVELTY or new >= bar(s)


def _spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base), key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) for each row of docs(doc_id, text)."""
    texts = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [_spans(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)),
                        pa.array([hashlib.sha256(written(base, KINDS).encode()).hexdigest() for base, _ in found]),
                        pa.array([written(every, KINDS) for _, every in found]),
                        pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret in column text replaced by its kind in brackets."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for text in part.column("text").to_pylist():
                    spans = _spans(text)[1] if text else []
                    out.append(redact(text, written(spans, KINDS), "[SECRET-{}]") if spans else text)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return modest_batches(docs).mapInArrow(run, docs.schema)
