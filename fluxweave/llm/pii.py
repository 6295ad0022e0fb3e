"""Personal data: spans of e-mail addresses, IP addresses, payment cards and phone numbers.

Base spans come from fixed patterns. Beyond them, generators of high recall propose
overlapping candidates (spelled-out addresses, phone numbers without a plus, grouped card
numbers, addresses of eight groups); boosted trees judge each by its format and context,
and those over their kind's calibrated threshold are added. The trees learn from two kinds of
examples. Built ones, from a fixed seed: sensitive formats with fitting words around them, and
look-alikes (orders, dates, prices, versions, measures) in plain contexts. And, with `fit`, ones
of all the documents' whole texts: base spans written in all other ways where they stand (spelled-out
addresses, numbers without their plus or with other separators) are positive, all other candidates
of the documents are negative, but those in a match that was dropped for too many digits, which may
be real and have no label. Equal examples are one row with their number (`examples`), and trees
and thresholds follow from all the rows. A threshold is the least one, LEAST or more, with PRECISION
on examples kept out of training, which are those of a third of the different texts.

Positions are code points, end exclusive. Null texts are empty and have no spans. Rows are
independent of each other, so ties and repeats do not matter; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave import runtime
from fluxweave.llm.boost import Boosted, Rows
from fluxweave.llm.textkit import modest_batches

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
LEAST = 0.5
CONTEXT = 32
EXAMPLES = 3000  # weight of the documents' examples of each label, the same for each kind that has some
GRID = 1 << 16  # thresholds are multiples of its inverse
COUNTED = 20_000  # different examples a task counts before it passes them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits whose head does not begin an address has no later digit that does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The checksum of payment card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:  # a match has one @, so each @ is tried with the run before it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


#: Generators: kind's number and pattern. They overlap on purpose.
_GENERATORS = (
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])0[0-9]{2,4}[\x20/-][0-9]{5,8}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])00[0-9](?:[\x20().-]{0,2}[0-9]){8,13}(?![0-9])")),
)
_SPELLED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)\x20?[0-9]{1,3}){3}(?![0-9])")
_AT = re.compile(r"\x20?(?:\([Aa][Tt]\)|\[[Aa][Tt]\])\x20?|\x20at\x20")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]|\x20dot\x20)\x20?[A-Za-z0-9-]*[A-Za-z])+")
#: Cue words for each kind, fixed.
_CUES = (
    ("mail", "e-mail", "contact", "write", "reach", "address"),
    ("ip", "host", "server", "address", "login", "client"),
    ("card", "visa", "credit", "debit", "payment", "cvv", "expires"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "ring"),
)
_AGAINST = ("order", "invoice", "version", "isbn", "date", "price", "total", "item", "ref", "page", "serial", "number of")
_NUMBER = re.compile(r"[0-9][0-9\x20./()-]{8}")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals, many of them wrong."""
    out, done = [], 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at.start() and (m := _AFTER_AT.match(text, at.end())):
            out.append((0, start, m.end()))
        done = at.end()
    if "dot" in text or "[.]" in text or "(.)" in text:
        out += [(1, m.start(), m.end()) for m in _SPELLED_IP.finditer(text)]
    numbers = _NUMBER.search(text) is not None
    for kind, pattern in _GENERATORS:
        if numbers or kind == 1 and text.count(":") >= 7:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and words around it."""
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    ahead = text[start - 1] if start else " "
    behind = text[end] if end < len(text) else " "
    return [
        kind,
        len(s),
        len(digits),
        len(digits) / max(1, len(s)),
        sum(c.isalpha() for c in s),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(set(digits)),
        float(len(digits) >= 13 and luhn(digits)),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(s.startswith(("(", "0"))),
        sum(c in " -./()" for c in s),
        float(ahead.isalnum() or ahead in "#$€£%"),
        float(behind.isalnum() or behind in "%€$"),
        sum(c in before for c in _CUES[kind]),
        sum(c in after for c in _CUES[kind]),
        sum(c in before for c in _AGAINST),
        float(before.rstrip().endswith((":", "=", "#"))),
        sum(s.lower().count(c) for c in ("dot", "at)", "at]", "[.]", "(.)")),
        float(s.startswith("00")),
        max((len(w) for w in re.split("[^A-Za-z0-9-]+", s)), default=0),
    ]


def _examples(seed: int = 11, n: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of built examples."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9))))

    def card(sep: str) -> str:
        body = pick("3456") + d(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        s = body + last
        return sep.join(s[k : k + 4] for k in range(0, 16, 4))

    def sensitive(kind: int) -> str:
        if kind == 0:
            return f"{word()}{pick([' at ', '(at)', '[at]', ' (at) ', ' [at] '])}{word()}{pick([' dot ', '(dot)', '[dot]', '.'])}{pick(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == 1:
            return ":".join("".join(pick("0123456789abcdef") for _ in range(4)) for _ in range(8))
        if kind == 2:
            return card(pick([" ", "-", ".", ""]))
        return pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(6)}"])

    def harmless(kind: int) -> str:
        if kind == 0:
            return f"{word()} at {word()}. {word()}"
        if kind == 1:
            return ":".join(d(2) for _ in range(8))
        if kind == 2:
            return pick([d(16), d(13), d(14), d(19), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4))])
        return pick([f"{d(2)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)}/{d(4)}-{d(4)}", f"0{d(3)}-{d(6)}", f"{d(3)} {d(3)} {d(4)}"])

    xs, ys = [], []
    for _ in range(n):
        kind = int(rng.integers(4))
        yes = bool(rng.integers(2))
        s = sensitive(kind) if yes else harmless(kind)
        plain = " ".join(word() for _ in range(5))
        if yes:
            lead = f"{plain} {pick(_CUES[kind])}{pick([': ', ' ', ' is ', '= ', ' no. '])}"
        else:
            lead = f"{plain} {pick([*_AGAINST, '', '', '', '', '', '', pick(_CUES[kind]) + ' ' + word() + ' ' + word() + ' ' + word()])}{pick([' ', ': ', ' #'])}"
        text = f"{lead}{s} {' '.join(word() for _ in range(5))}"
        start = len(lead)
        found = [c for c in candidates(text) if c[0] == kind and c[1] < start + len(s) and c[2] > start]
        for k, a, b in found:
            xs.append(features(text, k, a, b))
            ys.append(float(yes))
    return np.array(xs), np.array(ys)


def ways(kind: int, s: str) -> list[str]:
    """A base span written in other ways, which the fixed patterns do not know."""
    if kind == 0:
        local, domain = s.split("@")
        return [local + at + domain.replace(".", dot) for at in (" at ", "(at)", "[at]", " (at) ", " [at] ") for dot in (" dot ", "(dot)", "[dot]", " [dot] ")]
    if kind == 1:
        return [s.replace(".", dot) for dot in ("[.]", "(.)", "[dot]", " dot ")]
    digits = _digits(s)
    if kind == 2:
        return [".".join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    tail = digits[-10:]
    abroad = [form for at in (1, 2, 3) for form in (f"00{digits[:at]} {digits[at:]}", f"00{digits[:at]} {digits[at : at + 3]} {digits[at + 3 :]}")]
    return [*abroad, f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"]


def rewritten(kind: int, s: str, pick) -> str:
    """One of the ways."""
    return pick(ways(kind, s))


def _apart(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidates that overlap no base span."""
    starts, ends = [], []  # of the base spans' union
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [c for c in found if not (k := bisect_right(starts, c[2] - 1)) or ends[k - 1] <= c[1]]


def _unsure(text: str) -> list[tuple[int, int, int]]:
    """Matches of the fixed patterns that were dropped for too many digits: two numbers in a row, of which one may be real."""
    found = [(kind, *m.span()) for kind, pattern in ((2, _CARD), (3, _PHONE)) for m in pattern.finditer(text)]
    return [(kind, a, b) for kind, a, b in found if b - a > 15 and len(_digits(text[a:b])) > (19 if kind == 2 else 15)]


def text_examples(text: str) -> Iterator[tuple[bool, list[float]]]:
    """(sensitive, features) of base spans in all ways where they stand, and of all other candidates."""
    base = base_spans(text)
    for kind, a, b in base:
        before, after, start = text[max(0, a - 2 * CONTEXT) : a], text[b : b + 2 * CONTEXT], min(a, 2 * CONTEXT)
        for new in ways(kind, text[a:b]):
            window = f"{before}{new}{after}"
            for c in candidates(window):
                if c[0] == kind and c[1] < start + len(new) and c[2] > start:
                    yield True, features(window, *c)
    found = candidates(text)
    for c in _apart(found, [*base, *_unsure(text)]) if found else ():
        yield False, features(text, *c)


def _blank() -> Boosted:
    """Untrained trees. Bins are fixed: whole numbers to 62 and what is over, shares in steps of 1/62."""
    width, share = len(features("", 0, 0, 0)), 3
    return Boosted([np.arange(63) / (62 if k == share else 1) for k in range(width)])


def examples(docs: DataFrame) -> DataFrame:
    """(kept_out, sensitive, features, n): the different binned examples of all whole texts of docs(text), and how many there are.

    A third of the different texts by a hash are kept out of training; copies of a text stay together.
    """
    text = F.col("text").cast("string")
    kept_out = F.pmod(F.xxhash64(text, F.lit(29)), F.lit(3)) == 0
    texts = modest_batches(docs).where("text is not null").select(kept_out.alias("kept_out"), text.alias("text"))
    trees = _blank()

    def passed_on(counted: Counter) -> pa.RecordBatch:
        kept, sensitive, bins = zip(*counted, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kept), pa.array(sensitive), pa.array(bins, pa.binary()), pa.array(counted.values(), pa.int64())], ["kept_out", "sensitive", "features", "n"])

    def run(batches):
        counted: Counter = Counter()
        marks: list[tuple[bool, bool]] = []
        rows: list[list[float]] = []

        def count() -> None:
            if rows:
                counted.update((*mark, bins.tobytes()) for mark, bins in zip(marks, trees.binned(np.array(rows)), strict=True))
            marks.clear()
            rows.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                kept = batch.column(0)[at].as_py()
                for sensitive, row in text_examples(batch.column(1)[at].as_py()):
                    marks.append((kept, sensitive))
                    rows.append(row)
                    if len(rows) == 4096:
                        count()
                        if len(counted) > COUNTED:
                            yield passed_on(counted)
                            counted.clear()
        count()
        if counted:
            yield passed_on(counted)

    found = texts.mapInArrow(run, "kept_out boolean, sensitive boolean, features binary, n long")
    return found.groupBy("kept_out", "sensitive", "features").agg(F.sum("n").alias("n"))


def _thresholds(trees: Boosted, kept: Rows) -> np.ndarray:
    """For each kind the least threshold, LEAST or more, of PRECISION on the examples kept out of training."""
    weight = np.zeros((2, len(KINDS) * GRID))
    for _, block in kept.blocks():
        step = np.minimum((trees.probability_binned(block["b"]) * GRID).astype(np.int64), GRID - 1)
        cell = block["b"][:, 0].astype(np.int64) * GRID + step
        for label in (0, 1):
            weight[label] += np.bincount(cell, block["w"] * (block["y"] == label), len(KINDS) * GRID)
    thresholds = np.ones(len(KINDS))
    for kind, (no, yes) in enumerate(zip(*weight.reshape(2, len(KINDS), GRID), strict=True)):
        over_no, over_yes = np.cumsum(no[::-1])[::-1], np.cumsum(yes[::-1])[::-1]
        good = np.flatnonzero((no + yes > 0) & (over_yes >= PRECISION * (over_no + over_yes)))
        if len(good):
            thresholds[kind] = max(LEAST, good[0] / GRID)
    return thresholds


def _trained(mine: Rows, kept: Rows) -> tuple[Boosted, np.ndarray]:
    """Trees and thresholds of the rows to learn from, those kept out, and built examples."""
    trees = _blank()
    x, y = _examples()
    b, cut = trees.binned(x), len(x) * 2 // 3
    mine.add(b[:cut], y[:cut], np.ones(cut))
    kept.add(b[cut:], y[cut:], np.ones(len(x) - cut))
    return trees.fit(mine), _thresholds(trees, kept)


def _rows() -> Rows:
    return Rows(len(_blank().edges))


@lru_cache
def model() -> tuple[Boosted, np.ndarray]:
    """Trees and thresholds from built examples alone."""
    return _trained(_rows(), _rows())


def fit(docs: DataFrame) -> tuple[Boosted, np.ndarray]:
    """Trees and thresholds from built examples and from all whole texts of docs(text).

    The different examples go to a file of the driver in a fixed order, so repeated fits are equal.
    The weight of a kind's examples of one label does not depend on their number.
    """
    table = runtime.cut(examples(docs), "pii-examples")

    def packed(batches):
        for batch in batches:
            kept, sensitive, n = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1, 3))
            bins = np.array([np.frombuffer(x, np.uint8) for x in batch.column(2).to_pylist()], np.uint8)
            for side in np.unique(kept):
                at = kept == side
                yield pa.RecordBatch.from_arrays([pa.array([bool(side)]), *(pa.array([x[at].tobytes()], pa.binary()) for x in (sensitive.astype(np.uint8), bins, n.astype(np.int64)))], ["kept_out", "sensitive", "features", "n"])

    sides = _rows(), _rows()
    weight = np.zeros((2, len(KINDS), 2))
    width = len(_blank().edges)
    in_order = table.orderBy("kept_out", "sensitive", "features").mapInArrow(packed, "kept_out boolean, sensitive binary, features binary, n binary")
    for r in in_order.toLocalIterator():
        y, b, n = np.frombuffer(r.sensitive, np.uint8), np.frombuffer(r.features, np.uint8).reshape(-1, width), np.frombuffer(r.n, np.int64)
        sides[r.kept_out].add(b, y, n)
        np.add.at(weight[int(r.kept_out)], (b[:, 0], y), n)
    runtime.forget(table)
    for rows, total in zip(sides, weight, strict=True):
        for at, block in rows.blocks():
            block["w"] *= EXAMPLES / len(KINDS) / total[block["b"][:, 0], block["y"].astype(np.int64)]
            rows.put(at, block)
    return _trained(*sides)


def added_spans(text: str, base: list[tuple[int, int, int]], trees: Boosted, thresholds: np.ndarray) -> list[tuple[int, int, int]]:
    """Candidates that the trees select, best first, none over a base span or over a better one."""
    found = candidates(text)
    if not found:
        return []
    found = _apart(found, base)
    if not found:
        return []
    p = trees.probability(np.array([features(text, *c) for c in found]))
    out = []
    for k in np.argsort(-p, kind="stable"):
        kind, a, b = found[k]
        if p[k] >= thresholds[kind] and not any(a < y and b > x for _, x, y in out):
            out.append((kind, a, b))
    return out


def written(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, fitted: tuple[Boosted, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs(doc_id, text).

    fitted: what `fit` gives; without it, the trees of built examples.
    """
    texts = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trees, thresholds = fitted or model()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, hashes, spans, added = [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    more = added_spans(text, base, trees, thresholds)
                    counts.append([sum(s[0] == k for s in base) for k in range(4)])
                    hashes.append(hashlib.sha256(written(base, KINDS).encode()).hexdigest())
                    spans.append(written(sorted(base + more), KINDS))
                    added.append(len(more))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(hashes), pa.array(spans), pa.array(added, pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str, label: str = "[{}]") -> str:
    """The text with the written spans replaced by their kind; overlapping spans are one."""
    cuts: list[list] = []
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda s: s[1:]):
        if cuts and a < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], b)
        else:
            cuts.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in cuts:
        out += [text[at:a], label.format(kind.upper())]
        at = b
    return "".join([*out, text[at:]])
