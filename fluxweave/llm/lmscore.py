"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case (A-Z), each spelled byte by byte and closed by a blank, and
then an end sign. Each byte is eight binary decisions. The context of a decision is the
decided bits and the bytes before it in the text, none to DEPTH of them, across blanks (zeros
stand before a text's first byte), so each prefix of bits has a context tree of its own. A node's
Krichevsky-Trofimov estimate is mixed with its deeper contexts by half each, at all depths:
P(node) = (KT(node) + product of P(children)) / 2. The trained tree predicts a decision by
mixing the estimates on its path with the posterior weights. The score is the log10
probability of the whole text; divided by its bytes it is the code length for a byte.

How it runs: blocks of some MB of text are reduced to distinct words and to distinct
(context, next byte) pairs over all their bytes, 64 bits each, with counts. They send these,
packed, to buckets of words and of contexts; a bucket holds whole subtrees, those below the
STEM nearest bytes of the context. More than FAN blocks are pooled in groups of FAN first, as
often as it takes, so a bucket receives FAN messages at most, and the answers go back the
same way. Each bucket weighs its subtrees, the nodes at depth STEM meet by their nearest byte
(65,536 contexts at most), and those of depth LIMB in one group (256 contexts at most), so no
task but the buckets grows with the input, and buckets grow in number. All training tokens
count; nothing is pruned. Answers are float32: each byte's log is rounded by 6e-8 of itself.

Null texts are empty: the end sign alone. Rows with a null doc_id belong to no held-out
fold. Rows are scored each for itself; equal texts have equal scores. Without any training
text every decision has probability 1/2 and no token is known. With crossing=False contexts
end at a word's start and the end sign has none, the model of single words.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm import textkit as tk
from fluxweave.runtime import cut

DEPTH = 7  # bytes of context; with the next byte they fill 64 bits
STEM = 3  # depth at which the buckets' subtrees begin
LIMB = 1  # depth at which the groups over them begin
BLOCK_CHARS = 16 << 20
FAN = 64  # most messages that meet in one group
BUCKETS = 16  # buckets for the square root of the number of blocks
_END = 0x0A
_MESSAGE = "kind int, block long, bucket long, data binary"
_META = -1
_LEVEL = 1  # of zstandard, for messages


# --- vocabulary of a block -------------------------------------------------------------


class _Vocabulary:
    """Distinct words of a block by ascending hash, and how often training has them."""

    def __init__(self, table: pa.Table):
        text = table.column("text").combine_chunks()
        train = ~np.array(table.column("held_out").to_pylist(), bool)
        self.train_docs = int(train.sum())
        hashes, counts = [], []
        self.rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # lo, hi, first words of rows, words' places in `hash`
        for found in tk.words(text, tk.SPACES_LOWER):
            self.rows.append((found.lo, found.hi, found.first, np.zeros(0, np.int64)))
            if not len(found.starts):
                continue
            u, inverse = np.unique(found.hashes(), return_inverse=True)
            weight = np.repeat(train[found.lo : found.hi], np.diff(found.first))
            hashes.append(u)
            counts.append(np.bincount(inverse, weight, len(u)).astype(np.int64))
            self.rows[-1] = (found.lo, found.hi, found.first, inverse + sum(map(len, hashes[:-1])))
        if not hashes:
            self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        self.hash, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        self.count = np.bincount(inverse, np.concatenate(counts), len(self.hash)).astype(np.int64)
        self.rows = [(lo, hi, first, inverse[at]) for lo, hi, first, at in self.rows]


def _pairs(text: pa.Array, crossing: bool):
    """Of a few MB of rows at a time: lo, hi, (context, next byte) of every byte, each row's first place and the end.

    The nearest byte of the context is the highest, so contexts of any depth are runs of sorted pairs.
    """
    for found in tk.words(text, tk.SPACES_LOWER):
        rows, size, words = found.hi - found.lo, found.ends - found.starts, len(found.starts)
        # Units are words with their blank, and each row's end sign; zeros stand before those that see no context.
        end_at = found.first[1:] + np.arange(rows)
        unit = np.ones(words + rows, np.int64)
        is_word = np.ones(words + rows, bool)
        is_word[end_at] = False
        unit[is_word] = size + 1
        fresh = found.first[:-1] + np.arange(rows) if crossing else np.arange(words + rows)
        gap = np.zeros(words + rows, np.int64)
        gap[fresh] = DEPTH
        begin = np.cumsum(unit + gap) - unit
        total = int(begin[-1] + unit[-1]) if rows else 0
        valid = np.ones(total, bool)
        valid[(begin[fresh][:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
        inside = valid.copy()
        blanks, ends = begin[is_word] + size, begin[end_at]
        inside[blanks] = False
        inside[ends] = False
        data = np.frombuffer(found.data, np.uint8)
        byte = np.zeros(total + 8, np.uint8)  # after eight zeros
        byte[8:][inside] = data[data != 32]
        byte[8:][blanks] = 32
        byte[8:][ends] = _END
        key = np.ndarray((total,), "<u8", byte, strides=(1,)) & np.uint64(((1 << 8 * DEPTH) - 1) << (64 - 8 * DEPTH))
        key |= byte[8:]
        yield found.lo, found.hi, key[valid], np.append(0, np.cumsum(size + 1))[found.first] + np.arange(rows + 1)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their weights' sums."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(_heads(keys))
    return keys[heads], np.add.reduceat(weights, heads)


def _heads(x: np.ndarray) -> np.ndarray:
    """Whether each entry of a sorted array is the first of its value."""
    heads = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=heads[1:])
    return heads


def _counted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs; the array given is sorted."""
    every.sort()
    heads = np.flatnonzero(_heads(every))
    return every[heads], np.diff(np.append(heads, len(every)))


def _block_pairs(table: pa.Table, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a block, ascending, with how often training has them."""
    held_rows = np.array(table.column("held_out").to_pylist(), bool)
    text = table.column("text").combine_chunks()
    offsets, _ = tk.buffers(text)
    every = np.empty(int(offsets[-1] - offsets[0]) + 2 * len(text), np.uint64)  # one for each byte, blank and end at most
    held, n = [], 0
    for lo, hi, key, first in _pairs(text, crossing):
        every[n : n + len(key)] = key
        n += len(key)
        held.append(key[np.repeat(held_rows[lo:hi], np.diff(first))])
    keys, count = _counted(every[:n])
    del every
    others, more = _counted(np.concatenate(held) if held else np.zeros(0, np.uint64))
    count[np.searchsorted(keys, others)] -= more
    return keys, count


# --- weighting -------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_TABLE = 1 << 16
_HALVES, _WHOLES = log_gamma(np.arange(_TABLE) + 0.5), log_gamma(np.arange(_TABLE) + 1.0)


def _tabled(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """ln Gamma(n + shift) for whole numbers n."""
    out = table.take(np.minimum(n, _TABLE - 1).astype(np.int64))
    large = np.flatnonzero(n >= _TABLE)
    if len(large):
        out[large] = log_gamma(n[large] + shift)
    return out


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _tabled(n0, _HALVES, 0.5) + _tabled(n1, _HALVES, 0.5) - _tabled(n0 + n1, _WHOLES, 1.0) - np.log(np.pi)


class _Level:
    """Nodes of one depth for one bit of the byte: sorted ids, counts, weight of their own estimate."""

    def __init__(self, depth: int, bit: int, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, inverse: np.ndarray):
        self.depth, self.bit, self.ids, self.n0, self.n1, self.inverse = depth, bit, ids, n0, n1, inverse

    @classmethod
    def deepest(cls, keys: np.ndarray, weights: np.ndarray, bit: int) -> _Level:
        """Of ascending keys: the whole context and the bits decided before this one."""
        ids, ones = keys & ~np.uint64(0xFF) | (keys & np.uint64(0xFF)) >> np.uint64(8 - bit), (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        heads = _heads(ids)
        inverse = np.cumsum(heads) - 1
        n = int(heads.sum())
        return cls(DEPTH, bit, ids[heads], np.bincount(inverse, weights * ~ones, n), np.bincount(inverse, weights * ones, n), inverse.astype(np.int32))

    def above(self) -> tuple[_Level, np.ndarray]:
        """The level over this one, and the place there of each node's parent."""
        depth = self.depth - 1
        mask = (((1 << 8 * depth) - 1) << (64 - 8 * depth) if depth else 0) | 0xFF
        ids, at = np.unique(self.ids & np.uint64(mask), return_inverse=True)
        up = _Level(depth, self.bit, ids, np.bincount(at, self.n0, len(ids)), np.bincount(at, self.n1, len(ids)), at.astype(np.int32)[self.inverse])
        return up, at

    def weigh(self, at: np.ndarray | None = None, below_log: np.ndarray | None = None) -> np.ndarray:
        """ln P of each node; keeps the posterior weight of its own estimate and that estimate of a one. at: places of the nodes below."""
        own = kt_block(self.n0, self.n1)
        self.one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)
        if at is None:
            self.share = np.ones(len(own))
            return own
        deep = np.bincount(at, below_log, len(own))
        self.share = 1 / (1 + np.exp(np.clip(deep - own, -700, 700)))
        return np.logaddexp(own, deep) - np.log(2)


def _chains(keys: np.ndarray, weights: np.ndarray, top: int):
    """For each bit the levels from DEPTH up to `top`, and ln P at `top`; one bit at a time is held."""
    for bit in range(8):
        chain = [_Level.deepest(keys, weights, bit)]
        log = chain[0].weigh()
        while chain[-1].depth > top:
            up, at = chain[-1].above()
            log = up.weigh(at, log)
            chain.append(up)
        yield chain, log


def weighted_levels(keys: np.ndarray, weights: np.ndarray, top: int) -> tuple[list[list[_Level]], list[np.ndarray]]:
    """All of _chains at once."""
    found = list(_chains(keys, weights, top))
    return [chain for chain, _ in found], [log for _, log in found]


def pair_logs(keys: np.ndarray, levels: Iterable[list[_Level]], above: list[tuple[np.ndarray, np.ndarray]] | None) -> np.ndarray:
    """ln P(next byte | context) of each key. above: for each bit, what the levels over the subtree add and keep."""
    out = np.zeros(len(keys))
    for bit, chain in enumerate(levels):
        p = chain[0].one[chain[0].inverse]
        for level in chain[1:]:
            share = level.share[level.inverse]
            p = share * level.one[level.inverse] + (1 - share) * p
        if above is not None:
            add, keep = above[bit]
            p = add[chain[-1].inverse] + keep[chain[-1].inverse] * p
        ones = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        out += np.log(np.where(ones, p, 1 - p))
    return out


# --- messages --------------------------------------------------------------------------


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _runs(bucket: np.ndarray):
    """Bucket and places of all its keys, in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)]), len(order))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(sorted_[a]), order[a:b]


def _packed(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """First bytes of all keys, then second bytes and so on, then those of the weights: sorted keys and small counts shrink."""
    import zstandard

    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T) for x in (keys, weights)]
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.concatenate(planes).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 8, -1)
    keys, weights = (np.ascontiguousarray(x.T).view(kind).ravel() for x, kind in zip(both, (np.uint64, np.int64), strict=True))
    return keys, weights


def _pooled(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys with weights over all messages, and each message's keys."""
    parts = [_unpacked(x.as_py()) for x in table.column("data")]
    keys, weights = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return keys, weights, [p[0] for p in parts]


def _answers(table: pa.Table, keys: np.ndarray, values: np.ndarray, parts: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
    """Each message's values, in the order of its keys."""
    names = zip(*(table.column(c).to_pylist() for c in ("kind", "block", "bucket")), strict=True)
    return [(*name, values[np.searchsorted(keys, p)].tobytes()) for name, p in zip(names, parts, strict=True)]


def _merge(table: pa.Table) -> pa.Table:
    """Messages of a group of blocks as one."""
    keys, weights, _ = _pooled(table)
    return _rows([(table.column("kind")[0].as_py(), table.column("group")[0].as_py(), table.column("bucket")[0].as_py(), _packed(keys, weights))])


def _share(kind: type):
    """The answer to a group's message, dealt to the messages it was merged from."""

    def share(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(table) or not len(answer):
            return _rows([])
        keys, _, parts = _pooled(table)
        return _rows(_answers(table, keys, np.frombuffer(answer.column("data")[0].as_py(), kind), parts))

    return share


def _gathered(sent: DataFrame, blocks: int) -> tuple[DataFrame, list[DataFrame]]:
    """Messages of FAN groups of blocks at most, and the messages of each round before, with their group."""
    rounds = []
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        grouped = cut(sent.withColumn("group", F.pmod(F.col("block"), F.lit(blocks))), "messages")
        rounds.append(grouped)
        sent = grouped.groupBy("group", "bucket").applyInArrow(_merge, _MESSAGE)
    return sent, rounds


def _returned(answers: DataFrame, rounds: list[DataFrame], kind: type) -> DataFrame:
    """Answers to the blocks, from those to groups of them."""
    for grouped in reversed(rounds):
        answers = grouped.groupBy("group", "bucket").cogroup(answers.groupBy("block", "bucket")).applyInArrow(_share(kind), _MESSAGE)
    return answers


# --- the tree over the buckets -----------------------------------------------------------


def _written(bits: list[tuple[np.ndarray, ...]]) -> bytes:
    """Columns of eight bytes an entry, for each bit."""
    return b"".join(np.array([len(columns[0])], np.int64).tobytes() + b"".join(c.tobytes() for c in columns) for columns in bits)


def _read(data: bytes, kinds: tuple) -> list[tuple[np.ndarray, ...]]:
    out, at = [], 0
    for _ in range(8):
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(tuple(np.frombuffer(data, kind, n, at + 8 + 8 * n * k) for k, kind in enumerate(kinds)))
        at += 8 + 8 * n * len(kinds)
    return out


_NODES = (np.uint64, np.float64, np.float64, np.float64)  # ids, zeros, ones, ln P
_ABOVE = (np.float64, np.float64)  # what the levels above add to a prediction, and what they keep of it


def _stems(table: pa.Table) -> pa.Table:
    """A bucket's nodes at depth STEM, for each nearest byte."""
    keys, weights, _ = _pooled(table)
    by_limb: dict[int, list] = {}
    for bit, (chain, log) in enumerate(_chains(keys, weights.astype(float), STEM)):
        top = chain[-1]
        for limb, at in _runs((top.ids >> np.uint64(64 - 8 * LIMB)).astype(np.int64)):
            by_limb.setdefault(limb, [(np.zeros(0, np.uint64), *[np.zeros(0)] * 3)] * 8)
            by_limb[limb] = [*by_limb[limb][:bit], (top.ids[at], top.n0[at], top.n1[at], log[at]), *by_limb[limb][bit + 1 :]]
    bucket = table.column("bucket")[0].as_py()
    return _rows([(2, limb, bucket, _written(bits)) for limb, bits in sorted(by_limb.items())])


def _climbed(nodes: list[tuple[np.ndarray, ...]], bit: int, depth: int, root: int) -> tuple[np.ndarray, list[_Level], np.ndarray]:
    """Order of the nodes of all senders, the levels over them up to `root`, and ln P there."""
    ids, n0, n1, log = (np.concatenate(c) for c in zip(*nodes, strict=True))
    order = np.argsort(ids)
    level, log, levels = _Level(depth, bit, ids[order], n0[order], n1[order], np.arange(len(ids))), log[order], []
    while level.depth > root:
        level, at = level.above()
        log = level.weigh(at, log)
        levels.append(level)
    return order, levels, log


def _limbs(table: pa.Table) -> pa.Table:
    """The nodes at depth LIMB over all buckets' nodes."""
    sent = [_read(x.as_py(), _NODES) for x in table.column("data")]
    bits = []
    for bit in range(8):
        _, levels, log = _climbed([s[bit] for s in sent], bit, STEM, LIMB)
        bits.append((levels[-1].ids, levels[-1].n0, levels[-1].n1, log))
    return _rows([(2, table.column("block")[0].as_py(), 0, _written(bits))])


def _lowered(sent: list[list[tuple[np.ndarray, ...]]], depth: int, root: int, above: list[tuple[np.ndarray, ...]] | None) -> list[bytes]:
    """For each sender what the levels over its nodes add and keep."""
    answers: list[list] = [[] for _ in sent]
    for bit in range(8):
        order, levels, _ = _climbed([s[bit] for s in sent], bit, depth, root)
        add, keep = np.zeros(len(order)), np.ones(len(order))
        for level in levels:
            share = level.share[level.inverse]
            add = share * level.one[level.inverse] + (1 - share) * add
            keep = keep * (1 - share)
        if above is not None:
            more, kept = (x[levels[-1].inverse] for x in above[bit])
            add, keep = more + kept * add, kept * keep
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        for k, mine in enumerate(np.split(back, np.cumsum([len(s[bit][0]) for s in sent])[:-1])):
            answers[k].append((add[mine], keep[mine]))
    return [_written(a) for a in answers]


def _root(table: pa.Table) -> pa.Table:
    """What the root adds to and keeps of the nodes at depth LIMB."""
    answers = _lowered([_read(x.as_py(), _NODES) for x in table.column("data")], LIMB, 0, None)
    return _rows([(3, limb, 0, data) for limb, data in zip(table.column("block").to_pylist(), answers, strict=True)])


def _stem_answers(table: pa.Table, root: pa.Table) -> pa.Table:
    """The same for the buckets' nodes at depth STEM."""
    if not len(table) or not len(root):
        return _rows([])
    answers = _lowered([_read(x.as_py(), _NODES) for x in table.column("data")], STEM, LIMB, _read(root.column("data")[0].as_py(), _ABOVE))
    limb = table.column("block")[0].as_py()
    return _rows([(3, limb, bucket, data) for bucket, data in zip(table.column("bucket").to_pylist(), answers, strict=True)])


def _pair_answers(table: pa.Table, above: pa.Table) -> pa.Table:
    """For each message's pairs their ln P."""
    if not len(table) or not len(above):
        return _rows([])
    keys, weights, parts = _pooled(table)
    by_limb = [_read(x, _ABOVE) for _, x in sorted(zip(above.column("block").to_pylist(), above.column("data").to_pylist(), strict=True))]
    joined = [tuple(np.concatenate([limb[bit][k] for limb in by_limb]) for k in range(2)) for bit in range(8)]
    logs = pair_logs(keys, (c for c, _ in _chains(keys, weights.astype(float), STEM)), joined).astype(np.float32)
    return _rows(_answers(table, keys, logs, parts))


def _word_answers(table: pa.Table) -> pa.Table:
    """For each message's words their counts in training, and the bucket's totals."""
    words, counts, parts = _pooled(table)
    bucket = table.column("bucket")[0].as_py()
    return _rows([*_answers(table, words, counts, parts), (0, _META, bucket, np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes())])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double, n_bytes long, part_tokens long, part_words long"


def score(docs: DataFrame, held_out: str, crossing: bool = False) -> DataFrame:
    """Rows of the contract for docs(doc_id, text) and a boolean column that marks rows kept out of training."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    total, train_docs = texts.agg(F.sum(F.length("text")), F.count_if(~F.col("held_out"))).first()
    blocks = max(1, -(-(total or 0) // BLOCK_CHARS))
    buckets = int(np.ceil(BUCKETS * np.sqrt(blocks)))
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text", "held_out")

    def ranges(h: np.ndarray) -> np.ndarray:
        return (tk.mix(h) % np.uint64(buckets)).astype(np.int64)

    def stems(keys: np.ndarray) -> np.ndarray:
        return ranges(keys >> np.uint64(64 - 8 * STEM))

    def send_words(table: pa.Table) -> pa.Table:
        v, block = _Vocabulary(table), table.column("block")[0].as_py()
        return _rows([(0, block, k, _packed(v.hash[at], v.count[at])) for k, at in _runs(ranges(v.hash))])

    def send_pairs(table: pa.Table) -> pa.Table:
        keys, weights = _block_pairs(table, crossing)
        block = table.column("block")[0].as_py()
        return _rows([(1, block, k, _packed(keys[at], weights[at])) for k, at in _runs(stems(keys))])

    def pair_scores(table: pa.Table, said: dict[tuple[int, int], bytes]) -> tuple[list, list]:
        """Score and bytes of each row."""
        text = table.column("text").combine_chunks()
        keys, _ = _block_pairs(table, crossing)
        logs = np.zeros(len(keys), np.float32)
        for k, at in _runs(stems(keys)):
            logs[at] = np.frombuffer(said[1, k], np.float32)
        scores, sizes = [], []
        for _, _, key, first in _pairs(text, crossing):
            order = np.argsort(key)
            sorted_ = key[order]
            heads = _heads(sorted_)
            value = np.empty(len(key))
            value[order] = logs[np.searchsorted(keys, sorted_[heads])][np.cumsum(heads) - 1]
            scores += (np.add.reduceat(value, first[:-1]) / np.log(10)).tolist()
            sizes += np.diff(first).tolist()
        return scores, sizes

    def score_block(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns: dict[str, list] = {x.split()[0]: [] for x in _SCORED.split(", ")}
        if not len(table):  # totals of the word buckets
            for x in answers.column("data").to_pylist():
                tokens, words = np.frombuffer(x, np.int64)
                for name in columns:
                    columns[name].append({"part_tokens": int(tokens), "part_words": int(words)}.get(name))
        else:
            said = {(k, b): x for k, b, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True)}
            columns["score"], columns["n_bytes"] = pair_scores(table, said)
            v = _Vocabulary(table)
            count = np.zeros(len(v.hash), np.int64)
            for k, at in _runs(ranges(v.hash)):
                count[at] = np.frombuffer(said[0, k], np.int64)
            base, known = np.log10(count + 0.1), (count > 0).astype(np.int64)
            ids, held = table.column("doc_id").to_pylist(), table.column("held_out").to_pylist()
            sums = lambda x, first: (lambda c: c[first[1:]] - c[first[:-1]])(np.append(0, np.cumsum(x)))
            for lo, hi, first, at in v.rows:
                columns["doc_id"] += ids[lo:hi]
                columns["held_out"] += held[lo:hi]
                columns["n_tokens"] += (np.diff(first) + 1).tolist()
                columns["n_known"] += (sums(known[at], first) + (train_docs > 0)).tolist()
                columns["base_log"] += (sums(base[at], first) + np.log10(train_docs + 0.1)).tolist()
            for name in ("part_tokens", "part_words"):
                columns[name] = [None] * len(columns["doc_id"])
        kinds = {"held_out": pa.bool_(), "base_log": pa.float64(), "score": pa.float64()}
        return pa.table({name: pa.array(x, kinds.get(name, pa.int64())) for name, x in columns.items()})

    by_block = dealt.groupBy("block")
    words, word_rounds = _gathered(by_block.applyInArrow(send_words, _MESSAGE), blocks)
    counted = words.groupBy("bucket").applyInArrow(_word_answers, _MESSAGE)
    counted = _returned(counted.where(F.col("block") != _META), word_rounds, np.int64).unionByName(counted.where(F.col("block") == _META)) if word_rounds else counted
    pairs, pair_rounds = _gathered(by_block.applyInArrow(send_pairs, _MESSAGE), blocks)
    nodes = pairs.groupBy("bucket").applyInArrow(_stems, _MESSAGE)
    limbs = nodes.groupBy("block").applyInArrow(_limbs, _MESSAGE)
    root = limbs.groupBy("bucket").applyInArrow(_root, _MESSAGE)  # 256 rows at most
    above = nodes.groupBy("block").cogroup(root.groupBy("block")).applyInArrow(_stem_answers, _MESSAGE)
    logs = _returned(pairs.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_pair_answers, _MESSAGE), pair_rounds, np.float32)
    scored = cut(by_block.cogroup(counted.unionByName(logs).groupBy("block")).applyInArrow(score_block, _SCORED), "scored")
    found = scored.agg(F.sum("part_tokens"), F.sum("part_words")).first()
    n = (found[0] or 0) + train_docs
    v = (found[1] or 0) + (train_docs > 0)
    return scored.where("part_tokens is null").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
