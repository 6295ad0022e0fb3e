"""Token ids from a public tokenizer, and their binary files as directly addressable codes.

File format (.dac, little-endian). A file holds the ids of a run of documents, ascending
doc_id, those without a doc_id last; rows of one doc_id are in the order of their texts. An id is split into chunks of width[0], width[1], ... bits, lowest first. Level l
holds, for the ids that reach it, their chunks (bit-packed) and a continuation bitmap: bit i
says whether entry i goes on. A rank directory has the number of ones before each RANK_BITS
bits, so entry i of level l continues at entry rank(l, i) of level l + 1: any id is read
from the few words that hold it, without decoding a block. Widths are chosen per file from
the histogram of its ids, for the least size.

    magic "DACF", uint32 version, uint64 documents, uint64 ids, uint32 levels, uint64 unnamed
    int64 doc_id[documents] (0 for the last `unnamed` ones), uint64 begin[documents + 1]
    per level: uint8 width, uint64 entries, then chunks, bitmap (all but the last level), rank directory
"""

from __future__ import annotations

import re
import struct
import threading
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.llm.textkit import buffers, chunks, modest_batches
from fluxweave.runtime import cut, new_path

END_ID = 2
RANK_BITS = 512
FILE_IDS = 4_000_000
CACHE_WORDS = 400_000
CACHE_CHARS = 64  # longer pieces are not remembered, so the memory of pieces is bounded in bytes, too
CHUNK_BYTES = 3 << 20  # text encoded at once; a longer text alone
IDLE_SECONDS = 2.0  # a worker without text to encode gives its memory of pieces back
_MAGIC, _VERSION = b"DACF", 2

# A piece is white space followed by the rest up to the next white space. Both tokenizers
# cut there whatever follows, so equal pieces have equal ids. Texts with white space beyond
# ASCII, where runs of white space could span pieces, are encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _class_of(b: int) -> int:
    """Class of a byte: letters are those of ASCII and of U+00C0 to U+00FF; pieces with an odd byte are not cut further."""
    if b in b"\x09\x0a\x0b\x0c\x0d\x20":
        return _BLANK
    if 65 <= b <= 90 or 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3:
        return _LETTER
    return _DIGIT if 48 <= b <= 57 else _MARK if 0x21 <= b <= 0x7E and b != 0x27 else _ODD


_CLASSES = bytes(map(_class_of, range(256)))
_SIGNS = re.compile(b"\xc3[\x97\xb7]")  # the two of those characters that are no letters

#: Pieces of these characters alone are cut below as the vocabularies' own patterns cut them.
_SIMPLE = re.compile("[\x20-\x7eÀ-ÖØ-öø-ÿ]+")
_SPECIAL = "'s|'t|'re|'ve|'m|'ll|'d"  # endings that both patterns name, fixed values
_LOWER_PARTS = re.compile(_SPECIAL + "|[a-zß-öø-ÿ]+|[0-9]|[^\x20a-z0-9ß-öø-ÿ]+")
_BLANK_PARTS = re.compile(_SPECIAL + "|\x20?[A-Za-zÀ-ÖØ-öø-ÿ]+|\x20?[0-9]+|\x20?[^\x20A-Za-z0-9À-ÖØ-öø-ÿ]+")


class PieceEncoder:
    """Ids of whole texts; each distinct piece goes through the tokenizer once, while it is remembered.

    A chunk's pieces are told apart by Arrow's dictionary encoding, so Python sees each
    distinct one once; the ids are then gathered for all places at once.
    Two generations of `cache_words` pieces at most are remembered. A piece of common
    characters is put together from the ids of its words and marks; unknown words of letters
    are encoded many at once in one string, and the ids cut where the vocabulary marks the
    end (or the beginning) of a word.
    """

    def __init__(self, path: str, cache_words: int | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.brief: dict[str, bytes] = {}  # long pieces, for one chunk
        self.lock, self.timer = threading.Lock(), None
        self.most = cache_words or CACHE_WORDS
        n = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.word_end = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.byte_level = not self.word_end and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.mark = np.array([x.endswith("</w>") if self.word_end else x.startswith("Ġ") for x in names])
        # The same vocabulary for words of letters in normal form: nothing is left to normalise, and blanks part them.
        self.plain = Tokenizer.from_file(path)
        if self.word_end or self.byte_level:
            blanks = pre_tokenizers.WhitespaceSplit() if self.word_end else pre_tokenizers.Split(" ", "merged_with_next")
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _raw(self, pieces: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(c.ids, np.uint32).tobytes() for c in codes]

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters (each with one blank before it, if the vocabulary marks beginnings)."""
        text = " ".join(words) if self.word_end else "".join(words)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.mark[ids])
        edges = np.append(0, cuts + 1) if self.word_end else np.append(cuts, len(ids))
        if len(edges) != len(words) + 1:
            return self._raw(words)
        data, edges = ids.tobytes(), (edges * 4).tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that are not among the young ones; of long ones for this chunk only."""
        young, old = self.young, self.old
        words: list[str] = []  # of letters, for one string
        others: set[str] = set()
        made: list[tuple[str, list[str]]] = []
        simple = self.word_end or self.byte_level
        cut = (_LOWER_PARTS if self.word_end else _BLANK_PARTS).findall
        for piece in pieces:
            if (code := old.get(piece)) is not None:
                young[piece] = code
                continue
            # Most new pieces are words of letters (with a blank before them, if the vocabulary marks beginnings).
            word = piece if self.word_end else piece[1:] if simple and piece[0] == " " else ""
            if word.isalpha() and (word.isascii() or _SIMPLE.fullmatch(word) and (not self.word_end or word == word.lower())):
                words.append(piece)
                continue
            if not simple or not _SIMPLE.fullmatch(piece) or piece.endswith(" ") or "  " in piece:
                others.add(piece)
                continue
            parts = cut(piece.lower() if self.word_end else piece)
            if len(parts) != 1 or parts[0] != piece:
                made.append((piece, parts))
            for x in parts:
                if x not in young:
                    if (code := old.get(x)) is not None:
                        young[x] = code
                    else:
                        others.add(x)
        for some, how in ((words, self._many), (list(others), self._raw)):
            for at in range(0, len(some), 5_000):
                young.update(zip(some[at : at + 5_000], how(some[at : at + 5_000]), strict=True))
        for piece, parts in made:
            young[piece] = young[parts[0]] if len(parts) == 1 else b"".join([young[x] for x in parts])
        for new in (words, others, [x for x, _ in made]):
            for piece in new:
                if len(piece) > CACHE_CHARS and piece in young:
                    self.brief[piece] = young.pop(piece)

    def rest(self) -> None:
        """After a partition: keep what is remembered for the next one, but give it back if none follows soon."""
        self.timer = threading.Timer(IDLE_SECONDS, self.forget)
        self.timer.daemon = True
        self.timer.start()

    def forget(self) -> None:
        with self.lock:
            self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array for each text."""
        flat, edges = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, edges[1:-1])[: len(texts)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin (one more: the end). Nulls are empty."""
        if self.timer is not None:
            self.timer.cancel()
            self.timer = None
        with self.lock:
            flats, sizes = [], [np.zeros(1, np.int64)]
            offsets, _ = buffers(column)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                flat, size = self._encode(column.slice(lo, hi - lo))
                flats.append(flat)
                sizes.append(size)
            return np.concatenate(flats) if flats else np.zeros(0, np.uint32), np.cumsum(np.concatenate(sizes))

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some rows and how many each row has."""
        whole = {}
        for k, text in enumerate(column.to_pylist()):
            if text and ("<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and _OTHER_SPACE.search(text)):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if not whole:
            return self._by_pieces(column)
        rest = np.setdiff1d(np.arange(len(column)), list(whole))
        flat, size = self._by_pieces(column.take(pa.array(rest)))
        codes = dict(zip(rest.tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True)) if len(rest) else {}
        parts = [whole[k] if k in whole else codes[k] for k in range(len(column))]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _by_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text, begin, first = self._cut(column)
        edges = np.append(begin, len(text)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(text)).dictionary_encode()
        distinct, place = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young = self.young
        fresh = [p for p in distinct if p not in young]
        if fresh:
            self._learn(fresh)
        brief = self.brief
        codes = [young[p] if p in young else brief[p] for p in distinct] if brief else list(map(young.__getitem__, distinct))
        brief.clear()
        ids, size = np.frombuffer(b"".join(codes), np.uint32), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        mine = size[place]
        end = np.append(0, np.cumsum(mine))
        source = np.repeat((np.cumsum(size) - size)[place] - end[:-1], mine) + np.arange(end[-1])
        return ids[source], np.diff(end[first])

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, places in them where pieces begin, and each row's first piece (one more: how many there are).

        Pieces are cut at white space, and where the class of characters changes, as both
        vocabularies' patterns do. White space that is no single blank stays with what follows it.
        """
        at, data = buffers(column)
        data, at = bytes(data[at[0] : at[-1]]), at - at[0]
        kind = np.frombuffer(data.translate(_CLASSES), np.uint8)
        if _SIGNS.search(data):
            kind = kind.copy()
            for m in _SIGNS.finditer(data):
                kind[m.start() : m.end()] = _ODD
        solid = kind != _BLANK
        rows = np.zeros(len(data) + 1, bool)
        rows[at[:-1]] = True
        head = solid.copy()
        head[1:] &= ~solid[:-1] | rows[1:-1]
        inner = np.zeros(len(data), bool)
        inner[1:] = solid[1:] & solid[:-1] & (kind[1:] != kind[:-1])
        if self.word_end:  # one piece for each digit
            inner[1:] |= (kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT)
        inner &= ~head
        odd = np.flatnonzero(kind == _ODD)
        words = np.flatnonzero(head)
        keep = np.zeros(len(words), bool)  # words that stay whole
        if len(odd):
            keep[np.searchsorted(words, odd, "right") - 1] = True
            cuts = np.flatnonzero(inner)
            inner[cuts[keep[np.searchsorted(words, cuts, "right") - 1]]] = False
        if self.word_end:  # white space has no ids
            head |= inner
            text = np.frombuffer(data.translate(_LOWERED), np.uint8)[solid]
            return text, np.flatnonzero(head[solid]), np.searchsorted(np.flatnonzero(head), at)
        text = np.frombuffer(data, np.uint8)
        inner |= rows[:-1]
        inner[1:] |= ~solid[1:] & solid[:-1]
        after = words[~keep & (words > 0)]  # after a single line feed or tabulator, which is a piece of its own
        after = after[(text[after - 1] != 32) & ~solid[after - 1] & inner[after - 1]]
        inner[after] = True
        begin = np.flatnonzero(inner)
        return text, begin, np.searchsorted(begin, at)


def with_end(flat: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each closed by the end id."""
    return np.insert(flat, edges[1:], np.uint32(end_id)).astype("<u4", copy=False), edges + np.arange(len(edges))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, cache_words: int | None = None) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    _encoders[path].most = cache_words or CACHE_WORDS
    return _encoders[path]


@lru_cache
def _bit_rows(width: int) -> np.ndarray:
    """The bits of every number of so many bits, lowest first."""
    return ((np.arange(1 << width, dtype=np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)


def _group(width: int) -> int:
    """How many entries fill whole bytes within 64 bits; 0 if none do."""
    return 8 if width <= 8 else 4 if width % 2 == 0 and width <= 16 else 0


def _pack(values: np.ndarray, width: int) -> bytes:
    """Entries of so many bits each, lowest first."""
    if group := _group(width):
        words = np.zeros(-(-len(values) // group), "<u8")
        for k in range(group):
            part = values[k::group]
            words[: len(part)] |= part.astype(np.uint64) << np.uint64(k * width)
        data = words.view(np.uint8).reshape(-1, 8)[:, : group * width // 8].tobytes()
        return data[: -(-len(values) * width // 8)]
    parts = []
    for at in range(0, len(values), 1 << 18):  # a multiple of 8 entries, so parts end at whole bytes
        v = values[at : at + (1 << 18)].astype(np.uint32)
        rows = _bit_rows(width)[v] if width <= 12 else ((v[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
        parts.append(np.packbits(rows, bitorder="little").tobytes())
    return b"".join(parts)


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.uint32)
    out = np.empty(n, np.uint32)
    if group := _group(width):
        size = group * width // 8
        whole = np.zeros((-(-n // group), 8), np.uint8)
        raw = np.frombuffer(data, np.uint8, count=-(-n * width // 8))
        full = len(raw) // size
        whole[:full, :size] = raw[: full * size].reshape(full, size)
        if full < len(whole):
            whole[full, : len(raw) - full * size] = raw[full * size :]
        words = whole.view("<u8").ravel()
        for k in range(group):
            place = out[k::group]
            place[:] = (words[: len(place)] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
        return out
    for at in range(0, n, 1 << 18):
        m = min(1 << 18, n - at)
        begin = at * width // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=begin, count=-(-m * width // 8)), count=m * width, bitorder="little")
        rows = bits.reshape(m, width)
        value = np.zeros(m, np.uint32)
        for b in range(width):
            value |= rows[:, b].astype(np.uint32) << np.uint32(b)
        out[at : at + m] = value
    return out


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of the least size for these ids, by dynamic programming over bit positions."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    counts = np.bincount(ids, minlength=1 << top) if top <= 20 else None
    if counts is not None:  # ids by their number of bits
        bits = np.array([counts[(1 << b) >> 1 : 1 << b].sum() for b in range(top + 1)])
    else:
        bits = np.bincount(np.minimum(np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int), top), minlength=top + 1)
    reach = [int(bits[b + 1 :].sum()) if b else len(ids) for b in range(top + 1)]  # ids that have a bit at b or above
    cost, step = [0.0] * (top + 1), [0] * (top + 1)
    for b in range(top - 1, -1, -1):
        cost[b], step[b] = min((reach[b] * (w + (b + w < top) * (1 + 32 / RANK_BITS)) + cost[b + w], w) for w in range(1, top - b + 1))
    widths, b = [], 0
    while b < top:
        widths.append(step[b])
        b += step[b]
    return widths


def encode_file(doc_ids: np.ndarray, ids: list[np.ndarray], unnamed: int = 0) -> bytes:
    """The bytes of one file; the last `unnamed` documents have no doc_id."""
    return encode_flat(doc_ids, np.append(0, np.cumsum([len(x) for x in ids])), np.concatenate(ids) if ids else np.zeros(0, np.uint32), unnamed)


def encode_flat(doc_ids: np.ndarray, begin: np.ndarray, flat: np.ndarray, unnamed: int = 0) -> bytes:
    """The bytes of one file, from the ids of all documents one after the other."""
    widths = best_widths(flat)
    parts = [_MAGIC, struct.pack("<IQQIQ", _VERSION, len(doc_ids), len(flat), len(widths), unnamed), doc_ids.astype("<i8").tobytes(), begin.astype("<u8").tobytes()]
    rest = flat
    for level, width in enumerate(widths):
        parts += [struct.pack("<BQ", width, len(rest)), _pack(rest & np.uint32((1 << width) - 1), width)]
        if level < len(widths) - 1:
            more = (rest >> np.uint32(width)) > 0
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            parts += [bitmap.tobytes(), np.append(0, np.cumsum(ones)[:-1]).astype("<u4").tobytes() if len(more) else b""]
            rest = rest[more] >> np.uint32(width)
    return b"".join(parts)


class DacFile:
    """A file's bytes with random access to single ids and to documents."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a DAC file")
        version, docs, self.n, levels, self.unnamed = struct.unpack_from("<IQQIQ", data, 4)
        if version != _VERSION:
            raise ValueError(f"version {version} is unknown")
        at = 4 + struct.calcsize("<IQQIQ")
        self.data = data
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.begin = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for level in range(levels):
            width, entries = struct.unpack_from("<BQ", data, at)
            chunks = at + 9
            bitmap = chunks + -(-entries * width // 8)
            last = level == levels - 1
            ranks = bitmap if last else bitmap + -(-entries // 8)
            at = ranks if last else ranks + 4 * -(-entries // RANK_BITS)
            self.levels.append((width, entries, chunks, bitmap, ranks))

    def get(self, i: int) -> int:
        """The id at place i, read from the bytes that hold its chunks."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (width, _, chunks, bitmap, ranks) in enumerate(self.levels):
            bit = i * width
            word = int.from_bytes(self.data[chunks + bit // 8 : chunks + (bit + width + 7) // 8], "little")
            value |= (word >> bit % 8 & ((1 << width) - 1)) << shift
            shift += width
            if level == len(self.levels) - 1 or not self.data[bitmap + i // 8] >> i % 8 & 1:
                break
            block = i // RANK_BITS
            part = int.from_bytes(self.data[bitmap + block * RANK_BITS // 8 : bitmap + i // 8 + 1], "little")
            i = struct.unpack_from("<I", self.data, ranks + 4 * block)[0] + (part & ((1 << i - block * RANK_BITS) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.uint32)
        at, shift = None, 0
        for level, (width, entries, chunks, bitmap, _) in enumerate(self.levels):
            part = _unpack(memoryview(self.data)[chunks:bitmap], width, entries) << np.uint32(shift)
            if at is None:
                out |= part
            else:
                out[at] |= part
            if level < len(self.levels) - 1:
                more = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-entries // 8), bitmap), count=entries, bitorder="little").astype(bool)
                at = np.flatnonzero(more) if at is None else at[more]
            shift += width
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by random access."""
        return np.array([self.get(i) for i in range(int(self.begin[k]), int(self.begin[k + 1]))], np.uint32)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write files of ids under `out`, a folder all executors share; returns the list of files.

    (file, first_doc, part, documents, n_ids). Documents are range-partitioned and sorted by
    doc_id, nulls last, and then by text, so the order of repeated ids is the same each time.
    A task writes under names of its own and only the files that its successful
    attempt reports are listed, so a lost or repeated attempt leaves nothing that is read.
    Null texts are empty and have just the end id.
    """
    texts = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def write(batches):
        fs, base = _store(out)
        fs.create_dir(base, recursive=True)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n = part = 0

        def save():
            ids = pa.concat_arrays([h[0] for h in held])
            begin = np.append(0, np.cumsum(np.concatenate([np.diff(h[1]) for h in held])))
            name = f"{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(encode_flat(ids.fill_null(0).to_numpy(), begin, np.concatenate([h[2] for h in held]), ids.null_count))
            return pa.RecordBatch.from_pydict({"file": [name], "first_doc": ids[:1], "part": pa.array([part], pa.int32()), "documents": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for batch in batches:
            flat, edges = with_end(*encoder(vocabulary).encode_column(batch.column("text")), end_id)
            held.append((batch.column("doc_id"), edges, flat))
            n += len(flat)
            if n >= file_ids:
                yield save()
                held, n, part = [], 0, part + 1
        if held:
            yield save()
        encoder(vocabulary).rest()

    order = F.col("doc_id").asc_nulls_last()
    ordered = texts.repartitionByRange(order).sortWithinPartitions(order, "text")
    return cut(ordered.mapInArrow(write, "file string, first_doc long, part int, documents long, n_ids long"), "files")


def read_token_files(spark, out: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed files, read from their bytes.

    start needs the ids of all files before: a running sum over one row for each file.
    """
    before = Window.orderBy(F.col("first_doc").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).select("file", "base")
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(out)
    data = data.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(listed, "file")

    def decode(batches):
        for batch in batches:
            for content, base in zip(batch.column("content"), batch.column("base").to_pylist(), strict=True):
                f = DacFile(content.as_py())
                flat = f.all().astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.doc_ids, pa.int64(), mask=np.arange(len(f.doc_ids)) >= len(f.doc_ids) - f.unnamed),
                        pa.array(f.begin[:-1] + base, pa.int64()),
                        pa.array(np.diff(f.begin), pa.int64()),
                        pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(f.begin[:-1], f.begin[1:], strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return data.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write and read back, in a folder of the shared store."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens")
    files = write_token_files(docs, out, vocabulary, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, out, files)
