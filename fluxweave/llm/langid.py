"""Language identification: averaged hashed subword embeddings and a linear softmax.

Features of a text are its 1- to 4-byte grams within words (with the word's ends marked),
hashed into BUCKETS; a text's vector is the mean of its features' embeddings, and one
linear layer with softmax gives the languages. Embeddings and layer are trained together
by stochastic gradient descent in numpy, on pieces of the sampled texts so that short texts
are covered, too. Temperature and rejection threshold are calibrated on sampled documents
that training does not see.

The training sample is bounded: SAMPLE documents of each language at most (on average),
chosen by a hash of doc_id; a longer one than SAMPLE_CHARS is taken in pieces. Prediction reads whole texts. As the model is
linear, it is folded into one table of BUCKETS x languages numbers for prediction.

A null text or one without a letter is `und` with score 0; it is rejected. Without any
labelled document, every text is. Rows are independent: ties and repeats do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm import textkit as tk

BUCKETS_LOG2 = 17
DIM = 8
SAMPLE = 240
SAMPLE_CHARS = 60_000
EPOCHS = 4
PIECE_BYTES = 300
KEEP = 0.998  # of the calibration documents that are right, this part is not rejected
MOST_THRESHOLD = 0.6
UNDETERMINED = "und"

#: Letters in lower case, all bytes from 0x80 on, and blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..4: bucket of the gram that ends at each byte, and whether it is one.

    The blank before a word counts as its first byte and the blank after it as its last.
    """
    b = np.frombuffer(data, np.uint8)
    solid = b != 32
    out, key, inside = [], b.astype(np.uint64), np.ones(len(b), bool)
    for n in range(1, 5):
        if n > 1:
            key = key.copy()
            key[n - 1 :] |= b[: len(b) - n + 1].astype(np.uint64) << np.uint64(8 * (n - 1))
            # Inner bytes are letters; the ends may be the blanks around a word.
            inside = inside.copy()
            inside[: n - 1] = False
            if n > 2:
                inside[n - 1 :] &= solid[1 : len(b) - n + 2]
        ok = inside & (solid if n == 1 else np.ones(len(b), bool))
        if n == 2:
            ok = inside.copy()
            ok[1:] &= solid[1:] | solid[:-1]
        out.append(((key * _ODD[n - 1] >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), ok))
    return out


@dataclass
class Model:
    """languages; table: summed over a text's grams and divided by their number, logits less bias."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """One row of logits for each text."""
        offsets, data = tk.buffers(pc.utf8_lower(pc.fill_null(column, "")))
        out = np.empty((len(column), len(self.languages)))
        for lo, hi in tk.chunks(offsets, 1 << 20):
            lengths = np.diff(offsets[lo : hi + 1])
            # A blank before each text keeps grams from crossing into the next.
            text = bytes(data[offsets[lo] : offsets[hi]]).translate(_LETTERS)
            if hi - lo > 1:
                text = b" ".join(text[a - offsets[lo] : b - offsets[lo]] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True))
            text = b" " + text + b" "
            begin = np.append(0, np.cumsum(lengths + 1))[:-1] + 1  # a text's grams end in it or at the blank behind it
            total = np.zeros((hi - lo, len(self.languages)))
            count = np.zeros(hi - lo)
            for bucket, ok in grams(text):
                at = np.where(ok, bucket, len(self.table) - 1)  # the last row is zero
                count += np.add.reduceat(ok.astype(np.int64), begin)
                for k in range(len(self.languages)):
                    total[:, k] += np.add.reduceat(self.table[:, k].take(at), begin)
            out[lo:hi] = total / np.maximum(count, 1)[:, None] + self.bias
        return out

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return _softmax(self.logits(column) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    """Fit embeddings and the linear layer, then temperature and threshold."""
    languages = sorted(set(langs))
    label = {x: k for k, x in enumerate(languages)}
    n_class, rng = len(languages), np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    feats, marks, ys = [], [0], []
    for k in np.flatnonzero(~held):
        lowered = texts[k].lower().encode().translate(_LETTERS)
        parts = lowered.split()
        piece, size = [], 0
        pieces = []
        for w in parts:
            piece.append(w)
            size += len(w) + 1
            if size >= PIECE_BYTES:
                pieces.append(piece)
                piece, size = [], 0
        if piece:
            pieces.append(piece)
        for p in pieces:
            ids = np.concatenate([bucket[ok] for bucket, ok in grams(b" " + b" ".join(p) + b" ")])
            feats.append(ids)
            marks.append(marks[-1] + len(ids))
            ys.append(label[langs[k]])
    size = 1 << BUCKETS_LOG2
    e = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, n_class)), np.zeros(n_class)
    y, lengths = np.array(ys, np.int64), np.diff(marks)
    batch, rounds = 32, EPOCHS * -(-len(feats) // 32)
    step = 0
    for _ in range(EPOCHS if feats else 0):
        order = rng.permutation(len(feats))
        for at in range(0, len(order), batch):
            rate = 0.5 * (1 - step / rounds) + 0.01
            step += 1
            rows = order[at : at + batch]
            ids = np.concatenate([feats[r] for r in rows])
            who = np.repeat(np.arange(len(rows)), lengths[rows])
            begin = np.append(0, np.cumsum(lengths[rows]))[:-1]
            mean = np.add.reduceat(e[ids], begin, axis=0) / lengths[rows][:, None]
            p = _softmax(mean @ w + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = (p @ w.T / lengths[rows][:, None]) * rate
            w -= rate * mean.T @ p / len(rows)
            bias -= rate * p.mean(axis=0)
            o = np.argsort(ids, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(ids[o]) > 0))
            # A row's embedding moves by its mean's gradient; the count of the gram is in the sum.
            e[ids[o][heads]] -= np.add.reduceat(back[who[o]], heads, axis=0) * 20
    table = np.vstack([e @ w, np.zeros((1, n_class))])
    model = Model(languages, table, bias)
    if held.any():
        logits = model.logits(pa.array([texts[k] for k in np.flatnonzero(held)], pa.string()))
        truth = np.array([label[langs[k]] for k in np.flatnonzero(held)])
        choices = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in choices]
        model.temperature = float(choices[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            model.threshold = float(min(MOST_THRESHOLD, np.quantile(right, 1 - KEEP) * 0.9))
    return model


def fit(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Train on a bounded hash sample of the labelled rows of docs(doc_id, text, lang), long ones by pieces of SAMPLE_CHARS."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    usable = usable.where(F.length("text") > 0).withColumn("pieces", F.ceil(F.length("text") / SAMPLE_CHARS))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.sum("pieces").alias("n")).collect()}
    if not counts:
        return Model([UNDETERMINED], np.zeros(((1 << BUCKETS_LOG2) + 1, 1)), np.zeros(1))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    place = lambda k: F.pmod(F.when(k == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", k)), F.lit(1_000_003))
    taken = F.filter(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda k: place(k) < share[F.col("lang")] * 1_000_003)
    chosen = usable.withColumn("piece", F.explode(taken)).select("doc_id", "lang", F.substring("text", (F.col("piece") * SAMPLE_CHARS + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in chosen.collect())
    return train([r[2] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected, in place of columns of these names; the prediction sees the text only."""
    if "text" not in docs.columns:
        raise ValueError("docs has no column text")
    docs = docs.drop("lang_pred", "score", "rejected")
    languages = np.array(model.languages, object)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            lower = pc.fill_null(text, "")
            plain = pc.match_substring_regex(lower, "[A-Za-z]").to_numpy(zero_copy_only=False)
            letters = [bool(p) or any(map(str.isalpha, lower[k].as_py())) for k, p in enumerate(plain)]
            p = model.probabilities(text) if len(text) else np.zeros((0, len(languages)))
            best = p.argmax(axis=1)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            if len(languages) == 1 and languages[0] == UNDETERMINED:
                score[:] = 0.0
            names = [languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
            rejected = (score < model.threshold) | (score == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    out = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return tk.modest_batches(docs).mapInArrow(run, out)


def in_fold(doc_id: str, folds: int, fold: int):
    """Whether the checksum of the doc_id's text is the fold's; false for a null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
