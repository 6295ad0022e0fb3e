"""Each operator against a brute-force version, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tests_support import near_groups
from tokenizers import Tokenizer

from fluxweave.llm import boost, decontam, dedup, fingerprints, langid, lmscore, packing, pii, secrets, substring, textkit, tokens

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = r"[^\x20\x09-\x0D]+"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_token_files_round_trip(spark, docs, plain, nothing):
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    got = {r.doc_id: r for r in tokens.token_files(docs, WORD_BPE).collect()}
    for i, text in sorted(plain):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_files(nothing, WORD_BPE).count() == 0


def test_directly_addressable_codes_give_any_id():
    rng = np.random.default_rng(5)
    ids = [rng.geometric(0.01, n).astype(np.uint32) ** 2 for n in (0, 1, 700, 5000)]
    f = tokens.DacFile(tokens.encode_file(np.arange(4), ids))
    flat = np.concatenate(ids)
    assert (f.all() == flat).all() and all(f.get(i) == flat[i] for i in range(len(flat)))
    assert (f.document(2) == ids[2]).all() and len(f.levels) > 1
    assert tokens.DacFile(tokens.encode_file(np.arange(1), [np.zeros(0, np.uint32)])).n == 0


def test_pieces_encode_like_whole_texts():
    odd = ["a  b\n\nc \t d", " lead", "trail ", "it's we'LL 'tis", "ño é́", "\nFoo\n Bar", "x,y. z!?", "<|endoftext|> a", " wide space", "Straße ÀÉ"]
    for path in (WORD_BPE, BYTE_BPE):
        one, whole = tokens.PieceEncoder(path), Tokenizer.from_file(path)
        for text, code in zip(odd, one.encode(odd), strict=True):
            assert code.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_survive_a_small_memory(monkeypatch, plain):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    one, whole = tokens.PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = [t or "" for _, t in plain]
    assert [c.tolist() for c in one.encode(texts)] == [c.ids for c in whole.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_any_characters_encode_like_whole_texts():
    rng = random.Random(5)
    parts = ["a", "b", "the", "S", "s", "t", "re", "É", "é", "ß", "Å", "×", "÷", "«", "'", "'", "1", "23", "²", ".", ",", "!!", "-", " ", " ", "  ", "\n", "\t", "\r\n", " \n", "一", "e\u0301", "\u0307", "I", "İ", "\x00", "\x7f", "<|", "_", "$", "ſ", "ñ", "Ñ", "\x85", "w" * 70]
    for path in (WORD_BPE, BYTE_BPE):
        one, whole = tokens.PieceEncoder(path, cache_words=300), Tokenizer.from_file(path)
        for _ in range(12):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(100)]
            assert [c.tolist() for c in one.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(map(len, one.young)) <= tokens.CACHE_CHARS


def test_token_files_with_null_and_repeated_ids(spark):
    """Rows of one doc_id follow each other by text, those without one come last."""
    rows = [(3, "b"), (None, "z"), (3, "a"), (-1, None), (None, None), (3, "a"), (2, "")]
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in tokens.token_files(table, WORD_BPE).withColumnRenamed("start", "a").select("a", "doc_id", "n_tokens", "ids_crc32").collect())
    want = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_language_id_on_held_out_texts(spark, nothing, docs):
    words = {"aa": "kala mora suve tipo lano", "bb": "grust zweck pfahl schrum knopf", "cc": "oui leaux mentre çaque élan"}
    rng = np.random.default_rng(1)
    data = [(i, " ".join(rng.choice(words[k].split(), 30)), k, "s") for i in range(300) for k in [list(words)[i % 3]]]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    model = langid.fit(table.where("doc_id < 200"), sample=50)
    out = langid.predict(table.where("doc_id >= 200"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "一")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (1, 2, 3)) and got[4].lang_pred != "und"
    empty = langid.fit(nothing)
    assert all(r.lang_pred == "und" for r in langid.predict(docs.select("doc_id", "text"), empty).collect())
    assert langid.predict(nothing.select("doc_id", "text"), model).count() == 0


def test_language_logits_are_the_mean_over_grams(spark):
    """Against a loop over each text's grams; rows of one batch do not see each other."""
    rng = np.random.default_rng(3)
    model = langid.Model(["aa", "bb"], np.vstack([rng.normal(size=(1 << langid.BUCKETS_LOG2, 2)), np.zeros((1, 2))]), np.array([0.1, -0.2]))
    texts = ["Abc de", "", None, "x", "  two  words ", "12 3!", "Über été", "a\nbc-d"]
    for text, got in zip(texts, model.logits(pa.array(texts, pa.string())), strict=True):
        data = b" " + (text or "").lower().encode().translate(langid._LETTERS) + b" "
        rows = []
        for i in range(1, len(data)):
            for n in range(1, 5):
                g = data[i - n + 1 : i + 1] if i - n + 1 >= 0 else b""
                if len(g) == n and b" " not in g[1:-1] and g not in (b" ", b"  "):
                    key = sum(c << 8 * j for j, c in enumerate(reversed(g)))
                    rows.append(key * int(langid._ODD[n - 1]) % 2**64 >> 64 - langid.BUCKETS_LOG2)
        want = model.table[rows].sum(axis=0) / max(1, len(rows)) + model.bias
        assert np.allclose(got, want)
    table = spark.createDataFrame([(1, "x", 9.0)], "doc_id long, text string, score double")
    assert langid.predict(table, model).columns == ["doc_id", "text", "lang_pred", "score", "rejected"]


def test_language_of_long_documents_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 400)
    words = {"aa": "kala mora suve tipo lano", "bb": "grust zweck pfahl schrum knopf"}
    rng = np.random.default_rng(1)
    data = [(i, " ".join(rng.choice(words[k].split(), 30 if k == "aa" else 300)), k) for i in range(120) for k in [list(words)[i % 2]]]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 100"), sample=60)
    assert list(model.languages) == ["aa", "bb"]
    out = langid.predict(table.where("doc_id >= 100"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 19


def test_lm_score_base_and_model(spark, plain, docs, nothing):
    marked = docs.withColumn("held", langid.in_fold("doc_id", 10, 0))
    got = {r.doc_id: r for r in lmscore.score(marked, "held").collect()}
    split = {i: [*re.findall(SPACE, (t or "").translate(LOW)), None] for i, t in plain}
    held = {i for i in split if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, ws in split.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lmscore.score(nothing.selectExpr("*", "false held"), "held").count() == 0


def _tree_log(pairs, context, bits, depth):
    """ln P of a node, by the definition: pairs of (context bytes nearest first, byte)."""
    mine = [(c, b) for c, b in pairs if c[: len(context)] == context and format(b, "08b").startswith(bits)]
    ones = sum(format(b, "08b")[len(bits)] == "1" for _, b in mine)
    own = float(lmscore.kt_block(np.array([float(len(mine) - ones)]), np.array([float(ones)]))[0])
    if len(context) == depth or not mine:
        return own
    below = sum(_tree_log(mine, (*context, k), bits, depth) for k in {c[len(context)] for c, _ in mine})
    return float(np.logaddexp(own, below)) - math.log(2)


def test_weighting_is_the_context_tree_mixture():
    """The predicted probability equals the ratio of the tree's probabilities with and without the next byte."""
    words = [b"ab ", b"abc ", b"ab ", b"b "]
    pairs = [(tuple([*reversed(w[:k]), *([0] * 7)][:7]), w[k]) for w in words for k in range(len(w))]
    keys = np.array([sum(c << (56 - 8 * j) for j, c in enumerate(ctx)) | b for ctx, b in pairs], np.uint64)
    u, w = lmscore._summed(keys, np.ones(len(keys), np.int64))
    levels, _ = lmscore.weighted_levels(u, w.astype(float), 0)
    logs = lmscore.pair_logs(u, levels, None)
    for key, log in zip(u.tolist(), logs, strict=True):
        ctx, byte = tuple(key >> (56 - 8 * j) & 255 for j in range(7)), key & 255
        told = sum(_tree_log([*pairs, (ctx, byte)], (), format(byte, "08b")[:j], 7) - _tree_log(pairs, (), format(byte, "08b")[:j], 7) for j in range(8))
        assert math.isclose(log, told, rel_tol=1e-6, abs_tol=1e-9)


def test_scores_of_all_words_of_a_split_tree_agree(spark):
    """Subtrees and top levels together give what one tree gives."""
    data = [(k, t) for k, t in enumerate(["ab abc", "abc b", "ab", None])]
    table = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "false held")
    got = {r.doc_id: r.score for r in lmscore.score(table, "held").collect()}
    words = [w for _, t in data for w in [*(f"{x} " for x in (t or "").split()), "\n"]]
    pairs = [(tuple([*reversed(w.encode()[:k]), *([0] * 7)][:7]), w.encode()[k]) for w in words for k in range(len(w))]
    keys = np.array([sum(c << (56 - 8 * j) for j, c in enumerate(ctx)) | b for ctx, b in pairs], np.uint64)
    u, w = lmscore._summed(keys, np.ones(len(keys), np.int64))
    logs = dict(zip(u.tolist(), lmscore.pair_logs(u, lmscore.weighted_levels(u, w.astype(float), 0)[0], None), strict=True))
    end = logs[10] / math.log(10)
    assert math.isclose(got[3], end, rel_tol=1e-5)


def test_lm_contexts_cross_blanks(spark):
    """Every byte is predicted from the bytes before it in the text, whichever word they are in."""
    data = [(k, t) for k, t in enumerate(["ab  Abc d", "d abc ab", "ab d\tabc", None, "é ab", "x y"])]
    table = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "doc_id = 2 held")
    got = {r.doc_id: r for r in lmscore.score(table, "held", crossing=True).collect()}
    texts = {i: "".join(f"{w} " for w in (t or "").translate(LOW).split()).encode() + b"\n" for i, t in data}
    pairs = {i: [(tuple([*reversed(t[:k]), *([0] * 7)][:7]), t[k]) for k in range(len(t))] for i, t in texts.items()}
    trained = [x for i in pairs if i != 2 for x in pairs[i]]
    for i, mine in pairs.items():
        want = 0.0
        for ctx, byte in mine:
            bits = format(byte, "08b")
            want += sum(_tree_log([*trained, (ctx, byte)], (), bits[:j], 7) - _tree_log(trained, (), bits[:j], 7) for j in range(8))
        assert math.isclose(got[i].score, want / math.log(10), rel_tol=1e-5)
        assert math.isclose(got[i].bits_per_byte, -got[i].score * math.log2(10) / len(texts[i]), rel_tol=1e-9)
    assert not math.isclose(got[0].score, got[1].score, rel_tol=1e-3)  # the same words in another order


def test_lm_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    """Many blocks, pooled in several rounds, give what one block gives."""
    marked = docs.withColumn("held", langid.in_fold("doc_id", 10, 0)).unionByName(docs.limit(3).withColumn("held", langid.in_fold("doc_id", 10, 0)))
    rows = lambda: sorted(tuple(r) for r in lmscore.score(marked, "held", crossing=True).collect())
    want = rows()
    monkeypatch.setattr(lmscore, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(lmscore, "FAN", 3)
    got = rows()
    assert len(got) == len(want) > 9
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a[5:], b[5:], strict=True))


def _thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_words_that_defeat_polynomial_hashes_are_told_apart(spark):
    """Two words whose polynomial hashes modulo 2**64 are equal for any base."""
    x, y = _thue_morse(2048, "a", "b"), _thue_morse(2048, "b", "a")
    rows = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join([x] * 7)), (4, " ".join([y] * 7))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.remove_repeats(table)).collect()} == substring.plain_reference(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(table).collect()} == near_groups(rows)
    bench = spark.createDataFrame([(1, " ".join([x] * 10))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(table, bench).collect()} == {1: 60, 2: 0, 3: 0, 4: 0}
    scored = lmscore.score(table.withColumn("held", table.doc_id == 2), "held", crossing=True)
    assert {r.doc_id: r.n_known for r in scored.collect()} == {1: 61, 2: 61, 3: 8, 4: 8}
    scored = lmscore.score(table.where("doc_id < 3").withColumn("held", table.doc_id == 2), "held", crossing=True)
    assert {r.doc_id: r.n_known for r in scored.collect()} == {1: 61, 2: 1}


def test_near_duplicates(spark, docs, plain, nothing):
    want = near_groups(plain)
    got = {r.doc_id: r for r in dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())
    kept = dedup.deduplicate(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][1] == i) and kept.columns == docs.columns
    assert dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Each row is linked by its own text; rows without an id are the last of their group."""
    rng = random.Random(4)
    x, y, z = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(80)) for c in "xyz")
    rows = [(5, x), (5, y), (7, y + " end"), (9, x + " end"), (None, z), (None, z + " end"), (None, z), (3, None), (None, ""), (None, x)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(table).collect()), key=str)
    assert got == sorted([(5, 76, 5, True), (5, 76, 5, True), (7, 77, 5, False), (9, 77, 5, False), (None, 76, None, True), (None, 77, None, True), (None, 76, None, True), (3, 0, 3, True), (None, 0, None, True), (None, 76, 5, False)], key=str)
    kept = [(r.doc_id, r.text) for r in dedup.deduplicate(table).collect()]
    assert len(kept) == 5 and {t for i, t in kept if i == 5} == {x, y} and {(3, None), (None, "")} <= set(kept)
    assert sum(i is None and t is not None and t.startswith(z) for i, t in kept) == 1


def test_near_duplicates_in_a_large_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ITEMS", 16)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(120, k % 9, replace=False):
            words[at] = f"e{k}_{at}"
        texts.append((k, " ".join(words)))
    want = near_groups(texts)
    got = dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_fingerprints(spark, docs, plain, nothing):
    _check_fingerprints(docs, plain)
    assert fingerprints.fingerprints(nothing).count() == 0


def test_fingerprints_of_any_ids(spark):
    """Null and repeated ids, ids far apart and close together, identical rows."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    ids = [*range(100, 130), 5, 5, 5, -(2**63), 2**63 - 1, -7, 2**40, 2**40 + 1, *[None] * 8]
    rows = [(i, t) for i, t in zip(ids, texts, strict=False)]
    rows += [(5, rows[30][1]), (None, None), (None, rows[-1][1]), (77, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _check_fingerprints(table, rows)


def _plain_sketches(spark, texts):
    """text -> sketch, from Spark's hash of single words and shingles only."""
    split = {t: re.findall(SPACE, t.translate(LOW)) for t in texts}
    words = sorted({w for ws in split.values() for w in ws})
    code = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words] or [("",)], "w string").selectExpr("w", "xxhash64(w)").collect()}
    grams = {tuple(code[w] for w in ws[k : k + 5]) for ws in split.values() for k in range(len(ws) - 4)}
    shingle = {tuple(r[0]): r[1] for r in spark.createDataFrame([(list(g),) for g in grams] or [([0] * 5,)], "g array<long>").selectExpr("g", "xxhash64(g[0], g[1], g[2], g[3], g[4]) & 9223372036854775807").collect()}
    short = {tuple(code[w] for w in ws) for ws in split.values() if 0 < len(ws) < 5}
    shingle |= {tuple(r[0]): r[1] for r in spark.createDataFrame([(list(g),) for g in short] or [([0],)], "g array<long>").selectExpr("g", "xxhash64(g) & 9223372036854775807").collect()}
    out = {}
    for t, ws in split.items():
        codes = [code[w] for w in ws]
        sets = [tuple(codes[k : k + 5]) for k in range(len(codes) - 4)] or ([tuple(codes)] if codes else [])
        out[t] = sorted({shingle[x] for x in sets})[: fingerprints.K]
    return out


def _alike(a, b):
    both = sorted({*a, *b})[: fingerprints.K]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def _check_fingerprints(table, rows):
    """All columns, and the order of documents, against plain Python."""
    spark = table.sparkSession
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    follow = [t for _, t in order[1:] + order[:1]]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), n in zip(order, follow, strict=True)]
    known = _plain_sketches(spark, {t for _, t in order} | set(edited))
    text = lambda s: "".join(f"{h:016x}" for h in s)
    want = [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(known[t]), text(known[e]), round(_alike(known[t], known[e]), 9), round(_alike(known[t], known[n]), 9))
        for (i, t), n, e in zip(order, follow, edited, strict=True)
    ]
    for ranges in (None, 1, 7, 40):
        got = fingerprints.fingerprints(table, ranges).collect()
        assert sorted((tuple([*r[:5], round(r.near_edited, 9), round(r.near_next, 9)]) for r in got), key=str) == sorted(want, key=str)


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"a{k}" for k in range(3000)), " ".join(f"a{k}" for k in range(1500, 4500))
    row = (
        spark.createDataFrame([(a, b)], "a string, b string")
        .select(fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
        .select(fingerprints.resemblance(F.col("x"), F.col("y")), fingerprints.distinct_count(F.col("x")), fingerprints.containment(F.col("x"), F.col("y")), fingerprints.distinct_count(fingerprints.merge(F.col("x"), F.col("y"))))
        .first()
    )
    assert abs(row[0] - 1 / 3) < 0.2 and 2000 < row[1] < 4500 and abs(row[2] - 0.5) < 0.3 and 3000 < row[3] < 6500


def test_pii_base_spans_and_additions(spark, docs, plain, nothing):
    def naive(text):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and pii.luhn(d):
                out.append((2, *m.span()))
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, t in plain:
        base = naive(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base, pii.KINDS).encode()).hexdigest()
        assert set(pii.written(base, pii.KINDS).split(",")) <= set(got[i].spans.split(","))
    trees, thresholds = pii.model()
    text = "please call me, phone: (212) 555-0188 today"
    assert pii.added_spans(text, [], trees, thresholds) == [(3, 23, 37)]
    assert pii.added_spans("item 2021 1234 4412 9083 total", [], trees, thresholds) == []
    x, y = pii._examples(77, 1500)
    p = trees.probability(x)
    chosen = p >= thresholds[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.8
    assert pii.redact("a b@c.d e", "email:2:7") == "a [EMAIL] e"
    assert pii.detect(nothing).count() == 0


def test_pii_written_another_way_is_found_in_documents(spark):
    """Rewritten spans planted into documents that were not trained on, without any cue word; the rest stays alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trees, thresholds = pii.fit(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.where("doc_id % 2 = 1 and text is not null and length(text) > 200").orderBy("doc_id").limit(240).collect()]
    clean = [(t, pii.added_spans(t, pii.base_spans(t), trees, thresholds)) for t in texts]
    wrong = sum(len(x) for _, x in clean)
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda body: body + next(c for c in "0123456789" if pii.luhn(body + c))
    plain = [lambda: f"k{digits(3)}@mail{digits(2)}.example.org", lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)), lambda: card("4" + digits(14)), lambda: "+49" + digits(10)]
    hit = Counter()
    for k, text in enumerate(texts):
        kind, at = k % 4, text.index(" ", len(text) // 2) + 1 if " " in text[len(text) // 2 :] else 0
        new = pii.rewritten(kind, plain[kind](), rng.choice)
        planted = f"{text[:at]}{new} {text[at:]}"
        found = pii.added_spans(planted, pii.base_spans(planted), trees, thresholds)
        hit[kind] += any(a < at + len(new) and b > at for _, a, b in found)
    recall = [hit[k] / (len(texts) // 4) for k in range(4)]
    assert min(recall) >= 0.9 and wrong <= 0.05 * sum(hit.values()), (recall, wrong)


def test_pii_learns_from_whole_texts(spark):
    """Phones that stand past 20,000 characters only are learned from, too."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    far = "".join(rng.choice("abcdefgh ") for _ in range(21_000))
    rows = [(k, f"{far} +{digits(11)} gamma delta{k}") for k in range(30)]
    trees, thresholds = pii.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    news = [pii.rewritten(3, "+" + digits(11), rng.choice) for _ in range(40)]
    found = [pii.added_spans(f"beta {new} gamma", [], trees, thresholds) for new in news]
    assert sum(bool(x) for x in found) >= 36


def test_pii_examples_are_those_of_every_row(spark, plain, nothing):
    texts = [t for _, t in plain if t is not None] + ["call 0171/123456 or x at y.org, not 4111 1111 1111 1111 but 10.0.0.1"] * 3
    trees = pii.model()[0]
    want = Counter((label, trees.binned(np.array([row])).tobytes()) for t in texts for label, row in pii.text_examples(t))
    assert len({label for label, _ in want}) == 2
    table = spark.createDataFrame([(k // 2, t) for k, t in enumerate([*texts, None])], "doc_id long, text string")
    got = Counter()
    for r in pii.examples(table.repartition(5)).collect():
        got[r.sensitive, bytes(r.features)] += r.n
    assert got == want
    one, other = pii.fit(table), pii.fit(table.repartition(7))
    assert np.array_equal(one[1], other[1]) and all(np.array_equal(x, y) for a, b in zip(one[0].nodes, other[0].nodes, strict=True) for x, y in zip(a, b, strict=True))
    none = pii.fit(nothing)
    assert np.array_equal(none[1], pii.model()[1]) and none[0].base == trees.base


def test_pii_numbers_that_run_together_have_no_label(spark):
    """A phone before an address is dropped by the fixed pattern, which does not make it harmless."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    assert all(label for label, _ in pii.text_examples("un. +1 (826) 555-4081 190.137.223.204 du"))
    assert not any(label for label, _ in pii.text_examples("order 1234 5678 9012 3456 du, 0171/123456"))
    rows = [(k, f"beta{k} +1 {phone()} {rng.choice(['190.137.223.204', 'gamma'])} delta") for k in range(60)]
    trees, thresholds = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(bool(pii.added_spans(f"beta {phone()} gamma", [], trees, thresholds)) for _ in range(40)) >= 36


def test_pii_apart_and_blocks(monkeypatch):
    rng = random.Random(5)
    spans = lambda n: [(0, a, a + rng.randrange(1, 9)) for a in (rng.randrange(90) for _ in range(n))]
    for n in (0, 1, 4, 9):
        found, base = spans(40), spans(n)
        assert pii._apart(found, base) == [c for c in found if not any(c[1] < b and c[2] > a for _, a, b in base)]
    x, y = pii._examples(5, 400)
    made = []
    for block in (1 << 17, 61):
        monkeypatch.setattr(boost, "BLOCK", block)
        trees, rows = pii._blank(), pii._rows()
        rows.add(trees.binned(x), y, np.full(len(y), 2.0))
        made.append(trees.fit(rows).probability(x))
    assert np.allclose(*made) and ((made[0] > 0.5) == y).mean() > 0.9


def test_secrets(spark, docs, plain, nothing):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, t in plain:
        base = [(0, *m.span()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A) if len(m.group(1)) >= 6]
        base += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m.group()) >= 20]
        base += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m.group()) >= 24]
        base.sort(key=lambda s: (s[1], s[0]))
        assert got[i].base_sha256 == hashlib.sha256(secrets.written(base, secrets.KINDS).encode()).hexdigest()
    text = "auth bearer Zk93mQx71LpRt0VbNw82 then customerAccountRepository7 with key"
    assert [text[a:b] for _, a, b in secrets.added_spans(text, [])] == ["Zk93mQx71LpRt0VbNw82"]
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert all(clean[i] == t for i, t in plain if not got[i].spans) and not any("3f9a7c1d2b4e" in (t or "") for t in clean.values())
    assert secrets.scan(nothing).count() == 0 and secrets.redacted(nothing).count() == 0


def test_secrets_are_found_whole():
    rng = np.random.default_rng(8)
    key = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    for secret in (key(1600), ".".join(key(n) for n in (36, 400, 342))):
        text = f"the private key is {secret} and so on"
        assert [text[a:b] for _, a, b in secrets.added_spans(text, [])] == [secret]
    secret, known = key(700), "0123456789abcdef" * 4
    text = f"the private key is {known}/{secret}. Next"
    base = secrets.base_spans(text)
    assert [text[a:b] for _, a, b in base + secrets.added_spans(text, base)] == [known, f"/{secret}"]


def test_secrets_of_every_alphabet_and_length():
    rng = np.random.default_rng(9)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (digits + upper[:6], digits + "abcdefABCDEF", upper + "234567", lower + "234567", digits + lower, digits + upper, digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_"):
        for n in (16, 24, 40, 56, 64, 80, 128, 192, 256, 512, 1000, 4000):
            for _ in range(3):
                secret = "".join(rng.choice(list(letters), n - 2)) + "7" + letters[12]
                text = f"The private signing key of our connection is {secret} today"
                assert [text[a:b] for _, a, b in secrets.added_spans(text, [])] == [secret]
    for plain in ("customerAccountRepository7", "user_account_session_" * 12 + "1", "ABCDEF0123" * 30, "abc123" * 100):
        assert secrets.added_spans(f"The private signing key of our connection is {plain} today", []) == []


def test_substring_dedup(spark, docs, plain, nothing, monkeypatch):
    want = substring.plain_reference(plain)
    assert {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.remove_repeats(docs)).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) >= 6
    monkeypatch.setattr(substring, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 500)
    assert {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.remove_repeats(docs)).collect()} == want
    assert substring.remove_repeats(nothing).count() == 0


def test_packing(spark, docs, plain, nothing):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in plain}
    rows = packing.pack(docs, BYTE_BPE, group_docs=16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found in (*pieces.values(), *sequences.values()):
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) == len(ids[i]) for i, x in pieces.items()) and len(pieces) == len(ids)
    assert all(sum(n for _, n in x) <= packing.LENGTH for x in sequences.values())
    assert packing.pack(nothing, BYTE_BPE).count() == 0


def test_packing_wastes_little(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("word" + str(rng.randrange(90)) for _ in range(rng.randrange(1, 700)))) for k in range(400)]
    packed = packing.pack(spark.createDataFrame([*rows, (None, "x"), (None, None), (7, "x")], "doc_id long, text string"), BYTE_BPE, group_docs=100).collect()
    assert sum(r.length for r in packed) / (packing.LENGTH * len({r.sequence_id for r in packed})) > 0.97
    assert sum(r.doc_id is None for r in packed) == 2


def test_first_fit_is_the_first_that_fits():
    sizes = np.random.default_rng(4).integers(1, 1024, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    room: list[int] = []
    for k in np.argsort(-sizes, kind="stable"):
        b = next((j for j, free in enumerate(room) if free >= sizes[k]), len(room))
        if b == len(room):
            room.append(1024)
        assert bins[k] == b and offsets[k] == 1024 - room[b]
        room[b] -= sizes[k]


def test_decontamination(spark, docs, plain, nothing, item):
    items = [(1, item), (2, "alpha1 beta2"), (3, None), (4, " .. "), (5, "one"), (11, item + " more words"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontam.plain_reference(plain, [x for x in items if x[0] is not None])
    assert sum(x[4] for x in want.values()) >= 2
    for limit in (decontam.INDEX_BYTES, 60):
        got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(decontam.contamination(docs, bench, limit)).collect()}
        assert got == want
        kept = decontam.without_contaminated(docs, bench, limit)
        assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]} and kept.columns == docs.columns
    assert decontam.contamination(nothing, bench).count() == 0
    assert all(not r.n_hit for r in decontam.contamination(docs, bench.where("false")).collect())


def test_decontamination_keeps_every_row_in_parts(spark, plain, item):
    """Repeated rows and null ids each get a row of their own, whatever the benchmark's size."""
    texts = [(None, item), (None, "alpha1 beta2"), (None, None), (7, item), (7, item), (7, "one"), (8, "")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "alpha1 beta2"), (5, "one"), (6, item + " more"), *((k, f"x{k}") for k in range(20, 40))], "item_id long, text string")
    rows = lambda limit: sorted(map(str, decontam.digest(decontam.contamination(table, bench, limit)).collect()))
    want = rows(decontam.INDEX_BYTES)
    assert len(want) == len(texts) and sum("contaminated=True" in x for x in want) == 5
    assert rows(80) == rows(400) == want


def test_memory_given_back_changes_no_hash():
    values, at = np.arange(1, 70_000, dtype=np.uint64), np.array([0, 5, 60_000])
    before = textkit.rolling(values, at, at + 50), textkit.rolling_other(values, at, at + 50)
    textkit.give_back()
    assert not textkit._powers
    after = textkit.rolling(values, at, at + 50), textkit.rolling_other(values, at, at + 50)
    assert all((x == y).all() for x, y in zip(before, after, strict=True))
