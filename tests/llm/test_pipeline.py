"""The pipeline against plain Python over the smallest table."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fluxweave.llm import decontam, langid, secrets
from tests_support import near_groups

SF = "/root/testdata/sf0.001"


def test_pipeline_rows_agree_with_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.in_fold("doc_id", 4, 2)))
    rejected = {r.doc_id for r in langid.predict(docs.select("doc_id", "text"), model).where("rejected").collect()}
    texts = {r.doc_id: r.text for r in rows if r.doc_id not in rejected}
    assert len(texts) > 0.97 * len(rows)
    texts = {i: texts[i] for i, (_, low) in near_groups(list(texts.items())).items() if i == low}
    hit = decontam.plain_reference(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not hit[i][4]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = {i: secrets.redact(t, secrets.written(secrets._spans(t)[1], secrets.KINDS), "[SECRET-{}]") for i, t in texts.items()}
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = r.doc_tokens
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS


def test_stages_on_awkward_rows(spark, docs, nothing, item, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, extra columns, empty tables."""
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 1), (None, item, None, None, 2), (9001, None, "fr", "s", None), (9002, "key", "fr", "s", 3), (9002, "key", "fr", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    given = docs.unionByName(odd, allowMissingColumns=True).cache()
    n = given.count()
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, nothing, sf).count() == 0
    spoken = stages["language_id"](spark, given, sf)
    assert spoken.columns == corpus_pipeline.COLUMNS and spoken.where("text is null or text = ''").count() == 0 and spoken.count() > n / 2
    kept = stages["near_dedup"](spark, given, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.where("doc_id = 9002").count() == 1 and kept.where("doc_id = 9001").count() == 1
    clean = stages["decontamination"](spark, given, sf)
    assert clean.columns == corpus_pipeline.COLUMNS and clean.where("doc_id is null").count() == 1 and clean.where("doc_id = 9002").count() == 2
    safe = stages["secret_scan"](spark, given, sf)
    assert safe.columns == corpus_pipeline.COLUMNS and safe.count() == n
    assert safe.where("text is null and n_chars is null").count() == given.where("text is null").count() and safe.where("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, given, sf)
    assert packed.where("start = 0").count() == n and packed.where("doc_id is null").count() == 2
