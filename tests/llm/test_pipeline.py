"""The stages of the pipeline, each on what the one before kept."""

import zlib

import pytest

import corpus_pipeline
from kinlink.llm import mixing, packing, resemblance, secrets, tokens, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, SMALL).cache()
    flagged = {r.doc_id for r in toxicity.scored(docs, labels).where("flagged").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - flagged
    single = stages["near_duplicates"](spark, clean, SMALL).cache()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in clean.collect()} - {r.u for r in resemblance.grouped(clean).collect()}
    masked = stages["secrets"](spark, single, SMALL).cache()
    assert masked.columns == columns and masked.count() == single.count()
    assert all(not secrets.base_spans(r.text or "") and r.n_chars == len(r.text) for r in masked.collect())
    mixed = stages["mixing"](spark, masked, SMALL).cache()
    assert mixed.columns == columns and set(r.doc_id for r in mixed.collect()) <= set(r.doc_id for r in masked.collect())
    packed = stages["packing"](spark, mixed, SMALL)
    assert packed.groupBy().sum("length").head()[0] == sum(r.doc_tokens * 1 for r in packing.packed(mixed).where("start = 0").collect())
    assert corpus_pipeline.run(spark, SMALL).count() > 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, target double, g string, u long"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t", None, None), (4, "One", "en", "b"), (5, "one", "xx", "b"), (6, long, "en", "big"), (7, long + " end", "de", "big"), (7, long + " end", "de", "big"),
        (None, "a b c d e f", "en", "c"), (None, None, None, None), (8, "x" * 50_000, "en", "\U0001f600"), (9, "my password = abcdefghijklmn ok", "en", "b"), (10, "plain words of a document that is like no other", "fr", "c"),
    ]
    return [(i, t, lang, s, len(t or ""), "k", 1, 2.0, "g", 3) for i, t, lang, s in texts]


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_rows(spark, tmp_path, rows):
    """Null, empty and very long texts, ties, repeated rows, null ids, clashing columns, and an empty table."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    kept = stages["near_duplicates"](spark, stages["toxicity"](spark, docs, folder), folder).cache()
    assert kept.columns == columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (sorted(["1", "4", "6", "8", "9", "10", "None", "None"]) if rows else [])
    masked = stages["secrets"](spark, kept, folder)
    assert masked.columns == columns and {r.text for r in masked.collect() if r.doc_id == 9} == ({"my [SECRET] ok"} if rows else set())
    mixed = stages["mixing"](spark, masked, folder).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.where("text is null").collect()} == ({1, None} if rows else set())
    want = sum(len(tokens.library(tokens.default_path())((r.text or "").encode())) + 1 for r in mixed.collect())
    assert sum(r.length for r in stages["packing"](spark, mixed, folder).collect()) == want
    out = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in out) == want and mixing.mixed(masked).count() == masked.count()


def test_toxicity_learns_from_every_fold(spark, tmp_path, monkeypatch):
    """What only documents of one fold show is learned, and all labelled documents count for the thresholds."""
    seen = {}
    plain = toxicity.limit
    monkeypatch.setattr(toxicity, "limit", lambda model, rows, prior: seen.update(n=rows.count()) or plain(model, rows, prior))
    crc = {i: zlib.crc32(str(i).encode()) for i in range(1500)}
    rows = [(i, f"w{i % 41} {'' if i % 3 else 'zorg' if c // 4 % 5 == 0 else 'vile'} end", "en", "a", int(i % 3 == 0)) for i, c in crc.items()]
    spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if not r[4]]
    assert seen["n"] == sum(c % 4 != 2 for c in crc.values())
