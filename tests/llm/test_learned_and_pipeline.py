"""Token counts against the library, toxicity on held-out labels, and the stages of the pipeline."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from opsframe.llm import token_count, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [None, "", " ", "It's 3 o'clock<|endoftext|>now", "é é ÉCOLE ß", "日本 語", "👍🏽 ok\t\n", "x" * 3000, "word " * 3000]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None if i == 0 else 10**6 + i, t) for i, t in enumerate(odd)], docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_count.token_counts(docs, path).collect():
        wanted = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (wanted, len(texts[r.doc_id].encode()), wanted > 2048), texts[r.doc_id][:50]


def test_toxicity_on_labels_not_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels, "source").join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in scored)
    assert right / len(scored) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "b " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 2), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, labels).collect()] == [0.0] * 4
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_stages_return_documents_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, given = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        rows = docs.collect()
        left = {r.doc_id for r in rows}
        assert left <= given and (name == "source_mix" or len(left) == len(rows))
        given = left
    plain = ["".join(r.text.split()) for r in rows]
    assert all(plain) and all(r.n_chars == len(r.text) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0 and {p.doc_id for p in pieces} == given


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def labels_folder(spark, tmp_path):
    """A folder with labels of two toxic and many clean documents, and documents."""
    rows = [(i, f"calm words number {i} about gardens", "en", "a", 0) for i in range(60)]
    rows += [(100 + i, f"you idiot scum number {i}", "en", "a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id >= 100 as int) as toxic")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", None, 3), (3, "one", "en", "a", 3),
    (3, "one", "en", "a", 3), (None, "one", "en", "b", 3), (4, "a b c d e f g h " * 4000, "en", "b", 5), (5, "a  b c d e f g h " * 4000, "en", "b", 5),
    (6, "short é 人 text", "fr", "c", 1),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, labels_folder, name, stage):
    docs = spark.createDataFrame([(*row, "k", 1) for row in ODD], COLUMNS + ", _row string, score int")
    out = stage(spark, docs, labels_folder).collect()
    if name == "packing":
        assert sum(r.start == 0 for r in out) == len(ODD)
    else:
        assert out and set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
        texts = ["".join((r.text or "").split()) for r in out]
        whole = sorted("".join((t or "").split()) for _, t, *_ in ODD)
        if name == "toxicity":
            assert sorted(texts) == whole  # nothing here is toxic
        if name == "exact_dedup":
            assert sorted(texts) == sorted(set(whole))
        if name == "near_dedup":  # white space differs, the words do not
            assert sorted(t for t in texts if t) == sorted(t for t in set(whole) if t) and texts.count("") == 3
        if name == "source_mix":
            assert set(texts) <= set(whole) | {t for t in texts if any(t in w for w in whole)} and all(texts)
    empty = stage(spark, docs.limit(0), labels_folder)
    assert empty.count() == 0


def test_run_equals_the_stages_one_by_one(spark, labels_folder):
    whole = corpus_pipeline.run(spark, labels_folder).collect()
    docs = spark.read.parquet(f"{labels_folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, labels_folder)
        docs = spark.createDataFrame(made.collect(), made.schema)
    one_by_one = docs.collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, one_by_one))
    ids = {r.doc_id for r in whole}
    assert not any(i >= 100 for i in ids) and ids  # toxic ones go, clean ones stay


def test_a_stage_frees_what_the_one_before_settled(spark, labels_folder):
    from opsframe.sources.durable import recorded

    docs = spark.createDataFrame(ODD, COLUMNS)
    with recorded() as paths:
        corpus_pipeline.drop_copies(spark, docs, labels_folder).collect()
        own = list(paths)
        corpus_pipeline.drop_near_copies(spark, docs, labels_folder)
    import os

    assert own and not any(os.path.exists(p.removeprefix("file:")) for p in own)
