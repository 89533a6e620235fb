"""The pipeline against plain restatements of its stages, on planted documents."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import frame
from tests.llm.test_near_dup import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in stages] == ["quality classifier", "near duplicates", "secret scan", "mixing", "tokens"]
    for _, docs in stages[:-1]:
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_near_duplicates_of_what_was_kept(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0][1].collect()]
    assert sorted(r["doc_id"] for r in stages[1][1].collect()) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)


def test_no_secret_stays(stages):
    from shardwise.llm.secrets import base_spans

    assert stages[2][1].count() == stages[1][1].count()
    assert not any(base_spans(r["text"] or "") for r in stages[2][1].collect())


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    before, after = stages[2][1].join(good, "doc_id").count(), stages[3][1].join(good, "doc_id").count()
    assert after >= 0.97 * before


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[3][1].collect()}
    for r in stages[4][1].collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_odd_rows_and_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark), FOLDER).count() > 0
        assert stage(spark, frame(spark).where("false"), FOLDER).count() == 0
