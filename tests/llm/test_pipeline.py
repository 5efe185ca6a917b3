"""Every stage of the pipeline on odd rows, empty tables and clashing columns, and its decisions on planted ones."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from saffron.llm import langid
from saffron.llm.queries import piece_model
from tests.conftest import MEDIUM, SMALL
from tests.llm.rows import ODD, docs

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, name):
    df = docs(spark, clash=True)
    out = STAGES[name](spark, df, SMALL)
    assert out.columns == df.columns or name == "sentence_pieces" and set(out.columns) == {*df.columns, "ids", "n_tokens"}
    rows = out.collect()
    texts = {r[1] for r in ODD}
    assert all(r["text"] in texts for r in rows)
    assert STAGES[name](spark, docs(spark, [], clash=True), SMALL).count() == 0
    if name in ("personal_data", "sentence_pieces"):
        assert len(rows) == len(ODD)
    if name == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in rows if r["text"] and r["text"].startswith("the cat")) == ["5"]


def test_language_rejects_noise_and_keeps_documents(spark):
    genuine = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rng, columns = np.random.default_rng(1), genuine.columns
    texts = [r["text"] for r in genuine.where("n_chars > 300").limit(60).collect()]
    junk = [(10_000_000 + i, langid.noise(t, i % 3, rng), None, "junk", 0) for i, t in enumerate(texts)]
    junk = spark.createDataFrame([r for r in junk if len(r[1]) > 60], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["language"](spark, genuine.unionByName(junk.select(columns)), MEDIUM)
    kept = Counter(r["doc_id"] >= 10_000_000 for r in out.select("doc_id").collect())
    assert kept[False] >= 0.99 * genuine.count()
    assert kept[True] <= 0.05 * junk.count()


def test_an_unknown_language_is_mostly_rejected(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("n_chars > 300").collect()
    known = [(r["text"], r["lang"]) for r in rows if r["lang"] != "es"]
    import pyarrow as pa

    model = langid.fit(*map(list, zip(*known, strict=True)))
    _, score = model.guesses(pa.array([r["text"] for r in rows if r["lang"] == "es"]))
    assert (score < model.threshold).mean() > 0.5 and model.accepted < 0.05 and model.rejected < 0.05


def test_personal_data_is_masked(spark):
    text = "write to someone@example.com or call +1 (168) 555-5254 soon"
    out = STAGES["personal_data"](spark, docs(spark, [(1, text), (2, "nothing here")]), SMALL).orderBy("doc_id").collect()
    assert "example.com" not in out[0]["text"] and "555-5254" not in out[0]["text"] and out[0]["text"].startswith("write to ")
    assert out[1]["text"] == "nothing here" and all(r["n_chars"] == len(r["text"]) for r in out)


def test_mixture_takes_no_document_more_than_twice(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    times = Counter(r["doc_id"] for r in STAGES["mixture"](spark, df, SMALL).select("doc_id").collect())
    ids = Counter(r["doc_id"] for r in df.collect())
    assert set(times) <= set(ids) and all(n <= 2 * ids[i] for i, n in times.items())


def test_pieces_are_the_library_s(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in STAGES["sentence_pieces"](spark, docs(spark), SMALL).collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    n = out.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert n["n"] > 100 and n["t"] > n["n"]
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"}
