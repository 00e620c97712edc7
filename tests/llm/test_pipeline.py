"""The pipeline's stages against plain versions of what each must do, on a small corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from workboard.llm import queries
from workboard.llm.store import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _prose(rng, n):
    words = ["river", "under", "stone", "walks", "slowly", "evening", "letter", "market", "window", "garden", "yellow", "seven"]
    return (" ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(n)) + ".").capitalize()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, docs, labels = random.Random(12), {}, []
    for i in range(0, 240):
        docs[i] = _prose(rng, rng.randrange(40, 120))
        labels.append((i, 1, 0))
    for i in range(240, 340):
        docs[i] = " | ".join(_prose(rng, 60).split()) if i % 2 else " ".join(["again"] * 80)
        labels.append((i, 0, 0))
    for i in range(340, 400):
        docs[i] = _prose(rng, 60) + " " + rng.choice(["you worthless scum", "what scum", "worthless trash"])
        labels.append((i, 1, 1))
    for i in range(400, 420):  # exact and near copies of clean documents
        w = docs[i - 400].split()
        if i % 2:
            w[-1] = "changed"
        docs[i] = " ".join(w)
    for i in range(0, 240, 8):
        docs[i] += " Write to jo.doe@example.org or 10.1.2.3 now."
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()] + [(500, None, "en", "s", None), (501, "", "en", "s", 0)]
    rows.append(rows[5])  # a repeated row
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def test_stages(spark, corpus):
    at, texts = corpus
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, at), name)
        seen[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(seen[n].columns == COLUMNS for n in names[:-1])
    ids = {n: {r.doc_id for r in seen[n].select("doc_id").collect()} for n in names}
    clean = set(range(240))
    assert clean <= ids["quality_classifier"] and len(ids["quality_classifier"] & set(range(240, 340))) <= 5
    # copies go, the smallest id of each group stays, and each id once
    assert clean <= ids["minhash_near_dedup"] and not ids["minhash_near_dedup"] & set(range(400, 420))
    assert seen["minhash_near_dedup"].count() == len(ids["minhash_near_dedup"])
    for r in seen["pii"].collect():
        assert not re.search(r"@|10\.1\.2\.3", r.text or "")
        want = (texts.get(r.doc_id) or "").replace("jo.doe@example.org", "[EMAIL]").replace("10.1.2.3", "[IP]")
        assert (r.text or "") == want and r.n_chars in (len(want), None)
    assert clean <= ids["mixing"] and len(ids["mixing"] & set(range(340, 400))) < 30
    packed = seen["best_fit_packing"]
    assert ids["best_fit_packing"] == ids["mixing"]
    left = {r.doc_id: len((r.text or "").split()) for r in seen["mixing"].collect()}
    got = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {i: n + 1 if n else 0 for i, n in left.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, at).collect()} == {tuple(r) for r in packed.collect()}


def test_every_stage_takes_an_empty_table_and_odd_rows(spark, corpus):
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0),
                                 (2, "word " * 50_000, "en", "s", 250_000)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0
        assert stage(spark, odd, at).count() >= 0


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
