"""The registered queries over small tables, and the pipeline against plain code."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cellweave.llm import catalog, quality, syncmers
from conftest import DOCS, sentence


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean documents with near copies and a shared passage, shouting, symbols, and toxic ones; labels for most."""
    rng, there = random.Random(9), tmp_path_factory.mktemp("sf")
    passage = sentence(rng, 60)
    rows, labels = [], []
    for i in range(240):
        text, toxic = sentence(rng, rng.randrange(60, 140)), i % 4 == 1
        if toxic:
            words = text.split()
            words[::9] = [rng.choice(["vile", "wretch", "scoundrel"]) for _ in words[::9]]
            text = " ".join(words)
        elif i % 20 == 2:
            text = text.upper()
        elif i % 20 == 6:
            text = " ".join(w + "%%%" for w in text.split())
        elif i % 20 == 10:
            text += " " + passage
        rows.append((i, text, "en", "s", len(text), "b", "k", "c", 1))
        labels.append((i, int(i % 20 not in (2, 6)), int(toxic)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s", 1, None, None, None, None) for i in range(0, 40, 4)]
    rows += [(2000, None, None, None, None, None, None, None, None), (None, rows[0][1], "en", "s", 1, "", "", "", 0), rows[0]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{there}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{there}/labels.parquet")
    spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p/{i}", "") for i in range(100)], "page_id long, url string, html string").write.parquet(f"{there}/pages.parquet")
    return str(there)


def test_every_query_returns_each_row_once(spark, sf_dir):
    want = Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{n}" for n in range(1, 14)]
    for name, f in catalog.QUERIES.items():
        if int(name[2:].split("_")[0]) > 10:
            continue  # vectors and archives have tests of their own
        got = f(spark, sf_dir)
        if name.startswith("op10_"):
            assert sorted(r.page_id for r in got.collect()) == list(range(100))
        elif name.startswith("op8_"):
            assert Counter(r.doc_id for r in got.filter("piece = 0").collect()) == want
        else:
            assert Counter(r.doc_id for r in got.collect()) == want, name
    assert {*catalog.QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    toxic = {i for i in range(240) if i % 4 == 1}
    clean = {i for i in range(240) if i % 4 != 1}
    assert len(ids["toxicity"] & toxic) < 0.1 * len(toxic) and len(ids["toxicity"] & clean) > 0.95 * len(clean)
    bad = {i for i in clean if i % 20 in (2, 6)}
    assert not ids["quality rules"] & bad and len(ids["quality rules"] & (clean - bad)) > 0.95 * len(clean - bad)
    assert not {i for i in ids["n-gram Jaccard join"] if i is not None and 1000 <= i < 2000 and i - 1000 in ids["quality rules"]} and None in ids["n-gram Jaccard join"]
    assert len([r for r in kept["n-gram Jaccard join"] if r.doc_id == 0]) == 1 and ids["substring dedup"] == ids["n-gram Jaccard join"]
    before = {r.doc_id: r.text for r in kept["n-gram Jaccard join"]}
    carriers = sorted(i for i in ids["substring dedup"] if i is not None and i % 20 == 10)
    after = {r.doc_id: r for r in kept["substring dedup"]}
    words = lambda t: len(re.findall(r"\S+", t))
    assert words(after[carriers[0]].text) == words(before[carriers[0]]) and all(words(before[i]) - words(after[i].text) >= 60 for i in carriers[1:])
    assert all(after[i].n_chars == len(after[i].text) for i in carriers)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids["substring dedup"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_rules_keep_a_table_without_references(spark):
    rows = spark.createDataFrame([(1, sentence(random.Random(0), 50), None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.quality(rows).collect()] == [True]


def test_stages_take_empty_tables_and_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    rng = random.Random(3)
    long = docs.filter("doc_id = 4").withColumn("text", F.lit(sentence(rng, 30_000))).withColumn("doc_id", F.lit(5000).cast("long"))
    rows = docs.filter("doc_id % 4 = 0 and doc_id < 200").unionByName(long)
    for name, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(spark, rows, sf_dir).cache()
        assert rows.filter("doc_id = 5000").count() >= 1, name


def test_columns_with_the_names_of_the_operators_own(spark, sf_dir):
    names = ["_key", "_text", "_w", "_s", "_place", "_KEY_", "score", "kept", "block", "hashes"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("score", "kept", "block").filter("doc_id % 3 = 0")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{'?' if r.doc_id is None else r.doc_id}" for r in rows for n in names), name
    anchored = syncmers.with_anchors(docs)
    assert anchored.columns == [*docs.columns, "anchors"] and anchored.filter("doc_id = 3").first()["_w"] == "_w3"
    binary = quality.judged(docs.withColumn("text", F.col("text").cast("binary")), [])
    assert binary.filter("doc_id = 3").first()["_text"] == "_text3"


def test_of_rows_with_one_id_the_least_text_stays(spark, sf_dir):
    rng = random.Random(8)
    texts = sorted(sentence(rng, 40) for _ in range(3))
    rows = spark.createDataFrame([(7, texts[1], "a"), (7, texts[0], "b"), (7, texts[2], "c"), (7, texts[0], "d"), (8, texts[2] + " x", None)], "doc_id long, text string, source string")
    for n in (1, 5):
        got = corpus_pipeline.keep_one_of_each_group(spark, rows.repartition(n), sf_dir).filter("doc_id = 7").collect()
        assert [r.text for r in got] == [texts[0]]
