"""From raw documents to packed training sequences, as a chain of corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. Between stages the rows are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cellweave.llm import ngram_join, packing, quality, substring_dedup, toxicity
from cellweave.llm.catalog import tokenizer_path
from cellweave.llm.common import free_name, table, written

#: Word shingles and likeness, in percent, from which two documents are near duplicates.
SHINGLE_WORDS, LIKENESS = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay. Rows are told apart by a 64-bit hash of id and text, so null and repeated ids do no harm.

    Repeated rows share a score, a null text is scored as an empty one, very long texts are scored whole, and an empty
    table stays empty.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    learnt = keyed.select("doc_id", key).join(labels, "doc_id").select(F.col(key).alias("doc_id"), "label")
    scored = toxicity.scores(keyed.select(F.col(key).alias("doc_id"), "text"), learnt)
    toxic = scored.filter("score >= 0.5").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(toxic, key, "left_anti").select(docs.columns)


def drop_unlike_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged against what ``docs`` of their languages look like together.

    Null texts and those of under twenty words go, very long ones are judged whole, repeated rows share a verdict, and
    an empty table stays empty.
    """
    names = {n: f"_d{i}" for i, n in enumerate(n for n, _ in quality.COLUMNS) if n in docs.columns}
    rows = quality.quality(docs.withColumnsRenamed(names)).filter("kept")
    return rows.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows with one id that with the least text. Null ids stay.

    A null text comes before all others; rows of one id and text are told apart by a hash of all columns. Texts are
    compared whole, and an empty table stays empty.
    """
    groups = written(ngram_join.jaccard_components(docs, SHINGLE_WORDS, LIKENESS), "groups")
    stay = groups.filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").select(docs.columns)
    if not groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        place = free_name(docs, "_place")
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns)))
        known = known.withColumn(place, first).filter(F.col(place) == 1).drop(place)
    return known.unionByName(docs.filter("doc_id is null"))


def drop_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word that lies in fifty words which also stand in a smaller document is taken out; ``n_chars`` follows."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = substring_dedup.remove_shared_windows(docs.withColumnsRenamed(names))
    values = {c: F.col(names.get(c, c)) for c in docs.columns}
    if "n_chars" in values:
        values["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(name) for name, c in values.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences; a null text is one piece of the end token, a very long one as many pieces as it needs, an empty table gives none."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_unlike_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", drop_shared_passages),
    ("best-fit packing", pack),
]
#: Trained scores and a tokenizer are beyond SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over ``documents``; any of them may leave an empty table to the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
