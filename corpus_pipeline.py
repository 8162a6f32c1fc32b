"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Rows
that a stage rejects are gone for all later ones. Null or empty texts: the quality stage judges them by their zero
counts, the language stage rejects them. Repeated rows: the near-duplicate stage keeps one of each document.
Rows that share an id but not their text are documents of their own. An empty table passes through every stage.
Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language_id, ngram_join, packing, pii, quality_classifier, tables
from logloom.llm.queries import held_out, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    into = tables.fresh(docs, "quality")
    found = quality_classifier.classify(docs, labels, F.col("source"), F.col("lang"), into=into)
    return found.where(F.col(into)["kept"]).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's model accepts."""
    model = language_id.train(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    into = tables.fresh(docs, "language")
    return language_id.identify(docs, model, into=into).where(~F.col(into)["rejected"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram overlap the one of smallest id, once.

    Rows are told apart by id and text: those that share an id but not their text are documents of their own.
    """
    by_id, by_text = tables.fresh(docs, "id"), tables.fresh(docs, "mark")
    found = ngram_join.linked(docs).where("id is not null").groupBy("id", "mark").agg(F.max("leader").alias("leader"), F.count("*").alias("n"))
    found = tables.written(found.withColumnsRenamed({"id": by_id, "mark": by_text}), "near-duplicates")
    again = found.where("leader and n > 1").select(by_id, by_text)
    gone = found.where("not leader").select(by_id, by_text)
    keyed = docs.withColumn(by_text, F.xxhash64("text"))
    same = lambda other: (keyed["doc_id"] == other[by_id]) & (keyed[by_text] == other[by_text])
    if again.isEmpty():
        gone = tables.small_or_not(gone)
        return keyed.join(gone, same(gone), "left_anti").select(*docs.columns)
    once = keyed.join(again, same(again), "left_semi").dropDuplicates(["doc_id", by_text])
    gone = tables.small_or_not(gone.unionByName(again))
    return keyed.join(gone, same(gone), "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    into = tables.fresh(docs, "spans")
    weights = pii.train(pii.candidates(docs, keep=[]))
    rows = pii.annotate(pii.candidates(docs, into=into), weights, into=into)
    spans = F.col(into)["spans"]
    masked = rows.withColumn("text", pii.redacted(F.col("text"), spans)).withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, limits=packing.Limits())


STAGES = [("quality classifier", quality), ("language id", language), ("n-gram jaccard join", near_duplicates), ("pii", personal_data), ("packing", pack)]
#: The stages run trained models, a similarity join and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
