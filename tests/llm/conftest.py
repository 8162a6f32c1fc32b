import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def staged(spark, sf, docs):
    """(name, what the stage made, its rows as a table) of the pipeline's stages but the last, each run on its predecessor's rows."""
    import corpus_pipeline

    now, out = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = stage(spark, now, sf)
        now = spark.createDataFrame(then.collect(), docs.schema)
        out.append((name, then, now))
    return out


#: Null, empty and blank texts, odd characters, ties, a repeated row, a null id, and columns that clash with ours.
HARD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "Le café était très bon, n'est-ce pas?\n\n  Oui 123!", "fr"), (5, "a" * 3000 + " " + "b c " * 500, "en"), (5, "a" * 3000 + " " + "b c " * 500, "en"),
    (6, "The same text again and again.", "en"), (7, "The same text again and again.", "en"), (8, "日本語のテキスト、　テスト ①   x", "ja"), (9, "<|endoftext|> don't ▁ \r\n <s> x", "de"), (None, "no id here at all", "en"),
    (10, "x@y.zz +1 (743) 555-3824 10.0.0.1 4111 1111 1111 1111\n" * 3, "en"), (11, "\x00\x01 \x1c", "en"), (-12, "word", "es"),
]


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t, x) for i, t, x in HARD], "doc_id long, text string, lang string").repartition(3)
    return rows.withColumn("n_tokens", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("start", F.lit(None).cast("int")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("1 = 0")
