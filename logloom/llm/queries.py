"""The ten operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe_codec, language_id, media, ngram_join, packing, pii, quality_classifier, quality_rules, tables, token_counts, token_output


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2, limits=packing.Limits())


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stored = media.store_media(docs)
    page = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    items = media.parse_html(stored.select(F.struct("doc_id", "n_bytes").alias("key"), page.alias("html")), "key", "html")
    found = media.resolve(items, "key", media.read_media(stored))
    return found.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return language_id.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.written(pii.candidates(documents(spark, sf_dir), keep=["doc_id"]), "pii-spans")
    rows = pii.annotate(found, pii.train(found))
    counts = [pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"), keep=["doc_id"])
    return found


# Parts of the operators' results that SQL can say.


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of op2's payloads, read back from what was stored."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 without the method's verdict."""
    return op3_quality_rules(spark, sf_dir).drop("score", "kept")


def codec_decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's decoded texts, which are the texts themselves."""
    return op5_bpe_codec(spark, sf_dir).select("doc_id", "decoded_sha256")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base spans by kind."""
    found = pii.candidates(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", *[pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE])


OPERATORS = (op1_packing, op2_media_columns, op3_quality_rules, op4_language_id, op5_bpe_codec, op6_token_output, op7_ngram_join, op8_token_counts, op9_pii, op10_quality_classifier)
QUERIES = {f.__name__: f for f in (*OPERATORS, media_payloads, rules_base_counts, codec_decoded_texts, pii_base_counts)}

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PADDED = "576 * greatest(1, (strlen(t) + 575) // 576)"
_TEXTS = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
 grams AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
 flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams),
 shared AS (SELECT gram, row_number() OVER () AS k FROM flat GROUP BY gram HAVING count(*) > 1),
 held AS (SELECT doc_id, n, k FROM flat JOIN shared USING (gram)),
 links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = id)
 SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM grams JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) ON id = doc_id""",
    "media_payloads": rf"SELECT doc_id, strlen(t)::BIGINT AS n_bytes, ({_PADDED})::BIGINT AS payload_bytes, sha256(encode(t) || repeat('\xFF'::BLOB, ({_PADDED} - strlen(t))::BIGINT)) AS payload_sha256 FROM {_TEXTS}",
    "rules_base_counts": rf"""WITH texts AS (SELECT *, regexp_extract_all(t, {_WORD}) AS w FROM {_TEXTS}),
 windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
 again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
 lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS l FROM texts)
 SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
 FROM texts JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "codec_decoded_texts": f"SELECT doc_id, sha256(t) AS decoded_sha256 FROM {_TEXTS}",
    "pii_base_counts": rf"""WITH found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS i, list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: {_digits_sql('x')}) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_digits_sql('x')})) AS p FROM {_TEXTS})
 SELECT doc_id, len(e)::BIGINT AS n_email, len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
 len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN x[-k]::INT WHEN x[-k]::INT > 4 THEN 2 * x[-k]::INT - 9 ELSE 2 * x[-k]::INT END)) % 10 = 0))::BIGINT AS n_card, len(list_filter(p, lambda x: x BETWEEN 9 AND 15))::BIGINT AS n_phone FROM found""",
}
