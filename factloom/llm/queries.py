"""The corpus operators' queries, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, decontaminate, idstore, langid, neardup, perplexity, repeats, secrets, sharding
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), digest=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.telephony(table(spark, sf_dir, "documents"))


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.read(spark, idstore.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), width=2).drop("class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality, op3_shards, op4_decontamination, op5_repeats, op6_secrets, op7_bpe, op8_telephony, op9_id_store, op10_near_duplicates)
}

#: Near duplicates in SQL: distinct pairs of words, similarities by a join on them, components by the closure of the links.
ORACLE: dict[str, str] = {
    "op10_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM n LEFT JOIN least_ ON doc_id = a""",
}
