"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before
it kept, and returns documents again; the last one returns the packed pieces. A
stage's result is written as Parquet and read again as the next one's documents.

All stages take documents with doc_id, text, lang, source and any other columns, of
any name; these come along unchanged. What a stage does with null ids and texts, ties,
repeated rows and empty tables is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomwright.llm import langid, mixing, neardup, packing, suffixes
from bomwright.llm.common import materialize, packed, restored, table

#: Documents whose language is less sure than this go.
LEAST_SCORE = 0.5


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts every document's language; those without a letter or a likely language go, lang is what was predicted.

    Null and empty texts go; of languages with equally short codes the first by name is
    taken, with a score of a half at most, so exact ties of two stay; null ids are judged
    like others but not learned from; repeated rows all stay or all go; an empty table,
    and one without any known language, give no rows.
    """
    others = _others(docs)
    rows = docs.select("doc_id", "text", packed(others).alias("carried"))
    found = langid.predict(rows, langid.learn(docs.select("doc_id", "text", "lang")))
    likely = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return likely.select(*restored(docs.columns, others, lang=F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the least id, then the least hash of its text, then of its other columns.

    Near-duplicates have four fifths of their five-word shingles in common, as far as
    128 bits show it, or are linked by others that have.
    A null id comes last; null, empty and wordless texts are one group; of repeated rows
    one stays, also where ids are null or shared; an empty table gives no rows.
    """
    others, text_hash = _others(docs), F.xxhash64("text")
    rows = neardup.grouped(docs.select("doc_id", "text", text_hash.alias("text_hash")), similar=True)
    least = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = least.groupBy(F.col("root").alias("first_root")).agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("first_hash"), F.count("*").alias("n_rows"))
    whole = docs.select("doc_id", "text", text_hash.alias("text_hash"), packed(others).alias("carried"))
    kept = whole.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    # Only of groups in which the id is not one row's alone several rows can be here.
    row = ["doc_id", "text", "carried"]
    again = kept.where("n_rows > 1").groupBy("first_root").agg(F.min_by(F.struct(*row), F.xxhash64(F.to_json("carried"))).alias("r")).select("r.*")
    return kept.where("n_rows = 1").select(*row).unionByName(again).select(*restored(docs.columns, others))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur elsewhere are cut out of every text; characters cut in half go with them.

    Every row stays, with what is left of its text, maybe nothing; null texts become
    empty; n_chars, if there is one, is counted anew; repeated rows are separate
    documents, so of texts of 200 bytes or more nothing is left in either; an empty
    table gives no rows.
    """
    others = _others(docs)
    done = suffixes.remove_repeats(docs, kept_bytes=True, characters=True)
    rebuilt = done.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return rebuilt.select(*restored(docs.columns, others, n_chars=F.length("text").cast("bigint")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source of its own; texts without words are taken as often as
    their whole source at least; repeated rows are drawn by one number, and those at the
    cut are alike to it; an empty table gives no rows.
    """
    mixed = mixing.pareto_mix(docs, carry=True).where("copies > 0")
    again = mixed.select("carried", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return again.select(*restored(docs.columns, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens.

    Null text is the empty text, one piece with the end id only; null ids and repeated
    rows are documents like others; other columns are left out; an empty table gives no
    rows.
    """
    return packing.best_fit_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL cannot express the tokenizer or the language model; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
