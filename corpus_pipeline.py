"""Corpus pipeline: from raw documents to token ids, in five stages.

1. quality: the ordinal classifier drops documents it rejects.
2. near_duplicates: one document of each group of near copies stays.
3. pseudonyms: personal data in the texts is replaced within its format.
4. mixture: documents are taken by source weights; a repeat is a repeated row.
5. tokens: texts become token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of `docs`, whatever else these hold.
Null texts count as empty; an empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketmine.llm import chosen_path, mixing, ordinal, pieces, pii
from basketmine.llm.common import table
from basketmine.llm.queries import KEEP_TAIL, quality_model
from basketmine.plans.runtime import materialize, new_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of at least grade 1 is KEEP_TAIL or more."""
    model = quality_model(spark, docs, sf_dir)
    graded = docs.withColumn("_cp_grade", ordinal.grade_column(F.col("text"), model))
    return graded.filter(F.col("_cp_grade.tail") >= KEEP_TAIL).drop("_cp_grade")


def _row_key(doc_id, text_hash):
    return F.xxhash64(doc_id.isNull(), doc_id, text_hash)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group; texts without words all stay.

    Rows equal in id and text are copies of one another; one of them stays.
    """
    found = chosen_path.join(docs.select("doc_id", "text"))
    stay = (found.filter("first")
            .select(_row_key(F.col("doc_id"), F.col("text_hash")).alias("_cp_key")).distinct())
    keyed = docs.withColumn("_cp_key", _row_key(F.col("doc_id"), F.xxhash64("text")))
    one = Window.partitionBy("_cp_key").orderBy(F.lit(0))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return (keyed.join(stay, "_cp_key", "left_semi").withColumn("_cp_i", F.row_number().over(one))
            .filter((F.col("_cp_i") == 1) | wordless).select(*docs.columns))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; n_chars follows the new text."""
    out = docs.withColumn("text", pii.pseudonymise(F.col("text"))["text"])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the documents of each source towards its target; repeats are repeated rows."""
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, source, lang, n_tokens, ids, round_trip."""
    return pieces.encode_documents(docs, keep=("doc_id", "source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("tokens", tokens),
]

# A trained classifier, keyed pseudonyms and Viterbi segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each written to shared storage before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), new_scratch(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
