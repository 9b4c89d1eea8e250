"""Readers for the text outputs of a mining run.

Records are tab separated; a set is a comma separated list.  Records that
do not have the expected number of fields are dropped (the reference logs
and skips them), as are empty lines.  Items are taken as they are, blanks
included; only numbers are parsed with blanks around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.itemsets import FIELD_SEP, ITEM_SEP, RULE_ITEM_SEP, canonical


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("sep", FIELD_SEP).option("quote", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "DROPMALFORMED").csv(path))


def _set(text_col: str, item_type: str):
    def item(x):
        return x if item_type == "string" else F.trim(x).cast(item_type)

    return canonical(F.transform(F.split(F.col(text_col), ITEM_SEP), item))


def read_itemsets_text(spark: SparkSession, path: str, item_type: str = "string") -> DataFrame:
    """`i1,i2,.. \\t support` -> (k, items, support)."""
    df = _tsv(spark, path, "items_text STRING, support DOUBLE")
    df = df.filter(F.col("items_text").isNotNull() & F.col("support").isNotNull())
    df = df.select(_set("items_text", item_type).alias("items"), "support")
    return df.select(F.size("items").alias("k"), "items", "support")


def read_baskets_text(spark: SparkSession, path: str, item_type: str = "string",
                      user_type: str = "bigint") -> DataFrame:
    """`user \\t i1,i2,..` -> (user_id, items)."""
    df = _tsv(spark, path, "user_text STRING, items_text STRING")
    df = df.filter(F.col("user_text").isNotNull() & F.col("items_text").isNotNull())
    return df.select(F.trim("user_text").cast(user_type).alias("user_id"),
                     _set("items_text", item_type).alias("items"))


def read_rules_text(spark: SparkSession, path: str, item_type: str = "string") -> DataFrame:
    """`[a, b] -> c \t confidence` -> (k, antecedent, consequent, confidence)."""
    df = _tsv(spark, path, "rule STRING, confidence DOUBLE")
    pattern = r"^\[(.*)\] -> (.*)$"
    df = df.filter(F.col("rule").rlike(pattern) & F.col("confidence").isNotNull())
    items = F.split(F.regexp_extract("rule", pattern, 1), RULE_ITEM_SEP)
    antecedent = canonical(F.transform(items, lambda x: x.cast(item_type)))
    df = df.select(antecedent.alias("antecedent"),
                   F.regexp_extract("rule", pattern, 2).cast(item_type).alias("consequent"), "confidence")
    return df.select((F.size("antecedent") + 1).alias("k"), "antecedent", "consequent", "confidence")


def read_candidates_text(spark: SparkSession, path: str, item_type: str = "string") -> DataFrame:
    """one set per line -> (k, items); empty lines skipped."""
    df = spark.read.text(path).filter(F.col("value") != "")
    df = df.select(_set("value", item_type).alias("items"))
    return df.select(F.size("items").alias("k"), "items")
