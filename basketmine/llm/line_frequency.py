"""Quality rules from cross-document line frequency.

Lines are normalised and hashed together with their host.  A line that more
than `max_line_docs` distinct documents of one host share is boilerplate and is
removed; a document that loses more than `max_lost_percent` of its words is
depleted and rejected.  A few rules on the document alone come first.

DataFrame functions only; no Python runs on the executors.  The text is read
once; everything after that works on a narrow table of hashes in shared
storage.  Counting pre-aggregates by (line, document) and then by line, so a
line that every document holds is one row per task in the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmine.llm.common import SPACE, WORD, text_or_empty
from basketmine.plans.runtime import materialize, new_scratch

MIN_WORDS = 50               # base rule: shorter documents fail
MAX_REPEAT_PERCENT = 50      # base rule: share of words in repeated 3-word windows
MAX_LINE_DOCS = 10           # documents of one host that may share a line
MAX_LOST_PERCENT = 50        # share of words a document may lose to removed lines
SYMBOLS = "#*$%&|<>"
KEY = "_lf_key"


def normalise_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed, digits as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]", "0")


def document_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and `_lf_lines`.

    n_repeat_words counts the words inside 3-word windows that occur twice or
    more in the text.  Windows are hashed to 64 bits.  Only where some hash
    repeats, (hash, position) pairs are sorted, pairs with an equal neighbour
    are kept, and their 3-word spans are added up without overlap.
    """
    t, words, pairs, at = (text_or_empty(text), F.col("_lf_words"), F.col("_lf_pairs"),
                           F.col("_lf_at"))
    window_hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    sorted_pairs = F.sort_array(
        F.transform("_lf_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def same(a, b):
        return F.coalesce(a["g"] == b["g"], F.lit(False))

    repeated = F.filter(pairs, lambda p, i: same(p, F.get(pairs, i - 1)) | same(p, F.get(pairs, i + 1)))
    span = F.transform(at, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(at, i - 1), p - 3)))
    return (df.withColumn("_lf_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
            .withColumn("_lf_grams", F.when(F.size(words) >= 4, window_hashes))
            .withColumn("_lf_pairs", F.when(
                F.size(F.array_distinct("_lf_grams")) < F.size("_lf_grams"), sorted_pairs))
            .withColumn("_lf_at", F.sort_array(F.transform(repeated, lambda p: p["i"])))
            .withColumn("_lf_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
            .withColumn("n_words", F.size(words).cast("long"))
            .withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
            .withColumn("n_symbols",
                        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines",
                        (F.size("_lf_lines") - F.size(F.array_distinct("_lf_lines"))).cast("long"))
            .withColumn("n_repeat_words",
                        F.coalesce(F.aggregate(span, F.lit(0), lambda a, x: a + x),
                                   F.lit(0)).cast("long"))
            .drop("_lf_words", "_lf_grams", "_lf_pairs", "_lf_at"))


def _line_hash(host: Column, line: Column) -> Column:
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")), normalise_line(line))


def frequent_lines(lines: DataFrame, max_line_docs: int) -> DataFrame:
    """Hashes of the lines that more than `max_line_docs` distinct documents hold."""
    return (lines.groupBy("h").agg(F.count_distinct(KEY).alias("n_docs"))
            .filter(F.col("n_docs") > max_line_docs))


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          keep=("doc_id",), min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT, max_line_docs: int = MAX_LINE_DOCS,
          max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Judge every document; one row per input row.

    Returns the `keep` columns, the statistics of `document_stats`, base_failed,
    n_lost_words (words in removed lines), `lost_lines` (hashes of removed
    lines, for `remove_lines`) and kept.

    Defined cases: a null or empty text has no words and fails the base rule;
    a null host is a host of its own; a null id is an id like any other; rows
    equal in id, host and text are one document when lines are counted, and all
    get its verdict; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(*[F.col(c).alias(f"_lf_k{i}") for i, c in enumerate(keep)],
                      F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(host).isNull(), host,
                                 F.col(text).isNull(), text).alias(KEY),
                      F.col(host).cast("string").alias("_lf_host"), F.col(text).alias("_lf_text"))
    hashed = F.transform("_lf_lines", lambda x: F.struct(
        _line_hash(F.col("_lf_host"), x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = materialize(document_stats(src, "_lf_text").withColumn("_lf_lines", hashed)
                       .drop("_lf_text", "_lf_host"), new_scratch(spark, "lines"))
    lines = (rows.select(KEY, "_lf_lines").dropDuplicates([KEY])
             .select(KEY, F.explode("_lf_lines").alias("x")).select(KEY, "x.h", "x.w"))
    bad = frequent_lines(lines, max_line_docs).select("h")
    lost = (lines.join(bad, "h", "left_semi").groupBy(F.col(KEY).alias("_lf_lost"))
            .agg(F.sum("w").alias("n_lost_words"), F.collect_set("h").alias("lost_lines")))
    n_lost = F.coalesce("n_lost_words", F.lit(0)).cast("long")
    base_failed = ((F.col("n_words") < min_words)
                   | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    depleted = 100 * n_lost > max_lost_percent * F.col("n_words")
    return (rows.join(lost, F.col(KEY) == F.col("_lf_lost"), "left")
            .select(*[F.col(f"_lf_k{i}").alias(c) for i, c in enumerate(keep)],
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed.alias("base_failed"), n_lost.alias("n_lost_words"), "lost_lines",
                    (~base_failed & ~depleted).alias("kept")))


def remove_lines(text: Column, host: Column, lost_lines: Column) -> Column:
    """`text` without the lines whose hashes are in `lost_lines` (null: all lines stay)."""
    lines = F.split(text, "\n")
    stay = F.filter(lines, lambda x: ~F.array_contains(lost_lines, _line_hash(host, x)))
    return F.when(lost_lines.isNull(), text).otherwise(F.array_join(stay, "\n"))
