"""Rating-file readers.

Input format (one movie after another, with or without empty lines between):

    <item_id>:
    <user_id>,<rating>,<date>
    ...

Files are read line by line, so no record, row or task ever holds a whole movie
or file.  A header is a line that ends in ":".  The scan is written once to
shared storage as (file, split, position, line), so positions are fixed whatever
the split size is later.  A split is cut into pieces of at most PIECE_ROWS lines.  A
line's owner is the last header before it in its piece, or else the last one of the
pieces before.  The window spans one piece, and the number of tasks follows from the
number of lines, so no task sorts more for a larger file or split.

* `read_raw_ratings` ignores empty lines (the form of the original download).
* `read_rating_blocks` reads the normalised form: an empty line ends a block,
  so lines after it without a header of their own are malformed.

LF and CRLF files read alike.  A rating line may have any number of fields; the
first is the user id, a second and third are rating and date if they parse.

Malformed input: mode="skip" drops a rating line whose user id is not a
number and all lines under a header that is not a number; mode="fail"
raises for either.  A file with lines but without any header raises in both
modes.  Ids are trimmed.  A header without ratings yields no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.itemsets import normalise_blocks, strip_blank
from ..plans.runtime import (TASK_ROWS, key_bytes, materialize, materialize_measured, maybe_broadcast,
                             new_scratch)

# Fixed values of the reference's input: file names that hold ratings
# (matched at the start of the name only, no end anchor), the record separator
# of the normalised form and the end of a header line.
RATING_FILE_GLOB = "combined_data_*"
RATING_FILE_REGEX = r"^combined_data_\d+\.txt"
BLOCK_SEP = "\n\n"
HEADER_END = ":"
PIECE_ROWS = 16_384      # lines of a split that are put in order together


def _scan(spark: SparkSession, path: str, line_sep: str, name_regex: str | None,
          path_glob: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", line_sep)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    df = reader.text(path)
    if name_regex:
        # A filter on file metadata: Spark prunes files before reading them.
        df = df.filter(F.col("_metadata.file_name").rlike(name_regex))
    return df


def _id(text: Column, mode: str, what: str) -> Column:
    trimmed = F.trim(text)
    if mode == "skip":
        return trimmed.try_cast("bigint")
    if mode == "fail":
        parsed = trimmed.try_cast("bigint")
        return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"bad {what}: "), text))) \
            .otherwise(parsed)
    raise ValueError("mode must be 'skip' or 'fail'")


def _rating_rows(lines: DataFrame, mode: str) -> DataFrame:
    """(item_raw, line) -> one row per rating line, whatever its number of fields.

    Lines that are no rating lines come as null.  They are told apart inside the
    expressions, as a filter may be evaluated after an id that raises.
    """
    lines = lines.withColumn("f", F.split("line", ","))
    there = F.col("line").isNotNull()
    out = lines.select(
        F.when(there, _id(F.col("item_raw"), mode, "item id")).alias("item_id"),
        F.when(there, _id(F.col("f")[0], mode, "user id")).alias("user_id"),
        F.trim(F.get("f", F.lit(1))).try_cast("int").alias("rating"),
        F.trim(F.get("f", F.lit(2))).try_cast("date").alias("rated_on"))
    return out.filter(F.col("item_id").isNotNull() & F.col("user_id").isNotNull())


def parse_rating_blocks(blocks: DataFrame, mode: str = "skip") -> DataFrame:
    """`value` holding whole blocks -> (item_id, user_id, rating, rated_on).

    For text that is already in a column.  A value that holds several movies
    without empty lines between them is first split at each header (F10), so
    every block has one header.
    """
    text = F.regexp_replace("value", "\r\n", "\n")
    one = blocks.select(F.explode(F.split(normalise_blocks(text), BLOCK_SEP)).alias("value"))
    parts = one.select(F.split(strip_blank("value"), HEADER_END, 2).alias("p"))
    parts = parts.filter(F.size("p") == 2)
    lines = parts.select(F.col("p")[0].alias("item_raw"),
                         F.explode(F.split(F.col("p")[1], "\n")).alias("line"))
    rating = F.when(F.trim("line") != "", F.col("line"))
    return _rating_rows(lines.select("item_raw", rating.alias("line")), mode)


def _owned_lines(lines: DataFrame, n_rows: int, blank_ends_block: bool) -> DataFrame:
    """(file, block, pos, line) -> adds `owner`, the struct of the header a line belongs to.

    `headless` is the path of a file that has lines but no header at all, else null.
    """
    spark, keys = lines.sparkSession, ["file", "block", "piece"]
    header = F.when(F.col("line").endswith(HEADER_END), F.struct(
        F.expr("substring(line, 1, length(line) - 1)").alias("id")))
    if blank_ends_block:
        header = header.when(F.col("line") == "", F.struct(F.lit(None).cast("string").alias("id")))
    # Positions of a split are consecutive (but for lines left out), so its pieces are in its order.
    rows = lines.withColumn("head", header).withColumn("piece", F.floor(F.col("pos") / PIECE_ROWS))
    # One row per piece, of numbers only: an aggregate of texts would sort whole scan tasks.
    pieces = materialize(rows.groupBy(*keys).agg(
        F.max(F.when(F.col("head").isNotNull(), F.col("pos"))).alias("tail_pos"),
        F.max(F.col("line").endswith(HEADER_END)).alias("any_header"),
        F.max(F.col("line") != "").alias("any_line")), new_scratch(spark, "pieces"))
    n_bytes = pieces.agg(F.coalesce(F.sum(key_bytes(pieces, keys)), F.lit(0))).first()[0]
    ends = pieces.filter("tail_pos IS NOT NULL").select(F.col("tail_pos").alias("pos"))
    tails = (rows.filter(F.col("head").isNotNull()).join(maybe_broadcast(ends, int(n_bytes)), "pos")
             .select(F.col("pos").alias("tail_pos"), F.col("head").alias("tail")))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)
    no_header = F.max("any_line").over(of_file) & ~F.max("any_header").over(of_file)
    carry = materialize(pieces.join(tails, "tail_pos", "left").select(
        *keys, F.last("tail", ignorenulls=True).over(before).alias("carry"),
        F.when(no_header, F.col("file")).alias("headless")), new_scratch(spark, "carry"))
    carry_bytes = carry.agg(F.coalesce(F.sum(
        key_bytes(carry, [*keys, "headless"]) + F.coalesce(F.octet_length("carry.id"), F.lit(0))), F.lit(0))).first()[0]
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = (rows.repartition(max(1, math.ceil(n_rows / TASK_ROWS)), *keys)
            .withColumn("here", F.last("head", ignorenulls=True).over(upto)))
    return (here.join(maybe_broadcast(carry, int(carry_bytes)), keys)
            .withColumn("owner", F.coalesce("here", "carry")))


def _read(spark: SparkSession, path: str, mode: str, name_regex: str | None,
          path_glob: str | None, blank_ends_block: bool) -> DataFrame:
    scan = _scan(spark, path, "\n", name_regex, path_glob).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        strip_blank("value").alias("line"))
    if not blank_ends_block:
        scan = scan.filter(F.col("line") != "")
    lines, seen = materialize_measured(scan, new_scratch(spark, "rating-lines"), [F.count(F.lit(1)).alias("rows")])
    owned = _owned_lines(lines, int(seen["rows"]), blank_ends_block)
    is_header = F.col("line").endswith(HEADER_END)
    wanted = ~is_header & (F.col("line") != "")
    if mode == "fail":
        bad = is_header & F.trim(F.col("owner.id")).try_cast("bigint").isNull()
        wanted = F.when(bad, F.raise_error(F.concat(F.lit("bad item id: "), "line"))).otherwise(wanted)
    no_header = F.raise_error(F.concat(F.lit("no header line in "), "headless")).cast("boolean")
    wanted = F.when(F.col("headless").isNotNull(), no_header).otherwise(wanted)
    item = F.col("owner.id")
    if mode == "fail":
        item = F.coalesce(item, F.lit(""))      # a line before any header
    return _rating_rows(owned.select(item.alias("item_raw"), F.when(wanted, F.col("line")).alias("line")), mode)


def read_rating_blocks(spark: SparkSession, path: str, mode: str = "skip",
                       name_regex: str | None = None, path_glob: str | None = None) -> DataFrame:
    """Normalised rating files -> (item_id, user_id, rating, rated_on)."""
    return _read(spark, path, mode, name_regex, path_glob, blank_ends_block=True)


def read_raw_ratings(spark: SparkSession, path: str, mode: str = "skip",
                     name_regex: str | None = None, path_glob: str | None = None) -> DataFrame:
    """Raw rating files (no empty lines) -> (item_id, user_id, rating, rated_on)."""
    return _read(spark, path, mode, name_regex, path_glob, blank_ends_block=False)


def select_rating_files(spark: SparkSession, path: str, name_regex: str = RATING_FILE_REGEX,
                        path_glob: str = RATING_FILE_GLOB) -> DataFrame:
    """S3: paths of the rating files in a folder (names only, no data read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", path_glob).load(path)
             .select("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.rlike(name_regex)).select(name.alias("file_name"), "path")
