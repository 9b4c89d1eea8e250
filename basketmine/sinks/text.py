"""Writers for mining outputs (K1-K6) and for rating files.

Text outputs use the reference's record shapes; parquet outputs keep the
typed columns and are partitioned by level.  Every writer is a plain
DataFrame write: each task writes its own part file.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import FIELD_SEP, items_text, items_text_as_strings, rule_text
from ..plans.runtime import TASK_ROWS, key_bytes, materialize, maybe_broadcast, new_scratch
from ..sources.blocks import HEADER_END


def _checked(items):
    """The set, if no item holds a separator of the text format."""
    as_text = F.transform(items, lambda x: x.cast("string"))
    bad = F.exists(as_text, lambda x: x.rlike("[,\t\r\n]"))
    return F.when(bad, F.raise_error(F.concat(F.lit("an item holds a separator: "),
                                              F.array_join(as_text, " | ")))).otherwise(items)


def _write_text(value: DataFrame, path: str, partition_by: str | None = None,
                line_sep: str | None = None) -> None:
    writer = value.write.mode("overwrite")
    if line_sep is not None:
        writer = writer.option("lineSep", line_sep)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.text(path)


def itemsets_text(itemsets: DataFrame) -> DataFrame:
    """K1 record: `i1,i2,.. \\t support` (with `k` kept for partitioning)."""
    return itemsets.select("k", F.concat_ws(FIELD_SEP, items_text(_checked(F.col("items"))),
                                            F.col("support").cast("string")).alias("value"))


def write_itemsets_text(itemsets: DataFrame, path: str, by_level: bool = True) -> None:
    out = itemsets_text(itemsets)
    _write_text(out if by_level else out.select("value"), path, "k" if by_level else None)


def write_baskets_text(baskets: DataFrame, path: str) -> None:
    """K2 record: `user \\t i1,i2,..`."""
    _write_text(baskets.select(F.concat_ws(FIELD_SEP, F.col("user_id").cast("string"),
                                           items_text(_checked(F.col("items")))).alias("value")), path)


def write_rules_text(rules: DataFrame, path: str, by_level: bool = True) -> None:
    """K3 record: `[a, b] -> c \\t confidence`."""
    out = rules.select("k", F.concat_ws(FIELD_SEP, rule_text("antecedent", "consequent"),
                                        F.col("confidence").cast("string")).alias("value"))
    _write_text(out if by_level else out.select("value"), path, "k" if by_level else None)


def write_candidates_text(candidates: DataFrame, path: str, by_level: bool = True) -> None:
    """K4 record: one set per line, ids in string order as the reference sorts them."""
    out = candidates.select("k", items_text_as_strings(_checked(F.col("items"))).alias("value"))
    _write_text(out if by_level else out.select("value"), path, "k" if by_level else None)


def _stored(df: DataFrame, path: str, by_level: bool = True) -> DataFrame:
    """Writes `df` as parquet and returns the written table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("k") if by_level else writer).parquet(path)
    # A table written by level has no file at all when it is empty.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_result(result, path: str, with_rules: bool = True) -> dict[str, DataFrame]:
    """K5: the tables of one run as parquet, each evaluated once; returns the written tables."""
    out = {"itemsets": _stored(result.itemsets(), f"{path}/itemsets"),
           "baskets": _stored(result.baskets(), f"{path}/baskets", by_level=False)}
    if with_rules and len(result.levels) > 1:
        out["rules"] = _stored(result.rules(), f"{path}/rules")
    return out


def write_outputs(result, path: str, *, candidates: DataFrame | None = None,
                  recommendations: DataFrame | None = None) -> None:
    """Every output of a run: the parquet tables of `write_result` plus
    statistics, candidates and recommendations, and the text forms (K1-K4) under `text/`.

    Each table is evaluated by one write; its text form, and the statistics'
    number of candidates, come from the written table.
    """
    out = write_result(result, path)
    if candidates is not None:
        out["candidates"] = _stored(candidates, f"{path}/candidates")
    _stored(result.stats(out.get("candidates")), f"{path}/stats", by_level=False)
    if recommendations is not None:
        _stored(recommendations, f"{path}/recommendations", by_level=False)
    for name, write in (("itemsets", write_itemsets_text), ("baskets", write_baskets_text),
                        ("rules", write_rules_text), ("candidates", write_candidates_text)):
        if name in out:
            write(out[name], f"{path}/text/{name}")


def read_outputs(spark, path: str) -> dict[str, DataFrame]:
    """The parquet tables of `write_outputs`, by name.

    A table written by level has no file at all when it is empty, so its schema
    is stated here; the item type comes from the baskets, which are not.
    """
    baskets = spark.read.parquet(f"{path}/baskets")
    sets = baskets.schema["items"].dataType.simpleString()
    item = baskets.schema["items"].dataType.elementType.simpleString()
    by_level = {
        "itemsets": f"items {sets}, freq long, support double, k int",
        "candidates": f"items {sets}, k int",
        "rules": f"antecedent {sets}, consequent {item}, confidence double, support double, "
                 "antecedent_support double, k int",
    }
    out = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in by_level.items()}
    return out | {"baskets": baskets} | {name: spark.read.parquet(f"{path}/{name}")
                                         for name in ("stats", "recommendations")}


BLOCK_ROWS = 100_000     # ratings under one header before it is repeated
_ORDER = ["_item", "_chunk", "_kind"]


def block_lines(lines: DataFrame, *, normalised: bool, max_block_rows: int = BLOCK_ROWS,
                by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., item_id, line) -> the lines of rating files in order, headers among them.

    Columns: `by`, `value` and the order (_item, _chunk, _kind).  Headers and
    ratings are rows of their own, so no item is ever one value.  An item with more
    than `max_block_rows` lines is dealt into chunks by a hash of the line, each
    under a header of its own; chunks are spread over the partitions, whose number
    follows from the number of lines, and sorted there.  Readers that go by the header above a line see one item.  With
    `normalised` an empty line ends a chunk.
    """
    spark = lines.sparkSession
    rows = lines.select(*by, F.col("item_id").cast("string").alias("_item"), F.col("line").alias("value"))
    keys = [*by, "_item"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunks = materialize(counts.select(*keys, "_n", F.greatest(F.lit(1), F.ceil(F.col("_n") / max_block_rows))
                                       .cast("int").alias("_c")), new_scratch(spark, "chunks"))
    hot = chunks.filter("_c > 1").drop("_n")
    found = chunks.agg(F.sum("_n").alias("rows"),
                       F.sum(F.when(F.col("_c") > 1, key_bytes(chunks, keys))).alias("bytes")).first()
    n_tasks = math.ceil((found["rows"] or 0) / TASK_ROWS)
    dealt = (rows.join(maybe_broadcast(hot, int(found["bytes"] or 0)), keys, "left")
             .withColumn("_chunk", F.pmod(F.xxhash64("value"),
                                          F.coalesce("_c", F.lit(1))).cast("int")))
    marks = [F.struct(F.lit(0).alias("_kind"), F.concat("_item", F.lit(HEADER_END)).alias("value"))]
    if normalised:
        marks.append(F.struct(F.lit(2).alias("_kind"), F.lit("").alias("value")))
    heads = (chunks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_chunk"))
             .select(*keys, "_chunk", F.explode(F.array(*marks)).alias("_m"))
             .select(*keys, "_chunk", "_m._kind", "_m.value"))
    every = dealt.select(*keys, "_chunk", F.lit(1).alias("_kind"), "value").unionByName(heads)
    number = [n_tasks] if n_tasks > 1 else []
    return (every.repartition(*number, *keys, "_chunk").sortWithinPartitions(*by, *_ORDER)
            .select(*by, *_ORDER, "value"))


def rating_lines(ratings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., item_id, user_id, rating, rated_on) -> (by..., item_id, line)."""
    line = F.concat_ws(",", F.col("user_id").cast("string"),
                       F.coalesce(F.col("rating").cast("string"), F.lit("")),
                       F.coalesce(F.date_format("rated_on", "yyyy-MM-dd"), F.lit("")))
    return ratings.select(*by, "item_id", line.alias("line"))


def write_block_lines(lines: DataFrame, path: str, raw: bool = False, max_block_rows: int = BLOCK_ROWS,
                      line_sep: str = "\n") -> None:
    """Rating files from (item_id, line): normalised (an empty line after each block) or raw."""
    rows = block_lines(lines, normalised=not raw, max_block_rows=max_block_rows)
    _write_text(rows.select("value"), path, line_sep=line_sep)


def write_rating_blocks(ratings: DataFrame, path: str, raw: bool = False,
                        max_block_rows: int = BLOCK_ROWS) -> None:
    """K6: rating files, normalised (empty line between blocks) or raw."""
    write_block_lines(rating_lines(ratings), path, raw, max_block_rows)


def write_named_text_files(value: DataFrame, folder: str, names: list[str],
                           name_col: str = "file_name") -> None:
    """Writes rows of `block_lines` with `name_col == n` to files `<folder>/<n>.<part>`.

    One pass: the rows are written once, partitioned by the index of their
    target name; Spark names its part files itself, so the parts are then
    renamed one by one through the Hadoop file system API (on an object store
    each rename is a copy).
    Rows whose name is not in `names` are not written.
    """
    spark = value.sparkSession
    index = F.coalesce(*[F.when(F.col(name_col) == n, F.lit(i)) for i, n in enumerate(names)])
    # Sorted by file first, as a write by file asks for; so the lines keep their order.
    staged = (value.withColumn("_file", index).filter(F.col("_file").isNotNull())
              .sortWithinPartitions("_file", *_ORDER).select("_file", "value"))
    staging = f"{folder}/_staging"
    (staged.write.mode("overwrite").option("lineSep", "\n").partitionBy("_file")
     .text(staging))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(names):
        part_dir = path(f"{staging}/_file={i}")
        if not fs.exists(part_dir):
            continue
        parts = sorted(st.getPath().getName() for st in fs.listStatus(part_dir)
                       if st.getPath().getName().startswith("part-"))
        for j, part in enumerate(parts):
            fs.rename(path(part_dir, part), path(folder, f"{name}.{j:05d}"))
    fs.delete(path(staging), True)
