"""

Every query reads the given parquet tables (or text that Spark writes from
them into the shared checkpoint folder) and runs over whole tables.  Sets
are rendered as comma separated text (sorted members) so both engines
hash them alike; every computed column has the same alias in the Spark
query and in its oracle.

Fixtures (user -> item, threshold), as documented in FIXTURES.md:
F2 order -> part type, 0.05;  F3 order -> brand, 0.003;  F4 order -> brand,
0.02;  F5 customer -> supplier, 0.12;  F6 customer -> part, 0.003;  F7 event
user -> day of year, 0.8.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

# The package lives next to this file; make it importable whatever the
# caller's working directory or import mechanism.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F

from basketmine.functions.itemsets import items_text, items_text_as_strings, rule_text
from basketmine.operators import prepare as prep
from basketmine.operators.candidates import generate_candidates, prune_candidates
from basketmine.operators.containment import count_support, holders_of, retain_baskets
from basketmine.operators.fpgrowth import fpgrowth_itemsets
from basketmine.operators.recommend import recommend
from basketmine.operators.rules import association_rules, filter_rules
from basketmine.operators.support import candidate_support, retained_baskets
from basketmine.plans.miner import mine
from basketmine.plans.run import all_candidates, run
from basketmine.plans.runtime import new_scratch
from basketmine.sinks import text as sinks
from basketmine.sources import blocks, tables
from basketmine.sources import text as readers

# Thresholds of the fixtures (FIXTURES.md).
T_F2, T_F3, T_F4, T_F5, T_F6, T_F7 = 0.05, 0.003, 0.02, 0.12, 0.003, 0.8
RULE_MIN_CONF = 0.5          # F2 rules kept by rules_min_confidence
REC_MIN_CONF = 0.4           # F5 rules kept by recommendations_min_confidence
TOP_N = 3
MAX_LEN = 3
BOUND_ITEM, BOUND_USER = 500, 700
REF_MAX_USER = 7000          # an order with line items at sf0.01 and sf0.1


# ----------------------------------------------------------------- helpers

def _sets(df: DataFrame, *cols: str) -> DataFrame:
    """Render array columns as comma separated text."""
    for c in cols:
        df = df.withColumn(c, items_text(c))
    return df


def _itemsets_out(df: DataFrame) -> DataFrame:
    return _sets(df.select("k", "items", "freq", "support"), "items")


def _rules_out(rules: DataFrame) -> DataFrame:
    return _sets(rules.select("k", "antecedent", "consequent", "confidence", "support"),
                 "antecedent")


def _f2(spark, d):
    return tables.order_types(spark, d)


def _mine_f2(spark, d, **kw):
    return mine(_f2(spark, d), T_F2, **kw)


# ----------------------------------------------------------------- queries

def q_distinct_user_count(spark, d):
    return prep.distinct_user_count(prep.as_ratings(_f2(spark, d)))


def q_item_support(spark, d):
    r = prep.as_ratings(_f2(spark, d))
    return prep.item_support(r, prep.count_users(r)).select(prep.ITEM, "freq", "support")


def q_item_support_rows(spark, d):
    r = prep.as_ratings(_f2(spark, d))
    return prep.item_support(r, prep.count_users(r), count="rows").select(
        prep.ITEM, "freq", "support")


def q_frequent_items(spark, d):
    r = prep.as_ratings(_f2(spark, d))
    n = prep.count_users(r)
    return prep.frequent_items(prep.item_support(r, n), n, T_F2).select(
        prep.ITEM, "freq", "support")


def _f2_baskets(spark, d):
    r = prep.as_ratings(_f2(spark, d))
    n = prep.count_users(r)
    frequent = prep.frequent_items(prep.item_support(r, n), n, T_F2)
    return prep.baskets(prep.distinct_pairs(r), frequent)


def q_baskets(spark, d):
    return _sets(_f2_baskets(spark, d), "items")


def q_frequent_itemsets(spark, d):
    return _itemsets_out(_mine_f2(spark, d).itemsets())


def q_frequent_itemsets_max_len(spark, d):
    return _itemsets_out(_mine_f2(spark, d, max_len=MAX_LEN).itemsets())


def q_frequent_itemsets_reference_bounds(spark, d):
    res = mine(_f2(spark, d), T_F2, max_user=REF_MAX_USER, user_bound="reference")
    return _itemsets_out(res.itemsets())


def q_frequent_items_rows_mode(spark, d):
    return _itemsets_out(mine(_f2(spark, d), T_F2, max_len=2, l1_count="rows").level(1).itemsets())


def q_frequent_itemsets_brands(spark, d):
    return _itemsets_out(mine(tables.order_brands(spark, d), T_F3).itemsets())


def q_frequent_itemsets_parts(spark, d):
    return _itemsets_out(mine(tables.customer_parts(spark, d), T_F6).itemsets())


def q_frequent_itemsets_days(spark, d):
    return _itemsets_out(mine(tables.user_days(spark, d), T_F7).itemsets())


def q_fpgrowth_itemsets(spark, d):
    return _itemsets_out(fpgrowth_itemsets(_f2(spark, d), T_F2))


def q_iteration_stats(spark, d):
    return _mine_f2(spark, d).stats()


def q_association_rules(spark, d):
    return _rules_out(_mine_f2(spark, d).rules())


def q_rules_min_confidence(spark, d):
    return _rules_out(filter_rules(_mine_f2(spark, d).rules(), RULE_MIN_CONF))


def q_rule_text(spark, d):
    rules = _mine_f2(spark, d).rules()
    return rules.select("k", rule_text("antecedent", "consequent").alias("rule"), "confidence")


def _mine_f4(spark, d):
    return mine(tables.order_brands(spark, d), T_F4)


def q_candidates_k2(spark, d):
    res = _mine_f4(spark, d)
    lv = res.level(1)
    c = generate_candidates(lv.table, 2, n_rows=lv.n_frequent, max_group=lv.n_frequent)
    return _sets(c.select("k", "items"), "items")


def q_candidates_k3(spark, d):
    res = _mine_f4(spark, d)
    lv = res.level(2)
    c = generate_candidates(lv.table, 3, "union", n_rows=lv.n_frequent,
                            max_group=res.level(1).n_frequent)
    return _sets(c.select("k", "items"), "items")


def q_candidates_prefix_k3(spark, d):
    """Textbook apriori-gen join step: sets that share their first k-2 items."""
    res = _mine_f4(spark, d)
    lv = res.level(2)
    c = generate_candidates(lv.table, 3, "prefix", n_rows=lv.n_frequent,
                            max_group=res.level(1).n_frequent)
    return _sets(c.select("k", "items"), "items")


def q_candidates_text_order(spark, d):
    res = mine(tables.customer_suppliers(spark, d), T_F5, max_len=2)
    lv = res.level(1)
    c = generate_candidates(lv.table, 2, n_rows=lv.n_frequent, max_group=lv.n_frequent)
    return c.select("k", items_text_as_strings("items").alias("items"))


def q_candidate_support_k2(spark, d):
    return _itemsets_out(candidate_support(_mine_f4(spark, d), 2))


def q_candidate_support_k3(spark, d):
    return _itemsets_out(candidate_support(_mine_f4(spark, d), 3, method="union"))


def q_retained_baskets(spark, d):
    return _sets(retained_baskets(_mine_f4(spark, d), 3), "items")


def _mine_f5(spark, d):
    return mine(tables.customer_suppliers(spark, d), T_F5)


def q_recommendations(spark, d):
    return recommend(_mine_f5(spark, d)).select(prep.USER, prep.ITEM, "score", "rank")


def q_recommendations_top_n(spark, d):
    return recommend(_mine_f5(spark, d), top_n=TOP_N).select(prep.USER, prep.ITEM, "score", "rank")


def q_recommendations_min_confidence(spark, d):
    return recommend(_mine_f5(spark, d), min_confidence=REC_MIN_CONF).select(
        prep.USER, prep.ITEM, "score", "rank")


def q_recommendations_types(spark, d):
    """Recommendations on order -> part type: rules of every level up to 4."""
    return recommend(_mine_f2(spark, d), top_n=TOP_N).select(prep.USER, prep.ITEM, "score", "rank")


def q_bounded_ratings(spark, d):
    r = prep.as_ratings(tables.customer_parts(spark, d))
    return prep.bounded_ratings(r, max_item=BOUND_ITEM, max_user=BOUND_USER)


def q_bounded_ratings_reference(spark, d):
    r = prep.as_ratings(tables.customer_parts(spark, d))
    return prep.bounded_ratings(r, max_item=BOUND_ITEM, max_user=BOUND_USER, strict_user=True)


def _rating_rows(spark, d):
    return tables.part_order_ratings(spark, d).select("item_id", "user_id", "rating", "rated_on")


def q_parse_rating_blocks(spark, d):
    path = new_scratch(spark, "blocks")
    sinks.write_rating_blocks(_rating_rows(spark, d), path)
    return blocks.read_rating_blocks(spark, path)


def q_normalize_raw_blocks(spark, d):
    path = new_scratch(spark, "raw")
    sinks.write_rating_blocks(_rating_rows(spark, d), path, raw=True)
    return blocks.read_raw_ratings(spark, path)


# Rating files named by return flag: two names match the selection (the
# second only because the name pattern has no end anchor), two do not.
FILE_OF_FLAG = {"A": "combined_data_1.txt", "N": "combined_data_2.txt.bak",
                "R": "combined_data_x.txt"}
OTHER_FILE = "notes.txt"


def q_select_rating_files(spark, d):
    path = new_scratch(spark, "files")
    rows = tables.part_order_ratings(spark, d)
    name = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v))
                        for k, v in FILE_OF_FLAG.items()], F.lit(OTHER_FILE))
    ratings = rows.select("item_id", "user_id", "rating", "rated_on", name.alias("file_name"))
    text = sinks.block_lines(sinks.rating_lines(ratings, by=("file_name",)), normalised=False, by=("file_name",))
    sinks.write_named_text_files(text, path, [*FILE_OF_FLAG.values(), OTHER_FILE])
    return blocks.read_raw_ratings(spark, path, name_regex=blocks.RATING_FILE_REGEX,
                                   path_glob=blocks.RATING_FILE_GLOB).select("item_id", "user_id")


def q_skip_malformed_ratings(spark, d):
    """Rating blocks with injected faults: user ids of closed line items ('F')
    carry a letter, headers of parts larger than 45 carry a letter, user ids
    of 'A' line items are padded with blanks (trimmed, so kept)."""
    li = tables.table(spark, d, "lineitem")
    part = tables.table(spark, d, "part").select("p_partkey", "p_size")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    bad_item = F.col("p_size") > 45
    item = F.when(bad_item, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))) \
        .otherwise(F.col("l_partkey").cast("string"))
    user = (F.when(F.col("l_linestatus") == "F", F.concat(F.lit("u"), F.col("l_orderkey").cast("string")))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")))
            .otherwise(F.col("l_orderkey").cast("string")))
    ratings = rows.select(item.alias("item_id"), user.alias("user_id"),
                          F.col("l_linenumber").alias("rating"),
                          F.to_date("l_shipdate").alias("rated_on"))
    path = new_scratch(spark, "malformed")
    sinks.write_rating_blocks(ratings, path)
    return blocks.read_rating_blocks(spark, path, mode="skip").select("item_id", "user_id")


def q_itemset_text_roundtrip(spark, d):
    res = _mine_f2(spark, d)
    path = new_scratch(spark, "itemsets-text")
    sinks.write_itemsets_text(res.itemsets(), path)
    back = readers.read_itemsets_text(spark, path)
    return _sets(back.select("k", "items", "support"), "items")


def _outputs(spark, path):
    """Every output of a run read back from `path` as (output, k, key, value)."""
    read = sinks.read_outputs(spark, path).__getitem__

    def rows(df, output, k, key, value):
        return df.select(F.lit(output).alias("output"), F.col(k).cast("int").alias("k") if isinstance(k, str)
                         else k.cast("int").alias("k"), key.alias("key"), value.cast("double").alias("value"))

    stats = F.concat_ws(",", *[F.col(c).cast("string") for c in
                               ("n_candidates", "n_frequent", "n_users", "n_rules")])
    basket = F.concat_ws(" ", F.col("user_id").cast("string"), items_text("items"))
    rules = rule_text("antecedent", "consequent")
    parts = [
        rows(read("itemsets"), "itemsets", "k", items_text("items"), F.col("support")),
        rows(read("baskets"), "baskets", F.lit(0), basket, F.size("items")),
        rows(read("candidates"), "candidates", "k", items_text("items"), F.lit(0)),
        rows(read("rules"), "rules", "k", rules, F.col("confidence")),
        rows(read("stats"), "stats", "k", stats, F.lit(0)),
        rows(read("recommendations"), "recommendations", "rank",
             F.concat_ws(" ", F.col("user_id").cast("string"), F.col("item_id").cast("string")), F.col("score")),
        rows(readers.read_rules_text(spark, f"{path}/text/rules"), "rules_text", "k", rules, F.col("confidence")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def q_result_parquet_roundtrip(spark, d):
    """All outputs of one run written, every one of them read back."""
    res = _mine_f2(spark, d)
    path = new_scratch(spark, "result")
    sinks.write_outputs(res, path, candidates=all_candidates(res), recommendations=recommend(res))
    return _outputs(spark, path)


def q_mine_from_rating_files(spark, d):
    """The whole chain: raw rating files (supplier: customer) to all outputs."""
    files, out = new_scratch(spark, "ratings"), new_scratch(spark, "outputs")
    rows = tables.customer_suppliers(spark, d).select(
        "item_id", "user_id", F.lit(5).alias("rating"), F.lit(None).cast("date").alias("rated_on"))
    sinks.write_rating_blocks(rows, files, raw=True)
    run(spark, files, out, min_support=T_F5)
    return _outputs(spark, out)


def q_rules_text_roundtrip(spark, d):
    path = new_scratch(spark, "rules-text")
    sinks.write_rules_text(_mine_f2(spark, d).rules(), path)
    back = readers.read_rules_text(spark, path)
    return back.select("k", rule_text("antecedent", "consequent").alias("rule"), "confidence")


def q_rules_from_text(spark, d):
    """Rules derived from an itemset file alone."""
    path = new_scratch(spark, "itemsets-text")
    sinks.write_itemsets_text(_mine_f2(spark, d).itemsets(), path)
    return _rules_out(association_rules(readers.read_itemsets_text(spark, path)))


def _half_orders(spark, d):
    """(user_id, item_id): each order cut in two by line number; no such user was mined."""
    li = tables.table(spark, d, "lineitem")
    part = tables.table(spark, d, "part").select("p_partkey", "p_type")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select((F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).cast("long").alias("user_id"),
                    F.col("p_type").alias("item_id")))


def q_recommend_new_users(spark, d):
    """Rules of the F2 run applied to baskets that were not mined."""
    rules = _mine_f2(spark, d).rules()
    return recommend(prep.baskets(prep.distinct_pairs(_half_orders(spark, d))), rules, top_n=TOP_N)


def _f4_from_text(spark, d):
    """Baskets and union candidates of size 3 of F4, written as text and read back."""
    res = _mine_f4(spark, d)
    base = new_scratch(spark, "f4-text")
    sinks.write_baskets_text(res.baskets(), f"{base}/baskets")
    lv = res.level(2)
    sinks.write_candidates_text(generate_candidates(lv.table, 3, "union", n_rows=lv.n_frequent),
                                f"{base}/candidates")
    return (readers.read_baskets_text(spark, f"{base}/baskets"),
            readers.read_candidates_text(spark, f"{base}/candidates"), res.n_users)


def q_candidate_support_from_text(spark, d):
    held, candidates, n = _f4_from_text(spark, d)
    return _itemsets_out(count_support(candidates, held, n))


def q_retained_baskets_from_text(spark, d):
    held, candidates, _ = _f4_from_text(spark, d)
    return _sets(retain_baskets(held, candidates), "items")


HELD_TYPES = ["PROMO", "SMALL"]     # first words of part types


def q_baskets_holding_set(spark, d):
    """Orders whose baskets hold two given items."""
    first = _f2(spark, d).withColumn("item_id", F.split("item_id", " ")[0])
    held = prep.baskets(prep.distinct_pairs(prep.as_ratings(first)))
    return _sets(holders_of(held, HELD_TYPES), "items")


def q_candidates_pruned_k3(spark, d):
    """Prefix candidates without those that have an infrequent subset."""
    res = _mine_f4(spark, d)
    lv = res.level(2)
    c = generate_candidates(lv.table, 3, "prefix", n_rows=lv.n_frequent,
                            max_group=res.level(1).n_frequent)
    return _sets(prune_candidates(c, lv.table, 3), "items")


def q_frequent_itemsets_rows_mode(spark, d):
    return _itemsets_out(mine(_f2(spark, d), T_F2, l1_count="rows").itemsets())


def q_association_rules_rows_mode(spark, d):
    return _rules_out(mine(_f2(spark, d), T_F2, l1_count="rows").rules())


def _ragged_lines(spark, d):
    """(item_id, line): line items as rating lines of one to four fields, by line number."""
    li = tables.table(spark, d, "lineitem")
    user, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    line = (F.when(n % 4 == 0, user).when(n % 4 == 1, F.concat_ws(",", user, n.cast("string")))
            .when(n % 4 == 2, F.concat_ws(",", user, n.cast("string"), day))
            .otherwise(F.concat_ws(",", user, n.cast("string"), day, F.lit("extra"))))
    return li.select(F.col("l_partkey").alias("item_id"), line.alias("line"))


def q_ragged_rating_lines(spark, d):
    path = new_scratch(spark, "ragged")
    sinks.write_block_lines(_ragged_lines(spark, d), path)
    return blocks.read_rating_blocks(spark, path, mode="fail")


def q_crlf_rating_files(spark, d):
    path = new_scratch(spark, "crlf")
    sinks.write_block_lines(_ragged_lines(spark, d), path, raw=True, line_sep="\r\n")
    return blocks.read_raw_ratings(spark, path, mode="fail")


def q_split_bundled_blocks(spark, d):
    """Up to ten movies in one text value, split at their headers; a value holds some 10,000 lines at most."""
    rows = sinks.block_lines(_ragged_lines(spark, d), normalised=False, max_block_rows=1000)
    lines = F.sort_array(F.collect_list(F.struct("_item", "_kind", "value")))
    bundle = rows.groupBy(F.floor(F.col("_item").cast("long") / 10).alias("b"), "_chunk").agg(
        F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("value"))
    return blocks.parse_rating_blocks(bundle.select("value"))


def q_basket_text_roundtrip(spark, d):
    path = new_scratch(spark, "baskets-text")
    sinks.write_baskets_text(_f2_baskets(spark, d), path)
    return _sets(readers.read_baskets_text(spark, path), "items")


def q_candidate_text_roundtrip(spark, d):
    res = _mine_f2(spark, d)
    lv = res.level(2)
    cands = generate_candidates(lv.table, 3, "union", n_rows=lv.n_frequent,
                                max_group=res.level(1).n_frequent)
    path = new_scratch(spark, "candidates-text")
    sinks.write_candidates_text(cands, path)
    return _sets(readers.read_candidates_text(spark, path), "items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frequent_itemsets_rows_mode": q_frequent_itemsets_rows_mode,
    "association_rules_rows_mode": q_association_rules_rows_mode,
    "mine_from_rating_files": q_mine_from_rating_files,
    "rules_text_roundtrip": q_rules_text_roundtrip,
    "rules_from_text": q_rules_from_text,
    "recommend_new_users": q_recommend_new_users,
    "candidate_support_from_text": q_candidate_support_from_text,
    "retained_baskets_from_text": q_retained_baskets_from_text,
    "baskets_holding_set": q_baskets_holding_set,
    "candidates_pruned_k3": q_candidates_pruned_k3,
    "ragged_rating_lines": q_ragged_rating_lines,
    "crlf_rating_files": q_crlf_rating_files,
    "split_bundled_blocks": q_split_bundled_blocks,
    "distinct_user_count": q_distinct_user_count,
    "item_support": q_item_support,
    "item_support_rows": q_item_support_rows,
    "frequent_items": q_frequent_items,
    "baskets": q_baskets,
    "frequent_itemsets": q_frequent_itemsets,
    "frequent_itemsets_max_len": q_frequent_itemsets_max_len,
    "frequent_itemsets_reference_bounds": q_frequent_itemsets_reference_bounds,
    "frequent_items_rows_mode": q_frequent_items_rows_mode,
    "frequent_itemsets_brands": q_frequent_itemsets_brands,
    "frequent_itemsets_parts": q_frequent_itemsets_parts,
    "frequent_itemsets_days": q_frequent_itemsets_days,
    "fpgrowth_itemsets": q_fpgrowth_itemsets,
    "iteration_stats": q_iteration_stats,
    "association_rules": q_association_rules,
    "rules_min_confidence": q_rules_min_confidence,
    "rule_text": q_rule_text,
    "candidates_k2": q_candidates_k2,
    "candidates_k3": q_candidates_k3,
    "candidates_prefix_k3": q_candidates_prefix_k3,
    "candidates_text_order": q_candidates_text_order,
    "candidate_support_k2": q_candidate_support_k2,
    "candidate_support_k3": q_candidate_support_k3,
    "retained_baskets": q_retained_baskets,
    "recommendations": q_recommendations,
    "recommendations_top_n": q_recommendations_top_n,
    "recommendations_min_confidence": q_recommendations_min_confidence,
    "recommendations_types": q_recommendations_types,
    "bounded_ratings": q_bounded_ratings,
    "bounded_ratings_reference": q_bounded_ratings_reference,
    "parse_rating_blocks": q_parse_rating_blocks,
    "normalize_raw_blocks": q_normalize_raw_blocks,
    "select_rating_files": q_select_rating_files,
    "skip_malformed_ratings": q_skip_malformed_ratings,
    "itemset_text_roundtrip": q_itemset_text_roundtrip,
    "result_parquet_roundtrip": q_result_parquet_roundtrip,
    "basket_text_roundtrip": q_basket_text_roundtrip,
    "candidate_text_roundtrip": q_candidate_text_roundtrip,
}


# ------------------------------------------------------------------ oracles
# force (k-way self-joins of the distinct pairs), independent of the
# occurrence-table algorithm used on the Spark side.

SRC_F2 = ("SELECT l.l_orderkey AS user_id, p.p_type AS item_id "
          "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
SRC_F3 = ("SELECT l.l_orderkey AS user_id, p.p_brand AS item_id "
          "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
SRC_F5 = ("SELECT o.o_custkey AS user_id, l.l_suppkey AS item_id "
          "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
SRC_F6 = ("SELECT o.o_custkey AS user_id, l.l_partkey AS item_id "
          "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
SRC_F7 = "SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS item_id FROM events"


def _base_ctes(src: str, t: float, max_k: int, pairs_where: str = "",
               n_src: str | None = None, l1_from: str | None = None) -> list[str]:
    """pairs, n (N), L1..L{max_k} with columns x1..xk, freq; plus list forms."""
    ctes = [f"raw AS ({src})",
            f"pairs AS (SELECT DISTINCT user_id, item_id FROM raw {pairs_where})",
            f"nu AS (SELECT count(DISTINCT user_id) AS n FROM {n_src or 'pairs'})",
            f"L1 AS (SELECT item_id AS x1, count(*) AS freq FROM {l1_from or 'pairs'} "
            f"GROUP BY item_id HAVING count(*) / (SELECT n FROM nu) > CAST({t!r} AS DOUBLE))",
            "fp AS (SELECT p.user_id, p.item_id FROM pairs p JOIN L1 ON p.item_id = L1.x1)"]
    for k in range(2, max_k + 1):
        joins = "fp p1" + "".join(
            f" JOIN fp p{j} ON p{j}.user_id = p1.user_id AND p{j}.item_id > p{j - 1}.item_id"
            for j in range(2, k + 1))
        cols = ", ".join(f"p{j}.item_id AS x{j}" for j in range(1, k + 1))
        keys = ", ".join(f"p{j}.item_id" for j in range(1, k + 1))
        ctes.append(f"L{k} AS (SELECT {cols}, count(*) AS freq FROM {joins} GROUP BY {keys} "
                    f"HAVING count(*) / (SELECT n FROM nu) > CAST({t!r} AS DOUBLE))")
    for k in range(1, max_k + 1):
        xs = ", ".join(f"x{j}" for j in range(1, k + 1))
        ctes.append(f"S{k} AS (SELECT {k} AS k, [{xs}] AS items, freq FROM L{k})")
    union = " UNION ALL ".join(f"SELECT * FROM S{k}" for k in range(1, max_k + 1))
    ctes.append(f"S AS ({union})")
    return ctes


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _txt(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def _itemsets_sql(src: str, t: float, max_k: int, keep_k: int | None = None, **kw) -> str:
    where = f"WHERE k <= {keep_k}" if keep_k else ""
    return _with(_base_ctes(src, t, max_k, **kw),
                 f"SELECT k, {_txt('items')} AS items, freq, freq / (SELECT n FROM nu) AS support "
                 f"FROM S {where}")


def _rules_cte() -> str:
    return ("R AS (SELECT r.k, list_filter(r.items, lambda e: e <> r.consequent) AS antecedent, "
            "r.consequent, (r.freq / (SELECT n FROM nu)) / (a.freq / (SELECT n FROM nu)) "
            "AS confidence, r.freq / (SELECT n FROM nu) AS support "
            "FROM (SELECT k, items, freq, unnest(items) AS consequent FROM S WHERE k >= 2) r "
            "JOIN S a ON a.k = r.k - 1 "
            "AND a.items = list_filter(r.items, lambda e: e <> r.consequent))")


def _rules_sql(src: str, t: float, max_k: int, min_conf: float | None = None, **kw) -> str:
    where = f"WHERE confidence >= CAST({min_conf!r} AS DOUBLE)" if min_conf is not None else ""
    return _with(_base_ctes(src, t, max_k, **kw) + [_rules_cte()],
                 f"SELECT k, {_txt('antecedent')} AS antecedent, consequent, confidence, support "
                 f"FROM R {where}")


def _union_candidates_cte(k: int) -> str:
    u = "list_distinct(list_concat(a.items, b.items))"
    return (f"C{k} AS (SELECT DISTINCT list_sort({u}) AS items FROM S{k - 1} a JOIN S{k - 1} b "
            f"ON a.items < b.items WHERE len({u}) = {k})")


def _stats_sql(src: str, t: float, max_k: int) -> str:
    ctes = _base_ctes(src, t, max_k) + [_rules_cte()]
    ctes.append("B AS (SELECT user_id, list(item_id) AS items FROM fp GROUP BY user_id)")
    parts = ["SELECT 1 AS k, (SELECT count(DISTINCT item_id) FROM pairs) AS n_candidates, "
             "(SELECT count(*) FROM L1) AS n_frequent, (SELECT count(*) FROM B) AS n_users, "
             "CAST(0 AS BIGINT) AS n_rules"]
    for k in range(2, max_k + 1):
        ctes.append(_union_candidates_cte(k))
        guard = " AND ".join(f"(SELECT count(*) FROM L{j}) > 1" for j in range(2, k)) or "TRUE"
        parts.append(
            f"SELECT {k} AS k, (SELECT count(*) FROM C{k}) AS n_candidates, "
            f"(SELECT count(*) FROM L{k}) AS n_frequent, "
            f"(SELECT count(*) FROM B WHERE EXISTS (SELECT 1 FROM C{k} c "
            f"WHERE list_has_all(B.items, c.items))) AS n_users, "
            f"(SELECT count(*) FROM R WHERE R.k = {k}) AS n_rules WHERE {guard}")
    return _with(ctes, " UNION ALL ".join(parts))


def _recommend_sql(src: str, t: float, max_k: int, min_conf: float | None = None,
                   top_n: int | None = None) -> str:
    ctes = _base_ctes(src, t, max_k) + [_rules_cte()]
    held = ["SELECT user_id, [item_id] AS items FROM fp"]
    for j in range(2, max_k):
        joins = "fp p1" + "".join(
            f" JOIN fp p{i} ON p{i}.user_id = p1.user_id AND p{i}.item_id > p{i - 1}.item_id"
            for i in range(2, j + 1))
        xs = ", ".join(f"p{i}.item_id" for i in range(1, j + 1))
        held.append(f"SELECT p1.user_id, [{xs}] AS items FROM {joins} "
                    f"JOIN S{j} s ON s.items = [{xs}]")
    ctes.append("H AS (" + " UNION ALL ".join(held) + ")")
    conf = f"WHERE r.confidence >= CAST({min_conf!r} AS DOUBLE)" if min_conf is not None else ""
    ctes.append("A AS (SELECT h.user_id, r.consequent AS item_id, max(r.confidence) AS score "
                f"FROM H h JOIN R r ON r.antecedent = h.items {conf} GROUP BY h.user_id, r.consequent)")
    ctes.append("Q AS (SELECT a.user_id, a.item_id, a.score, CAST(row_number() OVER "
                "(PARTITION BY a.user_id ORDER BY a.score DESC, a.item_id ASC) AS INTEGER) AS rank "
                "FROM A a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.user_id = a.user_id "
                "AND p.item_id = a.item_id))")
    where = f"WHERE rank <= {top_n}" if top_n is not None else ""
    return _with(ctes, f"SELECT user_id, item_id, score, rank FROM Q {where}")


def _f4_c3_ctes() -> list[str]:
    return _base_ctes(SRC_F3, T_F4, 3) + [_union_candidates_cte(3)]


def _outputs_sql(src: str, t: float, max_k: int) -> str:
    """Every output of a run as (output, k, key, value)."""
    base = _base_ctes(src, t, max_k)
    cands = []
    for k in range(2, max_k + 1):
        guard = " AND ".join(f"(SELECT count(*) FROM L{j}) > 1" for j in range(2, k)) or "TRUE"
        cands.append(f"SELECT {k} AS k, items FROM C{k} WHERE {guard}")
    candidates = _with(base + [_union_candidates_cte(k) for k in range(2, max_k + 1)], " UNION ALL ".join(cands))
    rules = _with(base + [_rules_cte()],
                  "SELECT k, '[' || array_to_string(antecedent, ', ') || '] -> ' || consequent AS key, "
                  "confidence FROM R")
    baskets = _with(base, "SELECT user_id, string_agg(item_id, ',' ORDER BY item_id) AS items, "
                          "count(*) AS n FROM fp GROUP BY user_id")
    return f"""
SELECT 'itemsets' AS output, k, items AS key, support AS value FROM ({_itemsets_sql(src, t, max_k)})
UNION ALL SELECT 'baskets', 0, user_id || ' ' || items, CAST(n AS DOUBLE) FROM ({baskets})
UNION ALL SELECT 'candidates', k, {_txt('items')}, CAST(0 AS DOUBLE) FROM ({candidates})
UNION ALL SELECT 'rules', k, key, confidence FROM ({rules})
UNION ALL SELECT 'rules_text', k, key, confidence FROM ({rules})
UNION ALL SELECT 'stats', k, n_candidates || ',' || n_frequent || ',' || n_users || ',' || n_rules,
  CAST(0 AS DOUBLE) FROM ({_stats_sql(src, t, max_k)})
UNION ALL SELECT 'recommendations', rank, user_id || ' ' || item_id, score
  FROM ({_recommend_sql(src, t, max_k)})"""


def _new_users_sql() -> str:
    ctes = _base_ctes(SRC_F2, T_F2, 5) + [_rules_cte(),
        "N AS (SELECT DISTINCT l.l_orderkey * 2 + l.l_linenumber % 2 AS user_id, p.p_type AS item_id "
        "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)",
        "NB AS (SELECT user_id, list(item_id) AS items FROM N GROUP BY user_id)",
        "A AS (SELECT b.user_id, r.consequent AS item_id, max(r.confidence) AS score FROM NB b JOIN R r "
        "ON list_has_all(b.items, r.antecedent) AND NOT list_contains(b.items, r.consequent) "
        "GROUP BY b.user_id, r.consequent)",
        "Q AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) "
        "AS INTEGER) AS rank FROM A)"]
    return _with(ctes, f"SELECT CAST(user_id AS BIGINT) AS user_id, item_id, score, rank FROM Q WHERE rank <= {TOP_N}")


SQL_RAGGED = ("SELECT l_partkey AS item_id, l_orderkey AS user_id, "
              "CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_linenumber AS INTEGER) END AS rating, "
              "CASE WHEN l_linenumber % 4 > 1 THEN CAST(l_shipdate AS DATE) END AS rated_on FROM lineitem")

SQL_RATINGS = ("SELECT l_partkey AS item_id, l_orderkey AS user_id, l_linenumber AS rating, "
               "CAST(l_shipdate AS DATE) AS rated_on FROM lineitem")

ORACLES: dict[str, str] = {
    "distinct_user_count":
        f"SELECT count(DISTINCT user_id) AS n_users FROM ({SRC_F2})",
    "item_support": _with(_base_ctes(SRC_F2, T_F2, 1),
        "SELECT item_id, count(*) AS freq, count(*) / (SELECT n FROM nu) AS support "
        "FROM pairs GROUP BY item_id"),
    "item_support_rows": _with(_base_ctes(SRC_F2, T_F2, 1),
        "SELECT item_id, count(*) AS freq, count(*) / (SELECT n FROM nu) AS support "
        "FROM raw GROUP BY item_id"),
    "frequent_items": _with(_base_ctes(SRC_F2, T_F2, 1),
        "SELECT x1 AS item_id, freq, freq / (SELECT n FROM nu) AS support FROM L1"),
    "baskets": _with(_base_ctes(SRC_F2, T_F2, 1),
        "SELECT user_id, string_agg(item_id, ',' ORDER BY item_id) AS items "
        "FROM fp GROUP BY user_id"),
    "frequent_itemsets": _itemsets_sql(SRC_F2, T_F2, 5),
    "frequent_itemsets_max_len": _itemsets_sql(SRC_F2, T_F2, MAX_LEN),
    "frequent_itemsets_reference_bounds": _itemsets_sql(
        SRC_F2, T_F2, 5, pairs_where=f"WHERE user_id < {REF_MAX_USER}",
        n_src=f"(SELECT * FROM raw WHERE user_id <= {REF_MAX_USER})"),
    "frequent_items_rows_mode": _itemsets_sql(SRC_F2, T_F2, 1, l1_from="raw"),
    "frequent_itemsets_rows_mode": _itemsets_sql(SRC_F2, T_F2, 5, l1_from="raw"),
    "association_rules_rows_mode": _rules_sql(SRC_F2, T_F2, 5, l1_from="raw"),
    "frequent_itemsets_brands": _itemsets_sql(SRC_F3, T_F3, 4),
    "frequent_itemsets_parts": _itemsets_sql(SRC_F6, T_F6, 3),
    "frequent_itemsets_days": _itemsets_sql(SRC_F7, T_F7, 4),
    "fpgrowth_itemsets": _itemsets_sql(SRC_F2, T_F2, 5),
    "iteration_stats": _stats_sql(SRC_F2, T_F2, 5),
    "association_rules": _rules_sql(SRC_F2, T_F2, 5),
    "rules_min_confidence": _rules_sql(SRC_F2, T_F2, 5, RULE_MIN_CONF),
    "rule_text": _with(_base_ctes(SRC_F2, T_F2, 5) + [_rules_cte()],
        "SELECT k, '[' || array_to_string(antecedent, ', ') || '] -> ' || consequent AS rule, "
        "confidence FROM R"),
    "candidates_k2": _with(_base_ctes(SRC_F3, T_F4, 1),
        "SELECT 2 AS k, a.x1 || ',' || b.x1 AS items FROM L1 a JOIN L1 b ON a.x1 < b.x1"),
    "candidates_k3": _with(_f4_c3_ctes(), f"SELECT 3 AS k, {_txt('items')} AS items FROM C3"),
    "candidates_prefix_k3": _with(_base_ctes(SRC_F3, T_F4, 2),
        "SELECT 3 AS k, a.x1 || ',' || a.x2 || ',' || b.x2 AS items "
        "FROM L2 a JOIN L2 b ON a.x1 = b.x1 AND a.x2 < b.x2"),
    "candidates_text_order": _with(_base_ctes(SRC_F5, T_F5, 1),
        "SELECT 2 AS k, least(CAST(a.x1 AS VARCHAR), CAST(b.x1 AS VARCHAR)) || ',' || "
        "greatest(CAST(a.x1 AS VARCHAR), CAST(b.x1 AS VARCHAR)) AS items "
        "FROM L1 a JOIN L1 b ON a.x1 < b.x1"),
    "candidate_support_k2": _with(_base_ctes(SRC_F3, T_F4, 1),
        "SELECT 2 AS k, p1.item_id || ',' || p2.item_id AS items, count(*) AS freq, "
        "count(*) / (SELECT n FROM nu) AS support FROM fp p1 JOIN fp p2 "
        "ON p2.user_id = p1.user_id AND p2.item_id > p1.item_id GROUP BY p1.item_id, p2.item_id"),
    "candidate_support_k3": _with(_f4_c3_ctes(),
        f"SELECT 3 AS k, {_txt('c.items')} AS items, count(*) AS freq, "
        "count(*) / (SELECT n FROM nu) AS support FROM C3 c "
        "JOIN fp p1 ON p1.item_id = c.items[1] "
        "JOIN fp p2 ON p2.user_id = p1.user_id AND p2.item_id = c.items[2] "
        "JOIN fp p3 ON p3.user_id = p1.user_id AND p3.item_id = c.items[3] GROUP BY c.items"),
    "retained_baskets": _with(_f4_c3_ctes() + [
        "U AS (SELECT DISTINCT p1.user_id FROM C3 c JOIN fp p1 ON p1.item_id = c.items[1] "
        "JOIN fp p2 ON p2.user_id = p1.user_id AND p2.item_id = c.items[2] "
        "JOIN fp p3 ON p3.user_id = p1.user_id AND p3.item_id = c.items[3])"],
        "SELECT fp.user_id, string_agg(fp.item_id, ',' ORDER BY fp.item_id) AS items "
        "FROM fp JOIN U ON fp.user_id = U.user_id GROUP BY fp.user_id"),
    "recommendations": _recommend_sql(SRC_F5, T_F5, 3),
    "recommendations_top_n": _recommend_sql(SRC_F5, T_F5, 3, top_n=TOP_N),
    "recommendations_min_confidence": _recommend_sql(SRC_F5, T_F5, 3, min_conf=REC_MIN_CONF),
    "recommendations_types": _recommend_sql(SRC_F2, T_F2, 5, top_n=TOP_N),
    "bounded_ratings":
        f"SELECT user_id, item_id FROM ({SRC_F6}) "
        f"WHERE item_id <= {BOUND_ITEM} AND user_id <= {BOUND_USER}",
    "bounded_ratings_reference":
        f"SELECT user_id, item_id FROM ({SRC_F6}) "
        f"WHERE item_id <= {BOUND_ITEM} AND user_id < {BOUND_USER}",
    "parse_rating_blocks": SQL_RATINGS,
    "normalize_raw_blocks": SQL_RATINGS,
    "select_rating_files":
        "SELECT l_partkey AS item_id, l_orderkey AS user_id FROM lineitem "
        "WHERE l_returnflag IN ('A', 'N')",
    "skip_malformed_ratings":
        "SELECT l.l_partkey AS item_id, l.l_orderkey AS user_id FROM lineitem l "
        "JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size <= 45 AND l.l_linestatus <> 'F'",
    "itemset_text_roundtrip": _with(_base_ctes(SRC_F2, T_F2, 5),
        f"SELECT k, {_txt('items')} AS items, freq / (SELECT n FROM nu) AS support FROM S"),
    "result_parquet_roundtrip": _outputs_sql(SRC_F2, T_F2, 5),
    "mine_from_rating_files": _outputs_sql(SRC_F5, T_F5, 3),
    "rules_text_roundtrip": _with(_base_ctes(SRC_F2, T_F2, 5) + [_rules_cte()],
        "SELECT k, '[' || array_to_string(antecedent, ', ') || '] -> ' || consequent AS rule, "
        "confidence FROM R"),
    "rules_from_text": _rules_sql(SRC_F2, T_F2, 5),
    "recommend_new_users": _new_users_sql(),
    "candidates_pruned_k3": _with(_base_ctes(SRC_F3, T_F4, 2),
        "SELECT 3 AS k, a.x1 || ',' || a.x2 || ',' || b.x2 AS items FROM L2 a "
        "JOIN L2 b ON a.x1 = b.x1 AND a.x2 < b.x2 JOIN L2 c ON c.x1 = a.x2 AND c.x2 = b.x2"),
    "baskets_holding_set": "WITH f AS (SELECT DISTINCT user_id, split_part(item_id, ' ', 1) AS item_id "
        f"FROM ({SRC_F2})) SELECT user_id, string_agg(item_id, ',' ORDER BY item_id) AS items FROM f "
        f"GROUP BY user_id HAVING list_has_all(list(item_id), {HELD_TYPES!r})",
    "ragged_rating_lines": SQL_RAGGED,
    "crlf_rating_files": SQL_RAGGED,
    "split_bundled_blocks": SQL_RAGGED,
    "basket_text_roundtrip": _with(_base_ctes(SRC_F2, T_F2, 1),
        "SELECT user_id, string_agg(item_id, ',' ORDER BY item_id) AS items "
        "FROM fp GROUP BY user_id"),
    "candidate_text_roundtrip": _with(_base_ctes(SRC_F2, T_F2, 2) + [_union_candidates_cte(3)],
        f"SELECT 3 AS k, {_txt('items')} AS items FROM C3"),
}


ORACLES["candidate_support_from_text"] = ORACLES["candidate_support_k3"]
ORACLES["retained_baskets_from_text"] = ORACLES["retained_baskets"]

# ------------------------------------------- training-data queries (optional)

try:  # the subpackage and the pipeline may be absent; nothing else needs them
    import corpus_pipeline
    import basketmine.llm.queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "basketmine.llm", "basketmine.llm.queries"):
        raise
else:
    QUERIES.update(llm_queries.QUERIES)
    ORACLES.update(llm_queries.ORACLES)
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


# ------------------------------------------------------------------ contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: association rules of order -> part type at sf0.001."""
    return q_association_rules(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
