"""One run from rating files to all outputs: the whole chain in one call."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from ..operators.candidates import generate_candidates
from ..operators.recommend import recommend
from ..sinks.text import write_outputs
from ..sources.blocks import read_rating_blocks, read_raw_ratings
from .miner import MiningResult, mine
from .runtime import scratch_scope


def all_candidates(result: MiningResult) -> DataFrame:
    """(k, items) of every level's union candidates."""
    n1, out = result.level(1).n_frequent, None
    for lv in result.levels[1:]:
        prev = result.level(lv.k - 1)
        part = generate_candidates(prev.table, lv.k, "union", n_rows=prev.n_frequent, max_group=n1,
                                   skew=result.skew).select("k", "items")
        out = part if out is None else out.unionByName(part)
    return out


def run(spark: SparkSession, input_path: str, output_path: str, *, min_support: float,
        max_len: int | None = None, max_item: int | None = None, max_user: int | None = None,
        user_bound: str = "inclusive", l1_count: str = "distinct", normalised: bool = False,
        mode: str = "skip", name_regex: str | None = None, path_glob: str | None = None,
        min_confidence: float | None = None, top_n: int | None = None,
        cleanup: bool = True) -> MiningResult:
    """Rating files -> itemsets, baskets, candidates, rules, statistics, recommendations.

    Reads `input_path` (raw files, or blocks with `normalised`), mines, and writes
    every output below `output_path` (see `write_outputs`).  With `cleanup` all
    scratch files and cached tables of the run are freed after that; the returned
    result then still knows its sizes, but its tables are to be read from
    `output_path`.
    """
    read = read_rating_blocks if normalised else read_raw_ratings
    with scratch_scope(spark, "files-to-outputs") if cleanup else contextlib.nullcontext():
        ratings = read(spark, input_path, mode, name_regex, path_glob)
        result = mine(ratings, min_support, max_len, max_item=max_item, max_user=max_user,
                      user_bound=user_bound, l1_count=l1_count)
        write_outputs(result, output_path, candidates=all_candidates(result),
                      recommendations=recommend(result, min_confidence=min_confidence, top_n=top_n))
        if cleanup:
            result.cleanup()
    return result
