"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

MAX_CACHED_WORDS = 200_000   # per task; beyond it words are hashed each time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: Column, max_rows: int) -> DataFrame:
    """At most `max_rows` rows of `df`, the same ones however it is partitioned.

    Rows are taken in order of a hash of `key`.  A filter on the hash first
    leaves about 1.5 * max_rows of them, so that tasks hand on few rows whatever
    their number.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = 1.5 * max_rows / max(1, df.count())
    few = df if share >= 1 else df.filter(place < int(share * (1 << 40)))
    return few.orderBy(place, key).limit(max_rows)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text; `bytes.split` splits on exactly the ASCII white space of SPACE."""
    return data.split()


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_CACHED_WORDS:
            self[word] = h
        return h
