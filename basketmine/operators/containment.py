"""Which users hold which sets: containment on plain tables.

Sets are found by an inverted index on their three rarest members.  The members
that follow one in the index are one array, so a basket is led from member to
member by an equi-join and an intersection of that array with the basket; sets
with more members are then verified against the basket.  There is no scan of all
baskets against all sets, and the number of joins does not depend on the size of
the sets.  What a basket holds does not depend on its user, so equal baskets are
matched once (`BasketKinds`), dealt into tasks whose number follows from their items.

`held_sets` returns all holders; `holders` stops at a user's first verified set
of each index entry, by a semi-join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import contains_all, support
from ..plans.runtime import key_bytes, materialize, materialize_measured, maybe_broadcast, new_scratch
from . import prepare as prep

USER, ITEM = prep.USER, prep.ITEM
BASKET_ITEMS = 200_000   # items of the baskets that one task matches
INDEX = ["r1", "r2", "r3"]


@dataclass
class BasketKinds:
    """Baskets of users, and the distinct ones among them; those of a null user stand apart (`anon`)."""
    users: DataFrame        # user_id, basket, anon
    kinds: DataFrame        # kind, basket, anon, n_users
    n_items: int            # items of all kinds

    def dealt(self) -> DataFrame:
        """The kinds, partitioned by `kind` into tasks of about BASKET_ITEMS items."""
        return self.kinds.repartition(max(1, math.ceil(self.n_items / BASKET_ITEMS)), "kind")

    def of_users(self, found: DataFrame, scratch: str, how: str = "inner") -> DataFrame:
        """Rows found for kinds (basket, anon, ...) as rows of their users (user_id, ...)."""
        found = materialize(found, scratch)
        size = found.agg(F.coalesce(F.sum(key_bytes(found, found.columns)), F.lit(0))).first()[0]
        return self.users.join(maybe_broadcast(found, int(size)), ["basket", "anon"], how).drop("basket", "anon")


def whole_baskets(baskets: DataFrame) -> DataFrame:
    """(user_id, items) with one row per user and every item once, sorted, null items left out."""
    return (baskets.filter("items IS NOT NULL").groupBy(USER)
            .agg(F.sort_array(F.array_compact(F.array_distinct(F.flatten(F.collect_list("items"))))).alias("items")))


def basket_kinds(baskets: DataFrame, scratch: str) -> BasketKinds:
    """The baskets' users and kinds, both written once; `baskets` is evaluated once."""
    whole = whole_baskets(baskets).select(USER, F.col("items").alias("basket"), F.col(USER).isNull().alias("anon"))
    users = materialize(whole, f"{scratch}/users")
    kinds = users.groupBy("basket", "anon").agg(F.count(F.lit(1)).alias("n_users"))
    kinds, seen = materialize_measured(
        kinds.select(F.monotonically_increasing_id().alias("kind"), "basket", "anon", "n_users"), f"{scratch}/kinds",
        [F.expr("coalesce(sum(size(basket)), 0L) as items")])
    return BasketKinds(users, kinds, int(seen["items"]))


def set_index(kinds: DataFrame, sets: DataFrame, scratch: str) -> tuple[DataFrame, int]:
    """(id, items, r1, r2, r3, more) of each distinct set, and a bound of its bytes.

    r1, r2, r3 are the set's rarest members, the last one repeated in smaller
    sets; `more` tells that it has others.  Empty sets, sets with a null and sets
    with an item that no basket holds are left out: nobody holds them.
    """
    wanted = sets.select("items").distinct().filter((F.size("items") > 0) & ~F.exists("items", lambda x: x.isNull()))
    members = wanted.select("items", F.explode(F.array_distinct("items")).alias(ITEM))
    counts = (kinds.select(F.explode("basket").alias(ITEM), "n_users").groupBy(ITEM)
              .agg(F.sum("n_users").alias("_n")))
    ranked = members.join(counts, ITEM, "left")
    # A set's members form one group; its size is that of the set.
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col(ITEM).alias("x"))))
    index = (ranked.groupBy("items").agg(rare.alias("rare")).filter("rare[0].n > 0")
             .selectExpr("monotonically_increasing_id() as id", "items", "rare[0].x as r1",
                         "rare[least(size(rare), 2) - 1].x as r2", "rare[least(size(rare), 3) - 1].x as r3",
                         "size(rare) > 3 as more"))
    index = materialize(index, f"{scratch}/index")
    n_bytes = index.agg(F.coalesce(F.sum(key_bytes(index, ["items", *INDEX])), F.lit(0))).first()[0]
    return index, int(n_bytes)


def _met(kinds: DataFrame, index: DataFrame, n_bytes: int) -> DataFrame:
    """(kind, basket, anon, n_users, r1, r2, r3): the index entries whose members a basket holds."""
    met = kinds.select("*", F.explode("basket").alias("r1"))
    for i in (1, 2):
        after = index.groupBy(*INDEX[:i]).agg(F.collect_set(INDEX[i]).alias("_next"))
        met = (met.join(maybe_broadcast(after, n_bytes), INDEX[:i])
               .select(*kinds.columns, *INDEX[:i],
                       F.explode(F.array_intersect("_next", "basket")).alias(INDEX[i])))
    return met


def held_by_kinds(baskets: BasketKinds, sets: DataFrame, scratch: str) -> tuple[DataFrame, DataFrame]:
    """(kind, basket, anon, n_users, id, items) for every set of `sets` that a kind of basket
    holds, and the sets (id, items).

    While the sets are few enough to be broadcast, the rows are partitioned by kind.
    """
    index, n_bytes = set_index(baskets.kinds, sets, scratch)
    met = _met(baskets.dealt(), index, n_bytes).join(maybe_broadcast(index, n_bytes), INDEX)
    held = met.filter(~F.col("more") | contains_all("basket", "items"))
    return held.select(*baskets.kinds.columns, "id", "items"), index.select("id", "items")


def held_sets(baskets: DataFrame, sets: DataFrame, scratch: str | None = None) -> DataFrame:
    """(user_id, items) for every set of `sets` (column `items`) that a user holds.

    `baskets` is (user_id, items); several rows of a user are one basket.  Sets
    count once each, whatever their order; the empty set and sets with a null are
    held by nobody.
    """
    scratch = scratch or new_scratch(baskets.sparkSession, "held")
    whole = basket_kinds(baskets, scratch)
    held, _ = held_by_kinds(whole, sets, scratch)
    return whole.of_users(held.select("basket", "anon", "items"), f"{scratch}/held")


def holders(baskets: DataFrame, sets: DataFrame, scratch: str | None = None) -> DataFrame:
    """(user_id): the users that hold at least one set.

    A semi-join takes each index entry a basket meets at the first of its sets
    that the basket holds; no table of held sets is made.
    """
    scratch = scratch or new_scratch(baskets.sparkSession, "holders")
    whole = basket_kinds(baskets, scratch)
    index, n_bytes = set_index(whole.kinds, sets, scratch)
    met, sets_of = _met(whole.dealt(), index, n_bytes).alias("m"), maybe_broadcast(index, n_bytes).alias("s")
    same = ~F.col("s.more") | contains_all("m.basket", "s.items")
    for r in INDEX:
        same = (F.col(f"m.{r}") == F.col(f"s.{r}")) & same
    kinds = met.join(sets_of, same, "left_semi").select("kind", "basket", "anon").distinct()
    return whole.of_users(kinds.drop("kind"), f"{scratch}/held", "left_semi")


def count_support(candidates: DataFrame, baskets: DataFrame, n_users: int) -> DataFrame:
    """(k, items, freq, support) of arbitrary candidates over plain baskets (M4, A5).

    Holders are counted by the number of the set in the index.  Candidates that
    no basket holds are absent, as in the reference, whose reducer only sees
    candidates that were emitted.
    """
    scratch = new_scratch(baskets.sparkSession, "support")
    held, sets = held_by_kinds(basket_kinds(baskets, scratch), candidates, scratch)
    counts = held.groupBy("id").agg(F.sum("n_users").alias("freq"))
    return (counts.join(sets, "id")
            .select(F.size("items").alias("k"), "items", "freq",
                    support("freq", n_users).alias("support")))


def retain_baskets(baskets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Baskets that hold at least one candidate, items unchanged."""
    return baskets.join(holders(baskets, candidates), USER, "left_semi")


def holders_of(baskets: DataFrame, items: list) -> DataFrame:
    """Baskets that hold all of one given set (F6); a plain filter."""
    item_type = baskets.schema["items"].dataType.simpleString()
    wanted = F.array(*[F.lit(i) for i in items]).cast(item_type)
    return baskets.filter(contains_all("items", wanted))
