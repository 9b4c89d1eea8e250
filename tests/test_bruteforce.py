"""Randomized check against a brute force written in plain Python.

Small random (user, item) relations (with repeated rows and a skewed item
popularity) are mined by the Spark operators and by enumerating every
subset of every basket; frequent sets, supports, rules and statistics must
agree exactly.
"""

from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketmine import mine


def brute(rows, t):
    baskets = {}
    for u, i in rows:
        baskets.setdefault(u, set()).add(i)
    n = len(baskets)
    counts = {}
    for items in baskets.values():
        s = sorted(items)
        for k in range(1, len(s) + 1):
            for c in combinations(s, k):
                counts[c] = counts.get(c, 0) + 1
    frequent = {c: f for c, f in counts.items() if f / n > t}
    rules = {}
    for c, f in frequent.items():
        if len(c) < 2:
            continue
        for x in c:
            a = tuple(y for y in c if y != x)
            rules[(a, x)] = (f / n) / (frequent[a] / n)
    return n, frequent, rules


rows_strategy = st.lists(
    st.tuples(st.integers(1, 12), st.sampled_from([1, 1, 1, 2, 2, 3, 4, 5, 6, 7])),
    min_size=1, max_size=60)


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=rows_strategy, t=st.sampled_from([0.1, 0.2, 0.25, 0.4]))
def test_matches_brute_force(spark, rows, t):
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    res = mine(df, t)
    n, frequent, rules = brute(rows, t)
    assert res.n_users == n
    got = {tuple(r["items"]): r["freq"] for r in res.itemsets().collect()}
    assert got == frequent
    if len(res.levels) > 1:
        got_rules = {(tuple(r["antecedent"]), r["consequent"]): r["confidence"]
                     for r in res.rules().collect()}
        assert got_rules == rules
    res.cleanup()
