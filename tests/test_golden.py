"""Golden results on the tiny rating file F1 (FIXTURES.md, cases A-F)."""

import pytest

from basketmine import mine, recommend
from basketmine.operators.rules import filter_rules

THIRD = 0.6666666666666666


def stats(res):
    return [tuple(r) for r in res.stats().orderBy("k").collect()]


def itemsets(res):
    return {tuple(r["items"]): r["freq"] for r in res.itemsets().collect()}


def rules(res):
    return {(tuple(r["antecedent"]), r["consequent"]): r["confidence"]
            for r in res.rules().collect()}


def test_case_a_full_run(f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=200, user_bound="reference")
    assert res.n_users == 6
    # level 1 counts every distinct item as a candidate (5 items)
    assert stats(res) == [(1, 5, 4, 5, 0), (2, 6, 6, 4, 12), (3, 4, 4, 2, 12), (4, 1, 1, 2, 4)]
    sets = itemsets(res)
    assert sets[(1,)] == 4 and sets[(2,)] == sets[(3,)] == sets[(10,)] == 3
    assert sets[(1, 2)] == sets[(1, 10)] == 3 and sets[(1, 2, 3, 10)] == 2
    assert (7,) not in sets


def test_case_a_rules(f1_ratings):
    r = rules(mine(f1_ratings, 0.3, max_user=200))
    expect = {
        ((1,), 2): 0.75, ((1,), 10): 0.75, ((1,), 3): 0.5,
        ((2,), 1): 1.0, ((10,), 1): 1.0, ((3,), 1): THIRD,
        ((2,), 3): THIRD, ((2,), 10): THIRD, ((3,), 2): THIRD, ((3,), 10): THIRD,
        ((10,), 2): THIRD, ((10,), 3): THIRD,
        ((1, 2), 3): THIRD, ((1, 2), 10): THIRD, ((1, 10), 2): THIRD, ((1, 10), 3): THIRD,
        ((1, 3), 2): 1.0, ((1, 3), 10): 1.0, ((2, 3), 1): 1.0, ((2, 3), 10): 1.0,
        ((2, 10), 1): 1.0, ((2, 10), 3): 1.0, ((3, 10), 1): 1.0, ((3, 10), 2): 1.0,
        ((1, 2, 3), 10): 1.0, ((1, 2, 10), 3): 1.0, ((1, 3, 10), 2): 1.0, ((2, 3, 10), 1): 1.0,
    }
    assert r == expect


def test_case_b_user_counts_in_n_only(f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=106, user_bound="reference")
    assert res.n_users == 6
    assert stats(res) == [(1, 5, 4, 5, 0), (2, 6, 6, 4, 12), (3, 4, 4, 2, 12), (4, 1, 1, 2, 4)]


def test_case_c_float_traps(f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=105, user_bound="reference")
    assert res.n_users == 5
    assert [s[1:] for s in stats(res)][1:] == [(6, 6, 4, 12), (4, 4, 2, 12), (1, 1, 2, 4)]
    assert stats(res)[0][2:] == (4, 4, 0)
    r = rules(res)
    assert r[((1,), 2)] == 0.7499999999999999 and r[((1,), 10)] == 0.7499999999999999
    for key in [((1, 2), 3), ((1, 2), 10), ((1, 10), 2), ((1, 10), 3),
                ((2,), 3), ((2,), 10), ((10,), 2), ((10,), 3)]:
        assert r[key] == 0.6666666666666667, key
    for key in [((3,), 1), ((3,), 2), ((3,), 10)]:
        assert r[key] == 1.0


def test_case_d_tie_is_excluded(f1_ratings):
    res = mine(f1_ratings, 0.5, max_user=200)
    assert [s[2:] for s in stats(res)] == [(1, 4, 0), (0, 0, 0)]
    assert stats(res)[1][1] == 0


def test_case_e_level_limit(f1_ratings):
    for limit in (2, 1):
        res = mine(f1_ratings, 0.3, max_len=limit, max_user=200)
        assert [s[0] for s in stats(res)] == [1, 2]
        assert stats(res)[1] == (2, 6, 6, 4, 12)


def test_case_f_low_threshold(f1_ratings):
    res = mine(f1_ratings, 0.15, max_user=200)
    assert stats(res) == [(1, 5, 5, 6, 0), (2, 10, 6, 4, 12), (3, 4, 4, 2, 12), (4, 1, 1, 2, 4)]


def test_case_f_prime_bounds(f1_ratings):
    ref = mine(f1_ratings, 0.15, max_user=106, user_bound="reference")
    inc = mine(f1_ratings, 0.15, max_user=106)
    assert stats(ref) == [(1, 5, 4, 5, 0), (2, 6, 6, 4, 12), (3, 4, 4, 2, 12), (4, 1, 1, 2, 4)]
    assert stats(inc) == [(1, 5, 5, 6, 0), (2, 10, 6, 4, 12), (3, 4, 4, 2, 12), (4, 1, 1, 2, 4)]


def recs(df):
    return {(r["user_id"], r["item_id"]): (r["score"], r["rank"]) for r in df.collect()}


def test_case_a_recommendations(f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=200)
    got = recs(recommend(res))
    assert got == {
        (103, 10): (0.75, 1), (103, 3): (THIRD, 2),
        (104, 2): (0.75, 1), (104, 3): (THIRD, 2),
        (105, 1): (THIRD, 1), (105, 2): (THIRD, 2), (105, 10): (THIRD, 3),
    }
    filtered = recs(recommend(res, min_confidence=0.7))
    assert filtered == {(103, 10): (0.75, 1), (104, 2): (0.75, 1)}
    top1 = recs(recommend(res, top_n=1))
    assert set(top1) == {(103, 10), (104, 2), (105, 1)}


def test_min_confidence_filter(f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=200)
    kept = filter_rules(res.rules(), 0.75).collect()
    assert all(r["confidence"] >= 0.75 for r in kept) and len(kept) == 2 + 2 + 8 + 4


def test_missing_threshold_is_an_error(f1_ratings):
    with pytest.raises(ValueError):
        mine(f1_ratings, None)


def test_cleanup_removes_run_files(spark, f1_ratings):
    res = mine(f1_ratings, 0.3, max_user=200)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(res.scratch)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    res.cleanup()
    assert not fs.exists(path)
