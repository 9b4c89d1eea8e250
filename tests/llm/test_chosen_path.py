import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketmine.llm import chosen_path as cp
from basketmine.llm import components
from basketmine.llm.common import WordHash
from basketmine.llm.shingles import shingle_set

COLS = "doc_id long, text string, node string, bucket int"


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """(doc_id, class id, links) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, float("inf")), float("inf") if d is None else d)
    return sorted(((d, None if least[find(i)] == float("inf") else least[find(i)], links[i])
                   for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], COLS)
    out = cp.join(docs, **kw).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == brute(rows)
    return out


def corpus(seed=0, groups=12):
    rng, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 90, 200]))]
        if g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 3 % 101, " ".join(w)))
    return rows


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_large_buckets_are_split_and_compared_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows + [(100 + d, t) for d, t in corpus(5, 4)], small=4, block=7)


def buckets_of(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "_cp_id long, _cp_text string").selectExpr(
        "_cp_id", "xxhash64(_cp_text) AS _cp_hash", "_cp_text")
    nodes = cp._sketch(docs, 0.8, cp.runs_for(0.9999)).filter("node IS NOT NULL").cache()
    found = cp._buckets(nodes, cp.SMALL, cp.LEVELS, 0.8)
    return nodes, found.groupBy("node").agg(F.collect_list(F.struct(F.col("bucket").alias("b"), "c")).alias("buckets"))


def test_a_shared_passage_is_split_away(spark):
    rng = random.Random(8)
    passage, m = [f"p{i}" for i in range(60)], 1_000
    texts = [" ".join(passage + [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]) for _ in range(m)]
    _, found = buckets_of(spark, texts)
    cost = found.select(F.explode("buckets").alias("x")).agg(F.sum("x.c")).first()[0] or 0
    assert cost < 0.5 * m * m          # cells of the compared matrices, of m * m


def test_sets_of_near_copies_are_shipped_few_times(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([f"x{i}" if k == at else w for k, w in enumerate(base)])
             for i in range(300) for at in [rng.randrange(300)]]
    nodes, found = buckets_of(spark, texts)
    places = cp._places(nodes.select("node", "n").join(found, "node"), 1_000, 0.8)
    every = found.agg(F.sum(F.size("buckets"))).first()[0]
    assert 300 <= places.count() < every / 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 3)), st.booleans()), min_size=2,
                max_size=9), st.booleans())
def test_matrix_of_linked_pairs(rows, split):
    sets, before, sides = ([np.array(sorted(r[0]), np.uint64) for r in rows],
                           [np.array(sorted(r[1]), np.int64) for r in rows], np.array([r[2] for r in rows]))
    got = cp.compare(sets, sides if split else None, before, 0.5)
    for i, (s, b, side) in enumerate(rows):
        for j, (t, d, other) in enumerate(rows):
            want = (i != j and bool(s & t) and len(s & t) >= 0.5 * len(s | t) and not b & d
                    and (not split or side != other))
            assert got[i, j] == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "one  two\n"), (7, "One two"),
            (8, "a b c d e"), (9, "a b c d e f"), (None, "n o p q r s"), (11, "n o p q r s"), (None, "alone here"),
            (12, "repeated row of text here"), (12, "repeated row of text here"), (13, "long " * 30_000),
            (14, "long " * 30_001)]
    out = check(spark, rows)
    # One row of each group is first (rows equal in id and text share the mark).
    firsts = Counter(r.class_id for r in out if r.first and r.doc_id is not None)
    assert firsts == Counter({1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 8: 1, 9: 1, 11: 1, 12: 2, 13: 1})


def test_empty_table(spark):
    assert cp.join(spark.createDataFrame([], COLS)).collect() == []


def test_runs_reach_the_recall():
    assert cp.runs_for(0.99) < cp.runs_for(0.9999) < 20
    assert cp.runs_for(0.9999, 1) < cp.runs_for(0.9999, 3)
    with pytest.raises(ValueError):
        cp.runs_for(1.0)


def test_shingles_match_their_definition():
    cache = WordHash()
    for text in ("", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "é ü x b  c d\ne"):
        assert len(shingle_set(text.encode(), cache)) == len(shingles(text))
    assert set(shingle_set(b"a b c d e f", cache)) & set(shingle_set(b"x b c d e f", cache)) == \
        set(shingle_set(b"b c d e f", cache))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=14))
def test_components_equal_union_find(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.label for r in components.connected(df).collect()} == {x: find(x) for x in root}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
