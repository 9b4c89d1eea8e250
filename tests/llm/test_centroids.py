import hashlib
import random

from basketmine.llm import centroids

COLS = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, clusters, rounds, dim):
    """Lloyd rounds in plain integers."""
    import math
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
            and all(abs(x) * 64 < centroids.MAX_COMPONENT for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in named[:clusters]]
    if not cs:
        return []

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for k in range(len(cs)):
            mine = [v for (_, v), (c, _) in zip(kept, got) if c == k]
            if mine:
                cs[k] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    inertia = sum(d for _, d in got)
    return [(i, k, d, sum(e for c, e in got if c == k), inertia,
             hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest())
            for (i, _), (k, d) in zip(kept, got)]


def run(spark, rows, clusters=4, rounds=3, dim=3, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], COLS).repartition(parts)
    found = centroids.cluster(df, clusters=clusters, rounds=rounds, dim=dim)
    return [] if found is None else [tuple(r) for r in centroids.labels(found).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def test_equals_brute_force_in_any_partitioning(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(3)]) for i in range(300)]
    want = sorted(brute(rows, 4, 3, 3), key=key)
    for parts in (1, 7):
        assert sorted(run(spark, rows, parts=parts), key=key) == want


def test_bad_vectors_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [-0.001, 0.0, 0.0]), (3, [-0.001, 0.0, 0.0]),
            (4, None), (5, []), (6, [1.0, 2.0]), (7, [1.0, None, 0.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 0.0, 0.0]),
            (10, [1e300, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (11, [0.5, 0.0, 0.0]), (12, [1e6, -1e6, 3.0])]
    for clusters in (1, 3, 50):
        assert sorted(run(spark, rows, clusters), key=key) == sorted(brute(rows, clusters, 3, 3), key=key)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, [1.0, 1.0, 1.0]), (1, None)]) == []


def test_products_are_kept_exactly(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(3)], "x", 1) for i in range(60)]
    found = centroids.cluster(spark.createDataFrame(rows, COLS), clusters=4, dim=3)
    for r in found.state.collect():
        assert list(r["dots"]) == [sum(a * b for a, b in zip(r["v"], c)) for c in found.centroids]
