import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from basketmine.llm import queries, rp_forest

COLS = "vec_id long, embedding array<float>, id string, v int"


def brute(rows, query_ids, k=5):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows
          if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q in query_ids:
            s = sorted((-rp_forest.cosine(x[None], y[None])[0], i) for i, y in ok if i != q)
            out[q] = [(i, -c) for c, i in s[:k]]
    return out


def run(spark, rows, step=1, **kw):
    df = spark.createDataFrame([r + ("clash", 1) for r in rows], COLS)
    out = rp_forest.search(df, df.filter(f"vec_id % {step} = 0"), **kw).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_full_share_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(12)] + [(200 + i, [2 * x for x in rows[4][1]]) for i in range(3)]
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None] + [0.0] * 4), (304, [float("nan")] * 6),
           (305, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (306, [1.0, 2.0])]
    want = brute(rows, set(range(400)))
    got = run(spark, rows + odd + rows[:5], leaves=10 ** 9)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=0, atol=1e-15)


def test_chunks_and_slices_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(150)]
    plain = run(spark, rows, 3, leaves=10 ** 9, depth=2)
    monkeypatch.setattr(rp_forest, "CHUNK", 9)
    monkeypatch.setattr(rp_forest, "SLICE", 11)
    assert run(spark, rows, 3, leaves=10 ** 9, depth=2) == plain


def test_few_candidates_and_empty_table(spark):
    assert run(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]) == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    assert run(spark, [(1, [1.0, 0.0])]) == {}
    assert run(spark, []) == {}


def test_all_vectors_equal(spark):
    got = run(spark, [(i, [1.0, 2.0]) for i in range(300)], 50)
    assert got[0] == [(i, got[0][0][1]) for i in range(1, 6)] and got[50][0][0] == 0 and len(got) == 6


def test_recall_of_the_registered_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], dtype=np.float64), np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in queries.op4_nearest(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits, total = hits + len(best & got[ids[q]]), total + 5
    assert hits / total >= 0.9


def recall_and_leaves(spark, folder, x, monkeypatch):
    """Recall at 5 over the queries, and the share of all leaves that a query takes."""
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x.astype(np.float32)))}),
                   f"{folder}/embeddings.parquet")
    seen, measure = [], rp_forest.leaves_for

    def spy(forest, held, *rest):
        seen.append(measure(forest, held, *rest))
        seen.append(held.size)
        return seen[0]

    monkeypatch.setattr(rp_forest, "leaves_for", spy)
    got = {}
    for r in queries.op4_nearest(spark, str(folder)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    monkeypatch.setattr(rp_forest, "leaves_for", measure)
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = total = 0
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -9
        hits, total = hits + len(set(np.argsort(-s, kind="stable")[:5].tolist()) & got[q]), total + 5
    return hits / total, seen[0] / seen[1]


def clustered(rng, n):
    """Groups of 40 vectors around centres of their own."""
    return np.repeat(rng.normal(size=(n // 40, 64)), 40, axis=0) + 0.3 * rng.normal(size=(n, 64))


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_recall_on_random_directions(spark, tmp_path, monkeypatch, n):
    recall, _ = recall_and_leaves(spark, tmp_path, np.random.default_rng(3).normal(size=(n, 64)), monkeypatch)
    assert recall >= 0.9


def test_clustered_vectors_need_a_falling_share(spark, tmp_path, monkeypatch):
    shares = []
    for n in (4_000, 40_000):
        (tmp_path / str(n)).mkdir()
        recall, share = recall_and_leaves(spark, tmp_path / str(n), clustered(np.random.default_rng(4), n), monkeypatch)
        assert recall >= 0.9
        shares.append(share)
    assert shares[1] < shares[0] / 3
