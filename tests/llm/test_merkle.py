import hashlib

import pytest
from pyspark.sql import functions as F

from basketmine.llm import merkle

COLS = "doc_id long, source string, text string, pos2 int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, at, fanout):
    """Root of the nodes, and the siblings (left, right) of node `at` on the way."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // fanout * fanout:at // fanout * fanout + fanout]
        k = at % fanout
        path.append(("".join(run[:k]), "".join(run[k + 1:])))
        nodes, at = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)], at // fanout
    return nodes[0], path


def brute(rows, fanout):
    by = {}
    for doc, source, text in rows:
        by.setdefault(source, []).append((doc is not None, doc or 0, h(field(doc) + field(source) + field(text))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [x[2] for x in sorted(by[s])] for s in order}
    subs = [climb(leaves[s], 0, fanout)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        for at, (there, doc, leaf) in enumerate(sorted(by[s])):
            sub, path = climb(leaves[s], at, fanout)
            root, rest = climb(subs, i, fanout)
            out.append((doc if there else None, leaf, sub, root, path + rest))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], str(r[2:]))


def run(spark, rows, fanout, block_levels, parts=5):
    df = spark.createDataFrame([r + (1,) for r in rows], COLS).repartition(parts)
    m = merkle.build(df, source="source", order="doc_id", fanout=fanout, keep={"doc_id": F.col("doc_id")},
                     leaf=merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("text")))
    out = merkle.proofs(m, block_levels=block_levels)
    out = out.withColumn("ok", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).collect()
    assert all(r["ok"] for r in out)
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in out]


ROWS = ([(i, "hot", f"text {i}") for i in range(70)] + [(i, f"s{i}", "x") for i in range(100, 111)]
        + [(200, None, None), (201, "", ""), (202, "é", "日本語"), (None, "hot", "no id"), (3, "hot", "text 3"),
           (3, "hot", "other"), (None, None, "long " * 50_000)])


@pytest.mark.parametrize("fanout,block_levels", [(2, 1), (3, 2), (16, 3)])
def test_proofs_equal_brute_force(spark, fanout, block_levels):
    assert sorted(run(spark, ROWS, fanout, block_levels), key=key) == sorted(brute(ROWS, fanout), key=key)


def test_one_row_and_no_row(spark):
    (row,) = run(spark, [(1, "a", "t")], 16, 3)
    assert row[1] == row[2] == row[3] and row[4] == []
    assert run(spark, [], 16, 3) == []


def test_missing_is_minimal_and_sufficient():
    for size in range(1, 40):
        for lo in range(size):
            for hi in range(lo, size):
                got = merkle.missing(lo, hi, size, 3)
                a, b, n, level, want = lo, hi, size, 0, []
                while n > 1:        # by sets: what the parents of the known nodes lack
                    known = set(range(a, b + 1))
                    runs = {i for k in known for i in range(k // 3 * 3, min(k // 3 * 3 + 3, n))}
                    want += [(level, i) for i in sorted(runs - known)]
                    a, b, n, level = a // 3, b // 3, -(-n // 3), level + 1
                assert [(lv, i) for lv, x, y in got for i in range(x, y + 1)] == want


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, "s", f"T{i}", 0) for i in range(40)], COLS)
    m = merkle.build(df, source="source", order="doc_id", leaf=merkle.leaf_hash(F.col("text")),
                     keep={"bad": merkle.leaf_hash(F.lower("text"))})
    out = merkle.proofs(m).select((merkle.fold(F.col("bad"), F.col("path")) == F.col("root")).alias("ok"))
    assert {r["ok"] for r in out.collect()} == {False}
