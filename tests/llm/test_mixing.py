import hashlib
import re
from collections import Counter, defaultdict

import pytest

from basketmine.llm import mixing

COLS = "doc_id long, text string, source string, size string, target int"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def row_hash(doc, text):
    joined = f"{'' if doc is None else doc}\x1f{text or ''}"
    return int(hashlib.md5(joined.encode()).hexdigest()[:15], 16)


def brute_targets(sizes, ratio, repeats, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = ratio * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > repeats * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: repeats * sizes[s] for s in over}
        free -= over
    return target


def brute(rows, ratio=1.5, repeats=2):
    sizes = Counter()
    for doc, text, source in rows:
        sizes[source] += size(text)
    target = brute_targets(sizes, ratio, repeats)
    copies = Counter()
    for s in sizes:
        by_hash = defaultdict(int)
        for doc, text, source in rows:
            if source == s:
                by_hash[row_hash(doc, text)] += size(text)
        for k in range(repeats):
            budget, got = target[s] - k * sizes[s], 0
            if budget <= 0:
                continue
            for h in sorted(by_hash):
                n = by_hash[h]
                if got + n > budget and not n - (budget - got) < budget - got:
                    break
                copies[s, h] += 1
                got += n
                if got > budget:
                    break
    return sorted(((d, size(t), sizes[s], round(target[s], 6), size(t) * copies[s, row_hash(d, t)])
                   for d, t, s in rows), key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], COLS)
    out = mixing.mix(docs, keep=("doc_id",), **kw).collect()
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in out]
    assert sorted(got, key=str) == brute(rows)
    taken = mixing.take_mix(docs, **kw)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == \
        Counter({r.doc_id: 0 for r in out}) + Counter(x for r in out for x in [r.doc_id] * r.copies)


def test_mix_equals_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), ["a", "b", "ä", "Z", None][i * i % 5]) for i in range(200)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t", "empty"), (None, "x y", "a")]
    check(spark, rows)


def test_hot_source_and_long_document(spark):
    check(spark, [(i, "w " * (1 + i % 5), "hot" if i % 3 else "cold") for i in range(150)]
          + [(999, "long " * 20_000, "cold")])


def test_repeated_rows_are_taken_alike(spark):
    check(spark, [(7, "same text here", "a")] * 20 + [(i, "w w", "b") for i in range(10)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLS)
    assert mixing.mix(docs, keep=("doc_id",)).collect() == []
    assert mixing.take_mix(docs).collect() == []


def test_one_source_is_capped(spark):
    rows = [(i, "a b c", "only") for i in range(40)]
    docs = spark.createDataFrame([r + ("c", 1) for r in rows], COLS)
    r = mixing.mix(docs, keep=("doc_id",)).selectExpr("sum(taken) t", "first(target) g").first()
    assert r.g == pytest.approx(180) and abs(r.t - 180) <= 3


def test_smaller_budgets_are_nested(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(100)]
    docs = spark.createDataFrame([r + ("c", 1) for r in rows], COLS)
    small, large = ({r.doc_id: r.copies for r in mixing.mix(docs, keep=("doc_id",), budget_ratio=b).collect()}
                    for b in (0.4, 0.9))
    assert all(small[k] <= large[k] for k in small) and sum(small.values()) < sum(large.values())


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a", "s", "c", 1)], COLS)
    plan = mixing.mix(docs, keep=("doc_id",))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
