import random
import re

import numpy as np
from pyspark.sql import functions as F

from basketmine.llm import ordinal, queries, toxicity
from basketmine.llm import text_features as tf

D = "/root/testdata/sf0.01"


def make_docs(spark, n=400):
    """Texts whose words tell the grade: 0 junk, 1 half, 2 good."""
    rng, rows = np.random.default_rng(0), []
    for i in range(n):
        g = i % 3
        words = list(rng.choice(["the", "of", "tree", "house", "river"], 30))
        for _ in range(4):
            words[rng.integers(30)] = ["zzz###", "meh", "lovely"][g]
        rows.append((i, " ".join(words), g, i % 2, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int, tail int, score string")


def plain_sets(text):
    """Words, 4-grams and shapes of a text, word by word."""
    out = set()
    for word in text.split():
        low = word.lower()
        letters = "".join(c for c in low if c.isalnum())
        padded = f"^{letters}$"
        short = re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", word)))
        capital = word.isupper() and len(letters) > 1
        out.add(("w", low))
        out |= {("g", padded[i:i + 4]) for i in range(len(padded) - 3)}
        out |= {("s", capital, short[i:i + 20]) for i in range(max(1, len(short) - 19))}
    return out


def test_features_equal_those_taken_word_by_word():
    """As many features as plain Python finds, and equal ones for equal sets only."""
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "Ж", "7", "42", "-", "?", "...", "!!!!!", " ", "  ", "\n", "\u00a0", "漢字", "\U0001F600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    texts += ["", " ", "x", "ab-" * 300 + "?7", "a b", "b a", "end", None, "終" * 3000 + "わりの文"]
    f = tf.Featurizer()
    together = list(f.features_of([t if t is None else t.encode() for t in texts]))
    for t, got in zip(texts, together):
        assert got.tolist() == f.features(None if t is None else t.encode()).tolist()   # whatever stands next to it
        assert (np.diff(got) > 0).all()
        n = len(plain_sets(t or "")) + 4                                    # and the four bins
        assert n - 6 <= len(got) <= n                                       # but for two features in one bucket


def test_long_texts_and_words_are_taken_whole(monkeypatch):
    f = tf.Featurizer()
    late = "".join(chr(0x4E00 + i) for i in range(3000))
    assert f.features(("x" * 300 + "1").encode()).tolist() != f.features(("x" * 300 + "2").encode()).tolist()
    assert len(f.features(late.encode())) > 2900
    plain = f.features(b"one two two three").tolist()
    for space in "\u00a0\u2009\u202f\u3000\x85":
        assert f.features("one two two three".replace(" ", space).encode()).tolist() == plain
    text = " ".join(f"word{i % 700} A-{i} ..." for i in range(5000)).encode()
    whole = f.features(text).tolist()
    monkeypatch.setattr(tf, "PIECE", 5000)
    assert f.features(text).tolist() == whole


def test_scores_equal_plain_sums(spark):
    """Scores recomputed from the weights, without the mask, text by text."""
    docs = make_docs(spark, 60)
    model = ordinal.train(docs, docs.select("doc_id", "grade"), n_grades=3)
    f = tf.Featurizer()
    for r in docs.select("text", ordinal.grade_column(F.col("text"), model).alias("g")).collect():
        dot = sum(float(np.float32(model.weights[b])) for b in f.features(r.text.encode()))
        tails = [1 / (1 + np.exp(t - dot)) for t in model.thresholds]
        assert np.isclose(r.g.tail, tails[0], atol=1e-5) and np.isclose(r.g.expected_grade, sum(tails), atol=1e-5)


def test_repeated_ids_and_disagreeing_labels(spark):
    """The same sample however the tables are partitioned."""
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(30) for j in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, j) for i in range(30) for j in (1, 0)], "doc_id long, toxic int")
    runs = [tf.labelled_sample(docs.repartition(n), labels.repartition(n), 20, doc_id="doc_id", text="text",
                               columns=["toxic"]) for n in (3, 11)]
    assert runs[0][0] == runs[1][0] == [(0,)] * 20
    assert all(np.array_equal(a, b) for a, b in zip(runs[0][1], runs[1][1]))


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(1)
    x = [np.array(sorted(set(rng.integers(0, 40, 6))), dtype=np.int32) for _ in range(3000)]
    truth = rng.normal(size=tf.DIM) * 2
    dots = np.array([truth[r].sum() for r in x])
    grades = np.digitize(dots + rng.logistic(size=3000) * 0.3, [-2.0, 1.0])
    m = ordinal.fit(x, grades, 3)
    assert (np.diff(m.thresholds) > 0).all()
    expected = m.tails(np.array([m.weights[r].sum() for r in x])).sum(axis=1)
    assert np.corrcoef(expected, dots)[0, 1] > 0.8


def test_quality_on_a_table(spark):
    docs = make_docs(spark)
    model = ordinal.train(docs, docs.filter("doc_id < 300").select("doc_id", "grade"), n_grades=3)
    extra = spark.createDataFrame([(1000, None, None, 0, "c"), (1001, "", None, 0, "c"),
                                   (1002, "lovely " * 50_000, 2, 0, "c"), (5, "repeated id", 0, 0, "c")], docs.schema)
    out = docs.unionByName(extra).select("doc_id", "grade", ordinal.grade_column(F.col("text"), model).alias("g")).collect()
    assert len(out) == 404
    test = [r for r in out if 300 <= r.doc_id < 1000]
    assert np.mean([r.g.grade == r.grade for r in test]) > 0.95
    assert all(0 <= r.g.tail <= 1 and 0 <= r.g.expected_grade <= 2 for r in out)
    by = {r.doc_id: r.g for r in out}
    assert by[1000] == by[1001]


def test_without_labels_or_rows(spark):
    docs = make_docs(spark, 6)
    model = ordinal.train(docs, docs.filter("doc_id < 0").select("doc_id", "grade"), n_grades=3)
    assert not model.weights.any() and (np.diff(model.thresholds) > 0).all()
    none = docs.filter("doc_id < 0")
    assert none.select(ordinal.grade_column(F.col("text"), model)).collect() == []
    pu = toxicity.train(docs, none.select("doc_id", F.lit(1).alias("toxic")), prior=0.1,
                        unlabelled_ids=docs.select("doc_id"))
    scores = [r[0] for r in docs.select(toxicity.score_column(F.col("text"), pu)).collect()]
    assert np.allclose(scores, 0.1)


def test_positive_unlabelled_finds_hidden_positives():
    rng = np.random.default_rng(2)

    def doc(toxic):
        words = set(rng.integers(0, 3000, 80))
        return np.array(sorted(words | ({5000 + int(rng.integers(4))} if toxic else set())), dtype=np.int32)

    positive = [doc(True) for _ in range(300)]
    hidden = rng.random(3000) < 0.1
    model = toxicity.fit(positive, [doc(h) for h in hidden], 0.1)
    fresh = rng.random(1000) < 0.1
    score = tf.sigmoid(np.array([model.weights[doc(t)].sum() for t in fresh]) + model.bias)
    assert ((score >= 0.3) == fresh).mean() > 0.98


def test_sample_is_bounded_and_ignores_null_and_repeated_ids(spark):
    docs = make_docs(spark, 50)
    labels = spark.createDataFrame([(i % 40, 1) for i in range(80)] + [(None, 1)], "doc_id long, toxic int")
    rows, x = tf.labelled_sample(docs, labels, 25, doc_id="doc_id", text="text", columns=["toxic"])
    assert len(rows) == len(x) == 25 and set(rows) == {(1,)}
    again = tf.labelled_sample(docs.repartition(7), labels.repartition(3), 25, doc_id="doc_id", text="text", columns=[])
    assert all(np.array_equal(a, b) for a, b in zip(x, again[1]))


def test_registered_queries_against_the_labels(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    q = queries.op3_quality_classifier(spark, D).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in q]) > 0.95          # of the rows it was fitted on
    assert np.mean([r.kept for r in q if r.quality == 1 and r.toxic == 0]) > 0.98


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    t = queries.op7_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in t) and len(t) > 500
    hit = sum(r.predicted and r.toxic for r in t)
    assert hit / sum(r.predicted for r in t) > 0.85 and hit / sum(r.toxic for r in t) > 0.85
