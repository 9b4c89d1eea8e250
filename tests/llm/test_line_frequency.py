import re

from pyspark.sql import functions as F

from basketmine.llm import line_frequency as lf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = "doc_id long, text string, source string, kept string, h int"


def norm(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))


def brute(rows, max_docs, min_words=5, max_repeat=50, max_lost=50):
    """The rules, document by document and line by line."""
    seen = {}
    for doc, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen.setdefault((source, norm(line)), set()).add((doc, text))
    out = []
    for doc, text, source, *_ in rows:
        t = text or ""
        words = WORD.findall(t)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        lost = sum(len(WORD.findall(x)) for x in lines if len(seen[source, norm(x)]) > max_docs)
        failed = len(words) < min_words or 100 * len(covered) > max_repeat * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"),
                    len(lines) - len(set(lines)), len(covered), failed, lost,
                    not failed and not 100 * lost > max_lost * len(words)))
    return sorted(out, key=str)


ROWS = [
    (1, "alpha beta gamma delta epsilon\nPage 1 of 9", "a"),
    (2, "one two three four five six\npage  2 OF 9 ", "a"),
    (3, "page 3 of 9\nx y", "a"),
    (4, "page 4 of 9\nzeta eta theta iota kappa lambda", "b"),
    (5, None, "a"), (6, "", None), (7, " \t\n\x0b ", "b"),
    (8, "a b c a b c a b c tail", "b"), (9, "é # | <b> ü\né # | <b> ü\n日本 語", None),
    (None, "no id here but five words or more", None), (3, "page 3 of 9\nx y", "a"),
    (10, "r s t u v w x y z " * 700, "c"),
]


def check(spark, rows, max_docs):
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], COLS)
    out = lf.judge(docs, min_words=5, max_line_docs=max_docs)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.base_failed, r.n_lost_words, r.kept) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows, max_docs)


def test_judge_equals_brute_force(spark):
    check(spark, ROWS, 2)     # "page 0 of 0" is in three documents of host a


def test_limit_is_inclusive(spark):
    check(spark, ROWS, 3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLS)
    assert lf.judge(docs).collect() == []


def test_remove_lines(spark):
    docs = spark.createDataFrame([r + ("clash", 1) for r in ROWS[:4]], COLS)
    out = lf.judge(docs, keep=("doc_id", "text", "source"), min_words=5, max_line_docs=2)
    text = lf.remove_lines(F.col("text"), F.col("source"), F.col("lost_lines"))
    got = dict(out.select("doc_id", text.alias("t")).collect())
    assert got == {1: "alpha beta gamma delta epsilon", 2: "one two three four five six",
                   3: "x y", 4: ROWS[3][1]}


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([r + ("clash", 1) for r in ROWS], COLS)
    plan = lf.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
