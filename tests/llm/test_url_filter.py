import pytest
from pyspark.sql import functions as F

from basketmine.llm import queries
from basketmine.llm import url_filter as u

CASES = {
    "http://A.Example.NET/en/1?x=/y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://example.net/en/": ("example.net", "/en/", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "https://net": ("net", "", None, "allow"),
    "https://x.net": ("x.net", "", None, "allow"),
    "https://a.example.com/de/x": ("a.example.com", "/de/x", "example.com/de/", "block"),
    "https://free-bets.org/fr/": ("free-bets.org", "/fr/", "org/fr/", "allow"),
    "https://free-bets.org/": ("free-bets.org", "/", None, "block"),
    "https://casino-win.example.com/en": ("casino-win.example.com", "/en", None, "block"),
    "https://casinos.example.com/en": ("casinos.example.com", "/en", None, "allow"),
    "https://win.com/win/win": ("win.com", "/win/win", None, "allow"),
    "https://cheap.com/PILLS": ("cheap.com", "/PILLS", None, "block"),
    "no scheme casino": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://h#f": ("h", "", None, "allow"),
    "https://news.com/free-offer/win": ("news.com", "/free-offer/win", None, "block"),     # 3 weak terms
    "https://news.com/free-offer": ("news.com", "/free-offer", None, "allow"),             # 2 weak terms
    "https://poker.com/poker/POKER": ("poker.com", "/poker/POKER", None, "allow"),         # one telling term
    "https://poker.com/bonus": ("poker.com", "/bonus", None, "block"),
    "https://essex.gov.uk/analysis-of-pharmacy_law": ("essex.gov.uk", "/analysis-of-pharmacy_law", None, "allow"),
    "https://shop.com/?q=cheap%20viagra": ("shop.com", "/", None, "block"),
    "https://docs.org/xxx1/1xxx/xxxé": ("docs.org", "/xxx1/1xxx/xxxé", None, "allow"),
    "https://éads.com/track": ("éads.com", "/track", None, "allow"),
    "https://long.com/" + "a" * 100_000: ("long.com", "/" + "a" * 100_000, None, "allow"),
}


def test_cases(spark):
    df = spark.createDataFrame([(url, 1, "clash") for url in CASES] + [("", 2, "again")],
                               "url string, verdict int, host string")
    out = df.select("url", u.judge_url(F.col("url"), queries.OP6_RULES).alias("j")).select("url", "j.*").collect()
    assert len(out) == len(CASES) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.url], r.url


def test_longest_rule_wins_and_first_of_equals():
    rules = u.index_rules([("allow", "a.b", "/x"), ("block", "b", "/x"), ("block", "a.b", "/x")])
    assert u.match_rule(rules, "z.a.b", "/xy") == ("a.b/x", "allow")
    assert u.match_rule(rules, "b", "/xy") == ("b/x", "block")
    assert u.match_rule(rules, "", "") == (None, None)


def test_empty_table_and_empty_vocabulary(spark):
    df = spark.createDataFrame([], "url string")
    assert df.select(u.judge_url(F.col("url"), queries.OP6_RULES)).collect() == []
    one = spark.createDataFrame([("http://casino.com/",)], "url string")
    assert one.select(u.judge_url(F.col("url"), vocabulary=())["verdict"]).first()[0] == "allow"


def test_vocabulary_table(spark):
    cols = "term string, kind string, weight int, verdict string"
    rows = [(" Alpha ", "soft", 1, "x"), ("alpha", "soft", 2, "x"), ("beta", "soft", 5, "x"), ("beta", "strict", 1, "x"),
            ("gamma-ray", "soft", 2, "x")]
    vocabulary = u.read_vocabulary(spark.createDataFrame(rows, cols))
    assert vocabulary == [("alpha", "soft", 2), ("beta", "strict", 1), ("gamma-ray", "soft", 2)]
    df = spark.createDataFrame([("h://a/alpha",), ("h://a/alpha/gamma-ray",), ("h://beta",)], "url string")
    got = df.select(u.judge_url(F.col("url"), vocabulary=vocabulary).alias("j")).select("j.*").collect()
    assert [(r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in got] == [
        ("allow", 0, 1, 2), ("block", 0, 2, 4), ("block", 1, 0, 0)]
    with pytest.raises(ValueError):
        u.read_vocabulary(spark.createDataFrame(rows, cols), max_terms=4)
    for bad in ((None, "soft", 1, ""), ("a", "mild", 1, ""), ("a", "soft", 0, "")):
        with pytest.raises(ValueError):
            u.read_vocabulary(spark.createDataFrame([bad], cols))


def test_built_in_terms_stand_once():
    terms = [t for t, _, _ in u.VOCABULARY]
    assert len(set(terms)) == len(terms) and all(t == t.lower() for t in terms)
