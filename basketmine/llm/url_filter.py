"""URL filter: host and path rules first, then a weighted URL vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased
URL in one pass.  A hit counts only at term boundaries: the characters before
and after it are neither letters nor digits.  An escape such as %20 is a boundary.  One strict term rejects; several
distinct soft terms reject once their weights add up.  The vocabulary is a
parameter, a list or a table (`read_vocabulary`); the built-in one is a default.

Rows are judged one by one in Arrow batches, without a shuffle.  Rules and
vocabulary are parameters, sent with the task; they do not grow with the data.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT, SOFT = "strict", "soft"

# A vocabulary of our own, (term, kind, weight): unambiguous terms, telling ones, and weak ones.
VOCABULARY = (
    [(t, STRICT, 1) for t in (
        "blackjack", "camgirls", "casino", "cialis", "escort", "escorts", "gambling", "hentai", "hookers",
        "jackpot", "keygen", "milf", "phishing", "porn", "porno", "pornography", "roulette", "sexcam", "sportsbook",
        "torrents", "viagra", "warez", "webcamsex", "xxx")]
    + [(t, SOFT, 2) for t in (
        "adult", "affiliate", "baccarat", "bets", "betting", "bingo", "cracked", "crack", "dating", "erotic", "escrow",
        "farma", "fetish", "forex", "lottery", "nude", "nudes", "payday", "pharma", "pharmacy", "pills", "poker",
        "replica", "serial", "sex", "sexy", "slots", "spam", "spyware", "steroids", "strip", "tracker", "wager")]
    + [(t, SOFT, 1) for t in (
        "ads", "adserver", "bet", "bonus", "buy", "cash", "cheap", "click", "coupon", "credit", "deal", "deals",
        "diet", "discount", "download", "earn", "free", "girls", "hot", "insurance", "live", "loan", "loans", "lucky",
        "money", "offer", "offers", "online", "popup", "prize", "promo", "redirect", "sale", "spin", "track", "win",
        "winner")])
MIN_SOFT = 2        # distinct soft terms that reject together, if
MIN_WEIGHT = 3      # their weights add up to at least this
MAX_TERMS = 1_000_000   # a larger vocabulary is refused: it goes to every task

SCHEMA = ("host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight int")
_ESCAPE = re.compile("%[0-9a-f]{2}")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without '://'."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    end = min((i for i in map(rest[2].find, "/?#") if i >= 0), default=len(rest[2]))
    host, tail = rest[2][:end], rest[2][end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:cut]


def index_rules(rules) -> dict[str, list[tuple[str, str]]]:
    """host -> [(path, verdict)], longest path first; of equal rules the first stays first."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    return {h: sorted(v, key=lambda r: -len(r[0])) for h, v in by_host.items()}


def match_rule(by_host, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule (host + path) whose host is `host` or a parent domain of it."""
    best, labels = (None, None), host.split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for rule_path, verdict in by_host.get(suffix, ()):
            if path.startswith(rule_path):
                if best[0] is None or len(suffix + rule_path) > len(best[0]):
                    best = (suffix + rule_path, verdict)
                break
    return best


def _wordy(c: str) -> bool:
    return c.isascii() and c.isalnum() or not c.isascii()


def read_vocabulary(terms: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple[str, str, int]]:
    """(term, kind, weight) rows of a table, e.g. read from a file, as a vocabulary.

    Terms are trimmed and lower-cased (A-Z).  Rows without a term, without a
    weight above 0 or of another kind than 'strict' and 'soft' are an error, and
    so is a table above `max_terms`.  Of a repeated term the strict row counts,
    then the one of the largest weight.
    """
    rows = terms.select("term", "kind", F.col("weight").cast("int").alias("weight")).limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"vocabulary of more than {max_terms} terms")
    best: dict[str, tuple[bool, int]] = {}
    for r in rows:
        term = (r["term"] or "").strip().translate(_LOWER)
        if not term or r["kind"] not in (STRICT, SOFT) or (r["weight"] or 0) <= 0:
            raise ValueError(f"vocabulary row {r}")
        best[term] = max(best.get(term, (False, 0)), (r["kind"] == STRICT, r["weight"]))
    return [(t, STRICT if strict else SOFT, w) for t, (strict, w) in sorted(best.items())]


def count_terms(automaton, url: str | None) -> tuple[int, int, int]:
    """Distinct strict and soft terms found at boundaries, and the weight of the soft ones."""
    text, found = _ESCAPE.sub(" ", (url or "").translate(_LOWER)), set()
    for end, (term, kind, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _wordy(text[start - 1])) and \
                (end + 1 == len(text) or not _wordy(text[end + 1])):
            found.add((term, kind, weight))
    soft = [weight for _, kind, weight in found if kind == SOFT]
    return len(found) - len(soft), len(soft), sum(soft)


def judge_url(url: Column, rules=(), vocabulary=tuple(VOCABULARY), min_soft: int = MIN_SOFT,
              min_weight: int = MIN_WEIGHT) -> Column:
    """Struct of host, path, rule, verdict ('allow' or 'block'), n_strict, n_soft and soft_weight.

    `rules` holds (verdict, host, path); `vocabulary` holds (term, 'strict' |
    'soft', weight) in lower case.  Defined cases: a null URL or one without '://' has
    empty host and path and fits no rule; an empty path fits only rules with an
    empty path; of two rules of equal length the first given wins; repeated hits
    of a term count once; urls are read whole, however long; equal urls have equal
    verdicts; an empty table gives no rows.  Only the given column is read, so
    other columns may have any name.
    """
    rules, vocabulary = list(rules), list(vocabulary)

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for entry in vocabulary:
            automaton.add_word(entry[0], entry)
        if vocabulary:
            automaton.make_automaton()
        by_host = index_rules(rules)
        for urls in batches:
            rows = []
            for url in urls:
                url = url if isinstance(url, str) else None
                host, path = split_url(url)
                rule, verdict = match_rule(by_host, host, path)
                strict, soft, weight = count_terms(automaton, url) if vocabulary else (0, 0, 0)
                if rule is None:
                    verdict = "block" if strict or soft >= min_soft and weight >= min_weight else "allow"
                rows.append((host, path, rule, verdict, strict, soft, weight))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return judge(url.cast("string"))
