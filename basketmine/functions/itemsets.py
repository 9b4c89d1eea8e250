"""Column expressions for itemsets, supports and rule text.

All built-in Spark functions (JVM side, whole-stage codegen); no UDFs.
An itemset is always a sorted, duplicate-free array so that equal sets are
equal arrays and can be used as equi-join keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's text formats: item separator inside a
# set, field separator of a text record, separator inside the rule's
# bracketed antecedent, the arrow between antecedent and consequent, and
# the pattern before which the rating-file normaliser inserts an empty line
# (a newline followed by a movie header `<digits>:`).
ITEM_SEP = ","
FIELD_SEP = "\t"
RULE_ITEM_SEP = ", "
RULE_ARROW = " -> "
HEADER_BREAK = r"\n(?=\d+:)"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(items: str | Column) -> Column:
    """list -> set: drop repeats, sort (F2)."""
    return F.sort_array(F.array_distinct(col_of(items)))


def items_text(items: str | Column, sep: str = ITEM_SEP) -> Column:
    """Set -> text, in the set's own (sorted) order."""
    return F.array_join(col_of(items), sep)


def items_text_as_strings(items: str | Column, sep: str = ITEM_SEP) -> Column:
    """Set -> text with ids ordered as strings, as the candidate file is (O1)."""
    as_text = F.transform(col_of(items), lambda x: x.cast("string"))
    return F.array_join(F.sort_array(as_text), sep)


def contains_all(container: str | Column, items: str | Column) -> Column:
    """True when every member of `items` is in `container`."""
    return F.size(F.array_except(col_of(items), col_of(container))) == 0


def remove_item(items: str | Column, item: str | Column) -> Column:
    """Set minus one member."""
    return F.array_remove(col_of(items), col_of(item))


def support(freq: str | Column, n_users: int) -> Column:
    """(double) count / N, as a double division (A3)."""
    return col_of(freq).cast("double") / F.lit(float(n_users))


def is_frequent(freq: str | Column, n_users: int, min_support: float) -> Column:
    """Strict test support > t (Q1); never >=."""
    return support(freq, n_users) > F.lit(float(min_support))


def confidence(set_support: str | Column, antecedent_support: str | Column) -> Column:
    """Quotient of two supports, each already a double (Q7)."""
    return col_of(set_support) / col_of(antecedent_support)


def rule_text(antecedent: str | Column, consequent: str | Column) -> Column:
    """`[a, b] -> c` (F8)."""
    return F.concat(F.lit("["), F.array_join(col_of(antecedent), RULE_ITEM_SEP),
                    F.lit("]" + RULE_ARROW), col_of(consequent).cast("string"))


def normalise_blocks(text: str | Column) -> Column:
    """Put an empty line before every movie header inside a text."""
    return F.regexp_replace(col_of(text), HEADER_BREAK, "\n\n")


def strip_blank(text: str | Column) -> Column:
    """Trim white space, newlines included, at both ends."""
    return F.regexp_replace(col_of(text), r"^\s+|\s+$", "")


def min_count_above(n_users: int, min_support: float) -> int:
    """Smallest integer m with m / N > t, evaluated in double arithmetic.

    `floor(t*N)+1` alone is wrong when t*N is inexact (0.29*100 is
    28.999999999999996), so the candidate is corrected with the exact
    test that the miner itself applies.
    """
    if n_users <= 0:
        raise ValueError("N must be positive")
    m = max(0, math.floor(min_support * n_users) + 1)
    while m > 0 and (m - 1) / n_users > min_support:
        m -= 1
    while not m / n_users > min_support:
        m += 1
    return m
