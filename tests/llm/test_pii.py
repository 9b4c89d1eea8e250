import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketmine.llm import pii

P = pii.Pseudonyms("test key")


def test_feistel_is_a_permutation_without_fixed_points():
    for n in (2, 3, 10, 97, 1000):
        net = pii.Feistel("k", "t", n)
        out = [net.pseudonym(x) for x in range(n)]
        assert sorted(out) == list(range(n)) and all(a != b for a, b in enumerate(out))
        assert [net.original(y) for y in out] == list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 14 - 1), st.sampled_from("3456"))
def test_cards_stay_valid(body, first):
    digits = first + f"{body:014d}"
    card = digits + pii.luhn_digit(digits)
    new = P.card(card)
    assert new != card and new[0] == first and pii.luhn_digit(new[:-1]) == new[-1]
    assert P.card(new, back=True) == card


@settings(max_examples=60, deadline=None)
@given(st.dates(pii.FIRST_DAY, pii.LAST_DAY))
def test_dates_stay_linked_across_formats(day):
    iso, dotted = P.date(day.isoformat()), P.date(day.strftime("%d.%m.%Y"))
    new = datetime.date.fromisoformat(iso)
    assert new.strftime("%d.%m.%Y") == dotted and new != day
    assert P.date(iso, back=True) == day.isoformat()
    if day.day > 12:
        assert P.date(day.strftime("%m/%d/%Y")) == new.strftime("%m/%d/%Y")


def test_kinds_and_validation():
    text = ("Card 4111 1111 1111 1111 or 4111-1111-1111-1111, bad 4111111111111112; "
            "mail Jo.Doe@Mail3.example.com, JO.DOE@mail3.example.com; ip 10.0.0.255 not 10.0.0.256; "
            "tel +1 (017) 555-7713; ssn 123-45-6789 not 666-45-6789; born 1990-02-28 not 1990-02-30; "
            "iban DE89 3704 0044 0532 0130 00; version 1.2.3, price 1234567")
    new, spans = P.rewrite(text)
    found = [(k, text[s:e]) for k, s, e in spans]
    assert found == [("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"),
                     ("email", "Jo.Doe@Mail3.example.com"), ("email", "JO.DOE@mail3.example.com"),
                     ("ipv4", "10.0.0.255"), ("phone", "+1 (017) 555-7713"), ("ssn", "123-45-6789"),
                     ("date", "1990-02-28"), ("iban", "DE89 3704 0044 0532 0130 00")]
    for kept in ("4111111111111112", "10.0.0.256", "666-45-6789", "1990-02-30", "1.2.3", "1234567"):
        assert kept in new
    for _, value in found:
        assert value not in new
    assert P.rewrite(new, back=True)[0] == text
    # Equal values in other notations get equal pseudonyms.
    a, b = P.card("4111 1111 1111 1111"), P.card("4111-1111-1111-1111")
    assert a.replace(" ", "") == b.replace("-", "")
    assert P.email("Jo.Doe@Mail3.example.com").lower() == P.email("JO.DOE@mail3.example.com").lower()
    check = new[new.index("iban ") + 5:].split(";")[0].replace(" ", "")
    assert pii.iban_check(check[:2], check[4:]) == check[2:4]


def test_cards_and_ibans_next_to_other_groups():
    cases = {"born 1990-02-28 4845168114407329": ["1990-02-28", "4845168114407329"],
             "4111111111111111 12/25": ["4111111111111111"],
             "card 4111 1111 1111 1111 123": ["4111 1111 1111 1111"],
             "order 12 4111111111111111": ["4111111111111111"],
             "4111-1111-1111-1111-123": ["4111-1111-1111-1111"],
             "2024 4111 1111 1111 1111 1234 3782 822463 10005": ["4111 1111 1111 1111", "3782 822463 10005"],
             "12 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1": [" ".join("4111111111111111")],
             "4111111111111111 4845168114407329 7": ["4111111111111111", "4845168114407329"],
             "pay BE68 5390 0754 7034 2024 now": ["BE68 5390 0754 7034"],
             "REF AB12 DE89 3704 0044 0532 0130 00 EUR": ["DE89 3704 0044 0532 0130 00"],
             "BE68539007547034 DE89370400440532013000": ["BE68539007547034", "DE89370400440532013000"]}
    for text, values in cases.items():
        new, spans = P.rewrite(text)
        assert [text[s:e] for _, s, e in spans] == values, text
        for v in values:
            kind = "date" if v.startswith("1990") else "iban" if v[0].isalpha() else "card"
            assert getattr(P, kind)(v) in new and len(new) == len(text)
        assert P.rewrite(new, back=True)[0] == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text("0123456789", min_size=1, max_size=5),
                          st.text("23456", min_size=4, max_size=4),
                          st.sampled_from(["4111 1111 1111 1111", "4845168114407329", "3782 822463 10005"])),
                min_size=1, max_size=14))
def test_runs_of_digit_groups_come_back(groups):
    text = " ".join(groups)
    new, spans = P.rewrite(text)
    assert P.rewrite(new, back=True)[0] == text
    assert all(P.card_valid(text[s:e]) and P.card_valid(new[s:e]) and new[s:e] != text[s:e] for _, s, e in spans)


def test_column(spark):
    rows = [(1, "a@b.example.com and a@b.example.com"), (2, None), (3, ""), (4, "clean text"),
            (5, "see a@b.example.com"), (6, "x" * 200_000 + " 4111111111111111 @" + "y" * 200_000), (5, "1")]
    df = spark.createDataFrame([r + ("clash", 0) for r in rows], "id int, text string, spans string, n_found int")
    got = df.select("id", pii.pseudonymise(F.col("text"), "k").alias("p")).collect()
    by = {(r.id, i): r.p for i, r in enumerate(got)}
    name = pii.Pseudonyms("k").email("a@b.example.com")
    assert by[1, 0].text == f"{name} and {name}" and by[1, 0].n_found == 2
    assert [(s.kind, s.start, s.end) for s in by[1, 0].spans] == [("email", 0, 15), ("email", 20, 35)]
    assert by[2, 1].text is None and by[2, 1].n_found == 0 and by[3, 2].text == "" and by[4, 3].text == "clean text"
    assert by[5, 4].text == f"see {name}" and by[6, 5].n_found == 1 and by[5, 6].text == "1"
    back = df.limit(1).select(pii.pseudonymise(pii.pseudonymise(F.col("text"), "k")["text"], "k", back=True)["text"])
    assert back.first()[0] == rows[0][1]
    assert df.filter("id = 99").select(pii.pseudonymise(F.col("text"))).collect() == []
