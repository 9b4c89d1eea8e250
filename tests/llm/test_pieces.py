import itertools
import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketmine.llm import pieces as p

PIECES = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "é", "▁▁"] + [f"<0x{i:02X}>" for i in range(256)]
SCORES = [0.0, -2.0, -3.0, -3.5, -4.0, -4.5, -3.2, -4.1, -5.5, -6.0, -2.5] + [0.0] * 256
SMALL = p.Vocabulary(PIECES, SCORES, set(range(1, 11)), {i: 11 + i for i in range(256)})


def brute(text):
    """Best score over all segmentations of the marked text."""
    marked = p.MARK + text.replace(" ", p.MARK)
    score = {x: s for x, s in zip(PIECES[1:11], SCORES[1:11])}
    best = float("-inf")
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        at = [0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
        parts = [marked[a:b] for a, b in zip(at, at[1:])]
        if all(x in score or len(x) == 1 for x in parts):
            best = max(best, sum(score.get(x, SMALL.unknown_score) for x in parts))
    return best


def score_of(ids):
    """Score of a result; byte pieces of one character count as one unknown character."""
    total, data = 0.0, b""
    for i in ids:
        if i >= 11:
            data += bytes([i - 11])
        else:
            total += SCORES[i]
    return total + SMALL.unknown_score * len(data.decode())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab éx\n", min_size=1, max_size=9))
def test_segmentation_is_the_best(text):
    ids = p.Codec(SMALL).encode(text)
    assert score_of(ids) == pytest.approx(brute(text))
    assert p.Codec(SMALL).decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁é日\0\n", max_size=30), max_size=6))
def test_vectorised_equals_scalar_and_round_trip(texts):
    codec = p.Codec(SMALL)
    for text, ids in zip(texts, codec.encode_many(texts)):
        assert codec.decode(ids) == text
        if p.MARK not in text and text:
            marked = p.MARK + text.replace(" ", p.MARK)
            assert tuple(ids) == tuple(itertools.chain.from_iterable(
                map(SMALL.segment, SMALL.chunk.findall(marked))))


def test_double_array_holds_exactly_its_keys():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "日本", "日", "zz" * 9])}
    trie = p.DoubleArray(keys)

    def get(data):
        s = 0
        for byte in data:
            t = trie.base[s] + byte
            if t >= len(trie.check) or trie.check[t] != s or t == 0:
                return -1
            s = t
        return trie.value[s]

    assert all(get(k) == v for k, v in keys.items())
    assert all(get(k) == -1 for k in (b"", b"z", b"abcd", b"c", "本".encode()))


def test_chunks_do_not_change_the_result():
    whole = pickle.loads(pickle.dumps(SMALL))
    whole.chunk = None
    for text in ("ab ab", "a  b\n\naba é", " ", "\n"):
        assert score_of(p.Codec(whole).encode(text)) == pytest.approx(score_of(p.Codec(SMALL).encode(text)))


def test_public_vocabulary_on_a_table(spark):
    texts = ["Hello  world\n", None, "", "▁ marker", "日本語 🎉 \u0000", "x" * 30_000, "word " * 20_000, "Hello  world\n"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    out = {r.doc_id: r for r in p.encode_documents(df).collect()}
    assert len(out) == len(texts) and all(r.round_trip for r in out.values())
    assert out[1].ids is None and out[1].n_tokens == 0 and out[2].ids == [] and out[0].ids == out[7].ids
    assert all(len(r.ids) == r.n_tokens for r in out.values() if r.ids is not None)
    encoded = p.encode_documents(df, keep=("doc_id", "text"))
    back = encoded.select("text", p.decode_ids(F.col("ids")).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert p.encode_documents(df.filter("doc_id > 99")).collect() == []
