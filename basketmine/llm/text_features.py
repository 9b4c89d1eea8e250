"""Hashed text features for the linear classifiers, and their bounded training sample.

A text becomes the set of its hashed features: lower-cased words, character
4-grams of the letters and digits of words, word shapes (letter runs, digit runs,
punctuation), and a few binned counts (share of distinct words, words equal to
the one before, repeated lines).  Presence only: how often a feature occurs does
not count, so a very long text is one set like any other.

Words end at Unicode white space and are taken whole, however long: a text
without spaces (Chinese, Japanese, Thai) is one word with all its 4-grams and
shapes.

All texts of a group are hashed at once over one array of code points: a polynomial
hash with prefix sums gives the hash of any stretch, so words, shapes and
lines cost one pass each.  Scoring keeps only features that have a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmine.llm.common import hash_sample
from basketmine.llm.shingles import mix

BITS = 18
DIM = 1 << BITS
SHAPE_WINDOW = 20            # longer shapes become all their windows of this length
PIECE = 400_000              # code points hashed at once; a longer text is several pieces of whole words
_TABLE = 1 << 16             # code points looked up; of those beyond, only the ideographs count as letters
_IDEOGRAPHS = 0x20000
_BASE = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2^64
_WORD, _GRAM, _SHAPE, _CAPITALS, _BIN = (np.uint64(k * 0xD6E8FEB86659FD93 % 2 ** 64) for k in range(1, 6))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


class Featurizer:
    """Texts -> sorted arrays of their feature buckets, of those in `wanted` (a mask; all by default)."""

    def __init__(self, wanted: np.ndarray | None = None):
        chars = [chr(i) for i in range(_TABLE)]
        self.space, self.letter, self.digit, self.alnum, self.upper, self.lower = (
            np.array([f(c) for c in chars]) for f in
            (str.isspace, str.isalpha, str.isdecimal, str.isalnum, str.isupper, str.islower))
        self.low = np.array([ord(c.lower()[0]) for c in chars], np.uint32)
        self.wanted = wanted
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, PIECE + 1)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 2 ** 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums for `_stretch`."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values.astype(np.uint64) + _BIN) * self.power[:len(values)], out=out[1:])
        return out

    def _stretch(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of values[a:b], wherever it stands."""
        return (sums[b] - sums[a]) * self.inverse[a]

    def _hits(self, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        """owner * DIM + bucket of each feature that is wanted, once."""
        bucket = _bucket(h)
        if self.wanted is not None:
            keep = self.wanted[bucket]
            owner, bucket = owner[keep], bucket[keep]
        return np.unique(owner * DIM + bucket)

    def _piece(self, texts: list[str], owners: list[int]):
        """Hits, and (owner, hash) of the words and of the lines with a word, in order."""
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array(owners, np.int64), [len(t) + 1 for t in texts])
        at = np.minimum(cp, _TABLE - 1)
        far = cp >= _TABLE
        space = self.space[at] & ~far
        if space.all():
            return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.int64)] * 2
        wide = cp >= _IDEOGRAPHS
        alnum = (self.alnum[at] & ~far) | wide
        low = np.where(far, cp, self.low[at])
        edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = self._sums(low)
        word, of = self._stretch(sums, a, b), owner[a]
        hits = [self._hits(of, word + _WORD)]
        # 4-grams over letters and digits, 0 at both ends of a word.
        stay = alnum | space
        g, g_owner = np.where(alnum, low + np.uint32(1), np.uint32(0))[stay], owner[stay]
        once = np.concatenate([[True], (g[1:] != 0) | (g[:-1] != 0)])
        g, g_owner = np.concatenate([[0], g[once]]).astype(np.uint64), np.concatenate([[0], g_owner[once]])
        if len(g) > 3:
            ok = np.flatnonzero((g[1:-2] != 0) & (g[2:-1] != 0))
            h = np.zeros(len(ok), np.uint64)
            for i in range(4):
                h = mix(h + _GRAM + g[ok + i])
            hits.append(self._hits(g_owner[ok + 1], h))
        # Shapes: a run of letters or digits as one mark, of other characters as three at most.
        letter, digit = (self.letter[at] & ~far) | wide, self.digit[at] & ~far
        mark = np.where(space, 0, np.where(letter, 1, np.where(digit, 2, cp.astype(np.int64) + 16)))
        index = np.arange(len(mark))
        new = np.concatenate([[True], mark[1:] != mark[:-1]])
        run = index - np.maximum.accumulate(np.where(new, index, 0))
        stay = (run == 0) | ((run < 3) & (mark > 2))
        short = mark[stay]
        edge = np.diff(np.concatenate([[1], (short == 0).view(np.int8), [1]]))
        sa, sb = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)      # the same words, in the same order
        capital = np.add.reduceat(self.upper[at] & ~far, a, dtype=np.int64) > 0
        capital &= np.add.reduceat(self.lower[at] & ~far, a, dtype=np.int64) == 0
        capital &= np.add.reduceat(alnum, a, dtype=np.int64) > 1
        salt = np.where(capital, _CAPITALS, _SHAPE)
        windows = np.maximum(sb - sa - SHAPE_WINDOW + 1, 1)
        w = np.repeat(np.arange(len(sa)), windows)
        first = sa[w] + np.arange(len(w)) - np.repeat(np.cumsum(windows) - windows, windows)
        shape = self._stretch(self._sums(short), first, np.minimum(first + SHAPE_WINDOW, sb[w]))
        hits.append(self._hits(of[w], shape + salt[w]))
        ends = np.flatnonzero(cp == 10)
        line = np.unique(np.searchsorted(ends, a))
        begin = np.concatenate([[0], ends[:-1] + 1])
        return np.concatenate(hits), of, word, owner[begin[line]], self._stretch(sums, begin[line], ends[line])

    @staticmethod
    def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Number of distinct hashes per owner (their upper 44 bits)."""
        both = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (mix(h.astype(np.uint64)) >> np.uint64(20)))
        return np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=n)

    def _bins(self, n: int, of, word, line_of, line) -> np.ndarray:
        words, lines = np.bincount(of, minlength=n), np.bincount(line_of, minlength=n)
        same = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        repeats = np.bincount(of[1:][same], minlength=n)
        some = np.maximum(words, 1)
        size = np.where(words == 0, 15, np.minimum(np.log2(some).astype(np.int64), 10))
        bins = [np.minimum(size, 5) + 64 * (words == 0), size * 16 + 8 * self._distinct(of, word, n) // some,
                np.minimum(8, 16 * repeats // some),
                4 * self._distinct(line_of, line, n) // np.maximum(lines, 1)]
        out = [self._hits(np.arange(n), mix(b.astype(np.uint64) + np.uint64(1000 * k)) + _BIN)
               for k, b in enumerate(bins)]
        return np.concatenate(out)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        pieces, now, owners, size = [], [], [], 0
        for i, text in enumerate(texts):
            start = 0
            while True:
                end = len(text)
                if end - start > PIECE:       # cut at the last white space, or inside a word longer than a piece
                    end = start + PIECE
                    cut = max(text.rfind(c, start, end) for c in " \n\t")
                    end = cut + 1 if cut > start else end
                if size + end - start > PIECE and now:
                    pieces.append((now, owners))
                    now, owners, size = [], [], 0
                now.append(text[start:end])
                owners.append(i)
                size += end - start
                start = end
                if start >= len(text):
                    break
        parts = [self._piece(*p) for p in [*pieces, (now, owners)]]
        hits, *stats = (np.concatenate(x) for x in zip(*parts))
        keys = np.unique(np.concatenate([hits, self._bins(len(texts), *stats)]))
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * DIM)
        buckets = (keys % DIM).astype(np.int32)
        return [buckets[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def features_of(self, batch) -> Iterator[np.ndarray]:
        """Features of each text of `batch` (UTF-8 bytes, null for none), some texts at a time."""
        group, size = [], 0
        for data in batch:
            text = data.decode("utf-8", "replace") if isinstance(data, bytes) else ""
            group.append(text)
            size += len(text)
            if size >= PIECE or len(group) >= 2000:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def features(self, data: bytes | None) -> np.ndarray:
        return next(self.features_of([data]))


def features_column(text: Column) -> Column:
    """Binary column: the feature buckets of a text, as little-endian int32."""
    @F.pandas_udf("binary")
    def featurize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Featurizer()
        for b in batches:
            yield pd.Series([x.tobytes() for x in f.features_of(b)], dtype=object)

    return featurize(F.coalesce(text, F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, *, doc_id: str,
                    text: str, columns: list[str]) -> tuple[list, list[np.ndarray]]:
    """A deterministic sample of labelled documents, at most `max_rows`: label rows and features.

    Rows are taken in order of a hash of their id, so the sample does not
    depend on partitioning.  Of several labels of an id the least counts, of
    several texts the one with the least hash.  The chosen ids (a bounded list) are
    joined to the documents; only their features come to the driver, a
    document's at most DIM numbers.
    """
    one = (labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_tf_id"))
           .agg(F.count(F.lit(1)).alias("_tf_n"), *[F.min(c).alias(f"_tf_{c}") for c in columns]))
    chosen = hash_sample(one, F.col("_tf_id"), max_rows)
    rows = (docs.select(F.col(doc_id).alias("_tf_doc"), F.col(text).alias("_tf_text"))
            .join(F.broadcast(chosen), F.col("_tf_doc") == F.col("_tf_id"))
            .groupBy("_tf_doc", *[f"_tf_{c}" for c in columns])
            .agg(F.min_by("_tf_text", F.struct(F.xxhash64("_tf_text"), "_tf_text")).alias("_tf_text"))
            .select("_tf_doc", *[f"_tf_{c}" for c in columns],
                    features_column(F.col("_tf_text")).alias("_tf_x"))
            .collect())
    rows.sort(key=lambda r: r[0])
    return ([tuple(r)[1:-1] for r in rows], [np.frombuffer(r["_tf_x"], np.int32) for r in rows])


class Sparse:
    """Rows of binary features in compressed form, restricted to frequent ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    @classmethod
    def restricted(cls, rows: list[np.ndarray], keep: np.ndarray) -> "Sparse":
        return cls([r[keep[r]] for r in rows])

    def take(self, rows: np.ndarray) -> "Sparse":
        return Sparse([self.index[self.start[i]:self.start[i + 1]] for i in rows])

    def __len__(self):
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def pull(self, g: np.ndarray) -> np.ndarray:
        """Gradient of sum(g * dot(w)) by w."""
        return np.bincount(self.index, np.repeat(g, np.diff(self.start)), DIM)


def telling_features(rows_a: list[np.ndarray], rows_b: list[np.ndarray], *, least: int,
                     z: float = 4.0, ratio: float = 2.0) -> np.ndarray:
    """Features whose share of rows differs between a and b: significantly, and by a factor.

    The rest would add noise to the score of a long text, which holds thousands
    of features.
    """
    na, nb = len(rows_a) + 1.0, len(rows_b) + 1.0
    a, b = (np.bincount(np.concatenate(r), minlength=DIM) if r else np.zeros(DIM)
            for r in (rows_a, rows_b))
    pa, pb, p = (a + 0.5) / na, (b + 0.5) / nb, (a + b + 1.0) / (na + nb)
    far = np.abs(pa - pb) >= z * np.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    # Features of most rows count by the rows that lack them.
    odds = (pa / (1 - np.minimum(pa, 0.999))) / (pb / (1 - np.minimum(pb, 0.999)))
    return (a + b >= least) & far & (np.abs(np.log(odds)) >= np.log(ratio))


class Adam:
    """Adam steps with soft-thresholding, for one weight vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray, l1: float = 0.0) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        scale = self.rate / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-6)
        w -= scale * self.m / (1 - 0.9 ** self.t)
        if l1:
            np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - self.rate * l1, 0.0))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def score_column(text: Column, weights: np.ndarray, fields: str, make) -> Column:
    """`make(dot products)` as a struct column; `weights` goes to the tasks with the function."""
    weights = weights.astype(np.float32)

    @F.pandas_udf(fields)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Featurizer(weights != 0)
        for b in batches:
            yield make(np.array([weights[x].sum(dtype=np.float64) for x in f.features_of(b)], dtype=np.float64))

    return score(F.coalesce(text, F.lit("")).cast("binary"))
