"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary (pieces with log scores, byte pieces) comes from a public model
file, read on the driver and sent to the tasks; its size is that of the file.
A text is marked (a leading and every inner space becomes the marker), and the
segmentation with the largest sum of scores is found by dynamic programming;
characters without a piece of their own fall back to byte pieces.

No piece crosses the start of a marker run or a line break, so the best
segmentation of a text is that of its chunks in a row.  Chunks repeat, and
each task remembers the segmentations of a bounded number of them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"               # the white-space marker
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0        # an unknown character scores this much below the worst piece
SLICE_ROWS = 1_000            # rows turned into ids at a time
MAX_CACHED_CHUNKS = 300_000   # per task; when full, it starts anew
MAX_VECTOR_BYTES = 48         # longer chunks are segmented one by one
VECTOR_ROWS = 20_000          # chunks of one length segmented at a time


class DoubleArray:
    """Static trie over bytes: child of state s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = array("i", [0]), array("i", [-1]), array("i", [-1])
        ordered = sorted(keys)
        self._grow(512)
        self.check[0] = 0
        self.free = 1                                    # no free slot lies below
        stack = [(0, 0, len(ordered), 0)]                # state, key range, depth
        while stack:
            state, lo, hi, depth = stack.pop()
            if lo < hi and len(ordered[lo]) == depth:
                self.value[state] = keys[ordered[lo]]
                lo += 1
            children, at = [], lo                        # (byte, first key, end)
            while at < hi:
                byte, start = ordered[at][depth], at
                while at < hi and ordered[at][depth] == byte:
                    at += 1
                children.append((byte, start, at))
            if children:
                base = self._place([c for c, _, _ in children])
                self.base[state] = base
                for byte, start, end in children:
                    self.check[base + byte] = state
                    stack.append((base + byte, start, end, depth + 1))

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)

    def _place(self, labels: list[int]) -> int:
        """The first base whose slots for all labels are free."""
        while self.check[self.free] != -1:
            self.free += 1
            self._grow(self.free + 512)
        slot, misses = self.free, 0
        while True:
            base = slot - labels[0]
            self._grow(slot + 512)
            if base > 0 and self.check[slot] == -1 and all(self.check[base + c] == -1 for c in labels):
                return base
            slot += 1
            misses += 1
            if misses == 2_000:                          # crowded: leave the gaps behind
                self.free = slot


class Vocabulary:
    """Pieces, scores and the trie; picklable, so that tasks can hold it."""

    def __init__(self, pieces: list[str], scores: list[float], normal: set[int],
                 byte_ids: dict[int, int], unknown_id: int = 0):
        self.scores, self.unknown_id = list(scores), unknown_id
        self.byte_ids = byte_ids                         # byte -> id; empty: no byte fallback
        self.unknown_score = min((scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray({pieces[i].encode(): i for i in normal if pieces[i]})
        self.surface = [p.replace(MARK, " ").encode() if i in normal else b""
                        for i, p in enumerate(pieces)]
        for byte, i in byte_ids.items():
            self.surface[i] = bytes([byte])
        crossing = re.compile(f"[^{MARK}]{MARK}|[^\\n]\\n|\\n[^\\n]", re.S)
        # Chunks start at marker runs and line breaks, if no piece crosses such a place.
        whole = any(crossing.search(pieces[i]) for i in normal)
        self.chunk = None if whole else re.compile(f"\\n+|{MARK}*[^{MARK}\\n]+|{MARK}+")

    @classmethod
    def load(cls, model_file: str) -> "Vocabulary":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        pieces = [sp.id_to_piece(i) for i in ids]
        return cls(pieces, [sp.get_score(i) for i in ids], set(ids) - special,
                   {int(pieces[i][3:-1], 16): i for i in ids if sp.is_byte(i)}, sp.unk_id())

    def segment(self, chunk: str) -> tuple[int, ...]:
        """Ids of the segmentation with the largest score; of equal ones, longer last pieces."""
        data = chunk.encode()
        n, scores = len(data), self.scores
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, back = [float("-inf")] * (n + 1), [(0, 0)] * (n + 1)
        best[0], i = 0.0, 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, j, single = best[i], 0, i, False
            while j < n:
                to = base[state] + data[j]
                if check[to] != state or to == 0:
                    break
                state, j = to, j + 1
                v = value[state]
                if v >= 0:
                    single = single or j == i + width
                    if here + scores[v] > best[j]:
                        best[j], back[j] = here + scores[v], (i, v)
            if not single and here + self.unknown_score > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown_score, (i, -1)
            i += width
        out, end = [], n
        while end:
            start, v = back[end]
            if v >= 0:
                out.append(v)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(data[start:end]))
            else:
                out.append(self.unknown_id)
            end = start
        return tuple(reversed(out))


class Codec:
    """Encodes and decodes texts, remembering the segmentations of frequent chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        trie = vocabulary.trie
        self.base, self.check, self.value = (np.asarray(a) for a in (trie.base, trie.check, trie.value))
        self.scores = np.asarray(vocabulary.scores, dtype=np.float64)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        chunked = [self._chunks(t) for t in texts]
        missing = set().union(*chunked) - self.known.keys()
        if len(self.known) + len(missing) > MAX_CACHED_CHUNKS:
            self.known.clear()
            missing = set().union(*chunked)
        self._learn(missing)
        out = [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in chunked]
        if len(self.known) > MAX_CACHED_CHUNKS:      # one slice may hold more than the bound
            self.known.clear()
        return out

    def _chunks(self, text: str) -> list[str]:
        """Marked chunks; a marker of the text itself becomes a chunk of NUL + marker."""
        if not text:
            return []
        if MARK not in text:
            marked = MARK + text.replace(" ", MARK)
            return self.v.chunk.findall(marked) if self.v.chunk else [marked]
        out = []
        for k, part in enumerate(text.split(MARK)):
            marked = (MARK if not k else "") + part.replace(" ", MARK)
            out += ["\0" + MARK] if k else []
            out += (self.v.chunk.findall(marked) if self.v.chunk else [marked]) if marked else []
        return out

    def _learn(self, chunks: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for c in chunks:
            if c == "\0" + MARK and self.v.byte_ids:
                self.known[c] = tuple(self.v.byte_ids[b] for b in MARK.encode())
                continue
            data = c.encode()
            if len(data) > MAX_VECTOR_BYTES:
                self.known[c] = self.v.segment(c)
            else:
                by_length.setdefault(len(data), []).append((c, data))
        for n, group in by_length.items():
            for start in range(0, len(group), VECTOR_ROWS):
                self._segment_group(group[start:start + VECTOR_ROWS], n)

    def _segment_group(self, group: list[tuple[str, bytes]], n: int) -> None:
        """`Vocabulary.segment` for many chunks of `n` bytes at once."""
        m = len(group)
        data = np.frombuffer(b"".join(d for _, d in group), dtype=np.uint8).reshape(m, n)
        best = np.full((n + 1, m), -np.inf)
        start, piece = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
        best[0] = 0.0
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).T
        for i in range(n):
            rows = np.flatnonzero(best[i] > -np.inf)
            single = np.zeros(m, bool)
            at, state = rows, np.zeros(len(rows), np.int32)
            for j in range(i, n):
                to = self.base[state] + data[at, j]
                ok = self.check[to] == state
                at, state = at[ok], to[ok]
                if not len(at):
                    break
                v = self.value[state]
                hit = v >= 0
                r, v = at[hit], v[hit]
                single[r[width[i, r] == j + 1 - i]] = True
                score = best[i, r] + self.scores[v]
                better = score > best[j + 1, r]
                r = r[better]
                best[j + 1, r], start[j + 1, r], piece[j + 1, r] = score[better], i, v[better]
            for r in rows[~single[rows]]:                # characters without a piece: rare
                end, score = i + width[i, r], best[i, r] + self.v.unknown_score
                if score > best[end, r]:
                    best[end, r], start[end, r], piece[end, r] = score, i, -1
        ids, used, every = np.zeros((m, n), np.int32), np.zeros(m, np.int64), np.arange(m)
        end, unknown = np.full(m, n), np.zeros(m, bool)
        while True:
            live = every[end > 0]
            if not len(live):
                break
            p = piece[end[live], live]
            unknown[live[p < 0]] = True
            used[live] += 1
            ids[live, n - used[live]] = p
            end[live] = start[end[live], live]
        for (chunk, _), row, k, odd in zip(group, ids.tolist(), used.tolist(), unknown.tolist()):
            self.known[chunk] = self.v.segment(chunk) if odd else tuple(row[n - k:])

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def decode_ids(ids: Column, model_file: str = MODEL_FILE) -> Column:
    """The text of an array of ids; null for null, '' for an empty array."""
    vocabulary = Vocabulary.load(model_file)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary)
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode(x) for x in batch], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, *, text: str = "text", keep=("doc_id",),
                     model_file: str = MODEL_FILE, verify: bool = True) -> DataFrame:
    """Token ids of every document: the `keep` columns, n_tokens, ids and round_trip.

    Text spaces survive exactly, and so does a marker character in the text (as
    byte pieces).  round_trip tells whether decoding the ids gives the text
    back; null without `verify`.  Defined cases: a null text has null ids, 0
    tokens and round_trip true; an empty text has no ids; a text without any
    space is one long chunk and takes time in proportion to its length.
    """
    vocabulary = Vocabulary.load(model_file)    # goes to the tasks with the function
    names = [f"_sp_k{i}" for i in range(len(keep))]
    src = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("_sp_text"))
    schema = T.StructType(src.schema.fields[:-1] + [
        T.StructField("_sp_n", T.LongType()), T.StructField("_sp_ids", T.ArrayType(T.IntegerType())),
        T.StructField("_sp_ok", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ids, offsets, counts, missing, exact = array("i"), [0], [], [], []
                texts = part.column(part.num_columns - 1).to_pylist()
                for t, got in zip(texts, codec.encode_many([t or "" for t in texts])):
                    ids.extend(got)
                    offsets.append(len(ids))
                    counts.append(len(got))
                    missing.append(t is None)
                    exact.append((not t or codec.decode(got) == t) if verify else None)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()),
                                                 mask=pa.array(missing, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    part.columns[:-1] + [pa.array(counts, pa.int64()), lists,
                                         pa.array(exact, pa.bool_())],
                    names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[out[n].alias(c) for n, c in zip(names, keep)], out["_sp_n"].alias("n_tokens"),
                      out["_sp_ids"].alias("ids"), out["_sp_ok"].alias("round_trip"))
