"""Merkle manifest of a dataset, with inclusion proofs from octopus multiproofs.

Every row is a leaf, the sha256 of its fields.  The leaves of a source, in
order, make a tree: every `fanout` consecutive nodes become one, level by level,
until one is left, the subroot.  The subroots, in order of the sources, make the
top tree, whose root names the whole dataset.

Text is hashed once; everything after that works on a narrow table in shared
storage.  Positions come from a range partitioning and one offset per partition,
so no task sees a whole source, and a level is one aggregate over groups of
`fanout` nodes.

Proofs are made by leaf partitions, blocks of `fanout ** block_levels`
consecutive leaves of a source.  A partition knows all its leaves; going up, a
known range of nodes lacks only the rest of its outermost runs.  These missing
coordinates, the minimal union for all leaves of the partition, are fetched in one
join.  The partition then derives the shared interior nodes once and expands the
proof of every leaf from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketmine.plans.runtime import materialize, maybe_broadcast, new_scratch

FANOUT = 16
BLOCK_LEVELS = 3           # leaf partitions of 16^3 leaves
TOP = -1                   # tree id of the top tree; sources have 0, 1, ...
NODE_BYTES = 160           # bound of a fetched node in memory: three numbers and a hex digest
OUT_ROWS = 512             # rows of one output batch, some 4 KB of proof each


def leaf_hash(*fields: Column) -> Column:
    """sha256 over the fields: each `-` if null, else its UTF-8 byte count, `:` and value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, cols: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """`df` in order of `cols`, written with (part, idx), and the offset of each part.

    A row's place in the whole order is its part's offset plus idx.  The offsets
    are one row per partition.
    """
    mid = F.monotonically_increasing_id()
    rows = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
            .withColumn("_mid", mid))
    rows = materialize(rows.select(*df.columns, F.shiftright("_mid", 33).cast("int").alias("part"),
                                   F.col("_mid").bitwiseAND((1 << 33) - 1).alias("idx")), folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    return rows, parts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))


@dataclass
class Manifest:
    leaves: DataFrame          # tree, n, pos, leaf and the kept columns
    nodes: list[DataFrame]     # by level: tree, size, idx, h
    top: list[DataFrame]       # the same of the top tree
    sources: DataFrame         # source, tree, n, subroot
    n_sources: int
    root: str | None
    fanout: int

    @property
    def depth(self) -> int:
        return len(self.nodes) - 1


def _levels(level: DataFrame, largest: int, fanout: int, folder: str) -> list[DataFrame]:
    """All levels above the given nodes (tree, size, idx, h); a tree ends when one node is left."""
    out = [level]
    while largest > 1:
        largest = -(-largest // fanout)
        run = F.sort_array(F.collect_list(F.struct("idx", "h")))       # `fanout` nodes at most
        up = (out[-1].filter("size > 1")
              .groupBy("tree", F.ceil(F.col("size") / fanout).alias("size"), F.floor(F.col("idx") / fanout).alias("up"))
              .agg(F.sha2(F.array_join(F.transform(run, lambda x: x["h"]), ""), 256).alias("h"))
              .select("tree", "size", F.col("up").alias("idx"), "h"))
        out.append(materialize(up, f"{folder}/level={len(out)}"))
    return out


def build(docs: DataFrame, *, source: str, order: str, leaf: Column, keep: dict[str, Column] | None = None,
          fanout: int = FANOUT) -> Manifest:
    """The manifest of `docs`: `leaf` is each row's leaf hash, `order` its order within the source.

    Defined cases: sources ascend by their UTF-8 bytes, null first; leaves ascend
    by `order`, null first, equal ones by their hash, so repeated rows stand side
    by side; a lone leaf is its source's subroot and a lone subroot the root; an
    empty table has no root.
    """
    spark = docs.sparkSession
    folder = new_scratch(spark, "merkle")
    keep = keep or {}
    taken = {"tree", "n", "pos", "block", "kind", "of", "level", "idx", "h", "leaf", "subroot", "root", "path"}
    if taken & set(keep):
        raise ValueError(f"names in use: {sorted(taken & set(keep))}")
    hashed = materialize(docs.select(
        F.col(source).alias("_mk_source"), F.col(order).alias("_mk_order"), leaf.alias("leaf"),
        *[c.alias(f"_mk_keep_{k}") for k, c in keep.items()]), f"{folder}/hashed")
    rows, offsets = numbered(hashed, ["_mk_source", "_mk_order", "leaf"], f"{folder}/ordered")
    # One row per part and source in it: where its leaves stand in the whole order.
    seg = (rows.groupBy("part", "_mk_source").agg(F.min("idx").alias("lo"), F.count(F.lit(1)).alias("c"))
           .join(offsets, "part"))
    seg = materialize(seg, f"{folder}/segments")
    sources, source_offsets = numbered(
        seg.groupBy("_mk_source").agg(F.min(F.col("offset") + F.col("lo")).alias("first"), F.sum("c").alias("n")),
        ["first"], f"{folder}/sources")
    sources = materialize(sources.join(source_offsets, "part").select(
        "_mk_source", "first", "n", (F.col("offset") + F.col("idx")).alias("tree")), f"{folder}/trees")
    stat = sources.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
                       F.coalesce(F.sum(F.octet_length("_mk_source")), F.lit(0)).alias("bytes")).first()
    n_segs = seg.count()
    where = seg.alias("s").join(sources.alias("t"), F.col("s._mk_source").eqNullSafe(F.col("t._mk_source"))).select(
        F.col("s.part").alias("_part"), F.col("s._mk_source").alias("_src"), "t.tree", "t.n",
        (F.col("s.offset") - F.col("t.first")).alias("_shift"))
    where = maybe_broadcast(where, n_segs * NODE_BYTES + int(stat["bytes"]) * (1 + n_segs // max(1, stat["trees"])))
    leaves = materialize(
        rows.join(where, (F.col("part") == F.col("_part")) & F.col("_mk_source").eqNullSafe(F.col("_src")))
        .select("tree", "n", (F.col("idx") + F.col("_shift")).alias("pos"), "leaf",
                *[F.col(f"_mk_keep_{k}").alias(k) for k in keep]), f"{folder}/leaves")
    first = leaves.select("tree", F.col("n").alias("size"), F.col("pos").alias("idx"), F.col("leaf").alias("h"))
    nodes = _levels(first, stat["largest"], fanout, folder)
    subroots = None
    for level in nodes:
        part = level.filter("size = 1").select("tree", F.col("h").alias("subroot"))
        subroots = part if subroots is None else subroots.unionByName(part)
    told = materialize(sources.join(subroots, "tree").select(
        F.col("_mk_source").alias("source"), "tree", "n", "subroot"), f"{folder}/subroots")
    top = _levels(told.select(F.lit(TOP).cast("long").alias("tree"), F.lit(stat["trees"]).alias("size"),
                              F.col("tree").alias("idx"), F.col("subroot").alias("h")),
                  stat["trees"], fanout, f"{folder}/top")
    last = top[-1].first()
    return Manifest(leaves, nodes, top, told, stat["trees"], last["h"] if last else None, fanout)


def missing(lo: int, hi: int, size: int, fanout: int) -> list[tuple[int, int, int]]:
    """(level, first, last) ranges that lack when nodes lo..hi of `size` are known, up to the root.

    Known nodes are one range at every level, so what their runs lack lies at its two ends.
    """
    out, level = [], 0
    while size > 1:
        left, right = lo // fanout * fanout, min(hi // fanout * fanout + fanout, size) - 1
        if left < lo:
            out.append((level, left, lo - 1))
        if hi < right:
            out.append((level, hi + 1, right))
        lo, hi, size, level = lo // fanout, hi // fanout, -(-size // fanout), level + 1
    return out


def _requests(blocks: DataFrame, n_sources: int, fanout: int, rows: int) -> DataFrame:
    """(tree, block, of, level, idx): the nodes each leaf partition has to fetch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = block * rows, min(n, (block + 1) * rows) - 1
                for of, ranges in ((tree, missing(lo, hi, n, fanout)),
                                   (TOP, missing(tree, tree, n_sources, fanout))):
                    out += [(tree, block, of, level, i) for level, a, b in ranges for i in range(a, b + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["tree", "block", "of", "level", "idx"])

    return blocks.mapInArrow(run, "tree long, block long, of long, level long, idx long")


class _Tree:
    """One partition's view of a tree: known nodes by level, and the run of each parent."""

    def __init__(self, lo: int, known: list[bytes], size: int, fetched: dict, fanout: int):
        self.lo, self.fanout, self.runs = [], fanout, []
        level = 0
        while size > 1:
            hi = lo + len(known) - 1
            left, right = lo // fanout * fanout, min(hi // fanout * fanout + fanout, size) - 1
            whole = ([fetched[level, i] for i in range(left, lo)] + known
                     + [fetched[level, i] for i in range(hi + 1, right + 1)])
            runs = [b"".join(whole[i:i + fanout]) for i in range(0, len(whole), fanout)]
            self.lo.append(left)
            self.runs.append(runs)
            known = [hashlib.sha256(r).hexdigest().encode() for r in runs]
            lo, size, level = left // fanout, -(-size // fanout), level + 1
        self.top = known[0]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings left and right of node `at` and of each of its ancestors below the root."""
        out = []
        for left, runs in zip(self.lo, self.runs):
            run, k = divmod(at - left, self.fanout)
            r = runs[run]
            out.append((r[:64 * k], r[64 * (k + 1):]))
            at //= self.fanout
        return out


def _strings(pieces: list[bytes]) -> pa.Array:
    ends = np.zeros(len(pieces) + 1, np.int32)
    np.cumsum([len(p) for p in pieces], out=ends[1:])
    return pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends), pa.py_buffer(b"".join(pieces)))


def proofs(manifest: Manifest, *, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The kept columns of every leaf with leaf, subroot, root and path.

    `path` lists, level by level from the leaf over the subroot to the root, the
    concatenated siblings (left, right) of the node; see `fold`.
    """
    fanout, rows = manifest.fanout, manifest.fanout ** block_levels
    block = F.floor(F.col("pos") / rows)
    keep = [c for c in manifest.leaves.columns if c not in ("tree", "n", "pos", "leaf")]
    blocks = manifest.sources.select("tree", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n") - 1) / rows))).alias("block"), "n")
    stored = None
    for level, table in [*list(enumerate(manifest.nodes))[block_levels:], *enumerate(manifest.top)]:
        part = table.select(F.col("tree").alias("of"), F.lit(level).cast("long").alias("level"), "idx", "h")
        stored = part if stored is None else stored.unionByName(part)
    n_stored = stored.count()
    fetched = _requests(blocks, manifest.n_sources, fanout, rows).join(
        maybe_broadcast(stored, n_stored * NODE_BYTES), ["of", "level", "idx"])
    # Fetched nodes stand before the leaves of their partition.
    blank = [F.lit(None).cast(manifest.leaves.schema[c].dataType).alias(c) for c in keep]
    nothing = F.lit(None).cast("long").alias("n")
    both = fetched.select("tree", "block", F.lit(0).alias("kind"), "of", "level", "idx", "h", nothing, *blank).unionByName(
        manifest.leaves.select("tree", block.alias("block"), F.lit(1).alias("kind"), F.col("tree").alias("of"),
                               F.lit(0).cast("long").alias("level"), F.col("pos").alias("idx"),
                               F.col("leaf").alias("h"), "n", *keep))
    # The partition key is hashed together, so blocks of one source spread over the tasks.
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")
    n_sources, root = manifest.n_sources, (manifest.root or "").encode()

    def expand(tree: int, part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(part).combine_chunks()
        kind = got.column("kind").to_numpy()
        cut = int(np.searchsorted(kind, 1))
        if cut == len(kind):
            return
        near, top = {}, {}
        told = got.slice(0, cut)
        for of, level, idx, h in zip(*(told.column(c).to_pylist() for c in ("of", "level", "idx", "h"))):
            (top if of == TOP else near)[level, idx] = h.encode()
        leaves = got.slice(cut)
        known = [h.encode() for h in leaves.column("h").to_pylist()]
        lo = leaves.column("idx")[0].as_py()
        local = _Tree(lo, known, leaves.column("n")[0].as_py(), near, fanout)
        above = _Tree(tree, [local.top], n_sources, top, fanout)
        if above.top != root:
            raise ValueError("the nodes fetched do not lead to the root")
        rest = above.path(tree)
        for at in range(0, len(known), OUT_ROWS):
            some = leaves.slice(at, OUT_ROWS)
            paths = [local.path(lo + i) + rest for i in range(at, at + some.num_rows)]
            ends = np.zeros(len(paths) + 1, np.int32)
            np.cumsum([len(p) for p in paths], out=ends[1:])
            sides = [_strings([step[s] for p in paths for step in p]) for s in (0, 1)]
            path = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(sides, ["left", "right"]))
            columns = {**{c: some.column(c).combine_chunks() for c in keep}, "leaf": some.column("h").combine_chunks(),
                       "subroot": pa.array([local.top.decode()] * some.num_rows),
                       "root": pa.array([root.decode()] * some.num_rows), "path": path}
            flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns.values()]
            yield pa.RecordBatch.from_arrays(flat, names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, blk = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (blk[1:] != blk[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(tree)]):
                here = (int(tree[a]), int(blk[a]))
                if here != key and part:
                    yield from expand(key[0], part)
                    part = []
                key = here
                part.append(batch.slice(a, b - a))
        if part:
            yield from expand(key[0], part)

    kept = "".join(f"`{c}` {manifest.leaves.schema[c].dataType.simpleString()}, " for c in keep)
    return both.mapInArrow(run, f"{kept}leaf string, subroot string, root string, "
                                "path array<struct<left:string,right:string>>")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)
