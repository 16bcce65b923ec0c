"""SimHash near-duplicates: fingerprints, Hamming-distance sharding by vantage points, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import TEXT_ROWS, releasing, ship, spare, staged
from quern.llm.components import components

BITS = 64
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The majority bit of the XXH64 of every shingle of width words; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *(end + 1 for end in ends)]
    count = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, count)
    return majority(hashes)


def fingerprints(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in batch], np.uint64).view(np.int64))

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "bigint")(text)


class VantageTree:
    """Parts values by their Hamming distance to vantage points.

    Two values at most `radius` apart share at least one leaf: at a node with threshold m the near
    side takes distances up to m + radius // 2 and the far side those from m + 1 - (radius + 1) // 2,
    so a pair that shares no side differs by more than radius in its distances, and by the triangle
    inequality in itself. The sample only shapes the tree; any tree gives all pairs.
    """

    def __init__(self, sample: np.ndarray, total: int, leaf: int, radius: int, seed: int = 7):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.random = np.random.default_rng(seed)
        self.root = self._grow(sample, total / max(1, len(sample)), leaf)

    def _sides(self, distance: np.ndarray, middle: int) -> tuple[np.ndarray, np.ndarray]:
        return distance <= middle + self.radius // 2, distance >= middle + 1 - (self.radius + 1) // 2

    def _grow(self, sample: np.ndarray, weight: float, leaf: int) -> int:
        best = None
        if len(sample) >= 16 and len(sample) * weight > leaf:
            for point in self.random.choice(sample, 3):
                distance = np.bitwise_count(sample ^ point)
                for middle in np.unique(np.quantile(distance, (0.4, 0.5, 0.6)).astype(int)):
                    near, far = self._sides(distance, int(middle))
                    most = max(near.sum(), far.sum())
                    if most <= 0.85 * len(sample) and (best is None or near.sum() + far.sum() < best[0]):
                        best = near.sum() + far.sum(), point, int(middle), near, far
        self.nodes.append(None)
        at = len(self.nodes) - 1
        if best is None:
            self.nodes[at] = self.leaves
            self.leaves += 1
        else:
            _, point, middle, near, far = best
            self.nodes[at] = point, middle, self._grow(sample[near], weight, leaf), self._grow(sample[far], weight, leaf)
        return at

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions in values) for each leaf that holds any of them."""
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            at, where = stack.pop()
            if not len(where):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                yield node, where
                continue
            point, middle, near, far = node
            inside, outside = self._sides(np.bitwise_count(values[where] ^ point), middle)
            stack += [(near, where[inside]), (far, where[outside])]


def links(points: np.ndarray, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all distinct points at most radius apart into their components: star edges
    of each block of a local vantage tree, never all pairs of a group."""
    tree = VantageTree(points if len(points) <= 4096 else np.random.default_rng(1).choice(points, 4096, False), len(points), block, radius)
    left, right = [], []
    for _, where in tree.route(points):
        left_block, right_block = _block_links(points[where], radius, block)
        left.append(where[left_block])
        right.append(where[right_block])
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _block_links(points: np.ndarray, radius: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all close pairs among points, by strips so that memory stays at block squared:
    of each two blocks a star for each set of points that their close pairs join."""
    left, right = [], []
    for a in range(0, len(points), block):
        for b in range(a, len(points), block):
            near = np.bitwise_count(points[a : a + block, None] ^ points[None, b : b + block]) <= radius
            if a == b:
                np.fill_diagonal(near, False)
            rows, columns = (np.nonzero(near.any(k))[0] for k in (1, 0))
            if not len(rows):
                continue
            near = near[np.ix_(rows, columns)]
            far = len(points)
            one, two = rows + a, columns + b
            while True:  # the least label spreads from one side to the other and back
                new_two = np.minimum(two, np.where(near, one[:, None], far).min(0))
                new_one = np.minimum(one, np.where(near, new_two[None, :], far).min(1))
                if (new_one == one).all() and (new_two == two).all():
                    break
                one, two = new_one, new_two
            left += [one, two]
            right += [rows + a, columns + b]
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    first, second = np.concatenate(left), np.concatenate(right)
    return first[first != second], second[first != second]


HALF = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


def near_links(nodes: DataFrame, radius: int = 3, leaf: int = 8192, sample: int = 20_000) -> DataFrame:
    """Edges (a, b) between rows of nodes (fp distinct, node) whose fingerprints differ in at most
    radius bits, enough of them to keep every component whole.

    Of two 64-bit values at most r apart, one 32-bit half is at most r // 2 apart. So each half gets
    a vantage tree of that radius, whose boundary bands are far narrower than those of a tree over
    all bits. Leaves that a sample can't split are joined inside by a tree over all 64 bits. The
    sample is a bounded number of fingerprints that shapes the trees and decides no result.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    rows = nodes.select("fp").sample(min(1.0, 1.2 * sample / max(1, total)), seed=11).limit(2 * sample).toPandas()["fp"] if total else []
    drawn = np.array(rows, dtype=np.int64).view(np.uint64)
    target = max(leaf, total // max(1, 4 * len(drawn)))
    trees = [VantageTree(half, total, target, radius // 2) for half in (drawn >> HALF, drawn & LOW)]
    shared = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for side, tree in enumerate(shared.value):
                for shard, where in tree.route(fps >> HALF if side == 0 else fps & LOW):
                    at = pa.array(where)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), 2 * shard + side)), batch.column("fp").take(at), batch.column("node").take(at)], names=["shard", "fp", "node"])

    def join(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        left, right = links(fps, radius)
        node = group.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(left)), "b": node.take(pa.array(right))})

    join.__annotations__ = {"group": pa.Table, "return": pa.Table}
    routed = nodes.mapInArrow(releasing(route), "shard long, fp long, node long")
    return routed.groupBy("shard").applyInArrow(join, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed), component_id of every row of documents, and `component`, a number of the
    component itself.

    component_id is the smallest doc_id reachable over links of at most radius differing bits, the
    row's own included. Texts without words, null ones too, have fingerprint 0 and link like any
    other. Repeated rows get the same result. A null doc_id takes part with its fingerprint but never
    names a component unless all of its component's ids are null.
    """
    ship(documents.sparkSession)
    marked = staged(documents.select("doc_id", fingerprints(F.col("text"), width).alias("fp"), *(c.alias(k) for k, c in row_keys().items())), "simhash-fingerprints", arrow_rows=TEXT_ROWS)
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    keyed = nodes.select("fp", F.col("fp").alias("node"))
    edges = near_links(keyed, radius)
    member = components(edges)
    resolved = nodes.join(member, nodes.fp == member.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = resolved.groupBy("component").agg(F.min("first").alias("component_id"))
    named = resolved.join(smallest, "component").select(F.col("fp").alias("node_fp"), "component", "component_id")
    return marked.join(named, marked.fp == named.node_fp).drop("node_fp")


def row_keys() -> dict[str, Column]:
    """96 bits that stand for a row's id and text."""
    return {"_key": F.xxhash64("doc_id", "text"), "_crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}


def digests(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """documents without all but one row of each component of found (near_duplicates of documents if
    it is not given): the one of the smallest doc_id (null after all others), and of rows that share
    it the one of the smallest hash of its text. Of rows equal in both one stays. Null texts are like
    empty ones; an empty table stays empty; input columns of any name are kept."""
    key, crc = spare(documents, "key", "crc")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_crc")
    found = near_duplicates(documents) if found is None else found
    leaders = found.groupBy("component").agg(F.min(order).alias("leader")).select(F.col("leader._key").alias(key), F.col("leader._crc").alias(crc))
    keyed = documents.withColumns(dict(zip((key, crc), row_keys().values(), strict=True)))
    return keyed.join(leaders, [key, crc], "left_semi").dropDuplicates([key, crc]).drop(key, crc)
