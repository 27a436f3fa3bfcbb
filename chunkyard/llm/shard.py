"""K-d tree sharding by bytes.

A unit is all rows with one text, so equal texts share a shard; its weight is
their bytes. Nodes are split along the metadata dimension in which they are
widest, at the weighted quantile that gives each side its part of the shards,
until every leaf is one shard of about the same bytes. All nodes of a level are
split by the same few jobs: one for their widths and one for each narrowing of
the quantiles by a histogram, whose size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import lean, settled, table

SHARDS = 24
#: Bytes that each row takes beside its text.
OVERHEAD = 8
BINS = 4096
SCALE = (1 << 30) - 1
#: Each dimension's place in 30 bits, then 32 bits of the text's hash, so that ties can be cut anywhere.
TIES = 1 << 32


@dataclass
class Node:
    """`shards` leaves below, the first numbered `first`; after the split: dimension and the smallest key that goes right."""

    first: int
    shards: int
    dimension: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _leaf(node: Node | None) -> Column:
    """The number of the leaf, or of the node that is not split yet, by its first shard."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(node.dimension) < F.lit(node.cut), _leaf(node.left)).otherwise(_leaf(node.right))


def _cuts(units: DataFrame, root: Node, nodes: list[Node], dimensions: list[str]) -> None:
    """Splits the nodes of one level."""
    at = units.withColumn("node", _leaf(root)).where(F.col("node").isin([n.first for n in nodes]))
    edges = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max))]
    span = {r["node"]: r for r in at.groupBy("node").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *edges).collect()}
    lows, highs, below, want = {}, {}, {}, {}
    for n in nodes:
        if (s := span.get(n.first)) is None:  # nothing here: any cut will do
            n.dimension, n.cut = dimensions[0], 0
            continue
        n.dimension = max(dimensions, key=lambda d: s[f"high_{d}"] // TIES - s[f"low_{d}"] // TIES)
        lows[n.first], highs[n.first] = s[f"low_{n.dimension}"], s[f"high_{n.dimension}"]
        below[n.first], want[n.first] = 0, s["weight"] * (n.shards // 2) / n.shards
    by_first = {n.first: n for n in nodes}
    while lows:
        cases_key, cases_bin = None, None
        steps = {k: (highs[k] - lows[k]) // BINS + 1 for k in lows}
        for k in lows:
            here = F.col("node") == k
            key = F.col(by_first[k].dimension)
            inside = key.between(F.lit(lows[k]), F.lit(highs[k]))
            bin_ = F.floor((key - F.lit(lows[k])) / F.lit(steps[k])) if steps[k] == 1 else F.expr(f"({by_first[k].dimension} - {lows[k]}L) div {steps[k]}L")
            cases_bin = F.when(here & inside, bin_) if cases_bin is None else cases_bin.when(here & inside, bin_)
        counted = at.select("node", "weight", cases_bin.alias("bin")).where("bin is not null").groupBy("node", "bin").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
        for k in list(lows):
            total, cut = below[k], None
            for r in sorted((r for r in counted if r["node"] == k), key=lambda r: r["bin"]):
                if total + r["weight"] >= want[k]:
                    cut = r
                    break
                total += r["weight"]
            begin = lows[k] + cut["bin"] * steps[k]
            if cut["n"] == 1 or steps[k] == 1:  # one unit, or units that nothing tells apart
                nearer = want[k] - total < total + cut["weight"] - want[k]
                by_first[k].cut = begin if nearer else begin + steps[k]
                del lows[k]
            else:
                below[k], lows[k], highs[k] = total, begin, min(highs[k], begin + steps[k] - 1)
    for n in nodes:
        half = n.shards // 2
        n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)


def plan(units: DataFrame, dimensions: list[str], shards: int) -> Node:
    """The tree over units with a `weight` and integer keys named by `dimensions`."""
    root = Node(0, shards)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        _cuts(units, root, level, dimensions)
        level = [x for n in level for x in (n.left, n.right)]
    return root


def _scaled(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Keys for the tree: the place of each dimension between its least and its largest value, then bits of the hash."""
    edges = rows.agg(*(f(d).cast("double").alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max)))).first()
    keys = []
    for d in dimensions:
        low, high = edges[f"low_{d}"] or 0.0, edges[f"high_{d}"] or 0.0
        place = F.floor((F.coalesce(F.col(d).cast("double"), F.lit(low)) - F.lit(low)) * F.lit(SCALE / max(high - low, 1e-9)))
        keys.append((F.least(F.greatest(place, F.lit(0)), F.lit(SCALE)) * TIES + F.col("text_hash").bitwiseAND(TIES - 1)).cast("long").alias(d))
    return rows.select("text_hash", "text_crc32", "size", "weight", *keys)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    size is the text's UTF-8 bytes (null: none) plus 8. Shards have nearly
    equal sums of size; rows with equal texts share a shard (null counts as
    empty), so a group of copies larger than a shard makes its shard as large
    as itself. Slots number a shard's rows from 0 without gaps. Metadata that
    is null counts as the least value; other columns are ignored. Fewer texts
    than shards leave some shards empty; no rows give no rows.
    """
    given = lean(docs, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    word = lambda c: F.coalesce(F.ascii(c) * 256 + F.ascii(F.substring(F.reverse(c), 1, 1)), F.lit(0))
    rows = settled(
        given.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            F.col("n_chars").cast("long").alias("n_chars"),
            word(F.col("source")).alias("source"),
            word(F.col("lang")).alias("lang"),
        )
    )
    dimensions = ["doc_id", "n_chars", "source", "lang"]
    units = rows.groupBy("text_hash", "text_crc32", "size").agg(F.sum("size").alias("weight"), *(F.min(F.col(d).cast("long")).alias(d) for d in dimensions))
    units = settled(_scaled(settled(units), dimensions))
    root = plan(units, dimensions, shards)
    placed = units.select("text_hash", "text_crc32", "size", _leaf(root).cast("int").alias("shard"))
    return numbered(settled(rows.join(placed, ["text_hash", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "shard")), shards)


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Adds slot to stored rows: a count of rows for each partition and shard gives every partition its first slots."""
    counts = rows.groupBy(F.spark_partition_id().alias("part"), "shard").count().collect()
    table_ = np.zeros((1 + max((r["part"] for r in counts), default=0), shards), np.int64)
    for r in counts:
        table_[r["part"], r["shard"]] = r["count"]
    starts = rows.sparkSession.sparkContext.broadcast(np.cumsum(table_, axis=0) - table_)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = None
        for batch in batches:
            if following is None:
                following = starts.value[TaskContext.get().partitionId()].copy()
            shard = batch.column("shard").to_numpy()
            slot = np.empty(len(shard), np.int64)
            for k in np.unique(shard):
                here = np.flatnonzero(shard == k)
                slot[here] = following[k] + np.arange(len(here))
                following[k] += len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(number, f"{fields}, slot long")


def op7_shard(spark, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
