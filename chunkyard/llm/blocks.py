"""Texts stored in blocks of bounded size, and packed sorted keys that go between blocks and shards.

A block is a run of the rows that one task reads, so storing moves nothing. A
block's rows are numbered, so later passes name a row by its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .frames import pieces, raw, settled

BLOCK_BYTES = 16 << 20
#: What a row counts beside its text, so that blocks of empty texts are bounded too.
ROW_BYTES = 64
#: Blocks that the numbering leaves room for in one task.
BLOCKS_A_TASK = 1 << 20
SLICE = 1 << 20
SHARD_BYTES = 32 << 20
LEAST_SHARDS = 8


def stored(docs: DataFrame, block_bytes: int = BLOCK_BYTES, lower: bool = False) -> DataFrame:
    """docs with block, row and packed (the compressed text, null as empty) instead of text; stored in the shared folder."""
    names = [n for n in docs.columns if n != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * BLOCKS_A_TASK
        block, row, size = first, 0, 0
        packer = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in pieces(whole):
                blocks, rows, packed = [], [], []
                for text in raw(batch.column("text")):
                    cost = len(text) + ROW_BYTES
                    if size and size + cost > block_bytes:
                        block, row, size = block + 1, 0, 0
                    packed.append(packer.compress(text.lower() if lower else text))
                    blocks.append(block)
                    rows.append(row)
                    row, size = row + 1, size + cost
                arrays = [*(batch.column(n) for n in names), pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "block", "row", "packed"])

    schema = StructType([*(docs.schema[n] for n in names), StructField("block", LongType()), StructField("row", IntegerType()), StructField("packed", BinaryType())])
    return settled(docs.mapInArrow(pack, schema))


def by_block(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[pa.Table]:
    """The rows of each block (or other key), from stored rows in their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        block = batch.column(key).to_numpy()
        for end in [*(np.flatnonzero(block[1:] != block[:-1]) + 1), batch.num_rows]:
            if held and held[0].column(key)[0] != batch.column(key)[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            start = int(end)
    if held:
        yield pa.Table.from_batches(held)


def texts_of(packed: pa.Array | pa.ChunkedArray, size_of_run: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) for runs of rows of about so many bytes of text."""
    unpacker, run, start, size = zstandard.ZstdDecompressor(), [], 0, 0
    for i, p in enumerate(packed.to_pylist()):
        text = unpacker.decompress(p)
        if run and size + len(text) > size_of_run:
            yield start, run
            run, start, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length, bytes of one place together, compressed. Sorted ones are better given as differences."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(planes))


def unsqueeze(blob: bytes, *kinds: type) -> list[np.ndarray]:
    b = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(b[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        plane = np.frombuffer(b, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned keys; `np.cumsum` gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def shard_count(n_bytes: int) -> int:
    """Shards for the keys of so many bytes of text; a few at least, so that small inputs are shared out too."""
    return max(LEAST_SHARDS, math.ceil(n_bytes / SHARD_BYTES))


def shard_bounds(shards: int) -> np.ndarray:
    """The least hash of each shard but the first; for searchsorted."""
    return np.array([s * (1 << 64) // shards for s in range(1, shards)], np.uint64)
