"""Line deduplication across documents, as keep bitmaps.

Line keys are hashed to 128 bits and range-partitioned by (hash, document) with
documents in falling order, so a key of any number of rows spreads over as many
partitions as its rows fill. A row has a document's line numbers of a key, in
order, so documents and positions are the secondary sort. Each sorted partition
is streamed, a batch at a time: the first document of a key is the one that
keeps its lines. Only the rows of a key's first documents wait, until there are
enough of them to tell. Runs that cross a partition edge are settled from a
summary of a few numbers per partition. What comes back is a compressed bitmap
per document, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import block_count, free, lean, map_batches, raw, settled, table, text_bytes

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Stands for a null id; sorts below all others.
NO_ID = -(1 << 63)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo, doc_id, row_hash, lines: a row for each key of each document, with its line numbers."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        hi, lo, doc, row, lines = [], [], [], [], []
        for d, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist(), raw(batch.column("text")), strict=True):
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.lower().split(b"\n")):
                if len(line) >= min_chars:
                    found.setdefault(line.strip(BLANK), []).append(i)
            for key, at in found.items():
                if _long_enough(key, min_chars):
                    digest = xxhash.xxh3_128_digest(key)
                    hi.append(int.from_bytes(digest[:8], "little", signed=True))
                    lo.append(int.from_bytes(digest[8:], "little", signed=True))
                    doc.append(d)
                    row.append(h)
                    lines.append(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(lines, pa.list_(pa.int32()))],
            names=["hi", "lo", "doc_id", "row_hash", "lines"],
        )

    return map_batches(docs, keys, "hi long, lo long, doc_id long, row_hash long, lines array<int>")


def _runs(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each key, number of the key of each row, and whether a row is the first of its document with an id."""
    new_key = np.ones(len(hi), bool)
    new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return np.flatnonzero(new_key), np.cumsum(new_key) - 1, new_doc & (doc != NO_ID)


#: Bounds of one key in a partition: documents with an id, the largest and the smallest id.
Run = tuple[tuple[int, int], int, int, int]


def _key_columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in ("hi", "lo", "doc_id")]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition: documents, the largest and the smallest id. Batches are only looked through."""
    first: Run | None = None
    last: Run | None = None
    more = False
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = _key_columns(batch)
        starts, _, first_of_doc = _runs(hi, lo, doc)
        ends = np.append(starts[1:], len(hi))
        for k in sorted({0, len(starts) - 1}):
            a, b = starts[k], ends[k]
            run = ((int(hi[a]), int(lo[a])), int(first_of_doc[a:b].sum()), int(doc[a]), int(doc[b - 1]))
            if last is not None and last[0] == run[0]:  # goes on from the batch before
                again = run[2] == last[3] and run[2] != NO_ID
                last = (run[0], last[1] + run[1] - again, last[2], run[3])
            else:
                more, last = last is not None, run
            if first is None or first[0] == last[0]:
                first = last
    if first is None or last is None:
        return
    at = TaskContext.get().partitionId()
    rows = [(at, True, not more, *first[0], *first[1:])] + ([(at, False, True, *last[0], *last[1:])] if more else [])
    names = ["at", "is_first", "is_last", "hi", "lo", "n", "top", "bottom"]
    kinds = [pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _across(edges: list) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Documents and largest id of each key at a partition's edge, over all partitions that hold it."""
    total: dict[tuple[int, int], list[int]] = {}
    for e in sorted(edges, key=lambda e: (e["at"], not e["is_first"])):
        key = (e["hi"], e["lo"])
        if key not in total:
            total[key] = [e["n"], e["top"], e["bottom"]]
        else:
            same = e["top"] == total[key][2] and e["top"] != NO_ID
            total[key][0] += e["n"] - same
            total[key][2] = e["bottom"]
    return {(e["at"], *k): (total[k][0], total[k][1]) for e in edges for k in [(e["hi"], e["lo"])]}


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row_hash, lines: line numbers that go, in one or more rows for a document."""
    spark = docs.sparkSession
    parts = block_count(spark, text_bytes(docs), 128 << 20)
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc(), F.col("row_hash")]
    keys = settled(line_keys(docs, min_chars))  # ranging samples its input, which is not to be made twice
    ranged = settled(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    known = spark.sparkContext.broadcast(
        _across(ranged.select("hi", "lo", "doc_id").mapInArrow(_edges, "at int, is_first boolean, is_last boolean, hi long, lo long, n long, top long, bottom long").collect())
    )  # at most two rows a partition

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        waiting: pa.Table | None = None  # rows of a key of which too few documents were seen to tell
        told: tuple[tuple[int, int], int] | None = None  # a key that goes on, whose lines go but in one document

        def verdict(rows: pa.Table, is_end: bool) -> tuple[pa.Table, pa.Table | None, tuple[tuple[int, int], int] | None]:
            hi, lo, doc = _key_columns(rows)
            starts, of, first_of_doc = _runs(hi, lo, doc)
            n, top = np.add.reduceat(first_of_doc.astype(np.int64), starts), doc[starts].copy()
            if told is not None and told[0] == (int(hi[0]), int(lo[0])):
                n[0], top[0] = min_documents, told[1]
            for k in {0, len(starts) - 1}:
                if (across := known.value.get((at, int(hi[starts[k]]), int(lo[starts[k]])))) is not None:
                    n[k], top[k] = across
            end, rest = len(hi), None
            last = ((int(hi[-1]), int(lo[-1])), int(top[-1]))
            if not is_end and n[-1] < min_documents and (at, *last[0]) not in known.value:
                end = int(starts[-1])
                # Of rows that repeat a document's id and text, one tells as much as all.
                new = np.ones(len(hi) - end, bool)
                row = rows.column("row_hash").to_numpy()[end:]
                new[1:] = (doc[end + 1 :] != doc[end:-1]) | (row[1:] != row[:-1])
                rest = rows.slice(end).filter(pa.array(new))
            gone = (n[of] >= min_documents) & (doc != top[of])
            out = rows.slice(0, end).select(["doc_id", "row_hash", "lines"]).filter(pa.array(gone[:end]))
            return out, rest, last if rest is None and n[-1] >= min_documents else None

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = (rows if waiting is None else pa.concat_tables([waiting, rows])).combine_chunks()
                out, waiting, told = verdict(rows, False)
                yield from out.to_batches()
        if waiting is not None:
            yield from verdict(waiting.combine_chunks(), True)[0].to_batches()

    return ranged.mapInArrow(drop, "doc_id long, row_hash long, lines array<int>")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least long), row_hash and text; the first two say which row a bitmap is for."""
    return lean(docs, doc_id="doc_id", text="text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row_hash, keep: a zlib-compressed bitmap (bit i: line i stays) for documents that lose a line.

    Bits end with the byte of the last line that goes; lines after them, and documents
    without a row, keep everything. Rows that share doc_id are one document;
    rows with a null doc_id lose what others have but never count as holders
    nor keep a shared line. Repeated rows get the same bitmap. Null or empty
    texts have one empty line, which is too short to go. No rows give no rows.
    """

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for lines in batch.column("lines").to_numpy(zero_copy_only=False):
            bits = np.ones(int(lines.max()) // 8 * 8 + 8, bool)  # whole bytes: what pads the bitmap stays
            bits[lines] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(keep, pa.binary())], names=["doc_id", "row_hash", "keep"])

    gone = dropped_lines(_named(docs), min_chars, min_documents).groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_set("lines")).alias("lines"))
    return map_batches(gone, pack, "doc_id long, row_hash long, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines, lines that go, and the text that stays."""
    n = text.count(b"\n") + 1
    if keep is None:
        return n, 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
    lines = text.split(b"\n")
    out = [line for line, bit in zip(lines, bits.tolist(), strict=False) if bit] + lines[len(bits) :]
    return n, n - len(out), b"\n".join(out)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "keep") -> DataFrame:
    """Each row of docs with its bitmap, as `name`, or null; the other columns stay as they are."""
    names = docs.columns
    doc, row = free("b_doc", *names, name), free("b_row", *names, name)
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"])]
    b = bitmaps.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(row), F.col("keep").alias(name))
    return docs.join(b, (key[0] == b[doc]) & (key[1] == b[row]), "left").drop(doc, row)


def keep_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines that stay; columns, their order and the number of rows are as before.

    Null texts stay null, empty ones empty; see `keep_bitmaps` for null ids and repeated rows.
    """
    names = docs.columns
    bitmap = free("keep", *names)
    kept = with_bitmaps(docs, keep_bitmaps(docs, **options), bitmap)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, keep = batch.column("text"), batch.column(bitmap)
        if keep.null_count < len(keep):
            out = [t if k is None else apply_bitmap(t, k)[2] for t, k in zip(text.cast(pa.binary()).to_pylist(), keep.to_pylist(), strict=True)]
            text = pa.array(out, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names=names)

    return map_batches(kept.select(*(F.col(f"`{n}`") for n in [*names, bitmap])), cut, docs.select(*(docs[f"`{n}`"] for n in names)).schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = lean(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [apply_bitmap(t, k) for t, k in zip(raw(batch.column("text")), batch.column("keep").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    return map_batches(with_bitmaps(docs, keep_bitmaps(docs)), digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP4_SQL = f"""
WITH given AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, r, i, l[i] AS line FROM (SELECT doc_id, r, l, unnest(range(1, len(l) + 1)) AS i FROM given)),
keyed AS (SELECT *, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
