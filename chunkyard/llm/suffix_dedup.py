"""Removal of long repeated byte strings, by a sparse suffix array over all texts.

Suffixes begin at anchors: in each window of WINDOW bytes, the KEY-byte string
with the least hash (the last of equals). Equal windows have their anchor at
the same place, so windows that are equal have suffixes that meet; and anchors
lie some 85 bytes apart. An anchor's record is what its windows cover: the
bytes from it to the end of its last window, and those before it.

1. Prefix detection: only hashes of keys are exchanged, packed with counts, to
   find the keys that are there once and need no more.
2. All other records are sorted in their blocks, front-coded and exchanged as
   runs, dealt by key. Equal records of a block, compared byte by byte, are one
   entry with a multiplicity. A loser tree that never compares a known common
   prefix again merges a shard's runs.
3. The merged order's common prefixes say which records agree to the right, for
   every length; with a running hash of the bytes to the left, each window that
   is found at two anchors is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, shard_bounds, shard_count, squeeze, steps, stored, texts_of, unsqueeze
from .frames import block_count, lean, partitions, settled, table, text_bytes, unsized
from .suffix_merge import decode_run, front_code, merge
from .words import byte_values, mix

WINDOW = 200
KEY = 32
#: Key starts in a window, less one.
REACH = WINDOW - KEY
TILE = 1 << 18
#: Bits of a place inside a tile.
PLACE = np.uint64((1 << 24) - 1)
MERGE, HOT = 1, 2
#: Entries of one key that are merged together; those of keys with more are split by longer strings first.
MOST = 4096
PLACES = (np.int32, np.int64, np.uint8, np.uint8, np.dtype(f"V{REACH}"))


def _tiles(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Tiles in which every window of every text is once: bytes; length, row and place in the text of each part."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), 4 * TILE):
            part = text[at : at + 4 * TILE + WINDOW - 1]
            if parts and size + len(part) > TILE:
                yield _tile(parts)
                parts, size = [], 0
            parts.append((part, row, at))
            size += len(part)
    if parts:
        yield _tile(parts)


def _tile(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(p) for p, _, _ in parts])
    return np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8), lengths, np.array([r for _, r, _ in parts]), np.array([a for _, _, a in parts])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """row, anchor, first and last start of its windows (int64 each), hash of its key (uint64)."""
    found: list[tuple[np.ndarray, ...]] = []
    for data, lengths, rows, places in _tiles(texts):
        h = byte_values()[data]
        factor, width = 0x9E3779B97F4A7C15, 1
        while width < KEY:  # h[i]: of the bytes i to i + width
            h = h[: len(h) - width] * np.uint64(factor) + h[width:]
            factor, width = factor * factor % (1 << 64), 2 * width
        h = mix(h)
        least = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        ends = np.cumsum(lengths)
        starts = ends - lengths
        of = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
        inside = np.arange(len(least)) + WINDOW <= ends[of]
        window = np.flatnonzero(inside)
        chosen = (PLACE - (least[window] & PLACE)).astype(np.int64)
        first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)))
        last = np.append(first[1:], len(window)) - 1
        part = of[window[first]]
        shift = places[part] - starts[part]
        found.append((rows[part], chosen[first] + shift, window[first] + shift, window[last] + shift, mix(h[chosen[first]])))  # mixed again: least hashes are small, and shards are dealt by size
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def record_hashes(texts: list[bytes], row: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each anchor's record and of the anchor's place in it."""
    spans = zip(row.tolist(), first.tolist(), last.tolist(), (anchor - first).tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(texts[r][a : b + WINDOW], k) for r, a, b, k in spans), np.uint64, len(row))


def _block_anchors(packed: pa.ChunkedArray) -> tuple[list[bytes], tuple[np.ndarray, ...], np.ndarray]:
    texts = [t for _, run in texts_of(packed) for t in run]
    found = anchors(texts)
    return texts, found, record_hashes(texts, *found[:4])


def _pairs(key: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, record), and in it the first of each pair and the number of the pair of each."""
    order = np.lexsort((record, key))
    k, r = key[order], record[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _replies(texts: DataFrame, shards: int, most: int) -> DataFrame:
    """block, shard, flags: for a block's distinct keys of a shard, in order, MERGE if the key is there twice and HOT if it has many entries."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches):
            _, (*_, key), record = _block_anchors(block.column("packed"))
            order, first, _ = _pairs(key, record)
            k, starts, n = np.unique(key[order], return_index=True, return_counts=True)
            entries = np.diff(np.append(np.searchsorted(first, starts), len(first)))
            bounds = [0, *np.searchsorted(k, shard_bounds(shards)).tolist(), len(k)]
            used = [s for s in range(shards) if bounds[s + 1] > bounds[s]]
            blobs = [squeeze(steps(k[a:b]), np.minimum(n[a:b], 255).astype(np.uint8), entries[a:b].astype(np.uint32)) for s in used for a, b in [(bounds[s], bounds[s + 1])]]
            yield pa.RecordBatch.from_arrays([pa.array([block.column("block")[0].as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "blob"])

    def answer(rows: pa.Table) -> pa.Table:
        given = [unsqueeze(b, np.uint64, np.uint8, np.uint32) for b in rows.column("blob").to_pylist()]
        key, n, entries = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in given]), *(np.concatenate([g[i] for g in given]) for i in (1, 2))
        _, of = np.unique(key, return_inverse=True)
        flags = (MERGE * (np.bincount(of, n) >= 2) + HOT * (np.bincount(of, entries) > most)).astype(np.uint8)[of]
        bounds = np.cumsum([0, *(len(k) for k, _, _ in given)])
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "flags": pa.array([squeeze(flags[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())})

    blobs = texts.select("block", "packed").mapInArrow(send, "block long, shard int, blob binary")
    return blobs.repartition(max(shards, partitions(texts.sparkSession)), "shard").groupBy("shard").applyInArrow(answer, "block long, shard int, flags binary")


def _entries(bodies: list[bytes], row: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of anchors in order of (key, record): those that stand for equal records, with how many they stand for (2 for more), and (the one that stands, the other) of the rest."""
    stands = order[first]
    is_first = np.zeros(len(order), bool)
    is_first[first] = True
    other = order[~is_first]
    by = stands[of[~is_first]]
    same = np.ones(len(other), bool)
    for i, (x, y) in enumerate(zip(by.tolist(), other.tolist(), strict=True)):
        same[i] = bodies[row[x]][low[x] : high[x] + WINDOW] == bodies[row[y]][low[y] : high[y] + WINDOW] and anchor[x] - low[x] == anchor[y] - low[y]
    alone = other[~same]  # another record with the same hash
    counts = np.concatenate([1 + np.bincount(of[~is_first][same], minlength=len(stands)), np.ones(len(alone), np.int64)])
    return np.concatenate([stands, alone]), np.minimum(counts, 2).astype(np.uint8), by[same], other[same]


def _candidates(texts: DataFrame, replies: DataFrame, shards: int, parts: int) -> DataFrame:
    """block, shard, run, places: by shard a front-coded run of records and where they are; shard -1: where equal records are; -2: records of hot keys."""

    def pick(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, out_shard, out_run, out_place = [], [], [], []
        if block.num_rows and answers.num_rows:
            block = block.sort_by("row")
            block_id = block.column("block")[0].as_py()
            bodies, (row, anchor, low, high, key), record = _block_anchors(block.column("packed"))
            order, first, of = _pairs(key, record)
            sent, mult, by, other = _entries(bodies, row, anchor, low, high, order, first, of)
            flags = np.concatenate([unsqueeze(b, np.uint8)[0] for b in answers.sort_by("shard").column("flags").to_pylist()])[np.unique(key, return_inverse=True)[1]]
            out_shard.append(-1)
            out_run.append(None)
            out_place.append(squeeze(row[by].astype(np.int32), anchor[by].astype(np.int64), row[other].astype(np.int32), anchor[other].astype(np.int64)))
            wanted = flags[sent] & MERGE > 0
            sent, mult = sent[wanted], mult[wanted]
            shard = np.searchsorted(shard_bounds(shards), key[sent], side="right")
            shard[flags[sent] & HOT > 0] = -2
            for s in np.unique(shard):
                here, times = sent[shard == s], mult[shard == s]
                strings = []
                for i, (r, a, b, e) in enumerate(zip(row[here].tolist(), anchor[here].tolist(), low[here].tolist(), high[here].tolist(), strict=True)):
                    text = bodies[r]
                    strings.append((text[a : e + WINDOW], text[b:a], i))
                strings.sort()
                i = np.array([x[2] for x in strings])
                j, times = here[i], times[i]
                out_shard.append(int(s))
                out_run.append(front_code([x[0] for x in strings]))  # of hot keys too, for what it saves
                left = b"".join(x[1][::-1].ljust(REACH, b"\0") for x in strings)
                out_place.append(squeeze(row[j].astype(np.int32), anchor[j].astype(np.int64), (anchor[j] - low[j]).astype(np.uint8), times, np.frombuffer(left, f"V{REACH}")))
            ids = [block_id] * len(out_shard)
        return pa.table({"block": pa.array(ids, pa.int64()), "shard": pa.array(out_shard, pa.int32()), "run": pa.array(out_run, pa.binary()), "places": pa.array(out_place, pa.binary())})

    own, answered = texts.select("block", "row", "packed").repartition(parts, "block"), replies.repartition(parts, "block")
    return own.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(pick, "block long, shard int, run binary, places binary")


def repeats(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, n_left: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """[records, REACH + 1]: whether the window that begins i bytes before the anchor is found at two records.

    lcp: of each record's right string with the one before, in sorted order;
    right: lengths of the right strings; left: bytes before the anchors, the
    nearest first; n_left: how many of them a record has; mult: how many equal
    records each stands for.
    """
    out = np.zeros((len(lcp), REACH + 1), bool)
    behind = np.zeros(len(lcp), np.uint64)
    for i in range(REACH + 1):
        if i:
            behind = behind * np.uint64(0x9E3779B97F4A7C15) + byte_values()[left[:, i - 1]]
        has = np.flatnonzero((right >= WINDOW - i) & (n_left >= i))
        agree = np.cumsum(lcp < WINDOW - i).astype(np.uint64)
        _, of = np.unique(mix(behind[has] ^ mix(agree[has])), return_inverse=True)
        out[has, i] = np.bincount(of, mult[has])[of] > 1
    return out


def _merged(rows: pa.Table) -> pa.Table:
    """block and spans (row, start, end) from the runs of one shard."""
    rows = rows.sort_by("block")
    places = [unsqueeze(b, *PLACES) for b in rows.column("places").to_pylist()]
    run, lcp, right = [], [], []
    for r, s, n in merge([decode_run(b) for b in rows.column("run").to_pylist()]):
        run.append(r)
        lcp.append(n)
        right.append(len(s))
    run = np.array(run)
    begins = np.cumsum([0, *(len(p[0]) for p in places)])
    order = np.argsort(run, kind="stable")  # a run's records, in its order, are its places
    at = np.empty(len(run), np.int64)
    at[order] = np.arange(len(run))
    row, anchor, n_left, mult, left = (np.concatenate([p[i] for p in places])[at] for i in range(5))
    found = repeats(np.array(lcp), np.array(right), left.view(np.uint8).reshape(-1, REACH), n_left, mult)
    # A run of places i1 to i2 before the anchor covers the bytes from anchor - i2 to anchor - i1 + WINDOW.
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    who, i1 = np.nonzero(edge == 1)
    i2 = np.nonzero(edge == -1)[1] - 1
    start, end, where = anchor[who] - i2, anchor[who] - i1 + WINDOW, np.searchsorted(begins, at[who], side="right") - 1
    blocks, blobs = rows.column("block").to_pylist(), []
    used = np.unique(where)
    for b in used:
        here = where == b
        blobs.append(squeeze(row[who][here], anchor[who][here], start[here], end[here]))
    return pa.table({"block": pa.array([blocks[b] for b in used], pa.int64()), "places": pa.array(blobs, pa.binary())})


def _hot_records(picked: DataFrame) -> DataFrame:
    """block, row, anchor, least, most (its windows begin so many bytes before the anchor), left (the nearest byte first), right, mult."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, run, places in zip(batch.column("block").to_pylist(), batch.column("run").to_pylist(), batch.column("places").to_pylist(), strict=True):
                row, anchor, n_left, mult, left = unsqueeze(places, *PLACES)
                right = [s for s, _ in decode_run(run)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(row), pa.int64()),
                        pa.array(row),
                        pa.array(anchor),
                        pa.array([WINDOW - len(r) for r in right], pa.int32()),
                        pa.array(n_left.astype(np.int32)),
                        pa.array([x.tobytes()[:n] for x, n in zip(left, n_left.tolist(), strict=True)], pa.binary()),
                        pa.array(right, pa.binary()),
                        pa.array(mult.astype(np.int32)),
                    ],
                    names=["block", "row", "anchor", "least", "most", "left", "right", "mult"],
                )

    return picked.where("shard = -2").select("block", "run", "places").mapInArrow(spread, "block long, row int, anchor long, least int, most int, left binary, right binary, mult int")


def hot_spans(records: DataFrame) -> DataFrame:
    """block, row, anchor, start, end: repeats among the records of hot keys, by halving their ranges of windows.

    Ranges are the same for all records: 0 to REACH, its halves, their halves.
    All windows of a range share its core, and a record's hull holds those that
    it has. A hull that is there twice is a repeat as a whole; a core with one
    hull has no other; what is left is halved. Groups are only ever counted,
    with partial sums, so no group meets in one task, and after eight rounds
    every range is one window. Strings are told apart by two 64-bit hashes.
    """
    columns = ["block", "row", "anchor", "least", "most", "left", "right", "mult", "asks"]
    spans, now = [], settled(records.withColumn("asks", F.lit(True)).select(*columns, F.lit(0).alias("low"), F.lit(REACH).alias("high")))
    here = F.struct("block", "row", "anchor")
    begin, end = F.greatest("low", "least"), F.least("high", "most")
    while not now.isEmpty():
        core = [F.substring(F.col("left"), F.lit(1), F.col("low")), F.substring(F.col("right"), F.lit(1), WINDOW - F.col("high")), F.col("low"), F.col("high")]
        hull = [F.substring(F.col("left"), F.lit(1), end), F.substring(F.col("right"), F.lit(1), WINDOW - begin), begin, end]
        both = lambda x: F.struct(F.xxhash64(*x), F.xxhash64(*reversed(x)))
        keyed = settled(now.withColumn("core", both(core)).withColumn("hull", both(hull)))
        hulls = settled(keyed.groupBy("core", "hull").agg(F.sum("mult").alias("n"), F.min(here).alias("first")))
        cores = settled(hulls.groupBy("core").agg(F.count("*").alias("hulls")))
        told = settled(keyed.join(hulls, ["core", "hull"]).join(cores, "core"))
        spans.append(told.where("asks and n > 1").select("block", "row", "anchor", (F.col("anchor") - end).alias("start"), (F.col("anchor") - begin + WINDOW).alias("end")))
        left = told.where("hulls > 1 and low < high").where((F.col("n") == 1) | (here == F.col("first"))).withColumn("asks", F.col("asks") & (F.col("n") == 1))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
        split = left.select(*columns, F.explode(halves).alias("half")).select(*columns, "half.low", "half.high")
        now = unsized(settled(split.where("low <= most and high >= least")))
    none = records.select("block", "row", "anchor", F.col("anchor").alias("start"), F.col("anchor").alias("end")).where("false")
    for more in spans:
        none = none.unionByName(more)
    return none


def _packed_spans(spans: DataFrame) -> DataFrame:
    """block, places: the spans of a task's rows, packed for each block."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("block", "row", "anchor", "start", "end")]
            used = np.unique(columns[0])
            blobs = [squeeze(*(c[columns[0] == b] for c in columns[1:])) for b in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "places"])

    return spans.repartition("block").sortWithinPartitions("block", "row").mapInArrow(over, "block long, places binary")


def _of_equals(spans: list[np.ndarray], equals: list[np.ndarray]) -> list[np.ndarray]:
    """row, start, end of spans (row, anchor, start, end), and of the same for records that are equal (by row and anchor: equal row and anchor)."""
    row, anchor, start, end = spans
    by_row, by_anchor, other_row, other_anchor = equals
    order = np.lexsort((anchor, row))
    row, anchor, start, end = (x[order] for x in (row, anchor, start, end))
    name = lambda r, a: r.astype(np.uint64) << np.uint64(40) | a.astype(np.uint64)
    of, wanted = name(row, anchor), name(by_row, by_anchor)
    first, last = np.searchsorted(of, wanted, "left"), np.searchsorted(of, wanted, "right")
    n = last - first
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    shift = np.repeat(other_anchor - by_anchor, n)
    return [np.concatenate([row, np.repeat(other_row, n)]), np.concatenate([start, start[at] + shift]), np.concatenate([end, end[at] + shift])]


def _union(n: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of a text of n bytes."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    covered = np.diff(np.pad((np.cumsum(edge)[:n] > 0).astype(np.int8), 1))
    return np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, starts, ends (arrays of the maximal removed runs), kept (the remaining bytes) for every row.

    A byte goes if a WINDOW-byte string that covers it also starts anywhere
    else, in the same text or another, as the texts were given. Null and empty
    texts have no bytes; texts of fewer than WINDOW bytes lose none; repeated
    rows are repeats of each other. Other columns are ignored. No rows give no
    rows. most: entries of a key that are merged in one task; it changes no
    result.
    """
    given = lean(docs, doc_id="doc_id", text="text")
    n_bytes = text_bytes(given)
    shards, parts = shard_count(n_bytes), block_count(docs.sparkSession, n_bytes)
    texts = stored(given)
    replies = settled(_replies(texts, shards, most))
    picked = settled(_candidates(texts, replies, shards, parts))
    merged = picked.where("shard >= 0").select("block", "shard", "run", "places").repartition(max(shards, partitions(docs.sparkSession)), "shard").groupBy("shard").applyInArrow(_merged, "block long, places binary")
    hot = hot_spans(_hot_records(picked))
    spans = picked.where("shard = -1").select("block", "places", F.lit(True).alias("equals")).unionByName(merged.unionByName(_packed_spans(hot)).withColumn("equals", F.lit(False)))
    id_name = given.schema["doc_id"].dataType.simpleString()

    def cut(block: pa.Table, found: pa.Table) -> pa.Table:
        block = block.sort_by("row") if block.num_rows else block
        told = list(zip(found.column("places").to_pylist(), found.column("equals").to_pylist(), strict=True))
        spans = [unsqueeze(b, np.int32, np.int64, np.int64, np.int64) for b, equals in told if not equals]
        equals = [unsqueeze(b, np.int32, np.int64, np.int32, np.int64) for b, equals in told if equals]
        row, start, end = _of_equals(*([np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)] for parts in (spans, equals)))
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        bounds = np.searchsorted(row, np.arange(block.num_rows + 1))
        sizes, starts, ends, kept = [], [], [], []
        for first, run in texts_of(block.column("packed")):
            for i, text in enumerate(run, first):
                a, b = bounds[i], bounds[i + 1]
                s, e = _union(len(text), start[a:b], end[a:b]) if b > a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                sizes.append(len(text))
                starts.append(s)
                ends.append(e)
                kept.append(text if not len(s) else b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)))
        return _cut_table(block.column("doc_id"), sizes, starts, ends, kept)

    return texts.repartition(parts, "block").groupBy("block").cogroup(spans.repartition(parts, "block").groupBy("block")).applyInArrow(cut, f"doc_id {id_name}, n_bytes long, starts array<long>, ends array<long>, kept binary")


def _cut_table(doc_id, sizes, starts, ends, kept) -> pa.Table:
    longs = pa.list_(pa.int64())
    return pa.table({"doc_id": doc_id, "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(starts, longs), "ends": pa.array(ends, longs), "kept": pa.array(kept, pa.binary())})


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

