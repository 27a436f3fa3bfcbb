"""LM scoring: log10 probabilities of texts by context-tree weighting, beside a word-count base.

Texts are stored once, compressed, in blocks of bounded size. Both models'
counts are gathered from all training texts: byte contexts with the
next byte, and words. A block sends its distinct keys with counts, packed and
sorted, to shards by key; a shard adds up and sends each block the totals of its
own words, and the probabilities of its own byte strings, in the block's order.
So what moves grows with distinct keys of blocks, not with words of documents,
no word meets all its rows, and the tree stays in the shards at any size: only
contexts of at most two bytes come to the driver. Of a shard's blocks one is in
memory at a time; what stays is its distinct keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_tree
from .blocks import by_block, shard_bounds, shard_count, squeeze, steps, stored, texts_of, unsqueeze
from .frames import block_count, lean, partitions, remainder, settled, table, text_bytes
from .words import word_hashes

#: Bytes of text that the tree works on at once.
SLICE = 1 << 20
#: Stands for the end of a text among the words' hashes.
END = np.uint64(0xE2D0F7E871E2D0F7)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return squeeze(steps(keys), counts.astype(np.uint32))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = unsqueeze(blob, np.uint64, np.uint32)
    return np.cumsum(keys, dtype=np.uint64), counts.astype(np.int64)


def _messages(block: pa.Table, blobs: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """block, shard, blob: about a megabyte at a time, so that a block's messages are never all in one batch."""
    name, held, size = block.column("block")[0].as_py(), [], 0

    def out() -> pa.RecordBatch:
        shards, packed = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.int64()), pa.array(shards, pa.int32()), pa.array(packed, pa.binary())], names=["block", "shard", "blob"])

    for shard, blob in blobs:
        held.append((shard, blob))
        size += len(blob) + 64
        if size > 1 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a key's latest three bytes, so that a shard holds all data of the contexts below them."""
    return ((keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)


def dealt_grams(texts: DataFrame, shards: int) -> DataFrame:
    """block, shard, blob (the block's distinct keys of a shard with their training counts), stored with a shard's rows together."""

    def send(batches):
        for block in by_block(batches):
            training, found = block.column("training").to_pylist(), context_tree.Counter()
            for start, run in texts_of(block.column("packed"), SLICE):
                flags = training[start : start + len(run)]
                for flag in set(flags):
                    for own, _, _ in context_tree.gram_runs([t for t, f in zip(run, flags, strict=True) if f == flag], SLICE):
                        keys, counts = np.unique(own, return_counts=True)
                        found.add(keys, counts * flag)
            keys, counts = found.total()
            shard = _shards_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            bounds = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
            yield from _messages(block, ((int(shard[order[a]]), _pack(keys[order[a:b]], counts[order[a:b]])) for a, b in zip(bounds, bounds[1:], strict=False)))

    blobs = texts.select("block", "training", "packed").mapInArrow(send, "block long, shard int, blob binary")
    return settled(blobs.repartition(max(shards, partitions(texts.sparkSession)), "shard").sortWithinPartitions("shard", "block"))


def added_up(grams: DataFrame) -> DataFrame:
    """shard, piece, blob: a shard's distinct keys with all their counts, in pieces of whole subtrees. Blocks are added one by one. Stored."""

    def add(batches):
        shard, found = None, context_tree.Counter()

        def out():
            for i, (keys, counts) in enumerate(context_tree.pieces(*found.total())):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i], pa.int32()), pa.array([_pack(keys, counts)], pa.binary())], names=["shard", "piece", "blob"])

        for batch in batches:
            for s, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if s != shard:
                    yield from out()
                    shard, found = s, context_tree.Counter()
                found.add(*_unpack(blob))
        yield from out()

    return settled(grams.select("shard", "blob").mapInArrow(add, "shard int, piece int, blob binary"))


def learn_top(totals: DataFrame) -> context_tree.Top:
    """The tree of the shortest contexts. What comes to the driver is bounded by the number of three-byte strings."""

    def sums(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in context_tree.subtree(*_unpack(blob)).sums()], names=["place", "one", "two"])

    added = totals.select("blob").mapInArrow(sums, "place long, one double, two double").groupBy("place").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).toPandas().sort_values("place")
    return context_tree.top(added["place"].to_numpy(np.int64), added["one"].to_numpy(float), added["two"].to_numpy(float))


def gram_answers(grams: DataFrame, totals: DataFrame, above: context_tree.Top, parts: int) -> DataFrame:
    """block, shard, answers: log10 probabilities of the block's distinct keys of a shard, in order.

    A shard's pieces come first and stay; then its blocks pass, one at a time.
    """
    shared = grams.sparkSession.sparkContext.broadcast(above)

    def reply(batches):
        shard, known, keys, logs = None, [], None, None
        for batch in batches:
            for s, block, blob in zip(*(batch.column(n).to_pylist() for n in ("shard", "block", "blob")), strict=True):
                if s != shard:
                    shard, known, keys = s, [], None
                own, counts = _unpack(blob)
                if block is None:
                    known.append((own, context_tree.answers(own, counts, shared.value)))
                    continue
                if keys is None:
                    keys, logs = (np.concatenate(x) for x in zip(*known, strict=True))
                    known = []
                found = squeeze(logs[np.searchsorted(keys, own)])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([s], pa.int32()), pa.array([found], pa.binary())], names=["block", "shard", "answers"])

    both = totals.select("shard", "piece", F.lit(None).cast("long").alias("block"), "blob").unionByName(grams.select("shard", F.lit(None).cast("int").alias("piece"), "block", "blob"))
    dealt = both.repartition(parts, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first(), "piece")
    return dealt.select("shard", "block", "blob").mapInArrow(reply, "block long, shard int, answers binary")


def _block_scores(packed: pa.ChunkedArray, replies: pa.Table, shards: int) -> np.ndarray:
    """log10 of each text's probability, its end included, from the shards' answers."""
    runs, scores = [], np.zeros(len(packed))
    for first, run in texts_of(packed, SLICE):
        for grams, i, starts in context_tree.gram_runs(run, SLICE):
            own, place = np.unique(grams, return_inverse=True)
            runs.append((own, place.astype(np.int32), first + i, starts))
    keys = np.unique(np.concatenate([own for own, *_ in runs]))
    logs = np.empty(len(keys))
    logs[np.argsort(_shards_of(keys, shards), kind="stable")] = np.concatenate([unsqueeze(b, np.float16)[0] for b in replies.sort_by("shard").column("blob").to_pylist()])
    for own, place, first, starts in runs:
        scores[first : first + len(starts)] += np.add.reduceat(logs[np.searchsorted(keys, own)][place], starts)
    return scores


def _block_words(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, ends included, and where each row's begin."""
    hashes, begins, n = [], [], 0
    for _, run in texts_of(packed):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in run])])
        words, at = word_hashes(np.frombuffer(b"".join(run), np.uint8), offsets)
        own = np.insert(words, at[1:], END)
        hashes.append(own)
        begins.append(n + at[:-1] + np.arange(len(run)))
        n += len(own)
    return np.concatenate(hashes), np.concatenate(begins)


def word_totals(texts: DataFrame, shards: int) -> DataFrame:
    """block, shard, totals (training counts of the block's distinct tokens of a shard, in order of hash), known, tokens.

    known and tokens, the shard's distinct training tokens and their number, are on one of its rows and 0 on others.
    """

    def send(batches):
        for block in by_block(batches):
            hashes, begins = _block_words(block.column("packed"))
            training = np.repeat(block.column("training").to_numpy(), np.diff(np.append(begins, len(hashes))))
            keys, place = np.unique(hashes, return_inverse=True)
            counts = np.bincount(place, training, len(keys))
            bounds = [0, *np.searchsorted(keys, shard_bounds(shards)).tolist(), len(keys)]
            yield from _messages(block, ((s, _pack(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a))

    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        given = [_unpack(b) for b in rows.column("blob").to_pylist()]
        keys, counts = context_tree.merged(*(np.concatenate(x) for x in zip(*given, strict=True)))
        totals = [squeeze(counts[np.searchsorted(keys, k)]) for k, _ in given]
        first = np.arange(len(given)) == 0
        return pa.table(
            {
                "block": rows.column("block"),
                "shard": rows.column("shard"),
                "totals": pa.array(totals, pa.binary()),
                "known": pa.array(first * int((counts > 0).sum()), pa.int64()),
                "tokens": pa.array(first * int(counts.sum()), pa.int64()),
            }
        )

    blobs = texts.select("block", "training", "packed").mapInArrow(send, "block long, shard int, blob binary")
    return blobs.repartition(max(shards, partitions(texts.sparkSession)), "shard").groupBy("shard").applyInArrow(add_up, "block long, shard int, totals binary, known long, tokens long")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of (doc_id, training, text).

    The models learn from rows whose `training` is true. score is the context
    tree's log10 probability of the text with A-Z lower-cased and its end;
    bits_per_byte, its code length per byte, the end counted as one. Null texts are
    empty: their end is their only token. Repeated rows count as often as they
    are there. Without training rows every byte is equally likely and the base
    is 0 per token. No rows give no rows.
    """
    docs = docs.select("doc_id", F.coalesce("training", F.lit(False)).alias("training"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    n_bytes = text_bytes(docs)
    shards = shard_count(n_bytes)
    texts = stored(docs, lower=True)
    parts = max(shards, partitions(docs.sparkSession))
    grams = dealt_grams(texts, shards)
    sums = added_up(grams)
    answered = gram_answers(grams, sums, learn_top(sums), parts)
    totals = settled(word_totals(texts, shards))
    known, tokens = totals.agg(F.sum("known"), F.sum("tokens")).first()
    scale = math.log10((tokens or 0) + 0.5 * ((known or 0) + 1))

    def score(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), "training": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "bits_per_byte": pa.array([], pa.float64())})
        words = replies.column("words")
        hashes, begins = _block_words(rows.column("packed"))
        _, place = np.unique(hashes, return_inverse=True)
        total = np.concatenate([unsqueeze(b, np.int64)[0] for b in replies.filter(words).sort_by("shard").column("blob").to_pylist()])[place]
        n = np.diff(np.append(begins, len(hashes)))
        base = np.add.reduceat(np.log10(total + 0.5), begins) - n * scale
        scored = _block_scores(rows.column("packed"), replies.filter(pc.invert(words)), shards)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "training": rows.column("training"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.add.reduceat((total > 0).astype(np.int64), begins), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(scored),
                "bits_per_byte": pa.array(-scored / math.log10(2) / (rows.column("n_bytes").to_numpy() + 1)),
            }
        )

    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if id_name == "string" else pa.int64() if id_name == "bigint" else pa.int32()
    replies = totals.select("block", "shard", F.col("totals").alias("blob"), F.lit(True).alias("words")).union(answered.select("block", "shard", "answers", F.lit(False)))
    dealt = block_count(docs.sparkSession, n_bytes)
    scored = texts.repartition(dealt, "block").groupBy("block").cogroup(replies.repartition(dealt, "block").groupBy("block")).applyInArrow(score, f"doc_id {id_name}, training boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.withColumn("train_tokens", F.lit(tokens or 0).cast("long"))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = lean(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").withColumn("training", remainder("doc_id", 5) != 1)
    return scores(docs).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
