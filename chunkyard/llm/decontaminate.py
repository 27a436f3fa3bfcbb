"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is `width` consecutive words of an item, or the whole of a shorter
item; its tokens are its shingles of three words (of all its words, if it has
fewer). Shingles are ordered by how often they occur in the documents. All of a
window's shingles must be in a document that holds it, so one necessary prefix
token is enough: the rarest. Documents and windows are joined by that token. A
token's place in the window and in the document gives the one place where the
window may begin (positional bound), which must be inside the document with all
its words (length bound); there the words are compared, all of them, in a
context as large as a window.

Documents are read twice, however many items there are: to count shingles and
to give out those that are prefix tokens. Both passes look shingles up in a
filter of bounded size first, so only few that are none are sent. Windows,
their counts and prefixes are tables, never collected; of a token that very many
documents hold, the join is split where Spark finds it skewed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import flat, free, lean, pieces, raw, settled, table
from .words import LOWER, row_hashes, runs

WIDTH = 10
#: Words of a token.
SHINGLE = 3
#: Bits of the filter for each token, and how many bits (a power of two) it has at least and at most: 32 MB.
BITS_A_TOKEN = 256
LEAST_BITS, MOST_BITS = 16, 28
#: Marks of texts, of 8 bytes each, that are broadcast at most.
SENT_WHOLE = 1 << 17
#: Rows, and distinct tokens, that wait in a task at most.
WAITING = 1 << 16

#: ASCII that is no letter or digit is between words.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Filter:
    """Which tokens there may be: two bits of each are set. No token that is there is ever missed."""

    power: int
    bits: bytes  # compressed

    def unpacked(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.bits), np.uint8)


def _places(tokens: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    return tokens >> np.uint64(64 - power), tokens & np.uint64((1 << power) - 1)


def _may_hold(bits: np.ndarray, power: int, tokens: np.ndarray) -> np.ndarray:
    out = np.ones(len(tokens), bool)
    for at in _places(tokens, power):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def filter_of(tokens: DataFrame, n: int) -> Filter:
    """The filter of a column `token` of n rows; what comes to the driver is a bounded bitmap for each of a few tasks, one at a time."""
    power = min(max((n * BITS_A_TOKEN).bit_length(), LEAST_BITS), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << power - 3, np.uint8)
        for batch in batches:
            for at in _places(batch.column("token").to_numpy().view(np.uint64), power):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    whole = np.zeros(1 << power - 3, np.uint8)
    for row in tokens.select("token").coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return Filter(power, zlib.compress(whole.tobytes(), 1))


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id (as text, null: `null`), window (its words, a blank between), n (words), tokens (its shingles in order), for every place in every item."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), raw(batch.column("text")), strict=True):
                data = np.frombuffer(text, np.uint8)
                hashes, starts, ends = runs(data, np.array([0, len(data)]), BREAKS, True)
                if not len(hashes):
                    continue
                n, k = min(width, len(hashes)), min(width, len(hashes), SHINGLE)
                tokens, low = row_hashes(hashes, k).view(np.int64), LOWER[data].tobytes()
                words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                places = len(hashes) - n + 1
                for a in range(0, places, WAITING):
                    here = range(a, min(a + WAITING, places))
                    each = tokens[np.arange(here.start, here.stop)[:, None] + np.arange(n - k + 1)].ravel()
                    offsets = np.arange(len(here) + 1, dtype=np.int32) * np.int32(n - k + 1)
                    window = pa.array([b" ".join(words[i : i + n]) for i in here], pa.binary()).cast(pa.string())
                    columns = [pa.array(["null" if item_id is None else item_id] * len(here), pa.string()), window, pa.array([n] * len(here), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(each))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "window", "n", "tokens"])

    given = lean(items, item_id="item_id", text="text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return given.mapInArrow(over, "item_id string, window string, n int, tokens array<long>")


def _tokens(data: np.ndarray, offsets: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each size of shingle: tokens, and the word and the text that each begins at; then once, with size 0, words' starts, ends and bounds."""
    hashes, starts, ends = runs(data, offsets, BREAKS, True)
    bounds = np.searchsorted(starts, offsets)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    for k in sizes:
        found = row_hashes(hashes, k)
        inside = text_of[: len(found)] == text_of[k - 1 :] if len(found) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        yield k, found[at], at, text_of[at]
    yield 0, starts, ends, bounds


def occurrences(docs: DataFrame, given: Filter, sizes: list[int]) -> DataFrame:
    """token, n: how often the shingles that the filter may hold occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, waiting, n = shared.value.unpacked(), [], 0

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], names=["token", "n"])

        for whole in batches:
            for batch in pieces(whole):
                for k, tokens, *_ in _tokens(*flat(batch.column("text")), sizes):
                    if k:
                        waiting.append(tokens[_may_hold(bits, shared.value.power, tokens)])
                        n += len(waiting[-1])
                if n > WAITING:
                    yield out()
                    waiting, n = [], 0
        if n:
            yield out()

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, given: Filter, sizes: list[int], width: int = WIDTH) -> DataFrame:
    """Of docs (doc_id, mark, text), a row with n_words for each, numbered by id; and one for each shingle that the filter may hold:
    token, at (the word where it begins), before (words of context before it) and context (its words and those around it). Stored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(given)
    names = ["doc_id", "mark", "id", "n_words", "token", "at", "before", "context"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, first = shared.value.unpacked(), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = flat(batch.column("text"))
                *found, (_, starts, ends, bounds) = _tokens(data, offsets, sizes)
                doc, mark = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
                counts = np.diff(bounds).tolist()
                rows = [(d, m, first + i, n, None, None, None, None) for i, (d, m, n) in enumerate(zip(doc, mark, counts, strict=True))]
                for k, tokens, word, text in found:
                    hit = np.flatnonzero(_may_hold(bits, shared.value.power, tokens))
                    for token, w, t in zip(tokens[hit].view(np.int64).tolist(), word[hit].tolist(), text[hit].tolist(), strict=True):
                        a, b = max(int(bounds[t]), w - width + k), min(int(bounds[t + 1]), w + width)
                        context = b" ".join(LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(a, b))
                        rows.append((doc[t], mark[t], first + t, None, token, w - int(bounds[t]), w - a, context.decode()))
                        if len(rows) >= WAITING:
                            yield rows_of(rows)
                            rows = []
                if rows:
                    yield rows_of(rows)
                first += batch.num_rows

    return settled(docs.select("doc_id", "mark", "text").mapInArrow(look, "doc_id long, mark long, id long, n_words long, token long, at long, before int, context string"))


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """token, offset, n, window: the rarest shingle of each distinct window whose shingles all occur, stored."""
    each = windows.select("window", "n", F.posexplode("tokens").alias("offset", "token"))
    total = windows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    often = settled(occurrences(docs, filter_of(each, total), sizes))
    rarest = each.join(often.withColumnRenamed("n", "often"), "token", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "offset")).alias("p"))
    return settled(rarest.where("p.often > 0").select("p.token", "p.offset", "n", "window"))


def occurring(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, mark, text): all rows (doc_id, mark, id, n_words); places of windows (id, mark, start, n, window); and the
    items (window, item_id) that have them."""
    made = settled(item_windows(items, width))
    windows = settled(made.dropDuplicates(["window"]).select("window", "n", "tokens"))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # 1 to SHINGLE
    prefix = prefixes(docs, windows, sizes)
    n = prefix.count()
    seen = candidates(docs, filter_of(prefix, n), sizes if n else [], width)
    met = seen.where("token is not null").select("id", "mark", "token", "at", "before", "context").join(prefix, "token")
    words = F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("n"))
    holds = met.where("before >= offset").where((F.size(words) == F.col("n")) & (F.array_join(words, " ") == F.col("window")))
    places = settled(holds.select("id", "mark", (F.col("at") - F.col("offset")).alias("start"), "n", "window"))
    return seen.where("token is null").select("doc_id", "mark", "id", "n_words"), places, made.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), spans (first word and words of each occurrence), items (ids as text, sorted).

    One row for each row of docs; other columns are ignored. Null and empty
    texts have no words and no hits; items without words have no window. Items
    with equal windows are all found. Repeated rows each have their row. Texts
    are taken whole. No items: no hits. No rows give no rows.
    """
    given = lean(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text")
    rows, places, owners = occurring(given, items, width)
    spans = places.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    found = places.select("id", "window").distinct().join(owners, "window").groupBy("id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def more(so_far, span):
        end = F.greatest(so_far["end"], span["start"] + span["n"])
        return F.struct(end.alias("end"), (so_far["total"] + end - F.greatest(so_far["end"], F.least(span["start"], end))).alias("total"))

    n_hit = F.coalesce(F.aggregate("spans", zero, more, lambda x: x["total"]), F.lit(0).cast("long"))
    out = rows.join(spans, "id", "left").join(found, "id", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,n:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without a hit, whole and with all their columns, whatever their names.

    A text's rows stay or go together, by a 64-bit hash of the text. See `contamination` for odd rows.
    """
    given = lean(docs, text="text").select(F.lit(0).cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    _, places, _ = occurring(given, items, width)
    mark = free("mark", *docs.columns)
    gone = settled(places.select(F.col("mark").alias(mark)).distinct())
    if gone.count() <= SENT_WHOLE:  # else both sides are dealt by the mark
        gone = F.broadcast(gone)
    return docs.join(gone, F.xxhash64(docs["text"]) == gone[mark], "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5_SQL = f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[i:i + {WIDTH} - 1], ' ') AS v
        FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS v
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, spot.n, item_id FROM spot JOIN win ON spot.v = win.v AND spot.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""
