"""Near-duplicate detection with MinHash bands and odd sketches.

1. Rows with one shingle set are a class; only classes go on, so copies cost
   one row each.
2. MinHash samples make bands; classes that agree in a band share a bucket. The
   samples are also folded into an odd sketch, a bitmap of parities, whose XOR
   has about as many ones as the samples differ. Inside a bucket, classes are
   joined as far as their sketches allow the wanted similarity (within
   `SIGMAS` deviations), and each is tied to the least one: as many rows as
   members, never all pairs. Ties make candidate clusters.
3. Each class is compared with the least class that it is tied to, on their full
   sets. Links that hold make components; most clusters are one component then,
   and nothing more is compared in them.
4. In other clusters, classes of different components meet in blocks bounded in
   classes and in shingles. A large component has blocks of its own, which are
   not compared with each other. The sizes of all intersections in a pair of
   blocks are one matrix product over full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import stored, texts_of
from .components import components
from .frames import block_count, flat, lean, map_batches, settled, table, text_bytes
from .words import mix, shingles, word_hashes

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
SIGMAS = 5
#: Classes of a bucket that meet in one block; larger buckets are compared by pairs of blocks.
BUCKET = 8192
#: Classes of a cluster that meet in one block, and shingles; a longer text is a block of its own.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
#: Classes that are compared with one copy of the text they are tied to.
STAR = 1024
#: Bytes of text for a partition of what is shuffled.
PART_BYTES = 64 << 20
#: Shingles whose columns are multiplied at once.
COLUMNS = 8192
KEY = 16
#: Stands for a null id.
NO_ID = -(1 << 63)
PAYLOAD = KEY + SKETCH_BITS // 8


@lru_cache(1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1009)
    draw = lambda: rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def samples(shingle_set: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES hashes over a set."""
    factor, shift = seeds()
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_set), 4096):
        part = shingle_set[i : i + 4096, None] ^ shift
        part *= factor
        np.minimum(out, part.min(0), out=out)
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """[classes, BANDS] bucket numbers of [classes, SAMPLES]."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sampled), BANDS)).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sampled.reshape(-1, BANDS, ROWS)[:, :, i])
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """[classes, SKETCH_BITS / 64] parities of where the numbered samples fall."""
    at = (mix(sampled + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    hits = np.zeros((len(sampled), SKETCH_BITS), np.uint8)
    np.add.at(hits, (np.arange(len(sampled))[:, None], at), 1)
    return np.packbits(hits & 1, axis=1).view(np.uint64)


def most_ones(percent: int) -> int:
    """Ones in the XOR of two sketches up to which the sets may be `percent` similar, SIGMAS deviations allowed."""
    j, n, k = percent / 100, SKETCH_BITS, SAMPLES
    stay = (1 - 2 / n) ** (2 * k * (1 - j))
    q = (1 - stay) / 2
    return int(n * q + SIGMAS * np.sqrt(n * q * (1 - q) + stay**2 * 4 * k * j * (1 - j)))


def groups_of(near: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> list[np.ndarray]:
    """Components of 0..n-1, each sorted; near(some, others) is a matrix of booleans. Members that are joined are compared no more."""
    rest, out = np.arange(n), []
    while len(rest):
        found, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            joined = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                left = np.flatnonzero(~joined)
                if len(left):
                    joined[left[near(front[i : i + 64], rest[left]).any(0)]] = True
            front, rest = rest[joined], rest[~joined]
            found.append(front)
        out.append(np.sort(np.concatenate(found)))
    return out


def _sets(packed: pa.Array | pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """The shingle set of each stored text; one of bounded runs of texts is unpacked at a time."""
    for _, run in texts_of(packed):
        offsets = np.cumsum([0, *(len(t) for t in run)])
        hashes, at = word_hashes(np.frombuffer(b"".join(run), np.uint8), offsets)
        yield from (shingles(hashes[a:b], words) for a, b in zip(at, at[1:], strict=False))


ROW = "doc_id long, row_hash long, block long, row int"


def signatures(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row_hash, block, row, n_shingles, class_key (of the full set; null if empty), buckets and sketch (both binary) of stored texts."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, sampled = [], [], []
        for s in _sets(batch.column("packed"), words):
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sampled.append(samples(s))
        sampled = np.array(sampled).reshape(-1, SAMPLES)
        own = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([b.tobytes() for b in bands(sampled)], pa.binary()), pa.array([b.tobytes() for b in odd_sketches(sampled)], pa.binary())]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "row_hash", "block", "row")), *own], names=["doc_id", "row_hash", "block", "row", "n_shingles", "class_key", "buckets", "sketch"])

    return map_batches(texts.select("doc_id", "row_hash", "block", "row", "packed"), over, f"{ROW}, n_shingles long, class_key binary, buckets binary, sketch binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return flat(column)[0].reshape(-1, width)


def candidate_ties(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """a, b: classes of a bucket that may be similar, each tied to the least of those it reaches there."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets = _fixed(batch.column("buckets"), 8 * BANDS).view(np.int64)
        payload = np.repeat(np.hstack([_fixed(batch.column("class_key"), KEY), _fixed(batch.column("sketch"), SKETCH_BITS // 8)]), BANDS, axis=0)
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PAYLOAD), len(payload), [None, pa.py_buffer(payload.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), fixed.cast(pa.binary())], names=["bucket", "payload"])

    most = most_ones(percent)

    key = ["bucket", "first", "second"]

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if batch.num_rows and any(batch.column(k)[0] != batch.column(k)[batch.num_rows - 1] for k in key):
                whole = pa.Table.from_batches(held).combine_chunks()
                last = int(_group_starts(whole)[-1])  # the last group may go on
                yield from _tied(whole.slice(0, last), most)
                held = whole.slice(last).to_batches()
        if held:
            yield from _tied(pa.Table.from_batches(held).combine_chunks(), most)

    rows = map_batches(classes.select("class_key", "buckets", "sketch"), spread, "bucket long, payload binary")
    hot = settled(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")))
    if hot.isEmpty():
        dealt = rows.select("bucket", F.lit(0).alias("first"), F.lit(0).alias("second"), "payload")
    else:
        blocked = rows.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64("payload"), F.col("blocks")).cast("int"))
        paired = blocked.select("bucket", "payload", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = paired.select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "payload")
    ties = dealt.repartition(parts, *key).sortWithinPartitions(*key, "payload").mapInArrow(tie, "a binary, b binary")
    return ties.distinct()


def _group_starts(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for k in ("bucket", "first", "second"):
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _tied(rows: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    if rows.num_rows < 2:
        return
    payload = _fixed(rows.column("payload"), PAYLOAD)
    keys, sketches = payload[:, :KEY], np.ascontiguousarray(payload[:, KEY:]).view(np.uint64)
    starts = _group_starts(rows)
    sizes = np.diff(np.append(starts, len(payload)))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(1) <= most]
    a, b = [two + 1], [two]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = sketches[start : start + size]
        for g in groups_of(lambda x, y: np.bitwise_count(own[x][:, None] ^ own[y][None]).sum(2) <= most, size):
            a.append(start + g[1:])
            b.append(np.full(len(g) - 1, start + g[0]))
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys[i]], pa.binary()) for i in (a, b)], names=["a", "b"])


def _similar(sets: list[np.ndarray], percent: int, near_at: int) -> list[np.ndarray]:
    """Groups of sets linked by 100 * intersection >= percent * union; with near_at, only links between those before and after it count."""
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    of = np.repeat(np.arange(len(sets)), sizes)[shared[place]]
    at = column[place[shared[place]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, [start, start + COLUMNS])
        members = np.zeros((len(sets), COLUMNS), np.float32)
        members[of[i:j], at[i:j] - start] = 1
        both += members @ members.T
    union = sizes[:, None] + sizes[None] - both
    link = 100 * both.astype(np.int64) >= percent * union.astype(np.int64)
    if near_at:
        link[:near_at, :near_at] = False
        link[near_at:, near_at:] = False
    return groups_of(lambda x, y: link[np.ix_(x, y)], len(sets))


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"])


def star_links(ties: DataFrame, sources: DataFrame, texts: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """The ties (a, b) that hold on full sets. b's text is read once for each STAR of its ties."""
    # Stored, so that the join is not dealt by b as the counts are, and a class with very many ties can be split.
    degree = settled(ties.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("chunks")))
    members = ties.join(degree, "b").select("b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"), F.col("a").alias("node"), F.lit(1).alias("side"))
    centres = members.select("b", "chunk").distinct().select("b", "chunk", F.col("b").alias("node"), F.lit(0).alias("side"))
    wanted = members.unionByName(centres).join(sources, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for b, chunk, node, s in zip(*(batch.column(n).to_pylist() for n in ("b", "chunk", "node")), _sets(batch.column("packed"), words), strict=True):
                if (b, chunk) != now:
                    now, centre = (b, chunk), s  # a star begins with its centre
                    continue
                both = len(np.intersect1d(centre, s, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(s) - both):
                    found.append((node, b))
            if found:
                yield _links(found)

    met = texts.select("block", "row", "packed").join(wanted, ["block", "row"]).select("b", "chunk", "side", "node", "packed")
    return met.repartition(parts, "b", "chunk").sortWithinPartitions("b", "chunk", "side").mapInArrow(compare, "a binary, b binary")


def block_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of classes (node, cluster, part, n_shingles), part being the component so far: each with own and block; and the pairs of
    blocks that may hold links between parts, as (cluster, first_own, first, second_own, second).

    Parts of over BLOCK classes have blocks of their own (own is the part); others share blocks (own is empty).
    """
    sizes = settled(members.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).withColumn("own", F.when(F.col("n") > BLOCK, F.col("part")).otherwise(F.lit(b""))))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("w") / BLOCK_SHINGLES)).cast("int")
    counts = sizes.groupBy("cluster", "own").agg(blocks.alias("blocks"))
    dealt = members.join(sizes.select("cluster", "part", "own"), ["cluster", "part"]).join(counts, ["cluster", "own"])
    placed = settled(dealt.select("node", "cluster", "own", F.pmod(F.xxhash64(F.when(F.length("own") > 0, F.col("node")).otherwise(F.col("part"))), F.col("blocks")).cast("int").alias("block")))
    used = settled(placed.select("cluster", "own", "block").distinct())
    p = used.select("cluster", F.col("own").alias("first_own"), F.col("block").alias("first"))
    q = used.select("cluster", F.col("own").alias("second_own"), F.col("block").alias("second"))
    ordered = F.struct("first_own", "first") <= F.struct("second_own", "second")
    same_part = (F.col("first_own") == F.col("second_own")) & (F.length("first_own") > 0)
    return placed, p.join(q, "cluster").where(ordered & ~same_part)


def block_links(placed: DataFrame, pairs: DataFrame, sources: DataFrame, texts: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """a, b: links on full sets inside the pairs of blocks; as many as join what is linked, not all."""
    key = ["cluster", "first_own", "first", "second_own", "second"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, split = None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                found = [(keys[i], keys[g[0]]) for g in _similar(sets, percent, split) for i in g[1:]]
                if found:
                    yield _links(found)

        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in (*key, "side", "node")), _sets(batch.column("packed"), words), strict=True)
            for *group, side, node, s in rows:
                if group != now:
                    yield from done()
                    now, keys, sets, split = group, [], [], 0
                if side == 1 and not split:
                    split = len(sets)
                keys.append(node)
                sets.append(s)
        yield from done()

    found = texts.select(F.col("block").alias("at"), "row", "packed").join(placed.join(sources.withColumnRenamed("block", "at"), "node"), ["at", "row"])
    either = pairs.select("*", F.explode(F.when(F.struct("first_own", "first") == F.struct("second_own", "second"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    ends = either.withColumn("own", F.when(F.col("side") == 0, F.col("first_own")).otherwise(F.col("second_own"))).withColumn("block", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second")))
    met = found.join(ends, ["cluster", "own", "block"]).select(*key, "side", "node", "packed")
    return met.repartition(parts, *key).sortWithinPartitions(*key, "side").mapInArrow(confirm, "a binary, b binary")


def _components(texts: DataFrame, n_bytes: int, words: int, percent: int) -> DataFrame:
    """doc_id, row_hash, block, row, n_shingles, component_id, kept for every stored text (doc_id, row_hash, block, row, packed)."""
    spark = texts.sparkSession
    parts = block_count(spark, n_bytes, PART_BYTES)
    rows = settled(signatures(texts, words))
    # Rows of a class have the same signature, so any of them will do.
    classes = rows.where("class_key is not null").groupBy("class_key").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("block", "row")).alias("source"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")
    )
    classes = settled(classes)
    sources = classes.select(F.col("class_key").alias("node"), "source.block", "source.row")
    ties = settled(candidate_ties(classes, percent, parts))
    least = settled(ties.groupBy("a").agg(F.min("b").alias("b")))
    now = settled(components(settled(star_links(least, sources, texts, words, percent, parts))))
    part_of = lambda frame, name, to: frame.join(now.select(F.col("node").alias(name), F.col("root").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))
    between = settled(part_of(part_of(ties, "a", "x"), "b", "y").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    parts_of = part_of(classes.select(F.col("class_key").alias("node"), "first_id", "n_shingles"), "node", "part")
    if not between.isEmpty():  # ties that did not hold, or were not looked at, between components
        clusters = components(between).select(F.col("node").alias("part"), F.col("root").alias("cluster"))
        placed, pairs = block_pairs(settled(parts_of.join(clusters, "part").select("node", "cluster", "part", "n_shingles")))
        found = block_links(placed, pairs, sources, texts, words, percent, parts)
        joined = part_of(part_of(found, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        whole = components(settled(joined)).select(F.col("node").alias("part"), "root")
        parts_of = parts_of.join(whole, "part", "left").withColumn("part", F.coalesce("root", "part"))
    parts_of = settled(parts_of.select(F.col("node").alias("class_key"), "part", "first_id"))
    roots = parts_of.groupBy("part").agg(F.min("first_id").alias("component_id"))
    # Stored, so that the join with all rows is dealt by itself and a class with very many copies can be split.
    ids = settled(parts_of.join(roots, "part").select("class_key", "component_id"))
    out = rows.select("doc_id", "row_hash", "block", "row", "n_shingles", "class_key").join(ids, "class_key", "left")
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_hash", "block", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows are linked if 100 * intersection >= percent * union of their sets of
    distinct shingles of `words` words (A-Z lower-cased); with fewer words the
    whole sequence is the one shingle. Null, empty and blank texts have empty
    sets, are linked with nothing and are kept. component_id is the smallest
    doc_id that links reach (null ids only if there is no other); kept: doc_id
    equals it. Repeated rows stay, and any number of them is one class. Texts
    are taken whole. Other columns are ignored. No rows give no rows.
    """
    given = lean(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_hash"), "text")
    return _components(stored(given), text_bytes(given), words, percent).drop("row_hash", "block", "row")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names; of rows that repeat both id and text, one stays."""
    names = docs.columns
    others = F.struct(*(docs[f"`{n}`"] for n in names if n != "text"))
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row_hash"), others.alias("others"), docs["text"].isNull().alias("no_text"), docs["text"].alias("text"))
    texts = stored(given)
    found = _components(texts, text_bytes(given), words, percent).where("kept")
    chosen = found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)), "row_hash").agg(F.min(F.struct("block", "row")).alias("one")).select("one.block", "one.row")

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [t for _, run in texts_of(batch.column("packed")) for t in run]
        text = [None if no else t for t, no in zip(out, batch.column("no_text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("others"), pa.array(text, pa.binary()).cast(pa.string())], names=["others", "text"])

    kept = texts.select("block", "row", "others", "no_text", "packed").join(chosen, ["block", "row"]).select("others", "no_text", "packed")
    whole = map_batches(kept, unpack, StructType([StructField("others", given.schema["others"].dataType), StructField("text", StringType())]), 1 << 18)
    return whole.select(*(F.col("text") if n == "text" else F.col(f"others.`{n}`").alias(n) for n in names))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
