"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that never occurs inside any vocabulary token can't be spanned
by a merge, so each place where such a pair stands is a certain cut. The
tokenizer's own splits (special tokens, then its word pattern) come first; the
cuts are made inside its words, and every fragment is encoded independently by
the library's merge model and remembered; the ids are then concatenated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, pre_tokenizers

from .frames import lean, pieces, raw, table

#: Words of a generation of what is remembered; it changes no result.
REMEMBERED = 1 << 17
LONGEST_REMEMBERED = 64

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Outside these blocks, `regex` and the library may know different versions of Unicode, so the library itself splits such texts.
UNSURE = regex.compile("[^\\u0000-\\u052F\\u2000-\\u206F]")

#: Characters of a long text that are split into words at once.
PIECE = 1 << 20
#: No word of the pattern goes from a character that is no blank over a blank, so before such a blank a text may be cut.
BETWEEN_WORDS = regex.compile(r"(?<=[^\s]) (?=[^\s])")


@lru_cache(1)
def byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(extra)) for b in range(256))


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE without normalizer)."""

    def __init__(self, spec: str) -> None:
        given = json.loads(spec)
        before, model = given["pre_tokenizer"], given["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or given["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        special = {a["content"]: a["id"] for a in given["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in given["added_tokens"]):
            raise ValueError("added tokens that take blanks or ask for word ends are not supported")
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        back = {c: b for b, c in enumerate(letters)}
        self.special = special
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.model = Tokenizer.from_str(spec).model
        self.token_bytes: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
        inside = np.zeros((256, 256), bool)
        for token, i in model["vocab"].items():
            if token in special:
                continue
            self.token_bytes[i] = bytes(back[c] for c in token)
            pair = np.frombuffer(self.token_bytes[i], np.uint8)
            inside[pair[:-1], pair[1:]] = True
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.inside = [row.tobytes() for row in inside]
        self.decimals = [b"%d" % i for i in range(len(self.token_bytes))]
        self.memory = _Memory(self)

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut wherever a byte pair stands that no token has inside."""
        parts, begin, row = [], 0, self.inside[word[0]] if word else b""
        for i, byte in enumerate(word):
            if i and not row[byte]:
                parts.append(word[begin:i])
                begin = i
            row = self.inside[byte]
        return [*parts, word[begin:]]

    def encode_word(self, word: str) -> tuple[int, ...]:
        parts = self.fragments(word.encode("utf-8", "surrogatepass"))
        return tuple([t.id for part in parts for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))])

    def encode_plain(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self._encode_piece(text)
        ids, at = [], 0
        while at < len(text):
            cut = BETWEEN_WORDS.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            ids += self._encode_piece(text[at:end])
            at = end
        return ids

    def _encode_piece(self, text: str) -> list[int]:
        if UNSURE.search(text):
            words = [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]
        else:
            words = self.pattern.findall(text)
        return list(chain.from_iterable(map(self.memory.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.encode_plain(text)
        ids, at = [], 0
        for m in self.special_pattern.finditer(text):
            ids += self.encode_plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.encode_plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Memory(dict):
    """Ids of words. Two generations: when the young one is full it becomes the old one, from which words that come again return."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.old.get(word)) is None:
            ids = self.codec.encode_word(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.old = {}
        self.clear()


@lru_cache(2)
def _codec(spec: str) -> Codec:
    return Codec(spec)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def spec_of(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer's file, read on the driver and sent out; its size is that of its vocabulary."""
    return spark.sparkContext.broadcast(Path(path or default_path()).read_text())


def coded(rows: DataFrame, f: Callable[[Codec, pa.RecordBatch], pa.RecordBatch], schema: str, path: str | None = None) -> DataFrame:
    """f over batches of rows, with the codec of the tokenizer's file."""
    spec = spec_of(rows.sparkSession, path)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for whole in batches:
            for batch in pieces(whole):
                yield f(codec, batch)
        codec.memory.forget()  # the worker lives on for other stages

    return rows.mapInArrow(over, schema)


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; other columns are ignored.

    Null and empty texts have no ids; repeated rows stay. Text that spells a
    special token gets that token's id, as the library does by default.
    """

    def over(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array(codec.encode(t.decode("utf-8", "replace")), np.int32) for t in raw(batch.column("text"))]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(f) for f in found], out=offsets[1:])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["doc_id", "ids"])

    return coded(lean(docs, doc_id="doc_id", text="text"), over, f"doc_id {_id_type(docs)}, ids array<int>", path)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (text, special tokens included) of every row; null ids are empty."""

    def over(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec.decode(i.tolist() if i is not None else []) for i in batch.column("ids").to_numpy(zero_copy_only=False)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return coded(lean(encoded, doc_id="doc_id", ids="ids"), over, f"doc_id {_id_type(encoded)}, ids array<int>, decoded string", path)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of every row: `decode` of `encode`, in one worker, so ids go out once."""

    def over(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(t.decode("utf-8", "replace")) for t in raw(batch.column("text"))]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(i) for i in ids], out=offsets[1:])
        flat_ids = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids)), pa.array(map(codec.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
        )

    return coded(lean(docs, doc_id="doc_id", text="text"), over, f"doc_id {_id_type(docs)}, ids array<int>, decoded string", path)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and of what they decode to; ids stay in the worker that made them."""

    def over(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in raw(batch.column("text")):
            ids = codec.encode(text.decode("utf-8", "replace"))
            rows.append((len(ids), hashlib.sha256(b",".join(map(codec.decimals.__getitem__, ids))).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
        n, ids, decoded = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = lean(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return coded(docs, over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
