"""Language identification with hyperdimensional profiles.

Each letter of Unicode has a random vector of +1 and -1 of its own; upper and lower case share one. An n-gram is bound from its
letters' vectors, each rotated by its place, by multiplication; a text is the
bundle (sum) of its n-grams, and a language the bundle of its training texts.
A text gets the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import lean, map_batches, raw, remainder, table
from .words import BASE, mix

DIMENSIONS = 1024
SEED = 20_011
#: Bits of a letter in a trigram: any code point fits, so no two letters share a vector.
BITS = 21
SLICE = 2 << 20
COLUMNS = 4096
UNKNOWN = "und"


@lru_cache(1)
def codes() -> np.ndarray:
    """The letter of each code point: 0 is what is between words, 1-26 a to z, others their own lower-case code point."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else low
    return out


def vectors_of(letters: np.ndarray) -> np.ndarray:
    """[letters, DIMENSIONS] of +1 and -1, from a seeded hash of the letter."""
    words = np.uint64(DIMENSIONS // 64)
    bits = mix(mix(np.asarray(letters, np.uint64) + np.uint64(SEED << 32))[:, None] + np.arange(words, dtype=np.uint64) * BASE)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


@lru_cache(1)
def letters() -> np.ndarray:
    """The vectors of what is between words and of a to z."""
    return vectors_of(np.arange(27))


def vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, float32."""
    known, place = np.unique(np.stack([grams >> 2 * BITS, grams >> BITS & (1 << BITS) - 1, grams & (1 << BITS) - 1]), return_inverse=True)
    v, (first, second, third) = vectors_of(known), place.reshape(3, -1)
    return (np.roll(v, 2, 1)[first] * np.roll(v, 1, 1)[second] * v[third]).astype(np.float32)


def _counted(of: np.ndarray, gram: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and how often they are there (n times each)."""
    distinct, place = np.unique(gram, return_inverse=True)
    width = max(len(distinct), 1)
    if n is None:
        both, total = np.unique(of * width + place, return_counts=True)
    else:
        both, at = np.unique(of * width + place, return_inverse=True)
        total = np.bincount(at, n, len(both))
    return both // width, distinct[both % width], total


def _long_text(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams and counts of one text, a slice at a time; what is between words may go over slices, and so may trigrams."""
    decoded, carry, held = text.decode("utf-8", "replace"), np.zeros(1, np.int64), []
    for a in range(0, len(decoded) + 1, SLICE):
        part = decoded[a : a + SLICE] + (" " if a + SLICE > len(decoded) else "")
        code = codes()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = code > 0
        keep[1:] |= code[:-1] > 0
        keep[0] |= carry[-1] > 0
        code = np.concatenate([carry, code[keep].astype(np.int64)])
        gram, n = np.unique(code[:-2] << 2 * BITS | code[1:-1] << BITS | code[2:], return_counts=True)
        held.append((gram, n))
        carry = code[-2:]
    gram, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in held]), len(gram)).astype(np.int64)
    return gram[gram > 0], n[gram > 0]


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, trigram and count, sorted. Runs of what is no letter count as one boundary; each text has one at both ends."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        gram, n = _long_text(texts[0])
        return np.zeros(len(gram), np.int64), gram, n
    decoded = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.array([len(t) + 2 for t in decoded])
    points = np.frombuffer("".join(f" {t} " for t in decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
    code, of = codes()[points], np.repeat(np.arange(len(texts)), lengths)
    keep = code > 0
    keep[1:] |= code[:-1] > 0
    starts = np.cumsum(lengths) - lengths
    keep[starts] = True
    code, of = code[keep].astype(np.int64), of[keep]
    gram = code[:-2] << 2 * BITS | code[1:-1] << BITS | code[2:]
    inside = (of[:-2] == of[2:]) & (gram > 0)
    return _counted(of[:-2][inside], gram[inside])


def bundle(of: np.ndarray, gram: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """[rows, DIMENSIONS]: the sum of the counted trigrams' vectors, a bounded number of trigrams at a time."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    distinct, place = np.unique(gram, return_inverse=True)
    for start in range(0, len(distinct), COLUMNS):
        here = (place >= start) & (place < start + COLUMNS)
        counts = np.zeros((rows, min(COLUMNS, len(distinct) - start)), np.float32)
        counts[of[here], place[here] - start] = n[here]
        out += counts @ vectors(distinct[start : start + COLUMNS])
    return out


def _slices(texts: list[bytes]):
    """(start, end) of runs of texts of about SLICE bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # [languages, DIMENSIONS], of length 1 each

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in _slices(texts):
            of, gram, n = grams_of(texts[a:b])
            own = bundle(of, gram, n, b - a)
            length = np.linalg.norm(own, axis=1)
            has_letter = np.bincount(of, minlength=b - a) > 0
            if not self.languages:
                names += [UNKNOWN] * (b - a)
                scores += [0.0] * (b - a)
                continue
            cosine = own @ self.vectors.T / np.maximum(length, 1e-9)[:, None]
            best = cosine.argmax(1)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has_letter, strict=True)]
            scores += np.where(has_letter, np.clip(cosine[np.arange(b - a), best], 0, 1), 0.0).tolist()
        return names, scores


def learn(docs: DataFrame) -> Profiles:
    """Profiles from columns text and lang; rows where either is null are left out.

    What comes to the driver is one vector for each language.
    """

    def bundles(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = raw(batch.column("text")), batch.column("lang").to_pylist()
            for a, b in _slices(texts):
                known = sorted(set(langs[a:b]))
                of, gram, n = grams_of(texts[a:b])
                number = np.array([known.index(lang) for lang in langs[a:b]])
                sums = bundle(*_counted(number[of], gram, n), len(known))
                for lang, v in zip(known, sums, strict=True):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    given = lean(docs, text="text", lang="lang").dropna()
    parts = given.mapInArrow(bundles, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # Sums of whole numbers below 2^53 are exact in any order.
    rows = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    v = np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(-1, DIMENSIONS)
    return Profiles([r["lang"] for r in rows], (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every row; only the text is looked at.

    score is the cosine, at least 0. Texts that are null or have no letter are
    `und` with score 0, as are all texts when nothing was learned. Equal
    cosines: the language that sorts first. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(raw(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    given = lean(docs, doc_id="doc_id", text="text")
    return map_batches(given, over, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", SLICE)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(remainder("doc_id", 3) != 1))
    found = predict(docs, profiles)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
