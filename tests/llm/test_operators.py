"""Each operator against a plain version: on all documents, on odd rows, and on no rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash
from brute import pairs
from pyspark.sql import functions as F

from chunkyard.llm import bpe, chat_format, context_tree, decontaminate, language_id, line_dedup, lm_score, near_dedup, quality, registry, shard, suffix_dedup
from chunkyard.llm.suffix_merge import decode_run, front_code, merge

ORACLES = registry.oracle_sql()


def bag(rows):
    return sorted(rows, key=str)


def tuples(df, *names):
    return bag(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert bag(map(str, got[order].itertuples(index=False, name=None))) == bag(map(str, want[order].itertuples(index=False, name=None)))


# 1: LM scoring


def test_lm_base_scores_and_held_out_gain(spark, sf, corpus):
    got = {r["doc_id"]: r for r in registry.queries()["op1_lm_score"](spark, sf).collect()}
    want = brute.base_scores(corpus)
    assert len(got) == len(corpus)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, brute.crc(i) % 5 == 1)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in got.values() if r["held_out"]]
    n_bytes = sum(len(brute.raw(t)) for i, t in corpus if got[i]["held_out"])
    assert -sum(r["score"] for r in held) / math.log10(2) / n_bytes < 3.2  # bits a byte; 8 without a model


def _plain_ctw(texts, depth, least, total):
    """log10 P of the next byte after each context, by the definition, on a tree of frequent contexts."""
    counts = {}
    for t in texts:
        s = bytes([255]) * context_tree.DEPTH + t + bytes([255])
        for i in range(context_tree.DEPTH, len(s)):
            for d in range(depth + 1):
                counts.setdefault(s[i - d : i], [0] * 256)[s[i]] += 1
    kept = {c for c, n in counts.items() if not c or sum(n) >= least}

    def bits(n, byte):
        out = []
        for level in range(8):
            lo, width = (byte >> (8 - level)) << (8 - level), 1 << (8 - level)
            out.append((sum(n[lo : lo + width // 2]), sum(n[lo + width // 2 : lo + width])))
        return out

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(c):
        return [bytes([x]) + c for x in range(256) if bytes([x]) + c in kept] if len(c) < depth else []

    def rest(c):
        return [n - sum(counts[k][i] for k in children(c)) for i, n in enumerate(counts[c])]

    def weighted(c, byte, level):
        a, b = bits(counts[c], byte)[level]
        if len(c) == depth:
            return log_kt(a, b)
        together = log_kt(*bits(rest(c), byte)[level]) + sum(weighted(k, byte, level) for k in children(c))
        x, y = math.log(0.5) + log_kt(a, b), math.log(0.5) + together
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    def predict(context, byte):
        total = 0.0
        for level in range(8):
            bit = byte >> (7 - level) & 1
            path = [context[len(context) - d :] for d in range(depth + 1)]
            path = [c for k, c in enumerate(path) if all(p in kept for p in path[: k + 1])]
            a, b = bits(counts[path[-1]] if len(path) == depth + 1 else rest(path[-1]), byte)[level]
            p = ((b if bit else a) + 0.5) / (a + b + 1)
            for c in reversed(path if len(path) <= depth else path[:-1]):
                za, zb = bits(counts[c], byte)[level]
                stop = math.exp(math.log(0.5) + log_kt(za, zb) - weighted(c, byte, level))
                p = stop * ((zb if bit else za) + 0.5) / (za + zb + 1) + (1 - stop) * p
            total += math.log10(p)
        return total

    return predict


def test_context_tree_is_the_definition():
    texts = [b"abracadabra", b"abab", b"cadabra" * 3]
    keys, counts = context_tree.merged(*(np.concatenate(x) for x in zip(*(context_tree.counted_grams([t]) for t in texts), strict=True)))
    least = 2
    tree = context_tree.build([context_tree.frequent(keys, counts, d, least if d else 0) for d in range(context_tree.DEPTH + 1)])
    predict = _plain_ctw(texts, context_tree.DEPTH, least, int(counts.sum()))
    for text in (b"", b"abra", b"xq"):
        s = bytes([255]) * context_tree.DEPTH + text + bytes([255])
        want = sum(predict(s[:i], s[i]) for i in range(context_tree.DEPTH, len(s)))
        assert tree.score([text])[0] == pytest.approx(want, abs=0.01)
    assert (10.0 ** tree.table.astype(float)).sum(1) == pytest.approx(1, abs=2e-3)


def test_lm_odd_rows(odd_docs, no_docs, spark):
    given = lambda df: df.select("doc_id", "text", (F.coalesce("doc_id", F.lit(0)) % 2 == 0).alias("training"))
    rows = lm_score.scores(given(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm_score.scores(given(no_docs)).count() == 0
    untrained = lm_score.scores(spark.createDataFrame([(1, "ab", False)], "doc_id long, text string, training boolean")).first()
    assert untrained["score"] == pytest.approx(3 * 8 * math.log10(0.5), abs=0.02)
    assert untrained["base_score"] == pytest.approx(0) and untrained["train_tokens"] == 0


def test_lm_keeps_rare_contexts_at_any_size(spark, sf, corpus):
    """The scores are those of one tree with all contexts that were seen twice, though there are more bytes than 2^18."""
    texts = {i: brute.raw(t).lower() for i, t in corpus}
    training = [t for i, t in texts.items() if brute.crc(i) % 5 != 1]
    assert sum(map(len, training)) > 1 << 18
    keys, counts = context_tree.counted_grams(training)
    tree = context_tree.build([context_tree.frequent(keys, counts, d, 2 if d else 0) for d in range(context_tree.DEPTH + 1)])
    for r in registry.queries()["op1_lm_score"](spark, sf).collect():
        assert r["score"] == pytest.approx(tree.score([texts[r["doc_id"]]])[0], rel=1e-4)


def test_lm_subtrees_of_any_run_are_one_tree(monkeypatch):
    texts = [b"abracadabra", b"abab", b"cadabra" * 3, "\u00e9t\u00e9 \u65e5\u672c".encode()]
    asked = [b"", b"abra", b"xq", b"cadabracadab"]
    keys = np.concatenate([context_tree.turned_grams(texts), context_tree.turned_grams(asked)])
    keys, counts = context_tree.merged(keys, np.arange(len(keys)) < len(context_tree.turned_grams(texts)))
    plain = context_tree.counted_grams(texts)
    tree = context_tree.build([context_tree.frequent(*plain, d, 2 if d else 0) for d in range(context_tree.DEPTH + 1)])
    for piece in (1, 7, 1 << 18):
        monkeypatch.setattr(context_tree, "PIECE", piece)
        places, one, two = (np.concatenate(x) for x in zip(*(context_tree.subtree(*p).sums() for p in context_tree.pieces(keys, counts)), strict=True))
        place, at = np.unique(places, return_inverse=True)
        above = context_tree.top(place, np.bincount(at, one), np.bincount(at, two))
        logs = np.concatenate([context_tree.answers(*p, above) for p in context_tree.pieces(keys, counts)]).astype(float)
        for text in asked:
            assert logs[np.searchsorted(keys, context_tree.turned_grams([text]))].sum() == pytest.approx(tree.score([text])[0], abs=0.01)


@pytest.mark.parametrize("size", [1, 5, 6, 7, 100])
def test_lm_grams_of_slices_are_those_of_whole_texts(size):
    texts = [b"", b"a", b"abcdef", b"abcdefg" * 5, b"xy", b"z" * 13]
    whole = [context_tree.turned_grams([t]) for t in texts]
    got = [[] for _ in texts]
    for grams, first, starts in context_tree.gram_runs(texts, size):
        for i, part in enumerate(np.split(grams, starts[1:]), first):
            got[i].append(part)
    assert all((np.concatenate(g) == w).all() for g, w in zip(got, whole, strict=True))


# 2: language ID


def test_language_held_out_accuracy(spark, sf, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in registry.queries()["op2_language_id"](spark, sf).collect() if r["held_out"]]
    assert all(brute.crc(r["doc_id"]) % 3 == 1 and 0 <= r["score"] <= 1 for r in held)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_predictions_are_the_definition(spark, sf, corpus, duck):
    """Letters, trigrams, bundles and cosines in plain steps, for every document of the query."""
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())

    def letters_of(text):
        out = [0]
        for c in text or "":
            low = ord(c.lower()[0]) if c.isalpha() else 0
            code = low - 96 if 97 <= low <= 122 else low
            if code or out[-1]:
                out.append(code)
        return out if out[-1] == 0 else [*out, 0]

    known = {}

    def bound(*three):
        if three not in known:
            x, y, z = (language_id.vectors_of(np.array([c]))[0].astype(int) for c in three)
            known[three] = np.roll(x, 2) * np.roll(y, 1) * z
        return known[three]

    def bundle(text):
        c = letters_of(text)
        total = np.zeros(language_id.DIMENSIONS, int)
        for three, n in Counter(zip(c, c[1:], c[2:], strict=False)).items():
            if any(three):
                total += n * bound(*three)
        return total

    own = {i: bundle(t) for i, t in corpus}
    profiles = {}
    for i, v in own.items():
        if brute.crc(i) % 3 != 1 and langs[i] is not None:
            profiles[langs[i]] = profiles.get(langs[i], 0) + v
    got = {r["doc_id"]: r for r in registry.queries()["op2_language_id"](spark, sf).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(own[i] @ p / np.linalg.norm(own[i]) / np.linalg.norm(p)) for k, p in profiles.items()}
        best = max(cosine.values())
        assert got[i]["score"] == pytest.approx(max(best, 0), abs=1e-4) and cosine[got[i]["lang_pred"]] == pytest.approx(best, abs=1e-4)


def test_language_of_long_texts_is_that_of_whole_ones(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab é日 .\n") for _ in range(n)).encode() for n in (40, 41, 300)]
    whole = [language_id.grams_of([t]) for t in texts]
    for size in (1, 2, 3, 17):
        monkeypatch.setattr(language_id, "SLICE", size)
        for t, (_, gram, n) in zip(texts, whole, strict=True):
            _, g, m = language_id.grams_of([t])
            assert (g == gram).all() and (m == n).all()


def test_language_vector_is_the_bundle_of_bound_letters():
    v = language_id.letters()
    of, gram, n = language_id.grams_of([b"Ab", b"", "é1é".encode()])
    own = language_id.bundle(of, gram, n, 3)
    a, b, none = v[1].astype(int), v[2].astype(int), v[0].astype(int)
    want = np.roll(none, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * none
    assert (own[0] == want).all() and not own[1].any() and own[2].any()


def test_language_letters_share_no_vector():
    for alphabet in ("abcxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿčšžőűłı", "абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґўџ", "あいうえおかきくけこ日本語中国\U00020000\U00020001"):
        own = language_id.bundle(*language_id.grams_of([c.encode() for c in alphabet]), len(alphabet))
        assert len(np.unique(own, axis=0)) == len(alphabet)
        assert abs((own @ own.T / language_id.DIMENSIONS - np.eye(len(alphabet)))).max() < 0.2
    upper, lower = (language_id.grams_of([t.encode()]) for t in ("ÑІЖ", "ñіж"))
    assert all((a == b).all() for a, b in zip(upper, lower, strict=True))


def test_language_odd_rows(odd_docs, no_docs):
    profiles = language_id.learn(odd_docs)
    rows = language_id.predict(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert language_id.predict(no_docs, profiles).count() == 0
    nothing = language_id.learn(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}


# 3: suffix dedup


def _suffix_digest(df):
    return bag((r["doc_id"], r["n_bytes"], sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)), len(r["starts"]), brute.sha(bytes(r["kept"]))) for r in suffix_dedup.repeated_spans(df).collect())


def test_suffix_dedup_is_exact(spark, sf, corpus):
    got = registry.queries()["op3_suffix_dedup"](spark, sf)
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bag(brute.repeats(corpus))


def test_suffix_dedup_of_overlapping_and_periodic_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = word(450), word(300)
    texts = [shared[:260] + word(90), word(50) + shared[100:], shared[200:420] + word(10), "z" * 700, "yz" * 150, other, word(30) + other[:199], other[50:250] * 3, "é" * 120 + other[100:], shared[150:349]]
    rows = list(enumerate(texts)) + [(20 + i, word(i) + shared[i : 230 + i] + word(7)) for i in range(0, 200, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _suffix_digest(df) == bag(brute.repeats(rows))


def test_suffix_dedup_of_hot_keys(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(450)
    cuts = [sorted((rng.randrange(451), rng.randrange(451))) for _ in range(40)]
    texts = [word(rng.randrange(90)) + shared[a:b] + word(rng.randrange(90)) for a, b in cuts]
    texts += [word(i) + shared + word(40) for i in range(20)] + [shared[:300]] * 2 + [shared * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_spans(df, most=4).collect()
    want = brute.repeats(list(enumerate(texts)))
    assert bag((r["doc_id"], sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)), brute.sha(bytes(r["kept"]))) for r in got) == bag((i, n, h) for i, _, n, _, h in want)


def test_suffix_dedup_odd_rows(odd_docs, no_docs):
    short = odd_docs.where("doc_id is null or doc_id <> 10 and doc_id <> 11")
    assert _suffix_digest(short) == bag(brute.repeats(pairs(short)))
    long = _suffix_digest(odd_docs.where("doc_id in (10, 11, 12)"))
    assert [r[2] for r in long if r[0] == 10] == [300_000]
    assert suffix_dedup.repeated_spans(no_docs).count() == 0


def test_loser_tree_merges_with_true_common_prefixes():
    rng = random.Random(2)
    for _ in range(100):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(15))) for _ in range(rng.randrange(7))]
        before = b""
        out = list(merge([decode_run(front_code(r)) for r in runs]))
        assert [s for _, s, _ in out] == sorted(x for r in runs for x in r)
        for _, s, shared in out:
            assert s[:shared] == before[:shared] and (shared in (len(s), len(before)) or s[shared] != before[shared])
            before = s


# 4: line dedup


def test_line_dedup_odd_rows(odd_docs, no_docs, spark):
    kept = line_dedup.keep_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    want = brute.line_dedup(pairs(odd_docs))
    assert bag((r["doc_id"], brute.sha(brute.raw(r["text"]))) for r in kept.collect()) == bag((i, h) for i, _, _, h in want)
    assert sum(n for _, _, n, _ in want) >= 3
    assert line_dedup.keep_lines(no_docs).count() == 0


def test_line_dedup_runs_over_partition_edges(spark):
    rows = [(i, f"one line that very many documents share\nown line of the document {i:05d}") for i in range(3000)] + [(i, "two documents have this longer line") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.keep_lines(df).where("text like 'one line%'").select("doc_id").collect()
    assert [r[0] for r in got] == [2999]
    assert line_dedup.keep_lines(df).where("text like 'two doc%'").count() == 2


def test_keep_bitmap_round_trip():
    for n, gone in ((1, [0]), (9, [8]), (20, [0, 7, 8, 19]), (16, list(range(16)))):
        lines = [b"line %d" % i for i in range(n)]
        bits = np.ones(max(gone) // 8 * 8 + 8, bool)
        bits[gone] = False
        text = b"\n".join(lines)
        total, dropped, kept = line_dedup.apply_bitmap(text, zlib.compress(np.packbits(bits).tobytes()))
        assert (total, dropped, kept) == (n, len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone))


# 5: decontamination


def _items(spark):
    passage = " ".join(f"word{i}" for i in range(20, 35))
    return spark.createDataFrame([(1, passage), (2, None), (3, ""), (None, "Same WORDS, in two"), (4, "x"), (5, passage), (6, "...")], "item_id long, text string")


def _contaminated(found):
    return bag((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"]).encode()), r["n_hit"] > 0) for r in found.collect())


@pytest.mark.parametrize("bits", [28, 3])  # a filter that holds nearly everything changes nothing
def test_decontamination_odd_rows(spark, odd_docs, no_docs, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    got = _contaminated(decontaminate.contamination(odd_docs, _items(spark)))
    assert got == bag(brute.decontaminate(pairs(odd_docs), [(r["item_id"], r["text"]) for r in _items(spark).collect()]))
    monkeypatch.setattr(decontaminate, "SENT_WHOLE", bits - 3)
    clean = decontaminate.clean_documents(odd_docs.withColumn("mark", F.lit(1)), _items(spark))
    assert clean.columns == [*odd_docs.columns, "mark"] and clean.count() == sum(not r[-1] for r in got)
    assert decontaminate.contamination(no_docs, _items(spark)).count() == 0
    none = decontaminate.contamination(odd_docs, _items(spark).limit(0)).collect()
    assert len(none) == odd_docs.count() and all(r["n_hit"] == 0 and r["spans"] == [] for r in none)


def test_decontamination_of_overlapping_windows_and_common_words(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("ab")
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 14)))) for i in range(30)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert _contaminated(found) == bag(brute.decontaminate(docs, items))


# 6: BPE


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, sf, corpus, library):
    got = registry.queries()["op6_bpe"](spark, sf)
    want = []
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == bag(want)


def test_bpe_odd_rows_round_trip(spark, odd_docs, no_docs, library):
    coded = bpe.decode(bpe.encode(odd_docs)).collect()
    texts = pairs(odd_docs)
    assert bag((r["doc_id"], r["decoded"]) for r in coded) == bag((i, t or "") for i, t in texts)
    assert bag((r["doc_id"], list(r["ids"])) for r in coded) == bag((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert bpe.encode(no_docs).count() == 0


def test_bpe_of_rare_letters_and_cuts(library):
    codec = bpe.Codec(open(bpe.default_path()).read())
    for text in ["a՘b", " 　 x", "a​b'S's", "\x00\x1f \x85 ", "\U0003134a\U0003134a 1", "é€", "  \n\n  a", "x" * 3000, "<|endoftext|><|endo"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert b"".join(codec.fragments("qzé日".encode())) == "qzé日".encode() and len(codec.fragments("é日".encode())) > 1


def test_bpe_of_long_texts_is_that_of_whole_ones(library, monkeypatch):
    codec, rng = bpe.Codec(open(bpe.default_path()).read()), random.Random(9)
    texts = ["".join(rng.choice("ab1'sS.é \n\t") for _ in range(rng.randrange(80))) for _ in range(300)] + ["x" * 50, " " * 30, "a  b " * 9]
    for size in (1, 4, 11):
        monkeypatch.setattr(bpe, "PIECE", size)
        for t in texts:
            assert codec.encode(t) == library.encode(t, add_special_tokens=False).ids


# 7: sharding


def _plain_shards(docs, shards=24):
    """The tree by plain sorting: shard of each text."""
    dims = ["doc_id", "n_chars", "source", "lang"]
    word = lambda c: ord(c[0]) * 256 + ord(c[-1]) if c else 0
    units = {}
    for i, t, lang, source, n in docs:
        own = dict(zip(dims, (i, n, word(source), word(lang)), strict=True))
        u = units.setdefault(t, {"weight": 0, **own})
        u["weight"] += len(brute.raw(t)) + 8
        u |= {d: min(u[d], own[d]) for d in dims}
    for d in dims:
        low, high = min(u[d] for u in units.values()), max(u[d] for u in units.values())
        for t, u in units.items():
            place = math.floor((float(u[d]) - float(low)) * (shard.SCALE / max(float(high) - float(low), 1e-9)))
            u["key " + d] = min(max(place, 0), shard.SCALE) * shard.TIES + (xxhash.xxh64_intdigest(brute.raw(t), 42) & (shard.TIES - 1))
    out = {}

    def split(mine, first, n):
        if n == 1 or not mine:
            out.update({t: first for t in mine})
            return
        wide = max(dims, key=lambda d: max(units[t]["key " + d] // shard.TIES for t in mine) - min(units[t]["key " + d] // shard.TIES for t in mine))
        mine = sorted(mine, key=lambda t: units[t]["key " + wide])
        want, total, at = sum(units[t]["weight"] for t in mine) * (n // 2) / n, 0, 0
        while total + units[mine[at]]["weight"] < want:
            total += units[mine[at]]["weight"]
            at += 1
        at += not want - total < total + units[mine[at]]["weight"] - want
        split(mine[:at], first, n // 2)
        split(mine[at:], first + n // 2, n - n // 2)

    split(list(units), 0, shards)
    return out


def test_shards_are_those_of_a_plain_tree(spark, sf, duck):
    docs = duck.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    want = _plain_shards(docs)
    got = registry.queries()["op7_shard"](spark, sf)
    assert tuples(got, "doc_id", "size", "text_crc32", "law", "shard") == bag((i, len(brute.raw(t)) + 8, zlib.crc32(brute.raw(t)), "bytes", want[t]) for i, t, *_ in docs)
    assert all(r["grown_shard"] is None for r in got.collect())

def test_shards(spark, sf, duck):
    rows = registry.queries()["op7_shard"](spark, sf).toPandas()
    docs = duck.execute("SELECT doc_id, text, octet_length(encode(text)) + 8 AS size FROM documents").df().merge(rows, on="doc_id", suffixes=("", "_got"))
    assert len(rows) == len(docs) and (docs["size"] == docs["size_got"]).all()
    assert docs.groupby("text")["shard"].nunique().max() == 1
    sizes, largest = docs.groupby("shard")["size"].sum(), docs.groupby("text")["size"].sum().max()
    assert sorted(sizes.index) == list(range(24)) and sizes.max() - sizes.min() <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])


def test_shards_odd_rows(odd_docs, no_docs):
    rows = shard.shard_by_bytes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["shard"] < 24 for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert shard.shard_by_bytes(no_docs).count() == 0


# 8: quality


def test_quality_statistics(spark, sf, corpus):
    rows = {r["doc_id"]: r for r in registry.queries()["op8_quality"](spark, sf).collect()}
    for i, t in corpus:
        n, chars, symbols, dup, repeated = brute.statistics(t)
        r = rows[i]
        assert tuple(r[c] for c in quality.BASE) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["base_failed"] and r["kept"])


def test_quality_verdicts_are_those_of_a_walk(spark, sf, corpus):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    trees = quality.learn(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in registry.queries()["op8_quality"](spark, sf).collect()}
    for i, t in corpus:
        n, _, _, _, repeated = brute.statistics(t)
        assert got[i] == (n >= 50 and 100 * repeated <= 50 * n and brute.margin(trees, t) <= 0)


def test_quality_held_out_accuracy(spark, duck):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    x = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    import pyarrow as pa

    bad = trees.margin(quality.statistics(pa.array(x["text"]))[1]) > 0
    truth = (x["quality"] == 0).to_numpy()
    assert (bad == truth).mean() > 0.9 and (bad & ~truth).sum() <= 0.05 * (~truth).sum()


def test_trees_are_monotone_and_score_like_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    bad = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0.5) ^ (x[:, 1] > 0.8)
    trees = quality.fit(x, bad, rising=(0,), n_trees=15, depth=3)
    grid = np.repeat(x[:40], 21, axis=0)
    grid[:, 0] = np.tile(np.linspace(-0.1, 1.1, 21), 40)
    assert (np.diff(trees.margin(grid).reshape(40, 21), axis=1) >= -1e-9).all()
    for row, want in zip(x[:20], trees.margin(x[:20]), strict=True):
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > t[i])
            total += v[i - len(f)]
        assert total == pytest.approx(want)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, None), (None, 1, 0), (5, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for trees in (quality.learn(odd_docs, labels), quality.learn(odd_docs, labels.limit(0)), quality.learn(no_docs, labels)):
        rows = quality.judge(odd_docs, trees).collect()
        assert len(rows) == odd_docs.count() and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 9))
        assert quality.keep_good(odd_docs, trees).columns == odd_docs.columns
    assert quality.judge(no_docs, trees).count() == 0


# 9: chat formatting


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", "</s>[INST] \\[INST] \\\\ <<s>>", 7), (1, 1, "assistant", None, 7), (1, 1, "assistant", "b", 7), (1, None, "system", "", 7), (1, 1, "assistant", "b", 7),
        (None, 5, "user", "null conversation", 7), (2, 0, None, "role is null", 7), (2, 1, "tool [ROLE] x", "[OUT]", 7), (3, 0, "assistant", "first", 7), (4, 0, "user", "[", 7), (4, 1, "assistant", "<\\", 7),
        *((5, t, "user" if t % 2 == 0 else "assistant", f"turn {t} é🙂", 7) for t in range(150)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    segments = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert set(out) == {1, 2, 3, 4, 5, None}
    for conv in out:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[conv]["n_turns"] == len(turns)
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(s["text"] for s in segments[conv]["segments"]) == segments[conv]["formatted"]
        assert out[conv]["formatted_chars"] == len(segments[conv]["formatted"])
    assert [out[c]["valid_order"] for c in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_template_rejects_marks_that_texts_could_complete():
    with pytest.raises(ValueError):
        chat_format.Template(roles={"user": chat_format.Role("[U]", "[/U]")}, open="<s>", close="s>", other=("[R]", "[/R]"))


# 10: near-duplicates


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_exact(spark, sf, corpus, words):
    got = near_dedup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), words=words)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == bag(brute.near(corpus, words))


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BUCKET", 40)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 150, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df, words=2)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == bag(brute.near(rows, 2))


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs, words=2)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == bag(brute.near(pairs(odd_docs), 2))
    assert all(r["kept"] for r in got.collect() if r["doc_id"] in (1, 2, 3))
    one = near_dedup.one_of_each(odd_docs, words=2)
    assert one.columns == odd_docs.columns and one.where("doc_id = 7").count() == 2 and one.where("doc_id = 8").count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_chains_and_many_small_parts(spark, monkeypatch):
    """Links that hold only between neighbours, so that stars find few of them and blocks have to find the rest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STAR", 3)
    words, rows = [f"w{i}" for i in range(400)], []
    for i in range(60):
        rows.append((i, " ".join(words[2 * i : 2 * i + 40])))
    rows += [(100 + i, " ".join(words[200 + 9 * i : 200 + 9 * i + 60])) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df, words=2)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == bag(brute.near(rows, 2))


def test_near_duplicates_of_very_many_repeated_rows(spark):
    """100,000 rows of one text without an id, and near copies of it: one class, and texts that are compared are read once."""
    base = [f"w{i}" for i in range(40)]
    text, near, other = (" ".join(x) for x in (base, [*base[:-1], "x"], [f"y{i}" for i in range(40)]))
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(5, near), (6, near), (9, other)], "doc_id long, text string"))
    got = near_dedup.near_duplicates(rows, words=2).groupBy("doc_id", "component_id", "kept").count().collect()
    assert bag(tuple(r) for r in got) == bag([(None, 5, False, 100_000), (5, 5, True, 1), (6, 5, False, 1), (9, 9, True, 1)])
    assert near_dedup.one_of_each(rows.withColumn("block", F.lit("b")), words=2).select("doc_id", "block").collect() == [(5, "b"), (9, "b")]


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[100:1050]), np.unique(pool[1000:])]
    sketches = near_dedup.odd_sketches(np.array([near_dedup.samples(s) for s in sets]))
    ones = lambda a, b: int(np.bitwise_count(sketches[a] ^ sketches[b]).sum())
    assert ones(0, 1) <= near_dedup.most_ones(80) < ones(0, 2)
