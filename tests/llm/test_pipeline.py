"""The pipeline against plain versions of its stages, each on what the stage before kept."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from chunkyard.llm import quality


def test_stages(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "bpe":
            got = {r["doc_id"]: r for r in out.collect()}
            assert {i: r["decoded"] for i, r in got.items()} == before
            assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())
            break
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.cache().collect()
        got = {r["doc_id"]: r["text"] for r in rows}
        assert len(got) == len(rows)
        given = list(before.items())
        if name == "quality_rules":
            for i, t in given:
                n, _, _, _, repeated = brute.statistics(t)
                assert i not in got or (n >= 50 and 2 * repeated <= n)
            assert len(got) > 0.5 * len(given)
        elif name == "line_dedup":
            assert {i: brute.sha(t.encode()) for i, t in got.items()} == {i: h for i, _, _, h in brute.line_dedup(given)}
        elif name == "near_dedup":
            assert set(got) == {i for i, _, c in brute.near(given, 5) if i == c}
        else:
            assert set(got) == {r[0] for r in brute.decontaminate(given, items) if not r[-1]}
        before, docs = got, out
    assert out.agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_of_odd_rows(spark, sf, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, no rows, and columns with the names that the operators use themselves."""
    clash = [F.lit(k).alias(n) for k, n in enumerate(("block", "row", "packed", "_b_keep", "_n_id", "b_doc", "n_hash", "mark", "hi", "token"))]
    given = {k: r for k, r in enumerate(odd_docs.collect())}
    for docs in (odd_docs.select("*", *clash), no_docs.select("*", *clash), odd_docs.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "bpe":
                assert out.count() == docs.count()
                break
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            n = out.count()
            assert n <= docs.count() and (name != "line_dedup" or n == docs.count())
    rows = bag_of(given.values())
    assert bag_of(corpus_pipeline.near_duplicates(spark, odd_docs, sf).where("text is null or text = ''").collect()) == [x for x in rows if x[1] in (None, "")]
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, sf).collect()
    assert sum(r["doc_id"] == 7 for r in kept) <= 2 and {r["doc_id"] for r in kept} >= {1, 2, 3}
    clean = corpus_pipeline.benchmark_passages(spark, odd_docs, sf).collect()
    assert bag_of(clean) == rows  # no benchmark passage in them
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, odd_docs, sf).collect()}.isdisjoint({1, 2, 3, 9})


def bag_of(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_of_a_very_long_text(spark, sf):
    """One text of 16 MB among others; nothing of it is left out."""
    line = " ".join(f"word{i}" for i in range(300))
    long = "\n".join(f"{k} {line} {k * 7}" for k in range(8000))
    docs = spark.createDataFrame([(1, long), (2, "short text " * 3), (3, long + " more")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).orderBy("doc_id").select("doc_id").collect()] == [1, 2]
    assert corpus_pipeline.benchmark_passages(spark, docs, sf).count() == 3
    sizes = quality.judge(docs, quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))).orderBy("doc_id").collect()
    assert [r["n_words"] for r in sizes] == [8000 * 302, 6, 8000 * 302 + 1]


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_first_stage_keeps_what_rules_and_trees_keep(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    trees = quality.learn(docs, labels)
    pass_base, want = set(), set()
    for r in docs.collect():
        n, _, _, _, repeated = brute.statistics(r["text"])
        if n >= 50 and 2 * repeated <= n:
            pass_base.add(r["doc_id"])
            if brute.margin(trees, r["text"]) <= 0:
                want.add(r["doc_id"])
    got = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    assert got == want and want < pass_base  # the trees reject some that the rules let pass
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & pass_base
    assert good and len(good - got) <= 0.05 * len(good)
