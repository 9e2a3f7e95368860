"""Indexed and sparse search against exact search, and scorers."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, postings, retrieval
from quarry.plans import catalog

LARGE = "/root/testdata/sf0.1"


def pairs_of(rows):
    return {(r.query_id, r.vec_id) for r in rows}


def test_index_is_written_once_and_used_again(spark):
    queries, corpus = catalog.vectors(spark, LARGE)
    exact = pairs_of(retrieval.cosine_top_k(queries, corpus, k=10).collect())
    built = ann.Index.build(corpus)
    opened = ann.Index(spark, built.path)
    for half in (queries.filter("query_id % 100 = 0"), queries.filter("query_id % 100 <> 0")):
        asked = {r.query_id for r in half.collect()}
        made = ann.search(half, corpus, 10, index=built.path).collect()
        want = {p for p in exact if p[0] in asked}
        assert len(made) == len(want) and len(pairs_of(made) & want) >= 0.9 * len(want)
        assert all(r.rank == 1 and r.score == 1.0 for r in made if r.query_id == r.vec_id)
    n = corpus.count()
    assert opened.short_list(queries, 150).count() <= 0.1 * n * queries.count()  # scored exactly, of all pairs


def test_many_queries_take_several_passes(spark, monkeypatch):
    queries, corpus = catalog.vectors(spark, LARGE)
    index = ann.Index.build(corpus)
    once = pairs_of(index.top_k(queries, 5).collect())
    monkeypatch.setattr(ann, "TABLE_BYTES", 100_000)
    assert pairs_of(index.top_k(queries, 5).collect()) == once


def test_index_that_fails_gives_exact_rows(spark):
    import os

    queries, corpus = catalog.vectors(spark, "/root/testdata/sf0.01")
    exact = sorted(map(tuple, retrieval.cosine_top_k(queries, corpus, 3).collect()))
    assert sorted(map(tuple, ann.search(queries, corpus, 3, index="/nowhere/index").collect())) == exact
    index = ann.Index.build(corpus)
    folder = f"{index.path.removeprefix('file:')}/vectors"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            open(f"{folder}/{name}", "wb").write(b"no table")
    assert sorted(map(tuple, ann.search(queries, corpus, 3, index=index).collect())) == exact


def test_index_of_odd_vectors(spark):
    """Zero vectors, ties, fewer vectors than codewords, dimensions that are no multiple of a stretch, ids that are words."""
    rows = [(f"v{i}", [float(i % 3), 0.0, 0.0, 1.0, 2.0]) for i in range(9)] + [("zero", [0.0] * 5)]
    corpus = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = corpus.filter("vec_id in ('v1', 'zero')").select(F.col("vec_id").alias("query_id"), "embedding")
    made = ann.search(queries, corpus, 4, index=ann.Index.build(corpus)).collect()
    assert [r.vec_id for r in sorted((r for r in made if r.query_id == "v1"), key=lambda r: r.rank)][:3] == ["v1", "v4", "v7"]
    assert {r.score for r in made if r.query_id == "zero"} == {0.0}
    none = corpus.limit(0)
    with pytest.raises(ValueError, match="no vectors"):
        ann.Index.build(none)
    assert ann.search(queries, none, 4).collect() == [] and ann.search(queries.limit(0), corpus, 4, index=ann.Index.build(corpus)).collect() == []


def sparse(text):
    """Weights by bucket, from the description: the first word of a bucket counts."""
    import hashlib
    import re

    out, words = {}, re.findall(r"\w+", (text or "").lower())
    for w in words:
        bucket = int(hashlib.md5(w.encode()).hexdigest(), 16) % 1_000_000
        if out.setdefault(bucket, (w, 0))[0] == w:
            out[bucket] = (w, out[bucket][1] + 1)
    return {b: n for b, (_, n) in out.items()}


@pytest.fixture(scope="module")
def word_texts():
    draw = random.Random(8)
    usual = [f"w{i}" for i in range(30)]
    made = [" ".join(draw.choice(usual) for _ in range(draw.choice([3, 10, 60, 300]))) for _ in range(200)]
    made += [f"{made[k]} rare{k % 7} Straße naïve_1 ②" for k in range(40)]
    return [*enumerate(made), (900, None), (901, ""), (902, "?!"), (903, "w1 " * 5000)]


@pytest.mark.parametrize("size", [8, 1024])
def test_postings_give_the_full_product(spark, word_texts, size, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", size)
    queries = [(1, "rare3 straße"), (2, "w1"), (3, "W2 w2 w5 rare1"), (4, "unknown"), (5, None), (6, "w1 w2 w3 w4 w5 w6 w7 ②")]
    built = postings.Postings.build(spark.createDataFrame(word_texts, "doc_id bigint, text string"))
    made, met = postings.Postings(spark, built.path).search(spark.createDataFrame(queries, "query_id bigint, text string"), 5)
    vectors = {i: sparse(t) for i, t in word_texts}
    want = []
    for q, text in queries:
        own = sparse(text)
        scored = sorted(((-sum(n * v[b] for b, n in own.items() if b in v), i) for i, v in vectors.items() if own.keys() & v.keys()))[:5]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    counts = {r.query_id: (r.blocks, r.scored) for r in met.collect()}
    if size == 8:
        assert counts[2][0] > 20 and counts[2][1] < counts[2][0] / 2  # most blocks passed over


def test_first_word_of_a_bucket_counts(spark, monkeypatch):
    monkeypatch.setattr(postings.tx, "bucket_of", lambda word: F.length(word))
    made = postings.sparse_vectors(spark.createDataFrame([(1, "bb a aa c bb a")], "doc_id bigint, text string"), "doc_id")
    assert {(r.bucket, r.weight) for r in made.collect()} == {(1, 2), (2, 2)}


def test_groups_of_pairs_give_the_k_best(spark, monkeypatch):
    """Several groups on both sides, ties, copies, zero vectors, nulls and lengths that differ; no more than k rows of a query leave a group."""
    rng = random.Random(7)
    rows = [(i, [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)]) for i in range(150)]
    rows += [(150 + i, [1.0, 1.0, 0.0]) for i in range(40)] + [(190, [0.0] * 3), (191, None), (192, [1.0, None, 2.0]), (193, [1.0, 2.0]), (194, [float("nan"), 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = [r for r in rows if r[0] % 10 in (0, 1)] + [(193, [1.0, 2.0]), (194, rows[-1][1])]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<float>")

    def score(q, v):
        if q is None or v is None or len(q) != len(v) or None in q or None in v:
            return None
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        s = dot(q, v) / ((dot(q, q) ** 0.5 or 1.0) * (dot(v, v) ** 0.5 or 1.0))
        return s if s != s else round(s, 6)

    order = lambda s: (s is None, 0 if s is None else -9 if s != s else -s)  # noqa: E731  no number first, null last
    want = sorted((q, *[(v, str(s), n + 1) for n, (v, s) in enumerate(sorted(((v, score(qe, ve)) for v, ve in rows), key=lambda x: (order(x[1]), x[0]))[:7])]) for q, qe in asked)
    for name, most in (("GROUP_QUERIES", 9), ("GROUP_ROWS", 30), ("TILE_ROWS", 11)):
        monkeypatch.setattr(retrieval, name, most)
    real, left = retrieval.top, []
    monkeypatch.setattr(retrieval, "top", lambda scored, *a: left.append(scored) or real(scored, *a))
    got = {}
    for r in retrieval.cosine_top_k(queries, corpus, 7).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, str(r.score).replace("-0.0", "0.0") if r.score == 0 else str(r.score), r["rank"]))
    assert [(q, *sorted(v, key=lambda x: x[2])) for q, v in sorted(got.items())] == [(q, *[(v, s.replace("-0.0", "0.0") if s == "-0.0" else s, n) for v, s, n in own]) for q, *own in want]
    assert left[0].count() <= 7 * len(asked) * -(-len(rows) // 30)


def test_products_of_term_counts_leave_groups_as_the_k_best(spark, monkeypatch):
    """Frequent and rare words, ties, texts without words, ids twice, several groups: the same as all pairs, of which few are moved."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c dd ee".split() if rng.random() < 0.6 else [f"w{j}" for j in range(300)]) for _ in range(rng.randrange(25)))) for i in range(240)]
    rows += [(240 + i, "A b, b") for i in range(30)] + [(270, ""), (271, None), (5, "a a zz"), (None, "c c c")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    queries = corpus.filter("doc_id % 10 = 5 or doc_id in (270, 271)").select(F.col("doc_id").alias("query_id"), "text")
    want = sorted(map(tuple, retrieval.top(retrieval.sparse_scores(queries, corpus), "query_id", "score", "doc_id", 6).select("query_id", "rank", "score", F.coalesce("doc_id", F.lit(-1))).collect()))
    for name, most in (("GROUP_QUERIES", 9), ("GROUP_ROWS", 60), ("TILE_ROWS", 13)):
        monkeypatch.setattr(retrieval, name, most)
    real, left = retrieval.top, []
    monkeypatch.setattr(retrieval, "top", lambda scored, *a: left.append(scored) or real(scored, *a))
    got = retrieval.sparse_top_k(queries, corpus, 6).select("query_id", "rank", "score", F.coalesce("doc_id", F.lit(-1)))
    assert sorted(map(tuple, got.collect())) == want
    assert left[0].count() <= 6 * 26 * 5


def test_reranking_by_words_is_that_by_texts(spark):
    rows = [(i, f"word{i} a b c" if i % 3 else f"a a word{i - 1}") for i in range(12)] + [(12, ""), (13, None)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = spark.createDataFrame([(q, d) for q in (0, 1, 2, 12, 13) for d in (0, 1, 3, 4, 5, 12, 13, 99)], "query_id bigint, doc_id bigint")
    asked = texts.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    want = retrieval.two_stage(found.join(texts, "doc_id").join(asked, "query_id"), 3, 0.6)
    assert sorted(map(tuple, retrieval.two_stage_by_words(found, texts, 3, 0.6).collect())) == sorted(map(tuple, want.collect()))


def test_sparse_vectors_are_made_where_texts_stand(spark):
    """No text's words are moved to be counted; vectors are those of the description."""
    texts = spark.createDataFrame([(1, "b a a, c"), (2, ""), (3, None), (4, "Ä b_c 9 9")], "doc_id bigint, text string")
    made = postings.sparse_vectors(texts, "doc_id")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted((i, b, w) for i, t in ((1, "b a a, c"), (4, "Ä b_c 9 9")) for b, w in sparse(t).items())
