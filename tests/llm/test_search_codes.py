"""Lexical search and vector codes against slow models and DuckDB's SQL."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from notewright.llm import lexical_search as ls
from notewright.llm import vector_codes as vc

D = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    own = [(d, terms_of(t)) for d, t in docs]
    n, size = sum(1 for _, w in own if w), sum(len(w) for _, w in own)
    df = collections.Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        found = []
        for d, w in own:
            m, times = 10 + 90 * len(w) * n // max(size, 1), collections.Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * times[t] // (1000 * times[t] + 8 * m)) for t in set(terms_of(text)) if times[t])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name,module,sql,tables", [("op11_lexical_search", ls, ls.OP11_SQL, ("documents", "benchmark")), ("op12_vector_codes", vc, vc.OP12_SQL, ("embeddings",))])
def test_query_equals_sql(spark, name, module, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df, want = getattr(module, name)(spark, D), con.sql(sql)
    got = sorted(map(tuple, df.select(*want.columns).collect()))
    assert sorted(df.columns) == sorted(want.columns) and got == sorted(want.fetchall())


def test_search_of_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and items, clashing names; small shards and blocks."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "..."), (503, "AA bb " * 30_000), (7, "a b c"), (7, "a b c"), (None, "a b c"), (9, "é9 a_b"), *docs[:5]]
    items = [(1, "a b c"), (2, None), (3, "zz yy missing"), (3, "qq"), (None, "É9 é9 A"), (4, "!!"), (1, "a b c"), (5, "nowhere")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, query int, score int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ls.ranked(frame, asked).collect()), key=repr) == ranked(docs, items)
    assert ls.ranked(frame.limit(0), asked).count() == 0 and ls.ranked(frame, asked.limit(0)).count() == 0
    names = spark.createDataFrame([(f"id{d}", t) for d, t in docs if d is not None], "doc_id string, text string")
    assert sorted(map(tuple, ls.ranked(names, asked.filter("item_id = 4 or item_id = 1").distinct()).collect()), key=repr) == ranked([(f"id{d}", t) for d, t in docs if d is not None], [(1, "a b c"), (4, "!!")])


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BYTES", 10)
    monkeypatch.setattr(ls, "SHARD_DOCS", 7)
    docs = [(i, f"w{i % 5} w{i % 7} all") for i in range(60)]
    items = [(i, f"w{i} all") for i in range(8)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ls.ranked(frame, asked, 4).collect()), key=repr) == ranked(docs, items, 4)


def test_blocks_have_the_least_cost():
    """No cut of a list into blocks has less bound error, fixed costs included."""
    rng = np.random.default_rng(1)
    sizes = [1, 7, 0, 12, 30]
    share, ends = rng.integers(1, 100, sum(sizes)), np.cumsum(sizes)
    cuts, upto = ls.blocks_of(share, ends[[0, 1, 3, 4]], longest=6, fixed=50)
    begin = 0
    for n, (a, b) in zip((1, 7, 12, 30), zip([0, *upto[:-1]], upto)):
        own, least = share[begin : begin + n], [0] + [10**9] * n
        for i in range(1, n + 1):
            least[i] = min(least[i - k] + k * int(own[i - k : i].max()) + 50 for k in range(1, min(6, i) + 1))
        ends_, cost, last = [int(c) - begin for c in cuts[a:b]], 0, 0
        for e in ends_:
            assert 1 <= e - last <= 6
            cost, last = cost + (e - last) * int(own[last:e].max()) + 50, e
        assert last == n and cost == least[n]
        begin += n


def test_search_skips_blocks(spark):
    """A query whose best documents stand out reads a small part of its lists."""
    rng = random.Random(5)
    docs = [(i, " ".join(["x3 x4"] * (20 if 4000 <= i < 4040 else 0) + [f"x{rng.randrange(50)}" for _ in range(60)])) for i in range(8000)]
    terms, queries = ls.texts_as_terms(["x3 x4"])
    shards = ls.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), terms)
    n = ls.statistics(shards)
    index = ls.blocked(shards, n[ls.DOCS_OF], n[ls.WORDS_OF]).toArrow().to_batches()
    weights = np.array([ls.weight(n[ls.DOCS_OF], n[t]) for t in range(len(terms))])
    whole, read = 0, 0
    for batch in index:
        for i in range(batch.num_rows):
            shard = ls.Index(batch, i)
            found, scores, seen = ls.best(shard, queries[0], weights)
            whole, read = whole + len(shard.docs), read + seen
            score = np.zeros(shard.size, np.int64)
            np.add.at(score, shard.docs, weights[shard.terms[np.searchsorted(shard.ends, np.arange(len(shard.docs)), side="right")]] * shard.share)
            assert found.tolist() == np.lexsort((np.arange(len(score)), -score))[:10].tolist() and scores.tolist() == score[found].tolist()
    assert 0 < read < whole / 2


def plain_rounds(v, parts=8, entries=16, rounds=6):
    width = v.shape[1]
    at = [width * p // parts for p in range(parts + 1)]
    books, codes, error = [], [], np.zeros(len(v), np.int64)
    for a, b in zip(at, at[1:]):
        x, book = v[:, a:b], v[:entries, a:b].copy()
        far = lambda: ((x[:, None] - book[None]) ** 2).sum(axis=2)  # noqa: B023, E731
        for _ in range(rounds):
            own = far().argmin(axis=1)
            for e in range(len(book)):
                if (own == e).any():
                    book[e] = x[own == e].sum(axis=0) // int((own == e).sum())
        codes.append(far().argmin(axis=1))
        error += far().min(axis=1)
        books.append(book)
    return np.stack(codes, axis=1), error, books


@pytest.mark.parametrize("width", [8, 16, 37, 3])
def test_codes_equal_plain_rounds(spark, width, monkeypatch):
    """Repeated vectors, ties, nulls, non-finite components, uneven widths, several blocks in a partition."""
    monkeypatch.setattr(vc, "BLOCK", 150)
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(0, 0.2, (300, width)), rng.integers(-2, 3, (200, width)) / 4096, np.full((250, width), 0.125)]).astype(np.float32)
    rng.shuffle(x)
    rows = [(i * 2, x[i].tolist(), [None, 1, 2][i % 3], 5) for i in range(len(x))]
    odd = [(1, None, 1, 5), (3, [None] * width, 1, 5), (5, [float("nan")] * width, 1, 5), (7, [float("inf")] * width, None, 5), (9, [1.0] * (width + 1), 1, 5), (11, [], 1, 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, code int").repartition(3)
    out, books = vc.compressed(df)
    v = np.floor(x.astype(np.float64) * 4096).astype(np.int64)
    codes, error, want = plain_rounds(v)
    got = {r.vec_id: r for r in out.collect()}
    assert sorted(got) == [r[0] for r in rows]
    assert all(list(got[2 * i].code) == codes[i].tolist() and got[2 * i].error == error[i] and got[2 * i].label == [None, 1, 2][i % 3] for i in range(len(rows)))
    assert all((a == b).all() for a, b in zip(books, want))


def test_codes_of_few_and_large_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    big = [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (2, [0.5] * 8, None), (None, [0.25] * 8, None)]
    out, books = vc.compressed(spark.createDataFrame(big, schema))
    assert out.count() == 4 and {r.error for r in out.collect()} == {0} and len(books[0]) == 4
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vc.op12_vector_codes(spark, str(tmp_path)).count() == 0


def test_filtering_assigns_whole_subtrees():
    """Far more points than are compared: most go by their node's sum and count."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 8000)] + rng.integers(-40, 40, (8000, 8))).astype(np.int64)
    tree = vc.Tree(points)
    sums, counts, entry = tree.assigned(centres, places=True)
    own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (entry == own).all() and (counts == np.bincount(own, minlength=16)).all()
    assert all((sums[e] == points[own == e].sum(axis=0)).all() for e in range(16))
    compared = []
    spread = vc._spread
    try:
        vc._spread = lambda at, nodes: compared.append(int((at[nodes + 1] - at[nodes]).sum())) or spread(at, nodes)
        tree.assigned(centres)
    finally:
        vc._spread = spread
    assert compared[-1] < len(points) / 4
