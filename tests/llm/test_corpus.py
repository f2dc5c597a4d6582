"""Corpus operators against slow models written from their definitions."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewright.llm import decontamination, fingerprints, language_id, license_scan, near_dedup, sharding, substring_dedup
from notewright.llm import suffix_tree_lm as lm

D = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def frame(spark, rows):
    """doc_id and text, beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, "x", 1, 1, 1) for r in rows], "doc_id long, text string, n_words int, a string, _a int, _key int, _hash int")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]


def removed(rows, window):
    words = [blank_words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


def test_substring_dedup(spark):
    assert ordered(substring_dedup.op3_substring_dedup(spark, D).collect()) == removed(documents(spark), 35)


def test_substring_dedup_small_windows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        alphabet = rng.choice(["x", "xy", "abcdefghij"])
        rows.append((rng.choice([i, i, None, 7]), " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))))
    rows += [(1, None), (2, ""), (3, "a\tb  c"), *rows[:5]]
    for window in (6, 35):
        out = substring_dedup.deduplicated(frame(spark, rows), window)
        assert ordered(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()) == removed(rows, window)
    same = substring_dedup.deduplicated(frame(spark, [(1, " a\n b ")]), whole=True).first()
    assert same.text == " a\n b " and same.a == "x"
    assert substring_dedup.deduplicated(frame(spark, rows).limit(0)).count() == 0


def test_substring_dedup_of_a_passage_in_a_third_of_all(spark, monkeypatch):
    """Its words are no minimisers, no bucket gets all of its surroundings, and the result is the same."""
    monkeypatch.setattr(substring_dedup, "LEAST", 4)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(240):
        own = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        rows.append((i, " ".join(own[:40] + (passage if i % 3 == 0 else []) + own[40:])))
    df = frame(spark, rows)
    often, size = substring_dedup.frequent_grams(df)
    assert len(often) == 47 and size > 0
    assert ordered(substring_dedup.deduplicated(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()) == removed(rows, 35)
    w = substring_dedup.words(pa.array([t for _, t in rows]), substring_dedup.BLANK_WORDS)
    most = []
    for frequent in (substring_dedup._NONE, often):
        first, count, minimiser = substring_dedup.super_kmers(w.hashes()[w.codes], w.offsets, frequent=frequent)
        flat = w.codes.tolist()
        strings = {(m, tuple(flat[a : a + n + 34])) for a, n, m in zip(first.tolist(), count.tolist(), minimiser.tolist())}
        most.append(max(collections.Counter(m for m, _ in strings).values()))
    assert most[0] >= 80 and most[1] <= 2


def linked(rows):
    sets = []
    for _, t in rows:
        w = blank_words(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    where, up = collections.defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for x in s:
            where[x].append(i)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), d), d)
    return ordered((d, len(sets[i]), first[root(i)], d == first[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_dedup(spark):
    rng, rows = random.Random(5), []
    for _ in range(20):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([2, 5, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 3000)}"
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "  \t"), (n + 3, "one two"), (n + 4, "ONE  two")]
    assert ordered(near_dedup.grouped(frame(spark, rows)).collect()) == linked(rows)
    assert near_dedup.grouped(frame(spark, rows).limit(0)).count() == 0
    repeated = near_dedup.grouped(frame(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (None, "c")])).collect()
    assert ordered(r[2:] for r in repeated) == ordered([(4, True), (4, True), (4, False), (None, True)])


def test_large_group_that_links_through_one_base(spark):
    """Variants alike to one text but not to each other, beside documents that share just a passage with it."""
    rng, rows = random.Random(8), []
    for g in range(3):
        base = [f"w{g}.{i}" for i in range(304)]
        rows.append((1000 + g, " ".join(base)))
        for i in range(220):
            w = list(base)
            for k in rng.sample(range(58), 7):
                w[7 + 5 * k] = f"v{g}.{i}.{k}"
            rows.append((g * 220 + i, " ".join(w)))
        rows += [(2000 + 40 * g + i, " ".join(base[:150] + [f"x{g}.{i}.{k}" for k in range(70)])) for i in range(40)]
    assert ordered(near_dedup.grouped(frame(spark, rows)).collect()) == linked(rows)


def test_large_regions_in_blocks(spark, monkeypatch):
    """Regions of several blocks lose no pair of theirs."""
    monkeypatch.setattr(near_dedup, "CROWD", 16)
    test_large_group_that_links_through_one_base(spark)


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near, far = list(base), list(base)
    for k in rng.sample(range(len(base)), 4_000):
        near[k] = "edited"
    for k in rng.sample(range(len(base)), 30_000):
        far[k] = "edited"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (9, "short text of six words here"), (1, "short text of six words here")]
    assert ordered(near_dedup.grouped(frame(spark, rows)).collect()) == linked(rows)


@pytest.fixture
def small_regions(monkeypatch):
    """Regions of over 24 nodes count as large; how often their shingles were asked for."""
    calls = []
    real = near_dedup.rare_regions
    monkeypatch.setattr(near_dedup, "WHOLE", 24)
    monkeypatch.setattr(near_dedup, "rare_regions", lambda *args: calls.append(1) or real(*args))
    return calls


def test_stars_in_large_regions(spark, small_regions):
    """A hub's 220 variants, in regions that are all too large to be compared as they are: no link is lost."""
    test_large_group_that_links_through_one_base(spark)
    assert small_regions


def test_crowded_regions_by_rare_shingles(spark, monkeypatch, small_regions):
    """800 texts with one passage, in regions that are too large: no link between different texts is lost."""
    monkeypatch.setattr(near_dedup, "CROWD", 24)
    rng, rows = random.Random(9), []
    shared = [f"s{i}" for i in range(200)]
    for g in range(400):
        own = [f"w{g}.{i}" for i in range(80)]
        for c in range(2):
            w = shared + own
            for _ in range(2 * c):
                w[rng.randrange(len(w))] = f"v{g}.{rng.random()}"
            rows.append((2 * g + c, " ".join(w)))
    assert ordered(near_dedup.grouped(frame(spark, rows)).collect()) == linked(rows)
    assert small_regions


@pytest.mark.parametrize("whole", [near_dedup.WHOLE, 128])
def test_recall_where_all_share_a_passage(spark, monkeypatch, whole):
    """3,000 texts, two thirds of each one passage: every near copy is found, in regions compared whole and by rare shingles."""
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    rng, rows, pairs = random.Random(12), [], 0
    shared = [f"s{i}" for i in range(160)]
    for g in range(1500):
        w = shared + [f"w{g}.{i}" for i in range(80)]
        v = list(w)
        for k in rng.sample(range(240), rng.choice([1, 2, 4, 5, 6])):
            v[k] = f"v{g}.{k}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        a, b = ({tuple(x[i : i + 5]) for i in range(236)} for x in (w, v))
        pairs += 100 * len(a & b) >= 75 * len(a | b)
    got = {r.doc_id: r.component_id for r in near_dedup.grouped(frame(spark, rows)).collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    found = sum(got[2 * g + 1] == 2 * g for g in range(1500))
    assert pairs > 1200 and 0.999 * pairs <= found <= pairs


def test_held_regions_stay_linked(monkeypatch):
    """A region cut into parts still hangs together by the rows they share."""
    monkeypatch.setattr(near_dedup, "HELD_ROWS", 20)
    rows = pa.table({"prefix": [5] * 100, "deep": list(range(100)), "deeper": [0] * 100, "node": list(range(100))})
    pairs = [p for b in near_dedup.offered(iter(rows.to_batches(max_chunksize=7))) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    reach = {0}
    for _ in range(100):
        reach |= {y for p in pairs if reach & set(p) for y in p}
    assert reach == set(range(100))


def suffix_tree(texts, deepest):
    """The model by its definition: counts of sequences, and the contexts kept."""
    c = [collections.Counter(tuple(w[i - k : i + 1]) for _, w, held in texts if not held for i in range(k, len(w))) for k in range(deepest + 2)]
    total, distinct = sum(c[0].values()), len(c[0])

    def p(s, x):
        if not s:
            return (c[0][(x,)] + 1) / (total + distinct + 1)
        return (c[len(s)][(*s, x)] + lm.SMOOTH * p(s[1:], x)) / (c[len(s) - 1][s] + lm.SMOOTH)

    considered, kept = [{()}], [{()}]
    for k in range(1, deepest + 1):
        considered.append({s for s, n in c[k - 1].items() if None not in s and n >= lm.MIN_CONTEXT and s[1:] in kept[-1] and s[:-1] in considered[-1]})
        kept.append({g[:-1] for g, n in c[k].items() if g[:-1] in considered[-1] and n >= 2 and n * math.log(n / (c[k - 1][g[:-1]] * p(g[1:-1], g[-1]))) >= lm.DIVERGENCE})
    return c, total, kept, p


def test_suffix_tree_scores(spark):
    rng = random.Random(3)
    refrain = [rng.choice("uvwxyz") for _ in range(40)]
    own = [" ".join(rng.choice("uvwxyz") for _ in range(30)) + " " + " ".join(refrain[: rng.randint(4, 40)]) for _ in range(120)]
    rows = [*documents(spark), (None, None), (1, ""), (2, "A b"), (2, "A b"), (3, " ".join(["long"] * 30_000)), *[(10**6 + i, t) for i, t in enumerate(own)]]
    texts = [(d, blank_words(lower(t)) + [None], d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in rows]
    c, total, kept, p = suffix_tree(texts, 14)
    assert kept[4] and not kept[14]
    want = []
    for d, w, held in texts:
        base = score = 0.0
        for i, x in enumerate(w):
            base += math.log10(p((), x))
            k = max(k for k in range(min(i, 13) + 1) if tuple(w[i - k : i]) in kept[k])
            score += math.log10(p(tuple(w[i - k : i]), x))
        want.append((d, held, len(w), sum(c[0][(x,)] > 0 for x in w), total, round(base, 4), round(score, 4)))
    df = frame(spark, rows).withColumn("held_out", lm.held_out())
    got = [(*r[:5], round(r[5], 4), round(r[6], 4)) for r in lm.scored(df).collect()]
    assert ordered(got) == ordered(want)
    assert lm.scored(df.limit(0)).count() == 0


def test_fingerprints(spark):
    cut = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) ", t) if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    rows = [(None, "x. y"), (5, None), (7, ""), (9, "a\nb\nc. d! e"), (10**12, "a\nb"), (11, "é é. ü"), *[(i, f"a. {i}. " + " ".join(f"{j % i}." for j in range(i % 40))) for i in range(100, 700)]]
    line = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (d, t) in enumerate(line):
        after, half = line[(i + 1) % len(line)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(cut(t), cut(edited)), 9), round(like(cut(t), cut(after)), 9)))
    out = fingerprints.fingerprinted(frame(spark, rows)).collect()
    assert ordered((*r[:3], round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == ordered(want)
    prints = {r.doc_id: r.fingerprint for r in out}
    assert prints[5] == prints[7] != prints[9]
    assert fingerprints.fingerprinted(frame(spark, rows).limit(0)).count() == 0
    named = fingerprints.fingerprinted(frame(spark, rows[3:6]).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))).collect()
    assert {r.doc_id for r in named} == {"k9", "k1000000000000", "k11"}


@pytest.mark.parametrize("ids", [
    [f"https://site/{n}" for n in range(5000)],
    [f"https://{s}/page-{n}" for s in ("a.example", "a.example/x", "b.example", "ü.example") for n in range(1200)] + ["", "https://a.example/page-1"],
    [n if n % 2 else n * n * 10**9 for n in range(5000)],
], ids=["urls", "sites", "numbers"])
def test_next_documents_by_ranges(spark, ids):
    """Ids that begin alike are spread over many buckets, and the next document is the next lower one, whatever the bucket."""
    kind = "string" if isinstance(ids[0], str) else "long"
    docs = spark.createDataFrame([(d, f"t{k}") for k, d in enumerate(ids)] + [(None, "none")], f"doc_id {kind}, text string")
    got = fingerprints.with_next(docs).collect()
    sizes = collections.Counter(r._bucket for r in got)
    assert len(sizes) >= 6 and max(sizes.values()) <= 4 * fingerprints.BUCKET_ROWS
    order = sorted(ids, key=lambda x: x.encode() if kind == "string" else x, reverse=True) + [None]
    assert collections.Counter((r.doc_id, r.next_id) for r in got) == collections.Counter(zip(order, [*order[1:], order[0]]))


def test_fingerprints_of_repeated_rows_and_long_texts(spark):
    """Repeated rows are rows of their own, one after the other; a very long text is one like any other."""
    long = "\n".join(f"paragraph {k} of many" for k in range(60_000))
    rows = [(1, "a. b"), (1, "a. b"), (2, long), (3, long), (3, long), (None, "z")]
    got = fingerprints.fingerprinted(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.near_next) for r in got)[1:3] == [(1, 4, 0.0), (1, 4, 1.0)]
    assert sorted((r.n_chars, r.near_next) for r in got if r.doc_id in (2, 3)) == [(len(long), 0.0), (len(long), 1.0), (len(long), 1.0)]
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1


def test_fingerprints_retry_wider(spark, monkeypatch):
    """Sketches that are too narrow do not peel; wider ones give the same rows."""
    rows = frame(spark, [(i, ". ".join(f"p{i % 4}.{j}" for j in range(40))) for i in range(60)])
    want = ordered(fingerprints.fingerprinted(rows).collect())
    monkeypatch.setattr(fingerprints, "LEAST_BITS", -20)
    monkeypatch.setattr(fingerprints, "differences", lambda rows, keys, pairs, wider=0, real=fingerprints.differences: real(rows, keys, pairs, wider - 5))
    assert ordered(fingerprints.fingerprinted(rows).collect()) == want


def test_sketches_give_back_the_differing_digests(spark):
    rng, sets = random.Random(6), []
    for i in range(300):
        a = {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 30, 200]))}
        b = {x for x in a if rng.random() < 0.7} | {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 40]))}
        sets.append((i, sorted(a), sorted(b)))
    df = spark.createDataFrame(sets, "id long, a array<long>, b array<long>")
    got = {(r.id, r.side, r.digest) for r in fingerprints.recovered(df, ["id"], "a", "b").collect()}
    assert got == {(i, side, x) for i, a, b in sets for side, only in (("left", set(a) - set(b)), ("right", set(b) - set(a))) for x in only}


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item, 0), (2, "short One", 0), (3, None, 0), (4, "...", 0), (None, "nameless", 0)], "item_id long, text string, h int")
    rows = [(1, f"x {item.upper()} y"), (2, " ".join(item.split()[:9])), (3, "a SHORT, one! short one"), (4, None), (5, ""), (1, f"x {item.upper()} y"), (None, "short-one nameless")]
    got = ordered((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contaminated(frame(spark, rows), bench).collect())
    assert got == ordered([(1, 16, 14, ("1",)), (1, 16, 14, ("1",)), (2, 9, 0, ()), (3, 5, 4, ("2",)), (4, 0, 0, ()), (5, 0, 0, ()), (None, 3, 3, ("2",))])
    assert sorted(r.doc_id for r in decontamination.clean(frame(spark, rows), bench).collect()) == [2, 4, 5]
    assert decontamination.contaminated(frame(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contaminated(frame(spark, rows).limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    want = ordered(decontamination.op4_decontamination(spark, D).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert ordered(decontamination.op4_decontamination(spark, D).collect()) == want
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(1, "zero one two three"), (1, "zero one two three"), (None, "ONE, two-three"), (2, None), (3, "x " * 50_000 + "one two three")]
    got = decontamination.contaminated(frame(spark, rows), bench).collect()
    assert ordered((r.doc_id, r.n_words, r.n_hit) for r in got) == ordered([(1, 4, 3), (1, 4, 3), (None, 3, 3), (2, 0, 0), (3, 50_003, 3)])


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(997)] + [(5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sharding.interleaved(df, "source", ["doc_id"], ["doc_id"], 16).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and {len(s) for s in slots.values()} == {62, 63}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for source in ("a", "b", None):
        each = [sum(r.shard == s and r.source == source for r in got) for s in range(16)]
        assert max(each) - min(each) <= 2
    assert sharding.interleaved(df.limit(0), "source", ["doc_id"], ["doc_id"], 16).count() == 0


def divided(got):
    """Groups of equal texts that stand in several shards, and whether the rows of each are neighbours."""
    at = collections.defaultdict(list)
    for place, r in enumerate(sorted(got, key=lambda r: (r.shard, r.slot))):
        at[r.text_crc32, r.size].append((place, r.shard))
    assert all(x[-1][0] - x[0][0] == len(x) - 1 for x in at.values())
    return sum(len({s for _, s in x}) > 1 for x in at.values())


def test_sharding_query(spark, tmp_path):
    """Sizes, checksums, law and slots of the query; 16 shards divide 15 groups of copies at most, also with a text that a third of all rows has."""
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"é text {i % 300}", rng.choice(["a", "a", None])) for i in range(3000)] + [(None, None, "a"), (None, "", None), (7, "x" * 200_000, "b")]
    for name, frame_, want in (("small", spark.createDataFrame(rows, "doc_id long, text string, source string"), rows), ("data", spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "source"), None)):
        frame_.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = want or [tuple(r) for r in frame_.collect()]
        got = sharding.op7_sharding(spark, f"{tmp_path}/{name}").collect()
        bare = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered((d, *bare(t)) for d, t, _ in want)
        assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert divided(got) <= 15


def test_sharding_of_larger_tables(spark):
    """Few groups are divided and the mixture holds: no source is off its share of a shard by more than its groups at the ends."""
    for name in ("sf0.01", "sf0.1"):
        got = sharding.op7_sharding(spark, f"/root/testdata/{name}").collect()
        assert divided(got) <= 15
        source = {r.doc_id: r.source for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "source").collect()}
        all_, each = collections.Counter(source[r.doc_id] for r in got), collections.Counter((r.shard, source[r.doc_id]) for r in got)
        copies = max(collections.Counter((r.text_crc32, r.size) for r in got).values())
        assert all(abs(each[s, x] - n / 16) <= 2 * copies + 0.1 * n / 16 + 2 for x, n in all_.items() for s in range(16))


@pytest.mark.parametrize("heavy", [1, 0])
def test_sharding_divides_heavy_groups(spark, monkeypatch, tmp_path, heavy):
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    test_sharding(spark)
    test_sharding_query(spark, tmp_path)


def test_sharding_keeps_columns(spark):
    """Columns named as the operator's own ones stay; a column shard is replaced."""
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 3, i * 5, 9) for i in range(40)], "doc_id long, source string, g long, at long, shard int")
    got = sharding.interleaved(df, "source", ["doc_id"], ["doc_id"], 4)
    assert got.columns == ["doc_id", "source", "g", "at", "shard", "slot"]
    assert all(r.g == 3 * r.doc_id and r["at"] == 5 * r.doc_id and r.shard < 4 for r in got.collect())


def test_license_scan():
    scanner, rng = license_scan.Scanner(), random.Random(3)
    some = [w for t, _ in scanner.templates for w in t] + ["zz", "cc", "by", "all", "rights", "general"] * 5
    texts = [" ".join(rng.choice([rng.choice(some), " ".join(rng.choice(scanner.templates)[0][rng.randrange(3) :])]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [None, "", "É cc é by", "CC-BY all rights Reserved."]
    for text, got in zip(texts, scanner.scanned(pa.array(texts))):
        w = plain_words(text)
        at = lambda p: [i for i in range(len(w)) if w[i : i + len(p)] == p]  # noqa: E731, B023
        base = {label for p, label in scanner.base if at(p)}
        assert got[0] == len(w) and sorted(got[1]) == sorted(i for p, _ in scanner.base for i in at(p)) and got[2] == sorted(base)
        assert {label for p, label in scanner.templates if at(p)} <= set(got[3]) and 0 <= got[4] <= 1


def test_license_labels_by_a_slow_model():
    """Matching statistics by comparing with every place of every template, chains by trying every predecessor."""
    scanner, rng = license_scan.Scanner(), random.Random(11)
    names = [(" ".join(t), t, label) for t, label in scanner.templates]

    def cut(t):
        a = rng.randrange(len(t))
        return t[a : a + rng.randint(1, 40)]

    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = list(rng.choice(names)[1])
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(["zz", "the", "software"])
            parts += [t if rng.random() < 0.4 else cut(t), ["filler"] * rng.choice([0, 2, 8, 9, 30])]
        texts.append([w for p in parts for w in p])

    def slow(w):
        longest = [max(k for k in range(e + 2) if not k or any(f" {' '.join(w[e + 1 - k : e + 1])} " in f" {n} " for n, _, _ in names)) for e in range(len(w))]
        spans = collections.defaultdict(list)
        for e, k in enumerate(longest):
            if k >= scanner.long and (e + 1 == len(w) or longest[e + 1] <= k):
                for i, (_, t, _) in enumerate(names):
                    spans[i] += [(e + 1 - k, b, b + k) for b in range(len(t) - k + 1) if t[b : b + k] == w[e + 1 - k : e + 1]]
        for i, (_, t, _) in enumerate(names):  # whole templates, also within a longer match
            spans[i] += [(x, 0, len(t)) for x in range(len(w) - len(t) + 1) if len(t) >= scanner.long and w[x : x + len(t)] == t]
        found, best = [], 0.0
        for i, own in spans.items():
            own, got = sorted(set(own)), []
            for x, a, b in own:
                steps = [(0, None, 0)]
                for j, (y, c, d) in enumerate(own[: len(got)]):
                    trim = max(0, d - a, y + d - c - x)
                    if c <= a and x - (y + d - c) <= license_scan.GAP and trim < b - a:
                        steps.append((got[j][0] - trim, j, trim))
                most = max(v for v, _, _ in steps)
                v, j, trim = next(s for s in steps if s[0] == most)
                got.append((v + b - a, (got[j][1] if j is not None else set()) | set(range(x + trim, x + b - a))))
            if got:
                most = max(g[0] for g in got)
                share, places = most / len(names[i][1]), next(g[1] for g in got if g[0] == most)
                best = max(best, share)
                if share >= scanner.covered:
                    found.append((share, names[i][2], places))
        labels = {g for s, g, at in found if s == 1 or not any(at <= more for _, other, more in found if other != g)}
        base = {g for p, g in scanner.base if any(w[i : i + len(p)] == p for i in range(len(w)))}
        return sorted(labels | base), max(best, 1.0 if base else 0.0)

    got = scanner.scanned(pa.array([" ".join(t) for t in texts]))
    assert [(g[3], round(g[4], 9)) for g in got] == [(a, round(b, 9)) for a, b in map(slow, texts)]
    assert sum(bool(g[3]) for g in got) > 60
    assert scanner.scanned(pa.array(["word " * 300_000 + "released under the mit license"]))[0][3:] == (["mit"], 1.0, (300_000, 300_004))
    for label in ("bsd-2-clause", "bsd-3-clause", "zlib", "isc", "mit"):
        assert label in scanner.scanned(pa.array([license_scan.TEMPLATES[label][-1]]))[0][3]


def test_license_chains():
    """Fragments far apart and notices without what tells them from others give no label; a notice with a word changed does."""
    far = " ".join(["filler"] * 2000)
    found = lambda text: license_scan.Scanner().scanned(pa.array([text]))[0]
    scattered = found(f"it was released under the sea {far} see the MIT License")
    assert scattered[3] == [] and scattered[4] == 0.6
    assert found(f"the MIT license {far} released under the")[3] == found("the mit license released under the")[3] == []
    assert found("licensed under the GNU General Public License")[3] == found("licensed under the GNU General Public License, version 4")[3] == ["gpl"]
    assert found("licensed under the GNU General Public License, version 2")[3] == ["gpl", "gpl-2.0"]
    assert found("licensed under the GNU General Public License, version 3")[3] == ["gpl", "gpl-3.0"]
    notice = license_scan.TEMPLATES["mit"][1].split()
    edited = found(f"{far} {' '.join([*notice[:12], 'whatever', *notice[13:]])} {far}")
    assert edited[3] == ["mit"] and 0.9 < edited[4] < 1 and edited[5] == (2000, 2000 + len(notice) - 1)


def test_license_frame(spark):
    rows = license_scan.licenses(frame(spark, [(None, None), (1, "Released under the MIT License."), (1, "Released under the MIT License.")])).collect()
    assert rows[0].score == 0 and rows[0].labels == "" and rows[0].first_word is None
    assert rows[1].labels == rows[2].labels == "mit" and rows[1].score == 1.0 and rows[1].n_base == 0
    assert license_scan.licenses(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark):
    model = language_id.learned(spark.createDataFrame([(i, t, g) for i in range(30) for t, g in (("the and of that", "en"), ("der die und das", "de"), ("le la et les", "fr"))] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, None, 0), (2, "12 !", 0), (3, "the and that", 0), (3, "der und das", 0)], "doc_id long, text string, score int")
    assert [r.lang_pred for r in language_id.identified(df, model).collect()] == ["und", "und", "en", "de"]
    assert {(r.lang_pred, r.score) for r in language_id.identified(df, None).collect()} == {("und", 0.0)}
    assert language_id.learned(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_language_of_a_text_depends_on_it_alone(spark):
    """Whatever rows and steps stand beside it; and features by a slow model."""
    one = pa.array(["a", "ab", "É x", "", "1"], pa.large_string())
    code, at = language_id.trigrams(one)
    for i, t in enumerate(one.to_pylist()):
        for other in ("b", "zz", "\xff"):
            pair, ends = language_id.trigrams(pa.array([other, t, other], pa.large_string()))
            assert pair[ends[1] : ends[2]].tolist() == code[at[i] : at[i + 1]].tolist()
        raw = bytes(language_id._TABLE[b] for b in (t + " ").encode())
        around = b" " + raw + b" "
        want = []
        for k in range(len(raw)):
            x = 0
            for b, m in zip(around[k : k + 3], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                x ^= b * m & 0xFFFFFFFF
            want.append(((x ^ (x >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20)
        assert code[at[i] : at[i + 1]].tolist() == want
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learned(docs)
    bare = {r.doc_id: r.text for r in docs.collect()}
    value = lambda text, k: sum(model.weights[c, k] for c in language_id.trigrams(pa.array([text], pa.large_string()))[0]) / (len(text.encode()) + 1) + model.weights[-1, k]

    def slow(text):
        sure, level, names = 1.0, -1, model.families
        while True:
            duels = [(model.pairs[k][1:], value(text, k)) for k in range(len(model.pairs)) if model.pairs[k][0] == level]
            scores = [[v if a == c else -v for (a, b), v in duels if c in (a, b)] for c in range(len(names))]
            rank = [sum(x > 0 for x in s) + 0.5 / (1 + math.exp(-max(-30, min(30, sum(s))))) for s in scores]
            best = rank.index(max(rank))
            sure *= 1 / (1 + math.exp(-2 * max(-15, min(15, min(scores[best], default=15)))))
            if level >= 0:
                return names[best], sure
            level, names = best, model.families[best]

    seen = {}
    for parts, size in ((1, 10_000), (7, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows = language_id.identified(docs.repartition(parts, F.xxhash64("text", F.lit(parts))), model).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        now = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in rows}
        assert now == (seen or now)
        seen = now
    for d, t in list(bare.items())[:60]:
        if t and any(c.isalpha() for c in t):
            name, sure = slow(t)
            assert seen[d][0] == name and abs(seen[d][1] - sure) < 1e-3


def test_language_sample_is_bounded(spark):
    """Rows that share a doc_id, or have none, count once for each text."""
    same = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "concat(if(id % 2 = 0, 'the and of ', 'der und die '), id div 2 % 50) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    more = spark.range(4_000).selectExpr("cast(null as long) as doc_id", "concat('le la ', id) as text", "'fr' as lang")
    model = language_id.learned(same.unionByName(more), sample=20)
    df = spark.createDataFrame([(1, "the of"), (2, "le la"), (3, "und die")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identified(df, model).collect()] == ["en", "fr", "de"]
    assert language_id.identified(spark.createDataFrame([(1, "der " * 400_000)], "doc_id long, text string"), model).first().lang_pred == "de"


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = lambda seed, n: " ".join(random.Random(seed).choice(["the", "and", "of", "house", "tree", "river", "stone", "under"]) + str(random.Random(seed * 1000 + i).randrange(10**6)) for i in range(n))
    item, passage = words(1, 20), words(2, 60)
    rows = [(0, words(3, 100)), (1, words(3, 100)), (2, words(4, 50) + " " + passage), (3, words(5, 50) + " " + passage), (4, words(6, 30) + " " + item), (5, "123 456"), (6, None), (7, words(7, 40)), (7, words(7, 40))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [0, 2, 3, 7]
    assert len(pipeline.STAGES) == 5 and out[2].n_ids == len(out[2].ids) > 0


def test_pipeline_stages_alone(spark, tmp_path):
    """Each stage on nulls in any column, repeated rows, shared ids, a very long text, clashing columns, and on no rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "zwölf " * 3 + "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda k, n: " ".join(f"word{k}x{i}" for i in range(n))
    rows = [(None, text(1, 50), "en", "s", None), (None, text(1, 49) + " end", None, None, 3), (None, text(2, 50), "en", "s", 1), (5, text(3, 50), "de", "s", 1), (5, text(4, 50), "de", "s", 1), (5, text(4, 50), "de", "s", 1), (6, text(3, 50), None, "s", 1), (7, None, "en", None, None), (8, "", "en", "s", 0), (9, text(9, 60_000), "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _hash int, root string, n_words int")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        kept[name] = sorted(((r.doc_id, getattr(r, "text", None) and r.text[:9]) for r in out.collect()), key=repr)
        assert out.columns == (pipeline.COLUMNS if name != "sentencepiece" else ["doc_id", "lang", "source", "n_ids", "ids"])
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert len(kept["language_id"]) == 8 and len(kept["decontamination"]) == len(kept["sentencepiece"]) == 10
    # One of the two null-id copies, the other null-id text, one of doc 5's copies, 5 instead of 6, and the texts without words.
    assert collections.Counter(d for d, _ in kept["near_dedup"]) == {None: 2, 5: 2, 7: 1, 8: 1, 9: 1}
    # Equal texts lose all their words, and so the document; the near copies lose what they share and keep their ends.
    assert collections.Counter(d for d, _ in kept["substring_dedup"]) == {None: 3, 7: 1, 8: 1, 9: 1}


def test_pipeline_by_brute_force(spark, tmp_path):
    """The middle stages over the smallest tables, from the language stage's rows, by the slow models."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    first = pipeline.identify_languages(spark, docs, D).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in first]
    keep = {d for d, _, _, kept in linked(rows) if kept}
    rows = [(d, t) for d, t in rows if d in keep]
    cut = removed(rows, 35)
    seen = collections.Counter(tuple(w[i : i + 35]) for w in (blank_words(t) for _, t in rows) for i in range(len(w) - 34))
    left = []
    for d, t in rows:
        w = blank_words(t)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        if len(gone) < len(w):
            left.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    assert len(cut) == len(rows)
    items = [plain_words(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(len(w), 10)]) for w in items if w for i in range(len(w) - min(len(w), 10) + 1)}
    sizes = {len(g) for g in windows}
    clean = [(d, t) for d, t in left if not any(tuple(w[i : i + k]) in windows for w in [plain_words(t)] for k in sizes for i in range(len(w) - k + 1))]
    import sentencepiece

    from notewright.llm import sentencepiece_codec as sp

    library = sentencepiece.SentencePieceProcessor(model_proto=sp.model_bytes())
    got = {r.doc_id: r.ids for r in pipeline.run(spark, D).collect()}
    assert got == {d: library.encode(t) for d, t in clean}


def test_a_dirty_language_column_is_bounded(spark, monkeypatch):
    """Thousands of labels: the most frequent ones are learnt, from so many rows in all; the rest are rows to predict like any other."""
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    monkeypatch.setattr(language_id, "TOTAL", 30)
    taken = []
    real = language_id.Model
    monkeypatch.setattr(language_id, "Model", lambda x, names: taken.append(collections.Counter(names)) or real(x, names))
    says = {"en": "the house and the garden of this year", "de": "das Haus und der Garten in diesem Jahr", "fr": "la maison et le jardin de cette ann\u00e9e"}
    rows = [(i, f"{says[g]} {i}", g) for i, g in enumerate(list(says) * 40)] + [(1000 + i, f"{says['de']} x{i}", f"label-{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identified(df.select("doc_id", "text"), language_id.learned(df)).collect()
    assert set(taken[0]) == set(says) and all(n == 10 for n in taken[0].values())
    assert all(r.lang_pred == "de" for r in out if r.doc_id >= 1000) and all(r.lang_pred == list(says)[r.doc_id % 3] for r in out if r.doc_id < 1000)


def test_language_model_is_fit_in_little_memory():
    """The rows of one pair at a time are held as doubles, once, and the weights are those of plain arrays."""
    rng, n = np.random.default_rng(3), 400
    x = (rng.random((n, language_id.DIMS)) ** 8).astype(np.float16)
    langs = [("de", "en")[k % 2] for k in range(n)]
    x[::2, :40] *= np.float16(1.5)
    whole = n * language_id.DIMS * 8
    tracemalloc.start()
    model = language_id.Model(x, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * whole, (peak, whole)
    wide = x.astype(np.float32)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-4
    rows = (wide - mean) / scale / np.sqrt(language_id.DIMS)
    side = np.where(np.arange(n) % 2 == 0, 1, -1).astype(np.float32)
    w, bias = language_id.machine(np.concatenate([rows, np.ones((n, 1))], axis=1), side)
    w = w / scale / np.sqrt(language_id.DIMS)
    assert np.allclose(model.weights[:, -1], np.append(w, bias - float(w @ mean)), rtol=1e-9, atol=1e-9)
