"""Benchmark decontamination in DataFrame operations only.

The windows of benchmark items (WINDOW consecutive normalised words; a shorter item is one window) are hashed and
broadcast while their words and item lists take at most BROADCAST_BYTES. Each text is read and split once: the hashes of
its windows of every size are exploded beside its word array, with one more row that carries its number of words, and the
words of every hash hit are compared, so results are exact. A document without a hit sends just that row. Beyond
BROADCAST_BYTES only hash, document and place are shuffled to the benchmark's hashes; the words of what meets there are compared
after a join back to the texts. Hits are grouped by document, so a window that a third of all documents share loads no single task.

Null and empty texts have no words and no hits. A very long text is exploded like any other. Rows with equal doc_id and text
are repeated rows: each gets the same result. A row without a doc_id is a document too. Overlapping hits mark a word once.
Items without an item_id mark words but are not listed; equal items are listed each; without items nothing is hit. Only
doc_id, text, item_id are read, so further columns cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WINDOW, BROADCAST_BYTES = 10, 64 << 20
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str) -> Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _BREAKS), "")


def window_hashes(words: str, k: int) -> Column:
    """Hashes of all k-word windows; none where there are fewer words."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(F.col(words), i, k)))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """k, h, g (the words), items: one row for each distinct window."""
    b = bench.select(F.col("item_id").cast("string").alias("item"), normal_words("text").alias("w")).filter(F.size("w") > 0)
    b = b.withColumn("k", F.least(F.size("w"), F.lit(window)))
    b = b.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.expr("size(w) - k + 1")), lambda i: F.slice(F.col("w"), i, F.col("k")))))
    return b.groupBy("k", "g").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("g"))


def _place(sizes: list[int], n: Column, pos: Column) -> tuple[Column, Column]:
    """First word and number of words of the window at a place of the concatenated windows of all sizes; place 0 is none."""
    start, size, before = F.lit(-1), F.lit(0), F.lit(1)
    for k in sizes:
        here = pos >= before
        start, size = F.when(here, pos - before).otherwise(start), F.when(here, F.lit(k)).otherwise(size)
        before = before + F.greatest(n - (k - 1), F.lit(0))
    return start, size


def found_windows(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _text (hash of the text), n, span, items: a row without span and items for each row of docs, and one for each hit."""
    grams = benchmark_windows(bench, window)
    measured = grams.groupBy("k").agg(F.sum(F.aggregate("g", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8)).alias("words"), F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8)).alias("items"))
    rows = measured.collect()  # at most `window` rows
    sizes, small = sorted(r["k"] for r in rows), sum(r["words"] + r["items"] for r in rows) <= BROADCAST_BYTES
    side = grams.select("h", "g", "items")
    split = docs.select("doc_id", F.xxhash64("text").alias("_text"), normal_words("text").alias("_w"))
    none = F.expr("cast(array(null) as array<bigint>)")
    # An inner explode would infer a filter that computes the hashes once more, with the words split anew for each.
    every = split.withColumn("_hs", F.concat(none, *[window_hashes("_w", k) for k in sizes]))
    exploded = every.select("doc_id", "_text", "_w", F.posexplode_outer("_hs").alias("_pos", "h"))
    start, size = _place(sizes, F.size("_w"), F.col("_pos"))
    same = F.slice("_w", start + 1, size).between(F.col("g"), F.col("g"))  # an equality would become a second join key
    span = F.when(F.col("_pos") > 0, F.struct(start.alias("a"), (start + size).alias("b"))).alias("span")
    if small:
        joined = exploded.join(F.broadcast(side), (exploded["h"] == side["h"]) & same, "left").filter((F.col("_pos") == 0) | F.col("items").isNotNull())
        return joined.select("doc_id", "_text", F.size("_w").alias("n"), span, "items")
    met = exploded.select("doc_id", "_text", "_pos", "h").join(side, "h").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "_pos", "g", "items")
    split = split.dropDuplicates(["doc_id", "_text"])
    hit = split.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))).filter(same)
    marks = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.size(normal_words("text")).alias("n"))
    return marks.select("*", F.lit(None).cast("struct<a:int,b:int>").alias("span"), F.lit(None).cast("array<string>").alias("items")).unionByName(hit.select("doc_id", "_text", F.size("_w").alias("n"), span, "items"))


def grouped(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _text, copies, n_words, n_hit, items: one row for each doc_id and text."""
    found = found_windows(docs, bench, window)
    out = found.groupBy("doc_id", "_text").agg(
        F.count_if(F.col("span").isNull()).alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return out.select("doc_id", "_text", "copies", "n_words", covered.alias("n_hit"), "items")


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) for each row of docs(doc_id, text)."""
    g = grouped(docs, bench, window).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return g.select("doc_id", "n_words", "n_hit", F.sort_array("items").alias("items"))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns stay."""
    h = grouped(docs.select("doc_id", "text"), bench, window).filter("n_hit > 0").select(F.col("doc_id").alias("_hit_id"), F.col("_text").alias("_hit_text"))
    return docs.join(h, docs["doc_id"].eqNullSafe(h["_hit_id"]) & (F.xxhash64(docs["text"]) == h["_hit_text"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, p, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
