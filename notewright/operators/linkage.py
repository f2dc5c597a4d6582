"""Record linkage: catalogue hits, swapped fields, nearest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def catalogue_hit(recordings: DataFrame, artists: DataFrame) -> DataFrame:
    """The first recording(query, ord, title, credits array<string>) with a credit among artists(query, artist), in order, then by credit."""
    flat = recordings.select("query", "ord", "title", F.posexplode("credits").alias("credit_no", "artist"))
    hit = flat.join(artists.select("query", "artist"), ["query", "artist"], "left_semi")
    return hit.groupBy("query").agg(F.min_by(F.struct("title", "artist"), F.struct("ord", "credit_no")).alias("b")).select("query", "b.*")


def same_artist(records: DataFrame, wanted: str) -> DataFrame:
    """Records whose credit phrase is the wanted artist (a column), punctuation and case aside."""
    return records.filter(E.clean(F.col("phrase")) == E.clean(F.col(wanted)))


def last_contained(queries: DataFrame, records: DataFrame) -> DataFrame:
    """The last record(query, ord, title) whose cleaned title stands in the cleaned query."""
    both = queries.join(records, "query").filter(F.contains(E.clean(F.col("text")), E.clean(F.col("title"))))
    return both.groupBy("query").agg(F.max_by("title", "ord").alias("title"))


def one_line_hit(queries: DataFrame, recordings: DataFrame, artists: DataFrame) -> DataFrame:
    """For queries(query, text): the last recording(query, ord, title, phrase, credits) by the found artist whose title stands in the text.

    The found artist is the credit phrase of the first recording with a credit (null: a join phrase) among artists(query, artist).
    """
    flat = recordings.select("query", "ord", "phrase", F.posexplode("credits").alias("credit_no", "artist"))
    hit = flat.join(artists.select("query", "artist"), ["query", "artist"], "left_semi")
    found = hit.groupBy("query").agg(F.min_by("phrase", F.struct("ord", "credit_no")).alias("_wanted"))
    own = same_artist(recordings.join(found, "query"), "_wanted")
    text = queries.select("query", E.plain_title(E.clean(F.col("text"))).alias("text"))
    both = text.join(own, "query").filter(F.contains(E.clean(F.col("text")), E.clean(F.col("title"))))
    return both.groupBy("query").agg(F.max_by(F.struct("phrase", "title"), "ord").alias("b")).select("query", F.col("b.phrase").alias("artist"), "b.title")


def indel_ratio(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over the sum of lengths; 1 for two empty strings. A fold over the letters, in the JVM."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    right = letters(b)
    zero = F.transform(F.array_append(right, F.lit("")), lambda _: F.lit(0))  # row[j]: common with the first j letters of b

    def step(row: Column, x: Column) -> Column:
        # Rows never fall, so the new one is a running maximum of the old one and of the diagonals that match.
        grown = lambda out, y, j: F.array_append(out, F.greatest(F.element_at(out, -1), F.get(row, j + 1), F.when(y == x, F.get(row, j) + 1).otherwise(0)))
        pairs = F.transform(right, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(pairs, F.array(F.lit(0)), lambda out, p: grown(out, p["y"], p["j"]))

    common = F.element_at(F.aggregate(letters(a), zero, step), -1)
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * common / F.greatest(size, F.lit(1)))


def two_way_hit(queries: DataFrame, records: DataFrame) -> DataFrame:
    """For queries(query, artist, title): a record(query, side, ord, phrase, title), side 1 found as asked, side 2 with both swapped.

    Of records by the asked artist the side with the likest title gives its first one (a tie: side 2); if just one side has any,
    that side; if none has, the first record at all, of side 1 before side 2. A query without records is left out.
    """
    asked = queries.select("query", F.col("artist").alias("_a"), F.col("title").alias("_t"))
    x = records.withColumnRenamed("title", "_own").join(asked, "query")
    x = x.withColumns({"_artist": F.when(F.col("side") == 1, F.col("_a")).otherwise(F.col("_t")), "_title": F.when(F.col("side") == 1, F.col("_t")).otherwise(F.col("_a"))})
    x = x.withColumn("_same", E.clean(F.col("phrase")) == E.clean(F.col("_artist")))
    x = x.withColumn("_r", F.when(F.col("_same"), indel_ratio(E.clean(F.col("_own")), E.clean(F.col("_title")))))
    sides = x.groupBy("query", "side").agg(F.max("_r").alias("r"), F.min_by(F.struct("phrase", F.col("_own").alias("title")), F.when(F.col("_same"), F.col("ord"))).alias("own"), F.min_by(F.struct("phrase", F.col("_own").alias("title")), "ord").alias("any"))
    best = sides.groupBy("query").agg(F.max_by(F.struct("side", "r", "own", "any"), F.struct(F.coalesce("r", F.lit(-1.0)), F.when(F.col("r").isNull(), -F.col("side")).otherwise(F.col("side")))).alias("b"))
    row = F.when(F.col("b.r").isNotNull(), F.col("b.own")).otherwise(F.col("b.any"))
    return best.select("query", F.col("b.side").alias("side"), row["phrase"].alias("artist"), row["title"].alias("title"))


def release_facts(records: DataFrame, groups: DataFrame, images: DataFrame) -> DataFrame:
    """records(query, releases array<struct<id, group_id>>) with year and cover_url.

    Year: the first release's group(group_id, first_date), up to its first dash. Cover: of the first release with images(release_id, ord,
    front, url) that has a front one, the first front one. Null where nothing is found.
    """
    flat = records.select("query", F.posexplode_outer("releases").alias("_n", "_r")).select("query", "_n", F.col("_r.id").alias("release_id"), F.col("_r.group_id").alias("group_id"))
    year = flat.filter("_n = 0").join(groups, "group_id").select("query", F.split_part(F.trim("first_date"), F.lit("-"), F.lit(1)).alias("year"))
    cover = flat.join(images.filter("front"), "release_id").groupBy("query").agg(F.min_by("url", F.struct("_n", "ord")).alias("cover_url"))
    return records.join(year, "query", "left").join(cover, "query", "left").drop("releases")


def swapped_link(found: DataFrame, swapped: DataFrame, ratio: Column) -> DataFrame:
    """Of the hits as asked and with fields swapped (query, ord, artist, title), the first row of the side with the better ratio; a tie: swapped."""
    sides = found.withColumn("side", F.lit(1)).unionByName(swapped.withColumn("side", F.lit(2))).withColumn("r", ratio)
    best = sides.groupBy("query", "side").agg(F.max("r").alias("r"), F.min_by(F.struct("artist", "title"), "ord").alias("first"))
    return best.groupBy("query").agg(F.max_by(F.struct("side", "first"), F.struct("r", "side")).alias("b")).select("query", "b.side", "b.first.*")


def nearest_word(words: DataFrame, dictionary: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """word with the dictionary's(entry, ord) nearest entry by edit distance, the first of equals; each distinct word once.

    Words that are entries are done by an equi-join. The dictionary is the stated query set of a search in blocks: for the other
    words a block of at most about block_rows entries at a time is broadcast, and only each block's best entry is kept.
    """
    entries = dictionary.groupBy("entry").agg(F.min("ord").alias("ord"))
    distinct = words.select("word").filter(F.col("word").isNotNull()).distinct()
    members = distinct.join(entries, distinct["word"] == entries["entry"]).select("word", "entry", F.lit(0).alias("distance"))
    rest = distinct.join(entries, distinct["word"] == entries["entry"], "left_anti")
    blocks, best = max(1, -(-entries.count() // block_rows)), None
    for k in range(blocks):
        own = entries if blocks == 1 else entries.filter(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == k)
        scored = rest.join(F.broadcast(own)).withColumn("d", F.levenshtein("word", "entry"))
        near = scored.groupBy("word").agg(F.min(F.struct("d", "ord", "entry")).alias("b"))
        best = near if best is None else best.unionByName(near)
    near = best.groupBy("word").agg(F.min("b").alias("b"))
    return members.unionByName(near.select("word", "b.entry", F.col("b.d").alias("distance")))
