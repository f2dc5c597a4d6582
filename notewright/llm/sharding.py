"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash of their group (op7: their text), then of the row, and ranked; the fractional
rank of a group's middle spreads every source evenly over [0, 1), so contiguous cuts of the rows sorted by it hold each source
in the mixture's share. A group is one unit: it stands in the stratum of its first row (the smallest, by order), all its rows have one fraction,
and rows of one fraction stand by group. So n shards, which take n - 1 cuts, divide n - 1 groups at most, whatever the number of sources.

Ranks have two levels: about sqrt(rows) buckets are counted, their running totals are joined back, and only the place within a bucket is
a window. A group of over HEAVY * sqrt(rows) rows, of which there can be sqrt(rows) / HEAVY, is a bucket of its own in both rankings and is
divided by the row's hash, so a source or a text with a third of all rows is spread over all tasks.

The law kept is `rows`: counts at most one apart. The mixture of a shard differs from the whole one by a group at each end and by what the
groups of several sources bring along.

Null source: a stratum of its own. Null and empty texts: no bytes, CRC of no bytes, one group. Equal rows take places next to each other
and are interchangeable. A very long text counts as one row. An empty table gives no rows. Columns of the input keep their names and values; the
operator's own are named apart from them, but for `shard` and `slot`, which take the place of columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read, root_buckets

HEAVY = 8


def _running(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows before each bucket, and rows of all buckets, within by."""
    w = W.partitionBy(*by)
    return counts.withColumns({
        "before": F.coalesce(F.sum("n").over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "every": F.sum("n").over(w),
    })


def _by_group(keyed: DataFrame, n: int) -> DataFrame:
    """keyed with the stratum of its group's first row, and splits: into how many parts a heavy group is to go, else null.

    Heavy groups hold more than HEAVY * n of the rows, so there are n / HEAVY of them at most: few enough to broadcast, whatever
    the input. Of the others those that have several strata are joined; rows of heavy groups go by their own hash there, so none gathers.
    """
    groups = keyed.groupBy("g").agg(F.count("*").alias("size"), F.min("stratum").alias("low"), F.max("stratum").alias("high"), F.min_by("stratum", "row").alias("own"))
    heavy = groups.filter(F.col("size") > HEAVY * n).select("g", F.col("own").alias("heavy_own"), F.ceil(F.col("size") / n).alias("splits"))
    mixed = groups.filter((F.col("size") <= HEAVY * n) & (F.col("low") != F.col("high"))).select(F.col("g").alias("key"), F.lit(False).alias("is_heavy"), "own")
    out = keyed.join(F.broadcast(heavy), "g", "left").withColumn("is_heavy", F.col("splits").isNotNull())
    out = out.withColumn("key", F.when(F.col("is_heavy"), F.col("h")).otherwise(F.col("g"))).join(mixed, ["key", "is_heavy"], "left")
    return out.withColumn("stratum", F.coalesce("heavy_own", "own", "stratum")).drop("key", "is_heavy", "own", "heavy_own")


def interleaved(rows: DataFrame, stratum: str, group: list[str], order: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """rows with `shard` (0 to n_shards - 1, sizes at most one apart) and `slot` (0, 1, ... within the shard).

    group: columns whose equal values stay together; order: columns that tell a group's rows apart (rows equal in all of them
    are interchangeable).
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    total = rows.count()
    n = root_buckets(total)
    keyed = rows.select(
        F.struct(*columns).alias("kept"), F.struct(*order).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"),
        F.xxhash64(F.lit(seed), *group).alias("g"), F.xxhash64(F.lit(seed), *group, *order).alias("h"),
    )
    keyed = _by_group(keyed, n).withColumn("bucket", F.pmod(F.shiftright("g", 20), F.lit(n)))
    # A bucket's other groups come first (own: null), then each heavy one.
    keyed = keyed.withColumns({"own": F.when(F.col("splits").isNotNull(), F.col("g")), "split": F.coalesce(F.pmod(F.shiftright("h", 20), F.col("splits")), F.lit(0))}).drop("splits")
    bucket = ["stratum", "bucket", "own", "split"]
    within = _running(keyed.groupBy(*bucket).agg(F.count("*").alias("n")), ["stratum"], ["bucket", F.asc_nulls_first("own"), "split"])
    spread = W.partitionBy("stratum", "bucket", "own")
    within = within.select(*bucket, "every", F.when(F.col("own").isNull(), F.col("before")).otherwise(F.min("before").over(spread)).alias("before"), F.sum("n").over(spread).alias("size"))
    ahead, members = F.rank().over(W.partitionBy(*bucket).orderBy("g")) - 1, F.count("*").over(W.partitionBy(*bucket, "g"))
    ranked = keyed.withColumns({"ahead": ahead, "members": members}).alias("k").join(within.alias("w"), [F.col(f"k.{c}").eqNullSafe(F.col(f"w.{c}")) for c in bucket])
    middle = F.when(F.col("k.own").isNull(), F.col("ahead") + F.col("members") / 2).otherwise(F.col("size") / 2)
    ranked = ranked.select("kept", "row", "h", *[f"k.{c}" for c in ("stratum", "g", "own", "split")], ((F.col("before") + middle) / F.col("every")).alias("at"))
    # The same again over all strata: a part's heavy groups lie between its other rows.
    cut = ranked.withColumn("part", F.floor(F.col("at") * n))
    unit = F.struct("at", "stratum", "g")
    heavy = cut.filter(F.col("own").isNotNull()).groupBy("part").agg(F.collect_set(unit).alias("heavy"))
    cut = cut.join(F.broadcast(heavy), "part", "left")
    passed = F.coalesce(F.size(F.filter("heavy", lambda u: u < unit)), F.lit(0))
    cut = cut.withColumn("piece", 2 * passed + F.when(F.col("own").isNotNull(), 1).otherwise(0)).drop("heavy")
    part = ["part", "piece", "split"]
    parts = _running(cut.groupBy(*part).agg(F.count("*").alias("n")), [], part).select(*part, "before")
    place = F.row_number().over(W.partitionBy(*part).orderBy("at", "stratum", "g", "h", "row"))
    put = cut.withColumn("place", place).join(parts, part).withColumn("pos", F.col("before") + F.col("place") - 1)
    put = put.withColumn("shard", F.expr(f"cast((pos * {n_shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * cast({total} as bigint) + {n_shards - 1}) div {n_shards}")
    return put.select("kept.*", "shard", (F.col("pos") - first).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = interleaved(docs, "source", ["text_crc32", "size"], ["doc_id"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
