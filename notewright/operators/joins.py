"""Joins over time: nearest as-of, half-open ranges, interval subtraction and exclusion; always with song_id as the equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(song_id, id, t) with near: the t of right(song_id, t) nearest to it, the later one on a tie; null without any.

    One union and two running windows: no pairs are built, whatever the songs' lengths.
    """
    both = left.select("song_id", "id", "t", F.lit(None).cast("double").alias("r")).unionByName(right.select("song_id", F.lit(None).cast("long").alias("id"), "t", F.col("t").alias("r")))
    w = W.partitionBy("song_id").orderBy("t", F.col("r").isNull())
    up = W.partitionBy("song_id").orderBy(F.desc("t"), F.col("r").isNull())
    both = both.withColumns({"_b": F.last("r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_a": F.last("r", ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, 0))})
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("t") - F.col("_b") < F.col("_a") - F.col("t"), F.col("_b")).otherwise(F.col("_a"))
    return both.filter(F.col("id").isNotNull()).select("song_id", "id", "t", near.alias("near"))


def in_range(segments: DataFrame, frames: DataFrame, width: float) -> DataFrame:
    """Frames(song_id, frame_idx, t, ...) in [start, end) of segments(song_id, seg, start, end).

    Both sides carry time buckets of `width` seconds, so a long song is many join keys; a frame has one bucket, a segment those
    that it touches, so no pair comes twice.
    """
    s = segments.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    f = frames.withColumn("_bucket", F.floor(F.col("t") / width))
    return s.join(f, ["song_id", "_bucket"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("_bucket")


def nearest_index(left: DataFrame, frames: DataFrame) -> DataFrame:
    """left(song_id, id, t) with frame_idx of the frame(song_id, frame_idx, t) nearest to it, the later one on a tie, the first of frames at one time.

    One union, sorted once: a running window looks back, the same one looks ahead.
    """
    queries = left.select("song_id", "id", "t", F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("frame_idx"), F.lit(None).cast("struct<r:double,frame_idx:int>").alias("f"))
    known = frames.select("song_id", F.lit(None).cast(left.schema["id"].dataType).alias("id"), "t", F.lit(1).alias("_kind"), F.col("frame_idx").cast("int").alias("frame_idx"))
    both = queries.unionByName(known.withColumn("f", F.struct(F.col("t").alias("r"), "frame_idx")))
    w = W.partitionBy("song_id").orderBy("t", "_kind", "frame_idx")
    both = both.withColumns({"_b": F.last("f", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first("f", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    early = F.col("_a").isNull() | (F.col("t") - F.col("_b.r") < F.col("_a.r") - F.col("t"))
    return both.filter("_kind = 0").select("song_id", "id", "t", F.when(early, F.col("_b.frame_idx")).otherwise(F.col("_a.frame_idx")).alias("frame_idx"))


def index_ranges(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """segments(song_id, seg, start, end) with first_frame and stop_frame: from the frame nearest to start up to the one nearest to end, one frame at least."""
    ends = segments.select("song_id", F.explode(F.array(F.struct(F.struct("seg", F.lit(0).alias("e")).alias("id"), F.col("start").alias("t")), F.struct(F.struct("seg", F.lit(1).alias("e")).alias("id"), F.col("end").alias("t")))).alias("x")).select("song_id", "x.*")
    found = nearest_index(ends, frames).groupBy("song_id", F.col("id.seg").alias("seg")).agg(F.max(F.when(F.col("id.e") == 0, F.col("frame_idx"))).alias("lo"), F.max(F.when(F.col("id.e") == 1, F.col("frame_idx"))).alias("hi"))
    both = segments.join(found, ["song_id", "seg"]).filter(F.col("lo").isNotNull())
    return both.withColumns({"first_frame": F.col("lo"), "stop_frame": F.greatest("hi", F.col("lo") + 1)}).drop("lo", "hi")


def in_index_range(segments: DataFrame, frames: DataFrame, width: int = 64) -> DataFrame:
    """Frames(song_id, frame_idx, ...) with first_frame <= frame_idx < stop_frame of segments, joined on song and index block."""
    s = segments.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_frame") / width), F.floor((F.col("stop_frame") - 1) / width))))
    f = frames.withColumn("_block", F.floor(F.col("frame_idx") / width))
    return s.join(f, ["song_id", "_block"]).filter((F.col("frame_idx") >= F.col("first_frame")) & (F.col("frame_idx") < F.col("stop_frame"))).drop("_block", "first_frame", "stop_frame")


def sure(frames: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Rows over the threshold, without a fallback."""
    return frames.filter(F.col("conf") > threshold)


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows at the same place (song_id, seq) side by side; a place that only one side has is left out."""
    return left.join(right, ["song_id", "seq"])


def uncached(inputs: DataFrame, done: DataFrame, keys: list[str], skip: Column | None = None) -> DataFrame:
    """Inputs still to be worked out: those without a result in done(keys), and those that skip tells to do anew."""
    again = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    have = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = ~again
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inputs.join(have, on, "left_anti")


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each group, the first in order."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def confident(frames: DataFrame, by: list[str], threshold: float = 0.4) -> DataFrame:
    """Rows over the threshold; all rows of a group that has none."""
    any_over = F.max(F.col("conf") > threshold).over(W.partitionBy(*by))
    return frames.withColumn("_any", any_over).filter((F.col("conf") > threshold) | ~F.col("_any")).drop("_any")


def modal(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("m")).select(*by, f"m.{value}", "m.n")


def unmuted(frames: DataFrame, silences: DataFrame, width: float) -> DataFrame:
    """Frames in no silence: an anti-join on time buckets."""
    s = silences.select("song_id", "start", "end").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    f = frames.withColumn("_bucket", F.floor(F.col("t") / width))
    on = (f["song_id"] == s["song_id"]) & (f["_bucket"] == s["_bucket"]) & (f["t"] >= s["start"]) & (f["t"] < s["end"])
    return f.join(s, on, "left_anti").drop("_bucket")


def _piece(word: Column, start: Column, end: Column, last: Column) -> Column:
    return F.struct(word.alias("word"), start.alias("start"), end.alias("end"), last.alias("is_word_end"))


def without_silence(tokens: DataFrame, silences: DataFrame, least: float = 0.1, width: float = 3600.0) -> DataFrame:
    """tokens(song_id, seq, word, start, end, is_word_end) minus silences(song_id, start, end): pieces with piece_no.

    Silences that overlap a token are folded in order: those inside split it (pieces are `~`, the last ends the word), one at an
    edge trims it, one that covers it strictly on both sides removes it. Pieces of at most `least` seconds are not made.
    A head that was split keeps its own end when a later silence reaches past the token. Both sides meet in time buckets of
    `width` seconds, each pair in the first that it shares; (song_id, seq) tells tokens apart.
    """
    at = lambda c: F.floor(F.col(c) / width)
    s = silences.select("song_id", F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_bucket", F.explode(F.sequence(at("_s"), at("_e"))))
    t = tokens.select("song_id", "seq", "start", "end").withColumn("_bucket", F.explode(F.sequence(at("start"), at("end"))))
    met = t.join(s, ["song_id", "_bucket"]).filter((F.col("_s") <= F.col("end")) & (F.col("_e") >= F.col("start")) & (F.col("_bucket") == F.greatest(at("start"), at("_s"))))
    met = met.groupBy("song_id", "seq").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_sil"))
    g = tokens.join(met, ["song_id", "seq"], "left").withColumn("_sil", F.coalesce("_sil", F.expr("cast(array() as array<struct<s:double,e:double>>)")))
    g = g.withColumn("_sil", F.transform("_sil", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get("_sil", i + 1)["s"].alias("ns"), F.get("_sil", i + 1)["e"].alias("ne"))))
    end = F.col("end")
    none = F.expr("cast(array() as array<struct<word:string,start:double,end:double,is_word_end:boolean>>)")
    state = lambda head, pieces, split, gone: F.struct(head.alias("head"), pieces.alias("pieces"), split.alias("split"), gone.alias("gone"))

    def step(st: Column, x: Column) -> Column:
        h, pieces = st["head"], st["pieces"]
        stop = F.when(x["ns"] < end, x["ns"]).otherwise(end)
        more = F.coalesce(x["ne"] < end, F.lit(False))
        tail = _piece(F.when(more, F.lit("~")).otherwise(F.lit("~ ")), x["e"], stop, ~more)
        long = tail["end"] - tail["start"] > least
        short_head = x["s"] - h["start"] < least
        last_piece = F.element_at(pieces, -1)
        closed = F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(_piece(F.concat(F.rtrim(last_piece["word"]), F.lit(" ")), last_piece["start"], last_piece["end"], F.lit(True))))
        moved = state(_piece(h["word"], tail["start"], tail["end"], h["is_word_end"]), pieces, st["split"], st["gone"])
        whole = state(_piece(h["word"], h["start"], x["s"], h["is_word_end"]), pieces, st["split"], st["gone"])
        first = state(_piece(F.regexp_replace(h["word"], " $", ""), h["start"], x["s"], F.lit(False)), F.concat(pieces, F.array(tail)), F.lit(True), st["gone"])
        later = F.when(long, state(h, F.concat(pieces, F.array(tail)), F.lit(True), st["gone"])).when(~more & (F.size(pieces) > 0), state(h, closed, F.lit(True), st["gone"])).otherwise(st)
        inside = F.when(st["split"], later).when(short_head, moved).when(~long, whole).otherwise(first)
        trimmed_start = state(_piece(h["word"], x["e"], h["end"], h["is_word_end"]), pieces, st["split"], st["gone"])
        trimmed_end = F.when(st["split"], st).otherwise(state(_piece(h["word"], h["start"], x["s"], h["is_word_end"]), pieces, st["split"], st["gone"]))
        return (
            F.when(st["gone"] | (x["s"] > end) | (x["e"] < h["start"]), st)
            .when((x["s"] >= h["start"]) & (x["e"] <= end), inside)
            .when((x["s"] < h["start"]) & (x["e"] > end), state(h, pieces, st["split"], F.lit(True)))
            .when(x["s"] < h["start"], trimmed_start)
            .otherwise(trimmed_end)
        )

    begin = state(_piece(F.col("word"), F.col("start"), end, F.col("is_word_end")), none, F.lit(False), F.lit(False))
    out = g.withColumn("_p", F.aggregate("_sil", begin, step, lambda st: F.when(st["gone"], none).otherwise(F.concat(F.array(st["head"]), st["pieces"]))))
    return out.select("song_id", "seq", F.posexplode("_p").alias("piece_no", "_x")).select("song_id", "seq", "piece_no", "_x.*")
