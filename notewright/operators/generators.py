"""Row generators: grid splits and syllables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_split(tokens: DataFrame) -> DataFrame:
    """tokens(song_id, seq, word, start, end, bpm) cut into sixteenths: the head keeps the word, the rest are `~`.

    A rest of at least a thirty-second is a piece of its own, a shorter one lengthens the last piece; a blank at the end of the word
    moves to the last piece.
    """
    size = 60.0 / F.col("bpm") / 4
    t = tokens.withColumns({"_size": size, "_long": F.col("end") - F.col("start") > size})
    t = t.withColumn("_n", F.when(F.col("_long"), F.floor((F.col("end") - F.col("start")) / F.col("_size"))).otherwise(F.lit(1)).cast("int"))
    rest = F.col("end") - F.col("start") - F.col("_n") * F.col("_size")
    t = t.withColumn("_m", F.col("_n") + F.when(F.col("_long") & (rest >= F.col("_size") / 2), 1).otherwise(0))
    t = t.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    last = F.col("piece_no") == F.col("_m") - 1
    blank = F.when(F.endswith("word", F.lit(" ")), F.lit(" ")).otherwise(F.lit(""))
    word = F.when(F.col("_m") == 1, F.col("word")).when(F.col("piece_no") == 0, F.rtrim("word")).when(last, F.concat(F.lit("~"), blank)).otherwise(F.lit("~"))
    start = F.col("start") + F.col("piece_no") * F.col("_size")
    return t.select("song_id", "seq", "piece_no", word.alias("word"), start.alias("start"), F.when(last, F.col("end")).otherwise(start + F.col("_size")).alias("end"), last.alias("is_word_end"))


def syllables(tokens: DataFrame) -> DataFrame:
    """tokens(song_id, seq, word, start, end, parts) with a row for each syllable of parts, of equal length; null parts: unchanged."""
    t = tokens.select("*", F.posexplode_outer("parts").alias("piece_no", "_part"))
    n = F.size("parts")
    chunk = (F.col("end") - F.col("start")) / n
    stop = F.col("end") - chunk * (n - 1 - F.col("piece_no"))
    start = F.when(F.col("piece_no") == 0, F.col("start")).otherwise(F.col("end") - chunk * (n - F.col("piece_no")))
    whole = F.col("parts").isNull()
    return t.select(
        "song_id",
        "seq",
        F.coalesce("piece_no", F.lit(0)).alias("piece_no"),
        F.when(whole, F.col("word")).otherwise(F.col("_part")).alias("word"),
        F.when(whole, F.col("start")).otherwise(start).alias("start"),
        F.when(whole, F.col("end")).otherwise(stop).alias("end"),
        (~whole).alias("is_hyphen"),
        (whole | (F.col("piece_no") == n - 1)).alias("is_word_end"),
    )
