"""Plain table formats: token and frame CSV, JSON caches, recognition results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.sequences import filled_times

#: A word keeps the blank at its end, which tells that it ends there.
_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, the header row off."""
    return spark.read.csv(path, header=True, inferSchema=False)


def words_of(text: Column) -> Column:
    """The words of a text, in order, cut at white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word, ord: the words of a word list, in order within each file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("file"), F.posexplode(words_of(F.col("value"))).alias("ord", "word"))


def write_tokens_csv(tokens: DataFrame, path: str) -> None:
    """word,start,end,confidence of each song, in order, a folder for each song."""
    (tokens.repartition("song_id").sortWithinPartitions("song_id", "seq").select("song_id", "word", "start", "end", "confidence").write.partitionBy("song_id").csv(path, **_CSV))


def write_frames_csv(frames: DataFrame, path: str) -> None:
    rows = frames.repartition("song_id").sortWithinPartitions("song_id", "frame_idx")
    rows.select("song_id", F.col("t").alias("time"), F.col("freq").alias("frequency"), F.col("conf").alias("confidence")).write.partitionBy("song_id").csv(path, **_CSV)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def recognised(results: DataFrame) -> DataFrame:
    """Tokens of results(song_id, segments): words in order with a blank after each; a word with any of its four fields missing gets times anew."""
    words = results.select("song_id", F.posexplode("segments").alias("_s", "segment")).select("song_id", "_s", F.posexplode("segment.words").alias("_w", "x"))
    words = words.withColumn("seq", F.row_number().over(W.partitionBy("song_id").orderBy("_s", "_w")) - 1)
    whole = F.col("x.word").isNotNull() & F.col("x.start").isNotNull() & F.col("x.end").isNotNull() & F.col("x.score").isNotNull()
    out = words.select("song_id", "seq", F.concat(F.coalesce("x.word", F.lit("")), F.lit(" ")).alias("word"), F.when(whole, F.col("x.start")).alias("start"), F.when(whole, F.col("x.end")).alias("end"), F.coalesce("x.score", F.lit(0.0)).alias("confidence"))
    return filled_times(out).withColumns({"is_hyphen": F.lit(False), "is_word_end": F.lit(True)})


def unused_names(songs: DataFrame, most: int = 999) -> DataFrame:
    """songs(song_id, name) with repeated names numbered ` (1)`, ` (2)`, ... in order of song_id; an error past ` (999)`."""
    n = F.row_number().over(W.partitionBy("name").orderBy("song_id")) - 1
    name = F.when(F.col("_n") == 0, F.col("name")).when(F.col("_n") <= most, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return songs.withColumn("_n", n).select("song_id", F.coalesce(name, F.when(F.col("name").isNotNull(), F.raise_error(F.concat(F.lit("no unused name for "), "name")))).alias("name"))


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none if there is no such folder."""
    system, place = _place(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder of cached tables; False if there was none."""
    system, place = _place(spark, path)
    return bool(system.delete(place, True))
