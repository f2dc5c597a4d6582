"""A chain of stages over songs that keeps what is finished: a run that was stopped goes on where it was, song by song.

A stage's rows go to `<folder>/<stage>/run=<id>`, and only then the songs of that run into `<folder>/<stage>.done/run=<id>`. What is read
back is what has both, so a run that ended between the two leaves nothing behind but files that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import uncached

#: A stage gets the songs to do and the finished tables of the stages before it, by name, for those songs; its rows have a song_id.
Stage = tuple[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def finished(spark: SparkSession, folder: str, stage: str) -> DataFrame | None:
    """song_id, run of the songs that a stage is done with; None before its first run."""
    path = f"{folder}/{stage}.done"
    return spark.read.parquet(path).select("song_id", F.col("run").cast("string").alias("run")) if _exists(spark, path) else None


def advanced(songs: DataFrame, stages: list[Stage], folder: str, again: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The finished table of each stage, after all songs(song_id, ...) that lack it have gone through it.

    again: songs to do anew from a stage on, by the stage's name; their new rows take the place of the old ones in it and in all later stages.
    """
    spark, out, anew = songs.sparkSession, {}, None
    for name, work in stages:
        done = finished(spark, folder, name)
        more = (again or {}).get(name)
        if more is not None:
            own = more.select("song_id").distinct()
            anew = own if anew is None else anew.union(own).distinct()
        todo = songs
        if done is not None:
            left = uncached(songs, done, ["song_id"])
            todo = left if anew is None else left.unionByName(songs.join(anew, "song_id", "left_semi")).distinct()
        if not todo.isEmpty():
            run = f"r{uuid.uuid4().hex}"
            before = {k: t.join(todo.select("song_id"), "song_id", "left_semi") for k, t in out.items()}
            work(todo, before).write.parquet(f"{folder}/{name}/run={run}")
            todo.select("song_id").distinct().write.parquet(f"{folder}/{name}.done/run={run}")
        out[name] = latest(spark, folder, name)
    return out


def latest(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """A stage's finished rows, of a song that was done several times those of its last run."""
    done = spark.read.option("basePath", f"{folder}/{stage}.done").parquet(f"{folder}/{stage}.done").select("song_id", F.col("run").cast("string").alias("run"), F.col("_metadata.file_modification_time").alias("at"))
    last = done.groupBy("song_id").agg(F.max_by("run", F.struct("at", "run")).alias("run"))
    rows = spark.read.parquet(f"{folder}/{stage}").withColumn("run", F.col("run").cast("string"))
    return rows.join(last, ["song_id", "run"], "left_semi").drop("run")
