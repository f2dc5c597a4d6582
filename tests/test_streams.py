"""Streams in any split and order of arrival give the rows of the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from notewright.operators import sequences as S
from notewright.streaming import running as R

SCHEMA = "song_id string, seq long, want long, length long, note string, start double, end double, last boolean"


def songs():
    rng, rows = random.Random(6), []
    for song in "abc":
        n = rng.randint(15, 30)
        rows += [(song, i, rng.randint(-3, 60), rng.randint(1, 6), rng.choice(["C4", "C4", "D4", None]), float(i), i + 0.5, i == n) for i in range(1, n + 1)]
    return rows


def streamed(spark, tmp_path, out, batches, name):
    """The rows that a query over files, one a batch, has emitted."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        if k == 0:
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}/in")
        q = out(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/at").option("path", f"{tmp_path}/{name}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect()), key=repr)


@pytest.mark.parametrize("split", ["one", "in order", "any order, some twice"])
def test_any_split_gives_the_batch_rows(spark, tmp_path, split):
    """The query is stopped and started again after each batch: what it carries lies in its checkpoint."""
    rows = songs()
    df = spark.createDataFrame(rows, SCHEMA)
    if split == "one":
        batches = [rows]
    elif split == "in order":
        batches = [[r for r in rows if r[1] % 40 <= 9], [r for r in rows if 9 < r[1] <= 20], [r for r in rows if r[1] > 20]]
    else:
        rng, mixed = random.Random(2), list(rows)
        rng.shuffle(mixed)
        batches = [mixed[:20] + mixed[:5], mixed[15:50], mixed[45:]]
    want = sorted(map(tuple, S.beat_scan(df).select("song_id", "seq", "start_beat").collect()), key=repr)
    assert streamed(spark, tmp_path, R.beats, batches, "beats") == want
    want = sorted(map(tuple, S.note_islands(df).select("song_id", "island", "start", "end", "note", "n").collect()), key=repr)
    assert streamed(spark, tmp_path, R.note_spans, batches, "spans") == want


def test_a_missing_row_holds_back_what_follows(spark, tmp_path):
    rows = [r for r in songs() if r[0] == "a"]
    got = streamed(spark, tmp_path, R.beats, [[r for r in rows if r[1] != 4]], "held")
    assert [r[1] for r in got] == [1, 2, 3]
    assert spark.createDataFrame(rows, SCHEMA).filter(F.col("seq") > 4).count() > 5
