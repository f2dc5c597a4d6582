"""Catalogue look-ups: many queries sent by many tasks through an injected transport, with few retries, and what comes back as tables."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIES, WAIT, PATIENCE, BLOCK = 3, 1.0, 30.0, 256
#: What a catalogue answers to a search for recordings; a credit is an object with an artist, or a join phrase.
ANSWER = "struct<`recording-list`:array<struct<id:string,title:string,`artist-credit-phrase`:string,`artist-credit`:array<string>,`release-list`:array<struct<id:string,`release-group`:struct<id:string>>>>>>"


def asked(call: Callable[[], str | None], tries: int = TRIES, wait: float = WAIT, patience: float = PATIENCE) -> tuple[str | None, int]:
    """The answer of a call and how often it was made; None if it failed, or said nothing for `patience` seconds, each time. A failed call is made again after `wait` seconds."""
    for k in range(tries):
        if k:
            time.sleep(wait)
        box: queue.SimpleQueue = queue.SimpleQueue()

        def run(box: queue.SimpleQueue = box) -> None:
            try:
                box.put((True, call()))
            except Exception as e:  # what the network does wrong is the transport's to tell
                box.put((False, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            fine, answer = box.get(timeout=patience)
        except queue.Empty:
            continue
        if fine:
            return answer, k + 1
    return None, tries


def answers(queries: DataFrame, transport: Callable[[], Callable[[dict], str | None]], tries: int = TRIES, wait: float = WAIT, patience: float = PATIENCE, block: int = BLOCK) -> DataFrame:
    """queries with answer (text, null on failure) and tries. transport() is called once a task and gives f(row as a dict) -> the answer's text.

    Equal queries are sent once. Blocks of about `block` queries are partitions, so that a lost task asks few of them again; how many are sent at a
    time is how many tasks run.
    """
    columns = queries.columns
    once = queries.distinct()
    parts = max(1, -(-once.count() // block))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", answer string, tries int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = transport()
        for batch in batches:
            rows = [(*row, *asked(lambda row=row: send({c: None if v is None or v != v else v for c, v in zip(columns, row, strict=True)}), tries, wait, patience)) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*columns, "answer", "tries"])

    return once.repartition(parts, *columns).mapInPandas(run, schema)


def recordings(found: DataFrame) -> DataFrame:
    """query, ord, id, title, phrase, credits (artists' ids, null for join phrases), releases of answers(query, answer); what is no such answer gives no rows."""
    flat = found.select("query", F.posexplode(F.from_json("answer", ANSWER)["recording-list"]).alias("ord", "r"))
    credits = F.transform(F.col("r.artist-credit"), lambda c: F.get_json_object(c, "$.artist.id"))
    releases = F.transform(F.col("r.release-list"), lambda x: F.struct(x["id"].alias("id"), x["release-group"]["id"].alias("group_id")))
    return flat.select("query", "ord", "r.id", "r.title", F.col("r.artist-credit-phrase").alias("phrase"), credits.alias("credits"), releases.alias("releases"))
