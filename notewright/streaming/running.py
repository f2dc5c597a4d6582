"""What runs along a song while it arrives: beats that push each other on, and spans of one note; the state is one row a song.

Rows carry their number in the song (seq, from `first` on without holes). They may arrive in any order and any split into batches:
a row that comes early is kept in the song's state until those before it are there, a row that comes twice counts once. What comes out is what the
operators of operators.sequences give for the whole song, so a stream can be checked against, or replaced by, a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _advancing(first: int, names: list[str], begin: tuple, take: Callable[[tuple, tuple], tuple[tuple, list[tuple]]], columns: list[str]) -> Callable[..., Iterator[pd.DataFrame]]:
    """A group function that gives the song's rows (names, the first of them seq) in order to take(carried, row) -> carried, rows to emit.

    State: the next seq, what is carried, and the early rows, column by column.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            following, *rest = state.get
            carried, early = tuple(rest[: len(begin)]), {r[0]: r for r in zip(*rest[len(begin) :], strict=True)}
        else:
            following, carried, early = first, begin, {}
        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                row = tuple(v.item() if hasattr(v, "item") else v for v in row)
                if row[0] >= following:
                    early.setdefault(row[0], row)
        out = []
        while following in early:
            carried, more = take(carried, early.pop(following))
            out += more
            following += 1
        waiting = [list(c) for c in zip(*(early[k] for k in sorted(early)), strict=True)] or [[] for _ in names]
        state.update((following, *carried, *waiting))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["song_id", *columns])

    return run


def _stateful(stream: DataFrame, run: Callable[..., Iterator[pd.DataFrame]], output: str, carried: str, waiting: dict[str, str]) -> DataFrame:
    song = stream.schema["song_id"].dataType.simpleString()
    state = f"following long, {carried}, " + ", ".join(f"w_{c} array<{t}>" for c, t in waiting.items())
    return stream.groupBy("song_id").applyInPandasWithState(run, f"song_id {song}, {output}", state, "append", GroupStateTimeout.NoTimeout)


def beats(stream: DataFrame, first: int = 1) -> DataFrame:
    """song_id, seq, start_beat of a stream of notes(song_id, seq, want, length): no note begins before the one before it ends."""

    def take(carried: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        seq, want, length = row
        start = max(want, carried[0])
        return (start + length,), [(seq, start)]

    names = ["seq", "want", "length"]
    rows = stream.select("song_id", *[F.col(c).cast("long").alias(c) for c in names])
    return _stateful(rows, _advancing(first, names, (0,), take, ["seq", "start_beat"]), "seq long, start_beat long", "ends long", dict.fromkeys(names, "long"))


def note_spans(stream: DataFrame, first: int = 1) -> DataFrame:
    """song_id, island, start, end, note, n of a stream of notes(song_id, seq, note, start, end, last): runs of one note, each when the next one begins.

    The run at a song's end comes with the row that says it is the last. A null note continues nothing and is continued by nothing.
    """

    def take(carried: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        island, start, end, note, n = carried
        _, own, a, b, last = row
        out = []
        if n and own is not None and own == note:
            start, end, n = min(start, a), max(end, b), n + 1
        else:
            out = [(island, start, end, note, n)] if n else []
            island, start, end, note, n = island + 1, a, b, own, 1
        if last:
            out.append((island, start, end, note, n))
            n = 0
        return (island, start, end, note, n), out

    names, kinds = ["seq", "note", "start", "end", "last"], ["long", "string", "double", "double", "boolean"]
    rows = stream.select("song_id", *[F.col(c).cast(t).alias(c) for c, t in zip(names, kinds, strict=True)])
    run = _advancing(first, names, (0, 0.0, 0.0, None, 0), take, ["island", "start", "end", "note", "n"])
    return _stateful(rows, run, "island long, start double, `end` double, note string, n long", "island long, start double, `end` double, note string, n long", dict(zip(names, kinds, strict=True)))
