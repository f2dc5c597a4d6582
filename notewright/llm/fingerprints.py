"""Document fingerprints by an invertible Bloom lookup sketch of paragraph digests, in DataFrame operations only.

A paragraph is what stands between line breaks, cut further after a full stop, exclamation or question mark before a blank;
a document is the set of their 64-bit digests. A sketch has ROWS rows of 2^bits cells; a digest is in one cell of each row,
which holds a count, the XOR of its digests and the XOR of their checks. The fingerprint is the sketch with PRINT_BITS.

To compare two versions their sketches are subtracted cell by cell: both are added up, one of them negated, as table rows of
the cells that are not empty, so width costs nothing. Cells left with one digest give it up and it is taken from its other
cells, row after row, ROUNDS times. When all cells are empty, what came out is the difference of the sets, side by side, and
with their sizes the likeness (Jaccard), exactly. Where cells are left, or the sizes disagree, the pair is sketched again
with rows four times as wide, until none is left. Sets themselves are never compared.

Null texts are empty: no paragraphs, an empty fingerprint, and two empty sets are alike (1.0). Repeated paragraphs count once. Equal
texts have equal fingerprints. Repeated rows are rows of their own, one after the other. The next document is found within
buckets of the doc_id range; buckets that hold many more rows than others are divided again, as often as it takes. Rows without doc_id come last;
rows with equal doc_id are ordered by their text's hash. doc_id may be of any integer type, or a string. A very long text is
spread over rows like any other. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import partitions, read, written

PRINT_BITS, LEAST_BITS, ROWS, ROUNDS, WIDER = 3, 6, 3, 2, 2
BUCKET_ROWS, PART_BYTES, GROUP, FEW = 500, 8 << 20, 1024, 100_000
_SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns behind a generator, which keeps the optimizer from working them out again inside lambdas."""
    return df.select("*", F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_s")).select("*", "_s.*").drop("_s")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    for stop in ". ", "! ", "? ":
        text = F.replace(text, F.lit(stop), F.lit(stop[0] + "\n"))
    parts = F.array_distinct(F.filter(F.split(text, "\n"), lambda p: p != ""))
    return F.transform(parts, lambda p: F.xxhash64(p))


def check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(ROWS)).bitwiseAND(F.lit(0xFFFFFFFF))


def cell_of(d: Column, row: int | Column, bits: Column) -> Column:
    """Number of the cell that a digest has in a row: column * ROWS + row."""
    row = F.lit(row) if isinstance(row, int) else row
    return F.xxhash64(d, row).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1) * ROWS + row


def sketch(items: Column, bits: int = PRINT_BITS) -> Column:
    """The cells (cell, n, d, c) of a set that are not empty, in order."""

    def filled(number: int) -> Column:
        own = F.filter(items, lambda d: cell_of(d, number % ROWS, F.lit(bits)) == number)
        return F.aggregate(
            own,
            F.struct(F.lit(number).alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c")),
            lambda at, d: F.struct(at["cell"].alias("cell"), (at["n"] + 1).alias("n"), at["d"].bitwiseXOR(d).alias("d"), at["c"].bitwiseXOR(check(d)).alias("c")),
        )

    return F.filter(F.array(*[filled(k) for k in range(ROWS << bits)]), lambda x: x["n"] > 0)


def written_out(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["cell"].cast("string"), x["n"].cast("string"), F.hex(x["d"]), F.hex(x["c"]))), " ")


def _added(cells: DataFrame, keys: list[str]) -> DataFrame:
    summed = cells.groupBy(*keys, "kind", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    return summed.filter((F.col("n") != 0) | (F.col("d") != 0) | (F.col("c") != 0))


def differences(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]], wider: int = 0) -> DataFrame:
    """keys, kind (place of the pair + len(pairs) * bits), cell, n, d, c: the subtracted sketches of each pair of columns of digests."""
    sizes = [F.size(c) for c in {c for pair in pairs for c in pair}]
    bits = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.greatest(*sizes, F.lit(1)).cast("double"))).cast("int") + 3) + wider
    sides = [F.struct((F.lit(p) + len(pairs) * F.col("_bits")).alias("kind"), F.lit(sign).cast("long").alias("n"), F.col(name).alias("items")) for p, pair in enumerate(pairs) for sign, name in zip((1, -1), pair, strict=True)]
    every = rows.withColumn("_bits", bits).select(*keys, "_bits", F.inline(F.array(*sides)))
    every = every.select(*keys, "_bits", "kind", "n", F.explode("items").alias("d"))
    every = every.select(*keys, "_bits", "kind", "n", "d", F.explode(F.array(*[F.lit(r) for r in range(ROWS)])).alias("_row"))
    return _added(every.select(*keys, "kind", cell_of(F.col("d"), F.col("_row"), F.col("_bits")).alias("cell"), "n", "d", check(F.col("d")).alias("c")), keys)


LEFT, RIGHT = -1, -2


def peeled(cells: DataFrame, keys: list[str], n_pairs: int, named: bool = False) -> DataFrame:
    """The cells after peeling. What came out has cell LEFT or RIGHT: how many in n, or with named one row for each digest d."""
    bits = F.floor(F.col("kind") / n_pairs).cast("int")
    d, c, n = F.col("d"), F.col("c"), F.col("n")
    for row in [*range(ROWS)] * ROUNDS:
        pure = (F.col("cell") % ROWS == row) & (F.abs("n") == 1) & (c == check(d)) & (F.col("cell") == cell_of(d, row, bits))
        zero = F.lit(0).cast("long")
        side = F.when(n > 0, F.lit(LEFT)).otherwise(F.lit(RIGHT)).cast("long")
        out = F.struct(side.alias("cell"), F.lit(1).cast("long").alias("n"), zero.alias("d"), zero.alias("c"), *([d.alias("out")] if named else []))
        rest = [F.struct(cell_of(d, (row + k) % ROWS, bits).alias("cell"), (-n).alias("n"), d.alias("d"), c.alias("c"), *([F.lit(None).cast("long").alias("out")] if named else [])) for k in range(1, ROWS)]
        same = F.struct("cell", "n", "d", "c", *([F.col("out") if "out" in cells.columns else F.lit(None).cast("long").alias("out")] if named else []))
        given = cells.select(*keys, "kind", F.inline(F.when((F.col("cell") >= 0) & pure, F.array(out, *rest)).otherwise(F.array(same))))
        cells = _added(given, [*keys, "out"] if named else keys)
    return cells


def recovered(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys, side (left or right), digest: what only one of two columns of digests has, read off their subtracted sketches.

    Rows whose sketches do not peel are tried again with wider ones; keys tell rows apart.
    """
    found, todo, wider = None, rows, 0
    while True:
        cells = written(peeled(differences(todo, keys, [(left, right)], wider), keys, 1, named=True), "peeled")
        stuck = cells.filter("cell >= 0").select(*keys).distinct()
        out = cells.filter("cell < 0").join(stuck, keys, "left_anti").select(*keys, F.when(F.col("cell") == LEFT, "left").otherwise("right").alias("side"), F.col("out").alias("digest"))
        found = out if found is None else found.unionByName(out)
        if stuck.isEmpty():
            return found
        todo, wider = rows.join(stuck, keys, "left_semi"), wider + WIDER


HEAD = 7


def _number(doc_id: Column, kind: T.DataType, skip: Column) -> Column:
    """A long that grows with doc_id; of a string its HEAD bytes after the first `skip`, which others have too."""
    if isinstance(kind, T.StringType):
        head = F.substr(F.encode(doc_id, "UTF-8"), skip + 1, F.lit(HEAD))
        return F.conv(F.rpad(F.hex(head), 2 * HEAD, "0"), 16, 10).cast("long")
    return doc_id.cast("long")


def _alike(low: Column, high: Column, kind: T.DataType) -> Column:
    """How many bytes two different strings, and so all between them, begin with alike."""
    if not isinstance(kind, T.StringType):
        return F.lit(0)
    pairs = lambda x: F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit("(..)"), F.lit(1))
    return (F.array_position(F.zip_with(pairs(low), pairs(high), lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)) - 1).cast("int")


def ranges(docs: DataFrame, least: int | str | None, most: int | str | None, n_rows: int, rows: int = BUCKET_ROWS) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What gives a frame with doc_id its _bucket: ranges of descending doc_id, from most down to least, of about `rows` rows; and the numbers a first range spans.

    Ranges are of equal width, of strings past what all of them begin with; rows without doc_id are in the last. Those that come out much too
    full are divided in the same way, between their own ends and past what these begin with, and so on, until none is.
    """
    if least is None:
        return lambda df: df.withColumn("_bucket", F.lit(0).cast("long")), 1
    kind, skip = docs.schema["doc_id"].dataType, 0
    if isinstance(kind, T.StringType):
        skip = len(os.path.commonprefix([least.encode(), most.encode()]))
        low, high = (int.from_bytes(x.encode()[skip : skip + HEAD].ljust(HEAD, b"\0"), "big") for x in (least, most))
    else:
        low, high = int(least), int(most)
    n = max(1, n_rows // rows)
    width = max(1, -(-(high - low + 1) // n))
    levels, span = [], 1

    def into(df: DataFrame) -> DataFrame:
        out = df.withColumn("_num", _number(F.col("doc_id"), kind, F.lit(skip))).withColumn("_bucket", F.coalesce(F.expr(f"({high}L - _num) div {width}L"), F.lit(n + 1).cast("long")))
        for ends, parts in levels:
            out = out.join(ends, "_bucket", "left").withColumn("_num", _number(F.col("doc_id"), kind, F.col("_skip")))
            out = out.withColumn("_bucket", F.col("_bucket") * parts + F.coalesce(F.expr("(_high - _num) div _step"), F.lit(0).cast("long"))).drop(*(c for c in ends.columns if c != "_bucket"))
        return out.select(*df.columns, "_bucket")

    while True:
        sizes = into(docs.select("doc_id")).groupBy("_bucket").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
        heavy = sizes.filter((F.col("_n") > 4 * rows) & (F.col("_high") > F.col("_low"))).withColumn("_skip", _alike(F.col("_low"), F.col("_high"), kind))
        heavy = heavy.select("_bucket", "_n", "_skip", *[_number(F.col(c), kind, F.col("_skip")).alias(c) for c in ("_low", "_high")])
        heavy = written(heavy.select("_bucket", "_n", "_skip", "_high", F.expr(f"greatest(1L, (_high - _low) div (_n div {rows}))").alias("_step")), "ranges")
        full = heavy.agg(F.max("_n")).first()[0]
        parts = (full or 0) // rows * 2 + 2  # the width is rounded down, so there may be up to twice as many ranges
        if full is None or (n + 2) * span * parts >= 1 << 62:
            return into, span
        levels.append((heavy.drop("_n"), parts))
        span *= parts


def with_next(docs: DataFrame) -> DataFrame:
    """_bucket, _i, doc_id, text, next_id, next_text of docs(doc_id, text): the next row in descending doc_id, after the last the first.

    _bucket and _i tell rows apart; the rows of a bucket are in one partition.
    """
    found = docs.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    into, span = ranges(docs, found["least"], found["most"], found["n"])
    parts = max(partitions(docs.sparkSession), (found["size"] or 0) // PART_BYTES)
    w = W.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    keyed = into(docs).repartition(parts, "_bucket").withColumn("_i", F.row_number().over(w))
    led = keyed.withColumns({"_last": F.lead(F.lit(1)).over(w).isNull(), "_id": F.lead("doc_id").over(w), "_text": F.lead("text").over(w)})
    # The next bucket's first row for each bucket's last one: buckets in groups, so that one window holds groups only.
    buckets = into(docs.select("doc_id")).select("_bucket").distinct().withColumn("_g", F.expr(f"_bucket div {GROUP * span}L"))
    groups = buckets.groupBy("_g").agg(F.min("_bucket").alias("_first"))
    order = W.orderBy("_g")
    groups = groups.select("_g", F.coalesce(F.lead("_first").over(order), F.first("_first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_later"))
    after = buckets.withColumn("_next", F.lead("_bucket").over(W.partitionBy("_g").orderBy("_bucket"))).join(groups, "_g").select(F.col("_bucket").alias("_of"), F.coalesce("_next", "_later").alias("_next"))
    heads = keyed.filter("_i = 1").select(F.col("_bucket").alias("_next"), F.col("doc_id").alias("_head_id"), F.col("text").alias("_head"))
    tails = after.join(heads, "_next").drop("_next")
    out = led.join(tails, (F.col("_bucket") == F.col("_of")) & F.col("_last"), "left")
    return out.select("_bucket", "_i", "doc_id", "text", F.when(F.col("_last"), F.col("_head_id")).otherwise(F.col("_id")).alias("next_id"), F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_text")).alias("next_text"))


KEYS = ["_bucket", "_i"]


def edited_of(rows: DataFrame) -> DataFrame:
    """rows(text, next_text) with n_chars and edited: the second half of the text replaced by the next one's beginning."""
    rows = settled(rows, n_chars=F.length("text").cast("long"), _half=F.expr("cast(length(text) div 2 as int)"))
    return settled(rows, edited=F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _half)"), F.expr("substring(next_text, 1, _half)"))).drop("_half")


def differing(rows: DataFrame, wider: int = 0) -> DataFrame:
    """_bucket, _i, how many digests only one side has for the pairs text/edited and text/next_text, and whether some stay hidden."""
    sets = edited_of(rows).select(*KEYS, digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("after"), digests(F.col("next_text")).alias("next"))
    left = peeled(differences(sets, KEYS, [("own", "after"), ("own", "next")], wider), KEYS, 2)
    count = lambda pair, side: F.sum(F.when((F.col("kind") % 2 == pair) & (F.col("cell") == side), F.col("n")).otherwise(0))
    return left.groupBy(*KEYS).agg(
        count(0, LEFT).alias("gone_edited"), count(0, RIGHT).alias("new_edited"), count(1, LEFT).alias("gone_next"), count(1, RIGHT).alias("new_next"), F.max(F.col("cell") >= 0).alias("stuck"),
    )


def likeness(size: Column, gone: str, new: str) -> Column:
    """Jaccard likeness from the left set's size and what only either has."""
    gone, new = F.coalesce(gone, F.lit(0)), F.coalesce(new, F.lit(0))
    union = size + new
    return F.when(union == 0, F.lit(1.0)).otherwise((size - gone) / F.greatest(union, F.lit(1)))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The columns of op8 for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(whole)
    own = edited_of(rows).select(*KEYS, "doc_id", "n_chars", "next_id", F.xxhash64("text").alias("_hash"), F.xxhash64("next_text").alias("_next_hash"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("_own"), digests(F.col("edited")).alias("_after"))
    own = settled(own.select("*", F.size("_own").alias("_n"), F.size("_after").alias("_m")), _cells=sketch(F.col("_own")), _cells2=sketch(F.col("_after")))
    own = own.select(*KEYS, "doc_id", "n_chars", "edited_sha256", written_out(F.col("_cells")).alias("fingerprint"), written_out(F.col("_cells2")).alias("edited_fingerprint"), "_n", "_m", "_hash", "next_id", "_next_hash")

    def told(left: DataFrame, found: DataFrame) -> DataFrame:
        x = left.join(found, KEYS, "left")
        fits = F.col("_n") - F.coalesce("gone_edited", F.lit(0)) + F.coalesce("new_edited", F.lit(0)) == F.col("_m")
        x = x.withColumn("_done", ~F.coalesce("stuck", F.lit(False)) & fits)
        return x.select(*left.columns, likeness(F.col("_n"), "gone_edited", "new_edited").alias("near_edited"), likeness(F.col("_n"), "gone_next", "new_next").alias("near_next"), "_done")

    was = spark.conf.get(_SUBSET_KEYS)
    spark.conf.set(_SUBSET_KEYS, "false")  # both sides have a bucket in one partition, so this join needs no shuffle
    try:
        done = written(told(own, differing(rows)), "fingerprints")
    finally:
        spark.conf.set(_SUBSET_KEYS, was)
    out, wider = done.filter("_done"), WIDER
    todo = done.filter("not _done").drop("near_edited", "near_next", "_done")
    while (stuck := todo.count()) > 0:
        wanted = todo.select(F.col("doc_id").alias("_d"), F.col("_hash").alias("_k")).union(todo.select("next_id", "_next_hash")).distinct()
        wanted = F.broadcast(wanted) if stuck <= FEW else wanted  # as a rule one pair in some ten thousands
        texts = whole.withColumn("_h", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "_h"])
        side = lambda name, key, at: todo.select(*KEYS, F.col(name).alias("_d"), F.col(key).alias("_k")).join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k"))).select(*KEYS, F.col("text").alias(at))  # noqa: E731, B023
        again = side("doc_id", "_hash", "text").join(side("next_id", "_next_hash", "next_text"), KEYS)
        tried = written(told(todo, differing(again, wider)), "fingerprints")
        out = out.unionByName(tried.filter("_done"))
        todo, wider = tried.filter("not _done").drop("near_edited", "near_next", "_done"), wider + WIDER
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("_n").cast("long").alias("n_paragraphs"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(read(spark, sf_dir, "documents"))
