"""Language identification: family first, then one-versus-one linear support vector machines within the family.

Features are the shares of hashed byte trigrams of the whole lower-cased text (runs of other ASCII become blanks), so a
classifier's value for a text is the mean weight of its trigrams: one pass, however long the text is. Families come from
the training rows: languages whose mean feature vectors are more alike than the average pair are one family.

Learning knows the LANGUAGES most frequent labels (of equals the first by name) and uses at most SAMPLE rows of each, TOTAL in all: those
with the smallest seeded hash of doc_id and text among the training rows (rows equal in both are one). So what comes to the driver is
bounded, however many labels a dirty column has; everything else covers all rows. Null and empty texts and texts without a letter
are `und` with score 0, as is everything when there is nothing to learn from. A prediction depends on the text alone: equal
texts get equal ones, whatever rows stand beside them; a tie of duels goes to the larger sum of values, then to the first
language by name. A very long text is one step of its own, read whole. All input columns stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mapped, read, steps

DIMS, SAMPLE, TOTAL, LANGUAGES, STEP, UNKNOWN, BLOCK = 4096, 500, 20_000, 256, 2 << 20, "und", 128
_B = np.arange(256)
_TABLE = np.where((_B >= 128) | ((_B >= 97) & (_B <= 122)), _B, np.where((_B >= 65) & (_B <= 90), _B + 32, 32)).astype(np.uint8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers at all places of all texts, and where each text's begin; a text has a blank before and after."""
    joined = pc.binary_join_element_wise(mapped(texts, _TABLE), *[pa.scalar(x, pa.large_string()) for x in (" ", "")])
    _, offsets, data = joined.buffers()
    raw = np.frombuffer(data, np.uint8)[: int(np.frombuffer(offsets, np.int64)[-1])].astype(np.uint32)
    ends = np.frombuffer(offsets, np.int64)[1 : len(texts) + 1] - 1  # each text's own blank at its end
    before, after = np.roll(raw, 1), np.roll(raw, -1)
    after[ends] = 32
    code = (before * np.uint32(0x9E3779B1)) ^ (raw * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    return code.astype(np.int64), np.frombuffer(offsets, np.int64)[: len(texts) + 1]


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def shares(texts: pa.Array) -> np.ndarray:
    code, at = trigrams(texts)
    out = np.stack([np.bincount(code[a:b], minlength=DIMS) for a, b in itertools.pairwise(at)]).astype(np.float32)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def machine(a: np.ndarray, side: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, both sides weigh the same) by accelerated descent; side: +1 or -1. The last column of a is 1."""
    weight = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum())).astype(np.float32)
    step = 1.0 / (2 * float((weight * np.einsum("ij,ij->i", a, a)).sum()) + penalty)
    w = ahead = np.zeros(a.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - side * (a @ ahead))
        new = ahead - step * (penalty * ahead - 2 * ((weight * side * slack) @ a))
        ahead, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


class Model:
    """families: lists of languages; pairs: (level, a, b) for column k of weights, positive for a. level -1: families.

    The rows x may be of half precision: only those of the pair at hand are held as doubles, once.
    """

    def __init__(self, x: np.ndarray, langs: list[str], sample: int = SAMPLE):
        names = sorted(set(langs))
        y = np.array([names.index(g) for g in langs], np.int64)
        mean, scale = np.empty(x.shape[1], np.float32), np.empty(x.shape[1], np.float32)
        for k in range(0, x.shape[1], BLOCK):
            wide = x[:, k : k + BLOCK].astype(np.float32)
            mean[k : k + BLOCK], scale[k : k + BLOCK] = wide.mean(axis=0), wide.std(axis=0) + 1e-4

        def scaled(take: np.ndarray) -> np.ndarray:
            """The rows as doubles, with a last column of ones."""
            at = np.flatnonzero(take)
            out = np.ones((len(at), x.shape[1] + 1))
            for k in range(0, len(at), BLOCK):
                out[k : k + BLOCK, :-1] = (x[at[k : k + BLOCK]].astype(np.float32) - mean) / scale / np.sqrt(x.shape[1])
            return out

        middle = np.stack([scaled(y == k)[:, :-1].mean(axis=0) for k in range(len(names))])
        unit = middle / np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
        like = unit @ unit.T
        group = list(range(len(names)))
        pairs = list(itertools.combinations(range(len(names)), 2))
        usual = np.mean([like[p] for p in pairs]) if pairs else 0
        for i, j in pairs:
            if len(names) > 2 and like[i, j] > usual:
                group = [group[i] if g == group[j] else g for g in group]
        self.families = [[names[k] for k in range(len(names)) if group[k] == g] for g in sorted(set(group))]
        kin = np.array([[g in f for f in self.families].index(True) for g in langs])
        lang = np.array(langs, object)
        self.pairs: list[tuple[int, int, int]] = []
        columns = []

        def fit(level: int, a: int, b: int, first: np.ndarray, second: np.ndarray) -> None:
            take = first | second
            w, bias = machine(scaled(take), np.where(first[take], 1, -1).astype(np.float32))
            w = w / scale / np.sqrt(x.shape[1])
            columns.append(np.append(w, bias - float(w @ mean)))
            self.pairs.append((level, a, b))

        for a, b in itertools.combinations(range(len(self.families)), 2):
            fit(-1, a, b, kin == a, kin == b)
        for level, family in enumerate(self.families):
            for a, b in itertools.combinations(range(len(family)), 2):
                fit(level, a, b, lang == family[a], lang == family[b])
        self.weights = np.array(columns, np.float64).T if columns else np.zeros((x.shape[1] + 1, 0))

    def values(self, texts: pa.Array) -> np.ndarray:
        code, at = trigrams(texts)
        out = np.empty((len(texts), len(self.pairs)))
        for k in range(len(self.pairs)):
            w = self.weights[:-1, k].astype(np.float32)[code]
            out[:, k] = np.add.reduceat(w, at[:-1], dtype=np.float64) / np.maximum(np.diff(at), 1) + self.weights[-1, k]
        return out

    def winners(self, values: np.ndarray, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class with the most duels won at a level (the larger sum of values on a tie), and its weakest duel as a likelihood."""
        won, total, least = np.zeros((len(values), n)), np.zeros((len(values), n)), np.full((len(values), n), np.inf)
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level:
                v = values[:, k]
                for c, s in ((a, v), (b, -v)):
                    won[:, c] += s > 0
                    total[:, c] += s
                    least[:, c] = np.minimum(least[:, c], s)
        best = np.argmax(won + 0.5 / (1 + np.exp(-np.clip(total, -30, 30))), axis=1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(values)), best], -15, 15)))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = self.values(texts)
        family, sure = self.winners(values, -1, len(self.families))
        names = np.full(len(values), UNKNOWN, object)
        for level, own in enumerate(self.families):
            best, likely = self.winners(values, level, len(own))
            here = family == level
            names[here] = np.array(own, object)[best[here]]
            sure[here] *= likely[here]
        return names, sure


def learned(rows: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model | None:
    """Fit on at most sample rows of each language of rows(doc_id, text, lang), within the bounds of all."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("_h", F.abs(F.xxhash64(F.lit(seed), "doc_id", "text") % 1_000_000_007))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    sample = min(sample, max(1, TOTAL // len(counts)))
    top = F.create_map(*[F.lit(v) for g, n in sorted(counts.items()) for v in (g, int(min(1.0, 1.5 * sample / n + 64 / n) * 1_000_000_007))])
    chosen = rows.filter(F.col("_h") <= top[F.col("lang")]).groupBy("_h", "lang").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            texts, keep = batch.column("text"), has_letter(batch.column("text"))
            if keep.any():
                batch = batch.filter(pa.array(keep))
                x = shares(texts.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("lang"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["h", "lang", "x"])

    lean()
    found = sorted(chosen.mapInArrow(featured, "h long, lang string, x binary").collect(), key=lambda r: (r["h"], r["lang"]))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in found:
        if seen[r["lang"]] < sample:
            seen[r["lang"]] += 1
            kept.append(r)
    if not kept:
        return None
    x, langs = np.empty((len(kept), DIMS), np.float16), [r["lang"] for r in kept]
    for k, r in enumerate(kept):
        x[k] = np.frombuffer(r["x"], np.float16)
    del found, kept, r  # the rows go before the model is fit
    return Model(x, langs)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; all columns stay (lang_pred and score are replaced if there)."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            texts = batch.column("text")
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            good = has_letter(texts)
            if model is not None and good.any():
                names[good], score[good] = model.predict(texts.filter(pa.array(good)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether the row is kept from learning; a row without a doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learned(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identified(rows, model).drop("text").select("doc_id", "held_out", "lang_pred", "score")
