"""Syllables by hyphenation patterns: substrings of distinct words joined to an injected pattern table.

A pattern is letters with digits between them; a full stop stands for either end of a word. Wherever a pattern's letters occur in a
word its digits rate the places between letters; the highest digit at a place counts, and a word may be cut where that is odd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

#: Letters of a word on each side of a cut at least, and letters of the longest word that is split.
LEFT, RIGHT, LONGEST = 2, 2, 100


def ratings(patterns: DataFrame) -> DataFrame:
    """patterns(lang, pattern) as lang, letters, rates (place within the letters, digit), each once."""
    p = F.lower("pattern")
    rate = F.transform(F.split(p, "[^0-9]"), lambda d, i: F.struct(i.alias("place"), d.try_cast("int").alias("digit")))
    own = patterns.select("lang", F.regexp_replace(p, "[0-9]", "").alias("letters"), F.filter(rate, lambda r: r["digit"] > 0).alias("rates"))
    return own.filter((F.size("rates") > 0) & (F.length("letters") > 0)).distinct()


def word_cuts(words: DataFrame, patterns: DataFrame, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """lang, word, cuts: each distinct bare word(lang, word) in lower case with the letters before each of its cuts; words without any are left out.

    The table of patterns may be of any size: it is joined on language and letters. A word of up to LONGEST letters
    sends its substrings that are as long as some pattern, and its hits meet by word and place.
    """
    rated = ratings(patterns)
    lengths = rated.agg(F.sort_array(F.collect_set(F.length("letters")))).scalar()
    # The word goes before the language in all keys: rows are then sorted by their first letters.
    bare = words.select(F.lower(E.bare(F.col("word"))).alias("word"), "lang").filter(F.length("word").between(left + right, LONGEST)).distinct()
    starts = bare.withColumn("_d", F.concat(F.lit("."), "word", F.lit("."))).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_d"))))
    parts = starts.withColumn("_n", F.explode(lengths)).filter(F.col("_at") + F.col("_n") - 1 <= F.length("_d")).withColumn("letters", F.substr("_d", "_at", "_n"))
    hit = parts.select("lang", "word", "_at", "letters").join(rated, ["lang", "letters"]).select("lang", "word", "_at", F.inline("rates"))
    # The place is counted in the dotted word, which has one character before the word's first letter.
    placed = hit.select("lang", "word", (F.col("_at") + F.col("place") - 2).alias("cut"), "digit").filter(F.col("cut").between(F.lit(left), F.length("word") - right))
    odd = placed.groupBy("word", "lang", "cut").agg(F.max("digit").alias("digit")).filter(F.col("digit") % 2 == 1)
    return odd.groupBy("word", "lang").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).select("lang", "word", "cuts")


def sliced(word: Column, cuts: Column) -> Column:
    """A word's pieces between its cuts."""
    starts = F.concat(F.array(F.lit(0)), cuts)
    stop = lambda i: F.coalesce(F.get(cuts, i), F.length(word))
    return F.transform(starts, lambda a, i: F.substr(word, a + 1, stop(i) - a))


def hyphenated(tokens: DataFrame, patterns: DataFrame, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """tokens(lang, word, ...) with parts: the word's syllables, its marks put back; null for a word of one syllable, of over LONGEST letters, or of a language without patterns."""
    found = word_cuts(tokens, patterns, left, right).select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), F.col("cuts").alias("_cuts"))
    # Each of these is a column of its own, so that it is worked out once for a row: a sort compares by columns, and lambdas look at them for each syllable.
    keyed = tokens.withColumn("_key", F.lower(E.bare(F.col("word"))))
    both = keyed.join(found, (F.col("_key") == F.col("_word")) & (F.col("lang") == F.col("_lang")), "left").withColumn("_bare", E.bare(F.col("word")))
    whole, plain = F.col("_cuts").isNotNull() & (F.length("_bare") == F.length("_word")), F.col("_bare") == F.col("word")
    cut = both.withColumn("_own", F.when(whole, sliced(F.col("_bare"), F.col("_cuts"))))
    parts = F.when(plain, F.col("_own")).otherwise(E.marked_syllables(F.col("word"), F.col("_own")))
    return cut.withColumn("parts", parts).drop("_key", "_lang", "_word", "_cuts", "_bare", "_own")
