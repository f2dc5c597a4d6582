"""Text functions that need Python: numbers in words, ASCII folding. Arrow batches, never row by row."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Number words of each language.
EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DE = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
DE_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
ES = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
ES_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
FR = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = "vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt".split()
ES_HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()

#: Powers of 1000 from 10^6 on: the short scale, the long one with -illiard between, and millions of millions.
EN_SCALES = [x + "illion" for x in "m b tr quadr quint sext sept oct non".split()]
DE_SCALES = [x + y for x in "M B Tr Quadr Quint Sext Sept Okt Non".split() for y in ("illion", "illiarde")]
FR_SCALES = [x + y for x in "m b tr quadr quint sext sept oct non".split() for y in ("illion", "illiard")]
ES_SCALES = [x + "ill" for x in "m b tr cuatr".split()]


def _split(n: int, scales: list[str], step: int) -> tuple[int, str, int]:
    """How many of the largest scale in n, its name, and the rest; scales are 10^6 and each step times the one before."""
    k = (len(str(n)) - 7) // (len(str(step)) - 1)
    if k >= len(scales):
        raise ValueError(n)
    much, rest = divmod(n, 10**6 * step**k)
    return much, scales[k], rest


def english(n: int) -> str:
    if n < 20:
        return EN[n]
    if n < 100:
        return EN_TENS[n // 10 - 2] + (f"-{EN[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{EN[n // 100]} hundred" + (f" and {english(n % 100)}" if n % 100 else "")
    much, name, rest = (n // 1000, "thousand", n % 1000) if n < 10**6 else _split(n, EN_SCALES, 1000)
    return f"{english(much)} {name}" + (("" if not rest else f" and {english(rest)}") if rest < 100 else f", {english(rest)}")


def german(n: int) -> str:
    if n < 20:
        return DE[n]
    if n < 100:
        unit = "ein" if n % 10 == 1 else DE[n % 10]
        return (f"{unit}und" if n % 10 else "") + DE_TENS[n // 10 - 2]
    if n < 1000:
        return ("ein" if n // 100 == 1 else DE[n // 100]) + "hundert" + (german(n % 100) if n % 100 else "")
    if n < 10**6:
        return ("ein" if n // 1000 == 1 else german(n // 1000)) + "tausend" + (german(n % 1000) if n % 1000 else "")
    much, name, rest = _split(n, DE_SCALES, 1000)
    return (f"eine {name}" if much == 1 else f"{german(much)} {name.removesuffix('e')}en") + (f" {german(rest)}" if rest else "")


def spanish(n: int) -> str:
    if n < 30:
        return ES[n]
    if n < 100:
        return ES_TENS[n // 10 - 3] + (f" y {ES[n % 10]}" if n % 10 else "")
    if n == 100:
        return "cien"
    if n < 1000:
        return ES_HUNDREDS[n // 100 - 1] + (f" {spanish(n % 100)}" if n % 100 else "")
    if n < 10**6:
        return ("" if n // 1000 == 1 else f"{spanish(n // 1000)} ") + "mil" + (f" {spanish(n % 1000)}" if n % 1000 else "")
    much, name, rest = _split(n, ES_SCALES, 10**6)
    return (f"un {name}ón" if much == 1 else f"{spanish(much)} {name}ones") + (f" {spanish(rest)}" if rest else "")


def french(n: int) -> str:
    if n < 20:
        return FR[n]
    if n < 100:
        tens, rest = FR_TENS[n // 10 - 2], n % 20 if n >= 60 else n % 10
        if not rest:
            return "quatre-vingts" if n == 80 else tens
        return f"{tens} et {FR[rest]}" if rest % 10 == 1 and n < 80 else f"{tens}-{FR[rest]}"
    if n < 1000:
        head = "cent" if n < 200 else f"{FR[n // 100]} cent"
        return f"{head} {french(n % 100)}" if n % 100 else head + ("s" if n >= 200 else "")
    if n < 10**6:
        much = french(n // 1000)
        much = much[:-1] if much.endswith(("cents", "vingts")) else much
        return ("" if n < 2000 else f"{much} ") + "mille" + (f" {french(n % 1000)}" if n % 1000 else "")
    much, name, rest = _split(n, FR_SCALES, 1000)
    return f"{french(much)} {name}" + ("s" if much > 1 else "") + (f" {french(rest)}" if rest else "")


LANGUAGES: dict[str, Callable[[int], str]] = {"en": english, "de": german, "es": spanish, "fr": french}
_TOKENS = regex.compile(r"\d+|\W+|\w+")


def spelled(line: str | None, language: str | None) -> str | None:
    """line with its numbers in words; a language without number words loses them, numbers beyond a language's scales stay."""
    if line is None:
        return None
    words = LANGUAGES.get(language or "")
    out = []
    for token in _TOKENS.findall(line):
        if token.isdecimal() and token.isascii():
            try:
                token = words(int(token)) if words else ""
            except ValueError:  # so for the digits that int() does not read
                pass
        out.append(token)
    return "".join(out)


@F.pandas_udf(T.StringType())
def number_words(line: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([spelled(a, b) for a, b in zip(line, language, strict=True)], dtype=object)


#: Latin letters that no decomposition takes apart, and signs with a usual ASCII spelling.
FOLDED = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H", "ŋ": "ng", "Ŋ": "NG", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "«": "<<", "»": ">>"}
_FOLD = str.maketrans(FOLDED)


def folded(text: str) -> str:
    """Letters without their marks; what has no ASCII form goes."""
    return text if text.isascii() else unicodedata.normalize("NFKD", text.translate(_FOLD)).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def ascii_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else folded(t))


def language_region(asked: DataFrame, installed: DataFrame, offered: DataFrame) -> DataFrame:
    """The dictionary for each asked language: installed xx_XX, else the first installed with a region, else offered xx, xx_XX, the first offered.

    asked(language), installed(code, ord), offered(code, ord); null where nothing fits. Codes meet languages as their beginnings, by an equi-join.
    """
    own = F.concat("language", F.lit("_"), F.upper("language"))
    rank = F.when(F.col("here") & (F.col("code") == own), 1).when(F.col("here"), 2).when(F.col("code") == F.col("language"), 3).when(F.col("code") == own, 4).otherwise(5)
    every = installed.withColumn("here", F.lit(True)).unionByName(offered.withColumn("here", F.lit(False))).filter(~F.col("here") | F.contains("code", F.lit("_")))
    heads = every.withColumn("language", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substr(F.col("code"), F.lit(1), n))))
    found = asked.join(heads, "language", "left").withColumn("_rank", rank)
    first = F.row_number().over(W.partitionBy("language").orderBy("_rank", "ord"))
    return found.withColumn("_n", first).filter("_n = 1").select("language", "code")
