"""Dimension tables that follow from a rule: notes, key templates, scales, quantising steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pitch class names, scales, key profiles, codec extensions, languages.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10]}
CODECS = {"aac": "aac", "mp3": "mp3", "opus": "opus", "vorbis": "ogg", "flac": "flac", "pcm_s16le": "wav", "pcm_s24le": "wav", "pcm_s32le": "wav", "ac3": "ac3", "eac3": "eac3"}
LANGUAGES = dict(x.strip().split(" ", 1) for x in """
aa Afar, ab Abkhazian, ae Avestan, af Afrikaans, ak Akan, am Amharic, an Aragonese, ar Arabic, as Assamese, av Avaric, ay Aymara, az Azerbaijani,
ba Bashkir, be Belarusian, bg Bulgarian, bi Bislama, bm Bambara, bn Bengali, bo Tibetan, br Breton, bs Bosnian, ca Catalan, ce Chechen, ch Chamorro,
co Corsican, cr Cree, cs Czech, cv Chuvash, cy Welsh, da Danish, de German, dv Divehi, dz Dzongkha, ee Ewe, el Greek, en English, eo Esperanto, es Spanish,
et Estonian, eu Basque, fa Persian, ff Fulah, fi Finnish, fj Fijian, fo Faroese, fr French, fy Western Frisian, ga Irish, gd Scottish Gaelic, gl Galician,
gn Guarani, gu Gujarati, gv Manx, ha Hausa, he Hebrew, hi Hindi, ho Hiri Motu, hr Croatian, ht Haitian Creole, hu Hungarian, hy Armenian, hz Herero,
ia Interlingua, id Indonesian, ie Interlingue, ig Igbo, ik Inupiaq, io Ido, is Icelandic, it Italian, iu Inuktitut, ja Japanese, jv Javanese, ka Georgian,
kg Kongo, ki Kikuyu, kj Kuanyama, kk Kazakh, kl Kalaallisut, km Khmer, kn Kannada, ko Korean, kr Kanuri, ks Kashmiri, ku Kurdish, kv Komi, kw Cornish,
ky Kyrgyz, la Latin, lb Luxembourgish, lg Ganda, li Limburgish, ln Lingala, lo Lao, lt Lithuanian, lu Luba-Katanga, lv Latvian, mg Malagasy, mh Marshallese,
mi Maori, mk Macedonian, ml Malayalam, mn Mongolian, mr Marathi, ms Malay, mt Maltese, my Burmese, na Nauru, nb Norwegian Bokmål, nd North Ndebele, ne Nepali,
ng Ndonga, nl Dutch, nn Norwegian Nynorsk, no Norwegian, nr South Ndebele, nv Navajo, ny Nyanja, oc Occitan, oj Ojibwa, om Oromo, or Odia, os Ossetic,
pa Punjabi, pi Pali, pl Polish, ps Pashto, pt Portuguese, qu Quechua, rm Romansh, rn Rundi, ro Romanian, ru Russian, rw Kinyarwanda, sa Sanskrit,
sc Sardinian, sd Sindhi, se Northern Sami, sg Sango, si Sinhala, sk Slovak, sl Slovenian, sm Samoan, sn Shona, so Somali, sq Albanian, sr Serbian, ss Swati,
st Southern Sotho, su Sundanese, sv Swedish, sw Swahili, ta Tamil, te Telugu, tg Tajik, th Thai, ti Tigrinya, tk Turkmen, tl Tagalog, tn Tswana, to Tongan,
tr Turkish, ts Tsonga, tt Tatar, tw Twi, ty Tahitian, ug Uyghur, uk Ukrainian, ur Urdu, uz Uzbek, ve Venda, vi Vietnamese, vo Volapük, wa Walloon, wo Wolof,
xh Xhosa, yi Yiddish, yo Yoruba, za Zhuang, zh Chinese, zu Zulu
""".split(","))


def names() -> Column:
    return F.array(*[F.lit(n) for n in NOTE_NAMES])


def note_dim(spark: SparkSession) -> DataFrame:
    """midi 0 to 127 with name, octave and frequency."""
    m = F.col("id").cast("int")
    return spark.range(128).select(
        m.alias("midi"),
        F.concat(F.element_at(names(), F.pmod(m, F.lit(12)) + 1), (F.floor(m / 12) - 1).cast("string")).alias("note"),
        (F.floor(m / 12) - 1).cast("int").alias("octave"),
        (440 * F.pow(F.lit(2.0), (m - 69) / 12)).alias("hz"),
    )


def quantize_dim(spark: SparkSession) -> DataFrame:
    """shift, mode, pc, delta: steps from a pitch class to the nearest one of the key, the lower of two as near."""
    rows = []
    for shift in range(12):
        for mode, scale in SCALES.items():
            allowed = {(shift + i) % 12 for i in scale}
            rows += [(shift, mode, pc, min((d for d in (0, -1, 1, -2, 2) if (pc + d) % 12 in allowed), key=lambda d: (abs(d), d))) for pc in range(12)]
    return spark.createDataFrame(rows, "shift int, mode string, pc int, delta int")


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)
