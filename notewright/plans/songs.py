"""More operators over the driver's tables: notes by frame index, song assembly, catalogue cascades, small filters and formats."""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import alignment as A
from ..operators import hyphenation as H
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import music as M
from ..operators import spectra as SP
from ..sources import exports as EX
from ..sources import karaoke_txt as K
from ..sources import tables as TB
from .queries import _LINES, FR, MIDI, NAMES, _lines, frames, query, table

#: Segments of a fifth of a day from each purchase, and the frame nearest to both of their ends (the later of two).
_SEG = FR + """, sg AS (SELECT song_id, event_id AS seg, t AS st, t + 17280 AS en FROM fr WHERE word = 'purchase'),
en AS (SELECT song_id, seg, 0 AS e, st AS t FROM sg UNION ALL SELECT song_id, seg, 1, en FROM sg),
ix AS (SELECT song_id, seg, e, frame_idx FROM (SELECT en.song_id, seg, e, frame_idx, row_number() OVER (PARTITION BY en.song_id, seg, e ORDER BY abs(fr.t - en.t), fr.t DESC, frame_idx) AS r FROM en JOIN fr ON fr.song_id = en.song_id) WHERE r = 1),
rg AS (SELECT song_id, seg, max(frame_idx) FILTER (e = 0) AS lo, greatest(max(frame_idx) FILTER (e = 1), max(frame_idx) FILTER (e = 0) + 1) AS hi FROM ix GROUP BY ALL)"""


def _segments(f):
    return f.filter("word = 'purchase'").select("song_id", F.col("event_id").alias("seg"), F.col("t").alias("start"), (F.col("t") + 17280).alias("end"))


@query(f"WITH {_SEG} SELECT song_id, seg, lo AS first_frame, hi AS stop_frame FROM rg")
def q_index_range(spark, d):
    f = frames(spark, d)
    return J.index_ranges(_segments(f), f).select("song_id", "seg", "first_frame", "stop_frame")


@query(f"""WITH {_SEG}, j AS (SELECT rg.song_id, seg, conf, freq, frame_idx, max(CASE WHEN conf > 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY rg.song_id, seg) AS a FROM rg JOIN fr ON fr.song_id = rg.song_id AND frame_idx >= lo AND frame_idx < hi),
c AS (SELECT song_id, seg, {MIDI.format('freq')} AS midi, count(*) AS n, min(frame_idx) AS f FROM j WHERE conf > 0.4 OR a = 0 GROUP BY ALL)
SELECT song_id, seg, midi, n FROM (SELECT *, row_number() OVER (PARTITION BY song_id, seg ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def q_notes_by_index(spark, d):
    f = frames(spark, d)
    return M.notes_of(_segments(f), f)


@query(f"WITH {FR} SELECT song_id, event_id, conf FROM fr WHERE conf > 0.4")
def q_conf_filter(spark, d):
    return J.sure(frames(spark, d)).select("song_id", "event_id", "conf")


@query("SELECT a.l_orderkey AS song_id, a.l_linenumber AS seq, a.l_quantity::DOUBLE AS start, b.l_discount::DOUBLE AS stop FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_linenumber <> 3")
def q_zip(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("double").alias("start"), F.col("l_discount").cast("double").alias("stop"))
    return J.zipped(li.select("song_id", "seq", "start"), li.filter("seq <> 3").select("song_id", "seq", "stop"))


@query("SELECT o_orderkey AS song_id FROM orders o WHERE o_orderkey % 10 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def q_uncached(spark, d):
    todo = table(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"))
    done = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("song_id"))
    return J.uncached(todo, done, ["song_id"], F.col("song_id") % 10 == 0)


@query("SELECT o_custkey AS query, o_orderkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 10")
def q_first_rows(spark, d):
    return J.first_rows(table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ord")), ["query"], ["ord"], 10)


@query(f"WITH {FR} SELECT song_id, t AS step FROM fr WHERE frame_idx = 2")
def q_step_size(spark, d):
    return EX.step_sizes(frames(spark, d))


@query(f"""WITH {FR}, b AS (SELECT song_id, greatest(0, quantile_cont(CASE WHEN freq > 0 THEN log10(freq) END, 0.01) - 0.05) AS low, quantile_cont(CASE WHEN freq > 0 THEN log10(freq) END, 0.99) + 0.05 AS high FROM fr GROUP BY song_id),
m AS (SELECT unnest(range(12, 120))::INT AS m) SELECT song_id, {NAMES}[m % 12 + 1] || (m // 12 - 1) AS note, round(log10(440 * pow(2.0, (m - 69) / 12.0)), 9) AS y FROM b JOIN m ON log10(440 * pow(2.0, (m - 69) / 12.0)) BETWEEN low AND high""")
def q_pitch_axis(spark, d):
    return EX.pitch_axis(frames(spark, d)).select("song_id", "note", F.round("y", 9).alias("y"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS artist, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', ' - ') ELSE p_name END AS title, p_type AS channel FROM part)
SELECT p_partkey, CASE WHEN artist IS NOT NULL THEN trim(artist) WHEN contains(title, '-') THEN trim(split_part(title, '-', 1)) ELSE trim(channel) END AS artist,
 CASE WHEN artist IS NOT NULL THEN trim(title) WHEN contains(title, '-') THEN trim(split_part(title, '-', 2)) ELSE trim(title) END AS title FROM p""")
def q_video_title(spark, d):
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit(" - "))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", E.video_title(F.when(k % 3 == 0, F.col("p_brand")), title, title, F.col("p_type")).alias("x")).select("p_partkey", "x.artist", "x.title")


@query("""WITH p AS (SELECT p_partkey, p_brand || ' ' AS artist, ' ' || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN p_size || '.mp3' WHEN 1 THEN '' END AS mp3, CASE WHEN p_partkey % 6 <> 5 THEN 'a.' || p_size || '.ogg' END AS audio FROM part),
x AS (SELECT *, coalesce(nullif(mp3, ''), nullif(audio, '')) AS f FROM p)
SELECT p_partkey AS song_id, trim(artist) || ' - ' || trim(title) AS basename, 'in/' || f AS audio_file, CASE WHEN f IS NOT NULL THEN regexp_extract(f, '\\.([^./]*)$', 1) END AS extension, f IS NOT NULL AS found FROM x""")
def q_locate_audio(spark, d):
    k = F.col("p_partkey")
    heads = table(spark, d, "part").select(
        k.alias("song_id"), F.concat("p_brand", F.lit(" ")).alias("artist"), F.concat(F.lit(" "), "p_name").alias("title"),
        F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".mp3"))).when(k % 3 == 1, "").alias("mp3"), F.when(k % 6 != 5, F.concat(F.lit("a."), F.col("p_size").cast("string"), F.lit(".ogg"))).alias("audio"),
    )
    return K.located(heads, "in/")


@query("SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)")
def q_word_list(spark, d):
    w = table(spark, d, "documents").select("doc_id", TB.words_of(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS version FROM part")
def q_version_probe(spark, d):
    own = F.when(F.col("p_partkey") % 5 == 0, F.lit("MuseScore")).otherwise(F.concat(F.lit("MuseScore "), F.col("p_size").cast("string"), F.lit(" beta")))
    return table(spark, d, "part").select("p_partkey", E.version_in(F.array(F.lit("Notepad 7"), own, F.lit("MuseScore"))).alias("version"))


@query("""SELECT p_partkey, 'key: ' || p_brand AS tags, string_agg(x, '') AS tag_list FROM (SELECT p_partkey, p_brand, trim(unnest(string_split(p_type, ' '))) || ',' AS x FROM part) GROUP BY ALL""")
def q_tag_list(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("key: "), "p_brand").alias("tags"), E.tag_list(F.split("p_type", " ")).alias("tag_list"))


@query("""SELECT o_orderkey, [round(60.0::DOUBLE / b * q, 9) FOR q IN [4.0, 2.0, 1.0, 0.5, 0.25, 0.125]] AS lengths, regexp_replace(printf('%.2f', x), '0$', '') AS bpm_text, b / 4 * 4 AS real_bpm, CASE WHEN o_orderkey % 4 = 0 THEN 'note_event_x' ELSE 'plain' END AS snake,
 CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE ':' END AS note_type, ['Afar','Zulu','Persian'][(o_orderkey % 3 + 1)::INT] AS language, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 40 - 8 END AS file_pitch
FROM (SELECT o_orderkey, (o_orderkey % 200 + 30)::DOUBLE AS b, (o_orderkey % 1000)::DOUBLE / 8 AS x FROM orders)""")
def q_note_scalars(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", (k % 200 + 30).cast("double").alias("b"), ((k % 1000).cast("double") / 8).alias("x"))
    code = F.element_at(F.array(F.lit("aa"), F.lit("zu"), F.lit("fa")), (k % 3 + 1).cast("int"))
    name = F.when(k % 5 == 0, F.lit("H9")).otherwise(E.midi_to_name((k % 40 + 40).cast("int")))
    return o.select(
        "o_orderkey", F.array(*[F.round(E.note_length(F.col("b"), q), 9) for q in (4, 2, 1, 0.5, 0.25, 0.125)]).alias("lengths"), E.bpm_text(F.col("x")).alias("bpm_text"), E.real_bpm(E.file_bpm(F.col("b"))).alias("real_bpm"),
        E.snake(F.when(k % 4 == 0, "NoteEvent x").otherwise("plain")).alias("snake"), E.note_type(F.when(k % 3 == 0, "*").otherwise(":")).alias("note_type"), E.language_name(code).alias("language"), E.name_to_file_pitch(name).cast("long").alias("file_pitch"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['(a', 'b)c'] WHEN 1 THEN NULL ELSE ['a', '-b!!'] END AS syllables, p_partkey % 3 <> 1 AS punctuated, CASE p_partkey % 3 WHEN 0 THEN 'abc' WHEN 1 THEN 'abc' ELSE 'ab' END AS bare FROM part""")
def q_marked_syllables(spark, d):
    k = F.col("p_partkey") % 3
    word = F.when(k == 0, "(ab)c").when(k == 1, "abc").otherwise("a-b!!")
    parts = F.when(k == 0, F.array(F.lit("a"), F.lit("bc"))).when(k == 1, F.array(F.lit("abc"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "part").select("p_partkey", E.marked_syllables(word, parts).alias("syllables"), E.punctuated(word).alias("punctuated"), E.bare(word).alias("bare"))


_MEDIA = """md AS (SELECT p_partkey AS song_id, p_brand || ' - ' || p_name AS base, CASE p_partkey % 3 WHEN 0 THEN '0.2.0' WHEN 1 THEN '1.1.0' ELSE '1.2.0' END AS version, p_partkey % 2 AS k, p_brand, p_name, p_type, p_size FROM part)"""
_CAPS = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"


def _media(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("song_id"), F.concat_ws(" - ", "p_brand", "p_name").alias("basename"), F.when(k % 3 == 0, "0.2.0").when(k % 3 == 1, "1.1.0").otherwise("1.2.0").alias("version"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
        F.concat_ws("-", F.col("p_size") + 1960, F.lit("01-31")).alias("year"), F.lit("pop").alias("genre"), F.when(k % 2 == 0, "de").alias("language"), F.when(k % 2 == 0, "C major").alias("music_key"), F.lit("mp3").alias("audio_extension"),
        F.when(k % 2 == 0, "mp4").alias("video_extension"), F.lit("https://v").alias("video_url"), F.lit("https://c").alias("cover_url"), (k % 2 == 0).alias("has_cover"),
    )


@query(f"""WITH {_MEDIA}, vr AS (SELECT *, 'main' AS variant, p_name AS title, base || '.mp3' AS mp3 FROM md UNION ALL SELECT *, 'karaoke', base || ' [Karaoke]', base || ' [Karaoke].mp3' FROM md WHERE version = '0.2.0'),
ls AS (SELECT song_id, variant, unnest([CASE WHEN version >= '1.0.0' THEN '#VERSION:' || version END, '#ARTIST:' || p_brand, '#TITLE:' || title, '#YEAR:' || (p_size + 1960), CASE WHEN k = 0 THEN '#LANGUAGE:German' END, '#GENRE:Pop', CASE WHEN k = 0 THEN '#COVER:' || base || ' [CO].jpg' END,
 CASE WHEN version >= '1.2.0' THEN '#COVERURL:https://c' END, '#MP3:' || mp3, CASE WHEN version >= '1.1.0' THEN '#AUDIO:' || base || '.mp3' END, CASE WHEN version >= '1.1.0' THEN '#VOCALS:' || base || ' [Vocals].mp3' END, CASE WHEN version >= '1.1.0' THEN '#INSTRUMENTAL:' || base || ' [Instrumental].mp3' END,
 CASE WHEN k = 0 THEN '#VIDEO:' || base || '.mp4' END, CASE WHEN version >= '1.2.0' THEN '#VIDEOURL:https://v' END, CASE WHEN version >= '1.1.0' AND k = 0 THEN '#TAGS:key: C major' END, '#CREATOR:me 1', '#COMMENT:me 1', 'E']) AS line, unnest(range(18)) AS ord FROM vr)
SELECT song_id, variant, md5(string_agg(line, chr(10) ORDER BY ord)) AS content_md5 FROM ls WHERE line IS NOT NULL GROUP BY ALL""")
def q_song_assembly(spark, d):
    heads = K.song_headers(_media(spark, d), "me 1", karaoke=True).withColumn("song_id", F.struct("song_id", "variant"))
    return K.header_files(heads).select("song_id.song_id", "song_id.variant", F.md5("content").alias("content_md5"))


@query(f"WITH {_MEDIA} SELECT song_id, kind, base || ' [' || name || '].mp3' AS file FROM md JOIN (VALUES ('Karaoke', 'instrumental', true), ('Instrumental', 'instrumental', false), ('Vocals', 'vocals', false)) v(name, kind, old) ON (version = '0.2.0') = old")
def q_audio_files(spark, d):
    return K.audio_files(_media(spark, d).withColumn("extension", F.col("audio_extension")), karaoke=True)


_REPITCH = _LINES + f""", rp AS (SELECT ln.song_id, line_no::INT AS line_no, CASE WHEN line LIKE ': %' AND r.n IS NOT NULL THEN regexp_replace(line, '^(:\\s+\\S+\\s+\\S+\\s+)\\S+', '\\1' || (r.n % 30)) ELSE line END AS line
 FROM ln LEFT JOIN (SELECT song_id, line_no AS l, row_number() OVER (PARTITION BY song_id ORDER BY line_no) - 1 AS n FROM ln WHERE line LIKE ': %') r ON r.song_id = ln.song_id AND r.l = ln.line_no)"""


def _new_notes(lines):
    n = lines.filter(F.col("line").startswith(": ")).groupBy("song_id").agg(F.count("*").alias("n"))
    rows = n.select("song_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    return rows.select("song_id", F.col("seq").cast("int").alias("seq"), E.midi_to_name((F.col("seq") % 30 + 48).cast("int")).alias("note"))


@query(f"WITH {_REPITCH} SELECT song_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS content_md5 FROM rp GROUP BY song_id")
def q_repitch_file(spark, d):
    lines = _lines(spark, d)
    return K.repitched_files(lines, _new_notes(lines)).select("song_id", F.md5("content").alias("content_md5"))


@query(f"""WITH {_LINES}, al AS (SELECT song_id, line_no::DOUBLE AS ord, line FROM ln WHERE song_id % 2 = 0 UNION ALL SELECT song_id, line_no::DOUBLE, CASE WHEN line_no = 0 THEN '#COMMENT:given' ELSE line END FROM ln WHERE song_id % 2 = 1),
cm AS (SELECT song_id, min(ord) FILTER (line LIKE '#COMMENT:%') AS c, min(ord) FILTER (line SIMILAR TO '[:*FRG] .*') AS n FROM al GROUP BY song_id),
ot AS (SELECT al.song_id, ord, CASE WHEN ord = c THEN line || ' | Score ' || al.song_id ELSE line END AS line FROM al JOIN cm USING (song_id) UNION ALL SELECT song_id, n - 0.5, '#COMMENT:Score ' || song_id FROM cm WHERE c IS NULL)
SELECT song_id, md5(string_agg(line, chr(10) ORDER BY ord)) AS content_md5 FROM ot GROUP BY song_id""")
def q_finished_files(spark, d):
    lines = _lines(spark, d)
    given = lines.filter("song_id % 2 = 1").withColumn("line", F.when(F.col("line_no") == 0, "#COMMENT:given").otherwise(F.col("line")))
    scores = lines.select("song_id").distinct().withColumn("score", F.concat(F.lit("Score "), F.col("song_id").cast("string")))
    return K.finished_files(lines.filter("song_id % 2 = 0"), given, scores).select("song_id", F.md5("content").alias("content_md5"))


_CLEAN = "trim(lower(regexp_replace({0}, '[!-/:-@\\[-`{{-~]', '', 'g')))"


@query(f"""WITH rec AS (SELECT o_custkey AS query, o_orderkey AS ord, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '!' ELSE lower(o_orderstatus) END AS phrase, [NULL, o_orderstatus, o_orderpriority] AS credits FROM orders),
ar AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE '1-URGENT' END AS artist FROM customer), f AS (SELECT query, ord, phrase, unnest(credits) AS artist, unnest([0, 1, 2]) AS k FROM rec),
fd AS (SELECT query, phrase FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query ORDER BY ord, k) AS n FROM f SEMI JOIN ar ON f.query = ar.query AND f.artist = ar.artist) WHERE n = 1),
ow AS (SELECT rec.query, ord, rec.phrase, title, row_number() OVER (PARTITION BY rec.query ORDER BY ord DESC) AS n FROM rec JOIN fd ON fd.query = rec.query AND {_CLEAN.format('rec.phrase')} = {_CLEAN.format('fd.phrase')} WHERE contains('official 1urgent 2high 3medium', {_CLEAN.format('title')}))
SELECT query, phrase AS artist, title FROM ow WHERE n = 1""")
def q_one_line_link(spark, d):
    o = table(spark, d, "orders")
    phrase = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.lower("o_orderstatus"))
    rec = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), phrase.alias("phrase"), F.array(F.lit(None).cast("string"), "o_orderstatus", "o_orderpriority").alias("credits"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("1-URGENT").alias("artist"))
    return L.one_line_hit(c.select("query", F.lit("Official 1-URGENT 2-HIGH 3-MEDIUM (Official Video)").alias("text")), rec, c)


_LCS = "list_reduce(list_prepend([0 for y in range(len({1}) + 1)], [[ascii(x)] for x in string_split({0}, '')]), lambda row, x: [list_max([CASE WHEN k = 0 THEN 0 ELSE greatest(row[k + 1], CASE WHEN ascii({1}[k]) = x[1] THEN row[k] + 1 ELSE 0 END) END for k in range(j + 1)]) for j in range(len({1}) + 1)])[-1]"


@query(f"""WITH qs AS (SELECT c_custkey AS query, CASE c_custkey % 3 WHEN 0 THEN 'F' ELSE '3-medium' END AS artist, CASE c_custkey % 3 WHEN 0 THEN '3-LOW' WHEN 1 THEN 'O' ELSE 'none' END AS title FROM customer),
rc AS (SELECT o_custkey AS query, (o_orderkey % 2 + 1)::INT AS side, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS phrase, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS own FROM orders),
jn AS (SELECT rc.*, {_CLEAN.format('phrase')} = {_CLEAN.format("CASE WHEN side = 1 THEN artist ELSE title END")} AS same, {_CLEAN.format('own')} AS a, {_CLEAN.format("CASE WHEN side = 1 THEN title ELSE artist END")} AS b FROM rc JOIN qs USING (query)),
rt AS (SELECT *, CASE WHEN same THEN 2.0 * {_LCS.format('a', 'b')} / (len(a) + len(b)) END AS r FROM jn),
sd AS (SELECT query, side, max(r) AS r, arg_min({{'phrase': phrase, 'title': own}}, ord) FILTER (same) AS mine, arg_min({{'phrase': phrase, 'title': own}}, ord) AS anyone FROM rt GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(r, -1) DESC, CASE WHEN r IS NULL THEN -side ELSE side END DESC) AS n FROM sd)
SELECT query, side, CASE WHEN r IS NULL THEN anyone.phrase ELSE mine.phrase END AS artist, CASE WHEN r IS NULL THEN anyone.title ELSE mine.title END AS title FROM bs WHERE n = 1""")
def q_two_way_link(spark, d):
    k, odd = F.col("c_custkey") % 3, F.col("o_orderkey") % 2
    qs = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.when(k == 0, "F").otherwise("3-medium").alias("artist"), F.when(k == 0, "3-LOW").when(k == 1, "O").otherwise("none").alias("title"))
    rc = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), (odd + 1).cast("int").alias("side"), F.col("o_orderkey").alias("ord"), F.when(odd == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("phrase"), F.when(odd == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("title"))
    return L.two_way_hit(qs, rc)


@query("""WITH fl AS (SELECT l_orderkey AS query, l_linenumber AS n, l_partkey AS rid, l_suppkey AS gid FROM lineitem), rl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n, rid) AS k FROM fl),
yr AS (SELECT query, CASE WHEN gid % 4 = 0 THEN NULL ELSE (1900 + gid % 100)::VARCHAR END AS year FROM rl WHERE k = 1 AND gid % 5 <> 0), cv AS (SELECT query, rid, row_number() OVER (PARTITION BY query ORDER BY k) AS m FROM rl WHERE rid % 3 = 0)
SELECT o_orderkey AS query, year, 'front' || rid AS cover_url FROM orders LEFT JOIN yr ON yr.query = o_orderkey LEFT JOIN cv ON cv.query = o_orderkey AND m = 1""")
def q_release_facts(spark, d):
    # Of lines with one number and part the one that stands first in the table comes first, as in a stable sort.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "l_suppkey")
    rel = lines.groupBy(F.col("l_orderkey").alias("query")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "file", "row", "l_suppkey"))).alias("x"))
    rec = table(spark, d, "orders").select(F.col("o_orderkey").alias("query")).join(rel, "query", "left").select("query", F.transform("x", lambda r: F.struct(r["l_partkey"].alias("id"), r["l_suppkey"].alias("group_id"))).alias("releases"))
    g = F.col("s_suppkey")
    groups = table(spark, d, "supplier").filter(g % 5 != 0).select(g.alias("group_id"), F.when(g % 4 != 0, F.concat(F.lit(" "), (1900 + g % 100).cast("string"), F.lit("-02-03"))).alias("first_date"))
    p = F.col("p_partkey")
    images = table(spark, d, "part").select(p.alias("release_id"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit(False).alias("front"), F.lit("back").alias("url")), F.struct(F.lit(1).alias("ord"), (p % 3 == 0).alias("front"), F.concat(F.lit("front"), p.cast("string")).alias("url")))).alias("i")).select("release_id", "i.*")
    return L.release_facts(rec, groups, images)


@query("SELECT l_orderkey AS song_id, l_linenumber AS seq, 'chunk_' || l_linenumber || '_' || regexp_replace(l_shipdate::DATE::VARCHAR, '[^A-Za-z0-9]+', '', 'g') || '.wav' AS file, trunc(l_quantity::DOUBLE * 1000 * 2)::BIGINT AS first_frame, trunc((l_quantity::DOUBLE + 1) * 1000 * 2)::BIGINT AS last_frame FROM lineitem")
def q_line_chunks(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("line_no"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("word"), F.col("l_quantity").cast("double").alias("start_time"), (F.col("l_quantity").cast("double") + 1).alias("end_time"))
    return EX.line_chunks(li, 1000, 2)


#: Patterns by rule, as many as consonants times vowels: a cut before a consonant and a vowel, none after a word's first vowel, none within ch, ph, sh and th.
_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxz", "aeiouyäöüéèáíóúñ"
_PATTERNS = f"""co AS (SELECT unnest(string_split('{_CONSONANTS}', '')) AS c), vo AS (SELECT unnest(string_split('{_VOWELS}', '')) AS v), la AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang),
pt AS (SELECT lang, '1' || c || v AS pattern FROM la, co, vo UNION ALL SELECT lang, '.' || v || '2' FROM la, vo UNION ALL SELECT lang, c || '2h' FROM la, co WHERE c IN ('c', 'p', 's', 't')
  UNION ALL SELECT lang, '1' || c || 'h' || v FROM la, co, vo WHERE c IN ('c', 'p', 's', 't') UNION ALL SELECT lang, '2' || c || 'e.' FROM la, co WHERE lang IN ('en', 'fr')),
pd AS (SELECT lang, regexp_replace(pattern, '[0-9]', '', 'g') AS letters, string_split_regex(pattern, '[^0-9]') AS ds FROM pt), pr AS (SELECT lang, letters, place - 1 AS place, ds[place]::INT AS digit FROM pd, range(1, 8) AS r(place) WHERE place <= len(ds) AND ds[place] <> '')"""


def _rule_patterns(spark):
    rows = []
    for lang in ("de", "en", "es", "fr"):
        rows += [(lang, f"1{c}{v}") for c in _CONSONANTS for v in _VOWELS] + [(lang, f".{v}2") for v in _VOWELS] + [(lang, f"{c}2h") for c in "cpst"]
        rows += [(lang, f"1{c}h{v}") for c in "cpst" for v in _VOWELS] + [(lang, f"2{c}e.") for c in _CONSONANTS if lang in ("en", "fr")]
    # As an Arrow table its size is known to the planner, which then sends it to all tasks instead of shuffling the words' substrings.
    return spark.createDataFrame(pa.table({"lang": [x for x, _ in rows], "pattern": [p for _, p in rows]}))


@query(f"""WITH {_PATTERNS}, dt AS (SELECT lang, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n]+')) AS word FROM documents),
wd AS (SELECT lang, word, regexp_replace(word, '[!-/:-@\\[-`{{-~ ]', '', 'g') AS bare, count(*) AS n FROM dt WHERE word <> '' GROUP BY ALL),
bw AS (SELECT DISTINCT lang, lower(bare) AS w FROM wd WHERE len(lower(bare)) BETWEEN 4 AND 100), dw AS (SELECT lang, w, '.' || w || '.' AS d FROM bw),
st AS (SELECT *, unnest(range(1, len(d) + 1)) AS pos FROM dw), sb AS (SELECT lang, w, pos, k, substr(d, pos, k) AS letters FROM st, range(1, 5) AS r(k) WHERE pos + k - 1 <= len(d)),
ht AS (SELECT sb.lang, w, pos + place - 2 AS cut, max(digit) AS digit FROM sb JOIN pr ON pr.lang = sb.lang AND pr.letters = sb.letters GROUP BY ALL),
ct AS (SELECT lang, w, list(cut ORDER BY cut) AS cuts FROM ht WHERE digit % 2 = 1 AND cut BETWEEN 2 AND len(w) - 2 GROUP BY ALL)
SELECT wd.lang, word, n, array_to_string(list_transform(range(0, len(cuts) + 1), lambda i: substr(bare, CASE WHEN i = 0 THEN 1 ELSE cuts[i] + 1 END, CASE WHEN i = len(cuts) THEN len(bare) ELSE cuts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE cuts[i] END)), '-') AS syllables,
  (len(cuts) + 1)::INT AS n_syllables FROM wd LEFT JOIN ct ON ct.lang = wd.lang AND w = lower(bare) AND len(w) = len(bare)""")
def q_syllables(spark, d):
    docs = table(spark, d, "documents").select("lang", F.explode(F.split("text", "[ \\t\\n]+")).alias("word")).filter("word <> ''")
    # The words are asked for twice. Kept, they are counted once; else the marks would be taken off each word of each text before any is counted.
    words = docs.groupBy("lang", "word").agg(F.count("*").alias("n")).localCheckpoint(False, StorageLevel.DISK_ONLY)
    parts = H.hyphenated(words, _rule_patterns(spark))
    # No word holds a line's end, so one stands between its syllables while the marks go.
    return parts.select("lang", "word", "n", F.replace(E.bare(F.array_join("parts", "\n")), F.lit("\n"), F.lit("-")).alias("syllables"), F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_syllables"))


#: A song's frames as emissions of six symbols, its first four event types as words; quarters are exact in binary.
_SYMBOLS = ["-", "|", *"cdefgiklnoprsuvw"]


def _emissions(spark, d):
    f = frames(spark, d).select("song_id", F.lit(0).alias("segment"), (F.col("frame_idx") - 1).alias("frame"), "event_id")
    each = F.transform(F.array(*[F.lit(s) for s in _SYMBOLS]), lambda s, k: F.struct(s.alias("symbol"), (-((F.col("event_id") * (k * 5 + 3) + k) % 61) / F.lit(4.0)).alias("logp")))
    return f.select("song_id", "segment", "frame", F.inline(each))


_LOG = "(-((event_id * ({0} * 5 + 3) + {0}) % 61) / 4.0::DOUBLE)"


@query(f"""WITH RECURSIVE {FR}, wd AS (SELECT song_id, frame_idx AS seq, word, list_filter(string_split(lower(word), ''), lambda c: position(c IN 'cdefgiklnoprsuvw') > 0) AS cs FROM fr WHERE frame_idx <= 4),
kn AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY seq) AS n FROM wd WHERE len(cs) > 0),
tk AS (SELECT song_id, seq, unnest(CASE WHEN n > 1 THEN list_prepend('|', cs) ELSE cs END) AS c, unnest(range(CASE WHEN n > 1 THEN 0 ELSE 1 END, len(cs) + 1)) AS i FROM kn),
ls AS (SELECT song_id, list(position(c IN '-|cdefgiklnoprsuvw') - 1 ORDER BY seq, i) AS ks, list(CASE WHEN i = 0 THEN NULL ELSE seq END ORDER BY seq, i) AS own FROM tk GROUP BY ALL),
ev AS (SELECT song_id, frame_idx - 1 AS t, event_id, (count(*) OVER (PARTITION BY song_id))::INT AS frames FROM fr),
rc AS (SELECT song_id, -1 AS t, list_transform(range(0, len(ks) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE '-infinity'::DOUBLE END) AS sc, []::BOOLEAN[][] AS st FROM ls
 UNION ALL SELECT song_id, t, list_transform(range(1, len(sc) + 1), lambda j: greatest(stay[j], step[j])), list_append(st, list_transform(range(1, len(sc) + 1), lambda j: step[j] > stay[j]))
 FROM (SELECT rc.song_id, ev.t, sc, st, list_transform(sc, lambda x: x + {_LOG.format('0')}) AS stay,
  list_transform(range(0, len(sc)), lambda j: CASE WHEN j = 0 THEN '-infinity'::DOUBLE ELSE sc[j] + {_LOG.format('ks[j]')} END) AS step FROM rc JOIN ev ON ev.song_id = rc.song_id AND ev.t = rc.t + 1 JOIN ls ON ls.song_id = rc.song_id)),
en AS (SELECT rc.song_id, st FROM rc JOIN (SELECT DISTINCT song_id, frames FROM ev) f ON f.song_id = rc.song_id AND rc.t = frames - 1 WHERE sc[-1] > '-infinity'::DOUBLE),
bk AS (SELECT en.song_id, len(st) - 1 AS t, len(ks) AS j, st, st[-1][len(ks) + 1] AS moved FROM en JOIN ls USING (song_id)
 UNION ALL SELECT song_id, t - 1, j - moved::INT, st, st[t][j - moved::INT + 1] FROM bk WHERE j - moved::INT > 0),
pt AS (SELECT bk.song_id, own[j] AS seq, bk.t, exp(CASE WHEN moved THEN {_LOG.format('ks[j]')} ELSE {_LOG.format('0')} END) AS p FROM bk JOIN ls ON ls.song_id = bk.song_id JOIN ev ON ev.song_id = bk.song_id AND ev.t = bk.t)
SELECT wd.song_id, wd.seq, word, min(t) * 0.25::DOUBLE AS start, (max(t) + 1) * 0.25::DOUBLE AS stop, round(avg(p), 9) AS score FROM wd LEFT JOIN pt ON pt.song_id = wd.song_id AND pt.seq = wd.seq GROUP BY ALL""")
def q_forced_alignment(spark, d):
    first = frames(spark, d).filter("frame_idx <= 4").select("song_id", F.lit(0).alias("segment"), F.col("frame_idx").alias("seq"), "word", F.lit(0.0).alias("offset"))
    out = A.aligned(first, _emissions(spark, d), 0.25)
    return out.select("song_id", "seq", "word", "start", F.col("end").alias("stop"), F.round("score", 9).alias("score"))


@query(f"""WITH {FR}, f AS (SELECT song_id, frame_idx, t, log10(freq) AS y FROM fr WHERE freq > 0), e AS (SELECT song_id, min(t) AS lo, max(t) AS hi FROM f GROUP BY ALL),
x AS (SELECT f.*, least(floor(CASE WHEN hi > lo THEN (t - lo) / (hi - lo) ELSE 0 END * 50), 49)::INT AS px FROM f JOIN e USING (song_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id, px ORDER BY t, frame_idx) AS a, row_number() OVER (PARTITION BY song_id, px ORDER BY t DESC, frame_idx DESC) AS b,
  row_number() OVER (PARTITION BY song_id, px ORDER BY y, t, frame_idx) AS c, row_number() OVER (PARTITION BY song_id, px ORDER BY y DESC, t, frame_idx) AS d FROM x)
SELECT song_id, px, t, round(y, 9) AS y, frame_idx FROM r WHERE 1 IN (a, b, c, d)""")
def q_plot_points(spark, d):
    return EX.plot_points(frames(spark, d), 50).select("song_id", "px", "t", F.round("y", 9).alias("y"), "frame_idx")


@query()
def q_pitch_plot(spark, d):
    f = frames(spark, d)
    return EX.pitch_plot(f, gap=86400.0, words=f.filter("frame_idx % 20 = 1").select("song_id", "word", F.col("t").alias("start")))


def _event_blocks(spark, d, block, after):
    """A song's frequencies as samples: rows of `block` of them, with so many of the next ones."""
    f = frames(spark, d).select("song_id", (F.col("frame_idx") - 1).cast("long").alias("i"), (F.col("freq") / 1000).cast("float").alias("x"))
    totals = f.groupBy("song_id").agg(F.count("*").alias("total"))
    own = F.floor(F.col("i") / block)
    rows = f.select("song_id", "i", "x", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - block - after + 1) / block)), own)).alias("b"))
    rows = rows.groupBy("song_id", "b").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).join(totals, "song_id")
    first = F.col("b") * block
    return rows.select(F.col("song_id").cast("string").alias("song_id"), first.alias("first"), "total", F.lit(1000).alias("rate"), F.lit(0).alias("lead"), F.least(F.lit(block).cast("long"), F.col("total") - first).cast("int").alias("own"), F.transform("s", lambda v: v["x"]).alias("samples"))


@query(f"""WITH {FR}, s AS (SELECT song_id, frame_idx - 1 AS i, (freq / 1000)::FLOAT::DOUBLE AS x FROM fr), n AS (SELECT song_id, count(*) AS total FROM s GROUP BY ALL),
c AS (SELECT song_id, unnest(range(0, (total - 16) // 8 + 1)) AS "column" FROM n WHERE total >= 16), w AS (SELECT k, 0.5 - 0.5 * cos(2 * pi() * k / 15) AS w FROM range(16) AS r(k)),
v AS (SELECT c.song_id, "column", k, x * w AS v FROM c JOIN s ON s.song_id = c.song_id AND i >= "column" * 8 AND i < "column" * 8 + 16 JOIN w ON k = i - "column" * 8),
p AS (SELECT song_id, "column", bin, power(sum(v * cos(2 * pi() * bin * k / 16)), 2) + power(sum(v * sin(2 * pi() * bin * k / 16)), 2) AS p FROM v, range(9) AS b(bin) GROUP BY ALL)
SELECT * FROM (SELECT song_id::VARCHAR AS song_id, "column", bin::INT AS bin, round(10 * log10(CASE WHEN bin IN (0, 8) THEN p ELSE 2 * p END / (1000 * (SELECT sum(w * w) FROM w))), 4) AS db FROM p WHERE p > 0) WHERE db > -110""")
def q_spectrogram(spark, d):
    rows = SP.spectrogram(_event_blocks(spark, d, 32, 15), 16, 8)
    return rows.select("song_id", "column", "bin", F.round("db", 4).alias("db")).filter(F.col("db") > -110)
