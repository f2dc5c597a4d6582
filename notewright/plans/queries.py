"""Every operator applied to the driver's tables: users are songs, their events notes, values frequencies.

Events become frames: song_id = user_id, frame_idx in time order, t in seconds, freq = value, conf = props.k / 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dims
from ..functions import expr as E
from ..functions import text as X
from ..operators import generators as G
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import music as M
from ..operators import sequences as S
from ..sources import exports as EX
from ..sources import tables as TB
from ..sources import karaoke_txt as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def frames(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.col("user_id").alias("song_id"), seconds().alias("t"), F.col("value").alias("freq"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("conf"), F.col("event_type").alias("word"))
    return ev.withColumn("frame_idx", F.row_number().over(W.partitionBy("song_id").orderBy("t", "event_id")))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Frames as notes: each lasts until an hour after, or the next one."""
    f = frames(spark, d).withColumn("_n", F.lead("t").over(W.partitionBy("song_id").orderBy("frame_idx")))
    return f.select("song_id", F.col("frame_idx").alias("seq"), "word", F.col("t").alias("start"), F.least(F.col("t") + 3600, F.coalesce("_n", F.col("t") + 3600)).alias("end"), F.col("word").alias("note"), "freq")


FR = """fr AS (SELECT event_id, user_id AS song_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS freq,
  json_extract_string(props, '$.k')::DOUBLE / 100 AS conf, event_type AS word,
  (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))::INT AS frame_idx FROM events)"""
NT = FR + """, nt AS (SELECT song_id, frame_idx AS seq, word, t AS start, freq,
  least(t + 3600, coalesce(lead(t) OVER (PARTITION BY song_id ORDER BY frame_idx), t + 3600)) AS stop FROM fr)"""
MIDI = "(CASE WHEN {0} > 0 THEN round_even(12 * (log2({0}) - log2(440.0)) + 69, 0)::INT END)"
NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(f"SELECT event_id, {MIDI.format('value')} AS midi, {NAMES}[({MIDI.format('value')} % 12 + 12) % 12 + 1] || (floor({MIDI.format('value')} / 12.0) - 1)::INT AS note, round(440 * pow(2.0, ({MIDI.format('value')} - 69) / 12.0), 6) AS hz FROM events")
def q_hz_to_note(spark, d):
    m = table(spark, d, "events").select("event_id", E.hz_to_midi(F.col("value")).alias("midi"))
    return m.select("event_id", "midi", E.midi_to_name(F.col("midi")).alias("note"), F.round(E.midi_to_hz(F.col("midi")), 6).alias("hz"))


@query(f"WITH {FR}, c AS (SELECT song_id, {MIDI.format('freq')} AS midi, count(*) AS n, min(frame_idx) AS f FROM fr GROUP BY ALL) SELECT song_id, midi, n FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1")
def q_modal_note(spark, d):
    f = frames(spark, d).withColumn("midi", E.hz_to_midi(F.col("freq")))
    return J.modal(f, ["song_id"], "midi", "frame_idx")


@query(f"WITH {FR}, m AS (SELECT *, max(CASE WHEN conf > 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id, word) AS a FROM fr) SELECT song_id, event_id, word, conf FROM m WHERE conf > 0.9 OR a = 0")
def q_conf_filter_fallback(spark, d):
    return J.confident(frames(spark, d), ["song_id", "word"], 0.9).select("song_id", "event_id", "word", "conf")


@query(f"WITH {FR}, p AS (SELECT a.song_id, a.event_id AS id, a.t, b.t AS near, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t DESC) AS r FROM fr a JOIN fr b ON a.song_id = b.song_id AND b.word = 'view' WHERE a.word = 'click') SELECT song_id, id, t, near FROM p WHERE r = 1")
def q_nearest_asof(spark, d):
    f = frames(spark, d)
    out = J.nearest(f.filter("word = 'click'").select("song_id", F.col("event_id").alias("id"), "t"), f.filter("word = 'view'").select("song_id", "t"))
    return out.filter(F.col("near").isNotNull())


@query(f"WITH {FR}, s AS (SELECT song_id, event_id AS seg, t AS start, t + 86400 AS stop FROM fr WHERE word = 'purchase') SELECT s.song_id, seg, count(*) AS n, max(frame_idx)::INT AS last_frame FROM s JOIN fr ON s.song_id = fr.song_id AND fr.t >= s.start AND fr.t < s.stop GROUP BY ALL")
def q_range_join(spark, d):
    f = frames(spark, d)
    s = f.filter("word = 'purchase'").select("song_id", F.col("event_id").alias("seg"), F.col("t").alias("start"), (F.col("t") + 86400).alias("end"))
    return J.in_range(s, f.select("song_id", "frame_idx", "t"), 86400.0).groupBy("song_id", "seg").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last_frame"))


@query(f"""WITH {FR}, s AS (SELECT song_id, event_id AS seg, t AS start, t + 86400 AS stop FROM fr WHERE word = 'purchase'),
j AS (SELECT s.song_id, seg, conf, freq, frame_idx, max(CASE WHEN conf > 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY s.song_id, seg) AS a FROM s JOIN fr ON s.song_id = fr.song_id AND fr.t >= s.start AND fr.t < s.stop),
c AS (SELECT song_id, seg, {MIDI.format('freq')} AS midi, count(*) AS n, min(frame_idx) AS f FROM j WHERE conf > 0.4 OR a = 0 GROUP BY ALL)
SELECT song_id, seg, midi, n FROM (SELECT *, row_number() OVER (PARTITION BY song_id, seg ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def q_segment_notes(spark, d):
    f = frames(spark, d)
    s = f.filter("word = 'purchase'").select("song_id", F.col("event_id").alias("seg"), F.col("t").alias("start"), (F.col("t") + 86400).alias("end"))
    return M.pitch_of(s, f.select("song_id", "frame_idx", "t", "freq", "conf"), 86400.0)


@query(f"WITH {NT}, m AS (SELECT *, CASE WHEN word = lag(word) OVER (PARTITION BY song_id ORDER BY seq) THEN 0 ELSE 1 END AS b FROM nt), i AS (SELECT *, (sum(b) OVER (PARTITION BY song_id ORDER BY seq))::BIGINT AS island FROM m) SELECT song_id, island, min(start) AS start, max(stop) AS stop, any_value(word) AS note, count(*) AS n FROM i GROUP BY ALL")
def q_note_islands(spark, d):
    return S.note_islands(notes(spark, d)).withColumnRenamed("end", "stop")


@query(f"""WITH {FR}, q AS (SELECT *, freq < 100 AS q FROM fr), m AS (SELECT *, CASE WHEN q AND lag(q) OVER (PARTITION BY song_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS b FROM q),
i AS (SELECT *, sum(b) OVER (PARTITION BY song_id ORDER BY frame_idx) AS island FROM m) SELECT song_id, min(t) AS start, max(t) AS stop FROM i WHERE q GROUP BY song_id, island HAVING max(t) - min(t) >= 3600""")
def q_silence_islands(spark, d):
    return S.silence_islands(frames(spark, d), F.col("freq") < 100, 3600.0).withColumnRenamed("end", "stop")


def _silences(spark, d):
    return frames(spark, d).filter("word = 'error'").select("song_id", F.col("t").alias("start"), (F.col("t") + 7200).alias("end"))


@query(f"WITH {FR} SELECT event_id, song_id FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr s WHERE s.word = 'error' AND s.song_id = a.song_id AND a.t >= s.t AND a.t < s.t + 7200)")
def q_mute_antijoin(spark, d):
    return J.unmuted(frames(spark, d), _silences(spark, d), 7200.0).select("event_id", "song_id")


_PIECE = "{'word': CASE WHEN more THEN '~' ELSE '~ ' END, 'start': e, 'stop': cut, 'we': NOT more}"


@query(f"""WITH RECURSIVE {NT}, tk AS (SELECT song_id, seq, word || ' ' AS word, start, stop FROM nt), si AS (SELECT song_id, t + 600 AS s, t + 900 AS e FROM fr WHERE word = 'error'),
ov AS (SELECT tk.song_id, seq, s, e, stop, row_number() OVER w AS k, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM tk JOIN si ON si.song_id = tk.song_id AND s <= stop AND e >= start WINDOW w AS (PARTITION BY tk.song_id, seq ORDER BY s, e)),
sl AS (SELECT *, CASE WHEN ns < stop THEN ns ELSE stop END AS cut, coalesce(ne < stop, false) AS more FROM ov),
rc AS (SELECT song_id, seq, 0::BIGINT AS k, word AS hw, start AS hs, stop AS he, true AS hl, []::STRUCT(word VARCHAR, start DOUBLE, stop DOUBLE, we BOOLEAN)[] AS ps, false AS sp, false AS gn FROM tk
 UNION ALL SELECT song_id, seq, k, CASE WHEN kind = 'first' THEN regexp_replace(hw, ' $', '') ELSE hw END, CASE WHEN kind IN ('moved', 'late') THEN e ELSE hs END, CASE kind WHEN 'moved' THEN cut WHEN 'whole' THEN s WHEN 'first' THEN s WHEN 'early' THEN s ELSE he END, hl AND kind <> 'first',
  CASE WHEN kind IN ('first', 'more') THEN list_append(ps, {_PIECE}) WHEN kind = 'close' THEN list_append(ps[:-2], {{'word': rtrim(ps[-1].word) || ' ', 'start': ps[-1].start, 'stop': ps[-1].stop, 'we': true}}) ELSE ps END, sp OR kind IN ('first', 'more', 'close'), gn OR kind = 'gone'
  FROM (SELECT r.song_id, r.seq, sl.k, hw, hs, he, hl, ps, sp, gn, s, e, cut, more, CASE WHEN gn OR s > stop OR e < hs THEN 'none' WHEN s >= hs AND e <= stop THEN
    CASE WHEN sp THEN CASE WHEN cut - e > 0.1 THEN 'more' WHEN NOT more AND len(ps) > 0 THEN 'close' ELSE 'none' END WHEN s - hs < 0.1 THEN 'moved' WHEN NOT cut - e > 0.1 THEN 'whole' ELSE 'first' END
    WHEN s < hs AND e > stop THEN 'gone' WHEN s < hs THEN 'late' WHEN sp THEN 'none' ELSE 'early' END AS kind FROM rc r JOIN sl ON sl.song_id = r.song_id AND sl.seq = r.seq AND sl.k = r.k + 1)),
fn AS (SELECT *, list_prepend({{'word': hw, 'start': hs, 'stop': he, 'we': hl}}, ps) AS a FROM (SELECT *, row_number() OVER (PARTITION BY song_id, seq ORDER BY k DESC) AS n FROM rc) WHERE n = 1 AND NOT gn),
ex AS (SELECT song_id, seq, unnest(range(len(a)))::INT AS piece_no, unnest(a) AS x FROM fn)
SELECT song_id, seq, piece_no, x.word AS word, x.start AS start, x.stop AS "end", x.we AS is_word_end FROM ex""")
def q_interval_subtract(spark, d):
    t = notes(spark, d).select("song_id", "seq", F.concat("word", F.lit(" ")).alias("word"), "start", "end", F.lit(True).alias("is_word_end"))
    return J.without_silence(t, _silences(spark, d).withColumns({"start": F.col("start") + 600, "end": F.col("start") + 900}))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 100000 AS dur, 60.0::DOUBLE / 120 / 4 AS size FROM orders),
n AS (SELECT *, CASE WHEN dur > size THEN floor(dur / size)::INT ELSE 1 END AS n FROM o),
m AS (SELECT *, n + CASE WHEN dur > size AND dur - n * size >= size / 2 THEN 1 ELSE 0 END AS m FROM n),
e AS (SELECT *, unnest(generate_series(0, m - 1))::INT AS piece_no FROM m)
SELECT o_orderkey AS song_id, piece_no, CASE WHEN m = 1 THEN 'la ' WHEN piece_no = 0 THEN 'la' WHEN piece_no = m - 1 THEN '~ ' ELSE '~' END AS word,
 round(piece_no * size, 8) AS start, round(CASE WHEN piece_no = m - 1 THEN dur ELSE (piece_no + 1) * size END, 8) AS stop FROM e""")
def q_grid_split(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"), F.lit(0).alias("seq"), F.lit("la ").alias("word"), F.lit(0.0).alias("start"), (F.col("o_totalprice") / 100000).alias("end"), F.lit(120.0).alias("bpm"))
    return G.grid_split(o).select("song_id", "piece_no", "word", F.round("start", 8).alias("start"), F.round("end", 8).alias("stop"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), 1) - 1 AS seq FROM documents),
p AS (SELECT doc_id, seq, regexp_extract_all(word, '.{1,3}') AS parts, len(word)::DOUBLE AS stop FROM w),
e AS (SELECT doc_id, seq, stop, len(parts) AS n, unnest(parts) AS word, unnest(range(0, len(parts)))::INT AS piece_no FROM p)
SELECT doc_id AS song_id, seq::INT AS seq, piece_no, word, round(CASE WHEN piece_no = 0 THEN 0 ELSE stop - stop / n * (n - piece_no) END, 6) AS start, round(stop - stop / n * (n - 1 - piece_no), 6) AS stop, piece_no = n - 1 AS is_word_end FROM e""")
def q_syllable_explode(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("song_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("seq", "word"))
    t = w.select("song_id", "seq", "word", F.lit(0.0).alias("start"), F.length("word").cast("double").alias("end"), F.regexp_extract_all("word", F.lit(".{1,3}"), F.lit(0)).alias("parts"))
    return G.syllables(t).select("song_id", "seq", "piece_no", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), "is_word_end")


@query(f"""WITH {FR}, w AS (SELECT song_id, frame_idx AS seq, CASE WHEN conf >= 0.1 THEN t END AS s, CASE WHEN conf >= 0.1 THEN t + 1 END AS e FROM fr),
k AS (SELECT *, count(e) OVER (PARTITION BY song_id ORDER BY seq) AS c, last_value(e IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY song_id, c ORDER BY seq) AS r FROM k)
SELECT song_id, seq, round(coalesce(s, CASE WHEN c = 0 THEN 0.2 * (r - 1) ELSE v + 0.2 * (r - 1) - 0.1 END), 3) AS start, round(coalesce(e, CASE WHEN c = 0 THEN 0.2 * (r - 1) + 0.1 ELSE v + 0.2 * (r - 1) END), 3) AS stop FROM n""")
def q_fill_missing_ts(spark, d):
    have = F.col("conf") >= 0.1
    w = frames(spark, d).select("song_id", F.col("frame_idx").alias("seq"), F.when(have, F.col("t")).alias("start"), F.when(have, F.col("t") + 1).alias("end"))
    return S.filled_times(w).select("song_id", "seq", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"))


@query(f"""WITH RECURSIVE {FR}, b AS (SELECT song_id, frame_idx AS seq, (event_id % 1000)::BIGINT AS want, (event_id % 7 + 1)::BIGINT AS length FROM fr),
r AS (SELECT song_id, seq, want, length, greatest(0, want) AS start_beat FROM b WHERE seq = 1
 UNION ALL SELECT b.song_id, b.seq, b.want, b.length, greatest(b.want, r.start_beat + r.length) FROM r JOIN b ON b.song_id = r.song_id AND b.seq = r.seq + 1)
SELECT song_id, seq, start_beat::BIGINT AS start_beat FROM r""")
def q_beat_scan(spark, d):
    b = frames(spark, d).select("song_id", F.col("frame_idx").alias("seq"), (F.col("event_id") % 1000).alias("want"), (F.col("event_id") % 7 + 1).alias("length"))
    return S.beat_scan(b).select("song_id", "seq", "start_beat")


@query("SELECT o_orderkey, greatest(ceil(400.0::DOUBLE / bpm) - 1, 0)::INT AS multiplier, round_even(o_totalprice / 1000 * bpm / 60, 0)::INT AS beat, round(o_totalprice / 1000 * 60 / bpm, 9) AS second FROM (SELECT *, (o_orderkey % 200 + 30)::DOUBLE AS bpm FROM orders)")
def q_beat_quantize(spark, d):
    o = table(spark, d, "orders").withColumn("bpm", (F.col("o_orderkey") % 200 + 30).cast("double"))
    x = F.col("o_totalprice") / 1000
    return o.select("o_orderkey", E.beat_multiplier(F.col("bpm")).alias("multiplier"), E.half_even(E.second_to_beat(x, F.col("bpm"))).alias("beat"), F.round(E.beat_to_second(x, F.col("bpm")), 9).alias("second"))


DEV = """g AS (SELECT song_id, lead(start) OVER (PARTITION BY song_id ORDER BY seq) - stop AS gap FROM nt), h AS (SELECT *, max(gap) OVER (PARTITION BY song_id) AS top FROM g WHERE gap IS NOT NULL),
dv AS (SELECT song_id, CASE WHEN count(*) >= 5 AND sum(gap) <> 0 THEN coalesce(avg(gap) FILTER (gap < top), 0) ELSE 0 END AS deviation FROM h GROUP BY song_id)"""


@query(f"WITH {NT}, {DEV} SELECT song_id, round(deviation, 4) AS deviation FROM dv")
def q_gap_deviation(spark, d):
    return S.gap_deviation(S.gaps(notes(spark, d))).select("song_id", F.round("deviation", 4).alias("deviation"))


@query(f"""WITH {NT}, {DEV}, x AS (SELECT nt.song_id, seq, seq % 3 = 0 AS ends, lead(seq) OVER w IS NULL AS last, coalesce(lead(start) OVER w - stop, 0) AS gap FROM nt WINDOW w AS (PARTITION BY nt.song_id ORDER BY seq)),
y AS (SELECT x.*, deviation, coalesce(sum(ends::INT) OVER (PARTITION BY x.song_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wd FROM x JOIN dv ON x.song_id = dv.song_id),
z AS (SELECT *, coalesce(bool_or(gap > deviation) FILTER (NOT ends) OVER (PARTITION BY song_id, wd), false) AS inner_gap FROM y)
SELECT song_id, seq, ends AND ((NOT last AND deviation <> 0 AND gap > deviation) OR inner_gap) AS line_break FROM z""")
def q_linebreaks(spark, d):
    n = notes(spark, d).withColumn("word", F.when(F.col("seq") % 3 == 0, F.concat("word", F.lit(" "))).otherwise(F.col("word")))
    return S.line_breaks(n, S.gap_deviation(S.gaps(n))).select("song_id", "seq", "line_break")


def _chroma(spark, d):
    return frames(spark, d).groupBy("song_id", F.pmod(E.hz_to_midi(F.col("freq")), F.lit(12)).alias("pc")).agg(F.count("*").cast("double").alias("weight"))


_KEYS = """kt AS (SELECT s.shift, m.mode, s.shift * 2 + m.k AS ord, p.pc, CASE WHEN list_contains(m.scale, (p.pc - s.shift + 12) % 12) THEN 1.0::DOUBLE ELSE 0 END AS weight FROM (SELECT unnest(range(12))::INT AS shift) s, (SELECT unnest(range(12))::INT AS pc) p, (VALUES ('major', 0, [0,2,4,5,7,9,11]), ('minor', 1, [0,2,3,5,7,8,10])) m(mode, k, scale))"""
_KEY = f"""ch AS (SELECT song_id, ({MIDI.format('freq')} % 12 + 12) % 12 AS pc, count(*)::DOUBLE AS x FROM fr GROUP BY ALL), {_KEYS},
cf AS (SELECT g.song_id, shift, mode, ord, corr(coalesce(x, 0), weight) AS r FROM (SELECT DISTINCT song_id FROM ch) g CROSS JOIN kt LEFT JOIN ch ON ch.song_id = g.song_id AND ch.pc = kt.pc GROUP BY ALL),
ky AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(r, 9) DESC, ord) AS n FROM cf WHERE r IS NOT NULL AND NOT isnan(r)) WHERE n = 1)"""


@query(f"WITH {FR}, {_KEY} SELECT song_id, {NAMES}[shift + 1] AS key, mode, round(r, 6) AS r FROM ky")
def q_key_detect(spark, d):
    return M.key_of(_chroma(spark, d))


@query(f"""WITH {FR}, {_KEYS}, qd AS (SELECT a.shift, a.mode, a.pc, arg_min(s.delta, (abs(s.delta), s.delta)) AS delta FROM kt a, (SELECT unnest([0,-1,1,-2,2])::INT AS delta) s JOIN kt b ON b.weight = 1 WHERE b.shift = a.shift AND b.mode = a.mode AND b.pc = (a.pc + s.delta + 12) % 12 GROUP BY ALL)
SELECT event_id, {MIDI.format('freq')} AS midi, {MIDI.format('freq')} + delta AS quantized FROM fr JOIN qd ON qd.shift = song_id % 12 AND qd.mode = 'major' AND qd.pc = ({MIDI.format('freq')} % 12 + 12) % 12""")
def q_quantize_to_key(spark, d):
    f = frames(spark, d).withColumn("midi", E.hz_to_midi(F.col("freq")))
    keys = f.select("song_id").distinct().select("song_id", (F.col("song_id") % 12).cast("int").alias("shift"), F.lit("major").alias("mode"))
    return M.quantized(f, keys).select("event_id", "midi", "quantized")


_SCORE = f"""WITH {FR}, ln AS (SELECT song_id, frame_idx AS line_no, CASE event_id % 5 WHEN 0 THEN '*' WHEN 1 THEN 'F' WHEN 2 THEN 'R' ELSE ':' END AS note_type, {MIDI.format('freq')} - 48 AS pitch, t AS st, t + 0.2 AS en FROM fr),
tot AS (SELECT song_id, count(*) AS lines FROM ln GROUP BY song_id), pr AS (SELECT *, greatest(1, trunc((en - st) / 0.09)::INT) AS parts FROM ln WHERE note_type <> 'F'),
pt AS (SELECT *, unnest(range(parts))::INT AS part FROM pr), sg AS (SELECT *, st + part * 0.09::DOUBLE AS s, CASE WHEN part = parts - 1 THEN en ELSE st + (part + 1) * 0.09::DOUBLE END AS e FROM pt),
fd AS (SELECT song_id, t, min(frame_idx) AS i FROM fr GROUP BY ALL), xs AS (SELECT song_id, line_no, part, unnest([0, 1]) AS z, unnest([s, e]) AS x FROM sg),
ba AS (SELECT xs.*, b.t AS bt, b.i AS bi FROM xs ASOF LEFT JOIN fd b ON b.song_id = xs.song_id AND b.t <= x), ab AS (SELECT ba.*, a.t AS at_, a.i AS ai FROM ba ASOF LEFT JOIN fd a ON a.song_id = ba.song_id AND a.t >= x),
nx AS (SELECT song_id, line_no, part, z, CASE WHEN ai IS NULL OR x - bt < at_ - x THEN bi ELSE ai END AS i FROM ab),
rg AS (SELECT song_id, line_no, part, max(i) FILTER (z = 0) AS lo, greatest(max(i) FILTER (z = 1), max(i) FILTER (z = 0) + 1) AS hi FROM nx GROUP BY ALL),
j AS (SELECT rg.song_id, line_no, part, conf, freq, frame_idx, max(CASE WHEN conf > 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY rg.song_id, line_no, part) AS a FROM rg JOIN fr ON fr.song_id = rg.song_id AND frame_idx >= lo AND frame_idx < hi),
c AS (SELECT song_id, line_no, part, {MIDI.format('freq')} AS midi, count(*) AS n, min(frame_idx) AS f FROM j WHERE conf > 0.4 OR a = 0 GROUP BY ALL),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id, line_no, part ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
ht AS (SELECT sg.song_id, sg.line_no, note_type, parts, coalesce(midi = pitch + 48, false) AS ha, coalesce((midi % 12 + 12) % 12 = ((pitch + 48) % 12 + 12) % 12, false) AS hs FROM sg LEFT JOIN md USING (song_id, line_no, part)),
bl AS (SELECT song_id, line_no, note_type, parts, count(*) FILTER (ha) AS accurate, count(*) FILTER (hs) AS simple FROM ht GROUP BY ALL),
kd AS (SELECT song_id, note_type, parts, 'accurate' AS granularity, accurate AS hits FROM bl UNION ALL SELECT song_id, note_type, parts, 'simple', simple FROM bl),
sm AS (SELECT song_id, granularity, sum(parts) AS parts, coalesce(sum(hits) FILTER (note_type NOT IN ('*', 'G')), 0) AS n, coalesce(sum(2 * hits) FILTER (note_type IN ('*', 'G')), 0) AS g, count(*) FILTER (hits = parts) AS fl FROM kd GROUP BY ALL),
bo AS (SELECT *, fl * (1000.0::DOUBLE / lines) AS bonus FROM sm JOIN tot USING (song_id)), tp AS (SELECT *, CASE WHEN bonus = 0 THEN 10000 ELSE 9000 END AS top FROM bo)
SELECT song_id, granularity, top AS max_score, round_even(top * n / parts::DOUBLE, 0)::INT AS notes, g::INT AS golden, round_even(bonus, 0)::INT AS line_bonus, round_even(round_even(top * n / parts::DOUBLE, 0) + bonus + g, 0)::INT AS score FROM tp"""


@query(_SCORE)
def q_score(spark, d):
    f = frames(spark, d)
    kind = F.when(F.col("event_id") % 5 == 0, "*").when(F.col("event_id") % 5 == 1, "F").when(F.col("event_id") % 5 == 2, "R").otherwise(":")
    lines = f.select("song_id", F.col("frame_idx").alias("line_no"), kind.alias("note_type"), "word", (E.hz_to_midi(F.col("freq")) - 48).alias("pitch"), F.col("t").alias("start_time"), (F.col("t") + 0.2).alias("end_time"))
    return M.score(lines, f.select("song_id", "frame_idx", "t", "freq", "conf"))


@query(f"WITH {FR} SELECT song_id, round(quantile_cont(CASE WHEN freq > 0 THEN log10(freq) END, 0.01), 6) AS low, round(quantile_cont(CASE WHEN freq > 0 THEN log10(freq) END, 0.99), 6) AS high FROM fr GROUP BY song_id")
def q_percentile_bounds(spark, d):
    p = frames(spark, d).groupBy("song_id").agg(F.percentile(F.log10("freq"), F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    return p.select("song_id", F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


@query(f"WITH {FR}, g AS (SELECT song_id, frame_idx, t, freq, t - lag(t) OVER (PARTITION BY song_id ORDER BY frame_idx) > 86400 AS late FROM fr) SELECT song_id, frame_idx, t, false AS marker FROM g UNION ALL SELECT song_id, frame_idx, t, true FROM g WHERE late")
def q_gap_markers(spark, d):
    return S.gap_markers(frames(spark, d), 86400.0).select("song_id", "frame_idx", "t", "marker")


@query(r"SELECT o_orderkey, coalesce(nullif(regexp_extract(x, '\b\d{4}\b', 0), ''), x) AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS x FROM orders)")
def q_year(spark, d):
    k = F.col("o_orderkey") % 3
    x = F.when(k == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", E.year(x).alias("year"))


_CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"


@query(f"SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split(translate(replace(lower(p_type), ' ', '/') || ';rock-pop, ', ';/', ',,'), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: array_to_string(list_transform(string_split(x, '-'), lambda y: {_CAP.format('y')}), '-')), ', ') AS genres FROM part")
def q_genre(spark, d):
    return table(spark, d, "part").select("p_partkey", E.genres(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit(";rock-pop, "))).alias("genres"))


@query(r"""SELECT page_id, translate(translate(x, '?:"', ''), '<>/\|*', '()----') AS file_name, regexp_replace(url, '[^A-Za-z0-9]+', '', 'g') AS chunk_name FROM (SELECT page_id, url, url || '<a>|*?' AS x FROM pages)""")
def q_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", E.file_name(F.concat("url", F.lit("<a>|*?"))).alias("file_name"), E.alphanumeric(F.col("url")).alias("chunk_name"))


@query(r"SELECT doc_id, md5(trim(lower(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')))) AS clean FROM documents")
def q_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(E.clean(F.col("text"))).alias("clean"))


@query("SELECT p_partkey, coalesce(map {'aac': 'aac', 'mp3': 'mp3', 'opus': 'opus', 'vorbis': 'ogg', 'flac': 'flac', 'pcm_s16le': 'wav', 'ac3': 'ac3'}[c], 'wav') AS extension FROM (SELECT p_partkey, ['aac','mp3','opus','vorbis','flac','pcm_s16le','ac3','other'][(p_partkey % 8 + 1)::INT] AS c FROM part)")
def q_codec_map(spark, d):
    codec = F.element_at(F.array(*[F.lit(x) for x in ("aac", "mp3", "opus", "vorbis", "flac", "pcm_s16le", "ac3", "other")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", dims.lookup(dims.CODECS, codec, F.lit("wav")).alias("extension"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN [p_size // 10, p_size % 10, 0] >= [1, 1, 0] WHEN 1 THEN p_size >= 2 WHEN 2 THEN [p_size // 10, p_size % 10] >= [1, 1] WHEN 3 THEN [p_size // 10, p_size % 10, 0] > [1, 1, 0]
 WHEN 4 THEN [p_size // 10, p_size % 10, 0] >= [1, 1, 0] WHEN 5 THEN [p_size // 10, p_size % 10] > [1, 1] ELSE false END AS gate FROM part""")
def q_version_gate(spark, d):
    number = F.concat_ws(".", F.expr("p_size div 10").cast("string"), (F.col("p_size") % 10).cast("string"))
    kinds = [F.concat(number, F.lit(".0")), F.col("p_size").cast("string"), number, F.concat(number, F.lit(".0rc1")), F.concat(number, F.lit(".0.post1")), F.concat(number, F.lit(".dev2")), F.concat(number, F.lit(".x")), F.lit("")]
    v = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", E.at_least(v, "1.1.0").alias("gate"))


@query("""WITH rec AS (SELECT o_custkey AS query, o_orderkey AS ord, o_orderpriority AS title, [o_orderstatus, o_orderpriority] AS credits FROM orders), ar AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE '1-URGENT' END AS artist FROM customer),
f AS (SELECT query, ord, title, unnest(credits) AS artist, unnest([0, 1]) AS k FROM rec) SELECT query, title, artist FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query ORDER BY ord, k) AS n FROM f SEMI JOIN ar ON f.query = ar.query AND f.artist = ar.artist) WHERE n = 1""")
def q_catalogue_link(spark, d):
    rec = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus", "o_orderpriority").alias("credits"))
    ar = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("1-URGENT").alias("artist"))
    return L.catalogue_hit(rec, ar)


@query("""WITH a AS (SELECT o_custkey AS query, o_orderkey AS ord, o_orderpriority AS artist, o_orderstatus AS title, o_totalprice::BIGINT % 100 / 100.0::DOUBLE AS r, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS side FROM orders),
b AS (SELECT query, side, max(r) AS r, arg_min({'artist': artist, 'title': title}, ord) AS f FROM a GROUP BY ALL)
SELECT query, side, f.artist AS artist, f.title AS title FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r DESC, side DESC) AS n FROM b) WHERE n = 1""")
def q_swap_link(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("artist"), F.col("o_orderstatus").alias("title"), (F.rint("o_totalprice").cast("long") % 100 / 100).alias("_r"))
    return L.swapped_link(o.filter("ord % 2 = 0"), o.filter("ord % 2 <> 0"), F.col("_r"))


@query("""WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entry FROM part), e AS (SELECT entry, row_number() OVER (ORDER BY entry) AS ord FROM d), w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS word FROM documents)
SELECT word, entry, distance FROM (SELECT word, entry, levenshtein(word, entry)::INT AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, entry), ord) AS n FROM w, e) WHERE n = 1""")
def q_nearest_word(spark, d):
    entries = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("entry")).distinct().select("entry", F.col("entry").alias("ord"))
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return L.nearest_word(words, entries)


def _lines(spark, d):
    f = frames(spark, d).select("song_id", "frame_idx", "event_id", "freq")
    note = F.concat_ws(" ", F.when(F.col("event_id") % 4 == 0, "*").otherwise(":"), (F.col("frame_idx") * 4).cast("string"), (F.col("event_id") % 5 + 1).cast("string"), (E.hz_to_midi(F.col("freq")) - 48).cast("string"), F.lit("la "))
    body = f.select("song_id", (F.col("frame_idx") + 2).alias("line_no"), note.alias("line"))
    heads = f.select("song_id").distinct().select("song_id", F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("#BPM:120,5").alias("line")), F.struct(F.lit(1).alias("line_no"), F.lit("#GAP:500").alias("line")), F.struct(F.lit(2).alias("line_no"), F.lit("#VIDEOGAP:3").alias("line")))).alias("x")).select("song_id", "x.*")
    return heads.unionByName(body)


_LINES = FR + f""", ln AS (SELECT song_id, frame_idx + 2 AS line_no, concat_ws(' ', CASE WHEN event_id % 4 = 0 THEN '*' ELSE ':' END, frame_idx * 4, event_id % 5 + 1, {MIDI.format('freq')} - 48, 'la ') AS line FROM fr
 UNION ALL SELECT DISTINCT song_id, 0, '#BPM:120,5' FROM fr UNION ALL SELECT DISTINCT song_id, 1, '#GAP:500' FROM fr UNION ALL SELECT DISTINCT song_id, 2, '#VIDEOGAP:3' FROM fr)"""


@query(f"WITH {FR} SELECT song_id, (frame_idx + 2)::INT AS line_no, CASE WHEN event_id % 4 = 0 THEN '*' ELSE ':' END AS note_type, {MIDI.format('freq')} - 48 AS pitch, CASE WHEN freq > 0 THEN 'la' ELSE '' END AS word, round(frame_idx * 4 * 60 / 482.0 + 0.5, 6) AS start_time, round((frame_idx * 4 + event_id % 5 + 1) * 60 / 482.0 + 0.5, 6) AS end_time FROM fr")
def q_txt_parse(spark, d):
    return K.note_lines(_lines(spark, d)).select("song_id", "line_no", "note_type", "pitch", "word", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query(f"WITH {_LINES} SELECT song_id, md5(string_agg(line, chr(10) ORDER BY line_no) || chr(10) || 'E') AS content_md5 FROM ln GROUP BY song_id")
def q_txt_write(spark, d):
    return K.files(_lines(spark, d).withColumnRenamed("line_no", "ord")).select("song_id", F.md5("content").alias("content_md5"))


@query(f"WITH {_LINES} SELECT song_id, line_no::INT AS line_no, CASE WHEN line LIKE ': %' THEN regexp_replace(line, '^(:\\s+\\S+\\s+\\S+\\s+)\\S+', '\\1' || (line_no % 24)) ELSE line END AS line FROM ln")
def q_repitch(spark, d):
    lines = _lines(spark, d)
    return S.repitched(lines, lines.select("song_id", "line_no", (F.col("line_no") % 24).alias("pitch")))


@query(f"WITH {_LINES}, x AS (SELECT song_id, line_no::DOUBLE AS ord, line FROM ln), n AS (SELECT song_id, min(line_no) - 0.5::DOUBLE AS ord FROM ln WHERE line SIMILAR TO '[:*FRG] .*' GROUP BY song_id) SELECT * FROM x UNION ALL SELECT song_id, ord, '#COMMENT:Score ' || song_id FROM n")
def q_score_inject(spark, d):
    lines = _lines(spark, d)
    return K.with_score(lines, lines.select("song_id").distinct().withColumn("score", F.concat(F.lit("Score "), F.col("song_id").cast("string"))))


@query("WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', ' - ') ELSE p_name END AS stem FROM part) SELECT p_partkey, CASE WHEN contains(stem, ' - ') THEN split_part(stem, ' - ', 1) END AS artist, CASE WHEN contains(stem, ' - ') THEN substr(stem, strpos(stem, ' - ') + 3) ELSE stem END AS title FROM s")
def q_title_split(spark, d):
    stem = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(" - "))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", K.retitled(F.concat(F.lit("/in/"), stem, F.lit(".mp3"))).alias("x")).select("p_partkey", "x.artist", "x.title")


@query(f"""WITH RECURSIVE {NT}, tk AS (SELECT song_id, seq, CASE seq % 3 WHEN 0 THEN '~ ' WHEN 1 THEN 'la' ELSE '~' END AS word, start, stop, seq % 3 = 0 AS we, word AS note, {MIDI.format('freq')} AS midi, 60.0::DOUBLE / 0.005 / 4 AS size FROM nt),
fl AS (SELECT *, lag(note) OVER w AS prev, trim(word) = '~' AS tilde, note = lag(note) OVER w AS same, start - lag(stop) OVER w > size AS breath, NOT lag(we) OVER w AS open, abs(midi - lag(midi) OVER w) AS step FROM tk WINDOW w AS (PARTITION BY song_id ORDER BY seq)),
sd AS (SELECT *, tilde AND stop - start <= 2 * size AND step BETWEEN 1 AND 2 AS slide FROM fl), jn AS (SELECT *, coalesce(NOT breath AND CASE WHEN tilde THEN same OR slide ELSE same AND open END, false) AS j FROM sd),
rc AS (SELECT song_id, seq, seq AS head, word, start, stop, note, we FROM jn WHERE seq = 1
 UNION ALL SELECT n.song_id, n.seq, CASE WHEN j THEN r.head ELSE n.seq END, CASE WHEN NOT j THEN n.word WHEN tilde THEN CASE WHEN n.word LIKE '% ' AND r.word NOT LIKE '% ' THEN r.word || ' ' ELSE r.word END
   ELSE CASE WHEN rtrim(r.word) = '~' THEN '' ELSE rtrim(r.word) END || CASE WHEN rtrim(n.word) LIKE '~%' THEN substr(rtrim(n.word), 2) ELSE rtrim(n.word) END || CASE WHEN n.word LIKE '% ' THEN ' ' ELSE '' END END,
  CASE WHEN j THEN r.start ELSE n.start END, n.stop, CASE WHEN NOT j THEN n.note WHEN slide AND NOT coalesce(same, false) THEN prev ELSE r.note END, CASE WHEN NOT j THEN n.we WHEN tilde THEN r.we OR n.word LIKE '% ' ELSE r.we OR n.we END FROM rc r JOIN jn n ON n.song_id = r.song_id AND n.seq = r.seq + 1)
SELECT song_id, head AS seq, word, start, stop AS "end", note, false AS is_hyphen, we AS is_word_end FROM (SELECT *, row_number() OVER (PARTITION BY song_id, head ORDER BY seq DESC) AS n FROM rc) WHERE n = 1""")
def q_merge_words(spark, d):
    n = notes(spark, d).withColumn("midi", E.hz_to_midi(F.col("freq")))
    word = F.when(F.col("seq") % 3 == 0, "~ ").when(F.col("seq") % 3 == 1, "la").otherwise("~")
    t = n.select("song_id", "seq", word.alias("word"), "start", "end", F.lit(False).alias("is_hyphen"), (F.col("seq") % 3 == 0).alias("is_word_end"), "note", "midi", F.lit(0.005).alias("bpm"))
    return S.merged_syllables(t)


@query("""SELECT o_orderkey, b / 4 AS file_bpm, round(60.0::DOUBLE / b * 0.25, 9) AS sixteenth, trunc(x * 1000)::INT AS gap_ms, greatest(round_even(x * 4, 0) / 4, 0.25) AS quarters, trunc(x * 16000 * 2)::BIGINT AS frame,
 (o_orderkey % 100)::INT - 48 AS pitch, translate(['C♯4','D♭3'][(o_orderkey % 2 + 1)::INT], '♯♭', '#b') AS plain,
 format('{}:{:02d}:{:02d}.{:03d}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS clock FROM (SELECT o_orderkey, (o_orderkey % 200 + 30)::DOUBLE AS b, o_totalprice / 1000 AS x, round_even(o_totalprice, 0)::BIGINT AS m FROM orders)""")
def q_scalars(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 200 + 30).cast("double").alias("b"), (F.col("o_totalprice") / 1000).alias("x"))
    name = F.when(F.col("o_orderkey") % 2 == 0, "C♯4").otherwise("D♭3")
    return o.select(
        "o_orderkey", E.file_bpm(F.col("b")).alias("file_bpm"), F.round(E.note_length(F.col("b"), 0.25), 9).alias("sixteenth"), E.gap_ms(F.col("x")).alias("gap_ms"), E.sheet_quarters(F.col("x")).alias("quarters"),
        E.frame_index(F.col("x"), F.lit(16000), F.lit(2)).alias("frame"), E.midi_to_file_pitch((F.col("o_orderkey") % 100).cast("int")).alias("pitch"), E.plain_accidentals(name).alias("plain"), E.clock(F.rint("o_totalprice") / 1000).alias("clock"),
    )


@query("""SELECT p_partkey, trim(replace(replace(replace(lower(p_name || ' Official Video'), 'official video', ''), 'official music video', ''), 'offizielles musikvideo', '')) AS title, translate(p_name || '.,', '.,', '') AS word,
 ['English','German','French'][(p_partkey % 3 + 1)::INT] AS language, [['C','D','E','F','G','A','B'],['D','E','F#','G','A','B','C#']][(p_partkey % 2 + 1)::INT] AS allowed, (p_size - least(p_size, 20)) // 2 AS crop_left FROM part""")
def q_titles(spark, d):
    code = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", E.plain_title(F.concat("p_name", F.lit(" Official Video"))).alias("title"), E.without_stops(F.concat("p_name", F.lit(".,"))).alias("word"), E.language_name(code).alias("language"),
        E.allowed_notes((F.col("p_partkey") % 2 * 2).cast("int"), "major").alias("allowed"), E.crop(F.col("p_size"), F.lit(20))["left"].cast("int").alias("crop_left"),
    )


@query("SELECT page_id, CASE WHEN p LIKE '%.txt' THEN 'repitch' WHEN p LIKE 'https:%' THEN 'url' ELSE 'media' END AS kind FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'song.txt' ELSE 'song.mp3' END AS p FROM pages)")
def q_route(spark, d):
    k = F.col("page_id") % 3
    return K.routed(table(spark, d, "pages").select("page_id", F.when(k == 0, F.col("url")).when(k == 1, "song.txt").otherwise("song.mp3").alias("path"))).select("page_id", "kind")


@query(f"""WITH {FR}, w AS (SELECT song_id, frame_idx AS seq, CASE WHEN conf >= 0.1 THEN t END AS s, CASE WHEN conf >= 0.1 THEN t + 1 END AS e, word || ' ' AS word, coalesce(CASE WHEN conf >= 0.1 THEN conf END, 0) AS confidence FROM fr),
k AS (SELECT *, count(e) OVER (PARTITION BY song_id ORDER BY seq) AS c, last_value(e IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY song_id, c ORDER BY seq) AS r FROM k)
SELECT song_id, seq - 1 AS seq, word, confidence, round(coalesce(s, CASE WHEN c = 0 THEN 0.2 * (r - 1) ELSE v + 0.2 * (r - 1) - 0.1 END), 3) AS start, round(coalesce(e, CASE WHEN c = 0 THEN 0.2 * (r - 1) + 0.1 ELSE v + 0.2 * (r - 1) END), 3) AS stop FROM n""")
def q_recognised(spark, d):
    have = F.col("conf") >= 0.1
    word = F.struct(F.col("frame_idx"), F.struct("word", F.when(have, F.col("t")).alias("start"), F.when(have, F.col("t") + 1).alias("end"), F.when(have, F.col("conf")).alias("score")).alias("w"))
    songs = frames(spark, d).groupBy("song_id").agg(F.array_sort(F.collect_list(word)).alias("p"))
    results = songs.select("song_id", F.array(F.struct(F.transform("p", lambda x: x["w"]).alias("words"))).alias("segments"))
    out = TB.recognised(results)
    return out.select("song_id", "seq", "word", "confidence", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"))


@query("SELECT o_orderkey AS song_id, o_orderpriority || CASE WHEN n = 1 THEN '' ELSE ' (' || (n - 1) || ')' END AS name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def q_unused_names(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("name"))
    return TB.unused_names(o).select("song_id", F.regexp_replace("name", "^[0-9]+/", "").alias("name"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _groups(least: int) -> str:
    """Places of the groups of three digits from the highest down to `least` that are not 0; a: all groups, the lowest first."""
    return f"list_filter(list_reverse(range({least}, len(a))), lambda k: a[k + 1] > 0)"


_WORD = r"\p{L}\p{N}\p{M}_"
#: Numbers in words: tables of 0 to 999, groups of three digits, each language's way to put them together.
_SPELT = f"""c AS (SELECT {_list(X.EN)} AS en, {_list(X.EN_TENS)} AS en10, {_list(X.DE)} AS de, {_list(X.DE_TENS)} AS de10, {_list(X.ES)} AS es, {_list(X.ES_TENS)} AS es10, {_list(X.ES_HUNDREDS)} AS es100, {_list(X.FR)} AS fr, {_list(X.FR_TENS)} AS fr10),
h AS (SELECT n, CASE WHEN n < 20 THEN en[n + 1] ELSE en10[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || en[n % 10 + 1] ELSE '' END END AS en,
 CASE WHEN n < 20 THEN de[n + 1] ELSE CASE WHEN n % 10 = 0 THEN '' WHEN n % 10 = 1 THEN 'einund' ELSE de[n % 10 + 1] || 'und' END || de10[n // 10 - 1] END AS de,
 CASE WHEN n < 30 THEN es[n + 1] ELSE es10[n // 10 - 2] || CASE WHEN n % 10 > 0 THEN ' y ' || es[n % 10 + 1] ELSE '' END END AS es,
 CASE WHEN n < 20 THEN fr[n + 1] WHEN n = 80 THEN 'quatre-vingts' WHEN x = 0 THEN fr10[n // 10 - 1] WHEN x % 10 = 1 AND n < 80 THEN fr10[n // 10 - 1] || ' et ' || fr[x + 1] ELSE fr10[n // 10 - 1] || '-' || fr[x + 1] END AS fr
 FROM (SELECT n, CASE WHEN n >= 60 THEN n % 20 ELSE n % 10 END AS x FROM range(100) r(n)), c),
th AS (SELECT m.n, CASE WHEN m.n < 100 THEN h.en ELSE c.en[m.n // 100 + 1] || ' hundred' || CASE WHEN h.n > 0 THEN ' and ' || h.en ELSE '' END END AS en,
 CASE WHEN m.n < 100 THEN h.de ELSE CASE WHEN m.n < 200 THEN 'ein' ELSE c.de[m.n // 100 + 1] END || 'hundert' || CASE WHEN h.n > 0 THEN h.de ELSE '' END END AS de,
 CASE WHEN m.n < 100 THEN h.es WHEN m.n = 100 THEN 'cien' ELSE c.es100[m.n // 100] || CASE WHEN h.n > 0 THEN ' ' || h.es ELSE '' END END AS es,
 CASE WHEN m.n < 100 THEN h.fr ELSE CASE WHEN m.n < 200 THEN 'cent' ELSE c.fr[m.n // 100 + 1] || ' cent' END || CASE WHEN h.n > 0 THEN ' ' || h.fr WHEN m.n >= 200 THEN 's' ELSE '' END END AS fr FROM range(1000) m(n) JOIN h ON h.n = m.n % 100, c),
v AS (SELECT list(en ORDER BY n) AS en, list(de ORDER BY n) AS de, list(es ORDER BY n) AS es, list(fr ORDER BY n) AS fr, {_list(["thousand", *X.EN_SCALES])} AS ens, {_list(X.DE_SCALES)} AS des, {_list(X.ES_SCALES)} AS ess, {_list(X.FR_SCALES)} AS frs FROM th),
tk AS (SELECT doc_id, lang, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(text, '[{_WORD}]+|[^{_WORD}]+') AS w FROM documents)),
nu AS (SELECT DISTINCT lang, regexp_extract(tok, '^[0-9]+') AS raw FROM tk WHERE regexp_matches(tok, '^[0-9]')), dg AS (SELECT lang, raw, CASE WHEN ltrim(raw, '0') = '' THEN '0' ELSE ltrim(raw, '0') END AS d FROM nu),
gr AS (SELECT lang, raw, d, CASE WHEN len(d) <= 60 THEN list_transform(range((len(d) + 2) // 3), lambda k: substr(d, greatest(len(d) - 3 * k - 2, 1), least(3, len(d) - 3 * k))::INT) END AS a FROM dg),
lo AS (SELECT gr.*, v.*, coalesce(a[2], 0) AS g, CASE WHEN d = '0' OR a[1] > 0 THEN a[1] END AS u FROM gr, v),
wd AS (SELECT lang, raw, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'es', 'fr') THEN '' WHEN len(d) > CASE lang WHEN 'en' THEN 33 WHEN 'es' THEN 30 ELSE 60 END THEN raw WHEN lang = 'en' THEN
  array_to_string(list_transform({_groups(1)}, lambda k: en[a[k + 1] + 1] || ' ' || ens[k]), ', ') || CASE WHEN u IS NULL THEN '' ELSE CASE WHEN len(a) = 1 THEN '' WHEN u < 100 THEN ' and ' ELSE ', ' END || en[u + 1] END
 WHEN lang = 'de' THEN concat_ws(' ', nullif(array_to_string(list_transform({_groups(2)}, lambda k: CASE WHEN a[k + 1] = 1 THEN 'eine ' || des[k - 1] ELSE de[a[k + 1] + 1] || ' ' || regexp_replace(des[k - 1], 'e$', '') || 'en' END), ' '), ''),
  nullif(CASE WHEN g = 0 THEN '' WHEN g = 1 THEN 'eintausend' ELSE de[g + 1] || 'tausend' END || CASE WHEN u IS NULL THEN '' ELSE de[u + 1] END, ''))
 WHEN lang = 'fr' THEN concat_ws(' ', nullif(array_to_string(list_transform({_groups(2)}, lambda k: fr[a[k + 1] + 1] || ' ' || frs[k - 1] || CASE WHEN a[k + 1] > 1 THEN 's' ELSE '' END), ' '), ''),
  CASE WHEN g = 1 THEN 'mille' WHEN g > 1 THEN regexp_replace(fr[g + 1], '(cent|vingt)s$', '\\1') || ' mille' END, CASE WHEN u IS NOT NULL THEN fr[u + 1] END)
 ELSE concat_ws(' ', nullif(array_to_string(list_transform(list_filter(list_reverse(range(1, (len(a) + 1) // 2)), lambda j: a[2 * j + 1] + 1000 * coalesce(a[2 * j + 2], 0) > 0), lambda j: CASE WHEN a[2 * j + 1] = 1 AND coalesce(a[2 * j + 2], 0) = 0 THEN 'un ' || ess[j] || 'ón'
   ELSE concat_ws(' ', CASE WHEN a[2 * j + 2] = 1 THEN 'mil' WHEN a[2 * j + 2] > 1 THEN es[a[2 * j + 2] + 1] || ' mil' END, CASE WHEN a[2 * j + 1] > 0 THEN es[a[2 * j + 1] + 1] END) || ' ' || ess[j] || 'ones' END), ' '), ''),
  CASE WHEN g = 1 THEN 'mil' WHEN g > 1 THEN es[g + 1] || ' mil' END, CASE WHEN u IS NOT NULL THEN es[u + 1] END) END AS words FROM lo),
pt AS (SELECT doc_id, string_agg(CASE WHEN raw IS NULL THEN tok ELSE words || substr(tok, len(raw) + 1) END, '' ORDER BY pos) AS line FROM tk LEFT JOIN wd ON regexp_matches(tok, '^[0-9]') AND raw = regexp_extract(tok, '^[0-9]+') AND wd.lang IS NOT DISTINCT FROM tk.lang GROUP BY doc_id)"""


@query(f"WITH {_SPELT} SELECT doc_id, md5(CASE WHEN text IS NOT NULL THEN coalesce(line, '') END) AS words FROM documents LEFT JOIN pt USING (doc_id)")
def q_number_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.number_words("text", "lang")).alias("words"))


_FOLDED = "text"
for _letter, _plain in X.FOLDED.items():
    _FOLDED = f"""replace({_FOLDED}, '{_letter}', '{_plain.replace("'", "''")}')"""


@query(f"SELECT doc_id, md5(regexp_replace(strip_accents({_FOLDED}), '[^\\x00-\\x7F]+', '', 'g')) AS folded FROM documents")
def q_ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.ascii_folded("text")).alias("folded"))


@query(f"WITH {FR}, l AS (SELECT song_id, string_agg(b, chr(10) ORDER BY o) AS t FROM (SELECT DISTINCT song_id, 0 AS o, '#VERSION:1.1.0' AS b FROM fr UNION ALL SELECT DISTINCT song_id, 1, '#ARTIST:' || song_id FROM fr UNION ALL SELECT DISTINCT song_id, 2, '#BPM:390.0' FROM fr UNION ALL SELECT song_id, frame_idx + 10, concat_ws(' ', ':', frame_idx * 4, 2, {MIDI.format('freq')} - 48, word) FROM fr) GROUP BY song_id) SELECT song_id, md5(t || chr(10) || 'E') AS content_md5 FROM l")
def q_song_files(spark, d):
    f = frames(spark, d)
    songs = f.select("song_id").distinct().select("song_id", F.lit("1.1.0").alias("version"), F.col("song_id").cast("string").alias("artist"), F.lit("390.0").alias("bpm"), F.lit("https://x").alias("video_url"))
    n = f.select("song_id", F.col("frame_idx").alias("seq"), (F.col("frame_idx") * 4).alias("start_beat"), F.lit(2).alias("length"), (E.hz_to_midi(F.col("freq")) - 48).alias("pitch"), "word", F.lit(False).alias("line_break"), F.lit(0).alias("break_beat"))
    return K.files(K.header_lines(songs).unionByName(K.note_text(n))).select("song_id", F.md5("content").alias("content_md5"))


@query(f"WITH {FR} SELECT song_id, frame_idx AS seq, 'chunk_' || frame_idx || '_' || regexp_replace(word, '[^A-Za-z0-9]+', '', 'g') || '.wav' AS file, trunc(conf * 16000 * 2)::BIGINT AS first_frame, trunc((conf + 1) * 16000 * 2)::BIGINT AS last_frame FROM fr")
def q_chunk_manifest(spark, d):
    t = frames(spark, d).select("song_id", F.col("frame_idx").alias("seq"), "word", F.col("conf").alias("start"), (F.col("conf") + 1).alias("end"))
    return EX.chunk_manifest(t, 16000, 2)


@query(f"WITH {FR}, e AS (SELECT song_id, min(t) AS low, max(t) AS high FROM fr GROUP BY song_id), k AS (SELECT song_id, unnest(generate_series((ceil(low / 604800) * 604800)::BIGINT, (floor(high / 604800) * 604800)::BIGINT, 604800))::DOUBLE AS tick FROM e UNION SELECT song_id, low FROM e UNION SELECT song_id, high FROM e) SELECT song_id, tick, (row_number() OVER (PARTITION BY song_id ORDER BY tick) - 1)::INT AS tick_no FROM k")
def q_time_ticks(spark, d):
    return EX.time_ticks(frames(spark, d), 604800)


@query(f"WITH {FR}, m AS (SELECT *, {MIDI.format('freq')} AS midi, {NAMES}[({MIDI.format('freq')} % 12 + 12) % 12 + 1] AS nm FROM fr) SELECT song_id, md5('<score-partwise version=\"4.0\"><part-list><score-part id=\"P1\"><part-name>Vocals</part-name></score-part></part-list><part id=\"P1\"><measure number=\"1\"><attributes><divisions>4</divisions></attributes>' || string_agg('<note><pitch><step>' || nm[1:1] || '</step>' || CASE WHEN contains(nm, '#') THEN '<alter>1</alter>' ELSE '' END || '<octave>' || (floor(midi / 12.0) - 1)::INT || '</octave></pitch><duration>' || (greatest(round_even(conf * 4, 0) / 4, 0.25) * 4)::BIGINT || '</duration><lyric><text>' || word || '</text></lyric></note>', '' ORDER BY frame_idx) || '</measure></part></score-partwise>') AS xml_md5 FROM m GROUP BY song_id")
def q_music_xml(spark, d):
    n = frames(spark, d).select("song_id", F.col("frame_idx").alias("seq"), E.hz_to_midi(F.col("freq")).alias("midi"), F.lit(0.0).alias("start"), F.col("conf").alias("end"), "word")
    return EX.music_xml(n).select("song_id", F.md5("xml").alias("xml_md5"))
