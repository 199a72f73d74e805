"""Intervals, timelines and sessions: conversations as transcripts, lineitems as ranges, events as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.operators import intervals as iv
from lattice.plans.registry import query

#: A turn starts 20 seconds after the one before it and lasts a tenth of a second a character, 60 at most.
_TURNS = "SELECT conv_id, turn, role, text, turn * 20::DOUBLE AS start, turn * 20::DOUBLE + least(60, length(text) / 10) AS \"end\" FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 20.0
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", start.alias("start"), (start + F.least(F.lit(60.0), F.length("text") / 10)).alias("end"))


@query("interval_union", f"""
WITH t AS ({_TURNS}), m AS (SELECT *, coalesce("start" > max("end") OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS n FROM t),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT conv_id, min("start") AS "start", round(max("end"), 6) AS "end", count(*) AS members FROM g GROUP BY conv_id, g""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_touching(_turns(spark, sf_dir), ["conv_id"]).withColumn("end", F.round("end", 6))


@query("interval_coalesce_gap1", f"""
WITH t AS ({_TURNS}), m AS (SELECT *, coalesce("start" > max("end") OVER (PARTITION BY conv_id, role ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30, true) AS n FROM t),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY conv_id, role ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT conv_id, role, min("start") AS "start", round(max("end"), 6) AS "end", count(*) AS members FROM g GROUP BY conv_id, role, g""")
def interval_coalesce_gap1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_touching(_turns(spark, sf_dir), ["conv_id", "role"], gap=30).withColumn("end", F.round("end", 6))


@query("interval_subtract", """
WITH r AS (SELECT o_orderkey AS k, 1 AS s, 30 AS e FROM orders), x AS (SELECT k, unnest(generate_series(s, e)) AS p FROM r),
m AS (SELECT l_orderkey AS k, unnest(generate_series(l_quantity::BIGINT, l_quantity::BIGINT + 4)) AS p FROM lineitem),
y AS (SELECT k, p FROM x EXCEPT SELECT k, p FROM m), g AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM y)
SELECT k, min(p) AS "start", max(p) AS "end" FROM g GROUP BY k, g""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).cast("long").alias("start"), F.lit(30).cast("long").alias("end"))
    q = F.col("l_quantity").cast("long")
    masks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("start"), (q + 4).alias("end"))
    return iv.subtract_inclusive(ranges, masks, ["k"])


@query("scope_overlap_filter", f"""
WITH t AS ({_TURNS}), d AS (SELECT conv_id, max("end") AS dur FROM t GROUP BY 1)
SELECT t.conv_id, t.turn FROM t JOIN d ON t.conv_id = d.conv_id WHERE "end" > dur * 0.25 AND "start" < dur * 0.75""")
def scope_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    d = t.groupBy("conv_id").agg(F.max("end").alias("dur"))
    return t.join(d, "conv_id").where(iv.overlaps_half_open(F.col("start"), F.col("end"), F.col("dur") * 0.25, F.col("dur") * 0.75)).select("conv_id", "turn")


@query("gap_islands", """
WITH d AS (SELECT DISTINCT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS size FROM g GROUP BY user_id, g""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return iv.bands(table(spark, sf_dir, "events").select("user_id", day.alias("day")), ["user_id"], "day")


@query("n_largest_gaps", f"""
WITH t AS ({_TURNS}), g AS (SELECT *, round("start" - lag("end") OVER w, 9) AS gap, row_number() OVER w AS pos FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY "start", turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY gap DESC NULLS LAST, pos) AS rk FROM g)
SELECT conv_id, turn, (1 + sum((gap IS NOT NULL AND rk < 3)::INT) OVER (PARTITION BY conv_id ORDER BY "start", turn ROWS UNBOUNDED PRECEDING))::BIGINT AS part FROM r""")
def n_largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("start", "turn")
    gaps = t.withColumn("_gap", F.round(F.col("start") - F.lag("end").over(w), 9)).withColumn("_pos", F.row_number().over(w))
    ranked = gaps.withColumn("_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("_gap"), "_pos")))
    cut = (F.col("_gap").isNotNull() & (F.col("_rank") < 3)).cast("int")
    return ranked.select("conv_id", "turn", (F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).alias("part"))


@query("running_timeline", f"""
WITH t AS ({_TURNS}), g AS (SELECT *, CASE WHEN text = '' OR lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 0 ELSE 0.5 END AS gap FROM t)
SELECT conv_id, turn, round(coalesce(sum("end" - "start" + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS speech_start, gap::DOUBLE AS gap FROM g""")
def running_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("gap", F.when((F.col("text") == "") | F.lead("turn").over(w).isNull(), 0.0).otherwise(0.5))
    before = F.sum(F.col("end") - F.col("start") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.select("conv_id", "turn", F.round(F.coalesce(before, F.lit(0.0)), 6).alias("speech_start"), "gap")


@query("lead_durations", f"""
WITH t AS ({_TURNS}) SELECT conv_id, turn, round(coalesce(lead("start") OVER (PARTITION BY conv_id ORDER BY turn), "end") - "start", 6) AS duration FROM t""")
def lead_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(F.coalesce(F.lead("start").over(w), F.col("end")) - F.col("start"), 6).alias("duration"))


@query("shot_grouping", """
WITH f AS (SELECT user_id, event_id, ts, event_type, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS n FROM events),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shot FROM f)
SELECT user_id, shot::BIGINT AS shot, any_value(event_type) AS media, count(*) AS segments, min(event_id) AS first_event FROM g GROUP BY user_id, shot""")
def shot_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    flagged = e.withColumn("_new", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    shots = flagged.withColumn("shot", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return shots.groupBy("user_id", "shot").agg(F.first("event_type").alias("media"), F.count(F.lit(1)).alias("segments"), F.min("event_id").alias("first_event"))


@query("range_join_units_chapters", f"""
WITH t AS ({_TURNS}), c AS (SELECT DISTINCT conv_id, turn // 2 AS chapter, (turn // 2) * 37.0 AS cs, (turn // 2) * 37.0 + 45.0 AS ce FROM conversations)
SELECT t.conv_id, chapter, turn FROM t JOIN c ON t.conv_id = c.conv_id AND t."end" > cs AND t."start" < ce WHERE t."end" > t."start" """)
def range_join_units_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("conv_id", "turn", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    chapter = F.floor(F.col("turn") / 2)
    c = table(spark, sf_dir, "conversations").select("conv_id", chapter.alias("chapter")).distinct().select("conv_id", "chapter", (F.col("chapter") * 37.0).alias("r_start"), (F.col("chapter") * 37.0 + 45.0).alias("r_end"))
    return iv.range_join(t, c, ["conv_id"], 40.0).select("conv_id", "chapter", "turn")


@query("best_overlap_segment", f"""
WITH t AS ({_TURNS}), s AS (SELECT DISTINCT conv_id, turn AS segment, turn * 27.0 AS ss, turn * 27.0 + 27.0 AS se FROM conversations),
p AS (SELECT t.conv_id, turn, segment, round(least("end", se) - greatest("start", ss), 9) AS o FROM t JOIN s ON t.conv_id = s.conv_id AND "end" > ss AND "start" < se WHERE "end" > "start"),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY o DESC, segment) = 1)
SELECT t.conv_id, t.turn, coalesce(b.segment, 0) AS segment FROM t LEFT JOIN b ON t.conv_id = b.conv_id AND t.turn = b.turn""")
def best_overlap_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment")).distinct().select("conv_id", "segment", (F.col("segment") * 27.0).alias("start"), (F.col("segment") * 27.0 + 27.0).alias("end"))
    return iv.best_overlap(_turns(spark, sf_dir), s, ["conv_id"], "turn", 30.0).select("conv_id", "turn", "segment")


@query("containment_collapse", f"""
WITH t AS ({_TURNS}) SELECT a.conv_id, a.turn AS child, b.turn AS "outer" FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a."end" > b."start" AND a."start" < b."end"
WHERE a."end" > a."start" AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.5 * (a."end" - a."start") AND b."end" - b."start" > a."end" - a."start" + 0.2""")
def containment_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.contained(_turns(spark, sf_dir), ["conv_id"], "turn", 40.0, share=0.5)


@query("scene_cuts_last_kept", """
WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS s FROM events), o AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM e),
r AS (SELECT user_id, n, s, s AS kept, true AS keep FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.n, o.s, CASE WHEN o.s - r.kept >= 50000 THEN o.s ELSE r.kept END, o.s - r.kept >= 50000 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, s AS cut FROM r WHERE keep""")
def scene_cuts_last_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - 1704067200
    cuts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(s).alias("cuts"))
    return cuts.select("user_id", F.explode(iv.kept_cuts(F.col("cuts"), 50000)).alias("cut"))


@query("waveform_peaks", """
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT user_id, (i * 16) // n AS bin, max(abs(value)) AS peak FROM s GROUP BY 1, 2)
SELECT user_id, bin, round(sqrt(peak / max(peak) OVER (PARTITION BY user_id)), 6) AS level FROM b""")
def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    s = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    b = s.groupBy("user_id", F.floor(F.col("i") * 16 / F.col("n")).alias("bin")).agg(F.max(F.abs("value")).alias("peak"))
    return b.select("user_id", "bin", F.round(F.sqrt(F.col("peak") / F.max("peak").over(w)), 6).alias("level"))


@query("crossfade_chain", f"""
WITH t AS ({_TURNS}), f AS (SELECT *, CASE WHEN lead(turn) OVER w IS NULL OR lead(role) OVER w = role THEN 0 ELSE least(0.4, ("end" - "start") * 0.25) END AS fade FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, round(sum("end" - "start") - sum(fade), 6) AS total, round(sum(fade), 6) AS fades FROM f GROUP BY 1""")
def crossfade_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.col("end") - F.col("start")
    f = _turns(spark, sf_dir).withColumn("fade", F.when(F.lead("turn").over(w).isNull() | (F.lead("role").over(w) == F.col("role")), 0.0).otherwise(F.least(F.lit(0.4), size * 0.25)))
    return f.groupBy("conv_id").agg(F.round(F.sum(size) - F.sum("fade"), 6).alias("total"), F.round(F.sum("fade"), 6).alias("fades"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("at", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("sliding_avg", """
WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - (INTERVAL '6 hours') * k AS window_start, value FROM events, (SELECT unnest([0, 1]) AS k))
SELECT window_start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1""")
def sliding_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "value")
    g = e.groupBy(F.window("at", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "mean")


@query("session_windows", """
WITH f AS (SELECT user_id, ts, event_id, value, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '4 hours', true) AS n FROM events),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "value")
    g = e.groupBy("user_id", F.session_window("at", "4 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n", "total")


@query("dedup_events", "SELECT min(event_id) AS event_id, user_id, event_type, date_trunc('day', ts)::DATE AS day FROM events GROUP BY user_id, event_type, day")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.min("event_id").alias("event_id"))
