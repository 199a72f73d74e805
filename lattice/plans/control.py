"""Folds over events, documents and embeddings: limits, packing, greedy choices, state checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.catalog import table
from lattice.operators import folds, vectors
from lattice.plans.registry import query


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", t.alias("t"))


@query("token_bucket_decisions")
def token_bucket_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request in two hours with bursts of two, per user."""
    decide = lambda t: folds.token_bucket(t, 1 / 120, 2)
    return folds.fold_column(_log(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t"], decide, "allowed", T.BooleanType()).select("user_id", "event_id", "allowed")


@query("throttled_events")
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decide = lambda t, status, progress: folds.throttle(t, status, progress, ["error"], 20, 7200)
    return folds.fold_column(_log(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t", "event_type", "value"], decide, "written", T.BooleanType()).select("user_id", "event_id", "written")


@query("circuit_breaker_states")
def circuit_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    decide = lambda t, kind: folds.circuit(t, [k != "error" for k in kind], 2, 86400)
    return folds.fold_column(_log(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t", "event_type"], decide, "state", T.StringType()).select("user_id", "event_id", "state")


@query("circuit_breaker_cooldown")
def circuit_breaker_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    decide = lambda t, kind: folds.cooldown_circuit(t, [k != "error" for k in kind], 2, 86400)
    return folds.fold_column(_log(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t", "event_type"], decide, "state", T.StringType()).select("user_id", "event_id", "state")


@query("state_machine_violations", """
WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'structuring' ELSE 'failed' END AS status, ts FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s)
SELECT user_id, event_id, prev, status FROM l WHERE NOT CASE WHEN prev IS NULL THEN status = 'queued' WHEN status = 'failed' THEN prev NOT IN ('completed', 'failed')
  ELSE (prev, status) IN (('queued', 'parsing'), ('parsing', 'extracting'), ('extracting', 'structuring'), ('structuring', 'storing'), ('storing', 'completed')) END""")
def state_machine_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = {"signup": "queued", "view": "parsing", "click": "extracting", "purchase": "structuring"}
    status = F.lit("failed")
    for event, name in names.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("user_id", "event_id", status.alias("status"), "ts").withColumn("prev", F.lag("status").over(w))
    step = F.lit(False)
    for before, after in folds.TRANSITIONS.items():
        for to in after:
            step = step | ((F.col("prev") == before) & (F.col("status") == to))
    fine = F.when(F.col("prev").isNull(), F.col("status") == "queued").when(F.col("status") == "failed", ~F.col("prev").isin(*folds.FINAL)).otherwise(step)
    return rows.where(~fine).select("user_id", "event_id", "prev", "status")


@query("stale_reclaim", """
SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-31' AND arg_max(event_type, (ts, event_id)) NOT IN ('purchase', 'error') THEN 'failed' ELSE arg_max(event_type, (ts, event_id)) END AS status FROM events GROUP BY user_id""")
def stale_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    stale = (F.col("last") < F.lit("2024-01-31").cast("timestamp_ntz")) & ~F.col("status").isin("purchase", "error")
    return g.select("user_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"))


@query("lpt_bins")
def lpt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer into batches of bounded load."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil(F.col("o_totalprice") / 1000).alias("cost"))
    return folds.fold_column(orders, ["o_custkey"], ["o_orderkey"], ["cost"], lambda c: folds.lpt(c, 1000), "bin", T.LongType())


@query("budget_merge")
def budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order under a token budget, every supplier first."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("grp"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_extendedprice").alias("gain"))
    decide = lambda grp, tokens, gain: folds.budget_merge(grp, tokens, gain, 80, 4)
    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "grp", "tokens", "gain"], ["grp", "tokens", "gain"], decide, "kept", T.BooleanType()).select("l_orderkey", "l_linenumber", "tokens", "kept")


@query("mmr_representatives")
def mmr_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.representatives(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5)


@query("utterance_units")
def utterance_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 20.0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", start.alias("s"), (start + F.least(F.lit(60.0), F.length("text") / 50)).alias("e"))
    return folds.fold_column(rows, ["conv_id"], ["turn"], ["s", "e", "role", "text"], folds.utterances, "unit", T.LongType()).select("conv_id", "turn", "unit")


@query("short_segment_merge")
def short_segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return folds.fold_column(rows, ["conv_id"], ["turn"], ["n"], lambda n: folds.merge_short(n, 400), "segment", T.LongType()).select("conv_id", "turn", "segment")


@query("sentence_merge")
def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences read at 15 characters a second: groups of 20 to 40 seconds and fewer than 500 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("c"), (F.length("text") / 15).alias("d"))
    decide = lambda d, c: folds.sentence_groups(d, c, 20, 40, 500)
    return folds.fold_column(rows, ["conv_id"], ["turn"], ["d", "c"], decide, "grp", T.LongType()).select("conv_id", "turn", "grp")


@query("scene_merge")
def scene_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scenes of as many frames as characters, until each has 400: start, end, least confidence, joined summaries."""
    after = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (after - F.length("text")).alias("s"), after.alias("e"), (1 / (1 + F.col("turn"))).alias("c"), "role")

    def step(p: pd.DataFrame) -> pd.DataFrame:
        scenes = folds.merge_scenes(p.s.tolist(), p.e.tolist(), p.c.tolist(), p.role.tolist(), 400)
        return pd.DataFrame([(p.conv_id.iloc[0], *scene) for scene in scenes], columns=["conv_id", "first_frame", "end_frame", "confidence", "summary"])

    return folds.fold(rows, ["conv_id"], ["turn"], step, "conv_id long, first_frame long, end_frame long, confidence double, summary string")


@query("plan_consumption")
def plan_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as one plan for each return flag; heads of plans in turn while the quantities stay within 90."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("plan"), F.col("l_quantity").cast("long").alias("cost"))
    decide = lambda plan, cost: folds.consume_plans(plan, cost, 90)
    return folds.fold_column(li, ["l_orderkey"], ["l_linenumber", "plan", "cost"], ["plan", "cost"], decide, "place", T.LongType()).select("l_orderkey", "l_linenumber", "place")


@query("page_groups")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pages = lines.groupBy("doc_id", F.floor(F.col("pos") / 10).alias("page")).agg(F.ceil(F.sum(F.length("line")) / 4).alias("tokens"))

    def step(p: pd.DataFrame) -> pd.DataFrame:
        runs = folds.page_groups([int(n) for n in p.tokens], 500)
        return pd.DataFrame({"doc_id": p.doc_id.iloc[0], "first_page": [a for a, _ in runs], "last_page": [b for _, b in runs]})

    return folds.fold(pages, ["doc_id"], ["page"], step, "doc_id long, first_page long, last_page long")


@query("edit_log_states")
def edit_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an edit log: clicks undo, purchases redo, others apply their type."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        kinds = p.event_type.map({"click": "undo", "purchase": "redo"}).fillna("apply").tolist()
        states = folds.edit_log(kinds, p.event_type.tolist(), [None] * len(kinds))
        return p[["user_id", "event_id"]].assign(revision=[s[0] for s in states], value=[s[1] for s in states])

    return folds.fold(_log(spark, sf_dir), ["user_id"], ["t", "event_id"], step, "user_id long, event_id long, revision long, value string")


@query("adaptive_top_k", """
SELECT doc_id, CASE WHEN length(text) > 4000 THEN 20 WHEN length(text) > 1000 THEN 12 ELSE 8 END + CASE WHEN regexp_matches(text, 'all|every|overview') THEN 4 ELSE 0 END AS top_k FROM documents""")
def adaptive_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    base = F.when(n > 4000, 20).when(n > 1000, 12).otherwise(8)
    return table(spark, sf_dir, "documents").select("doc_id", (base + F.when(F.col("text").rlike("all|every|overview"), 4).otherwise(0)).alias("top_k"))


@query("box_overlap", """
WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10 AS x1, l_discount * 100 + 5 AS y1 FROM lineitem),
p AS (SELECT a.page, a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(inter / (100 - inter), 6) AS iou FROM p WHERE inter > 0""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of boxes on one page (an order has at most seven lines, so pairs are few)."""
    box = lambda n: table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_discount") * 100 + 5).alias("y1")).alias(n))
    j = box("p").join(box("q"), "page").where("p.id < q.id")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"p.{hi}"), F.col(f"q.{hi}")) - F.greatest(F.col(f"p.{lo}"), F.col(f"q.{lo}")))
    inter = side("x0", "x1") * side("y0", "y1")
    return j.where(inter > 0).select("page", F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.round(inter / (100 - inter), 6).alias("iou"))
