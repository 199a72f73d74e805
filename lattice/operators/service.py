"""What a retrieval service decides about requests and cached answers, as queries over logs of them."""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_error(mode: Column, top_k: Column, n_ids: Column, tokens: Column, max_top_k: int = 50, max_ids: int = 500, token_range: tuple[int, int, int] = (500, 8000, 32000)) -> Column:
    """Struct of status and code of the first rule that a request breaks, else null. ``token_range``: least, default and most tokens to return."""
    least, default, most = token_range
    wanted = F.coalesce(F.nullif(tokens, F.lit(0)), F.lit(default))
    error = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    return (
        F.when(mode == "keyword", error(501, "MODE_NOT_IMPLEMENTED"))
        .when(top_k > max_top_k, error(422, "INVALID_TOP_K"))
        .when(n_ids > max_ids, error(422, "TOO_MANY_DOCUMENT_IDS"))
        .when(~wanted.between(least, most), error(422, "INVALID_RETURN_TOKEN_BUDGET"))
    )


def admissions(times: Sequence[float], users: Sequence[str], durations: Sequence[float], active: int, queued: int, patience: float) -> list[tuple[str, float | None]]:
    """(outcome, start) of each request of one service, by arrival: ``active`` run at once, ``queued`` wait; users take turns at free slots.

    A request finds the queue full: overloaded. It waits longer than ``patience``: timeout. A slot that frees at the moment of an
    arrival is free for it.
    """
    out: list[tuple[str, float | None]] = [("", None)] * len(times)
    running: list[tuple[float, int]] = []
    queues: OrderedDict[str, deque[int]] = OrderedDict()
    waiting = 0

    def start(i: int, at: float) -> None:
        out[i] = ("granted", at)
        heapq.heappush(running, (at + durations[i], i))

    def until(now: float) -> None:
        nonlocal waiting
        while running and running[0][0] <= now:
            at, _ = heapq.heappop(running)
            while queues:
                user, own = queues.popitem(last=False)
                i = own.popleft()
                waiting -= 1
                if own:
                    queues[user] = own
                if at - times[i] <= patience:
                    start(i, at)
                    break
                out[i] = ("timeout", None)
        for user in list(queues):  # those whose patience has ended leave their place
            own = queues[user]
            while own and now - times[own[0]] > patience:
                out[own.popleft()] = ("timeout", None)
                waiting -= 1
            if not own:
                del queues[user]

    for i, (now, user) in enumerate(zip(times, users, strict=True)):
        until(now)
        if len(running) < active and not waiting:
            start(i, now)
        elif waiting >= queued:
            out[i] = ("overloaded", None)
        else:
            queues.setdefault(user, deque()).append(i)
            waiting += 1
    until(float("inf")) if running else None
    return out


def cache_hits(times: Sequence[float], keys: Sequence[str], size: int, ttl: float | None = None) -> list[bool]:
    """Which lookups of one cache hit; a miss stores the key. Least recently used keys go beyond ``size``; with ``ttl`` an entry ends that long after it was stored."""
    store: OrderedDict[str, float] = OrderedDict()
    out = []
    for t, key in zip(times, keys, strict=True):
        hit = key in store and (ttl is None or t <= store[key] + ttl)
        out.append(hit)
        if not hit:
            store[key] = t
        store.move_to_end(key)
        if len(store) > size:
            store.popitem(last=False)
    return out


def page_plan(pages: DataFrame, sections: DataFrame, scores: Column, cost: Column, budget: int, boilerplate: Sequence[str], wanted: int = 4) -> DataFrame:
    """(doc_id, page, rank): the order in which the pages of each document are read under a budget.

    ``pages``: doc_id, page and what ``scores`` and ``cost`` need; ``sections``: doc_id, title, first_page, last_page of the primary
    sections. Pages of boilerplate sections go (unless no page would stay). Where all that is left fits the budget, pages stand in
    order; else the first page of each section comes first (``wanted`` evenly spaced pages where no section has any), then the others by score.
    """
    from pyspark.sql import Window

    doc = Window.partitionBy("doc_id")
    spans = sections.select("doc_id", F.lower(F.trim("title")).isin([b.lower() for b in boilerplate]).alias("_bad"), "first_page", "last_page")
    scored = pages.select("doc_id", "page", scores.alias("_score"), cost.alias("_cost"))
    marks = F.coalesce(F.max(F.col("_bad") & F.col("page").between(F.col("first_page"), F.col("last_page"))), F.lit(False)).alias("_out")
    # sections of a document are few: the join is by document, each page meets its own outline only
    left = scored.join(spans, "doc_id", "left").groupBy("doc_id", "page").agg(F.first("_score").alias("_score"), F.first("_cost").alias("_cost"), marks)
    left = left.withColumn("_all", F.min("_out").over(doc)).where(~F.col("_out") | F.col("_all"))
    first = left.select("doc_id", "page").join(spans, "doc_id").where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    first = first.groupBy("doc_id", "first_page", "last_page").agg(F.min("page").alias("page")).groupBy("doc_id", "page").agg(F.min("first_page").alias("_section"))
    numbered = left.join(first, ["doc_id", "page"], "left").withColumns({
        "_n": F.count(F.lit(1)).over(doc), "_at": F.row_number().over(doc.orderBy("page")) - 1, "_fits": F.sum("_cost").over(doc) <= budget, "_any": F.max("_section").over(doc).isNotNull()})
    even = F.array(*(F.bround(F.lit(float(i)) * (F.col("_n") - 1) / (wanted - 1)).cast("int") for i in range(wanted)))
    lead = F.when(F.col("_any"), F.col("_section").isNotNull()).otherwise((F.col("_n") <= wanted) | F.array_contains(even, F.col("_at")))
    order = [F.when(F.col("_fits"), 0).when(lead, 0).otherwise(1), F.when(F.col("_fits"), F.lit(0.0)).when(lead, F.coalesce(F.col("_section"), F.lit(0)).cast("double")).otherwise(-F.col("_score").cast("double")), F.col("page")]
    return numbered.select("doc_id", "page", F.row_number().over(doc.orderBy(*order)).cast("long").alias("rank"))


def fits_before() -> Column:
    """If a table may go on from the one before of its document, by page, caption, footnotes and width."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("position")
    before = lambda c: F.lag(c).over(w)
    width, wide = F.col("x1") - F.col("x0"), F.lag(F.col("x1") - F.col("x0")).over(w)
    caption = F.coalesce(F.trim("caption"), F.lit(""))
    says = caption.rlike("(?i)(续表|续上表|\\(续\\)|（续）|continued|cont\\.)")
    allowed = F.when(caption != "", says & (before("footnotes") <= 1)).otherwise(before("footnotes") == 0)
    return F.coalesce((before("page") == F.col("page") - 1) & allowed & (F.abs(width - wide) < 0.1 * F.least(width, wide)), F.lit(False))


def continued_tables(tables: DataFrame, headers: int = 5) -> DataFrame:
    """(doc_id, position, chain, skip): tables that go on from the page before share a chain; ``skip`` header rows repeat.

    ``tables``: doc_id, position (reading order), page, x0, x1, columns, rows (array of arrays of cell texts), caption and
    footnotes (a number). A table goes on if it stands on the next page, has no caption or one that says so (and the table before no
    footnote, one at most with such a caption), its width differs by less than a tenth, and the number of columns, or
    that of the last row before and its first row, is the same.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("position")
    before = lambda c: F.lag(c).over(w)
    same = (before("columns") == F.col("columns")) | (F.size(F.element_at(before("rows"), -1)) == F.size(F.element_at("rows", 1)))
    goes_on = fits_before() & F.coalesce(same, F.lit(False))
    clean = lambda row: F.transform(row, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", ""))
    pairs = F.arrays_zip(F.slice("rows", 1, headers).alias("a"), F.slice(before("rows"), 1, headers).alias("b"))
    alike = F.transform(pairs, lambda p: F.coalesce(clean(p["a"]) == clean(p["b"]), F.lit(False)))
    run = F.array_position(alike, False)
    repeated = F.when(run == 0, F.size(alike)).otherwise(run - 1)
    marked = tables.select("doc_id", "position", goes_on.alias("_on"), F.when(goes_on, repeated).otherwise(0).cast("long").alias("skip"))
    chain = F.sum((~F.col("_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("doc_id", "position", chain.alias("chain"), "skip")
