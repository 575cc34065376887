"""Corporate-action inventories and qualification gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import shared_series
from .reconcile import scale_equal
from .validate import reasons


def fitting(events: DataFrame, candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates of the kind and value of an event, on its application session or the next: the columns that name a series on both sides, then ``event_id,
    effective_date, application_date, reach`` (the later of the two sessions), ``candidate_id, candidate_date``."""
    by, own = shared_series(events, bars), shared_series(events, candidates)
    w = Window.partitionBy(*by).orderBy("trading_date")
    nxt = bars.select(*by, "trading_date").distinct().select(*by, F.col("trading_date").alias("application_date"), F.lead("trading_date").over(w).alias("next_date"))
    e = events.where("application_date is not null").join(nxt, [*by, "application_date"], "left").withColumn("reach", F.coalesce("next_date", "application_date"))
    e = e.select(*own, "event_id", "effective_date", "application_date", "reach", "kind", "official_value", F.explode(F.array_distinct(F.array("application_date", "reach"))).alias("candidate_date"))
    fits = e.join(candidates.select(*own, "kind", "candidate_date", "candidate_id", "value"), [*own, "kind", "candidate_date"]).where(scale_equal(F.col("value"), F.col("official_value")))
    return fits.select(*own, "event_id", "effective_date", "application_date", "reach", "candidate_id", "candidate_date").distinct()


def consumed(fits: DataFrame, *own: str) -> DataFrame:
    """``own, event_id, candidate_id, candidate_date``: the events of each series are visited in the order of their dates (then ids); one that exactly one
    unused candidate fits takes it, and the candidate is used from then on.

    Events that could want the same candidate stand on sessions that touch, so the ledger falls into islands between which nothing is shared; each
    is folded by itself, in order. An event that more candidates fit than its island has events can never be left with one, as each event before it takes one
    at most: it takes none, and its fits are not gathered."""
    events = fits.groupBy(*own, "event_id", "effective_date", "application_date", "reach").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*own).orderBy("effective_date", "event_id")
    fresh = F.coalesce(F.col("application_date") > F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    events = events.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    events = events.withColumn("m", F.count("*").over(Window.partitionBy(*own, "island"))).where("n <= m").select(*own, "event_id", "island")
    fit = F.struct("candidate_id", "candidate_date")
    rows = fits.join(events, [*own, "event_id"]).groupBy(*own, "island", "event_id", "effective_date", "application_date").agg(F.collect_list(fit).alias("fits"))
    islands = rows.groupBy(*own, "island").agg(F.array_sort(F.collect_list(F.struct("effective_date", "event_id", "application_date", "fits"))).alias("events"))
    kind = {c: t for c, t in fits.dtypes}
    used = f"array<struct<candidate_id:{kind['candidate_id']},candidate_date:date>>"
    taken = f"array<struct<event_id:{kind['event_id']},candidate_id:{kind['candidate_id']},candidate_date:date>>"

    def visit(state, e):
        open_ = F.filter(e["fits"], lambda c: ~F.exists(state["used"], lambda u: u["candidate_id"] == c["candidate_id"]))
        # Later events apply no earlier than this one, so candidates before it are of no more use.
        live = F.filter(state["used"], lambda u: u["candidate_date"] >= e["application_date"])
        one, first = F.size(open_) == 1, F.get(open_, F.lit(0))
        got = F.array(F.struct(e["event_id"].alias("event_id"), first["candidate_id"].alias("candidate_id"), first["candidate_date"].alias("candidate_date")))
        return F.struct(F.when(one, F.concat(live, open_)).otherwise(live).alias("used"), F.when(one, F.concat(state["taken"], got)).otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.array().cast(used).alias("used"), F.array().cast(taken).alias("taken"))
    out = islands.select(*own, F.explode(F.aggregate("events", start, visit, lambda state: state["taken"])).alias("t"))
    return out.select(*own, "t.event_id", "t.candidate_id", "t.candidate_date")


def candidate_event_match(events: DataFrame, candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Matches of ledger events and provider candidates, in ledger order, each candidate used once: the columns that name a series on both sides, then
    ``event_id, candidate_id, candidate_date`` (see ``fitting`` and ``consumed``). ``events`` need ``application_date`` and ``official_value``, its value
    as reported text."""
    return consumed(fitting(events, candidates, bars), *shared_series(events, candidates))


def event_inventory(events: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Every ledger event with its match, and every candidate that no event explains."""
    by = shared_series(events, matches)
    own = events.join(matches.select(*by, "event_id", "candidate_id"), [*by, "event_id"], "left").select(
        "symbol", "event_id", "candidate_id", F.col("effective_date").alias("event_date"), "kind", F.col("candidate_id").isNotNull().alias("provider_confirmed"), (F.col("status") == "verified").alias("verified"),
        F.when(F.col("kind") == "split", "SPLIT").otherwise("DIVIDEND").alias("classification"),
    )
    rest = candidates.join(matches, [*shared_series(candidates, matches), "candidate_id"], "left_anti").select("symbol", F.lit(None).cast("string").alias("event_id"), "candidate_id", F.col("candidate_date").alias("event_date"), "kind", F.lit(True).alias("provider_confirmed"), F.lit(False).alias("verified"), F.lit("UNEXPLAINED").alias("classification"))
    return own.unionByName(rest)


def event_inventory_counts(inventory: DataFrame, attested: DataFrame) -> DataFrame:
    """Per symbol: events by class, those still candidates, and whether the inventory is complete."""
    n = lambda c: F.count_if(F.col("classification") == c)
    out = inventory.groupBy("symbol").agg(n("DIVIDEND").alias("dividends"), n("SPLIT").alias("splits"), n("UNEXPLAINED").alias("unexplained"), F.count("*").alias("total"), F.count_if((F.col("classification") != "UNEXPLAINED") & ~F.col("verified")).alias("still_candidate"))
    return out.join(attested, "symbol", "left").withColumn("complete", F.coalesce("attested", F.lit(False)) & (F.col("unexplained") == 0)).drop("attested")


def announcement_ledger_match(announcements: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """What has no counterpart of its kind within ``days`` on the other side: ``symbol, side, day, kind``."""
    e = events.select("symbol", "kind", F.col("effective_date").alias("event_day"))
    a = announcements.select("symbol", "kind", F.col("day").alias("announced_day"))
    near = F.abs(F.datediff("event_day", "announced_day")) <= days
    # The interval is met in buckets of its own width: equal or neighbouring ones, so the join stays an equi-join.
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    wide = a.withColumn("b", F.explode(F.array(*(bucket("announced_day") + k for k in (-1, 0, 1)))))
    pairs = e.withColumn("b", bucket("event_day")).join(wide, ["symbol", "kind", "b"]).where(near)
    no_e = e.join(pairs.select("symbol", "kind", "event_day").distinct(), ["symbol", "kind", "event_day"], "left_anti").select("symbol", F.lit("event").alias("side"), F.col("event_day").alias("day"), "kind")
    no_a = a.join(pairs.select("symbol", "kind", "announced_day").distinct(), ["symbol", "kind", "announced_day"], "left_anti").select("symbol", F.lit("announcement").alias("side"), F.col("announced_day").alias("day"), "kind")
    return no_e.unionByName(no_a)


def qualification_gates(assets: DataFrame, *tables: DataFrame, gates: list) -> DataFrame:
    """Left joins of gate tables by symbol, then the names of all failed gates; QUALIFIED when there are none. ``gates``: (name,
    condition that holds when the gate fails; null counts as failed)."""
    out = assets
    for t in tables:
        out = out.join(t, "symbol", "left")
    failed = reasons([(name, F.coalesce(broken, F.lit(True))) for name, broken in gates])
    return out.select("symbol", F.array_join(failed, ",").alias("reasons")).withColumn("verdict", F.when(F.col("reasons") == "", "QUALIFIED").otherwise("BLOCKED"))


def universe_verdict(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count("*").alias("assets"), F.count_if(F.col("verdict") == "QUALIFIED").alias("qualified")).withColumn("all_qualified", (F.col("assets") > 0) & (F.col("assets") == F.col("qualified")))
