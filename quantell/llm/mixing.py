"""Problem 9: mixing sources to target weights, by a curriculum whose weights change over the training run.

Each source has a schedule of weights over training time t in [0, 1], straight lines between the points of a table; a
source without points keeps one weight. A source's schedule is scaled so that its integral is what the source is to give
in all, so every share is met, and at any time the sources stand in the ratio of their scaled weights: they are
normalised over the sources by counting training time in what all of them give. A copy of a document that comes after c
tokens of its source's stream is trained on at the t where the integral reaches c. Sorting by t interleaves all sources
as their schedules ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.llm.stable import RANGE, key_hash
from quantell.plans.shared import written

#: Parts of a source's stream over which running sums are taken.
BUCKETS = 1 << 12
#: Target sources up to this many are broadcast; more are joined by shuffle.
MOST_SOURCES = 10_000


def source_plan(sizes: DataFrame, targets: DataFrame, source: Column, share: str = "target_share", cap: str = "max_repeats", budget: float | None = None) -> DataFrame:
    """``(source, tokens, wanted, most, used, repeats, remainder, target_share, share, short)`` per target source.

    ``sizes`` is (source, tokens) per source, of all documents that have one. ``wanted`` is the target share of
    ``budget`` (all tokens by default), ``most`` what the source can give at ``cap`` repeats, ``used`` the lesser.
    A source is ``short`` where ``most`` is below ``wanted``. ``share`` is of what is used in all. Whole ``repeats``
    go to every document of the source and one more to the first documents of its stream, ``remainder`` tokens of them.
    A null cap is 0, a null share too; repeated targets of a source add their shares and keep the greatest cap.
    """
    t = targets.select(source.alias("source"), F.coalesce(F.col(share), F.lit(0.0)).alias("s"), F.coalesce(F.col(cap), F.lit(0)).alias("cap"))
    t = t.where("source IS NOT NULL").groupBy("source").agg(F.sum("s").alias("target_share"), F.max("cap").alias("cap"))
    total = F.lit(float(budget)) if budget is not None else F.col("total").cast("double")
    all_ = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    p = t.join(sizes, "source", "left").join(F.broadcast(all_)).withColumn("tokens", F.coalesce("tokens", F.lit(0)))  # one row is broadcast
    p = p.withColumn("wanted", F.col("target_share") * total).withColumn("most", F.col("cap") * F.col("tokens"))
    p = p.withColumn("used", F.least(F.col("wanted"), F.col("most").cast("double"))).withColumn("short", F.col("most") < F.col("wanted"))
    p = p.withColumn("repeats", F.coalesce(F.floor(F.col("used") / F.nullif(F.col("tokens"), F.lit(0))), F.lit(0)))
    p = p.withColumn("remainder", F.col("used") - F.col("repeats") * F.col("tokens"))
    used = p.agg(F.sum("used").alias("all_used"))
    p = p.join(F.broadcast(used)).withColumn("share", F.coalesce(F.col("used") / F.nullif(F.col("all_used"), F.lit(0.0)), F.lit(0.0)))
    return p.select("source", "tokens", "wanted", "most", "used", "repeats", "remainder", "target_share", "share", "short")


def segments(schedules: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, lines, area)`` per source: its schedule's straight lines, an array of (before, t0, t1, w0, w1) in order of time,
    ``before`` the integral up to t0, and ``area`` the integral over all.

    ``schedules`` is (source, t, weight). Points with a null part, outside [0, 1] or of negative weight are left out; of
    several at a time the greatest weight counts. Before the first and after the last point the weight stays; a source
    without points, or with no weight at any of them, keeps weight 1.
    """
    points = schedules.select("source", F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("w"))
    points = points.where("source IS NOT NULL AND t BETWEEN 0 AND 1 AND w >= 0 AND w < double('infinity')").groupBy("source", "t").agg(F.max("w").alias("w"))
    per = points.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("k"))  # the points of one schedule
    level = F.expr("array(named_struct('t', 0D, 'w', 1D), named_struct('t', 1D, 'w', 1D))")
    first, last = F.element_at("k", 1), F.element_at("k", -1)
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), first["w"].alias("w"))), F.col("k"), F.array(F.struct(F.lit(1.0).alias("t"), last["w"].alias("w"))))
    k = F.coalesce(F.when(F.exists("k", lambda p: p["w"] > 0), ends), level)
    all_ = sources.select("source").join(per, "source", "left").select("source", k.alias("k"))
    start = F.expr("named_struct('lines', CAST(array() AS array<struct<before: double, t0: double, t1: double, w0: double, w1: double>>), 'area', 0D, 't', 0D, 'w', 0D)")

    def more(s: Column, p: Column) -> Column:
        line = F.struct(s["area"].alias("before"), s["t"].alias("t0"), p["t"].alias("t1"), s["w"].alias("w0"), p["w"].alias("w1"))
        area = s["area"] + (p["t"] - s["t"]) * (s["w"] + p["w"]) / 2
        return F.struct(F.when(p["t"] > s["t"], F.concat(s["lines"], F.array(line))).otherwise(s["lines"]).alias("lines"), area.alias("area"), p["t"].alias("t"), p["w"].alias("w"))

    return all_.select("source", F.aggregate("k", start, more).alias("s")).select("source", "s.lines", "s.area")


def when_demanded(share: Column, lines: Column, area: Column) -> Column:
    """The t at which a schedule (see :func:`segments`) has demanded a ``share`` of its stream.

    In the line that holds it, ``y = w0 s + m s² / 2`` with m its slope; the root is written so that it holds for level
    lines too.
    """
    part = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * area
    line = F.element_at(F.filter(lines, lambda s: (s["before"] <= part) & (s["w0"] + s["w1"] > 0)), -1)
    y = 2 * (part - line["before"])
    slope = (line["w1"] - line["w0"]) / (line["t1"] - line["t0"])
    root = F.sqrt(F.greatest(line["w0"] * line["w0"] + slope * y, F.lit(0.0)))
    return line["t0"] + F.coalesce(y / F.nullif(line["w0"] + root, F.lit(0.0)), F.lit(0.0))


def mixture(
    docs: DataFrame, targets: DataFrame, doc_id: str, source: Column, size: Column, target_source: Column, schedules: DataFrame | None = None,
    salt: str = "mix", budget: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The training copies ``(doc_id, copy, source, tokens, position)`` and the plan with the shares reached.

    ``position`` is the copy's time in [0, 1]; :func:`in_order` sorts by it. ``schedules`` is (source, t, weight), sources
    written as ``source`` gives them; see :func:`segments`. Documents without a source, or of one
    without a target, get no copy; documents of 0 tokens come with the whole repeats only. Repeated rows of a document
    count as often as they occur. The stream of a source follows a hash of the document, so the same documents are
    repeated in every run. The last copy may reach beyond the demand: shares are met to within one document a source.

    Running sums over a source are taken from sums per hash bucket, then within buckets: a source of any size is spread
    over ``BUCKETS`` windows.
    """
    rows = docs.select(F.col(doc_id).alias("d"), source.alias("source"), size.cast("long").alias("n")).where("source IS NOT NULL AND d IS NOT NULL")
    rows = written(rows.withColumn("h", key_hash(F.col("d"), salt)).withColumn("b", (F.col("h") / (RANGE // BUCKETS)).cast("int")))
    buckets = rows.groupBy("source", "b").agg(F.sum("n").alias("n"))
    plan = written(source_plan(buckets.groupBy("source").agg(F.sum("n").alias("tokens")), targets, target_source, budget=budget))
    points = schedules if schedules is not None else docs.sparkSession.createDataFrame([], "source string, t double, weight double")
    lines = segments(points, plan)
    few = plan.join(lines, "source").select("source", "used", "repeats", "remainder", F.col("tokens").alias("in_source"), "lines", "area")
    if plan.count() <= MOST_SOURCES:
        few = F.broadcast(few)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = buckets.withColumn("before", F.coalesce(before, F.lit(0))).select("source", "b", "before")  # BUCKETS rows a source at most
    inside = Window.partitionBy("source", "b").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["source", "b"]).join(few, "source")
    offset = F.col("before") + F.col("own")
    copies = F.col("repeats") + F.when((offset < F.col("remainder")) & (F.col("n") > 0), 1).otherwise(0)
    each = placed.withColumn("offset", offset).withColumn("copies", copies).where("copies > 0")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    c = (F.col("copy") - 1) * F.col("in_source") + F.col("offset")
    position = F.round(when_demanded(c / F.nullif(F.col("used"), F.lit(0.0)), F.col("lines"), F.col("area")), 9)
    return each.select(F.col("d").alias(doc_id), "copy", "source", F.col("n").alias("tokens"), position.alias("position")), plan


def in_order(copies: DataFrame, doc_id: str, partitions: int | None = None) -> DataFrame:
    """Copies in training order: range-partitioned and sorted by position, ties by document and copy."""
    by = ["position", doc_id, "copy"]
    ranged = copies.repartitionByRange(partitions, *by) if partitions else copies.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def reached(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with what the copies give: ``made`` tokens, ``copies``, ``made_share`` of all made, and ``short`` where the source
    stays below what is wanted."""
    made = copies.groupBy("source").agg(F.sum("tokens").alias("made"), F.count("*").alias("copies"))
    out = plan.drop("short").join(made, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("made", "copies")})
    all_ = out.agg(F.sum("made").alias("all_made"))
    out = out.join(F.broadcast(all_)).withColumn("made_share", F.coalesce(F.col("made") / F.nullif(F.col("all_made"), F.lit(0)), F.lit(0.0)))  # one row is broadcast
    return out.drop("all_made").withColumn("short", F.col("made") < F.col("wanted"))
