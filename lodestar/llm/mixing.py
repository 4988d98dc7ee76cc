"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Length of the hex prefixes of the draw at each refinement; the last is the whole digest.
PREFIXES = (3, 6, 9, 32)


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row ``(source, source_size)`` per source to ``(source, source_size, target)``.

    Sources by code point (null last) weigh ``weights`` in turn and share the total size. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight. The level
    at which that settles is found from running sums over sources ordered by cap per weight, the
    same as repeating the sharing until no target is above its cap. One row per source: this table
    is as long as the list of source names.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    t = t.withColumns({
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward),
        "place": F.row_number().over(order),
    })
    settled = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"]
    return t.withColumn("target", F.least("cap", F.coalesce(settled * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def draw(doc_id: Column, text: Column) -> Column:
    """A document's place between 0 and 1, as the hex digits of a digest: the same in every run. Without an id the text draws."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("|"), text), F.lit("")))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, whole, cut, upto)``: every document of the source is taken ``whole`` times, and once
    more if its draw is before ``cut`` (or equal to it where ``upto``).

    Histograms of size by source and prefix of the draw find the bucket in which the rest of the
    budget ends; only that bucket is counted again with a longer prefix. No document is sorted: what
    is ordered are at most 4096 buckets of a source. At the last prefix a bucket is one digest, taken
    when that ends nearer to the budget than leaving it.
    """
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    at = goals.select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit("").alias("cut"), F.lit(0.0).alias("used"))
    upto = None
    for n in PREFIXES:
        known = at.select(F.col("source").alias("s"), "whole", "budget", "cut", "used")
        inside = sized.join(known, F.col("source").eqNullSafe(F.col("s")) & F.col("draw").startswith(F.col("cut"))).drop("s")
        hist = inside.groupBy("source", F.substring("draw", 1, n).alias("bucket")).agg(F.sum("size").alias("size"), F.first("whole").alias("whole"), F.first("budget").alias("budget"), F.first("used").alias("used"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("end", F.col("used") + F.sum("size").over(run))
        over = hist.where(F.col("end") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct("bucket", "size", "end", "whole", "budget"), "bucket").alias("x"))
        at = over.select("source", "x.whole", "x.budget", F.col("x.bucket").alias("cut"), (F.col("x.end") - F.col("x.size")).alias("used"), (F.col("x.end") - F.col("x.budget") < F.col("x.budget") - F.col("x.end") + F.col("x.size")).alias("upto"))
        at = materialize(at, "cut")
    none = goals.select("source", "whole")
    cuts = at.select(F.col("source").alias("s"), "cut", "upto")
    # A source whose budget no bucket exceeds takes all its documents.
    return none.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "whole", F.coalesce("cut", F.lit("g")).alias("cut"), F.coalesce("upto", F.lit(False)).alias("upto"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``documents`` to ``(doc_id, size, source_size, target, times, taken)`` plus text and source columns untouched.

    ``times`` is how often the mix takes the document, ``taken = times * size``. Two narrow passes over
    the text size the documents; the histograms read the narrow table.

    Null text has size 0; a null source is a source of its own, last in order; null ids draw by
    their text, and rows with one id share a draw (both in or both out). An empty table gives no
    rows. Input columns named like a result column are replaced.
    """
    size, place = word_count("text"), draw(F.col("doc_id"), F.col("text"))
    sized = materialize(docs.select("source", size.alias("size"), place.alias("draw")), "sized")
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    plan = goals.alias("g").join(thresholds(sized, goals).alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(*[F.col(a).alias(f"_mix_{b}") for a, b in (("g.source", "source"), ("source_size", "size"), ("target", "target"), ("whole", "whole"), ("cut", "cut"), ("upto", "upto"))])
    plan = materialize(plan, "plan")
    names = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "times", "taken"}]
    out = docs.select(*[F.col(f"`{c}`") for c in names], size.alias("size"), place.alias("_mix_draw")).join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
    extra = F.when((F.col("_mix_draw") < F.col("_mix_cut")) | (F.col("_mix_upto") & (F.col("_mix_draw") == F.col("_mix_cut"))), 1).otherwise(0)
    times = (F.col("_mix_whole") + extra).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in names], "size", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), times.alias("times"), (times * F.col("size")).alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as many times as the mix takes it."""
    return mixed.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
