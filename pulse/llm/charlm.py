"""Variable-order character Markov models of two classes, in DataFrame operations only.

A position of a string is described by its window: the character and up to ``order`` characters before it. All
its suffixes are (context, character) events of orders 0, 1, 2, ... Windows are counted by class, events are sums
over the windows that end in them, and a window's probability in a class interpolates its events from short to
long by Witten and Bell's rule: p = (n + T * p_shorter) / (N + T), where N is how often the context was seen in
the class, T with how many different characters, n with this one. Events that neither class has seen say nothing.
The counts cover all rows given, so they grow with the input; only distinct windows meet the event table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probability of a character about which nothing is known: one in so many.
ALPHABET = 256


def window_array(text: Column, order: int) -> Column:
    """The windows of a string's characters, one each; the string is opened by U+0002 and closed by U+0003."""
    framed = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    at = F.sequence(F.lit(2), F.length(framed))
    return F.transform(at, lambda i: F.substring(framed, F.greatest(i - order, F.lit(1)), i - F.greatest(i - order, F.lit(1)) + 1))


def window_counts(strings: DataFrame, order: int) -> DataFrame:
    """(win, n0, n1) of ``strings`` (text, cls: 0, 1 or null, times): null counts for neither, but lists its windows."""
    rows = strings.select("cls", "times", F.explode(window_array(F.col("text"), order)).alias("win"))
    n = [F.sum(F.when(F.col("cls") == c, F.col("times")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    return rows.groupBy("win").agg(*n)


def _suffixes(order: int) -> Column:
    n = F.least(F.length("win"), F.lit(order + 1))
    return F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col("win"), F.length("win") - k + 1, k))).alias("event")


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(win, ratio): log of the window's probability in class 1 over that in class 0."""
    seen = counts.where((F.col("n0") > 0) | (F.col("n1") > 0))
    events = (seen.select("n0", "n1", _suffixes(order)).groupBy("event")
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .withColumn("context", F.expr("substring(event, 1, length(event) - 1)")))
    contexts = events.groupBy("context").agg(*[f for c in (0, 1) for f in (
        F.sum(f"n{c}").alias(f"all{c}"), F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"kinds{c}"))])
    known = events.join(contexts, "context").select("event", F.struct(
        F.length("event").alias("k"), *[F.col(x).cast("double").alias(x) for c in (0, 1) for x in (f"n{c}", f"all{c}", f"kinds{c}")]).alias("e"))
    steps = (counts.select("win", _suffixes(order)).join(known, "event").groupBy("win")
             .agg(F.array_sort(F.collect_list("e")).alias("steps")))  # at most order + 1 events a window

    def probability(c: int) -> Column:
        return F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda p, e: F.when(
            e[f"all{c}"] > 0, (e[f"n{c}"] + e[f"kinds{c}"] * p) / (e[f"all{c}"] + e[f"kinds{c}"])).otherwise(p))

    return steps.select("win", (F.log(probability(1)) - F.log(probability(0))).alias("ratio"))


def scores(strings: DataFrame, ids: list[str], ratios: DataFrame, order: int) -> DataFrame:
    """``ids``, ``total`` and ``chars``: summed log ratio of each string (ids, text) and its number of positions."""
    rows = strings.select(*ids, F.explode(window_array(F.col("text"), order)).alias("win"))
    return (rows.join(ratios, "win", "left").groupBy(*ids)
            .agg(F.sum(F.coalesce("ratio", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("chars")))


def calibrated(scored: DataFrame, step: float = 0.01) -> DataFrame:
    """One row (threshold): where the scores held out (score, cls) are parted with the best mean of both classes' hits.

    It lies midway between the lowest such score and the next below. Scores are binned by ``step``; log ratios per character are bounded by the smoothing, so are the bins.
    """
    from pyspark.sql import Window

    bins = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(
        F.sum((F.col("cls") == 1).cast("long")).alias("ones"), F.sum((F.col("cls") == 0).cast("long")).alias("zeros"))
    upward = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    hits = (F.sum("ones").over(upward) / F.greatest(F.sum("ones").over(everything), F.lit(1))
            + F.coalesce(F.sum("zeros").over(below), F.lit(0)) / F.greatest(F.sum("zeros").over(everything), F.lit(1)))
    gap = F.lag("bin").over(Window.orderBy("bin"))
    place = (F.col("bin") + F.coalesce(gap + 1, F.col("bin"))) / 2 * step
    return bins.select("bin", hits.alias("hits"), place.alias("place")).agg(
        F.coalesce(F.min_by("place", F.struct(-F.col("hits"), F.col("bin"))), F.lit(0.0)).alias("threshold"))


def odds(one_in: float) -> float:
    """The log ratio that outweighs a prior of one in so many."""
    return math.log(one_in)
