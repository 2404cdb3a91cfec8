"""Exact order statistics (k-th smallest value) for a few large groups, without a global sort.

``percentile`` holds every distinct value of a group in one aggregation buffer and a
window ``row_number`` over a group sorts it in one task; neither survives a group
with a third of all rows.  Instead every wanted rank is searched on its own, in an open
interval of values that shrinks with distributed passes:

1. one aggregate per rank over the values strictly inside its interval: their number and a
   grid of approximate quantiles (``percentile_approx``, mergeable sketches);
2. two grid values p <= q around the rank split the interval; an exact count of the values
   below p, equal to p, between, and equal to q says where the rank falls.  On p or q it is
   answered at once, however often that value occurs; otherwise the interval shrinks to
   one of the three open parts.

Both p and q occur in the data and leave the interval, so every round makes progress and
ties cost nothing; each round divides the interval by about the grid's resolution.  An
interval with at most ``CAP`` rows is ranked by a window, which is thus bounded.  There is no limit
on rounds.  Only scalars of each (group, rank) travel to the driver, and the caller asks for
a few: features of a table, classes of a label.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import materialized

GRID = 256
ACCURACY = 10_000
CAP = 200_000


@dataclasses.dataclass
class Target:
    """The wanted ``rank`` of ``group``: above ``low`` and below ``high`` (both open), ``below`` rows come before."""

    group: object
    rank: int
    low: object = None
    high: object = None
    below: int = 0
    rows: int | None = None  # inside the interval
    answer: object = None
    before: int = 0  # rows smaller than the answer


def _inside(base: DataFrame, targets: list[tuple[int, Target]], gtype: str, vtype: str, *more) -> DataFrame:
    """The rows of each target's interval, as (t, _x); ``more``: further columns (name, type, values by target)."""
    rows = [(i, t.group, t.low, t.high, *(v[i] for _, _, v in more)) for i, t in targets]
    extra = "".join(f", {n} {k}" for n, k, _ in more)
    bounds = base.sparkSession.createDataFrame(rows, f"t int, _g {gtype}, _low {vtype}, _high {vtype}{extra}")
    within = (F.col("_low").isNull() | (F.col("_x") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_x") < F.col("_high")))
    return base.join(F.broadcast(bounds), "_g").where(within)  # one row for each wanted rank


def narrow(base: DataFrame, targets: list[Target], cap: int) -> None:
    """Shrink the targets' intervals over ``base`` (_g, _x) until each is answered or holds at most ``cap`` rows."""
    gtype, vtype = (base.schema[c].dataType.simpleString() for c in ("_g", "_x"))
    while True:
        open_ = [(i, t) for i, t in enumerate(targets) if t.answer is None and (t.rows is None or t.rows > cap)]
        if not open_:
            return
        grid = [i / GRID for i in range(GRID + 1)]
        found = {r["t"]: r for r in _inside(base, open_, gtype, vtype).groupBy("t").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", grid, ACCURACY).alias("q")).collect()}
        p, q = {}, {}
        for i, t in open_:
            t.rows = found[i]["n"] if i in found else 0
            if t.rows > cap:
                share = (t.rank - t.below) / t.rows
                slack = 1 / GRID + 2 / ACCURACY
                p[i] = found[i]["q"][max(0, int((share - slack) * GRID))]
                q[i] = found[i]["q"][min(GRID, int((share + slack) * GRID) + 1)]
        split = [(i, t) for i, t in open_ if i in p]
        if not split:
            return
        x = F.col("_x")
        counted = _inside(base, split, gtype, vtype, ("_p", vtype, p), ("_q", vtype, q)).groupBy("t").agg(
            F.count_if(x < F.col("_p")).alias("under"), F.count_if(x == F.col("_p")).alias("on_p"),
            F.count_if((x > F.col("_p")) & (x < F.col("_q"))).alias("between"),
            F.count_if((x == F.col("_q")) & (F.col("_p") < F.col("_q"))).alias("on_q"))
        counts = {r["t"]: r for r in counted.collect()}
        for i, t in split:
            r, k = counts[i], t.rank - t.below
            if k <= r["under"]:
                t.high, t.rows = p[i], r["under"]
            elif k <= r["under"] + r["on_p"]:
                t.answer, t.before = p[i], t.below + r["under"]
            elif k <= r["under"] + r["on_p"] + r["between"]:
                t.low, t.high, t.below, t.rows = p[i], q[i], t.below + r["under"] + r["on_p"], r["between"]
            elif k <= r["under"] + r["on_p"] + r["between"] + r["on_q"]:
                t.answer, t.before = q[i], t.below + r["under"] + r["on_p"] + r["between"]
            else:
                passed = r["under"] + r["on_p"] + r["between"] + r["on_q"]
                t.low, t.below, t.rows = q[i], t.below + passed, t.rows - passed


def _rank_small(base: DataFrame, targets: list[Target]) -> None:
    """Answer the targets whose intervals are small by ranking their rows."""
    gtype, vtype = (base.schema[c].dataType.simpleString() for c in ("_g", "_x"))
    rest = [(i, t) for i, t in enumerate(targets) if t.answer is None]
    if not rest:
        return
    need = {i: t.rank - t.below for i, t in rest}
    w = Window.partitionBy("t").orderBy("_x")
    ranked = (_inside(base, rest, gtype, vtype, ("_need", "long", need))
              .select("t", "_x", "_need", F.row_number().over(w).alias("_k"), (F.rank().over(w) - 1).alias("_less")))
    for r in ranked.where(F.col("_k") == F.col("_need")).collect():  # one row for each wanted rank
        t = targets[r["t"]]
        t.answer, t.before = r["_x"], t.below + r["_less"]


def order_statistics(df: DataFrame, group_col: str, value_col: str, ranks: dict,
                     counts: dict | None = None, tiebreak_col: str | None = None) -> DataFrame:
    """Exact k-th smallest non-null ``value_col`` per group (1-based ranks): (group, k, value).

    ``ranks`` maps group value -> list of wanted ranks; ties are those of a multiset.  ``counts``
    (non-null values per group), when the caller has them, lets small groups skip the sketch pass.
    With ``tiebreak_col`` (numeric) the k-th row of the order (value, tiebreak) is returned with its
    tiebreak: among the rows that hold the answer, the search goes on over the tiebreak.
    The passes run when this is called; the result is a small local frame.
    """
    spark = df.sparkSession
    tb = [F.col(tiebreak_col).alias("_tb")] if tiebreak_col else []
    base = df.select(F.col(group_col).alias("_g"), F.col(value_col).alias("_x"), *tb).filter(F.col("_x").isNotNull())
    types = {c: base.schema[c].dataType.simpleString() for c in base.columns}
    for c in ("_x", "_tb"):
        if c in types and not (types[c] in ("double", "float", "bigint", "int", "smallint", "tinyint") or types[c].startswith("decimal")):
            raise TypeError("order statistics need a numeric column")
    counts = counts or {}
    targets = [Target(g, int(k), rows=counts.get(g)) for g, ks in ranks.items() for k in ks]
    narrow(base.select("_g", "_x"), targets, CAP)
    _rank_small(base.select("_g", "_x"), targets)
    targets = [t for t in targets if t.answer is not None]
    rows = [(t.group, t.rank, t.answer) for t in targets]
    schema = f"_g {types['_g']}, k long, _x {types['_x']}"
    if tiebreak_col:
        # every target is a group of its own now: the rows of its answer
        at = spark.createDataFrame([(i, t.group, t.answer) for i, t in enumerate(targets)], f"_t int, _g {types['_g']}, _at {types['_x']}")
        equal = (base.join(F.broadcast(at), "_g").where(F.col("_x") == F.col("_at"))
                 .select(F.col("_t").alias("_g"), F.col("_tb").alias("_x")))
        ties = [Target(i, t.rank - t.before) for i, t in enumerate(targets)]
        narrow(equal, ties, CAP)
        _rank_small(equal, ties)
        rows = [(*r, t.answer) for r, t in zip(rows, ties, strict=True)]
        schema += f", _tb {types['_tb']}"
    out = spark.createDataFrame(rows, schema)
    extra = [F.col("_tb").alias(tiebreak_col)] if tiebreak_col else []
    return out.select(F.col("_g").alias(group_col), "k", F.col("_x").alias(value_col), *extra)


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median of each numeric column (NULLs ignored): (feature, median) as double.

    The median of an even count is the mean of the two middle values (numpy's rule).
    Columns are stacked into a (feature, value) long form and solved together.
    The passes run when this is called; the result is a small local frame.
    """
    spark = df.sparkSession
    # The narrow projection is materialised for the counting and narrowing passes and
    # released afterwards; the long form is a cheap explode on top of it.
    with materialized(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])) as src:
        long = (src.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                                               for c in cols])).alias("kv"))
                .select("kv.feature", "kv.value").filter(F.col("value").isNotNull()))
        counts = {r["feature"]: r["n"] for r in
                  long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        ranks = {c: sorted({(counts[c] + 1) // 2, counts[c] // 2 + 1}) for c in cols if counts.get(c)}
        if not ranks:
            return spark.createDataFrame([(c, None) for c in cols], "feature string, median double")
        found = order_statistics(long, "feature", "value", ranks, counts)
    med = found.groupBy("feature").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    allf = spark.createDataFrame([(c,) for c in cols], "feature string")
    return allf.join(med, "feature", "left")
