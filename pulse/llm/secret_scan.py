"""Secret scanning: patterns, and character Markov models of random strings against ordinary identifiers.

The base finds assignments, access keys and hexadecimal runs. What it finds is the labelled sample of random
strings; runs of letters that are written like words, and overlap no base match, are the labelled sample of ordinary
identifiers. Both train character Markov models (``charlm``) over all documents. Every run of key characters that
overlaps no base match, also one written like words, is compared by log-likelihood ratio and added if the ratio
outweighs a prior of one secret in ``PRIOR`` such runs.

No string trains its own verdict: labelled strings are dealt into two folds by a hash, and one that is also to be judged
is judged by the models of the other fold; all others by the models of both.

Positions come from splitting at the matches: a match starts where the pieces and matches before it end, by running
sums over chunks of matches; runs that overlap a base match are found by one merge of both lists. So a text costs about
as much per match whether it is short or long. All in code points.

Cases: null text is empty; a document without matches has zero counts and an empty list; equal texts get equal
spans (texts are named by 128 hash bits); without labelled strings of both kinds nothing is added,
nor is a labelled string if the other fold lacks one kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm import charlm
from pulse.llm.common import cut, payload

ORDER = 2
PRIOR = 1000.0
KINDS = ("assign", "access", "hex", "random")
#: The base patterns. Runs of access keys and hexadecimal digits are maximal, so their least length
#: can stand in the pattern; an assignment that is too short still uses up its text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{12,}"
WORDLIKE = r"^([A-Z]?[a-z]+|[A-Z]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+))*$"
#: Tasks that share the spans of one common run.
SALTS = 32
#: Values that are folded one by one, and how often chunks of them are gathered into chunks of chunks.
CHUNK, LEVELS = 32, 2
#: The fold of runs that are no labelled string.
UNLABELLED = -1
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step, start: int, levels: int = LEVELS) -> Column:
    """What ``step`` (a sum, a maximum) makes of the integers before each of ``values``.

    Chunks are folded for themselves, and what lies before a chunk comes from the chunks' totals in the same way: no
    fold is longer than ``CHUNK`` but for the last level's, over the totals of ``CHUNK ** (levels - 1)`` values each.
    """
    if not levels:
        return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i), F.lit(start), step))

    def by_chunks(v: Column) -> Column:
        count = F.floor((F.size(v) + CHUNK - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(_let(chunks, joined))

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(start), step))
        before = _let(totals, lambda t: running(t, step, start, levels - 1))
        inside = F.zip_with(chunks, before, lambda c, first: F.transform(
            c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), first, step)))
        return F.flatten(inside)

    return by_chunks(values)


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """The pattern's matches as structs (start, kind, end, value), those whose value has ``least`` characters."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.zip_with(whole, values, lambda m, v: F.struct(F.length(m).alias("size"), v.alias("value")))
    parts = F.filter(F.zip_with(gaps, parts, lambda g, p: F.struct(  # the last gap has no match behind it
        F.length(g).alias("gap"), p["size"].alias("size"), p["value"].alias("value"))), lambda p: p["size"].isNotNull())

    def placed(found: Column) -> Column:
        before = _let(F.transform(found, lambda p: p["gap"] + p["size"]), lambda n: running(n, lambda a, x: a + x, 0))
        spans = F.zip_with(found, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value")))
        return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans

    return F.when(F.rlike(text, F.lit(pattern)), _let(parts, placed)).otherwise(F.array().cast(SPAN))


def apart_from(base: Column, runs: Column) -> Column:
    """Those of ``runs`` that overlap no span of ``base``, by one merge of both.

    Runs stand by their ends among the base spans' starts (before an equal one): what starts before a run's end
    stands before the run, and overlaps it if its end lies beyond the run's start.
    """
    places = F.array_sort(F.concat(
        F.transform(runs, lambda r: F.struct(r["end"].alias("at"), F.lit(0).alias("of_base"), r.alias("span"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("of_base"), b.alias("span")))))

    def merged(found: Column) -> Column:
        ends = F.transform(found, lambda p: F.when(p["of_base"] == 1, p["span"]["end"]).otherwise(0))
        reach = _let(ends, lambda e: running(e, lambda a, x: F.greatest(a, x), 0))
        free = F.zip_with(found, reach, lambda p, far: F.when((p["of_base"] == 0) & (far <= p["span"]["start"]), p["span"]))
        return F.filter(free, lambda s: s.isNotNull())

    return F.when(F.size(base) == 0, runs).otherwise(_let(places, merged))


def _outweighing(strings: DataFrame, counts: DataFrame, fold: int, order: int, prior: float) -> DataFrame:
    """(text): the runs of ``fold`` whose ratio outweighs the prior, by the labelled strings of the other folds."""
    others = [F.sum(F.when(F.col("fold") != fold, F.col(c)).otherwise(0)).alias(c) for c in ("n0", "n1")]
    ratios = charlm.log_ratios(counts.groupBy("win").agg(*others), order)
    trained = F.broadcast(counts.agg(*others).select(((F.col("n0") > 0) & (F.col("n1") > 0)).alias("trained")))  # one row
    asked = strings.where((F.col("fold") == fold) & (F.col("runs") > 0))
    return (charlm.scores(asked, ["text"], ratios, order).crossJoin(trained)
            .where(F.col("trained") & (F.col("total") > charlm.odds(prior))).select("text"))


def scan(docs: DataFrame, text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``row`` (the other columns), ``base`` and ``spans``: arrays of (start, kind, end, value) by start, then kind."""
    rows = docs.select(payload(docs, text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = F.array_sort(F.concat(matches(F.col("text"), ASSIGN, 0, 2, ASSIGN_LEAST), matches(F.col("text"), ACCESS, 1),
                                 matches(F.col("text"), HEX, 2)))
    rows = rows.select("row", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), base.alias("base"))
    rows = rows.select("row", "d1", "d2", "base", matches(F.col("text"), RUN, 3).alias("runs"))
    found = cut(rows.select("row", "d1", "d2", "base", apart_from(F.col("base"), F.col("runs")).alias("apart")))

    strings = (found.select(F.explode(F.col("base.value")).alias("text"), F.lit(1).alias("n1"), F.lit(0).alias("runs"))
               .unionAll(found.select(F.explode("apart.value").alias("text"), F.lit(0).alias("n1"), F.lit(1).alias("runs")))
               .groupBy("text").agg(F.sum("n1").alias("n1"), F.sum("runs").alias("runs")))
    strings = strings.withColumn("n0", F.when(F.rlike("text", F.lit(WORDLIKE)), F.col("runs")).otherwise(0))
    fold = F.when(F.col("n0") + F.col("n1") > 0, F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).otherwise(UNLABELLED)
    strings = cut(strings.withColumn("fold", fold))
    windows = strings.select("fold", "n0", "n1", F.explode(charlm.window_array(F.col("text"), order)).alias("win"))
    counts = cut(windows.groupBy("fold", "win").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    secret = _outweighing(strings, counts, UNLABELLED, order, prior)
    for own in (0, 1):
        secret = secret.unionAll(_outweighing(strings, counts, own, order, prior))
    # a word may be a run of very many documents: its spans meet the secrets in several tasks
    salted = secret.select("text", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spans = found.select("d1", "d2", F.explode("apart").alias("span")).withColumn("text", F.col("span.value"))
    spans = spans.withColumn("salt", F.pmod("d1", F.lit(SALTS)).cast("int"))
    added = (spans.join(salted, ["text", "salt"])
             .groupBy("d1", "d2").agg(F.collect_set("span").alias("added")))  # equal texts have equal spans
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return found.join(added, ["d1", "d2"], "left").select("row", "base", every.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
