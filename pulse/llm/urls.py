"""URL filtering: host and path rules first, then a character language-model ratio.

Rules that fit label URLs as accepted (allow) or rejected (block). Smoothed variable-order Markov models of both
(``charlm``) are trained on four fifths of the labelled distinct URLs; the other fifth calibrates the threshold of
the length-normalised log-likelihood difference. URLs without a rule are allowed from the threshold on.

Cases: null URLs have an empty host and path and no score; what has no score is allowed, as is everything when
one of the classes has no URL; equal URLs get one verdict (URLs are named by 128 hash bits); an empty
table gives an empty result. Extra columns pass through in ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm import charlm
from pulse.llm.common import cut, payload

ORDER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and /, ?, # or the end, A-Z lower-cased; and from there to ? or # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest that fits, or nulls. A rule fits its host and subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", order: int = ORDER) -> DataFrame:
    """``row`` (the other columns), ``url``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (null if a rule decides)."""
    rows = pages.select(payload(pages, url_col), F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": by_rule, "u1": F.xxhash64("url"), "u2": F.xxhash64(F.lit(1), "url")})
    cls = F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0)
    urls = cut(rows.where(F.col("url").isNotNull()).groupBy("u1", "u2")
               .agg(F.first("url").alias("text"), F.first(cls).alias("cls")))
    held_out = F.pmod(F.col("u2"), F.lit(5)) == 0
    counted = urls.select("text", F.when(~held_out, F.col("cls")).alias("cls"), F.lit(1).alias("times"))
    ratios = cut(charlm.log_ratios(cut(charlm.window_counts(counted, order)), order))
    asked = urls.where(F.col("cls").isNull() | held_out)
    scored = cut(charlm.scores(asked, ["u1", "u2", "cls"], ratios, order)
                 .select("u1", "u2", "cls", (F.col("total") / F.col("chars")).alias("score")))
    sides = urls.where(~held_out).agg(F.count_if(F.col("cls") == 1).alias("a"), F.count_if(F.col("cls") == 0).alias("b"))
    trained = F.broadcast(sides.crossJoin(charlm.calibrated(scored.where(F.col("cls").isNotNull()))))  # one row
    open_ = scored.where(F.col("cls").isNull()).select("u1", "u2", "score")
    passes = F.col("score").isNull() | (F.col("score") >= F.col("threshold")) | (F.least("a", "b") == 0)
    verdict = F.coalesce("by_rule", F.when(passes, F.lit("allow")).otherwise(F.lit("block")))
    return rows.join(open_, ["u1", "u2"], "left").crossJoin(trained).select(
        "row", "url", "host", "path", "rule", verdict.alias("verdict"), "score")
