"""URL filter: host and path rules first, a pair of character language models for the rest.

Built from DataFrame expressions only. URLs that a rule allows or blocks train an accepting and a
rejecting model: Markov models over the last two characters, the last one, or none, each order smoothed
with the shorter one by the number of different followers (Witten and Bell). A URL's score is the
difference of the two log-likelihoods by its length; the threshold is where fewest training URLs, each
class counted as one half, come out wrong.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

#: (verdict, host, path); the longest that fits decides.
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Printable ASCII without capitals, one sign for all other characters, one for either end.
OTHER, EDGE = "\x01", "\x02"
ALPHABET = 94 - 26 + 2
#: Log-likelihood ratios are summed as whole millionths, scores compared in hundredths.
MICRO, STEP = 1_000_000, 100


def host_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, null where none fits."""
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _signs(url: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^!-~]", OTHER)
    return F.concat(F.lit(EDGE * 2), plain, F.lit(EDGE))


def trigrams(url: Column) -> Column:
    """All overlapping threes, in one pass over the text."""
    return F.regexp_extract_all(_signs(url), F.lit("(?=([\\x00-\\x7F]{3}))"), F.lit(1))


def _smoothed(n: Column, context: Column, followers: Column, shorter: Column) -> Column:
    """Share of the context's events plus the followers' share of the shorter order."""
    return F.when(context > 0, (n + followers * shorter) / (context + followers)).otherwise(shorter)


def trigram_ratios(counted: DataFrame) -> DataFrame:
    """(gram, llr) from (gram, allowed, blocked): the log ratio in millionths, for every gram listed.

    At most ``ALPHABET ** 3`` rows whatever the input, so its sums are over bounded groups.
    """
    table = counted.select("gram", F.substr("gram", F.lit(1), F.lit(2)).alias("c2"), F.substr("gram", F.lit(2), F.lit(2)).alias("g2"), "allowed", "blocked")
    sums = [F.sum(c).alias(c) for c in ("allowed", "blocked")]
    seen = lambda prefix: [F.sum(c).alias(f"{prefix}_{c}") for c in ("allowed", "blocked")] + [
        F.sum((F.col(c) > 0).cast("long")).alias(f"{prefix}f_{c}") for c in ("allowed", "blocked")
    ]
    pairs = table.groupBy("g2").agg(*sums).select("*", F.substr("g2", F.lit(1), F.lit(1)).alias("c1"), F.substr("g2", F.lit(2), F.lit(1)).alias("g1"))
    single = pairs.groupBy("g1").agg(*sums)
    total = single.groupBy().agg(*seen("t0"))
    single = single.withColumnsRenamed({c: f"n1_{c}" for c in ("allowed", "blocked")})
    pairs_named = pairs.withColumnsRenamed({c: f"n2_{c}" for c in ("allowed", "blocked")})
    joined = (
        table.join(table.groupBy("c2").agg(*seen("t2")), "c2")
        .join(pairs_named, "g2")
        .join(pairs.groupBy("c1").agg(*seen("t1")), "c1")
        .join(single, "g1")
        .withColumns({c: total.select(c).scalar() for c in total.columns})
    )

    def probability(c: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for order, n in ((0, f"n1_{c}"), (1, f"n2_{c}"), (2, c)):
            p = _smoothed(F.col(n), F.col(f"t{order}_{c}"), F.col(f"t{order}f_{c}"), p)
        return p

    return joined.select("gram", F.round((F.log(probability("allowed")) - F.log(probability("blocked"))) * MICRO).cast("long").alias("llr"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", id_column: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the model's ``step`` (hundredths of the
    log-likelihood ratio by character, rounded down).

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
    model (a null as the empty string). If no url is allowed by a rule, or none is blocked, there is
    nothing to tell apart and the rest is allowed. Repeated rows are judged alike, each on its own row;
    no rows give no rows. Other columns are not read.
    """
    picked = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"))
    judged = picked.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "ruled.rule", F.col("ruled.verdict").alias("ruled")
    )
    grams = judged.select("ruled", F.explode(trigrams(F.col("url"))).alias("gram"))
    side = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)).alias({"allow": "allowed", "block": "blocked"}[v])
    ratios = stage(trigram_ratios(stage(grams.groupBy("gram").agg(side("allow"), side("block")), "url-grams")), "url-ratios")

    rows = judged.withColumn("row", F.monotonically_increasing_id())
    # Only the row's number goes with every gram: a path may be as long as its url.
    spread = rows.select("row", F.explode(trigrams(F.col("url"))).alias("gram"))
    # At most ALPHABET ** 3 short rows, whatever the number of pages.
    sums = spread.join(F.broadcast(ratios), "gram").groupBy("row").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    scored = rows.drop("url").join(sums, "row")
    step = F.floor(F.col("llr") / (F.col("n") * (MICRO // STEP)))
    scored = stage(scored.select("page_id", "host", "path", "rule", "ruled", step.alias("step")), "url-scores")

    threshold = calibrated(scored).scalar()
    verdict = F.when((F.col("step") >= threshold) | threshold.isNull(), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), "step")


def calibrated(scored: DataFrame) -> DataFrame:
    """One row: the lowest step with the best balanced accuracy on the ruled URLs; null if a class is empty.

    Steps are hundredths of a bounded mean, so there are only some thousands to rank.
    """
    # A sign's likelihoods differ by a bounded factor, so a mean lies within a few dozen units.
    steps = scored.filter("ruled IS NOT NULL").groupBy("step").agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked")
    )
    below = Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    right = (
        (F.sum("allowed").over(whole) - F.coalesce(F.sum("allowed").over(below), F.lit(0))) * F.sum("blocked").over(whole)
        + F.coalesce(F.sum("blocked").over(below), F.lit(0)) * F.sum("allowed").over(whole)
    )
    ranked = steps.select("step", right.alias("right"), F.sum("allowed").over(whole).alias("a"), F.sum("blocked").over(whole).alias("b"))
    return ranked.filter("a > 0 AND b > 0").agg(F.max_by("step", F.struct("right", -F.col("step"))))
