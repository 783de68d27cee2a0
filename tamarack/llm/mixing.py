"""Problem 9: sources mixed to target weights by whole copies and one hash-seeded draw.

The mix is as large as all documents together. A source's rate is its target tokens over its own, at most
``max_repeats``; each document is emitted floor(rate) times and once more with the probability of the fraction, decided
by a hash of seed and doc_id, so that the draw is the same on every cluster and in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
TOKEN = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{2,50}(?![\p{L}\p{N}_])"


def n_tokens(text: Column) -> Column:
    """Tokens of the project's tokenizer: runs of letters, digits and underscores, 2 to 50 long."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), written once, so that texts are read once; a null text has no tokens, a null source stays null
    and counts in the total only."""
    from tamarack.plans.stage import written

    s = docs.select("doc_id", source_key(F.col("source")).alias("source"), n_tokens(F.col("text")).alias("tokens"))
    return written(s, "sizes")


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, tokens, total, rate, capped) of each target source.

    ``capped``: even max_repeats copies of all its documents miss the weight, so the rate stops at max_repeats. Spellings of a source are added up: weights are summed, the largest number of repeats holds. A source without
    documents has rate 0. Null weights count as 0.
    """
    t = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    # A grand total of zero rows or more: one row, joined to every source by a constant it carries.
    total = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    n = total.first()["total"]
    r = t.where("source IS NOT NULL").join(own, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("total", F.lit(n).cast("long"))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_weight") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return r.withColumn("rate", rate).withColumn("capped", F.expr("max_repeats * tokens < target_weight * total"))


def unreachable(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source) of the targets whose rate stops at max_repeats before their weight is reached."""
    return rates(sized(docs), targets).where("capped").select("source")


def _draw(doc_id: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _copies(sizes: DataFrame, rate: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, tokens, copies): floor(rate) copies and one more by the draw. Targets are few: one row a source."""
    j = sizes.join(F.broadcast(rate.select("source", "rate")), "source")
    copies = (F.floor("rate") + (_draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return j.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixed(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, tokens, copy): a row for each copy of the chosen documents, numbered from 1, never above max_repeats."""
    s = sized(docs)
    c = _copies(s, rates(s, targets), seed)
    return c.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shares(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, target_weight, tokens, rate, mixed_tokens, actual_share) of each target source."""
    s = sized(docs)
    r = rates(s, targets)
    got = _copies(s, r, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    r = r.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("long"))
    from pyspark.sql import Window as W

    whole = F.greatest(F.sum("mixed_tokens").over(W.partitionBy(F.lit(1))), F.lit(1))  # one row for each source
    return r.select(
        "source", "target_weight", "tokens", F.round("rate", 6).alias("rate"), "mixed_tokens", F.round(F.col("mixed_tokens") / whole, 6).alias("actual_share")
    )
