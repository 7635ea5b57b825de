"""Mixing sources to target weights, with a cap on how often a source may be repeated.

Capped water-filling: every source gets tokens in proportion to its weight, sources that would need more
than their cap of repetitions are clamped, and what they leave is shared by the others in proportion until
nothing exceeds its cap. With the sources of a mix in order of cap over weight this level is found by running
sums, without a loop. A source then takes all its documents a whole number of times, and for the rest a
seeded part of them once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.session import materialize

#: Parts into which the documents of a source are divided by their seeded hash.
BUCKETS = 4096
#: Rows of targets up to which the plan of a mix is broadcast.
SMALL = 10_000


def allot(targets: DataFrame, sizes: DataFrame, total: int | float) -> DataFrame:
    """Tokens that each source of each mix is to give, with the repetitions that this takes.

    ``targets``: mix_name, source, weight, max_repeats, size_ratio; ``sizes``: source, tokens; ``total``: tokens of all
    documents. Result per mix_name and source: weight, max_repeats, tokens, wanted, allotted, clamped, whole
    (repetitions of all documents) and budget (tokens of the part taken once more).

    - Repeated rows of targets count once; rows with a null mix or source are left out. A null or negative weight
      counts as 0, a null cap as 1, a negative one as 0; the wanted size of a mix is its largest size_ratio.
    - A source without documents or tokens gives nothing, and its weight goes to the others. If all sources
      together are too small, each gives all that its cap allows.
    """
    rows = (
        targets.dropna(subset=["mix_name", "source"])
        .groupBy("mix_name", "source")
        .agg(F.greatest(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
        .join(sizes.select("source", "tokens"), "source", "left")
        .fillna(0, ["tokens"])
    )
    mix = W.partitionBy("mix_name")
    rows = rows.withColumn("wanted", F.coalesce(F.max("size_ratio").over(mix), F.lit(0.0)) * F.lit(float(total)))
    rows = rows.withColumn("cap", F.when(F.col("weight") > 0, F.col("max_repeats") * F.col("tokens").cast("double")).otherwise(0.0))
    rows = rows.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
    order = mix.orderBy("fill", "source")
    rows = rows.withColumn("clamped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the level if all smaller sources are clamped and this one isn't; the first that holds is the level
    level = F.when(F.col("weight_left") > 0, F.greatest(F.col("wanted") - F.col("clamped_before"), F.lit(0.0)) / F.col("weight_left"))
    rows = rows.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(mix)
    rows = rows.withColumn("level", first["level"])
    clamped = F.col("level").isNull() | (F.col("fill") < F.col("level"))
    allotted = F.when(clamped, F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    rows = rows.withColumn("clamped", clamped & (F.col("weight") > 0)).withColumn("allotted", allotted)
    whole = F.when(F.col("tokens") > 0, F.when(clamped, F.col("max_repeats")).otherwise(F.least(F.floor(F.col("allotted") / F.col("tokens")), F.col("max_repeats")))).otherwise(0)
    rows = rows.withColumn("whole", F.when(F.col("weight") > 0, whole).otherwise(0).cast("int"))
    return rows.select("mix_name", "source", "weight", "max_repeats", "tokens", "wanted", "allotted", "clamped", "whole", F.greatest(F.col("allotted") - F.col("whole") * F.col("tokens"), F.lit(0.0)).alias("budget"))


def _fitting(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``fits``: whether the tokens of the rows of a key up to this one, in the order of ``_order``, are within ``budget``.

    The running sum goes over 4096 parts of a key and then inside the one part where the budget ends: no window holds a whole key.
    """
    rows = rows.withColumn("_part", F.pmod("_order", F.lit(BUCKETS)).cast("int"))
    parts = rows.groupBy(*key, "_part").agg(F.sum("n_tokens").alias("_size"))
    parts = parts.withColumn("_before", F.sum("_size").over(W.partitionBy(*key).orderBy("_part")) - F.col("_size"))
    rows = rows.join(parts, [*key, "_part"])
    ends_here = (F.col("_before") <= F.col("budget")) & (F.col("_before") + F.col("_size") > F.col("budget"))
    running = F.sum("n_tokens").over(W.partitionBy(*key, "_part").orderBy("_order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    inside = rows.filter(ends_here).withColumn("fits", F.col("_before") + running <= F.col("budget"))
    outside = rows.filter(~ends_here).withColumn("fits", F.col("_before") + F.col("_size") <= F.col("budget"))
    return inside.unionByName(outside).drop("_part", "_size", "_before")


def sample(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of each mix: mix_name, source, doc_id, n_tokens, repeats (at least 1).

    ``docs``: doc_id, source, n_tokens, one row per document; ``plan``: what ``allot`` gives. Beyond the whole
    repetitions documents are taken once more in the order of a seeded hash as long as they fit the budget, then, of those
    that are short enough for what is left, again as long as they fit; then the one document that brings the sum nearest to the
    budget is added, if any does. Documents with a null source, or one that the plan lacks, are in no mix. The same seed
    gives the same mix.
    """
    plan = plan.filter("whole > 0 or budget > 0").select("mix_name", "source", "whole", "budget", "max_repeats")
    plan = F.broadcast(plan) if plan.count() <= SMALL else plan
    key = ["mix_name", "source"]
    rows = docs.select("doc_id", "source", "n_tokens").join(plan, "source").withColumn("_order", F.xxhash64("doc_id", "mix_name", F.lit(seed)))
    rows = materialize(_fitting(rows, key), "fitting")

    def gaps(chosen: DataFrame) -> DataFrame:
        """What is left of each budget."""
        left = F.max("budget") - F.sum(F.when(F.col("fits"), F.col("n_tokens")).otherwise(0))
        return chosen.groupBy(*key).agg(left.alias("gap"))

    rest = rows.filter("not fits and n_tokens > 0 and whole < max_repeats").join(gaps(rows), key)
    second = _fitting(rest.filter("n_tokens <= gap").withColumn("budget", F.col("gap")).drop("fits", "gap"), key).filter("fits")
    second = materialize(second.select(*key, "doc_id", "n_tokens"), "second")
    filled = second.groupBy(*key).agg(F.sum("n_tokens").alias("filled"))
    # an untaken document shorter than twice what is left brings the sum nearer
    last = rest.join(second.select(*key, "doc_id"), [*key, "doc_id"], "left_anti").join(filled, key, "left").withColumn("gap", F.col("gap") - F.coalesce("filled", F.lit(0)))
    last = last.filter("n_tokens < 2 * gap").groupBy(*key).agg(F.min(F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("miss"), "_order", "doc_id"))["doc_id"].alias("doc_id"))
    more = second.select(*key, "doc_id").unionByName(last).withColumn("also", F.lit(1))
    rows = rows.join(more, [*key, "doc_id"], "left")
    repeats = F.least(F.col("whole") + F.greatest(F.col("fits").cast("int"), F.coalesce("also", F.lit(0))), F.col("max_repeats"))
    return rows.select(*key, "doc_id", "n_tokens", repeats.cast("int").alias("repeats")).filter("repeats > 0")


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source what was wanted and what was reached; sources that gave nothing are reported too."""
    got = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    rows = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["documents", "mixed_tokens", "most_repeats"])
    mix = W.partitionBy("mix_name")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(mix), F.lit(0)), F.lit(0.0))
    return rows.select(
        "mix_name", "source", "max_repeats", F.col("tokens").alias("source_tokens"), "clamped", share("weight").alias("target_share"), share("allotted").alias("allotted_share"), share("mixed_tokens").alias("actual_share"),
        "documents", "mixed_tokens", F.col("most_repeats").cast("int").alias("most_repeats"), (F.col("mixed_tokens") / F.nullif(F.col("wanted"), F.lit(0.0))).alias("size_reached"),
    )
