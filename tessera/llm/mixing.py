"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's size is the number of its words. Sources, by code point and null
last, get the weights in turn and share `budget` of all sizes; a target stops at
`most_epochs` times its source's size, and the excess is shared anew by weight
until none is above. A source then gives whole epochs, each document once an
epoch, and a fraction of one: documents draw exponential keys -ln(u) / w, with u
in (0, 1) from a digest of seed and id and w the document's quality weight;
within the source, by rising key, documents are taken up to the budget left: the one in
which it ends gives its first words, so that a source takes its target to the word.

The prefix sum never sorts a source in one task. Rows are dealt into ranges of source and
key by Spark's sampled ranges, whatever the weights; the sums of ranges tell which range a
source's budget ends in, and only that range's rows of the source are sorted.

Quality weight: a column of docs, or from 1/2 to 1 by the share of distinct words
among words. Null weights count as 1, those of 0 or less as the least.

Defined cases: a null or empty text has size 0 and takes nothing; a source of
size 0 has target 0; a null source is a source of its own; null ids draw as the
empty string; repeated rows are documents of their own, with equal keys; ties of keys
go by id, then size; a very long text counts with all its words; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered, write_table

WEIGHTS = (5, 2, 1)
#: Rows of a range, and the most ranges: Spark samples a hundred keys for each to the driver.
ROWS_IN_RANGE = 10_000
MOST_RANGES = 2_000
LEAST_WEIGHT = 1e-6
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most_epochs: int = 2) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target.

    Only sums by weight reach the driver. In each round the share of a unit of
    weight is the budget left by its weight; sources that it would lift above
    their limit stop there. The limit by weight, source_size / weight, orders the
    sources, so a round is one aggregation.
    """
    unit = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes.select("source", "source_size"), "source")
    weighted = write_table(ranked.select("source", "source_size", unit.alias("weight")), "sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget = total * percent / 100
    limit = F.col("source_size") * most_epochs
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= limit
        row = weighted.agg(
            F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(above.cast("long"))
        ).first()
        full, weight, count = row[0] or 0, row[1] or 0, row[2] or 0
        if not weight or count == stopped:
            break
        stopped, level = count, (budget - full) / weight
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), limit.cast("double")).alias("target"))


def quality_weight(words: Column) -> Column:
    return F.when(F.size(words) > 0, 0.5 + 0.5 * F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(1.0))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = 150,
    most_epochs: int = 2,
    seed: str = "mix",
    rows_in_range: int = ROWS_IN_RANGE,
    weight: str | None = None,
) -> DataFrame:
    """docs: doc_id, text, source, and the column `weight` if one is named. A row for each row: doc_id, source, size,
    source_size, target, weight, draw (the key), epochs, taken."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0))
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # Thirteen hex digits: exact in a double.
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    own = F.lit(None) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(LEAST_WEIGHT))
    drawn = docs.select("doc_id", "source", words.alias("words"), u.alias("u"), own.alias("own")).select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("size"),
        (quality_weight(F.col("words")) if weight is None else F.col("own")).alias("weight"),
        "u",
    )
    drawn = write_table(drawn.withColumn("draw", -F.log("u") / F.col("weight")), "draws")
    sizes = write_table(drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sizes")
    target = targets(sizes.select("source", "source_size"), weights, percent, most_epochs)
    plan = target.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )
    # Whole words; what is a rounding error below one counts as one.
    plan = plan.withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6).cast("long"))
    plan = write_table(plan, "plan")
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    ranges = min(max(1, -(-rows // rows_in_range)), MOST_RANGES)
    order = ("draw", "doc_id", "size")
    ranged = drawn.repartitionByRange(ranges, "source", *order).withColumn("range", F.spark_partition_id())
    ranged = write_table(ranged, "ranges").join(plan.withColumnRenamed("source", "s"), same, "left").drop("s")
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.max("left").alias("left"))
    through = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    before = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), "range_size", "left", through.alias("before"))
    # The range in which the budget ends: below it all are taken, above it none.
    last = before.where("before <= left and before + range_size > left")
    last = last.groupBy("s").agg(F.max(F.struct("r", "before")).alias("x")).select("s", F.col("x.r").alias("last"), F.col("x.before").alias("before"))
    marked = ranged.join(last, same, "left").drop("s")
    at_end = (F.col("range") == F.col("last")) & (F.col("left") > 0)
    upto = F.sum("size").over(Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = F.least(F.col("size"), F.greatest(F.col("left") - F.col("before") - (upto - F.col("size")), F.lit(0)))
    chosen = marked.where(at_end).withColumn("fraction", own.cast("long"))
    # No `last`: nothing is left over to choose (the whole range of keys fits the budget).
    whole = F.when(F.col("left") <= 0, 0).when(F.col("last").isNull() | (F.col("range") < F.col("last")), F.col("size")).otherwise(0)
    rest = marked.where(~F.coalesce(at_end, F.lit(False))).withColumn("fraction", whole.cast("long"))
    return chosen.unionByName(rest).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "weight",
        "draw",
        "epochs",
        (F.col("size") * F.col("epochs") + F.col("fraction")).alias("taken"),
    )
