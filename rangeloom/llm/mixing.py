"""Mixing sources to target weights with built-in functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import WORD, small_side, written

WEIGHTS = (5, 2, 1)
#: No document is repeated more often.
MOST = 3
SEED = "mix"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target (double): one row for each source.

    Sources in order of code points, null last, take the weights in turn. Targets sum to all sizes; a target stops
    at most times its source's size and the excess goes to the others by weight, again and again. Sorted by size for
    a weight, the sources that stop come first, so the final share follows from two running sums. The windows run
    over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = by_source.withColumn("w", weight.cast("bigint"))
    # Everything is a whole number until the last division, so results don't depend on the order of sums.
    big = "decimal(38,0)"
    step = math.lcm(*weights)
    filling = Window.orderBy(F.col("source_size").cast(big) * (F.lit(step) / F.col("w")).cast("bigint"), F.col("source").isNull(), "source")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    rows = rows.withColumn("place", F.row_number().over(filling)).withColumn("left", F.sum("source_size").over(everyone) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
    rows = rows.withColumn("others", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(earlier), F.lit(0)))
    stops = F.col("w").cast(big) * F.col("left") > (most * F.col("source_size")).cast(big) * F.col("others")
    rows = rows.withColumn("free", F.min(F.when(~stops, F.struct("place", "left", "others"))).over(everyone))
    share = (F.col("w") * F.col("free.left")).cast("double") / F.col("free.others").cast("double")
    target = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), (most * F.col("source_size")).cast("double")).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def coin(ident: str, seed: str) -> Column:
    """A number from 0 to below 1 that follows from seed and id."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(F.col(ident).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / float(16**13)


def copies(ident: str, seed: str) -> Column:
    """floor(rate), and one more with the probability of rate's fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + (coin(ident, seed) < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def mixed(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs; taken = copies * size.

    A null text has size 0; a source of size 0 has target 0 and no copies. Null is a source of its own. Rows of one
    doc_id share one coin, so reruns and repeats agree. Other columns are not read.
    """
    sizes = written(docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size")))
    named = targets(sizes, weights, most).withColumnRenamed("source", "__source")
    joined = sizes.join(named, F.col("source").eqNullSafe(F.col("__source")))
    out = joined.withColumn("copies", copies("doc_id", seed))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; same columns. Texts stay where they lie while the table of sources
    can be broadcast; beyond that both sides of the join were written, and Spark splits the partitions of large sources."""
    sizes = docs.select(F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    named = written(targets(sizes, weights, most).select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")))
    # Texts must not be dealt out by source: a source may hold a third of them.
    named = small_side(named, 24 + F.coalesce(F.octet_length("__source"), F.lit(0)))
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    times = F.floor(rate) + (coin(ident, seed) < rate - F.floor(rate)).cast("bigint")
    joined = docs.join(named, docs[source].cast("string").eqNullSafe(F.col("__source")))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[joined[c] for c in docs.columns])
