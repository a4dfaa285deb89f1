"""Shards by extendible hashing.

A row's hash is 60 bits. The directory starts with one bucket; a bucket with more bytes than the limit splits
on the next bit. A bucket's bytes only shrink as its prefix grows, so its rows end at the shortest prefix that
fits; the splits of many bits are taken from one grouped sum, and only leaves still too large are summed again
on deeper bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import row_key, small_side, written

SHARD_BYTES = 8 << 20
#: Bits of hash used; rows that agree in all of them are told apart by pages, in order of their bytes.
BITS = 60
#: Bits that one grouped sum looks ahead at first, and at each later turn.
STEP = 12


def _hashed(docs: DataFrame, ident: str) -> DataFrame:
    """docs with __hash: 60 bits, the first 15 hex digits of the id's MD5."""
    name = F.coalesce(F.col(ident).cast("string"), F.lit("null"))
    return docs.withColumn("__hash", F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("bigint"))


def _prefix(bits: int):
    return F.shiftright("__hash", BITS - bits)


def directory(rows: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """rows: __hash, size. Levels (bits, table of leaf and depth), and the leaves that all bits leave too large, if any."""
    levels: list[tuple[int, DataFrame]] = []
    deep, open_leaves = 0, None
    while deep < BITS:
        to = min(BITS, deep + STEP)
        here = rows if open_leaves is None else rows.join(open_leaves, _prefix(deep) == open_leaves.open, "left_semi")
        leaves = here.groupBy(_prefix(to).alias("leaf")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        # Every prefix of a leaf, the leaf included; the shortest that fits is its bucket.
        depths = F.explode(F.sequence(F.lit(deep), F.lit(to))).alias("depth")
        tree = leaves.select("leaf", "bytes", "n", depths).withColumn("prefix", F.expr(f"shiftright(leaf, {to} - depth)"))
        sums = tree.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("n") <= 1)).select("depth", "prefix")
        placed = written(tree.select("leaf", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("leaf").agg(F.min("depth").alias("depth")))
        levels.append((to, small_side(placed, F.lit(16))))
        open_leaves = written(leaves.join(placed, "leaf", "left_anti").select(F.col("leaf").alias("open")))
        if open_leaves.isEmpty():
            return levels, None
        deep = to
    return levels, open_leaves


def _placed(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with __depth and __shard, null where no leaf fits. Where the directory can be broadcast, rows stay where they lie."""
    for to, leaves in levels:
        rows = rows.join(leaves.select(F.col("leaf").alias(f"__leaf{to}"), F.col("depth").alias(f"__depth{to}")), _prefix(to) == F.col(f"__leaf{to}"), "left")
    rows = rows.withColumn("__depth", F.coalesce(*[F.col(f"__depth{to}") for to, _ in levels]))
    bits = F.lpad(F.conv(F.col("__hash").cast("string"), 10, 2), BITS, "0")
    return rows.withColumn("__shard", F.when(F.col("__depth") == 0, "").otherwise(F.substring(bits, F.lit(1), F.col("__depth")))).drop(*[f"__{x}{to}" for to, _ in levels for x in ("leaf", "depth")])


def shards(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes), shard (the prefix's bits, '' for one bucket; '#n' follows on overflow page n), depth (bits of
    the prefix) for each row of docs.

    A shard's sizes sum to limit at most, unless one text alone is longer, which is then a shard by itself or with
    empty texts. The hash is of doc_id, so a shard doesn't move when other columns change. Null doc_ids hash as
    'null', null texts have size 0. Rows of one doc_id share all bits: once no bit is left, they fill numbered
    overflow pages. Other columns are not read.
    """
    small = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("size"), row_key(text, ident).alias("__key"))
    rows = written(_hashed(small, "doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint")))
    levels, crowded = directory(rows, limit)
    out = _placed(rows, levels)
    if crowded is not None:
        out = out.where("__depth IS NOT NULL").unionByName(_pages(out.where("__depth IS NULL"), limit))
    return out.select("doc_id", "size", F.col("__shard").alias("shard"), F.col("__depth").alias("depth"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows whose hashes agree in all bits: rows of one doc_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("__hash").orderBy("size", "__key", "__tie")
    # Half a page at a time: the rows that end within one half sum to a page at most; a longer text has its own.
    run = rows.withColumn("__tie", F.monotonically_increasing_id()).withColumn("__sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    half = max(limit // 2, 1)
    page = F.when(F.col("size") > half, F.concat(F.lit("L"), F.row_number().over(order).cast("string"))).otherwise(F.floor(F.col("__sum") / half).cast("string"))
    bits = F.lpad(F.conv(F.col("__hash").cast("string"), 10, 2), BITS, "0")
    return run.withColumn("__shard", F.concat(bits, F.lit("#"), page)).withColumn("__depth", F.lit(BITS)).drop("__tie", "__sum")


def with_shards(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with the column shard (see shards). Texts are shuffled only if the directory is too large to broadcast."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    levels, crowded = directory(written(_hashed(docs.select(ident, size.alias("size")), ident).select("__hash", "size")), limit)
    columns = [c for c in docs.columns if c != "shard"]
    out = _placed(_hashed(docs.select(*columns), ident), levels)
    if crowded is None:
        return out.select(*columns, F.col("__shard").alias("shard"))
    whole = F.struct(*columns).alias("__row")  # whatever the columns are called, they don't meet the pages' own
    over = _pages(out.where("__depth IS NULL").select(whole, size.alias("size"), row_key(text, ident).alias("__key"), "__hash"), limit)
    return out.where("__depth IS NOT NULL").select(*columns, F.col("__shard").alias("shard")).union(over.select("__row.*", "__shard"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, text: str = "text", ident: str = "doc_id") -> None:
    """One folder a shard below path, named s_ and the shard's name, so that it is read back as text and never empty."""
    named = with_shards(docs, limit, text, ident).withColumn("shard", F.concat(F.lit("s_"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
