"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm import chat, decontaminate, langid, lines, mixing, ngram_lm, quality, sharding, simhash, sql, substring
from rangeloom.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(_table(spark, sf_dir, "documents"), with_text=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_common_lines(_table(spark, sf_dir, "documents"), with_kept=False)


def _as_log(rows: DataFrame) -> DataFrame:
    """The log of events that conversations could come from; its fold gives the rows back. By turn, an answer is streamed in two
    parts; or a draft with its deltas is edited; or a draft is followed by one more turn, and is then regenerated in two parts,
    which drops that turn. Rows of one turn stay apart, and half a text is counted in code points."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    rows = rows.select("conv_id", nth.alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text") + 1)
    none, later = F.lit(None).cast("string"), F.col("nth") + F.lit(1 << 40)

    def event(kind: str, text, role=none, turn=None):
        return F.struct((F.col("nth") if turn is None else turn).alias("turn"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    role = F.col("role")
    streamed = F.array(event("message", first, role), event("delta", second))
    edited = F.array(event("message", F.lit("A draft"), role), event("delta", F.lit(" that was wrong")), event("edit", F.col("text")))
    again = F.array(event("message", F.lit("A draft"), role), event("message", F.lit("A turn after it"), role, later), event("regenerate", first), event("delta", second))
    log = rows.select("conv_id", "nth", F.posexplode(F.when(F.col("nth") % 3 == 0, streamed).when(F.col("nth") % 3 == 1, edited).otherwise(again)).alias("place", "event"))
    return log.select("conv_id", (F.col("nth") * 8 + F.col("place")).alias("seq"), "event.turn", "event.kind", "event.role", "event.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    out = chat.render(chat.messages(_as_log(rows.union(probe)))).withColumn("turns", chat.read_back()).withColumn("under", chat.loss_text())
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.fit(docs.where(~langid.held_out()))
    out = langid.identified(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.train(docs.where(ngram_lm.learned_from()), min_count=1)  # every n-gram, single ones too
    out = ngram_lm.scored(docs, model)
    return out.select("doc_id", (~ngram_lm.learned_from()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents")).select("doc_id", "size", "shard", F.col("depth").cast("int").alias("depth"))


#: A limit that splits even small tables many times, for the check of the directory against SQL.
SMALL_SHARD_BYTES = 16 << 10


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 with shards of 16 kB: all documents, deep directories."""
    return sharding.shards(_table(spark, sf_dir, "documents"), SMALL_SHARD_BYTES).select("doc_id", "size", "shard", F.col("depth").cast("int").alias("depth"))


def queries() -> dict:
    own = [sharding_small_limit, op1_decontaminate, op2_quality_rules, op3_substring_dedup, op4_line_dedup, op5_chat_format, op6_source_mixing, op7_language_id, op8_lm_scoring, op9_simhash, op10_sharding]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": sql.OP2, "op3_substring_dedup": sql.OP3, "op4_line_dedup": sql.OP4, "op5_chat_format": sql.OP5, "op6_source_mixing": sql.OP6, "op10_sharding": sql.OP10, "sharding_small_limit": sql.sharding_sql(SMALL_SHARD_BYTES)}
