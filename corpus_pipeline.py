"""A corpus pipeline over documents: language, near-duplicates, benchmark leaks, source mix, shards.

Every stage takes null in any column, empty and very long texts, rows that repeat, and an empty table, which stays
empty. Stages read text, doc_id, lang and source alone and give the five columns of documents; what else documents
has, whatever its name, isn't carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import common, decontaminate, langid, mixing, sharding, simhash
from rangeloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose predicted language has a smaller share of the code go.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a clear language stay, unless they cost far more bits a byte in it than the texts it was
    learned from: those are in none of the languages. The trees and what texts cost in them come from every row with a lang;
    where no row has one, only documents without a letter go."""
    ship(spark)
    rows = langid.labelled(docs)
    trees = langid.stored(rows)
    if trees is None:
        return docs.where(docs.text.rlike(r"\p{L}")).select(*COLUMNS)
    limit = F.create_map(*[F.lit(x) for pair in langid.rate_limits(rows, trees).items() for x in pair])
    named = langid.identified(docs, trees, with_rate=True)
    return named.where((named.lang_pred != "und") & (named.score >= MIN_LANGUAGE_SCORE) & (named.rate <= limit[named.lang_pred])).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the one with the smallest doc_id, null after all others; of
    texts with one id the one with the smallest key; of rows that repeat, one. Texts without words are one component."""
    ship(spark)
    return simhash.one_of_each(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go, each row that repeats among them. Null and empty texts
    hold nothing and stay; null and short items are looked for in none."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a document that is not drawn goes. A null source is a source; rows
    of one doc_id share one draw, null ids too; a source whose texts have no word isn't taken."""
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard it belongs to, by the hash of its doc_id (null as 'null'); a text longer than a shard is a shard
    of its own, and rows of one doc_id that no bit tells apart fill numbered pages. A column named shard is replaced."""
    return sharding.with_shards(docs).select(*COLUMNS, "shard")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: Fingerprints and trained models are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
            if before is not None:
                common.discard(before)  # the stage after it is written whole
            before = docs
    return docs
