import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import decontaminate, langid, mixing, sharding
from test_deduplication import grouped, own_fingerprint


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]


def test_language_stage_drops_only_texts_without_a_language(spark, docs, sf):
    odd = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "12 34 !!", None, None, 8)], docs.schema)
    got = pipeline.identify_language(spark, docs.union(odd), sf)
    assert got.columns == list(pipeline.COLUMNS)
    trees = langid.fit(docs.union(odd))
    low = {r.doc_id for r in langid.identified(docs, trees).where((F.col("score") < 0.5) | (F.col("lang_pred") == "und")).collect()}
    assert ids(got) == [i for i in ids(docs) if i not in low] and len(low) <= 0.01 * docs.count()


def test_language_stage_drops_texts_in_no_learned_language(spark, docs, sf):
    draw = random.Random(5)
    odd = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) + "x" for n in (20, 50, 200, 1000) for _ in range(25)]
    odd += ["Это предложение на русском языке, которого модель никогда не видела.", "To jest zdanie w języku polskim, którego model nie zna."]
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    rows = some.union(spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema))
    got = set(ids(pipeline.identify_language(spark, rows, sf)))
    assert max(got) < 10_000
    # Documents stay, also those that nothing was learned from, unless their language isn't recognised.
    named = langid.identified(docs, langid.fit(some)).where((F.col("score") >= 0.5) & (F.col("lang_pred") != "und")).collect()
    assert {r.doc_id for r in named if r.lang_pred == r.lang} <= got <= {r.doc_id for r in named} and len(named) - len(got) <= 0.01 * len(named)


def test_language_stage_learns_from_every_labelled_row(spark, docs, sf):
    """More text in a language than op7's sample holds, and a few of its texts in letters that no other has."""
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=1500)), "en", "s", 1) for i in range(1000)]
    rare = [(2000 + i, "".join(chr(0x4E00 + 100 * i + draw.randrange(100)) for _ in range(300)), "en", "s", 1) for i in range(20)]
    assert sum(len(r[1]) for r in rows) > 1.5 * langid.SAMPLE_BYTES
    both = spark.createDataFrame(rows + rare, docs.schema).repartition(8)
    held = langid.sampled(both).where(F.ascii("text") > 127).count()
    assert held < len(rare)  # a sample of this size leaves some out
    assert ids(pipeline.identify_language(spark, both, sf)) == [r[0] for r in rows + rare]


def test_near_duplicate_stage_keeps_one_of_each(spark, docs, sf):
    rows = docs.collect()
    root = grouped([own_fingerprint(r.text) for r in rows])
    first = {}
    for r, x in zip(rows, root, strict=True):
        first[x] = min(first.get(x, r.doc_id), r.doc_id)
    got = pipeline.near_duplicates(spark, docs, sf)
    assert ids(got) == sorted(first.values()) and got.columns == list(pipeline.COLUMNS)
    assert {(r.doc_id, r.text) for r in got.collect()} <= {(r.doc_id, r.text) for r in rows}


def test_decontamination_stage_keeps_clean_documents(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (t or "").lower()).strip()
    items = [plain(b.text) for b in bench.collect()]
    leaked = {r.doc_id for r in docs.collect() if any(x in plain(r.text) for x in items)}
    got = ids(pipeline.decontaminate_benchmark(spark, docs, sf))
    edited = {r.doc_id for r in decontaminate.leaks(docs, bench).where("edits > 0").collect()}
    assert leaked and not leaked & set(got) and set(ids(docs)) - set(got) <= leaked | edited


def test_mix_stage_repeats_rows(spark, docs, sf):
    got = Counter(ids(pipeline.mix_sources(spark, docs, sf)))
    assert got == Counter({r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies})


def test_shard_stage_places_every_row(spark, docs, sf):
    twice = docs.union(docs.where("doc_id < 10"))
    got = pipeline.shard(spark, twice, sf)
    assert ids(got) == ids(twice)
    size = defaultdict(int)
    for r in got.collect():
        size[r.shard] += len((r.text or "").encode())
    assert max(size.values()) <= sharding.SHARD_BYTES


def test_run_equals_its_stages(spark, docs, sf):
    step = docs
    for _, stage in pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, sf).collect(), stage(spark, step, sf).schema)
    rows = lambda df: sorted(repr(r) for r in df.collect())
    assert rows(pipeline.run(spark, sf)) == rows(step)


def test_odd_documents_pass_all_stages(spark, docs, sf):
    odd = [(None, None, None, None, None), (1, "", None, None, None), (2, " \n ", "xx", "é", 3), (3, "letters in a text", None, None, 1), (3, "letters in a text", None, None, 1), (4, "word " * 50_000, "en", "s", 1), (None, "no id but a text", "en", None, 1)]
    step = spark.createDataFrame(odd, docs.schema)
    for _, stage in pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, sf).collect(), stage(spark, step, sf).schema)
    assert {r.doc_id for r in step.collect()} <= {None, 3, 4}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
