import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from rangeloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, tables, name):
    same_rows(catalogue.queries()[name](spark, sf), tables, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("rank", range(catalogue.RANKS))
def test_wrong_slots_of_any_rank_surprise(spark, sf, monkeypatch, rank):
    right = catalogue.partition.predicted_slots
    wrong = F.col("slot_id") + F.when(F.col("rank") == rank, 1).otherwise(0)
    monkeypatch.setattr(catalogue.partition, "predicted_slots", lambda *a: right(*a).withColumn("slot_id", wrong))
    assert {r["rank"] for r in catalogue.queries()["slots_as_predicted"](spark, sf).collect() if r.surprises} == {rank}


def test_documents_without_a_source_are_a_file(spark, sf, tables, tmp_path):
    file = tmp_path / "documents.parquet"
    tables.execute(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source) FROM read_parquet('{sf}/documents.parquet')) TO '{file}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{file}')")
    got = catalogue.queries()["contiguous_offsets"](spark, str(tmp_path))
    same_rows(got, con, catalogue.oracle_sql()["contiguous_offsets"])
    assert got.count() == spark.read.parquet(str(file)).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", ["xxhash", "rangeloom.llm", "corpus_pipeline"])
def test_entry_without_the_optional_part(gone):
    """In a fresh interpreter, one module of the optional part or a library of its own can't be imported."""
    import subprocess
    import sys

    from conftest import ROOT

    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql())), "None"]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from rangeloom.session import shared_dir

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_dir(session)
    session.sparkContext.master = "local[4]"
    assert shared_dir(session) == conf["spark.checkpoint.dir"]
