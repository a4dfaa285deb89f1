import numpy as np
import pytest

from rangeloom.api import RangeReader, TensorReader
from rangeloom.operators import checks, responses
from rangeloom.sources import header


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    where = tmp_path_factory.mktemp("api")
    for k in (1, 0):
        header.write(str(where / f"{k}.safetensors"), {f"b{k}": ("F32", (2, 2), np.arange(4, dtype="<f4").tobytes()), f"a{k}": ("I16", (0, 3), b""), f"c{k}": ("F4", (2, 4), b"\x12\x34\x56\x78")})
    return [str(where / "1.safetensors"), str(where / "0.safetensors")]


def test_tensors_come_in_order(spark, files):
    with TensorReader(spark) as r:
        r.stream_files(files)
        got = list(r.get_tensors())
        # In one file an empty tensor keeps its place between its neighbours' bytes.
        assert [n for n, _ in got] == ["b1", "a1", "c1", "b0", "a0", "c0"]
        assert got[0][1].tolist() == [[0, 1], [2, 3]] and got[1][1].shape == (0, 3) and got[2][1].shape == (2, 2)
        r.stream_files(files, distributed=True)
        assert [n for n, _ in r.get_tensors()][0] == "b0"
        r.stream_file(files[0], ["c1"])
        assert [n for n, _ in r.get_tensors()] == ["c1"]
        for bad in ("c1", []):
            with pytest.raises(ValueError):
                r.stream_file(files[0], bad)


def test_path_rewrite(spark, files):
    with TensorReader(spark) as r:
        where = files[0].rsplit("/", 1)[0]
        r.stream_file("s3://bucket/1.safetensors", pathRewrite=f"s3://bucket={where}")
        assert len(list(r.get_tensors())) == 3


def test_range_reader(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(100)))
    rows = [(0, str(tmp_path / "f"), i, o, n) for i, (o, n) in enumerate([(90, 10), (0, 0), (5, 10), (5, 10), (0, 30)])]
    df = spark.createDataFrame(rows, "file_id int, path string, range_index int, offset bigint, size bigint")
    r = RangeReader(spark)
    r.stream_ranges(df)
    assert sorted(r.get_chunks()) == [(0, i, bytes(range(o, o + n))) for _, _, i, o, n in rows]
    assert [(s, [i for _, i, _ in x]) for s, x in r.get_slots(30)] == [(0, [0, 1, 2, 3]), (1, [4])]
    with pytest.raises(Exception):
        r.stream_ranges(df.selectExpr("file_id", "path", "range_index", "-1L as offset", "size"))
        list(r.get_chunks())


def test_checks(spark):
    tensors = spark.createDataFrame([("a", 8, 4, "F32"), ("a", 12, 1, "X"), ("b", 8, 2, "U8")], "path string, file_offset bigint, nbytes bigint, dtype string")
    lengths = spark.createDataFrame([("a", 13), ("b", 11)], "path string, length bigint")
    assert [r.path for r in checks.wrong_lengths(tensors, lengths).collect()] == ["b"]
    assert [r.dtype for r in checks.unknown_dtypes(tensors).collect()] == ["X"]
    a, b = spark.range(3), spark.range(1, 4)
    assert sorted((r.id, r.side) for r in checks.differences(a, b).collect()) == [(0, "predicted"), (3, "found")]


def test_zero_elapsed_has_no_rate(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (2, 3, None)], "submission_id bigint, size bigint, at_ms bigint")
    got = {r.submission_id: tuple(r)[1:] for r in responses.submission_completion(rows).collect()}
    assert got == {1: (0, 10, 0, 0), 2: (1, 0, 0, 0)}
