import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import decode, scalars
from rangeloom.model import DTYPES
from rangeloom.sources import header, listing, safetensors, storage


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    where = tmp_path_factory.mktemp("model")
    draw = np.random.Generator(np.random.PCG64(5))
    files = []
    for k, align in enumerate((8, 4096, 1)):
        tensors = {f"{k}.{kind}": (kind, (2, 3, 4), draw.integers(0, 256, 24 * w // p, dtype=np.uint8).tobytes()) for kind, (w, p) in DTYPES.items() if kind != "BOOL"}
        tensors |= {f"{k}.empty": ("F32", (0, 2), b""), f"{k}.scalar": ("I64", (), bytes(8)), f"{k}.big": ("U8", (70_001,), draw.integers(0, 256, 70_001, dtype=np.uint8).tobytes())}
        header.write(str(where / f"part-{k}.safetensors"), tensors, align, {"a": "b"})
        files.append(tensors)
    return str(where), {n: t for f in files for n, t in f.items()}


@pytest.mark.parametrize("policy", ["spans", "chunks", "files"])
@pytest.mark.parametrize("chunk", [1, 100_000])
def test_scan_gives_every_byte(spark, model, policy, chunk):
    where, expected = model
    rows = safetensors.scan(spark, where, partitionPolicy=policy, chunkBytes=chunk, numPartitions=5).select("name", "dtype", "shape", "data").collect()
    assert {r.name: (r.dtype, tuple(r["shape"]), bytes(r.data)) for r in rows} == expected and len(rows) == len(expected)


def test_blocks_join_to_tensors(spark, model):
    where, expected = model
    rows = safetensors.scan(spark, where, blockBytes=1000).select("name", "block_index", "block").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.name, r.block_index)):
        got[r.name] = got.get(r.name, b"") + bytes(r.block)
    assert got == {n: t[2] for n, t in expected.items()}


def test_pushdown_and_metadata(spark, model):
    where, expected = model
    df = safetensors.scan(spark, where, withData=False)
    assert "data" not in df.columns and df.count() == len(expected)
    few = df.where(F.col("name").isin("0.F32", "2.empty"))
    assert sorted(r.name for r in few.collect()) == ["0.F32", "2.empty"]
    assert "PushedFilters" in few._jdf.queryExecution().toString() or few.count() == 2
    assert df.where(F.col("name") == "1.F4").first().storage_shape == [2, 3, 2]
    assert safetensors.scan(spark, where, names=["0.F32"]).count() == 1
    for bad in ([], ["lost"]):
        with pytest.raises(Exception):
            safetensors.scan(spark, where, names=bad or "[]").count()


def test_decoding_is_exact(spark, model):
    where, expected = model
    df = safetensors.scan(spark, where)
    for kind in ("F64", "F32", "F16", "I8", "U32"):
        row = df.where(F.col("name") == f"0.{kind}").select(decode.decode_double("data", "dtype").alias("v")).first()
        np.testing.assert_array_equal(np.array(row.v), decode.values_of(expected[f"0.{kind}"][2], kind).astype(np.float64))
    row = decode.decode_unsigned(df.where(F.col("name") == "0.U64")).first()
    assert [int(x) for x in row["values"]] == np.frombuffer(expected["0.U64"][2], "<u8").tolist()
    signed = decode.decode_unsigned(df.where(F.col("name") == "0.I8").withColumn("data", F.when(F.col("dtype") == "I8", F.col("data")))).first()
    assert [int(x) for x in signed["values"]] == np.frombuffer(expected["0.I8"][2], "i1").tolist()
    row = decode.decode_complex(df.where(F.col("name") == "0.C64")).first()
    np.testing.assert_array_equal(np.array([complex(x.re, x.im) for x in row["values"]], "<c8"), np.frombuffer(expected["0.C64"][2], "<c8"))
    some = df.where(F.col("name").isin("0.C64", "0.empty", "1.C64")).withColumn("dtype", F.lit("C64")).withColumn("data", F.when(F.col("name") != "1.C64", F.col("data")))
    assert {r.name: r["values"] and len(r["values"]) for r in decode.decode_complex(some).collect()} == {"0.C64": 24, "0.empty": [], "1.C64": None}


def test_small_floats():
    assert decode.E4M3[[0x00, 0x38, 0x7E, 0x08, 0x01]].tolist() == [0.0, 1.0, 448.0, 2**-6, 2**-9] and np.isnan(decode.E4M3[0x7F])
    assert decode.E5M2[[0x3C, 0x7B, 0x7C, 0xFC]].tolist() == [1.0, 57344.0, np.inf, -np.inf] and np.isnan(decode.E5M2[0x7D])
    assert decode.E8M0[127] == 1 and np.isnan(decode.E8M0[255])
    assert decode.values_of(b"\x80\x3f", "BF16").tolist() == [1.0]


def raw(entries, data=b"", length=None):
    text = entries if isinstance(entries, bytes) else json.dumps(entries).encode()
    return struct.pack("<Q", len(text) if length is None else length) + text + data


def one(start, end, shape=(4,), kind="U8"):
    return {"dtype": kind, "shape": list(shape), "data_offsets": [start, end]}


BAD = {
    "short": b"123",
    "header of": raw({}, length=(100 << 20) + 1),
    "not UTF-8 JSON": raw(b"{bad"),
    "cut off": raw({}, length=50),
    "no data_offsets": raw({"a": {"dtype": "U8", "shape": []}}),
    "unsupported dtype": raw({"a": one(0, 4, kind="X9")}, bytes(4)),
    "has 4 bytes": raw({"a": one(0, 4, (5,))}, bytes(4)),
    "starts late": raw({"a": one(1, 5)}, bytes(5)),
    "an overlap": raw({"a": one(0, 4), "b": one(3, 7)}, bytes(7)),
    "a hole": raw({"a": one(0, 4), "b": one(5, 9)}, bytes(9)),
    "ends before": raw({"a": one(4, 0)}, bytes(4)),
    "multiple of 2": raw({"a": one(0, 2, (3,), "F4")}, bytes(2)),
    "declares": raw({"a": one(0, 4)}, bytes(5)),
}


@pytest.mark.parametrize("why", BAD)
def test_bad_files_are_refused(tmp_path, why):
    path = tmp_path / "x.safetensors"
    path.write_bytes(BAD[why])
    data = BAD[why]
    with pytest.raises(ValueError, match=why):
        header.read_header(lambda o, n: data[o : o + n], str(path), len(data))


def test_excluded_tensors_are_checked_too(spark, tmp_path):
    (tmp_path / "x.safetensors").write_bytes(BAD["a hole"])
    with pytest.raises(Exception, match="a hole"):
        safetensors.scan(spark, str(tmp_path / "x.safetensors"), names=["a"]).count()


def test_empty_before_full_at_one_place():
    data = raw({"b": one(0, 4), "a": one(0, 0, (0, 9)), "c": one(4, 4, (0,))}, bytes(4))
    assert [t.name for t in header.read_header(lambda o, n: data[o : o + n], "x", len(data))[1]] == ["a", "b", "c"]


def test_read_ranges(spark, tmp_path):
    data = np.arange(5000, dtype="<u4").tobytes()
    (tmp_path / "f").write_bytes(data)
    rows = [(0, str(tmp_path / "f"), i, o, n) for i, (o, n) in enumerate([(400, 8), (0, 0), (0, 20000), (400, 8), (19999, 1)])]
    df = spark.createDataFrame(rows, "file_id int, path string, range_index int, offset bigint, size bigint")
    assert {r.range_index: bytes(r.data) for r in safetensors.read_ranges(df).collect()} == {i: data[o : o + n] for _, _, i, o, n in rows}
    with pytest.raises(Exception, match="EOFError"):
        safetensors.read_ranges(df.withColumn("offset", F.lit(19_999))).collect()


def test_listing_and_pull(spark, tmp_path):
    source, to = tmp_path / "from", tmp_path / "to"
    for name in ("a.safetensors", "b.json", "sub/c.safetensors", "sub/d.pt"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(name)
    names = lambda df: sorted(r.path.split("/from/")[1] for r in df.collect())
    assert names(listing.list_files(spark, str(source))) == ["a.safetensors", "b.json", "sub/c.safetensors", "sub/d.pt"]
    assert names(listing.list_files(spark, str(source), recursive=False)) == ["a.safetensors", "b.json"]
    assert names(listing.list_files(spark, str(source), allow=["*.safetensors", "*.pt"], ignore=["*/sub/*pt"])) == ["a.safetensors", "sub/c.safetensors"]
    assert names(listing.list_files(spark, str(source), allow=[])) == []
    assert names(listing.list_safetensors(spark, str(source))) == ["a.safetensors"]
    with pytest.raises(Exception):
        listing.list_files(spark, str(tmp_path / "none")).count()
    with pytest.raises(NotImplementedError):
        listing.pull_files(spark, str(source), str(to))
    with pytest.raises(FileNotFoundError):
        listing.pull_files(spark, str(source), str(to), allow=["*.none"], from_local=True)
    assert not os.path.exists(to / "_SUCCESS")
    assert listing.pull_files(spark, str(source), str(to), ignore=["*.pt"], from_local=True).count() == 3
    assert (to / "sub/c.safetensors").read_text() == "sub/c.safetensors" and os.path.exists(to / "_SUCCESS")
    assert listing.pull_files(spark, str(source), str(to), from_local=True).count() == 0
    with pytest.raises(ValueError, match="leads out"):
        listing.safe_destination(str(to), "../x")
    with pytest.raises(ValueError, match="locked to a single"):
        listing.one_backend(spark.createDataFrame([("s3://a/b",), ("gs://a/b",)], "path string"))


def test_written_checkpoint_reads_back(spark, model, tmp_path):
    where, expected = model
    rows = safetensors.scan(spark, where).where("name <> '0.empty'").select(F.concat("dtype", F.lit(".safetensors")).alias("file"), "name", "dtype", "shape", "data")
    made = safetensors.write(rows.repartition(7), str(tmp_path / "out"), 64).collect()
    assert {r.file for r in made} == {f"{t[0]}.safetensors" for t in expected.values()} == set(os.listdir(tmp_path / "out"))
    back = safetensors.scan(spark, str(tmp_path / "out")).select("name", "dtype", "shape", "data", "file_offset", "data_start").collect()
    assert {r.name: (r.dtype, tuple(r["shape"]), bytes(r.data)) for r in back} == {n: t for n, t in expected.items() if n != "0.empty"}
    assert {(r.file_offset - r.data_start) % 64 for r in back} == {0}


def test_backends_are_not_mixed(spark):
    with pytest.raises(ValueError, match="locked to a single"):
        safetensors.scan(spark, ["s3://a/b.safetensors", "gs://a/b.safetensors"])


def test_failed_chunks_are_tried_again_then_leave_as_access_errors(monkeypatch):
    class Flaky:
        def __init__(self, failures):
            self.failures, self.tries = failures, 0

        def open_input_file(self, path):
            return self

        def read_at(self, size, offset):
            self.tries += 1
            if self.tries <= self.failures:
                raise OSError("gone")
            return bytes(range(offset, offset + size))

        def close(self):
            pass

    for failures, seconds, fine in ((2, 5, True), (1, 0, False), (10**6, 0.3, False)):
        flaky = Flaky(failures)
        monkeypatch.setattr(storage, "located", lambda path, flaky=flaky: (flaky, path))
        monkeypatch.setattr(storage, "retry_wait", lambda n: 0.01)
        read, _ = storage.reader("x", seconds)
        if fine:
            assert storage.exact(read, 3, 4, "x") == bytes([3, 4, 5, 6]) and flaky.tries == 3
        else:
            with pytest.raises(storage.ReadError) as e:
                read(3, 4)
            assert e.value.code == 2 and (flaky.tries == 1 if not seconds else flaky.tries > 2)


def test_credentials_are_set_once(spark):
    kept = dict(spark.sparkContext.environment)
    system = spark._jsc.hadoopConfiguration()
    try:
        storage.set_credentials(spark, access_key="a", secret_key="b")
        storage.set_credentials(spark, secret_key="b", access_key="a")
        assert system.get("fs.s3a.access.key") == "a" and spark.sparkContext.environment["AWS_SECRET_ACCESS_KEY"] == "b"
        with pytest.raises(PermissionError, match="already set"):
            storage.set_credentials(spark, access_key="a", secret_key="c")
        with pytest.raises(ValueError):
            storage.set_credentials(spark, password="x")
    finally:
        spark.sparkContext.environment.clear()
        spark.sparkContext.environment.update(kept)
        for name in ("rangeloom.credentials", "fs.s3a.access.key", "fs.s3a.secret.key"):
            system.unset(name)
        for name in ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY"):
            os.environ.pop(name, None)


def test_readers_of_a_pull_wait_for_no_reader(tmp_path):
    with pytest.raises(FileNotFoundError), listing.pulled(str(tmp_path)):
        pass
    (tmp_path / "_SUCCESS").touch()
    with listing.pulled(str(tmp_path)) as a, listing.pulled(str(tmp_path)) as b:
        assert a == b


def test_number_settings():
    assert scalars.number_setting("depth", " 7 ", 1) == 7 and scalars.number_setting("depth", None, 3) == 3
    assert scalars.number_setting("share", "0.5", 1, above=0, most=1, kind=float) == 0.5
    for raw, bounds in (("x", {}), ("", {}), ("0", {"above": 0}), ("3", {"most": 2}), ("-1", {"least": 0}), ("nan", {"least": 0, "kind": float}), ("1.5", {})):
        with pytest.raises(ValueError, match="depth"):
            scalars.number_setting("depth", raw, 1, **bounds)


@pytest.mark.parametrize("pattern", ["*", "*.txt", "a?c", "[!a]*", "[a-c]x", "[", "a[b", "x[]]y", "a.b+c", "*[^x]"])
def test_glob_regex_is_fnmatch(spark, pattern):
    from fnmatch import fnmatchcase

    words = ["", "a", "abc", "a/c", "ax", "bx", "x.txt", "q/x.txt", "[", "a[b", "x]y", "a.b+c", "a.b\nc", "zz^", "zzx"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").where(scalars.matches_any(F.col("w"), [pattern]))
    assert sorted(r.w for r in rows.collect()) == sorted(w for w in words if fnmatchcase(w, pattern))


def test_specs():
    assert scalars.parse_queue_depth(" 64 , NFS=32") == (64, [("nfs", 32)])
    for bad in ("", "nfs=2", "64,", "64,=3", "64,nfs=0", "64,nfs=1,NFS=2", "-1"):
        with pytest.raises(ValueError):
            scalars.parse_queue_depth(bad)
    assert scalars.parse_strategies("sync_buffered, libaio_direct") == ["sync_buffered", "libaio_direct"]
    for bad in ("", "x", "sync_buffered,", "sync_buffered,sync_buffered"):
        with pytest.raises(ValueError):
            scalars.parse_strategies(bad)
