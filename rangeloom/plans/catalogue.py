"""The catalogue of queries over the operators of this package, each with SQL for an independent engine.

The byte ranges stand in for a checkpoint: one file for each source of documents, one range for each document,
named by doc_id, every sixth empty, 8 bytes of file before the first.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import decode, scalars
from rangeloom.model import INVALID_CODE, MESSAGES
from rangeloom.operators import checks, division, partition, ranges, responses
from rangeloom.plans import ring
from rangeloom.session import shared_dir, ship

RANKS, RING, CAP, CHUNK, BLOCK, WORKERS = 4, 64, 16, 2048, 4096, 7
DEPTHS = "64,nfs=32,fuse=16,nfs4=8"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    from pyspark.sql import Window

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    # Documents without a source are a file of their own, the last one.
    files = docs.select(F.col("source").alias("path")).distinct().withColumn("file_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("path"))) - 1)
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy(F.asc_nulls_last("doc_id"))) - 1
    rows = docs.join(files, F.col("source").eqNullSafe(F.col("path"))).select(
        "file_id", "path", nth.alias("range_index"),
        F.when(F.col("doc_id") % 6 == 0, 0).otherwise(F.col("n_chars")).cast("bigint").alias("size"), F.col("doc_id").alias("name"),
    )
    rows = ranges.contiguous_offsets(rows, 8)
    return rows.where("name % 7 <> 3") if gaps else rows


FIXTURE = """
r0 AS (SELECT (dense_rank() OVER (ORDER BY source) - 1)::INT AS file_id, source AS path, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS range_index,
  (CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars END)::BIGINT AS size, doc_id AS name FROM documents),
r AS (SELECT *, (8 + coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY range_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM r0),
g AS (SELECT * FROM r WHERE name % 7 <> 3),
f AS (SELECT *, (row_number() OVER w - 1)::BIGINT AS ordinal, (coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM r WINDOW w AS (ORDER BY file_id, "offset", size, range_index))"""

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _with(sql: str) -> str:
    return f"WITH RECURSIVE {FIXTURE.strip()}\n{sql}"


# Listing and scalar rules ------------------------------------------------------------------------

ALLOW, IGNORE = ["http://*[0-4]*", "*page*", "https://??????*"], ["*7*", "*/[!a-p]*x"]
_ALLOW = r"(regexp_full_match(url, '(?s)http://.*[0-4].*') OR regexp_full_match(url, '(?s).*page.*') OR regexp_full_match(url, '(?s)https://.......*'))"
_IGNORE = r"(regexp_full_match(url, '(?s).*7.*') OR regexp_full_match(url, '(?s).*/[^a-p].*x'))"
_SLASH = "url NOT LIKE '%/'"


@query("list_allow", f"SELECT page_id, url FROM pages WHERE {_SLASH} AND {_ALLOW}")
def list_allow(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(scalars.allowed(F.col("url"), ALLOW)).select("page_id", "url")


@query("list_ignore", f"SELECT page_id, url FROM pages WHERE {_SLASH} AND NOT {_IGNORE}")
def list_ignore(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(scalars.allowed(F.col("url"), None, IGNORE)).select("page_id", "url")


@query("list_allow_ignore", f"SELECT page_id, url FROM pages WHERE {_SLASH} AND {_ALLOW} AND NOT {_IGNORE}")
def list_allow_ignore(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(scalars.allowed(F.col("url"), ALLOW, IGNORE)).select("page_id", "url")


_URI = r"'^(https?)://([^/]+)/(.+)$'"


@query("uri_parse", f"SELECT page_id, regexp_extract(url, {_URI}, 1) AS scheme, regexp_extract(url, {_URI}, 2) AS host, regexp_extract(url, {_URI}, 3) AS key, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare FROM pages")
def uri_parse(spark, sf_dir):
    scheme, host, key = scalars.uri_parts(F.col("url"), scalars.WEB_URI)
    return _table(spark, sf_dir, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), key.alias("key"), scalars.without_prefix(F.col("url"), "https://").alias("bare"))


@query("scheme_mix", f"SELECT regexp_extract(url, {_URI}, 1) AS scheme, count(*) AS n FROM pages GROUP BY 1")
def scheme_mix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(scalars.uri_parts(F.col("url"), scalars.WEB_URI)[0].alias("scheme")).agg(F.count("*").alias("n"))


@query("padded_cursor", _with('SELECT file_id, range_index, (("offset" + 63) // 64 * 64)::BIGINT AS padded FROM r'))
def padded_cursor(spark, sf_dir):
    return fixture(spark, sf_dir).select("file_id", "range_index", scalars.padded_cursor(F.col("offset"), 64).alias("padded"))


@query("retry_schedule", """SELECT event_id, [0, 100, 200, 400, 800, 1000][least(n, 5) + 1]::BIGINT AS bound_ms, n = 0 OR (t > 0 AND now < t) AS may_begin,
  t > 0 AND now < t AND now + [0, 100, 200, 400, 800, 1000][least(n, 5) + 1] < t AS may_schedule
FROM (SELECT event_id, event_id % 9 AS n, event_id * 37 % 2500 AS now, (event_id % 4) * 700 AS t FROM events) WHERE n > 0""")
def retry_schedule(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("n"), (F.col("event_id") * 37 % 2500).alias("now"), ((F.col("event_id") % 4) * 700).alias("t")).where("n > 0")
    bound = scalars.retry_delay_bound_ms(F.col("n"))
    zero = F.lit(0)
    return e.select("event_id", bound.alias("bound_ms"), scalars.may_begin(F.col("n"), F.col("now"), zero, F.col("t")).alias("may_begin"), scalars.may_schedule(bound, F.col("now"), zero, F.col("t")).alias("may_schedule"))


@query("retryable", """SELECT event_id, CASE WHEN s < 0 THEN NOT fatal WHEN s >= 500 THEN true WHEN s >= 400 THEN s IN (408, 429) ELSE hint END AS retryable
FROM (SELECT event_id, [-1, 200, 301, 400, 404, 408, 429, 500, 503][(event_id % 9 + 1)::INT] AS s, event_id % 5 = 0 AS fatal, event_id % 2 = 0 AS hint FROM events)""")
def retryable(spark, sf_dir):
    status = F.get(F.array(*[F.lit(x) for x in (-1, 200, 301, 400, 404, 408, 429, 500, 503)]), (F.col("event_id") % 9).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", scalars.retryable(status, F.col("event_id") % 5 == 0, F.col("event_id") % 2 == 0).alias("retryable"))


@query("strategy_first_available", """SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 THEN 'io_uring_direct' WHEN event_id % 3 = 0 THEN 'libaio_direct' WHEN event_id % 5 = 0 THEN 'sync_buffered' END AS strategy FROM events""")
def strategy_first_available(spark, sf_dir):
    names = scalars.parse_strategies("io_uring_direct, libaio_direct,sync_buffered")
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(x).alias("name"), F.lit(k).alias("k")) for i, (x, k) in enumerate(zip(names, (2, 3, 5), strict=True))])
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.explode(listed).alias("c"))
    return scalars.first_available(rows.select("request_id", "c.position", "c.name", (F.col("request_id") % F.col("c.k") == 0).alias("available")))


@query("queue_depth_lookup", """SELECT event_id, fs_type, CASE WHEN starts_with(lower(fs_type), 'nfs') THEN 32 WHEN starts_with(lower(fs_type), 'fuse') THEN 16 ELSE 64 END AS depth
FROM (SELECT event_id, ['ext4', 'NFS4', 'nfs', 'fuse.virtiofs', 'xfs', ''][(event_id % 6 + 1)::INT] AS fs_type FROM events)""")
def queue_depth_lookup(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(x) for x in ("ext4", "NFS4", "nfs", "fuse.virtiofs", "xfs", "")]), (F.col("event_id") % 6).cast("int"))
    return scalars.queue_depths(_table(spark, sf_dir, "events").select("event_id", kind.alias("fs_type")), DEPTHS)


_CODES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MESSAGES))


@query("response_code_text", f"SELECT event_id, (event_id % 40 - 5)::INT AS code, coalesce(m.text, '{INVALID_CODE}') AS message FROM events LEFT JOIN (VALUES {_CODES}) AS m(code, text) ON m.code = event_id % 40 - 5")
def response_code_text(spark, sf_dir):
    code = (F.col("event_id") % 40 - 5).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", code.alias("code"), scalars.response_text(code).alias("message"))


# Ranges ------------------------------------------------------------------------------------------


@query("contiguous_offsets", _with('SELECT file_id, range_index, "offset", size FROM r'))
def contiguous_offsets(spark, sf_dir):
    return fixture(spark, sf_dir).select("file_id", "range_index", "offset", "size")


@query("flatten_ordinals", _with("SELECT name, ordinal, start FROM f"))
def flatten_ordinals(spark, sf_dir):
    return ranges.flatten(fixture(spark, sf_dir)).select("name", "ordinal", "start")


_RUNS = """, t AS (SELECT *, coalesce("offset" <> lag("offset" + size) OVER (PARTITION BY file_id ORDER BY range_index), false)::INT AS turn FROM g),
c AS (SELECT *, sum(turn) OVER (PARTITION BY file_id ORDER BY range_index)::BIGINT AS run_id FROM t)
"""


@query("coalesce_runs", _with(_RUNS + "SELECT file_id, range_index, run_id FROM c"))
def coalesce_runs(spark, sf_dir):
    return ranges.coalesce_runs(fixture(spark, sf_dir, True)).select("file_id", "range_index", "run_id")


@query("run_counts", _with(_RUNS + 'SELECT file_id, run_id, min("offset") AS "offset", sum(size)::BIGINT AS bytes, count(*) AS n_ranges FROM c GROUP BY ALL'))
def run_counts(spark, sf_dir):
    return ranges.run_totals(fixture(spark, sf_dir, True))


@query("validate_gaps_overlaps", _with(""", b AS (SELECT file_id, range_index, ("offset" - 8 + CASE WHEN name % 11 = 5 THEN 3 ELSE 0 END)::BIGINT AS "offset", (CASE WHEN name % 13 = 4 THEN size - 2 ELSE size END)::BIGINT AS size FROM r),
l AS (SELECT *, lead("offset") OVER w AS n, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY file_id ORDER BY "offset", size, range_index))
SELECT file_id, range_index, 'negative' AS fault FROM l WHERE size < 0 UNION ALL SELECT file_id, range_index, 'starts late' FROM l WHERE k = 1 AND "offset" <> 0
UNION ALL SELECT file_id, range_index, 'overlap' FROM l WHERE n < "offset" + size UNION ALL SELECT file_id, range_index, 'gap' FROM l WHERE n > "offset" + size"""))
def validate_gaps_overlaps(spark, sf_dir):
    rows = fixture(spark, sf_dir).withColumn("offset", F.col("offset") - 8 + F.when(F.col("name") % 11 == 5, 3).otherwise(0))
    return ranges.layout_faults(rows.withColumn("size", F.when(F.col("name") % 13 == 4, F.col("size") - 2).otherwise(F.col("size"))))


def _labels(spark, sf_dir):
    return _table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("name"))


@query("name_select", _with('SELECT name, file_id, size FROM r WHERE name IN (SELECT doc_id * 2 FROM labels)'))
def name_select(spark, sf_dir):
    return ranges.selected_names(fixture(spark, sf_dir), _labels(spark, sf_dir)).select("name", "file_id", "size")


@query("name_missing", _with("SELECT DISTINCT doc_id * 2 AS name FROM labels WHERE doc_id * 2 NOT IN (SELECT name FROM r)"))
def name_missing(spark, sf_dir):
    return ranges.missing_names(fixture(spark, sf_dir), _labels(spark, sf_dir))


@query("name_duplicate", _with("SELECT name % 333 AS name, count(DISTINCT file_id) AS n_files FROM r WHERE name % 333 IN (SELECT doc_id * 2 FROM labels) GROUP BY 1 HAVING count(DISTINCT file_id) > 1"))
def name_duplicate(spark, sf_dir):
    return ranges.names_in_several_files(fixture(spark, sf_dir).withColumn("name", F.col("name") % 333), _labels(spark, sf_dir))


@query("repeated_file_ids", _with("SELECT file_id, count(*) AS times FROM (SELECT file_id // 2 AS file_id FROM (SELECT DISTINCT file_id FROM r)) GROUP BY 1 HAVING count(*) > 1"))
def repeated_file_ids(spark, sf_dir):
    return ranges.repeated_file_ids(fixture(spark, sf_dir).select("file_id").distinct().select(F.expr("int(file_id div 2)").alias("file_id")))


@query("total_and_largest", _with("SELECT coalesce(sum(size), 0)::BIGINT AS total_bytes, coalesce(max(size), 0) AS largest, count(*) AS n_ranges, greatest(1, count(*)) AS metadata_rows FROM r"))
def total_and_largest(spark, sf_dir):
    return ranges.largest_and_total(fixture(spark, sf_dir))


@query("bytes_per_file", _with("SELECT file_id, path, sum(size)::BIGINT AS bytes, max(size) AS largest, count(*) AS n_ranges FROM r GROUP BY ALL"))
def bytes_per_file(spark, sf_dir):
    return ranges.bytes_per_file(fixture(spark, sf_dir))


# Division ----------------------------------------------------------------------------------------

_SHARES = f"""s AS (SELECT group_id, total, workers, total // {BLOCK} // workers * {BLOCK} AS share, total - (workers - 1) * (total // {BLOCK} // workers * {BLOCK}) AS first_share
  FROM (SELECT *, greatest(least(total // {BLOCK}, {WORKERS}), 1)::BIGINT AS workers FROM (SELECT %s AS group_id, sum(size)::BIGINT AS total FROM r GROUP BY 1)))"""


@query("worker_shares", _with("," + _SHARES % "file_id" + " SELECT group_id, total, workers, share, first_share FROM s"))
def worker_shares(spark, sf_dir):
    return division.worker_shares(fixture(spark, sf_dir), BLOCK, WORKERS, "file_id").select("group_id", "total", "workers", "share", "first_share")


@query("worker_division", _with("," + _SHARES % "0" + """,
w AS (SELECT k AS worker, CASE WHEN k = 0 THEN 0 ELSE first_share + (k - 1) * share END AS lo, first_share + k * share AS hi FROM s, (SELECT unnest(range(0, 64)) AS k) WHERE k < workers)
SELECT name, ordinal, worker, ("offset" + CASE WHEN size = 0 THEN 0 ELSE greatest(start, lo) - start END)::BIGINT AS piece_offset,
  (CASE WHEN size = 0 THEN 0 ELSE least(start + size, hi) - greatest(start, lo) END)::BIGINT AS piece_size
FROM f JOIN w ON CASE WHEN size = 0 THEN (lo < start AND start <= hi) OR (start = 0 AND worker = 0) ELSE start < hi AND lo < start + size END"""))
def worker_division(spark, sf_dir):
    return division.divided(fixture(spark, sf_dir), BLOCK, WORKERS).select("name", "ordinal", "worker", "piece_offset", "piece_size")


@query("worker_division_groups", _with(", " + _SHARES.replace("%s AS group_id", "file_id % 3 AS group_id") + """,
h AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY file_id % 3 ORDER BY file_id, range_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin FROM r),
w AS (SELECT group_id, k AS worker, CASE WHEN k = 0 THEN 0 ELSE first_share + (k - 1) * share END AS lo, first_share + k * share AS hi FROM s, (SELECT unnest(range(0, 64)) AS k) WHERE k < workers)
SELECT name, group_id::INT AS pool, worker, (CASE WHEN size = 0 THEN 0 ELSE least(begin + size, hi) - greatest(begin, lo) END)::BIGINT AS piece_size
FROM h JOIN w ON group_id = file_id % 3 AND CASE WHEN size = 0 THEN (lo < begin AND begin <= hi) OR (begin = 0 AND worker = 0) ELSE begin < hi AND lo < begin + size END"""))
def worker_division_groups(spark, sf_dir):
    rows = fixture(spark, sf_dir).withColumn("pool", F.col("file_id") % 3)
    return division.divided(rows, BLOCK, WORKERS, "pool").select("name", "pool", "worker", "piece_size")


_TASKS = f""", k AS (SELECT *, unnest(range("offset" // {CHUNK}, greatest("offset" + size - 1, "offset") // {CHUNK} + 1)) AS block FROM g),
t AS (SELECT file_id, range_index, block, greatest("offset", block * {CHUNK}) AS task_offset, (least("offset" + size, (block + 1) * {CHUNK}) - greatest("offset", block * {CHUNK}))::BIGINT AS task_size FROM k)
"""


@query("task_cuts", _with(_TASKS + "SELECT * FROM t"))
def task_cuts(spark, sf_dir):
    return division.task_cuts(fixture(spark, sf_dir, True), CHUNK).select("file_id", "range_index", "block", "task_offset", "task_size")


@query("chunk_groups", _with(_TASKS + """, u AS (SELECT *, coalesce(task_offset <> lag(task_offset + task_size) OVER (PARTITION BY file_id, block ORDER BY range_index, task_offset), false)::INT AS turn FROM t),
v AS (SELECT *, sum(turn) OVER (PARTITION BY file_id, block ORDER BY range_index, task_offset) AS part FROM u)
SELECT file_id, block, min(task_offset) AS chunk_offset, sum(task_size)::BIGINT AS chunk_bytes, count(*) AS n_tasks FROM v GROUP BY file_id, block, part HAVING sum(task_size) > 0"""))
def chunk_groups(spark, sf_dir):
    return division.chunk_groups(fixture(spark, sf_dir, True), CHUNK)


# Partition and packing ---------------------------------------------------------------------------

_SLOT = f"slot AS (SELECT greatest(max(size), sum(size) // {RING})::BIGINT AS b FROM r)"
_WALK = f", {_SLOT}" + """, walk AS (SELECT ordinal, 0 AS slot_id, size AS used, 1 AS n, 0::BIGINT AS slot_offset FROM f WHERE ordinal = 0
UNION ALL SELECT f.ordinal, CASE WHEN used + f.size > b OR n >= {cap} THEN slot_id + 1 ELSE slot_id END, CASE WHEN used + f.size > b OR n >= {cap} THEN f.size ELSE used + f.size END,
  CASE WHEN used + f.size > b OR n >= {cap} THEN 1 ELSE n + 1 END, CASE WHEN used + f.size > b OR n >= {cap} THEN 0 ELSE used END FROM walk JOIN f ON f.ordinal = walk.ordinal + 1, slot)
"""


def _slot(rows: DataFrame) -> int:
    """The slots of a ring of RING for these ranges: each holds the largest."""
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    return ring.even_slot(total, largest, RING)


@query("slots_nextfit", _with(_WALK.format(cap=1 << 60) + "SELECT ordinal, slot_id::INT AS slot_id, slot_offset::BIGINT AS slot_offset FROM walk"))
def slots_nextfit(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    return partition.packed(ranges.flatten(rows), _slot(rows)).select("ordinal", "slot_id", "slot_offset")


@query("slots_row_cap", _with(_WALK.format(cap=CAP) + "SELECT ordinal, slot_id::INT AS slot_id, slot_offset::BIGINT AS slot_offset FROM walk"))
def slots_row_cap(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    return partition.packed(ranges.flatten(rows), _slot(rows), CAP).select("ordinal", "slot_id", "slot_offset")


@query("slot_fill", _with(_WALK.format(cap=1 << 60) + ", e AS (SELECT slot_id, max(used) AS taken, count(*) AS n FROM walk GROUP BY 1) SELECT count(*) AS n_slots, sum(taken)::BIGINT AS bytes, max(n) AS widest, round(sum(taken) / (count(*) * max(b)), 6)::DOUBLE AS fill FROM e, slot"))
def slot_fill(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    slot = _slot(rows)
    return partition.slot_fill(partition.packed(ranges.flatten(rows), slot), slot)


def _least_loaded(items: str) -> str:
    """Largest first to the least loaded of four, as a recursion over items(key, size, place)."""
    pick = "CASE WHEN l0 <= l1 AND l0 <= l2 AND l0 <= l3 THEN 0 WHEN l1 <= l2 AND l1 <= l3 THEN 1 WHEN l2 <= l3 THEN 2 ELSE 3 END"
    loads = ", ".join(f"l{i} + CASE WHEN {pick} = {i} THEN o.size ELSE 0 END" for i in range(4))
    return f""", items AS ({items}), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, place) AS k FROM items),
lpt AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS key, -1 AS rank, 0::BIGINT AS l0, 0::BIGINT AS l1, 0::BIGINT AS l2, 0::BIGINT AS l3
UNION ALL SELECT o.k, o.key, {pick}, {loads} FROM lpt JOIN o ON o.k = lpt.k + 1)
"""


@query("partition_files", _with(_least_loaded("SELECT file_id::BIGINT AS key, sum(size)::BIGINT AS size, file_id AS place FROM r GROUP BY file_id") + "SELECT name, rank::INT AS rank FROM r JOIN lpt ON lpt.key = file_id"))
def partition_files(spark, sf_dir):
    return partition.partitioned(fixture(spark, sf_dir), RANKS, "files").select("name", "rank")


@query("partition_chunks", _with(_least_loaded("SELECT name AS key, size, file_id * 1000000::BIGINT + range_index AS place FROM r") + "SELECT key AS name, rank::INT AS rank FROM lpt WHERE k > 0"))
def partition_chunks(spark, sf_dir):
    return partition.partitioned(fixture(spark, sf_dir), RANKS, "chunks").select("name", "rank")


_SPANS = """, p AS (SELECT ordinal AS i, start AS p FROM f UNION ALL SELECT count(*), sum(size)::BIGINT FROM r),
d2 AS (SELECT b.i, b.p, min(greatest(a.p, b.p - a.p)) AS d FROM p a JOIN p b ON a.i <= b.i GROUP BY ALL),
d3 AS (SELECT b.i, b.p, min(greatest(a.d, b.p - a.p)) AS d FROM d2 a JOIN p b ON a.i <= b.i GROUP BY ALL),
d4 AS (SELECT min(greatest(a.d, b.p - a.p)) AS d FROM d3 a JOIN (SELECT * FROM p ORDER BY i DESC LIMIT 1) b ON true),
c1 AS (SELECT max(i) AS i, max(p.p) AS p FROM p, d4 WHERE p.p <= d), c2 AS (SELECT max(p.i) AS i, max(p.p) AS p FROM p, d4, c1 WHERE p.p <= c1.p + d), c3 AS (SELECT max(p.i) AS i FROM p, d4, c2 WHERE p.p <= c2.p + d),
x AS (SELECT f.*, CASE WHEN ordinal < c1.i THEN 0 WHEN ordinal < c2.i THEN 1 WHEN ordinal < c3.i THEN 2 ELSE 3 END AS rank FROM f, c1, c2, c3)
"""


@query("partition_spans", _with(_SPANS + "SELECT name, rank::INT AS rank FROM x"))
def partition_spans(spark, sf_dir):
    return partition.partitioned(fixture(spark, sf_dir), RANKS).select("name", "rank")


@query("rank_bytes", _with(_SPANS + """, y AS (SELECT *, coalesce("offset" = lag("offset" + size) OVER (PARTITION BY rank, file_id ORDER BY "offset", size, range_index), false) AS same FROM x)
SELECT k::INT AS rank, coalesce(sum(size), 0)::BIGINT AS bytes, count(name) AS n_ranges, (count(name) FILTER (WHERE NOT same))::BIGINT AS runs FROM (SELECT unnest(range(0, 4)) AS k) LEFT JOIN y ON y.rank = k GROUP BY 1"""))
def rank_bytes(spark, sf_dir):
    return partition.rank_bytes(partition.partitioned(fixture(spark, sf_dir), RANKS), RANKS)


@query("rank_runs", _with(_SPANS + """, y AS (SELECT *, coalesce(path <> lag(path) OVER (PARTITION BY rank ORDER BY ordinal), false)::INT AS turn FROM x),
z AS (SELECT *, sum(turn) OVER (PARTITION BY rank ORDER BY ordinal)::BIGINT AS chunk_id FROM y)
SELECT name, rank::INT AS rank, chunk_id, (row_number() OVER (PARTITION BY rank, chunk_id ORDER BY ordinal) - 1)::BIGINT AS chunk_index FROM z"""))
def rank_runs(spark, sf_dir):
    return ranges.rebuilt_files(partition.partitioned(fixture(spark, sf_dir), RANKS)).select("name", "rank", "chunk_id", "chunk_index")


@query("rank_share", _with(_SPANS + "SELECT name, size FROM x WHERE rank = 2"))
def rank_share(spark, sf_dir):
    return partition.share_of(fixture(spark, sf_dir), RANKS, 2).select("name", "size")


_RANK_WALK = f", {_SLOT}" + """, walk AS (SELECT rank, ordinal, 0 AS slot_id, size AS used, 0::BIGINT AS slot_offset FROM x WHERE ordinal IN (SELECT min(ordinal) FROM x GROUP BY rank)
UNION ALL SELECT x.rank, x.ordinal, CASE WHEN used + x.size > b THEN slot_id + 1 ELSE slot_id END, CASE WHEN used + x.size > b THEN x.size ELSE used + x.size END, CASE WHEN used + x.size > b THEN 0 ELSE used END
  FROM walk JOIN x ON x.ordinal = walk.ordinal + 1 AND x.rank = walk.rank, slot)
"""


@query("predicted_slots", _with(_SPANS + _RANK_WALK + "SELECT name, walk.rank::INT AS rank, slot_id::INT AS slot_id, slot_offset::BIGINT AS slot_offset FROM walk JOIN x USING (ordinal)"))
def predicted_slots(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    return partition.predicted_slots(rows, RANKS, _slot(rows)).select("name", "rank", "slot_id", "slot_offset")


@query("broadcast_delivery", _with(_SPANS + "SELECT name, rank::INT AS from_rank, k::INT AS to_rank FROM x, (SELECT unnest(range(0, 4)) AS k)"))
def broadcast_delivery(spark, sf_dir):
    return partition.delivered(partition.partitioned(fixture(spark, sf_dir), RANKS), RANKS).select("name", "from_rank", "to_rank")


# Responses ---------------------------------------------------------------------------------------


@query("response_completion", """SELECT event_id // 8 AS request_id, count(*) AS n_tasks, count(code) AS n_done, coalesce(arg_max(code, event_id) FILTER (WHERE code <> 0), 0)::INT AS code, count(*) = count(code) AS finished
FROM (SELECT event_id, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 19 = 0 THEN 3 ELSE 0 END AS code FROM events) GROUP BY 1""")
def response_completion(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 53 == 0, None).when(e % 17 == 0, 2).when(e % 19 == 0, 3).otherwise(0)
    return responses.request_completion(_table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("request_id"), e.alias("event_seq"), code.alias("code")))


@query("submission_completion", """SELECT user_id AS submission_id, count(*) - count(at_ms) AS remaining, coalesce(sum(size) FILTER (WHERE at_ms IS NOT NULL), 0)::BIGINT AS bytes, coalesce(max(at_ms) - min(at_ms), 0) AS elapsed_ms,
  CASE WHEN coalesce(max(at_ms) - min(at_ms), 0) = 0 THEN 0 ELSE (coalesce(sum(size) FILTER (WHERE at_ms IS NOT NULL), 0) * 1000 // (max(at_ms) - min(at_ms))) END::BIGINT AS bytes_per_s
FROM (SELECT user_id, event_id % 1000 AS size, CASE WHEN event_id % 29 <> 0 THEN epoch_us(ts) // 1000 END AS at_ms FROM events) GROUP BY 1""")
def submission_completion(spark, sf_dir):
    at = F.when(F.col("event_id") % 29 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return responses.submission_completion(_table(spark, sf_dir, "events").select(F.col("user_id").alias("submission_id"), (F.col("event_id") % 1000).alias("size"), at.alias("at_ms")))


@query("session_throughput", """SELECT coalesce(sum(size) FILTER (WHERE at_ms IS NOT NULL), 0)::BIGINT AS bytes, max(at_ms) - min(at_ms) AS elapsed_ms, (sum(size) FILTER (WHERE at_ms IS NOT NULL) * 1000 // (max(at_ms) - min(at_ms)))::BIGINT AS bytes_per_s
FROM (SELECT event_id % 1000 AS size, CASE WHEN event_id % 29 <> 0 THEN epoch_us(ts) // 1000 END AS at_ms FROM events)""")
def session_throughput(spark, sf_dir):
    at = F.when(F.col("event_id") % 29 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return responses.session_throughput(_table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("size"), at.alias("at_ms")))


@query("group_agreement", _with("SELECT min(n) AS least, max(n) AS most, min(n) = max(n) AS agree FROM (SELECT count(*) AS n FROM r GROUP BY file_id)"))
def group_agreement(spark, sf_dir):
    return responses.all_agree(ranges.bytes_per_file(fixture(spark, sf_dir)), "n_ranges")


@query("assigned_bytes", _with("SELECT 'chunks' AS policy, sum(size)::BIGINT AS asked, sum(size)::BIGINT AS given, count(*) AS n_asked, count(*) AS n_given FROM r"))
def assigned_bytes(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    return checks.conserved(rows, partition.partitioned(rows, RANKS, "chunks")).withColumn("policy", F.lit("chunks"))


@query("assigned_bytes_by_policy", _with("SELECT policy, sum(size)::BIGINT AS asked, sum(size)::BIGINT AS given, count(*) AS n_asked, count(*) AS n_given FROM r, (VALUES ('spans'), ('chunks'), ('files')) p(policy) GROUP BY 1"))
def assigned_bytes_by_policy(spark, sf_dir):
    rows = fixture(spark, sf_dir)
    return functools.reduce(DataFrame.union, [checks.conserved(rows, partition.partitioned(rows, RANKS, x)).withColumn("policy", F.lit(x)) for x in partition.POLICIES])


@query("slots_as_predicted", _with(_SPANS + _RANK_WALK + "SELECT rank::INT AS rank, count(DISTINCT slot_id) AS n_slots, sum(size)::BIGINT AS bytes, 0::BIGINT AS surprises FROM walk JOIN x USING (rank, ordinal) GROUP BY 1"))
def slots_as_predicted(spark, sf_dir):
    """What each rank's own packing of its share holds, and how many of its ranges lie elsewhere than predicted."""
    rows = fixture(spark, sf_dir)
    slot = _slot(rows)
    columns = ("rank", "name", "size", "slot_id", "slot_offset")
    said = partition.predicted_slots(rows, RANKS, slot).select(*columns)
    where = f"{shared_dir(spark)}/shares-{uuid.uuid4().hex}"
    partition.partitioned(rows, RANKS).drop("ordinal", "start").write.parquet(where)  # planned once, packed by each rank
    shares = [spark.read.parquet(where).where(F.col("rank") == k) for k in range(RANKS)]
    own = functools.reduce(DataFrame.union, [partition.packed(ranges.flatten(share), slot).select(*columns) for share in shares])
    wrong = checks.differences(said, own).groupBy("rank").agg(F.count("*").alias("n"))
    held = own.groupBy("rank").agg(F.countDistinct("slot_id").alias("n_slots"), F.sum("size").alias("bytes"))
    return held.join(wrong, "rank", "left").select("rank", "n_slots", "bytes", F.coalesce("n", F.lit(0)).alias("surprises"))


@query("error_attribution", """WITH t AS (SELECT event_id // 40 AS workload_id, event_id // 8 % 3 AS file_id, event_id AS range_index, event_id * 7919 % 10007 AS event_seq, CASE WHEN event_id % 23 = 0 THEN 19 WHEN event_id % 31 = 0 THEN 3 WHEN event_id % 7 < 2 THEN NULL ELSE 0 END AS code FROM events),
f AS (SELECT workload_id, file_id, arg_min(code, event_seq) AS error FROM t WHERE code <> 0 GROUP BY ALL)
SELECT workload_id, file_id, range_index, (CASE WHEN code = 0 THEN 0 WHEN error = 19 THEN 2 ELSE error END)::INT AS code FROM t LEFT JOIN f USING (workload_id, file_id)""")
def error_attribution(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 23 == 0, 19).when(e % 31 == 0, 3).when(e % 7 < 2, None).otherwise(0)
    rows = _table(spark, sf_dir, "events").select(F.expr("event_id div 40").alias("workload_id"), F.expr("event_id div 8 % 3").alias("file_id"), e.alias("range_index"), (e * 7919 % 10007).alias("event_seq"), code.alias("code"))
    return responses.attributed_errors(rows)


def _arrivals(spark, sf_dir) -> DataFrame:
    """Streams of 1,000 events; arrival order is a fixed shuffle within a stream."""
    from pyspark.sql import Window

    order = Window.partitionBy("stream").orderBy((F.col("event_id") * 7919) % 10007, "event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 1000").alias("stream"), F.expr("event_id % 1000").alias("ordinal"), "value")
    return rows.withColumn("arrival_seq", F.row_number().over(order).cast("bigint"))


_ARRIVALS = "a AS (SELECT event_id, event_id // 1000 AS stream, event_id % 1000 AS ordinal, value, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY (event_id * 7919) % 10007, event_id) AS arrival_seq FROM events)"


@query("reorder_batch", f"WITH {_ARRIVALS} SELECT stream, ordinal, arrival_seq, max(arrival_seq) OVER (PARTITION BY stream ORDER BY ordinal) AS emit_at FROM a")
def reorder_batch(spark, sf_dir):
    return responses.ordered_yield(_arrivals(spark, sf_dir), "stream").select("stream", "ordinal", "arrival_seq", "emit_at")


@query("unordered_arrival", f"WITH {_ARRIVALS} SELECT event_id, stream, arrival_seq FROM a")
def unordered_arrival(spark, sf_dir):
    return _arrivals(spark, sf_dir).select("event_id", "stream", "arrival_seq")


@query("stray_responses", """SELECT event_id, submission_id, 'unknown submission' AS reason FROM (SELECT event_id, event_id % 50 AS submission_id FROM events) WHERE submission_id >= 45
UNION ALL SELECT event_id, submission_id, 'delivered before' FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, range_index ORDER BY event_id) AS k FROM (SELECT event_id, event_id % 50 AS submission_id, event_id // 50 % 150 AS range_index FROM events)) WHERE k > 1 AND submission_id < 45""")
def stray_responses(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id"), F.col("event_id").alias("event_seq"), (F.col("event_id") % 50).alias("submission_id"), F.lit(0).alias("file_index"), F.expr("event_id div 50 % 150").alias("range_index"))
    return responses.stray_responses(rows, spark.range(45).select(F.col("id").alias("submission_id"))).select("event_id", "submission_id", "reason")


@query("late_completions", "SELECT event_id, event_id % 50 AS submission_id FROM events WHERE event_id % 50 < 45")
def late_completions(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("submission_id"))
    return responses.live_only(rows, spark.range(45).select(F.col("id").alias("submission_id"))).select("event_id", "submission_id")


@query("global_ids", "SELECT event_id, event_id % 4 * 10 + event_id % 3 AS file_id, event_id % 4 * 100 + event_id % 7 AS global_range FROM events")
def global_ids(spark, sf_dir):
    e = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", (e % 4).alias("submission_id"), (e % 3).alias("file_index"), (e % 7).alias("range_index"))
    i = F.col("id")
    requests = spark.range(12).select((i % 4).alias("submission_id"), F.expr("id div 4").alias("file_index"), ((i % 4) * 10 + F.expr("id div 4")).alias("file_id"), ((i % 4) * 100).alias("range_base"))
    return responses.to_global(rows, requests).select("event_id", "file_id", "global_range")


def _stream(spark, rows: DataFrame, operate, out: str, parts: int = 4) -> DataFrame:
    """operate over rows as a stream of parts files, one for each micro-batch; what it gives, from the shared folder."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(parts, "arrival_seq").sortWithinPartitions("arrival_seq").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = operate(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out).parquet(f"{base}/out")


@query("reorder_stream", f"WITH {_ARRIVALS} SELECT stream, ordinal, value FROM a")
def reorder_stream(spark, sf_dir):
    from rangeloom.streaming import reorder

    return _stream(spark, _arrivals(spark, sf_dir).select("stream", "ordinal", "value", "arrival_seq"), reorder.reordered, reorder.ORDERED)


@query("completion_stream", f"WITH {_ARRIVALS} SELECT stream AS submission_id, count(*) AS n_ranges, sum(ordinal)::BIGINT AS bytes, false AS timed_out FROM a GROUP BY 1 HAVING count(*) = 1000")
def completion_stream(spark, sf_dir):
    from rangeloom.streaming import reorder

    rows = _arrivals(spark, sf_dir).select(F.col("stream").alias("submission_id"), F.col("ordinal").alias("range_id"), F.col("ordinal").alias("size"), F.lit(1000).cast("bigint").alias("expected"), "arrival_seq")
    again = rows.where("range_id % 7 = 0").withColumn("arrival_seq", F.col("arrival_seq") + 1)  # answers that come twice count once
    return _stream(spark, rows.union(again), reorder.completions, reorder.COMPLETED)


@query("once_stream", "SELECT DISTINCT event_id % 50 AS submission_id, event_id // 50 % 10 AS file_index, event_id // 50 % 15 AS range_index FROM events")
def once_stream(spark, sf_dir):
    from rangeloom.streaming import reorder

    rows = _table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).alias("submission_id"), F.expr("event_id div 50 % 10").alias("file_index"), F.expr("event_id div 50 % 15").alias("range_index"),
        F.col("ts").cast("timestamp").alias("arrival"), F.col("event_id").alias("arrival_seq"),
    )
    span = rows.agg(F.expr("unix_seconds(max(arrival)) - unix_seconds(min(arrival))")).first()[0] or 0  # the log is replayed in any order
    keys = ["submission_id", "file_index", "range_index"]
    return _stream(spark, rows, lambda s: reorder.once_each(s, "arrival", f"{span + 1} seconds").select(*keys), "submission_id bigint, file_index bigint, range_index bigint")


@query("workload_of_handle", """SELECT e.event_id, e.handle, b.base, e.handle - b.base AS place FROM (SELECT event_id, event_id * 7919 % 100003 AS handle FROM events) e
  LEFT JOIN (SELECT DISTINCT user_id * 613 + 17 AS base FROM events) b ON b.base = (SELECT max(user_id * 613 + 17) FROM events x WHERE x.user_id * 613 + 17 <= e.handle)""")
def workload_of_handle(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    bases = e.select((F.col("user_id") * 613 + 17).cast("bigint").alias("base")).distinct()
    rows = responses.greatest_base(e.select("event_id", (F.col("event_id") * 7919 % 100003).alias("handle")), bases, 4096)
    return rows.withColumn("place", F.col("handle") - F.col("base"))


@query("teardown_codes", "SELECT event_id, (CASE WHEN event_id % 7 < 2 THEN 1 WHEN event_id % 17 = 0 THEN 2 ELSE 0 END)::INT AS code FROM events")
def teardown_codes(spark, sf_dir):
    e = F.col("event_id")
    return responses.torn_down(_table(spark, sf_dir, "events").select("event_id", F.when(e % 7 < 2, None).when(e % 17 == 0, 2).otherwise(0).cast("int").alias("code")))


@query("chunk_retries", """SELECT event_id // 4 AS chunk_id, event_id AS range_id, (CASE WHEN n = 0 THEN 0 WHEN event_id // 4 % 3 = 0 THEN 2 WHEN n * 300 > 1000 THEN 2 ELSE 0 END)::INT AS code
FROM (SELECT event_id, event_id // 4 % 6 AS n FROM events)""")
def chunk_retries(spark, sf_dir):
    """Chunks of four ranges; the nth chunk fails n times, 300 ms apart, and every third has no retry."""
    e = F.col("event_id")
    chunk = F.expr("event_id div 4")
    rows = _table(spark, sf_dir, "events").select(chunk.alias("chunk_id"), e.alias("range_id"), (chunk % 6).alias("failures"))
    tries = rows.select("chunk_id", "range_id", F.posexplode(F.sequence(F.lit(0), F.col("failures"))).alias("attempt", "__n"), "failures")
    tries = tries.select("chunk_id", "range_id", (F.col("attempt") * 300).cast("bigint").alias("at_ms"), F.when(F.col("attempt") < F.col("failures"), 19).otherwise(0).alias("code"), F.when(F.col("chunk_id") % 3 == 0, 0).otherwise(1000).alias("timeout_ms"))
    return responses.chunk_outcomes(tries)


@query("human_sizes", """SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars::BIGINT AS n FROM documents)""")
def human_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.human_size(F.col("n_chars").cast("bigint")).alias("size"))


# Tensors -----------------------------------------------------------------------------------------


def _encoded(spark, sf_dir) -> DataFrame:
    """The embeddings as F32 bytes."""
    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    return _table(spark, sf_dir, "embeddings").select("vec_id", pack("embedding").alias("data"), F.lit("F32").alias("dtype"), F.array(F.size("embedding").cast("bigint")).alias("shape"))


@query("tensor_bytes", "SELECT vec_id, len(embedding)::BIGINT AS items, (4 * len(embedding))::BIGINT AS nbytes FROM embeddings")
def tensor_bytes(spark, sf_dir):
    return _encoded(spark, sf_dir).select("vec_id", decode.element_count().alias("items"), F.octet_length("data").cast("bigint").alias("nbytes"))


@query("tensor_decode", "SELECT vec_id, (unnest(embedding))::DOUBLE AS value, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM embeddings")
def tensor_decode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("vec_id", F.posexplode(decode.decode_double("data", "dtype")).alias("i", "value"))


FILES = 8


def _checkpoint(spark, sf_dir) -> str:
    """The embeddings as a checkpoint of FILES files in the shared folder, one tensor a vector."""
    from rangeloom.sources.safetensors import write

    where = f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}"
    tensors = _encoded(spark, sf_dir).select(F.concat(F.lit("part-"), F.col("vec_id") % FILES, F.lit(".safetensors")).alias("file"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"), "dtype", "shape", "data")
    write(tensors, where).collect()  # a row a file
    return where


@query("safetensors_scan", "SELECT vec_id, 'F32' AS dtype, (4 * len(embedding))::BIGINT AS nbytes, (unnest(embedding))::DOUBLE AS value, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM embeddings")
def safetensors_scan(spark, sf_dir):
    from rangeloom.sources.safetensors import scan

    rows = scan(spark, _checkpoint(spark, sf_dir))
    return rows.select(F.col("name").cast("bigint").alias("vec_id"), "dtype", "nbytes", F.posexplode(decode.decode_double("data", "dtype")).alias("i", "value"))


@query("header_sweep", f"""SELECT vec_id, (dense_rank() OVER (ORDER BY vec_id % {FILES}) - 1)::INT AS file_id, (row_number() OVER w - 1)::INT AS tensor_index, len(embedding)::BIGINT AS item_count, len(embedding)::BIGINT AS length,
  coalesce(sum(4 * len(embedding)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_start, (sum(4 * len(embedding)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS data_end
FROM embeddings WINDOW w AS (PARTITION BY vec_id % {FILES} ORDER BY vec_id)""")
def header_sweep(spark, sf_dir):
    from rangeloom.sources.safetensors import scan

    rows = scan(spark, _checkpoint(spark, sf_dir), withData=False)
    return rows.select(F.col("name").cast("bigint").alias("vec_id"), "file_id", "tensor_index", "item_count", F.element_at("storage_shape", 1).alias("length"), "data_start", "data_end")


@query("selected_tensors", "SELECT vec_id, (4 * len(embedding))::BIGINT AS nbytes, (unnest(embedding))::DOUBLE AS value, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM embeddings WHERE vec_id % 10 = 3 AND vec_id IN (SELECT doc_id FROM labels)")
def selected_tensors(spark, sf_dir):
    """Tensors asked for by name: blocks of 64 bytes, put together again."""
    from rangeloom.sources.safetensors import scan

    asked = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")).where("vec_id % 10 = 3").join(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", "left_semi").distinct()
    names = [r[0] for r in asked.select(F.lpad(F.col("vec_id").cast("string"), 12, "0")).collect()]  # what a caller would pass
    rows = scan(spark, _checkpoint(spark, sf_dir), names=names, blockBytes=64)
    whole = rows.groupBy("name", "dtype", "nbytes").agg(F.expr("aggregate(array_sort(collect_list(struct(block_index, block))), X'', (a, x) -> concat(a, x.block))").alias("data"))
    return whole.select(F.col("name").cast("bigint").alias("vec_id"), "nbytes", F.posexplode(decode.decode_double("data", "dtype")).alias("i", "value"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
