import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import same_rows
from pyspark.sql import functions as F

from rangeloom.llm import components, lines, queries, sharding, simhash, sql, substring
from rangeloom.llm.common import Sieve, Texts, texts_of

SCHEMA = "doc_id bigint, text string, key string, line string, start int, anchor int, spans int, places int, size int, hash int"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", "l", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


def awkward(seed, n=60, long=4000):
    """Texts that share passages, repeat themselves, are empty, null, very long or of separators alone."""
    draw = random.Random(seed)
    vocab = ["a", "b", "é", "the", "of", "あい", "x" * 30] + [f"w{i}" for i in range(60)]
    passage = lambda k: [draw.choice(vocab) for _ in range(k)]
    shared = [passage(k) for k in (34, 35, 36, 50, 90)]
    rows = [(None, None), (None, "x y"), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, " ".join(passage(long))), (3, "other text of one id"), (4, "same row"), (4, "same row")]
    for i in range(n):
        parts = []
        for _ in range(draw.randint(1, 4)):
            own = list(draw.choice(shared)) if draw.random() < 0.5 else passage(draw.randint(1, 60))
            if draw.random() < 0.4:
                own[draw.randrange(len(own))] = f"u{draw.random()}"
            parts += own
        rows.append((10 + i, draw.choice([" ", "\n", "  \t"]).join(parts) + draw.choice(["", " ", "\n"])))
    rows += [(1000 + i, rows[20][1]) for i in range(5)]
    rows.append((2000, "same same " * 40))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = awkward(seed)
    count = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    expected = []
    for i, t in rows:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring.without_repeats(table(spark, rows).repartition(7)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert sum(x[2] for x in expected) > 100


def thue_morse(n):
    """Letters a and b in an order whose polynomial hash modulo 2**64 is that of the same with a and b exchanged."""
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_only_hash_alike_stay(spark):
    word = thue_morse(1024)
    same = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*same, word])), (2, " ".join([*same, word.translate(str.maketrans("ab", "ba"))]))]
    assert [r.n_removed for r in substring.without_repeats(table(spark, rows)).collect()] == [0, 0]
    raw = b"a b c d"
    starts, ends = np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])
    good = substring._digest(raw, starts, ends, 1, 3)
    assert substring._merged([{"start": 1, "end": 3, "digest": good}, {"start": 0, "end": 2, "digest": good}, {"start": 2, "end": 9, "digest": good}], raw, starts, ends, 0, 4) == [(1, 3)]


def test_spans_are_disjoint(spark):
    text = " ".join(f"w{i}" for i in range(80))
    got = substring.repeated_spans(table(spark, [(1, text), (2, text), (3, "x " + text + " y"), (4, "other")])).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in got) == [(1, [(0, 80)]), (2, [(0, 80)]), (3, [(1, 81)])]


def test_copies_compact_to_one_path(spark):
    """A long copied text is one path, however many anchors it has; where two texts part, paths end."""
    from rangeloom.llm.common import row_key

    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    rows = table(spark, [(1, a), (2, a), (3, a), (4, f"{b} {c}"), (5, f"{b} {c}"), (6, c)]).select("doc_id", row_key().alias("key"), "text")
    _, _, vertices = substring.graph(rows, 35, 16)
    found = sorted((r.source.doc_id, r.source.start, r.n) for r in substring.compacted(vertices).collect())
    assert found == [(1, 0, 366), (4, 0, 400), (4, 400, 366)] and vertices.count() > 20


def test_span_hashes():
    from rangeloom.llm.common import span_hashes

    texts = [b"", b"a", b"b", b"a\x00", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 2000, thue_morse(1024).encode(), thue_morse(1024).translate(str.maketrans("ab", "ba")).encode()]
    ends = np.cumsum([len(t) for t in texts])
    hashes = span_hashes(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, 5)
    assert len(set(hashes.tolist())) == len(texts)
    alone = [span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 5)[0] for t in texts]
    assert hashes.tolist() == alone


def test_substring_dedup_of_nothing(spark):
    assert substring.without_repeats(table(spark, [])).count() == 0
    assert [tuple(r)[1:3] for r in substring.without_repeats(table(spark, [(1, None)])).collect()] == [(0, 0)]


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(3)
    pool = ["", " ", "short line", "A line of just enough letters", " a LINE of just enough letters\t", "é" * 19, "é" * 20, "É" * 20, "x" * 5000, "nineteen characters", "twenty characters ok", "a line that only two texts have"]
    rows = [(None, "A line of just enough letters"), (5, None), (6, ""), (7, "\n\n")]
    rows += [(i, "\n".join(draw.choice(pool[:-1]) for _ in range(draw.randint(1, 12)))) for i in range(10, 60)]
    rows += [(70, pool[-1]), (71, pool[-1]), (72, "twenty characters ok"), (72, "twenty characters ok")]
    key = lambda x: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    expected = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = "\n".join(x for x in all_ if not (key(x) in last and last[key(x)] != i))
        gone = sum(key(x) in last and last[key(x)] != i for x in all_)
        expected.append((i, len(all_), gone, hashlib.sha256(stay.encode()).hexdigest(), stay))
    for size in (lines.FILTER_BYTES, 1 << 16):
        got = [tuple(r) for r in lines.without_common_lines(table(spark, rows).repartition(5), filter_bytes=size).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert lines.without_common_lines(table(spark, [])).count() == 0


def test_a_full_filter_only_passes_more(spark):
    values = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 200_000, dtype=np.int64)
    df = spark.createDataFrame([(int(x),) for x in values[:20_000]], "v bigint").repartition(3)
    sieve = Sieve.of(df, 20_000)
    assert sieve.passes(values[:20_000].view(np.uint64)).all()
    assert sieve.passes(values[20_000:].view(np.uint64)).mean() < 0.1
    tiny = Sieve.of(df, 10**9, Sieve.SEGMENT)
    assert len(tiny.bits) == Sieve.SEGMENT and tiny.passes(values[:20_000].view(np.uint64)).all()


def own_fingerprint(t):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """doc position -> smallest position it reaches over links of three bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_spark_xxhash(spark, sf):
    row = spark.sql("SELECT xxhash64('the quick brown') AS h").first()
    assert row.h == np.array([xxhash.xxh64_intdigest(b"the quick brown", 42)], np.uint64).view(np.int64)[0]
    texts = [t for _, t in awkward(5)]
    import pyarrow as pa

    assert simhash.fingerprints(texts_of(pa.array(texts))).tolist() == [own_fingerprint(t) for t in texts]


def test_simhash_equals_brute_force(spark):
    rows = awkward(4) + [(5000 + i, f"one two three four five six seven eight nine ten {'x' if i % 2 else ''} tail {i // 8}") for i in range(40)]
    prints = [own_fingerprint(t) for _, t in rows]
    root = grouped(prints)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        least[r].append(i)
    expected = [(i, f"{p:016x}", min((x for x in least[r] if x is not None), default=None)) for (i, _), p, r in zip(rows, prints, root, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows).repartition(6)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    kept = simhash.one_of_each(table(spark, rows)).collect()
    assert len(kept) == len(set(root))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize(("seed", "split"), [(0, simhash.SPLIT), (1, simhash.SPLIT), (2, simhash.SPLIT), (0, 0), (1, 1), (2, 3)])
def test_links_connect_what_three_bits_connect(spark, seed, split):
    """Whatever a task holds of one anchor, and however much of it is dealt out once more."""
    draw = random.Random(seed)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in sorted(prints)[:30]:
        for k in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in draw.sample(range(64), k)))
    prints |= {0, 1, (1 << 64) - 1, 1 << 63, 0x7FFFFFFF, 0x80000000}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints], "fp bigint")
    found = {r.node: r.root for r in components.components(simhash.links(df, split=split)).collect()}
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    ours = [found.get(s, s) for s in signed]
    same = lambda x: {frozenset(i for i, y in enumerate(x) if y == z) for z in set(x)}
    assert same(ours) == same(grouped(prints))


def test_crowds_at_an_anchor_lose_no_pair(monkeypatch):
    draw = np.random.Generator(np.random.PCG64(4))
    base = draw.integers(0, 1 << 64, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4) for _ in range(60)], np.uint64)
    prints = np.unique(np.concatenate([base[:30], np.tile(base, 5) ^ flips]))
    keys, owner = simhash.anchors(prints)
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], prints[owner[order]]
    pairs = []
    for crowd in (10**9, 1):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        a, b = simhash.close_pairs(keys, own, 3)
        pairs.append({tuple(sorted(p)) for p in zip(own[a].tolist(), own[b].tolist(), strict=True)})
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


@pytest.mark.parametrize(("n", "spread"), [(1, 1), (300, 3), (300, 64), (2000, 12)])
def test_connected_equals_all_pairs(monkeypatch, n, spread):
    """A group around one word, from nothing but links to hardly any, in sorted groups of its own."""
    draw = np.random.Generator(np.random.PCG64(n + spread))
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, spread, endpoint=True), replace=False)) for _ in range(n)], np.uint64)
    prints = draw.permutation(np.unique(np.concatenate([flips ^ np.uint64(0x9E3779B97F4A7C15), flips])))
    keys = np.sort(np.arange(len(prints), dtype=np.uint64) % np.uint64(2))

    def classes(a, b):
        root = np.arange(len(prints))
        nodes, to = components.local_stars(a, b)
        root[nodes] = to
        return root.tolist()

    every = classes(*simhash._compared(keys, prints, 3))
    monkeypatch.setattr(simhash, "DENSE", 0)
    assert classes(*simhash.in_groups(keys, prints, 3)) == every


def test_a_dense_crowd_takes_no_pair_of_all():
    """All words within three bits of one, 43,745 of them: a second or two, where all pairs are a thousand million."""
    bits = [np.uint64(1 << k) for k in range(64)]
    prints = np.array([0, *(a for a in bits), *(a | b for a, b in itertools.combinations(bits, 2)), *(a | b | c for a, b, c in itertools.combinations(bits, 3))], np.uint64)
    began = time.process_time()
    a, b = simhash.connected(prints, 3)
    assert time.process_time() - began < 20
    nodes, root = components.local_stars(a, b)
    assert len(nodes) == len(prints) - 1 and (root == 0).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 300)] + [(7, i) for i in range(1000, 1100)] + [(1050, 2), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(200, 301)} == {200} and {got[i] for i in (7, 2, *range(1000, 1100))} == {2} and got.get(5, 5) == 5
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_written_rows_can_be_deleted(spark):
    from rangeloom.llm import common

    one, two = common.written(spark.range(5)), common.written(spark.range(3))
    common.discard(one)
    assert two.count() == 3
    with pytest.raises(Exception):
        one.count()
    common.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(two.written_to).count()


def test_words_of_byte_texts():
    data = np.frombuffer(b"ab c d", np.uint8)
    starts, ends, at = Texts(data, np.array([0, 1, 1, 2, 6])).words()
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(0, 1), (1, 2), (3, 4), (5, 6)] and at.tolist() == [0, 1, 1, 2, 4]


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_shards_fit_and_split_no_more_than_needed(spark, limit):
    draw = random.Random(limit)
    rows = [(i, "é" * draw.randint(0, 12)) for i in range(300)] + [(500, "y" * 90), (None, None), (None, "null id"), (600, "twice"), (600, "twice")] + [(700, f"row {i} of one id") for i in range(30)]
    got = sharding.shards(table(spark, rows), limit).collect()
    assert sorted(repr((r.doc_id, r["size"])) for r in got) == sorted(repr((i, len((t or "").encode()))) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r["size"])
    assert all(sum(x) <= limit or sum(s > 0 for s in x) == 1 for x in shards.values())
    for name, sizes in shards.items():
        if name and "#" not in name:  # the parent had to split
            parent = [s for n, x in shards.items() if n.startswith(name[:-1]) for s in x]
            assert sum(parent) > limit and len(parent) > 1
    assert sharding.shards(table(spark, []), limit).count() == 0


def test_shards_with_text(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    given = {r.doc_id: f"s_{r.shard}" for r in sharding.with_shards(table(spark, rows), 100).collect()}
    assert {r.doc_id: (r.text, r.shard) for r in back.collect()} == {i: (t, given[i]) for i, t in rows} and len(set(given.values())) > 3
    sharding.write_shards(table(spark, rows), str(tmp_path / "one"))
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "one")).collect()} == {"s_"}


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_line_dedup", "op10_sharding", "sharding_small_limit"])
def test_query_equals_its_sql(spark, sf, tables, name):
    same_rows(queries.queries()[name](spark, sf), tables, queries.oracle_sql()[name])
    assert queries.oracle_sql()[name] in (sql.OP3, sql.OP4, sql.OP10, sql.sharding_sql(queries.SMALL_SHARD_BYTES))


def test_simhash_query_covers_all_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [own_fingerprint(r.text) for r in rows]
    least = {}
    root = grouped(prints)
    for r, x in zip(rows, root, strict=True):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf).collect()}
    assert got == {(r.doc_id, f"{p:016x}", least[x]) for r, p, x in zip(rows, prints, root, strict=True)}
    assert F is not None


@pytest.mark.parametrize("limit", [60, 10**9])
def test_rows_with_shards_fit_as_well(spark, limit, monkeypatch):
    from rangeloom.llm import common

    rows = [(i, "é" * (i % 9)) for i in range(200)] + [(None, None), (600, "twice"), (600, "twice")] + [(700, f"row {i} of one id") for i in range(20)]
    for most in (common.BROADCAST_BYTES, -1):  # without a broadcast the rows are the same
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        got = sharding.with_shards(table(spark, rows), limit).collect()
        assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr(r) for r in rows)
        size = defaultdict(list)
        for r in got:
            size[r.shard].append(len((r.text or "").encode()))
        assert all(sum(x) <= limit for x in size.values())
