import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from rangeloom.llm import chat, decontaminate, eliasfano, langid, mixing, ngram_lm, quality, queries, sql

SCHEMA = "doc_id bigint, text string, lang string, source string, size int, target int, copies int, words int, lines int, score int, lang_pred int, item_id int, key int"


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in rows], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_chat_format", "op6_source_mixing"])
def test_query_equals_its_sql(spark, sf, tables, name):
    same_rows(queries.queries()[name](spark, sf), tables, queries.oracle_sql()[name])


# Quality rules


def test_quality_counts(spark):
    prose = "This is a clean line of plain words that ends as it should. " * 3
    rows = [
        (None, None), (1, ""), (2, " \n\t\n"), (3, "a b c a b c"), (4, "x x x x"), (5, "é | > ##\né | > ##\n\n\n"),
        (6, "\n".join(f"{prose}{i} and {i * 7} more{i}." for i in range(5))), (7, "home | about | news | contact | help\n" * 30 + prose), (8, "w " * 40_000), (8, "w " * 40_000),
    ]
    got = {(r.doc_id, i): r for i, r in enumerate(quality.clean(table(spark, rows)).collect())}
    for (i, t), r in zip(rows, [got[k] for k in sorted(got, key=lambda k: k[1])], strict=True):
        w, text = words(t), t or ""
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeated = {j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        full = [x for x in text.split("\n") if words(x)]
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert r.line_chars == sum(map(len, full)) and not (r.kept and r.base_failed)
        assert r.lost_chars + len(r.cleaned.replace("\n", "")) == r.line_chars
    assert quality.clean(table(spark, [])).count() == 0


def test_quality_lines(spark):
    body = " ".join(f"word{i}" for i in range(60)) + "."
    lines = {"Menu | Home | About | Help": True, "BUY!! NOW!! GREAT!! DEAL!!": True, "All rights reserved.": True, "Short title": True, "Stop.": False, body: False, "Fragment of three words": False, "He said: \"no\".": False}
    r = quality.clean(table(spark, [(1, "\n".join(lines))])).first()
    assert r.cleaned.split("\n") == [x for x, fails in lines.items() if not fails] and r.kept
    junk = "\n".join(" ".join(f"w{i}{j}$$$" for j in range(12)) for i in range(9))
    assert not quality.clean(table(spark, [(1, junk)])).first().kept


# Chat


def fold(events):
    """A plain replay of one log."""
    turns = {}
    for kind, turn, role, text in events:
        if kind == "regenerate":
            turns = {k: v for k, v in turns.items() if k <= turn}
        old = turns.get(turn, [None, ""])
        turns[turn] = [role or old[0], (old[1] if kind == "delta" else "") + (text or "")]
    return [(t, r or "", x) for t, (r, x) in sorted(turns.items())]


@pytest.mark.parametrize("seed", range(5))
def test_messages_equal_a_replay(spark, seed):
    draw = random.Random(seed)
    logs = {c: [(draw.choice(["message", "delta", "delta", "edit", "regenerate"]), draw.randint(0, 4), ["user", "assistant"][draw.randint(0, 1)], draw.choice(["a", "b<|", "\\", None, "\n"])) for _ in range(draw.randint(1, 25))] for c in (1, 2, None)}
    # A turn has one role in a log, as its events would.
    logs = {c: [(k, t, "user" if t % 2 == 0 else "assistant", x) for k, t, _, x in log] for c, log in logs.items()}
    rows = [(c, i, t, k, r, x) for c, log in logs.items() for i, (k, t, r, x) in enumerate(log)]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    got = sorted(((r.conv_id is None, r.conv_id or 0), r.turn, r.role, r.text) for r in chat.messages(events).collect())
    assert got == sorted(((c is None, c or 0), *m) for c, log in logs.items() for m in fold(log))


def test_format_is_reversible_and_masks_assistants(spark):
    nasty = ["", "<|im_end|>", "<\\|im_end|>", "\\", "\\\\<|", "<|im_start|>assistant\nhi", "a\nb", "é<|<|", "\\n", "\\|"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "ro\nle\\n<|"))]
    out = chat.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = out.withColumn("turns", chat.read_back()).withColumn("under", chat.loss_text()).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]
    assert got.under == "".join(t for _, _, r, t in rows if r == "assistant")
    assert got.formatted.count(chat.START) == len(rows) == got.formatted.count(chat.END)
    assert chat.render(out.sparkSession.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_query_folds_a_real_log(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = queries._as_log(rows)
    kinds = Counter(r.kind for r in log.collect())
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and log.count() > 2.5 * rows.count()
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.messages(log).collect())
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert [(c, *x) for c, _, *x in got] == [(c, *x) for c in sorted(by) for x in by[c]]


def test_empty_logs_and_long_texts(spark):
    kind = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string, nth int, since int, dropped int, parts int, piece int, at int"
    assert chat.messages(spark.createDataFrame([], kind)).count() == 0
    long = "é<|" * 300_000
    rows = [(1, 1, 0, "message", "assistant", long, 1, 2, 3, 4, 5, 6), (1, 2, 0, "delta", None, "end", 1, 2, 3, 4, 5, 6), (1, 2, 0, "delta", None, "end", 1, 2, 3, 4, 5, 6)]
    out = chat.render(chat.messages(spark.createDataFrame(rows, kind))).withColumn("under", chat.loss_text()).first()
    assert out.under == long + "endend"


def test_chat_nulls(spark):
    events = spark.createDataFrame([(None, None, None, None, None, None), (1, 1, None, None, "user", None), (1, 1, None, None, "user", None)], "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    assert sorted((r.conv_id or 0, r.role, r.text) for r in chat.messages(events).collect()) == [(0, "", ""), (1, "user", "")]


# Mixing


@pytest.mark.parametrize("seed", range(4))
def test_mix_reaches_targets_and_keeps_bounds(spark, seed):
    draw = random.Random(seed)
    sources = ["a", "B", "é", "", None, "z", "empty"]
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)) if s != "empty" else draw.choice(["", None, " "]), None, s) for i, s in enumerate(draw.choices(sources, [9, 3, 2, 1, 1, 1, 1], k=4000))]
    got = mixing.mixed(table(spark, rows).repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    by = {}
    for r in got:
        s = rows[r.doc_id][3]
        assert r["size"] == len(words(rows[r.doc_id][1])) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        by.setdefault(s, [0, 0, r.source_size, r.target])
        by[s][0] += r["size"]
        by[s][1] += r.taken
    total = sum(x[0] for x in by.values())
    # Targets by refilling, source after source.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, (s or "").encode())))}
    stopped = set()
    while True:
        left, w = total - sum(3 * by[s][0] for s in stopped), sum(weight[s] for s in by if s not in stopped)
        more = {s for s in by if s not in stopped and weight[s] * left > 3 * by[s][0] * w}
        if not more:
            break
        stopped |= more
    for s, (size, taken, said, target) in by.items():
        assert said == size and math.isclose(target, 3 * size if s in stopped else weight[s] * left / w, abs_tol=1e-9)
        assert abs(taken - target) <= max(0.25 * target, 60)
    assert math.isclose(sum(x[3] for x in by.values()), total)
    again = {r.doc_id: r.copies for r in mixing.mixed(table(spark, rows)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    copied = Counter(r.doc_id for r in mixing.mix(table(spark, rows)).collect())
    assert copied == Counter({k: v for k, v in again.items() if v})


def test_mix_of_nothing(spark):
    assert mixing.mixed(table(spark, [])).count() == 0
    assert [(r["size"], r.target, r.copies) for r in mixing.mixed(table(spark, [(None, None, None, None), (1, "", None, "a")])).collect()] == [(0, 0.0, 0)] * 2


# Language


def brute_bits(text, grams, symbols):
    """One text's code length, from counts of bytes after contexts."""
    raw, total = b"\n\n\n" + text, 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            seen = grams[k].get(raw[i - k : i])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total += math.log2((n + q) / seen[raw[i]])
                break
            total += math.log2((n + q) / q)
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    import pyarrow as pa

    from rangeloom.llm.common import texts_of

    learn = {"en": ["the cat and the hat", "a cat"], "xx": ["zzzz qqqq", "éé"]}
    rows = [(i, t, k, None) for i, (k, t) in enumerate((k, t) for k, ts in learn.items() for t in ts)]
    trees = langid.fit(table(spark, rows).drop("lang_pred", "score"))
    tests = ["", "the", "zq", "é", "あ unseen Bytes", "cat hat zzz"]
    got = trees.code_lengths(texts_of(pa.array(tests)))
    for j, name in enumerate(trees.langs):
        grams = [{} for _ in range(4)]
        for t in learn[name]:
            raw = b"\n\n\n" + t.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    grams[k].setdefault(raw[i - k : i], Counter())[raw[i]] += 1
        for i, t in enumerate(tests):
            # Bytes that no sample has share one symbol; all cost what an unseen byte costs.
            assert got[i, j] == pytest.approx(brute_bits(t.encode(), grams, None), rel=1e-4)
    named = {r.text: (r.lang_pred, r.score) for r in langid.identified(table(spark, [(None, None), (1, ""), (2, "12 !"), (3, "the hat"), (4, "qzz")]), trees).collect()}
    assert named[None] == named[""] == named["12 !"] == ("und", 0.0)
    assert named["the hat"][0] == "en" and named["qzz"][0] == "xx" and 0.5 < named["qzz"][1] <= 1
    assert langid.fit(table(spark, [(1, "x", None, None)])) is None
    assert {r.lang_pred for r in langid.identified(table(spark, rows), None).collect()} == {"und"}


def test_no_language_is_lost_by_its_sample(spark):
    """Languages of five equal texts, one of which fills the bound, and one with a huge text among small ones."""
    rows = [(i, chr(97 + i // 5) * 1000, f"l{i // 5}", None) for i in range(100)]
    rows += [(1000, "zy" * 50_000, "big", None), *((1001 + i, f"zx{i} " * 20, "big", None) for i in range(300)), (2000, "tiny", "tiny", None)]
    docs = table(spark, rows).drop("lang_pred", "score")
    assert set(langid.fit(docs, sample_bytes=1000).langs) == {f"l{i}" for i in range(20)} | {"big", "tiny"}
    for bound in (1, 1000, 1500, 4000, 10**9):
        found = {}
        for r in langid.sampled(docs, sample_bytes=bound).collect():
            found.setdefault(r.lang, []).append(len(r.text))
        whole = {}
        for _, t, name, _ in rows:
            whole.setdefault(name, []).append(len(t))
        for name, own in whole.items():
            assert sum(found[name]) >= min(bound, sum(own)) and sum(found[name]) - max(found[name]) < bound


def test_trees_keep_every_context_of_many_languages():
    """A hundred languages with contexts of their own, more than any table of all contexts by all bytes could hold."""
    import pickle

    import pyarrow as pa

    from rangeloom.llm.common import texts_of

    draw = np.random.Generator(np.random.PCG64(3))
    texts = {f"l{i:02}": draw.integers(0x20 + i, 0x7F if i < 40 else 0x100 + 40 * i, 4000) for i in range(100)}
    texts = {k: "".join(map(chr, v)) for k, v in texts.items()}
    counts = {k: np.unique(langid._grams(texts_of(pa.array([t]))), return_counts=True) for k, t in texts.items()}
    trees = langid.Trees(counts)
    assert len(pickle.dumps(trees)) < 100e6 and all(len(o[3].seen) == len(counts[k][0]) for k, o in zip(trees.langs, trees.trees, strict=True))
    bits = trees.code_lengths(texts_of(pa.array([texts["l07"], texts["l71"], "", texts["l07"]])))
    assert bits[:2].argmin(1).tolist() == [7, 71] and not bits[2].any() and (bits[0] == bits[3]).all()


def test_stored_trees_equal_those_in_memory(spark):
    """Segments of a few entries, so that an order has many and an asked byte may lie before a segment's first."""
    import pickle

    import pyarrow as pa

    from rangeloom.llm.common import texts_of

    draw = np.random.Generator(np.random.PCG64(4))
    rows = [(i, "".join(map(chr, draw.integers(0x20 + 40 * (i % 3), 0x90 + 90 * (i % 3), 50))), ("en", "é", "xx")[i % 3], None) for i in range(30)]
    docs = table(spark, [*rows, (99, None, "en", None), (100, "", "yy", None), (101, "no language", None, None)]).drop("lang_pred", "score")
    plain, asked = langid.fit(docs, sample_bytes=10**9), texts_of(pa.array([*(r[1] for r in rows), "", "unseen ü 語", *(chr(x) for x in range(1, 0x180))]))
    for segment in (100, langid.SEGMENT):
        trees = pickle.loads(pickle.dumps(langid.stored(langid.labelled(docs), segment)))
        assert trees.langs == plain.langs == ["en", "xx", "é"]
        assert (trees.code_lengths(asked) == plain.code_lengths(asked)).all()
        assert segment > 100 or len(trees.trees[0][3].parts) > 1
        whole = langid.identified(docs, plain).collect()
        assert langid.identified(docs, trees).collect() == whole
    assert langid.stored(langid.labelled(docs.where("doc_id > 98"))) is None


def test_quantiles_are_exact(spark):
    from rangeloom.llm.common import written

    draw = np.random.Generator(np.random.PCG64(6))
    own = {"a": draw.exponential(2, 30_000), "b": np.full(5000, 1.5), "c": np.array([3.0]), "d": np.repeat(np.nextafter(2.0, [1, 3]), [999, 1]), "e": np.append(draw.random(1998), [1e300, 1e300]), "f": 1 + draw.integers(0, 50, 20_000) * 2.0**-52}
    rates = written(spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v], "lang string, rate double"))
    want = {k: float(np.sort(v)[-(-999 * len(v) // 1000) - 1]) for k, v in own.items()}
    assert langid.quantiles(rates, langid.RATE_QUANTILE) == want


def test_repeated_rows_ties_and_long_texts_have_a_language(spark):
    rows = [(1, "the cat", "en", None), (1, "the cat", "en", None), (2, "the cat", "xx", None), (3, "le chat " * 60_000, "fr", None)]
    docs = table(spark, rows).drop("lang_pred", "score")
    got = langid.identified(docs, langid.fit(docs)).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (1, "en"), (2, "en"), (3, "fr")] and got[0].score == got[2].score


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op7_language_id(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert np.mean([r.lang_pred == r.lang for r in judged]) > 0.95


# Decontamination


def near(item, text):
    """Least edits between item and a substring of text, by a plain full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    draw = random.Random(11)
    vocab = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(40)] + ["été"]
    text = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    items = [(i, text(draw.choice([4, 12, 25, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "short"), (93, items_ := text(20)), (94, items_)]
    docs = [(None, None), (1, ""), (2, "   ")]
    for i in range(60):
        host, item = text(draw.randint(0, 20)), items[draw.randrange(12)][1]
        for _ in range(draw.choice([0, 0, 1, 3, 5, 9, 20])):
            k = draw.randrange(len(item))
            item = draw.choice([item[:k] + item[k + 1 :], item[:k] + draw.choice("xyz ") + item[k:], item[:k] + "q" + item[k + 1 :]])
        docs.append((10 + i, draw.choice([item, f"{host} {item.upper()}, {text(3)}", host, f"{host}\n{item.replace(' ', ' -- ')}"])))
    docs.append((500, text(20_000) + " " + items[2][1]))
    plain = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (t or "").translate({c: c + 32 for c in range(65, 91)})).strip().encode()
    expected = set()
    for i, t in docs:
        for k, x in items:
            a, b = plain(x), plain(t)
            if len(a) < decontaminate.Q:
                continue
            budget = min(int(len(a) * decontaminate.EDIT_SHARE), (len(a) - decontaminate.Q) // decontaminate.Q)
            edits = 0 if a in b else near(a, b) if budget and len(b) < 3000 else 10**9
            if edits <= budget:
                expected.add((i, k, edits))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    got = {tuple(r) for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert got == expected and len({e for _, _, e in got}) > 3
    gone = {i for i, _, _ in expected}
    assert sorted((r.doc_id or 0) for r in decontaminate.clean(table(spark, docs), bench).collect()) == sorted((i or 0) for i, _ in docs if i not in gone)
    assert decontaminate.leaks(table(spark, []), bench).count() == 0
    assert decontaminate.leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_repetitive_texts_and_items_stay_small():
    """One letter nine thousand times against an item of a thousand: equal q-grams meet in 9e6 pairs."""
    import tracemalloc

    items = decontaminate.Items([1, 2, 3], [b"0" * 1000, b"0" * 500 + b"1" * 500, b"ab " * 30])
    flat = np.concatenate([np.frombuffer(x + b"\0", np.uint8) for x in (b"0" * 9_000, b"ab " * 20, b"0" * 3000 + b"1" * 600)])
    begin = np.array([0, 9_001, 9_062, 12_663])
    tracemalloc.start()
    found = items.matches(flat, begin)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert sorted(found) == [(0, 0, 0), (2, 0, 0), (2, 1, 0)]


def test_short_items_are_listed(spark):
    bench = spark.createDataFrame([(1, None), (2, "  -- "), (3, "Forty-Two"), (4, "é" * 6), (5, "twelve bytes")], "item_id bigint, text string")
    assert sorted(tuple(r) for r in decontaminate.unsearched(bench).collect()) == [(1, 0), (2, 0), (3, 9)]


def test_blocks_of_a_benchmark_find_the_same(spark, sf, monkeypatch):
    whole = {tuple(r) for r in queries.op1_decontaminate(spark, sf).collect()}
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("text", "item_id", 2000))
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == whole
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in (d.text or "")}
    assert exact and exact <= {x[:2] for x in whole}


# Scoring


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (1000, 1 << 64), (1000, 1003), (3000, 10**9)])
def test_elias_fano(n, universe):
    draw = np.random.Generator(np.random.PCG64(n))
    values = np.unique(draw.integers(0, universe, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    shape = eliasfano.Shape(len(values), universe)
    arrays = {k: np.zeros(size, kind) for k, (kind, size) in shape.arrays("v").items()}
    builder = eliasfano.Builder(shape, arrays, "v")
    for part in np.array_split(values, 3):
        builder.add(part)
    builder.done()
    found = eliasfano.Sequence(shape, arrays, "v")
    assert (found.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, draw.integers(0, universe, 500, dtype=np.uint64)])
    at = {int(v): i for i, v in enumerate(values)}
    assert found.find(asked).tolist() == [at.get(int(v), -1) for v in asked]


def test_scores_equal_brute_force(spark):
    draw = random.Random(2)
    vocab = ["a", "A", "b", "é", "the", "x" * 40] + [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(draw.choice(vocab) for _ in range(draw.randint(0, 60)))) for i in range(60)] + [(None, None), (100, ""), (101, "unknown words only here"), (102, "a b a b " * 3000)]
    learn = [r for r in rows if r[0] != 101]
    model = ngram_lm.train(table(spark, learn))
    token = lambda t: words((t or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]
    texts = [token(t) for _, t in learn]
    c = [Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
    kept = [c[0], *({k: v for k, v in x.items() if v > 1} for x in c[1:])]
    total, v = sum(c[0].values()), len(c[0])
    given = [Counter() for _ in range(3)]
    for n in (1, 2):
        for k, x in kept[n].items():
            given[n][k[:-1]] += (x - ngram_lm.DISCOUNT) / c[n - 1][k[:-1]]
    for r, (i, t) in zip(ngram_lm.scored(table(spark, rows), model).collect(), rows, strict=True):
        w, base, score = token(t), 0.0, 0.0
        for j, x in enumerate(w):
            p = (c[0][(x,)] + 0.5) / (total + 0.5 * (v + 1))
            base += math.log10(p)
            for n in (1, 2):
                context = tuple(w[j - n : j]) if j >= n else None
                if context and context in kept[n - 1]:
                    p = (1 - given[n][context]) * p + ((kept[n][context + (x,)] - ngram_lm.DISCOUNT) / c[n - 1][context] if context + (x,) in kept[n] else 0)
            score += math.log10(p)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(w), sum((x,) in c[0] for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) <= len(w) / ngram_lm.SCALE
    empty = ngram_lm.scored(table(spark, rows), ngram_lm.train(table(spark, [])))
    assert {r.n_known for r in empty.collect()} == {0}
    assert ngram_lm.scored(table(spark, []), model).count() == 0


def test_query_scores_with_every_ngram(spark, sf):
    """Against a brute force in which n-grams that occur once count too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    token = lambda t: words((t or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]
    texts = {r.doc_id: token(r.text) for r in docs}
    learn = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = [Counter(tuple(t[i : i + n]) for t in learn for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
    total, v, kinds = sum(c[0].values()), len(c[0]), Counter(k[:-1] for x in c[1:] for k in x)
    assert sum(x == 1 for x in c[2].values()) > len(c[2]) / 2
    for r in queries.op8_lm_scoring(spark, sf).collect():
        w, score = texts[r.doc_id], 0.0
        for j, x in enumerate(w):
            p = (c[0][(x,)] + 0.5) / (total + 0.5 * (v + 1))
            for n in (1, 2):
                context = tuple(w[j - n : j])
                if j >= n and c[n - 1][context]:
                    times = c[n][(*context, x)]
                    p = (ngram_lm.DISCOUNT * kinds[context] * p + max(times - ngram_lm.DISCOUNT, 0)) / c[n - 1][context]
            score += math.log10(p)
        assert abs(r["score"] - score) <= len(w) / ngram_lm.SCALE


@pytest.mark.parametrize("min_count, segment", [(1, 100), (2, 150)])
def test_segments_score_alike(spark, min_count, segment):
    """Whatever the segments are cut for, contexts that are split over several of them among it."""
    draw = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(draw.choice(["the", draw.choice(vocab[: draw.randint(1, 400)])]) for _ in range(draw.randint(0, 80)))) for i in range(60)] + [(None, None), (90, "the unseen the"), (91, "the " * 500)]
    learn = table(spark, [r for r in rows if r[0] != 90])
    whole, cut = (ngram_lm.train(learn, min_count=min_count, segment=x) for x in (ngram_lm.SEGMENT, segment))
    assert [x.n for x in whole.levels] == [x.n for x in cut.levels] and whole.total == cut.total
    assert max((cut.levels[1].address.parts).tolist()) > 1 and cut.levels[1].left and max(len(x.paths) for x in whole.levels[1:]) < min(len(x.paths) for x in cut.levels[1:])
    for a, b in zip(*(ngram_lm.scored(table(spark, rows), m).collect() for m in (whole, cut)), strict=True):
        assert (a.doc_id, a.n_known, a.base_score) == (b.doc_id, b.n_known, b.base_score) and a["score"] == pytest.approx(b["score"], abs=1e-3)
    level = cut.levels[1].open()
    for i in cut.levels[1].paths:
        file, n = level.segment(i), int(cut.levels[1].sizes[i])
        begin, end = file.children(np.arange(cut.levels[1].address.contexts(i)))
        assert begin[0] == 0 and end[-1] == n and (end >= begin).all() and (begin[1:] == end[:-1]).all()


def test_order_of_wide_keys():
    draw = np.random.Generator(np.random.PCG64(1))
    segment, key = draw.integers(0, 300, 2000), draw.integers(0, 1 << 62, 2000, dtype=np.uint64)
    for width, keys in ((62, key), (20, key >> np.uint64(42))):
        order = ngram_lm.in_order(segment, keys, width)
        assert [(segment[i], keys[i]) for i in order] == sorted(zip(segment.tolist(), keys.tolist(), strict=True))


def test_words_with_one_polynomial_hash_are_two_words(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    model = ngram_lm.train(table(spark, [(1, word), (2, "x " + word)]))
    got = ngram_lm.scored(table(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]), model).collect()
    assert [r.n_known for r in got] == [2, 1]


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary, the end and one unknown word, after every kind of context."""
    import pyarrow as pa

    from rangeloom.llm.common import texts_of

    model = ngram_lm.train(table(spark, [(1, "a b c a b d a b c"), (2, "b c a"), (3, "d d d a")]))
    levels = [x.open() for x in model.levels]
    for context in ("", "a ", "a b ", "b c ", "d d ", "zz ", "a zz "):
        texts = texts_of(pa.array([context + x for x in ("a", "b", "c", "d", "unknown", "")]))
        tokens = ngram_lm.Tokens(texts, levels[0])
        _, log = model.score(tokens, levels)
        assert (10 ** log[tokens.begin[:-1] + len(words(context))]).sum() == pytest.approx(1, abs=2e-3)


def test_held_out_score_beats_the_base(spark, sf):
    rows = queries.op8_lm_scoring(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r["score"] for r in held) > sum(r.base_score for r in held)


def test_sql_is_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and sql.OP2 in queries.oracle_sql().values()
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
