"""Operators that compare documents with each other or with a benchmark, against brute force on small fixtures."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.llm import decontaminate, ngram_join, substring_dedup
from covelight.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text, k):
    words = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(docs, k, percent):
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def family(rng, base, n, most_edits):
    """Near copies of a text: each with up to most_edits words changed, dropped or doubled."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [words[i], words[i]], [f"new{rng.randrange(9)}"]])
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for length, n, edits in ((120, 90, 6), (60, 60, 4), (25, 40, 3), (9, 30, 1)):
        texts += family(rng, [rng.choice(vocabulary) for _ in range(length)], n, edits)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += ["", " \n", None, "one", "one", "One two", "one TWO", "a b c", "a b c", "ÀB c d", "àb c d", "x " * 5000]
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 55)])
def test_ngram_join_against_brute_force(spark, near_copies, k, percent):
    df = spark.createDataFrame(near_copies, "doc_id long, text string").withColumns({"sid": F.lit(1), "component_id": F.lit("x"), "n": F.lit(0)}).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(df, k=k, threshold=percent / 100).collect()}
    assert got == brute_components(near_copies, k, percent)


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join_ngrams(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (7, None)]
    got = sorted(map(tuple, ngram_join.join_ngrams(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (None, 0, None), (7, 0, 7)], key=str)
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(spark.createDataFrame(rows, schema)).collect()) == ["2", "7", "None", "None"]


def test_bands_hold_every_linked_size():
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(55, 100)):
        starts = ngram_join.bands(t)
        for a in range(1, 400):
            b = int(a / t)
            x, y = (int(np.searchsorted(starts, n, "right")) - 1 for n in (a, b))
            assert y - x in (0, 1)
            d, pieces = ngram_join.band_bound(t, x)
            assert d >= (1 - t) / (1 + t) * (a + b) - 1 and pieces > d


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 60, 700):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 2 // 3], rng.integers(0, 2**63, n // 2).astype(np.uint64)])
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        words = min(len(x), len(y))
        stacked = ngram_join._stack([x.tobytes(), y.tobytes()], words)
        assert np.bitwise_count(stacked[0] ^ stacked[1]).sum() <= len(np.setxor1d(a, b))


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (100, 101), (101, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_strip(docs, size):
    seen, out = set(), {}
    for d, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out[d] = len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("size", "gram", "bits"), [(20, 8, 28), (20, 8, 16), (5, 3, 16), (4, 4, 20)])
def test_substring_dedup_against_brute_force(spark, size, gram, bits):
    rng = random.Random(size + bits)
    vocabulary = ["a", "b", "cc", "é"] + [f"v{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 70))) for _ in range(9)]
    docs = []
    for i in range(120):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), "z " * rng.randrange(60)]) for _ in range(4)]
        docs.append((i * 7 % 121, "\n".join(parts)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, ""), (503, None), (504, "short one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc_key": F.lit("x"), "lost": F.lit(1)}).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(df, size=size, gram=gram, max_bits=bits).collect()}
    assert got == brute_strip(docs, size)


def test_substring_dedup_edges(spark):
    schema, text = "doc_id long, text string", " ".join(map(str, range(30)))
    assert substring_dedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, text), (1, text), (None, text), (2, "x " + text)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]


def test_rows_without_an_id_are_documents_of_their_own(spark):
    schema = "doc_id long, text string"
    a, c = " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    run = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept_text"][:2], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert run([(1, a), (None, a), (None, c)]) == [(False, 1, "a0", 0), (True, 0, "", 30), (True, 0, "c0", 0)]
    assert run([(1, a), (None, a), (None, c), (None, c), (None, None)]) == [(False, 1, "a0", 0), (True, 0, "", 0), (True, 0, "", 30), (True, 0, "", 30), (True, 0, "c0", 0)]
    assert run([(2**63 - 1, a), (5, a), (None, a + " x"), (None, c)]) == [(False, 5, "a0", 0), (False, 2**63 - 1, "", 30), (True, 0, "c0", 0), (True, 0, "x", 30)]
    assert run([(None, a), (None, a)]) == [(True, 0, "", 30), (True, 0, "a0", 0)]


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_leaks_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    letters = "abcde "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(5, 90)))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "abc")]
    docs = []
    for i in range(50):
        passage = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(9)):
            passage[rng.randrange(len(passage))] = rng.choice(["", "x", "ab"])
        fill = lambda: "".join(rng.choice("fghij ") for _ in range(rng.randrange(60)))
        docs.append((i, fill() + " " + "".join(passage).upper() + "\n" + fill()))
    docs += [(90, None), (91, ""), (92, items[0][1] * 50), (92, items[0][1] * 50)]
    want = {}
    for d, text in docs:
        text = decontaminate.normalise(text or "")
        want[d] = {}
        for i, item in items:
            item = decontaminate.normalise(item or "")
            k = int(0.08 * len(item))
            if i is None or not item:
                continue
            if k == 0:
                if b" " + item + b" " in b" " + text + b" ":
                    want[d][i] = 0
            elif (e := edit_distance_in(item, text)) <= k:
                want[d][i] = e
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaked", F.lit("x"))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, items_df, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["item_ids"] == sorted(want[r["doc_id"]]) and r["leaked"] == bool(want[r["doc_id"]])
        assert all(want[r["doc_id"]][i] <= d for i, d in zip(r["item_ids"], r["distances"], strict=True))
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(df, items_df, block_bytes=block_bytes).collect()}
    assert kept == {d for d in want if not want[d]}


def test_least_distances_and_items_without_an_id(spark):
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(40, 150)))) for i in range(6)]
    docs = []
    for d in range(30):
        parts = []
        for edits in rng.sample(range(10), 4):
            near = list(decontaminate.normalise(items[d % 6][1]).decode())
            for _ in range(edits):
                near[rng.randrange(len(near))] = "x"
            parts += ["".join(near), "fghij " * rng.randrange(40)]
        docs.append((d, " ".join(parts)))
    items_df = spark.createDataFrame([*items, (None, "nameless passage")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (90, "a nameless passage here"), (91, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["distances"], strict=True)) for r in decontaminate.find_leaks(df, items_df).collect()}
    for d, text in docs:
        least = {i: edit_distance_in(decontaminate.normalise(t), decontaminate.normalise(text)) for i, t in items}
        assert got[d] == {i: e for i, e in least.items() if e <= int(0.08 * len(decontaminate.normalise(items[i][1])))}
    assert got[90] == got[91] == {}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, items_df).collect()} == {91, *(d for d, _ in docs if not got[d])}


def test_leaks_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_leaks(docs, items.limit(0)).collect()] == [(1, False, [], [])]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == 1


def test_queries_agree_with_sql(spark, sf):
    import duckdb

    from covelight.llm import queries

    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(repr, want.fetchall())) == sorted(map(repr, map(tuple, got.select(*names).collect())))


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline
    import sentencepiece
    from covelight.llm import language_id, queries, secret_scan

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"] for r in language_id.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    left = [(d, texts[d]) for d in sorted(known)]
    component = brute_components(left, 5, 80)
    left = [(d, t) for d, t in left if component[d][1] == d]
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher([(i, t) for i, t in enumerate(items)], 0.08)
    assert all(any(t in decontaminate.normalise(x) for t in items) <= bool(matcher.find(decontaminate.normalise(x))) for _, x in left)
    left = [(d, t) for d, t in left if not matcher.find(decontaminate.normalise(t))]
    patterns = [(re.compile(r.pattern), re.compile(r.strict)) for r in secret_scan.RULES]

    def clean(text):
        spans = sorted((m.start(), m.end()) for p, strict in patterns for m in p.finditer(text) if strict.fullmatch(m[0]))
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    want = {d: hashlib.sha256(str(sp.encode(clean(t))).encode()).hexdigest() for d, t in left}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: hashlib.sha256(str(list(r["ids"])).encode()).hexdigest() for r in got} == want
    assert all(r["round_trip"] for r in got)
