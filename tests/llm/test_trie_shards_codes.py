"""The token shards, the conversation trie and the vector codes against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from covelight.llm import conversation_trie, queries, token_shards, vector_codes

WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


# Token shards


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_FILE)


def plain_ids(tokenizer, texts, end=1):
    return [[*x.ids, end] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain_rows(tokenizer, rows, end=1):
    out, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, _), ids in zip(ordered, plain_ids(tokenizer, [t for _, t in ordered], end), strict=True):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


ODD = [
    "", "  \t\n ", "a", "A b\x1cc\x85d\xa0e f", "can't STOP'll x's", "<|endoftext|> <|startoftext|>x", "é é ́x ﬁ Ǆ İ ς Σ", "🙂" * 40, "x" * 3000,
    "tok " * 5000, "日本語 テキスト 한국어", "1234 5.6e7 !!??", "\u0000\u0001", " ́a",
]


def test_word_by_word_encoding_is_the_librarys(tokenizer):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aàÀ'ßȩ́ \t\n\x1c\xa0.,1²Ⅳ日ñ🙂<|>") for _ in range(rng.randrange(60))) for _ in range(400)]
    encoder = token_shards.Encoder(open(queries.WORD_FILE, encoding="utf-8").read())
    assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1] for x in plain_ids(tokenizer, texts)]


@pytest.mark.parametrize("ids", [[], [3], [3] * 1001, [1, 2] * 300, list(range(50)) * 30, [5, 5, 7] * 200 + [9, 5, 5] * 100])
def test_grammar_expands_to_what_it_was_made_from(ids):
    ids = np.array(ids, np.int64)
    symbols, rules = token_shards.compress(ids, 60, 500)
    lengths = token_shards.rule_lengths(rules, 60)
    assert token_shards.Grammar(rules, lengths, 60, 1).expand(symbols).tolist() == ids.tolist()
    assert len(ids) < 300 or len(symbols) < len(ids) / 4


def test_rules_stay_within_documents_and_their_number():
    ids = np.array(([4, 5, 60] * 40 + [5, 4, 60] * 40) * 5)
    symbols, rules = token_shards.compress(ids, 60, 500)
    assert 60 not in rules and (symbols == 60).sum() == 400
    rng = np.random.default_rng(1)
    symbols, rules = token_shards.compress(rng.integers(0, 9, 20_000), 60, 25)
    assert len(rules) == 25


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_shards_give_back_all_documents_and_any_range(spark, tokenizer, tmp_path, segment):
    rng = random.Random(segment)
    rows = [(i * 3, rng.choice(ODD)) for i in range(60)] + [(None, "null id"), (7, None), (10**15, "last " * 900), (-4, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    index = token_shards.write_shards(docs, str(tmp_path / "out"), queries.WORD_FILE, segment_ids=segment)
    got = sorted((tuple(r) for r in token_shards.read_documents(index).collect()), key=lambda r: r[1])
    want = plain_rows(tokenizer, rows)
    assert got == want
    whole = [x for r in want for x in r[4]]
    assert index.agg(F.sum("n_ids")).first()[0] == len(whole)
    for a, n in ((0, 5), (len(whole) - 3, 50), (len(whole) // 2, 1500), (17, 1), (len(whole), 4)):
        parts = token_shards.read_range(token_shards.read_index(spark, str(tmp_path / "out")), a, n).orderBy("start").collect()
        assert [x for p in parts for x in p["ids"]] == whole[a : a + n]


def test_repeated_rows_and_an_empty_table(spark, tokenizer, tmp_path):
    rows = [(1, "same text")] * 30 + [(1, "another")] * 3
    index = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), queries.WORD_FILE)
    got = token_shards.read_documents(index, ids=False).orderBy("start").collect()
    assert len(got) == 33 and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    index = token_shards.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), queries.WORD_FILE)
    assert index.count() == 0 and token_shards.read_documents(index).count() == 0


def test_a_file_that_was_not_closed_is_refused(tmp_path):
    (tmp_path / "x.rp").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        token_shards.ShardReader(str(tmp_path / "x.rp"))


def test_token_shards_query(spark, sf, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_token_shards"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [r[:4] for r in plain_rows(tokenizer, rows)]


# Conversation trie


def plain_trie(rows, family=20, most_shared=4):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}:{t[2]}".encode()).digest()))
    built = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % most_shared
        base = c - (c % family if c >= 0 else -(-c % family))
        built[c] = [t[1:] for t in talks.get(base, [])[:h]] + [t[1:] for t in turns[h:]]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    children, below = {}, {p: [0, 0] for p in members}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, m in members.items():
        own = (len(m) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += own
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(df, **more):
    return sorted(tuple(r) for r in conversation_trie.prefix_trie(df, **more).select(TRIE).collect())


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 2), (3, 3)])
def test_trie_of_random_conversations(spark, seed, block):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None])) for c in rng.sample(range(-30, 90), 70) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(40, None, "user", "null turn"), (41, 3, "user", "tie"), (41, 3, "bot", "tie"), (None, 1, "user", "nobody's")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(1), "name": F.lit("x"), "digest": F.lit(0)}).repartition(3)
    assert found_trie(df, block=block) == plain_trie(rows)


def test_trie_of_nested_conversations_with_falling_ids(spark):
    rows = [(100 - n, t, "user", f"turn {t} of all") for n in range(1, 12) for t in range(n)]
    assert found_trie(spark.createDataFrame(rows, TURNS), family=1, most_shared=1, block=4) == plain_trie(rows, 1, 1)


def test_trie_with_hot_nodes_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "HOT_ROWS", 20)
    monkeypatch.setattr(conversation_trie, "PIECE", 16)
    rows = [(c, t, "user", f"say {t}") for c in range(120) for t in range(2 + (c % 10 == 0))]
    assert found_trie(spark.createDataFrame(rows, TURNS), block=2) == plain_trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "only turn")]
    assert found_trie(spark.createDataFrame(rows, TURNS)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == plain_trie(rows)
    assert found_trie(spark.createDataFrame([], TURNS)) == []


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op12_conversation_trie"](spark, sf).select(TRIE).collect()) == plain_trie(rows)


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [int(np.floor(float(x) * 4096)) for x in v]) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not kept:
        return [], ""
    width = len(kept[0][2]) // parts
    kept = [r for r in kept if len(r[2]) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [[near(cut(r[2], p), books[p]) for p in range(parts)] for r in kept]
    errors, out = {}, []
    for r, f in zip(kept, found, strict=True):
        errors[r[1]] = errors.get(r[1], 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    for r, f in zip(kept, found, strict=True):
        out.append((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[r[1]], digest))
    return sorted(out, key=lambda r: (r[0] is None, r)), digest


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType())])


def found_codes(df, **more):
    return sorted((tuple(r) for r in vector_codes.compress_vectors(df, **more).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed, size", [(1, 64), (2, 16), (3, 8), (4, 24)])
def test_codes_of_random_vectors(spark, seed, size):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(150, size)), 2)
    v[50:80] = v[3]
    rows = [(int(i), x.tolist(), None if i % 7 == 0 else int(i % 3)) for i, x in zip(rng.permutation(400)[:150], v, strict=True)]
    rows += [(500, None, 1), (501, [None] * size, 1), (502, [float("nan")] * size, 0), (503, [float("-inf")] * size, 2), (504, [], 1), (505, [1.0], 1), (None, v[9].tolist(), 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"code": F.lit("x"), "error": F.lit(1), "q": F.lit(2)}).repartition(4)
    assert found_codes(df) == plain_codes([r for r in rows if r[0] not in (504, 505)])[0]


def test_codes_of_few_rows_ties_and_none(spark):
    rows = [(i, [float(i % 2)] * 8, i) for i in range(5)]
    assert found_codes(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)[0]
    assert found_codes(spark.createDataFrame([], VECTORS)) == []
    assert found_codes(spark.createDataFrame([(1, None, 1), (2, [1e30] * 8, 1)], VECTORS)) == []


def test_labels_are_joined_by_shuffle_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 2)
    rows = [(i, [i / 50, *[0.5] * 7], i % 6 or None) for i in range(60)]
    assert found_codes(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)[0]


@pytest.mark.parametrize("size, scale", [(8, 300), (8, 1 << 26), (7, 50), (1, 9), (32, 4000)])
def test_bounds_lose_no_nearest_entry(size, scale):
    rng = np.random.default_rng(size)
    entries = rng.integers(-scale, scale, (16, size))
    entries[9] = entries[4]
    u = np.concatenate((rng.integers(-scale, scale, (500, size)), entries, entries + 1, rng.integers(-2, 2, (200, size))))
    index, error, measured = vector_codes.Codebook(entries).nearest(u)
    exact = ((u[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == exact.argmin(1)).all() and (error == exact.min(1)).all()
    assert measured <= len(u) * 17


def test_bounds_leave_most_entries_out_where_groups_lie_apart():
    rng = np.random.default_rng(2)
    entries = np.repeat(np.arange(16) * 1000, 8).reshape(16, 8) + rng.integers(-30, 30, (16, 8))
    u = entries[rng.integers(0, 16, 2000)] + rng.integers(-50, 50, (2000, 8))
    assert vector_codes.Codebook(entries).nearest(u)[2] < 2 * len(u)


def test_codes_decode_to_their_entries(spark, sf):
    rows = vector_codes.quantize(spark.read.parquet(f"{sf}/embeddings.parquet"))
    books = vector_codes.fit(rows, rounds=2)
    got = vector_codes.decode(vector_codes.encode(rows, books), books).join(rows.select("vec_id", "q"), "vec_id").collect()
    for r in got:
        v = np.frombuffer(r["q"], "<i4")
        assert ((v - np.array(r["approximation"]) * 4096) ** 2).sum() == r["error"]


def test_vector_codes_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == plain_codes(rows)[0]
