import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from covelight.llm import wordhash
from covelight.llm.common import blocks, text_blocks, utf8
from covelight.llm.repeat_sketch import Repeats, count, width_for

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t 你.", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_the_contracts_words(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    words = wordhash.words_of(data, offsets)
    got = [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(words.first).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_equal_words_and_windows_have_equal_hashes_anywhere():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "é", "ab"]) for _ in range(40)) for _ in range(20)]
    data, offsets = utf8(pa.array(texts))
    words = wordhash.words_of(data, offsets)
    begin, hashes = wordhash.windows_of(words, 3)
    flat = [w for t in texts for w in t.split()]
    keys = [tuple(flat[b : b + 3]) for b in begin]
    assert len(set(keys)) == len(set(hashes.tolist())) == len(set(zip(keys, hashes.tolist(), strict=True)))


def test_blocks_cover_every_row_once():
    offsets = np.array([0, 5, 5, 300, 301, 302, 700])
    got = list(blocks(offsets, 100))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == 6
    assert sum(b - a for a, b, _, _ in text_blocks(batch(["x"] * 10))) == 10
    assert list(text_blocks(batch([]))) == []


def test_sketch_never_misses_a_repeat(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 5000, 6000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(7)
    for bits in (16, 18):
        seen: Repeats = count(df, lambda b: iter([b.column("k").to_numpy().astype(np.uint64)]), bits, (2, 4))
        values, n = np.unique(keys, return_counts=True)
        level = seen.level(values.astype(np.uint64))
        assert (level >= (n >= 2).astype(int) + (n >= 4)).all()
        assert (level[n == 1] > 0).mean() < 0.2
    assert width_for(0, 27) == 16 and width_for(1e12, 27) == 27
