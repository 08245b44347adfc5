"""Token ids of documents in binary files, compressed by Re-Pair grammars and readable from any id on.

write_shards puts the ids of all documents, in ascending order, into one file a task; read_documents and read_range get
them back. A file is a row of segments and a footer:

    segment   rules (left, right: u32 each), expansion lengths of the rules (u32), ids before every STEP-th symbol (u32),
              symbols (u16, or u32 where they need it)
    footer    segment directory (7 x u64 each: place, ids before it, ids, rules, symbols, bytes a symbol, number of the
              first rule), document ids (i64), null marks (u8), ids before each document and in all (u64)
    trailer   place of the footer, segments, documents, ids, end id (5 x u64), the mark COVLRP01

All numbers are little-endian. In a segment, symbols below the vocabulary's size are token ids, the next one is a
document's end, and those from there on are rules. A segment holds SEGMENT_IDS ids, whatever documents they belong to, so
memory depends on neither the table nor a document. No rule goes across a document's end.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

SEGMENT_IDS, STEP, LEAST, FALL, WORTH = 1 << 20, 1024, 16, 64, 32
MARK = b"COVLRP01"
#: A worker remembers the ids of so many pieces of at most so many characters each.
WORDS, WORD_CHARS = 1 << 20, 48
HASHES = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)  # odd, for multiplicative hashing


# Encoding

#: Fixed values of the word tokenizer: how it normalises and cuts texts.
NORMAL = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which the cutting rule is short: ASCII, Latin letters that are composed and change case one by one, and
#: common punctuation. No other letters, digits or white space are among them, by Python's rules either.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u012f\u0131-\u017e"
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026]*")
PIECE = re.compile(f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r {LETTERS}0-9]+")
SPACE = re.compile("[\t-\r ]+")


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    """The tokenizer of a JSON text, and whether it normalises and cuts as NORMAL and PATTERN say."""
    from tokenizers import Tokenizer

    rules = json.loads(text)
    normal, cut = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    first = (cut.get("pretokenizers") or [{}])[0]
    return Tokenizer.from_str(text), steps == NORMAL and (first.get("pattern") or {}).get("Regex") == PATTERN


_WORKER: dict[str, dict[str, bytes]] = {}


class Encoder:
    """Ids of whole texts by the tokenizers library, without special tokens added.

    A tokenizer that cuts words as PATTERN says, and never looks across them, sees each distinct word once: texts of PLAIN
    characters are cut here by the same rule, other texts at white space alone. Any other tokenizer gets whole texts.
    """

    def __init__(self, model: str):
        tokenizer, self.by_word = _tokenizer(model)
        self.size = tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.tokenizer, self.known = tokenizer, _WORKER.setdefault(hashlib.sha256(model.encode()).hexdigest(), {})
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def _pieces(self, text: str, odd: set[str]) -> list[str]:
        """The pieces of a text; those that PIECE did not cut go into `odd` as well."""
        special = any(x in text for x in self.special)
        if not special and PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        out = []
        for w in SPACE.split(text):
            if not special and PLAIN.fullmatch(w):
                out += PIECE.findall(w.lower())
            else:
                out.append(w)
                odd.add(w)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces cut by PIECE, which the tokenizer leaves whole: encoded as one text and told apart by their numbers."""
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        words = np.array(found.word_ids, np.int64)
        ends = np.searchsorted(words, np.arange(len(pieces)), "right")
        if len(pieces) and (ends[-1] != len(words) or (np.diff(ends, prepend=0) <= 0).any()):
            return dict(zip(pieces, self._whole(pieces), strict=True))
        ids, at = np.array(found.ids, self.kind).tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
        return dict(zip(pieces, map(ids.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(x, self.kind) for x in self._whole(texts)]
        if len(self.known) > WORDS:
            self.known.clear()
        odd: set[str] = set()
        pieces = [self._pieces(t, odd) for t in texts]
        ids = [list(map(self.known.get, p)) for p in pieces]  # one look-up a piece; gaps are filled from what is learnt
        gaps = [[i for i, x in enumerate(k) if x is None] if None in k else () for k in ids]
        new = {p[i] for p, g in zip(pieces, gaps, strict=True) for i in g}
        rest = list(new & odd)
        found = (self._encoded(list(new - odd)) if new - odd else {}) | dict(zip(rest, self._whole(rest), strict=True))
        self.known.update(found if all(len(w) <= WORD_CHARS for w in found) else {w: x for w, x in found.items() if len(w) <= WORD_CHARS})
        for p, k, g in zip(pieces, ids, gaps, strict=True):
            for i in g:
                k[i] = found[p[i]]
        return [np.frombuffer(b"".join(k), self.kind) for k in ids]


# The grammar


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys that occur `least` times or more, ascending, and how often."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    often = counts >= least
    return keys[first[often]], counts[often]


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number below 2^20 for each pair of symbols."""
    return ((left.astype(np.uint32) * HASHES[0] ^ right.astype(np.uint32) * HASHES[1]) >> np.uint32(12)).astype(np.int64)


def compress(symbols: np.ndarray, size: int, most: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of the Re-Pair grammar of one segment; `size` is the end mark, rule k is symbol size + 1 + k.

    Each round counts neighbouring pairs and replaces those with about a FALL-th of the top pair's count or more (`least`
    at least), most frequent first, ties by symbols. Where two occurrences overlap, the more frequent pair gets its place; in
    a run of one symbol every second pair is taken. Rounds end when `most` rules are made or pairs that
    may occur `least` times are less than one in WORTH.
    A table of counts by hash, never too low, leaves few pairs to be counted exactly.
    """
    s, rules = symbols.astype(np.uint32), np.zeros((0, 2), np.int64)
    none = np.iinfo(np.int32).max
    while len(s) > 1 and len(rules) < most:
        spots = _slots(s[:-1], s[1:])
        ends = np.flatnonzero(s == size)
        spots[ends[ends < len(spots)]] = spots[ends[ends > 0] - 1] = 1 << 20
        table = np.bincount(spots, minlength=(1 << 20) + 1)
        table[-1] = 0
        floor = max(least, int(table.max()) // FALL)
        while True:
            at = np.flatnonzero((table >= floor)[spots])
            keys = s[at].astype(np.int64) << 32 | s[at + 1]
            pairs, counts = _frequent(keys, floor) if len(at) else (keys, keys)
            worth = len(pairs) and len(at) * WORTH >= len(s)
            if worth or floor == least:
                break
            floor = max(least, floor // FALL)
        if not worth:
            break
        chosen = pairs[np.lexsort((pairs, -counts))][: most - len(rules)]
        slot = _slots(chosen >> 32, chosen & 0xFFFFFFFF)
        ranks = np.full(1 << 20, none, np.int32)
        ranks[slot[::-1]] = np.arange(len(chosen) - 1, -1, -1)  # of two pairs in a slot the more frequent one; the other has its turn later
        rank = ranks[spots[at]]
        hit = rank != none
        hit[hit] = chosen[rank[hit]] == keys[hit]
        r = np.full(len(s) + 1, none, np.int32)  # r[i + 1]: the rank of the pair at i
        r[at[hit] + 1] = rank[hit]
        same = np.flatnonzero((r[1:] == r[:-1]) & (r[1:] != none))
        if len(same):  # pairs of a run: keep every second one
            begins = np.concatenate(([True], same[1:] != same[:-1] + 1))
            start = same[np.flatnonzero(begins)][np.cumsum(begins) - 1]
            r[same[(same - start) % 2 == 0] + 1] = none
        spot = at[hit]
        mine = r[spot + 1]
        take = spot[(mine != none) & (mine < r[spot]) & (mine < r[spot + 2])]
        used = np.bincount(r[take + 1], minlength=len(chosen))
        kept = used >= max(2, least // 2)
        if not kept.any():
            break
        number = np.cumsum(kept) - 1 + size + 1 + len(rules)
        take = take[kept[r[take + 1]]]
        s[take] = number[r[take + 1]]
        new = chosen[kept]
        rules = np.concatenate((rules, np.stack((new >> 32, new & 0xFFFFFFFF), 1)))
        stay = np.ones(len(s), bool)
        stay[take + 1] = False
        s = s[stay]
    return s, rules


def rule_lengths(rules: np.ndarray, size: int) -> np.ndarray:
    """How many ids each rule stands for; a rule's parts come before it."""
    lengths = np.ones(size + 1 + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[size + 1 + k] = lengths[a] + lengths[b]
    return lengths[size + 1 :]


class Grammar:
    """Expands symbols: every rule's ids lie in one array, `lengths` long from `places` on."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, size: int, end_id: int):
        terminals = np.arange(size + 1)
        terminals[size] = end_id
        self.lengths = np.concatenate((np.ones(size + 1, np.int64), lengths))
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        self.flat[: size + 1] = terminals
        depth = [0] * (size + 1)
        for a, b in rules.tolist():
            depth.append(1 + max(depth[a], depth[b]))
        level = np.array(depth[size + 1 :], np.int64)
        for step in range(1, int(level.max(initial=0)) + 1):  # all rules of one depth at a time
            k = np.flatnonzero(level == step)
            left, right = rules[k, 0], rules[k, 1]
            to = self.places[size + 1 + k]
            self._copy(left, to)
            self._copy(right, to + self.lengths[left])

    def _copy(self, symbols: np.ndarray, to: np.ndarray) -> None:
        lengths = self.lengths[symbols]
        before = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum()))
        self.flat[np.repeat(to - before, lengths) + step] = self.flat[np.repeat(self.places[symbols] - before, lengths) + step]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.places[symbols] - before, lengths) + np.arange(int(lengths.sum()))]


# Files


def _file_system(path: str):
    """The file system and the path in it; Hadoop's file:/x is a local path."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


class ShardWriter:
    """One file, written from its beginning to its end."""

    def __init__(self, path: str, size: int, end_id: int, segment_ids: int = SEGMENT_IDS):
        system, place = _file_system(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out, self.size, self.end_id, self.segment_ids = system.open_output_stream(place), size, end_id, segment_ids
        self.place = self.ids = self.waiting = 0
        self.parts: list[np.ndarray] = []
        self.segments: list[tuple[int, ...]] = []
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.starts = [0]

    def _put(self, *arrays: np.ndarray | bytes) -> None:
        for x in arrays:
            data = x if isinstance(x, bytes) else x.tobytes()
            self.out.write(data)
            self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """The ids of one document, without its end id."""
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids) + 1)
        self.parts += [ids, np.array([self.size])]
        self.waiting += len(ids) + 1
        if self.waiting >= self.segment_ids:
            whole = np.concatenate(self.parts).astype(np.int64)
            done = self.waiting // self.segment_ids * self.segment_ids
            for a in range(0, done, self.segment_ids):
                self._segment(whole[a : a + self.segment_ids])
            self.parts, self.waiting = [whole[done:]], self.waiting - done

    def _segment(self, ids: np.ndarray) -> None:
        room = 1 << 16 if (1 << 16) - self.size > 4096 else 1 << 31  # two bytes a symbol where that leaves enough rules
        symbols, rules = compress(ids, self.size, min(room - self.size - 1, len(ids)))
        lengths = rule_lengths(rules, self.size)
        width = 2 if self.size + 1 + len(rules) <= 1 << 16 else 4
        each = np.concatenate((np.ones(self.size + 1, np.int64), lengths))[symbols]
        self.segments.append((self.place, self.ids, len(ids), len(rules), len(symbols), width, self.size + 1))
        self._put(rules.astype("<u4"), lengths.astype("<u4"), (np.cumsum(each) - each)[::STEP].astype("<u4"), symbols.astype(f"<u{width}"))
        self.ids += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._segment(np.concatenate(self.parts).astype(np.int64))
        footer = self.place
        self._put(np.array(self.segments, "<u8"), np.array(self.doc_ids, "<i8"), np.array(self.nulls, "u1"), np.array(self.starts, "<u8"))
        self._put(struct.pack("<5Q", footer, len(self.segments), len(self.doc_ids), self.ids, self.end_id), MARK)
        self.out.close()


class ShardReader:
    """Reads ids of one file; a range costs the rules of its segments and the symbols around it."""

    def __init__(self, path: str):
        system, place = _file_system(path)
        self.file = system.open_input_file(place)
        tail = 40 + len(MARK)
        end = self.file.size() - tail
        data = self.file.read_at(tail, end)
        if end < 0 or data[40:] != MARK:
            raise ValueError(f"{path} is no whole shard file")
        footer, n, self.n_docs, self.n_ids, self.end_id = struct.unpack("<5Q", data[:40])
        data = self.file.read_at(end - footer, footer)
        self.segments = np.frombuffer(data, "<u8", 7 * n).reshape(n, 7).astype(np.int64)
        at = 56 * n
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(data, "u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)
        self._held: tuple[int, Grammar, np.ndarray] | None = None

    def _grammar(self, k: int) -> tuple[Grammar, np.ndarray]:
        if self._held is None or self._held[0] != k:
            place, _, _, n_rules, n_symbols, _, first = self.segments[k].tolist()
            n_marks = -(-n_symbols // STEP)
            data = self.file.read_at(12 * n_rules + 4 * n_marks, place)
            rules = np.frombuffer(data, "<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
            lengths = np.frombuffer(data, "<u4", n_rules, 8 * n_rules).astype(np.int64)
            marks = np.frombuffer(data, "<u4", n_marks, 12 * n_rules).astype(np.int64)
            self._held = (k, Grammar(rules, lengths, first - 1, self.end_id), marks)
        return self._held[1:]

    def _part(self, k: int, a: int, b: int) -> np.ndarray:
        """Ids a to b of segment k: only the stretch of symbols between the marks around them is read and expanded."""
        place, _, _, n_rules, n_symbols, width, _ = self.segments[k].tolist()
        grammar, marks = self._grammar(k)
        i, j = int(np.searchsorted(marks, a, "right")) - 1, int(np.searchsorted(marks, b, "left"))
        lo, hi = i * STEP, min(j * STEP, n_symbols)
        data = self.file.read_at(width * (hi - lo), place + 12 * n_rules + 4 * len(marks) + width * lo)
        return grammar.expand(np.frombuffer(data, f"<u{width}").astype(np.int64))[a - marks[i] : b - marks[i]]

    def ids(self, a: int, b: int) -> Iterator[np.ndarray]:
        """Ids a to b of the file, in pieces of a segment at most."""
        for k, (_, before, n, *_) in enumerate(self.segments.tolist()):
            if a < before + n and b > before:
                yield self._part(k, max(a - before, 0), min(b - before, n))

    def documents(self) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
        """(doc_id, ids before it in the file, number of ids, its ids in pieces), each segment read once."""
        waiting: list[np.ndarray] = []
        d = read = 0
        for piece in self.ids(0, self.n_ids):
            at = 0
            while d < self.n_docs and self.starts[d + 1] <= read + len(piece):
                end = int(self.starts[d + 1]) - read
                yield None if self.nulls[d] else int(self.doc_ids[d]), int(self.starts[d]), int(self.starts[d + 1] - self.starts[d]), [*waiting, piece[at:end]]
                waiting, at, d = [], end, d + 1
            if at < len(piece):
                waiting.append(piece[at:])
            read += len(piece)


# Spark


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id to each and writes all in ascending order of the ids below `path`.

    Returns the index, also written to path/index: part, file, n_docs, n_ids and start (ids in all files before), a row a
    file. A null text counts as empty and has its end id alone; null ids come first; rows of one id go by their texts; an
    empty table gives an empty index; other columns are not read. Rows are dealt by ranges of id and text, so neither
    a hot id nor a hot source meets in one task. A file has a name of its own for each attempt and counts once the index
    names it, so a lost or repeated task leaves a stray file at most. path: any place that pyarrow's file systems and
    Spark both reach. The tokenizer's file is read on the driver and broadcast (1 to 2 MB).
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, name = Encoder(model.value), None, ""
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                if writer is None:
                    name = f"{path}/shards/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rp"
                    writer = ShardWriter(name, encoder.size, end_id, segment_ids)
                writer.add(doc_id, found)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [name], "n_docs": pa.array([len(writer.doc_ids)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long").write.parquet(f"{path}/written")
    # a row a task that wrote, so one task can add them up
    files = spark.read.parquet(f"{path}/written")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, file string, n_docs long, n_ids long, start long").parquet(f"{path}/index")


def _each_file(index: DataFrame) -> DataFrame:
    """The index with few files a task."""
    files, cores = index.count(), index.sparkSession.sparkContext.defaultParallelism
    return index.repartition(max(1, min(files, max(2 * cores, files // 16))), "file")


def read_documents(index: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, an array) of every document, decoded from the files of an index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for doc_id, before, n, pieces in ShardReader(name).documents():
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4", copy=False).tobytes(), crc)
                    rows.append((doc_id, first + before, n, crc, np.concatenate(pieces) if ids else None))
                    size += n if ids else 1
                    if size >= SEGMENT_IDS:
                        yield _rows(rows, ids)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, ids)

    return _each_file(index).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def _rows(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    columns = {k: pa.array(x, pa.int64()) for k, x in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*(r[:4] for r in rows), strict=True), strict=True)}
    if ids:
        ends = np.cumsum([0, *(r[2] for r in rows)]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in rows]).astype(np.int32)))
    return pa.RecordBatch.from_pydict(columns)


def read_range(index: DataFrame, start: int, n: int) -> DataFrame:
    """(start, ids): ids start to start + n of the whole sequence, in pieces of one segment at most; only the symbols around
    them are read. What lies outside the sequence is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = ShardReader(name)
                a, b = max(start - first, 0), min(start + n - first, reader.n_ids)
                for piece in reader.ids(a, b):
                    yield pa.RecordBatch.from_pydict({"start": pa.array([first + a], pa.int64()), "ids": pa.array([piece.astype(np.int32)], pa.list_(pa.int32()))})
                    a += len(piece)

    some = index.where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
    return _each_file(some).mapInArrow(read, "start long, ids array<int>")


def new_place(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/token-shards-{uuid.uuid4().hex}"
