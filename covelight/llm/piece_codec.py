"""SentencePiece encoding and decoding, with long documents split over tasks by a max-plus scan.

Encoding is a best path over the text: an edge is a piece, a path's weight the sum of its edges'. In a unigram model an
edge weighs its piece's score. In a BPE model an edge weighs nothing, and minus infinity after a piece that byte-pair
merging would not leave before it: a token sequence is the merge result exactly when each neighbouring pair is, so
the one path left is the library's own encoding. Pieces do not reach over the start of a word (checked on
loading), so words are solved once and remembered.

A document over `chunk` characters is cut into chunks at fixed places, also inside words. The state at a cut is the piece that
covers the character before it. Each chunk gives the matrix of best weights from entry to exit states;
matrices combine associatively in max-plus algebra; the scan fixes the state at each cut; then every chunk is
traced back by itself between its two states.

A null text has null ids; an empty one has none. Repeated rows get repeated results. The model file is read once on the driver
and sent to the tasks (a vocabulary, whose size does not follow the data). encode keeps the columns of its input.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_WORDS_KEPT = 400_000
#: Rows whose ids are Python lists at a time.
_ROWS = 256
#: Longer words are solved edge by edge, in time that grows with their length.
_MERGED = 64
State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        value, i, shift = value | (c & 127) << shift, i + 1, shift + 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(tag & 7) or _varint(b, i)
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


class Model:
    """Pieces of a SentencePiece model file with an identity normaliser."""

    def __init__(self, raw: bytes) -> None:
        pieces, self.bpe, self.fallback, self.prefix = [], False, False, True
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.bpe, self.fallback = f.get(3, 1) == 2, bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(1) not in (b"identity", None) or f.get(2) or f.get(4, 1):
                    raise ValueError("only models that leave the text as it is are known")
                self.prefix = bool(f.get(3, 1))
        if any(kind == _USER for *_, kind in pieces):
            raise ValueError("models with pieces set by the user are not known")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == _NORMAL}
        self.unknown = next((i for i, (*_, kind) in enumerate(pieces) if kind == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.least = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.surface = [bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.solved: dict[str, tuple[int, ...]] = {}  # tuples of numbers, which the garbage collector does not follow
        self.weights: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def prepare(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging as such: again and again the best-scored neighbouring pair, the leftmost of equals."""
        parts, get, none = list(text), self.scores.get, -float("inf")
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Would merging leave these two beside each other? before is "" at a beginning."""
        key = before, piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > _WORDS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def sweep(self, text: str, begin: int, stop: int, last: str, weight: float = 0.0) -> dict[int, tuple[float, int, str]]:
        """Best way to each place in (begin, stop] from `begin`, where piece `last` ended: (weight, start, piece)."""
        best: dict[int, tuple[float, int, str]] = {begin: (weight, -1, last)}
        scores, pairs, longest, bpe = self.scores, self.pairs, self.longest, self.bpe
        for end in range(begin + 1, stop + 1):
            found = None
            for start in range(max(begin, end - longest), end):  # longest edge first
                piece = text[start:end]
                if piece not in scores and start < end - 1:
                    continue
                way = best.get(start)
                if way is None:
                    continue
                if bpe:
                    fits = pairs.get((way[2], piece))
                    if fits or (fits is None and self.follows(way[2], piece)):
                        found = way[0], start, piece
                        break
                else:
                    total = way[0] + scores.get(piece, self.least)
                    if found is None or total > found[0]:
                        found = total, start, piece
            if found:
                best[end] = found
        return best

    def ids_of(self, piece: str) -> list[int]:
        at = self.ids.get(piece)
        if at is not None:
            return [at]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.fallback and self.bytes else [self.unknown]

    def trace(self, best: dict[int, tuple[float, int, str]], end: int, begin: int) -> list[int]:
        pieces = []
        while end > begin:
            _, end, piece = best[end]
            pieces.append(piece)
        return [i for p in reversed(pieces) for i in self.ids_of(p)]

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a word; its weight, which only unigram models have, is kept beside them."""
        known = self.solved.get(text)
        if known is None:
            if len(self.solved) > _WORDS_KEPT:
                self.solved.clear()
                self.weights.clear()
            if self.bpe and len(text) <= _MERGED:  # a short word's one path, found by merging itself
                known = tuple([i for p in self.merged(text) for i in self.ids_of(p)])
            else:
                best = self.sweep(text, 0, len(text), "")
                known = tuple(self.trace(best, len(text), 0))
                if not self.bpe:
                    self.weights[text] = best[len(text)][0]
            self.solved[text] = known
        return known

    def weight(self, text: str) -> float:
        self.word(text)
        return self.weights.get(text, 0.0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        solved, word = self.solved, self.word
        for w in self.words.findall(self.prepare(text)):
            out += solved.get(w) or word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return (raw[1:] if self.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")

    # One chunk [begin, end) of a text; places count from the window's start, which is `offset` in the whole text.

    def states(self, text: str, cut: int) -> list[State]:
        """The pieces that may cover the character before `cut`."""
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in range(cut, min(len(text), s + self.longest) + 1) if e - s == 1 or text[s:e] in self.ids]

    def _word_starts(self, text: str, begin: int, end: int) -> list[int]:
        return [m.start() for m in self.words.finditer(text) if begin <= m.start() < end and (m.start() == 0 or text[m.start() - 1] != SPACE)]

    def _exits(self, text: str, best: dict[int, tuple[float, int, str]], end: int) -> dict[State, float]:
        """Exit states that a sweep up to the cut reaches, with their weights."""
        exits: dict[State, float] = {}
        for s, e in self.states(text, end):
            if s in best:
                piece = text[s:e]
                if not self.bpe or self.follows(best[s][2], piece):
                    exits[s, e] = best[s][0] + (0.0 if self.bpe else self.scores.get(piece, self.least))
        return exits

    def transfer(self, text: str, begin: int, end: int, first: bool) -> Matrix:
        """Weights from each entry state to each exit state. From the first word start on all entries share one way."""
        heads = self._word_starts(text, begin, end)
        tails: dict[int, dict[State, float]] = {}

        def tail(k: int) -> dict[State, float]:
            if k not in tails:
                inside = 0.0 if self.bpe else sum(self.weight(text[a:b]) for a, b in zip(heads[k:], heads[k + 1 :], strict=False))
                tails[k] = {v: inside + w for v, w in self._exits(text, self.sweep(text, heads[-1], end, ""), end).items()}
            return tails[k]

        out: Matrix = {}
        for u in [(begin, begin)] if first else self.states(text, begin):
            if u[1] >= end > u[0]:  # the piece reaches over the whole chunk
                out[u] = {u: 0.0}
                continue
            k = bisect_left(heads, u[1])
            if k == len(heads):
                row = self._exits(text, self.sweep(text, u[1], end, text[u[0] : u[1]]), end)
            else:
                best = self.sweep(text, u[1], heads[k], text[u[0] : u[1]])
                row = {v: best[heads[k]][0] + w for v, w in tail(k).items()} if heads[k] in best else {}
            if row:
                out[u] = row
        return out

    def backtrace(self, text: str, begin: int, end: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces after `entry` up to `leave`, which is included."""
        if entry == leave:
            return []
        heads, at, last = self._word_starts(text, begin, end), entry[1], text[entry[0] : entry[1]]
        k, out = bisect_left(heads, at), []
        if k < len(heads):
            out += self.trace(self.sweep(text, at, heads[k], last), heads[k], at)
            for a, b in zip(heads[k:], heads[k + 1 :], strict=False):
                out += self.word(text[a:b])
            at, last = heads[-1], ""
        out += self.trace(self.sweep(text, at, leave[0], last), leave[0], at)
        return out + self.ids_of(text[leave[0] : leave[1]])


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: best weights through the state between."""
    out: Matrix = {}
    for u, row in a.items():
        best: dict[State, float] = {}
        for mid, w in row.items():
            for v, x in b.get(mid, {}).items():
                if v not in best or w + x > best[v]:
                    best[v] = w + x
        if best:
            out[u] = best
    return out


def scan_states(matrices: list[Matrix], length: int) -> list[tuple[State, State]]:
    """(entry, exit) of each chunk on the best path that ends at `length`, by a scan over a balanced tree: products of
    neighbours go up level by level, then each node hands its children the state between them."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([compose(*low[i : i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    (start, last) = next(iter(levels[-1][0].items()))
    spans = [(start, max((v for v in last if v[1] == length), key=lambda v: (last[v], -v[0])))]
    for low in reversed(levels[:-1]):
        below = []
        for i, (entry, leave) in enumerate(spans):
            if 2 * i + 1 == len(low):
                below.append((entry, leave))
                continue
            left, right = low[2 * i][entry], low[2 * i + 1]
            middle = max((m for m in left if leave in right.get(m, {})), key=lambda m: (left[m] + right[m][leave], -m[0]))
            below += [(entry, middle), (middle, leave)]
        spans = below
    return spans


def combined(matrices: list[Matrix]) -> Matrix:
    return reduce(compose, matrices)


_models: dict[str, Model] = {}


def _model(shared) -> Model:
    digest, raw = shared.value
    if digest not in _models:
        _models.clear()
        _models[digest] = Model(raw)
    return _models[digest]


def _share(df: DataFrame, model_file: str):
    """(digest, bytes) of the model's file, read by the driver: a file of a few MB whatever the input."""
    with open(model_file, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def _free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_CHUNKS = "key long, number int, first long, before int, size int, length long, window string"
_STATE = "struct<s:long,e:long>"


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, chunk: int = 16_384) -> DataFrame:
    """df with the column `ids_col` (array of int; replaces one of that name). check_col, where given, says whether the ids
    decode to the text again (the sign for a space, U+2581, taken as one; null for null)."""
    shared = _share(df, model_file)
    df = df.drop(*[c for c in (ids_col, check_col) if c in df.columns])
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(check_col, T.BooleanType())] if check_col else [])
    schema = T.StructType([*df.schema.fields, *added])
    long = F.coalesce(F.length(text_col) > chunk, F.lit(False))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                texts = batch.column(text_col).to_pylist()
                ids = [None if t is None else model.encode(t) for t in texts]
                columns, fields = [pa.array(ids, pa.list_(pa.int32()))], [pa.field(ids_col, pa.list_(pa.int32()))]
                if check_col:
                    columns.append(pa.array([None if t is None else model.decode(i) == t.replace(SPACE, " ") for t, i in zip(texts, ids, strict=True)], pa.bool_()))
                    fields.append(pa.field(check_col, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *fields]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        m = model.longest
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = model.prepare(text)
                rows = []
                for number, a in enumerate(range(0, len(text), chunk)):
                    b, low = min(len(text), a + chunk), max(0, a - m)
                    rows.append((key, number, low, a - low, b - a, len(text), text[low : b + m]))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "number", "first", "before", "size", "length", "window"), r, strict=True)) for r in rows], schema=chunk_schema)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            for r in batch.to_pylist():
                o = r["first"]
                found = model.transfer(r["window"], r["before"], r["before"] + r["size"], r["number"] == 0)
                cells = [(us + o, ue + o, vs + o, ve + o, w) for (us, ue), row in found.items() for (vs, ve), w in row.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["number"]], pa.int32()), pa.array([r["length"]]), *(pa.array([list(map(kind, c))], pa.list_(ty)) for c, kind, ty in zip(zip(*cells, strict=True), (int, int, int, int, float), [pa.int64()] * 4 + [pa.float64()], strict=True))], ["key", "number", "length", "us", "ue", "vs", "ve", "w"])

    def fix(pdf):
        import pandas as pd

        pdf = pdf.sort_values("number")
        matrices: list[Matrix] = []
        for r in pdf.itertuples():
            matrix: Matrix = {}
            for us, ue, vs, ve, w in zip(r.us, r.ue, r.vs, r.ve, r.w, strict=True):
                matrix.setdefault((us, ue), {})[vs, ve] = w
            matrices.append(matrix)
        states = scan_states(matrices, int(pdf["length"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"], "number": pdf["number"], "us": [u[0] for u, _ in states], "ue": [u[1] for u, _ in states], "vs": [v[0] for _, v in states], "ve": [v[1] for _, v in states]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                o = r["first"]
                ids.append(model.backtrace(r["window"], r["before"], r["before"] + r["size"], (r["us"] - o, r["ue"] - o), (r["vs"] - o, r["ve"] - o)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), pa.array(ids, pa.list_(pa.int32()))], ["key", "number", "ids"])

    chunk_schema = pa.schema([("key", pa.int64()), ("number", pa.int32()), ("first", pa.int64()), ("before", pa.int32()), ("size", pa.int32()), ("length", pa.int64()), ("window", pa.string())])
    short_rows = df.where(~long).mapInArrow(direct, schema)
    key = F.xxhash64(text_col, F.length(text_col))
    giants = df.where(long).select(key.alias("key"), F.col(text_col).alias("text"))
    # Equal texts give equal chunks; they meet where the chunks are dealt anyway, so texts are not dealt whole before.
    chunks = giants.mapInArrow(split, _CHUNKS).repartition("key", "number").dropDuplicates(["key", "number"])
    matrices = chunks.mapInArrow(transfers, "key long, number int, length long, us array<long>, ue array<long>, vs array<long>, ve array<long>, w array<double>")
    # A stated number of partitions, which Spark does not merge: the matrices are small, the scan of a document is not.
    matrices = matrices.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    fixed = matrices.groupBy("key").applyInPandas(fix, "key long, number int, us long, ue long, vs long, ve long")
    traced = chunks.join(fixed.hint("merge"), ["key", "number"]).mapInArrow(trace, "key long, number int, ids array<int>")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("parts")).select(F.col("key").alias(own := _free_name(df, "_key")), F.flatten("parts.ids").alias(ids_col))
    long_rows = df.where(long).withColumn(own, key).join(whole.hint("merge"), own).select(*df.columns, ids_col)
    if check_col:
        decoded = decode(long_rows, model_file, ids_col, back := _free_name(long_rows, "_decoded"))
        long_rows = decoded.withColumn(check_col, F.col(back) == F.translate(text_col, SPACE, " ")).drop(back)
    return short_rows.union(long_rows)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the column `out_col`: the text of `ids_col` (null for null)."""
    shared = _share(df, model_file)
    df = df.drop(out_col) if out_col in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in (whole.slice(a, _ROWS) for whole in batches for a in range(0, whole.num_rows, _ROWS)):
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field(out_col, pa.string())]))

    return df.mapInArrow(run, schema)
