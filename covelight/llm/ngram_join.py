"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of k consecutive words; two sets link when |A & B| >= t |A | B|. Then their
symmetric difference is at most (1 - t) / (1 + t) (|A| + |B|). Sets are put in size bands such that a set's larger
partners are in its own band or the next; each pair of neighbouring bands has a bound d on the difference. In it
every shingle flips one bit of a sketch cut into P = 1.5 (d + 1) pieces. The sketches' Hamming distance is at most
the symmetric difference, so at most d pieces differ and linked sets agree in P - d pieces at least.

By the pigeonhole rule it suffices to join on each set's first d + 1 pieces in any order that is the same for all.
The order here is rarest first, by exact counts; then pieces that very many sets have, then empty pieces. A count-min sketch over all
pieces comes before: a set with d + 1 pieces that it shows to be the set's own has no partner and gives no row, nor do such pieces. All
other pieces are dealt by piece once and counted there, so the result, and all work after that one shuffle, do
not depend on how full the sketch is. Very common pieces are dealt by piece and salt.

Sets of one bucket are first linked through pivots and connected; then any two sets of a bucket that are still in
different components are compared too, so no link between components is lost. That is done block against block on
whole parity sketches inside tasks: no pair becomes a row unless its Hamming distance allows a link. Every link is
verified on the whole shingle sets, which are read again from the texts of those sets alone that a near pair names.
Equal sets count as one throughout.

The answer is components only: links between sets already in one component are not formed, so neither the pairs nor
the number of links of a document can be had from here.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, id_text, spread_join, text_blocks
from .components import components
from .repeat_sketch import Repeats, count, total_bytes, width_for
from .wordhash import mix, span_hashes, windows_of, words_of

#: Bits of a piece of the sketch, as a power of two: so many that two shingles hardly ever share one.
PIECE_BITS = 24
#: Sets of one bucket that are compared as a block.
BLOCK = 256
#: Parts of a very common piece's bucket.
SALTS = 256


@lru_cache(maxsize=8)
def bands(t: Fraction, largest: int = 1 << 40) -> np.ndarray:
    """First size of each band: a size and its largest linked size are in the same or in neighbouring bands."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(int(starts[-1] / t) + 1)
    return np.array(starts)


def band_bound(t: Fraction, group: int) -> tuple[int, int]:
    """(greatest difference d, pieces P) for bands `group` and `group` + 1."""
    top = int(bands(t)[group + 1]) - 1
    d = int((1 - t) / t * top)
    return d, d + 1 + (d + 1) // 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; one shingle where a row has fewer than k words, none without words."""
    words = words_of(data, offsets, lower=True)
    begin, hashes = windows_of(words, k)
    counts = np.diff(words.first)
    windows = np.concatenate([[0], np.cumsum(np.maximum(counts - (k - 1), 0))])
    short = span_hashes(words.hashes, words.first[:-1], words.first[1:])
    return [np.unique(hashes[windows[i] : windows[i + 1]]) if n >= k else short[i : i + 1][: int(n > 0)] for i, n in enumerate(counts)]


def set_id(shingles: np.ndarray) -> np.uint64:
    return mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64))[0]


def piece_keys(shingles: np.ndarray, t: Fraction) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the set's band pairs: the greatest difference, the keys of all P pieces, and which pieces are empty."""
    n = len(shingles)
    band = int(np.searchsorted(bands(t), n, "right")) - 1
    spots = mix(shingles)
    for group in {band, max(band - 1, 0)}:
        d, pieces = band_bound(t, group)
        bit = spots % np.uint64(pieces << PIECE_BITS)
        values = np.zeros(pieces, np.uint64)
        np.bitwise_xor.at(values, (bit >> np.uint64(PIECE_BITS)).astype(np.int64), mix(bit + np.uint64(1)))  # equal bits cancel
        tag = mix(np.arange(pieces, dtype=np.uint64) + np.uint64(group << 40))
        yield d, mix(values ^ tag), values == 0


def prefix_keys(shingles: np.ndarray, t: Fraction, seen: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """The keys among which the set's first d + 1 are, those aside that nobody else has, and a lot for each: -1 for a very
    common or empty piece, which is wanted; else 2 s + g where all but the s last of those of band pair g are."""
    keys_out, lots = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for g, (d, keys, empty) in enumerate(piece_keys(shingles, t)):
        level = np.where(empty, 3, seen.level(keys))
        alone, some = int((level == 0).sum()), np.flatnonzero(level == 1)
        spare = alone + len(some) - (d + 1)
        if spare < len(some):
            common = np.flatnonzero(level > 1)
            common = common[np.lexsort((keys[common], level[common]))][: max(-spare, 0)]
            keys_out += [keys[some], keys[common]]
            lots += [np.full(len(some), 2 * max(spare, 0) + g), np.full(len(common), -1)]
    return np.concatenate(keys_out), np.concatenate(lots)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The set's whole parity sketch in 64-bit words: four bits a shingle or more, a power of two; halves fold by XOR."""
    bits = max(256, 1 << int(4 * len(shingles) - 1).bit_length())
    flips = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def _stack(sketches: list[bytes], words: int) -> np.ndarray:
    out = np.empty((len(sketches), words), np.uint64)
    for i, raw in enumerate(sketches):
        w = np.frombuffer(raw, np.uint64)
        while len(w) > words:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _near_pairs(blocked: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) in different components of one key whose sketches are near enough for a link; blocked: key, blocks
    (how many the key has), block and members, an array of (sid, component, n, sketch)."""
    p, q = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = batch.column("left"), batch.column("right"), batch.column("same").to_pylist()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                sides = []
                for side in (left, right):
                    m = side[i].values
                    sides.append([m.field(c).to_numpy() for c in ("sid", "component", "n")] + [m.field("sketch").to_pylist()])
                (sa, ca, na, ka), (sb, cb, nb, kb) = sides
                words = min(min(map(len, ka)), min(map(len, kb))) // 8
                xa, xb = _stack(ka, words), _stack(kb, words)
                for j in range(len(sa)):
                    may = (ca[j] != cb) & (p * na[j] <= q * nb) & (p * nb <= q * na[j])
                    if same[i]:
                        may[: j + 1] = False
                    at = np.flatnonzero(may)
                    if len(at):
                        gap = np.bitwise_count(xa[j] ^ xb[at]).sum(1, dtype=np.int64)
                        at = at[gap * (p + q) <= (q - p) * (na[j] + nb[at])]
                        found.append((np.full(len(at), sa[j]), sb[at]))
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    alone = blocked.where("blocks = 1").select(F.col("members").alias("left"), F.col("members").alias("right"), F.lit(True).alias("same"))
    # Numbers of blocks are paired first, so the pairs of one key's blocks are dealt over all tasks.
    many = blocked.where("blocks > 1")
    others = many.select("key", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    sides = [many.select("key", F.col("block").alias(number), F.col("members").alias(side)).hint("merge") for number, side in (("x", "left"), ("y", "right"))]
    met = others.join(sides[0], ["key", "x"]).join(sides[1], ["key", "y"]).select("left", "right", (F.col("x") == F.col("y")).alias("same"))
    return alone.union(met).mapInArrow(run, "a long, b long").distinct()


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Sets:
    """The distinct sets of docs (doc_id, text), described when asked for; own: doc_id, n and sid of every document."""

    def __init__(self, docs: DataFrame, own: DataFrame, k: int, t: Fraction) -> None:
        self.docs, self.k, self.t = docs, k, t
        self.first = cut(own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))

    def describe(self, need: DataFrame, what: str) -> DataFrame:
        """(sid, n, payload): the "sketch" or the "shingles" of the sets whose sid is in need.

        Only texts whose doc_id a filter of bounded size lets through are cut into shingles; need takes out the rest.
        """
        ids = self.first.join(need.hint("merge"), "sid").select("doc_id").where("doc_id is not null")
        wanted = cut(ids)
        filter_ = count(wanted, lambda batch: iter([mix(batch.column("doc_id").to_numpy().view(np.uint64))]), width_for(wanted.count(), 26), (1,))
        shared, k = self.docs.sparkSession.sparkContext.broadcast(filter_), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            for batch in batches:
                ids = batch.column("doc_id")
                may = shared.value.may_repeat(mix(ids.fill_null(0).to_numpy().view(np.uint64))) | ids.is_null().to_numpy(zero_copy_only=False)
                for _, _, data, offsets in text_blocks(batch.filter(pa.array(may))):
                    rows = []
                    for s in shingle_sets(data, offsets, k):
                        if len(s) and (sid := int(set_id(s).view(np.int64))) not in met:
                            met.add(sid)
                            rows.append((sid, len(s), (sketch(s) if what == "sketch" else s).tobytes()))
                    if rows:
                        columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in columns], ["sid", "n", "payload"])

        found = self.docs.mapInArrow(run, "sid long, n long, payload binary")
        out = cut(found.join(need.hint("merge"), "sid", "left_semi").dropDuplicates(["sid"]))
        shared.destroy()
        return out

    def verified(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b) of set ids whose sets link; pairs has no repeated row."""
        p, q = self.t.numerator, self.t.denominator

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y, n in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    a, b = _stack([x, y], min(len(x), len(y)) // 8)
                    keep.append(int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) * (p + q) <= (q - p) * n)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(q * both >= p * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def attached(pairs: DataFrame, sets: DataFrame) -> DataFrame:
            """pairs with the payloads of both ends; a pivot, the lesser end, may hold a third of all pairs."""
            hot = hot_keys(pairs, "a")
            ends = [sets.select(F.col("sid").alias(end), F.col("n").alias(f"n_{name}"), F.col("payload").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
            return spread_join(pairs.join(ends[1].hint("merge"), "b"), ends[0], "a", "b", hot)

        both = attached(pairs, sketches).where((F.col("n_x") * p <= F.col("n_y") * q) & (F.col("n_y") * p <= F.col("n_x") * q))
        thin = cut(both.select("a", "b", "x", "y", (F.col("n_x") + F.col("n_y")).alias("n")).mapInArrow(near, "a long, b long"))
        if not thin.limit(1).count():
            return thin
        shingles = self.describe(thin.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "shingles")
        return cut(attached(thin, shingles).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def join_ngrams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, max_bits: int = 27) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included).

    A null or empty text, or one without words, has no shingle and its own doc_id as component. Repeated rows get
    repeated results. A null doc_id never is a component's least id unless all its ids are null. Other columns are not
    read. A component whose links have not settled after 60 rounds of doubling raises an error.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch):
                sets = shingle_sets(data, offsets, k)
                sids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids)], ["doc_id", "n", "sid"])

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_blocks(batch):
            keys = [keys[~empty] for s in shingle_sets(data, offsets, k) if len(s) for _, keys, empty in piece_keys(s, t)]
            if keys:
                yield np.concatenate(keys)

    # A set of n shingles has about 3 (1 - t) / t n pieces; a word has about six bytes.
    pieces = total_bytes(docs) / 6 * float(3 * (1 - t) / t)
    bits = width_for(pieces, max_bits, 3)
    seen = spark.sparkContext.broadcast(count(docs.select("text"), keys_of, bits, (2, 200 + int(4 * pieces / 2**bits))))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch):
                sids, keys, lots = [], [], []
                for s in shingle_sets(data, offsets, k):
                    if len(s) and (sid := int(set_id(s).view(np.int64))) not in met:
                        met.add(sid)
                        own, lot = prefix_keys(s, t, seen.value)
                        sids.append(np.full(len(own), sid))
                        keys.append(own.view(np.int64))
                        lots.append(np.where(lot < 0, -1 - sid % SALTS, lot))
                if sids:
                    columns = (np.concatenate(sids), np.concatenate(keys), np.concatenate(lots).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sid", "key", "lot"])

    own = cut(docs.mapInArrow(describe, "doc_id long, n long, sid long"))
    # Dealt by piece once: what one set alone has ends here. A lot under 0 is the salt of a very common piece.
    ends = "min(sid) over (partition by key, salt) as low", "max(sid) over (partition by key, salt) as high"
    dealt = docs.select("text").mapInArrow(candidates, "sid long, key long, lot int").withColumn("salt", F.least("lot", F.lit(0))).repartition("key", "salt")
    shared = dealt.selectExpr("*", *ends, "count(1) over (partition by key, salt) as times").where("low <> high or lot < 0").select("sid", "key", "lot", "times").distinct()
    shared = cut(shared)
    # Of a set's repeated pieces the most frequent are not needed: as many as it has others to spare.
    ranked = shared.where("lot >= 0").selectExpr("sid", "key", "lot", "row_number() over (partition by sid, lot order by times desc, key desc) as place")
    wanted = ranked.where("place > shiftright(lot, 1)").select("sid", "key", F.lit(-1).alias("salt"))
    common = shared.where("lot < 0").select("sid", "key", (-1 - F.col("lot")).alias("salt"))
    met = cut(wanted.union(common).repartition("key", "salt").selectExpr("*", *ends).where("low <> high or salt >= 0"))
    seen.destroy()
    tops = met.where("salt >= 0").groupBy("key").agg(F.min("low").alias("a"))
    roots = cut(met.where("salt >= 0").select("key", "low").distinct().join(tops.hint("merge"), "key").select("a", F.col("low").alias("b")).where("a <> b").distinct())

    sets = _Sets(docs, own, k, t)
    sketches = sets.describe(met.select("sid").distinct(), "sketch")

    # One pivot for each set, the least it meets; then the pivots of all buckets; then whatever is still apart.
    first = met.groupBy("sid").agg(F.min("low").alias("low")).where("sid <> low").select(*_pairs("sid", "low"))
    links = sets.verified(cut(first.union(roots).distinct()), sketches)
    label = components(links)
    for last in (False, True):
        named = met.join(label.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        if last:
            # The least and the greatest set of an unsalted bucket have met all others of it as pivots; a bucket of three is done.
            rest = named.where("salt >= 0 or (sid <> low and sid <> high)")
            apart = rest.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("rows"), F.max("salt").alias("top")).where("c1 <> c2")
            parts = F.when(F.col("top") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            apart = apart.select("key", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks"), F.explode(parts).alias("salt"))
            placed = rest.join(apart.hint("merge"), ["key", "salt"]).select("key", "blocks", F.pmod(F.xxhash64("sid"), "blocks").alias("block"), "sid", "component")
            drawn = placed.join(sketches.select("sid", "n", F.col("payload").alias("sketch")).hint("merge"), "sid")
            more = _near_pairs(cut(drawn.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("sid", "component", "n", "sketch")).alias("members"))), t)
        else:
            star = named.select("sid", "component", F.explode(F.array("low", "high")).alias("node")).where("sid <> node")
            more = star.select(*_pairs("sid", "node")).union(roots).distinct()
            for end in ("a", "b"):
                more = more.join(label.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")).hint("merge"), end, "left")
            more = more.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
        new = sets.verified(cut(more), sketches)
        if new.limit(1).count():
            links = links.union(new)
            label = components(links)

    # Least ids by set, then by component; rows of one set or sets of one component may be a third of all.
    known = sets.first.join(label.withColumnRenamed("node", "sid").hint("merge"), "sid")
    known = cut(known.select("sid", "doc_id", "component"))
    least = known.groupBy("component").agg(F.min("doc_id").alias("least"))
    known = spread_join(known, least, "component", "sid").select("sid", "least")
    copies = sets.first.select("sid", F.col("doc_id").alias("least")).join(known.select("sid", F.col("least").alias("linked")).hint("merge"), "sid", "left")
    named = spread_join(own, copies.select("sid", F.coalesce("linked", "least").alias("least")), "sid", "doc_id", how="left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the documents whose component has a smaller doc_id; rows that repeat a doc_id stay or go together.

    A row with a null id cannot be named and always stays; so do texts without words. Other columns stay as they are.
    """
    gone = join_ngrams(df, id_col, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return df.join(gone.hint("merge"), df[id_col].cast("long") == gone["doc_id"], "left_anti")
