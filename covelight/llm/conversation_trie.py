"""The prefix trie of conversations: shared beginnings as nodes, with members, children and the words that sharing saves.

Every prefix of every conversation gets a chained SHA-256 digest, each made from the one before it and the next turn, so
equal prefixes meet by (depth, digest) without their texts. Texts are read once, where their own digest is made.

A node's smallest member names it: (conv_id, depth). The nodes of one name lie on one conversation's path, a run from some
depth down to its end, and hang on a node of another run. Subtree sums explode each run, not each node, to all its
ancestor runs, which gives the same sums from fewer rows: what hangs on a node is summed by group, and sums along a run
are running sums. Only where each of many conversations is a beginning of the next, and their ids fall as they grow, are
the rows as many as exploding each node would give.

Long conversations are dealt in blocks of turns, in every step: no task holds more than a block of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from .common import HOT_ROWS, PARTS, cut, spread_join

#: Turns in a block of one conversation's digest chain and of the running sums; ids in a piece of a node's list of ends.
BLOCK, PIECE = 256, 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["conv_id", "depth"]


def crc_mod(c: Column, mod: int) -> Column:
    """Unsigned CRC-32 of a column's decimal text, modulo mod."""
    return F.crc32(c.cast("string").cast("binary")) % mod


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0 on, by turn with null first, then digest), n_turns, turn_digest, n_words: texts as digests.

    The length of the role goes before it, so that two pairs of role and text never look alike."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)).alias("turn_digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    # sorted by ranges of (conversation, turn), so a conversation with a third of all turns lies in many partitions
    return number_rows(cut(turns), "conv_id", F.asc_nulls_first("turn"), "turn_digest", out="row")


def rebuild(turns: DataFrame, family: int, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; turns: conv_id, depth from 1 on, turn_digest, n_words) after each conversation got the
    beginning of its family's first one (h turns of conversation c - c % family) in place of its own first h turns."""
    convs = cut(turns.groupBy("conv_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), F.max("row").alias("row_end")))
    heads = turns.where(F.col("conv_id") % family == 0)
    firsts = convs.where(F.col("conv_id") % family == 0).select("conv_id", "first")
    # the few first turns of a conversation are picked by their row numbers, so this join meets most_shared - 1 rows a key
    wanted = firsts.select(F.col("conv_id").alias("base"), F.posexplode(F.sequence("first", F.col("first") + most_shared - 2)).alias("pos", "row"))
    begins = heads.select(F.col("conv_id").alias("base"), "row", "turn_digest", "n_words").join(wanted, ["base", "row"])
    begins = begins.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_digest", "n_words"))).alias("begin"))
    h = crc_mod(F.col("conv_id"), most_shared).cast("int").alias("h")
    convs = convs.select("conv_id", "first", "n", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(begins.hint("merge"), "base", "left")
    shared = F.least("h", F.coalesce(F.size("begin"), F.lit(0)))
    convs = cut(convs.withColumn("shared", F.when(F.col("begin").isNull(), 0).otherwise(shared)).withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = spread_join(turns, convs.select("conv_id", "first", "h", "shared", "length"), "conv_id", "row").withColumn("pos", F.col("row") - F.col("first")).where("pos >= h")
    own = own.select("conv_id", (F.col("shared") + F.col("pos") - F.col("h") + 1).alias("depth"), "length", "turn_digest", "n_words")
    lent = convs.where("shared > 0").select("conv_id", "length", F.explode(F.slice("begin", F.lit(1), F.col("shared"))).alias("t"))
    lent = lent.select("conv_id", (F.col("t.pos") + 1).cast("long").alias("depth"), "length", "t.turn_digest", "t.n_words")
    return convs.select("conv_id", "length"), own.unionByName(lent)


def _chain(rows: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """rows with `digest` replaced by the chained digest of all up to it, by keys in ascending order; read as a stream."""
    schema = rows.schema

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, b""
        for batch in batches:
            out = []
            for key, x in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(digest).to_pylist(), strict=True):
                state = hashlib.sha256((state if key == last else b"") + x).digest()
                last = key
                out.append(state)
            at = batch.schema.get_field_index(digest)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(chain, schema)


def prefix_digests(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns with `digest`, the chained digest of the whole prefix, in place of turn_digest.

    A chain starts anew with every `block` turns; a second one over the blocks' last digests carries on from there, so
    the digest still follows from all turns so far, and a task never needs a whole conversation's turns."""
    blocks = turns.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long"))
    inside = cut(_chain(blocks.withColumnRenamed("turn_digest", "digest"), ["conv_id", "block"], "depth", "digest"))
    ends = inside.where((F.col("depth") % block == 0) & (F.col("length") > F.col("depth"))).select("conv_id", (F.col("block") + 1).alias("block"), F.col("digest").alias("before"))
    before = _chain(ends, ["conv_id"], "block", "before")
    joined = inside.join(before.hint("merge"), ["conv_id", "block"], "left")
    whole = F.unhex(F.sha2(F.concat("before", "digest"), 256))
    return joined.withColumn("digest", F.when(F.col("before").isNull(), F.col("digest")).otherwise(whole)).drop("before", "block")


def _list_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from (conv_id, depth, member): ids in ascending order, comma-joined.

    A piece holds PIECE ids at most, as members are distinct; one digest then reads its pieces in order, one at a time."""
    piece = F.floor(F.col("member") / PIECE).cast("long").alias("piece")
    pieces = ends.groupBy(*KEY, piece).agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if (conv, depth) == last:
                    state.update(b"," + ids.encode())
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (conv, depth), hashlib.sha256(ids.encode())
            yield _batch(done)
        if last is not None:
            yield _batch([(*last, state.hexdigest())])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": pa.array(digest, pa.string())})


def _suffix_sums(nodes: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """nodes with each column summed over itself and all deeper nodes of its run, block by block."""
    blocks = nodes.withColumn("block", F.floor(F.col("depth") / block).cast("long"))
    sums = blocks.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns])
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    joined = blocks.join(later.hint("merge"), ["conv_id", "block"])
    return joined.withColumns({c: F.sum(c).over(inside) + F.col(f"_{c}") for c in columns}).drop("block", *[f"_{c}" for c in columns])


def prefix_trie(conversations: DataFrame, family: int = 20, most_shared: int = 4, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node.

    Conversations (conv_id, turn, role, text) are ordered by turn, null first, then by their turns' digests; null roles and
    texts are empty; repeated turns are turns of their own; rows without a conv_id belong to no conversation and are left
    out; other columns are not read. Each conversation is rebuilt first (see rebuild; family 1 and most_shared 1 leave
    them as they are). An empty table has no node."""
    turns = turn_digests(conversations)
    convs, rebuilt = rebuild(turns, family, most_shared)
    prefixes = cut(prefix_digests(rebuilt, block))
    total = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    root, n_convs = total["conv_id"], total["n"]
    nodes = cut(prefixes.groupBy(F.col("depth").alias("node_depth"), "digest").agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs")))
    # names onto prefixes; nodes that many conversations share are dealt in parts
    share = max(n_convs * 4 / PARTS, HOT_ROWS)
    hot = nodes.where(F.col("n_convs") > share).select("digest", F.ceil(F.col("n_convs") / share).cast("int").alias("copies"))
    hot = cut(hot) if hot.limit(1).count() else None
    named = nodes.select("digest", "name", "n_convs")
    paths = cut((prefixes.join(named.hint("merge"), "digest") if hot is None else spread_join(prefixes, named, "digest", "conv_id", hot)).drop("digest"))
    at_root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("n_words"), F.lit(root).cast("long").alias("name"), F.lit(n_convs).cast("long").alias("n_convs"))
    paths = paths.unionByName(at_root)

    trie = paths.where("name = conv_id").select(*KEY, "length", "n_convs", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"))
    runs = trie.groupBy("conv_id").agg(F.sum("saved_tokens").alias("saved"), F.min("depth").alias("top"), F.max("depth").alias("length"))
    # each run to all its ancestor runs: where its path leaves them
    leaves_at = paths.where("name <> conv_id").groupBy("conv_id", "name").agg(F.max("depth").alias("depth"))
    pairs = cut(leaves_at.join(runs.hint("merge"), "conv_id").withColumn("child", (F.col("depth") == F.col("top") - 1).cast("long")))
    hung = pairs.where("child = 1").groupBy(F.col("name").alias("conv_id"), F.col("depth").alias("length")).agg(F.lit(0).cast("long").alias("leaf"))
    ends = runs.select("conv_id", "length").join(hung.hint("merge"), ["conv_id", "length"], "left").select("conv_id", F.coalesce("leaf", F.lit(1).cast("long")).alias("leaf"))
    below = pairs.join(ends.hint("merge"), "conv_id").groupBy(F.col("name").alias("conv_id"), "depth").agg(F.sum("saved").alias("b_saved"), F.sum("leaf").alias("b_leaves"), F.sum("child").alias("b_children"))
    up = pairs.where("child = 1").select("conv_id", F.col("top").alias("depth"), F.col("name").alias("parent"))
    lists = _list_digests(paths.where("depth = length").select(F.col("name").alias("conv_id"), "depth", F.col("conv_id").alias("member")))

    full = trie.join(below.hint("merge"), KEY, "left").join(up.hint("merge"), KEY, "left").join(lists.hint("merge"), KEY, "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("b_saved", "b_leaves", "b_children")})
    last = (F.col("depth") == F.col("length")).cast("long")
    full = full.select(
        *KEY, F.coalesce("parent", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"), "n_convs", (F.col("b_children") + 1 - last).alias("n_children"),
        (F.col("b_leaves") + last * (F.col("b_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + F.col("b_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return _suffix_sums(full, ["n_leaves", "saved_tokens"], block)
