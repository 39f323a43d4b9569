"""Prefix trie of conversations, summed up its subtrees by heavy paths.

``rebuilt`` gives each conversation's prefixes, one row a prefix: a digest chained over its turns is the node. A node's
members are counted by partial aggregation, and its least member names it: with its depth that is a key, and the nodes
named by one conversation are a chain from some depth to its end.

Subtree sums go by heavy-path decomposition. The child with most members is its parent's heavy child, so a light edge
at least halves the members and there are at most log2(conversations) of them above any node. Each path's own sum goes
to the path it hangs from, and from there on, one light edge a round; what hangs from a node is then added to it, and
running sums from each path's end give the sums of all subtrees.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import drop_table, write_table, written

#: Ids a row in the lists of conversations that end at a node: a block of ids this wide is one string.
BLOCK = 1024
#: Most turns that a conversation takes over from another.
MOST_SHARED = 8

PREFIXES = "conv_id long, depth int, node binary, parent binary, n_bytes long, last boolean"
ROOT = b"\0" * 16


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, not its first, conversation, position): chains digests turn by turn, a conversation at a time.

    What is held is the first turns of the group's leading conversation and one batch of output.
    """
    out: list[tuple] = []
    group, lead, conv, own, shared, chain, depth, size = None, [], None, 0, 0, ROOT, 0, 0

    def step(turn: bytes, n_bytes: int) -> None:
        nonlocal chain, depth, size
        out.append((conv, depth, chain, before, size, False))
        depth, size = depth + 1, n_bytes

    def flush() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PREFIXES.split(", ")])
        out.clear()
        return batch

    before = None
    for b in batches:
        for g, c, take, turn, n_bytes in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, depth, chain, before, size, True))
                if g != group:
                    group, lead = g, []
                conv, own, shared, chain, depth, size, before = c, 0, take, ROOT, 0, 0, None
                for t, n in lead[:take] if c != g else ():
                    step(t, n)
                    chain, before = hashlib.blake2b(chain + t, digest_size=16).digest(), chain
            own += 1
            if c == g and own <= MOST_SHARED:
                lead.append((turn, n_bytes))
            if c == g or own > shared:
                step(turn, n_bytes)
                chain, before = hashlib.blake2b(chain + turn, digest_size=16).digest(), chain
            if len(out) >= 1 << 14:
                yield flush()
    if conv is not None:
        out.append((conv, depth, chain, before, size, True))
    if out:
        yield flush()


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: PREFIXES; ``last`` marks the whole conversation.

    Conversation c takes the first h turns of c - c % 5 (h: crc32 of its decimal id, mod 9), then its own after its
    first h. Turns are in order of ``turn``, null first; turns with one number in order of role, then of a digest of the
    text. Repeated rows are turns of their own, a null role or text is empty, rows without conv_id belong to nothing.
    A conversation's rows pass through one task as a sorted stream, digests only; texts stay where they are read.
    """
    text, role, c = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit("")), F.col("conv_id")
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(c.isNotNull()).select(
        (c - c % 5).cast("long").alias("group"),
        c.cast("long").alias("conv_id"),
        (F.crc32(c.cast("string")) % 9).cast("int").alias("take"),
        digest.alias("turn_digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.col("turn").alias("turn"),
        role.alias("role"),
    )
    order = ["group", F.col("conv_id") != F.col("group"), "conv_id", F.col("turn").asc_nulls_first(), "role", "turn_digest"]
    dealt = rows.repartition("group").sortWithinPartitions(*order)
    return dealt.select("group", "conv_id", "take", "turn_digest", "n_bytes").mapInArrow(_prefixes, PREFIXES)


def _ends(prefixes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the ids that end there, ascending. Ids meet in blocks, blocks stream through the hash in order."""
    blocks = prefixes.where("last").groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    blocks = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, t) for b in batches for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        nodes, found = [], []
        for node, of in itertools.groupby(rows, key=lambda r: r[0]):
            sha, mark = hashlib.sha256(), ""
            for _, ids in of:
                sha.update(f"{mark}{ids}".encode())
                mark = ","
            nodes.append(node)
            found.append(sha.hexdigest())
            if len(nodes) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], names=["node", "ends_sha256"])
                nodes, found = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], names=["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """A row a node with its parent's name and whether it is a light child (the root is)."""
    found = prefixes.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs")
    )
    found = written(found, "trie-counts")
    inner = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"))
    inner = inner.agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", F.bitwise_not("conv_id"))).alias("heavy"))
    found = found.join(inner, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    found = written(found, "trie-children")
    above = found.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("_heavy"))
    light = ~F.col("conv_id").eqNullSafe(F.col("_heavy"))
    return found.drop("heavy").join(above, "parent", "left").withColumn("light", light).drop("_heavy", "parent")


def _with_paths(nodes: DataFrame) -> DataFrame:
    """Add the head (conv_id, depth) of each node's heavy path.

    Down the chain of one name, the last light node is the head. A chain whose first node is heavy goes on with the path
    of the node above it; such links between chains are followed by doubling, so their number of rounds is logarithmic.
    """
    down = Window.partitionBy("conv_id").orderBy("depth")
    here = F.when(F.col("light"), F.struct("conv_id", "depth"))
    seen = nodes.withColumn("head", F.last(here, True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))).over(down)
    seen = written(seen.withColumn("up", F.when(F.col("head").isNull(), first)), "trie-chains")
    # A row a chain that goes on above: where (conv_id, depth), then the head there or the chain that it goes on with.
    on = seen.where("head IS NULL").select("conv_id", F.col("up.conv_id").alias("c"), F.col("up.depth").alias("d")).distinct()
    at = seen.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "head")
    path = write_table(on.join(at, ["c", "d"]).select("conv_id", F.when(F.col("head").isNull(), F.col("c")).alias("next"), "head"), "trie-links")
    spark = nodes.sparkSession
    schema = spark.read.parquet(path).schema
    while (links := spark.read.schema(schema).parquet(path)).where("head IS NULL").limit(1).count():
        further = links.select(F.col("conv_id").alias("next"), F.col("next").alias("_next"), F.col("head").alias("_head"))
        moved = links.where("head IS NULL").join(further, "next").select("conv_id", F.col("_next").alias("next"), F.col("_head").alias("head"))
        next_ = write_table(links.where("head IS NOT NULL").union(moved), "trie-links")
        drop_table(spark, path)
        path = next_
    links = spark.read.schema(schema).parquet(path).select("conv_id", F.col("head").alias("_head"))
    return seen.join(links, "conv_id", "left").withColumn("head", F.coalesce("head", "_head")).drop("_head", "up")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, light, head and ``values``), each value summed over the node's subtree."""
    total = [F.sum(v).alias(v) for v in values]
    by_head = nodes.groupBy("head").agg(*total)
    heads = nodes.where(F.col("light") & F.col("parent_conv_id").isNotNull()).select(F.col("head"), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).alias("at"))
    # The path that each path hangs from: through the node that it hangs from.
    place = nodes.select(F.struct("conv_id", "depth").alias("at"), F.col("head").alias("above"))
    hung = written(heads.join(place, "at"), "trie-paths")
    moving, rounds = written(by_head, "trie-sums"), []
    while True:
        rounds.append(moving)
        up = written(moving.join(hung, "head").groupBy(F.col("above").alias("head")).agg(*total), "trie-sums")
        if up.limit(1).count() == 0:
            break
        moving = up
    whole = rounds[0]
    for r in rounds[1:]:
        whole = whole.unionByName(r)
    added = hung.join(whole.groupBy("head").agg(*total), "head").groupBy("at").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    up = Window.partitionBy("head").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    met = nodes.withColumn("at", F.struct("conv_id", "depth")).join(added, "at", "left")
    sums = {v: F.sum(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).over(up) for v in values}
    return met.withColumns(sums).drop("at", *(f"_{v}" for v in values))


def prefix_trie(turns: DataFrame, rebuild: Callable[[DataFrame], DataFrame] = rebuilt) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    An empty table has no nodes, not even a root. Of children with equally many members that with the least id is heavy.
    ``rebuild`` gives PREFIXES.
    """
    prefixes = written(rebuild(turns), "trie-prefixes")
    nodes = _with_paths(_nodes(prefixes))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    summed = subtree_sums(written(nodes, "trie-nodes"), ["n_leaves", "saved_tokens"])
    ended = summed.join(_ends(prefixes), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return ended.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
