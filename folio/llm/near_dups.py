"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal word sequences are one class from the start. Classes are banded by their signatures. In every bucket
each class is paired with the bucket's least member, and of a class's pairs the one that most buckets share is looked
at first: signatures are compared batch by batch, a pair is dropped once the posterior probability that it is similar
enough falls below the miss probability, and survivors are compared exactly, on their full shingle sets. Links make
components. Buckets that still hold several components are then settled completely, in blocks: all pairs across their
components go through the same comparison, each in the first band that the two share. Signatures meet first; texts
come only to members with a pair that outlasts all batches, and pairs that a link already joins are skipped.
So no link between different texts is lost but with the miss probability, and no bucket's pairs are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, LOWER, WORD, Hashes, drop_table, mixed, release, spread, text_chunks, words, write_table, written
from folio.llm.components import components

#: 32 bands of 4: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the probability at which a similar pair may be dropped over all looks.
BATCH, MISS = 32, 1e-6
LOOKS = HASHES // BATCH
#: Members of a block of a bucket; two blocks meet in one task.
BLOCK = 512
#: Shingles of sets that a task keeps while it compares (some 40 MB).
HELD = 200_000
#: Bytes of a group beyond which a worker first gives back what memory it can.
LARGE = 4 << 20

_LOWER = bytes(LOWER)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


@lru_cache(maxsize=64)
def least_matches(compared: int, similarity: float, miss: float = MISS / LOOKS) -> int:
    """The least matches of ``compared`` at which a pair stays: below it, P(similarity >= s | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail at s is a binomial sum.
    """
    n, tail = compared, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def shingle_hashes(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: a 64-bit hash of each shingle, their texts, and a pair of 64-bit hashes of each word sequence.

    A text of fewer than ``size`` words, but some, has one shingle: all of them.
    """
    raw = LOWER[raw]
    start, end, first = words(raw, off)
    n, n_words = len(off) - 1, np.diff(first)
    word = Hashes(raw).of(start, end)
    doc = np.repeat(np.arange(n), n_words)
    with np.errstate(over="ignore"):
        m = max(0, len(word) - size + 1)
        key = np.zeros(m, np.uint64)
        for k in range(size):
            key = mixed(key * np.uint64(0xD1342543DE82EF95) + word[k : k + m])
        full = doc[:m] == doc[size - 1 :] if m else np.zeros(0, bool)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            h = np.uint64(len(word[first[d] : first[d + 1]]))
            for w in word[first[d] : first[d + 1]]:
                h = mixed(np.array([h * np.uint64(0xD1342543DE82EF95) + w], np.uint64))[0]
            whole[i] = h
        place = np.arange(len(word), dtype=np.uint64) - np.repeat(first[:-1], n_words).astype(np.uint64)
        tagged = mixed(word + place * np.uint64(0x9E3779B97F4A7C15))
        sums = [np.zeros(len(word) + 1, np.uint64), np.zeros(len(word) + 1, np.uint64)]
        np.cumsum(tagged, out=sums[0][1:])
        np.cumsum(mixed(tagged ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1][1:])
        sequence = np.column_stack([s[first[1:]] - s[first[:-1]] for s in sums])
    hashes, docs = np.append(key[full], whole), np.append(doc[:m][full], short)
    return hashes, docs, sequence


def signatures(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct shingles of each text, and its signature: a row of HASHES minima (32-bit)."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        keep = np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))
        hashes, docs = hashes[keep], docs[keep]
    counts = np.bincount(docs, minlength=n)
    sig = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(counts)
    if len(has):
        at = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                v = x * _A[k]
                v += _B[k]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                sig[has, k] = np.minimum.reduceat(v, at)
    return counts, sig


SIGNED = "doc_id long, n_shingles long, s0 long, s1 long, sig binary"


def _sign(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for i, j, raw, off in text_chunks(b.column("text")):
                hashes, docs, sequence = shingle_hashes(raw, off, size)
                counts, sig = signatures(hashes, docs, j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(counts), *(pa.array(sequence[:, k].view(np.int64)) for k in (0, 1)), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "s0", "s1", "sig"],
                )

    return rows


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(b), BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(b), 1))
            for k in range(ROWS):
                key = mixed(key * np.uint64(0xD1342543DE82EF95) + sig[:, :, k])
        bands = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), BANDS)), bands], names=["bucket", "rep", "band"])


class Members:
    """Texts of one comparison, with signatures; shingle sets are made when first needed."""

    def __init__(self, ids: list[int], texts: list[str] | None, sigs: list[bytes], size: int, similarity: float) -> None:
        self.ids, self.texts, self.size, self.similarity = ids, texts, size, similarity
        self.sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(ids), HASHES)
        self.sets: dict[int, frozenset] = {}
        self.held = 0
        # In percent, so that a similarity such as 0.8 is compared in whole numbers.
        self.percent = round(100 * similarity)

    def survivors(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs outlast all batches, and their matches."""
        alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
        for at in range(0, HASHES, BATCH):
            to = at + BATCH
            for k in range(0, len(alive), 1 << 14):
                part = alive[k : k + (1 << 14)]
                matches[part] += np.count_nonzero(self.sig[left[part], at:to] == self.sig[right[part], at:to], axis=1)
            alive = alive[matches[alive] >= least_matches(to, self.similarity)]
        return alive, matches[alive]

    def shingles(self, k: int) -> frozenset:
        found = self.sets.get(k)
        if found is None:
            w = self.texts[k].encode().translate(_LOWER).split()  # of bytes: at ASCII white space
            found = frozenset(zip(*(w[i:] for i in range(self.size)), strict=False)) if len(w) >= self.size else frozenset([tuple(w)] if w else [])
            self.held += len(found)
            if self.held > HELD:
                self.sets, self.held = {}, len(found)
            self.sets[k] = found
        return found

    def linked(self, i: int, j: int) -> bool:
        a, b = self.shingles(i), self.shingles(j)
        if self.percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
            return False
        both = len(a & b)
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _stars(size: int, similarity: float):
    """Rows (pivot, salt, rep, text, sig): links of each rep with the pivot of its group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.nbytes > LARGE:
            release()
        ids = table.column("rep").to_pylist()
        m = Members(ids, table.column("text").to_pylist(), table.column("sig").to_pylist(), size, similarity)
        centre = ids.index(key[0].as_py())
        others = np.array([k for k in range(len(ids)) if ids[k] != ids[centre]], np.int64)
        stay, _ = m.survivors(np.full(len(others), centre), others)
        links = [ids[others[k]] for k in stay if m.linked(centre, int(others[k]))]
        return pa.table({"a": pa.array(links, pa.int64()), "b": pa.array([ids[centre]] * len(links), pa.int64())})

    return run


def _pairs(m: Members, table: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs across components that outlast all batches and share no band before this one, with their matches.

    i is a block of the bucket's largest component and j one of the others' members; or i is -1 - a block of the others.
    """
    block, part, big = (table.column(c).to_numpy() for c in ("block", "component", "big"))
    if i >= 0:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(big), np.flatnonzero(~big), indexing="ij"))
    else:
        left, right = np.triu_indices(len(m.ids), 1)
        across = part[left] != part[right]
        if -1 - i != j:
            across &= block[left] != block[right]
        left, right = left[across], right[across]
    stay, matches = m.survivors(left, right)
    left, right = left[stay], right[stay]
    band = table.column("band")[0].as_py() if len(table) else 0
    before = np.zeros(len(left), bool)
    for k in range(0, len(left), 1 << 14):
        at = slice(k, k + (1 << 14))
        same = m.sig[left[at], : band * ROWS] == m.sig[right[at], : band * ROWS]
        before[at] = same.reshape(-1, band, ROWS).all(2).any(1) if band else False
    return left[~before], right[~before], matches[~before]


def _with_partner(similarity: float):
    """Of rows (bucket, i, j, rep, component, big, block, band, sig) those that have a pair to verify."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        m = Members(table.column("rep").to_pylist(), None, table.column("sig").to_pylist(), 0, similarity)
        left, right, _ = _pairs(m, table, key[1].as_py(), key[2].as_py())
        return table.drop_columns(["sig"]).take(pa.array(np.union1d(left, right), pa.int64()))

    return run


def _blocks(size: int, similarity: float):
    """The same rows with text and sig: links across components that join what was not joined."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.nbytes > LARGE:
            release()
        table = table.sort_by("rep")
        ids = table.column("rep").to_pylist()
        m = Members(ids, table.column("text").to_pylist(), table.column("sig").to_pylist(), size, similarity)
        part = table.column("component").to_numpy()
        left, right, matches = _pairs(m, table, key[1].as_py(), key[2].as_py())
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        links = []
        for k in np.argsort(-matches, kind="stable"):
            a, b = int(left[k]), int(right[k])
            x, y = find(int(part[a])), find(int(part[b]))
            if x != y and m.linked(a, b):
                root[max(x, y)] = min(x, y)
                links.append((ids[a], ids[b]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _narrow(rows: DataFrame, n: int) -> DataFrame:
    """A table of ids to join with texts: broadcast if its counted rows are few, else left to a shuffled join."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    Words are lower-cased in A-Z; a text's set is its distinct shingles of ``size`` words, or all its words as one if it
    has fewer; a text without words, or a null one, has the empty set and is linked with nothing. Texts are linked if the
    Jaccard similarity of their sets is at least ``similarity`` (in whole percent). ``component_id`` is the least
    doc_id that links reach; ``kept`` marks it. Rows with a null id are left out of links and keep a null component.
    An empty table gives an empty one; rows that repeat are linked with each other. Where rows of one id have different
    texts, links are found through each text's set, and the id's least signature and least text are what is compared.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed_path = write_table(spread(texts).mapInArrow(_sign(size), SIGNED), "signed")
    signed = spark.read.schema(SIGNED).parquet(signed_path)
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # Equal word sequences are one class, shown by its least id.
    classes = some.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep"))
    of_class = "doc_id long, rep long"
    member_path = write_table(some.select("doc_id", "s0", "s1").join(classes, ["s0", "s1"]).select("doc_id", "rep"), "members")
    members = spark.read.schema(of_class).parquet(member_path)
    reps = some.select("doc_id", "sig").join(members.where("doc_id = rep").select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("rep", "sig")
    sig_path = write_table(reps.groupBy("rep").agg(F.min("sig").alias("sig")), "reps")
    reps = spark.read.schema("rep long, sig binary").parquet(sig_path)

    # Buckets with more than one class; each with its least member.
    keyed = reps.mapInArrow(_band_keys, "bucket long, rep long, band int")
    shared = keyed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("_b"), "pivot")
    bucket_path = write_table(keyed.join(shared, F.col("bucket") == F.col("_b")).select("bucket", "rep", "band", "pivot"), "buckets")
    buckets = spark.read.schema("bucket long, rep long, band int, pivot long").parquet(bucket_path)

    # First: each class with the pivot that it shares most buckets with.
    pairs = buckets.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    best = pairs.groupBy("rep").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot"))
    best_path = write_table(best, "pairs")
    best = spark.read.schema("rep long, pivot long").parquet(best_path)
    sizes = best.groupBy(F.col("pivot").alias("_p")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_parts"))
    salted = best.join(sizes, F.col("pivot") == F.col("_p")).select("rep", "pivot", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int").alias("salt"))
    centres = sizes.select(F.col("_p").alias("rep"), F.col("_p").alias("pivot"), F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))).alias("salt"))
    # Centres are texts of their own in every salted part of their group.
    role_path = write_table(salted.union(centres), "roles")
    roles = spark.read.schema("rep long, pivot long, salt int").parquet(role_path)
    links = _with_text(texts, reps, roles, roles.count(), "rep").groupBy("pivot", "salt").applyInArrow(_stars(size, similarity), "a long, b long")
    link_path = write_table(links, "stars")
    links = spark.read.schema("a long, b long").parquet(link_path)
    first_path = write_table(components(links), "components")
    first = spark.read.schema("node long, component long").parquet(first_path)

    # Then: buckets that still hold several components, each set of members once.
    placed = buckets.join(first, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "band", F.coalesce("component", "rep").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("band").alias("band"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s0"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("s1")).where("lo <> hi")
    once = open_.groupBy("n", "s0", "s1").agg(F.min_by("bucket", "band").alias("_b")).select("_b")
    inside_path = write_table(placed.join(once, F.col("bucket") == F.col("_b"), "left_semi"), "inside")
    inside = spark.read.schema("bucket long, rep long, band int, component long").parquet(inside_path)
    # Members of a bucket's largest component are not compared with each other: each goes to one block of it, and only
    # the others' members go to all of its blocks.
    largest = inside.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy(F.col("bucket").alias("_b")).agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.max("n").alias("n"), F.sum("n").alias("of"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    largest = largest.select("_b", "top", blocks(F.col("n")).alias("bigs"), blocks(F.col("of") - F.col("n")).alias("smalls"))
    inside = inside.join(largest, F.col("bucket") == F.col("_b")).withColumn("big", F.col("component") == F.col("top"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("smalls"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_big = F.transform(upto(F.col("smalls")), lambda j: pair(F.col("block"), j))
    of_small = F.concat(F.transform(upto(F.col("bigs")), lambda i: pair(i, F.col("block"))), F.transform(upto(F.col("smalls")), lambda j: pair(-1 - F.least(F.col("block"), j), F.greatest(F.col("block"), j))))
    inside = inside.withColumn("ij", F.explode(F.when(F.col("big"), of_big).otherwise(of_small)))
    inside = inside.select("bucket", "rep", "component", "big", "block", "band", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"))
    kind = "bucket long, rep long, component long, big boolean, block int, band int, i int, j int"
    signed_in = inside.join(reps.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep")).drop("_rep")
    open_path = write_table(signed_in.groupBy("bucket", "i", "j").applyInArrow(_with_partner(similarity), kind), "open")
    inside = spark.read.schema(kind).parquet(open_path)
    more = _with_text(texts, reps, inside, inside.count(), "rep").groupBy("bucket", "i", "j").applyInArrow(_blocks(size, similarity), "a long, b long")
    more_path = write_table(more, "links")
    more = spark.read.schema("a long, b long").parquet(more_path)

    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(more)
    last = components(joined)
    result = members.join(last, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("component_id"))
    final_path = write_table(result.groupBy("_id").agg(F.min("component_id").alias("component_id")), "final")
    for path in (sig_path, bucket_path, best_path, role_path, link_path, inside_path, open_path, first_path, more_path, member_path):
        drop_table(spark, path)
    final = spark.read.schema("_id long, component_id long").parquet(final_path)
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def once_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text that has a word: that with the least id, nulls last, then with the least other columns.

    Texts are told apart by digest, and only those that stand more than once are shuffled. Rows without a word stay,
    but for repeats of one id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lonely = F.when(text.rlike(WORD), F.lit(None)).otherwise(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumns({"_key": F.sha2(text, 256), "_of": lonely})
    again = keyed.groupBy("_key", "_of").agg(F.count("*").alias("_n")).where("_n > 1")
    again = written(again.select(F.col("_key").alias("_k"), F.col("_of").alias("_o")), "repeated")
    n = again.count()
    if not n:
        return docs
    met = (F.col("_key") == F.col("_k")) & F.col("_of").eqNullSafe(F.col("_o"))
    few = _narrow(again, n)
    rest = [c for c in docs.columns if c != id_col]
    least = F.min(F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), *rest)).alias("_row")
    one = keyed.join(few, met, "left_semi").groupBy("_key", "_of").agg(least)
    one = one.select(*[F.col("_row._id" if c == id_col else f"_row.{c}").alias(c) for c in docs.columns])
    return keyed.join(few, met, "left_anti").select(docs.columns).unionByName(one)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is kept: one document of each group. Equal texts are one row before they are compared.

    Rows of one id with different texts are kept or dropped together. A row without an id goes only if its text stands
    elsewhere. Columns must be of types that can be ordered.
    """
    each = once_each(docs, id_col, how.get("text_col", "text"))
    docs = docs if each is docs else written(each, "once")
    dropped = near_duplicates(docs, id_col=id_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_drop")).distinct()
    path = write_table(dropped, "dropped")
    dropped = docs.sparkSession.read.schema("_drop long").parquet(path)
    return docs.join(_narrow(dropped, dropped.count()), F.col(id_col) == F.col("_drop"), "left_anti")


def _with_text(texts: DataFrame, reps: DataFrame, roles: DataFrame, n: int, key: str) -> DataFrame:
    """``roles`` with the text and the signature of each rep. Only texts that a role names are shuffled on."""
    named = roles.select(F.col(key).alias("_rep")).distinct()
    picked = texts.join(_narrow(named, n), F.col("doc_id") == F.col("_rep"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    with_sig = picked.join(reps.withColumnRenamed("rep", "_rep"), F.col("doc_id") == F.col("_rep")).select("doc_id", "text", "sig")
    return roles.join(with_sig, F.col(key) == F.col("doc_id")).drop("doc_id")
