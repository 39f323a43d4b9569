"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Every passage of ``LENGTH`` bytes that starts anywhere else too is removed, byte by byte of its cover. Suffixes are
taken at anchors: of any ``LENGTH`` bytes, the least hash of a ``GRAM``-byte string in them (the last of equal ones).
Equal passages choose the same place, so no repeat is missed, and only anchors whose gram occurs again go on.

Each task sorts its suffixes with what stands before them into runs, one per destination, front-coded: a suffix is
sent as the length it shares with the one before and the rest. A destination combines its runs with a loser tree that
keeps, for every run's head, the prefix it is known to share with the last output; heads with different known prefixes
are ordered by these lengths alone, and equal ones are compared from there on, so no known prefix is read again. The
merge yields the sorted suffixes and their common prefixes; in every group that shares a gram the longest match to the
left, for each length to the right, comes from neighbours in left order as groups of falling common prefix are united.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Hashes, drop_table, new_path, release, text_chunks, write_table

LENGTH, GRAM = 200, 40
#: Suffixes of one gram in a task; the pairs of a larger group's blocks meet in tasks of their own.
BLOCK = 100_000
#: Suffixes that go to one destination, besides those of larger groups; the number of destinations follows from their count.
IN_DEST = 100_000


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: each anchor's text, position in the buffer, and gram hash."""
    n, w = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(off)
    if n < length or not (sizes >= length).any():
        return none, none, none.astype(np.uint64)
    hashes = Hashes(raw)
    m = n - gram + 1
    at = np.arange(m)
    h = hashes.of(at, at + gram)
    bits = np.uint64(m.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | (low - at.astype(np.uint64))
    padded = np.full(-(-m // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = np.maximum(sizes - length + 1, 0)
    first = np.cumsum(count) - count
    start = np.arange(count.sum()) + np.repeat(off[:-1] - first, count)
    chosen = low - (np.minimum(back[start], ahead[start + w - 1]) & low)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])].astype(np.int64)
    return np.searchsorted(off, chosen, "right") - 1, chosen, h[chosen]


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


# A suffix here is (right, left, places): up to LENGTH bytes from the anchor on, up to LENGTH - GRAM bytes before it in
# reverse, and the (text, position) of every occurrence with just these.


def front_coded(suffixes: list[tuple[bytes, bytes, list]]) -> dict:
    """A sorted run as columns: what each right and left side shares with the one before, lengths, rests, places."""
    shared, lengths, rest, n_places, places = [], [], [], [], []
    last_right, last_left = b"", b""
    for right, left, where in suffixes:
        r = common(right, last_right)
        same = r == len(right) == len(last_right)
        s = common(left, last_left) if same else 0
        shared.append((r, s))
        lengths.append((len(right), len(left)))
        rest += (right[r:], left[s:])
        n_places.append(len(where))
        places += where
        last_right, last_left = right, left
    flat = np.array(places, np.int64).reshape(-1, 3)
    return {"shared": np.array(shared, "u1").tobytes(), "lengths": np.array(lengths, "u1").tobytes(), "rest": b"".join(rest), "n_places": np.array(n_places, "<i4").tobytes(), "places": flat.tobytes()}


def decoded(run: dict) -> Iterator[tuple[int, bytes, bytes, list]]:
    """The suffixes of a run in order, each with the length its right side shares with the one before."""
    shared = np.frombuffer(run["shared"], "u1").reshape(-1, 2).tolist()
    lengths = np.frombuffer(run["lengths"], "u1").reshape(-1, 2).tolist()
    counts = np.frombuffer(run["n_places"], "<i4").tolist()
    places = np.frombuffer(run["places"], np.int64).reshape(-1, 3).tolist()
    rest, at, place, right, left = run["rest"], 0, 0, b"", b""
    for (r, s), (n, m), k in zip(shared, lengths, counts, strict=True):
        right, at = right[:r] + rest[at : at + n - r], at + n - r
        left, at = left[:s] + rest[at : at + m - s], at + m - s
        yield r, right, left, places[place : place + k]
        place += k


class LoserTree:
    """Merges sorted runs; yields (shared, right, left, places), ``shared`` with the suffix yielded before."""

    def __init__(self, runs: list[dict]) -> None:
        self.runs = [decoded(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.known = [0] * len(runs)  # what each head shares with the last output, or with the head that beat it
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size

    def _first(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads."""
        x, y = self.heads[a] if a >= 0 else None, self.heads[b] if b >= 0 else None
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = self.known[a], self.known[b]
        if p != q:  # the one that shares more with the last output comes first
            return (a, b) if p > q else (b, a)
        r, s = x[1], y[1]
        both = p + common(r[p:], s[p:])
        if both == len(r) == len(s):
            won = x[2] <= y[2]
        else:
            won = both == len(r) or both < len(s) and r[both] < s[both]
        win, lose = (a, b) if won else (b, a)
        self.known[lose] = both
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, list]]:
        n = len(self.runs)
        won = [k if k < n else -1 for k in range(self.size)]
        level = self.size
        tree = won
        while level > 1:
            level //= 2
            up = []
            for k in range(level):
                win, lose = self._first(tree[2 * k], tree[2 * k + 1])
                self.losers[level + k] = lose
                up.append(win)
            tree = up
        best = tree[0] if tree else -1
        while best >= 0 and self.heads[best] is not None:
            _, right, left, places = self.heads[best]
            yield self.known[best], right, left, places
            self.heads[best] = head = next(self.runs[best], None)
            if head is not None:
                self.known[best] = head[0]
            node = (best + self.size) // 2
            while node:
                best, self.losers[node] = self._first(best, self.losers[node])
                node //= 2


def longest(shared: list[int], lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """Of suffixes in order that share a gram (``shared[k]`` with the one before): how far repeats reach left and right of each.

    A repeat is a match with another suffix of at least ``length`` bytes in all; every repeat holds the anchor, so their
    union is one stretch. Groups are united at falling common prefixes. In a group the longest match to the left is
    with a neighbour in left order, and only new neighbours need be looked at.
    """
    m = len(lefts)
    reach = [[0, 0] for _ in range(m)]
    order = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for k, i in enumerate(order):
        rank[i] = k

    def meet(x: int, y: int, right: int) -> None:
        i, j = order[x], order[y]
        a, b = reach[i], reach[j]
        left = common(lefts[i], lefts[j])
        if left + right >= length:
            for e in (a, b):
                if e[0] < left:
                    e[0] = left
                if e[1] < right:
                    e[1] = right

    groups: dict[int, list[int]] = {k: [rank[k]] for k in range(m)}  # by first member
    first = list(range(m))  # of each group's last member

    levels: dict[int, list[int]] = {}
    for k in range(1, m):
        levels.setdefault(shared[k], []).append(k)
    for right in sorted(levels, reverse=True):
        cuts = levels[right]
        at = 0
        while at < len(cuts):
            # Groups that touch at this level: each starts where the one before ends.
            head = first[cuts[at] - 1]
            parts = [groups.pop(head)]
            last = cuts[at] - 1
            while at < len(cuts) and cuts[at] == last + 1:
                k = cuts[at]
                part = groups.pop(k)
                parts.append(part)
                last = k + len(part) - 1
                at += 1
            big = max(parts, key=len)
            few = sum(map(len, parts)) - len(big)
            if few * 8 < len(big):
                for part in parts:
                    if part is not big:
                        for x in part:
                            to = bisect_left(big, x)
                            if to:
                                meet(big[to - 1], x, right)
                            if to < len(big):
                                meet(x, big[to], right)
                            big.insert(to, x)
            else:
                big = sorted(x for part in parts for x in part)
                for x, y in zip(big, big[1:], strict=False):
                    meet(x, y, right)
            groups[head] = big
            first[last] = head
    return [tuple(e) for e in reach]


def _settle(merged: Iterator[tuple[int, bytes, bytes, list]], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(text keys, start, end) of every stretch of repeats, from the merged suffixes."""

    def close(group: list) -> Iterator[tuple[int, int, int, int]]:
        if len(group) == 1:
            reach = [(0, 0)]
        else:
            reach = longest([g[0] for g in group], [g[2] for g in group], [g[1] for g in group], length)
        for (_, right, left, places), (before, after) in zip(group, reach, strict=True):
            if len(places) > 1 and len(left) + len(right) >= length:
                before, after = len(left), len(right)
            if after:
                for k0, k1, pos in places:
                    yield k0, k1, pos - before, pos + after

    group: list = []
    for shared, right, left, places in merged:
        if group and (shared < gram or len(right) < gram):
            yield from close(group)
            group = []
        if group and shared == len(right) == len(group[-1][1]) and left == group[-1][2]:
            group[-1][3].extend(places)
            continue
        group.append([shared, right, left, list(places)])
    if group:
        yield from close(group)


RUN = pa.schema([("dest", pa.int64()), ("shared", pa.binary()), ("lengths", pa.binary()), ("rest", pa.binary()), ("n_places", pa.binary()), ("places", pa.binary())])
RUN_SQL = "dest long, shared binary, lengths binary, rest binary, n_places binary, places binary"
SPAN_SQL = "k0 long, k1 int, start int, stop int"


def _find_anchors(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            k0, k1 = b.column("k0").to_numpy(), b.column("k1").to_numpy()
            for i, _, raw, off in text_chunks(b.column("text")):
                doc, pos, h = anchors(raw, off, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(k0[i + doc]), pa.array(k1[i + doc]), pa.array((pos - off[doc]).astype(np.int32)), pa.array(h.view(np.int64))], names=["k0", "k1", "pos", "gram"])

    return rows


def _make_runs(length: int, gram: int, at_once: int = 48 << 20):
    """Rows (k0, k1, text, spots: pos, gram, parts) to front-coded runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, dict[tuple[bytes, bytes], list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for dest, found in held.items():
                run = front_coded([(r, s, w) for (r, s), w in sorted(found.items())])
                yield pa.RecordBatch.from_pydict({"dest": [dest], **{k: [v] for k, v in run.items()}}, schema=RUN)

        for b in batches:
            for k in range(0, len(b), 64):
                cut = b.slice(k, 64)
                for k0, k1, text, spots in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    data = text.encode()
                    for spot in spots:
                        pos, g, parts, buckets = spot["pos"], spot["gram"], spot["parts"], spot["buckets"]
                        key = (data[pos : pos + length], data[max(0, pos - length + gram) : pos][::-1])
                        if parts == 1:
                            dests = ((g % buckets),)
                        else:  # block pairs of a large group have numbers of their own
                            own = hash((k0, pos)) % parts
                            dests = tuple(-1 - (hash((g, min(own, o), max(own, o))) & (2**62 - 1)) for o in range(parts))
                        for dest in dests:
                            held.setdefault(dest, {}).setdefault(key, []).append((k0, k1, pos))
                            size += len(key[0]) + len(key[1]) + 200
                if size > at_once:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return rows


def _merge(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        runs = table.drop_columns(["dest"]).to_pylist()
        found = list(_settle(iter(LoserTree(runs)), length, gram))
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("k0", "k1", "start", "stop"), cols, kinds, strict=True)})

    return run


def spans_kept(n: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """What stays of n bytes; how many go, in how many maximal runs."""
    kept, at, gone, runs = [], 0, 0, 0
    stop = -1
    for a, b in sorted(spans):
        if a > stop:
            if a > at:
                kept.append((at, a))
            runs += 1
            gone += b - a
            stop = b
        elif b > stop:
            gone += b - stop
            stop = b
        at = max(at, stop)
    if at < n:
        kept.append((at, n))
    return kept, gone, runs


def _cut(with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for k in range(0, len(b), 256):
                out = []
                cut = b.slice(k, 256)
                for k0, k1, text, copies, starts, stops in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    data = text.encode()
                    spans = [(0, len(data))] if copies > 1 else list(zip(starts or (), stops or (), strict=True))
                    kept, gone, runs = spans_kept(len(data), spans)
                    rest = b"".join([data[i:j] for i, j in kept])
                    out.append((k0, k1, gone, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text and gone else None))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k0", "k1", "n_removed", "n_spans", "kept_sha256", "rest"])

    return rows


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", with_text: bool = False) -> tuple[DataFrame, list]:
    """k0, k1, n_removed, n_spans, kept_sha256 (and the rest of the text) of each distinct text of at least ``length`` bytes.

    Also the key columns' expressions. Texts are keyed by 88 bits of their SHA-256, so equal texts are looked at once
    and rows that repeat, or have no id, need no care. The distinct texts are written bucketed by key: later steps join
    them in place, and texts are shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    keys = [F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("k0"), F.conv(F.substring(digest, 16, 7), 16, 10).cast("int").alias("k1")]
    distinct = docs.where(F.octet_length(text) >= length).select(*keys, text.alias("text")).groupBy("k0", "k1").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    path = new_path(spark, "texts")
    name = "folio_" + path.rpartition("-")[2]
    distinct.write.bucketBy(n, "k0", "k1").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    found = texts.select("k0", "k1", "text").mapInArrow(_find_anchors(length, gram), "k0 long, k1 int, pos int, gram long")
    # Counts are aggregated before they are shuffled, and anchors are joined with them, so that a gram with a large share of
    # all anchors is split; a window over grams would put it into one task.
    grams_path = write_table(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    grams = spark.read.schema("gram long, n long").parquet(grams_path)
    dests = max(n, -(-(grams.agg(F.sum("n")).first()[0] or 0) // IN_DEST))
    again = found.join(grams, "gram")
    spot = F.struct("pos", "gram", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"), F.lit(dests).cast("long").alias("buckets"))
    spots = again.groupBy("k0", "k1").agg(F.collect_list(spot).alias("spots"))
    runs = texts.select("k0", "k1", "text").join(spots.hint("merge"), ["k0", "k1"]).select("k0", "k1", "text", "spots").mapInArrow(_make_runs(length, gram), RUN_SQL)
    spans_path = write_table(runs.groupBy("dest").applyInArrow(_merge(length, gram), SPAN_SQL), "spans")
    spans = spark.read.schema(SPAN_SQL).parquet(spans_path)
    by_text = spans.groupBy("k0", "k1").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    whole = texts.join(by_text.hint("merge"), ["k0", "k1"], "left").select("k0", "k1", "text", "copies", "starts", "stops")
    out_sql = "k0 long, k1 int, n_removed long, n_spans long, kept_sha256 string, rest string"
    out_path = write_table(whole.mapInArrow(_cut(with_text), out_sql), "repeats")
    spark.sql(f"DROP TABLE {name}")
    for p in (path, grams_path, spans_path):
        drop_table(spark, p)
    return spark.read.schema(out_sql).parquet(out_path), keys


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of ``docs``.

    A null text is empty. Texts shorter than ``length`` keep everything. Texts that repeat as a whole go as a whole, every
    one of them. An empty table gives an empty one.
    """
    result, keys = repeats(docs, length, gram, text_col)
    text, zero = F.coalesce(F.col(text_col), F.lit("")), F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    # Short texts have nothing to look up, and all empty ones would share a key.
    short = rows.where(F.col("n_bytes") < length).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    keyed = rows.where(F.col("n_bytes") >= length).withColumns({"_k0": F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), "_k1": F.conv(F.substring("sha", 16, 7), 16, 10).cast("int")})
    met = keyed.join(result, (F.col("_k0") == F.col("k0")) & (F.col("_k1") == F.col("k1")), "left")
    return met.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")).union(short)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; a character that a cut leaves in part goes as a whole.

    Rows stay, with an empty text where all of it repeats; null and short texts stay as they are.
    """
    result, keys = repeats(docs, length, gram, text_col, with_text=True)
    changed = result.where("n_removed > 0").select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), F.col("rest").alias("_rest"))
    enough = F.coalesce(F.octet_length(text_col) >= length, F.lit(False))
    keyed = docs.where(enough).select("*", keys[0].alias("_a"), keys[1].alias("_b"))
    met = keyed.join(changed, (F.col("_a") == F.col("_k0")) & (F.col("_b") == F.col("_k1")), "left")
    cut = met.withColumn(text_col, F.when(F.col("_k0").isNotNull(), F.col("_rest")).otherwise(F.col(text_col))).select(*docs.columns)
    return cut.unionByName(docs.where(~enough))
