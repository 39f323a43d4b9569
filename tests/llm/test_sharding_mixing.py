import re
import zlib
from collections import Counter, defaultdict

from folio.llm.mixing import capped_targets, entropy_balance, mix_sources, mixed_documents
from folio.llm.sharding import shard_documents


def test_shards_hold_equal_bytes_and_slots_without_gaps(docs, rows):
    out = shard_documents(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in out:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest = max(r.size for r in out)
    assert set(bytes_) <= {0, 1, 2, 3} and max(bytes_.values()) <= sum(bytes_.values()) / 4 + largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_group_of_copies_is_split(spark):
    copies = spark.createDataFrame([(1, "the same text", "en", "s", 13)] * 400, "doc_id long, text string, lang string, source string, n_chars long")
    n = Counter(r.shard for r in shard_documents(copies, shards=8).collect())
    assert len(n) == 8 and max(n.values()) - min(n.values()) <= 3


def test_target_bytes_and_empty_tables(docs, empty):
    assert len({r.shard for r in shard_documents(docs, target_bytes=20_000).collect()}) > 3
    assert shard_documents(empty, shards=8).collect() == []


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]


def test_mix_meets_targets(docs, rows):
    out = mix_sources(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, words(t)) for d, t, *_ in rows)
    source = defaultdict(list)
    for r in out:
        source[r.source].append(r)
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    want = water_fill({s: sum(r.size for r in g) for s, g in source.items()})
    for s, g in source.items():
        assert abs(g[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in g) - want[s]) <= max(r.size for r in g)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_of_repeats_zero_sizes_and_nothing(spark, empty):
    assert mix_sources(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in mix_sources(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    same = spark.createDataFrame([(7, "a b c", "x")] * 50 + [(8, "d e", "y")] * 50, "doc_id long, text string, source string")
    out = mix_sources(same).collect()
    taken = sum(r.taken for r in out if r.doc_id == 7)
    assert abs(taken - next(r.target for r in out if r.doc_id == 7)) <= 3


def test_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 300.0), ("b", "x", 200.0), ("b", "y", 400.0)], "s string, l string, tokens double")
    by_s = spark.createDataFrame([("a", 500.0), ("b", 500.0)], "s string, target double")
    by_l = spark.createDataFrame([("x", 400.0), ("y", 600.0)], "l string, target double")
    out = entropy_balance(cells, [("s", by_s), ("l", by_l)], tolerance=1e-8).collect()
    total = defaultdict(float)
    for r in out:
        total[r.s] += r.tokens * r.rate
        total[r.l] += r.tokens * r.rate
    assert all(abs(total[k] - v) < 0.5 for k, v in {"a": 500, "b": 500, "x": 400, "y": 600}.items())


def test_mixed_documents_keep_columns(docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert max(n.values()) == 2


def test_targets_of_tied_and_empty_sources(spark):
    out = {r.source: r.target for r in capped_targets(spark.createDataFrame([("a", 10), ("b", 0), (None, 10)], "source string, tokens long")).collect()}
    assert out == {"a": 20.0, "b": 0.0, None: 10.0}


def test_joint_newton_is_what_a_direct_solver_finds(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    tokens = draw.integers(50, 900, (4, 3)).astype(float)
    rows, cols = tokens.sum(1) * draw.uniform(0.6, 1.6, 4), tokens.sum(0) * draw.uniform(0.6, 1.6, 3)
    cols *= rows.sum() / cols.sum()
    a = np.array([[float(i == k) for k in range(4)] + [float(j == k) for k in range(3)] for i in range(4) for j in range(3)])
    x = np.zeros(7)
    for _ in range(60):
        tilt = tokens.ravel() * np.exp(a @ x)
        step = np.linalg.lstsq(a.T @ (a * tilt[:, None]), np.append(rows, cols) - a.T @ tilt, rcond=None)[0]
        x += step / max(1, np.abs(step).max())
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", float(tokens[i, j])) for i in range(4) for j in range(3)], "s string, l string, tokens double")
    by_s = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(rows)], "s string, target double")
    by_l = spark.createDataFrame([(f"l{j}", float(v)) for j, v in enumerate(cols)], "l string, target double")
    rate = {(r.s, r.l): r.rate for r in entropy_balance(cells, [("s", by_s), ("l", by_l)], tolerance=1e-8).collect()}
    direct = np.exp(a @ x).reshape(4, 3)
    assert all(abs(rate[f"s{i}", f"l{j}"] - direct[i, j]) < 1e-7 for i in range(4) for j in range(3))


def brute_kd_tree(rows, leaves):
    """``rows``: (dimensions, digest, row, bytes). Leaf of each row: plain recursion at weighted medians."""
    whole = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(len(rows[0][0]))]
    out = {}

    def split(part, n, first):
        if n == 1 or not part:
            out.update((r[2], first) for r in part)
            return
        spans = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / whole[d] for d in range(len(whole))]
        dim = spans.index(max(spans))
        part = sorted(part, key=lambda r: (r[0][dim], r[1], r[2]))
        want, at = sum(r[3] for r in part) * (n // 2) / n, 0
        while at < len(part) - 1 and want > part[at][3]:
            want -= part[at][3]
            at += 1
        cut = at + (want >= part[at][3] / 2)  # the row at the median goes where more of it lies
        split(part[:cut], n // 2, first)
        split(part[cut:], n - n // 2, first + n // 2)

    split(rows, leaves, 0)
    return out


def test_shards_are_those_of_a_plain_tree(spark):
    import hashlib

    r = __import__("random").Random(4)
    texts = ["copied text " * 9] * 40 + ["w" * r.randint(0, 900) for _ in range(160)]
    data = [(k, t, r.choice(["en", "de", None]), f"source_{r.choice('abcde')}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = {x.doc_id: x.shard for x in shard_documents(docs, shards=7).collect()}
    rank = lambda v, c: sorted({x[c] for x in data} - {None}).index(v) if v is not None else -1
    rows = [((n, rank(s, 3), rank(lang, 2)), hashlib.md5(t.encode()).hexdigest()[:15], k, len(t) + 1) for k, t, lang, s, n in data]
    most = sum(x[3] for x in rows) / 7 / 16
    groups = defaultdict(list)
    for k, t, *_ in data:
        groups[t].append(k)
    together = [g for t, g in groups.items() if len(g) * (len(t) + 1) <= most]
    units = [(*rows[g[0]][:3], len(g) * rows[g[0]][3]) for g in together] + [rows[k] for t, g in groups.items() if g not in together for k in g]
    assert len(together[-1]) and len(units) < len(rows)
    leaf = brute_kd_tree(units, 7)
    assert found == leaf | {k: leaf[g[0]] for g in together for k in g}


def test_copies_stay_together_whatever_their_metadata(spark):
    """Also copies without an id, and rows that repeat; only a text above a sixteenth of a leaf is dealt out."""
    r = __import__("random").Random(6)
    texts = [f"text {k} " * r.randint(1, 30) for k in range(150)]
    data = [(r.choice([k, None]) if r.random() < 0.2 else k, r.choice(texts), r.choice(["en", None]), f"s{r.randint(0, 9)}", r.randint(0, 99)) for k in range(600)]
    data += data[:20] + [(1000 + k, "hot " * 30, "en", f"s{k % 3}", 9) for k in range(300)] + [(k, None, None, None, None) for k in (2000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = shard_documents(docs, shards=8).collect()
    assert Counter((x.doc_id, x.text_crc32) for x in out) == Counter((d, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    shards, bytes_ = defaultdict(Counter), Counter()
    for x in out:
        shards[x.text_crc32][x.shard] += x.size
        bytes_[x.shard] += x.size
    leaf = sum(bytes_.values()) / 8
    assert {c for c, s in shards.items() if len(s) > 1} <= {c for c, s in shards.items() if sum(s.values()) > leaf / 16}
    assert len(shards[zlib.crc32(b"hot " * 30)]) > 1 and max(bytes_.values()) - min(bytes_.values()) < leaf / 4
