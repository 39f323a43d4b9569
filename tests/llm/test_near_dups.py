import numpy as np
import pytest

from folio.llm.components import components
from folio.llm.near_dups import BATCH, HASHES, least_matches, near_duplicates, without_duplicates

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, size, percent=80):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    ids = [d for d in sets if d is not None]
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(docs, rows, size):
    got = near_duplicates(docs, size=size).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_a_large_group_of_near_copies_and_repeats(spark):
    r = np.random.default_rng(1)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for d in range(700):
        w = list(base)
        for _ in range(int(r.integers(0, 8))):
            w[int(r.integers(80))] = f"x{r.integers(1000)}"
        rows.append((d, " ".join(w)))
    rows += [(0, rows[0][1])] * 2
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    want = brute(rows, 2)
    assert len(got) == 702 and all(r.component_id == want[r.doc_id][1] for r in got)


def test_nothing(empty, docs):
    assert near_duplicates(empty).collect() == []
    assert without_duplicates(docs).columns == docs.columns


def test_bounds_never_drop_what_is_similar():
    for n in range(BATCH, HASHES + 1, BATCH):
        m = least_matches(n, 0.8)
        draws = np.random.default_rng(n).binomial(n, 0.8, 200_000)
        assert (draws < m).mean() < 1e-4


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    from folio.llm import near_dups

    monkeypatch.setattr(near_dups, "BLOCK", 5)
    monkeypatch.setattr(near_dups, "BROADCAST_ROWS", 0)
    r = np.random.default_rng(9)
    rows = []
    for family in range(4):
        base = [f"w{family % 2}{k}" for k in range(60)]
        for k in range(45):
            w = list(base)
            for _ in range(int(r.integers(0, 9))):
                w[int(r.integers(60))] = f"x{r.integers(3000)}"
            rows.append((1000 * family + k, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    want = brute(rows, 1)
    assert all(r.component_id == want[r.doc_id][1] for r in got)
