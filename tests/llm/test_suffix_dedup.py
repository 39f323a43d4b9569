import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folio.llm.suffix_dedup import LoserTree, anchors, common, decoded, front_coded, longest, removed, spans_kept, without_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 40), (30, 12)])
def test_repeats_are_those_of_all_substrings(docs, rows, length, gram):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed(docs, length, gram).collect())
    want = brute([t for _, t, *_ in rows], length)
    assert got == Counter((d, *w) for (d, *_), w in zip(rows, want, strict=True))


def test_rows_that_repeat_and_nothing(spark, empty, docs):
    assert removed(empty).collect() == []
    text = "".join(random.Random(2).choices("abcdefgh ", k=500))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text[:150])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in removed(twice).collect()) == [(1, 500), (1, 500), (2, 0)]
    assert without_repeats(docs).columns == docs.columns


def test_kept_text(spark):
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcdeé fgh ", k=n))
    passage = prose(260)
    df = spark.createDataFrame([(k, f"{k} {prose(50)}#{passage}#{prose(50)}", "keep") for k in range(3)] + [(9, None, None)], "doc_id long, text string, other string")
    out = {x.doc_id: x for x in without_repeats(df).collect()}
    assert out[9].text is None and all(passage not in out[k].text and out[k].text.startswith(str(k)) and out[k].other == "keep" for k in range(3))


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(1)
    make = lambda: (bytes(r.choices(b"ab", k=r.randint(1, 12))), bytes(r.choices(b"ab", k=r.randint(0, 3))))
    for n in range(1, 8):
        all_, runs = [], []
        for k in range(n):
            own = sorted({make() for _ in range(r.randint(1, 40))})
            all_ += own
            runs.append(front_coded([(a, b, [(k, 0, i)]) for i, (a, b) in enumerate(own)]))
            assert [(a, b) for _, a, b, _ in decoded(runs[-1])] == own
        out = list(LoserTree(runs))
        assert [(a, b) for _, a, b, _ in out] == sorted(all_)
        assert all(h == common(x[1], y[1]) for (h, *_), x, y in zip(out[1:], out, out[1:], strict=False))


def test_longest_repeats_against_all_pairs():
    r = random.Random(7)
    for _ in range(200):
        own = sorted({(bytes(r.choices(b"ab", k=8)), bytes(r.choices(b"ab", k=5))) for _ in range(r.randint(2, 30))})
        rights, lefts = [a for a, _ in own], [b for _, b in own]
        shared = [0] + [common(x, y) for x, y in zip(rights, rights[1:], strict=False)]
        want = []
        for i in range(len(own)):
            pairs = [(common(lefts[i], lefts[j]), common(rights[i], rights[j])) for j in range(len(own)) if j != i]
            good = [p for p in pairs if sum(p) >= 7]
            want.append((max((p[0] for p in good), default=0), max((p[1] for p in good), default=0)))
        assert longest(shared, lefts, rights, 7) == want


def test_anchors_are_chosen_by_content():
    r = np.random.default_rng(3)
    passage = r.integers(97, 105, 400, dtype=np.uint8)
    a = np.concatenate([r.integers(97, 105, 300, dtype=np.uint8), passage])
    b = np.concatenate([r.integers(97, 105, 77, dtype=np.uint8), passage])
    raw, off = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    doc, pos, h = anchors(raw, off)
    at = [{int(p - off[d] - s) for d, p in zip(doc, pos, strict=True) if d == k} for k, s in ((0, 300), (1, 77))]
    assert {p for p in at[0] & at[1] if p >= 0} and len(h) == len(doc)


def test_spans_kept():
    assert spans_kept(10, [(2, 4), (3, 6), (6, 7)]) == ([(0, 2), (7, 10)], 5, 1)
    assert spans_kept(3, []) == ([(0, 3)], 0, 0)
    assert spans_kept(3, [(0, 3)]) == ([], 3, 1)


def test_large_groups_meet_in_blocks(docs, rows, monkeypatch):
    from folio.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    got = Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in removed(docs, 60, 20).collect())
    want = brute([t for _, t, *_ in rows], 60)
    assert got == Counter((d, *w[1:]) for (d, *_), w in zip(rows, want, strict=True))
