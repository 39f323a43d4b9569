import random
import re

import numpy as np
import pytest

from folio.llm import chat, quality, toxicity
from folio.llm.common import text_bytes


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)]


def labelled(n=1500):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "st", "a", "ou"]) for _ in range(r.randint(1, 3)))
    out = []
    for k in range(n):
        w = [word() for _ in range(r.randint(40, 120))]
        bad, toxic = r.random() < 0.2, r.random() < 0.3
        if bad:
            w = [x.upper() + r.choice(["!!", "###", "$$$"]) for x in w]
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum", "worthless"]))
        out.append((k, " ".join(w), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = labelled()
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int"), rows


def test_statistics(docs, rows, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(docs, None).collect()}
    want = set()
    for d, t, *_ in rows:
        c = plain_counts(t)
        want.add((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == want
    assert quality.assess(empty, None).collect() == []


def test_trees_learn_and_stay_monotone(corpus):
    docs, labels, rows = corpus
    forest = quality.fit(docs, labels, sample_rows=900)
    kept = {r.doc_id: r.kept for r in quality.assess(docs, forest).collect()}
    assert np.mean([kept[d] == bool(q) for d, _, q, _ in rows]) > 0.98
    x = np.repeat(np.random.default_rng(1).random((50, len(quality.FEATURES))), 20, axis=0)
    for name in quality.MONOTONE:
        y = x.copy()
        y[:, quality.FEATURES.index(name)] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(forest.scores(y).reshape(50, 20), axis=1) <= 1e-9).all()
    assert quality.keep_good(docs, forest).columns == docs.columns
    assert quality.train(np.zeros((0, 12)), np.zeros(0)) is None


def test_flat_trees_score_like_nested_ones():
    r = np.random.default_rng(2)
    x = r.random((400, len(quality.FEATURES)))
    f = quality.train(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=5)

    def walk(row, at):
        while f.left[at] != at:
            at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
        return f.value[at]

    assert np.allclose(f.scores(x[:50]), [f.bias + sum(walk(row, k) for k in f.roots) for row in x[:50]])


def test_toxicity_on_rows_it_has_not_seen(corpus, docs, empty):
    texts, labels, rows = corpus
    model = toxicity.fit(texts, labels)
    got = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    away = [(d, t) for d, _, _, t in rows if got[d].held_out]
    assert len(away) > 150 and np.mean([got[d].predicted == t for d, t in away]) > 0.95
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    same = {r.doc_id: r.score for r in toxicity.score(texts, toxicity.fit(texts, flipped)).collect()}
    assert all(same[d] == got[d].score for d in same)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).collect() == [] and {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.fit(texts, labels.where("toxic = 0")) is None


def test_windows_hold_the_whole_text():
    for n in (1, 7, 24, 64):
        for t in (b"", b"a", b"some words and more of them " * 5, b"x" * 200):
            ends = toxicity.cuts(t, n)
            assert (ends[-1] if t else 0) == len(t) and all(0 < j - i <= n for i, j in zip([0, *ends], ends, strict=False))


def test_distances_are_those_of_single_windows():
    import zstandard

    ordinary, toxic = b"the words of ordinary texts and others " * 20, b" idiot moron scum worthless " * 4
    how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    plain = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (ordinary, ordinary + toxic)]
    texts = ["The words of an IDIOT and other ordinary texts", None, "", "x", "worthless words and a moron of the others " * 9, "é" * 100]
    x = toxicity.Distance(ordinary, toxic).features(texts)
    for t, row in zip(texts, x, strict=True):
        data = (t or "").lower().encode()
        ends = toxicity.cuts(data, toxicity.WINDOW)
        parts = [toxicity.LEAD + data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        saved = sorted((len(plain[0].compress(p)) - len(plain[1].compress(p)) for p in parts), reverse=True)
        n = np.array([sum(v >= k for v in saved) for k in toxicity.SAVED])
        want = [sum(saved[:1]), sum(saved[:2]), sum(saved[:4]), *np.log1p(n), *n / max(1, len(saved)), np.log1p(len(saved))]
        assert np.allclose(row, want)


def test_long_texts_and_clashing_labels_are_learned_from(spark, corpus):
    _, _, rows = corpus
    long = [(5000 + k, " ".join(t for _, t, *_ in rows[k * 60 : k * 60 + 60] if not rows[k * 60][3]) + " idiot", 1) for k in range(20)]
    texts = [(d, t) for d, t, *_ in rows] + [(d, t * 2) for d, t, _ in long] + [(9001, rows[0][1])]
    assert max(len(t) for _, t in texts) > 40_000
    labels = [(d, t) for d, _, _, t in rows] + [(d, y) for d, _, y in long] + [(9001, 1 - rows[0][3])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fits = [toxicity.fit(docs.repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int")) for n in (2, 5)]
    assert fits[0].toxic == fits[1].toxic and fits[0].ordinary == fits[1].ordinary and np.array_equal(fits[0].weight, fits[1].weight)


def test_transcripts(spark):
    r = random.Random(3)
    rows = []
    for c in range(150):
        for t in range(r.randint(2, 8)):
            role = "user" if t % 2 == 0 else "assistant"
            line = "a question about it?" if role == "user" else "\n".join(["an answer that goes on for quite a while and then some more."] * r.randint(2, 4))
            rows.append((c, t, role, line))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(turns)
    out = chat.parse_transcripts(chat.transcripts(turns), model, ["conv_id", "true_roles"]).collect()
    assert np.mean([x.roles == x.true_roles for x in out]) > 0.95
    got = chat.turns_of(model, ["Human: is it so?\nAI: an answer that goes on for quite a while and then some more.\nan answer that goes on for quite a while and then some more.\nHuman: and why?", None, "", "### System\nrules"])
    assert [r for r, _ in got[0]] == ["user", "assistant", "user"] and got[1] == got[2] == [] and got[3][0][0] == "system"
    assert chat.render(*got[0][0]) == "<|user|>\nis it so?\n<|end|>\n"
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", "")], turns.schema)
    assert chat.parse_transcripts(chat.transcripts(odd), model, ["conv_id"]).count() == 2
    assert chat.parse_transcripts(chat.transcripts(turns.limit(0)), chat.fit(turns.limit(0)), ["conv_id"]).collect() == []


def test_a_long_conversation_is_one_transcript(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"words of turn {t}.") for c, n in ((0, 400), *((k, 3) for k in range(1, 40))) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(turns)
    step = np.exp(model.move[:3, :3])
    # counts and one each, those between turns 63 and 64 and so on with the others
    assert np.allclose(step / step.sum(1, keepdims=True), np.array([[1, 41, 1], [1, 1, 239], [1, 200, 1]]) / [[43], [241], [202]])
    assert np.allclose(np.exp(model.start[:3]), np.array([41, 1, 1]) / 43)
    raw = {r.conv_id: r for r in chat.transcripts(turns).collect()}
    assert len(raw) == 40 and raw[0].true_roles == "s" + "ua" * 199 + "u" and "words of turn 399." in raw[0].text
    out = {r.conv_id: r for r in chat.parse_transcripts(chat.transcripts(turns), model, ["conv_id"]).collect()}
    for c in (0, 1, 39):
        want = chat.turns_of(model, [raw[c].text])[0]
        assert out[c].rendered == "".join(chat.render(*x) for x in want) and out[c].n_turns == len(want)
    assert "s" not in out[0].roles[1:] and len(out[0].roles) > 380
    lines = [chat.marked_lines(raw[0].text)]
    seen = [np.array([(m + 1, *chat._seen(x)) for m, x in part]) for part in lines]
    assert [r for r, _ in chat.turns_of(model, [raw[0].text])[0]] == [chat.ROLES[s] for s in chat.viterbi(model, seen)[0] if s < 3]


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(4)
    m = chat.Model(*(np.log(r.random(s)) for s in ((6,), (6, 6), (6, 4), (6, len(chat.LENGTHS) + 1), (6, 3))))
    for n in (1, 2, 4):
        seen = np.column_stack([r.integers(0, 4, n), r.integers(0, 5, n), r.integers(0, 3, n)])
        emit = m.marker.T[seen[:, 0]] + m.length.T[seen[:, 1]] + m.ending.T[seen[:, 2]]
        best = max(product(range(6), repeat=n), key=lambda p: m.start[p[0]] + emit[range(n), list(p)].sum() + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert chat.viterbi(m, [seen, np.zeros((0, 3), int)])[0].tolist() == list(best)


def test_text_bytes_of_slices_and_nulls():
    import pyarrow as pa

    raw, off = text_bytes(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(raw) == "é".encode() and off.tolist() == [0, 0, 2, 2]
