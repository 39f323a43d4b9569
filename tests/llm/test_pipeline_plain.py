"""The whole pipeline against plain Python, stage by stage, on the smallest tables and rows that are odd."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    """What the trees look at, one text at a time."""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeat = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    w, c = max(1, len(words)), max(1, sum(map(len, words)))
    count = lambda chars: sum(text.count(x) for x in chars)
    features = [
        math.log1p(len(words)), sum(map(len, words)) / w, count("#*$%&|<>") / c, (len(lines) - len(set(lines))) / max(1, len(lines)), repeat / w, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, count("0123456789") / c,
        count("!?@^~=+_/\\{}[]") / c, len(set(words)) / w, len(words) / max(1, len(lines)), sum(len(x) > 20 for x in words) / w, sum(x[-1] in ".?!:;" for x in words) / w,
    ]
    return features, len(words) < 10 or 100 * repeat > 20 * len(words)


def plain_quality(rows, forest):
    def verdict(text):
        x, failed = plain_features(text or "")
        if failed:
            return False
        total = forest.bias
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + math.exp(-total)) >= 0.5

    return [r for r in rows if verdict(r["text"])]


def plain_once(rows):
    """One row of each text with a word, that of the least id; wordless rows once an id."""
    least = {}
    place = lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for k, v in r.items() if k != "doc_id")
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, place(r))):
        text = r["text"] or ""
        least.setdefault((text, None if WORD.search(text) else r["doc_id"]), r)
    return list(least.values())


def plain_near_duplicates(rows):
    sets, rows = [], plain_once(rows)
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r["doc_id"]), r["doc_id"])
    return [r for k, r in enumerate(rows) if r["doc_id"] == least[find(k)]]


def plain_repeats(rows):
    data = [(r["text"] or "").encode() for r in rows]
    seen = Counter(hash(x[i : i + 200]) for x in data for i in range(len(x) - 199))
    out = []
    for r, x in zip(rows, data, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[hash(x[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        text = bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else r["text"]
        out.append(r | {"text": text, "n_chars": len(text or "")})
    return out


def plain_mix(rows):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    of = defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    total, weight = {s: sum(map(size, of[s])) for s in names}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(total.values()), {}
    while True:
        free = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    out = []
    for s in names:
        rate = min(target[s] / total[s], 2.0) if total[s] else 0.0
        whole = math.floor(rate + 1e-9)
        fraction, need, sure = rate - whole, target[s] - whole * total[s], 0
        u = {id(r): (int(hashlib.md5(f"17-{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for r in of[s]}
        for r in sorted(of[s], key=lambda r: (u[id(r)], r["doc_id"])):
            sure += size(r)
            extra = fraction > 1e-9 and sure - size(r) / 2 <= need
            out += [r] * ((whole + extra) if rate > 0 else 0)
    return out


def test_run_is_what_plain_code_finds(spark):
    held_against_plain_code(spark, SF)


def test_run_on_odd_tables(spark, docs, tmp_path):
    """Repeated rows, nulls, empty and long texts; every id that quality keeps is left, once a group."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.union(docs.where("doc_id % 4 = 0")).union(docs.where("doc_id % 8 = 0")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k < 40 or k % 3 > 0), 0) for k in range(0, 100, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held_against_plain_code(spark, str(tmp_path))


def test_no_document_vanishes(spark):
    """A row that stands twice is neither two documents of a group nor a repeat of itself."""
    r = random.Random(4)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(120))
    rows = [(k, prose(), "en", "s", 1) for k in range(20)]
    texts = {k: t for k, t, *_ in rows}
    rows += [rows[3], rows[3], (None, texts[5], "en", "s", 1), (None, "w " + prose(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.no_repeated_passages(spark, corpus_pipeline.one_of_near_duplicates(spark, docs, ""), "").collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter([*texts.items(), (None, rows[-1][1])])


def held_against_plain_code(spark, SF):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    now = spark.read.parquet(f"{SF}/documents.parquet")
    plain = (lambda r: plain_quality(r, forest), plain_near_duplicates, plain_repeats, plain_mix)
    key = lambda r: tuple(str(r[c]) for c in docs.columns)
    from folio.llm.common import written

    for (name, stage), what in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        now, rows = written(stage(spark, now, SF), name), what(rows)
        assert Counter(key(r.asDict()) for r in now.collect()) == Counter(map(key, rows)), name
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in rows]
    want = Counter((d, len(i), sha(",".join(map(str, i))), sha(t)) for d, i, t in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want
