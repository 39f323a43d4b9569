"""The filter audit, the conversation trie and the archives against plain Python, on odd tables."""

import base64
import glob
import gzip
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from folio.llm import audit, trie, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, rows):
    return Counter(map(tuple, df.collect())) == Counter(rows)


# --- filter audit


def plain_audit(docs, labels):
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    seen = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        seen[lang or ""].append((frozenset(k for k, v in fails.items() if v), *(marks[i] if i is not None else [False, False])))
    for part, found in seen.items():
        shapley, rows = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = sum(f in x[0] for x in found)
                rows.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        for r in rows:
            yield (*r[:-1], shapley[r[-1]])


def test_audit(spark, docs, rows):
    labels = [(k, r.randint(0, 1), r.randint(0, 1)) for r in [random.Random(3)] for k in range(0, 90, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (10**9, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    twice = docs.union(docs.where("doc_id % 3 = 0"))
    plain = [(r.doc_id, r.text, r.lang) for r in twice.collect()]
    assert same(audit.audit_documents(twice, told), plain_audit(plain, labels))


def test_audit_of_rows_without_ids_and_copies_across_parts(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (3, "a b", "y"), (2, "a b", None), (2, "a b", ""), (2, "a b", None), (9, None, "y"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert same(audit.audit_documents(docs, labels), plain_audit(rows, []))


def test_audit_of_long_texts(spark):
    rows = [(k, (f"w{k} " * 400_000) + "#" * k, "en") for k in range(3)] + [(7, "Ab" * 1_500_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert same(audit.audit_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), plain_audit(rows, []))


def test_audit_of_nothing(spark, empty):
    assert audit.audit_documents(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in audit.adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


# --- trie


def plain_rebuilt(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own[c].append((turn is not None, turn or 0, r.encode(), digest, (r, t)))
    lists = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    for c, mine in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - int(c - 5 * int(c / 5))
        yield c, tuple(lists.get(lead, [])[:h] + mine[h:])


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences:
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    saved = {s: (len(m) - 1) * len(s[-1][1].encode()) if s else 0 for s, m in members.items()}
    leaves = {s: int(not children[s]) for s in members}
    for s in sorted(members, key=len, reverse=True):
        if s:
            saved[s[:-1]] += saved[s]
            leaves[s[:-1]] += leaves[s]
    for s, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
        yield min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], digest


TURNS = "conv_id long, turn long, role string, text string, depth int, node string, light string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "l") for r in rows], TURNS).repartition(3)


def test_trie(spark):
    r = random.Random(1)
    rows = []
    for c in [*range(-12, 60), *range(1000, 1040), 5_000_000_000, None]:
        for k in r.sample(range(14), r.randint(1, 14)):
            rows.append((c, None if r.random() < 0.1 else k, r.choice(["user", "assistant", None, ""]), r.choice(["a", "bé", "", None, "long " * 50])))
    rows += [x for x in rows if r.random() < 0.05]
    assert same(trie.prefix_trie(turns_of(spark, rows)), plain_trie(plain_rebuilt(rows)))


def own_prefixes(turns):
    """Conversations as they are: no turns taken over."""
    return trie.rebuilt(turns).sparkSession.createDataFrame(list(chained(turns)), trie.PREFIXES)


def chained(turns):
    by = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append(r.text)
    for c, texts in by.items():
        node, before = trie.ROOT, None
        for d in range(len(texts) + 1):
            yield c, d, node, before, len(texts[d - 1]) if d else 0, d == len(texts)
            if d < len(texts):
                node, before = hashlib.blake2b(node + texts[d].encode(), digest_size=16).digest(), node


@pytest.mark.parametrize("kind", ["comb", "caterpillar", "star", "binary", "deep"])
def test_trie_shapes(spark, kind):
    """Shapes where heavy paths change their least member often, hang deep, or fan out at one node."""
    n = 40
    words = {
        "comb": [["x"] * k + ["y"] for k in range(n)],
        "caterpillar": [["x"] * (n - k) + [f"y{k}"] * 3 for k in range(n)],
        "star": [[f"s{k % 30}", "t"] for k in range(3 * n)],
        "binary": [list(f"{k:06b}") for k in range(64)],
        "deep": [["z"] * 300 for _ in range(3)] + [["z"] * 150 + ["w"] * 150],
    }[kind]
    rows = [(c, k, None, t) for c, s in enumerate(words) for k, t in enumerate(s)]
    got = trie.prefix_trie(turns_of(spark, rows), own_prefixes)
    assert same(got, plain_trie([(c, tuple((None, t) for t in s)) for c, s in enumerate(words)]))


def test_trie_of_one_conversation_that_many_repeat(spark):
    rows = [(5 * c, k, "user", f"t{k}") for c in range(3000) for k in range(2)]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(turns_of(spark, rows)).collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2)]
    assert got[0, 2].ends_sha256 == hashlib.sha256(",".join(str(5 * c) for c in range(3000)).encode()).hexdigest()
    assert got[0, 0].saved_tokens == 2 * 2 * 2999


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert trie.prefix_trie(turns_of(spark, [(None, 1, "user", "x")])).count() == 0


# --- archives


PAGES = "page_id long, url string, html string, record string, part int, kind string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], PAGES)


def sha1(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain_pages(rows, least=0):
    first, kind = {}, []
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode())
    for r in sorted(rows, key=order):
        text = r[2] or ""
        known = first.get(text) if len(text.encode()) >= least else None
        kind.append((r[0], len(text.encode()), sha1(text), "revisit" if known else "response", known[0] if known else None))
        first.setdefault(text, (r[0],))
    return kind


def odd_pages():
    r = random.Random(2)
    rows = [(k, f"http://h/{k}", r.choice(["<p>a</p>", "", None, "é\r\n\r\nWARC/1.1", "x" * r.randint(0, 9000)])) for k in r.sample(range(-50, 500), 200)]
    rows += [(7000, None, "<p>a</p>"), (None, "http://x/ y\r\nZ: 1", "<p>a</p>"), (None, None, "only here"), (None, None, "only here"), (3000, "http://ü", "b" * 3_000_000)]
    return rows + rows[:20] + rows[:3]


@pytest.mark.parametrize("least", [0, 1, 10_000])
def test_archives(spark, tmp_path, least):
    rows = odd_pages()
    manifest = warc.write_warc(pages_of(spark, rows).repartition(5), f"file://{tmp_path}/w", least, roll=20_000)
    back = warc.read_warc(manifest, f"file://{tmp_path}/w")
    assert same(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), plain_pages(rows, least))
    texts = Counter((r.page_id, r.payload.decode()) for r in back.where("record_type = 'response'").collect())
    assert texts == Counter((i, next(t or "" for j, _, t in rows if j == i and sha1(t or "") == d)) for i, _, d, k, _ in plain_pages(rows, least) if k == "response")


def files(folder):
    return {p.rpartition("/")[2]: open(p, "rb").read() for p in glob.glob(f"{folder}/*")}


def test_archives_are_the_same_whatever_the_tasks(spark, tmp_path):
    rows = odd_pages()
    for name, n, parts in (("a", 1, "4"), ("b", 7, "9")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        warc.write_warc(pages_of(spark, rows[::-1] if n > 1 else rows).repartition(n), f"file://{tmp_path}/{name}", roll=20_000)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 3
    assert not glob.glob(f"{tmp_path}/a/.*[!c]")  # nothing temporary is left but checksums
    listed = [json.loads(x) for x in a["MANIFEST.json"].decode().splitlines()]
    assert {x["archive"]: (x["total"], x["sha256"]) for x in listed} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in a.items() if k != "MANIFEST.json"}
    # Plain gzip reads them; every record has the fields that its type needs.
    for name, data in a.items():
        if name != "MANIFEST.json":
            plain = gzip.decompress(data)
            heads = [h for h, _ in warc.records(plain)]
            assert [h for h, _ in warc.records(data)] == heads and heads[0]["warc-type"] == "warcinfo" and heads[0]["warc-filename"] == name
            for h in heads[1:]:
                assert {"warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "warc-block-digest", "content-type"} <= h.keys()
                assert (h["warc-type"] == "revisit") == ("warc-refers-to" in h)


def test_revisits_name_the_record_of_their_response(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", "other"), (1, "u1", "same")]
    warc.write_warc(pages_of(spark, rows), f"file://{tmp_path}/w")
    heads = [h for h, _ in warc.records(files(tmp_path / "w")["000000.warc.gz"])][1:]
    assert [(h["x-page-id"], h["warc-type"]) for h in heads] == [("1", "response"), ("1", "revisit"), ("2", "response"), ("3", "revisit")]
    assert heads[3]["warc-refers-to"] == heads[0]["warc-record-id"] and heads[3]["warc-refers-to-target-uri"] == "u1"


def test_a_changed_byte_is_found(spark, tmp_path):
    record = warc.page_record(1, "u", warc.base32_sha1(b"payload"), 7, b"payload")
    ((head, block),) = warc.records(record)
    assert warc._page(head, block)[:2] == (1, "u")
    with pytest.raises(ValueError):
        warc._page(head, block.replace(b"payload", b"Payload"))


def test_archives_of_nothing(spark, tmp_path):
    manifest = warc.write_warc(pages_of(spark, []), f"file://{tmp_path}/w")
    assert warc.read_warc(manifest, f"file://{tmp_path}/w").count() == 0 and files(tmp_path / "w") == {"MANIFEST.json": b""}
