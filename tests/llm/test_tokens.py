import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folio.llm.bpe import Bpe
from folio.llm.common import new_path
from folio.llm.token_files import library_encoder, read_token_files, sequence, tokens_of_documents, write_token_files
from folio.llm.tokens import decode_documents, encode_documents, encoder, token_digests

VOCAB = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB[0])


@pytest.fixture(scope="module")
def bpe():
    return Bpe(*VOCAB)


def texts(n, seed=3):
    r = random.Random(seed)
    parts = ["a", "the", "ing", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\x85", " ", "　", "é", "中", "😀", "12", "²", "'s", "'", "!!", ".", ",", "<|endoftext|>", "<|", "\r\n", "hello", "Thingly"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(n)]


def test_backtracking_equals_the_library(bpe, library):
    for t in texts(1500) + ["".join(random.Random(k).choices("abcdeinrtosh", k=40)) for k in range(300)]:
        want = library.encode(t, add_special_tokens=False).ids
        got = bpe.encode(t)
        assert got.tolist() == want, repr(t)
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False) == t
        assert bpe.decimals(got) == ",".join(map(str, want)).encode()


def test_chunk_memory_equals_the_library(library):
    for ids_of in (library_encoder(VOCAB[0]), encoder(*VOCAB)[1]):
        for k in range(40):
            batch = texts(20, k)
            assert [np.frombuffer(x, "<u4").tolist() for x in ids_of(batch)] == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_digests(docs, rows, empty, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(docs, *VOCAB).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(d, t or "", library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows]
    assert got == {(d, len(i), sha(",".join(map(str, i))), sha(t)) for d, t, i in ids}
    assert token_digests(empty, *VOCAB).collect() == []


def test_round_trip(docs, rows):
    back = decode_documents(encode_documents(docs, *VOCAB), *VOCAB).collect()
    assert {(r.doc_id, r.text) for r in back} == {(d, t or "") for d, t, *_ in rows}


def test_token_files(docs, rows, empty, library):
    got = sorted(tokens_of_documents(docs, VOCAB[0], length=64).collect(), key=lambda r: r.start)
    want, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokens_of_documents(empty, VOCAB[0]).collect() == []


def test_random_access_to_sequences(spark, docs):
    path = new_path(spark, "tokens")
    manifest = write_token_files(docs, path, lambda: library_encoder(VOCAB[0]), length=64)
    part = manifest.orderBy("part").first()
    ids, real, end = sequence(path, part.part, 0)
    assert len(ids) == 64 and real.all() == (part.tokens >= 64) and end.any()
    first = read_token_files(manifest, path).orderBy("start").first()
    flat = np.frombuffer(first.ids, "<u4")
    assert flat[:64].tolist() == ids[: min(64, len(flat))].tolist()


def test_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in tokens_of_documents(df, VOCAB[0]).collect()) == [2, 3, 3]


def test_another_tokenizer_is_asked_for_whole_texts(spark, docs, rows):
    from folio.llm.token_files import cuts_safely, needs_wide

    other = public_tokenizers.path("word_bpe_49k.json")
    assert cuts_safely(VOCAB[0]) and not cuts_safely(other) and not needs_wide(other)
    tokenizer = Tokenizer.from_file(other)
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert sorted(r.n_tokens for r in tokens_of_documents(docs, other).collect()) == want
    batch = texts(60, 77)
    assert [np.frombuffer(x, "<u4").tolist() for x in library_encoder(other)(batch)] == [e.ids for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
