import hashlib
import io
import tarfile
import zlib

from pyarrow import fs

from folio.llm.common import new_path
from folio.llm.media import HEADER_BYTES, media_columns, payload_of, places, read_header, to_media, to_payload, with_metadata, write_shards


def test_media_columns(docs, rows, empty):
    got = media_columns(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    want = {}
    for d, t, *_ in rows:
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        want[d] = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), t or "")
    for r in got:
        n, p, sha, tail, text = want[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, p, sha, tail)
        assert r.media_bytes == r.length and r.width * r.height == p
        assert by_text.setdefault(text, (r.media_sha256, r.feature, r.offset, r.shard)) == (r.media_sha256, r.feature, r.offset, r.shard)
    assert media_columns(empty).collect() == []


def test_shards_are_tar_files_named_by_digest(spark, docs):
    path = new_path(spark, "media")
    index = write_shards(docs, path)
    store, root = fs.FileSystem.from_uri(path)
    row = index.first()
    with store.open_input_stream(f"{root}/{row['shard']}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        member = tar.getmember(f"{row['digest']}.png")
        data = tar.extractfile(member).read()
        assert member.offset_data == row["offset"] and hashlib.sha256(data).hexdigest() == row["digest"]
        assert len(tar.getnames()) == len(set(tar.getnames()))
    seen = with_metadata(places(index), path).collect()
    assert all(r.width == 192 and r.bits == 8 for r in seen) and len({r.digest for r in seen}) == len(seen)


def test_round_trip_and_headers():
    for t in (None, "", "x" * 192, "é" * 500):
        payload, _ = payload_of(t)
        media = to_media(payload)
        assert to_payload(media) == payload and read_header(media[:HEADER_BYTES])[:2] == (192, len(payload) // 192)
