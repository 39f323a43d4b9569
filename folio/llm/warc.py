"""WARC archives: a deterministic sharded writer, and a reader that trusts the manifest alone.

Each record is a gzip member of its own. Keys and lengths are sorted by ranges of page_id, and the running total of
compressed bytes in that order says where archives begin: archive k holds the members that start in the k-th share of
``roll`` bytes. So neither names nor contents depend on the number of tasks, and a rerun writes the same bytes. Payloads
are shuffled once, packed, each straight to the task that writes its archive; they are packed once before, for their
lengths, which costs less than a table of all records.

Headers and digests are made anew from the payload. A payload that a smaller page_id has already is not stored again:
its record is a revisit that names the first one. Archives are written under temporary names and moved to their own by
what the committed manifest lists; ``MANIFEST.json``, written last, is what readers go by.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import new_path, put, spread, written

#: Compressed bytes of an archive, and of a run of members that one task reads back.
ROLL, RUN = 128 << 20, 8 << 20
#: Packed bytes that a reader unpacks at a time.
PIECE = 1 << 14
#: Pages carry no date of their own.
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, REFERS = "X-Page-Id", "X-Refers-To-Page-Id"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same page has the same id in every run."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest))).urn}>"


def _target(url: str | None) -> str:
    """A URL that stands on one line of ASCII; what may stand in a header stays as it is."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def _block(fields: list[tuple[str, object]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, digest: str, n_bytes: int, payload: bytes = b"", first: tuple[int | None, str | None] | None = None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of ``first`` (page_id, url), which keeps the HTTP header alone.

    ``digest`` (base32 SHA-1) and ``n_bytes`` are the whole payload's.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http if first else http + payload
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(page_id, url, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _target(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(body)}"),
        (PAGE, page_id),
    ]
    if first:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Target-URI", _target(first[1])), ("WARC-Refers-To-Date", date), (REFERS, first[0])]
    return _block(fields, body)


def info_record(name: str, date: str = DATE) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{base32_sha1(body)}")], body)


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name: equal records have equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


PACKED = "page_id long, url string, digest binary, sha1 string, n_bytes long, record binary"
WEIGHED = PACKED.replace("record binary", "length long")
KEY = ["page_id", "url", "digest"]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _packed(page: int | None, url: str | None, payload: bytes) -> tuple:
    sha1 = base32_sha1(payload)
    return page, url, hashlib.sha256(payload).digest(), sha1, len(payload), member(page_record(page, url, sha1, len(payload), payload))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, payload to PACKED: every page as a response, in a gzip member."""
    for b in batches:
        for k in range(0, len(b), 256):
            yield _batch([_packed(*row) for row in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True)], PACKED)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, payload to WEIGHED: what ``_pack`` gives, with its length in place of the record."""
    for b in batches:
        for k in range(0, len(b), 256):
            rows = (_packed(*row) for row in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True))
            yield _batch([(*r[:-1], len(r[-1])) for r in rows], WEIGHED)


def _sorted_key(page: int | None, url: str | None, digest: bytes) -> tuple:
    return page is None, page or 0, url is None, (url or "").encode(), digest


def _in_order(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted rows (page_id, url, digest, kind, first_id, first_url, same, ...) of pages, each with the first that it
    revisits or None. What was found about a page (kind 0) stands right before it.

    Of rows alike in id, URL and payload the first is the response, if theirs is the least place.
    """
    known = seen = None
    for row in rows:
        key, kind, first, same = row[:3], row[3], row[4:6], row[6]
        if kind == 0:
            known = (key, first, same)
            continue
        told = known if known and known[0] == key else None
        yield row, told[1] if told and not (told[2] and seen != key) else None
        seen = key


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, len(b), 256):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True)


def _found_revisits(weighed: DataFrame, least_bytes: int) -> DataFrame:
    """Pages whose payload stands more than once, with the first that has it: found on digests and ids alone."""
    order = [F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url")]
    place = F.struct(*[c.alias(n) for c, n in zip(order, ("_no_id", "_id", "_no_url", "_url"), strict=True)])
    keyed = weighed.where(F.col("n_bytes") >= least_bytes).select(*KEY, place.alias("place"))
    # Written, so that both sides of the join are dealt by it and a payload that many pages share can be split.
    first = written(keyed.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    same = (F.col("place") == F.col("first")).alias("same")
    found = keyed.join(first, "digest").select(*KEY, F.lit(0).alias("kind"), F.col("first._id").alias("first_id"), F.col("first._url").alias("first_url"), same)
    return written(found.distinct(), "warc-revisits")


def _with_findings(pages: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Pages and what was found about them in one table: KEY, kind, first_id, first_url, same, then ``columns`` (null in findings)."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = dict(pages.dtypes)
    told = found.select(*KEY, "kind", "first_id", "first_url", "same", *[null(kinds[c], c) for c in columns])
    return told.union(pages.select(*KEY, F.lit(1), null("long", "first_id"), null("string", "first_url"), null("boolean", "same"), *columns))


def _by() -> list[Column]:
    return [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest")]


def _starts(weighed: DataFrame, found: DataFrame, roll: int) -> list[tuple]:
    """The least sort key of each archive, in order: a row an archive. Only lengths are sorted here, no payloads."""
    n = int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = _by()
    light = _with_findings(weighed, found, ["sha1", "n_bytes", "length"])
    dealt = light.repartitionByRange(n, *by).sortWithinPartitions(*by, "kind")
    schema = "part int, at long, length long, page_id long, url string, digest binary"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, out = TaskContext.get().partitionId(), 0, []
        for (page, url, digest, *_, sha1, n_bytes, length), first in _in_order(_rows(batches)):
            if first:
                length = len(member(page_record(page, url, sha1, n_bytes, first=first)))
            out.append((part, at, length, page, url, digest))
            at += length
            if len(out) >= 1 << 12:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    ordered = written(dealt.mapInArrow(lengths, schema), "warc-order")
    sizes = ordered.groupBy("part").agg(F.sum("length").alias("size"))  # a row a task
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = ordered.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    share = F.floor((F.col("before") + F.col("at")) / F.lit(roll))
    key = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "digest")
    least = based.groupBy(share.alias("share")).agg(F.min(key).alias("k")).orderBy("share").select("k.page_id", "k.url", "k.digest")
    return [_sorted_key(r.page_id, r.url, bytes(r.digest)) for r in least.toLocalIterator()]


RUNS = "archive string, temporary string, first long, length long, records long, total long, sha256 string"


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path``; returns the manifest: RUNS without temporary names.

    A null html is an empty payload; a null url becomes ``about:blank``. Records are in order of page_id, url, payload
    digest, nulls last. Of records with equal payloads of at least ``least_bytes`` bytes the first in that order is the
    response; rows that repeat a response are revisits of it. Rows alike in all three lie in one archive. No pages: no
    archive, an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    weighed = written(spread(plain).mapInArrow(_weigh, WEIGHED), "warc-weighed")
    found = _found_revisits(weighed, least_bytes)
    starts = _starts(weighed, found, roll)
    both = _with_findings(spread(plain).mapInArrow(_pack, PACKED), found, ["sha1", "n_bytes", "record"])

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield b.append_column("archive", pa.array([bisect_right(starts, _sorted_key(*k)) - 1 for k in keys], pa.int64()))

    placed = both.mapInArrow(archives, both.withColumn("archive", F.lit(0).cast("long")).schema)

    def store_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream of archives, each a stream of members; runs of about RUN bytes are what a reader takes at once."""
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        archive, out, sha = None, None, None
        runs: list[list] = []

        def close() -> pa.RecordBatch:
            out.close()
            total = runs[-1][3] + runs[-1][2]
            rows = [(f"{archive:06d}.warc.gz", own, at, length, n, total, sha.hexdigest()) for _, own, length, at, n in runs]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])

        def add(data: bytes) -> None:
            if runs[-1][2] >= RUN:
                runs.append([archive, own, 0, runs[-1][3] + runs[-1][2], 0])
            out.write(data)
            sha.update(data)
            runs[-1][2] += len(data)
            runs[-1][4] += 1

        for (page, url, _, *_, sha1, n_bytes, record, a), first in _in_order(_rows(batches)):
            if a != archive:
                if out is not None:
                    yield close()
                archive, own, sha = a, f".{uuid.uuid4().hex}", hashlib.sha256()
                out, runs = store.open_output_stream(f"{root}/{own}"), [[a, own, 0, 0, 0]]
                add(member(info_record(f"{a:06d}.warc.gz")))
            add(member(page_record(page, url, sha1, n_bytes, first=first)) if first else record)
        if out is not None:
            yield close()

    dealt = placed.repartition("archive").sortWithinPartitions("archive", *_by(), "kind")
    listed = written(dealt.mapInArrow(store_all, RUNS), "warc-manifest")
    return _commit(spark, listed, path)


def _commit(spark: SparkSession, listed: DataFrame, path: str) -> DataFrame:
    """Move what the manifest lists to its own name, and write MANIFEST.json: one name, size and digest an archive.

    Moving again is harmless: an archive that stands already with the size listed has been moved. Temporary files that
    the manifest doesn't list were left by tasks that ran twice; they go.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for own, name, total in zip(*(b.column(c).to_pylist() for c in ("temporary", "archive", "total")), strict=True):
                there = store.get_file_info(f"{root}/{own}").type != fs.FileType.NotFound
                if there:
                    put(store, f"{root}/{own}", f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != total:
                    raise ValueError(f"{name}: not the size that the manifest has")
            yield b

    one = listed.groupBy("archive").agg(F.first("temporary").alias("temporary"), F.first("total").alias("total"), F.first("sha256").alias("sha256"), F.sum("records").alias("records"))
    archives = written(one.repartition("archive").mapInArrow(move, one.schema), "warc-archives").orderBy("archive")
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    rows = archives.select("archive", "total", "sha256", "records").toLocalIterator()  # a row an archive
    own = f"{root}/.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for r in rows:
            out.write((json.dumps(r.asDict()) + "\n").encode())
    put(store, own, f"{root}/MANIFEST.json")
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith("."):
            store.delete_file(left.path)
    return listed.drop("temporary")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (names in lower case, the first of each) and block of each record in whole gzip members, or in plain bytes."""
    place = 0
    while place < len(data):
        if data[place : place + 2] == b"\x1f\x8b":
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof and place < len(data):  # a little at a time: what a member leaves over is copied
                piece = data[place : place + PIECE]
                parts.append(unpack.decompress(piece))
                place += len(piece)
            place -= len(unpack.unused_data)
            plain = b"".join(parts)
        else:
            plain, place = data[place:], len(data)
        at = 0
        while at < len(plain):
            stop = plain.find(b"\r\n\r\n", at)
            lines = plain[at:stop].decode("utf-8").split("\r\n")
            if stop < 0 or not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head: dict[str, str] = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                head.setdefault(name.strip().lower(), value.strip())
            start, n = stop + 4, int(head["content-length"])
            if plain[start + n : start + n + 4] != b"\r\n\r\n":
                raise ValueError("a record's length is not what its header says")
            yield head, plain[start : start + n]
            at = start + n + 4


PAGES = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _page(head: dict[str, str], block: bytes) -> tuple | None:
    if head["warc-type"] not in ("response", "revisit"):
        return None
    told = head["warc-payload-digest"].removeprefix("sha1:")
    if base32_sha1(block) != head["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"{head['warc-record-id']}: the block doesn't have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != n or base32_sha1(payload) != told):
        raise ValueError(f"{head['warc-record-id']}: the payload doesn't have its digest")
    number = lambda name: int(head[name.lower()]) if name.lower() in head else None
    return number(PAGE), head["warc-target-uri"], head["warc-type"], n, told, number(REFERS), None if revisit else payload


def read_warc(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Every page back from the archives: PAGES. Runs of members are read in parallel, each from its offset.

    Block and payload digests are made anew; one that differs from its header raises. A revisit's payload is null.
    """
    columns = PAGES if payloads else PAGES.rpartition(",")[0]
    width = len(columns.split(", "))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, at, length, n in zip(*(b.column(c).to_pylist() for c in ("archive", "first", "length", "records")), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(length, at)
                rows, seen = [], 0
                for head, block in records(data):
                    seen += 1
                    if (row := _page(head, block)) is not None:
                        rows.append(row[:width])
                    if len(rows) >= 256:
                        yield _batch(rows, columns)
                        rows = []
                if seen != n:
                    raise ValueError(f"{name} at {at}: {seen} records, the manifest has {n}")
                if rows:
                    yield _batch(rows, columns)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive", "first", "length", "records").repartition(n, "archive", "first").mapInArrow(read, columns)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(pages.sparkSession, "warc")
    back = read_warc(write_warc(pages, path), path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
