"""Deterministic sharded WARC archives.

Records are sorted by identifier and dealt to shards by ranges of it. The cuts come from exact sums of
bytes over a fixed histogram of identifiers, not from a sample, so that equal tables give equal files
however they are partitioned. A task writes its shards in order, one gzip member a record, and rolls to
a new file at a compressed size. Headers and digests are made anew. Files are written under temporary
names; the driver renames those that the successful attempts report and then the manifest, so
a reader sees a whole archive or none, and lost executors or repeated tasks leave nothing but files that
no manifest names.

Equal payloads are stored once: the record with the smallest identifier is a response, the others
are revisits that refer to it and hold the HTTP headers alone.

Defined results: a null payload is empty; null identifiers sort last among equal payloads, first among
records; of rows with one identifier and payload the first is the response; a null or empty address
becomes ``urn:page:<id>``, and characters that a header can't hold are percent-encoded; an
empty table gives a manifest without files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import hadoop_path, join_unique, materialize

MANIFEST = "manifest.jsonl"
FILES = "shard int, seq int, temporary string, name string, records long, bytes long, sha1 string"
RECORDS = "record_id string, record_type string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: At most so many shards, whose files one driver can list.
MOST_SHARDS = 100_000
RECORD_OVERHEAD = 700
#: Bytes that a reader inflates at a time.
STEP = 4096


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{nth}>"


def record(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response or revisit record, uncompressed; nth tells rows of one identifier and payload apart."""
    own = f"urn:page:{'null' if page_id is None else page_id}"
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else own
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base32_sha1(payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, nth)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    else:
        block += payload
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    return gzip.compress(data, 6, mtime=0)


def info(date: str, name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: skyloom\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _ranges(sized: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """The first identifier of each shard after the first, by exact byte sums over equal cuts of the range, and the bytes of a shard."""
    low, high, total = sized.agg(F.min("id"), F.max("id"), F.sum("weight")).first()
    if low is None:
        return [], shard_bytes
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    found, heavy = [], [(low, high - low + 1)]
    while heavy:
        parts = max(4, min(4 * -(-total // shard_bytes), 4 * MOST_SHARDS) // len(heavy))
        cuts = [(a, max(1, -(-n // parts))) for a, n in heavy]
        spans = sized.sparkSession.createDataFrame([(a, a + n, step) for (a, n), (_, step) in zip(heavy, cuts, strict=True)], "a long, z long, step long")
        sums = sized.join(F.broadcast(spans), (F.col("id") >= F.col("a")) & (F.col("id") < F.col("z"))).groupBy((F.col("a") + F.floor((F.col("id") - F.col("a")) / F.col("step")) * F.col("step")).alias("at"), "step").agg(F.sum("weight").alias("w")).collect()
        heavy = [(r["at"], r["step"]) for r in sums if r["w"] > shard_bytes and r["step"] > 1]
        known = {a for a, _ in heavy}
        found += [(r["at"], r["w"]) for r in sums if r["at"] not in known]
    out, held = [], 0
    for at, w in sorted(found):
        if held and held + w > shard_bytes:
            out.append(at)
            held = 0
        held += w
    return out, shard_bytes


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z") -> list[str]:
    """Writes the archive, commits it, and returns the files' paths. folder: any URI that Spark and pyarrow both open.

    Shards hold shard_bytes before compression, files roll_bytes after it; both grow alike where there would be
    more than MOST_SHARDS shards.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    slim = materialize(rows.select("id", "digest", "bytes", (F.col("bytes") + RECORD_OVERHEAD).cast("long").alias("weight")), "warc-digests")
    groups = slim.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    again = groups.where("n > 1").select("digest", "least", "n")
    marks = join_unique(slim.select("id", "digest"), again, "digest", slim.count()).distinct()  # who has equal payloads, and which comes first
    starts, held = _ranges(slim, shard_bytes)
    cuts, roll_bytes = np.array(starts, np.int64), roll_bytes * held // shard_bytes

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    page = rows.select("id", "digest", F.lit(1).alias("mark"), "url", "payload", F.lit(None).cast("long").alias("least"))
    mark = marks.select("id", "digest", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "least")
    shard = shard_of(F.coalesce("id", F.lit(-(1 << 63)))).alias("shard")  # cuts as a closure: MOST_SHARDS numbers at most
    dealt = page.select(shard, "*").union(mark.select(shard, "*"))
    dealt = dealt.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "mark", "url")
    folder = folder.rstrip("/")
    temporary = f"{folder}/_temporary"
    fs, at = hadoop_path(spark, temporary)
    if fs.exists(hadoop_path(spark, f"{folder}/{MANIFEST}")[1]):
        raise FileExistsError(f"{folder} holds an archive")
    fs.mkdirs(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(temporary)
        out, shard, seq, done, again, last, nth = None, None, 0, [], None, None, 0

        def close():
            nonlocal out
            if out:
                out["stream"].close()
                done.append(out)
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["id"], row["digest"])
                if not row["mark"]:
                    again = (own, row["least"])
                    continue
                if row["shard"] != shard:
                    close()
                    shard, seq, last = row["shard"], 0, None
                elif out and out["bytes"] >= roll_bytes:
                    close()
                    seq += 1
                if not out:
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    path = f"{name}.{uuid.uuid4().hex}"
                    out = {"shard": shard, "seq": seq, "temporary": path, "name": name, "records": 0, "bytes": 0, "sha1": hashlib.sha1(), "stream": store.open_output_stream(f"{root}/{path}", compression=None)}
                    first = member(info(date, name))
                    out["stream"].write(first)
                    out["sha1"].update(first)
                    out["bytes"] += len(first)
                nth = nth + 1 if own == last else 0
                last = own
                repeats = bool(again) and again[0] == own
                least = again[1] if repeats else None
                revisit = repeats and (row["id"] != least or nth > 0)
                data = member(record(row["id"], nth, row["url"], row["payload"], least, revisit, date))
                out["stream"].write(data)
                out["sha1"].update(data)
                out["bytes"] += len(data)
                out["records"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist([{k: v.hexdigest() if k == "sha1" else v for k, v in x.items() if k != "stream"} for x in done], schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    made = sorted(dealt.mapInArrow(write, FILES).collect(), key=lambda r: r["name"])  # a row a file
    for r in made:
        if not fs.rename(hadoop_path(spark, f"{temporary}/{r['temporary']}")[1], hadoop_path(spark, f"{folder}/{r['name']}")[1]):
            raise OSError(f"{r['name']} can't be committed")
    _put(spark, f"{temporary}/{MANIFEST}", "".join(json.dumps({k: r[k] for k in ("name", "shard", "seq", "records", "bytes", "sha1")}) + "\n" for r in made))
    fs.rename(hadoop_path(spark, f"{temporary}/{MANIFEST}")[1], hadoop_path(spark, f"{folder}/{MANIFEST}")[1])
    fs.delete(at, True)
    return [f"{folder}/{r['name']}" for r in made]


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a .warc.gz file."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the last record is cut off")
            some = view[at : at + STEP]
            parts.append(inflate.decompress(some))
            at += len(some)
        at -= len(inflate.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]


def _page(uri: str) -> int | None:
    found = uri.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _parse(data: bytes) -> Iterator[dict]:
    for headers, block in records_of(data):
        if headers["warc-type"] == "warcinfo":
            continue
        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"{headers['warc-record-id']}: the block doesn't have its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        revisit = headers["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't have its digest")
        yield {
            "record_id": headers["warc-record-id"], "record_type": headers["warc-type"], "page_id": _page(headers["warc-record-id"]), "target_uri": headers["warc-target-uri"], "date": headers["warc-date"],
            "payload_digest": digest, "payload_bytes": size, "refers_to": _page(headers["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
        }


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the archive's manifest names, verified: RECORDS."""
    names = [r["name"] for r in spark.read.schema("name string").json(f"{folder}/{MANIFEST}").collect()]
    fields = RECORDS if with_payload else RECORDS.replace(", payload binary", "")
    if not names:
        return spark.createDataFrame([], fields)
    files = spark.read.format("binaryFile").load([f"{folder}/{x}" for x in names]).select("content")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for x in _parse(data.as_py()):
                    rows.append({k: x[k] for k in schema.names})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(parse, fields)
