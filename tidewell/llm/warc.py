"""WARC archives with revisit records.

Payloads are written once, as response records, by map tasks; the headers of the records (file, ordinal, id, digest,
length) come back as a table. Headers alone are shuffled by payload digest to choose each payload's original, revisits
are joined to it, and each archive is rewritten with fresh headers, payloads of revisits left out. Digests of many
records (at most `HOT` of them can hold more than 1/HOT of the rows) are joined by broadcast, the others by shuffle,
so that no key holds a large part of the join.

Files are written under a name of the attempt and moved into place, so that a repeated task replaces its own work; what failed
attempts left is swept away. The tasks that rewrite and read archives are as many as there are archives, whatever little their
headers weigh. Null html: an empty payload. Null id: a record without the id's header; it is never preferred as original. Ids of
any type are carried as text. Of equal ids
with equal payloads the later record is the original. Payloads under `least` bytes are always responses. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import materialize, scratch, slices

HOT = 1000
DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, key: str, url: str, digest: str, length: int, payload: bytes | None, page_id: object, refers: tuple[str, object, str] | None = None, date: str = DATE) -> bytes:
    """One record as a gzip member. key: what the record's id is made of; refers: key, id and url of the original."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE_ID, key)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {_line(str(page_id))}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE_ID, refers[0])}>", f"WARC-Refers-To-Target-URI: {_line(refers[2])}", f"WARC-Refers-To-Date: {date}"]
        if refers[1] is not None:
            head.append(f"X-Refers-To-Page-ID: {_line(str(refers[1]))}")
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _line(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in "\r\n")


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a .warc.gz stream, one in memory at a time."""
    import gzip

    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := data.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            yield headers, data.read(int(headers["content-length"]))


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The HTTP body, and the length that its headers name."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            return body, int(line.split(b":")[1])
    return body, len(body)


class Archive:
    """Writes one file under a name of its own and moves it into place when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bytes = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)


def sweep(folder: str) -> None:
    """Removes what attempts that didn't end have left, once their job has."""
    system, path = fs.FileSystem.from_uri(folder)
    for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.type == fs.FileType.File and not f.path.endswith(".warc.gz"):
            system.delete_file(f.path)


def _tasks(archives: int) -> int:
    """Partitions for so many archives: enough that few meet in one, up to a number that a driver can take."""
    return max(1, min(4 * archives, max(archives, 5_000), 50_000))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = 256 << 20, date: str = DATE) -> DataFrame:
    """Every row as a response record; returns the headers: file, ordinal, page_id, url, payload_bytes, digest."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, k, out = TaskContext.get().partitionId(), 0, 0, None
        for b in slices(batches, 2):
            rows: dict[str, list] = {c: [] for c in ("file", "ordinal", "id", "url", "payload_bytes", "digest")}
            for page_id, url, body in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or out.bytes >= file_bytes:
                    if out:
                        out.close()
                    name, n, k = f"part-{part:06d}-{n:05d}.warc.gz", n + 1, 0
                    out = Archive(f"{folder}/{name}")
                digest = hashlib.sha1(body).hexdigest()
                out.write(record("response", f"raw/{name}/{k}", url, digest, len(body), body, page_id, date=date))
                for c, v in zip(rows, (name, k, page_id, url, len(body), digest)):
                    rows[c].append(v)
                k += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows["file"], pa.string()), pa.array(rows["ordinal"], pa.int64()), pa.array(rows["id"], b.schema.field(0).type), pa.array(rows["url"], pa.string()), pa.array(rows["payload_bytes"], pa.int64()), pa.array(rows["digest"], pa.string())], names=list(rows))
        if out:
            out.close()

    picked = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    made = picked.mapInArrow(run, f"file string, ordinal long, id {kind}, url string, payload_bytes long, digest string")
    out = materialize(made, "warc-headers")
    sweep(folder)
    return out


def resolve_revisits(headers: DataFrame, least: int = 1000) -> DataFrame:
    """headers with refer_id, refer_key, refer_url: null where the record is the original, or alone, or small."""
    whole = headers.where(F.col("payload_bytes") >= least)
    groups = whole.groupBy("digest").agg(F.max(F.struct("id", "file", "ordinal", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "warc-originals")
    many = headers.count() // HOT + 1
    hot, cold = groups.where(F.col("n") > many), groups.where(F.col("n") <= many)  # hot: fewer than HOT rows
    marked = headers.join(F.broadcast(hot.select("digest", F.col("first").alias("f"))), "digest", "left")
    direct = marked.where("f IS NOT NULL")
    rest = marked.where("f IS NULL").drop("f").join(cold.select("digest", F.col("first").alias("f")), "digest", "left")
    both = direct.unionByName(rest)
    other = F.col("f").isNotNull() & ~(F.col("f.file").eqNullSafe(F.col("file")) & F.col("f.ordinal").eqNullSafe(F.col("ordinal"))) & (F.col("payload_bytes") >= least)
    pick = lambda c: F.when(other, c)
    return both.select(*headers.columns, pick(F.col("f.id")).alias("refer_id"), pick(F.concat_ws("/", F.col("f.file"), F.col("f.ordinal"))).alias("refer_key"), pick(F.col("f.url")).alias("refer_url"))


def rewrite_archives(resolved: DataFrame, raw: str, folder: str, date: str = DATE) -> DataFrame:
    """Each raw archive again, with revisits in place of repeated payloads and fresh headers; returns file, records."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["file"].iloc[0]
        revisit = group[group["refer_key"].notna()]
        refers = {int(k): (f"new/{key}", None if pd.isna(i) else i, url) for k, key, i, url in zip(revisit["ordinal"], revisit["refer_key"], revisit["refer_id"], revisit["refer_url"])}
        source, path = fs.FileSystem.from_uri(f"{raw}/{name}")
        out, n = Archive(f"{folder}/{name}"), 0
        try:
            with source.open_input_stream(path, compression=None) as stream:
                for n, (h, block) in enumerate(read_records(stream), 1):
                    body, length = payload_of(block)
                    to = refers.get(n - 1)
                    out.write(record("revisit" if to else "response", f"new/{name}/{n - 1}", h["warc-target-uri"], h["warc-payload-digest"].removeprefix("sha1:"), length, None if to else body, h.get("x-page-id"), to, date))
            if n != len(group):
                raise ValueError(f"{name}: {n} records, {len(group)} headers")
        except BaseException:
            out.abandon()
            raise
        out.close()
        return pd.DataFrame({"file": [name], "records": [n]})

    # whether an id is null is in refer_id; whole numbers stay whole as text
    sent = resolved.select("file", "ordinal", F.col("refer_id").cast("string").alias("refer_id"), "refer_key", "refer_url")
    spread = sent.repartition(_tasks(sent.select("file").distinct().count()), "file")
    out = materialize(spread.groupBy("file").applyInPandas(run, "file string, records long"), "warc-files")
    sweep(folder)
    return out


def read_archives(files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests of kept payloads are computed again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                source, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                with source.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for h, block in read_records(stream):
                        body, length = payload_of(block)
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its headers")
                        rows.append((h.get("x-page-id"), length, digest, h["warc-type"], h.get("x-refers-to-page-id")))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["i", "payload_bytes", "payload_digest", "record_type", "r"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["i", "payload_bytes", "payload_digest", "record_type", "r"])

    names = files.select("file").repartition(_tasks(files.count()), "file")
    back = names.mapInPandas(run, "i string, payload_bytes long, payload_digest string, record_type string, r string")
    return back.select(F.col("i").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("r").cast(id_type).alias("refers_to"))


def deduplicated_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Writes, resolves, rewrites and reads back; the archives are left in `folder`/deduplicated. date: of the records, by default now."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or scratch(pages.sparkSession, "warc")
    headers = write_archives(pages, f"{folder}/raw", id_col, url_col, body_col, date=date)
    files = rewrite_archives(resolve_revisits(headers, least), f"{folder}/raw", f"{folder}/deduplicated", date)
    return read_archives(files, f"{folder}/deduplicated", pages.schema[id_col].dataType.simpleString())


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM m
"""
