"""WARC archives: a deterministic sharded writer and its reader.

Writing. Pages are sorted by key and cut into shards of ``shard_rows`` keys;
the cuts are exact positions in the order of all keys, so the same pages give
the same shards on any cluster. A task writes one shard: headers and digests
are made anew, every record is a gzip member of its own, and a file is closed
when its compressed size reaches ``file_bytes``. A file is written under a
temporary name of its attempt and renamed when it is whole; names follow from
shard and number, so a task that runs again replaces its own files. Which
files belong to the archive is said by the manifest, which Spark commits after
all shards.

Payloads that occur more than once and have ``least_bytes`` or more are kept
once: the record with the largest key is the response, the others are revisit
records that refer to it.

Reading goes over the files of the manifest in parallel, streams their members
and checks every digest. Paths are URIs of the shared folder.

Defined results: a null payload is the empty one. A null key sorts first and
is written as an empty id; rows that share a key go to the same shard and are
told apart by an occurrence number. Among equal payloads whose largest key
occurs twice, its last occurrence is the response. No pages give an archive
without files. Columns other than key, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches
from tablewright.operators.ordering import global_index
from tablewright.session import fresh_path, materialize, qualified


@dataclass(frozen=True)
class Settings:
    shard_rows: int = 500
    file_bytes: int = 1 << 20
    least_bytes: int = 1000
    level: int = 6
    #: Pages carry no date; a fixed one keeps archives reproducible.
    date: str = "2024-01-01T00:00:00Z"


_END = b"\r\n\r\n"
MANIFEST = "shard long, file string, n_records long, n_bytes long, sha256 string"
RECORDS = (
    "file string, offset long, record_type string, key string, occurrence int, url string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def record(kind: str, key: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: WARC headers, HTTP headers and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Date: {date}",
        ]
    return "\r\n".join(head).encode() + _END + block + _END


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def _clean(url: str | None) -> str:
    """A header holds no line breaks."""
    return "".join((url or "").splitlines())


def _originals(rows: DataFrame, settings: Settings) -> DataFrame:
    """digest and keep: the largest key of every payload that is kept once."""
    large = rows.where(F.col("size") >= settings.least_bytes).groupBy("digest").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n"))
    return large.where("n > 1 and keep is not null").select("digest", "keep")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", settings: Settings = Settings()) -> DataFrame:
    """Write the archive under ``path`` and return its manifest, as committed."""
    spark = pages.sparkSession
    # Without a scheme a path is one of Spark's default file system, not of each worker's disk.
    path = qualified(spark, path)
    small_batches(spark)
    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    slim = rows.select("key", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    slim = materialize(slim, "digests")
    order = global_index(slim.select("key").where("key is not null").distinct(), ["key"], "place")
    # One key for each shard; shards are as many as the archive has by its size.
    cuts = [r[0] for r in order.where(F.col("place") % settings.shard_rows == 0).orderBy("key").select("key").collect()]
    bounds = spark.sparkContext.broadcast(np.array(cuts))

    @F.pandas_udf("long")
    def shard_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        at = np.zeros(len(keys), dtype=np.int64)
        if known.any() and len(bounds.value):
            at[known] = np.searchsorted(bounds.value, keys[known].to_numpy().astype(bounds.value.dtype), side="right") - 1
        return pd.Series(np.maximum(at, 0))

    originals = _originals(slim, settings)
    # Only copies are told what they repeat; a payload with very many is dealt by Spark's skew handling.
    copies = slim.join(originals, "digest").select("key", "digest", "keep").distinct()
    # Keys go by name, so that a null among whole numbers cannot turn them into floats.
    named = [shard_of("key").alias("shard"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name")]
    written = rows.select(*named, F.coalesce("key", F.lit(0).cast(kind)).alias("key"), F.col("key").isNotNull().alias("known"), "url", "payload")
    told = copies.select(*named, "digest", F.col("keep").cast("string").alias("keep"))
    level, limit, date, least = settings.level, settings.file_bytes, settings.date, settings.least_bytes

    def write(shard_key: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        shard = int(shard_key[0])
        repeats = {(k, d): keep for k, d, keep in zip(told["name"], told["digest"], told["keep"], strict=True)}
        group = group.assign(digest=[hashlib.sha1(x).hexdigest() for x in group["payload"]])
        group = group.sort_values(["known", "key", "digest", "url"], kind="stable", na_position="first")
        occurrence = group.groupby("name", sort=False).cumcount()
        # Of a kept payload, the last occurrence of its key.
        last = group.assign(o=occurrence).groupby(["name", "digest"])["o"].max().to_dict()
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        out, n_records, done = bytearray(), 0, []

        def close() -> None:
            nonlocal out, n_records
            name = f"part-{shard:08d}-{len(done):05d}.warc.gz"
            temporary = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
            with fs.open_output_stream(temporary) as stream:
                stream.write(bytes(out))
            fs.move(temporary, posixpath.join(root, name))
            done.append((shard, name, n_records, len(out), hashlib.sha256(out).hexdigest()))
            out, n_records = bytearray(), 0

        for k, u, p, d, o in zip(group["name"], group["url"], group["payload"], group["digest"], occurrence, strict=True):
            keep = repeats.get((k, d)) if len(p) >= least else None
            if keep is not None and k == keep and o == last[k, d]:
                keep = None
            kind = "response" if keep is None else "revisit"
            out += _member(record(kind, f"{k}:{o}", _clean(u), p, d, keep, date), level)
            n_records += 1
            if len(out) >= limit:
                close()
        if n_records:
            close()
        return pd.DataFrame(done, columns=["shard", "file", "n_records", "n_bytes", "sha256"])

    manifest = written.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(write, MANIFEST)
    # The commit: files that no manifest row names are leftovers of lost attempts.
    manifest.write.mode("overwrite").parquet(posixpath.join(path, "_manifest"))
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(posixpath.join(path, "_manifest"))


def members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member of a file, read piece by piece."""
    offset = read = 0
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            if out or read > offset:
                raise ValueError(f"archive ends inside the record at {offset}")
            return
        if not rest:
            read += len(data)
        out.append(unpack.decompress(data))
        rest = b""
        if unpack.eof:
            yield offset, b"".join(out)
            rest = unpack.unused_data
            offset = read - len(rest)
            unpack, out = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """Fields of a record, its digests checked."""
    head, _, body = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    block = body[:int(named["content-length"])]
    if body[len(block):] != _END or f"sha1:{hashlib.sha1(block).hexdigest()}" != named["warc-block-digest"]:
        raise ValueError(f"broken record {named.get('warc-record-id')}")
    http, _, payload = block.partition(_END)
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if named["warc-type"] != "revisit" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"broken payload {named['warc-record-id']}")
    name, _, occurrence = named["warc-record-id"][len("<urn:page:"):-1].rpartition(":")
    refers = named.get("warc-refers-to")
    return {
        "record_type": named["warc-type"], "key": name or None, "occurrence": int(occurrence), "url": named["warc-target-uri"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": refers[len("<urn:page:"):-1] if refers else None,
        "payload": None if named["warc-type"] == "revisit" else payload,
    }


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files of the manifest, with the columns ``RECORDS``."""
    small_batches(spark)
    columns = [x.split()[0] for x in RECORDS.split(", ")]
    path = qualified(spark, path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(path)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for offset, data in members(stream):
                        rows.append({"file": name, "offset": offset, **parse(data)})
                        if len(rows) == 200:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"occurrence": "int32", "payload_bytes": "int64", "offset": "int64"})

    files = read_manifest(spark, path).select("file")
    # A row is a whole file of records. As many tasks as files: by their names alone they would all look small enough for one.
    return files.repartition(max(1, files.count()), "file").mapInPandas(read, RECORDS)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", settings: Settings = Settings(), path: str | None = None) -> DataFrame:
    """Write an archive, read it back, and describe its records: key, size, digest, type and what it refers to."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archive(pages, path, key, url, payload, settings)
    kind = dict(pages.dtypes)[key]
    found = read_archive(spark, path)
    return found.select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "file", "offset",
    )
