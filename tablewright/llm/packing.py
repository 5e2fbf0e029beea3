"""Packed token-id matrices by best-fit-decreasing.

Documents are encoded, and those longer than a row are split into whole rows
and a rest, losing nothing. A pool of pieces is packed longest first, each into
the open row with the least room that still holds it. That row is found by a
segment tree over the remaining capacities 1..``row_tokens``: a node knows
whether an open row lies below it, so a search descends in log steps however
many rows are open.

A pool is packed when it holds ``pool_tokens``, and at the end of a task's
input. So packing needs no shuffle, a task holds one pool, and a lost task is
repeated from its input. Only the last row sets of a task are less full.

A matrix is one row of the result: its ids and the positions of all tokens as
little-endian binaries, the cumulative segment lengths of every matrix row, and
for each segment the document and the token where it starts in it. Positions
start at 0 in every segment; after the last segment follows ``pad``.

Defined results: null and empty texts have no tokens and fill no segment.
Repeated rows are packed as often as they occur. Columns other than key and
text are not read; the key may be null.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches


@dataclass(frozen=True)
class Settings:
    row_tokens: int = 2048
    pool_tokens: int = 1 << 20
    #: A value that is not an id of the vocabulary.
    pad: int = 50_256
    #: numpy type of ids and positions, wide enough for both.
    dtype: str = "<u2"


class OpenRows:
    """Open rows by remaining capacity, with a segment tree that finds the best fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Room and number of the fullest open row with at least ``length`` left; it is taken out."""
        node = self.size + length
        if not self.tree[node]:
            # Up to the first ancestor with something to its right, then down to its least.
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.tree[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in every row; each length is 1..capacity."""
    lengths = list(lengths)
    rows: list[list[int]] = []
    free = OpenRows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if not 0 < lengths[i] <= capacity:
            raise ValueError(f"a piece of {lengths[i]} tokens for rows of {capacity}")
        found = free.take(lengths[i])
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            free.put(room - lengths[i], row)
    return rows


def split(tokens: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Start and tokens of consecutive pieces of at most ``capacity``; together they are the document."""
    return [(i, tokens[i:i + capacity]) for i in range(0, len(tokens), capacity)]


def matrix(pieces: list[tuple], settings: Settings) -> tuple:
    """Rows, tokens, ids, positions, cumulative lengths, keys and starts of packed (key, start, tokens) pieces."""
    width = settings.row_tokens
    rows = best_fit_decreasing((len(p[2]) for p in pieces), width)
    ids = np.full((len(rows), width), settings.pad, dtype=settings.dtype)
    positions = np.zeros((len(rows), width), dtype=settings.dtype)
    lengths, keys, starts, total = [], [], [], 0
    for r, members in enumerate(rows):
        ends = [0]
        for i in members:
            key, start, tokens = pieces[i]
            at, end = ends[-1], ends[-1] + len(tokens)
            ids[r, at:end] = tokens
            positions[r, at:end] = np.arange(len(tokens), dtype=settings.dtype)
            ends.append(end)
            keys.append(key)
            starts.append(start)
        lengths.append(ends)
        total += ends[-1]
    return len(rows), total, ids.tobytes(), positions.tobytes(), lengths, keys, starts


def default_ranks() -> bytes:
    """A public byte-level vocabulary of the machine this runs on; a parameter everywhere."""
    with open(import_module("public_tokenizers").path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """One row for every matrix; see the module's text for the columns."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    # The files are read here and sent along: workers need no copy of their own.
    vocabulary = spark.sparkContext.broadcast((ranks or default_ranks(), pattern or import_module("public_tokenizers").PATTERN))
    kind = dict(docs.dtypes)[key]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoding(*vocabulary.value)
        task, n, held, pool = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pd.DataFrame:
            rows, total, ids, positions, lengths, keys, starts = matrix(pool, settings)
            return pd.DataFrame([{
                "task": task, "number": n, "n_rows": rows, "n_tokens": total, "input_ids": ids, "position_ids": positions,
                "cu_seqlens": lengths, "keys": keys, "starts": starts,
            }])

        for batch in batches:
            for name, content in zip(batch["key"], batch["text"], strict=True):
                if not content:
                    continue
                tokens = encoder.encode_to_numpy(content, disallowed_special=()).astype(settings.dtype)
                for start, piece in split(tokens, settings.row_tokens):
                    pool.append((name, start, piece))
                    held += len(piece)
                    if held >= settings.pool_tokens:
                        yield close()
                        n, held, pool = n + 1, 0, []
        if pool:
            yield close()

    # As text, so that a null among whole numbers cannot turn them into floats.
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(
        packed, "task int, number int, n_rows int, n_tokens long, input_ids binary, position_ids binary, "
        "cu_seqlens array<array<int>>, keys array<string>, starts array<long>",
    )
    return out.withColumn("keys", F.col("keys").cast(f"array<{kind}>"))


def segments(packed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """key, start and ids of every segment, cut out of the matrices again."""
    kind = dict(packed.dtypes)["keys"][len("array<"):-1]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, lengths, keys, starts in zip(batch["input_ids"], batch["cu_seqlens"], batch["keys"], batch["starts"], strict=True):
                rows = np.frombuffer(ids, dtype=settings.dtype).reshape(-1, settings.row_tokens)
                found = [rows[r, a:b].astype(np.int32) for r, ends in enumerate(lengths) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pd.DataFrame({"key": list(keys), "start": list(starts), "ids": found})

    small_batches(packed.sparkSession, 16)
    rows = packed.select("input_ids", "cu_seqlens", F.col("keys").cast("array<string>").alias("keys"), "starts")
    return rows.mapInPandas(cut, "key string, start long, ids array<int>").withColumn("key", F.col("key").cast(kind))


def write_matrices(packed: DataFrame, path: str) -> DataFrame:
    """Write each matrix as raw files under ``path`` (a URI all tasks reach) and commit their manifest.

    ``<name>.ids``, ``<name>.pos`` and ``<name>.cu`` (rows of cumulative
    lengths as 32-bit integers, one after another). Files are written under a
    temporary name and renamed; the manifest names those that count.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for row in batch.itertuples():
                name = f"matrix-{row.task:06d}-{row.number:06d}"
                cu = np.concatenate([np.asarray(x, dtype="<i4") for x in row.cu_seqlens]).tobytes()
                for suffix, data in (("ids", row.input_ids), ("pos", row.position_ids), ("cu", cu)):
                    temporary = posixpath.join(root, f".{name}.{suffix}.{uuid.uuid4().hex}")
                    with fs.open_output_stream(temporary) as stream:
                        stream.write(data)
                    fs.move(temporary, posixpath.join(root, f"{name}.{suffix}"))
                done.append((name, row.n_rows, row.n_tokens, hashlib.sha256(row.input_ids).hexdigest()))
            yield pd.DataFrame(done, columns=["name", "n_rows", "n_tokens", "sha256"])

    schema = "name string, n_rows int, n_tokens long, sha256 string"
    small_batches(packed.sparkSession, 16)
    columns = packed.select("task", "number", "n_rows", "n_tokens", "input_ids", "position_ids", "cu_seqlens")
    manifest = posixpath.join(path, "_manifest")
    columns.mapInPandas(write, schema).write.mode("overwrite").parquet(manifest)
    return packed.sparkSession.read.schema(schema).parquet(manifest)
