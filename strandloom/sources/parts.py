"""Files written as parts by all tasks, the bytes of each file joined by one more."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .places import new_folder, staged

_ROWS = 2000


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and path for a plain path or URI."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of a batch of one target each, of some rows at most."""
    targets, low = batch.column("__target").to_pylist(), 0
    while low < len(targets):
        high = min(low + _ROWS, len(targets))
        if targets[high - 1] != targets[low]:
            high = next(i for i in range(low, high) if targets[i] != targets[low])
        yield targets[low], batch.slice(low, high - low)
        low = high


def write_parts(records: DataFrame, order: list[str], encode: Callable[[pa.RecordBatch], bytes | list[bytes]], is_table: bool = False, kinds: tuple[str, ...] = ()) -> list:
    """Write runs of records (with ``__target``) in order beside their targets; ``target, at, part`` of each.

    Ranges are found by a sample, which computes the records once more: unless they are a
    table already, they are written as one first. With ``kinds`` records have bytes for each of them,
    which go to the target with the kind as its last ``*``.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = None if is_table else new_folder(records.sparkSession, "parts")
    if folder:
        records = staged(records, folder)
    ranged = records.repartitionByRange(n, "__target", *order).sortWithinPartitions("__target", *order)

    def write(batches):
        from pyspark import TaskContext

        target, outs = None, []

        def opened(own: str) -> tuple:
            system, place = open_uri(own)
            system.create_dir(place.rpartition("/")[0] or ".", recursive=True)
            part = f"{own}.{uuid.uuid4().hex}.part"
            return own, part, system.open_output_stream(open_uri(part)[1])

        def done() -> pa.RecordBatch:
            for *_, out in outs:
                out.close()
            at = pa.array([TaskContext.get().partitionId()] * len(outs), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in outs]), at, pa.array([x[1] for x in outs])], ["target", "at", "part"])

        for batch in batches:
            for own, rows in _runs(batch):
                if own != target:
                    if outs:
                        yield done()
                    target, outs = own, [opened(k.join(own.rsplit("*", 1))) for k in kinds] or [opened(own)]
                for (*_, out), raw in zip(outs, encode(rows) if kinds else [encode(rows)], strict=True):
                    out.write(raw)
        if outs:
            yield done()

    parts = ranged.mapInArrow(write, "target string, at int, part string").collect()  # a row a task and target
    if folder:
        system, place = open_uri(folder)
        system.delete_dir(place)
    return parts


def join_parts(target: str, parts: list[str], start: bytes = b"", end: bytes = b"") -> None:
    """One file of a start, the bytes of its parts and an end, under its name when whole."""
    system, place = open_uri(target)
    whole = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(whole) as out:
        out.write(start)
        for part in parts:
            with system.open_input_stream(open_uri(part)[1], compression=None) as f:
                while raw := f.read(4 << 20):
                    out.write(raw)
        out.write(end)
    system.move(whole, place)


def assemble(spark: SparkSession, parts: list, start: bytes = b"", end: bytes = b"") -> list[str]:
    """Join the parts of each target in a task of its own; the targets."""
    held: dict[str, list[str]] = {}
    for row in sorted(parts, key=lambda r: (r.target, r["at"])):
        held.setdefault(row.target, []).append(row.part)
    if not held:
        return []
    rows = spark.createDataFrame(list(held.items()), "target string, parts array<string>").repartition(min(len(held), 10_000))

    def join(batches):
        for batch in batches:
            for target, own in zip(batch.column("target").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                join_parts(target, own, start, end)
            yield batch.select(["target"])

    done = sorted(r.target for r in rows.mapInArrow(join, "target string").collect())
    for row in parts:  # a lost task may have needed them again
        system, place = open_uri(row.part)
        system.delete_file(place)
    return done
