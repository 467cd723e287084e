"""FASTQ read pairs as a Python data source, and the striped gzip writer.

The two to four files of a lane are read in lockstep in one partition, so pairing
costs no shuffle and keeps the file order. Plain gzip cannot be split: such lanes are
one partition each. Large files of BGZF blocks, which is gzip too (what is written here,
and by most sequencers' software), are read in ranges of records, whose lines are counted first.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import RecordBatch, array, schema as arrow_schema, string, int64
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf
from .parts import assemble, open_uri, write_parts

READS = ("r1", "r2", "i1", "i2")
SCHEMA = "lane_id string, ordinal bigint, " + ", ".join(f"{r}_{c} string" for r in READS for c in ("header", "seq", "qual"))
_BATCH = 4096
#: Bytes of a file that are unpacked at a time.
_CHUNK = 1 << 19


class Lines:
    """Whole lines of a gzip file as bytes, from the member that begins at ``start`` on."""

    def __init__(self, uri: str, start: int = 0):
        system, path = open_uri(uri)
        held = system.open_input_file(path) if start else system.open_input_stream(path, compression=None)
        if start:
            held.seek(start)
        self.f, self.held = gzip.GzipFile(fileobj=held), b""

    def take(self, n: int) -> bytes:
        """The next ``n`` lines, fewer at the end."""
        parts, left = [], n
        while left:
            if not self.held and not (raw := self.f.read(_CHUNK)):
                break
            raw, self.held = self.held or raw, b""
            if (m := raw.count(b"\n")) < left:
                parts.append(raw)
                left -= m
                continue
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            cut = int(ends[left - 1]) + 1
            parts.append(raw[:cut])
            self.held, left = raw[cut:], 0
        return b"".join(parts)

    def skip(self, n: int) -> None:
        for at in range(0, n, 4 * _BATCH):
            self.take(min(n - at, 4 * _BATCH))

    def close(self) -> None:
        self.f.close()


def records(lines: Iterator[str], name: str = "") -> Iterator[tuple[str, str, str]]:
    """``(header, sequence, quality)`` of four-line records; broken ones raise."""
    while four := list(islice(lines, 4)):
        if four == ["\n"] * len(four):
            return
        header, seq, plus, qual = [x.rstrip("\r\n") for x in [*four, "", "", ""][:4]]
        if len(four) < 4 or not header.startswith("@") or not plus.startswith("+") or len(seq) != len(qual) or seq.strip("ACGTNacgtn"):
            raise ValueError(f"broken FASTQ record in {name}: {header}")
        yield header, seq, qual


def _clean(raw: bytes) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """Headers, sequences and qualities of whole records; None if anything is odd."""
    data = np.frombuffer(raw, np.uint8)
    stops = np.flatnonzero(data == 10).astype(np.int32)
    if len(stops) % 4 or not raw.endswith(b"\n") and raw or b"\r" in raw or not raw.isascii():
        return None
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(stops)].astype(np.int32)
    lengths = stops - starts
    if (data[starts[::4]] != 64).any() or (data[starts[2::4]] != 43).any() or (lengths[1::4] != lengths[3::4]).any():
        return None
    # Texts of lines and their ends by turns, so that they take no copy; columns are every eighth of these.
    edges = np.append(np.stack([starts, stops], 1).ravel(), np.int32(len(raw)))
    held = pa.StringArray.from_buffers(2 * len(stops), pa.py_buffer(edges), pa.py_buffer(raw))
    header, seq, qual = (held.take(array(np.arange(2 * k, 2 * len(stops), 8))) for k in (0, 1, 3))
    return (header, seq, qual) if not _bytes_of(seq).translate(None, b"ACGTNacgtn") else None


def _bytes_of(texts: pa.StringArray) -> bytes:
    """The texts of an array that begins with its buffers, one after another."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    return texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""


def _split(raw: bytes) -> list[str]:
    """Lines with their ends."""
    *whole, last = raw.decode("ascii").split("\n")
    return [f"{x}\n" for x in whole] + [last] * bool(last)


class _Lane(InputPartition):
    """``n`` pairs of a lane from the one of number ``ordinal`` on, all if negative; each file from a block on, some lines behind it."""

    def __init__(self, lane_id: str, paths: list[str], strict: bool, ordinal: int = 0, n: int = -1, places: list[tuple[int, int]] | None = None):
        self.lane_id, self.paths, self.strict, self.ordinal, self.n = lane_id, paths, strict, ordinal, n
        self.places = places or [(0, 0)] * len(paths)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.lanes = json.loads(options["lanes"])
        self.strict = options.get("strict_lengths", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Lane(lane, paths, self.strict, *part) for lane, paths, *part in self.lanes]

    def read(self, lane: _Lane) -> Iterator[RecordBatch]:
        names = [n for n in SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")]
        kinds = arrow_schema([(n, int64() if n == "ordinal" else string()) for n in names])
        files = [Lines(p, start) for p, (start, _) in zip(lane.paths, lane.places, strict=True)]
        try:
            for f, (_, skipped) in zip(files, lane.places, strict=True):
                f.skip(skipped)
            at, left = lane.ordinal, lane.n
            while n := _BATCH if left < 0 else min(left, _BATCH):
                held = self._next(files, lane, n)
                m = len(held[0][0])
                if m:
                    columns = [array([lane.lane_id] * m), array(range(at, at + m), int64())]
                    for k in range(len(READS)):
                        columns += held[k] if k < len(files) else [pa.nulls(m, string())] * 3
                    yield RecordBatch.from_arrays(columns, schema=kinds)
                if m < n:
                    break
                at, left = at + m, left - m if left > 0 else left
        finally:
            for f in files:
                f.close()

    def _next(self, files: list[Lines], lane: _Lane, n: int) -> list[tuple]:
        """The next ``n`` records of each file, fewer at the end; columns by file."""
        raws = [f.take(4 * n) for f in files]
        held = [_clean(x) for x in raws]
        # The shortest file ends the lane; strict lanes must be of one length.
        if None not in held and (len({len(x[0]) for x in held}) == 1 or not lane.strict):
            m = min(len(x[0]) for x in held)
            return [tuple(c[:m] for c in x) for x in held]
        rows = list(zip(*(records(iter(_split(x)), p) for x, p in zip(raws, lane.paths, strict=True)), strict=lane.strict))
        return [tuple(array([x[k][c] for x in rows], string()) for c in range(3)) for k in range(len(files))]


class FastqSource(DataSource):
    """``format("fastq_pairs")``; options ``lanes`` (as ``read_pairs`` finds them) and ``strict_lengths``."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def _line_places(f, low: int, high: int, step: int) -> list[tuple[int, int, int, bool, bool]]:
    """The blocks from ``low`` and before ``high`` in stretches: where each begins and ends, its lines, if blank lines make it odd, if its last line is whole."""
    start = bgzf.find_block(f, low)
    if start is None or start >= high:
        return []
    reader, found = bgzf.BlockReader(f, (start, 0)), []
    place = reader.place()
    while place < (high, 0):
        begin, limit, n, odd, seen = place[0], (min(high, place[0] + step), 0), 0, False, b""
        while place < limit:
            n += reader.block.count(b"\n")
            edge = seen + reader.block
            odd |= b"\n\n\n" in edge or not seen and edge.startswith(b"\n\n")
            seen, reader.at = edge[-2:], len(reader.block)
            place = reader.place()
        found.append((begin, place[0], n, odd or seen == b"\n\n", seen.endswith(b"\n")))
    return found


def _by_records(lane: str, paths: list[str], found: list[list[tuple]], n_parts: int, strict: bool) -> list[list]:
    """Partitions of equally many pairs if the stretches of each file meet and hold whole records, else the lane as one."""
    whole, totals = [[lane, paths]], []
    for own in found:
        met = own and own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] == bgzf.END[0] and own[-1][4] and not any(x[3] for x in own)
        totals.append(sum(x[2] for x in own))
        if not met or totals[-1] % 4:
            return whole
    if strict and len(set(totals)) > 1:
        return whole
    n, parts = min(totals) // 4, []
    bounds = [n * i // n_parts for i in range(n_parts + 1)]
    held = [iter(x) for x in found]
    now = [[next(x), 0] for x in held]  # the stretch of each file that holds the line, and the lines before it
    for low, high in zip(bounds, bounds[1:]):
        for k, own in enumerate(held):
            while low < high and now[k][1] + now[k][0][2] <= 4 * low:
                now[k] = [next(own), now[k][1] + now[k][0][2]]
        if low < high:
            parts.append([lane, paths, low, high - low, [(x[0], 4 * low - before) for x, before in now]])
    return parts or whole


def _ranges(spark: SparkSession, lanes: dict[str, list[str]], sizes: dict[str, int], split_bytes: int, strict: bool) -> dict[str, list[list]]:
    """The partitions of large lanes; the lines of all their files are counted in one job."""
    rows = [(p, low, min(sizes[p], low + split_bytes)) for p in dict.fromkeys(p for own in lanes.values() for p in own) for low in range(0, sizes[p], split_bytes)]

    def scan(batches):
        for batch in batches:
            for path, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high")), strict=True):
                system, name = open_uri(path)
                with system.open_input_file(name) as f:
                    found = [(path, low, *x) for x in _line_places(f, low, high, max(split_bytes // 8, 1))]
                if found:
                    yield RecordBatch.from_arrays([array(c) for c in zip(*found, strict=True)], ["path", "low", "begin", "until", "n", "odd", "whole"])

    ranges = spark.createDataFrame(rows, "path string, low long, high long").repartition(len(rows))
    found: dict[str, list] = {p: [] for p in sizes}
    for path, _, *own in sorted(map(tuple, ranges.mapInArrow(scan, "path string, low long, begin long, until long, n long, odd boolean, whole boolean").collect())):  # a row a stretch
        found[path].append(tuple(own))
    return {lane: _by_records(lane, paths, [found[p] for p in paths], -(-sum(sizes[p] for p in paths) // split_bytes), strict) for lane, paths in lanes.items()}


def read_pairs(spark: SparkSession, lanes: dict[str, list[str]], strict_lengths: bool = False, split_bytes: int = 32 << 20) -> DataFrame:
    """Read pairs of ``{lane_id: [r1, r2(, i1, i2)]}``; gzip only.

    A lane is a partition; if its files have more than ``split_bytes`` together and all are
    of BGZF blocks, it is several.
    """
    sizes, large = {}, {}
    for lane, files in lanes.items():
        if len(files) not in (2, 4):
            raise ValueError("a lane has two or four files")
        blocks = True
        for path in files:
            system, name = open_uri(path)
            sizes[path] = system.get_file_info(name).size or 0
            if sizes[path]:
                with system.open_input_stream(name, compression=None) as f:
                    blocks &= bgzf.block_size(f.read(64)) is not None
        if blocks and sum(sizes[p] for p in files) > split_bytes:
            large[lane] = files
    spark.dataSource.register(FastqSource)
    ranged = _ranges(spark, large, sizes, split_bytes, strict_lengths) if large else {}
    parts = [part for lane, files in lanes.items() for part in ranged.get(lane, [[lane, files]])]
    return spark.read.format("fastq_pairs").option("lanes", json.dumps(parts)).option("strict_lengths", str(strict_lengths)).load()


def _target(root: str) -> Column:
    """``root_001.fastq.gz`` and so on, by ``stripe``."""
    target = F.concat(F.lit(f"{root}_"), F.lpad(F.col("stripe").cast("string"), 3, "0"), F.lit(".fastq.gz"))
    return F.when(F.col("stripe") > 999, F.concat(F.lit(f"{root}_"), F.col("stripe").cast("string"), F.lit(".fastq.gz"))).otherwise(target)


def _encoded(header: pa.Array, seq: pa.Array, qual: pa.Array, level: int) -> bytes:
    """The records as BGZF blocks; those without a header are left out."""
    header, seq, qual = (x.filter(header.is_valid()).cast(string()) for x in (header, seq, qual))
    texts = pc.binary_join_element_wise(header, seq, "+", qual, "", "\n")
    if texts.null_count or not (raw := _bytes_of(texts)).isascii():
        raise ValueError("a read to be written has no bases or scores, or letters beyond ASCII")
    return bgzf.packed(raw, level)


def write_striped(reads: DataFrame, root: str, level: int = 5, is_table: bool = False) -> list[str]:
    """Write ``stripe, lane_id, ordinal, header, seq, qual`` as ``root_001.fastq.gz`` and so on.

    All tasks write parts of BGZF blocks (which is gzip); one more a stripe joins their bytes.
    ``is_table``: the reads are cheap to read twice.
    """
    encode = lambda batch: _encoded(*(batch.column(c) for c in ("header", "seq", "qual")), level)
    dealt = reads.select(_target(root).alias("__target"), "lane_id", "ordinal", "header", "seq", "qual")
    return assemble(reads.sparkSession, write_parts(dealt, ["lane_id", "ordinal"], encode, is_table), end=bgzf.EOF_BLOCK)


def write_pairs(pairs: DataFrame, folder: str, level: int = 5, is_table: bool = False) -> list[str]:
    """Write ``stripe, lane_id, ordinal`` and the reads' columns as ``folder/r1_001.fastq.gz`` to ``i2_001.fastq.gz`` and so on.

    All reads of a pair are dealt out and sorted once; reads without a header are left out of their file.
    """
    def encode(batch: pa.RecordBatch) -> list[bytes]:
        return [_encoded(*(batch.column(f"{r}_{c}") for c in ("header", "seq", "qual")), level) for r in READS]

    dealt = pairs.select(_target(f"{folder}/*").alias("__target"), "lane_id", "ordinal", *[f"{r}_{c}" for r in READS for c in ("header", "seq", "qual")])
    return assemble(pairs.sparkSession, write_parts(dealt, ["lane_id", "ordinal"], encode, is_table, READS), end=bgzf.EOF_BLOCK)
