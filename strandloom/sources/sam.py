"""SAM and BAM as a Python data source, and writers for both.

Header and records are separate tables. Records keep their number in the file, also where
a large file is read as several partitions; BAM is BGZF read with ``zlib`` alone, a block
at a time.
"""

from __future__ import annotations

import io
import json
import struct
from binascii import hexlify, unhexlify
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyarrow import RecordBatch, array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf
from .bgzf import BlockReader
from .parts import assemble, join_parts, open_uri, write_parts

SCHEMA = (
    "file string, ordinal bigint, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, "
    "seq string, qual string, tags map<string, struct<type: string, value: string>>, corrupt string"
)
_NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")
_TAG = pa.struct([("type", pa.string()), ("value", pa.string())])
_ARROW = pa.schema(
    [
        (n, pa.int64() if n == "ordinal" else pa.int32() if n in _NUMBERS else pa.map_(pa.string(), _TAG) if n == "tags" else pa.string())
        for n in "file ordinal qname flag rname pos mapq cigar rnext pnext tlen seq qual tags corrupt".split()
    ]
)
_BATCH = 4096
HEADER_SCHEMA = "file string, line_no int, record_type string, fields map<string, string>"
# Fixed values of the BAM format.
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_FIXED = struct.Struct("<iiBBHHHiiii")
# A base as a hexadecimal digit and back; other letters give no digit. Scores as letters and back, without a check.
_TO_DIGIT = bytes(b"0123456789abcdef"[_BASES.index(chr(i).upper())] if i < 128 and chr(i).upper() in _BASES else 33 for i in range(256))
_TO_BASE = bytes.maketrans(b"0123456789abcdef", _BASES.encode())
_TO_LETTER = bytes(min(i + 33, 255) for i in range(256))
_TO_SCORE = bytes(max(i - 33, 0) for i in range(256))
_TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def unsupported_cram(path: str) -> None:
    if path.lower().endswith(".cram"):
        raise NotImplementedError("CRAM is not supported; convert it to BAM with its reference first")


def is_bam_name(path: str) -> bool:
    return path.endswith(".bam")


# Reading

def _int(raw: bytes) -> int:
    return struct.unpack("<i", raw)[0]


def _bam_header(data: BlockReader) -> tuple[str, list[str]]:
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = data.take(_int(data.take(4))).rstrip(b"\0").decode()
    names = []
    for _ in range(_int(data.take(4))):
        names.append(data.take(_int(data.take(4)))[:-1].decode())
        data.take(4)
    return text, names


def _bam_tags(raw: bytes) -> dict:
    tags, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind == "B":
            inner, n = chr(raw[at]), _int(raw[at + 1 : at + 5])
            form = f"<{n}{_TYPES[inner]}"
            value = ",".join([inner, *map(_number, struct.unpack(form, raw[at + 5 : at + 5 + struct.calcsize(form)]))])
            at += 5 + struct.calcsize(form)
        else:
            form = "<" + _TYPES[kind]
            value = _number(struct.unpack(form, raw[at : at + struct.calcsize(form)])[0])
            at += struct.calcsize(form)
            kind = "f" if kind == "f" else "i"
        tags[name] = (kind, value)
    return tags


def _number(x) -> str:
    return str(x) if isinstance(x, int) else f"{x:g}"


@lru_cache(4096)
def _cigar_text(raw: bytes) -> str:
    return "".join(f"{o >> 4}{_OPS[o & 15]}" for o in struct.unpack(f"<{len(raw) // 4}I", raw)) or "*"


def _bam_record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(raw)
    at = 32 + n_name
    qname = raw[32 : at - 1].decode()
    cigar = _cigar_text(raw[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    seq = hexlify(packed).translate(_TO_BASE)[:n_seq].decode() or "*"
    at += (n_seq + 1) // 2
    qual = raw[at : at + n_seq]
    text = "*" if not n_seq or qual[:1] == b"\xff" else qual.translate(_TO_LETTER).decode("ascii")
    rname = names[ref] if ref >= 0 else "*"
    rnext = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
    return qname, flag, rname, pos + 1, mapq, cigar, rnext, next_pos + 1, tlen, seq, text, _bam_tags(raw[at + n_seq :])


def _sam_record(line: str) -> tuple:
    f = line.split("\t")
    if len(f) < 11:
        raise ValueError("fewer than eleven columns")
    if f[9] != "*" and f[10] != "*" and len(f[9]) != len(f[10]):
        raise ValueError("bases and qualities differ in length")
    tags = {}
    for t in f[11:]:
        name, kind, value = t.split(":", 2)
        tags[name] = (kind, value)
    numbers = [int(f[i]) for i in (1, 3, 4, 7, 8)]
    if any(not -(1 << 31) <= n < 1 << 31 for n in numbers):
        raise ValueError("a number is out of range")
    flag, pos, mapq, pnext, tlen = numbers
    return f[0], flag, f[2], pos, mapq, f[5], f[6], pnext, tlen, f[9], f[10], tags


class _Part(InputPartition):
    """``n`` records of a file from a place on, the first of number ``ordinal``; all if ``n`` is negative."""

    def __init__(self, path: str, place: tuple[int, int] = (0, 0), n: int = -1, ordinal: int = 0):
        self.path, self.place, self.n, self.ordinal = path, place, n, ordinal


def _is_packed(system, path: str) -> bool:
    with system.open_input_stream(path, compression=None) as f:
        return f.read(2) == b"\x1f\x8b"


def _tag_array(tags: tuple[dict | None, ...]) -> pa.MapArray:
    """Parsed tags as a map column, null for None."""
    ends = list(accumulate((len(t or ()) for t in tags), initial=0))
    pairs = [p for t in tags if t for p in t.values()]
    values = pa.StructArray.from_arrays([array([p[0] for p in pairs], pa.string()), array([p[1] for p in pairs], pa.string())], fields=list(_TAG))
    offsets = array([None if t is None else e for t, e in zip(tags, ends)] + ends[-1:], pa.int32())
    return pa.MapArray.from_arrays(offsets, array([k for t in tags if t for k in t], pa.string()), values)


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.parts = [(path, (c, u), n, at) for path, c, u, n, at in json.loads(options["parts"])]
        self.mode = options.get("mode", "FAILFAST").upper()
        for path, *_ in self.parts:
            unsupported_cram(path)

    def partitions(self) -> list[InputPartition]:
        return [_Part(*p) for p in self.parts]

    def read(self, part: _Part) -> Iterator[RecordBatch]:
        rows = self._rows(part)
        while chunk := list(islice(rows, _BATCH)):
            columns = [_tag_array(c) if f.name == "tags" else array(c, type=f.type) for c, f in zip(zip(*chunk, strict=True), _ARROW, strict=True)]
            yield RecordBatch.from_arrays(columns, schema=_ARROW)

    def _rows(self, part: _Part) -> Iterator[tuple]:
        system, path = open_uri(part.path)
        raws = self._raw(system, path, part)
        for at, (raw, parse) in enumerate(raws if part.n < 0 else islice(raws, part.n), part.ordinal):
            try:
                row = parse(raw)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                if self.mode == "FAILFAST":
                    raise ValueError(f"broken record {at} in {part.path}: {e}") from e
                if self.mode == "PERMISSIVE":
                    yield (part.path, at, *[None] * 12, f"{e}")
                continue
            yield (part.path, at, *row, None)

    def _raw(self, system, path: str, part: _Part):
        if _is_packed(system, path):
            with system.open_input_file(path) as f:
                data = BlockReader(f)
                _, names = _bam_header(data)
                if part.n >= 0:
                    data = BlockReader(f, part.place)
                parse = lambda raw: _bam_record(raw, names)
                for raw in data.records():
                    yield raw, parse
        else:
            with system.open_input_file(path) as f:
                f.seek(part.place[0])
                for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                    if line.strip() and not line.startswith("@"):
                        yield line.rstrip("\r\n"), _sam_record


def _scan_text(f, low: int, high: int) -> tuple:
    """First line, the place behind the last, and how many records' lines begin from ``low`` and before ``high``."""
    at = low
    if low:
        f.seek(low - 1)
        while True:
            held = f.read(1 << 16)
            if not held:
                return None, None, 0
            if (cut := held.find(b"\n")) >= 0:
                at += cut
                break
            at += len(held)
    if at >= high:
        return None, None, 0
    f.seek(at)
    first, n = (at, 0), 0
    for line in io.BufferedReader(f, 1 << 20):
        if at >= high:
            break
        n += bool(line.strip()) and not line.startswith(b"@")
        at += len(line)
    return first, (at, 0), n


def _chained(path: str, place: tuple[int, int] | None, found: list[tuple]) -> list[list]:
    """The ranges ``c, u, c2, u2, n`` as partitions if each begins where the one before ends, else the file as one."""
    parts, ordinal = [], 0
    for c, u, c2, u2, n in found:
        if c < 0:
            continue
        if place is not None and (c, u) != place:
            return [[path, 0, 0, -1, 0]]
        parts.append([path, c, u, n, ordinal])
        place, ordinal = (c2, u2), ordinal + n
    return parts or [[path, 0, 0, -1, 0]]


def _ranges(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int) -> list[list]:
    """The partitions of large files (``path, size``): ranges of bytes, whose records are counted first in one job.

    A range's first record is guessed from what follows; the guess holds only if the range
    before ends exactly there. If one doesn't, the file is one partition.
    """
    begins, rows = {}, []
    for path, size in files:
        system, name = open_uri(path)
        begins[path], references = None, 0
        if packed := _is_packed(system, name):
            with system.open_input_file(name) as f:
                data = BlockReader(f)
                references = len(_bam_header(data)[1])
                begins[path] = data.place()
        rows += [(path, low, min(size, low + split_bytes), packed, *(begins[path] or (-1, -1)), references) for low in range(0, size, split_bytes)]

    def scan_range(path, low, high, packed, c, u, references):
        system, name = open_uri(path)
        with system.open_input_file(name) as f:
            if not packed:
                first, end, n = _scan_text(f, low, high)
            elif c >= high:  # only the header
                first, end, n = None, None, 0
            else:
                first, end, n = bgzf.scan(f, low, high, references, (c, u) if c >= low else None)
        return (path, low, *(first or (-1, -1)), *(end or (-1, -1)), n)

    def scan_ranges(batches):
        for batch in batches:
            found = [scan_range(*x.values()) for x in batch.to_pylist()]
            yield RecordBatch.from_arrays([array(c) for c in zip(*found, strict=True)], ["path", "low", "c", "u", "c2", "u2", "n"])

    ranges = spark.createDataFrame(rows, "path string, low long, high long, packed boolean, c long, u long, references int").repartition(len(rows))
    found: dict[str, list] = {}
    for path, _, *own in sorted(map(tuple, ranges.mapInArrow(scan_ranges, "path string, low long, c long, u long, c2 long, u2 long, n long").collect())):  # a row a range
        found.setdefault(path, []).append(tuple(own))
    return [part for path, _ in files for part in _chained(path, begins[path], found[path])]


class SamSource(DataSource):
    """``format("alignments")``; options ``parts`` (as ``read_alignments`` finds them) and ``mode``:

    ``FAILFAST`` (default), ``DROPMALFORMED`` or ``PERMISSIVE`` (a row with ``corrupt``).
    """

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def read_alignments(spark: SparkSession, paths: list[str], mode: str = "FAILFAST", split_bytes: int = 32 << 20) -> DataFrame:
    """Records of SAM and BAM files (told apart by content), numbered in file order.

    A file of at most ``split_bytes`` is a partition; of a larger one the records of each
    range are counted first, so that ranges are read side by side and numbers have no gaps.
    """
    spark.dataSource.register(SamSource)
    sizes = []
    for path in paths:
        unsupported_cram(path)
        system, name = open_uri(path)
        sizes.append((path, system.get_file_info(name).size or 0))
    large = list(dict.fromkeys(x for x in sizes if x[1] > split_bytes))
    ranged: dict[str, list] = {}
    for part in _ranges(spark, large, split_bytes) if large else []:
        ranged.setdefault(part[0], []).append(part)
    parts = [part for path in paths for part in ranged.get(path, [[path, 0, 0, -1, 0]])]
    return spark.read.format("alignments").option("parts", json.dumps(parts)).option("mode", mode).load()


def header_text(path: str) -> str:
    """The header lines of one file."""
    unsupported_cram(path)
    system, name = open_uri(path)
    with system.open_input_file(name) as f:
        if f.read(2) == b"\x1f\x8b":
            return _bam_header(BlockReader(f))[0]
        f.seek(0)
        lines = []
        for line in io.TextIOWrapper(f, encoding="utf-8"):
            if not line.startswith("@"):
                break
            lines.append(line)
        return "".join(lines)


def common_header(paths: list[str]) -> str:
    """The header of the first file; raises if another has a different sequence dictionary."""
    texts = [header_text(p) for p in paths]
    dictionaries = [[(f.get("SN"), f.get("LN")) for _, _, kind, f in parse_header(p, t) if kind == "SQ"] for p, t in zip(paths, texts, strict=True)]
    for path, own in zip(paths, dictionaries, strict=True):
        if own != dictionaries[0]:
            raise ValueError(f"{path} has other reference sequences than {paths[0]}")
    return texts[0]


def split_broken(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records read in mode ``PERMISSIVE``: the good ones, and ``file, ordinal, corrupt`` of the broken."""
    return records.where("corrupt IS NULL"), records.where("corrupt IS NOT NULL").select("file", "ordinal", "corrupt")


def parse_header(path: str, text: str) -> list[tuple]:
    rows = []
    for i, line in enumerate(x for x in text.splitlines() if x):
        kind, _, rest = line[1:].partition("\t")
        fields = {"text": rest} if kind == "CO" else dict(f.split(":", 1) for f in rest.split("\t") if ":" in f)
        rows.append((path, i, kind, fields))
    return rows


def read_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, line_no, record_type, fields`` of all header lines."""
    return spark.createDataFrame([r for p in paths for r in parse_header(p, header_text(p))], HEADER_SCHEMA)


def sequences(headers: DataFrame) -> DataFrame:
    """``file, ordinal, name, length`` of the sequence dictionaries."""
    f = F.col("fields")
    return headers.where("record_type = 'SQ'").select("file", F.col("line_no").alias("ordinal"), f["SN"].alias("name"), f["LN"].cast("int").alias("length"))


def read_groups(headers: DataFrame) -> DataFrame:
    f = F.col("fields")
    names = {"ID": "id", "LB": "library", "SM": "sample", "PL": "platform", "CN": "center", "PU": "platform_unit", "PM": "platform_model", "DT": "run_date"}
    return headers.where("record_type = 'RG'").select("file", *[F.try_element_at(f, F.lit(k)).alias(v) for k, v in names.items()])


# Writing

def _bin(start: int, end: int) -> int:
    """The smallest index bin that holds the 0-based half-open interval."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def _pack_tags(tags: list[tuple[str, str, str]]) -> bytes:
    out = b""
    for name, kind, value in tags:
        out += name.encode()
        if kind in "ZH":
            out += kind.encode() + value.encode() + b"\0"
        elif kind == "A":
            out += b"A" + value.encode()
        elif kind == "B":
            inner, *numbers = value.split(",")
            cast = float if inner == "f" else int
            out += b"B" + inner.encode() + struct.pack(f"<i{len(numbers)}{_TYPES[inner]}", len(numbers), *map(cast, numbers))
        else:
            out += kind.encode() + struct.pack("<f" if kind == "f" else "<i", float(value) if kind == "f" else int(value))
    return out


@lru_cache(4096)
def _pack_cigar(cigar: str) -> tuple[bytes, int, int]:
    """The packed operations, their number, and how far they reach on the reference."""
    ops, number = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | _OPS.index(c))
            number = ""
    return struct.pack(f"<{len(ops)}I", *ops), len(ops), sum(o >> 4 for o in ops if _OPS[o & 15] in "MDN=X") or 1


def _pack(qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags, index: dict[str, int]) -> bytes:
    ops, n_ops, span = _pack_cigar(cigar)
    bases = b"" if seq == "*" else seq.encode()
    packed = unhexlify(bases.translate(_TO_DIGIT) + b"0" * (len(bases) % 2))
    scores = b"\xff" * len(bases)
    if qual != "*":
        letters = qual.encode("ascii")
        if letters and min(letters) < 33:
            raise ValueError(f"a quality of {qname} is below zero")
        scores = letters.translate(_TO_SCORE)
    ref = index.get(rname, -1)
    mate = ref if rnext == "=" else index.get(rnext, -1)
    name = qname.encode() + b"\0"
    start = max(pos - 1, 0)
    body = b"".join((
        _FIXED.pack(ref, pos - 1, len(name), mapq, _bin(start, start + span), n_ops, flag, len(bases), mate, pnext - 1, tlen), name, ops, packed, scores, _pack_tags(tags),
    ))
    return struct.pack("<i", len(body)) + body


def _line(*fields) -> bytes:
    *columns, tags, _ = fields
    return ("\t".join([*map(str, columns), *[":".join(t) for t in tags]]) + "\n").encode()


_WRITTEN = "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()


def _tag_lists(tags: pa.MapArray) -> list[list[tuple[str, str, str]]]:
    """Name, type and value of the tags of each row."""
    ends = tags.offsets.to_pylist()
    low, n = ends[0], ends[-1] - ends[0]
    values = tags.items.slice(low, n)
    flat = list(zip(tags.keys.slice(low, n).to_pylist(), values.field("type").to_pylist(), values.field("value").to_pylist(), strict=True))
    return [flat[a - low : b - low] for a, b in zip(ends, ends[1:])]


def _write_parts(records: DataFrame, header: str, as_bam: bool, sort: bool, level: int) -> list:
    """Write runs of records (with ``__target``) beside their targets; ``target, at, part`` of each."""
    rows = parse_header("", header)
    index = {f["SN"]: i for i, f in enumerate(f for _, _, kind, f in rows if kind == "SQ") if "SN" in f}
    order = ["file", "ordinal"]
    if sort and any(kind == "HD" and f.get("SO") == "coordinate" for _, _, kind, f in rows):
        place = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in index.items() for x in (F.lit(k), F.lit(v))]), "rname"), F.lit(1 << 30)) if index else F.lit(1 << 30)
        records, order = records.withColumn("__place", place), ["__place", "pos", "file", "ordinal"]

    def encode(batch: pa.RecordBatch) -> bytes:
        rows = zip(*[batch.column(c).to_pylist() for c in _WRITTEN], _tag_lists(batch.column("tags")), strict=True)
        if not as_bam:
            return b"".join(_line(*r, index) for r in rows)
        return bgzf.packed(b"".join(_pack(*r, index) for r in rows), level)

    held = dict.fromkeys(["__target", *order, *_WRITTEN, "tags"])
    return write_parts(records.select(*held), order, encode)


def _file_start(header: str, as_bam: bool, level: int) -> bytes:
    text = header.encode()
    if not as_bam:
        return text
    sq = [f for _, _, kind, f in parse_header("", header) if kind == "SQ"]
    names = b"".join(struct.pack("<i", len(f["SN"].encode()) + 1) + f["SN"].encode() + b"\0" + struct.pack("<i", int(f["LN"])) for f in sq)
    return bgzf.packed(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sq)) + names, level)


def _end(as_bam: bool) -> bytes:
    return bgzf.EOF_BLOCK if as_bam else b""


def write_alignments(records: DataFrame, header: str, path: str, bam: bool | None = None, sort: bool = True, level: int = 5) -> str:
    """Write one SAM or BAM file (``.bam`` names: BAM) under ``header``.

    With ``sort`` records come in coordinate order if the header says so, else in that of
    ``file, ordinal``. Tasks write parts beside the target; one more joins their bytes.
    """
    unsupported_cram(path)
    as_bam = is_bam_name(path) if bam is None else bam
    parts = _write_parts(records.withColumn("__target", F.lit(path)), header, as_bam, sort, level)
    start = _file_start(header, as_bam, level)
    if not assemble(records.sparkSession, parts, start, _end(as_bam)):
        join_parts(path, [], start, _end(as_bam))
    return path


def write_by_key(selected: DataFrame, header: str, folder: str, bam: bool = False, sort: bool = True, level: int = 5) -> list[str]:
    """A SAM or BAM file for each ``file_name`` of the records, all under ``header``; the paths.

    Keys without records leave nothing. Any number of files is written in one pass.
    """
    target = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file_name"), F.lit(".bam" if bam else ".sam"))
    parts = _write_parts(selected.withColumn("__target", target), header, bam, sort, level)
    return assemble(selected.sparkSession, parts, _file_start(header, bam, level), _end(bam))
