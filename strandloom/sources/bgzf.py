"""BGZF blocks by their places in a file, and where records start after any byte of a BAM file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

_MAGIC = b"\x1f\x8b\x08\x04"
_HEAD = 18
#: Most bytes of a block.
_BLOCK = 1 << 16
#: Blocks that must follow one another, and bytes of records that must fit, before a guess holds.
_BLOCKS_SEEN, _BYTES_SEEN = 3, 1 << 17
END = (1 << 62, 0)
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_SIZE = struct.Struct("<i")
Place = tuple[int, int]


def packed(data: bytes, level: int = 5) -> bytes:
    """One or more blocks of ``data``."""
    out = []
    for at in range(0, len(data), 0xFF00):
        raw = data[at : at + 0xFF00]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return b"".join(out)


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with ``head``; None if it isn't one."""
    if len(head) < _HEAD or head[:4] != _MAGIC or struct.unpack("<H", head[10:12])[0] != 6 or head[12:14] != b"BC":
        return None
    return struct.unpack("<H", head[16:18])[0] + 1


def _length(held: bytes, at: int = 0) -> int:
    n = _SIZE.unpack_from(held, at)[0]
    if n < 0:
        raise ValueError("a record of the BAM file has a negative length")
    return n


class BlockReader:
    """Exact byte counts over the blocks of an open file, from a place on."""

    def __init__(self, f, place: Place = (0, 0)):
        self.f, self.block, self.at, self.start, self.next = f, b"", 0, place[0], place[0]
        f.seek(place[0])
        if place[1]:
            self._load()
            self.at = place[1]

    def _load(self) -> bool:
        """The next block that isn't empty."""
        while head := self.f.read(_HEAD):
            size = block_size(head)
            if size is None:
                raise ValueError("not a BGZF block")
            rest = self.f.read(size - _HEAD)
            if len(rest) < size - _HEAD:
                raise ValueError("the BAM file is cut off")
            self.start, self.next = self.next, self.next + size
            self.block, self.at = zlib.decompress(rest[:-8], -15), 0
            if self.block:
                return True
        self.block, self.at = b"", 0
        return False

    def take(self, n: int) -> bytes:
        """``n`` bytes, or none at the end; fewer raise."""
        parts, left = [], n
        while left:
            if self.at == len(self.block) and not self._load():
                break
            part = self.block[self.at : self.at + left]
            self.at += len(part)
            left -= len(part)
            parts.append(part)
        if left and left < n:
            raise ValueError("the BAM file is cut off")
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def records(self) -> Iterator[bytes]:
        """The records from here on, each without the length before it."""
        while True:
            block, at, last = self.block, self.at, len(self.block)
            while at + 4 <= last:
                end = at + 4 + _SIZE.unpack_from(block, at)[0]
                if not at + 4 <= end <= last:
                    break
                self.at = end
                yield block[at + 4 : end]
                at = end
            if not (head := self.take(4)):
                return
            yield self.take(_length(head))

    def pass_block(self) -> int:
        """Passes the records that begin in this block; how many."""
        block, at, last, n = self.block, self.at, len(self.block), 0
        while at + 4 <= last:
            at += 4 + _length(block, at)
            n += 1
        if at < last:  # a length that lies across blocks
            self.at = at
            self.take(_length(self.take(4)))
            return n + 1
        self.at = last
        self.take(at - last)
        return n

    def place(self) -> Place:
        """Where the next byte is: the start of its block, and its place there."""
        if self.at == len(self.block) and not self._load():
            return END
        return self.start, self.at


def find_block(f, low: int) -> int | None:
    """The first block that begins at ``low`` or later."""
    f.seek(low)
    held = f.read(_BLOCK + _HEAD)
    at = held.find(_MAGIC)
    while at >= 0:
        place = low + at
        for _ in range(_BLOCKS_SEEN):
            f.seek(place)
            head = f.read(_HEAD)
            if not head:
                return low + at
            size = block_size(head)
            if size is None:
                break
            place += size
        else:
            return low + at
        at = held.find(_MAGIC, at + 1)
    return None


def _record_end(held: bytes, at: int, references: int) -> int | None:
    """Where the record at ``at`` would end; None if none can begin there."""
    if at + 36 > len(held):
        return len(held)
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", held[at : at + 36])
    if not (-1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and n_name and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    name = held[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
        return None
    return at + 4 + size


def find_record(f, low: int, high: int, references: int) -> Place | None:
    """The first record that begins in a block from ``low`` and before ``high``: a guess that long runs of records bear out."""
    block = find_block(f, low)
    while block is not None and block < high:
        reader = BlockReader(f, (block, 0))
        if not reader._load():
            return None
        first, start = len(reader.block), reader.start
        held = [reader.block]
        while sum(map(len, held)) < first + _BYTES_SEEN and reader._load():
            held.append(reader.block)
        whole = b"".join(held)
        if start >= high:
            return None
        for at in range(first):
            end = at
            while end is not None and end < len(whole):
                end = _record_end(whole, end, references)
            if end is not None:
                return start, at
        f.seek(start)
        block = start + block_size(f.read(_HEAD))
    return None


def scan(f, low: int, high: int, references: int, begin: Place | None = None) -> tuple[Place | None, Place | None, int]:
    """First record, the place behind the last, and how many begin in blocks from ``low`` and before ``high``."""
    first = begin or find_record(f, low, high, references)
    if first is None:
        return None, None, 0
    reader, n = BlockReader(f, first), 0
    place = reader.place()
    while place < (high, 0):
        n += reader.pass_block()
        place = reader.place()
    return first, place, n
