"""Telephony audio columns: G.711 by lookup, IMA ADPCM by blocks, resampled PCM.

Media are WAVE bytes in a binary column. Mu-law and A-law are expanded through
256-entry tables; ADPCM is decoded for all blocks at once, a numpy step for each
sample of a block. Decoded audio can be stored again as resampled 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .staging import small_batches

PCM, IMA_ADPCM, ALAW, MULAW = 1, 0x11, 6, 7
RATE = 8000
#: Rates that can be resampled: outside them lies no speech, and a tiny one would swell without bound.
RATES = (2000, 384_000)
_CHUNK = 1 << 18
_BLOCKS_AT_ONCE = 1 << 14
#: The payload of a text is padded with zero bytes to a positive multiple of this.
UNIT = 64


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law code."""
    code = np.arange(256) ^ 0x55
    step, low = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    size = np.where(step == 0, low, (low + 0x100) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)


@dataclass(frozen=True)
class Wave:
    """One mono WAVE: its format tag, rate, block size and data bytes."""

    tag: int
    rate: int
    block: int
    data: bytes


def write_wave(wave: Wave, samples: int) -> bytes:
    """RIFF bytes; formats other than PCM carry a ``fact`` chunk with the sample count."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(wave.tag, 8)
    fmt = struct.pack("<HHIIHH", wave.tag, 1, wave.rate, wave.rate * bits // 8, wave.block, bits)
    if wave.tag == IMA_ADPCM:
        fmt += struct.pack("<HH", 2, (wave.block - 4) * 2 + 1)
    elif wave.tag != PCM:
        fmt += struct.pack("<H", 0)
    chunks = [(b"fmt ", fmt)] + ([(b"fact", struct.pack("<I", samples))] if wave.tag != PCM else []) + [(b"data", wave.data)]
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(raw: bytes) -> Wave:
    """The first ``fmt`` and ``data`` chunks; anything else raises ``ValueError``."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE")
    at, fmt = 12, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = raw[at + 8 : at + 8 + size]
        elif name == b"data" and len(fmt) >= 16:
            tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", fmt[:16])
            if channels != 1:
                raise ValueError("one channel is supported")
            if tag == PCM and bits != 16:
                raise ValueError("PCM of 16 bits is supported")
            return Wave(tag, rate, block, raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no audio data")


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Samples of IMA ADPCM blocks, decoded side by side; a short last block is padded."""
    if block < 5:
        raise ValueError("ADPCM blocks have at least five bytes")
    if not data:
        return np.zeros(0, np.int16)
    raw = np.frombuffer(data + b"\0" * (-len(data) % block), np.uint8).reshape(-1, block)
    value = np.ascontiguousarray(raw[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(raw[:, 2].astype(np.int64), len(STEPS) - 1)
    codes = np.stack((raw[:, 4:] & 0x0F, raw[:, 4:] >> 4), axis=2).reshape(len(raw), -1)
    out = np.empty((len(raw), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k].astype(np.int64), STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code & 7], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1)


def decode(wave: Wave) -> np.ndarray:
    """16-bit linear samples of a wave."""
    if wave.tag in (MULAW, ALAW):
        return (MULAW_TABLE if wave.tag == MULAW else ALAW_TABLE)[np.frombuffer(wave.data, np.uint8)]
    if wave.tag == IMA_ADPCM:
        return decode_adpcm(wave.data, wave.block)
    if wave.tag == PCM:
        return np.frombuffer(wave.data[: len(wave.data) // 2 * 2], "<i2")
    raise ValueError(f"unsupported format {wave.tag}")


def decode_many(waves: list[Wave]) -> list[np.ndarray | ValueError]:
    """What ``decode`` gives for each wave, or its error; ADPCM of one block size is decoded side by side."""
    out: list = [None] * len(waves)
    same: dict[int, list[int]] = {}
    for i, wave in enumerate(waves):
        if wave.tag == IMA_ADPCM and wave.block >= 5:
            same.setdefault(wave.block, []).append(i)
            continue
        try:
            out[i] = decode(wave)
        except ValueError as e:
            out[i] = e
    for block, held in same.items():
        while held:  # a bounded number of blocks at a time, one wave at least
            size, n = 0, 0
            while n < len(held) and (not n or size < _BLOCKS_AT_ONCE * block):
                size += len(waves[held[n]].data)
                n += 1
            part, held = held[:n], held[n:]
            blocks = [-(-len(waves[i].data) // block) for i in part]
            samples = decode_adpcm(b"".join(waves[i].data.ljust(k * block, b"\0") for i, k in zip(part, blocks, strict=True)), block)
            ends = np.cumsum([k * ((block - 4) * 2 + 1) for k in blocks])
            for i, found in zip(part, np.split(samples, ends[:-1]), strict=True):
                out[i] = found
    return out


def resampled(samples: np.ndarray, rate: int, to: int) -> Iterator[np.ndarray]:
    """Linear interpolation to another rate, as 16-bit chunks of bounded size.

    Rates outside ``RATES`` raise ``ValueError``.
    """
    if not RATES[0] <= rate <= RATES[1]:
        raise ValueError(f"unsupported rate {rate}")
    n = len(samples) * to // rate
    for at in range(0, n, _CHUNK):
        place = np.arange(at, min(n, at + _CHUNK), dtype=np.int64) * rate
        low = place // to
        high = np.minimum(low + 1, len(samples) - 1)
        a, b = samples[low].astype(np.int64), samples[high].astype(np.int64)
        yield (a + (b - a) * (place - low * to) // to).astype("<i2")


def features(chunks: Iterator[np.ndarray], to: int) -> str:
    """Sample count, RMS, peak and sign changes of 16-bit audio, and its CRC."""
    n = energy = peak = turns = crc = 0
    last = False
    for chunk in chunks:
        wide, below = chunk.astype(np.int64), np.concatenate(([last if n else chunk[0] < 0], chunk < 0))
        energy += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
        turns += int((below[1:] != below[:-1]).sum())
        crc, last, n = zlib.crc32(chunk.tobytes(), crc), bool(chunk[-1] < 0), n + len(chunk)
    return f"pcm16:{to}:{n}:{math.isqrt(energy // n) if n else 0}:{peak}:{turns}:{crc:08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Byte count of a text (null: empty) and its bytes, padded with zeros to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def stored_wave(payload: bytes, tag: int) -> bytes:
    """The wave that holds a payload: a byte a sample, or ADPCM blocks of ``UNIT`` bytes."""
    block = UNIT if tag == IMA_ADPCM else 1
    samples = len(payload) // UNIT * ((UNIT - 4) * 2 + 1) if tag == IMA_ADPCM else len(payload)
    return write_wave(Wave(tag, RATE, block, payload), samples)


def encode_texts(docs: DataFrame, text_col: str = "text", name: str = "media", tag: int = MULAW) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_bytes`` and the wave ``bytes`` of each whole text.

    ``tag`` is the format: mu-law, A-law or IMA ADPCM. A column ``name`` is replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, bytes binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, stored_wave(payload, tag)) for n, payload in map(payload_of, texts)]
        return pd.DataFrame(rows, columns=["n_bytes", "bytes"])

    return docs.withColumn(name, of(F.col(text_col)))


def describe_media(docs: DataFrame, media_col: str = "media", name: str = "audio", rate: int = 2 * RATE) -> DataFrame:
    """``docs`` with a struct ``name`` from the stored bytes read back; a column ``name`` is replaced.

    ``payload_bytes, payload_sha256, tail_crc32`` (unsigned, of the last 64 payload
    bytes), ``media_bytes, media_sha256`` and ``feature``, of the audio resampled to
    ``rate``. Null media give nulls; bytes that aren't a mono WAVE of a known format and
    rate a feature ``error: ...``, with null payload columns if no wave can be read.
    """
    small_batches(docs.sparkSession)
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(fields)
    def of(media: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for raw, (wave, samples) in zip(media, _read(media), strict=True):
            whole = (len(raw), hashlib.sha256(raw).hexdigest()) if raw is not None else (None, None)
            payload = (len(wave.data), hashlib.sha256(wave.data).hexdigest(), zlib.crc32(wave.data[-UNIT:])) if wave else (None,) * 3
            try:
                if isinstance(samples, ValueError):
                    raise samples
                feature = None if samples is None else features(resampled(samples, wave.rate, rate), rate)
            except ValueError as e:
                feature = f"error: {e}"
            rows.append((*payload, *whole, feature))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])
        return out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return docs.withColumn(name, of(F.col(media_col)))


def _read(media: pd.Series) -> list[tuple]:
    """``(wave, samples)`` of each; an error in place of samples, None for null media."""
    waves: list = []
    for raw in media:
        try:
            waves.append(read_wave(raw) if raw is not None else None)
        except ValueError as e:
            waves.append(e)
    known = [i for i, w in enumerate(waves) if isinstance(w, Wave)]
    out = [(None, w) for w in waves]
    for i, samples in zip(known, decode_many([waves[i] for i in known]), strict=True):
        out[i] = waves[i], samples
    return out


def to_pcm(docs: DataFrame, media_col: str = "media", rate: int = 2 * RATE, name: str = "pcm") -> DataFrame:
    """``docs`` with ``name``: the decoded audio as a resampled 16-bit PCM wave; a column ``name`` is replaced.

    Null or unreadable media give null.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def of(media: pd.Series) -> pd.Series:
        def one(wave: Wave | None, samples) -> bytes | None:
            try:
                if wave is None or isinstance(samples, ValueError):
                    return None
                data = b"".join(chunk.tobytes() for chunk in resampled(samples, wave.rate, rate))
            except ValueError:
                return None
            return write_wave(Wave(PCM, rate, 2, data), len(data) // 2)

        return pd.Series([one(*x) for x in _read(media)], dtype=object)

    return docs.withColumn(name, of(F.col(media_col)))
