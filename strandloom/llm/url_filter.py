"""URL filters over a memory-mapped array of sorted digests.

Rules are keyed by host and path. The 64-bit xxhash of each key stands in one sorted
array beside the full keys; URLs probe it with vectorised binary search at every
host suffix and rule path length, and a hit counts only if the stored string is the
same, so a digest collision never decides.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .staging import new_path, open_folder

_UPPER, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER, _LOWER_LETTERS)
ALLOW, BLOCK = "allow", "block"
_PARTS = ("digests", "offsets", "bytes", "blocks", "lengths")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.translate(host, _UPPER, _LOWER_LETTERS)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


def build_index(rules: Iterable[tuple[str, str, str]], folder: str, prefix: str = "") -> str:
    """Write the sorted arrays of ``(verdict, host, path)`` rules; the folder's path.

    Of equal rules a block wins. Each part is a plain ``.npy`` that readers map.
    """
    verdicts: dict[bytes, bool] = {}
    lengths = set()
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict {verdict!r}")
        key = _key(host.translate(_LOWER), path)
        verdicts[key] = verdicts.get(key, False) or verdict == BLOCK
        lengths.add(len(path))
    keys = sorted(verdicts, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    parts = {
        "digests": np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64),
        "offsets": np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64),
        "bytes": np.frombuffer(b"".join(keys), np.uint8),
        "blocks": np.array([verdicts[k] for k in keys], bool),
        "lengths": np.array(sorted(lengths), np.int64),
    }
    fs, place = open_folder(folder)
    fs.create_dir(place, recursive=True)
    for name, values in parts.items():
        with fs.open_output_stream(f"{place}/{prefix}{name}.npy") as f:
            raw = io.BytesIO()
            np.save(raw, values)
            f.write(raw.getbuffer())
    return folder


class DigestIndex:
    """The arrays of ``build_index``, mapped into memory."""

    def __init__(self, folder: str, prefix: str = ""):
        for name in _PARTS:
            setattr(self, name, np.load(f"{folder}/{prefix}{name}.npy", mmap_mode="r"))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of each key, or -1."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low = np.searchsorted(self.digests, wanted, "left")
        high = np.searchsorted(self.digests, wanted, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(low < high):
            for row in range(low[i], high[i]):  # more than one only on a collision
                if self.bytes[self.offsets[row] : self.offsets[row + 1]].tobytes() == keys[i]:
                    out[i] = row
        return out

    def match(self, hosts: Iterable[str], paths: Iterable[str]) -> list[tuple[str | None, bool]]:
        """The longest rule (as host + path) of each URL and whether it blocks."""
        keys, owner, text = [], [], []
        lengths = self.lengths.tolist()
        n = 0
        for n, (host, path) in enumerate(zip(hosts, paths, strict=True), 1):
            labels = host.split(".")
            for i in range(len(labels) if host else 0):
                suffix = ".".join(labels[i:])
                for size in lengths:
                    if size > len(path):
                        break
                    keys.append(_key(suffix, path[:size]))
                    owner.append(n - 1)
                    text.append(suffix + path[:size])
        found: list[tuple[str | None, bool]] = [(None, False)] * n
        row = self.find(keys)
        for k in np.flatnonzero(row >= 0):
            held = found[owner[k]][0]
            if held is None or len(text[k]) > len(held):  # hosts come longest first, so of equals the longer host stays
                found[owner[k]] = (text[k], bool(self.blocks[row[k]]))
        return found


_indexes: dict[str, DigestIndex] = {}


def _shipped(tag: str) -> DigestIndex:
    if tag not in _indexes:
        _indexes[tag] = DigestIndex(os.path.dirname(SparkFiles.get(f"{tag}digests.npy")), tag)
    return _indexes[tag]


def ship_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Build the arrays and give every executor, now or later, a local copy to map."""
    tag = f"urls-{uuid.uuid4().hex}-"
    folder = new_path(spark, "urls")  # stays: executors that come later fetch it too
    build_index(rules, folder, tag)
    for name in _PARTS:
        spark.sparkContext.addFile(f"{folder}/{tag}{name}.npy")
    return tag


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", name: str = "judged", default: str = ALLOW) -> DataFrame:
    """``pages`` with a struct ``name``: ``host, path, rule, verdict``; a column of that name is replaced.

    A rule ``(verdict, host, path)`` fits its host and subdomains when the path starts
    with its own; the longest rule (host and path together, then host) wins, whether it
    allows or blocks. Without a rule ``rule`` is null and the verdict ``default``: a URL
    absent from the array isn't listed. Null URLs and those without ``://`` have an
    empty host and path and meet no rule.
    """
    tag = ship_index(pages.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def of(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = _shipped(tag).match(hosts, paths)
        return pd.DataFrame(
            [(rule, default if rule is None else BLOCK if blocks else ALLOW) for rule, blocks in found], columns=["rule", "verdict"]
        )

    parts = pages.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    parts = parts.withColumn("__of", of("__host", "__path"))
    whole = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), "__of.rule", "__of.verdict")
    return parts.withColumn(name, whole).drop("__host", "__path", "__of")
