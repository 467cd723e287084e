"""Corpus-wide line dedup through a sharded minimal perfect hash.

The hashes of repeated lines are placed by a minimal perfect hash, one a shard;
the slot of a line indexes arrays with its fingerprint, its document count and
its last document. Documents probe these arrays, which are read from the shared
folder; lines are never joined with lines. Where a worker can hold all shards it
probes them as it reads; a larger index meets the hashes of the lines shard by shard.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .staging import new_path, open_folder, small_batches, stage, stage_side

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys a shard holds on average; a shard takes about 22 bytes a key in memory.
SHARD_KEYS = 1 << 18
#: Shards a Python worker keeps in memory at once.
SHARDS_HELD = 16
#: Tasks among which the probes of one shard are dealt out, so that no line is hot.
SALTS = 16
_SPACE = b" \t\n\x0b\x0c\r"
_GAMMA = 2.0
_LEVELS = 48


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))


def _digests(text: str | None, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines, the indexes of those long enough, and their 128-bit hashes."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    at, found = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and _code_points(key := line_key(line)) >= min_chars:
            at.append(i)
            found.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(at, np.int64), np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64)


class MinimalPerfectHash:
    """Levels of bit arrays: a key sits at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], rest: np.ndarray):
        self.levels, self.ranks, self.rest = levels, ranks, rest

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """``keys`` are distinct 64-bit values."""
        levels, ranks, placed = [], [], 0
        while len(keys) and len(levels) < _LEVELS:
            size = max(64, int(len(keys) * _GAMMA))
            slot = cls._slot(keys, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            ranks.append(placed + np.concatenate(([0], np.cumsum(alone)[:-1])))
            placed += int(alone.sum())
            keys = keys[~alone[slot]]
        return cls(levels, ranks, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = self._slot(keys[left], level, len(alone))
            hit = alone[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            base = int(self.ranks[-1][-1]) + int(self.levels[-1][-1])
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = base + at[same]
        return out


class Shard:
    """A perfect hash over line hashes with fingerprint, count and last-document arrays."""

    def __init__(self, hashing: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hashing, self.prints, self.counts, self.last = hashing, prints, counts, last

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        keys = low ^ (high * np.uint64(0xD6E8FEB86659FD93))
        hashing = MinimalPerfectHash.build(keys)
        slot = hashing.index(keys)
        prints, n, most = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints[slot], n[slot], most[slot] = high, counts, last
        return cls(hashing, prints, n, most)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self.hashing.index(low ^ (high * np.uint64(0xD6E8FEB86659FD93)))
        if not len(self.prints):
            return np.full(len(low), -1, np.int64)
        return np.where((slot >= 0) & (self.prints[slot] == high), slot, -1)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        h = self.hashing
        sizes = np.array([len(x) for x in h.levels], np.int64)
        bits = np.concatenate([np.packbits(x) for x in h.levels]) if h.levels else np.zeros(0, np.uint8)
        np.savez(out, sizes=sizes, bits=bits, rest=h.rest, prints=self.prints, counts=self.counts, last=self.last)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Shard:
        z = np.load(io.BytesIO(raw))
        levels, ranks, placed, at = [], [], 0, 0
        for size in z["sizes"].tolist():
            alone = np.unpackbits(z["bits"][at : at + (size + 7) // 8])[:size].astype(bool)
            at += (size + 7) // 8
            levels.append(alone)
            ranks.append(placed + np.concatenate(([0], np.cumsum(alone)[:-1])))
            placed += int(alone.sum())
        return cls(MinimalPerfectHash(levels, ranks, z["rest"]), z["prints"], z["counts"], z["last"])


_held: OrderedDict[str, Shard] = OrderedDict()


def _shard(uri: str) -> Shard:
    if uri not in _held:
        fs, path = open_folder(uri)
        with fs.open_input_stream(path) as f:
            _held[uri] = Shard.loads(f.read())
        while len(_held) > SHARDS_HELD:
            _held.popitem(last=False)
    _held.move_to_end(uri)
    return _held[uri]


def _holdings(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = [], [np.zeros((0, 2), np.uint64)]
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = np.unique(_digests(text, min_chars)[2], axis=0)
                ids += [None if pd.isna(doc_id) else int(doc_id)] * len(own)
                found.append(own)
            both = np.concatenate(found).view(np.int64)
            yield pd.DataFrame({"low": both[:, 0], "high": both[:, 1], "doc_id": pd.array(ids, "Int64")})

    return run


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``low, high, n, last`` of each line key found in ``min_docs`` documents or more.

    A document is an id: repeated rows of an id count once, all null ids count as
    one more document, which is never the last.
    """
    # ids travel as text: pandas would turn longs with nulls into doubles
    slim = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    held = slim.mapInPandas(_holdings(min_chars), "low long, high long, doc_id long")
    counts = held.groupBy("low", "high").agg(
        (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("last")
    )
    return counts.where(F.col("n") >= min_docs)


def build_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> list[str]:
    """Write the shards of ``repeated_lines`` to the shared folder; their paths by shard."""
    lines = stage(lines, "lines-repeated")
    shards = max(1, -(-lines.count() // shard_keys))
    root = new_path(lines.sparkSession, "lines-index")

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, high = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high"))
        raw = Shard.build(low, high, part["n"].to_numpy(np.int64), part["last"].to_numpy(np.int64)).dumps()
        uri = f"{root}/{int(key[0]):06d}-{uuid.uuid4().hex}.npz"  # a second attempt writes its own file
        fs, path = open_folder(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(raw)
        return pd.DataFrame({"shard": [int(key[0])], "uri": [uri]})

    placed = lines.withColumn("last", F.coalesce("last", F.lit(0))).groupBy(F.pmod("low", F.lit(shards)).alias("shard"))
    paths: list[str | None] = [None] * shards
    for row in placed.applyInPandas(write, "shard long, uri string").collect():
        paths[row.shard] = row.uri
    return paths


def _drops(batch: list[tuple], paths: list[str | None]) -> list[np.ndarray]:
    """For each (doc_id, hashes) which of its lines go; shards are probed one by one."""
    sizes = [len(h) for _, h in batch]
    both = np.concatenate([np.zeros((0, 2), np.uint64), *(h for _, h in batch)])
    low, high = both[:, 0].copy(), both[:, 1].copy()
    own = np.repeat(np.array([-1 if d is None else d for d, _ in batch], np.int64), sizes)
    no_id = np.repeat(np.array([d is None for d, _ in batch], bool), sizes)
    gone = np.zeros(len(low), bool)
    shard = np.mod(low.view(np.int64), len(paths))
    for s in np.unique(shard):
        if paths[s] is None:
            continue
        at = np.flatnonzero(shard == s)
        held = _shard(paths[s])
        slot = held.find(low[at], high[at])
        known = slot >= 0
        gone[at[known]] = no_id[at[known]] | (held.last[slot[known]] != own[at[known]])
    return np.split(gone, np.cumsum(sizes)[:-1]) if sizes else []


def _kept(lines: list[bytes], drop: set[int]) -> tuple[int, int, str]:
    kept = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
    return len(lines), len(drop), kept.decode("utf-8", "surrogatepass")


def _own_id(doc_id) -> int | None:
    return None if pd.isna(doc_id) else int(doc_id)


def _probed(docs: DataFrame, paths: list[str | None], min_chars: int) -> DataFrame:
    """``__id, __text`` -> ``__lines`` where a worker holds the whole index."""

    @F.pandas_udf(_LINES)
    def probe(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        split = [_digests(t, min_chars) for t in texts]
        keys = [(_own_id(i), h) for i, (_, _, h) in zip(ids, split, strict=True)]
        out = [_kept(lines, set(at[gone].tolist())) for (lines, at, _), gone in zip(split, _drops(keys, paths), strict=True)]
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return docs.withColumn("__lines", probe("__id", "__text"))


def _probed_by_shard(docs: DataFrame, paths: list[str | None], min_chars: int) -> DataFrame:
    """The same with each shard read by the tasks that have its probes.

    Only hashes travel, dealt out by shard and document; what comes back are the lines
    that go, by id and digest of the text.
    """

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_digests(t, min_chars)[1:] for t in batch["__text"]]
            sizes = [len(at) for at, _ in found]
            both = np.concatenate([np.zeros((0, 2), np.uint64), *(h for _, h in found)]).view(np.int64)
            repeat = lambda c: np.repeat(batch[c].to_numpy(object), sizes)
            yield pd.DataFrame({
                "shard": both[:, 0] % len(paths), "id": repeat("__id"), "key": repeat("__key"), "line": np.concatenate([np.zeros(0, np.int64), *(at for at, _ in found)]),
                "low": both[:, 0], "high": both[:, 1],
            })

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch[["low", "high"]].to_numpy(np.int64).view(np.uint64)
            gone = _drops([(_own_id(i), hashes[k : k + 1]) for k, i in enumerate(batch["id"])], paths)
            yield batch.loc[[bool(x[0]) for x in gone], ["id", "key", "line"]]

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("__key", F.concat_ws(":", F.md5(F.coalesce("__text", F.lit(""))), F.octet_length(F.coalesce("__text", F.lit("")))))
    sent = keyed.select("__id", "__key", "__text").mapInPandas(probes, "shard long, id string, key string, line long, low long, high long")
    dealt = sent.repartition(n, "shard", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("shard")
    drops = dealt.mapInPandas(find, "id string, key string, line long").groupBy("id", "key").agg(F.collect_set("line").alias("drop"))
    drops = stage_side(drops.select(F.col("id").alias("__d_id"), F.col("key").alias("__d_key"), "drop"), "lines-dropped")

    @F.pandas_udf(_LINES)
    def cut(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = [_kept((t or "").encode("utf-8", "surrogatepass").split(b"\n"), set(() if d is None else d)) for t, d in zip(texts, drop, strict=True)]
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    met = keyed.join(drops, (F.col("__key") == F.col("__d_key")) & F.col("__id").eqNullSafe(F.col("__d_id")), "left")
    return met.withColumn("__lines", cut("__text", "drop"))


_LINES = "n_lines long, n_dropped long, kept string"


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``docs`` with ``__lines``: ``n_lines``, ``n_dropped`` and the ``kept`` text of each row.

    A key (line stripped of ASCII space, A-Z lower-cased) of ``min_chars`` code
    points in ``min_docs`` documents keeps its lines in the largest id holding it
    only, with all its repeats there; a null id never is the largest. Ids are whole
    numbers, as any type that casts to long; others raise. Null and empty texts are one
    empty line. Very long texts are handled whole. Columns of ``docs`` may have any name
    but ``__lines``, which is replaced.
    """
    small_batches(docs.sparkSession)
    paths = build_index(repeated_lines(docs, id_col, text_col, min_chars, min_docs), shard_keys)
    own = [c for c in docs.columns if c != "__lines"]
    # ids travel as text: pandas would turn longs with nulls into doubles
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(id_col).cast("long").cast("string").alias("__id"), F.col(text_col).alias("__text"))
    probed = _probed if len(paths) <= SHARDS_HELD else _probed_by_shard
    return probed(rows, paths, min_chars).select("__row.*", "__lines")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs``, its columns unchanged, with the kept text (null texts become empty)."""
    found = dedup_lines(docs, id_col, text_col, **how)
    changed = {text_col: F.col("__lines.kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("__lines.kept").cast("long")
    return found.withColumns(changed).select(*docs.columns)
