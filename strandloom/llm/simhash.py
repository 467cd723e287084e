"""SimHash near-duplicates by bit-sliced comparison.

Every pair of fingerprints within the radius shares whole blocks of bits, so the
fingerprints are dealt out by pairs of blocks (``TABLES``). Inside a bucket the 64
bit planes stand vertically, one bit a fingerprint; shifting the planes by ``d``
compares all neighbours at lag ``d`` at once, carry-save counters add up the
differing bits, and a block of comparisons is abandoned as soon as each of its
counters has passed the radius. Buckets emit a spanning star, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .components import connected_components
from .staging import stage, stage_side

SHINGLE = 3
RADIUS = 3
#: (shift, width) of the blocks a fingerprint is cut into. A radius of 3 leaves
#: at least two of five blocks equal, so ten tables of two blocks miss no link.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets above this many fingerprints are compared as pairs of parts.
PART = 4096
_CHUNK = 1 << 16


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; null or wordless texts give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a:b], 42)
            for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column, as a signed long."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((simhash64(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def bit_planes(values: np.ndarray) -> list[int]:
    """Plane b as an integer whose bit i is bit b of value i."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def _as_int(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _positions(value: int, n: int) -> np.ndarray:
    raw = np.frombuffer(value.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def within(planes: list[int], lag: int, alive: int, radius: int) -> int:
    """Of the positions in ``alive``, those i where values i and i + lag are close."""
    counters = [0] * max(1, radius.bit_length())
    for plane in planes:
        carry = (plane ^ (plane >> lag)) & alive
        for k, held in enumerate(counters):
            if not carry:
                break
            counters[k], carry = held ^ carry, held & carry
        alive ^= alive & carry
        if not alive:
            return 0
    above = 0  # counters > radius, from the highest bit down
    same = alive
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            above |= same & counters[k]
            same &= ~counters[k]
    return alive & ~above


def bucket_roots(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Index of the first value reachable inside its bucket, for every value.

    ``values`` holds the buckets one after the other, largest first.
    """
    n = len(values)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    root = np.arange(n)
    open_ = np.ones(len(sizes), bool)
    planes = bit_planes(values)
    held = n
    for lag in range(1, int(sizes[0]) if len(sizes) else 0):
        active = int(sizes[sizes > lag].sum())
        if active * 2 < held:  # shed the finished small buckets
            planes, held = [p & ((1 << active) - 1) for p in planes], active
        left = bucket[: active - lag]
        alive = _as_int((left == bucket[lag:active]) & open_[left])
        if not alive:
            if not open_[: np.searchsorted(-sizes, -lag)].any():
                break
            continue
        alive = within(planes, lag, alive, radius)
        if not alive:
            continue
        i = _positions(alive, active)
        changed = False
        while (apart := root[i] != root[i + lag]).any():
            i = i[apart]
            a, b = root[i], root[i + lag]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
            changed = True
        if changed:
            roots = np.bincount(bucket[root == np.arange(n)], minlength=len(sizes))
            open_ = roots > 1
    return root


def _bucket_links(radius: int, wide: bool = False, chunk: int = _CHUNK):
    """mapInPandas over rows sorted by key: a star of links for each bucket.

    A row's fingerprint is its node itself, or if ``wide`` the bytes in ``fp``.
    """

    def links(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> pd.DataFrame | None:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        many = sizes > 1
        starts, sizes = starts[many], sizes[many]
        if not len(sizes):
            return None
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
        own, root = nodes[at], bucket_roots(values[at], sizes, radius)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"u": own[moved], "v": own[root[moved]]})

    def prints(batch: pd.DataFrame) -> np.ndarray:
        if wide:
            return np.frombuffer(b"".join(batch["fp"]), "<u8").reshape(len(batch), -1)
        return batch["node"].to_numpy().view(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append((batch["key"].to_numpy(), batch["node"].to_numpy(), prints(batch)))
            if sum(len(k) for k, _, _ in held) < chunk or held[-1][0][-1] == held[0][0][0]:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1  # the last bucket may go on
            if (out := links(*[c[:cut] for c in columns])) is not None:
                yield out
            held = [tuple(c[cut:] for c in columns)]
        if held and (out := links(*[np.concatenate(c) for c in zip(*held, strict=True)])) is not None:
            yield out

    return run


def _block(fp: Column, at: tuple[int, int]) -> Column:
    shift, width = at
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def candidate_keys(fp: Column) -> Column:
    """One long key for each table: its number and the bits of its two blocks."""
    return F.array(
        *[
            F.shiftleft(_block(fp, BLOCKS[a]), 13).bitwiseOR(_block(fp, BLOCKS[b])).bitwiseOR(F.lit(t << 32).cast("long"))
            for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )


def compare_buckets(keyed: DataFrame, radius: int, part: int = PART, chunk: int = _CHUNK) -> DataFrame:
    """``(node, key[, fp])`` -> ``(u, v)``: links that span the close prints of every bucket.

    A bucket of more than ``part`` prints is cut into parts by hash and every pair of
    parts is compared by itself, so no task gathers a hot bucket.
    """
    hot = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
        .select("key", F.ceil(F.col("n") * 2 / part).cast("int").alias("parts"))
    )
    wide = [c for c in keyed.columns if c == "fp"]
    keyed = keyed.join(stage(hot, "simhash-hot"), "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    split = F.transform(others, lambda q: F.xxhash64("key", F.least(own, q), F.greatest(own, q)))
    keyed = keyed.select("node", *wide, F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(split)).alias("key"))
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInPandas(_bucket_links(radius, bool(wide), chunk), "u long, v long")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Distinct ``fp`` -> ``(u, v)``: links that span every class of close fingerprints.

    Exact for a radius of 3 or less.
    """
    if radius > 3:
        raise ValueError("the block tables are exact for a radius of 3 at most")
    keyed = prints.select(F.col("fp").alias("node"), F.explode(candidate_keys(F.col("fp"))).alias("key"))
    return compare_buckets(keyed, radius, part)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row a document: ``doc_id, text_key, fp, component_id, keeper``.

    ``component_id`` is the smallest id among all documents reachable by links of
    ``radius`` or fewer bits. Ids are whole numbers, as any type that casts to long; others
    raise. Wordless texts (null, empty) share fingerprint zero
    and link like others. Null ids are kept as rows but never name a component (a
    component of null ids only has a null id). Repeated rows give repeated rows.
    ``keeper`` marks the rows whose id and text are the least of the component.
    """
    slim = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            fingerprint(F.col(text_col), shingle).alias("fp"),
        ),
        "simhash-slim",
    )
    of_print = stage(print_groups(slim).withColumn("node", F.col("fp")), "simhash-prints")
    return print_classes(slim, of_print, fingerprint_links(of_print.select("fp"), radius))


def print_groups(slim: DataFrame, *more: Column) -> DataFrame:
    """One row a fingerprint, with the least id and the best row of its documents."""
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")
    return slim.groupBy("fp").agg(F.min("doc_id").alias("low"), best, *more)


def print_classes(slim: DataFrame, of_print: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` from the links between the ``node`` of ``of_print``."""
    of_print = of_print.select("fp", "low", "best", "node")
    classes = stage(connected_components(links), "simhash-classes")
    members = of_print.join(classes, "node")
    tops = stage(members.groupBy("root").agg(F.min("low").alias("c_low"), F.min("best").alias("c_best")), "simhash-tops")
    linked = classes.join(tops, "root").select("node", "c_low", "c_best")
    info = stage(
        of_print.join(linked, "node", "left").select(
            "fp", F.coalesce("c_low", "low").alias("component_id"), F.coalesce("c_best", "best").alias("best")
        ),
        "simhash-info",
    )
    out = slim.join(info, "fp")
    return out.select(
        "doc_id", "text_key", "fp", "component_id",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("keeper"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=near_duplicates, **how) -> DataFrame:
    """The documents that stay: of each component the row of the least id and text.

    ``classes`` finds the components: ``near_duplicates`` or another function of its
    form. Columns are those of ``docs``. Of repeated rows of the keeper one stays.
    """
    found = stage(classes(docs, id_col, text_col, **how).drop("fp"), "simhash-found")
    ids = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")]
    losers = stage_side(found.where("NOT keeper").select(*ids).distinct(), "simhash-losers")
    again = stage_side(
        found.where("keeper").groupBy("doc_id", "text_key").count().where("count > 1").select(*ids), "simhash-repeated"
    )
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    left = docs.join(losers, on, "left_anti")
    if again.isEmpty():
        return left
    repeated = left.withColumn("__md5", key).join(again, on, "left_semi")
    return left.join(again, on, "left_anti").unionByName(repeated.dropDuplicates([id_col, "__md5"]).drop("__md5"))
