"""Near copies by wide SimHash: five-word shingles, similarity of 0.8 or more.

64 bits within a radius of 3 find only the closest of the copies that share four in
five of their shingles, so this form takes 1024 bits. The share of differing bits is
the angle between two shingle sets, which estimates their Jaccard similarity.
Fingerprints meet in buckets of three shared shingle minima and are compared there by
the bit planes and carry-save counters of ``simhash``, with a radius that loses no
pair. That gives candidate classes only: inside them the shingle sets themselves are
compared, and only pairs of that exact similarity are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .simhash import compare_buckets, print_classes, print_groups
from .staging import stage, stage_side

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 16
#: Ten bands of three minima: of pairs at 0.8, one in 1300 shares no bucket.
BANDS, ROWS = 10, 3
_ROWS_AT_ONCE = 255  # sums of so many bits fit a byte
_CHUNK = 1 << 14
#: Candidate classes above this many shingle sets are compared as pairs of parts.
PART = 512
#: Shared shingles up to which bits are counted out; above, the angle holds.
_FEW = 64
_ERRORS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLANE, _MINIMUM, _FOLD = _odd(1, WORDS), _odd(2, BANDS * ROWS), _odd(3, ROWS)
_BAND = _odd(4, BANDS)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text; fewer words make one, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(each) - width + 1
    found = each[:n].copy()
    for k in range(1, width):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found += each[k : k + n]
    found = np.sort(_mix(found))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def signature(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The wide fingerprint and the bucket keys of a shingle set; both zero for none."""
    if not len(hashes):
        return bytes(WORDS * 8), np.zeros(BANDS, np.int64)
    ones = np.zeros(WORDS * 64, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE]
        bits = np.unpackbits(_mix(part[:, None] * _PLANE).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        np.minimum(low, (_MINIMUM[:, None] * part).min(axis=1), out=low)
    bands = _mix((_mix(low.reshape(BANDS, ROWS)) * _FOLD).sum(axis=1, dtype=np.uint64) * _BAND)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), bands.view(np.int64)


def _reach(share: float) -> int:
    bits = WORDS * 64
    return round(bits * share + _ERRORS * sqrt(bits * share * (1 - share)))


def radius_of(similarity: float) -> int:
    """Differing bits of a pair of that Jaccard similarity, and three standard errors more."""
    return _reach(acos(2 * similarity / (1 + similarity)) / pi)


def differing_share(shared: int, left: int, right: int) -> float:
    """Chance that a bit differs between sets of so many shared and own shingles."""
    ones = lambda n: np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n
    s = np.arange(shared + 1)
    # chance of a one, by the ones among the shared
    a, b = ((ones(own)[None, :] * (2 * (s[:, None] + np.arange(own + 1)) > shared + own)).sum(axis=1) for own in (left, right))
    return float((ones(shared) * (a * (1 - b) + b * (1 - a))).sum())


@lru_cache
def candidate_radius(similarity: float) -> int:
    """The radius that holds for sets of any size: small ones differ in more bits."""
    most = 0.0
    for shared in range(1, _FEW + 1):
        own = int(shared / similarity - shared + 1e-9)
        most = max([most, *(differing_share(shared, k, own - k) for k in range(own // 2 + 1))])
    return max(radius_of(similarity), _reach(most))


def exact_links(prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links ``(i, j)`` that span the classes of sets with that Jaccard similarity or more."""
    n, links = len(sets), []
    sizes, root = np.array([len(s) for s in sets]), np.arange(len(sets))
    for i in range(n - 1):
        later = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        later = later[np.minimum(sizes[later], sizes[i]) + 1e-9 >= similarity * np.maximum(sizes[later], sizes[i])]
        if not len(later):
            continue
        apart = np.bitwise_count(prints[later] ^ prints[i]).sum(axis=1, dtype=np.int64)
        order = np.argsort(apart, kind="stable")
        for j in later[order[apart[order] <= radius]].tolist():
            if root[j] == root[i]:
                continue
            small, large = sorted((sets[i], sets[j]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if both + 1e-9 >= similarity * (len(small) + len(large) - both):
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _class_links(radius: int, similarity: float):
    """mapInPandas over rows ``key, node, fp, hashes`` sorted by key: confirmed links."""

    def links(rows: list[tuple]) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(r[2] for r in rows), "<u8").reshape(len(rows), -1)
        found = exact_links(prints, [np.frombuffer(r[3], "<u8") for r in rows], radius, similarity)
        node = np.array([r[1] for r in rows], np.int64)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": node[at[:, 0]], "v": node[at[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(batch["key"], batch["node"], batch["fp"], batch["hashes"], strict=True):
                if held and held[0][0] != row[0]:
                    out.append(links(held))
                    held = []
                held.append(row)
            if out:
                yield pd.concat(out)
        if held:
            yield links(held)

    return run


def confirmed_links(candidates: DataFrame, sets: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """``(node, root)`` and ``(node, fp, hashes)`` -> ``(u, v)``: exact links inside each candidate class.

    A class of more than ``part`` nodes is cut into parts by hash and every pair of
    parts is compared by itself.
    """
    large = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    large = stage_side(large.select("root", F.ceil(F.col("n") * 2 / part).cast("int").alias("parts")), "wide-large")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    split = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.xxhash64("root", F.least(own, q), F.greatest(own, q)))
    keys = candidates.distinct().join(large, "root", "left").select(
        "node", F.when(F.col("parts").isNull(), F.array(F.xxhash64("root"))).otherwise(split).alias("keys")
    )
    keyed = sets.join(stage_side(keys, "wide-keys"), "node").select("node", "fp", "hashes", F.explode("keys").alias("key"))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInPandas(_class_links(candidate_radius(similarity), similarity), "u long, v long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row a document, of the form and with the edge cases of ``near_duplicates``.

    Linked are texts whose distinct shingles have a Jaccard similarity of ``similarity``
    or more, counted exactly; ``fp`` is the fingerprint and a digest of the shingle set.
    Wordless texts (null, empty) are copies of each other and of nothing else; a text
    shorter than a shingle is one shingle.
    """

    @F.pandas_udf("fp binary, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [(h, *signature(h)) for h in (shingle_hashes(t, shingle) for t in texts)]
        digest = lambda h: xxhash.xxh3_128_digest(h.tobytes()) if len(h) else bytes(16)
        return pd.DataFrame({"fp": [f + digest(h) for h, f, _ in found], "bands": [b for *_, b in found]})

    @F.pandas_udf("binary")
    def hashes_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).tobytes() for t in texts], dtype=object)

    key = F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")
    slim = stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), key, of(F.col(text_col)).alias("s")).select("doc_id", "text_key", "s.fp", "s.bands"),
        "wide-slim",
    )
    # the ids hold once written
    groups = print_groups(slim, F.min("bands").alias("bands"))
    of_print = stage(groups.withColumn("node", F.monotonically_increasing_id()), "wide-prints")
    bits = F.substring("fp", 1, WORDS * 8).alias("fp")
    keyed = of_print.where(F.col("fp") != F.lit(bytes(WORDS * 8 + 16))).select("node", bits, F.explode("bands").alias("key"))
    candidates = stage(connected_components(compare_buckets(keyed, candidate_radius(similarity), chunk=_CHUNK)).distinct(), "wide-candidates")
    best = [F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__key")]
    wanted = stage_side(of_print.join(candidates, "node", "left_semi").select("node", bits, *best), "wide-wanted")
    # The sets are made again, for one document of each candidate.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key, F.col(text_col).alias("text"))
    texts = texts.join(wanted, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    sets = stage(texts.dropDuplicates(["node"]).select("node", "fp", hashes_of(F.col("text")).alias("hashes")), "wide-sets")
    return print_classes(slim.drop("bands"), of_print, confirmed_links(candidates, sets, similarity))
