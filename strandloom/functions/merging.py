"""Merging read pairs: overlap search and element-wise merge over Arrow batches.

A batch of pairs is two byte matrices, read 1 flush right and read 2 flush left, so that
one slice of each compares all pairs at once at a given overlap. Only the pairs with few
mismatches there are looked at position by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .dna import PHRED_OFFSET

#: Scores of merged bases are at most this.
MAX_QUALITY = 50
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCAtgca")
_UPPER = np.array([ord(chr(i).upper()) if i < 128 else i for i in range(256)], np.uint8)


@dataclass(frozen=True)
class MergeParams:
    max_penalty: int = 3
    penalty_high: int = 3
    penalty_low: int = 1
    quality_threshold: int = 20
    min_overlap: int = 15
    min_length: int = 30


def _matrix(texts: list[bytes], sizes: np.ndarray, right: bool = False) -> np.ndarray:
    """One row a text, filled up with zeros after it (before it if ``right``)."""
    width = int(sizes.max(initial=0))
    held = np.frombuffer(b"".join(texts), np.uint8)
    place = np.arange(width)
    inside = place >= width - sizes[:, None] if right else place < sizes[:, None]
    out = np.zeros((len(sizes), width), np.uint8)
    out[inside] = held
    return out


def agreement(differ: np.ndarray, sure: np.ndarray, first: np.ndarray, limit: int, p: MergeParams) -> np.ndarray:
    """Which rows pass: at every mismatch the penalty so far is within its limit.

    Positions count from ``first`` (of each row); up to ``limit`` of them the penalty may
    be ``max_penalty``, beyond that it may grow in proportion. No overlap passes.
    """
    penalty = np.cumsum(np.where(differ, np.where(sure, p.penalty_high, p.penalty_low), 0), axis=1)
    at = np.arange(differ.shape[1]) - first[:, None]
    over = np.where(at <= limit, penalty > p.max_penalty, penalty * limit > at * p.max_penalty)
    return ~(differ & over).any(axis=1)


def passing_offsets(a: list[bytes], aq: list[bytes], b: list[bytes], bq: list[bytes], p: MergeParams) -> tuple[np.ndarray, np.ndarray]:
    """For each pair how many offsets of ``b`` against ``a`` pass, and the first, from the least overlap on.

    Offsets leave ``min_overlap`` positions of ``a`` at least and ``min_length`` of the
    merged read.
    """
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    left, right = _matrix(a, na, right=True), _matrix(b, nb)
    good = [_matrix(q, n, right=r) >= p.quality_threshold + PHRED_OFFSET for q, n, r in ((aq, na, True), (bq, nb, False))]
    width, hits, found = left.shape[1], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    last = na + nb - p.min_overlap - p.min_length
    most = p.max_penalty * max(1.0, max(width, right.shape[1]) / max(p.min_overlap, 1))  # no passing overlap has more
    for k in range(int(last.max(initial=-1)) + 1):
        reach = p.min_overlap + k
        low, high = max(0, reach - width), min(right.shape[1], reach)
        x, y = left[:, width - reach + low : width - reach + high], right[:, low:high]
        differ = (x != y) & (x != 0) & (y != 0)
        rows = np.flatnonzero((differ.sum(axis=1) * p.penalty_low <= most) & (k <= last))
        sure = good[0][rows, width - reach + low : width - reach + high] & good[1][rows, low:high]
        first = np.maximum(reach - na[rows], 0) - low
        rows = rows[agreement(differ[rows], sure, first, p.min_overlap, p)]
        found[rows[hits[rows] == 0]] = na[rows[hits[rows] == 0]] - reach
        hits[rows] += 1
    return hits, found


def merged_bases(a: list[bytes], aq: list[bytes], b: list[bytes], bq: list[bytes], offset: np.ndarray) -> tuple[list[str], list[str]]:
    """Bases and qualities of pairs laid at ``offset``, as far as ``b`` reaches.

    Where both reads lie, equal bases get the better score (limited), others the base of
    the better score and the difference of the two; read 1 wins ties.
    """
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    n = np.maximum(nb + offset, 0)
    at = np.arange(int(n.max(initial=0)))[None, :]
    back = at - offset[:, None]
    in_a, in_b = (at < na[:, None]), (back >= 0) & (back < nb[:, None])

    def laid(texts: list[bytes], sizes: np.ndarray, place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        held = _matrix(texts, sizes)
        if not held.shape[1]:
            return np.zeros(inside.shape, np.uint8)
        return np.where(inside, np.take_along_axis(held, np.clip(np.broadcast_to(place, inside.shape), 0, held.shape[1] - 1), axis=1), 0)

    x, q = laid(a, na, at, in_a), laid(aq, na, at, in_a).astype(np.int64) - PHRED_OFFSET
    y, r = laid(b, nb, back, in_b), laid(bq, nb, back, in_b).astype(np.int64) - PHRED_OFFSET
    both = in_a & in_b
    base = np.where(both, _UPPER[np.where(q >= r, x, y)], np.where(in_b, y, x))
    score = np.where(both, np.where(x == y, np.minimum(np.maximum(q, r), MAX_QUALITY), np.abs(r - q)), np.where(in_b, r, q))
    return _rows(base, n), _rows((score + PHRED_OFFSET).astype(np.uint8), n)


def _rows(matrix: np.ndarray, sizes: np.ndarray) -> list[str]:
    return [row[:n].tobytes().decode("latin-1") for row, n in zip(matrix, sizes.tolist(), strict=True)]


def _trimmed(seq: str, qual: str, cut: int) -> tuple[bytes, bytes]:
    if cut > len(seq):
        raise ValueError("barcode longer than its read")
    bases = seq[cut:].rstrip("Nn").encode("latin-1", "replace")
    return bases, qual[cut:].encode("latin-1", "replace")[: len(bases)]


def merge_batch(r1: pd.DataFrame, r2: pd.DataFrame, p: MergeParams) -> pd.DataFrame:
    """``seq, qual, hits, offset`` of pairs given as ``seq, qual, cut`` of each read."""
    out = pd.DataFrame({"seq": None, "qual": None, "hits": pd.array([None] * len(r1), "Int32"), "offset": pd.array([None] * len(r1), "Int32")}, index=r1.index)
    known = np.flatnonzero((r1.notna().all(axis=1) & r2.notna().all(axis=1)).to_numpy())
    a, aq, b, bq, rows = [], [], [], [], []
    for i, s1, q1, n1, s2, q2, n2 in zip(known.tolist(), *(r.iloc[known][c] for r in (r1, r2) for c in ("seq", "qual", "cut")), strict=True):
        (x, xq), (y, yq) = _trimmed(s1, q1, int(n1)), _trimmed(s2, q2, int(n2))
        if len(x) == len(xq) and len(y) == len(yq):
            rows.append(i)
            a.append(x)
            aq.append(xq)
            b.append(_COMPLEMENT[np.frombuffer(y, np.uint8)[::-1]].tobytes())
            bq.append(yq[::-1])
    hits, offset = passing_offsets(a, aq, b, bq, p)
    one = np.flatnonzero(hits == 1)
    seq, qual = merged_bases(*([x[i] for i in one] for x in (a, aq, b, bq)), offset[one])
    rows = np.array(rows, np.int64)
    out.iloc[rows, 2], out.iloc[rows[one], 3] = hits.astype(np.int32), offset[one].astype(np.int32)
    out.iloc[rows[one], 0], out.iloc[rows[one], 1] = np.array(seq, object), np.array(qual, object)
    return out


def merged(r1_seq: Column, r1_qual: Column, r1_barcode: Column, r2_seq: Column, r2_qual: Column, r2_barcode: Column, params: MergeParams | None = None) -> Column:
    """Struct ``seq, qual, hits, offset`` of a pair: the merged read, the alignments that pass, and the offset of the only one."""
    p = params or MergeParams()

    @F.pandas_udf("seq string, qual string, hits int, offset int")
    def of(s1: pd.Series, q1: pd.Series, n1: pd.Series, s2: pd.Series, q2: pd.Series, n2: pd.Series) -> pd.DataFrame:
        named = lambda s, q, n: pd.DataFrame({"seq": s, "qual": q, "cut": n})
        return merge_batch(named(s1, q1, n1), named(s2, q2, n2), p)

    # else a filter on the result that is pushed down merges every pair twice
    of = of.asNondeterministic()
    return of(r1_seq, r1_qual, r1_barcode, r2_seq, r2_qual, r2_barcode)


def merge_pairs(pairs: DataFrame, r1_barcode: Column, r2_barcode: Column, params: MergeParams | None = None, wanted: Column | None = None) -> DataFrame:
    """``pairs`` (with ``r1_seq, r1_qual, r2_seq, r2_qual``) and ``merged_seq, merged_qual``.

    Barcodes of the given lengths are cut off, trailing unknown bases trimmed, read 2
    reverse-complemented; the pair merges if exactly one alignment passes, which also
    trims adapters, else both columns are null. A barcode longer than its read raises;
    nulls and reads with fewer scores than bases aren't merged, nor are pairs that
    aren't ``wanted``.
    """
    seq = F.col("r1_seq") if wanted is None else F.when(wanted, F.col("r1_seq"))
    out = pairs.withColumn("__merged", merged(seq, F.col("r1_qual"), r1_barcode, F.col("r2_seq"), F.col("r2_qual"), r2_barcode, params))
    return out.withColumns({"merged_seq": F.col("__merged.seq"), "merged_qual": F.col("__merged.qual")}).drop("__merged")


def starts_with(texts: list[bytes], quals: list[bytes], oligo: bytes, p: MergeParams) -> np.ndarray:
    """Which reads agree with the oligo from their first base, as far as both reach."""
    n = np.array([min(len(x), len(q), len(oligo)) for x, q in zip(texts, quals, strict=True)], np.int64)
    cut = lambda s: _matrix([x[:k] for x, k in zip(s, n.tolist(), strict=True)], n)
    read, scores = cut(texts), cut(quals)
    inside = np.arange(read.shape[1]) < n[:, None]
    differ = inside & (read != np.frombuffer(oligo, np.uint8)[: read.shape[1]])
    return agreement(differ, scores >= p.quality_threshold + PHRED_OFFSET, np.zeros(len(n), np.int64), len(oligo), p)


def is_oligo(seq: Column, qual: Column, oligo: str, params: MergeParams | None = None) -> Column:
    """The start of a merged read agrees with the oligo or its reverse complement; false for null."""
    p = params or MergeParams()
    ends = [oligo.encode(), _COMPLEMENT[np.frombuffer(oligo.encode(), np.uint8)[::-1]].tobytes()]

    @F.pandas_udf("boolean")
    def of(seqs: pd.Series, quals: pd.Series) -> pd.Series:
        known = np.flatnonzero((seqs.notna() & quals.notna()).to_numpy())
        text, score = ([x.encode("latin-1", "replace") for x in s.iloc[known]] for s in (seqs, quals))
        out = np.zeros(len(seqs), bool)
        out[known] = starts_with(text, score, ends[0], p) | starts_with(text, score, ends[1], p)
        return pd.Series(out)

    return of.asNondeterministic()(seq, qual)


def _known(*columns: pd.Series) -> tuple[np.ndarray, list[list[bytes]]]:
    """The rows without nulls, and their texts."""
    known = np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))
    return known, [[x.encode("latin-1", "replace") for x in c.iloc[known]] for c in columns]


def agrees(a: Column, a_qual: Column, b: Column, b_qual: Column, limit: int, params: MergeParams | None = None) -> Column:
    """Whether two reads agree from their first bases, as far as both reach; null for null."""
    p = params or MergeParams()

    @F.pandas_udf("boolean")
    def of(a: pd.Series, aq: pd.Series, b: pd.Series, bq: pd.Series) -> pd.Series:
        known, (x, xq, y, yq) = _known(a, aq, b, bq)
        n = np.array([min(map(len, t)) for t in zip(x, xq, y, yq, strict=True)], np.int64)
        x, xq, y, yq = (_matrix([t[:k] for t, k in zip(s, n.tolist(), strict=True)], n) for s in (x, xq, y, yq))
        sure = np.minimum(xq, yq) >= p.quality_threshold + PHRED_OFFSET
        out = pd.Series([None] * len(a), dtype="boolean")
        out.iloc[known] = agreement(x != y, sure, np.zeros(len(n), np.int64), limit, p)
        return out

    return of(a, a_qual, b, b_qual)


def merged_at(a: Column, a_qual: Column, b: Column, b_qual: Column, offset: Column) -> Column:
    """Struct ``seq, qual`` of two reads laid at an offset; null for null."""

    @F.pandas_udf("seq string, qual string")
    def of(a: pd.Series, aq: pd.Series, b: pd.Series, bq: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        known, texts = _known(a, aq, b, bq)
        out = pd.DataFrame({"seq": [None] * len(a), "qual": [None] * len(a)}, dtype=object)
        seq, qual = merged_bases(*texts, offsets.iloc[known].to_numpy(np.int64))
        out.iloc[known, 0], out.iloc[known, 1] = np.array(seq, object), np.array(qual, object)
        return out

    return of(a, a_qual, b, b_qual, offset)
