"""Toxicity from class-conditional Kneser-Ney word models.

Both classes share a model of order two: pairs of words with modified Kneser-Ney
discounts, backed off to the continuation counts of the whole corpus (in how many
distinct contexts a word is seen), labelled or not. Each class has a Kneser-Ney model
of its own words, by the contexts they have in its documents, smoothed by the same
continuation counts; it bends the shared model to its own marginals and norms it anew
in each context. A document is judged by the difference of the two log-likelihoods of
its words, divided by their number. A rare expression is left to the shared counts,
so that the two likelihoods hardly differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .staging import small_batches, stage
from .tokens import Lookup, mix, stretches

_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Stands before the first word of a text.
_START = np.uint64(1)
#: Distinct pairs that a task gathers before it gives them out, and words of labelled documents.
_GATHERED, _COUNTED = 3 << 20, 1 << 20
#: Rows that a task gives out at a time.
_ROWS = 1 << 15
#: Bits of a context's hash: a word of a million contexts is short by about seven.
_CONTEXT_BITS = 36
#: No discount is less, so that every class keeps some backoff mass.
_LEAST_DISCOUNT = 0.05
#: Nats from which a word's log-ratio counts as striking.
STRIKING = 2.0
#: One in so many labelled documents is kept from the counts, to fit the curve on.
CURVE_SHARE = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Log-ratios of toxic to ordinary likelihood: of a word, and of the norms of the context before it.

    The last entries are those of words that are not listed; the one before in
    ``of_context`` is that of the start of a text.
    """

    words: Lookup
    of_context: np.ndarray
    of_word: np.ndarray
    weights: np.ndarray


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_fold(doc_id: Column) -> Column:
    """True where labels may be learned; a null id belongs to no fold."""
    return F.coalesce(_fold(doc_id) != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def _pair_code(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + word)


def _in_context(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(before, word, owner)`` of each stretch; a text's first word follows the start."""
    last, last_owner = _START, -1
    for word, owner in stretches(texts):
        if len(word):
            before = np.concatenate(([_START], word[:-1]))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            before[first] = _START
            if owner[0] == last_owner:
                before[0] = last
            last, last_owner = word[-1], int(owner[-1])
            yield before, word, owner


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts of 0, 1, 2, and 3 or more, from how many things have counts of 1, 2, 3 and 4."""
    n = np.concatenate(([0.0], counts_of_counts))
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    found = [k - (k + 1) * plain * n[k + 1] / n[k] if n[k] else plain for k in (1, 2, 3)]
    return np.concatenate(([0.0], np.clip(found, _LEAST_DISCOUNT, (1, 2, 3))))


def _counts_of(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def class_words(contexts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """One class's probability of each word as a multiple of its ``shared`` one.

    ``contexts`` are the distinct contexts of the words in the class. The last entry is
    that of every word that isn't listed, so all words of the corpus sum up to one.
    """
    if not contexts.any():
        return np.ones(len(shared) + 1)
    cut = discounts(_counts_of(contexts))[np.minimum(contexts, 3)]
    rest = cut.sum() / contexts.sum()
    return np.append((contexts - cut) / contexts.sum() / shared + rest, rest)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0

    def summed() -> Iterator[pd.DataFrame]:
        rows = np.concatenate(held, axis=1)
        held.clear()
        order = np.lexsort(rows[:2])
        before, word, toxic = (x[order] for x in rows)
        first = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (word[1:] != word[:-1]))))
        ends = np.append(first[1:], len(before))
        toxic = np.add.reduceat(toxic, first)
        out = pd.DataFrame({"before": before[first], "word": word[first], "toxic": toxic, "plain": ends - first - toxic})
        for at in range(0, len(out), _ROWS):
            yield out.iloc[at : at + _ROWS]

    for batch in batches:
        toxic = batch["toxic"].to_numpy(np.int64)
        for before, word, owner in _in_context(batch["text"]):
            held.append(np.stack((before.view(np.int64), word.view(np.int64), toxic[owner])))
            n += len(word)
            if n >= _COUNTED:
                yield from summed()
                n = 0
    if held:
        yield from summed()


def _packed(codes: np.ndarray) -> bytes:
    """Sorted distinct codes as compressed planes of the bytes of their differences."""
    steps = np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def _context_codes(words: Lookup, buckets: int):
    """mapInPandas: the distinct contexts of words, as packed codes dealt out to buckets.

    A code is the hash of a context over the word's place (0: not listed). The hash is
    shifted by word, so that its upper bits deal out the pairs evenly even if all have
    one context. Of unlisted words the pair is hashed.
    """
    low = np.uint64(64 - _CONTEXT_BITS)

    def packed(codes: np.ndarray) -> pd.DataFrame:
        codes.sort()
        codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))]
        starts = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
        ends = [*np.searchsorted(codes, starts).tolist(), len(codes)]
        # inside a bucket the word comes first: the contexts of common words lie close together
        turned = lambda x: np.sort((x << np.uint64(_CONTEXT_BITS)) | (x >> low))
        rows = [(b, _packed(turned(codes[ends[b] : ends[b + 1]]))) for b in range(buckets) if ends[b] < ends[b + 1]]
        return pd.DataFrame(rows, columns=["bucket", "codes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.empty(_GATHERED, np.uint64), 0
        for batch in batches:
            for before, word, _ in _in_context(batch["text"]):
                place = (words.find(word) + 1).astype(np.uint64)
                context = np.where(place == 0, _pair_code(before, word), mix(before) + mix(place))
                found = _distinct(context >> low << low | place)
                for at in range(0, len(found), _GATHERED):
                    part = found[at : at + _GATHERED]
                    if n + len(part) > _GATHERED:
                        yield packed(held[:n])
                        n = 0
                    held[n : n + len(part)] = part
                    n += len(part)
        if n:
            yield packed(held[:n])

    return run


def context_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many distinct contexts each of the sorted ``words`` is seen in all of ``text``, and how many all words have.

    Distinct pairs are dealt out by their own hash, so a common word is spread over all
    tasks; a task holds its share of the distinct pairs only.
    """
    spark = docs.sparkSession
    if len(words) >= 1 << (64 - _CONTEXT_BITS):
        raise ValueError("too many words for the codes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(words)

    def gather(batches):
        yield from _context_codes(Lookup(sent.value), buckets)(batches)

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        codes = _distinct(np.concatenate([_unpacked(x) for x in part["codes"]]))
        n = np.bincount((codes >> np.uint64(_CONTEXT_BITS)).astype(np.int64))
        place = np.flatnonzero(n)
        return pd.DataFrame({"place": place, "n": n[place]})

    packed = docs.select("text").mapInPandas(gather, "bucket long, codes binary")
    found = packed.groupBy("bucket").applyInPandas(counted, "place long, n long")
    found = found.groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a word of the model
    counts = np.zeros(len(words) + 1, np.int64)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    return counts[1:], int(counts.sum())


def _norms(pairs: DataFrame, words: np.ndarray, toxic: np.ndarray, plain: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each word as a context (then the start, then any other) the log-ratio of the classes' norms.

    The norm of a class in a context is the sum over all words of the shared model's
    probability times the class's multiple: that of the pairs seen, and the backoff mass.
    """
    sent = pairs.sparkSession.sparkContext.broadcast((words, toxic, plain, cut))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, toxic, plain, cut = sent.value
        known = Lookup(words)
        for batch in batches:
            before, word = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("before", "word"))
            n = (batch["toxic"] + batch["plain"]).to_numpy(np.int64)
            off, at = cut[np.minimum(n, 3)], known.find(word)
            place = np.where(before == _START, len(words), known.find(before))
            yield pd.DataFrame({"place": place.astype(np.int64), "n": n, "off": off, "toxic": (n - off) * toxic[at], "plain": (n - off) * plain[at]})

    rows = pairs.mapInPandas(sums, "place long, n long, off double, toxic double, plain double")
    found = rows.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "off", "toxic", "plain")]).toArrow()  # a row a word
    out, place = np.zeros(len(words) + 2), found["place"].to_numpy()
    off = found["off"].to_numpy()
    out[place] = np.log(found["toxic"].to_numpy() + off) - np.log(found["plain"].to_numpy() + off)
    return out


def differences(model: ToxicityModel, texts) -> np.ndarray:
    """For each text the difference of its length-normalised log-likelihoods, and of the part beyond ``STRIKING`` nats a word.

    Both also times the root of the number of different words (of the model), which says
    how much they vary by chance: a text that repeats itself tells no more than once.
    Zeros without words.
    """
    total, beyond, n, different = np.zeros((4, len(texts)))
    if len(model.words.keys):
        spanning, known = -1, np.zeros(0, np.uint64)  # the words so far of a text that goes on
        for before, word, owner in _in_context(texts):
            at = model.words.find(word)
            context = np.where(before == _START, len(model.of_context) - 2, model.words.find(before))
            ratio = model.of_word[at] - model.of_context[context]  # -1 is the last
            total += np.bincount(owner, ratio, len(texts))
            beyond += np.bincount(owner, np.maximum(ratio - STRIKING, 0), len(texts))
            n += np.bincount(owner, minlength=len(texts))
            held = _distinct((owner.astype(np.uint64) << np.uint64(32)) | (at + 1).astype(np.uint64))
            if owner[0] == spanning:
                held = held[~np.isin(held, known)]
            different += np.bincount((held >> np.uint64(32)).astype(np.int64), minlength=len(texts))
            last = held[held >> np.uint64(32) == np.uint64(owner[-1])]
            spanning, known = int(owner[-1]), np.concatenate((known, last)) if owner[-1] == spanning else last
    out = np.stack((total, beyond)) / np.maximum(n, 1)
    return np.concatenate((out, out * np.sqrt(different))).T


def probabilities(model: ToxicityModel, texts) -> np.ndarray:
    z = model.weights[0] + differences(model, texts) @ model.weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not len(y) or y.min() == y.max():
        return np.array([10.0 if len(y) and y.max() else -10.0, 0, 0, 0, 0])
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    full = np.column_stack((np.ones(len(x)), x / scale))
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (y - p) - 1e-2 * w
        bend = (full * (p * (1 - p))[:, None]).T @ full + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(bend, slope)
    return np.concatenate((w[:1], w[1:] / scale))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """``text, toxic, curve`` of the labelled documents that are learned from."""
    wanted = labels.select(F.col(id_col).cast(docs.schema["__id"].dataType).alias("__id"), F.col(label_col).cast("int").alias("toxic"))
    wanted = wanted.where(training_fold(F.col("__id")) & F.col("toxic").isNotNull())
    share = min(1.0, sample_rows / max(1, wanted.count()))
    wanted = wanted.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    wanted = wanted.groupBy("__id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    held = wanted.select("__id", "toxic", F.xxhash64(F.lit(7), "__id").alias("dice")).toArrow()  # about sample_rows
    held = held.sort_by([("toxic", "ascending"), ("dice", "ascending"), ("__id", "ascending")])
    toxic = held["toxic"].to_numpy()
    rank = np.arange(len(toxic)) - np.searchsorted(toxic, toxic)
    held = held.drop_columns("dice").append_column("curve", [pa.array(rank % CURVE_SHARE == CURVE_SHARE - 1)])
    wanted = docs.sparkSession.createDataFrame(held, docs.select("__id").withColumns({"toxic": F.lit(0), "curve": F.lit(True)}).schema)
    return stage(docs.join(F.broadcast(wanted), "__id").select("text", "toxic", "curve"), "toxicity-labelled")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000
) -> ToxicityModel:
    """Learn from the labelled rows of the training folds.

    ``sample_rows`` bounds the labelled rows that are learned from (drawn by hash of the
    id; all of them while there are fewer), so their ids are safe to broadcast and their
    words to gather. The continuation counts are of all words of all documents. A fifth
    of each class's labelled documents is kept from the counts: the curve is fitted on
    them. Rows without a label or id are not learned from; of several labels for an id
    the largest counts. With no labelled rows, or of one class only, every score is
    near that class.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    labelled = _labelled(text, labels, id_col, label_col, sample_rows)
    pairs = stage(
        labelled.where("NOT curve").mapInPandas(_class_counts, "before long, word long, toxic long, plain long")
        .groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")),
        "toxicity-pairs",
    )
    own = pairs.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("plain") > 0).alias("plain")).toArrow()
    words = own["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    counts, all_counts = context_counts(text, words) if len(words) else (np.zeros(0, np.int64), 0)
    shared = counts / max(all_counts, 1)
    toxic, plain = (class_words(own[c].to_numpy()[order], shared) for c in ("toxic", "plain"))
    often = {r.n: r.m for r in pairs.groupBy(F.least(F.col("toxic") + F.col("plain"), F.lit(5)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect()}
    of_context = _norms(pairs, words, toxic, plain, discounts(np.array([often.get(k, 0) for k in (1, 2, 3, 4)])))
    model = ToxicityModel(Lookup(words), of_context, np.log(toxic) - np.log(plain), np.zeros(5))
    sent = spark.sparkContext.broadcast(model)

    def measured(batches):
        for batch in batches:
            found = differences(sent.value, batch["text"])
            yield pd.DataFrame(found, columns=list("abcd")).assign(toxic=batch["toxic"].to_numpy(float))

    seen = labelled.where("curve").mapInPandas(measured, "a double, b double, c double, d double, toxic double").toPandas()
    seen = seen.sort_values(list(seen.columns))  # the same sums whatever the order of tasks
    return replace(model, weights=_fit_curve(seen[list("abcd")].to_numpy(), seen["toxic"].to_numpy()))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a probability of toxicity in ``name`` (a column of that name is replaced); null and empty texts have one too."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(sent.value, texts))

    return docs.withColumn(name, of(F.col(text_col)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The documents scored below ``threshold``, with the columns of ``docs``."""
    model = fit(docs, labels, **how)
    return score(docs, model, how.get("text_col", "text"), "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
