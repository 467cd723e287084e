"""Language identification with bit-sliced n-gram Bloom filters.

One table of language bit masks, as wide as there are languages, serves all of them: a
lookup ANDs the masks of an n-gram's slots and so returns every language whose filter
holds it. A text counts
the hits of each language over all its n-grams; the share that false positives
alone would give is taken off before the counts decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .staging import small_batches, stage, stage_side
from .toxicity import training_fold

ORDERS = (2, 3, 4)
PROBES = 3
#: Slots of the table for each n-gram of the largest filter, at least: under a fifth of a filter's bits are set.
SLOTS_PER_GRAM = 16
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_SPLIT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CHUNK = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """Languages in bit order, the table of masks (a row of bytes a slot), and each filter's false-positive share."""

    languages: list[str]
    table: np.ndarray
    false_share: np.ndarray
    prior: int


def letters(text: str | None) -> str:
    """Lower-cased words between single spaces; empty if there is no letter."""
    plain = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {plain} " if any(map(str.isalpha, plain)) else ""


def grams(plain: str) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams of whole texts, in chunks."""
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + max(ORDERS) - 1]
        for n in ORDERS:
            size = min(_CHUNK, len(part) - n + 1)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint64)
            for k in range(n):
                code = (code * _SPLIT[0]) ^ part[k : k + size]
            code ^= code >> np.uint64(29)
            yield code * _SPLIT[1]


def _slots(codes: np.ndarray, size: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (size.bit_length() - 1))
    return [((codes ^ (codes >> np.uint64(31))) * np.uint64(2 * k + 3) * _SPLIT[k % 3]) >> shift for k in range(PROBES)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            held: list[np.ndarray] = []
            for text in part["text"]:
                held += list(grams(letters(text)))
                if sum(map(len, held)) > 1 << 22:
                    codes, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})
                    held = []
            if held:
                codes, n = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 4000, rare: float = 0.03
) -> LanguageModel:
    """Learn the filters from labelled documents of the training folds.

    ``sample_per_language`` bounds the labelled rows learned from (drawn by hash of the
    id; all while there are fewer). An n-gram is in a language's filter if it is seen there
    once, and at least ``rare`` times as often as there are documents of the language in
    the sample. The table grows with the largest filter and with the number of languages;
    the driver holds a row a language. No labelled rows give a model that answers ``und``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(training_fold(F.col("__id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = stage_side(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.least(F.lit(1.0), F.lit(sample_per_language) / F.col("n"))
    wanted = held.select(F.col("lang").alias("__lang"), "n", (share * 1_000_000).cast("long").alias("share"), F.ceil(rare * share * F.col("n")).alias("least"))
    drawn = rows.join(wanted, F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < F.col("share"))
    counted = drawn.select("lang", "text").mapInPandas(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("count"))
    kept = stage(
        counted.join(wanted, F.col("lang") == F.col("__lang")).where(F.col("count") >= F.col("least")).select("lang", "code"), "language-grams"
    )
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(16, (most * SLOTS_PER_GRAM - 1).bit_length())

    def filled(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(slots, bool)
        for slot in _slots(part["code"].to_numpy(np.int64).view(np.uint64), slots):
            bits[slot] = True
        return pd.DataFrame({"lang": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # the n-grams of a language are those of a bounded sample
    filters = {r.lang: r.bits for r in kept.groupBy("lang").applyInPandas(filled, "lang string, bits binary").collect()}
    names = sorted(filters)
    table, false_share = np.zeros((slots, max(1, -(-len(names) // 8))), np.uint8), np.zeros(len(names))
    for bit, lang in enumerate(names):
        own = np.unpackbits(np.frombuffer(filters[lang], np.uint8), bitorder="little")
        table[:, bit // 8] |= own << np.uint8(bit % 8)
        false_share[bit] = float(own.mean()) ** PROBES
    sizes = {r.lang: r.n for r in held.collect()}
    prior = int(np.argmax([sizes[lang] for lang in names])) if names else 0
    return LanguageModel(names, table, false_share, prior)


def popcounts(model: LanguageModel, plain: str) -> tuple[np.ndarray, int]:
    """In how many n-grams of a text each language's filter has a hit, and how many there are."""
    hits, total = np.zeros(len(model.languages), np.int64), 0
    for codes in grams(plain):
        slots = _slots(codes, len(model.table))
        mask = model.table[slots[0]] & model.table[slots[1]] & model.table[slots[2]]
        total += len(mask)
        for byte in range(mask.shape[1]):
            seen = np.bincount(mask[:, byte], minlength=256)
            for bit in range(8 * byte, min(8 * byte + 8, len(hits))):
                hits[bit] += seen[(np.arange(256) >> (bit % 8)) & 1 == 1].sum()
    return hits, total


def identify(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The language of one text and its share of the corrected counts."""
    plain = letters(text)
    if not plain or not model.languages:
        return UNDETERMINED, 0.0
    hits, total = popcounts(model, plain)
    right = np.maximum(0.0, (hits / total - model.false_share) / np.maximum(1e-12, 1 - model.false_share))
    if not right.any():
        return model.languages[model.prior], 1 / len(right)
    top = int(np.argmax(right))
    return model.languages[top], float(right[top] / right.sum())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang`` and ``score``, from whole texts; a column of that name is replaced.

    A null text, or one without letters, is ``und`` with score 0; a text none of whose
    n-grams is known gets the most frequent training language.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(sent.value, t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(name, of(F.col(text_col)))
