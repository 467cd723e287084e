"""Mixing sources to target weights through a hypergeometric splitting tree.

Every source is cut into blocks of documents by hash. A source's target fixes how
often its blocks are drawn, in a permuted order; a tree halves the output shards
again and again and splits the exact quotas of draws among them by multivariate
hypergeometric sampling. Each shard then draws its own stretch of the permuted
blocks and is shuffled locally.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .staging import stage, stage_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of a block, on average.
BLOCK_DOCS = 512
#: Blocks of a source that are put in order together, on average.
STRETCH = 4096
#: Sources whose quotas are split together; the quotas of such groups are split first.
GROUP = 4096
#: Draws up to which numpy samples.
_NUMPY_MOST = 10**9


def word_count(text: Column) -> Column:
    """ASCII-space separated words of whole texts; null has none."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts], dtype="int64")

    return count(text)


def _log_gamma_step(x: float, by: float) -> float:
    """``lgamma(x + by) - lgamma(x)`` for large ``x``, without taking the difference of two large numbers."""
    series = lambda y: 1 / (12 * y) - 1 / (360 * y**3)
    return (x - 0.5) * math.log1p(by / x) + by * (math.log(x + by) - 1) + series(x + by) - series(x)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are among the ``good``, of any size.

    Beyond numpy's range by rejection (the distribution is log-concave, so its mode and the
    probability there bound it).
    """
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    if draws * 2 > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    low, high, total = max(0, draws - bad), min(good, draws), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = draws * good / total * (bad / total) * ((total - draws) / (total - 1))
    peak = min(1.0, 0.9 / math.sqrt(2 * math.pi * (spread + 1)))  # below the probability of the mode
    wide = 1 + peak / 2

    def log_ratio(k: int) -> float:
        """Log-probability of ``k`` less that of the mode."""
        out = 0.0
        for held, sign in ((mode, 1), (good - mode, -1), (draws - mode, -1), (bad - draws + mode, 1)):
            by = sign * (k - mode)
            # large counts by the stable step, small ones exactly
            out -= _log_gamma_step(held + 1.0, by) if min(held, held + by) > 1000 else math.lgamma(held + by + 1) - math.lgamma(held + 1)
        return out

    while True:
        if rng.random() <= wide / (1 + wide):
            away = rng.random() * wide / peak
        else:
            away = (wide + rng.exponential()) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(away)
        bound = min(0.0, wide - peak * away)
        if low <= k <= high and math.log(max(rng.random(), 1e-300)) + bound <= log_ratio(k):
            return k


def even_dues(total: int, shards: int) -> np.ndarray:
    return np.diff([total * k // shards for k in range(shards + 1)])


def split_quotas(quotas: np.ndarray, dues: np.ndarray, seed: list[int]) -> np.ndarray:
    """``shards x sources``: exact quotas dealt out to shards of ``dues`` draws each, by halving the shards.

    At each node the left half's draws are a multivariate hypergeometric sample of the
    node's quotas, of the size its shards are due.
    """
    out = np.zeros((len(dues), len(quotas)), np.int64)
    todo = [(0, len(dues), quotas.astype(np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[low] = held
            continue
        middle, rest = (low + high) // 2, int(held.sum())
        due = int(dues[low:middle].sum())
        rng = np.random.default_rng([*seed, low, high])
        left = np.zeros_like(held)
        for s in np.flatnonzero(held):  # conditional marginals
            others = rest - int(held[s])
            left[s] = hypergeometric(rng, int(held[s]), others, due)
            due, rest = due - int(left[s]), others
        todo += [(low, middle, left), (middle, high, held - left)]
    return out


def _dice(doc_id: Column, text_key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_key)


def _placed(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with ``__source`` and ``__dice``) and the block each falls in."""
    out = rows.join(known, F.col("__source").eqNullSafe(F.col("__s_source"))).drop("__s_source")
    return out.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), "__dice"), F.col("__s_blocks")))


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` (a row a source) with ``number``: its place by code point, null last."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stage(sizes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "mix-ranged")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    held = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before = np.concatenate(([0], np.cumsum([held.get(k, 0) for k in range(max(held, default=-1) + 1)]))).tolist()
    return ranged.withColumn("number", F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), part.cast("int") + 1) + place).drop("id")


def _settle(sizes: DataFrame, weights, share: float, most: int, block_docs: int) -> DataFrame:
    """Target, block count, whole passes and the words left for each source.

    Targets are ``share`` of all sizes by weight; what passes ``most`` times a size is
    shared anew by the others. A round finds who passes it at the present share a weight,
    which only rises; the sources stay where they are.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int") + 1)
    rows = stage(_numbered(sizes).withColumn("weight", weight), "mix-numbered")
    total = float(rows.agg(F.sum("words")).first()[0] or 0)
    over, held = F.lit(False), -1
    while True:
        free = (F.col("words") > 0) & ~over
        seen = rows.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(over, F.col("words"))), F.count_if(over)).first()
        of_free, left = seen[0] or 0.0, share * total - most * float(seen[1] or 0)
        if seen[2] == held or not of_free:
            break
        held = seen[2]
        over = (F.col("words") > 0) & (F.col("weight") / of_free * left > most * F.col("words"))
    given = F.col("weight") / F.lit(of_free or 1.0) * F.lit(left)
    target = F.when(F.col("words") <= 0, 0.0).when(over, most * F.col("words").cast("double")).otherwise(given)
    rows = rows.withColumn("target", target)
    passes = F.when(F.col("words") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("words") + 1e-12))).otherwise(0).cast("long")
    return rows.withColumn("passes", passes).select(
        F.col("source").alias("__s_source"), F.col("number").alias("__number"), F.col("words").alias("source_size"), "target",
        F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("long").alias("__s_blocks"), F.col("passes").alias("__passes"),
        F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("words")).alias("__left"),
    )


def _in_order(blocks: DataFrame, seed: int) -> DataFrame:
    """``blocks`` with their permuted ``rank`` in the source and the words ``before`` them.

    A source's blocks fall into stretches by the upper bits of the hash that orders them;
    stretches are summed up first, so no task sorts a whole source.
    """
    dice = F.xxhash64(F.lit(seed + 2), "__number", "__block")
    upper = F.shiftrightunsigned(dice.bitwiseXOR(F.lit(-(1 << 63))), 40)  # in the order of the signed hash
    stretches = F.ceil(F.col("s_blocks") / STRETCH).cast("long")
    blocks = stage(blocks.withColumn("dice", dice).withColumn("stretch", F.shiftright(upper * stretches, 24)), "mix-unordered")
    upto = Window.partitionBy("__number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("__number", "stretch").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("__number", "stretch", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("__number", "stretch").orderBy("dice", "__block")
    run = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    out = blocks.withColumn("run", run).withColumn("at", F.row_number().over(inside) - 1).join(stage_side(sums, "mix-stretches"), ["__number", "stretch"])
    return out.withColumn("rank", F.col("n0") + F.col("at")).withColumn("before", F.col("w0") + F.col("run")).drop("run", "at", "w0", "n0", "dice", "stretch")


def _dealt(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """``__number, n, ends``: after which draw of a source each shard's stretch ends.

    ``quota`` has ``__number, n, drawn``. The draws of groups of sources are split among
    the shards first, on the driver, then those of each group's sources, in tasks.
    """
    quota = stage(quota.withColumn("group", F.floor(F.col("__number") / GROUP)), "mix-quota")
    groups = quota.groupBy("group").agg(F.sum("drawn").alias("drawn")).orderBy("group").collect()  # a row for GROUP sources
    totals = np.array([r.drawn for r in groups], np.int64)
    dues = split_quotas(totals, even_dues(int(totals.sum()), shards), [seed, 0])
    due_of = quota.sparkSession.sparkContext.broadcast({r.group: dues[:, i] for i, r in enumerate(groups)})

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__number")
        dealt = split_quotas(part["drawn"].to_numpy(np.int64), due_of.value[key[0]], [seed, 1 + int(key[0])])
        return pd.DataFrame({"__number": part["__number"], "n": part["n"], "ends": list(np.cumsum(dealt, axis=0).T)})

    return quota.groupBy("group").applyInPandas(split, "__number long, n long, ends array<long>")


def _draws(placed: DataFrame, most: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The draws of each block, and the documents taken of blocks drawn in part."""
    blocks = placed.groupBy("__number", "__block").agg(
        F.sum("size").alias("words"), F.first("__passes").alias("passes"), F.first("__left").alias("left"), F.first("__s_blocks").alias("s_blocks")
    )
    blocks = _in_order(blocks, seed)
    # Of the last pass: whole blocks while they fit, then one block in part.
    part = F.when(F.col("before") + F.col("words") <= F.col("left"), "all").when(F.col("before") < F.col("left"), "some").otherwise("none")
    blocks = stage(blocks.withColumn("part", part).withColumn("last", (F.col("part") != "none").cast("long")), "mix-blocks")
    quota = blocks.groupBy("__number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passes") + F.col("last")).alias("drawn"))
    bounds = stage_side(_dealt(quota, shards, seed), "mix-bounds")
    copies = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda c: c < F.col("passes") + F.col("last"))
    shard = lambda c: F.size(F.filter("ends", lambda e: e <= c * F.col("n") + F.col("rank")))
    draws = F.transform(copies, lambda c: F.struct(c.alias("copy"), shard(c).alias("shard")))
    drawn = stage_side(
        blocks.join(bounds, "__number")
        .select(F.col("__number").alias("__d_number"), F.col("__block").alias("__d_block"), F.col("part").alias("__part"), draws.alias("__draws")), "mix-draws"
    )
    room = stage_side(
        blocks.where("part = 'some'").select(F.col("__number").alias("__r_number"), F.col("__block").alias("__r_block"), (F.col("left") - F.col("before")).alias("room")),
        "mix-room",
    )
    # Only blocks drawn in part are ordered by document; each has about BLOCK_DOCS different
    # ones, and repeated rows are one.
    here = (F.col("__number") == F.col("__r_number")) & (F.col("__block") == F.col("__r_block"))
    some = placed.join(room, here).groupBy("__number", "__block", "__dice").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    inside = Window.partitionBy("__number", "__block").orderBy("__dice")
    fits = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words") / 2 <= F.col("room")
    taken = some.withColumn("fits", fits).where("fits").select(F.col("__dice").alias("__t_dice"), F.col("__number").alias("__t_number"))
    return drawn, stage_side(taken, "mix-taken")


def _drawn(placed: DataFrame, drawn: DataFrame, taken: DataFrame) -> DataFrame:
    """``placed`` with ``__draws``: the copies and shards of each row."""
    out = placed.join(drawn, (F.col("__number") == F.col("__d_number")) & (F.col("__block") == F.col("__d_block")), "left")
    out = out.join(taken, (F.col("__part") == "some") & (F.col("__number") == F.col("__t_number")) & (F.col("__dice") == F.col("__t_dice")), "left")
    without = F.filter("__draws", lambda d: d["copy"] < F.col("__passes"))
    return out.withColumn("__draws", F.when((F.col("__part") == "some") & F.col("__t_dice").isNull(), without).otherwise(F.col("__draws")))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most, shards, seed, block_docs):
    text_key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("__source"),
            _dice(F.col(id_col), text_key, seed).alias("__dice"), word_count(F.col(text_col)).alias("size"),
        ),
        "mix-slim",
    )
    sizes = slim.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    known = stage_side(_settle(sizes, weights, share, most, block_docs), "mix-sources")
    placed = stage(_placed(slim, known, seed), "mix-placed")
    return known, placed, *_draws(placed, most, shards, seed)


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: int = MOST, shards: int = 16, seed: int = 42, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, draws``.

    ``draws`` lists ``(copy, shard)`` of each time the mix takes the document. Sources
    are ordered by code point, null last, and weighed by ``weights``, repeating. Draws
    depend on ids, texts and ``seed`` only, so reruns agree and repeated rows (of equal id
    and text, ids may be null) are drawn alike. Wordless documents ride with their block.
    A source's draws end about half a document (all its repeated rows) from its target. No
    documents give no rows.
    """
    _, placed, drawn, taken = _planned(docs, id_col, text_col, source_col, weights, share, most, shards, seed, block_docs)
    return _drawn(placed, drawn, taken).select("doc_id", "size", "source_size", "target", F.col("__draws").alias("draws"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: int = MOST, shards: int = 16, seed: int = 42, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The mixed documents: the columns of ``docs``, with ``mix_copy`` and ``mix_shard``.

    A document taken twice is there twice. Rows of a shard lie together in a shuffled
    order, many tasks to a large shard. Texts are moved once, to their shard. Columns of
    ``docs`` that are named ``mix_copy`` or ``mix_shard`` are replaced; others may have
    any name.
    """
    known, _, drawn, taken = _planned(docs, id_col, text_col, source_col, weights, share, most, shards, seed, block_docs)
    text_key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_shard")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(source_col).cast("string").alias("__source"), _dice(F.col(id_col), text_key, seed).alias("__dice")
    )
    known = known.select("__s_source", "__number", "__s_blocks", "__passes")
    out = _drawn(_placed(rows, known, seed), drawn, taken).select("__row", "__dice", F.explode("__draws").alias("__draw"))
    out = out.select("__row", F.col("__draw.copy").alias("copy"), F.col("__draw.shard").alias("shard"), F.xxhash64(F.lit(seed + 3), "__dice", "__draw.copy").alias("order"))
    out = out.repartition("shard", F.pmod("order", F.lit(64))).sortWithinPartitions("shard", "order")
    return out.select("__row.*", F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"))
