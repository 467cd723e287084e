"""Benchmark decontamination by winnowing, with DataFrame functions only.

Each text keeps the least hash of ``K``-word grams in every run of ``W`` grams, so
two texts that share ``K + W - 1`` words share a kept hash at the same offset. The
kept hashes of documents and benchmark items are joined; a match gives the offset of
the item in the document, and the words themselves are compared along it, so a hash
collision never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .staging import BROADCAST_ROWS, stage, stage_side

#: Words of a window: the shortest span that counts (a shorter item counts whole).
WINDOW = 13
#: Words of a gram and grams of a run; K + W - 1 = WINDOW.
K = 5
W = WINDOW - K + 1
#: The bitmap of a large benchmark's prints has 16 MB at most; more prints only let more pass.
SIEVE_BITS = 27
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A packed print holds the upper 33 bits of the hash over a 31-bit position, as
#: many as an array can have.
_POSITION_BITS = 31


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are (``lower`` where they are the same)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Words of whole texts; null and wordless texts give an empty array."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _grams(tokens: Column, n: int) -> Column:
    """Packed prints of all n-grams: the hash above, the position below."""

    def packed(i: Column) -> Column:
        digest = F.xxhash64(F.slice(tokens, i + 1, n))
        return F.shiftleft(F.shiftright(digest, _POSITION_BITS), _POSITION_BITS) + i.cast("long")

    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), packed)).otherwise(
        F.array().cast("array<long>")
    )


def winnow(grams: Column) -> Column:
    """The least print of every run of ``W`` grams, each once."""
    runs = F.transform(F.sequence(F.lit(1), F.size(grams) - W + 1), lambda i: F.array_min(F.slice(grams, i, W)))
    return F.when(F.size(grams) >= W, F.array_distinct(runs)).otherwise(F.array().cast("array<long>"))


def _with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """``df`` (with ``tokens``) and ``prints``: ``(n, digest, at)`` of kept grams.

    ``n`` is 0 for winnowed grams; items shorter than a window are met by all grams
    of their own length ``n``. Grams are columns of their own, so that no lambda
    computes them again.
    """

    def rows(found: Column, n: int) -> Column:
        return F.transform(
            found,
            lambda v: F.struct(
                F.lit(n).alias("n"), F.shiftright(v, _POSITION_BITS).alias("digest"),
                v.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int").alias("at"),
            ),
        )

    df = df.withColumn("grams", _grams(F.col("tokens"), K)).withColumn("kept", winnow(F.col("grams")))
    return df.withColumn("prints", F.concat(rows(F.col("kept"), 0), *[rows(_grams(F.col("tokens"), n), n) for n in short]))


def _along(tokens: Column, item: Column, shift: Column) -> Column:
    """A string of 1 where the item laid at ``shift`` has the document's word, else 0."""
    same = lambda w, j: (shift + j >= 0) & F.coalesce(F.get(tokens, F.greatest(shift + j, F.lit(0))) == w, F.lit(False))
    return F.array_join(F.transform(item, lambda w, j: F.when(same(w, j), "1").otherwise("0")), "")


def _hit_words(same: Column, shift: Column) -> Column:
    """Positions of document words inside whole windows of agreement."""
    n = F.char_length(same)
    width = F.least(n, F.lit(WINDOW))
    starts = F.filter(F.sequence(F.lit(0), n - width), lambda j: F.substring(same, j + 1, width) == F.repeat(F.lit("1"), width))
    return F.flatten(F.transform(starts, lambda j: F.sequence(shift + j, shift + j + width - 1)))


def _sieve(prints: DataFrame, bits: int) -> DataFrame:
    """One row ``__sieve``: a bitmap of ``2 ** bits`` bits as longs, set where a print of an item falls."""
    place = F.pmod(F.xxhash64("n", "digest"), F.lit(1 << bits))
    words = prints.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    dense = prints.sparkSession.range(1 << (bits - 6)).join(words, F.col("id") == F.col("w"), "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("__sieve"))


def _passes(bits: int) -> Column:
    place = F.pmod(F.xxhash64("n", "digest"), F.lit(1 << bits))
    word = F.get("__sieve", F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row a document: ``doc_id, text_key, n_words, n_hit, n_items, items``.

    A word is hit inside any occurrence of ``WINDOW`` consecutive words of an item, or
    of a whole shorter item. ``items`` are the ids (as strings, sorted, distinct) of
    items with a hit. Null texts have no words; items without words or without id match
    nothing; repeated documents and items count alike each time, a repeated item id
    once. Equal texts are compared once, of documents (``text_key``, MD5 and length, stands
    for them) and of items. The prints of a benchmark that is counted to be small are
    broadcast; a larger one first sends a bitmap of bounded size, so that of the
    documents' prints only those travel that may meet one.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = stage(
        benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col("text")).alias("item"))
        .where("item_id IS NOT NULL AND size(item) > 0").distinct(),
        "benchmark-words",
    )
    key_of = F.xxhash64("item").alias("item_key")
    texts_of = stage(items.groupBy("item").agg(F.min("item_id").alias("first_id")), "benchmark-texts")
    members = stage_side(items.join(texts_of, "item").select("first_id", key_of, "item_id"), "benchmark-members")
    lengths = items.where(F.size("item") < WINDOW).select(F.size("item").alias("n")).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most WINDOW - 1 numbers
    of_item = _with_prints(texts_of.withColumn("tokens", F.col("item")), short)
    of_item = of_item.select("first_id", "item", F.explode("prints").alias("p")).where(
        F.col("p.n") == F.when(F.size("item") < WINDOW, F.size("item")).otherwise(0)
    )
    of_item = stage_side(of_item.select("p.n", "p.digest", F.col("p.at").alias("item_at"), "first_id", key_of), "benchmark-prints", broadcast_rows)
    n_prints = of_item.count()
    key = F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), F.octet_length(F.coalesce("text", F.lit(""))))
    marker = F.array(F.struct(F.lit(-1).alias("n"), F.xxhash64("text_key").alias("digest"), F.lit(0).alias("at")))
    # One pass over the texts: a row that stands for the document and one for each print.
    read = _with_prints(base.select("doc_id", key.alias("text_key"), words(F.col("text")).alias("tokens")), short)
    read = read.select("doc_id", "text_key", F.size("tokens").alias("n_words"), F.explode(F.concat(marker, "prints")).alias("p"))
    read = read.select("doc_id", "text_key", "n_words", "p.n", "p.digest", "p.at")
    if n_prints > broadcast_rows:
        bits = min(SIEVE_BITS, max(10, (32 * n_prints).bit_length()))
        read = read.crossJoin(F.broadcast(stage(_sieve(of_item, bits), "benchmark-sieve"))).where((F.col("n") == -1) | _passes(bits)).drop("__sieve")  # one row
    seen = stage(
        read.join(of_item, ["n", "digest"], "left").where("n = -1 OR first_id IS NOT NULL")
        .select("doc_id", "text_key", "n_words", "n", "first_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")),
        "contamination-seen",
    )
    laid = stage(seen.where("n >= 0").select("text_key", "first_id", "item_key", "shift").distinct(), "contamination-laid")
    hit_texts = stage_side(laid.select(F.xxhash64("text_key").alias("__hit")).distinct(), "contamination-texts")
    texts = base.withColumn("text_key", key).join(hit_texts, F.xxhash64("text_key") == F.col("__hit"), "left_semi")
    texts = texts.groupBy("text_key").agg(F.min("text").alias("text"))
    with_items = laid.join(texts_of.withColumn("item_key", F.xxhash64("item")), ["first_id", "item_key"])
    # A text and its candidate items meet in one row: distinct shifts only, at most as many
    # for an item as the two have words together; an item that shares no print isn't there.
    per_text = with_items.groupBy("text_key").agg(F.collect_list(F.struct("first_id", "item_key", "item", "shift")).alias("laid"))
    tokens = texts.join(per_text, "text_key").select("text_key", words(F.col("text")).alias("tokens"), "laid")
    aligned = F.transform(
        "laid", lambda x: F.struct(F.struct(x["first_id"].alias("first_id"), x["item_key"].alias("item_key")).alias("item"), x["shift"].alias("shift"), _along(F.col("tokens"), x["item"], x["shift"]).alias("same"))
    )
    marked = tokens.select("text_key", aligned.alias("aligned")).select(
        "text_key",
        F.filter(
            F.transform("aligned", lambda x: F.struct(x["item"].alias("item"), _hit_words(x["same"], x["shift"]).alias("at"))),
            lambda x: F.size(x["at"]) > 0,
        ).alias("hits"),
    )
    found = stage(
        marked.select(
            "text_key", F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["at"])))).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda x: x["item"])).alias("met"),
        ),
        "contamination-found",
    )
    each = found.select("text_key", F.explode("met").alias("i")).select("text_key", "i.first_id", "i.item_key").join(members, ["first_id", "item_key"])
    ids = each.groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = stage_side(found.drop("met").join(ids, "text_key"), "contamination-items")
    out = seen.where("n = -1").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words")).join(found, "text_key", "left")
    return out.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Hit words are at least one in ``share``."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int | None = None, **how) -> DataFrame:
    """The documents without a benchmark window, with the columns of ``docs``.

    With a ``share`` only documents go whose hit words are at least one in ``share``.
    """
    found = find_contamination(docs, benchmark, text_col=text_col, **how)
    hit = F.col("n_hit") > 0 if share is None else contaminated(F.col("n_hit"), F.col("n_words"), share)
    bad = found.where(hit).select(F.col("text_key").alias("__bad")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.md5(text), F.octet_length(text))
    return docs.join(stage_side(bad, "contamination-bad"), key == F.col("__bad"), "left_anti")
