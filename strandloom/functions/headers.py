"""FASTQ headers as structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dna import _col, let
from .keys import parse_key

KEY_SEPARATOR = ";"
FIELDS = ("instrument", "run", "flowcell", "lane", "tile", "x", "y", "key", "umi", "read", "filtered", "control", "index")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def parse_header(line: Column | str) -> Column:
    """A struct of ``FIELDS``, or null if neither header form fits.

    A leading ``@`` is optional and so is a ``;key`` before the first space. The usual
    form is ``instrument:run:flowcell:lane:tile:x:y[:umi] read:Y|N:control[:index]``
    (a run or read number that isn't one counts as 0); the other one
    ``flowcell`` + six digits + ``:lane:tile:x:y/read``.
    """
    bare = F.regexp_replace(_col(line), "^@", "")
    keyed = r"^([^;]*);([^ ]*)(?= )"
    text = F.when(bare.contains(KEY_SEPARATOR), F.regexp_replace(bare, keyed, "$1")).otherwise(bare)
    key = F.when(bare.contains(KEY_SEPARATOR), F.nullif(F.regexp_extract(bare, keyed, 2), F.lit("")))
    halves = F.split(F.rtrim(text), " ")
    slash = F.split(text, "/")
    cut = F.struct(
        F.size(halves).alias("n"), F.split(F.get(halves, F.lit(0)), ":").alias("left"), F.split(F.get(halves, F.lit(1)), ":").alias("right"),
        F.split(F.get(slash, F.lit(0)), ":").alias("plain"), _int(F.get(slash, F.lit(1))).alias("read"), key.alias("key"),
    )
    return let(cut, _usual_or_short)


def _usual_or_short(cut: Column) -> Column:
    left, right, plain, read, key = (cut[n] for n in ("left", "right", "plain", "read", "key"))
    at = lambda parts, i: F.get(parts, F.lit(i))
    places = ("lane", "tile", "x", "y")
    numbers = [_int(at(left, i)) for i in (3, 4, 5, 6)]
    flag, control = at(right, 1), _int(at(right, 2))
    fits = (cut["n"] == 2) & flag.isin("Y", "N") & control.isNotNull() & at(left, 2).isNotNull()
    for n in numbers:
        fits &= n.isNotNull()
    usual = F.struct(
        at(left, 0).alias("instrument"), F.coalesce(_int(at(left, 1)), F.lit(0)).alias("run"), at(left, 2).alias("flowcell"),
        *[n.alias(name) for n, name in zip(numbers, places, strict=True)], key.alias("key"),
        at(left, 7).alias("umi"), F.coalesce(_int(at(right, 0)), F.lit(0)).alias("read"), (flag == "Y").alias("filtered"),
        control.alias("control"), F.coalesce(at(right, 3), F.lit("")).alias("index"),
    )
    other_numbers = [_int(at(plain, i)) for i in (1, 2, 3, 4)]
    other_fits = read.isNotNull() & (F.char_length(at(plain, 0)) >= 6)
    for n in other_numbers:
        other_fits &= n.isNotNull()
    other = F.struct(
        F.lit("").alias("instrument"), F.lit(0).alias("run"), F.left(at(plain, 0), F.char_length(at(plain, 0)) - 6).alias("flowcell"),
        *[n.alias(name) for n, name in zip(other_numbers, places, strict=True)], key.alias("key"),
        F.lit(None).cast("string").alias("umi"), read.alias("read"), F.lit(False).alias("filtered"), F.lit(0).alias("control"), F.lit("").alias("index"),
    )
    return F.when(F.coalesce(fits, F.lit(False)), usual).when(F.coalesce(other_fits, F.lit(False)), other)


def parsed_key(header: Column) -> Column:
    """The key embedded in a parsed header, as a struct."""
    return parse_key(header["key"])


def header_text(h: Column, key: Column | None = None) -> Column:
    """The usual form. A ``key`` is put before the first space; another embedded one raises."""
    return let(F.struct(h.alias("h"), (F.lit(None).cast("string") if key is None else key).alias("key")), lambda x: _written(x["h"], None if key is None else x["key"]))


def _written(h: Column, key: Column | None) -> Column:
    own = h["key"]
    if key is not None:
        own = F.when(own.isNull() | (own == key), key).otherwise(F.raise_error(F.lit("the header has another key")).cast("string"))
    where = F.concat_ws(":", h["instrument"], h["run"], h["flowcell"], h["lane"], h["tile"], h["x"], h["y"])
    embedded = F.coalesce(F.concat(F.lit(KEY_SEPARATOR), h["key"]), F.lit("")) if key is None else F.when(h["key"].isNotNull(), F.concat(F.lit(KEY_SEPARATOR), own)).otherwise("")
    tail = F.lit("") if key is None else F.when(h["key"].isNull(), F.concat(F.lit(KEY_SEPARATOR), own)).otherwise("")
    read = F.concat_ws(":", h["read"], F.when(h["filtered"], "Y").otherwise("N"), h["control"], h["index"])
    return F.concat(F.lit("@"), where, embedded, F.coalesce(F.concat(F.lit(":"), h["umi"]), F.lit("")), tail, F.lit(" "), read)


def same_but_read(a: Column, b: Column) -> Column:
    """Equal in all but the read number; key and UMI count only where ``a`` has one."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: _same_but_read(x["a"], x["b"]))


def _same_but_read(a: Column, b: Column) -> Column:
    plain = [n for n in FIELDS if n not in ("key", "umi", "read")]
    same = F.lit(True)
    for name in plain:
        same &= a[name].eqNullSafe(b[name])
    for name in ("key", "umi"):
        same &= a[name].isNull() | a[name].eqNullSafe(b[name])
    return same


def same_header(a: Column, b: Column) -> Column:
    return same_but_read(a, b) & a["read"].eqNullSafe(b["read"])


def read_group(h: Column) -> Column:
    """``PM:instrument`` and ``PU:flowcell.run.lane``, tab-separated."""
    return let(h, lambda x: F.concat(F.lit("PM:"), x["instrument"], F.lit("\tPU:"), F.concat_ws(".", x["flowcell"], x["run"], x["lane"])))
