"""Sample keys: four labels (two indices, two barcodes) in one text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dna import _col

SEPARATOR = "_"
#: Label of read pairs whose barcodes were not found.
WITHOUT_BARCODES = "without_barcodes"


def key_text(i5: Column, i7: Column, p5: Column | None = None, p7: Column | None = None) -> Column:
    """``i5_i7_p5_p7`` with absent parts empty; a separator inside a part raises."""
    parts = [F.coalesce(_col(x), F.lit("")) if x is not None else F.lit("") for x in (i5, i7, p5, p7)]
    joined = F.concat_ws(SEPARATOR, *parts)
    clean = F.size(F.split(joined, SEPARATOR)) == 4
    return F.when(_col(i5).isNull() | _col(i7).isNull(), F.lit(None).cast("string")).when(clean, joined).otherwise(
        F.raise_error(F.concat(F.lit("separator inside a label: "), joined)).cast("string")
    )


def parse_key(text: Column | str) -> Column:
    """The parts as a struct, empty ones null; fewer than two parts give null."""
    parts = F.split(_col(text), SEPARATOR)
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    fields = F.struct(*[part(i).alias(n) for i, n in enumerate(("i5", "i7", "p5", "p7"))])
    return F.when(F.size(F.split(F.rtrim(_col(text), F.lit(SEPARATOR)), SEPARATOR)) >= 2, fields)


def flatten_key(text: Column | str) -> Column:
    """Each part without what follows its first point: all barcodes of a set are one."""
    return F.regexp_replace(_col(text), r"\.[^_]*", "")


def index_only(text: Column | str) -> Column:
    """The key of the index pair alone: ``i5_i7__``."""
    return F.concat(F.substring_index(_col(text), SEPARATOR, 2), F.lit(SEPARATOR * 2))
