"""CIGAR and MD strings, unrolled to one letter a position as Columns; clipping on runs, over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .dna import PHRED_OFFSET, _col

#: Operators that consume read bases, and reference bases.
READ_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def _count(text: Column, letters: str) -> Column:
    """Letters of ``text`` that are among ``letters``."""
    return F.char_length(F.regexp_replace(text, f"[^{letters}]", ""))


def unroll(cigar: Column | str) -> Column:
    """``2S3M`` as ``SSMMM``; ``*`` and null are empty."""
    runs = F.regexp_extract_all(_col(cigar), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    letters = F.transform(runs, lambda r: F.repeat(F.right(r, F.lit(1)), F.left(r, F.char_length(r) - 1).cast("int")))
    return F.coalesce(F.array_join(letters, ""), F.lit(""))


def reroll(unrolled: Column | str) -> Column:
    """``SSMMM`` as ``2S3M``; empty as ``*``."""
    text = _col(unrolled)
    runs = F.regexp_extract_all(text, F.lit(r"((.)\2*)"), F.lit(1))
    out = F.array_join(F.transform(runs, lambda r: F.concat(F.char_length(r).cast("string"), F.left(r, F.lit(1)))), "")
    return F.when(text == "", "*").otherwise(out)


def md_is_valid(md: Column | str) -> Column:
    """The grammar of the format: counts between mismatches and deletions."""
    return _col(md).rlike(r"^[0-9]+(([A-Z]|\^[A-Z]+)[0-9]+)*$")


def md_expand(md: Column | str) -> Column:
    """One letter a reference position: ``m`` match, upper case mismatch, lower case deletion."""
    tokens = F.regexp_extract_all(_col(md), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike("^[0-9]"), F.repeat(F.lit("m"), t.try_cast("int"))).when(t.startswith("^"), F.lower(F.substring(t, 2, 1 << 30))).otherwise(t),
        ), "",
    )


def md_format(expanded: Column | str) -> Column:
    """The MD text; letters other than ACGTN raise.

    A mismatch is preceded by the count of matches since the last event; so is a run of
    deletions, with ``^``.
    """
    text = _col(expanded)
    events = F.regexp_extract_all(text, F.lit(r"(m*)([ACGTN]|[acgtn]+)"), F.lit(0))
    piece = lambda e: F.concat(
        F.char_length(F.regexp_replace(e, "[^m]", "")).cast("string"), F.when(e.rlike("[acgtn]$"), "^").otherwise(""), F.upper(F.regexp_replace(e, "m", ""))
    )
    tail = F.char_length(F.regexp_extract(text, "(m*)$", 1)).cast("string")
    out = F.concat(F.array_join(F.transform(events, piece), ""), tail)
    return F.when(text.rlike("^[mACGTNacgtn]*$"), out).otherwise(F.raise_error(F.concat(F.lit("unexpected MD letter in "), text)).cast("string"))


def edit_distance(unrolled: Column, expanded: Column) -> Column:
    """Insertions of the CIGAR and every non-match of the MD."""
    return _count(unrolled, "I") + F.char_length(expanded) - _count(expanded, "m")


_RUN = re.compile(r"(\d+)([MIDNSHP=X])")
_MD = re.compile(r"[0-9]+(?:(?:[A-Z]|\^[A-Z]+)[0-9]+)*")
_MD_TOKEN = re.compile(r"(\d+)|\^([A-Z]+)|([A-Z])")
_MD_EVENT = re.compile(r"(m*)(?:([ACGTN])|([acgtn]+))")
Runs = list[tuple[int, str]]


def runs_of(cigar: str | None) -> Runs:
    """The runs of a CIGAR; none for ``*`` and null."""
    return [(int(n), op) for n, op in _RUN.findall(cigar or "")]


def _written(runs: Runs) -> str:
    out: list[list] = []
    for n, op in runs:
        if n and out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out) or "*"


def _split(runs: Runs, bases: int) -> tuple[Runs, Runs] | None:
    """The least start with so many read bases, and the rest; None if there are fewer."""
    for i, (n, op) in enumerate(runs):
        if bases <= 0:
            return runs[:i], runs[i:]
        if op in READ_OPS:
            if n > bases:
                return [*runs[:i], (bases, op)], [(n - bases, op), *runs[i + 1 :]]
            bases -= n
    return (runs, []) if bases <= 0 else None


def _size(runs: Runs, ops: str) -> int:
    return sum(n for n, op in runs if op in ops)


def _marks(cut: Runs, hard: bool) -> Runs:
    """What stands for a clipped end, outermost first: all ``H``, or ``S`` for its bases."""
    bases = 0 if hard else _size(cut, READ_OPS)
    return [(sum(n for n, _ in cut) - bases, "H"), (bases, "S")]


def _md_letters(md: str) -> str:
    return "".join("m" * int(n) if n else gone.lower() or other for n, gone, other in _MD_TOKEN.findall(md))


def _md_text(letters: str) -> str:
    if other := letters.strip("mACGTNacgtn"):
        raise ValueError(f"unexpected MD letter in {other}")
    out, at = [], 0
    for event in _MD_EVENT.finditer(letters):
        out.append(f"{len(event[1])}{event[2] or '^' + event[3].upper()}")
        at = event.end()
    return "".join(out) + str(len(letters) - at)


def clipped(cigar: str | None, md: str | None, n: int, hard: bool) -> tuple:
    """``error, n, left, cigar, md, nm`` of an alignment with ``n`` bases clipped at both ends.

    ``left`` counts the reference positions that go at the front; ``n`` comes back limited
    to the length of the alignment.
    """
    runs = runs_of(cigar)
    n = min(n, sum(k for k, _ in runs))
    front = _split(runs, n)
    rest = [*_marks(front[0], hard), *front[1]] if front else runs
    # on what the front has left, from the other end
    rear = _split([r for r in rest[::-1] if r[0]], n) if front else None
    if n > 0 and not rear:
        return "fewer read bases than are to be clipped", n, 0, None, None, None
    if md is None or not _MD.fullmatch(md):
        return "no valid MD", n, 0, None, None, None
    (head, _), (tail, left) = front, rear
    runs = [*_marks(tail, hard), *left][::-1]
    lost = _size(head, REFERENCE_OPS)
    letters = _md_letters(md)
    letters = letters[lost : max(lost, len(letters) - _size(tail, REFERENCE_OPS))]
    return None, n, lost, _written(runs), _md_text(letters), _size(runs, "I") + len(letters) - letters.count("m")


def clip_both_ends(records: DataFrame, n: Column, hard: bool = False) -> DataFrame:
    """``records`` with ``n`` bases clipped at both ends: ``pos, cigar, md, nm, seq, qual``.

    ``n`` is limited to the length of the alignment; a null one clips nothing. Soft
    clipping leaves the bases and marks them ``S``; hard clipping cuts them and marks all
    ``H``. ``clip_error`` says why a record cannot be clipped (too few read bases, no MD);
    such records are unchanged. Equal alignments of a batch are worked out once.
    """

    @F.pandas_udf("error string, n int, left int, cigar string, md string, nm int")
    def of(cigars: pd.Series, mds: pd.Series, ns: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}
        keys = list(zip(cigars, mds, ns.fillna(0).astype(int), strict=True))
        for key in set(keys):
            known[key] = clipped(*key, hard)
        out = pd.DataFrame([known[k] for k in keys], columns=["error", "n", "left", "cigar", "md", "nm"])
        return out.astype({"nm": "Int32"})

    # else a filter on the result that is pushed down clips every record twice
    out = records.withColumn("__clip", of.asNondeterministic()("cigar", "md", n))
    ok, k = F.col("__clip.error").isNull(), F.col("__clip.n")
    changed = {
        "clip_error": F.col("__clip.error"), "pos": F.when(ok, F.col("pos") + F.col("__clip.left")).otherwise(F.col("pos")),
        **{c: F.when(ok, F.col(f"__clip.{c}")).otherwise(F.col(c)) for c in ("cigar", "nm", "md")},
    }
    if hard:
        cut = lambda c: F.substring(F.col(c), k + 1, F.greatest(F.lit(0), F.char_length(c) - 2 * k))
        changed |= {c: F.when(ok, cut(c)).otherwise(F.col(c)) for c in ("seq", "qual")}
    return out.withColumns(changed).drop("__clip")


def sure_stretches(cigar: str | None, qual: str | None, pos: int, least: int) -> list[tuple[int, int]]:
    """First and last reference position of each stretch of aligned bases that all score ``least`` or more.

    Positions that are deleted or skipped, or have no score, end a stretch.
    """
    out: list[list[int]] = []
    scores = (qual or "").encode("latin-1", "replace").translate(_sure_table(least))
    at = 0
    for n, op in runs_of(cigar):
        if op in "M=X":
            for good in _GOOD.finditer(scores, at, at + n):
                first, last = pos + good.start() - at, pos + good.end() - at - 1
                if out and out[-1][1] == first - 1:
                    out[-1][1] = last
                else:
                    out.append([first, last])
            pos += n
        elif op in "DN":
            pos += n
        if op in READ_OPS:
            at += n
    return [tuple(x) for x in out]


_GOOD = re.compile(rb"1+")


@lru_cache(16)
def _sure_table(least: int) -> bytes:
    return bytes(49 if i - PHRED_OFFSET >= least else 48 for i in range(256))


def is_non_empty(cigar: Column | str, pos: Column | str, sq_length: Column | str) -> Column:
    """Some ``M`` in the CIGAR and a start within the reference sequence."""
    return _col(cigar).contains("M") & (_col(pos) > 0) & (_col(pos) <= _col(sq_length))
