"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by pattern in each text; the hashes of their values are then
counted over the whole corpus by distinct repositories and owners. A value held by
few owners and in few repositories looks like a live credential; one copied widely,
be it by one owner, is an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .staging import stage

# The base patterns, with the group that must be long enough and its length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more of AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{16,}"
#: Candidate kinds that only ownership frequency can judge: they add spans.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Header, header fields, body (the group) and footer; a key that is cut off ends with its last line of base64.
PRIVATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:\s{0,4}[A-Z][A-Za-z-]{1,40}:[^\r\n]{0,200}){0,8}"
    r"([A-Za-z0-9+/=\s\x5C]{0,65536}(?=-----END )|(?:(?:\s|\x5C[nr]){0,4}[A-Za-z0-9+/]{32,}={0,2}){0,400})"
    r"(?:-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
)
#: White space of a key's body, also as written in string literals.
BREAKS = r"\s|\x5C[nr]"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "private")
#: A value of more distinct owners than this is a copied example.
LIVE_OWNERS = 2
#: Likewise of more distinct repositories.
LIVE_REPOSITORIES = 10


def _matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``(start, end, value)`` of the leftmost non-overlapping matches, in code points.

    ``split`` gives the text between the matches, ``regexp_extract_all`` the matches
    themselves; their lengths add up to the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    pieces = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(done: Column, piece: Column) -> Column:
        start = done["at"] + F.char_length(piece["gap"])
        end = start + F.char_length(piece["whole"])
        row = F.struct(start.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.char_length(piece["value"]) >= least, F.concat(done["rows"], F.array(row))).otherwise(done["rows"]).alias("rows"),
        )

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("rows")), step, lambda done: done["rows"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _spans(text: Column) -> Column:
    found = {
        "assign": _matches(text, ASSIGN, 2, 12), "access": _matches(text, ACCESS), "hex": _matches(text, HEX),
        "token": _matches(text, TOKEN), "private": _matches(text, PRIVATE, 1),
    }

    def of_kind(kind: int, rows: Column) -> Column:
        value = lambda x: F.regexp_replace(x["value"], BREAKS, "") if KINDS[kind] == "private" else x["value"]
        digest = lambda x: F.xxhash64(value(x), F.sha2(value(x), 256))
        return F.transform(
            rows, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), digest(x).alias("digest"))
        )

    return F.array_sort(F.concat(*[of_kind(KINDS.index(k), rows) for k, rows in found.items()]))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None,
    owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """One row a document: ``doc_id`` and ``spans``, an array sorted by start and kind.

    A span is ``start, kind, end, digest, owners, repositories, live``: offsets are
    code points, ``kind`` indexes ``KINDS``, ``owners`` and ``repositories`` are the
    distinct ones that hold the value anywhere in the corpus (null ones count as one
    more), and ``live`` says that at most ``live_owners`` owners and
    ``live_repositories`` repositories do. Without a
    ``repository_col`` a document is its own repository. Null and empty texts have no
    spans; repeated rows are scanned each.
    """
    repository = F.col(repository_col or id_col).cast("string")
    scanned = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), repository.alias("repository"), F.col(owner_col).cast("string").alias("owner"),
            _spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "secrets-scanned",
    )
    each = scanned.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("s"))
    each = each.select("row", "repository", "owner", "s.start", "s.kind", "s.end", "s.digest")
    nulls = [F.max(F.col(c).isNull().cast("int")) for c in ("owner", "repository")]
    spread = stage(
        each.groupBy("digest").agg(
            (F.countDistinct("owner") + nulls[0]).alias("owners"), (F.countDistinct("repository") + nulls[1]).alias("repositories")
        ),
        "secrets-spread",
    )
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    judged = each.join(spread, "digest").select(
        "row", F.struct("start", "kind", "end", "digest", "owners", "repositories", live.alias("live")).alias("s")
    )
    # The spans of a row are what its own text holds.
    rows = stage(judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans")), "secrets-rows")
    empty = F.array().cast(rows.schema["spans"].dataType)
    return scanned.select("doc_id", "row").join(rows, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def is_base(span: Column) -> Column:
    return span["kind"] < len(BASE_KINDS)


def joined(spans: Column, *more: str) -> Column:
    """``kind:start:end`` of the spans, and ``more`` fields, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"], *(s[m] for m in more))), ",")


def explode_spans(found: DataFrame) -> DataFrame:
    """One row a span of ``scan_secrets``: ``doc_id, kind`` (its name) ``, start, end, owners, repositories, live``."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1).alias("kind")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", name, "s.start", "s.end", "s.owners", "s.repositories", "s.live")
