"""Operators on aligned records: split, clip, filter, statistics, tags, read groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.cigar import clip_both_ends, is_non_empty, sure_stretches
from ..functions.dna import is_dna
from ..functions.keys import flatten_key, parse_key
from ..sources.places import written
from .counts import combine, count_labels
from .sizes import sized

UNMAPPED, DUPLICATE = 0x4, 0x400


def is_mapped() -> Column:
    return F.col("flag").bitwiseAND(UNMAPPED) == 0


def tag(name: str) -> Column:
    """The text of an optional tag, null if absent."""
    return F.try_element_at("tags", F.lit(name))["value"]


def with_tag(records: DataFrame, name: str, value: Column, kind: str = "Z") -> DataFrame:
    """``records`` with the tag set, its place in the map replaced."""
    others = F.map_filter("tags", lambda k, _: k != name)
    new = F.map_from_arrays(F.array(F.lit(name)), F.array(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))
    return records.withColumn("tags", F.map_concat(F.coalesce(others, F.create_map().cast(records.schema["tags"].dataType)), new))


# Splitting by sample

def demultiplex(records: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Records with ``key`` (flattened) from the read name, the name without it, and XD.

    XD is ``p5bases_p7bases_length``, unknown barcodes empty. ``error`` marks records
    whose name has no key; the other columns of those are unchanged.
    """
    full = F.get(F.split("qname", ";"), F.lit(1))
    parts = parse_key(full)
    out = records.withColumns({"__key": full, "__p5": parts["p5"], "__p7": parts["p7"], "error": F.when(parts.isNull(), F.lit("no key in the read name"))})
    known = sized(barcodes.select(F.col("augmented_label").alias("__l"), F.col("barcode").alias("__b")))
    for side in ("5", "7"):
        side_known = known.select(F.col("__l").alias(f"__l{side}"), F.col("__b").alias(f"__b{side}"))
        out = out.join(side_known, F.col(f"__p{side}") == F.col(f"__l{side}"), "left")
    mark = F.concat_ws("_", F.coalesce("__b5", F.lit("")), F.coalesce("__b7", F.lit("")), F.char_length("seq"))
    ok = F.col("error").isNull()
    out = with_tag(out.withColumn("__xd", mark), "XD", F.col("__xd"))
    return out.withColumns({"key": F.when(ok, flatten_key("__key")), "qname": F.when(ok, F.get(F.split("qname", ";"), F.lit(0))).otherwise(F.col("qname"))}).drop(
        "__key", "__p5", "__p7", "__l5", "__b5", "__l7", "__b7", "__xd"
    )


def demultiplex_counts(split: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``demultiplexed`` and ``aligned`` of each key, added to the counters read before."""
    rows = split.where("error IS NULL")
    each = rows.groupBy("key").agg(F.count(F.lit(1)).alias("demultiplexed"), F.sum(is_mapped().cast("long")).alias("aligned"))
    new = each.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.lit(1000 + i).alias("label_ordinal"), F.col(c).alias("n")) for i, c in enumerate(("demultiplexed", "aligned"))])).alias("x"))
    new = new.select("key", "x.*").where("n > 0")
    return new if before is None else combine(before, new)


def selected_records(split: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of the chosen keys, with ``file_name``: the key, ``:`` as ``-``."""
    chosen = split.where("error IS NULL").join(sized(keys.select("key").distinct()), "key", "left_semi")
    return chosen.withColumn("file_name", F.replace(F.col("key"), F.lit(":"), F.lit("-")))


# Clipping and filters

def clip_length(records: DataFrame, read_groups: DataFrame, default: int, libraries1=(), n1: int = 0, libraries2=(), n2: int = 0) -> DataFrame:
    """``records`` with ``clip_n`` by the library of their read group; the second list overrides."""
    library = sized(read_groups.select(F.col("id").alias("__rg"), F.col("library").alias("__lb")))
    out = records.join(library, tag("RG") == F.col("__rg"), "left")
    n = F.when(F.col("__lb").isin(*libraries2), n2).when(F.col("__lb").isin(*libraries1), n1).otherwise(default)
    return out.withColumn("clip_n", n).drop("__rg", "__lb")


def clip(records: DataFrame, n: Column, sequences: DataFrame, hard: bool = False) -> DataFrame:
    """Clipped records that keep a match within their sequence; those that can't be clipped go."""
    clipped = clip_both_ends(records, n, hard).where("clip_error IS NULL").drop("clip_error")
    sizes = sized(sequences.select(F.col("name").alias("__sq"), F.col("length").alias("__sq_length")))
    return clipped.join(sizes, F.col("rname") == F.col("__sq")).where(is_non_empty("cigar", "pos", "__sq_length")).drop("__sq", "__sq_length")


def clip_errors(records: DataFrame, n: Column) -> DataFrame:
    """``error, n, qname``: why records cannot be clipped, how many, and the first by name."""
    bad = clip_both_ends(records, n).where("clip_error IS NOT NULL")
    return bad.groupBy(F.col("clip_error").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.min("qname").alias("qname")).orderBy("error")


#: Targets of up to so many positions share a width of bins (a power of two).
_WIDTHS = tuple(range(12, 32, 3))


def _width(length: Column) -> Column:
    """The least of ``_WIDTHS`` whose bins are as wide as a target, so it lies in two bins at most."""
    return F.coalesce(*[F.when(length <= 1 << w, w) for w in _WIDTHS[:-1]], F.lit(_WIDTHS[-1]))


def _bins(first: Column, last: Column, width: Column) -> Column:
    shifted = lambda x: F.call_function("shiftright", x, width)
    return F.sequence(shifted(first), shifted(last))


class TargetIndex:
    """Targets by chromosome and start, with the least end of each and all later ones."""

    def __init__(self, targets: pd.DataFrame):
        self.held = {}
        for chrom, own in targets.groupby("chrom"):
            own = own.sort_values("first")
            self.held[chrom] = own["first"].to_numpy(), np.minimum.accumulate(own["last"].to_numpy()[::-1])[::-1]

    def inside(self, chrom: str, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which stretches contain a target."""
        starts, ends = self.held.get(chrom, (np.zeros(0, np.int64),) * 2)
        at = np.searchsorted(starts, first)
        out = at < len(starts)
        out[out] = ends[at[out]] <= last[out]
        return out


def _meets(index, least: int) -> Column:
    """Whether a stretch of sure bases of the record contains a target."""

    @F.pandas_udf("boolean")
    def of(chroms: pd.Series, positions: pd.Series, cigars: pd.Series, quals: pd.Series) -> pd.Series:
        rows, names, spans = [], [], []
        for i, (chrom, pos, cigar, qual) in enumerate(zip(chroms, positions, cigars, quals, strict=True)):
            found = sure_stretches(cigar, qual, pos, least) if chrom in index.value.held else []
            rows += [i] * len(found)
            names += [chrom] * len(found)
            spans += found
        out = np.zeros(len(chroms), bool)
        at, names, spans = np.array(rows, np.int64), np.array(names, object), np.array(spans, np.int64).reshape(-1, 2)
        for chrom in set(names.tolist()):
            own = names == chrom
            out[at[own][index.value.inside(chrom, spans[own, 0], spans[own, 1])]] = True
        return pd.Series(out)

    return of.asNondeterministic()("rname", "pos", "cigar", "qual")


def filter_to_targets(
    records: DataFrame, bed: DataFrame, min_mapq: int, min_base_quality: int, bed_rows: int = 1_000_000, keys: tuple[str, ...] = ("file", "ordinal")
) -> DataFrame:
    """Mapped records that cover all of some target with bases of the given quality.

    A deleted base or one outside the read fails the target. A read becomes its stretches
    of sure bases, which must contain a target. Of a list counted to at most ``bed_rows``
    targets each task holds the sorted ends, and no record is moved. A larger list meets
    the stretches by bins, whose width goes by the target's length so that it lies in two
    at most; the records that met one are found by their ``keys``.
    """
    spark = records.sparkSession
    reads = records.where(is_mapped() & (F.col("mapq") >= min_mapq))
    targets = bed.select("chrom", (F.col("start0") + 1).cast("long").alias("first"), F.col("end").cast("long").alias("last")).where("chrom IS NOT NULL AND first <= last").distinct()
    if targets.limit(bed_rows + 1).count() <= bed_rows:
        index = spark.sparkContext.broadcast(TargetIndex(targets.toPandas()))
        return reads.where(_meets(index, min_base_quality))

    @F.pandas_udf("array<struct<lo:long,hi:long>>")
    def stretches(positions: pd.Series, cigars: pd.Series, quals: pd.Series) -> pd.Series:
        return pd.Series([sure_stretches(c, q, p, min_base_quality) for p, c, q in zip(positions, cigars, quals, strict=True)], dtype=object)

    targets = targets.withColumn("__width", _width(F.col("last") - F.col("first") + 1))
    widths = [r[0] for r in targets.select("__width").distinct().collect()]  # at most as many as _WIDTHS
    placed = targets.select("chrom", "first", "last", "__width", F.explode(_bins(F.col("first"), F.col("last"), F.col("__width"))).alias("__bin"))
    slim = reads.select(*keys, "rname", F.explode(stretches("pos", "cigar", "qual")).alias("s")).select(*keys, "rname", "s.lo", "s.hi")
    slim = slim.withColumn("__w", F.explode(F.array(*map(F.lit, widths)))).withColumn("__b", F.explode(_bins(F.col("lo"), F.col("hi"), F.col("__w"))))
    met = (F.col("rname") == F.col("chrom")) & (F.col("__w") == F.col("__width")) & (F.col("__b") == F.col("__bin")) & (F.col("lo") <= F.col("first")) & (F.col("last") <= F.col("hi"))
    return reads.join(slim.join(placed, met, "left_semi").select(*keys).distinct(), list(keys), "left_semi")


def restrict_damage(records: DataFrame, threshold: float, name: str = "ds") -> DataFrame:
    """Records whose tag is a number above ``threshold``, compared as 32-bit floats."""
    return records.where(tag(name).try_cast("float") > F.lit(threshold).cast("float"))


# Statistics

def target_classes(spark: SparkSession, json: str) -> DataFrame:
    """``reference, class`` from ``{"class": "reference" or [...]}``; raises on bad JSON."""
    from pyspark.sql import types as T

    one = spark.range(1).select(F.explode(F.from_json(F.lit(json), T.MapType(T.StringType(), T.StringType()), {"mode": "FAILFAST"})).alias("class", "v"))
    many = F.coalesce(F.from_json("v", T.ArrayType(T.StringType())), F.array("v"))
    return one.select(F.explode(many).alias("reference"), "class")


def class_counts(records: DataFrame, classes: DataFrame, key: str, min_mapq: int = 0) -> DataFrame:
    """Counters of each class: reads, and ``class-coverageLength``, the bases they have."""
    good = records.where(is_mapped() & (F.col("mapq") >= min_mapq)).select("rname", F.char_length("seq").alias("n"))
    each = good.join(sized(classes), F.col("rname") == F.col("reference")).groupBy("class").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").cast("long").alias("bases"))
    rows = each.select(F.explode(F.array(F.struct(F.col("class").alias("label"), F.col("reads").alias("n")), F.struct(F.concat(F.col("class"), F.lit("-coverageLength")).alias("label"), F.col("bases").alias("n")))).alias("x"))
    order = Window.partitionBy("key").orderBy("label")
    return rows.select(F.lit(key).alias("key"), "x.label", "x.n").withColumn("label_ordinal", F.row_number().over(order))


def length_histogram(records: DataFrame, min_mapq: int = 0) -> DataFrame:
    """``length, n, share, cumulative`` of mapped reads."""
    counts = records.where(is_mapped() & (F.col("mapq") >= min_mapq)).groupBy(F.char_length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    every, upto = Window.partitionBy(), Window.partitionBy().orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(every)  # a row a read length
    return counts.select("length", "n", (F.col("n") / total).alias("share"), (F.sum("n").over(upto) / total).alias("cumulative"))


def duplicate_depths(records: DataFrame) -> DataFrame:
    """``depth, n``: how many groups of equal place and XD have that many reads, zeros kept.

    Reads without XD form the group ``null``; strands count together.
    """
    mapped = records.where(is_mapped())
    groups = mapped.groupBy("rname", "pos", F.coalesce(tag("XD"), F.lit("null")).alias("xd")).agg(F.count(F.lit(1)).alias("depth"))
    counted = groups.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    span = counted.agg(F.max("depth").alias("top")).where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("depth"))
    return span.join(counted, "depth", "left").select("depth", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def sorted_duplicate_depths(records: DataFrame, stretch: int = 1 << 20) -> DataFrame:
    """The same where only adjacent equal places (by ``ordinal``) form a group, as in a sorted file.

    Runs are numbered inside stretches of so many ordinals; a stretch's first run goes on
    that of the one before if the places are equal, so no task sorts a file.
    """
    own = records.where(is_mapped()).withColumn("__at", F.floor(F.col("ordinal") / stretch))
    inside = Window.partitionBy("file", "__at").orderBy("ordinal")
    same = F.lag("rname").over(inside).eqNullSafe(F.col("rname")) & F.lag("pos").over(inside).eqNullSafe(F.col("pos")) & (F.row_number().over(inside) > 1)
    runs = own.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(inside))
    place = F.struct("rname", "pos")
    ends = runs.groupBy("file", "__at").agg(F.max("__run").alias("runs"), F.min_by(place, "ordinal").alias("first"), F.max_by(place, "ordinal").alias("last"))
    order = Window.partitionBy("file").orderBy("__at")  # a row a stretch
    ends = ends.withColumn("on", F.coalesce(F.lag("last").over(order) == F.col("first"), F.lit(False)).cast("long"))
    upto = F.sum(F.col("runs") - F.col("on")).over(order) - F.col("runs")
    runs = runs.join(sized(ends.select("file", "__at", upto.alias("__before"))), ["file", "__at"])
    groups = runs.groupBy("file", F.col("__before") + F.col("__run"), F.coalesce(tag("XD"), F.lit("null")).alias("xd")).agg(F.count(F.lit(1)).alias("depth"))
    return groups.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


# Tags and names

def barcodes_from_name(records: DataFrame, name: str = "XD") -> DataFrame:
    """Barcodes at the end of the read name moved to a tag ``first_second_length``.

    ``error`` marks names whose last field isn't DNA of even length; those are unchanged.
    """
    last = F.element_at(F.split("qname", ":"), -1)
    half = (F.char_length(last) / 2).cast("int")
    ok = is_dna(last) & (F.char_length(last) % 2 == 0)
    value = F.concat_ws("_", F.left(last, half), F.right(last, half), F.char_length("seq"))
    cut = F.substring(F.col("qname"), F.lit(1), F.instr("qname", F.concat(F.lit(":"), last)) - 1)
    marked = records.withColumns({"error": F.when(~F.coalesce(ok, F.lit(False)), "no barcodes in the read name"), "__value": value, "__cut": cut})
    done = with_tag(marked, name, F.col("__value")).where("error IS NULL").withColumn("qname", F.col("__cut"))
    return done.unionByName(marked.where("error IS NOT NULL")).drop("__value", "__cut")


def rebuild_duplicates_tag(records: DataFrame, p5_tag: str | None = None, p7_tag: str | None = None) -> DataFrame:
    """XD as ``[p5]_[p7]_length`` from other tags; a named but absent tag is the text ``null``."""
    part = lambda n: F.lit("") if n is None else F.coalesce(tag(n), F.lit("null"))
    marked = records.withColumn("__value", F.concat_ws("_", part(p5_tag), part(p7_tag), F.char_length("seq")))
    return with_tag(marked, "XD", F.col("__value")).drop("__value")


# Read groups

def assign_read_groups(records: DataFrame, label: str, date: str, sample: str, library: str | None = None, platform: str = "ILLUMINA", center: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with RG and short names, and the read groups their names call for.

    Names are ``instrument:run:flowcell:lane:tile:x:y``; a group is a flowcell and lane,
    described by its first record. ``date`` is ``yyyyMMdd``. Numbers that aren't raise.
    """
    parts = F.split("qname", ":")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")
    flowcell = F.get(parts, F.lit(2))
    when = F.date_format(F.to_date(F.lit(date), "yyyyMMdd"), "yyyyMMdd")
    named = records.withColumns({"__fc": flowcell, "__lane": number(3), "__run": number(1), "__inst": F.get(parts, F.lit(0))})
    rg = F.concat_ws("_", F.lit(label), when, "__fc", "__lane")
    groups = named.groupBy("__fc", "__lane").agg(F.min_by(F.struct("__inst", "__run"), F.struct("file", "ordinal")).alias("first")).select(
        rg.alias("id"), F.concat_ws(".", "__fc", "__lane").alias("platform_unit"), F.concat_ws(" ", "first.__inst", "first.__run").alias("platform_model"),
        F.lit(sample).alias("sample"), F.lit(library).cast("string").alias("library"), F.lit(platform).alias("platform"), F.lit(center).cast("string").alias("center"), when.alias("run_date"),
    )
    out = with_tag(named.withColumn("__rg", rg), "RG", F.col("__rg"))
    return out.withColumn("qname", F.concat_ws(":", number(4), number(5), number(6))).drop("__fc", "__lane", "__run", "__inst", "__rg"), groups


# The platforms the SAM specification allows.
PLATFORMS = ("CAPILLARY", "DNBSEQ", "ELEMENT", "HELICOS", "ILLUMINA", "IONTORRENT", "LS454", "ONT", "OTHER", "PACBIO", "SINGULAR", "SOLID", "ULTIMA")


def rewrite_read_groups(groups: DataFrame, sample: str | None = None, library: str | None = None, center: str | None = None, platform: str | None = None) -> DataFrame:
    """Read groups with given values put in; platforms the format does not allow become null.

    A given ``platform`` that isn't allowed raises.
    """
    if platform is not None and platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    out = groups.withColumn("platform", F.when(F.col("platform").isin(*PLATFORMS), F.col("platform")))
    given = {"sample": sample, "library": library, "center": center, "platform": platform}
    return out.withColumns({k: F.lit(v) for k, v in given.items() if v is not None})


def append_program(programs: DataFrame, program: str, version: str, command: str) -> DataFrame:
    """Program records with one more: the first free ``program.N``, chained to the last.

    ``programs`` is a header's: ``ordinal, id, name, version, command, previous``.
    """
    taken = F.coalesce(F.collect_set("id"), F.array().cast("array<string>"))
    free = F.filter(F.sequence(F.lit(1), F.count(F.lit(1)).cast("int") + 1), lambda i: ~F.array_contains(taken, F.concat(F.lit(f"{program}."), i.cast("string"))))
    new = programs.agg(
        (F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).cast(programs.schema["ordinal"].dataType).alias("ordinal"),
        F.concat(F.lit(f"{program}."), F.element_at(free, 1).cast("string")).alias("id"), F.lit(program).alias("name"), F.lit(version).alias("version"),
        F.lit(command).alias("command"), F.max_by("id", "ordinal").alias("previous"),
    )
    return programs.unionByName(new)


# Verification

def _identity(tags_checked: tuple[str, ...]) -> list[Column]:
    score = F.when(F.char_length("seq") <= 1, F.lit("")).otherwise(F.col("qual"))
    return [F.col("qname"), F.col("seq"), score.alias("qual"), F.col("flag").bitwiseAND(0xFFFF ^ DUPLICATE).alias("flag"), F.col("rname"), F.col("pos"), F.col("mapq"), F.col("cigar"), *[tag(t).alias(f"tag_{t}") for t in tags_checked]]


def same_records(a: DataFrame, b: DataFrame, tags_checked: tuple[str, ...] = ()) -> bool:
    """Equal multisets of records; duplicate bit, mates, lengths and other tags don't count."""
    x, y = (t.select(*_identity(tags_checked)) for t in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def verify_merge(check: DataFrame, inputs: DataFrame, check_sequences: DataFrame, input_sequences: DataFrame, tags_checked: tuple[str, ...] = (), stretch: int = 1 << 16) -> DataFrame:
    """One row ``matches, unmatched, disordered``: is ``check`` an interleaving of the ``inputs``?

    Both have ``file, ordinal`` (without gaps, as the sources number them); every record of the check file must be one of an input and
    the other way round, and along the check file the records of each input must keep their
    order. The k-th of equal records in the check file stands for the k-th in the inputs, in
    file and record order. Sequence dictionaries (``file, ordinal, name, length``) must agree.
    The places of the records that met are written once, so no side is computed twice.
    """
    identity = _identity(tags_checked)
    names = ["digest_a", "digest_b"]
    whole = F.to_json(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(identity)]), {"ignoreNullFields": "false"})
    digests = [F.xxhash64(whole).alias(names[0]), F.md5(whole).alias(names[1])]
    a = check.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("ordinal"), F.col("ordinal").cast("long").alias("at"), *digests)
    b = inputs.select("file", F.col("ordinal").cast("long").alias("ordinal"), F.lit(None).cast("long").alias("at"), *digests)
    is_check = F.col("at").isNotNull()
    copy = F.row_number().over(Window.partitionBy(*names, "side").orderBy("at", "file", "ordinal"))
    both = a.unionByName(b).withColumn("side", is_check).repartition(*names).withColumn("copy", copy)
    met = both.groupBy(*names, "copy").agg(F.max("file").alias("file"), F.max("ordinal").alias("ordinal"), F.max("at").alias("at"))
    met = written(met.select("file", "ordinal", "at"), "merge")
    # Each stretch of a file with the last record before it, which is compared with none itself.
    placed = met.where("at IS NOT NULL AND file IS NOT NULL").withColumn("stretch", F.floor(F.col("ordinal") / stretch))
    stretches = placed.unionByName(placed.where((F.col("ordinal") + 1) % stretch == 0).withColumn("stretch", F.col("stretch") + 1))
    before = Window.partitionBy("file", "stretch").orderBy("ordinal")
    back = (F.lag("ordinal").over(before) + 1 == F.col("ordinal")) & (F.lag("at").over(before) > F.col("at"))
    lost = met.agg(F.sum((F.col("at").isNull() | F.col("file").isNull()).cast("long")).alias("unmatched"))
    turned = stretches.select(back.alias("back")).agg(F.sum(F.coalesce(F.col("back"), F.lit(False)).cast("long")).alias("disordered"))
    dictionary = lambda d: d.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "name", "length")))).alias("d"))
    kinds = dictionary(check_sequences).unionByName(dictionary(input_sequences)).agg(F.countDistinct("d").alias("kinds"))
    out = lost.crossJoin(turned).crossJoin(kinds)  # three tables of one row
    lost_n, turned_n = F.coalesce("unmatched", F.lit(0).cast("long")), F.coalesce("disordered", F.lit(0).cast("long"))
    return out.select(((lost_n == 0) & (turned_n == 0) & (F.col("kinds") <= 1)).alias("matches"), lost_n.alias("unmatched"), turned_n.alias("disordered"))


def unmatched_records(check: DataFrame, inputs: DataFrame, tags_checked: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """``side, file, ordinal, record``: the first ``most`` records (a report) that have no partner on the other side."""
    record = F.to_json(F.struct(*_identity(tags_checked))).alias("record")
    sides = [t.select(F.lit(name).alias("side"), "file", "ordinal", record) for name, t in (("check", check), ("input", inputs))]
    copy = F.row_number().over(Window.partitionBy("side", "record").orderBy("file", "ordinal"))
    each = sides[0].unionByName(sides[1]).withColumn("copy", copy)
    alone = each.groupBy("record", "copy").agg(F.count(F.lit(1)).alias("n"), F.first("side").alias("side"), F.first("file").alias("file"), F.first("ordinal").alias("ordinal")).where("n = 1")
    return alone.select("side", "file", "ordinal", "record").orderBy("side", "file", "ordinal").limit(most)


def record_counts(records: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    return count_labels(records, key, label)
