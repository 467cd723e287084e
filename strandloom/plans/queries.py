"""Queries over the derived views, each with its oracle as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import cigar, dna, headers, keys
from ..operators import alignments as al, barcodes as bc, counts, screening
from ..sources import text
from . import views
from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


READS = duck(views.READS)
RC = "reverse(translate({0}, 'ACGTNacgtn', 'TGCANtgcan'))"


# Scalar functions

@query("p01_reverse_complement", f"SELECT k, {RC.format('short1')} AS rc FROM ({READS})")
def _(s, d):
    return view(s, d, views.READS).select("k", dna.reverse_complement("short1").alias("rc"))


@query("p02_dna_validation", f"SELECT k, regexp_full_match(short1, '[ACGTNacgtn]*') AS ok, regexp_full_match(qual, '[ACGTNacgtn]*') AS bad, length(seq) = length(qual) AS is_read FROM ({READS})")
def _(s, d):
    return view(s, d, views.READS).select("k", dna.is_dna(dna.checked_dna("short1")).alias("ok"), dna.is_dna("qual").alias("bad"), dna.read_is_valid("seq", "qual").alias("is_read"))


@query("p03_hamming_distance", f"SELECT k, CAST(hamming(short1, short2) AS INT) AS distance FROM ({READS})")
def _(s, d):
    return view(s, d, views.READS).select("k", dna.hamming("short1", "short2").alias("distance"))


@query("p04_phred", f"""SELECT k, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS total,
  array_to_string(list_transform(string_split(qual, ''), lambda c: chr(ascii(c) - 1)), '') AS lower_text FROM ({READS})""")
def _(s, d):
    scores = dna.phred("qual")
    less = dna.phred_text(F.transform(scores, lambda q: q - 1))
    return view(s, d, views.READS).select("k", F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), less.alias("lower_text"))


@query("p05_error_probability", f"SELECT k, CAST(round(pow(10, -(ascii(qual) - 33) / 10.0) * 1000000) AS BIGINT) AS ppm FROM ({READS})")
def _(s, d):
    return view(s, d, views.READS).select("k", F.round(dna.error_probability(F.ascii("qual") - 33) * 1e6).cast("long").alias("ppm"))


@query("p06_subsequence", f"SELECT k, substr(seq, CAST(k % 10 AS INT) + 1, 20) AS part, reverse(qual) AS turned FROM ({READS})")
def _(s, d):
    at = (F.col("k") % 10).cast("int")
    return view(s, d, views.READS).select("k", dna.subsequence("seq", at, at + 20).alias("part"), F.reverse("qual").alias("turned"))


@query("p07_trim_unknown", f"SELECT k, regexp_replace(short1, '[Nn]+$', '') AS trimmed, left(qual, length(regexp_replace(short1, '[Nn]+$', ''))) AS q FROM ({READS})")
def _(s, d):
    return view(s, d, views.READS).select("k", dna.trim_unknown("short1").alias("trimmed"), dna.trim_to("qual", dna.trim_unknown("short1")).alias("q"))


_HEADERS = f"""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '@FCABC' || CAST(100000 + o_orderkey % 7 AS STRING) || ':1:1101:' || CAST(o_orderkey % 99 AS STRING) || ':7/2'
  WHEN o_orderkey % 4 = 1 THEN 'NS2:run' || ':FCY:2:11:3:' || {views.K} || ';a1_b2_Q1.1_Q2.2 1:Y:0:ACGT'
  WHEN o_orderkey % 4 = 2 THEN '@NS2:7:FCY:2:11:3:' || {views.K} || ':TTAG x:N:18'
  ELSE '@broken ' || {views.K} END AS line FROM {{orders}}"""
_PARTS = ("instrument", "run", "flowcell", "lane", "tile", "x", "y", "key", "umi", "read", "filtered", "control", "index")


@query("p08_header_parse", f"""
SELECT k, CASE m WHEN 0 THEN '' WHEN 3 THEN NULL ELSE 'NS2' END AS instrument, CAST(CASE m WHEN 2 THEN 7 WHEN 3 THEN NULL ELSE 0 END AS INT) AS run,
  CASE m WHEN 0 THEN 'FCABC' WHEN 3 THEN NULL ELSE 'FCY' END AS flowcell, CAST(CASE m WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 2 END AS INT) AS lane,
  CAST(CASE m WHEN 0 THEN 1101 WHEN 3 THEN NULL ELSE 11 END AS INT) AS tile, CAST(CASE m WHEN 0 THEN k % 99 WHEN 3 THEN NULL ELSE 3 END AS INT) AS x,
  CAST(CASE m WHEN 0 THEN 7 WHEN 3 THEN NULL ELSE k END AS INT) AS y, CASE m WHEN 1 THEN 'a1_b2_Q1.1_Q2.2' END AS key, CASE m WHEN 2 THEN 'TTAG' END AS umi,
  CAST(CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS INT) AS read, CASE m WHEN 1 THEN true WHEN 3 THEN NULL ELSE false END AS filtered,
  CAST(CASE m WHEN 2 THEN 18 WHEN 3 THEN NULL ELSE 0 END AS INT) AS control, CASE m WHEN 1 THEN 'ACGT' WHEN 3 THEN NULL ELSE '' END AS index
FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS m FROM orders)""")
def _(s, d):
    rows = view(s, d, _HEADERS).select("k", headers.parse_header("line").alias("h"))
    return rows.select("k", *[F.col(f"h.{p}").alias(p) for p in _PARTS])


@query("p09_header_equality", f"""
SELECT ordinal AS k, true AS same_but_read, false AS same, ordinal % 2 = 0 AS same_place FROM ({duck(views.PAIRS)})""")
def _(s, d):
    rows = view(s, d, views.PAIRS).withColumns({"a": headers.parse_header("r1_header"), "b": headers.parse_header("r2_header")})
    rows = rows.withColumn("c", F.col("b").withField("x", F.when(F.col("ordinal") % 2 == 0, F.col("b.x")).otherwise(F.col("b.x") + 1)))
    a = F.col("a")
    return rows.select(F.col("ordinal").alias("k"), headers.same_but_read(a, F.col("b")).alias("same_but_read"), headers.same_header(a, F.col("b")).alias("same"), headers.same_but_read(a, F.col("c")).alias("same_place"))


@query("p10_read_group", f"SELECT ordinal AS k, 'PM:NS1' || chr(9) || 'PU:FCX.12.1' AS read_group FROM ({duck(views.PAIRS)})")
def _(s, d):
    return view(s, d, views.PAIRS).select(F.col("ordinal").alias("k"), headers.read_group(headers.parse_header("r1_header")).alias("read_group"))


_ALN = duck(views.ALIGNMENTS)


@query("p11_keys", f"""
SELECT qname, string_split(full_key, '_')[1] AS i5, string_split(full_key, '_')[3] AS p5,
  string_split(full_key, '_')[1] || '_' || string_split(full_key, '_')[2] || '__' AS pair FROM ({_ALN})""")
def _(s, d):
    rows = view(s, d, views.ALIGNMENTS).withColumn("p", keys.parse_key("full_key"))
    return rows.select("qname", "p.i5", "p.p5", keys.key_text(F.col("p.i5"), F.col("p.i7")).alias("pair"))


@query("p12_flatten_key", f"SELECT qname, regexp_replace(full_key, '\\.[0-9]+', '', 'g') AS flat FROM ({_ALN})")
def _(s, d):
    return view(s, d, views.ALIGNMENTS).select("qname", keys.flatten_key("full_key").alias("flat"))


# Barcodes

def _sets(s, d):
    return tuple(bc.reference_set(view(s, d, v)) for v in (views.I5_LINES, views.I7_LINES, views.BARCODE_LINES))


def _reference(lines: str) -> str:
    return f"""SELECT label, i AS ordinal, CASE WHEN n > 1 THEN label || '.' || CAST(i AS VARCHAR) ELSE label END AS augmented_label, m AS barcode, CAST(length(m) AS INT) AS length
    FROM (SELECT string_split(value, ' ')[2] AS label, CAST(unnest(generate_series(1, len(string_split(string_split(value, ' ')[1], ':')))) AS INT) AS i,
                 unnest(string_split(string_split(value, ' ')[1], ':')) AS m, len(string_split(string_split(value, ' ')[1], ':')) AS n FROM ({duck(lines)}))"""


@query("s05_reference_set", f"SELECT * FROM ({_reference(views.BARCODE_LINES)}) UNION ALL SELECT * FROM ({_reference(views.I7_LINES)})")
def _(s, d):
    _, i7, sets = _sets(s, d)
    return sets.unionByName(i7)


@query("p13_label_length", f"SELECT l AS label, coalesce(length, 0) AS length FROM (SELECT DISTINCT 'Q' || CAST(p_partkey % 20 AS VARCHAR) AS l FROM part) LEFT JOIN (SELECT DISTINCT label, length FROM ({_reference(views.BARCODE_LINES)})) r ON r.label = l")
def _(s, d):
    labels = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("Q"), (F.col("p_partkey") % 20).cast("string")).alias("label")).distinct()
    return bc.label_length(labels, "label", _sets(s, d)[2], "length")


def _nearest(seq: str, lines: str) -> str:
    return f"""SELECT q, arg_min(augmented_label, (dist, augmented_label)) AS label FROM (
      SELECT q, augmented_label, hamming(q, barcode) AS dist FROM (SELECT DISTINCT {seq} AS q FROM pairs), ({_reference(lines)}) r WHERE length(q) = r.length) WHERE dist <= 1 GROUP BY q"""


_KEYED = f"""
pairs AS MATERIALIZED ({duck(views.PAIRS)}), n5 AS ({_nearest('i2_seq', views.I5_LINES)}), n7 AS ({_nearest('i1_seq', views.I7_LINES)}),
b5 AS ({_nearest('left(r1_seq, 7)', views.BARCODE_LINES)}), b7 AS ({_nearest('left(r2_seq, 7)', views.BARCODE_LINES)}),
keyed AS (SELECT pairs.*, n5.label AS i5, n7.label AS i7, CASE WHEN b5.label IS NOT NULL AND b7.label IS NOT NULL THEN b5.label END AS p5,
                 CASE WHEN b5.label IS NOT NULL AND b7.label IS NOT NULL THEN b7.label END AS p7
          FROM pairs LEFT JOIN n5 ON n5.q = i2_seq LEFT JOIN n7 ON n7.q = i1_seq LEFT JOIN b5 ON b5.q = left(r1_seq, 7) LEFT JOIN b7 ON b7.q = left(r2_seq, 7)),
full_keys AS (SELECT *, i5 || '_' || i7 || '_' || coalesce(p5, '') || '_' || coalesce(p7, '') AS key FROM keyed)"""


@query("j02_nearest_barcode", f"WITH {_KEYED} SELECT ordinal AS k, i5, i7 FROM keyed")
def _(s, d):
    i5, i7, _ = _sets(s, d)
    out = bc.nearest_label(view(s, d, views.PAIRS), F.col("i2_seq"), i5, "i5")
    return bc.nearest_label_by_search(out, "i1_seq", i7, "i7").select(F.col("ordinal").alias("k"), "i5", "i7")


@query("j03_experiment_key", f"WITH {_KEYED} SELECT ordinal AS k, key FROM full_keys")
def _(s, d):
    return bc.experiment_keys(view(s, d, views.PAIRS), *_sets(s, d)).select(F.col("ordinal").alias("k"), "key")


_FLAT = "regexp_replace({0}, '\\.[0-9]+', '', 'g')"
_C1 = f"""SELECT i5 || '_' || i7 || '__' AS key, CASE WHEN p5 IS NULL THEN 'without_barcodes' ELSE {_FLAT.format('p5')} || '_' || {_FLAT.format('p7')} END AS label, count(*) AS n
FROM full_keys WHERE key IS NOT NULL GROUP BY ALL"""


def _pair_counts(s, d):
    return counts.barcode_pair_counts(bc.experiment_keys(view(s, d, views.PAIRS), *_sets(s, d)))


@query("c01_barcode_count", f"WITH {_KEYED} {_C1}")
def barcode_count(s, d):
    return _pair_counts(s, d).select("key", "label", "n")


@query("c01_total", "SELECT count(*) AS total FROM orders")
def _(s, d):
    return screening.total(view(s, d, views.PAIRS))


_LENGTHS = f"""WITH {_KEYED}, c AS ({_C1}), r AS (SELECT key, n, max(label) AS label FROM c GROUP BY key, n),
t AS (SELECT *, CASE WHEN label = 'without_barcodes' THEN 0 ELSE 7 END AS len, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rk FROM r)
SELECT a.key, CAST(CASE WHEN a.len = 0 AND CAST(b.n AS FLOAT) > CAST(0.05 AS FLOAT) * CAST(a.n AS FLOAT) THEN b.len ELSE a.len END AS INT) AS length
FROM t a LEFT JOIN t b ON a.key = b.key AND b.rk = 2 WHERE a.rk = 1"""


def _prior(s, d):
    lengths = _sets(s, d)[2].where("ordinal = 1").select("label", "length")
    return counts.barcode_lengths_from_counts(_pair_counts(s, d).withColumn("label_ordinal", F.dense_rank().over(Window.partitionBy("key").orderBy("label"))), lengths)


@query("a13_length_from_counts", _LENGTHS)
def _(s, d):
    return _prior(s, d)


# Merge and screen

_MERGED = f"""{_KEYED},
m0 AS (SELECT ordinal AS k, key, CASE WHEN p5 IS NULL THEN 0 ELSE 7 END AS cut, r1_seq, r1_qual, r2_seq, r2_qual, ordinal % 11 = 0 AS filtered FROM full_keys WHERE key IS NOT NULL),
m1 AS (SELECT k, key, filtered, regexp_replace(substr(r1_seq, cut + 1), '[Nn]+$', '') AS a, substr(r1_qual, cut + 1) AS aq, regexp_replace(substr(r2_seq, cut + 1), '[Nn]+$', '') AS b0, substr(r2_qual, cut + 1) AS bq0 FROM m0),
m AS MATERIALIZED (SELECT k, key, filtered, a, aq, {RC.format('b0')} AS b, reverse(left(bq0, length(b0))) AS bq FROM m1),
tries AS (SELECT *, unnest(generate_series(30 - length(b), length(a) - 15)) AS off FROM m),
diffs AS (
  SELECT k, off, i, CASE WHEN ascii(substr(aq, CAST(greatest(off, 0) + i + 1 AS BIGINT), 1)) >= 53 AND ascii(substr(bq, CAST(greatest(-off, 0) + i + 1 AS BIGINT), 1)) >= 53 THEN 3 ELSE 1 END AS pen
  FROM (SELECT *, unnest(generate_series(0, least(length(a) - greatest(off, 0), length(b) - greatest(-off, 0)) - 1)) AS i FROM tries)
  WHERE substr(a, CAST(greatest(off, 0) + i + 1 AS BIGINT), 1) <> substr(b, CAST(greatest(-off, 0) + i + 1 AS BIGINT), 1)),
runs AS (SELECT k, off, i, sum(pen) OVER (PARTITION BY k, off ORDER BY i) AS run FROM diffs),
bad AS (SELECT DISTINCT k, off FROM runs WHERE (i <= 15 AND run > 3) OR (i > 15 AND run * 15 > i * 3)),
good AS (SELECT t.k, t.off FROM tries t ANTI JOIN bad ON bad.k = t.k AND bad.off = t.off),
one AS (SELECT k, min(off) AS off FROM good GROUP BY k HAVING count(*) = 1),
bases AS (
  SELECT k, i, CASE WHEN i < off OR i < length(a) THEN substr(a, CAST(i + 1 AS BIGINT), 1) END AS x, ascii(substr(aq, CAST(i + 1 AS BIGINT), 1)) - 33 AS xq, i < length(a) AS in_a, i >= off AS in_b,
         CASE WHEN i >= off THEN substr(b, CAST(i - off + 1 AS BIGINT), 1) END AS y, CASE WHEN i >= off THEN ascii(substr(bq, CAST(i - off + 1 AS BIGINT), 1)) - 33 END AS yq
  FROM (SELECT m.*, one.off, unnest(generate_series(0, length(b) + one.off - 1)) AS i FROM m JOIN one ON m.k = one.k)),
merged AS (
  SELECT k, string_agg(CASE WHEN NOT in_b THEN x WHEN NOT in_a THEN y WHEN x = y THEN upper(x) WHEN xq >= yq THEN upper(x) ELSE upper(y) END, '' ORDER BY i) AS merged_seq,
         string_agg(chr(33 + CAST(CASE WHEN NOT in_b THEN xq WHEN NOT in_a THEN yq WHEN x = y THEN least(greatest(xq, yq), 50) ELSE abs(yq - xq) END AS INT)), '' ORDER BY i) AS merged_qual
  FROM bases GROUP BY k),
screened AS (SELECT m.k, {_FLAT.format('m.key')} AS key, m.key AS full_key, filtered, merged_seq, merged_qual FROM m LEFT JOIN merged ON m.k = merged.k)"""


def _screening(s, d):
    i5, i7, sets = _sets(s, d)
    every = bc.lengths_descending(sets)[0]  # the views' barcodes are of one length
    pairs = i5.select(F.col("label").alias("a")).join(i7.select(F.col("label").alias("b")), F.lit(True))
    prior = pairs.select(F.concat_ws("_", "a", "b", F.lit(""), F.lit("")).alias("key"), F.lit(every).alias("length"))
    return view(s, d, views.PAIRS), i5, i7, sets, prior


def _screened(s, d, oligo=None):
    return screening.screen_pairs(*_screening(s, d), oligo=oligo)


@query("c02_screen_pairs", f"WITH {_MERGED} SELECT k, key, merged_seq, merged_qual FROM screened")
def _(s, d):
    return _screened(s, d).where("key IS NOT NULL").select(F.col("ordinal").alias("k"), "key", "merged_seq", "merged_qual")


_OLIGO = f"substr('{views.OLIGO}', CAST(i + 1 AS BIGINT), 1)"


def _oligo_hit(text: str) -> str:
    n = len(views.OLIGO)
    return f"""SELECT k FROM screened WHERE merged_seq IS NOT NULL AND k NOT IN (
      SELECT k FROM (SELECT k, i, sum(CASE WHEN ascii(substr(merged_qual, CAST(i + 1 AS BIGINT), 1)) >= 53 THEN 3 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run
        FROM (SELECT k, merged_seq, merged_qual, unnest(generate_series(0, least({n}, length(merged_seq)) - 1)) AS i FROM screened WHERE merged_seq IS NOT NULL)
        WHERE substr(merged_seq, CAST(i + 1 AS BIGINT), 1) <> substr({text}, CAST(i + 1 AS BIGINT), 1))
      WHERE (i <= {n} AND run > 3) OR (i > {n} AND run * {n} > i * 3))"""


@query("a04_screen_counts", f"""WITH {_MERGED}, oligos AS ({_oligo_hit(f"'{views.OLIGO}'")} UNION {_oligo_hit(RC.format(f"'{views.OLIGO}'"))}),
t AS (SELECT key, count(*) AS raw, count(*) FILTER (WHERE k IN (SELECT k FROM oligos)) AS oligo, count(*) FILTER (WHERE merged_seq IS NOT NULL AND NOT filtered) AS merged FROM screened GROUP BY key)
SELECT key, label, n FROM t UNPIVOT (n FOR label IN (raw, oligo, merged)) WHERE n > 0""")
def _(s, d):
    return screening.screen_counts(_screened(s, d, views.OLIGO)).select("key", "label", "n")


@query("k01_striped_reads", f"""WITH {_MERGED}, w AS (SELECT s.*, p.lane_id, p.r1_header FROM screened s JOIN pairs p ON p.ordinal = s.k WHERE merged_seq IS NOT NULL AND NOT filtered)
SELECT CAST((row_number() OVER (PARTITION BY lane_id ORDER BY k) - 1) % 25 + 1 AS INT) AS stripe, lane_id, k AS ordinal,
  string_split(r1_header, ' ')[1] || ';' || full_key || ' ' || string_split(r1_header, ' ')[2] AS header, merged_seq AS seq, merged_qual AS qual FROM w""")
def _(s, d):
    return screening.striped(_screened(s, d), stretch=1000).withColumn("stripe", F.col("stripe").cast("int"))


@query("k05_read_group", f"""WITH {_KEYED} SELECT DISTINCT 'PM:' || substr(string_split(r1_header, ':')[1], 2) || chr(9) || 'PU:' || string_split(r1_header, ':')[3] || '.' || string_split(r1_header, ':')[2] || '.'
  || string_split(r1_header, ':')[4] AS read_group FROM full_keys WHERE key IS NOT NULL""")
def _(s, d):
    return screening.check_read_groups(screening.keyed_pairs(*_screening(s, d)))


# Counters

_COUNTS = duck(views.COUNTS)


def _counter(s, d):
    return view(s, d, views.COUNTS).withColumn("label_ordinal", F.row_number().over(Window.partitionBy("key").orderBy("label")))


@query("a02_combine_counters", f"SELECT key, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM ({_COUNTS}) UNION ALL SELECT * FROM ({_COUNTS}) WHERE n > 2) GROUP BY ALL")
def _(s, d):
    c = _counter(s, d)
    return counts.combine(c, c.where("n > 2")).select("key", "label", "n")


@query("a14_point_lookup", f"SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM ({_COUNTS}) WHERE key = '1' AND label = 'click'")
def _(s, d):
    return counts.lookup(_counter(s, d), "1", "click")


@query("k03_counter_text", f"""SELECT key, key || chr(9) || string_agg(label || chr(9) || CAST(n AS VARCHAR), chr(9) ORDER BY label) AS line,
  CAST(coalesce(sum(n) FILTER (WHERE label = 'click'), 0) AS BIGINT) AS "by" FROM ({_COUNTS}) GROUP BY key""")
def _(s, d):
    return counts.sorted_text(_counter(s, d), "click")


@query("s06_counter_parse", f"SELECT key, label, n FROM ({_COUNTS})")
def _(s, d):
    """Text written by ``rows_as_text`` and parsed back."""
    lines = counts.rows_as_text(_counter(s, d)).select(F.col("line").alias("value"), F.xxhash64("key").bitwiseAND(F.lit((1 << 31) - 1)).alias("ordinal")).withColumn("ordinal", F.col("ordinal") + 1)
    return text.parse_counter(lines)[0].select("key", "label", "n")


@query("l01_select_samples", f"""SELECT key FROM (SELECT key, n, CAST(key AS BIGINT) AS ordinal FROM ({_COUNTS}) WHERE label = 'click') WHERE (ordinal < 20 OR n >= 4) AND n >= 2""")
def _(s, d):
    c = _counter(s, d)
    order = c.select("key", F.col("key").cast("long").alias("ordinal")).distinct()
    return counts.select_samples(c, order, "click", top=20, minimum=2, threshold=4).select("key")


# Alignments

def _join_records(columns: str, where: str = "true") -> str:
    return f"SELECT {columns} FROM ({_ALN}) WHERE {where}"


@query("f01_mapped", _join_records("qname", "flag & 4 = 0"))
def _(s, d):
    return al_view(s, d).where(al.is_mapped()).select("qname")


def al_view(s, d):
    return views.alignments(s, d)


@query("f05_damage_restrict", _join_records("qname", "CAST(ds AS FLOAT) > CAST(1.5 AS FLOAT)"))
def _(s, d):
    return al.restrict_damage(al_view(s, d), 1.5).select("qname")


@query("p20_cigar_unroll", f"""SELECT qname, u, CASE CAST(CAST(string_split(qname, ':')[7] AS BIGINT) % 8 AS INT) WHEN 0 THEN repeat('M', 50) ELSE u END = u AS same, cigar AS again FROM (
  SELECT qname, cigar, array_to_string(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda r: repeat(right(r, 1), CAST(left(r, length(r) - 1) AS INT))), '') AS u FROM ({_ALN}))""")
def _(s, d):
    rows = al_view(s, d).select("qname", cigar.unroll("cigar").alias("u"))
    same = F.when(F.element_at(F.split("qname", ":"), 7).cast("long") % 8 == 0, F.repeat(F.lit("M"), F.lit(50))).otherwise(F.col("u")) == F.col("u")
    return rows.select("qname", "u", same.alias("same"), cigar.reroll("u").alias("again"))


def _window_clip(n: str, hard: bool) -> str:
    """Clipping by running counts over single operators."""
    front = "'H'" if hard else "CASE WHEN reads THEN 'S' ELSE 'H' END"
    return f"""
src AS (SELECT CAST(string_split(qname, ':')[7] AS BIGINT) AS k, *, array_to_string(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda r: repeat(right(r, 1), CAST(left(r, length(r) - 1) AS INT))), '') AS u,
         {n} AS n FROM ({_ALN})),
ops AS (SELECT k, n, i, substr(u, CAST(i AS BIGINT), 1) AS op, substr(u, CAST(i AS BIGINT), 1) IN ('M', 'I', 'S') AS reads, substr(u, CAST(i AS BIGINT), 1) IN ('M', 'D', 'N') AS refs
        FROM (SELECT k, n, u, unnest(generate_series(1, length(u))) AS i FROM src)),
seen AS (SELECT *, coalesce(sum(reads::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                coalesce(sum(reads::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM ops),
cl AS (SELECT k, string_agg(CASE WHEN before < n OR after < n THEN {front} ELSE op END, '' ORDER BY i) AS v, sum((before < n AND refs)::INT) AS l, sum((after < n AND refs)::INT) AS r FROM seen GROUP BY k),
md AS (SELECT src.*, v, l, r, array_to_string(list_transform(regexp_extract_all(md, '([0-9]+|\\^[A-Z]+|[A-Z])'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN repeat('m', TRY_CAST(t AS INT)) WHEN starts_with(t, '^') THEN lower(substr(t, 2)) ELSE t END), '') AS e
       FROM src JOIN cl ON cl.k = src.k),
cut AS (SELECT *, substr(e, CAST(l + 1 AS BIGINT), CAST(greatest(0, length(e) - l - r) AS BIGINT)) AS e2 FROM md),
rolled AS (SELECT *, array_to_string(list_transform(regexp_extract_all(v, 'S+|M+|D+|I+|N+|H+'), lambda x: CAST(length(x) AS VARCHAR) || left(x, 1)), '') AS cigar2,
  array_to_string(list_transform(regexp_extract_all(e2, 'm*(?:[ACGTN]|[acgtn]+)'), lambda x: CAST(length(x) - length(replace(x, 'm', '')) AS VARCHAR) || CASE WHEN regexp_matches(x, '[acgtn]$') THEN '^' ELSE '' END || upper(replace(x, 'm', ''))), '')
    || CAST(length(regexp_extract(e2, '(m*)$', 1)) AS VARCHAR) AS md2,
  length(v) - length(replace(v, 'I', '')) + length(replace(e2, 'm', '')) AS nm2 FROM cut)"""


@query("p21_soft_clip", f"WITH {_window_clip('(2 + CAST(string_split(qname, chr(58))[7] AS BIGINT) % 3)', False)} SELECT qname, CAST(pos + l AS INT) AS pos, cigar2 AS cigar, md2 AS md, CAST(nm2 AS INT) AS nm FROM rolled")
def _(s, d):
    n = (F.element_at(F.split("qname", ":"), 7).cast("long") % 3 + 2).cast("int")
    out = cigar.clip_both_ends(al_view(s, d), n)
    return out.where("clip_error IS NULL").select("qname", "pos", "cigar", "md", "nm")


@query("c08_hard_clip", f"WITH {_window_clip('3', True)} SELECT qname, CAST(pos + l AS INT) AS pos, cigar2 AS cigar, md2 AS md, CAST(nm2 AS INT) AS nm, substr(seq, 4, 44) AS seq FROM rolled WHERE position('M' IN v) > 0")
def _(s, d):
    sq = al_view(s, d).select(F.col("rname").alias("name"), F.lit(1_000_000).alias("length")).distinct()
    return al.clip(al_view(s, d), F.lit(3), sq, hard=True).select("qname", "pos", "cigar", "md", "nm", "seq")


@query("p24_clip_length", f"""SELECT qname, CAST(CASE WHEN library IN ('Lib1') THEN 10 WHEN library IN ('Lib2', 'Lib1') THEN 5 ELSE 2 END AS INT) AS clip_n
FROM ({_ALN}) a LEFT JOIN ({duck(views.READ_GROUPS)}) g ON a.rg = g.id""")
def _(s, d):
    groups = view(s, d, views.READ_GROUPS)
    return al.clip_length(al_view(s, d), groups, 2, ["Lib2", "Lib1"], 5, ["Lib1"], 10).select("qname", "clip_n")


@query("c04_demultiplex", f"""
SELECT qname, {_FLAT.format('full_key')} AS key, b5.barcode || '_' || b7.barcode || '_50' AS xd FROM ({_ALN}) a
LEFT JOIN ({_reference(views.BARCODE_LINES)}) b5 ON b5.augmented_label = string_split(full_key, '_')[3] LEFT JOIN ({_reference(views.BARCODE_LINES)}) b7 ON b7.augmented_label = string_split(full_key, '_')[4]""")
def _(s, d):
    return _split(s, d).select("qname", "key", al.tag("XD").alias("xd"))


def _split(s, d):
    named = al_view(s, d).withColumn("qname", F.concat_ws(";", "qname", "full_key"))
    return al.demultiplex(named, _sets(s, d)[2])


@query("a05_demultiplex_counts", f"SELECT key, label, n FROM (SELECT {_FLAT.format('full_key')} AS key, count(*) AS demultiplexed, count(*) FILTER (WHERE flag & 4 = 0) AS aligned FROM ({_ALN}) GROUP BY 1) UNPIVOT (n FOR label IN (demultiplexed, aligned)) WHERE n > 0")
def _(s, d):
    return al.demultiplex_counts(_split(s, d)).select("key", "label", "n")


@query("j06_selected_records", f"SELECT qname, {_FLAT.format('full_key')} AS file_name FROM ({_ALN}) WHERE string_split(full_key, '_')[1] IN ('a1', 'a3', 'a5')")
def _(s, d):
    split = _split(s, d)
    chosen = split.where(keys.parse_key("key")["i5"].isin("a1", "a3", "a5")).select("key")
    return al.selected_records(split, chosen).select("qname", "file_name")


@query("j04_filter_targets", f"""
WITH src AS (SELECT *, array_to_string(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda r: repeat(right(r, 1), CAST(left(r, length(r) - 1) AS INT))), '') AS u FROM ({_ALN}) WHERE flag & 4 = 0 AND mapq >= 20),
ops AS (SELECT qname, rname, pos, qual, i, substr(u, CAST(i AS BIGINT), 1) AS op FROM (SELECT *, unnest(generate_series(1, length(u))) AS i FROM src)),
spots AS (SELECT qname, rname, qual, op, pos - 1 + sum((op IN ('M', 'D', 'N'))::INT) OVER w AS refpos, sum((op IN ('M', 'I', 'S'))::INT) OVER w AS readpos FROM ops WINDOW w AS (PARTITION BY qname ORDER BY i)),
bases AS (SELECT qname, rname, refpos, op = 'M' AND ascii(substr(qual, CAST(readpos AS BIGINT), 1)) - 33 >= 25 AS good FROM spots WHERE op IN ('M', 'D', 'N')),
sites AS (SELECT DISTINCT chrom, start0, "end", unnest(generate_series(start0 + 1, "end")) AS p FROM ({duck(views.BED)})),
full_sites AS (SELECT qname, chrom, start0, "end" FROM bases JOIN sites ON rname = chrom AND refpos = p WHERE good GROUP BY ALL HAVING count(*) = "end" - start0)
SELECT DISTINCT qname FROM full_sites""")
def _(s, d):
    return al.filter_to_targets(al_view(s, d), view(s, d, views.BED), 20, 25).select("qname")


@query("j04_filter_targets_binned", None)
def _(s, d):
    """The same where the target list is too large to broadcast."""
    return al.filter_to_targets(al_view(s, d), view(s, d, views.BED), 20, 25, bed_rows=0).select("qname")


ORACLE_SQL["j04_filter_targets_binned"] = ORACLE_SQL["j04_filter_targets"]
_TARGETS = '{"first": "chr1", "some": ["chr1", "chr4", "chr7"], "none": "chrX"}'


@query("a06_target_counts", f"""WITH t(class, reference) AS (VALUES ('first', 'chr1'), ('some', 'chr1'), ('some', 'chr4'), ('some', 'chr7'), ('none', 'chrX')),
c AS (SELECT class, count(*) AS n, sum(length(seq)) AS bases FROM ({_ALN}) JOIN t ON rname = reference WHERE flag & 4 = 0 AND mapq >= 30 GROUP BY class)
SELECT 'sample' AS key, class AS label, n FROM c UNION ALL SELECT 'sample', class || '-coverageLength', CAST(bases AS BIGINT) FROM c""")
def _(s, d):
    return al.class_counts(al_view(s, d), al.target_classes(s, _TARGETS), "sample", 30).select("key", "label", "n")


@query("a07_length_histogram", f"""WITH c AS (SELECT CAST(length(seq) - (mapq % 5) AS INT) AS length, count(*) AS n FROM ({_ALN}) WHERE flag & 4 = 0 AND mapq >= 30 GROUP BY 1)
SELECT length, n, CAST(round(1e6 * n / sum(n) OVER ()) AS BIGINT) AS share, CAST(round(1e6 * sum(n) OVER (ORDER BY length) / sum(n) OVER ()) AS BIGINT) AS cumulative FROM c""")
def _(s, d):
    rows = al_view(s, d).withColumn("seq", F.expr("left(seq, length(seq) - mapq % 5)"))
    ppm = lambda c: F.round(F.lit(1e6) * F.col(c)).cast("long").alias(c)
    return al.length_histogram(rows, 30).select("length", "n", ppm("share"), ppm("cumulative"))


@query("a08_duplicate_depths", f"""WITH g AS (SELECT count(*) AS depth FROM ({duck(views.PLACED)}) WHERE flag & 4 = 0 GROUP BY rname, pos, coalesce(xd, 'null')),
h AS (SELECT depth, count(*) AS n FROM g GROUP BY depth)
SELECT s.depth, coalesce(h.n, 0) AS n FROM (SELECT unnest(generate_series(1, (SELECT max(depth) FROM g))) AS depth) s LEFT JOIN h ON h.depth = s.depth""")
def _(s, d):
    rows = view(s, d, views.PLACED)
    entry = F.map_from_entries(F.array(F.struct(F.lit("XD").alias("k"), F.struct(F.lit("Z").alias("type"), F.col("xd").alias("value")).alias("v"))))
    return al.duplicate_depths(rows.withColumn("tags", F.map_filter(entry, lambda _, v: v["value"].isNotNull())))


@query("p27_rebuild_duplicates_tag", f"SELECT qname, rg || '_null_50' AS xd FROM ({_ALN})")
def _(s, d):
    return al.rebuild_duplicates_tag(al_view(s, d), "RG", "ZZ").select("qname", al.tag("XD").alias("xd"))


@query("p28_barcodes_from_name", f"""SELECT qname, substr(s, 1, 4) || '_' || substr(s, 5, 4) || '_50' AS xd FROM (SELECT qname, substr(seq, 1, 8) AS s FROM ({_ALN}))""")
def _(s, d):
    named = al_view(s, d).withColumn("qname", F.concat_ws(":", "qname", F.left("seq", F.lit(8))))
    return al.barcodes_from_name(named).select("qname", al.tag("XD").alias("xd"))


@query("c09_assign_read_groups", f"""SELECT string_split(qname, ':')[5] || ':' || string_split(qname, ':')[6] || ':' || string_split(qname, ':')[7] AS qname,
  'lab_20240131_' || string_split(qname, ':')[3] || '_' || string_split(qname, ':')[4] AS rg FROM ({_ALN})""")
def _(s, d):
    return al.assign_read_groups(al_view(s, d), "lab", "20240131", "S1")[0].select("qname", al.tag("RG").alias("rg"))


@query("a10_distinct_read_groups", f"""SELECT DISTINCT 'lab_20240131_' || string_split(qname, ':')[3] || '_' || string_split(qname, ':')[4] AS id, string_split(qname, ':')[3] || '.' || string_split(qname, ':')[4] AS platform_unit,
  'NS1 12' AS platform_model, 'S1' AS sample, 'ILLUMINA' AS platform FROM ({_ALN})""")
def _(s, d):
    return al.assign_read_groups(al_view(s, d), "lab", "20240131", "S1")[1].select("id", "platform_unit", "platform_model", "sample", "platform")


@query("p30_read_group_rewrite", f"SELECT id, 'NewLib' AS library, sample, CASE WHEN platform = 'ILLUMINA' THEN platform END AS platform FROM ({duck(views.READ_GROUPS)})")
def _(s, d):
    return al.rewrite_read_groups(view(s, d, views.READ_GROUPS), library="NewLib").select("id", "library", "sample", "platform")


_IDENTITY = "qname, seq, qual, flag & 64511 AS flag, rname, pos, mapq, cigar, rg"


def _merge_check(kept: str) -> str:
    """Records on one side only, and records of a file whose order the merged file turns round."""
    return f"""WITH a AS ({_ALN}), merged AS (SELECT {_IDENTITY}, ordinal * 3 + CAST(substr(file, 3, 1) AS BIGINT) AS spot FROM a WHERE {kept}),
    inputs AS (SELECT {_IDENTITY}, file, ordinal FROM a), met AS (SELECT file, ordinal, spot FROM merged FULL JOIN inputs USING (qname, seq, qual, flag, rname, pos, mapq, cigar, rg)),
    n AS (SELECT count(*) FILTER (WHERE spot IS NULL OR file IS NULL) AS unmatched, (SELECT count(*) FROM met x JOIN met y ON x.file = y.file AND x.ordinal + 1 = y.ordinal AND x.spot > y.spot) AS disordered FROM met)
    SELECT unmatched = 0 AND disordered = 0 AS matches, CAST(unmatched AS BIGINT) AS unmatched, CAST(disordered AS BIGINT) AS disordered FROM n"""


@query("j11_verify_merge", _merge_check("true"))
def _(s, d):
    rows = al_view(s, d)
    merged = rows.withColumn("ordinal", F.col("ordinal") * 3 + F.substring("file", 3, 1).cast("long")).withColumn("file", F.lit("out.bam"))
    return al.verify_merge(merged, rows, *_dictionaries(s), ("RG",))


@query("j11_verify_lost_record", _merge_check("mapq <> 60"))
def _(s, d):
    rows = al_view(s, d)
    merged = rows.where("mapq <> 60").withColumn("ordinal", F.col("ordinal") * 3 + F.substring("file", 3, 1).cast("long")).withColumn("file", F.lit("out.bam"))
    return al.verify_merge(merged, rows, *_dictionaries(s))


def _dictionaries(s):
    make = lambda files: s.createDataFrame([(f, i, f"chr{i + 1}", 50_100) for f in files for i in range(24)], "file string, ordinal int, name string, length int")
    return make(["out.bam"]), make([f"in{i}.bam" for i in range(3)])


@query("p22_md_round_trip", f"SELECT qname, md, CAST(length(md) AS INT) AS n FROM ({_ALN})")
def _(s, d):
    return al_view(s, d).withColumn("e", cigar.md_expand("md")).select("qname", cigar.md_format("e").alias("md"), F.char_length("md").alias("n"))


@query("s13_key_from_file", f"SELECT DISTINCT string_split(file, '.bam')[1] AS key FROM ({_ALN})")
def _(s, d):
    return view(s, d, views.ALIGNMENTS).select(text.key_from_path(F.concat(F.lit("/x/y/"), F.col("file"))).alias("key")).distinct()


_SAME = f"WITH x AS (SELECT {_IDENTITY} FROM ({_ALN}))"


@query("u04_same_records", f"""{_SAME}, y AS (SELECT {_IDENTITY.replace('flag & 64511', '(flag | 1024) & 64511')} FROM ({_ALN})), z AS (SELECT * FROM x WHERE mapq > 0)
SELECT (SELECT count(*) FROM (FROM x EXCEPT ALL FROM y)) + (SELECT count(*) FROM (FROM y EXCEPT ALL FROM x)) = 0 AS same,
  (SELECT count(*) FROM (FROM x EXCEPT ALL FROM z)) + (SELECT count(*) FROM (FROM z EXCEPT ALL FROM x)) = 0 AS lost""")
def _(s, d):
    rows = al_view(s, d)
    marked = rows.withColumn("flag", F.col("flag").bitwiseOR(1024))
    return s.createDataFrame([(al.same_records(rows, marked), al.same_records(rows, rows.where("mapq > 0")))], "same boolean, lost boolean")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: barcode pair counts of fuzzily matched read pairs."""
    return barcode_count(spark, sf_dir)
