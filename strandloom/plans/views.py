"""Sequence-shaped views derived from the driver's tables.

The driver's tables hold no reads, so reads, pairs and alignments are derived from keys.
The text is SQL that both engines run; only what is computed *from* a view differs
between a query and its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HEX = "0123456789abcdef"
READ_LENGTH = 40
OLIGO = "ACGGTTCAGGATTTACCGCAGTAAGCTTACGGAT"


def _dna(text: str) -> str:
    """32 letters from a text."""
    return f"translate(md5({text}), '{HEX}', 'ACGTACGTACGTACGT')"


def _quals(text: str) -> str:
    return f"translate(md5({text}), '{HEX}', 'EEEEEEEEAAAA66//')"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


K = _text("o_orderkey")
READS = f"""
SELECT o_orderkey AS k, {_dna(K)} || {_dna(K + " || 'b'")} AS seq, {_quals(K + " || 'q'")} || {_quals(K + " || 'r'")} AS qual,
       substr({_dna(K)}, 1, 12) || CASE WHEN o_orderkey % 3 = 0 THEN 'NNnN' ELSE 'ACgT' END AS short1,
       substr({_dna(K + " || 'c'")}, 1, 16) AS short2
FROM {{orders}}"""


def _barcode(kind: str, number: str) -> str:
    return f"substr({_dna(f"'{kind}-' || {_text(number)}")}, 1, 7)"


I5_LINES = f"SELECT {_barcode('i5', 'p_partkey')} || ' a' || {_text('p_partkey')} AS value FROM {{part}} WHERE p_partkey < 24"
I7_LINES = f"SELECT {_barcode('i7', 'p_partkey')} || ' b' || {_text('p_partkey')} || ' ignored' AS value FROM {{part}} WHERE p_partkey < 20"
BARCODE_LINES = (
    "SELECT " + " || ':' || ".join(_barcode("bc", f"(p_partkey * 4 + {i})") for i in range(4)) + f" || ' Q' || {_text('p_partkey')} AS value FROM {{part}} WHERE p_partkey < 12"
)
_HEAD = "'@NS1:12:FCX:1:' || CAST(11101 + o_orderkey % 5 AS STRING) || ':' || CAST(o_orderkey % 1000 AS STRING) || ':' || " + K
_TAIL = "CASE WHEN o_orderkey % 11 = 0 THEN 'Y' ELSE 'N' END || ':0:ACGT'"
PAIRS = f"""
WITH f AS (
  SELECT o_orderkey, {_barcode('i5', '(o_orderkey % 24)')} AS i5, {_barcode('i7', '((o_orderkey * 7) % 20)')} AS i7,
         CASE WHEN o_orderkey % 9 = 0 THEN 'NNNNNNN' ELSE {_barcode('bc', '(o_orderkey % 48)')} END AS p5,
         {_barcode('bc', '((o_orderkey * 5) % 48)')} AS p7,
         CASE WHEN o_orderkey % 13 = 0 THEN '{OLIGO}' ELSE substr({_dna(K)} || {_dna(K + " || 'b'")}, 1, CAST(30 + o_orderkey % 30 AS INT)) END AS ins
  FROM {{orders}}),
g AS (
  SELECT *, p5 || substr(ins || 'AGATTGCAGGCATACCGTTAAGCCTAGGTTACCGATCGGA', 1, {READ_LENGTH}) AS s1,
         p7 || substr(reverse(translate(ins, 'ACGT', 'TGCA')) || 'CTTGACCAGTTAGCAACGGATTCAGGCCATTACAGTGCAT', 1, {READ_LENGTH}) AS s2
  FROM f)
SELECT 'L' || CAST(o_orderkey % 4 AS STRING) AS lane_id, o_orderkey AS ordinal,
       {_HEAD} || ' 1:' || {_TAIL} AS r1_header,
       CASE WHEN o_orderkey % 5 = 0 THEN substr(s1, 1, 19) || translate(substr(s1, 20, 1), 'ACGT', 'GTAC') || substr(s1, 21) ELSE s1 END AS r1_seq,
       substr({_quals(K + " || 'q1'")} || {_quals(K + " || 'q2'")}, 1, 47) AS r1_qual,
       {_HEAD} || ' 2:' || {_TAIL} AS r2_header,
       CASE WHEN o_orderkey % 17 = 0 THEN substr(s2, 1, 44) || 'NNN' ELSE s2 END AS r2_seq,
       substr({_quals(K + " || 'q3'")} || {_quals(K + " || 'q4'")}, 1, 47) AS r2_qual,
       {_HEAD} || ' 1:' || {_TAIL} AS i1_header,
       CASE WHEN o_orderkey % 7 = 0 THEN translate(substr(i7, 1, 1), 'ACGT', 'CGTA') || substr(i7, 2) ELSE i7 END AS i1_seq, 'EEEEEEE' AS i1_qual,
       {_HEAD} || ' 2:' || {_TAIL} AS i2_header,
       CASE WHEN o_orderkey % 23 = 0 THEN 'GGG' || substr(i5, 4) ELSE i5 END AS i2_seq, 'EEEEEEE' AS i2_qual
FROM g"""

# Consistent CIGAR and MD templates, one for each remainder of the key by 8.
TEMPLATES = (
    ("50M", "50"), ("20M1D30M", "20^A30"), ("20M2I28M", "48"), ("5S45M", "10A34"), ("45M5S", "0C44"), ("10M1I20M2D19M", "30^CC19"), ("2H50M", "25T24"), ("25M100N25M", "50"),
)


def _case(values) -> str:
    return "CASE CAST(o_orderkey % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ALIGNMENTS = f"""
SELECT 'in' || CAST(o_orderkey % 3 AS STRING) || '.bam' AS file, CAST(floor(o_orderkey / 3.0) AS BIGINT) AS ordinal,
       'NS1:12:FC' || CAST(o_orderkey % 2 AS STRING) || ':' || CAST(1 + o_orderkey % 4 AS STRING) || ':11101:' || CAST(o_orderkey % 1000 AS STRING) || ':' || {K} AS qname,
       CAST(CASE o_orderkey % 10 WHEN 0 THEN 4 WHEN 1 THEN 16 WHEN 2 THEN 1024 ELSE 0 END AS INT) AS flag,
       'chr' || CAST(1 + (o_orderkey * 3) % 24 AS STRING) AS rname, CAST(1 + (o_orderkey * 7) % 50000 AS INT) AS pos, CAST(o_orderkey % 61 AS INT) AS mapq,
       {_case(c for c, _ in TEMPLATES)} AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen,
       substr({_dna(K)} || {_dna(K + " || 'b'")}, 1, 50) AS seq, substr({_quals(K + " || 'q'")} || {_quals(K + " || 'r'")}, 1, 50) AS qual,
       {_case(m for _, m in TEMPLATES)} AS md, 'rg' || CAST(o_orderkey % 5 AS STRING) AS rg,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE substr({_dna(K)}, 1, 2) || '_50' END AS xd, CAST((o_orderkey % 50) / 10.0 - 1 AS STRING) AS ds,
       'a' || CAST(o_orderkey % 24 AS STRING) || '_b' || CAST((o_orderkey * 7) % 20 AS STRING) || '_Q' || CAST(o_orderkey % 12 AS STRING) || '.' || CAST(1 + o_orderkey % 4 AS STRING) || '_Q'
           || CAST((o_orderkey * 5) % 12 AS STRING) || '.2' AS full_key
FROM {{orders}}"""
PLACED = """
SELECT 'chr' || CAST(l_suppkey % 25 AS STRING) AS rname, CAST(1 + l_partkey * 7 % 500 AS INT) AS pos, CAST(CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS INT) AS flag,
       CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) ELSE 'AC_GT_' || CAST(l_linenumber AS STRING) END AS xd FROM {lineitem}"""
BED = """
SELECT 'chr' || CAST(1 + (p_partkey * 3) % 24 AS STRING) AS chrom, CAST((p_partkey * 13) % 50000 AS INT) AS start0,
       CAST((p_partkey * 13) % 50000 + 1 + 2 * (p_partkey % 2) AS INT) AS "end", p_name AS name FROM {part}"""
COUNTS = "SELECT CAST(user_id AS STRING) AS key, event_type AS label, count(*) AS n FROM {events} GROUP BY user_id, event_type"
READ_GROUPS = """
SELECT 'rg' || CAST(s_suppkey AS STRING) AS id, 'Lib' || CAST(s_suppkey % 4 AS STRING) AS library, s_name AS sample,
       CASE s_suppkey % 3 WHEN 0 THEN 'ILLUMINA' WHEN 1 THEN 'illumina' ELSE 'ABC' END AS platform, CAST(NULL AS STRING) AS center FROM {supplier}"""
_TABLES = ("orders", "lineitem", "part", "supplier", "events")


def view(spark: SparkSession, sf_dir: str, sql: str, spread: str | None = None) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``.

    Reads take some 25 microseconds a row to derive and a file is read by as many tasks as it has row groups,
    often few: rows are dealt out by the column ``spread`` before.
    """
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql}
    if spread:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        used = {t: rows.repartition(n, spread) for t, rows in used.items()}
    return spark.sql(sql.replace('"end"', "`end`"), **used)


def duck(sql: str) -> str:
    """The same text for the oracle's engine."""
    return sql.format(**{t: t for t in _TABLES})


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ALIGNMENTS`` with its tags as a map and an empty NM."""
    rows = view(spark, sf_dir, ALIGNMENTS)
    tags = {"MD": "md", "RG": "rg", "XD": "xd", "ds": "ds"}
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(t).alias("k"), F.struct(F.lit("Z").alias("type"), F.col(c).alias("value")).alias("v")) for t, c in tags.items()]))
    return rows.withColumns({"tags": F.map_filter(pairs, lambda _, v: v["value"].isNotNull()), "nm": F.lit(None).cast("int")})
