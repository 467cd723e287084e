"""Queries over sources and sinks, which write derived rows and read them back, and over single steps of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import merging
from ..functions.keys import parse_key
from ..functions.reads import make_read, same_keys, same_merged, same_reads
from ..operators import alignments as al, barcodes as bc, counts, screening
from ..sources import fastq, sam, text
from ..sources.places import new_folder, written
from . import views
from .queries import _ALN, _COUNTS, _FLAT, _KEYED, _MERGED, RC, READS, _counter, _dictionaries, _oligo_hit, _reference, _screened, _sets, al_view, query
from .views import duck, view


# Sources and sinks

_PAIRS = duck(views.PAIRS)


def _fastq_pairs(s: SparkSession, d: str) -> DataFrame:
    """The pairs written as four gzip files a lane and read back; lane L3 lacks the later half of its second reads."""
    pairs, root = written(view(s, d, views.PAIRS, "o_orderkey"), "pairs"), new_folder(s, "fastq")
    half = pairs.agg(F.max("ordinal") / 2).first()[0] or 0
    kept = (F.col("lane_id") != "L3") | (F.col("ordinal") <= half)
    own = pairs.withColumns({"stripe": F.substring("lane_id", 2, 1).cast("int") + 1, **{f"r2_{c}": F.when(kept, F.col(f"r2_{c}")) for c in ("header", "seq", "qual")}})
    made = fastq.write_pairs(own, root, is_table=True)
    return fastq.read_pairs(s, {f"L{k}": paths for k in range(4) if (paths := [f"{root}/{r}_{k + 1:03d}.fastq.gz" for r in fastq.READS])[0] in made})


_ZIPPED = f"""(SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY k) - 1 AS ordinal FROM (SELECT *, ordinal AS k FROM ({_PAIRS})) p
  WHERE lane_id <> 'L3' OR k <= (SELECT max(ordinal) / 2.0 FROM ({_PAIRS}) q)) z"""


@query("s01_fastq_scan", f"SELECT lane_id, z.ordinal, r1_header, r1_seq, r1_qual, i2_seq FROM {_ZIPPED.replace('SELECT *, ordinal AS k', 'SELECT * EXCLUDE ordinal, ordinal AS k')}")
def _(s, d):
    return _fastq_pairs(s, d).select("lane_id", "ordinal", "r1_header", "r1_seq", "r1_qual", "i2_seq")


@query("s02_positional_zip", f"SELECT lane_id, z.ordinal, r1_header, r2_header, r2_seq, i1_header, i2_header FROM {_ZIPPED.replace('SELECT *, ordinal AS k', 'SELECT * EXCLUDE ordinal, ordinal AS k')}")
def _(s, d):
    return _fastq_pairs(s, d).select("lane_id", "ordinal", "r1_header", "r2_header", "r2_seq", "i1_header", "i2_header")


_HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{i}\tLN:50100\n" for i in range(1, 25))
_SORTED = f"""SELECT row_number() OVER (ORDER BY CAST(substr(rname, 4) AS INT), pos, file, ordinal) - 1 AS ordinal, qname, flag, rname, pos, mapq, cigar, seq, qual, md, xd FROM ({_ALN})"""


def _written(s: SparkSession, d: str, kind: str) -> DataFrame:
    path = sam.write_alignments(al_view(s, d), _HEADER, f"{new_folder(s, kind)}.{kind}")
    return sam.read_alignments(s, [path]).select("ordinal", "qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", al.tag("MD").alias("md"), al.tag("XD").alias("xd"))


@query("s03_sam_scan", _SORTED)
def _(s, d):
    return _written(s, d, "sam")


@query("k06_bam_writer", _SORTED)
def _(s, d):
    return _written(s, d, "bam")


@query("s14_header_scan", f"SELECT rname AS name, CAST(max(pos) + 100 AS INT) AS length, row_number() OVER (ORDER BY rname) AS place FROM ({_ALN}) GROUP BY rname")
def _(s, d):
    rows = al_view(s, d)
    lengths = rows.groupBy("rname").agg((F.max("pos") + 100).alias("n")).orderBy("rname").collect()  # a row a reference sequence
    path = sam.write_alignments(rows.limit(0), "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{r.rname}\tLN:{r.n}\n" for r in lengths), f"{new_folder(s, 'header')}.bam")
    return sam.sequences(sam.read_headers(s, [path])).select("name", "length", F.col("ordinal").cast("long").alias("place"))


@query("s12_broken_records", f"""SELECT kind, count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS places FROM (
  SELECT CASE WHEN mapq % 7 = 0 THEN 'broken' ELSE 'good' END AS kind, row_number() OVER (ORDER BY ordinal, file) - 1 AS ordinal FROM ({_ALN})) GROUP BY kind""")
def _(s, d):
    text_of = F.concat_ws("\t", "qname", "flag", "rname", F.when(F.col("mapq") % 7 == 0, "x").otherwise(F.col("pos").cast("string")), "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    path = text.write_lines(al_view(s, d).select("ordinal", "file", text_of.alias("value")), ["ordinal", "file"], f"{new_folder(s, 'broken')}.sam")
    good, broken = sam.split_broken(sam.read_alignments(s, [path], "PERMISSIVE"))
    each = good.select(F.lit("good").alias("kind"), "ordinal").unionByName(broken.select(F.lit("broken").alias("kind"), "ordinal"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("places"))


def _numbered(s: SparkSession, d: str, sql: str) -> DataFrame:
    return view(s, d, sql).select("value", "ordinal")


_SHEET = """
SELECT CASE WHEN p_partkey % 5 = 4 THEN 'c' || CAST(p_partkey AS STRING) || '_d__' ELSE 'a' || CAST(p_partkey % 100 AS STRING) || '_b'
       || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'ACGTACG:TTTTTTT_ACGTACG' ELSE 'ACGTA_ACGTA' END || CAST('' AS STRING) END || '	more' AS value, CAST(p_partkey AS INT) AS ordinal FROM {part}
UNION ALL SELECT '' AS value, 100000000 AS ordinal UNION ALL SELECT 'late_key__' AS value, 100000001 AS ordinal"""


@query("s07_sample_sheet", """SELECT DISTINCT CASE WHEN p_partkey % 5 = 4 THEN 'c' || CAST(p_partkey AS VARCHAR) || '_d__' ELSE 'a' || CAST(p_partkey % 100 AS VARCHAR) || '_b__' END AS key,
  CAST(CASE WHEN p_partkey % 5 = 4 THEN 0 WHEN p_partkey % 2 = 0 THEN 7 ELSE 5 END AS INT) AS length FROM part""")
def _(s, d):
    lengths = s.createDataFrame([(7,), (5,)], "length int")
    return text.parse_sample_sheet(_numbered(s, d, _SHEET), lengths)


@query("s08_explicit_keys", "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'a' || CAST(p_partkey % 50 AS VARCHAR) || '_b__' ELSE 'i5_i7_Q' || CAST(p_partkey % 9 AS VARCHAR) || '_Q1' END AS key FROM part WHERE p_partkey % 4 <> 0")
def _(s, d):
    lines = """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'no key' WHEN p_partkey % 3 = 0 THEN 'a' || CAST(p_partkey % 50 AS STRING) || '_b__' ELSE 'i5_i7_Q' || CAST(p_partkey % 9 AS STRING) || '_Q1' END
      || '	extra' AS value, CAST(p_partkey AS INT) AS ordinal FROM {part}"""
    return text.parse_keys(_numbered(s, d, lines))


@query("s09_bed", f"SELECT chrom, start0, \"end\", name FROM (SELECT chrom, start0, \"end\", regexp_replace(name, ' .*', '') AS name FROM ({duck(views.BED)}))")
def _(s, d):
    rows = view(s, d, views.BED).select(F.concat_ws("\t", "chrom", "start0", "end", F.regexp_replace("name", " .*", "")).alias("value"))
    more = s.createDataFrame([("# comment",), ("track name=x",), ("browser y",), ("",)], "value string")
    return text.parse_bed(rows.select(F.when(F.hash("value") % 2 == 0, F.col("value")).otherwise(F.replace("value", F.lit("\t"), F.lit("  "))).alias("value")).unionByName(more))


@query("s10_metrics", "SELECT CAST(sum(l_partkey) AS BIGINT) AS n, CAST(-1 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS empty FROM lineitem")
def _(s, d):
    total = s.read.parquet(f"{d}/lineitem.parquet").agg(F.sum("l_partkey").alias("t"))
    rows = [(0, F.lit("## htsjdk")), (1, F.lit("")), (2, F.lit("LIBRARY\tUNPAIRED_READ_DUPLICATES\tREADS")), (3, F.concat(F.lit("x\t"), F.col("t").cast("string"), F.lit("\t7"))), (4, F.lit("y\t1\t2"))]
    lines = total.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), v.alias("value")) for i, v in rows])).alias("x")).select("x.value", "x.ordinal")
    found = [text.parse_metrics(lines), text.parse_metrics(lines, "NOTHING"), text.parse_metrics(lines.where("ordinal < 2"))]
    return found[0].crossJoin(found[1].select(F.col("n").alias("absent"))).crossJoin(found[2].select(F.col("n").alias("empty")))  # one row each


@query("k08_files_by_key", f"""WITH sets AS ({_reference(views.BARCODE_LINES)}) SELECT replace({_FLAT.format('full_key')}, ':', '-') AS name, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, CAST(count(DISTINCT mark) AS BIGINT) AS marks FROM (
  SELECT full_key, pos, coalesce(b5.barcode, '') || '_' || coalesce(b7.barcode, '') || '_50' AS mark FROM ({duck(views.ALIGNMENTS)}) a
  LEFT JOIN sets b5 ON string_split(full_key, '_')[3] = b5.augmented_label LEFT JOIN sets b7 ON string_split(full_key, '_')[4] = b7.augmented_label) GROUP BY 1""")
def _(s, d):
    named = al_view(s, d).withColumn("qname", F.concat_ws(";", "qname", "full_key"))
    split = al.demultiplex(named, _sets(s, d)[2])
    paths = sam.write_by_key(al.selected_records(split, split.select("key")), _HEADER, new_folder(s, "keys"), bam=True)
    got = sam.read_alignments(s, paths)
    return got.groupBy(text.key_from_path("file").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.countDistinct(al.tag("XD")).alias("marks"))


@query("k09_histogram_file", f"""WITH c AS (SELECT length(seq) - mapq % 5 AS length, count(*) AS n FROM ({_ALN}) WHERE flag & 4 = 0 AND mapq >= 30 GROUP BY 1),
p AS (SELECT length, n, round_even(100.0 * n / sum(n) OVER (), 0) AS share, round_even(100.0 * sum(n) OVER (ORDER BY length) / sum(n) OVER (), 0) AS upto FROM c)
SELECT length || chr(9) || n || chr(9) || CAST(share AS BIGINT) || '%' || chr(9) || CAST(upto AS BIGINT) || '%' AS line FROM p""")
def _(s, d):
    rows = al_view(s, d).withColumn("seq", F.left("seq", F.char_length("seq") - F.col("mapq") % 5))
    lines = text.histogram_text(al.length_histogram(rows, 30).orderBy("length").collect()).splitlines()  # a line a read length
    return s.createDataFrame([(x,) for x in lines[1:]], "line string")


# Single steps

_OTHER = """CASE k % 4 WHEN 0 THEN seq WHEN 1 THEN translate(substr(seq, 1, 5), 'ACGT', 'CGTA') || substr(seq, 6) WHEN 2 THEN substr(seq, 1, 19) || translate(substr(seq, 20, 1), 'ACGT', 'GTAC') || substr(seq, 21)
  ELSE substr(seq, 1, 30) || translate(substr(seq, 31, 2), 'ACGT', 'TGCA') END"""


@query("p14_alignment_passes", f"""WITH r AS (SELECT k, seq, qual, {_OTHER} AS other, reverse(qual) AS other_qual FROM ({READS})),
diffs AS (SELECT k, i, CASE WHEN least(ascii(substr(qual, CAST(i + 1 AS BIGINT), 1)), ascii(substr(other_qual, CAST(i + 1 AS BIGINT), 1))) >= 53 THEN 3 ELSE 1 END AS pen
  FROM (SELECT *, unnest(generate_series(0, least(length(seq), length(other)) - 1)) AS i FROM r) WHERE substr(seq, CAST(i + 1 AS BIGINT), 1) <> substr(other, CAST(i + 1 AS BIGINT), 1)),
runs AS (SELECT k, i, sum(pen) OVER (PARTITION BY k ORDER BY i) AS run FROM diffs)
SELECT k, k NOT IN (SELECT k FROM runs WHERE (i <= 15 AND run > 3) OR (i > 15 AND run * 15 > i * 3)) AS passes FROM r""")
def _(s, d):
    rows = view(s, d, views.READS).withColumn("other", F.expr(_OTHER))
    other_qual = F.left(F.reverse("qual"), F.char_length("other"))
    return rows.select("k", merging.agrees(F.col("seq"), F.col("qual"), F.col("other"), other_qual, 15).alias("passes"))


def _searched(s: SparkSession, d: str) -> DataFrame:
    keyed = bc.experiment_keys(view(s, d, views.PAIRS), *_sets(s, d)).where("key IS NOT NULL")
    cut = F.when(parse_key("key")["p5"].isNull(), 0).otherwise(7)
    both = merging.merged(F.col("r1_seq"), F.col("r1_qual"), cut, F.col("r2_seq"), F.col("r2_qual"), cut)
    return keyed.select(F.col("ordinal").alias("k"), both.alias("m"))


@query("p15_alignment_search", f"WITH {_MERGED} SELECT m.k, CAST(count(good.off) AS INT) AS hits, CASE WHEN count(good.off) = 1 THEN CAST(min(good.off) AS INT) END AS \"offset\" FROM m LEFT JOIN good ON m.k = good.k GROUP BY m.k")
def _(s, d):
    return _searched(s, d).select("k", "m.hits", "m.offset")


@query("p16_merge_pairs", f"WITH {_MERGED} SELECT k, merged_seq IS NOT NULL AS merges, CAST(length(merged_seq) AS INT) AS n FROM screened")
def _(s, d):
    return _searched(s, d).select("k", F.col("m.seq").isNotNull().alias("merges"), F.char_length("m.seq").alias("n"))


@query("p17_element_wise_merge", f"WITH {_MERGED} SELECT k, merged_seq, merged_qual FROM merged")
def _(s, d):
    return _searched(s, d).where("m.seq IS NOT NULL").select("k", F.col("m.seq").alias("merged_seq"), F.col("m.qual").alias("merged_qual"))


@query("p18_base_rule", f"""WITH b AS (SELECT k, i, substr(short1, i, 1) AS x, ascii(substr(qual, i, 1)) AS q, substr(short2, i, 1) AS y, ascii(substr(qual, i + 16, 1)) AS r
  FROM (SELECT *, CAST(unnest(generate_series(1, 16)) AS BIGINT) AS i FROM ({READS})))
SELECT k, string_agg(CASE WHEN x = y OR q >= r THEN upper(x) ELSE upper(y) END, '' ORDER BY i) AS seq,
  string_agg(chr(CASE WHEN x = y THEN least(greatest(q, r), 83) ELSE 33 + abs(r - q) END), '' ORDER BY i) AS qual FROM b GROUP BY k""")
def _(s, d):
    rows = view(s, d, views.READS)
    both = merging.merged_at(F.col("short1"), F.substring("qual", 1, 16), F.col("short2"), F.substring("qual", 17, 16), F.lit(0))
    return rows.select("k", both.alias("m")).select("k", "m.seq", "m.qual")


@query("p19_positive_oligo", f"""WITH {_MERGED}, oligos AS ({_oligo_hit(f"'{views.OLIGO}'")} UNION {_oligo_hit(RC.format(f"'{views.OLIGO}'"))})
SELECT k, merged_seq IS NOT NULL AND k IN (SELECT k FROM oligos) AS oligo FROM screened""")
def _(s, d):
    return _screened(s, d, views.OLIGO).where("key IS NOT NULL").select(F.col("ordinal").alias("k"), "oligo")


_PROGRAMS = """SELECT CAST(s_suppkey AS INT) AS ordinal, CASE WHEN s_suppkey % 3 = 0 THEN 'tool.' || CAST(CAST(floor(s_suppkey / 3.0) AS INT) AS STRING) ELSE 'other' || CAST(s_suppkey AS STRING) END AS id,
  CAST('n' AS STRING) AS name, CAST('1' AS STRING) AS version, s_name AS command, CAST(NULL AS STRING) AS previous FROM {supplier}"""


@query("p31_program_chain", f"""WITH p AS ({duck(_PROGRAMS)}), n AS (SELECT count(*) AS n FROM p)
SELECT id, name, version, command, previous FROM p UNION ALL
SELECT 'tool.' || (SELECT min(i) FROM (SELECT unnest(generate_series(1, n + 1)) AS i FROM n) WHERE 'tool.' || i NOT IN (SELECT id FROM p)), 'tool', '2.0', 'run it', (SELECT arg_max(id, ordinal) FROM p)""")
def _(s, d):
    return al.append_program(view(s, d, _PROGRAMS), "tool", "2.0", "run it").drop("ordinal")


@query("j10_length_precedence", f"""WITH {_KEYED}, prior AS (SELECT DISTINCT i5 || '_' || i7 || '__' AS key FROM full_keys WHERE key IS NOT NULL AND ordinal % 2 = 0),
sheet AS (SELECT DISTINCT i5 || '_' || i7 || '__' AS key FROM full_keys WHERE key IS NOT NULL AND ordinal % 3 = 0)
SELECT k.ordinal AS k, CAST(CASE WHEN s.key IS NOT NULL THEN 5 WHEN p.key IS NOT NULL THEN 7 ELSE -1 END AS INT) AS length, CAST(-1 AS INT) AS without_prior
FROM (SELECT ordinal, i5 || '_' || i7 || '__' AS key FROM full_keys WHERE key IS NOT NULL) k LEFT JOIN prior p ON p.key = k.key LEFT JOIN sheet s ON s.key = k.key""")
def _(s, d):
    keyed = bc.experiment_keys(view(s, d, views.PAIRS), *_sets(s, d)).where("key IS NOT NULL").select("ordinal", F.concat(F.col("i5_label"), F.lit("_"), F.col("i7_label"), F.lit("__")).alias("key"))
    of = lambda by, n: keyed.where(F.col("ordinal") % by == 0).select("key", F.lit(n).alias("length")).distinct()
    found = screening.decide_lengths(keyed, of(3, 5), of(2, 7))
    without = screening.decide_lengths(keyed, of(3, 5), None).select(F.col("ordinal").alias("o"), F.col("length").alias("without_prior"))
    return found.join(without, F.col("ordinal") == F.col("o")).select(F.col("ordinal").alias("k"), "length", "without_prior")


@query("a15_counter_equality", f"""WITH c AS ({_COUNTS}), more AS (SELECT key, label, n + CASE WHEN n > 2 THEN 1 ELSE 0 END AS n FROM c)
SELECT (SELECT count(*) FROM (FROM c EXCEPT ALL FROM (SELECT * FROM c ORDER BY n))) = 0 AS same,
  (SELECT count(*) FROM (FROM c EXCEPT ALL FROM more)) + (SELECT count(*) FROM (FROM more EXCEPT ALL FROM c)) = 0 AS changed""")
def _(s, d):
    c = _counter(s, d)
    more = c.withColumn("n", F.col("n") + F.when(F.col("n") > 2, 1).otherwise(0))
    return s.createDataFrame([(counts.same_counts(c, c.orderBy("n")), counts.same_counts(c, more))], "same boolean, changed boolean")


_RUNS = "SELECT file, ordinal, flag, xd, 'chr' || CAST(1 + CAST(floor(ordinal / 40.0) AS BIGINT) % 3 AS VARCHAR) AS rname, CAST(floor(ordinal / 4.0) AS BIGINT) % 7 AS pos"


@query("w01_adjacent_places", f"""WITH m AS (SELECT *, CASE WHEN lag(rname) OVER w = rname AND lag(pos) OVER w = pos THEN 0 ELSE 1 END AS fresh FROM ({_RUNS} FROM ({_ALN})) WHERE flag & 4 = 0 WINDOW w AS (PARTITION BY file ORDER BY ordinal)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ordinal) AS run FROM m), sizes AS (SELECT count(*) AS depth FROM g GROUP BY file, run, coalesce(xd, 'null'))
SELECT depth, count(*) AS n FROM sizes GROUP BY depth""")
def _(s, d):
    rows = al_view(s, d).withColumns({"rname": F.expr("'chr' || CAST(1 + CAST(floor(ordinal / 4E1) AS BIGINT) % 3 AS STRING)"), "pos": F.expr("CAST(floor(ordinal / 4E0) AS BIGINT) % 7")})
    return al.sorted_duplicate_depths(rows, 50)


@query("f10_tag_equality", f"""SELECT t.n = 0 AS same, t.n AS unmatched, CAST(0 AS BIGINT) AS disordered FROM (
  SELECT CAST(2 * count(*) FILTER (WHERE xd IS NOT NULL AND mapq % 10 = 0) AS BIGINT) AS n FROM ({_ALN})) t""")
def _(s, d):
    rows = al_view(s, d)
    other = rows.withColumn("tags", F.when(F.col("mapq") % 10 == 0, F.map_filter("tags", lambda k, _: k != "XD")).otherwise(F.col("tags")))
    merged = other.withColumn("ordinal", F.col("ordinal") * 3 + F.substring("file", 3, 1).cast("long")).withColumn("file", F.lit("out.bam"))
    return al.verify_merge(merged, rows, *_dictionaries(s), ("XD",)).select(F.col("matches").alias("same"), "unmatched", "disordered")


@query("k13_unmatched_records", f"SELECT side, qname FROM (SELECT 'input' AS side, qname FROM ({_ALN}) WHERE mapq = 60 ORDER BY file, ordinal LIMIT 10)")
def _(s, d):
    rows = al_view(s, d)
    found = al.unmatched_records(rows.where("mapq <> 60"), rows)
    return found.select("side", F.get_json_object("record", "$.qname").alias("qname"))


@query("k13_clip_errors", f"""SELECT error, count(*) AS n, min(qname) AS qname FROM (SELECT qname, CASE WHEN mapq % 3 = 0 THEN 'no valid MD' END AS error FROM ({_ALN})) WHERE error IS NOT NULL GROUP BY error""")
def _(s, d):
    return al.clip_errors(al_view(s, d).withColumn("md", F.when(F.col("mapq") % 3 > 0, F.col("md"))), F.lit(2))


@query("w03_first_seen_labels", f"""SELECT event_type AS label, key, CAST(row_number() OVER (PARTITION BY key ORDER BY first, event_type) AS INT) AS label_ordinal, n FROM (
  SELECT CAST(user_id AS VARCHAR) AS key, event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL)""")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("label"), "event_id")
    return counts.count_labels(rows, ordinal=F.col("event_id")).select("label", "key", "label_ordinal", "n")


@query("u03_chosen_keys", f"""WITH c AS (SELECT key, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY key) - 1 AS ordinal FROM ({_COUNTS}) WHERE label = 'click' GROUP BY key)
SELECT key FROM c WHERE ordinal < 20 AND n >= 2 UNION SELECT 'u' || CAST(p_partkey % 7 AS VARCHAR) || '_v__' FROM part UNION SELECT key FROM c WHERE ordinal = 3 AND n >= 2""")
def _(s, d):
    counter = _counter(s, d).where("label = 'click'")
    order = counter.groupBy("key").count().select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("ordinal"))  # a row a sample
    top = counts.select_samples(counter, order, "click", 20, 2).select("key")
    lines = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("u"), (F.col("p_partkey") % 7).cast("string"), F.lit("_v__\tx")).alias("value"))
    return top.union(text.parse_keys(lines)).distinct()


@query("w03_pair_label_order", f"""WITH {_KEYED} SELECT key, label, CAST(row_number() OVER (PARTITION BY key ORDER BY lane_id, seen) AS INT) AS label_ordinal, n FROM (
  SELECT key, label, n, lane_id, ordinal AS seen FROM (
    SELECT *, count(*) OVER (PARTITION BY key, label) AS n, row_number() OVER (PARTITION BY key, label ORDER BY lane_id, ordinal) AS turn FROM (
      SELECT i5 || '_' || i7 || '__' AS key, CASE WHEN p5 IS NULL THEN 'without_barcodes' ELSE {_FLAT.format('p5')} || '_' || {_FLAT.format('p7')} END AS label, lane_id, ordinal FROM full_keys WHERE key IS NOT NULL))
  WHERE turn = 1)""")
def _(s, d):
    return counts.barcode_pair_counts(bc.experiment_keys(view(s, d, views.PAIRS), *_sets(s, d))).select("key", "label", "label_ordinal", "n")


@query("p32_file_names", f"SELECT file, ordinal, replace('a:' || rname || ':' || xd, ':', '-') AS file_name FROM ({_ALN}) WHERE CAST(substr(rname, 4) AS INT) > 12 AND xd IS NOT NULL")
def _(s, d):
    split = al_view(s, d).withColumns({"key": F.concat(F.lit("a:"), "rname", F.lit(":"), al.tag("XD")), "error": F.lit(None).cast("string")})
    keys = split.where(F.substring("rname", 4, 2).cast("int") > 12).select("key").where("key IS NOT NULL")
    return al.selected_records(split, keys).select("file", "ordinal", "file_name")


@query("s15_read_construction", f"SELECT ordinal AS k, '12' AS run, r1_seq AS seq, CAST(length(r1_qual) AS INT) AS n, true AS bare FROM ({_PAIRS})")
def _(s, d):
    rows = view(s, d, views.PAIRS).select(F.col("ordinal").alias("k"), make_read("r1_header", "r1_seq", "r1_qual").alias("r"), make_read(F.substring("r1_header", 2, 99), "r1_seq", "r1_qual").alias("b"))
    return rows.select("k", F.col("r.header.run").cast("string").alias("run"), "r.seq", F.char_length("r.qual").alias("n"), F.col("b.header").isNull().alias("bare"))


@query("f12_value_equality", f"""WITH p AS ({_PAIRS}), x AS (SELECT *, i5 || '_' || i7 || '_' AS a, CASE WHEN ordinal % 3 = 0 THEN i5 || '_' || i7 || '__' WHEN ordinal % 3 = 1 THEN i5 || '_' || i7 || '_Q' ELSE 'none' END AS b
  FROM (SELECT *, 'a' || CAST(ordinal % 5 AS VARCHAR) AS i5, 'b' || CAST(ordinal % 7 AS VARCHAR) AS i7 FROM p))
SELECT ordinal AS k, r1_header = i1_header AND r1_seq = i1_seq AS with_index, r1_header = r1_header AND r1_seq = r1_seq AND (ordinal % 2 = 0 OR r1_qual = reverse(r1_qual)) AS with_turned,
  ordinal % 3 = 0 AS keys, ordinal % 3 = 0 AND (ordinal % 2 = 0 OR r1_qual = reverse(r1_qual)) AS merged FROM x""")
def _(s, d):
    rows = view(s, d, views.PAIRS).withColumns({"i5": F.concat(F.lit("a"), F.col("ordinal") % 5), "i7": F.concat(F.lit("b"), F.col("ordinal") % 7)})
    pair = F.concat_ws("_", "i5", "i7")
    other = F.when(F.col("ordinal") % 3 == 0, F.concat(pair, F.lit("__"))).when(F.col("ordinal") % 3 == 1, F.concat(pair, F.lit("_Q"))).otherwise("none")
    turned = F.when(F.col("ordinal") % 2 == 0, F.col("r1_qual")).otherwise(F.reverse("r1_qual"))
    rows = rows.select(
        F.col("ordinal").alias("k"), F.concat(pair, F.lit("_")).alias("a"), other.alias("b"), make_read("r1_header", "r1_seq", "r1_qual").alias("r"),
        make_read("i1_header", "i1_seq", "i1_qual").alias("i"), make_read("r1_header", "r1_seq", turned).alias("t"),
    )
    r, i, t = F.col("r"), F.col("i"), F.col("t")
    return rows.select("k", same_reads(r, i).alias("with_index"), same_reads(r, t).alias("with_turned"), same_keys("a", "b").alias("keys"), same_merged(F.col("a"), r, F.col("b"), t).alias("merged"))
