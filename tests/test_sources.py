"""Files written and read back."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import alignments as al, screening
from strandloom.plans import queries, views
from strandloom.sources import bgzf, fastq, parts, sam, text
from strandloom.streaming.counts import stream_counts, write_counts

SF = "/root/testdata/sf0.001"
HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{i}\tLN:60000\n" for i in range(1, 25)) + "@RG\tID:rg0\tLB:Lib1\tSM:x\n"


def write_fastq(path, rows):
    with gzip.open(path, "wt") as f:
        f.writelines(f"{h}\n{s}\n+\n{q}\n" for h, s, q in rows)


def test_fastq_lanes_are_read_in_lockstep(spark, tmp_path):
    rows = [(f"@I:1:F:1:1:1:{i} 1:N:0:A", "ACGT", "IIII") for i in range(5)]
    write_fastq(tmp_path / "r1.gz", rows)
    write_fastq(tmp_path / "r2.gz", rows[:4])
    lanes = {"a": [f"{tmp_path}/r1.gz", f"{tmp_path}/r2.gz"], "b": [f"{tmp_path}/r2.gz", f"{tmp_path}/r2.gz"]}
    got = fastq.read_pairs(spark, lanes)
    assert {(r.lane_id, r.ordinal, r.r1_header == r.r2_header) for r in got.collect()} == {(x, i, True) for x in "ab" for i in range(4)}
    with pytest.raises(Exception, match="zip"):
        fastq.read_pairs(spark, lanes, strict_lengths=True).collect()
    write_fastq(tmp_path / "bad.gz", [("@x", "ACX", "III")])
    with pytest.raises(Exception, match="broken FASTQ"):
        fastq.read_pairs(spark, {"a": [f"{tmp_path}/bad.gz"] * 2}).collect()


def test_large_lanes_are_read_in_ranges(spark, tmp_path):
    rows = spark.range(9000).select(F.lit(1).alias("stripe"), F.lit("L").alias("lane_id"), F.col("id").alias("ordinal"), F.concat(F.lit("@h"), "id").alias("header"), F.repeat(F.lit("ACGT"), F.col("id").cast("int") % 20).alias("seq"))
    rows = rows.withColumn("qual", F.translate("seq", "ACGT", "IIII"))
    for name, n in (("r1", 9000), ("r2", 8000)):
        fastq.write_striped(rows.where(F.col("ordinal") < n), f"{tmp_path}/{name}")
    lanes = {"a": [f"{tmp_path}/r1_001.fastq.gz", f"{tmp_path}/r2_001.fastq.gz"]}
    whole, ranged = fastq.read_pairs(spark, lanes), fastq.read_pairs(spark, lanes, split_bytes=40_000)
    assert whole.rdd.getNumPartitions() == 1 and ranged.rdd.getNumPartitions() > 1
    assert whole.count() == ranged.count() == 8000 and whole.exceptAll(ranged).isEmpty()
    assert ranged.where("r1_header <> r2_header OR r1_header <> concat('@h', ordinal)").isEmpty()
    with pytest.raises(Exception, match="zip"):
        fastq.read_pairs(spark, lanes, strict_lengths=True, split_bytes=40_000).collect()
    # Blank lines end a lane, which ranges don't tell; plain gzip has no blocks.
    text = gzip.open(lanes["a"][0], "rb").read()
    (tmp_path / "odd.gz").write_bytes(bgzf.packed(text + b"\n" * 4 + text))
    odd = fastq.read_pairs(spark, {"a": [f"{tmp_path}/odd.gz"] * 2}, split_bytes=40_000)
    write_fastq(tmp_path / "plain.gz", [("@x", "AC", "II")])
    plain = fastq.read_pairs(spark, {"a": [f"{tmp_path}/plain.gz"] * 2}, split_bytes=1)
    assert (odd.count(), plain.count()) == (9000, 1) and odd.rdd.getNumPartitions() == plain.rdd.getNumPartitions() == 1


def test_pairs_are_derived_by_all_tasks_and_dealt_out_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(fastq, "write_parts", lambda rows, *a: calls.append(rows) or parts.write_parts(rows, *a))
    got = queries.QUERIES["s02_positional_zip"](spark, SF)
    assert len(calls) == 1  # not once a read
    rows = views.view(spark, SF, views.PAIRS, "o_orderkey").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1  # the table has one row group
    assert got.where("lane_id <> 'L3'").count() == spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 4 <> 3").count()


def test_pairs_without_a_read_are_left_out_of_its_file(spark, tmp_path):
    column = lambda r, c: f"CASE WHEN '{r}' <> 'r2' OR id < 7 THEN {c} END AS {r}_"
    reads = [column(r, c) + n for r in fastq.READS for n, c in (("header", f"concat('@{r}', id)"), ("seq", "repeat('A', cast(id % 3 as int))"), ("qual", "repeat('I', cast(id % 3 as int))"))]
    rows = spark.range(3000).selectExpr("1 + cast(id % 2 as int) AS stripe", "'L' AS lane_id", "id AS ordinal", *reads)
    paths = fastq.write_pairs(rows, f"{tmp_path}/x")
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == sorted(f"{r}_00{k}.fastq.gz" for r in fastq.READS for k in (1, 2)) and len(list((tmp_path / "x").iterdir())) == 8
    for r in fastq.READS:
        held = "".join(f"@{r}{i}\n{'A' * (i % 3)}\n+\n{'I' * (i % 3)}\n" for i in range(1, 7 if r == "r2" else 3000, 2))
        assert gzip.open(f"{tmp_path}/x/{r}_002.fastq.gz", "rt").read() == held
    lacking = rows.withColumn("r1_seq", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="has no bases"):
        fastq.write_pairs(lacking, f"{tmp_path}/y")


def test_lines_of_gzip_files_as_bytes(tmp_path, monkeypatch):
    plain = b"".join(b"@h%d\nAC\n+x\nI@\n" % i for i in range(50))
    (tmp_path / "x.gz").write_bytes(gzip.compress(plain[:300]) + gzip.compress(plain[300:] + b"@last\nA\n+\nI"))
    for size in (3, 64, 1 << 19):
        monkeypatch.setattr(fastq, "_CHUNK", size)
        f = fastq.Lines(f"{tmp_path}/x.gz")
        f.skip(6)
        taken = [f.take(n) for n in (1, 5, 0, 80, 1000, 4)]
        assert b"".join(taken) == b"\n".join((plain + b"@last\nA\n+\nI").split(b"\n")[6:]) and [x.count(b"\n") for x in taken] == [1, 5, 0, 80, 111, 0]
    assert [c.to_pylist() for c in fastq._clean(plain[:26])] == [["@h0", "@h1"], ["AC"] * 2, ["I@"] * 2] and [len(c) for c in fastq._clean(b"")] == [0, 0, 0]
    for odd in (plain[:20], plain[:13] + b"\r\n", plain[:12], plain[:13].replace(b"A", b"X"), plain[:13].replace(b"+", b"-"), plain[:13].replace(b"I@", b"I"), plain[1:14], plain[:13].replace(b"h", b"\xe9")):
        assert fastq._clean(odd) is None
    assert fastq._split(plain[:13] + b"@\r\nA") == ["@h0\n", "AC\n", "+x\n", "I@\n", "@\r\n", "A"]


def test_lines_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    sizes = []
    monkeypatch.setattr(text, "assemble", lambda s, found: sizes.append(len(found)) or parts.assemble(s, found))
    text.write_lines(spark.range(1000).select(F.col("id").alias("value"), (-F.col("id")).alias("at")), ["at"], f"{tmp_path}/lines")
    assert (tmp_path / "lines").read_text() == "".join(f"{i}\n" for i in reversed(range(1000)))
    assert sizes[0] > 1 and [x.name for x in tmp_path.iterdir()] == ["lines"]


def test_a_stripe_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    sizes = []
    monkeypatch.setattr(fastq, "assemble", lambda s, found, end: sizes.append(len(found)) or parts.assemble(s, found, end=end))
    rows = spark.range(1000).select(F.lit(1).alias("stripe"), F.lit("L").alias("lane_id"), F.col("id").alias("ordinal"), F.concat(F.lit("@"), "id").alias("header"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    (path,) = fastq.write_striped(rows, f"{tmp_path}/out")
    assert gzip.open(path, "rt").read() == "".join(f"@{i}\nA\n+\nI\n" for i in range(1000))
    assert sizes[0] > 1 and len(list(tmp_path.iterdir())) == 1


def test_many_large_files_are_counted_at_once(spark, tmp_path):
    rows = views.alignments(spark, SF).withColumn("file_name", F.col("rname")).drop("md", "rg", "xd", "ds", "full_key", "nm")
    paths = sam.write_by_key(rows, HEADER, str(tmp_path), bam=True)
    spark.sparkContext.setJobGroup("ranges", "")
    got = sam.read_alignments(spark, paths, split_bytes=3000)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ranges")
    spark.sparkContext.setJobGroup("none", "")
    assert len(paths) == 8 and len(jobs) <= 2 and got.count() == rows.count()


def test_bam_pieces_as_before():
    tags = [("NM", "i", "3"), ("XB", "B", "s,1,-2"), ("XF", "f", "0.5"), ("XA", "A", "c"), ("XD", "Z", "AC_GT")]
    row = ("n1", 16, "chr2", 7, 30, "2S3M1D2M", "=", 9, -4, "ACGTNAC", "!I~5A?J", tags)
    (raw,) = bgzf.BlockReader(io.BytesIO(bgzf.packed(sam._pack(*row, {"chr1": 0, "chr2": 1})))).records()
    assert sam._bam_record(raw, ["chr1", "chr2"]) == (*row[:11], {k: (t, v) for k, t, v in tags})
    for seq, qual in (("AXA", "III"), ("ACA", "I I")):
        with pytest.raises(ValueError):
            sam._pack("n", 0, "chr1", 1, 0, "3M", "*", 0, 0, seq, qual, [], {})
    held = sam._tag_array(({"A": ("Z", "x"), "B": ("i", "1")}, None, {}))
    assert held.to_pylist() == [[("A", {"type": "Z", "value": "x"}), ("B", {"type": "i", "value": "1"})], None, []] and sam._tag_lists(held.slice(2)) == [[]]


def test_striped_output(spark, tmp_path):
    rows = spark.createDataFrame([(1 + i % 3, "L", i, f"@h{i}", "ACGT", "IIII") for i in range(7)], "stripe int, lane_id string, ordinal long, header string, seq string, qual string")
    paths = fastq.write_striped(rows, f"{tmp_path}/out")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out_001.fastq.gz", "out_002.fastq.gz", "out_003.fastq.gz"]
    assert gzip.open(paths[0], "rt").read() == "".join(f"@h{i}\nACGT\n+\nIIII\n" for i in (0, 3, 6))


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_alignment_round_trip(spark, tmp_path, kind):
    rows = views.alignments(spark, SF).where("rname <> 'chr99'").drop("md", "rg", "xd", "ds", "full_key", "nm").limit(500).cache()
    path = sam.write_alignments(rows, HEADER, f"{tmp_path}/x.{kind}")
    got = sam.read_alignments(spark, [path])
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))).alias("tags")]
    a, b = rows.select(*columns), got.select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    places = [(int(r.rname[3:]), r.pos) for r in got.orderBy("ordinal").collect()]
    assert places == sorted(places)
    assert sam.header_text(path) == HEADER
    assert sam.sequences(sam.read_headers(spark, [path])).count() == 24


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_large_files_are_read_in_ranges(spark, tmp_path, kind):
    rows = views.alignments(spark, "/root/testdata/sf0.01").drop("md", "rg", "xd", "ds", "full_key", "nm")
    long = rows.limit(1).withColumns({"qname": F.lit("long"), "seq": F.repeat(F.lit("ACGT"), F.lit(60_000)), "qual": F.lit("*"), "cigar": F.lit("240000M"), "pos": F.lit(9000)})
    path = sam.write_alignments(rows.unionByName(long), HEADER, f"{tmp_path}/x.{kind}")
    whole = sam.read_alignments(spark, [path])
    for size in (30_000, 200_000):
        ranged = sam.read_alignments(spark, [path], split_bytes=size)
        assert ranged.rdd.getNumPartitions() > 1
        columns = [c for c in whole.columns if c != "tags"] + [F.to_json("tags").alias("tags")]
        a, b = whole.select(*columns), ranged.select(*columns)
        assert a.count() == b.count() == 15_001 and a.exceptAll(b).isEmpty()
    (tmp_path / "empty.sam").write_text(HEADER)
    assert sam.read_alignments(spark, [f"{tmp_path}/empty.sam"], split_bytes=10).isEmpty()


def test_ranges_that_do_not_meet_are_not_trusted():
    good = [(100, 5, 300, 7, 4), (-1, -1, -1, -1, 0), (300, 7, 1 << 62, 0, 9)]
    assert sam._chained("x", (100, 5), good) == [["x", 100, 5, 4, 0], ["x", 300, 7, 9, 4]]
    whole = [["x", 0, 0, -1, 0]]
    assert sam._chained("x", (100, 4), good) == sam._chained("x", (100, 5), [good[0], (300, 8, 1 << 62, 0, 9)]) == sam._chained("x", None, []) == whole


def test_malformed_records(spark, tmp_path):
    path = tmp_path / "x.sam"
    far = f"far\t0\tc\t{1 << 40}\t0\t1M\t*\t0\t0\tA\tI\n"
    path.write_text("@SQ\tSN:c\tLN:9\na\t0\tc\t1\t0\t1M\t*\t0\t0\tA\tI\nbroken\tline\n" + far)
    assert sam.read_alignments(spark, [str(path)], "DROPMALFORMED").count() == 1
    assert sam.read_alignments(spark, [str(path)], "PERMISSIVE").where("corrupt IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="broken record"):
        sam.read_alignments(spark, [str(path)]).collect()
    with pytest.raises(NotImplementedError):
        sam.header_text("x.CRAM")


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "x.sam"
    path.write_text(HEADER + "".join(f"n{i}\t0\tchr1\t{1 + i // 2}\t30\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:4\tXD:Z:a\tRG:Z:rg0\n" for i in range(4)))
    assert cli.main(["duplicateshistogram", "-i", str(path)]) == 0
    assert capsys.readouterr().out == "1\t0\n2\t2\n"
    assert cli.main(["SoftClip", "-i", str(path), "-o", f"{tmp_path}/y.bam", "-n", "1"]) == 0
    assert {r.cigar for r in sam.read_alignments(spark, [f"{tmp_path}/y.bam"]).collect()} == {"1S2M1S"}
    assert cli.main(["alignmentcomparison", "-c", str(path), "-i", str(path)]) == 0
    assert cli.main(["alignmentcomparison", "-c", f"{tmp_path}/y.bam", "-i", str(path)]) == 1
    assert cli.main([]) == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def sam_lines(rows):
    return "".join("\t".join(map(str, r)) + "\n" for r in rows)


def test_demultiplexing_writes_a_file_a_key(spark, tmp_path, capsys):
    record = lambda i, key, pos, flag=0: (f"n{i};{key}", flag, "chr1" if flag == 0 else "*", pos, 30, "4M", "*", 0, 0, "ACGT", "IIII", "MD:Z:4")
    inputs = [tmp_path / "a.sam", tmp_path / "b.sam"]
    rows = [[record(1, "1_2_Q1.1_Q2", 30), record(2, "1_2_Q1.2_Q2", 20), record(3, "3_4__", 5)], [record(4, "1_2_Q1_Q2", 10, 4), record(5, "9_9__", 7), ("nokey", 0, "chr1", 1, 0, "4M", "*", 0, 0, "ACGT", "IIII")]]
    for path, own in zip(inputs, rows, strict=True):
        path.write_text(HEADER + sam_lines(own))
    (tmp_path / "counts").write_text("9\n1_2_Q1_Q2\traw\t5\n3_4__\traw\t2\n9_9__\traw\t1\n")
    (tmp_path / "sets").write_text("AAAA:CCCC Q1\nGGGG Q2\n")
    (tmp_path / "more").write_text("not a key\n9_9__\textra\n")
    for flag, kind in (([], "sam"), (["-b", "-c", "9"], "bam")):
        out = tmp_path / kind
        assert cli.main(["DemultiplexSAM", "-s", f"{tmp_path}/counts", "-f", f"{tmp_path}/sets", "-n", "1", "-e", f"{tmp_path}/more", "-o", str(out), *flag, *map(str, inputs)]) == 0
        said = capsys.readouterr()
        assert "1_2_Q1_Q2\traw\t5\tdemultiplexed\t3\taligned\t2" in said.out and "b.sam\t1 records: no key" in said.err and "Outputting 2 files" in said.err
        assert sorted(x.name for x in out.iterdir()) == [f"1_2_Q1_Q2.{kind}", f"9_9__.{kind}"]
        path = f"{out}/1_2_Q1_Q2.{kind}"
        got = [(r.qname, r.pos, r.tags["XD"].value) for r in sam.read_alignments(spark, [path]).orderBy("ordinal").collect()]
        assert sam.header_text(path) == HEADER and set(got) == {("n1", 30, "AAAA_GGGG_4"), ("n2", 20, "CCCC_GGGG_4"), ("n4", 10, "_GGGG_4")}
    inputs[1].write_text(HEADER.replace("LN:", "LN:7") + sam_lines(rows[1]))
    with pytest.raises(ValueError, match="other reference sequences"):
        sam.common_header([str(p) for p in inputs])


def test_broken_records_are_skipped_and_said(spark, tmp_path, capsys):
    path = tmp_path / "x.bam.sam"
    good = "n\t0\tchr1\t1\t30\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:4\n"
    path.write_text(HEADER + "@CO\tgrün\n" + good + "broken\tline\n" + good.replace("4M", "2M") .replace("ACGT\tIIII", "AC\tII"))
    assert "grün" in sam.header_text(str(path))
    assert cli.main(["samstats", "-f", str(path), "-t", '{"one": "chr1"}', "-l", f"{tmp_path}/hist", "-q", "10", "--lenient", "--stdoutFile", f"{tmp_path}/out"]) == 0
    assert "1 broken records skipped" in capsys.readouterr().err
    assert (tmp_path / "hist").read_text() == "Value \t Freq. \t Pct. \t Cum Pct. \n2\t1\t50%\t50%\n4\t1\t50%\t100%\n"
    assert (tmp_path / "out").read_text() == "0\nx\tone\t2\tone-coverageLength\t6\n"


def test_diagnostics_name_the_records(spark, tmp_path, capsys):
    path, other = tmp_path / "x.sam", tmp_path / "y.sam"
    line = lambda i, md="\tMD:Z:4": f"n{i}\t0\tchr1\t{i}\t30\t4M\t*\t0\t0\tACGT\tIIII{md}\n"
    path.write_text(HEADER + line(1) + line(2, ""))
    other.write_text(HEADER + line(1) + line(3))
    assert cli.main(["alignmentcomparison", "-c", str(path), "-i", str(other)]) == 1
    said = capsys.readouterr()
    assert "Match: false" in said.out and "check\t" in said.err and '"n2"' in said.err and "input\t" in said.err and '"n3"' in said.err and '"n1"' not in said.err
    assert cli.main(["softclip", "-i", str(path), "-o", f"{tmp_path}/z.sam", "-n", "1", "-x", "2", "-s", "Lib9"]) == 0
    assert "1 records cannot be clipped, the first n2: no valid MD" in capsys.readouterr().err
    assert cli.main(["readgrouprewrite", "-i", str(path), "-o", f"{tmp_path}/w.sam", "-s", "S"]) == 0
    assert cli.main(["readgrouprewrite", "-i", f"{tmp_path}/w.sam", "-o", f"{tmp_path}/v.sam", "-s", "S"]) == 0
    programs = [r.fields for r in sam.read_headers(spark, [f"{tmp_path}/v.sam"]).where("record_type = 'PG'").collect()]
    assert [(f["ID"], f.get("PP")) for f in programs[-2:]] == [("strandloom.1", programs[-2].get("PP")), ("strandloom.2", "strandloom.1")]


def test_running_counts(spark, tmp_path):
    rows = queries.QUERIES["c01_barcode_count"](spark, SF).select("key", "label").limit(20)
    rows.write.parquet(f"{tmp_path}/in")
    write_counts(stream_counts(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == rows.count()


def test_headers_of_a_pair_must_agree(spark):
    pair = spark.createDataFrame([("@I:1:F:1:1:1:1 1:N:0:A", "@I:1:F:1:1:1:2 2:N:0:A")], "r1_header string, r2_header string")
    with pytest.raises(Exception, match="headers of a pair differ"):
        screening.check_headers(pair).collect()
    # Texts that are alike are not parsed; unlike ones may still be equal headers, or not.
    assert spark.range(1).select(screening._alike(F.lit("@I:1:F:1:1:1:1 1:N:0:A"), F.lit("@I:1:F:1:1:1:1 2:N:0:A"))).first()[0]
    one = "@I:1:F:1:1:1:1 1:N:0:A"
    others = [("@I:1:F:1:1:1:1 2:N:0:A", True), ("I:01:F:1:1:1:1 12:N:0:A", True), ("@I:1:F:1:1:1:1 x:N:0:A ", True), ("@I:1:F:1:1:1:1;k 2:N:0:A", True), ("@I:1:F:1:1:1:1 2:Y:0:A", False), ("2:N:0:A", False), (None, False)]
    for other, same in others:
        pair = spark.createDataFrame([(one, other)], "r1_header string, r2_header string")
        if same:
            assert screening.check_headers(pair).first().h1.read == 1
        else:
            with pytest.raises(Exception, match="headers of a pair differ"):
                screening.check_headers(pair).collect()
    short = spark.createDataFrame([("ab 12:3:4:5:6/1 1:", "ab 13:3:4:5:6/1 1:")], "r1_header string, r2_header string")
    with pytest.raises(Exception, match="headers of a pair differ"):
        screening.check_headers(short).collect()


def test_read_groups_look_no_lengths_up(spark):
    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("k05_read_group").count("Join LeftOuter") + 2 == plan("c02_screen_pairs").count("Join LeftOuter")


def test_merge_order_over_stretches(spark):
    rows = views.alignments(spark, SF).cache()
    sequences = spark.createDataFrame([], "file string, ordinal int, name string, length int")
    # Each input turned round: of n records n - 1 lie behind the one after them, wherever a stretch ends.
    turned = rows.withColumn("ordinal", -F.col("ordinal") * 3 + F.substring("file", 3, 1).cast("long")).withColumn("file", F.lit("out.bam"))
    for stretch in (1, 7, 1 << 16):
        got = al.verify_merge(turned, rows, sequences, sequences, stretch=stretch).first()
        assert (got.matches, got.unmatched, got.disordered) == (False, 0, rows.count() - 3)
