"""Golden cases and properties of the Column functions and operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar, dna, headers, keys, merging
from strandloom.functions.merging import MergeParams, merge_pairs
from strandloom.functions.reads import make_read
from strandloom.operators import alignments as al, barcodes as bc, counts, screening
from strandloom.sources import text

from . import merge_columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lines(spark, content):
    return spark.createDataFrame(list(enumerate(content)), "ordinal long, value string")


def test_reverse_complement_twice_is_the_same(spark):
    seq = "".join(random.Random(1).choices("ACGTNacgtn", k=200))
    assert one(spark, dna.reverse_complement(dna.reverse_complement(F.lit(seq)))) == seq
    assert one(spark, dna.reverse_complement(F.lit("ACTGN"))) == "NCAGT"


def test_bad_input_raises(spark):
    for column in (dna.checked_dna(F.lit("ACX")), dna.hamming(F.lit("AC"), F.lit("A")), dna.subsequence(F.lit("ACG"), 1, 7), keys.key_text(F.lit("a_b"), F.lit("c"))):
        with pytest.raises(Exception, match="USER_RAISED|DNA|lengths|range|separator"):
            one(spark, column)


def test_key_round_trip(spark):
    assert tuple(one(spark, keys.parse_key(F.lit("a_b__")))) == ("a", "b", None, None)
    assert one(spark, keys.parse_key(F.lit("a"))) is None
    assert one(spark, keys.flatten_key(F.lit("a.1_b_Q1.2_Q2.3"))) == "a_b_Q1_Q2"


def test_header_round_trip(spark):
    for text_ in ("@I:3:F:1:2:3:4 1:N:0:ACGT", "@I:3:F:1:2:3:4;a_b_c_d 2:Y:5:"):
        assert one(spark, headers.header_text(headers.parse_header(F.lit(text_)))) == text_
    keyed = headers.header_text(headers.parse_header(F.lit("@I:3:F:1:2:3:4 1:N:0:A")), F.lit("a_b__"))
    assert one(spark, keyed) == "@I:3:F:1:2:3:4;a_b__ 1:N:0:A"


def clip_by_hand(cigar_text, n, hard):
    u = "".join(op * int(k) for k, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar_text))
    ops, shifts = list(u), []
    for _ in range(2):
        left, shift, i = min(n, len(u)), 0, 0
        while left:
            if i >= len(ops):
                return None
            reads, refs = ops[i] in "MIS=X", ops[i] in "MDN=X"
            left, shift, i = left - reads, shift + refs, i + 1
        gone = i if hard else sum(op not in "MIS=X" for op in ops[:i])
        ops[:i] = "H" * gone + "S" * (i - gone)  # what has no bases stands outside
        shifts.append(shift)
        ops.reverse()
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"((.)\2*)", "".join(ops)) for m in [(m[1], m[2])]), shifts


@pytest.mark.parametrize("hard", [False, True])
def test_clipping_matches_a_loop(spark, hard):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        c = "".join(f"{rng.randint(1, 4)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 6)))
        refs = sum(int(k) for k, op in re.findall(r"(\d+)(\D)", c) if op in "MDN=X")
        rows.append((i, c, str(refs), 100, None, "A" * 40, "E" * 40, rng.randint(0, 6)))
    df = spark.createDataFrame(rows, "i int, cigar string, md string, pos int, nm int, seq string, qual string, n int")
    got = {r.i: r for r in cigar.clip_both_ends(df, F.col("n"), hard).collect()}
    for i, c, *_, n in rows:
        want = clip_by_hand(c, n, hard)
        if want is None:
            assert got[i].clip_error and got[i].cigar == c
        else:
            assert (got[i].cigar, got[i].pos) == (want[0], 100 + want[1][0]), (c, n)


def test_clip_golden(spark):
    df = spark.createDataFrame([("1M2D2M4I77M", "1^AC79", 10, None, "A" * 84, "E" * 84)], "cigar string, md string, pos int, nm int, seq string, qual string")
    r = cigar.clip_both_ends(df, F.lit(2)).first()
    assert (r.cigar, r.md, r.nm, r.pos) == ("2H2S1M4I75M2S", "76", 4, 14)


def test_md_round_trip(spark):
    for md in ("3C55G0", "10^AC0T5", "0A0C0", "50"):
        assert one(spark, cigar.md_format(cigar.md_expand(F.lit(md)))) == md


def test_merge_trims_adapters_and_refuses_repeats(spark):
    seq = "ACGTTGCATCCGATAGGCTAACTGGTCAATCGAT"
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("full", seq + "GGGGG", rc + "CCCCC"), ("repeat", "AC" * 20, "GT" * 20), ("short", seq[:10], rc[:10])]
    df = spark.createDataFrame([(n, a, "I" * len(a), b, "I" * len(b)) for n, a, b in rows], "n string, r1_seq string, r1_qual string, r2_seq string, r2_qual string")
    got = {r.n: r.merged_seq for r in merge_pairs(df, F.lit(0), F.lit(0), MergeParams()).collect()}
    assert got == {"full": seq, "repeat": None, "short": None}


def test_merge_agrees_with_the_slow_version(spark):
    rng = random.Random(7)
    turned = str.maketrans("ACGTNacgtn", "TGCANtgcan")
    rows = [(0, "", "", "", ""), (1, "ACGT" * 12, "I" * 48, "", ""), (2, "N" * 40, "I" * 40, "A" * 45, "I" * 45), (3, None, "I", "A", "I")]
    for n in range(4, 400):
        whole = "".join(rng.choices("ACGTN" if n % 3 else "AC", weights=(4, 4, 4, 4, 1) if n % 3 else None, k=rng.randint(20, 90)))
        noisy = lambda s: "".join(rng.choice("ACGTNacgtn") if rng.random() < 0.06 else c for c in s)
        k = rng.randint(30, 60)
        reads = [noisy((x + "".join(rng.choices("ACGT", k=60)))[:k]) for x in (whole, whole[::-1].translate(turned))]
        rows.append((n, *(x for r in reads for x in (r, "".join(chr(33 + rng.randint(0, 40)) for _ in r)))))
    df = spark.createDataFrame(rows, "n int, r1_seq string, r1_qual string, r2_seq string, r2_qual string")
    for cut, params in ((0, MergeParams()), (4, MergeParams(max_penalty=5, min_overlap=10, min_length=20, quality_threshold=15))):
        usable = df.where(f"n >= 4 OR {cut} = 0").where("r1_seq IS NOT NULL")
        fast, slow = (
            {r.n: (r.merged_seq, r.merged_qual, r.hit) for r in f.merge_pairs(usable, F.lit(cut), F.lit(cut), params)
             .withColumn("hit", f.is_oligo(F.col("merged_seq"), F.col("merged_qual"), "ACACCAACCA", params)).collect()}
            for f in (merging, merge_columns)
        )
        assert fast == slow and 100 < sum(x[0] is not None for x in fast.values()) < 396
    assert [r.merged_seq for r in merge_pairs(df.where("n = 3"), F.lit(0), F.lit(0)).collect()] == [None]
    with pytest.raises(Exception, match="barcode longer"):
        merge_pairs(df.where("n = 0"), F.lit(1), F.lit(0)).collect()


def test_sure_stretches():
    assert cigar.sure_stretches("2S3M1I2M1D4M2H", "IIIIIIII!III", 10, 30) == [(10, 14), (17, 19)]
    assert cigar.sure_stretches("*", "*", 10, 30) == cigar.sure_stretches(None, None, 1, 1) == cigar.sure_stretches("5M", None, 1, 0) == []
    assert cigar.sure_stretches("3M4N3M", "IIIIII", 5, 40) == [(5, 7), (12, 14)] and cigar.sure_stretches("2M1I2M", "I!I!!", 5, 41) == []


def test_targets_of_any_length(spark):
    rng = random.Random(11)
    reads = [("f", i, "q", 0, rng.choice(["a", "b"]), rng.randint(1, 20_000), 30, "50M", "".join(rng.choice("I!") if rng.random() < 0.1 else "I" for _ in range(50)) , None) for i in range(300)]
    records = spark.createDataFrame(reads, "file string, ordinal long, qname string, flag int, rname string, pos int, mapq int, cigar string, qual string, tags map<string,struct<type:string,value:string>>")
    targets = [(rng.choice(["a", "b", "c"]), s := rng.randint(0, 20_000), s + rng.choice([1, 2, 30, 5000])) for _ in range(60)] + [(None, 1, 2), ("a", 0, 1 << 28)]
    bed = spark.createDataFrame(targets, "chrom string, start0 int, end int")
    good = lambda r: any(
        c == r[4] and r[5] <= s + 1 and e <= r[5] + 49 and all(r[8][p - r[5]] == "I" for p in range(s + 1, e + 1)) for c, s, e in targets
    )
    wanted = {r[1] for r in reads if good(r)}
    for rows in (1_000_000, 0):
        assert {r.ordinal for r in al.filter_to_targets(records, bed, 20, 25, bed_rows=rows).collect()} == wanted
    assert 0 < len(wanted) < 300 and al.filter_to_targets(records, bed.limit(0), 20, 25).isEmpty()


def test_reads_are_checked_when_made(spark):
    rows = spark.createDataFrame([("@I:1:F:1:1:1:1 1:N:0:A", "ACG", "III"), ("free text", "", ""), (None, None, None)], "h string, s string, q string")
    got = [r.x for r in rows.select(make_read("h", "s", "q").alias("x")).collect()]
    assert got[0].header.flowcell == "F" and got[1].header is None and got[1].seq == "" and got[2] is None
    for seq, qual in (("ACG", "II"), ("AXG", "III"), ("ACG", None)):
        with pytest.raises(Exception, match="not a read"):
            spark.createDataFrame([("@x", seq, qual)], "h string, s string, q string").select(make_read("h", "s", "q").alias("x")).collect()


def test_several_read_groups_raise(spark):
    rows = [("L", 0, "a", "g1"), ("L", 1, None, "g2"), ("L", 2, "b", "g1")]
    screened = spark.createDataFrame(rows, "lane_id string, ordinal long, key string, read_group string")
    assert screening.check_read_groups(screened).first().read_group == "g1"
    assert screening.check_read_groups(screened.limit(0)).first().read_group == "null"
    with pytest.raises(Exception, match="several read groups"):
        screening.check_read_groups(screened.withColumn("key", F.lit("a"))).collect()


def test_reference_sets_are_checked(spark):
    good = bc.reference_set(lines(spark, ["acgt:TTTT Q1 9", "", "GGGG  Q2"])).collect()
    assert {(r.augmented_label, r.barcode) for r in good} == {("Q1.1", "ACGT"), ("Q1.2", "TTTT"), ("Q2", "GGGG")}
    for bad in (["AC:A Q"], ["AC Q", "AC R"], ["AC Q", "GG Q"], ["AC Q.1"], ["AX Q"]):
        with pytest.raises(Exception, match="barcode|label"):
            bc.reference_set(lines(spark, bad)).collect()


def test_both_lookups_agree(spark):
    ref = bc.reference_set(lines(spark, ["ACGTACG:TTTTTTT A", "ACGTACC B", "GGGGG C"]))
    rng = random.Random(2)
    reads = spark.createDataFrame([("".join(rng.choices("ACGTN", k=n)),) for n in (5, 7) for _ in range(300)] + [("ACGTACG",), ("ACGTACT",), (None,)], "q string")
    for d in (0, 1, 2):
        a = bc.nearest_label(reads, F.col("q"), ref, "label", d)
        b = bc.nearest_label_by_search(reads, "q", ref, "label", d)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_counter_text(spark):
    tidy, total = text.parse_counter(lines(spark, ["5", "a_b__\traw\t3\tmerged\t2", "c_d__", "a_b__\traw\t4000000000"]))
    assert total.first().total == 5
    assert {(r.key, r.label, r.n) for r in tidy.collect()} == {("a_b__", "raw", 4000000003), ("a_b__", "merged", 2)}
    assert counts.same_counts(counts.combine(tidy, tidy.limit(0)), tidy)


def test_sample_sheet_stops_at_an_empty_line(spark):
    lengths = spark.createDataFrame([(7,), (6,)], "length int")
    rows = ["a_b_ACGTACG:TTTTTTT_ACGTACG\tx", "c_d__", "", "a_b_ACGTAC_ACGTAC"]
    assert {tuple(r) for r in text.parse_sample_sheet(lines(spark, rows), lengths).collect()} == {("a_b__", 7), ("c_d__", 0)}
    with pytest.raises(Exception, match="inconsistent"):
        text.parse_sample_sheet(lines(spark, [r for r in rows if r]), lengths).collect()


def test_small_text_formats(spark):
    bed = text.parse_bed(lines(spark, ["track x", "chr1\t5 9 name", "# c"])).collect()
    assert [tuple(r) for r in bed] == [("chr1", 5, 9, "name")]
    metrics = ["# c", "", "LIBRARY\tUNPAIRED_READ_DUPLICATES", "x\t449", "more"]
    assert text.parse_metrics(lines(spark, metrics)).first().n == 449
    assert text.parse_metrics(lines(spark, ["#"])).first().n == 0
    assert text.parse_metrics(lines(spark, ["A", "1"])).first().n == -1


def test_prior_counts_decide_lengths(spark):
    rows = [("k1", "without_barcodes", 1, 100), ("k1", "Q1_Q2", 2, 6), ("k2", "without_barcodes", 1, 100), ("k2", "Q1_Q2", 2, 5), ("k3", "Q1_Q2", 1, 9)]
    counter = spark.createDataFrame(rows, "key string, label string, label_ordinal int, n long")
    lengths = spark.createDataFrame([("Q1", 7), ("Q2", 7)], "label string, length int")
    assert {tuple(r) for r in counts.barcode_lengths_from_counts(counter, lengths).collect()} == {("k1", 7), ("k2", 0), ("k3", 7)}


def test_program_records_are_chained(spark):
    programs = spark.createDataFrame([(0, "bwa", "bwa", "1", "x", None), (1, "p.1", "p", "1", "y", "bwa")], "ordinal int, id string, name string, version string, command string, previous string")
    last = al.append_program(programs, "p", "2", "c").orderBy(F.desc("ordinal")).first()
    assert (last.id, last.previous) == ("p.2", "p.1")
    assert al.append_program(programs.limit(0), "p", "2", "c").first().id == "p.1"
