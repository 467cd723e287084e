"""Command line: ``python -m strandloom.cli COMMAND ...`` over the operators."""

from __future__ import annotations

import argparse
import contextlib
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import __version__
from .functions.merging import MergeParams
from .operators import alignments as al, barcodes as bc, counts, screening
from .sources import fastq, sam, text


def _session() -> SparkSession:
    return SparkSession.builder.appName("strandloom").getOrCreate()


def _records(spark, args) -> tuple[DataFrame, str]:
    """Records with NM and MD as columns, and the header all files agree with.

    In mode SKIP broken records are left out and said on standard error.
    """
    header = sam.common_header(args.input)
    rows = sam.read_alignments(spark, args.input, "PERMISSIVE" if args.mode == "SKIP" else args.mode)
    if args.mode == "SKIP":
        rows, broken = sam.split_broken(rows)
        for r in broken.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("corrupt", "ordinal").alias("first")).orderBy("file").collect():
            print(f"{r.file}\t{r.n} broken records skipped, the first: {r.first}", file=sys.stderr)
    return rows.withColumns({"md": al.tag("MD"), "nm": al.tag("NM").try_cast("int")}), header


def _write(rows: DataFrame, header: str, path: str, bam: bool) -> None:
    sam.write_alignments(rows, header, path, bam=bam or sam.is_bam_name(path))


def _print_counter(rows: DataFrame, total: int, label: str | None) -> None:
    print(total)
    lines = counts.sorted_text(rows, label) if label else counts.rows_as_text(rows).orderBy("key")
    for r in lines.toLocalIterator():
        print(r.line)


def _pairs(spark, args) -> DataFrame:
    files = args.files
    rows = fastq.read_pairs(spark, {"lane": files})
    if len(files) == 2:
        if args.fixed_i5 is None or args.fixed_i7 is None:
            raise SystemExit("two files need --fixed-i5 and --fixed-i7")
        rows = rows.drop(*[c for c in rows.columns if c[:2] in ("i1", "i2")]).withColumns({"i5_label": F.lit(args.fixed_i5), "i7_label": F.lit(args.fixed_i7)})
    return rows


def _sets(spark, args):
    return tuple(text.read_reference_set(spark, p) for p in (args.i5_indices, args.i7_indices, args.barcodes))


def barcodecount(spark, args) -> None:
    pairs = screening.check_headers(_pairs(spark, args))
    keyed = bc.experiment_keys(pairs, *_sets(spark, args), args.hamming_distance, reverse_i5=args.reverse_complement_i5)
    _print_counter(counts.barcode_pair_counts(keyed), pairs.count(), None)


def indexandbarcodescreener(spark, args) -> None:
    *args.files, root = args.files
    i5, i7, sets = _sets(spark, args)
    lengths = sets.where("ordinal = 1").select("label", "length")
    prior = sheet = None
    if args.prior_counts:
        prior = counts.barcode_lengths_from_counts(text.read_counter(spark, args.prior_counts)[0], lengths, args.threshold)
    if args.sample_sheet:
        sheet = text.parse_sample_sheet(text._numbered(spark, args.sample_sheet), sets)
    params = MergeParams(args.max_penalty, args.penalty_high, args.penalty_low, args.quality_threshold, args.min_overlap, args.min_length)
    pairs = _pairs(spark, args)
    out = screening.screen_pairs(pairs, i5, i7, sets, prior, sheet, args.oligo, args.hamming_distance, args.reverse_complement_i5, params).persist()
    if not args.disable_flowcell_lane_check:
        group = screening.check_read_groups(out).first().read_group
        if args.read_group_file:
            with open(args.read_group_file, "w") as f:
                f.write(group + "\n")
    fastq.write_striped(screening.striped(out, args.outputs), root)
    _print_counter(screening.screen_counts(out), out.count(), "raw")


def aggregatestatistics(spark, args) -> None:
    read = [text.read_counter(spark, p) for p in args.files]
    whole = counts.combine(*[c for c, _ in read])
    if args.key:
        print(counts.lookup(whole, args.key, args.label).first().n)
    else:
        _print_counter(whole, sum(t.first().total for _, t in read), args.sort)


def demultiplexsam(spark, args) -> None:
    counter, total = text.read_counter(spark, args.statistics)
    sets = text.read_reference_set(spark, args.barcodes) if args.barcodes else bc.reference_set(spark.createDataFrame([], "value string"))
    rows, header = _records(spark, args)
    split = al.demultiplex(rows, sets).persist()
    for r in split.where("error IS NOT NULL").groupBy("file", "error").count().orderBy("file").collect():
        print(f"{r.file}\t{r['count']} records: {r.error}", file=sys.stderr)
    order = counter.select("key", F.col("file_ordinal").alias("ordinal")).distinct()
    chosen = counts.select_samples(counter, order, "raw", args.number, args.minimum, args.threshold).select("key")
    if args.explicit:
        chosen = chosen.union(text.parse_keys(text._numbered(spark, args.explicit))).distinct()
    written = sam.write_by_key(al.selected_records(split, chosen), header, args.output, args.bam, level=args.compression)
    print(f"Outputting {len(written)} files", file=sys.stderr)
    _print_counter(al.demultiplex_counts(split, counter), total.first().total, "raw")


def readmarkduplicatesstatistics(spark, args) -> None:
    n = text.parse_metrics(text._numbered(spark, args.input[0])).first().n
    key = spark.range(1).select(text.key_from_path(F.lit(args.input[0]))).first()[0]
    print(f"0\n{key}\t{args.label}\t{n}")


def samstats(spark, args) -> None:
    rows, _ = _records(spark, args)
    key = spark.range(1).select(text.key_from_path(F.lit(args.input[0]))).first()[0]
    _print_counter(al.class_counts(rows, al.target_classes(spark, args.targets), key, args.min_mapq), 0, None)
    if args.lengths:
        with open(args.lengths, "w") as f:
            f.write(text.histogram_text(al.length_histogram(rows, args.min_mapq).orderBy("length").collect()))


def _clipped(spark, args, rows: DataFrame, hard: bool) -> DataFrame:
    headers = sam.read_headers(spark, args.input)
    rows = al.clip_length(rows, sam.read_groups(headers), args.n, args.library1, args.n1, args.library2, args.n2)
    for r in al.clip_errors(rows, F.col("clip_n")).collect():
        print(f"{r.n} records cannot be clipped, the first {r.qname}: {r.error}", file=sys.stderr)
    out = al.clip(rows, F.col("clip_n"), sam.sequences(headers).dropDuplicates(["name"]), hard)
    return al.with_tag(al.with_tag(out, "MD", F.col("md")), "NM", F.col("nm"), "i").drop("clip_n", "md", "nm")


def softclip(spark, args) -> None:
    rows, header = _records(spark, args)
    _write(_clipped(spark, args, rows, args.hard), header, args.output, args.bam)


def hardclip(spark, args) -> None:
    args.hard = True
    softclip(spark, args)


def filtersam(spark, args) -> None:
    rows, header = _records(spark, args)
    if args.n or args.n1 or args.n2:
        rows = _clipped(spark, args, rows.where(al.is_mapped()), False)
    _write(al.filter_to_targets(rows, text.read_bed(spark, args.bed), args.min_mapq, args.min_base_quality), header, args.output, args.bam)


def assignreadgroups(spark, args) -> None:
    rows, header = _records(spark, args)
    out, groups = al.assign_read_groups(rows, args.label, args.date, args.sample, args.library, args.platform, args.center)
    names = {"ID": "id", "CN": "center", "DT": "run_date", "LB": "library", "PL": "platform", "PM": "platform_model", "PU": "platform_unit", "SM": "sample"}
    lines = ["@RG\t" + "\t".join(f"{k}:{g[v]}" for k, v in names.items() if g[v] is not None) + "\n" for g in groups.orderBy("id").collect()]
    _write(out, header + "".join(lines), args.output, args.bam)


def duplicateshistogram(spark, args) -> None:
    for r in al.duplicate_depths(_records(spark, args)[0]).orderBy("depth").collect():
        print(r.depth, r.n, sep="\t")


def readgrouprewrite(spark, args) -> None:
    rows, header = _records(spark, args)
    given = {"SM": args.sample, "LB": args.library, "CN": args.center, "PL": args.platform}
    if args.platform is not None and args.platform not in al.PLATFORMS:
        raise SystemExit(f"unknown platform {args.platform}")
    lines, programs = [], []
    for _, at, kind, fields in sam.parse_header("", header):
        if kind == "RG":
            if fields.get("PL") not in al.PLATFORMS:
                fields.pop("PL", None)
            fields |= {k: v for k, v in given.items() if v is not None}
        if kind == "PG":
            programs.append((at, fields.get("ID"), fields.get("PN"), fields.get("VN"), fields.get("CL"), fields.get("PP")))
        lines.append(f"@{kind}\t" + (fields["text"] if kind == "CO" else "\t".join(f"{k}:{v}" for k, v in fields.items())))
    held = spark.createDataFrame(programs, "ordinal int, id string, name string, version string, command string, previous string")
    added = al.append_program(held, "strandloom", __version__, "ReadGroupRewrite " + " ".join(sys.argv[2:])).orderBy(F.desc("ordinal")).first()
    names = {"ID": "id", "PN": "name", "VN": "version", "PP": "previous", "CL": "command"}
    lines.append("@PG\t" + "\t".join(f"{k}:{added[v]}" for k, v in names.items() if added[v] is not None))
    _write(rows, "\n".join(lines) + "\n", args.output, args.bam)


def duplicatestagrewrite(spark, args) -> None:
    rows, header = _records(spark, args)
    _write(al.rebuild_duplicates_tag(rows, args.p5_tag, args.p7_tag), header, args.output, args.bam)


def barcodemover(spark, args) -> None:
    rows, header = _records(spark, args)
    _write(al.barcodes_from_name(rows, args.tag).where("error IS NULL"), header, args.output, args.bam)


def damagerestrict(spark, args) -> None:
    rows, header = _records(spark, args)
    _write(al.restrict_damage(rows, args.damage, args.tag), header, args.output, args.bam)


def alignmentcomparison(spark, args) -> int:
    read = lambda paths: (sam.read_alignments(spark, paths), sam.sequences(sam.read_headers(spark, paths)))
    (check, cs), (inputs, ns) = read([args.check]), read(args.input)
    found = al.verify_merge(check, inputs, cs, ns, tuple(args.tags)).first()
    for r in al.unmatched_records(check, inputs, tuple(args.tags)).collect() if found.unmatched else []:
        print(f"{r.side}\t{r.file}\trecord {r.ordinal}\t{r.record}", file=sys.stderr)
    print(f"Match: {str(found.matches).lower()}")
    return 0 if found.matches else 1


def version(spark, args) -> None:
    print(__version__)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    sub = top.add_subparsers(dest="command")

    def command(f, *specs, inputs: str = "", output: bool = False):
        p = sub.add_parser(f.__name__, add_help=False)
        p.add_argument("--help", action="help")
        if inputs:
            p.add_argument(*inputs.split(), **{"nargs": "+"} | ({"required": True, "dest": "input"} if inputs.startswith("-") else {}))
            p.add_argument("--mode", default="FAILFAST", choices=("FAILFAST", "DROPMALFORMED", "SKIP"))
            p.add_argument("--lenient", dest="mode", action="store_const", const="SKIP")
        if output:
            p.add_argument("-o", "--output", required=True)
            p.add_argument("-b", "--bam", "--BAM", action="store_true")
        for names, options in specs:
            p.add_argument(*names.split(), **options)
        p.add_argument("--stdoutFile")
        p.add_argument("--stderrFile")
        p.set_defaults(run=f)

    number = lambda n: {"type": int, "default": n}
    flag = {"action": "store_true"}
    needed, some = {"required": True}, {"nargs": "*", "default": []}
    pairs = [
        ("files", {"nargs": "+"}), ("-h --hamming-distance", number(1)), ("-y --reverse-complement-i5", flag), ("--fixed-i5", {}), ("--fixed-i7", {}),
    ]
    clip = [
        ("-n --numBases", {"dest": "n"} | number(0)), ("-x --n1 --numBasesSpecial1", {"dest": "n1"} | number(0)), ("-s --library1 --libraries1", {"dest": "library1"} | some),
        ("-y --n2 --numBasesSpecial2", {"dest": "n2"} | number(0)), ("-t --library2 --libraries2", {"dest": "library2"} | some),
    ]
    records = "-i --input --input-filename --input_BAM"
    command(barcodecount, *pairs, ("-i --i5-indices", needed), ("-j --i7-indices", needed), ("-b --barcodes", needed))
    command(
        indexandbarcodescreener, *pairs, ("--i5-indices", needed), ("--i7-indices", needed), ("-b --barcodes", needed),
        ("-m --max-penalty --mismatch-penalty-max", {"dest": "max_penalty"} | number(3)), ("-j --penalty-high --mismatch-penalty-high", {"dest": "penalty_high"} | number(3)),
        ("-k --penalty-low --mismatch-penalty-low", {"dest": "penalty_low"} | number(1)), ("-q --quality-threshold --mismatch-quality-threshold", {"dest": "quality_threshold"} | number(20)),
        ("-o --min-overlap --minimum-overlap", {"dest": "min_overlap"} | number(15)), ("-l --min-length --minimum-length", {"dest": "min_length"} | number(30)),
        ("-n --outputs --number-output-files", {"dest": "outputs"} | number(25)), ("-c --prior-counts --barcode-count", {"dest": "prior_counts"}),
        ("-x --sample-sheet --index-barcode-keys", {"dest": "sample_sheet"}), ("-t --threshold --barcode-threshold", {"dest": "threshold", "type": float, "default": 0.05}),
        ("-z --oligo --positive-oligo", {"dest": "oligo"}), ("-r --read-group-file", {}), ("--disable-flowcell-lane-check", flag), ("--threads", number(1)),
    )
    command(aggregatestatistics, ("files", {"nargs": "+"}), ("-s --sort", {"default": "raw"}), ("-k --key", {}), ("-l --label", {"default": "raw"}))
    command(demultiplexsam, ("-s --statistics --statisticsFilename", {"dest": "statistics"} | needed), ("-f --barcodes --barcodeFile", {"dest": "barcodes"}),
            ("-n --number --numSamples", {"dest": "number"} | number(1000)), ("-r --minimum --minimumReads", {"dest": "minimum"} | number(1)),
            ("-t --threshold --thresholdReads", {"dest": "threshold"} | number(-1)), ("-e --explicit", {}), ("-b --bam --BAM", {"dest": "bam"} | flag),
            ("-c --compression", number(5)), ("-o --output --outputDirectory", {"dest": "output", "default": "."}), inputs="input")
    command(readmarkduplicatesstatistics, ("-l --label", {"default": "duplicates"}), inputs="input")
    command(samstats, ("-t --targets", needed), ("-q --min-mapq --mapping-quality", {"dest": "min_mapq"} | number(0)), ("-l --lengths --length-histogram", {"dest": "lengths"}), inputs="-f -i --filename --input")
    command(softclip, *clip, ("--hard", flag), inputs=records, output=True)
    command(hardclip, *clip, inputs=records, output=True)
    command(filtersam, *clip, ("-p --bed --positions", {"dest": "bed"} | needed), ("-m --min-mapq --minimum_mapping_quality", {"dest": "min_mapq"} | number(0)),
            ("-q --min-base-quality --minimum_base_quality", {"dest": "min_base_quality"} | number(0)), inputs=records, output=True)
    command(assignreadgroups, ("-s --sample", needed), ("-d --date", needed), ("-x --label", {"default": ""}), ("-l --library", {}),
            ("-q --center --sequencing-center", {"dest": "center"}), ("-p --platform --sequencing-platform", {"dest": "platform", "default": "ILLUMINA"}), inputs=records, output=True)
    command(duplicateshistogram, inputs=records)
    command(readgrouprewrite, ("-s --sample", {}), ("-l --library", {}), ("-q --center --sequencing-center", {"dest": "center"}),
            ("-p --platform --sequencing-platform", {"dest": "platform"}), inputs=records, output=True)
    command(duplicatestagrewrite, ("-l --p5-tag --p5-barcode-tag", {"dest": "p5_tag"}), ("-k --p7-tag --p7-barcode-tag", {"dest": "p7_tag"}), inputs=records, output=True)
    command(barcodemover, ("-t --tag", {"default": "XD"}), inputs=records, output=True)
    command(damagerestrict, ("-d --damage", {"type": float} | needed), ("-t --tag", {"default": "ds"}), inputs=records, output=True)
    command(alignmentcomparison, ("-c --check", needed), ("tags", {"nargs": "*"}), inputs="-i --input")
    command(version)
    return top


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args([argv[0].lower(), *argv[1:]] if argv else ["version"])
    with contextlib.ExitStack() as files:
        if args.stdoutFile:
            files.enter_context(contextlib.redirect_stdout(files.enter_context(open(args.stdoutFile, "w"))))
        if args.stderrFile:
            files.enter_context(contextlib.redirect_stderr(files.enter_context(open(args.stderrFile, "w"))))
        return args.run(None if args.command == "version" else _session(), args) or 0


if __name__ == "__main__":
    sys.exit(main())
