"""Readers of the text formats, as typed DataFrames; absent sentinels become nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators.intervals import overlaps


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), "value")
    return rows.filter((F.size("f") >= least) & ~F.col("value").startswith("#"))


def _int(c: Column) -> Column:
    return F.regexp_replace(c, r"[()]", "").try_cast("long")


def repeats(spark: SparkSession, path: str, left: int = 0, right: int = 0, most_div: float | None = None, least_length: int = 0, family: str | None = None) -> DataFrame:
    """A RepeatMasker table: rows of 15 fields and more, but headers; extended, and by divergence, length and family.

    Lengths are those before the extension.
    """
    rows = _fields(spark, path, 15).filter(~F.col("f")[0].isin("SW", "score"))
    rc = F.col("f")[8] == "C"
    out = rows.select(
        F.col("f")[4].alias("chrom"), _int(F.col("f")[5]).alias("start"), _int(F.col("f")[6]).alias("end"), F.col("f")[1].try_cast("double").alias("div"), rc.alias("is_rc"), F.col("f")[9].alias("subfamily"), F.col("f")[10].alias("family"),
        F.when(rc, _int(F.col("f")[13])).otherwise(_int(F.col("f")[11])).alias("cns_start"), _int(F.col("f")[12]).alias("cns_end"))
    out = out.filter(F.abs(F.col("end") - F.col("start")) >= least_length)
    if most_div is not None:
        out = out.filter(F.col("div") <= most_div)
    if family:
        out = out.filter(F.col("family").contains(family))
    return out.withColumns({"start": F.col("start") - left, "end": F.col("end") + right})


def bed(spark: SparkSession, path: str | None) -> DataFrame:
    """Half-open intervals; without a path none."""
    if not path:
        return spark.createDataFrame([], schema.INTERVAL)
    return _fields(spark, path, 3).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"))


def gff3(spark: SparkSession, path: str, extend: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Genes, extended to both sides, and the regions of genes (no transcripts)."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 9)
    attributes = F.str_to_map(F.col("f")[8], F.lit(";"), F.lit("="))
    rows = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("kind"), F.col("f")[3].cast("long").alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[6].alias("strand"),
                       F.try_element_at(attributes, F.lit("gene_id")).alias("gene_id"), F.try_element_at(attributes, F.lit("gene_name")).alias("gene_name"), F.try_element_at(attributes, F.lit("gene_type")).alias("gene_type"))
    genes = rows.filter("kind = 'gene'").withColumns({"gene_start": F.col("start"), "gene_end": F.col("end"), "start": F.col("start") - extend, "end": F.col("end") + extend}).drop("kind")
    return genes, rows.filter("kind not in ('gene', 'transcript')").drop("gene_type")


LINES = 1 << 16


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: the number of each line from 0, however the files are split.

    Splits count their own lines; what comes before a split is one row for each.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    counts = rows.groupBy("file", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i")) - 1
    return rows.withColumn("_k", own).join(counts, ["file", "_b"]).select("file", (F.col("_before") + F.col("_k")).alias("line"), "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, seq): the lines of each sequence, with the place of their first base; a long contig is many rows.

    A name line begins with ">" and may hold more of them.
    """
    rows = numbered(spark, path).withColumn("_tile", F.floor(F.col("line") / LINES))
    head = F.col("value").startswith(">")
    rows = rows.withColumns({"_name": F.when(head, F.split(F.substring("value", 2, 1 << 20), r"\s+")[0]), "_n": F.when(head, 0).otherwise(F.length(F.trim("value")))})
    inside = Window.partitionBy("file", "_tile").orderBy("line")
    till = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_own": F.last("_name", True).over(till), "_part": F.count("_name").over(till)})
    rows = rows.withColumn("_at", F.coalesce(F.sum("_n").over(Window.partitionBy("file", "_tile", "_part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row a tile: its last name, and the bases after it
    ends = rows.groupBy("file", "_tile").agg(F.max_by("_own", "line").alias("_last"), F.max_by(F.col("_at") + F.col("_n"), "line").alias("_tail"), F.max("_part").alias("_heads"))
    tiles = Window.partitionBy("file").orderBy("_tile")
    ends = ends.withColumns({"_carry": F.last("_last", True).over(tiles.rowsBetween(Window.unboundedPreceding, -1)), "_run": F.sum(F.when(F.col("_heads") > 0, 1).otherwise(0)).over(tiles)})
    sums = F.sum("_tail").over(Window.partitionBy("file", "_run").orderBy("_tile").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_sum", sums).withColumn("_bases", F.coalesce(F.lag("_sum").over(tiles), F.lit(0))).select("file", "_tile", "_carry", "_bases")
    out = rows.filter(~head & (F.col("_n") > 0)).join(ends, ["file", "_tile"])
    first = F.col("_own").isNull()
    return out.select(F.coalesce("_own", "_carry").alias("name"), (F.col("_at") + F.when(first, F.col("_bases")).otherwise(0)).cast("long").alias("offset"), F.trim("value").alias("seq")).filter("name is not null")


def fetch(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (chrom, start, end) with seq, the bases from start to before end of fasta()'s sequences; cut where a contig ends, null outside."""
    lines = sequences.select(F.col("name").alias("chrom"), F.col("offset").alias("start"), (F.col("offset") + F.length("seq")).alias("end"), "seq")
    wanted = regions.select("chrom", "start", "end").distinct()
    cut = F.substring(F.col("seq_b"), (F.greatest(F.col("start") - F.col("start_b"), F.lit(0)) + 1).cast("int"), (F.least("end", "end_b") - F.greatest("start", "start_b")).cast("int"))
    hits = overlaps(wanted, lines).select("chrom", "start", "end", F.struct(F.col("start_b").alias("at"), cut.alias("piece")).alias("x"))
    found = hits.groupBy("chrom", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["piece"]), "").alias("seq"))
    return regions.join(found, ["chrom", "start", "end"], "left")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of four-line records; reads of quality strings that begin with "@" do no harm."""
    rows = numbered(spark, path)

    def nth(n: int) -> Column:
        return F.max(F.when(F.col("line") % 4 == n, F.col("value")))

    out = rows.groupBy("file", F.floor(F.col("line") / 4).alias("_r")).agg(nth(0).alias("head"), nth(1).alias("seq"), nth(3).alias("qual"))
    return out.filter(F.col("head").startswith("@")).select(F.split(F.substring("head", 2, 1 << 20), r"\s+")[0].alias("name"), "seq", "qual")


def alignment_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, read groups) of SAM text: chrom, length, has_prefix; rg, sample."""
    rows = spark.read.text(path).filter(F.col("value").startswith("@"))
    tags = F.str_to_map(F.expr("substring(value, 5)"), F.lit("\t"), F.lit(":"))

    def tag(name: str) -> Column:
        return F.try_element_at(tags, F.lit(name))

    contigs = rows.filter(F.col("value").startswith("@SQ\t")).select(tag("SN").alias("chrom"), tag("LN").cast("long").alias("length")).withColumn("has_prefix", F.col("chrom").startswith("chr"))
    return contigs, rows.filter(F.col("value").startswith("@RG\t")).select(tag("ID").alias("rg"), tag("SM").alias("sample"))


def bam_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, platform) of a list of alignment files, illumina where no platform is named."""
    return _fields(spark, path, 1).filter(F.trim("value") != "").select(F.col("f")[0].alias("path"), F.coalesce(F.get("f", F.lit(1)), F.lit("illumina")).alias("platform"))


def benchmark_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos); lines that begin with # are skipped."""
    return _fields(spark, path, 2).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"))


def result_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample, path) of result files."""
    return _fields(spark, path, 2).select(F.col("f")[0].alias("sample"), F.col("f")[1].alias("path"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, strand, subtype) of a BED file of repeats: the last two fields are the strand and the subtype."""
    rows = _fields(spark, path, 5)
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.element_at("f", -2).alias("strand"), F.element_at("f", -1).alias("subtype"))


def basic_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, coverage, read_length, mean_is, std_is) of each alignment file, as sinks.write_basic_info() leaves them."""
    rows = _fields(spark, path, 5)
    return rows.select(F.col("f")[0].alias("path"), *(F.col("f")[k + 1].cast("double").alias(n) for k, n in enumerate(("coverage", "read_length", "mean_is", "std_is"))))


def genotype_features(spark: SparkSession, path: str, most_clips: int | None = None) -> DataFrame:
    """Genotype features as schema.FEATURES; most_clips: without sites that have more clip lengths."""
    rows = _fields(spark, path, 12)
    numbers = [f.name for f in schema.FEATURES]
    out = []
    for k, name in enumerate(numbers):
        v = F.col("f")[k]
        out.append((F.when(v == "none", F.array().cast("array<int>")).otherwise(F.split(v, ":").cast("array<int>")) if name == "clip_lens" else v if name == "chrom" else v.try_cast("long")).alias(name))
    df = rows.select(*out)
    return df if most_clips is None else df.filter(F.size("clip_lens") <= most_clips)


def arff(spark: SparkSession, path: str) -> DataFrame:
    """The data of an ARFF file; numbers as double, the class as text."""
    lines = spark.read.text(path)
    names = [r[0] for r in numbered(spark, path).filter(F.lower("value").startswith("@attribute")).orderBy("line").select(F.split("value", r"\s+")[1], "value").collect()]  # one row for each column
    data = lines.filter(~F.col("value").startswith("@") & ~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split("value", ",").alias("f"))
    return data.select(*(F.trim(F.col("f")[k]).alias(n) if k == len(names) - 1 else F.trim(F.col("f")[k]).try_cast("double").alias(n) for k, n in enumerate(names)))


def vcf(spark: SparkSession, path: str, main_contigs: bool = False) -> DataFrame:
    """Records with INFO as a map and GT; main_contigs drops names with HLA, Un or an underscore."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 8)
    out = rows.select(*(F.col("f")[k].alias(n) for k, n in enumerate(("chrom", "pos", "id", "ref", "alt", "qual", "filter"))), F.str_to_map(F.col("f")[7], F.lit(";"), F.lit("=")).alias("info"), F.split(F.get("f", F.lit(9)), ":")[0].alias("gt"))
    out = out.withColumn("pos", F.col("pos").cast("long"))
    return out.filter(~F.col("chrom").rlike("HLA|Un|_")) if main_contigs else out


def cohort(spark: SparkSession, files: DataFrame, names: list[str]) -> DataFrame:
    """Calls of many samples' VCF files (files: sample, path, a folder or a file for each) -> sample, chrom, pos, dosage and the named INFO keys.

    dosage is how many alleles of the genotype are 1; unknown ones count as none. Samples whose file doesn't exist raise an error.
    """
    listed = files.select("sample", "path").distinct().collect()  # one row a sample
    if not listed:
        return spark.createDataFrame([], "sample string, chrom string, pos long, dosage int" + "".join(f", {n} string" for n in names))
    rows = spark.read.text([r["path"] for r in listed]).select("value", F.col("_metadata.file_path").alias("_file")).filter(~F.col("value").startswith("#"))
    # a file belongs to the sample whose path its own begins with
    bare = F.regexp_replace(F.regexp_replace("_file", "^file:/+", "/"), "/[^/]*$", "")
    at = spark.createDataFrame([(str(r["sample"]), "/" + r["path"].removeprefix("file:").strip("/") if "://" not in r["path"] or r["path"].startswith("file:") else r["path"].rstrip("/")) for r in listed], "sample string, _at string")
    whole = F.regexp_replace("_file", "^file:/+", "/")
    f = F.split("value", "\t")
    own = rows.withColumn("_at", F.explode(F.array(bare, whole))).join(at, "_at")
    info = F.str_to_map(f[7], F.lit(";"), F.lit("="))
    gt = F.split(F.get(f, F.lit(9)), ":")[0]
    dosage = F.coalesce(F.regexp_count(gt, F.lit("1")), F.lit(0))
    return own.select("sample", f[0].alias("chrom"), f[1].cast("long").alias("pos"), dosage.cast("int").alias("dosage"), *(F.try_element_at(info, F.lit(n)).alias(n) for n in names))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith("##")).withColumnRenamed("value", "line")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate sites; lines of fewer than three fields are skipped, missing counts are null."""
    rows = _fields(spark, path, 3)
    names = [f.name for f in schema.CANDIDATE][2:]
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), *(F.get("f", F.lit(k + 2)).try_cast("long").alias(n) for k, n in enumerate(names)))


def sites(spark: SparkSession, path: str, least_length: int | None = None) -> DataFrame:
    """Site records from their text form: sentinels become nulls. least_length: only records whose last field is at least that."""
    rows = _fields(spark, path, 2)
    if least_length is not None:
        rows = rows.filter(F.element_at("f", -1).try_cast("long") >= least_length)
    out = []
    for k, field in enumerate(schema.SITE):
        v = F.get("f", F.lit(k))
        v = F.when(~v.isin("-1", "-1:-1", "none", "null", "NULL"), v)
        out.append(v.try_cast(field.dataType).alias(field.name))
    return rows.select(*out)


def before_filter(spark: SparkSession, path: str) -> DataFrame:
    """sinks.before_filter_lines() again: -1 is null."""
    def value(k: int, kind: str) -> Column:
        v = F.get("f", F.lit(k))
        return F.when(v != "-1", v).try_cast(kind)

    plain = [value(k, "string" if c == "chrom" else "long").alias(c) for k, c in enumerate(("chrom", "pos", "lclip_pos", "rclip_pos", "n_all_lclip", "n_all_rclip", "n_all_ldisc", "n_all_rdisc"))]
    ends = [F.split(F.get("f", F.lit(8 + k)), ":")[j].alias(f"{x}_{e}") for k, x in enumerate(("lc", "rc", "ld", "rd")) for j, e in enumerate(("start", "end"))]
    rows = _fields(spark, path, 12).select(*plain, *ends)
    return rows.select(*(F.when(F.col(c) != "-1", F.col(c)).try_cast("long").alias(c) if c[:2] in ("lc", "rc", "ld", "rd") and c.endswith(("_start", "_end")) else F.col(c) for c in rows.columns))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata; the first entry of a sample counts."""
    rows = _fields(spark, path, 4).withColumn("_k", F.monotonically_increasing_id())
    named = rows.select(*(F.col("f")[k].alias(x.name) for k, x in enumerate(schema.SAMPLE)), "_k")
    first = named.groupBy("sample").agg(F.min_by(F.struct("sex", "biosample", "population"), "_k").alias("x"))
    return first.select("sample", "x.*")


def alignments(spark: SparkSession, path: str, sample: str = "") -> DataFrame:
    """Alignments in SAM text (binary forms have to be converted first), as schema.READ; positions from 0."""
    from ..functions.cigar import parse_cigar

    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 11)
    f, flag = F.col("f"), F.col("f")[1].cast("int")

    def bit(n: int) -> Column:
        return flag.bitwiseAND(n) != 0

    tags = F.map_from_entries(F.array_distinct(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 20).alias("v")))))
    mate = F.when(f[6] == "=", f[2]).when(f[6] != "*", f[6])
    return rows.select(
        F.lit(sample).alias("sample"), f[0].alias("qname"), bit(64).alias("is_read1"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), bit(1024).alias("is_duplicate"), bit(4).alias("is_unmapped"), bit(8).alias("mate_is_unmapped"),
        bit(256).alias("is_secondary"), bit(2048).alias("is_supplementary"), bit(16).alias("is_reverse"), bit(32).alias("mate_is_reverse"), F.when(f[5] != "*", parse_cigar(f[5])).alias("cigar"), mate.alias("mate_chrom"), F.when(mate.isNotNull(), f[7].cast("long") - 1).alias("mate_pos"),
        f[8].cast("long").alias("tlen"), f[9].alias("seq"), F.when(f[10] != "*", F.transform(F.split(f[10], ""), lambda q: (F.ascii(q) - 33).cast("tinyint"))).alias("qual"), tags.alias("tags"))
