"""Writers: text forms of the stages' tables, VCF, FASTA, browser scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.seq import is_decoy

#: INFO keys in their order, and the site columns they come from.
INFO = (("SVTYPE", "svtype"), ("SVLEN", "ins_len"), ("END", "end"), ("TSD", "tsd_seq"), ("TSDLEN", "tsd"), ("SUBTYPE", "sub_type"), ("TD_SRC", "td_src"), ("STRAND", "strand"), ("AF", "af"), ("LCLIP", "n_lclip"), ("RCLIP", "n_rclip"), ("LDISC", "n_ldisc"), ("RDISC", "n_rdisc"),
        ("LPOLYA", "n_lpolya"), ("RPOLYA", "n_rpolya"), ("LRAWCLIP", "n_l_raw"), ("RRAWCLIP", "n_r_raw"), ("AF_CLIP", "n_af_clip"), ("AF_FMAP", "n_full_map"), ("AF_DISC", "n_disc"), ("AF_CONCORDNT", "n_conc"), ("LDRC", "ldisc_same"), ("LDNRC", "ldisc_diff"), ("RDRC", "rdisc_same"),
        ("RDNRC", "rdisc_diff"), ("LCOV", "lcov"), ("RCOV", "rcov"), ("LD_AKR_RC", "lanchor_rc"), ("LD_AKR_NRC", "lanchor_nrc"), ("RD_AKR_RC", "ranchor_rc"), ("RD_AKR_NRC", "ranchor_nrc"), ("LC_CLUSTER", "lclip_cns"), ("RC_CLUSTER", "rclip_cns"), ("LD_CLUSTER", "ldisc_cns"),
        ("RD_CLUSTER", "rdisc_cns"), ("NINDEL", "n_indel"), ("CLIP_LEN", "clip_lens"), ("INS_INV", "inversion"), ("REF_REP", "ref_copy"), ("GENE_INFO", "gene"))


def allele_frequency() -> Column:
    return F.col("n_af_clip") / F.nullif(F.col("n_af_clip") + F.col("n_full_map"), F.lit(0))


def vcf_lines(records: DataFrame) -> DataFrame:
    """Site records -> VCF lines, sorted by contig in natural order and position. Keys without a value are left out; a column without one is "."."""
    have = set(records.columns)
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in INFO if c in have]
    number = F.regexp_extract("chrom", r"^(?:chr)?(\d+)$", 1).try_cast("int")
    line = F.concat_ws("\t", F.coalesce("chrom", F.lit(".")), F.coalesce(F.col("pos").cast("string"), F.lit(".")), F.lit("."), F.coalesce(F.col("ref") if "ref" in have else F.lit(None).cast("string"), F.lit(".")), F.coalesce(F.concat(F.lit("<"), F.col("svtype"), F.lit(">")), F.lit(".")), F.lit("."), F.lit("PASS"), F.when(F.concat_ws(";", *pairs) != "", F.concat_ws(";", *pairs)).otherwise("."), F.lit("GT"), F.coalesce("genotype", F.lit("./.")))
    return records.select(line.alias("value"), F.coalesce(number, F.lit(10**6)).alias("_n"), "chrom", "pos").orderBy("_n", "chrom", "pos").select("value")


def vcf_head(contigs: list[tuple[str, int]], sample: str, types: list[tuple[str, str]]) -> list[str]:
    out = ["##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={k}>" for n, k in contigs), *(f'##ALT=<ID={i},Description="{d}">' for i, d in types)]
    return [*out, "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample))]


def write_vcf(records: DataFrame, path: str, head: list[str]) -> None:
    """A folder of part files in order; the head is the first one's start."""
    spark = records.sparkSession
    first = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    first.unionByName(vcf_lines(records)).write.mode("overwrite").text(path)


def write_sites(records: DataFrame, path: str, high_confident: bool = False) -> None:
    """The text form: tab-separated, nulls as their sentinels. high_confident: those with both ends consistent beside it as well."""
    out = []
    for field in schema.SITE:
        missing = "-1:-1" if field.name.endswith("_cns") else "not_transduction" if field.name == "td_src" else "-1" if field.dataType.typeName() in ("integer", "long", "double") else "none"
        out.append(F.coalesce(F.col(field.name).cast("string"), F.lit(missing)))
    line = F.concat_ws("\t", *out).alias("value")
    records.select(line).write.mode("overwrite").text(path)
    if high_confident:
        records.filter("consistent = 'both_end_consistent'").select(line).write.mode("overwrite").text(f"{path}.high_confident")


def original_site_lines(records: DataFrame) -> DataFrame:
    """Records with `site`, the position that they were found by -> text lines of contig, that position, the refined one and both breakpoints; missing ones as -1."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in ("chrom", "site", "pos", "lclip_pos", "rclip_pos")]
    return records.select(F.concat_ws("\t", *cells).alias("value"))


def before_filter_lines(records: DataFrame) -> DataFrame:
    """Records before the filter -> text lines of contig, position, breakpoints, counts of clips and pairs by side, and the four clusters as start:end; missing ones as -1."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in ("chrom", "pos", "lclip_pos", "rclip_pos", "n_all_lclip", "n_all_rclip", "n_all_ldisc", "n_all_rdisc")]
    clusters = [F.concat_ws(":", *(F.coalesce(F.col(f"{x}_{e}").cast("string"), F.lit("-1")) for e in ("start", "end"))) for x in ("lc", "rc", "ld", "rd")]
    return records.select(F.concat_ws("\t", *plain, *clusters).alias("value"))


def deletion_lines(deletions: DataFrame) -> DataFrame:
    """Paired deletions (chrom, start, end; an open end is -1) -> text lines."""
    return deletions.select(F.concat_ws("\t", F.coalesce("chrom", F.lit(".")), *(F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in ("start", "end"))).alias("value"))


def write_candidates(df: DataFrame, path: str, decoys: bool = True) -> None:
    """Candidates by contig; without decoys, contigs that aren't chromosomes are left out."""
    (df if decoys else df.filter(~is_decoy(F.col("chrom")))).write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """df (name, seq, qual) as four-line records."""
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path)


def write_basic_info(df: DataFrame, path: str) -> None:
    """Library statistics of each alignment file, for text.basic_info()."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("path", "coverage", "read_length", "mean_is", "std_is"))).alias("value")).write.mode("overwrite").text(path)


def write_coverage(df: DataFrame, path: str) -> None:
    """Depths by site as schema.COVERAGE, tab-separated; null as 0.0."""
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("0.0")) for f in schema.COVERAGE]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def write_arff(df: DataFrame, path: str, label: str, classes: list[str]) -> None:
    """Numeric columns, then the class, as one ARFF text; the head is the first file's start."""
    names = [c for c in df.columns if c != label]
    head = "\n".join(["@RELATION genotype", *(f"@ATTRIBUTE {c} NUMERIC" for c in names), f"@ATTRIBUTE {label} {{{','.join(classes)}}}", "@DATA"])
    data = df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in [*names, label])).alias("value"))
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).unionByName(data).write.mode("overwrite").text(path)


def population_lines(alleles: DataFrame, modes: DataFrame) -> DataFrame:
    """population.allele_counts() and population.site_modes() -> VCF lines: AN, AC and AF in all, then by population in the order of their names."""
    part = F.concat_ws(";", *(F.concat(F.lit(f"{k}_"), "population", F.lit("="), F.col(c).cast("string")) for k, c in (("AN", "an"), ("AC", "ac"), ("AF", "af"))))
    whole = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("AN", "an"), ("AC", "ac"), ("AF", "af"))))
    by = alleles.groupBy("chrom", "site").agg(F.max(F.when(F.col("population") == "ALL", whole)).alias("all"), F.sort_array(F.collect_list(F.when(F.col("population") != "ALL", F.struct("population", part.alias("x"))))).alias("parts"))
    rows = by.join(modes.select("chrom", "site", "svtype"), ["chrom", "site"], "left")
    chrom = F.col("chrom").cast("string")
    info = F.concat_ws(";", F.concat(F.lit("SVTYPE="), "svtype"), "all", F.transform("parts", lambda x: x["x"]))
    line = F.concat_ws("\t", chrom, F.col("site").cast("string"), F.lit("."), F.lit("."), F.concat(F.lit("<"), F.coalesce("svtype", F.lit("INS")), F.lit(">")), F.lit("."), F.lit("PASS"), info)
    number = F.regexp_extract(chrom, r"^(?:chr)?(\d+)$", 1).try_cast("int")
    return rows.select(line.alias("value"), F.coalesce(number, F.lit(10**6)).alias("_n"), "chrom", "site").orderBy("_n", "chrom", "site").select("value")


def population_head(contigs: list[tuple[str, int]], populations: list[str]) -> list[str]:
    counts = [("AN", "Integer", "Alleles"), ("AC", "Integer", "Alleles with the insertion"), ("AF", "Float", "Frequency of the insertion")]
    info = [f'##INFO=<ID={k}{p and "_" + p},Number=1,Type={t},Description="{d}{p and " in " + p}">' for p in ["", *populations] for k, t, d in counts]
    return ["##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={k}>" for n, k in contigs), *info, "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))]


def write_matrix(columns: DataFrame, path: str) -> None:
    """A block of population.dosage_columns() as CSV with a header; one file a block."""
    columns.orderBy("sample").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def browser_script(sites: DataFrame, out_dir: str, extend: int = 500) -> DataFrame:
    """Lines of a batch script that takes a picture of each site."""
    a, b = (F.greatest(F.col("pos") - extend, F.lit(1)).cast("string"), (F.col("pos") + extend).cast("string"))
    at = F.col("pos").cast("string")
    return sites.select(F.concat(F.lit("goto "), F.col("chrom"), F.lit(":"), a, F.lit("-"), b, F.lit(f"\nsnapshotDirectory {out_dir}\nsnapshot "), F.col("chrom"), F.lit("_"), at, F.lit(".png")).alias("value"))
