import random

import pytest

from siteloom.sources import sinks, text


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return f"file://{p}"


def test_repeats(spark, tmp_path):
    path = put(tmp_path, "r.out", "   SW  perc perc perc query x x x x x x x x x x\nscore div del ins seq b e l + r c b e l i\n\n 10 1.5 0 0 chr1 100 300 (5) + AluY SINE/Alu 1 200 (10) 1\n 10 2.5 0 0 chr1 100 220 (5) C L1HS LINE/L1 (7) 6000 5900 2\n")
    rows = sorted(text.repeats(spark, path, left=10, right=20, least_length=120).collect(), key=lambda r: r.end)
    assert [(r.start, r.end, r.is_rc, r.cns_start, r.div) for r in rows] == [(90, 240, True, 5900, 2.5), (90, 320, False, 1, 1.5)]
    assert text.repeats(spark, path, most_div=2).count() == 1 and text.repeats(spark, path, family="L1").count() == 1 and text.repeats(spark, path, least_length=150).count() == 1


def test_bed_and_none(spark, tmp_path):
    assert text.bed(spark, None).count() == 0
    assert text.bed(spark, put(tmp_path, "b.bed", "chr1\t5\t9\n# x\nchr2 7 8 z\n")).count() == 2


def test_gff3(spark, tmp_path):
    body = "##gff\nchr1\th\tgene\t2000\t3000\t.\t+\t.\tID=g;gene_id=G1;gene_name=A;gene_type=x\nchr1\th\ttranscript\t2000\t3000\t.\t+\t.\tgene_id=G1\nchr1\th\texon\t2000\t2100\t.\t+\t.\tgene_id=G1;gene_name=A\n"
    genes, regions = text.gff3(spark, put(tmp_path, "g.gff3", body))
    g = genes.first()
    assert (g.start, g.end, g.gene_id, g.gene_name) == (500, 4500, "G1", "A") and [r.kind for r in regions.collect()] == ["exon"]


@pytest.mark.parametrize("lines,split", [(1 << 16, None), (3, None), (2, 40)])
def test_fasta(spark, tmp_path, monkeypatch, lines, split):
    """Offsets don't depend on how the file is split or tiled; regions are cut from several lines."""
    rng = random.Random(2)
    whole = {f"c{i}": "".join(rng.choices("ACGT", k=n)) for i, n in enumerate((57, 0, 10, 203))}
    body = ">stray\n" + "".join(f">{name} more > of it\n" + "".join(seq[k : k + 10] + "\n" for k in range(0, len(seq), 10)) + "\n" for name, seq in whole.items())
    monkeypatch.setattr(text, "LINES", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = text.fasta(spark, put(tmp_path, "x.fa", body))
        got = {}
        for r in df.collect():
            assert whole[r.name][r.offset : r.offset + len(r.seq)] == r.seq
            got[r.name] = got.get(r.name, 0) + len(r.seq)
        assert got == {k: len(v) for k, v in whole.items() if v}
        regions = [("c0", 5, 38), ("c3", 0, 203), ("c3", 199, 300), ("c2", 4, 5), ("none", 1, 2)]
        back = {(r.chrom, r.start, r.end): r.seq for r in text.fetch(df, spark.createDataFrame(regions, "chrom string, start long, end long")).collect()}
        assert back == {(c, s, e): whole[c][s:e] if c in whole else None for c, s, e in regions}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", "ACGT", "@III"), ("r2", "AC", "+@")], "name string, seq string, qual string")
    sinks.write_fastq(df.coalesce(1), f"file://{tmp_path}/q")
    assert sorted(text.fastq(spark, f"file://{tmp_path}/q").collect()) == sorted(df.collect())


def test_headers_and_lists(spark, tmp_path):
    sam = put(tmp_path, "h.sam", "@HD\tVN:1\n@SQ\tSN:chr1\tLN:500\n@SQ\tSN:7\tLN:70\n@RG\tID:a\tSM:s1\n")
    contigs, groups = text.alignment_header(spark, sam)
    assert sorted(map(tuple, contigs.collect())) == [("7", 70, False), ("chr1", 500, True)] and list(map(tuple, groups.collect())) == [("a", "s1")]
    assert sorted(map(tuple, text.bam_list(spark, put(tmp_path, "b.txt", "/x.bam illumina\n/y.bam 10X\n/z.bam\n\n")).collect())) == [("/x.bam", "illumina"), ("/y.bam", "10X"), ("/z.bam", "illumina")]
    assert list(map(tuple, text.benchmark_sites(spark, put(tmp_path, "k.txt", "#c\nchr1 5 x\n")).collect())) == [("chr1", 5)]
    assert list(map(tuple, text.result_list(spark, put(tmp_path, "l.txt", "s1 /a.vcf\n")).collect())) == [("s1", "/a.vcf")]
    assert list(map(tuple, text.annotations(spark, put(tmp_path, "an.bed", "chr1\t5\t9\tx\t+\tAluY\n")).collect())) == [("chr1", 5, 9, "+", "AluY")]


def test_basic_info_and_features(spark, tmp_path):
    df = spark.createDataFrame([("/x.bam", 30.5, 100.0, 400.0, 50.5)], "path string, coverage double, read_length double, mean_is double, std_is double")
    sinks.write_basic_info(df, f"file://{tmp_path}/i")
    assert text.basic_info(spark, f"file://{tmp_path}/i").collect() == df.collect()
    path = put(tmp_path, "f.txt", "chr1 5 1 2 3 4 5 6 7 10:20:30 8 9\nchr1 6 1 2 3 4 5 6 7 none 8 9\n")
    got = {r.pos: (list(r.clip_lens), r.n_mate_chroms) for r in text.genotype_features(spark, path).collect()}
    assert got == {5: ([10, 20, 30], 9), 6: ([], 9)} and [r.pos for r in text.genotype_features(spark, path, 2).collect()] == [6]


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1.0, "0/1"), (0.25, None, "1/1")], "a double, b double, gt string")
    sinks.write_arff(df, f"file://{tmp_path}/a", "gt", ["0/1", "1/1"])
    assert sorted(map(tuple, text.arff(spark, f"file://{tmp_path}/a").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_population_lines(spark):
    alleles = spark.createDataFrame([("chr10", 5, "ALL", 4, 2, 0.5), ("chr10", 5, "b", 2, 1, 0.5), ("chr10", 5, "a", 2, 1, 0.5), ("chr2", 7, "ALL", 4, 1, 0.25)], "chrom string, site long, population string, an long, ac long, af double")
    modes = spark.createDataFrame([("chr10", 5, "INS"), ("chr2", 7, None)], "chrom string, site long, svtype string")
    got = [r.value.split("\t") for r in sinks.population_lines(alleles, modes).collect()]
    assert [x[0] for x in got] == ["chr2", "chr10"] and got[1][7] == "SVTYPE=INS;AN=4;AC=2;AF=0.5;AN_a=2;AC_a=1;AF_a=0.5;AN_b=2;AC_b=1;AF_b=0.5" and got[0][7] == "AN=4;AC=1;AF=0.25"
    assert sum(x.startswith("##INFO") for x in sinks.population_head([("chr1", 5)], ["a", "b"])) == 9


def test_candidates_without_decoys(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 5), ("chrUn_1", 6)], "chrom string, pos long")
    sinks.write_candidates(df, f"file://{tmp_path}/c", decoys=False)
    assert [r.pos for r in spark.read.parquet(f"file://{tmp_path}/c").collect()] == [5]


def test_vcf_round_trip(spark, tmp_path):
    rows = [("chr10", 5, "INS:ME:L1", 20, "two_side", 3, 4, "0/1"), ("chr2", 7, "INS:ME:L1", None, "two_side", 3, 4, "1/1")]
    df = spark.createDataFrame(rows, "chrom string, pos long, svtype string, ins_len int, sub_type string, n_af_clip int, n_full_map int, genotype string")
    path = f"file://{tmp_path}/out.vcf"
    sinks.write_vcf(df, path, sinks.vcf_head([("chr2", 10)], "s1", []))
    back = text.vcf(spark, path, main_contigs=True).collect()
    assert sorted((r.chrom, r.pos, r.info["SUBTYPE"], r.info.get("SVLEN"), r.gt) for r in back) == [("chr10", 5, "two_side", "20", "0/1"), ("chr2", 7, "two_side", None, "1/1")]
    assert [r.value.split("\t")[0] for r in sinks.vcf_lines(df).collect()] == ["chr2", "chr10"]
    assert text.vcf_header(spark, path).count() >= 2


def test_sites_sentinels(spark, tmp_path):
    from siteloom import schema

    n = len(schema.SITE)
    values = ["chr1", "7", "-1"] + ["-1"] * (n - 3)
    values[23] = "not_transduction"
    df = text.sites(spark, put(tmp_path, "s.txt", "\t".join(values) + "\n"))
    r = df.first()
    assert (r.chrom, r.pos, r.lclip_pos, r.lclip_cns) == ("chr1", 7, None, None)
    sinks.write_sites(df, f"file://{tmp_path}/back")
    assert text.sites(spark, f"file://{tmp_path}/back").collect() == df.collect()


def test_samples_first_wins(spark, tmp_path):
    assert text.samples(spark, put(tmp_path, "m.txt", "a M b1 EUR\na F b1 AFR\n")).first().population == "EUR"


def test_alignments(spark, tmp_path):
    body = "@HD\tVN:1\nq\t99\tchr1\t101\t60\t20S80M\t=\t301\t300\tACGT\tIIII\tBX:Z:AC-1\tNM:i:2\n"
    r = text.alignments(spark, put(tmp_path, "x.sam", body)).first()
    assert (r.pos, r.mate_chrom, r.mate_pos, r.is_read1, r.mate_is_reverse, r.cigar[0].op, list(r.qual), r.tags["BX"]) == (100, "chr1", 300, True, True, 4, [40] * 4, "AC-1")


def test_browser_script(spark):
    df = spark.createDataFrame([("chr1", 100)], "chrom string, pos long")
    assert "goto chr1:1-600" in sinks.browser_script(df, "/x").first().value
