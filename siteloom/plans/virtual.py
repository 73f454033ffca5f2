"""Virtual tables over the driver's tables: the same SQL for both engines, integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "reads": """SELECT l_suppkey % 24 AS chrom, l_orderkey AS pos, CASE l_returnflag WHEN 'A' THEN 'L' WHEN 'R' THEN 'R' ELSE '-' END AS side,
        CAST(l_quantity AS INT) AS mapq, l_linestatus = 'F' AS is_rev, l_partkey % 24 AS mate_chrom, l_partkey AS mate_pos, l_orderkey + 20 + l_partkey % 80 AS read_end,
        CAST(l_partkey % 50 + 1 AS INT) AS clip_len, l_suppkey % 40 AS bx, l_suppkey % 10 AS rg, CAST(l_quantity AS INT) % 7 * 10 + 90 AS read_len FROM {lineitem}""",
    "repeats": """SELECT p_partkey % 24 AS chrom, p_partkey AS start, p_partkey + p_size AS "end", p_type AS family, p_brand AS subfamily, p_size % 20 AS div FROM {part}""",
    "samples": """SELECT c_custkey AS sample, r_name AS population FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "cohort": """SELECT o_custkey AS sample, o_custkey % 5 AS chrom, o_orderkey * 3 AS pos, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS dosage, o_orderpriority AS svtype FROM {orders}""",
    "calls": """SELECT o_custkey % 24 AS chrom, o_orderkey * 7 AS pos, CAST(o_orderkey % 3 AS INT) AS priority,
        CASE o_custkey % 3 WHEN 0 THEN 'two_side_tprt_both' WHEN 1 THEN 'one_half_side' ELSE 'two_side' END AS sub_type, o_custkey % 13 AS sample FROM {orders}""",
    "records": """SELECT l_suppkey % 24 AS chrom, l_orderkey * 10 + l_linenumber AS pos, CAST(l_partkey % 130 - 10 AS INT) AS tsd, l_orderkey * 10 + l_partkey % 60 AS lclip_pos, l_orderkey * 10 + l_suppkey % 200 AS rclip_pos,
        CAST(l_partkey % 7 AS INT) AS n_lclip, CAST(l_orderkey % 6 AS INT) AS n_rclip, CAST(l_suppkey % 9 AS INT) AS n_ldisc, CAST((l_partkey + l_orderkey) % 8 AS INT) AS n_rdisc,
        CAST(l_partkey % 9 - 4 AS INT) AS n_lpolya, CAST(l_orderkey % 7 - 3 AS INT) AS n_rpolya, CAST(l_partkey % 100 + 1 AS DOUBLE) AS lcov, CAST(l_orderkey % 110 + 1 AS DOUBLE) AS rcov, CAST(30 AS DOUBLE) AS mean_cov,
        CASE WHEN l_partkey % 5 > 0 THEN l_partkey * 7 % 6100 END AS lc_start, CASE WHEN l_partkey % 5 > 0 THEN l_partkey * 7 % 6100 + 20 END AS lc_end,
        CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey * 11 % 6100 END AS rc_start, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey * 11 % 6100 + 15 END AS rc_end,
        CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey * 37 % 6000 END AS ld_start, CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey * 37 % 6000 + 150 END AS ld_end,
        CASE WHEN (l_partkey + l_suppkey) % 5 > 0 THEN (l_partkey + l_orderkey) * 13 % 6000 END AS rd_start, CASE WHEN (l_partkey + l_suppkey) % 5 > 0 THEN (l_partkey + l_orderkey) * 13 % 6000 + 180 END AS rd_end,
        CASE l_partkey % 11 WHEN 0 THEN 'chr1:5-9~0~orphan' WHEN 1 THEN 'chr2:7-9~1~sibling' WHEN 2 THEN 'chr3:1-2~0' ELSE 'not_transduction' END AS td_src,
        CAST(l_partkey % 20 AS INT) AS n_af_clip, CAST(l_orderkey % 25 AS INT) AS n_full_map, CAST(l_partkey % 12 AS INT) AS n_l_raw, CAST(l_orderkey % 11 AS INT) AS n_r_raw, CAST(l_suppkey % 30 AS INT) AS n_disc,
        CAST((l_partkey + l_suppkey) % 60 AS INT) AS n_conc, CAST(l_orderkey % 15 AS INT) AS n_indel, CAST(l_partkey % 10 AS INT) AS ldisc_same, CAST(l_orderkey % 10 AS INT) AS ldisc_diff, CAST(l_suppkey % 10 AS INT) AS rdisc_same, CAST((l_partkey + 3) % 7 AS INT) AS rdisc_diff,
        l_partkey % 3 = 0 AS both_consistent, CASE (l_linenumber + l_partkey) % 10 WHEN 0 THEN 'two_side_tprt_both' WHEN 1 THEN 'two_side_tprt' WHEN 2 THEN 'two_side' WHEN 3 THEN 'one_half_side_tprt' WHEN 4 THEN 'one_half_side_tprt_both' WHEN 5 THEN 'one_side'
            WHEN 6 THEN 'orphan_or_sibling_transduction' WHEN 7 THEN 'one_side_and_half_transduction' WHEN 8 THEN 'polyA_dominant_both-side_may_low_confident' ELSE 'other_type_low_confident' END AS sub_type,
        CAST(l_partkey % 7 AS INT) AS n_all_lclip, CAST(l_orderkey % 6 AS INT) AS n_all_rclip, CAST(l_suppkey % 9 AS INT) AS n_all_ldisc, CAST((l_partkey + l_orderkey) % 8 AS INT) AS n_all_rdisc,
        CAST(l_partkey % 7 * (l_suppkey % 2) AS INT) AS n_all_lpolya, CAST(l_orderkey % 6 * (l_linenumber % 2) AS INT) AS n_all_rpolya, l_suppkey % 4 > 0 AS hit_end, l_orderkey % 2 = 0 AS within_copy, l_partkey % 4 = 0 AS td_novel,
        l_partkey % 23 = 0 AS in_blacklist, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey % 30 AS DOUBLE) END AS div FROM {lineitem}""",
    "evidence": """SELECT l_suppkey % 24 AS chrom, l_orderkey - l_orderkey % 400 AS site, l_orderkey AS ref, l_partkey % 200 + 5800 AS cns, CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END AS side, l_partkey % 3 AS sample,
        l_orderkey - l_orderkey % 400 + 200 AS clip_pos, l_orderkey AS anchor, l_returnflag = 'A' AS anchor_lclip, l_returnflag = 'R' AS anchor_rclip, l_linestatus = 'F' AS same_ori, l_quantity > 25 AS anchor_rc, l_partkey % 5 AS source,
        l_partkey % 24 AS mate_chrom, l_partkey AS mate_pos, CASE l_partkey % 3 WHEN 0 THEN 'Alu' WHEN 1 THEN 'L1' ELSE 'SVA' END AS family, l_partkey % 700 AS flank_at, CAST(l_quantity AS INT) % 4 AS n_polya,
        CAST(l_quantity AS INT) AS mapq, l_partkey % 40 AS bx, CAST(l_partkey % 4 AS INT) AS phase FROM {lineitem}""",
    # alignments with clips, an insertion or a deletion; the clipped bases of a fifth of them are all A or all T
    "alns": """SELECT 'q' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS qname, 'c' || CAST(l_suppkey % 24 AS VARCHAR) AS chrom, l_orderkey AS pos, CAST(l_quantity AS INT) AS mapq, l_partkey % 29 = 0 AS dup, l_partkey % 31 = 0 AS sec, l_suppkey % 17 = 0 AS sup,
        l_linestatus = 'F' AS rev, l_suppkey % 2 = 0 AS mate_rev, l_partkey % 37 = 0 AS mate_lost, CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN 'hs37d5' ELSE 'c' || CAST(l_partkey % 24 AS VARCHAR) END AS mate_chrom,
        CASE WHEN l_partkey % 37 > 0 THEN l_partkey * 3 END AS mate_pos, lead, tail, ins, del, 100 - lead - tail - ins AS m, CASE WHEN ins + del > 0 THEN 30 ELSE 100 - lead - tail - ins END AS m1, CAST(l_quantity AS INT) % 40 AS q,
        CASE WHEN l_suppkey % 5 = 0 THEN repeat('A', lead) ELSE substr(repeat('ACGGTTCAATC', 12), CAST(1 + l_partkey % 11 AS INT), lead) END || substr(repeat('ACGGTTCAATC', 12), CAST(1 + l_orderkey % 11 AS INT), 100 - lead - tail)
          || CASE WHEN l_suppkey % 5 = 0 THEN repeat('T', tail) ELSE substr(repeat('ACGGTTCAATC', 12), CAST(2 + l_partkey % 11 AS INT), tail) END AS seq
        FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey % 40 + 1 AS INT) WHEN l_linenumber = 7 THEN 10 ELSE 0 END AS lead, CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 40 + 1 AS INT) WHEN l_linenumber = 7 THEN 12 ELSE 0 END AS tail,
          CASE WHEN l_linenumber = 3 THEN 5 ELSE 0 END AS ins, CASE WHEN l_linenumber = 4 THEN 3 ELSE 0 END AS del FROM {lineitem})""",
    # a site for each order; its lines are the left and right flanks on the contigs of three groups of reads, and a left one of a fourth
    "flanks": """SELECT 'c' || CAST(l_orderkey % 24 AS VARCHAR) AS chrom, l_orderkey AS pos, CASE (l_linenumber - 1) // 2 WHEN 0 THEN 'all' WHEN 1 THEN 'hap1' WHEN 2 THEN 'hap2' ELSE 'unknown' END AS "group", CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS flank,
        'k' || CAST(p // 7 % 2 AS VARCHAR) AS contig, CAST(CASE WHEN l_linenumber % 2 = 1 THEN p * 7 % 700 ELSE p * 13 % 1100 END AS INT) AS start, CAST(CASE WHEN p % 6 = 0 THEN 120 ELSE p % 5 END AS INT) AS lead, CAST(CASE WHEN s % 7 = 0 THEN 110 ELSE s % 4 END AS INT) AS tail, CAST(s % 190 AS INT) AS lost,
        p % 3 = 0 AS rev, p % 53 = 0 AS sec FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
    "contigs": """SELECT 'c' || CAST(o_orderkey % 24 AS VARCHAR) AS chrom, o_orderkey AS pos, g AS "group", 'k' || CAST(k AS VARCHAR) AS contig, substr(repeat('ACGGTTCAATC', 200), CAST(1 + (o_orderkey + k) % 11 AS INT), CAST(900 + o_custkey % 600 AS INT)) AS seq
        FROM {orders}, (VALUES ('all', 0), ('all', 1), ('hap1', 0), ('hap1', 1), ('hap2', 0), ('hap2', 1), ('unknown', 0), ('unknown', 1)) AS x(g, k)""",
    # reads of two samples in windows of 400 bases: around each window's middle, mates lie together, or in repeats, or anywhere
    "moved": """SELECT CASE WHEN l_linenumber % 3 = 0 THEN 's1' ELSE 's0' END AS sample, 'c' || CAST(l_orderkey // 1000 % 24 AS VARCHAR) AS chrom, l_orderkey AS pos, l_orderkey - l_orderkey % 400 + 200 AS site, CASE WHEN l_partkey % 20 = 0 OR l_orderkey // 400 % 7 = 0 AND l_partkey % 3 = 0 THEN 5 ELSE 60 END AS mapq,
        l_partkey % 43 = 0 AS sec, (l_orderkey % 400 >= 175) <> (l_partkey % 9 = 0) AS rev, CASE WHEN l_returnflag = 'A' THEN 12 + CAST(l_partkey % 20 AS INT) ELSE 0 END AS lead, CASE WHEN l_returnflag = 'R' THEN 12 + CAST(l_partkey % 20 AS INT) ELSE 0 END AS tail, l_suppkey % 3 = 0 AS poly, l_partkey % 11 = 0 AS mate_lost,
        CASE WHEN l_partkey % 31 = 0 THEN 'hs37d5' WHEN l_orderkey // 400 % 5 = 0 AND l_orderkey % 400 >= 175 THEN 'c' || CAST(l_partkey % 24 AS VARCHAR) WHEN l_orderkey // 400 % 11 = 0 THEN 'c' || CAST(l_suppkey % 5 AS VARCHAR) ELSE 'c' || CAST(l_orderkey // 400 % 24 AS VARCHAR) END AS mate_chrom,
        CASE WHEN l_orderkey // 400 % 5 = 0 AND l_orderkey % 400 >= 175 THEN l_partkey ELSE 150000 + l_orderkey // 400 * 30 + l_partkey % 300 + CASE WHEN l_orderkey % 400 >= 175 THEN 3000 ELSE 0 END END AS mate_pos FROM {lineitem}""",
    # realigned parts of 60 bases on copies (the repeats) with flanks of 30, and on the consensus: by turns clips and mates
    "parts": """SELECT 'c' || CAST(l_suppkey % 24 AS VARCHAR) AS chrom, l_orderkey - l_orderkey % 100 + 50 AS site, l_orderkey AS ref_pos, 's' || CAST(l_partkey % 3 AS VARCHAR) AS sample, CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END AS side, l_linestatus = 'F' AS rc, CAST(l_quantity AS INT) AS mapq, l_partkey % 19 = 0 AS lost,
        CAST(l_partkey % 13 AS INT) AS lead, CAST(l_suppkey % 12 AS INT) AS tail, CAST(l_partkey % 110 AS INT) AS start, p_partkey % 24 AS copy_no, p_partkey AS copy_start, p_partkey + p_size AS copy_end, p_size % 3 = 0 AS copy_rc, p_size * 7 % 300 AS cns_start, p_size * 7 % 300 + p_size AS cns_end, l_suppkey % 4 = 0 AS decoy,
        l_orderkey % 3 = 0 AS mate_rc, l_orderkey % 2 = 0 AS anchor_rc, l_orderkey + CASE WHEN l_suppkey % 3 = 0 THEN 700 ELSE 4000 END AS src_start, l_orderkey + CASE WHEN l_suppkey % 3 = 0 THEN 1400 ELSE 4900 END AS src_end, CASE l_suppkey % 5 WHEN 0 THEN 'AAAAA' WHEN 1 THEN 'GGCGG' WHEN 2 THEN 'TTATT' WHEN 3 THEN 'CGTCG' ELSE 'AATAA' END || substr(repeat('ACGGTTCAATC', 9), CAST(1 + l_partkey % 11 AS INT), 50)
          || CASE l_partkey % 5 WHEN 0 THEN 'TTTTT' WHEN 1 THEN 'GGCGG' WHEN 2 THEN 'AAAAA' WHEN 3 THEN 'CGTCG' ELSE 'TTATT' END AS seq FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "places": """SELECT 'c' || CAST(c_custkey % 24 AS VARCHAR) AS chrom, c_custkey * 10 AS pos FROM {customer}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name].replace('"end"', "`end`").replace('"group"', "`group`").replace("VARCHAR", "STRING").replace(" // ", " DIV ")
    needed = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **needed)


def oracle_view(name: str) -> str:
    out = SQL[name]
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return out
