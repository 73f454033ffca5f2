"""Typed schemas of the stages' tables. Missing values are nulls; text sinks write the sentinels."""

from pyspark.sql import types as T

CIGAR = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("len", T.IntegerType())]))


_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "array<int>": T.ArrayType(T.IntegerType()), "array<tinyint>": T.ArrayType(T.ByteType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(spec: str) -> T.StructType:
    """'name type, ...' as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in spec.split(", "))])


READ = T.StructType([*struct("sample string, qname string, is_read1 boolean, chrom string, pos long, mapq int, is_duplicate boolean, is_unmapped boolean, mate_is_unmapped boolean, is_secondary boolean, is_supplementary boolean, is_reverse boolean, mate_is_reverse boolean"),
                     T.StructField("cigar", CIGAR), *struct("mate_chrom string, mate_pos long, tlen long, seq string, qual array<tinyint>, tags map<string,string>")])
INTERVAL = struct("chrom string, start long, end long")
REPEAT = struct("chrom string, start long, end long, div double, is_rc boolean, subfamily string, family string, cns_start long, cns_end long")
CLIP_POSITION = struct("chrom string, pos long, n_l long, n_r long, n_mate long")
CANDIDATE = struct("chrom string, pos long, n_l long, n_r long, n_mate long, n_ldisc long, n_rdisc long")
COVERAGE = struct("chrom string, pos long, lcov_200 double, rcov_200 double, lcov_900 double, rcov_900 double")
FEATURES = struct("chrom string, pos long, n_af_clip long, n_full_map long, n_l_raw long, n_r_raw long, n_disc long, n_conc long, n_large_indel long, clip_lens array<int>, n_polya long, n_mate_chroms long")
SAMPLE = struct("sample string, sex string, biosample string, population string")

#: The 48 columns of a site record, in the order of its text form, then copy label, gene and genotype.
SITE = struct(
    "chrom string, pos long, lclip_pos long, rclip_pos long, tsd int, n_all_lclip int, n_all_rclip int, n_all_ldisc int, n_all_rdisc int, n_all_lpolya int, n_all_rpolya int, lcov double, rcov double, "
    "n_lclip int, n_rclip int, n_ldisc int, n_rdisc int, n_lpolya int, n_rpolya int, lclip_cns string, rclip_cns string, ldisc_cns string, rdisc_cns string, td_src string, n_td_clip int, n_td_disc int, n_td_polya int, "
    "ldisc_same int, ldisc_diff int, rdisc_same int, rdisc_diff int, inversion string, sub_type string, consistent string, hit_end string, n_af_clip int, n_full_map int, n_l_raw int, n_r_raw int, n_disc int, n_conc int, n_indel int, clip_lens string, "
    "lanchor_rc int, lanchor_nrc int, ranchor_rc int, ranchor_nrc int, ins_len int, ref_copy string, gene string, genotype string")
