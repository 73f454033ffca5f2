"""Site rules on records made by hand, one for each rung; the reasons are worked out from the rules' definition."""

import pytest
from pyspark.sql import functions as F

from siteloom.config import Config
from siteloom.operators import consistency, rules

#: A record that passes all cascades.
GOOD = dict(n_all_lclip=6, n_all_rclip=6, n_all_ldisc=6, n_all_rdisc=6, n_all_lpolya=2, n_all_rpolya=0, n_lpolya=2, n_rpolya=0, lcov=30.0, rcov=30.0, mean_cov=30.0, lc_start=5900, lc_end=6010, rc_start=5600, rc_end=5700,
            ld_start=5800, ld_end=6005, rd_start=5500, rd_end=5690, td_src="not_transduction", sub_type="two_side_tprt_both", both_consistent=True, hit_end=True, n_af_clip=12, n_full_map=20, n_l_raw=6, n_r_raw=6, n_disc=12, n_conc=20,
            n_indel=0, in_blacklist=False, div=None, within_copy=False, td_novel=False, k_lcov=30.0, k_rcov=30.0, k_n_af_clip=0, k_n_full_map=30, k_n_l_raw=0, k_n_r_raw=0, k_n_disc=0, k_n_polya=0)
TYPES = {bool: "boolean", int: "int", float: "double", str: "string"}
SCHEMA = ", ".join(f"{k} {TYPES.get(type(v), 'double')}" for k, v in GOOD.items()) + ", expected string"


def reasons(spark, cascade, cases):
    rows = [tuple({**GOOD, **change}.values()) + (expected,) for expected, change in cases]
    out = rules.post_filter(spark.createDataFrame(rows, SCHEMA).withColumn("_k", F.monotonically_increasing_id()), cascade).orderBy("_k").collect()
    assert [(r.expected, r.reason) for r in out] == [(e, e) for e, _ in cases]


POLYA = dict(n_all_lpolya=6, n_all_rpolya=6, n_lpolya=3, n_rpolya=3)
SAME_PLACE = dict(lc_start=5960, lc_end=6010, rc_start=5955, rc_end=6000, ld_start=5960, ld_end=6005, rd_start=5955, rd_end=6000)


def test_l1(spark):
    td = dict(td_src="chr1:5-9~0")
    reasons(spark, rules.l1_rules(), [
        (None, {}), ("blacklist", dict(in_blacklist=True)), (None, dict(sub_type="orphan_or_sibling_transduction", n_all_lpolya=0, hit_end=False)),
        ("td_in_copy", {**td, "div": 6.0, "within_copy": True, "both_consistent": False}), (None, {**td, "div": 6.0, "within_copy": False, "lc_end": 6010}), ("td_polya", {**td, "n_disc": 1, "n_conc": 20}), ("td_polya", {**td, "sub_type": "two_side_tprt", **POLYA}),
        (None, {**td, "td_novel": True, "hit_end": False, "n_all_lpolya": 0}), ("td_one_side", {**td, "td_novel": True, "sub_type": "one_side"}), ("two_side_end", {**td, "hit_end": False}),
        ("no_polya_no_end", dict(n_all_lpolya=0, hit_end=False)), ("two_side_polya", {**POLYA, **SAME_PLACE}), (None, {**POLYA, **SAME_PLACE, "n_rpolya": -3}), (None, {**POLYA, "lc_start": None, "lc_end": None}), ("two_side_end", dict(hit_end=False)),
        ("two_side_af", dict(n_disc=1, n_conc=20, n_all_ldisc=0)), ("two_side_af", dict(n_af_clip=0)), ("two_side_copy", dict(div=14.0, both_consistent=False)), (None, dict(div=14.0)), (None, dict(div=20.0)), ("one_half_copy", dict(div=14.0, sub_type="one_half_side")),
        ("one_half_polya", {**POLYA, **SAME_PLACE, "sub_type": "one_half_side_tprt"}), ("one_side_copy", dict(div=0.0, sub_type="one_side")), ("other", dict(sub_type="other_type_low_confident")),
        ("tail_same_way", {**SAME_PLACE, "n_rpolya": 1, "lcov": 70.0}), (None, {**SAME_PLACE, "n_rpolya": 1}), ("copy_without_tail", dict(div=20.0, lc_end=5900, rc_end=5700)), (None, dict(div=20.0, lc_start=None, lc_end=None)),
    ])
    reasons(spark, rules.l1_rules(Config(tumor=True)), [(None, {**td, "td_novel": True, "sub_type": "one_side"}), (None, dict(n_disc=2, n_conc=98, n_all_ldisc=1, n_all_rdisc=0))])


def test_alu(spark):
    one = dict(sub_type="one_side")
    at = dict(lc_start=200, lc_end=280, rc_start=100, rc_end=150)
    reasons(spark, rules.alu_rules(), [
        (None, {}), ("two_side_polya", {**POLYA, **SAME_PLACE}), ("two_side_polya", {**POLYA, **SAME_PLACE, "sub_type": "one_half_side"}), ("two_side_af", dict(n_full_map=1000)), ("two_side_no_polya", dict(n_all_lpolya=0, lc_end=100, rc_end=200)), (None, dict(n_all_lpolya=0, lc_end=100, rc_end=201)),
        ("two_side_no_polya", dict(n_all_lpolya=0, lc_start=None, lc_end=None, rc_end=250)), ("low_copy", {**one, "div": 1.0}), ("one_side_polya", {**one, "n_all_lclip": 0, "n_all_rclip": 0, "n_all_lpolya": 0}), ("one_side_polya", {**one, "n_all_lclip": 0, "n_all_rpolya": 6}),
        (None, {**one, "n_all_lclip": 0, "n_all_rpolya": 6, "n_af_clip": 10}), ("copy_no_polya", {**one, "div": 30.0, "n_all_lpolya": 0}), ("other", dict(sub_type="other_type_low_confident")), ("copy_both_tails", dict(div=30.0, lc_start=256, lc_end=280, rc_start=257, rc_end=281)),
        (None, {**at, "div": 30.0, "rc_start": 255}), ("copy_without_tail", dict(div=30.0, lc_start=10, lc_end=254, rc_start=20, rc_end=30)), ("indels", dict(n_indel=10, lcov=61.0)), (None, dict(n_indel=9, lcov=61.0)), (None, dict(n_indel=10, lcov=60.0)),
    ])


def test_sva_and_mosaic(spark):
    tail = dict(lc_start=1950, lc_end=2000, rc_start=1500, rc_end=1600)
    reasons(spark, rules.sva_rules(), [
        (None, {}), ("two_side_polya", {**POLYA, "sub_type": "two_side"}), ("two_side_polya", POLYA), (None, {**POLYA, "ld_start": 300}), ("no_polya", dict(n_all_lpolya=0)), ("low_copy", dict(div=1.0, sub_type="one_half_side")), ("one_half_polya", {**POLYA, "sub_type": "one_half_side"}),
        ("one_side_td", dict(sub_type="one_side", td_src="chr1:5-9~0")), ("other", dict(sub_type="other_type_low_confident")), ("copy_both_tails", {**tail, "div": 20.0, "rc_start": 1900}), ("copy_both_heads", {**tail, "div": 20.0, "lc_start": 1899}), (None, {**tail, "div": 20.0}), (None, {**tail, "div": 20.0, "rc_start": None, "rc_end": None}),
    ])
    low = dict(n_af_clip=3, n_full_map=97, n_disc=3, n_conc=97)
    reasons(spark, rules.mosaic_rules(), [(None, low), ("no_polya", {**low, "n_all_lpolya": 0}), ("clip_af", {**low, "n_af_clip": 1}), ("clip_af", {**low, "n_af_clip": 0, "n_full_map": 0}), ("disc_af", {**low, "n_disc": 60}), ("two_side_polya", {**low, **POLYA, **SAME_PLACE}), ("one_half_copy", {**low, "sub_type": "one_half_side", "div": 40.0}),
                                          ("one_half_polya", {**low, **POLYA, **SAME_PLACE, "sub_type": "one_half_side"}), ("one_side_copy", {**low, "sub_type": "one_side", "div": 40.0}), ("other", {**low, "sub_type": "other_type_low_confident"})])
    reasons(spark, rules.mosaic_rules("SVA"), [(None, {**low, **POLYA, **SAME_PLACE, "sub_type": "one_half_side"})])


def test_case_control(spark):
    td = dict(td_src="chr1:5-9~0")
    reasons(spark, rules.case_control_rules(), [
        (None, {}), ("no_coverage", dict(lcov=0.0, rcov=0.0)), ("few_effective_disc", dict(n_all_ldisc=1, n_all_rdisc=0)), ("orphan_disc", dict(td_src="orphan", n_all_rdisc=1)), ("orphan_clip", dict(td_src="orphan", n_l_raw=1)), ("few_disc", dict(n_disc=4)), ("effective_share", dict(n_disc=200, n_all_ldisc=2, n_all_rdisc=2)),
        (None, dict(n_disc=200, n_all_ldisc=2, n_all_rdisc=2, td_src="sibling")), ("no_control", dict(k_lcov=None)), ("control_no_coverage", dict(k_lcov=0.0, k_rcov=0.0)), ("control_has_both", dict(k_n_disc=5, k_n_af_clip=5)), (None, dict(k_n_disc=5, k_n_l_raw=5, k_n_polya=0)), ("control_has_both", {**td, "k_n_disc": 5, "k_n_l_raw": 5}),
        (None, {**td, "k_n_disc": 5, "k_n_af_clip": 5}), ("control_polya", dict(k_n_polya=19)), ("control_af", dict(k_n_disc=6, k_n_af_clip=0, k_n_full_map=0)), ("control_raw_clip", dict(k_n_disc=1, k_n_l_raw=40, k_n_full_map=2, k_n_polya=18)), (None, dict(k_n_disc=0, k_n_l_raw=40, k_n_full_map=2, k_n_polya=18)),
        ("no_polya_control_clip", dict(n_all_lpolya=0, k_n_l_raw=11, k_n_full_map=20)), (None, dict(n_all_lpolya=0, k_n_l_raw=10, k_n_full_map=20)),
    ])


def test_evidence(spark):
    """Clips of the left side go with pairs of the right one."""
    near = dict(lc_start=1000, lc_end=1050, rd_start=1100, rd_end=1300, rc_start=4000, rc_end=4050, ld_start=3800, ld_end=3900)
    td = dict(td_src="chr1:5-9~0")
    steps, marks = consistency.evidence_rules(2, 3, 550, 5950)
    reasons(spark, steps, [
        (None, {**near, "ld_end": 5950}), ("td_depth", {**td, "lcov": 19.5}), (None, {**td, "lcov": 19.6}), ("no_side_consistent", {**near, "rd_start": 9000, "rd_end": 9100, "ld_start": 9000, "ld_end": 9100}), ("no_side_consistent", {**near, "n_all_rdisc": 2, "n_all_ldisc": 2}),
        ("no_polya", {**near, "n_all_lpolya": 0}), ("no_end", near), (None, {**near, "n_all_rclip": 1, "lcov": 10.0}), ("no_end", {**near, "n_all_rclip": 1}), (None, {**near, "n_all_ldisc": 2}),
    ])
    rows = spark.createDataFrame([tuple({**GOOD, **near, "ld_end": 5950}.values()) + ("",)], SCHEMA).select(*(m.alias(k) for k, m in marks.items())).first()
    assert tuple(rows) == (True, False, True)


@pytest.mark.parametrize("change,length", [({}, 410), (dict(lc_start=None, lc_end=None), 505), (dict(lc_start=None, lc_end=None, rd_start=None, rd_end=None, rc_start=None, rc_end=None), 0), (dict(td_src="chr1:5-9~0"), 550), (dict(td_src="chr1:5-9~0", rd_start=None, rd_end=None), 250)])
def test_insertion_length(spark, change, length):
    row = spark.createDataFrame([tuple({**GOOD, **change}.values()) + ("",)], SCHEMA).select(rules.insertion_length(6050).alias("n")).first()
    assert row.n == length
