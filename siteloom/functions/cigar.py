"""Column expressions on alignments; cigar is an array of (op, len), ops 0 M, 1 I, 2 D, 4 S, 5 H."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cigar: Column, ops: tuple[int, ...], keep: bool = True) -> Column:
    """The lengths of the elements with these ops (or, not keep, without them) added up."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops) if keep else ~x["op"].isin(*ops)), F.lit(0), lambda s, x: s + x["len"])


def first(cigar: Column) -> Column:
    return F.get(cigar, F.lit(0))


def last(cigar: Column) -> Column:
    return F.try_element_at(cigar, F.lit(-1))


def left_clipped(cigar: Column, hard: bool = True) -> Column:
    return F.coalesce(first(cigar)["op"].isin(*((4, 5) if hard else (4,))), F.lit(False))


def right_clipped(cigar: Column, hard: bool = True) -> Column:
    return F.coalesce(last(cigar)["op"].isin(*((4, 5) if hard else (4,))), F.lit(False))


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos + total(cigar, (4, 5, 1), keep=False)


def right_breakpoint(pos: Column, cigar: Column) -> Column:
    """Where a right clip begins: all but the last element, without clips and insertions."""
    return pos + total(F.slice(cigar, F.lit(1), F.greatest(F.size(cigar) - 1, F.lit(0))), (4, 5, 1), keep=False)


def fully_mapped(cigar: Column) -> Column:
    return (F.size(cigar) == 1) & (first(cigar)["op"] == 0)


def both_sides_clipped(cigar: Column, n: int = 8) -> Column:
    return F.coalesce((F.size(cigar) > 1) & (first(cigar)["op"] == 4) & (first(cigar)["len"] > n) & (last(cigar)["op"] == 4) & (last(cigar)["len"] > n), F.lit(False))


def mapped_ratio(cigar: Column) -> Column:
    return total(cigar, (0,)) / F.nullif(total(cigar, (2,), keep=False), F.lit(0))


def contig_ratio(cigar: Column, flank: Column) -> Column:
    """The matched bases of a flank on a contig, of its length."""
    return total(cigar, (0,)) / F.nullif(flank, F.lit(0))


def clipped_part(seq: Column, cigar: Column, left: bool) -> Column:
    """The clipped bases of one end; null where it isn't soft-clipped."""
    end = first(cigar) if left else last(cigar)
    return F.when(end["op"] == 4, F.substring(seq, F.lit(1), end["len"]) if left else F.right(seq, end["len"]))


def large_clip(cigar: Column, least: int) -> Column:
    """An end with a clip over that many bases, of alignments of more than two elements."""
    def long(x: Column) -> Column:
        return F.coalesce(x["op"].isin(4, 5) & (x["len"] > least), F.lit(False))

    return (F.size(cigar) > 2) & (long(first(cigar)) | long(last(cigar)))


def qualified(cigar: Column, ratio: float) -> Column:
    """A realigned part counts: not clipped at both ends, and mapped for that share of its bases."""
    return ~both_sides_clipped(cigar) & (total(cigar, (0,)) >= ratio * total(cigar, (2,), keep=False))


def qualified_share(cigar: Column) -> Column:
    """The matched share of a sequence; 0 where the cigar has no bases of it."""
    return F.coalesce(mapped_ratio(cigar), F.lit(0.0))


def _place(cigar: Column, asked: Column, of: str, to: str) -> Column:
    """What lies at a place of `of`, told in `to`, for at (bases of the sequence) and on (of the reference, from 0); null outside of matches. The first element that holds it counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("on"), F.lit(None).cast("long").alias("hit"))

    def step(s: Column, x: Column) -> Column:
        here = x["op"].isin(0, 7, 8) & (s[of] <= asked) & (asked < s[of] + x["len"])
        return F.struct(
            (s["at"] + F.when(x["op"].isin(0, 1, 4, 7, 8), x["len"]).otherwise(0)).alias("at"), (s["on"] + F.when(x["op"].isin(0, 2, 3, 7, 8), x["len"]).otherwise(0)).alias("on"),
            F.coalesce(s["hit"], F.when(here, (s[to] + asked - s[of]).cast("long"))).alias("hit"))

    return F.aggregate(cigar, start, step, lambda s: s["hit"])


def to_reference(pos: Column, cigar: Column, at: Column) -> Column:
    """Where a base of the sequence (from 0) lies on the reference; null for clipped and inserted bases and beyond the ends."""
    return pos + _place(cigar, at, "at", "on")


def to_sequence(pos: Column, cigar: Column, on: Column) -> Column:
    """Which base of the sequence (from 0) lies at a place of the reference; null for deleted bases and beyond the ends."""
    return _place(cigar, on - pos, "on", "at")


def nearly_full(cigar: Column, n: int) -> Column:
    """One match, or a match with one clip of up to n."""
    clip = F.when(left_clipped(cigar), first(cigar)["len"]).when(right_clipped(cigar), last(cigar)["len"])
    other = F.when(left_clipped(cigar), last(cigar)["op"] == 0).when(right_clipped(cigar), first(cigar)["op"] == 0)
    return fully_mapped(cigar) | F.coalesce((clip <= n) & other, F.lit(False))


def large_indel(cigar: Column, n: int = 3) -> Column:
    return F.exists(F.slice(cigar, F.lit(1), F.greatest(F.size(cigar) - 1, F.lit(0))), lambda x: x["op"].isin(1, 2) & (x["len"] >= n))


def low_quality(qual: Column, least: int = 15) -> Column:
    """More than half of the bases are below."""
    return 2 * F.size(F.filter(qual, lambda q: q < least)) > F.size(qual)


def clip_length_ok(part: Column) -> Column:
    """Ten bases and more; seven to nine only if all are A, or all T."""
    n = F.length(part)
    return (n >= 10) | ((n >= 7) & part.rlike("^(?:A+|T+)$"))


def discordant(chrom: Column, pos: Column, mate_chrom: Column, mate_pos: Column, distance: int = 2000) -> Column:
    return (chrom != mate_chrom) | (F.abs(mate_pos - pos) > distance)


def discordant_by_template(chrom: Column, mate_chrom: Column, tlen: Column, insert_size: float, deviation: float) -> Column:
    return F.coalesce((mate_chrom != "*") & ((chrom != mate_chrom) | (F.abs(tlen) > insert_size + 3 * deviation)), F.lit(False))


def spans_site(chrom: Column, pos: Column, mate_chrom: Column, mate_pos: Column, site: Column, read_length: int, insert_size: int) -> Column:
    """A concordant pair whose fragment covers the site, with neither arm over the insert size."""
    start, end = F.least(pos, mate_pos), F.greatest(pos, mate_pos) + read_length
    return (chrom == mate_chrom) & (start <= site) & (site <= end) & (site - start <= insert_size) & (end - site <= insert_size)


def same_orientation(is_reverse: Column, mate_rc: Column, anchor_rc: Column) -> Column:
    return F.when(mate_rc, ~is_reverse).otherwise(is_reverse) != anchor_rc


def few_mismatches(md: Column, n: Column) -> Column:
    return F.length(F.regexp_replace(md, "[^A-Z]", "")) <= F.when(n >= 100, 2).otherwise(1)


def parse_cigar(text: Column) -> Column:
    """'20S80M' -> array of (op, len)."""
    ops = F.create_map(*(F.lit(x) for kv in zip("MIDNSHP", range(7)) for x in kv))
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP]"), F.lit(0)), lambda x: F.struct(F.element_at(ops, F.right(x, F.lit(1))).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def alternatives(xa: Column) -> Column:
    """An XA tag -> array of (chrom, is_rc, pos, cigar)."""
    items = F.filter(F.split(xa, ";"), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.split(x, ",")[0].alias("chrom"), F.split(x, ",")[1].startswith("-").alias("is_rc"), F.abs(F.split(x, ",")[1].cast("long")).alias("pos"), F.split(x, ",")[2].alias("cigar")))
