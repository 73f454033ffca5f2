"""Column expressions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(F.upper(seq), F.lit(base), F.lit("")))


def is_poly_a_t(seq: Column, ratio: float = 0.75) -> Column:
    """More than that share of A, or of T."""
    return (_count(seq, "A") > ratio * F.length(seq)) | (_count(seq, "T") > ratio * F.length(seq))


def has_run_a_t(seq: Column, n: int) -> Column:
    return F.upper(seq).rlike(f"A{{{n},}}|T{{{n},}}")


#: Fixed motifs that count as consecutive A or T.
POLY_A, POLY_T = ("AAAAA", "AATAA"), ("TTTTT", "TTATT")
SIGNAL_A, SIGNAL_T = ("AATAAA", "AAAAAA", "ATTAAA"), ("TTTATT", "TTTTTT", "TTTAAT")


def has_any(seq: Column, motifs: tuple[str, ...]) -> Column:
    return seq.rlike("|".join(motifs))


def consecutive_a_t(seq: Column) -> Column:
    return has_any(seq, POLY_A + POLY_T)


def consecutive_with_base(seq: Column) -> Column:
    """(hit, is_a): A is tested first."""
    a, t = has_any(seq, POLY_A), has_any(seq, POLY_T)
    return F.struct((a | t).alias("hit"), a.alias("is_a"))


def enough_a_t(seq: Column, n: int) -> Column:
    return (_count(seq, "A") >= n) | (_count(seq, "T") >= n)


def enough_a_t_of(seq: Column, n: Column) -> Column:
    """As enough_a_t(), with a number for each row."""
    return (_count(seq, "A") >= n) | (_count(seq, "T") >= n)


def polya_at(seq: Column, left: Column, n: int = 20) -> Column:
    """Whether the n bases nearest the breakpoint, the end of a left clip or the start of a right one, have consecutive A or T."""
    return consecutive_a_t(F.when(left, F.right(seq, F.lit(n))).otherwise(F.substring(seq, 1, n)))


def is_short_contig(chrom: Column, most: int = 5) -> Column:
    """Names of up to `most` characters are kept as chromosomes; longer ones are other contigs."""
    return F.length(chrom) <= most


def consecutive_long(seq: Column) -> Column:
    return has_any(seq, ("AAAAAA", "TTTTTT", "AAATAA", "TTTATT"))


def consecutive_on_side(seq: Column, left: Column) -> Column:
    """Left clips have A, right ones T."""
    return F.when(left, has_any(seq, POLY_A)).otherwise(has_any(seq, POLY_T))


#: Fixed motifs whose simple repeats count as polyA, and as polyT.
REPEATS_A = ("AAAAAC", "AAAAC", "AAAATAA", "AAAAT", "AAATA", "AAAT", "AACAAA", "AAC", "AATAAAA", "AATAAA", "AATAA", "AATA", "AAT", "ACA", "A")
REPEATS_T = ("GTTTTT", "GTTTT", "TTATTTT", "ATTTT", "TATTT", "ATTT", "TTTGTT", "GTT", "TTTTGTT", "TTTATT", "TTATT", "TATT", "ATT", "TGT", "T")


def is_polya_repeat(name: Column, t: bool = False) -> Column:
    """A repeat's name, such as (AAAT)n, is one of these motifs in any rotation."""
    names = sorted({f"({r})n" for m in (REPEATS_T if t else REPEATS_A) for r in rotations(m)})
    return name.isin(names)


def signal_offsets(seq: Column, reverse: bool) -> Column:
    """Starts of all polyA signals, motif by motif."""
    return F.concat(*(motif_offsets(seq, m) for m in (SIGNAL_T if reverse else SIGNAL_A)))


def polya_signal(seq: Column, reverse: bool) -> Column:
    return has_any(seq, SIGNAL_T if reverse else SIGNAL_A)


def dominant_a_t(seq: Column, ratio: float) -> Column:
    """A or T above that share; an empty sequence isn't."""
    return (F.length(seq) > 0) & ((_count(seq, "A") > ratio * F.length(seq)) | (_count(seq, "T") > ratio * F.length(seq)))


def motif_offsets(seq: Column, motif: str) -> Column:
    """Starts of the non-overlapping occurrences of a motif, from 0."""
    pieces = F.split(seq, motif, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, lambda s, p: F.struct((s["at"] + F.length(p) + len(motif)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")))
    return found["out"]


def rotations(motif: str) -> list[str]:
    return sorted({motif[k:] + motif[:k] for k in range(len(motif))})


def reverse_complement(seq: Column) -> Column:
    """Upper case; what isn't a base becomes N."""
    return F.reverse(F.translate(F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "N")), "ACGT", "TGCA"))


def breakpoint_end(seq: Column, left_clip: Column, reverse: Column, n: int = 20) -> Column:
    """The n bases nearest the breakpoint: the end of a left clip, the start of a right one, turned round when reversed."""
    return F.when(left_clip != reverse, F.right(seq, F.lit(n))).otherwise(F.substring(seq, 1, n))


def quality_string(qual: Column) -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char(q.cast("int") + 33)), "")


def tsd_sequence(left: Column, right: Column, bases: Column) -> Column:
    """+seq where the left breakpoint comes first, -seq where they are swapped, null if a side is missing."""
    return F.when((left > 0) & (right > 0), F.concat(F.when(left <= right, "+").otherwise("-"), bases))


def with_prefix(chrom: Column) -> Column:
    """Contig names with chr; a name of over three characters that starts with it has it."""
    return F.when((F.length(chrom) > 3) & chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_prefix(chrom: Column) -> Column:
    return F.when((F.length(chrom) > 3) & chrom.startswith("chr"), F.substring(chrom, 4, 1000)).otherwise(chrom)


#: Fixed starts of the names of contigs that aren't chromosomes.
DECOY_STARTS = ("HLA", "HPV", "HIV", "EBV", "NC", "hs37", "hs38", "Un", "decoy", "random")


def is_decoy(chrom: Column, mitochondrial: bool = False) -> Column:
    out = chrom.rlike(r"[_.\-]") | chrom.rlike("^(?:" + "|".join(DECOY_STARTS) + ")") | chrom.rlike("hs37|hs38")
    return out if mitochondrial else out | chrom.isin("chrM", "M", "MT", "chrMT")


def barcode(bx: Column) -> Column:
    return F.regexp_replace(bx, "-1$", "_1")
