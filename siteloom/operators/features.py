"""Genotype features of sites from the reads around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar as C
from ..functions import seq as S

#: How near a clip is to be looked at for polyA and with how many bases, and how near a border of a fully mapped read is to count it to a side.
POLYA_NEAR, TAIL, BORDER = 25, 20, 45


def told(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """scan.placed() -> what a read tells of genotypes wherever a site is, in a few short columns: what genotype_evidence() needs of it."""
    return reads.select(*(c for c in ("site", "start", "end") if c in reads.columns), *told_columns(config))


def told_columns(config: Config = Config(), place: Column | None = None) -> list[Column]:
    """What told() makes of a read. place: the read's place, where it is known."""
    g, pos = F.col("cigar"), F.col("pos")
    extra = F.col("is_secondary") | F.col("is_supplementary")
    lclip, rclip = C.left_clipped(g, hard=False), C.right_clipped(g, hard=False)
    place = F.when(rclip, C.right_breakpoint(pos, g)).otherwise(pos) if place is None else place
    left_part, right_part = F.substring(F.col("seq"), F.lit(1), C.first(g)["len"]), F.right("seq", C.last(g)["len"])

    def inner(part: Column, left: bool) -> Column:
        """The bases at the breakpoint, as the read was aligned; on the other strand those at the other end."""
        end, start = F.right(part, F.lit(TAIL)), F.substring(part, 1, TAIL)
        return F.when(F.col("is_reverse"), start if left else end).otherwise(end if left else start)

    no = F.lit(False)
    l_ok, r_ok = lclip & ~extra, rclip & ~extra
    goes_on = ~((lclip | rclip) & extra)
    mate = F.coalesce(goes_on & ~F.col("mate_is_unmapped") & F.col("mate_chrom").isNotNull() & ~S.is_decoy(F.coalesce("mate_chrom", F.lit("*"))), no)
    disc = mate & F.coalesce(C.discordant(F.col("chrom"), place, F.col("mate_chrom"), F.col("mate_pos"), config.discordant_distance), no)
    # a mate that can make a concordant pair, and the contig of any that counts
    return [
        F.col("chrom"), F.col("pos"), F.col("qname"), place.alias("place"), F.when(l_ok, C.first(g)["len"]).alias("l_len"), F.when(r_ok, C.last(g)["len"]).alias("r_len"), F.when(C.fully_mapped(g), C.first(g)["len"]).alias("full_len"), F.when(mate, F.col("mate_chrom")).alias("mate_chrom"),
        F.when(mate & ~disc, F.col("mate_pos")).alias("mate_pos"), (mate & ~disc).alias("conc"), disc.alias("disc"), (disc & C.large_indel(g, config.large_indel)).alias("indel"),
        F.coalesce(l_ok & S.consecutive_a_t(inner(left_part, True)), no).alias("l_polya"), F.coalesce(r_ok & S.consecutive_a_t(inner(right_part, False)), no).alias("r_polya")]


def genotype_evidence(near: DataFrame, config: Config = Config(), more: tuple[Column, ...] = ()) -> DataFrame:
    """scan.around() -> one row for each chrom and site: schema.FEATURES but for pos.

    n_af_clip and clip_lens are of the side with more soft clips less than exact_clip_slack from the site (of equal ones the
    left); n_full_map are fully mapped reads over the site, less those that lie nearly all on that side of it. n_l_raw and
    n_r_raw are soft clips within tsd_cutoff. A read's place is its right breakpoint if it is clipped there. Discordant
    pairs count within an insert size, those with an indel wherever they are; concordant ones span the site, and no read of
    the pair is clipped near it. n_mate_chroms counts contigs of all mates but decoys. Clipped secondary and supplementary
    reads tell nothing but whether they are fully mapped. clip_lens are in order, an empty list without any. more: aggregates
    of the same rows, told beside.
    """
    near = near if "l_polya" in near.columns else told(near, config)
    pos, place, site, key, no = F.col("pos"), F.col("place"), F.col("site"), ["chrom", "site"], F.lit(False)
    l_off, r_off = F.abs(pos - site), F.abs(place - site)
    l_len, r_len, full_len = F.col("l_len"), F.col("r_len"), F.col("full_len")
    raw = {"l": l_len.isNotNull() & (l_off < config.tsd_cutoff), "r": r_len.isNotNull() & (r_off < config.tsd_cutoff)}
    exact = {"l": F.when(l_off < config.exact_clip_slack, l_len), "r": F.when(r_off < config.exact_clip_slack, r_len)}
    full = full_len.isNotNull() & (site >= pos) & (site <= pos + full_len)
    # a right part near the site takes the left one's place
    polya = F.when(r_len.isNotNull() & (r_off < POLYA_NEAR), F.col("r_polya")).otherwise(F.col("l_polya") & (l_off < POLYA_NEAR))
    spans = F.coalesce(F.col("conc") & C.spans_site(F.col("chrom"), place, F.col("mate_chrom"), F.col("mate_pos"), site, config.read_length, config.insert_size), no)
    # concordant pairs by name: none of a name that is clipped near the site
    names = near.filter(raw["l"] | raw["r"] | spans).groupBy(*key, "qname").agg(F.bool_or(raw["l"] | raw["r"]).alias("clipped"), F.count_if(spans).alias("k"))
    conc = names.filter(~F.col("clipped")).groupBy(*key).agg(F.sum("k").alias("n_conc"))
    # the lists of lengths are the result's own, contigs of mates are few
    n = near.groupBy(*key).agg(
        F.count(exact["l"]).alias("nl"), F.count(exact["r"]).alias("nr"), F.count_if(full).alias("nf"), F.count_if(full & ~(l_off < BORDER) & (F.abs(pos + full_len - site) < BORDER)).alias("nfl"), F.count_if(full & (l_off < BORDER)).alias("nfr"), F.count_if(raw["l"]).alias("n_l_raw"), F.count_if(raw["r"]).alias("n_r_raw"),
        F.count_if(F.col("disc") & (r_off <= config.insert_size)).alias("n_disc"), F.count_if("indel").alias("n_large_indel"), F.count_if(polya).alias("n_polya"), F.size(F.collect_set("mate_chrom")).alias("n_mate_chroms"), *(F.collect_list(exact[x]).alias(f"lens_{x}") for x in "lr"), *more)
    extra = [c for c in n.columns if c not in (*key, "nl", "nr", "nf", "nfl", "nfr", "n_l_raw", "n_r_raw", "n_disc", "n_large_indel", "n_polya", "n_mate_chroms", "lens_l", "lens_r")]
    out = n.join(conc, key, "left")
    right = F.col("nl") < F.col("nr")
    return out.select(*key, F.greatest("nl", "nr").alias("n_af_clip"), (F.col("nf") - F.when(right, F.col("nfr")).otherwise(F.col("nfl"))).alias("n_full_map"), "n_l_raw", "n_r_raw", "n_disc", F.coalesce("n_conc", F.lit(0)).alias("n_conc"), "n_large_indel",
                      F.sort_array(F.when(right, F.col("lens_r")).otherwise(F.col("lens_l"))).alias("clip_lens"), "n_polya", F.col("n_mate_chroms").cast("long").alias("n_mate_chroms"), *extra)
