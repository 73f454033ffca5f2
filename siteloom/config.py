"""Run configuration: an immutable value handed to operators, never module state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    clip_mapq: int = 12
    disc_mapq: int = 20
    neighbourhood: int = 50
    discordant_distance: int = 2000
    tsd_cutoff: int = 100
    coverage_multiple: int = 3
    clip_mapped_ratio: float = 0.65
    disc_mapped_ratio: float = 0.70
    td_mapped_ratio: float = 0.80
    td_source_ratio: float = 0.45
    exact_clip_slack: int = 3
    large_indel: int = 3
    insert_size: int = 550
    read_length: int = 100
    gene_extension: int = 1500
    tumor: bool = False

    def max_clip_coverage(self, coverage: float, mosaic: bool = False) -> int:
        return int((0.5 if mosaic else 15) * coverage)


#: Coverage -> least numbers of clipped reads, discordant pairs and clips with a mate in a repeat.
GERMLINE_CUTOFFS = {
    5: (1, 3, 0), 10: (2, 3, 0), 15: (2, 3, 0), 20: (2, 4, 0), 25: (2, 4, 1), 30: (3, 4, 1), 35: (3, 5, 1), 40: (3, 6, 1), 45: (4, 6, 1), 50: (4, 7, 1), 60: (5, 8, 2), 70: (5, 9, 2),
    80: (6, 10, 2), 90: (7, 11, 3), 100: (8, 12, 3), 110: (9, 12, 3), 120: (9, 13, 3), 130: (10, 14, 3), 140: (11, 14, 4), 150: (12, 15, 4), 175: (13, 17, 5), 200: (14, 20, 5), 250: (20, 25, 7), 300: (25, 30, 8),
}
CASE_CONTROL_CUTOFFS = {
    5: (1, 1, 0), 10: (1, 2, 0), 15: (2, 2, 0), 20: (2, 3, 1), 25: (2, 4, 1), 30: (2, 4, 1), 35: (2, 5, 1), 40: (3, 5, 1), 45: (3, 6, 1), 50: (4, 6, 1), 60: (5, 7, 2), 70: (5, 8, 2),
    80: (6, 8, 2), 90: (7, 9, 2), 100: (8, 10, 3), 200: (14, 20, 5),
}
#: Long reads: coverage -> least number of clips.
LONG_READ_CUTOFFS = {5: 1, 10: 3, 15: 4, 20: 4, 25: 5, 30: 6, 35: 6, 40: 7, 45: 8, 50: 9, 60: 10, 70: 11, 80: 12, 90: 13, 100: 14, 110: 15, 120: 16, 130: 17, 140: 18, 150: 19, 200: 20}
#: Bits of the repeat types.
TYPE_BITS = {"L1": 1, "ALU": 2, "SVA": 4, "HERV": 8, "MT": 16, "MSTA": 32, "PSEUDOGENE": 64}
