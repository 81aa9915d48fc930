"""Run options with their defaults and checks. S13-S15, P12."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    species: str = "species"
    genome: str | None = None
    annotation: str | None = None
    bed: str | None = None
    sequences: str | None = None
    features: tuple[str, ...] = ("cds", "exon")
    sequences_only: bool = False
    allow_noncanonical: bool = True
    longest_only: bool = True
    allow_overlap: bool = True
    include_duplicates: bool = False
    simple_names: bool = False
    abbreviate_names: bool = True
    pwms: tuple[str, ...] = ()
    reference_u12: str | None = None
    reference_u2: str | None = None
    threshold: float = 90.0
    five_coords: tuple[int, int] = (-3, 9)
    three_coords: tuple[int, int] = (-6, 4)
    bp_coords: tuple[int, int] = (-55, -5)
    regions: tuple[str, ...] = ("five", "bp", "three")
    min_length: int = 30
    pseudocount: float = 1e-4
    missing: float = 1e-4
    flank: int = 200
    exons_as_flanks: bool = False
    ignore_ambiguous_ends: bool = True
    adjust_splice_sites: bool = True
    subsamples: int = 0
    hyper_c: float | None = None
    recursive: int | None = None
    generate_u2_bps_pwm: bool = False
    pwm_score_info: bool = False
    sequence_output: bool = True
    abbreviate_filenames: bool = False
    matrices: str | None = None
    conserved_u2_bp: str | None = None
    optimise_rounds: int = 5
    chunk: int = field(default=1 << 20)

    def __post_init__(self):
        if not (self.sequences or (self.genome and (self.annotation or self.bed))):
            raise ValueError("give intron sequences, or a genome with an annotation or a BED file")
        if self.annotation and self.bed:
            raise ValueError("an annotation and a BED file exclude one another")
        if self.sequences and (self.genome or self.annotation or self.bed):
            raise ValueError("intron sequences exclude a genome, an annotation and a BED file")
        if self.exons_as_flanks and self.bed:
            raise ValueError("a BED file names no exons that could be flanks")
        if not 0 <= self.threshold <= 100:
            raise ValueError("the threshold lies between 0 and 100")
        if unknown := set(self.regions) - {"five", "bp", "three"}:
            raise ValueError(f"unknown scoring regions: {sorted(unknown)}")
        if unknown := set(self.features) - {"cds", "exon"}:
            raise ValueError(f"unknown features: {sorted(unknown)}")

    def least_length(self, bp_width: int) -> int:
        """The shortest intron that can be scored: the 5' window's intron part, and the longer of what the 3' end needs. P12."""
        if self.sequences_only:
            return self.min_length
        need = max(0, self.five_coords[1]) + max(bp_width + abs(self.bp_coords[1]), max(0, -self.three_coords[0]))
        return max(self.min_length, need)
