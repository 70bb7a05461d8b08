"""Settings of the two analyses, frozen and passed on explicitly."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class QuantifySettings:
    """Abundance estimation. phantom_rows and strand_strict are legacy switches: extra empty long reads in the
    denominator, and treating every gene as on the plus strand."""

    em_choice: str = "LR"  # LR, SR or hybrid
    alpha: float | None = None  # weight of long reads in hybrid; None: from alpha_path or a model
    alpha_path: str | None = None
    max_iterations: int = 200
    relative_tolerance: float = 1e-6
    tested_above: float = 1e-7
    floor: float = 1e-100
    end_tolerance: int = 20  # at a read's two ends
    junction_tolerance: int = 5
    gene_tolerance: int = 20
    least_block: int = 15
    cond_prob: str = "form_2"  # form_1, form_2, no_read_length, no_isoform_specific
    initial_theta: str = "LR"  # *_unique: only reads of one isoform count
    read_filter: str = "best"  # best or unique_only
    mean_f_len: float | None = None
    std_f_len: float | None = None
    phantom_rows: int = 0
    strand_strict: bool = True
    em_rows_per_task: int = 2_000_000  # larger communities iterate as distributed tables


@dataclass(frozen=True)
class KValueSettings:
    """Condition numbers of an annotation."""

    region_selection: str = "read_length"  # read_length, num_exons or real_data
    read_length: int = 150
    least_junction: int = 1
    sr_design: str = "weight"  # weight or regular
    multi_exon_weight: str = "regular"  # regular or minus_inner_region
    normalize_sr: bool = True
    normalize_lr: bool = True
    singular_tolerance: float = 0.0
    full_length_regions: str = "all"  # all, none or nonfullrank: zero-count long-read regions kept
    keep_sr_regions: str = "nonfullrank"  # nonfullrank, all or none: zero-count short-read regions kept
    filter_reads: bool = False  # leave out long reads on much shorter regions than an isoform of theirs


#: Options of the original command line that never change a result; naming one is an error here.
NO_EFFECT = (
    "srfastq sr_m1 sr_m2 ref_genome SR_quantification_option beta training DL_model assign_unique_mapping_option "
    "iter_theta eff_len kde_path EM_output_frequency initial_theta_eps eps_strategy same_struc_isoform_handling threads"
).split()


def settings_of(kind: type, **options):
    """kind(**options), with a clear error for options that are unknown or have no effect."""
    known = {f.name for f in fields(kind)}
    for name in options:
        if name in NO_EFFECT:
            raise ValueError(f"{name} has no effect on the result and isn't taken")
        if name not in known:
            raise ValueError(f"unknown option {name}; known: {', '.join(sorted(known))}")
    return kind(**options)
