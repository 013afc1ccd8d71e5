"""Configuration: five axes of a fit, their validation, and the named presets."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class EmissionModel(Enum):
    BINOMIAL = "binomial"
    BETA_BINOMIAL = "beta_binomial"
    BB_PARETO = "bb_pareto"
    DCF_BB = "dcf_bb"


class InferenceEngine(Enum):
    EM = "em"
    MFVI = "mfvi"
    MCMC = "mcmc"
    HYBRID = "hybrid"


class KPrior(Enum):
    BIC = "bic"
    DIRICHLET = "dirichlet"
    TSSB = "tssb"
    FIXED = "fixed"


class PhyloMode(Enum):
    NONE = "none"
    POST_HOC = "post_hoc"
    CONSTRAINED = "constrained"
    JOINT_MCMC = "joint_mcmc"
    LONGITUDINAL = "longitudinal"
    PAIRWISE = "pairwise"


class NoiseModel(Enum):
    NONE = "none"
    TAIL_FILTER = "tail_filter"
    ARTEFACT = "artefact"
    MULTIPLICITY = "multiplicity"


class SubChallenge(Enum):
    """What a score measures: purity, mutation fractions, clone number, assignment, tree."""

    SC1A = "SC1A"
    SC1B = "SC1B"
    SC2A = "SC2A"
    SC2B = "SC2B"
    SC3 = "SC3"

    @classmethod
    def parse(cls, value: SubChallenge | str) -> SubChallenge:
        return value if isinstance(value, cls) else cls(str(value).upper())


SUBCHALLENGES = list(SubChallenge)


@dataclass(frozen=True)
class CloneConfig:
    """phi: beta-binomial precision (None: 100). tail_weight: weight of the neutral tail (None: 0.05 in the
    emission, estimated in the filter). n_clones: the K of a fixed fit, the most of a Dirichlet one."""

    emission: EmissionModel = EmissionModel.BETA_BINOMIAL
    inference: InferenceEngine = InferenceEngine.HYBRID
    k_prior: KPrior = KPrior.DIRICHLET
    phylo: PhyloMode = PhyloMode.CONSTRAINED
    noise: NoiseModel = NoiseModel.ARTEFACT
    phi: float | None = None
    tail_weight: float | None = None
    n_clones: int | None = None
    n_samples: int = 1
    longitudinal: bool = False
    depth_median: float = 100.0
    tail_threshold: float = 0.5
    artefact_absence_threshold: float = 0.05
    purity: float = 1.0

    def __post_init__(self) -> None:
        sampled = (InferenceEngine.MCMC, InferenceEngine.HYBRID)
        rules = [
            (self.k_prior is KPrior.FIXED and self.n_clones is None, "a fixed K needs n_clones"),
            (self.phylo is PhyloMode.LONGITUDINAL and not self.longitudinal, "longitudinal trees need longitudinal=True"),
            (self.phylo is PhyloMode.JOINT_MCMC and self.inference not in sampled, "joint trees need MCMC or HYBRID inference"),
            (self.phi is not None and self.phi <= 0, "phi must be positive"),
            (self.tail_weight is not None and not 0 < self.tail_weight < 1, "tail_weight must lie in (0, 1)"),
            (self.n_samples < 1, "n_samples must be at least 1"),
            (self.depth_median <= 0, "depth_median must be positive"),
            (not 0 < self.tail_threshold <= 1, "tail_threshold must lie in (0, 1]"),
            (not 0 <= self.artefact_absence_threshold <= 1, "artefact_absence_threshold must lie in [0, 1]"),
            (not 0 < self.purity <= 1, "purity must lie in (0, 1]"),
        ]
        for broken, message in rules:
            if broken:
                raise ValueError(message)


def _preset(emission: str, inference: str, k_prior: str, phylo: str, noise: str, **more) -> CloneConfig:
    return CloneConfig(EmissionModel(emission), InferenceEngine(inference), KPrior(k_prior), PhyloMode(phylo), NoiseModel(noise), **more)


# The presets' names and axes, in the order that ties between configurations go by.
CONFIGS: dict[str, CloneConfig] = {
    "quantumclone_v1": _preset("binomial", "em", "bic", "post_hoc", "none"),
    "pyclone_vi": _preset("beta_binomial", "mfvi", "dirichlet", "none", "none", phi=50.0),
    "mobster": _preset("bb_pareto", "em", "bic", "none", "tail_filter"),
    "decifer_style": _preset("dcf_bb", "em", "bic", "none", "multiplicity"),
    "conipher_style": _preset("beta_binomial", "mfvi", "dirichlet", "post_hoc", "artefact"),
    "phyloclone_style": _preset("beta_binomial", "mcmc", "tssb", "joint_mcmc", "none"),
    "calder_style": _preset("beta_binomial", "em", "fixed", "longitudinal", "none", longitudinal=True, n_clones=3),
    "wes_clinical": _preset("beta_binomial", "hybrid", "dirichlet", "constrained", "artefact"),
    "wgs_cohort": _preset("bb_pareto", "mfvi", "dirichlet", "none", "tail_filter", phi=100.0),
    "wgs_cohort_phylo": _preset("bb_pareto", "hybrid", "dirichlet", "constrained", "tail_filter", phi=100.0),
    "multiregion_phylo": _preset("dcf_bb", "hybrid", "dirichlet", "pairwise", "multiplicity"),
    "longitudinal_clinical": _preset("beta_binomial", "hybrid", "bic", "longitudinal", "artefact", longitudinal=True),
}
CONFIG_NAMES = list(CONFIGS)
#: Left out of training by default for its run time.
DEFAULT_EXCLUDE_CONFIGS = frozenset({"phyloclone_style"})

# The order of the meta-features.
FEATURE_NAMES = [
    "depth_median", "depth_cv", "frac_low_depth",
    "frac_cna", "wgd", "ploidy", "n_cn_states", "frac_loh", "subclonal_cn",
    "skewness", "kurtosis", "n_peaks", "clonal_peak_width", "has_pareto_tail", "purity_estimate",
    "n_samples", "is_longitudinal", "n_mutations", "sequencing_type",
    "nrpcc", "mappability",
]

_BACKEND = "spark"


def set_backend(name: str, device: str | None = None) -> None:
    """One backend exists; "auto" and "numpy" mean it too, any other name is an error."""
    if name not in ("spark", "auto", "numpy"):
        raise ValueError(f"unknown backend {name!r}")


def get_backend() -> str:
    return _BACKEND
