"""Log-probabilities of alternate reads given depth and expected frequency, per sample.

Each emission has a Column form and a NumPy form. What does not depend on the clone (`fixed`) is made once
per observation; `log_prob` adds the rest. Frequencies are clipped to [1e-10, 1 - 1e-10]."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from clonal_spark.config import CloneConfig, EmissionModel
from clonal_spark.functions import mathx as mx

EPS = 1e-10
PHI, TAU, PARETO = 100.0, 0.05, 2.0


def log_choose(alt: Column, depth: Column) -> Column:
    return mx.lgamma(depth + 1) - mx.lgamma(alt + 1) - mx.lgamma(depth - alt + 1)


def np_log_choose(alt, depth) -> np.ndarray:
    return mx.np_lgamma(depth + 1) - mx.np_lgamma(alt + 1) - mx.np_lgamma(depth - alt + 1)


class Binomial:
    def __init__(self, config: CloneConfig | None = None):
        pass

    def fixed(self, alt: Column, depth: Column) -> Column:
        return log_choose(alt, depth)

    def log_prob(self, alt: Column, depth: Column, mu: Column, fixed: Column | None = None) -> Column:
        mu = mx.clip(mu, EPS, 1 - EPS)
        return (self.fixed(alt, depth) if fixed is None else fixed) + mx.xlogy(alt, mu) + mx.xlogy(depth - alt, 1 - mu)

    def np_fixed(self, alt, depth):
        return np_log_choose(alt, depth)

    def np_log_prob(self, alt, depth, mu, fixed=None):
        mu = np.clip(mu, EPS, 1 - EPS)
        return (self.np_fixed(alt, depth) if fixed is None else fixed) + mx.np_xlogy(alt, mu) + mx.np_xlogy(depth - alt, 1 - mu)

    def np_table(self, count, mu, rest: bool):
        """np_log_prob's term of the alternate reads, or of the others."""
        mu = np.clip(mu, EPS, 1 - EPS)
        return mx.np_xlogy(count, 1 - mu if rest else mu)

    def np_less(self, mu) -> list[np.ndarray]:
        """What goes off for each frequency."""
        return []

    def np_mixed(self, body, alt, depth):
        return body


class BetaBinomial:
    """Precision phi: alpha + beta = phi, so terms in depth + phi and phi are fixed too."""

    def __init__(self, config: CloneConfig | None = None):
        self.phi = PHI if config is None or config.phi is None else config.phi

    def fixed(self, alt: Column, depth: Column) -> Column:
        return log_choose(alt, depth) - mx.lgamma(depth + self.phi) + float(mx.np_lgamma(self.phi))

    def log_prob(self, alt: Column, depth: Column, mu: Column, fixed: Column | None = None) -> Column:
        mu = mx.clip(mu, EPS, 1 - EPS)
        a, b = mu * self.phi, (1 - mu) * self.phi
        return (self.fixed(alt, depth) if fixed is None else fixed) + mx.lgamma(alt + a) + mx.lgamma(depth - alt + b) - mx.lgamma(a) - mx.lgamma(b)

    def np_fixed(self, alt, depth):
        return np_log_choose(alt, depth) - mx.np_lgamma(depth + self.phi) + mx.np_lgamma(self.phi)

    def np_log_prob(self, alt, depth, mu, fixed=None):
        mu = np.clip(mu, EPS, 1 - EPS)
        a, b = mu * self.phi, (1 - mu) * self.phi
        return (self.np_fixed(alt, depth) if fixed is None else fixed) + mx.np_lgamma(alt + a) + mx.np_lgamma(depth - alt + b) - mx.np_lgamma(a) - mx.np_lgamma(b)

    def np_table(self, count, mu, rest: bool):
        mu = np.clip(mu, EPS, 1 - EPS)
        return mx.np_lgamma(count + ((1 - mu) if rest else mu) * self.phi)

    def np_less(self, mu) -> list[np.ndarray]:
        mu = np.clip(mu, EPS, 1 - EPS)
        return [mx.np_lgamma(mu * self.phi), mx.np_lgamma((1 - mu) * self.phi)]

    def np_mixed(self, body, alt, depth):
        return body


class BetaBinomialPareto(BetaBinomial):
    """Mixed per sample with a power-law tail over the observed frequency."""

    def __init__(self, config: CloneConfig | None = None):
        super().__init__(config)
        self.tau = TAU if config is None or config.tail_weight is None else config.tail_weight

    def tail(self, alt: Column, depth: Column) -> Column:
        return float(np.log(PARETO - 1)) - PARETO * F.log(mx.clip(alt / F.greatest(depth, F.lit(1.0)), EPS, 1.0))

    def log_prob(self, alt: Column, depth: Column, mu: Column, fixed: Column | None = None) -> Column:
        body = super().log_prob(alt, depth, mu, fixed)
        return mx.logaddexp(float(np.log1p(-self.tau)) + body, float(np.log(self.tau)) + self.tail(alt, depth))

    def np_log_prob(self, alt, depth, mu, fixed=None):
        return self.np_mixed(super().np_log_prob(alt, depth, mu, fixed), alt, depth)

    def np_mixed(self, body, alt, depth):
        tail = np.log(PARETO - 1) - PARETO * np.log(np.clip(alt / np.maximum(depth, 1), EPS, 1.0))
        return np.logaddexp(np.log1p(-self.tau) + body, np.log(self.tau) + tail)


class DescendantFraction(BetaBinomial):
    """The copy-number correction enters through the adjustment factor alone."""


EMISSIONS = {EmissionModel.BINOMIAL: Binomial, EmissionModel.BETA_BINOMIAL: BetaBinomial, EmissionModel.BB_PARETO: BetaBinomialPareto, EmissionModel.DCF_BB: DescendantFraction}


def emission_of(config: CloneConfig):
    """The configured emission; an axis that holds a class of one's own gives that."""
    return EMISSIONS.get(config.emission, config.emission)(config)
