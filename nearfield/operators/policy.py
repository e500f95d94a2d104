"""How many links and how wide a beam a node gets, as expressions over its density and intrinsic dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("continuous", "quantile", "lid_only", "density_only", "uniform")


#: The defaults of a policy.
@dataclass(frozen=True)
class Policy:
    kind: str = "continuous"
    m_base: int = 16
    m_min: int = 8
    m_max: int = 24
    ef_base: int = 120
    ef_min: int = 40
    ef_max: int = 220
    alpha_lid: float = 0.5
    beta_density: float = 0.5
    sensitivity: float = 0.4
    clip: float = 3.0
    tier: float = 0.5
    decay: float = 0.75
    m_min_layer: int = 4

    def __post_init__(self):
        if self.kind not in POLICIES:
            raise ValueError(f"no policy {self.kind}; there are {', '.join(POLICIES)}")

    def score(self, density: Column, lid: Column, stats: dict[str, Column]) -> Column:
        """stats: density_mean, density_std, lid_mean, lid_std."""
        zd = (density - stats["density_mean"]) / (stats["density_std"] + 1e-6)
        zl = (lid - stats["lid_mean"]) / (stats["lid_std"] + 1e-6)
        raw = {"lid_only": zl, "density_only": zd}.get(self.kind, self.alpha_lid * zl + self.beta_density * zd)
        return F.greatest(F.lit(-self.clip), F.least(F.lit(self.clip), raw))

    def parameters(self, score: Column) -> tuple[Column, Column]:
        """m and ef_construction."""
        clamp = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint(v).cast("int")))
        if self.kind == "uniform":
            return F.lit(self.m_base), F.lit(self.ef_base)
        if self.kind == "quantile":
            pick = lambda lo, mid, hi: F.when(score > self.tier, hi).when(score < -self.tier, lo).otherwise(mid)
            return pick(self.m_min, self.m_base, self.m_max), pick(self.ef_min, self.ef_base, self.ef_max)
        f = 1 + self.sensitivity * score
        return clamp(self.m_base * f, self.m_min, self.m_max), clamp(self.ef_base * f, self.ef_min, self.ef_max)

    def layer_budget(self, m: Column, layer: Column) -> tuple[Column, Column]:
        """m and the most links of a node at a layer."""
        up = F.greatest(F.lit(self.m_min_layer), F.floor(m * F.pow(F.lit(self.decay), layer)).cast("int"))
        return F.when(layer == 0, m).otherwise(up), F.when(layer == 0, 2 * m).otherwise(up)


def adopted(signals: DataFrame, profile: DataFrame) -> DataFrame:
    """signals (density, lid) beside the one row of a profile made elsewhere, whose deviations up to 1e-6 count as 1: what score() needs."""
    one = profile.select(*(F.col(f"{c}_mean") for c in ("density", "lid")), *(F.when(F.col(f"{c}_std") <= 1e-6, 1.0).otherwise(F.col(f"{c}_std")).alias(f"{c}_std") for c in ("density", "lid")))
    return signals.join(F.broadcast(one.limit(1)), F.lit(True))


def node_level(id_: Column, m_base: int = 16) -> Column:
    """A geometric level from the id's hash, so that it depends on no order or partition."""
    u = (F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-F.ln(u) / F.ln(F.lit(float(m_base)))).cast("int")


def dynamic_ef(base: Column, score: Column, k: int) -> Column:
    """The beam of a query whose entry point has this score."""
    return F.floor(F.greatest(F.lit(float(k)), F.least(2.0 * base, base * (1 + 0.3 * score)))).cast("int")


def dynamic_ef_hardness(ef: int, score: Column, z_dist: Column, kappa: float = 0.4, lo: int = 16, hi: int = 128) -> Column:
    h = 0.7 * score + 0.3 * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z_dist))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.round(ef * (1 + kappa * h)).cast("int")))


def tombstone_ef(ef: Column, deleted: Column, all_: Column) -> Column:
    return F.least(2 * ef, ef + F.floor(ef * deleted / F.greatest(all_, F.lit(1))).cast("int"))
