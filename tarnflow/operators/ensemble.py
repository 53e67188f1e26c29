"""Ensembles (realization, site, ts, q) by site and by realization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.flows import validated


class Ensemble:
    """One long table; both wide layouts are pivots of it."""

    def __init__(self, flows: DataFrame):
        if "realization" not in flows.columns:
            raise ValueError("an ensemble needs a realization column")
        self.flows = validated(flows)

    @classmethod
    def of(cls, frames: dict) -> Ensemble:
        """From {int: flow of sites} or {str: frame of (realization, ts, q)}; ValueError for other keys."""
        if not frames:
            raise ValueError("no frames")
        first = next(iter(frames))
        if isinstance(first, int):
            parts = [f.withColumn("realization", F.lit(k)) for k, f in frames.items()]
        elif isinstance(first, str):
            parts = [f.withColumn("site", F.lit(k)) for k, f in frames.items()]
        else:
            raise ValueError("keys must be realization numbers or site names")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls(out)

    def sites(self) -> DataFrame:
        return self.flows.select("site").distinct()

    def by_realization(self, sites: list[str]) -> DataFrame:
        """(realization, ts, a column a site)."""
        return self.flows.groupBy("realization", "ts").pivot("site", sites).agg(F.sum("q"))

    def by_site(self, realizations: list[int]) -> DataFrame:
        """(site, ts, realization_0, realization_1 ...)."""
        wide = self.flows.groupBy("site", "ts").pivot("realization", realizations).agg(F.sum("q"))
        return wide.select("site", "ts", *[F.col(str(r)).alias(f"realization_{r}") for r in realizations])


def resampled_history(periods: DataFrame, realizations: int, seed: int) -> DataFrame:
    """(realization, site, year, period, q): each cell of history from one year drawn at random, the same for all sites."""
    from ..functions.rng import uniform

    years = sorted(r.year for r in periods.select("year").distinct().collect())  # as many as the record has
    cells = periods.select("year", "period").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(realizations - 1))).alias("realization"))
    pick = F.floor(uniform(seed, "hist", "realization", "year", "period") * len(years)).cast("int")
    drawn = cells.select("realization", "year", "period", F.get(F.array(*map(F.lit, years)), pick).alias("from_year"))
    return drawn.join(periods.withColumnRenamed("year", "from_year"), ["from_year", "period"]).select("realization", "site", "year", "period", "q")
