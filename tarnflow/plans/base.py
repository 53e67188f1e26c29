"""The life of a generator: fit on a flow, then generate."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class Generator(ABC):
    """Subclasses keep what fit() learned as small tables and generate (realization, site, ts, q)."""

    is_fitted = False

    @abstractmethod
    def fit(self, flow: DataFrame) -> Generator: ...

    @abstractmethod
    def generate(self, n_realizations: int = 1, n_years: int | None = None, seed: int = 0) -> DataFrame: ...

    def check_fitted(self) -> None:
        if not self.is_fitted:
            raise RuntimeError("fit() first")
