"""A microdata table together with its catalog and design: the entry point for single estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .catalog import Catalog, Design
from .operators import estimates, quantiles, tables


@dataclass(frozen=True)
class Survey:
    """Estimates with the catalog's codes and each variable's own weight. The ``universe`` given replaces the question universe."""

    data: DataFrame
    catalog: Catalog
    design: Design

    def _universe(self, variable: str, universe: str | None) -> str | None:
        return universe if universe is not None else self.catalog[variable].universe

    def prevalence(self, variable: str, universe: str | None = None) -> DataFrame:
        meta = self.catalog[variable]
        return estimates.prevalence(
            self.data, variable, universe=self._universe(variable, universe), affirmative=meta.affirmative,
            valid=meta.valid, design=meta.design(self.design),
        )

    def prevalence_ci(self, variable: str, universe: str | None = None) -> DataFrame:
        meta = self.catalog[variable]
        return estimates.prevalence_ci(
            self.data, variable, universe=self._universe(variable, universe), affirmative=meta.affirmative,
            valid=meta.valid, design=meta.design(self.design),
        )

    def mean(self, variable: str, universe: str | None = None) -> DataFrame:
        return estimates.mean(
            self.data, variable, universe=self._universe(variable, universe),
            valid=self.catalog[variable].valid, design=self.catalog[variable].design(self.design),
        )

    def quantile(self, variable: str, q: float, universe: str | None = None) -> DataFrame:
        return quantiles.quantile(
            self.data, variable, q, universe=self._universe(variable, universe),
            valid=self.catalog[variable].valid, design=self.catalog[variable].design(self.design),
        )

    def subpopulation(self, variable: str, universe: str | None, stat: str = "prevalence", q: float = 0.5) -> DataFrame:
        """Applies exactly the universe given, also when that is None."""
        return tables.subpopulation_stat(
            self.data, variable, universe=universe, stat=stat, q=q, catalog=self.catalog, design=self.design
        )

    def table(self, variable: str, groupby: str, stat: str = "prevalence", q: float = 0.5,
              universe: str | None = None, cap: int | None = None) -> DataFrame:
        return tables.grouped_table(
            self.data, variable, groupby, stat=stat, q=q, universe=universe, catalog=self.catalog,
            design=self.design, cap=cap,
        )
