"""Query registry: each entry pairs a DataFrame plan with its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables
from .adapters_sql import with_ctes


@dataclass
class Registry:
    plans: dict[str, Callable[[Tables], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None, ctes: str = ""):
        """Register a plan; ``ctes`` names the adapter tables the SQL reads."""

        def register(plan: Callable[[Tables], DataFrame]):
            if name in self.plans:
                raise ValueError(f"query {name} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = with_ctes(ctes.split(), sql)
            return plan

        return register

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(plan):
            return lambda spark, sf_dir: plan(Tables(spark, sf_dir))

        return {name: bind(plan) for name, plan in self.plans.items()}
