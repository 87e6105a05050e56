"""Row-level access: every read goes through ``scoped``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A set of entity ids, or all of them (``entities`` is None)."""

    entities: frozenset[str] | None = None

    @classmethod
    def everything(cls) -> Scope:
        return cls(None)

    @classmethod
    def of(cls, *entities: str) -> Scope:
        return cls(None if "*" in entities else frozenset(entities))

    def clause(self, column: str | Column) -> Column:
        if self.entities is None:
            return F.lit(True)
        if not self.entities:
            return F.lit(False)
        column = F.col(column) if isinstance(column, str) else column
        return column.isin(sorted(self.entities))


def scoped(df: DataFrame, scope: Scope, column: str = "entity_id") -> DataFrame:
    return df.where(scope.clause(column))
