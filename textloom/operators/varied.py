"""Texts whose parts vary from row to row, made alike in Spark and in SQL, so that a query's SQL has rules to state and not results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Varied:
    """One of ``parts`` for each row, by its number, its step and the column ``key``; sums of these and plain columns are texts."""

    parts: tuple[str, ...]
    step: int
    key: str = "doc_id"

    @property
    def sql(self) -> str:
        listed = ", ".join("'" + p.replace("'", "''").replace("\0", "' || chr(0) || '") + "'" for p in self.parts)
        return f"list_element([{listed}], (({self.key} * {self.step} + {self.key} // {self.step + 4}) % {len(self.parts)} + 1)::INT)"

    @property
    def column(self) -> Column:
        at = F.expr(f"cast(({self.key} * {self.step} + {self.key} div {self.step + 4}) % {len(self.parts)} + 1 as int)")
        return F.element_at(F.array(*map(F.lit, self.parts)), at)


@dataclass(frozen=True)
class Joined:
    """Parts and column names, one after the other."""

    parts: tuple[Varied | str, ...]

    @property
    def sql(self) -> str:
        return " || ".join(f"({p.sql if isinstance(p, Varied) else p})" for p in self.parts)

    @property
    def column(self) -> Column:
        return F.concat(*(p.column if isinstance(p, Varied) else F.col(p).cast("string") for p in self.parts))
