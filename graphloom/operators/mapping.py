"""Vocabulary mapping: terms replaced by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import URI

ROLES = ("SUBJECT", "PREDICATE", "OBJECT")


class Mapping:
    """role -> {old URI: new URI}; a later entry for the same role and URI wins."""

    def __init__(self, entries: list[tuple[str, str, str]] = ()):
        self.roles: dict[str, dict[str, str]] = {r: {} for r in ROLES}
        for role, old, new in entries:
            self.add(role, old, new)

    def add(self, role: str, old: str, new: str) -> None:
        self.roles[role][old] = new

    def get(self, role: str, old: str) -> str | None:
        return self.roles[role].get(old)

    def __contains__(self, key: tuple[str, str]) -> bool:
        return key[1] in self.roles[key[0]]

    def rows(self) -> list[tuple[str, str, str]]:
        return [(r, a, b) for r in ROLES for a, b in sorted(self.roles[r].items())]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "role string, `from` string, `to` string")


#: Entries up to which a configuration's mapping is sent to all tasks.
FEW = 100_000


def map_statements(statements: DataFrame, mapping: DataFrame, few: bool = False) -> DataFrame:
    """Each role's URIs replaced by its entries, once, not transitively; literals and blank nodes stay.

    ``mapping``: (role, from, to), at most one ``to`` for each role and ``from``.  Three left joins, whose
    strategy Spark picks by the mapping's size; a role without entries costs nothing at all.  ``few``: the mapping is known to be
    small and is sent to all tasks, so that statements stay where they are read: moved by predicate, those of the most
    frequent one would all meet in one task."""
    for role, column, kind in (("SUBJECT", "s", "s_kind"), ("PREDICATE", "p", None), ("OBJECT", "o", "o_kind")):
        own = mapping.where(F.col("role") == role).groupBy(F.col("from").alias("__from")).agg(F.max("to").alias("__to"))
        on = F.col(column) == F.col("__from")
        if kind:
            on &= F.col(kind) == URI
        statements = statements.join(F.broadcast(own) if few else own, on, "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")
    return statements


def apply(statements: DataFrame, mapping: Mapping) -> DataFrame:
    """map_statements() for a mapping of a configuration."""
    return map_statements(statements, mapping.frame(statements.sparkSession), len(mapping.rows()) <= FEW)
