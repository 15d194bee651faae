"""The store's fixed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.terms import LABEL, SUB_CLASS, TYPE, URI


def _is(column: str, value: str | Column) -> Column:
    return F.col(column) == (value if isinstance(value, Column) else F.lit(value))


def _plain_literal(value: str) -> Column:
    return (F.col("o_kind") == t.LITERAL) & (F.col("o") == value) & F.col("o_dt").isNull() & F.col("o_lang").isNull()


def has_literal(statements: DataFrame, value: str) -> bool:
    """Whether an explicit statement has this plain literal."""
    return not statements.where(~F.col("inferred") & _plain_literal(value)).select(F.lit(1)).isEmpty()


def count(statements: DataFrame) -> int:
    """Explicit statements."""
    return statements.where(~F.col("inferred")).count()


def full_types(statements: DataFrame) -> DataFrame:
    """(x, cls): all types, inferred ones too."""
    return statements.where((F.col("p") == TYPE) & (F.col("o_kind") != t.LITERAL)).select(F.col("s").alias("x"), F.col("o").alias("cls")).distinct()


def direct_types(statements: DataFrame) -> DataFrame:
    """(x, cls): types of which the resource has no other type that is a sub-class."""
    types = full_types(statements)
    under = statements.where((F.col("p") == SUB_CLASS) & (F.col("s") != F.col("o"))).select(F.col("s").alias("other"), F.col("o").alias("cls"))
    covered = types.select("x", F.col("cls").alias("other")).join(under, "other").select("x", "cls")
    return types.join(covered, ["x", "cls"], "left_anti")


def type_of(statements: DataFrame, uri: str, direct: bool = True) -> DataFrame:
    """(cls) of one resource."""
    narrow = statements.where((F.col("p") == SUB_CLASS) | ((F.col("p") == TYPE) & (F.col("s") == uri) & (F.col("s_kind") == URI)))
    return (direct_types(narrow) if direct else full_types(narrow)).where(F.col("x") == uri).select("cls")


def describe(statements: DataFrame, uri: str) -> DataFrame:
    """(prop, hasValue, isValueOf) of statements about the resource and of those that name it, by prop."""
    out = statements.where((F.col("s") == uri) & (F.col("s_kind") == URI)).select(F.col("p").alias("prop"), F.col("o").alias("hasValue"))
    into = statements.where((F.col("o") == uri) & (F.col("o_kind") == URI)).select(F.col("p").alias("prop"), F.col("s").alias("isValueOf"))
    return out.unionByName(into, allowMissingColumns=True).orderBy("prop", "hasValue", "isValueOf")


def what(statements: DataFrame, label: str) -> DataFrame:
    """(node) with this plain label."""
    return statements.where((F.col("p") == LABEL) & _plain_literal(label)).select(F.col("s").alias("node")).distinct()


def fix_years(statements: DataFrame, wrong: str, right: str, low: int = 1913, high: int = 2012) -> DataFrame:
    """Plain literals of the predicate ``wrong`` that are years between low and high become integers of ``right``."""
    year = F.when(F.col("o").rlike("^[0-9]{4}$"), F.col("o").cast("int"))
    bad = F.coalesce((F.col("p") == wrong) & (F.col("o_kind") == t.LITERAL) & F.col("o_dt").isNull() & F.col("o_lang").isNull() & year.between(low, high), F.lit(False))
    return t.distinct(statements.withColumns({"p": F.when(bad, F.lit(right)).otherwise(F.col("p")), "o_dt": F.when(bad, F.lit(t.XSD + "int")).otherwise(F.col("o_dt"))}))
