"""Statements as flat rows, so that Parquet prunes their columns and Catalyst pushes filters into them.

A term is (lexical form, kind, datatype, language); kind is ``uri``, ``bnode`` or ``literal``.  Two terms are
equal when all four are: ``"1"`` isn't ``"1"^^xsd:int``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, CLASS = RDF + "type", RDFS + "label", RDFS + "Class"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"

URI, BNODE, LITERAL = "uri", "bnode", "literal"
#: Datatypes whose literals are compared as numbers.
NUMERIC = tuple(XSD + n for n in ("int", "integer", "long", "short", "byte", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger", "unsignedInt"))

STATEMENT = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, inferred boolean"
SCHEMA = T.StructType([T.StructField(n, T.BooleanType() if n == "inferred" else T.StringType()) for n in (x.split()[0] for x in STATEMENT.split(", "))])
#: What makes two statements the same one.
KEY = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def _column(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def statement(s: Column, p: Column | str, o: Column, o_kind: str = URI, o_dt: Column | str | None = None, s_kind: str = URI, o_lang: str | None = None) -> Column:
    """A struct of the statement schema."""
    dt = F.lit(None).cast("string") if o_dt is None else _column(o_dt)
    return F.struct(
        s.cast("string").alias("s"), F.lit(s_kind).alias("s_kind"), _column(p).alias("p"), o.cast("string").alias("o"), F.lit(o_kind).alias("o_kind"),
        dt.alias("o_dt"), F.lit(o_lang).cast("string").alias("o_lang"), F.lit(False).alias("inferred"),
    )


def link(s: Column, p: Column | str, o: Column) -> Column:
    """A statement whose object is a resource."""
    return statement(s, p, o)


def text(s: Column, p: Column | str, o: Column) -> Column:
    """A statement whose object is a plain literal."""
    return statement(s, p, o, LITERAL)


def typed(s: Column, p: Column | str, o: Column, datatype: str) -> Column:
    """A statement whose object is a literal of an XML Schema datatype (``int``, ``date``, ...)."""
    return statement(s, p, o, LITERAL, XSD + datatype)


def flatten(df: DataFrame, *statements: Column) -> DataFrame:
    """A row for each of the statements made of each row, but for those without subject or object.

    Every statement is a branch of its own: a constant predicate is a literal there, so the optimiser drops the
    branches that a query's predicate excludes and brings conditions on columns to the scans of the others."""
    branches = [df.select(x.alias("__x")).select("__x.*").where("s is not null and o is not null") for x in statements]
    return reduce(DataFrame.unionByName, branches)


def distinct(statements: DataFrame) -> DataFrame:
    """Every statement once; it is explicit if any of its rows is."""
    return statements.groupBy(*KEY).agg(F.bool_and("inferred").alias("inferred"))


def number(lexical: Column, datatype: Column) -> Column:
    """The value of a numeric literal, null for other terms."""
    return F.when(datatype.isin(*NUMERIC), lexical.try_cast("double"))


def pack(prefix: str) -> Column:
    """One sortable, joinable struct for the object term of a statement."""
    return F.struct(F.col("o").alias("v"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")).alias(prefix)


def show(v: Column, kind: Column, dt: Column, lang: Column) -> Column:
    """A term as N-Triples writes it."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull(), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise(""))
    return F.when(kind == URI, F.concat(F.lit("<"), v, F.lit(">"))).when(kind == BNODE, F.concat(F.lit("_:"), v)).otherwise(literal)
