"""RDFS inference by forward chaining, as joins repeated until nothing new follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.terms import CLASS, DOMAIN, RANGE, RDF, RDFS, SUB_CLASS, SUB_PROPERTY, TYPE, URI
from ..sources.shared import cut


SCHEMA = (SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for every path of one edge or more in (a, b).

    Each round joins the paths with themselves, so rounds grow with the logarithm of the longest path;
    cycles end when no path is new."""
    paths = cut(edges.select("a", "b").distinct())
    known = paths.count()
    while True:
        longer = paths.select("a", F.col("b").alias("m")).join(paths.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        paths = cut(paths.union(longer).distinct())
        now = paths.count()
        if now == known:
            return paths
        known = now


def _name(term: str, kind: str) -> Column:
    """A resource in one column: blank nodes are marked, as no URI begins like that."""
    return F.when(F.col(kind) == t.BNODE, F.concat(F.lit("_:"), F.col(term))).otherwise(F.col(term))


def _parts(name: Column) -> tuple[Column, Column]:
    blank = name.startswith("_:")
    return F.when(blank, F.substring(name, F.lit(3), F.length(name))).otherwise(name), F.when(blank, t.BNODE).otherwise(URI)


def _edges(statements: DataFrame, predicate: str) -> DataFrame:
    return statements.where((F.col("p") == predicate) & F.col("o_kind").isin(URI, t.BNODE)).select(_name("s", "s_kind").alias("a"), _name("o", "o_kind").alias("b"))


def _triples(pairs: DataFrame, predicate: str) -> DataFrame:
    """(a, b) as inferred statements between resources."""
    (s, s_kind), (o, o_kind), none = _parts(F.col("a")), _parts(F.col("b")), F.lit(None).cast("string")
    return pairs.select(s.alias("s"), s_kind.alias("s_kind"), F.lit(predicate).alias("p"), o.alias("o"), o_kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), F.lit(True).alias("inferred"))


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A schema table, to be sent to all executors if it has no more rows than that; else Spark joins it by its size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _closed_schema(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schema statements, closure of sub-properties).  A sub-property of a schema predicate makes schema statements
    itself, so this is repeated until none is new; without such a sub-property the statements are read once."""
    schema = cut(t.distinct(statements.where(F.col("p").isin(*SCHEMA))))
    while True:
        properties = closure(_edges(schema, SUB_PROPERTY))
        own = properties.where(F.col("b").isin(*SCHEMA) & ~F.col("a").isin(*SCHEMA) | F.col("a").isin(*SCHEMA) & F.col("b").isin(*SCHEMA) & (F.col("a") != F.col("b")))
        if own.isEmpty():
            return schema, properties
        more = statements.unionByName(schema).join(_small(own.select(F.col("a").alias("p"), F.col("b").alias("__p"))), "p").withColumn("p", F.col("__p")).select(*t.KEY).withColumn("inferred", F.lit(True))
        after = cut(t.distinct(schema.unionByName(more)))
        fresh = after.select(*t.KEY[:4]).join(schema.select(*t.KEY[:4]), t.KEY[:4], "left_anti").isEmpty()
        schema = after
        if fresh:
            return schema, properties


def infer(statements: DataFrame, axioms: bool = False) -> DataFrame:
    """The statements and all that follows by domain, range, sub-properties, sub-classes and the types that
    they give (rdfs2, 3, 5, 7, 9, 11).  Explicit statements stay explicit; inferred ones are marked.

    Only schema statements are closed, in rounds; what they say of a predicate (its super-properties, and the classes
    of its subjects and objects with all that are above) is put in small tables, which the instance statements are joined with
    once.  Nothing else is written, so a query of the result reads what it asks for.  With ``axioms`` every resource is a Resource, every class a
    sub-class of itself and of Resource, every property a sub-property of itself."""
    schema, properties = _closed_schema(statements)
    classes = closure(_edges(schema, SUB_CLASS))
    above = classes.select(F.col("a").alias("__c"), F.col("b").alias("__up"))

    def with_upper(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select("a", F.col("b").alias("__c")).join(above, "__c").select("a", F.col("__up").alias("b"))).distinct()

    def of_predicate(kind: str) -> DataFrame:
        """(p, b): the classes that a predicate gives, by itself and by its super-properties."""
        stated = _edges(schema, kind)
        inherited = properties.select("a", F.col("b").alias("__p")).join(stated.withColumnRenamed("a", "__p"), "__p").select("a", "b")
        return _small(cut(with_upper(stated.union(inherited))).withColumnRenamed("a", "p"))

    links = F.col("o_kind").isin(URI, t.BNODE)
    upper = _small(cut(properties.where("a <> b").select(F.col("a").alias("p"), F.col("b").alias("__p"))))
    inherited = statements.join(upper, "p").withColumn("p", F.col("__p")).select(*t.KEY).withColumn("inferred", F.lit(True))
    by_domain = statements.join(of_predicate(DOMAIN), "p").select(_name("s", "s_kind").alias("a"), "b")
    by_range = statements.where(links).join(of_predicate(RANGE), "p").select(_name("o", "o_kind").alias("a"), "b")
    below = _small(cut(properties.where(F.col("b") == TYPE).select(F.col("a").alias("p"))))
    stated = _edges(statements, TYPE).union(_edges(statements.join(below, "p", "left_semi").withColumn("p", F.lit(TYPE)), TYPE))
    up = stated.select("a", F.col("b").alias("__c")).join(_small(above), "__c").select("a", F.col("__up").alias("b"))
    of_types = _triples(by_domain.union(by_range).union(stated).union(up), TYPE)
    everything = statements.select(*t.SCHEMA.names).unionByName(inherited).unionByName(schema).unionByName(_triples(properties, SUB_PROPERTY)).unionByName(of_types).unionByName(_triples(classes, SUB_CLASS))
    if axioms:
        known = everything
        resources = known.select("s", "s_kind").union(known.where(links).select("o", "o_kind")).union(known.select("p", F.lit(URI))).distinct()
        everything = everything.unionByName(_axiom(resources, TYPE, F.lit(RDFS + "Resource")))
        named = known.where((F.col("p") == TYPE) & (F.col("o") == CLASS)).select("s", "s_kind").union(known.where(F.col("p") == SUB_CLASS).select(F.inline(F.array(F.struct("s", "s_kind"), F.struct(F.col("o").alias("s"), F.col("o_kind").alias("s_kind")))))).distinct()
        used = known.select(F.col("p").alias("s"), F.lit(URI).alias("s_kind")).distinct()
        for frame, p, o in ((named, SUB_CLASS, F.col("s")), (named, SUB_CLASS, F.lit(RDFS + "Resource")), (used, TYPE, F.lit(RDF + "Property")), (used, SUB_PROPERTY, F.col("s"))):
            everything = everything.unionByName(_axiom(frame, p, o))
    return t.distinct(everything)


def _axiom(resources: DataFrame, p: str, o) -> DataFrame:
    none = F.lit(None).cast("string")
    return resources.select("s", "s_kind", F.lit(p).alias("p"), o.alias("o"), F.lit(URI).alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), F.lit(True).alias("inferred"))
