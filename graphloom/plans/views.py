"""The driver tables as a statement graph and as a crawl frontier, in Spark and in DuckDB's SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions import urls

BASE = "http://graph.example/"
V = BASE + "v#"
#: The time of all frontier queries (epoch seconds).
NOW = 1_700_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{BASE}{kind}/"), F.col(key).cast("string"))


def schema_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nations below regions below Place; orders' predicates with a domain, a range and a sub-property."""
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    r, n = _id("region", "r_regionkey"), _id("nation", "n_nationkey")
    fixed = [
        (V + "placedBy", t.DOMAIN, V + "Order"), (V + "placedBy", t.RANGE, V + "Client"), (V + "placedBy", t.SUB_PROPERTY, V + "concerns"),
        (V + "concerns", t.SUB_PROPERTY, V + "relatedTo"), (V + "Client", t.SUB_CLASS, V + "Agent"),
    ]
    more = spark.createDataFrame(fixed, "s string, p string, o string")
    return (
        t.flatten(region, t.link(r, t.TYPE, F.lit(t.CLASS)), t.link(r, t.SUB_CLASS, F.lit(V + "Place")), t.text(r, t.LABEL, F.col("r_name")))
        .unionByName(t.flatten(nation, t.link(n, t.TYPE, F.lit(t.CLASS)), t.link(n, t.SUB_CLASS, _id("region", "n_regionkey")), t.text(n, t.LABEL, F.col("n_name"))))
        .unionByName(t.flatten(more, t.link(F.col("s"), F.col("p"), F.col("o"))))
    )


def agents_graph(spark: SparkSession, d: str) -> DataFrame:
    customer, supplier = read(spark, d, "customer"), read(spark, d, "supplier")
    c, s = _id("customer", "c_custkey"), _id("supplier", "s_suppkey")
    return t.flatten(customer, t.link(c, t.TYPE, _id("nation", "c_nationkey")), t.text(c, t.LABEL, F.col("c_name")), t.text(c, V + "segment", F.col("c_mktsegment"))).unionByName(
        t.flatten(supplier, t.link(s, t.TYPE, _id("nation", "s_nationkey")), t.text(s, t.LABEL, F.col("s_name")))
    )


def orders_graph(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    o = _id("order", "o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return t.flatten(orders, t.link(o, V + "placedBy", _id("customer", "o_custkey")), t.typed(o, V + "price", cents, "integer"), t.text(o, V + "priority", F.col("o_orderpriority")))


def parts_graph(spark: SparkSession, d: str) -> DataFrame:
    part, line = read(spark, d, "part"), read(spark, d, "lineitem")
    p = _id("part", "p_partkey")
    return t.flatten(part, t.text(p, t.LABEL, F.col("p_name")), t.text(p, V + "brand", F.col("p_brand")), t.typed(p, V + "size", F.col("p_size"), "int")).unionByName(
        t.flatten(line, t.link(_id("order", "l_orderkey"), V + "hasPart", _id("part", "l_partkey")))
    )


def graph(spark: SparkSession, d: str) -> DataFrame:
    return schema_graph(spark, d).unionByName(agents_graph(spark, d)).unionByName(orders_graph(spark, d)).unionByName(parts_graph(spark, d))


_COUNTS: dict[tuple[str, str], dict[str, int]] = {}


def counts(spark: SparkSession, d: str) -> dict[str, int]:
    """Rows of graph() by predicate, for the join order: from the tables' numbers of rows, which their footers have."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COUNTS:
        rows = {table: read(spark, d, table).count() for table in {r[0] for r in _RAW}}
        found: dict[str, int] = {}
        for p, n in [(r[2], rows[r[0]]) for r in _RAW] + [(p, 1) for _, p, _ in _FIXED]:
            found[p] = found.get(p, 0) + n
        _COUNTS[key] = found
    return _COUNTS[key]


def _row(s: str, p: str, o: str, kind: str = "uri", dt: str | None = None) -> str:
    dt = f"'{dt}'" if dt else "NULL::VARCHAR"
    return f"{s} as s, {p} as p, {o} as o, '{kind}' as o_kind, {dt} as o_dt"


def _uri(kind: str, key: str) -> str:
    return f"concat('{BASE}{kind}/', {key})"


_RAW = [
    ("region", _uri("region", "r_regionkey"), t.TYPE, f"'{t.CLASS}'", "uri", None), ("region", _uri("region", "r_regionkey"), t.SUB_CLASS, f"'{V}Place'", "uri", None), ("region", _uri("region", "r_regionkey"), t.LABEL, "r_name", "literal", None),
    ("nation", _uri("nation", "n_nationkey"), t.TYPE, f"'{t.CLASS}'", "uri", None), ("nation", _uri("nation", "n_nationkey"), t.SUB_CLASS, _uri("region", "n_regionkey"), "uri", None), ("nation", _uri("nation", "n_nationkey"), t.LABEL, "n_name", "literal", None),
    ("customer", _uri("customer", "c_custkey"), t.TYPE, _uri("nation", "c_nationkey"), "uri", None), ("customer", _uri("customer", "c_custkey"), t.LABEL, "c_name", "literal", None), ("customer", _uri("customer", "c_custkey"), V + "segment", "c_mktsegment", "literal", None),
    ("supplier", _uri("supplier", "s_suppkey"), t.TYPE, _uri("nation", "s_nationkey"), "uri", None), ("supplier", _uri("supplier", "s_suppkey"), t.LABEL, "s_name", "literal", None),
    ("orders", _uri("order", "o_orderkey"), V + "placedBy", _uri("customer", "o_custkey"), "uri", None), ("orders", _uri("order", "o_orderkey"), V + "price", "round(o_totalprice * 100)::BIGINT::VARCHAR", "literal", t.XSD + "integer"), ("orders", _uri("order", "o_orderkey"), V + "priority", "o_orderpriority", "literal", None),
    ("part", _uri("part", "p_partkey"), t.LABEL, "p_name", "literal", None), ("part", _uri("part", "p_partkey"), V + "brand", "p_brand", "literal", None), ("part", _uri("part", "p_partkey"), V + "size", "p_size::VARCHAR", "literal", t.XSD + "int"),
    ("lineitem", _uri("order", "l_orderkey"), V + "hasPart", _uri("part", "l_partkey"), "uri", None),
]
_FIXED = [(V + "placedBy", t.DOMAIN, V + "Order"), (V + "placedBy", t.RANGE, V + "Client"), (V + "placedBy", t.SUB_PROPERTY, V + "concerns"), (V + "concerns", t.SUB_PROPERTY, V + "relatedTo"), (V + "Client", t.SUB_CLASS, V + "Agent")]
#: DuckDB: the statement graph as the common table ``g`` (s, p, o, o_kind, o_dt).
G = "g as (\n  " + "\n  union all ".join(
    [f"select {_row(s, repr(p), o, kind, dt)} from {table} where {o} is not null" for table, s, p, o, kind, dt in _RAW] + [f"select {_row(repr(s), repr(p), repr(o))}" for s, p, o in _FIXED]
) + ")"


# -- the frontier: every page is a URL whose state follows from its number
def hosts(spark: SparkSession, d: str) -> DataFrame:
    """(hostid, address): a host's number is the least page_id that it has."""
    pages = read(spark, d, "pages")
    return pages.groupBy(urls.full_host(F.col("url")).alias("address")).agg(F.min("page_id").cast("int").alias("hostid")).select("hostid", "address")


def frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages as frontier rows with a state made of their numbers."""
    n = F.col("page_id")
    pages = read(spark, d, "pages").select("page_id", urls.full_host(F.col("url")).alias("address"), urls.file(F.col("url")).alias("path"))
    is_entity = F.col("path").rlike("^/[a-z]+/[0-9]")
    pattern = F.when(F.col("path").rlike(r"\.html$"), F.lit(r"/[a-z]+/\d+\.html")).otherwise(F.lit(r"/[a-z]+/\d+/?(\?.*)?"))
    return pages.join(hosts(spark, d), "address").select(
        n.cast("bigint").alias("urlid"), "hostid", "path", (F.lit(NOW - 86_400) - (n * 7919) % 172_800).cast("bigint").alias("last_visited"), (n % 5).cast("int").alias("visit_count"),
        F.lit(86_400).alias("update_freq"), (is_entity & (n % 4 != 0)).alias("entity"), pattern.alias("pattern"), (n % 7 != 0).alias("working"), F.negative(n % 4).cast("smallint").alias("score"),
    )


def locks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").where("page_id % 5 = 0").select(F.lit(0).alias("owner"), F.col("page_id").cast("bigint").alias("urlid"), F.timestamp_seconds(F.lit(NOW)).alias("time"))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """Two entity patterns of weights 3 and 2 and one for sources, for every host."""
    rows = [(0, True, r"/[a-z]+/\d+\.html", 3), (1, True, r"/[a-z]+/\d+/?(\?.*)?", 2), (2, False, r"/[^/]*", 1)]
    fixed = spark.createDataFrame(rows, "ord int, is_entity boolean, pattern string, weight int")
    return hosts(spark, d).select("hostid").crossJoin(F.broadcast(fixed)).select("hostid", "ord", "is_entity", "pattern", F.lit(86_400).alias("update_freq"), "weight", F.array(F.lit("outline")).alias("scrapers"))


FRONTIER = f"""parts as (
  select page_id, url, concat('http://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '/') as address,
    regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path from pages
), host as (select min(page_id)::INT as hostid, address from parts group by address
), url as (
  select page_id::BIGINT as urlid, hostid, path, ({NOW} - 86400 - (page_id * 7919) % 172800)::BIGINT as last_visited, (page_id % 5)::INT as visit_count, 86400 as update_freq,
    regexp_matches(path, '^/[a-z]+/[0-9]') and page_id % 4 <> 0 as entity,
    case when regexp_matches(path, '\\.html$') then '/[a-z]+/\\d+\\.html' else '/[a-z]+/\\d+/?(\\?.*)?' end as pattern, page_id % 7 <> 0 as working, (-(page_id % 4))::SMALLINT as score
  from parts join host using (address)
), url_lock as (select 0 as owner, page_id::BIGINT as urlid from pages where page_id % 5 = 0)"""
