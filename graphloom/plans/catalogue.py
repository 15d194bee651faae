"""The registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, robots, urls
from ..functions import terms as t
from ..operators import crawl, extract, frontier, mapping, rdfs, stats
from . import builtins, planner, views
from .views import BASE, FRONTIER, NOW, G, V

_NS = f"USING NAMESPACE v = <{V}>, n = <{BASE}nation/>, c = <{BASE}customer/>"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_more  # noqa: F401  (it registers its queries)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _p(name: str) -> str:
    return f"'{V}{name}'"


def _answer(spark: SparkSession, d: str, text: str, **bindings) -> DataFrame:
    """A query on the whole graph, as lexical forms."""
    return planner.plain(planner.select(views.graph(spark, d), text, views.counts(spark, d), **bindings))


LABEL, TYPE, SUB = f"'{t.LABEL}'", f"'{t.TYPE}'", f"'{t.SUB_CLASS}'"


# -- the query language
@query(f"""with {G} select name, price from (
  select name.o as name, price.o as price, price.s from g pb join g name on name.s = pb.o and name.p = {LABEL} join g price on price.s = pb.s and price.p = {_p('price')}
    join g pr on pr.s = pb.s and pr.p = {_p('priority')} and pr.o = '1-URGENT' where pb.p = {_p('placedBy')}
) order by try_cast(price as double) desc, name, price limit 20""")
def bgp_star_topk(spark, d):
    """A star with a chain, ordered by a number, cut to the first 20: a report."""
    text = f'SELECT name, price FROM {{o}} v:price {{price}}; v:priority {{"1-URGENT"}}; v:placedBy {{c}}, {{c}} rdfs:label {{name}} ORDER BY price DESC LIMIT 20 {_NS}'
    return _answer(spark, d, text)


@query(f"""with {G} select distinct seg.o as segment, cls.o as nation from g has join g b on b.s = has.o and b.p = {_p('brand')} and b.o = 'Brand#13' join g pb on pb.s = has.s and pb.p = {_p('placedBy')}
  join g seg on seg.s = pb.o and seg.p = {_p('segment')} join g cls on cls.s = pb.o and cls.p = {TYPE} where has.p = {_p('hasPart')}""")
def bgp_chain_distinct(spark, d):
    text = f'SELECT DISTINCT segment, nation FROM {{o}} v:hasPart {{}} v:brand {{"Brand#13"}}, {{o}} v:placedBy {{c}} v:segment {{segment}}, {{c}} rdf:type {{nation}} {_NS}'
    return _answer(spark, d, text)


@query(f"""with {G} select c.s as c, name.o as name from g c join g name on name.s = c.s and name.p = {LABEL} where c.p = {_p('segment')} and c.o = 'BUILDING'
  and not exists (select 1 from g pb join g pr on pr.s = pb.s and pr.p = {_p('priority')} and pr.o = '1-URGENT' where pb.p = {_p('placedBy')} and pb.o = c.s) and name.o <> 'Customer#000000001'""")
def bgp_not_exists(spark, d):
    text = f'SELECT c, name FROM {{c}} v:segment {{"BUILDING"}}; rdfs:label {{name}} WHERE NOT EXISTS (SELECT o FROM {{o}} v:placedBy {{c}}; v:priority {{pr}} WHERE pr = "1-URGENT") AND name != "Customer#000000001" {_NS}'
    return _answer(spark, d, text)


@query(f"""with {G} select l.s as x, l.o as name, seg.o as segment from g l left join g seg on seg.s = l.s and seg.p = {_p('segment')} where l.p = {LABEL}""")
def bgp_optional(spark, d):
    text = f"SELECT x, name, segment FROM {{x}} rdfs:label {{name}}, [{{x}} v:segment {{segment}}] {_NS}"
    return _answer(spark, d, text)


@query(f"""with {G} select o.s as o, o.o as price from g o join g pr on pr.s = o.s and pr.p = {_p('priority')} where o.p = {_p('price')}
  and (try_cast(o.o as bigint) >= 30000000 and regexp_matches(pr.o, '^1-.*$') or try_cast(o.o as bigint) < 500000 and pr.o <> '1-URGENT')""")
def bgp_filter_boolean(spark, d):
    text = f'SELECT o, price FROM {{o}} v:price {{price}}; v:priority {{pr}} WHERE price >= 30000000 AND pr LIKE "1-*" OR price < 500000 AND NOT pr = "1-URGENT" {_NS}'
    return _answer(spark, d, text)


@query(f"""with {G} select c.s as c from g c where c.p = {_p('segment')} and c.o = 'MACHINERY' and c.s in (select pb.o from g pb join g pr on pr.s = pb.s and pr.p = {_p('priority')} and pr.o = '5-LOW' where pb.p = {_p('placedBy')})""")
def bgp_in_subquery(spark, d):
    text = f'SELECT c FROM {{c}} v:segment {{"MACHINERY"}} WHERE c IN (SELECT b FROM {{o}} v:placedBy {{b}}; v:priority {{"5-LOW"}}) {_NS}'
    return _answer(spark, d, text)


def _set_query(op: str, d: str, spark: SparkSession) -> DataFrame:
    text = f'SELECT x FROM {{x}} v:brand {{"Brand#13"}}; v:size {{n}} WHERE n < 20 {op} SELECT x FROM {{x}} v:size {{n}} WHERE n > 10 AND n < 30 {_NS}'
    return _answer(spark, d, text)


def _set_sql(op: str) -> str:
    return f"""with {G} select b.s as x from g b join g n on n.s = b.s and n.p = {_p('size')} and n.o::INT < 20 where b.p = {_p('brand')} and b.o = 'Brand#13'
  {op} select n.s from g n where n.p = {_p('size')} and n.o::INT > 10 and n.o::INT < 30"""


@query(_set_sql("union"))
def set_union(spark, d):
    return _set_query("UNION", d, spark)


@query(_set_sql("union all"))
def set_union_all(spark, d):
    return _set_query("UNION ALL", d, spark)


@query(_set_sql("except"))
def set_minus(spark, d):
    return _set_query("MINUS", d, spark)


@query(_set_sql("intersect"))
def set_intersect(spark, d):
    return _set_query("INTERSECT", d, spark)


@query(f"""with {G} select pb.s, '{V}boughtBy' as p, cls.o, 'uri' as o_kind from g pb join g cls on cls.s = pb.o and cls.p = {TYPE} where pb.p = {_p('placedBy')} group by all""")
def construct_rewrite(spark, d):
    text = f"CONSTRUCT {{o}} v:boughtBy {{nation}} FROM {{o}} v:placedBy {{c}} rdf:type {{nation}} {_NS}"
    return planner.select(views.graph(spark, d), text, views.counts(spark, d)).select("s", "p", "o", "o_kind")


# -- fixed questions
@query(f"with {G} select x.v as value, exists (select 1 from g where o = x.v and o_kind = 'literal' and o_dt is null) as has from (values ('BUILDING'), ('no such text')) x(v)")
def has_literal(spark, d):
    g = views.graph(spark, d)
    return spark.createDataFrame([(v, builtins.has_literal(g, v)) for v in ("BUILDING", "no such text")], "value string, has boolean")


@query(f"with {G} select count(*) as statements from g")
def stmt_count(spark, d):
    return spark.createDataFrame([(builtins.count(views.graph(spark, d)),)], "statements bigint")


@query(f"with {G} select distinct s as node from g where p = {LABEL} and o = 'NATION_6'")
def what_label(spark, d):
    return builtins.what(views.graph(spark, d), "NATION_6")


@query(f"""with {G} select p as prop, o as "hasValue", NULL::VARCHAR as "isValueOf" from g where s = '{BASE}nation/6' union all select p, NULL, s from g where o = '{BASE}nation/6' and o_kind = 'uri'""")
def describe(spark, d):
    return builtins.describe(views.graph(spark, d), BASE + "nation/6")


_CLASSES = f"""classes as (
  select s as a, o as b from g where p = {SUB} union select e.s, c.b from g e join classes c on e.o = c.a where e.p = {SUB}
)"""
_SUBPROPERTIES = f"""props as (
  select s as a, o as b from g where p = '{t.SUB_PROPERTY}' union select e.s, q.b from g e join props q on e.o = q.a where e.p = '{t.SUB_PROPERTY}'
)"""
_TYPED = f"""typed as (
  select s as x, o as cls from g where p = {TYPE} union select s, '{V}Order' from g where p = {_p('placedBy')} union select o, '{V}Client' from g where p = {_p('placedBy')}
), alltypes as (select x, cls from typed union select x, b from typed join classes on cls = a)"""


@query(f"with recursive {G}, {_CLASSES} select a, b from classes")
def subclass_closure(spark, d):
    return rdfs.closure(rdfs._edges(views.graph(spark, d), t.SUB_CLASS))


@query(f"with recursive {G}, {_SUBPROPERTIES} select distinct s, b as p, o from g join props on p = a")
def subproperty_infer(spark, d):
    g = rdfs.infer(views.graph(spark, d))
    return g.where(F.col("p").isin(V + "concerns", V + "relatedTo")).select("s", "p", "o")


@query(f"with recursive {G}, {_CLASSES}, {_TYPED} select x, cls from alltypes")
def full_type(spark, d):
    return builtins.full_types(rdfs.infer(views.graph(spark, d)))


@query(f"""with recursive {G}, {_CLASSES}, {_TYPED} select x, cls from alltypes k where not exists (
  select 1 from alltypes z join classes c on z.cls = c.a where z.x = k.x and c.b = k.cls and z.cls <> k.cls)""")
def direct_type(spark, d):
    return builtins.direct_types(rdfs.infer(views.graph(spark, d)))


@query(f"with {G} select distinct s as x, '{V}Order' as cls from g where p = {_p('placedBy')} union select o, '{V}Client' from g where p = {_p('placedBy')}")
def domain_range(spark, d):
    g = rdfs.infer(views.graph(spark, d))
    return g.where((F.col("p") == t.TYPE) & F.col("o").isin(V + "Order", V + "Client")).select(F.col("s").alias("x"), F.col("o").alias("cls"))


@query(f"""with {G}, all_ as (select * from g union all select concat('{BASE}customer/', c_custkey), {_p('segment')}, (1900 + c_custkey % 150)::VARCHAR, 'literal', NULL from customer)
select distinct s, case when y then {_p('since')} else p end as p, o, o_kind, case when y then '{t.XSD}int' else o_dt end as o_dt from (
  select *, p = {_p('segment')} and o_kind = 'literal' and coalesce(try_cast(o as int) between 1913 and 2012, false) as y from all_)""")
def fix_predicate(spark, d):
    """Years that were written under the wrong predicate."""
    c = F.col("c_custkey")
    wrong = t.flatten(views.read(spark, d, "customer"), t.text(F.concat(F.lit(BASE + "customer/"), c.cast("string")), V + "segment", (1900 + c % 150).cast("string")))
    return builtins.fix_years(views.graph(spark, d).unionByName(wrong), V + "segment", V + "since").select("s", "p", "o", "o_kind", "o_dt")


@query(f"""with {G} select case when s = '{BASE}customer/1' then '{BASE}boss' else s end as s, case when p = {_p('placedBy')} then '{V}buyer' else p end as p,
  case when o_kind = 'uri' and o = '{BASE}customer/1' then '{BASE}boss' when o_kind = 'uri' and o = '{BASE}nation/1' then '{BASE}home' else o end as o, o_kind, o_dt
  from g""")
def map_statements(spark, d):
    m = mapping.Mapping([("SUBJECT", BASE + "customer/1", BASE + "boss"), ("OBJECT", BASE + "customer/1", BASE + "boss"), ("OBJECT", BASE + "nation/1", BASE + "home"), ("PREDICATE", V + "placedBy", V + "buyer")])
    return mapping.apply(views.graph(spark, d), m).select("s", "p", "o", "o_kind", "o_dt")


@query(f"with {G} select distinct s, p, o, o_kind, o_dt from g")
def dedup_store(spark, d):
    return t.distinct(views.graph(spark, d)).select("s", "p", "o", "o_kind", "o_dt")


# -- URLs and pages
_NORMAL = """case when regexp_replace({u}, '^[a-z]+://[^/?#]+', '') = '' then '' else '' end || regexp_replace(regexp_replace({u}, '#.*$', ''), '\\?.*$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_extract(regexp_replace({u}, '#.*$', ''), '\\?(.*)$', 1), '&')), lambda x: x <> '' and not regexp_matches(x, '^utm_|^[^=]*session'))), '&'), ''), '')"""
_URL_NORMAL = _NORMAL.format(u="url")


@query(f"select page_id, url, {_URL_NORMAL} as normal, concat('http://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '/') as host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as file from pages")
def url_normalize(spark, d):
    u = F.col("url")
    return views.read(spark, d, "pages").select("page_id", "url", urls.normalize(u).alias("normal"), urls.full_host(u).alias("host"), urls.file(u).alias("file"))


@query("""with a as (select distinct concat('http://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '/') as address from pages)
select count(*) as hosts, count(distinct address) as addresses, 7 + count(*) as last_id from a""")
def host_add(spark, d):
    """New hosts are numbered on from the greatest number; which number a host gets is not a result."""
    held = spark.createDataFrame([(7, "http://held.example/")], frontier.HOST)
    made = frontier.add_hosts(held, views.read(spark, d, "pages").select(urls.full_host(F.col("url")).alias("address"))).where("hostid > 7")
    return made.agg(F.countDistinct("hostid").alias("hosts"), F.countDistinct("address").alias("addresses"), F.max("hostid").cast("bigint").alias("last_id"))


#: A reference of the driver's pages as the library resolves it: root-relative, without escapes.
_LINKS = r"""found as (
  select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages
), plain as (select page_id, root, regexp_replace(replace(replace(href, '&amp;', '&'), '&quot;', '"'), '#.*$', '') as href from found)"""


@query(rf"""with {_LINKS} select page_id, root || href as link from plain""")
def link_extract(spark, d):
    """Links of every page (those of these pages are normal as they stand)."""
    return crawl.links(views.read(spark, d, "pages"), "page_id").select("page_id", "link")


@query(r"""with paths as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path from pages)
select page_id, path, regexp_full_match(path, '/[a-z]+/\d+\.html') or regexp_full_match(path, '/[a-z]+/\d+/?(\?.*)?') as is_entity,
  case when regexp_full_match(path, '/[a-z]+/\d+\.html') then '/[a-z]+/\d+\.html' else '/[a-z]+/\d+/?(\?.*)?' end as pattern from paths
where regexp_full_match(path, '/[a-z]+/\d+\.html') or regexp_full_match(path, '/[a-z]+/\d+/?(\?.*)?')""")
def url_classify(spark, d):
    pages = views.read(spark, d, "pages").select("page_id", urls.full_host(F.col("url")).alias("address"), urls.file(F.col("url")).alias("path")).join(views.hosts(spark, d), "address")
    return frontier.classify(pages, views.patterns(spark, d)).select("page_id", "path", "is_entity", "pattern")


_POLICY = "User-agent: *\nDisallow: /de/\nDisallow: /*/7\nAllow: /de/1\nCrawl-delay: 1.5"


@query(r"""with paths as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path from pages)
select page_id, path, not ((starts_with(path, '/de/') or regexp_matches(path, '^/[^/]+/7')) and not starts_with(path, '/de/1')) as allowed from paths""")
def robots_filter(spark, d):
    policy = spark.createDataFrame([(_POLICY,)], "robots string").select(robots.policy(F.col("robots")).alias("policy"))
    paths = views.read(spark, d, "pages").select("page_id", urls.file(F.col("url")).alias("path"))
    return paths.crossJoin(F.broadcast(policy)).select("page_id", "path", robots.allows(F.col("path"), F.col("policy")).alias("allowed"))


@query("select page_id, upper(coalesce(nullif(regexp_extract(html, 'charset=\"?([A-Za-z0-9-]+)', 1), ''), 'UTF-8')) as charset from pages")
def charset_detect(spark, d):
    return views.read(spark, d, "pages").select("page_id", html.charset(F.col("html")).alias("charset"))


def outline(page: extract.Page):
    """Language, kind and navigation of any page."""
    yield t.TYPE, extract.term(V + "Page")
    yield V + "lang", extract.lit(page.root.get("lang") or "")
    yield V + "links", extract.integer(str(len(page.nodes(page.root, ".//nav//a"))))
    yield V + "title", extract.lit(page.text(page.need(page.root, ".//head"), "title"))


OUTLINE = extract.Scraper("outline", V, outline, [V + "Page"])


@query(rf"""with p as (select url, html from pages)
select url as s, '{t.TYPE}' as p, '{V}Page' as o, NULL::VARCHAR as o_dt from p union all select url, '{V}lang', regexp_extract(html, '<html lang="([^"]*)"', 1), NULL from p
union all select url, '{V}links', len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a '))::VARCHAR, '{t.XSD}int' from p
union all select url, '{V}title', trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), NULL from p""")
def scrape_pages(spark, d):
    pages = views.read(spark, d, "pages").select("url", F.col("url").alias("base_url"), "html", F.array(F.lit("outline")).alias("scrapers"))
    return extract.scrape(pages, [OUTLINE])[0].select("s", "p", "o", "o_dt")


@query(r"""with paths as (select page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') as path from pages)
select page_id, s as scraper from (select page_id, case when regexp_full_match(path, '/[a-z]+/\d+\.html') then ['outline', 'second'] when regexp_full_match(path, '/[a-z]+/\d+/?(\?.*)?') then ['outline'] else [] end as names from paths), unnest(names) as x(s)""")
def router_union(spark, d):
    """Documents go to all scrapers of their pattern."""
    p = views.patterns(spark, d).withColumn("scrapers", F.when(F.col("ord") == 0, F.array(F.lit("outline"), F.lit("second"))).otherwise(F.col("scrapers")))
    pages = views.read(spark, d, "pages").select("page_id", urls.full_host(F.col("url")).alias("address"), urls.file(F.col("url")).alias("path")).join(views.hosts(spark, d), "address")
    return extract.route(frontier.classify(pages, p).select("page_id", "hostid", "pattern"), p).select("page_id", F.explode("scrapers").alias("scraper"))


# -- the frontier
def _frontier_query(spark: SparkSession, d: str) -> frontier.FrontierQuery:
    return frontier.FrontierQuery(views.frontier(spark, d), views.locks(spark, d))


_READY = f"ready as (select url.* from url where not exists (select 1 from url_lock l where l.urlid = url.urlid) and {NOW} > last_visited + update_freq and working)"
_ALL = ", ".join(frontier.COLUMNS)


@query(f"with {FRONTIER}, {_READY} select {_ALL} from ready where entity")
def frontier_due_unlocked(spark, d):
    return _frontier_query(spark, d).not_locked().due(NOW).working().entity().frame()


@query(f"with {FRONTIER} select {_ALL}, owner from url join url_lock using (urlid)")
def frontier_locked(spark, d):
    return frontier.list_locked(views.frontier(spark, d), views.locks(spark, d)).drop("time")


@query(f"with {FRONTIER} select {_ALL} from url where not working")
def frontier_broken(spark, d):
    return frontier.list_broken(views.frontier(spark, d))


@query(f"""with {FRONTIER}, {_READY}, ranked as (select *, row_number() over (partition by hostid, entity, pattern order by urlid) as rank from ready where entity)
select {_ALL} from ranked where rank <= case when pattern like '%html' then 30 else 20 end""")
def frontier_prefetch(spark, d):
    return frontier.prefetch(views.frontier(spark, d), views.locks(spark, d), views.patterns(spark, d), NOW, source_first=False)


@query(f"""with {FRONTIER}, {_READY}, sources as (select * from (select *, row_number() over (partition by hostid order by urlid) as rank from ready where not entity) where rank <= 50),
ranked as (select *, row_number() over (partition by hostid, entity, pattern order by urlid) as rank from ready where entity and hostid not in (select hostid from sources))
select {_ALL} from sources union all select {_ALL} from ranked where rank <= case when pattern like '%html' then 30 else 20 end""")
def source_first(spark, d):
    return frontier.prefetch(views.frontier(spark, d), views.locks(spark, d), views.patterns(spark, d), NOW)


@query(f"""with {FRONTIER}, held as (select * from url where urlid % 3 <> 0), entries as (select distinct hostid, path, pattern, entity from url), fresh as (
  select hostid, path, min((pattern, entity)) as e from entries where not exists (select 1 from held where held.hostid = entries.hostid and held.path = entries.path) group by 1, 2)
select count(*) as added, count(distinct path) as paths, sum(case when e[2] then 1 else 0 end)::BIGINT as entities, (select max(urlid) from held)::BIGINT + 1 as first_id, (select max(urlid) from held)::BIGINT + count(*) as last_id from fresh""")
def frontier_add_if_absent(spark, d):
    url = views.frontier(spark, d)
    added = frontier.add(url.where("urlid % 3 <> 0"), url.select("hostid", "path", "update_freq", "entity", "pattern"))
    return added.agg(F.count(F.lit(1)).alias("added"), F.countDistinct("path").alias("paths"), F.count(F.when(F.col("entity"), 1)).alias("entities"), F.min("urlid").alias("first_id"), F.max("urlid").alias("last_id"))


@query(f"""with {FRONTIER}, gone as (select hostid from host where hostid % 2 = 0)
select (select count(*) from host where hostid not in (select hostid from gone)) as hosts, (select count(*) from url where hostid not in (select hostid from gone)) as urls,
  (select count(*) from url_lock join url using (urlid) where hostid not in (select hostid from gone)) as locks""")
def remove_host_cascade(spark, d):
    hosts, url, locks = frontier.remove_hosts(views.hosts(spark, d), views.frontier(spark, d), views.locks(spark, d), views.hosts(spark, d).where("hostid % 2 = 0"))
    one = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    return one(hosts, "hosts").crossJoin(one(url, "urls")).crossJoin(one(locks, "locks"))


_STEPS = "list_transform(list_sort(list({'t': ts, 'e': event_id, 'ok': event_type <> 'error'})), lambda x: x.ok)"
_FOLD = f"list_reduce(list_prepend(0, list_transform({_STEPS}, lambda b: case when b then 1 else -1 end)), lambda s, x: case when x > 0 then least(0, s + 1) else greatest(s - 1, -3) end)"


@query(f"select user_id as urlid, {_FOLD}::SMALLINT as score, {_FOLD} > -3 as working from events group by user_id")
def score_fold(spark, d):
    """The score after all visits, a failure being an error event."""
    log = views.read(spark, d, "events").select(F.col("user_id").alias("urlid"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return frontier.fold_scores(log, order=("ts", "event_id"))


@query(f"""with {FRONTIER}, seen as (select user_id as urlid, bool_or(event_type <> 'error') as ok, bool_or(event_type in ('click', 'view')) as seen from events group by 1)
select urlid, case when coalesce(seen, false) then {NOW} else last_visited end::BIGINT as last_visited, (visit_count + case when coalesce(seen, false) then 1 else 0 end)::INT as visit_count,
  (case when ok is null then score when ok then least(0, score + 1) else greatest(score - 1, -3) end)::SMALLINT as score,
  case when ok is null then working else case when ok then least(0, score + 1) else greatest(score - 1, -3) end > -3 end as working from url left join seen using (urlid)""")
def visit_update(spark, d):
    e = F.col("event_type")
    seen = views.read(spark, d, "events").groupBy(F.col("user_id").cast("bigint").alias("urlid")).agg(F.bool_or(e != "error").alias("ok"), F.bool_or(e.isin("click", "view")).alias("fetched")).withColumn("allowed", F.lit(True))
    return frontier.visit(views.frontier(spark, d), seen, NOW).select("urlid", "last_visited", "visit_count", "score", "working")


# -- statistics
@query("select event_type as stat, count(*)::BIGINT as number, sum(round(value * 100)::BIGINT)::BIGINT as total, round(avg(round(value * 100)::BIGINT), 6) as average from events group by 1")
def stat_sum_avg(spark, d):
    cents = views.read(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    f = stats.FUNCTIONS
    return cents.groupBy(F.col("event_type").alias("stat")).agg(f["count"](F.col("cents")).alias("number"), f["sum"](F.col("cents")).alias("total"), F.round(f["average"](F.col("cents")), 6).alias("average"))


@query("select event_type as stat, round(coalesce(avg(gap), 0), 6) as interval_ms from (select event_type, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by event_type order by ts, event_id) as gap from events) group by 1")
def stat_interval(spark, d):
    ms = F.expr("unix_millis(cast(ts as timestamp))")
    return views.read(spark, d, "events").groupBy(F.col("event_type").alias("stat")).agg(F.round(stats.interval(ms), 6).alias("interval_ms"))


@query("select event_id, sum(round(value * 100)::BIGINT) over w::BIGINT as running_sum, count(*) over w as running_count from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def stat_running(spark, d):
    e = views.read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return stats.running(e, ["user_id"], ["ts", "event_id"], "cents").select("event_id", "running_sum", "running_count")


# -- the crawl: rounds of joins against the snapshot of pages
@query(f"""with {FRONTIER}, {_READY}, ranked as (select *, row_number() over (partition by hostid, entity, pattern order by urlid) as rank from ready where entity)
select regexp_replace(address, '/$', '') || ranked.path as url, ranked.pattern from ranked join host using (hostid) where rank <= case when ranked.pattern like '%html' then 30 else 20 end""")
def crawl_snapshot(spark, d):
    """The documents of one round: prefetch, fetch from the snapshot, entity pages out."""
    pages = views.read(spark, d, "pages")
    by_file = pages.select(F.concat(F.regexp_replace(urls.full_host(F.col("url")), "/$", ""), urls.file(F.col("url"))).alias("url"), "html")

    def fetch(wanted: DataFrame) -> DataFrame:
        held = by_file.groupBy("url").agg(F.min("html").alias("html"))
        return wanted.join(held, "url", "left").select("urlid", "html", F.when(F.col("html").isNull(), "not found").alias("error"))

    made = crawl.crawl_round(views.frontier(spark, d), views.locks(spark, d), views.hosts(spark, d), views.patterns(spark, d), fetch, NOW, source_first=False)
    return made.documents.select("url", "pattern")
