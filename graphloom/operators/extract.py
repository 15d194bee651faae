"""Extraction of statements from pages by scrapers, and their routing.

A scraper is a Python generator over a page's tree that yields facts in order.  All scrapers of a page run in
one Arrow pass over one parse; addresses are resolved and normalised afterwards, in the JVM.  Where a scraper
fails, what it has yielded stays and the failure is counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import terms as t
from ..functions import urls

#: (subject or None for the page, predicate, object, kind, datatype, is the subject's address raw)
Fact = tuple


class Page:
    """A page's tree with the queries that scrapers use.

    Paths are those of ElementTree, with ``/@name`` at the end for attributes; a step ``//`` begins with a dot."""

    def __init__(self, html: str | None, url: str = "", base: str = ""):
        self.root, self.url, self.base = h.tree(html), url, base

    @staticmethod
    def nodes(at: Element, path: str) -> list[Element]:
        return at.findall(path)

    @staticmethod
    def need(at: Element, path: str) -> Element:
        """The first match; a scraper fails where there is none."""
        found = at.find(path)
        if found is None:
            raise LookupError(path)
        return found

    @staticmethod
    def first_text(node: Element) -> str:
        """Text of the node's first child alone, trimmed."""
        if node.text and node.text.strip():
            return node.text.strip()
        return "".join(node[0].itertext()).strip() if len(node) else ""

    @staticmethod
    def all_text(node: Element) -> str:
        return "".join(node.itertext())

    def texts(self, at: Element, path: str) -> list[str]:
        head, _, attribute = path.partition("/@")
        if attribute:
            return [n.get(attribute) for n in at.findall(head) if n.get(attribute) is not None]
        return [self.first_text(n) for n in at.findall(path)]

    def text(self, at: Element, path: str) -> str | None:
        return next(iter(self.texts(at, path)), None)


def lit(s: str) -> tuple:
    """A plain literal, trimmed; the page's tree has its references undone already, and once is enough."""
    return s.strip(), t.LITERAL, None


def integer(s: str) -> tuple:
    return str(int(s.strip())), t.LITERAL, t.XSD + "int"


def date(year: str, month: str, day: str) -> tuple:
    return f"{int(year):04d}-{int(month):02d}-{int(day):02d}", t.LITERAL, t.XSD + "date"


def term(uri: str) -> tuple:
    """A URI that is known, as a vocabulary term."""
    return uri, t.URI, ""


def address(ref: str) -> tuple:
    """A reference of the page, to be resolved and normalised."""
    return ref, t.URI, None


@dataclass
class Scraper:
    """``facts(page)`` yields (predicate, object), or (subject reference, predicate, object) where the subject is
    another resource; None for the object's place in such a triple is the page itself."""

    name: str
    namespace: str
    facts: Callable[[Page], Iterator[tuple]]
    classes: list[str] = field(default_factory=list)
    vocabulary: dict[str, str] = field(default_factory=dict)


def class_statements(spark: SparkSession, scrapers: list[Scraper]) -> DataFrame:
    """(class, rdf:type, rdfs:Class) for the classes that the scrapers state."""
    rows = sorted({c for s in scrapers for c in s.classes})
    return spark.createDataFrame([(c, "uri", t.TYPE, t.CLASS, "uri", None, None, False) for c in rows], t.SCHEMA)


def vocabulary(spark: SparkSession, scrapers: list[Scraper]) -> DataFrame:
    """(term, definition) of the scrapers' vocabularies."""
    return spark.createDataFrame(sorted({(k, v) for s in scrapers for k, v in s.vocabulary.items()}), "term string, definition string")


def _run(page: Page, scraper: Scraper) -> Iterator[tuple]:
    """(s, p, o, kind, datatype) rows; s and o as raw references; the last may be an error row."""
    try:
        for fact in scraper.facts(page):
            subject, predicate, value = fact if len(fact) == 3 else (None, *fact)
            o, kind, dt = (None, t.URI, None) if value is None else value
            yield subject, predicate, o, kind, dt
    except Exception as problem:  # whatever a scraper may do, the pages after it go on
        yield None, None, f"{scraper.name}: {type(problem).__name__}: {problem}", "error", None


def raw_facts(routed: DataFrame, scrapers: dict[str, Scraper]) -> DataFrame:
    """(url, base_url, s, p, o, kind, dt) from (url, base_url, html, scrapers: array of names)."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for url, base, html, names in zip(*(batch.column(c).to_pylist() for c in ("url", "base_url", "html", "scrapers")), strict=True):
                page = Page(html, url, base)
                rows += [(url, base, *row) for n in names or () if n in scrapers for row in _run(page, scrapers[n])]
            names = ["url", "base_url", "s", "p", "o", "kind", "dt"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return routed.select("url", "base_url", "html", "scrapers").mapInArrow(run, "url string, base_url string, s string, p string, o string, kind string, dt string")


def route(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """documents with the names of all scrapers that their pattern has in their host."""
    # a host's patterns are few
    named = patterns.where("is_entity").groupBy("hostid", "pattern").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scrapers")))).alias("scrapers"))
    return documents.join(named, ["hostid", "pattern"]).select(*documents.columns, "scrapers")


def scrape(routed: DataFrame, scrapers: list[Scraper]) -> tuple[DataFrame, DataFrame]:
    """(statements, errors) of routed documents.  errors: (url, message); a page's statements before its error
    stay.  An address that can't be normalised loses its statement alone."""
    raw = raw_facts(routed, {s.name: s for s in scrapers})
    base = F.coalesce("base_url", "url")
    full = lambda c: urls.normalize(urls.resolve(base, F.col(c)))
    s = F.when(F.col("s").isNull(), F.col("url")).otherwise(full("s"))
    o = F.when(F.col("kind") == t.LITERAL, F.col("o")).when(F.col("o").isNull(), F.col("url")).when(F.col("dt") == "", F.col("o")).otherwise(full("o"))
    fact = F.struct(
        s.alias("s"), F.lit(t.URI).alias("s_kind"), F.col("p"), o.alias("o"), F.col("kind").alias("o_kind"), F.when(F.col("kind") == t.LITERAL, F.col("dt")).alias("o_dt"),
        F.lit(None).cast("string").alias("o_lang"), F.lit(False).alias("inferred"),
    )
    made = raw.where("kind <> 'error'").select(F.inline(F.array(fact)))  # a generator, as in urls.once()
    return made.where("s is not null and p is not null and o is not null"), raw.where("kind = 'error'").select("url", F.col("o").alias("message"))
