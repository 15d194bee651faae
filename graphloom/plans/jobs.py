"""Jobs from configuration files: the registered processors and their runner."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots
from ..operators import crawl, extract, frontier, mapping, stats
from ..operators.scrapers import SCRAPERS
from ..sources import config, rdf, store
from .pipeline import Attached, Context, Pipeline, Stage

#: Scrapers that configurations may name.
SCRAPER_NAMES: dict[str, extract.Scraper] = {s.name: s for s in SCRAPERS}


@dataclass
class CrawlSource(Stage):
    """Documents of a crawl to its end.

    The frontier is a folder of Parquet tables (host, url) beside the configuration; ``pages`` is a snapshot of
    (url, html), unless a fetcher is in the context under ``fetcher``; ``robots`` is a table (address, text)."""

    conf: str
    bootstrap: str = ""
    pages: str = "pages.parquet"
    robots: str = ""
    state: str = "frontier"
    rounds: int = 0
    now: int = 0

    def open(self, context: Context) -> None:
        self.context = context
        self.crawler = config.read_crawler(context.path(self.conf))

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = self.context.path(os.path.join(self.state, name))
        return spark.read.parquet(path) if os.path.exists(path) else spark.createDataFrame([], schema)

    def apply(self, df):
        spark = SparkSession.getActiveSession()
        addresses = spark.createDataFrame([(h.base_url,) for h in self.crawler.hosts], "address string")
        hosts = frontier.add_hosts(self._table(spark, "host", frontier.HOST), addresses)
        ids = {r.address: r.hostid for r in hosts.join(addresses, "address", "left_semi").collect()}  # the configuration's hosts
        patterns = config.patterns_frame(spark, self.crawler, ids)
        table = self._table(spark, "url", frontier.URL)
        seeds = self.context.path(self.bootstrap) if self.bootstrap else ""
        if seeds and os.path.exists(seeds):
            table = table.unionByName(frontier.bootstrap(spark.read.text(seeds), hosts, patterns, table))
        fetcher = self.context.get("fetcher") or crawl.snapshot(spark.read.parquet(self.context.path(self.pages)))
        policies = None
        if self.robots:
            texts = spark.read.parquet(self.context.path(self.robots)).join(hosts, "address")
            policies = texts.select("hostid", robots.policy(F.col("text")).alias("policy"))
        made = crawl.crawl(
            table, hosts, patterns, fetcher, self.now or int(time.time()), self.rounds or None, policies=policies, ignore_policy=self.crawler.policy_ignored,
            source_first=any(h.source_first for h in self.crawler.hosts),
        )
        numbers = made.counters.agg(*[F.sum(f"`{c}`").alias(c) for c in made.counters.columns]).first().asDict()
        for k, v in numbers.items():
            self.context[stats.key("Crawler", k)] = v or 0
        hosts.write.mode("overwrite").parquet(self.context.path(os.path.join(self.state, "host__new")))
        made.table.write.mode("overwrite").parquet(self.context.path(os.path.join(self.state, "url__new")))
        for name in ("host", "url"):
            _swap(spark, self.context.path(os.path.join(self.state, name)))
        if seeds and os.path.exists(seeds):
            os.replace(seeds, seeds + ".old")
        self.context["patterns"] = patterns
        return made.documents


def _swap(spark: SparkSession, path: str) -> None:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = make(path), make(path + "__new")
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.rename(new, old)


@dataclass
class ScrapeRouter(Stage):
    """Statements of all scrapers that a document's pattern names, after those of their classes."""

    scrapers: str = ""

    def open(self, context: Context) -> None:
        self.context = context

    def apply(self, df):
        spark = df.sparkSession
        routed = extract.route(df, self.context["patterns"])
        made, errors = extract.scrape(routed, list(SCRAPER_NAMES.values()))
        self.context["scrape_errors"] = errors
        return extract.class_statements(spark, list(SCRAPER_NAMES.values())).unionByName(made)


@dataclass
class MapStatements(Stage):
    mapping: str

    def open(self, context: Context) -> None:
        self.table, warnings = config.read_mapping(context.path(self.mapping))
        context.warnings += warnings

    def apply(self, df):
        return mapping.apply(df, self.table)


@dataclass
class StoreWriter(Stage):
    """Adds statements, and those of bootstrap RDF files, to the store, with inference if it has one."""

    conf: str
    bootstrap: str = ""
    bootBase: str = ""  # noqa: N815

    def open(self, context: Context) -> None:
        self.context = context

    def apply(self, df):
        spark = df.sparkSession
        made, infer, warning = store.open_store(spark, store.properties(self.context.path(self.conf)), os.path.dirname(self.context.path(self.conf)))
        self.context.warnings += [warning] if warning else []
        more, warnings = rdf.load(spark, self.bootstrap, self.bootBase, self.context.working_dir)
        self.context.warnings += warnings
        everything = made.read().where("not inferred").unionByName(df if more is None else df.unionByName(more))
        made.replace(infer(everything) if infer else everything)
        for entry in filter(None, (x.strip() for x in self.bootstrap.split(","))):
            path = self.context.path(entry)
            if os.path.exists(path):
                os.replace(path, path + ".old")
        out = made.read()
        self.context[stats.key("StoreWriter", "stat.count")] = out.where("not inferred").count()
        return out


@dataclass
class StatsWriter(Attached):
    """Writes the context's values when the chain has stopped (and whenever write() is called)."""

    file: str = "stdout"
    interval: int = 0
    filter: str = ""

    def write(self, context: Context) -> None:
        target = self.file if self.file in ("stdout", "stderr") else context.path(self.file)
        stats.write({k: v for k, v in context.items() if isinstance(v, int | float | str)}, target, [x for x in self.filter.split(",") if x])

    def chain_stopped(self, pipeline: Pipeline) -> None:
        self.write(pipeline.context)


@dataclass
class Printer(Stage):
    rows: int = 20

    def apply(self, df):
        df.show(self.rows, truncate=False)
        return df


#: Names of processors in job files; a dotted name is known by its last part.
REGISTRY: dict[str, type] = {
    "crawl": CrawlSource, "scrape": ScrapeRouter, "map": MapStatements, "store": StoreWriter, "stats": StatsWriter, "print": Printer,
}


def register(name: str, processor: type | Callable) -> None:
    REGISTRY[name] = processor


def build(step: config.Step):
    name = step.name if step.name in REGISTRY else step.name.rpartition(".")[2]
    if name not in REGISTRY:
        raise ValueError(f"no processor {step.name!r}")
    return config.inject(REGISTRY[name], step.params)


@dataclass
class Runner:
    """A job file, or the ``job.xml`` of a folder; its folder is the working folder."""

    path: str
    context: Context = field(init=False)

    def __post_init__(self):
        self.path = os.path.join(self.path, "job.xml") if os.path.isdir(self.path) else self.path
        self.context = Context(os.path.dirname(os.path.abspath(self.path)))
        job = config.read_job(self.path)
        attached = []
        for step in job.attached:
            try:
                attached.append(build(step))
            except ValueError as problem:  # one that can't start is left out
                self.context.warnings.append(str(problem))
        self.pipeline = Pipeline([build(s) for s in job.chain], attached, self.context)

    def run(self) -> DataFrame | None:
        return self.pipeline.start()
