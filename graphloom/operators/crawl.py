"""The crawl source: frontier rows become pages, pages become links, links become frontier rows.

A *fetcher* turns URLs into pages.  The default one joins a snapshot of pages by URL, so that a crawl is a
sequence of joins; another may fetch over the network, a host's URLs in one partition and in turn."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import robots, urls
from ..sources.shared import cut
from . import frontier

DOCUMENT = "base_url string, url string, hostid int, pattern string, html string"
RETRIES, PAUSE, TIMEOUT, AGENT = 2, 5.0, 10.0, robots.AGENT
#: The error of a server that answers but has no such page; any other one is taken for no answer.
NOT_FOUND = "not found"
#: A fetcher: (hostid, urlid, url) -> (urlid, html, error); html is null where it failed.
Fetcher = Callable[[DataFrame], DataFrame]


def snapshot(pages: DataFrame) -> Fetcher:
    """Pages (url, html) by their normal address; of several with the same one, the least page counts.

    No server has to be spared here, so crawl() takes all that is due at once."""
    held = pages.select(urls.once(urls.normalize(F.col("url")), "url"), "html").where("url is not null").groupBy("url").agg(F.min("html").alias("html"))

    def fetch(wanted: DataFrame) -> DataFrame:
        return wanted.join(held, "url", "left").select("urlid", "html", F.when(F.col("html").isNull(), NOT_FOUND).alias("error"))

    fetch.at_once = True
    return fetch


def network(get: Callable[[str, dict, float], str], delay_ms: int, retries: int = RETRIES, pause: float = PAUSE, referer: bool = False, sleep=time.sleep) -> Fetcher:
    """Fetches with ``get(url, headers, timeout)``, a host's URLs one after another with the delay between,
    each tried again ``retries`` times.  The function is injected: nothing here opens a connection."""

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = []
            for urlid, url in zip(batch["urlid"], batch["url"], strict=True):
                page, error = None, None
                headers = {"User-Agent": AGENT} | ({"Referer": url.split("/", 3)[0] + "//" + url.split("/", 3)[2] + "/"} if referer else {})
                for k in range(retries + 1):
                    try:
                        page, error = get(url, headers, TIMEOUT), None
                        break
                    except OSError as problem:
                        error = str(problem) or type(problem).__name__
                        if k < retries:
                            sleep(pause)
                rows.append((urlid, page, error))
                sleep(delay_ms / 1000)
            yield pd.DataFrame(rows, columns=["urlid", "html", "error"])

    return lambda wanted: wanted.repartition("hostid").sortWithinPartitions("hostid", "urlid").mapInPandas(run, "urlid bigint, html string, error string")


def crawl_delay(host_delay: Column, policy: Column, least_ms: int) -> Column:
    """The pause between two fetches of a host, in ms: its own or else the robots file's, but no less than the least."""
    return F.greatest(F.lit(least_ms), F.coalesce(host_delay, robots.delay_ms(policy), F.lit(0)))


def schedule(batch: DataFrame, delay_ms: Column, start_ms: int = 0) -> DataFrame:
    """``fetch_at`` (ms) of each URL: a host's URLs follow each other by the delay."""
    rank = F.row_number().over(Window.partitionBy("hostid").orderBy("urlid"))
    return batch.withColumn("fetch_at", F.lit(start_ms).cast("bigint") + (rank - 1) * delay_ms)


def links(documents: DataFrame, *keep: str) -> DataFrame:
    """(url, link): every link of (url, html) to the page's own host, as a normal address; with the columns ``keep``, which tell
    pages of the same URL apart.

    Relative links are resolved against the page's base address if it has one, else its URL; what isn't a
    URL, and other schemes than http(s), is left out."""
    based = documents.select(*keep, "url", "html", urls.once(F.coalesce(urls.normalize(h.base_href(F.col("html"))), F.col("url")), "__base"))
    wanted = F.filter(h.hrefs(F.col("html")), lambda x: ~x.rlike("^(?i:javascript|mailto|data|tel|ftp):"))
    target = F.transform(wanted, lambda x: urls.normalize(urls.resolve(F.col("__base"), urls.unescape(x))))
    out = based.select(*keep, "url", F.explode(target).alias("link"))
    return out.where(F.col("link").rlike("^https?://") & urls.equal_hosts(F.col("url"), F.col("link")))


def new_links(documents: DataFrame, hosts: DataFrame, patterns: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that a pattern of their host matches, frontier rows that are new)."""
    placed = links(documents).select(urls.full_host(F.col("link")).alias("address"), urls.file(F.col("link")).alias("path")).join(hosts, "address").select("hostid", "path")
    # the pages are read and parsed once for what is counted, what is new and the table after it
    valid = cut(frontier.classify(placed, patterns).withColumnRenamed("is_entity", "entity"))
    return valid, cut(frontier.add(table, valid))


def hosts_down(fetched: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(hostid, down) of the hosts whose fetches all got no answer: down if their own address gets none either."""
    silent = lambda: F.col("html").isNull() & (F.coalesce("error", F.lit("")) != NOT_FOUND)
    lost = fetched.where("allowed").groupBy("hostid", "address").agg(F.bool_and(silent()).alias("lost")).where("lost").select("hostid", "address")
    if lost.isEmpty():
        return lost.select("hostid", F.lit(True).alias("down"))
    lost = cut(lost)
    probed = fetcher(lost.select("hostid", F.col("hostid").cast("bigint").alias("urlid"), F.col("address").alias("url")))
    return probed.select(F.col("urlid").cast("int").alias("hostid"), silent().alias("down"))


@dataclass
class Round:
    """What one round of a crawl made: entity pages, the frontier after it, and its counters."""

    documents: DataFrame
    table: DataFrame
    counters: DataFrame


def crawl_round(table: DataFrame, locks: DataFrame, hosts: DataFrame, patterns: DataFrame, fetcher: Fetcher, now: int, policies: DataFrame | None = None, ignore_policy: bool = False, source_first: bool = True, size: int = frontier.FETCH, at_once: bool = False) -> Round:
    """Fetches the next URLs of every host, finds their links and updates the frontier.

    ``policies``: (hostid, policy); what they forbid isn't fetched and isn't an error.  Where every fetch of a
    host got no answer (an error other than NOT_FOUND), the host's own address is tried: if that gets none either the host is
    down and its URLs aren't penalised.  Only entity pages are documents.  ``at_once``: as in prefetch()."""
    batch = frontier.prefetch(table, locks, patterns, now, size, source_first, at_once).join(hosts, "hostid").withColumn("url", urls.join_host(F.col("address"), F.col("path")))
    if policies is not None and not ignore_policy:
        batch = batch.join(policies, "hostid", "left").withColumn("allowed", robots.allows(F.col("path"), F.col("policy"))).drop("policy")
    else:
        batch = batch.withColumn("allowed", F.lit(True))
    batch = cut(batch)
    fetched = cut(batch.join(fetcher(batch.where("allowed").select("hostid", "urlid", "url")), "urlid", "left"))
    outcome = fetched.select("hostid", "urlid", "allowed", F.col("html").isNotNull().alias("fetched")).join(hosts_down(fetched, fetcher), "hostid", "left")
    outcome = outcome.select("urlid", "allowed", "fetched", (~F.col("allowed") | F.col("fetched") | F.coalesce("down", F.lit(False))).alias("ok"))
    pages = fetched.where("html is not null").select(F.col("address").alias("base_url"), "url", "hostid", "pattern", "html", "entity")
    valid, fresh = new_links(pages, hosts, patterns, table)
    after = frontier.visit(table, outcome, now).unionByName(fresh)
    counters = fetched.agg(
        F.count(F.when(F.col("html").isNotNull(), 1)).alias("stat.crawled"), F.count(F.when(F.col("allowed") & F.col("html").isNull(), 1)).alias("err.connError"),
    ).crossJoin(valid.agg(F.count(F.lit(1)).alias("stat.validLinks"))).crossJoin(fresh.agg(F.count(F.lit(1)).alias("stat.newLinks")))
    return Round(pages.where("entity").drop("entity"), cut(after), counters)


def crawl(table: DataFrame, hosts: DataFrame, patterns: DataFrame, fetcher: Fetcher, now: int, rounds: int | None = None, locks: DataFrame | None = None, **options) -> Round:
    """Rounds until one brings no page (or as many as are asked for), all at the time ``now``.

    What was fetched isn't due again at that time, so this ends; hosts that are down are left for another
    crawl.  What ``locks`` hold is others' and left alone.  The documents of all rounds are together; a round's rows are written to the shared folder.
    Where their number is open and the fetcher spares no server, a round takes all that is due, so that there are as many as
    links are deep and not as many as the largest host has pages by 50."""
    locks = table.sparkSession.createDataFrame([], frontier.LOCK) if locks is None else locks
    options = {"at_once": rounds is None and getattr(fetcher, "at_once", False)} | options
    documents, counters, k = None, None, 0
    while rounds is None or k < rounds:
        made = crawl_round(table, locks, hosts, patterns, fetcher, now, **options)
        found = made.documents  # of pages that are written already
        numbers = cut(made.counters)
        table = made.table
        documents = found if documents is None else documents.unionByName(found)
        counters = numbers if counters is None else counters.unionByName(numbers)
        k += 1
        seen = numbers.first()
        if not seen["stat.crawled"]:
            break
    return Round(documents, table, counters)
