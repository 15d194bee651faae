import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import cli
from graphloom.functions import terms as t
from graphloom.operators import extract
from graphloom.plans import jobs, pipeline
from graphloom.sources import config, store
from graphloom.streaming import jobs as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # scrapers of this file run in workers
A, B = T.StructType([T.StructField("a", T.LongType())]), T.StructType([T.StructField("b", T.LongType())])


def test_chain_types_and_order(spark):
    stages = [pipeline.Function(lambda _: spark.range(4).toDF("a"), out_schema=A), pipeline.Function(lambda df: df.where("a > 1"), in_schema=A)]
    seen = []

    class Side(pipeline.Attached):
        def before_context(self, p):
            seen.append("before")

        def after_context(self, p):
            seen.append("after")
            raise OSError("only told")

        def chain_stopped(self, p):
            seen.append("stopped")

    p = pipeline.Pipeline(stages, [Side()])
    assert p.status() == pipeline.Status.NOT_STARTED
    assert p.start().count() == 2 and seen == ["before", "after", "stopped"] and p.errors == ["Side: only told"] and p.status() == pipeline.Status.STOPPED
    with pytest.raises(pipeline.PipelineError, match="do not match"):
        pipeline.Pipeline([stages[0], pipeline.Function(lambda df: df, in_schema=B)]).plan()
    assert pipeline.FanIn([lambda _: spark.range(2), lambda _: spark.range(3)]).apply(None).count() == 5


def test_context(spark, tmp_path):
    class Gives(pipeline.Stage):
        number = 3

    class Takes(pipeline.Stage):
        pass

    takes = Takes(needs={"got": ("number", int)})
    pipeline.Pipeline([Gives(publishes=("number",)), takes]).plan()
    assert takes.got == 3
    with pytest.raises(pipeline.PipelineError):
        pipeline.Pipeline([takes]).plan()
    with pytest.raises(pipeline.PipelineError):
        pipeline.Pipeline([Gives(publishes=("number",)), Gives(publishes=("number",))]).plan()
    with pytest.raises(pipeline.PipelineError):
        pipeline.Pipeline([Gives(publishes=("number",)), Takes(needs={"x": ("number", str)})]).plan()
    c = pipeline.Context(str(tmp_path), a=1)
    assert c.set("a", 2) == 1 and c.warnings and c.names() == ["a"] and c.path("x") == str(tmp_path / "x") and c.path("/x") == "/x"
    bad = pipeline.Stage()
    bad.fail_start("no")
    with pytest.raises(pipeline.PipelineError, match="no"):
        pipeline.Pipeline([bad]).plan()


def test_params():
    from dataclasses import dataclass

    @dataclass
    class P:
        n: int
        flag: bool = False
        state: pipeline.Status = pipeline.Status.STOPPED

    assert config.inject(P, {"n": "5", "flag": "TRUE", "state": "RUNNING", "other": "x"}) == P(5, True, pipeline.Status.RUNNING)
    for wrong in ({}, {"n": "x"}, {"n": "1", "state": "NONE"}):
        with pytest.raises(ValueError):
            config.inject(P, wrong)
    assert config.coalesce(None, 0, 1) == 0 and config.coalesce() is None


CRAWLER = """<crawler><dbLayer><driver>d</driver><url>jdbc:x</url><schema>s</schema></dbLayer><threadsPerHost>0</threadsPerHost><globalCrawlDelayMinimum>0</globalCrawlDelayMinimum><hosts>
<host><baseURL>http://a.cz/</baseURL><crawlDelay>soon</crawlDelay><sourceFirst>true</sourceFirst><source><pattern update="1">/s</pattern><pattern>/t</pattern></source>
<entities><entity weight="0"><pattern>/e/.+</pattern><scraper>heads</scraper><scraper>heads</scraper></entity></entities></host>
<host><baseURL>http://bad.cz/</baseURL><source><pattern>/(</pattern></source></host></hosts></crawler>"""


def test_config_files(spark, tmp_path):
    path = tmp_path / "crawler.xml"
    path.write_text(CRAWLER)
    c = config.read_crawler(str(path))
    assert (c.threads_per_host, c.least_delay_ms, c.table("url"), c.jdbc()) == (1, 40, "s.url", {"driver": "d", "url": "jdbc:x"})
    h = c.hosts[0]
    assert h.crawl_delay is None and [(p.pattern, p.update_freq, p.is_entity, p.weight) for p in h.patterns] == [("/e/.+", 365 * 86400, True, 1), ("/s", 86400, False, 1), ("/t", 30 * 86400, False, 1)]
    assert h.patterns[0].scrapers == ("heads",)
    assert config.patterns_frame(spark, c, {"http://a.cz/": 1, "http://bad.cz/": 2}).where("hostid = 2").count() == 0
    (tmp_path / "m.xml").write_text('<mapping><entry target="SUBJECT,WHAT"><from>a</from><to>b</to></entry><entry><from>c</from><to>d</to></entry></mapping>')
    m, warnings = config.read_mapping(str(tmp_path / "m.xml"))
    assert m.rows() == [("SUBJECT", "a", "b"), ("SUBJECT", "c", "d"), ("PREDICATE", "c", "d"), ("OBJECT", "c", "d")] and len(warnings) == 1
    config.write_mapping(m, str(tmp_path / "n.xml"))
    assert config.read_mapping(str(tmp_path / "n.xml"))[0].rows() == m.rows()
    job = config.Job("n", "d", [config.Step("crawl", {"conf": "x"})], [config.Step("stats")])
    config.write_job(job, str(tmp_path / "job.xml"))
    assert config.read_job(str(tmp_path / "job.xml")) == job


def heads(page):
    yield t.LABEL, extract.lit(page.text(page.root, ".//h1"))


def test_job_end_to_end(spark, tmp_path):
    jobs.SCRAPER_NAMES["heads"] = extract.Scraper("heads", "http://h#", heads, ["http://h#Head"])
    (tmp_path / "crawler.xml").write_text(CRAWLER)
    (tmp_path / "seeds").write_text("http://a.cz/s\n\n")
    (tmp_path / "map.xml").write_text('<mapping><entry target="OBJECT"><from>http://h#Head</from><to>http://h#Top</to></entry></mapping>')
    (tmp_path / "store.properties").write_text("dataDir=graph\ninferencer=rdfs\n")
    (tmp_path / "job.xml").write_text(
        '<processingJob><name>j</name><processorChain><processor conf="crawler.xml" bootstrap="seeds" now="1000000000">crawl</processor><processor>some.pkg.scrape</processor>'
        '<processor mapping="map.xml">map</processor><processor conf="store.properties">store</processor></processorChain><attached><processor file="stats.txt" filter="stats">stats</processor><processor>gone</processor></attached></processingJob>'
    )
    site = [("http://a.cz/s", '<a href="/e/1">x</a>'), ("http://a.cz/e/1", "<h1>One</h1>")]
    spark.createDataFrame(site, "url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    runner = jobs.Runner(str(tmp_path))
    made = runner.run()
    assert [(r.s, r.o) for r in made.where(F.col("p") == t.LABEL).collect()] == [("http://a.cz/e/1", "One")]
    assert made.where("o = 'http://h#Top' or s = 'http://h#Head'").count() >= 1 and any("gone" in w for w in runner.context.warnings)
    assert "stats.Crawler.stat.crawled=2" in (tmp_path / "stats.txt").read_text() and os.path.exists(tmp_path / "seeds.old")
    out = []
    conf = str(tmp_path / "store.properties")
    assert cli.query(spark, [conf, "what", "One"], out.append) == 0 and out == ["http://a.cz/e/1"]
    assert cli.query(spark, [conf, "has", "One"], out.append) == 0 and out[-1] == "true"
    (tmp_path / "q").write_text("SELECT l FROM {x} rdfs:label {l}\nORDER BY l")
    assert cli.query(spark, [conf, "tquery", str(tmp_path / "q")], out.append) == 0 and out[-1] == '[l="One"]'
    (tmp_path / "g").write_text("CONSTRUCT * FROM {x} rdfs:label {l}")
    assert cli.query(spark, [conf, "gquery", str(tmp_path / "g"), str(tmp_path / "g.rdf")], out.append) == 0 and "One" in (tmp_path / "g.rdf").read_text()
    assert cli.query(spark, [conf, "describe", "http://a.cz/e/1"], out.append) == 0 and f"{t.LABEL}, One" in out
    assert cli.query(spark, [conf, "count"], out.append) == 0 and out[-1].endswith("explicit statements")
    assert cli.query(spark, [conf, "what"], out.append) == 2 and cli.query(spark, [conf, "tquery", conf], out.append) == 1
    assert cli.query(spark, [conf, "rdfdump", str(tmp_path / "d.rdf")], out.append) == 0
    state = str(tmp_path / "frontier")
    assert cli.hosts(spark, [state, "list"], out.append) == 0 and "http://a.cz/" in out[-2] + out[-1]
    assert cli.hosts(spark, [state, "remove", "99"], out.append, lambda _: "y") == 1
    assert cli.hosts(spark, [state, "reset"], out.append, lambda _: "y") == 0 and spark.read.parquet(state + "/url").count() == 0


def test_streams(spark, tmp_path):
    log = [(1, 0, False, 0), (1, 1, False, 1), (1, 2, True, 2), (2, 0, True, 3)]
    spark.createDataFrame(log, "urlid bigint, ts int, ok boolean, event_id bigint").coalesce(1).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema("urlid bigint, ts int, ok boolean, event_id bigint").parquet(str(tmp_path / "log"))
    query = streams.scores(source).writeStream.format("memory").queryName("scores").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.urlid, r.score, r.working) for r in spark.table("scores").collect()} == {(1, -1, True), (2, 0, True)} and streams.status(query) == "STOPPED" and streams.status(None) == "NOT_STARTED"
    st = store.ParquetStore(spark, str(tmp_path / "s"))
    rows = [("s", "uri", "p", "o", "uri", None, None, False)] * 2
    spark.createDataFrame(rows, t.SCHEMA).write.parquet(str(tmp_path / "in"))
    streams.into_store(spark.readStream.schema(t.SCHEMA).parquet(str(tmp_path / "in")), st, str(tmp_path / "c2")).awaitTermination()
    assert st.read().count() == 1
