"""Configuration files: jobs, crawlers and mappings as XML."""

from __future__ import annotations

import re
from dataclasses import MISSING, dataclass, field, fields
from enum import Enum
from typing import get_type_hints
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from ..operators.frontier import DAY, PATTERN
from ..operators.mapping import ROLES, Mapping


def coalesce(*values):
    """The first that isn't None, or None."""
    return next((v for v in values if v is not None), None)


def coerce(value: str, kind: type):
    """A text parameter as str, bool, int, float or an Enum; ValueError if it can't be one."""
    if kind is bool:
        return value.strip().lower() == "true"
    if isinstance(kind, type) and issubclass(kind, Enum):
        try:
            return kind[value]
        except KeyError:
            raise ValueError(f"{value!r} is none of {[k.name for k in kind]}") from None
    return kind(value) if kind in (int, float, str) else value


def inject(cls: type, params: dict[str, str]):
    """An instance of a dataclass with parameters from texts.  A parameter that is missing keeps its default and is
    an error without one; names that the class lacks are ignored."""
    hints, values = get_type_hints(cls), {}
    for f in fields(cls):
        if f.name in params:
            values[f.name] = coerce(params[f.name], hints[f.name])
        elif f.init and f.default is MISSING and f.default_factory is MISSING:
            raise ValueError(f"parameter {f.name} of {cls.__name__} is missing")
    return cls(**values)


@dataclass
class Step:
    """A processor of a job: the registered name of its class and its parameters."""

    name: str
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Job:
    name: str = ""
    description: str = ""
    chain: list[Step] = field(default_factory=list)
    attached: list[Step] = field(default_factory=list)


def _text(e: ET.Element | None, default: str | None = None) -> str | None:
    return default if e is None or e.text is None else e.text.strip()


def read_job(path: str) -> Job:
    root = ET.parse(path).getroot()
    steps = lambda name: [Step(_text(e, ""), dict(e.attrib)) for e in root.iterfind(f"{name}/processor")]
    return Job(_text(root.find("name"), ""), _text(root.find("description"), ""), steps("processorChain"), steps("attached"))


def write_job(job: Job, path: str) -> None:
    root = ET.Element("processingJob")
    ET.SubElement(root, "name").text, ET.SubElement(root, "description").text = job.name, job.description
    for name, steps in (("processorChain", job.chain), ("attached", job.attached)):
        parent = ET.SubElement(root, name)
        for s in steps:
            ET.SubElement(parent, "processor", s.params).text = s.name
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


@dataclass
class UrlPattern:
    pattern: str
    update_freq: int
    is_entity: bool
    weight: int = 1
    scrapers: tuple[str, ...] = ()


@dataclass
class Host:
    base_url: str
    name: str = ""
    charset: str | None = None
    crawl_delay: int | None = None
    source_first: bool = False
    patterns: list[UrlPattern] = field(default_factory=list)


@dataclass
class Crawler:
    db_layer: dict[str, str] = field(default_factory=dict)
    threads_per_host: int = 1
    least_delay_ms: int = 40
    policy_ignored: bool = False
    fake_referrer: bool = False
    hosts: list[Host] = field(default_factory=list)

    def jdbc(self) -> dict[str, str]:
        """Options of Spark's JDBC source; a table's name is put behind the schema, if there is one."""
        d = self.db_layer
        return {k: v for k, v in (("driver", d.get("driver")), ("url", d.get("url")), ("user", d.get("user")), ("password", d.get("password"))) if v}

    def table(self, name: str) -> str:
        schema = self.db_layer.get("schema")
        return f"{schema}.{name}" if schema else name


def _int(text: str | None, default):
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def read_crawler(path: str) -> Crawler:
    """A crawler's configuration.  Times of patterns are in days (30 for sources, 365 for entities, if not
    given); a weight that is no number, or below 1, is 1; a delay that is no number is none."""
    root = ET.parse(path).getroot()
    flag = lambda e, name: (_text(e.find(name), "") or "").lower() == "true"
    out = Crawler(
        {e.tag: _text(e, "") for e in root.iterfind("dbLayer/*")}, max(1, _int(_text(root.find("threadsPerHost")), 1)),
        _int(_text(root.find("globalCrawlDelayMinimum")), 40), flag(root, "policyIgnored"), flag(root, "fakeReferrer"),
    )
    if out.least_delay_ms <= 0:
        out.least_delay_ms = 40
    for h in root.iterfind("hosts/host"):
        host = Host(_text(h.find("baseURL"), ""), _text(h.find("name"), ""), _text(h.find("charset")), _int(_text(h.find("crawlDelay")), None), flag(h, "sourceFirst"))
        for e in h.iterfind("entities/entity"):
            p = e.find("pattern")
            host.patterns.append(UrlPattern(_text(p, ""), _int(p.get("update"), 365) * DAY, True, max(1, _int(e.get("weight"), 1)), tuple(dict.fromkeys(_text(s, "") for s in e.iterfind("scraper")))))
        for p in h.iterfind("source/pattern"):
            host.patterns.append(UrlPattern(_text(p, ""), _int(p.get("update"), 30) * DAY, False))
        out.hosts.append(host)
    return out


def patterns_frame(spark: SparkSession, crawler: Crawler, host_ids: dict[str, int]) -> DataFrame:
    """The patterns of hosts that have an id (by address).  A pattern that is no regular expression leaves its
    host out, as one without an id is."""
    rows = []
    for h in crawler.hosts:
        if h.base_url not in host_ids:
            continue
        try:
            for p in h.patterns:
                re.compile(p.pattern)
        except re.error:
            continue
        rows += [(host_ids[h.base_url], k, p.is_entity, p.pattern, p.update_freq, p.weight, list(p.scrapers)) for k, p in enumerate(h.patterns)]
    return spark.createDataFrame(rows, PATTERN)


def read_mapping(path: str) -> tuple[Mapping, list[str]]:
    """(mapping, warnings).  An entry without ``target`` is for all roles; unknown roles are told and skipped."""
    mapping, warnings = Mapping(), []
    for e in ET.parse(path).getroot().iterfind("entry"):
        roles = [r.strip().upper() for r in e.get("target", ",".join(ROLES)).split(",") if r.strip()]
        for r in roles:
            if r in ROLES:
                mapping.add(r, _text(e.find("from"), ""), _text(e.find("to"), ""))
            else:
                warnings.append(f"unknown role {r}")
    return mapping, warnings


def write_mapping(mapping: Mapping, path: str) -> None:
    """Entries sorted by their old URI, one for each (old, new) with its roles."""
    roles: dict[tuple[str, str], list[str]] = {}
    for r, a, b in mapping.rows():
        roles.setdefault((a, b), []).append(r)
    root = ET.Element("mapping")
    for (a, b), rs in sorted(roles.items()):
        e = ET.SubElement(root, "entry", {} if len(rs) == len(ROLES) else {"target": ",".join(rs)})
        ET.SubElement(e, "from").text, ET.SubElement(e, "to").text = a, b
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
