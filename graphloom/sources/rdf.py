"""RDF files: N-Triples by lines, RDF/XML by documents, and writers of both."""

from __future__ import annotations

import os
import re
from io import BytesIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t

_EXTENSIONS = {".nt": "NTRIPLES", ".ttl": "NTRIPLES", ".n3": "NTRIPLES", ".rdf": "RDFXML", ".rdfs": "RDFXML", ".owl": "RDFXML", ".xml": "RDFXML"}
_HEAD = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+"
_TAIL = r"\s*\.\s*(?:#[^\"]*)?$"
_LINK = _HEAD + r"(<[^>]*>|_:\S+)" + _TAIL
#: The text runs to the line's last quotation mark, so a long one is matched without a step for each sign.
_LITERAL = _HEAD + r'"(.*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?' + _TAIL


def unescaped(s: Column) -> Column:
    """The text of an N-Triples literal: all escapes are undone in one go, so that an escaped backslash protects what follows it."""
    held = F.replace(s, F.lit("\\\\"), F.lit("\x00"))
    for mark, sign in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        held = F.replace(held, F.lit(mark), F.lit(sign))
    token = F.regexp_extract_all(held, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|[^\\]+|\\)"), F.lit(1))

    def one(x: Column) -> Column:
        # four digits are one UTF-16 sign, or half of one; eight are UTF-32
        code = F.unhex(F.substring(x, F.lit(3), F.length(x)))
        return F.when(x.rlike(r"^\\u.{4}$"), F.decode(code, "UTF-16BE")).when(x.rlike(r"^\\U.{8}$"), F.decode(code, "UTF-32")).otherwise(x)

    held = F.when(F.contains(held, F.lit("\\")), F.array_join(F.transform(token, one), "")).otherwise(held)
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Statements of N-Triples files (and of Turtle in that form).  Lines that are neither statements, comments nor blank
    make it fail, so that nothing is lost unseen: Turtle with prefixes must be converted first."""
    row = spark.read.text(path).select(F.col("value").alias("l")).where(~F.col("l").rlike(r"^\s*(#.*)?$"))

    def bare(x):
        return F.when(x.startswith("<"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.substring(x, F.lit(3), F.length(x)))

    literal, link = F.col("l").rlike(_LITERAL), F.col("l").rlike(_LINK)
    known = row.withColumn("literal", literal & ~link).where(F.when(literal | link, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples statement: "), F.substring("l", 1, 200))).cast("boolean")))
    s, o = F.regexp_extract("l", _HEAD, 1), F.regexp_extract("l", _LINK, 3)
    none_if_empty = lambda c: F.when(c != "", c)
    return known.select(
        bare(s).alias("s"), F.when(s.startswith("<"), t.URI).otherwise(t.BNODE).alias("s_kind"), F.regexp_extract("l", _HEAD, 2).alias("p"),
        F.when(F.col("literal"), unescaped(F.regexp_extract("l", _LITERAL, 3))).otherwise(bare(o)).alias("o"),
        F.when(F.col("literal"), t.LITERAL).when(o.startswith("<"), t.URI).otherwise(t.BNODE).alias("o_kind"),
        F.when(F.col("literal"), none_if_empty(F.regexp_extract("l", _LITERAL, 5))).alias("o_dt"), F.when(F.col("literal"), none_if_empty(F.regexp_extract("l", _LITERAL, 4))).alias("o_lang"), F.lit(False).alias("inferred"),
    )


_R, _X = "{" + t.RDF + "}", "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(data: bytes, base: str = "") -> list[tuple]:
    """Statement rows of an RDF/XML document: nodes by about, ID or nodeID, typed nodes, property attributes,
    resources, typed and tagged literals, nested nodes, parseType Resource and Collection."""
    out: list[tuple] = []
    made = 0
    plain = lambda name: name[1:].replace("}", "", 1) if name.startswith("{") else name

    def absolute(ref: str) -> str:
        from urllib.parse import urljoin

        return urljoin(base, ref) if base and not re.match(r"[A-Za-z][\w+.-]*:", ref) else ref

    def blank() -> str:
        nonlocal made
        made += 1
        return f"genid{made}"

    def state(s, p, o, kind, dt=None, lang=None):
        out.append((s[0], s[1], p, o, kind, dt, lang, False))

    def node(e: ET.Element, lang: str | None) -> tuple[str, str]:
        lang = e.get(_X + "lang", lang)
        if e.get(_R + "about") is not None:
            me = (absolute(e.get(_R + "about")), t.URI)
        elif e.get(_R + "ID") is not None:
            me = (absolute("#" + e.get(_R + "ID")), t.URI)
        else:
            me = (e.get(_R + "nodeID") or blank(), t.BNODE)
        if e.tag != _R + "Description":
            state(me, t.TYPE, plain(e.tag), t.URI)
        attributes(me, e, lang)
        for child in e:
            prop(me, child, lang)
        return me

    def attributes(me, e, lang):
        for k, v in e.attrib.items():
            if k == _R + "type":
                state(me, t.TYPE, absolute(v), t.URI)
            elif k.startswith("{") and not k.startswith((_R, _X)):
                state(me, plain(k), v, t.LITERAL, None, lang)

    def prop(me, e: ET.Element, lang: str | None):
        lang = e.get(_X + "lang", lang) or None
        p, parse = plain(e.tag), e.get(_R + "parseType")
        if e.get(_R + "resource") is not None:
            o = (absolute(e.get(_R + "resource")), t.URI)
        elif e.get(_R + "nodeID") is not None:
            o = (e.get(_R + "nodeID"), t.BNODE)
        elif parse == "Resource":
            o = (blank(), t.BNODE)
            for child in e:
                prop(o, child, lang)
        elif parse == "Collection":
            cells = [(blank(), t.BNODE) for _ in e]
            ends = [*cells[1:], (t.RDF + "nil", t.URI)]
            for cell, item, rest in zip(cells, e, ends, strict=True):
                x = node(item, lang)
                state(cell, t.RDF + "first", *x)
                state(cell, t.RDF + "rest", *rest)
            o = cells[0] if cells else (t.RDF + "nil", t.URI)
        elif parse == "Literal":
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            return state(me, p, inner, t.LITERAL, t.RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], lang)
        else:
            extra = [k for k in e.attrib if k.startswith("{") and not k.startswith((_R, _X))]
            if not extra:
                dt = e.get(_R + "datatype")
                return state(me, p, e.text or "", t.LITERAL, dt, None if dt else lang)
            o = (blank(), t.BNODE)
        state(me, p, *o)
        if not len(e):
            attributes(o, e, lang)

    root = ET.parse(BytesIO(data)).getroot()
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, root.get(_X + "lang"))
    return out


def read_rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Statements of RDF/XML files, a file in one task; blank nodes are named by their file."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                mark = re.sub(r"\W", "_", os.path.basename(name)) + "_"
                rows = [(mark + r[0] if r[1] == t.BNODE else r[0], r[1], r[2], mark + r[3] if r[4] == t.BNODE else r[3], *r[4:]) for r in parse_rdfxml(data, base)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 7 else pa.string()) for k, c in enumerate(columns)], names=t.SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, t.STATEMENT)


def read(spark: SparkSession, path: str, form: str | None = None, base: str = "") -> DataFrame:
    """Statements of a file, by its format's name or else its extension; an unknown one is a ValueError."""
    form = (form or _EXTENSIONS.get(os.path.splitext(path)[1].lower(), "")).upper().replace("-", "").replace("/", "")
    if form in ("NTRIPLES", "TURTLE", "N3"):
        return read_ntriples(spark, path)
    if form == "RDFXML":
        return read_rdfxml(spark, path, base)
    raise ValueError(f"unknown RDF format of {path}")


def load(spark: SparkSession, listed: str, base: str = "", working_dir: str = ".") -> tuple[DataFrame | None, list[str]]:
    """Statements of ``file[:FORMAT],...`` and warnings for files that are missing or of unknown format."""
    frames, warnings = [], []
    for entry in filter(None, (x.strip() for x in listed.split(","))):
        name, _, form = entry.rpartition(":") if re.search(r":[A-Za-z0-9/-]+$", entry) and not entry.rpartition(":")[2].startswith("/") else (entry, "", "")
        path = os.path.join(working_dir, name)
        try:
            if not os.path.exists(path):
                raise ValueError(f"no such file: {path}")
            frames.append(read(spark, path, form or None, base))
        except ValueError as problem:
            warnings.append(str(problem))
    union = None
    for f in frames:
        union = f if union is None else union.unionByName(f)
    return union, warnings


def write_ntriples(statements: DataFrame, path: str) -> None:
    """One statement a line; every task writes its own file."""
    line = F.concat(
        t.show(F.col("s"), F.col("s_kind"), F.lit(None), F.lit(None)), F.lit(" <"), F.col("p"), F.lit("> "),
        t.show(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), F.lit(" ."),
    )
    statements.select(line.alias("value")).write.mode("overwrite").text(path)


def rdfxml_blocks(statements: DataFrame) -> DataFrame:
    """(value): one rdf:Description for each subject; values are sorted, so the result doesn't depend on the plan."""
    split = r"^(.*?)([A-Za-z_][\w.\-]*)$"

    def render(batches):
        for batch in batches:
            out = []
            for s, kind, facts in zip(*(batch.column(c).to_pylist() for c in ("s", "s_kind", "facts")), strict=True):
                body = []
                for f in facts:
                    m = re.match(split, f["p"])
                    space, local = (m[1], m[2]) if m else (f["p"], "value")
                    head = f"    <n:{local} xmlns:n={quoteattr(space)}"
                    if f["o_kind"] == t.URI:
                        body.append(f"{head} rdf:resource={quoteattr(f['o'])}/>")
                    elif f["o_kind"] == t.BNODE:
                        body.append(f"{head} rdf:nodeID={quoteattr(f['o'])}/>")
                    else:
                        extra = f" xml:lang={quoteattr(f['o_lang'])}" if f["o_lang"] else f" rdf:datatype={quoteattr(f['o_dt'])}" if f["o_dt"] else ""
                        body.append(f"{head}{extra}>{escape(f['o'])}</n:{local}>")
                name = f"rdf:about={quoteattr(s)}" if kind == t.URI else f"rdf:nodeID={quoteattr(s)}"
                out.append(f"  <rdf:Description {name}>\n" + "\n".join(body) + "\n  </rdf:Description>")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    grouped = statements.groupBy("s", "s_kind").agg(F.sort_array(F.collect_list(F.struct("p", "o", "o_kind", "o_dt", "o_lang"))).alias("facts"))
    return grouped.mapInArrow(render, "value string")


def write_rdfxml(statements: DataFrame, path: str) -> None:
    """One RDF/XML document at a local path; rows stream through the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{t.RDF}">\n')
        for row in rdfxml_blocks(statements).toLocalIterator():
            out.write(row.value + "\n")
        out.write("</rdf:RDF>\n")
