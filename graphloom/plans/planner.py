"""From the algebra of graph queries to DataFrames.

A variable is a struct column (v, kind, dt, lang).  Patterns become scans with pushed filters, ordered so
that connected ones with the fewest rows come first and joined on their shared variables; optional groups are
left joins, EXISTS and IN are semi-joins where they stand alone (anti under NOT), marks from a left join
elsewhere.  Spark picks each join's strategy by its sizes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from .serql import Group, Pattern, QueryError, Select, SetOp, Term, Var, parse

_FIELDS = ("v", "kind", "dt", "lang")


def _struct(v: Column, kind: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(v.alias("v"), kind.alias("kind"), (none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"))


def _constant(x: Term) -> Column:
    return _struct(F.lit(x.value), F.lit(x.kind), F.lit(x.dt).cast("string"), F.lit(x.lang).cast("string"))


class Planner:
    """Answers queries over one statement table.

    ``counts``: rows by predicate, if they are known, for the join order.  ``bindings``: values of variables
    before evaluation, as terms."""

    def __init__(self, statements: DataFrame, counts: dict[str, int] | None = None, bindings: dict[str, Term] | None = None):
        self.statements, self.counts, self.bindings = statements, counts or {}, bindings or {}
        self.marks = 0

    # -- scans and joins
    def bound(self, x: Var | Term) -> Var | Term:
        return self.bindings.get(x.name, x) if isinstance(x, Var) else x

    def scan(self, pattern: Pattern) -> DataFrame:
        rows, columns = self.statements, {}
        s, p, o = self.bound(pattern.s), self.bound(pattern.p), self.bound(pattern.o)
        if isinstance(p, Term):
            rows = rows.where(F.col("p") == p.value)
        if isinstance(s, Term):
            rows = rows.where((F.col("s") == s.value) & (F.col("s_kind") == s.kind))
        if isinstance(o, Term):
            rows = rows.where((F.col("o") == o.value) & (F.col("o_kind") == o.kind))
            if o.kind == t.LITERAL:
                rows = rows.where(F.col("o_dt").isNull() if o.dt is None else F.col("o_dt") == o.dt).where(F.col("o_lang").isNull() if o.lang is None else F.col("o_lang") == o.lang)
        values = ((s, _struct(F.col("s"), F.col("s_kind"))), (p, _struct(F.col("p"), F.lit(t.URI))), (o, _struct(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))))
        for x, value in values:
            if isinstance(x, Var):
                if x.name in columns:
                    rows = rows.where(columns[x.name] == value)
                else:
                    columns[x.name] = value
        bound = {v.name: _constant(self.bindings[v.name]) for v in (pattern.s, pattern.p, pattern.o) if isinstance(v, Var) and v.name in self.bindings}
        return rows.select(*[c.alias(n) for n, c in (columns | bound).items()] or [F.lit(1).alias("__row")])

    def size(self, pattern: Pattern) -> float:
        """A guess of a pattern's rows: its predicate's count, less for a constant subject or object."""
        p = self.bound(pattern.p)
        rows = self.counts.get(p.value, 0) if self.counts and isinstance(p, Term) else sum(self.counts.values()) or 1e9
        return rows / (1e6 if isinstance(self.bound(pattern.s), Term) else 1) / (1e3 if isinstance(self.bound(pattern.o), Term) else 1)

    @staticmethod
    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        shared = [c for c in left.columns if c in right.columns and c != "__row"]
        if "__row" in right.columns:
            right = right.drop("__row") if len(right.columns) > 1 else right
        if not shared:
            return left.crossJoin(right.withColumnRenamed("__row", "__again").drop("__again") if "__row" in left.columns else right) if how == "inner" else left.join(right, F.lit(True), how)
        return left.join(right, shared, how)

    def patterns(self, patterns: list[Pattern], start: DataFrame | None = None) -> DataFrame | None:
        names = lambda p: {x.name for x in (p.s, p.p, p.o) if isinstance(x, Var)}
        rest, frame, have = list(patterns), start, set(start.columns) if start is not None else set()
        while rest:
            connected = [p for p in rest if names(p) & have] if have else rest
            # where nothing is connected a product can't be helped
            best = min(connected or rest, key=lambda p: (self.size(p), rest.index(p)))
            rest.remove(best)
            frame = self.scan(best) if frame is None else self.join(frame, self.scan(best))
            have |= names(best)
        return frame

    def group(self, g: Group, outer: DataFrame | None = None) -> DataFrame:
        frame = self.patterns(g.patterns, outer)
        if frame is None:
            frame = self.statements.sparkSession.range(1).select(F.lit(1).alias("__row"))
        for o in g.optional:
            inner = self.group(replace(o, where=None))
            if o.where is None:
                frame = self.join(frame, inner, "left")
            else:
                # the condition may name variables of both sides, so it is part of the join
                shared = [c for c in frame.columns if c in inner.columns]
                renamed = inner.withColumnsRenamed({c: f"__r_{c}" for c in shared})
                env = set(frame.columns) | set(inner.columns)
                on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__r_{c}") for c in shared], F.coalesce(self.test(o.where, env), F.lit(False)))
                frame = frame.join(renamed, on, "left").drop(*[f"__r_{c}" for c in shared])
        return frame if g.where is None else self.filter(frame, g.where)

    # -- conditions
    def filter(self, frame: DataFrame, e: tuple) -> DataFrame:
        if e[0] == "and":
            return self.filter(self.filter(frame, e[1]), e[2])
        negated, inner = (True, e[1]) if e[0] == "not" else (False, e)
        sub = self.as_exists(inner)
        if sub is not None:
            if sub[1]:
                negated = not negated
            return self.semi(frame, sub[0], "left_anti" if negated else "left_semi")
        frame, e = self.mark(frame, e)
        drop = [c for c in frame.columns if c.startswith("__mark")]
        return frame.where(self.test(e, set(frame.columns))).drop(*drop)

    @staticmethod
    def as_exists(e: tuple) -> tuple[Select | SetOp, bool] | None:
        """(subquery, negated) if the condition is one about a subquery's rows."""
        if e[0] == "exists":
            return e[1], False
        if e[0] == "compare" and len(e) == 5:
            _, op, left, kind, sub = e
            if isinstance(sub, SetOp) or not sub.projection or len(sub.projection) != 1:
                raise QueryError("ANY, ALL and IN take a SELECT of one value")
            opposite = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
            # x op ALL (..): there is no value for which it doesn't hold
            condition = ("compare", op if kind == "any" else opposite[op], left, sub.projection[0][1])
            where = condition if sub.group.where is None else ("and", sub.group.where, condition)
            return replace(sub, group=replace(sub.group, where=where)), kind == "all"
        return None

    @staticmethod
    def _null_safe(names: list[str], right: str = "__k_") -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(right + c)) for c in names])

    def _inner(self, frame: DataFrame, sub: Select | SetOp) -> tuple[DataFrame, list[str]]:
        """The subquery's rows with the outer variables that they depend on."""
        if isinstance(sub, SetOp):
            raise QueryError("EXISTS takes a SELECT")
        outer = [c for c in frame.columns if not c.startswith("__")]
        own = _variables(sub.group, conditions=False)
        free = [c for c in outer if c in _variables(sub.group) and c not in own]
        shared = [c for c in outer if c in own]
        if not free:
            return self.group(sub.group), shared
        # conditions inside that name outer variables: these are joined in, each combination once
        keys = frame.select(*[c for c in outer if c in free or c in shared]).distinct()
        pairs, rest = ([], []) if sub.group.optional else self._equalities(sub.group.where, set(outer), own)
        if not pairs:
            return self.group(sub.group, keys), keys.columns
        # an equality between both sides is the join's key, as in IN; without it every outer row would meet every inner one
        rows = self.group(replace(sub.group, where=None))
        rows = rows.withColumns({f"__in{k}": self.identity(self.value(e, own)) for k, (_, e) in enumerate(pairs)})
        asked = keys.withColumns({f"__in{k}": self.identity(self.value(e, set(outer))) for k, (e, _) in enumerate(pairs)})
        met = self.join(asked, rows).drop(*[f"__in{k}" for k in range(len(pairs))])
        return reduce(self.filter, rest, met), keys.columns

    @classmethod
    def _equalities(cls, e: tuple | None, outer: set[str], own: set[str]) -> tuple[list[tuple], list[tuple]]:
        """Of the conditions that AND joins: ([(outer side, own side) of those that equate them], the others)."""
        if e is None:
            return [], []
        if e[0] == "and":
            a, b = cls._equalities(e[1], outer, own), cls._equalities(e[2], outer, own)
            return a[0] + b[0], a[1] + b[1]
        if e[0] == "compare" and len(e) == 4 and e[1] == "=":
            for x, y in ((e[2], e[3]), (e[3], e[2])):
                far, near = _in_condition(x), _in_condition(y)
                if far and near and far <= outer and not far & own and near <= own:
                    return [(x, y)], []
        return [], [e]

    def semi(self, frame: DataFrame, sub: Select | SetOp, how: str) -> DataFrame:
        rows, names = self._inner(frame, sub)
        if not names:
            return frame.join(rows.select(F.lit(1).alias("__k_")).limit(1), F.lit(True), how)
        keys = rows.select(*[F.col(c).alias(f"__k_{c}") for c in names])
        # variables that the outer rows leave open (optional paths) match null alone
        plain = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k_{c}") for c in names])
        return frame.join(keys, plain if how == "left_semi" else self._null_safe(names), how)

    def mark(self, frame: DataFrame, e: tuple) -> tuple[DataFrame, tuple]:
        """The frame with a boolean column for each subquery inside e, and e with those in their place."""
        sub = self.as_exists(e)
        if sub is not None:
            self.marks += 1
            name = f"__mark{self.marks}"
            rows, names = self._inner(frame, sub[0])
            keys = rows.select(*[F.col(c).alias(f"__k_{c}") for c in names], F.lit(True).alias(name)).distinct() if names else rows.select(F.lit(True).alias(name)).limit(1)
            frame = frame.join(keys, self._null_safe(names) if names else F.lit(True), "left").drop(*[f"__k_{c}" for c in names])
            marked = ("column", name)
            return frame, ("not", marked) if sub[1] else marked
        if e[0] in ("and", "or"):
            frame, left = self.mark(frame, e[1])
            frame, right = self.mark(frame, e[2])
            return frame, (e[0], left, right)
        if e[0] == "not":
            frame, inner = self.mark(frame, e[1])
            return frame, ("not", inner)
        return frame, e

    def test(self, e: tuple, names: set[str]) -> Column:
        kind = e[0]
        if kind == "and":
            return self.test(e[1], names) & self.test(e[2], names)
        if kind == "or":
            return self.test(e[1], names) | self.test(e[2], names)
        if kind == "not":
            return ~self.test(e[1], names)
        if kind == "constant":
            return F.lit(e[1])
        if kind == "column":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if kind == "isnull":
            return self.value(e[1], names).isNull()
        if kind == "call":
            k = self.value(e[2], names)["kind"]
            return {"isliteral": k == t.LITERAL, "isuri": k == t.URI, "isbnode": k == t.BNODE, "isresource": k != t.LITERAL}[e[1]]
        if kind == "like":
            pattern = "".join(".*" if c == "*" else c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in e[2])
            return self.value(e[1], names)["v"].rlike(("(?is)" if e[3] else "(?s)") + f"^{pattern}$")
        if kind == "compare" and len(e) == 4:
            return self.compare(e[1], self.value(e[2], names), self.value(e[3], names))
        raise QueryError(f"{kind} can't be part of this condition")

    @staticmethod
    def compare(op: str, a: Column, b: Column) -> Column:
        """Numbers by value, other terms for identity; an order only between literals of one kind."""
        x, y = t.number(a["v"], a["dt"]), t.number(b["v"], b["dt"])
        both = x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            same = F.when(both, x == y).otherwise(a == b)
            return same if op == "=" else ~same
        lexical = (a["kind"] == t.LITERAL) & (b["kind"] == t.LITERAL) & (F.coalesce(a["dt"], F.lit(t.XSD + "string")) == F.coalesce(b["dt"], F.lit(t.XSD + "string")))
        order = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
        return F.when(both, order(x, y)).when(lexical, order(a["v"], b["v"]))

    @staticmethod
    def identity(x: Column) -> Column:
        """A key that is the same for two terms exactly where compare() takes them as equal; null for none."""
        n = t.number(x["v"], x["dt"])
        other = lambda f: F.when(n.isNull(), x[f]).alias(f)
        return F.when(x.isNotNull(), F.struct(n.alias("n"), *[other(f) for f in _FIELDS]))

    def value(self, e: tuple, names: set[str]) -> Column:
        if e[0] == "term":
            return _constant(e[1])
        if e[0] == "var":
            if e[1] in names:
                return F.col(f"`{e[1]}`")
            if e[1] in self.bindings:
                return _constant(self.bindings[e[1]])
            raise QueryError(f"{e[1]} isn't bound")
        x = self.value(e[2], names)
        literal, uri = x["kind"] == t.LITERAL, x["kind"] == t.URI
        text = lambda v, when: F.when(when & v.isNotNull(), _struct(v, F.lit(t.LITERAL)))
        split = r"^(.*[#/:])([^#/:]*)$"
        return {
            "label": lambda: text(x["v"], literal), "str": lambda: text(x["v"], F.lit(True)), "lang": lambda: text(x["lang"], literal),
            "datatype": lambda: F.when(literal & x["dt"].isNotNull(), _struct(x["dt"], F.lit(t.URI))),
            "namespace": lambda: F.when(uri, _struct(F.regexp_extract(x["v"], split, 1), F.lit(t.URI))), "localname": lambda: text(F.regexp_extract(x["v"], split, 2), uri),
        }[e[1]]()

    # -- queries
    @staticmethod
    def sort_keys(x: Column, up: bool) -> list[Column]:
        """Unbound first, then blank nodes, URIs and literals; numbers by value before other literals' text."""
        rank = F.when(x.isNull(), 0).when(x["kind"] == t.BNODE, 1).when(x["kind"] == t.URI, 2).otherwise(3)
        keys = [rank, t.number(x["v"], x["dt"]), x["v"], x["dt"], x["lang"]]
        return [k.asc_nulls_last() if up else k.desc_nulls_first() for k in keys]

    def evaluate(self, q: Select | SetOp) -> DataFrame:
        if isinstance(q, SetOp):
            left, right = self.evaluate(q.left), self.evaluate(q.right)
            if len(left.columns) != len(right.columns):
                raise QueryError("the sides of a set operation have different numbers of columns")
            right = right.toDF(*left.columns)
            return {"UNION": lambda: left.union(right).distinct(), "UNION ALL": lambda: left.union(right), "MINUS": lambda: left.subtract(right), "INTERSECT": lambda: left.intersect(right)}[q.kind]()
        frame = self.group(q.group)
        if q.construct:
            return self.construct(frame, q)
        names = [c for c in frame.columns if not c.startswith("__")]
        projection = q.projection if q.projection is not None else [(n, ("var", n)) for n in names]
        env = set(frame.columns)
        columns = [self.value(e, env).alias(n) for n, e in projection]
        if not q.order:
            out = frame.select(*columns)
            out = out.distinct() if q.distinct else out
        else:
            keys = [(self.value(e, env), up) for e, up in q.order]
            sortable = frame.select(*columns, *[k.alias(f"__o{i}") for i, (k, _) in enumerate(keys)])
            if q.distinct:
                # of equal rows the one that comes first gives the place
                picks = [(F.min_by if up else F.max_by)(f"__o{i}", F.struct(*[F.coalesce(x, F.lit("")) if n else x for n, x in enumerate([t.number(F.col(f"__o{i}.v"), F.col(f"__o{i}.dt")), F.col(f"__o{i}.v")])])).alias(f"__o{i}") for i, (_, up) in enumerate(keys)]
                sortable = sortable.groupBy(*[n for n, _ in projection]).agg(*picks)
            order = [k for i, (_, up) in enumerate(keys) for k in self.sort_keys(F.col(f"__o{i}"), up)]
            # ties go by the row itself, so that a limit takes the same rows each time
            out = sortable.orderBy(*order, *[n for n, _ in projection]).drop(*[f"__o{i}" for i in range(len(keys))])
        if (q.limit is not None or q.offset) and not q.order:
            out = out.orderBy(*out.columns)
        if q.offset:
            out = out.offset(q.offset)
        return out if q.limit is None else out.limit(q.limit)

    def construct(self, frame: DataFrame, q: Select) -> DataFrame:
        """The template's statements for every row, each once.  Blank nodes of a template are not made anew."""
        env = set(frame.columns)
        made = []
        patterns = q.template if q.template is not None else [*q.group.patterns, *[p for o in q.group.optional for p in o.patterns]]
        for pattern in patterns:
            s, p, o = (_constant(b) if isinstance(b := self.bound(x), Term) else self.value(("var", x.name), env) for x in (pattern.s, pattern.p, pattern.o))
            made.append(F.struct(s["v"].alias("s"), s["kind"].alias("s_kind"), p["v"].alias("p"), o["v"].alias("o"), o["kind"].alias("o_kind"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang"), F.lit(False).alias("inferred")))
        rows = frame.select(F.inline(F.array(*made))).where("s is not null and p is not null and o is not null").where(F.col("s_kind") != t.LITERAL).distinct()
        if q.offset or q.limit is not None:
            rows = rows.orderBy(*t.KEY).offset(q.offset)
        return rows if q.limit is None else rows.limit(q.limit)


def _variables(g: Group, conditions: bool = True) -> set[str]:
    out = {x.name for p in g.patterns for x in (p.s, p.p, p.o) if isinstance(x, Var)}
    for o in g.optional:
        out |= _variables(o, conditions)
    return out | (_in_condition(g.where) if conditions and g.where else set())


def _in_condition(e) -> set[str]:
    if isinstance(e, Select):
        return _variables(e.group)
    if isinstance(e, tuple):
        return {e[1]} if e[:1] == ("var",) else set().union(*map(_in_condition, e))
    return set()


def predicate_counts(statements: DataFrame) -> dict[str, int]:
    """Rows by predicate: one pass over one column, kept by whoever asks many queries."""
    return {r["p"]: r["count"] for r in statements.groupBy("p").count().collect()}


def select(statements: DataFrame, text: str, counts: dict[str, int] | None = None, **bindings: Term) -> DataFrame:
    """The answer of a SELECT, a struct column for each variable (null: unbound), or a CONSTRUCT's statements."""
    return Planner(statements, counts, bindings).evaluate(parse(text))


def plain(answer: DataFrame, *names: str) -> DataFrame:
    """Lexical forms in place of structs, for all columns or those named."""
    chosen = names or tuple(answer.columns)
    return answer.select(*[F.col(f"`{c}`.v").alias(c) for c in chosen])


def shown(answer: DataFrame) -> DataFrame:
    """Terms as N-Triples writes them."""
    return answer.select(*[t.show(*[F.col(f"`{c}`.{f}") for f in _FIELDS]).alias(c) for c in answer.columns])
