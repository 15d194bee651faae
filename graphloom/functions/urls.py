"""URL functions as column expressions; everything stays in the JVM's generated code.

A URL is taken apart by one regular expression, so that odd input gives null and never an error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, user part, host, port, path, query, fragment
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, USER, HOST, PORT, PATH, QUERY, FRAGMENT = range(1, 8)
_PLAIN = "[A-Za-z0-9._~-]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; an expression that is named twice would be copied, and nested
    ones grow beyond what can be compiled."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def once(value: Column, name: str) -> Column:
    """The value as a column of its own: a generator of one row, behind which the optimiser doesn't look.

    A URL expression is large; copied into each filter and projection above it, and multiplied by the constraints
    that follow from those, it would grow without bounds.  At most one in a select()."""
    return F.explode(F.array(value)).alias(name)


def part(url: Column, which: int) -> Column:
    """A part of an absolute URL; empty if it has none, null for what isn't a URL."""
    return F.when(url.rlike(_PARTS), F.regexp_extract(url, _PARTS, which))


def decode_unreserved(s: Column) -> Column:
    """Escapes of letters, digits and ``-._~`` become those signs; other escapes get capital digits."""
    token = F.regexp_extract_all(s, F.lit("(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))

    def one(x: Column) -> Column:
        sign = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))
        return F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.when((F.conv(F.substring(x, 2, 2), 16, 10).cast("int") < 128) & sign.rlike(f"^{_PLAIN}$"), sign).otherwise(F.upper(x))).otherwise(x)

    return F.when(s.contains("%"), F.array_join(F.transform(token, one), "")).otherwise(s)


def encode(s: Column) -> Column:
    """Form encoding; what has a ``%`` is taken as encoded already."""
    return F.when(s.contains("%"), s).otherwise(F.url_encode(s))


def decode(s: Column) -> Column:
    """Form decoding; null for a broken escape."""
    return F.try_url_decode(s)


#: Named references that occur in queries, and numeric ones, are undone by unescape().
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&eacute;": "é", "&aacute;": "á", "&iacute;": "í", "&ouml;": "ö", "&uuml;": "ü", "&auml;": "ä", "&szlig;": "ß"}


def unescape(s: Column) -> Column:
    """HTML references of the common names and of numbers below 256 replaced by their signs."""

    def token(x: Column) -> Column:
        named = reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(_NAMED.items())[1:], F.when(x == "&amp;", F.lit("&")))
        code = F.when(x.rlike("^&#[0-9]{1,3};$"), F.regexp_extract(x, "([0-9]+)", 1).cast("int")).when(x.rlike("^&#[xX][0-9A-Fa-f]{1,2};$"), F.conv(F.regexp_extract(x, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int"))
        return named.when(code.between(1, 255), F.char(code)).otherwise(x)

    return F.when(s.contains("&"), F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(&[A-Za-z]+;|&#[0-9A-Fa-fxX]+;|[^&]+|&)"), F.lit(1)), token), "")).otherwise(s)


def clean_query(query: Column) -> Column:
    """Parameters sorted by name and value, each once, without those that don't tell pages apart.

    ``&`` divides them where there is one, else ``;``.  A value that is missing is empty; a query of one
    word without ``=`` is encoded afresh and kept.  An empty query, or null, is empty."""
    return let(F.coalesce(query, F.lit("")), _clean_query)


def _clean_query(query: Column) -> Column:
    delimiter = F.when(query.contains("&"), "&").when(query.contains(";"), ";").otherwise("")
    pieces = F.filter(F.when(delimiter == "&", F.split(query, "&")).when(delimiter == ";", F.split(query, ";")).otherwise(F.array(query)), lambda x: x != "")

    def pair(x: Column) -> Column:
        # a sign that is never left unencoded stands for the first = while the pairs are sorted
        at = F.instr(x, "=")
        name = F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)
        value = F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise("")
        return F.concat(let(decode(name), encode), F.lit("\u0001"), let(decode(value), encode))

    kept = F.filter(F.transform(pieces, pair), lambda p: ~p.rlike("^utm_|^[^\u0001]*session"))
    joined = F.replace(F.array_join(F.array_sort(F.array_distinct(kept)), "\u0002"), F.lit("\u0001"), F.lit("="))
    tidy = F.replace(joined, F.lit("\u0002"), F.when(delimiter == "", "&").otherwise(delimiter))
    return F.when(query == "", "").when((delimiter == "") & ~query.contains("="), encode(decode(query))).otherwise(tidy)


def dot_segments(path: Column) -> Column:
    """The path without ``.``, ``..`` that has something before it, and doubled slashes."""
    pieces = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, x: Column) -> Column:
        size = F.size(done)
        up = (x == "..") & (size > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    # a path that ends in a slash, a dot or two dots that were undone names a folder
    last = F.regexp_extract(path, "([^/]*)$", 1)

    def tidied(kept: Column) -> Column:
        folder = last.isin("", ".") | ((last == "..") & ~F.array_contains(kept, ".."))
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))

    tidy = let(F.aggregate(pieces, F.array().cast("array<string>"), step), tidied)
    return F.when(path.rlike(r"//|/\.\.?(/|$)"), tidy).otherwise(path)


def normalize(url: Column) -> Column:
    """One spelling for the addresses of a page: host in small letters, port 80 left out, no user part and no
    fragment, plain escapes undone, parameters in order, dot segments resolved.  A missing scheme is http.
    Null for what can't be a URL, as with spaces in its path."""
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), url).otherwise(F.concat(F.lit("http://"), url))
    return let(full, _normalize)


def _normalize(full: Column) -> Column:
    group = lambda k: F.regexp_extract(full, _PARTS, k)
    port = group(PORT)
    path = let(F.when(group(PATH) == "", "/").otherwise(decode_unreserved(group(PATH))), lambda p: F.when(~p.rlike(r'[\s"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})'), dot_segments(p)))
    query = let(unescape(group(QUERY)), clean_query)
    out = F.concat(
        F.lower(group(SCHEME)), F.lit("://"), F.lower(group(HOST)), F.when(port.isin("", "80"), "").otherwise(F.concat(F.lit(":"), port)),
        path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(full.rlike(_PARTS) & (group(HOST) != ""), out)


def full_host(url: Column) -> Column:
    """``http://authority/``, always with http: the key under which hosts are kept."""
    user, port = part(url, USER), part(url, PORT)
    return F.concat(F.lit("http://"), F.when(user == "", "").otherwise(F.concat(user, F.lit("@"))), part(url, HOST), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.lit("/"))


def equal_hosts(a: Column, b: Column, full: bool = False) -> Column:
    """Whether two URLs have the same host; with ``full``, whether they are the same up to the fragment."""
    if not full:
        return F.lower(part(a, HOST)) == F.lower(part(b, HOST))
    port = lambda u: F.when(part(u, PORT) == "", F.when(F.lower(part(u, SCHEME)) == "https", "443").otherwise("80")).otherwise(part(u, PORT))
    return (F.lower(part(a, SCHEME)) == F.lower(part(b, SCHEME))) & (F.lower(part(a, HOST)) == F.lower(part(b, HOST))) & (port(a) == port(b)) & (file(a) == file(b))


def file(url: Column) -> Column:
    """Path and query."""
    query = part(url, QUERY)
    return F.concat(part(url, PATH), F.when(url.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), query)).otherwise(""))


def join_host(host: Column, path: Column) -> Column:
    """A host address (which ends in a slash) and a path that begins with one."""
    return F.concat(F.regexp_replace(host, "/$", ""), path)


def resolve(base: Column, ref: Column) -> Column:
    """A reference against a base URL; one that is absolute stays.  A reference that is only a query takes
    the base's folder, as RFC 2396 has it; a fragment alone is the base itself."""
    return let(F.struct(base.alias("base"), F.trim(ref).alias("ref")), lambda x: _resolve(x["base"], x["ref"]))


def _resolve(base: Column, ref: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.when(part(base, PATH) == "", "/").otherwise(F.regexp_extract(part(base, PATH), "^(.*/)", 1)))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(part(base, SCHEME), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when((ref == "") | ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(folder, ref))
    )
