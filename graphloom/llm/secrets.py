"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind -> (expression, group of the secret).  No look-around, so that Java and RE2 agree; no upper bounds, so that a
#: secret is taken whole, however long.
PATTERNS = {
    "aws_access_key": (r"(AKIA[0-9A-Z]{16,})", 1),
    "github_token": (r"(gh[pousr]_[A-Za-z0-9]{36,})", 1),
    "google_api_key": (r"(AIza[0-9A-Za-z_\-]{35,})", 1),
    "slack_token": (r"(xox[abprs]-[0-9A-Za-z\-]{10,})", 1),
    "stripe_key": (r"([sr]k_live_[0-9A-Za-z]{16,})", 1),
    "openai_key": (r"(sk-[A-Za-z0-9_\-]{20,})", 1),
    "json_web_token": (r"(eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})", 1),
    "private_key": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END)", 1),
    "url_password": (r"://[^\s:/@]+:([^\s:/@]{4,})@", 1),
    "assigned": (r"""(?i:token|secret|passwd|password|api_?key|access_?key)["']?\s*[:=]{1,2}\s*["']([^"'\s]{8,})["']""", 1),
}
#: A text is scanned for a kind only where one of these occurs; cheap, and every match has one.
MARKS = {
    "aws_access_key": ("AKIA",), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "google_api_key": ("AIza",), "slack_token": ("xox",),
    "stripe_key": ("k_live_",), "openai_key": ("sk-",), "json_web_token": ("eyJ",), "private_key": ("PRIVATE KEY",), "url_password": ("://",),
    "assigned": (),
}
#: A value with one of these (in lower case) is a stand-in.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "your-", "xxxx", "dummy", "sample", "redacted", "<", "${")
#: Found with so many owners or more, a value is a widely copied example.
COPIED_OWNERS = 3
#: Bits a sign that a live-looking value has at least; below it is a word or a pattern.
MIN_ENTROPY = 2.5


def _found(kind: str) -> str:
    pattern, group = PATTERNS[kind]
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    scan = f"regexp_extract_all(text, '{quoted}', {group})"
    marks = " or ".join(f"contains(text, '{m}')" for m in MARKS[kind])
    scan = f"if({marks}, {scan}, array())" if marks else scan
    return f"transform({scan}, v -> struct('{kind}' as kind, v as value))"


def candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """(repository, owner, kind, value), one row for each occurrence."""
    named = docs.select(F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = F.expr(f"concat({', '.join(map(_found, PATTERNS))})")
    return named.select("repository", "owner", F.explode(every).alias("c")).select("repository", "owner", "c.kind", "c.value")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each (kind, secret): its hash, how often and with how many distinct repositories and
    owners it occurs, and the verdict: ``placeholder``, ``example`` (COPIED_OWNERS or more owners have
    it), ``low_entropy`` or ``live`` (found with one or two owners only).

    The secret itself is hashed before it is shuffled and is not in the result.  Null repositories and
    owners are not counted as one; null and empty texts hold nothing; repeated rows add occurrences, not
    repositories; other columns are not read; an empty table gives an empty result."""
    low = F.lower("value")
    signs = F.expr("split(value, '')")
    length = F.length("value")
    entropy = F.aggregate(
        F.transform(F.array_distinct(signs), lambda s: F.size(F.filter(signs, lambda x: x == s)).cast("double") / length),
        F.lit(0.0), lambda total, p: total - p * F.log2(p),
    )
    stand_in = F.lit(False)
    for word in PLACEHOLDERS:
        stand_in = stand_in | F.contains(low, F.lit(word))
    rated = candidates(docs, repository, owner).groupBy(F.col("kind"), F.sha2("value", 256).alias("secret_hash")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"),
        F.bool_or(stand_in).alias("stand_in"), F.max(entropy).alias("entropy"),
    )
    verdict = F.when(F.col("stand_in"), "placeholder").when(F.col("owners") >= COPIED_OWNERS, "example").when(F.col("entropy") < MIN_ENTROPY, "low_entropy").otherwise("live")
    return rated.select("kind", "secret_hash", "occurrences", "repositories", "owners", verdict.alias("verdict"))


def sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = "\n  union all ".join(f"select doc_id, source, '{k}' as kind, unnest(regexp_extract_all(text, {quote(p)}, {g})) as value from documents" for k, (p, g) in PATTERNS.items())
    stand_in = " or ".join(f"contains(lower(value), {quote(w)})" for w in PLACEHOLDERS)
    return f"""with found as (
  {parts}
), shares as (
  select value, sign, count(*) / length(any_value(value))::DOUBLE as p
  from (select value, unnest(string_split(value, '')) as sign from (select distinct value from found)) where sign <> '' group by 1, 2
), entropies as (select value, -sum(p * log2(p)) as entropy from shares group by 1
), rated as (
  select kind, sha256(value) as secret_hash, count(*) as occurrences, count(distinct doc_id) as repositories, count(distinct source) as owners,
    bool_or({stand_in}) as stand_in, max(entropy) as entropy
  from found join entropies using (value) group by 1, 2
)
select kind, secret_hash, occurrences, repositories, owners,
  case when stand_in then 'placeholder' when owners >= {COPIED_OWNERS} then 'example' when entropy < {MIN_ENTROPY} then 'low_entropy' else 'live' end as verdict
from rated"""
