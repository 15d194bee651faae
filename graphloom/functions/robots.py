"""Robots policies: parsed once for each host, applied as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLICY = "allows array<string>, disallows array<string>, crawl_delay float, allow_all boolean"
AGENT = "GraphloomBot/1.0"
_FIELDS = ("user-agent", "disallow", "allow", "crawl-delay")


def parse(text: str | None, agent: str = AGENT) -> dict:
    """The policy of a robots file for an agent.

    A group for the agent itself wins over ``*``: the first one drops what was gathered, and later
    Disallow lines of ``*`` don't count, while its Allow and Crawl-delay lines do.  Of several User-agent
    lines in a row the last one counts.  A file that is missing allows everything."""
    allows: list[str] = []
    disallows: list[str] = []
    delay = 0.0
    own = general = found = False
    for line in (text or "").splitlines():
        head, colon, rest = line.partition(":")
        name = head.lower()
        if not colon or name not in _FIELDS:
            continue
        value = rest.partition("#")[0].strip()
        if name == "user-agent":
            own, general = value == agent, value == "*"
            if own and not found:
                allows, disallows, delay, found = [], [], 0.0, True
        elif not (own or general):
            continue
        elif name == "disallow":
            if value and not (general and found):
                disallows.append(value)
        elif name == "allow":
            if value:
                allows.append(value)
        else:
            try:
                delay = float(value)
            except ValueError:
                pass
    return {"allows": allows, "disallows": disallows, "crawl_delay": delay, "allow_all": not disallows}


def policy(text: Column, agent: str = AGENT) -> Column:
    """The policy struct of a robots file's text: one row for each host, so Python is no bottleneck."""

    @F.pandas_udf(POLICY)
    def parsed(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x, agent) for x in files], columns=["allows", "disallows", "crawl_delay", "allow_all"])

    return parsed(text)


def _hits(path: Column, rule: Column) -> Column:
    # a star stands for one sign or more of one segment
    pattern = F.concat(F.lit("^(?:"), F.replace(rule, F.lit("*"), F.lit("[^/]+")), F.lit(").*$"))
    return path.startswith(rule) | (rule.contains("*") & F.rlike(path, pattern))


def allows(path: Column, policy: Column) -> Column:
    """Whether the policy lets the path be fetched; a missing policy does."""
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    barred = F.exists(policy["disallows"], lambda r: _hits(path, r)) & ~F.exists(policy["allows"], lambda r: _hits(path, r))
    return policy.isNull() | policy["allow_all"] | ~barred


def delay_ms(policy: Column) -> Column:
    return (F.coalesce(policy["crawl_delay"], F.lit(0.0)) * 1000).cast("int")
