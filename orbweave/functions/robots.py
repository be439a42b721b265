"""Robots rules (RFC 9309): parsed to rows of regular expressions, joined by host, longest match wins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "host string, rule string, allow boolean, length int"


def _regex(path: str) -> str:
    body = "".join(".*" if c == "*" else re.escape(c) for c in path.rstrip("$"))
    return f"^{body}$" if path.endswith("$") else f"^{body}"


def parse(content: str | None, agent: str = "*") -> list[tuple[str, bool, int]]:
    """(regex, allow, length of the path) of the most specific group that names the agent; [] allows everything."""
    groups: dict[str, list[tuple[str, bool, int]]] = {}
    agents: list[str] = []
    closed = False
    for raw in (content or "").splitlines():
        line = raw.split("#", 1)[0].strip()
        if ":" not in line:
            continue
        field, value = (x.strip() for x in line.split(":", 1))
        field = field.lower()
        if field == "user-agent":
            if closed:
                agents, closed = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow") and agents:
            closed = True
            if value:
                for name in agents:
                    groups[name].append((_regex(value), field == "allow", len(value)))
    named = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(named, key=len)] if named else groups.get("*", [])


def rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rule, allow, length) from (host, content); a missing or unreadable file has no rules and so allows all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, *r) for h, c in zip(pdf["host"], pdf["content"]) for r in parse(c, agent)]
            yield pd.DataFrame(rows, columns=["host", "rule", "allow", "length"])

    return files.select("host", "content").mapInPandas(run, RULES)


def allowed(urls: DataFrame, rule_rows: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """`urls` with `allowed`: the longest matching rule decides, allow wins ties, no match allows."""
    by_host = rule_rows.groupBy("host").agg(F.collect_list(F.struct("length", "allow", "rule")).alias("_rules"))
    path = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    best = F.array_max(F.transform(F.filter("_rules", lambda r: F.rlike(F.col("_path"), r["rule"])), lambda r: F.struct(r["length"], r["allow"])))
    joined = urls.join(by_host.withColumnRenamed("host", "_host"), F.col(host) == F.col("_host"), "left").withColumn("_path", path)
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_rules", "_host", "_path")

