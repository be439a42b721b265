"""Acceptance of extracted links: robots, depth, path patterns, user predicates, as one short-circuit chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.functions import antpath

#: Predicates by name: (link url, the site's root, policy columns) to a boolean column.
Acceptor = Callable[[Column, Column, dict[str, Column]], Column]
ACCEPTORS: dict[str, Acceptor] = {}


def acceptor(name: str) -> Callable[[Acceptor], Acceptor]:
    """Register a predicate under a name that catalogs list in `url_path_acceptor`."""

    def add(fn: Acceptor) -> Acceptor:
        ACCEPTORS[name] = fn
        return fn

    return add


def link_depth(url: Column, refer: Column) -> Column:
    """Slashes of the url less the site's root and one leading slash; a foreign url keeps those of its scheme."""
    rest = F.regexp_replace(F.replace(url, refer, F.lit("")), "^/", "")
    return (F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit("")))).cast("int")


def within_depth(url: Column, refer: Column, depth: Column) -> Column:
    """A negative depth accepts everything; the site's root itself has depth 0."""
    return (depth < 0) | (link_depth(url, refer) <= depth)


def path_accepted(url: Column, refer: Column, included: Column, excluded: Column) -> Column:
    """Excluded patterns first, then included ones; without any included pattern the site's root has to lead the url.

    `included` and `excluded` are arrays of Ant patterns per row (empty or null for none).
    """
    any_of = lambda patterns: F.coalesce(F.exists(patterns, lambda p: F.rlike(url, antpath.regex_of(p))), F.lit(False))
    return F.when(any_of(excluded), F.lit(False)).when(F.coalesce(F.size(included), F.lit(0)) > 0, any_of(included)).otherwise(url.startswith(refer))


def fixed_path_accepted(url: Column, refer: Column, included: list[str], excluded: list[str]) -> Column:
    """The same for the patterns of one catalog, translated once on the driver."""
    chosen = antpath.any_match(url, included) if included else url.startswith(refer)
    return F.when(antpath.any_match(url, excluded), F.lit(False)).otherwise(chosen) if excluded else chosen


@acceptor("depth")
def _depth(url: Column, refer: Column, policy: dict[str, Column]) -> Column:
    return within_depth(url, refer, policy["depth"])


def accepted(url: Column, refer: Column, policy: dict[str, Column], names: list[str] = (), robots: Column | None = None) -> Column:
    """The chain in order: user predicates and robots, depth, path patterns. Unknown names are ignored."""
    checks = [ACCEPTORS[n](url, refer, policy) for n in names if n in ACCEPTORS and n != "depth"]
    if robots is not None:
        checks.append(robots)
    checks += [within_depth(url, refer, policy["depth"]), path_accepted(url, refer, policy["included"], policy["excluded"])]
    verdict = checks[-1]
    for check in reversed(checks[:-1]):
        verdict = F.when(check, verdict).otherwise(F.lit(False))
    return verdict
