"""Columns over urls: parts, normal forms, resolution of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"


def protocol(url: Column) -> Column:
    """Scheme of an absolute url, null otherwise."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit(""))


def host(url: Column) -> Column:
    """Host without user and port, null otherwise."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def site_root(url: Column) -> Column:
    """Scheme and authority, null otherwise."""
    return F.nullif(F.regexp_extract(url, _ROOT, 0), F.lit(""))


def domain_label(url: Column) -> Column:
    """The label before the last one of the host, the whole host if it has one label."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(host(url))


def default_path_pattern(url: Column) -> Column:
    """Pattern of a catalog without one: any host with the site's label, any path."""
    return F.concat(protocol(url), F.lit("://**."), domain_label(url), F.lit(".**/**"))


def without_closing_slash(path: Column, refer: Column) -> Column:
    """The site's root with a slash is the site's root; nothing else is normalised."""
    return F.when(path == F.concat(refer, F.lit("/")), refer).otherwise(path)


def without_dots(path: Column) -> Column:
    """`.` and `..` segments of a rooted path resolved, however many; a slash at the end stays, and stands for a last dot segment."""
    folded = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/", -1),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))),
    )
    end = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(folded, "/"), end), r"^//$", "/")


def resolved(href: Column, base: Column) -> Column:
    """Absolute url of a link (RFC 3986) on a page: absolute, scheme-relative, rooted, query, fragment or relative."""
    root = site_root(base)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    relative = F.regexp_replace(F.substr(F.concat(folder, href), F.length(root) + 1), r"^(?!/)", "/")
    tail = F.regexp_extract(relative, r"([?#].*)$", 1)
    path = without_dots(F.regexp_replace(relative, r"[?#].*$", ""))
    return (
        F.when(href.isNull() | (F.trim(href) == ""), F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(protocol(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(root, path, tail))
    )
