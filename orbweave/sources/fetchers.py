"""Page fetchers behind one interface: stored pages, or any Python fetcher in parallel, with retry, pacing and defaults."""

from __future__ import annotations

import codecs
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.plans.crawl import fetched

#: (url, charset) to html; raises on failure.
Fetcher = Callable[[str, str], str]
_REGISTRY: dict[str, Callable[[], Fetcher]] = {}


class FetchError(RuntimeError):
    """A page could not be had."""

    def __init__(self, url: str, status: int = 404):
        super().__init__(f"{status}: {url}")
        self.url, self.status = url, status


def register(name: str, factory: Callable[[], Fetcher]) -> None:
    """Add a fetcher under a lower-case name; the factory runs once per task, so clients are pooled by task."""
    _REGISTRY[name.lower()] = factory


def factory_of(name: str) -> Callable[[], Fetcher]:
    """Factory for a catalog's extractor name; an unknown name is an error."""
    key = (name or "default").lower()
    if key not in _REGISTRY:
        raise ValueError(f"unknown extractor: {name}")
    return _REGISTRY[key]


#: Headers of a plain request. Agents and addresses are not made up.
HEADERS = {"Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en,*;q=0.5"}
TIMEOUT_S = 300.0


def _plain(headers: dict[str, str] | None = None, timeout_s: float = TIMEOUT_S) -> Fetcher:
    from urllib.request import Request, urlopen

    def fetch(url: str, charset: str) -> str:
        with urlopen(Request(url, headers={**HEADERS, **(headers or {})}), timeout=timeout_s) as answer:  # noqa: S310
            if not 200 <= answer.status < 300:
                raise FetchError(url, answer.status)
            return decode(answer.read(), charset)

    return fetch


register("default", _plain)
register("resttemplate", _plain)


@dataclass
class Retrying:
    """Attempts in all, fixed pause between them; what fails for good is a FetchError."""

    inner: Fetcher
    attempts: int = 1
    pause_s: float = 1.0

    def __call__(self, url: str, charset: str) -> str:
        for n in range(max(1, self.attempts)):
            try:
                return self.inner(url, charset)
            except Exception as e:  # noqa: BLE001
                if n + 1 >= self.attempts:
                    raise e if isinstance(e, FetchError) else FetchError(url) from e
                time.sleep(self.pause_s)
        raise FetchError(url)


@dataclass
class Paced:
    """A pause before each fetch: of a fixed length, or (`least_ms`) of a random one between two."""

    inner: Fetcher
    interval_ms: int = 1000
    least_ms: int | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, url: str, charset: str) -> str:
        ms = self.interval_ms if self.least_ms is None else random.uniform(min(self.least_ms, self.interval_ms), self.interval_ms)
        self.sleep(ms / 1000)
        return self.inner(url, charset)


def for_policy(extractor: str, max_retry_count: int = 0, interval_ms: int = 1000, pause_s: float = 1.0) -> Callable[[], Fetcher]:
    """Factory for a catalog's fetcher: the extractor of that name, tried again as often as allowed, each try after the catalog's pause."""
    inner = factory_of(extractor)
    return lambda: Retrying(Paced(inner(), interval_ms), max(1, max_retry_count), pause_s)


def live_fetch(factory: Callable[[], Fetcher], charset: str = "UTF-8") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A fetch step for `crawl` that calls a fetcher in every task; a failure is an empty page."""

    def step(frontier: DataFrame, _pages: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch = factory()
            for pdf in batches:
                got = []
                for url in pdf["path"]:
                    try:
                        got.append(fetch(url, charset) or "")
                    except Exception:  # noqa: BLE001
                        got.append("")
                yield pdf.assign(html=got)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frontier.schema) + ", html string"
        return frontier.mapInPandas(run, schema)

    return step


def charset_of(name: str | None) -> str:
    """The codec of a charset name however it is spelt; UTF-8 where it is null, blank or unknown."""
    try:
        return codecs.lookup((name or "").strip() or "utf-8").name
    except LookupError:
        return "utf-8"


def decode(raw: bytes, charset: str | None) -> str:
    """Bytes as text in a charset; what it does not know becomes the replacement character."""
    return raw.decode(charset_of(charset), "replace")


def decoded_pages(files: DataFrame, charset_column: str = "page_encoding") -> DataFrame:
    """Binary pages (url, content, charset) as text in their charset; an unknown charset is read as UTF-8."""

    @F.pandas_udf("string")
    def run(content: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else decode(c, n) for c, n in zip(content, charset)], dtype=object)

    return files.withColumn("html", run("content", charset_column))


def encoded_pages(pages: DataFrame, charset_column: str = "page_encoding") -> DataFrame:
    """The reverse: html as bytes (`content`) in the charset, characters it lacks as numeric entities."""

    @F.pandas_udf("binary")
    def run(text: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t.encode(charset_of(n), "xmlcharrefreplace") for t, n in zip(text, charset)], dtype=object)

    return pages.withColumn("content", run("html", charset_column))


__all__ = ["FetchError", "Paced", "Retrying", "charset_of", "decode", "decoded_pages", "encoded_pages", "factory_of", "fetched", "for_policy", "live_fetch", "register"]
