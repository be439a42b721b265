"""Explicit schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _B, _H, _N = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.ShortType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CATALOG = _struct(
    id=_L, name=_S, url=_S, start_url=_S, path_pattern=_S, excluded_path_pattern=_S, cat=_S, page_encoding=_S,
    max_fetch_size=_I, duration=_L, interval_ms=_L, depth=_H, counting_type=_H, max_retry_count=_H, url_path_acceptor=_S,
    url_path_filter=_S, extractor=_S, credential_handler=_S, running_state=_S, indexed=_B, last_modified=_N,
)
CATALOG_INDEX = _struct(id=_L, catalog_id=_L, last_modified=_N, version=_I)
RESOURCE = _struct(id=_L, title=_S, html=_S, url=_S, cat=_S, create_time=_N, version=_I, catalog_id=_L)
INDEXED_RESOURCE = _struct(
    id=_L, title=_S, content=_S, url=_S, path=_S, cat=_S, catalog=_S, version=_I, create_time=_L
)
FRONTIER = _struct(
    action=_S, catalog_id=_L, refer=_S, path=_S, cat=_S, page_encoding=_S, max_fetch_size=_I, duration=_L, depth=_I,
    interval_ms=_L, version=_I, index_enabled=_B, level=_I,
)
SEARCH_RESULT = _struct(id=_L, title=_S, content=_S, url=_S, path=_S, cat=_S, catalog=_S, version=_I, create_time=T.TimestampType())

# What a blank or null policy field stands for.
DEFAULTS = {
    "page_encoding": "UTF-8",
    "max_fetch_size": 10000,
    "depth": -1,
    "duration": 5,
    "max_retry_count": 0,
    "interval_ms": 1000,
    "url_path_filter": "redission-bloomfilter",
    "extractor": "resttemplate",
    "counting_type": 0,
}
# Run counters by their code.
COUNTERS = ("URL_TOTAL_COUNT", "INVALID_URL_COUNT", "EXISTING_URL_COUNT", "FILTERED_URL_COUNT", "SAVED_RESOURCE_COUNT", "INDEXED_RESOURCE_COUNT")
# Markers of a highlighted search word, size and number of its fragments.
HIGHLIGHT_PRE, HIGHLIGHT_POST = "<font color='red' class='searchKeyword'>", "</font>"
FRAGMENT_CHARS, FRAGMENTS = 120, 3
RUNNING_STATES = ("none", "crawl", "update", "rebuild")
