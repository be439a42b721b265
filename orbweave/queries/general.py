"""Queries of the general data operations (not tied to one kind of text)."""

from __future__ import annotations

from orbweave.operators.snapshot_diff import snapshot_changes
from orbweave.session import table


def p1_found(spark, sf_dir):
    """Urls added, removed or changed between consecutive deliveries of each catalog."""
    return snapshot_changes(table(spark, sf_dir, "crawler_resource"))


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
WITH latest AS (
  SELECT catalog_id, version, url, html FROM crawler_resource
  WHERE url IS NOT NULL AND catalog_id IS NOT NULL AND version IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY catalog_id, version, url ORDER BY id DESC) = 1
), pairs AS (
  SELECT catalog_id, version AS earlier, lead(version) OVER (PARTITION BY catalog_id ORDER BY version) AS later
  FROM (SELECT DISTINCT catalog_id, version FROM latest)
), a AS (
  SELECT p.catalog_id, p.later AS version, l.url, l.html FROM pairs p JOIN latest l
  ON l.catalog_id = p.catalog_id AND l.version = p.earlier WHERE p.later IS NOT NULL
), b AS (
  SELECT p.catalog_id, p.later AS version, l.url, l.html FROM pairs p JOIN latest l
  ON l.catalog_id = p.catalog_id AND l.version = p.later
)
SELECT coalesce(a.catalog_id, b.catalog_id) AS catalog_id, coalesce(a.url, b.url) AS url,
  coalesce(a.version, b.version) AS version,
  CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.catalog_id = b.catalog_id AND a.version = b.version AND a.url = b.url
WHERE a.url IS NULL OR b.url IS NULL OR a.html IS DISTINCT FROM b.html
"""
}
