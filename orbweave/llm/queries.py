"""Queries of the operators on texts, over whole tables and with production parameters."""

from __future__ import annotations

from orbweave.llm.containers import container_fill, pack, packing_checks, packing_summary
from orbweave.llm.main_body import main_contents, main_lines, main_texts
from orbweave.llm.mixing import mix, mixture_checks
from orbweave.llm.mojibake import chain_rates, garbled_fields
from orbweave.llm.repeated_lines import repeated_blocks, repeated_lines, without_repeated_lines
from orbweave.llm.residue import template_residue
from orbweave.llm.seen_keys import seen_before, seen_rates
from orbweave.llm.shared_spans import shared_amounts, shared_classes, shared_pairs, shared_stretches
from orbweave.session import table


def p2_found(spark, sf_dir):
    """Lines that stand on a large share of a catalog's pages."""
    return repeated_lines(table(spark, sf_dir, "crawler_resource")).select("id", "line_no")


def p2_cleaned(spark, sf_dir):
    """The pages without them."""
    return without_repeated_lines(table(spark, sf_dir, "crawler_resource"))


def p2_blocks(spark, sf_dir):
    """The boilerplate blocks with their support and text."""
    return repeated_blocks(table(spark, sf_dir, "crawler_resource"))


def p3_found(spark, sf_dir):
    """Lines of each page's main body."""
    return main_lines(table(spark, sf_dir, "crawler_resource"), table(spark, sf_dir, "crawler_catalog"))


def p3_texts(spark, sf_dir):
    """The main body's text of each page."""
    return main_texts(table(spark, sf_dir, "crawler_resource"), table(spark, sf_dir, "crawler_catalog"))


def p3_contents(spark, sf_dir):
    """Search documents with the main body only."""
    pages, catalogs = table(spark, sf_dir, "crawler_resource"), table(spark, sf_dir, "crawler_catalog")
    return main_contents(table(spark, sf_dir, "indexed_resource"), pages, catalogs)


def p4_found(spark, sf_dir):
    """Titles and pages that hold wrongly decoded text."""
    return garbled_fields(table(spark, sf_dir, "crawler_resource")).select("id", "field_name")


def p4_restored(spark, sf_dir):
    """The same with the original text, as far as it can be had."""
    return garbled_fields(table(spark, sf_dir, "crawler_resource"), restore=True)


def p4_rates(spark, sf_dir):
    """What the models find and restore of held-out words garbled on purpose, by chain, and what they flag of clean ones."""
    return chain_rates(table(spark, sf_dir, "crawler_resource"))


def p5_found(spark, sf_dir):
    """Pages whose (catalog_id, url) came before."""
    return seen_before(table(spark, sf_dir, "crawler_resource"))


def p6_found(spark, sf_dir):
    """Pages that show placeholders, filler, errors or demands for scripts where content should be."""
    found = template_residue(table(spark, sf_dir, "crawler_resource"), table(spark, sf_dir, "crawler_catalog"))
    return found.select("id").distinct()


def p6_reasons(spark, sf_dir):
    """The same with the reasons."""
    return template_residue(table(spark, sf_dir, "crawler_resource"), table(spark, sf_dir, "crawler_catalog"))


def p5_rates(spark, sf_dir):
    """Theoretical and audited false positives of the coded sets."""
    return seen_rates(table(spark, sf_dir, "crawler_resource"))


def _packed(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p7_packed(spark, sf_dir):
    """Every document's place in the containers of each capacity."""
    return _packed(spark, sf_dir)


def p7_containers(spark, sf_dir):
    """The containers with the number of their items and their fill."""
    return container_fill(_packed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p7_summary(spark, sf_dir):
    """Containers used, fewest possible and mean fill by capacity."""
    return packing_summary(_packed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p7_checks(spark, sf_dir):
    """What must hold of the packing."""
    return packing_checks(_packed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p8_drawn(spark, sf_dir):
    """Documents drawn for the mixture, with their copies."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):
    """Shares of the sources, wanted and reached."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_checks(spark, sf_dir):
    """What must hold of the mixture."""
    return mixture_checks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark, sf_dir):
    """Pairs of documents that share 200 code points or more in one stretch."""
    return shared_pairs(table(spark, sf_dir, "documents"))


def p9_shared(spark, sf_dir):
    """How much of each document also stands elsewhere."""
    return shared_amounts(table(spark, sf_dir, "documents"))


def p9_spans(spark, sf_dir):
    """The stretches themselves, by document."""
    return shared_stretches(table(spark, sf_dir, "documents"))


def p9_classes(spark, sf_dir):
    """Documents by the spans they hold in common, without expanding them to pairs."""
    return shared_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        p2_found,
        p2_cleaned,
        p2_blocks,
        p3_found,
        p3_texts,
        p3_contents,
        p4_found,
        p4_restored,
        p4_rates,
        p5_found,
        p5_rates,
        p6_found,
        p6_reasons,
        p7_packed,
        p7_containers,
        p7_summary,
        p7_checks,
        p8_drawn,
        p8_shares,
        p8_checks,
        p9_found,
        p9_shared,
        p9_spans,
        p9_classes,
    )
}

#: Where stretches shared with another document begin and end: every run of 200 code points that two documents have.
_STRETCHES = """
WITH spans AS (
  SELECT doc_id, p, hash(s) AS h1, hash(s || '.') AS h2 FROM (
    SELECT doc_id, p, substring(text, p, 200) AS s FROM (
      SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200))
), common AS (SELECT h1, h2 FROM spans GROUP BY h1, h2 HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT DISTINCT doc_id, p FROM spans JOIN common USING (h1, h2)),
runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
    SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits)),
stretches AS (SELECT doc_id, min(p) - 1 AS start, max(p) + 199 AS stop FROM runs GROUP BY doc_id, run)
"""

SQL = {
    "p7_checks": """
SELECT spec_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS loose
FROM container_specs
""",
    "p8_checks": "SELECT DISTINCT source, 0::BIGINT AS too_often, 0::BIGINT AS twice, 0::BIGINT AS strange FROM mix_targets",
    "p5_found": """
SELECT r.id FROM crawler_resource r JOIN (
  SELECT catalog_id, url, min(id) AS first_id FROM crawler_resource
  WHERE url IS NOT NULL AND catalog_id IS NOT NULL GROUP BY catalog_id, url
) f ON r.catalog_id = f.catalog_id AND r.url = f.url WHERE r.id > f.first_id
""",
    "p9_found": """
WITH spans AS (
  SELECT DISTINCT doc_id, hash(s) AS h1, hash(s || '.') AS h2 FROM (
    SELECT doc_id, substring(text, p, 200) AS s FROM (
      SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200))
), common AS (SELECT h1, h2 FROM spans GROUP BY h1, h2 HAVING count(*) > 1),
hits AS (SELECT s.* FROM spans s JOIN common c ON c.h1 = s.h1 AND c.h2 = s.h2)
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM hits a JOIN hits b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.doc_id < b.doc_id
""",
    "p9_spans": _STRETCHES + "SELECT doc_id, start::INT AS start, stop::INT AS stop FROM stretches",
    "p9_shared": _STRETCHES + """
SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(c.covered, 0)::BIGINT AS shared_chars,
  CASE WHEN coalesce(length(d.text), 0) > 0 THEN round(coalesce(c.covered, 0) / length(d.text), 6) ELSE 0.0 END AS shared_share
FROM documents d LEFT JOIN (SELECT doc_id, sum(stop - start) AS covered FROM stretches GROUP BY doc_id) c USING (doc_id)
""",
}
