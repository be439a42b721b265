"""Template residue and error pages: records that show placeholders, filler or errors where content should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.main_body import page_arrays, page_bodies

#: Sites on which a title has to recur, on pages that do not show it, to count as a default.
DEFAULT_SITES = 3
#: Records with a slot that holds nothing but a variable, from which the variable is proven; marks in which a name is
#: used, and records with it, from which the name is.
PROVEN_RECORDS, PROVEN_STYLES, NAME_RECORDS = 2, 2, 3


def slot_variables(pages: DataFrame) -> DataFrame:
    """(doc) of records in which a slot retains a variable.

    A slot is the place of a text in the records of a site, or the title. A variable is proven where it is all
    that slots of several records hold, or where its name stands in different marks: that is how templates
    are written, and not prose. A proven one counts at the begin or end of a slot's value, in marks of two
    signs or more anywhere; such marks count at begin and end unproven too. So a path or a set in a text about code does not.
    """
    marks = pages.filter("size(marks) > 0").select("doc", F.explode("marks").alias("m")).select("doc", "m.*")
    uses = marks.groupBy("token", "name", "style").agg(F.count_if("whole").alias("wholes"), F.count_if(F.col("whole") | F.col("edge")).alias("uses"))
    names = uses.filter("uses > 0").groupBy("name").agg(F.collect_set("style").alias("styles"), F.sum("uses").alias("named"))
    names = names.select("name", ((F.size("styles") >= PROVEN_STYLES) & (F.col("named") >= NAME_RECORDS)).alias("by_name"))
    proven = uses.join(names, "name", "left").filter((F.col("wholes") >= PROVEN_RECORDS) | F.coalesce("by_name", F.lit(False)))
    known = marks.join(proven.select("token", F.lit(True).alias("proven")), "token", "left").withColumn("proven", F.coalesce("proven", F.lit(False)))
    return known.filter("(whole or edge) and (proven or strong) or strong and proven").select("doc")


def default_titles(pages: DataFrame) -> DataFrame:
    """(doc) of records whose title is a default: the same on several sites, without what sites add behind a dash or a
    bar, on pages that do not show it. A title without a letter or digit is a blank one."""
    key = F.lower(F.regexp_extract("title", r"^(.*?)(?:\s+[-–—|:·]+\s+.*)?$", 1))
    unseen = pages.filter("title is not null and not shown").select("doc", "site", key.alias("key")).filter(F.col("key").rlike(r"[\p{L}\p{N}]"))
    common = unseen.select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("sites")).filter(F.col("sites") >= DEFAULT_SITES).select("key")
    return unseen.join(common, "key", "left_semi").select("doc")


def template_residue(rows: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """(id, reason) with reason `placeholder`, `title` or `replaced`; a record may have several reasons.

    Records of one host are aligned by its template (see main_body); what is not template fills the slots.
    `placeholder`: a slot retains a variable (see slot_variables; code samples and scripts left out). `title`: the
    title recurs on several sites whose pages do not show it. `replaced`: what fills the page's
    slots is chiefly filler, a trace, variables, or a text
    that stands on otherwise bare pages of several hosts (errors, demands for scripts, filler sentences), or nothing but a headline, or nothing at all.
    Null or empty html and a blank title alone are no reason; rows with null id are left out; repeated rows
    are reported once; extra columns are never read; an empty table gives an empty result.
    """
    pages = page_arrays(rows, catalogs, residue=True)
    replaced = page_bodies(pages.filter("size(items) > 0")).filter("2 * content <= all_chars")
    reasons = (("placeholder", slot_variables(pages)), ("title", default_titles(pages)), ("replaced", replaced))
    found = [docs.select(F.col("doc").alias("id"), F.lit(reason).alias("reason")) for reason, docs in reasons]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()
