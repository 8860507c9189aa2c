"""Checks of requests for signatures before they are sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_email


def request_problems(drafts: DataFrame, signers: DataFrame, fields: DataFrame) -> DataFrame:
    """(request, problem, signer): the first thing wrong with each draft, null if nothing is, and the signer that it is about.

    drafts: request, title, requester, email. signers: request, signer, name, email; looked at by signer. fields: request, signer.
    In this order: title, requester, requester's email; no signer; each signer's name and email; no field; a signer who owns no
    field. Null counts as blank; fields of unknown signers count as fields; a draft's row is one row here.
    """
    c = F.col
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    bad = lambda x: ~F.coalesce(is_email(F.trim(x)), F.lit(False))
    owned = fields.groupBy("request", "signer").agg(F.count(F.lit(1)).alias("_own"))
    wrong = F.when(blank(c("name")), "signer-name").when(bad(c("email")), "signer-email")
    each = signers.select("request", "signer", wrong.alias("wrong")).join(owned, ["request", "signer"], "left")
    said = lambda x: F.struct("signer", x.alias("problem"))
    people = each.groupBy("request").agg(F.min(F.when(c("wrong").isNotNull(), said(c("wrong")))).alias("_person"), F.min(F.when(c("_own").isNull(), said(F.lit("nothing-to-sign")))).alias("_idle"), F.lit(True).alias("_any"))
    placed = owned.groupBy("request").agg(F.sum("_own").alias("_fields"))
    own = F.when(blank(c("title")), "title").when(blank(c("requester")), "requester").when(bad(c("email")), "requester-email")
    own = own.when(c("_any").isNull(), "no-signer")
    later = F.when(c("_fields").isNull(), F.lit("no-field"))
    found = drafts.join(people, "request", "left").join(placed, "request", "left").withColumn("_own", own).withColumn("_later", later)
    problem = F.coalesce("_own", "_person.problem", "_later", "_idle.problem")
    signer = F.when(c("_own").isNull() & c("_person").isNotNull(), c("_person.signer")).when(c("_own").isNull() & c("_later").isNull(), c("_idle.signer"))
    return found.select("request", problem.alias("problem"), signer.alias("signer"))
