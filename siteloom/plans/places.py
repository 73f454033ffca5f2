"""Queries on approximate placement by seeds. The queried rows are those of an id divisible by 50, held against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seeds
from .queries import query
from .virtual import table

_PART = "substr(text, CAST(1 + doc_id * 7 % greatest(length(text) - 199, 1) AS INT), 200)"


def _both(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    asked = table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), F.expr(_PART).alias("seq"))
    return asked, docs


@query(f"""SELECT id, doc_id AS target, unnest(list_filter(range(0, length(text) - length(part) + 1), lambda i: substr(text, i + 1, length(part)) = part)) AS place
  FROM (SELECT doc_id AS id, {_PART} AS part FROM documents WHERE doc_id % 50 = 0) q JOIN documents ON contains(text, part) WHERE length(part) >= 24""")
def seed_exact_places(spark, d):
    return seeds.exact_places(*_both(spark, d))


@query()
def seed_places(spark, d):
    """Places of 30 % of a part's seeds or more: copies, near copies and repeated passages."""
    return seeds.placed(*_both(spark, d), strands=False).select("id", "target", "first", "last", "n", F.round("share", 6).alias("share"))
