"""Integrity audit of a graph: terms in places where RDF does not allow them, missing terms, ids of two terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T


def audit(quads: DataFrame) -> dict:
    """Counts for each position, in one pass, and whether the graph is clean."""
    s = T.id_of(F.col("s__k"), F.col("s__x"), F.lit(""), F.lit(""))
    p = T.id_of(F.lit(T.IRI), F.col("p__x"), F.lit(""), F.lit(""))
    o = T.id_of(F.col("o__k"), F.col("o__x"), F.col("o__d"), F.col("o__l"))
    dangling = lambda i, x, key: F.count_if(x.isNull() | (i != key))
    row = quads.agg(
        F.count(F.lit(1)).alias("quads"),
        F.count_if(F.col("s__k") == T.LITERAL).alias("subject_literal"),
        F.count_if(~F.rlike("p__x", F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))).alias("predicate_illegal"),
        dangling(F.col("s"), F.col("s__x"), s).alias("subject_dangling"),
        dangling(F.col("p"), F.col("p__x"), p).alias("predicate_dangling"),
        dangling(F.col("o"), F.col("o__x"), o).alias("object_dangling"),
    ).first().asDict()
    row["illegal_terms"] = row["subject_literal"] + row["predicate_illegal"]
    row["dangling_refs"] = row["subject_dangling"] + row["predicate_dangling"] + row["object_dangling"]
    row["colliding_ids"] = T.collisions(quads).count()
    row["clean"] = not (row["illegal_terms"] or row["dangling_refs"] or row["colliding_ids"])
    return row
