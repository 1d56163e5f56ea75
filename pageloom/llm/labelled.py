"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: str = "true") -> DataFrame:
    """At most ``rows`` documents with a label, as ``text`` and ``label`` (0 or 1), the same ones in every run.

    ``learn`` is SQL over doc_id for the rows that may be learnt from. The ids are drawn by hash from the label table
    alone, so the documents are only joined with a list of bounded size. Labels other than 0 and 1 do not count.
    """
    drawn = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(f"label in (0, 1) and doc_id is not null and {learn}")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")
