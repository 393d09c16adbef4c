"""Skeleton counts over a stream of documents: the batch plan, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.operators import extract, signature


def stream_counts(docs: DataFrame) -> DataFrame:
    """Running triples of a streaming ``docs(collection, doc)``; state is a row
    per distinct structure, however many documents pass. For output modes
    complete and update."""
    text = F.to_json("doc") if dict(docs.dtypes)["doc"] == "variant" else F.col("doc")
    dated = docs.withColumn("ts", extract.oid_seconds(F.get_json_object(text, "$['_id']['$oid']")))
    return extract.skeleton_counts(signature.signatures(dated), F.col("ts"))
