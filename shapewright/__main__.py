"""spark-submit entry: documents or a graph to a model file.

python -m shapewright --name shop --input customers=/data/customers.json --output /models
python -m shapewright --kind graph --name shop --nodes /data/nodes --edges /data/edges --output /models"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from shapewright.operators import extract, graph, model
from shapewright.sources import documents, xmi
from shapewright.tables import clean


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--kind", choices=("documents", "graph"), default="documents")
    p.add_argument("--name", required=True, type=documents.check_name)
    p.add_argument("--input", action="append", default=[], help="collection=path of JSON lines; may be repeated")
    p.add_argument("--nodes", help="Parquet of (id, label, props map of type names)")
    p.add_argument("--edges", help="Parquet of (src, dst, type, props)")
    p.add_argument("--sampling", type=float, default=1.0, help="share of a graph's nodes that is read")
    p.add_argument("--intermediate", help="where a graph's counted shapes are written as JSON")
    p.add_argument("--output", required=True, help="folder on the driver's machine")
    p.add_argument("--profile", choices=("faithful", "corrected"), default="corrected")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("shapewright").getOrCreate()
    if a.kind == "graph":
        made = graph.graph_model(documents.sampled(spark.read.parquet(a.nodes), a.sampling), spark.read.parquet(a.edges), a.name, a.intermediate)
    else:
        docs = documents.collections([documents.json_collection(spark, path, name) for name, path in (x.split("=", 1) for x in a.input)])
        triples = extract.triples_of_json(docs)
        at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("collection", "first_ts", "signature"))  # a row per distinct structure
        made = model.infer_model(triples.select(at.alias("ord"), "signature", "count", "first_ts", "last_ts"), a.name, a.profile)
    xmi.write(made, f"{a.output}/{a.name}.xmi")
    clean(spark)


if __name__ == "__main__":
    main()
