"""Command line: ``python -m tessera train|optimize|optimize-all|inference|list-models|query``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tessera.models import registry, spaces, study
from tessera.plans import catalog, inference
from tessera.sources import artifacts, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "optimize", "optimize-all", "inference"):
        c = sub.add_parser(name)
        c.add_argument("--data", required=True, help="folder of the tables")
        c.add_argument("--model", required=True, help="folder of the model")
        if name in ("train", "optimize"):
            c.add_argument("--model-type", default="logistic", choices=sorted(registry.FAMILIES if name == "train" else spaces.TRAINABLE))
        if name == "optimize-all":
            c.add_argument("--model-types", nargs="*", default=sorted(spaces.TRAINABLE), choices=sorted(spaces.TRAINABLE))
        if name.startswith("optimize"):
            c.add_argument("--trials", type=int, default=10)
            c.add_argument("--metric", default="harmonic_avg/AUROC")
            c.add_argument("--parallel", type=int, default=1)
        if name != "inference":
            c.add_argument("--resume", action="store_true", help="take up what is in the folder")
        if name == "inference":
            c.add_argument("--out", required=True, help="folder for predictions, tables and the report")
            c.add_argument("--rows", help="text file of the cells to score, an id a line")
    sub.add_parser("list-models")
    c = sub.add_parser("query")
    c.add_argument("name", choices=sorted(catalog.QUERIES))
    c.add_argument("--data", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-models":
        for name, family in registry.FAMILIES.items():
            print(f"{name}\t{family}")
        return 0
    spark = session()
    if a.command == "query":
        catalog.QUERIES[a.name](spark, a.data).show(truncate=False)
        return 0
    counts, cells, genes = tables.counts(spark, a.data), tables.cells(spark, a.data), tables.genes(spark, a.data)
    if a.command == "train":
        trained, found = inference.train(spark, a.model_type, counts, genes, cells, path=f"{a.model}/training" if a.resume else None, resume=a.resume)
        inference.save(trained, a.model)
        print(json.dumps(found, sort_keys=True))
    elif a.command.startswith("optimize"):
        inference.require_metric(a.metric.rpartition("/")[2])
        every = a.command == "optimize-all"
        for family in a.model_types if every else [a.model_type]:  # one after another; trials of one may run in parallel
            path = f"{a.model}/{family}" if every else a.model
            print(json.dumps(study.optimize(spark, path, family, counts, genes, cells, a.trials, a.metric, resume=a.resume, parallel=a.parallel), sort_keys=True))
    else:
        trained = inference.load(spark, a.model)
        if a.rows:
            cells = cells.join(artifacts.selector(spark, a.rows), "cell_id", "left_semi")
        found = inference.evaluate_and_save(spark, trained, counts, cells, a.out, "inference")
        print(json.dumps({"model_type": trained.model_type, "metrics": found.metrics}, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
