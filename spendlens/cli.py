"""Stage-by-stage command line over ``plans.stages``.

    python -m spendlens.cli land    --root R --csv 'raw/crs_{year}.csv' --years 2015 2024
    python -m spendlens.cli prepare --root R
    python -m spendlens.cli label   --root R --taxonomy continuum --classifier my.module:make_client [--max-cost 50]
    python -m spendlens.cli label   --root R --keywords rules.json      # deterministic dry run, no model
    python -m spendlens.cli merge   --root R --taxonomy continuum
    python -m spendlens.cli report  --root R --taxonomy continuum
    python -m spendlens.cli export  --root R --taxonomy continuum --table selected

The session comes from ``spark-submit`` (or a local one when run directly);
``spark.checkpoint.dir`` must name a shared folder on a cluster. The module
named by ``--classifier`` runs on the executors: ship it with ``--py-files``.
"""

from __future__ import annotations

import argparse
import importlib
import json
from functools import partial

from pyspark.sql import SparkSession

from spendlens.operators.label import KeywordClassifier
from spendlens.plans import stages as pl
from spendlens.session import configure
from spendlens.taxonomy import TAXONOMIES, Taxonomy


def _factory(spec: str):
    module, _, attr = spec.partition(":")
    return getattr(importlib.import_module(module), attr)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="spendlens")
    ap.add_argument("stage", choices=["land", "prepare", "label", "merge", "report", "export"])
    ap.add_argument("--table", choices=["merged", "selected"], default="merged", help="table to export as CSV (export)")
    ap.add_argument("--root", required=True, help="output root (shared file system)")
    ap.add_argument("--taxonomy", choices=sorted(TAXONOMIES), default="continuum")
    ap.add_argument("--taxonomy-file", help="JSON taxonomy (see Taxonomy.from_json) instead of a shipped one")
    ap.add_argument("--csv", help="yearly CSV path pattern with a {year} slot (land)")
    ap.add_argument("--years", nargs=2, type=int, metavar=("FIRST", "LAST"), help="inclusive year range (land)")
    ap.add_argument("--single-line", action="store_true", help="CSV has no quoted newlines: read files in parallel splits (land)")
    ap.add_argument("--classifier", help="module:factory returning a classifier (label)")
    ap.add_argument("--keywords", help="JSON file {class: [keywords]}: keyword classifier instead of a model (label)")
    ap.add_argument("--max-cost", type=float, help="refuse to label above this estimated price")
    ap.add_argument("--sample-size", type=int, help="trial run on the first N texts with the sector codes")
    ap.add_argument("--texts-per-task", type=int, default=500)
    ap.add_argument("--concurrency", type=int, default=1)
    a = ap.parse_args(argv)

    spark = configure(SparkSession.builder.appName(f"spendlens-{a.stage}").getOrCreate())
    layout = pl.Layout(a.root.rstrip("/"))
    tax = Taxonomy.from_json(a.taxonomy_file) if a.taxonomy_file else TAXONOMIES[a.taxonomy]
    out: dict = {"stage": a.stage}
    if a.stage == "land":
        if not (a.csv and a.years):
            ap.error("land needs --csv and --years")
        pl.land_yearly_csv(spark, a.csv, range(a.years[0], a.years[1] + 1), layout, multi_line=not a.single_line)
    elif a.stage == "prepare":
        out["funnel"] = pl.prepare(spark, layout)
    elif a.stage == "label":
        if a.keywords:
            with open(a.keywords) as f:
                rules = json.load(f)
            factory = partial(KeywordClassifier, rules)
        elif a.classifier:
            factory = _factory(a.classifier)
        else:
            ap.error("label needs --classifier or --keywords")
        out["labelled"] = pl.label(
            spark, layout, tax, factory, max_cost=a.max_cost, sample_size=a.sample_size,
            texts_per_task=a.texts_per_task, concurrency=a.concurrency,
        )
    elif a.stage == "merge":
        pl.merge(spark, layout, tax)
    elif a.stage == "report":
        out["reports"] = {k: [r.asDict() for r in v.collect()] for k, v in pl.report(spark, layout, tax).items()}
    else:
        out["path"] = pl.export_csv(spark, layout, tax, a.table)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
