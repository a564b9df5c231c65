"""Command line: resolve a file of addresses with a folder of reference data."""

from __future__ import annotations

import argparse
import os
import sys

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("waymark")
    p.add_argument("--input-path", "-i", default="", help=".txt, .csv, .tsv, .geojson or a folder of features")
    p.add_argument("--output-path", "-o", default="", help=".csv, .tsv or .json")
    p.add_argument("--batch-size", type=int, default=1024, help="rows of an Arrow batch; not positive: the default")
    p.add_argument("--resources-dir", default="resources", help="folder of reference data")
    p.add_argument("--model-dir", default="", help="folder with a model, its config and CRF parameters; without one no model runs")
    p.add_argument("--verbose", "-v", action="store_true", help="match lists, spans, predictions and IBANs too")
    p.add_argument("--version", action="store_true")
    return p


def load_model(spark, folder: str):
    """The model runner of a folder: address_transformer.onnx, address_transformer.config.json, address_crf.json."""
    from .operators import seqmodel, tagging
    from .sources import readers as R

    config, crf = R.read_json(spark, os.path.join(folder, "address_transformer.config.json")), R.read_json(spark, os.path.join(folder, "address_crf.json"))
    size = int(config.get("max_sequence_length") or 224)
    provider = seqmodel.onnx_provider(os.path.join(folder, "address_transformer.onnx"), list(config["vocabulary"]), size)
    countries = config.get("id_to_country") or []
    countries = [countries[k] for k in sorted(countries, key=int)] if isinstance(countries, dict) else list(countries)
    tags = [(bio, tag) for bio, tag in R.read_tags(config.get("bio_tags") or config["tags"])]
    return tagging.ModelRunner(provider, R.read_crf(crf), tags, countries, size, bool(config.get("strict_before_inside", True)))


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.version:
            print(VERSION)
            return 0
        out = a.output_path.lower()
        if not a.input_path or not a.output_path:
            raise ValueError("input path and output path are required")
        if not out.endswith((".csv", ".tsv", ".json")):
            raise ValueError(f"no writer for {a.output_path}")
        name = a.input_path.rstrip("/").rsplit("/", 1)[-1].lower()
        if "." in name and not name.endswith((".txt", ".csv", ".tsv", ".geojson")):
            raise ValueError(f"no reader for {a.input_path}")
    except SystemExit as e:
        return 2 if e.code else 0
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import resolve as R
    from .operators.gazetteer import ReferenceData
    from .settle import release, settle
    from .sources import readers, sinks

    spark = SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size if a.batch_size > 0 else 1024))
    try:
        ref = ReferenceData.load(spark, a.resources_dir)
        held: list[str] = []
        addresses = settle(readers.numbered(readers.read_addresses(spark, a.input_path)), "input", held)
        rows = R.clean_addresses(addresses)
        probabilities = predictions = None
        if a.model_dir:
            rows, probabilities = load_model(spark, a.model_dir).tag(rows)
            predictions = rows.select("addr_id", F.explode("predictions").alias("p")).select("addr_id", "p.tag", "p.text", "p.confidence")
        countries, towns = R.match_all(rows, ref, probabilities=probabilities, held=held)
        combos = R.combinations(countries, towns, rows, ref.same_name)
        if out.endswith(".json"):
            shown = R.structured(combos, rows)
        else:
            shown = sinks.readable(combos, rows)
        if a.verbose:
            none = spark.createDataFrame([], "addr_id long, tag string, text string, confidence double")
            tagged = rows if a.model_dir else rows.withColumn("head", F.struct(F.lit("").alias("country"), F.lit(0.0).alias("confidence"))).withColumn("spans", F.array().cast("array<string>"))
            shown = sinks.verbose(shown, predictions if predictions is not None else none, countries, towns, tagged)
        shown = shown.orderBy("addr_id").drop("addr_id")
        if out.endswith(".json"):
            sinks.write_json(shown, a.output_path)
        else:
            sinks.write_table(shown, a.output_path, "\t" if out.endswith(".tsv") else ",")
        shown.held = held
        release(shown)
    except Exception as e:  # the command reports any failure by its status
        print(e, file=sys.stderr)
        return 1
    return 0
