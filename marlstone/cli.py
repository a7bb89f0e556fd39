"""Command lines of the two evaluations: python -m marlstone.cli extraction|models …"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from marlstone.models import NATIVE
from marlstone.operators import match
from marlstone.plans.evaluation import combine_pairs, evaluate_extraction, evaluate_models
from marlstone.sources import sinks, tables


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marlstone")
    commands = parser.add_subparsers(dest="command", required=True)
    extraction = commands.add_parser("extraction", help="extracted recommendations against ground truth")
    extraction.add_argument("-p", "--predictions", required=True)
    extraction.add_argument("-g", "--ground-truth", required=True)
    extraction.add_argument("-ni", "--non-interactive", action="store_true", help="write no candidates for adjudication")
    extraction.add_argument("-a", "--adjudications", help="CSV of row_id and choice from an earlier run")
    extraction.add_argument("-v", "--verbose", action="store_true")
    models = commands.add_parser("models", help="similarity models on scored sentence pairs")
    models.add_argument("-o", "--output", required=True)
    models.add_argument("-d", "--data", required=True, help="folder of TSV files")
    models.add_argument("-x", "--extra", help="Parquet with more pairs")
    models.add_argument("-v", "--verbose", action="store_true")
    models.add_argument("-t", "--testing", action="store_true")
    models.add_argument("-r", "--retrain", action="store_true")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    if got.command == "extraction":
        ext, gt = tables.read_recommendations(spark, got.predictions), tables.read_recommendations(spark, got.ground_truth)
        chosen = spark.read.csv(got.adjudications, header=True, schema="row_id bigint, choice string") if got.adjudications else None
        found = evaluate_extraction(ext, gt, dict((m.name, m.score) for m in NATIVE)["token_jaccard"], chosen)
        folder = os.path.dirname(got.predictions) or "."
        found.matches.cache()
        if got.verbose:
            found.matches.groupBy("match_stage").count().show()
        for row in sinks.metric_lines(found.metrics).orderBy("pos").collect():
            print(row.line)
        sinks.write_matches(found.matches, folder)
        sinks.write_missing(found.missing, folder)
        if not got.non_interactive:
            left = ext.join(found.matches.where("match_stage = 'none'").select("row_id"), "row_id", "left_semi")
            sinks.write_csv(match.fuzzy_top(left, gt), f"{folder}/candidates.csv")
    else:
        pairs = tables.read_pairs(spark, got.data)
        if got.extra:
            pairs = combine_pairs(pairs, tables.read_parquet(spark, got.extra))
        results, wide = evaluate_models(pairs, NATIVE, got.testing, got.retrain)
        if got.verbose:
            results.show()
        sinks.write_model_results(results, got.output)
        sinks.write_scores(wide, got.output)


if __name__ == "__main__":
    main()
