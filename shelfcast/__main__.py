"""Command line: look at a sales file, or train on it and write the results.

    python -m shelfcast report sales.csv
    python -m shelfcast features sales.csv
    python -m shelfcast train sales.csv results
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from shelfcast.operators import features
from shelfcast.operators.features import FeatureSpec
from shelfcast.plans.processor import SalesProcessor
from shelfcast.plans.trainer import ForecastTrainer
from shelfcast.session import build_session


def report(processor: SalesProcessor) -> None:
    for name, value in processor.get_data_quality_report().items():
        print(f"{name}: {value}")
    processor.get_daily_series().show(3)


def show_features(processor: SalesProcessor) -> None:
    spec = FeatureSpec()
    matrix = features.build_features(processor.get_daily_series(), spec)
    print(f"{len(spec.names)} features: {', '.join(spec.names)}")
    marked = features.chronological_split(matrix)
    marked.groupBy("split").agg(F.min("Date"), F.max("Date"), F.count("*").alias("rows")).show()


def train(processor: SalesProcessor, out: str) -> None:
    trainer = ForecastTrainer(processor.get_daily_series())
    trainer.save_artifacts(f"{out}/model", f"{out}/forecast", f"{out}/comparison")
    trainer.train_and_evaluate().show(truncate=False)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfcast", description="Retail demand analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("report", "features", "train"):
        command = commands.add_parser(name)
        command.add_argument("sales", help="sales file or folder of files")
        if name == "train":
            command.add_argument("out", help="folder for model, forecast and comparison")
    chosen = parser.parse_args(arguments)
    processor = SalesProcessor(build_session(), chosen.sales)
    if chosen.command == "report":
        report(processor)
    elif chosen.command == "features":
        show_features(processor)
    else:
        train(processor, chosen.out)


if __name__ == "__main__":
    main()
