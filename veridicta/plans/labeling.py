"""Labels for a table of sentences from an external labeler, in batches that a stopped run goes on behind."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.operators import corpus, labels
from veridicta.sources import tables
from veridicta.streaming.scorers import label_batches


def label_table(sentences: DataFrame, path: str, labeler: tables.Labeler, field: str = "topic", default: str = "Non_ESG", last: str = "section_title", batch: int = 2000) -> int:
    """Prompts each sentence, parses the reply and appends (sent_id, llm_label, llm_confidence, llm_reason) to ``path``."""

    def label(part: DataFrame) -> DataFrame:
        asked = part.withColumn("prompt", corpus.prompt("Muc" if last == "section_title" else "Chu de", F.col(last)))
        got = tables.label_with(asked, labeler)
        a, b, c = labels.parse_reply(F.col("reply"), field, default)
        return got.select("sent_id", a.alias("llm_label"), b.alias("llm_confidence"), c.alias("llm_reason"))

    return label_batches(sentences, label, path, batch)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--task", choices=("topic", "action"), default="topic")
    p.add_argument("--url", required=True)
    p.add_argument("--key-variable", default="LABELER_KEY", help="environment variable that holds the key")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("claim-labeling").getOrCreate()
    field, default, last = ("topic", "Non_ESG", "section_title") if a.task == "topic" else ("action", "Indeterminate", "topic_label")
    label_table(tables.read_table(spark, a.input), a.output, tables.http_labeler(a.url, os.environ[a.key_variable]), field, default, last)


if __name__ == "__main__":
    main()
