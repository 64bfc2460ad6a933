"""The stages in order, from texts, classified sentences or linked evidence to scores, analyses and report."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.packs import ACTION_RULES, EVIDENCE, KPI_VALUES, TOPIC_RULES
from veridicta.operators import analyses, corpus, evidence, labels, linking, quality, report, risk, rules, vectors
from veridicta.sources import tables
from veridicta.streaming.scorers import hashed_embeddings


class ClaimPipeline:
    """Rule packs and scorers are parameters; every stage is a lazy frame, written only where ``folder`` is given."""

    def __init__(self, spark: SparkSession, folder: str | None = None, topics=TOPIC_RULES, actions=ACTION_RULES, pack=EVIDENCE, kpis=KPI_VALUES, variant: linking.Variant = linking.VARIANTS[0], nli=linking.lexical_nli, encoder=hashed_embeddings):
        self.spark, self.folder, self.topics, self.actions, self.pack, self.kpis, self.variant, self.nli, self.encoder = spark, folder, topics, actions, pack, kpis, variant, nli, encoder

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return df
        path = f"{self.folder}/{name}.parquet"
        tables.write_parquet(df, path)
        return self.spark.read.parquet(path)

    def build_corpus(self, path: str) -> DataFrame:
        """Sentences; with a folder also their quality figures, without the marks behind them."""
        blocks = corpus.build_blocks(tables.read_texts(self.spark, path))
        self._keep(blocks, "blocks")
        sentences = self._keep(corpus.build_sentences(blocks), "sentences")
        if self.folder:
            quality_job(sentences, self.folder)
        return sentences

    def classify(self, sentences: DataFrame) -> DataFrame:
        d = labels.esg_subset(rules.match_topics(sentences, rules=self.topics))
        return self._keep(rules.match_actions(d, rules=self.actions), "classified")

    def find_evidence(self, classified: DataFrame) -> DataFrame:
        d = classified.withColumn("text", F.col("sentence")) if "text" not in classified.columns else classified
        d = evidence.detect(d, pack=self.pack, kpis=self.kpis)
        if "sent_pos" not in d.columns:
            d = corpus.text_position(d)
        if "embedding" not in d.columns:
            d = self.encoder(d)
        return self._keep(linking.link(d, self.variant, scorer=self.nli), "evidence")

    def score(self, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        scored = self._keep(risk.enrich(linked, self.pack), "scored")
        return scored, risk.bank_years(scored)

    def run(self, path: str | None = None, classified: DataFrame | None = None, linked: DataFrame | None = None) -> dict:
        """From the furthest stage given: linked evidence, classified sentences, or a path of texts."""
        if linked is None:
            if classified is None:
                if path is None:
                    raise ValueError("nothing to start from")
                classified = self.classify(self.build_corpus(path))
            linked = self.find_evidence(classified)
        scored, scores = self.score(linked)
        flat = risk.rounded(scores)
        out = {"scored": scored, "scores": flat, "analyses": analyses.run_all(scored, flat)}
        if self.folder:
            tables.save_analyses(out["analyses"], f"{self.folder}/analysis")
            tables.save_report(report.build(scored, scores, with_analyses=False), flat, report.top_claims(scored), risk.sentence_risks(scored), f"{self.folder}/reports")
        return out


def fitted_vectors(df: DataFrame) -> DataFrame:
    """An encoder: vectors fitted on the sentences themselves."""
    return vectors.embed(df, vectors.fit(df))


def quality_job(sentences: DataFrame, folder: str, label: str | None = None, key: str = "sent_id", exact: bool = False, keep: bool = False) -> DataFrame:
    """Length, near-duplicate and OCR checks of a table of sentences: the report goes to quality.csv, the balance of
    ``label`` to balance.csv and, with ``keep``, the marked sentences to checked.parquet; returns these.  ``exact``: by the
    sequential rule for duplicates."""
    checked = quality.run_checks(sentences, key, exact=exact)
    if keep:
        tables.write_parquet(checked, f"{folder}/checked.parquet")
        checked = sentences.sparkSession.read.parquet(f"{folder}/checked.parquet")
    tables.write_csv(quality.report(checked), f"{folder}/quality.csv", one_file=True)
    if label:
        tables.write_csv(quality.class_balance(sentences, label), f"{folder}/balance.csv", one_file=True)
    return checked


def run_variants(df: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """All linking variants over the same candidates' frame, and their summary."""
    linked = linking.link_all(df, **kw)
    out = linking.summarize(linked)
    if folder:
        tables.write_parquet(linked, f"{folder}/evidence_variants.parquet")
        tables.write_csv(out, f"{folder}/evidence_variant_summary.csv", one_file=True)
    return out


def legacy_run(df: DataFrame, folder: str) -> None:
    tables.write_csv(risk.legacy_bank_years(df), f"{folder}/legacy_scores.csv", one_file=True)
    tables.write_csv(risk.legacy_topics(df), f"{folder}/legacy_topics.csv", one_file=True)
    tables.write_csv(risk.legacy_top_claims(df), f"{folder}/legacy_top_claims.csv", one_file=True)
    tables.write_csv(risk.legacy_claims(df), f"{folder}/legacy_sentences.csv")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", help="folder of texts, or a table of classified or linked sentences")
    p.add_argument("--output", default="outputs")
    p.add_argument("--start", choices=("texts", "classified", "linked"), default="texts")
    p.add_argument("--variant", choices=[v.name for v in linking.VARIANTS], default="nli")
    p.add_argument("--encoder", choices=("fitted", "hashed"), default="fitted", help="sentence vectors where the table has none")
    p.add_argument("--job", choices=("run", "quality", "variants", "legacy"), default="run", help="all stages; or, of a table: checks of its sentences, all linking variants, the earlier scores")
    p.add_argument("--label", help="for quality: whose balance to report")
    p.add_argument("--exact", action="store_true", help="for quality: duplicates by the sequential rule")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("claim-risk").getOrCreate()
    encoder = fitted_vectors if a.encoder == "fitted" else hashed_embeddings
    if a.job == "quality":
        quality_job(tables.read_table(spark, a.input), a.output, a.label, exact=a.exact, keep=True)
        return
    if a.job == "variants":
        d = tables.read_table(spark, a.input)
        d = d if "sent_pos" in d.columns else corpus.text_position(d)
        run_variants(d if "embedding" in d.columns else encoder(d), a.output)
        return
    if a.job == "legacy":
        legacy_run(tables.read_table(spark, a.input), a.output)
        return
    pipeline = ClaimPipeline(spark, a.output, variant=next(v for v in linking.VARIANTS if v.name == a.variant), encoder=encoder)
    if a.start == "texts":
        pipeline.run(a.input)
    else:
        pipeline.run(**{a.start: tables.read_table(spark, a.input)})


if __name__ == "__main__":
    main()
