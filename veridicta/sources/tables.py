"""Reading and writing: texts with bank and year, tables by suffix, report files, settings, model folders, labelers."""

from __future__ import annotations

import copy
import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.operators.corpus import bank_year
from veridicta.plans.shipping import ship


DEPTH = 4  # of a bank's folder below the path
FILE_ROWS = 10_000  # of a CSV file


def _bank_folders(spark: SparkSession, path: str, banks: Sequence[str]) -> list[str]:
    """The folders of some banks, at any depth up to ``DEPTH``, or the path itself if it is one's."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    top = path.rstrip("/")
    for b in banks:
        if top.rsplit("/", 1)[-1] == b:
            found.append(top)
        for level in range(DEPTH):
            p = hadoop.Path(f"{top}/{'*/' * level}{b}")
            found += [s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or () if s.isDirectory()]
    return list(dict.fromkeys(found))


def read_texts(spark: SparkSession, path: str, banks: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, bank, year, path, content) of a .txt file, or of all under a folder, in the order of paths; of some banks
    or years only, where these are given: other banks' folders and other years' files are not opened.

    Bytes that aren't UTF-8 are left out.  Another suffix, or nothing to read, is an error."""
    ship(spark)
    if banks is not None:
        folders = _bank_folders(spark, path, banks)
        if not folders:
            raise FileNotFoundError(f"no folder of {', '.join(banks)} in {path}")
    else:
        folders = [path]
    # the year is the first in the name; 0 stands for none
    names = "*.txt" if years is None or 0 in years else "*{" + ",".join(str(y) for y in years) + "}*.txt"
    one = path.lower().endswith(".txt")
    if not one and "." in path.rstrip("/").rsplit("/", 1)[-1] and not path.endswith("/"):
        raise ValueError(f"not a text file: {path}")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folders)
    if raw.isEmpty():
        raise FileNotFoundError(f"no .txt files in {path}")

    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    bank, year, stem = bank_year(F.col("path"))
    d = raw.select(bank.alias("bank"), year.alias("year"), stem.alias("stem"), "path", decode("content").alias("content"))
    if banks is not None:
        d = d.where(F.col("bank").isin(*banks))
    if years is not None:
        d = d.where(F.col("year").isin(*years))
    return d.select(F.concat_ws("_", "bank", F.col("year").cast("string"), "stem").alias("doc_id"), "bank", "year", "path", "content")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


def write_parquet(df: DataFrame, path: str, by_document: bool = False) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy("bank", "year") if by_document else w).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Everything in quotes, since sentences hold line feeds; arrays joined by |.  Records with line feeds can't be split, so a
    file is read by one task: it has ``FILE_ROWS`` rows at most, however large the table is.  ``one_file`` is for summaries:
    one task writes it."""
    flat = [F.concat_ws("|", c).alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    d = df.select(*flat)
    w = d.coalesce(1).write if one_file else d.write.option("maxRecordsPerFile", FILE_ROWS)
    w.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_text(text: str, path: str) -> None:
    """A small file on any file system that Spark reaches.  It is written under another name in its folder and renamed
    when it is whole, so that readers see the old file or the new one."""
    spark = SparkSession.active()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    part = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(part, target, over)


def read_text(path: str) -> str:
    """A small file of any file system that Spark reaches."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    opened = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode("utf-8")
    finally:
        opened.close()


def save_report(report: dict, scores: DataFrame, claims: DataFrame, details: DataFrame, folder: str) -> None:
    from veridicta.operators.report import as_json, text

    write_text(as_json(report), f"{folder}/report.json")
    write_text(text(report), f"{folder}/summary.txt")
    write_csv(scores, f"{folder}/bank_year_scores.csv", one_file=True)
    write_csv(claims, f"{folder}/top_risk_claims_global.csv", one_file=True)
    write_csv(details, f"{folder}/sentence_details.csv")


ANALYSIS_FILES = ("temporal_trends", "bank_ranking", "topic_summary", "evidence_type_importance", "formula_comparison")


def save_analyses(results: dict[str, DataFrame], folder: str) -> None:
    from veridicta.operators.report import _rows, markdown

    rows = {k: _rows(v) for k, v in results.items()}
    write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str), f"{folder}/analysis_results.json")
    write_text(markdown(rows), f"{folder}/analysis_report.md")
    for name in ANALYSIS_FILES:
        if name in results:
            write_csv(results[name], f"{folder}/{name}.csv", one_file=True)


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, dict by dict."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_settings(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def runtime_settings(settings: dict, task: str, profile: str | None = None) -> dict:
    """common, then the task's, then the profile's."""
    if task not in settings.get("tasks", {}):
        raise KeyError(f"no such task: {task}")
    out = merged(settings.get("common", {}), settings["tasks"][task])
    if profile:
        if profile not in settings.get("profiles", {}):
            raise KeyError(f"no such profile: {profile}")
        out = merged(out, settings["profiles"][profile])
    return out


def model_folder(path: str) -> str:
    """The folder itself, or its spelling with output(s)/ exchanged, or its final/ folder: the first that is there."""
    swap = path.replace("outputs/", "output/") if "outputs/" in path else path.replace("output/", "outputs/")
    for p in (path, swap):
        plain = p[: -len("/final")] if p.endswith("/final") else p
        for q in (p, plain, f"{plain}/final"):
            if Path(q).exists():
                return q
    raise FileNotFoundError(path)


Labeler = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def http_labeler(url: str, key: str, timeout: float = 30.0, header: str = "x-goog-api-key") -> Labeler:
    """Posts each prompt, with the key in a header; a failure becomes the reply ``error: ...`` of its row."""

    def run(parts):
        for p in parts:
            replies = []
            for prompt in p["prompt"]:
                try:
                    body = json.dumps({"contents": [{"parts": [{"text": prompt}]}]}).encode()
                    req = urllib.request.Request(url, body, {"Content-Type": "application/json", header: key})
                    replies.append(json.load(urllib.request.urlopen(req, timeout=timeout))["candidates"][0]["content"]["parts"][0]["text"])  # noqa: S310
                except Exception as e:
                    replies.append(f"error: {e}")
            yield p[["sent_id"]].assign(reply=replies)

    return run


def label_by_table(df: DataFrame, known: DataFrame) -> DataFrame:
    """The offline labeler: replies that a table holds."""
    return df.select("sent_id").join(known.select("sent_id", "reply"), "sent_id", "left")


def label_with(df: DataFrame, labeler: Labeler, partitions: int = 20) -> DataFrame:
    """(sent_id, prompt) -> (sent_id, reply), ``partitions`` at a time."""
    return df.select("sent_id", "prompt").repartition(partitions, "sent_id").mapInPandas(labeler, f"sent_id {df.select('sent_id').dtypes[0][1]}, reply string")
