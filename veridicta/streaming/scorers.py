"""Scorers behind one interface (a frame in, a frame with more columns out), with offline stand-ins that always give the
same result, and incremental labeling that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import dbl, once, softmax
from veridicta.operators.labels import not_yet, wants_label
from veridicta.operators.linking import nli_decision, with_nli_fallback
from veridicta.plans.shipping import ship

DIMENSIONS = 64
SMALL = 100_000  # rows that one task may order
PIECE = 20_000  # rows of a batch that one task brings together


def hashed_embeddings(df: DataFrame, text: str = "sentence", dimensions: int = DIMENSIONS) -> DataFrame:
    """Signed hashed counts of the words; stands in for a sentence encoder."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    zero = F.array_repeat(dbl(0), dimensions)
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, dbl(1)).otherwise(dbl(-1))
    marked = F.transform(words, lambda w: F.struct(place(w).alias("p"), sign(w).alias("s")))
    sums = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(m, lambda x: x["p"] == i), dbl(0), lambda s, x: s + x["s"]))
    vector = once(marked, sums)
    return df.withColumn("embedding", F.when(F.size(words) > 0, vector).otherwise(zero))


def model_scorer(load: Callable, classes: int, text: str = "sentence") -> Callable[[DataFrame], DataFrame]:
    """A scorer from ``load() -> (list of texts -> rows of logits)``, loaded once a worker, 64 texts at a time."""

    def score(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)

        def run(parts):
            predict = load()
            for p in parts:
                texts = p[text].fillna("").tolist()
                rows = [r for i in range(0, len(texts), 64) for r in predict(texts[i : i + 64])]
                yield p.assign(logits=[list(map(float, r))[:classes] for r in rows])

        return df.mapInPandas(run, df.withColumn("logits", F.array(dbl(0))).schema)

    return score


def nli_scorer(load: Callable, batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An entailment scorer of pairs from ``load() -> (list of (evidence, claim) -> rows of contradiction, neutral and
    entailment logits)``, loaded once a worker, ``batch`` pairs at a time.  A batch that fails is neutral."""

    def score(pairs: DataFrame) -> DataFrame:
        ship(pairs.sparkSession)

        def run(parts):
            predict = load()
            for p in parts:
                both = list(zip(p["evidence_text"].fillna(""), p["claim_text"].fillna(""), strict=True))
                rows: list = []
                for i in range(0, len(both), batch):
                    try:
                        rows += [list(map(float, r)) for r in predict(both[i : i + batch])]
                    except Exception:  # whatever a model raises
                        rows += [[]] * len(both[i : i + batch])
                yield p.assign(__failed=[not r for r in rows], __logits=[r or [0.0] * 3 for r in rows])

        d = pairs.mapInPandas(run, pairs.withColumns({"__failed": F.lit(False), "__logits": F.array(dbl(0))}).schema)
        d = d.withColumn("__p", softmax(F.col("__logits"))).withColumns({n: F.col("__p")[i] for i, n in enumerate(("contradiction", "neutral", "entailment"))})
        label = F.when(~F.col("__failed"), nli_decision(F.col("contradiction"), F.col("neutral"), F.col("entailment")))
        return with_nli_fallback(d.withColumn("nli_label", label)).drop("__failed", "__logits", "__p")

    return score


def nli_pair(spark, evidence: str, claim: str, scorer: Callable[[DataFrame], DataFrame]):
    """The scores of one pair."""
    d = scorer(spark.createDataFrame([(evidence, claim)], "evidence_text string, claim_text string"))
    return d.select("nli_label", "entailment", "contradiction", "neutral").first()


def train_surrogate(df: DataFrame, label_id: str = "label_id", text: str = "text", weight: str | None = None, features: int = 1 << 14, seed: int = 42):
    """TF-IDF and logistic regression in place of a fine-tuned encoder; returns a fitted model with probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    lr = LogisticRegression(featuresCol="features", labelCol=label_id, maxIter=30, regParam=1e-3)
    if weight:
        lr = lr.setWeightCol(weight)
    stages = [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"(?U)\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), lr]
    return Pipeline(stages=stages).fit(df)


def surrogate_logits(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("logits", vector_to_array("rawPrediction"))
    return out.drop("words", "tf", "features", "rawPrediction", "probability")


def _done(spark, path: str) -> DataFrame | None:
    """sent_id of what has been written; None where nothing has.  Any other failure to read is an error."""
    try:
        return spark.read.parquet(path).select("sent_id")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def label_batches(df: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, batch: int = 2000) -> int:
    """Label what isn't in ``path`` yet, about ``batch`` rows at a time, each appended when done; returns how many
    batches ran.  What is to be done is found once and laid out by batch beside ``path``, so each batch reads only its
    own rows.  A run that stops loses its last batch only: the anti-join on sent_id leaves out what is there."""
    spark = df.sparkSession
    done, todo = _done(spark, path), wants_label(df)
    if done is not None:
        todo = not_yet(todo, done)
    n = todo.count()
    if not n:
        return 0
    batches = -(-n // batch)
    staged = f"{path.rstrip('/')}_todo"
    by_rows = F.ntile(batches).over(W.orderBy("sent_id")) - 1 if n <= SMALL else F.pmod(F.xxhash64("sent_id"), F.lit(batches))
    # a batch's rows are brought together first: else each task writes a file for each batch
    pieces = F.pmod(F.xxhash64("sent_id", F.lit(1)), F.lit(-(-batch // PIECE)))
    todo.withColumn("__batch", by_rows).repartition("__batch", pieces).write.mode("overwrite").partitionBy("__batch").parquet(staged)
    schema = todo.schema
    ran = 0
    for k in range(batches):
        part = spark.read.schema(schema).parquet(f"{staged}/__batch={k}") if _has(spark, f"{staged}/__batch={k}") else None
        if part is not None:
            label(part).write.mode("append").parquet(path)
            ran += 1
    return ran


def _has(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def label_stream(stream: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, known: DataFrame | None = None, within: tuple[str, str] | None = None):
    """The same over a stream of sentences; each sent_id is labelled once.

    Which ids have come before is kept in the state store, by partitions of sent_id, so a micro-batch looks up its own ids
    and reads nothing that was written.  ``within``, (a column of times, how late), lets the state forget ids older than
    that.  A micro-batch has its own folder, ``path``/batch=<number>, that a replay writes anew: nothing is there twice.
    ``known``: ids with labels from elsewhere, such as ``label_batches`` wrote, which are left out.  Rows without an id count
    as one."""
    todo = wants_label(stream)
    if known is not None:
        todo = not_yet(todo, known)
    todo = todo.withWatermark(*within).dropDuplicatesWithinWatermark(["sent_id"]) if within else todo.dropDuplicates(["sent_id"])

    def step(part: DataFrame, batch: int) -> None:
        label(part).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return todo.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
