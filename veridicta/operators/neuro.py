"""Rules as soft constraints: fuzzy truth, rule probabilities, fusion with a model's, and the semantic losses."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import arg_max, dbl, free, log_softmax, re_, softmax
from veridicta.functions.packs import ACTION_NEGATIONS, ACTION_RULES, ACTIONS, TOPIC_RULES, TOPICS, Rule
from veridicta.functions.patterns import Patterns
from veridicta.operators.labels import f1_summary
from veridicta.plans.shipping import ship

EPS = 1e-7


class Constraint(NamedTuple):
    name: str
    kind: str  # exactly_one, implication, negation
    target: str | None
    source: str
    rule: Rule | None


class KnowledgeBase(NamedTuple):
    labels: tuple[str, ...]
    constraints: tuple[Constraint, ...]

    @property
    def rules(self):
        return [c for c in self.constraints if c.rule is not None]


def knowledge_base(task: str = "topic", labels=None, rules=None, negations=None) -> KnowledgeBase:
    labels = tuple(labels or (TOPICS if task == "topic" else ACTIONS))
    rules = rules if rules is not None else (TOPIC_RULES if task == "topic" else ACTION_RULES)
    negations = negations if negations is not None else (ACTION_NEGATIONS if task == "action" else ())
    out = [Constraint("exactly_one", "exactly_one", None, "Classification axiom: single-label constraint", None)]
    order = list(dict.fromkeys(r.label for r in rules))
    out += [Constraint(f"impl_{r.name}_{r.label}", "implication", r.label, r.source, r) for k in order for r in rules if r.label == k and k in labels]
    out += [Constraint(r.description, "negation", r.label, r.source, r) for r in negations if r.label in labels]
    return KnowledgeBase(labels, tuple(out))


def describe(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    rows = [(c.name, c.kind, c.target, c.source) for c in kb.constraints]
    return spark.createDataFrame(rows, "name string, constraint_type string, target_label string, source string")


def fuzzy(text: Column, rule: Rule, share: bool = False, find: Callable[[str], Column] | None = None) -> Column:
    """Half a point for each pattern that hits, 1 at most; with ``share`` the part of patterns that hit.  ``find``: how to
    look for a pattern, if not by searching."""
    find = find or (lambda p: text.rlike(re_(p)))
    n = sum((F.when(find(p), 1).otherwise(0) for p in rule.patterns), F.lit(0))
    return n / dbl(len(rule.patterns)) if share else F.least(dbl(0.5) * n, dbl(1))


def truths(df: DataFrame, kb: KnowledgeBase, text: str = "sentence", share: bool = False) -> DataFrame:
    """Adds truth, an array with one value for each rule of the knowledge base."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    ship(df.sparkSession)
    known = Patterns(p for c in kb.rules for p in c.rule.patterns)
    lower, mask, *names = free(df.columns, "l", "mask", *(f"q{i}" for i in range(len(kb.rules))))
    df = df.withColumn(lower, t).withColumn(mask, known.mask(F.col(lower)))
    df = df.withColumns({n: fuzzy(F.col(lower), c.rule, share, lambda p: known.has(F.col(mask), F.col(lower), p)) for n, c in zip(names, kb.rules, strict=True)})
    return df.withColumn("truth", F.array(*names)).drop(lower, mask, *names)


def _truth(i: int) -> Column:
    return F.col("truth")[i]


def label_truth(kb: KnowledgeBase) -> dict[str, Column]:
    """The largest truth among each label's rules."""
    out = {}
    for k in kb.labels:
        mine = [_truth(i) for i, c in enumerate(kb.rules) if c.kind == "implication" and c.target == k]
        out[k] = F.greatest(*mine) if len(mine) > 1 else mine[0] if mine else dbl(0)
    return out


def active(kb: KnowledgeBase) -> Column:
    """Constraints with their truth, where it isn't 0; exactly_one always holds."""
    one = [F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.target).cast("string").alias("target"), dbl(1).alias("truth")) for c in kb.constraints if c.rule is None]
    rest = [F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.target).alias("target"), _truth(i).alias("truth")) for i, c in enumerate(kb.rules)]
    return F.filter(F.array(*one, *rest), lambda c: c["truth"] > 0)


def triggered(kb: KnowledgeBase) -> Column:
    """label -> "name (source)" of the rules that hit."""
    lists = [F.array_compact(F.array(*(F.when(_truth(i) > 0, f"{c.rule.name} ({c.source})") for i, c in enumerate(kb.rules) if c.kind == "implication" and c.target == k), F.lit(None).cast("string"))) for k in kb.labels]
    return F.map_from_arrays(F.array(*map(F.lit, kb.labels)), F.array(*lists))


def rule_log_probs(kb: KnowledgeBase) -> Column:
    scores = []
    for k in kb.labels:
        s = dbl(0)
        for i, c in enumerate(kb.rules):
            if c.target == k:
                s = s + _truth(i) if c.kind == "implication" else s - _truth(i)
        scores.append(s)
    return log_softmax(F.array(*scores))


def fuse(df: DataFrame, kb: KnowledgeBase, logits: str = "logits", alpha: Column | float = 0.5) -> DataFrame:
    """Adds label, confidence, neural_label, neural_confidence, rule_adjusted, active_constraints, rule_probs."""
    a = alpha if isinstance(alpha, Column) else dbl(alpha)
    df = df.withColumns({"__n": log_softmax(F.col(logits)), "__r": rule_log_probs(kb)})
    df = df.withColumn("__m", F.zip_with("__n", "__r", lambda n, r: (dbl(1) - a) * n + a * r)).withColumn("__c", softmax(F.col("__m")))
    # equal to twelve digits is equal, so that the first label wins a tie and not the last bit of a sum
    name = lambda c: F.array(*map(F.lit, kb.labels))[arg_max(F.transform(c, lambda x: F.round(x, 12)))]
    probs = F.transform("__n", F.exp)
    hits = sum((F.when(_truth(i) > 0, 1).otherwise(0) for i in range(len(kb.rules))), F.lit(0))
    return df.withColumns({
        "label": name(F.col("__m")), "confidence": F.array_max("__c"), "neural_label": name(F.col("__n")), "neural_confidence": F.array_max(probs),
        "rule_adjusted": name(F.col("__m")) != name(F.col("__n")), "active_constraints": hits, "rule_probs": F.transform("__r", F.exp),
    }).drop("__n", "__r", "__m", "__c")


def explain(df: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Adds explanations, for rows out of ``fuse``."""
    parts = [F.when(F.col("rule_adjusted"), F.format_string("Posterior regularization: '%s' (neural=%.3f) -> '%s' (combined=%.3f)", "neural_label", "neural_confidence", "label", "confidence"))]
    for i, c in enumerate(kb.rules):
        arrow = f"P({c.target})↑" if c.kind == "implication" else f"¬P({c.target})"
        parts.append(F.when(_truth(i) > dbl(0.3), F.format_string(f"α: {c.rule.name} -> {arrow} [truth=%.2f, src=%s]", _truth(i), F.lit(c.source))))
    text = F.array_compact(F.array(*parts))
    return df.withColumn("explanations", F.when(F.size(text) > 0, text).otherwise(F.array(F.lit("No symbolic constraints active for this input."))))


def exactly_one_loss(probs: Column, eps: float = EPS) -> Column:
    """Of one row; the batch's is the mean."""
    p = F.transform(probs, lambda x: F.least(F.greatest(x, dbl(eps)), dbl(1 - eps)))
    prod = F.aggregate(p, dbl(1), lambda s, x: s * (dbl(1) - x))
    odds = F.aggregate(p, dbl(0), lambda s, x: s + x / (dbl(1) - x))
    return -F.ln(prod * odds + dbl(eps))


def constraint_losses(kb: KnowledgeBase, probs: str = "probs", eps: float = EPS) -> dict[str, tuple[Column, Column]]:
    """kind -> (sum of losses, number of active constraints) of one row."""
    out = {}
    for kind in ("implication", "negation"):
        total, n = dbl(0), F.lit(0)
        for i, c in enumerate(kb.rules):
            if c.kind == kind:
                p = F.col(probs)[kb.labels.index(c.target)]
                p = p if kind == "implication" else dbl(1) - p
                on = _truth(i) > 0
                total = total + F.when(on, -_truth(i) * F.ln(F.greatest(p, dbl(eps)))).otherwise(dbl(0))
                n = n + F.when(on, 1).otherwise(0)
        out[kind] = (total, n)
    return out


def semantic_loss(df: DataFrame, kb: KnowledgeBase, probs: str = "probs", weight: float = 1.0, w_one: float = 1.0, w_implication: float = 0.5, w_negation: float = 0.5) -> DataFrame:
    """One row: exactly_one, implication, negation, total of the batch."""
    parts = constraint_losses(kb, probs)
    mean = lambda k: F.when(F.sum(parts[k][1]) > 0, F.sum(parts[k][0]) / F.sum(parts[k][1])).otherwise(dbl(0))
    r = df.agg(F.avg(exactly_one_loss(F.col(probs))).alias("exactly_one"), mean("implication").alias("implication"), mean("negation").alias("negation"))
    return r.withColumn("total", dbl(weight) * (dbl(w_one) * F.col("exactly_one") + dbl(w_implication) * F.col("implication") + dbl(w_negation) * F.col("negation")))


def rule_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.when(F.col("active_constraints") > 0, 1.0).otherwise(0.0)).alias("rule_coverage"))


def alpha_search(df: DataFrame, kb: KnowledgeBase, truth: str, logits: str = "logits", grid=(0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """alpha, macro_f1, micro_f1, best: each alpha's scores; the first of the best macro-F1 is marked."""
    d = df.withColumn("alpha", F.explode(F.array(*map(dbl, grid))))
    s = f1_summary(fuse(d, kb, logits, F.col("alpha")), truth, "label", ("alpha",))
    order = W.orderBy(F.round("macro_f1", 12).desc(), "alpha")  # one row for each alpha
    return s.withColumn("best", F.row_number().over(order) == 1)


def parse_grid(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


class Reasoner:
    """Rules of both tasks over a frame of sentences."""

    def __init__(self, topic: KnowledgeBase | None = None, action: KnowledgeBase | None = None):
        self.bases = {"topic": topic or knowledge_base("topic"), "action": action or knowledge_base("action")}

    def reason(self, df: DataFrame, task: str, text: str = "sentence") -> DataFrame:
        kb = self.bases[task]
        d = truths(df, kb, text)
        best = label_truth(kb)
        return d.withColumns({
            f"{task}_constraints": active(kb), f"{task}_triggered": triggered(kb), f"{task}_truth": F.map_from_arrays(F.array(*map(F.lit, kb.labels)), F.array(*(best[k] for k in kb.labels))),
        }).drop("truth")

    def predict(self, df: DataFrame, task: str, logits: str = "logits", alpha: float = 0.5, text: str = "sentence") -> DataFrame:
        kb = self.bases[task]
        return explain(fuse(truths(df, kb, text), kb, logits, alpha), kb).drop("truth")


def compare(df: DataFrame, kb: KnowledgeBase, truth: str, alpha: float, logits: str = "logits") -> DataFrame:
    """Scores of the model alone and with rules."""
    d = fuse(df, kb, logits, alpha)
    a = f1_summary(d, truth, "neural_label").withColumn("run", F.lit("baseline"))
    return a.unionByName(f1_summary(d, truth, "label").withColumn("run", F.lit("neuro_symbolic")))


Scorer = Callable[[DataFrame], DataFrame]
