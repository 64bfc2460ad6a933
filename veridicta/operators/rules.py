"""Weighted regex rules: which label a text's signs speak for, and which rules said so.

Within a rule, patterns are tried in order; the first that hits the text, or else the context with the text, ends the
search.  Scores add up in the pack's order, in doubles.  A pack's patterns are looked for at once: only those of which
the text holds a necessary string are searched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.expressions import arg_max, dbl, re_
from veridicta.functions.packs import ACTION_RULES, ACTIONS, FUTURE_YEAR, HAS_NUMBERS, TOPIC_RULES, Rule
from veridicta.functions.patterns import Patterns
from veridicta.plans.shipping import ship

_ANCHOR = re.compile(r"\^|\\[AGB]|\(\?<")  # what may hold at a text's start and not behind a space


def _lower(c) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _hit(rule: Rule, text: Column, both: Column | None, known: Patterns, mask: Column) -> Column:
    """1: the text has it, 2: only the context, null: neither."""
    out = F
    for p in rule.patterns:
        in_text = known.has(mask, text, p)
        if both is None:
            out = out.when(in_text, 1)
        elif _ANCHOR.search(p):
            out = out.when(in_text, 1).when(known.has(mask, both, p), 2)
        else:  # the context ends with the text and a space before it, so what the text has the context has: misses cost one search
            out = out.when(known.has(mask, both, p), F.when(text.rlike(re_(p)), 1).otherwise(2))
    return out.otherwise(F.lit(None).cast("int"))


def hits(df: DataFrame, rules, text: str, context: str | None, prefix: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A column for each rule, so that no pattern runs twice; and for each of ``more``, whether the text has it."""
    ship(df.sparkSession)
    known = Patterns([*(p for r in rules for p in r.patterns), *more])
    df = df.withColumn(f"{prefix}t", _lower(text))
    both = None
    if context is not None:
        c = F.coalesce(F.col(context), F.lit(""))
        df = df.withColumn(f"{prefix}c", F.when(c != "", F.lower(F.concat(c, F.lit(" "), F.coalesce(F.col(text), F.lit(""))))).otherwise(F.col(f"{prefix}t")))
        both = F.col(f"{prefix}c")
    t, mask = F.col(f"{prefix}t"), F.col(f"{prefix}m")
    df = df.withColumn(f"{prefix}m", known.mask(t if both is None else both))
    return df.withColumns({f"{prefix}{i}": _hit(r, t, both, known, mask) for i, r in enumerate(rules)} | {f"{prefix}more{i}": known.has(mask, t, p) for i, p in enumerate(more)})


def _scores(rules, labels, prefix: str, in_text: float, in_context: float) -> dict[str, Column]:
    out = {}
    for label in labels:
        total = dbl(0)
        for i, r in enumerate(rules):
            if r.label == label:
                h = F.col(f"{prefix}{i}")
                total = total + F.when(h == 1, dbl(in_text * r.weight)).when(h == 2, dbl(in_context * r.weight)).otherwise(dbl(0))
        out[label] = total
    return out


def _decide(df: DataFrame, rules, scores: dict[str, Column], prefix: str, out: str, threshold: float, default: str, default_confidence: float) -> DataFrame:
    labels = list(scores)
    df = df.withColumn(f"{prefix}s", F.array(*scores.values()))
    best, at = F.array_max(f"{prefix}s"), arg_max(F.col(f"{prefix}s"))
    low = best < dbl(threshold)
    named = [
        F.array_compact(F.array(*(F.when(F.col(f"{prefix}{i}") == 1, r.name).when(F.col(f"{prefix}{i}") == 2, f"{r.name}(ctx)") for i, r in enumerate(rules) if r.label == label)))
        for label in labels
    ]
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"{out}_label": F.when(low, default).otherwise(F.array(*map(F.lit, labels))[at]),
        f"{out}_confidence": F.when(low, dbl(default_confidence)).otherwise(F.least(best, dbl(1))),
        f"{out}_rules": F.when(low, none).otherwise(F.array(*named)[at]),
    })
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))


def match_topics(df: DataFrame, text: str = "sentence", context: str | None = "section_title", rules=TOPIC_RULES, out: str = "topic") -> DataFrame:
    """Adds <out>_label, <out>_confidence, <out>_rules.  Below 0.3: Non_ESG at 0.5."""
    p = "__topic_"
    d = hits(df, rules, text, context, p)
    labels = list(dict.fromkeys(r.label for r in rules))
    return _decide(d, rules, _scores(rules, labels, p, 0.4, 0.1), p, out, 0.3, "Non_ESG", 0.5)


def match_actions(df: DataFrame, text: str = "sentence", context: str | None = None, rules=ACTION_RULES, out: str = "action", numbers: str = HAS_NUMBERS, future: str = FUTURE_YEAR) -> DataFrame:
    """Adds <out>_label, <out>_confidence, <out>_rules.  Numbers and future years speak against Indeterminate, the
    latter for Planning too; below 0.4: Indeterminate at 0.3."""
    p = "__action_"
    d = hits(df, rules, text, context, p, (numbers, future))
    has_numbers, has_future = F.col(f"{p}more0"), F.col(f"{p}more1")
    s = _scores(rules, ACTIONS, p, 0.5, 0.2)
    s["Indeterminate"] = s["Indeterminate"] - F.when(has_numbers, dbl(0.3)).otherwise(dbl(0)) - F.when(has_future, dbl(0.2)).otherwise(dbl(0))
    s["Planning"] = s["Planning"] + F.when(has_future, dbl(0.2)).otherwise(dbl(0))
    return _decide(d, rules, s, p, out, 0.4, "Indeterminate", 0.3)


def provenance(spark: SparkSession, rules=TOPIC_RULES + ACTION_RULES) -> DataFrame:
    rows = [(r.label, r.name, r.source, r.description, len(r.patterns)) for r in rules]
    return spark.createDataFrame(rows, "label string, name string, source string, description string, num_patterns int")


def use(df: DataFrame, rules=TOPIC_RULES, text: str = "sentence", context: str | None = "section_title") -> DataFrame:
    """The provenance of each rule, with in_text, the number of texts that it hits, and in_context, that of texts where
    only the context does.  One pass; a rule that hits nothing, or an empty frame, has zeros."""
    p, told = "__use_", []
    d = hits(df, rules, text, context, p)
    counts = [F.count_if(F.col(f"{p}{i}") == k).alias(f"{k}_{i}") for i in range(len(rules)) for k in (1, 2)]
    for i, r in enumerate(rules):
        known = {"label": r.label, "name": r.name, "source": r.source, "description": r.description, "num_patterns": len(r.patterns)}
        told.append(F.struct(*(F.lit(v).alias(k) for k, v in known.items()), F.col(f"1_{i}").alias("in_text"), F.col(f"2_{i}").alias("in_context")))
    return d.agg(*counts).select(F.explode(F.array(*told)).alias("x")).select("x.*")
