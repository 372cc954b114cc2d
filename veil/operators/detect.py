"""Raw findings of a text table: every rule in one scan, then checks and grading per match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.config import Config
from veil.operators.labels import LABEL_RULE_NAMES, label_rules, name_value
from veil.operators.persons import PERSON_RULES, judge_runs, without_shadowed_caps
from veil.operators.rules import SECRETS, lookalike_rule, term_rule, value_rules
from veil.operators.spans import CONTEXT, Rule, find_spans

FINDING = ["type", "start_at", "end_at", "value", "surface", "via", "before", "after", "gathered"]
_LABEL_KEYS = ("LABEL_NAME", "FIELD_NAME")
_PERSON_KEYS = tuple(r.key for r in PERSON_RULES)


# order in which evidence is gathered; it settles ties between findings of equal rank and place
GATHERED = {"value": 0, "lookalike": 1000, "encoded": 2000, "term": 3000, "label": 4000, "table": 5000, "secret": 6000, "person": 7000, "sweep": 8000}


def _gathered(rule: Rule, i: int) -> int:
    family = {"token_literal": "lookalike", "term": "term", "secret": "secret"}.get(rule.via, "value")
    if rule.key in _PERSON_KEYS:
        family = "person"
    elif rule.key in LABEL_RULE_NAMES:
        family = "label"
    return GATHERED[family] + i


def _by_rule(rules: list[Rule], pick) -> Column | None:
    """CASE over the rule number for the rules for which ``pick`` has something to say."""
    chain = None
    for i, rule in enumerate(rules):
        answer = pick(rule)
        if answer is not None:
            chain = (F.when if chain is None else chain.when)(F.col("rule") == i, answer)
    return chain


def detect(
    df: DataFrame, rules: list[Rule], keys: list[str], config: Config | None = None, text: str = "text", context: int = CONTEXT,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``keys`` plus type, offsets, value, evidence and context of every match that passes its checks."""
    config = config or Config()
    names = F.array(*[F.lit(r.key) for r in rules])
    types = F.array(*[F.lit(r.type) for r in rules])
    vias = F.array(*[F.lit(r.via) for r in rules])
    hits = find_spans(df, rules, keys, text, context)
    valid = _by_rule(rules, lambda r: r.valid(F.col("value")) if r.valid else None)
    if valid is not None:
        hits = hits.where(F.coalesce(valid.otherwise(True), F.lit(False)))
    grade = _by_rule(rules, lambda r: r.grade(F.col("value")) if r.grade else None)
    stated = F.get(vias, F.col("rule"))
    hits = hits.withColumn("via", grade.otherwise(stated) if grade is not None else stated).withColumn("type", F.get(types, F.col("rule")))
    if any(r.key in _LABEL_KEYS for r in rules):
        cut = name_value(F.get(names, F.col("rule")), F.col("value"), F.col("explicit"), config.lexicons)
        hits = (
            hits.withColumn("_v", cut)
            .where("_v is not null")
            .withColumn("after", F.left(F.concat(F.expr("substring(value, length(_v) + 1)"), "after"), F.lit(context)))
            .withColumn("end_at", F.col("start_at") + F.length("_v"))
            .withColumn("value", F.col("_v"))
            .drop("_v")
        )
    if any(r.key in _PERSON_KEYS for r in rules):
        key = F.get(names, F.col("rule"))
        hits = judge_runs(hits.withColumn("run", F.when(key.isin(*_PERSON_KEYS), key)), config.lexicons, config.person_mode)
        if any(r.key == "CAPS_RUN" for r in rules):
            hits = without_shadowed_caps(hits, keys)
    order = F.get(F.array(*[F.lit(_gathered(r, i)) for i, r in enumerate(rules)]), F.col("rule"))
    return hits.withColumn("surface", F.col("value")).withColumn("gathered", order).select(*keys, *FINDING, *extra)


def text_rules(config: Config, spark=None) -> list[Rule]:
    """Everything that reads the text as it stands, in the order evidence is gathered."""
    rules = value_rules(config, spark) + lookalike_rule(config) + term_rule(config)
    if config.labels:
        rules += label_rules()
    if config.on("SECRETS"):
        rules += SECRETS
    if config.on("PERSON"):
        rules += PERSON_RULES
    return rules
