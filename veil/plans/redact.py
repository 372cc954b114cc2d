"""The whole pass over a corpus: find, learn, grade, keep, name, mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from veil.config import Config
from veil.operators.detect import detect, text_rules
from veil.operators.encoded import detect_encoded, drop_in_base64
from veil.operators.inrow import finding_rows, findings_in_row
from veil.operators.known import learn_and_sweep
from veil.operators.resolve import select_findings
from veil.operators.rules import needs_rows
from veil.operators.score import score
from veil.operators.secrets import seed_phrases
from veil.operators.tabular import detect_tables
from veil.operators.terms import detect_terms
from veil.operators.tokens import assign_tokens, attach_tokens, redact, token_sites
from veil.session import materialize

KEYS = ["session_id", "doc_id"]


@dataclass(frozen=True)
class Lists:
    """Word lists that are tables, one column each: the wallet list, and terms to mask always."""

    wallet_words: DataFrame | None = None
    terms: DataFrame | None = None


def candidates(corpus: DataFrame, config: Config, keys: list[str] = KEYS, text: str = "text", lists: Lists = Lists()) -> DataFrame:
    """Everything the detectors propose, before grading."""
    spark = corpus.sparkSession
    found = detect(corpus, text_rules(config, spark), keys, config, text)
    if config.encoded:
        found = found.unionByName(detect_encoded(corpus, keys, config, spark, text))
    if config.tables:
        found = found.unionByName(detect_tables(corpus, keys, text=text, header_lines=config.header_lines))
    if lists.wallet_words is not None and config.on("SECRETS"):
        found = found.unionByName(seed_phrases(corpus, lists.wallet_words, keys, text))
    if lists.terms is not None:
        found = found.unionByName(detect_terms(corpus, lists.terms, keys, text))
    return found


def find(corpus: DataFrame, config: Config | None = None, keys: list[str] = KEYS, text: str = "text", lists: Lists = Lists()) -> DataFrame:
    """Resolved findings of ``corpus`` (keys and text).

    Without the sweep and without lists that are tables all of it happens inside the row. With the sweep on, the candidates
    are checkpointed once: known values are learnt from them and then looked for in every text of the same session.
    """
    config = config or Config()
    if not config.sweep and lists == Lists() and not needs_rows(config):
        return finding_rows(findings_in_row(corpus, config, text), keys)
    found = candidates(corpus, config, keys, text, lists)
    if config.sweep:
        found = learn_and_sweep(materialize(found), corpus, keys, config, text)
    if config.encoded:
        found = drop_in_base64(found, corpus, keys, text)
    return select_findings(score(found), keys, config)


@dataclass
class Redaction:
    redacted: DataFrame
    findings: DataFrame
    token_map: DataFrame
    sites: DataFrame


def redact_corpus(corpus: DataFrame, config: Config | None = None, text: str = "text", lists: Lists = Lists()) -> Redaction:
    """Mask a corpus of ``session_id, doc_id, text``; tokens are stable within a session.

    Findings are checkpointed between the two passes, so no pattern runs twice.
    """
    config = config or Config()
    findings = materialize(find(corpus, config, KEYS, text, lists))
    token_map = assign_tokens(findings, config=config)
    tokenised = attach_tokens(findings, token_map)
    return Redaction(redact(corpus, tokenised, KEYS, text), tokenised, token_map, token_sites(tokenised))
