"""The whole pass over nested records and chat bodies: masked and restored in shape, keys speaking for their values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.config import Config
from veil.operators import records as N
from veil.operators.encoded import detect_encoded, drop_in_base64
from veil.operators.known import learn_and_sweep
from veil.operators.resolve import select_findings
from veil.operators.score import score
from veil.operators.secrets import seed_phrases
from veil.operators.terms import detect_terms
from veil.operators.tokens import assign_tokens, attach_tokens, redact, rehydrate, token_sites
from veil.plans.redact import Lists
from veil.session import materialize

# Fields of a chat message that say what it is, and the kinds of blocks that hold text.
MESSAGE_KEYS = ("role", "id", "tool_use_id", "name", "model")
TEXT_BLOCKS = ("text", "tool_result", "tool_use")


@dataclass
class RecordRedaction:
    redacted: DataFrame  # the records, in their own schema
    findings: DataFrame
    token_map: DataFrame
    sites: DataFrame


def _leaves(df: DataFrame, id_cols: list[str], session: str | None, skip_keys: tuple[str, ...], block_types: tuple[str, ...] | None) -> DataFrame:
    leaves = N.explode_leaves(df, id_cols, skip_keys=skip_keys, skip_blobs=True, block_types=block_types)
    named = F.col(session) if session else F.lit(0)
    # tokens are numbered in the order of the records, then of the fields' paths
    return leaves.withColumn("session_id", named).withColumn("doc_id", F.struct(*id_cols, "field_path"))


def redact_records(
    df: DataFrame, id_cols: list[str], config: Config | None = None, session: str | None = None, lists: Lists = Lists(),
    skip_keys: tuple[str, ...] = tuple(N.STRUCTURAL_KEYS), block_types: tuple[str, ...] | None = None,
) -> RecordRedaction:
    """Mask the string leaves of records of any schema; numbers, structural fields, blobs and the shape stay.

    All rules run on each leaf, with a telling key before it as a label; what a key declares is certain, and is looked for in
    the session's other leaves. ``session`` is one of ``id_cols`` (None: all records are one session).
    """
    config = config or Config()
    leaves = _leaves(df, id_cols, session, skip_keys, block_types)
    keys = list(dict.fromkeys(["session_id", *id_cols, "field_path"]))
    spark = df.sparkSession
    found = N.detect_fields(leaves, keys, config, spark)
    more = []
    if config.encoded:
        more.append(detect_encoded(leaves, keys, config, spark, "value"))
    if lists.wallet_words is not None and config.on("SECRETS"):
        more.append(seed_phrases(leaves, lists.wallet_words, keys, "value"))
    if lists.terms is not None:
        more.append(detect_terms(leaves, lists.terms, keys, "value"))
    for part in more:
        found = found.unionByName(part.withColumn("declared", F.lit(False)))
    if config.sweep:
        found = learn_and_sweep(materialize(found), leaves.select(*keys, "value"), keys, config, "value")
    if config.encoded:
        found = drop_in_base64(found, leaves, keys, "value")
    kept = select_findings(score(found), keys, config).withColumn("doc_id", F.struct(*id_cols, "field_path"))
    kept = materialize(kept)
    token_map = assign_tokens(kept, config=config)
    tokenised = attach_tokens(kept, token_map)
    done = redact(leaves.select(*keys, "value"), tokenised, keys, "value").where("redacted <> value")
    changed = N.rewrite_records(df, done.select(*id_cols, "field_path", F.col("redacted").alias("new_value")), id_cols, skip_keys)
    return RecordRedaction(changed, tokenised, token_map, token_sites(tokenised))


def rehydrate_records(
    df: DataFrame, id_cols: list[str], token_map: DataFrame, sites: DataFrame, config: Config | None = None, session: str | None = None,
    skip_keys: tuple[str, ...] = (),
) -> DataFrame:
    """Records with the tokens in their string leaves replaced by what they stand for, in their own schema."""
    leaves = _leaves(df, id_cols, session, skip_keys, None)
    keys = list(dict.fromkeys(["session_id", *id_cols, "field_path"]))
    back = rehydrate(leaves.select(*keys, "value"), token_map, sites, keys, text="value", config=config).where("restored <> value")
    return N.rewrite_records(df, back.select(*id_cols, "field_path", F.col("restored").alias("new_value")), id_cols, skip_keys)


def redact_messages(df: DataFrame, id_cols: list[str], config: Config | None = None, session: str | None = None, lists: Lists = Lists()) -> RecordRedaction:
    """Mask chat bodies: ``system`` and message contents as strings or as blocks, nested tool results, inputs of tool calls.

    Blocks of other types, roles, ids and tool names stay as they are.
    """
    return redact_records(df, id_cols, config, session, lists, (*N.STRUCTURAL_KEYS, *MESSAGE_KEYS), TEXT_BLOCKS)
