"""Sources, sinks and nested records."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import pick, query, view
from veil.catalog.redaction import SESSIONS, findings_sql, masked, masked_sql, token_steps
from veil.operators import records as N
from veil.operators.audit import leak_events
from veil.config import Config
from veil.functions.crypto import derive_key, hmac_pads, looks_encrypted
from veil.sources import sinks
from veil.plans.records import redact_records, rehydrate_records
from veil.sources.text import message_texts, read_conversations, read_text, route_records

MASTER = "sample master secret"

# one nested record per customer, and what its string leaves are
FIRST, LAST = pick("c_custkey", V.FIRST), pick("cast(floor(c_custkey / 2) as bigint)", V.LAST)
MAIL = "'u' || cast(c_custkey as string) || '@acme.co.za'"
BLOB = "repeat('QUJD', 40)"
RECORDS = f"""SELECT c_custkey AS id, named_struct('first_name', {FIRST}, 'last_name', {LAST}, 'age', c_nationkey) AS person,
 array(named_struct('value', {MAIL}, 'type', 'work'), named_struct('value', 'none', 'type', 'home')) AS email_addresses,
 array('tag' || cast(c_custkey % 3 as string), 'vip') AS names, map('notes', 'call ' || {MAIL} || ' soon', 'title', 'about ' || {MAIL}) AS extra,
 'files/' || {MAIL} AS path, CASE WHEN c_custkey % 2 = 0 THEN {BLOB} ELSE 'data ' || {MAIL} END AS body FROM customer"""
LEAVES = [
    ("person.first_name", "first_name", FIRST), ("person.last_name", "last_name", LAST),
    ("email_addresses[0].value", "value", MAIL), ("email_addresses[0].type", "type", "'work'"),
    ("email_addresses[1].value", "value", "'none'"), ("email_addresses[1].type", "type", "'home'"),
    ("names[0]", "names", "'tag' || cast(c_custkey % 3 as string)"), ("names[1]", "names", "'vip'"),
    ("extra.notes", "notes", f"'call ' || {MAIL} || ' soon'"), ("extra.title", "title", f"'about ' || {MAIL}"),
    ("path", "path", f"'files/' || {MAIL}"), ("body", "body", f"CASE WHEN c_custkey % 2 = 0 THEN {BLOB} ELSE 'data ' || {MAIL} END"),
]
LEAVES_SQL = " UNION ALL ".join(f"SELECT c_custkey AS id, '{p}' AS field_path, '{k}' AS key, {v} AS value FROM customer" for p, k, v in LEAVES)


def records(spark, folder):
    return view(spark, folder, RECORDS, "id")


@query("src_text", "SELECT 0 AS session_id, doc_id, length(text) AS n FROM documents")
def src_text(spark, folder):
    return read_text(spark, f"{folder}/documents.parquet").select("session_id", "doc_id", F.length("text").cast("bigint").alias("n"))


@query("src_leaves", LEAVES_SQL)
def src_leaves(spark, folder):
    return N.explode_leaves(records(spark, folder), ["id"])


@query("src_structural_skip", f"SELECT * FROM ({LEAVES_SQL}) WHERE key NOT IN ('path', 'type')")
def src_structural_skip(spark, folder):
    return N.explode_leaves(records(spark, folder), ["id"], skip_keys=tuple(N.STRUCTURAL_KEYS))


@query("src_blob_skip", f"SELECT * FROM ({LEAVES_SQL}) WHERE NOT (length(value) >= 120 AND regexp_full_match(value, '[A-Za-z0-9+/]+={{0,2}}'))")
def src_blob_skip(spark, folder):
    return N.explode_leaves(records(spark, folder), ["id"], skip_blobs=True)


@query("src_description_only", f"SELECT * FROM ({LEAVES_SQL}) WHERE key IN ('description', 'title', 'summary', 'instructions')")
def src_description_only(spark, folder):
    return N.explode_leaves(records(spark, folder), ["id"], only_keys=tuple(N.DESCRIPTION_KEYS))


@query("src_messages", "SELECT conv_id AS session_id, turn AS doc_id, role, 'content[' || b || ']' || p AS field_path, text || s AS text FROM conversations, (VALUES ('0', '.text', ''), ('1', '.content', ' (result)'), ('2', '.input.q', ' (asked)')) AS blocks(b, p, s)")
def src_messages(spark, folder):
    """Chat turns as blocks: text, a tool's result, a tool's input, and an image that is passed over."""
    empty = "cast(NULL AS map<string,string>)"
    rich = view(
        spark, folder,
        f"""SELECT conv_id AS session_id, turn AS doc_id, role, array(
 named_struct('type', 'text', 'text', text, 'content', cast(NULL AS string), 'input', {empty}),
 named_struct('type', 'tool_result', 'text', cast(NULL AS string), 'content', text || ' (result)', 'input', {empty}),
 named_struct('type', 'tool_use', 'text', cast(NULL AS string), 'content', cast(NULL AS string), 'input', map('q', text || ' (asked)')),
 named_struct('type', 'image', 'text', text, 'content', text, 'input', {empty})) AS content FROM conversations""",
        "session_id",
    )
    return message_texts(rich, ["session_id", "doc_id", "role"])


@query("src_conversations", "SELECT conv_id AS session_id, count(*) AS turns, sum(length(text)) AS n FROM conversations GROUP BY conv_id")
def src_conversations(spark, folder):
    corpus = read_conversations(view(spark, folder, "SELECT * FROM conversations", "conv_id"))
    return corpus.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("n"))


METHOD = pick("event_id", ["tools/call", "tools/list", "initialize", "resources/read", "prompts/get", "ping"])
REQUESTS = f"SELECT event_id % 7 AS session_id, cast(floor(event_id / 7) AS bigint) AS id, {METHOD} AS method FROM events"
REPLIES = "SELECT event_id % 7 AS session_id, cast(floor(event_id / 7) AS bigint) + 3 AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS result FROM events"


@query(
    "src_data_methods",
    f"""SELECT r.session_id, r.id, r.result, q.method, CASE WHEN r.result IS NULL OR q.method IS NULL THEN 'pass' WHEN q.method = 'tools/list' THEN 'descriptions' ELSE 'data' END AS route
 FROM ({REPLIES}) r LEFT JOIN (SELECT * FROM ({REQUESTS}) WHERE method IN ('tools/call', 'tools/list', 'resources/read', 'prompts/get')) q ON q.id = r.id AND q.session_id = r.session_id""",
)
def src_data_methods(spark, folder):
    requests = view(spark, folder, REQUESTS, "id")
    return route_records(requests, spark.sql(REPLIES))


# ---- sinks
@query("snk_redacted", token_steps(SESSIONS) + masked_sql(SESSIONS) + " SELECT session_id, doc_id, redacted AS text FROM masked")
def snk_redacted(spark, folder):
    """Written and read back: same columns and types as the source, masked text inside."""
    corpus, _, _, done = masked(spark, folder)
    path = sinks.scratch(spark, "redacted")
    sinks.write_redacted(done, corpus, path)
    return spark.read.parquet(path)


@query(
    "snk_token_map",
    findings_sql(SESSIONS) + " SELECT session_id, type, lower(value) AS norm, true AS sealed FROM f GROUP BY session_id, type, lower(value)",
)
def snk_token_map(spark, folder):
    """What is stored is ciphertext; with the key it reads back as it was."""
    token_map = masked(spark, folder)[2]
    path, key = sinks.scratch(spark, "tokens"), F.lit(derive_key("enc", "global", MASTER).hex())
    sinks.write_token_map(token_map, path, key)
    stored = spark.read.parquet(path).select("token", "session_id", looks_encrypted(F.col("canonical")).alias("sealed"))
    back = sinks.read_token_map(spark, path, key)
    return back.join(stored, ["session_id", "token"]).select("session_id", "type", "norm", "sealed")


@query("snk_events", findings_sql(SESSIONS) + " SELECT type, 'prevented' AS status, session_id AS convo_ref, count(DISTINCT lower(value)) AS n FROM f GROUP BY type, session_id")
def snk_events(spark, folder):
    ipad, opad = (F.lit(p) for p in hmac_pads(derive_key("blind", "global", MASTER)))
    events = leak_events(masked(spark, folder)[2], None, ipad, opad, F.lit(derive_key("enc", "global", MASTER).hex()))
    path = sinks.scratch(spark, "events")
    sinks.write_events(events, path)
    return spark.read.parquet(path).groupBy("type", "status", "convo_ref").agg(F.countDistinct("blind_idx").alias("n"))


# ---- masking and restoring records
def flat(df):
    return df.select(
        "id", F.col("person.first_name").alias("first_name"), F.col("email_addresses")[0]["value"].alias("mail"), F.col("names")[1].alias("name"),
        F.col("extra")["notes"].alias("notes"), F.col("person.age").alias("age"), "path", "body",
    )


_FLAT = f"SELECT c_custkey AS id, {FIRST} AS first_name, {{mail}} AS mail, 'vip' AS name, 'call ' || {{mail}} || ' soon' AS notes, c_nationkey AS age, 'files/' || {MAIL} AS path, CASE WHEN c_custkey % 2 = 0 THEN {BLOB} ELSE 'data ' || {{mail}} END AS body FROM customer"


@query("redact_record", _FLAT.format(mail="'[EMAIL_1]'"))
def redact_record(spark, folder):
    """Masked in place: keys, numbers, structural fields and blobs stay."""
    return flat(redact_records(records(spark, folder), ["id"], Config.only("EMAIL"), "id").redacted)


@query("rehydrate_record", _FLAT.format(mail=MAIL))
def rehydrate_record(spark, folder):
    done = redact_records(records(spark, folder), ["id"], Config.only("EMAIL"), "id")
    return flat(rehydrate_records(done.redacted, ["id"], done.token_map, done.sites, session="id"))


@query(
    "withhold_record",
    f"SELECT c_custkey AS id, 'withheld' AS first_name, 'withheld' AS mail, 'withheld' AS name, 'withheld' AS notes, c_nationkey AS age, 'files/' || {MAIL} AS path, CASE WHEN c_custkey % 2 = 0 THEN {BLOB} ELSE 'withheld' END AS body FROM customer",
)
def withhold_record(spark, folder):
    return flat(N.withhold_records(records(spark, folder), ["id"], F.lit("withheld")))


# ---- records without a schema: an object, an array or a mere string, by row
_MIXED = """SELECT c_custkey AS id, CASE c_custkey % 3
 WHEN 0 THEN '{"mail":"' || @@ || '","n":1.25,"tags":["x",2,null,{"note":"to \\"' || @@ || '\\""},"last"],"type":"' || @kept@ || '"}'
 WHEN 1 THEN '["' || @@ || '",[["deep ' || @@ || '"]],true]' ELSE '"only ' || @@ || '"' END AS body FROM customer""".replace("@kept@", MAIL)
MIXED = _MIXED.replace("@@", MAIL)
MIXED_LEAVES = [  # which third of the rows, path, key, value
    (0, "body.mail", "mail", MAIL), (0, "body.tags[0]", "tags", "'x'"), (0, "body.tags[3].note", "note", f"'to \"' || {MAIL} || '\"'"),
    (0, "body.tags[4]", "tags", "'last'"), (0, "body.type", "type", MAIL), (1, "body[0]", "body", MAIL), (1, "body[1][0][0]", "body", f"'deep ' || {MAIL}"),
    (2, "body", "body", f"'only ' || {MAIL}"),
]


def variants(spark, folder):
    rows = view(spark, folder, MIXED.replace("\\", "\\\\"), "id")
    return rows.withColumn("body", F.parse_json("body"))


@query("src_variant_leaves", " UNION ALL ".join(f"SELECT c_custkey AS id, '{p}' AS field_path, '{k}' AS key, {v} AS value FROM customer WHERE c_custkey % 3 = {m}" for m, p, k, v in MIXED_LEAVES))
def src_variant_leaves(spark, folder):
    """Leaves of values whose types differ by row."""
    return N.explode_leaves(variants(spark, folder), ["id"])


@query("redact_variant", _MIXED.replace("@@", "'[EMAIL_1]'"))
def redact_variant(spark, folder):
    """Masked in place, whatever the shape: numbers and structural keys keep their values."""
    done = redact_records(variants(spark, folder), ["id"], Config.only("EMAIL"), "id").redacted
    return done.select("id", F.to_json("body").alias("body"))


@query("rehydrate_variant", MIXED)
def rehydrate_variant(spark, folder):
    done = redact_records(variants(spark, folder), ["id"], Config.only("EMAIL"), "id")
    back = rehydrate_records(done.redacted, ["id"], done.token_map, done.sites, session="id")
    return back.select("id", F.to_json("body").alias("body"))
