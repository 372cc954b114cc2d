"""Fingerprints, previews, sealed fields, events, usage and quotas."""

import os

from pyspark.sql import functions as F

from veil.catalog.base import pad, query, view
from veil.catalog.records import MASTER
from veil.catalog.redaction import KEYS, SESSIONS, findings_sql, found
from veil.functions import crypto as C
from veil.functions.text import finding_id
from veil.operators import audit as A
from veil.operators import envelope as E
from veil.operators import tokens as T

TENANTS = ["en", "de", "fr", "es"]
_FNV = (
    "list_reduce(list_prepend(cast(2166136261 AS bigint), list_transform(string_split(lower(value), ''), lambda c: cast(ord(c) AS bigint))),"
    " lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
)
_B36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(floor(h / {36 ** k}) AS bigint) % 36 + 1, 1)" for k in range(6, -1, -1))


@query(
    "finding_id",
    findings_sql(SESSIONS) + f", h AS (SELECT DISTINCT type, lower(value) AS norm, {_FNV} AS h FROM f) SELECT type, norm, type || '::' || ltrim({_B36}, '0') AS finding_id FROM h",
)
def finding_ids(spark, folder):
    kept = found(spark, folder)[1]
    return kept.select("type", F.lower("value").alias("norm"), finding_id(F.col("type"), F.col("value")).alias("finding_id")).distinct()


def _pads(tenant):
    return C.hmac_pads(C.derive_key("blind", tenant, MASTER))


def _hmac_sql(value: str, ipad: str, opad: str) -> str:
    return f"sha256(unhex({opad}) || unhex(sha256(unhex({ipad}) || encode({value}))))"


_IPAD = "CASE session_id " + " ".join(f"WHEN '{t}' THEN '{_pads(t)[0]}'" for t in TENANTS) + " END"
_OPAD = "CASE session_id " + " ".join(f"WHEN '{t}' THEN '{_pads(t)[1]}'" for t in TENANTS) + " END"


def fingerprinted(spark, folder):
    kept = found(spark, folder)[1]
    keys = F.broadcast(C.tenant_keys(spark, TENANTS, MASTER).withColumnRenamed("tenant", "session_id"))
    return kept.join(keys, "session_id").withColumn("blind_idx", C.blind_index(F.col("value"), F.col("ipad"), F.col("opad")))


@query("blind_index", findings_sql(SESSIONS) + f" SELECT session_id, doc_id, start_at, {_hmac_sql('lower(value)', _IPAD, _OPAD)} AS blind_idx FROM f")
def blind_index(spark, folder):
    """Each tenant's own key; the same value fingerprints differently for two tenants."""
    return fingerprinted(spark, folder).select(*KEYS, F.col("start_at").cast("bigint").alias("start_at"), "blind_idx")


_SAMPLES = f"""SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'CREDIT_CARD' WHEN 2 THEN 'SSN' WHEN 3 THEN 'PHONE' WHEN 4 THEN 'IPV4' WHEN 5 THEN 'PERSON' WHEN 6 THEN 'EMAIL' WHEN 7 THEN 'MAC' WHEN 8 THEN 'CUSTOM' ELSE 'VIN' END AS type,
 CASE c_custkey % 10 WHEN 0 THEN 'jane' || cast(c_custkey as string) || '@acme.com' WHEN 1 THEN '4111 1111-' || {pad('c_custkey', 8)} WHEN 2 THEN '123-45-' || {pad('c_custkey', 4)} WHEN 3 THEN '+27 82 ' || {pad('c_custkey', 7)}
  WHEN 4 THEN cast(c_custkey % 256 as string) || '.168.0.1' WHEN 5 THEN 'Jane Van Doe' WHEN 6 THEN 'noat' WHEN 7 THEN '00:1A:' || {pad('c_custkey', 4)} WHEN 8 THEN 'Secret Project' ELSE 'X' END AS value FROM customer"""


@query(
    "mask_preview",
    f"""SELECT id, type, CASE id % 10 WHEN 0 THEN 'j***@acme.com' WHEN 1 THEN '****' || right(value, 4) WHEN 2 THEN '•••••' || right(value, 4) WHEN 3 THEN '•••‑•••‑' || right(value, 4)
 WHEN 4 THEN string_split(value, '.')[1] || '.*.*.*' WHEN 5 THEN 'J*** V*** D***' WHEN 6 THEN 'n***' WHEN 7 THEN '0***' || right(value, 1) WHEN 8 THEN 'S*** P***' ELSE 'X*' END AS preview FROM ({_SAMPLES})""",
)
def mask_preview(spark, folder):
    return view(spark, folder, _SAMPLES, "id").select("id", "type", C.mask_preview(F.col("value"), F.col("type")).alias("preview"))


@query("encrypt_field", f"SELECT id, value AS opened, true AS sealed, '' AS wrong_key FROM ({_SAMPLES})")
def encrypt_field(spark, folder):
    """Sealed and opened again; the wrong key yields an empty string."""
    key, other = (F.lit(C.derive_key("enc", t, MASTER).hex()) for t in ("a", "b"))
    sealed = view(spark, folder, _SAMPLES, "id").withColumn("cipher", C.encrypt(F.col("value"), key))
    return sealed.select(
        "id", C.decrypt(F.col("cipher"), key).alias("opened"), C.looks_encrypted(F.col("cipher")).alias("sealed"), C.decrypt(F.col("cipher"), other).alias("wrong_key")
    )


_STORED = f"SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'jane@acme.com' WHEN 1 THEN repeat('QUJD', 12) WHEN 2 THEN repeat('A', 43) || '=' WHEN 3 THEN repeat('A', 41) ELSE '' END AS cipher FROM orders"


@query("plaintext_rows", f"SELECT id, cipher FROM ({_STORED}) WHERE id % 5 NOT IN (1, 2)")
def plaintext_rows(spark, folder):
    return A.plaintext_rows(view(spark, folder, _STORED, "id"), "cipher")


@query("envelope_encrypt", f"SELECT id, true AS opens, 344 AS wrapped_len FROM ({_SAMPLES})")
def envelope_encrypt(spark, folder):
    """Previews sealed under one random key per job; the key itself travels wrapped for its owner."""
    data_key = os.urandom(32)
    wrapped = C.wrap_key(spark, data_key, C.rsa_pair(spark)[0])
    key = F.lit(data_key.hex())
    previews = view(spark, folder, _SAMPLES, "id").select("id", C.mask_preview(F.col("value"), F.col("type")).alias("preview"))
    sealed = previews.withColumn("cipher", C.encrypt(F.col("preview"), key))
    return sealed.select(
        "id", (C.decrypt(F.col("cipher"), key) == F.col("preview")).alias("opens"), F.lit(len(wrapped.removeprefix("e2e:"))).alias("wrapped_len")
    )


_OWNED = f"SELECT id, type AS tenant, value FROM ({_SAMPLES})"


@query("envelope_rotate", f"SELECT id, tenant, CASE WHEN tenant = 'VIN' THEN '' ELSE value END AS opened, tenant <> 'VIN' AS sealed, 8 AS keys FROM ({_OWNED})")
def envelope_rotate(spark, folder):
    """Values sealed under a key for each type but one, the keys then wrapped for another reader, who opens the rows as they are."""
    (public, private), (new_public, new_private) = C.rsa_pair(spark), C.rsa_pair(spark)
    owners = ["EMAIL", "CREDIT_CARD", "SSN", "PHONE", "IPV4", "PERSON", "MAC", "CUSTOM"]
    opened, wrapped = E.new_keys(spark, owners, public)
    sealed = E.seal_rows(view(spark, folder, _OWNED, "id"), opened, "value").withColumn("cipher", F.col("value"))
    keys = E.open_keys(E.rotate_keys(wrapped, private, new_public), new_private)
    return E.open_rows(sealed, keys, "value").select(
        "id", "tenant", F.col("value").alias("opened"), F.coalesce(C.looks_encrypted(F.col("cipher")), F.lit(False)).alias("sealed"), F.lit(keys.count()).alias("keys")
    )


_OLD = "doc_id < 500"


@query(
    "leak_events",
    findings_sql(SESSIONS)
    + f""", d AS (SELECT session_id, type, lower(value) AS norm, min(doc_id) AS first_doc FROM f GROUP BY ALL)
SELECT type, 'prevented' AS status, session_id AS convo_ref, {_hmac_sql('norm', f"'{_pads('global')[0]}'", f"'{_pads('global')[1]}'")} AS blind_idx FROM d WHERE NOT first_doc < 500""",
)
def leak_events(spark, folder):
    """Values first seen after a snapshot that covered the earlier documents."""
    kept = found(spark, folder)[1]
    before, now = T.assign_tokens(kept.where(_OLD)), T.assign_tokens(kept)
    ipad, opad = (F.lit(p) for p in _pads("global"))
    return A.leak_events(now, before, ipad, opad, None).drop("cipher")


@query(
    "leak_dedupe",
    findings_sql(SESSIONS)
    + f""", x AS (SELECT session_id, type, value, {_hmac_sql('lower(value)', f"'{_pads('global')[0]}'", f"'{_pads('global')[1]}'")} AS blind_idx FROM f)
SELECT blind_idx, type, count(*) AS times, count(DISTINCT session_id) AS places FROM x WHERE blind_idx NOT IN (SELECT blind_idx FROM x WHERE type = 'IPV4') GROUP BY blind_idx, type""",
)
def leak_dedupe(spark, folder):
    """The suppression list holds every address of a machine."""
    ipad, opad = (F.lit(p) for p in _pads("global"))
    events = found(spark, folder)[1].select("type", F.col("session_id").alias("convo_ref"), C.blind_index(F.col("value"), ipad, opad).alias("blind_idx"))
    return A.dedupe_events(events, events.where("type = 'IPV4'"))


@query("usage_counts", findings_sql(SESSIONS) + " SELECT session_id, type, count(DISTINCT lower(value)) AS distinct_values, count(*) AS occurrences FROM f GROUP BY session_id, type")
def usage_counts(spark, folder):
    return A.usage_counts(found(spark, folder)[1], ["session_id"])


_WINDOWS = "(VALUES ('all', 0, 6), ('early', 0, 2), ('middle', 2, 4), ('late', 6, 6)) AS w(name, lo, hi)"


@query(
    "usage_sketches",
    findings_sql(SESSIONS)
    + f" SELECT name AS span, type, count(DISTINCT lower(value)) AS exact, count(*) AS occurrences, true AS close FROM f JOIN {_WINDOWS} ON doc_id % 7 BETWEEN lo AND hi GROUP BY ALL",
)
def usage_sketches(spark, folder):
    """Sketches by day and session, added up over overlapping spans of days; four standard errors count as close."""
    kept = found(spark, folder)[1].withColumn("day", F.col("doc_id") % 7)
    spans = F.broadcast(spark.sql(f"SELECT * FROM {_WINDOWS}"))
    within = F.col("day").between(F.col("lo"), F.col("hi"))
    facts = A.distinct_sketches(kept, ["session_id", "day"])
    about = A.distinct_over(facts.join(spans, within).withColumnRenamed("name", "span"), ["span", "type"])
    exact = A.usage_counts(kept.join(spans, within).withColumnRenamed("name", "span"), ["span"]).select("span", "type", F.col("distinct_values").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.065)
    return about.join(exact, ["span", "type"]).select("span", "type", "exact", "occurrences", close.alias("close"))


USAGE = "SELECT user_id AS tenant, ts, cast(1 + event_id % 3 as bigint) AS used FROM events"
PLANS = """SELECT DISTINCT user_id AS tenant, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'team' ELSE 'enterprise' END AS plan,
 cast(CASE user_id % 3 WHEN 0 THEN 150 WHEN 1 THEN 190 ELSE -1 END as bigint) AS limit_n, cast(CASE user_id % 2 WHEN 0 THEN 20 ELSE 0 END as bigint) AS credits FROM events"""


@query(
    "quota_state",
    f"""WITH u AS (SELECT tenant, cast(sum(used) AS bigint) AS used FROM ({USAGE}) GROUP BY tenant),
s AS (SELECT p.*, coalesce(used, 0) AS used FROM ({PLANS}) p LEFT JOIN u ON u.tenant = p.tenant),
q AS (SELECT *, CASE WHEN limit_n <> -1 THEN greatest(limit_n - used, 0) END AS remaining, CASE WHEN limit_n = -1 THEN credits ELSE greatest(credits - greatest(used - limit_n, 0), 0) END AS credits_left FROM s),
h AS (SELECT *, CASE WHEN limit_n <> -1 THEN remaining + credits_left END AS headroom, CASE WHEN limit_n > 0 THEN cast(round(used * 100.0 / limit_n) AS bigint) END AS pct FROM q)
SELECT tenant, plan, limit_n, credits, used, remaining, credits_left, headroom, pct, coalesce(headroom BETWEEN 1 AND 25, false) AS low, coalesce(headroom <= 0, false) AS paused FROM h""",
)
def quota_state(spark, folder):
    return A.quota_state(view(spark, folder, USAGE, "tenant"), spark.sql(PLANS))


@query(
    "quota_over_time",
    f"""WITH m AS (SELECT tenant, date_trunc('minute', ts) AS minute, sum(used) AS used FROM ({USAGE}) GROUP BY ALL),
r AS (SELECT *, sum(used) OVER (PARTITION BY tenant ORDER BY minute) AS total FROM m)
SELECT r.tenant, strftime(minute, '%Y-%m-%d %H:%M') AS minute, cast(used AS bigint) AS used, cast(total AS bigint) AS total, limit_n <> -1 AND total >= limit_n + credits AS over_limit FROM r JOIN ({PLANS}) p ON p.tenant = r.tenant""",
)
def quota_over_time(spark, folder):
    return A.over_limit_at(view(spark, folder, USAGE, "tenant"), spark.sql(PLANS)).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query(
    "hotspot_report",
    f"""SELECT type, lang, quality, hits, grouping_level FROM (SELECT type, lang, quality, count(*) AS hits, cast(grouping(type, lang, quality) AS bigint) AS grouping_level FROM (
 SELECT x.type, d.lang, coalesce(l.quality, -1) AS quality FROM ({findings_sql(SESSIONS)} SELECT doc_id, type FROM f) x JOIN documents d ON d.doc_id = x.doc_id LEFT JOIN labels l ON l.doc_id = x.doc_id) GROUP BY CUBE (type, lang, quality))""",
)
def hotspot_report(spark, folder):
    """Findings by type, language and quality of the document, with all totals."""
    kept = found(spark, folder)[1].select("doc_id", "type", F.col("session_id").alias("lang"))
    labelled = kept.join(spark.table("labels"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return A.hotspots(labelled, ["type", "lang", "quality"])
