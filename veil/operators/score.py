"""Confidence of a finding from how it was found and what stands around it, in whole hundredths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import finding_id

# What each kind of evidence is worth, in hundredths.
BASE = {
    "established": 97, "token_literal": 99, "term": 99, "secret": 97, "custom": 96, "known_value": 95, "checksum": 95,
    "structural": 90, "gazetteer": 80, "field": 86, "label": 78, "sa_id_weak": 72, "honorific": 62, "shape": 55,
}
# Words that support a finding of a type when they stand near it; the first listed one is named.
HOTWORDS = {
    "CREDIT_CARD": "card credit debit visa mastercard amex cvv cvc expiry expires ending payment pay pan cardholder",
    "PHONE": "phone tel telephone mobile cell cellphone call whatsapp fax contact reach ring dial",
    "EMAIL": "email e-mail mail contact reach address cc bcc",
    "SA_ID": "id identity identification national",
    "SSN": "ssn social security",
    "IBAN": "iban bank account swift bic transfer payment",
    "PASSPORT": "passport",
    "DOB": "birth born dob birthday",
    "ID": "number no nr reference member policy account",
    "PERSON": "mr mrs ms miss dr prof sir name contact signed prepared reviewed approved attn regards sincerely dear spoke met called",
    "STREET_ADDRESS": "address street road avenue lives resides deliver postal",
    "VIN": "vin vehicle chassis registration",
    "SECRET": "key secret token password credential auth env config export",
    "API_KEY": "key api token secret auth bearer env",
    "SEED_PHRASE": "seed mnemonic recovery phrase wallet backup restore",
    "PRIVATE_KEY": "key private ssh pem cert certificate identity",
}
# Words that, right before a number, make it a transactional one.
ANTIWORDS = (
    "order invoice ref reference ticket case sku batch serial tracking receipt quote po purchase item product part "
    "model build version row line record job task issue bug pr commit port pid seed"
).split()
NUMERIC_TYPES = ("PHONE", "CREDIT_CARD", "SA_ID", "SSN", "ID", "VIN", "IPV4")
HOT_BONUS, ANTI_MALUS, LOWERCASE_MALUS, FLOOR, HIGH, MEDIUM, CEILING, IMMEDIATE = 15, 45, 20, 35, 85, 60, 99, 16

# Sentences that explain a finding.
VIA_REASON = {
    "gazetteer": "Known first name followed by a capitalised surname",
    "honorific": "Introduced by a title, but the given name is not one we know",
    "label": "Value sitting next to a personal-identifier label",
    "field": "A field name declares what this value is",
    "sa_id_weak": "13-digit South African ID shape with a valid date, but the check digit does not match - mistyped or synthetic",
    "term": "One of your always-mask terms",
    "established": "The same value is declared personal elsewhere in this payload",
}
TYPE_REASON = {
    "secret": ({
        "API_KEY": "A provider-issued API key prefix (the vendor registers these, so it is not a coincidence)",
        "PRIVATE_KEY": "A private key block",
        "SEED_PHRASE": "Every word is from the BIP-39 wallet recovery wordlist",
        "JWT": "A JSON Web Token — header, payload and signature",
        "CONNECTION_STRING": "A connection URI with a password inline",
        "SECRET": "A value assigned to a field named like a credential",
    }, " credential pattern"),
    "checksum": ({
        "CREDIT_CARD": "Luhn-valid card number",
        "SA_ID": "Luhn-valid 13-digit South African ID with a valid date",
        "AADHAAR": "Verhoeff-checked Aadhaar number",
        "IBAN": "IBAN country code and check digits",
        "NINO_UK": "UK National Insurance number with a valid prefix",
        "DOB": "A date next to a date-of-birth label",
    }, " passed its checksum"),
    "structural": ({
        "EMAIL": "Email address structure",
        "IPV6": "IPv6 address",
        "MAC": "MAC address",
        "ETH_ADDRESS": "Ethereum address (0x and 40 hex characters)",
        "BTC_ADDRESS": "Bitcoin address structure",
        "PAN_INDIA": "Indian PAN structure (AAAAA1234A)",
    }, " structure"),
    None: ({
        "PHONE": "Digits shaped like a phone number",
        "VIN": "17 characters shaped like a VIN",
        "STREET_ADDRESS": "A number followed by a named street and a street type",
        "IPV4": "Four dotted integers",
        "SSN": "US Social Security number format",
        "ID": "Value next to a personal-identifier label",
    }, " pattern"),
}


def choose(subject: Column, table: dict, default: Column) -> Column:
    chain = F
    for key, value in table.items():
        chain = chain.when(subject == key, F.lit(value))
    return chain.otherwise(default)


def base_score(via: Column) -> Column:
    return choose(via, BASE, F.lit(BASE["shape"]))


def context_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z'-]*"), F.lit(0))


def hotword(type_: Column, before: Column, after: Column) -> Column:
    """The first supporting word of the type's list found within the context, or NULL."""
    near = F.concat(context_words(before), context_words(after))
    lists = F
    for name, words in HOTWORDS.items():
        lists = lists.when(type_ == name, F.array(*[F.lit(w) for w in words.split()]))
    return F.get(F.array_intersect(lists, near), F.lit(0))


def antiword(type_: Column, via: Column, before: Column) -> Column:
    """The transactional word right before a numeric value, or NULL."""
    words = context_words(F.right(before, F.lit(IMMEDIATE)))
    last = F.get(words, F.size(words) - 1)
    counts = type_.isin(*NUMERIC_TYPES) & ~via.isin("established", "term")
    return F.when(counts & last.isin(ANTIWORDS), last)


def is_lowercase_person(type_: Column, via: Column, value: Column) -> Column:
    return (type_ == "PERSON") & ~via.isin("term", "established") & (value == F.lower(value))


def points(via: Column, hot: Column, anti: Column, lowercase: Column) -> Column:
    """Hundredths: what the evidence is worth, with the context's bonus and maluses."""
    plus = F.when(hot.isNotNull(), HOT_BONUS).otherwise(0)
    minus = F.when(anti.isNotNull(), ANTI_MALUS).otherwise(0) + F.when(lowercase, LOWERCASE_MALUS).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(CEILING), base_score(via) + plus - minus))


def level(points: Column) -> Column:
    return F.when(points >= HIGH, "high").when(points >= MEDIUM, "medium").otherwise("low")


def reason(type_: Column, via: Column, hot: Column, anti: Column, lowercase: Column) -> Column:
    def typed(kind):
        table, suffix = TYPE_REASON[kind]
        return choose(type_, table, F.concat(type_, F.lit(suffix)))

    first = choose(via, VIA_REASON, F.lit(None).cast("string"))
    first = F.coalesce(
        first,
        F.when(via == "secret", typed("secret"))
        .when(via == "checksum", typed("checksum"))
        .when(via == "structural", typed("structural"))
        .when(via == "custom", F.concat(F.lit('Matched your custom "'), type_, F.lit('" pattern')))
        .otherwise(typed(None)),
    )
    return F.concat_ws(
        ", ",
        F.concat(F.upper(F.left(first, F.lit(1))), F.substring(first, 2, 1000)),
        F.when(hot.isNotNull(), F.concat(F.lit('"'), hot, F.lit('" appears next to it'))),
        F.when(anti.isNotNull(), F.concat(F.lit('but "'), anti, F.lit('" immediately precedes it, which usually labels a transactional number'))),
        F.when(lowercase, F.lit("but the name is not capitalised")),
    )


def score(findings: DataFrame, drop_weak: bool = True) -> DataFrame:
    """Add points (hundredths), confidence, level, reason and finding_id; weak findings are dropped."""
    type_, via, value = F.col("type"), F.col("via"), F.col("value")
    scored = (
        findings.withColumn("_hot", hotword(type_, F.col("before"), F.col("after")))
        .withColumn("_anti", antiword(type_, via, F.col("before")))
        .withColumn("_low", is_lowercase_person(type_, via, value))
        .withColumn("points", points(via, F.col("_hot"), F.col("_anti"), F.col("_low")))
    )
    if drop_weak:
        scored = scored.where(F.col("points") >= FLOOR)
    return (
        scored.withColumn("confidence", F.col("points") / 100.0)
        .withColumn("level", level(F.col("points")))
        .withColumn("reason", reason(type_, via, F.col("_hot"), F.col("_anti"), F.col("_low")))
        .withColumn("finding_id", finding_id(type_, value))
        .drop("_hot", "_anti", "_low")
    )
