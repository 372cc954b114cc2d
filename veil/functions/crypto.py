"""Keyed fingerprints, masked previews and field encryption. Keys are derived once on the driver."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import norm

# Key derivation labels. To agree with fingerprints made elsewhere, pass the labels used there.
SALTS = {"blind": b"veil/leak/blind", "enc": b"veil/leak/enc"}
BLOCK, IV, TAG = 64, 12, 16


def master_bytes(secret: str) -> bytes:
    return bytes.fromhex(secret) if re.fullmatch(r"[0-9a-fA-F]{64}", secret) else secret.encode()


def derive_key(kind: str, tenant: str, master: str, salts: dict[str, bytes] = SALTS) -> bytes:
    """HKDF-SHA256 key of 32 bytes for one tenant and purpose."""
    pseudo = hmac.new(salts[kind], master_bytes(master), hashlib.sha256).digest()
    return hmac.new(pseudo, f"tenant:{tenant or 'global'}".encode() + b"\x01", hashlib.sha256).digest()


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer HMAC pads of a key, in hex."""
    padded = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()


def tenant_keys(spark, tenants: list[str], master: str, salts: dict[str, bytes] = SALTS) -> DataFrame:
    """One row per tenant with its pads and encryption key; tenants are named by the caller, not collected."""
    rows = []
    for t in tenants:
        inner, outer = hmac_pads(derive_key("blind", t, master, salts))
        rows.append((t, inner, outer, derive_key("enc", t, master, salts).hex()))
    return spark.createDataFrame(rows, "tenant string, ipad string, opad string, enc_key string")


def hmac_sha256(value: Column, ipad: Column, opad: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(F.unhex(ipad), F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(opad), inner), 256)


def blind_index(value: Column, ipad: Column, opad: Column) -> Column:
    """One-way fingerprint of a value's normal form; empty for an empty value."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "").otherwise(hmac_sha256(norm(value), ipad, opad))


def encrypt(value: Column, key_hex: Column) -> Column:
    """base64(iv, ciphertext, tag) under AES-256-GCM; empty for an empty value."""
    sealed = F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), F.unhex(key_hex), F.lit("GCM")))
    sealed = F.regexp_replace(sealed, r"\s", "")
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "").otherwise(sealed)


def decrypt(cipher: Column, key_hex: Column) -> Column:
    """The value, or an empty string where the ciphertext cannot be opened."""
    opened = F.try_aes_decrypt(F.when(looks_encrypted(cipher), F.unbase64(cipher)), F.unhex(key_hex), F.lit("GCM"))
    return F.coalesce(opened.cast("string"), F.lit(""))


def looks_encrypted(c: Column) -> Column:
    """Whether a stored value has the shape of our ciphertext."""
    shaped = (F.length(c) >= 40) & c.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(c) % 4 == 0)
    raw = F.when(shaped, F.call_function("try_to_binary", c, F.lit("base64")))
    again = F.regexp_replace(F.base64(raw), r"\s", "")
    return F.coalesce(shaped & (F.octet_length(raw) >= IV + TAG + 1) & (again == c), F.lit(False))


DOT, HYPHEN = chr(0x2022), chr(0x2011)


def mask_preview(value: Column, type_: Column) -> Column:
    """A preview that shows the kind of value without giving it away."""
    from veil.functions.text import java, trim

    v = trim(F.coalesce(value, F.lit("")))
    t = F.upper(F.coalesce(type_, F.lit("")))
    first = F.left(v, F.lit(1))
    host = F.get(F.split(v, "@"), F.lit(1))
    nums = F.regexp_replace(v, "[^0-9]", "")
    words = F.transform(F.split(v, java(r"\s+")), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***")))
    return (
        F.when(v == "", "")
        .when((t == "EMAIL") & (F.coalesce(F.length(host), F.lit(0)) > 0), F.concat(F.left(F.substring_index(v, "@", 1), F.lit(1)), F.lit("***@"), host))
        .when(t == "EMAIL", F.concat(first, F.lit("***")))
        .when(t.isin("CREDIT_CARD", "IBAN"), F.concat(F.lit("****"), F.right(F.regexp_replace(v, java(r"\s|-"), ""), F.lit(4))))
        .when(t.isin("SSN", "SA_ID", "ID"), F.concat(F.lit(DOT * 5), F.right(nums, F.lit(4))))
        .when(t == "PHONE", F.concat(F.lit(DOT * 3 + HYPHEN + DOT * 3 + HYPHEN), F.right(nums, F.lit(4))))
        .when(t == "IPV4", F.concat(F.substring_index(v, ".", 1), F.lit(".*.*.*")))
        .when(t.isin("PERSON", "CUSTOM"), F.array_join(words, " "))
        .when(F.length(v) <= 2, F.concat(first, F.lit("*")))
        .otherwise(F.concat(first, F.lit("***"), F.right(v, F.lit(1))))
    )


def _rsa(spark, mode: str, key):
    """RSA-OAEP with SHA-256, also for its mask, in the driver's JVM."""
    jvm = spark.sparkContext._jvm
    oaep = jvm.javax.crypto.spec.OAEPParameterSpec(
        "SHA-256", "MGF1", jvm.java.security.spec.MGF1ParameterSpec.SHA256, getattr(jvm.javax.crypto.spec, "PSource$PSpecified").DEFAULT
    )
    cipher = jvm.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPWithSHA-256AndMGF1Padding")
    cipher.init(getattr(jvm.javax.crypto.Cipher, mode), key, oaep)
    return cipher


def _bytes(array) -> bytes:
    return bytes(b & 0xFF for b in array)


def rsa_pair(spark, bits: int = 2048) -> tuple[bytes, bytes]:
    """A new key pair: public in X.509 form, private in PKCS #8 form."""
    maker = spark.sparkContext._jvm.java.security.KeyPairGenerator.getInstance("RSA")
    maker.initialize(bits)
    pair, forms = maker.generateKeyPair(), spark.sparkContext._jvm.java.security.KeyFactory.getInstance("RSA")
    kinds = [spark.sparkContext._jvm.java.lang.Class.forName(f"java.security.spec.{n}EncodedKeySpec") for n in ("X509", "PKCS8")]
    return _bytes(forms.getKeySpec(pair.getPublic(), kinds[0]).getEncoded()), _bytes(forms.getKeySpec(pair.getPrivate(), kinds[1]).getEncoded())


def wrap_key(spark, data_key: bytes, public_key_der: bytes) -> str:
    """Wrap a data key with RSA-OAEP-SHA256 in the driver's JVM; returned in base64 behind ``e2e:``."""
    jvm = spark.sparkContext._jvm
    spec = jvm.java.security.spec.X509EncodedKeySpec(bytearray(public_key_der))
    public = jvm.java.security.KeyFactory.getInstance("RSA").generatePublic(spec)
    return "e2e:" + base64.b64encode(_bytes(_rsa(spark, "ENCRYPT_MODE", public).doFinal(bytearray(data_key)))).decode()


def unwrap_key(spark, wrapped: str, private_key_der: bytes) -> bytes:
    """The data key again; an error if it was wrapped for another reader."""
    jvm = spark.sparkContext._jvm
    spec = jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(private_key_der))
    private = jvm.java.security.KeyFactory.getInstance("RSA").generatePrivate(spec)
    return _bytes(_rsa(spark, "DECRYPT_MODE", private).doFinal(bytearray(base64.b64decode(wrapped.removeprefix("e2e:")))))
