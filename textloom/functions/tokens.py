"""Web tokens, passphrase encryption and generated identifiers."""

from __future__ import annotations

import hashlib
import secrets

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import base64, hmac, unbase64

CLAIMS = ("iss", "sub", "aud", "exp", "nbf", "iat", "jti")
BITS = {"HS256": 256, "HS384": 384, "HS512": 512}


def relative_time(seconds: Column) -> Column:
    """Seconds from now as words: in 3 hours, 2 days ago."""
    n = F.abs(seconds)
    unit = lambda k, name: F.concat((F.floor(n / k + 0.5)).cast("string"), F.lit(f" {name}"), F.when(F.floor(n / k + 0.5) == 1, "").otherwise("s"))
    words = F.when(n < 60, unit(1, "second")).when(n < 3600, unit(60, "minute")).when(n < 86400, unit(3600, "hour")).when(n < 2592000, unit(86400, "day")).otherwise(unit(2592000, "month"))
    return F.when(seconds < 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))


def decode_jwt(df: DataFrame, token: str, now: int, *, leeway: int = 0, secret: str = "") -> DataFrame:
    """df with header, payload, status, signature and warnings; a bad token has an error and nulls."""
    bare = F.regexp_replace(F.regexp_replace(F.col(token), r"^\s*(?i:bearer)\s+", ""), r"\s", "")
    parts = F.split(bare, r"\.", -1)
    out = df.withColumn("_p", parts).withColumns({"header": unbase64(F.get("_p", F.lit(0))), "payload": unbase64(F.get("_p", F.lit(1)))})
    object_ = lambda c: F.coalesce(F.col(c).rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(F.col(c)).isNotNull(), F.lit(False))
    error = F.when(F.size("_p") == 5, "encrypted tokens can't be read").when(F.size("_p") != 3, "a token has three parts").when(~object_("header"), "the header is no JSON object").when(~object_("payload"), "the payload is no JSON object")
    out = out.withColumn("error", error)
    claim = lambda c: F.get_json_object("payload", f"$.{c}").try_cast("double")
    alg = F.get_json_object("header", "$.alg")
    ms = lambda c: F.coalesce(claim(c) > 1e11, F.lit(False))
    status = F.when(claim("exp") + leeway <= now, "expired").when(claim("nbf") - leeway > now, "not yet valid").otherwise("valid")
    signed = F.concat_ws(".", F.get("_p", F.lit(0)), F.get("_p", F.lit(1)))
    given = F.get("_p", F.lit(2))
    signature = F.when(F.lower(alg) == "none", "unsigned").when(~alg.isin(*BITS), "unsupported").when(F.lit(not secret), "no-secret")
    for name, bits in BITS.items():
        signature = signature.when(alg == name, F.when(base64(F.unhex(hmac(signed, secret or "-", bits)), url_safe=True) == given, "valid").otherwise("invalid"))
    sensitive = F.exists(F.json_object_keys("payload"), lambda k: F.lower(k).rlike("password|passwd|secret|ssn|credit|card"))
    warnings = F.array_compact(
        F.array(
            F.when(F.lower(alg) == "none", "no signature algorithm"),
            F.when((given == "") & (F.lower(alg) != "none"), "empty signature"),
            F.when(claim("exp").isNull(), "never expires"),
            F.when(claim("exp") - claim("iat") > 30 * 86400, "lives over 30 days"),
            F.when(ms("exp") | ms("iat") | ms("nbf"), "times are in milliseconds"),
            F.when(F.coalesce(sensitive, F.lit(False)), "sensitive claims"),
        )
    )
    good = F.col("error").isNull()
    return out.withColumns({"status": F.when(good, status), "signature": F.when(good, signature), "warnings": F.when(good, warnings), "expires": F.when(good, relative_time(claim("exp") - now))}).drop("_p")


ROUNDS = 600_000


SALT, IV, TAG = 16, 12, 16  # bytes


def derived_keys(salts: DataFrame, passphrase: str, rounds: int = ROUNDS) -> DataFrame:
    """salt, key of each distinct salt: the costly derivation runs once for each, in tasks of their own."""
    if len(passphrase) < 8:
        raise ValueError("a passphrase has eight characters at least")

    def run(batches):
        for b in batches:
            keys = [hashlib.pbkdf2_hmac("sha256", passphrase.encode(), s, rounds) for s in b.column("salt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("salt"), pa.array(keys, pa.binary())], names=["salt", "key"])

    wanted = salts.select("salt").where(F.octet_length("salt") == SALT).distinct()
    return wanted.repartition("salt").mapInArrow(run, "salt binary, key binary")


def encrypt(df: DataFrame, column: str, passphrase: str, salt: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """df with the column sealed: base64, in lines of 76, of 1, the salt, a fresh iv, and the AES-256-GCM text with its tag.

    salt: 16 bytes of each row; without it one random salt is drawn for the table. Null stays null.
    """
    salt = F.lit(bytearray(secrets.token_bytes(SALT))) if salt is None else salt
    salted = df.withColumn("_salt", salt)
    keys = derived_keys(salted.select(F.col("_salt").alias("salt")), passphrase, rounds)
    both = salted.join(keys, F.col("_salt") == F.col("salt"), "left")
    sealed = base64(F.concat(F.lit(bytearray(b"\x01")), F.col("_salt"), F.aes_encrypt(F.col(column).cast("binary"), "key", F.lit("GCM"), F.lit("DEFAULT"))))
    lined = F.regexp_replace(F.regexp_replace(sealed, "(.{76})", "$1\n"), r"\n$", "")
    return both.withColumn(column, lined).drop("_salt", "salt", "key")


def decrypt(df: DataFrame, column: str, passphrase: str, rounds: int = ROUNDS) -> DataFrame:
    """df with the column opened and an error: each text's own salt is read from it, and its key derived once.

    error: not base64, too short, another version, or failed (a wrong passphrase or an altered text).
    """
    bare = F.translate(F.regexp_replace(F.col(column), r"\s", ""), "-_", "+/")
    raw = F.try_to_binary(F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)))), F.lit("base64"))
    read = df.withColumn("_raw", raw).withColumn("_salt", F.substring("_raw", 2, SALT))
    version = F.hex(F.substring("_raw", 1, 1))
    error = F.when(F.col(column).isNull(), None).when(F.col("_raw").isNull(), "not base64").when(F.octet_length("_raw") < 1 + SALT + IV + TAG, "too short").when(version != "01", F.concat(F.lit("version "), F.conv(version, 16, 10)))
    read = read.withColumn("error", error)
    fit = F.when(F.col("error").isNull(), F.col("_salt"))
    keys = derived_keys(read.select(fit.alias("salt")), passphrase, rounds)
    both = read.join(keys, fit == F.col("salt"), "left")
    opened = F.try_aes_decrypt(F.substring("_raw", 2 + SALT, 2**31 - 1), F.col("key"), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    failed = F.when(F.col("error").isNull() & F.col(column).isNotNull() & opened.isNull(), "failed").otherwise(F.col("error"))
    return both.withColumns({column: F.when(F.col("error").isNull(), opened), "error": failed}).drop("_raw", "_salt", "salt", "key")


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
NANO = "useandom-26T198340PX75pxJACKVERYMINDBUSHWOLF_GQZbfghjklqvwyzrict"


def identifiers(df: DataFrame, kind: str, now_ms: int = 0) -> DataFrame:
    """df with id: v4, v7, ulid or nanoid. Random digits are those of the JVM's uuid() that are free."""
    free = [F.substring("_r", at, n) for at, n in ((1, 12), (14, 3), (18, 15), (33, 12), (46, 3), (50, 15))]
    rows = df.withColumn("_r", F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit(""))).withColumn("_d", F.concat(*free))

    def spell(letters: str, n: int) -> list[Column]:
        byte = lambda i: F.conv(F.substring("_d", 2 * i + 1, 2), 16, 10).cast("int")
        return [F.substring(F.lit(letters), byte(i) % len(letters) + 1, 1) for i in range(n)]

    if kind == "v4":
        out = F.uuid()
    elif kind == "v7":
        time = f"{now_ms:012x}"
        out = F.concat(F.lit(f"{time[:8]}-{time[8:]}-7"), F.substring("_d", 1, 3), F.lit("-"), F.substring("_r", 17, 1), F.substring("_d", 4, 3), F.lit("-"), F.substring("_d", 7, 12))
    elif kind == "ulid":
        out = F.concat(F.lit("".join(CROCKFORD[now_ms >> 5 * k & 31] for k in range(9, -1, -1))), *spell(CROCKFORD, 16))
    elif kind == "nanoid":
        out = F.concat(*spell(NANO, 21))
    else:
        raise ValueError(kind)
    return rows.withColumn("id", out).drop("_r", "_d")


# What passwords are made of, and what is easily misread.
CHARACTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "symbols": "!@#$%^&*()-_=+[]{};:,.<>?"}
AMBIGUOUS = "Il1O0oB8S5Z2"


def passwords(df: DataFrame, length: int, kinds: tuple[str, ...] = tuple(CHARACTERS), *, exclude_ambiguous: bool = False, require_each: bool = True) -> DataFrame:
    """df with password: characters of the system's secure source, which Spark's rand() is not."""
    pools = ["".join(c for c in CHARACTERS[k] if not (exclude_ambiguous and c in AMBIGUOUS)) for k in kinds]
    if not pools:
        raise ValueError("choose a kind of characters")
    if require_each and length < len(pools):
        raise ValueError(f"{len(pools)} kinds need as many characters")

    @F.pandas_udf("string")
    def made(seed: pd.Series) -> pd.Series:
        draw, every = secrets.SystemRandom(), "".join(pools)

        def one() -> str:
            chars = [draw.choice(p) for p in pools] if require_each else []
            chars += [draw.choice(every) for _ in range(length - len(chars))]
            draw.shuffle(chars)
            return "".join(chars)

        return pd.Series([one() for _ in range(len(seed))])

    return df.withColumn("password", made.asNondeterministic()(F.lit(0)))
