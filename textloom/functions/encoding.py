"""Hashes, Base64, URL encoding and HMAC as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

BLOCK = {256: 64, 384: 128, 512: 128, 1: 64}


def digest(c: Column, bits: int = 256) -> Column:
    """Hex of SHA-1 (bits 1) or SHA-2 of the UTF-8 text or the bytes."""
    return F.sha1(c) if bits == 1 else F.sha2(c, bits)


def hmac(c: Column, secret: str, bits: int = 256) -> Column:
    """Hex; an empty secret gives the plain hash. The pads are literals, so only the text is data."""
    import hashlib

    raw, block = secret.encode(), BLOCK[bits]
    if not raw:
        return digest(c.cast("binary"), bits)
    if len(raw) > block:
        raw = hashlib.new({1: "sha1"}.get(bits, f"sha{bits}"), raw).digest()
    raw = raw.ljust(block, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, c.cast("binary")), bits))), bits)


def base64(c: Column, url_safe: bool = False) -> Column:
    """One line, whatever the session says of chunks."""
    text = F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit(""))
    return F.rtrim(F.translate(text, "+/", "-_"), F.lit("=")) if url_safe else text


def looks_like_base64(c: Column) -> Column:
    bare = F.regexp_replace(c, r"\s", "")
    return (F.length(bare) > 0) & (F.length(bare) % 4 != 1) & bare.rlike(r"^[A-Za-z0-9+/_-]+={0,2}$")


def unbase64(c: Column) -> Column:
    """Text, or null if it isn't Base64; both alphabets, with or without padding."""
    bare = F.rtrim(F.translate(F.regexp_replace(c, r"\s", ""), "-_", "+/"), F.lit("="))
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4.0) * 4).cast("int"), F.lit("="))
    return F.when(F.length(bare) % 4 != 1, F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"))


def base64_auto(c: Column) -> Column:
    """Decoded if the trimmed text is whole, well-formed Base64 of a text, else encoded."""
    t = trim(c)
    decoded = unbase64(t)
    fits = looks_like_base64(t) & (F.length(t) % 4 == 0) & decoded.isNotNull() & ~decoded.contains("\ufffd")
    return F.when(t == "", "").when(F.coalesce(fits, F.lit(False)), decoded).otherwise(base64(t))


def url_encode(c: Column, mode: str = "component") -> Column:
    """component and full keep ! ~ ' ( ), full also the reserved characters; form writes a space as +."""
    out = F.url_encode(c)
    if mode == "form":
        return F.replace(out, F.lit("%7E"), F.lit("~"))
    kept = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    if mode == "full":
        kept |= {"%3B": ";", "%2C": ",", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%23": "#"}
    for a, b in kept.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_decode(c: Column, form: bool = False) -> Column:
    """Null if an escape is malformed."""
    return F.try_url_decode(c if form else F.replace(c, F.lit("+"), F.lit("%2B")))
