"""Redaction of free text and salted hashes of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns scrubbed in this order, and what takes their place.
REDACTIONS = [
    (r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", "<mac>"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<ip>"),
    (r"(?i)\b(token|key|secret|password|passphrase|psk)\b\s*[:=]\s*\S+", "$1=<redacted>"),
    (r"(?i)\bssid\s*[:=]\s*.+", "SSID=<redacted>"),
]


def redact(text: Column, limit: int = 400) -> Column:
    """Text without addresses, secrets and network names, white space squeezed, cut to `limit` characters."""
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def hash_identifier(value: Column, salt: bytes, length: int = 12) -> Column:
    """Truncated HMAC-SHA256 of the trimmed value; null for null or blank."""
    inner, outer = (bytes(b ^ k for b in salt.ljust(64, b"\0")) for k in (0x36, 0x5C))
    clean = F.trim(value)
    digest = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(clean, "utf-8")), 256)
    mac = F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(digest)), 256)
    return F.when(F.length(clean) > 0, F.substring(mac, 1, length))


def hash_to_number(value: Column, salt: bytes) -> Column:
    """48 bits of the salted hash as a double; 0.0 for null or blank."""
    return F.coalesce(F.conv(hash_identifier(value, salt), 16, 10).cast("double"), F.lit(0.0))
