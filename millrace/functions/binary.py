"""Base64, digests and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes that give a content type, tried in this order.
MAGIC_BYTES = [
    ("FFD8", "image/jpeg"),
    ("8950", "image/png"),
    ("2550", "application/pdf"),
]
DEFAULT_CONTENT_TYPE = "application/octet-stream"
BASE64_TEXT = r"^[A-Za-z0-9+/=]+\z"


def encode_base64(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def decode_base64(text: Column) -> Column:
    """Bytes, or null when the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def content_type(data: Column) -> Column:
    """By magic bytes; values of four bytes or fewer have no type."""
    head = F.hex(F.substring(data, 1, 2))
    chosen = F.lit(DEFAULT_CONTENT_TYPE)
    for magic, name in reversed(MAGIC_BYTES):
        chosen = F.when(head == magic, F.lit(name)).otherwise(chosen)
    return F.when(F.octet_length(data) > 4, chosen)


def digest(data: Column) -> Column:
    """Lower-case MD5 hex; missing or empty data gives blank."""
    return F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, F.lit("")).otherwise(F.md5(data))


def looks_base64(text: Column) -> Column:
    return text.rlike(BASE64_TEXT) & (F.length(text) % 4 == 0)
