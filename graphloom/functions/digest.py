"""Digests, encodings and minted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_prefixed(*parts: Column) -> Column:
    """Parts joined so that no two lists of parts give the same text: each has its length in bytes before it."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def tuple_digest(*parts: Column) -> Column:
    return F.sha2(length_prefixed(*parts), 256)


def base64url(hex_digest: Column) -> Column:
    """A hex digest in unpadded base64url."""
    return F.rtrim(F.translate(F.base64(F.unhex(hex_digest)), "+/", "-_"), F.lit("="))


def uuid4(hex_digest: Column) -> Column:
    """A deterministic version-4 UUID from the first 16 bytes of a hex digest."""
    h = F.substring(hex_digest, 1, 32)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def encode_for_uri(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def local_name(name: Column) -> Column:
    """What follows the last slash or hash."""
    return F.regexp_extract(name, "([^/#]*)$", 1)
