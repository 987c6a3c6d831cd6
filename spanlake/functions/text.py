"""Cleaning of free strings and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(value: Column, longest: int = 256) -> Column:
    """Line breaks and NUL become blanks; cut to the longest allowed; empty becomes null."""
    return F.nullif(F.left(F.regexp_replace(value, "[\\r\\n\\x00]", " "), F.lit(longest)), F.lit(""))


def key_hash(value: Column) -> Column:
    """A session key is never stored, only this digest of it."""
    return F.when(F.length(value) > 0, F.concat(F.lit("sha256:"), F.left(F.sha2(value, 256), F.lit(24))))


def agent_of_key(value: Column) -> Column:
    """The agent named in a key of the form ``agent:<id>:...``, any case of the word agent."""
    return clean(F.regexp_extract(clean(value), "(?i)^agent:([^:]+):", 1), 128)


def packed(text: Column) -> Column:
    """An id as bytes: hexadecimal digits in lower case (digests) and UUIDs take half their length, any other text stays as it is.

    Ids are random, so a shuffle's compression does not shorten them.  The first byte says which form follows.
    """
    digits = F.translate(text, "-", "")
    uuid = F.concat_ws("-", *[F.substring(digits, first, n) for first, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    def tagged(tag: str, body: Column) -> Column:
        return F.concat(F.unhex(F.lit(tag)), body)

    return (F.when(F.lower(F.hex(F.unhex(text))) == text, tagged("01", F.unhex(text)))
            .when((F.length(text) == 36) & (F.lower(F.hex(F.unhex(digits))) == digits) & (uuid == text), tagged("02", F.unhex(digits)))
            .otherwise(tagged("00", F.encode(text, "UTF-8"))))


def unpacked(code: Column) -> Column:
    """The text that ``packed`` made into bytes."""
    form, body = F.hex(F.substring(code, 1, 1)), F.substring(code, 2, 1 << 30)
    digits = F.lower(F.hex(body))
    uuid = F.concat_ws("-", *[F.substring(digits, first, n) for first, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(form == "01", digits).when(form == "02", uuid).otherwise(F.decode(body, "UTF-8"))
