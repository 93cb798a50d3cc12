"""Scalar functions: labels, terms, expiry, ids and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark import params as P


def anon_label(rank: Column, prefix: str = "Student ") -> Column:
    """A, B, ... Z, AA, AB, ... for ranks from 0: digits of base 26 without a zero, from the last one."""
    digit = F.struct(F.lit("").alias("s"), rank.cast("long").alias("n"))
    step = lambda acc, _: F.when(acc["n"] < 0, acc).otherwise(F.struct(F.concat(F.chr(65 + F.pmod(acc["n"], F.lit(26))), acc["s"]).alias("s"), (F.floor(acc["n"] / 26) - 1).alias("n")))
    return F.concat(F.lit(prefix), F.aggregate(F.sequence(F.lit(1), F.lit(14)), digit, step)["s"])


def local_time(utc: Column, zone: str = P.ZONE) -> Column:
    """The clock of zone at a moment in UTC (both without a zone of their own)."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone)


def noon_of_day(utc: Column, zone: str = P.ZONE) -> Column:
    """The moment in UTC of noon on the local day."""
    return F.to_utc_timestamp(F.date_trunc("day", local_time(utc, zone)) + F.expr("interval 12 hours"), zone)


def token_expiry(due: Column, now: Column) -> Column:
    return F.coalesce(due, now + F.expr("interval 30 days"))


def size_text(size: Column) -> Column:
    """B, KB or MB, one decimal beyond bytes."""
    kb, mb = F.round(size / 1024, 1).cast("decimal(18,1)"), F.round(size / 1048576, 1).cast("decimal(18,1)")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(mb.cast("string"), F.lit(" MB")))


def extension_allowed(name: Column, language: Column) -> Column:
    """Whether a file may stand in a submission of that language; names without an extension may."""
    extension = F.lower(F.regexp_extract(basename(name), "([.][^.]*)$", 1))
    allowed = F.element_at(F.create_map(*[x for k, v in P.LANGUAGE_EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.lower(language))
    return (extension == "") | F.coalesce(F.array_contains(allowed, extension), F.lit(False))


def upload_allowed(name: Column, language: Column) -> Column:
    """Whether a file may be uploaded: for a known language archives only, whatever the case; for others anything."""
    known = F.lower(language).isin(*P.LANGUAGE_EXTENSIONS)
    return ~F.coalesce(known, F.lit(False)) | F.coalesce(F.endswith(F.lower(name), F.lit(".zip")), F.lit(False))


def season(day: Column) -> Column:
    month = F.month(day)
    return F.when(month <= 4, "Winter").when(month <= 7, "Summer").otherwise("Fall")


def term(start: Column, end: Column) -> Column:
    """The term or terms from start to end (local days)."""
    a, b, y, z = season(start), season(end), F.year(start).cast("string"), F.year(end).cast("string")
    return F.when((a == b) & (y == z), F.concat_ws(" ", a, y)).when(y == z, F.concat(a, F.lit("/"), b, F.lit(" "), y)).otherwise(F.concat(a, F.lit("/"), b, F.lit(" "), y, F.lit("-"), z))


def expiry_status(end_day: Column, now: Column) -> Column:
    """expiring_soon, null, grace_period or data_deleted, from the last second of end_day (local times)."""
    left = F.unix_timestamp(F.date_trunc("day", end_day)) + 86399 - F.unix_timestamp(now)
    days = F.floor(F.abs(left) / 86400)
    return F.when(left >= 0, F.when(days <= P.WARNING_DAYS, "expiring_soon")).when(left < 0, F.when(days <= P.GRACE_DAYS, "grace_period").otherwise("data_deleted"))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of text, from two digests over the padded key."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    padded = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in padded)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def submission_id(key: str, name: Column, number: Column, email: Column) -> Column:
    return F.substring(hmac_sha256(key, F.concat_ws(":", number, name, email)), 1, 16)


def slug_valid(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def strip_comments(source: Column) -> Column:
    """Block comments give way to their line ends, line comments to nothing."""
    pieces = F.regexp_extract_all(source, F.lit(r"(?s)/\*.*?\*/|/(?!\*)|[^/]+|/"), F.lit(0))
    kept = F.transform(pieces, lambda p: F.when(p.startswith("/*") & (F.length(p) > 3), F.regexp_replace(p, "[^\n]", "")).otherwise(p))
    return F.regexp_replace(F.array_join(kept, ""), "//[^\n]*", "")


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def readable_on(colour: Column) -> Column:
    """White or black text for a background #rrggbb."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    return F.when(0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6) < 140, "#ffffff").otherwise("#000000")
