"""Scalar functions over columns: names, paths, signatures, versions, times. All of them stay in the JVM."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of a file by its extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".php": "php", ".go": "go", ".rs": "rust", ".rb": "ruby", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin"}


def extension(path: str | Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language_of(path: str | Column) -> Column:
    """The language of the path's extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_snake(c: str | Column) -> Column:
    return F.rlike(c, F.lit("^[a-z][a-z0-9_]*$"))


def is_camel(c: str | Column) -> Column:
    return F.rlike(c, F.lit("^[A-Z][a-zA-Z0-9]*$"))


def to_snake(c: str | Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, "([A-Z]+)", "_$1")), F.lit("_"))


def to_camel(c: str | Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def normal_path(c: str | Column) -> Column:
    """Slashes forward, no leading ./ ."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def valid_path(c: str | Column) -> Column:
    """Not blank, no NUL or line end, at most three '..'."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.trim(c) != "") & ~c.contains("\n") & ~c.contains("\0") & (F.size(F.split(c, r"\.\.")) - 1 <= 3)


def url_owner(c: str | Column) -> Column:
    return F.regexp_extract(c, r"[:/]([^/:]+)/[^/]+?(?:\.git)?/?$", 1)


def url_name(c: str | Column) -> Column:
    return F.regexp_extract(c, r"/([^/]+?)(?:\.git)?/?$", 1)


def signature(name: str, parameters: str, returns: str) -> Column:
    """name(a: type = default, ...) -> type."""
    one = lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))
    args = F.array_join(F.transform(F.coalesce(F.col(parameters), F.array().cast("array<struct<name:string,type:string,default:string>>")), one), ", ")
    return F.concat(F.col(name), F.lit("("), args, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), F.col(returns)), F.lit("")))


def token_estimate(c: str | Column) -> Column:
    """Words times 1.3, as an integer."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return (words * 1.3).cast("int")


def location(c: str | Column) -> Column:
    """file[:line[:column]] as a struct; all null if a number is bad or there are more parts."""
    p = F.split(c, ":")
    n = F.size(p)
    line, col = F.expr("cast(null as int)"), F.expr("cast(null as int)")
    line = F.when(n >= 2, F.try_element_at(p, F.lit(2)).try_cast("int"))
    col = F.when(n >= 3, F.try_element_at(p, F.lit(3)).try_cast("int"))
    ok = (n <= 3) & ((n < 2) | line.isNotNull()) & ((n < 3) | col.isNotNull())
    return F.struct(F.when(ok, p[0]).alias("file"), F.when(ok, line).alias("line"), F.when(ok, col).alias("column"))


def relative_time(ts: Column, as_of: Column) -> Column:
    """just now, minutes, hours, days below 30, else the date; never for null."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    unit = lambda n, w: F.concat(n.cast("string"), F.lit(" " + w), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return F.when(ts.isNull(), "never").when(s < 60, "just now").when(s < 3600, unit(minutes, "minute")).when(s < 86400, unit(hours, "hour")).when(days < 30, unit(days, "day")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))


def sync_age(ts: Column, as_of: Column) -> Column:
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    d, h, m = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    text = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}s ago"))
    return F.when(ts.isNull(), "Never synced").when(d > 0, text(d, "day")).when(h > 0, text(h, "hour")).when(m > 0, text(m, "minute")).otherwise("Just now")


def version_struct(c: str | Column) -> Column:
    """major, minor, patch as integers; null where a part is no number."""
    p = F.split(c, r"\.")
    return F.struct(*[F.try_element_at(p, F.lit(i + 1)).try_cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def compare_versions(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1; a version that can't be read compares equal."""
    x, y = version_struct(a), version_struct(b)
    bad = F.lit(False)
    for n in ("major", "minor", "patch"):
        bad = bad | x[n].isNull() | y[n].isNull()
    return F.when(bad, 0).when(x < y, -1).when(x > y, 1).otherwise(0)


def char_similarity(a: str | Column, b: str | Column) -> Column:
    """Equal characters at the same place over the longer length; two empty texts are equal."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    most, least = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), F.lit(0), lambda n, i: n + F.when((i <= least) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), 1).otherwise(0))
    return F.when(most == 0, 1.0).otherwise(same / most)


def complexity_level(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c <= 10, "simple").when(c <= 20, "moderate").when(c <= 50, "complex").when(c.isNotNull(), "very complex")


def verify_signature(payload: bytes, header: str | None, secret: str | None) -> bool:
    """Whether header is sha256= and the payload's HMAC under the secret; without a secret everything passes."""
    if not secret:
        return True
    if not header or not header.startswith("sha256="):
        return False
    return hmac.compare_digest(hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest(), header[7:])


def error_response(message: Column, code: Column | None = None, details: Column | None = None) -> Column:
    """A struct (status, error, code, details) as every failed request returns it."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit("error").alias("status"), message.alias("error"), (none if code is None else code).alias("code"), (none if details is None else details).alias("details"))


def relative_module(path: str | Column, dots: Column, name: Column) -> Column:
    """The module that a relative import with so many dots names from the file at path: one dot is the file's package."""
    parts = F.split(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0))), ".")
    return F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(name, F.lit("")))


def iso(ts: Column) -> Column:
    """The time in ISO 8601 with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(c: Column) -> Column:
    """The naive time in UTC of an ISO 8601 text; without an offset it is UTC already, null if it can't be read."""
    return F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
