"""Scalar rules as columns: URIs, patterns, sizes, retries, strategies, queue depths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.model import INVALID_CODE, MESSAGES, STRATEGIES

URI = r"^(s3|gs|az)://([^/]+)/(.+)$"
WEB_URI = r"^(https?)://([^/]+)/(.+)$"


def glob_regex(pattern: str) -> str:
    """An anchored regex for a shell pattern: * and ? also match slashes, [!x] is any but x, an open [ is itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            no, body = ("^", body[1:]) if body[0] == "!" else ("", body)
            out.append("[" + no + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s/-])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(subject: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [subject.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def allowed(subject: Column, allow: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """allow None: all; an empty list: nothing. ignore is applied after it. Keys that end in a slash are folders, and go."""
    keep = ~subject.endswith("/")
    if allow is not None:
        keep = keep & matches_any(subject, allow)
    return keep & ~matches_any(subject, ignore or [])


def uri_parts(uri: Column, pattern: str = URI) -> tuple[Column, Column, Column]:
    """Scheme, bucket or host, and key; empty where the uri doesn't fit."""
    return tuple(F.regexp_extract(uri, pattern, k) for k in (1, 2, 3))


def scheme_of(path: str) -> str:
    """The storage scheme of a path; a plain path is a file."""
    scheme, sign, _ = path.partition("://")
    return scheme.lower() if sign else "file"


def number_setting(name: str, raw: str | None, default: float, least: float | None = None, most: float | None = None, above: float | None = None, kind=int):
    """A numeric setting's value; the error names the setting and its range."""
    if raw is None:
        return default
    bounds = [f"at least {least}"] * (least is not None) + [f"above {above}"] * (above is not None) + [f"at most {most}"] * (most is not None)
    try:
        value = kind(str(raw).strip())
    except ValueError:
        raise ValueError(f"{name} must be a number, not {raw!r}") from None
    if not (least is None or value >= least) or not (above is None or value > above) or not (most is None or value <= most):
        raise ValueError(f"{name} must be {' and '.join(bounds)}, not {raw!r}")
    return value


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def padded_cursor(cursor: Column, block: int) -> Column:
    """The cursor moved up to the next multiple of block."""
    return cursor + F.pmod(-cursor, F.lit(block))


def human_size(size: Column) -> Column:
    rows = F.when(size >= 2**30, F.concat(F.format_number(size / 2**30, 1), F.lit(" GiB"))).when(size >= 2**20, F.concat(F.format_number(size / 2**20, 1), F.lit(" MiB")))
    return rows.when(size >= 2**10, F.concat(F.format_number(size / 2**10, 1), F.lit(" KiB"))).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def response_text(code: Column) -> Column:
    known = F.array(*[F.lit(x) for x in MESSAGES])
    return F.when((code >= 0) & (code < len(MESSAGES)), F.get(known, code)).otherwise(INVALID_CODE)


def retry_delay_bound_ms(attempt: Column) -> Column:
    """100, 200, 400, 800, then 1000 ms: the upper bound of the random wait before the nth retry."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(4)).cast("int")
    return F.least(F.lit(1000).cast("bigint"), F.lit(100).cast("bigint") * F.pow(F.lit(2), power).cast("bigint"))


def may_begin(retries: Column, now_ms: Column, first_ms: Column, timeout_ms: Column) -> Column:
    """The first attempt always; later ones only with a timeout and before the deadline, counted from the first attempt."""
    return (retries == 0) | ((timeout_ms > 0) & (now_ms < first_ms + timeout_ms))


def may_schedule(delay_ms: Column, now_ms: Column, first_ms: Column, timeout_ms: Column) -> Column:
    deadline = first_ms + timeout_ms
    return (timeout_ms > 0) & (now_ms < deadline) & (now_ms + delay_ms < deadline)


def retryable(status: Column, fatal_error: Column, hint: Column) -> Column:
    """status below 0: no HTTP answer, retryable unless the client's own error is fatal."""
    rows = F.when(status < 0, ~fatal_error).when(status >= 500, F.lit(True))
    return rows.when((status >= 400) & (status < 500), status.isin(408, 429)).otherwise(hint)


def parse_strategies(text: str) -> list[str]:
    names = [x.strip(" \t") for x in text.split(",")]
    if bad := [x for x in names if x not in STRATEGIES]:
        raise ValueError(f"unknown or empty strategy in {text!r}: {bad}")
    if len(set(names)) < len(names):
        raise ValueError(f"a strategy is named twice in {text!r}")
    return names


def first_available(candidates: DataFrame) -> DataFrame:
    """candidates: request_id, position, name, available. The first available one of each request, or null."""
    return candidates.groupBy("request_id").agg(F.min_by("name", F.when(F.col("available"), F.col("position"))).alias("strategy"))


def parse_queue_depth(text: str) -> tuple[int, list[tuple[str, int]]]:
    """'64,nfs=32': the default, then depths by type of file system."""
    first, *rest = [x.strip() for x in text.split(",")]

    def count(x: str) -> int:
        if not x.isascii() or not x.isdigit() or int(x) < 1:
            raise ValueError(f"{x!r} in {text!r} is not a positive number")
        return int(x)

    entries = []
    for x in rest:
        kind, sign, value = x.partition("=")
        kind = kind.strip().lower()
        if not sign or not kind or kind in dict(entries):
            raise ValueError(f"{x!r} in {text!r} is not a new <type>=<number>")
        entries.append((kind, count(value.strip())))
    return count(first), entries


def queue_depths(types: DataFrame, text: str) -> DataFrame:
    """types: fs_type. depth: of the first entry that the type begins with, else the default."""
    default, entries = parse_queue_depth(text)
    found = [F.when(F.lower("fs_type").startswith(kind), F.lit(n)) for kind, n in entries]
    return types.withColumn("depth", F.coalesce(*found, F.lit(default)))
