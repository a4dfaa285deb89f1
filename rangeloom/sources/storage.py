"""Ranged reads for a data source's workers: local files, and any file system that pyarrow knows."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Callable

import pyarrow.fs as fs
from pyspark.sql import SparkSession

from rangeloom.model import CREDENTIALS_SET, END_OF_FILE, FILE_ACCESS, MESSAGES

Read = Callable[[int, int], bytes]


class ReadError(OSError):
    """A read that failed for good. code is what a caller sees of it: a failure that could have been tried again leaves as
    file access error, so the retryable code stays inside. All ranges of the read fail with it."""

    def __init__(self, code: int, path: str, why: object):
        super().__init__(f"{path}: {MESSAGES[code]} ({why})")
        self.code = code


# Settings of the file systems that a credential goes to, Spark's and the workers'.
CREDENTIALS = {
    "access_key": ("fs.s3a.access.key", "AWS_ACCESS_KEY_ID"),
    "secret_key": ("fs.s3a.secret.key", "AWS_SECRET_ACCESS_KEY"),
    "session_token": ("fs.s3a.session.token", "AWS_SESSION_TOKEN"),
    "region": ("fs.s3a.endpoint.region", "AWS_DEFAULT_REGION"),
    "endpoint": ("fs.s3a.endpoint", "AWS_ENDPOINT_URL"),
}


def set_credentials(spark: SparkSession, **values: str) -> None:
    """Credentials of a Spark application, set once: Spark's readers and the workers of this package use them. The same values
    again are fine, others are refused."""
    if unknown := sorted(set(values) - set(CREDENTIALS)):
        raise ValueError(f"unknown credentials {unknown}; there are {sorted(CREDENTIALS)}")
    digest = hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()
    system = spark._jsc.hadoopConfiguration()
    if (before := system.get("rangeloom.credentials")) is not None:
        if before != digest:
            raise PermissionError(MESSAGES[CREDENTIALS_SET])
        return
    for name, value in values.items():
        setting, variable = CREDENTIALS[name]
        system.set(setting, value)
        spark.sparkContext.environment[variable] = os.environ[variable] = value
    system.set("rangeloom.credentials", digest)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(paths: list[str]) -> list[str]:
    """Files as they are; folders give their *.safetensors files, sorted, without going deeper."""
    out = []
    for path in paths:
        system, inner = located(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.Directory:
            own = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name.endswith(".safetensors") and not x.base_name.startswith(".")]
            scheme = path[: path.index("://") + 3] if "://" in path else ""
            out += [scheme + x for x in sorted(own)]
        else:
            out.append(path)
    return out


def length_of(path: str) -> int:
    system, inner = located(path)
    return system.get_file_info(inner).size


def retry_wait(attempt: int) -> float:
    """Seconds before the nth retry: random, up to 0.1 s doubled each time, 1 s at most."""
    return random.uniform(0, min(1.0, 0.1 * 2 ** min(max(attempt - 1, 0), 4)))


def reader(path: str, retry_seconds: float = 0) -> tuple[Read, Callable[[], None]]:
    """(read, close). A failed read, one chunk of ranges beside each other, is tried again as a whole until retry_seconds after
    its first attempt; 0: never. Then all of it fails with the code of a file access error."""
    system, inner = located(path)
    handle = system.open_input_file(inner)

    def read(offset: int, size: int) -> bytes:
        deadline, attempt = time.monotonic() + retry_seconds, 0
        while True:
            try:
                data = handle.read_at(size, offset)
                break
            except OSError as e:
                attempt += 1
                wait = retry_wait(attempt)
                if time.monotonic() + wait >= deadline:
                    raise ReadError(FILE_ACCESS, path, e) from e
                time.sleep(wait)
        return bytes(data)

    return read, handle.close


def exact(read: Read, offset: int, size: int, path: str) -> bytes:
    data = read(offset, size) if size else b""
    if len(data) != size:
        raise EOFError(f"{path}: {MESSAGES[END_OF_FILE]}, {len(data)} of {size} bytes at {offset}")
    return data
