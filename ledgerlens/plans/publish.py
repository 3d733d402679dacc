"""Atomic publication: readers get the old version whole until the new one is whole.

A published path is a folder of versions. ``publish`` writes a version's files into a new folder, then a small manifest
``_versions/<number>`` that names it. The manifest is written under another name and renamed, which is one step on
a shared file system, and fails if another writer has taken the number: it then takes the next. Readers ``resolve`` the
path to the folder that the highest manifest names. So a reader during a rewrite, or after a write that failed, gets
the last version that was finished. The versions before it are kept for readers that have begun (``KEPT``).

A path without manifests is an ordinary folder or file, and resolves to itself.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Versions that stay; seconds after which a folder that no manifest names counts as left behind by a failed write.
KEPT, LEFT_AFTER = 2, 24 * 3600
_MANIFESTS = "_versions"
_NUMBER = re.compile(r"^\d{12}$")


class _Files:
    """The few calls to the path's file system that are needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def list(self, p: str) -> list:
        path = self.path(p)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        """False if there is something at ``b``."""
        return not self.fs.exists(self.path(b)) and self.fs.rename(self.path(a), self.path(b))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def _numbers(files: _Files, root: str) -> list[int]:
    names = [s.getPath().getName() for s in files.list(f"{root}/{_MANIFESTS}")]
    return sorted(int(n) for n in names if _NUMBER.match(n))


def _manifest(files: _Files, root: str, number: int) -> dict:
    return json.loads(files.read(f"{root}/{_MANIFESTS}/{number:012d}"))


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the last version: ``folder``, and what the writer has put in; None if nothing is published."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    for _ in range(5):  # the manifest may be removed between listing and reading, by the writer of two newer ones
        numbers = _numbers(files, root)
        if not numbers:
            return None
        try:
            return _manifest(files, root, numbers[-1])
        except Exception:
            if numbers == _numbers(files, root):
                raise
    raise RuntimeError(f"{root} is published faster than it can be read")


def resolve(spark: SparkSession, path: str) -> str:
    """The folder that a reader of ``path`` reads: the last version's, or ``path`` itself if it isn't published."""
    now = current(spark, path)
    return path if now is None else f"{path.rstrip('/')}/{now['folder']}"


def commit(spark: SparkSession, root: str, folder: str, **more) -> int:
    """Make ``folder`` (a name in ``root``) the current version; ``more`` goes into the manifest."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    draft = f"{root}/{_MANIFESTS}/.draft-{uuid.uuid4().hex}"
    files.write(draft, json.dumps({"folder": folder, **more}))
    number = max(_numbers(files, root), default=0) + 1
    while not files.rename(draft, f"{root}/{_MANIFESTS}/{number:012d}"):
        number = max([number, *_numbers(files, root)]) + 1
    return number


def prune(spark: SparkSession, root: str, kept: int = KEPT, used: Callable[[dict], set[str]] = lambda m: {m["folder"]}) -> None:
    """Remove all but the last ``kept`` manifests, the folders that only removed ones use, and folders of failed writes."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    numbers = _numbers(files, root)
    old, live = numbers[:-kept], numbers[-kept:]
    needed = set().union(*(used(_manifest(files, root, n)) for n in live))
    gone = set().union(*(used(_manifest(files, root, n)) for n in old)) - needed
    for n in old:
        files.delete(f"{root}/{_MANIFESTS}/{n:012d}")
    for s in files.list(root):
        name = s.getPath().getName()
        left = name.startswith("v-") and name not in needed and s.getModificationTime() / 1000 < time.time() - LEFT_AFTER
        if name in gone or left:
            files.delete(f"{root}/{name}")


def new_folder() -> str:
    return f"v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None], kept: int = KEPT) -> str:
    """``write`` gets an empty folder's path and writes the new version there. If it raises, readers keep the old one."""
    path, folder = path.rstrip("/"), new_folder()
    try:
        write(f"{path}/{folder}")
    except BaseException:
        _Files(spark, path).delete(f"{path}/{folder}")
        raise
    commit(spark, path, folder)
    prune(spark, path, kept)
    return f"{path}/{folder}"
