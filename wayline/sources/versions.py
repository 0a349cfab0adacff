"""Versions of a table, claimed one after the other.

A writer first writes a folder of its own and then *claims* the next number for
it by creating a file of that name, which fails if another writer has been
quicker.  So a writer that says which version it started from finds out that
someone else has written since, and no edit is lost.  The largest number is
what counts; the catalog is brought to point at its folder.

Creating a file only if there is none has to be atomic, as on HDFS and on
stores with conditional writes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from wayline.sources import files

FOLDER, CLAIM = "version-", "claim-"


class VersionConflict(RuntimeError):
    """The contents have been replaced since the version that was read."""


@dataclass(frozen=True)
class Version:
    """A claimed number and the folder it stands for; number 0 is before any claim."""

    number: int
    folder: str | None


def new_folder(root: str) -> str:
    return f"{root.rstrip('/')}/{FOLDER}{uuid.uuid4().hex}"


def _text(spark: SparkSession, path) -> str:
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _claims(spark: SparkSession, root: str) -> list[tuple[int, object]]:
    """Claimed numbers with their files, the newest first."""
    found = [(int(f.getPath().getName().removeprefix(CLAIM)), f.getPath())
             for f in files.listed(spark, root, CLAIM)]
    return sorted(found, key=lambda c: -c[0])


def newest(spark: SparkSession, root: str) -> Version:
    """The version that counts.  A claim whose writer died before naming its folder doesn't."""
    for number, path in _claims(spark, root):
        name = _text(spark, path)
        if name:
            return Version(number, f"{root.rstrip('/')}/{name}")
    return Version(0, None)


def _create(spark: SparkSession, root: str, number: int, folder: str) -> bool:
    at, system = files.at(spark, f"{root.rstrip('/')}/{CLAIM}{number:012d}")
    try:
        stream = system.create(at, False)
    except Py4JJavaError:
        if system.exists(at):
            return False
        raise
    stream.writeBytes(folder.rsplit("/", 1)[1])
    stream.close()
    return True


def claim(spark: SparkSession, root: str, folder: str, expected: int | None = None) -> Version:
    """Make ``folder`` the next version.

    With ``expected``, that has to be the version that counts now; otherwise the
    claim comes after whatever others have claimed.
    """
    if expected is not None:
        now = newest(spark, root).number
        last = max([now, *(n for n, _ in _claims(spark, root))])
        if now != expected or not _create(spark, root, last + 1, folder):
            raise VersionConflict(f"version {expected} of {root} has been replaced")
        return Version(last + 1, folder)
    while True:
        number = max([0, *(n for n, _ in _claims(spark, root))]) + 1
        if _create(spark, root, number, folder):
            return Version(number, folder)


def folders(spark: SparkSession, root: str) -> list[str]:
    """All version folders, claimed or not, oldest first."""
    found = sorted(files.listed(spark, root, FOLDER), key=lambda f: f.getModificationTime())
    return [f.getPath().toString() for f in found]


def remove_old(spark: SparkSession, root: str, keep_days: float, in_use: str | None = None) -> list[str]:
    """Delete folders older than ``keep_days`` that nothing points at, and their claims.

    What counts, what it replaced, and ``in_use`` stay, whatever their age; so do
    younger folders, which another writer may be filling or a reader reading.
    """
    claims = [(n, p, _text(spark, p)) for n, p in _claims(spark, root)]
    named = [c for c in claims if c[2]]
    kept = {name for _, _, name in named[:2]} | {(in_use or "").rstrip("/").rsplit("/", 1)[-1]}
    gone = files.remove_unused(spark, root, FOLDER, kept, keep_days)
    lowest = min((n for n, _, _ in named[:2]), default=0)
    for number, path, name in claims:
        if number < lowest and (name in gone or not name):
            files.delete(spark, path.toString())
    return gone
