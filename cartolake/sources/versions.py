"""Versions of the persisted catalog: written beside each other, published by one small file.

A version's datasets are complete before its manifest appears, and no version is ever
written twice: a reader sees a whole catalog, and keeps it while newer ones are written.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cartolake import schema as S
from cartolake.sources.bundle import PARTS, Bundle, BundleIntegrityError, BundleVersionError, check_integrity
from cartolake.schema import BUNDLE_VERSION, TABLE_KEY

MANIFESTS = "_published"
_NAME = re.compile(r"(\d{12})\.json")


class PublishConflict(Exception):
    """Another writer published a version meanwhile."""


class _Files:
    """The few file operations a pointer needs, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/{MANIFESTS}")
        if not self.fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self.fs.listStatus(folder))
        return sorted(int(m.group(1)) for m in map(_NAME.fullmatch, names) if m)

    def has(self, number: int) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{MANIFESTS}/{number:012d}.json"))

    def manifest(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.path}/{MANIFESTS}/{number:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as exc:
            raise BundleIntegrityError(f"manifest {number} is no JSON") from exc

    def publish(self, number: int, content: dict) -> None:
        """Write the manifest under another name, then give it its own: it is there whole or not at all."""
        target = self._path(f"{self.path}/{MANIFESTS}/{number:012d}.json")
        draft = self._path(f"{self.path}/{MANIFESTS}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            moved = not self.fs.exists(target) and self.fs.rename(draft, target)
        except Py4JJavaError:
            moved = False
        if not moved:
            self.fs.delete(draft, False)
            raise PublishConflict(f"version {number} is published already")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)


def write_version(bundle: Bundle, path: str, *, after: int | None = None) -> int:
    """Store a catalog as a new version and publish it; returns its number.

    With ``after`` the version is published only if that is still the latest one, else
    ``PublishConflict`` is raised; what was written stays unpublished and no reader sees it.
    """
    spark = bundle.meta.sparkSession
    files = _Files(spark, path)
    folder = f"v-{uuid.uuid4().hex}"
    for name in [*PARTS, "meta"]:
        getattr(bundle, name).write.mode("errorifexists").parquet(f"{path}/{folder}/{name}")
    numbers = files.numbers()
    latest = numbers[-1] if numbers else 0
    if after is not None and latest != after:
        raise PublishConflict(f"the latest version is {latest}, not {after}")
    files.publish(latest + 1, {"folder": folder, "schema_version": BUNDLE_VERSION, "number": latest + 1})
    return latest + 1


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    return _Files(spark, path).numbers()


def _checked(spark: SparkSession, folder: str, name: str, ddl: str) -> DataFrame:
    """A stored dataset, if it has the columns and types it must have."""
    try:
        found = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as exc:
        raise BundleIntegrityError(f"{name}: {str(exc).splitlines()[0]}") from exc
    have = {f.name: f.dataType for f in found.schema.fields}
    wanted = T.StructType.fromDDL(ddl)
    wrong = [f.name for f in wanted.fields
             if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise BundleIntegrityError(f"{name}: missing or of another type: {', '.join(wrong)}")
    return found.select(*[f"`{f.name}`" for f in wanted.fields])


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Bundle | None:
    """The latest version, or the one with that number; None where nothing is published.

    Shapes, the schema version and the match of tables and descriptions are checked.
    """
    files = _Files(spark, path)
    numbers = files.numbers()
    if not numbers or (number is not None and number not in numbers):
        return None
    manifest = files.manifest(numbers[-1] if number is None else number)
    if manifest.get("schema_version") != BUNDLE_VERSION:
        raise BundleVersionError(f"expected version {BUNDLE_VERSION}, found {manifest.get('schema_version')}")
    if not isinstance(manifest.get("folder"), str):
        raise BundleIntegrityError("the manifest names no folder")
    folder = f"{path}/{manifest['folder']}"
    meta = _checked(spark, folder, "meta", S.META)
    if len(meta.take(2)) != 1:
        raise BundleIntegrityError("meta must hold one row")
    parts = {name: _checked(spark, folder, name, ddl) for name, ddl in PARTS.items()}
    problems = check_integrity(parts["tables"], parts["table_descriptions"])
    examples = problems.orderBy("problem", *TABLE_KEY).take(10)
    if examples:
        error = BundleIntegrityError(", ".join(f"{r['problem']}: {r['schema']}.{r['table']}" for r in examples))
        error.problems = problems
        raise error
    return Bundle(meta=meta, **parts)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the last ``keep`` versions, manifest first; returns the numbers that went.

    A reader that still uses a removed version loses its files: keep as many as readers may hold.
    """
    if keep < 1:
        raise ValueError(f"keep must be at least 1, got {keep}")
    files = _Files(spark, path)
    gone = files.numbers()[:-keep]
    for number in gone:
        folder = files.manifest(number)["folder"]
        files.remove(f"{MANIFESTS}/{number:012d}.json")
        files.remove(folder)
    return gone
