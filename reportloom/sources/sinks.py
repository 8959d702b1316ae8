"""Stores of documents in versions: a write adds files and then becomes visible at once.

A store is a folder::

    versions/<name>/rows         the rows that one write brought
    versions/<name>/documents    the ids that it speaks for, those without rows too
    snapshots/<n>.json           the versions that make up the n-th state, oldest first

A write puts its own rows and ids into a new version, which nobody reads yet, and then
renames a snapshot into place, which fails if another writer has taken the number; then it
goes on from that one's state. So a crash at any step leaves the state before or the one
after, and a batch writes its own rows alone, however large the store is. A document's rows
are those of the newest version that speaks for it. ``compact`` writes a state as one
version, ``vacuum`` deletes what the newest state doesn't hold.

Renaming must be atomic and fail on an existing target, as it does and is on HDFS and local
disks; object stores need a committer in front that makes it so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "v1"
#: What a raw document may bring along for its analysis.
ABOUT = ["original_file_name", "manufacturer", "period_month", "period_year", "custom_instructions"]


class _Folder:
    """The few file operations that a store needs, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.at(name))] if self.files.exists(self.at(name)) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self.files.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def take(self, old: str, new: str) -> bool:
        """Renames unless ``new`` is there already."""
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        try:
            context.rename(self.files.makeQualified(self.at(old)), self.files.makeQualified(self.at(new)), options)
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.files.delete(self.at(name), True)


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest state: its number (0: nothing yet) and its versions."""
    folder = _Folder(spark, path)
    numbers = [int(n.removesuffix(".json")) for n in folder.names("snapshots") if n.removesuffix(".json").isdigit()]
    newest = max(numbers, default=0)
    return newest, json.loads(folder.text(f"snapshots/{newest}.json")) if newest else []


def _commit(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> int:
    folder = _Folder(spark, path)
    while True:
        number, versions = snapshot(spark, path)
        draft = f"snapshots/.draft-{uuid.uuid4().hex}"
        folder.put(draft, json.dumps(change(versions)))
        if folder.take(draft, f"snapshots/{number + 1}.json"):
            return number + 1
        folder.drop(draft)  # another writer was first


def _versions(spark: SparkSession, path: str, names: list[str], part: str) -> DataFrame:
    frame = spark.read.option("mergeSchema", "true").parquet(*(f"{path.rstrip('/')}/versions/{n}/{part}" for n in names))
    order = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))))
    return frame.withColumn("_at", F.element_at(order, F.col("_version"))).drop("_version")


def read(spark: SparkSession, path: str, key: str = "doc_id", number: int | None = None) -> DataFrame | None:
    """The rows of a store's newest state (or of an earlier one's number), or None where nothing has been written yet.

    Only ids of later writes are looked at to tell which rows still hold; a store that has
    been compacted is read as it lies.
    """
    newest, names = snapshot(spark, path)
    if number is not None and newest:
        newest, names = number, json.loads(_Folder(spark, path).text(f"snapshots/{number}.json"))
    if not newest:
        return None
    rows = _versions(spark, path, names, "rows")
    if len(names) == 1:
        return rows.drop("_at")
    later = _versions(spark, path, names, "documents").where("_at > 0").groupBy(F.col(key).alias("_key")).agg(F.max("_at").alias("_last"))
    held = rows.join(later, rows[key].eqNullSafe(F.col("_key")), "left").where("_last IS NULL OR _last = _at")
    return held.drop("_key", "_last", "_at")


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id", of: DataFrame | None = None) -> int:
    """Rows of the documents ``of`` (by default those in ``rows``) replace those documents' rows and no others.

    A document of ``of`` without rows loses its old ones. A new column of ``rows`` is null
    in old rows, a missing one null in new ones. Returns the number of the new state.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    place = f"{path.rstrip('/')}/versions/{name}"
    rows.withColumn("_version", F.lit(name)).write.parquet(f"{place}/rows")
    ids = spark.read.parquet(f"{place}/rows") if of is None else of
    ids.select(key).distinct().withColumn("_version", F.lit(name)).write.parquet(f"{place}/documents")
    return _commit(spark, path, lambda versions: [*versions, name])


def delete_documents(ids: DataFrame, *paths: str, key: str = "doc_id") -> None:
    """All rows of the documents in every store: raw, canonical, status."""
    for path in paths:
        if (held := read(ids.sparkSession, path, key)) is not None:
            replace_documents(held.where("false"), path, key, ids)


def compact(spark: SparkSession, path: str, key: str = "doc_id") -> int:
    """The newest state as one version; what others write meanwhile stays on top of it."""
    number, names = snapshot(spark, path)
    if len(names) < 2:
        return number
    name = uuid.uuid4().hex
    place = f"{path.rstrip('/')}/versions/{name}"
    read(spark, path, key, number).withColumn("_version", F.lit(name)).write.parquet(f"{place}/rows")
    spark.read.parquet(f"{place}/rows").select(key).distinct().withColumn("_version", F.lit(name)).write.parquet(f"{place}/documents")

    def change(versions: list[str]) -> list[str]:
        if versions[: len(names)] != names:
            raise RuntimeError(f"{path} was compacted by another writer.")
        return [name, *versions[len(names) :]]

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes earlier states and versions that the newest doesn't hold, failed writes' too; none may be at work then."""
    number, names = snapshot(spark, path)
    folder = _Folder(spark, path)
    for n in folder.names("snapshots"):
        if n != f"{number}.json":
            folder.drop(f"snapshots/{n}")
    for n in folder.names("versions"):
        if n not in names:
            folder.drop(f"versions/{n}")


def write_sales(sales: DataFrame, path: str, of: DataFrame | None = None) -> None:
    """Canonical rows with their schema version; a document that comes again replaces its rows."""
    replace_documents(sales.withColumn("schema_version", F.lit(SCHEMA_VERSION)), path, of=of)


def write_raw(raw: DataFrame, path: str) -> None:
    """Envelopes as they came (doc_id, raw_json, what is known about them): kept, so that a document can be analysed again without its source."""
    about = [c for c in ABOUT if c in raw.columns]
    replace_documents(raw.select("doc_id", "raw_json", *about, F.current_timestamp().alias("extracted_ts")), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
