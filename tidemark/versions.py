"""Committed versions of stored tables.

Every append is a batch: a folder ``batch=<name>`` below its day and server (below the table for dimensions).  A table's
version is a short list of commits; a commit names batch folders that are gone and batches that were added in one
step, and is made by creating a file that must not be there.  Of a batch the first letters of its name say when it shows:

* ``c-``: a rewrite or a bulk append, shown once a commit adds it;
* ``s-<snapid>``: facts of one snapshot, shown at once and read by reports when the snapshot is published;
* any other: a delivery of a stream, which replaces itself, or one file of a dimension.

A rewrite reads a list of batch folders, writes one new batch and commits "these are gone, this is added".  What others
append meanwhile is another batch, so it stays; a commit that another rewrite overtook is refused and done again.
A reader takes the commits first and lists files after that, so it sees one version whole; folders that are gone
are removed only after a grace period.  Needs a file system whose rename is atomic and refuses an existing target.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

LOG = "_commits"
COMMITTED = "c-"
SNAPSHOT = "s-"
GRACE = 6 * 3600  # seconds that folders and commits outlive their use


@dataclass(frozen=True)
class Version:
    number: int = 0
    gone: frozenset[str] = frozenset()  # batch folders below the table
    added: frozenset[str] = frozenset()  # names of committed batches

    def shows(self, folder: str) -> bool:
        name = folder.rsplit("batch=", 1)[1]
        return folder not in self.gone and (not name.startswith(COMMITTED) or name in self.added)

    def visible(self, columns: Iterable[str]) -> Column:
        """The same on partition columns, so hidden folders are pruned before they are read."""
        batch = F.col("batch")
        shown = ~batch.startswith(COMMITTED)
        if self.added:
            shown = shown | batch.isin(*sorted(self.added))
        if self.gone:
            parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("date", "server", "batch") if c in columns]
            shown = shown & ~F.concat_ws("/", *parts).isin(*sorted(self.gone))
        return shown


def open_path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, location: str) -> str | None:
    """Content of a small file; null where it is not there."""
    fs, path = open_path(spark, location)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, location: str, text: str) -> bool:
    """Create a file with its whole content unless it is there; of several writers one succeeds."""
    fs, path = open_path(spark, location)
    draft = open_path(spark, f"{path.getParent().toString()}/.{uuid.uuid4().hex}")[1]
    fs.mkdirs(path.getParent())
    out = fs.create(draft, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(path) and fs.rename(draft, path)
        try:  # Hadoop's local rename replaces its target
            os.link(draft.toUri().getPath(), path.toUri().getPath())
        except FileExistsError:
            return False
        return True
    finally:
        fs.delete(draft, False)


def names(spark: SparkSession, location: str) -> list[str]:
    fs, path = open_path(spark, location)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _entry(number: int, kind: str = "json") -> str:
    return f"{number:020d}.{kind}"


def current(spark: SparkSession, root: str, table: str) -> Version:
    """The version that holds now: the last folded state and the commits after it."""
    while True:
        found = names(spark, f"{root}/{LOG}/{table}")
        folded = [n for n in found if n.endswith(".all")]
        state = folded[-1] if folded else None
        start = int(state.split(".")[0]) if state else 0
        wanted = ([state] if state else []) + [n for n in found if n.endswith(".json") and int(n.split(".")[0]) > start]
        texts = [read_text(spark, f"{root}/{LOG}/{table}/{n}") for n in wanted]
        if None in texts:
            continue  # folded meanwhile
        gone, added = set(), set()
        for text in texts:
            step = json.loads(text)
            gone.update(step["gone"])
            added.update(step["added"])
        return Version(int(wanted[-1].split(".")[0]) if wanted else 0, frozenset(gone), frozenset(added))


def commit(spark: SparkSession, root: str, table: str, gone: Iterable[str] = (), added: Iterable[str] = ()) -> bool:
    """Take folders away and add batches in one step; refused if another commit took one of the folders before."""
    gone, added = sorted(gone), sorted(added)
    text = json.dumps({"at": time.time(), "gone": gone, "added": added})
    while True:
        version = current(spark, root, table)
        if version.gone.intersection(gone):
            return False
        if create(spark, f"{root}/{LOG}/{table}/{_entry(version.number + 1)}", text):
            return True


def batches(spark: SparkSession, root: str, table: str, folder: str = "") -> list[str]:
    """Batch folders of a table, or of one of its day or server folders, as paths below the table."""
    if folder.rsplit("/", 1)[-1].startswith("batch="):
        return [folder]
    out = []
    for name in names(spark, f"{root}/{table}/{folder}".rstrip("/")):
        if name.startswith(("date=", "server=", "batch=")):
            out += batches(spark, root, table, f"{folder}/{name}".lstrip("/"))
    return out


def live(spark: SparkSession, root: str, table: str, folder: str = "") -> list[str]:
    version = current(spark, root, table)
    return [b for b in batches(spark, root, table, folder) if version.shows(b)]


def new_batch() -> str:
    return f"{COMMITTED}{uuid.uuid4().hex}"


def read(spark: SparkSession, root: str, table: str, folders: list[str]) -> DataFrame:
    """Rows of the given batch folders, with their partition columns."""
    reader = spark.read.schema(schemas.stored_struct(table)).option("basePath", f"{root}/{table}")
    return reader.parquet(*[f"{root}/{table}/{f}" for f in folders])


def write(rows: DataFrame, root: str, table: str) -> None:
    """Write rows that bear their partition columns as whole batch folders.

    Spark stages such a write under a name of its own and moves finished folders into place, so writers of one table do
    not touch each other's files, a batch shows with all its files, and one that is written again replaces itself.
    """
    folders = [c for c in ("date", "server", "batch") if c in rows.columns]
    writer = rows.write.partitionBy(*folders).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{root}/{table}")


def vacuum(spark: SparkSession, root: str, table: str, grace: float = GRACE) -> list[str]:
    """Remove folders that have been gone for ``grace`` seconds and batches of that age that were never committed.

    The commits so far are folded into one state without what no longer exists.  Returns the removed folders.
    """
    version = current(spark, root, table)
    if not version.number:
        return []
    folder, limit = f"{root}/{LOG}/{table}", time.time() - grace
    recent = set()
    listed = names(spark, folder)
    for name in listed:
        if name.endswith(".json"):
            step = json.loads(read_text(spark, f"{folder}/{name}") or '{"at": 0, "gone": []}')
            if step["at"] > limit:
                recent.update(step["gone"])
    removed, there = [], batches(spark, root, table)
    for batch in there:
        fs, path = open_path(spark, f"{root}/{table}/{batch}")
        pending = batch not in version.gone and not version.shows(batch)
        if (batch in version.gone and batch not in recent) or (pending and fs.getFileStatus(path).getModificationTime() / 1000 < limit):
            fs.delete(path, True)
            removed.append(batch)
    kept = set(there) - set(removed)
    held = {b.rsplit("batch=", 1)[1] for b in kept}
    state = {"at": time.time(), "gone": sorted(version.gone & (kept | recent)), "added": sorted(version.added & held)}
    create(spark, f"{folder}/{_entry(version.number, 'all')}", json.dumps(state))
    fs = open_path(spark, folder)[0]
    for name in listed:  # readers and writers of older lists have had their time
        path = open_path(spark, f"{folder}/{name}")[1]
        if int(name.split(".")[0]) < version.number and fs.getFileStatus(path).getModificationTime() / 1000 < limit:
            fs.delete(path, False)
    return removed
