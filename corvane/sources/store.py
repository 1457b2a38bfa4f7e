"""A workspace as versions of Parquet tables, with a pointer to the current one.

A version is written whole beside the others and named by one small file, so readers see the
old or the new one and nothing between.  Files are reached through Spark's file systems only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

TABLES = {
    "documents": schemas.DOCUMENT, "chunks": schemas.CHUNK, "entities": schemas.ENTITY, "relations": schemas.RELATION, "vectors": schemas.VECTOR,
    "document_status": schemas.STATUS, "chunk_snapshots": schemas.CHUNK_SNAPSHOT, "journals": schemas.JOURNAL, "llm_cache": "id string, value string", "task_events": schemas.TASK_EVENT,
}


class WorkspaceStore:
    """The tables of one workspace under root/workspace_id."""

    def __init__(self, spark: SparkSession, root: str, workspace_id: str = "default"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{workspace_id}"
        self.pin: int | None = None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str, text: str) -> bool:
        """A new file, written aside and renamed into place; false where another writer was first.  Files are never replaced."""
        aside, to = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(to) and self._fs.rename(aside, to):
            return True
        self._fs.delete(aside, False)
        return False

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def _numbers(self, folder: str) -> list[int]:
        path = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _next(self, folder: str, text: Callable[[int], str]) -> int:
        """The next numbered file of a folder."""
        while True:
            n = max(self._numbers(folder), default=0) + 1
            if self._place(f"{folder}/{n:09d}.json", text(n)):
                return n

    def versions(self) -> list[int]:
        return self._numbers("versions")

    def _tables(self, version: int | None) -> dict[str, str]:
        return json.loads(self._read_text(f"versions/{version:09d}.json"))["tables"] if version else {}

    def current(self) -> int | None:
        """The version of the highest pointer; a staged store's own."""
        if self.pin is not None:
            return self.pin
        last = max(self._numbers("pointers"), default=0)
        return json.loads(self._read_text(f"pointers/{last:09d}.json"))["version"] if last else None

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the current one unless told; empty where it was never written."""
        have = self._tables(self.current() if version is None else version)
        if name not in have:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(f"{self.root}/{have[name]}")

    def commit(self, changed: Mapping[str, DataFrame], message: str = "") -> int:
        """A new version with these tables; the others stay as they are.  It becomes the current one, unless the store is staged.

        Tables go to a folder of their own, then the version's list of tables, then the pointer: whatever fails before
        the pointer leaves readers and later commits where they were.
        """
        tables, folder = self._tables(self.current()), f"data/{uuid.uuid4().hex}"
        for name, rows in changed.items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            tables[name] = f"{folder}/{name}"
        version = self._next("versions", lambda n: json.dumps({"version": n, "tables": tables, "message": message}, sort_keys=True))
        if self.pin is not None:
            self.pin = version
        else:
            self.publish(version)
        return version

    def publish(self, version: int) -> None:
        """Make a version the current one."""
        if version not in self.versions():
            raise ValueError(f"there is no version {version}")
        self._next("pointers", lambda _: json.dumps({"version": version}))

    def restore(self, version: int) -> None:
        self.publish(version)

    def staged(self) -> WorkspaceStore:
        """The same tables, from the current version on, with commits that only its own readers see until the last is published."""
        other = WorkspaceStore(self.spark, self.root.rsplit("/", 1)[0], self.root.rsplit("/", 1)[1])
        other.pin = self.current() or 0
        return other

    def save_snapshot(self, path: str) -> None:
        """A copy of the current tables in a folder: Parquet for each, and the manifest last."""
        other = WorkspaceStore(self.spark, path, "snapshot")
        other.commit({name: self.load(name) for name in TABLES}, "snapshot")

    def load_snapshot(self, path: str) -> int:
        other = WorkspaceStore(self.spark, path, "snapshot")
        return self.commit({name: other.load(name) for name in TABLES}, f"restored from {path}")
