"""A file system of datasets: paths, globs, versions, and the resolver that queries load through."""

from __future__ import annotations

import fnmatch
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SetwiseError
from ..manifest import Manifest
from ..operators.sets import Table
from . import readers


class Catalog:
    """Datasets under a root folder, one folder a path; each holds streams, and a stream is a version.

    Writes follow the stream modes: 'create' fails where data is, 'append' adds a
    stream, 'replace' makes its own stream the only one. What a dataset holds is the
    newest version of its manifest, which is published in one step after the data, so
    readers see the old or the new content, never half of it or both. Files are never
    overwritten; cook() merges small streams, clean() removes what no version names.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys or {}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _dir(self, path: str) -> str:
        return f"{self.root}/{path.strip('/')}"

    def manifest(self, path: str) -> Manifest:
        return Manifest(self.spark, f"{self._dir(path)}/_versions")

    def streams(self, path: str) -> list[str]:
        """Ids of the visible streams of a dataset."""
        return [s["id"] for s in self.manifest(path).latest()[1].get("streams", [])]

    def write(self, path: str, df: DataFrame, mode: str = "append", stream: str | None = None, terminal: bool = True, batch: tuple[str, int] | None = None) -> str:
        """Write df to a stream of the dataset and make it visible; returns the stream's id.

        terminal: with False the stream stays open and invisible, and what is written to
        it gathers until a terminal write. A stream that was delivered already changes
        nothing. batch: (source, number) of an ordered delivery; numbers up to the last
        one of a source were delivered, even after their streams were merged.
        """
        if mode not in ("create", "append", "replace"):
            raise SetwiseError(f"unknown write mode: {mode}")
        sid = f"{batch[0]}-{batch[1]:012d}" if batch else stream or uuid.uuid4().hex

        def delivered(c: dict) -> bool:
            return c.get("batches", {}).get(batch[0], -1) >= batch[1] if batch else mode != "replace" and (sid in c.get("merged", []) or any(s["id"] == sid for s in c.get("streams", [])))

        def check(c: dict) -> None:
            if mode == "create" and any(s["id"] != sid for s in c.get("streams", [])):
                raise SetwiseError(f"{path} exists")

        m = self.manifest(path)
        now = m.latest()[1]
        if delivered(now):
            return sid
        check(now)
        part = {"at": f"{sid}-{uuid.uuid4().hex}", "schema": df.schema.json()}
        df.write.parquet(f"{self._dir(path)}/data/{part['at']}")

        def change(c: dict) -> dict:
            if delivered(c):
                return c
            check(c)
            parts = [*c.get("open", {}).pop(sid, []), part]
            if not terminal:
                c.setdefault("open", {})[sid] = parts
                return c
            c["streams"] = [*([] if mode == "replace" else c.get("streams", [])), {"id": sid, "parts": parts}]
            if batch:
                c.setdefault("batches", {})[batch[0]] = batch[1]
            return c

        m.update(change)
        return sid

    def archive(self, path: str) -> None:
        """Hide all of a dataset's streams; their files stay until they are cleaned up."""
        self.manifest(path).update(lambda c: {**c, "streams": []})

    def cook(self, path: str, rows: int = 20_000) -> int:
        """Merge the streams of fewer than `rows` rows into one for each schema; returns how many were merged."""
        m = self.manifest(path)
        groups: dict[str, list[dict]] = {}
        for s in m.latest()[1].get("streams", []):
            if len({p["schema"] for p in s["parts"]}) == 1 and self._scan(path, s["parts"]).count() < rows:
                groups.setdefault(s["parts"][0]["schema"], []).append(s)
        done = 0
        for schema, some in groups.items():
            if len(some) < 2:
                continue
            sid, ids = f"cooked-{uuid.uuid4().hex}", {s["id"] for s in some}
            self._scan(path, [p for s in some for p in s["parts"]]).coalesce(max(1, len(some) * rows // 1_000_000)).write.parquet(f"{self._dir(path)}/data/{sid}")

            def change(c: dict, sid=sid, ids=ids, schema=schema) -> dict:
                if not ids <= {s["id"] for s in c["streams"]}:  # replaced meanwhile
                    return c
                known = [x for x in sorted(ids) if not any(x.startswith(f"{b}-") for b in c.get("batches", {}))]
                rest = [s for s in c["streams"] if s["id"] not in ids]
                return {**c, "streams": [*rest, {"id": sid, "parts": [{"at": sid, "schema": schema}]}], "merged": [*c.get("merged", []), *known]}

            if any(s["id"] == sid for s in m.update(change)["streams"]):
                done += len(ids)
        return done

    def clean(self, path: str) -> int:
        """Delete the data that the newest version doesn't name; returns the number of folders. Not for use while others write or read older versions."""
        c = self.manifest(path).latest()[1]
        keep = {p["at"] for s in c.get("streams", []) for p in s["parts"]} | {p["at"] for ps in c.get("open", {}).values() for p in ps}
        fs, p = self._fs()
        at = p(f"{self._dir(path)}/data")
        old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in keep] if fs.exists(at) else []
        for x in old:
            fs.delete(x, True)
        return len(old)

    # --- files as they are ------------------------------------------------------------------------

    def put_file(self, path: str, local: str, content_type: str) -> None:
        """Keep a file of any kind under a path, in place of the one before."""
        fs, p = self._fs()
        name = uuid.uuid4().hex
        fs.mkdirs(p(f"{self._dir(path)}/_files"))
        fs.copyFromLocalFile(p(local), p(f"{self._dir(path)}/_files/{name}"))
        self.manifest(path).update(lambda c: {**c, "file": {"at": name, "type": content_type}})

    def get_file(self, path: str) -> tuple[bytes, str]:
        """(content, content type) of the file kept under a path."""
        f = self.manifest(path).latest()[1].get("file")
        if f is None:
            raise SetwiseError(f"no file at {path}")
        row = self.spark.read.format("binaryFile").load(f"{self._dir(path)}/_files/{f['at']}").select("content").collect()[0]
        return bytes(row.content), f["type"]

    # --- paths ------------------------------------------------------------------------------------

    def children(self, path: str = "/") -> list[str]:
        fs, p = self._fs()
        at = p(self._dir(path))
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName() not in ("data", "_versions", "_files"))

    def expand(self, pattern: str) -> list[str]:
        """The paths that a pattern names; * stands for one segment or a part of it."""
        found = ["/"]
        for part in [x for x in pattern.split("/") if x]:
            if "*" in part:
                found = [f"{f.rstrip('/')}/{c}" for f in found for c in self.children(f) if fnmatch.fnmatch(c, part)]
            else:
                found = [f"{f.rstrip('/')}/{part}" for f in found]
        return found

    def _scan(self, path: str, parts: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(parts[0]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self._dir(path)}/data/{p['at']}" for p in parts])

    def read(self, path: str) -> DataFrame:
        """All visible streams of all datasets that the path names, by column name: one scan for each schema, however many streams."""
        groups: dict[str, list[str]] = {}
        for p in self.expand(path):
            for s in self.manifest(p).latest()[1].get("streams", []):
                for part in s["parts"]:
                    groups.setdefault(part["schema"], []).append(f"{self._dir(p)}/data/{part['at']}")
        out = None
        for schema, folders in groups.items():
            df = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*folders)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise SetwiseError(f"no such dataset: {path}")
        return out

    def resolve(self, path: str) -> Table:
        return Table(self.read(path), self.keys.get(path, ()))

    def ingest_file(self, path: str, file: str, content_type: str | None = None, **options) -> tuple[str, DataFrame]:
        """Read a JSON or CSV file, chosen by content type or by its first bytes, append it, and give back the rows that failed."""
        kind = readers.sniff(self.spark, file, content_type)
        good, bad = readers.read_json(self.spark, file, **options) if kind == "json" else readers.read_csv(self.spark, file, **options)
        return self.write(path, good), bad
