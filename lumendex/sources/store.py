"""Versioned tables: Parquet snapshots and one pointer file that is swapped atomically."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import CatalogueError, SchemaTooNew
from ..schema import SCHEMA_VERSION


class Store:
    """Tables with fixed schemas under a folder that all executors reach; one writer at a time.

    A commit writes new versions of the tables it changes, and then renames a new
    pointer over the old one: readers see all of it or nothing.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], migrations: dict | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), tables
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.root)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)
        self._pointer = self._path(f"{self.root}/CURRENT.json")
        if not self._fs.exists(self._pointer):
            self._swap({"schema_version": SCHEMA_VERSION, "tables": {}, "marks": {}, "commit": 0})
        self._migrate(migrations or {})

    def state(self) -> dict:
        """The pointer's content."""
        stream = self._fs.open(self._pointer)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _swap(self, state: dict) -> None:
        temp = self._path(f"{self.root}/.pointer-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(temp, self._pointer, options)

    def _migrate(self, migrations: dict) -> None:
        """Bring an older store to the present version; refuse a later one; a missing or odd version counts as 0."""
        state = self.state()
        try:
            version = int(state.get("schema_version", 0))
        except (TypeError, ValueError):
            version = 0
        if version > SCHEMA_VERSION:
            raise SchemaTooNew(f"catalogue version {version} is later than supported version {SCHEMA_VERSION}")
        if version < SCHEMA_VERSION:
            for step in range(version, SCHEMA_VERSION):
                state = migrations.get(step, lambda s: s)(state)
            self._swap(state | {"schema_version": SCHEMA_VERSION})

    def table(self, name: str) -> DataFrame:
        """The present version of a table."""
        where = self.state()["tables"].get(name)
        if where is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{where}")

    def commit(self, marks: dict[str, int] | None = None, **tables: DataFrame) -> None:
        """Replace tables, and raise id marks, in one step; older versions but the last are removed."""
        state, new = self.state(), {}
        for name, df in tables.items():
            if name not in self.schemas:
                raise CatalogueError(f"no table {name}")
            columns = [c.strip().split(" ")[0] for c in self.schemas[name].split(",")]
            new[name] = f"{name}/{state['commit'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            df.select(*columns).write.parquet(f"{self.root}/{new[name]}")
        old = state.get("previous", {})
        state["previous"] = {n: state["tables"][n] for n in new if n in state["tables"]} | {n: w for n, w in old.items() if n not in new}
        state["tables"] |= new
        state["marks"] = {k: max(v, state["marks"].get(k, 0)) for k, v in (state["marks"] | (marks or {})).items()}
        state["commit"] += 1
        self._swap(state)
        for name in new:
            if name in old:
                self._fs.delete(self._path(f"{self.root}/{old[name]}"), True)

    def mark(self, name: str) -> int:
        """The highest id that a table has ever had."""
        return self.state()["marks"].get(name, 0)
