"""Versioned parquet tables partitioned by scope: append versions, read the current ones, erase for good."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.views import latest
from mnemospark.runtime import checkpointed


class StoreError(Exception):
    """A coded error: 'invalid-input', 'identity-conflict' or 'not-found'."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


class VersionedTable:
    """Rows (id, scope, version, op, ...) in one folder, a sub-folder per scope; one writer per scope at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(self.path)
        return fs.exists(p)

    def rows(self, scopes: list[str] | None = None) -> DataFrame:
        """All versions; a list of scopes prunes the scan to their folders."""
        df = self.spark.read.parquet(self.path)
        return df if scopes is None else df.where(F.col("scope").isin(list(dict.fromkeys(scopes))))

    def put(self, rows: DataFrame) -> None:
        """Appends rows as the next version of their id within the scope (1 for new ones); ids must be unique within a call. Only
        the folders of the rows' scopes are read, and a scope's rows are written by one task, or several where they are many.
        """
        missing = {"id", "scope"} - set(rows.columns)
        if missing:
            raise StoreError("invalid-input", f"missing columns {sorted(missing)}")
        fresh = rows.drop("version", "op")
        if not fresh.groupBy("id").count().where("count > 1").isEmpty():
            raise StoreError("identity-conflict", "an id occurs twice in one put")
        if self.exists():
            scopes = [r[0] for r in fresh.select("scope").distinct().collect()]  # names of folders
            top = self.rows(scopes).groupBy("id").agg(F.max("version").alias("top"))
            fresh = checkpointed(fresh.join(top, "id", "left").withColumn("version", F.coalesce(F.col("top"), F.lit(0)) + 1).drop("top"))
        else:
            fresh = fresh.withColumn("version", F.lit(1))
        fresh.withColumn("op", F.lit("put")).hint("rebalance", "scope").write.mode("append").partitionBy("scope").parquet(self.path)

    def current(self, scopes: list[str] | None = None) -> DataFrame:
        """The highest version of each id."""
        return latest(self.rows(scopes), ["id"], [F.col("version").desc()]).where("op = 'put'")

    def erase(self, ids: DataFrame) -> int:
        """Removes every version of the ids (id, scope) by rewriting the folders of their scopes; returns erased ids.

        The survivors are staged beside the table and moved into place, so no erased byte stays in it.
        """
        gone = checkpointed(self.rows().join(ids.select("id", "scope").distinct(), ["id", "scope"], "left_semi").select("id", "scope").distinct())
        n = gone.count()
        if not n:
            return 0
        scopes = gone.select("scope").distinct()
        left = self.rows().join(scopes, "scope", "left_semi").join(gone, ["id", "scope"], "left_anti")
        staging = f"{self.path}.staging"
        left.write.mode("overwrite").partitionBy("scope").parquet(staging)
        fs, stage = self._fs(staging)
        jvm = self.spark._jvm
        names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for row in scopes.toLocalIterator():  # one folder at a time; their number is that of the scopes asked for
            folder = f"scope={names.escapePathName(row['scope'])}"
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            staged = jvm.org.apache.hadoop.fs.Path(f"{staging}/{folder}")
            self._swap(fs, staged, target)
        fs.delete(stage, True)
        self.spark.catalog.refreshByPath(self.path)
        return n

    def _swap(self, fs, staged, target) -> None:
        """Puts the staged folder in the target's place; the old one is only moved aside until the new one stands, so a crash
        loses nothing: ``recover`` moves it back.
        """
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.old")
        fs.delete(aside, True)
        if fs.exists(target):
            fs.rename(target, aside)
        if fs.exists(staged):
            fs.rename(staged, target)
        fs.delete(aside, True)

    def recover(self) -> int:
        """Moves folders that a crash left aside back where nothing took their place; returns their number."""
        fs, p = self._fs(self.path)
        n = 0
        for parent in (p.getParent(), p):
            for status in fs.listStatus(parent) if fs.exists(parent) else []:
                name = status.getPath().getName()
                if name.startswith("_") and name.endswith(".old") and (parent.equals(p) or name == f"_{p.getName()}.old"):
                    target = self.spark._jvm.org.apache.hadoop.fs.Path(parent, name[1:-4])
                    if fs.exists(target):
                        fs.delete(status.getPath(), True)
                    else:
                        fs.rename(status.getPath(), target)
                        n += 1
        self.spark.catalog.refreshByPath(self.path)
        return n

    def compact(self) -> None:
        """Rewrites every scope with the current versions only."""
        kept = checkpointed(self.current())
        kept.repartition("scope").write.mode("overwrite").partitionBy("scope").parquet(f"{self.path}.staging")
        fs, p = self._fs(self.path)
        self._swap(fs, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.staging"), p)
        self.spark.catalog.refreshByPath(self.path)


def change_feed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """id, op ('insert', 'update', 'delete'), before and after structs of the columns; unchanged rows are left out."""
    b = before.select("id", F.struct(*columns).alias("before"))
    a = after.select("id", F.struct(*columns).alias("after"))
    both = b.join(a, "id", "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.select("id", op.alias("op"), "before", "after").where("op IS NOT NULL")


class ResultLog:
    """Append-only results with a manifest: a resumed run must have the same one."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path = spark, path
        text = json.dumps(manifest, sort_keys=True)
        fs, p = VersionedTable(spark, path)._fs(f"{path}/_manifest")
        if fs.exists(p):
            held = spark.read.text(f"{path}/_manifest").first()[0]
            if held != text:
                raise StoreError("identity-conflict", "the results in this folder belong to another run")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/_manifest")

    def append(self, results: DataFrame) -> None:
        results.write.mode("append").json(f"{self.path}/results")

    def done(self, schema: str) -> DataFrame:
        """Results so far; the torn last line of a broken run is dropped."""
        fs, p = VersionedTable(self.spark, self.path)._fs(f"{self.path}/results")
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{self.path}/results")
