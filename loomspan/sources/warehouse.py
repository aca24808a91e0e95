"""Loads that take effect whole or not at all: tables are staged, checked, and then made current by one small file.

A warehouse is a folder. Each load writes its tables to a folder of its own and then a numbered manifest that says which
folders make up each table. The greatest manifest is the current one; it is renamed into place without overwriting, so of two
loads that start from the same one, the second fails. Readers see the old tables until then, and a load that fails its checks
leaves them byte for byte.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import first_per_key

#: What whole-number columns hold (fixed values).
RANGES = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


@dataclass(frozen=True)
class Rule:
    """A table's schema (types of whole-number columns are its declared ranges), key, and parent (table, own column, its key)."""

    schema: dict[str, str]
    key: tuple[str, ...] = ()
    parent: tuple[str, str, str] | None = None


class LoadError(ValueError):
    """A check of a load failed; the tables are as they were."""


@dataclass
class Warehouse:
    spark: SparkSession
    at: str
    rules: dict[str, Rule] = field(default_factory=dict)

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._fs("_loads")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """The current load's number (0: none yet) and each table's folders."""
        numbers = self._manifests()
        if not numbers:
            return 0, {}
        path, fs = self._fs(f"_loads/{numbers[-1]}.json")
        stream = fs.open(path)
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, tables: dict[str, list[str]]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        rough, fs = self._fs(f"_loads/.{uuid.uuid4().hex}")
        out = fs.create(rough, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        final, _ = self._fs(f"_loads/{number}.json")
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(rough, final, none)
        except Exception as e:
            fs.delete(rough, False)
            raise LoadError(f"another load took number {number}: {e}") from e

    def _folders(self, name: str, folders: Iterable[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in self.rules[name].schema.items())
        folders = [f"{self.at}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A table as the current load left it; empty before the first."""
        return self._folders(name, self.manifest()[1].get(name, []))

    def load(self, tables: dict[str, DataFrame], mode: str) -> dict[str, int]:
        """replace: each table's rows take the place of the old ones, and tables below it that are not supplied are emptied.
        append: rows are added. Returns how many rows were written of each table.

        Rows that repeat a key in one supplied table are reduced to one. A number outside its column's declared range, a null
        key, a key that the table has already, and a row without its parent are errors, which change nothing. Counts and ranges
        are observed while the rows are written.
        """
        if mode not in ("replace", "append"):
            raise ValueError(f"mode must be replace or append: {mode}")
        if unknown := set(tables) - set(self.rules):
            raise ValueError(f"tables without a rule: {sorted(unknown)}")
        number, now = self.manifest()
        own = f"load-{number + 1}-{uuid.uuid4().hex}"
        staged, counts = {}, {}
        try:
            for name, df in tables.items():
                counts[name] = self._stage(name, df, f"{own}/{name}")
                staged[name] = f"{own}/{name}"
            after = dict(now)
            for name, folder in staged.items():
                after[name] = [folder] if mode == "replace" else [*now.get(name, []), folder]
            emptied = set(tables) if mode == "replace" else set()
            while below := {c for c, r in self.rules.items() if r.parent and r.parent[0] in emptied and c not in emptied}:
                emptied |= below
            for name in emptied - set(tables):
                after[name] = []
            self._check(after, set(tables) | emptied, mode)
            self._publish(number + 1, after)
        except BaseException:
            path, fs = self._fs(own)
            fs.delete(path, True)
            raise
        return counts

    def _stage(self, name: str, df: DataFrame, folder: str) -> int:
        rule = self.rules[name]
        if missing := [c for c in rule.schema if c not in df.columns]:
            raise LoadError(f"{name}: columns are missing: {missing}")
        rows = df.select(*rule.schema)
        if rule.key:
            rows = first_per_key(rows, list(rule.key), [F.col(c) for c in rule.schema])
        whole = [c for c, t in rule.schema.items() if t in RANGES]
        wide = {c: F.col(c).cast("decimal(38,0)") for c in whole}
        low, high = ({c: f(x).alias(f"{side}_{i}") for i, (c, x) in enumerate(wide.items())} for side, f in (("lo", F.min), ("hi", F.max)))
        nulls = F.count_if(F.lit(False)) if not rule.key else F.count_if(sum((F.col(c).isNull().cast("int") for c in rule.key), F.lit(0)) > 0)
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), *low.values(), *high.values())
        fitting = watched.select(*(F.col(c).try_cast(t).alias(c) if t in RANGES else F.col(c).cast(t).alias(c) for c, t in rule.schema.items()))
        fitting.write.parquet(f"{self.at}/{folder}")
        got = seen.get
        if got["nulls"]:
            raise LoadError(f"{name}: {got['nulls']} rows without a key")
        for i, c in enumerate(whole):
            lo, hi = RANGES[rule.schema[c]]
            if got[f"lo_{i}"] is not None and not lo <= got[f"lo_{i}"] <= got[f"hi_{i}"] <= hi:
                raise LoadError(f"{name}.{c}: {rule.schema[c]} holds {lo} to {hi}, the rows {got[f'lo_{i}']} to {got[f'hi_{i}']}")
        return got["n"]

    def _check(self, after: dict[str, list[str]], changed: set[str], mode: str) -> None:
        for name, rule in self.rules.items():
            rows = self._folders(name, after.get(name, []))
            if mode == "append" and name in changed and rule.key and len(after[name]) > 1:
                twice = rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
                if twice:
                    raise LoadError(f"{name}: key {tuple(twice[0])[:-1]} is there already")
            if rule.parent and {name, rule.parent[0]} & changed:
                parent, column, key = rule.parent
                lost = rows.where(F.col(column).isNotNull()).join(self._folders(parent, after.get(parent, [])).select(F.col(key).alias(column)), column, "left_anti").count()
                if lost:
                    raise LoadError(f"{name}: {lost} rows without their {parent}")

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last `keep` manifests names, and older manifests; returns how many folders went.
        Not while a load runs: its folders are not named yet."""
        numbers = self._manifests()
        named = set()
        for n in numbers[-keep:]:
            path, fs = self._fs(f"_loads/{n}.json")
            stream = fs.open(path)
            named |= {f.split("/")[0] for folders in json.loads(bytes(stream.readAllBytes()).decode()).values() for f in folders}
            stream.close()
        for n in numbers[:-keep]:
            path, fs = self._fs(f"_loads/{n}.json")
            fs.delete(path, False)
        path, fs = self._fs("")
        old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("load-") and s.getPath().getName() not in named]
        for p in old:
            fs.delete(p, True)
        return len(old)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A database table, read in `parts` ranges of a whole-number column whose bounds are asked for first."""
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    low, high = reader().option("query", f"select min({column}) lo, max({column}) hi from {table}").load().first()
    if low is None:
        return reader().option("dbtable", table).load()
    return reader().options(dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(parts)).load()


def load_jdbc(tables: dict[str, DataFrame], url: str, mode: str, below: dict[str, list[str]] | None = None, **options: str) -> None:
    """The same load into existing database tables (parents before children): tasks fill staging tables side by side, and one
    transaction of the database moves their rows, so that its own checks (keys, ranges, parents) fail all of it or none.
    replace empties the tables, and those below them, first."""
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be replace or append: {mode}")
    spark = next(iter(tables.values())).sparkSession
    rough = {}
    manager = spark._jvm.java.sql.DriverManager
    db = manager.getConnection(url)

    def run(sql: str) -> None:
        statement = db.createStatement()
        try:
            statement.executeUpdate(sql)
        finally:
            statement.close()

    try:
        try:
            for name, df in tables.items():
                at = f"{name}_{uuid.uuid4().hex[:8]}"
                df.write.format("jdbc").options(url=url, dbtable=at, **options).save()
                rough[name] = at
            db.setAutoCommit(False)
            if mode == "replace":
                emptied = list(dict.fromkeys(t for name in tables for t in (*(below or {}).get(name, []), name)))
                for name in sorted(emptied, key=lambda t: t in (below or {})):  # children first
                    run(f"delete from {name}")
            for name, df in tables.items():
                columns = ", ".join(df.columns)
                quoted = ", ".join(f'"{c}"' for c in df.columns)
                run(f"insert into {name} ({columns}) select {quoted} from {rough[name]}")
            db.commit()
        except BaseException:
            if not db.getAutoCommit():
                db.rollback()
            raise
        finally:
            db.setAutoCommit(True)
            for name in rough.values():
                run(f"drop table {name}")
    finally:
        db.close()
