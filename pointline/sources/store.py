"""Several tables in one folder that change together.

A table is a set of Parquet folders, one per value of its partition column. A snapshot is a small file that names the folders of every
table; readers take the latest. A change writes new folders for the partitions it touches and then one new snapshot for all
tables, so it is seen as a whole or not at all, and untouched files stay as they are. A change that was cut off leaves folders
that no snapshot names; repeating it gives the same tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .upkeep import upsert_latest

WHOLE = "all"


@dataclass
class Table:
    """Its schema, the column it is partitioned by (or none), the columns that tell its rows apart, its folders by partition."""

    schema: str
    part: str | None = None
    keys: list[str] = field(default_factory=list)
    folders: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.folder, *names]).rstrip("/"))

    # snapshots ------------------------------------------------------------------------------------------------------

    def snapshot(self) -> tuple[int, dict[str, Table]]:
        """The latest snapshot and its number; (0, nothing) for a new folder."""
        place = self._path("_snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(str(self._path("_snapshots", f"{max(numbers):08d}.json")), wholetext=True).first().value
        return max(numbers), {name: Table(**spec) for name, spec in json.loads(text).items()}

    def commit(self, base: int, tables: Mapping[str, Table]) -> int:
        """Publishes a snapshot that follows ``base``. Fails if another change came first; nothing is lost then, and one may try again."""
        staged, final = self._path("_snapshots", f"{uuid.uuid4().hex}.tmp"), self._path("_snapshots", f"{base + 1:08d}.json")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps({name: asdict(t) for name, t in tables.items()}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self._hadoop, "Options$Rename")
        context.rename(staged, final, self.spark.sparkContext._gateway.new_array(rename, 0))  # refuses to replace a file
        return base + 1

    # tables ---------------------------------------------------------------------------------------------------------

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        return self._read(self.snapshot()[1][name], parts)

    def _read(self, table: Table, parts: Iterable[str] | None = None) -> DataFrame:
        folders = list(table.folders.values()) if parts is None else [table.folders[p] for p in parts if p in table.folders]
        schema = T.StructType.fromDDL(table.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def part_of(self, table: Table):
        return F.coalesce(F.col(table.part).cast("string"), F.lit("-")) if table.part else F.lit(WHOLE)

    def written(self, name: str, table: Table, rows: DataFrame) -> dict[str, str]:
        """New folders of the rows by partition. A heavy partition is dealt out over several tasks, light ones share one."""
        place = f"{name}/{uuid.uuid4().hex}"
        rows = rows.select(*T.StructType.fromDDL(table.schema).names).withColumn("_part", self.part_of(table))
        rows.hint("rebalance", "_part").write.partitionBy("_part").parquet(str(self._path(place)))
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(place)) if s.isDirectory()]
        return {unquote(f.removeprefix("_part=")): str(self._path(place, f)) for f in found if f.startswith("_part=")}

    def replaced(self, name: str, table: Table, touched: Iterable[str], rows: DataFrame) -> Table:
        """The table with these rows for the touched partitions, and with its other folders as they are."""
        touched = set(touched)
        kept = {p: f for p, f in table.folders.items() if p not in touched}
        return Table(table.schema, table.part, table.keys, kept | self.written(name, table, rows))

    def create(self, name: str, rows: DataFrame, part: str | None = None, keys: Sequence[str] = ()) -> None:
        """Adds a table or replaces it as a whole."""
        base, tables = self.snapshot()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        table = Table(schema, part, list(keys))
        table.folders = self.written(name, table, rows)
        self.commit(base, {**tables, name: table})

    def parts(self, rows: DataFrame, table: Table) -> list[str]:
        """The partitions that rows lie in: as many values as the table has folders, at most."""
        return [r[0] for r in rows.select(self.part_of(table).alias("p")).distinct().collect()]

    def upsert(self, name: str, updates: DataFrame, order: str | None = None) -> list[str]:
        """``upkeep.upsert_latest`` into a stored table; reads and writes only the partitions that the updates touch, and names them.

        The partition column is one of the keys, so the old and the new row of a key lie in the same folder.
        """
        base, tables = self.snapshot()
        table = tables[name]
        if table.part and table.part not in table.keys:
            raise ValueError(f"{name}: rows could move between partitions, as {table.part} is not one of the keys {table.keys}")
        touched = self.parts(updates, table)
        if touched:
            merged = upsert_latest(self._read(table, touched), updates, table.keys, order)
            self.commit(base, {**tables, name: self.replaced(name, table, touched, merged)})
        return touched

    def change_rows(self, key: str, chosen: DataFrame, change, add: Mapping[str, DataFrame] | None = None) -> dict[str, list[str]]:
        """Applies ``change(rows)`` to all tables that have the column ``key``, in the partitions that hold one of the ``chosen`` keys,
        and appends the rows of ``add``: one snapshot for all. Returns the touched partitions."""
        base, tables = self.snapshot()
        after, seen = dict(tables), {}
        for name, table in tables.items():
            extra = (add or {}).get(name)
            has = key in T.StructType.fromDDL(table.schema).names
            if has and table.part == key:
                raise ValueError(f"{name} is partitioned by {key}, so its rows would move")
            touched = self.parts(self._read(table).join(chosen.select(key).distinct(), key, "left_semi"), table) if has else []
            rows = change(self._read(table, touched)) if touched else None
            if extra is not None:
                more = [p for p in self.parts(extra, table) if p not in touched]
                rest = self._read(table, more).unionByName(extra)
                rows, touched = rest if rows is None else rows.unionByName(rest), [*touched, *more]
            if touched:
                after[name] = self.replaced(name, table, touched, rows)
                seen[name] = touched
        self.commit(base, after)
        return seen

    def clean(self) -> None:
        """Deletes the folders that the latest snapshot doesn't name; only when no one reads an earlier one."""
        tables = self.snapshot()[1]
        named = {f for t in tables.values() for f in t.folders.values()}
        for name in tables:
            for write in self._fs.listStatus(self._path(name)):
                inner = [s.getPath() for s in self._fs.listStatus(write.getPath()) if s.isDirectory()]
                gone = [p for p in inner if str(self._path(name, write.getPath().getName(), p.getName())) not in named]
                for path in gone if len(gone) < len(inner) else [write.getPath()]:
                    self._fs.delete(path, True)
