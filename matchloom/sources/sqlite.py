"""SQLite files as a table: read in parts, with the wanted columns and filters in the files' own SQL, and written by tasks."""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

#: Rows that one part of a file has at most, by their row ids, and rows of a batch.
PART_ROWS, BATCH_ROWS = 250_000, 10_000
#: Declared types and those of Spark.
TYPES = {"bigint": "bigint", "integer": "bigint", "int": "int", "real": "double", "double": "double", "text": "string", "date": "date", "boolean": "boolean"}
_COMPARED = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
SUFFIX = ".sqlite"


def local(path: str) -> str:
    """The path for SQLite itself, which opens files only: a folder that all machines have mounted."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"SQLite files must lie in a mounted folder, not in {scheme}:")
    return "/" + rest.lstrip("/") if colon else path


def files_of(path: str) -> list[str]:
    path = local(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(SUFFIX)) if os.path.isdir(path) else [path]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def stored(value):
    """A value as the files have it: days as text, truth as a number."""
    return value.isoformat() if isinstance(value, dt.date) else int(value) if isinstance(value, bool) else value


def condition(f: ds.Filter) -> tuple[str, list] | None:
    """A filter as SQL with its values; None for one that SQLite does not judge as Spark does, or that SQL has no form for."""
    if isinstance(f, ds.Not):
        inside = condition(f.child)
        return inside and (f"NOT ({inside[0]})", inside[1])
    if len(f.attribute) > 1:
        return None
    column = quoted(f.attribute[0])
    if type(f) in _COMPARED:
        if isinstance(f.value, dt.datetime) or not isinstance(f.value, (int, float, str, bool, dt.date, type(None))) or f.value != f.value:
            return None
        return f"{column} {_COMPARED[type(f)]} ?", [stored(f.value)]
    if isinstance(f, ds.In):
        return f"{column} IN ({', '.join('?' * len(f.value))})", [stored(v) for v in f.value]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return f"{column} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL", []
    if isinstance(f, ds.StringStartsWith):
        return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
    if isinstance(f, ds.StringContains):
        return f"instr({column}, ?) > 0", [f.value]
    return None


@dataclass
class Part(ds.InputPartition):
    file: str
    low: int
    high: int


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("part_rows", PART_ROWS))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            said = condition(f)
            if said is None:
                yield f
            else:
                self.where.append(said[0])
                self.values += said[1]

    def partitions(self) -> list[Part]:
        """Ranges of row ids. Only their ends are read here; they are looked up at the ends of the files' own index."""
        out = []
        for file in files_of(self.path):
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as c:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            c.close()
            out += [Part(file, at, min(at + self.rows, high + 1)) for at in range(low, high + 1, self.rows)] if low is not None else []
        return out or [Part("", 0, 0)]

    def sql(self) -> str:
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        return f"SELECT {columns} FROM {quoted(self.table)} WHERE " + " AND ".join(["rowid >= ? AND rowid < ?", *[f"({w})" for w in self.where]])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        schema = to_arrow_schema(self.schema)
        fixed = {i: dt.date.fromisoformat if pa.types.is_date(t) else bool for i, t in enumerate(schema.types) if pa.types.is_date(t) or pa.types.is_boolean(t)}
        c = sqlite3.connect(f"file:{part.file}?mode=ro", uri=True)
        try:
            cursor = c.execute(self.sql(), [part.low, part.high, *self.values])
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = [list(x) for x in zip(*rows)]
                for i, of in fixed.items():
                    columns[i] = [None if v is None else of(v) for v in columns[i]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
        finally:
            c.close()


@dataclass
class Written(ds.WriterCommitMessage):
    file: str


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = local(options["path"]), options["table"], schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file for each task, under a name that no reader takes until all have ended."""
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f"{uuid.uuid4().hex}{SUFFIX}.part")
        back = {v: k for k, v in TYPES.items()}
        kinds = ", ".join(f"{quoted(f.name)} {back.get(f.dataType.simpleString(), 'text')}" for f in self.schema)
        c = sqlite3.connect(file)
        try:
            with c:
                c.execute(f"CREATE TABLE {quoted(self.table)} ({kinds})")
                for b in batches:
                    columns = [[None if v is None else stored(v) for v in x.to_pylist()] for x in b.columns]
                    c.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(columns))})", zip(*columns))
        finally:
            c.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        old = files_of(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m:
                os.rename(m.file, m.file.removesuffix(".part"))
        for file in old:
            os.remove(file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                os.remove(m.file)


class Sqlite(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        c = sqlite3.connect(f"file:{files_of(self.options['path'])[0]}?mode=ro", uri=True)
        try:
            found = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        finally:
            c.close()
        return ", ".join(f"`{name}` {TYPES.get(kind.lower(), 'string')}" for _, name, kind, *_ in found)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """df as a table in SQLite files below path, one for each task that has rows. All appear at the end, or none."""
    _ready(df.sparkSession)
    kinds = [f.dataType.simpleString() for f in df.schema]
    if unknown := set(kinds) - set(TYPES.values()):
        raise ValueError(f"SQLite has no type for {', '.join(sorted(unknown))}")
    df.write.format("sqlite").option("path", path).option("table", table).mode(mode).save()


def read(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """A table of one SQLite file, or of all below a folder. Only `columns` are read; filters of the query go into the files' SQL.

    A file is read in parts by row ids, in parallel, and never by the driver. Doubles that are no number are null there.
    """
    _ready(spark)
    found = spark.read.format("sqlite").option("path", path).option("table", table).option("part_rows", part_rows)
    if columns is not None:
        every: dict[str, DataType] = {f.name: f.dataType for f in found.load().schema}
        found = found.schema(StructType([StructType().add(c, every[c])[0] for c in columns]))
    return found.load()
