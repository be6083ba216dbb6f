"""Season CSV files of unlike encodings and columns, read file by file, with every rejected line listed."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.files import kept

_READ = "file string, encoding string, line long, reason string, fields array<string>, text string"


def encoding_of(content: bytes) -> str:
    """UTF-8 with or without a byte-order mark where the bytes are valid as such, else Latin-1, in which all are."""
    if content.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def lines_of(file: str, content: bytes, columns: list[str]) -> Iterator[tuple]:
    """Rows of _READ: the wanted fields of each line by its file's header, null where that lacks them or the line ends early."""
    encoding = encoding_of(content)
    if encoding == "utf-8-sig":
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            encoding, text = "latin-1", content[len(codecs.BOM_UTF8) :].decode("latin-1")
    else:
        text = content.decode(encoding)
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    reader = csv.reader(io.StringIO(text, newline=""))
    header = next(reader, [])
    places = [header.index(c) if c in header else None for c in columns]
    line = reader.line_num
    for fields in reader:
        line, at = reader.line_num, line + 1
        if not fields:
            continue
        if len(fields) > len(header):
            yield file, encoding, at, f"{len(fields)} fields, not {len(header)}", None, ",".join(fields)
        else:
            yield file, encoding, at, None, [fields[p] if p is not None and p < len(fields) and fields[p] != "" else None for p in places], ",".join(fields)


def read(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all CSV files below path: rows (file, encoding, line, and the columns by name and type), rejects (file, line, reason, text).

    A line with more fields than its header is rejected, and one with a field that is not of its type; a field that is
    missing or empty is null. No line is lost: each but the header and empty ones is a row or a reject. A file is read as a whole by one
    task, as a season's file is small, and only once for both tables.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(lines_of(file, content, names))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "encoding", "line", "reason", "fields", "text"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    lines = kept(found.select("path", "content").mapInArrow(run, _READ))
    typed = {c: F.get("fields", F.lit(i)).try_cast(kind) for i, (c, kind) in enumerate(columns.items())}
    wrong = F.array_compact(F.array(*[F.when(v.isNull() & F.get("fields", F.lit(i)).isNotNull(), F.lit(f"{c} is no {columns[c]}")) for i, (c, v) in enumerate(typed.items())]))
    judged = lines.withColumn("reason", F.coalesce("reason", F.when(F.size(wrong) > 0, F.array_join(wrong, ", "))))
    rows = judged.where("reason IS NULL").select("file", "encoding", "line", *[v.alias(c) for c, v in typed.items()])
    return rows, judged.where("reason IS NOT NULL").select("file", "line", "reason", "text")
