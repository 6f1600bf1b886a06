"""Readers by reference formulation; each gives a DataFrame and its column names by position.

Columns are bound by position, so names that differ in case only, repeat, are empty or
hold dots never meet Spark's name resolution. The first of equal names wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError, UnsupportedPlanError
from ..functions.terms import ANY, PLAIN, UNRESERVED
from ..options import Options
from ..plans.model import Source
from .paths import find

#: The frame (columns in their own types), its names, and what characters the text of each column can hold.
Read = tuple[DataFrame, list[str], list[str]]

#: No quoted or unquoted field is null; blanks and backslashes are kept; a row of another length is an error.
_CSV = {"quote": '"', "escape": '"', "mode": "FAILFAST", "nullValue": "\x01", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "inferSchema": "false"}


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a field may hold a line feed: its first line then has an odd number of quotes. The scan is split."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _csv(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    path = find(spark, source.path, options.working_dir_hint)
    multiline = options.multiline
    if multiline is None:
        multiline = stream or bool(dict(source.options)) or _spans_lines(spark, path)
    how = {**_CSV, "multiLine": str(multiline).lower(), **dict(source.options)}
    head = spark.read.options(**how, header="false").csv(path).head()
    if head is None:
        return spark.createDataFrame([], T.StructType([])), [], []
    names = ["" if x is None else x for x in head]
    # every file's header is held against the first one's, unless Spark couldn't tell the names apart
    plain = all(names) and len({x.lower() for x in names}) == len(names)
    schema = T.StructType([T.StructField(x if plain else f"c{i}", T.StringType()) for i, x in enumerate(names)])
    how["enforceSchema"] = str(not plain).lower()
    reader = (spark.readStream if stream else spark.read).schema(schema).options(**how, header="true")
    df = reader.csv(path).toDF(*[f"c{i}" for i in range(len(names))])
    # an empty field is a value like any other
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns]), names, [ANY] * len(names)


def _characters(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType)):
        return UNRESERVED
    return PLAIN if isinstance(kind, (T.FractionalType, T.TimestampType, T.TimestampNTZType)) else ANY


def _typed(df: DataFrame) -> Read:
    """Columns keep their types, and are cast to canonical text where they are used; nulls stay, and their statements are left out."""
    names, plain = df.columns, [_characters(f.dataType) for f in df.schema]
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names, plain


def _file(format: str) -> Callable[[SparkSession, Source, Options, bool], Read]:
    def read(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
        path = find(spark, source.path, options.working_dir_hint)
        reader = spark.read.options(**dict(source.options))
        if not stream:
            return _typed(reader.format(format).load(path))
        schema = reader.format(format).load(path).schema
        return _typed(spark.readStream.options(**dict(source.options)).schema(schema).format(format).load(path))

    return read


def _json(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    """JSON lines, or with an iterator such as ``$.a.b[*]`` the objects that it names, a document to a file (option multiLine=false: to a line)."""
    if source.iterator in ("", "$"):
        return _file("json")(spark, source, options, stream)
    steps = re.findall(r"\.([A-Za-z_][A-Za-z0-9_]*)|(\[\*\])", source.iterator)
    if source.iterator != "$" + "".join(f".{a}" if a else b for a, b in steps):
        raise UnsupportedPlanError(f"JSON iterator {source.iterator!r}")
    if stream:
        raise UnsupportedPlanError("a JSON iterator over a stream")
    df = spark.read.options(**{"multiLine": "true", **dict(source.options)}).json(find(spark, source.path, options.working_dir_hint))
    at = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    df = df.select(at.alias("at"))
    for i, (name, _) in enumerate(steps):
        kind = df.schema["at"].dataType
        if name and isinstance(kind, T.StructType) and name in kind.names:
            df = df.select(F.col("at")[name].alias("at"))
        elif not name and isinstance(kind, T.ArrayType):
            df = df.select(F.explode("at").alias("at"))
        elif name or i:  # a document that is an array is read as its items
            raise SourceError(f"{source.path}: nothing at {source.iterator!r}")
    if not isinstance(df.schema["at"].dataType, T.StructType):
        raise SourceError(f"{source.path}: no objects at {source.iterator!r}")
    return _typed(df.select("at.*"))


def _xml(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    """Elements of the name that the iterator, such as ``/a/b``, ends in."""
    if not source.iterator:
        return _file("xml")(spark, source, options, stream)
    if not re.fullmatch(r"/{1,2}[\w.-]+(?:/[\w.-]+)*", source.iterator):
        raise UnsupportedPlanError(f"XML iterator {source.iterator!r}")
    row = ("rowTag", source.iterator.rpartition("/")[2])
    return _file("xml")(spark, replace(source, options=(row, *source.options)), options, stream)


def _view(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    if not spark.catalog.tableExists(source.path):
        raise SourceError(f"no table or view {source.path!r}")
    return _typed(spark.readStream.table(source.path) if stream else spark.table(source.path))


def _jdbc(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    return _typed(spark.read.format("jdbc").options(**{"dbtable": source.path, **dict(source.options)}).load())


def _kafka(spark: SparkSession, source: Source, options: Options, stream: bool) -> Read:
    reader = spark.readStream if stream else spark.read
    return _typed(reader.format("kafka").options(**{"subscribe": source.path, **dict(source.options)}).load())


_READERS = {
    ("File", "CSVRows"): _csv,
    ("File", "Parquet"): _file("parquet"),
    ("File", "ORC"): _file("orc"),
    ("File", "JSONPath"): _json,
    ("File", "XMLPath"): _xml,
    ("Table", "Rows"): _view,
    ("RDB", "SQL2008Table"): _jdbc,
    ("Kafka", "Rows"): _kafka,
}


def read(spark: SparkSession, source: Source, options: Options, stream: bool = False) -> Read:
    reader = _READERS.get((source.source_type, source.formulation))
    if reader is None:
        raise UnsupportedPlanError(f"source type {source.source_type!r} with {source.formulation!r}")
    return reader(spark, source, options, stream)
