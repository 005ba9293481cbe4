"""JSON lines as a partitioned Python data source.

``register(spark)`` makes the format ``lexiloom_jsonl`` known.  Files are listed
through Arrow's file systems, cut into byte ranges, and each range reads the
lines that begin in it, in blocks that Arrow's JSON parser takes at once.  Only
the fields of the given schema are made; filters that Spark hands over are
applied to a block before it leaves the worker; with ``limit`` a range stops after
so many rows.

Three columns are filled where the schema asks for them: ``_path``, ``_offset``
(the byte where the line begins) and ``_error``.  A line that is not one JSON
object, or does not fit the schema, raises with its path and offset; where
``_error`` is asked for, it becomes a row with the reason and no values.

Folders named ``name=value``, as partitioned sinks write them, give string columns
of that name where the schema asks for them.

Options: ``path``; ``revision``, a folder under it that is read in its place and
must be there; ``rangeBytes``; ``limit``; ``pushFilters``, which :func:`read` sets
where the session has ``spark.sql.python.filterPushdown.enabled``, as Spark asks
for (else Spark filters the rows itself).

Defined cases: byte-order marks and blank lines are skipped; a line may be longer
than a range; compressed files are one range; names that begin with ``_`` or
``.`` are no data, and folders are read to any depth; a field that a line lacks,
or has as null, is null; a value that is no string in a string column is its JSON
text; an empty folder is an empty table; a path that is not there raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "lexiloom_jsonl"
#: Bytes of a range, and of the blocks that it is parsed in.
RANGE_BYTES, BLOCK = 64 << 20, 4 << 20
#: Columns that say where a row is from.
PATH, OFFSET, ERROR = "_path", "_offset", "_error"
BOM = b"\xef\xbb\xbf"
#: Fixed value: the folder of a null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``end`` (None: all of a compressed file)."""

    path: str
    start: int
    end: int | None

    def __post_init__(self):
        self.value = (self.path, self.start, self.end)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a URI or a local path, and the path in it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def data_files(path: str) -> list[pa.fs.FileInfo]:
    """The data files at a path, by name."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pa.fs.FileType.File:
        return [info]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    inside = lambda f: f.path[len(at) :].strip("/").split("/")
    return sorted((f for f in found if f.type == pa.fs.FileType.File and not any(p[0] in "_." for p in inside(f))), key=lambda f: f.path)


def folder_values(root: str, path: str) -> dict[str, str | None]:
    """Columns that the folders between a root and a file name, ``name=value`` each."""
    _, at = file_system(root)
    inside = path[len(at) :].strip("/").split("/")[:-1]
    pairs = (unquote(p).split("=", 1) for p in inside if "=" in p)
    return {k: None if v == NO_VALUE else v for k, v in pairs}


def pinned(path: str, revision: str | None) -> str:
    """``path``, or the folder of a revision under it, which must be there."""
    if not revision:
        return path
    if "/" in revision or revision in (".", ".."):
        raise ValueError(f"{revision!r} is no name of a revision")
    at = f"{path.rstrip('/')}/{revision}"
    fs, inner = file_system(at)
    if fs.get_file_info(inner).type != pa.fs.FileType.Directory:
        raise FileNotFoundError(f"no revision {revision!r} at {path}")
    return at


def _split(stream) -> Iterator[bytes]:
    """Lines of a stream without their line feeds."""
    parts: list[bytes] = []  # of a line that spans reads
    while piece := stream.read(1 << 20):
        first, *more = piece.split(b"\n")
        parts.append(first)
        for begun in more:
            yield b"".join(parts)
            parts = [begun]
    if any(parts):
        yield b"".join(parts)


def lines_of(stream, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in ``[start, end)``, with that byte.  The stream stands one byte before ``start``, if there is one."""
    lines, at = _split(stream), start
    if start:  # up to the first line feed from there on is the rest of a line that begins before
        at = start + len(next(lines, b""))
    for line in lines:
        if end is not None and at >= end:
            return
        yield at, line
        at += len(line) + 1


class LineError(ValueError):
    """A line that is not one object of the schema."""


def _value(value, kind: pa.DataType):
    if pa.types.is_integer(kind) and isinstance(value, (bool, float)) or pa.types.is_floating(kind) and isinstance(value, bool):
        raise LineError(f"{json.dumps(value)} in a column of {kind}")
    if value is None or not pa.types.is_string(kind) or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def parse_line(line: bytes, schema: pa.Schema) -> dict:
    """A line's fields, or :class:`LineError`."""
    try:
        row = json.loads(line.decode("utf-8"))
    except (ValueError, RecursionError) as wrong:
        raise LineError(f"no JSON: {wrong}") from None
    if not isinstance(row, dict):
        raise LineError(f"a JSON {type(row).__name__}, not an object")
    out = {}
    for field in schema:
        try:
            out[field.name] = pa.scalar(_value(row.get(field.name), field.type), field.type).as_py()
        except LineError as wrong:
            raise LineError(f"{field.name}: {wrong}") from None
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, UnicodeEncodeError) as wrong:
            raise LineError(f"{field.name}: {wrong}") from None
    return out


def _fast(lines: list[bytes], schema: pa.Schema) -> pa.Table | None:
    """All lines through Arrow's parser; None where it can't take them as they are."""
    if not len(schema) or not all(x.startswith(b"{") and x.endswith(b"}") for x in lines):  # so no object spans lines
        return None
    options = pa.json.ParseOptions(explicit_schema=schema, newlines_in_values=False, unexpected_field_behavior="ignore")
    data = b"\n".join(lines)
    try:
        table = pa.json.read_json(pa.BufferReader(data), pa.json.ReadOptions(use_threads=False, block_size=len(data) + 2), options)
        table.validate(full=True)  # strings are UTF-8
    except pa.ArrowInvalid:
        return None
    return table.select(schema.names) if table.num_rows == len(lines) else None


def _matches(table: pa.Table, f: Filter):
    """Rows of a table that a filter keeps (null: no)."""
    if isinstance(f, Not):
        return pc.invert(_matches(table, f.child))
    own = table[f.attribute[0]]
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
    if type(f) in compare:
        return compare[type(f)](own, pa.scalar(f.value, own.type))
    if isinstance(f, EqualNullSafe):
        return pc.is_null(own) if f.value is None else pc.coalesce(pc.equal(own, pa.scalar(f.value, own.type)), False)
    if isinstance(f, In):
        found = pc.is_in(own, pa.array([v for v in f.value if v is not None], own.type))
        return pc.if_else(pc.or_(pc.is_null(own), pc.and_(pc.invert(found), any(v is None for v in f.value))), None, found)
    if isinstance(f, IsNull):
        return pc.is_null(own)
    if isinstance(f, IsNotNull):
        return pc.is_valid(own)
    return {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}[type(f)](own, f.value)


def _takes(f: Filter, schema: pa.Schema) -> bool:
    """Can the reader apply this filter as Spark would?  Strings and whole numbers only: others compare in ways of their own."""
    if isinstance(f, Not):
        return _takes(f.child, schema)
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in schema.names or f.attribute[0] == ERROR:
        return False
    kind = schema.field(f.attribute[0]).type
    text = isinstance(f, (StringStartsWith, StringEndsWith, StringContains))
    known = text or isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull))
    return known and (pa.types.is_string(kind) or pa.types.is_integer(kind) and not text)


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        if "path" not in options:
            raise ValueError("the option path is missing")
        self.schema = to_arrow_schema(schema)
        self.root = pinned(options["path"], options.get("revision"))
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.filters: list[Filter] = []
        if self.step < 1 or self.limit is not None and self.limit < 0:
            raise ValueError("rangeBytes is at least 1 and limit at least 0")

    def partitions(self) -> Sequence[Range]:
        out = []
        for f in data_files(self.root):
            if f.path.endswith(_PACKED):
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, at, min(at + self.step, f.size)) for at in range(0, f.size, self.step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        left = self.limit
        for table in self._blocks(partition):
            for f in self.filters:
                table = table.filter(_matches(table, f))
            if left is not None:
                table = table.slice(0, left)
                left -= table.num_rows
            yield from table.to_batches()
            if left == 0:
                return

    def _blocks(self, part: Range) -> Iterator[pa.Table]:
        if not part.path or self.limit == 0:
            return
        fs, _ = file_system(self.root)
        with fs.open_input_stream(part.path) if part.end is None else fs.open_input_file(part.path) as stream:
            if part.start:
                stream.seek(part.start - 1)
            offsets: list[int] = []
            lines: list[bytes] = []
            held = 0
            for at, line in lines_of(stream, part.start, part.end):
                line = line.removeprefix(BOM).strip(b" \t\r")
                if not line:
                    continue
                offsets.append(at)
                lines.append(line)
                held += len(line)
                if held >= BLOCK or self.limit is not None and len(lines) >= max(1, self.limit):
                    yield self._table(part.path, offsets, lines)
                    offsets, lines, held = [], [], 0
            if lines:
                yield self._table(part.path, offsets, lines)

    def _table(self, path: str, offsets: list[int], lines: list[bytes]) -> pa.Table:
        folders = folder_values(self.root, path)
        fields = pa.schema([f for f in self.schema if f.name not in (PATH, OFFSET, ERROR) and f.name not in folders])
        table, errors = _fast(lines, fields), None
        if table is None:  # line by line, to name what is wrong
            rows, errors = [], []
            for at, line in zip(offsets, lines, strict=True):
                try:
                    alone = _fast([line], fields)
                    rows.append(parse_line(line, fields) if alone is None else alone.to_pylist()[0])
                    errors.append(None)
                except LineError as wrong:
                    if ERROR not in self.schema.names:
                        raise ValueError(f"{path} at byte {at}: {wrong}") from None
                    rows.append({})
                    errors.append(str(wrong))
            table = pa.Table.from_pylist([{f.name: r.get(f.name) for f in fields} for r in rows], fields)
        own = {PATH: pa.array([path] * len(lines), pa.string()), OFFSET: pa.array(offsets, pa.int64()), ERROR: pa.array(errors or [None] * len(lines), pa.string())}
        own |= {k: pa.array([v] * len(lines), pa.string()) for k, v in folders.items() if k in self.schema.names}
        return pa.Table.from_arrays([own[f.name].cast(f.type) if f.name in own else table[f.name].cast(f.type) for f in self.schema], schema=self.schema)


class PushingReader(Reader):
    """A reader that takes filters, which Spark allows only where the session says so."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _takes(f, self.schema):
                self.filters.append(f)
            else:
                yield f


class JsonLines(DataSource):
    """Read with a schema: ``spark.read.format("lexiloom_jsonl").schema(...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> Reader:
        return (PushingReader if self.options.get("pushfilters") == "true" else Reader)(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)


def read(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """The lines at ``path`` as a frame; ``options`` as above."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).schema(schema).options(pushFilters=push, **{k: v for k, v in options.items() if v is not None}).load(path)


def first_rows(spark: SparkSession, path: str, schema: T.StructType | str, rows: int, **options) -> DataFrame:
    """The first ``rows`` lines in order of path and offset: each range stops after that many, and what is over is cut."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, *[f for f in T._parse_datatype_string(f"{PATH} string, {OFFSET} long").fields if f.name not in schema.names]])
    return read(spark, path, wide, limit=rows, **options).orderBy(PATH, OFFSET).limit(rows).select(*[f"`{n}`" for n in schema.names])


def infer(spark: SparkSession, path: str, revision: str | None = None) -> T.StructType:
    """The schema of all lines, by Spark's own inference (a column of mixed kinds is a string), and the columns that folders name."""
    where = f"{path.rstrip('/')}/{revision}" if revision else path
    fields = [f for f in spark.read.option("recursiveFileLookup", True).json(where).schema.fields if f.name != "_corrupt_record"]
    folders = {k for f in data_files(where) for k in folder_values(where, f.path)}
    return T.StructType([f for f in fields if f.name not in folders] + [T.StructField(k, T.StringType()) for k in sorted(folders)])
