"""Polygon files (shapefiles) as a Spark data source: read by ranges of records, written a file set a task."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StringType, StructField, StructType

from ratefield.functions.shapes import oriented, rings_of

POLYGON, NULL, HEADER = 5, 0, 100
#: Records that one task reads.
RECORDS = 4096
_RINGS = pa.list_(pa.list_(pa.float64()))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; a path without scheme must be on a disk that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Field:
    name: str
    kind: str
    width: int
    decimals: int

    @property
    def type(self):
        return StringType() if self.kind in "CDL" else DoubleType() if self.decimals or self.kind == "F" else LongType()

    def value(self, raw: bytes):
        text = raw.decode("utf-8", "replace").rstrip(" \0") if self.kind == "C" else raw.decode("ascii", "replace").strip(" \0*")
        if not text:
            return None
        return text if self.kind in "CDL" else float(text) if isinstance(self.type, DoubleType) else int(float(text)) if "." in text else int(text)


def _table_head(f) -> tuple[list[Field], int, int, int]:
    """Fields of an attribute table, its records, where they begin and their width."""
    head = f.read_at(32, 0)
    count, begin, width = struct.unpack_from("<IHH", head, 4)
    rest, fields = f.read_at(begin - 32, 32), []
    for at in range(0, len(rest) - 31, 32):
        if rest[at] == 0x0D:
            break
        fields.append(Field(rest[at : at + 11].split(b"\0")[0].decode("utf-8"), chr(rest[at + 11]), rest[at + 16], rest[at + 17]))
    return fields, count, begin, width


def read_shape(content: bytes) -> list | None:
    """Rings of a record in file order, without closing vertices; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == NULL:
        return None
    if kind % 10 != POLYGON:
        raise ValueError(f"not a polygon: shape type {kind}")
    parts, points = struct.unpack_from("<ii", content, 36)
    first = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return rings_of([xy[a:b, 0] for a, b in zip(first, first[1:], strict=False)], [xy[a:b, 1] for a, b in zip(first, first[1:], strict=False)])


def shape_bytes(xs, ys) -> bytes:
    """A polygon record: outer rings clockwise, holes counter-clockwise, closed."""
    rings = [] if xs is None or ys is None else [(x[::-1], y[::-1]) for part in oriented(rings_of(xs, ys)) for x, y in part]
    if not rings:
        return struct.pack("<i", NULL)
    closed = [np.column_stack([np.append(x, x[0]), np.append(y, y[0])]) for x, y in rings]
    every, first = np.concatenate(closed), np.concatenate([[0], np.cumsum([len(c) for c in closed])[:-1]])
    box = [*every.min(0), *every.max(0)]
    return struct.pack("<i4dii", POLYGON, *box, len(closed), len(every)) + first.astype("<i4").tobytes() + every.astype("<f8").tobytes()


@dataclass
class Records(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class PolygonReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, records: int):
        self.path, self.schema, self.records = path, schema, records

    def partitions(self) -> list[Records]:
        out = []
        for path in _shape_files(self.path):
            place, at = _place(path[:-4] + ".shx")
            count = (place.get_file_info(at).size - HEADER) // 8
            out += [Records(path, i, min(i + self.records, count)) for i in range(0, count, self.records)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        place, at = _place(partition.path[:-4])
        begin, end = partition.begin, partition.end
        with place.open_input_file(at + ".shx") as f:
            index = np.frombuffer(f.read_at(8 * (end - begin), HEADER + 8 * begin), ">i4").reshape(-1, 2) * 2
        with place.open_input_file(at + ".shp") as f:
            low, high = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
            data = f.read_at(high - low, low)
            shapes = [read_shape(data[o - low + 8 : o - low + 8 + n]) for o, n in index.tolist()]
        columns = {}
        with place.open_input_file(at + ".dbf") as f:
            fields, _, first, width = _table_head(f)
            rows = f.read_at(width * (end - begin), first + width * begin)
        offset = 1
        for field in fields:
            columns[field.name] = [field.value(rows[k * width + offset : k * width + offset + field.width]) for k in range(end - begin)]
            offset += field.width
        # outer rings run clockwise in files; here they run the other way
        for k, name in enumerate(("xs", "ys")):
            columns[name] = [None if s is None else [r[k][::-1].tolist() for r in s] for s in shapes]
        kinds = {"xs": _RINGS, "ys": _RINGS} | {f.name: pa.string() if isinstance(f.type, StringType) else pa.float64() if isinstance(f.type, DoubleType) else pa.int64() for f in fields}
        yield pa.record_batch([pa.array(columns[f.name], kinds[f.name]) for f in self.schema.fields], [f.name for f in self.schema.fields])


def _shape_files(path: str) -> list[str]:
    place, at = _place(path)
    if path.endswith(".shp"):
        return [path]
    found = place.get_file_info(fs.FileSelector(at))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    names = sorted(i.path for i in found if i.path.endswith(".shp") and not posixpath.basename(i.path).startswith("_"))
    if not names:
        raise FileNotFoundError(f"no shapefile in {path}")
    return [prefix + n for n in names]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PolygonWriter(DataSourceWriter):
    """Each task writes one file set under a hidden name; committing names those of the tasks that count."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        _field_plan(schema)

    def write(self, rows: Iterator) -> Written:
        place, at = _place(self.path)
        place.create_dir(at, recursive=True)
        base = f"{at.rstrip('/')}/_part-{uuid.uuid4().hex}"
        fields = _field_plan(self.schema)
        width = 1 + sum(f.width for f in fields)
        shx, count, where, box = [], 0, HEADER, np.array([np.inf, np.inf, -np.inf, -np.inf])
        # the head is known at the end, so shapes and attributes follow it from files of their own
        with place.open_output_stream(base + ".body") as shp, place.open_output_stream(base + ".rows") as dbf:
            for row in rows:
                content = shape_bytes(row["xs"], row["ys"])
                if len(content) > 4:
                    own = struct.unpack_from("<4d", content, 4)
                    box = np.array([*np.minimum(box[:2], own[:2]), *np.maximum(box[2:], own[2:])])
                count += 1
                shp.write(struct.pack(">ii", count, len(content) // 2) + content)
                shx.append((where // 2, len(content) // 2))
                where += 8 + len(content)
                dbf.write(b" " + b"".join(_cell(row[f.name], f) for f in fields))
        if count:
            head = lambda size: struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, POLYGON, *(box if np.isfinite(box).all() else [0.0] * 4), 0, 0, 0, 0)
            table = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, count, 33 + 32 * len(fields), width)
            table += b"".join(f.name.encode().ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.width, f.decimals]) + bytes(14) for f in fields) + b"\r"
            for name, first, rest, last in ((".shp", head(where), ".body", b""), (".dbf", table, ".rows", b"\x1a")):
                with place.open_output_stream(base + name) as out, place.open_input_stream(base + rest) as data:
                    out.write(first)
                    while block := data.read(1 << 20):
                        out.write(block)
                    out.write(last)
            with place.open_output_stream(base + ".shx") as out:
                out.write(head(HEADER + 8 * count) + np.array(shx, ">i4").tobytes())
        for name in (".body", ".rows"):
            place.delete_file(base + name)
        return Written([base] if count else [])

    def commit(self, messages: list[Written | None]) -> None:
        place, at = _place(self.path)
        if self.overwrite:
            for info in place.get_file_info(fs.FileSelector(at)):
                if info.is_file and not posixpath.basename(info.path).startswith("_"):
                    place.delete_file(info.path)
        for base in (n for m in messages if m for n in m.names):
            for kind in (".shp", ".shx", ".dbf"):
                place.move(base + kind, posixpath.join(posixpath.dirname(base), posixpath.basename(base)[1:]) + kind)

    def abort(self, messages: list[Written | None]) -> None:
        place, _ = _place(self.path)
        for base in (n for m in messages if m for n in m.names):
            for kind in (".shp", ".shx", ".dbf"):
                place.delete_file(base + kind)


def _field_plan(schema: StructType) -> list[Field]:
    """Attribute columns: text up to 254 bytes, whole numbers, and doubles written in full."""
    out = []
    for f in schema.fields:
        if f.name in ("xs", "ys"):
            continue
        if len(f.name.encode()) > 10:
            raise ValueError(f"{f.name}: a column's name has ten bytes at most in this format")
        if isinstance(f.dataType, StringType):
            out.append(Field(f.name, "C", 254, 0))
        elif isinstance(f.dataType, IntegralType):
            out.append(Field(f.name, "N", 20, 0))
        elif isinstance(f.dataType, DoubleType):
            out.append(Field(f.name, "F", 25, 15))
        else:
            raise ValueError(f"{f.name}: this format has no {f.dataType.simpleString()}")
    return out


def _cell(value, field: Field) -> bytes:
    if field.kind == "C":
        raw = ("" if value is None else value).encode()
        if len(raw) > field.width:
            raise ValueError(f"{field.name}: a text of {len(raw)} bytes; this format holds {field.width}")
        return raw.ljust(field.width)
    return ("" if value is None else repr(value)).encode().rjust(field.width)


class PolygonFiles(DataSource):
    """spark.read.format("polygons").load(folder or .shp) and df.write.format("polygons").save(folder).

    Rows have the attribute columns and xs, ys: arrays of rings without closing vertices, outer ones counter-clockwise,
    holes clockwise. A null shape has null rings. Reading takes the columns from the first file, 4,096 records a task
    (option records), each task its own byte range. Written text of a null is read as null, as is an empty one.
    """

    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> StructType:
        place, at = _place(_shape_files(self.options["path"])[0][:-4] + ".dbf")
        with place.open_input_file(at) as f:
            fields = _table_head(f)[0]
        ring = ArrayType(ArrayType(DoubleType()))
        return StructType([*(StructField(f.name, f.type) for f in fields)]).add("xs", ring).add("ys", ring)

    def reader(self, schema: StructType) -> PolygonReader:
        return PolygonReader(self.options["path"], schema, int(self.options.get("records", RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> PolygonWriter:
        return PolygonWriter(self.options["path"], schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(PolygonFiles)
