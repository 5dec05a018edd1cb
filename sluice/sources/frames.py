"""Framed binary messages: a wire format of tagged fields, columns of encoded messages, and files of frames as a data source.

A frame is the byte 30, the length of a header, the header, the byte 31 and the message. The header is a tagged field 1 with
the message's length. A file can be read from any byte on: a reader looks for a frame that another one, or the
end of the file, follows, or whose message reads. Files written here need no such search, since a manifest lists an offset for each split.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELD = "struct<name:string,representation:string,strings:array<string>,binaries:array<binary>,integers:array<bigint>,doubles:array<double>,booleans:array<boolean>>"
MESSAGE = f"uuid binary, nanos bigint, type string, logger string, severity int, payload string, env_version string, pid int, hostname string, fields array<{FIELD}>"
#: Fixed values of the wire format: a number and a kind for each member of a message and of a field.
MEMBERS = {"uuid": (1, "bytes"), "nanos": (2, "int"), "type": (3, "text"), "logger": (4, "text"), "severity": (5, "int"), "payload": (6, "text"), "env_version": (7, "text"), "pid": (8, "int"), "hostname": (9, "text"), "fields": (10, "fields")}
FIELD_MEMBERS = {"name": (1, "text"), "representation": (3, "text"), "strings": (4, "text"), "binaries": (5, "bytes"), "integers": (6, "int"), "doubles": (7, "double"), "booleans": (8, "bool")}
#: The number that a field gives its kind of values as, in member 2.
KINDS = {"strings": 0, "binaries": 1, "integers": 2, "doubles": 3, "booleans": 4}
RECORD, UNIT, LONGEST_HEADER = 0x1E, 0x1F, 255


class Cut(ValueError):
    """Bytes that end too early or don't follow the format."""


def put_varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; negative numbers as 64-bit ones."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it), signed."""
    n, shift = 0, 0
    while True:
        if at >= len(data) or shift > 63:
            raise Cut("number")
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            n &= (1 << 64) - 1
            return (n - (1 << 64) if n >> 63 else n), at


def tagged(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """(number, wire kind, value) of each member; a value is a number, eight or four bytes, or a run of bytes."""
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = get_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = get_varint(data, at)
            value, at = data[at : at + size], at + size
            if size < 0:
                raise Cut("length")
        else:
            raise Cut("kind")
        if at > len(data) or number < 1:
            raise Cut("member")
        yield number, kind, value


def _member(number: int, kind: int, value: bytes) -> bytes:
    return put_varint(number << 3 | kind) + (put_varint(len(value)) if kind == 2 else b"") + value


def _put(number: int, kind: str, value: Any) -> bytes:
    if kind in ("text", "bytes"):
        return _member(number, 2, value.encode() if kind == "text" else bytes(value))
    return _member(number, 0, put_varint(int(value)))


def encode_field(field: dict) -> bytes:
    """A field with its name, representation and the first list of values that it has; numbers are packed."""
    out = _put(1, "text", field["name"] or "")
    found = next((k for k in KINDS if field.get(k) is not None), "strings")
    if KINDS[found]:
        out += _put(2, "int", KINDS[found])
    if field.get("representation"):
        out += _put(3, "text", field["representation"])
    number, kind = FIELD_MEMBERS[found]
    values = field.get(found) or []
    if kind in ("text", "bytes"):
        return out + b"".join(_put(number, kind, v) for v in values)
    packed = b"".join(struct.pack("<d", v) if kind == "double" else put_varint(int(v)) for v in values)
    return out + (_member(number, 2, packed) if values else b"")


def encode(message: dict) -> bytes:
    """A message; members that are null are left out."""
    out = []
    for name, (number, kind) in MEMBERS.items():
        value = message.get(name)
        if value is None:
            continue
        if kind == "fields":
            out += [_member(number, 2, encode_field(f)) for f in value]
        else:
            out.append(_put(number, kind, value))
    return b"".join(out)


_WIRE = {"text": (2,), "bytes": (2,), "fields": (2,), "int": (0, 2), "bool": (0, 2), "double": (1, 2)}


def _values(kind: str, wire: int, value: Any) -> list:
    """One value, or those of a packed run."""
    if wire not in _WIRE[kind]:
        raise Cut("kind")
    if kind == "text":
        return [value.decode("utf-8", "replace")]
    if kind == "bytes":
        return [value]
    if kind == "double":
        if len(value) % 8:
            raise Cut("double")
        return list(struct.unpack(f"<{len(value) // 8}d", value))
    if kind == "fields":
        return [_members(value, FIELD_PLACES, 7, "name")]
    numbers, at = [value] if wire == 0 else [], 0
    while wire == 2 and at < len(value):
        number, at = get_varint(value, at)
        numbers.append(number)
    return [bool(n) for n in numbers] if kind == "bool" else numbers


#: The place and kind of each number among a message's and a field's members.
PLACES = {number: (place, kind) for place, (number, kind) in enumerate(MEMBERS.values())}
FIELD_PLACES = {number: (place, kind) for place, (number, kind) in enumerate(FIELD_MEMBERS.values())}


def _members(data: bytes, places: dict[int, tuple[int, str]], count: int, needed: str) -> list[list | None]:
    """The values of each member of a message or a field, by its place; as `tagged`, in one loop. Members of other numbers are newer than this reader."""
    out: list[list | None] = [None] * count
    at, size = 0, len(data)
    while at < size:
        tag = data[at]
        if tag < 128:
            at += 1
        else:
            tag, at = get_varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 2:
            if at < size and data[at] < 128:
                stop = at + 1 + data[at]
                at += 1
            else:
                length, at = get_varint(data, at)
                if length < 0:
                    raise Cut("length")
                stop = at + length
            value, at = data[at:stop], stop
        elif wire == 0:
            value, at = get_varint(data, at)
        elif wire in (1, 5):
            stop = at + (8 if wire == 1 else 4)
            value, at = data[at:stop], stop
        else:
            raise Cut("kind")
        if at > size or number < 1:
            raise Cut("member")
        if number in places:
            place, kind = places[number]
            made = _values(kind, wire, value)
            if out[place] is None:
                out[place] = made
            else:
                out[place] += made
    if out[0] is None:  # a field's name, a message's uuid
        raise Cut(needed)
    return out


def _last(values: list | None) -> Any:
    return values[-1] if values else None


def _message(data: bytes) -> tuple[list, list[list]]:
    """(members other than fields, fields); each field is its members' values by their places."""
    found = _members(data, PLACES, 10, "header")
    if not found[1]:
        raise Cut("header")
    return [_last(x) for x in found[:9]], found[9] or []


def _field(members: list[list | None]) -> dict:
    return {"name": _last(members[0]), "representation": _last(members[1])} | dict(zip(KINDS, members[2:], strict=True))


def decode_field(data: bytes) -> dict:
    return _field(_members(data, FIELD_PLACES, 7, "name"))


def decode(data: bytes) -> dict:
    """The members of a message; of a repeated one the last counts. A message without uuid or time is cut."""
    plain, fields = _message(data)
    return dict(zip(MEMBERS, [*plain, [_field(f) for f in fields]], strict=True))


def frame(message: bytes) -> bytes:
    header = _put(1, "int", len(message))
    return bytes([RECORD, len(header)]) + header + bytes([UNIT]) + message


def _varints(numbers: np.ndarray) -> pa.BinaryArray:
    """put_varint of each number."""
    left = numbers.astype(np.int64).view(np.uint64)
    shifted = left[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))
    sizes = np.maximum((shifted > 0).sum(axis=1), 1)
    used = np.arange(10) < sizes[:, None]
    more = np.arange(10) < sizes[:, None] - 1
    data = ((shifted & np.uint64(127)).astype(np.uint8) | (more * np.uint8(128)))[used]
    return _bytes_of(data, sizes)


def _bytes_of(data: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Runs of bytes of the given sizes, one after the other."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(*parts: pa.Array | bytes, nulls: str = "emit_null") -> pa.Array:
    """The parts of each row in one, null where one of them is; with `replace` missing parts are empty."""
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts), pa.scalar(b"", pa.binary()), null_handling=nulls, null_replacement=b"")


def _runs(values: pa.Array) -> pa.Array:
    """Runs of bytes as members hold them, each after its length; null stays."""
    values = values.cast(pa.binary())
    return _joined(_varints(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)), values)


def _column(number: int, kind: str, values: pa.Array) -> pa.Array:
    """A member as `_put` writes it, for each row; null stays."""
    if kind in ("text", "bytes"):
        return _joined(put_varint(number << 3 | 2), _runs(values))
    made = _joined(put_varint(number << 3), _varints(pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)))
    return pc.if_else(values.is_valid(), made, pa.scalar(None, pa.binary()))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _grouped(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """So many neighbouring runs of bytes joined in one."""
    offsets = np.concatenate(([0], np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False)))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return _bytes_of(_data(values), np.diff(offsets[ends]))


def _data(values: pa.Array) -> np.ndarray:
    """All the bytes of a column without nulls, one value after the other."""
    offsets, data = (np.frombuffer(b or b"", t) for b, t in zip(values.buffers()[1:], (np.int32, np.uint8), strict=True))
    return data[offsets[values.offset] : offsets[values.offset + len(values)]] if len(values) else data[:0]


def _field_columns(fields: pa.StructArray) -> pa.Array:
    """encode_field of each field."""
    held = dict(zip((f.name for f in fields.type), fields.flatten(), strict=True))
    kinds = {k: held[k] for k in KINDS if k in held}
    chosen = np.zeros(len(fields), np.int64)
    values = pa.nulls(len(fields), pa.binary())
    for kind, lists in reversed(kinds.items()):  # the first list that there is counts
        number, of = FIELD_MEMBERS[kind]
        flat, sizes = lists.flatten(), _sizes(lists)
        if flat.null_count:
            raise ValueError(f"null among the {kind} of a field")
        if of in ("text", "bytes"):
            made = _grouped(_column(number, of, flat), sizes)
        elif of == "double":
            made = _bytes_of(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype("<f8").view(np.uint8), sizes * 8)
        else:
            made = _grouped(_varints(flat.cast(pa.int64()).to_numpy(zero_copy_only=False)), sizes)
        if of not in ("text", "bytes"):
            made = pc.if_else(pa.array(sizes > 0), _joined(put_varint(number << 3 | 2), _runs(made)), pa.scalar(b"", pa.binary()))
        there = lists.is_valid()
        values = pc.if_else(there, made, values)
        chosen = np.where(there.to_numpy(zero_copy_only=False), KINDS[kind], chosen)
    parts = [_column(1, "text", pc.fill_null(held["name"].cast(pa.binary()), b"")), _column(2, "int", pa.array(chosen, mask=chosen == 0))]
    if "representation" in held:
        some = pc.fill_null(pc.greater(pc.binary_length(held["representation"].cast(pa.binary())), 0), False)
        parts.append(pc.if_else(some, _column(3, "text", held["representation"]), pa.scalar(None, pa.binary())))
    return _joined(*parts, values, nulls="replace")


def encode_columns(batch: pa.RecordBatch, framed: bool = False) -> pa.Array:
    """encode of each row of the columns that are members of a message; with their frames, if wished."""
    parts = []
    for name, (number, kind) in MEMBERS.items():
        if name not in batch.schema.names:
            continue
        column = batch.column(name)
        if pa.types.is_null(column.type):
            continue
        if column.offset:  # some of Arrow's functions misread parts of a column
            column = column.take(pa.array(np.arange(len(column))))
        if kind == "fields":
            flat = _column(number, "bytes", _field_columns(column.flatten()))
            column = _grouped(flat, _sizes(column))
        else:
            column = _column(number, kind, column)
        parts.append(column)
    made = _joined(*parts, nulls="replace") if parts else pa.array([b""] * batch.num_rows, pa.binary())
    if not framed:
        return made
    header = _column(1, "int", pc.binary_length(made))
    lengths = pc.binary_length(header).to_numpy(zero_copy_only=False)
    return _joined(bytes([RECORD]), _varints(lengths), header, bytes([UNIT]), made)


def _pieces(batch: pa.RecordBatch, most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut by rows into pieces of about so many bytes."""
    rows = max(1, min(batch.num_rows, batch.num_rows * most // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encoded(df: DataFrame, name: str = "bytes", framed: bool = False) -> DataFrame:
    """df with the members of a message as one binary column, framed or not; other columns stay."""
    keep = [c for c in df.columns if c not in MEMBERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), encode_columns(batch, framed)], [*keep, name])

    schema = StructType([df.schema[c] for c in keep]).add(name, "binary")
    return df.mapInArrow(run, schema)


def decode_columns(messages: list[bytes | None]) -> tuple[list[pa.Array], list[str | None]]:
    """(the members of each message as columns, what is wrong with it): decode of many; messages that can't be read have null members."""
    none = [None] * (len(MEMBERS) - 1)
    plain, fields, sizes, errors = [], [], [], []
    for data in messages:
        try:
            values, own = _message(data or b"")
        except Cut as cut:
            plain.append(none)
            sizes.append(0)
            errors.append(str(cut))
        else:
            plain.append(values)
            fields += own
            sizes.append(len(own))
            errors.append(None)
    *types, listed = (f.type for f in _arrow_schema())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*plain, strict=True)) or [()] * len(types), types, strict=True)]
    held = list(zip(*fields, strict=True)) or [()] * len(FIELD_MEMBERS)
    inner = [pa.array([_last(x) for x in c] if k < 2 else c, f.type) for k, (c, f) in enumerate(zip(held, listed.value_type, strict=True))]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    broken = pa.array([e is not None for e in errors], pa.bool_())
    return [*columns, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(inner, fields=list(listed.value_type)), mask=broken)], errors


def decoded(df: DataFrame, name: str = "bytes") -> DataFrame:
    """df with the members of a message in place of a binary column, and decode_error, null where the bytes are whole."""
    keep = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, errors = decode_columns(batch.column(name).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns, pa.array(errors, pa.string())], [*keep, *MEMBERS, "decode_error"])

    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(f"{MESSAGE}, decode_error string").fields)
    return df.mapInArrow(run, schema)


def _arrow_schema() -> pa.Schema:
    lists = {"strings": pa.string(), "binaries": pa.binary(), "integers": pa.int64(), "doubles": pa.float64(), "booleans": pa.bool_()}
    field = pa.struct([("name", pa.string()), ("representation", pa.string()), *((k, pa.list_(t)) for k, t in lists.items())])
    plain = {"uuid": pa.binary(), "nanos": pa.int64(), "severity": pa.int32(), "pid": pa.int32(), "fields": pa.list_(field)}
    return pa.schema([(k, plain.get(k, pa.string())) for k in MEMBERS])


class Found(NamedTuple):
    """A frame's start, its message's start and its end."""

    start: int
    body: int
    end: int


class _Window:
    """Bytes of a file by their offsets, read ahead in blocks."""

    def __init__(self, file: Any, block: int = 1 << 20) -> None:
        self.file, self.block, self.at, self.data, self.size = file, block, 0, b"", file.size()
        self.known: tuple[int, Found | None] = (-1, None)  # the last answer of _claimed: a frame's end is the next one's start

    def get(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start < self.at or end > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(end - start, self.block))
        return self.data[start - self.at : end - self.at]

    def _claimed(self, at: int) -> Found | None:
        """The frame that a header here announces, if the file is long enough for it."""
        if self.known[0] != at:
            self.known = at, self._announced(at)
        return self.known[1]

    def _announced(self, at: int) -> Found | None:
        head = self.get(at, at + 2)
        if len(head) < 2 or head[0] != RECORD:
            return None
        header = self.get(at + 2, at + 3 + head[1])
        if len(header) <= head[1] or header[-1] != UNIT:
            return None
        try:
            size, end = get_varint(header, 1) if header[0] == 8 else (-1, 0)
            if end != head[1]:  # more than the one member
                size = [-1, *(v for n, k, v in tagged(header[:-1]) if (n, k) == (1, 0))][-1]
        except Cut:
            return None
        body = at + 3 + head[1]
        return Found(at, body, body + size) if 0 <= size <= self.size - body else None

    def frame_at(self, at: int) -> Found | None:
        """The frame that starts here, if it is whole.

        Another one follows it, or the file's end, or damage. Before damage its message must read, and no frame may start inside and reach
        beyond it: then it was cut, and has taken the start of the next one for its own end.
        """
        own = self._claimed(at)
        if own is None or own.end == self.size or self._claimed(own.end):
            return own
        message = self.get(own.body, own.end)
        place = message.find(bytes([RECORD]))
        while place >= 0:
            other = self._claimed(own.body + place)
            if other and other.end > own.end and (other.end == self.size or self._claimed(other.end)):
                return None
            place = message.find(bytes([RECORD]), place + 1)
        try:
            decode(message)
        except Cut:
            return None
        return own

    def next_frame(self, at: int) -> int:
        """The first place from `at` on where a whole frame starts; else the file's size."""
        while at < self.size:
            if not self.at <= at < self.at + len(self.data):
                self.get(at, at + self.block)
            place = self.data.find(bytes([RECORD]), at - self.at)
            at = self.at + (place if place >= 0 else len(self.data))
            if place >= 0:
                if self.frame_at(at):
                    return at
                at += 1
        return self.size


def frames(window: _Window, start: int, end: int, exact: bool) -> Iterator[tuple[Found, bool]]:
    """(frame, whole) for frames that start in [start, end), and for stretches that are none.

    Without exact offsets the first frame is searched for, and a stretch that begins where the last frame of a range ends, at or
    after the range's end, is this range's. So each frame and each stretch is one range's, however a file is cut.
    """
    at = start if exact or start == 0 else window.next_frame(start)
    if at >= end:
        return
    while at < window.size:
        found = window.frame_at(at)
        if found and at < end:
            yield found, True
            at = found.end
        elif found or (exact and at >= end):
            return
        else:
            after = window.next_frame(at + 1)
            yield Found(at, at, after), False
            at = after


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, exact: bool) -> None:
        self.file, self.start, self.end, self.exact = file, start, end, exact


def _manifests(fs: pafs.FileSystem, folder: str) -> list[dict] | None:
    """What committed writes have listed, or None where nothing was written by this sink."""
    listed = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{folder}/_manifests", allow_not_found=True))]
    if not listed:
        return None
    out = []
    for path in listed:
        with fs.open_input_file(path) as file:
            out += json.loads(file.readall())
    return out


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", 32 << 20))
        self.search = str(options.get("search", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Ranges of the files' bytes: from offset to offset where a manifest has them, else of equal size."""
        fs, path = filesystem(self.path)
        listed = None if self.search else _manifests(fs, path)
        if listed is not None:
            return [_Range(f"{path}/{x['file']}", a, b, True) for x in listed for a, b in zip(x["offsets"], [*x["offsets"][1:], x["size"]], strict=True)]
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(path) :].split("/"))]
        return [_Range(x.path, a, min(a + self.split, x.size), False) for x in files for a in range(0, x.size, self.split)]

    def stretches(self, partition: InputPartition) -> Iterator[tuple[tuple[str, int, int], bytes | None]]:
        """((file, offset, length), message) of each frame of a range, and of what is none, without a message."""
        if not isinstance(partition, _Range):  # no file at all
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as file:
            window = _Window(file)
            for found, whole in frames(window, partition.start, partition.end, partition.exact):
                yield (partition.file, found.start, found.end - found.start), window.get(found.body, found.end) if whole else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for place, data in self.stretches(partition):
            values, error = (None,) * len(MEMBERS), "no frame"
            if data is not None:
                try:
                    plain, fields = _message(data)
                    values, error = (*plain, [tuple(_field(f).values()) for f in fields]), None
                except Cut as cut:
                    error = str(cut)
            yield (*values, *place, error)


class FrameBatchReader(FrameReader):
    """The same rows as record batches, which Spark takes as they are."""

    ROWS, BYTES = 10_000, 64 << 20

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        places, messages, size = [], [], 0
        for place, data in self.stretches(partition):
            places.append(place)
            messages.append(data)
            size += len(data or b"")
            if len(places) >= self.ROWS or size >= self.BYTES:
                yield self._batch(places, messages)
                places, messages, size = [], [], 0
        if places:
            yield self._batch(places, messages)

    def _batch(self, places: list[tuple[str, int, int]], messages: list[bytes | None]) -> pa.RecordBatch:
        columns, errors = decode_columns(messages)
        told = ["no frame" if m is None else e for m, e in zip(messages, errors, strict=True)]
        file, offset, length = (pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True))
        return pa.RecordBatch.from_arrays([*columns, file, offset, length, pa.array(told, pa.string())], [*MEMBERS, "file", "offset", "length", "error"])


class _Written(WriterCommitMessage):
    def __init__(self, file: str, size: int, offsets: list[int]) -> None:
        self.file, self.size, self.offsets = file, size, offsets


class FrameWriter(DataSourceArrowWriter):
    """A file a task, named anew for each attempt; the manifest of a committed write lists them, so files of lost attempts don't count."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.split, self.overwrite = options["path"], int(options.get("split", 32 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        name, size, offsets = f"part-{uuid.uuid4().hex}.frames", 0, []
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in (piece for whole in iterator for piece in _pieces(whole)):
                made = encode_columns(batch, framed=True)
                for length in pc.binary_length(made).to_pylist():
                    if not offsets or size - offsets[-1] >= self.split:
                        offsets.append(size)
                    size += length
                out.write(_data(made))
        return _Written(name, size, offsets)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        held = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{path}/_manifests", allow_not_found=True))]
        old = _manifests(fs, path) or []
        fs.create_dir(f"{path}/_manifests", recursive=True)
        with fs.open_output_stream(f"{path}/_manifests/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([{"file": m.file, "size": m.size, "offsets": m.offsets} for m in messages if isinstance(m, _Written) and m.size]).encode())
        if self.overwrite:
            for gone in held + [f"{path}/{x['file']}" for x in old]:
                fs.delete_file(gone)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            if isinstance(m, _Written):
                fs.delete_file(f"{path}/{m.file}")


class FrameSource(DataSource):
    """Files of framed messages. Options: path; split, the bytes of a partition; search, to ignore manifests.

    Reading gives the members of each message and its file, offset, length and error. Bytes that are no frame, up to the next one, are a
    row with error `no frame`; a whole frame whose message can't be read has its own error. Missing manifests are no fault.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"{MESSAGE}, file string, offset bigint, length bigint, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameBatchReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options, overwrite)


def read_frames(spark: SparkSession, path: str, split: int = 32 << 20, search: bool = False) -> DataFrame:
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("split", split).option("search", search).load(path)


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run inside cut their batches by so many rows alone: to weigh a batch, as Spark does after each row, takes most of the time of a write of nested fields."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def write_frames(df: DataFrame, path: str, mode: str = "append", split: int = 32 << 20) -> None:
    """The members of messages among df's columns, as frames; a missing member is left out."""
    df.sparkSession.dataSource.register(FrameSource)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(MESSAGE).fields if f.name not in df.columns}
    places = {"file": F.lit(None).cast("string"), "offset": F.lit(None).cast("long"), "length": F.lit(None).cast("long"), "error": F.lit(None).cast("string")}
    whole = df.withColumns(missing | places).select(*MEMBERS, *places)
    with _batches_of(df.sparkSession, 500):
        whole.write.format("frames").mode(mode).option("split", split).save(path)


def field(name: str | Column, value: Column, kind: str) -> Column:
    """A field of one value, for the list of fields of a message; kind is the name of its list, such as `strings`."""
    types = {"strings": "string", "binaries": "binary", "integers": "bigint", "doubles": "double", "booleans": "boolean"}
    held = [(F.array(value) if k == kind else F.lit(None)).cast(f"array<{t}>").alias(k) for k, t in types.items()]
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(None).cast("string").alias("representation"), *held)


def value_of(fields: str, name: str, kind: str) -> Column:
    """The first value of the first field of that name, null where there is none."""
    own = F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))
    return F.get(own[kind], F.lit(0))
