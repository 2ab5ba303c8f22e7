"""Signal files as a Spark data source: NumPy arrays and WFDB records, read in pieces.

    signals.register(spark)
    spark.read.format("pulsegrid_signals").option("path", folder).option("kind", "wfdb").load().where("record = '1001'")

A row is a piece of one channel: record, channel, start (number of its first sample), fs, x, error. Pieces are dealt
into partitions by their bytes, a file of any size is read piece by piece, and filters on record and channel
keep other files closed. With a schema that has no x, files' heads alone are read. Folders are read by
pyarrow's file systems: local ones and those that a URI names (s3, gs, hdfs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "pulsegrid_signals"
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("record", T.StringType()), ("channel", T.StringType()), ("start", T.LongType()), ("fs", T.IntegerType()), ("x", T.ArrayType(T.DoubleType())), ("error", T.StringType()))])
CHANNELS = ("fhr", "uc")
#: Samples of a piece and bytes of a partition, unless options say otherwise.
PIECE, PARTITION = 1 << 20, 64 << 20


@dataclass(frozen=True)
class Codec:
    """A WFDB storage format: `samples` of them take `bytes`, and the value that marks a missing one."""

    samples: int
    bytes: int
    missing: int

    def decode(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data[: len(data) // self.bytes * self.bytes], np.uint8)
        if self.samples == 2:  # two of 12 bits in three bytes
            b = raw.reshape(-1, 3).astype(np.int32)
            pair = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] & 240) << 4], 1)
            return np.where(pair > 2047, pair - 4096, pair).ravel()
        if self.bytes == 1:  # offset binary
            return raw.astype(np.int32) - 128
        wide = np.zeros((len(raw) // self.bytes, 4), np.uint8)
        wide[:, 4 - self.bytes :] = raw.reshape(-1, self.bytes)
        return (wide.view("<i4").ravel() >> 8 * (4 - self.bytes)).astype(np.int64)


#: Formats by their number; fixed values of the WFDB file layout.
CODECS = {"16": Codec(1, 2, -(1 << 15)), "24": Codec(1, 3, -(1 << 23)), "32": Codec(1, 4, -(1 << 31)), "80": Codec(1, 1, -(1 << 7)), "212": Codec(2, 3, -(1 << 11))}


@dataclass(frozen=True)
class Piece:
    """Samples start to start + count of a channel of a file; `layout` says how they are stored."""

    record: str
    channel: str
    path: str
    start: int
    count: int
    layout: dict

    def bytes(self) -> int:
        return int(self.count * self.layout.get("frame_bytes", 8))


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def npy_layout(f, fs: int) -> tuple[int, dict]:
    """Length and layout of a one-dimensional array file, from its head."""
    version = np.lib.format.read_magic(f)
    shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if len(shape) != 1 or dtype.hasobject or dtype.kind not in "fiu":
        raise ValueError(f"{len(shape)} dimensions of {dtype}")
    return shape[0], {"kind": "npy", "at": f.tell(), "dtype": dtype.str, "frame_bytes": dtype.itemsize, "fs": fs}


def wfdb_layouts(head: str, by_position: bool) -> list[tuple[str, str, int, dict]]:
    """(channel, file, length, layout) of the channels that a header names: by a part of their description, or the first two in order."""
    lines = [x for x in head.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    channels, fs = int(first[1]), float(re.match(r"[\d.]+", first[2])[0]) if len(first) > 2 else 250.0
    length = int(first[3]) if len(first) > 3 else None
    rows = [x.split(None, 8) for x in lines[1 : 1 + channels]]
    out = []
    for n, part in enumerate(CHANNELS):
        k = (n if n < len(rows) else None) if by_position else next((i for i, r in enumerate(rows) if len(r) > 8 and part in r[8].lower()), None)
        if k is None:
            continue
        r = rows[k]
        form = re.match(r"(\d+)(?:x(\d+))?(?::\d+)?(?:\+(\d+))?$", r[1])
        if not form or form[1] not in CODECS or (form[2] or "1") != "1" or any(x[0] == r[0] and x[1].split("+")[0] != r[1].split("+")[0] for x in rows):
            raise ValueError(f"format {r[1]}")
        gain = re.match(r"([-\d.eE]+)(?:\((-?\d+)\))?", r[2]) if len(r) > 2 else None
        group = [i for i, x in enumerate(rows) if x[0] == r[0]]
        zero = int(gain[2]) if gain and gain[2] else int(r[4]) if len(r) > 4 else 0
        codec = CODECS[form[1]]
        out.append((part, r[0], length, {"kind": form[1], "at": int(form[3] or 0), "width": len(group), "channel": group.index(k), "gain": (float(gain[1]) if gain else 0.0) or 200.0, "zero": zero, "frame_bytes": len(group) * codec.bytes / codec.samples, "fs": int(fs)}))
    return out


def read_piece(f, p: Piece) -> np.ndarray:
    lay = p.layout
    if lay["kind"] == "npy":
        f.seek(lay["at"] + p.start * lay["frame_bytes"])
        return np.frombuffer(f.read(p.count * lay["frame_bytes"]), lay["dtype"]).astype(np.float64)
    codec, width = CODECS[lay["kind"]], lay["width"]
    skip = p.start * width  # samples before; pieces start where a whole number of bytes does
    f.seek(lay["at"] + skip // codec.samples * codec.bytes)
    wanted = -(-p.count * width // codec.samples) * codec.bytes
    data = f.read(wanted)
    whole = codec.decode(data + b"\0" * (-len(data) % codec.bytes))
    raw = whole[: len(whole) // width * width].reshape(-1, width)[: p.count, lay["channel"]].astype(np.float64)
    return np.where(raw == codec.missing, np.nan, (raw - lay["zero"]) / lay["gain"])


class SignalReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.kind = schema, options.get("kind", "npy")
        if "path" not in options:
            raise ValueError("option path is missing")
        if self.kind not in ("npy", "wfdb"):
            raise ValueError(f"kind {self.kind}")
        self.path, self.piece, self.most = options["path"], int(options.get("piecesamples", PIECE)), int(options.get("partitionbytes", PARTITION))
        self.fs, self.by_position = int(options.get("fs", 4)), options.get("channels", "name") == "position"
        self.records: set | None = None
        self.channels = set(CHANNELS)
        self.opened: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("record",), ("channel",)):
                yield f
            elif f.attribute == ("record",):
                self.records = values if self.records is None else self.records & values
            else:
                self.channels &= values

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def _pieces(self) -> Iterator[Piece]:
        store, root = self._store()
        files = {i.base_name: i for i in store.get_file_info(pafs.FileSelector(root)) if i.is_file}
        wanted = lambda record: self.records is None or record in self.records
        lazy = "x" in self.schema.fieldNames()

        def cut(record: str, channel: str, path: str, length: int, layout: dict) -> Iterator[Piece]:
            # an even number of frames, so that a packed pair isn't cut
            step = max(2, self.piece // 2 * 2)
            for start in range(0, max(1, length), step if lazy else max(1, length)):
                yield Piece(record, channel, path, start, min(step, length - start) if lazy else length, layout)

        def head(path: str):
            self.opened.append(path)
            return store.open_input_file(path)

        for name in sorted(files):
            if self.kind == "npy":
                found = re.match(r"(.+)_(fhr|uc)\.npy\Z", name)
                if not found or not wanted(found[1]) or found[2] not in self.channels:
                    continue
                try:
                    with head(files[name].path) as f:
                        length, layout = npy_layout(f, self.fs)
                    if layout["at"] + length * layout["frame_bytes"] > files[name].size:
                        raise ValueError("shorter than its head says")
                    yield from cut(found[1], found[2], files[name].path, length, layout)
                except (ValueError, OSError, EOFError, SyntaxError) as e:
                    yield Piece(found[1], found[2], files[name].path, 0, 0, {"error": str(e) or type(e).__name__})
            elif name.endswith(".hea") and wanted(record := name[:-4]):
                try:
                    with head(files[name].path) as f:
                        layouts = wfdb_layouts(f.read().decode("latin-1"), self.by_position)
                    for channel, data, length, layout in layouts:
                        if channel not in self.channels:
                            continue
                        if data not in files:
                            raise ValueError(f"no file {data}")
                        there = int((files[data].size - layout["at"]) // layout["frame_bytes"])
                        yield from cut(record, channel, files[data].path, there if length is None else min(length, there), layout)
                except (ValueError, IndexError, OSError) as e:
                    yield Piece(record, "", files[name].path, 0, 0, {"error": str(e) or type(e).__name__})

    def partitions(self) -> list[InputPartition]:
        out: list[Pieces] = []
        size = 0
        for p in self._pieces():
            if not out or size + p.bytes() > self.most:
                out.append(Pieces([]))
                size = 0
            out[-1].pieces.append(p)
            size += p.bytes()
        return out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        names = self.schema.fieldNames()
        kinds = {"record": pa.string(), "channel": pa.string(), "start": pa.int64(), "fs": pa.int32(), "x": pa.list_(pa.float64()), "error": pa.string()}
        for p in partition.pieces:
            error, x = p.layout.get("error"), None
            if error is None and "x" in names:
                try:
                    with store.open_input_file(p.path) as f:
                        values = pa.array(read_piece(f, p), from_pandas=True)
                    x = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                except (ValueError, OSError) as e:
                    error = str(e) or type(e).__name__
            values = {"record": p.record, "channel": p.channel or None, "start": p.start if error is None else None, "fs": p.layout.get("fs"), "error": error}
            yield pa.RecordBatch.from_arrays([(x if x is not None else pa.nulls(1, kinds["x"])) if n == "x" else pa.array([values[n]], kinds[n]) for n in names], names)


class SignalSource(DataSource):
    """Options: path, kind (npy or wfdb), pieceSamples, partitionBytes, fs (of npy files), channels (name or position, of WFDB records)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> SignalReader:
        if extra := [n for n in schema.fieldNames() if n not in SCHEMA.fieldNames()]:
            raise ValueError(f"no columns {extra}")
        return SignalReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filters."""
    spark.dataSource.register(SignalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def whole(pieces: DataFrame) -> DataFrame:
    """record, fhr, uc, fs, error from pieces, channels trimmed to the common length; a channel that isn't there is NULL. One record is one row."""
    samples = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("channel") == c) & F.col("x").isNotNull(), F.struct("start", "x")))), lambda p: p["x"]))
    g = pieces.groupBy("record").agg(*[samples(c).alias(c) for c in CHANNELS], *[F.count_if((F.col("channel") == c) & F.col("x").isNotNull()).alias(f"n_{c}") for c in CHANNELS], F.max("fs").alias("fs"), F.max("error").alias("error"))
    there = {c: F.when(F.col(f"n_{c}") > 0, F.col(c)) for c in CHANNELS}
    n = F.least(*[F.size(F.when(F.col(f"n_{c}") > 0, F.col(c))) for c in CHANNELS])
    shortest = F.when((F.col("n_fhr") > 0) & (F.col("n_uc") > 0), n)
    return g.select("record", *[F.when(shortest.isNotNull(), F.slice(c, F.lit(1), shortest)).otherwise(there[c]).alias(c) for c in CHANNELS], "fs", "error")
