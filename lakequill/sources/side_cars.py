"""Vectors in side-car files: NPZ archives as a data source, format "side_cars".

An archive has a member for the ids and one for each vector column; the first axis of all runs over the rows. Members are
read by name, so what isn't asked for stays unread, and headers are compared before data. Each archive that can't be used
gives one row with its file and the reason, and no values: a scan never stops, and never drops anything in silence.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _header(archive: zipfile.ZipFile, member: str) -> tuple[int, ...]:
    with archive.open(f"{member}.npy") as f:
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def _values(archive: zipfile.ZipFile, member: str) -> np.ndarray:
    with archive.open(f"{member}.npy") as f:
        return np.lib.format.read_array(f, allow_pickle=False)


class SideCarReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.folder, self.key, self.names = options["path"], options.get("key", "id"), schema.names
        self.shapes = {k.removeprefix("shape."): tuple(int(x) for x in v.split(",")) for k, v in options.items() if k.startswith("shape.")}
        self.members = [n for n in schema.names if n not in (self.key, "file", "reason")]
        self.each = int(options.get("files", 64))

    def partitions(self) -> list[Files]:
        """So many files a task; the names are all that the driver sees."""
        system, root = fs.FileSystem.from_uri(self.folder)
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".npz"))
        return [Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            name = path.rpartition("/")[2]
            try:
                rows = list(self.rows(system, path, name))
            except Exception as e:  # noqa: BLE001  (whatever is wrong with a file becomes its row)
                rows = [tuple({"file": name, "reason": f"{type(e).__name__}: {e}"}.get(n) for n in self.names)]
            yield from rows

    def rows(self, system: fs.FileSystem, path: str, name: str) -> Iterator[tuple]:
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            have = {m.removesuffix(".npy") for m in archive.namelist()}
            if missing := [m for m in (self.key, *self.members) if m not in have]:
                raise ValueError(f"no member {', '.join(missing)}")
            count = _header(archive, self.key)[0]
            for m in self.members:
                shape, asked = _header(archive, m), self.shapes.get(m)
                if asked is not None and shape[1:] != asked or shape[0] != count:
                    raise ValueError(f"{m} has shape {shape}, not {(count, *(asked or shape[1:]))}")
            data = {m: _values(archive, m) for m in (self.key, *self.members)}
        for m in self.members:
            if not np.isfinite(data[m]).all():
                raise ValueError(f"{m} holds values that are not finite")
        lists = {m: data[m].tolist() for m in data} | {"file": [name] * count, "reason": [None] * count}
        yield from zip(*(lists[n] for n in self.names), strict=True)


class SideCars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "side_cars"

    def reader(self, schema: T.StructType) -> SideCarReader:
        return SideCarReader(schema, dict(self.options))


def read_side_cars(spark: SparkSession, path: str, key: str = "id", **shapes: tuple[int, ...]) -> DataFrame:
    """(key, a column of doubles for each member named with its shape, file, reason) of the archives in a folder."""
    spark.dataSource.register(SideCars)
    columns = ", ".join(f"{m} {'array<' * len(shape)}double{'>' * len(shape)}" for m, shape in shapes.items())
    reader = spark.read.format("side_cars").schema(f"{key} long, {columns}, file string, reason string").option("key", key)
    for m, shape in shapes.items():
        reader = reader.option(f"shape.{m}", ",".join(map(str, shape)))
    return reader.load(path)


def write_side_cars(df: DataFrame, path: str, key: str, columns: list[str], rows: int = 64) -> DataFrame:
    """An archive for each `rows` successive keys, written by the tasks; (file, n) of each when the result is run."""
    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)

    def work(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out, number = io.BytesIO(), group[0].as_py()
        arrays = {key: np.array(table[key].to_pylist(), np.int64), **{c: np.array(table[c].to_pylist(), np.float64) for c in columns}}
        np.savez(out, **arrays)
        there, folder = fs.FileSystem.from_uri(path)
        with there.open_output_stream(f"{folder}/{number:012d}.npz", compression=None) as f:
            f.write(out.getvalue())
        return pa.table({"file": [f"{number:012d}.npz"], "n": pa.array([len(table)], pa.int64())})

    chosen = df.select(key, *columns, F.floor(F.col(key) / rows).cast("long").alias("_group"))
    return chosen.groupBy("_group").applyInArrow(work, "file string, n long")
