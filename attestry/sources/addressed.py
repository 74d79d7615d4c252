"""A data source for blobs in files that are named by their address.

``spark.read.format("addressed").load(folder)`` gives hash and bytes of each blob; a filter on the address opens the
named files and lists nothing. ``df.write.format("addressed").mode("append").save(folder)`` adds the blobs that the folder
lacks. Each write fills a folder of its own, ``batch-...``, that gets its name once all tasks are done: readers see all of a
write or none, and one that fails leaves nothing. Below it files lie by the first digits of their digest, which are the
partitions of a scan. Files right below the folder, as ``packages.write_files`` leaves them, are read as well.

The commit is one rename, whatever the number of files; stores without an atomic rename make it a copy. Load the
folder anew for each filter of a plan: Spark plans all scans of one loaded table by the filters of one of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

SCHEMA = pa.schema([("hash", pa.string()), ("bytes", pa.binary())])
DIGITS = 3  # of a digest that name a folder: 4,096 folders, and at most so many partitions
BATCH, STAGING = "batch-", "_staging-"
FLUSH = 1 << 25  # bytes of blobs in one batch of rows


def file_name(address: str) -> str:
    """The file's name for an address; raises where that would lead out of its folder."""
    name = address.replace(":", "-")
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"no address for a file: {address!r}")
    return name


def address_of(name: str) -> str:
    return f"sha256:{name[7:]}" if name.startswith("sha256-") else name


def prefix_of(name: str) -> str:
    """The folder of a file: the first digits of what follows the name of the hash."""
    return name.rsplit("-", 1)[-1][:DIGITS]


@dataclass
class Folder:
    """One folder of addressed files, in any store that pyarrow reaches."""

    path: str
    store: fs.FileSystem = field(init=False, repr=False)
    root: str = field(init=False)

    def __post_init__(self) -> None:
        self.store, self.root = fs.FileSystem.from_uri(self.path)

    def __getstate__(self) -> dict:
        return {"path": self.path}

    def __setstate__(self, state: dict) -> None:
        self.path = state["path"]
        self.__post_init__()

    def listed(self, below: str = "") -> list[fs.FileInfo]:
        return self.store.get_file_info(fs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True))

    def batches(self) -> list[str]:
        return sorted(i.base_name for i in self.listed() if i.type == fs.FileType.Directory and i.base_name.startswith(BATCH))

    def places(self, name: str, batches: list[str]) -> list[str]:
        return [f"{self.root}/{b}/{prefix_of(name)}/{name}" for b in batches] + [f"{self.root}/{name}"]

    def found(self, name: str, batches: list[str]) -> str | None:
        places = self.places(name, batches)
        return next((p for p, i in zip(places, self.store.get_file_info(places)) if i.type == fs.FileType.File), None)

    def read(self, path: str) -> bytes:
        with self.store.open_input_stream(path) as f:
            return f.read()


@dataclass
class Part(InputPartition):
    """Names to look up, or a prefix whose folders are listed, and the batches as they were when the scan was planned."""

    batches: list[str]
    names: list[str] | None = None
    prefix: str | None = None

    def __init__(self, batches: list[str], names: list[str] | None = None, prefix: str | None = None) -> None:
        self.batches, self.names, self.prefix = batches, names, prefix


class Reader(DataSourceReader):
    def __init__(self, folder: Folder) -> None:
        self.folder, self.wanted, self.starts = folder, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what compares the address with given ones; nulls equal nothing."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("hash",):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = told if self.wanted is None else self.wanted & told
            elif isinstance(f, StringStartsWith) and f.attribute == ("hash",):
                self.starts.append(f.value)
                yield f
            elif not (isinstance(f, IsNotNull) and f.attribute in (("hash",), ("bytes",))):
                yield f

    def _may_start(self, prefix: str) -> bool:
        """Whether addresses of SHA-256 in the folder of a prefix may start as the filters say."""
        held = f"sha256:{prefix}"
        return all(held.startswith(s) or s.startswith(held) or not s.startswith("sha256:"[: len(s)]) for s in self.starts)

    def partitions(self) -> list[Part]:
        batches = self.folder.batches()
        if self.wanted is not None:
            names = []
            for a in sorted(w for w in self.wanted if w is not None):
                try:
                    names.append(file_name(a))
                except ValueError:  # no file can have it
                    continue
            return [Part(batches, names[k : k + 1000]) for k in range(0, len(names), 1000)] or [Part([], [])]
        prefixes = sorted({i.base_name for b in batches for i in self.folder.listed(b) if i.type == fs.FileType.Directory})
        flat: dict[str, list[str]] = {}
        for i in self.folder.listed():
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")):
                flat.setdefault(prefix_of(i.base_name), []).append(i.base_name)
        out = [Part(batches, flat.get(p), p) for p in sorted({*prefixes, *flat}) if self._may_start(p)]
        return out or [Part([], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names, data, size, seen = [], [], 0, set()
        for name, path in self._files(partition):
            if name in seen:
                continue
            seen.add(name)  # of one prefix, or of the names asked for
            names.append(address_of(name)), data.append(self.folder.read(path))
            size += len(data[-1])
            if size > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], schema=SCHEMA)
                names, data, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], schema=SCHEMA)

    def _files(self, part: Part) -> Iterator[tuple[str, str]]:
        if part.prefix is None:
            for name in part.names or []:
                path = self.folder.found(name, part.batches)
                if path is not None:
                    yield name, path
            return
        for b in part.batches:
            for i in self.folder.listed(f"{b}/{part.prefix}"):
                if i.type == fs.FileType.File and not i.base_name.startswith("_"):
                    yield i.base_name, i.path
        for name in part.names or []:
            yield name, f"{self.folder.root}/{name}"


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: Folder, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        self.held = [] if overwrite else folder.batches()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each file is written under a passing name first, so that an attempt that stops leaves no part of one."""
        folder, n, made = self.folder, 0, set()
        staging = f"{folder.root}/{STAGING}{self.job}"
        for batch in iterator:
            for address, data in zip(batch["hash"].to_pylist(), batch["bytes"].to_pylist()):
                if address is None or data is None:
                    raise ValueError("a blob needs an address and bytes")
                name = file_name(address)
                if not self.overwrite and folder.found(name, self.held) is not None:
                    continue
                below = f"{staging}/{prefix_of(name)}"
                if below not in made:
                    folder.store.create_dir(below, recursive=True)
                    made.add(below)
                passing = f"{below}/_{uuid.uuid4().hex}"
                with folder.store.open_output_stream(passing) as f:
                    f.write(data)
                folder.store.move(passing, f"{below}/{name}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        before = [i for i in self.folder.listed() if not i.base_name.startswith(STAGING)] if self.overwrite else []
        if any(m is not None and m.files for m in messages):
            self.folder.store.move(f"{self.folder.root}/{STAGING}{self.job}", f"{self.folder.root}/{BATCH}{self.job}")
        for i in before:
            if i.type == fs.FileType.Directory and i.base_name.startswith(BATCH):
                self.folder.store.delete_dir(i.path)
            elif i.type == fs.FileType.File and i.base_name.startswith("sha256-"):
                self.folder.store.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        staging = f"{self.folder.root}/{STAGING}{self.job}"
        if self.folder.store.get_file_info(staging).type == fs.FileType.Directory:
            self.folder.store.delete_dir(staging)


class AddressedFiles(DataSource):
    """The data source ``addressed``; its only option is the path."""

    @classmethod
    def name(cls) -> str:
        return "addressed"

    def schema(self) -> str:
        return "hash string, bytes binary"

    def reader(self, schema) -> Reader:
        return Reader(Folder(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(Folder(self.options["path"]), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AddressedFiles)
