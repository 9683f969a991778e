"""Archives of source trees as a data source: tar and zip files read member by member.

A partition is an archive, or a share of a zip's members; a task streams through it and holds one member at a time, so
its memory does not depend on how large the archive is.  A filter on the suffix is pushed down, and other members are
passed over unread.  Paths may lie in any store that Arrow's file systems open."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from posixpath import splitext

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, path string, suffix string, bytes bigint, content binary"
SUFFIXES = (".tar", ".tar.gz", ".tgz", ".zip")
#: Members of a zip that one task reads at least, where there are several tasks.
SHARE = 2000


class Part(InputPartition):
    def __init__(self, archive: str, share: int = 0, shares: int = 1):
        super().__init__(None)
        self.archive, self.share, self.shares = archive, share, shares


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
    return system, place


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.largest = options["path"], int(options.get("maxbytes", 1 << 30))
        self.strip = options.get("striproot", "false").lower() == "true"
        self.wanted: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take filters of the form suffix = … or suffix in (…); Spark keeps the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("suffix",):
                found = set(f.value)
            else:
                yield f
                continue
            self.wanted = frozenset(found if self.wanted is None else self.wanted & found)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, place = _open(self.path)
        info = system.get_file_info(place)
        files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File]
        parts = []
        for f in sorted(files, key=lambda i: i.path):
            if f.path.endswith(SUFFIXES):
                shares = 1
                if f.path.endswith(".zip"):
                    with system.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                        shares = max(1, len(z.namelist()) // SHARE)
                parts += [Part(f.path, k, shares) for k in range(shares)]
        return parts or [Part("")]

    def _row(self, archive: str, name: str, size: int, read) -> tuple | None:
        path = name.split("/", 1)[-1] if self.strip else name
        suffix = splitext(path)[1]
        if self.wanted is not None and suffix not in self.wanted:
            return None
        return archive, path, suffix, size, read() if size <= self.largest else None

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.archive:
            return
        system, _ = _open(self.path)
        if partition.archive.endswith(".zip"):
            with system.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z:
                members = [i for i in z.infolist() if not i.is_dir()]
                for i in members[partition.share :: partition.shares]:
                    if row := self._row(partition.archive, i.filename, i.file_size, lambda i=i: z.read(i)):
                        yield row
            return
        compressed = None if partition.archive.endswith(".tar") else "gzip"
        with system.open_input_stream(partition.archive, compression=compressed) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            for m in tar:
                if m.isfile() and (row := self._row(partition.archive, m.name, m.size, lambda m=m: tar.extractfile(m).read())):
                    yield row
                tar.members = []  # else the archive's whole list of members stays


class ArchiveSource(DataSource):
    """Options: path (an archive, or a folder of archives), maxBytes (larger members have a null content), stripRoot
    (leave out the first folder of each path, as archives of repositories have one)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark, path: str, **options):
    """(archive, path, suffix, bytes, content) of the members of the archives at a path."""
    from ..session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**{k: str(v) for k, v in options.items()}).load(path)
