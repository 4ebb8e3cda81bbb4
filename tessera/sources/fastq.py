"""FASTQ reads as a Spark data source, split by byte ranges."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.binary import read_bytes, size_of

SPLIT = 64 << 20  # bytes of a file that one task reads
AHEAD = 1 << 20  # bytes read beyond a split at a time, until its last record ends
BATCH = 20_000


class Piece(InputPartition):
    def __init__(self, path: str, accession: str, start: int, end: int | None):
        self.path, self.accession, self.start, self.end = path, accession, start, end


class Fastq(DataSource):
    """(accession, name, seq): option files, a JSON list of [path, accession]. Paths that end in .gz are read by one task."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "accession string, name string, seq string"

    def reader(self, schema):
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])

    def partitions(self):
        out = []
        for path, accession in self.files:
            if path.endswith(".gz"):
                out.append(Piece(path, accession, 0, None))
            else:
                size = size_of(path)
                out += [Piece(path, accession, a, min(a + SPLIT, size)) for a in range(0, size, SPLIT)]
        return out or [Piece("", "", 0, 0)]

    def read(self, part):
        rows = []
        for name, seq in records(part):
            rows.append((name, seq))
            if len(rows) == BATCH:
                yield _batch(part.accession, rows)
                rows = []
        if rows:
            yield _batch(part.accession, rows)


def _batch(accession, rows):
    names, seqs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([accession] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(seqs, pa.string())], names=["accession", "name", "seq"])


def starts_record(lines: list[bytes], i: int) -> bool:
    """Whether a record of four lines begins at line i: a quality line may begin with @ too, but is followed by a
    name and bases, not by bases and a line with +."""
    return lines[i][:1] == b"@" and lines[i + 2][:1] == b"+" and len(lines[i + 1]) == len(lines[i + 3])


def records(part: Piece):
    """(name, bases) of the records that begin within a piece."""
    if part.end is None:
        data, begin, stop = gzip.decompress(read_bytes(part.path)), 0, None
    else:
        size, stop = (size_of(part.path) if part.path else 0), part.end
        begin = max(part.start - 1, 0)  # with the byte before, to see whether a line begins at the start
        end = min(part.end + AHEAD, size)
        data = read_bytes(part.path, begin, end - begin) if size else b""
        while end < size and not _whole(data, stop - begin):
            data += read_bytes(part.path, end, min(AHEAD, size - end))
            end = min(end + AHEAD, size)
    at = 0
    if part.start:
        at = data.find(b"\n") + 1
        if not at:
            return
    raw, offsets, here = data[at:].split(b"\n"), [], begin + at
    for line in raw:
        offsets.append(here)
        here += len(line) + 1
    lines = [line.rstrip(b"\r") for line in raw]
    i = 0
    if part.start:
        while i + 3 < len(lines) and not starts_record(lines, i):
            i += 1
        if i + 3 >= len(lines):  # the end of a record that began before
            return
    while i < len(lines) and not lines[i]:
        i += 1  # empty lines at the start
    while i + 3 < len(lines) and (stop is None or offsets[i] < stop):
        if not starts_record(lines, i):
            raise ValueError(f"{part.path}: no FASTQ record at byte {offsets[i]}")
        yield lines[i][1:].split()[0].decode() if len(lines[i]) > 1 else "", lines[i + 1].decode("ascii")
        i += 4
    if i < len(lines) and (stop is None or offsets[i] < stop) and any(lines[i:]):
        raise ValueError(f"{part.path} ends within a record")


def _whole(data: bytes, stop: int) -> bool:
    """Whether eight lines end beyond `stop`: a record that begins before it ends in data then."""
    at = stop
    for _ in range(8):
        at = data.find(b"\n", at) + 1
        if not at:
            return False
    return True


def read_fastq(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(accession, name, seq) of the reads of all files, (path, accession) each; several files may share an accession."""
    spark.dataSource.register(Fastq)
    return spark.read.format("fastq").option("files", json.dumps([list(f) for f in files])).load()
