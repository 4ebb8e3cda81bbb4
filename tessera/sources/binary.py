"""Spark data sources for the binary files: k-mers tables, sorted k-mer lists, genotype matrices.

Readers are split by row ranges, so a file of any size is read by many tasks;
paths are opened with pyarrow's file systems (local paths and URIs).
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessera.functions.sequences import unpack_kmer, variant_name
from tessera.operators.presence import bits_of, numbered, pattern_rows, words_of

# Fixed values of the file formats.
TABLE_MAGIC = 0xDDCCBBAA
BED_MAGIC = b"\x6c\x1b\x01"
FLAG_SHIFT, KMER_MASK = 62, (1 << 62) - 1

ROWS_A_TASK = 1_000_000
BYTES_A_TASK, BYTES_A_BATCH = 1 << 26, 1 << 20  # of a file whose rows are samples wide


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        fs, inner = pafs.FileSystem.from_uri(path)
    else:
        fs, inner = pafs.LocalFileSystem(), os.path.abspath(path)
    return fs, inner


def read_bytes(path: str, start: int = 0, length: int | None = None) -> bytes:
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(f.size() - start if length is None else length, start)


def files_in(path: str) -> list[str]:
    """Paths of the data files that a folder holds, in order."""
    fs, inner = _open(path)
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and f.size and f.base_name[:1] not in "._")
    return [path.rstrip("/") + "/" + f.rpartition("/")[2] for f in found]


def size_of(path: str) -> int:
    fs, inner = _open(path)
    return fs.get_file_info(inner).size or 0


def exists(path: str) -> bool:
    fs, inner = _open(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


class Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


def _ranges(total: int, first: int = 0, width: int = 1) -> list[Rows]:
    """Row ranges of the rows of `width` bytes from `first` up to `total`."""
    step = max(1, min(ROWS_A_TASK, BYTES_A_TASK // max(width, 1)))
    return [Rows(i, min(step, total - i)) for i in range(first, total, step)] or [Rows(0, 0)]


def _slices(part: Rows, width: int) -> list[tuple[int, int]]:
    """First row and number of rows of what is read at once."""
    step = max(1, BYTES_A_BATCH // max(width, 1))
    return [(i, min(step, part.first + part.count - i)) for i in range(part.first, part.first + part.count, step)]


class KmerRange:
    """Which k-mers a reader of sorted rows has to give: options least and most (both included), and
    filters on the column that Spark hands over. Rows outside are never read: where they end is searched in the file.

    Filters stay with Spark too, which applies them again.
    """

    def __init__(self, options):
        self.least, self.most = int(options.get("least", 0)), int(options.get("most", KMER_MASK))

    def take(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("kmer",):
                if isinstance(f, EqualTo):
                    self.least, self.most = max(self.least, f.value), min(self.most, f.value)
                elif isinstance(f, In) and f.value:
                    self.least, self.most = max(self.least, min(f.value)), min(self.most, max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            yield f

    def rows(self, path: str, start: int, width: int, total: int) -> tuple[int, int]:
        """First row and end of the rows within, of a file whose rows of `width` bytes begin with their k-mer."""

        def first_from(kmer: int) -> int:
            lo, hi = 0, total
            while lo < hi:
                mid = (lo + hi) // 2
                at = int.from_bytes(read_bytes(path, start + mid * width, 8), "little") & KMER_MASK
                lo, hi = (mid + 1, hi) if at < kmer else (lo, mid)
            return lo

        lo = first_from(self.least) if self.least > 0 else 0
        return lo, max(lo, first_from(self.most + 1) if self.most < KMER_MASK else total)


def table_header(path: str, n: int | None = None, k: int | None = None) -> tuple[int, int, int]:
    """(samples, k, rows) of a k-mers table; an error where magic, sizes or the caller's n and k don't fit."""
    head = read_bytes(path, 0, 16)
    if len(head) < 16 or int.from_bytes(head[:4], "little") != TABLE_MAGIC:
        raise ValueError(f"{path} is no k-mers table")
    samples, width = int.from_bytes(head[4:12], "little"), int.from_bytes(head[12:16], "little")
    if n is not None and n != samples or k is not None and k != width:
        raise ValueError(f"{path} has {samples} samples and k = {width}")
    rows, rest = divmod(size_of(path) - 16, 8 * (1 + -(-samples // 64)))
    if rest:
        raise ValueError(f"{path} ends within a row")
    return samples, width, rows


class KmersTable(DataSource):
    """(kmer, pa): options path, and n and k to check.

    least and most give a range of k-mers.  columns, a JSON list of sample numbers,
    squeezes rows to these samples in the order given; min_count keeps rows with
    so many of them on either side.  All of it is done where rows are read.
    names, a file with a name in each line, gives (kmer, accessions) instead: the samples of each k-mer.
    """

    @classmethod
    def name(cls):
        return "kmers_table"

    def schema(self):
        return "kmer long, accessions array<string>" if "names" in self.options else "kmer long, pa array<long>"

    def reader(self, schema):
        return KmersTableReader(self.options)


class KmersTableReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.n, self.k, self.rows = table_header(self.path, int(options["n"]) if "n" in options else None, int(options["k"]) if "k" in options else None)
        self.range = KmerRange(options)
        self.columns = np.array(json.loads(options["columns"]), np.int64) if "columns" in options else None
        self.least = int(options.get("min_count", 0))
        self.names = options.get("names")

    def pushFilters(self, filters):
        return self.range.take(filters)

    def partitions(self):
        width = 8 * (1 + -(-self.n // 64))
        first, end = self.range.rows(self.path, 16, width, self.rows)
        return _ranges(end, first, width)

    def read(self, part):
        words = -(-self.n // 64)
        width, names = 8 * (1 + words), None
        if self.names:
            names = pa.array(read_bytes(self.names).decode().splitlines(), pa.string())
            names = names if self.columns is None else names.take(pa.array(self.columns))
        for first, count in _slices(part, width):
            m = np.frombuffer(read_bytes(self.path, 16 + first * width, count * width), "<i8").reshape(-1, 1 + words)
            kmer, pa_ = pa.array(m[:, 0].copy()), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * words), pa.array(m[:, 1:].ravel()))
            if self.columns is not None or self.least or self.names:
                bits = bits_of(pa_, self.n)
                bits = bits if self.columns is None else bits[:, self.columns]
                n1 = bits.sum(axis=1, dtype=np.int64)
                ok = (n1 >= self.least) & (bits.shape[1] - n1 >= self.least)
                kmer, bits = kmer.filter(pa.array(ok)), bits[ok]
                pa_ = _named(bits, names) if self.names else words_of(bits)
            yield pa.RecordBatch.from_arrays([kmer, pa_], names=["kmer", "accessions" if self.names else "pa"])


def _named(held: np.ndarray, names: pa.Array) -> pa.ListArray:
    """For each row the names of the columns that aren't 0."""
    row, at = np.nonzero(held)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(held) + 1)).astype(np.int32)), names.take(pa.array(at)))


class SortedKmers(DataSource):
    """(kmer, flag): the flag is in the two top bits; an empty file is an error. least and most give a range of k-mers.
    With scores, pairs of k-mer and double, which come in any order of k-mers."""

    @classmethod
    def name(cls):
        return "sorted_kmers"

    def schema(self):
        return "kmer long, score double" if self.options.get("scores") == "true" else "kmer long, flag int"

    def reader(self, schema):
        return SortedKmersReader(self.options)


class SortedKmersReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.scores = options["path"], options.get("scores") == "true"
        size = size_of(self.path)
        if not size or size % (16 if self.scores else 8):
            raise ValueError(f"{self.path} is empty or ends within a row")
        self.rows = size // (16 if self.scores else 8)
        self.range = KmerRange(options)

    def pushFilters(self, filters):
        return filters if self.scores else self.range.take(filters)

    def partitions(self):
        if self.scores:
            return _ranges(self.rows)
        first, end = self.range.rows(self.path, 0, 8, self.rows)
        return _ranges(end, first)

    def read(self, part):
        if self.scores:
            m = np.frombuffer(read_bytes(self.path, part.first * 16, part.count * 16), np.dtype([("kmer", "<i8"), ("score", "<f8")]))
            yield pa.RecordBatch.from_arrays([pa.array(m["kmer"].copy()), pa.array(m["score"].copy())], names=["kmer", "score"])
        else:
            w = np.frombuffer(read_bytes(self.path, part.first * 8, part.count * 8), "<u8")
            yield pa.RecordBatch.from_arrays([pa.array((w & np.uint64(KMER_MASK)).astype(np.int64)), pa.array((w >> np.uint64(FLAG_SHIFT)).astype(np.int32))], names=["kmer", "flag"])


class SampleRows(Rows):
    def __init__(self, rows: Rows, path: str, accession: str):
        super().__init__(rows.first, rows.count)
        self.path, self.accession = path, accession


class SampleKmers(DataSource):
    """(accession, kmer, flag) of many files of sorted k-mers: option files, a JSON list of [path, accession];
    least and most give a range of k-mers. An empty file is an error."""

    @classmethod
    def name(cls):
        return "sample_kmers"

    def schema(self):
        return "accession string, kmer long, flag int"

    def reader(self, schema):
        return SampleKmersReader(self.options)


class SampleKmersReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.range = json.loads(options["files"]), KmerRange(options)

    def pushFilters(self, filters):
        return self.range.take(filters)

    def partitions(self):
        out = []
        for path, accession in self.files:
            size = size_of(path)
            if not size or size % 8:
                raise ValueError(f"{path} is empty or ends within a row")
            first, end = self.range.rows(path, 0, 8, size // 8)
            out += [SampleRows(r, path, accession) for r in _ranges(end, first)]
        return out or [SampleRows(Rows(0, 0), "", "")]

    def read(self, part):
        w = np.frombuffer(read_bytes(part.path, part.first * 8, part.count * 8), "<u8") if part.count else np.empty(0, np.uint64)
        names = pa.array([part.accession], pa.string()).take(pa.array(np.zeros(len(w), np.int64)))
        yield pa.RecordBatch.from_arrays([names, pa.array((w & np.uint64(KMER_MASK)).astype(np.int64)), pa.array((w >> np.uint64(FLAG_SHIFT)).astype(np.int32))], names=["accession", "kmer", "flag"])


def read_samples(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(accession, kmer, flag) of samples' sorted k-mers, (path, accession) each."""
    register(spark)
    return spark.read.format("sample_kmers").option("files", json.dumps([list(f) for f in files])).load()


class PlinkBed(DataSource):
    """(snp_idx, name, codes): two-bit genotype codes of the samples of a bed/bim/fam set. Option path is the base name.
    With option code (snp_idx, name, samples): names of the samples that have it; with option names (snp_idx, name) alone."""

    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return "snp_idx long, name string" + (", samples array<string>" if "code" in self.options else "" if "names" in self.options else ", codes array<int>")

    def reader(self, schema):
        return PlinkBedReader(self.options)


class PlinkBedReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["path"]
        self.n = len(fam_names(self.base + ".fam"))
        self.code, self.alone = options.get("code"), "names" in options
        if read_bytes(self.base + ".bed", 0, 3) != BED_MAGIC:
            raise ValueError(f"{self.base}.bed has another magic number")
        self.width = -(-self.n // 4)
        self.rows, rest = divmod(size_of(self.base + ".bed") - 3, self.width)
        if rest:
            raise ValueError(f"{self.base}.bed ends within a row")

    def partitions(self):
        return _ranges(self.rows, 0, 1 if self.alone else self.width)

    def read(self, part):
        lines = read_bytes(self.base + ".bim").decode().splitlines()
        samples = pa.array(fam_names(self.base + ".fam"), pa.string()) if self.code else None
        for first, count in _slices(part, 1 if self.alone else self.width):
            names = pa.array([line.split("\t")[1] for line in lines[first : first + count]], pa.string())
            columns = {"snp_idx": pa.array(np.arange(first, first + count)), "name": names}
            if not self.alone:
                m = np.frombuffer(read_bytes(self.base + ".bed", 3 + first * self.width, count * self.width), np.uint8).reshape(-1, self.width)
                codes = np.stack([(m >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(m), -1)[:, : self.n]
                if self.code:
                    columns["samples"] = _named(codes == int(self.code), samples)
                else:
                    columns["codes"] = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * self.n), pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def fam_names(path: str) -> list[str]:
    """First token of each line."""
    return [line.split()[0] for line in read_bytes(path).decode().splitlines() if line.strip()]


class RawRows(DataSource):
    """Sink of a binary column: every task writes a part, the commit joins them in order behind a header. With option side a
    second column of whole lines goes to a file of its own. With options cut and width files hold `cut` rows of `width`
    bytes, and as many lines, at the most; their numbers stand for the {} of the paths."""

    @classmethod
    def name(cls):
        return "raw_rows"

    def schema(self):
        return "row binary, line binary" if "side" in self.options else "row binary"

    def writer(self, schema, overwrite):
        return RawRowsWriter(self.options)


class Part(WriterCommitMessage):
    def __init__(self, number: int, name: str):
        self.number, self.name = number, name


class RawRowsWriter(DataSourceArrowWriter):
    """Every attempt of a task writes a part of its own; the commit joins the parts of the attempts that
    Spark reports, one a task, so that attempts that were repeated or lost do no harm."""

    def __init__(self, options):
        self.path, self.header = options["path"], bytes.fromhex(options.get("header", ""))
        self.side, self.cut, self.width = options.get("side"), int(options.get("cut", 0)), int(options.get("width", 0))
        self.paths = [self.path, *([self.side] if self.side else [])]

    def write(self, batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"{number:08d}-{uuid.uuid4().hex}"
        files = []
        for path in self.paths:
            fs, inner = _open(f"{path}.parts/{name}")
            fs.create_dir(inner.rpartition("/")[0])
            files.append(fs.open_output_stream(inner))
        for batch in batches:
            for column, f in zip(batch.columns, files):
                f.write(b"".join(column.to_pylist()))
        for f in files:
            f.close()
        return Part(number, name)

    def _pieces(self, fs, inner: str, names: list[str], lines: bool):
        """(number of the file, bytes) of the joined parts; a part that has been read is removed, so that disk holds no second copy."""
        file, left = 0, self.cut * (1 if lines else self.width)
        for name in names:
            with fs.open_input_stream(f"{inner}.parts/{name}") as f:
                while block := f.read(1 << 24):
                    while self.cut and block:
                        if not left:
                            file, left = file + 1, self.cut * (1 if lines else self.width)
                        ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) if lines else None
                        at = len(block) if lines and len(ends) < left else int(ends[left - 1]) + 1 if lines else min(left, len(block))
                        yield file, block[:at]
                        left, block = left - (min(left, len(ends)) if lines else at), block[at:]
                    if block:
                        yield file, block
            fs.delete_file(f"{inner}.parts/{name}")

    def commit(self, messages):
        names = [m.name for m in sorted((m for m in messages if m), key=lambda m: m.number)]
        for path, header in zip(self.paths, (self.header, b"")):
            fs, inner = _open(path)
            fs.create_dir(inner.rpartition("/")[0])
            now, out = 0, None
            try:
                if not self.cut:
                    out = fs.open_output_stream(inner)
                    out.write(header)
                for file, piece in self._pieces(fs, inner, names, path == self.side):
                    if self.cut and (out is None or file != now):
                        if out:
                            out.close()
                        now, out = file, fs.open_output_stream(inner.replace("{}", str(file)))
                        out.write(header)
                    out.write(piece)
            finally:
                if out:
                    out.close()
        self.abort(messages)

    def abort(self, messages):
        for path in self.paths:
            fs, inner = _open(path)
            if fs.get_file_info(f"{inner}.parts").type != pafs.FileType.NotFound:
                fs.delete_dir(f"{inner}.parts")


def register(spark: SparkSession) -> None:
    """Makes the sources known; filters are handed to Python sources only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (KmersTable, SortedKmers, SampleKmers, PlinkBed, RawRows):
        spark.dataSource.register(source)


def _binary(df: DataFrame, pack) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(batch), pa.binary())], names=["row"])

    return df.mapInArrow(run, "row binary")


def _save(rows: DataFrame, path: str, header: bytes = b"", **options) -> None:
    register(rows.sparkSession)
    rows.write.format("raw_rows").mode("append").option("path", path).option("header", header.hex()).options(**options).save()


def _table_header(names: list[str], k: int) -> bytes:
    return TABLE_MAGIC.to_bytes(4, "little") + len(names).to_bytes(8, "little") + k.to_bytes(4, "little")


def write_table_rows(rows: DataFrame, base: str, names: list[str], k: int) -> None:
    """`base`.table of rows (row) that are in its order, and `base`.names."""
    _save(rows, base + ".table", _table_header(names, k))
    write_lines(base + ".names", names)


def write_bed_rows(rows: DataFrame, base: str, names: list[str], cut: int | None = None, phenotype: dict[str, float] | None = None) -> list[str]:
    """bed, bim and fam of rows (row, line) that are in order, in one pass; with `cut` in sets base.0, base.1 and so on of so many
    variants at the most. Returns the base names."""
    more = {"cut": cut, "width": -(-len(names) // 4)} if cut else {}
    stem = base + ".{}" if cut else base
    _save(rows, stem + ".bed", BED_MAGIC, side=stem + ".bim", **more)
    out = [base]
    if cut:
        out = []
        while exists(f"{base}.{len(out)}.bed"):
            out.append(f"{base}.{len(out)}")
    for path in out:
        write_fam(path, names, phenotype)
    return out


def write_kmers_table(packed: DataFrame, base: str, names: list[str], k: int) -> None:
    """`base`.table in order of k-mers and `base`.names."""
    words = -(-len(names) // 64)

    def pack(batch):
        m = np.empty((batch.num_rows, 1 + words), "<i8")
        m[:, 0] = batch.column("kmer").to_numpy()
        if batch.num_rows:
            m[:, 1:] = batch.column("pa").flatten().to_numpy().reshape(batch.num_rows, words)
        return [r.tobytes() for r in m]

    _save(_binary(packed.select("kmer", "pa").orderBy("kmer"), pack), base + ".table", _table_header(names, k))
    write_lines(base + ".names", names)


def write_sorted_kmers(df: DataFrame, path: str) -> None:
    """kmer, with flag in the top bits if the column is there, in order of k-mers."""
    flagged = "flag" in df.columns

    def pack(batch):
        w = batch.column("kmer").to_numpy().astype(np.uint64)
        if flagged:
            w = w | (batch.column("flag").to_numpy().astype(np.uint64) << np.uint64(FLAG_SHIFT))
        return [x.tobytes() for x in w]

    _save(_binary(df.select("kmer", *(["flag"] if flagged else [])).orderBy("kmer"), pack), path)


def write_scores(df: DataFrame, path: str) -> None:
    """k-mer and score, worst first."""

    def pack(batch):
        m = np.empty(batch.num_rows, np.dtype([("kmer", "<i8"), ("score", "<f8")]))
        m["kmer"], m["score"] = batch.column("kmer").to_numpy(), batch.column("score").to_numpy()
        return [x.tobytes() for x in m]

    _save(_binary(df.select("kmer", "score").orderBy("score", "kmer"), pack), path)


def _bed_rows(codes: np.ndarray) -> list[bytes]:
    """Rows of two-bit codes, four samples a byte from the low bits."""
    x = np.pad(codes.astype(np.uint8), ((0, 0), (0, -codes.shape[1] % 4))).reshape(len(codes), -(-codes.shape[1] // 4), 4)
    return [r.tobytes() for r in x[:, :, 0] | x[:, :, 1] << 2 | x[:, :, 2] << 4 | x[:, :, 3] << 6]


def _bim(ordered: DataFrame, label: str) -> DataFrame:
    return ordered.select(F.concat(F.lit("0\t"), F.col(label).cast("string"), F.lit("\t0\t0\t0\t1\n")).cast("binary").alias("row"))


def write_fam(base: str, names: list[str], phenotype: dict[str, float] | None = None) -> None:
    """A line for each sample in the order given; samples without a value get -9."""
    write_lines(base + ".fam", [f"{a} {a} 0 0 0 {(phenotype or {}).get(a, -9):g}" for a in names])


def write_bed(packed: DataFrame, base: str, names: list[str], label: str = "name", phenotype: dict[str, float] | None = None) -> None:
    """bed, bim and fam of presence rows (kmer, pa, and `label`, the variant's name): present is code 3, absent 0."""
    n = len(names)
    ordered = packed.orderBy("kmer", label)
    _save(_binary(ordered.select("pa"), lambda batch: _bed_rows(bits_of(batch.column("pa"), n) * np.uint8(3))), base + ".bed", BED_MAGIC)
    _save(_bim(ordered, label), base + ".bim")
    write_fam(base, names, phenotype)


def write_bed_top(packed: DataFrame, best: DataFrame, base: str, names: list[str], k: int, phenotypes: dict[str, dict[str, float]]) -> list[str]:
    """A set for each phenotype with its best k-mers, named <kmer>_<rank>: best (phenotype, kmer, rank), packed
    (kmer, pa). phenotypes: for each one the samples' values. Returns the base names."""
    held = best.select("phenotype", "kmer", variant_name(unpack_kmer(F.col("kmer"), k), F.col("rank")).alias("name")).join(packed.select("kmer", "pa"), "kmer").persist()
    out = []
    for phenotype, values in phenotypes.items():
        out.append(f"{base}.{phenotype}")
        write_bed(held.where(F.col("phenotype") == phenotype), out[-1], names, phenotype=values)
    held.unpersist()
    return out


def write_bed_batches(packed: DataFrame, base: str, names: list[str], k: int, rows: int, phenotype: dict[str, float] | None = None, unique_patterns: bool = False) -> list[str]:
    """Sets base.0, base.1 and so on with at most `rows` k-mers each, in order of k-mers, each with its fam;
    with unique_patterns one k-mer of each presence pattern. Returns the base names."""
    packed = pattern_rows(packed) if unique_patterns else packed
    named = packed.select("kmer", "pa", unpack_kmer(F.col("kmer"), k).alias("name"))
    placed = numbered(named, "kmer").withColumn("batch", F.expr(f"place div {rows}")).persist()
    out = [f"{base}.{r['batch']}" for r in placed.select("batch").distinct().orderBy("batch").collect()]  # as many as files
    for i, path in enumerate(out):
        write_bed(placed.where(F.col("batch") == i), path, names, phenotype=phenotype)
    placed.unpersist()
    return out


def write_genotypes(genotypes: DataFrame, base: str, names: list[str], phenotype: dict[str, float] | None = None) -> None:
    """bed, bim and fam of rows (snp_idx, name, codes), codes as PLINK has them: 0, 1 missing, 2 heterozygous, 3."""
    n, ordered = len(names), genotypes.orderBy("snp_idx")
    pack = lambda batch: _bed_rows(np.asarray(batch.column("codes").flatten()).reshape(-1, n)) if batch.num_rows else []
    _save(_binary(ordered.select("codes"), pack), base + ".bed", BED_MAGIC)
    _save(_bim(ordered, "name"), base + ".bim")
    write_fam(base, names, phenotype)


def write_snp_subsets(spark: SparkSession, base: str, wanted: DataFrame, out: str) -> list[str]:
    """A bed and bim for each list of SNPs, out.<list>: wanted (list, snp_idx). The genotypes of base are read once,
    and codes stay as they are; the fam is copied to each. Returns the base names."""
    register(spark)
    names = fam_names(base + ".fam")
    chosen = spark.read.format("plink_bed").option("path", base).load().join(wanted.select("list", F.col("snp_idx").cast("long").alias("snp_idx")).distinct(), "snp_idx").persist()
    paths = []
    for r in wanted.select("list").distinct().orderBy("list").collect():  # as many as files
        paths.append(f"{out}.{r['list']}")
        write_genotypes(chosen.where(F.col("list") == r["list"]), paths[-1], names)
        write_lines(paths[-1] + ".fam", read_bytes(base + ".fam").decode().splitlines())
    chosen.unpersist()
    return paths


def read_raw_kmers(spark: SparkSession, path: str, with_scores: bool = False) -> DataFrame:
    """(kmer) of a file of k-mers, with or without scores, each once; no file, or an empty one, gives no rows."""
    register(spark)
    if not exists(path) or not size_of(path):
        return spark.createDataFrame([], "kmer long")
    return spark.read.format("sorted_kmers").option("path", path).option("scores", str(with_scores).lower()).load().select("kmer").distinct()


def write_lines(path: str, lines: list[str]) -> None:
    fs, inner = _open(path)
    fs.create_dir(inner.rpartition("/")[0])
    with fs.open_output_stream(inner) as f:
        f.write("".join(f"{x}\n" for x in lines).encode())
