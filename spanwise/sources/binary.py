"""Binary sources: bigWig and BAM, by the public format descriptions.

Files of file systems that pyarrow opens (local, S3, GCS, HDFS) are read by ranges, so
they may be of any size: a bigWig file's sections are listed by one task and decoded
by many; a BAM file is one task's stream, held a block at a time. Other Hadoop file
systems are read as whole byte blocks through Spark's binaryFile reader, up to 2 GiB.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.reference import Reference

# Fixed values of the formats.
BIGWIG_MAGIC, CHROM_TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
CIGAR_OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def _locate(path: str):
    """(file system, path) of pyarrow."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class Pages:
    """Bytes of a file by slices, read and kept in pages."""

    SIZE, KEPT = 1 << 18, 64

    def __init__(self, file):
        self.file, self.pages = file, {}

    def __getitem__(self, at: slice) -> bytes:
        out, place = [], at.start
        while place < at.stop:
            number, offset = divmod(place, self.SIZE)
            if number not in self.pages:
                if len(self.pages) >= self.KEPT:
                    self.pages.clear()
                self.pages[number] = self.file.read_at(self.SIZE, number * self.SIZE)
            piece = self.pages[number][offset : offset + at.stop - place]
            if not piece:
                break
            out.append(piece)
            place += len(piece)
        return b"".join(out)


def _get(form: str, data, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Rows (source) of one file: its path where pyarrow opens it, else its whole content; and which of them."""
    try:
        system, place = _locate(path)
        if system.get_file_info(place).type == pyarrow.fs.FileType.File:
            return spark.createDataFrame([(path,)], "source string"), True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        pass
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("source")), False


def _opened(source):
    """A file's bytes by slices: of a path, or of the content itself."""
    if isinstance(source, bytes):
        return source
    system, place = _locate(source)
    return Pages(system.open_input_file(place))


def bigwig_contigs(data) -> list[tuple[str, int, int]]:
    """(name, id, length) from the chromosome tree."""
    magic, _, _, tree = _get("<IHHQ", data, 0)
    if magic != BIGWIG_MAGIC:
        raise ValueError("not a little-endian bigWig file")
    if _get("<I", data, tree)[0] != CHROM_TREE_MAGIC:
        raise ValueError("bad chromosome tree")
    key = _get("<I", data, tree + 8)[0]
    todo, found = [tree + 32], []
    while todo:
        at = todo.pop()
        leaf, _, count = _get("<BBH", data, at)
        for i in range(count):
            item = at + 4 + i * (key + 8)
            if leaf:
                name = data[item : item + key].rstrip(b"\0").decode()
                found.append((name, *_get("<II", data, item + key)))
            else:
                todo.append(_get("<Q", data, item + key)[0])
    return sorted(found, key=lambda x: x[1])


def bigwig_sections(data) -> list[tuple[int, int]]:
    """(offset, size) of the data sections, from the index's leaves."""
    at = _get("<Q", data, 24)[0]
    if _get("<I", data, at)[0] != INDEX_MAGIC:
        raise ValueError("bad index")
    todo, found = [at + 48], []
    while todo:
        at = todo.pop()
        leaf, _, count = _get("<BBH", data, at)
        for i in range(count):
            if leaf:
                found.append(_get("<QQ", data, at + 4 + 32 * i + 16))
            else:
                todo.append(_get("<Q", data, at + 4 + 24 * i + 16)[0])
    return sorted(found)


def section_runs(raw: bytes) -> list[tuple[int, int, int, float]]:
    """(contig id, start, end, value) of a decompressed section: bedGraph, variable or fixed step."""
    chrom, start, _, step, span, kind, _, count = struct.unpack_from("<IIIIIBBH", raw, 0)
    if kind == 1:
        return [(chrom, *struct.unpack_from("<IIf", raw, 24 + 12 * i)) for i in range(count)]
    if kind == 2:
        return [(chrom, s, s + span, v) for s, v in (struct.unpack_from("<If", raw, 24 + 8 * i) for i in range(count))]
    return [(chrom, start + i * step, start + i * step + span, struct.unpack_from("<f", raw, 24 + 4 * i)[0]) for i in range(count)]


def read_bigwig(spark: SparkSession, path: str, label: str = "", tasks: int | None = None) -> tuple[Reference, DataFrame]:
    """The file's reference, and its (contig, start, end, label, value) runs; NaN values are left out (missing)."""
    head, by_path = _files(spark, path)

    def contigs(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                rows = bigwig_contigs(_opened(source))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["name", "id", "length"])

    names = sorted(head.mapInArrow(contigs, "name string, id long, length long").collect(), key=lambda r: r.id)
    by_id = {r.id: r.name for r in names}

    def sections(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                found = bigwig_sections(_opened(source))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["source", "at", "size"])

    def runs(data, at: int, size: int, packed: bool):
        raw = data[at : at + size]
        rows = [r for r in section_runs(zlib.decompress(raw) if packed else raw) if r[3] == r[3]]
        return pa.RecordBatch.from_arrays([pa.array([by_id[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([label] * len(rows), pa.string()), pa.array([r[3] for r in rows], pa.float32())], ["contig", "start", "end", "label", "value"])

    def decode(batches):
        opened, data = None, None
        for b in batches:
            if not by_path:
                for source in b.column(0).to_pylist():
                    yield from (runs(source, at, size, _get("<I", source, 52)[0] > 0) for at, size in bigwig_sections(source))
                continue
            for source, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if source != opened:
                    opened, data = source, _opened(source)
                yield runs(data, at, size, _get("<I", data, 52)[0] > 0)

    if by_path:
        # Neighbouring sections stay together, so that a task reads its pages once.
        listed = head.mapInArrow(sections, "source string, at long, size long")
        head = listed.repartitionByRange(tasks or spark.sparkContext.defaultParallelism, "at").sortWithinPartitions("at")
    return Reference([(r.name, r.length) for r in names]), head.mapInArrow(decode, "contig string, start long, end long, label string, value float")


def bgzf(source):
    """Yield the decompressed blocks of a BGZF file: of its content, or of a path, read as a stream."""
    if isinstance(source, bytes):
        stream = pa.BufferReader(source)
    else:
        system, place = _locate(source)
        stream = system.open_input_stream(place, compression=None, buffer_size=1 << 20)
    with stream:
        while head := stream.read(12):
            extra = stream.read(struct.unpack_from("<H", head, 10)[0])
            field, size = 0, None
            while field < len(extra):
                tag, length = extra[field : field + 2], struct.unpack_from("<H", extra, field + 2)[0]
                if tag == b"BC":
                    size = struct.unpack_from("<H", extra, field + 4)[0] + 1
                field += 4 + length
            if size is None:
                raise ValueError("not a BGZF block")
            yield zlib.decompress(stream.read(size - 12 - len(extra))[:-8], -15)


class BgzfWriter:
    """Writes BGZF to an open file: blocks of at most 64 KiB, and the empty one that ends a file."""

    BLOCK = 0xFF00

    def __init__(self, out):
        self.out, self.held = out, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.BLOCK:
            self._block(bytes(self.held[: self.BLOCK]))
            del self.held[: self.BLOCK]

    def _block(self, raw: bytes) -> None:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(raw) + deflate.flush()
        head = struct.pack("<4BI2BH2sHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, b"BC", 2, len(body) + 25)
        self.out.write(head + body + struct.pack("<II", zlib.crc32(raw), len(raw)))

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
        self._block(b"")
        self.out.close()


class _Stream:
    """Reads exact counts of bytes from blocks."""

    def __init__(self, blocks):
        self.blocks, self.held = blocks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            block = next(self.blocks, None)
            if block is None:
                return b""
            parts.append(block)
            have += len(block)
        joined = b"".join(parts)
        self.held = joined[n:]
        return joined[:n]

    def number(self) -> int | None:
        raw = self.take(4)
        return struct.unpack("<i", raw)[0] if raw else None


def _header(stream: _Stream) -> list[tuple[str, int]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    contigs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number())[:-1].decode()
        contigs.append((name, stream.number()))
    return contigs


def bam_record(raw: bytes, contigs: list[tuple[str, int]]) -> tuple | None:
    """One read as the columns of read_sam() from qname on, without the label; None if unplaced."""
    ref, pos, name_size, mapq, _, ops, flag, bases, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", raw, 0)
    if ref < 0 or pos < 0:
        return None
    at = 32 + name_size
    cigar = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", raw, at)) or "*"
    at += 4 * ops
    packed = raw[at : at + (bases + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:bases] or "*"
    qual = raw[at + len(packed) : at + len(packed) + bases]
    text = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    return raw[32 : at - 4 * ops - 1].decode(), flag, contigs[ref][0], pos, mapq, cigar, mate_pos, mate_ref == ref, seq, text


def read_bam(spark: SparkSession, path: str, label: str = "") -> tuple[Reference, DataFrame]:
    """As read_sam(), from a BAM file; a header without a reference sequence is refused."""
    head, _ = _files(spark, path)

    def contigs(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                rows = _header(_Stream(bgzf(source)))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["id", "name", "length"])

    names = sorted(head.mapInArrow(contigs, "id long, name string, length long").collect())
    if not names:
        raise ValueError(f"{path} has no reference sequence")
    columns = ["line", "qname", "flag", "contig", "start", "mapq", "cigar", "mate_start", "same_contig", "seq", "qual", "label"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def decode(batches):
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

        for b in batches:
            for source in b.column(0).to_pylist():
                stream, rows, line = _Stream(bgzf(source)), [], 0
                known = _header(stream)
                while (size := stream.number()) is not None:
                    record = bam_record(stream.take(size), known)
                    if record:
                        rows.append((line, *record, label))
                    line += 1
                    if len(rows) >= 4096:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    schema = "line long, qname string, flag int, contig string, start int, mapq int, cigar string, mate_start int, same_contig boolean, seq string, qual string, label string"
    return Reference([(r.name, r.length) for r in names]), head.mapInArrow(decode, schema)
