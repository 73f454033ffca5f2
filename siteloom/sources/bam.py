"""Binary alignments as a data source: format "bam", read and written.

A file is a chain of compressed blocks of up to 64 KB; a place in it is a virtual offset, a block's offset and one within
its bytes. Reading cuts files into ranges of virtual offsets, of about `split` bytes each: at offsets that the file's index
knows, else at the first record after a multiple of `split`, which is told from other bytes by a chain of plausible
records. A region, or a filter on chrom and pos, leaves the ranges that the index names for it. Blocks become Arrow columns
without a step for each record, but for tags. Nothing reads a whole file in one task.

Options: `sample` (for the sample column), `columns` (comma-separated; only these are decoded), `region` (contig or
contig:start-end, half-open from 0; reads that overlap it), `split`, and `contigs` for writing ("name:length,...").
Files are opened with pyarrow's file systems, so a path may be local, file:, hdfs:, s3: or gs:. Filters are pushed with the
option `pushdown`, which needs spark.sql.python.filterPushdown.enabled; Spark applies them again. A folder is read as all its .bam files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schema

#: Fixed values of the format.
LETTERS, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
_MAGIC = b"\x1f\x8b\x08\x04"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FLAGS = {"is_read1": 64, "is_duplicate": 1024, "is_unmapped": 4, "mate_is_unmapped": 8, "is_secondary": 256, "is_supplementary": 2048, "is_reverse": 16, "mate_is_reverse": 32}
_SIZES = {"c": ("<i1", 1), "C": ("<u1", 1), "s": ("<i2", 2), "S": ("<u2", 2), "i": ("<i4", 4), "I": ("<u4", 4), "f": ("<f4", 4)}
#: Windows of the linear index; its bins have widths of 8 ** k such windows.
WINDOW = 1 << 14
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
SPLIT, BATCH, BLOCK = 64 << 20, 4 << 20, 65280
#: So many records in a row must be plausible for a place to count as a record's.
CHAIN = 6


class File:
    """A file that counts the bytes read from it."""

    def __init__(self, path: str):
        fs, name = (pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path))
        self.handle = fs.open_input_file(name)
        self.size, self.taken = self.handle.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        out = self.handle.read_at(max(0, min(n, self.size - offset)), offset) if offset < self.size else b""
        self.taken += len(out)
        return out


def block_size(data: bytes, at: int) -> int:
    """The size of the block whose header is at a place; 0 if none is."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 18:
        return 0
    i, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while i + 4 <= min(end, len(data)):
        n = struct.unpack_from("<H", data, i + 2)[0]
        if data[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return 0


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)


def blocks(file: File, offset: int, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the blocks from an offset on."""
    data, base = b"", offset
    while base < file.size:
        n = block_size(data, 0)
        if (not n or len(data) < n) and len(data) < 1 << 16 and base + len(data) < file.size:
            data += file.at(base + len(data), piece)
            n = block_size(data, 0)
        if not n or len(data) < n:
            raise ValueError(f"no whole block at {base}")
        yield base, inflate(data[:n])
        data, base = data[n:], base + n


@dataclass(frozen=True)
class Header:
    text: str
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    #: Where the first record is.
    start: int


def header(file: File) -> Header:
    data, places = b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            offset, more = next(source)
            places.append((len(data), offset))
            data += more

    source = blocks(file, 0, 1 << 16)
    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError("not a file of binary alignments")
    n_text = struct.unpack_from("<i", data, 4)[0]
    need(12 + n_text)
    text, at = data[8 : 8 + n_text].rstrip(b"\0").decode(), 8 + n_text
    names, lengths = [], []
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        names.append(data[at + 4 : at + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + size)[0])
        at += 8 + size
    k = max(i for i, (p, _) in enumerate(places) if p <= at)
    return Header(text, tuple(names), tuple(lengths), places[k][1] << 16 | (at - places[k][0]))


def bins(start: int, end: int) -> set[int]:
    """The bins that may hold reads overlapping [start, end)."""
    return {b for first, shift in LEVELS for b in range(first + (start >> shift), first + (max(end - 1, start) >> shift) + 1)}


def bin_of(start: int, end: int) -> int:
    """The least bin that holds [start, end) whole."""
    for first, shift in reversed(LEVELS):
        if start >> shift == (max(end, start + 1) - 1) >> shift:
            return first + (start >> shift)
    return 0


def bins_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """bin_of() of many."""
    out, last = np.zeros(len(start), np.int64), np.maximum(end, start + 1) - 1
    for first, shift in LEVELS:
        out = np.where(start >> shift == last >> shift, first + (start >> shift), out)
    return out


class Index:
    """For each contig the ranges of virtual offsets by bin, and the least offset of reads that overlap each window."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\1":
            raise ValueError("not an index of binary alignments")
        at = 8
        self.contigs: list[tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]] = []
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            found: dict[int, list[tuple[int, int]]] = {}
            n_bins = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", data, at)
                ends = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                at += 8 + 16 * n
                if number < 37450:  # beyond are counts
                    found[number] = list(zip(ends[::2], ends[1::2]))
            n = struct.unpack_from("<i", data, at)[0]
            self.contigs.append((found, struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n

    def ranges(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all reads of a contig that overlap [start, end), joined where they touch."""
        if ref >= len(self.contigs):
            return []
        found, windows = self.contigs[ref]
        least = windows[min(start >> 14, len(windows) - 1)] if windows else 0
        out: list[list[int]] = []
        wanted = bins(start, end)
        for a, b in sorted(x for k in (found.keys() & wanted) for x in found[k] if x[1] > least):
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def places(self) -> list[int]:
        """Virtual offsets where a record begins."""
        return sorted({a for found, windows in self.contigs for x in found.values() for a, _ in x} | {w for _, windows in self.contigs for w in windows if w})


def _plausible(data: bytes, at: int, h: Header) -> int:
    """The place after the record at a place, if it may be one; -1 if it can't; 0 if the bytes end within it."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    n = len(h.names)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < n and -1 <= next_ref < n and l_name > 0 and l_seq >= 0 and least <= size < 1 << 28) or (ref >= 0 and not -1 <= pos <= h.lengths[ref]) or (next_ref >= 0 and not -1 <= next_pos <= h.lengths[next_ref]):
        return -1
    name = data[at + 36 : at + 36 + l_name]
    if name and (b"\0" in name[: l_name - 1] or (len(name) == l_name and name[-1]) or any(c < 33 or c > 126 for c in name[:-1])):
        return -1
    ops = struct.unpack_from(f"<{k}I", data, at + 36 + l_name) if (k := min(n_cigar, max(0, (len(data) - at - 36 - l_name) // 4))) else ()
    return -1 if any(x & 15 > 8 for x in ops) else at + 4 + size


def first_record(file: File, offset: int, h: Header) -> int | None:
    """The virtual offset of the first record that begins in a block from an offset on; None if there is no more."""
    if offset <= h.start >> 16:
        return h.start
    data, base = b"", offset
    at = 0
    while True:
        at = data.find(_MAGIC, at)
        if at < 0 or len(data) < at + (1 << 16) + 64:
            if base + len(data) >= file.size:
                if at < 0:
                    return None
            else:
                data += file.at(base + len(data), 1 << 18)
                at = max(at, 0)
                continue
        n = block_size(data, at)
        if n and (base + at + n >= file.size or block_size(data, at + n)):
            break
        at += 1
    # bytes of as many blocks as a chain needs; places in the first block only, then in the next one, and so on
    held, starts, source = b"", [], blocks(file, base + at, 1 << 18)
    k = u = 0
    while True:
        while k >= len(starts) or u >= starts[k][0] + starts[k][2]:
            if k < len(starts):
                k += 1
                continue
            more = next(source, None)
            if more is None:
                return None
            starts.append((len(held), more[0], len(more[1])))
            held += more[1]
        at, seen = u, 0
        while seen < CHAIN:
            after = _plausible(held, at, h)
            if after < 0:
                break
            if after == 0 or after > len(held):
                more = next(source, None)
                if more is None:
                    seen = CHAIN if at == len(held) and seen else -1  # the last record ends the file
                    break
                starts.append((len(held), more[0], len(more[1])))
                held += more[1]
                continue
            at, seen = after, seen + 1
        if seen >= CHAIN:
            return starts[k][1] << 16 | (u - starts[k][0])
        u += 1


@dataclass
class Range(InputPartition):
    path: str
    parts: tuple[tuple[int, int], ...]  # of virtual offsets; records that begin in them
    in_order: bool  # of contig and position, as all files with an index are


def _gather(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, one after the other."""
    ends = np.cumsum(n)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)]


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def _strings(data: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(n), [None, _offsets(n).buffers()[1], pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append((name, chr(data[at])))
            at += 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out.append((name, data[at:end].decode()))
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form, size = _SIZES[sub]
            out.append((name, ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in np.frombuffer(data, form, n, at + 5).tolist())])))
            at += 5 + n * size
        else:
            form, size = _SIZES[kind]
            x = np.frombuffer(data, form, 1, at).tolist()[0]
            out.append((name, f"{x:g}" if kind == "f" else str(x)))
            at += size
    return out


def decode(data: bytes, at: np.ndarray, h: Header, columns: list[str], sample: str) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """Records whose fields begin at some places -> columns, the fixed fields, and the reference end of each."""
    raw = np.frombuffer(data, np.uint8)
    f = raw[at[:, None] + np.arange(32)].copy().view(_FIXED).ravel()
    n_cigar, l_seq = f["n_cigar"].astype(np.int64), f["l_seq"].astype(np.int64)
    cigar_at = at + 32 + f["l_name"]
    seq_at = cigar_at + 4 * n_cigar
    ops = _gather(raw, cigar_at, 4 * n_cigar).view("<u4")
    op, size = (ops & 15).astype(np.int32), (ops >> 4).astype(np.int32)
    spans = np.concatenate([[0], np.cumsum(np.where(np.isin(op, (0, 2, 3, 7, 8)), size, 0), dtype=np.int64)])
    cigar_end = np.cumsum(n_cigar)
    end = f["pos"] + spans[cigar_end] - spans[cigar_end - n_cigar]
    names = np.array([*h.names, "*"], object)
    next_known = f["next_ref"] >= 0
    out: dict[str, pa.Array] = {}
    for c in columns:
        if c == "sample":
            out[c] = pa.array([sample] * len(at), pa.string())
        elif c in _FLAGS:
            out[c] = pa.array(f["flag"] & _FLAGS[c] != 0)
        elif c == "qname":
            n = f["l_name"].astype(np.int64) - 1
            out[c] = _strings(_gather(raw, at + 32, n), n)
        elif c == "chrom":
            out[c] = pa.array(names[f["ref"]], pa.string())
        elif c in ("pos", "tlen"):
            out[c] = pa.array(f[c].astype(np.int64))
        elif c == "mapq":
            out[c] = pa.array(f[c].astype(np.int32))
        elif c == "mate_chrom":
            out[c] = pa.array(np.where(next_known, names[f["next_ref"]], None), pa.string())
        elif c == "mate_pos":
            out[c] = pa.array(f["next_pos"].astype(np.int64), mask=~next_known)
        elif c == "cigar":
            out[c] = pa.ListArray.from_arrays(_offsets(n_cigar), pa.StructArray.from_arrays([pa.array(op), pa.array(size)], ["op", "len"]), mask=pa.array(n_cigar == 0))
        elif c == "seq":
            packed = _gather(raw, seq_at, (l_seq + 1) // 2)
            both = np.frombuffer(LETTERS.encode(), np.uint8)[np.stack([packed >> 4, packed & 15], 1).ravel()]
            ends = np.cumsum((l_seq + 1) // 2) * 2
            bases = _gather(both, ends - (l_seq + 1) // 2 * 2, l_seq)
            none = l_seq == 0
            if none.any():
                bases = np.insert(bases, (np.cumsum(l_seq) - l_seq)[none], ord("*"))
            out[c] = _strings(bases, np.maximum(l_seq, 1))
        elif c == "qual":
            quality = _gather(raw, seq_at + (l_seq + 1) // 2, l_seq)
            first = np.concatenate([quality, [255]])[np.minimum(np.cumsum(l_seq) - l_seq, len(quality))]
            out[c] = pa.ListArray.from_arrays(_offsets(l_seq), pa.array(quality.view(np.int8)), mask=pa.array((l_seq == 0) | (first == 255)))
        elif c == "tags":
            begin = seq_at + (l_seq + 1) // 2 + l_seq
            stop = at + np.frombuffer(raw[(at - 4)[:, None] + np.arange(4)].tobytes(), "<i4")
            out[c] = pa.array([list(dict(_tags(data[a:b])).items()) for a, b in zip(begin.tolist(), stop.tolist())], pa.map_(pa.string(), pa.string()))
        else:
            raise ValueError(f"no column {c}")
    return out, f, end


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: StructType):
        self.paths = _files(options["path"])
        self.columns, self.sample = columns.names, options.get("sample", "")
        self.split = int(options.get("split", SPLIT))
        name, _, span = options.get("region", "").partition(":") if ":" in options.get("region", "") else (options.get("region", ""), "", "")
        start, _, end = span.replace(",", "").partition("-")
        self.chrom, self.start, self.end = name or None, int(start or 0), int(end or 1 << 40)
        #: Reads that don't overlap [start, end) are left out; further, those that don't begin in [least, most].
        self.least, self.most, self.mapq = -(1 << 40), 1 << 40, 0
        self.opened: list[File] = []

    def _open(self, path: str) -> File:
        self.opened.append(File(path))
        return self.opened[-1]

    def _index(self, path: str) -> Index | None:
        for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
            try:
                f = self._open(name)
            except FileNotFoundError:
                continue
            return Index(f.at(0, f.size))
        return None

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            file = self._open(path)
            h = header(file)
            index = self._index(path)
            if self.chrom is not None and self.chrom != "*" and index:
                if self.chrom in h.names:
                    # what begins in [least, most] overlaps it
                    a, b = max(self.start, self.least, 0), min(self.end, self.most + 1, 1 << 29)
                    parts = index.ranges(h.names.index(self.chrom), a, b) if a < b else []
                else:
                    parts = []
            else:
                parts = [(h.start, file.size << 16)]
            known = index.places() if index else []
            group: list[tuple[int, int]] = []
            for a, b in parts:
                # a long range is cut near the multiples of split
                cuts = [a]
                for offset in range((a >> 16) + self.split, b >> 16, self.split):
                    v = known[k] if index and (k := bisect_left(known, offset << 16)) < len(known) else None if index else first_record(file, offset, h)
                    if v is not None and cuts[-1] < v < b:
                        cuts.append(v)
                for x, y in zip(cuts, [*cuts[1:], b]):
                    group.append((x, y))
                    if sum((q >> 16) - (p >> 16) for p, q in group) >= self.split // 2:
                        out.append(Range(path, tuple(group), index is not None))
                        group = []
            if group:
                out.append(Range(path, tuple(group), index is not None))
        return out or [Range("", (), False)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        file = self._open(part.path)
        h = header(file)
        own = h.names.index(self.chrom) if self.chrom in h.names else None
        past = False
        for a, b in part.parts:
            if past:
                return
            for data, at in self._records(file, a, b):
                out, f, end = decode(data, at, h, self.columns, self.sample)
                keep = (f["pos"] >= self.least) & (f["pos"] <= self.most) & (f["mapq"] >= self.mapq)
                if self.chrom is not None:
                    keep &= f["ref"] == (own if own is not None else -1 if self.chrom == "*" else -2)
                    if self.start > 0 or self.end < 1 << 40:
                        keep &= (f["pos"] < self.end) & (np.maximum(end, f["pos"] + 1) > self.start)
                if part.in_order and own is not None:
                    last = f[-1]
                    past = last["ref"] > own or last["ref"] < 0 or last["ref"] == own and last["pos"] >= min(self.end, self.most + 1)
                batch = pa.RecordBatch.from_arrays([out[c] for c in self.columns], self.columns)
                yield batch if keep.all() else batch.filter(pa.array(keep))

    @staticmethod
    def _records(file: File, begin: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """Bytes and where the fields of records begin in them, for the records that begin in a range of virtual offsets."""
        held, at, limit = b"", begin & 0xFFFF, None
        for offset, more in blocks(file, begin >> 16, min(1 << 20, ((end >> 16) - (begin >> 16) + (1 << 16)))):
            if limit is None and offset >= end >> 16:
                limit = len(held) + (end & 0xFFFF if offset == end >> 16 else 0)
            held += more
            if limit is None and len(held) < BATCH:
                continue
            places = []
            while (limit is None or at < limit) and at + 4 <= len(held):
                after = at + 4 + struct.unpack_from("<i", held, at)[0]
                if after > len(held):
                    break
                places.append(at + 4)
                at = after
            if places:
                yield held, np.array(places, np.int64)
            if limit is not None and at >= limit:
                return
            held, at, limit = held[at:], 0, None if limit is None else limit - at
        places = []
        while (limit is None or at < limit) and at + 4 <= len(held):
            places.append(at + 4)
            at += 4 + struct.unpack_from("<i", held, at)[0]
        if places:
            yield held, np.array(places, np.int64)


class FilteringReader(Reader):
    """A reader that learns of filters; Spark refuses such a one where they aren't to be pushed."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.chrom in (None, f.value):
                self.chrom = f.value
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("mapq",):
                self.mapq = max(self.mapq, f.value + isinstance(f, GreaterThan))
            yield f  # Spark applies each again


def _files(path: str) -> list[str]:
    fs, name = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(name, recursive=False)) if x.is_file and x.path.endswith(".bam") and not x.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{x.rpartition('/')[2]}" for x in names]


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    indexed: bool


class BlockWriter:
    """Blocks of compressed bytes; a record begins in a new block where it would not fit."""

    def __init__(self, stream):
        self.stream, self.offset, self.held = stream, 0, bytearray()

    def place(self) -> int:
        return self.offset << 16 | len(self.held)

    def add(self, data: bytes) -> int:
        """Where the data begins."""
        if self.held and len(self.held) + len(data) > BLOCK:
            self.flush()
        begin = self.place()
        self.held += data
        while len(self.held) > BLOCK:
            rest = self.held[BLOCK:]
            self.held = self.held[:BLOCK]
            self.flush()
            self.held = rest
        return begin

    def add_all(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each record begins and where the next may; data holds records, record k from offsets[k] on."""
        n = len(offsets) - 1
        begin, after, i = np.empty(n, np.int64), np.empty(n, np.int64), 0
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + BLOCK - len(self.held), "right")) - 1
            if j > i:
                here = self.place() - int(offsets[i])
                begin[i:j], after[i:j] = offsets[i:j] + here, offsets[i + 1 : j + 1] + here
                self.held += data[offsets[i] : offsets[j]]
                i = j
            elif self.held:
                self.flush()
            else:  # longer than a block
                begin[i] = self.add(data[offsets[i] : offsets[i + 1]])
                after[i] = self.place()
                i += 1
        return begin, after

    def flush(self) -> None:
        if self.held:
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = z.compress(bytes(self.held)) + z.flush()
            block = struct.pack("<4sIBBHBBHH", _MAGIC, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(self.held), len(self.held))
            self.stream.write(block)
            self.offset += len(block)
            self.held = bytearray()

    def close(self) -> None:
        self.flush()
        self.stream.write(_END)


class IndexWriter:
    def __init__(self, n: int):
        self.contigs: list[tuple[dict[int, list[list[int]]], dict[int, int]]] = [({}, {}) for _ in range(n)]

    def add(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, after: np.ndarray) -> None:
        """Records in their order: a chunk for each run of one bin within a block."""
        some = (ref >= 0) & (start >= 0)
        ref, start, end, begin, after = (x[some] for x in (ref, start, end, begin, after))
        if not len(ref):
            return
        bins = bins_of(start, end)
        new = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (bins[1:] != bins[:-1]) | (begin[1:] >> 16 != begin[:-1] >> 16)]))
        for r, number, x, y in zip(ref[new].tolist(), bins[new].tolist(), begin[new].tolist(), after[np.append(new[1:], len(ref)) - 1].tolist()):
            chunks = self.contigs[r][0].setdefault(number, [])
            if chunks and x >> 16 == chunks[-1][1] >> 16:
                chunks[-1][1] = y
            else:
                chunks.append([x, y])
        first = start >> 14
        many = (np.maximum(end, start + 1) - 1 >> 14) - first + 1
        window, of = _ragged(first, many), np.repeat(np.arange(len(ref)), many)
        _, at = np.unique(ref[of] << 32 | window, return_index=True)  # the first record of each
        for r, w, x in zip(ref[of[at]].tolist(), window[at].tolist(), begin[of[at]].tolist()):
            self.contigs[r][1].setdefault(w, x)

    def data(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.contigs))]
        for found, windows in self.contigs:
            out.append(struct.pack("<i", len(found)))
            for number in sorted(found):
                out.append(struct.pack("<Ii", number, len(found[number])) + b"".join(struct.pack("<QQ", *x) for x in found[number]))
            last = max(windows, default=-1)
            filled, least = [], 0
            for w in range(last, -1, -1):  # a window without reads has the offset of the next one's
                least = windows.get(w, least)
                filled.append(least)
            out.append(struct.pack("<i", last + 1) + b"".join(struct.pack("<Q", x) for x in reversed(filled)))
        return b"".join(out)


_NIBBLE = {c: k for k, c in enumerate(LETTERS)}


def _tag_bytes(tags: list[tuple[str, str]]) -> bytes:
    out = []
    for name, value in tags:
        if value.lstrip("-").isdigit() and len(value) < 10:
            out.append(name.encode() + b"i" + struct.pack("<i", int(value)))
        else:
            out.append(name.encode() + b"Z" + value.encode() + b"\0")
    return b"".join(out)


def encode(row: dict, ref: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A row of schema.READ -> its bytes, contig, start and end. Tags of digits become numbers, others text."""
    flag = sum(bit for c, bit in _FLAGS.items() if row[c])
    if row["mate_chrom"] is not None or row["mate_is_unmapped"]:
        flag |= 1 | (0 if row["is_read1"] else 128)
    cigar = [(x["op"], x["len"]) for x in row["cigar"] or []]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    r, pos = ref.get(row["chrom"], -1), row["pos"] if row["pos"] is not None else -1
    end = pos + sum(n for op, n in cigar if op in (0, 2, 3, 7, 8))
    name = row["qname"].encode() + b"\0"
    codes = [_NIBBLE.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    tags = row["tags"] or []
    body = struct.pack("<iiBBHHHiiii", r, pos, len(name), row["mapq"] or 0, bin_of(max(pos, 0), max(end, pos + 1)) if r >= 0 else 4680, len(cigar), flag, len(seq), ref.get(row["mate_chrom"], -1), -1 if row["mate_pos"] is None else row["mate_pos"], row["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += bytes(q & 255 for q in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    body += _tag_bytes(list(tags.items()) if isinstance(tags, dict) else tags)
    return struct.pack("<i", len(body)) + body, r, pos, end


_CODES = np.array([_NIBBLE.get(chr(k).upper(), 15) for k in range(128)], np.uint8)
_RECORD = np.dtype([("size", "<i4"), *((name, _FIXED[name].str) for name in _FIXED.names)])


def _ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), first[1], ..."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def _sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sums of so many successive values each."""
    till = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(many)
    return till[ends] - till[ends - many]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the elements of a column of lists or maps stand among its values, and how many each row has; a null has none."""
    at = np.asarray(column.offsets).astype(np.int64)
    many = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
    return _ragged(at[:-1], many), many


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings in a row, and how many each has."""
    column = column.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def encoded(batch: pa.RecordBatch, ref: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of schema.READ as encode() has them: all bytes, where records begin and the last ends, their contigs, starts and ends."""
    col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    n = batch.num_rows

    def numbers(name: str, missing: int) -> np.ndarray:
        return col[name].cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)

    def contigs(name: str) -> np.ndarray:
        return pc.index_in(col[name].cast(pa.string()), pa.array(list(ref), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    is_true = {c: np.asarray(col[c].fill_null(False)) for c in _FLAGS}
    paired = np.asarray(col["mate_chrom"].is_valid()) | is_true["mate_is_unmapped"]
    flag = sum(bit * is_true[c].astype(np.int64) for c, bit in _FLAGS.items()) | np.where(paired, np.where(is_true["is_read1"], 1, 129), 0)
    name, n_name = _texts(col["qname"])
    bases, n_bases = _texts(pc.if_else(pc.equal(col["seq"], "*"), "", col["seq"]))
    at, n_cigar = _lists(col["cigar"])
    op, length = (x.cast(pa.int64()).to_numpy(zero_copy_only=False)[at] for x in col["cigar"].values.flatten())
    r, pos, mapq, tlen, next_pos = contigs("chrom"), numbers("pos", -1), numbers("mapq", 0), numbers("tlen", 0), numbers("mate_pos", -1)
    wide = any(len(x) and (x.min() < -1 << 31 or x.max() >= 1 << 31) for x in (pos, tlen, next_pos))
    if wide or col["qname"].null_count or (n and (n_name.max() > 254 or mapq.min() < 0 or mapq.max() > 255 or n_cigar.max() > 65535)) or (len(bases) and bases.max() > 127) or len(op) and (op.min() < 0 or op.max() > 15 or length.min() < 0 or length.max() >= 1 << 28):
        each = [encode(row, ref) for row in batch.to_pylist()]  # tells what can't be written
        offsets = np.cumsum([0, *(len(x[0]) for x in each)])
        return b"".join(x[0] for x in each), offsets, *(np.array([x[k] for x in each], np.int64) for k in (1, 2, 3))
    end = pos + _sums(np.where(np.isin(op, (0, 2, 3, 7, 8)), length, 0), n_cigar)
    n_packed = n_bases + 1 >> 1
    halves = np.zeros(2 * int(n_packed.sum()), np.uint8)
    halves[_ragged(2 * (np.cumsum(n_packed) - n_packed), n_bases)] = _CODES[bases]
    at, known = _lists(col["qual"])
    n_qual = np.where(known > 0, known, n_bases)
    qual = np.full(int(n_qual.sum()), 255, np.uint8)
    qual[_ragged(np.cumsum(n_qual) - n_qual, known)] = (col["qual"].values.cast(pa.int64()).to_numpy(zero_copy_only=False)[at] & 255).astype(np.uint8)
    # each tag is spelled once
    at, n_tags = _lists(col["tags"])
    pairs = pc.binary_join_element_wise(col["tags"].keys.take(at), col["tags"].items.take(at), "\0").dictionary_encode()
    spelled = [_tag_bytes([tuple(x.split("\0", 1))]) for x in pairs.dictionary.to_pylist()]
    sizes, which = np.array([len(x) for x in spelled], np.int64), pairs.indices.to_numpy(zero_copy_only=False)
    tags = np.frombuffer(b"".join(spelled), np.uint8)[_ragged((np.cumsum(sizes) - sizes)[which], sizes[which])] if spelled else np.empty(0, np.uint8)
    n_tag = _sums(sizes[which], n_tags) if spelled else np.zeros(n, np.int64)

    size = 33 + n_name + 4 * n_cigar + n_packed + n_qual + n_tag
    offsets = np.concatenate([[0], np.cumsum(size + 4)])
    fixed = np.zeros(n, _RECORD)
    values = {"size": size, "ref": r, "pos": pos, "l_name": n_name + 1, "mapq": mapq, "bin": np.where(r >= 0, bins_of(np.maximum(pos, 0), np.maximum(end, pos + 1)), 4680), "n_cigar": n_cigar, "flag": flag, "l_seq": n_bases, "next_ref": contigs("mate_chrom"), "next_pos": next_pos, "tlen": tlen}
    for k, v in values.items():
        fixed[k] = v
    out = np.zeros(int(offsets[-1]), np.uint8)
    place = offsets[:-1]
    cigar = (length << 4 | op).astype("<u4").view(np.uint8)
    for part, many, gap in ((fixed.view(np.uint8), np.full(n, 36), 0), (name, n_name, 1), (cigar, 4 * n_cigar, 0), (halves[::2] << 4 | halves[1::2], n_packed, 0), (qual, n_qual, 0), (tags, n_tag, 0)):
        out[_ragged(place, many)] = part
        place = place + many + gap
    return out.tobytes(), offsets, r, pos, end


class Writer(DataSourceArrowWriter):
    """A file for each task. Files whose rows come in the order of contig and position get an index."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.contigs = [(x.rpartition(":")[0], int(x.rpartition(":")[2])) for x in options["contigs"].split(",") if x]

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self._at()
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        ref = {c: k for k, (c, _) in enumerate(self.contigs)}
        text = "".join(["@HD\tVN:1.6\tSO:unknown\n", *(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs)]).encode()
        index, last, records = IndexWriter(len(self.contigs)), -1, 0
        with fs.open_output_stream(f"{folder}/.{name}") as stream:
            out = BlockWriter(stream)
            head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
            out.add(head + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs))
            out.flush()
            for batch in iterator:
                if not batch.num_rows:
                    continue
                data, offsets, r, start, end = encoded(batch, ref)
                begin, after = out.add_all(data, offsets)
                records += batch.num_rows
                here = np.where(r >= 0, r, 1 << 29) << 33 | start + 1
                index = index if last <= here[0] and (here[1:] >= here[:-1]).all() else None
                last = int(here[-1])
                if index:
                    index.add(r, start, end, begin, after)
            out.close()
        if index:
            with fs.open_output_stream(f"{folder}/.{name}.bai") as stream:
                stream.write(index.data())
        return Written(name, records, bool(index))

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = self._at()
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if x.is_file and x.base_name.startswith("part-"):
                    fs.delete_file(x.path)
        for m in messages:
            if m:
                for suffix in (".bai",) * m.indexed + ("",):
                    fs.move(f"{folder}/.{m.name}{suffix}", f"{folder}/{m.name}{suffix}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = self._at()
        for m in messages:
            if m:
                for suffix in ("", ".bai"):
                    if fs.get_file_info(f"{folder}/.{m.name}{suffix}").is_file:
                        fs.delete_file(f"{folder}/.{m.name}{suffix}")


class BinaryAlignments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([schema.READ[c] for c in names]) if names else schema.READ

    def reader(self, schema: StructType) -> Reader:
        return (FilteringReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def alignments(spark: SparkSession, path: str, region: str | None = None, sample: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Binary alignments as schema.READ, of a file or of a folder's files; see the module for regions and columns."""
    spark.dataSource.register(BinaryAlignments)
    options = {"sample": sample, "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({"region": region} if region else {}) | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format("bam").options(**options).load(path)


def write_alignments(reads: DataFrame, path: str, contigs: list[tuple[str, int]], parts: int) -> None:
    """reads (schema.READ) as a folder of indexed files in the order of contig and position, a range of it in each."""
    from pyspark.sql import functions as F

    reads.sparkSession.dataSource.register(BinaryAlignments)
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, (c, _) in enumerate(contigs) for x in (c, k))), F.col("chrom")), F.lit(len(contigs)))
    dealt = reads.withColumn("_number", number).repartitionByRange(parts, "_number", "pos", "qname").sortWithinPartitions("_number", "pos").drop("_number")
    dealt.write.format("bam").options(contigs=",".join(f"{c}:{n}" for c, n in contigs)).mode("append").save(path)
