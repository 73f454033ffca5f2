"""Binary alignments against their text form, by ranges, regions and filters."""

import io
import random
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siteloom import schema
from siteloom.sources import bam, text

CONTIGS = [("chr1", 3_000_000), ("chr2", 500_000), ("hs37d5", 10_000)]


def sam_lines(n=4000, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([1, 30, 75, 101])
        cigar = rng.choice([f"{size}M", f"{size}M", f"10S{size}M", f"{size}M5I3D12M8S", f"4H{size}M", f"{size}M700N{size}M", "*"])
        bases = sum(int(m[:-1]) for m in _elements(cigar) if m[-1] in "MIS")
        seq = "".join(rng.choices("ACGTN", k=bases)) or "*"
        qual = "*" if seq == "*" or rng.random() < 0.1 else "".join(chr(rng.randint(33, 74)) for _ in range(bases))
        contig = rng.choice(["chr1"] * 5 + ["chr2", "*"])
        pos = 0 if contig == "*" else rng.randint(1, dict(CONTIGS)[contig] - 2000)
        mate = rng.choice(["=", "chr2", "*", "hs37d5"]) if contig != "*" else "*"
        flag = rng.choice([0, 16, 99, 147, 1024, 2048, 256, 65, 129]) if contig != "*" else 4
        tags = rng.sample(["NM:i:3", "RG:Z:a b", "MD:Z:10A5", "XF:f:0.5", "XC:A:q", "XH:H:1AE3", "XB:B:s,1,-2,300", "XI:i:-70000"], rng.randint(0, 4))
        out.append("\t".join([f"read/{k}", str(flag), contig, str(pos), str(rng.randint(0, 60)), cigar, mate, str(rng.randint(1, 9000) if mate != "*" else 0), str(rng.randint(-900, 900)), seq, qual, *tags]))
    return out


def _elements(cigar):
    out, n = [], ""
    for c in cigar if cigar != "*" else "":
        n += c
        if not c.isdigit():
            out.append(n)
            n = ""
    return out


def binary(lines, block):
    """The text form in binary, by the rules of the format alone; blocks of one size, whatever they cut."""
    names = [c for c, _ in CONTIGS]
    data = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", len(CONTIGS))
    for c, n in CONTIGS:
        data += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    for line in lines:
        q, flag, contig, pos, mapq, cigar, mate, mate_pos, tlen, seq, qual, *tags = line.split("\t")
        ref = names.index(contig) if contig != "*" else -1
        next_ref = ref if mate == "=" else names.index(mate) if mate != "*" else -1
        ops = [(int(x[:-1]) << 4) | "MIDNSHP=X".index(x[-1]) for x in _elements(cigar)]
        bases = "" if seq == "*" else seq
        body = struct.pack("<iiBBHHHiiii", ref, int(pos) - 1, len(q) + 1, int(mapq), 0, len(ops), int(flag), len(bases), next_ref, int(mate_pos) - 1, int(tlen)) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes("=ACMGRSVTWYHKDBN".index(a) << 4 | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(bases[::2], bases[1::2] + "="))
        body += b"\xff" * len(bases) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        for t in tags:
            name, kind, value = t.split(":", 2)
            body += name.encode() + kind.encode()
            body += {"i": lambda v: struct.pack("<i", int(v)), "f": lambda v: struct.pack("<f", float(v)), "A": str.encode, "Z": lambda v: v.encode() + b"\0", "H": lambda v: v.encode() + b"\0",
                     "B": lambda v: v[:1].encode() + struct.pack("<i", v.count(",")) + struct.pack(f"<{v.count(',')}h", *map(int, v.split(",")[1:]))}[kind](value)
        data += struct.pack("<i", len(body)) + body
    out = b""
    for k in range(0, len(data), block):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = z.compress(data[k : k + block]) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data[k : k + block]), len(data[k : k + block]))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bag(df):
    return sorted(repr(r.asDict(recursive=True)) for r in df.collect())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    lines = sam_lines()
    (folder / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    (folder / "a.bam").write_bytes(binary(lines, 3000))
    (folder / "large.sam").write_text("\n".join(sam_lines(30_000, 4)) + "\n")
    return folder


def test_rows_of_the_text_form(spark, files):
    want = text.alignments(spark, str(files / "a.sam"), "s")
    got = bam.alignments(spark, str(files / "a.bam"), sample="s")
    assert got.schema == schema.READ
    assert bag(got) == bag(want)
    few = bam.alignments(spark, str(files / "a.bam"), columns=("chrom", "pos", "cigar"))
    assert bag(few) == bag(want.select("chrom", "pos", "cigar"))


def test_ranges_without_an_index(files):
    """Records fall to exactly one range, wherever files are cut; none reads much more than its share."""
    path = str(files / "a.bam")
    size = bam.File(path).size
    for split in (2_000, 7_777, 50_000):
        r = bam.Reader({"path": path, "split": str(split)}, schema.READ)
        parts = r.partitions()
        assert len(parts) > size // split // 2
        names = []
        for p in parts:
            one = bam.Reader({"path": path, "split": str(split)}, schema.READ)
            names += [x for b in one.read(p) for x in b.column("qname").to_pylist()]
        assert names == [f"read/{k}" for k in range(4000)]


def test_regions_by_the_index(spark, files, tmp_path):
    rows = text.alignments(spark, str(files / "large.sam"), "").cache()
    path = str(tmp_path / "out")
    bam.write_alignments(rows, path, CONTIGS, 3)
    assert bag(bam.alignments(spark, path).drop("tags", "mate_is_unmapped")) == bag(rows.drop("tags", "mate_is_unmapped"))
    assert len(list((tmp_path / "out").glob("part-*.bam.bai"))) == len(list((tmp_path / "out").glob("part-*.bam"))) == 3
    end = F.expr("pos + greatest(aggregate(filter(coalesce(cigar, array()), x -> x.op in (0, 2, 3)), 0, (a, x) -> a + x.len), 1)")
    for region, chrom, a, b in (("chr1:0-40000", "chr1", 0, 40_000), ("chr1:1000000-1000900", "chr1", 1_000_000, 1_000_900), ("chr2", "chr2", 0, 1 << 40), ("chr2:499999-500000", "chr2", 499_999, 500_000), ("chrX", "chrX", 0, 9)):
        want = rows.filter((F.col("chrom") == chrom) & (F.col("pos") < b) & (end > a)).select("qname", "pos")
        assert bag(bam.alignments(spark, path, region, columns=("qname", "pos"))) == bag(want)
        r = bam.Reader({"path": path, "region": region}, schema.READ)
        parts = r.partitions()
        for p in parts:
            list(r.read(p))
        whole = sum(bam.File(f).size for f in r.paths)
        if b - a < 50_000:  # headers, indexes and the blocks that the index names
            indexes = sum(bam.File(f + ".bai").size for f in r.paths)
            assert sum(f.taken for f in r.opened) - indexes < 0.25 * whole, region


def test_filters_choose_ranges(spark, files, tmp_path):
    rows = text.alignments(spark, str(files / "a.sam"), "")
    path = str(tmp_path / "out")
    bam.write_alignments(rows, path, CONTIGS, 2)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        wanted = (F.col("chrom") == "chr1") & (F.col("pos") >= 500_000) & (F.col("pos") < 520_000) & (F.col("mapq") > 12)
        got = bam.alignments(spark, path, columns=("qname", "chrom", "pos", "mapq")).filter(wanted)
        assert bag(got) == bag(rows.filter(wanted).select("qname", "chrom", "pos", "mapq"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    r = bam.FilteringReader({"path": path}, schema.READ)
    assert len(list(r.pushFilters([EqualTo(("chrom",), "chr1"), GreaterThanOrEqual(("pos",), 500_000), LessThan(("pos",), 520_000)]))) == 3
    spans = sum((b >> 16) - (a >> 16) for p in r.partitions() for a, b in p.parts)
    assert spans < 0.2 * sum(bam.File(f).size for f in r.paths)


def test_edges(spark, tmp_path):
    (tmp_path / "none.bam").write_bytes(binary([], 3000))
    assert bam.alignments(spark, str(tmp_path / "none.bam")).count() == 0
    (tmp_path / "one.bam").write_bytes(binary(sam_lines(1), 65280))
    assert bam.alignments(spark, str(tmp_path / "one.bam")).count() == 1
    (tmp_path / "bad.bam").write_bytes(b"not binary alignments at all")
    with pytest.raises(Exception, match="no whole block"):
        bam.alignments(spark, str(tmp_path / "bad.bam")).count()


def test_rows_are_encoded_together(spark, monkeypatch):
    """All of a batch's records at once, byte for byte those of single rows; blocks and index too."""
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        ops = [{"op": rng.randint(0, 8), "len": rng.randint(1, 40_000 if rng.random() < 0.02 else 60)} for _ in range(rng.randint(0, 4))]
        seq = rng.choice([None, "*", "", "".join(rng.choices("ACGTNacgtnRX=", k=rng.randint(1, 90_000 if k % 999 == 7 else 120)))])
        qual = rng.choice([None, [], [rng.randint(0, 60) for _ in range(len(seq or ""))]])
        tags = rng.choice([None, {}, {"NM": str(rng.randint(-5, 99_999_999_999))}, {"RG": "a b", "XA": "é,1;", "XB": "-12", "XC": ""}])
        flags = {c: rng.choice([True, False, None]) for c in bam._FLAGS}
        rows.append({"sample": "s", "qname": f"read é {k}"[: rng.randint(1, 12)], "chrom": rng.choice(["chr1", "chr2", "chr9", None]), "pos": rng.choice([None, k * 900, k * 900]), "mapq": rng.choice([None, 3, 255]), "mate_chrom": rng.choice([None, "chr2", "chr8"]), "mate_pos": rng.choice([None, 7]), "tlen": rng.choice([None, -4]), "cigar": rng.choice([None, ops, ops]), "seq": seq, "qual": qual, "tags": tags, **flags})
    ref = {c: k for k, (c, _) in enumerate(CONTIGS)}
    batch = pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema.READ))
    one = [bam.encode(row, ref) for row in batch.to_pylist()]
    monkeypatch.setattr(bam, "encode", None)
    for a, b in ((0, 3000), (17, 900), (5, 6)):
        data, offsets, *more = bam.encoded(batch.slice(a, b - a), ref)
        assert [data[x:y] for x, y in zip(offsets, offsets[1:])] == [x[0] for x in one[a:b]]
        assert [tuple(x) for x in zip(*more)] == [x[1:] for x in one[a:b]]
    streams = [io.BytesIO(), io.BytesIO()]
    singly, together = map(bam.BlockWriter, streams)
    data, offsets, *more = bam.encoded(batch, ref)
    want = [(singly.add(x[0]), singly.place()) for x in one]
    got = together.add_all(data, offsets)
    assert [tuple(x) for x in zip(*(x.tolist() for x in got))] == want
    singly.close(), together.close()
    assert streams[0].getvalue() == streams[1].getvalue()
    found, windows = {}, {}
    for (_, r, start, end), (begin, after) in zip(one, want):
        if r >= 0 and start >= 0:
            chunks = found.setdefault((r, bam.bin_of(start, end)), [])
            if chunks and begin >> 16 == chunks[-1][1] >> 16:
                chunks[-1][1] = after
            else:
                chunks.append([begin, after])
            for w in range(start >> 14, (max(end, start + 1) - 1 >> 14) + 1):
                windows.setdefault((r, w), begin)
    index = bam.IndexWriter(len(CONTIGS))
    index.add(*more, *got)
    assert {(r, k): v for r, (x, _) in enumerate(index.contigs) for k, v in x.items()} == found
    assert {(r, k): v for r, (_, x) in enumerate(index.contigs) for k, v in x.items()} == windows
