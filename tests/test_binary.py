import gzip
import struct
import zlib

import pytest

from spanwise import api, cli
from spanwise.sources import text
from spanwise.sources.binary import BASES, CIGAR_OPS, BgzfWriter, bgzf, read_bam, read_bigwig

from .test_sources import SAM


def block(raw: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def to_bam(sam: str) -> bytes:
    heads = [x.split("\t") for x in sam.splitlines() if x.startswith("@SQ")]
    contigs = [(h[1][3:], int(h[2][3:])) for h in heads]
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, length in contigs:
        raw += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for line in sam.splitlines():
        if line.startswith("@"):
            continue
        name, flag, _, pos, mapq, cigar, rnext, pnext, _, seq, qual = line.split("\t")
        ops, n = [], ""
        for c in cigar:
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | CIGAR_OPS.index(c))
                n = ""
        codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        record = struct.pack("<iiBBHHHiiii", 0, int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), len(seq), 0 if rnext == "=" else -1, int(pnext) - 1, 0)
        record += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        record += b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        raw += struct.pack("<i", len(record)) + record
    return block(raw[:100]) + block(raw[100:]) + block(b"")


def to_bigwig(name: str, length: int, rows) -> bytes:
    section = zlib.compress(struct.pack("<IIIIIBBH", 0, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack("<IIf", *r) for r in rows))
    tree = 64
    chroms = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 8, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + name.encode().ljust(8, b"\0") + struct.pack("<II", 0, length)
    data = tree + len(chroms)
    index = data + len(section)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, tree, data, index, 0, 0, 0, 0, 1 << 15, 0)
    leaves = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, 1, 0, 0, 0, length, 0, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 0, 0, length, data, len(section))
    return head + chroms + section + leaves


def test_bam_reads_as_its_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.bam").write_bytes(to_bam(SAM))
    assert gzip.decompress(to_bam(SAM))[:4] == b"BAM\1"
    (ref, got), (sam_ref, want) = read_bam(spark, str(tmp_path / "a.bam"), "x"), text.read_sam(spark, str(tmp_path / "a.sam"), "x")
    same = ["qname", "flag", "contig", "start", "mapq", "cigar", "same_contig", "seq", "qual", "label"]
    assert ref == sam_ref and sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.select(*same).collect()))


def test_bigwig_and_command_line(spark, tmp_path, capsys):
    rows = [(p * 5, p * 5 + 5, p / 2) for p in range(3)]
    (tmp_path / "a.bw").write_bytes(to_bigwig("chr1", 20, rows))
    ref, runs = read_bigwig(spark, str(tmp_path / "a.bw"), "a")
    assert ref.lengths == (20,) and [(r.start, r.end, r.value) for r in runs.orderBy("start").collect()] == rows
    (tmp_path / "sizes").write_text("chr1\t20\n")
    store, capsys_out = str(tmp_path / "st"), lambda: capsys.readouterr().out
    assert cli.main(["import", "bigwig", store, f"{tmp_path}/a.bw", "--reference", str(tmp_path / "sizes")]) == 0
    assert cli.main(["view", store, "-r", "chr1:3-12"]) == 0
    assert capsys_out() == "#chrom\tstart\tend\ta\nchr1\t3\t5\t0\nchr1\t5\t10\t0.5\nchr1\t10\t12\t1\n"
    assert cli.main(["stat", store, "-s", "mean", "-r", "chr1:0-10", "-r", "chr1:15-20"]) == 0
    assert capsys_out().splitlines()[1:] == ["0\t0\ta\t0.25", "1\t0\ta\tNaN"]
    assert cli.main(["validate", store]) == 0 and cli.main(["info", store]) == 0
    with pytest.raises(TypeError):
        cli.main(["stat", store, "-s", "hist"])
    got = api.reduce_regions(api.open(spark, store)["signal"], "chr1:0-15", "max").collect()
    assert got[0].value == 1.0


def test_sections_spread_over_tasks(spark, tmp_path):
    """Many sections, also larger than a page apart: each is decoded once, whatever the tasks."""
    rows = [[(k * 1000 + i * 5, k * 1000 + i * 5 + 5, float(k)) for i in range(20)] for k in range(30)]
    sections = [struct.pack("<IIIIIBBH", 0, r[0][0], r[-1][1], 0, 0, 1, 0, len(r)) + b"".join(struct.pack("<IIf", *x) for x in r) for r in rows]
    tree = 64
    chroms = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 8, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"c".ljust(8, b"\0") + struct.pack("<II", 0, 40_000)
    places, body = [], b""
    for x in sections:
        packed = zlib.compress(x)
        places.append((tree + len(chroms) + len(body), len(packed)))
        body += packed + b"\0" * 20_000
    index = tree + len(chroms) + len(body)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, tree, tree + len(chroms), index, 0, 0, 0, 0, 1 << 15, 0)
    leaves = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, 30, 0, 0, 0, 40_000, 0, 1, 0) + struct.pack("<BBH", 1, 0, 30) + b"".join(struct.pack("<IIIIQQ", 0, 0, 0, 40_000, a, n) for a, n in places)
    (tmp_path / "m.bw").write_bytes(head + chroms + body + leaves)
    for path in (f"{tmp_path}/m.bw", f"file://{tmp_path}/m.bw"):
        _, runs = read_bigwig(spark, path, "x", 4)
        assert sorted((r.start, r.end, r.value) for r in runs.collect()) == [x for r in rows for x in r]
        assert runs.rdd.getNumPartitions() == 4


def test_command_line_files(spark, tmp_path, capsys):
    """BED options, an import that fails, composition, output files as BGZF, and headers left out."""
    (tmp_path / "sizes").write_text("ref1\t60\n")
    (tmp_path / "a.bed").write_text("#chrom\tstart\tend\tx\ty\nref1\t0\t4\t7\t0.5\nref1\t4\t6\t300\t2\n")
    (tmp_path / "list").write_text("# sources\na.bed\tone\n")
    store, sizes = str(tmp_path / "st"), str(tmp_path / "sizes")
    with pytest.raises(ValueError):
        cli.main(["import", "bed", store, f"{tmp_path}/a.bed", "--reference", sizes, "--field", "z"])
    assert not (tmp_path / "st").exists()
    assert cli.main(["import", "bed", store, "--emit-schema", "-f", str(tmp_path / "list"), "--fill", "0"]) == 0
    schema = capsys.readouterr().out
    assert schema == "column\ttrack\tdtype\tfill\nx\tx\tuint16\t0\ny\ty\tfloat32\t0\n"
    (tmp_path / "schema").write_text(schema.replace("y\ty", "y\tsignal"))
    assert cli.main(["import", "bed", store, "-f", str(tmp_path / "list"), "--genome", sizes, "--schema", str(tmp_path / "schema")]) == 0
    assert cli.main(["view", store, "--track", "signal", "-o", str(tmp_path / "out.bedgraph.gz"), "-r", "ref1:3-8"]) == 0
    raw = (tmp_path / "out.bedgraph.gz").read_bytes()
    assert gzip.decompress(raw) == b"#chrom\tstart\tend\tone\nref1\t3\t4\t0.5\nref1\t4\t6\t2\nref1\t6\t8\t0\n" and b"".join(bgzf(raw)) == gzip.decompress(raw)
    assert cli.main(["stat", store, "--track", "x", "-s", "max", "--no-header"]) == 0
    assert capsys.readouterr().out == "0\t0\tone\t300\n"
    (tmp_path / "a.sam").write_text(SAM)
    made = api.create(spark, str(tmp_path / "bam"), api.Reference([("ref1", 60)]))
    api.import_bam(made, f"{tmp_path}/a.sam:s", fields=("a", "c", "del"))
    assert made.names == ["a", "c", "del"] and made["del"].labels == ("s",)
    api.import_bam(made, f"{tmp_path}/a.sam", "counts", fields=("g", "ins"), axis="column")
    wide = api.open(spark, made.path)["counts"]
    assert (wide.labels, wide.dim) == (("g", "ins"), "field") and wide.runs.where("label = 'ins'").count() == 1
    for wrong in ({"fields": ("a", "a")}, {"fields": ("x",)}, {"axis": "row"}):
        with pytest.raises(ValueError):
            api.import_bam(made, f"{tmp_path}/a.sam", "more", **wrong)


def test_blocks_of_large_output(tmp_path):
    with open(tmp_path / "x.gz", "wb") as raw:
        out = BgzfWriter(raw)
        for i in range(40_000):
            out.write(f"line {i}\n".encode())
        out.close()
    want = "".join(f"line {i}\n" for i in range(40_000)).encode()
    assert gzip.decompress((tmp_path / "x.gz").read_bytes()) == want == b"".join(bgzf(str(tmp_path / "x.gz")))
