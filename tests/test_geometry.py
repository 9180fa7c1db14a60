import pytest

from spanwise.functions.grammar import RegionQuery, format_g, human_bytes, parse_flags, parse_region
from spanwise.plans.reference import Reference, bin_width, reserved


def test_rows_and_intervals_of_bins():
    ref = Reference([("chr1", 5), ("empty", 0), ("chr2", 7)])
    assert (ref.size("position"), ref.size("bin_4"), ref.offsets) == (12, 4, (0, 5, 5))
    assert ref.rows("chr2", 3, 5, "bin_4") == (2, 4)
    assert ref.interval(3, "bin_4") == ("chr2", 4, 7)
    assert all(ref.rows(*ref.interval(i, "bin_4"), "bin_4") == (i, i + 1) for i in range(4))
    with pytest.raises(ValueError):
        ref.interval(4, "bin_4")


@pytest.mark.parametrize("span", [(0, 6), (2, 2), (-1, 2), (5, None)])
def test_ranges_outside_raise(span):
    with pytest.raises(ValueError):
        Reference([("chr1", 5)]).resolve("chr1", *span)


def test_references():
    for bad in ([("a", 1), ("a", 2)], [("", 1)], [("a", -1)], [("a", 1 << 62), ("b", 1 << 62), ("c", 1)]):
        with pytest.raises(ValueError):
            Reference(bad)
    assert Reference([("a", 1), ("b", 1)]) != Reference([("b", 1), ("a", 1)])
    with pytest.raises(KeyError):
        Reference([("a", 1)])["b"]
    assert bin_width("bin_10") == 10 and bin_width("bin_0") is bin_width("bin_04") is bin_width("sample") is None
    assert all(map(reserved, ["position", "contig", "bin_0", "bin_01", "bin_x", "bin_5"])) and not reserved("binned")


def test_region_texts():
    assert parse_region(" chr1:1,000-2,000 ") == RegionQuery("chr1", 1000, 2000)
    assert parse_region("chr1:5") == RegionQuery("chr1", 5)
    assert parse_region("chr1:") == parse_region("chr1") == RegionQuery("chr1")
    assert parse_region("HLA-A*01:01", ["HLA-A*01:01"]) == RegionQuery("HLA-A*01:01")
    for bad in ("", "chr1:5-5", "chr1:x-3", ":1-2"):
        with pytest.raises(ValueError):
            parse_region(bad)


def test_small_texts():
    assert parse_flags("UNMAP,0x400,256") == 0x4 | 0x400 | 256
    assert [format_g(x) for x in (0.25, 0.0, None, 1e-7, 1234567.0)] == ["0.25", "0", "NaN", "1e-07", "1.23457e+06"]
    assert [human_bytes(x) for x in (5, 2048)] == ["5 B", "2.0 KiB"]
