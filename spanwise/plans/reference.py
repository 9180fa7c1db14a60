"""The ordered reference of contigs: geometry of positions and bins, digest, and its DataFrame form."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_EXTENT = (1 << 63) - 1
RESERVED = {"position", "contig", "contig_id", "contig_length", "contig_md5", "reference"}


def bin_width(dim: str) -> int | None:
    """Width of a genomic dimension: 1 for ``position``, N for ``bin_N`` (no leading zero), None otherwise."""
    if dim == "position":
        return 1
    head, _, tail = dim.partition("_")
    return int(tail) if head == "bin" and tail.isascii() and tail.isdigit() and tail[0] != "0" else None


def reserved(name: str) -> bool:
    """Names that no track may have: the axes' own and all that look like bins, also of a width that none can have."""
    return name in RESERVED or name.startswith("bin_")


class Reference(Mapping):
    """Ordered contigs (name, length). Immutable; two references are the same if names, lengths and order agree."""

    def __init__(self, contigs):
        self._contigs = tuple((str(n), int(x)) for n, x in (contigs.items() if isinstance(contigs, Mapping) else contigs))
        names = [n for n, _ in self._contigs]
        if any(not n for n in names) or len(set(names)) < len(names):
            raise ValueError("contig names must be unique and not empty")
        if any(x < 0 for _, x in self._contigs):
            raise ValueError("contig lengths must not be negative")
        offsets = [0]
        for _, x in self._contigs:
            offsets.append(offsets[-1] + x)
        if offsets[-1] > MAX_EXTENT:
            raise ValueError("the reference is longer than 2**63 - 1")
        self.offsets, self.total = tuple(offsets[:-1]), offsets[-1]
        self._index = {n: i for i, n in enumerate(names)}
        self._starts: dict[int, list[int]] = {}

    def __getitem__(self, name: str) -> int:
        return self._contigs[self.ord(name)][1]

    def __iter__(self) -> Iterator[str]:
        return (n for n, _ in self._contigs)

    def __len__(self) -> int:
        return len(self._contigs)

    def __eq__(self, other) -> bool:
        return isinstance(other, Reference) and self._contigs == other._contigs

    def __hash__(self) -> int:
        return hash(self._contigs)

    def __repr__(self) -> str:
        return f"Reference({len(self)} contigs, {self.total} positions, {self.digest})"

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self)

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(x for _, x in self._contigs)

    @property
    def digest(self) -> str:
        """First 8 hex digits of the SHA-1 over ``name<TAB>length<LF>`` lines in order."""
        return hashlib.sha1("".join(f"{n}\t{x}\n" for n, x in self._contigs).encode()).hexdigest()[:8]

    def ord(self, name: str) -> int:
        if name not in self._index:
            raise KeyError(f"unknown contig {name!r}")
        return self._index[name]

    def size(self, dim: str) -> int:
        """Extent of a genomic dimension; bins restart in each contig and the last one may be short."""
        return self._first_rows(self._width(dim))[-1]

    def resolve(self, contig: str, start: int | None = None, end: int | None = None) -> tuple[str, int, int]:
        """Half-open range with open ends filled in; empty or outside ranges are errors, never clipped."""
        length = self[contig]
        start, end = 0 if start is None else start, length if end is None else end
        if start < 0 or end <= start or end > length:
            raise ValueError(f"range {start}-{end} is empty or outside of {contig} (length {length})")
        return contig, start, end

    def rows(self, contig: str, start: int | None = None, end: int | None = None, dim: str = "position") -> tuple[int, int]:
        """Rows of ``dim`` that intersect a range."""
        width = self._width(dim)
        contig, start, end = self.resolve(contig, start, end)
        base = self._first_rows(width)[self.ord(contig)]
        return base + start // width, base - (-end // width)

    def interval(self, row: int, dim: str = "position") -> tuple[str, int, int]:
        """The range of one row of ``dim``."""
        width = self._width(dim)
        starts = self._first_rows(width)
        if not 0 <= row < starts[-1]:
            raise ValueError(f"row {row} is outside of {dim}")
        at = bisect_right(starts, row) - 1
        name, length = self._contigs[at]
        lo = (row - starts[at]) * width
        return name, lo, min(lo + width, length)

    def _first_rows(self, width: int) -> list[int]:
        """The first row of each contig at a width, and the number of all rows."""
        if width not in self._starts:
            self._starts[width] = list(accumulate((-(-x // width) for x in self.lengths), initial=0))
        return self._starts[width]

    def _width(self, dim: str) -> int:
        width = bin_width(dim)
        if width is None:
            raise ValueError(f"{dim!r} is not a genomic dimension")
        return width

    def frame(self, spark: SparkSession) -> DataFrame:
        """(contig_ord, contig, length, offset); as many rows as contigs, so it is safe to broadcast."""
        rows = [(i, n, x, self.offsets[i]) for i, (n, x) in enumerate(self._contigs)]
        return spark.createDataFrame(rows, "contig_ord int, contig string, length long, offset long")

    def flat(self, contig: Column, pos: Column) -> Column:
        """Flat coordinate on the concatenated ``position`` axis."""
        pairs = [F.lit(x) for n, o in zip(self, self.offsets, strict=True) for x in (n, o)]
        return F.element_at(F.create_map(*pairs), contig) + pos

    def bucket(self, cells: int = 4096) -> int:
        """Width of the buckets of overlap joins: a power of two that cuts the longest contig into some ``cells``."""
        width = 64
        while width * cells < max(self.lengths, default=0):
            width *= 2
        return width

    @classmethod
    def from_frame(cls, contigs: DataFrame) -> Reference:
        return cls([(r.contig, r.length) for r in contigs.orderBy("contig_ord").select("contig", "length").collect()])
