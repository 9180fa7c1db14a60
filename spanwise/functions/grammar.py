"""Text forms: regions, SAM flags, numbers as %g, sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag names and bits, and those that depth drops by default.
SAM_FLAGS = {"PAIRED": 0x1, "PROPER_PAIR": 0x2, "UNMAP": 0x4, "MUNMAP": 0x8, "REVERSE": 0x10, "MREVERSE": 0x20, "READ1": 0x40, "READ2": 0x80, "SECONDARY": 0x100, "QCFAIL": 0x200, "DUP": 0x400, "SUPPLEMENTARY": 0x800}
DEFAULT_EXCLUDE = 1796


@dataclass(frozen=True)
class RegionQuery:
    """A contig with an optional half-open range; missing ends are open."""

    contig: str
    start: int | None = None
    end: int | None = None


def parse_region(text: str, names=()) -> RegionQuery:
    """``chr``, ``chr:``, ``chr:start`` (to the end), ``chr:start-end``; commas in numbers are dropped.

    0-based half-open. The last colon counts; a text that is a known contig name as a whole is that contig.
    """
    text = text.strip()
    if not text:
        raise ValueError("empty region")
    if text in names or ":" not in text:
        return RegionQuery(text)
    contig, _, span = text.rpartition(":")
    if not contig:
        raise ValueError(f"no contig in {text!r}")
    if not span:
        return RegionQuery(contig)

    def number(s: str) -> int:
        s = s.replace(",", "")
        if not (s.isascii() and s.isdigit()):
            raise ValueError(f"bad position in {text!r}")
        return int(s)

    first, dash, last = span.partition("-")
    start, end = number(first), number(last) if dash else None
    if end is not None and start >= end:
        raise ValueError(f"start is not below end in {text!r}")
    return RegionQuery(contig, start, end)


def parse_flags(text: str) -> int:
    """Decimal, 0x-hexadecimal, or comma-joined names, or-ed."""
    total = 0
    for part in text.split(","):
        part = part.strip()
        if part.upper() in SAM_FLAGS:
            total |= SAM_FLAGS[part.upper()]
        elif part.lower().startswith("0x"):
            total |= int(part, 16)
        elif part.isascii() and part.isdigit():
            total |= int(part)
        else:
            raise ValueError(f"unknown flag {part!r}")
    return total


def quantize(value: Column, digits: int) -> Column:
    """Round to significant digits, halves away from zero; zero, null and non-finite values stay, and those whose power of ten is no double."""
    plain = value.cast("double")
    factor = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(plain))))
    finite = (plain != 0) & ~F.isnan(plain) & (F.abs(plain) < float("inf")) & (factor > 0) & (factor < float("inf"))
    return F.when(finite, F.round(plain * factor) / factor).otherwise(plain)


def format_g(value: float | None, digits: int = 6) -> str:
    """C's %g; missing values print NaN."""
    if value is None or math.isnan(value):
        return "NaN"
    return f"{value:.{digits}g}"


def human_bytes(n: int) -> str:
    size = float(n)
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return ""
