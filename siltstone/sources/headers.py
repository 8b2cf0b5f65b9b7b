"""Integers and magic numbers out of binary columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_int(data: Column, offset: int, size: int) -> Column:
    """A little-endian unsigned integer of up to seven bytes."""
    cut = F.hex(F.substring(data, offset + 1, size))
    turned = F.concat(*[F.substring(cut, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("long")


def be_int(data: Column, offset: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def container_kind(data: Column) -> Column:
    """The container a file's first bytes announce, in order of precedence; null for none."""
    magic = F.hex(F.substring(data, 1, 4))
    text = lambda s: F.lit(s.encode().hex().upper())
    return (
        F.when(F.substring(magic, 1, 6) == text("XNB"), "xnb").when(magic.isin("46534235", "46455620"), "fmod").when(magic == text("GDPC"), "pck").when(F.hex(F.substring(data, 1, 7)) == text("UnityFS"), "unityfs")
        .when(magic == "2D3D3D2D", "utoc").when(magic == "3412AA55", "vpk").when(magic == text("VTF\0"), "vtf").when(magic == text("FORM"), "gamemaker").when(magic == text("DDS "), "dds").when(magic == text("RIFF"), "wav")
    )


def le_bytes(n: Column, size: int) -> Column:
    """A whole number as little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))
