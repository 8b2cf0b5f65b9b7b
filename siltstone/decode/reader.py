"""A bounded random-access reader: every read is checked against the file and a budget, and a bad file is an error, never a guess."""

from __future__ import annotations

import struct


class Rejected(ValueError):
    """A file that a decoder does not accept, with the reason."""


class Reader:
    def __init__(self, source, length: int, budget: int = 64 << 20):
        """``source`` is bytes or has ``read_at(size, offset)``; ``budget`` bounds the bytes read in all."""
        self.source, self.length, self.left, self.at = source, length, budget, 0

    def take(self, offset: int, size: int) -> bytes:
        if offset < 0 or size < 0 or offset + size > self.length:
            raise Rejected(f"range {offset}+{size} lies outside the file of {self.length} bytes")
        self.left -= size
        if self.left < 0:
            raise Rejected("read budget used up")
        if isinstance(self.source, (bytes, bytearray, memoryview)):
            return bytes(self.source[offset : offset + size])
        data = self.source.read_at(size, offset)
        if len(data) != size:
            raise Rejected("file changed while being read")
        return data

    def seek(self, offset: int) -> Reader:
        self.at = offset
        return self

    def read(self, size: int) -> bytes:
        data = self.take(self.at, size)
        self.at += size
        return data

    def unpack(self, layout: str) -> tuple:
        return struct.unpack(layout, self.read(struct.calcsize(layout)))

    def number(self, layout: str) -> int:
        return self.unpack(layout)[0]

    def cstring(self, most: int = 4096) -> str:
        out = bytearray()
        while (b := self.read(1)) != b"\0":
            out += b
            if len(out) > most:
                raise Rejected("unterminated string")
        return text(bytes(out))


def text(data: bytes) -> str:
    try:
        out = data.decode()
    except UnicodeDecodeError:
        raise Rejected("text is not UTF-8") from None
    if any(ord(c) < 32 or ord(c) == 127 for c in out):
        raise Rejected("text holds control characters")
    return out


def need(condition: bool, reason: str) -> None:
    if not condition:
        raise Rejected(reason)
