"""Decoders of game containers: a file in, records out. Each record is (tag, name, numbers, texts).

They read directories and headers, not payloads, and reject what they do not understand.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

from .reader import Reader, Rejected, need, text

Record = tuple[str, str, dict[str, int], dict[str, str]]


def pck(f: Reader) -> Iterator[Record]:
    """Godot packs of version 1 to 4: the directory."""
    magic, version, major, minor, patch = f.seek(0).unpack("<4s4I")
    need(magic == b"GDPC" and 1 <= version <= 4, "no Godot pack of version 1 to 4")
    base, directory = 0, 84
    if version >= 2:
        flags, base = f.unpack("<IQ")
        need(flags & ~2 == 0, "encrypted, sparse or unknown pack layout")
        directory = f.number("<Q") if version >= 3 else 96
    count = f.seek(directory).number("<I")
    need(base <= f.length and count <= 2_000_000, "pack header out of bounds")
    entries = []
    for _ in range(count):
        n = f.number("<I")
        need(0 < n <= 4096, "path length out of bounds")
        name = text(f.read(n).rstrip(b"\0"))
        need(bool(name) and "|" not in name, "unsafe path")
        offset, size, md5 = f.unpack("<QQ16s")
        flags = f.number("<I") if version >= 2 else 0
        need(flags & ~3 == 0, "unknown entry flags")
        if not flags & 2:
            need(base + offset + size <= f.length, "entry outside the file")
        entries.append((name, base + offset, size, flags, md5))
    end = f.at
    for _, offset, size, flags, _ in entries:
        need(bool(flags & 2) or size == 0 or offset >= end or offset + size <= directory, "entry overlaps the directory")
    held = [e for e in entries if not e[3] & 2]
    yield "GODOT_PCK", "", {"version": version, "entries": len(entries), "payload": sum(e[2] for e in held)}, {"engine": f"{major}.{minor}.{patch}"}
    for name, offset, size, flags, md5 in entries:
        yield "PCK_ENTRY", name, {"offset": offset, "size": size, "flags": flags, "removed": flags >> 1}, {"md5": md5.hex()}


PAK_MAGIC = 0x5A6F12E1


def pak(f: Reader) -> Iterator[Record]:
    """Unreal packs: the footer, found once in the last 1,024 bytes, and the SHA-1 of the index."""
    tail = min(1024, f.length)
    data = f.take(f.length - tail, tail)
    found = []
    for i in range(len(data) - 43):
        if struct.unpack_from("<I", data, i)[0] != PAK_MAGIC:
            continue
        version, offset, size, sha = struct.unpack_from("<IQQ20s", data, i + 4)
        start, after = f.length - tail + i, len(data) - i - 44
        extra = {8: (128, 160), 9: (161,), 10: (160,), 11: (160,)}.get(version, (0,))
        if 1 <= version <= 11 and after in extra and offset + size <= start:
            found.append((version, offset, size, sha, data[i - 1] if version >= 4 and i else 0, data[i + 44 :]))
    need(len(found) == 1, "no single footer of an Unreal pack")
    version, offset, size, sha, encrypted, rest = found[0]
    names = rest[1:] if version == 9 else rest
    methods = [m for k in range(0, len(names), 32) if (m := names[k : k + 32].rstrip(b"\0"))]
    status = "ENCRYPTED" if encrypted else "OK" if hashlib.sha1(f.take(offset, size)).digest() == sha else "INDEX_SHA1_MISMATCH"
    yield "UNREAL_PAK", "", {"version": version, "index_offset": offset, "index_size": size, "encrypted": encrypted & 1}, {"index": status, "methods": ",".join(text(m) for m in methods)}
    if status != "OK":
        return
    f.seek(offset)
    yield from _pak_directory(f, methods, offset + size) if version >= 10 else _pak_entries(f, version, methods, offset + size)


def _fstring(f: Reader) -> str:
    n = f.number("<i")
    need(-4096 <= n <= 4096, "string length out of bounds")
    raw = f.read(n) if n >= 0 else f.read(-2 * n)
    return text(raw.rstrip(b"\0") if n >= 0 else raw.decode("utf-16-le", "replace").rstrip("\0").encode())


def _pak_entries(f: Reader, version: int, methods: list[bytes], end: int) -> Iterator[Record]:
    mount = _fstring(f)
    count = f.number("<I")
    need(count <= 2_000_000, "too many entries")
    seen: set[str] = set()
    for _ in range(count):
        name = _fstring(f)
        need(name.lower() not in seen, "repeated entry name")
        seen.add(name.lower())
        offset, size, raw, method = f.unpack("<QQQI" if version != 8 else "<QQQI")
        if version == 1:
            f.read(8)
        sha = f.read(20)
        blocks = 0
        if version >= 3:
            if method:
                blocks = f.number("<I")
                f.read(16 * blocks)
            f.read(5)
        yield "UNREAL_ENTRY", name, {"offset": offset, "size": size, "raw": raw, "method": method, "blocks": blocks}, {"sha1": sha.hex(), "mount": mount, "method_name": methods[method - 1].decode() if 0 < method <= len(methods) else ""}
    need(f.at <= end, "index runs over its end")


def _pak_section(f: Reader) -> Reader | None:
    """A secondary index that the primary one declares; its SHA-1 must hold."""
    if not f.number("<I"):
        return None
    offset, size, sha = f.unpack("<QQ20s")
    data = f.take(offset, size)
    need(hashlib.sha1(data).digest() == sha, "secondary index differs from its SHA-1")
    return Reader(data, len(data))


def _pak_encoded(f: Reader) -> dict[str, int]:
    """A packed entry: sizes of 32 or 64 bits by its flags, then the sizes of its blocks."""
    word = f.number("<I")
    block_size = f.number("<I") if word & 0x3F == 0x3F else (word & 0x3F) << 11
    blocks, encrypted, method = word >> 6 & 0xFFFF, word >> 22 & 1, word >> 23 & 0x3F
    offset = f.number("<I" if word >> 31 & 1 else "<Q")
    raw = f.number("<I" if word >> 30 & 1 else "<Q")
    size = f.number("<I" if word >> 29 & 1 else "<Q") if method else raw
    need(blocks > 0 or not method, "compressed entry without blocks")
    need(not blocks or method > 0, "stored entry with blocks")
    if blocks and (encrypted or blocks != 1):
        f.read(4 * blocks)
    return {"offset": offset, "size": size, "raw": raw, "method": method, "blocks": blocks, "block_size": block_size, "encrypted": encrypted}


def _pak_directory(f: Reader, methods: list[bytes], end: int) -> Iterator[Record]:
    """Entries of version 10 and 11: the full directory names packed entries by offset, plain ones by a negative number, deleted ones by the least."""
    mount = _fstring(f)
    count, _ = f.unpack("<IQ")
    need(count <= 2_000_000, "too many entries")
    _pak_section(f)
    directory = _pak_section(f)
    packed = f.read(f.number("<I"))
    plain = f.number("<I")
    need(plain <= count and f.at <= end, "index runs over its end")
    listed = []
    for _ in range(plain):
        offset, size, raw, method, sha = f.unpack("<QQQI20s")
        blocks = f.number("<I") if method else 0
        f.read(16 * blocks + 5)
        listed.append({"offset": offset, "size": size, "raw": raw, "method": method, "blocks": blocks})
    if directory is None:
        return
    work = 0
    for _ in range(directory.number("<I")):
        folder = _fstring(directory)
        for _ in range(directory.number("<I")):
            name, at = folder.removeprefix("/") + _fstring(directory), directory.number("<i")
            if at == -(1 << 31):
                yield "UNREAL_DELETED", name, {}, {"mount": mount}
                continue
            need(at < len(packed) and -at - 1 < len(listed), "entry outside of the index")
            entry = _pak_encoded(Reader(packed, len(packed)).seek(at)) if at >= 0 else listed[-at - 1]
            work += 1
            need(work <= 2_000_000, "too many names")
            m = entry["method"]
            yield "UNREAL_ENTRY", name, entry, {"mount": mount, "method_name": methods[m - 1].decode() if 0 < m <= len(methods) else ""}
    need(directory.at == directory.length, "unknown trailer of the directory index")


def utoc(f: Reader) -> Iterator[Record]:
    """Unreal I/O store tables of contents: header, chunks and blocks."""
    need(f.seek(0).read(16) == b"-==--==--==--==-", "no I/O store header")
    version = f.number("<B")
    f.read(3)
    header, chunks, blocks, block_entry, methods, method_length, block_size, directory, partitions, container = f.unpack("<9IQ")
    guid, flags = f.read(16), f.number("<B")
    need(header == 144 and block_entry == 12 and chunks <= 1_000_000 and blocks <= 8_000_000 and methods <= 16, "unsupported I/O store layout")
    at = header
    sections = {"chunk_ids": 12 * chunks, "offsets": 10 * chunks, "blocks": 12 * blocks, "methods": methods * method_length}
    need(at + sum(sections.values()) <= f.length, "file is shorter than its tables")
    yield "UNREAL_IOSTORE", "", {"version": version, "chunks": chunks, "blocks": blocks, "block_size": block_size, "partitions": partitions, "container": container - (1 << 64) if container >> 63 else container, "directory": directory}, {"compressed": str(bool(flags & 1)), "encrypted": str(bool(flags & 2)), "signed": str(bool(flags & 4)), "indexed": str(bool(flags & 8)), "guid": guid.hex()}
    ids, offsets = f.take(at, 12 * chunks), f.take(at + 12 * chunks, 10 * chunks)
    table = f.take(at + 22 * chunks, 12 * blocks)
    names = f.take(at + 22 * chunks + 12 * blocks, methods * method_length)
    need(len({ids[12 * i : 12 * i + 12] for i in range(chunks)}) == chunks, "repeated chunk id")
    for i in range(chunks):
        o = offsets[10 * i : 10 * i + 10]
        yield "IOSTORE_CHUNK", ids[12 * i : 12 * i + 12].hex(), {"offset": int.from_bytes(o[:5], "big"), "length": int.from_bytes(o[5:], "big"), "kind": ids[12 * i + 11], "at": i}, {}
    for i in range(blocks):
        b = table[12 * i : 12 * i + 12]
        method = b[11]
        name = names[(method - 1) * method_length : method * method_length].rstrip(b"\0").decode("latin-1") if method else "None"
        yield "IOSTORE_BLOCK", name, {"offset": int.from_bytes(b[:5], "little"), "size": int.from_bytes(b[5:8], "little"), "raw": int.from_bytes(b[8:11], "little"), "at": i}, {}


def vpk(f: Reader) -> Iterator[Record]:
    """Valve packs of version 1 and 2: header and tree."""
    magic, version, tree = f.seek(0).unpack("<3I")
    need(magic == 0x55AA1234 and version in (1, 2), "no Valve pack of version 1 or 2")
    need(0 < tree <= 32 << 20, "tree out of bounds")
    sizes = f.unpack("<4I") if version == 2 else ()
    end = f.at + tree
    need(end <= f.length and end + sum(sizes) <= f.length, "sections outside the file")
    yield "VPK_HEADER", "", {"version": version, "tree": tree, "data": sizes[0] if sizes else f.length - end}, {}
    seen: set[str] = set()
    while ext := f.cstring():
        while folder := f.cstring():
            while name := f.cstring():
                crc, preload, archive, offset, length, stop = f.unpack("<IHHIIH")
                need(stop == 0xFFFF, "entry without its end mark")
                f.read(preload)
                path = ("" if folder == " " else f"{folder}/") + ("" if name == " " else name) + ("" if ext == " " else f".{ext}")
                need(path.lower() not in seen and len(seen) < 1_000_000, "repeated path")
                seen.add(path.lower())
                safe = path and "\\" not in path and ":" not in path and not any(p in ("", ".", "..") for p in path.split("/"))
                yield "VPK_ENTRY", path, {"crc32": crc, "preload": preload, "archive": archive, "offset": offset, "length": length}, {"path_status": "OK" if safe else "UNSAFE"}
    need(f.at == end, "tree does not end where it should")


def form(f: Reader) -> Iterator[Record]:
    """GameMaker data: the chunks of a FORM file."""
    need(f.seek(0).read(4) == b"FORM", "no FORM container")
    need(f.number("<I") + 8 == f.length, "length differs from the file's")
    chunks: list[Record] = []
    tags: set[bytes] = set()
    while f.at < f.length:
        need(len(chunks) < 256, "too many chunks")
        tag, size = f.unpack("<4sI")
        need(all(32 <= b <= 126 for b in tag) and tag not in tags, "odd or repeated chunk tag")
        tags.add(tag)
        need(f.at + size <= f.length, "chunk outside the file")
        chunks.append(("FORM_CHUNK", tag.decode(), {"offset": f.at, "size": size}, {}))
        f.at += size
    need(bool(chunks), "no chunks")
    yield "FORM_HEADER", "", {"chunks": len(chunks), "size": f.length}, {}
    for chunk in chunks:
        yield chunk
        if chunk[1] in FORM_TABLES and chunk[2]["size"] >= 4:
            yield _form_table(f, chunk[1], chunk[2]["offset"], chunk[2]["size"])


# Chunks that begin with a count and a table of pointers.
FORM_TABLES = frozenset(("STRG", "TXTR", "TPAG", "SPRT", "AUDO", "SOND", "BGND", "FONT", "OBJT", "ROOM", "CODE"))


def _form_table(f: Reader, tag: str, start: int, size: int) -> Record:
    """Bounds of a pointer table; what it points to is not read."""
    count = f.seek(start).number("<I")
    if count > 1_000_000:
        return "GAMEMAKER_TABLE", tag, {"count": count}, {"table": "TABLE_BUDGET_SKIPPED"}
    if 4 + 4 * count > size:
        return "GAMEMAKER_TABLE", tag, {"count": count}, {"table": "TABLE_TRUNCATED"}
    pointers = f.unpack(f"<{count}I")
    real = [p for p in pointers if p]
    inside = {"nulls": count - len(real), "aliases": len(real) - len(set(real)), "outside": sum(not start <= p < start + size for p in real), "into_table": sum(start <= p < start + 4 + 4 * count for p in real)}
    return "GAMEMAKER_TABLE", tag, {"count": count, **inside}, {"table": "POINTER_BOUNDS_ONLY"}


# Sample rates of FSB5 by code, and codecs by mode.
FSB_RATES = {1: 8000, 2: 11000, 3: 11025, 4: 16000, 5: 22050, 6: 24000, 7: 32000, 8: 44100, 9: 48000}
FSB_CODECS = {1: "PCM8", 2: "PCM16", 3: "PCM24", 4: "PCM32", 5: "PCMFLOAT", 6: "GCADPCM", 7: "IMAADPCM", 8: "VAG", 9: "HEVAG", 10: "XMA", 11: "MPEG", 12: "CELT", 13: "AT9", 14: "XWMA", 15: "VORBIS"}


def fsb5(f: Reader) -> Iterator[Record]:
    """FMOD banks: the samples of an FSB5, bare or inside a RIFF bank."""
    start = 0
    if f.seek(0).read(4) == b"RIFF":
        head = f.take(0, min(f.length, 1 << 20))
        start = head.find(b"FSB5")
        need(start > 0, "no FSB5 in the bank")
    magic, version, count, headers, names, data, mode = f.seek(start).unpack("<4s6I")
    need(magic == b"FSB5" and version in (0, 1), "no FSB5")
    size = 64 if version == 0 else 60
    need(start + size + headers + names + data <= f.length and count <= 1_000_000, "sections outside the file")
    yield "FMOD_AUDIT", "", {"version": version, "samples": count, "data": data, "mode": mode}, {"codec": FSB_CODECS.get(mode, "UNKNOWN")}
    f.seek(start + size)
    last = -1
    for i in range(count):
        word = f.number("<Q")
        more, rate, channels, offset, frames = word & 1, word >> 1 & 15, word >> 5 & 3, (word >> 7 & 0x7FFFFFF) * 32, word >> 34
        extras = 0
        hz, ch = FSB_RATES.get(rate, 0), (1, 2, 6, 8)[channels]
        while more:
            head = f.number("<I")
            more, length, kind = head & 1, head >> 1 & 0xFFFFFF, head >> 25
            body = f.read(length)
            extras += 1
            hz = struct.unpack("<I", body[:4])[0] if kind == 2 and length >= 4 else hz
            ch = body[0] if kind == 1 and length else ch
        need(offset > last and offset <= data, "sample offsets do not increase")
        last = offset
        yield "FMOD_SAMPLE", str(i), {"rate": hz, "channels": ch, "frames": frames, "offset": offset, "extras": extras}, {}
    need(f.at <= start + size + headers, "sample headers run over their end")


def xnb(f: Reader) -> Iterator[Record]:
    """XNA content: the header; its size must be the file's."""
    magic, platform, version, flags, size = f.seek(0).unpack("<3scBBI")
    need(magic == b"XNB" and version in (3, 4, 5), "no XNA content of version 3 to 5")
    need(size == f.length, "size differs from the file's")
    yield "XNB_HEADER", "", {"version": version, "size": size, "compressed": int(bool(flags & 0xC0)), "hidef": flags & 1}, {"platform": platform.decode("latin-1")}
    if version != 5 or flags & 0xC0:
        return
    readers = []
    for _ in range(_seven(f)):
        readers.append(text(f.read(_seven(f))))
        yield "XNB_READER", readers[-1], {"version": f.number("<i")}, {}
    if f.at == f.length:
        return
    shared, root = _seven(f), _seven(f)
    if shared or not 0 < root <= len(readers) or readers[root - 1].split(",")[0] != "Microsoft.Xna.Framework.Content.Texture2DReader":
        yield "XNB_TEXTURE_STATUS", "", {"shared": shared}, {"texture": "UNSUPPORTED_ROOT"}
        return
    fmt, width, height, mips = f.unpack("<4i")
    need(0 < width <= 16384 and 0 < height <= 16384 and 0 < mips <= 15, "texture dimensions")
    yield "XNB_TEXTURE", "", {"format": fmt, "width": width, "height": height, "mips": mips}, {}
    for level in range(mips):
        n = f.number("<I")
        yield "XNB_MIP", str(level), {"width": max(1, width >> level), "height": max(1, height >> level), "offset": f.at, "size": n}, {}
        need(f.at + n <= f.length, "mip outside the file")
        f.at += n
    yield "XNB_TEXTURE_STATUS", "", {"shared": 0}, {"texture": "OK" if f.at == f.length else "TRAILING_BYTES"}


def _seven(f: Reader) -> int:
    out = 0
    for shift in range(0, 35, 7):
        b = f.read(1)[0]
        out |= (b & 127) << shift
        if b < 128:
            return out
    raise Rejected("number of more than five bytes")


def vtf(f: Reader) -> Iterator[Record]:
    """Valve textures of version 7.1 to 7.4: the header."""
    magic, major, minor, header, width, height, flags, frames, first = f.seek(0).unpack("<4s3IHHIHh")
    need(magic == b"VTF\0" and major == 7 and 1 <= minor <= 4, "no Valve texture of version 7.1 to 7.4")
    f.seek(52)
    fmt, mips, low, low_width, low_height = f.unpack("<IBIBB")
    depth = f.number("<H") if minor >= 2 else 1
    resources = 0
    if minor >= 3:
        f.read(3)
        resources = f.number("<I")
    need(width > 0 and height > 0 and 0 < mips <= 16 and header <= f.length, "header out of bounds")
    yield "VTF_HEADER", "", {"minor": minor, "width": width, "height": height, "depth": depth, "frames": frames, "mips": mips, "format": fmt, "low_format": low, "low_width": low_width, "low_height": low_height, "resources": resources, "flags": flags, "first": first}, {}
    if fmt not in VTF_BLOCKS or low not in (*VTF_BLOCKS, 0xFFFFFFFF) or minor >= 3:
        yield "VTF_STATUS", "", {}, {"chain": "UNSUPPORTED"}
        return
    faces = 6 if flags & 0x4000 else 1
    at = header + (_vtf_bytes(low, low_width, low_height) if low != 0xFFFFFFFF else 0)
    for level in reversed(range(mips)):
        w, h, d = max(1, width >> level), max(1, height >> level), max(1, depth >> level)
        n = _vtf_bytes(fmt, w, h) * d * max(1, frames) * faces
        yield "VTF_MIP", str(level), {"width": w, "height": h, "offset": at, "size": n}, {}
        at += n
    yield "VTF_STATUS", "", {"expected": at, "length": f.length}, {"chain": "OK" if at == f.length else "LENGTH_DIFFERS"}


# Side of a block and its bytes by the texture's format number.
VTF_BLOCKS = {0: (1, 4), 2: (1, 3), 3: (1, 3), 12: (1, 4), 13: (4, 8), 14: (4, 16), 15: (4, 16)}


def _vtf_bytes(fmt: int, width: int, height: int) -> int:
    side, size = VTF_BLOCKS[fmt]
    return -(-width // side) * -(-height // side) * size


# Bytes of a 4x4 block by DDS code.
DDS_BLOCKS = {b"DXT1": 8, b"DXT3": 16, b"DXT5": 16, b"ATI1": 8, b"BC4U": 8, b"ATI2": 16, b"BC5U": 16}


def dds(f: Reader) -> Iterator[Record]:
    """DirectDraw surfaces of block formats: dimensions and mips; the chain's bytes must be the payload's."""
    magic, size, flags, height, width, _, depth, mips = f.seek(0).unpack("<4s7I")
    need(magic == b"DDS " and size == 124 and width > 0 and height > 0, "no DDS header")
    code = f.take(84, 4)
    mips = max(1, mips if flags & 0x20000 else 1)
    block = DDS_BLOCKS.get(code)
    start = 148 if code == b"DX10" else 128
    expected = sum(-(-max(1, width >> i) // 4) * -(-max(1, height >> i) // 4) * block for i in range(mips)) if block else 0
    status = "UNSUPPORTED" if not block else "OK" if expected == f.length - start else "LENGTH_DIFFERS"
    yield "DDS_HEADER", "", {"width": width, "height": height, "mips": mips, "payload": f.length - start, "expected": expected, "depth": depth}, {"format": code.rstrip(b"\0").decode("latin-1"), "chain": status}


def gst2(f: Reader) -> Iterator[Record]:
    """Godot 4 textures: the header."""
    magic, version, width, height, flags, limit = f.seek(0).unpack("<4s5I")
    need(magic == b"GST2" and version == 1 and width > 0 and height > 0, "no Godot 4 texture")
    f.read(12)
    encoding, w, h, mips, fmt = f.unpack("<IHHII")
    yield "GST2_HEADER", "", {"width": width, "height": height, "flags": flags, "limit": limit, "encoding": encoding, "image_width": w, "image_height": h, "mips": mips, "format": fmt}, {}


def gdst(f: Reader) -> Iterator[Record]:
    """Godot 3 textures: the header."""
    magic, width, custom_width, height, custom_height, flags, fmt = f.seek(0).unpack("<4s4HII")
    need(magic == b"GDST" and width > 0 and height > 0, "no Godot 3 texture")
    yield "GDST_HEADER", "", {"width": width, "height": height, "custom_width": custom_width, "custom_height": custom_height, "flags": flags, "format": fmt}, {}


def wav(f: Reader) -> Iterator[Record]:
    """RIFF WAVE: format and data, and whether samples loop."""
    riff, size, wave = f.seek(0).unpack("<4sI4s")
    need(riff == b"RIFF" and wave == b"WAVE" and size + 8 <= f.length, "no RIFF WAVE")
    fmt, data, loops = None, None, 0
    while f.at + 8 <= size + 8:
        tag, n = f.unpack("<4sI")
        need(f.at + n <= f.length, "chunk outside the file")
        body = f.at
        if tag == b"fmt ":
            fmt = f.unpack("<HHIIHH")
        elif tag == b"data":
            data = n
        elif tag == b"smpl" and n >= 32:
            loops = struct.unpack("<I", f.take(body + 28, 4))[0]
        f.at = body + n + (n & 1)
    need(fmt is not None and data is not None, "no format or no data")
    yield "WAV", "", {"codec": fmt[0], "channels": fmt[1], "rate": fmt[2], "bits": fmt[5], "data": data, "loops": loops, "frames": data // max(1, fmt[4])}, {}


def unityfs(f: Reader) -> Iterator[Record]:
    """Unity bundles of version 6 to 8: header, storage blocks and nodes."""
    need(f.seek(0).read(8) == b"UnityFS\0", "no Unity bundle")
    version = f.number(">I")
    need(6 <= version <= 8, "bundle version")
    player, engine = f.cstring(256), f.cstring(256)
    size, packed, raw, flags = f.unpack(">QIII")
    need(size == f.length and raw <= 64 << 20, "bundle size")
    if version >= 7:
        f.at = (f.at + 15) // 16 * 16
    data = f.take(f.length - packed, packed) if flags & 0x80 else f.read(packed)
    kind = flags & 63
    if kind in (2, 3):
        import pyarrow as pa

        try:
            data = pa.decompress(data, raw, codec="lz4_raw", asbytes=True)
        except (OSError, pa.ArrowException) as e:
            raise Rejected(f"block list does not unpack: {e}") from None
    need(kind in (0, 2, 3) and len(data) == raw, "block list is stored in an unknown way")
    g = Reader(data, len(data))
    g.read(16)
    blocks = [g.unpack(">IIH") for _ in range(g.number(">I"))]
    nodes = []
    for _ in range(g.number(">I")):
        offset, length, node = g.unpack(">QQI")
        nodes.append((g.cstring(), offset, length, node))
    total = sum(b[0] for b in blocks)
    need(all(o + n <= total for _, o, n, _ in nodes), "node outside the blocks")
    yield "UNITYFS_BUNDLE", "", {"version": version, "blocks": len(blocks), "nodes": len(nodes), "raw": total, "packed": sum(b[1] for b in blocks)}, {"player": player, "engine": engine}
    for name, offset, length, node in nodes:
        yield "UNITYFS_NODE", name, {"offset": offset, "size": length, "flags": node}, {}


def serialized(f: Reader) -> Iterator[Record]:
    """Unity serialized files of version 17 to 22: the header and the engine that wrote them."""
    meta, size, version, data = f.seek(0).unpack(">4I")
    need(17 <= version <= 22, "serialized file version")
    endian = f.read(4)[0]
    if version >= 22:
        meta, size, data, _ = f.unpack(">IQQQ")
    need(size == f.length and data <= size and endian in (0, 1), "header out of bounds")
    engine = f.cstring(256)
    e = ">" if endian else "<"
    yield "UNITY_SERIALIZED", "", {"version": version, "metadata": meta, "data": data, "big_endian": endian, "platform": f.number(f"{e}I")}, {"engine": engine}
    if f.at >= min(f.length, f.at + meta) or meta <= len(engine) + 5:
        return
    tree, count = f.unpack(f"{e}?I")
    need(count <= 4096, "too many types")
    classes = []
    for _ in range(count):
        kind, _, _ = f.unpack(f"{e}i?h")
        f.read(32 if kind == 114 else 16)
        if tree:
            nodes, names = f.unpack(f"{e}II")
            need(nodes <= 1 << 16, "type tree size")
            f.read(nodes * (32 if version >= 19 else 24) + names)
            if version >= 21:
                f.read(4 * f.number(f"{e}I"))
        classes.append(kind)
    objects = f.number(f"{e}I")
    need(objects <= 4_000_000, "too many objects")
    seen: set[int] = set()
    for _ in range(objects):
        f.at = (f.at + 3) // 4 * 4
        path_id, begin, n, type_ = f.unpack(f"{e}qQII" if version >= 22 else f"{e}qIII")
        need(path_id not in seen and type_ < len(classes) and data + begin + n <= size, "repeated object, unknown type or object outside the file")
        seen.add(path_id)
        yield "UNITY_OBJECT", str(path_id), {"class": classes[type_], "offset": data + begin, "size": n}, {}


# Property types of Godot resources with a layout of fixed size, codecs of its samples by number, and the properties a Godot 4 sample may have.
GODOT_VALUES = {1: ("EMPTY", ""), 2: ("BOOL", "<I"), 3: ("INTEGER", "<i"), 4: ("REAL", "<f"), 40: ("INTEGER", "<q"), 41: ("REAL", "<d")}
GODOT_CODECS = ("PCM8", "PCM16", "IMA_ADPCM", "QOA")
GODOT_SAMPLE = {"data", "format", "mix_rate", "stereo", "loop_mode", "loop_begin", "loop_end", "resource_name", "resource_local_to_scene", "script"}


class _Opaque(Exception):
    """A resource whose rest is not read, with the reason; it is no fault of the file."""


def _godot_text(f: Reader, size: int | None = None) -> str:
    size = f.number("<I") if size is None else size
    need(size <= 4096, "resource text too long")
    if not size:
        return ""
    held = f.read(size)
    need(held[-1] == 0 and 0 not in held[:-1], "resource text does not end")
    return text(held[:-1])


def _godot_count(f: Reader, most: int) -> range:
    n = f.number("<I")
    need(n <= most, "too many resource entries")
    return range(n)


def _godot_properties(f: Reader, strings: list[str], four: bool) -> dict[str, tuple[str, object]]:
    """Name to (kind, value) of the properties at the reader's place; of bytes the value is where they lie, and they are not read."""
    out: dict[str, tuple[str, object]] = {}
    for _ in _godot_count(f, 128 if four else 4096):
        at = f.number("<I")
        need(at >> 31 or at < len(strings), "property name out of range")
        name = _godot_text(f, at & 0x7FFFFFFF) if at >> 31 else strings[at]
        if four:
            need(name != "" and name not in out, "property name empty or repeated")
            if name not in GODOT_SAMPLE:
                raise _Opaque("UNKNOWN_AUDIO_PROPERTY_SCHEMA")
        type_ = f.number("<I")
        if type_ == 5:
            out[name] = "STRING", _godot_text(f)
        elif type_ == 31:
            size = f.number("<I")
            out[name] = "DECLARED_BYTES", (f.at, size)
            f.seek(f.at + size + (-size % 4 if four else 0))
            need(f.at <= f.length, "property bytes outside the file")
        elif four and type_ == 24:
            if f.number("<I"):
                raise _Opaque("OBJECT_REFERENCE_PROPERTY_NOT_PARSED")
            out[name] = "EMPTY", None
        elif type_ in GODOT_VALUES and not (four and type_ in (4, 41)):
            kind, layout = GODOT_VALUES[type_]
            value = f.number(layout) if layout else None
            need(not four or kind != "BOOL" or value <= 1, "no truth value")
            out[name] = kind, bool(value) if kind == "BOOL" else value
        elif four:
            raise _Opaque("UNSUPPORTED_PROPERTY_VARIANT")
        else:
            need(False, "property type")
    return out


def _godot_sample(properties: dict[str, tuple[str, object]]) -> Record:
    """The sample that properties describe, with the engine's defaults for those left out."""

    def one(name: str, kind: str, default):
        found = properties.get(name, (kind, default))
        need(found[0] == kind, f"type of {name}")
        return found[1]

    one("resource_name", "STRING", ""), one("resource_local_to_scene", "BOOL", False)
    if properties.get("script", ("EMPTY",))[0] != "EMPTY":
        raise _Opaque("SCRIPTED_AUDIO_RESOURCE_NOT_PARSED")
    codec, rate, stereo = one("format", "INTEGER", 0), one("mix_rate", "INTEGER", 44100), one("stereo", "BOOL", False)
    mode, begin, end = (one(f"loop_{x}", "INTEGER", 0) for x in ("mode", "begin", "end"))
    offset, size = one("data", "DECLARED_BYTES", (0, 0))
    need(0 <= codec <= 3 and 0 < rate < 1 << 31 and 0 <= mode <= 3 and 0 <= begin < 1 << 31 and 0 <= end < 1 << 31, "sample metadata")
    numbers = {"rate": rate, "channels": 1 + stereo, "loop_mode": mode, "loop_begin": begin, "loop_end": end, "offset": offset, "size": size}
    if codec < 2:
        frames, rest = divmod(size, (1 + codec) * (1 + stereo))
        need(rest == 0, "samples are not whole frames")
        need(mode == 0 or begin < end <= frames, "loop outside the sample")
        numbers["frames"] = frames
    return "GODOT_AUDIO_WAV", GODOT_CODECS[codec], numbers, {}


def _godot(f: Reader) -> Iterator[Record]:
    """The records of an uncompressed resource; ends with ``_Opaque`` where the rest isn't read."""
    big, wide = f.unpack("<2I")
    need(big <= 1 and wide <= 1, "resource layout")
    if big:
        raise _Opaque("BIG_ENDIAN_RESOURCE_NOT_PARSED")
    major, minor, fmt = f.unpack("<3I")
    four = (major, minor, fmt) == (4, 3, 6)
    if not four and major != 3:
        raise _Opaque("UNSUPPORTED_ENGINE_OR_RESOURCE_VERSION")
    kind = _godot_text(f)
    imports, flags, uid = f.unpack("<QIQ")
    yield "GODOT_RESOURCE", kind, {"compressed": 0, "major": major, "minor": minor, "format": fmt, "flags": flags}, {"uid": str(uid)}
    if four and flags >> 4:
        raise _Opaque("UNKNOWN_HEADER_FLAGS")
    if four and flags & 8:
        raise _Opaque("SCRIPT_CLASS_RESOURCE_NOT_PARSED")
    reserved = f.unpack("<11I")
    if four and any(reserved):
        raise _Opaque("UNKNOWN_RESERVED_HEADER_FIELDS")
    if four and imports:
        raise _Opaque("IMPORT_METADATA_LAYOUT_NOT_PARSED")
    strings = [_godot_text(f) for _ in _godot_count(f, 4096 if four else 65535)]
    external = [(_godot_text(f), _godot_text(f), str(f.number("<Q")) if four and flags & 2 else "") for _ in _godot_count(f, 1024 if four else 4096)]
    internal = [(_godot_text(f), f.number("<Q")) for _ in _godot_count(f, 1024)]
    need(len(internal) == 1 or four and len(internal) > 1, "internal resources")
    need(len(dict(internal)) == len(internal) == len({at for _, at in internal}), "internal resources of one path or place")
    close = f.length - 4 if four else f.length
    need(all(at < close and (at >= f.at or not four) for _, at in internal), "internal resource outside the data")
    need(not four or f.take(close, 4) == b"RSRC", "no signature at the end")
    yield "GODOT_RESOURCE_TABLES", "", {"strings": len(strings), "external": len(external), "internal": len(internal)}, {}
    yield from (("GODOT_RESOURCE_EXTERNAL", path, {}, {"type": type_, "uid": id_}) for type_, path, id_ in external)
    yield from (("GODOT_RESOURCE_INTERNAL", path, {"offset": at}, {}) for path, at in internal)
    if four and kind != "AudioStreamWAV":
        raise _Opaque("NON_WAV_RESOURCE_PAYLOAD_OPAQUE")
    if four and (external or len(internal) > 1):
        raise _Opaque("REFERENCED_OR_MULTI_RESOURCE_AUDIO_OPAQUE")
    if four and (wide or flags & 4):
        raise _Opaque("REAL64_RESOURCE_PAYLOAD_NOT_PARSED")
    own = _godot_text(f.seek(internal[0][1]))
    need(not four or own == kind, "class differs from the header's")
    found = _godot_properties(f, strings, four)
    need(not four or f.at == close, "bytes after the resource")
    sample = _godot_sample(found) if four else None
    for name, (type_, value) in sorted(found.items()):
        size = {"size": value[1]} if type_ == "DECLARED_BYTES" else {"value": int(value)} if type_ in ("INTEGER", "BOOL") else {}
        yield "GODOT_PROPERTY", name, size, {"type": type_} | ({"value": str(value)} if type_ in ("STRING", "REAL") else {})
    if sample:
        yield sample


def rsrc(f: Reader) -> Iterator[Record]:
    """Godot binary resources: header, tables, and the properties of Godot 3 resources and Godot 4.3 samples; the last record is whether all was read, or what stayed opaque.

    Compressed resources are opaque, references are not followed, and the bytes of a property are not read.
    """
    magic, status = f.seek(0).read(4), "METADATA_ONLY"
    need(magic in (b"RSRC", b"RSCC"), "no Godot resource")
    if magic == b"RSCC":
        status = "COMPRESSED_RESOURCE_NOT_DECODED"
        yield "GODOT_RESOURCE", "", {"compressed": 1}, {}
    else:
        try:
            yield from _godot(f)
        except _Opaque as e:
            status = str(e)
    yield "GODOT_STATUS", status, {"opaque": int(status != "METADATA_ONLY")}, {}


# First bytes of a package, the decoded bytes of a chunk (the first lacks the four of the magic), and limits on chunks and bytes.
PACKAGE_MAGIC, PACKAGE_CHUNK, PACKAGE_CHUNKS, PACKAGE_BYTES = b"\x20\0\0\x07", 1 << 25, 128, 512 << 20


def package(f: Reader) -> Iterator[Record]:
    """Chunked packages: where each chunk lies and whether it is stored or compressed. Payloads are not read, so the decoded bytes are known of stored chunks alone."""
    need(10 <= f.length <= PACKAGE_BYTES, "package size")
    need(f.seek(0).read(4) == PACKAGE_MAGIC, "no package of this version")
    room, at = PACKAGE_CHUNK - 4, 0
    while f.at < f.length:
        need(at < PACKAGE_CHUNKS, "too many chunks")
        begin, kind = f.at, f.number("B")
        need(kind in (0, 1), "unknown chunk flag")
        size = f.number(">I") if kind else room
        need(0 < size <= PACKAGE_CHUNK + PACKAGE_CHUNK // 255 + 16 and f.at + size <= f.length, "chunk size")
        yield "PACKAGE_CHUNK", "lz4" if kind else "stored", {"at": at, "offset": begin, "size": size, "room": room}, {}
        f.seek(f.at + size)
        room, at = PACKAGE_CHUNK, at + 1


#: By the first bytes, in order; packs without magic at their start come last.
MAGIC: list[tuple[bytes, str, Callable[[Reader], Iterator[Record]]]] = [
    (b"XNB", "xnb", xnb), (b"FSB5", "fsb5", fsb5), (b"GDPC", "pck", pck), (b"UnityFS\0", "unityfs", unityfs), (b"-==-", "utoc", utoc), (b"\x34\x12\xaa\x55", "vpk", vpk), (b"VTF\0", "vtf", vtf),
    (b"FORM", "form", form), (b"DDS ", "dds", dds), (b"GST2", "gst2", gst2), (b"GDST", "gdst", gdst), (b"RSRC", "rsrc", rsrc), (b"RSCC", "rsrc", rsrc),
    (PACKAGE_MAGIC, "package", package),
]


def detect(f: Reader) -> tuple[str, Callable[[Reader], Iterator[Record]]]:
    head = f.take(0, min(16, f.length))
    for magic, name, decoder in MAGIC:
        if head.startswith(magic):
            return name, decoder
    if head[:4] == b"RIFF":
        return ("fsb5", fsb5) if head[8:12] == b"FEV " else ("wav", wav)
    if len(head) >= 12 and 17 <= struct.unpack_from(">I", head, 8)[0] <= 22:
        return "serialized", serialized
    return "pak", pak


def decode(f: Reader, fmt: str | None = None) -> tuple[str, list[Record], str | None]:
    """(format, records, reason): all records of a file, or none and the reason for its rejection, which never holds a pipe."""
    name = fmt or ""
    try:
        name, decoder = detect(f) if not fmt else (fmt, {n: d for _, n, d in MAGIC}.get(fmt) or {"pak": pak, "wav": wav, "serialized": serialized}[fmt])
        return name, list(decoder(f)), None
    except (Rejected, struct.error) as e:
        return name or "unknown", [], str(e).replace("|", "/")
