"""Container decoders on bytes built here, whole, cut short and spoiled."""

import hashlib
import struct

import pyarrow as pa
import pytest
from siltstone.decode import formats, scan
from siltstone.decode.reader import Reader, Rejected


def records(data, fmt=None):
    name, out, reason = formats.decode(Reader(data, len(data)), fmt)
    assert reason is None, reason
    return name, out


def rejected(data):
    return formats.decode(Reader(data, len(data)))[2] is not None


def make_pck(version, files):
    head = struct.pack("<4s4I", b"GDPC", version, 4, 2, 1)
    if version >= 2:
        head += struct.pack("<IQ", 0, 0)
    if version >= 3:
        head += struct.pack("<Q", 112)
    head = head.ljust({1: 84, 2: 96}.get(version, 112), b"\0")
    entry = lambda n, o, d: struct.pack("<I", len(n)) + n + struct.pack("<QQ", o, len(d)) + hashlib.md5(d).digest() + (struct.pack("<I", 0) if version >= 2 else b"")
    at = len(head) + 4 + sum(len(entry(n, 0, d)) for n, d in files)
    body, payload = b"", b""
    for n, d in files:
        body += entry(n, at + len(payload), d)
        payload += d
    return head + struct.pack("<I", len(files)) + body + payload


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_pck(version):
    data = make_pck(version, [(b"res://a.png\0", b"one"), (b"res://b.png", b"one"), (b"c", b"three")])
    name, out = records(data)
    assert name == "pck" and out[0][2]["entries"] == 3 and out[0][2]["payload"] == 11 and [r[1] for r in out[1:]] == ["res://a.png", "res://b.png", "c"]
    assert rejected(data[:-1]) and rejected(data[:90])


def test_pck_tables(spark):
    data = make_pck(2, [(b"a.png", b"one"), (b"b.png", b"one"), (b"c.wav", b"three")])
    files = spark.createDataFrame([("good", bytearray(data)), ("bad", bytearray(b"GDPC"))], "path string, content binary")
    found = scan.decode_content(files).cache()
    audit = {r.path: r for r in scan.tree_audit(found).collect()}
    assert audit["good"].status == "OK" and audit["bad"].status == "REJECT" and audit["bad"].reason
    assert [(r.name, r.first_name) for r in scan.pack_duplicates(scan.pack_entries(found)).collect()] == [("b.png", "a.png")]
    assert {r.ext: r.entries for r in scan.type_rollup(found).collect()} == {"png": 2, "wav": 1}


def test_decode_files(spark, tmp_path):
    (tmp_path / "x.pck").write_bytes(make_pck(1, [(b"a", b"b")]))
    (tmp_path / "y.bin").write_bytes(b"nothing here")
    got = {r.path.rsplit("/")[-1]: r.status for r in scan.tree_audit(scan.decode_files(spark, str(tmp_path))).collect()}
    assert got == {"x.pck": "OK", "y.bin": "REJECT"}


def test_pak():
    fstring = lambda s: struct.pack("<i", len(s) + 1) + s + b"\0"
    index = fstring(b"../../../") + struct.pack("<I", 1) + fstring(b"Game/a.uasset") + struct.pack("<QQQI", 0, 4, 4, 0) + b"\1" * 20 + b"\0" + struct.pack("<I", 0)
    data = b"data" + index + bytes(16) + b"\0" + struct.pack("<IIQQ", formats.PAK_MAGIC, 7, 4, len(index)) + hashlib.sha1(index).digest()
    name, out = records(data)
    assert name == "pak" and out[0][3]["index"] == "OK" and out[1][1] == "Game/a.uasset"
    spoiled = data[:6] + b"\xff" + data[7:]
    assert records(spoiled)[1][0][3]["index"] == "INDEX_SHA1_MISMATCH"
    assert rejected(data + bytes(3))


def test_utoc():
    header = b"-==--==--==--==-" + struct.pack("<B3x9IQ", 3, 144, 2, 2, 12, 1, 32, 65536, 0, 1, 7) + bytes(16) + b"\x09"
    header = header.ljust(144, b"\0")
    ids = bytes(range(12)) + bytes(range(1, 13))
    offsets = (0).to_bytes(5, "big") + (70000).to_bytes(5, "big") + (131072).to_bytes(5, "big") + (10).to_bytes(5, "big")
    blocks = b"".join(o.to_bytes(5, "little") + c.to_bytes(3, "little") + r.to_bytes(3, "little") + bytes([m]) for o, c, r, m in [(0, 100, 65536, 1), (112, 50, 4464, 0)])
    name, out = records(header + ids + offsets + blocks + b"Oodle".ljust(32, b"\0"))
    assert name == "utoc" and [r[0] for r in out] == ["UNREAL_IOSTORE"] + ["IOSTORE_CHUNK"] * 2 + ["IOSTORE_BLOCK"] * 2
    assert out[1][2]["length"] == 70000 and out[3][1] == "Oodle" and out[4][2]["raw"] == 4464
    assert rejected(header + ids)


def test_vpk():
    entry = struct.pack("<IHHIIH", 1, 2, 0, 10, 20, 0xFFFF) + b"pp"
    tree = b"txt\0dir\0a\0" + entry + b"b\0" + entry + b"\0\0\0"
    data = struct.pack("<3I", 0x55AA1234, 1, len(tree)) + tree
    assert [r[1] for r in records(data)[1][1:]] == ["dir/a.txt", "dir/b.txt"]
    assert rejected(data.replace(b"b\0" + entry, b"A\0" + entry)) and rejected(data[:-1])


def test_form_fsb_xnb():
    body = b"GEN8" + struct.pack("<I", 4) + b"abcd" + b"STRG" + struct.pack("<I", 0)
    data = b"FORM" + struct.pack("<I", len(body)) + body
    assert [r[1] for r in records(data)[1]] == ["", "GEN8", "STRG"] and rejected(data + b"x")
    sample = 0 | 8 << 1 | 1 << 5 | 0 << 7 | 1000 << 34
    extra = 1 | 9 << 1 | 0 << 5 | 1 << 7 | 500 << 34
    headers = struct.pack("<Q", sample) + struct.pack("<Q", extra) + struct.pack("<I", 0 | 4 << 1 | 2 << 25) + struct.pack("<I", 12345)
    data = struct.pack("<4s6I", b"FSB5", 1, 2, len(headers), 0, 64, 15).ljust(60, b"\0") + headers + bytes(64)
    out = records(data)[1]
    assert out[0][3]["codec"] == "VORBIS" and out[1][2]["rate"] == 44100 and out[2][2]["rate"] == 12345 and out[2][2]["offset"] == 32
    reader = b"Microsoft.Xna.Framework.Content.Texture2DReader"
    rest = bytes([1, len(reader)]) + reader + struct.pack("<i", 0)
    data = b"XNBw\x05\x00" + struct.pack("<I", 10 + len(rest)) + rest
    assert records(data)[1][1][1] == reader.decode() and rejected(data + b"x")


def test_textures_and_sounds():
    dds = (b"DDS " + struct.pack("<7I", 124, 0x20000, 8, 8, 0, 0, 2)).ljust(84, b"\0") + b"DXT1"
    dds = dds.ljust(128, b"\0") + bytes(32 + 8)
    assert records(dds)[1][0][3]["chain"] == "OK" and records(dds + b"x")[1][0][3]["chain"] == "LENGTH_DIFFERS"
    vtf = (b"VTF\0" + struct.pack("<3IHHIHh", 7, 2, 80, 64, 32, 0, 1, 0)).ljust(52, b"\0") + struct.pack("<IBIBBH", 13, 7, 13, 16, 16, 1)
    assert records(vtf.ljust(80, b"\0"))[1][0][2]["width"] == 64
    wav = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48000, 192000, 4, 16) + b"data" + struct.pack("<I", 8) + bytes(8)
    assert records(b"RIFF" + struct.pack("<I", 4 + len(wav)) + b"WAVE" + wav)[1][0][2]["frames"] == 2
    assert records(b"GST2" + struct.pack("<5I", 1, 4, 4, 0, 0) + bytes(12) + struct.pack("<IHHII", 0, 4, 4, 2, 5))[0] == "gst2"
    assert records(b"GDST" + struct.pack("<4HII", 4, 0, 4, 0, 0, 5))[0] == "gdst"
    assert records(make_resource([]))[1][0][1] == "AudioStreamWAV"


def godot_text(s):
    return struct.pack("<I", len(s) + 1) + s.encode() + b"\0"


def make_resource(properties, version=(4, 3, 6), kind="AudioStreamWAV", flags=0, external=(), tail=b"RSRC"):
    """A Godot resource of (name, type, packed value); names are in its table."""
    names = [n for n, _, _ in properties]
    head = b"RSRC" + struct.pack("<5I", 0, 0, *version) + godot_text(kind) + struct.pack("<QIQ", 0, flags, 2**64 - 1) + bytes(44)
    head += struct.pack("<I", len(names)) + b"".join(map(godot_text, names)) + struct.pack("<I", len(external)) + b"".join(godot_text(t) + godot_text(n) for t, n in external)
    head += struct.pack("<I", 1) + godot_text("local://1")
    body = godot_text(kind) + struct.pack("<I", len(names)) + b"".join(struct.pack("<2I", i, t) + v for i, (_, t, v) in enumerate(properties))
    return head + struct.pack("<Q", len(head) + 8) + body + tail


def test_godot_resources():
    word = lambda n: struct.pack("<I", n)
    pcm = lambda n: word(n) + bytes(n + -n % 4)
    good = [("data", 31, pcm(10)), ("format", 3, word(1)), ("mix_rate", 40, struct.pack("<q", 22050)), ("loop_mode", 3, word(1)), ("loop_end", 3, word(5)), ("resource_name", 5, godot_text("hit")), ("script", 24, word(0))]
    data = make_resource(good)
    got = records(data)[1]
    wav = next(r for r in got if r[0] == "GODOT_AUDIO_WAV")
    assert wav[1:3] == ("PCM16", {"rate": 22050, "channels": 1, "loop_mode": 1, "loop_begin": 0, "loop_end": 5, "offset": data.index(pcm(10), 200) + 4, "size": 10, "frames": 5})
    assert got[-1][1:3] == ("METADATA_ONLY", {"opaque": 0}) and got[0][3] == {"uid": str(2**64 - 1)}
    assert [(n, t["type"]) for tag, n, _, t in got if tag == "GODOT_PROPERTY"][:3] == [("data", "DECLARED_BYTES"), ("format", "INTEGER"), ("loop_end", "INTEGER")]
    assert next(r for r in records(make_resource([]))[1] if r[0] == "GODOT_AUDIO_WAV")[2]["rate"] == 44100
    spoiled = [[("data", 31, pcm(5)), ("format", 3, word(1))], [("format", 3, word(4))], [("stereo", 3, word(1))], [("stereo", 2, word(2))], [("loop_mode", 3, word(1))], [("mix_rate", 3, word(0))], [("stereo", 2, word(1))] * 2]
    assert all(rejected(make_resource(x)) for x in spoiled)
    for cut in (4, 40, 60, len(data) - 8, len(data) - 1):
        assert rejected(data[:cut])
    assert rejected(make_resource(good, tail=b"\0RSRC")) and rejected(make_resource(good, tail=b"RSRX"))
    status = lambda *a, **k: records(make_resource(*a, **k))[1][-1][1]
    assert status([("other", 1, b"")]) == "UNKNOWN_AUDIO_PROPERTY_SCHEMA" and status([("data", 4, word(0))]) == "UNSUPPORTED_PROPERTY_VARIANT"
    assert status([("script", 24, word(3))]) == "OBJECT_REFERENCE_PROPERTY_NOT_PARSED" and status([], kind="Theme") == "NON_WAV_RESOURCE_PAYLOAD_OPAQUE"
    assert status([], version=(4, 4, 6)) == "UNSUPPORTED_ENGINE_OR_RESOURCE_VERSION" and status([], flags=16) == "UNKNOWN_HEADER_FLAGS" and status([], flags=8) == "SCRIPT_CLASS_RESOURCE_NOT_PARSED"
    assert status([], external=[("Script", "res://a.gd")]) == "REFERENCED_OR_MULTI_RESOURCE_AUDIO_OPAQUE" and status([], flags=4) == "REAL64_RESOURCE_PAYLOAD_NOT_PARSED"
    assert records(b"RSCC" + bytes(20))[1][-1][1] == "COMPRESSED_RESOURCE_NOT_DECODED"
    old = [("data", 31, word(4) + b"abcd"), ("loop", 2, word(1)), ("loop_offset", 4, struct.pack("<f", 0.5)), ("n", 41, struct.pack("<d", 2.0))]
    got = records(make_resource(old, version=(3, 5, 3), kind="AudioStreamMP3", tail=b""))[1]
    assert [(n, r, t) for tag, n, r, t in got if tag == "GODOT_PROPERTY"] == [("data", {"size": 4}, {"type": "DECLARED_BYTES"}), ("loop", {"value": 1}, {"type": "BOOL"}), ("loop_offset", {}, {"type": "REAL", "value": "0.5"}), ("n", {}, {"type": "REAL", "value": "2.0"})]
    assert rejected(make_resource([("x", 24, word(0))], version=(3, 5, 3)))


def make_package(*chunks):
    """Compressed chunks as their bytes, a stored one as None."""
    body = b"\x20\0\0\x07"
    for i, c in enumerate(chunks):
        body += bytes(1 + formats.PACKAGE_CHUNK - 4 * (i == 0)) if c is None else b"\1" + struct.pack(">I", len(c)) + c
    return body


def test_package(spark):
    first, second = pa.compress(b"a" * 500, codec="lz4_raw", asbytes=True), pa.compress(b"xyz" * 90, codec="lz4_raw", asbytes=True)
    name, got = records(make_package(first, second))
    assert name == "package" and [(n, r["at"], r["offset"], r["size"]) for _, n, r, _ in got] == [("lz4", 0, 4, len(first)), ("lz4", 1, 9 + len(first), len(second))]
    assert [r["room"] for _, _, r, _ in got] == [(1 << 25) - 4, 1 << 25]
    name, got = records(make_package(None, second))
    assert [(n, r["offset"], r["size"]) for _, n, r, _ in got] == [("stored", 4, (1 << 25) - 4), ("lz4", 1 + (1 << 25), len(second))]
    whole = make_package(first, second)
    for bad in (whole[:-1], whole + b"\0", whole + b"\2abcd", whole + b"\1" + bytes(4), whole + b"\1" + struct.pack(">I", 1 << 26), whole[:9], b"\x20\0\0\x05" + whole[4:]):
        assert rejected(bad)
    assert rejected(make_package(*[b"q"] * 129)) and not rejected(make_package(*[b"q"] * 128))
    files = spark.createDataFrame([("a.pkg", whole), ("b.pkg", whole[:-1])], "path string, content binary")
    assert scan.package_rollup(scan.decode_content(files)).collect() == [("a.pkg", 2, 2, len(first) + len(second))]


def test_unity():
    info = bytes(16) + struct.pack(">I", 1) + struct.pack(">IIH", 10, 10, 0) + struct.pack(">I", 1) + struct.pack(">QQI", 0, 10, 4) + b"CAB-x\0"
    packed = pa.compress(info, codec="lz4_raw", asbytes=True)
    for kind, stored in ((0, info), (2, packed)):
        head = b"UnityFS\0" + struct.pack(">I", 6) + b"5.x.x\0" + b"2020.1\0"
        size = len(head) + 20 + len(stored) + 10
        data = head + struct.pack(">QIII", size, len(stored), len(info), kind) + stored + bytes(10)
        assert [r[1] for r in records(data)[1]] == ["", "CAB-x"] and rejected(data[:-1])
    data = struct.pack(">4I", 10, 64, 17, 48) + bytes(4) + b"2020.1\0" + struct.pack("<I", 19)
    assert records(data.ljust(64, b"\0"))[1][0][2]["platform"] == 19


def test_reader_bounds():
    r = Reader(b"0123456789", 10, budget=8)
    assert r.take(2, 3) == b"234"
    for offset, size in ((8, 3), (-1, 2), (0, 6)):
        with pytest.raises(Rejected):
            r.take(offset, size)


def test_pak_directory():
    fstring = lambda s: struct.pack("<i", len(s) + 1) + s + b"\0"
    packed = struct.pack("<IIII", 1 << 31 | 1 << 30 | 1 << 29 | 2 << 23 | 2 << 6 | 4, 100, 5000, 900) + struct.pack("<II", 450, 450) + struct.pack("<III", 1 << 31 | 1 << 30, 7, 8)
    directory = struct.pack("<I", 1) + fstring(b"Game/") + struct.pack("<I", 4) + b"".join(fstring(n) + struct.pack("<i", at) for n, at in [(b"a", 0), (b"b", 24), (b"c", -1), (b"d", -(1 << 31))])
    plain = struct.pack("<QQQI20s", 3, 4, 4, 0, bytes(20)) + bytes(5)
    index = fstring(b"../") + struct.pack("<IQ", 4, 0) + struct.pack("<I", 0) + struct.pack("<IQQ", 1, 0, len(directory)) + hashlib.sha1(directory).digest() + struct.pack("<I", len(packed)) + packed + struct.pack("<I", 1) + plain
    names = (b"Zlib".ljust(32, b"\0") + b"Oodle".ljust(32, b"\0")).ljust(160, b"\0")
    data = directory + index + bytes(16) + b"\0" + struct.pack("<IIQQ", formats.PAK_MAGIC, 11, len(directory), len(index)) + hashlib.sha1(index).digest() + names
    out = {r[1]: r for r in records(data, "pak")[1][1:]}
    assert out["Game/a"][2]["raw"] == 5000 and out["Game/a"][2]["size"] == 900 and out["Game/a"][3]["method_name"] == "Oodle" and out["Game/a"][2]["block_size"] == 8192
    assert out["Game/b"][2]["offset"] == 7 and out["Game/c"][2]["size"] == 4 and out["Game/d"][0] == "UNREAL_DELETED"
    assert formats.decode(Reader(b"x" + data[1:], len(data)), "pak")[2] == "secondary index differs from its SHA-1"


def test_textures_in_full():
    body = struct.pack("<4i", 0, 4, 2, 2) + struct.pack("<I", 32) + bytes(32) + struct.pack("<I", 8) + bytes(8)
    reader = b"Microsoft.Xna.Framework.Content.Texture2DReader, X"
    rest = bytes([1, len(reader)]) + reader + struct.pack("<i", 0) + b"\0\1" + body
    out = records(b"XNBw\x05\x00" + struct.pack("<I", 10 + len(rest)) + rest)[1]
    assert [r[0] for r in out] == ["XNB_HEADER", "XNB_READER", "XNB_TEXTURE", "XNB_MIP", "XNB_MIP", "XNB_TEXTURE_STATUS"] and out[-1][3]["texture"] == "OK"
    vtf = (b"VTF\0" + struct.pack("<3IHHIHh", 7, 2, 80, 8, 8, 0, 1, 0)).ljust(52, b"\0") + struct.pack("<IBIBBH", 13, 2, 13, 4, 4, 1)
    vtf = vtf.ljust(80, b"\0") + bytes(8 + 8 + 32)
    out = records(vtf)[1]
    assert [r[1] for r in out[1:3]] == ["1", "0"] and out[-1][3]["chain"] == "OK" and records(vtf + b"x")[1][-1][3]["chain"] == "LENGTH_DIFFERS"
    table = struct.pack("<5I", 4, 0, 44, 44, 9999)
    data = b"FORM" + struct.pack("<I", 8 + len(table) + 12) + b"STRG" + struct.pack("<I", len(table) + 12) + table + bytes(12)
    assert records(data)[1][2][2] == {"count": 4, "nulls": 1, "aliases": 1, "outside": 1, "into_table": 0}


def test_tables_of_records(spark):
    header = (b"-==--==--==--==-" + struct.pack("<B3x9IQ", 3, 144, 2, 2, 12, 0, 0, 65536, 0, 1, 7) + bytes(16) + b"\0").ljust(144, b"\0")
    offsets = b"".join(a.to_bytes(5, "big") + n.to_bytes(5, "big") for a, n in [(0, 70000), (65536, 9000)])
    blocks = b"".join(o.to_bytes(5, "little") + c.to_bytes(3, "little") + r.to_bytes(3, "little") + b"\0" for o, c, r in [(0, 100, 65536), (112, 50, 4464)])
    utoc = header + bytes(range(12)) + bytes(range(1, 13)) + offsets + blocks
    types = struct.pack("<?I", False, 1) + struct.pack("<i?h", 28, False, -1) + bytes(16)
    meta = b"2020.1\0" + struct.pack("<I", 19) + types + struct.pack("<I", 2)
    at = 20 + len(meta)
    objects = bytes(-at % 4) + struct.pack("<qIII", 1, 0, 8, 0) + struct.pack("<qIII", 2, 8, 8, 0)
    data = 20 + len(meta) + len(objects)
    unity = struct.pack(">4I", len(meta) + len(objects), data + 16, 17, data) + bytes(4) + meta + objects + bytes(16)
    found = scan.decode_content(spark.createDataFrame([("u", bytearray(utoc)), ("s", bytearray(unity))], "path string, content binary")).cache()
    got = {r.chunk[-2:]: (r.blocks, r.complete) for r in scan.chunk_blocks(found).collect()}
    assert got == {"0b": (2, True), "0c": (1, False)}
    assert [(r["class"], r.objects, r.bytes) for r in scan.class_rollup(found).collect()] == [(28, 2, 16)]
    assert [(r.union_length, r.overlap_groups) for r in scan.coverage(found, "UNITY_OBJECT").collect()] == [(16, 0)]
    refs = spark.createDataFrame([("a", 0, 5), ("a", 9, 5), ("b", 0, 1), ("c", 0, 1)], "path string, begin long, length long")
    files = spark.createDataFrame([("a", 10), ("b", None)], "path string, size long")
    assert sorted(r.status for r in scan.resolve_streams(refs, files).collect()) == ["MISSING", "OUT_OF_RANGE", "RESOLVED", "UNREADABLE"]
