"""Readers of PDF pages and media tags, on files made here."""

import struct
import zlib

from skerry.sources import extract, media, pdf


def _pdf(parts, packed=True):
    out = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n"
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(parts))).encode()
    out += b"2 0 obj <</Type/Pages/Kids[%s]/Count %d/Resources<</Font<</F1 90 0 R/F2 91 0 R>>>>>> endobj\n" % (kids, len(parts))
    for i, body in enumerate(parts):
        raw = zlib.compress(body) if packed else body
        out += b"%d 0 obj <</Type/Page/Parent 2 0 R/Contents %d 0 R>> endobj\n" % (3 + 2 * i, 4 + 2 * i)
        out += b"%d 0 obj <</Length %d%s>> stream\n%s\nendstream endobj\n" % (4 + 2 * i, len(raw), b"/Filter/FlateDecode" if packed else b"", raw)
    cmap = b"begincmap 1 beginbfchar <0041> <03B1> endbfchar 1 beginbfrange <0001> <0003> <0061> endbfrange endcmap"
    out += b"90 0 obj <</Type/Font/Subtype/Type1>> endobj 91 0 obj <</Type/Font/Subtype/Type0/ToUnicode 92 0 R>> endobj\n"
    return out + b"92 0 obj <</Length %d>> stream\n%s\nendstream endobj trailer <</Root 1 0 R>>" % (len(cmap), cmap)


def _lzw(data):
    """LZW as PDF has it: most significant bit first, widths of 9 to 12 bits changed so early that a reader, an entry behind, can follow."""
    table, word, bits, n, width = {bytes([i]): i for i in range(256)}, b"", 256, 9, 9
    for i in range(len(data) + 1):
        c = data[i:i + 1]
        if c and word + c in table:
            word += c
            continue
        bits, n = bits << width | table[word], n + width
        if c:
            table[word + c] = len(table) + 2
            width = min(12, (len(table) + 2).bit_length())
            word = c
    bits, n = bits << width | 257, n + width
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


def test_pdf_pages():
    body = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Quarterly \\(net\\)) Tj 0 -14 Td [(rev) 20 (enue) -300 (plan)] TJ ET"
    for packed in (True, False):
        got = list(pdf.pages(_pdf([body, b"", b"BT /F2 9 Tf <0001000200030041> Tj ET"], packed)))
        assert got == [(1, "Quarterly (net)\nrevenue plan", "page"), (3, "abcα", "page")]
    import base64

    for name, coded in (("ASCII85Decode", base64.a85encode(body) + b"~>"), ("ASCIIHexDecode", body.hex().encode() + b">"), ("RunLengthDecode", bytes([len(body) - 1]) + body + bytes([128])), ("LZWDecode", _lzw(body))):
        assert pdf.FILTERS[name](coded) == body
    long = bytes(i * i % 251 % 11 + 97 for i in range(4000))
    assert pdf._lzw(_lzw(long)) == long
    assert pdf._run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    with_picture = _pdf([body]).replace(b"/Resources<<", b"/Resources<</XObject<</I 95 0 R/J 96 0 R>>")
    with_picture += b" 95 0 obj <</Subtype/Image/Filter/DCTDecode/Length 7>> stream\ninvoice\nendstream endobj 96 0 obj <</Subtype/Image/Filter/FlateDecode/Length 2>> stream\nxx\nendstream endobj"
    assert list(pdf.pages(with_picture, bytes.decode)) == [(1, "Quarterly (net)\nrevenue plan", "page"), (1, "invoice", "ocr")]
    assert list(pdf.pages(with_picture, bytes.decode, 8)) == [(1, "Quarterly (net)\nrevenue plan", "page")]
    assert list(pdf.pages(b"%PDF-1.4 nothing")) == [] and list(pdf.pages(b"")) == []


def test_sound_and_film_tags():
    frame = lambda name, text: name + struct.pack(">IH", len(text) + 1, 0) + b"\3" + text
    frames = frame(b"TIT2", b"Song") + frame(b"TPE1", b"Ann\0Bob")
    mp3 = b"ID3\3\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames
    assert list(media.READERS[".mp3"](mp3)) == [(1, "[Artist] Ann, Bob", "tag"), (2, "[Title] Song", "tag")]
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    item = box(b"\xa9nam", box(b"data", b"\0" * 8 + b"Film"))
    film = box(b"ftyp", b"M4A ") + box(b"moov", box(b"udta", box(b"meta", b"\0" * 4 + box(b"ilst", item))))
    assert list(media.READERS[".mp4"](film)) == [(1, "[Title] Film", "tag")]
    comment = struct.pack("<I", 1) + b"v" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(c)) + c for c in (b"ARTIST=A", b"ARTIST=B"))
    assert list(media.READERS[".flac"](b"fLaC\x84" + len(comment).to_bytes(3, "big") + comment)) == [(1, "[Artist] A, B", "tag")]
    assert list(media.READERS[".mp3"](b"")) == []
    head = b"\1vorbis" + b"\0" * 23
    packet = b"\3vorbis" + comment + b"\1"
    page = lambda n, *packets: b"OggS\0\0" + b"\0" * 8 + b"abcd" + struct.pack("<I", n) + b"\0" * 4 + bytes([len(packets), *map(len, packets)]) + b"".join(packets)
    assert list(media.READERS[".ogg"](page(0, head) + page(1, packet))) == [(1, "[Artist] A, B", "tag")]
    assert list(media.READERS[".opus"](page(0, b"OpusHead") + page(1, b"OpusTags" + comment))) == [(1, "[Artist] A, B", "tag")]
    assert list(media.READERS[".ogg"](b"")) == []


def test_picture_tags():
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + b"\0\0\0\0"
    packet = b'<x xmlns:d="d" xmlns:r="r"><r:Description d:headline="News"><d:subject><r:li>sea</r:li><r:li>sun</r:li></d:subject></r:Description></x>'
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Author\0Ann") + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + packet)
    assert [t for _, t, _ in media.READERS[".png"](png)] == ["[Author] Ann", "[Headline] News", "[Keywords] sea, sun"]
    entry = lambda tag, kind, n, value: struct.pack("<HHI4s", tag, kind, n, value)
    gps_at = 8 + 2 + 12 * 2 + 4
    values_at = gps_at + 2 + 12 * 4 + 4
    top = struct.pack("<H", 2) + entry(271, 2, 3, b"Ab\0\0") + entry(media.GPS_FOLDER, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", values_at)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", values_at + 24)) + b"\0" * 4
    numbers = struct.pack("<12I", 33, 1, 30, 1, 36, 1, 151, 1, 0, 1, 0, 1)
    tiff = b"II*\0" + struct.pack("<I", 8) + top + gps + numbers
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    assert [t for _, t, _ in media.READERS[".jpg"](jpg)] == ["[GPS] -33.510000, 151.000000", "[Make] Ab"]
    assert [t for _, t, _ in media.READERS[".nef"](tiff)] == ["[GPS] -33.510000, 151.000000", "[Make] Ab"]
    box = b"\0\0\0\x18ftypheic" + b"junk" * 5 + b"\0\0\0\6Exif\0\0" + tiff + b'<x:xmpmeta xmlns:x="x" xmlns:d="d"><d:headline>News</d:headline></x:xmpmeta>'
    assert [t for _, t, _ in media.READERS[".heic"](box)] == ["[GPS] -33.510000, 151.000000", "[Headline] News", "[Make] Ab"]
    assert [t for _, t, _ in media.READERS[".cr3"](b"\0\0\0\x50CMT1" + tiff)] == ["[GPS] -33.510000, 151.000000", "[Make] Ab"]
    webp = b"RIFF\0\0\0\0WEBP" + b"EXIF" + struct.pack("<I", len(tiff)) + tiff + b"\0" * (len(tiff) % 2) + b"XMP " + struct.pack("<I", len(packet)) + packet
    assert [t for _, t, _ in media.READERS[".webp"](webp)] == ["[GPS] -33.510000, 151.000000", "[Headline] News", "[Keywords] sea, sun", "[Make] Ab"]


def test_broken_files_give_no_units(spark, tmp_path):
    for name in ("a.pdf", "b.jpg", "c.png", "d.mp3", "e.flac", "f.mp4"):
        (tmp_path / name).write_bytes({"b.jpg": b"\xff\xd8\xff\xe1\0\x10Exif\0\0II", "c.png": b"\x89PNG\r\n\x1a\n\0\0\0\5zTXta\0\0xx", "f.mp4": b"\0\0\0\0moov"}.get(name, b"ID3\3\0\0\0\0\1\1\0"))
    from skerry.sources.files import list_files

    assert extract.units(list_files(spark, str(tmp_path))).count() == 0


def test_extended_attributes(tmp_path, monkeypatch):
    import plistlib

    held = {"user.xdg.tags": b"red, blue", "com.apple.metadata:_kMDItemUserTags": plistlib.dumps(["red\n6", "green"], fmt=plistlib.FMT_BINARY), "user.xdg.comment": b"note"}

    def get(path, name):
        if name not in held:
            raise OSError(name)
        return held[name]

    monkeypatch.setattr("os.getxattr", get)
    assert [t for _, t, _ in extract.attributes("x")] == ["[Tags] red", "[Tags] blue", "[Tags] green", "[Comment] note"]
    monkeypatch.undo()
    assert list(extract.attributes(str(tmp_path / "none"))) == []
