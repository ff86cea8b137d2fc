"""Tags of pictures, sound and film, read from their containers without decoding."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

Unit = tuple[int, str, str]

# Tag numbers and field names, with the labels they are shown under.
EXIF = {
    270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution",
    305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright", 37510: "UserComment",
}
EXIF_FOLDER, GPS_FOLDER, XMP_TAG = 34665, 34853, 700
XP = {40091: "Title", 40092: "Comment", 40093: "Author", 40094: "Keywords"}
XMP = {
    "title": "Title", "description": "Description", "creator": "Creator", "subject": "Keywords", "headline": "Headline",
    "credit": "Credit", "source": "Source", "creatortool": "Software", "imagedescription": "ImageDescription",
}
ID3 = {
    "TIT2": "Title", "TPE1": "Artist", "TALB": "Album", "TCON": "Genre", "TDRC": "Date", "TYER": "Date",
    "TCOM": "Composer", "TIT1": "Grouping", "TPE2": "Albumartist", "TRCK": "Tracknumber",
}
MP4 = {
    b"\xa9nam": "Title", b"\xa9ART": "Artist", b"\xa9alb": "Album", b"\xa9gen": "Genre",
    b"\xa9day": "Date", b"\xa9cmt": "Comment", b"\xa9wrt": "Composer", b"\xa9grp": "Grouping",
}


def decimal_degrees(parts: list[float], reference: str) -> float:
    """Degrees, minutes and seconds as one number; south and west are negative."""
    d, m, s = (*parts, 0.0, 0.0, 0.0)[:3]
    return round((d + m / 60 + s / 3600) * (-1 if reference.upper() in ("S", "W") else 1), 6)


def _ifd(data: bytes, at: int, order: str) -> dict[int, object]:
    """One directory of a TIFF: text, bytes, or a list of numbers by tag."""
    sizes = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "s"), 9: (4, "i"), 10: (8, "ii")}
    found: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in sizes:
            continue
        width, code = sizes[kind]
        place = at + 10 + 12 * k
        if width * n > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        raw = data[place:place + width * n]
        if kind == 2:
            found[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (1, 7):
            found[tag] = raw
        else:
            numbers = struct.unpack(order + code * (len(raw) // width), raw[:len(raw) // width * width])
            found[tag] = [a / b if b else 0.0 for a, b in zip(numbers[::2], numbers[1::2], strict=True)] if len(code) == 2 else list(numbers)
    return found


def _shown(value: object) -> str:
    if isinstance(value, list):
        return ", ".join(f"{v:g}" for v in value)
    if isinstance(value, bytes):
        return re.sub(rb"^(ASCII|UNICODE|JIS)\0+", b"", value).decode("utf-8", "ignore").strip("\0 ")
    return str(value).strip()


def exif(data: bytes) -> dict[str, str]:
    """Tags of a TIFF, which is what EXIF is, and most raw pictures are."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    top = _ifd(data, struct.unpack_from(order + "I", data, 4)[0], order)
    inner = _ifd(data, top[EXIF_FOLDER][0], order) if EXIF_FOLDER in top else {}
    tags = {EXIF[t]: _shown(v) for t, v in {**top, **inner}.items() if t in EXIF}
    tags |= {XP[t]: v.decode("utf-16-le", "ignore").strip("\0 ") for t, v in top.items() if t in XP and isinstance(v, bytes)}
    if XMP_TAG in top and isinstance(top[XMP_TAG], bytes):
        tags = {**xmp(top[XMP_TAG]), **tags}
    if GPS_FOLDER in top:
        g = _ifd(data, top[GPS_FOLDER][0], order)
        if 2 in g and 4 in g:
            tags["GPS"] = f"{decimal_degrees(g[2], g.get(1, 'N')):.6f}, {decimal_degrees(g[4], g.get(3, 'E')):.6f}"
    return tags


def xmp(packet: bytes) -> dict[str, str]:
    """Known fields of an XMP packet, as elements or attributes; lists joined."""
    tags: dict[str, str] = {}
    for e in ElementTree.fromstring(packet[packet.index(b"<"):packet.rindex(b">") + 1]).iter():
        items = [(e.tag, ", ".join(t.strip() for t in e.itertext() if t.strip())), *e.attrib.items()]
        for name, value in items:
            local = name.rpartition("}")[2]
            label = XMP.get(local.lower()) if local != "Description" else None  # the element that holds the others
            if label and value.strip() and not re.match(r"(?i)xmp\.(iid|did):", value):
                tags.setdefault(label, value.strip())
    return tags


def jpeg(data: bytes) -> dict[str, str]:
    tags, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4:at + 2 + size]
        if body.startswith(b"Exif\0\0"):
            tags = {**tags, **exif(body[6:])}
        elif body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            tags = {**xmp(body[29:]), **tags}
        at += 2 + size
    return tags


def embedded(data: bytes) -> dict[str, str]:
    """Tags of a container that holds EXIF and XMP in boxes of its own (HEIC, CR3, RAF):
    the TIFF behind a known mark, and the XMP packet."""
    tags: dict[str, str] = {}
    for m in re.finditer(rb"(?:Exif\0\0|CMT[124])(?=II\*\0|MM\0\*)", data):
        tags = {**exif(data[m.end():]), **tags}
    if m := re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S):
        tags = {**xmp(m[0]), **tags}
    return tags


def png(data: bytes) -> dict[str, str]:
    tags, at = {}, 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        key, _, body = data[at + 8:at + 8 + size].partition(b"\0")
        name = key.decode("latin-1")
        if kind == b"tEXt":
            tags[name] = body.decode("latin-1")
        elif kind == b"zTXt":
            tags[name] = zlib.decompress(body[1:]).decode("latin-1")
        elif kind == b"iTXt":
            text = body[2:].split(b"\0", 2)[2]
            text = zlib.decompress(text) if body[:1] == b"\1" else text
            tags |= xmp(text) if name == "XML:com.adobe.xmp" else {name: text.decode("utf-8", "ignore")}
        elif kind == b"eXIf":
            tags |= exif(data[at + 8:at + 8 + size])
        at += 12 + size
    return tags


def webp(data: bytes) -> dict[str, str]:
    tags, at = {}, 12
    while data[:4] == b"RIFF" and at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8:at + 8 + size]
        if kind == b"EXIF":
            tags = {**tags, **exif(body.removeprefix(b"Exif\0\0"))}
        elif kind == b"XMP ":
            tags = {**xmp(body), **tags}
        at += 8 + size + size % 2
    return tags


def mp3(data: bytes) -> dict[str, str]:
    """Text frames of ID3v2.3 and 2.4."""
    def safe(b: bytes) -> int:
        return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]

    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or data[3] not in (3, 4):
        return tags
    at, end = 10, 10 + safe(data[6:10])
    while at + 10 <= min(end, len(data)) and data[at]:
        name = data[at:at + 4].decode("latin-1")
        size = safe(data[at + 4:at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4:at + 8], "big")
        body = data[at + 10:at + 10 + size]
        if name in ID3 and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "ignore")
            tags[ID3[name]] = ", ".join(t.strip() for t in text.split("\0") if t.strip())
        at += 10 + size
    return tags


def comments(data: bytes) -> dict[str, str]:
    """Vorbis comments: name=value, values of one name joined."""
    values: dict[str, list[str]] = {}
    f = io.BytesIO(data)
    number = lambda: struct.unpack("<I", f.read(4))[0]
    f.read(number())
    for _ in range(number()):
        key, _, value = f.read(number()).decode("utf-8", "ignore").partition("=")
        values.setdefault(key.replace("_", " ").title(), []).append(value)
    return {k: ", ".join(v) for k, v in values.items()}


def flac(data: bytes) -> dict[str, str]:
    tags: dict[str, str] = {}
    at, last = 4, False
    while not last and data[:4] == b"fLaC" and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1:at + 4], "big")
        if kind == 4:
            tags |= comments(data[at + 4:at + 4 + size])
        at += 4 + size
    return tags


def ogg(data: bytes) -> dict[str, str]:
    """The comment packet of the first stream, Vorbis or Opus: its second packet."""
    packets, held, at, stream = [], b"", 0, None
    while len(packets) < 2 and data[at:at + 4] == b"OggS":
        serial, n = data[at + 14:at + 18], data[at + 26]
        sizes, body = data[at + 27:at + 27 + n], at + 27 + n
        stream = serial if stream is None else stream
        for size in sizes:
            if serial == stream:
                held += data[body:body + size]
                if size < 255:
                    packets.append(held)
                    held = b""
            body += size
        at = body
    for mark in (b"\3vorbis", b"OpusTags"):
        if len(packets) > 1 and packets[1].startswith(mark):
            return comments(packets[1][len(mark):])
    return {}


def mp4(data: bytes) -> dict[str, str]:
    """Items of moov/udta/meta/ilst."""
    def boxes(a: int, b: int) -> Iterator[tuple[bytes, int, int]]:
        while a + 8 <= b:
            size, kind = struct.unpack_from(">I4s", data, a)
            head = 16 if size == 1 else 8
            size = struct.unpack_from(">Q", data, a + 8)[0] if size == 1 else size or b - a
            if size < head:
                return
            yield kind, a + head, min(b, a + size)
            a += size

    spans = [(0, len(data))]
    for name in (b"moov", b"udta", b"meta", b"ilst"):
        spans = [(x + 4 * (name == b"meta"), y) for s in spans for k, x, y in boxes(*s) if k == name]
    tags = {}
    for span in spans:
        for kind, a, b in boxes(*span):
            texts = [data[x + 8:y].decode("utf-8", "ignore") for k, x, y in boxes(a, b) if k == b"data"]
            if kind in MP4 and texts:
                tags[MP4[kind]] = ", ".join(texts)
    return tags


def _tags(read: Callable[[bytes], dict[str, str]]) -> Callable[[bytes], Iterator[Unit]]:
    def units(data: bytes) -> Iterator[Unit]:
        shown = sorted((k, v.strip()) for k, v in read(data).items() if v.strip())
        yield from ((i, f"[{k}] {v}", "tag") for i, (k, v) in enumerate(shown, 1))

    return units


# Suffixes of pictures that can be decoded, raw pictures, sound and film.
PICTURES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".heic", ".heif")
RAW = (".arw", ".cr2", ".cr3", ".dng", ".nef", ".nrw", ".orf", ".pef", ".raf", ".raw", ".rw2", ".srw")
SOUND = (".mp3", ".flac", ".ogg", ".oga", ".opus", ".m4a", ".aac")
FILM = (".mp4", ".m4v", ".mov")
SUFFIXES = (*PICTURES, *RAW, *SOUND, *FILM)
_READ = {jpeg: (".jpg", ".jpeg"), png: (".png",), webp: (".webp",), embedded: (".heic", ".heif", ".cr3", ".raf"), exif: (".tif", ".tiff", *(s for s in RAW if s not in (".cr3", ".raf"))), mp3: (".mp3", ".aac"), flac: (".flac",), ogg: (".ogg", ".oga", ".opus"), mp4: (".m4a", *FILM)}
READERS = {s: _tags(lambda data: {}) for s in SUFFIXES} | {s: _tags(f) for f, suffixes in _READ.items() for s in suffixes}
