"""Text units of files: a reader for each kind of content, chosen by suffix.

``READERS`` maps a suffix to a function from bytes to (number, text, kind); more can
be given in ``Ports``, where a library for them is installed, and there too what
reads writing in pictures and speech in sound."""

from __future__ import annotations

import io
import os
import plistlib
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import archives, media, pdf

SNIFFED = 8192
UNITS = "file_id long, unit_ord int, line_number int, text string, location_kind string"
_UNITS = pa.schema([("file_id", pa.int64()), ("unit_ord", pa.int32()), ("line_number", pa.int32()), ("text", pa.string()), ("location_kind", pa.string())])
Unit = tuple[int, str, str]
#: Rows to a batch, so that a long file is never held as rows.
BATCH = 20_000

# Core and extended properties shown as tags, with their labels.
PROPERTIES = {
    "docProps/core.xml": {
        "creator": "Author", "lastModifiedBy": "Last saved by", "title": "Title", "subject": "Subject", "keywords": "Keywords", "description": "Description",
        "category": "Category", "contentStatus": "Content status",
    },
    "docProps/app.xml": {"Application": "Program name", "Company": "Company", "Manager": "Manager"},
}
# Limits of what is read for writing and speech, and of pictures within documents.
OCR_BYTES, SPEECH_BYTES, LEAST_PICTURE = 50 << 20, 500 << 20, 20_000
DOCUMENTS = (".pdf", ".docx", ".xlsx", ".pptx")
UNCOUNTED = ("tag", "ocr", "transcript")


#: What a word without a vowel, or with a long run of consonants, is not; and letters that
#: follow themselves three times.
_UNSAID = re.compile(r"^[b-df-hj-np-tv-z]+$|[b-df-hj-np-tv-xz]{6}|(.)\1\1")
_WORD = re.compile(r"[^\W\d_]{3,}")


def is_word(word: str) -> bool:
    """Whether letters can be said; what stands in for a word list.  One that is learned from
    the texts beside the pictures, ``lexicon.learn``, tells more."""
    return len(word) >= 4 and not _UNSAID.search(word.lower())


def reading(text: str, known: Callable[[str], bool] = is_word) -> tuple[int, int]:
    """Letters of a picture's writing in words that are known, and in others."""
    sure = other = 0
    for w in _WORD.findall(text):
        if known(w):
            sure += len(w)
        else:
            other += len(w)
    return sure, other


@dataclass(frozen=True)
class Ports:
    """What reads content.  readers: more readers by suffix.  ocr: the writing in a
    picture's bytes, or several readings of it, of which the best counts.  speech: (second, text) of a sound's or film's bytes.  Functions
    must pickle; they run in the workers."""

    readers: dict[str, Callable[[bytes], Iterator[Unit]]] = field(default_factory=dict)
    ocr: Callable[[bytes], str | list[str]] | None = None
    speech: Callable[[bytes], Iterable[tuple[int, str]]] | None = None
    ocr_bytes: int | None = OCR_BYTES
    speech_bytes: int | None = SPEECH_BYTES
    is_word: Callable[[str], bool] = is_word

    def _worth(self, text: str) -> int:
        sure, other = reading(text, self.is_word)
        return sure - other

    def writing(self, picture: bytes) -> str:
        """Writing in a picture: of several readings the one with the most letters in known
        words, less those in others.  None where fewer than half of them are known."""
        read = self.ocr(picture)
        text = max([read] if isinstance(read, str) else read, key=self._worth, default="")
        sure, other = reading(text, self.is_word)
        return text.strip() if sure and sure >= other else ""


def plain(data: bytes) -> Iterator[Unit]:
    """Lines, at universal newlines; none of content with a NUL byte at its start."""
    if b"\0" not in data[:SNIFFED]:
        parts = re.split("\r\n|\r|\n", data.decode("utf-8", "ignore"))
        yield from ((i, t, "line") for i, t in enumerate(parts[:-1] if not parts[-1] else parts, 1))


def member_lines(data: bytes) -> Iterator[Unit]:
    if b"\0" not in data[:SNIFFED]:
        yield from ((i, t, "line") for i, t in enumerate(data.decode("utf-8", "ignore").splitlines(), 1))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _text(e: ElementTree.Element, names: tuple[str, ...] = ("t",)) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _local(x) in names else marks.get(_local(x), "") for x in e.iter())


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(z: zipfile.ZipFile) -> Iterator[Unit]:
    """Paragraphs of the body; blank ones count but are left out."""
    body = next(_all(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    for i, p in enumerate((p for p in body if _local(p) == "p"), 1):
        if (t := _text(p)).strip():
            yield i, t, "paragraph"


def _related(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Part names by relationship id of a part."""
    folder, _, base = name.rpartition("/")
    where = f"{folder}/_rels/{base}.rels"
    found = ElementTree.fromstring(z.read(where)) if where in z.namelist() else ()
    return {r.get("Id"): (t[1:] if (t := r.get("Target", "")).startswith("/") else f"{folder}/{t}") for r in found}


def xlsx(z: zipfile.ZipFile) -> Iterator[Unit]:
    """Rows that are not empty, counted over all sheets in the workbook's order, led
    by the sheet's name.  A sheet is found by its relationship, else by its number."""
    shared = [_text(s) for s in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    related, numbered, at = _related(z, "xl/workbook.xml"), _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), 0
    for i, sheet in enumerate(_all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")):
        ids = [v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id"]
        name = next((related[x] for x in ids if x in related), numbered[i] if i < len(numbered) else "")
        for row in _all(ElementTree.fromstring(z.read(name)), "row") if name in z.namelist() else ():
            cells = []
            for c in _all(row, "c"):
                v = next(_all(c, "v"), None)
                value = _text(c) if c.get("t") == "inlineStr" else "" if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells += [value.strip()] if value.strip() else []
            if cells:
                at += 1
                yield at, f"[{sheet.get('name', '')}] {' '.join(cells)}", "row"


def pptx(z: zipfile.ZipFile, ports: Ports | None = None) -> Iterator[Unit]:
    """Slides; with ports the writing in a slide's pictures before it."""
    for i, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
        for target in _related(z, name).values() if ports else ():
            part = os.path.normpath(target)
            if part in z.namelist() and _is_picture(z, part) and (text := ports.writing(z.read(part))):
                yield i, text, "ocr"
        shapes = ("\n".join(_text(p) for p in _all(s, "p")) for s in _all(ElementTree.fromstring(z.read(name)), "txBody"))
        if t := " ".join(s for s in shapes if s.strip()):
            yield i, t, "slide"


def properties(z: zipfile.ZipFile) -> Iterator[Unit]:
    """Document properties as [Label] value, keywords one by one."""
    at = 0
    for name, labels in PROPERTIES.items():
        first: dict[str, str] = {}
        for e in ElementTree.fromstring(z.read(name)).iter() if name in z.namelist() else ():
            first.setdefault(_local(e), (e.text or "").strip())
        for field_, label in labels.items():
            value = first.get(field_, "")
            for v in re.split("[;,]", value) if label == "Keywords" else [value]:
                if v.strip():
                    at += 1
                    yield at, f"[{label}] {v.strip()}", "tag"


def _guarded(data: bytes) -> zipfile.ZipFile:
    """An office package; one over the limits of archives is not read."""
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > archives.MAX_ENTRIES or sum(i.file_size for i in z.infolist()) > archives.MAX_BYTES:
        raise zipfile.BadZipFile("over the limits of an archive")
    return z


def _office(body: Callable[[zipfile.ZipFile], Iterator[Unit]]) -> Callable[[bytes], Iterator[Unit]]:
    def read(data: bytes) -> Iterator[Unit]:
        with _guarded(data) as z:
            yield from body(z)

    return read


def _package_tags(data: bytes) -> Iterator[Unit]:
    with _guarded(data) as z:
        yield from properties(z)


def _is_picture(z: zipfile.ZipFile, name: str) -> bool:
    return "/media/" in name and os.path.splitext(name)[1].lower() in media.PICTURES and z.getinfo(name).file_size >= LEAST_PICTURE


def with_writing(suffix: str, data: bytes, ports: Ports) -> Iterator[Unit]:
    """A document's body and the writing in its pictures: by page or slide, else behind
    the body, numbered by name."""
    if suffix == ".pdf":
        yield from pdf.pages(data, ports.writing, LEAST_PICTURE)
        return
    with _guarded(data) as z:
        if suffix == ".pptx":
            yield from pptx(z, ports)
            return
        yield from (docx if suffix == ".docx" else xlsx)(z)
        for i, name in enumerate(sorted(n for n in z.namelist() if _is_picture(z, n)), 1):
            if text := ports.writing(z.read(name)):
                yield i, text, "ocr"


# Extended attributes that hold tags and comments.
TAG_ATTRIBUTES = ("user.xdg.tags", "user.dolphin.tags", "com.apple.metadata:_kMDItemUserTags")
COMMENT_ATTRIBUTES = ("user.xdg.comment", "com.apple.metadata:kMDItemFinderComment", "com.apple.metadata:kMDItemComment")


def _attribute(path: str, name: str) -> list[str]:
    """Texts of an attribute: a property list's strings without their colours, or one
    text; none where it is missing or cannot be had."""
    try:
        raw = os.getxattr(path, name)
        value = plistlib.loads(raw) if raw.startswith((b"bplist", b"<?xml")) else raw.decode("utf-8", "ignore")
    except (OSError, AttributeError, plistlib.InvalidFileException, ExpatError):
        return []
    texts = value if isinstance(value, list) else [value]
    return [str(t).split("\n")[0].strip("\0 ") for t in texts]


def attributes(path: str) -> Iterator[Unit]:
    """Tags of a file, each once, and its comments, from extended attributes."""
    tags = [t.strip() for name in TAG_ATTRIBUTES for text in _attribute(path, name) for t in text.split(",")]
    comments = [t for name in COMMENT_ATTRIBUTES for t in _attribute(path, name)]
    shown = [f"[{label}] {t}" for label, texts in (("Tags", tags), ("Comment", comments)) for t in dict.fromkeys(texts) if t]
    yield from ((i, t, "tag") for i, t in enumerate(shown, 1))


READERS: dict[str, Callable[[bytes], Iterator[Unit]]] = {".docx": _office(docx), ".xlsx": _office(xlsx), ".pptx": _office(pptx), ".pdf": pdf.pages, **media.READERS}
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, TypeError, StopIteration, RuntimeError, struct.error, zlib.error)


OFFICE = (".docx", ".xlsx", ".pptx")


def _read(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return b""


def plain_file(path: str) -> Iterator[Unit]:
    """As ``plain``, a line in memory at a time."""
    try:
        with open(path, "rb") as f:
            if b"\0" in f.read(SNIFFED):
                return
        with open(path, encoding="utf-8", errors="ignore") as f:  # universal newlines
            yield from ((i, t.removesuffix("\n"), "line") for i, t in enumerate(f, 1))
    except OSError:
        return


def _some(read: Callable[..., Iterator[Unit]], *args) -> Iterator[Unit]:
    """What a reader gives before it finds a fault."""
    try:
        yield from read(*args)
    except _BROKEN:
        return


@dataclass(frozen=True)
class Wanted:
    """Which surfaces of content are read, and how much of it."""

    docs_tags: bool = True
    ocr: bool = False
    transcribe: bool = False
    max_bytes: int | None = None

    def limit(self, suffix: str, ports: Ports) -> int | None:
        """The most bytes of a file of this kind: media have none, documents in which
        writing is read have that one's."""
        if self.max_bytes is None or self.max_bytes <= 0 or suffix in media.SUFFIXES:
            return None
        return ports.ocr_bytes if self.ocr and suffix in DOCUMENTS else self.max_bytes


def _surfaces(row: dict, ports: Ports, want: Wanted) -> Iterator[Unit]:
    """Units of one file in their order: body, writing, speech, then tags."""
    path, suffix, size = row["path"], row["suffix"], row["size_bytes"]
    chosen = {**READERS, **ports.readers}
    limit = want.limit(suffix, ports)
    fits = lambda most: most is None or size <= most
    if suffix in media.SUFFIXES:
        data = _read(path)
        if want.docs_tags:
            yield from _some(chosen[suffix], data)
        if want.ocr and suffix in media.PICTURES and fits(ports.ocr_bytes) and (text := ports.writing(data)):
            yield 1, text, "ocr"
        if want.transcribe and suffix in (*media.SOUND, *media.FILM) and fits(ports.speech_bytes):
            yield from ((int(at), text, "transcript") for at, text in ports.speech(data))
    elif fits(limit) and (want.docs_tags or want.ocr):
        read = chosen.get(suffix)
        data = _read(path) if read else b""
        if want.ocr and suffix in DOCUMENTS:
            yield from (u for u in _some(with_writing, suffix, data, ports) if want.docs_tags or u[2] == "ocr")
        elif want.docs_tags:
            yield from _some(read, data) if read else plain_file(path)
    if want.docs_tags:
        yield from attributes(path)
        if suffix in OFFICE and fits(limit):
            yield from _some(_package_tags, _read(path))


def _counted(found: Iterator[Unit], limit: int | None) -> Iterator[Unit]:
    """Units up to a limit of bytes of body text; what would go over it ends them."""
    total = 0
    for unit in found:
        if limit is not None and unit[2] not in UNCOUNTED:
            total += len(unit[1].encode("utf-8", "ignore"))
            if total > limit:
                return
        yield unit


def units(files: DataFrame, ports: Ports | dict | None = None, want: Wanted = Wanted(), with_archives: bool = True) -> DataFrame:
    """Units of files whose content may be read, with those of archives' members or
    without.  What cannot be parsed gives those units that come before the fault.  Tags
    follow the content.  An archive is read once for all of its members."""
    ports = ports if isinstance(ports, Ports) else Ports(readers=ports or {})
    if want.ocr and ports.ocr is None or want.transcribe and ports.speech is None:
        raise RuntimeError("writing in pictures and speech need a function for them in Ports")

    def batched(found: Iterator[tuple[dict, Iterator[Unit]]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, read in found:
            for i, (n, t, k) in enumerate(_counted(read, want.limit(row["suffix"], ports))):
                out.append((row["file_id"], i, n, t, k))
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _UNITS, strict=True)], schema=_UNITS)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _UNITS, strict=True)], schema=_UNITS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row, _surfaces(row, ports, want)) for b in batches for row in b.to_pylist())

    def of_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row, _some(member_lines, content)) for row, content in archives.each(batches))

    rows = files.where(~F.col("names_only")).select("file_id", "path", "suffix", "size_bytes", "archive", "member")
    found = rows.where(F.col("archive").isNull()).mapInArrow(own, UNITS)
    if not (with_archives and want.docs_tags):
        return found
    members = rows.where(F.col("archive").isNotNull())
    if want.max_bytes is not None and want.max_bytes > 0:
        members = members.where(F.coalesce(F.col("size_bytes") <= content_limit(want, ports), F.lit(True)))
    return found.unionByName(archives.grouped(members).mapInArrow(of_archives, UNITS))


def content_limit(want: Wanted, ports: Ports) -> Column:
    """The most bytes of a file or member, by its suffix; null where there is none."""
    by_limit: dict[int | None, list[str]] = {}
    for s in (*media.SUFFIXES, *DOCUMENTS):
        by_limit.setdefault(want.limit(s, ports), []).append(s)
    limit = F.lit(want.limit("", ports)).cast("long")
    for most, suffixes in by_limit.items():
        limit = F.when(F.col("suffix").isin(*suffixes), F.lit(most).cast("long")).otherwise(limit)
    return limit


def skips(files: DataFrame, ports: Ports, want: Wanted) -> tuple[DataFrame, DataFrame]:
    """``files`` with those flagged ``names_only`` whose content is over its limit and of
    which nothing else can be read; and (path, size_bytes, reason) of what is not read.
    Empty files always pass; tags of a long file are still read where it has any."""
    if not (want.max_bytes or want.ocr or want.transcribe):
        return files, files.sparkSession.createDataFrame([], "path string, size_bytes long, reason string")
    suffix, size, alone = F.col("suffix"), F.col("size_bytes"), F.col("archive").isNull()
    limit = content_limit(want, ports)
    over = F.lit(want.docs_tags) & F.coalesce(size > limit, F.lit(False)) & ~F.col("names_only")

    def bare(paths):
        return paths.map(lambda p: next(attributes(p), None) is None)

    body = files.where(over)
    if not (want.ocr or want.transcribe):
        has_tags = F.pandas_udf(bare, "boolean")
        body = body.where(~alone | has_tags(F.col("path")))
        marked = files.join(body.select("file_id", F.lit(True).alias("_over")), "file_id", "left")
        flagged = marked.withColumn("names_only", F.col("names_only") | F.coalesce("_over", F.lit(False))).drop("_over") if want.max_bytes else files
        told = body.select("path", "size_bytes", F.lit("oversized").alias("reason"))
    else:
        flagged, told = files, files.limit(0).select("path", "size_bytes", F.lit("oversized").alias("reason"))
    for active, kinds, most, reason in ((want.ocr, media.PICTURES, ports.ocr_bytes, "ocr_too_large"), (want.transcribe, (*media.SOUND, *media.FILM), ports.speech_bytes, "transcribe_too_large")):
        if active and most is not None:
            told = told.unionByName(files.where(alone & suffix.isin(*kinds) & (size > most) & ~F.col("names_only")).select("path", "size_bytes", F.lit(reason).alias("reason")))
    return flagged, told
