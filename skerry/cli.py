"""Search a folder from the command line: python -m skerry.cli QUERY [PATH].

Ends with 0 if something matched, 1 if nothing did, 2 for wrong usage."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from .operators import output, units
from .operators.file_search import Pictures, search_files
from .operators.matchers import use_encoder
from .plans.query import FileQueryParseError, display_query, parse_file_query
from .sources.extract import OCR_BYTES, SPEECH_BYTES, Ports
from .sources.files import WalkOptions


def _share(text: str) -> float:
    value = float(text.rstrip("%")) / (100 if text.endswith("%") else 1)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a share from 0 to 1, or a percentage, is needed")
    return value


def _positive(text: str) -> int:
    if (value := int(text)) < 1:
        raise argparse.ArgumentTypeError("a number above 0 is needed")
    return value


def _named(text: str) -> object:
    """What module:name names: where OCR, speech, encoders come from."""
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skerry")
    p.add_argument("query")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--threshold", type=_share, default=units.THRESHOLD)
    p.add_argument("--max-file-size", type=int, default=100 << 20, help="bytes; 0 and less: no limit")
    p.add_argument("--max-matches", "--max-line-matches", type=_positive, default=50, help="lines of a file")
    p.add_argument("--limit", type=_positive, help="files")
    p.add_argument("--format", choices=("grouped", "flat"), default="grouped")
    p.add_argument("--json", action="store_true")
    p.add_argument("-o", "--output", help="file to write to as well")
    p.add_argument("--output-folder", help="folder to write to in place of the screen, by the tasks")
    for name, what in (("semantic", "an encoder of texts"), ("semantic-image", "Pictures"), ("ocr", "a function from a picture's bytes to its writing"), ("transcribe", "a function from a sound's bytes to (second, text)")):
        p.add_argument(f"--{name}", type=_named, metavar="MODULE:NAME", help=what)
    p.add_argument("--semantic-image-threshold", type=_share, default=units.PREVIEW_THRESHOLD)
    p.add_argument("--transcribe-threshold", type=_share, default=units.TRANSCRIPT_THRESHOLD)
    p.add_argument("--max-ocr-file-size", type=int, default=OCR_BYTES)
    p.add_argument("--max-transcribe-file-size", type=int, default=SPEECH_BYTES)
    only = p.add_mutually_exclusive_group()
    only.add_argument("--names-only", action="store_true")
    only.add_argument("--content-only", action="store_true")
    yes = argparse.BooleanOptionalAction
    p.add_argument("--names", action=yes, default=True, help="search names")
    p.add_argument("--content", action=yes, default=True, help="search contents")
    p.add_argument("--docs-tags", action=yes, default=True, help="search documents, text and tags")
    p.add_argument("--include-hidden", action="store_true")
    p.add_argument("--include-noise", action="store_true", help="noise folders")
    p.add_argument("--include-noise-files", action="store_true")
    p.add_argument("--match-skipped-names", action="store_true")
    p.add_argument("--include-archives", action=yes, default=False)
    p.add_argument("--include-subdirectories", action=yes, default=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        q = parse_file_query(a.query)
    except FileQueryParseError as e:
        print(f"error: invalid query: {e}", file=sys.stderr)
        return 2
    names, contents = (a.names_only or a.names and not a.content_only), (a.content_only or a.content and not a.names_only)
    options = WalkOptions(not a.include_hidden, not a.include_noise, not a.include_noise_files, a.match_skipped_names, a.include_archives, a.include_subdirectories)
    ports = Ports(ocr=a.ocr, speech=a.transcribe, ocr_bytes=a.max_ocr_file_size, speech_bytes=a.max_transcribe_file_size)
    spark = spark or SparkSession.builder.appName("skerry").getOrCreate()
    use_encoder(a.semantic)
    try:
        found = search_files(
            spark, os.path.expanduser(a.path), q, names=names, contents=contents, docs_tags=a.docs_tags, ocr=a.ocr is not None, transcribe=a.transcribe is not None,
            pictures=a.semantic_image if isinstance(a.semantic_image, Pictures) else None, threshold=a.threshold, picture_threshold=a.semantic_image_threshold,
            transcript_threshold=a.transcribe_threshold, limit=a.limit, max_matches=a.max_matches, max_file_bytes=a.max_file_size, options=options, ports=ports,
        )
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        use_encoder(None)
    if a.output_folder:
        output.write_results(found.results, q, a.output_folder, "json" if a.json else a.format)
        n = not spark.read.text(a.output_folder).isEmpty()
    else:
        n = _write(found.results, a, q)
    limits = {"ocr_too_large": a.max_ocr_file_size, "transcribe_too_large": a.max_transcribe_file_size}
    for s in found.skipped.toLocalIterator():
        print(output.skip_warning(s["path"], s["size_bytes"], s["reason"], limits.get(s["reason"], a.max_file_size)), file=sys.stderr)
    if not n:
        print(f'No matches for "{display_query(a.query)}" in {a.path}', file=sys.stderr)
    return 0 if n else 1


def _write(results, a: argparse.Namespace, q) -> int:
    """Results to the screen and the file, one after the other; how many there were."""
    form = "json" if a.json else a.format
    rows = {"json": lambda: output.json_rows(results, q).select("json"), "grouped": lambda: output.text_blocks(results, q).select("block"), "flat": lambda: output.flat_lines(results).select("flat")}[form]()
    sinks = [sys.stdout, *([open(a.output, "w", encoding="utf-8")] if a.output else [])]
    tell = lambda text: [print(text, file=s) for s in sinks]
    n = 0
    try:
        if form == "grouped" and (total := results.count()):
            tell(output.summary(total, a.query))
        for n, row in enumerate(rows.toLocalIterator(), 1):
            tell((("[" if n == 1 else ",") if form == "json" else "") + row[0] if form != "grouped" or n == 1 else "\n" + row[0])
        if form == "json":
            tell("]" if n else "[]")
    finally:
        for s in sinks[1:]:
            s.close()
    return n


if __name__ == "__main__":
    sys.exit(main())
