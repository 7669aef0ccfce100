"""Ordered outputs: BED, JSON arrays, sampled text. Results are small by then; rows stream through one writer."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F


def _write(path: str, lines: Iterable[str]) -> None:
    """Write lines beside the path, then move them there, so that a failure leaves no half of a file.

    The path may be any URI that the file systems of Arrow know.
    """
    system, inner = file_system(path)
    part = f"{inner}.part"
    try:
        with system.open_output_stream(part) as file:
            for line in lines:
                file.write(line.encode("utf-8"))
        system.move(part, inner)
    finally:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Counted:
    """Counts what passes through it."""

    def __init__(self):
        self.n = 0

    def __call__(self, rows: Iterable):
        for row in rows:
            self.n += 1
            yield row


def bed_lines(regions: DataFrame) -> DataFrame:
    """value: chrom, start, end, motif, irr_count with TABs between, in contig order."""
    ordered = regions.orderBy("tid", "start", "end", "motif")
    return ordered.select(F.concat_ws("\t", "chrom", "start", "end", "motif", "irr_count").alias("value"))


def write_bed(regions: DataFrame, path: str) -> int:
    """The number of lines written."""
    counted = Counted()
    _write(path, (r.value + "\n" for r in counted(bed_lines(regions).toLocalIterator())))
    return counted.n


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def write_json(rows: DataFrame, path: str) -> int:
    """Rows, in their order, as an indented array with sorted maps; [] without rows. Gives their number."""
    counted = Counted()

    def lines():
        first = True
        for row in counted(rows.toLocalIterator()):
            item = {k: dict(sorted(v.items())) if isinstance(v, dict) else v for k, v in _plain(row).items()}
            text = json.dumps(item, indent=2, ensure_ascii=False)
            yield ("[\n" if first else ",\n") + "\n".join("  " + x for x in text.split("\n"))
            first = False
        yield "[]" if first else "\n]"

    _write(path, lines())
    return counted.n


def write_lines(header: str | None, lines: DataFrame, path: str) -> int:
    """The number of lines after the header."""
    counted = Counted()

    def rows():
        if header is not None:
            yield header + "\n"
        for r in counted(lines.orderBy("line_no").toLocalIterator()):
            yield r.value + "\n"

    _write(path, rows())
    return counted.n
