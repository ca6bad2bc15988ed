"""Table functions for SQL: a file's children, streams and strings as rows, for use after ``LATERAL``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import binary as B
from . import pdf


class ArchiveMembers:
    """``archive_members(content)``: (name, content) of the files in an archive, within its limits."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from ((m["name"], bytes(m["content"])) for m in B.members(content))


class PdfStreams:
    """``pdf_streams(content)``: (position, content) of a document's streams, inflated within one budget."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from enumerate(pdf.streams(bytes(content)[: B.PDF_BYTES], pdf.Budget()))


class PrintableStrings:
    """``printable_strings(content, most)``: (position, run) of the different runs of six or more printable characters, in order, ``most`` of them."""

    runs = re.compile(rb"[\x20-\x7e]{6,}")

    def eval(self, content: bytes, most: int) -> Iterator[tuple]:
        seen: dict[bytes, None] = {}
        for m in self.runs.finditer(bytes(content or b"")):
            if len(seen) >= most:
                break
            if m[0] not in seen:
                seen[m[0]] = None
                yield len(seen) - 1, m[0].decode("ascii")


TABLES = {
    "archive_members": (ArchiveMembers, "name string, content binary"),
    "pdf_streams": (PdfStreams, "position int, content binary"),
    "printable_strings": (PrintableStrings, "position int, run string"),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    for name, (maker, columns) in TABLES.items():
        spark.udtf.register(name, udtf(maker, returnType=columns))
