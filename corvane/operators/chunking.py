"""Outline-aware chunking: sections by headings, long sections cut at blank lines, blocks kept whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.schemas import struct

TARGET = 800
#: White space that is trimmed, and that may follow a heading's marks.
STRIP = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
IN_LINE = "[^\n\r\u2028\u2029]"
FENCE = re.compile(rf" {{0,3}}(`{{3,}}|~{{3,}})({IN_LINE}*)")
HEADING = re.compile(rf"(#{{1,6}})[{STRIP}]+({IN_LINE}*)")
RESULT = T.ArrayType(struct("heading_path string, start_line int, end_line int, content string"))
_ARROW = pa.list_(pa.struct([("heading_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())]))


def open_lines(lines: list[str]) -> list[bool]:
    """For each line: does it stand outside all code and math blocks (their delimiters included)?"""
    opened, out = None, []  # what the open block is closed by: (fence character, least length) or "$$"
    for line in lines:
        fence = FENCE.fullmatch(line) if opened != "$$" else None
        closes = fence and opened and fence[1][0] == opened[0] and len(fence[1]) >= opened[1] and not fence[2].strip(STRIP)
        bare = line.strip(STRIP)
        if fence and (closes or opened is None):
            opened = None if closes else (fence[1][0], len(fence[1]))
            out.append(False)
        elif bare.startswith("$$") and opened in (None, "$$"):
            if len(bare) == 2 or not bare.endswith("$$"):
                opened = None if opened else "$$"
            out.append(False)
        else:
            out.append(opened is None)
    return out


def chunk_text(text: str, target: int = TARGET) -> list[dict]:
    """Chunks of one text, in order; lines count from 1, lengths in UTF-16 units."""
    lines = re.split(r"\r?\n", text)
    free = open_lines(lines)
    headings = [HEADING.fullmatch(x) if ok else None for x, ok in zip(lines, free, strict=True)]
    borders = [i for i, h in enumerate(headings) if h and i] + [len(lines)]
    chunks, trail, start = [], [], 0
    for border in borders:
        if own := headings[start]:
            trail = [t for t in trail if t[0] < len(own[1])] + [(len(own[1]), own[2].strip(STRIP))]
        path, at, size = " > ".join(t[1] for t in trail) if trail else "Root", start, 0
        for i in range(start, border):
            size += len(lines[i].encode("utf-16-le", "surrogatepass")) // 2 + 1
            blank = free[i] and not headings[i] and not lines[i].strip(STRIP)
            if i + 1 == border or (blank and size >= target):
                content = "\n".join(lines[at : i + 1]).strip(STRIP)
                if content:
                    chunks.append({"heading_path": path, "start_line": at + 1, "end_line": i + 1, "content": content})
                at, size = i + 1, 0
        start = border
    return chunks


def chunk(files: DataFrame, target: int = TARGET) -> DataFrame:
    """files(relative_path, content) to heading_path, start_line, end_line, content of each chunk.

    A null content has no chunks. Texts stream through Arrow batches; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk_text(t, target) if t is not None else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["relative_path", "chunks"])

    schema = T.StructType([T.StructField("relative_path", T.StringType()), T.StructField("chunks", RESULT)])
    return files.select("relative_path", "content").mapInArrow(run, schema).select("relative_path", F.inline("chunks"))
