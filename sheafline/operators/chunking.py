"""Cutting documents into chunks.

Blocks of one heading are packed up to `size` signs; longer ones are cut at paragraphs, then
sentences, then lines, then by a moving window.  What follows a cut repeats the last `overlap`
signs before it.  Parts under `least` signs join the chunk before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signs of a chunk, of its overlap, and of the least part.
SIZE, OVERLAP, LEAST = 1400, 200, 60
# Where a text may be cut.
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+(?=[A-Z0-9(\[\"'])")


def _pack(pieces: Sequence[str], size: int, overlap: int, glue: str) -> Iterator[str]:
    """Joins pieces while they fit; a piece that does not fit opens the next part."""
    held = ""
    for p in pieces:
        if held and len(held) + len(glue) + len(p) > size:
            yield held.strip()
            tail = held[-overlap:] if overlap else ""
            held = f"{tail}{glue}{p}" if tail else p
        else:
            held = f"{held}{glue}{p}" if held else p
    if held.strip():
        yield held.strip()


def cut_paragraph(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """A paragraph that is too long."""
    for cut in (_SENTENCE.split, lambda t: t.split("\n")):
        pieces = [p for p in cut(text) if p.strip()]
        if len(pieces) > 1:
            return list(_pack(pieces, size, overlap, " "))
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    step = max(1, size - overlap)
    return [text[i : i + size] for i in range(0, len(text), step)]


def cut_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    if len(text) <= size:
        return [text]
    out: list[str] = []
    run: list[str] = []
    for p in filter(None, (x.strip() for x in _PARAGRAPH.split(text))):
        if len(p) <= size:
            run.append(p)
            continue
        # A long paragraph stands for itself; the short ones before it are packed on their own.
        out += _pack(run, size, overlap, "\n\n")
        run = []
        out += cut_paragraph(p, size, overlap)
    return out + list(_pack(run, size, overlap, "\n\n"))


def chunk_blocks(blocks: Sequence[tuple[str, str, str]], size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, str, str]]:
    """(text, loc, heading) chunks of blocks (text, loc, heading) of one document, in order."""
    packed: list[list[str]] = []
    for text, loc, head in blocks:
        if not text or not text.strip():
            continue
        last = packed[-1] if packed else None
        if last and last[2] == (head or "") and len(last[0]) + len(text) + 2 <= size:
            last[0] += "\n\n" + text
            if loc and loc not in last[1]:
                last[1] = f"{last[1]}, {loc}" if last[1] else loc
        else:
            packed.append([text, loc or "", head or ""])
    out: list[list[str]] = []
    for text, loc, head in packed:
        for part in cut_text(text, size, overlap):
            if len(part) >= least:
                out.append([part, loc, head])
            elif out and out[-1][2] == head:
                out[-1][0] += "\n" + part
    return [tuple(x) for x in out]


def chunk_documents(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(path, ord, text, loc, heading) of blocks (path, block, text, loc, heading).

    A document's blocks meet in one task, as the cut depends on what came before; that is
    bounded by the size of a file, never by the corpus.
    """

    doc = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "text", "loc", "heading"))).alias("x"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, x in zip(pdf["path"], pdf["x"]):
                got = chunk_blocks([(b["text"], b["loc"], b["heading"]) for b in x], size, overlap, least)
                out += [(path, i, t, loc, h) for i, (t, loc, h) in enumerate(got)]
            yield pd.DataFrame(out, columns=["path", "ord", "text", "loc", "heading"])

    return doc.mapInPandas(run, "path string, ord long, text string, loc string, heading string")
