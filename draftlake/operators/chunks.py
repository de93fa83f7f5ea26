"""Texts cut to chunks along a hierarchy of separators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of prose, from the widest cut to the narrowest.
PROSE = ("\n\n", "\n", "[。！？]", r"[.!?]\s", r"；|;\s", r"，|,\s")
#: Separators of plain text; the last one cuts between any two characters.
PLAIN = ("\n\n", "\n", " ", "")
PART = 1 << 20  # bytes of texts whose chunks are held at once


def _pieces(text: str, start: int, end: int, mark: re.Pattern, before: bool) -> Iterator[tuple[int, int]]:
    """The parts of text[start:end] between separators, each of which stays at the end of its part or at the start of the next."""
    at = start
    for m in mark.finditer(text, start, end):
        cut = m.start() if before else m.end()
        if cut > at:
            yield at, cut
            at = cut
    if at < end:
        yield at, end


def _packed(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring pieces joined to spans of at most size, each beginning with those last pieces of the one before that overlap allows."""
    queue: deque[tuple[int, int]] = deque()
    for start, end in pieces:
        if queue and end - queue[0][0] > size:
            yield queue[0][0], queue[-1][1]
            while queue and (queue[-1][1] - queue[0][0] > overlap or end - queue[0][0] > size):
                queue.popleft()
        queue.append((start, end))
    if queue:
        yield queue[0][0], queue[-1][1]


def chunk_spans(text: str, size: int, overlap: int, marks: list[re.Pattern], before: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of text in order, none over size unless no separator is left in it.

    Work is a list of spans to cut and of runs of pieces to pack.  A span is cut at the first separator of the hierarchy
    that it holds; of its pieces those of size or more are cut again by the separators behind that one, the runs between them packed.
    """
    todo: list[tuple[list[tuple[int, int]], int | None]] = [([(0, len(text))], 0)]
    while todo:
        spans, level = todo.pop()
        if level is None:
            yield from _packed(spans, size, overlap)
            continue
        start, end = spans[0]
        at = next((k for k in range(level, len(marks)) if marks[k].search(text, start, end)), None)
        pieces = [(start, end)] if at is None else list(_pieces(text, start, end, marks[at], before))
        after = len(marks) if at is None else at + 1
        found: list[tuple[list[tuple[int, int]], int | None]] = []
        run: list[tuple[int, int]] = []
        for p in pieces:
            if p[1] - p[0] < size:
                run.append(p)
                continue
            if run:
                found.append((run, None))
                run = []
            # Without a separator left the piece stays as it is.
            found.append(([p], after) if after < len(marks) else ([p], None))
        if run:
            found.append((run, None))
        todo += reversed(found)


def cut(text: str | None, size: int, overlap: int, marks: list[re.Pattern], before: bool = False, squeeze: bool = True) -> list[str] | None:
    """The chunks of a text, trimmed, none empty; runs of line feeds become one if squeeze."""
    if text is None:
        return None
    found = (text[a:b].strip() for a, b in chunk_spans(text, size, overlap, marks, before))
    return [re.sub(r"\n{2,}", "\n", c) if squeeze else c for c in found if c]


def chunks(text: Column, size: int, overlap: int, separators: tuple[str, ...] = PROSE, before: bool = False, squeeze: bool = True) -> Column:
    """Chunks of a text column as an array; null stays null, blank texts give an empty one.

    The queue of pieces that makes the overlap has no form in SQL functions that is not quadratic in the pieces, so texts are cut in
    Arrow batches; of these only the chunks of PART bytes of text, or of one text, are held at a time.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    marks = [re.compile(s) for s in separators]

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start, end in parts(texts):
                found = [cut(t.as_py(), size, overlap, marks, before, squeeze) for t in texts.slice(start, end - start)]
                yield pa.array(found, pa.list_(pa.string()))

    return run(text)


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places at which texts are parted, so that no part has more than PART bytes unless it is one text."""
    start = held = 0
    for n, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held + size > PART and n > start:
            yield start, n
            start, held = n, 0
        held += size
    yield start, len(texts)
