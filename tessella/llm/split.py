"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.bloom import BloomFilter
from tessella.session import materialize

#: A token is a run of non-space and the space behind it.
_TOKEN = re.compile(r"\S+\s*|\s+")
#: What a token ends with, from the strongest boundary to the weakest.
_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}$")
_SENTENCE = re.compile(r"[.!?…]['\"”’»)\]]*\s+$")
LEVELS = ("paragraph", "line", "sentence", "clause", "word")


def boundaries(text: str) -> list[list[int]]:
    """Per level the sorted offsets behind which a piece may end; each level holds the stronger ones too.

    The offsets are prefix sums of the token lengths.
    """
    tokens = _TOKEN.findall(text)
    out: list[list[int]] = [[] for _ in LEVELS]
    for token, end in zip(tokens, accumulate(map(len, tokens))):
        if token[-1:].isspace():
            if "\n" in token:
                level = 0 if _PARAGRAPH.search(token) else 1
            elif _SENTENCE.search(token):
                level = 2
            else:
                level = 3 if token.rstrip()[-1:] in ",;:" else 4
            for k in range(level, 5):
                out[k].append(end)
    return out


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary kind) of pieces of at most ``limit`` code points.

    The pieces cover the text without gaps; each begins at most ``overlap``
    before the end of the one before it, at a word boundary where there is one.
    A piece ends at the strongest boundary in the second half of its room, else
    at the last boundary of any kind, else it is cut hard (never inside CRLF).
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    marks = boundaries(text)
    spans: list[tuple[int, int, str]] = []
    start = last = 0
    while True:
        if n - start <= limit:
            spans.append((start, n, "end"))
            return spans
        room = start + limit
        end, kind = 0, "hard"
        for floor in (max(last, start + limit // 2), last):
            for level, offsets in zip(LEVELS, marks):
                at = bisect_right(offsets, room) - 1
                if at >= 0 and offsets[at] > floor:
                    end, kind = offsets[at], level
                    break
            if end:
                break
        if not end:
            end = room
            if text[end - 1] == "\r" and text[end] == "\n" and end - 1 > last:
                end -= 1
        spans.append((start, end, kind))
        back = end - overlap
        at = bisect_left(marks[4], back)
        nxt = marks[4][at] if overlap and at < len(marks[4]) and marks[4][at] <= end else end
        if nxt == end and overlap and kind == "hard":
            nxt = back  # inside a run without boundaries the overlap is cut hard, too
        start, last = max(nxt, start + 1), end


_OUT = pa.schema([("chunk_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("overlap_chars", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())])


def _split(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for cid, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                spans, before = split_spans(text, limit, overlap), 0
                for k, (a, b, kind) in enumerate(spans):
                    rows.append((cid, k + 1, len(spans), a, b, max(0, before - a), kind, text[a:b] if with_text else None))
                    before = b
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return run


def split_oversized(chunks: DataFrame, limits: DataFrame, *, with_text: bool = True, max_limits: int = 10_000) -> DataFrame:
    """Pieces of the contents longer than the limit of their section level.

    chunks: (chunk_id, content, section_level); limits: (section_level,
    max_chars, overlap_chars). Rows: chunk_id, piece_no (from 1), n_pieces,
    start_char, end_char, overlap_chars, boundary, piece.

    A null section_level uses the entry for 0; a level without an entry has no
    limit. Null contents and contents within the limit give no rows. Of several
    rows of a chunk the one with the least content (by its bytes) is cut, so
    that the pieces of a chunk always belong together. Only ids met more than
    once, told by a filter, are shuffled with their contents to choose among
    them; all others are cut where they are read. The filter on the length
    runs on the JVM, so only oversized contents reach Python. ``limits`` is broadcast, after a check that it has at most
    ``max_limits`` rows.
    """
    small = limits.where("section_level is not null and max_chars >= 1").groupBy(F.col("section_level").alias("_level")).agg(F.min("max_chars").alias("_max"), F.min("overlap_chars").alias("_overlap"))
    if small.limit(max_limits + 1).count() <= max_limits:
        small = F.broadcast(small)
    over = (
        chunks.select("chunk_id", "content", F.coalesce("section_level", F.lit(0)).alias("_level"))
        .where("chunk_id is not null and content is not null")
        .join(small, "_level")
        .where(F.length("content") > F.col("_max"))
        .select("chunk_id", "content", "_max", F.coalesce("_overlap", F.lit(0)).alias("_overlap"))
    )
    schema = "chunk_id string, piece_no int, n_pieces int, start_char int, end_char int, overlap_chars int, boundary string, piece string"
    repeated = materialize(over.groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    probed = BloomFilter.build(repeated, "chunk_id").probe(over, "chunk_id", "_again")
    one = F.min(F.struct("content", "_max", "_overlap")).alias("m")
    chosen = probed.where("_again").groupBy("chunk_id").agg(one).select("chunk_id", "m.content", "m._max", "m._overlap")
    return probed.where("not _again").drop("_again", "_level").select(*chosen.columns).unionByName(chosen).mapInArrow(_split(with_text), schema)
