"""Chunkers: sections, recursive splits, overlap, semantic boundaries.

The text algorithms are plain functions; ``explode_pieces`` runs any of them
over a table in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\r\f"
#: Separators of the recursive splitter, strongest first.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", ", ", " ")
MIN_WORDS = 7


@dataclass(frozen=True)
class Section:
    title: str
    content: str
    level: int
    page: int


_PAGE = re.compile(r"<!-- Page (\d+) -->")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_BOLD = re.compile(r"^\*\*([^*]+)\*\*:?\s*(.*)$")
_COLON = re.compile(r"^([A-Z][a-zA-Z\s]+):\s+(.+)$")
_ITALIC = re.compile(r"^_([^_]+)_\s*(.*)$")
_TABLE = re.compile(r"(?:table|tbl\.)\s+\d", re.I)
_BORDER = re.compile(r"\+[-=]{2,}")
_FIGURE = re.compile(r"figure|fig\.|image|chart|graph", re.I)
_CAPTION_GOES_ON = re.compile(r"^(?:\||\d+\.|\()")
_NUMERIC = re.compile(r"^\d+$")
_REFERENCES = re.compile(r"reference|bibliography|works cited", re.I)


def is_table_line(line: str) -> bool:
    return bool(_TABLE.search(line) or line.lstrip().startswith("|") or _BORDER.search(line) or line.count("|") >= 3 or "Table" in line or "TABLE" in line)


def is_figure_line(line: str) -> bool:
    return bool(_FIGURE.search(line))


class _Reader:
    """State of the section extraction over one document's lines."""

    def __init__(self) -> None:
        self.done: list[Section] = []
        self.title: str | None = None
        self.level = 0
        self.body: list[str] = []
        self.page = 0
        self.main: tuple[str, int] | None = None

    def close(self, merge: bool = False) -> None:
        """End the open section; it is kept if it has enough words. ``merge`` joins it to an earlier one of its title and level."""
        text = "\n".join(self.body).strip()
        self.body = []
        if self.title is None or len(text.split()) < MIN_WORDS:
            return
        if merge:
            for i, s in enumerate(self.done):
                if (s.title, s.level) == (self.title, self.level):
                    self.done[i] = replace(s, content=f"{s.content}\n\n{text}")
                    return
        self.done.append(Section(self.title, text, self.level, self.page))

    def open(self, title: str, level: int) -> None:
        if _NUMERIC.match(title):  # a number is no heading: what follows belongs to nothing yet
            self.title = None
        else:
            self.title, self.level = title, level


def extract_sections(markdown: str) -> list[Section]:
    """Sections of a Markdown text.

    Page comments set the page; rules (-----) and the blank line behind them go;
    tables and figures, caption included, are dropped up to a blank line that
    is followed by plain text. Headings (#), bold or ``Name:`` lines open
    sections, italic lines open subsections "main - sub". Sections need seven
    words. A section's page is the page at its end. Without any section the
    whole text, figure and table lines left out, is one of level 0.
    """
    lines = markdown.split("\n")
    r = _Reader()
    in_figure = after_rule = False
    for i, line in enumerate(lines):
        bare = line.strip()
        if m := _PAGE.search(line):
            r.page = int(m[1]) - 1
            continue
        if bare == "-----":
            after_rule = True
            continue
        if after_rule and not bare:
            after_rule = False
            continue
        after_rule = False
        if is_table_line(line) or is_figure_line(line):
            in_figure = True
            continue
        if in_figure:
            nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
            if not bare and nxt and not is_table_line(nxt) and not is_figure_line(nxt) and not _CAPTION_GOES_ON.match(nxt):
                in_figure = False
            continue
        if m := _HEADING.match(line):
            r.close()
            level, title = len(m[1]), m[2].strip().strip("*_ ")
            r.open(title, level)
            if level <= 2:
                r.main = (title, level)
        elif m := _BOLD.match(line) or _COLON.match(line):
            r.close()
            title = m[1].strip().rstrip(":")
            r.open(title, 2)
            if m[2].strip():
                r.body.append(m[2].strip())
            if not title[:1].islower():
                r.main = (title, 2)
        elif (m := _ITALIC.match(line)) and r.main is not None and r.title is not None:
            r.close(merge=True)
            r.open(f"{r.main[0]} - {m[1].strip()}", r.main[1] + 1)
        else:
            r.body.append(line)
    r.close(merge=True)
    if r.done:
        return r.done
    kept = "\n".join(x for x in lines if not is_table_line(x) and not is_figure_line(x) and not _PAGE.search(x)).strip()
    return [Section("Document Title", kept, 0, 0)] if kept else []


def tidy_sections(sections: list[Section]) -> list[Section]:
    """Sections of one title joined; a main section's text put before its first subsection; references joined and last.

    Nothing is dropped: a main section without subsections stays as it is.
    """
    order: dict[str, Section] = {}
    for s in sections:
        have = order.get(s.title)
        order[s.title] = replace(have, content=f"{have.content}\n\n{s.content}") if have else s
    subs: dict[str, str] = {}
    for title in order:
        main, dash, _ = title.partition(" - ")
        if dash and main in order:
            subs.setdefault(main, title)
    for main, sub in subs.items():
        order[sub] = replace(order[sub], content=f"{order[main].content}\n\n{order[sub].content}")
        del order[main]
    refs = [s for s in order.values() if _REFERENCES.search(s.title)]
    rest = [s for s in order.values() if not _REFERENCES.search(s.title)]
    if refs:
        rest.append(replace(refs[0], title="References", content="\n\n".join(s.content for s in refs)))
    return rest


def recursive_split(text: str, limit: int = 1000) -> list[str]:
    """Pieces cut behind the last strongest separator that starts within the limit, without outer white space.

    A piece may exceed the limit by its separator. Without a separator the cut
    is at the next space within 20 characters, else hard. Iterative, so long
    texts need no stack.
    """
    out: list[str] = []
    start, end = 0, len(text)
    while end - start > limit:
        for sep in SEPARATORS:
            at = text.rfind(sep, start + 1, min(end, start + limit + len(sep)))
            if at > 0:
                cut = at + len(sep)
                break
        else:
            nxt = text.find(" ", start + limit, min(end, start + limit + 20))
            cut = nxt if nxt > 0 else start + limit
        out.append(text[start:cut].strip(SPACE))
        start = cut
        while start < end and text[start] in SPACE:
            start += 1
        while end > start and text[end - 1] in SPACE:
            end -= 1
    if start < end:
        out.append(text[start:end])
    return out


def add_overlap(pieces: list[str], size: int = 100) -> list[str]:
    """Every piece but the first with the end of the one before it, from its first whole word on."""
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:]):
        tail = before[-size:] if size else ""
        if tail and tail[0] not in SPACE:
            tail = tail[tail.find(" ") + 1 :] if " " in tail else ""
        out.append(tail + piece)
    return out


def window_split(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split by the first separator present, split what is still too long by the next ones, and merge up to ``size`` with overlap."""
    def split(part: str, level: int) -> list[str]:
        while level < len(separators) - 1 and separators[level] not in part:
            level += 1
        sep = separators[level]
        bits = part.split(sep) if sep else list(part)
        out: list[str] = []
        run: list[str] = []
        for bit in bits:
            if len(bit) <= size:
                run.append(bit)
                continue
            out += merge(run, sep)
            run = []
            out += split(bit, level + 1) if level + 1 < len(separators) else [bit]
        return out + merge(run, sep)

    def merge(bits: list[str], sep: str) -> list[str]:
        out: list[str] = []
        cur: list[str] = []
        total = 0
        for bit in bits:
            extra = len(bit) + (len(sep) if cur else 0)
            if cur and total + extra > size:
                out.append(sep.join(cur))
                while cur and (total > overlap or total + len(bit) + len(sep) > size):
                    total -= len(cur.pop(0)) + (len(sep) if cur else 0)
                extra = len(bit) + (len(sep) if cur else 0)
            cur.append(bit)
            total += extra
        if cur:
            out.append(sep.join(cur))
        return [x for x in (p.strip(SPACE) for p in out) if x]

    return split(text, 0)


#: Common English words that carry no topic.
STOP_WORDS = frozenset("a an and are as at be been but by can do for from had has have he her his how i if in into is it its may me more my no not of on or our out over she should so some such than that the their them then there these they this those to under up was we were what when where which while who will with would you your".split())
_TERM = re.compile(r"[^\W_]{2,}")


def split_sentences(text: str) -> list[str]:
    flat = " ".join(text.split())
    return [s for s in re.split(r"(?<=[.!?]) ", flat) if s]


def _tfidf(sentences: list[str]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of sentences over one and two words; the document itself is the corpus."""
    counts = []
    for s in sentences:
        terms = [w for w in _TERM.findall(s.lower()) if w not in STOP_WORDS]
        counts.append(Counter(terms + [f"{a} {b}" for a, b in zip(terms, terms[1:])]))
    df = Counter(t for c in counts for t in c)
    n = len(sentences)
    out = []
    for c in counts:
        v = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()} if size else {})
    return out


def adjacent_similarity(sentences: list[str]) -> list[float]:
    """Cosine of each sentence and the next."""
    v = _tfidf(sentences)
    return [sum(x * b.get(t, 0.0) for t, x in a.items()) for a, b in zip(v, v[1:])]


def semantic_split(text: str, threshold: float = 0.3, limit: int = 1000) -> list[str]:
    """Runs of sentences, ended where the next one is less similar than ``threshold`` or ``limit`` characters are reached.

    Runs that are too long are packed anew by sentence, over-long sentences by
    word. Texts of fewer than two sentences give nothing.
    """
    sentences = split_sentences(text)
    if len(sentences) < 2:
        return []
    runs: list[list[str]] = [[]]
    size = 0
    for s, near in zip(sentences, [*adjacent_similarity(sentences), 1.0]):
        runs[-1].append(s)
        size += len(s)
        if near < threshold or size >= limit:
            runs.append([])
            size = 0
    out: list[str] = []
    for run in runs:
        joined = " ".join(run)
        out += [joined] if len(joined) <= limit else _pack(run, limit)
    return [x for x in out if x]


def _pack(parts: list[str], limit: int) -> list[str]:
    out: list[str] = []
    cur: list[str] = []
    size = 0
    for p in parts:
        if len(p) > limit and " " in p:
            if cur:
                out.append(" ".join(cur))
                cur, size = [], 0
            out += _pack(p.split(" "), limit)
            continue
        if cur and size + len(p) > limit:
            out.append(" ".join(cur))
            cur, size = [], 0
        cur.append(p)
        size += len(p) + 1
    return [*out, *([" ".join(cur)] if cur else [])]


_PIECES = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("page", pa.int32())]))


def explode_pieces(docs: DataFrame, key: str, text: str, split: Callable[[str], list]) -> DataFrame:
    """One row per piece: (key, chunk_index, total_chunks, title, content, section_level, page_number, words, chars).

    ``split`` gives strings or Sections. Null texts and texts without pieces
    give no rows. Documents stay in their partition.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                rows.append([{"title": p.title, "content": p.content, "level": p.level, "page": p.page} if isinstance(p, Section) else {"title": None, "content": p, "level": None, "page": None} for p in split(t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _PIECES)], names=["k", "pieces"])

    parts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInArrow(run, f"k {kind}, pieces array<struct<title:string,content:string,level:int,page:int>>")
    flat = parts.select(F.col("k").alias(key), F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "p"))
    from tessella.functions.text import char_count, word_count

    return flat.select(
        key, "chunk_index", "total_chunks", F.col("p.title").alias("title"), F.col("p.content").alias("content"), F.col("p.level").alias("section_level"), F.col("p.page").alias("page_number"),
        word_count(F.col("p.content")).alias("words"), char_count(F.col("p.content")).alias("chars"),
    )
