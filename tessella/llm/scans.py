"""Noise in text from scanned pages: find its kinds and repair the text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.filters import MAX_BITS, KeyFilter, hashes
from tessella.llm.lexicon import Trie
from tessella.llm.shingles import Shingled
from tessella.operators.bloom import BloomFilter
from tessella.session import materialize

#: What is read (left) for what is printed (right), by shape.
CONFUSIONS = """
c e|e c|f t|t f|0 o|o 0|! i|! l|1 l|1 i|l i|i l|l 1|I l|| l|| i|5 s|s 5|¢ c|9 g|q g|g q|g 9|b h|h b|6 b|8 b|2 z|z 2|3 e|@ a|$ s|€ e|y v|v y|n u|u n|a o|o a|] j|j i
cl d|d cl|ii u|u ii|rn m|m rn|nn m|vv w|w vv|li h|h li|ri n|n ri|lc k|lo b|tl d|fi fi|1i h|l1 h|ci a
""".replace("\n", "|").replace("|| ", "|\x00 ").split("|")
PAIRS = {tuple(p.replace("\x00", "|").split(" ", 1)) for p in CONFUSIONS if " " in p}

#: Characters that stand for letters inside words only by misreading.
ODD = str.maketrans({"0": "o", "1": "l", "!": "i", "|": "l", "5": "s", "¢": "c", "9": "g", "6": "b", "2": "z", "8": "b", "@": "a", "$": "s", "€": "e", "3": "e", "ø": "o", "æ": "ae", "œ": "oe"})
_FOLD = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("ri", "n"))

#: Words of the vocabulary that one trie holds; larger vocabularies are asked trie by trie.
TRIE_WORDS = 200_000
#: Words that are passed over unasked: a common one that passed the filter by chance would drag along every text it is in.
COMMON = 20_000
#: Of the filter of answers while that is below its largest size; a word that passes by chance costs the reading of all its texts.
BITS_PER_KEY = 64
#: Longest words that are looked at (longer runs are no words).
LONGEST = 60

_HYPHENS = "-\xad‐¬"
_ROMAN = r"[ivxlc]{1,6}"
_NUMBER = rf"(?:[-–—~]\s*\d{{1,4}}\s*[-–—~]?|\d{{1,4}}|\[\d{{1,4}}\]|\(\d{{1,4}}\)|\d{{1,4}}\s*/\s*\d{{1,4}}|(?:page|pg\.?|p\.|seite|s\.|página|pág\.)\s*\d{{1,4}}(?:\s*(?:of|/|von|de|sur)\s*\d{{1,4}})?|[A-Z]-\d{{1,4}}|{_ROMAN})"
PAGE = re.compile(rf"\s*{_NUMBER}\s*", re.I)
_MARKED = r"(?:[-–—~]\s*\d{1,4}\s*[-–—~]|\[\d{1,4}\]|\d{1,4}\s*/\s*\d{1,4}|(?:page|pg\.?|p\.|seite|página|pág\.)\s*\d{1,4}(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?)"
_PAGE_HEAD, _PAGE_TAIL = re.compile(rf"{_MARKED}\s+(?=\S)", re.I), re.compile(rf"\s+{_MARKED}$", re.I)
_BARE = re.compile(r"\s*\d{1,4}\s*")
_SPLIT = re.compile(r"\s{2,}|\t|\s+\|\s+")
_ITEM = re.compile(r"\s*(?:[-*•·+>#|]|\d{1,3}[.)]\s|[a-z][.)]\s)")
_ENDS = re.compile(r"[.!?;:,…”\"')]$")
_SUSPENDED = frozenset("or and und oder et ou y o e bis sowie to".split())
_TITLE_HYPHEN = re.compile(rf"([^\W\d_]+)[{_HYPHENS}]\s+([a-zà-öø-ÿﬁ-ﬆ][^\W\d_]*)")
_LEADER = re.compile(rf"(?:\s*\.{{3,}}\s*|\s{{2,}}|\t+|\s*\n\s*)({_NUMBER})\s*$|\s+([-–—~]\s*\d{{1,4}}\s*[-–—~])\s*$", re.I)
_ODD_TOKEN = re.compile(r"[^\W\d_][0-9!|¢€][^\W\d_]|[¢øﬀ-ﬆ\xad]|vv|[^\W\d_][‐¬]$", re.I)
_BROKEN_LINE = re.compile(rf"[^\W\d_][{_HYPHENS}][ ]?\r?\n\s*[a-z]")
_HYPHEN_BREAK = re.compile(rf"[{_HYPHENS}]\s*[\r\n]")
_LOWER_WORD = re.compile(r"(?:^|\s)[a-zà-öø-ÿ][^\s\d]{3}")
_EDGE = ".,;:()[]{}\"“”„‘’'«»…?<>*_`~"
_CODE = re.compile(r"[A-Z0-9]{1,4}-\d+|[-+±~]?\d[\d.,:/%×x-]*[^\W\d_]{0,3}[\d%]?|\d+(?:st|nd|rd|th)", re.I)
_CODE_JVM = r"(?i)^(?:[A-Z0-9]{1,4}-[0-9]+|[-+±~]?[0-9][0-9.,:/%×x-]*\p{L}{0,3}[0-9%]?|[0-9]+(?:st|nd|rd|th))$"  # the same for the JVM
_HYPHENATED = re.compile(rf"[{_HYPHENS}]\s")
_LIGATURE = re.compile("[ﬀ-ﬆ]")
_BROKEN_WORD = re.compile(rf"(?<!\S)\S+[{_HYPHENS}][ ]?\r?\n(?:[^\n]*\n){{0,4}}?\s*[a-zà-öø-ÿﬁ-ﬆ]\S*")  # with page furniture between the parts


def core(token: str) -> str:
    """A token without the punctuation around it; "!" only where it ends a word."""
    if token.isalpha():
        return token
    token = token.strip(_EDGE).strip("-–—‐¬\xad").strip(_EDGE)
    return token[:-1] if token.endswith("!") and token[:-1].isalpha() else token


def ends_in_hyphen(text: str) -> bool:
    """Whether a line of the text ends in a letter and a hyphen."""
    return any(_ALPHA.match(text, m.start() - 1) for m in _HYPHEN_BREAK.finditer(text) if m.start())


@lru_cache(1 << 16)
def line_key(line: str) -> str:
    """What running headers have in common over pages: shape-alike letters folded, digits masked."""
    text = unicodedata.normalize("NFKC", line).casefold()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ø", "o")
    text = re.sub(r"\b[a-z]{1,3}-\d+\b|\d+(?:st|nd|rd|th)?\b|(?<=rev\. )\w+", "#", text)
    for a, b in _FOLD:
        text = text.replace(a, b)
    text = text.translate(_SHAPE)
    return re.sub(r"[^a-z#]+", " ", text).strip()


#: One letter for all that are misread as one another.
_SHAPE = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "¢": "c", "e": "c", "9": "g", "q": "g", "6": "b", "h": "b", "2": "z", "t": "f", "8": "b"})


def split_page(line: str) -> tuple[str, bool]:
    """(rest of the line, whether a page number stood beside it)."""
    parts = [p for p in _SPLIT.split(line.strip()) if p]
    if len(parts) > 1:
        rest = [p for p in parts if not PAGE.fullmatch(p)]
        if len(rest) < len(parts) and rest:
            return " ".join(rest), True
    text = line.strip()
    for pattern in (_PAGE_HEAD, _PAGE_TAIL):
        m = pattern.match(text) if pattern is _PAGE_HEAD else pattern.search(text)
        if m:
            return (text[m.end() :] if m.start() == 0 else text[: m.start()]).strip(), True
    return text, False


def may_be_header(text: str) -> bool:
    """A short line that is no sentence, no list item and no wrapped text by its case."""
    if not 6 <= len(text) <= 90 or _ITEM.match(text) or _ENDS.search(text):
        return False
    found = [w for w in re.split(r"[\s/,]+", text) if any(c.isalpha() for c in w)]
    if not 2 <= len(found) <= 12:
        return False
    long = [w for w in found if len(w) > 3]
    return bool(long) and (text.isupper() or text.islower() or all(w[0].isupper() or not w[0].isalpha() for w in long))


def foreign_lines(lines: list[str], lower: bool = True) -> Iterator[tuple[int, str, bool]]:
    """(line number, text without page number, page number beside it) of lines that may be page furniture.

    The text is empty for lines that hold nothing but a page number. Numbers
    among other numbers are a list, not page numbers. Without ``lower``, lines
    wholly in lower case are passed over.
    """
    for i, line in enumerate(lines):
        if len(line) > 100 or not line or line.isspace():
            continue
        if len(line) <= 28 and PAGE.fullmatch(line):
            if _BARE.fullmatch(line) and (_BARE.fullmatch(_beside(lines, i, -1)) or _BARE.fullmatch(_beside(lines, i, 1))):
                continue
            yield i, "", True
            continue
        if line.islower():
            if not lower:
                continue
        elif not line.isupper() and _LOWER_WORD.search(line):
            continue
        rest, page = split_page(line)
        if may_be_header(rest):
            yield i, rest, page


def _beside(lines: list[str], i: int, step: int) -> str:
    """The nearest line with text before or after line i, or an empty string."""
    i += step
    while 0 <= i < len(lines):
        if lines[i] and not lines[i].isspace():
            return lines[i]
        i += step
    return ""


class Answers:
    """What the tables say about one text's questions: known words, recurring headers, corrections and pairs of neighbours."""

    def __init__(self, found: list[tuple[str, list[str] | None]] = (), pairs: frozenset[int] = frozenset()) -> None:
        self.held = {k for k, _ in found}
        self.fixes = {k[1:]: v for k, v in found if k[0] == "f"}
        self.pairs = pairs

    def is_known(self, word: str) -> bool:
        return "k" + word in self.held

    def is_header(self, file: str | None, text: str) -> bool:
        return any("h" + k in self.held for k in header_keys(file, text))

    def corrections(self, token: str) -> list[str]:
        """The corrected forms of a token, the likeliest first; empty where it needs none."""
        if token.isalpha() and token.lower() not in self.fixes:
            return []
        inner = core(token)
        low = inner.lower()
        if low in self.fixes:
            return [token.replace(inner, in_case(inner, v)) for v in self.fixes[low]]
        if not _JOINT.search(inner) or self.is_known(low) or _CODE.fullmatch(inner):
            return []
        parts = re.split(r"([-‐/])", inner)
        good = "".join(in_case(x, self.fixes[x.lower()][0]) if x.lower() in self.fixes else x for x in parts)
        return [token.replace(inner, good)] if good != inner else []

    def choose(self, before: str, options: list[str], after: str) -> str:
        """Of corrections that are as near, the one that the corpus has beside its neighbours, then the commonest."""
        return max(options, key=lambda c: sum(p in self.pairs for p in pair_hashes(before, c, after)))


def token_keys(token: str) -> list[str]:
    """The questions that a token may need: corrections of its core and of the parts of a compound."""
    inner = core(token)
    if len(inner) > LONGEST:
        return []
    low = inner.lower()
    if low.isalpha():
        return [f"f{low}"] if len(low) > 2 else []
    if _CODE.fullmatch(low) and (len(low) < 4 or len(_DIGIT.findall(low)) != 1):
        return []
    parts = [p for p in re.split(r"[-‐/]", low) if len(p) > 2]
    return [f"f{low}", *(f"f{p}" for p in parts if p != low)] if len(low) > 2 else []


def header_keys(file: str | None, text: str) -> tuple[str, str]:
    key = line_key(text)
    return f"{file}\n{key}", "\n" + key


def pair_hashes(before: str, word: str, after: str) -> list[int]:
    """Hashes of a word with the one before and the one after it, as ``neighbours`` makes them of whole texts."""
    return Shingled([f"{core(a)} {core(b)}" for a, b in ((before, word), (word, after)) if a and b], 2).hashes.view(np.int64).tolist()


def in_case(word: str, good: str) -> str:
    """``good`` in the case of the misread word."""
    if word.isupper() and len(word) > 1:
        return good.upper()
    return good[0].upper() + good[1:] if word[0].isupper() or (not word[0].islower() and word[1:2].isupper()) else good


def confusable() -> dict[str, frozenset[str]]:
    """Per character read the characters that it may be printed as."""
    out: dict[str, set[str]] = {}
    for read, printed in PAIRS:
        if len(read) == len(printed) == 1:
            out.setdefault(read, set()).add(printed)
    return {c: frozenset(v) for c, v in out.items()}


_LONG_PAIRS = tuple(sorted((a, b) for a, b in PAIRS if max(len(a), len(b)) > 1))


def word_forms(word: str, most: int) -> set[str]:
    """A word as it may have been printed: odd characters resolved, and up to ``most`` confusions that join or part letters undone."""
    forms, last = {word, plain(word)}, {word}
    for _ in range(most):
        nxt = set()
        for w in last:
            for a, b in _LONG_PAIRS:
                at = w.find(a)
                while at >= 0:
                    nxt.add(w[:at] + b + w[at + len(a) :])
                    at = w.find(a, at + 1)
        last = nxt
        forms.update(plain(w) for w in nxt)
    return forms - {""}


def broken_words(lines: list[str], furniture: set[int]) -> set[tuple[str, str, str]]:
    """(left part, hyphen, right part) of all words that may be broken over these lines, with or without ``furniture`` lines between the parts."""
    out: set[tuple[str, str, str]] = set()
    ends = [i for i, line in enumerate(lines) if (t := line.rstrip())[-1:] and t[-1] in _HYPHENS and len(t) > 1 and t[-2].isalpha()]
    at_ends = set(ends)
    lefts: dict[int, set[str]] = {}
    for i in ends:
        body = lines[i].strip()
        own = {body[:-1].split()[-1]} | (lefts.get(i, set()) if len(body.split()) == 1 else set())
        for j in range(i + 1, len(lines)):
            if not lines[j].strip():
                continue
            right = lines[j].split()[0]
            out.update((left, body[-1], right) for left in own)
            if j in at_ends and len(lines[j].split()) == 1:  # the word goes on over a third line
                lefts.setdefault(j, set()).update(left + glue + right[:-1] for left in own for glue in ("", body[-1], "-"))
            if j not in furniture:
                break
    return out


def joined_forms(left: str, mark: str, right: str) -> list[str]:
    """What a broken word may read when joined."""
    return [left + right, f"{left}-{right}"] if mark in "-‐" else [left + right, left + mark + right, f"{left}-{right}"]


def known_keys(left: str, mark: str, right: str) -> list[str]:
    """The words whose being known decides how a broken word is joined."""
    a, b = core(left).lower(), core(right).lower()
    if not a or not b:
        return []
    last = re.split(r"[-‐]", a)[-1]
    return list(dict.fromkeys(f"k{w}" for w in (a + b, f"{a}-{b}", last + b, a, b)))


def plain(word: str) -> str:
    """Odd characters as the letters they stand for, ligatures and accents resolved."""
    word = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", word).translate(ODD))
    return "".join(c for c in word if not unicodedata.combining(c))


def misreading(read: str, printed: str, most: int = 3) -> int | None:
    """How many confusions turn ``printed`` into ``read``, or None if other edits or more than ``most`` are needed."""
    n, m = len(read), len(printed)
    if abs(n - m) > most:
        return None
    best = {(0, 0): 0}
    for i in range(n + 1):
        for j in range(m + 1):
            c = best.get((i, j))
            if c is None or c > most:
                continue
            if i < n and j < m and read[i] == printed[j]:
                if c < best.get((i + 1, j + 1), 99):
                    best[i + 1, j + 1] = c
            for a in (1, 2):
                for b in (1, 2):
                    x, y = read[i : i + a], printed[j : j + b]
                    if len(x) == a and len(y) == b and x != y and ((x, y) in PAIRS or (a == 1 and plain(x) == y)):
                        if c + 1 < best.get((i + a, j + b), 99):
                            best[i + a, j + b] = c + 1
    return best.get((n, m)) if (best.get((n, m)) or 0) <= most else None


#: Of a row of ``_counted``: what counts.
FILE_CONTENT, FILE_TITLE, TITLE, CONTENT = 1, 2, 4, 8
ALL = FILE_CONTENT | FILE_TITLE | TITLE | CONTENT


def _counted(chunks: DataFrame) -> DataFrame:
    """(title, content, file, how, copies): every text once for each thing it counts for.

    Contents met once are read where they are and count for everything. The
    others (told by a Bloom filter of their hashes, so a few more) are reduced:
    lines of a content count once per file and once overall, those of a title
    and its words once per (file, title, content) and (title, content), words
    of a content once. ``copies`` are the chunks that have the content.
    """
    id_ = F.col("chunk_id") if "chunk_id" in chunks.columns else F.monotonically_increasing_id().cast("string")
    rows = chunks.select(id_.alias("id"), "title", "content", "file", F.xxhash64(F.coalesce("content", F.lit(""))).alias("h"))
    repeated = materialize(rows.groupBy("h").count().where("count >= 2").select("h"))
    probed = BloomFilter.build(repeated, "h").probe(rows, "h", "again")
    once = probed.where("not again").select("title", "content", "file", F.lit(ALL).alias("how"), F.lit(1).cast("long").alias("copies"))
    texts = materialize(
        probed.where("again").select("id", "title", "content", "file").distinct()
        .groupBy("title", "content", "file").agg(F.count(F.lit(1)).alias("copies"))
    )
    none = F.lit(None).cast("string")
    parts = (
        (texts, FILE_TITLE), (texts.groupBy("title", "content").agg(F.lit(1).alias("copies")).withColumn("file", none), TITLE),
        (texts.groupBy("content", "file").agg(F.lit(1).alias("copies")).withColumn("title", none), FILE_CONTENT),
        (texts.groupBy("content").agg(F.min("title").alias("title"), F.sum("copies").alias("copies")).withColumn("file", none), CONTENT),
    )
    for df, how in parts:
        once = once.unionByName(df.select("title", "content", "file", F.lit(how).alias("how"), F.col("copies").cast("long").alias("copies")))
    return once


def _words_and_lines(batches):
    """Of rows of ``_counted``: ('w', word, count in texts without and with symptoms, count in all copies), ('l', file + line key or line key, count) and ('t', totals of 'w').

    Parts of compounds, words with digits in them and joined forms of broken
    words don't count as words, but come out as 'w' with zeros, so that their
    corrections are looked up as well.
    """
    raw: Counter[str] = Counter()
    noisy: Counter[str] = Counter()
    more: Counter[str] = Counter()
    lines: Counter[str] = Counter()
    seen: set[str] = set()
    odd: set[str] = set()
    asked: set[str] = set()  # words that may need an answer though they don't count themselves

    def symptoms(tokens: list[str]) -> bool:
        if not seen.issuperset(tokens):
            new = set(tokens) - seen
            odd.update(t for t in new if len(t) < 60 and _ODD_TOKEN.search(t))
            seen.update(new)
        return not odd.isdisjoint(tokens)

    def flush():
        words: tuple[Counter[str], ...] = (Counter(), Counter(), Counter())
        for found, tokens in zip(words, (raw, noisy, more)):
            for token, n in tokens.items():
                w = core(token).lower()
                if len(w) > 1 and not _DIGIT.search(w):
                    found[w] += n
                    if len(w) > 3 and not w.isalpha():
                        asked.update(k[1:] for k in token_keys(token))
                elif len(w) > 2 and _ALPHA.search(w):
                    asked.update(k[1:] for k in token_keys(token))
            tokens.clear()
        clean, scanned, extra = words
        rows = [("w", w, clean[w], scanned[w], clean[w] + scanned[w] + extra[w]) for w in clean.keys() | scanned.keys()] + [("l", k, n, 0, 0) for k, n in lines.items()]
        rows += [("w", w, 0, 0, 0) for w in asked - clean.keys() - scanned.keys()]
        asked.clear()
        rows.append(("t", "", *(sum(c.values()) for c in (clean, scanned)), sum(r[4] for r in rows)))
        lines.clear()
        seen.clear()
        odd.clear()
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "key", "n", "noisy", "stored"])

    for batch in batches:
        for title, content, file, how, copies in zip(*(c.to_pylist() for c in batch.columns)):
            keys = set()
            heading = title.split() if title else []
            scanned = bool(title) and ("\n" in title or symptoms(heading))
            if content:
                if "\n" in content:
                    rows = text_lines(content)
                    found = list(foreign_lines(rows, lower=(broken := ends_in_hyphen(content))))
                    for _, text, page in found:
                        if text and not text.islower():
                            keys.add(line_key(text))
                        scanned = scanned or page
                    scanned = scanned or ("-\n" in content and bool(_BROKEN_LINE.search(content)))
                    for parts in broken_words(rows, {i for i, _, _ in found}) if broken else ():
                        asked.update(k[1:] for form in joined_forms(*parts) for k in token_keys(form))
                tokens = content.split()
                scanned = symptoms(tokens) or scanned
                if how & CONTENT:
                    if scanned and "\n" in content:
                        tokens = _BROKEN_WORD.sub(" ", content).split()
                    (noisy if scanned else raw).update(tokens)
                    if copies > 1:
                        for token in tokens:
                            more[token] += copies - 1
            above = set()
            if title:
                above.update(line_key(p) for p in title_parts(title) if may_be_header(p) and not p.islower())
                if _HYPHENATED.search(title):
                    for m in _TITLE_HYPHEN.finditer(title):
                        asked.update(k[1:] for form in joined_forms(m[1], m[0][len(m[1])], m[2]) for k in token_keys(form))
                if how & TITLE:
                    (noisy if scanned else raw).update(_TITLE_HYPHEN.sub(" ", title).split() if _HYPHENATED.search(title) else heading)
            for bits, found in (((FILE_CONTENT, CONTENT), keys), ((FILE_TITLE, TITLE), above - keys)):
                for k in found:
                    if how & bits[0]:
                        lines[f"{file}\n{k}"] += 1
                    if how & bits[1]:
                        lines["\n" + k] += 1
        if len(raw) + len(noisy) + len(lines) + len(seen) + len(asked) > 600_000:
            yield flush()
    yield flush()


def title_parts(title: str) -> list[str]:
    """The parts of a title that may be a running header: what is before a line end or |, and in parentheses at its end."""
    if "\n" not in title and "|" not in title and not title.rstrip().endswith(")"):
        return []
    parts = [p.strip() for p in re.split(r"\n|\s\|\s", title)]
    inner = re.search(r"\(([^()]*)\)\s*$", title)
    out = parts[:1] if len(parts) > 1 and not PAGE.fullmatch(parts[1]) and parts[0][-1:] not in tuple(_HYPHENS) else []
    return [split_page(p)[0] for p in [*out, *([inner[1].strip()] if inner else [])] if p]


@dataclass
class Tables:
    """What is known of the corpus, in written tables: every question is answered by an equi-join with them."""

    vocabulary: DataFrame  # (key, n): the words that are corrections
    answers: DataFrame  # (key, options): 'k' + known word, 'h' + header line, 'f' + word with its corrections
    filter: KeyFilter  # of the answers' keys
    common: frozenset[str]  # words of which it is known that they have no correction, the commonest


def fit(chunks: DataFrame, *, suspect_ratio: int = 200, trie_words: int = TRIE_WORDS, filter_bits: int = MAX_BITS) -> Tables:
    """Tables of words and lines of (title, content, file) rows, counted per task before the shuffle.

    Copies of a text count once (see ``_counted``); with a column ``chunk_id``
    a repeated row counts as one copy. Sure are words met twice in texts
    without symptoms of scanning whose odds of standing in texts with symptoms
    are at most a quarter or twice those of all words, so that a large scanned
    share alone casts no doubt. They are known unless a known misreading makes
    them of a word ``suspect_ratio`` times as common. Other words met twice
    there, or, if the odds don't speak against it, in any texts and copies, are
    doubtful: they are known unless a known misreading makes them of a sure
    word or of a commoner one. The vocabulary has all known words of letters
    met three times, whatever the size of the corpus. Lines are headers if they
    recur in a file, or three times anywhere.

    Every other distinct word is asked once: its automata are intersected with
    the tries of the vocabulary (see ``candidates``). Words that no vocabulary
    word explains stay as they are.
    """
    counts = (
        _counted(chunks).mapInArrow(_words_and_lines, "kind string, key string, n long, noisy long, stored long")
        .groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "noisy", "stored"))).where("n >= 2 or kind <> 'l'")
    )
    counts = materialize(counts, "kind")
    total = counts.where("kind = 't'").agg(F.sum("n").alias("n"), F.sum("noisy").alias("noisy")).first()
    clean, noisy = (total[c] or 0 for c in ("n", "noisy"))
    odds = max(0.25, 2 * noisy / max(1, clean))
    sure = (F.col("n") >= 2) & (F.col("noisy") <= odds * F.col("n"))
    doubtful = (F.col("n") >= 2) | ((F.col("stored") >= 2) & (F.col("noisy") <= odds * (F.col("n") + 2)))  # what only noisy texts have where others abound is mostly broken words
    word = F.col("key").rlike(r"^[\p{L}\-’']{2,}$") & F.col("key").rlike(r"\p{L}")
    words = counts.where("kind = 'w'").select("key", (F.col("n") + F.col("noisy")).alias("n"), sure.alias("sure"), (sure | doubtful).alias("met"), (word & F.when(sure, F.col("n") >= 3).otherwise(doubtful & (F.col("stored") >= 3))).alias("often"))
    most = words.where("often").agg(F.max("n")).first()[0] or 0
    plainly = F.col("sure") & (F.col("n") * suspect_ratio > most) & ~F.col("key").rlike(r"[^a-z'’\-]")  # too common to be a misreading
    asked = words.where(~plainly & (F.length("key") > 2) & (F.length("key") <= LONGEST) & F.col("key").rlike(r"\p{L}"))
    asked = materialize(asked.repartition(max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // 20_000)), "key"))  # the dearest step per row
    near = candidates(asked, words.where("often").select("key", "n", "sure"), trie_words=trie_words)
    first = near.groupBy("key").agg(F.min(F.struct("cost", -F.col("n"), "v", "n", "sure")).alias("m")).select("key", F.col("m.n").alias("vn"), F.col("m.sure").alias("vsure"))
    misread = materialize(
        asked.where(F.col("met") & (F.length("key") <= 40) & (F.length("key") > F.when(F.col("sure"), 3).otherwise(2))).join(first, "key")
        .where(F.when(F.col("sure"), F.col("vn") >= suspect_ratio * F.col("n")).otherwise(F.col("vsure") | (F.col("vn") > F.col("n")))).select("key")
    )
    known = materialize(words.where("met").join(misread, "key", "left_anti").select("key", "n", "often"))
    vocabulary = known.where("often").select("key", "n")
    good = near.join(misread.select(F.col("key").alias("v")), "v", "left_anti")
    ranked = good.groupBy("key").agg(F.min("cost").alias("least"), F.max("flat").alias("flat"), F.collect_set(F.struct("cost", -F.col("n"), "v")).alias("all"))  # vocabulary words within the edits of one word
    options = F.transform(F.array_sort(F.filter("all", lambda x: x["cost"] == F.col("least"))), lambda x: x["v"])
    fixes = _unfit(asked, known, ranked).select("key", options.alias("options"))
    none = F.lit(None).cast("array<string>")
    lines = counts.where("kind = 'l' and (n >= 3 or key not like '\n%')").select(F.concat(F.lit("h"), "key").alias("key"), none.alias("options"))
    answers = materialize(known.select(F.concat(F.lit("k"), "key").alias("key"), none.alias("options")).unionByName(lines).unionByName(fixes.withColumn("key", F.concat(F.lit("f"), "key"))))
    common = frozenset(r["key"] for r in words.where(plainly).orderBy(F.desc("n"), "key").limit(COMMON).select("key").collect())
    return Tables(vocabulary, answers, KeyFilter.build(answers.select("key"), max_bits=filter_bits, bits_per_key=BITS_PER_KEY), common)


def _unfit(asked: DataFrame, known: DataFrame, ranked: DataFrame) -> DataFrame:
    """The asked words that need a correction and have one, with the columns of ``ranked``.

    Codes count as misread only where one digit stands in a vocabulary word;
    words with odd characters or ligatures wherever the plain form is in the
    vocabulary; others unless they, or all parts of a compound, are known.
    """
    rows = asked.select("key").join(ranked, "key").join(known.select("key", F.lit(True).alias("known"), "often"), "key", "left")
    low = F.col("key")
    code = low.rlike(_CODE_JVM)
    odd = (F.length("key") <= 40) & low.rlike(r"[^a-z'’\-]")
    flat = odd & F.col("flat") & (low.rlike("[\ufb00-\ufb06]") | ~F.coalesce("often", F.lit(False)))
    parts = rows.where(low.rlike(r"[-‐/’']")).select("key", F.explode(F.split("key", r"[-‐/’']")).alias("part")).where(F.length("part") > 2)
    loose = parts.join(known.select(F.col("key").alias("part")), "part", "left_anti").select("key", F.lit(True).alias("loose")).distinct()
    compound = low.rlike(r"[-‐/’']")
    rows = rows.join(loose, "key", "left")
    single = F.regexp_count("key", F.lit("[0-9]")) == 1
    need = F.when(code, (F.length("key") > 3) & single & F.col("flat")).otherwise(flat | (F.col("known").isNull() & (~compound | F.coalesce("loose", F.lit(False)))))
    return rows.where(need)


def candidates(asked: DataFrame, vocabulary: DataFrame, *, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(key, v, cost, n, sure, flat): all vocabulary words that known misreadings turn into an asked word.

    asked: (key, ...); vocabulary: (key, n, sure). The automata of all forms
    of a word (see ``word_forms``) are intersected with a trie of the
    vocabulary; their substitutions are those of the known confusions, so the
    walk is complete for them: one in words of less than six letters, two in
    others, besides one that joins or parts letters (two in others) and odd
    characters. A trie holds at most ``trie_words`` words of neighbouring
    lengths; with more, the tries are broadcast one after the other, and each
    meets the words whose lengths can match. ``flat`` marks the word's own
    plain form.
    """
    spark = asked.sparkSession
    sizes = {r["k"]: r["count"] for r in vocabulary.groupBy(F.length("key").alias("k")).count().collect()}  # one row per length
    bands: list[tuple[int, int, int, int]] = []  # least and greatest length, which part of how many
    held = 0
    for k in sorted(sizes):
        parts = -(-sizes[k] // trie_words)
        if parts > 1:
            bands += [(k, k, i, parts) for i in range(parts)]
            held = trie_words
        elif bands and held + sizes[k] <= trie_words:
            bands[-1] = (bands[-1][0], k, 0, 1)
            held += sizes[k]
        else:
            bands.append((k, k, 0, 1))
            held = sizes[k]
    schema = "key string, v string, cost int, n long, sure boolean, flat boolean"
    out = spark.createDataFrame([], schema)
    for low, high, part, of in bands:
        block = vocabulary.where(F.length("key").between(low, high) & (F.pmod(F.xxhash64("key"), F.lit(of)) == part))
        rows = [(r["key"], r["n"], r["sure"]) for r in block.toLocalIterator()]  # at most about trie_words
        trie = Trie([r[0] for r in rows])
        facts = {w: (n, is_sure) for w, n, is_sure in rows}
        shared = spark.sparkContext.broadcast((trie, facts))
        reach = 4  # forms may be longer or shorter than the word by ligatures and pairs of letters
        out = out.unionByName(asked.where(F.length("key").between(low - reach, high + reach)).select("key").mapInArrow(_intersect(shared), schema))
    return materialize(out)


def _intersect(shared):
    def run(batches):
        trie, facts = shared.value
        swaps = confusable()
        for batch in batches:
            rows = []
            words = batch.column(0).to_pylist()
            for start in range(0, len(words), 1000):
                part = words[start : start + 1000]
                for k, group in ((1, [w for w in part if len(w) < 6]), (2, [w for w in part if len(w) >= 6])):
                    pairs = [(w, f) for w in group for f in word_forms(w, k)]
                    hits = {(w, i) for (w, _), found in zip(pairs, trie.within([f for _, f in pairs], k, swaps)) for i in found}
                    for w, i in hits:
                        v = trie.words[i]
                        cost = misreading(w, v) if v != w else None
                        if cost:
                            rows.append((w, v, cost, *facts[v], v == plain(w)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()))], names=["key", "v", "cost", "n", "sure", "flat"])

    return run


def neighbours(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(pair): which of the asked pairs of neighbouring words (hashes) the corpus has. Texts are read once; pairs that pass the filter are joined with those asked."""
    filter_ = texts.sparkSession.sparkContext.broadcast(KeyFilter.build(asked))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                h = Shingled([t or "" for t in batch.column(0).slice(start, 2000).to_pylist()], 2).hashes
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[filter_.value.may_hold(h)]).view(np.int64))], names=["pair"])

    return texts.mapInArrow(run, "pair long").distinct().join(asked, "pair", "left_semi")


_DIGIT = re.compile(r"\d")
_ALPHA = re.compile(r"[^\W\d_]")
_JOINT = re.compile("[-‐/]")


def text_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


class Repair:
    """The noise kinds of a text and its repaired form."""

    def __init__(self, model: Answers, file: str | None) -> None:
        self.model, self.file = model, file
        self.kinds: set[str] = set()

    def _joins(self, left: str, mark: str, right: str) -> str | None:
        """What a word broken at a line end reads together, or None if the hyphen belongs there (as in "pre- and")."""
        a, b = core(left), core(right)
        if not a or not b or not b[0].isalpha() or not a[-1].isalpha():
            return None
        if mark != "-":
            return "" if self.model.is_known((a + b).lower()) or not self.model.is_known(f"{a}-{b}".lower()) else "-"
        if self.model.is_known((a + b).lower()):
            return ""
        if self.model.is_known(f"{a}-{b}".lower()):
            return "-"
        if b.lower() in _SUSPENDED:
            return None
        last, whole = re.split(r"[-‐]", a.lower())[-1], self.model.is_known(b.lower()) and self.model.is_known(a.lower())
        if last != a.lower() and self.model.is_known(last + b.lower()):
            return ""
        return "-" if whole else ""

    def lines(self, text: str) -> list[str]:
        """The text's lines without page furniture and with broken words joined; "" separates paragraphs."""
        lines = text_lines(text)
        gone = set()
        for i, rest, page in foreign_lines(lines):
            if not rest:
                if _plausible(lines, i):
                    gone.add(i)
                    self.kinds.add("page_number")
            elif self.model.is_header(self.file, rest) or (not rest.islower() and (_interrupts(lines, i) or page and _touches(lines, i))):
                gone.add(i)
                self.kinds.add("header")
                if page:
                    self.kinds.add("page_number")
        out: list[str] = []
        cut = False  # furniture lies between this line and the one before
        for i, line in enumerate(lines):
            if i in gone:
                cut = True
                continue
            body = line.strip()
            if not body:
                if out and out[-1]:
                    out.append("")
                continue
            at = len(out) - 1
            while at >= 0 and not out[at]:
                at -= 1
            if at >= 0 and out[at][-1] in _HYPHENS and len(out[at]) > 1 and out[at][-2].isalpha() and not _ITEM.match(body) and (cut or at == len(out) - 1):
                left, right = out[at][:-1].split()[-1], body.split()[0]
                glue = self._joins(left, out[at][-1], right)
                if glue is not None:
                    self.kinds.add("hyphen")
                    rest = body[len(right) :].strip()
                    out[at] = out[at][:-1] + glue + right
                    del out[at + 1 :]
                    if rest:
                        out.append(rest)
                    cut = False
                    continue
            if cut and at >= 0 and at < len(out) - 1 and not re.search(r"[.!?:…”\"]$", out[at]):
                del out[at + 1 :]  # the blank line came with the furniture inside a paragraph
            cut = False
            out.append(body)
        return out

    def words(self, text: str) -> str:
        """The text with misread words corrected."""
        if not self.model.fixes:
            return text
        fixed = {t: c for t in set(text.split()) if (c := self.model.corrections(t)) and c != [t]}
        if not fixed:
            return text
        self.kinds.add("ocr")
        parts = re.split(r"(\s+)", text)
        for i in range(0, len(parts), 2):
            options = fixed.get(parts[i])
            if options:
                parts[i] = options[0] if len(options) == 1 else self.model.choose(parts[i - 2] if i else "", options, parts[i + 2] if i + 2 < len(parts) else "")
        return "".join(parts)

    def content(self, text: str) -> str:
        lines = self.lines(text)
        paragraphs, cur = [], []
        for line in [*lines, ""]:
            if line and not (_ITEM.match(line) and cur):
                cur.append(line)
                continue
            if cur:
                paragraphs.append(" ".join(cur))
            cur = [line] if line else []
        return "\n\n".join(self.words(p) for p in paragraphs)

    def title(self, text: str) -> str:
        m = _LEADER.search(text)
        if m and m.start() > 0:
            self.kinds.add("page_number")
            text = text[: m.start()]
        parts = re.split(r"\n|\s\|\s", text)
        if len(parts) > 1:
            rest, page = split_page(parts[0])
            if PAGE.fullmatch(parts[0]) and parts[0].strip():
                self.kinds.add("page_number")
                text = text[len(parts[0]) + 1 :]
            elif parts[0].strip()[-1:] not in tuple(_HYPHENS) and may_be_header(rest) and (self.model.is_header(self.file, rest) or (rest.isupper() and not parts[1].isupper())):
                self.kinds.update({"header", "page_number"} if page else {"header"})
                text = text[len(parts[0]) :].lstrip(" |\n")
        m = re.search(r"\s*\(([^()]*)\)\s*$", text)
        if m and m.start() > 0:
            rest, page = split_page(m[1])
            if may_be_header(rest) and self.model.is_header(self.file, rest):
                self.kinds.add("header")
                if page:
                    self.kinds.add("page_number")
                text = text[: m.start()]

        def join(m: re.Match) -> str:
            mark = m[0][len(m[1])]
            glue = self._joins(m[1], mark, m[2])
            if glue is None or (mark == "-" and "\n" not in m[0] and not self.model.is_known((m[1] + m[2]).lower()) and not self.model.is_known(f"{m[1]}-{m[2]}".lower())):
                return m[0]
            self.kinds.add("hyphen")
            return m[1] + glue + m[2]

        text = _TITLE_HYPHEN.sub(join, text)
        return self.words(" ".join(text.split()))


def _interrupts(lines: list[str], i: int) -> bool:
    """Whether line i stands within a sentence: the text before it hasn't ended and goes on in lower case after it."""
    before, after = _beside(lines, i, -1).strip(), _beside(lines, i, 1).strip()
    return bool(before) and after[:1].islower() and before[-1:].isalnum() and not _ITEM.match(before) and not PAGE.fullmatch(before)


def _touches(lines: list[str], i: int) -> bool:
    """Whether line i is the first or last with text and no blank line parts it from the rest."""
    if not _beside(lines, i, -1):
        return bool(lines[i + 1 : i + 2] and lines[i + 1].strip())
    return not _beside(lines, i, 1) and bool(lines[i - 1].strip())


def _plausible(lines: list[str], i: int) -> bool:
    """A roman numeral or letter-number line counts as a page number only by itself; all other forms always do."""
    return bool(lines[i].strip()) and not (len(lines) == 1)


def _questions(shared):
    """Rows (chunk_id, title, content, file) that may hold noise, with the keys to be asked: those that pass the filter."""

    def run(batches):
        filter_, common = shared.value
        hits: dict[str, list[str]] = {}  # token -> keys that pass
        seen: set[str] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                if len(seen) > 500_000:
                    seen, hits = set(), {}
                split = [((title or "").split() + (content or "").split()) for _, title, content, _ in rows]
                new = set().union(*split) - seen
                seen |= new
                asked = [(t, k) for t in new for k in token_keys(t) if k[1:] not in common]
                for (t, k), ok in zip(asked, filter_.may_hold(hashes([k for _, k in asked]))):
                    if ok:
                        hits.setdefault(t, []).append(k)
                picked, keys = [], []
                for (_, title, content, file), tokens in zip(rows, split):
                    own = [k for t in hits.keys() & set(tokens) for k in hits[t]] if not hits.keys().isdisjoint(tokens) else []
                    sure, more = _doubts(title, content, file)
                    own += [f"k{k[1:]}" for k in own if any(c in k for c in "-‐/")] + [f"k{core(t).lower()}" for t in hits.keys() & set(tokens) if any(c in t for c in "-‐/")] if own else []
                    picked.append((sure, own, len(more)))
                    keys += more
                passed = filter_.may_hold(hashes(keys))
                at, out = 0, []
                for row, (sure, own, n) in zip(rows, picked):
                    own = own + [k for k, ok in zip(keys[at : at + n], passed[at : at + n]) if ok]
                    at += n
                    if sure or own:
                        out.append((*row, list(dict.fromkeys(own))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.string()] * 4, pa.list_(pa.string())))], names=["chunk_id", "title", "content", "file", "asks"])

    return run


def _doubts(title: str | None, content: str | None, file: str | None) -> tuple[bool, list[str]]:
    """Whether the fields may hold noise whatever the tables say, and all keys on which their noise may depend."""
    sure, keys = False, []
    broken: set[tuple[str, str, str]] = set()
    if content and ("\n" in content or "\r" in content):
        lines = text_lines(content)
        found = list(foreign_lines(lines))
        for i, rest, page in found:
            if not rest or (not rest.islower() and (_interrupts(lines, i) or page and _touches(lines, i))):
                sure = True
            if rest:
                keys += [f"h{k}" for k in header_keys(file, rest)]
        broken = broken_words(lines, {i for i, _, _ in found}) if ends_in_hyphen(content) else set()
    if title:
        sure = sure or bool(_LEADER.search(title)) or "\n" in title or " | " in title
        for part in title_parts(title):
            keys += [f"h{k}" for k in header_keys(file, part)]
        if _HYPHENATED.search(title):
            broken |= {(m[1], m[0][len(m[1])], m[2]) for m in _TITLE_HYPHEN.finditer(title)}
    for parts in broken:
        sure = True
        keys += known_keys(*parts)
        forms = [k for form in joined_forms(*parts) for k in token_keys(form)]
        keys += forms + [f"k{k[1:]}" for k in forms if any(c in k for c in "-‐/")]
    return sure, keys


def _told(column: pa.ListArray) -> Iterator[list[tuple[str, list[str] | None]]]:
    """Per row its (key, options); none where it is null."""
    pairs = list(zip(*(c.to_pylist() for c in column.flatten().flatten())))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield pairs[at : (at := at + (n or 0))]


def _repair(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for cid, title, content, file, pairs, told in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), _told(batch.column(4))):
                model = Answers(told, frozenset(pairs or ()))
                a, b = Repair(model, file), Repair(model, file)
                good_title = a.title(title) if title else title
                if with_text:
                    good = b.content(content) if content else content
                else:
                    good = None
                    for line in b.lines(content) if content else ():
                        if line:
                            b.words(line)
                rows += [(cid, "title", k, good_title if with_text else None) for k in sorted(a.kinds)]
                rows += [(cid, "content", k, good) for k in sorted(b.kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["chunk_id", "field", "noise", "repaired"])

    return run


def _ambiguous(batches):
    """(chunk_id, pair): pairs of words whose occurrence in the corpus decides between corrections that are as near."""
    for batch in batches:
        out = []
        for cid, title, content, file, told in zip(*(c.to_pylist() for c in batch.columns)):
            model = Answers([(x["key"], x["options"]) for x in told])
            if all(len(v) < 2 for v in model.fixes.values()):
                continue
            repair = Repair(model, file)
            for line in [*(repair.lines(content) if content else ()), repair.title(title) if title else ""]:
                tokens = line.split()
                for i, t in enumerate(tokens):
                    options = model.corrections(t)
                    if len(options) > 1:
                        out += [(cid, p) for c in options for p in pair_hashes(tokens[i - 1] if i else "", c, tokens[i + 1] if i + 1 < len(tokens) else "")]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([p for _, p in out], pa.int64())], names=["chunk_id", "pair"])


def scan_noise(chunks: DataFrame, *, with_text: bool = False, **options) -> DataFrame:
    """(chunk_id, field, noise, repaired): a row per noise kind in the content or title of a chunk.

    chunks: (chunk_id, title, content, file). Kinds: hyphen, ocr, header,
    page_number. ``repaired`` is the field without noise, in continuous
    paragraphs (null unless ``with_text``).

    A first pass counts words and lines; of the counts, tables of known words,
    recurring header lines and the corrections of all other words are made
    (see ``fit``), each distinct word being asked once. A second pass finds the
    chunks that may hold noise and the questions on which that depends; keys
    that pass a filter of bounded size are answered by an equi-join with the
    tables, so the filter's size changes the rows that are shuffled, never the
    result. The third pass, over those chunks alone, removes page furniture,
    joins broken words and corrects misread ones. The fewest confusions win,
    then the words that the corpus has beside the neighbours (asked in a pass
    of its own, only where text is repaired: the kinds don't depend on it),
    then the commonest.

    Null ids take no part; null, empty and clean fields give no rows; repeated
    rows count once. A text of one line has no page furniture. Lines of more
    than 100 characters and headings of more than 90 aren't taken for page
    furniture, runs of more than 60 characters not for words.
    """
    rows = chunks.select("chunk_id", "title", "content", "file").where("chunk_id is not null and (title is not null or content is not null)")
    tables = fit(rows, **options)
    spark = rows.sparkSession
    text = "chunk_id string, title string, content string, file string"
    suspects = materialize(rows.mapInArrow(_questions(spark.sparkContext.broadcast((tables.filter, tables.common))), f"{text}, asks array<string>"))
    asks = suspects.select("chunk_id", F.explode("asks").alias("key")).distinct()
    told = asks.join(tables.answers, "key").groupBy("chunk_id").agg(F.collect_list(F.struct("key", "options")).alias("told"))  # questions of one chunk
    none = F.lit(None).cast("array<bigint>").alias("pairs")
    both = suspects.drop("asks").join(told, "chunk_id", "left")
    if with_text:
        both = materialize(both)
        pairs = materialize(both.where(F.exists("told", lambda x: F.size(x["options"]) > 1)).mapInArrow(_ambiguous, "chunk_id string, pair long").distinct())
        met = pairs.join(neighbours(rows.select("content"), pairs.select("pair").distinct()), "pair").groupBy("chunk_id").agg(F.collect_list("pair").alias("pairs"))
        both = both.join(met, "chunk_id", "left")
    else:
        both = both.select("*", none)
    return both.mapInArrow(_repair(with_text), "chunk_id string, field string, noise string, repaired string").dropDuplicates(["chunk_id", "field", "noise"])
