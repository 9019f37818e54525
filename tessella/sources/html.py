"""Fields of crawled pages, by a tolerant parser from the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of a lesson page and the columns they fill.
LESSON_LABELS = (("Abstract", "abstract"), ("Driving Event", "driving_event"), ("Lesson(s) Learned", "lessons_learned"), ("Recommendation(s)", "recommendations"), ("Evidence", "evidence"), ("Program Relation", "program_relation"), ("Program/Project Phase", "program_phase"), ("Mission Directorate", "mission_directorate"), ("Topic(s)", "topics"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.parts: list[tuple[str, list[str]]] = []  # heading, texts until the next one
        self.terms: list[str] = []
        self.values: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.strong: list[str] = []
        self.card = ""
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        self.open.append(tag)
        if tag == "h3":
            self.parts.append(("", []))
            if "title" in (a.get("class") or ""):
                self.card = ""
        elif tag == "dt":
            self.terms.append("")
        elif tag == "dd":
            self.values.append("")
        elif tag == "a" and a.get("href"):
            self.links.append((a["href"], self.card))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        text = data.strip()
        if not text or "script" in self.open or "style" in self.open:
            return
        if "title" in self.open:
            self.title.append(text)
        if "dt" in self.open and self.terms:
            self.terms[-1] += text
        elif "dd" in self.open and self.values:
            self.values[-1] += text
        if "h3" in self.open and self.parts:
            self.parts[-1] = (self.parts[-1][0] + text, self.parts[-1][1])
            self.card = self.parts[-1][0]
        elif self.parts:
            self.parts[-1][1].append(text)
            if "em" in self.open and "strong" in self.open and self.parts[-1][0] == "Subject":
                self.strong.append(text)


def parse_page(html: str | None) -> dict[str, str | None]:
    """Lesson fields of a page; those without a heading are null. The subject is its emphasised text, else what follows its heading."""
    page = _Page()
    page.feed(html or "")
    out: dict[str, str | None] = {"page_title": " ".join(page.title) or None, "subject": None, "lesson_date": None}
    for head, texts in page.parts:
        if head == "Subject" and out["subject"] is None:
            out["subject"] = " ".join(page.strong) or " ".join(texts) or None
    for label, column in LESSON_LABELS:
        out[column] = next((" ".join(t) or None for h, t in page.parts if label in h), None)
    for term, value in zip(page.terms, page.values):
        if term.rstrip(":") == "Lesson Date":
            out["lesson_date"] = value or None
    return out


_FIELDS = ["page_title", "subject", "lesson_date", *[c for _, c in LESSON_LABELS]]


def lesson_fields(html: Column) -> Column:
    """A struct of the lesson fields of a page's HTML."""

    @F.pandas_udf(", ".join(f"{c} string" for c in _FIELDS))
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(p) for p in pages], columns=_FIELDS)

    return parse(html)


def download_links(html: Column) -> Column:
    """Links to PDF downloads in a page's HTML, as an array."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*/downloads/[^"]*[.]pdf[^"]*)"'), F.lit(1))


def lesson_year(date: Column) -> Column:
    return F.year(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))
