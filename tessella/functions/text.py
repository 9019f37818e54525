"""Column expressions on text. White space is space, tab, line feed, carriage return and form feed throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]+"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null and blank text."""
    flat = squeeze(text)
    return F.when(F.coalesce(flat, F.lit("")) == "", 0).otherwise(F.size(F.split(flat, " "))).cast("long")


def char_count(text: Column) -> Column:
    """Number of code points; 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def average_word_length(text: Column) -> Column:
    """Characters (spaces included) per word, 0 without words."""
    n = word_count(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(char_count(text) / n)


def markdown_to_text(md: Column) -> Column:
    """Markdown without its marks: images, links, headings, bold, italics, code, rules and page comments."""
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}[ \t]+", ""),
        (r"\*\*(.*?)\*\*", "$1"),
        (r"_(.*?)_", "$1"),
        (r"`(.*?)`", "$1"),
        (r"-----+", "\n\n"),
        (r"<!-- Page [0-9]+ -->", ""),
        (r"\n{3,}", "\n\n\n"),
    ):
        md = F.regexp_replace(md, pattern, to)
    return md


def rouge_text(text: Column) -> Column:
    """Lower case, single spaces, and only letters, digits, underscores, points and spaces."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), WS, " ")), r"[^\p{L}\p{N}_ .]", "")


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? and white space."""
    return F.split(F.regexp_replace(squeeze(text), r"([.!?]) ", "$1\x01"), "\x01")


def leftmost_year(name: Column, low: int, high: int) -> Column:
    """The first 19xx or 20xx in a name, or null if that is outside the range."""
    year = F.nullif(F.regexp_extract(name, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    return F.when(year.between(low, high), year)


def task_number(task: Column) -> Column:
    """n of task<n>, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(task, r"task([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))


#: Spellings of model names by family.
MODEL_FAMILIES = {
    "OpenAI": ("openai", "gpt-4", "gpt-4o-mini", "gpt4", "gpt"),
    "Llama": ("llama", "llama3", "llama-3", "wizardlm2"),
}


#: Spellings that only the wide list of names takes for a family.
WIDE_ONLY = ("gpt-4o-mini", "wizardlm2")


def model_family(model: Column, *, wide: bool = True) -> Column:
    """One spelling per model family; other names stay as they are. The narrow list lacks ``WIDE_ONLY``."""
    low = F.lower(F.trim(model))
    out = model
    for family, names in MODEL_FAMILIES.items():
        out = F.when(low.isin(*[n for n in names if wide or n not in WIDE_ONLY]), F.lit(family)).otherwise(out)
    return out


def ngrams(words: Column, n: int) -> Column:
    """The distinct word n-grams of an array of words."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
    )
