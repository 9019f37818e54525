"""File names, titles and download links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host of the download service; a parameter of every function that makes links.
BASE = "https://reports.example"


def document_number(name: Column) -> Column:
    """The first run of at least eight digits in a name, or null."""
    return F.nullif(F.regexp_extract(name, "([0-9]{8,})", 1), F.lit(""))


def report_number(name: Column) -> Column:
    """An agency report number (AGENCY-XX-123) in a name, or null."""
    return F.nullif(F.regexp_extract(name, "(?i)([A-Z]{2,}-[A-Z]+-[0-9]+)", 1), F.lit(""))


def download_link(name: Column, base: str = BASE) -> Column:
    """A link made from the number in a file name, or a general one."""
    number = F.coalesce(document_number(name), report_number(name))
    return F.when(number.isNotNull(), F.concat(F.lit(f"{base}/api/citations/"), number, F.lit("/downloads/"), name)).otherwise(F.concat(F.lit(f"{base}/api/citations/downloads/"), name))


def search_link(name: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}/search?q="), F.replace(F.replace(name, F.lit(" "), F.lit("%20")), F.lit(".pdf"), F.lit("")))


def file_of_link(url: Column) -> Column:
    """The file name behind /downloads/, without parameters and with spaces."""
    return F.replace(F.split_part(F.split_part(url, F.lit("/downloads/"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("%20"), F.lit(" "))


def safe_title(title: Column) -> Column:
    """At most 100 characters, all but letters and digits as underscores."""
    return F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}]", "_"), 1, 100)
