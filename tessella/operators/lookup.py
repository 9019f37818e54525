"""Resolving names against a table of links, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.links import BASE, document_number, report_number, search_link


#: Characters of the runs by which names that may contain one another are found.
_RUN = 8


def _contained(names: DataFrame, known: DataFrame) -> DataFrame:
    """(file_name, url_within) of the names that contain a known file or are contained in one.

    The first run of the shorter name stands somewhere in the longer one, so
    the runs of one side at every place meet the first runs of the other. Runs
    are as long as the shorter name where that is below ``_RUN``.
    """

    def first(df: DataFrame, c: str) -> DataFrame:
        return df.where(F.length(c) > 0).withColumn("run", F.substring(c, 1, _RUN))

    def everywhere(df: DataFrame, c: str) -> DataFrame:
        runs = F.expr(f"flatten(transform(sequence(1, length({c})), i -> transform(sequence(1, {_RUN}), k -> substring({c}, i, k))))")
        return df.where(F.length(c) > 0).withColumn("run", F.explode(F.array_distinct(runs)))

    a = first(names, "file_name").join(everywhere(known, "file"), "run").where(F.expr("contains(file, file_name)"))
    b = everywhere(names, "file_name").join(first(known, "file"), "run").where(F.expr("contains(file_name, file)"))
    pairs = a.select("file_name", "file", "url").unionByName(b.select("file_name", "file", "url"))
    return pairs.groupBy("file_name").agg(F.min_by("url", "file").alias("url_within"))


def resolve_links(files: DataFrame, links: DataFrame, *, base: str = BASE) -> DataFrame:
    """(file_name, url, step): the link of every file by the first step that gives one.

    files: (file_name); links: (file, url). Steps: 'exact' name, name without
    regard to 'case' (least key), 'number' in the name, 'partial' (another
    extension, else one name within the other), 'search'. Each step is an
    equi-join on a derived key; several links of one key count as the least.
    Containment is decided exactly among the pairs that share a run of
    characters as long as the shorter name, up to ``_RUN``; of several keys the
    least counts. Null names take no part.
    """
    names = files.where("file_name is not null").select("file_name").distinct()
    known = links.where("file is not null and url is not null").groupBy("file").agg(F.min("url").alias("url"))
    lower = known.groupBy(F.lower("file").alias("low")).agg(F.min_by("url", "file").alias("url_low"))
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.[a-z0-9]+$", "")
    stems = known.groupBy(stem("file").alias("stem")).agg(F.min_by("url", "file").alias("url_stem"))
    number = F.coalesce(document_number(F.col("file_name")), report_number(F.col("file_name")))
    made = F.concat(F.lit(f"{base}/api/citations/"), number, F.lit("/downloads/"), "file_name", F.lit("?attachment=true"))
    joined = (
        names.join(known.withColumnRenamed("file", "file_name"), "file_name", "left")
        .withColumn("low", F.lower("file_name")).join(lower, "low", "left")
        .withColumn("stem", stem("file_name")).join(stems, "stem", "left")
    )
    joined = joined.withColumn("made", made)
    left = joined.where(F.coalesce("url", "url_low", "made", "url_stem").isNull()).select("file_name")
    joined = joined.join(_contained(left, known), "file_name", "left")
    steps = (("exact", F.col("url")), ("case", F.col("url_low")), ("number", F.col("made")), ("partial", F.coalesce("url_stem", "url_within")), ("search", search_link(F.col("file_name"), base)))
    return joined.select(
        "file_name", F.coalesce(*[u for _, u in steps]).alias("url"),
        F.coalesce(*[F.when(u.isNotNull(), F.lit(s)) for s, u in steps]).alias("step"),
    )


def pair_log_lines(lines: DataFrame) -> DataFrame:
    """(file, url) from a download log: a "Downloading from" line and the "Downloaded" line right after it.

    lines: (log, line_no, line). The next line is looked at once; a request
    without its confirmation gives nothing.
    """
    w = Window.partitionBy("log").orderBy("line_no")
    url = F.nullif(F.regexp_extract("line", "Downloading from: ([^ ]+)", 1), F.lit(""))
    done = F.nullif(F.regexp_extract(F.lead("line").over(w), "Downloaded [0-9]+/[0-9]+: (.+)$", 1), F.lit(""))
    return lines.select(done.alias("file"), url.alias("url")).where("file is not null and url is not null")
