"""Corpus profiling: statistics and distributions over chunks, files and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.ordering import in_order
from tessella.operators.profile import describe, fixed_ranges, width_histogram
from tessella.tables import table

#: The latest delivery of every chunk, with its length figures.
SQL_CHUNKS = """chunks AS (SELECT * FROM (SELECT chunk_id, title, content, page_number, section_level, section_number, total_sections, coalesce(metadata.file_name, 'Unknown') AS file_name,
    metadata.download_url AS download_url, coalesce(length(content), 0) AS chars,
    CASE WHEN trim(regexp_replace(coalesce(content, ''), '[ \\t\\n\\r\\f]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(content, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ')) END AS words,
    row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, metadata.statistics.processing_time_seconds DESC) AS rn FROM chunk) WHERE rn = 1)"""


def chunks(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """The latest delivery of every chunk: chunk_id, file_name, chars, words and further columns.

    Lengths are taken before the shuffle, so contents move only if asked for.
    """
    raw = table(spark, d, "chunk")
    w = Window.partitionBy("chunk_id").orderBy(F.desc("_at"), F.desc("_took"))
    return (
        raw.select(
            "chunk_id", *columns, F.coalesce("metadata.file_name", F.lit("Unknown")).alias("file_name"),
            T.char_count(F.col("content")).alias("chars"), T.word_count(F.col("content")).alias("words"),
            F.col("ingested_at").alias("_at"), F.col("metadata.statistics.processing_time_seconds").alias("_took"),
        )
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_at", "_took")
    )


def chunk_stats(spark, d):
    avg = F.round(F.when(F.col("words") == 0, 0.0).otherwise(F.col("chars") / F.col("words")), 6)
    return chunks(spark, d).select("chunk_id", "words", "chars", avg.alias("average_word_length"))


def doc_stats(spark, d):
    return chunks(spark, d).groupBy("file_name").agg(
        F.count("*").alias("n_chunks"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.min("words").alias("min_words"), F.max("words").alias("max_words")
    )


def chunk_totals(spark, d):
    zero = lambda c, a: F.coalesce(c, F.lit(0)).alias(a)
    return chunks(spark, d).agg(
        F.count("*").alias("n_chunks"), zero(F.sum("words"), "words"), zero(F.sum("chars"), "chars"), zero(F.min("words"), "min_words"),
        zero(F.max("words"), "max_words"), zero(F.min("chars"), "min_chars"), zero(F.max("chars"), "max_chars"),
    )


def chunk_averages(spark, d):
    """Averages over files with content (success) and over all files."""
    files = chunks(spark, d).groupBy("file_name").agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.sum("chars").alias("c"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return files.agg(
        div(F.sum("n"), F.count_if(F.col("w") > 0)).alias("chunks_per_successful_file"), div(F.sum("n"), F.count("*")).alias("chunks_per_file"),
        div(F.sum("w"), F.sum("n")).alias("words_per_chunk"), div(F.sum("c"), F.sum("n")).alias("chars_per_chunk"),
    )


def describe_overall(spark, d):
    return describe(chunks(spark, d).withColumn("tokens", F.col("chars") / 4.0), ["words", "chars", "tokens"])


def describe_by_level(spark, d):
    return describe(chunks(spark, d, F.coalesce("section_level", F.lit(0)).alias("section_level")), ["words", "chars"], by="section_level")


def chunks_per_doc_capped(spark, d):
    return chunks(spark, d).groupBy("file_name").count().groupBy(F.least("count", F.lit(80)).alias("n_chunks")).agg(F.count("*").alias("n_docs"))


def chunk_count_histogram(spark, d):
    return chunks(spark, d).groupBy("file_name").count().groupBy(F.col("count").alias("n_chunks")).agg(F.count("*").alias("n_docs"))


def token_histogram(spark, d):
    tokens = chunks(spark, d).select((F.col("chars") / 4.0).alias("tokens")).where("tokens between 40 and 2000")
    return width_histogram(tokens, "tokens", 30)


def word_range_histogram(spark, d):
    files = chunks(spark, d).groupBy(F.split_part("file_name", F.lit(".pdf"), F.lit(1)).alias("f")).agg(F.sum("words").alias("words"))
    edges = [0, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 6000, 7000, 8000, 9000, 10000, None]
    return fixed_ranges(files, "words", edges, lambda a, b: f"{a}-{b}" if b else f"{a}+")


def size_range_histogram(spark, d):
    sizes = table(spark, d, "documents").select((F.coalesce("n_chars", F.lit(0)) / 1000.0).alias("kb"))
    edges = [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, None]
    return fixed_ranges(sizes, "kb", edges, lambda a, b: f"{a:.1f}-{b:.1f}KB" if b else f"{a:.1f}-infKB")


def size_totals(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / 1e6, 6).alias("total_mb"), F.round(F.avg("n_chars") / 1e3, 6).alias("mean_kb"))


def std_pop_vs_samp(spark, d):
    files = chunks(spark, d).groupBy("file_name").agg(F.count("*").alias("n"), F.avg("words").alias("w"))
    r = lambda c, a: F.round(c, 4).alias(a)
    return files.agg(r(F.stddev_pop("n"), "pop_chunks"), r(F.stddev_samp("n"), "samp_chunks"), r(F.stddev_pop("w"), "pop_words"), r(F.stddev_samp("w"), "samp_words"))


def top_documents(spark, d):
    short = F.when(F.length("file_name") > 20, F.concat(F.substring("file_name", 1, 20), F.lit("..."))).otherwise(F.col("file_name"))
    return chunks(spark, d).groupBy("file_name").agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "file_name").limit(10).select(short.alias("name"), "file_name", "n_chunks")


def word_count_stats(spark, d):
    return chunks(spark, d).groupBy(F.coalesce(F.col("file_name") == "Unknown", F.lit(False)).alias("unknown_file")).agg(
        F.count("*").alias("n"), F.round(F.avg("words"), 6).alias("mean"), F.round(F.median("words"), 6).alias("median"), F.min("words").alias("least"), F.max("words").alias("most"), F.countDistinct("file_name").alias("n_files")
    )


def min_words_filter(spark, d):
    return chunks(spark, d, "section_level").where("words >= 7").groupBy("section_level").agg(F.count("*").alias("kept"))


def drop_single_section(spark, d):
    return chunks(spark, d, "total_sections").where(F.coalesce("total_sections", F.lit(0)) != 1).groupBy("file_name").agg(F.count("*").alias("kept"))


def short_section_flags(spark, d):
    flagged = (F.col("words") < 10) & ~F.coalesce("title", F.lit("")).isin("Abstract", "References")
    return chunks(spark, d, "title").select("chunk_id", "words", flagged.alias("is_short"))


_TABLE = r"(?i:(?:table|tbl\.)\s+[0-9])|^\s*\||[+][-=]{2,}|[|].*[|].*[|]|Table|TABLE"
_FIGURE = r"(?i)figure|fig\.|image|chart|graph"


def figure_table_lines(spark, d):
    lines = chunks(spark, d, "content").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.agg(
        F.count("*").alias("lines"), F.count_if(F.col("line").rlike(_TABLE)).alias("table_lines"), F.count_if(F.col("line").rlike(_FIGURE)).alias("figure_lines"),
        F.count_if(F.col("line").rlike("^[0-9]+$")).alias("numeric_lines"),
    )


def section_position(spark, d):
    """Ordinal of each chunk in its file by section, the file's chunk total and the index gap before it."""
    rows = in_order(chunks(spark, d, "section_number"), "file_name", F.col("section_number"), "chunk_id")
    totals = chunks(spark, d).groupBy("file_name").agg(F.count("*").alias("n_in_file"))
    return rows.join(totals, "file_name").select(
        "chunk_id", F.col("_ordinal").alias("ordinal"), "n_in_file", F.coalesce(F.col("section_number") - F.col("_previous") - 1, F.lit(0)).alias("gap_before")
    )


def page_carry_forward(spark, d):
    """The last known page of each chunk's file (pages of even sections count as unmarked)."""
    marked = F.when(F.col("section_number") % 2 == 1, F.col("page_number"))
    rows = in_order(chunks(spark, d, "section_number", "page_number"), "file_name", F.col("section_number"), "chunk_id", carry=marked)
    return rows.select("chunk_id", F.col("_carried").alias("page"))


def level_title_rollup(spark, d):
    """Chunks and words by section level and language-independent title initial, with subtotals."""
    base = chunks(spark, d, "section_level", F.substring(F.upper(F.coalesce("title", F.lit("?"))), 1, 1).alias("initial"))
    return base.rollup("section_level", "initial").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.grouping_id().cast("int").alias("level_of_total"))


def filename_years(spark, d):
    names = table(spark, d, "documents").select(T.leftmost_year(F.col("file_name"), 1999, 2025).alias("year")).where("year is not null")
    return names.groupBy("year").agg(F.count("*").alias("n"), F.min(F.min("year")).over(Window.partitionBy(F.lit(1))).alias("first_year"), F.max(F.max("year")).over(Window.partitionBy(F.lit(1))).alias("last_year"))


def lesson_years(spark, d):
    rows = table(spark, d, "lessons").where("url <> 'url' and url is not null").select(F.year("scraped_at").alias("year"), "url").distinct()
    return rows.groupBy("year").agg(F.count("*").alias("n_lessons"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_stats, doc_stats, chunk_totals, chunk_averages, describe_overall, describe_by_level, chunks_per_doc_capped, chunk_count_histogram, token_histogram,
        word_range_histogram, size_range_histogram, size_totals, std_pop_vs_samp, top_documents, word_count_stats, min_words_filter, drop_single_section,
        short_section_flags, figure_table_lines, section_position, page_carry_forward, level_title_rollup, filename_years, lesson_years,
    )
}


def _describe_sql(source: str, columns: dict[str, str], by: str | None = None) -> str:
    key = f"CAST({by} AS VARCHAR) AS group_value, " if by else "NULL::VARCHAR AS group_value, "
    one = """SELECT {key}'{name}' AS metric, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 4) AS std, min(x)::DOUBLE AS least, round(quantile_cont(x, 0.25), 6) AS p25,
        round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, max(x)::DOUBLE AS most FROM (SELECT *, ({expr})::DOUBLE AS x FROM {source}) {group}"""
    overall = "NULL::VARCHAR AS group_value, "
    parts = []
    for name, expr in columns.items():
        parts.append(one.format(key=overall, name=name, expr=expr, source=source, group=""))
        if by:
            parts.append(one.format(key=key, name=name, expr=expr, source=source, group=f"GROUP BY {by}"))
    return " UNION ALL ".join(parts)


def _ranges_sql(source: str, column: str, edges: list, label) -> str:
    rows = ", ".join(f"({i}, '{label(a, b)}', {a}::DOUBLE, {b if b is not None else 'NULL'}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"SELECT e.i AS bucket, e.label, count(s.{column}) AS n FROM (VALUES {rows}) e(i, label, lo, hi) LEFT JOIN {source} s ON s.{column} >= e.lo AND (e.hi IS NULL OR s.{column} < e.hi) GROUP BY e.i, e.label"


_W = f"WITH {SQL_CHUNKS} "
ORACLES = {
    "chunk_stats": _W + "SELECT chunk_id, words, chars, round(CASE WHEN words = 0 THEN 0.0 ELSE chars / words END, 6) AS average_word_length FROM chunks",
    "doc_stats": _W + "SELECT file_name, count(*) AS n_chunks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, min(words) AS min_words, max(words) AS max_words FROM chunks GROUP BY 1",
    "chunk_totals": _W + "SELECT count(*) AS n_chunks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, min(words) AS min_words, max(words) AS max_words, min(chars) AS min_chars, max(chars) AS max_chars FROM chunks",
    "chunk_averages": _W + """SELECT round(sum(n) / count(*) FILTER (WHERE w > 0), 6) AS chunks_per_successful_file, round(sum(n) / count(*), 6) AS chunks_per_file, round(sum(w) / sum(n), 6) AS words_per_chunk,
        round(sum(c) / sum(n), 6) AS chars_per_chunk FROM (SELECT file_name, count(*) AS n, sum(words) AS w, sum(chars) AS c FROM chunks GROUP BY 1)""",
    "describe_overall": _W + _describe_sql("chunks", {"words": "words", "chars": "chars", "tokens": "chars / 4.0"}),
    "describe_by_level": _W + _describe_sql("(SELECT words, chars, coalesce(section_level, 0) AS section_level FROM chunks)", {"words": "words", "chars": "chars"}, "section_level"),
    "chunks_per_doc_capped": _W + "SELECT least(n, 80) AS n_chunks, count(*) AS n_docs FROM (SELECT file_name, count(*) AS n FROM chunks GROUP BY 1) GROUP BY 1",
    "chunk_count_histogram": _W + "SELECT n AS n_chunks, count(*) AS n_docs FROM (SELECT file_name, count(*) AS n FROM chunks GROUP BY 1) GROUP BY 1",
    "token_histogram": _W + """, t AS (SELECT chars / 4.0 AS x FROM chunks WHERE chars / 4.0 BETWEEN 40 AND 2000), m AS (SELECT min(x) AS lo, max(x) AS hi FROM t),
        b AS (SELECT CAST(least(29, floor((x - lo) / (hi - lo) * 30)) AS INTEGER) AS bin FROM t, m), g AS (SELECT unnest(range(0, 30)) AS bin)
        SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) * g.bin / 30, 6) AS low, round(lo + (hi - lo) * (g.bin + 1) / 30, 6) AS high, count(b.bin) AS n FROM g LEFT JOIN b ON b.bin = g.bin, m GROUP BY g.bin, lo, hi""",
    "word_range_histogram": _W + ", f AS (SELECT split_part(file_name, '.pdf', 1) AS f, sum(words) AS words FROM chunks GROUP BY 1) "
    + _ranges_sql("f", "words", [0, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 6000, 7000, 8000, 9000, 10000, None], lambda a, b: f"{a}-{b}" if b else f"{a}+"),
    "size_range_histogram": "WITH f AS (SELECT coalesce(n_chars, 0) / 1000.0 AS kb FROM documents) "
    + _ranges_sql("f", "kb", [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, None], lambda a, b: f"{a:.1f}-{b:.1f}KB" if b else f"{a:.1f}-infKB"),
    "size_totals": "SELECT count(*) AS n, round(sum(n_chars) / 1e6, 6) AS total_mb, round(avg(n_chars) / 1e3, 6) AS mean_kb FROM documents",
    "std_pop_vs_samp": _W + """SELECT round(stddev_pop(n), 4) AS pop_chunks, round(stddev_samp(n), 4) AS samp_chunks, round(stddev_pop(w), 4) AS pop_words, round(stddev_samp(w), 4) AS samp_words
        FROM (SELECT file_name, count(*) AS n, avg(words) AS w FROM chunks GROUP BY 1)""",
    "top_documents": _W + "SELECT CASE WHEN length(file_name) > 20 THEN substr(file_name, 1, 20) || '...' ELSE file_name END AS name, file_name, count(*) AS n_chunks FROM chunks GROUP BY file_name ORDER BY n_chunks DESC, file_name LIMIT 10",
    "word_count_stats": _W + "SELECT file_name = 'Unknown' AS unknown_file, count(*) AS n, round(avg(words), 6) AS mean, round(median(words), 6) AS median, min(words) AS least, max(words) AS most, count(DISTINCT file_name) AS n_files FROM chunks GROUP BY 1",
    "min_words_filter": _W + "SELECT section_level, count(*) AS kept FROM chunks WHERE words >= 7 GROUP BY 1",
    "drop_single_section": _W + "SELECT file_name, count(*) AS kept FROM chunks WHERE coalesce(total_sections, 0) <> 1 GROUP BY 1",
    "short_section_flags": _W + "SELECT chunk_id, words, words < 10 AND coalesce(title, '') NOT IN ('Abstract', 'References') AS is_short FROM chunks",
    "figure_table_lines": _W + r""", l AS (SELECT unnest(string_split(content, chr(10))) AS line FROM chunks WHERE content IS NOT NULL)
        SELECT count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '(?i:(?:table|tbl\.)\s+[0-9])|^\s*\||[+][-=]{2,}|[|].*[|].*[|]|Table|TABLE')) AS table_lines,
        count(*) FILTER (WHERE regexp_matches(line, '(?i)figure|fig\.|image|chart|graph')) AS figure_lines, count(*) FILTER (WHERE regexp_matches(line, '^[0-9]+$')) AS numeric_lines FROM l""",
    "section_position": _W + """SELECT chunk_id, row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY file_name) AS n_in_file, coalesce(section_number - lag(section_number) OVER w - 1, 0) AS gap_before
        FROM chunks WINDOW w AS (PARTITION BY file_name ORDER BY section_number NULLS FIRST, chunk_id)""",
    "page_carry_forward": _W + """, m AS (SELECT chunk_id, file_name, section_number, CASE WHEN section_number % 2 = 1 THEN page_number END AS p FROM chunks)
        SELECT chunk_id, last_value(p IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY section_number NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING) AS page FROM m""",
    "level_title_rollup": _W + """, b AS (SELECT section_level, substr(upper(coalesce(title, '?')), 1, 1) AS initial, words FROM chunks)
        SELECT section_level, initial, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(grouping(section_level, initial) AS INTEGER) AS level_of_total FROM b GROUP BY ROLLUP (section_level, initial)""",
    "filename_years": """WITH y AS (SELECT TRY_CAST(nullif(regexp_extract(file_name, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year FROM documents)
        SELECT year, count(*) AS n, min(min(year)) OVER () AS first_year, max(max(year)) OVER () AS last_year FROM y WHERE year BETWEEN 1999 AND 2025 GROUP BY year""",
    "lesson_years": "SELECT year, count(*) AS n_lessons FROM (SELECT DISTINCT year(scraped_at) AS year, url FROM lessons WHERE url <> 'url') GROUP BY year",
}
