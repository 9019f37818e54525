"""Readers with explicit schemas. Bad records are kept apart, never inferred around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layouts of the inputs.
CHUNK = (
    "chunk_id string, title string, content string, page_number int, section_level int, section_number int, total_sections int, "
    "metadata struct<file_name:string,file_path:string,download_url:string,statistics:struct<word_count:int,character_count:int,average_word_length:double,processing_time_seconds:double>>"
)
PIECE = (
    "chunk_id string, title string, author string, content string, chunk_index int, total_chunks int, "
    "metadata struct<title:string,author:string,subject:string,keywords:string,file_path:string,file_name:string,statistics:struct<word_count:int,character_count:int,average_word_length:double>>"
)
LESSON = ", ".join(f"{c} string" for c in "url subject abstract driving_event lessons_learned recommendations evidence program_relation program_phase mission_directorate topics".split())
ITEM = "id bigint, question string, expected_answer string, relevant_chunk_ids array<string>"
ANSWERS = "id bigint, username string, task_id string, answer string, is_correct string, timestamp string, entry_type string, model_used string, query string"
EVALUATIONS = "id bigint, username string, timestamp string, sus_responses string, task_difficulty string, ai_helpfulness string, ai_relevance string, retrieval_quality string, traditional_comparison string, improvement_suggestions string, favorite_feature string, skipped_tasks string"
SYSTEM_LOGS = "id bigint, timestamp string, level string, message string, logger string, pathname string, lineno int"
QUERIES = "id bigint, timestamp string, username string, task_id string, question string, model string, processing_time double, num_docs_retrieved int, answer_length int"


def read_chunks(spark: SparkSession, paths: str | list[str], schema: str = CHUNK) -> DataFrame:
    """Chunks from JSON files (an array or one object each), below the given folders.

    Items without title or content are left out, as are files that aren't JSON
    (see ``read_bad_json``). ``source_file`` is the file's name.
    """
    rows = spark.read.schema(schema + ", _bad string").options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json*", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").json(paths)
    return rows.where("content is not null and title is not null").withColumn("source_file", F.col("_metadata.file_name")).drop("_bad")


def read_bad_json(spark: SparkSession, paths: str | list[str], schema: str = CHUNK) -> DataFrame:
    """(source_file, record) of files that couldn't be parsed."""
    rows = spark.read.schema(schema + ", _bad string").options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json*", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").json(paths)
    return rows.where("_bad is not null and chunk_id is null").select(F.col("_metadata.file_name").alias("source_file"), F.col("_bad").alias("record"))


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lessons from CSV with quoted multi-line fields; "None" and empty fields are null, repeated header rows go, ``scrape_failed`` marks "Error" rows."""
    raw = spark.read.schema(LESSON).options(header=True, multiLine=True, quote='"', escape='"').csv(path).where("url is not null and url <> 'url'")
    names = [c for c in raw.columns if c != "url"]
    failed = F.coalesce(F.greatest(*[(F.col(c) == "Error").cast("int") for c in names]), F.lit(0)) == 1
    return raw.select("url", *[F.when(F.trim(c).isin("None", "", "Error"), None).otherwise(F.col(c)).alias(c) for c in names], failed.alias("scrape_failed"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from a JSON array."""
    return spark.read.schema(ITEM).json(path, multiLine=True)


def _time(c: str) -> F.Column:
    return F.coalesce(F.col(c).try_cast("timestamp"), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers log; flags that aren't true or false are null."""
    rows = spark.read.schema(ANSWERS).json(path, multiLine=True)
    return rows.withColumn("is_correct", F.col("is_correct").try_cast("boolean")).withColumn("timestamp", _time("timestamp"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path, multiLine=True).withColumn("timestamp", _time("timestamp"))


def read_system_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYSTEM_LOGS).json(path, multiLine=True).withColumn("timestamp", _time("timestamp"))


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Questionnaires; the nested answers may be objects or JSON text."""
    rows = spark.read.schema(EVALUATIONS).json(path, multiLine=True)
    return (
        rows.withColumn("sus_responses", F.from_json("sus_responses", "map<string,string>"))
        .withColumn("task_difficulty", F.from_json("task_difficulty", "map<string,string>"))
        .withColumn("skipped_tasks", F.from_json("skipped_tasks", "array<string>"))
        .withColumn("timestamp", _time("timestamp"))
    )


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf", *, recursive: bool = False) -> DataFrame:
    """(file_name, file_path, bytes): files of a folder by suffix; recursive lists compare it without case. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    fits = F.endswith(F.lower("path"), F.lit(suffix.lower())) if recursive else F.endswith("path", F.lit(suffix))
    return rows.where(fits).select(name.alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("bytes")).dropDuplicates(["file_path"])


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, file_path, markdown): one row per Markdown file."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("markdown"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, line): the lines of log files in order."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("log"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows.where("line <> ''")


def read_skipped(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """File names a statistics file lists as skipped, among those that exist."""
    names = spark.read.schema("still_skipped_file_list array<string>").json(path, multiLine=True).select(F.explode("still_skipped_file_list").alias("file_name"))
    return names.distinct().join(existing.select("file_name").distinct(), "file_name", "left_semi")


def document_metadata(raw: DataFrame) -> DataFrame:
    """(file_name, title, author, subject, keywords) with defaults: the title is the file's stem, the author 'Unknown', others empty."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        "file_name", F.coalesce(blank("title"), F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("title"), F.coalesce(blank("author"), F.lit("Unknown")).alias("author"),
        F.coalesce(blank("subject"), F.lit("")).alias("subject"), F.coalesce(blank("keywords"), F.lit("")).alias("keywords"),
    )
