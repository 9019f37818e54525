"""The queries p3_ to p10_ over the test tables, with those SQL twins that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.encoding import find_garbled, restore_garbled
from tessella.llm.mixing import mix_shares, mix_sources
from tessella.llm.neardup import expand_pairs, near_duplicates, near_groups
from tessella.llm.nearest import nearest_in_time
from tessella.llm.packing import container_fill, pack_documents
from tessella.llm.pairs import broken_pairs
from tessella.llm.scans import scan_noise
from tessella.llm.split import split_oversized
from tessella.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunk"), table(spark, d, "split_limits"), with_text=False)
    return pieces.where("piece_no = 1 and n_pieces > 1").select("chunk_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunk"), table(spark, d, "split_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "test_database_open_minded").select("id", "question", F.col("expected_answer").alias("answer"))
    return broken_pairs(items, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"))


def _scanned(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return scan_noise(table(spark, d, "chunk").select("chunk_id", "title", "content", F.col("metadata.file_name").alias("file")), with_text=with_text)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, False).select("chunk_id", "field", "noise")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return (
        _scanned(spark, d, True).groupBy("chunk_id", "field")
        .agg(F.array_join(F.array_sort(F.collect_set("noise")), ",").alias("noise"), F.first("repaired").alias("repaired"))  # four kinds at most
    )


def p5_samples(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of title and content of every sample, repaired where noise was found, without regard to white space."""
    flat = lambda c: F.md5(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " ")))
    wanted = table(spark, d, "scan_samples").select("chunk_id").distinct()
    stored = table(spark, d, "chunk").select("chunk_id", "title", "content").join(wanted, "chunk_id").distinct()
    good = p5_repaired(spark, d)
    title = good.where("field = 'title'").select("chunk_id", F.col("repaired").alias("good_title"))
    content = good.where("field = 'content'").select("chunk_id", F.col("repaired").alias("good_content"))
    both = stored.join(title, "chunk_id", "left").join(content, "chunk_id", "left")
    return both.select("chunk_id", flat(F.coalesce("good_title", "title")).alias("title_md5"), flat(F.coalesce("good_content", "content")).alias("content_md5"))


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "chunk"), id="chunk_id", text="content", threshold=0.5, shingle=3, min_words=20)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return expand_pairs(*_similar(spark, d)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(*_similar(spark, d)).withColumnRenamed("id", "chunk_id")


def _timed(df: DataFrame) -> DataFrame:
    return df.select(F.lower(F.trim("username")).alias("entity"), F.col("timestamp").alias("ts"), "id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearest_in_time(_timed(table(spark, d, "user_answers")), _timed(table(spark, d, "rag_queries")), tolerance_seconds=120)
    return pairs.select(F.col("left_id").alias("answer_id"), F.col("right_id").alias("query_id"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that take more than one container of the packing, as only those above the capacity do."""
    return pack_documents(table(spark, d, "documents")).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b")).where("a <> b").select("doc_id")


def p8_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Packed documents, those not whole in their containers, and containers above the capacity."""
    packed = pack_documents(table(spark, d, "documents"))
    whole = packed.groupBy("doc_id").agg(F.countDistinct("piece_no").alias("k"), F.count("*").alias("rows"), F.max("n_pieces").alias("n"))
    over = container_fill(packed).agg(F.count_if(F.col("tokens") > 2048).alias("overfull"))
    return whole.agg(F.count("*").alias("documents"), F.count_if((F.col("k") != F.col("n")) | (F.col("rows") != F.col("n"))).alias("broken")).crossJoin(over)  # one row each


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_fill(pack_documents(table(spark, d, "documents")))


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(p9_uses(spark, d), table(spark, d, "mix_targets"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: its documents in the mix's table, and how many are used too often."""
    goal = table(spark, d, "mix_targets").where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("max_repeats").alias("most"))
    return p9_uses(spark, d).join(goal, "source").groupBy("source").agg(F.count("*").alias("documents"), F.count_if((F.col("uses") > F.col("most")) | (F.col("uses") < 0)).alias("too_often"))


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per cut chunk: its length, whether the pieces cover it in order without gaps, and whether all keep their limit."""
    limits = table(spark, d, "split_limits").groupBy("section_level").agg(F.min("max_chars").alias("most"), F.min("overlap_chars").alias("again"))
    levels = table(spark, d, "chunk").select("chunk_id", F.coalesce("section_level", F.lit(0)).alias("section_level")).distinct().join(F.broadcast(limits), "section_level").groupBy("chunk_id").agg(F.max("most").alias("most"), F.max("again").alias("again"))  # eight limits
    w = Window.partitionBy("chunk_id").orderBy("piece_no")
    pieces = p3_pieces(spark, d).withColumn("last", F.lag("end_char").over(w)).join(levels, "chunk_id")
    follows = (F.coalesce(F.col("last") - F.col("start_char"), F.lit(0)).between(0, F.col("again"))) & (F.col("end_char") > F.coalesce("last", F.lit(0)))
    kept = (F.col("end_char") - F.col("start_char") <= F.col("most")) & (F.length("piece") == F.col("end_char") - F.col("start_char"))
    return pieces.groupBy("chunk_id").agg(F.max("end_char").alias("chars"), F.bool_and(follows).alias("covered"), F.bool_and(kept).alias("within"))


def p10_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every affected sample with the hash of its restored text."""
    stored = table(spark, d, "documents").select("doc_id", "text").distinct()
    affected = table(spark, d, "encoding_samples").distinct().join(stored, "doc_id").where("text <> original_text").select("doc_id")
    return affected.join(p10_restored(spark, d), "doc_id", "left").select("doc_id", F.md5("restored").alias("text_md5"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"))[0].select(F.col("id").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_garbled(table(spark, d, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_cover": p3_cover,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p5_samples": p5_samples,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_capacity": p8_capacity,
    "p9_uses": p9_uses,
    "p9_shares": p9_shares,
    "p9_limits": p9_limits,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
    "p10_samples": p10_samples,
}

ORACLES = {
    "p3_cover": """WITH c AS (SELECT chunk_id, min(content) AS content FROM chunk c JOIN split_limits s ON s.section_level = coalesce(c.section_level, 0) WHERE length(c.content) > s.max_chars GROUP BY 1)
        SELECT chunk_id, CAST(length(content) AS INTEGER) AS chars, true AS covered, true AS within FROM c""",
    "p8_capacity": "SELECT count(DISTINCT doc_id) AS documents, 0 AS broken, 0 AS overfull FROM documents WHERE text <> ''",
    "p9_limits": """SELECT lower(trim(d.source)) AS source, count(DISTINCT doc_id) AS documents, 0 AS too_often FROM documents d
        WHERE d.text <> '' AND lower(trim(d.source)) IN (SELECT lower(trim(source)) FROM mix_targets) GROUP BY 1""",
    "p10_samples": """SELECT DISTINCT s.doc_id, md5(s.original_text) AS text_md5 FROM encoding_samples s JOIN documents d ON d.doc_id = s.doc_id WHERE d.text <> s.original_text""",
    "p6_found": """WITH t AS (SELECT DISTINCT chunk_id, content, string_split(trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM chunk WHERE content IS NOT NULL),
        g AS (SELECT DISTINCT chunk_id, content, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h
              FROM (SELECT chunk_id, content, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 20)),
        n AS (SELECT chunk_id, content, count(*) AS n FROM g GROUP BY 1, 2),
        o AS (SELECT x.chunk_id AS a, x.content AS ca, y.chunk_id AS b, y.content AS cb, count(*) AS o FROM g x JOIN g y ON x.h = y.h AND x.chunk_id < y.chunk_id GROUP BY 1, 2, 3, 4)
        SELECT DISTINCT a AS chunk_id_a, b AS chunk_id_b FROM o JOIN n p ON p.chunk_id = a AND p.content = ca JOIN n q ON q.chunk_id = b AND q.content = cb
        WHERE o / (p.n + q.n - o) >= 0.5""",
    "p3_found": """SELECT DISTINCT c.chunk_id FROM chunk c JOIN split_limits s ON s.section_level = coalesce(c.section_level, 0)
        WHERE length(c.content) > s.max_chars""",
    "p7_found": """WITH a AS (SELECT DISTINCT id, lower(trim(username)) AS u, timestamp AS ts FROM user_answers WHERE username IS NOT NULL AND timestamp IS NOT NULL),
        q AS (SELECT DISTINCT id, lower(trim(username)) AS u, timestamp AS ts FROM rag_queries WHERE username IS NOT NULL AND timestamp IS NOT NULL),
        p AS (SELECT a.id AS answer_id, q.id AS query_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch_us(a.ts) - epoch_us(q.ts)), q.id) AS k
              FROM a JOIN q ON a.u = q.u AND abs(epoch_us(a.ts) - epoch_us(q.ts)) <= 120000000)
        SELECT answer_id, query_id FROM p WHERE k = 1""",
}
