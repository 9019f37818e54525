"""Queries on vectors, lookups, citations and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import index as I
from tessella.operators import retrieval as R
from tessella.tables import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(spark, d):
    """Every vector whose id is divisible by 20 asks."""
    return _vectors(spark, d).where("id % 20 = 0")


def _knn(spark, d, **how):
    return R.knn(_asked(spark, d), _vectors(spark, d), **how)


def knn_topk(spark, d):
    return _knn(spark, d, k=4, exclude_self=True).select("query_id", "doc_id", F.round("distance", 5).alias("distance"), "rank")


def knn_threshold(spark, d):
    return _knn(spark, d, k=4, threshold=1.4, exclude_self=True).select("query_id", "doc_id", F.round("distance", 5).alias("distance"), "rank")


def knn_index(spark, d):
    """The inverted-list index against the exact form: queries, and whether at least nine of ten neighbours are found."""
    found = I.search(_asked(spark, d), I.build_index(_vectors(spark, d)), k=4, probes=12, exclude_self=True)
    return I.recall(found, _knn(spark, d, k=4, exclude_self=True)).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


def nearest_document(spark, d):
    """k=1 with the document's text length, language and source type."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source_type", "n_chars")
    return _knn(spark, d, k=1, exclude_self=True).join(docs, "doc_id").select("query_id", "doc_id", "lang", "source_type", "n_chars")


def cosine_to_next(spark, d):
    """Cosine of every vector and the one with the next id."""
    v = _vectors(spark, d)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(nxt, "id").select("id", F.round(V.cosine(F.col("v"), F.col("w")), 5).alias("cosine"))


def vector_norms(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.min(V.norm(F.col("embedding"))), 5).alias("least"), F.round(F.max(V.norm(F.col("embedding"))), 5).alias("most"))


def retrieval_metrics_by_query(spark, d):
    """Relevant are all other vectors of the query's label."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return R.label_metrics(_knn(spark, d, k=4, exclude_self=True), labels)


def retrieval_metrics(spark, d):
    return R.metrics_summary(retrieval_metrics_by_query(spark, d))


def _item_lists(spark, d):
    """For every item: its references, and as retrieved list the neighbours of the first one, in its file."""
    items = table(spark, d, "test_database_open_minded").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "relevant_chunk_ids")
    rel = items.select("query_id", F.explode("relevant_chunk_ids").alias("r")).select("query_id", F.trim("r").alias("rel_key")).where("rel_key <> ''")
    first = F.nullif(F.regexp_extract(F.trim(F.try_element_at("relevant_chunk_ids", F.lit(1))), r"^(.*\.pdf)_([0-9]+)$", 1), F.lit(""))
    at = F.nullif(F.regexp_extract(F.trim(F.try_element_at("relevant_chunk_ids", F.lit(1))), r"^(.*\.pdf)_([0-9]+)$", 2), F.lit("")).cast("int")
    got = items.select("query_id", first.alias("f"), at.alias("n")).where("f is not null").select("query_id", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.concat("f", F.lit("_"), (F.col("n") + step).cast("string")).alias("doc_key")) for i, step in enumerate((1, 0, 2))])).alias("x")).select("query_id", "x.rank", "x.doc_key")
    return got, rel


def item_metrics_exact(spark, d):
    return R.metrics_by_query(*_item_lists(spark, d))


def item_metrics_substring(spark, d):
    return R.metrics_by_query(*_item_lists(spark, d), match="substring")


def item_metrics_summary(spark, d):
    return R.metrics_summary(item_metrics_substring(spark, d))


def _documents(spark, d):
    """Chunks and lessons as one table of retrieval documents: (doc_key, source_type, title, url)."""
    chunks = table(spark, d, "chunk").select(F.col("chunk_id").alias("doc_key"), F.lit("pdf").alias("source_type"), F.coalesce("metadata.file_name", F.lit("Unknown")).alias("title"), F.col("metadata.download_url").alias("url"))
    lessons = table(spark, d, "lessons").where("url <> 'url' and subject <> 'Error'").select(F.col("url").alias("doc_key"), F.lit("lessons_learned").alias("source_type"), F.col("subject").alias("title"), "url")
    both = chunks.unionByName(lessons)
    return both.groupBy("doc_key", "source_type").agg(F.min("title").alias("title"), F.min("url").alias("url"))


def _refs(spark, d):
    items = table(spark, d, "test_database_open_minded").dropDuplicates(["id"])
    return items.select("id", F.posexplode("relevant_chunk_ids").alias("pos", "r")).select("id", "pos", F.trim("r").alias("doc_key")).where("doc_key <> ''")


def doc_lookup(spark, d):
    """Every reference with the document it names; one join for all."""
    return _refs(spark, d).join(_documents(spark, d), "doc_key").select("id", "pos", "doc_key", "source_type", "title")


def prefix_lookup(spark, d):
    """How many chunks belong to the file that a reference names (everything before its last underscore)."""
    per_file = table(spark, d, "chunk").select("chunk_id").distinct().groupBy(F.regexp_replace("chunk_id", "_[0-9]+$", "").alias("f")).agg(F.count("*").alias("n_chunks"))
    refs = _refs(spark, d).select("id", F.regexp_replace("doc_key", "_[0-9]+$", "").alias("f")).distinct()
    return refs.join(per_file, "f").select("id", F.col("f").alias("file_name"), "n_chunks")


def citations(spark, d):
    """The source list of every item, in order of its references, each source once."""
    found = _refs(spark, d).join(_documents(spark, d), "doc_key").select("id", "pos", R.citation(F.col("source_type"), F.col("title"), F.col("url")).alias("line"))
    first = found.groupBy("id", "line").agg(F.min("pos").alias("pos"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return first.groupBy("id").agg(F.concat(F.lit("\n\n4. Sources:\n"), F.array_join(lines, "\n")).alias("sources"))


def context_block(spark, d):
    """The context given to a model: source, title and content of every referenced chunk, in order."""
    text = table(spark, d, "chunk").groupBy(F.col("chunk_id").alias("doc_key")).agg(F.max("content").alias("content"), F.min("title").alias("title"), F.min("metadata.file_name").alias("file"))
    block = F.concat(F.lit("Source: "), F.coalesce("file", F.lit("Unknown Source")), F.lit("\nTitle: "), F.coalesce("title", F.lit("No Title")), F.lit("\nContent: "), F.coalesce("content", F.lit("")))
    found = _refs(spark, d).groupBy("id", "doc_key").agg(F.min("pos").alias("pos")).join(text, "doc_key").select("id", "pos", block.alias("block"))
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context")).select("id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def dedupe_last(spark, d):
    """Items by question text, the last id winning."""
    return table(spark, d, "test_database_open_minded").where("question is not null").groupBy("question").agg(F.max("id").alias("id"), F.max_by(F.coalesce(F.size("relevant_chunk_ids"), F.lit(-1)), "id").alias("n_refs"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_threshold, knn_index, nearest_document, cosine_to_next, vector_norms, retrieval_metrics_by_query, retrieval_metrics, item_metrics_exact, item_metrics_substring, item_metrics_summary,
        doc_lookup, prefix_lookup, citations, context_block, dedupe_last,
    )
}

_KNN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    p AS (SELECT q.id AS query_id, x.id AS doc_id, q.label AS ql, x.label AS xl, list_sum(list_transform(list_zip(q.e, x.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v q JOIN v x ON q.id % 20 = 0 AND q.id <> x.id),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p) WHERE rank <= 4)"""


def _metrics_sql(retrieved: str, relevant: str, fits: str) -> str:
    return f"""got AS ({retrieved}), rel AS (SELECT DISTINCT * FROM ({relevant})),
    met AS (SELECT rel.query_id, count(DISTINCT rel_key) AS found, min(rank) AS first, sum(CASE WHEN doc_key = rel_key THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM rel JOIN got ON got.query_id = rel.query_id WHERE {fits} GROUP BY 1),
    ng AS (SELECT query_id, count(*) AS n FROM got GROUP BY 1), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
    ideal AS (SELECT i AS n, sum(1.0 / log2(i2 + 1.0)) AS idcg FROM (SELECT unnest(range(1, 20)) AS i) a JOIN (SELECT unnest(range(1, 20)) AS i2) b ON i2 <= i GROUP BY i),
    m AS (SELECT nr.query_id, coalesce(ng.n, 0) AS n_retrieved, nr.n AS n_relevant, round(coalesce(found / nullif(ng.n, 0), 0), 6) AS precision, round(coalesce(found / nr.n, 0), 6) AS recall,
        round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(dcg / idcg, 0), 6) AS ndcg
        FROM nr LEFT JOIN ng ON ng.query_id = nr.query_id LEFT JOIN met ON met.query_id = nr.query_id LEFT JOIN ideal ON ideal.n = least(nr.n, coalesce(ng.n, 0)))"""


_LABEL_METRICS = "WITH " + _KNN + ", " + _metrics_sql(
    "SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_key, rank FROM k", "SELECT q.id AS query_id, CAST(x.id AS VARCHAR) AS rel_key FROM v q JOIN v x ON q.label = x.label AND q.id <> x.id WHERE q.id % 20 = 0", "doc_key = rel_key"
)
_ITEMS = "i AS (SELECT * FROM (SELECT id, relevant_chunk_ids, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM test_database_open_minded) WHERE rn = 1)"
_REL = "SELECT query_id, trim(r) AS rel_key FROM (SELECT id AS query_id, unnest(relevant_chunk_ids) AS r FROM i) WHERE trim(r) <> ''"
_GOT = r"""SELECT query_id, rank, f || '_' || CAST(n + step AS VARCHAR) AS doc_key FROM (SELECT id AS query_id, regexp_extract(trim(relevant_chunk_ids[1]), '^(.*\.pdf)_([0-9]+)$', 1) AS f,
    TRY_CAST(regexp_extract(trim(relevant_chunk_ids[1]), '^(.*\.pdf)_([0-9]+)$', 2) AS INTEGER) AS n FROM i) CROSS JOIN (VALUES (1, 1), (2, 0), (3, 2)) s(rank, step) WHERE f <> ''"""
_SUM = """SELECT count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg,
    CAST(sum(n_retrieved) AS BIGINT) AS total_retrieved, CAST(sum(n_relevant) AS BIGINT) AS total_relevant FROM m"""
_EXACT = f"WITH {_ITEMS}, " + _metrics_sql(_GOT, _REL, "doc_key = rel_key")
_SUB = f"WITH {_ITEMS}, " + _metrics_sql(_GOT, _REL, "(contains(doc_key, rel_key) OR contains(rel_key, doc_key))")
_DOCS = """docs AS (SELECT doc_key, source_type, min(title) AS title, min(url) AS url FROM (SELECT chunk_id AS doc_key, 'pdf' AS source_type, coalesce(metadata.file_name, 'Unknown') AS title, metadata.download_url AS url FROM chunk
    UNION ALL SELECT url, 'lessons_learned', subject, url FROM lessons WHERE url <> 'url' AND subject <> 'Error') GROUP BY 1, 2)"""
_REFS = f"{_ITEMS}, refs AS (SELECT id, pos, trim(r) AS doc_key FROM (SELECT id, unnest(relevant_chunk_ids) AS r, unnest(range(0, len(relevant_chunk_ids))) AS pos FROM i) WHERE trim(r) <> '')"
_METRIC = "SELECT query_id, n_retrieved, n_relevant, precision, recall, reciprocal_rank, hit, ndcg FROM m"
ORACLES = {
    "knn_index": "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "knn_topk": f"WITH {_KNN} SELECT query_id, doc_id, round(distance, 5) AS distance, rank FROM k",
    "knn_threshold": f"WITH {_KNN} SELECT query_id, doc_id, round(distance, 5) AS distance, rank FROM k WHERE distance <= 1.4",
    "nearest_document": f"WITH {_KNN} SELECT query_id, k.doc_id, lang, source_type, n_chars FROM k JOIN documents d ON d.doc_id = k.doc_id WHERE rank = 1",
    "cosine_to_next": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))
        / (sqrt(list_sum(list_transform(a.e, lambda z: z * z))) * sqrt(list_sum(list_transform(b.e, lambda z: z * z)))), 5) AS cosine FROM v a JOIN v b ON b.id = a.id + 1""",
    "vector_norms": """WITH v AS (SELECT label, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * z))) AS n FROM embeddings) SELECT label, count(*) AS n, round(min(n), 5) AS least, round(max(n), 5) AS most FROM v GROUP BY 1""",
    "retrieval_metrics_by_query": f"{_LABEL_METRICS} {_METRIC}",
    "retrieval_metrics": f"{_LABEL_METRICS} {_SUM}",
    "item_metrics_exact": f"{_EXACT} {_METRIC}",
    "item_metrics_substring": f"{_SUB} {_METRIC}",
    "item_metrics_summary": f"{_SUB} {_SUM}",
    "doc_lookup": f"WITH {_REFS}, {_DOCS} SELECT id, pos, refs.doc_key, source_type, title FROM refs JOIN docs ON docs.doc_key = refs.doc_key",
    "prefix_lookup": f"""WITH {_REFS}, c AS (SELECT regexp_replace(chunk_id, '_[0-9]+$', '') AS f, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id FROM chunk) GROUP BY 1)
        SELECT DISTINCT id, c.f AS file_name, n_chunks FROM refs JOIN c ON c.f = regexp_replace(refs.doc_key, '_[0-9]+$', '')""",
    "citations": f"""WITH {_REFS}, {_DOCS}, l AS (SELECT id, min(pos) AS pos, (CASE WHEN source_type = 'lessons_learned' THEN '- Lesson Learned - ' || title ELSE '- ' || title END) || ': ' || coalesce(url, 'no link') AS line
        FROM refs JOIN docs ON docs.doc_key = refs.doc_key GROUP BY id, line)
        SELECT id, chr(10) || chr(10) || '4. Sources:' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) AS sources FROM l GROUP BY id""",
    "context_block": f"""WITH {_REFS}, t AS (SELECT chunk_id AS doc_key, max(content) AS content, min(title) AS title, min(metadata.file_name) AS file FROM chunk GROUP BY 1),
        b AS (SELECT id, refs.doc_key, min(pos) AS pos, any_value('Source: ' || coalesce(file, 'Unknown Source') || chr(10) || 'Title: ' || coalesce(title, 'No Title') || chr(10) || 'Content: ' || coalesce(content, '')) AS block FROM refs JOIN t ON t.doc_key = refs.doc_key GROUP BY id, refs.doc_key),
        c AS (SELECT id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM b GROUP BY id) SELECT id, md5(context) AS context_md5, length(context) AS chars FROM c""",
    "dedupe_last": "SELECT question, max(id) AS id, arg_max(coalesce(len(relevant_chunk_ids), -1), id) AS n_refs FROM test_database_open_minded WHERE question IS NOT NULL GROUP BY 1",
}
