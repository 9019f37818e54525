"""Queries on text: cleaning, chunking, similarity, links, lessons and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import links as L
from tessella.functions import similarity as Y
from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators import lookup as U
from tessella.operators.weights import sentence_weights
from tessella.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def md_clean(spark, d):
    """Markdown made of every document's title and text, and its plain text."""
    md = F.concat(F.lit("## "), F.coalesce("title", F.lit("none")), F.lit("\n\n**Source:** _"), F.coalesce("source", F.lit("none")), F.lit("_ [link](https://x.example/a)\n\n-----\n<!-- Page 1 -->\n"), F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", F.md5(T.markdown_to_text(md)).alias("plain_md5"))


def rouge_preprocess(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.rouge_text(F.col("text"))).alias("flat_md5"))


def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(s).alias("n_sentences"), F.length(s[0]).alias("first_chars"))


def section_extract_lenient(spark, d):
    """Sections of a Markdown by heading lines alone; text before the first heading belongs to none."""
    md = F.concat(F.lit("# "), F.coalesce("title", F.lit("Document")), F.lit("\n"), F.coalesce("text", F.lit("")))
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(md, "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("line").rlike("^#{1,6}[ \t]+[^ \t]") | F.col("line").rlike("^[A-Z][a-zA-Z ]+: ")
    marked = lines.withColumn("s", F.sum(head.cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return marked.where("s > 0").groupBy("doc_id", "s").agg(body.alias("body")).select("doc_id", F.col("s").alias("section"), F.length("body").alias("chars"), F.md5("body").alias("body_md5"))


def _markdown(spark, d):
    """Markdown of a document: its title as heading, then its text."""
    return _docs(spark, d).where("text is not null and text <> ''").select("doc_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), "text").alias("md"))


def section_chunks(spark, d):
    return C.explode_pieces(_markdown(spark, d), "doc_id", "md", lambda t: C.tidy_sections(C.extract_sections(t))).where("words >= 7")


def recursive_chunks(spark, d):
    return C.explode_pieces(_docs(spark, d), "doc_id", "text", C.recursive_split).select("doc_id", "chunk_index", "total_chunks", "content")


def recursive_chunks_overlap(spark, d):
    return C.explode_pieces(_docs(spark, d), "doc_id", "text", lambda t: C.add_overlap(C.recursive_split(t))).select("doc_id", "chunk_index", "content")


def window_chunks(spark, d):
    return C.explode_pieces(_docs(spark, d), "doc_id", "text", C.window_split).select("doc_id", "chunk_index", "total_chunks", "content")


def semantic_chunks(spark, d):
    return C.explode_pieces(_docs(spark, d), "doc_id", "text", C.semantic_split).select("doc_id", "chunk_index", "total_chunks", "content")


def semantic_adjacent_sim(spark, d):
    """Mean similarity of neighbouring sentences of every document with two or more."""

    @F.pandas_udf("double")
    def mean(texts: pd.Series) -> pd.Series:
        near = [C.adjacent_similarity(C.split_sentences(t)) for t in texts]
        return pd.Series([sum(x) / len(x) if x else None for x in near], dtype="float64")

    return _docs(spark, d).where("text is not null").select("doc_id", F.round(mean("text"), 6).alias("mean_similarity")).where("mean_similarity is not null")


def _weights(spark, d):
    return sentence_weights(_docs(spark, d), "doc_id", "text")


def semantic_tfidf(spark, d):
    """Terms and largest weight of every sentence."""
    return _weights(spark, d).select("doc_id", "s", "n_terms", F.round("largest", 5).alias("largest"), F.round("total", 4).alias("total"))


def semantic_next_similarity(spark, d):
    """Cosine of every sentence and the next one that share a term."""
    return _weights(spark, d).where("next_similarity is not null").select("doc_id", "s", F.round("next_similarity", 5).alias("similarity"))


def chunking_compare(spark, d):
    """Both chunkings of the documents that have both: chunk counts and mean lengths."""
    a = C.explode_pieces(_docs(spark, d), "doc_id", "text", C.recursive_split).groupBy("doc_id").agg(F.count("*").alias("n_recursive"), F.round(F.avg("chars"), 6).alias("mean_recursive"))
    b = C.explode_pieces(_docs(spark, d), "doc_id", "text", C.semantic_split).groupBy("doc_id").agg(F.count("*").alias("n_semantic"), F.round(F.avg("chars"), 6).alias("mean_semantic"))
    return a.join(b, "doc_id")


def _items(spark, d):
    return table(spark, d, "test_database_open_minded").dropDuplicates(["id"])


def rouge12(spark, d):
    """ROUGE-1 and ROUGE-2 of question and answer of every item."""
    scores = Y.rouge_n(_items(spark, d), "id", F.col("expected_answer"), F.col("question"))
    return scores.select("id", *(F.round(c, 5).alias(c) for c in scores.columns[1:]))


def generation_summary(spark, d):
    """Means over all items, and the difference of both F values, as value and per cent."""
    m = rouge12(spark, d).agg(F.count("*").alias("n"), F.avg("rouge1_f").alias("x"), F.avg("rouge2_f").alias("y"), F.count_if(F.col("rouge1_f") == 0).alias("n_zero"))
    return m.select("n", "n_zero", F.round("x", 5).alias("rouge1_f"), F.round("y", 5).alias("rouge2_f"), F.round(F.col("x") - F.col("y"), 5).alias("difference"), F.round((F.col("x") - F.col("y")) * 100, 3).alias("percent"))


def rouge_l(spark, d):
    """ROUGE-L of question and answer: the larger of raw and normalised texts, and of the sentence-aligned F."""
    return _items(spark, d).select("id", Y.rouge_l_best(F.col("expected_answer"), F.col("question")).alias("s")).select("id", *(F.round(f"s.{c}", 6).alias(f"rouge_l_{c}") for c in "prf"))


def sentence_rouge_l(spark, d):
    text = table(spark, d, "lessons").where("url <> 'url'").select("url", "abstract", "recommendations").distinct()
    return text.select("url", F.round(Y.sentence_rouge_l(F.col("abstract"), F.col("recommendations")), 6).alias("mean_best"))


def judge_score_parse(spark, d):
    reply = F.when(F.col("id") % 7 == 0, F.lit("no score, sorry")).otherwise(F.concat_ws(", ", F.col("num_docs_retrieved").cast("string"), (F.col("id") % 13).cast("string"), (F.col("answer_length") % 10).cast("string")))
    s = Y.judge_scores(reply)
    return table(spark, d, "rag_queries").dropDuplicates(["id"]).select("id", *(F.round(s[i], 6).alias(n) for i, n in enumerate(("relevance", "accuracy", "clarity"))))


def url_filename(spark, d):
    url = F.col("metadata.download_url")
    return table(spark, d, "chunk").where(url.isNotNull()).select(url.alias("url")).distinct().select("url", L.file_of_link(F.col("url")).alias("file_name"))


def safe_title(spark, d):
    return table(spark, d, "chunk").select("title").where("title is not null").distinct().select("title", L.safe_title(F.col("title")).alias("safe"))


def download_links(spark, d):
    return _docs(spark, d).where("file_name is not null").select("file_name").distinct().select("file_name", L.download_link(F.col("file_name")).alias("url"))


def _known_links(spark, d):
    return table(spark, d, "chunk").select(F.col("metadata.file_name").alias("file"), F.col("metadata.download_url").alias("url"))


def download_url_resolve(spark, d):
    """Links for every file name of documents, one in three written in capitals and one in five as a plain word."""
    raw = _docs(spark, d).where("file_name is not null").select("file_name", "doc_id").groupBy("file_name").agg(F.min("doc_id").alias("k"))
    files = raw.select(F.when(F.col("k") % 3 == 0, F.upper("file_name")).when(F.col("k") % 5 == 0, F.concat(F.lit("report "), F.col("k").cast("string"), F.lit(".pdf"))).otherwise(F.col("file_name")).alias("file_name"))
    return U.resolve_links(files, _known_links(spark, d))


def _log(spark, d):
    """A download log made from the known links: two lines per file, the second one missing for one in four."""
    files = _known_links(spark, d).where("file is not null and url is not null").groupBy("file").agg(F.min("url").alias("url"))
    n = F.row_number().over(Window.partitionBy(F.substring("file", -6, 1)).orderBy("file"))
    numbered = files.select(F.substring("file", -6, 1).alias("log"), n.alias("n"), "file", "url")
    a = numbered.select("log", (F.col("n") * 2).alias("line_no"), F.concat(F.lit("2024-01-01 - INFO - Downloading from: "), "url").alias("line"))
    b = numbered.where("n % 4 <> 0").select("log", (F.col("n") * 2 + 1).alias("line_no"), F.concat(F.lit("2024-01-01 - INFO - Downloaded "), F.col("n").cast("string"), F.lit("/8000: "), "file").alias("line"))
    return a.unionByName(b)


def log_line_pairs(spark, d):
    return U.pair_log_lines(_log(spark, d))


def log_url_scan(spark, d):
    """Links with their attachment flag, as a pattern over whole lines finds them."""
    pattern = r"/downloads/([^?/]+)[?]attachment=true"
    return _log(spark, d).select(F.regexp_extract("line", pattern, 1).alias("file")).where("file <> ''").groupBy("file").agg(F.count("*").alias("n"))


def html_links(spark, d):
    """Links to downloads out of a page made for every file."""
    page = F.concat(F.lit('<div class="card"><h3 class="title">'), "file", F.lit('</h3><a href="'), "url", F.lit('">PDF</a><a href="/about">x</a></div>'))
    files = _known_links(spark, d).where("file is not null and url is not null").distinct()
    found = files.select("file", F.explode(F.regexp_extract_all(page, F.lit('href="([^"]*/downloads/[^"]*[.]pdf[^"]*)"'), F.lit(1))).alias("link"))
    return found.groupBy("file").agg(F.count("*").alias("n_links"), F.min("link").alias("link"))


def _lessons(spark, d):
    """Lessons without header rows, 'None' and '' as null, the latest scrape of each; ``failed`` where scraping failed."""
    raw = table(spark, d, "lessons").where("url is not null and url <> 'url'")
    names = ("subject", "abstract", "driving_event", "lessons_learned", "recommendations", "evidence", "program_relation", "program_phase", "mission_directorate", "topics")
    failed = F.coalesce(F.col("subject") == "Error", F.lit(False))
    clean = [F.when(F.trim(n).isin("None", "", "Error"), None).otherwise(F.col(n)).alias(n) for n in names]
    w = Window.partitionBy("url").orderBy(F.desc("scraped_at"), F.desc("abstract"))
    return raw.select("url", "scraped_at", failed.alias("failed"), *clean).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


PARTS = (("Subject", "subject"), ("Abstract", "abstract"), ("Driving Event", "driving_event"), ("Lessons Learned", "lessons_learned"), ("Recommendations", "recommendations"), ("Evidence", "evidence"), ("Topics", "topics"))


def lesson_text(spark, d):
    """One text per lesson: labelled parts, those missing left out."""
    text = F.concat_ws("\n\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), c)) for label, c in PARTS])
    return _lessons(spark, d).where("not failed").select("url", F.md5(text).alias("text_md5"), F.length(text).alias("chars"))


def prototype_text(spark, d):
    fields = ("subject", "abstract", "driving_event", "lessons_learned", "recommendations")
    text = F.concat(*[F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("")), F.lit("\n")) for c in fields])
    return _lessons(spark, d).where("not failed").select("url", F.md5(text).alias("text_md5"))


def lesson_scan(spark, d):
    return _lessons(spark, d).groupBy("failed", "mission_directorate", "program_phase").agg(F.count("*").alias("n"), F.count("evidence").alias("with_evidence"))


def union_sources(spark, d):
    """Chunks and lessons under one schema, counted by kind and section level."""
    a = table(spark, d, "chunk").select(F.lit("pdf").alias("source_type"), "chunk_id", "section_level").distinct()
    b = table(spark, d, "lessons").where("url <> 'url'").select(F.lit("lessons_learned").alias("source_type"), "url").distinct()
    return a.unionByName(b, allowMissingColumns=True).groupBy("source_type", "section_level").agg(F.count("*").alias("n"), F.count("url").alias("with_url"))


def _referenced(spark, d):
    """(doc_key, file_name) of every reference; lesson links have no file."""
    refs = _items(spark, d).select(F.explode("relevant_chunk_ids").alias("r")).select(F.trim("r").alias("doc_key")).where("doc_key <> ''")
    return refs.select("doc_key", F.nullif(F.regexp_extract("doc_key", "^(.*[.]pdf)_[0-9]+$", 1), F.lit("")).alias("file_name"))


def incremental_anti(spark, d):
    """Referenced keys that neither chunks nor lessons have yet, with their number of references."""
    have = table(spark, d, "chunk").select(F.col("chunk_id").alias("doc_key")).unionByName(table(spark, d, "lessons").select(F.col("url").alias("doc_key")))
    return _referenced(spark, d).join(have, "doc_key", "left_anti").groupBy("doc_key").agg(F.count("*").alias("n_references"))


def existing_semi(spark, d):
    """References by file, for files that have chunks."""
    have = table(spark, d, "chunk").select(F.col("metadata.file_name").alias("file_name"))
    return _referenced(spark, d).join(have, "file_name", "left_semi").groupBy("file_name").agg(F.count("*").alias("n"))


def shared_files(spark, d):
    """Files that have chunks and are referenced."""
    a = table(spark, d, "chunk").select(F.col("metadata.file_name").alias("file_name"))
    return a.intersect(_referenced(spark, d).select("file_name")).where("file_name is not null")


def model_assignment(spark, d):
    """A model for every user and task, drawn evenly and always the same."""
    users = table(spark, d, "rag_queries").select(F.lower(F.trim("username")).alias("user")).where("user is not null").distinct()
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "user", "task")), 1, 2), 16, 10).cast("int") % 2
    return users.select("user", F.explode(F.array(*[F.lit(f"task{i}") for i in range(1, 6)])).alias("task")).select("user", "task", F.when(pick == 0, "OpenAI").otherwise("Llama").alias("model"))


QUERIES = {
    f.__name__: f
    for f in (
        md_clean, rouge_preprocess, sentence_split, section_extract_lenient, section_chunks, recursive_chunks, recursive_chunks_overlap, window_chunks, semantic_chunks, semantic_adjacent_sim, semantic_tfidf, semantic_next_similarity, chunking_compare,
        rouge12, generation_summary, rouge_l, sentence_rouge_l, judge_score_parse, url_filename, safe_title, download_links, download_url_resolve, log_line_pairs, log_url_scan, html_links,
        lesson_text, prototype_text, lesson_scan, union_sources, incremental_anti, existing_semi, shared_files, model_assignment,
    )
}

_WS = r"[ \t\n\r\f]+"
_ITEMS = "i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM test_database_open_minded) WHERE rn = 1)"
_REFD = "refd AS (SELECT doc_key, nullif(regexp_extract(doc_key, '^(.*[.]pdf)_[0-9]+$', 1), '') AS file_name FROM (SELECT trim(r) AS doc_key FROM (SELECT unnest(relevant_chunk_ids) AS r FROM i)) WHERE doc_key <> '')"
_LINKS = "links AS (SELECT metadata.file_name AS file, metadata.download_url AS url FROM chunk)"
_LESSONS = (
    "l AS (SELECT * FROM (SELECT url, coalesce(subject = 'Error', false) AS failed, "
    + ", ".join(f"CASE WHEN trim({c}) IN ('None', '', 'Error') THEN NULL ELSE {c} END AS {c}" for c in ("subject", "abstract", "driving_event", "lessons_learned", "recommendations", "evidence", "program_relation", "program_phase", "mission_directorate", "topics"))
    + ", row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, CASE WHEN trim(abstract) IN ('None', '', 'Error') THEN NULL ELSE abstract END DESC) AS rn FROM lessons WHERE url <> 'url') WHERE rn = 1)"
)
_RAW = rf"trim(regexp_replace({{c}}, '{_WS}', ' ', 'g'))"
_FLAT = rf"regexp_replace(trim(regexp_replace(lower({{c}}), '{_WS}', ' ', 'g')), '[^\p{{{{L}}}}\p{{{{N}}}}_ .]', '', 'g')"


def _grams(words: str, n: int) -> str:
    gram = " || ' ' || ".join(f"{words}[k + {j}]" if j else f"{words}[k]" for j in range(n))
    return f"CASE WHEN len({words}) < {n} THEN [] ELSE list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda k: {gram})) END"


def _rouge_sql() -> str:
    cols = ", ".join(f"string_split({form.format(c=f'coalesce({c}, chr(39) || chr(39))').replace('chr(39) || chr(39)', chr(39) * 2)}, ' ') AS {name}_{side}" for name, form in (("r", _RAW), ("f", _FLAT)) for side, c in (("a", "expected_answer"), ("b", "question")))
    grams = ", ".join(f"{_grams(f'{name}_{side}', n)} AS {name}{n}_{side}" for name in "rf" for n in (1, 2) for side in "ab")
    inter = ", ".join(f"len(list_intersect({x}_a, {x}_b)) AS {x}_n, len({x}_a) AS {x}_la, len({x}_b) AS {x}_lb" for x in ("r1", "r2", "f1", "f2"))
    pr = ", ".join(f"coalesce({x}_n / nullif({x}_lb, 0), 0) AS {x}_p, coalesce({x}_n / nullif({x}_la, 0), 0) AS {x}_r" for x in ("r1", "r2", "f1", "f2"))
    fs = ", ".join(f"2.0 * {x}_p * {x}_r / ({x}_p + {x}_r + 1e-8) AS {x}_f" for x in ("r1", "r2", "f1", "f2"))
    out = ", ".join(f"round(greatest(r{n}_{c}, f{n}_{c}), 5) AS rouge{n}_{c}" for n in (1, 2) for c in "prf")
    return f"WITH {_ITEMS}, w AS (SELECT id, {cols} FROM i), g AS (SELECT id, {grams} FROM w), c AS (SELECT id, {inter} FROM g), s AS (SELECT id, {pr} FROM c), z AS (SELECT *, {fs} FROM s), rouge AS (SELECT id, {out} FROM z)"


_SEPS = (("chr(10) || chr(10) || chr(10)", 3), ("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("', '", 2), ("' '", 1))
_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


def _recursive_sql() -> str:
    """The recursive splitter as a recursive query: per separator its last start within the limit, 0-based."""
    at = ", ".join(f"CASE WHEN strpos(substr(rest, 1, 1000 + {n}), {s}) = 0 THEN -1 ELSE length(substr(rest, 1, 1000 + {n})) - strpos(reverse(substr(rest, 1, 1000 + {n})), reverse({s})) - {n} + 1 END AS p{i}" for i, (s, n) in enumerate(_SEPS))
    cut = "CASE " + " ".join(f"WHEN p{i} > 0 THEN p{i} + {n}" for i, (_, n) in enumerate(_SEPS)) + " ELSE CASE WHEN strpos(substr(rest, 1001, 20), ' ') > 0 THEN 999 + strpos(substr(rest, 1001, 20), ' ') ELSE 1000 END END"
    step = f"SELECT doc_id, n, rest, CASE WHEN length(rest) <= 1000 THEN length(rest) ELSE {cut} END AS cut FROM (SELECT *, {at} FROM {{src}})"
    return f"""WITH RECURSIVE s AS (SELECT doc_id, 0 AS n, CAST(NULL AS VARCHAR) AS content, text AS rest FROM documents WHERE text IS NOT NULL AND text <> ''
        UNION ALL SELECT doc_id, n + 1, CASE WHEN length(rest) <= 1000 THEN rest ELSE {_TRIM.format(x='substr(rest, 1, cut)')} END, CASE WHEN length(rest) <= 1000 THEN '' ELSE {_TRIM.format(x='substr(rest, cut + 1)')} END
        FROM ({step.format(src='s')}) WHERE rest <> ''),
        c AS (SELECT doc_id, n - 1 AS chunk_index, content, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM s WHERE n > 0)"""


_WEIGHTS = rf"""sent AS (SELECT doc_id, unnest(range(0, len(ss))) AS s, unnest(ss) AS sentence FROM (SELECT doc_id, string_split(regexp_replace({_RAW.format(c='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL)),
    terms AS (SELECT doc_id, s, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]{{2,}}')) AS term FROM sent), tf AS (SELECT doc_id, s, term, count(*) AS tf FROM terms GROUP BY 1, 2, 3), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
    n AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1), raw AS (SELECT tf.doc_id, s, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.doc_id = tf.doc_id AND df.term = tf.term JOIN n ON n.doc_id = tf.doc_id),
    z AS (SELECT doc_id, s, sqrt(sum(w * w)) AS size FROM raw GROUP BY 1, 2), w AS (SELECT raw.doc_id, raw.s, term, w / size AS w FROM raw JOIN z ON z.doc_id = raw.doc_id AND z.s = raw.s)"""
ORACLES = {
    "semantic_tfidf": f"WITH {_WEIGHTS} SELECT doc_id, s, count(*) AS n_terms, round(max(w), 5) AS largest, round(sum(w), 4) AS total FROM w GROUP BY 1, 2",
    "semantic_next_similarity": f"WITH {_WEIGHTS} SELECT a.doc_id, a.s, round(sum(a.w * b.w), 5) AS similarity FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.s = a.s + 1 AND b.term = a.term GROUP BY 1, 2",
    "md_clean": r"""WITH m AS (SELECT doc_id, '## ' || coalesce(title, 'none') || chr(10) || chr(10) || '**Source:** _' || coalesce(source, 'none') || '_ [link](https://x.example/a)' || chr(10) || chr(10) || '-----' || chr(10) || '<!-- Page 1 -->' || chr(10) || coalesce(text, '') AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
        '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}[ \t]+', '', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '_(.*?)_', '\1', 'g'), '`(.*?)`', '\1', 'g'), '-----+', chr(10) || chr(10), 'g'), '<!-- Page [0-9]+ -->', '', 'g'),
        '\n{3,}', chr(10) || chr(10) || chr(10), 'g')) AS plain_md5 FROM m""",
    "rouge_preprocess": f"SELECT doc_id, md5({_FLAT.format(c='text').replace('{{', '{').replace('}}', '}')}) AS flat_md5 FROM documents WHERE text IS NOT NULL",
    "sentence_split": rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace({_RAW.format(c='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s) AS n_sentences, length(s[1]) AS first_chars FROM s""",
    "section_extract_lenient": r"""WITH m AS (SELECT doc_id, string_split('# ' || coalesce(title, 'Document') || chr(10) || coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM m),
        h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}[ \t]+[^ \t]') OR regexp_matches(line, '^[A-Z][a-zA-Z ]+: ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM l),
        b AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY pos) AS body FROM h WHERE s > 0 GROUP BY 1, 2) SELECT doc_id, CAST(s AS BIGINT) AS section, length(body) AS chars, md5(body) AS body_md5 FROM b""",
    "recursive_chunks": f"{_recursive_sql()} SELECT doc_id, chunk_index, total_chunks, content FROM c",
    "recursive_chunks_overlap": f"""{_recursive_sql()}, o AS (SELECT *, right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), 100) AS tail FROM c)
        SELECT doc_id, chunk_index, (CASE WHEN tail IS NULL THEN '' WHEN substr(tail, 1, 1) IN (' ', chr(9), chr(10), chr(13), chr(12)) THEN tail WHEN strpos(tail, ' ') > 0 THEN substr(tail, strpos(tail, ' ') + 1) ELSE '' END) || content AS content FROM o""",
    "rouge12": _rouge_sql().replace("{{", "{").replace("}}", "}") + " SELECT * FROM rouge",
    "generation_summary": _rouge_sql().replace("{{", "{").replace("}}", "}") + """, m AS (SELECT count(*) AS n, avg(rouge1_f) AS x, avg(rouge2_f) AS y, count(*) FILTER (WHERE rouge1_f = 0) AS n_zero FROM rouge)
        SELECT n, n_zero, round(x, 5) AS rouge1_f, round(y, 5) AS rouge2_f, round(x - y, 5) AS difference, round((x - y) * 100, 3) AS percent FROM m""",
    "judge_score_parse": """WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM rag_queries) WHERE rn = 1),
        r AS (SELECT id, string_split(CASE WHEN id % 7 = 0 THEN 'no score, sorry' ELSE concat_ws(', ', CAST(num_docs_retrieved AS VARCHAR), CAST(id % 13 AS VARCHAR), CAST(answer_length % 10 AS VARCHAR)) END, ',') AS p FROM q),
        v AS (SELECT id, len(p) AS n, TRY_CAST(trim(p[1]) AS DOUBLE) AS a, TRY_CAST(trim(p[2]) AS DOUBLE) AS b, TRY_CAST(trim(p[3]) AS DOUBLE) AS c FROM r)
        SELECT id, """ + ", ".join(f"round(CASE WHEN n = 3 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN greatest(0.0, least(1.0, {x} / 10.0)) ELSE 0.5 END, 6) AS {y}" for x, y in (("a", "relevance"), ("b", "accuracy"), ("c", "clarity"))) + " FROM v",
    "url_filename": "SELECT DISTINCT metadata.download_url AS url, replace(split_part(split_part(metadata.download_url, '/downloads/', 2), '?', 1), '%20', ' ') AS file_name FROM chunk WHERE metadata.download_url IS NOT NULL",
    "safe_title": r"SELECT DISTINCT title, substr(regexp_replace(title, '[^\p{L}\p{N}]', '_', 'g'), 1, 100) AS safe FROM chunk WHERE title IS NOT NULL",
    "download_links": r"""WITH f AS (SELECT DISTINCT file_name, nullif(regexp_extract(file_name, '([0-9]{8,})', 1), '') AS n, nullif(regexp_extract(file_name, '(?i)([A-Z]{2,}-[A-Z]+-[0-9]+)', 1), '') AS r FROM documents WHERE file_name IS NOT NULL)
        SELECT file_name, CASE WHEN coalesce(n, r) IS NOT NULL THEN 'https://reports.example/api/citations/' || coalesce(n, r) || '/downloads/' || file_name ELSE 'https://reports.example/api/citations/downloads/' || file_name END AS url FROM f""",
    "download_url_resolve": rf"""WITH {_LINKS}, k AS (SELECT file, min(url) AS url FROM links WHERE file IS NOT NULL AND url IS NOT NULL GROUP BY 1),
        lo AS (SELECT lower(file) AS low, arg_min(url, file) AS url FROM k GROUP BY 1), st AS (SELECT regexp_replace(lower(file), '\.[a-z0-9]+$', '') AS stem, arg_min(url, file) AS url FROM k GROUP BY 1),
        f AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN upper(file_name) WHEN k % 5 = 0 THEN 'report ' || CAST(k AS VARCHAR) || '.pdf' ELSE file_name END AS file_name FROM (SELECT file_name, min(doc_id) AS k FROM documents WHERE file_name IS NOT NULL GROUP BY 1)),
        j AS (SELECT f.file_name, k.url AS a, lo.url AS b, nullif(regexp_extract(f.file_name, '([0-9]{{8,}})', 1), '') AS num, nullif(regexp_extract(f.file_name, '(?i)([A-Z]{{2,}}-[A-Z]+-[0-9]+)', 1), '') AS rep, st.url AS e FROM f
              LEFT JOIN k ON k.file = f.file_name LEFT JOIN lo ON lo.low = lower(f.file_name) LEFT JOIN st ON st.stem = regexp_replace(lower(f.file_name), '\.[a-z0-9]+$', ''))
        SELECT file_name, coalesce(a, b, 'https://reports.example/api/citations/' || coalesce(num, rep) || '/downloads/' || file_name || '?attachment=true', e, 'https://reports.example/search?q=' || replace(replace(file_name, ' ', '%20'), '.pdf', '')) AS url,
        CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'case' WHEN coalesce(num, rep) IS NOT NULL THEN 'number' WHEN e IS NOT NULL THEN 'partial' ELSE 'search' END AS step FROM j""",
    "log_line_pairs": f"""WITH {_LINKS}, f AS (SELECT file, min(url) AS url FROM links WHERE file IS NOT NULL AND url IS NOT NULL GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY substr(file, -6, 1) ORDER BY file) AS n FROM f) SELECT file, url FROM n WHERE n % 4 <> 0""",
    "log_url_scan": f"WITH {_LINKS}, f AS (SELECT file, min(url) AS url FROM links WHERE file IS NOT NULL AND url IS NOT NULL GROUP BY 1) SELECT regexp_extract(url, '/downloads/([^?/]+)[?]attachment=true', 1) AS file, count(*) AS n FROM f WHERE regexp_matches(url, '/downloads/([^?/]+)[?]attachment=true') GROUP BY 1",
    "html_links": f"WITH {_LINKS} SELECT file, count(DISTINCT url) AS n_links, min(url) AS link FROM links WHERE file IS NOT NULL AND url IS NOT NULL AND contains(url, '/downloads/') AND contains(url, '.pdf') GROUP BY 1",
    "lesson_text": f"WITH {_LESSONS}, t AS (SELECT url, concat_ws(chr(10) || chr(10), " + ", ".join(f"'{a}: ' || {c}" for a, c in PARTS) + ") AS t FROM l WHERE NOT failed) SELECT url, md5(t) AS text_md5, length(t) AS chars FROM t",
    "prototype_text": f"WITH {_LESSONS} SELECT url, md5(" + " || ".join(f"'{c}: ' || coalesce({c}, '') || chr(10)" for c in ("subject", "abstract", "driving_event", "lessons_learned", "recommendations")) + ") AS text_md5 FROM l WHERE NOT failed",
    "lesson_scan": f"WITH {_LESSONS} SELECT failed, mission_directorate, program_phase, count(*) AS n, count(evidence) AS with_evidence FROM l GROUP BY 1, 2, 3",
    "union_sources": """WITH u AS (SELECT DISTINCT 'pdf' AS source_type, chunk_id AS k, section_level, CAST(NULL AS VARCHAR) AS url FROM chunk UNION ALL SELECT DISTINCT 'lessons_learned', url, CAST(NULL AS INTEGER), url FROM lessons WHERE url <> 'url')
        SELECT source_type, section_level, count(*) AS n, count(url) AS with_url FROM u GROUP BY 1, 2""",
    "incremental_anti": f"WITH {_ITEMS}, {_REFD} SELECT doc_key, count(*) AS n_references FROM refd WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.chunk_id = doc_key) AND NOT EXISTS (SELECT 1 FROM lessons l WHERE l.url = doc_key) GROUP BY 1",
    "existing_semi": f"WITH {_ITEMS}, {_REFD} SELECT file_name, count(*) AS n FROM refd WHERE file_name IN (SELECT metadata.file_name FROM chunk WHERE metadata.file_name IS NOT NULL) GROUP BY 1",
    "shared_files": f"WITH {_ITEMS}, {_REFD} SELECT metadata.file_name AS file_name FROM chunk WHERE metadata.file_name IS NOT NULL INTERSECT SELECT file_name FROM refd",
    "model_assignment": """WITH u AS (SELECT DISTINCT lower(trim(username)) AS "user" FROM rag_queries WHERE username IS NOT NULL), x AS (SELECT "user", 'task' || i AS task FROM u CROSS JOIN (SELECT unnest(range(1, 6)) AS i))
        SELECT "user", task, CASE WHEN substr(md5("user" || '|' || task), 2, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'OpenAI' ELSE 'Llama' END AS model FROM x""",
}
