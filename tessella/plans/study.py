"""Queries over the interaction logs and questionnaires."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import model_family
from tessella.operators import study as S
from tessella.operators.ordering import in_order
from tessella.tables import table


def _answers(spark, d):
    return table(spark, d, "user_answers")


def _times(spark, d, most=10.0):
    return S.task_completions(_answers(spark, d), table(spark, d, "rag_queries"), max_minutes=most)


def task_completion(spark, d):
    return _times(spark, d).select("user", "task_id", "model", F.round("minutes", 6).alias("minutes"), "attempts")


def completion_summary(spark, d):
    return S.time_summary(_times(spark, d))


def task_stats(spark, d):
    return S.time_summary(_times(spark, d), "task_id")


def model_stats(spark, d):
    return S.time_summary(_times(spark, d, 15.0), "model")


def task_model_stats(spark, d):
    return S.time_summary(_times(spark, d, 15.0), "task_id", "model")


def model_summary(spark, d):
    return _times(spark, d, 15.0).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("n_tasks"), F.countDistinct("user").alias("n_users"), F.round(F.avg("attempts"), 6).alias("mean_attempts"))


def unusual_cases(spark, d):
    return _times(spark, d, None).where("minutes > 15").groupBy(F.lit("exceeded_max_time").alias("issue"), "task_id").agg(F.count("*").alias("n"), F.round(F.max("minutes"), 6).alias("longest"))


def true_success_rate(spark, d):
    """Users who solved a task over users who tried it."""
    per = S.attempts_to_success(_answers(spark, d)).groupBy("task_id", "user").agg(F.max("solved").alias("solved"))
    return per.groupBy("task_id").agg(F.count("*").alias("users"), F.count_if("solved").alias("solved"), F.round(F.count_if("solved") * 100.0 / F.count("*"), 6).alias("percent"))


def attempts_to_success(spark, d):
    """Zero rows for every task and the two model families without attempts."""
    a = S.attempts_to_success(_answers(spark, d)).where(F.col("model").isin("OpenAI", "Llama")).groupBy("task_id", "model").agg(
        F.count("*").alias("users"), F.round(F.avg("attempts"), 6).alias("mean_attempts"), F.min("attempts").alias("least_attempts"), F.max("attempts").alias("most_attempts")
    )
    grid = spark.range(1, 6).select(F.concat(F.lit("task"), "id").alias("task_id"), F.explode(F.array(F.lit("OpenAI"), F.lit("Llama"))).alias("model"))
    skips = S.skipped_tasks(_answers(spark, d)).withColumnRenamed("task", "task_id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "least_attempts", "most_attempts", "n_skips")]
    return grid.join(a, ["task_id", "model"], "left").join(skips, ["task_id", "model"], "left").select("task_id", "model", F.coalesce("mean_attempts", F.lit(0.0)).alias("mean_attempts"), *zero)


def user_task_attempts(spark, d):
    return S.submissions(_answers(spark, d)).where("user is not null").groupBy("user", "task_id").agg(F.count("*").alias("attempts"), F.max_by("task_num", "id").alias("task_num"))


def skips(spark, d):
    return S.skipped_tasks(_answers(spark, d))


def skipped_value_counts(spark, d):
    return S.clean_log(table(spark, d, "user_evaluations")).select(F.explode("skipped_tasks").alias("task")).groupBy("task").agg(F.count("*").alias("n"))


def entry_filters(spark, d):
    """How many rows each of the log filters keeps."""
    q = F.coalesce("query", F.lit(""))
    return S.clean_log(_answers(spark, d)).agg(
        F.count("*").alias("n_rows"), F.count_if((F.col("entry_type") == "submission") & F.col("task_id").startswith("task")).alias("n_submissions"),
        F.count_if((F.col("entry_type") == "query") & F.col("task_id").startswith("query_task")).alias("n_task_queries"),
        F.count_if(q.contains("Task skipped")).alias("n_skips"), F.count_if("is_correct").alias("n_correct"),
    )


def sus_scores(spark, d):
    return S.sus_scores(table(spark, d, "user_evaluations"))


def sus_summary(spark, d):
    one = S.sus_scores(table(spark, d, "user_evaluations")).agg(
        F.count("*").alias("n"), F.round(F.avg("sus_score"), 6).alias("mean_score"), F.round(F.median("sus_score"), 6).alias("median_score"), F.min("sus_score").alias("least"),
        F.max("sus_score").alias("most"), F.round(F.stddev_samp("sus_score"), 4).alias("std"),
    )
    return one.withColumn("grade", S.grade(F.col("mean_score")))


def sus_distribution(spark, d):
    rows = S.clean_log(table(spark, d, "user_evaluations")).select(F.explode("sus_responses").alias("question", "answer")).where("answer is not null")
    return S.crosstab(rows, "question", "answer", ("Strongly Disagree", "Disagree", "Neutral", "Agree", "Strongly Agree"))


def difficulty_crosstab(spark, d):
    rows = S.clean_log(table(spark, d, "user_evaluations")).select(F.explode("task_difficulty").alias("task", "difficulty")).where("difficulty is not null")
    return S.crosstab(rows, "task", "difficulty", S.DIFFICULTY)


def feedback_counts(spark, d):
    """Every grade of every feedback question, those nobody gave included."""
    wide = S.clean_log(table(spark, d, "user_evaluations")).select("id", *S.FEEDBACK)
    got = wide.unpivot("id", list(S.FEEDBACK), "question", "option").where("option is not null").groupBy("question", "option").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(q, f"{degree} {word}", i + 1) for q, word in S.FEEDBACK.items() for i, degree in enumerate(S.DEGREES)], "question string, option string, position int")
    return grid.join(got, ["question", "option"], "left").select("question", "option", "position", F.coalesce("n", F.lit(0)).alias("n"))


def processing_time_stats(spark, d):
    rows = S.clean_log(table(spark, d, "rag_queries")).where("processing_time >= 0")
    return rows.groupBy("task_id", model_family(F.trim("model")).alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("processing_time"), 6).alias("mean_seconds"), F.round(F.stddev_samp("processing_time"), 4).alias("std_seconds"))


def model_names(spark, d):
    return S.clean_log(table(spark, d, "rag_queries")).groupBy(F.col("model").alias("as_written"), model_family(F.trim("model")).alias("family")).agg(F.count("*").alias("n"))


def answer_after_query(spark, d):
    """Each row of a user's answers log with its turn, and the seconds since the row before."""
    rows = S.clean_log(_answers(spark, d)).where("user is not null and timestamp is not null").select("id", "user", F.unix_micros("timestamp").alias("us"))
    turns = in_order(rows, "user", F.col("us"), "id", width=86_400_000_000)  # a day
    return turns.select("id", F.col("_ordinal").alias("turn"), ((F.col("us") - F.col("_previous")) / 1e6).alias("seconds_since"))


def concept_eval(spark, d):
    """Which of five concepts an answer names, whether these are enough (two), and the first two that are missing."""
    concepts = F.array(*[F.lit(c) for c in CONCEPTS])
    low = F.lower(F.coalesce("answer", F.lit("")))
    found = F.filter(concepts, lambda c: F.contains(low, c))
    missing = F.filter(concepts, lambda c: ~F.contains(low, c))
    return S.submissions(_answers(spark, d)).select("id", F.size(found).alias("n_found"), (F.size(found) >= 2).alias("enough"), F.array_join(F.slice(missing, 1, 2), ", ").alias("hints"))


CONCEPTS = ("margin", "test", "load", "pressure", "measurement")


def all_tasks_done(spark, d):
    """Users with every one of their tasks solved or skipped."""
    rows = S.clean_log(_answers(spark, d)).where("user is not null and task_id like 'task%'")
    skip = F.coalesce("query", F.lit("")).startswith("Task skipped")
    per = rows.groupBy("user", "task_id").agg(F.coalesce(F.max("is_correct"), F.lit(False)).alias("ok"), F.max(skip).alias("skipped"))
    return per.groupBy("user").agg(F.count("*").alias("n_tasks"), F.bool_and(F.col("ok") | F.col("skipped")).alias("all_done"))


QUERIES = {
    f.__name__: f
    for f in (
        task_completion, completion_summary, task_stats, model_stats, task_model_stats, model_summary, unusual_cases, true_success_rate, attempts_to_success, user_task_attempts,
        skips, skipped_value_counts, entry_filters, sus_scores, sus_summary, sus_distribution, difficulty_crosstab, feedback_counts, processing_time_stats, model_names,
        answer_after_query, concept_eval, all_tasks_done,
    )
}

_FAMILY = """CASE WHEN lower(trim({c})) IN ('openai', 'gpt-4', 'gpt-4o-mini', 'gpt4', 'gpt') THEN 'OpenAI' WHEN lower(trim({c})) IN ('llama', 'llama3', 'llama-3', 'wizardlm2') THEN 'Llama' ELSE {e} END"""
_A = """a AS (SELECT * FROM (SELECT *, lower(trim(username)) AS "user", row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM user_answers) WHERE rn = 1)"""
_Q = """q AS (SELECT * FROM (SELECT *, lower(trim(username)) AS "user", row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM rag_queries) WHERE rn = 1)"""
_E = """e AS (SELECT * FROM (SELECT *, lower(trim(username)) AS "user", row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM user_evaluations) WHERE rn = 1)"""
_S = f"""s AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(task_id, 'task([0-9]+)', 1), '') AS INTEGER), 0) AS task_num, {_FAMILY.format(c='model_used', e='trim(model_used)')} AS model
    FROM a WHERE entry_type = 'submission' AND starts_with(task_id, 'task'))"""
_T = f"""WITH {_A}, {_Q}, {_S},
    p AS (SELECT "user", task_id, task_num, max(timestamp) FILTER (WHERE is_correct) AS done, min(timestamp) AS first_try, arg_min_null(model, (timestamp, id)) AS model, count(*) AS attempts
          FROM s WHERE "user" IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
    f AS (SELECT "user", min(timestamp) AS first_query FROM q WHERE "user" IS NOT NULL GROUP BY 1),
    b AS (SELECT *, CASE WHEN lag(task_num) OVER w = task_num - 1 THEN lag(done) OVER w END AS before FROM p WHERE done IS NOT NULL WINDOW w AS (PARTITION BY "user" ORDER BY task_num)),
    t AS (SELECT b."user", task_id, coalesce(model, 'unknown') AS model, attempts,
          abs(epoch_us(done) - epoch_us(CASE WHEN task_num = 1 THEN coalesce(first_query, first_try) ELSE coalesce(before, first_try) END)) / 6e7 AS minutes
          FROM b LEFT JOIN f ON f."user" = b."user") """
_SUM = """count(*) AS n, round(avg(minutes), 6) AS mean_minutes, round(median(minutes), 6) AS median_minutes, round(stddev_samp(minutes), 4) AS std_minutes, round(min(minutes), 6) AS least_minutes,
    round(max(minutes), 6) AS most_minutes, round(avg(attempts), 6) AS mean_attempts"""
_FIRST = f"""WITH {_A}, {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY "user", task_id, model ORDER BY timestamp NULLS FIRST, id) AS n FROM s WHERE "user" IS NOT NULL),
    u AS (SELECT "user", task_id, model, coalesce(min(n) FILTER (WHERE is_correct), max(n)) AS attempts, coalesce(bool_or(is_correct), false) AS solved FROM r GROUP BY 1, 2, 3)"""
_SKIP = f"""k AS (SELECT regexp_extract(query, '^Task skipped - (task[0-9]+)', 1) AS task, {_FAMILY.format(c='model_used', e='trim(model_used)')} AS model, count(*) AS n_skips FROM a
    WHERE regexp_matches(query, '^Task skipped - task[0-9]+') GROUP BY 1, 2)"""


def _points(q: int) -> str:
    p = f"CASE lower(trim(sus_responses['q{q}'])) WHEN 'strongly disagree' THEN 1 WHEN 'disagree' THEN 2 WHEN 'agree' THEN 4 WHEN 'strongly agree' THEN 5 ELSE 3 END"
    return f"CASE WHEN sus_responses['q{q}'] IS NULL THEN 0 ELSE " + (f"(({p}) - 1) * 2.5" if q % 2 else f"(5 - ({p})) * 2.5") + " END"


def _grade(c: str) -> str:
    return f"CASE WHEN {c} < 51 THEN 'Poor (F)' WHEN {c} < 68 THEN 'Below Average (D)' WHEN {c} < 74 THEN 'Good (C)' WHEN {c} < 80.3 THEN 'Very Good (B)' ELSE 'Excellent (A)' END"


def _cross(source: str, row: str, column: str, values) -> str:
    listed = ", ".join(f"('{v}')" for v in values)
    return f"""SELECT r.{row}, v.v AS {column}, count(m.{column}) AS n, round(count(m.{column}) * 100.0 / t.total, 6) AS percent FROM (SELECT DISTINCT {row} FROM {source}) r CROSS JOIN (VALUES {listed}) v(v)
        JOIN (SELECT {row}, count(*) AS total FROM {source} WHERE {column} IN ({', '.join(f"'{v}'" for v in values)}) GROUP BY 1) t ON t.{row} = r.{row}
        LEFT JOIN {source} m ON m.{row} = r.{row} AND m.{column} = v.v GROUP BY r.{row}, v.v, t.total"""


_SUS = f'WITH {_E}, z AS (SELECT id, "user", (' + " + ".join(f"({_points(q)})" for q in range(1, 11)) + ")::DOUBLE AS sus_score FROM e)"
ORACLES = {
    "task_completion": _T + 'SELECT "user", task_id, model, round(minutes, 6) AS minutes, attempts FROM t WHERE minutes <= 10',
    "completion_summary": _T + f"SELECT {_SUM} FROM t WHERE minutes <= 10",
    "task_stats": _T + f"SELECT task_id, {_SUM} FROM t WHERE minutes <= 10 GROUP BY 1",
    "model_stats": _T + f"SELECT model, {_SUM} FROM t WHERE minutes <= 15 GROUP BY 1",
    "task_model_stats": _T + f"SELECT task_id, model, {_SUM} FROM t WHERE minutes <= 15 GROUP BY 1, 2",
    "model_summary": _T + 'SELECT model, count(*) AS n, count(DISTINCT task_id) AS n_tasks, count(DISTINCT "user") AS n_users, round(avg(attempts), 6) AS mean_attempts FROM t WHERE minutes <= 15 GROUP BY 1',
    "unusual_cases": _T + "SELECT 'exceeded_max_time' AS issue, task_id, count(*) AS n, round(max(minutes), 6) AS longest FROM t WHERE minutes > 15 GROUP BY task_id",
    "true_success_rate": _FIRST + """, v AS (SELECT task_id, "user", bool_or(solved) AS solved FROM u GROUP BY 1, 2)
        SELECT task_id, count(*) AS users, count(*) FILTER (WHERE solved) AS solved, round(count(*) FILTER (WHERE solved) * 100.0 / count(*), 6) AS percent FROM v GROUP BY 1""",
    "attempts_to_success": _FIRST + f""", {_SKIP}, g AS (SELECT 'task' || i AS task_id, m AS model FROM (SELECT unnest(range(1, 6)) AS i) CROSS JOIN (VALUES ('OpenAI'), ('Llama')) v(m)),
        x AS (SELECT task_id, model, count(*) AS users, avg(attempts) AS mean_attempts, min(attempts) AS least_attempts, max(attempts) AS most_attempts FROM u GROUP BY 1, 2)
        SELECT g.task_id, g.model, coalesce(users, 0) AS users, coalesce(round(mean_attempts, 6), 0.0) AS mean_attempts, coalesce(least_attempts, 0) AS least_attempts, coalesce(most_attempts, 0) AS most_attempts,
        coalesce(n_skips, 0) AS n_skips FROM g LEFT JOIN x ON x.task_id = g.task_id AND x.model = g.model LEFT JOIN k ON k.task = g.task_id AND k.model = g.model""",
    "user_task_attempts": f'WITH {_A}, {_S} SELECT "user", task_id, count(*) AS attempts, arg_max(task_num, id) AS task_num FROM s WHERE "user" IS NOT NULL GROUP BY 1, 2',
    "skips": f"WITH {_A}, {_SKIP} SELECT * FROM k",
    "skipped_value_counts": f"WITH {_E} SELECT task, count(*) AS n FROM (SELECT unnest(skipped_tasks) AS task FROM e) GROUP BY 1",
    "entry_filters": f"""WITH {_A} SELECT count(*) AS n_rows, count(*) FILTER (WHERE entry_type = 'submission' AND starts_with(task_id, 'task')) AS n_submissions,
        count(*) FILTER (WHERE entry_type = 'query' AND starts_with(task_id, 'query_task')) AS n_task_queries, count(*) FILTER (WHERE contains(coalesce(query, ''), 'Task skipped')) AS n_skips,
        count(*) FILTER (WHERE is_correct) AS n_correct FROM a""",
    "sus_scores": _SUS + f""" SELECT id, "user", sus_score, {_grade('sus_score')} AS grade FROM z""",
    "sus_summary": _SUS + f""", y AS (SELECT count(*) AS n, round(avg(sus_score), 6) AS mean_score, round(median(sus_score), 6) AS median_score, min(sus_score) AS least, max(sus_score) AS most, round(stddev_samp(sus_score), 4) AS std FROM z)
        SELECT *, {_grade('mean_score')} AS grade FROM y""",
    "sus_distribution": f"WITH {_E}, m AS (SELECT question, sus_responses[question] AS answer FROM (SELECT sus_responses, unnest(map_keys(sus_responses)) AS question FROM e) WHERE sus_responses[question] IS NOT NULL) "
    + _cross("m", "question", "answer", ("Strongly Disagree", "Disagree", "Neutral", "Agree", "Strongly Agree")),
    "difficulty_crosstab": f"WITH {_E}, m AS (SELECT task, task_difficulty[task] AS difficulty FROM (SELECT task_difficulty, unnest(map_keys(task_difficulty)) AS task FROM e) WHERE task_difficulty[task] IS NOT NULL) " + _cross("m", "task", "difficulty", S.DIFFICULTY),
    "feedback_counts": f"WITH {_E}, l AS (" + " UNION ALL ".join(f"SELECT '{q}' AS question, {q} AS option FROM e" for q in S.FEEDBACK) + "), g(question, option, position) AS (VALUES "
    + ", ".join(f"('{q}', '{deg} {w}', {i + 1})" for q, w in S.FEEDBACK.items() for i, deg in enumerate(S.DEGREES))
    + ") SELECT g.question, g.option, g.position, count(l.option) AS n FROM g LEFT JOIN l ON l.question = g.question AND l.option = g.option GROUP BY 1, 2, 3",
    "processing_time_stats": f"WITH {_Q} SELECT task_id, {_FAMILY.format(c='model', e='trim(model)')} AS model, count(*) AS n, round(avg(processing_time), 6) AS mean_seconds, round(stddev_samp(processing_time), 4) AS std_seconds FROM q WHERE processing_time >= 0 GROUP BY 1, 2",
    "model_names": f"WITH {_Q} SELECT model AS as_written, {_FAMILY.format(c='model', e='trim(model)')} AS family, count(*) AS n FROM q GROUP BY 1, 2",
    "answer_after_query": f"""WITH {_A} SELECT id, row_number() OVER w AS turn, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS seconds_since FROM a WHERE "user" IS NOT NULL AND timestamp IS NOT NULL WINDOW w AS (PARTITION BY "user" ORDER BY timestamp, id)""",
    "concept_eval": f"WITH {_A}, {_S}, c AS (SELECT id, lower(coalesce(answer, '')) AS t FROM s), l AS (SELECT id, list_filter([{', '.join(repr(c) for c in CONCEPTS)}], lambda x: contains(t, x)) AS f, list_filter([{', '.join(repr(c) for c in CONCEPTS)}], lambda x: NOT contains(t, x)) AS m FROM c) "
    "SELECT id, len(f) AS n_found, len(f) >= 2 AS enough, array_to_string(list_slice(m, 1, 2), ', ') AS hints FROM l",
    "all_tasks_done": f"""WITH {_A}, p AS (SELECT "user", task_id, coalesce(bool_or(is_correct), false) AS ok, bool_or(starts_with(coalesce(query, ''), 'Task skipped')) AS skipped FROM a WHERE "user" IS NOT NULL AND task_id LIKE 'task%' GROUP BY 1, 2)
        SELECT "user", count(*) AS n_tasks, bool_and(ok OR skipped) AS all_done FROM p GROUP BY 1""",
}
