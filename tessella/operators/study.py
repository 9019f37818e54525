"""User-study analytics over the three log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import model_family, task_number
from tessella.operators.quantiles import exact_quantiles, join_groups

#: Answers of the usability questionnaire and their points.
LIKERT = {"strongly disagree": 1, "disagree": 2, "neutral": 3, "agree": 4, "strongly agree": 5}
#: Upper limits of the grades of a usability score.
GRADES = ((51.0, "Poor (F)"), (68.0, "Below Average (D)"), (74.0, "Good (C)"), (80.3, "Very Good (B)"), (None, "Excellent (A)"))
#: Answers on task difficulty, in order.
DIFFICULTY = ("Too Easy", "Easy", "Just Right", "Challenging", "Too Difficult")
#: The graded feedback questions and the word each grade is given for.
FEEDBACK = {"ai_helpfulness": "helpful", "ai_relevance": "relevant", "retrieval_quality": "accurate", "traditional_comparison": "better"}
DEGREES = ("Not", "Slightly", "Moderately", "Very", "Extremely")


def clean_log(log: DataFrame) -> DataFrame:
    """A log table with ``user`` (trimmed, lower case) and every id once; repeated rows are alike but for their order of arrival."""
    return log.dropDuplicates(["id"]).withColumn("user", F.lower(F.trim("username")))


def submissions(answers: DataFrame) -> DataFrame:
    """Submitted answers to numbered tasks, with ``task_num`` and ``model`` (family name)."""
    return (
        clean_log(answers).where((F.col("entry_type") == "submission") & F.col("task_id").startswith("task"))
        .withColumn("task_num", task_number(F.col("task_id"))).withColumn("model", model_family(F.trim("model_used")))
    )


def task_completions(answers: DataFrame, queries: DataFrame, *, max_minutes: float | None = 10.0) -> DataFrame:
    """Minutes from the start of a task to its last success, per user and solved task.

    (user, task_id, task_num, model, minutes, attempts). A task starts when the
    user solved the task before it; task 1 at the user's first query; otherwise
    at the task's first submission. The model is that of the first submission,
    'unknown' without one. Times over ``max_minutes`` are left out after all
    starts are fixed, so such a task still anchors the next one. Users and
    times that are null take no part.
    """
    subs = submissions(answers).where("user is not null and timestamp is not null")
    first = clean_log(queries).where("user is not null").groupBy("user").agg(F.min("timestamp").alias("first_query"))
    per_task = subs.groupBy("user", "task_id", "task_num").agg(
        F.max(F.when(F.col("is_correct"), F.col("timestamp"))).alias("done"),
        F.min("timestamp").alias("first_try"),
        F.min_by("model", F.struct("timestamp", "id")).alias("model"),
        F.count("*").alias("attempts"),
    )
    w = Window.partitionBy("user").orderBy("task_num")
    solved = per_task.where("done is not null").withColumn(
        "before", F.when(F.lag("task_num").over(w) == F.col("task_num") - 1, F.lag("done").over(w))
    )
    start = F.when(F.col("task_num") == 1, F.coalesce("first_query", "first_try")).otherwise(F.coalesce("before", "first_try"))
    minutes = F.abs(F.unix_micros("done") - F.unix_micros(start)) / 6e7
    out = solved.join(first, "user", "left").select("user", "task_id", "task_num", F.coalesce("model", F.lit("unknown")).alias("model"), minutes.alias("minutes"), "attempts")
    return out if max_minutes is None else out.where(F.col("minutes") <= max_minutes)


def time_summary(times: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, median, sample deviation, least and most minutes and mean attempts per group."""
    r = lambda c, n: F.round(c, 6).alias(n)
    sums = times.groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.avg("minutes"), "mean_minutes"), F.round(F.stddev_samp("minutes"), 4).alias("std_minutes"),
        r(F.min("minutes"), "least_minutes"), r(F.max("minutes"), "most_minutes"), r(F.avg("attempts"), "mean_attempts"),
    )
    return join_groups(sums, exact_quantiles(times, list(keys), "minutes", {"median_minutes": 0.5}), list(keys)).withColumn("median_minutes", F.round("median_minutes", 6))


def attempts_to_success(answers: DataFrame) -> DataFrame:
    """Per user, task and model ('unknown' without one): the number of the first correct submission in time order, or of all if none is."""
    subs = submissions(answers).where("user is not null").select("user", "task_id", F.coalesce("model", F.lit("unknown")).alias("model"), "is_correct", F.struct("timestamp", "id").alias("at"))
    keys = ["user", "task_id", "model"]
    first = subs.where("is_correct").groupBy(*keys).agg(F.min("at").alias("first"))  # partial aggregates only, no group is sorted
    return (
        subs.join(first, keys, "left").groupBy(*keys)
        .agg(F.count_if(F.col("first").isNull() | (F.col("at") <= F.col("first"))).alias("attempts"), F.coalesce(F.max("is_correct"), F.lit(False)).alias("solved"))
    )


def skipped_tasks(answers: DataFrame) -> DataFrame:
    """Skip events by task and model; they are told by the query text, whatever their entry type."""
    rows = clean_log(answers).withColumn("task", F.nullif(F.regexp_extract("query", r"^Task skipped - (task[0-9]+)", 1), F.lit(""))).where("task is not null")
    return rows.groupBy("task", model_family(F.trim("model_used")).alias("model")).agg(F.count("*").alias("n_skips"))


def question_points(answer: Column, question: int) -> Column:
    """2.5 x (points - 1) for odd and 2.5 x (5 - points) for even questions; unknown words count as neutral, a missing answer 0."""
    low = F.lower(F.trim(answer))
    points = F.lit(3)
    for word, n in LIKERT.items():
        points = F.when(low == word, n).otherwise(points)
    score = (points - 1) * 2.5 if question % 2 else (5 - points) * 2.5
    return F.when(answer.isNull(), 0.0).otherwise(score)


def grade(score: Column) -> Column:
    """The grade of a usability score."""
    out = F.lit(GRADES[-1][1])
    for limit, name in reversed(GRADES[:-1]):
        out = F.when(score < limit, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def sus_scores(evaluations: DataFrame) -> DataFrame:
    """(id, user, sus_score, grade) of every questionnaire."""
    answers = [question_points(F.col("sus_responses")[f"q{q}"], q) for q in range(1, 11)]
    total = answers[0]
    for a in answers[1:]:
        total = total + a
    return clean_log(evaluations).select("id", "user", F.coalesce(total, F.lit(0.0)).alias("sus_score")).withColumn("grade", grade(F.col("sus_score")))


def crosstab(rows: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value and its per cent of the row's total, as long rows; zero cells included."""
    counts = rows.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"`{v}`").alias("n")) for v in values]))
    return counts.select(row, total.alias("total"), cells.alias("c")).select(row, F.col("c.value").alias(column), F.col("c.n").alias("n"), F.round(F.coalesce(F.try_divide(F.col("c.n") * 100.0, F.col("total")), F.lit(0.0)), 6).alias("percent"))
