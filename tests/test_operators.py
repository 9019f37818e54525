import json
import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import links as L
from tessella.functions import similarity as Y
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import chunking as C
from tessella.operators import lookup as U
from tessella.operators import models as M
from tessella.operators import retrieval as R
from tessella.operators import study as S
from tessella.operators.profile import describe, fixed_ranges, width_histogram
from tessella.sources import files, html, sinks
from tessella.streaming.logs import new_rows_only, run_available


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_word_counts(spark):
    assert [one(spark, t, T.word_count) for t in (None, "", " \n ", "a", " a\tb\r\nc ")] == [0, 0, 0, 1, 3]
    assert one(spark, "été😀", T.char_count) == 4
    assert one(spark, None, T.average_word_length) == 0.0


def test_markdown_to_text(spark):
    md = "## Head\n![x](y)[link](u) **b** _i_ `c`\n<!-- Page 3 -->\n\n\n\n\nend-----"
    assert one(spark, md, T.markdown_to_text) == "Head\nlink b i c\n\n\nend\n\n"


def test_sentences_and_rouge_text(spark):
    assert one(spark, "A b. C d!  E?", T.sentences) == ["A b.", "C d!", "E?"]
    assert one(spark, " É tude, (x)\n1.5 ", T.rouge_text) == "é tude x 1.5"


def test_model_family_and_task_number(spark):
    assert [one(spark, m, T.model_family) for m in ("GPT-4", " llama3", "mixtral", None)] == ["OpenAI", "Llama", "mixtral", None]
    assert [one(spark, t, T.task_number) for t in ("task12", "query", None)] == [12, 0, 0]


def test_leftmost_year(spark):
    assert [one(spark, n, lambda c: T.leftmost_year(c, 1999, 2025)) for n in ("r-2003-1950.pdf", "r1950-2003", "none")] == [2003, None, None]


def test_links(spark):
    assert one(spark, "20990000001.pdf", L.download_link).endswith("/api/citations/20990000001/downloads/20990000001.pdf")
    assert one(spark, "abc-tm-12.pdf", L.download_link).endswith("/citations/abc-tm-12/downloads/abc-tm-12.pdf")
    assert one(spark, "x.pdf", L.download_link).endswith("/citations/downloads/x.pdf")
    assert one(spark, "https://h/downloads/a%20b.pdf?attachment=true", L.file_of_link) == "a b.pdf"
    assert one(spark, "é a/b" + "x" * 200, L.safe_title) == "é_a_b" + "x" * 95


def test_resolve_links(spark):
    known = spark.createDataFrame([("A.pdf", "u1"), ("a.PDF", "u0"), ("plan.docx", "u2"), (None, "u"), ("z", None)], "file string, url string")
    names = spark.createDataFrame([("A.pdf",), ("a.pdf",), ("20990000009.pdf",), ("plan.pdf",), ("my file.pdf",), (None,)], "file_name string")
    got = {r["file_name"]: (r["step"], r["url"]) for r in U.resolve_links(names, known).collect()}
    assert got["A.pdf"] == ("exact", "u1") and got["a.pdf"] == ("case", "u1") and got["20990000009.pdf"][0] == "number"
    assert got["plan.pdf"] == ("partial", "u2") and got["my file.pdf"] == ("search", "https://reports.example/search?q=my%20file") and len(got) == 5


def test_resolve_links_by_containment(spark):
    known = spark.createDataFrame([("plan.pdf", "u1"), ("long report on valves.pdf", "u2"), ("b.c", "u3"), ("", "u4")], "file string, url string")
    names = spark.createDataFrame([("my plan.pdf",), ("report on valves.pdf",), ("ab.cd",), ("x plan",), ("",)], "file_name string")
    got = {r["file_name"]: (r["step"], r["url"]) for r in U.resolve_links(names, known).collect()}
    assert got["my plan.pdf"] == ("partial", "u1") and got["report on valves.pdf"] == ("partial", "u2") and got["ab.cd"] == ("partial", "u3")
    assert got["x plan"][0] == "search" and len(got) == 5


def test_log_pairs(spark):
    rows = [("l", 0, "x Downloading from: http://a?x"), ("l", 1, "x Downloaded 1/2: a.pdf"), ("l", 2, "x Downloading from: http://b"), ("l", 3, "noise"), ("l", 4, "x Downloaded 2/2: b.pdf"), ("m", 0, "x Downloaded 1/2: c.pdf")]
    assert [tuple(r) for r in U.pair_log_lines(spark.createDataFrame(rows, "log string, line_no int, line string")).collect()] == [("a.pdf", "http://a?x")]


def test_describe_and_histograms(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", None)], "g string, x double")
    got = {r["group_value"]: r for r in describe(df, ["x"], by="g").collect()}
    assert got[None]["n"] == 3 and got["a"]["p50"] == 1.5 and got["b"]["std"] is None
    bins = {r["bin"]: r["n"] for r in width_histogram(df, "x", 3).collect()}
    assert bins == {0: 1, 1: 1, 2: 1}
    assert sum(r["n"] for r in width_histogram(df.where("x < 0"), "x", 4).collect()) == 0
    ranges = {r["label"]: r["n"] for r in fixed_ranges(df, "x", [0, 2, 4, None], lambda a, b: f"{a}-{b}").collect()}
    assert ranges == {"0-2": 1, "2-4": 1, "4-None": 1}


def test_knn_exact_with_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype("float32")
    x[5] = x[4]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "id long, v array<float>")
    got = {}
    for r in R.knn(df.where("id % 20 = 0"), df, k=3, exclude_self=True, block_rows=32).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    for q in range(0, 120, 20):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        want = [int(i) for i in np.lexsort((np.arange(120), d))[:3]]
        assert [got[q][k] for k in (1, 2, 3)] == want
    assert R.knn(df.where("id < 0"), df, k=3).count() == 0 and R.knn(df.where("id = 0"), df.where("id < 0"), k=3).count() == 0


def test_in_order_over_buckets(spark):
    import random

    from tessella.operators.ordering import in_order

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, *range(60)]), i, rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, p int, i int, c int")
    got = {r["i"]: (r["_ordinal"], r["_previous"], r["_carried"]) for r in in_order(df, "g", F.col("p"), "i", carry=F.col("c"), width=7).collect()}
    for g in "ab":
        kept = before = None
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, (_, p, i, c) in enumerate(own, 1):
            kept = c if c is not None else kept
            assert got[i] == (n, before, kept)
            before = p
    assert in_order(df.limit(0), "g", F.col("p"), "i").count() == 0


def test_label_metrics(spark):
    got = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (4, 1, 1)], "query_id long, doc_id long, rank int")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "x")], "id long, label string")
    rows = R.label_metrics(got, labels).collect()
    assert len(rows) == 1 and rows[0]["precision"] == 0.5 and rows[0]["recall"] == 0.5 and rows[0]["reciprocal_rank"] == 0.5


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")), V.squared_l2(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == pytest.approx(0.96) and r[0][1] == 2.0 and r[1][0] is None


def test_retrieval_metrics(spark):
    got = spark.createDataFrame([(1, "a", 1), (1, "x.pdf_11", 2), (1, "c", 3), (2, "z", 1), (4, "", 1)], "query_id long, doc_key string, rank int")
    rel = spark.createDataFrame([(1, "x.pdf_1"), (1, "c"), (1, "c"), (2, "q"), (3, "q"), (4, "q")], "query_id long, rel_key string")
    e = {r["query_id"]: r for r in R.metrics_by_query(got, rel).collect()}
    assert e[1]["precision"] == round(1 / 3, 6) and e[1]["recall"] == 0.5 and e[1]["reciprocal_rank"] == round(1 / 3, 6)
    assert e[1]["ndcg"] == round(0.5 / (1 + 1 / math.log2(3)), 6) and e[2]["hit"] == 0 and e[3]["precision"] == 0.0 and e[4]["n_retrieved"] == 0
    s = {r["query_id"]: r for r in R.metrics_by_query(got, rel, match="substring").collect()}
    assert s[1]["recall"] == 1.0 and s[1]["reciprocal_rank"] == 0.5
    assert R.metrics_summary(R.metrics_by_query(got, rel.where("query_id < 0"))).first()["precision"] is None
    perfect = spark.createDataFrame([(1, "c", 1), (1, "x.pdf_1", 2)], "query_id long, doc_key string, rank int")
    p = R.metrics_by_query(perfect, rel.where("query_id = 1")).first()
    assert [p[c] for c in ("precision", "recall", "reciprocal_rank", "hit", "ndcg")] == [1, 1, 1, 1, 1]


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "The cat, ran"), (2, None, "x"), (3, "", "")], "id int, a string, b string")
    got = {r["id"]: r for r in Y.rouge_n(df, "id", F.col("a"), F.col("b")).collect()}
    assert got[1]["rouge1_p"] == pytest.approx(2 / 3) and got[1]["rouge2_r"] == pytest.approx(0.5) and got[2]["rouge1_f"] == 0.0
    assert Y.rouge_l_scores("a b c d", "a x c d")[1] == 0.75 and Y.rouge_l_scores(None, "x") == (0.0, 0.0, 0.0)
    s = df.select(Y.sentence_rouge_l(F.lit("A b c. D e f."), F.lit("A b c. X y z.")).alias("s")).first()["s"]
    assert s == pytest.approx(1.0)
    assert Y.greedy_similarity([[1, 0]], [[1, 0], [0, 1]]) == pytest.approx((1.0, 0.5, 2 / 3))


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=60, deadline=None)
def test_lcs_equals_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert Y.lcs(a, b) == t[-1][-1]


def test_judge_scores(spark):
    assert [one(spark, t, Y.judge_scores) for t in ("8, 7.5,12", "8, x, 1", None, "1,2")] == [[0.8, 0.75, 1.0], [0.5] * 3, [0.5] * 3, [0.5] * 3]


def test_sections_rules():
    long = "one two three four five six seven eight"
    md = f"""before
# Intro
{long}
<!-- Page 3 -->
-----

| a | b | c |
Table 1
dropped heading below
## Lost

Back to text with enough words for it all.
**Bold Part**: {long}
_sub_ gone
{long}
Summary: {long}
# 12
{long}
# Works Cited
{long}
"""
    got = C.extract_sections(md)
    titles = [s.title for s in got]
    assert titles == ["Intro", "Bold Part", "Bold Part - sub", "Summary", "Works Cited"]
    assert got[0].page == 2 and got[0].level == 1 and got[1].level == 2 and got[2].level == 3 and "before" not in got[0].content
    tidy = C.tidy_sections(got)
    assert [s.title for s in tidy] == ["Intro", "Bold Part - sub", "Summary", "References"]
    assert tidy[1].content.startswith(long) and tidy[1].content.count(long) == 2


def test_sections_without_heading_and_hyphens():
    assert C.extract_sections("just text\nFigure 1\nmore")[0] == C.Section("Document Title", "just text\nmore", 0, 0)
    assert C.extract_sections("") == []
    s = [C.Section("High-speed flow", "x", 1, 0), C.Section("High-speed flow", "y", 1, 0)]
    assert C.tidy_sections(s) == [C.Section("High-speed flow", "x\n\ny", 1, 0)]


def recursive_model(text, limit):
    if len(text) <= limit:
        return [text] if text else []
    for sep in C.SEPARATORS:
        at = text.rfind(sep, 1, limit + len(sep))
        if at > 0:
            cut = at + len(sep)
            break
    else:
        nxt = text.find(" ", limit, limit + 20)
        cut = nxt if nxt > 0 else limit
    return [text[:cut].strip(C.SPACE), *recursive_model(text[cut:].strip(C.SPACE), limit)]


@given(st.text(alphabet="ab .,\n", max_size=400), st.integers(5, 60))
@settings(max_examples=120, deadline=None)
def test_recursive_split_equals_model_and_keeps_text(text, limit):
    text = text.strip(C.SPACE)
    got = C.recursive_split(text, limit)
    assert got == recursive_model(text, limit)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert all(len(p) <= limit + 3 for p in got)


def test_long_unbroken_text_and_overlap():
    assert [len(p) for p in C.recursive_split("x" * 2500, 1000)] == [1000, 1000, 500]
    assert len(C.recursive_split("word " * 100_000, 100)) > 4000  # no recursion
    assert C.add_overlap(["abc def", "ghi", "j"], 5) == ["abc def", "defghi", "j"]
    assert C.add_overlap([]) == []


def test_window_and_semantic_split():
    text = " ".join(f"w{i}" for i in range(400))
    pieces = C.window_split(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces) and pieces[1].split()[0] in pieces[0].split()
    assert C.window_split("", 10, 2) == [] and C.window_split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    s = "The pump failed early. The pump failed again. Birds sing in spring. Birds sing loudly in spring."
    assert C.semantic_split(s, 0.2) == ["The pump failed early. The pump failed again.", "Birds sing in spring. Birds sing loudly in spring."]
    assert C.semantic_split("One sentence only.") == [] and all(len(p) <= 50 for p in C.semantic_split(("word " * 60 + ". ") * 3, limit=50))


def test_explode_pieces(spark):
    df = spark.createDataFrame([(1, "a b. " * 300), (2, None), (3, ""), (4, "short")], "id long, t string")
    rows = C.explode_pieces(df, "id", "t", C.recursive_split).collect()
    assert {r["id"] for r in rows} == {1, 4} and all(r["total_chunks"] == 2 for r in rows if r["id"] == 1)


def logs(spark):
    t = datetime(2024, 1, 1)
    m = lambda n: t + timedelta(minutes=n)
    answers = [
        (1, " U1", "task1", "x", False, m(1), "submission", "gpt-4", None), (2, "u1", "task1", "x", True, m(4), "submission", "llama", None),
        (3, "u1", "task2", "x", True, m(9), "submission", None, None), (4, "u1", "task4", "x", True, m(40), "submission", "OpenAI", None), (4, "u1", "task4", "x", True, m(40), "submission", "OpenAI", None),
        (5, "u2", "task3", "x", None, m(0), "submission", "OpenAI", None), (6, "u2", "task3", None, None, m(1), "submission", "OpenAI", "Task skipped - task3"), (7, None, "task1", "x", True, m(1), "submission", "OpenAI", None),
        (8, "u1", "query_task1", "x", None, m(2), "query", "OpenAI", "q"),
    ]
    a = spark.createDataFrame(answers, "id long, username string, task_id string, answer string, is_correct boolean, timestamp timestamp, entry_type string, model_used string, query string")
    q = spark.createDataFrame([(1, m(2), "u1"), (2, m(3), "u1")], "id long, timestamp timestamp, username string")
    return a, q


def test_task_completion(spark):
    got = {r["task_id"]: r for r in S.task_completions(*logs(spark)).collect()}
    assert got["task1"]["minutes"] == 2.0 and got["task1"]["model"] == "OpenAI" and got["task1"]["attempts"] == 2
    assert got["task2"]["minutes"] == 5.0 and got["task2"]["model"] == "unknown"
    assert got["task4"]["minutes"] == 0.0 and set(got) == {"task1", "task2", "task4"}


def test_attempts_and_skips(spark):
    a, _ = logs(spark)
    got = {(r["user"], r["task_id"], r["model"]): (r["attempts"], r["solved"]) for r in S.attempts_to_success(a).collect()}
    assert got["u2", "task3", "OpenAI"] == (2, False) and got["u1", "task1", "Llama"] == (1, True)
    assert [tuple(r) for r in S.skipped_tasks(a).collect()] == [("task3", "OpenAI", 1)]


def test_usability_scores(spark):
    best = {f"q{i}": "Strongly Agree" if i % 2 else "Strongly Disagree" for i in range(1, 11)}
    rows = [(1, "a", best), (2, "b", {"q1": "whatever", "q2": "Agree"}), (3, "c", None), (4, "d", {"q1": None})]
    got = {r["id"]: (r["sus_score"], r["grade"]) for r in S.sus_scores(spark.createDataFrame(rows, "id long, username string, sus_responses map<string,string>")).collect()}
    assert got[1] == (100.0, "Excellent (A)") and got[2] == (7.5, "Poor (F)") and got[3][0] == 0.0 and got[4][0] == 0.0
    grades = spark.createDataFrame([(50.9,), (51.0,), (68.0,), (74.0,), (78.625,), (80.3,), (None,)], "s double").select(S.grade(F.col("s"))).collect()
    assert [g[0] and g[0][-2] for g in grades] == ["F", "D", "C", "B", "B", "A", None]


def test_crosstab(spark):
    df = spark.createDataFrame([("t", "x"), ("t", "x"), ("t", "y"), ("u", "other")], "row string, v string")
    got = {(r["row"], r["v"]): (r["n"], r["percent"]) for r in S.crosstab(df, "row", "v", ("x", "y")).collect()}
    assert got[("t", "x")] == (2, 66.666667) and got[("u", "x")] == (0, 0.0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "a.json").write_text(json.dumps([{"chunk_id": "a_0", "title": "T", "content": "C"}, {"chunk_id": "a_1", "title": None, "content": "x"}]))
    (tmp_path / "c" / "sub" / "b.json.partial").write_text(json.dumps({"chunk_id": "b_0", "title": "T", "content": "C", "metadata": {"file_name": "b.pdf"}}))
    (tmp_path / "c" / "bad.json").write_text("[{ nonsense")
    got = files.read_chunks(spark, str(tmp_path / "c")).collect()
    assert {r["chunk_id"] for r in got} == {"a_0", "b_0"} and {r["source_file"] for r in got} == {"a.json", "b.json.partial"}
    assert files.read_bad_json(spark, str(tmp_path / "c")).first()["source_file"] == "bad.json"
    head = "url,subject,abstract,driving_event,lessons_learned,recommendations,evidence,program_relation,program_phase,mission_directorate,topics"
    (tmp_path / "l.csv").write_text(f'{head}\nu1,S,"two\nlines ""q""",None,,x,x,x,x,x,x\nu2,Error,Error,x,x,x,x,x,x,x,x\n{head}\n')
    rows = {r["url"]: r for r in files.read_lessons(spark, str(tmp_path / "l.csv")).collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"]["abstract"] == 'two\nlines "q"' and rows["u1"]["driving_event"] is None and rows["u2"]["scrape_failed"]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "is_correct": "not_submitted", "timestamp": "2024-01-01 10:00:00"}, {"id": 2, "is_correct": True, "timestamp": "2024-01-01T10:00:00.5"}]))
    ans = {r["id"]: r for r in files.read_answers(spark, str(tmp_path / "a.json")).collect()}
    assert ans[1]["is_correct"] is None and ans[2]["is_correct"] is True and ans[2]["timestamp"].microsecond == 500000
    (tmp_path / "e.json").write_text(json.dumps([{"id": 1, "sus_responses": {"q1": "Agree"}, "task_difficulty": '{"task1": "Easy"}', "skipped_tasks": ["task2"]}]))
    e = files.read_evaluations(spark, str(tmp_path / "e.json")).first()
    assert e["sus_responses"] == {"q1": "Agree"} and e["task_difficulty"] == {"task1": "Easy"} and e["skipped_tasks"] == ["task2"]
    for n in ("x.pdf", "y.PDF", "z.txt"):
        (tmp_path / n).write_bytes(b"12")
    flat = files.list_files(spark, str(tmp_path))
    assert [r["file_name"] for r in flat.collect()] == ["x.pdf"] and files.list_files(spark, str(tmp_path), recursive=True).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"still_skipped_file_list": ["x.pdf", "gone.pdf"]}))
    assert [r[0] for r in files.read_skipped(spark, str(tmp_path / "s.json"), flat).collect()] == ["x.pdf"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "d.md").write_text("# A\ntext")
    assert files.read_markdown(spark, str(tmp_path / "m")).first()["markdown"] == "# A\ntext"
    (tmp_path / "log.txt").write_text("a\n\nb\n")
    assert [(r["line_no"], r["line"]) for r in files.read_log_lines(spark, str(tmp_path / "log.txt")).collect()] == [(0, "a"), (2, "b")]
    meta = files.document_metadata(spark.createDataFrame([("r.v1.pdf", " ", None, None, None)], "file_name string, title string, author string, subject string, keywords string")).first()
    assert tuple(meta) == ("r.v1.pdf", "r.v1", "Unknown", "", "")
    sinks.write_chunks(spark.createDataFrame([(1, "s")], "a int, b string"), str(tmp_path / "out"), by="b")
    sinks.append_rows(spark.createDataFrame([(2, "s")], "a int, b string"), str(tmp_path / "log"))
    sinks.append_rows(spark.createDataFrame([(3, "s")], "a int, b string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    built = []
    make = lambda: built.append(1) or spark.range(3)
    assert sinks.table_or_build(spark, str(tmp_path / "idx"), make).count() == 3 and sinks.table_or_build(spark, str(tmp_path / "idx"), make).count() == 3 and built == [1]
    good, bad = sinks.split_errors(spark.createDataFrame([("success",), ("timeout",), (None,)], "status string"))
    assert good.count() == 1 and bad.count() == 2
    md, js = sinks.report("R", {"x": spark.range(2)})
    assert "## x" in md and json.loads(js)["x"] == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        sinks.report("R", {"x": spark.range(5)}, max_rows=3)


def test_log_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS logs_test LOCATION '{tmp_path}'")
    try:
        sinks.create_log_tables(spark, "logs_test")
        sinks.create_log_tables(spark, "logs_test")
        spark.sql("INSERT INTO logs_test.system_logs VALUES (1, now(), 'INFO', 'm', 'l', 'p', 3)")
        assert sinks.table_size(spark, "logs_test.system_logs") == 1 and sinks.table_size(spark, "logs_test.none") is None
    finally:
        spark.sql("DROP DATABASE logs_test CASCADE")


def test_html_fields(spark):
    page = """<html><head><title>Lesson 1</title></head><body><h3>Subject</h3><div><em><strong>Valves &amp; pipes</strong></em></div><h3>Abstract:</h3><p>First</p><p>second<br>line</p>
    <h3>Topic(s)</h3><ul><li>a</li><li>b</li></ul><dl class="dl-horizontal"><dt>Lesson Date</dt><dd>1999-05-03</dd></dl><script>x</script></body></html>"""
    got = html.parse_page(page)
    assert got["page_title"] == "Lesson 1" and got["subject"] == "Valves & pipes" and got["abstract"] == "First second line" and got["evidence"] is None and got["lesson_date"] == "1999-05-03"
    assert set(html.parse_page(None).values()) == {None}
    df = spark.createDataFrame([(page,), (None,)], "h string")
    rows = df.select(html.lesson_fields(F.col("h")).alias("f")).select("f.subject", html.lesson_year(F.col("f.lesson_date")).alias("y")).collect()
    assert rows[0]["y"] == 1999 and rows[1]["subject"] is None
    assert one(spark, '<a href="/x/downloads/a.pdf?b">q</a><a href="/y">z</a>', html.download_links) == ["/x/downloads/a.pdf?b"]


def test_sql_functions(spark):
    from tessella.functions.register import register_functions

    assert "section_table" in register_functions(spark)
    row = spark.sql("SELECT recursive_split(repeat('ab. ', 500)) AS p, rouge_l_f('a b', 'a b') AS f, split_sentences('A b. C d.') AS s").first()
    assert len(row["p"]) == 2 and row["f"] > 0.99 and row["s"] == ["A b.", "C d."]
    text = "# T\none two three four five six seven eight"
    assert spark.sql(f"SELECT * FROM section_table('{text}')").first()["title"] == "T"
    assert spark.sql("SELECT count(*) FROM piece_table(repeat('ab. ', 500), 100)").first()[0] > 10


def test_models(spark):
    df = spark.createDataFrame([("pump valve", "The pump failed. Birds sing"), (None, None)], "q string, c string")
    rows = df.select(M.embed(F.col("q"), M.HashingEmbedder(16)).alias("v"), M.generate(F.col("q"), F.col("c"), M.ExtractiveGenerator()).alias("a"), M.judge(F.col("q"), F.col("c"), F.col("c"), M.OverlapJudge()).alias("j")).collect()
    assert sum(x * x for x in rows[0]["v"]) == pytest.approx(1.0) and rows[1]["v"] is None and rows[0]["a"] == "The pump failed"
    assert one(spark, rows[0]["j"], Y.judge_scores)[0] == 1.0


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, datetime(2024, 1, 1, i)), (0, datetime(2024, 1, 1))], "k long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), "k long, ts timestamp", lambda s: s.groupBy("k").count())
    assert {r["k"]: r["count"] for r in got.collect()} == {0: 4, 1: 1, 2: 1}
    assert new_rows_only(spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts").isStreaming


def test_recursive_split_keeps_an_index():
    """The same pieces as cutting the text itself, and no quadratic copying."""

    def plain(text, limit):
        out, rest = [], text
        while len(rest) > limit:
            for sep in C.SEPARATORS:
                at = rest.rfind(sep, 1, limit + len(sep))
                if at > 0:
                    cut = at + len(sep)
                    break
            else:
                nxt = rest.find(" ", limit, limit + 20)
                cut = nxt if nxt > 0 else limit
            out.append(rest[:cut].strip(C.SPACE))
            rest = rest[cut:].strip(C.SPACE)
        return out + ([rest] if rest else [])

    import random

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", ". ", ", ", "x" * 30]) for _ in range(rng.randrange(80)))
        assert C.recursive_split(text, 20) == plain(text, 20)
    assert len(C.recursive_split("word " * 400_000, 1000)) > 1900


def test_rouge_l_takes_the_larger_value(spark):
    df = spark.createDataFrame([(1, "The Valve, failed!", "the valve failed"), (2, "A b c. D e f.", "D e f. A b c."), (3, None, "x"), (4, "", "")], "id long, a string, b string")
    got = {r["id"]: tuple(round(x, 6) for x in r["s"]) for r in df.select("id", Y.rouge_l_best(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[1][:2] == (1.0, 1.0) and got[2][2] > 0.99 and got[2][1] == 0.5 and got[3] == got[4] == (0.0, 0.0, 0.0)


def test_narrow_model_list(spark):
    assert [one(spark, m, lambda c: T.model_family(c, wide=False)) for m in ("gpt-4", "gpt-4o-mini", "wizardlm2")] == ["OpenAI", "gpt-4o-mini", "wizardlm2"]


def test_exact_quantiles(spark):
    import numpy as np

    from tessella.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 1000) * 1.0, "c": np.array([7.0]), None: np.concatenate([np.full(3000, 5.0), [1e12, -1e12]])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in exact_quantiles(df, ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, [0.1, 0.5, 0.99]))
    assert exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"] == np.median([x for _, x in rows if x is not None])
    assert exact_quantiles(df.limit(0), ["g"], "x", {"m": 0.5}).count() == 0


def test_vector_index(spark, tmp_path):
    import numpy as np

    from tessella.operators import index as I

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in range(600)] + [(None, [0.0] * 8), (999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("list", F.lit(1)).withColumn("part", F.lit("x"))
    built = I.build_index(df, list_rows=40)  # hot lists are cut into parts
    assert built.rows.count() == 600 and built.rows.agg(F.max("part")).first()[0] >= 1
    asked = df.where("id % 20 = 0")
    exact = R.knn(asked, df, k=4)
    found = I.search(asked, built, k=4, probes=6)
    assert I.recall(found, exact).first()["recall"] >= 0.9
    assert sorted(map(tuple, I.search(asked, built, k=4, probes=10_000).select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "doc_id", "rank").collect()))
    built.save(str(tmp_path / "ix"))
    assert sorted(map(tuple, I.search(asked, I.VectorIndex.load(spark, str(tmp_path / "ix")), k=4, probes=6).collect())) == sorted(map(tuple, found.collect()))
    empty = I.build_index(df.limit(0))
    assert empty.rows.count() == 0 and I.search(asked.limit(0), built).count() == 0


def test_attempt_states_as_stream(spark, tmp_path):
    from datetime import datetime

    from tessella.streaming.attempts import attempt_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = datetime(2024, 1, 1)
    parts = [[(1, "u", "task1", False, t), (2, "u", "task1", None, t), (3, "v", "task1", True, t)], [(4, "u", "task1", False, t), (5, "u", "task1", False, t), (6, None, "task1", True, t)], [(7, "u", "task1", True, t), (8, "v", "task1", False, t)]]
    schema = "id long, user string, task_id string, is_correct boolean, timestamp timestamp"
    seen = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_available(spark, str(tmp_path / "in"), schema, attempt_states, keys=["user", "task_id"], checkpoint=str(tmp_path / "go"), per_trigger=9)
        seen.append({(r["user"], r["attempts"], r["state"]) for r in out.collect()})
    assert seen == [{("u", 2, "open"), ("v", 1, "solved")}, {("u", 4, "may_skip"), ("v", 1, "solved")}, {("u", 5, "solved"), ("v", 1, "solved")}]


def test_sentence_weights_equal_plain_ones_without_a_row_per_term(spark):
    import random
    import re
    from collections import Counter
    from math import log, sqrt

    from tessella.operators.weights import sentence_weights

    rng = random.Random(11)
    words = "alpha beta gamma delta eps zeta x9 y 42".split()
    text = lambda: " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + "." for _ in range(rng.randrange(1, 7)))
    rows = [(i, text()) for i in range(60)] + [(5, text()), (5, text()), (7, None), (8, None), (100, None), (101, ""), (102, "y. ?"), (None, text())]
    by = {}
    for k, t in rows:
        if k is not None and t is not None:
            for s, sentence in enumerate(re.sub("([.!?]) ", "\\1\x01", t.strip()).split("\x01")):
                by.setdefault(k, []).append((s, re.findall("[a-z0-9]{2,}", sentence.lower())))
    want, near = {}, {}
    for k, listed in by.items():
        tf = {}
        for s, ws in listed:
            tf.setdefault(s, Counter()).update(ws)
        df = Counter(w for c in tf.values() for w in c)
        unit = {}
        for s, c in tf.items():
            w = {x: n * (log((1 + len(listed)) / (1 + df[x])) + 1) for x, n in c.items()}
            unit[s] = {x: v / sqrt(sum(y * y for y in w.values())) for x, v in w.items()}
            if w:
                want[k, s] = (len(w), round(max(unit[s].values()), 9), round(sum(unit[s].values()), 9))
        for s in unit:
            both = set(unit[s]) & set(unit.get(s + 1, {}))
            if both:
                near[k, s] = round(sum(unit[s][x] * unit[s + 1][x] for x in both), 9)
    df = sentence_weights(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    got = df.collect()
    assert {(r["k"], r["s"]): (r["n_terms"], round(r["largest"], 9), round(r["total"], 9)) for r in got} == want and len(got) == len(want)
    assert {(r["k"], r["s"]): round(r["next_similarity"], 9) for r in got if r["next_similarity"] is not None} == near
    alone = sentence_weights(spark.createDataFrame(rows[:60], "k long, t string"), "k", "t")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["semantic_tfidf", "semantic_next_similarity"])
def test_semantic_queries_shuffle_no_terms(spark, name):
    import os

    from tessella.plans.texts import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    assert "Exchange" not in QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_attempt_states_of_many_small_files_in_any_order(spark, tmp_path):
    import os

    from tessella.streaming.attempts import attempt_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = [datetime(2024, 1, 1, 0, m) for m in range(9)]
    late, early = [(9, "u", "task1", True, t[5]), (8, "u", "task1", False, t[4]), (7, "w", "task1", False, t[1])], [(1, "u", "task1", False, t[0]), (2, "u", "task1", True, t[2]), (3, "u", "task1", False, t[3])]
    schema = "id long, user string, task_id string, is_correct boolean, timestamp timestamp"
    for rows in (late, early, late, early):  # the copies count once  # the copies count once
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for at, how in enumerate(({"per_trigger": 1}, {"bytes_per_trigger": 1 << 20})):
        path = str(tmp_path / f"go{at}")
        out = run_available(spark, str(tmp_path / "in"), schema, attempt_states, keys=["user", "task_id"], checkpoint=path, **how)
        assert {tuple(r) for r in out.collect()} == {("u", "task1", 2, "solved"), ("w", "task1", 1, "open")}
        assert len([f for f in os.listdir(f"{path}/state/commits") if f.isdigit()]) == (4, 1)[at]
