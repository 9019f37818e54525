
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import encoding, pairs, scans
from tessella.llm.filters import KeyFilter, hashes
from tessella.llm.lexicon import Trie
from tessella.llm.split import split_oversized, split_spans


@given(st.text(alphabet="ab .,\n\r😀", max_size=300), st.integers(1, 50), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_split_covers_and_keeps_limits(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= max(0, min(overlap, limit - 1))
    assert all(b - a <= limit for a, b, _ in spans)
    rebuilt, end = "", 0
    for a, b, _ in spans:
        rebuilt += text[end:b]
        end = b
    assert rebuilt == text


def test_split_prefers_strong_boundaries():
    text = "One two three. Four five.\n\nSix seven eight nine ten. Eleven twelve."
    a, b, kind = split_spans(text, 40, 0)[0]
    assert kind == "paragraph" and text[a:b].endswith("\n\n")
    assert split_spans("x" * 95, 40, 10) == [(0, 40, "hard"), (30, 70, "hard"), (60, 95, "end")]
    assert split_spans("", 5, 1) == [(0, 0, "end")]
    with pytest.raises(ValueError):
        split_spans("abc", 0, 0)


def test_split_table(spark):
    chunks = [("a", "w " * 30, 2, "x"), ("a", "w " * 30, 2, "y"), ("b", "short", 2, "x"), ("c", None, 2, "x"), ("d", "w " * 30, None, "x"), ("e", "w " * 30, 9, "x"), (None, "w " * 30, 2, "x"), ("f", "x" * 100_000, 2, "x"), ("g", "", 2, "x"), ("h", "y" * 20, 2, "x")]
    df = spark.createDataFrame(chunks, "chunk_id string, content string, section_level int, max_chars string")
    limits = spark.createDataFrame([(0, 40, 10), (2, 20, 5)], "section_level int, max_chars int, overlap_chars int")
    rows = split_oversized(df, limits).collect()
    assert {r["chunk_id"] for r in rows} == {"a", "d", "f"}
    a = sorted((r for r in rows if r["chunk_id"] == "a"), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in a] == list(range(1, a[0]["n_pieces"] + 1)) and all(len(r["piece"]) <= 20 for r in a)
    assert split_oversized(df.limit(0), limits).count() == 0 and split_oversized(df, limits.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="abcd", min_size=1, max_size=7), min_size=1, max_size=25), st.lists(st.text(alphabet="abcd", max_size=7), max_size=6))
@settings(max_examples=80, deadline=None)
def test_trie_finds_all_within_distance(words, queries):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    trie = Trie(words)
    for k in (0, 1, 2):
        for q, found in zip(queries, trie.within(queries, k)):
            assert {trie.words[i] for i in found} == ({w for w in words if dist(q, w) <= k} if q else set())


def test_misreading():
    assert scans.misreading("vvith", "with") == 1 and scans.misreading("rnodel", "model") == 1 and scans.misreading("hne", "line") == 1
    assert scans.misreading("f|ow", "flow") == 1 and scans.misreading("løad", "load") == 1 and scans.misreading("with", "with") == 0
    assert scans.misreading("form", "from") is None and scans.misreading("cat", "dog") is None


CLEAN = "The pressure transducer was installed near the propellant tank and the heated check valve. Engineers confirmed the margin on the landing strut before the final countdown. "


def scanned(spark, extra):
    body = [(f"c{i}", "Test Configuration", CLEAN, "clean.pdf") for i in range(12)]
    df = spark.createDataFrame(body + extra, "chunk_id string, title string, content string, file string")
    out = {}
    for r in scans.scan_noise(df, with_text=True).collect():
        out.setdefault((r["chunk_id"], r["field"]), [set(), r["repaired"]])[0].add(r["noise"])
    return out


def test_scan_kinds_and_repair(spark):
    page = "The pressure trans-\nducer was insta1led near the\n- 4 -\npropellant tank and the\nHAVREL PROGRAM HANDBOOK\nheated check valve."
    got = scanned(spark, [
        ("s1", "Test Configur-\nation", page, "s.pdf"), ("s1", "Test Configur-\nation", page, "s.pdf"), ("s2", "HAVREL PROGRAM HANDBOOK | Test Configuration", "HAVREL PROGRAM HANDBOOK\nThe landing strut.", "s.pdf"),
        ("s3", "Test Configuration ........ 7", "Engineers confirrned the margin on the landing strut before the final countdown.", "s.pdf"),
        ("n1", None, None, None), ("n2", "", "", "s.pdf"), ("n3", "See", "Readings:\n710\n952\n393\n", "s.pdf"), ("n4", None, "x" * 50_000, None), (None, "a", CLEAN, "s.pdf"),
        ("n5", "Wrapped", "The pressure transducer was installed near\nthe propellant tank, both pre-\nand post-test.", "s.pdf"),
    ])
    assert got["s1", "content"][0] == {"hyphen", "ocr", "page_number", "header"}
    assert got["s1", "content"][1] == "The pressure transducer was installed near the propellant tank and the heated check valve."
    assert got["s1", "title"] == [{"hyphen"}, "Test Configuration"]
    assert got["s2", "title"] == [{"header"}, "Test Configuration"] and got["s2", "content"][0] == {"header"}
    assert got["s3", "title"] == [{"page_number"}, "Test Configuration"] and got["s3", "content"][0] == {"ocr"}
    assert not {k for k in got if k[0].startswith(("n", "c"))}


def test_scan_counts_copies_once(spark):
    misread = "The prcssure was confirmed before the countdown."
    heading = "Engineers confirmed the margin.\n\nLanding Strut Margin\n\nThe heated check valve."
    got = scanned(spark, [
        *[("p%d" % i, "Test Configuration", f"The pressure of tank {i} was confirmed.", "p.pdf") for i in range(4)],
        *[("m1", "Test Configuration", misread, "m.pdf")] * 4, *[(f"k{i}", f"Title {i}", misread, f"k{i}.pdf") for i in range(5)],
        *[("h1", "Test Configuration", heading, "h.pdf")] * 3, *[(f"j{i}", f"Title {i}", heading, f"j{i}.pdf") for i in range(5)],
        ("s1", "Test Configuration", "7  HAVREL PROGRAM HANDBOOK\nThe landing strut.", "s.pdf"), ("s1", "Test Configuration", "7  HAVREL PROGRAM HANDBOOK\nThe landing strut.", "s.pdf"),
    ])
    assert {k for k in got if k[0][0] in "mk"} == {(c, "content") for c in ("m1", "k0", "k1", "k2", "k3", "k4")} and got["m1", "content"] == [{"ocr"}, misread.replace("prcss", "press")]
    assert not {k for k in got if k[0][0] in "hjpc"} and got["s1", "content"][0] == {"header", "page_number"}


def test_scan_with_mostly_scanned_texts(spark):
    body = [(f"q{i}", "T", f"The pressure transducer of unit {'abcdefghij'[i % 10] * (2 + i // 10)} was installed" + (" with a va1ve." if i % 4 else "."), "q.pdf") for i in range(40)]
    df = spark.createDataFrame(body + [("m1", "T", "A prcssure test.", "m.pdf")], "chunk_id string, title string, content string, file string")
    got = {tuple(r) for r in scans.scan_noise(df).select("chunk_id", "field", "noise").collect()}
    assert {"pressure", "transducer", "installed"} <= {r["key"] for r in scans.fit(df).vocabulary.collect()} and ("m1", "content", "ocr") in got


def test_common_words_make_no_suspects(spark):
    """However full the filter, a common word that passes it by chance must not drag along its texts."""
    words = CLEAN.split()
    body = [(f"c{i}", "The margin", " ".join(words[i:] + words[:i]), "clean.pdf") for i in range(12)] + [("s1", "T", "The prcssure was confirmed.", "s.pdf")]
    df = spark.createDataFrame(body, "chunk_id string, title string, content string, file string")
    tables = scans.fit(df, filter_bits=64)
    ask = scans._questions(spark.sparkContext.broadcast((tables.filter, tables.common)))
    picked = {r["chunk_id"] for r in df.mapInArrow(ask, "chunk_id string, title string, content string, file string, asks array<string>").collect()}
    assert picked == {"s1"} and {"pressure", "the"} <= tables.common


def test_filter_of_answers_passes_few_other_keys(spark):
    keys = spark.range(8000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("key"))
    held = KeyFilter.build(keys, bits_per_key=scans.BITS_PER_KEY)
    assert held.may_hold(hashes([f"f{i}" for i in range(8000)])).all()
    assert held.may_hold(hashes([f"g{i}" for i in range(200_000)])).sum() < 20


@given(st.text(alphabet="aé9_ -\xad‐¬\t\n\r", max_size=12))
@settings(max_examples=500, deadline=None)
def test_hyphens_at_line_ends(text):
    assert scans.ends_in_hyphen(text) == bool(re.search(rf"[^\W\d_][{scans._HYPHENS}]\s*[\r\n]", text))


def test_context_decides_between_candidates(spark):
    body = [(f"c{i}", "T", "the hold was kept and the bold step was taken by the crew", "f") for i in range(6)]
    body += [(f"d{i}", "T", "the cat sat with a hat on the cat", "f") for i in range(4)] + [("s1", "T", "the |old step was taken", "f")]
    df = spark.createDataFrame(body, "chunk_id string, title string, content string, file string")
    asked = [scans.pair_hashes("the", c, "step") for c in ("hold", "bold")]
    met = {r["pair"] for r in scans.neighbours(df.select("content"), spark.createDataFrame([(p,) for pair in asked for p in pair], "pair long").distinct()).collect()}
    assert met == set(asked[0][:1] + asked[1])
    model = scans.Answers([], frozenset(met))
    assert model.choose("the", ["hold", "bold"], "step") == "bold" and model.choose("the", ["hold", "bold"], "was") == "hold"


def test_scan_results_do_not_depend_on_filters_and_tries(spark):
    """Full filters and tries of three words change the rows that are joined, not the result."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    chunks = spark.read.parquet("/root/testdata/sf0.001/chunk.parquet").select("chunk_id", "title", "content", F.col("metadata.file_name").alias("file"))
    want = sorted(tuple(r) for r in scans.scan_noise(chunks, with_text=True).collect())
    assert len(want) > 20 and sorted(tuple(r) for r in scans.scan_noise(chunks, with_text=True, filter_bits=1 << 9, trie_words=100).collect()) == want


@given(st.lists(st.text(alphabet="ceo", min_size=1, max_size=6), min_size=1, max_size=20), st.text(alphabet="ceo", min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_trie_with_confusions_only(words, query):
    trie = Trie(words)
    swap = {"c": frozenset("e"), "e": frozenset("c")}
    for k in (1, 2):
        want = {w for w in words if len(w) == len(query) and all(a == b or b in swap.get(a, ()) for a, b in zip(query, w)) and sum(a != b for a, b in zip(query, w)) <= k}
        assert {trie.words[i] for i in trie.within([query], k, swap)[0]} == want


def test_word_forms_undo_joined_letters():
    assert {"model", "rnodel"} <= scans.word_forms("rnodel", 1) and "mm" in scans.word_forms("rnrn", 2) and "mm" not in scans.word_forms("rnrn", 1)
    assert scans.broken_words(["The trans-", "- 4 -", "ducer and pre-", "fab-", "ricated"], {1}) >= {("trans", "-", "ducer"), ("pre", "-", "fab-"), ("fab", "-", "ricated"), ("prefab", "-", "ricated")}


def test_scan_of_empty_table(spark):
    assert scans.scan_noise(spark.createDataFrame([], "chunk_id string, title string, content string, file string")).count() == 0


MODEL = pairs.LanguageModel.of_function_words()


def test_defect_rules():
    q = "What limits the relief valve at 280 kg?"
    good = ["The valve is limited by its spring.", "392 cycles", "- one\n- two\n- three", "about 45 kPa", "What limits the relief valve at 280 kg? The spring does, in the end.", "Yes, the feed line.", "The valve cannot be reset, so no answer from it is expected.", "The report says “Die Dichtfläche war nicht verfügbar und wurde geändert”, and the valve is to be changed."]
    assert [pairs.defect(q, a, False, MODEL) for a in good] == [None] * len(good)
    assert {pairs.defect(q, a, False, MODEL) for a in (None, "", " \n", "n.a.", "<p></p>", "[ ]", "TBD", "...", "\xa0")} == {"empty"}
    assert {pairs.defect(q, a, False, MODEL) for a in ("The valve is limited by the", "The spring of the val", "The valve, which…", "It reached 3 kg and (see")} == {"truncated"}
    assert {pairs.defect(q, a, False, MODEL) for a in (q, f"You asked: {q}", q.upper(), f'"{q}"', f"{q} {q}", "What limits the relief valve at 280 kg.")} == {"copied_question"}
    assert pairs.defect(q, "Die Dichtfläche war für mehrere Stunden nicht verfügbar und wurde geändert.", False, MODEL) == "wrong_language"
    assert pairs.defect(None, "An answer.", False, MODEL) is None and pairs.defect(q, "x " * 50_000, False, MODEL) == "truncated"


def test_broken_pairs(spark):
    rows = [(i, f"What limits part {i} of the valve?", "I'm sorry, but I cannot answer this question at this time.", "x") for i in range(6)]
    rows += [(10, "What is it?", "Sorry to say, no answer can be given on the basis of the context.", "x"), (11, "What is the load?", "The load is high.", "x"), (11, "What is the load?", "The load is high.", "y"), (12, None, None, None), (None, "q", "a", "x")]
    df = spark.createDataFrame(rows, "id long, question string, answer string, opening string")
    got = {r["id"]: r["defect"] for r in pairs.broken_pairs(df).collect()}
    assert got == {**{i: "refusal" for i in range(6)}, 10: "refusal", 12: "empty"}
    assert pairs.broken_pairs(df.limit(0)).count() == 0


PARTS = "valve pump nozzle seal tank hinge sensor panel bearing rotor".split()


def refusal_rows():
    """Answers of a made-up template that no list knows, between answers that share phrases with one another."""
    asks = ["What limits the {}?", "Why was the {} replaced?", "How does the {} react to shock?", "Which {} flew first?"]
    rows = [(i, asks[i % 4].format(p), f"{pre}That lies beyond what these records permit me to tell{post}") for i, (p, pre, post) in enumerate(zip(PARTS, ["", "Well, ", "Alas. "] * 4, [".", ", and so be it.", ".", ". Kindly ask elsewhere today."] * 3))]
    rows += [(50 + i, f"Why did the {p} fail?", f"The {p} failed in the endurance run. Tests were repeated after the acceptance run.") for i, p in enumerate(PARTS)]
    rows += [(70 + i, f"How does the {p} react?", f"The {PARTS[i - 1]} cannot be reset in flight, so wear grows.") for i, p in enumerate(PARTS)]
    rows += [(90, "What limits the pump of stage 90?", "What limits the pump of stage 90? That lies beyond what these records permit me to tell."), (91, "What of the seal?", "The seal lies beyond " + "the outer wall and " * 40 + "that lies beyond what these records permit me to tell.")]
    return rows


def test_recurring_templates_decline_without_the_list(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DECLINING", "no such phrase")
    df = spark.createDataFrame(refusal_rows(), "id long, question string, answer string")
    assert {r["id"] for r in pairs.declining(df).collect()} == {*range(10), 90}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_planted_refusals_are_found_without_the_list(spark, monkeypatch):
    """Of sf0.1: 154 answers decline; templates that recur there reveal at least 135 of them, and nothing else."""
    items = spark.read.parquet("/root/testdata/sf0.1/test_database_open_minded.parquet").select("id", "question", F.col("expected_answer").alias("answer")).dropDuplicates(["id"])
    listed = {r["id"] for r in pairs.declining(items).collect()}
    monkeypatch.setattr(pairs, "DECLINING", "no such phrase")
    bare = {r["id"] for r in pairs.declining(items).collect()}
    assert len(listed) == 154 and bare <= listed and len(bare) >= 135


def test_language_model_is_fitted(spark):
    docs = [(i, "zub dar kel mor", "de") for i in range(5)] + [(i + 9, "wip rol ton gas", "fr") for i in range(5)] + [(99, None, "en"), (98, "x", None)]
    m = pairs.fit_languages(spark.createDataFrame(docs, "id long, text string, lang string"))
    assert m.detect("zub kel mor dar") == "de" and m.detect("wip ton rol gas") == "fr" and m.detect("???") is None


@given(st.text(alphabet="éüñàßœ’–±°Ж", min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_ungarble_undoes_garble(text):
    for chain in encoding.CHAINS:
        bad = encoding.garble(text, chain)
        back = encoding.ungarble(bad, chain) if bad is not None else None
        assert back is None or back == text or "�" in bad or encoding.garble(back, chain) == bad


def test_garbled_texts(spark):
    clean = ["Für die Prüfung wurde die Dichtfläche geändert.", "Le système a été modifié jusqu’à l’arrêt complet.", "Según el plano, la válvula soportó 3 ± 1 kN."]
    docs = [(i, clean[i % 3], "z") for i in range(60)]
    fr, de, es = clean[1], clean[0], clean[2]
    bad = {100: fr.encode().decode("cp1252"), 101: de.encode().decode("cp1251"), 102: es.encode("cp1252").decode("mac_roman"), 103: es.encode("cp1252").decode("utf-8", "replace"), 104: fr.encode().decode("cp1252").encode().decode("cp1252", "ignore")}
    tree = "├── Москва └── √2 SÃO Å"
    docs += [(k, t, "z") for k, t in bad.items()] + [(200, tree, "z"), (201, tree, "z"), (202, "", "z"), (203, None, None), (None, bad[100], "z"), (100, bad[100], "z"), (204, "a" * 100_000 + "é", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    got = {r["doc_id"]: r for r in encoding.restore_garbled(df).collect()}
    assert set(got) == set(bad)
    assert got[100]["restored"] == fr and got[101]["restored"] == de and got[102]["restored"] == es and got[103]["words_restored"] >= 2
    assert encoding.find_garbled(df.limit(0))[0].count() == 0


def test_restore_keeps_the_rest():
    text = "a  b\tÃ© c"
    assert encoding.restore_text(text, {"Ã©": ("é", 0, ["é"])}, [0]) == ("a  b\té c", 1, 0)
