"""Broken prompt and response pairs, flagged with their defect."""

from __future__ import annotations

import re
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.neardup import near_duplicates
from tessella.session import materialize

#: Words that alone make an answer a placeholder.
PLACEHOLDERS = "n a|na|n a n|nan|none|null|nil|tbd|tba|todo|to do|to be determined|to be defined|tbc|missing|empty|undefined|placeholder|no data|no value|not available|not applicable|unknown|xxx|keine|kein eintrag|k a|entfällt|s o|sans objet|à compléter|néant|ninguno|pendiente|sin datos|lorem ipsum"

#: How answers decline, in the four languages; seeds for templates too rare to recur, matched on clauses in lower case.
DECLINING = "|".join((
    r"\bi (?:can ?not|can't|won't be able|will not be able|am unable|am not able|don't have|do not have|must decline|have to decline|apologi[sz]e|am sorry|am afraid)\b",
    r"\bi'm (?:sorry|unable|not able|afraid)\b",
    r"\bno answer can be given\b|\bnot enough information\b|\bnot? (?:allow|permit) (?:me|us) to\b|\bas an? (?:ai|assistant|language model)\b",
    r"\bleider kann ich\b|\bkann ich (?:\S+ ){0,6}nicht\b|\bich kann (?:\S+ ){0,6}nicht\b|\bliegen mir (?:\S+ ){0,2}keine\b|\bmir liegen keine\b|\btut mir leid\b",
    r"\bje ne (?:peux|puis|dispose|suis)\b|\bje suis désolée?\b|\bje regrette\b|\bne me permet(?:tent)? pas\b|\bimpossible de répondre\b|\bje n'ai pas\b",
    r"\blo siento\b|\bno puedo\b|\bno dispongo\b|\bno me permiten?\b|\bno tengo (?:información|acceso)\b|\bno es posible responder\b",
))

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and was is in to at for that with had were by when after what which how why does be on from as it this these not are has can should",
    "de": "der die das und ist wurde nicht für mit den dem des ein eine einer zu im war wie wird auf bei nach von vor dass sich auch zwischen durch ohne blieb",
    "fr": "le la les des une est pour dans que du et un sur par pas au aux ne se il elle qui ce cette sont a été avec plus puis dès après",
    "es": "el la los las una del por que en se un y con para no es su al lo como más fue cuando hasta después también según desde qué cómo",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_TAG = re.compile(r"<[^<>]{0,40}>|&nbsp;")
_QUANTITY = re.compile(r"(?:(?:about|approx\.?|approximately|ca\.?|circa|etwa|rund|environ|unos|unas|some|nearly|~|≈|<|>|≤|≥|\+|-|±)\s*)*\d[\d.,' ]*(?:±\s*\d[\d.,]*\s*)?[^\s\d]{0,12}(?:\s[^\s\d]{1,12})?")
_BULLET = re.compile(r"\s*(?:[-*•·–]|\d{1,3}[.)]|[a-z][.)])\s+\S")
#: Abbreviations that don't end a sentence.
_ABBREVIATION = re.compile(r"(?:^|\s)(?:approx|fig|figs|no|nos|vs|e\.g|i\.e|cf|eq|sec|ref|z\.b|d\.h|bzw|ca|abb|nr|p\. ?ex|c\.-à-d|env|núm|p\. ?ej|aprox)\.$", re.I)


def words(text: str) -> list[str]:
    return _WORD.findall(text.replace("’", "'").lower())


def is_empty(answer: str | None) -> bool:
    """Null, blank, markup or punctuation only, or nothing but a placeholder word."""
    if answer is None:
        return True
    found = words(_TAG.sub(" ", answer))
    return not found or " ".join(found) in _PLACEHOLDERS


_PLACEHOLDERS = frozenset(PLACEHOLDERS.split("|"))


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question: its words cover the answer, but for an introduction before them."""
    q, a = words(question or ""), words(answer)
    if len(q) < 3 or not a:
        return False
    have = set(q)
    known = [w in have for w in a]
    if sum(w in set(a) for w in have) < 0.8 * len(have) or not known[-1]:
        return False
    return len({w for w, k in zip(a, known) if not k}) <= max(3, len(have) // 4)


class LanguageModel:
    """Naive Bayes over words: log-probabilities of known words by language."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        """counts: language -> word -> occurrences."""
        self.langs = sorted(counts)
        total = {k: sum(c.values()) + 1.0 for k, c in counts.items()}
        known = set().union(*counts.values()) if counts else set()
        self.table = {w: [log((counts[k].get(w, 0) + 0.5) / total[k]) for k in self.langs] for w in known}

    @classmethod
    def of_function_words(cls) -> "LanguageModel":
        return cls({k: dict.fromkeys(v, 10) for k, v in _SETS.items()})

    def scores(self, text: str) -> tuple[list[list[float]], list[float]]:
        rows = [self.table[w] for w in words(text) if w in self.table]
        return rows, [sum(c) for c in zip(*rows)] if rows else [0.0] * len(self.langs)

    def detect(self, text: str, least: int = 2, margin: float = 2.0) -> str | None:
        """The language that is ``margin`` nats likelier than any other, given ``least`` known words."""
        rows, sums = self.scores(text)
        if len(rows) < least or len(sums) < 2:
            return None
        first, second = sorted(sums, reverse=True)[:2]
        return self.langs[sums.index(first)] if first - second >= margin else None


def fit_languages(labelled: DataFrame, *, max_rows: int = 20_000, max_words: int = 20_000) -> LanguageModel:
    """A model from (id, text, lang) rows.

    Fitted on a sample of about ``max_rows`` labelled rows, chosen by a hash of
    their ids, and on its ``max_words`` most frequent words, added to the fixed
    function words. Without labelled rows only those are used.
    """
    rows = labelled.where("lang is not null")
    share = min(1.0, max_rows / max(1, rows.count()))  # counted without reading texts
    sample = rows.where("text is not null").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    found = sample.select(F.lower(F.trim("lang")).alias("lang"), F.explode(F.split(F.lower(F.regexp_replace("text", "[’]", "'")), r"[^\p{L}']+")).alias("w")).where("w <> ''")
    counts = found.groupBy("w").pivot("lang", list(_SETS)).count().na.fill(0)
    top = counts.orderBy(F.desc(sum((F.col(k) for k in _SETS), F.lit(0))), "w").limit(max_words).collect()
    table = {k: {w: 10 for w in v} for k, v in _SETS.items()}
    for r in top:
        for k in _SETS:
            if r[k]:
                table[k][r["w"]] = table[k].get(r["w"], 0) + r[k]
    return LanguageModel(table)


def is_other_language(question: str | None, answer: str, model: LanguageModel) -> bool:
    """The answer as a whole, without quotations, is in another language than the question."""
    asked, bare = model.detect(question or ""), _QUOTED.sub(" ", answer)
    told = model.detect(bare, least=3, margin=3.0)
    if asked is None or told is None or told == asked or _QUANTITY.fullmatch(answer.strip()):
        return False
    i, j = model.langs.index(asked), model.langs.index(told)
    rows, _ = model.scores(bare)
    return sum(r[j] > r[i] for r in rows) >= 0.7 * sum(r[j] != r[i] for r in rows)


def is_truncated(answer: str) -> bool:
    """Breaks off within a sentence; bare quantities, lists and short names are complete."""
    text = answer.rstrip()
    bare = text.rstrip("\"'”’»)]}*_ ")
    if bare.endswith(("…", "...")):
        return True
    if bare[-1:] in ("。", "!", "?"):
        return False
    if bare.endswith("."):
        return bool(_ABBREVIATION.search(bare))
    if _QUANTITY.fullmatch(bare.strip()):
        return False
    if _BULLET.match(text.split("\n")[-1]):
        return False
    found = words(text)
    if len(found) <= 2:
        return bool(found) and any(found[-1] in s for s in _SETS.values())
    parts = re.split(r"[,;\n]", bare)
    if len(parts) >= 3 and all(0 < len(words(p)) <= 4 for p in parts) and not any(found[-1] in s for s in _SETS.values()):
        return False
    return True


def defect(question: str | None, answer: str | None, declines: bool, model: LanguageModel) -> str | None:
    """The first defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    if declines:
        return "refusal"
    if is_copy(question, answer):
        return "copied_question"
    if is_other_language(question, answer, model):
        return "wrong_language"
    return "truncated" if is_truncated(answer) else None


def _defects(shared):
    def run(question: pd.Series, answer: pd.Series, declines: pd.Series) -> pd.Series:
        return pd.Series([defect(*row, shared.value) for row in zip(question, answer, declines)], dtype="object")

    run.__annotations__ = {"question": pd.Series, "answer": pd.Series, "declines": pd.Series, "return": pd.Series}
    return run


def _plain(text: Column) -> Column:
    """Words in lower case with single spaces between them, no punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[’‘`]", "'"), r"[^\p{L}\p{N}']+", " "))


def content_words(text: Column) -> Column:
    """The distinct words of four or more letters that are no function words."""
    words = F.filter(F.split(_plain(F.coalesce(text, F.lit(""))), " "), lambda w: F.length(w) > 3)
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(set().union(*_SETS.values())) if len(w) > 3]))


def with_prompts(rows: DataFrame) -> DataFrame:
    """Rows of (id, question, answer) with ``asked``, the content words of the question, and ``whole``, its words between spaces; written once, since each clause is held against them."""
    question = F.coalesce("question", F.lit(""))
    return materialize(rows.select("id", "question", "answer", content_words(question).alias("asked"), F.concat(F.lit(" "), _plain(question), F.lit(" ")).alias("whole")))


def clauses(answer: Column, asked: Column) -> Column:
    """The clauses of the whole answer: (text, n words, own: whether it has one of the words ``asked``, or a number, ends: whether a sentence ends with it)."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"[.!?;]+(?=\s|$)", "\x02\x01"), r"[,:…]+(?=\s|$)|[\r\n]+", "\x01")
    flat = F.regexp_replace(F.translate(F.lower(marked), "’‘`", "\'\'\'"), r"[^\p{L}\p{N}'\x01\x02]+", " ")

    def tell(part: Column) -> Column:
        text = F.trim(F.translate(part, "\x02", ""))
        words = F.split(text, " ")
        return F.struct(text.alias("text"), F.size(words).alias("n"), (F.arrays_overlap(words, asked) | text.rlike("[0-9]")).alias("own"), F.contains(part, F.lit("\x02")).alias("ends"))

    return F.filter(F.transform(F.split(flat, "\x01"), tell), lambda x: x["text"] != "")


def _leading(spans: Column, empty) -> Column:
    """Number and words of the leading clauses for which ``empty(clause, position)`` holds, and words of all: (run, words, total)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("words"), F.lit(0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        on = (s["run"] == s["i"]) & empty(x, s["i"])
        return F.struct((s["i"] + 1).alias("i"), (s["run"] + on.cast("int")).alias("run"), (s["words"] + F.when(on, x["n"]).otherwise(0)).alias("words"), (s["total"] + x["n"]).alias("total"))

    return F.aggregate(spans, start, step)


def declining_templates(told: DataFrame, *, min_prompts: int = 3, topical: float = 0.1) -> DataFrame:
    """(h, text, prompts, around): clauses with which answers decline, told by their recurrence across unrelated prompts.

    told: (id, prompt, asked, spans), of ``clauses``. Looked at are the clauses
    with which answers open that say nothing of their prompt: no word of it and
    no number in them, and at least half of the answer's words in that opening.
    The distinct ones are clustered by verified MinHash (five-word shingles,
    similarity 0.8). A clause declines if it recurs, if it and those near it open such
    answers to at least ``min_prompts`` prompts that have no longer word in
    common, if most of its occurrences anywhere are in such openings (a phrase
    of ordinary answers stands beside content), one in four of them at the end
    of a sentence, and if at most a quarter of its content words are what prompts ask about (words of
    several prompts, and of at least ``topical`` as many prompts as answers). The phrase list ``DECLINING`` only seeds: near a clause that
    matches it, one prompt is enough.
    """
    strict = told.select("id", "prompt", "asked", "spans", _leading(F.col("spans"), lambda x, i: ~x["own"]).alias("lead")).where("lead.run > 0 and lead.words * 2 >= lead.total")
    opened = materialize(strict.select("id", "prompt", "asked", F.explode(F.slice("spans", 1, F.col("lead.run"))).alias("c")).select("id", "prompt", "asked", F.xxhash64("c.text").alias("h"), "c.text", "c.n", "c.ends"))
    spoken = materialize(opened.groupBy("h").agg(F.min("text").alias("text"), F.min("n").alias("n"), F.countDistinct("prompt").alias("prompts"), F.count("*").alias("opening"), F.count_if("ends").alias("ends")).withColumn("says", F.col("text").rlike(DECLINING)))
    everywhere = told.select(F.explode("spans").alias("c")).select(F.xxhash64("c.text").alias("h")).join(spoken.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("all"))
    links, members = near_duplicates(spoken.where("n >= 5"), id="h", text="text", threshold=0.8, shingle=5, min_words=5)
    near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(members.toDF("a", "h"), "a").join(members.toDF("b", "other"), "b").select("h", "other").where("h <> other").distinct()
    beside = near.join(spoken.select(F.col("h").alias("other"), "prompts", "says"), "other").groupBy("h").agg(F.sum("prompts").alias("more"), F.max("says").alias("seeded"))
    longest = opened.select("h", "prompt", F.explode("asked").alias("w")).where("length(w) > 4").distinct().groupBy("h", "w").count().groupBy("h").agg(F.max("count").alias("common"))
    judged = spoken.join(everywhere, "h").join(beside, "h", "left").join(longest, "h", "left").withColumn("around", F.col("prompts") + F.coalesce("more", F.lit(0)))
    recurs = (F.col("prompts") >= 2) & (F.col("around") >= min_prompts) & (F.coalesce("common", F.lit(0)) < F.greatest("prompts", F.lit(2)))
    judged = materialize(judged.where((F.col("n") >= 4) & (F.col("opening") * 2 >= F.col("all")) & (F.col("ends") * 4 >= F.col("opening")) & (recurs | F.col("says") | F.coalesce("seeded", F.lit(False)))).select("h", "text", "prompts", "around", content_words(F.col("text")).alias("words")))
    words = materialize(judged.select("h", F.explode("words").alias("w")))
    looked = words.select("w").distinct()
    asked = told.select("prompt", "asked").dropDuplicates(["prompt"]).select(F.explode("asked").alias("w")).join(looked, "w", "left_semi").groupBy("w").agg(F.count("*").alias("nq"))
    said = told.select(F.explode(F.array_distinct(F.split(F.array_join(F.transform("spans", lambda x: x["text"]), " "), " "))).alias("w")).join(looked, "w", "left_semi").groupBy("w").agg(F.count("*").alias("na"))
    common = asked.join(said, "w").where((F.col("nq") >= 2) & (F.col("nq") >= topical * F.col("na"))).select("w")
    about = words.join(common, "w").groupBy("h").agg(F.count("*").alias("about"))
    return judged.join(about, "h", "left").where(F.coalesce("about", F.lit(0)) * 4 <= F.size("words")).select("h", "text", "prompts", "around")


def declining(rows: DataFrame, *, min_prompts: int = 3) -> DataFrame:
    """(id): items whose answer declines.

    rows: (id, question, answer), whole answers. An answer declines if a clause
    of ``declining_templates`` stands in it with nothing of its prompt before
    it (a repetition of the question aside), and such clauses, with short ones
    beside them, make up three eighths of its words.
    """
    if "asked" not in rows.columns:
        rows = with_prompts(rows)
    told = rows.select("id", F.xxhash64("question").alias("prompt"), "asked", clauses(F.col("answer"), F.col("asked")).alias("spans"), "whole")
    told = materialize(told.withColumn("spans", F.filter("spans", lambda x: ~F.contains(F.col("whole"), F.concat(F.lit(" "), x["text"], F.lit(" "))) | (x["n"] < 3))).where("size(spans) > 0").drop("whole"))
    found = declining_templates(told, min_prompts=min_prompts)
    at = told.select("id", F.posexplode("spans").alias("pos", "c")).select("id", "pos", F.xxhash64("c.text").alias("h")).join(found.select("h"), "h", "left_semi").groupBy("id").agg(F.collect_list("pos").alias("at"))  # clauses of one answer
    template = lambda i: F.array_contains("at", i)
    both = told.join(at, "id").select(
        "id", "at", _leading(F.col("spans"), lambda x, i: ~x["own"] | template(i)).alias("lead"),
        F.aggregate(F.filter("spans", lambda x, i: template(i) | (~x["own"] & (x["n"] < 4))), F.lit(0), lambda s, x: s + x["n"]).alias("empty"),
    )
    return both.where("array_min(at) < lead.run and empty * 8 >= lead.total * 3").select("id")


def broken_pairs(items: DataFrame, labelled: DataFrame | None = None, *, min_prompts: int = 3) -> DataFrame:
    """(id, defect) of the items whose answer doesn't answer the question.

    items: (id, question, answer); labelled: (id, text, lang) to fit languages
    on (see ``fit_languages``), else fixed function words tell them. A repeated id counts once. At most one
    defect each, the first of: empty (null, blank, only markup or a
    placeholder), refusal (see ``declining``), copied_question,
    wrong_language, truncated. A null question can't be copied and has no
    language. Null ids take no part; an empty table gives no rows.
    """
    rows = with_prompts(items.where("id is not null").select("id", "question", "answer").dropDuplicates(["id"]))
    no = declining(rows, min_prompts=min_prompts).select("id", F.lit(True).alias("declines"))
    flagged = rows.join(no, "id", "left").select("id", "question", "answer", F.coalesce("declines", F.lit(False)).alias("declines"))
    model = LanguageModel.of_function_words() if labelled is None else fit_languages(labelled)
    found = F.pandas_udf(_defects(items.sparkSession.sparkContext.broadcast(model)), "string")
    return flagged.select("id", found("question", "answer", "declines").alias("defect")).where("defect is not null")
