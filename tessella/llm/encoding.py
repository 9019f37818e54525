"""Texts garbled by a wrong character encoding: find them and restore the original."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.bloom import BloomFilter
from tessella.session import materialize

#: Encodings in which text is commonly stored, and those in which it is commonly misread.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437", "cp1251")
READ = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "utf-8", "ascii")

#: A chain is a list of (written as, read as) steps.
CHAINS: list[tuple[tuple[str, str], ...]] = [((w, r),) for w in WRITTEN for r in READ if w != r and (w, r) != ("cp1252", "latin-1") and (w != "utf-8" or r != "ascii")]
CHAINS += [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251") for b in ("cp1252", "latin-1", a)]
CHAINS = list(dict.fromkeys(CHAINS))
CHAIN_NAMES = [" > ".join(f"{w} as {r}" for w, r in chain) for chain in CHAINS]


def _decode(raw: bytes, reader: str) -> str:
    if reader in ("utf-8", "ascii"):
        return raw.decode(reader, "replace")
    try:
        return raw.decode(reader)
    except UnicodeDecodeError:  # bytes without a character pass as C1 controls, as common software does
        return "".join(bytes([b]).decode(reader, "ignore") or chr(b) for b in raw)


def _encode(text: str, writer: str) -> bytes | None:
    try:
        return text.encode(writer)
    except UnicodeEncodeError:
        if writer == "utf-8":
            return None
        try:
            return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(writer) for c in text)
        except UnicodeEncodeError:
            return None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after the chain, or None where it can't be written so."""
    for writer, reader in chain:
        raw = _encode(text, writer)
        if raw is None:
            return None
        text = _decode(raw, reader)
    return text


def ungarble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text that the chain turned into ``text``, or None where that isn't reversible."""
    for writer, reader in reversed(chain):
        if reader in ("utf-8", "ascii") and "�" in text:
            return None
        raw = _encode(text, reader)
        if raw is None:
            return None
        try:
            text = raw.decode(writer)
        except UnicodeDecodeError:
            return None
    return text


#: Size of the bit array of words and their neighbours: 2**25 bits are 4 MB.
CONTEXT_BITS = 25

_PUNCT = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"
_SPACE = re.compile(r"[ \t\r\n\f]+")
_STRIP = re.compile(f"^{_PUNCT}|{_PUNCT}$")


def words_of(text: Column) -> Column:
    """The distinct words of a text that hold other than ASCII characters, without ASCII punctuation around them."""
    tokens = F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda t: t.rlike(r"[^\x00-\x7f]"))
    return F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, f"^{_PUNCT}|{_PUNCT}$", "")))


def _generate(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value

        def rank(word: str) -> int:
            return min((common.get(c, 0) for c in word if ord(c) > 127), default=1 << 60)

        for df in frames:
            out = []
            for word, n in zip(df["word"].tolist(), df["n"].tolist()):
                own, seen = rank(word) + 1, set()
                if "�" in word:
                    continue
                for k, chain in enumerate(CHAINS):
                    bad = garble(word, chain)
                    if bad is None or bad == word:
                        continue
                    whole = _STRIP.sub("", bad)
                    for form in dict.fromkeys((whole, _STRIP.sub("", bad.replace("\xa0", " ").strip(" ").split(" ")[0]))):
                        if form and form not in seen and form != word and not form.isascii():
                            seen.add(form)
                            out.append((form, word, k, n, own / (rank(form) + 1), form != whole and len(form) == 1))
            yield pd.DataFrame(out, columns=["garbled", "original", "chain", "n", "ratio", "weak"])

    return run


def garbled_table(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which corpus words are garbled forms of clean corpus words: (garbled, original, chain, weak) and (garbled, options).

    words: (word, n). Every word is garbled under every chain, and the forms
    are hash-joined with the corpus words. Which of two words that map to each
    other is the clean one is told by how often each occurs and how common the
    rarest character of each is: the product of both ratios must exceed 1.
    Words that are themselves garbled forms are no originals. Of several
    originals the one with the largest product counts, times the number of
    forms of three or more characters that speak for its chain; a form of one
    or two characters needs a chain for which such forms speak. ``weak`` marks
    single characters left of a form whose no-break space was lost. The second
    table has the originals in question where a chain that lost characters
    leaves several.
    """
    # one row per character: at most as many as Unicode has, whatever the corpus
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "n").where("c rlike '[^\\\\x00-\\\\x7f]'").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    common = words.sparkSession.sparkContext.broadcast(dict(zip(chars["c"], chars["n"].astype(int))))
    spread = words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // 20_000)), "word")  # sixty chains a word
    forms = spread.mapInPandas(_generate(common), "garbled string, original string, chain int, n long, ratio double, weak boolean")
    own = words.select(F.col("word").alias("garbled"), F.col("n").alias("own"))
    scored = forms.join(own, "garbled").select("garbled", "original", "chain", "weak", (F.col("n") / F.col("own") * F.col("ratio")).alias("score"))
    hits = materialize(scored.where("score > 1"))
    clean = hits.join(hits.select(F.col("garbled").alias("original")).distinct(), "original", "left_anti")
    best = clean.withColumn("support", F.lit(1))
    for _ in range(2):  # the second round counts only the forms that a chain keeps in the first
        support = {r["chain"]: r["n"] for r in best.where("length(garbled) >= 3").groupBy("chain").agg(F.count("*").alias("n")).collect()}  # a row per chain at most
        known = F.create_map(*[F.lit(x) for pair in support.items() for x in pair])[F.col("chain")] if support else F.lit(None).cast("long")
        judged = clean.withColumn("support", F.coalesce(known, F.lit(0))).where("support > 0")
        best = judged.groupBy("garbled").agg(F.max_by(F.struct("original", "chain", "weak"), F.struct(F.col("score") * F.col("support"), "original")).alias("m")).select("garbled", "m.*")
    several = judged.groupBy("garbled").agg(F.countDistinct("original").alias("n")).where("n > 1").select("garbled")
    options = judged.join(several, "garbled", "left_semi").groupBy("garbled").agg(F.collect_set("original").alias("options"))  # words of one lossy form
    return best.select("garbled", "original", "chain", "weak"), options


def find_garbled(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tokens, options): the garbled words of each document, and the originals of forms that have several.

    tokens: (id, garbled, original, chain), one row per document and garbled
    word; original is null for words with U+FFFD that match no corpus word.
    Words are runs between ASCII white space, without ASCII punctuation around
    them; pure ASCII words can't show any garbling.

    Corpus words and their document counts come from all documents. Document
    words are first held against a broadcast Bloom filter (bounded size) of the
    garbled forms, so that frequent clean words aren't shuffled again. Weak
    forms count only beside another word garbled by the same chain.

    Null ids, null and empty texts give no rows; repeated rows count once.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & F.col("t").rlike(r"[^\x00-\x7f]"))
    flat = rows.select("id", F.explode(words_of(F.col("t"))).alias("word")).where("word <> ''")
    words = materialize(flat.groupBy("word").agg(F.count("*").alias("n")))
    table, options = garbled_table(words)
    table = materialize(table)
    bloom = BloomFilter.build(table, "garbled")
    maybe = bloom.probe(flat, "word", "_maybe").where("_maybe").drop("_maybe")
    sure = F.max(~F.col("weak")).over(Window.partitionBy("id", "chain"))
    tokens = maybe.join(table, F.col("word") == F.col("garbled")).withColumn("sure", sure).where("sure").select("id", "garbled", "original", "chain")
    lost = flat.where(F.col("word").contains("�")).join(table, F.col("word") == F.col("garbled"), "left_anti")
    lost = lost.select("id", F.col("word").alias("garbled"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("int").alias("chain"))
    return tokens.unionByName(lost).dropDuplicates(["id", "garbled"]), options


def _beside(word: str, other: str, left: bool) -> int:
    """Slot of a word and its neighbour (digits as #, without case and punctuation) in the context's bit array."""
    other = re.sub(r"\d+", "#", _STRIP.sub("", other).lower())
    return xxhash.xxh3_64_intdigest(f"{other}\t{word}" if left else f"{word}\t{other}\t") >> (64 - CONTEXT_BITS)


def context_bits(texts: DataFrame) -> np.ndarray:
    """Bit array of all words that aren't ASCII with each of their neighbours; column ``t``. A task sends its set bytes only."""

    def run(batches):
        out = np.zeros(1 << (CONTEXT_BITS - 3), np.uint8)
        for batch in batches:
            slots = []
            for t in batch.column(0).to_pylist():
                parts = t.split()
                for i, p in enumerate(parts):
                    if not p.isascii():
                        word = _STRIP.sub("", p)
                        slots += [_beside(word, parts[i - 1], True)] if i else []
                        slots += [_beside(word, parts[i + 1], False)] if i + 1 < len(parts) else []
            at = np.array(slots, dtype=np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int64))], names=["at", "b"])

    rows = texts.mapInArrow(run, "at long, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (CONTEXT_BITS - 3), np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint8)
    return out


def restore_text(text: str, found: dict[str, tuple[str | None, int, list[str]]], chains: list[int], context: np.ndarray | None = None) -> tuple[str, int, int]:
    """(restored text, garbled words restored, garbled words left).

    found: garbled word -> (original or None, chain, options). Of several
    options the one that the corpus has beside both neighbours counts, else
    beside one, else the original.

    Words in ``found`` are replaced by their verified originals; other words
    that aren't ASCII are undone by the document's own chains where that is
    reversible and shortens them, as for words that occur nowhere else.
    """
    done = left = 0
    out = []
    lost_space = False
    parts = re.split(r"([ \t\r\n\f]+)", text)

    def fits(word: str, i: int) -> int:
        sides = [(parts[j], j < i) for j in (i - 2, i + 2) if 0 <= j < len(parts)]
        slots = [_beside(word, other, left) for other, left in sides if other]
        return sum(int(context[s >> 3] >> (s & 7) & 1) for s in slots)

    for i, part in enumerate(parts):
        if lost_space and part[:2] == "  ":  # the first of them was the no-break space of a garbled form
            part = part[1:]
        lost_space = False
        if not part.isascii():
            core = _STRIP.sub("", part)
            at = part.find(core)
            good, chain, options = found.get(core, (None, -1, []))
            if len(options) > 1 and context is not None:
                good = max([good, *sorted(options)], key=lambda w: fits(w, i))
            if good is not None and garble(good, CHAINS[chain]) == core + "\xa0":
                lost_space = True
            if good is None:
                for k in chains:
                    back = ungarble(core, CHAINS[k])
                    if back is not None and len(back) < len(core) and "�" not in back:
                        good = back
                        break
            if good is not None:
                part = part[:at] + good + part[at + len(core) :]
                done += 1
            elif core in found or "�" in core:
                left += 1
        out.append(part)
    return "".join(out), done, left


def restore_garbled(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per garbled document: id, restored, chains, words_restored, words_left.

    Documents that aren't garbled don't appear. See ``find_garbled``.
    """
    tokens, options = find_garbled(docs, id=id, text=text)
    tokens = materialize(tokens)
    named = tokens.join(options, "garbled", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    per_doc = named.groupBy("id").agg(F.collect_list(F.struct("garbled", "original", "chain", "options")).alias("found"))  # words of one document
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))
    shared = docs.sparkSession.sparkContext.broadcast(context_bits(texts.select("t")))
    garbled = BloomFilter.build(tokens.select(F.col("id").alias("key")), "key").probe(texts, "id", "_maybe").where("_maybe").drop("_maybe")  # only these texts are shuffled
    rows = garbled.join(per_doc, "id").dropDuplicates(["id"])

    @F.pandas_udf("restored string, chains string, words_restored int, words_left int")
    def restore(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, rows in zip(texts, found):
            counts: dict[int, int] = {}
            for r in rows:
                if r["chain"] is not None and not np.isnan(r["chain"]):
                    counts[int(r["chain"])] = counts.get(int(r["chain"]), 0) + 1
            order = sorted(counts, key=lambda k: (-counts[k], k))
            words = {r["garbled"]: (r["original"], -1 if r["chain"] is None or np.isnan(r["chain"]) else int(r["chain"]), list(r["options"])) for r in rows}
            s, a, b = restore_text(t, words, order, shared.value)
            out.append((s, "; ".join(CHAIN_NAMES[k] for k in order), a, b))
        return pd.DataFrame(out, columns=["restored", "chains", "words_restored", "words_left"])

    return rows.select(F.col("id").alias(id), restore("t", "found").alias("r")).select(id, "r.*")
