"""TF-IDF weights of the sentences of each document, the document being the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import sentences
from tessella.session import materialize

#: Terms that are weighed at once.
TERMS = 1 << 20


def _weigh(key: pa.Array, total: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """One row per sentence with a term; total: sentences of each document, terms: its terms by sentence."""
    n = np.diff(terms.offsets.to_numpy())
    per_sentence = terms.flatten()
    flat = per_sentence.flatten().dictionary_encode()
    code, width = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    pair, tf = np.unique(np.repeat(np.arange(len(doc)), np.diff(per_sentence.offsets.to_numpy())) * width + code, return_counts=True)
    sentence, term = pair // width, pair % width
    _, where, df = np.unique(doc[sentence] * width + term, return_inverse=True, return_counts=True)
    w = tf * (np.log((1 + total[doc[sentence]]) / (1 + df[where])) + 1)
    w = w / np.sqrt(np.bincount(sentence, w * w, len(doc)))[sentence]
    begin = np.flatnonzero(np.diff(sentence, prepend=-1))
    own = sentence[begin]
    follows = np.zeros(len(doc), dtype=bool)
    follows[:-1] = doc[1:] == doc[:-1]
    at = np.minimum(np.searchsorted(pair, pair + width), max(0, len(pair) - 1))
    shared = (pair[at] == pair + width) & follows[sentence]
    near = np.bincount(sentence[shared], w[shared] * w[at[shared]], len(doc))[own]
    some = np.bincount(sentence[shared], minlength=len(doc))[own] > 0
    of = (lambda f: f.reduceat(w, begin)) if len(w) else (lambda f: w)
    return pa.RecordBatch.from_arrays(
        [key.take(pa.array(doc[own])), pa.array(place[own], pa.int32()), pa.array(np.diff(np.append(begin, len(w)))), pa.array(of(np.maximum)), pa.array(of(np.add)), pa.array(near, mask=~some)],
        names=["k", "s", "n_terms", "largest", "total", "next_similarity"],
    )


def _weigh_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        held = lists.flatten().offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(held, held[start] + TERMS, side="right")) - 1)
            part = batch.slice(start, stop - start)
            start = stop
            whole = pa.concat_arrays([part.column(2)])
            base = whole.offsets[0].as_py()
            if base:  # a slice keeps the offsets of the batch
                whole = part.column(2).take(pa.array(np.arange(part.num_rows)))
            yield _weigh(part.column(0), part.column(1).to_numpy(zero_copy_only=False), whole)


def sentence_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, n_terms, largest, total, next_similarity) of every sentence with a term.

    Per sentence the number, the largest and the sum of its unit TF-IDF
    weights, and its cosine with the next sentence (null where they share no
    term). A document is weighed where it is read: nothing is shuffled, and no
    row per term is made. Only keys that come with several rows are gathered;
    their sentences of equal number count as one, all of them as the corpus.
    Null keys and texts take no part.
    """
    terms = F.transform(sentences(F.col(text)), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    again = materialize(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))

    def split(part: DataFrame) -> DataFrame:
        return part.select(F.col(key).alias("k"), terms.alias("terms")).select("k", F.size("terms").cast("long").alias("n"), "terms")

    if again.isEmpty():
        ready = split(rows)
    else:
        each = split(rows.join(again, key, "left_semi")).select("k", "n", F.posexplode("terms").alias("s", "t"))
        joined = each.groupBy("k", "s").agg(F.flatten(F.collect_list("t")).alias("t"), F.count("*").alias("n"))
        whole = joined.groupBy("k").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "t"))).alias("x")).select("k", "n", F.col("x.t").alias("terms"))
        ready = split(rows.join(again, key, "left_anti")).unionByName(whole)
    kind = docs.schema[key].dataType.simpleString()
    out = ready.mapInArrow(_weigh_batches, f"k {kind}, s int, n_terms long, largest double, total double, next_similarity double")
    return out.withColumnRenamed("k", key)
