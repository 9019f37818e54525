import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import neardup, packing
from tessella.llm.mixing import Flight, land, mix_shares, mix_sources, water_fill
from tessella.llm.neardup import expand_pairs, near_duplicates, near_groups, variants
from tessella.llm.nearest import nearest_in_time, tick_candidates
from tessella.llm.shingles import Shingled
from tessella.llm.tokens import encoder, token_count, DEFAULT_TOKENIZER

T0 = datetime(2024, 1, 1)


def jaccard_pairs(rows, k, least, words):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None and len(w) >= words:
            sets.setdefault(i, []).append(frozenset(zip(*(w[j:] for j in range(k)))))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if any(len(x & y) / len(x | y) >= least for x in sets[a] for y in sets[b])}


def family_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(25):
        base = [rng.choice(vocab) for _ in range(60)]
        for c in range(5):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((f"d{f}_{c}", " ".join(w)))
    shared = " ".join(vocab[:40])
    rows += [(f"s{i}", f"{shared} {' '.join(rng.choice(vocab) for _ in range(25))}") for i in range(30)]
    rows += [("copy1", rows[0][1].upper()), ("copy2", rows[0][1]), ("copy2", rows[0][1]), ("short", "a b c"), ("none", None), ("empty", ""), (None, rows[0][1]), ("long", "z " * 60_000), ("emoji", "😀 " * 30)]
    return rows


@pytest.mark.parametrize("bucket", [2048, 3])  # with 3, most keys are hot and go through the exact join
def test_near_duplicates_equal_brute_force(spark, bucket):
    rows = family_rows()
    df = spark.createDataFrame(rows, "chunk_id string, content string").withColumn("cls", F.lit(1)).withColumn("key", F.lit("x"))
    links, members = near_duplicates(df, id="chunk_id", text="content", threshold=0.5, shingle=3, min_words=20, max_bucket=bucket)
    got = {tuple(r) for r in expand_pairs(links, members).collect()}
    assert got == jaccard_pairs(rows, 3, 0.5, 20)


def shuffled_records(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_copies_of_texts_are_not_multiplied_in_shuffles(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(40)]
    rows = [(f"{k}-{n}", t) for k in range(8) for n, t in enumerate(texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "i string, t string")  # each partition has a copy of every text
    before = shuffled_records(spark)
    links, members = near_duplicates(df, id="i", text="t", threshold=0.5, shingle=3, min_words=20)
    pairs = expand_pairs(links, members)
    assert pairs.count() == 40 * 8 * 7 // 2
    assert shuffled_records(spark) - before < 24 * len(rows)  # 24 variants of each class, not of each copy


def test_pairs_of_an_id_with_several_texts_come_once(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, far = words[:40], words[:39] + ["x"], [f"z{i}" for i in range(40)]
    rows = [("two", a), ("two", b), ("two", far), ("one", a), ("other", b), ("third", far)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "i string, t string")
    got = sorted(tuple(r) for r in expand_pairs(*near_duplicates(df, id="i", text="t", threshold=0.5, shingle=3, min_words=20)).collect())
    assert got == [("one", "other"), ("one", "two"), ("other", "two"), ("third", "two")]


def test_near_groups(spark):
    rows = family_rows()
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in near_groups(*near_duplicates(df, id="chunk_id", text="content", threshold=0.5, shingle=3, min_words=20)).collect()}
    assert groups["copy1"] == groups["copy2"] == groups["d0_0"] and "short" not in groups
    assert all(groups[a][0] == groups[b][0] for a, b in jaccard_pairs(rows, 3, 0.5, 20))


def test_near_duplicates_of_empty_table(spark):
    links, members = near_duplicates(spark.createDataFrame([], "i long, t string"), id="i", text="t")
    assert links.count() == 0 and members.count() == 0


def test_variants_meet_within_the_radius():
    a = np.arange(1, 6, dtype=np.uint64)[None, :]
    b = a.copy()
    b[0, 2] = 99
    c = b.copy()
    c[0, 4] = 98
    v = [set(variants(x, 1, 0)[0].tolist()) for x in (a, b, c)]
    assert v[0] & v[1] and not v[0] & v[2] and set(variants(a, 2, 0)[0].tolist()) & set(variants(c, 2, 0)[0].tolist())


def test_sketches_agree_as_symbols_do():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (50, 60), dtype=np.uint64)
    b = np.where(rng.random((50, 60)) < 0.5, a, rng.integers(0, 2**63, (50, 60), dtype=np.uint64))
    low = lambda x: (neardup.mix(x[:, : neardup.COARSE]) & np.uint64(15)).astype(int)
    got = neardup.agreeing(*(np.ascontiguousarray(neardup.nibbles(x)).view(np.uint32) for x in (a, b)))
    assert got.tolist() == (low(a) == low(b)).sum(axis=1).tolist()


def test_shingles_by_word():
    s = Shingled(["A b-c d", "a B c D!", "x", "", "é a b c d", "K b c d"], 3)  # the last begins with the Kelvin sign
    assert s.n_words.tolist() == [4, 4, 1, 0, 4, 4] and s.sequence[0] == s.sequence[1] == s.sequence[4] and s.sequence[5] != s.sequence[0]
    assert [len(x) for x in s.sets(np.array([0, 4]))] == [2, 2]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    lefts = [(i, rng.choice(["a", "b", "hot", "hot", None]), None if rng.random() < 0.05 else T0 + timedelta(seconds=rng.randrange(4000))) for i in range(400)]
    rights = [(i, rng.choice(["a", "b", "hot", "hot", None]), None if rng.random() < 0.05 else T0 + timedelta(microseconds=rng.randrange(4_000_000_000))) for i in range(300)]
    rights += [(1000, "tie", T0 + timedelta(seconds=10)), (999, "tie", T0 + timedelta(seconds=30)), (500, "edge", T0)]
    lefts += [(900, "tie", T0 + timedelta(seconds=20)), (901, "edge", T0 + timedelta(seconds=120)), (902, "edge", T0 + timedelta(seconds=121)), (903, "edge", T0 - timedelta(seconds=120)), (904, "edge", T0 + timedelta(microseconds=1))]
    want = {}
    for i, e, t in lefts:
        best = min(((abs((t - u).total_seconds()), j) for j, f, u in rights if t and u and e == f and e and abs((t - u).total_seconds()) <= 120), default=None)
        if best:
            want[i] = best[1]
    schema = "id long, entity string, ts timestamp"
    left = spark.createDataFrame(lefts + lefts[:50], schema).withColumn("block", F.lit(1)).withColumn("left_id", F.lit(2))
    right = spark.createDataFrame(rights + rights[:50], schema).withColumn("tick", F.lit(1)).withColumn("us", F.lit(1))
    got = [(r["left_id"], r["right_id"]) for r in nearest_in_time(left, right).collect()]
    assert len(got) == len(set(got)) and dict(got) == want and want[900] == 999
    assert nearest_in_time(left.limit(0), right).count() == 0 and nearest_in_time(left, right.limit(0)).count() == 0


def test_nearest_with_fractions_on_both_sides(spark):
    rng = random.Random(3)
    lefts = [(i, "a", T0 + timedelta(microseconds=rng.randrange(-4_000_000, 6_000_000))) for i in range(300)]
    rights = [(i, "a", T0 + timedelta(microseconds=rng.randrange(-4_000_000, 6_000_000))) for i in range(40)]
    schema = "id long, entity string, ts timestamp"
    for tol, tick in ((1, 1), (2, 1), (3, 2)):
        want = {i: min((abs(t - u), j) for j, _, u in rights)[1] for i, _, t in lefts if min(abs(t - u) for _, _, u in rights) <= timedelta(seconds=tol)}
        got = dict(r[:2] for r in nearest_in_time(spark.createDataFrame(lefts, schema), spark.createDataFrame(rights, schema), tolerance_seconds=tol, tick_seconds=tick).collect())
        assert got == want


def test_tick_expansion_is_linear_in_the_density(spark):
    """A user with 100 rows a second on the right: no more candidates than two per tick and second with right rows."""
    schema = "entity string, us long"
    lefts = spark.range(2000).select(F.lit("hot").alias("entity"), (F.col("id") * 1_000_000).alias("us"))
    rights = spark.range(20_000).select(F.lit("hot").alias("entity"), (F.col("id") * 10_000 + 3).alias("us"), F.col("id").alias("right_id"))
    n = tick_candidates(lefts, rights, 120_000_000, 1_000_000).count()
    assert n <= 241 * 200 < 241 * 20_000  # 200 seconds hold right rows
    pairs = nearest_in_time(lefts.select("entity", F.timestamp_micros("us").alias("ts"), F.col("us").alias("id")), rights.select("entity", F.timestamp_micros("us").alias("ts"), F.col("right_id").alias("id")))
    assert pairs.count() == 320


def test_token_counts(spark):
    texts = ["Hello world", "", None, "naïve 😀", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(encoder(DEFAULT_TOKENIZER).encode_ordinary(t)) if t else 0 for t in texts]


@pytest.mark.parametrize("kind", ["short", "mixed", "one", "big"])
def test_plan_places_every_item_once(kind):
    rng = np.random.default_rng(4)
    sizes = {"short": rng.integers(1, 60, 4000), "mixed": rng.integers(1, 2049, 3000), "one": np.full(1000, 700), "big": rng.integers(1025, 2049, 500)}[kind]
    counts = np.bincount(sizes, minlength=2049)
    plan = packing.plan_containers(counts, 2048)
    placed = np.zeros_like(counts)
    for pattern, times in plan:
        assert times > 0 and sum(s * m for s, m in pattern.items()) <= 2048
        for s, m in pattern.items():
            placed[s] += m * times
    assert (placed == counts).all()
    n = sum(t for _, t in plan)
    if kind in ("short", "mixed"):
        assert n <= -(-int(sizes.sum()) // 2048) * 1.02 + 1
    if kind == "one":
        assert n == 500
    assert packing.plan_containers(np.zeros(2049, dtype=int), 2048) == []


def test_pack_documents(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randrange(1, 700), "x") for i in range(150)] + [(500, "word " * 5000, "x"), (501, None, None), (502, "", "x"), (None, "word", "x"), (1, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens string").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(df, capacity=512).collect()
    sizes = {d: len(encoder(DEFAULT_TOKENIZER).encode_ordinary(t)) for d, t in ((r["doc_id"], r["text"]) for r in df.collect()) if d is not None and t}
    fill, per = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        per.setdefault(r["doc_id"], []).append(r["tokens"])
    assert max(fill.values()) <= 512 and {d: sum(v) for d, v in per.items()} == sizes
    assert all((len(v) > 1) == (sizes[d] > 512) for d, v in per.items())
    assert set(fill) == set(range(len(fill))) and sum(fill.values()) / (512 * len(fill)) > 0.95
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert packing.container_fill(packing.pack_documents(df, capacity=512), 512).agg(F.max("fill")).first()[0] <= 1.0


def test_water_fill():
    assert water_fill(100, np.array([0.5, 0.5]), np.array([10.0, 1000.0])).tolist() == pytest.approx([10, 90])
    assert water_fill(100, np.array([0.5, 0.5]), np.array([10.0, 20.0])).tolist() == pytest.approx([10, 20])


def test_flight_keeps_both_sums():
    rng = random.Random(1)
    flight, out, sizes = Flight(), [], [rng.randrange(5, 500) for _ in range(400)] + [50] * 20
    for i, n in enumerate(sizes):
        out += flight.add(i, n, 0.37, rng.random())
    assert len(flight.units) <= 2 and len(out) + len(flight.units) == 420
    assert sum(x for *_, x in out) + sum(u[2] for u in flight.units) == pytest.approx(0.37 * 420)
    assert sum(n * x for _, n, x in out) + sum(u[1] * u[2] for u in flight.units) == pytest.approx(0.37 * sum(sizes))
    assert land([]) == [] and {x for *_, x in land([["a", 5, 0.5], ["b", 7, 0.5]])} <= {0, 1}


def test_mix_sources(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randrange(5, 300), rng.choice(["A ", "a", " a", "B", "b", "c"]), "x") for i in range(900)]
    docs += [(2000, "word " * 20_000, "a", "x"), (2001, None, "a", "x"), (2002, "", "b", "x"), (2003, "word", None, "x"), (2004, "word", "unlisted", "x"), (None, "word", "a", "x"), (5, docs[5][1], docs[5][2], "x")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 4), ("C", 0.4, 2), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    uses = mix_sources(df, targets)
    rows = uses.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {r["doc_id"] for r in rows} & {2001, 2002, 2003, 2004, None}
    most = {"a": 1, "b": 4, "c": 2}
    assert all(0 <= r["uses"] <= most[r["source"]] for r in rows)
    own = {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in most}
    total = sum(own.values())
    want = dict(zip("abc", water_fill(total, np.array([0.3, 0.3, 0.4]), np.array([own[s] * most[s] for s in "abc"], dtype=float))))
    for s in most:
        assert sum(r["tokens"] * r["uses"] for r in rows if r["source"] == s) == pytest.approx(want[s], rel=0.01)
    shares = {r["source"]: r for r in mix_shares(uses, targets).collect()}
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1.0, abs=1e-6) and shares["gone"]["times_used"] == 0
    assert sorted(map(tuple, mix_sources(df, targets).collect())) == sorted(map(tuple, rows))  # the same again
    assert mix_sources(df.limit(0), targets).count() == 0 and mix_sources(df, targets.limit(0)).count() == 0
