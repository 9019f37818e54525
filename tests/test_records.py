import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators.bloom import BloomFilter
from tessella.operators.components import connected_components
from tessella.operators.orphans import find_orphans, orphan_report
from tessella.operators.sessions import sessionize

T0 = datetime(2024, 1, 31, 23, 0)
REFS = "id long, ref_id string, at timestamp, _key string"
PARENTS = "key string, valid_from timestamp, valid_to timestamp, id long"


def day(n):
    return T0 + timedelta(days=n)


def orphans(spark, refs, parents, **how):
    r = spark.createDataFrame(refs, REFS)
    p = spark.createDataFrame(parents, PARENTS)
    return find_orphans(r, p, **how)


def test_orphans_by_time_and_deletion(spark):
    refs = [(1, "a", day(5), "x"), (2, "a", day(0), "x"), (3, "a", day(9), None), (4, "b", day(5), None), (5, "c", day(5), None), (6, None, day(5), None), (7, "  ", day(5), None), (8, "a", None, None)]
    parents = [("a", day(1), day(9), 1), ("a", day(1), day(9), 2), ("a", day(12), None, 3), ("b", day(6), None, 4), (None, day(1), None, 5), ("d", None, None, 6)]
    got = {r["id"] for r in orphans(spark, refs, parents).collect()}
    assert got == {2, 3, 4, 5, 8}  # 3: deleted exactly then; 8: no time


def test_orphans_do_not_depend_on_the_filter(spark):
    rng = random.Random(1)
    refs = [(i, f"k{rng.randrange(300)}", day(rng.randrange(10)), None) for i in range(600)]
    parents = [(f"k{i}", day(rng.randrange(10)), None, i) for i in range(0, 300, 2)]
    want = {i for i, k, at, _ in refs if not any(p == k and f <= at for p, f, _, _ in parents)}
    for bits in (1 << 13, 64):  # 64 bits: full, every reference is verified
        assert {r["id"] for r in orphans(spark, refs, parents, max_bits=bits).collect()} == want


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [("a", day(1), None, 1)]).count() == 0
    assert orphans(spark, [(1, "a", day(1), None)], []).count() == 1


def test_orphan_report(spark):
    rows = spark.createDataFrame([(1, "a_1", day(0)), (1, "https://x/1", day(0)), (2, "a_2", day(1)), (3, "a_3", None)], "id long, ref_id string, at timestamp")
    got = {(r[0], r[1]): (r[2], r[3]) for r in orphan_report(rows).collect()}
    assert got == {("chunk", "2024-01"): (1, 1), ("lessons", "2024-01"): (1, 1), ("chunk", "2024-02"): (1, 1), ("chunk", None): (1, 1)}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = BloomFilter.build(keys, "k")
    asked = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), "id").unionByName(spark.createDataFrame([(None, 9999)], "k string, id long"))
    got = {r["id"]: r["hit"] for r in bloom.probe(asked, "k", "hit").collect()}
    assert all(got[i] for i in range(2000)) and not got[9999]
    assert sum(got[i] for i in range(2000, 4000)) < 60


def brute_sessions(rows, gap):
    out, by = [], {}
    for u, t, i, k in set(rows):
        if u is not None and t is not None:
            by.setdefault(u, []).append((t, i, k))
    for u, ev in by.items():
        ev.sort(key=lambda e: e[:2])
        cur = []
        for e in ev:
            if cur and (e[0] - cur[-1][0]).total_seconds() > gap:
                out.append((u, cur))
                cur = []
            cur.append(e)
        out.append((u, cur))
    return sorted((u, c[0][0], c[-1][0], c[0][1], c[-1][1], len(c), len({e[2] for e in c} - {None})) for u, c in out)


def run_sessions(spark, rows, gap=1800):
    df = spark.createDataFrame(rows, "user string, ts timestamp, id long, task string").withColumn("entity", F.lit("clash")).withColumn("edge", F.lit(1))
    got = sessionize(df, entity="user", ts="ts", id="id", kind="task", gap_seconds=gap)
    return sorted((r["entity"], r["start_ts"], r["end_ts"], r["start_id"], r["end_id"], r["n_events"], r["n_kinds"]) for r in got.collect())


def test_sessions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        u = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        t = None if rng.random() < 0.02 else T0 + timedelta(seconds=rng.randrange(3_000_000) if u != "hot" else rng.randrange(400_000))
        rows.append((u, t, i, rng.choice(["t1", "t2", None])))
    rows += rows[:200]  # repeated rows
    assert run_sessions(spark, rows) == brute_sessions(rows, 1800)


def test_one_session_over_all_partitions(spark):
    rows = [("u", T0 + timedelta(minutes=30 * i), i, "t") for i in range(500)]
    got = run_sessions(spark, rows)
    assert len(got) == 1 and got[0][3:] == (0, 499, 500, 1)


def test_session_gap_boundary_and_ties(spark):
    rows = [("u", T0, 2, "x"), ("u", T0, 1, "y"), ("u", T0 + timedelta(seconds=1800), 3, "x"), ("u", T0 + timedelta(seconds=3601), 4, None)]
    got = run_sessions(spark, rows)
    assert [(g[3], g[4], g[5], g[6]) for g in got] == [(1, 3, 3, 2), (4, 4, 1, 0)]


def test_sessions_of_an_empty_table(spark):
    assert run_sessions(spark, []) == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (None, 5), (20, 21), (21, 22), (22, 20)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + chain, "a long, b long")).collect()}
    assert got[4] == got[1] == 1 and got[11] == 10 and got[7] == 7 and got[22] == 20 and 5 not in got
    assert {got[100 + i] for i in range(41)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_a_local_session_may_lack_the_shared_folder():
    from types import SimpleNamespace

    from tessella.session import shared_dir

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    local = session("local[4]")
    assert shared_dir(local) == shared_dir(local)
