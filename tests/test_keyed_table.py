"""Keyed tables against a dictionary: repeated keys, NULL patches, deletes, appends, resets, versions, conflicts."""

import random

import pytest
from pyspark.errors import AnalysisException

from tillcast.operators import keyed_table as kt
from tillcast.session import scratch_path

SCHEMA = "k int, name string, qty int"


def _table(spark, rows=(), buckets=4):
    df = spark.createDataFrame(list(rows), SCHEMA)
    t = kt.KeyedTable.create(spark, scratch_path(spark, "keyed-test"), df, ["k"], buckets)
    if rows:
        t.append(df)
    return t


def _rows(t, version=None):
    return sorted((tuple(r) for r in t.read(version).collect()), key=repr)


def test_random_changes_equal_a_dictionary(spark):
    rnd = random.Random(4)
    state = {k: (k, "base", k) for k in range(20)}
    t = _table(spark, state.values())
    for _ in range(3):
        ups, pats, dels = [], [], []
        changes = []
        for seq in rnd.sample(range(1000), 60):  # distinct numbers, most keys several times
            k, op = rnd.randrange(30), rnd.choice("uupd")
            v = rnd.choice([None, rnd.randrange(100)])
            changes.append((seq, op, k, v))
            if op == "u":
                ups.append((k, f"u{seq}", v, seq))
            elif op == "p":
                pats.append((k, v, seq))
            else:
                dels.append((k, seq))
        u = spark.createDataFrame(ups, SCHEMA + ", s int")
        p = spark.createDataFrame(pats, "k int, qty int, s int")
        d = spark.createDataFrame(dels, "k int, s int")
        t.commit(kt.upserts(u, u["s"]).drop("s"), kt.patches(p, p["s"], ["qty"]).drop("s"), kt.deletes(d, d["s"]).drop("s"))
        for seq, op, k, v in sorted(changes):
            if op == "u":
                state[k] = (k, f"u{seq}", v)
            elif op == "d":
                state.pop(k, None)
            elif k in state:
                state[k] = (k, state[k][1], v)
        assert _rows(t) == sorted(state.values(), key=repr)


def test_versions_reset_append_compact(spark):
    t = _table(spark, [(1, "a", 10), (2, "b", None)])
    assert t.version() == 1
    t.append(spark.createDataFrame([(3, "c", 30)], SCHEMA))
    t.commit(kt.patches(spark.createDataFrame([(1, None), (9, 5)], "k int, qty int"), 1, ["qty"]))
    assert _rows(t) == [(1, "a", None), (2, "b", None), (3, "c", 30)]  # a patch of no row adds none
    t.compact()
    assert _rows(t) == [(1, "a", None), (2, "b", None), (3, "c", 30)]
    t.reset()
    assert _rows(t) == [] and t.read().schema.names == ["k", "name", "qty"]
    t.append(spark.createDataFrame([], SCHEMA))
    t.commit(kt.deletes(spark.createDataFrame([(1,)], "k int"), 1))
    assert _rows(t) == [] and _rows(t, 1) == [(1, "a", 10), (2, "b", None)] and _rows(t, 0) == []
    assert _rows(kt.KeyedTable(spark, t.path), 2) == [(1, "a", 10), (2, "b", None), (3, "c", 30)]


def test_null_keys_and_untouched_buckets(spark):
    t = _table(spark, [(None, "none", 1)] + [(k, "x", k) for k in range(40)], buckets=8)
    before = dict(t._manifest(t.version()))
    t.commit(kt.upserts(spark.createDataFrame([(None, "new", 2)], SCHEMA), 1))
    after = dict(t._manifest(t.version()))
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket rewritten
    assert [r["name"] for r in t.read().where("k is null").collect()] == ["new"] and t.read().count() == 41


def test_second_writer_of_a_version_fails(spark):
    t = _table(spark, [(1, "a", 1)])
    other = kt.KeyedTable(spark, t.path)
    version = other.version()
    t.append(spark.createDataFrame([(2, "b", 2)], SCHEMA))
    with pytest.raises(AnalysisException):
        other._publish(version + 1, [])
    assert len(_rows(t)) == 2
