"""Tables on storage: writes, reads, restarts, history, rollback, pruning, compaction, replication."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.expr import Col
from ledgerframe.operators import history, state
from ledgerframe.operators.table import Database
from ledgerframe.sources.manifest import Batch, Conflict
from ledgerframe.streaming.replicate import replicate

SCHEMA = "k string, v string"


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_put_get_overwrite_remove_reopen(spark, tmp_path, db):
    t = db.table("kv", SCHEMA, "k")
    t.put([("hello", "world"), ("empty", "")])
    assert t.get("hello").v == "world" and t.get("missing") is None
    t.put([("hello", "earth")])
    t.remove(["hello", "ghost"])
    assert t.get("hello") is None and not t.exists("hello") and t.get("empty").v == ""
    t.put([("hello", "again"), ("hello", "last")])  # of one batch the last counts
    db.close()
    db.close()
    with pytest.raises(RuntimeError):
        t.get("hello")
    again = Database(spark, f"file://{tmp_path}/db").table("kv")
    assert again.get("hello").v == "last" and again.count() == 2
    assert Database(spark, f"file://{tmp_path}/db").node_id == db.node_id


def test_many_keys_and_compaction(db):
    t = db.table("kv", SCHEMA, "k")
    for i in range(2):
        t.put([(f"key_{j:06d}", f"v{i}") for j in range(500)])
    t.remove([f"key_{j:06d}" for j in range(0, 500, 2)])
    assert t.count() == 250 and {r.v for r in t.rows().collect()} == {"v1"}
    before = rows(t.rows())
    t.compact()
    assert rows(t.rows()) == before and t.stats().first().tombstones == 0
    assert [r.level for r in t.level_stats().collect()] == [1]
    assert t.changes.manifest.vacuum() == 3 and rows(t.rows()) == before


def test_history_rollback_prune(db):
    t = db.table("kv", SCHEMA, "k")
    s1 = t.put([("a", "a1"), ("b", "b1")])
    t.put([("a", "a2"), ("c", "c1")])
    s3 = t.remove(["b"])
    assert [r.v for r in t.history("a").collect()] == ["a1", "a2"] and t.history("none").count() == 0
    assert t.get_at("a", s1).v == "a1" and t.get_at("a", 0) is None and t.get_at("b", s3) is None
    t.rollback_to(s1)
    assert rows(t.rows()) == {("a", "a1"), ("b", "b1")}
    assert {r.origin for r in t.log().collect()} == {"user", "rollback"}
    t.rollback_key("c", s3)
    assert t.get("c").v == "c1"
    now = rows(t.rows())
    n = t.log().count()
    assert t.prune_before(10_000) == n - 3 and rows(t.rows()) == now  # the newest version of each key stays
    assert t.prune_before(10_000, keep_newest=False) == 3 and t.count() == 0


def test_compaction_keeps_history_where_the_preset_does(spark, tmp_path, db):
    t = db.table("kv", SCHEMA, "k")
    s1 = t.put([("a", "a1"), ("b", "b1")])
    t.put([("a", "a2")])
    s3 = t.remove(["b"])
    t.compact()
    t.put([("c", "c1")])
    t.compact()
    t.compact()
    t.changes.manifest.vacuum()
    assert rows(t.rows()) == {("a", "a2"), ("c", "c1")} and t.stats().first().tombstones == 0
    assert [r.v for r in t.history("a").collect()] == ["a1", "a2"] and t.history("b").count() == 2 and t.log().count() == 5
    assert t.get_at("a", s1).v == "a1" and rows(t.as_of(s1)) == {("a", "a1"), ("b", "b1")} and rows(t.as_of(s3)) == {("a", "a2")}
    t.rollback_to(s1)
    assert rows(t.rows()) == {("a", "a1"), ("b", "b1")}
    t.compact()
    assert rows(t.rows()) == {("a", "a1"), ("b", "b1")} and t.prune_before(10_000) > 0
    assert rows(t.rows()) == {("a", "a1"), ("b", "b1")} and t.log().count() == 3
    fast = Database(spark, f"file://{tmp_path}/fast", "FAST").table("kv", SCHEMA, "k")
    fast.put([("a", "a1")])
    fast.put([("a", "a2")])
    fast.compact()
    assert fast.log().count() == 1 and fast.get("a").v == "a2"


def test_index_and_queries(db):
    t = db.table("users", "id long, name string, age int", "id").index("name").index("age")
    t.put([(1, "Alice", 30), (2, "Bob", 25), (3, "Alice", None), (-1, "Neg", 40)])
    assert t.find_by("name", "Alice").id == 3 and t.find_by("age", None).id == 3
    with pytest.raises(KeyError):
        t.find_by("id", 1)
    t.put([(3, "Carol", 5)])
    assert t.find_by("name", "Alice").id == 1  # derived: the earlier row is found again
    assert [r.id for r in t.query().to_list()] == [1, 2, 3, -1]  # key order: negative numbers last
    q = t.query(Col("age") >= 18).where(F.col("name") != "Bob")
    assert [r.id for r in q.limit(1).to_list()] == [1] and q.limit(1).count() == 2 and q.first().id == 1
    assert q.limit(0).first() is None and not t.query(lambda r: r.age and r.age > 99).any() and [r.id for r in q] == [1, -1]
    t.upsert([1, 9], {"age": F.coalesce("age", F.lit(0)) + 1})
    assert t.get(1).age == 31 and tuple(t.get(9)) == (9, None, 1)
    assert [r.id for r in t.scan(2).collect()] == [2, 3, 9, -1] and t.count(2, 9) == 2
    assert t.get_many(t.rows().select("id").where("id > 1")).count() == 3
    assert db.stats().first()["table"] == "users"


def test_value_filters_stay_above_the_merge(spark):
    log = spark.createDataFrame([(1, "P", "k", 5), (2, "P", "k", 1), (3, "P", "j", 7), (4, "D", "j", None)], "seq long, op string, k string, v int")
    assert state.current(log, ["k"]).where("v >= 5").count() == 0


def test_one_writer_wins(db):
    t = db.table("kv", SCHEMA, "k")
    version = t.changes.manifest.current()
    t.put([("a", "1")])
    with pytest.raises(Conflict):
        t.changes.manifest.commit(version, [Batch("x", 0, 1, 1, 1)])
    assert t.get("a").v == "1"


def test_random_operations_match_a_dict(db, spark):
    rng = random.Random(3)
    model, seq, ops = {}, 0, []
    for _ in range(400):
        seq += 1
        k, op = rng.randrange(12), rng.choice("PPD")
        ops.append((seq, op, k, rng.randrange(100) if op == "P" else None))
        model.setdefault(k, []).append(ops[-1])
    log = spark.createDataFrame(ops, "seq long, op string, k int, v int")
    at = lambda t: {(k, v[-1][3]) for k, all_ in model.items() if (v := [x for x in all_ if x[0] <= t]) and v[-1][1] == "P"}
    for t in (0, 7, 150, 400):
        assert {(r.k, r.v) for r in state.as_of(log, ["k"], t).collect()} == at(t)
    targets = history.rollback_targets(log, ["k"], 380).collect()
    assert {r.k for r in targets} == {k for k, x in model.items() if x[-1][0] > 380}
    rolled = history.rollback_rows(log, ["k"], 150, [F.col("k")])
    assert {(r.k, r.v) for r in state.current(log.unionByName(rolled.select(*log.columns)), ["k"]).collect()} == at(150)
    for t in (150, 300):
        pruned = history.prune_before(log, ["k"], 150)
        assert {(r.k, r.v) for r in state.as_of(pruned, ["k"], t).collect()} == at(t)


def test_replication_resumes_and_repeats(spark, tmp_path):
    a, b = (Database(spark, f"file://{tmp_path}/{x}").table("kv", SCHEMA, "k") for x in "ab")
    a.put([("x", "1"), ("y", "1")])
    go = lambda: replicate(spark, a.changes, b.changes, f"file://{tmp_path}/cp", 1).awaitTermination()
    go()
    a.put([("x", "2")])
    a.remove(["y"])
    go()
    go()
    assert rows(b.rows()) == {("x", "2")} and b.log().count() == 4
    assert b.changes.replicate(a.log()) == 4 and b.log().count() == 4  # known rows change nothing


@pytest.mark.parametrize(("preset", "options"), [("NORMAL", {"max_l0": 2, "level_bytes": 1, "blob_bytes": 8}), ("FAST", {"max_l0": 3, "blob_bytes": 8}), ("DURABLE", {"ordering": "natural"})])
def test_random_writes_compactions_and_replicas_match_a_dict(spark, tmp_path, preset, options):
    """Levels, large values, pruned reads, history and a replica that follows now and then, against a dict."""
    rng = random.Random(len(preset))
    a, b = (Database(spark, f"file://{tmp_path}/{x}", preset, **options).table("kv", "k int, v string", "k") for x in "ab")
    state_, states, seq = {}, {}, 0
    for step in range(9):
        kind = rng.choice(["list", "list", "frame", "remove", "compact"])
        keys = [rng.randrange(-15, 15) for _ in range(rng.randrange(1, 8))]
        if kind in ("list", "frame"):
            rows_ = [(k, rng.choice("xyz") * rng.choice([1, 3, 20]) + str(step)) for k in keys]
            seq = a.put(rows_ if kind == "list" else spark.createDataFrame(rows_, "k int, v string").coalesce(1))
            state_.update(rows_)
        elif kind == "remove":
            seq = a.remove(keys)
            state_ = {k: v for k, v in state_.items() if k not in keys}
        else:
            a.compact()
        states[seq] = dict(state_)
        if step % 4 == 3:
            replicate(spark, a.changes, b.changes, f"file://{tmp_path}/cp").awaitTermination()
            assert rows(b.rows()) == set(state_.items())
    assert rows(a.rows()) == set(state_.items()) and a.count() == len(state_)
    for k in rng.sample(range(-16, 16), 4):
        assert (a.get(k).v if k in state_ else a.get(k)) == state_.get(k) and a.exists(k) == (k in state_)
    natural = options.get("ordering") == "natural"
    place = (lambda k: k) if natural else (lambda k: (k < 0, k))
    assert [r.k for r in a.keys().collect()] == sorted(state_, key=place)
    start, end = sorted(rng.sample(range(-15, 15), 2), key=place)
    assert [(r.k, r.v) for r in a.scan(start, end).collect()] == [(k, state_[k]) for k in sorted(state_, key=place) if place(start) <= place(k) < place(end)]
    if preset != "FAST":
        for seq in rng.sample(sorted(states), 2):
            assert rows(a.as_of(seq)) == set(states[seq].items())
        seq = min(states)
        a.rollback_to(seq)
        assert rows(a.rows()) == set(states[seq].items())


def test_as_of_joins_in_blocks(spark):
    rng = random.Random(2)
    log = [(i + 1, rng.choice("PPD"), rng.randrange(4), rng.randrange(99)) for i in range(300)]
    probes = [(i, rng.choice([0, 1, 2, 3, 9, None]), rng.choice([rng.randrange(-5, 320), None])) for i in range(200)]
    want = set()
    for i, k, t in probes:
        found = [x for x in log if x[2] == k and t is not None and x[0] <= t]
        want.add((i, k, t, *(found[-1][:2] if found else (None, None)), found[-1][3] if found else None))
    df, asked = spark.createDataFrame(log, "seq long, op string, k int, v int"), spark.createDataFrame(probes, "id int, k int, t int")
    for block_rows in (10**6, 40, 1):
        assert rows(history.probe_as_of(df, ["k"], asked, "t", "id", block_rows)) == want
    assert rows(history.probe_as_of(df.where("false"), ["k"], asked, "t", "id")) == {(*p, None, None, None) for p in probes}


def test_a_large_value_that_was_changed_on_disk_is_not_read(spark, tmp_path):
    import glob

    t = Database(spark, f"file://{tmp_path}/db", blob_bytes=10).table("kv", SCHEMA, "k")
    t.put([("a", "x" * 50), ("b", "y")])
    (path,) = {p.rsplit("/", 1)[0] for p in glob.glob(f"{tmp_path}/db/tables/kv/blobs/*/*.parquet")}
    spark.read.parquet(f"file://{path}").withColumn("text", F.lit("z" * 50)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/other")
    for p in glob.glob(f"{path}/*"):
        import os

        os.remove(p)
    spark.read.parquet(f"file://{tmp_path}/other").write.mode("append").parquet(f"file://{path}")
    assert rows(t.rows()) == {("b", "y")} and t.get("a") is None
