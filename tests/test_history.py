"""Published generations: guards, conflicts, replays, versions, and reads as of each generation."""

import threading

import pytest

from reviewlake.operators import snapshots
from reviewlake.operators.history import History, Refused


def rows(spark, *pairs):
    return spark.createDataFrame([("p", t, h, i) for i, (t, h) in enumerate(pairs)], "property_key string, token string, record_hash string, tenths int")


def refused(code, f):
    with pytest.raises(Refused) as e:
        f()
    assert e.value.code == code


def files(tmp_path):
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("*/*"))


def test_versions_and_states_at_each_generation(spark, tmp_path):
    h = History(spark, str(tmp_path))
    with pytest.raises(LookupError):
        h.current()
    h.publish(rows(spark, ("a", "1"), ("b", "1"), (("c"), None)), 10, None, 3)
    h.publish(rows(spark, ("a", "2"), ("c", None)), 11, 10, 2)
    h.publish(rows(spark, ("d", "1")), 12, 11, 3, complete=False)
    h.publish(rows(spark, ("a", "2"), ("d", "1")), 13, 12, 2)
    h.publish(rows(spark, ("a", "1"), ("b", "9"), ("c", None), ("d", "1")), 14, 13, 4)
    got = sorted((r.token, r.version, r.record_hash, r.valid_from, r.valid_to, r.is_current) for r in h.versions().collect())
    assert got == [("a", 1, "1", 1, 2, False), ("a", 2, "2", 2, 5, False), ("a", 3, "1", 5, None, True), ("b", 1, "1", 1, 5, False), ("b", 2, "9", 5, None, True), ("c", 1, None, 1, None, True), ("d", 1, "1", 3, None, True)]
    assert {(r.token, r.version, r.valid_to) for r in h.versions(2).collect()} == {("a", 1, 2), ("a", 2, None), ("b", 1, None), ("c", 1, None)}
    for c in h.commits():
        columns = ("property_key", "token", "version", "record_hash", "tenths", "presence")
        then = {tuple(r[k] for k in columns) for r in spark.read.parquet(c.state).collect()}
        now = {(*(r[k] for k in columns),) for r in h.as_of(c.generation).collect()}
        assert {x[:4] + x[5:] for x in then} == {x[:4] + x[5:] for x in now}
    counts = [(c.inserted, c.updated, c.unchanged, c.reactivated, c.suspect_missing, c.tombstoned, c.present) for c in h.commits()]
    assert counts == [(3, 0, 0, 0, 0, 0, 3), (0, 1, 1, 0, 1, 0, 2), (1, 0, 0, 0, 0, 0, 3), (0, 0, 2, 0, 1, 1, 2), (0, 2, 2, 2, 0, 0, 4)]
    before = {tuple(r) for r in h.as_of(2).collect()}
    assert h.forget_states() == 4 and h.forget_states() == 0 and {tuple(r) for r in h.as_of(2).collect()} == before and h.current().count() == 4
    assert {r.token for r in h.changes(3).collect()} == {"a", "b", "c"} and h.changes(4, 5).count() == 3


def test_replay_changes_nothing(spark, tmp_path):
    h = History(spark, str(tmp_path))
    first = h.publish(rows(spark, ("a", "1")), 1, None, 1)
    before = files(tmp_path)
    assert not first[1] and h.publish(rows(spark, ("a", "2")), 1, None, 1) == (first[0], True) and files(tmp_path) == before
    h.publish(rows(spark, ("a", "1")), 2, 1, 1)
    refused("RUN_NOT_READY", lambda: h.publish(rows(spark, ("a", "1")), 1, 2, 1))


def test_guards_leave_nothing(spark, tmp_path):
    h = History(spark, str(tmp_path))
    h.publish(rows(spark, ("a", "1"), ("b", "1")), 1, None, 2)
    before = files(tmp_path)
    refused("STALE_BASE_PUBLICATION", lambda: h.publish(rows(spark, ("a", "1")), 2, None, 1))
    refused("RECONCILIATION_MISMATCH", lambda: h.publish(rows(spark, ("a", "1")), 2, 1, 2))
    refused("RECONCILIATION_MISMATCH", lambda: h.publish(rows(spark, ("a", "1"), ("a", "2")), 2, 1, 2))
    refused("RECONCILIATION_MISMATCH", lambda: h.publish(rows(spark, (None, "1")), 2, 1, 1))
    refused("PROMOTION_COUNT_MISMATCH", lambda: h.publish(rows(spark, ("c", "1")), 2, 1, 2, complete=False))
    assert files(tmp_path) == before and h.head().run_id == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    """Both read the same head; the commit file decides, and the loser's files go."""
    History(spark, str(tmp_path)).publish(rows(spark, ("a", "1")), 1, None, 1)
    wait, out = threading.Barrier(2), []

    def run(number):
        h = History(spark, str(tmp_path))
        appear = h._files.appear
        h._files.appear = lambda *x: (wait.wait(60), appear(*x))[1]
        try:
            out.append(("won", h.publish(rows(spark, ("a", str(number))), number, 1, 1)[0].run_id))
        except Refused as e:
            out.append((e.code, number))

    threads = [threading.Thread(target=run, args=(n,)) for n in (2, 3)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(x for x, _ in out) == ["STALE_BASE_PUBLICATION", "won"]
    h = History(spark, str(tmp_path))
    assert [c.run_id for c in h.commits()] == [1, dict(out)["won"]] and h.current().first().record_hash == str(dict(out)["won"])
    assert len(list((tmp_path / "states").iterdir())) == 2 == len(list((tmp_path / "commits").glob("[!.]*")))


def test_content_columns_are_a_parameter(spark):
    df = spark.createDataFrame([("p", "a", "1", "t", 2.5)], "property_key string, token string, record_hash string, title string, size double")
    one = snapshots.promote(None, df, 1, content=("title", "size"))
    assert one.first().title == "t" and snapshots.promote(one, df.limit(0), 2, content=("title", "size")).first().presence == "suspect_missing"
