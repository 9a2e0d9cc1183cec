"""Property tests on random small inputs, checked against brute force."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from replicakit.operators.diff import apply_diff, resync_diff
from replicakit.operators.fold import apply_changes
from replicakit.plans.replica import ChangeSpec, merge_changes

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

LOG_SCHEMA = "k bigint, ts timestamp_ntz, seq bigint, op string, v string"
T0 = dt.datetime(2024, 1, 1)

changes = st.lists(
    st.tuples(st.integers(0, 5), st.integers(0, 20), st.sampled_from(["upsert", "delete"]),
              st.one_of(st.none(), st.text("abc", max_size=2))),
    max_size=40)


def log_rows(raw):
    # seq is unique, so (ts, seq) orders every key's changes totally.
    return [(k, T0 + dt.timedelta(minutes=t), i, op, v) for i, (k, t, op, v) in enumerate(raw)]


def brute_fold(rows, keep_deletes=False):
    newest = {}
    for r in rows:
        if r[0] not in newest or (r[1], r[2]) > (newest[r[0]][1], newest[r[0]][2]):
            newest[r[0]] = r
    return sorted(r for r in newest.values() if keep_deletes or r[3] != "delete")


@SETTINGS
@given(raw=changes)
def test_fold_equals_brute_force(spark, raw):
    rows = log_rows(raw)
    df = spark.createDataFrame(rows, LOG_SCHEMA).repartition(3)
    for keep in (False, True):
        got = sorted(tuple(r) for r in apply_changes(df, ["k"], ["ts", "seq"], keep_deletes=keep)
                     .collect())
        assert got == brute_fold(rows, keep)


@SETTINGS
@given(base_raw=changes, log_raw=changes)
def test_merge_equals_fold_of_union(spark, base_raw, log_raw):
    spec = ChangeSpec(keys=("k",), order=("ts", "seq"), op_col="op")
    base_rows = brute_fold(log_rows(base_raw), keep_deletes=True)
    log = [(k, ts, seq + 1000, op, v) for k, ts, seq, op, v in log_rows(log_raw)]
    base = spark.createDataFrame(base_rows, LOG_SCHEMA)
    logdf = spark.createDataFrame(log, LOG_SCHEMA)
    for keep in (False, True):
        want = brute_fold(base_rows + log, keep)
        fast = sorted(tuple(r) for r in merge_changes(base, logdf, spec, keep).collect())
        assert fast == want


tables = st.lists(st.tuples(st.integers(0, 6), st.one_of(st.none(), st.integers(0, 2))),
                  max_size=12)


@SETTINGS
@given(src_raw=tables, rep_raw=tables)
def test_apply_of_diff_reaches_source(spark, src_raw, rep_raw):
    src_rows = sorted({k: (k, v) for k, v in src_raw}.values())  # source: unique keys
    schema = "k bigint, v int"
    src = spark.createDataFrame(src_rows, schema)
    rep = spark.createDataFrame(rep_raw, schema)  # replica: duplicates allowed
    diff = resync_diff(src, rep, ["k"])
    actions = {r["k"]: r["action"] for r in diff.collect()}
    assert len(actions) == diff.count()  # one row per key
    src_keys, rep_keys = {k for k, _ in src_rows}, {k for k, _ in rep_raw}
    assert {k for k, a in actions.items() if a == "insert"} == src_keys - rep_keys
    assert {k for k, a in actions.items() if a == "delete"} == rep_keys - src_keys
    fixed = apply_diff(rep, diff, ["k"])
    assert sorted(tuple(r) for r in fixed.collect()) == src_rows
    assert resync_diff(src, fixed, ["k"]).count() == 0
    pruned = resync_diff(src, rep, ["k"], exact=False, buckets=3)
    assert sorted(map(tuple, pruned.collect()), key=str) == sorted(map(tuple, diff.collect()),
                                                                   key=str)


polls = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 30),
              st.sampled_from(["replicating", "x Replicating", "initializing", "paused", ""]),
              st.sampled_from(["ready", "READY now", "add", "initializing ready", ""])),
    max_size=40)


@SETTINGS
@given(raw=polls, max_tries=st.integers(1, 8))
def test_gate_by_order_equals_brute_force(spark, raw, max_tries):
    from replicakit.plans.status import ready_gate

    rows = [(rep, t, i, s, d) for i, (rep, t, s, d) in enumerate(raw)]
    df = spark.createDataFrame(
        rows, "replica int, at int, seq int, status_text string, data_state_text string")
    got = {r["replica"]: (r["verdict"], r["tries"])
           for r in ready_gate(df, max_tries, order=["at", "seq"]).collect()}

    def first_word(text, vocab):
        low, best = text.lower(), None
        for w in vocab:
            i = low.find(w)
            if i >= 0 and (best is None or i < best[0] or (i == best[0] and len(w) > len(best[1]))):
                best = (i, w)
        return best[1] if best else None

    status_vocab = ("replicating", "initializing", "paused", "error", "offline", "stopped")
    state_vocab = ("add", "ready", "initializing", "replicating", "offline", "error")
    want = {}
    for rep in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == rep), key=lambda r: (r[1], r[2]))
        verdict, tries = "timeout", min(len(mine), max_tries)
        for n, r in enumerate(mine[:max_tries], start=1):
            if (first_word(r[3], status_vocab) == "replicating"
                    and first_word(r[4], state_vocab) == "ready"):
                verdict, tries = "ready", n
                break
        want[rep] = (verdict, tries)
    assert got == want
