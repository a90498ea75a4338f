import json
import random
import statistics

import pytest

from lodequarry.operators import clock, context, intervals
from lodequarry.sources import inference_log
from lodequarry.streaming import imports


def line(**k):
    base = dict(schema_version=1, event_id="e1", trace_id="a" * 32, span_id="b" * 16, producer_id="p", clock_id="c", sequence=1, event_type="span_start", wall_time_ns=1, monotonic_ns=(1 << 53) + 1)
    return json.dumps(base | k)


def test_lines_are_checked():
    assert inference_log.check(line())[6] == (1 << 53) + 1
    for bad in ("", "[]", line(trace_id="0" * 32), line(event_type="x"), line(zzz=1), line(sequence=-1), '{"a": 1, "a": 2}', line(name="x" * 20_000)):
        assert inference_log.check(bad)[8]


def test_import_is_idempotent_and_whole(spark, tmp_path):
    store = str(tmp_path / "store")
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "value string")
    end = line(event_id="e2", event_type="span_end", sequence=2, monotonic_ns=(1 << 53) + 11, status="ok")
    assert inference_log.import_batch(store, lines(line(), end, line())) == {"lines": 3, "new": 2, "known": 0, "repeated": 1}
    assert inference_log.import_batch(store, lines(line()))["new"] == 0
    with pytest.raises(inference_log.ConflictError):
        inference_log.import_batch(store, lines(line(sequence=9)))
    with pytest.raises(ValueError):
        inference_log.import_batch(store, lines(line(event_id="e3"), "nonsense"))
    span = imports.spans(spark, store).first()
    assert (span["status"], span["duration_ns"]) == ("ok", 10)


def test_stream_of_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.ndjson").write_text(line() + "\n")
    seen = []
    run = lambda: imports.follow(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), lambda df, n: seen.append(sorted(r["status"] for r in df.collect()))).awaitTermination()
    run()
    (tmp_path / "in" / "2.ndjson").write_text(line() + "\n" + line(event_id="e2", event_type="span_end", sequence=2, status="ok") + "\n")
    run()
    assert seen == [["open"], ["ok"]]


def test_growing_file(spark, tmp_path):
    p = tmp_path / "g.ndjson"
    p.write_text("one\ntwo\nthr")
    df, tail = inference_log.complete_lines(spark, str(p))
    assert [r[0] for r in df.collect()] == ["one", "two"] and tail == 3


def test_paths_and_cycles(spark):
    span = spark.createDataFrame([("t", "a", None, 5), ("t", "b", "a", 7), ("t", "c", "b", 1)], "trace_id string, span_id string, parent_span_id string, duration_ns long")
    links = spark.createDataFrame([("t", "c", "a"), ("t", "c", "b")], "trace_id string, span_id string, source string")
    got = {r["span_id"]: (r["depth"], r["path_ns"]) for r in context.longest_paths(span, links).collect()}
    assert got == {"a": (0, 5), "b": (1, 7), "c": (2, 8)}
    with pytest.raises(Exception, match="cycle"):
        context.longest_paths(span, links.union(spark.createDataFrame([("t", "a", "c")], links.schema))).collect()


def test_scheduler_records(spark):
    step = {"schema": "v", "type": "step", "run_id": "r", "producer_id": "p", "step_id": "s", "ordinal": 1, "total_scheduled_tokens": 5, "requests": [{"request_id": "q", "scheduled_tokens": 5, "scheduled_token_start": 3, "prompt_tokens": 6}], "finished_request_ids": ["z"]}
    rows = [json.dumps(step), json.dumps({"type": "summary", "run_id": "r", "producer_id": "p", "written_records": 1, "dropped_records": 0}), '{"a": 1, "a": 2}', "x"]
    recs = context.records(spark.createDataFrame([(x,) for x in rows], "value string"))
    assert [r["well_formed"] for r in recs.collect()] == [True, True, False, False]
    assert context.capture_state(recs).first()["capture_state"] == "closed"
    s = context.steps(recs)
    q = context.requests(s)
    assert (q.first()["prompt_part"], q.first()["phase"]) == (3, "mixed") and context.step_kinds(s, q).first()["step_kind"] == "mixed"
    assert {(r["request_id"], r["observation"]) for r in context.observations(s).collect()} == {("q", "scheduled"), ("z", "finished_observed")}


def test_clock_fit_is_exact():
    m = clock.fit([(10**18 + k * 1000, 10**18 + 77 + k * 1001) for k in range(50)])
    assert m.slope == clock.Fraction(1001, 1000) and (m.p50, m.p95, m.worst) == (0, 0, 0)
    assert m.map(10**18 + 1000) == 10**18 + 77 + 1001
    with pytest.raises(ValueError):
        clock.fit([(1, 2)] * 9)


def test_clock_fit_takes_the_median_of_all_slopes():
    r = random.Random(3)
    for n in (3, 4, 7, 12, 40, 90):
        for wide in (5, 60, 10**9):
            pairs = [(r.randrange(wide), r.randrange(-wide, wide)) for _ in range(n)]
            ordered = sorted(set(pairs))
            used = [p for k, p in enumerate(ordered) if k % 5 != 4]
            slopes = [clock.Fraction(b[1] - a[1], b[0] - a[0]) for a in used for b in used if b[0] > a[0]]
            if len(ordered) < 3 or not slopes:
                continue
            m = clock.fit(pairs)
            assert m.slope == statistics.median(slopes)
            assert m.intercept == statistics.median([y - m.slope * (x - ordered[0][0]) for x, y in used])


def test_clock_samples_may_be_many(spark):
    rows = [(k % 2, k * 1_000_000, k * 1_000_020 + k % 3) for k in range(10_000)]
    got = clock.fitted(spark.createDataFrame(rows, "rank int, a long, b long"), ["rank"], "a", "b").orderBy("rank").collect()
    assert [(x["rank"], x["slope_ppb"], x["samples"]) for x in got] == [(0, 20_000, 5_000), (1, 20_000, 5_000)]


def test_linked_work_is_counted_like_all_pairs(spark):
    r = random.Random(4)
    some = lambda n, ids: [(r.randrange(2), r.randrange(4), r.choice(ids) if r.random() < 0.2 else 100 + k, a, a + r.choice([0, 0, 3, 40])) for k in range(n) for a in [r.randrange(120)]]
    ops, work = some(40, [1, 2]), some(60, [7, 8, None])
    want = {}
    for d, _, i, a, b in ops:
        hit = [x for x in work if x[0] == d and x[3] <= b and x[4] >= a]
        t, s = want.setdefault(i, (set(), set()))
        t.update(x[2] for x in hit if x[2] is not None), s.update(x[1] for x in hit)
    schema = "device_id long, stream_id long, event_id long, start_ns long, end_ns long"
    got = context.linked_stats(spark.createDataFrame(ops, schema), spark.createDataFrame(work, schema))
    assert sorted(map(tuple, got.collect())) == sorted((i, len(t), len(s)) for i, (t, s) in want.items())
    assert sorted(map(tuple, intervals.overlap_counts(got.selectExpr("0L AS k", "event_id", "tasks AS start_ns", "tasks AS end_ns"), got.selectExpr("0L AS k", "tasks AS start_ns", "tasks + 3 AS end_ns"), ["k"], "event_id", 4).select("event_id", "n").collect())) == sorted((i, sum(len(u) <= len(t) <= len(u) + 3 for u, _ in want.values())) for i, (t, _) in want.items())
