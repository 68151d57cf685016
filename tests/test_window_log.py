"""The stored window log: any cut into batches, streams that stop, ticks and old versions."""

import random

import pytest

from cairnlake.operators import activity, jobs
from cairnlake.sources.versions import Conflict, Versions
from cairnlake.streaming.log import WindowLog

SCHEMA = "id long, ts long, kind string, session_id string, payload string"


def log_rows(seed, n=240):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([10, 100, 850, 901, 3000, -400])
        cmd = rng.choice(["search", "get", "related"])
        payload = "{" if rng.random() < 0.1 else '{"cmd": "%s", "hit_ids": ["n%d"], "expand_ids": ["n%d", "n%d"]}' % (cmd, i % 9, i % 7, i % 5)
        rows.append((i * 3, t, "retrieval", rng.choice([None, None, "", "a", "b"]), payload))
    return rows


def expected(rows, gap=900):
    """Windows by id, one event after another."""
    at, out = {}, {}
    for i, ts, _, s, payload in sorted(rows):
        if payload == "{":
            continue
        if s not in at or ts > out[at[s]][2] + gap:
            at[s], out[i] = i, [s, ts, ts, 0]
        w = out[at[s]]
        w[2], w[3] = max(w[2], ts), w[3] + 1
    return {k: tuple(v) for k, v in out.items()}


def windows(log):
    return {r.id: (r.session_id, r.started_at, r.ended_at, r.queries) for r in log.windows().collect()}


def test_any_cut_gives_the_windows_of_the_whole_log(spark, tmp_path):
    rows, rng = log_rows(1), random.Random(1)
    log = WindowLog(spark, str(tmp_path / "log"), parts=4)
    assert windows(log) == {} and log.advance(spark.createDataFrame([], SCHEMA)) == -1
    cuts = sorted(rng.sample(range(len(rows)), 3)) + [len(rows)]
    for a, b in zip([0, *cuts], cuts):
        part = rows[a:b]
        rng.shuffle(part)
        log.advance(spark.createDataFrame(part, SCHEMA))
    assert windows(log) == expected(rows) and len(windows(log)) > 20
    whole = jobs.derived(activity.parsed(spark.createDataFrame(rows, SCHEMA)), -1)[1]
    key = lambda df: sorted(map(repr, df.select("window_id", "event_id", "ts", "cmd", "note_id", "surface", "session_id").collect()))
    assert key(log.hits()) == key(whole)
    before = Versions(spark, log.root).latest()
    log.advance(spark.createDataFrame(rows[:40], SCHEMA))  # a batch that comes again
    assert Versions(spark, log.root).latest() == before and windows(log) == expected(rows)


def test_a_stream_that_stops_between_commit_and_checkpoint(spark, tmp_path):
    rows, into = log_rows(3, 90), str(tmp_path / "in")
    log = WindowLog(spark, str(tmp_path / "log"), parts=4)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(into)

    class Failing(WindowLog):
        def advance(self, events):
            super().advance(events)
            raise RuntimeError("lost after the commit")

    for n, part in enumerate((rows[:30], rows[30:60], rows[60:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(into)
        if n == 1:
            with pytest.raises(Exception, match="lost after the commit"):
                Failing(spark, log.root, parts=4).start(stream, str(tmp_path / "at"), availableNow=True).awaitTermination()
            assert log.numbers()["mark"] == rows[59][0]
        else:
            log.start(stream, str(tmp_path / "at"), availableNow=True).awaitTermination()
    assert windows(log) == expected(rows) and log.numbers()["mark"] == rows[-1][0]


def test_ticks_are_kept_and_old_versions_go(spark, tmp_path):
    rows = log_rows(5, 150)
    log = WindowLog(spark, str(tmp_path / "log"), parts=2)
    now = max(r[1] for r in rows) + 10**6
    for a in range(0, 150, 50):
        log.advance(spark.createDataFrame(rows[a : a + 50], SCHEMA))
    hits = log.hits().count()
    log.compact(most=2, keep=1)
    files = Versions(spark, log.root)
    state = files.state()
    assert all(len(f) <= 2 for t in ("past", "hits") for f in state["tables"][t]["files"].values())
    assert windows(log) == expected(rows) and log.hits().count() == hits
    assert [n for n in files._names(log.root) if n.endswith(".json")] == [f"v{state['version']}.json"] and files.release(1) == 0
    first = log.tick(now)
    want = jobs.homeostasis(log.windows(), log.hits(), now).first().asDict()
    assert first == want and first["windows"] == len(expected(rows)) and log.numbers()["ticked"] == first["watermark"]
    again = log.tick(now)
    assert again["windows"] == 0 and again["hops"] == first["hops"] and again["sample_seen"] == first["sample_seen"]
    late = spark.createDataFrame([(10**6, now, "retrieval", "a", "{"), (0, -(10**7), "retrieval", "a", "{"), (3, now, "retrieval", "a", "{")], SCHEMA)
    assert {r.id for r in log.retained(late, now).collect()} == {10**6, 3}
    with pytest.raises(Conflict):
        files.change(state, {}, None, {"mark": 0})
