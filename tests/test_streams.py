"""Batches that run again, and sessions of progressive filters kept by a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import etl, retrieval
from quillet.sources import readers, sinks
from quillet.streaming import sessions


def ids(df):
    return sorted(r["youtube_id"] for r in df.collect())


def test_batches_that_break_off_change_nothing_twice(spark, tmp_path, monkeypatch):
    out, state = f"file://{tmp_path}/features", f"file://{tmp_path}/state"
    urls = readers.url_lists(spark, ["https://youtu.be/abcdefghijk", "https://youtu.be/bbbbbbbbbbb"])
    fetch = lambda source: ([0.0, 1.0, -1.0] * 500, {})

    def broken(*_):
        raise OSError("killed")

    # Rows are written, but the run ends before they are published.
    with monkeypatch.context() as m:
        m.setattr(sinks, "_announce", broken)
        with pytest.raises(OSError):
            etl.audio_batch(spark, urls, fetch, out, state, "7")
    assert etl.audio_rows(spark, out).count() == 0 and readers.state(spark, state).count() == 0
    # It runs again and is published, but ends before its tracks are marked.
    with monkeypatch.context() as m:
        plain = sinks.mark_processed
        calls = []
        m.setattr(sinks, "mark_processed", lambda *a: plain(*a) if not calls.append(1) and len(calls) == 1 else broken())
        with pytest.raises(OSError):
            etl.audio_batch(spark, urls, fetch, out, state, "7")
    assert ids(etl.audio_rows(spark, out)) == ["abcdefghijk", "bbbbbbbbbbb"] and readers.state(spark, state).count() == 0
    # The same batch, and a later one: no track is fetched again, the marks are made up for.
    assert etl.audio_batch(spark, urls, broken, out, state, "7").count() == 0
    assert ids(readers.state(spark, state)) == ["abcdefghijk", "bbbbbbbbbbb"]
    more = readers.url_lists(spark, ["https://youtu.be/abcdefghijk", "https://youtu.be/ccccccccccc"])
    assert ids(etl.audio_batch(spark, more, fetch, out, state, "8")) == ["ccccccccccc"]
    assert ids(etl.audio_rows(spark, out)) == ["abcdefghijk", "bbbbbbbbbbb", "ccccccccccc"] == ids(readers.state(spark, state))


def test_published_batches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert sinks.published(spark, path, df.schema).count() == 0
    assert sinks.publish(df, path, "a.1") and not sinks.publish(df, path, "a.1") and sinks.publish(df.limit(0), path, "b")
    sinks._announce(spark, path, "a.1", "zzz")  # a second attempt that raced
    assert sinks.published(spark, path, df.schema).count() == 1 and [b for b, _ in sinks.manifest(spark, path)] == ["a.1", "b"]


def test_sessions_keep_their_chips_over_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(120)]
    rows = spark.createDataFrame(vectors, "id long, embedding array<double>")
    chips = {f"q{i}": vectors[i][1] for i in range(6)}

    def events(name, *given):
        data = [(s, f"2024-01-01 {t}", seq, op, query, place) for s, t, seq, op, query, place in given]
        df = spark.createDataFrame(data, "session string, ts string, seq long, op string, query string, place int").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(sessions.EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        sessions.run_chips(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", idle="30 minutes", late="1 minute")
        return {r["session"]: r["chips"] for r in sessions.latest(spark.read.parquet(f"file://{tmp_path}/out")).collect()}

    events("a", ("s", "10:00:00", 2, "add", "q1", None), ("s", "10:00:00", 1, "add", "q0", None), ("t", "10:00:10", 1, "add", "q2", None), ("u", "10:00:00", 1, "add", "q5", None), ("t", "10:00:11", 2, "add", "  ", None), (None, "10:00:11", 2, "add", "q1", None))
    assert run() == {"s": ["q0", "q1"], "t": ["q2"], "u": ["q5"]}
    # A new run from the same checkpoint goes on with the state.
    events("b", ("s", "10:05:00", 3, "add", "q3", None), ("s", "10:06:00", 4, "remove", None, 1), ("t", "10:05:00", 3, "remove", None, 9), ("t", "10:05:30", 4, "add", "q4", None))
    assert run() == {"s": ["q0", "q3"], "t": ["q2", "q4"], "u": ["q5"]}
    # Time passes: sessions that were idle are forgotten, one that goes on isn't.
    events("c", ("s", "10:31:00", 5, "add", "q5", None), ("v", "10:34:00", 1, "clear", None, None))
    run()
    events("d", ("v", "10:35:00", 2, "add", "q1", None))
    got = run()
    assert got == {"s": ["q0", "q3", "q5"], "t": ["q2", "q4"], "u": [], "v": ["q1"]}

    chains = [(s, i + 1, chips[c]) for s, own in got.items() for i, c in enumerate(own)]
    kept = {}
    for r in sessions.survivors(rows, spark.createDataFrame(chains, "session string, step int, vec array<double>")).collect():
        kept.setdefault(r["session"], {})[r["id"]] = r["score"]
    for s, own in got.items():
        asked = [spark.createDataFrame([(chips[c],)], "embedding array<double>") for c in own]
        want = {r["id"]: r["score"] for r in retrieval.progressive_filter(rows, asked).collect()} if asked else {}
        assert kept.get(s, {}) == pytest.approx(want)
    assert sessions.survivors(rows, spark.createDataFrame([], "session string, step int, vec array<double>")).count() == 0


def test_catalogue_files(spark, tmp_path):
    """Songs and news as JSON arrays, a catalogue given by hand, packed texts as CSV, results as JSON."""
    (tmp_path / "songs.json").write_text('[{"id": 1, "title": "T", "artist": "A", "year": 1990, "embedding": [0.5, 1], "more": 3},\n {"id": 2, "title": null}]')
    got = {r["id"]: r for r in readers.songs(spark, f"file://{tmp_path}/songs.json").collect()}
    assert got[1]["title"] == "T" and got[1]["embedding"] == [0.5, 1.0] and got[2]["artist"] is None and "more" not in got[1]
    (tmp_path / "news.json").write_text('[{"id": 1, "title": "N", "date": "2024-02-29", "snippet": "s"}, {"id": 2, "date": "never"}, {"id": 3}]')
    news = {r["id"]: r for r in readers.news(spark, f"file://{tmp_path}/news.json").collect()}
    assert str(news[1]["day"]) == "2024-02-29" and news[3]["day"] is None
    assert [tuple(r) for r in readers.catalog(spark, [("T", "A"), ("U", None)]).collect()] == [("T", "A"), ("U", None)]
    assert sorted(r["body"] for r in sinks.as_json(spark.createDataFrame([(1, "a\"b"), (2, None)], "id int, t string")).collect()) == ['{"id":1,"t":"a\\"b"}', '{"id":2}']
