import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattice.operators import folds
from lattice.streaming import ordered, tasks


@pytest.fixture(scope="module")
def stateful(spark):
    name, value = ordered.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def feed(spark, path, rows, schema, seed, files=4):
    """Rows in random order in several files, then rows of a key of its own far later, which move the watermark past all."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    later = [r for r in rows[:1]]
    parts = [rows[i::files] for i in range(files)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    for day in ("2030-01-01", "2031-01-01", "2032-01-01"):
        spark.createDataFrame([(-1, pd.Timestamp(day).to_pydatetime(), *later[0][2:])], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.table(name).collect() if r[0] != -1], q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def events(seed, n=60):
    rng = random.Random(seed)
    start = pd.Timestamp("2024-01-01")
    return [(rng.randrange(4), (start + pd.Timedelta(microseconds=rng.randrange(600_000_000))).to_pydatetime(), i, rng.choice(["queued", "parsing", "extracting", "failed"]), rng.random() * 20, rng.random() < 0.5, rng.random() < 0.7) for i in range(n)]


SCHEMA = "user_id long, ts timestamp, event_id long, status string, progress double, ok boolean, counted boolean"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def seconds(rows):
    return [pd.Timestamp(r[1]).value / 1e9 for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_equal_the_batch_fold(stateful, tmp_path, seed):
    rows = events(seed)
    stream = feed(stateful, str(tmp_path / "in"), rows, SCHEMA, seed)
    got, left = run(ordered.rate_limited(stream, 3, 2, lateness="20 minutes"), f"limited{seed}", str(tmp_path / "a"))
    want = [(k, r[2], a) for k, own in by_key(rows).items() for r, a in zip(own, folds.token_bucket(seconds(own), 3, 2), strict=True)]
    assert sorted(got) == sorted(want)
    assert left <= 3  # what belongs to the key that moved the watermark; the others' state is gone


def test_throttle_and_breaker(stateful, tmp_path):
    rows = events(5)
    stream = feed(stateful, str(tmp_path / "in"), rows, SCHEMA, 5)
    got, _ = run(ordered.throttled(stream, "user_id", lateness="20 minutes", step=4, interval=60, terminal=("failed",)), "throttled_o", str(tmp_path / "a"))
    want = []
    for k, own in by_key(rows).items():
        written = folds.throttle(seconds(own), [r[3] for r in own], [r[4] for r in own], ("failed",), 4, 60)
        want += [(k, r[2]) for r, w in zip(own, written, strict=True) if w]
    assert sorted(got) == sorted(want)
    got, _ = run(ordered.breaker(stream, 2, 45.0, lateness="20 minutes"), "breaker_o", str(tmp_path / "b"))
    want = [(k, r[2], s) for k, own in by_key(rows).items() for r, s in zip(own, folds.circuit(seconds(own), [r[5] for r in own], 2, 45.0, [r[6] for r in own]), strict=True)]
    assert sorted(got) == sorted(want)


def test_state_changes(stateful, tmp_path):
    rows = events(8)
    stream = feed(stateful, str(tmp_path / "in"), rows, SCHEMA, 8)
    got, _ = run(ordered.state_changes(stream, "user_id", lateness="20 minutes"), "changes_o", str(tmp_path / "a"))
    want = []
    for k, own in by_key(rows).items():
        before = None
        for r in own:
            ok = folds.legal(before, r[3])
            want.append((k, r[2], r[3], ok))
            before = r[3] if ok else before
    assert sorted(got) == sorted(want)


def test_pages_survive_a_failure_in_the_middle(stateful, tmp_path):
    rng = random.Random(3)
    docs = {d: [f"{d}.{p}" for p in range(1, rng.randrange(2, 7))] for d in range(12)}
    now = pd.Timestamp("2024-05-01").to_pydatetime()
    pages = [(d, p, len(texts), t, now) for d, texts in docs.items() for p, t in enumerate(texts, 1)]
    pages.append((99, 1, 2, "never whole", now))
    rng.shuffle(pages)
    schema, source, sink, checkpoint = "doc_id long, page int, n_pages int, text string, arrived timestamp", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for i in range(6):
        stateful.createDataFrame(pages[i::6], schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return ordered.whole_documents(ordered.page_stream(stateful, source, schema, 1))

    def fail(number):
        # a part of the batch is written, then the worker is lost
        if number == 3:
            stateful.createDataFrame([(-5, 1, "half a batch")], "doc_id long, n_pages int, text string").write.mode("overwrite").parquet(f"{sink}/batch=3")
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ordered.write_batches(stream(), sink, checkpoint, fail).awaitTermination()
    ordered.write_batches(stream(), sink, checkpoint).awaitTermination()
    rows = stateful.read.parquet(sink).collect()
    assert max(r.batch for r in rows) >= 4
    found = {r.doc_id: (r.n_pages, r.text) for r in rows}
    assert {d: found[d] for d in docs} == {d: (len(t), "\n".join(t)) for d, t in docs.items()} and set(found) == set(docs)


def test_steps_are_those_of_the_batch(spark, tmp_path):
    """A failure that doesn't count leaves the count, in the unordered stream too."""
    rows = [(1, i, float(i), False, i % 2 == 0) for i in range(6)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id long, event_id long, t double, ok boolean, counted boolean").write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_id long, t double, ok boolean, counted boolean").parquet(source)
    got = tasks.run_to_end(tasks.breaker(stream, 3, 100.0), "counted", str(tmp_path / "c")).orderBy(F.col("event_id")).collect()
    assert [r.state for r in got] == folds.circuit([r[2] for r in rows], [False] * 6, 3, 100.0, [r[4] for r in rows])
