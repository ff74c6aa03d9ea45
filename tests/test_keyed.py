"""State tables in buckets: what a batch reads stays bounded, and folding changes nothing that is read."""

from pyspark.sql import functions as F

from sessionloom.operators import normalize
from sessionloom.plans import ingest
from sessionloom.sources.keyed import KeyedTable

SCHEMA = "k string, n bigint"


def table(spark, path, **options):
    fold = lambda rows: rows.groupBy("k").agg(F.max("n").alias("n"))
    return KeyedTable(spark, str(path), SCHEMA, ("k",), fold, **options)


def test_files_of_a_batch_do_not_grow_with_the_number_of_batches(spark, tmp_path):
    kept = table(spark, tmp_path / "t", buckets=4, most_files=3)
    want, seen = {}, []
    touched = spark.createDataFrame([("a",)], "k string")
    for n in range(14):
        keys = ["a", f"x{n % 7}"]
        kept.append(spark.createDataFrame([(k, n) for k in keys], SCHEMA), "w" if n % 2 else "v")
        want |= {k: n for k in keys}
        read = kept.read(touched)
        seen.append(len(read.inputFiles()))
        assert read.where("k = 'a'").agg(F.max("n")).first()[0] == n
    assert max(seen[7:]) <= max(seen[:7]) <= 2 * 4
    assert {r.k: r.n for r in kept.read().groupBy("k").agg(F.max("n").alias("n")).collect()} == want
    assert any(v[-1] >= 1 for v in kept.versions().values()) and all(len(v) <= 2 for v in kept.versions().values())
    others = [w for w in range(12) if kept.read(spark.createDataFrame([(f"x{w}",)], "k string")).where("k = 'a'").count() == 0]
    assert others  # keys of another bucket do not read this one's files


def test_a_fold_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    kept = table(spark, tmp_path / "t", buckets=1, most_files=2)
    for n in range(2):
        kept.append(spark.createDataFrame([("a", n), (None, n)], SCHEMA), "w")

    def broken(rows):
        return rows.select("k", F.raise_error(F.lit("lost")).cast("bigint").alias("n"))

    dying = KeyedTable(spark, kept.path, SCHEMA, ("k",), broken, 1, 2)
    try:
        dying.append(spark.createDataFrame([("a", 2)], SCHEMA), "w")
        raise AssertionError("the fold should have died")
    except Exception as e:
        assert "lost" in str(e)
    assert sorted(map(tuple, kept.read().collect()), key=str) == sorted([("a", 0), ("a", 1), ("a", 2), (None, 0), (None, 1)], key=str)
    kept.append(spark.createDataFrame([("b", 3)], SCHEMA), "w")
    assert sorted(map(tuple, kept.read().collect()), key=str) == sorted([("a", 2), ("b", 3), (None, 1)], key=str)
    assert table(spark, tmp_path / "none").read().count() == 0


def test_many_batches_equal_one(spark, tmp_path, monkeypatch):
    """Folded warehouse tables give the digests, history and log of a single batch."""
    from sessionloom.sources import keyed

    init = keyed.KeyedTable.__init__
    monkeypatch.setattr(keyed.KeyedTable, "__init__", lambda self, *a, **k: init(self, *a, **{**k, "buckets": 2, "most_files": 2}))
    turns = [(f"s{i % 3}", 1_000_000 + 2000 * i, ("user", "assistant")[i % 2], f"Please do the task {i} now. Is it done {i}?") for i in range(12)]

    def store(wh, batch, rows):
        df = spark.createDataFrame(rows, "session_id string, ts_ms bigint, role string, content string").withColumns({
            "tool": F.lit("claude"), "source_path": F.lit("f"), "end_offset": F.col("ts_ms"), "status": F.lit("ok"), "project_dir": F.lit("/work/p")
        })
        ingest.store_batch(wh, normalize.finish(df), "claude", batch)
        ingest.digest_batch(wh, "claude", batch)

    many, one = (ingest.open_warehouse(spark, f"{tmp_path}/{n}") for n in ("many", "one"))
    for batch in range(4):
        store(many, batch, turns[3 * batch : 3 * batch + 3])
    store(many, 3, turns[9:])  # a repeated batch
    store(one, 0, turns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(many.digests().drop("body")) == rows(one.digests().drop("body"))
    assert rows(many.progress_log().select("project", "entry")) == rows(one.progress_log().select("project", "entry"))
    assert {r.value for r in one.history().collect()} <= {r.value for r in many.history().collect()}
    assert any(v[-1] for v in many._session_state().versions().values())


def test_the_buckets_of_a_small_append_are_written_by_several_tasks(spark, tmp_path):
    kept = table(spark, tmp_path / "t", buckets=16)
    kept.append(spark.createDataFrame([(f"k{n}", n) for n in range(200)], SCHEMA), "w")
    files = kept.read().inputFiles()
    assert len(files) == len({f.split("/bucket=")[1].split("/")[0] for f in files}) == 16  # still a file a bucket
    assert len({f.rsplit("/", 1)[1][:10] for f in files}) > 1
