import os
import tempfile

from corpuskit.sources import io
from corpuskit.plans import fixtures as fx
from corpuskit.plans.q_labels import std

SF = "/root/testdata/sf0.001"


def test_write_read_splits_idempotent_and_resolve(spark):
    base = tempfile.mkdtemp(prefix="splits-", dir="/tmp")
    path = os.path.join(base, "std")
    s = std(spark, SF)
    io.write_splits(s, path)                      # mode ignore
    io.write_splits(s.limit(1), path)             # second run is skipped, not appended
    back = io.read_splits(spark, path)
    assert back.count() == s.count()
    assert set(r.split for r in back.select("split").distinct().collect()) <= {"train", "validation", "test"}
    got = io.resolve_source(spark, [os.path.join(base, "missing"), path])
    assert got.count() == s.count()


def test_whole_text_export_and_isolation(spark):
    d = tempfile.mkdtemp(prefix="texts-", dir="/tmp")
    for i in range(3):
        with open(os.path.join(d, f"{i}.txt"), "w") as f:
            f.write(f"doc {i}\nsecond line")
    t = io.read_whole_text(spark, d)
    assert t.count() == 3 and all("\n" in r.text for r in t.collect())
    out = os.path.join(tempfile.mkdtemp(prefix="csv-", dir="/tmp"), "x")
    io.export_csv(fx.v_scotus(spark, SF), out, "doc_id", split="train", n=3)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert back.count() == 3
    status = io.run_isolated({"ok": lambda: None, "bad": lambda: 1 / 0}, spark)
    got = {r.dataset: r.status for r in status.collect()}
    assert got == {"ok": "ok", "bad": "failed"}


def test_literal_texts(spark):
    assert io.literal_texts(spark, ["a", "b"]).count() == 2


def test_load_pairs_kinds(spark):
    from corpuskit.operators import pairs as P
    wl = spark.createDataFrame([(1, "Hard one", "Easy one", "train"), (2, "Hard two", None, "validation"),
                                (3, "Hard three", "Easy three", "test")],
                               "id long, Normal string, Simple string, split string")
    out = P.load_pairs(wl, "wikilarge", "id")
    assert sorted((r.id, r.complex, r.simple, r.split) for r in out.collect()) == [
        (1, "Hard one", "Easy one", "train"), (3, "Hard three", "Easy three", "test")]
    ms = spark.createDataFrame([(i, f"orig {i}", f"simple {i}") for i in range(20)],
                               "id long, original string, simple string")
    out = P.load_pairs(ms, "multisim", "id")        # no splits -> seeded 80/10/10
    assert out.count() == 20 and set(r.split for r in out.collect()) <= {"train", "validation", "test"}
    try:
        P.require_pair_columns(ms, ("complex", "simple"))
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_half_written_table_is_written_again(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="half-", dir="/tmp"), "std")
    s = std(spark, SF)
    s.limit(3).write.partitionBy("split").parquet(path)
    os.remove(os.path.join(path, "_SUCCESS"))
    assert not io.finished(spark, path)
    try:
        io.resolve_source(spark, [path])
        raise AssertionError("expected an error")
    except FileNotFoundError:
        pass
    io.write_splits(s, path)
    assert io.finished(spark, path) and io.read_splits(spark, path).count() == s.count()
