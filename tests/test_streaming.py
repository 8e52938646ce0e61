import tempfile

from corpuskit.plans import fixtures as fx
from corpuskit.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_incremental_standardize_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="inc-", dir="/tmp")
    target, ck = f"{base}/target", f"{base}/ck"
    schema = fx.table(spark, SF, "documents").schema
    labels = fx.table(spark, SF, "labels")
    ST.incremental_standardize(spark, SF, schema, labels, target, ck, fx.split_of())
    n1 = spark.read.parquet(target).count()
    ST.incremental_standardize(spark, SF, schema, labels, target, ck, fx.split_of())   # nothing new arrived
    n2 = spark.read.parquet(target).count()
    assert n1 == n2 == labels.count()


def test_stream_documents_matches_batch(spark):
    from corpuskit.operators.scoring import process_document
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    schema = fx.table(spark, SF, "documents").schema
    ST.stream_documents(spark, SF, schema, lambda s: process_document(s, terms=dict(fx.PLAIN_TERMS)), f"{base}/sink", f"{base}/ck")
    streamed = {r.doc_id: r.summary for r in spark.read.parquet(f"{base}/sink").collect()}
    batch = {r.doc_id: r.summary for r in process_document(fx.documents(spark, SF), terms=dict(fx.PLAIN_TERMS)).collect()}
    assert streamed == batch


def test_a_document_that_arrives_before_its_label_is_not_lost(spark):
    base = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    target, ck = f"{base}/target", f"{base}/ck"
    schema = fx.table(spark, SF, "documents").schema
    labels = fx.table(spark, SF, "labels")
    early = labels.where("doc_id % 2 = 0")
    for known in (early, labels, labels):
        ST.incremental_standardize(spark, SF, schema, known, target, ck, fx.split_of())
        rows = ST.standardized_rows(spark, target)
        assert rows.count() == rows.select("doc_id").distinct().count() == known.count()


LABELS = "doc_id long, quality long"
DOCS = "doc_id long, text string"


def _docs(spark, path, ids):
    spark.createDataFrame([(i, f"text {i}") for i in ids], DOCS).coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")


def _labels(spark, path, ids):
    spark.createDataFrame([(i, i % 2) for i in ids], LABELS).coalesce(1).write.mode("append").parquet(f"{path}/labels.parquet")


def test_a_run_stopped_between_its_two_sinks_loses_nothing(spark, tmp_path, monkeypatch):
    base, target, ck = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")
    _docs(spark, base, [1, 2, 3])
    schema = spark.read.parquet(f"{base}/documents.parquet").schema
    some, everything = (spark.createDataFrame([(i, 1) for i in ids], LABELS) for ids in ([1], [1, 2, 3]))
    # stopped as the second sink is about to begin: the first one's query is the last that runs
    real, calls = ST.document_stream, []

    def stopping(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(*args, **kw)
    monkeypatch.setattr(ST, "document_stream", stopping)
    try:
        ST.incremental_standardize(spark, base, schema, some, target, ck, fx.split_of())
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(ST, "document_stream", real)
    for _ in range(2):
        ST.incremental_standardize(spark, base, schema, everything, target, ck, fx.split_of())
        assert sorted(r.doc_id for r in ST.standardized_rows(spark, target).collect()) == [1, 2, 3]


def test_runs_without_a_label_leave_a_readable_table(spark, tmp_path):
    base, target, ck = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")
    _docs(spark, base, [1, 2])
    schema = spark.read.parquet(f"{base}/documents.parquet").schema
    first, both = (spark.createDataFrame([(i, 1) for i in ids], LABELS) for ids in ([1], [1, 2]))
    for labels, there in ((first, [1]), (first, [1]), (first, [1]), (both, [1, 2])):
        ST.incremental_standardize(spark, base, schema, labels, target, ck, fx.split_of())
        assert sorted(r.doc_id for r in ST.standardized_rows(spark, target).collect()) == there


def test_a_table_folder_is_a_source(spark, tmp_path):
    base = str(tmp_path / "in")
    _docs(spark, base, [1, 2])
    _docs(spark, base, [3])
    schema = spark.read.parquet(f"{base}/documents.parquet").schema
    ST.stream_documents(spark, base, schema, lambda s: s, str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [1, 2, 3]


def test_state_holds_what_waits(spark, tmp_path):
    base, target, ck = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")
    _docs(spark, base, [1, 2, 3, 4, 4])
    _labels(spark, base, [1, 9])
    schemas = [spark.read.parquet(f"{base}/{t}.parquet").schema for t in ("documents", "labels")]

    def run():
        docs, labels = (ST.document_stream(spark, base, s, f"{t}.parquet") for s, t in zip(schemas, ("documents", "labels")))
        ST.standardize_with_state(docs, labels, target, ck, fx.split_of())
        return sorted((r.doc_id, r.input_text, r.input_label) for r in spark.read.schema("doc_id long, input_text string, input_label long").parquet(target).collect())

    one = [(1, "text 1", 1)]
    assert run() == one and run() == one  # nothing new arrived: nothing is written twice
    _docs(spark, base, [9])  # its label waited
    _labels(spark, base, [4])  # its two rows waited
    two = sorted(one + [(4, "text 4", 0)] * 2 + [(9, "text 9", 1)])
    assert run() == two
    _labels(spark, base, [2, 3, 1])
    _docs(spark, base, [1])  # the label of an id stays for later rows
    assert run() == sorted(two + [(2, "text 2", 0), (3, "text 3", 1), (1, "text 1", 1)])


def test_match_makes_no_selection_of_frames():
    """F8: rows of a key are sorted apart without pandas selections, the smallest label of a batch counts."""
    import pandas as pd
    from corpuskit.streaming import stream as ST

    class Rows(dict):
        @property
        def loc(self):
            raise AssertionError("a selection for every key")

    class State:
        exists = False

        def update(self, value):
            self.kept = value
    rows = Rows(is_label=pd.Series([False, True, True, True]), text=pd.Series(["a", None, None, None]), label=pd.Series([None, 4, 2, None], dtype=float))
    state = State()
    out = list(ST._match((7,), iter([rows]), state))
    assert out[0].values.tolist() == [[7, "a", 2]] and state.kept == (2, [])
