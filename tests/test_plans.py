"""Plan-shape checks: the physical plans keep the properties the design relies on."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))


def test_textrank_summary_does_not_shuffle(spark):
    p = _plan(E.queries()["textrank_summary"](spark, SF))
    assert "Exchange" not in p and "ArrowEvalPython" in p, p


def test_generation_metrics_read_each_side_once(spark):
    p = _plan(E.queries()["evaluate_generation"](spark, SF))
    assert len(re.findall("Scan parquet", p)) == 2 and _shuffles(p) <= 3, p


def test_profile_scan_prunes_text(spark):
    p = _plan(E.queries()["label_profile"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("text" not in s for s in schemas), schemas


def test_native_text_operators_stay_in_the_jvm(spark):
    for name in ("post_process", "clean_text", "encode_fixed_length", "dictionary_simplify", "word_count"):
        p = _plan(E.queries()[name](spark, SF))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p, name
        assert _shuffles(p) == 0, (name, p)


def test_split_filter_is_pushed_to_the_scan(spark, tmp_path):
    from corpuskit.sources import io
    from corpuskit.plans.q_labels import std
    path = str(tmp_path / "std")
    io.write_splits(std(spark, SF), path)
    p = _plan(io.read_splits(spark, path).where("split = 'test'").select("doc_id"))
    assert "PartitionFilters: [isnotnull(split" in p and "ReadSchema: struct<doc_id:bigint>" in p, p
