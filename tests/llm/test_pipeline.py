"""The pipeline, stage by stage, against plain versions on its own input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm.mixing import mixed, schedule
from llm.packing import file_runs, pack
from test_ngram_jaccard import plain_components
from test_pii import plain_spans
from test_quality_rules import plain_counts

SF = "/root/testdata/sf0.001"


def test_stages_on_the_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    before, after = seen["quality rules"]
    failed = {i for i, r in before.items() if (c := plain_counts(r.text))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not failed & set(after) and len(after) >= 0.9 * (len(before) - len(failed)) and all(after[i] == before[i] for i in after)
    before, after = seen["near copies"]
    assert set(after) == {i for i, _, c in plain_components([(i, r.text) for i, r in before.items()]) if i == c} and all(after[i] == before[i] for i in after)
    before, after = seen["personal data"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert plain_spans(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == before[i].text or plain_spans(before[i].text) or "[SECRET]" in r.text
    before, after = seen["mixing"]
    assert before == after
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in after.values())
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == total and {p.doc_id for p in pieces} == set(after)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_sequences_follow_the_mix(spark, documents, tmp_path):
    """Over the sequences of a mixed table in many files of unequal sizes, each source is within one block of its
    share at the end of every group; read as Spark reads the files, or without the mix, it is not."""
    weights = {"a": 5, "b": 2, "c": 1}
    every, n = 8, 640
    rows = [(i, " ".join(f"w{(i * 31 + j) % 977}" for j in range(40)).ljust(400, ".")[:400], s) for i, s in enumerate(s for s, w in weights.items() for _ in range(n * w // every))]
    source = {i: s for i, _, s in rows}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed(documents(rows), weights, 400).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(docs.inputFiles()) > 4
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pack(docs, path, run=file_runs(docs), group=16).collect()
    assert sorted({p.sequence_id for p in pieces}) == list(range(1 + max(p.sequence_id for p in pieces)))
    slot = {r.doc_id: r.slot for r in schedule(docs, weights, 400).collect()}
    first = {}
    for p in pieces:
        first[p.doc_id] = min(first.get(p.doc_id, p.sequence_id), p.sequence_id)

    def worst(order):
        """Largest distance from the share, in blocks, where all documents of the sequences so far are a prefix of the mix."""
        at, done, seen, ends = 0.0, dict.fromkeys(weights, 0), set(), 0
        for t, i in enumerate(order):
            done[source[i]] += 1
            seen.add(slot[i])
            if t + 1 == len(order) or first[order[t + 1]] > first[i]:
                if len(seen) == t + 1 == max(seen) + 1:
                    ends += 1
                    at = max(at, *(abs(done[s] - (t + 1) * w / every) for s, w in weights.items()))
        return at, ends
    distance, ends = worst(sorted(first, key=lambda i: (first[i], i)))
    assert distance < 1 and ends >= n // 16 - 1
    assert worst(sorted(first))[1] <= 1
    assert file_runs(documents(rows[:1])) is None


def test_odd_rows_and_empty_table(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    df = documents([(1, text, "s"), (2, text, None), (None, text, "s"), (3, None, "s"), (4, "", "s"), (1, text, "s"), (9, text + " mail a@b.co and 12 more words here", "s")])
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        out = docs.collect()
        assert sorted((r.doc_id or -1) for r in out) == ([] if empty else [-1, 1, 1, 9] if len(out) == 4 else [-1, 1, 1])
        assert np.all([("@" not in r.text) for r in out])
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0) == empty
