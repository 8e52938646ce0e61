import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.bpe import CachedEncoder
from llm.packing import difference, pack, windows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    """Every id in exactly one piece, pieces fill their sequence from 0, CRCs match. Returns the fill."""
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (len(by_seq) * capacity)


def test_cached_encoder_equals_the_library():
    random.seed(2)
    texts = ["".join(random.choice("ab \n\t 's<|1. \x1c\x85é") for _ in range(30)) for _ in range(400)]
    texts += ["", " ", "a  b", "a <|endoftext|> b", "x \n \ny", "  x  y", "a b 　c", "퟿😀 z"]
    tok, mine = Tokenizer.from_file(PATH), CachedEncoder(PATH, cache_words=50)
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40])
def test_differencing_partitions_all_items(k):
    random.seed(k)
    for _ in range(50):
        sizes = [random.randint(1, 100) for _ in range(random.randint(1, 60))]
        found = difference(sizes, k)
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and len(found) <= k


def test_differencing_gives_near_equal_windows():
    random.seed(4)
    sizes = [random.randint(1, 2047) for _ in range(2000)]
    sums = [sum(sizes[i] for i in w) for w in difference(sizes, 900)]
    assert len(sums) == 900 and max(sums) - min(sums) < 0.1 * sum(sizes) / 900


def test_windows_respect_capacity_and_waste_little():
    random.seed(5)
    for _ in range(100):
        sizes = [random.randint(1, 63) for _ in range(random.randint(1, 80))]
        windows = windows_of(sizes, 64, 0.01)
        assert all(sum(n for _, _, n in w) <= 64 for w in windows)
        assert len(windows) <= max(-(-sum(sizes) // 64), int(sum(sizes) / (64 * 0.99)))
        for i, s in enumerate(sizes):
            at = 0
            for start, n in sorted((a, n) for w in windows for j, a, n in w if j == i):
                assert start == at
                at += n
            assert at == s


def test_pack_whole_table(spark, documents):
    random.seed(6)
    texts = [None, "", " ", "word", "long " * 9000, "dup", "dup"] + [" ".join(random.choices(["alpha", "beta", "x", "é"], k=random.randint(1, 900))) for _ in range(60)]
    for group in (8, 2048):
        rows = pack(documents(texts).repartition(3), PATH, capacity=256, group=group).collect()
        fill = check(rows, dict(enumerate(texts)), 256)
    assert fill > 0.97


def test_pack_repeated_rows_null_ids_and_empty_table(spark, documents):
    df = documents([(3, "a b c", "s"), (3, "a b c", "s"), (None, "a b c", "s")])
    rows = pack(df.coalesce(1), PATH).collect()
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in rows) == [(False, 4, 4), (False, 4, 4), (True, 4, 4)]
    assert pack(df.limit(0), PATH).count() == 0


def test_sf_table(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert check(e.queries()["op1_packing"](spark, sf).collect(), texts, 2048) > 0.98
