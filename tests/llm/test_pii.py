import hashlib
import random
import re

from pyspark.sql import functions as F

from llm.pii import BASE, MORE, find, joined, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(t):
    t = t or ""
    return ([("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
            + [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
            + [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
            + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15])


def spans(df):
    return {r.doc_id: ([(s.kind, s.start, s.end) for s in r.base], [(s.kind, s.start, s.end) for s in r.more]) for r in find(df).collect()}


def test_base_spans_equal_plain_expressions(spark, documents):
    random.seed(3)
    parts = ["a", "@", "b.", ".", "1", "2 ", "-", "+", "(", "255", "é", "😀", " ", "4111111111111111", "x@y.z", "\n", "00"]
    texts = ["".join(random.choice(parts) for _ in range(40)) for _ in range(1200)]
    texts += [None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1.2.3.0255", "é+1 (017) 555-7713x", "😀a@b.co 😀1.2.3.4", "4111 1111-1111 1111"]
    got = spans(documents(texts))
    for i, t in enumerate(texts):
        assert got[i][0] == plain_spans(t), t


def test_long_runs_cost_no_stack(spark, documents):
    texts = ["5" * 200_000, "a" * 200_000, "a.b@" + "c.d" * 100_000, "1 " * 100_000, "a@b.c " * 5_000, "+1" + "(" * 50_000, "1.2.3.4 " * 20_000]
    got = spans(documents(texts))
    for i, t in enumerate(texts):
        if i in (2, 4, 6):
            assert got[i][0] == plain_spans(t)
        else:
            assert got[i][0] == []


def test_the_methods_own_kinds(spark, documents):
    texts = ["DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789", "code 123-45-6789 here", "my ssn is 666-45-6789",
             "call me (555) 123-4567", "part (555) 123-4567", 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC4"', "tel +1 (555) 123-4567"]
    got = spans(documents(texts))
    assert [s[0] for s in got[0][1]] == ["iban", "iban"] and got[1][1] == []
    assert got[2][1] == [("ssn", 10, 21)] and got[3][1] == [] and got[4][1] == []
    assert got[5][1] == [("local_phone", 8, 22)] and got[6][1] == [] and [s[0] for s in got[7][1]] == ["secret"]
    assert got[8] == ([("phone", 4, 21)], [])


def test_context_reaches_across_neighbours(spark, documents):
    """Lists of numbers after one context word: 40 code points of the text as it is, also by ``redact``."""
    ssns = "SSNs: 123-45-6789, 321-54-9876, 219-09-9999"
    pad = "x" * 25
    texts = [ssns, "call 555-123-4567 or 555-987-6543", "555-987-6543 and 555-123-4567 (fax)", f"{ssns} {pad} 123-45-6780", f"😀😀 ssn 1.2.3.4 {pad[:20]} 123-45-6789",
             "mail +1 (555) 123-4567, 555-987-6543 x", "ssn 000-45-6789 ssn 123-45-6789", "part 555-987-6543, mail a@b.co"]
    want = [["123-45-6789", "321-54-9876", "219-09-9999"], ["555-123-4567", "555-987-6543"], ["555-987-6543", "555-123-4567"], ["123-45-6789", "321-54-9876", "219-09-9999"],
            ["123-45-6789"], [], ["123-45-6789"], []]
    got = spans(documents(texts))
    clean = {r.doc_id: r.text for r in redact(documents(texts)).collect()}
    for i, t in enumerate(texts):
        assert [t[a:b] for _, a, b in got[i][1]] == want[i], t
        plain = t
        for kind, a, b in sorted(got[i][0] + got[i][1], key=lambda s: -s[1]):
            plain = plain[:a] + f"[{kind.upper()}]" + plain[b:]
        assert clean[i] == plain, t
    assert clean[5] == "mail [PHONE], 555-987-6543 x"


def test_redact_replaces_what_find_accepts(spark, documents):
    """Spans that meet are replaced as one; long texts with many spans cost no square of their length."""
    random.seed(4)
    parts = ["a", "@", "b.", "1.2.3.4", "2 ", "-", "+1", "é", "😀", " ", "4111111111111111", "x@y.z", "ssn ", "123-45-6789", " 555-123-4567 "]
    texts = ["".join(random.choice(parts) for _ in range(30)) for _ in range(400)] + ["1.2.3.4 " * 20_000, "ssn 123-45-6789, " * 5_000, None, ""]
    got = spans(documents(texts))
    clean = {r.doc_id: r.text for r in redact(documents(texts)).collect()}
    rank = {k: i for i, k in enumerate((*BASE, *MORE))}
    for i, t in enumerate(texts):
        groups = []
        for kind, a, b in sorted(got[i][0] + got[i][1], key=lambda s: s[1:]):
            if groups and a < groups[-1][2]:
                groups[-1] = (min(groups[-1][0], kind, key=rank.get), groups[-1][1], max(groups[-1][2], b))
            else:
                groups.append((kind, a, b))
        at, out = 0, []
        for kind, a, b in groups:
            out += [t[at:a], f"[{kind.upper()}]"]
            at = b
        assert clean[i] == (t if t is None else "".join(out) + t[at:])


def test_digest_columns(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = e.queries()["op4_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = plain_spans(texts[r.doc_id])
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in plain)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in plain) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


def test_redact_repeated_rows_nulls_and_empty_table(spark, documents):
    df = documents([(1, "mail a@b.co now", "s"), (1, "mail a@b.co now", "s"), (None, None, None), (2, "card 4111 1111-1111 1111, 1.2.3.4 or 1.2.3.999", "s"), (3, "ssn 123-45-6789", "s")])
    out = redact(df)
    assert out.columns == df.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert texts == [(0, ""), (1, "mail [EMAIL] now"), (1, "mail [EMAIL] now"), (2, "card [CARD], [IP] or 1.2.3.999"), (3, "ssn [SSN]")]
    assert find(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0
    assert find(df).select(joined(F.col("base"))).count() == 5
    assert set(BASE) & set(MORE) == set()
