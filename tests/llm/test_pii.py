"""Personal data: positions and base kinds against Python's matcher, checksums, context."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fraudlake.llm import pii
from fraudlake.llm.queries import QUERIES

from conftest import SF_SMALL


def luhn(d):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))]
    return sum(doubled) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}


def brute(text):
    return [(k, m.start(), m.end()) for k, (rx, ok) in BASE.items()
            for m in re.finditer(rx, text or "") if ok(m.group())]


def spans(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.pii for r in pii.find(df, **kw).collect()}
    return [[(s["kind"], s["start"], s["end"]) for s in got[i]] for i in range(len(texts))]


CARD = "4111 1111 1111 1111"
ODD = [
    None, "", " ", "@", "a@b", "a@b.c", "mail a@b.cc_x@d.ee now", "a@b.c.d.@e.f..g", "x@y.z.x@y.z", "%@-.-",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.0.00 1.2.3 1..2.3.4 999999999999999999999.1.1.1",
    f"é𠮷{CARD}", f"{CARD} {CARD}", f"5 {CARD}", CARD.replace(" ", "-"), "4111  1111 1111 1111", "0" * 13, "0" * 20,
    "4111111111111111a 4111111111111112", "+1 (017) 555-7713 +49 30 1234567 ( x", "+12345678 +123456789012345678",
    "++1 22 333 44 5+6 77 888 99 0", "+1.2.3.4.5.6.7.8.9", "٣" * 16, "1 2 3 4 5 6 7 8 9 0 1 2 3 -",
    "no@no no no@no.no " * 400, "9" * 20_000, "a" * 15_000 + "@", "1.2.3.4 " * 3_000 + "\U0001F600 +1 222 333 444",
    "- 1" * 4_000, "a@b" * 5_000 + ".c", "+ (" * 10_000,
]


def test_base_kinds_as_the_plain_patterns_find_them(spark):
    got = spans(spark, ODD, kinds=pii.BASE)
    assert got == [brute(t) for t in ODD]
    assert sum(map(len, got)) > 3_400


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_pii"](spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, r = brute(t), got[i]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans == text            # none of the added kinds occurs there


IBANS = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947",
         "MT84MALT011000012345MTLCAST001S"]


def test_checksums_confirm(spark):
    texts = []
    for x in IBANS:
        grouped = " ".join(x[i:i + 4] for i in range(0, len(x), 4))
        wrong = x[:-1] + ("1" if x[-1] != "1" else "2")
        texts += [x, grouped, f"({grouped}) AND", wrong, x + "7", "Q" + x, x.lower(), "ZZ" + x[2:]]
    got = spans(spark, texts, kinds=[k for k in pii.ADDED if k.name == "iban"])
    for n, x in enumerate(IBANS):
        wide = len(x) + (len(x) - 1) // 4
        one = [[("iban", a, b)] for a, b in ((0, len(x)), (0, wide), (1, 1 + wide))]
        assert got[8 * n:8 * n + 8] == one + [[]] * 5
    for x in IBANS:                     # the check is the number modulo 97
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_context_decides_what_no_checksum_confirms(spark):
    texts = ["my SSN is 123-45-6789.", "part 123-45-6789", "123-45-6789", "ssn 666-45-6789", "ssn 123-00-6789",
             "ssn 123-45-6789x", "ABA routing number 021000021", "021000021", "routing 021000022",
             "order 021000021, no routing", "SSN" + " " * 70 + "123-45-6789", "123-45-6789 (social security)"]
    got = [[s[0] for s in x] for x in spans(spark, texts)]
    assert got == [["ssn"], [], [], [], [], [], ["routing"], [], [], [], [], ["ssn"]]


def test_scores_and_other_columns(spark):
    df = spark.createDataFrame([(None, "write to a@b.cd", "p", "k"), (None, "write to a@b.cd", "p", "k"),
                                (1, None, "p", "k")], "doc_id long, text string, gaps string, kind string")
    got = pii.find(df).collect()
    assert pii.find(df).columns == ["doc_id", "text", "gaps", "kind", "pii"]
    assert sorted(len(r.pii) for r in got) == [0, 1, 1] and {r.gaps + r.kind for r in got} == {"pk"}
    assert {(s.match, s.score) for r in got for s in r.pii} == {("a@b.cd", 1.0)}
    assert pii.find(pii.find(df)).columns == pii.find(df).columns       # replaced, not doubled
    assert pii.find(df.limit(0)).collect() == []


def test_redaction(spark):
    texts = [None, "", f"x a@b.cc_c@d.ee {CARD}, +1 222 333 4444 and 1.2.3.4!", f"IBAN {IBANS[0]} {IBANS[0]}x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.text for r in pii.redact(df).orderBy("doc_id").collect()]
    assert got == [None, "", "x [EMAIL][EMAIL] [CARD], [PHONE] and [IP]!", f"IBAN [IBAN] {IBANS[0]}x"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_running_sums(spark, n):
    a = [(7 * i) % 11 for i in range(n)]
    df = spark.createDataFrame([(a,)], "a array<bigint>")
    assert df.select(pii.running(F.col("a"))).first()[0] == [sum(a[:i]) for i in range(n)]


def test_native_plan(spark):
    plan = QUERIES["op12_pii"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
