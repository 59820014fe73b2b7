import hashlib
import re

import pytest
from comparing import assert_same
from pyspark.sql import functions as F

from tracewell.functions.vectors import running
from tracewell.llm import pii, queries
from tracewell.llm.oracles import ORACLES

IBAN = re.compile(r"(^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)")
SSN = re.compile(r"(^|[^0-9A-Za-z+-])[0-9]{3}(-[0-9]+)+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, v):
    digits = re.sub("[^0-9]", "", v)
    match kind:
        case "ip":
            return all(int(p) <= 255 for p in v.split("."))
        case "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        case "phone":
            return 9 <= len(digits) <= 15
        case "iban":
            v = v.replace(" ", "")
            return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
        case "ssn":
            p = v.split("-")
            return [len(x) for x in p] == [3, 2, 4] and p[0] not in ("000", "666") and p[0][0] != "9" and p[1] != "00" and p[2] != "0000"
    return True


def brute(text):
    text, spans = text or "", []
    for kind in pii.KINDS:
        pattern = re.compile(pii.FIXED[kind.name]) if kind.base else {"iban": IBAN, "ssn": SSN}[kind.name]
        last = 0
        for m in pattern.finditer(text):
            start = m.start() + (len(m[1]) if kind.lead else 0)
            if good(kind.name, text[start : m.end()]):
                near = text[max(last, start - pii.WINDOW) : start].lower()
                score = round(kind.prior + (kind.gain if re.search(kind.words, near, re.A) else 0), 2)
                if kind.base or score >= pii.THRESHOLD:
                    spans.append((kind.name, start, m.end(), score, kind.base))
            # A short run of digits is no proposal of cards, so what is before it counts as well.
            if kind.name != "card" or len(re.sub("[^0-9]", "", m[0])) >= 13:
                last = m.end()
    return spans


def digest(spans):
    text = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in s)
    base = [s for s in spans if s[4]]
    return (*[sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")], hashlib.sha256(text(base).encode()).hexdigest(), text(spans))


def test_whole_table_against_sql_and_brute_force(spark, sf_dir):
    assert_same(queries.op12_personal_data(spark, sf_dir), ORACLES["op12_personal_data"], sf_dir)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r["n_email"] + r["n_card"] for r in rows) > 0
    for r in rows:
        assert tuple(r)[1:] == digest(brute(docs[r["doc_id"]]))


TEXTS = [
    "a@b.c_d@e.f and x@y z@w.é a@b@c.d .@d.e-f.", "é1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.255 1.2.3 9999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 0-0 4111111111111111 4",
    "card 4111111111111111123456 40000000000000000 4 2", "+1 (017) 555-7713 +1 2 +12345678901234567 +44-20.7946 0958) x ++1234567890", "pay to my bank DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 today",
    "DE89370400440532013001 XDE89370400440532013000", "his SSN is 123-45-6789, not 123-45-67890 nor 000-12-3456; 123-45-6789", "é😀 ssn: 987-65-4321 ssn: 219-09-9999\nemail me: a.b+c@d-e.example.com, IP 10.0.0.1",
    "", " ", None, "7" * 4000 + " " + "a" * 3000 + "@ " + "1." * 1500 + "+" * 500 + "-1" * 2000, "a@b.co " * 3000 + "é 1.1.1.1 " * 2000,
]


def test_odd_texts(spark, documents):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] * 2 + [(None, "a@b.c", None)]
    got = pii.scan_pii(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute("a@b.c" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert [tuple(s) for s in r["spans"]] == want, r["doc_id"]
    assert {s["kind"] for r in got for s in r["spans"]} == {k.name for k in pii.KINDS}
    for r in pii.digest(pii.scan_pii(documents(rows))).collect():
        assert tuple(r)[1:] == digest(brute("a@b.c" if r["doc_id"] is None else TEXTS[r["doc_id"]]))


def test_words_nearby_decide_without_a_checksum(spark, documents):
    spans = lambda t: [tuple(s)[:4] for s in pii.scan_pii(documents([(1, t, "s")])).first()["spans"]]
    assert spans("order 219-09-9999 is in") == [] and spans("ssn 219-09-9999") == [("ssn", 4, 15, 0.7)]
    assert spans("see 4111111111111111") == [("card", 4, 20, 0.7)] and spans("my visa: 4111111111111111") == [("card", 9, 25, 1.0)]


def test_long_runs_cost_linear_time_and_no_stack(spark, documents):
    text = "7" * 400_000 + " " + "a" * 600_000 + "@ " + "1." * 300_000 + " " + "1-" * 300_000 + " +" + "(" * 200_000 + " a@b.co"
    spans = [tuple(s)[:3] for s in pii.scan_pii(documents([(1, text, "s")])).first()["spans"]]
    assert spans[0] == ("email", len(text) - 6, len(text)) and spans[1:] == [("ip", 1_000_003 + 8 * i, 1_000_010 + 8 * i) for i in range(75_000)]


def test_empty_table(spark, documents):
    assert pii.digest(pii.scan_pii(documents([(1, "a", "b")]).where("false"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 512, 513, 2000])
def test_running_sums(spark, n):
    got = spark.range(1).select(running(F.slice(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: x % 7), 1, n))).first()[0]
    want = [sum((x % 7) for x in range(1, i + 1)) for i in range(n)]
    assert got == want
