"""Pseudonyms against a plain Python version, and texts that are hard on patterns."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cartloom.llm import pii
from cartloom.llm.common import prepare, scratch

KEY = "k"
MARKED = pii.KEY_MARK + hashlib.sha256(KEY.encode()).hexdigest()


def feistel(left, right, m, n, tag):
    for i in range(pii.ROUNDS):
        other = right if i % 2 == 0 else left
        x = int(hashlib.sha256(f"{MARKED}|{tag}|{i}|{other}".encode()).hexdigest()[:15], 16)
        left, right = ((left + x % m) % m, right) if i % 2 == 0 else (left, (right + x % n) % n)
    return left, right


def digits(d, tag):
    a = len(d) // 2
    b = len(d) - a
    p, q = feistel(int(d[:a] or 0), int(d[a:]), 10**a, 10**b, f"{tag}{len(d)}")
    return (str(p).zfill(a) if a else "") + str(q).zfill(b)


def fill(shape, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def plain_pseudonym(kind, v):
    d = "".join(c for c in v if c.isdigit())
    if kind == "card":
        body = digits(d[:-1], "card")
        return fill(v, body + str(-luhn(body + "0") % 10))
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        p, q = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        area = p // 99 + 1
        return f"{area + (area >= 666):03d}-{p % 99 + 1:02d}-{q + 1:04d}"
    if kind == "ip":
        a, b, c, e = map(int, v.split("."))
        p, q = feistel(a * 256 + b, c * 256 + e, 65536, 65536, "ip")
        return f"{p // 256}.{p % 256}.{q // 256}.{q % 256}"
    if kind == "date":
        n = (datetime.date.fromisoformat(v) - datetime.date(1901, 1, 1)).days
        era, at = divmod(n, pii.ERA)
        p, q = feistel(at // pii.ERA_B, at % pii.ERA_B, pii.ERA_A, pii.ERA_B, f"date{era}")
        return str(datetime.date(1901, 1, 1) + datetime.timedelta(era * pii.ERA + p * pii.ERA_B + q))
    return v[:3] + fill(v[3:], digits(d[1:], "phone"))  # "+1 ..."


def test_pseudonyms_equal_a_plain_version(spark):
    rng, rows = random.Random(4), []
    for _ in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        d = body + str(-luhn(body + "0") % 10)
        rows.append(("card", rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4))])))
        rows.append(("ssn", f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 600)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"))
        rows.append(("ip", ".".join(str(rng.randrange(256)) for _ in range(4))))
        rows.append(("date", str(datetime.date(1901, 1, 1) + datetime.timedelta(rng.randrange(70000)))))
        rows.append(("phone", f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}"))
    docs = spark.createDataFrame([(i, f"x {v}, y") for i, (_, v) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    assert [got[i].text for i in range(len(rows))] == [f"x {plain_pseudonym(*r)}, y" for r in rows]
    assert all(r.n_found == 1 for r in got.values())


def test_ssn_is_a_permutation_of_the_valid_ones(spark):
    areas = spark.range(1, 900).filter("id <> 666").select(F.format_string("%03d-%02d-%04d", "id", F.col("id") % 99 + 1, F.col("id") * 7 % 9999 + 1).alias("v"))
    got = areas.select(pii.ssn(KEY, F.col("v")).alias("v"))
    assert got.distinct().count() == 898 and got.filter(pii.kind_of(F.col("v")) == "ssn").count() == 898


@pytest.mark.parametrize("text", ["x@" + "a." * 500_000 + "com", "a1" * 500_000, "1" * 1_000_000, "a@" * 300_000, "+12 34" * 150_000, "a-" * 300_000 + "@" + "b-" * 300_000, "1234 " * 200_000])
def test_very_long_texts_end(spark, text):
    prepare(spark)
    path = scratch(spark, "long")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(path)  # a literal row would be in every plan
    r = pii.pseudonymise(spark.read.parquet(path), KEY).first()
    assert r.text == text and r.n_found == 0


def test_address_case_long_parts_and_clashing_names(spark):
    rows = [(1, f"Ann.B7@X.Example.com and ANN.b7@X.Example.com {'9' * 40}@a.bc", "u", "v", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, n_found string, _New string")
    out = pii.pseudonymise(docs, KEY)
    r = out.first()
    assert out.columns == ["doc_id", "text", "_found", "n_found", "_New", "n_found_1"] and tuple(r)[2:] == ("u", "v", "w", 3)
    first, second, third = r.text.split(" ")[0], r.text.split(" ")[2], r.text.split(" ")[3]
    assert first.lower() == second.lower() and first != second and first.endswith("@X.Example.com") and first[0].isupper() and first[3] == "."
    assert third != f"{'9' * 40}@a.bc" and third[:40].isdigit() and third[40:] == "@a.bc"


def test_plans_hide_the_key(spark):
    plan = pii.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), KEY)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert MARKED not in plan


def test_redaction_of_the_session_stays(spark):
    name = "spark.sql.redaction.string.regex"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "my-secret-[a-z]+")
        docs = spark.createDataFrame([(1, "call 555 my-secret-abc")], "doc_id long, text string")
        for _ in range(2):
            made = pii.pseudonymise(docs.filter("text <> 'my-secret-xyz'"), "hidden")
        plan = made._jdf.queryExecution().toString()
        assert "my-secret-xyz" not in plan and pii.KEY_MARK not in plan
        assert spark.conf.get(name).count(pii.KEY_PATTERN) == 1
        assert [r.doc_id for r in made.collect()] == [1]
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
