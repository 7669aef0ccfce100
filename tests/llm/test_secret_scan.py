"""op3: trigram queries, spans and redaction against re."""

import random
import re
import time

import pytest

from quillon.llm import secret_scan as ss


def plain(text):
    found = []
    for i, (_, e, group, least) in enumerate(ss.RULES):
        if i == 2:
            e = "[0-9a-f]+"
        found += [(m.start(), i, m.end()) for m in re.finditer(e, text) if len(m[group]) >= least]
    return sorted(found)


def test_trigram_queries():
    assert ss.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert ss.trigram_query("[0-9a-f]+") == ss.ANY
    assert ss.trigram_query("(?:foo|ba[rz])x") == {frozenset({"foo", "oox"}), frozenset({"bar", "arx"}), frozenset({"baz", "azx"})}
    assert ss.trigram_query("abc.*def") == {frozenset({"abc", "def"})}
    assert ss.trigram_query("(?:abc)?x") == ss.ANY
    assert ss.trigram_query("(?:abcd)+") == {frozenset({"abc", "bcd"})}
    for kind, e, *_ in ss.RULES:
        assert (ss.trigram_query(e) == ss.ANY) == (kind == "hex")


def texts():
    r = random.Random(4)
    words = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "AKIA", "=", ":", '"', "'", " ", "\n", "deadbeefdeadbeef", "0123456789abcdef0", "ABCDEFGHIJKLMNOP", "é", "😀", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "eyJabcdefghi.abcdefghij.abcdefghij", "short", "/", "."]
    out = ["", "token=secret: abcdefghijklmnop", "😀 password = 'hunter2hunter2'", "AKIAAKIA" + "B" * 30, "f" * 5000, "token=" + "a" * 100_000]
    return out + ["".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(400)]


def test_spans(spark):
    all_texts = texts()
    rows = [(i, t, "clash", 7) for i, t in enumerate(all_texts)] + [(None, None, "c", 1), (0, "", "c", 1), (5, all_texts[5], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int")
    got = {}
    for row in ss.scan(docs).collect():
        spans = [(s.start, s.rule, s.end) for s in row.spans]
        assert spans == plain(row.text)
        got[row.doc_id] = got.get(row.doc_id, 0) + 1
    assert len(got) == len(all_texts) + 1 and got[0] == got[5] == 2 and got[None] == 1
    assert ss.scan(docs.limit(0)).count() == 0


def test_candidates_keep_all_that_match(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    bits = {r.key: r.rules for r in ss.candidates(spark.createDataFrame(rows, "key long, text string")).collect()}
    for key, text in rows:
        for _, i, _ in plain(text):
            assert i == 2 or bits.get(key, 0) >> i & 1


def test_a_dump_of_a_megabyte(spark):
    """Time grows little faster than the number of matches."""
    line = "deadbeefdeadbeef0123 "
    docs = spark.createDataFrame([(1, line * 50_000), (2, "x")], "doc_id long, text string")
    start = time.time()
    found = ss.scan(docs).selectExpr("doc_id", "size(spans) as n", "get(spans, 49999) as last").collect()
    assert {(r.doc_id, r.n) for r in found} == {(1, 50_000), (2, 0)} and time.time() - start < 60
    assert [tuple(r.last) for r in found if r.n] == [(49_999 * 21, 2, 49_999 * 21 + 20)]
    assert ss.redact(docs.where("doc_id = 1")).first().text == (ss.PLACE + " ") * 50_000


def test_redaction(spark):
    rows = [(i, t, len(t)) for i, t in enumerate(texts())] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, Text2 int")
    out = ss.redact(docs)
    assert out.columns == docs.columns
    for row in out.collect():
        if row[0] is None:
            assert row[1] is None
            continue
        text, done, want = rows[row[0]][1], 0, []
        for a, _, b in plain(text):
            if a >= done:
                want += [text[done:a], ss.PLACE]
            done = max(done, b)
        assert row[1] == "".join([*want, text[done:]])


def test_the_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    docs.write.mode("overwrite").saveAsTable("secret_scan_docs")
    plan = ss.scan(spark.table("secret_scan_docs"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|BroadcastNestedLoop|Cartesian", plan)
    spark.sql("drop table secret_scan_docs")


@pytest.mark.parametrize("bad", ["doc", "TEXT"])
def test_missing_columns(spark, bad):
    with pytest.raises(ValueError):
        ss.scan(spark.createDataFrame([(1, "x")], f"doc_id long, {bad} string"))
