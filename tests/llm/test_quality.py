"""op1: the model against a plain Kneser-Ney, the sample, held-out thresholds and odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import quality as q


def plain_model(texts):
    """Interpolated modified Kneser-Ney of characters, straight from the definition: a function of a gram."""
    tables = {q.ORDER: Counter()}
    for t in texts:
        s = q._PAD + t
        tables[q.ORDER].update(s[i : i + q.ORDER] for i in range(len(t)))
    for level in range(q.ORDER - 1, 0, -1):
        tables[level] = Counter(g[1:] for g in tables[level + 1])
    cuts = {}
    for level, counts in tables.items():
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        cuts[level] = [max(0.1, min(i - (i + 1) * y * n[i + 1] / n[i], i - 0.05)) if n[1] and n[2] and n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]
    totals = {level: defaultdict(lambda: [0, 0.0]) for level in tables}
    for level, counts in tables.items():
        for g, c in counts.items():
            totals[level][g[:-1]][0] += c
            totals[level][g[:-1]][1] += min(c, cuts[level][min(c, 3) - 1])

    def p(gram):
        level = len(gram)
        if not level:
            return 1 / q.UNITS
        below = p(gram[1:])
        if gram[:-1] not in totals[level]:
            return below
        total, taken = totals[level][gram[:-1]]
        c = tables[level].get(gram, 0)
        return (max(c - cuts[level][min(c, 3) - 1], 0) if c else 0) / total + taken / total * below

    return p


def corpus(seed, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(("ba", "na", "ra", "é", "th")) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_against_the_definition(spark):
    train, test = corpus(1, 40), [*corpus(2, 10), "", "zzz 😀 BANA", "x" * 3000]
    texts = spark.createDataFrame([("a", t) for t in train], "lang string, text string")
    top = q.materialize(spark, q.gram_counts(texts), "t")
    model = q.materialize(spark, q.model_table(spark, top), "m")
    docs = spark.createDataFrame([(i, lang, i, 0, t) for i, t in enumerate(test) for lang in ("a", "b")], "doc_id long, lang string, t1 long, t2 long, text string")
    p = plain_model(train)
    for r in q.scores(spark, docs, model).collect():
        text = test[r.doc_id]
        units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        assert r.n_units == len(units)
        if r.lang == "b":
            assert r.total is None
            continue
        s = q._PAD + "".join(map(chr, units))
        assert r.total == pytest.approx(sum(math.log(p(s[i : i + q.ORDER])) for i in range(len(units))), rel=1e-5, abs=1e-6)


def test_probabilities_sum_to_one(spark):
    train = corpus(3, 30)
    p = plain_model(train)
    letters = sorted(set("".join(train)))
    known = sum(p("na" + c) for c in letters)
    assert known < 1 and known + (q.UNITS - len(letters)) * p("na￿") == pytest.approx(1)


def test_classify(spark):
    good = corpus(5, 200)
    docs = [(i, "a", t) for i, t in enumerate(good)] + [(500, "a", "#%& ZZ@! " * 50), (501, "a", None), (502, "a", ""), (None, "a", good[0]), (503, "unknown", "#%&"), (504, None, "x"), (3, "a", good[3])]
    labels = [(i, 1, 0) for i in range(150)] + [(500, 0, 0), (3, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 as perplexity", "2 as band")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as lang")
    rows = q.classify(spark, d, l).collect()
    assert len(rows) == len(docs)
    kept = {r.doc_id: r.keep for r in rows}
    assert not kept[500] and all(kept[i] for i in (501, 502, 503, 504, None)) and sum(kept[i] for i in range(200)) >= 198
    none = {r.doc_id: r.perplexity for r in rows}
    assert none[501] is none[502] is none[503] is none[504] is None and none[500] > 20
    empty = spark.createDataFrame([], l.schema)
    assert all(r.keep for r in q.classify(spark, d, empty).collect())
    assert q.classify(spark, d.limit(0), l).count() == 0


def test_thresholds_are_held_out(spark):
    """A band's limit is the quantile of trusted texts under models that have not seen them."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    docs = [(i, "a", " ".join(r.choice(words) for _ in range(r.randint(10, 30)))) for i in range(400)] + [(900, "a", "zq"), (901, "one", "single text")]
    labels = [(i, 1, 0) for i in range(60)] + [(900, 1, 0), (901, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    rows = {x.doc_id: x for x in q.classify(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    t1 = {x.doc_id: x.fold for x in d.select("doc_id", (q.F.pmod(q.text_key("text")[1], q.F.lit(q.FOLDS))).alias("fold")).collect()}
    held = {}
    for k in range(q.FOLDS):
        p = plain_model([t for i, lang, t in docs if lang == "a" and i in {x[0] for x in labels} and t1[i] != k])
        for i, lang, t in docs:
            if lang == "a" and i in {x[0] for x in labels} and t1[i] == k:
                held[i] = math.exp(-sum(math.log(p((q._PAD + t)[j : j + q.ORDER])) for j in range(len(t))) / len(t))
    whole = max(held.values()) * q.SLACK
    assert rows[0].threshold == pytest.approx(whole, rel=1e-4) and rows[900].threshold == pytest.approx(whole, rel=1e-4)
    assert all(rows[i].keep for i in range(400)) and rows[901].threshold is None and rows[901].keep


def test_the_model_has_a_bounded_sample_and_all_trusted_texts_set_limits(spark):
    """With few units the model sees few texts; a text outside the sample is judged by the whole model."""
    good = corpus(21, 600)
    docs = [(i, None if i % 2 else "", t) for i, t in enumerate(good)] + [(900, "", "#%& ZZ@! " * 60), (901, None, "x" * 4000)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    size = sum(map(len, good))
    seen = []
    plain = q.fold_counts

    def counted(spark, trusted):
        seen.append(trusted.selectExpr("sum(length(text)) as n").collect()[0].n)
        return plain(spark, trusted)

    q.fold_counts = counted
    try:
        rows = {r.doc_id: r for r in q.classify(spark, d, labels, units=size // 4).collect()}
    finally:
        q.fold_counts = plain
    assert size / 8 < seen[0] < size / 2
    assert {r.lang for r in rows.values()} == {None, ""} and rows[0].threshold != rows[1].threshold
    assert not rows[900].keep and not rows[901].keep
    limit = {lang: sorted(r.perplexity for r in rows.values() if r.lang == lang and r.doc_id < 600)[-1] * q.SLACK for lang in (None, "")}
    assert all(r.threshold <= limit[r.lang] * 1.3 for r in rows.values()) and sum(not rows[i].keep for i in range(600)) <= 3


def test_held_out_rejection(spark):
    """Of clean texts without a label as many go as the quantile says, about."""
    good = corpus(31, 3000)
    d = spark.createDataFrame(list(enumerate(["en"] * 3000)), "doc_id long, lang string").join(spark.createDataFrame(list(enumerate(good)), "doc_id long, text string"), "doc_id")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    gone = [r.doc_id for r in q.classify(spark, d, labels).collect() if not r.keep]
    assert len([i for i in gone if i >= 1500]) <= 0.015 * 1500 and len([i for i in gone if i < 1500]) <= 0.01 * 1500


def test_the_model_is_fitted_on_all_trusted_texts(spark, monkeypatch):
    """Of 41 million characters no text is left out, and each is judged by a model of the other folds."""
    docs = spark.range(80).selectExpr("id as doc_id", "'a' as lang", "repeat(md5(string(id)), 16000) as text")
    labels = spark.range(80).selectExpr("id as doc_id", "1 as quality", "0 as toxic")

    class Seen(Exception):
        pass

    def counted(spark, trusted):
        raise Seen(trusted.count(), trusted.selectExpr("sum(length(text)) as n").collect()[0].n)

    monkeypatch.setattr(q, "fold_counts", counted)
    with pytest.raises(Seen) as seen:
        q.classify(spark, docs, labels)
    assert seen.value.args == (80, 80 * 32 * 16000)


def test_a_model_too_large_to_broadcast_gives_the_same_sums(spark):
    train, test = corpus(1, 40), [*corpus(2, 10), "", "zzz 😀 BANA", "x" * 3000, "ba", "ba"]
    top = q.materialize(spark, q.gram_counts(spark.createDataFrame([("a", t) for t in train] + [("c", t) for t in corpus(7, 5)], "lang string, text string")), "t")
    model = q.materialize(spark, q.model_table(spark, top), "m")
    docs = spark.createDataFrame([(i, lang, t) for i, t in enumerate(test) for lang in ("a", "b", "c")], "doc_id long, lang string, text string")
    t1, t2 = q.text_key("text")
    docs = docs.select("doc_id", "lang", t1.alias("t1"), t2.alias("t2"), "text")
    read = lambda most: {(r.doc_id, r.lang): r for r in q.scores(spark, docs, model, most).collect()}
    held, joined = read(q.MODEL_ROWS), read(0)
    assert held.keys() == joined.keys() and len(held) == 3 * len(test)
    for key, r in held.items():
        assert joined[key].n_units == r.n_units
        if r.n_units:
            assert joined[key].total is None if r.total is None else joined[key].total == pytest.approx(r.total, rel=1e-6)
