"""Registered queries: their names, and their SQL twins or plain forms on the small tables."""

import hashlib
import os

import duckdb
import pytest

from quillon.llm import queries
from tests.llm.test_license_scan import walk
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as brute_spans

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)


# --- queries without SQL, against plain forms on the small tables -------------------------------


needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SMALL}/documents.parquet'").fetchall()
    return {i: (text, lang, source) for i, text, lang, source in rows}


def named(name):
    return next(q for n, q in queries.QUERIES.items() if n.startswith(name + "_"))


@needs_tables
def test_op1(spark, documents):
    """Every document is judged; perplexity and limits decide, and few trusted documents go."""
    rows = {r.doc_id: r for r in named("op1")(spark, SMALL).collect()}
    assert rows.keys() == documents.keys()
    for i, (text, lang, _) in documents.items():
        r = rows[i]
        assert r.lang == lang and r.n_units == len((text or "").encode("utf-16-le")) // 2
        assert r.kept == (r.perplexity is None or r.threshold is None or r.perplexity <= r.threshold)
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SMALL}/labels.parquet'").fetchall()
    good, bad = [i for i, q, t in labels if q == 1 and not t], [i for i, q, t in labels if q == 0]
    assert sum(not rows[i].kept for i in good) <= 0.02 * len(good) and sum(not rows[i].kept for i in bad) >= 0.5 * len(bad)


@needs_tables
def test_op2(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, (t, _, _) in documents.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in named("op2")(spark, SMALL).collect()}
    assert got == {i: (*w, w[1] > 2048) for i, w in want.items()}


@needs_tables
def test_op4(spark, documents):
    def path(i, lang, source):
        level = {0: [source], 20: [source, lang], 40: [source, lang, str(i % 8)]}.get(i % 60)
        return "/".join([*level, "LICENSE"] if level else [source, lang, str(i % 8), f"{i}.txt"])

    files = [(i, path(i, lang, source), text) for i, (text, lang, source) in documents.items()]
    got = sorted(((r.doc_id, r.license, r.origin) for r in named("op4")(spark, SMALL).collect()), key=str)
    assert got == walk(files)


@needs_tables
def test_op7(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm import best_fit_packing as bp

    rows = named("op7")(spark, SMALL).collect()
    held = check(rows, [(i, t) for i, (t, _, _) in documents.items()], Tokenizer.from_file(public_tokenizers.path(bp.TOKENIZER)), bp.LENGTH)
    assert len(held) <= 1.05 * sum(r.length for r in rows) / bp.LENGTH + 1


@needs_tables
def test_op8(spark):
    import numpy as np

    from quillon.llm import audio as au

    vectors = dict(duckdb.sql(f"select vec_id, embedding from '{SMALL}/embeddings.parquet'").fetchall())
    prints = {i: au.fingerprint(au.chroma(*au.read_wave(au.recording(v)))) for i, v in vectors.items()}
    asked = [i for i in prints if i % 100 == 0]
    index = au.QueryIndex(asked, [prints[i] for i in asked])
    for r in named("op8")(spark, SMALL).collect():
        want = {m[0]: m[1:] for m in index.matches(prints[r.vec_id]) if m[0] != r.vec_id}
        got = [tuple(map(int, m.split(":"))) for m in r.matches.split(",") if m]
        assert r.n_matches == len(want) == sum(m[1] for m in got) and r.n_prints == len(prints[r.vec_id])
        assert all(want[q] == tuple(m) for q, _, *m in got)
        near = {q for q in asked if q != r.vec_id and len(prints[q]) == r.n_prints and np.bitwise_count(prints[q] ^ prints[r.vec_id]).sum() <= 0.1 * 32 * r.n_prints}
        assert near <= set(want)


@needs_tables
def test_op10(spark, documents):
    from quillon.llm import pii

    for r in named("op10")(spark, SMALL).collect():
        text = documents[r.doc_id][0] or ""
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        listed = [x for x in r.spans.split(",") if x]
        assert listed[: len(base)] == base and all(x.split(":")[0] in pii.EXTRA for x in listed[len(base) :])
