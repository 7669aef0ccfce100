"""The pipeline's stages, each on its own input against a plain form, and what it does with odd tables."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from quillon.llm import best_fit_packing, quality, stages
from quillon.llm import secret_scan as ss
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_packing import check
from tests.llm.test_quality import corpus
from tests.llm.test_secret_scan import plain as plain_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int"


def documents():
    r = random.Random(3)
    good = [t + " ." for t in corpus(5, 150)]
    for i in range(20, 40):  # trusted texts hold secrets, too, so these are no sign of bad quality
        good[i] += f" token = {r.getrandbits(96):024x} "
    passage = " ".join(f"raba{c}" for c in ("na", "th", "ra") * 5)
    for i in (41, 42):  # and benchmark passages
        good[i] += " " + passage
    docs = [(i, t) for i, t in enumerate(good)]
    for i in range(150, 190):
        w = r.choice(good).split(" ")
        w[r.randrange(len(w))] = "bana"
        docs.append((i, " ".join(w)))
    docs += [(200, good[0] + " " + passage), (201, good[1] + " token = deadbeefdeadbeefdeadbeef"), (202, "#%& ZZ@! " * 60), (203, None), (204, ""), (None, good[2]), (None, None), docs[3], docs[3]]
    return [(i, t, "a" if i != 7 else None, "s", len(t) if t is not None else None, 1) for i, t in docs], [(0, passage), (1, "q w e r t y u i o p a s")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, items = documents()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(202, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    store = lambda df: best_fit_packing.materialize(spark, df, "t")

    after = store(stages.drop_low_quality(spark, docs, folder))
    judged = quality.classify(spark, docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    gone = {r.doc_id for r in judged if not r.keep}
    assert after.columns == docs.columns and 202 in gone and None not in gone and len(gone) < 8
    assert rows_of(after) == sorted((tuple(r) for r in docs.collect() if r.doc_id not in gone), key=str)
    docs = after

    after = store(stages.drop_near_duplicates(spark, docs, folder))
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5)
    left = [r.doc_id for r in after.collect()]
    assert sorted(left, key=str) == sorted([g[0] for g in groups if g[0] is None] + [*{g[0] for g in groups if g[3]}], key=str)
    assert set(rows_of(after)) <= set(rows_of(docs))
    docs = after

    after = store(stages.drop_contaminated(spark, docs, folder))
    hits = brute_hits([(r.doc_id, r.text) for r in docs.collect()], documents()[1])
    assert sorted((r.doc_id for r in after.collect()), key=str) == sorted((h[0] for h in hits if not h[2]), key=str) and after.count() < docs.count()
    docs = after

    after = store(stages.redact_secrets(spark, docs, folder))
    want = []
    for r in docs.collect():
        text, done, parts = r.text or "", 0, []
        for a, _, b in plain_spans(text):
            if a >= done:
                parts += [text[done:a], ss.PLACE]
            done = max(done, b)
        text = None if r.text is None else "".join([*parts, text[done:]])
        want.append((r.doc_id, text, r.lang, r.source, None if r.n_chars is None else len(text), r["a.b"]))
    assert after.columns == docs.columns and rows_of(after) == sorted(want, key=str)
    assert any(ss.PLACE in (r.text or "") for r in after.collect())
    docs = after

    known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    library = Tokenizer.from_file(public_tokenizers.path(best_fit_packing.TOKENIZER))
    check(stages.pack(spark, docs.where("doc_id is not null"), folder).collect(), known, library, 2048)
    assert stages.pack(spark, docs, folder).count() == docs.count()


def test_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "secret scans", "best-fit packing"]
    rows = corpus_pipeline.run(spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_quality_stage_uses_all_trusted_texts(spark, tmp_path, monkeypatch):
    """The pipeline's first stage fits its model on every trusted text, 41 million characters here."""
    docs = spark.range(80).selectExpr("id as doc_id", "repeat(md5(string(id)), 16000) as text", "'a' as lang")
    spark.range(80).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")

    class Seen(Exception):
        pass

    def counted(spark, trusted):
        raise Seen(trusted.count())

    monkeypatch.setattr(quality, "fold_counts", counted)
    with pytest.raises(Seen) as seen:
        stages.drop_low_quality(spark, docs, str(tmp_path))
    assert seen.value.args == (80,)
