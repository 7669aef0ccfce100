"""Pipeline stages: each takes documents and gives back the documents that stay, with their columns.

Cases, for all stages: columns are kept as they are, whatever their names; null texts and rows without
doc_id stay unless a stage says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import best_fit_packing, decontaminate, near_dedup, quality, secret_scan
from quillon.llm.common import materialize, project, salted, table, text_key

SALTS = 16


def _plain(docs: DataFrame, **keep: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named by place, but for those in keep (new name = old name); and the new names."""
    own = {old: new for new, old in keep.items()}
    names = [own.pop(name, f"c{i}") for i, name in enumerate(docs.columns)]
    if own:
        raise ValueError(f"missing columns {list(own)}")
    return docs.toDF(*names), names


def _without_texts(docs: DataFrame, bad: DataFrame, with_lang: bool = False) -> DataFrame:
    """docs but for those whose text (and language) is in bad (t1, t2 and lang)."""
    keep = {"text": "text"} | ({"lang": "lang"} if with_lang else {})
    rows, names = _plain(docs, **keep)
    t1, t2 = text_key("text")
    rows = rows.withColumn("t1", t1).withColumn("t2", t2)
    key = ["t1", "t2"]
    if with_lang:
        rows, key = rows.withColumn("key_lang", quality.language_key(F.col("lang"))), [*key, "key_lang"]
        bad = bad.withColumn("key_lang", quality.language_key(F.col("lang")))
    rows, bad = salted(rows, bad.select(*key).distinct(), SALTS, *key)
    return rows.join(bad.hint("shuffle_hash"), [*key, "salt"], "left_anti").select(*names).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; a row of an equal text and language goes too."""
    found = quality.classify(spark, docs, table(spark, sf_dir, "labels"))
    bad = materialize(spark, found.where(~F.col("keep")).select("lang", "t1", "t2"), "rejected")
    return _without_texts(docs, bad, with_lang=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; of rows with one doc_id one stays,
    the one of the smallest text (null first) and, of equal texts, the smallest other columns as JSON. Shingles have
    five words, as for all stages on word shingles; the query op9 has its own size by contract."""
    found = near_dedup.groups(spark, docs)
    rows = materialize(spark, found.select("doc_id", "kept"), "kept")
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("id"))
    again = materialize(spark, rows.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), "repeated")
    plain, names = _plain(docs, id="doc_id")
    left = plain.join(gone.union(again).distinct().hint("shuffle_hash"), "id", "left_anti").select(*names)
    if not again.isEmpty():
        at = names[docs.columns.index("text")]
        order = F.struct(F.coalesce(at, F.lit("")), F.col(at).isNotNull(), F.to_json(F.struct(*names)))
        one = plain.join(again, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*names), order).alias("row"))
        left = left.union(one.select(*[F.col(f"row.{x}").alias(x) for x in names]))
    return left.toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window."""
    found = decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))
    return _without_texts(docs, materialize(spark, found.where("n_hit > 0").select("t1", "t2"), "contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a placeholder; n_chars is that of the new text."""
    out = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    rows, names = _plain(out, text="text", n_chars="n_chars")
    kind = rows.schema["n_chars"].dataType
    size = F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce("text", F.lit("")))).cast(kind)
    return rows.withColumn("n_chars", size).select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return best_fit_packing.pack_documents(spark, project(docs, doc_id="doc_id", text="text"))
