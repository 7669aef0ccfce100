"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted rows are those labelled of good quality and not toxic. N-grams of up to ORDER UTF-16 units are
packed into 64 bits. The model is fitted on all trusted texts. Their counts are summed in each task and then by
key; the lower orders' continuation counts, the context totals and the interpolated probabilities come from joins
of the count tables by language and gram, so every table is sharded by its key. A model of up to MODEL_ROWS grams
is broadcast, and one pass over all documents sums the log-probabilities of each; with a larger one the documents'
grams are joined with it by key, which gives the same sums. The threshold is the QUANTILE of perplexity over all
trusted documents of the language and length band, times SLACK, which allows for the error of so high a quantile.
Each of these is judged by a model that has not seen it, of the other FOLDS - 1 folds; equal texts share a fold,
by a hash. A band with too few documents for the quantile takes the language's threshold, or the band's where that
is larger; one with none takes the language's. A caller may ask for a model of a sample of so many units, drawn by
a hash of the text with an equal share for each language; the query and the pipeline don't.

Cases: null and empty texts have no perplexity and are kept, since there is nothing to judge; so are rows
of a language without trusted text (a null language is one of its own, other than an empty one), or with trusted
text in one fold only, which nothing can judge; a null doc_id can't be
labelled but is scored; repeated rows each give a row, and repeated labels count once, a trusted one only if no
other label of the document is bad; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import forget, joined, materialize, mix, project, small, table, text_key

ORDER, UNITS = 4, 65536
QUANTILE, SLACK = 0.995, 1.05
#: lengths in units from which texts have a threshold of their own: perplexities of short texts vary more
BANDS = (64, 256)
#: grams of a model that is broadcast at most; a larger one is joined
MODEL_ROWS = 4_000_000
#: a sample that a caller asks for is cut by a hash in so many steps
STEPS = 1 << 20
#: trusted texts are judged by models of the other folds (one digit each); ALL is the prefix of the model of all folds
FOLDS, ALL = 5, "a"
#: labelled ids that are broadcast at most; more are joined by shuffling
BROADCAST_IDS = 1_000_000
#: rows by language that are broadcast at most
BROADCAST_LANGUAGES = 100_000
_PAD, _U = "\x02" * (ORDER - 1), np.uint64
BLOCK_CHARS = 1 << 19


def _blocks(texts: list[str]):
    """Ranges of texts of about BLOCK_CHARS characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each unit of the texts, one after another, and each text's end among them."""
    units = [np.frombuffer((_PAD + t).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    lengths = np.array([len(u) for u in units])
    flat = np.concatenate(units).astype(_U)
    grams = flat[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        grams |= flat[ORDER - 1 - j : len(flat) - j] << _U(16 * j)
    keep = np.ones(len(flat), bool)
    starts = np.cumsum(lengths) - lengths
    for j in range(ORDER - 1):
        keep[starts + j] = False
    return grams[keep[ORDER - 1 :]], np.cumsum(lengths - (ORDER - 1))


def _by_language(batch, lang: int, text: int):
    """(language, places of its rows, their texts) for each language of a batch."""
    places: dict[str, list[int]] = {}
    langs, texts = batch.column(lang).to_pylist(), batch.column(text).to_pylist()
    for i, x in enumerate(langs):
        places.setdefault(x, []).append(i)
    for x, at in places.items():
        yield x, at, [texts[i] for i in at]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts (lang, text), summed in each task first."""

    def count(batches):
        held: dict[str, list] = {}

        def flush():
            for lang, (g, n) in held.items():
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, _, mine in _by_language(batch, 0, 1):
                for a, b in _blocks(mine):
                    g, n = np.unique(packed(mine[a:b])[0], return_counts=True)
                    if lang in held:
                        g, back = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = [g, n.astype(np.int64)]
            if sum(len(g) for g, _ in held.values()) > 2_000_000:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts from counts of counts; 0.5 where those are lacking."""
    of = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(i: int):
        value = F.lit(float(i)) - F.lit(i + 1.0) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0)
        return F.when(enough, F.greatest(F.lit(0.1), F.least(value, F.lit(i - 0.05)))).otherwise(F.lit(0.5)).alias(f"d{i}")

    return counts.groupBy("lang").agg(*of).select("lang", d(1), d(2), d(3))


def model_table(spark: SparkSession, top: DataFrame) -> DataFrame:
    """(lang, level, gram, logp, back) of all grams of 1 to ORDER units, from the counts (lang, gram, n) of the longest.

    logp is the natural logarithm of the interpolated probability of the last unit, back that of the
    weight that the gram, taken as a context, gives to the next shorter one (0 if it is no context).
    """
    levels = {ORDER: top}
    for level in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * level)) - 1))
        levels[level] = materialize(spark, levels[level + 1].select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), f"level{level}")
    lower, out, weights = None, [], {}
    for level in range(1, ORDER + 1):
        rows = levels[level]
        rows = rows.join(small(materialize(spark, discounts(rows), "discounts"), BROADCAST_LANGUAGES), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftrightunsigned("gram", 16) if level > 1 else F.lit(0).cast("long")
        rows = rows.select("lang", "gram", "n", cut.alias("cut"), context.alias("context"))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(F.least("cut", "n")).alias("taken"))
        weight = totals.select("lang", "context", "total", (F.col("taken") / F.col("total")).alias("weight"))
        rows = rows.join(weight, ["lang", "context"])
        if lower is None:
            base = F.lit(1.0 / UNITS)
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (16 * (level - 1))) - 1))).join(below, ["lang", "suffix"])
            base = F.col("below")
        p = F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total") + F.col("weight") * base
        lower = materialize(spark, rows.select("lang", "gram", p.alias("p")), f"probability{level}")
        weights[level - 1] = materialize(spark, weight.select("lang", F.col("context").alias("gram"), "weight"), f"weight{level - 1}")
        out.append(lower)
    found = None
    for level in range(0, ORDER + 1):
        if level == 0:  # the empty context
            part = weights[0].select("lang", F.lit(0).alias("level"), "gram", F.lit(-math.log(UNITS)).alias("logp"), F.log("weight").alias("back"))
        else:
            part = out[level - 1].select("lang", F.lit(level).alias("level"), "gram", F.log("p").alias("logp"))
            if level < ORDER:
                part = part.join(weights[level].select("lang", "gram", F.log("weight").alias("back")), ["lang", "gram"], "full").select(
                    "lang", F.lit(level).alias("level"), "gram", "logp", F.coalesce("back", F.lit(0.0)).alias("back")
                )
            else:
                part = part.withColumn("back", F.lit(0.0))
        found = part if found is None else found.unionByName(part)
    return found


class Lookup:
    """An open-addressing table from (level, gram) to (logp, back), in arrays."""

    def __init__(self, level: np.ndarray, gram: np.ndarray, logp: np.ndarray, back: np.ndarray):
        self.bits = max(4, int(2 * len(gram) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, _U)
        self.logp, self.back = np.full(1 << self.bits, np.nan, np.float32), np.zeros(1 << self.bits, np.float32)
        key = self._key(level.astype(_U), gram)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = key[todo[free]]  # of those that meet in a slot the last stays
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.logp[slot], self.back[slot] = logp, back

    @staticmethod
    def _key(level, gram) -> np.ndarray:
        return mix(gram + np.atleast_1d(level) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> _U(64 - self.bits)).astype(np.int64)

    def find(self, level: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logp (nan if the gram is unknown) and back (0 if it is no context)."""
        key = self._key(np.array([level], _U), gram)
        slot = self._slot(key)
        held = self.keys[slot]
        miss = np.flatnonzero((held != key) & (held != 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[miss]]
            miss = miss[(held != key[miss]) & (held != 0)]
        known = self.keys[slot] == key
        return np.where(known, self.logp[slot], np.nan), np.where(known, self.back[slot], 0.0)


def log_probabilities(grams: np.ndarray, model: Lookup) -> np.ndarray:
    """Of each gram's last unit after the others: the longest known gram's, with the weights of the contexts passed on the way."""
    out = np.zeros(len(grams))
    rest = np.arange(len(grams))
    for level in range(ORDER, 0, -1):
        mine = grams[rest] & _U((1 << (16 * level)) - 1)
        logp, _ = model.find(level, mine)
        known = ~np.isnan(logp)
        out[rest[known]] += logp[known]
        rest, mine = rest[~known], mine[~known]
        if not len(rest):
            return out
        out[rest] += model.find(level - 1, mine >> _U(16))[1]
    out[rest] += model.find(0, np.zeros(1, _U))[0][0]
    return out


def lookups(model: DataFrame) -> dict[str, Lookup]:
    """The tables by language of a model of MODEL_ROWS grams at most."""
    rows = model.select("lang", F.col("level").cast("tinyint").alias("level"), "gram", F.col("logp").cast("float").alias("logp"), F.col("back").cast("float").alias("back")).toArrow()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    columns = [rows.column(c).to_numpy() for c in ("level", "gram", "logp", "back")]
    tables = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        level, gram, logp, back = (c[codes == i] for c in columns)
        tables[lang] = Lookup(level, gram.view(_U), logp, back)
    return tables


def text_grams(docs: DataFrame) -> DataFrame:
    """(lang, t1, t2, gram, n) of each row of docs (lang, t1, t2, text): its longest grams."""

    def count(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in _blocks(texts):
                grams, ends = packed(texts[a:b])
                row = np.repeat(np.arange(a, b), np.diff(ends, prepend=0))
                order = np.lexsort((grams, row))
                row, grams = row[order], grams[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), bool), (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])]))
                n = np.diff(first, append=len(row))
                for i in range(0, len(first), 1 << 16):
                    at = first[i : i + (1 << 16)]
                    own = [batch.column(c).take(pa.array(row[at])) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(grams[at].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["lang", "t1", "t2", "gram", "n"])

    return docs.select("lang", "t1", "t2", "text").mapInArrow(count, "lang string, t1 long, t2 long, gram long, n long")


def gram_scores(spark: SparkSession, grams: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct (lang, gram) with logp, as log_probabilities() has it, by joins; without those of a language that has no model."""
    suffix = lambda n: F.col("gram").bitwiseAND(F.lit((1 << (16 * n)) - 1)) if n < ORDER else F.col("gram")
    rows = joined(grams, materialize(spark, model.where("level = 0").select("lang", (F.col("logp") + F.col("back").cast("float")).alias("logp")), "level0"), "lang")
    for level in range(1, ORDER + 1):
        own = model.where(F.col("level") == level).select("lang", F.col("gram").alias("key"), F.col("logp").cast("float").alias("own"), F.col("back").cast("float").alias("next"))
        own = materialize(spark, own, f"level{level}")
        rows = joined(rows.withColumn("key", suffix(level)), own.drop("next"), "lang", "key", how="left")
        rows = rows.withColumn("logp", F.coalesce("own", "logp")).drop("own", "key")
        if level < ORDER:  # the weight of the context of the next longer gram
            rows = joined(rows.withColumn("key", F.shiftrightunsigned(suffix(level + 1), 16)), own.drop("own"), "lang", "key", how="left")
            rows = rows.withColumn("logp", F.col("logp") + F.coalesce("next", F.lit(0.0))).drop("next", "key")
    return materialize(spark, rows.select("lang", "gram", "logp"), "gram-scores")


def joined_scores(spark: SparkSession, docs: DataFrame, model: DataFrame) -> DataFrame:
    """scores() by a model of any size. Rows of equal text and language are summed up together and share their total."""
    grams = materialize(spark, text_grams(docs), "text-grams")
    known = gram_scores(spark, materialize(spark, grams.select("lang", "gram").distinct(), "text-gram-keys"), model)
    text = ["lang", "t1", "t2"]
    found = materialize(spark, sums(spark, docs, {}).drop("total"), "sizes")
    totals = joined(grams, known, "lang", "gram").groupBy(*text).agg(F.sum(F.col("n") * F.col("logp").cast("double")).alias("all"))
    totals = totals.join(found.groupBy(*text).agg(F.count("*").alias("rows")), text).select(*text, (F.col("all") / F.col("rows")).alias("total"))
    return joined(found, materialize(spark, totals, "totals"), *text, how="left").select("doc_id", *text, "n_units", "total")


def scores(spark: SparkSession, docs: DataFrame, model: DataFrame, most: int = MODEL_ROWS) -> DataFrame:
    """docs (doc_id, lang, t1, t2, text) to (doc_id, lang, t1, t2, n_units, total): the sum of log-probabilities, null without a model of the language.

    model must be stored; with more than most grams it is joined, not broadcast.
    """
    return joined_scores(spark, docs, model) if model.count() > most else sums(spark, docs, lookups(model))


def sums(spark: SparkSession, docs: DataFrame, tables: dict[str, Lookup]) -> DataFrame:
    """scores() by tables that each task holds."""
    held = spark.sparkContext.broadcast(tables)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        tables = held.value
        for batch in batches:
            size, total = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            for lang, at, mine in _by_language(batch, 1, 4):
                for a, b in _blocks(mine):
                    grams, ends = packed(mine[a:b])
                    place = np.array(at[a:b])
                    size[place] = np.diff(ends, prepend=0)
                    if lang in tables:
                        sums = np.concatenate([[0.0], np.cumsum(log_probabilities(grams, tables[lang]))])
                        total[place] = np.diff(sums[ends], prepend=0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(size), pa.array(total, from_pandas=True)], names=["doc_id", "lang", "t1", "t2", "n_units", "total"])

    return docs.select("doc_id", "lang", "t1", "t2", "text").mapInArrow(score, f"doc_id {kind}, lang string, t1 long, t2 long, n_units long, total double")


def fold_counts(spark: SparkSession, trusted: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) of trusted texts (fold, lang, text) by "k:lang" without fold k, and by ALL of all folds."""
    each = gram_counts(trusted.select(F.concat_ws(":", F.col("fold").cast("string"), "lang").alias("lang"), "text"))
    own = F.substring("lang", 1, 1)
    models = F.filter(F.array(*[F.lit(k) for k in [ALL, *map(str, range(FOLDS))]]), lambda k: k != own)
    rows = each.select(F.explode(models).alias("k"), F.expr("substring(lang, 2)").alias("rest"), "gram", "n")
    return rows.groupBy(F.concat("k", "rest").alias("lang"), "gram").agg(F.sum("n").alias("n"))


def _perplexities(spark: SparkSession, docs: DataFrame, model: DataFrame, k: str) -> DataFrame:
    """scores() by the model of prefix k, with perplexity and length band."""
    docs = docs.withColumn("lang", F.concat_ws(":", F.lit(k), "lang"))
    found = scores(spark, docs, model.where(F.col("lang").startswith(k + ":"))).withColumn("lang", F.expr("substring(lang, 3)"))
    found = found.withColumn("perplexity", F.when(F.col("n_units") > 0, F.exp(-F.col("total") / F.col("n_units"))))
    return found.withColumn("band", sum((F.col("n_units") >= n).cast("int") for n in BANDS))


def language_key(lang) -> F.Column:
    """A language as a key that is never null: a null one is "-", any other has "=" before it."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def _quotas(spark: SparkSession, trusted: DataFrame, units: int) -> DataFrame:
    """(lang, steps): the steps of the hash that are in the sample, of STEPS; together the samples have about so many units."""
    sizes = materialize(spark, trusted.groupBy("lang").agg(F.sum(F.char_length("text")).alias("size")), "sizes")
    share = units / max(1, sizes.count())
    steps = F.least(F.lit(float(STEPS)), F.ceil(F.lit(float(STEPS)) * share / F.greatest("size", F.lit(1)))).cast("long")
    return small(materialize(spark, sizes.select("lang", steps.alias("steps")), "quotas"), BROADCAST_LANGUAGES)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, units: int | None = None) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold, keep for every row of docs, and t1, t2: two hashes of its text.

    With units the model is fitted on a sample of about so many, otherwise on all trusted texts.
    """
    labels = project(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    trusted = materialize(spark, labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).where("good = 1").select("doc_id"), "trusted")
    ids = small(trusted, BROADCAST_IDS)
    docs = project(docs, doc_id="doc_id", lang="lang", text="text")
    t1, t2 = text_key("text")
    docs = docs.select("doc_id", language_key(F.col("lang")).alias("lang"), t1.alias("t1"), t2.alias("t2"), F.coalesce("text", F.lit("")).alias("text"))
    mine = docs.join(ids, "doc_id", "left_semi").withColumn("fold", F.pmod("t2", F.lit(FOLDS)).cast("int"))
    if units is not None:
        quotas = _quotas(spark, docs.join(ids, "doc_id", "left_semi"), units)
        in_sample = F.pmod("t1", F.lit(STEPS)) < F.col("steps")
        mine = mine.join(quotas, "lang").where(in_sample).drop("steps")
    mine = materialize(spark, mine, "trusted-texts")
    model = materialize(spark, model_table(spark, materialize(spark, fold_counts(spark, mine), "grams")), "model")
    found = materialize(spark, _perplexities(spark, docs, model, ALL), "scores")
    judged = found.limit(0)
    if units is not None:
        judged = found.join(ids, "doc_id", "left_semi").join(quotas, "lang").where(~in_sample).drop("steps")
    for k in range(FOLDS):
        part = _perplexities(spark, mine.where(F.col("fold") == k), model, str(k))
        judged = judged.unionByName(materialize(spark, part, "held-out"))
    forget(spark, mine)
    judged = judged.where("perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 100_000) * slack
    by_lang = judged.groupBy("lang").agg(limit.alias("whole"))
    by_band = judged.groupBy("lang", "band").agg(limit.alias("own"), F.count("*").alias("n"))
    by_band, by_lang = (small(materialize(spark, x, "limits"), BROADCAST_LANGUAGES) for x in (by_band, by_lang))
    out = found.join(by_band, ["lang", "band"], "left").join(by_lang, "lang", "left")
    enough = round(1 / (1 - quantile)) if quantile < 1 else 1
    out = out.withColumn("threshold", F.when(F.col("n") >= enough, F.col("own")).otherwise(F.greatest("own", "whole")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    lang = F.when(F.col("lang") != "-", F.expr("substring(lang, 2)"))
    return out.select("doc_id", lang.alias("lang"), "n_units", "perplexity", "threshold", keep.alias("keep"), "t1", "t2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("t1", "t2").withColumnRenamed("keep", "kept")
