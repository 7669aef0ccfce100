"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. From it a Boolean query over lower-case trigrams is derived: every
text that the expression matches holds, for at least one clause of the query, all trigrams of the
clause. Postings (trigram, text key) are made for the trigrams that some query names, intersected by
clause, and only the candidates are verified by the expression. A rule without a mandatory trigram is
run on every text. The text key is a hash of the text, so copies share their postings; a collision can
only add a candidate.

Cases: null text counts as empty; an empty text has no spans; repeated rows each give a row; null
doc_id is passed on; an empty table gives an empty result; extra columns are ignored. Matches of one
rule don't overlap, those of different rules may; ties in the order of spans go by rule order, then end.
"""

from __future__ import annotations

from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm.common import project, salted, table

#: kind, expression, group whose length counts, least length. The first three are the base kinds.
#: [0-9a-f]{16,} finds the runs of [0-9a-f]+ that have 16 characters or more.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
)
BASE = 3
MOST_STRINGS = 24
SALTS = 16
PLACE = "[SECRET]"


# --- Boolean trigram queries -------------------------------------------------------------------
# A query is a set of clauses, a clause a frozenset of trigrams that must all be there. {frozenset()}
# holds for any text.

ANY = {frozenset()}


def _both(a: set, b: set) -> set:
    return _least({x | y for x in a for y in b})


def _least(clauses: set) -> set:
    """Without clauses that a weaker clause covers."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _of_strings(strings: set) -> set:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _exact(op, arg) -> set | None:
    """All lower-case strings that a node matches, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        found = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_STRINGS else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[3])
    if op is C.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] <= 8:
        one = _exact_all(arg[2])
        if one is None:
            return None
        found, power = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                found |= power
            power = {a + b for a in power for b in one}
            if len(found) > MOST_STRINGS or len(power) > MOST_STRINGS:
                return None
        return found
    return None


def _exact_all(nodes) -> set | None:
    strings = {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is None:
            return None
        strings = {a + b for a in strings for b in one}
        if len(strings) > MOST_STRINGS:
            return None
    return strings


def _query(nodes) -> set:
    query, run = ANY, {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is not None and len(more := {a + b for a in run for b in one}) <= MOST_STRINGS:
            run = more
            continue
        query = _both(query, _of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            if op is C.SUBPATTERN:
                query = _both(query, _query(arg[3]))
            elif op is C.BRANCH:
                query = _both(query, _least(set().union(*map(_query, arg[1]))))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                query = _both(query, _query(arg[2]))
    return _both(query, _of_strings(run))


def trigram_query(expression: str) -> set[frozenset[str]]:
    """Clauses of trigrams of which one must hold, in the lower-cased text, for the expression to match."""
    return _query(_parser.parse(expression))


# --- index and candidates ----------------------------------------------------------------------


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): texts whose postings satisfy a rule's query, rules as a bit set. texts: (key, text)."""
    clauses = [(1 << r, n, t, len(c)) for r, rule in enumerate(rules) for n, c in enumerate(sorted(map(sorted, trigram_query(rule[1])))) for t in c]
    spark = texts.sparkSession
    if not clauses:
        return spark.createDataFrame([], "key long, rules long")
    vocabulary = sorted({t for _, _, t, _ in clauses})
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(F.col("low"), t))
    postings = low.select("key", F.explode(held).alias("trigram")).distinct()
    wanted = spark.createDataFrame(clauses, "bit long, clause int, trigram string, n int")  # a row for each trigram of a rule
    whole = postings.join(F.broadcast(wanted), "trigram").groupBy("key", "bit", "clause", "n").count().where("count = n")
    return whole.groupBy("key").agg(F.bit_or("bit").alias("rules"))


_SPANS = "array<struct<start:int,rule:int,end:int>>"


def _found(text: Column, rule: tuple, number: int) -> Column:
    """Spans (start, rule, end) of the rule's matches that are long enough.

    Starts are running sums, taken in chunks of about the square root of the number of matches: first
    in each chunk from 0, then chunk by chunk, so that no array is copied for each match.
    """
    _, expression, group, least = rule
    e = F.lit(expression)
    columns = [F.transform(F.split(text, expression, -1), F.char_length).alias("gap"), F.transform(F.regexp_extract_all(text, e, F.lit(0)), F.char_length).alias("len")]
    if group:
        columns.append(F.transform(F.regexp_extract_all(text, e, F.lit(group)), F.char_length).alias("own"))
    none = F.array().cast(_SPANS)

    def step(state, x):
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), (start + x["len"]).alias("end"))
        spans = F.when(x["own" if group else "len"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + F.coalesce(x["len"], F.lit(0))).alias("at"), spans.alias("spans"))

    def chunks(rows):
        size = _chunk(rows)
        firsts = F.sequence(F.lit(1), F.size(rows), size)
        return F.transform(firsts, lambda first: F.aggregate(F.slice(rows, first, size), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def follow(state, chunk):
        moved = F.transform(chunk["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["rule"].alias("rule"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    def whole(rows):
        return F.aggregate(chunks(rows), F.struct(F.lit(0).alias("at"), none.alias("spans")), follow, lambda s: s["spans"])

    all_spans = F.element_at(F.transform(F.array(F.arrays_zip(*columns)), whole), 1)  # so the matches are found once
    return F.when(text.rlike(expression), all_spans).otherwise(none)


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs as (doc_id, text, spans): array of (start, rule, end) in code points, sorted."""
    return _scanned(project(docs, doc_id=id_col, text=text_col), rules)


def _scanned(rows: DataFrame, rules) -> DataFrame:
    """rows with text (null: empty) and spans added; every other column of rows is kept."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    indexed = [bool(trigram_query(r[1]) - ANY) and ANY & trigram_query(r[1]) == set() for r in rules]
    hits = candidates(rows.select("key", "text"), rules)
    rows, hits = salted(rows, hits, SALTS, "key")
    rows = rows.join(hits.hint("shuffle_hash"), ["key", "salt"], "left")
    text, bits = F.col("text"), F.coalesce(F.col("rules"), F.lit(0).cast("long"))
    none = F.array().cast(_SPANS)
    spans = [F.when(F.getbit(bits, F.lit(i)) == 1, _found(text, r, i)).otherwise(none) if indexed[i] else _found(text, r, i) for i, r in enumerate(rules)]
    return rows.withColumn("spans", F.array_sort(F.concat(*spans))).drop("key", "rules", "salt")


def _chunk(rows: Column) -> Column:
    """About the square root of an array's size: chunks of so many are joined in little more than linear time."""
    return F.ceil(F.sqrt(F.size(rows))).cast("int")


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones as one, (start, end)."""
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(state, more):
        """more, which is merged itself, after state: what reaches beyond state's last span; of that only the first can overlap it."""
        last, size = F.element_at(state, -1), F.size(state)
        beyond = F.filter(more, lambda s: s["end"] > last["end"])
        first = F.get(beyond, F.lit(0))
        wider = F.concat(F.slice(state, F.lit(1), size - 1), F.array(pair(last["start"], first["end"])), F.slice(beyond, F.lit(2), F.greatest(F.size(beyond), F.lit(1))))
        return F.when(size == 0, more).when((F.size(beyond) > 0) & (first["start"] < last["end"]), wider).otherwise(F.concat(state, beyond))

    firsts = F.sequence(F.lit(1), F.size(spans), _chunk(spans))
    parts = F.transform(firsts, lambda i: F.aggregate(F.slice(spans, i, _chunk(spans)), none, lambda state, s: join(state, F.array(pair(s["start"], s["end"])))))
    return F.aggregate(parts, none, join)


def _replaced(text: Column, merged: Column, place: str) -> Column:
    """The text with each of the merged spans replaced: pieces that end with a span's end are cut out first, and the spans in each piece then."""
    chunk = _chunk(merged)

    def cut(i):
        mine = F.slice(merged, i, chunk)
        begin = F.when(i == 1, F.lit(0)).otherwise(F.element_at(merged, F.greatest(i - 1, F.lit(1)))["end"])
        return F.struct(begin.alias("begin"), mine.alias("spans"), F.substring(text, begin + 1, F.element_at(mine, -1)["end"] - begin).alias("piece"))

    def between(x):
        def part(s, i):
            begin = F.when(i == 0, F.lit(0)).otherwise(F.element_at(x["spans"], F.greatest(i, F.lit(1)))["end"] - x["begin"])
            return F.substring(x["piece"], begin + 1, s["start"] - x["begin"] - begin)

        return F.array_join(F.concat(F.transform(x["spans"], part), F.array(F.lit(""))), place)

    pieces = F.transform(F.transform(F.sequence(F.lit(1), F.size(merged), chunk), cut), between)
    end = F.element_at(merged, -1)["end"]
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.char_length(text) - end))


def redact(docs: DataFrame, rules=RULES, text_col: str = "text", place: str = PLACE) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced in the text; the columns stay as they are.

    A null text stays null.
    """
    names = docs.columns
    at = names.index(text_col)
    inner = [f"c{i}" if i != at else "text" for i in range(len(names))]
    rows = docs.toDF(*inner).withColumn("was_null", F.col("text").isNull())
    rows = _scanned(rows, rules)

    rows = rows.withColumn("merged", F.when(F.size("spans") > 0, _merged(F.col("spans"))))
    clean = F.when(F.col("merged").isNotNull(), _replaced(F.col("text"), F.col("merged"), place)).otherwise(F.col("text"))
    out = rows.withColumn("text", F.when(~F.col("was_null"), clean))
    return out.select(*inner).toDF(*names)


def _digest(spans: Column, rules) -> Column:
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"], s["end"])), ",")


def _of_rule(i: int):
    return lambda s: s["rule"] == i


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _of_rule(i))).cast("long").alias(f"n_{RULES[i][0]}") for i in range(BASE)]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_digest(F.filter(spans, lambda s: s["rule"] < BASE), RULES), 256).alias("base_sha256"),
        _digest(spans, RULES).alias("spans"),
    )


def oracle_sql(rules=RULES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    finds = []
    for i, (_, e, group, least) in enumerate(rules):
        finds.append(f"""select doc_id, row, {i} as rule,
            unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'len': length(m[i]), 'own': length(g[i])}})) as s, {least} as least
            from (select doc_id, row, regexp_extract_all(text, {quoted(e)}) as m, regexp_extract_all(text, {quoted(e)}, {group}) as g, string_split_regex(text, {quoted(e)}) as gaps from t)""")
    kinds = "[" + ", ".join(quoted(r[0]) for r in rules) + "]"
    return f"""with t as (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
        f as ({' union all '.join(finds)}),
        x as (select row, rule, cast(s['start'] as bigint) as a, cast(s['start'] + s['len'] as bigint) as b from f where s['own'] >= least),
        y as (select row, count(*) filter (rule = 0) as n_assign, count(*) filter (rule = 1) as n_access, count(*) filter (rule = 2) as n_hex,
            coalesce(string_agg({kinds}[rule + 1] || ':' || a || ':' || b, ',' order by a, rule, b) filter (rule < {BASE}), '') as base,
            string_agg({kinds}[rule + 1] || ':' || a || ':' || b, ',' order by a, rule, b) as spans from x group by row)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
            sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join y using (row)"""
