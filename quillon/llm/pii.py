"""Personal data: generators propose overlapping spans, boosted trees score them, thresholds select.

Base kinds are exact patterns, always selected. Generators of high recall propose more: written-out
mail addresses, telephone numbers without a plus, numbers in the form of national insurance, bank
account, birth date or network address. Boosted trees see the format of a candidate and the words
around it. The training rows are all candidates in TRAIN_ROWS sentences made from templates with a fixed
seed, so the model is the same everywhere and needs no corpus: a candidate is right if it has the kind and
the span of what the sentence was made to hold, so kinds that propose the same span compete by score. The
templates overlap on purpose: some personal data come without a word that tells, or after a misleading one,
and some other numbers look the same or follow a word that tells. Scores are calibrated on held-out
sentences for each kind, and each kind has the least threshold, of one half or more, at which the precision of
what is selected among further held-out sentences reaches PRECISION.

Cases: null and empty texts have no spans; repeated rows each give a row; a null doc_id is passed on;
an empty table gives an empty result; extra columns are ignored; every pattern takes time linear in
the text. Of overlapping candidates the higher probability wins, ties the higher score, then the earlier, then
the longer; one that overlaps a base span is dropped.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.boosting import BoostedTrees, Isotonic
from quillon.llm.common import project, table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_words", "phone_plain", "national_id", "iban", "birth_date", "ipv6")
KINDS = BASE + EXTRA
TRAIN_ROWS, PRECISION = 20_000, 0.92
PLACE = "[PII]"

# --- base kinds ----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive repeats and the look-behind give the same matches as the plain patterns, without retries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str):
    """Spans of local@domain, by their @; the local part begins where its run or the span before it ends."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (done := found.end())
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


# --- generators ----------------------------------------------------------------------------------

_DIGIT = re.compile("[0-9]")
_AT_WORD = re.compile(r"[(\[{ ]\s?(?:at|AT|At)\s?[)\]} ]")
_GENERATORS = (
    (4, re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,40}+ ?[(\[{ ]\s?(?:at|AT|At)\s?[)\]} ] ?[A-Za-z0-9-]{2,40}+(?:(?: ?[(\[{ ]\s?(?:dot|DOT|Dot)\s?[)\]} ] ?|\.)[A-Za-z]{2,12}+){1,3}+")),
    (5, re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}+\)?(?:[ ./-]{1,2}+\(?[0-9]{2,5}+\)?){1,4}+(?![\w-])")),
    (6, re.compile(r"(?<![\w.+-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    (7, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}+(?!\w)")),
    (8, re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![\w/-])")),
    (9, re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![\w:])")),
)

#: Words near personal data of each kind, and near numbers that are none.
CUES = (
    ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel"),
    ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "teléfono", "téléphone"),
    ("ssn", "social", "security", "insurance", "national", "identity", "passport"),
    ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    ("born", "birth", "dob", "birthday", "geboren", "née", "né", "nacido", "nacida"),
    ("ip", "address", "host", "server", "client", "login"),
    ("version", "release", "v", "isbn", "order", "invoice", "ref", "reference", "page", "pages", "chapter", "section", "sku", "part", "serial", "model", "build", "published", "updated", "score", "article", "figure", "total", "price"),
)
#: common ends of mail addresses
ENDS = frozenset("com org net edu gov io de fr es uk it nl eu info".split())
_CUE_OF = {w: i for i, group in enumerate(CUES) for w in group}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    found = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _GENERATORS:
        if digits if kind != 4 else _AT_WORD.search(text):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    digits = sum(groups)
    left, right = text[max(0, start - 48) : start].lower(), text[end : end + 24].lower()
    before = _WORD.findall(left)[-5:]
    near = [9.0] * len(CUES)
    for i, w in enumerate(reversed(before)):
        if (c := _CUE_OF.get(w)) is not None:
            near[c] = min(near[c], float(i))
    for i, w in enumerate(_WORD.findall(right)[:2]):
        if (c := _CUE_OF.get(w)) is not None:
            near[c] = min(near[c], i + 4.0)
    seps = {c for c in s if not c.isalnum()}
    return [
        float(kind),
        float(end - start),
        float(digits),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(len(seps)),
        float("(" in s or "[" in s or "{" in s),
        float("dot" in s.lower() or kind != 4 and "." in s),
        float(kind == 4 and re.split("[^a-z]+", s.lower())[-1] in ENDS),
        float(kind == 7 and _iban_ok(s)),
        float(kind == 9 and s.count(":") == 7),
        float(kind == 8 and any(1900 <= int(g) <= 2015 for g in re.findall("[0-9]{4}", s))),
        float(left.rstrip()[-1:] in (":", "=")),
        float(left[-1:] in ("$", "€", "#", "£")),
        float(right[:1] in ("%", "$", "€")),
        *near,
    ]


# --- model ---------------------------------------------------------------------------------------


def _sentences(n: int, seed: int = 20) -> list[tuple[str, int, int, int]]:
    """(text, kind, start, end) of sentences made from templates; kind is -1 where the sentence holds no personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = r.choice
    filler = "the and of to in is on for with we were are this that from was by it not all der die und el la de le les des une que para con en".split()
    some = lambda a, b: " ".join(pick(filler) for _ in range(r.randint(a, b)))
    name = lambda: pick(("anna", "j.doe", "info", "max_m", "lee", "sales", "o.nunez", "kim88"))
    link = lambda: pick(("", "", ":", ":", " is", " =", " no.", " number", " " + some(1, 3), " " + some(1, 3)))
    sep = lambda: pick((" ", "-", ".", "/"))

    def iban(country: str, right: bool) -> str:
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        flat = f"{country}{check if right else (check + r.randint(1, 96)) % 97:02d}{body}"
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if r.random() < 0.5 else flat

    def date(first: int, last: int) -> str:
        y, m, day = r.randint(first, last), r.randint(1, 12), r.randint(1, 28)
        return pick((f"{day}.{m}.{y}", f"{y}-{m:02d}-{day:02d}", f"{m}/{day}/{y}", f"{day:02d}-{m:02d}-{y}"))

    def personal(kind: int) -> str:
        if kind == 4:
            a, b = pick((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), ("(at)", ".")))
            gap = pick(("", " ")) if a[0] != " " else ""
            return f"{name()}{gap}{a}{pick(('mail', 'example', 'post', 'firm'))}{b}{pick(('com', 'org', 'de', 'net'))}"
        if kind == 5:
            s = sep()
            return pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(3)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"))
        if kind == 6:
            return f"{d(3)}{pick('-- ')}{d(2)}-{d(4)}"
        if kind == 7:
            return iban(pick(("DE", "FR", "GB", "ES")), True)
        return date(1925, 2012) if kind == 8 else ":".join(f"{r.getrandbits(16):x}" for _ in range(8))

    def other(kind: int) -> str:
        if kind in (4, 7, 9) and r.random() < 0.06:  # what looks the same: a shop's address, an example account, a key's print
            return personal(kind)
        if kind == 4:
            return f"{pick(('look', 'arrive', 'stay', 'meet'))} at {pick(('noon', 'home', 'the', 'work'))}{pick(('. The', '. Then', ' dot matrix', '. And'))}"
        if kind == 5:
            s = sep()
            return pick((f"{d(2)}{s}{d(2)}{s}{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(5)}", f"19{d(2)}-20{d(2)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}"))
        if kind == 6:
            return f"{d(3)}-{d(2)}-{d(4)}"
        if kind == 7:
            return pick((iban(pick(("DE", "FR")), False), f"{pick(('AB', 'XK', 'PN', 'SN'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{pick(('RT', 'GT'))}{d(2)}{d(14)}"))
        return date(1950, 2030) if kind == 8 else pick((":".join(d(2) for _ in range(r.randint(4, 6))), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"))

    def cue(kind: int, right: bool) -> str:
        """A word that tells, mostly; sometimes none or a misleading one."""
        chance = r.random()
        if right:
            told = 0.97 if kind == 8 else 0.86  # a date alone is no birth date
            return pick(CUES[kind - 4]) + link() if chance < told else some(1, 2) if chance < told + 0.1 else pick(CUES[6]) + link()
        if chance < 0.04:
            return pick(CUES[kind - 4]) + link()
        return pick((pick(CUES[6]) + link(), pick(CUES[6]) + link(), pick(filler), some(1, 3), pick(CUES[pick([i for i in range(6) if i != kind - 4])]) + " " + some(1, 3), "$", "#"))

    rows = []
    for _ in range(n):
        kind, right = r.randint(4, 9), r.random() < 0.5
        told, s = cue(kind, right), (personal if right else other)(kind)
        if r.random() < 0.1:
            told = told.upper() if r.random() < 0.5 else told.title()
        before = f"{some(2, 6)} {told}" + ("" if told in ("$", "#") else " ")
        text = f"{before}{s}{pick((' ', ' ', ', ', '; ', ') '))}{some(2, 5)}."
        rows.append((text, kind if right else -1, len(before), len(before) + len(s)))
    return rows


def _training_rows(n: int, seed: int = 20) -> list[tuple[str, int, int, int, int, int]]:
    """(text, kind, start, end, label, sentence) of all candidates in n sentences."""
    made = enumerate(_sentences(n, seed))
    return [(t, *c, int(c == truth), i) for i, (t, *truth) in made for truth in [tuple(truth)] for c in candidates(t)]


class Model:
    """Trees, and for each kind a calibration and a threshold."""

    def __init__(self, rows: int = TRAIN_ROWS):
        found = _training_rows(rows)
        x = np.array([features(t, k, a, b) for t, k, a, b, _, _ in found])
        y = np.array([label for *_, label, _ in found], float)
        part = np.array([0, 0, 1, 2])[np.array([i for *_, i in found]) % 4]  # sentences to fit, to calibrate, to set thresholds
        self.trees = BoostedTrees(trees=80, depth=4).fit(x[part == 0], y[part == 0])
        raw, kind = self.trees.raw(x), x[:, 0].astype(int)
        self.calibration = {k: Isotonic().fit(raw[(part == 1) & (kind == k)], y[(part == 1) & (kind == k)]) for k in range(len(BASE), len(KINDS))}
        p = self._probability(raw, kind)
        held = [found[i] for i in np.flatnonzero(part == 2)]
        kept = self._best([(row[5], *row[1:4]) for row in held], raw[part == 2], p[part == 2])
        self.thresholds = {}
        for k in self.calibration:
            mine = np.array([i for i in kept if held[i][1] == k], np.int64)
            p_k, y_k = p[part == 2][mine], y[part == 2][mine]
            self.thresholds[k] = float(min((t for t in np.unique(p_k) if t >= 0.5 and y_k[p_k >= t].mean() >= PRECISION), default=1.1))

    def _probability(self, raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
        p = np.zeros(len(raw))
        for k, steps in self.calibration.items():
            p[kind == k] = steps.predict(raw[kind == k])
        return p

    @staticmethod
    def _best(places: list[tuple], raw: np.ndarray, p: np.ndarray) -> list[int]:
        """Those of the candidates (text, kind, start, end) that no better one overlaps, the best first."""
        taken: dict = {}
        kept = []
        for i in sorted(range(len(places)), key=lambda i: (-p[i], -raw[i], places[i][2], -places[i][3], places[i][1])):
            text, _, a, b = places[i]
            own = taken.setdefault(text, [])
            if _free(own, a, b):
                insort(own, (a, b))
                kept.append(i)
        return kept

    def select(self, text: str, proposed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The candidates that reach their kind's threshold and overlap no better one that does, the best first."""
        raw = self.trees.raw(np.array([features(text, *c) for c in proposed]))
        p = self._probability(raw, np.array([k for k, _, _ in proposed]))
        good = [i for i, (k, _, _) in enumerate(proposed) if p[i] >= self.thresholds[k]]
        return [proposed[good[i]] for i in self._best([(0, *proposed[i]) for i in good], raw[good], p[good])]


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b overlaps none of the ordered spans, which don't overlap one another."""
    i = bisect_left(taken, (a, a))
    return not ((i < len(taken) and taken[i][0] < b) or (i and taken[i - 1][1] > a))


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def spans(text: str, tools: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and selected further spans, each (kind, start, end) by kind, then start."""
    if "@" not in text and not _DIGIT.search(text) and not _AT_WORD.search(text):
        return [], []
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, []
    taken: list[tuple[int, int]] = []  # what base spans cover; those of two kinds may overlap
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    proposed = [c for c in proposed if _free(taken, *c[1:])]
    return base, sorted(tools.select(text, proposed)) if proposed else []


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) in code points, kind as a place in KINDS."""
    rows = project(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tools = model()
    kind = rows.schema["doc_id"].dataType.simpleString()
    entry = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def scan(batches):
        for batch in batches:
            base, added = [], []
            for text in batch.column(1):
                b, a = spans(text.as_py(), tools)
                base.append(named(b))
                added.append(named(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, entry), pa.array(added, entry)], names=["doc_id", "base", "added"])

    struct = "array<struct<kind:int,start:int,end:int>>"
    return rows.mapInArrow(scan, f"doc_id {kind}, base {struct}, added {struct}")


def redacted(text: str | None, tools, place: str = PLACE) -> str | None:
    """The text with every span, overlapping ones as one, replaced."""
    if text is None:
        return None
    out, done = [], 0
    for a, b in sorted((a, b) for part in spans(text, tools) for _, a, b in part):
        if a >= done:
            out += [text[done:a], place]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _digest(column) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.concat("base", "added")).alias("spans"))
