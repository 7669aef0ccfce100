"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A word's symbols stand in a doubly linked list. A heap holds the ranks of adjacent pairs; the lowest
rank, leftmost first, is popped again and again and, if both its symbols still stand as they did,
merged. The count is the initial symbols minus the merges. Runs between blanks recur, so a worker keeps
a bounded memory of counts by run. For scripts beyond Latin the split into words is the library's
own, since tables of letters differ between Unicode versions; the merging is always ours.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; null doc_id is
passed on; an empty table gives an empty result; extra columns are ignored; a text without any
white space costs n log n in its length. Ties between equal ranks go to the leftmost pair.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import project, table

VOCABULARY = "word_bpe_49k.json"
OVER = 2048
#: runs whose counts a worker remembers, and the longest of them
REMEMBERED, LONGEST = 400_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte, as byte-level vocabularies write them.

    Bytes that are printable Latin-1 stand for themselves, the rest take letters from U+0100 on in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts for a vocabulary file of word-end byte-pair merges."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.rank = {}
        for i, p in enumerate(pairs):
            self.rank.setdefault(p, i)
        self.end = model.get("end_of_word_suffix") or ""
        self.letter = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.beyond = regex.compile(r"[^\x00-\u024F\u2000-\u206F\u20A0-\u20BF]|[\u0130]")
        self.library = Tokenizer.from_file(path)
        self.known, self.words = Known(self.run_count), Known(self.word_count)

    def merged(self, symbols: list[str]) -> int:
        """Symbols left after all merges."""
        n = len(symbols)
        ranked = self.rank.get
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranked(p)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:  # one of them was merged meanwhile
                continue
            symbols[i] = whole = pair[0] + pair[1]
            symbols[j] = ""
            merges += 1
            right[i] = k = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                if (r := ranked(p := (whole, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := left[i]) >= 0 and (r := ranked(p := (symbols[h], whole))) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges

    def letters_count(self, letters: list[str]) -> int:
        if not letters:
            return 0
        letters[-1] += self.end
        return self.merged(letters)

    def run_count(self, run: str) -> int:
        """Tokens of a run without blanks."""
        if self.beyond.search(run):  # rarer scripts: the library's own tables of letters and cases
            low = self.library.normalizer.normalize_str(run)
            return sum(self.letters_count(list(w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(low))
        low = unicodedata.normalize("NFC", run).lower()
        return sum(map(self.words.__getitem__, self.word.findall(low)))

    def word_count(self, word: str) -> int:
        return self.letters_count([*map(self.letter.__getitem__, word.encode())])

    def count(self, text: str) -> int:
        """Tokens of a whole text. No token and no character composition crosses a blank or a special string."""
        if self.split_special is not None and "<|" in text:
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts)) if len(parts) > 1 else self.blank_count(text)
        return self.blank_count(text)

    def blank_count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


class Known(dict):
    """Counts by run; forgets all when it is full, and never keeps long runs."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, run: str) -> int:
        n = self.of(run)
        if len(run) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > over) of every row; narrow, without a shuffle."""
    path = path or vocabulary_path()
    rows = project(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counts(batches):
        tool = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([tool.count(t.as_py()) for t in texts], pa.int64())
            size = pa.compute.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    out = rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(over))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
