"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily against
it: each phrase is the longest match with any part of the labelled text. Phrases times the
logarithm of the labelled length, over the text's length, estimates the cross entropy (Ziv and
Merhav); the language with the least wins.

Whole texts are parsed. For speed a text's letters are laid out in segments of ``SEGMENT``
characters (a phrase never crosses the end of one; the same rule holds for all languages), and all
segments of a batch step through the automata together as arrays.

The model is fitted on a bounded sample, whatever repeats: at most ``train_docs`` documents per language
(and ``SAMPLE_ROWS`` in all, but two a language), at most
``train_chars`` characters each of the automata, less if all tables would pass ``table_bytes`` (but
at least ``LEAST_CHARS``), and at most the ``languages`` commonest languages. The ``letters``
commonest letters have a code of their own; where the sample has more, as with several scripts, every other
letter has one of ``HASHED`` codes by its code point, so that no script becomes a single symbol.
Only text and language of documents whose crc32(doc_id as text) mod 5 is not 0 are used.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing
to learn from; equal entropies go to the language with more labelled documents, then by name; texts
are read whole, however long; repeated rows each get their row; an empty table gives an empty result. A null
identifier counts as the empty text in the crc32. Columns other than the named ones are not read by
``identify`` and may have any name; ``with_language`` numbers them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256
CHUNK = 1 << 19
PIECE = 4000
PAD, SPACE, OTHER = 0, 1, 2
UND = "und"
#: Codes that letters without a code of their own share, and the least text of a language.
HASHED = 64
LEAST_CHARS = 200
#: Most pieces of labelled text in the sample, of up to ``PIECE`` letters (but at least two a language).
SAMPLE_ROWS = 8192


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5 == 0


class SuffixAutomaton:
    """The smallest automaton that reads every substring of a sequence of codes."""

    def __init__(self, codes: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(self.next[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur


@dataclass(frozen=True)
class LanguageModel:
    """Labelled text by language (in order of preference), the letters that have codes of their own, and
    how many codes the others share."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]
    letters: str
    shared: int = 1


class _Parser:
    """Automata of a model as one transition table."""

    def __init__(self, model: LanguageModel) -> None:
        self.size = OTHER + model.shared + len(model.letters)
        own = {c: OTHER + model.shared + i for i, c in enumerate(model.letters)}
        points = np.arange(0x110000)
        alphabetic = np.array([chr(i).isalpha() for i in range(0x110000)])
        # both cases of a letter share a code
        low = points.copy()
        for i in np.flatnonzero(alphabetic):
            low[i] = ord(chr(i).lower()[0])
        shared = OTHER + (low * 0x9E3779B1 % (1 << 32)) * model.shared // (1 << 32)
        self.codes = np.where(alphabetic, shared, SPACE).astype(np.uint8)
        for c, code in own.items():
            self.codes[(low == ord(c)) & alphabetic] = code
        self.roots, at = [], 0
        # an automaton has fewer than twice as many states as characters
        full = np.empty((sum(max(1, 2 * len(t)) for t in model.texts), self.size), np.int32)
        self.norm = np.array([math.log2(max(2, len(t))) for t in model.texts])
        for text in model.texts:
            automaton = SuffixAutomaton(self.encode(text)[0].tolist())
            n = len(automaton.next)
            root = automaton.next[0]
            fresh = np.array([~((at + root.get(c, 0)) * self.size) for c in range(self.size)], np.int32)
            table = full[at : at + n]
            table[:] = fresh
            for s in range(1, n):
                for c, to in automaton.next[s].items():
                    table[s, c] = (at + to) * self.size
            table[:, PAD] = at * self.size
            self.roots.append(at * self.size)
            at += n
        # pages of the rest are never touched, so they take no memory
        self.table = full[:at].reshape(-1)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a text with runs of non-letters as one SPACE, and where each kept character stood."""
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kept = np.ones(len(codes), bool)
        kept[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        at = np.flatnonzero(kept)
        return codes[at], at

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (row) in each language (column), and the texts' letters."""
        counts = np.zeros((len(texts), len(self.roots)), np.int64)
        letters = np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            counts[start:end], letters[start:end] = self._phrases(texts[start:end])
            start = end
        return counts, letters

    def _phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = self.encode("".join(texts))
        ends = np.searchsorted(at, np.cumsum([len(t) for t in texts]))
        sizes = np.diff(ends, prepend=0)
        is_letter = np.r_[0, np.cumsum(codes != SPACE)]
        letters = is_letter[ends] - is_letter[ends - sizes]
        counts = np.zeros((len(texts), len(self.roots)), np.int64)
        segments = -(-sizes // SEGMENT)
        total = int(segments.sum())
        if not total:
            return counts, letters
        owner = np.repeat(np.arange(len(texts)), segments)
        nth = np.arange(total) - np.repeat(np.cumsum(segments) - segments, segments)
        from_ = (ends - sizes)[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, ends[owner] - from_)
        order = np.argsort(-length, kind="stable")
        from_, length, owner = from_[order], length[order], owner[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], total, axis=1)
        found = np.zeros((len(self.roots), total), np.int32)
        live = total
        for step in range(int(length[0])):
            while live and length[live - 1] <= step:
                live = int(np.searchsorted(-length[:live], -step, side="left"))
            now = state[:, :live] + codes[from_[:live] + step]
            value = self.table.take(now)
            miss = value >> 31
            found[:, :live] -= miss
            state[:, :live] = value ^ miss
        np.add.at(counts, owner, found.T)
        return counts, letters

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The index of the language of each text, -1 for none, and its score."""
        counts, letters = self.phrases([t or "" for t in texts])
        bits = counts * self.norm[None, :]
        best = bits.argmin(axis=1)
        rate = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(letters, 1)[:, None]
        odds = np.exp2(-np.minimum(rate * np.minimum(letters, 50)[:, None], 1000))
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, 1 / odds.sum(axis=1))


_parsers: dict[LanguageModel, _Parser] = {}


def parser(model: LanguageModel) -> _Parser:
    """The tables of a model; built once in each Python process."""
    if model not in _parsers:
        _parsers.clear()
        _parsers[model] = _Parser(model)
    return _parsers[model]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 64, train_chars: int = 30_000, table_bytes: int = 64 << 20, letters: int = 60, languages: int = 1000) -> LanguageModel:
    """Labelled text of each language from a bounded sample of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # repeated rows have one place
    placed = rows.withColumn("place", F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("language")), F.lit(1 << 30)))
    counts = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("place").alias("places"))
    top = counts.orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    sizes = {r["lang"]: r["n"] for r in top}
    if not sizes:
        return LanguageModel((), (), "")
    each = max(2, min(2 * train_docs, SAMPLE_ROWS // len(sizes)))
    # a row for each of at most ``languages`` languages
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2 * each / r["places"]) * (1 << 30))) for r in top], "lang string, below long"))
    size = F.char_length("text")
    start = F.when(size > PIECE, F.pmod(F.xxhash64("id"), size - PIECE)).otherwise(0).cast("int") + 1
    some = placed.join(shares, "lang").filter("place < below").select("lang", "place", F.substring(F.col("text"), start, F.lit(PIECE)).alias("piece")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "piece"))
    found = some.withColumn("nth", nth).filter(F.col("nth") <= each).collect()
    found.sort(key=lambda r: (r["lang"], r["place"], r["piece"]))
    common = Counter(c for r in found for c in r["piece"].lower() if c.isalpha())
    shared = 1 if len(common) <= letters else HASHED
    kept = "".join(c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:letters])
    chars = max(LEAST_CHARS, min(train_chars, table_bytes // (8 * (OTHER + shared + len(kept)) * len(sizes))))
    names = tuple(sorted({r["lang"] for r in found}, key=lambda x: (-sizes[x], x)))
    texts = tuple(" ".join([r["piece"] for r in found if r["lang"] == lang][:train_docs])[: 2 * chars] for lang in names)
    return LanguageModel(names, tuple(t[:chars] for t in texts), kept, shared)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, as _c0, _c1, ... in their order, with lang_pred and score."""
    plain = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(text_col)
    schema = plain.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.languages:
                best, score = parser(model).predict(batch.column(at).to_pylist())
                names = [UND if i < 0 else model.languages[i] for i in best]
            else:
                names, score = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return plain.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs, id_col, text_col, lang_col, **fitting)
    out = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return out.select(F.col("_c0").alias("doc_id"), held_out(F.col("_c0")).alias("held_out"), "lang_pred", "score")
