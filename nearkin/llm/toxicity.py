"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, learned word, threat, target, negation, reported speech, other; a word
that is repeated right away counts once), a clause is a sequence of symbols with an end mark, and
five transducers, composed into one machine, read it: the lexicon gives insults and learned words
out as hits; negation turns those in its reach into ``x``; reported speech turns those after it into
``q``; a threat word needs a target after it and then gives ``T``; a hit behind a target of its clause is a
directed one. Arcs carry weights, which add up along a path and over the composition, so a clause's
score is the weight of its path; in the lexicon a learned word's arc weighs its own evidence. The
text's score is logistic: the bias and the scores of its matched clauses, of which the k-th
strongest counts 1/k.

The weights are learned (``fit``): each weighted arc has a name, a path takes each a number of times, and
as a text's score is linear in the weights for a given order of its clauses, they come from a
penalised regression that is repeated as the order settles.

Fitting uses at most ``train_rows`` labelled documents whose crc32(doc_id as text) mod 5 is not 0:
two thirds of them find learned words (words that toxic texts use significantly more often), the
other third the weights, so learned words have to prove themselves on texts that did not suggest
them; with these weights, the model takes the words that all of the sample suggests. Without
labels the prior weights stay.

Defined results: null and empty texts score as texts without a match; texts are read whole, however
long; repeated rows each get their row; a null doc_id is kept and scored; labels of unknown
documents and null labels are ignored; of a document labelled more than once the largest label
counts; of an identifier that stands for several texts, the one with the smallest hash is learned from; an empty table gives an empty result. Only the named columns are read, so others may have
any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.language_id import held_out
from nearkin.runtime import cut

#: Fixed words of the grammar.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools jerk imbecile imbeciles "
    "dimwit halfwit cretin vermin filth filthy pig pigs rat scumbag lowlife degenerate freak ugly useless brainless bastard bitch asshole dumbass "
    "idiota imbécile crétin connard salaud abruti idioten dummkopf arschloch abschaum blöd estúpido estúpida imbécil basura asqueroso inútil".split()
)
THREATS = frozenset("kill hurt destroy punch beat stab shoot crush burn strangle murder attack töten schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours yourself u ur he she they them him her his their these those this that people dich du ihr euch tu toi vous tú te usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't didn't nobody nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say called calls quoted quote wrote claims claimed reported sagte sagt dit disait dijo dice".split())

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]+")
NEGATION_REACH = 3
#: The least share of toxic texts among those with a learned word.
LEAST_SHARE = 0.5
#: Names of the weighted arcs, with the weights that hold without labels; the bias is that of a text.
PRIOR = {"bias": -2.2, "insult": 3.0, "learned": 0.7, "negated": -3.5, "reported": -2.0, "threat": 3.5, "directed": 1.0}
ARCS = tuple(k for k in PRIOR if k != "bias")

@dataclass
class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, output, names of its weighted arcs)."""

    arcs: dict[tuple[int, str], tuple[int, str, tuple[str, ...]]] = field(default_factory=dict)

    def run(self, symbols: str) -> tuple[str, list[str]]:
        """What it gives out, and the weighted arcs of the path."""
        state, out, names = 0, [], []
        for s in symbols:
            state, o, n = self.arcs[state, s]
            out.append(o)
            names += n
        return "".join(out), names

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one gives out is read by ``other``; a path takes the arcs of both."""
        out, numbers, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        inputs = sorted({s for _, s in self.arcs})
        while todo:
            a, b = todo.pop()
            for s in inputs:
                if (a, s) not in self.arcs:
                    continue
                a2, o, n = self.arcs[a, s]
                b2, o2, n2 = other.arcs[b, o]
                if (a2, b2) not in numbers:
                    numbers[a2, b2] = len(numbers)
                    todo.append((a2, b2))
                out.arcs[numbers[a, b], s] = (numbers[a2, b2], o2, n + n2)
        return out

    def weighted(self, weights: dict[str, float]) -> dict[tuple[int, str], tuple[int, float]]:
        """(state, symbol) -> (state, weight): the machine as it scores."""
        return {k: (to, sum(weights[n] for n in names)) for k, (to, _, names) in self.arcs.items()}


def _machine(states: int, symbols: str, rule) -> Transducer:
    """``rule`` gives (state, output) or (state, output, name of the weighted arc)."""
    return Transducer({(q, s): (found[0], found[1], tuple(found[2:])) for q in range(states) for s in symbols if (found := rule(q, s))})


def grammar() -> Transducer:
    """Lexicon, negation, reported speech, threats and directed insults, composed. ``$`` ends a clause."""
    lexicon = _machine(1, "iltynro$", lambda q, s: (0, "h", "insult") if s == "i" else (0, "h") if s == "l" else (0, s))
    negation = _machine(NEGATION_REACH + 1, "htynro$", lambda q, s: (
        (0, "$") if s == "$" else (NEGATION_REACH, "n") if s == "n" else (q - 1, "x", "negated") if q and s == "h" else (q - 1, "x") if q and s == "t" else (max(0, q - 1), s)))
    reported = _machine(2, "htynrox$", lambda q, s: (
        (0, "$") if s == "$" else (1, "o") if s == "r" else (1, "q", "reported") if q and s == "h" else (1, "q") if q and s == "t" else (q, s)))
    # state 1: a threat word waits for its target
    threat = _machine(2, "htynoxq$", lambda q, s: (
        (1, "o") if s == "t" else (0, "T", "threat") if q and s == "y" else (0, "$") if s == "$" else (q, s)))
    directed = _machine(2, "hTynoxq$", lambda q, s: (
        (0, "$") if s == "$" else (1, s) if s in "yT" else (q, "H", "directed") if q and s == "h" else (q, s)))
    return lexicon.then(negation).then(reported).then(threat).then(directed)


@dataclass(frozen=True)
class ToxicityModel:
    """Learned words with their evidence, and the weights: the bias, then those of ``ARCS``."""

    words: dict[str, float]
    weights: tuple[float, ...]


class Reader:
    """Finds the clauses of texts that match. ``words``: learned words and what evidence each gives."""

    def __init__(self, words: dict[str, float]) -> None:
        self.words, self.machine = words, grammar()
        self.known: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = (
                "i" if word in INSULTS else "l" if word in self.words else "t" if word in THREATS else "y" if word in TARGETS
                else "n" if word in NEGATIONS or word.endswith(("n't", "n’t")) else "r" if word in REPORTS else "o")
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def clauses(self, text: str | None) -> Iterator[tuple[str, float]]:
        """The symbols of each clause that may match, and the evidence of its learned words."""
        low = (text or "").lower()
        if any(self.symbol(w) in "ilt" for w in set(WORD.findall(low))):
            for clause in CLAUSE_END.split(low):
                words = WORD.findall(clause)
                words = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
                symbols = "".join(map(self.symbol, words))
                if any(s in symbols for s in "ilt"):
                    yield symbols + "$", sum(self.words[w] for w, s in zip(words, symbols, strict=True) if s == "l")

    def arcs(self, text: str | None) -> Counter[tuple[float, ...]]:
        """The clauses of a text by how many of each of ``ARCS`` they take; learned words count by their evidence."""
        found: Counter[tuple[float, ...]] = Counter()
        for symbols, evidence in self.clauses(text):
            names = self.machine.run(symbols)[1]
            if names or evidence:
                found[tuple(round(evidence, 6) if a == "learned" else float(names.count(a)) for a in ARCS)] += 1
        return found


def _ranked(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The factor of each kind of clause: 1/k for the k-th strongest clause, summed over equal ones."""
    order = np.argsort(-scores, kind="stable")
    ends = np.cumsum(counts[order])
    harmonic = np.r_[0.0, np.cumsum(1 / np.arange(1, ends[-1] + 1))]
    out = np.empty(len(scores))
    out[order] = harmonic[ends] - harmonic[ends - counts[order]]
    return out


def text_score(found: list[float], bias: float) -> float:
    """The logistic score of a text from the weights of its matched clauses."""
    total = bias + sum(w / k for k, w in enumerate(sorted(found, reverse=True), 1))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled texts that are not held out: (id, text, toxic, part)."""
    marked = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    share = min(1.0, rows / max(1, marked.count()))
    some = marked.filter(place < int(share * (1 << 30))).limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample's size is bounded by its parameter; of an identifier with several texts one is learned from
    joined = texts.join(F.broadcast(some), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))
    return joined.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3)))


def _learn_words(sample: DataFrame, most: int, support: int, chance: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words whose use in toxic texts is very unlikely by chance, with their evidence (the logarithm of
    how much likelier they are there): by the parts of the sample that do not set weights, and by all
    of it. Equal texts count once."""
    once = sample.groupBy(F.xxhash64("text").alias("same"), "toxic", (F.col("part") > 0).alias("finds")).agg(F.first("text").alias("text"))
    totals = {(r[0], r[1]): r[2] for r in once.groupBy("finds", "toxic").count().collect()}
    words = once.select("toxic", "finds", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))).alias("word"))
    toxic = F.col("toxic") == 1
    stats = words.groupBy("word").agg(F.count_if(F.col("finds") & toxic).alias("bad1"), F.count_if("finds").alias("n1"), F.count_if(toxic).alias("bad2"), F.count(F.lit(1)).alias("n2"))
    out = []
    for k, of in ((1, {c: v for c, v in totals.items() if c[0]}), (2, totals)):
        all_, all_bad = sum(of.values()), sum(v for (_, t), v in of.items() if t == 1)
        if not 0 < all_bad < all_:
            out.append({})
            continue
        base, bad, n = all_bad / all_, F.col(f"bad{k}"), F.col(f"n{k}")
        share = bad / n
        rest = F.when(share < 1, (n - bad) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        gain = bad * F.log(share / base) + rest
        evidence = F.log(((bad + 0.5) / (all_bad + 1)) / ((n - bad + 0.5) / (all_ - all_bad + 1)))
        some = stats.filter((bad >= support) & (bad > 2 * base * n) & (share > LEAST_SHARE)).select("word", gain.alias("gain"), evidence.alias("evidence"))
        rows = some.filter(F.col("gain") > -math.log(chance)).orderBy(F.col("gain").desc(), "word").limit(most).collect()
        out.append({r["word"]: r["evidence"] for r in rows})
    return tuple(out)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps towards the most likely weights, drawn to the prior."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _weights(rows: list[tuple[dict[tuple[float, ...], int], int]], prior: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Weights from (clauses of a text, label); the order of clauses and the weights settle in turns."""
    w = prior.copy()
    kinds = [(np.array(list(found)).reshape(len(found), len(ARCS)), np.array(list(found.values()), np.int64)) for found, _ in rows]
    y = np.array([label for _, label in rows], float)
    for _ in range(rounds):
        x = np.array([np.r_[1.0, _ranked(arcs @ w[1:], counts) @ arcs if len(counts) else np.zeros(len(ARCS))] for arcs, counts in kinds])
        new = _logistic(x, y, prior)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", train_rows: int = 20_000, max_words: int = 2_000, support: int = 4, chance: float = 1e-4) -> ToxicityModel:
    sample = cut(_sample(docs, labels, id_col, text_col, label_id, label_col, train_rows))
    proven, words = _learn_words(sample, max_words, support, chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(proven)
        for batch in batches:
            found = [reader.arcs(t) for t in batch.column(0).to_pylist()]
            rows = [[{"arcs": list(k), "n": n} for k, n in sorted(f.items())] for f in found]
            kind = pa.list_(pa.struct([("arcs", pa.list_(pa.float64())), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), batch.column(1)], names=["clauses", "toxic"])

    # a row per text of a third of the bounded sample
    rows = sample.filter("part = 0").select("text", "toxic").mapInArrow(run, "clauses array<struct<arcs: array<double>, n: long>>, toxic int").collect()
    prior = np.array([PRIOR["bias"], *(PRIOR[a] for a in ARCS)])
    weights = _weights(sorted(((dict((tuple(c["arcs"]), c["n"]) for c in r["clauses"]), r["toxic"]) for r in rows), key=lambda x: (sorted(x[0].items()), x[1])), prior) if rows else prior
    return ToxicityModel(words, tuple(float(v) for v in weights))


class Scorer:
    """A model as it scores texts: the composed machine with the weights summed on its arcs."""

    def __init__(self, model: ToxicityModel) -> None:
        weights = dict(zip(ARCS, model.weights[1:], strict=True))
        self.reader, self.bias, self.unit = Reader(model.words), model.weights[0], weights["learned"]
        self.machine = self.reader.machine.weighted(weights)

    def clause(self, symbols: str, evidence: float) -> float:
        """The weight of the path; a learned word's arc in the lexicon weighs its evidence."""
        state, total = 0, self.unit * evidence
        for s in symbols:
            state, w = self.machine[state, s]
            total += w
        return total

    def score(self, text: str | None) -> float:
        # a clause whose path has no weighted arc is not a match
        found = [w for c in self.reader.clauses(text) if (w := self.clause(*c))]
        return text_score(found, self.bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    schema = docs.select(F.col(id_col).alias("doc_id")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, **fitting: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs, fit(docs, labels, **fitting))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
