"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult (a learned weight), threat, target, negation, report, other. Four transducers read
a clause at once, composed to one: insults and threats emit weights (a threat only once its target follows),
and the others multiply what is emitted - a target nearby raises it, a negation shortly before or
reported speech lowers it. Documents are scored by their matched clauses, not by words alone.

The insult words are learned: stems of words (the first 4 or 6 letters, or the word) whose documents are
far more often labelled toxic, counted over a bounded number of labelled documents outside the held-out fold. A
stem must come from documents with different beginnings, so that copies of one document cannot teach it. A
logistic curve, fitted to the same documents' clause figures, turns figures into a score from 0 to 1.

One scan with an Aho-Corasick automaton finds the clauses that hold an insult or threat; only those are read.

Defined cases: null, empty and blank texts have no clause and get the score of a document without matches;
labels without an id or a verdict are ignored, several labels of an id count as toxic if one is; without
labels, or with labels of one kind only, nothing is learned and every score is 0 or the share of toxic ones;
repeated rows score alike; an empty table gives an empty result; further columns are carried by ``filter_toxic``.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import bounded_batches, fresh, map_arrow, named
from driftline.session import cut_lineage

#: Labelled documents to learn from, at most; the lowest hashes of their ids are taken.
MAX_LABELLED = 50_000
STEM_LETTERS = (4, 6)
MIN_DOCS = 5
#: Different toxic texts that hold a stem, at least (counted by 60 marks, so never too many).
MIN_TEXTS = 5
MIN_LOG_ODDS = 2.5
PREDICT_AT = 0.3
FOLDS, HELD_OUT = 4, 2

#: How many words a negation or target reaches, and a threat waits for its target.
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 3
NEGATED, REPORTED, AIMED, THREAT = 0.6, 0.7, 1.3, 3.0

# Words of the grammar in English, German, French and Spanish.
THREATS = frozenset("kill murder destroy hurt beat burn shoot töte töten umbringen zerstören tuer détruire frapper "
                    "matar destruir golpear".split())
TARGETS = frozenset("you your yours he she they them dich dir du euch ihr toi tu vous te ti usted ustedes".split())
NEGATIONS = frozenset("not no never neither nor kein keine nie niemals ne jamais nunca ni sin".split())
REPORTS = frozenset("said says wrote quoted claimed reported sagte schrieb behauptete dit écrit affirme dijo "
                    "escribió".split())

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
INSULT, THREATEN, AIM, NEGATE, REPORT, OTHER = range(6)


@dataclass(frozen=True)
class Transducer:
    """A finite table: (state, symbol) -> (next state, emission, factor); state 0 begins."""

    table: dict[tuple[int, int], tuple[int, float, float]]


def _countdown(opens: int, reach: int, factor: float, closes: bool = False) -> Transducer:
    """After ``opens``, emissions of the next ``reach`` words are multiplied (of all later ones, if it never closes)."""
    table = {}
    for state in range(reach + 1):
        for symbol in range(6):
            left = reach if symbol == opens else state if closes else max(state - 1, 0)
            table[state, symbol] = (left, 0.0, factor if state and symbol != opens else 1.0)
    return Transducer(table)


def insults() -> Transducer:
    """Emits 1 for an insult (to be weighted by the word) and ``THREAT`` when a threat meets its target."""
    table = {}
    for state in range(THREAT_REACH + 1):
        for symbol in range(6):
            emitted = 1.0 if symbol == INSULT else THREAT if symbol == AIM and state else 0.0
            left = THREAT_REACH if symbol == THREATEN else 0 if symbol == AIM else max(state - 1, 0)
            table[state, symbol] = (left, emitted, 1.0)
    return Transducer(table)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols: emissions add, factors multiply; only states that can be reached remain."""
    index, todo, table = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        x, y = todo.pop()
        for symbol in range(6):
            nx, ea, fa = a.table[x, symbol]
            ny, eb, fb = b.table[y, symbol]
            if (nx, ny) not in index:
                index[nx, ny] = len(index)
                todo.append((nx, ny))
            table[index[x, y], symbol] = (index[nx, ny], ea + eb, fa * fb)
    return Transducer(table)


def grammar() -> Transducer:
    return compose(compose(compose(insults(), _countdown(NEGATE, NEGATION_REACH, NEGATED)),
                           _countdown(AIM, TARGET_REACH, AIMED)), _countdown(REPORT, 1, REPORTED, closes=True))


def score_clause(words: list[tuple[str, float]], fst: Transducer) -> float:
    """Sum of what the grammar emits; ``words``: (word, weight as an insult or 0)."""
    state, total = 0, 0.0
    for word, weight in words:
        symbol = (INSULT if weight else THREATEN if word in THREATS else AIM if word in TARGETS else
                  NEGATE if word in NEGATIONS else REPORT if word in REPORTS else OTHER)
        state, emitted, factor = fst.table[state, symbol]
        if emitted:
            total += emitted * factor * (weight or 1.0)
    return total


def stems_of(word: str) -> list[str]:
    """Prefixes that stand for a word; a whole short word is marked by a closing blank."""
    out = [word[:n] for n in STEM_LETTERS if len(word) >= n]
    return out if len(out) == len(STEM_LETTERS) else [*out, word + " "]


@dataclass
class Model:
    """Insult stems with their weights, and the logistic curve over a document's figures."""

    stems: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    shift: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    constant: float | None = 0.0

    def __post_init__(self):
        self._scanner = None

    def __getstate__(self):
        return {**self.__dict__, "_scanner": None}

    def scanner(self):
        if self._scanner is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for stem in self.stems:
                found.add_word(stem.rstrip(" "), stem.rstrip(" "))
            for word in THREATS:
                found.add_word(word, word)
            found.make_automaton()
            self._scanner = (found, grammar())
        return self._scanner

    def weight(self, word: str) -> float:
        return max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)

    def figures(self, text: str | None) -> tuple[float, float, float]:
        """Sum (logarithmic), greatest and number (logarithmic) of the matched clauses' scores."""
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        scanner, fst = self.scanner()
        starts = sorted({at for end, word in scanner.iter(low) if (at := end - len(word) + 1) == 0 or not low[at - 1].isalpha()})
        if not starts:
            return 0.0, 0.0, 0.0
        total = most = 0.0
        n, k = 0, 0
        for clause in CLAUSE.finditer(low):
            if clause.start() > starts[-1]:
                break
            k = bisect_right(starts, clause.start() - 1, k)
            if k >= len(starts) or starts[k] >= clause.end():
                continue
            hits = set(starts[k:bisect_right(starts, clause.end() - 1, k)])
            words = [(m.group(), self.weight(m.group()) if m.start() in hits else 0.0)
                     for m in WORD.finditer(low, clause.start(), clause.end())]
            score = score_clause(words, fst)
            if score > 0:
                total, most, n = total + score, max(most, score), n + 1
        return math.log1p(total), most, math.log1p(n)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.curve[0] + sum(w * (x - s) for w, x, s in zip(self.curve[1:], self.figures(text), self.shift))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def learnable(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, l_id) of at most ``limit`` labelled ids outside the held-out fold.

    The labels are cut to the limit before the join, so the broadcast side has at most that many rows of
    a key and a flag.
    """
    flags = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("l_id")))
             .orderBy(F.xxhash64("l_id"), "l_id").limit(limit))
    return docs.select(named(doc_id).alias("d_id"), named(text).alias("text")).join(
        F.broadcast(flags), F.col("d_id") == F.col("l_id")).select("text", "toxic", "l_id")


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: stem, toxic and clean documents that hold it, and a 60-bit mask of the toxic texts' hashes."""
    for b in batches:
        found: dict[str, list[int]] = {}
        totals = [0, 0]
        for text, toxic in zip(b.column(0), b.column(1)):
            low, toxic = (text.as_py() or "").lower(), int(bool(toxic.as_py()))
            totals[toxic] += 1
            mark = 1 << zlib.crc32(low.encode()) % 60
            for stem in {s for w in set(WORD.findall(low)) for s in stems_of(w)}:
                row = found.setdefault(stem, [0, 0, 0])
                row[toxic] += 1
                if toxic:
                    row[2] |= mark
        found["\n"] = [*totals, 0]  # no word: the batch's totals
        yield pa.RecordBatch.from_arrays([
            pa.array(list(found)), *[pa.array([r[i] for r in found.values()], pa.int64()) for i in range(3)]],
            names=["stem", "clean", "toxic", "mask"])


def learn_stems(examples: DataFrame) -> tuple[dict[str, float], int, int]:
    """All stems that pass the odds test, and the clean and toxic documents behind them.

    They come from the labelled documents alone, whose number is bounded, and so is theirs.
    """
    counts = (examples.mapInArrow(_count_stems, "stem string, clean long, toxic long, mask long").groupBy("stem")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("mask")).alias("texts")))
    all_ = F.col("stem") == "\n"
    counts = cut_lineage(counts.where(all_ | ((F.col("toxic") >= MIN_DOCS) & (F.col("texts") >= MIN_TEXTS)
                                              & (F.col("toxic") > F.col("clean")))))  # read twice
    totals = counts.where(all_).select("clean", "toxic").first()
    if totals is None:
        return {}, 0, 0
    clean, toxic = totals
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    passed = counts.where(~all_).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    return {r["stem"]: r["odds"] for r in passed.orderBy("stem").collect()}, clean, toxic


def _figures_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([model.figures(t.as_py()) for t in b.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), b.column(1), b.column(2)],
                                             names=["a", "b", "c", "toxic", "l_id"])
    return run


def figures_by_id(examples: DataFrame, model: Model) -> DataFrame:
    """(a, b, c, toxic), a row for each labelled id: the greatest figures of the rows that share it."""
    id_type = examples.schema["l_id"].dataType.simpleString()
    found = examples.mapInArrow(_figures_of(model), f"a double, b double, c double, toxic int, l_id {id_type}")
    return found.groupBy("l_id").agg(F.max(F.struct("a", "b", "c", "toxic")).alias("r")).select("r.*")


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Ridge logistic regression by Newton's method; the intercept is not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          limit: int = MAX_LABELLED) -> Model:
    """Stems and curve from at most ``limit`` labelled ids; three numbers of each id come to the driver.

    However many rows share an id, the curve is fitted to one of them.
    """
    bounded_batches(docs.sparkSession)
    examples = learnable(docs, labels, doc_id, text, limit)
    stems, clean, toxic = learn_stems(examples)
    if not clean or not toxic:
        return Model({}, constant=toxic / (clean + toxic) if clean + toxic else 0.0)
    model = Model(stems, constant=None)
    rows = figures_by_id(examples, model).toPandas()
    rows = rows.sort_values(["a", "b", "c", "toxic"])  # sums do not depend on the order of arrival
    x, y = rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy(float)
    model.shift = x.mean(axis=0).tolist()
    model.curve = fit_curve(x - x.mean(axis=0), y)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """The documents with their score."""
    keep = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(b.schema.get_field_index(text))], pa.float64())
            cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, scores], names=[*[f.name for f in keep], out])

    return map_arrow(docs, run, T.StructType([*keep, T.StructField(out, T.DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels, doc_id=doc_id, text=text)
    slim = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return score(slim, model, keep_text=False).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns."""
    out, = fresh(docs, "score")
    model = learn(docs, labels, doc_id=doc_id, text=text)
    return score(docs, model, text=text, out=out).where(named(out) < PREDICT_AT).select(*[named(c) for c in docs.columns])
