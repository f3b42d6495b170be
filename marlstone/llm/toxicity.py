"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the token classes of a clause: insults, threats, targets, negation and reported speech. They are
composed into one deterministic machine whose states are tuples of theirs; each insult or threat passes with its weight
times the factors of the machine's state, and a clause's score is the sum. A text's score joins its clauses' scores by
a logistic model. The insult lexicon (words and word beginnings, so that inflected forms count) and the logistic model
are fitted on at most FIT_ROWS labelled rows; lists of common words in four languages give the other classes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

FIT_ROWS = 12_000
PREDICT_AT = 0.7
#: Lengths of word beginnings; least labelled documents with a feature; least share of toxic ones among them.
STARTS, LEAST, PURE = (4, 5, 6, 7), 4, 0.75
SEEDS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown".split()
THREATS = "kill murder destroy burn beat shoot stab strangle töten umbringen tuer matar".split()
TARGETS = "you your yourself he she they them this these people du dich ihr sie er tu toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not never no isn't aren't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says told wrote claims claimed quoted sagte schrieb behauptet dit écrit affirme dijo escribió afirma".split()
OTHER, END, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
TOKEN = re.compile(r"[^\W\d_]+(?:'t)?|[.,;:!?\n()]+")
#: Factors: of a target in the clause, of a negation up to 3 tokens before, of reported speech.
AIMED, DENIED, REPORTED, THREAT_WEIGHT = 1.3, 0.5, 0.7, 1.5


class Machine:
    """A deterministic transducer over token classes: state -> class -> (state, weight factor); others stay, factor 1."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, float]]):
        self.arcs = arcs

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 1.0))


def _grammar() -> tuple[Machine, ...]:
    hit = (INSULT, THREAT)
    target = Machine({(0, TARGET): (1, 1.0), **{(1, k): (1, AIMED) for k in hit}})
    reach = {(s, k): (max(s - 1, 0), 1.0) for s in range(4) for k in (OTHER, TARGET, REPORT)}
    negation = Machine(reach | {(s, NEGATION): (3, 1.0) for s in range(4)} | {(s, k): (0, DENIED) for s in (1, 2, 3) for k in hit})
    report = Machine({(0, REPORT): (1, 1.0), **{(1, k): (1, REPORTED) for k in hit}})
    insult = Machine({(0, INSULT): (1, 1.0), (1, INSULT): (1, 0.5)})  # a second one in the clause adds half
    threat = Machine({(0, THREAT): (1, THREAT_WEIGHT), (1, THREAT): (1, 0.5)})
    return insult, threat, target, negation, report


def compose(machines: tuple[Machine, ...]) -> list[list[tuple[int, float]]]:
    """The product machine: table[state][class] = (state, factor), from the states that can be reached."""
    start = (0,) * len(machines)
    number, todo, out = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = []
        for kind in range(7):
            to = [m.step(s, kind) for m, s in zip(machines, state, strict=True)]
            after, factor = (start, 1.0) if kind == END else (tuple(t[0] for t in to), float(np.prod([t[1] for t in to])))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], factor))
        out.append(row)
    return out


class Classes(dict):
    """Token -> class, found once for each distinct token."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.weight = lexicon, {}
        self.fixed = {w: k for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.weight.clear()
        weight = max([self.lexicon.get(token, 0.0), *(self.lexicon.get(token[:n] + "*", 0.0) for n in STARTS)])
        kind = END if not token[0].isalpha() else INSULT if weight else self.fixed.get(token, OTHER)
        if kind in (INSULT, THREAT):
            self.weight[token] = weight or 1.0
        self[token] = kind
        return kind


def features(lexicon: dict[str, float]) -> Callable[[str | None], tuple[float, float, float, int]]:
    """Of a whole text: highest clause score, log of their sum, log of the number of matched clauses; that number."""
    classes, machine = Classes(lexicon), compose(_grammar())

    def of(text: str | None) -> tuple[float, float, float, int]:
        tokens = TOKEN.findall((text or "").lower())
        kinds = bytes([classes[t] for t in tokens])
        if INSULT not in kinds and THREAT not in kinds:
            return 0.0, 0.0, 0.0, 0
        scores, at = [], 0
        for clause in kinds.split(bytes([END])):
            if INSULT in clause or THREAT in clause:
                state, score = 0, 0.0
                for k, kind in enumerate(clause):
                    state, factor = machine[state][kind]
                    if kind in (INSULT, THREAT):
                        if tokens[at + k] not in classes.weight:
                            classes.pop(tokens[at + k], None)
                            classes[tokens[at + k]]  # the memory was emptied meanwhile
                        score += factor * classes.weight[tokens[at + k]]
                scores.append(score)
            at += len(clause) + 1
        return max(scores), float(np.log1p(sum(scores))), float(np.log1p(len(scores))), len(scores)

    return of


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): documents with each word or beginning, by label."""
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for value, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = {w for w in TOKEN.findall((value.as_py() or "").lower()) if w[0].isalpha()}
            starts = {w[:n] + "*" for w in words for n in STARTS if len(w) >= n}
            seen[toxic].update(words | starts)
        keys = list(seen[1]) + [k for k in seen[0] if k not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])


def _feature_batches(lexicon: dict[str, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(lexicon)
        for b in batches:
            rows = [of(v.as_py()) for v in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3)] + [b.column("toxic")], ["f0", "f1", "f2", "toxic"])

    return run


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; with too few rows of either label, a fixed model."""
    if min(y.sum(), len(y) - y.sum()) < 5:
        return np.array([-3.0, 1.5, 1.0, 1.0])
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[dict[str, float], list[float]]:
    """(lexicon, coefficients) from at most so many labelled rows, chosen by a hash of doc_id. Rows without a label or a
    text teach nothing; an id with several labels counts as toxic if one says so."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_ = durable(docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), F.col("__id") == F.col("doc_id")).where("text is not null").select("text", "toxic"))
    counts = rows_.mapInArrow(_count_batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.where((F.col("toxic") >= LEAST) & (F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean")))).collect()  # of the bounded sample
    lexicon = dict.fromkeys(SEEDS, 1.0)
    for f, toxic, clean in found:
        lexicon[f] = float(np.log((toxic + 0.5) / (clean + 0.5)) / 2)
    data = np.array([tuple(r) for r in rows_.mapInArrow(_feature_batches(lexicon), "f0 double, f1 double, f2 double, toxic int").collect()], float).reshape(-1, 4)
    return lexicon, _fit(data[:, :3], data[:, 3]).tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]]) -> DataFrame:
    """(doc_id, score, clauses) for each row of docs(doc_id, text): score from 0 to 1, and how many clauses matched.

    Whole texts are read. Null and empty texts have no clause and the score of a text without a match. Repeated rows
    each give a row; other columns are ignored; an empty table gives an empty result.
    """
    lexicon, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(lexicon)
        for b in batches:
            rows = [of(v.as_py()) for v in b.column(1)]
            x = np.array(rows, float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x[:, :3] @ np.array(w[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "score", "clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, clauses long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "clauses")
