"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols of five classes: insult, threat, target, negation and
reported speech. Each class has a transducer, written as a table of arcs; all
read the same symbols, and on an insult or a threat each says what the word's
weight is worth in its state. ``compose`` makes one transducer of the five, whose
states are tuples of theirs and whose factors are products. It may have several
arcs for a symbol (an insult may wait for the target that follows); a clause's
weight is that of its best accepted path.

A text is judged by its matched clauses. The insults are learned: words, and stems
of several lengths that stand for words not met before, whose presence goes with
the label by a likelihood-ratio test and that a greedy cover of the positive
texts needs; the closed classes are word lists. A
logistic model over clause totals, fitted on a bounded sample of labelled rows
and corrected to the label's rate among all training rows, makes the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cipherlake.llm.common import held_out, labelled_sample, strings

TOKEN = re.compile(r"[^\W_]+(?:['’]t)?")
CLAUSE = re.compile(r"[.!?;:,\n]+")
#: Lengths of the stems that stand for all longer words that begin with them.
STEMS = range(3, 9)
#: Fixed word lists, by class, in English, German, French and Spanish.
THREAT = frozenset("kill hurt destroy burn beat murder attack shoot stab strangle toten verletzen umbringen schlagen tuer frapper detruire matar golpear destruir quemar".split())
TARGET = frozenset("you your yours yourself u they them these those he she people du dich dir euch ihr sie tu te toi vous ils elles usted ustedes ellos ellas".split())
NEGATION = frozenset("not no never neither nor cannot nicht kein keine nie niemals pas jamais aucun nunca jamas tampoco ningun".split())
REPORT = frozenset("said says say told tells wrote writes called calls quoted reported claimed according sagte sagt meinte schrieb dit disait selon ecrit dijo dice segun escribio".split())
FEATURES = 6


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
WEIGHED = ("insult", "threat")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol, next state, factor); a symbol without an arc stays and is worth 1. Paths end in ``final``."""

    start: object
    final: frozenset
    arcs: tuple

    def step(self, state, symbol: str) -> list[tuple]:
        return [(to, factor) for at, by, to, factor in self.arcs if at == state and by == symbol] or [(state, 1.0)]


#: What follows an insult in its clause weighs more.
INSULTING = Transducer("calm", frozenset({"calm", "heated"}), (("calm", "insult", "heated", 1.0), ("heated", "insult", "heated", 1.1)))
#: A threat is worth little unless someone is named in the clause, before or after it.
THREATENING = Transducer(
    "idle",
    frozenset({"idle", "aimed"}),
    (("idle", "threat", "idle", 0.2), ("idle", "threat", "pending", 1.0), ("idle", "target", "aimed", 1.0), ("pending", "threat", "pending", 1.0), ("pending", "target", "aimed", 1.0)),
)
#: An insult with a target in the clause, before or after it, is worth half as much again.
TARGETING = Transducer(
    "none",
    frozenset({"none", "named"}),
    (("none", "insult", "none", 1.0), ("none", "insult", "pending", 1.5), ("none", "target", "named", 1.0), ("pending", "insult", "pending", 1.5), ("pending", "target", "named", 1.0), ("named", "insult", "named", 1.5)),
)
#: A negation halves what comes within three words.
NEGATING = Transducer(
    0,
    frozenset(range(4)),
    (*[(k, "negation", 3, 1.0) for k in range(4)], *[(k, s, k - 1, 0.5 if s in WEIGHED else 1.0) for k in (1, 2, 3) for s in SYMBOLS if s != "negation"]),
)
#: What comes after a verb of saying in its clause may be someone else's.
REPORTING = Transducer("own", frozenset({"own", "reported"}), (("own", "report", "reported", 1.0), *[("reported", s, "reported", 0.6) for s in WEIGHED]))
MACHINES = (INSULTING, THREATENING, TARGETING, NEGATING, REPORTING)


def compose(machines: tuple[Transducer, ...]) -> Transducer:
    """One transducer over tuples of states, those that can be reached; factors are multiplied."""
    start = tuple(m.start for m in machines)
    arcs, known, todo = [], {start}, [start]
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            for steps in product(*[m.step(q, symbol) for m, q in zip(machines, state)]):
                to = tuple(q for q, _ in steps)
                arcs.append((state, symbol, to, math.prod(f for _, f in steps)))
                if to not in known:
                    known.add(to)
                    todo.append(to)
    return Transducer(start, frozenset(q for q in known if all(x in m.final for m, x in zip(machines, q))), tuple(arcs))


class Reader:
    """The composed grammar as arrays: for each state and symbol, the next states and their factors."""

    def __init__(self, machine: Transducer):
        number = {machine.start: 0}
        for at, _, to, _ in machine.arcs:
            number.setdefault(at, len(number))
            number.setdefault(to, len(number))
        self.arcs = {s: [[] for _ in number] for s in SYMBOLS}
        for at, symbol, to, factor in machine.arcs:
            self.arcs[symbol][number[at]].append((number[to], factor))
        self.final = [q in machine.final for q in number]

    def weight(self, symbols: list[tuple[str, float]]) -> float:
        """The weight of the best accepted path over (symbol, weight)."""
        best = {0: 0.0}
        for symbol, weight in symbols:
            table, new = self.arcs[symbol], {}
            for state, so_far in best.items():
                for to, factor in table[state]:
                    worth = so_far + weight * factor
                    if worth > new.get(to, -1.0):
                        new[to] = worth
            best = new
        return max(w for q, w in best.items() if self.final[q])


READER = Reader(compose(MACHINES))


def clause_weight(symbols: list[tuple[str, float]]) -> tuple[float, int]:
    """The grammar's output over one clause's symbols (class, weight): best weight and the number of insults and threats."""
    n = sum(kind in WEIGHED for kind, _ in symbols)
    return (READER.weight(symbols), n) if n else (0.0, 0)


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) > k]


class Grammar:
    """Symbols of words, and the clause features of texts."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

        self.heads = {s[: STEMS[0]] for s in stems}

    def insult(self, word: str) -> float:
        """The weight of a word, else of its heaviest stem, else 0."""
        if word in self.words:
            return self.words[word]
        if word[: STEMS[0]] not in self.heads:
            return 0.0
        return max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)

    def symbols(self, tokens: list[str]) -> list[tuple[str, float]]:
        out = []
        for w in tokens:
            if weight := self.insult(w):
                out.append(("insult", weight))
            elif w in THREAT:
                out.append(("threat", 2.0))
            elif w in TARGET:
                out.append(("target", 0.0))
            elif w in NEGATION or w.endswith(("n't", "n’t")):
                out.append(("negation", 0.0))
            elif w in REPORT:
                out.append(("report", 0.0))
            else:
                out.append(("other", 0.0))
        return out

    def features(self, text: str | None) -> list[float]:
        """Clause totals: capped sum, largest, matched clauses, matches, matches over log of words, distinct insults."""
        if not text:
            return [0.0] * FEATURES
        total = top = 0.0
        clauses = n = n_words = 0
        found: set[str] = set()
        words, heads, first = self.words, self.heads, STEMS[0]
        for clause in CLAUSE.split(text.lower()):
            tokens = TOKEN.findall(clause)
            n_words += len(tokens)
            hits = [w for w in tokens if w in words or w[:first] in heads and self.insult(w)]
            if not hits and THREAT.isdisjoint(tokens):
                continue
            weight, k = clause_weight(self.symbols(tokens))
            if k:
                total, top, clauses, n = total + weight, max(top, weight), clauses + 1, n + k
                found.update(w for w in hits if self.insult(w))
        return [math.log1p(total), min(top, 20.0) / 5, math.log1p(clauses), math.log1p(n), n / math.log(2 + n_words), math.log1p(len(found))]


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, pos, n): labelled texts with the term, by presence, equal texts once; stems carry a leading ``^``."""

    def run(batches):
        pos, n = Counter(), Counter()
        for batch in batches:
            for text, label in zip(strings(batch.column(0)), strings(batch.column(1))):
                words = set(TOKEN.findall((text or "").lower()))
                words |= {"^" + s for w in words for s in stems_of(w)}
                n.update(words)
                if label:
                    pos.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([pos[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["term", "pos", "n"])

    return sample.select("text", "label").mapInArrow(run, "term string, pos long, n long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _g2(pos, neg, n_pos: int, n_neg: int):
    """Likelihood ratio of a term's presence against independence of the label."""
    share = (pos + neg) / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(pos > 0, pos * np.log(pos / (n_pos * share)), 0.0)
        b = np.where(neg > 0, neg * np.log(neg / (n_neg * share)), 0.0)
    return 2 * (a + b)


def cover(terms: list[str], neg: np.ndarray, texts: list[list[str]], n_pos: int, n_neg: int, least: float, enough: int = 3) -> list[int]:
    """Terms, as places in ``terms``, chosen one by one for the positives that need them.

    A text is covered when ``enough`` of its words are matched. Each step takes
    the term with the largest likelihood ratio over texts not yet covered, until
    none has ``least``. A word that only goes along with insults, as all words
    of much copied texts do, finds its texts covered and is never chosen.
    """
    place = {t: k for k, t in enumerate(terms)}
    of: list[dict[int, set[str]]] = []
    where: dict[int, list[int]] = {}
    for d, words in enumerate(texts):
        mine: dict[int, set[str]] = {}
        for w in words:
            for t in (w, *("^" + s for s in stems_of(w))):
                if t in place:
                    mine.setdefault(place[t], set()).add(w)
        of.append(mine)
        for k in mine:
            where.setdefault(k, []).append(d)
    left = np.array([len(where.get(k, ())) for k in range(len(terms))], float)
    matched: list[set[str]] = [set() for _ in texts]
    done, chosen = [False] * len(texts), []
    while len(terms):
        gain = np.where((left >= 2) & (left / max(n_pos, 1) > neg / max(n_neg, 1)), _g2(left, neg, n_pos, n_neg), -1.0)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        for d in where[best]:
            if done[d] or best not in of[d]:
                continue
            matched[d] |= of[d][best]
            done[d] = len(matched[d]) >= enough
            for k in [k for k, words in of[d].items() if done[d] or words <= matched[d]]:  # nothing more to gain there
                left[k] -= 1
                del of[d][k]
    return chosen


def learn_grammar(sample: DataFrame, least: float = 10.0) -> Grammar:
    """Insults: words and stems that mark positives, and that some positives need to be told by.

    Candidates have a likelihood ratio of ``least`` or more over the sample, in
    which equal texts of a label count once; ``cover`` picks among them all. The
    sample's size bounds their number.
    """
    sample = sample.select("text", "label").distinct().persist()
    by = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = by.get(1, 0), by.get(0, 0)
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    share = (a + b) / F.lit(float(n_pos + n_neg))
    part = lambda k, of: F.when(k > 0, k * F.ln(k / (F.lit(float(of)) * share))).otherwise(0.0)
    counts = _term_counts(sample).where(F.col("pos") >= 2).withColumn("g2", 2 * (part(a, n_pos) + part(b, n_neg)))
    counts = counts.withColumn("w", F.ln((a + 0.5) / (n_pos + 1.0)) - F.ln((b + 0.5) / (n_neg + 1.0))).where((F.col("g2") >= least) & (F.col("w") >= 2.0))
    # of equals a word comes before a stem, and the longer stem first
    rows = counts.orderBy(F.desc("g2"), F.col("term").startswith("^"), F.desc(F.length("term")), "term").collect()
    known = sample.sparkSession.sparkContext.broadcast({r["term"] for r in rows})

    def run(batches):
        for batch in batches:
            found = []
            for text in strings(batch.column(0)):
                words = set(TOKEN.findall((text or "").lower()))
                found.append(sorted(w for w in words if w in known.value or any("^" + s in known.value for s in stems_of(w))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["words"])

    texts = sorted(r["words"] for r in sample.where("label = 1").select("text").mapInArrow(run, "words array<string>").collect())
    sample.unpersist()
    chosen = [rows[k] for k in cover([r["term"] for r in rows], np.array([float(r["n"] - r["pos"]) for r in rows]), texts, n_pos, n_neg, least)]
    words, stems = {r["term"]: r["w"] for r in chosen if r["term"][0] != "^"}, {r["term"][1:]: r["w"] for r in chosen if r["term"][0] == "^"}
    return Grammar(words, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the intercept last, by Newton steps; moved from the sample's rate of positives to ``rate``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty
        w -= np.linalg.solve(h, x.T @ (p - y) / len(x) + penalty @ w)
    in_sample = min(max(y.mean(), 1e-6), 1 - 1e-6)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    w[-1] += math.log(rate / (1 - rate)) - math.log(in_sample / (1 - in_sample))
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000):
    """(grammar, weights) from at most ``per_class`` training rows of each label; None without both labels."""
    spark = docs.sparkSession
    sample = labelled_sample(spark, docs, labels, "toxic", per_class).persist()
    by = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by) < 2:
        sample.unpersist()
        return None
    grammar = learn_grammar(sample)
    known = spark.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            rows = [known.value.features(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "label").mapInArrow(run, "x array<double>, y int").collect()
    sample.unpersist()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    order = np.lexsort(np.vstack([x.T, y]))  # partitions come in any order; sums of floats depend on it
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return grammar, fit_logistic(x[order], y[order], usable.agg(F.avg("toxic")).first()[0])


def _scorer(docs: DataFrame, labels: DataFrame, **how):
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def score(texts) -> np.ndarray:
        if model.value is None:
            return np.array([0.0 for _ in texts])
        grammar, w = model.value
        x = np.array([grammar.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.5).

    Null and empty texts match no clause and get the score of that. A null
    doc_id counts as the text ``None`` for the fold. Without training rows of
    both labels every score is 0. Other columns are not read.
    """
    score = _scorer(docs, labels, **how)

    def run(batches):
        for batch in batches:
            s = score(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below 0.5."""
    score, at = _scorer(docs, labels, **how), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(strings(batch.column(at))) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
