"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of words, and each clause of it ends with a stop. Five transducers over words, composed into one,
read it once:

* insult: words and phrases of the lexicon (weights learned from labels) and fixed phrases become `I`;
* threat: a verb of violence with the person it is meant for, and fixed phrases of several words, become `T`;
* negation: marks in its reach become `I-` and `T-`;
* target: marks near a person addressed, before or after them, become `I@` and `T@`;
* reported speech: takes everything up to the end of the clause, where it writes what the clause is: its gravest mark,
  with `"` if a reporting verb stands anywhere in the clause, before or after the mark.

So one weighted match comes out of each clause that has any, when it closes. Their weights, summed by class over the
clauses of a text, give a score through a logistic function fitted on labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, slices, table

#: Labelled rows that are used at most: those of the smallest hash of the id.
FIT_ROWS = 20_000
#: A lexicon word stands in this share of toxic rows among those that hold it, by this log-likelihood ratio at least.
LEAST_SHARE, LEAST_EVIDENCE, LEXICON_WORDS = 0.5, 25.0, 2_000
WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+(?:['’]t\b)?|[.!?;\n\"“”„«»]")
STOPS, QUOTES, END, OTHER = ".!?;", '"“”„«»', "$", ""
#: Words from a negation or a person to the mark that it concerns; from a verb to its object, and from an object to its verb.
REACH, OBJECT_AFTER, OBJECT_BEFORE = 3, 2, 3
NEGATED, TARGETED, REPORTED = -1.0, 0.5, -0.5
#: Closed classes of the grammar in the four languages.
NEGATIONS = "not no never nor cannot n't kein keine keinen nicht nie pas jamais ne ni nunca jamás".split()
REPORTING = "said says say called claimed reported wrote quoted sagte sagt schrieb behauptete dit disait écrit affirme dijo dice escribió afirmó".split()
PERSONS = "you your yours yourself he she him her they them their du dich dein deine ihr euch sie ihn tu toi ton te vous votre il elle ils tú usted ustedes ellos ella".split()
#: Verbs whose object follows, and verbs of the languages where it may also come before.
VERBS_BEFORE_OBJECT = "kill killing hurt destroy burn stab shoot strangle murder beat".split()
VERBS_AROUND_OBJECT = "töten umbringen verletzen erschießen verbrennen tuer frapper brûler étrangler matar golpear quemar mataré mataremos golpearé".split()
OBJECTS_BEFORE_VERB = "dich euch ihn te vous les os".split()
INSULT_PHRASES = ["piece of trash", "piece of garbage", "waste of space", "waste of oxygen", "stück dreck", "sac à merde", "pedazo de mierda"]
THREAT_PHRASES = [
    *(" ".join(x) for x in product(["you will", "you ll", "they will", "hope you"], ["die", "suffer", "pay for this", "regret this"])),
    *(" ".join(x) for x in product(["du wirst", "ihr werdet"], ["sterben", "leiden", "dafür bezahlen", "das bereuen"])),
    *(" ".join(x) for x in product(["tu vas", "vous allez"], ["mourir", "souffrir", "le payer", "le regretter"])),
    *(" ".join(x) for x in product(["vas a", "van a"], ["morir", "sufrir", "pagarlo", "lamentarlo"])),
    *(" ".join(x) for x in product(["never", "not", "n't"], ["wake up again", "see tomorrow", "leave alive", "get out alive"])),
    "watch your back", "know where you live", "come for you", "you are dead", "weiß wo du wohnst", "sais où tu habites", "sé dónde vives",
]
#: From the slightest to the gravest; a clause is told by the gravest of its marks.
GRAVITY = ("", "I-", "T-", "I", "T", "I@", "T@")
FINAL = (*GRAVITY[1:], *(f'{m}"' for m in GRAVITY[1:]))
FEATURES = len(FINAL) + 3


@dataclass(frozen=True)
class Transducer:
    """One symbol out for each one in. step: (state, symbol) -> (symbol out, next state, weight)."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[str, Hashable, float]]

    def compose(self, other: Transducer) -> Transducer:
        """Reads what self reads and writes what other writes; weights add up."""

        def step(state: tuple, symbol: str) -> tuple[str, tuple, float]:
            mid, here, w = self.step(state[0], symbol)
            out, there, v = other.step(state[1], mid)
            return out, (here, there), w + v

        return Transducer((self.start, other.start), step)

    def read(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        out, state = [], self.start
        for symbol in symbols:
            found, state, w = self.step(state, symbol)
            out.append((found, w))
        return out


class Arcs(dict):
    """(state number, symbol) -> (symbol out, next state number, weight), each worked out when first needed.

    The states are finite, so there are at most states times known words of them, whatever the texts.
    """

    def __init__(self, of: Transducer):
        super().__init__()
        self.step, self.states, self.numbers = of.step, [of.start], {of.start: 0}

    def __missing__(self, key: tuple[int, str]) -> tuple[str, int, float]:
        out, state, w = self.step(self.states[key[0]], key[1])
        to = self.numbers.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        self[key] = arc = (out, to, w)
        return arc


def phrases(found: dict[tuple[str, ...], float]) -> Transducer:
    """Writes "!" with its weight where a phrase ends and every other symbol as it is; the longest phrase counts.

    The state is the longest opening of a phrase that the text read so far ends with.
    """
    openings = {p[:i] for p in found for i in range(len(p))}
    longest = max(map(len, found), default=0)

    def step(state: tuple[str, ...], symbol: str) -> tuple[str, tuple[str, ...], float]:
        if symbol == END:
            return END, (), 0.0
        read = (*state, symbol)[-longest:] if longest else ()
        ends = [read[i:] for i in range(len(read))]
        whole = next((e for e in ends if e in found), None)
        state = next((e for e in ends if e in openings), ())
        return ("!" if whole else symbol), state, found[whole] if whole else 0.0

    return Transducer((), step)


def clauses() -> Transducer:
    """Writes END where a clause ends: at a line's end, and at a stop outside quotes. The state: within quotes or not."""

    def step(quoted: bool, symbol: str) -> tuple[str, bool, float]:
        if symbol in (END, "\n"):
            return END, False, 0.0
        if symbol and symbol in QUOTES:
            return OTHER, not quoted, 0.0
        if symbol and symbol in STOPS:
            return (OTHER if quoted else END), quoted, 0.0
        return symbol, quoted, 0.0

    return Transducer(False, step)


def insult(lexicon: dict[str, float]) -> Transducer:
    """`I` where a word of the lexicon stands or an insulting phrase ends."""
    known = phrases({tuple(p.split()): 1.0 for p in INSULT_PHRASES} | {(w,): weight for w, weight in lexicon.items()})

    def step(state: Hashable, symbol: str) -> tuple[str, Hashable, float]:
        out, state, w = known.step(state, symbol)
        return ("I" if out == "!" else out), state, w

    return Transducer(known.start, step)


def threat() -> Transducer:
    """`T!` where a threatening phrase ends (a negation in it is its own); `TA` where a verb of violence meets a person.

    The state: that of the phrases, for how many words a verb still waits for its object, and for how many one told
    before still waits for its verb.
    """
    known = phrases({tuple(p.split()): 1.0 for p in THREAT_PHRASES})
    before, around, persons, objects = set(VERBS_BEFORE_OBJECT), set(VERBS_AROUND_OBJECT), set(PERSONS), set(OBJECTS_BEFORE_VERB)

    def step(state: tuple, symbol: str) -> tuple[str, tuple, float]:
        phrase, verb, told = state
        out, phrase, w = known.step(phrase, symbol)
        if symbol == END:
            return END, (phrase, 0, 0), 0.0
        if out == "!":
            return "T!", (phrase, 0, 0), w
        if (verb and symbol in persons) or (told and symbol in around):
            return "TA", (phrase, 0, 0), 1.0
        verb = OBJECT_AFTER if symbol in before or symbol in around else max(0, verb - 1)
        told = OBJECT_BEFORE if symbol in objects else max(0, told - 1)
        return out, (phrase, verb, told), 0.0

    return Transducer((known.start, 0, 0), step)


def negation() -> Transducer:
    """Marks within REACH after a negation become `I-` and `T-`, but for phrases with a negation of their own."""
    negations = set(NEGATIONS)

    def step(left: int, symbol: str) -> tuple[str, int, float]:
        if symbol == END:
            return END, 0, 0.0
        if symbol in negations:
            return OTHER, REACH, 0.0
        if symbol == "T!":
            return "T", max(0, left - 1), 0.0
        if left and symbol in ("I", "TA"):
            return f"{symbol[0]}-", left - 1, NEGATED
        return symbol, max(0, left - 1), 0.0

    return Transducer(0, step)


def target() -> Transducer:
    """Marks within REACH of a person become `I@` and `T@`; where the person comes later, they become it there.

    The state: words since which a person counts, the mark that waits for one, and for how many words.
    """
    persons = set(PERSONS)

    def step(state: tuple, symbol: str) -> tuple[str, tuple, float]:
        person, mark, wait = state
        if symbol == END:
            return END, (0, "", 0), 0.0
        fewer = max(0, person - 1), mark if wait > 1 else "", max(0, wait - 1)
        if symbol == "TA":
            return "T@", (REACH, "", 0), TARGETED
        if symbol in ("I", "T"):
            return (f"{symbol}@", fewer, TARGETED) if person else (symbol, (0, symbol, REACH), 0.0)
        if symbol in persons:
            return (f"{mark}@", (REACH, "", 0), TARGETED) if mark else (OTHER, (REACH, "", 0), 0.0)
        return symbol, fewer, 0.0

    return Transducer((0, "", 0), step)


def reported() -> Transducer:
    """Writes nothing but at the end of a clause what the clause is. The state: its gravest mark, reported or not."""
    verbs = set(REPORTING)

    def step(state: tuple[str, bool], symbol: str) -> tuple[str, tuple[str, bool], float]:
        mark, told = state
        if symbol == END:
            return (f'{mark}"', ("", False), REPORTED) if mark and told else (mark, ("", False), 0.0)
        if symbol in GRAVITY:
            mark = max(mark, symbol, key=GRAVITY.index)
        return OTHER, (mark, told or symbol in verbs), 0.0

    return Transducer(("", False), step)


def parts(lexicon: dict[str, float]) -> list[Transducer]:
    """The transducers in the order in which they read."""
    return [clauses(), insult(lexicon), threat(), negation(), target(), reported()]


def grammar(lexicon: dict[str, float]) -> Transducer:
    first, *rest = parts(lexicon)
    for part in rest:
        first = first.compose(part)
    return first


class Scorer:
    """The clauses that match and their sums by class, for texts. lexicon: insult -> weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.arcs = Arcs(grammar(lexicon))
        fixed = [p.split() for p in (*INSULT_PHRASES, *THREAT_PHRASES)]
        verbs = {*VERBS_BEFORE_OBJECT, *VERBS_AROUND_OBJECT}
        #: No clause matches without one of these.
        self.marks = {*lexicon, *verbs, *(p[-1] for p in fixed)}
        self.ends = {*STOPS, "\n"}
        self.known = {*self.marks, *NEGATIONS, *REPORTING, *PERSONS, *OBJECTS_BEFORE_VERB, *STOPS, *QUOTES, "\n", *(w for p in fixed for w in p)}

    def symbol(self, token: str) -> str:
        return token if token in self.known else "n't" if token[-3:] in ("n't", "n’t") else OTHER

    def matches(self, text: str | None) -> Iterator[tuple[str, str, float]]:
        """(clause in lower case, its class, its weight) of every clause with a match."""
        lower = (text or "").lower()
        if self.marks.isdisjoint(WORD.findall(lower)):
            return
        state, arcs, known, start, weight = 0, self.arcs, self.known, 0, 0.0
        for token in TOKEN.finditer(lower):
            word = token[0]
            found, state, w = arcs[state, word if word in known else self.symbol(word)]
            weight += w
            if found:
                yield lower[start : token.end()].strip(), found, max(weight, 0.0)
            if state == 0 and word in self.ends:  # one within quotes ends no clause and leaves another state
                start, weight = token.end(), 0.0
        found, _, w = arcs[state, END]
        if found:
            yield lower[start:].strip(), found, max(weight + w, 0.0)

    def features(self, text: str | None) -> list[float]:
        """Weights by class, of all matches, and of all for the text's length; the number of matches. Logarithms."""
        total, n = dict.fromkeys(FINAL, 0.0), 0
        for _, kind, weight in self.matches(text):
            total[kind] += weight
            n += 1
        whole, length = sum(total.values()), len(text or "")
        return [float(x) for x in np.log1p([*total.values(), whole, whole / (1 + length / 500), n])]


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc text and label of at most fit_rows rows that are not held out."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (crc % 5 != 0))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return materialize(spark, docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxicity-fit")


def fit_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words that stand in toxic rows far more often than chance has it, with their log odds; all rows' words counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(counts: list[Counter]) -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array([counts[1][w] for w in words], pa.int64())], ["word", "clean", "toxic"])

        counts = [Counter(), Counter()]
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(set(WORD.findall((text or "").lower())))
            if len(counts[0]) > 200_000:
                yield told(counts)
                counts = [Counter(), Counter()]
        yield told(counts)

    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        return {}
    a, b = F.col("toxic"), F.col("clean")
    share = toxic / (clean + toxic)
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    known = rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known = known.filter((a >= LEAST_SHARE * (a + b)) & (2 * (part(a, share) + part(b, 1 - share)) >= LEAST_EVIDENCE))
    known = known.orderBy(F.desc("toxic"), "word").limit(LEXICON_WORDS).collect()
    return {r.word: float(np.log((r.toxic + 0.5) / (toxic + 1) * (clean + 1) / (r.clean + 0.5))) for r in known}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def scores(self, texts: list[str | None], scorer: Scorer) -> np.ndarray:
        x = np.array([scorer.features(t) for t in texts]).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits lexicon and weights. Without rows of both labels no word is an insult and each score is one half or less."""
    rows = labelled(spark, docs, labels, fit_rows)
    lexicon = fit_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches):
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # equal rows are summed, so that the few figures of at most fit_rows rows come back
    found = rows.mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    if not lexicon or not found:
        return Model({}, np.r_[-1.0, np.zeros(FEATURES)])
    times = [r["count"] for r in found]
    return Model(lexicon, fit_logistic(np.repeat([r.x for r in found], times, axis=0), np.repeat([r.toxic for r in found], times).astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from the text alone; narrow.

    Null and empty texts get the score of no match. Each row is scored by itself: repeated rows and null or repeated
    ids come back as often as they came, equal texts with equal scores. A text of any length is read whole, word by
    word. An empty table gives an empty one. Other columns, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in slices(batches):
            found = model.scores(batch.column(1).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns and as often as they came, whose text scores below `least`; narrow.

    A score of exactly `least` is rejected. Null and empty texts are scored as texts without a match. No column but
    text is looked at and none is added, so no name can clash; null ids are rows like others.
    """
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in slices(batches):
            yield batch.filter(pa.array(model.scores(batch.column(text_at).to_pylist(), scorer) < least))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model fitted on labelled rows that are not held out; see fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
