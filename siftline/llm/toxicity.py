"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: target, speaker, intention, harm, death, insult, "piece of", negation,
reported speech, clause break, other, and one for each word of a listed phrase. Transducers
read the symbols one after another. The first finds the listed phrases. The threat transducer
finds an intention with an act of harm, harm aimed at a target, and a target that is to die; a
word of harm alone is no match. The insult transducer finds insults said to a target, "piece of"
insults, and mere mentions. Those of negation and reported speech mark what they reach. All
but the first are composed to a single table. A clause's kind is the pattern and marks of its
strongest match; a text is scored by how many clauses of each kind it has, not by its words.

Insult words are learned from labelled texts alone (whole words and word beginnings that toxic texts
hold far more often than chance allows, by a bound that counts how many were tried): the code
lists none. The weights of the kinds, on the logarithm of their counts, are fitted by
logistic regression that is pulled towards fixed defaults.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, thrifty

OTHER, BREAK, NEGATION, REPORT, TARGET, SPEAKER, WILL, HARM, DIE, PIECE, INSULT, SAID_THREAT, SAID_INSULT = range(13)
#: Words that have their symbol without being learned (fixed values); no insults are among them, all are learned.
WORDS = {
    NEGATION: "not no never none don doesn didn isn aren wasn won cannot nicht kein keine nie pas jamais non nunca ningún tampoco",
    REPORT: "said says say told wrote claimed quoted alleged according reported sagte sagt schrieb laut dit disait selon écrit dijo dice según escribió",
    TARGET: "you your yours u he she him her they them these those du dich dein ihr euch tu toi te ton vous votre vos eres usted ustedes vosotros",
    SPEAKER: "i we ich wir je nous yo nosotros",
    WILL: "will ll gonna going shall should must want werde werden soll muss vais va allons veux voy vamos quiero",
    HARM: "kill murder hurt destroy shoot stab beat strangle hang burn töten umbringen schlagen erschießen tuer frapper brûler matar golpear quemar",
    DIE: "die dead suffer burn sterben tot mourir crever morir muerto",
    PIECE: "piece bunch load sack pile stück haufen morceau tas pedazo montón",
}
#: Phrases that are threats or insults as a whole (fixed values).
PHRASES = {
    SAID_THREAT: "watch your back|you are dead|you re dead|drop dead|go die|i know where you live|you will regret this|bring dich um|ich finde dich|je te retrouverai|te voy a encontrar",
    SAID_INSULT: "shut up|go to hell|get lost|screw you|you make me sick|halt die klappe|fahr zur hölle|ta gueule|va te faire|ferme la|vete al infierno|cállate la boca",
}
#: How far a negation, a target, an intention, an act of harm and "piece" reach, in words.
NEGATION_REACH, TARGET_REACH, WILL_REACH, HARM_REACH, PIECE_REACH = 3, 4, 3, 2, 2
#: What a clause can hold, and the marks on it.
HARM_AIMED, HARM_MEANT, THREAT_SAID, INSULT_MENTIONED, INSULT_DIRECT, INSULT_SAID = range(6)
NEGATED, REPORTED = 1, 2
N_SYMBOLS, N_KINDS = 13, 6 * 4
#: Labelled rows that the grammar is learned from, at most.
SAMPLE = 20_000
#: Characters of the word beginnings that may be learned.
BEGINNINGS = (3, 4, 5, 6, 7, 8)

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]").findall
_BREAKS = set(".!?;:\n")


def match(pattern: int, flags: int = 0) -> int:
    """The symbol of a match: from N_SYMBOLS on, four for each pattern."""
    return N_SYMBOLS + pattern * 4 + flags


def _with(symbol: int, flag: int) -> int:
    return N_SYMBOLS + ((symbol - N_SYMBOLS) | flag) if symbol >= N_SYMBOLS else symbol


def threat(state: tuple[int, int, int], symbol: int) -> tuple[tuple[int, int, int], int]:
    """Harm that is meant ("will kill"), aimed ("kill you"), or a target that is to die ("you will die")."""
    if symbol == BREAK:
        return (0, 0, 0), symbol
    target, will, harm = (max(0, n - 1) for n in state)
    out = symbol
    if symbol == SAID_THREAT:
        out = match(THREAT_SAID)
    elif symbol == HARM:
        out = match(HARM_MEANT) if state[1] else symbol
        harm = 0 if state[1] else HARM_REACH
    elif symbol == DIE and state[0] and state[1]:
        out = match(HARM_MEANT)
    elif symbol == TARGET:
        out = match(HARM_AIMED) if state[2] else symbol
        target, harm = TARGET_REACH, 0
    elif symbol == WILL:
        target, will = state[0], WILL_REACH
    return (target, will, harm), out


def insult(state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int]:
    """Insults said to a target ("you idiot", "he is such a fool"), "piece of" ones, mentions."""
    if symbol == BREAK:
        return (0, 0), symbol
    target, piece = (max(0, n - 1) for n in state)
    out = symbol
    if symbol == SAID_INSULT:
        out = match(INSULT_SAID)
    elif symbol == INSULT:
        out = match(INSULT_SAID if state[1] else INSULT_DIRECT if state[0] else INSULT_MENTIONED)
    elif symbol == TARGET or N_SYMBOLS <= symbol == match(HARM_AIMED):
        target = TARGET_REACH
    elif symbol == PIECE:
        piece = PIECE_REACH
    return (target, piece), out


def negation(state: int, symbol: int) -> tuple[int, int]:
    if symbol == BREAK:
        return 0, symbol
    if symbol == NEGATION:
        return NEGATION_REACH, symbol
    return max(0, state - 1), _with(symbol, NEGATED if state else 0)


def reported(state: int, symbol: int) -> tuple[int, int]:
    if symbol == BREAK:
        return 0, symbol
    return (1, symbol) if symbol == REPORT else (state, _with(symbol, REPORTED if state else 0))


def compose(*machines) -> list[list[tuple[int, int]]]:
    """table[state][symbol] = (next state, output) of (start, machine)s one after another."""
    start = tuple(first for first, _ in machines)
    names, table, todo = {start: 0}, [], [start]
    while todo:
        states = todo.pop(0)
        row = []
        for symbol in range(N_SYMBOLS):
            now, out = [], symbol
            for (_, machine), state in zip(machines, states):
                state, out = machine(state, out)
                now.append(state)
            key = tuple(now)
            if key not in names:
                names[key] = len(names)
                todo.append(key)
            row.append((names[key], out))
        table.append(row)
    return table


GRAMMAR = compose(((0, 0, 0), threat), ((0, 0), insult), (0, negation), (0, reported))
#: What a clause of each kind weighs before labels say otherwise.
DEFAULT = np.array([base - 2.5 * bool(f & NEGATED) - 2.0 * bool(f & REPORTED) for base in (3.0, 3.5, 4.0, 3.5, 5.0, 5.0) for f in range(4)])
DEFAULT_BIAS = -3.0


class Phrases:
    """The transducer of the listed phrases: their words, and the next place after each."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.out = [OTHER]
        for symbol, text in PHRASES.items():
            for phrase in text.split("|"):
                at = 0
                for word in phrase.split():
                    if word not in self.next[at]:
                        self.next[at][word] = len(self.next)
                        self.next.append({}), self.out.append(OTHER)
                    at = self.next[at][word]
                self.out[at] = symbol
        self.words = {w for row in self.next for w in row}

    def read(self, words: list[str], symbols: list[int]) -> list[int]:
        """``symbols`` of ``words``, the last one of each phrase replaced by the phrase's."""
        if self.words.isdisjoint(words):
            return symbols
        out, live = list(symbols), []
        for k, word in enumerate(words):
            live = [n for at in (*live, 0) if (n := self.next[at].get(word))]
            for at in live:
                if self.out[at]:
                    out[k] = self.out[at]
        return out


LISTED = Phrases()


class Symbols(dict):
    """The symbol of each word, by itself, else by its learned beginnings; remembers words."""

    def __init__(self, words: frozenset[str], beginnings: frozenset[str]):
        super().__init__(_FIXED | dict.fromkeys(words, INSULT) | dict.fromkeys(_BREAKS, BREAK))
        self.beginnings, self.fixed = beginnings, len(self)

    def __missing__(self, word: str) -> int:
        found = INSULT if any(len(word) > n and word[:n] in self.beginnings for n in BEGINNINGS) else OTHER
        if len(self) < self.fixed + 300_000:
            self[word] = found
        return found


_MAY_MATCH = {INSULT, HARM, DIE, SAID_THREAT, SAID_INSULT}


def clause_counts(text: str | None, symbols: Symbols) -> list[int]:
    """Clauses of each kind in the whole text."""
    counts = [0] * N_KINDS
    words = _TOKENS(text.lower()) if text else []
    read = LISTED.read(words, [symbols[w] for w in words])
    if _MAY_MATCH.isdisjoint(read):
        return counts
    state, best = 0, -1
    for symbol in (*read, BREAK):
        state, out = GRAMMAR[state][symbol]
        if out >= N_SYMBOLS:
            best = out - N_SYMBOLS if best < 0 or DEFAULT[out - N_SYMBOLS] > DEFAULT[best] else best
        elif symbol == BREAK and best >= 0:
            counts[best] += 1
            best = -1
    return counts


def words_of(text: str) -> set[str]:
    return {w for w in _TOKENS(text.lower()) if w not in _BREAKS}


_FIXED = {w: s for s, text in reversed(WORDS.items()) for w in text.split()}


def beginnings_of(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def _tally(entries_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, seen = Counter(), Counter()

        def out() -> pa.RecordBatch:
            columns = pa.array(list(seen), pa.string()), pa.array([bad[e] for e in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())
            return pa.RecordBatch.from_arrays(list(columns), ["entry", "bad", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                found = entries_of(text.as_py() or "")
                seen.update(found)
                if label.as_py():
                    bad.update(found)
                if len(seen) > 200_000:
                    yield out()
                    bad.clear(), seen.clear()
        yield out()

    return run


def _marks(texts: DataFrame, base: float, entries_of) -> frozenset[str]:
    """Entries nine in ten of whose texts are toxic, and more of them than chance allows.

    The log likelihood of an entry's toxic texts against the base rate has to outweigh the
    number of entries tried: fewer than one in e**3 such sets holds an entry by chance. What
    passes is bounded by the sample: an entry takes several toxic texts to pass.
    """
    seen = texts.mapInArrow(_tally(entries_of), "entry string, bad long, n long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    seen = materialise(seen.where("bad >= 2"), "entries")
    tried = max(1, seen.count())
    share = F.least(F.col("bad") / F.col("n"), F.lit(1 - 1e-9))
    gain = F.col("bad") * F.log(share / base) + (F.col("n") - F.col("bad")) * F.log((1 - share) / (1 - base))
    good = seen.where((share > 0.9) & (gain > math.log(tried) + 3))
    return frozenset(r.entry for r in good.select("entry").collect())


def learned_entries(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words, beginnings) that mark toxic texts, from (text, toxic) rows.

    Beginnings are learned from the words that aren't marks by themselves.
    """
    base = texts.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if not 0 < base < 1:
        return frozenset(), frozenset()
    words = _marks(texts, base, words_of)
    return words, _marks(texts, base, lambda text: beginnings_of(words_of(text) - words))


def fit(patterns: np.ndarray, bad: np.ndarray, n: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """(bias, weights) of the clause kinds (times log2(1 + count)) from texts grouped by their counts; Newton steps."""
    x = np.hstack([np.ones((len(patterns), 1)), np.log2(1 + patterns)])
    prior = np.concatenate(([DEFAULT_BIAS], DEFAULT))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (bad - n * p) - pull * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(words: frozenset[str], beginnings: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words, beginnings)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                counts = [clause_counts(t.as_py(), symbols) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.list_(pa.int32()))], [*batch.schema.names[1:], "clauses"])

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
    insults: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, held_out, score, predicted, clauses): one row per row of ``docs``.

    The grammar is learned from at most ``sample`` rows of ``labels`` (by a hash of their ids)
    whose crc32(id as text) mod 5 isn't 0; for the others ``held_out`` is true. Labels, and other
    columns of ``docs``, are no inputs of a score. ``clauses``: clauses of each kind. ``insults``: words, in lower case, that
    the caller knows to be insults whatever labels say; none by default. Texts that
    match nothing, null and empty ones too, get the score of the bias. A null id isn't held
    out. Without usable labels no insult is known, and listed threats and phrases with default weights decide. Repeated rows each
    count, copies of a text once in learning.
    """
    part = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    known = labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("int").alias("_toxic")).dropna()
    known = known.where(part("_lid") != 0).orderBy(F.xxhash64("_lid"), "_lid", "_toxic").limit(sample)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most ``sample`` rows of two numbers
    training = plain.join(F.broadcast(known), plain["id"] == known["_lid"]).select("text", F.col("_toxic").alias("toxic"), F.xxhash64("text").alias("h"))
    training = materialise(training.dropDuplicates(["h", "toxic"]).select("text", "toxic"), "training")
    words, beginnings = learned_entries(training)
    words |= set(insults)
    seen = training.mapInArrow(_counted(words, beginnings), "toxic int, clauses array<int>")
    seen = seen.groupBy("clauses").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
    weights = np.concatenate(([DEFAULT_BIAS], DEFAULT))
    if seen:
        weights = fit(np.array([r.clauses for r in seen], float), np.array([r.bad for r in seen], float), np.array([r.n for r in seen], float))
    bias, *each = weights.tolist()
    chosen = plain.select("text", "id").mapInArrow(thrifty(_counted(words, beginnings)), "id long, clauses array<int>")
    total = F.lit(bias)
    for k, w in enumerate(each):
        total = total + F.lit(w) * F.log2(1 + F.col("clauses")[k])
    score = 1 / (1 + F.exp(-total))
    out = chosen.select("id", "clauses", score.alias("score"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(part("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses",
    )
