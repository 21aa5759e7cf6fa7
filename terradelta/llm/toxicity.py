"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause become symbols (insult, harm, intent, target, negation, reported speech). Five small transducers
read them: one emits insults, one threats, one whom they are aimed at, one negation, one reported speech. They are
composed into one machine; each of its arcs that emits an insult or a threat carries the weight of the pattern it
emits. A document's score comes from the weights of the patterns that its clauses match, not from its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

#: The grammar's own words in English, German, French and Spanish. Insults are learned too.
INSULTS = "idiot idiots moron morons loser losers scum trash worthless pathetic stupid disgusting clown clowns imbecile dumbass bastard vermin parasite dummkopf trottel arschloch abschaum connard crétin imbécile ordure idiota estúpido basura escoria imbécil"
HARM = "kill hurt destroy beat crush stab shoot strangle töten umbringen vernichten schlagen tuer frapper détruire écraser matar golpear destruir aplastar"
INTENT = "will gonna shall going werde werden wirst vais va allons voy vamos"
TARGET = "you your yours yourself u ur he she they him her them du dich dein deine ihr euch tu toi vous ton votre usted tú ustedes"
NEGATION = "not no never isn't aren't don't nobody without nicht kein keine nie niemals ohne pas jamais sans aucun nunca jamás sin ningún"
REPORTED = "said says called calls quoted wrote claimed told according sagte nannte schrieb laut dit appelle écrit selon dijo llamó escribió según"

OTHER, INSULT, HARMS, INTENDS, TARGETS, NEGATES, REPORTS = SYMBOLS = range(7)
#: How many words an intent, a target and a negation reach, and an insult or a threat to a target after it;
#: reported speech reaches the clause's end.
INTENT_REACH, TARGET_REACH, NEGATION_REACH, AIM_REACH = 4, 5, 3, 3
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"«»„“”]")
CLAUSE_ENDS = ".!?;:\n…"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
NOTHING: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` is (next state, what it emits); state 0 is the start of a clause."""

    arcs: list[list[tuple[int, frozenset[str]]]]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both reading the same symbols: states are pairs that can be reached, emissions are united."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        for a, b in todo:
            row = []
            for x in SYMBOLS:
                (to_a, out_a), (to_b, out_b) = self.arcs[a][x], other.arcs[b][x]
                if (to_a, to_b) not in number:
                    number[to_a, to_b] = len(number)
                    todo.append((to_a, to_b))
                row.append((number[to_a, to_b], out_a | out_b))
            arcs.append(row)
        return Transducer(arcs)


def emitting(states: int, step) -> Transducer:
    """From step(state, symbol) -> (next state, emission or None)."""
    return Transducer([[(to, frozenset([out]) if out else NOTHING) for to, out in (step(s, x) for x in SYMBOLS)] for s in range(states)])


def insult() -> Transducer:
    """Emits each insult."""
    return emitting(1, lambda s, x: (0, "insult" if x == INSULT else None))


def threat(reach: int = INTENT_REACH) -> Transducer:
    """Emits harm that an intent announces; the state is how many more words it reaches."""
    return emitting(reach + 1, lambda s, x: (reach if x == INTENDS else max(s - 1, 0), "threat" if x == HARMS and s else None))


def target(reach: int = TARGET_REACH, aim: int = AIM_REACH) -> Transducer:
    """Emits that an insult or harm stands after a target, or that a target follows one: a state for each pair of
    words that the target and the insult still reach."""

    def step(s: int, x: int) -> tuple[int, str | None]:
        near, open_ = divmod(s, aim + 1)
        bad = x in (INSULT, HARMS)
        out = "targeted" if bad and near else "aimed" if x == TARGETS and open_ else None
        near = reach if x == TARGETS else max(near - 1, 0)
        open_ = aim if bad else 0 if x == TARGETS else max(open_ - 1, 0)
        return near * (aim + 1) + open_, out

    return emitting((reach + 1) * (aim + 1), step)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Emits that a word is negated."""
    return emitting(reach + 1, lambda s, x: (reach if x == NEGATES else max(s - 1, 0), "negated" if s else None))


def reported() -> Transducer:
    """Emits that a word stands in reported speech."""
    return emitting(2, lambda s, x: (int(s or x == REPORTS), "reported" if s else None))


#: What an arc can emit: what it is (``aimed``: a target follows an insult or harm), then its marks.
KINDS, MARKS = ("insult", "threat", "aimed"), ("targeted", "negated", "reported")
PATTERNS = [(kind, *marks) for kind in KINDS for marks in product((False, True), repeat=len(MARKS))]


def compose() -> list[list[tuple[int, int]]]:
    """The composed machine: for each state and symbol the next state and the number of the pattern its arc emits (-1:
    none). Harm alone emits nothing."""
    machine = insult() @ threat() @ target() @ negation() @ reported()
    number = {p: n for n, p in enumerate(PATTERNS)}

    def pattern(out: frozenset[str]) -> int:
        kind = next((k for k in KINDS if k in out), None)
        return -1 if kind is None else number[(kind, *(m in out for m in MARKS))]

    return [[(to, pattern(out)) for to, out in row] for row in machine.arcs]


#: What the grammar alone expects, before labels: base log-odds, weights of an insult, a threat and an aimed
#: one, and what each mark adds.
BASE, KIND_WEIGHTS, MARK_WEIGHTS = -3.0, (2.0, 2.5, 1.0), (0.5, -1.0, -0.7)
PRIOR = [BASE] + [KIND_WEIGHTS[KINDS.index(p[0])] + sum(w for w, on in zip(MARK_WEIGHTS, p[1:], strict=True) if on) for p in PATTERNS]
HARM_WEIGHT = 3.0
#: By how much a target, and a threat over an insult, must raise a pattern's weight, and negation and report lower it.
STEP = 0.5
#: Weights of the strongest clause, and of the share of clauses that match, before labels.
PRIOR += [0.5, 0.5]


@dataclass
class Grammar:
    """The weighted grammar: the strength (log-odds) of each insult word and stem (``word*``), and the base, the
    weight of each pattern's arcs, in the order of PATTERNS, and those of the strongest clause and of the share
    of clauses that match."""

    insults: dict[str, float]
    arcs: list[float]

    def compiled(self) -> tuple:
        words = {w: k for k, ws in ((HARMS, HARM), (INTENDS, INTENT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORTED)) for w in ws.split()}
        find = ahocorasick.Automaton()
        for w in [*self.insults, *HARM.split()]:
            find.add_word(w.rstrip("*"), len(w.rstrip("*")))
        find.make_automaton()
        whole = {w: v for w, v in self.insults.items() if not w.endswith("*")}
        stems = {w[:-1]: v for w, v in self.insults.items() if w.endswith("*")}
        harm = max([HARM_WEIGHT, *self.insults.values()])  # a threat is as strong as any insult
        return find, words, whole, stems, sorted({len(s) for s in stems}, reverse=True), compose(), harm

    def chance(self, sums: list[float]) -> float:
        """That a text with these sums is toxic."""
        z = self.arcs[0] + sum(a * v for a, v in zip(self.arcs[1:], sums, strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def matched(clause: list[str], machine: tuple) -> list[tuple[int, float]]:
    """The patterns (number, strength) that the composed machine emits over the words of a clause."""
    _, words, whole, stems, lengths, table, harm = machine
    state, last, out = 0, harm, []
    for w in clause:
        strength = whole.get(w)
        if strength is None:
            strength = next((stems[w[:k]] for k in lengths if w[:k] in stems), None)
        x = INSULT if strength is not None else REPORTS if w in '"«»„“”' else words.get(w, OTHER)
        if x == HARMS:
            strength = harm
        last = strength if strength is not None else last  # an aimed pattern is as strong as what it aims
        state, pattern = table[state][x]
        if pattern >= 0:
            out.append((pattern, last))
    return out


def sums_of(text: str, machine: tuple) -> tuple[list[float], int]:
    """For each pattern the logarithm of the strengths of its matches in all clauses, the logarithms of the
    strength of the strongest clause and of the share of clauses that match; and the number of matches. Only clauses in which an
    insult or harm word begins a word are parsed, each once; the text is read from start to end."""
    low = text.lower()
    sums = [0.0] * len(PATTERNS)
    strongest, hits, matches, until = 0.0, 0, 0, 0
    for end, n in machine[0].iter(low):
        start = end - n + 1
        if start < until or (start and low[start - 1].isalpha()):
            continue
        a = max(max(low.rfind(c, until, start) for c in CLAUSE_ENDS) + 1, until)
        stop = CLAUSE_END.search(low, start)
        until = stop.start() if stop else len(low)
        found = matched(WORDS.findall(low, a, until), machine)
        for pattern, strength in found:
            sums[pattern] += strength
        matches += len(found)
        hits += bool(found)
        strongest = max(strongest, sum(strength for _, strength in found))
    share = math.log((hits + 1) / (sum(map(low.count, CLAUSE_ENDS)) + 2)) if hits else 0.0
    return [*(math.log1p(max(v, 0.0)) for v in sums), math.log1p(strongest), share], matches


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``prior``; a step is halved until it lowers the loss."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((b - prior) ** 2).sum())

    b = prior.astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - y) + strength * (b - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(b))
        step, now = np.linalg.solve(curve, slope), loss(b)
        while loss(b - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        b = b - step
    return b


def ordered(arcs: list[float]) -> list[float]:
    """Weights in the grammar's order, whatever the labels showed: a target makes an insult or threat weigh more by STEP, a
    threat weighs more than an insult, negation and report take STEP off. Labels often show one pattern only;
    others then rise above it, or fall below, so that clauses decide and not the word alone. Nothing weighs less than 0
    but by negation or report."""
    at = {p: n + 1 for n, p in enumerate(PATTERNS)}
    out = list(arcs)
    for marks in product((False, True), repeat=2):
        for kind in KINDS:
            calm = (kind, False, *marks)
            if not any(marks):
                out[at[calm]] = max(out[at[calm]], 0.0)
            if kind == "threat":
                out[at[calm]] = max(out[at[calm]], out[at["insult", False, *marks]] + STEP)
            out[at[kind, True, *marks]] = max(out[at[kind, True, *marks]], out[at[calm]] + STEP)
    for kind in KINDS:
        for targeted in (False, True):
            for negated, said in ((True, False), (False, True), (True, True)):
                above = [(kind, targeted, False, said)] * negated + [(kind, targeted, negated, False)] * said
                out[at[kind, targeted, negated, said]] = min(out[at[kind, targeted, negated, said]], *(out[at[p]] - STEP for p in above))
    return out


def learn(texts: DataFrame, min_share: float = 0.5) -> Grammar:
    """Fit insults and arc weights on labelled rows (text, toxic): the bounded sample that ``fit`` draws.

    Candidates are words and stems of 4 to 8 letters, counted by document; kept are those whose documents
    are toxic in at least ``min_share`` of cases and more often than chance allows over a million candidates
    (log-likelihood ratio). They, bounded by the sample, and a sum a pattern and sample row reach the driver. Weights
    are fitted by logistic regression and then put in the grammar's order (see ordered).
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = set(re.findall(r"[^\W\d_]{3,}", (text or "").lower()))
                for f in words | {w[:k] + "*" for w in words for k in range(4, min(len(w), 9))}:
                    seen.setdefault(f, [0, 0])[bool(toxic)] += 1
        if seen:
            yield {"feature": list(seen), "clean": [v[0] for v in seen.values()], "bad": [v[1] for v in seen.values()]}

    totals = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    share = ((totals.bad or 0) + 1) / (totals.n + 2)
    counts = map_rows(texts.select("text", "toxic"), count, "feature string, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    rate = F.col("bad") / (F.col("bad") + F.col("clean"))
    ratio = F.col("bad") * F.log(rate / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    kept = counts.where((F.col("bad") >= 3) & (rate >= max(min_share, share)) & (ratio > math.log(1e6))).orderBy("feature").collect()
    odds = lambda bad, clean: math.log((bad + share) / (clean + 1 - share)) - math.log(share / (1 - share))
    insults = {w: 3.0 for w in INSULTS.split()} | {r.feature: odds(r.bad, r.clean) for r in kept}
    grammar = Grammar(insults, list(PRIOR))

    def match(batches: Iterator[dict]) -> Iterator[dict]:
        machine = grammar.compiled()
        for b in batches:
            yield {"toxic": b["toxic"], "sums": [sums_of(t or "", machine)[0] for t in b["text"]]}

    rows = map_rows(texts.select("text", "toxic"), match, "toxic int, sums array<double>").collect()
    if rows:
        x = np.array([[1.0, *r.sums] for r in rows])
        order = np.lexsort(x.T)  # the same result whatever order rows arrive in
        grammar.arcs = ordered(logistic(x[order], np.array([r.toxic for r in rows], float)[order], np.array(PRIOR)).tolist())
    return grammar


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> Grammar:
    """Learn from at most ``rows`` labelled documents (a documented bound: those with the least hash of
    doc_id), none with crc32(doc_id as text) mod 4 = 2. Null labels are not learned from."""
    id_text = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_text % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "toxic")
    held = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    once = held.groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # an id's rows count as one
    return learn(once.select("text", "toxic").repartition(12))


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, matches) for every row: the whole text is matched, and the arc
    weights turn its sums into the chance that it is toxic. Null or empty text: no matches, the base chance.
    Null doc_id: held_out null. Repeated rows come out repeated. Empty table: no rows.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        machine = grammar.compiled()
        for b in batches:
            sums = [sums_of(text or "", machine) for text in b["text"]]
            yield {"doc_id": b["doc_id"], "score": [grammar.chance(s) for s, _ in sums], "matches": [n for _, n in sums]}

    scored = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, matches int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that score below ``threshold``. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.compiled()
        for b in batches:
            yield b.filter(pa.array([grammar.chance(sums_of(t or "", machine)[0]) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
