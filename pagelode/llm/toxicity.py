"""Toxicity scores from a weighted finite-state pattern grammar.

A lexicon gives each word of a clause a symbol (insult, threat, target,
negation, report, other) and a weight. Five transducers over these symbols are
composed into one machine, which reads a clause and says what matched:

* negation: a negation word covers the next NEGATION_REACH words; insults there
  are negated, threats void;
* reported: after a report verb insults are reported and threats void up to the
  clause end;
* target: a clause that holds a target word, before or after, makes its insults
  and threats directed. The machine guesses this at the clause start; the wrong
  guess ends in a state that doesn't accept, so one path is left;
* insult and threat: write the matched pattern (directed, plain, negated,
  reported, threat) with its weight; a threat without a target is no match.

A document's score joins the matched patterns of its clauses by noisy-or, a
word once for each pattern, so isolated words without their clause don't count.
The lexicon's fixed part is small and English. Insult words and stems of any
language are learned from labelled documents by greedy cover: the stem that
explains most toxic documents and hardly any clean one comes first, its
documents are set aside, and so on; so words that merely occur in copies of
toxic texts aren't learned. Each pattern's weight starts from a prior and
follows the labelled rows.

Learning uses at most ``bound`` labelled rows of each label value (a documented
parameter); scores cover whole texts of all rows. Where that leaves out more
clean rows than toxic ones, each sampled clean row counts for those it stands
for, so a stem's share of toxic documents is that of all labelled rows. Each learned stem covers a
hundredth of the toxic rows or more, so there are at most a hundred of them.

Defined results: null, empty and wordless texts score 0; repeated rows score
alike; equally good stems are taken in the order of cover, length and text;
without a usable label the fixed lexicon scores alone; an empty table gives an
empty result; further columns of the input stay, but one with the score's name
is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelode.llm.common import cut, over_texts

BOUND = 6000
NEGATION_REACH = 3
PRECISION = 0.6
END, INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "end", "insult", "threat", "target", "negation", "report", "other"
#: Prior weight of a pattern and how many labelled rows it counts for.
PRIOR = {"directed": 0.95, "plain": 0.9, "negated": 0.45, "reported": 0.45, "threat": 0.6}
PRIOR_ROWS = 4

FIXED = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown bastard imbecile",
    THREAT: "kill hurt destroy beat smash burn strangle stab shoot",
    TARGET: "you your yours u him her them they he she everyone",
    NEGATION: "not never no isn't aren't wasn't don't nobody without",
    REPORT: "said says say claimed claims wrote writes quoted called reported allegedly",
}
TOKEN = re.compile(r"[^\W\d_]+(?:['’]t\b)?|[.!?;\n]")


class Transducer:
    """Finite-state transducer with weights that multiply along a path.

    arcs[state][symbol] lists (output, weight, next state); a state without the
    symbol ends the path. Paths begin in ``starts`` and count if they end in
    ``accepting``.
    """

    def __init__(self, starts, accepting, arcs):
        self.starts, self.accepting, self.arcs = list(starts), set(accepting), arcs

    def run(self, symbols) -> tuple[float, list[str]] | None:
        """Weight and outputs of the best accepting path; None if there is none."""
        paths = {state: (1.0, None) for state in self.starts}
        for symbol in symbols:
            following: dict = {}
            for state, (weight, trace) in paths.items():
                for out, w, to in self.arcs[state].get(symbol, ()):
                    if to not in following or weight * w > following[to][0]:
                        following[to] = (weight * w, (out, trace))
            paths = following
        ends = [found for state, found in paths.items() if state in self.accepting]
        if not ends:
            return None
        weight, trace = max(ends, key=lambda x: x[0])
        out = []
        while trace is not None:
            out.append(trace[0])
            trace = trace[1]
        return weight, out[::-1]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the outputs of ``first`` to ``second``; states are pairs, those that can be reached."""
    starts = [(p, q) for p in first.starts for q in second.starts]
    arcs: dict = {}
    waiting = list(starts)
    while waiting:
        state = waiting.pop()
        if state in arcs:
            continue
        p, q = state
        arcs[state] = {
            symbol: found
            for symbol, steps in first.arcs[p].items()
            if (found := [(out, w * v, (to, on)) for mid, w, to in steps for out, v, on in second.arcs[q].get(mid, ())])
        }
        waiting += [to for steps in arcs[state].values() for _, _, to in steps]
    return Transducer(starts, {s for s in arcs if s[0] in first.accepting and s[1] in second.accepting}, arcs)


def passing(symbols, **changes) -> dict:
    """Arcs of a state that stays and copies ``symbols``, except for ``changes`` (symbol: (output, weight, next state))."""
    return {s: [(s, 1.0, None)] for s in symbols} | {s: [x] for s, x in changes.items() if x} | {s: [] for s, x in changes.items() if not x}


def staying(arcs: dict) -> dict:
    """Next state None means the state itself."""
    return {state: {symbol: [(out, w, state if to is None else to) for out, w, to in steps] for symbol, steps in found.items()} for state, found in arcs.items()}


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Words up to ``reach`` after a negation: insults become negated, threats void."""
    words = (OTHER, INSULT, THREAT, TARGET, REPORT)
    arcs = {0: passing(words, negation=(OTHER, 1.0, reach))}
    for left in range(1, reach + 1):
        moved = {s: (s, 1.0, left - 1) for s in words}
        arcs[left] = passing((), **moved | {INSULT: ("negated", 1.0, left - 1), THREAT: (OTHER, 1.0, left - 1), NEGATION: (OTHER, 1.0, reach)})
    return Transducer([0], arcs, staying(arcs))


def reported() -> Transducer:
    """After a report verb, insults become reported and threats void."""
    words = (OTHER, INSULT, THREAT, TARGET, "negated")
    after = passing(words, report=(OTHER, 1.0, None), insult=("reported", 1.0, None), negated=("reported", 1.0, None), threat=(OTHER, 1.0, None))
    return Transducer([0], [0, 1], staying({0: passing(words, report=(OTHER, 1.0, 1)), 1: after}))


def target() -> Transducer:
    """Insults and threats of a clause with a target become directed; states: promised, kept, and none promised."""
    marks = ("negated", "reported", OTHER)
    at = {"insult": ("insult+", 1.0, None), "threat": ("threat+", 1.0, None)}
    arcs = {
        "promised": passing(marks, target=(OTHER, 1.0, "kept"), **at),
        "kept": passing(marks, target=(OTHER, 1.0, None), **at),
        "none": passing((*marks, INSULT, THREAT), target=None),
    }
    return Transducer(["promised", "none"], ["kept", "none"], staying(arcs))


def insult(kinds: dict[str, float]) -> Transducer:
    """Writes the pattern of every insult with its weight."""
    marks = {INSULT: "plain", "insult+": "directed", "negated": "negated", "reported": "reported"}
    return Transducer([0], [0], staying({0: passing((OTHER, THREAT, "threat+"), **{s: (kind, kinds[kind], None) for s, kind in marks.items()})}))


def threat(kinds: dict[str, float]) -> Transducer:
    """Writes directed threats with their weight; others don't match."""
    marks = ("plain", "directed", "negated", "reported", OTHER)
    return Transducer([0], [0], staying({0: passing(marks, **{"threat+": ("threat", kinds["threat"], None), THREAT: (OTHER, 1.0, None)})}))


def grammar(kinds: dict[str, float]) -> Transducer:
    """The composed machine, from a clause's symbols to its matched patterns."""
    machine = negation()
    for part in (reported(), target(), insult(kinds), threat(kinds)):
        machine = compose(machine, part)
    return machine


def prefixes(word: str) -> list[str]:
    """The word itself, marked, and its stems of 3 to 8 letters."""
    return ["=" + word, *(word[:k] for k in range(3, min(8, len(word)) + 1))]


class Symbols(dict):
    """Word to (symbol, weight), worked out once a word; emptied when it grows large."""

    LIMIT = 50_000

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: (k, 0.97) for k, words in FIXED.items() for w in words.split()}

    def __missing__(self, token: str):
        if len(self) >= self.LIMIT:
            self.clear()
        if token in ".!?;\n":
            out = (END, 0.0)
        else:
            word = token.replace("’", "'")
            known = [self.stems[p] for p in prefixes(word) if p in self.stems]
            out = (INSULT, max(known)) if known else self.fixed.get(word, (OTHER, 0.0))
        if len(token) <= 40:
            self[token] = out
        return out


def matches(text: str, symbols: Symbols, machine: Transducer) -> dict[tuple[str, str], float]:
    """Matched patterns of a text, as (pattern, word) with the word's weight; a word counts once for each pattern."""
    tokens = TOKEN.findall(text.lower())
    found = list(map(symbols.__getitem__, tokens))
    hits = [at for at, x in enumerate(found) if x[0] == INSULT or x[0] == THREAT]
    out: dict[tuple[str, str], float] = {}
    done = 0
    for hit in hits:
        if hit < done:
            continue
        start, stop = hit, hit
        while start > done and found[start - 1][0] != END:
            start -= 1
        while stop < len(found) and found[stop][0] != END:
            stop += 1
        _, marks = machine.run([x[0] for x in found[start:stop]])  # every clause has one accepting path
        for at, mark in enumerate(marks, start):
            if mark != OTHER:
                out[mark, tokens[at]] = found[at][1]
        done = stop
    return out


def score_text(text: str | None, symbols: Symbols, machine: Transducer, kinds: dict[str, float]) -> float:
    found = matches(text, symbols, machine) if text else {}
    return 1.0 - math.prod(1.0 - weight * kinds[kind] for (kind, _), weight in found.items())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a stem, within a partition."""
    count = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            count[toxic].update({p for w in set(TOKEN.findall(text.lower())) if w not in ".!?;\n" for p in prefixes(w)})
    # a stem without a toxic document here still counts against it elsewhere
    stems = list(count[0].keys() | count[1].keys())
    for at in range(0, len(stems), 50_000):
        part = stems[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([count[1][s] for s in part], pa.int64()), pa.array([count[0][s] for s in part], pa.int64())], ["stem", "pos", "neg"])


def learn(sample: DataFrame, clean: float = 1.0) -> dict:
    """Model from labelled (doc_id, text, toxic 0/1) rows, a bounded sample in which a clean row stands for ``clean`` times as many rows as a toxic one."""
    sample = cut(sample.select("doc_id", "text", "toxic"))
    positives = sample.where("toxic = 1").count()
    least = max(4, positives // 100)
    totals = over_texts(sample, _counts, "stem string, pos long, neg long").groupBy("stem").sum("pos", "neg").toDF("stem", "pos", "neg")
    rows = totals.where(f"pos >= {least} and pos >= {PRECISION} * (pos + {clean!r}D * neg)").collect()  # stems of at most ``bound`` rows, each in a hundredth of them
    negative = {r["stem"]: r["neg"] * clean for r in rows}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sorted({p for w in set(TOKEN.findall(t.lower())) if w not in ".!?;\n" for p in prefixes(w) if p in negative}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "stems"])

    left = {r["doc_id"]: r["stems"] for r in over_texts(sample.where("toxic = 1"), held, "doc_id long, stems array<string>").collect()}  # at most ``bound`` rows
    stems: dict[str, float] = {}
    count = Counter(s for x in left.values() for s in x)
    while True:
        open_ = [s for s, n in count.items() if n >= least and n >= PRECISION * (n + negative[s])]
        if not open_:
            break
        # more toxic documents first, at equal cover the more telling and then the longer stem
        best = max(open_, key=lambda s: (count[s] * (count[s] / (count[s] + negative[s])) ** 2, len(s.lstrip("=")), s))
        stems[best] = (count[best] + 0.9) / (count[best] + negative[best] + 1)
        for doc in [d for d, x in left.items() if best in x]:
            count.subtract(left.pop(doc))
    kinds = dict(PRIOR)
    model = {"stems": stems, "kinds": kinds}

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = Symbols(stems), grammar(PRIOR)
        for b in batches:
            best = []
            for t in b.column("text").to_pylist():
                found = {k for k, _ in matches(t, symbols, machine)}
                best.append(next((k for k in PRIOR if k in found), None))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), b.column("toxic").cast(pa.int64())], ["kind", "toxic"])

    seen = over_texts(sample, outcome, "kind string, toxic long").where("kind is not null").groupBy("kind").agg({"toxic": "sum", "*": "count"}).toDF("kind", "toxic", "n").collect()
    for r in seen:
        kinds[r["kind"]] = (r["toxic"] + PRIOR[r["kind"]] * PRIOR_ROWS) / (r["toxic"] + (r["n"] - r["toxic"]) * clean + PRIOR_ROWS)
    return model


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores, 0 to 1."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != column.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, kinds, machine = Symbols(model["stems"]), model["kinds"], grammar(model["kinds"])
        for b in batches:
            scores = [score_text(t, symbols, machine, kinds) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, column])

    return over_texts(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
