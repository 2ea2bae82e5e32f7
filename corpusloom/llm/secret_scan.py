"""Secret scans: base rules, and formats of credentials learned by grammar inference.

What the base rules find are labelled credentials, a kind each; other long tokens are
ordinary text. From a bounded sample of each, a prefix tree is built over character classes,
and its states are merged where their frequencies are statistically compatible, into a
probabilistic automaton (one task a kind). Every candidate token is then scored by its
log-likelihood under each kind's automaton over that under the automaton of ordinary tokens.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialize

#: The base rules, fixed; ASCII letters of the first in either case. Runs shorter than the
#: last two ask for can't hold a longer match, so leaving them out changes nothing.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex")
#: Candidates: maximal runs of credential characters, without dots and dashes at their ends.
LEAST_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_TOKEN)
EDGES = ".-_/"
#: Distinct strings of a kind that its automaton is fitted on, at most, and their length.
SAMPLE, SAMPLE_LENGTH = 1000, 256
#: Significance of the test that keeps two states apart.
ALPHA = 0.05
#: Log-odds in nats, credential over ordinary text, from which on a candidate is a secret.
LEAST_ODDS = 20.0
#: Nats a character by which a candidate may be less likely than the least likely labelled one.
SLACK = 0.5
#: Weight of the kind's own character frequencies where a state was seldom seen.
SMOOTH = 1.0

_END = "$"
_CLASS = {c: k for k, cs in {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs} | {c: c for c in "+/_.=-"}


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base rules' matches, by start and kind.
    Matches of a rule are leftmost and don't overlap; too short ones are dropped after that."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    found += [(m.start(), k, m.end(), m.start()) for k, rule in ((1, ACCESS), (2, HEX)) for m in rule.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple]) -> list[tuple[int, int]]:
    """Long tokens that no span of the base rules touches."""
    out, i, taken = [], 0, []
    for s, _, e, _ in spans:  # merged, as spans of two rules may overlap
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for m in TOKEN.finditer(text):
        a = m.start() + len(m.group()) - len(m.group().lstrip(EDGES))
        b = m.end() - (len(m.group()) - len(m.group().rstrip(EDGES)))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a >= LEAST_TOKEN and (i == len(taken) or taken[i][0] >= b):
            out.append((a, b))
    return out


def classes(token: str) -> str:
    return "".join(map(_CLASS.__getitem__, token))


@dataclass
class Automaton:
    """Log-probabilities by state: of the class that comes next (or the end), and where it
    leads; state 0 is the first. What a state never saw has the little that smoothing gives
    (`unseen`), and from there on a token goes by the kind's class frequencies alone (`rest`).
    A class's characters have the frequencies of the kind as a whole. `typical` is the least
    log-likelihood a character, without the end, of the strings it was inferred from."""

    step: list[dict[str, tuple[float, int]]]
    rest: dict[str, float]
    char: dict[str, float]
    unseen: float
    typical: float = -math.inf

    def parts(self, token: str) -> tuple[float, float]:
        """Log-likelihood of the token's characters, and of its end after them."""
        state, total = 0, 0.0
        for c, k in zip(token, classes(token), strict=True):
            way, state = self.step[state].get(k, (self.unseen + self.rest[k], -1)) if state >= 0 else (self.rest[k], -1)
            total += way + self.char[c]
        return total, self.step[state].get(_END, (self.unseen + self.rest[_END], -1))[0] if state >= 0 else self.rest[_END]

    def log_likelihood(self, token: str) -> float:
        return sum(self.parts(token))

    def fits(self, token: str) -> float:
        """The log-likelihood, or -inf where the token's characters are less likely, by more
        than SLACK each, than those of all that the automaton was inferred from."""
        inside, end = self.parts(token)
        return inside + end if inside >= (self.typical - SLACK) * len(token) else -math.inf


class PrefixTree:
    """Counts of strings by prefix; states are merged by `merge`."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.through, self.ends = [0], [0]
        for s in strings:
            at = 0
            self.through[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.through.append(0)
                    self.ends.append(0)
                at = self.next[at][c]
                self.through[at] += 1
            self.ends[at] += 1
        # how many went each way, kept apart from the target's own count, as merged states
        # get visits from several ways
        self.ways = [{c: self.through[t] for c, t in n.items()} for n in self.next]

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the two states' frequencies of ends and ways, and those of all states
        behind them, could be of one distribution, by Hoeffding's bound."""
        wide, todo = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.through[a], self.through[b]
            bound = wide * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # too rare to tell, and so are all behind them
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.ways[a].keys() | self.ways[b].keys():
                if abs(self.ways[a].get(c, 0) / n - self.ways[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Folds the tree under b into the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.through[a] += self.through[b]
            self.ends[a] += self.ends[b]
            for c, t in self.next[b].items():
                self.ways[a][c] = self.ways[a].get(c, 0) + self.ways[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t


def infer(tokens: list[str], alpha: float = ALPHA, coarse: bool = False) -> Automaton:
    """The automaton of a kind. States that are kept grow from the first; each state next to
    them is merged into the first kept one it is compatible with, or kept itself; the most
    visited first. With `coarse`, all are merged into one. tokens in any order give one result."""
    tree = PrefixTree(sorted(map(classes, tokens)))
    kept, parents = [0], {0: None}
    border = [(c, t, 0) for c, t in tree.next[0].items()]
    while border:
        border.sort(key=lambda x: (-tree.through[x[1]], x[1]), reverse=True)
        c, state, parent = border.pop()
        if tree.next[parent].get(c) != state or state in parents:
            continue
        for red in kept:
            if coarse or tree.compatible(red, state, alpha):
                tree.next[parent][c] = red
                tree.merge(red, state)
                break
        else:
            kept.append(state)
            parents[state] = parent
        have = {(p, x) for x, _, p in border}
        border = [(x, tree.next[p][x], p) for x, _, p in border]
        border += [(x, t, p) for p in kept for x, t in tree.next[p].items() if t not in parents and (p, x) not in have]
    number = {s: i for i, s in enumerate(kept)}
    every = Counter(c for t in tokens for c in t)
    by_class = Counter()
    for c, n in every.items():
        by_class[_CLASS[c]] += n
    marks = [*sorted(set(_CLASS.values())), _END]
    by_class[_END] = len(tokens)
    total = sum(by_class.values())
    rest = {k: (by_class[k] + 0.5) / (total + 0.5 * len(marks)) for k in marks}
    members = Counter(_CLASS.values())
    char = {c: math.log((every[c] + 0.5) / (by_class[k] - (len(tokens) if k == _END else 0) + 0.5 * members[k])) for c, k in _CLASS.items()}
    step, least = [], 1.0
    for s in kept:
        n = tree.through[s]
        seen = {k: (tree.ways[s][k], number[t]) for k, t in tree.next[s].items()} | ({_END: (tree.ends[s], -1)} if tree.ends[s] else {})
        step.append({k: (math.log((w + SMOOTH * rest[k]) / (n + SMOOTH)), t) for k, (w, t) in seen.items()})
        least = min(least, SMOOTH / (n + SMOOTH))
    made = Automaton(step, {k: math.log(p) for k, p in rest.items()}, char, math.log(least))
    made.typical = min((made.parts(t)[0] / len(t) for t in tokens), default=-math.inf)
    return made


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _base, _tokens): arrays of (start, kind, end, value) by start and kind, and of
    (start, end, value), the candidates that no base span touches."""
    token = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    @F.arrow_udf("struct<base: array<struct<start: int, kind: int, end: int, value: string>>, tokens: array<struct<start: int, end: int, value: string>>>")
    def find(texts: pa.Array) -> pa.Array:
        base, tokens = [], []
        for x in texts:
            t = x.as_py() or ""
            spans = base_spans(t)
            base.append([{"start": a, "kind": k, "end": b, "value": t[v:b]} for a, k, b, v in spans])
            tokens.append([{"start": a, "end": b, "value": t[a:b]} for a, b in candidates(t, spans)])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(span)), pa.array(tokens, pa.list_(token))], ["base", "tokens"])

    return docs.select(F.col(id_col).alias("_id"), find(F.col(text_col).cast("string")).alias("_f")).select("_id", F.col("_f.base").alias("_base"), F.col("_f.tokens").alias("_tokens"))


def log_odds(token: str, kinds: dict[int, Automaton], plain: Automaton) -> tuple[float, int]:
    """(log-odds over ordinary text, kind) of the kind that a token fits best; a tie goes to
    the kind listed first. Tokens without a letter, or without a digit, fit none."""
    if token.isalpha() or not any(c.isalpha() for c in token) or not any(c.isdigit() for c in token):
        return -math.inf, -1
    odds, kind = max(((m.fits(token), -k) for k, m in kinds.items() if k >= 0), default=(-math.inf, 1))
    return odds - plain.log_likelihood(token), -kind


def fit(scanned: DataFrame, sample: int = SAMPLE, length: int = SAMPLE_LENGTH, alpha: float = ALPHA, least_odds: float = LEAST_ODDS) -> dict[int, Automaton]:
    """An automaton a kind, -1 for ordinary text, each fitted on at most `sample` distinct
    strings of at most `length` characters, those with the smallest hashes.

    Long tokens that no rule finds may be credentials too, and mustn't teach what ordinary
    text looks like: those that a kind explains better, by least_odds, than an automaton of
    one state for all of them are left out before ordinary text's own is inferred.
    """
    labelled = scanned.select(F.explode("_base").alias("b")).select("b.kind", "b.value")
    plain = scanned.select(F.explode("_tokens").alias("t")).select(F.lit(-1).alias("kind"), "t.value")
    rows = labelled.unionByName(plain).where(F.length("value") <= length).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    some = materialize(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("kind", "value"), "secrets-sample")

    def inferred(model: Callable[[int, list[str]], Automaton]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            kind = int(group["kind"].iloc[0])
            return pd.DataFrame([(kind, pickle.dumps(model(kind, list(group["value"]))))], columns=["kind", "model"])

        return one

    def models(part: DataFrame, model: Callable[[int, list[str]], Automaton]) -> dict[int, Automaton]:
        found = part.groupBy("kind").applyInPandas(inferred(model), "kind int, model binary").collect()  # four rows
        return {r["kind"]: pickle.loads(bytes(r["model"])) for r in found}

    first = models(some, lambda kind, tokens: infer(tokens, alpha, coarse=kind < 0))
    ordinary = lambda tokens: [t for t in tokens if log_odds(t, first, first[-1])[0] < least_odds]
    found = first | models(some.where("kind = -1"), lambda _, tokens: infer(ordinary(tokens), alpha))
    discard(some)
    return found


def blank() -> Automaton:
    """What stands for ordinary text if there is none: all classes and characters alike."""
    return infer([])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_odds: float = LEAST_ODDS) -> DataFrame:
    """(id, base, added), one row a document: arrays of (kind, start, end, value) and of (kind,
    start, end, value, odds), both by start, then kind; code points, end exclusive.

    base: what the base rules find. added: long tokens elsewhere, with a letter and a digit, whose format is that of a
    kind: log-likelihood under its automaton, less that under the automaton of ordinary
    tokens, plus the log-odds of the two among all strings found, is least_odds or more, and
    the token is about as likely, character by character, as the least likely labelled one of
    the kind (SLACK); value is the token itself (for base spans, the credential in the match).

    Null and empty texts have no spans; repeated rows and ids, and null ids, are rows like any
    other. Texts are searched whole. A kind that the rules never found adds nothing; ties go
    to the kind listed first. Empty tables give no rows. Other columns aren't read, so their
    names can't clash. Automata don't depend on the order of rows.
    """
    scanned = materialize(scan(docs, id_col, text_col), "secrets")
    models = fit(scanned, least_odds=least_odds)
    counts = scanned.select(F.sum(F.size("_base")).alias("b"), F.sum(F.size("_tokens")).alias("t")).first()
    prior = math.log(((counts["b"] or 0) + 1) / ((counts["t"] or 0) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((models, models.get(-1) or blank(), prior))

    @F.arrow_udf("array<struct<kind: string, start: int, end: int, value: string, odds: double>>")
    def score(column: pa.Array) -> pa.Array:
        kinds, plain, before = shared.value
        out = []
        for tokens in column.to_pylist():
            told = [(t, *log_odds(t["value"], kinds, plain)) for t in tokens]
            out.append([{"kind": KINDS[k], "start": t["start"], "end": t["end"], "value": t["value"], "odds": x + before} for t, x, k in told if x + before >= least_odds])
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("odds", pa.float64())])
        return pa.array(out, pa.list_(item))

    names = F.array(*map(F.lit, KINDS))
    base = F.transform("_base", lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return scanned.select(F.col("_id").alias(id_col), base.alias("base"), score("_tokens").alias("added"))


def written(spans) -> F.Column:
    """Spans as kind:start:end, by start, then kind as listed, comma-joined."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["name"], s["a"], s["b"])), ",")


def redact(text, spans, mark: str = "[secret]") -> F.Column:
    """text with every span's characters replaced by `mark`; overlapping spans by one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["a"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
        F.greatest(acc["at"], s["b"]).alias("at"),
    )
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(order, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
