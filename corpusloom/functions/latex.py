r"""Equations in LaTeX, read once as a sequence of tokens.

A token is a command, a run of letters or of digits, `$$`, white space, or one other character.
Each pass goes over the tokens from left to right, so its work grows with the text.
"""

from __future__ import annotations

import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that aren't variables in equations.
CONSTANTS = ("e", "i", "pi", "infty", "inf")
OPERATORS = ("sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min", "det", "sup", "inf", "arg", "mod")
COMMANDS = ("frac", "int", "sum", "prod", "partial", "left", "right", "begin", "end", "sqrt", "cdot", "times", "displaystyle", "text", "mathrm", "mathbf", "vec", "hat", "bar", "tilde", "dot", "ddot", "overline", "underline", "overbrace", "underbrace")
GREEK = ("alpha", "beta", "gamma", "omega", "theta", "phi", "sigma", "mu", "lambda", "delta", "epsilon", "rho", "tau", "pi")

_TOKEN = re.compile(r"\\[A-Za-z]+|[A-Za-z]+|[0-9]+|\$\$|\s+|.", re.S)
_UNSEEN = (r"\llap", r"\marginpar")
_BOLD = (r"\vec", r"\mathbf")
_STOP = frozenset(CONSTANTS + OPERATORS + COMMANDS)

# What the tokens of a region count as: anything, only what has a form of its own (in a power),
# only vectors and derivatives (in a subscript), or plain names of a vector or a derivative.
_ANY, _FORMS, _BELOW, _VECTOR, _DERIVATIVE = range(5)


def _closing(tokens: list[str]) -> dict[int, int]:
    """The place of the brace that closes each open one; unclosed ones have none."""
    opened, ends = [], {}
    for i, t in enumerate(tokens):
        if t == "{":
            opened.append(i)
        elif t == "}" and opened:
            ends[opened.pop()] = i
    return ends


def _past_space(tokens: list[str], i: int) -> int:
    return i + 1 if i < len(tokens) and tokens[i].isspace() else i


def cleaned(text: str) -> str:
    r"""Without `$$`, `\llap{}`, `\marginpar{}` and white space after a backslash; runs of white
    space and of backslashes made one."""
    tokens, out, i = _TOKEN.findall(text), [], 0
    ends = _closing(tokens)
    while i < len(tokens):
        t = tokens[i]
        i += 1
        if t == "$$":
            continue
        if t in _UNSEEN and (end := ends.get(_past_space(tokens, i))) is not None:
            i = end + 1
            continue
        after_slash = bool(out) and out[-1] == "\\"
        if t.isspace():
            if out and out[-1] != " " and not after_slash:
                out.append(" ")
        else:
            if after_slash and t[0] == "\\":
                out.pop()
            out.append(t)
    return "".join(out).strip()


def _greek(command: str) -> str | None:
    return command[1:] if command[1:] in GREEK else None


def _subscript(tokens: list[str], i: int, end: int) -> str:
    """The first run of letters and digits, a command's name too; a Greek letter stands alone."""
    while i < end and not tokens[i].lstrip("\\").isalnum():
        i += 1
    if i < end and tokens[i][0] == "\\" and _greek(tokens[i]):
        return tokens[i][1:]
    name = ""
    while i < end and tokens[i].isalnum() or (i < end and not name and len(tokens[i]) > 1):
        name += tokens[i].lstrip("\\")
        i += 1
    return name


def variables_of(text: str | None) -> list[str]:
    """Distinct variables: those of vectors and bold parts, of derivatives, bases with their
    braced subscripts, bases of powers, Greek letters, single letters; in this order, then as
    they stand. A place counts once, for the first of these that covers it."""
    tokens = _TOKEN.findall(cleaned(text or ""))
    ends = _closing(tokens)
    found: dict[str, list[str]] = {k: [] for k in ("vector greek", "vector", "derivative greek", "derivative", "below", "power", "greek", "letter")}

    def group(i: int) -> int | None:
        """The end of a group with something in it that opens at i."""
        end = ends.get(i)
        return end if end is not None and end > i + 1 else None

    def derivative(i: int) -> int | None:
        """The end of a group that begins with the sign of a partial derivative."""
        end = group(i)
        return end if end is not None and end > i + 3 and tokens[i + 1] == r"\partial" and tokens[i + 2].isspace() else None

    regions: list[tuple[int, int]] = []
    i = 0
    while i < len(tokens):
        while regions and i >= regions[-1][0]:
            regions.pop()
        mode, t = regions[-1][1] if regions else _ANY, tokens[i]
        command, letters = len(t) > 1 and t[0] == "\\", t.isascii() and t.isalpha()
        i += 1
        if mode in (_VECTOR, _DERIVATIVE):
            kind = "vector" if mode == _VECTOR else "derivative"
            if command and _greek(t):
                found[f"{kind} greek"].append(t[1:])
            elif letters and len(t) == 1:
                found[kind].append(t)
            continue
        at = _past_space(tokens, i)
        if t in _BOLD and (end := group(at)):
            regions.append((end, _VECTOR))
            i = at
            continue
        if t == r"\frac" and (top := derivative(at)) and (end := derivative(_past_space(tokens, top + 1))):
            regions.append((end, _DERIVATIVE))
            i = at
            continue
        if not (command or letters):
            continue
        mark = tokens[i] if i < len(tokens) else ""
        if mark in ("_", "^") and (end := group(i + 1)):
            base = _greek(t) if command else t[-1]
            if letters and len(t) == 2 and mode == _ANY:
                found["letter"].append(t[0])
            if mark == "_":
                name = _subscript(tokens, i + 2, end)
                if base and name and mode != _BELOW:
                    found["below"].append(f"{base}_{name}")
                regions.append((end, _BELOW))
            else:
                if base and mode == _ANY:
                    found["power"].append(base)
                regions.append((end, _FORMS if mode == _ANY else mode))
            i += 2
        elif mode == _ANY:
            if command and _greek(t):
                found["greek"].append(t[1:])
            elif letters and len(t) == 1:
                found["letter"].append(t)
    return [v for v in dict.fromkeys(chain(*found.values())) if v.lower() not in _STOP]


def clean_latex(c: Column) -> Column:
    r"""`cleaned` of a column: without `$$`, `\llap{}`, `\marginpar{}` and needless spaces."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cleaned(x) for x in texts], dtype=object)

    return clean(c)


def latex_variables(c: Column) -> Column:
    """Distinct variables of an equation, as `variables_of` has them; none of a null."""

    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        return pd.Series([variables_of(x) for x in texts], dtype=object)

    return names(c)


def real_variables(names: Column) -> Column:
    """Names that aren't constants, operators or commands, case aside."""
    stop = F.array(*map(F.lit, CONSTANTS + OPERATORS + COMMANDS))
    return F.filter(names, lambda n: ~F.array_contains(stop, F.lower(n)))
