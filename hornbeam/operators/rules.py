"""Horn rules: parsing, and compilation to the step table that grounding joins with.

Rules are few compared with the graph, so they are planned on the driver; from there on they are rows, and one plan
serves all rules of any length.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hornbeam.sources.shared import local

RULE_DDL = "rule_id int, line_no long, kind string, head_p string, head_s string, head_o string, conf float, text string"
STEP_DDL = "rule_id int, side string, step int, src int, p string, dir string, literal string, closes int, apart array<int>, n int, target int"


@dataclass(frozen=True)
class Atom:
    p: str
    s: str
    o: str


@dataclass(frozen=True)
class Rule:
    """kind: binary (both head terms are variables), unary (one is a constant), pattern (any connected body)."""

    rule_id: int
    line_no: int
    kind: str
    head: Atom
    body: tuple[Atom, ...]
    conf: float
    text: str


def variable(term: str) -> bool:
    return len(term) == 1


def parse_atom(text: str) -> Atom | None:
    """`p(s,o)`: the first bracket and the last, and the first comma between them, part the terms; these may hold more of each."""
    p, bracket, terms = text.strip().partition("(")
    first, comma, second = terms[:-1].partition(",")
    found = Atom(*(x.strip() for x in (p, first, second)))
    return found if bracket and comma and terms.endswith(")") and all((found.p, found.s, found.o)) else None


def body_atoms(text: str) -> list[str]:
    """The parts of a body, at each comma that white space follows."""
    ends = [i for i, c in enumerate(text) if c == "," and text[i + 1 : i + 2].isspace()]
    return [text[a + 1 : b] for a, b in zip([-1, *ends], [*ends, len(text)], strict=True)]


def parse_rule(text: str, conf: float, rule_id: int = 0, line_no: int = 0, pattern: bool = False) -> Rule | None:
    """`head <= atom, atom`; None if it is malformed, has no body, or is a pattern with constants."""
    head, arrow, body = text.partition("<=")
    atoms = [parse_atom(x) for x in body_atoms(body.strip())] if arrow and body.strip() else []
    top = parse_atom(head)
    if top is None or not atoms or None in atoms:
        return None
    kind = "pattern" if pattern else "binary" if variable(top.s) and variable(top.o) else "unary"
    if pattern and not all(variable(t) for a in (top, *atoms) for t in (a.s, a.o)):
        warnings.warn(f"a pattern rule with constants is left out: {text}", stacklevel=2)
        return None
    return Rule(rule_id, line_no, kind, top, tuple(atoms), float(np.float32(conf)), text)


def smoothed(predicted: float, correct: float) -> float:
    return float(np.float32(correct) / (np.float32(predicted) + np.float32(5)))


def load_rules(rows: Iterable[tuple], pattern: bool = False, first_id: int = 0, confidence_column: bool = False) -> tuple[list[Rule], int]:
    """rows: (line_no, predicted, correct, confidence, text). Returns the rules used, and how many rows were malformed.
    Confidences are smoothed, and rules at 0.99 or above left out; or confidences are taken as they stand."""
    out, bad = [], 0
    for line_no, predicted, correct, given, text in rows:
        conf = float(np.float32(given)) if confidence_column else smoothed(predicted, correct)
        rule = parse_rule(text, conf, first_id + len(out), line_no, pattern)
        if rule is None:
            bad += 1
        elif confidence_column or conf < 0.99:
            out.append(rule)
    return out, bad


def ordered(rules: list[Rule]) -> list[Rule]:
    """By confidence, descending; ties by head predicate and line."""
    return sorted(rules, key=lambda r: (-r.conf, r.head.p, r.line_no, r.rule_id))


def _path(start: str, atoms: Iterable[Atom], constants: bool) -> list[tuple[str, str, str, str | None]] | None:
    """(variable reached, predicate, direction, literal) of each hop from start; None if the atoms are no chain."""
    at, out = start, []
    for a in atoms:
        if a.s == at:
            to, way = a.o, "F"
        elif a.o == at:
            to, way = a.s, "B"
        else:
            return None
        out.append((to, a.p, way, to if constants and not variable(to) else None))
        at = to
    return out


def _path_steps(rule: Rule, side: str, start: str, target: str | None, atoms: Iterable[Atom], constants: bool) -> list[tuple]:
    """A new variable's value differs from those of the variables that earlier hops reached: not from the start's, nor from constants."""
    hops = _path(start, atoms, constants)
    if not hops:
        return []
    reached = [to for to, *_ in hops]
    if target is not None and target not in reached:
        return []
    end = max(i for i, to in enumerate(reached) if to == target) + 1 if target is not None else 0
    rows = []
    for i, (_, p, way, literal) in enumerate(hops, 1):
        apart = [j for j, h in enumerate(hops[: i - 1], 1) if h[3] is None] if literal is None else []
        rows.append((rule.rule_id, side, i, i - 1, p, way, literal, None, apart, len(hops), end))
    return rows


def _pattern_steps(rule: Rule, side: str, start: str, target: str) -> list[tuple]:
    """Repeatedly the first atom left that touches a bound variable (subject first); others are dropped. All values differ."""
    slot, left, rows = {start: 0}, list(rule.body), []
    while True:
        a = next((a for a in left if a.s in slot or a.o in slot), None)
        if a is None:
            break
        left.remove(a)
        src, to, way = (a.s, a.o, "F") if a.s in slot else (a.o, a.s, "B")
        closes = slot.get(to)
        apart = [] if closes is not None else sorted(slot.values())
        # every step adds a value, so that slots are places in one array
        rows.append([rule.rule_id, side, len(rows) + 1, slot[src], a.p, way, None, closes, apart])
        if closes is None:
            slot[to] = len(rows)
    if not rows or target not in slot:
        return []
    return [(*r, len(rows), slot[target]) for r in rows]


def compile_rule(rule: Rule) -> list[tuple]:
    """Rows of STEP_DDL. Sides: obj from the head's subject, sub from its object, and, of unary rules, body from its variable.
    A step leads from value `src` over (p, dir) to a new value, the next in the array; `closes`: it must equal that value."""
    h = rule.head
    if rule.kind == "pattern":
        return _pattern_steps(rule, "obj", h.s, h.o) + _pattern_steps(rule, "sub", h.o, h.s)
    if rule.kind == "binary":
        return _path_steps(rule, "obj", h.s, h.o, rule.body, False) + _path_steps(rule, "sub", h.o, h.s, rule.body[::-1], False)
    start = h.s if variable(h.s) else h.o
    return _path_steps(rule, "body", start, None, rule.body, True) if variable(start) else []


def step_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [s for r in rules for s in compile_rule(r)]
    return local(spark, rows, STEP_DDL)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules in order: rule_rank from 1."""
    rows = [(r.rule_id, r.line_no, r.kind, r.head.p, r.head.s, r.head.o, r.conf, r.text, i) for i, r in enumerate(ordered(rules), 1)]
    return local(spark, rows, RULE_DDL + ", rule_rank int")


def amie_rows(lines: Iterable[str]) -> list[tuple[float, float, float, str]]:
    """(predicted, correct, confidence, rule) from a miner's table: Rule, Head Coverage, Std Confidence, PCA Confidence,
    Positive Examples, Body size, ... Rules with a body size above 1 and a confidence below 1, most confident first."""
    out = []
    for line in lines:
        cells = line.rstrip("\n").split("\t")
        if len(cells) < 6 or "=>" not in cells[0]:
            continue
        conf, positive, size = float(cells[2].replace(",", ".")), float(cells[4]), float(cells[5])
        if size <= 1 or conf >= 1:
            continue
        body, _, head = cells[0].partition("=>")
        terms = lambda s: re.sub(r"\?", "", s).split()
        atoms = lambda t: [f"{t[i + 1]}({t[i]},{t[i + 2]})" for i in range(0, len(t) - 2, 3)]
        (top,), below = atoms(terms(head))[:1] or [""], atoms(terms(body))
        if top and below:
            out.append((size, positive, conf, f"{top} <= {', '.join(below)}"))
    return sorted(out, key=lambda r: -r[2])
