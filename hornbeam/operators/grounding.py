"""Grounding rules by joins.

A frontier row is a partial grounding (plan, v0, v1, ...): a plan is a rule from one side, or from both at once, and a
value a column. A hop joins it with the adjacency on (node, edge), where an edge is a predicate and a direction. All
plans of one length share one chain of joins. Every join is an equi-join that shuffles by node; hubs are left to AQE's
skew join. What a step checks is joined after the hop, so that it is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hornbeam.operators.codec import Codec
from hornbeam.sources.shared import local, written

#: Steps and rules are broadcast up to so many rows; beyond that the joins are left to the optimizer.
BROADCAST_ROWS = 500_000


class Plan(NamedTuple):
    """side: obj, sub, body, or both; then the steps are those of obj, and the last one's values are checked for each side."""

    number: int
    rule_id: int
    side: str
    steps: list[Row]


def adjacency(triples: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """s, p, o of each triple. steps: only those of the predicates that steps follow, which are known before anything is
    read, so that scans are pruned; the result is a table, as each hop reads it anew, but for triples that are read from
    tables as they are (hornbeam_scan). Repeated triples repeat groundings only."""
    t = triples.select("s", "p", "o")
    if steps is None:
        return t.distinct()
    t = t.filter(F.col("p").isin([r[0] for r in steps.select("p").distinct().collect()]))
    return t if getattr(triples, "hornbeam_path", None) or getattr(triples, "hornbeam_scan", False) else written(t.distinct(), "adjacency")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than the rows that a table of rules may have."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("entity")).distinct()


def plans(steps: DataFrame, both: bool) -> list[Plan]:
    """both: a rule whose sides have the same groundings is one plan. The sides of a pattern have, and those of a path that
    ends at the head's variables; there only the values that the last step may not meet differ."""
    of: dict[tuple, list[Row]] = {}
    for r in sorted(steps.collect(), key=lambda r: (r["rule_id"], r["side"], r["step"])):
        of.setdefault((r["rule_id"], r["side"]), []).append(r)
    out = []
    for (rule, side), own in of.items():
        other = of.get((rule, "sub" if side == "obj" else "obj"), [])
        edges = lambda rows: [(r["p"], r["dir"]) for r in rows]
        turned = [(p, "B" if d == "F" else "F") for p, d in edges(other)[::-1]]
        path = all(r["src"] == i and r["closes"] is None and r["literal"] is None and 0 not in r["apart"] for x in (own, other) for i, r in enumerate(x))
        whole = bool(other) and own[0]["target"] == other[0]["target"] == own[0]["n"] == len(other)
        if both and side != "body" and path and whole and edges(own) == turned:
            if side == "obj":
                out.append(Plan(len(out), rule, "both", own))
        else:
            out.append(Plan(len(out), rule, side, own))
    return out


def directed(adj: DataFrame, edges: dict[tuple[str, str], int]) -> DataFrame:
    """src, edge, dst of the edges (predicate, direction) wanted."""
    out = []
    for way, src, dst in (("F", "s", "o"), ("B", "o", "s")):
        own = [(p, i) for (p, d), i in edges.items() if d == way]
        if own:
            table = local(adj.sparkSession, own, "edge_p string, edge int")
            t = adj.filter(F.col("p").isin([p for p, _ in own]))
            out.append(t.join(small(table, len(own)), F.col("p") == F.col("edge_p")).select(F.col(src).alias("src"), "edge", F.col(dst).alias("dst")))
    return reduce(DataFrame.unionByName, out)


def _edge(step: Row) -> tuple[str, str, bool]:
    return step["p"], step["dir"], step["literal"] is not None


def _hops(adj: DataFrame, steps: list[Row], code: Callable) -> tuple[dict[tuple[str, str, bool], int], DataFrame]:
    """The edges of the steps, numbered, and their rows (src, edge, dst). Steps to a constant have edges of their own, which
    lead to those constants alone, so that no other is joined."""
    edges = {e: k for k, e in enumerate(sorted({_edge(r) for r in steps}))}
    to_any, to_some = ({e[:2]: k for e, k in edges.items() if e[2] is literal} for literal in (False, True))
    out = [directed(adj, to_any)] if to_any else []
    if to_some:
        rows = sorted({(edges[_edge(r)], code(r["literal"])) for r in steps if r["literal"] is not None})
        ends = local(adj.sparkSession, rows, f"edge int, dst {dict(adj.dtypes)['s']}")
        out.append(directed(adj, to_some).join(small(ends, len(rows)), ["edge", "dst"], "left_semi").select("src", "edge", "dst"))
    return edges, reduce(DataFrame.unionByName, out)


def first_nodes(found: list[Plan], adj: DataFrame) -> DataFrame:
    """rule_id, side, start: every node that has an edge for the first step."""
    edges = {e: k for k, e in enumerate(sorted({(p.steps[0]["p"], p.steps[0]["dir"]) for p in found}))}
    table = local(adj.sparkSession, [(p.rule_id, p.side, edges[p.steps[0]["p"], p.steps[0]["dir"]]) for p in found], "rule_id int, side string, edge int")
    return directed(adj, edges).join(small(table, len(found)), "edge").select("rule_id", "side", F.col("src").alias("start")).distinct()


def _fits(i: int) -> Column:
    """The checks of a step (literal, closes, apart, as bits) for v{i}."""
    new = F.col(f"v{i}")
    fits = F.col("literal").isNull() | (new == F.col("literal"))
    closed = F.col("closes").isNull()
    for j in range(i):
        closed = closed | ((F.col("closes") == j) & (F.col(f"v{j}") == new))
        fits = fits & ~((F.col("apart").bitwiseAND(F.lit(1 << j)) != 0) & (F.col(f"v{j}") == new))
    return fits & closed


def in_part(column: str, part: tuple[int, int]) -> Column:
    """Whether the value belongs to the part (number, of how many)."""
    return F.pmod(F.xxhash64(column), F.lit(part[1])) == part[0]


def _chain(found: list[Plan], n: int, adj: DataFrame, starts: DataFrame | None, code: Callable, part: tuple[int, int] | None = None, tried: tuple[int, int] | None = None) -> DataFrame:
    """plan, start, end, ok of the plans of n steps. ok: bit 1 where the side obj has this grounding, bit 2 where sub has it.
    part: of the sides that start at the head's subject only the starts of this part are followed. tried: of the last step
    only the values of this part."""
    spark, kind = adj.sparkSession, dict(adj.dtypes)["s"]
    frontier = None if starts is None else starts.select("plan", F.col("start").alias("v0"))
    for i in range(1, n + 1):
        own = [(p, p.steps[i - 1]) for p in found]
        edges, hops = _hops(adj, [r for _, r in own], code)
        hops = hops.filter(in_part("dst", tried)) if tried and i == n else hops
        apart = lambda p, r: 0 if i == n and p.side == "both" else sum(1 << j for j in r["apart"])  # noqa: E731, B023
        rows = [(p.number, edges[_edge(r)], r["src"], None if r["literal"] is None else code(r["literal"]), r["closes"], apart(p, r)) for p, r in own]
        checks = local(spark, rows, f"plan int, edge int, src_slot int, literal {kind}, closes int, apart long")
        values = [f"v{j}" for j in range(i)]
        if frontier is None:  # every node that has an edge for the first step starts
            at = small(checks.select("plan", "edge"), len(rows))
            if part:
                at = small(local(spark, [(r[0], r[1], p.side in ("obj", "both")) for (p, _), r in zip(own, rows, strict=True)], "plan int, edge int, subject boolean"), len(rows))
            out = hops.join(at, "edge")
            out = (out.filter(~F.col("subject") | in_part("src", part)) if part else out).select("plan", F.col("src").alias("v0"), F.col("dst").alias("v1"))
        else:
            at = frontier.join(small(checks.select("plan", F.col("edge").alias("on_edge"), "src_slot"), len(rows)), "plan")
            at = at.withColumn("node", F.coalesce(*[F.when(F.col("src_slot") == j, F.col(v)) for j, v in enumerate(values)])).drop("src_slot")
            out = at.join(hops, (at["node"] == hops["src"]) & (at["on_edge"] == hops["edge"])).select("plan", *values, F.col("dst").alias(f"v{i}"))
        if any(r[3] is not None or r[4] is not None or r[5] for r in rows):
            out = out.join(small(checks.select("plan", "literal", "closes", "apart"), len(rows)), "plan").filter(_fits(i)).select("plan", *values, f"v{i}")
        frontier = out
    meets = lambda v: reduce(Column.__or__, [F.col(v) == F.col(f"v{j}") for j in range(1, n)], F.lit(False))
    bit = lambda v, b: F.when(F.coalesce(~meets(v), F.lit(False)), b).otherwise(0)
    # a side starts at a node, so that its start is not null
    obj = F.when(F.col("v0").isNotNull(), bit(f"v{n}", 1)).otherwise(0)
    sub = F.when(F.col(f"v{n}").isNotNull(), bit("v0", 2)).otherwise(0)
    last = [(p.number, p.steps[0]["target"], {"obj": 1, "sub": 2, "body": 0, "both": 3}[p.side]) for p in found]
    ends = local(spark, last, "plan int, target int, sides int")
    whole = frontier.join(small(ends, len(last)), "plan")
    end = F.coalesce(*[F.when(F.col("target") == j, F.col(f"v{j}")) for j in range(n + 1)])
    whole = whole.select("plan", F.col("v0").alias("start"), end.alias("end"), "sides", F.when(F.col("sides") == 3, obj + sub).otherwise(F.col("sides")).alias("ok"))
    return whole.filter("CASE WHEN sides = 3 THEN ok > 0 ELSE start IS NOT NULL END").drop("sides")


def ground(found: list[Plan], adj: DataFrame, starts: DataFrame | None = None, code: Callable = str, part: tuple[int, int] | None = None, tried: tuple[int, int] | None = None) -> DataFrame:
    """rule_id, side, start, end, ok of every complete grounding, once or more. starts: rule_id, side, start; without it,
    every node. code: what a constant is in the graph. All plans of one length are one chain of joins, whatever the number of rules."""
    table = local(adj.sparkSession, [p[:3] for p in found], "plan int, rule_id int, side string")
    out = []
    for n in sorted({len(p.steps) for p in found}):
        some = [p for p in found if len(p.steps) == n]
        out.append(_chain(some, n, adj, None if starts is None else starts.join(small(table.filter(F.col("plan").isin([p.number for p in some])), len(found)), ["rule_id", "side"]), code, part, tried))
    return reduce(DataFrame.unionByName, out).join(small(table, len(found)), "plan").select("rule_id", "side", "start", "end", "ok")


def groups(rules: DataFrame, steps: DataFrame, adj: DataFrame, codec: Codec, never: Callable[[Row, Row], bool] = lambda a, b: False) -> DataFrame:
    """rule_id, side, anchor, distinct, of all that have a candidate. Rules of which every step's value is checked by itself
    or against the one before are followed back from the last step by the nodes that still have a grounding, so that no pair
    is made; of the others the pairs are. never(a, b): whether steps a and b, of one rule, cannot reach the same value."""
    found, near = plans(steps, False), []
    for p in found:
        apart = [{j for j in r["apart"] if j == 0 or not never(p.steps[j - 1], r)} for r in p.steps]
        if all(r["src"] == i and r["closes"] is None and apart[i] <= {i} for i, r in enumerate(p.steps)):
            near.append((p, apart))
    code, spark, out = codec.code, adj.sparkSession, []
    kind = dict(adj.dtypes)["s"]
    for n in sorted({len(p.steps) for p, _ in near}):
        own, frontier = [x for x in near if len(x[0].steps) == n], None
        for i in range(n - 1, -1, -1):
            edges, hops = _hops(adj, [p.steps[i] for p, _ in own], code)
            rows = [(p.number, edges[_edge(r)], None if r["literal"] is None else code(r["literal"]), bool(apart[i]), bool(r["apart"])) for p, apart in own for r in [p.steps[i]]]
            at = small(local(spark, rows, f"plan int, on_edge int, literal {kind}, other boolean, whole boolean"), len(rows))
            if frontier is None:
                some = hops.join(at, hops["edge"] == at["on_edge"])
            else:
                some = frontier.join(at, "plan").join(hops, (F.col("node") == hops["dst"]) & (F.col("on_edge") == hops["edge"]))
            fits = (F.col("literal").isNull() | (F.col("dst") == F.col("literal"))) & (~F.col("other") | (F.col("dst") != F.col("src"))) & (~F.col("whole") | F.col("dst").isNotNull())
            frontier = some.filter(fits & F.col("src").isNotNull()).select("plan", F.col("src").alias("node")).distinct()
        out.append(frontier)
    plan = small(local(spark, [p[:3] for p in found], "plan int, rule_id int, side string"), len(found))
    empty = local(spark, [], f"rule_id int, side string, start {kind}")
    starts = reduce(DataFrame.unionByName, out).join(plan, "plan").select("rule_id", "side", F.col("node").alias("start")) if out else empty
    numbers = {p.number for p, _ in near}
    if far := [p for p in found if p.number not in numbers]:
        starts = starts.unionByName(ground(far, adj, None, code).select("rule_id", "side", "start"))
    return _asked_of(starts, rules, len(found), codec).distinct()


def _asked_of(starts: DataFrame, rules: DataFrame, n: int, codec: Codec) -> DataFrame:
    """rule_id, side, anchor of starts (rule_id, side, start): a body's start is asked for at the constant's side, and the
    constant at the other."""
    at_s = F.length("head_s") > 1
    constant, at, opposite = F.when(at_s, F.col("head_s")).otherwise(F.col("head_o")), F.when(at_s, F.lit("sub")).otherwise(F.lit("obj")), F.when(at_s, F.lit("obj")).otherwise(F.lit("sub"))
    unary = rules.filter("kind = 'unary'").select("rule_id", constant.alias("constant"), at.alias("at"), opposite.alias("opposite"))
    bodies = starts.filter("side = 'body'").join(small(codec.encode(unary, "constant"), n), "rule_id")
    plain = starts.filter("side <> 'body'").select("rule_id", "side", F.col("start").alias("anchor"))
    own = bodies.select("rule_id", F.col("at").alias("side"), F.col("start").alias("anchor"))
    return plain.unionByName(own).unionByName(bodies.select("rule_id", F.col("opposite").alias("side"), F.col("constant").alias("anchor")))


def first_groups(rules: DataFrame, steps: DataFrame, adj: DataFrame, codec: Codec) -> DataFrame:
    """rule_id, side, anchor of all groups that can have a candidate: their anchors have an edge for the first step."""
    found = plans(steps, False)
    if not found:
        return local(adj.sparkSession, [], f"rule_id int, side string, anchor {dict(adj.dtypes)['s']}")
    return _asked_of(first_nodes(found, adj).filter("start IS NOT NULL"), rules, len(found), codec).distinct()


def sides(pairs: DataFrame) -> DataFrame:
    """rule_id, side, anchor, candidate of pairs (rule_id, s, o, ok)."""
    side = lambda bit, name, anchor, candidate: F.struct(F.when(F.col("ok").bitwiseAND(F.lit(bit)) != 0, F.lit(name)).alias("side"), F.col(anchor).alias("anchor"), F.col(candidate).alias("candidate"))
    return pairs.select("rule_id", F.explode(F.array(side(1, "obj", "s", "o"), side(2, "sub", "o", "s"))).alias("x")).select("rule_id", "x.*").filter("side IS NOT NULL")


def candidates(rules: DataFrame, steps: DataFrame, adj: DataFrame, lengths: list[int], n_steps: int, asked: DataFrame | None = None, codec: Codec | None = None) -> DataFrame:
    """rule_id, side, anchor, candidate, distinct: what each rule predicts at side (obj or sub) for each anchor.

    asked: rule_id, side, anchor; without it, every anchor. Rules with a constant in the head: asked for the constant's
    side, an anchor that satisfies the body gets the constant; asked for the variable's side, the anchor must be the
    constant, and candidates are all nodes that satisfy the body. codec: that of the graph's names.
    """
    rows = sides(pairs(rules, steps, adj, lengths, n_steps, asked, codec))
    if asked is not None:  # a body is asked for at one side of the head
        rows = rows.join(asked, ["rule_id", "side", "anchor"], "left_semi")
    return rows.distinct()


def answers(rules: DataFrame, steps: DataFrame, adj: DataFrame, lengths: list[int], n_steps: int, asked: DataFrame, codec: Codec | None = None, tried: tuple[int, int] | None = None) -> DataFrame:
    """The rows of candidates() for what is asked, once or more: a group's rows can be made distinct where they are gathered.
    tried: only groundings whose last step reaches a value of this part (number, of how many)."""
    found, out = [p for p in plans(steps, False) if len(p.steps) in lengths], []
    if plain := [p for p in found if p.side != "body"]:
        rows = ground(plain, adj, asked.select("rule_id", "side", F.col("anchor").alias("start")), codec.code if codec else str, tried=tried)
        out.append(rows.select("rule_id", "side", F.col("start").alias("anchor"), F.col("end").alias("candidate")))
    if any(p.side == "body" for p in found):
        rows = sides(pairs(rules.filter("kind = 'unary'"), steps.filter("side = 'body'"), adj, lengths, n_steps, asked, codec))
        out.append(rows.join(asked, ["rule_id", "side", "anchor"], "left_semi"))
    kind = dict(adj.dtypes)["s"]
    return reduce(DataFrame.unionByName, out) if out else local(adj.sparkSession, [], f"rule_id int, side string, anchor {kind}, candidate {kind}")


def pairs(rules: DataFrame, steps: DataFrame, adj: DataFrame, lengths: list[int], n_steps: int, asked: DataFrame | None = None, codec: Codec | None = None, part: tuple[int, int] | None = None) -> DataFrame:
    """rule_id, s, o, ok of the head's ends in every grounding, once or more; ok: bit 1 if side obj has it, bit 2 if sub has.
    part: only those whose s is of this part (number, of how many)."""
    kinds = rules.select("rule_id", "kind", "head_s", "head_o")
    constant = F.when(F.length("head_s") > 1, F.col("head_s")).otherwise(F.col("head_o"))
    # the side at which the constant stands
    const_side = F.when(F.length("head_s") > 1, F.lit("sub")).otherwise(F.lit("obj"))
    unary = kinds.filter("kind = 'unary'").select("rule_id", constant.alias("constant"), const_side.alias("const_side"))
    unary = small(codec.encode(unary, "constant") if codec else unary, n_steps)
    found = [p for p in plans(steps, asked is None) if len(p.steps) in lengths]
    starts = None
    if not found:
        return local(adj.sparkSession, [], f"rule_id int, s {(kind := dict(adj.dtypes)['s'])}, o {kind}, ok int")
    if asked is not None:
        plain = small(kinds.filter("kind <> 'unary'").select("rule_id"), n_steps)
        starts = asked.join(plain, "rule_id", "left_semi").select("rule_id", "side", F.col("anchor").alias("start"))
        if any(p.side == "body" for p in found):
            with_constant = asked.join(unary, "rule_id")
            at_anchor = with_constant.filter("side = const_side").select("rule_id", F.lit("body").alias("side"), F.col("anchor").alias("start"))
            wanted = with_constant.filter("side <> const_side AND anchor = constant").select("rule_id").distinct()
            starts = starts.unionByName(at_anchor.unionByName(first_nodes([p for p in found if p.side == "body"], adj).join(wanted, "rule_id", "left_semi")).distinct())
    rows = ground(found, adj, starts, codec.code if codec else str, part)
    if any(p.side == "body" for p in found):
        rows = rows.join(unary, "rule_id", "left")
    else:
        rows = rows.withColumn("constant", F.lit(None).cast(dict(adj.dtypes)["s"])).withColumn("const_side", F.lit(None).cast("string"))
    body, at_obj = F.col("side") == "body", F.col("const_side") == "obj"
    # a satisfied body counts at both sides of the head
    s = F.when(body, F.when(at_obj, F.col("start")).otherwise(F.col("constant"))).when(F.col("side") == "sub", F.col("end")).otherwise(F.col("start"))
    o = F.when(body, F.when(at_obj, F.col("constant")).otherwise(F.col("start"))).when(F.col("side") == "sub", F.col("start")).otherwise(F.col("end"))
    rows = rows.select("rule_id", s.alias("s"), o.alias("o"), F.when(body, 3).otherwise(F.col("ok")).alias("ok"))
    return rows.filter(in_part("s", part)) if part else rows
