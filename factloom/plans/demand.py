"""Recursive rules that are asked about given arguments: a rewrite that computes only what the question can reach.

A call binds some places of its rule. From the rule's definitions come, for each such set of places, a copy
of the rule that first joins the arguments asked for, and a rule of these demands: those of the call, and
those that a definition passes on to the calls in it, by way of the clauses that connect them. Both are
ordinary rules for the fixpoint. Demands may be too many, never too few, so the answers stay the same.
"""

from __future__ import annotations

from typing import Any

from factloom.plans.parse import BLANK, Const, Function, Not, Or, Pattern, Predicate, Rule, RuleCall, Var, all_vars, bound_vars, needed_vars


def calls(rules: dict[str, list[Rule]], name: str) -> set[tuple[str, bool]]:
    """(rule, negated) for each rule that the definitions of name call."""
    return set().union(*(_called(c, False) for r in rules.get(name, []) for c in r.clauses))


def _called(c: Any, negated: bool) -> set[tuple[str, bool]]:
    if isinstance(c, RuleCall):
        return {(c.name, negated)}
    if isinstance(c, Not):
        return set().union(*(_called(x, True) for x in c.clauses))
    if isinstance(c, Or):
        return set().union(*(_called(x, negated) for b in c.branches for x in b))
    return set()


def reach(rules: dict[str, list[Rule]], name: str) -> set[str]:
    """The rules that name calls, directly or not."""
    seen, todo = set(), [name]
    while todo:
        for other, _ in calls(rules, todo.pop()):
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return seen


def recurring(rules: dict[str, list[Rule]], name: str) -> set[str]:
    """name and the rules that recur with it."""
    return {n for n in reach(rules, name) if name in reach(rules, n)} | {name}


def askable(t: Any, known: set[str]) -> bool:
    """Whether an argument is given: a scalar constant, or a variable that has a value."""
    return isinstance(t.value, (bool, int, float, str)) if isinstance(t, Const) else t != BLANK and t.name in known


def adorned(rules: dict[str, list[Rule]], name: str, given: tuple[bool, ...], seed: str) -> tuple[dict[str, list[Rule]], str] | None:
    """The rules with those for demands, and the name of the one that answers; seed is a relation of the given arguments.

    None where nothing would be narrowed: when a call of the recursion, or one within or or not, has no argument given.
    """
    group = recurring(rules, name)
    out, todo, done = dict(rules), [(name, given)], set()
    start = [f"?{k}" for k in range(sum(given))]
    out[seed] = [Rule(seed, [], start, [])]
    out[_label(name, given) + "?"] = [Rule(_label(name, given) + "?", [], start, [RuleCall(seed, list(map(Var, start)))])]
    while todo:
        n, places = todo.pop()
        if (n, places) in done:
            continue
        if not any(places):
            return None
        done.add((n, places))
        label = _label(n, places)
        out[label] = []
        for rule in rules[n]:
            head = rule.required + rule.free
            asked = [h for h, x in zip(head, places) if x]
            demand = RuleCall(label + "?", list(map(Var, asked)))
            known, passed = _connected(rules, group, rule, set(asked))
            body: list[Any] = [demand]
            for c in rule.clauses:
                if not {x for x, _ in _called(c, False)} & group:
                    body.append(c)
                    continue
                if not isinstance(c, RuleCall) or c.source != "$":
                    return None
                to = tuple(askable(t, known) for t in c.args)
                args = [t for t, x in zip(c.args, to) if x]
                if len({t.name for t in args if isinstance(t, Var)}) < sum(isinstance(t, Var) for t in args):
                    return None
                todo.append((c.name, to))
                body.append(RuleCall(_label(c.name, to), c.args))
                more = RuleCall(_label(c.name, to) + "?", args)
                if more != demand:
                    names = [t.name if isinstance(t, Var) else f"?{k}~given" for k, t in enumerate(args)]
                    grounds = [Function("ground", [t], ("scalar", Var(x))) for t, x in zip(args, names) if isinstance(t, Const)]
                    out.setdefault(more.name, []).append(Rule(more.name, [], names, [demand, *passed, *grounds]))
            out[label].append(Rule(label, [], head, body))
    return out, _label(name, given)


def _label(name: str, places: tuple[bool, ...]) -> str:
    return f"{name}@{''.join('b' if x else 'f' for x in places)}"


def _connected(rules: dict[str, list[Rule]], group: set[str], rule: Rule, known: set[str]) -> tuple[set[str], list[Any]]:
    """What a definition knows once known is given, and the clauses outside the recursion by which it does."""
    left, passed = list(rule.clauses), []
    while True:
        for c in left:
            if isinstance(c, Pattern):
                ready = bool(all_vars(c) & known)
            elif isinstance(c, (Predicate, Function)):
                ready = needed_vars(c) <= known
            elif isinstance(c, RuleCall) and c.name not in group:
                needs = {t.name for t in c.args[: len(rules[c.name][0].required)] if isinstance(t, Var)}
                ready = bool(all_vars(c) & known) and needs <= known
            else:
                ready = False
            if ready:
                break
        else:
            return known, passed
        left = [x for x in left if x is not c]
        passed.append(c)
        known = known | bound_vars(c)
