"""Functions on class-probability vectors.

Vectors are ``array<double>`` columns over a known number of classes, so every function
is unrolled over the classes and stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.functions.exprs import clip, total, weighted

# Clipping bounds by caller (fixed values).
METRIC_BOUNDS = (1e-15, 1 - 1e-15)
SAVE_BOUNDS = (1e-7, 1.0)
ANSWER_BOUNDS = (1e-6, 1.0)
BLEND_BOUNDS = (1e-15, None)

# Parameter bounds of the decision rules (fixed values).
BIAS_BOUND = (-1.0, 1.0)
EQUAL_RECALL_BOUND = (-1.5, 1.5)
SCALE_BOUND, SHIFT_BOUND = (0.2, 3.0), (-2.0, 2.0)
TEMPERATURE_BOUND = (0.3, 5.0)


def parts(p: Column | str, k: int) -> list[Column]:
    p = F.col(p) if isinstance(p, str) else p
    return [p.getItem(i) for i in range(k)]


def normalize_parts(cols: Sequence[Column], bounds=METRIC_BOUNDS) -> list[Column]:
    clipped = [clip(c, *bounds) for c in cols]
    s = total(clipped)
    return [c / s for c in clipped]


def normalize_proba(p: Column | str, k: int, bounds=METRIC_BOUNDS) -> Column:
    """Clip every entry to ``bounds``, then divide by the row sum."""
    return F.array(*normalize_parts(parts(p, k), bounds))


def log_proba(p: Column | str, k: int, bounds=METRIC_BOUNDS) -> Column:
    return F.array(*[F.ln(clip(c, *bounds)) for c in parts(p, k)])


def logit_parts(cols: Sequence[Column], floor: float = 1e-7, limit: float = 30.0) -> list[Column]:
    out = []
    for c in cols:
        c = clip(c, floor, 1 - floor)
        out.append(clip(F.ln(c / (1 - c)), -limit, limit))
    return out


def logit(p: Column | str, k: int, floor: float = 1e-7, limit: float = 30.0) -> Column:
    return F.array(*logit_parts(parts(p, k), floor, limit))


def argmax_of(scores: Sequence[Column]) -> Column:
    """Position of the largest score, the lowest position on ties; null if all are null."""
    if len(scores) == 1:
        return F.when(scores[0].isNotNull(), 0)
    top = F.greatest(*scores)
    pick = F.when(scores[0] == top, 0)
    for i, s in enumerate(scores[1:], start=1):
        pick = pick.when(s == top, i)
    return pick


def argmax(p: Column | str, k: int) -> Column:
    return argmax_of(parts(p, k))


@dataclass(frozen=True)
class Rule:
    """A decision rule: class scores that are linear in the log probabilities, then the arg max.

    ``bounds(k)``: the range of each parameter, which a search draws from; ``start(k)``: parameters
    that leave the arg max unchanged; ``linear(params, k)``: rows ``weights[class][log p]`` and
    ``bias[class]``, which score many candidates in one job; ``columns(logs, params)``: the same scores
    as expressions, from ``linear`` if not given; ``text(params)``: one line for a report; ``judge``:
    ``balanced`` or ``equal_recall``, what a search raises.
    """

    name: str
    bounds: Callable[[int], list[tuple[float, float]]]
    start: Callable[[int], list[float]]
    linear: Callable[[Sequence[float], int], tuple[Sequence[Sequence[float]], Sequence[float]]]
    columns: Callable[[Sequence[Column], Sequence[float]], list[Column]] | None = None
    text: Callable[[Sequence[float]], str] | None = None
    judge: str = "balanced"

    def scores(self, logs: Sequence[Column], params: Sequence[float]) -> list[Column]:
        params = [float(x) for x in params]
        if self.columns:
            return self.columns(logs, params)
        return [weighted(logs, w, b) for w, b in zip(*self.linear(params, len(logs)))]

    def describe(self, params: Sequence[float]) -> str:
        if self.text:
            return self.text(params)
        return f"{self.name}(" + ", ".join(f"{x:g}" for x in params) + ")"


def diagonal(scale: Sequence[float]) -> tuple[tuple[float, ...], ...]:
    """Weights of a rule in which each class reads its own log probability only."""
    return tuple(tuple(a if i == c else 0.0 for i in range(len(scale))) for c, a in enumerate(scale))


def _shifted(name: str, bound: tuple[float, float], judge: str) -> Rule:
    """``ln p + b``."""
    return Rule(
        name, lambda k: [bound] * k, lambda k: [0.0] * k, lambda v, k: (diagonal([1.0] * k), tuple(v)),
        lambda logs, v: [lp + F.lit(b) for lp, b in zip(logs, v)], judge=judge,
    )


#: Rules that go by a name; ``add_rule`` adds more, and a ``Rule`` can be given wherever a name can.
RULES: dict[str, Rule] = {
    rule.name: rule
    for rule in (
        _shifted("bias", BIAS_BOUND, "balanced"),
        # ``a*ln p + b`` with parameters a, then b.
        Rule(
            "scale_shift", lambda k: [SCALE_BOUND] * k + [SHIFT_BOUND] * k, lambda k: [1.0] * k + [0.0] * k,
            lambda v, k: (diagonal(v[:k]), tuple(v[k:])),
            lambda logs, v: [F.lit(a) * lp + F.lit(b) for lp, a, b in zip(logs, v, v[len(logs):])],
        ),
        # ``ln p / T + b`` with T first.
        Rule(
            "temperature", lambda k: [TEMPERATURE_BOUND] + [SHIFT_BOUND] * k, lambda k: [1.0] + [0.0] * k,
            lambda v, k: (diagonal([1.0 / v[0]] * k), tuple(v[1:])),
            lambda logs, v: [lp / F.lit(v[0]) + F.lit(b) for lp, b in zip(logs, v[1:])],
        ),
        _shifted("equal_recall", EQUAL_RECALL_BOUND, "equal_recall"),
    )
}


def add_rule(rule: Rule) -> Rule:
    """Let ``rule`` go by its name. A name is given once."""
    if rule.name in RULES:
        raise ValueError(f"there is a rule {rule.name!r} already")
    RULES[rule.name] = rule
    return rule


def rule_of(rule: Rule | str) -> Rule:
    if isinstance(rule, Rule):
        return rule
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; choose from {tuple(RULES)}")
    return RULES[rule]


def rule_scores(log_parts: Sequence[Column], rule: Rule | str, params: Sequence[float]) -> list[Column]:
    """Class scores of a decision rule on log probabilities."""
    return rule_of(rule).scores(log_parts, params)


def apply_rule(p: Column | str, k: int, rule: Rule | str, params: Sequence[float]) -> Column:
    logs = [F.ln(clip(c, *METRIC_BOUNDS)) for c in parts(p, k)]
    return argmax_of(rule_scores(logs, rule, params))


def ovr_combine(binary: Sequence[Column], bounds=SAVE_BOUNDS) -> Column:
    """One-vs-rest probabilities to one normalized vector."""
    return F.array(*normalize_parts(binary, bounds))


def cascade_compose(
    p_first: Column, p_second: Column, first: int, a: int, b: int, bounds=SAVE_BOUNDS
) -> Column:
    """``first`` against the rest, then ``a`` against ``b`` inside the rest."""
    slots = {first: p_first, a: (1 - p_first) * p_second, b: (1 - p_first) * (1 - p_second)}
    return F.array(*normalize_parts([slots[i] for i in range(3)], bounds))
