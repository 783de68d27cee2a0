"""Ordered rule lists by incremental reduced-error pruning, written out as SQL CASE expressions.

Each rule is a conjunction of thresholds. It is grown on two thirds of the rows still to be covered, condition by
condition, by information gain over all thresholds of all columns, of equal ones that in the widest gap; then conditions are dropped from its end for as long
as that does not lower (p - n) / (p + n) on the other third; what it covers leaves the rows. Growing ends when a rule is
wrong more often than right on the pruning rows.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

MODEL = Path(__file__).with_name("models") / "quality.json"


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, str, float]]:
    rule, on = [], np.ones(len(y), bool)
    while (~y[on]).any() and y[on].any() and len(rule) < 4:
        p0 = y[on].mean()
        best = (1e-9, None)
        for j in range(x.shape[1]):
            v = x[on, j]
            order = np.argsort(v, kind="stable")
            v, t = v[order], y[on][order]
            pos = np.cumsum(t)
            n = np.arange(1, len(v) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            for op, p, m in (("<=", pos[cut], n[cut]), (">", pos[-1] - pos[cut], len(v) - n[cut])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / m) - np.log2(p0)), 0)
                gain = gain + 1e-6 * (v[cut + 1] - v[cut]) / (v[-1] - v[0])  # of equal cuts the widest gap
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        j, op, c = best[1]
        on &= (x[:, j] <= c) if op == "<=" else (x[:, j] > c)
    return rule


def covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, op, c in rule:
        on &= (x[:, j] <= c) if op == "<=" else (x[:, j] > c)
    return on


def induce(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[list[tuple[int, str, float]]]:
    """Rules for the rows with ``y``, in order."""
    rng = np.random.default_rng(seed)
    rules, left = [], np.ones(len(y), bool)
    while y[left].sum() >= 5 and len(rules) < 12:
        at = rng.permutation(np.flatnonzero(left))
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        rule = _grow(x[grow], y[grow])

        def worth(r):
            on = covers(r, x[prune])
            p, n = (y[prune] & on).sum(), (~y[prune] & on).sum()
            return (p - n) / max(p + n, 1) if r else -1

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) <= 0:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def to_sql(rules: list[list[list]], names: list[str]) -> str:
    """CASE expression: the number of the first rule that holds, 0 if none does."""
    when = " ".join(
        f"WHEN {' AND '.join(f'{names[j]} {op} {c!r}D' for j, op, c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)
    )
    return f"CASE {when} ELSE 0 END" if rules else "0"


def load() -> list[list[tuple[int, str, float]]]:
    return json.loads(MODEL.read_text())["rules"]


def case(prefix: str = "") -> str:
    """The kept rules of problem 5 as a CASE expression over columns of ``pages.STATS``."""
    m = json.loads(MODEL.read_text())
    return to_sql(m["rules"], [prefix + n for n in m["names"]])
