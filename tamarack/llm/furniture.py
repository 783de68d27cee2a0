"""Problem 3: main body of a page, by a linear-chain conditional random field over its lines.

The method names DOM leaf blocks; a WETDocument has only text, in which every leaf block is one line, so the chain runs
over the lines that are not blank. Three labels (content, furniture, sidebar) let the chain tell a title under a menu
from the same words under a "most read" heading. Features: hashed words and word pairs, shape, place in the page, and
the shape of the neighbours; tags are not in the data. Training: labelled pages, gradient by forward-backward, Adam;
decoding: Viterbi, all pages of a batch side by side.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

from tamarack.llm.arrays import TextBatch, mapped
from tamarack.llm.lines import BITS, Lines

LABELS = 3
MODEL = Path(__file__).with_name("models") / "furniture.npz"


def emissions(weights: np.ndarray, lines: Lines) -> np.ndarray:
    where, ids, weight = lines.features
    out = np.empty((lines.n, LABELS))
    for k in range(LABELS):
        out[:, k] = np.bincount(where, weights[ids, k] * weight, lines.n)
    return out


def _grid(lines: Lines) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents in groups of like length: (first lines, lengths), so that padding stays below half."""
    first = np.flatnonzero(lines.rank == 0)
    size = lines.back[first] + 1
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], [2**k for k in range(1, 24)])
    return [(first[g], size[g]) for g in np.split(order, cuts) if len(g)]


def viterbi(em: np.ndarray, trans: np.ndarray, lines: Lines) -> np.ndarray:
    """The best label for each line."""
    out = np.zeros(lines.n, np.int8)
    for first, size in _grid(lines):
        top, n = int(size.max()), len(first)
        score = em[first].copy()
        back = np.zeros((top, n, LABELS), np.int8)
        back[:] = np.arange(LABELS)
        for t in range(1, top):
            live = t < size
            step = score[:, :, None] + trans
            best = step.argmax(1)
            new = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + em[np.where(live, first + t, first)]
            score = np.where(live[:, None], new, score)
            back[t][live] = best[live]
        lab = score.argmax(1)
        for t in range(top - 1, -1, -1):
            live = t < size
            out[(first + t)[live]] = lab[live]
            lab = np.where(live, back[t][np.arange(n), lab], lab)
    return out


def _marginals(em: np.ndarray, trans: np.ndarray, lines: Lines, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, and its gradient by emission and transition."""
    lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
    ge, gt, ll = np.zeros_like(em), np.zeros_like(trans), 0.0
    for first, size in _grid(lines):
        top, n = int(size.max()), len(first)
        al = np.zeros((top, n, LABELS))
        be = np.zeros((top, n, LABELS))
        al[0] = em[first]
        at = [np.where(t < size, first + t, first) for t in range(top)]
        for t in range(1, top):
            new = lse(al[t - 1][:, :, None] + trans, 1) + em[at[t]]
            al[t] = np.where((t < size)[:, None], new, al[t - 1])
        z = lse(al[top - 1], 1)
        for t in range(top - 2, -1, -1):
            new = lse(trans + (em[at[t + 1]] + be[t + 1])[:, None, :], 2)
            be[t] = np.where((t + 1 < size)[:, None], new, 0)
        for t in range(top):
            live = t < size
            ge[at[t][live]] -= np.exp(al[t] + be[t] - z[:, None])[live]
            if t:
                p = np.exp(al[t - 1][:, :, None] + trans + (em[at[t]] + be[t])[:, None, :] - z[:, None, None])
                gt -= p[live].sum(0)
                y0, y1 = gold[at[t][live] - 1], gold[at[t][live]]
                np.add.at(gt, (y0, y1), 1)
                ll += trans[y0, y1].sum()
        ll -= z.sum()
    ge[np.arange(lines.n), gold] += 1
    return ll + em[np.arange(lines.n), gold].sum(), ge, gt


def train(
    texts: list[str], labels: list[list[int]], epochs: int = 6, batch: int = 64, rate: float = 0.03, l2: float = 1e-5, seed: int = 7, mute: float = 0.3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the transitions, from pages and a label for each of their lines.

    In every step the words of a share ``mute`` of the lines are not shown, so that shape, place and neighbours must carry
    what they can: the words of a line on another site may be new.
    """
    rng = np.random.default_rng(seed)
    par = [np.zeros((1 << BITS, LABELS)), np.zeros((LABELS, LABELS))]
    m, v, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(texts), batch):
            pick = order[a : a + batch]
            lines = Lines(TextBatch([texts[i] for i in pick]))
            gold = np.array([labels[pick[d]][k] for d, k in zip(lines.doc, lines.no)])
            where, ids, weight = lines.features
            quiet = rng.random(lines.n) < mute
            weight *= ~(quiet[where] & (np.arange(len(where)) >= lines.dense_rows))
            _, ge, gt = _marginals(emissions(par[0], lines), par[1], lines, gold)
            g = np.stack([np.bincount(ids, ge[where, k] * weight, 1 << BITS) for k in range(LABELS)], 1)
            step += 1
            for p, d, mi, vi in zip(par, (g / len(pick) - l2 * par[0], gt / len(pick)), m, v):
                mi += 0.1 * (d - mi)
                vi += 0.01 * (d * d - vi)
                p += rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return par[0], par[1]


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    with np.load(MODEL) as z:
        return z["weights"].astype(np.float64), z["transitions"].astype(np.float64)


def decode(lines: Lines) -> np.ndarray:
    """Label of each line of a batch: 0 content, 1 furniture, 2 sidebar."""
    weights, trans = model()
    return viterbi(emissions(weights, lines), trans, lines)


def furniture_lines(df, key: str = "rec_id", text: str = "text"):
    """(key, line_no) of every line that is not blank and does not belong to the page's main body.

    Null and empty texts have no lines. Rows with equal keys are handled one by one; the columns of ``df`` other than
    key and text are not read.
    """

    def make(batch, kept):
        lines = Lines(batch)
        hit = np.flatnonzero(decode(lines) > 0)
        return [kept[0].take(lines.doc[hit]), lines.no[hit]]

    return mapped(df, text, [key], f"{key} bigint, line_no int", make)
