"""Problem 7: language of each position by a bidirectional gated recurrent network over bytes.

A step reads four bytes (their embeddings side by side) and so labels four positions. A line is read in blocks of 64 steps,
each from a fresh state, so whole texts of any length are read and all blocks run side by side. A line's probabilities are
the mean over its positions, a record's the mean over its content. The network is trained here, in numpy, by
backpropagation through time; at run time only the forward pass is needed.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import furniture, pages
from tamarack.llm.arrays import mapped, running
from tamarack.llm.lines import Lines

LANGS = ["de", "en", "es", "fr", "pt", "und"]
"""The last stands for every other language; it is trained on text whose letters are changed for others."""
OTHER = len(LANGS) - 1
HIDDEN, STRIDE, STEPS, DIM = 16, 4, 64, 8
MODEL = Path(__file__).with_name("models") / "language.npz"
FOREIGN_LETTERS = 40
SEGMENT_STEPS, SEGMENT_GAIN = 10, 25.0
"""A stretch within a line is in another language if it has so many steps and gains so many nats over the main one."""
OWN_SHARE = 0.25
"""A line with more of its positions in the record's main language is not wholly in another one."""


def blocks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each block (n, STEPS, STRIDE), zero-padded, its number of steps, and the span it belongs to."""
    size = STEPS * STRIDE
    n = np.maximum(1, -(-(ends - starts) // size))
    span = np.repeat(np.arange(len(starts)), n)
    first = starts[span] + (np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)) * size
    length = np.minimum(ends[span] - first, size)
    at = first[:, None] + np.arange(size)
    x = np.where(np.arange(size) < length[:, None], raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else 0, 0)
    return x.reshape(-1, STEPS, STRIDE).astype(np.uint8), np.maximum(1, -(-length // STRIDE)), span


def _init(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.5, (256, DIM)), "w": r.normal(0, 0.2, (2 * HIDDEN, len(LANGS))), "o": np.zeros(len(LANGS))}
    for d in "fb":
        p[f"x{d}"] = r.normal(0, 1 / np.sqrt(STRIDE * DIM), (STRIDE * DIM, 3 * HIDDEN))
        p[f"u{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
        p[f"c{d}"] = np.zeros(3 * HIDDEN)
    return p


def _states(p: dict, d: str, x: np.ndarray, steps: np.ndarray):
    """States of one direction for blocks sorted by falling length, with what backpropagation needs; for training."""
    T, n = x.shape[:2]
    H = HIDDEN
    h, out, trace = np.zeros((n, H)), np.zeros((T, n, H)), []
    gx = x @ p[f"x{d}"] + p[f"c{d}"]
    for t in range(T) if d == "f" else range(T - 1, -1, -1):
        m = int((steps > t).sum())
        if not m:
            continue
        g, h0 = gx[t, :m], h[:m].copy()
        hu = h0 @ p[f"u{d}"]
        zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * H] + hu[:, : 2 * H])) + 0.5
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
        h[:m] = h0 + z * (c - h0)
        out[t, :m] = h[:m]
        trace.append((t, m, h0, hu[:, 2 * H :], z, r, c))
    return out, trace


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def changed_letters(text: str, rng) -> str:
    """Text of no language of the list: letters changed for others of their kind, or for those of another script."""
    kinds = ["aeiouyäöüáéíóúàèêâôûãõ", "bcdfghjklmnpqrstvwxzñçß"]
    if rng.random() < 0.25:
        low = int(rng.choice([0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x4E00, 0xAC00, 0x3042]))
        letters = [chr(low + int(k)) for k in rng.integers(0, 24, 64)]
        return "".join(letters[ord(c) % 64] if c.isalpha() else c for c in text)
    table = {}
    for kind in kinds:
        for c, k in zip(kind, rng.permutation(len(kind))):
            table[ord(c)] = kind[k]
            if len(c.upper()) == 1:
                table[ord(c.upper())] = kind[k].upper()
    return text.translate(table)


def train(raw_lines: list[bytes], labels: np.ndarray, updates: int = 2500, batch: int = 192, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters from lines and their languages: cross-entropy at every step, Adam, backpropagation through time."""
    rng = np.random.default_rng(seed)
    p = _init(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    H = HIDDEN
    for step in range(1, updates + 1):
        pick = rng.integers(0, len(raw_lines), batch)
        # A random stretch, so that no word is learnt with its place in the line.
        rows = []
        for i in pick:
            b = raw_lines[i]
            a = int(rng.integers(0, max(1, len(b) - 40)))
            rows.append(b[a : a + int(rng.integers(40, 161))])
        ends = np.cumsum([len(b) for b in rows])
        raw, steps, _ = blocks(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(-steps, kind="stable")
        steps, y = steps[order], labels[pick][order]
        raw = raw[order, : steps[0]].transpose(1, 0, 2)
        T = raw.shape[0]
        x = p["e"][raw].reshape(T, batch, -1)
        hf, tf = _states(p, "f", x, steps)
        hb, tb = _states(p, "b", x, steps)
        hh = np.concatenate([hf, hb], 2)
        d = _softmax(hh @ p["w"] + p["o"])
        on = np.arange(T)[:, None] < steps
        d[:, np.arange(batch), y] -= 1
        d *= on[:, :, None] / on.sum()
        g = {"w": np.einsum("tni,tnj->ij", hh, d), "o": d.sum((0, 1))}
        dh_all = d @ p["w"].T
        dx = np.zeros_like(x)
        for name, trace, part in (("f", tf, dh_all[:, :, :H]), ("b", tb, dh_all[:, :, H:])):
            gu, gg = np.zeros_like(p[f"u{name}"]), np.zeros((T, batch, 3 * H))
            dh = np.zeros((batch, H))
            for t, k, h0, huc, z, r, c in reversed(trace):
                cur = dh[:k] + part[t, :k]
                dz, dc = cur * (c - h0) * z * (1 - z), cur * z * (1 - c * c)
                dr = dc * huc * r * (1 - r)
                gg[t, :k] = np.concatenate([dz, dr, dc], 1)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                gu += h0.T @ dhu
                dh[:k] = cur * (1 - z) + dhu @ p[f"u{name}"].T
            g[f"u{name}"], g[f"c{name}"] = gu, gg.sum((0, 1))
            g[f"x{name}"] = np.einsum("tni,tnj->ij", x, gg)
            dx += gg @ p[f"x{name}"].T
        onehot = np.zeros((256, raw.size))
        onehot[raw.ravel(), np.arange(raw.size)] = 1
        g["e"] = onehot @ dx.reshape(-1, DIM)
        norm = np.sqrt(sum((a * a).sum() for a in g.values()))
        for k, a in g.items():
            a = a * min(1, 1 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.001 * (a * a - v[k])
            p[k] -= rate * (1 - step / updates * 0.95) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


@lru_cache(1)
def model() -> dict[str, np.ndarray]:
    with np.load(MODEL) as z:
        return {k: np.ascontiguousarray(z[k].astype(np.float32)) for k in z.files}


def _scores(p: dict, d: str, x: np.ndarray, steps: np.ndarray, out: np.ndarray) -> None:
    """Adds one direction's class scores to out (STEPS, languages, n). All arrays run along the blocks, so that every
    operation is over neighbouring numbers; x is (STEPS, n, STRIDE * DIM)."""
    T, n = x.shape[:2]
    H = HIDDEN
    h = np.zeros((H, n), np.float32)
    w = np.ascontiguousarray((p["w"][:H] if d == "f" else p["w"][H:]).T)
    wx, u, c0 = p[f"x{d}"].T, np.ascontiguousarray(p[f"u{d}"].T), p[f"c{d}"][:, None]
    live = np.searchsorted(-steps, -np.arange(T), "left")
    for t in range(T) if d == "f" else range(T - 1, -1, -1):
        m = int(live[t])
        if not m:
            continue
        g = wx @ x[t, :m].T
        g += c0
        hu = u @ h[:, :m]
        zr = g[: 2 * H]
        zr += hu[: 2 * H]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = hu[2 * H :]
        c *= zr[H:]
        c += g[2 * H :]
        np.tanh(c, out=c)
        c -= h[:, :m]
        c *= zr[:H]
        h[:, :m] += c
        out[t, :, :m] += w @ h[:, :m]


def label_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: int = 1024, each: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each span of bytes: summed language probabilities, and how many positions each language wins.

    If ``each`` is a list, it gets for every span the probabilities of each of its steps.
    """
    p = model()
    total = np.zeros((len(starts), len(LANGS)))
    wins = np.zeros((len(starts), len(LANGS)))
    if not len(starts):
        return total, wins
    x, steps, span = blocks(raw, starts, ends)
    kept = np.zeros((len(span), STEPS, len(LANGS)), np.float32) if each is not None else None
    order = np.argsort(-steps, kind="stable")
    for a in range(0, len(order), group):
        o = order[a : a + group]
        top = int(steps[o[0]])
        xi = p["e"].take(x[o, :top].transpose(1, 0, 2), 0).reshape(top, len(o), -1)
        score = np.zeros((top, len(LANGS), len(o)), np.float32)
        score += p["o"][:, None]
        _scores(p, "f", xi, steps[o], score)
        _scores(p, "b", xi, steps[o], score)
        score -= score.max(1, keepdims=True)
        on = (np.arange(top)[:, None] < steps[o])[:, None, :]
        best = ((score == 0) & on).sum(0)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        score *= on
        np.add.at(total, span[o], score.sum(0).T)
        np.add.at(wins, span[o], best.T)
        if kept is not None:
            kept[o, :top] = score.transpose(2, 0, 1)
    if kept is not None:
        cut = np.searchsorted(span, np.arange(len(starts) + 1))
        each += [np.concatenate([kept[b, : steps[b]] for b in range(i, j)]) for i, j in zip(cut, cut[1:])]
    return total, wins


def stretches(prob: np.ndarray, main: int) -> list[tuple[int, int, int, float]]:
    """(first step, end, language, mean probability) of the stretches of a line in another language than ``main``.

    The other language with most probability is held against the main one, step by step; a stretch is a run of steps of
    greatest sum, as the gains and losses before and after it do not pay.
    """
    other = prob.sum(0)
    other[[main, OTHER]] = -1
    lang = int(other.argmax())
    gain = np.clip(np.log(prob[:, lang] + 1e-6) - np.log(prob[:, main] + 1e-6), -4, 4)
    out, low, start, best = [], 0.0, 0, (0.0, 0)
    run = 0.0
    for i, g in enumerate(gain.tolist()):
        run += g
        if run - low > best[0]:
            best = (run - low, i + 1)
        if run <= low or best[0] - (run - low) > SEGMENT_GAIN / 2:
            if best[0] >= SEGMENT_GAIN and best[1] - start >= SEGMENT_STEPS:
                out.append((start, best[1], lang, float(prob[start : best[1], lang].mean())))
            low, start, best = run, i + 1, (0.0, 0)
    if best[0] >= SEGMENT_GAIN and best[1] - start >= SEGMENT_STEPS:
        out.append((start, best[1], lang, float(prob[start : best[1], lang].mean())))
    return out


def utf8_offsets(lines: Lines, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch as UTF-8, and the bytes of the picked lines."""
    cp = lines.b.cp
    at = running(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
    raw = np.frombuffer(lines.b.text.encode("utf-8", "surrogatepass"), np.uint8)
    return raw, at[lines.s[pick]], at[lines.e[pick]]


_LINE = "line_no:int,lang:string,confidence:double"
SCHEMA = f"rec_id bigint, label string, prose boolean, lang string, confidence double, foreign_lines array<struct<{_LINE}>>, segments array<struct<{_LINE},start:int,end:int>>"


def _in_line(line: str, raw: bytes, a: int, z: int) -> tuple[int, int]:
    """Characters of a line that bytes a to z lie in, widened to whole words."""
    s, e = (len(raw[:k].decode("utf-8", "ignore")) for k in (a, z))
    while s > 0 and line[s - 1].isalnum() and line[s : s + 1].isalnum():
        s -= 1
    while e < len(line) and line[e].isalnum() and line[e - 1].isalnum():
        e += 1
    return s, e


def _structs(counts: np.ndarray, columns: list, names: list[str]):
    import pyarrow as pa

    st = pa.StructArray.from_arrays(columns, names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), st)


def languages(df: DataFrame) -> DataFrame:
    """(rec_id, label, prose, lang, confidence, foreign_lines, segments) of each record with a text that is not blank.

    The main language is read from the content lines, or from all lines if there is no content; it is "und" where no
    language of the list fits. ``foreign_lines`` are content lines wholly in another one, ``segments`` stretches of SEGMENT_STEPS
    steps or more within content lines, by characters. ``label`` is the delivered label as it stands, ``prose`` the verdict of problem 5.
    Null, empty and blank texts have no row.
    """

    def make(b, kept):
        import pyarrow as pa

        lines = Lines(b)
        content = furniture.decode(lines) == 0
        prose = pages.prosaic(pages.stats(lines, content))
        has = np.bincount(lines.doc[content], minlength=b.n) > 0
        pick = np.flatnonzero(content | ~has[lines.doc])
        raw, s, e = utf8_offsets(lines, pick)
        total, wins = label_spans(raw, s, e)
        doc = lines.doc[pick]
        pooled = np.zeros((b.n, len(LANGS)))
        np.add.at(pooled, doc, total)
        all_ = pooled.sum(1)
        main = pooled.argmax(1)
        sure = pooled.max(1) / np.maximum(all_, 1e-9)
        own = wins[np.arange(len(pick)), main[doc]] / np.maximum(wins.sum(1), 1)
        best = total.argmax(1)
        foreign = (best != main[doc]) & (best != OTHER) & content[pick] & (lines.letters[pick] >= FOREIGN_LETTERS) & (own <= OWN_SHARE)
        f = np.flatnonzero(foreign)
        at = np.flatnonzero((all_ > 0) & ~b.null)
        row = np.full(b.n, -1)
        row[at] = np.arange(len(at))
        names = np.array(LANGS, object)
        score = total[f, best[f]] / np.maximum(total[f].sum(1), 1e-9)
        whole = _structs(np.bincount(row[doc[f]], minlength=len(at)), [pa.array(lines.no[pick[f]], pa.int32()), pa.array(names[best[f]], pa.string()), pa.array(score)], ["line_no", "lang", "confidence"])
        # Lines of which some other language holds a stretch, but not the whole.
        rest = wins[:, :OTHER].copy()
        mixed = np.flatnonzero(main[doc] != OTHER)
        rest[mixed, main[doc[mixed]]] = 0
        mixed = np.flatnonzero((rest.max(1, initial=0) >= SEGMENT_STEPS) & (main[doc] != OTHER) & content[pick] & ~foreign)
        each: list[np.ndarray] = []
        label_spans(raw, s[mixed], e[mixed], each=each)
        seg: list[tuple] = []
        for i, prob in zip(mixed.tolist(), each):
            j = pick[i]
            line, held = b.text[lines.s[j] : lines.e[j]], raw[s[i] : e[i]].tobytes()
            for x, y, lang, p in stretches(prob, int(main[doc[i]])):
                seg.append((int(row[doc[i]]), int(lines.no[j]), LANGS[lang], p, *_in_line(line, held, x * STRIDE, min(y * STRIDE, len(held)))))
        per = np.bincount(np.array([q[0] for q in seg], np.int64), minlength=len(at))
        cols = [pa.array([q[k] for q in seg], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32()))]
        parts = _structs(per, cols, ["line_no", "lang", "confidence", "start", "end"])
        take = pa.array(at)
        return [kept[0].take(take), kept[1].take(take), prose[at], names[main[at]], sure[at], whole, parts]

    return mapped(df, "text", ["rec_id", "lang"], SCHEMA, make)


#: Codes of three letters and what they name. Fixed values.
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl", "ita": "it"}


def named(label: Column) -> Column:
    """The two-letter code that a label names; null if it is null, empty or says unknown."""
    code = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    three = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    return F.when(code.isin("", "und", "unk", "mis", "mul", "zxx"), F.lit(None)).otherwise(F.coalesce(three[code], code))


def wrong_labels(df: DataFrame, meta: DataFrame, codes: DataFrame) -> DataFrame:
    """(rec_id, label_field, line_no, lang): records whose delivered label or stored lang_id is missing or wrong, and
    content lines wholly in another language.

    Of several rows of a record in ``meta`` the one loaded last counts (of those the greatest lang_id). Records without a
    row there have no lang_id to be wrong. Null texts, cases of problem 5 and records in no language of the list have no rows.
    """
    from tamarack.plans.stage import written

    t = written(languages(df).where(F.col("prose") & (F.col("lang") != "und")).drop("segments"), "languages")
    own = named(F.col("label"))
    label = t.where(own.isNull() | (own != F.col("lang"))).select("rec_id", F.lit("lang").alias("label_field"), F.lit(-1).alias("line_no"), "lang")
    last = meta.groupBy("rec_id").agg(F.max(F.struct("loaded_at", "lang_id")).alias("m")).select("rec_id", F.col("m.lang_id").alias("lang_id"))
    # lang_codes is a fixed table of a few rows.
    ids = last.join(F.broadcast(codes.select("lang_id", F.col("lang").alias("known"))), "lang_id", "left")
    ids = t.select("rec_id", "lang").join(ids, "rec_id").where("lang_id IS NULL OR lang_id = 0 OR known IS NULL OR known <> lang")
    ids = ids.select("rec_id", F.lit("lang_id").alias("label_field"), F.lit(-1).alias("line_no"), "lang")
    line = t.select("rec_id", F.explode("foreign_lines").alias("f")).select("rec_id", F.lit("line").alias("label_field"), F.col("f.line_no").alias("line_no"), F.col("f.lang").alias("lang"))
    return label.unionByName(ids).unionByName(line)
