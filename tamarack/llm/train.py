"""Trains the models that are kept in ``models``: python -m tamarack.llm.train NAME DIR."""

from __future__ import annotations

import sys

import numpy as np


def pages(folders: str, rows: int) -> list[str]:
    """A bounded sample of texts of one or more folders (parted by commas), in the order of a hash of the key."""
    return [t for f in folders.split(",") for t in _pages(f, rows // len(folders.split(",")))]


def _pages(folder: str, rows: int) -> list[str]:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{folder}/wet_documents.parquet", columns=["rec_id", "text"]).to_pylist()
    t = [r for r in t if (r["text"] or "").strip()]
    t.sort(key=lambda r: (r["rec_id"] * 2654435761) % 2**32)
    return [r["text"] for r in t[:rows]]


def furniture(folder: str, rows: int = 12_000) -> None:
    """The line labeller, and what it finds of furniture, a language and words it was not shown."""
    from tamarack.llm import furniture as f
    from tamarack.llm import pagelabels as pl

    texts = [t for _, t in sorted(enumerate(pages(folder, rows)), key=lambda p: p[0] * 2654435761 % 2**32)]
    rng = np.random.default_rng(4)
    gold = [pl.label(t.split("\n")) for t in texts]
    cut = len(texts) * 9 // 10
    seen, unseen = pl.COMMON[::2], pl.COMMON[1::2]
    mixed = [pl.dressed(t, g, seen, rng) if rng.random() < 0.4 else (t, g) for t, g in zip(texts[:cut], gold[:cut])]
    w, t = f.train([x for x, _ in mixed], [g for _, g in mixed])
    np.savez_compressed(f.MODEL, weights=w.astype(np.float16), transitions=t.astype(np.float16))
    print("held out:", measured(w, t, texts[cut:], gold[cut:]))
    other = [pl.dressed(x, [-1] * len(g), unseen, rng) for x, g in zip(texts[cut:], gold[cut:])]
    print("furniture never seen, on held-out pages:", measured(w, t, [x for x, _ in other], [g for _, g in other]))
    tongue = page_languages(texts)
    rest = [i for i in range(len(texts)) if tongue[i] != "pt"]
    own = [i for i in range(len(texts)) if tongue[i] == "pt"][:600]
    w, t = f.train([texts[i] for i in rest[: cut // 3]], [gold[i] for i in rest[: cut // 3]], epochs=3)
    print("a language never seen:", measured(w, t, [texts[i] for i in own], [gold[i] for i in own]))


def page_languages(texts: list[str]) -> list[str]:
    from tamarack.llm.arrays import TextBatch
    from tamarack.llm.lines import lookup

    out: list[str] = []
    for a in range(0, len(texts), 300):
        out += [lookup()["langs"][k] for k in word_votes(TextBatch(texts[a : a + 300])).argmax(1)]
    return out


def measured(w: np.ndarray, t: np.ndarray, texts: list[str], gold: list[list[int]]) -> str:
    """Precision and recall of furniture; lines labelled -1 do not count."""
    from tamarack.llm import furniture as f
    from tamarack.llm.arrays import TextBatch
    from tamarack.llm.lines import Lines

    hit = said = true = n = 0
    for a in range(0, len(texts), 300):
        lines = Lines(TextBatch(texts[a : a + 300]))
        y = np.array([gold[a + d][k] for d, k in zip(lines.doc, lines.no)])
        p = f.viterbi(f.emissions(w, lines), t, lines) > 0
        on = y >= 0
        hit, said, true, n = hit + (p & (y > 0)).sum(), said + (p & on).sum(), true + (y > 0).sum(), n + on.sum()
    return f"{n} lines, precision {hit / max(said, 1):.4f}, recall {hit / max(true, 1):.4f}"


def quality(folder: str, rows: int = 20_000) -> None:
    import json

    from tamarack.llm import furniture as f
    from tamarack.llm import pages as p
    from tamarack.llm import rules as r
    from tamarack.llm.arrays import TextBatch
    from tamarack.llm.lines import Lines
    from tamarack.llm.pagelabels import not_prose

    texts = [t for _, t in sorted(enumerate(pages(folder, rows)), key=lambda p: p[0] * 2654435761 % 2**32)]
    x = []
    for a in range(0, len(texts), 300):
        lines = Lines(TextBatch(texts[a : a + 300]))
        x.append(p.stats(lines, f.decode(lines) == 0))
    x, y = np.concatenate(x), np.array([not_prose(t) for t in texts])
    cut = len(texts) * 3 // 4
    found = r.induce(x[:cut], y[:cut])
    r.MODEL.write_text(json.dumps({"names": p.STATS, "rules": found}, indent=1) + "\n")
    on = np.any([r.covers(q, x[cut:]) for q in found], 0)
    print(r.to_sql(found, p.STATS))
    print(f"held out: {len(on)} pages, {y[cut:].sum()} cases, precision {(on & y[cut:]).sum() / on.sum():.4f}, recall {(on & y[cut:]).sum() / y[cut:].sum():.4f}")


def language(folder: str, rows: int = 8000) -> None:
    """Lines labelled by the function words in them and in their page.

    A line takes the language with most of its function words if that has three and a clear lead, and the page's language
    if that ties with the best; pages whose own lines disagree give only their clear lines.
    """
    from tamarack.llm import furniture as f
    from tamarack.llm import language as g
    from tamarack.llm import pages as pg
    from tamarack.llm import rules as r
    from tamarack.llm.arrays import TextBatch
    from tamarack.llm.lines import Lines

    seen: dict[str, int] = {}
    for a in range(0, len(texts := pages(folder, rows)), 300):
        b = TextBatch(texts[a : a + 300])
        lines = Lines(b)
        content = f.decode(lines) == 0
        x = pg.stats(lines, content)
        prose = ~np.any([r.covers(q, x) for q in r.load()], 0)
        at = np.flatnonzero(content & prose[lines.doc] & (lines.letters >= 25))
        row = [b.text[s:e] for s, e in zip(lines.s[at], lines.e[at])]
        votes = word_votes(TextBatch(row))
        page = np.zeros((b.n, g.OTHER))
        np.add.at(page, lines.doc[at], votes)
        ahead = np.sort(votes, 1)
        clear = (ahead[:, -1] >= 4) & (ahead[:, -1] >= 1.34 * ahead[:, -2])
        main = page.argmax(1)[lines.doc[at]]
        mixed = np.zeros(b.n, bool)
        mixed[lines.doc[at[clear & (votes.argmax(1) != main)]]] = True
        for t, v, k, sure, mix_ in zip(row, votes, main, clear, mixed[lines.doc[at]]):
            if sure:
                seen[t] = int(v.argmax())
            elif not mix_ and v[k] >= v.max() - 1:
                seen[t] = int(k)
    rng = np.random.default_rng(1)
    by = {k: [t for t, j in seen.items() if j == k] for k in range(len(g.LANGS))}
    pool = [t for v in list(by.values()) for t in v]
    by[g.OTHER] = [g.changed_letters(pool[int(i)], rng) for i in rng.integers(0, len(pool), 4000)]
    print({g.LANGS[k]: len(v) for k, v in by.items()})
    most = 4000
    rows_ = [(t, k) for k, v in by.items() for t in (rng.permutation(np.array(v, object))[:most])]
    rng.shuffle(rows_)
    cut = len(rows_) * 9 // 10
    y = np.array([int(k) for _, k in rows_])
    p = g.train([str(t).encode() for t, _ in rows_[:cut]], y[:cut])
    np.savez_compressed(g.MODEL, **{k: v.astype(np.float16) for k, v in p.items()})
    test = [str(t).encode() for t, _ in rows_[cut:]]
    ends = np.cumsum([len(t) for t in test])
    total, wins = g.label_spans(np.frombuffer(b"".join(test), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    print(f"held out: {len(test)} lines, {(total.argmax(1) == y[cut:]).mean():.4f} right, positions {(wins[np.arange(len(test)), y[cut:]].sum() / wins.sum()):.4f}")


def word_votes(b) -> np.ndarray:
    """Function words of each language in each text."""
    from tamarack.llm.arrays import member
    from tamarack.llm.lines import lookup

    t = lookup()
    at = np.searchsorted(t["common"], b.word_hash)
    at[at == len(t["common"])] = 0
    hit = member(b.word_hash, t["common"])
    return np.stack([np.bincount(b.word_doc[hit], w[at[hit]], b.n) for w in t["by_lang"]], 1)


if __name__ == "__main__":
    globals()[sys.argv[1]](sys.argv[2])
