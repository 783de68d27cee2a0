"""Problem 10: text from a wrong character encoding, by mutual information of neighbouring characters.

All adjacent pairs of the corpus are counted, once for each distinct text, as copies are no further evidence. A pair's
score is how far its pointwise mutual information lies below a level; maximum-scoring segments of these scores are the
improbable runs of a text, widened to the runs of non-ASCII characters they touch. Inside them, and wherever characters
are the bytes of a UTF-8 character in some encoding or letters of two scripts touch, however frequent, inverse mappings
are tried: the characters are turned back into the bytes of an encoding they may have been read in, and the bytes are
read as UTF-8 or as another single-byte encoding, twice over if need be. A mapping is taken if the corpus makes the result
likelier by more than a margin. Replacement characters and C1 controls are marks of wrong decoding whether or not anything can be restored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.arrays import BMP, LETTER, TextBatch, mapped, tables

LEVEL = -2.0
"""Pairs whose mutual information (nats) lies below this score above zero."""
FLOOR = 0.02
"""Least share a single character counts with, so that rare characters cannot make a pair look bound."""

#: Encodings that bytes may have been read in, and those they may have been written in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "iso8859_15", "cp1254", "cp1257", "cp866"]
WRITTEN_AS = ["cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_2"]
MULTI_GAIN, SINGLE_GAIN, LEAST_SEEN = -6.0, 4.0, 3
"""Nats of gain a restored run must exceed: in all for UTF-8, whose byte pattern is evidence itself, for each changed
character else. Restored characters must occur so often in the corpus."""
BROADCAST_COPIES = 400_000
"""Repeated texts up to this number have their hashes broadcast; beyond it the texts are shuffled to meet them."""
ALIKE = 3
"""Different runs of one text that a less sure mapping must explain, or else ..."""
ENOUGH = 18.0
"""... nats that its different cases in the text must gain together."""


@lru_cache(None)
def to_byte(codec: str) -> dict[str, int]:
    """Upper half of an encoding; where it leaves a byte undefined, the C1 control of that number."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def from_byte(codec: str) -> dict[int, str]:
    return {b: c for c, b in reversed(to_byte(codec).items()) if not (0x80 <= ord(c) < 0xA0)}


def reread_utf8(run: str, codec: str) -> str:
    """The run with every stretch that is UTF-8 read as ``codec`` put right; a blank may stand for a lost hard blank."""
    table, out, i = to_byte(codec), [], 0
    while i < len(run):
        lead = table.get(run[i], 0)
        n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        rest = run[i + 1 : i + n]
        if n and len(rest) == n - 1:
            raw = bytes([lead, *(0xA0 if c == " " and "\xa0" in table else table.get(c, 0) for c in rest)])
            try:
                out.append(raw.decode("utf-8"))
                i += n
                continue
            except UnicodeDecodeError:
                pass
        out.append(run[i])
        i += 1
    return "".join(out)


def reread_single(run: str, read: str, written: str) -> str | None:
    table, back = to_byte(read), from_byte(written)
    out = []
    for c in run:
        if ord(c) < 128:
            out.append(c)
            continue
        b = table.get(c)
        if b is None or b not in back:
            return None
        out.append(back[b])
    return "".join(out)


@lru_cache(1)
def _utf8_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the basic plane, a bit for each of READ_AS: leads of 2, 3 and 4 bytes and later bytes."""
    two, three, four, later = (np.zeros(BMP, np.uint16) for _ in range(4))
    for i, codec in enumerate(READ_AS):
        table = to_byte(codec)
        for c, b in table.items():
            t = two if 0xC2 <= b < 0xE0 else three if 0xE0 <= b < 0xF0 else four if 0xF0 <= b < 0xF5 else later if b < 0xC0 else None
            if t is not None:
                t[ord(c)] |= 1 << i
        if "\xa0" in table:
            later[32] |= 1 << i
    return two, three, four, later


def utf8_leads(cp: np.ndarray) -> np.ndarray:
    """Whether a character and those after it are the bytes of one UTF-8 character in some encoding."""
    two, three, four, later = _utf8_tables()
    x = np.zeros(len(cp) + 3, np.uint32)
    x[: len(cp)] = np.where(cp < BMP, cp, 0)
    x, n = x.astype(np.uint16), len(cp)
    l1, l2, l3 = (later[x[k : n + k]] for k in (1, 2, 3))
    return (two[x[:n]] & l1 | three[x[:n]] & l1 & l2 | four[x[:n]] & l1 & l2 & l3) != 0


def foreign_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where ``_foreign`` holds of two neighbouring characters."""
    mark = lambda c: (c >= 0x370) & (c < 0x530) | (c >= 0x2200) & (c < 0x2400) | (c >= 0x2500) & (c < 0x25A0)
    latin = lambda c: (c < 0x250) & (tables()[0][np.minimum(c, BMP - 1)] & LETTER > 0)
    return mark(a) & latin(b) | mark(b) & latin(a)


BLOCKS = 0x110000 >> 12


@lru_cache(1)
def kinds() -> tuple[np.ndarray, int]:
    """A kind for every code point, and the number of kinds.

    ASCII and each character that one of the encodings can read or write is a kind of its own; all others, which no single
    byte can stand for, are told apart by their block of 4096. So pairs of kinds are about a million, whatever the corpus.
    """
    own = sorted({*range(128), *(ord(c) for k in {*READ_AS, *WRITTEN_AS} for c in to_byte(k)), 0xFFFD})
    table = len(own) + (np.arange(0x110000, dtype=np.int32) >> 12)
    table[own] = np.arange(len(own))
    return table.astype(np.int32), len(own) + BLOCKS


def single(cp: np.ndarray) -> np.ndarray:
    """Whether a character is beyond ASCII and a kind of its own, or U+FFFD."""
    table, n = kinds()
    return (cp > 127) & (table[cp] < n - BLOCKS)


def weighed(docs: DataFrame) -> DataFrame:
    """(text, weight): the copies of a text weigh one together."""
    from tamarack.plans.stage import cut

    d = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    d = d.withColumn("h", F.xxhash64("text"))
    many = cut(d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    n = many.limit(BROADCAST_COPIES + 1).count()
    if not n:
        return d.select("text", F.lit(1.0).alias("weight"))
    many = F.broadcast(many) if n <= BROADCAST_COPIES else many
    return d.join(many, "h", "left").select("text", F.coalesce(1 / F.col("n"), F.lit(1.0)).alias("weight"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n, copies): how often a character of kind b follows one of kind a, in distinct texts and in all; a line feed
    counts as a blank. Rows with b = -1 count single characters that share their kind."""

    def make(b, kept):
        cp = np.where(b.cp == 10, 32, b.cp)
        if len(cp) < 2:
            return [[], [], [], []]
        weight = kept[0].to_numpy(zero_copy_only=False)[b.doc_of[:-1]]
        table, k = kinds()
        code = table[cp]
        pair = code[:-1].astype(np.int64) * k + code[1:]
        copies = np.bincount(pair, minlength=k * k)
        n = np.bincount(pair, weight, k * k)
        at = np.flatnonzero(copies)
        rare, times = np.unique(cp[code >= k - BLOCKS], return_counts=True)
        none = np.full(len(rare), -1)
        return [np.concatenate([at // k, rare]), np.concatenate([at % k, none]), np.concatenate([n[at], none + 1.0]), np.concatenate([copies[at], times])]

    n = mapped(weighed(docs), "text", ["weight"], "a int, b int, n double, copies bigint", make)
    return n.groupBy("a", "b").agg(F.round(F.sum("n"), 6).alias("n"), F.sum("copies").alias("copies"))


class Model:
    """Pair statistics of the corpus, a row and a column for each kind of character."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, copies: np.ndarray):
        k = kinds()[1]
        self.rare = dict(zip(a[b < 0].tolist(), copies[b < 0].tolist()))
        a, b, n, copies = (x[b >= 0] for x in (a, b, n, copies))
        self.n = np.zeros((k, k), np.float32)
        self.n[a, b] = n
        self.total = max(float(n.sum()), 1.0)
        self.p = (np.bincount(a, n, k) / self.total).astype(np.float32)
        self.copies = np.bincount(a, copies, k)
        self._seen: dict[int, float] = {}

    def pair_n(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        table = kinds()[0]
        return self.n[table[a], table[b]].astype(float)

    def times(self, c: str) -> float:
        """Occurrences of a character in the corpus, copies and all."""
        table, k = kinds()
        kind = int(table[ord(c)])
        return float(self.rare.get(ord(c), 0) if kind >= k - BLOCKS else self.copies[kind])

    def own_share(self, c: int) -> float:
        """Log of a character's share in its kind."""
        table, k = kinds()
        kind = int(table[c])
        return 0.0 if kind < k - BLOCKS else float(np.log((self.rare.get(c, 0) + 0.01) / (self.copies[kind] + 1.0)))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positive where a pair is improbable."""
        table = kinds()[0]
        pa, pb = np.maximum(self.p[table[a]], FLOOR), np.maximum(self.p[table[b]], FLOOR)
        return LEVEL - np.log((self.pair_n(a, b) + 0.5) / self.total / pa / pb)

    def loglik(self, text: str, own: int = 0) -> float:
        """Log-probability of the characters after the first; ``own`` is how often the text itself is among the counts."""
        total, table = 0.0, kinds()[0]
        for x, y in zip(text, text[1:]):
            total += self.own_share(ord(y))
            x, y = int(table[ord(x)]), int(table[ord(y)])
            k = own << 42 | x << 21 | y
            if k not in self._seen:
                first = max(float(self.p[x]) * self.total - own, 0.0)
                n = max(float(self.n[x, y]) - own, 0.0)
                share = max(float(self.p[y]) - own / self.total, 0.0)
                self._seen[k] = float(np.log((n + 20 * (share + 1e-8)) / (first + 20)))
            total += self._seen[k]
        return total


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, end) of a row of scores, left to right, in one pass."""
    stack: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(score.tolist()):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(int(a), int(b)) for a, b, _, _ in stack]


def _odd(left: str, run: str, right: str) -> bool:
    """Whether a character of the run cannot stand where it does in a Latin word: a symbol between letters, a letter of
    another script beside Latin ones, a capital after a small letter."""
    row = left + run + right
    latin = lambda c: c.isalpha() and (c < "\u0250" or "\u1e00" <= c < "\u1f00") and c not in "ªº"
    for i in range(1, len(row) - 1):
        c, x, y = row[i], row[i - 1], row[i + 1]
        if ord(c) < 128:
            continue
        if not c.isalpha():
            if latin(x) and latin(y) and c not in "’‘´·\xad\xa0–—":
                return True
        elif not latin(c):
            if latin(x) or latin(y):
                return True
        elif c.isupper() and latin(x) and x.islower():
            return True
    return False


def _foreign(left: str, run: str, right: str) -> bool:
    """Whether a letter of another script, a mathematical sign or a box piece touches a Latin letter: a mark of wrong
    decoding even if nothing can be restored."""
    row = left + run + right
    for x, y in zip(row, row[1:]):
        for c, o in ((x, y), (y, x)):
            if ("\u0370" <= c < "\u0530" or "\u2200" <= c < "\u2400" or "\u2500" <= c < "\u25a0") and o.isalpha() and o < "\u0250":
                return True
    return False


def restore(model: Model, left: str, run: str, right: str) -> tuple[str | None, dict[str, tuple[float, str]]] | None:
    """What the run was before it was read wrongly, or None if no mapping fits.

    The restored run if that is sure, for UTF-8 read as something else, characters that cannot stand there or a letter
    alone that was a dash or bullet; and what each pair of single-byte encodings gains and makes of it, of which the text as a whole must give enough evidence.
    """
    best, text = None, run
    for _ in range(3):
        base = model.loglik(left + text + right)
        options = []
        for codec in READ_AS:
            tail = text + " " if right == " " and not left.isupper() else text
            new = reread_utf8(tail, codec)
            if new == tail:
                continue
            blank = tail is not text and new[-1:] == " "
            new = new[:-1] if blank else new
            gain = model.loglik(left + new + (right if blank or tail is text else " ")) - base
            seen = all(model.times(c) >= LEAST_SEEN for c in new if ord(c) > 127)
            if seen and gain > MULTI_GAIN or "\ufffd" in new:
                options.append((gain, new))
        if options:
            best = text = max(options)[1]
            continue
        break
    if best is not None:
        return best, {}
    odd, options = _odd(left, run, right), {}
    base = model.loglik(left + run + right, 1)
    for read in READ_AS:
        for written in WRITTEN_AS:
            new = None if read == written else reread_single(run, read, written)
            if new is None or new == run or not all(c.isalpha() or c in "«»“”‘’–—…°º•" for c in new if ord(c) > 127):
                continue
            gain = model.loglik(left + new + right) - base
            if gain > SINGLE_GAIN * sum(x != y for x, y in zip(run, new)) and not _odd(left, new, right):
                options[f"{read} {written}"] = gain, new
    if not options:
        return (run, {}) if _foreign(left, run, right) else None
    alone = len(run) == 1 and run.isalpha() and left.isspace() and right.isspace()
    sure = [x for x in options.values() if odd or alone and x[1] in "–—•"]
    return max(sure)[1] if sure else None, options


def convincing(found: dict[tuple[str, str, str], tuple[str | None, dict[str, tuple[float, str]]]]) -> dict[tuple[str, str, str], str]:
    """The restored run of each (left, run, right) of one text for which the text's own evidence is enough.

    Each pair of encodings has the gains of all the different cases it explains; pairs that restore them alike have the
    same. The best is taken, then the best of what it leaves.
    """
    out = {k: new for k, (new, _) in found.items() if new is not None}
    left = {k: options for k, (new, options) in found.items() if new is None}
    while left:
        total: dict[str, float] = {}
        runs: dict[str, set] = {}
        for k, (_, options) in found.items():
            if k in left or k in out:
                for how, (gain, new) in options.items():
                    if k in left or out[k] == new:
                        total[how] = total.get(how, 0.0) + gain
                        runs.setdefault(how, set()).add(k[1])
        open_ = {how for options in left.values() for how in options}
        good = [how for how in open_ if total[how] >= ENOUGH or len(runs[how]) >= ALIKE]
        if not good:
            break
        how = max(good, key=lambda h: (round(total[h], 6), h))
        for k in [k for k in left if how in left[k]]:
            out[k] = left.pop(k)[how][1]
    return out


def repair(model: Model, texts: list[str | None], cache: dict | None = None) -> tuple[np.ndarray, list[str | None]]:
    """Of each text: whether some part was decoded wrongly, and the text with all runs restored that can be."""
    cache = {} if cache is None else cache
    b = TextBatch(texts)
    cp = np.where(b.cp == 10, 32, b.cp)
    bad = np.zeros(b.n, bool)
    fixed = list(texts)
    if len(cp) < 2:
        return bad, fixed
    high = cp > 127
    mark = np.flatnonzero((cp == 0xFFFD) | (cp >= 0x80) & (cp < 0xA0))
    bad[np.searchsorted(b.start, mark, "right") - 1] = True
    # Only neighbourhoods of characters that a byte may have become are scored: ASCII survives every one of these encodings,
    # and no encoding makes other characters. Where two scripts touch is looked at in any case.
    mixed = foreign_pairs(cp[:-1], cp[1:])
    alone = single(cp)
    near = alone[:-1] | alone[1:] | mixed
    at = np.flatnonzero(near)
    if not len(at):
        return bad, fixed
    score = model.scores(cp[at], cp[at + 1])
    certain = utf8_leads(cp)[at] | foreign_pairs(cp[at], cp[at + 1])
    score = np.where(certain, np.maximum(score, 1e-9), score)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    hot = np.maximum.reduceat(score, np.concatenate([[0], cut])) > 0
    edits: dict[int, list[tuple[int, int, tuple[str, str, str], tuple]]] = {}
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    for a, z in zip(starts[hot].tolist(), ends[hot].tolist()):
        done = -1
        for s, e in segments(score[a:z]):
            s, e = int(at[a + s]), int(at[a + e - 1]) + 2
            while s > 0 and high[s - 1] and high[s]:
                s -= 1
            while e < len(cp) and high[e] and high[e - 1]:
                e += 1
            while s < e and not high[s]:
                s += 1
            while e > s and not high[e - 1]:
                e -= 1
            if s >= e or e <= done:
                continue
            s, done = max(s, done), e
            run = b.text[s:e]
            left, right = (b.text[s - 1 : s] or " ").replace("\n", " "), (b.text[e : e + 1] or " ").replace("\n", " ")
            key = (left, run, right)
            if key not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[key] = restore(model, left, run, right)
            if cache[key] is not None:
                d = int(np.searchsorted(b.start, s, "right")) - 1
                o = int(b.start[d])
                edits.setdefault(d, []).append((s - o, e - o, key, cache[key]))
    for d, row in edits.items():
        t, out, last = texts[d], [], 0
        good = convincing({key: found for _, _, key, found in row})
        row = [(s, e, good[key]) for s, e, key, _ in row if key in good]
        bad[d] |= bool(row)
        for s, e, new in row:
            out += [t[last:s], new]
            # A hard blank that had become a blank belongs to the character restored before it.
            last = e + (t[e : e + 1] == " " and new[-1:] in "àÀ" and t[e - 1 : e] == "Ã")
        fixed[d] = "".join([*out, t[last:]])
    return bad, fixed


def corpus_model(docs: DataFrame) -> Model:
    """Counts over all distinct texts; pairs of kinds come to the driver, at most about a million rows by construction."""
    n = pair_counts(docs).toPandas()  # and one row for each character that shares its kind
    return Model(n["a"].to_numpy(np.int64), n["b"].to_numpy(np.int64), n["n"].to_numpy(float), n["copies"].to_numpy(float))


def repaired(docs: DataFrame) -> DataFrame:
    """(doc_id, restored) of the documents with wrongly decoded parts; ``restored`` equals the text where nothing could be
    put right. Null and empty texts are never cases; repeated rows are judged one by one."""
    model = docs.sparkSession.sparkContext.broadcast(corpus_model(docs))
    cache: dict = {}

    def make(b, kept):
        import pyarrow as pa

        bad, fixed = repair(model.value, b.texts, cache)
        at = np.flatnonzero(bad)
        return [kept[0].take(pa.array(at)), [fixed[i] for i in at]]

    return mapped(docs, "text", ["doc_id"], "doc_id bigint, restored string", make)
