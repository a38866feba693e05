"""Operator 2: toxicity by a support vector machine on a gapped-subsequence kernel with Nyström landmarks.

The kernel of two words is that of their common subsequences of three letters, each weighted by decay to the power of
the letters it spans, gaps included, and normalized. Labels say whether a text is toxic, so its sentences are the examples by multiple-instance
learning: all of a clean text's are clean, and at least one of a toxic text's is toxic, by its witness words, which the kernel reads. A machine trained on the landmarks' kernel columns is a weighted sum of kernels, and since the kernel is
linear in its features, that sum is one table of letter triples, which scores any word at the same cost.

Two machines of the same kernel read each word. The strict one pays dearly for words of clean sentences: a single word
above its threshold makes a text toxic. The loose one finds words that clean sentences hold too, now and then: a text is
toxic when it has more of them than its length explains, and also when one of its sentences has as many as no clean sentence, however long the text is.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import WordHashes, bounded_sample, mix, per_doc

SAMPLE, LANDMARKS, DECAY, LONGEST, EVIDENCE, NEGATIVES = 4000, 256, 0.6, 24, 8.0, 2500
TEXTS, LONG_TEXT = 64, 1 << 18  # longer texts are read alone
RATES, NEEDS = (0.0, 0.001, 0.002, 0.004, 0.006, 0.01), (0.5, 1.5, 2.5, 3.5, 4.5)
SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w(?!\w)){3,}")
KEEP = {c: c for c in range(97, 123)} | {c: c + 32 for c in range(65, 91)}
LEET = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas")}


#: Letters a to z, and 32 classes for those of all other scripts: neighbours in an alphabet are of different classes.
LETTERS_N = 58


class _Letters(dict):
    """Translation table: a letter without its accent, in lower case; a few look-alike digits and signs; other scripts' letters by class; nothing for the rest."""

    def __missing__(self, c: int):
        base = unicodedata.normalize("NFKD", chr(c).casefold())
        self[c] = v = "".join(x if "a" <= x <= "z" else chr(123 + ord(x) % 32) for x in base if "a" <= x <= "z" or x.isalpha() and ord(x) > 127)
        return v


LETTERS = _Letters(KEEP | LEET)


def sentences(text: str) -> list[str]:
    """Between ends of sentences or lines."""
    return [x for x in SPLIT.split(text) if x]


def tokens(sentence: str) -> list[str]:
    """Words reduced to letters, and runs of single characters ("i d i o t") as one word each."""
    out = sentence.split()
    if SPACED.search(sentence):
        out += [re.sub(r"[\W_]", "", m.group()) for m in SPACED.finditer(sentence)]
    return out


def windows(word: str) -> list[str]:
    """The letters of a word, in overlapping windows if they are many: no word is cut short."""
    w = word.translate(LETTERS)
    if len(w) <= LONGEST:
        return [w] if len(w) >= 3 else []
    return [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


_PLACES = {n: np.array(list(combinations(range(n), 3)), np.int64) for n in range(3, LONGEST + 1)}


def triples(ws: list[str], decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: (codes, weights) of all their letter triples."""
    a = np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(len(ws), -1).astype(np.int32) - 97
    at = _PLACES[a.shape[1]]
    code = (a[:, at[:, 0]] * LETTERS_N + a[:, at[:, 1]]) * LETTERS_N + a[:, at[:, 2]]
    return code, (decay ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def columns(ws: list[str]) -> np.ndarray:
    """The codes of all triples of some words."""
    return np.unique(np.concatenate([triples([w])[0][0] for w in ws] or [np.zeros(0, np.int32)]))


def features(ws: list[str], decay: float = DECAY, cols: np.ndarray | None = None) -> np.ndarray:
    """Explicit normalized features of a few words, one row each, for training: the columns are those of `cols`, by default of the words' own triples. What lies outside counts in the norm."""
    cols = columns(ws) if cols is None else cols
    out = np.zeros((len(ws), len(cols)), np.float32)
    for i, w in enumerate(ws):
        code, weight = triples([w], decay)
        own, at = np.unique(code[0], return_inverse=True)
        sums = np.bincount(at, weight)
        sums /= max(np.linalg.norm(sums), 1e-9)
        where = np.minimum(np.searchsorted(cols, own), max(len(cols) - 1, 0))
        there = cols[where] == own if len(cols) else np.zeros(len(own), bool)
        out[i, where[there]] = sums[there]
    return out


def kernel(a: list[str], b: list[str], decay: float = DECAY) -> np.ndarray:
    cols = columns(b)
    return features(a, decay, cols) @ features(b, decay, cols).T


class Model:
    """Two tables of triple weights (strict, loose), their biases, the words by which the loose one's hits in a text must exceed `rate` a word, and the hits that make a sentence toxic; caches words, and letters of words, within a bound."""

    def __init__(self, tables: np.ndarray, biases: np.ndarray, rate: float = 0.0, need: float = np.inf, sentence: float = np.inf, decay: float = DECAY, bound: int = 120_000):
        self.tables, self.biases, self.rate, self.need, self.sentence = tables.astype(np.float32), np.asarray(biases, float), rate, need, sentence
        self.decay, self.bound, self.known, self.scored = decay, bound, {}, {}

    def __getstate__(self):
        return (self.tables, self.biases, self.rate, self.need, self.sentence, self.decay, self.bound)

    def __setstate__(self, s):
        self.tables, self.biases, self.rate, self.need, self.sentence, self.decay, self.bound = s
        self.known, self.scored = {}, {}

    def _score(self, ws: list[str]) -> np.ndarray:
        """A row for each word: its scores by the two machines. Words of one length are scored together."""
        out = np.zeros((len(ws), 2))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(ws):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            for lo in range(0, len(at), 1000):
                part = at[lo : lo + 1000]
                code, weight = triples([ws[i] for i in part], self.decay)
                raw = np.stack([(t[code] * weight).sum(axis=1) for t in self.tables], 1)
                # the norm: equal triples of a word add up before they are squared
                order = np.argsort(code, axis=1)
                c = np.take_along_axis(code, order, 1)
                w = weight[order]
                new = np.ones(c.shape, bool)
                new[:, 1:] = c[:, 1:] != c[:, :-1]
                sums = np.add.reduceat(w.ravel(), np.nonzero(new.ravel())[0])
                row = np.repeat(np.arange(len(part)), new.sum(axis=1))
                out[part] = raw / np.sqrt(np.bincount(row, sums**2, len(part)))[:, None]
        return out + self.biases

    def learn(self, words: set[str]) -> dict[str, tuple[float, float]]:
        """The cache, with scores of these words in it: the greatest over a word's windows, minus infinity if it hasn't three letters."""
        known, scored = self.known, self.scored
        new = words.difference(known)
        if new and len(known) + len(new) > self.bound:
            known.clear()
            new = words
        if new:
            wins = {w: windows(w) for w in new}
            letters = {x for v in wins.values() for x in v}
            fresh = letters.difference(scored)
            if len(scored) + len(fresh) > self.bound:
                scored.clear()
                fresh = letters
            if fresh:
                flat = list(fresh)
                scored.update(zip(flat, map(tuple, self._score(flat).tolist())))
            for w, v in wins.items():
                known[w] = scored[v[0]] if len(v) == 1 else tuple(map(max, zip(*(scored[x] for x in v)))) if v else (-np.inf, -np.inf)
        return known

    def read(self, text: str, toks: list[str] | None = None) -> tuple[float, int, int, int]:
        """(best strict score of any word, loose hits, words, loose hits of the sentence that has most)."""
        toks = tokens(text) if toks is None else toks
        distinct = set(toks)
        known = self.learn(distinct)
        best = max((known[w][0] for w in distinct), default=-np.inf)
        loose = {w for w in distinct if known[w][1] > 0}
        if not loose:
            return best, 0, len(toks), 0
        hits = sum(t in loose for t in toks)
        return best, hits, len(toks), hits if hits < 2 else max(sum(t in loose for t in tokens(x)) for x in sentences(text))

    def text_score(self, text: str | None, toks: list[str] | None = None) -> float:
        """Above 0 for toxic texts; minus infinity where there is no word."""
        if not text:
            return -np.inf
        strict, hits, n, most = self.read(text, toks)
        return max(strict, hits - self.rate * n - self.need, most - self.sentence) if strict > -np.inf else strict

    def text_scores(self, texts: list[str | None]) -> list[float]:
        """text_score of each; the words of many texts are scored at once."""
        out: list[float] = []
        for lo in range(0, len(texts), TEXTS):
            toks = [tokens(t) if t and len(t) < LONG_TEXT else None for t in texts[lo : lo + TEXTS]]
            self.learn({w for own in toks if own for w in own})
            out += map(self.text_score, texts[lo : lo + TEXTS], toks)
        return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """A linear machine of squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-3
    for _ in range(steps):
        live = y * (x @ w) < 1
        xl = x[live] * cost[live, None]
        new = np.linalg.solve(reg + xl.T @ x[live], xl.T @ y[live])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def without_copies(bags: list[tuple[list[str], bool]], hashes: int = 16) -> list[tuple[list[str], bool]]:
    """One bag of each set of near copies, by MinHash: copies of a text are no more evidence than the text. A toxic copy makes the set toxic."""
    h, seeds = WordHashes(), mix(np.arange(1, hashes + 1, dtype=np.uint64))
    held: dict[tuple[int, int], list[int]] = {}
    out: list[list] = []
    for ws, y in bags:
        sig = [int(v) for v in (mix(h(ws)[:, None] ^ seeds).min(axis=0) if ws else [])]
        votes: dict[int, int] = {}
        for k in enumerate(sig):
            for j in held.get(k, ()):
                votes[j] = votes.get(j, 0) + 1
        twin = max(votes, key=votes.get, default=None)
        if twin is not None and votes[twin] >= hashes // 2:
            out[twin][1] = out[twin][1] or y
            continue
        for k in enumerate(sig):
            held.setdefault(k, []).append(len(out))
        out.append([ws, y])
    return [(ws, y) for ws, y in out]


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, decay: float = DECAY, rounds: int = 4, negatives: int = NEGATIVES) -> Model:
    """A model of labelled texts, whose sentences are the examples: those of clean texts are clean, and of a toxic text at least one is toxic, by its witness words.

    Witnesses are words that toxic texts hold far oftener. `negatives` bounds the clean words that a machine is first trained with: so many of the most frequent, and as many of the
    others, drawn evenly; then all words of clean sentences are scored, and those that a machine takes for toxic are added, round by round.
    """
    nothing = Model(np.zeros((2, LETTERS_N**3)), [-1.0, -1.0], decay=decay)
    texts = [t or "" for t in texts]
    truth = np.array([bool(y) for y in toxic])
    bags = without_copies([(sorted({w for x in sentences(t) for y in tokens(x) for w in windows(y)}), bool(y)) for t, y in zip(texts, truth)])
    n_tox, n_clean = max(1, sum(y for _, y in bags)), max(1, sum(not y for _, y in bags))
    seen = {True: {}, False: {}}
    for ws, y in bags:
        for w in ws:
            seen[y][w] = seen[y].get(w, 0) + 1
    n = n_tox + n_clean
    odds, sure = {}, {}
    for w, k in seen[True].items():
        j = seen[False].get(w, 0)
        odds[w] = np.log((k + 0.1) / n_tox) - np.log((j + 0.1) / n_clean)
        # the likelihood ratio of the word's share in toxic texts against that of all texts
        sure[w] = k * np.log(k / (k + j) * n / n_tox) + (j * np.log(j / (k + j) * n / n_clean) if j else 0.0) if odds[w] > 0 else 0.0
    strong = sorted((w for w in odds if seen[True][w] >= min(3, n_tox) and odds[w] > 1 and sure[w] > EVIDENCE), key=lambda w: (-sure[w], w))
    if not strong:
        strong = sorted((w for w in odds if odds[w] > 1), key=lambda w: (-sure[w], w))[:3]
    if not strong:
        return nothing
    top = strong[: landmarks // 2]
    rng = np.random.default_rng(5)
    every = sorted((w for w in seen[False] if w not in set(strong)), key=lambda w: (-seen[False][w], w))
    tail = every[negatives:]
    clean = every[:negatives] + [tail[i] for i in sorted(rng.choice(len(tail), min(len(tail), negatives), replace=False))]
    marks = top + [clean[i] for i in rng.permutation(len(clean))[: landmarks - len(top)]]
    cols = columns(marks)
    fm = features(marks, decay, cols)
    val, vec = np.linalg.eigh(fm @ fm.T)
    good = val > 1e-3
    root = vec[:, good] / np.sqrt(val[good])  # the Nyström map is k(x, marks) @ root

    def mapped(ws: list[str]) -> np.ndarray:
        return np.vstack([features(ws[i : i + 300], decay, cols) @ fm.T for i in range(0, len(ws), 300)] or [np.zeros((0, len(marks)))]) @ root

    positive, negative = mapped(strong), mapped(clean)
    hits = np.array([min(seen[True][w], 50) for w in strong], float)
    for _ in range(rounds):
        x, y = np.vstack([positive, negative]), np.concatenate([np.ones(len(strong)), -np.ones(len(negative))])
        tables, biases = np.zeros((2, LETTERS_N**3), np.float32), []
        for k, dear in enumerate((30.0, 1.0)):
            cost = np.concatenate([10.0 + 10.0 * hits / hits.mean(), np.full(len(negative), dear)])
            w = svm(x, y, cost)
            tables[k, cols] = fm.T @ (root @ w[:-1])
            biases.append(w[-1])
        model = Model(tables, biases, decay=decay)
        known = set(clean)
        hard = [w for w, s in zip(every, model._score(every)) if s.max() > 0 and w not in known] if every else []
        if not hard:
            break
        clean, negative = clean + hard, np.vstack([negative, mapped(hard)])
    found = [model.read(t) for t in texts]
    # the strict threshold lies above all but one in a thousand of the clean texts' best words
    best = np.array([f[0] for f in found])
    limit = np.sort(best[~truth])[::-1][int(0.001 * (~truth).sum())] if (~truth).any() else -1.0
    top_score = float(np.median(best[truth & (best > limit)])) if (truth & (best > limit)).any() else limit + 1
    model.biases[0] -= max(limit, 0.0) + 0.3 * max(0.0, top_score - max(limit, 0.0))
    # the loose hits that a text must have, as a part of its words and beyond: the fewest errors on the sample
    k, size = np.array([f[1] for f in found], float), np.array([f[2] for f in found], float)
    sure_already = best + (model.biases[0] - biases[0]) > 0
    choices = [(((k - r * size - b > 0) | sure_already) != truth).sum() for r in RATES for b in NEEDS]
    at = int(np.argmin(choices))
    model.rate, model.need = RATES[at // len(NEEDS)], NEEDS[at % len(NEEDS)]
    # and the hits that no sentence of a clean text has, or of no more of them than one in a thousand
    most = np.sort(np.array([f[3] for f in found], float)[~truth])[::-1]
    model.sentence = float(most[int(0.001 * len(most))] if len(most) else 0.0) + 0.5
    model.known.clear()
    model.scored.clear()
    return model


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Trains on at most `sample` labelled documents, those of least hash of doc_id: the documented bound of labelled rows."""
    some = bounded_sample(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], [r.toxic for r in rows], **options)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) of every row: the greatest score of any word of the whole text, and whether it is above 0.

    A null text, or one without three letters in a row, has a null score and isn't toxic. Repeated rows, and rows
    without doc_id, give a row each. Other columns are never read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.array(m.text_scores(list(b.text)), float)
            yield pd.DataFrame({"doc_id": b.doc_id, "score": pd.Series(s).astype("Float64").mask(~np.isfinite(s)), "toxic": s > 0})

    return per_doc(docs, run, "doc_id long, score double, toxic boolean", "doc_id", "text")


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """toxicity() of all documents by a model of the labelled ones; without any label, nothing is toxic."""
    return toxicity(docs, train_on(docs, labels, sample))
