import random

import numpy as np
import pandas as pd

from auditlake.llm.common import words
from auditlake.llm.paragraphs import JACCARD, LEAST_WORDS, PART, PASSAGE, _around, _parted, drop_repeated_paragraphs, recall, repeated_paragraphs

from .tables import awkward, docs, prose, shuffled


def brute(rows):
    paras = []
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t}):
        for i, p in enumerate(text.split("\n")):
            w = words(p)
            if len(w) >= LEAST_WORDS:
                paras.append((doc, i, tuple(w), {tuple(w[k : k + 3]) for k in range(len(w) - 2)}))
    root = list(range(len(paras)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(paras)):
        for b in range(a):
            x, y = paras[a], paras[b]
            if x[2] == y[2] or len(x[3] & y[3]) >= JACCARD * len(x[3] | y[3]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    groups = {}
    for i, p in enumerate(paras):
        groups.setdefault(find(i), []).append(p[:2])
    return {p: min(g) for g in groups.values() if len(g) > 1 for p in g}


def _case():
    r = random.Random(9)
    shared = [prose(500 + i, 60) for i in range(8)]
    rows = []
    for i in range(80):
        w = shared[i % 8].split()
        for _ in range(i // 8 % 4):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, "\n".join([prose(i, 40), " ".join(w).title() + "!", "short line", "", prose(700 + i, 30)])))
    return rows


def test_against_brute_force(spark):
    rows = _case()
    want = brute(rows)
    got = {(r.doc_id, r.para): (r.cluster_doc, r.cluster_para) for r in repeated_paragraphs(docs(spark, rows)).where("words is null").collect()}
    assert len(want) > 60 and set(got) <= set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want)
    assert recall(0.76) > 0.98 and recall(0.7) > 0.94


def test_removal(spark):
    rows = _case()
    left = {r.doc_id: r for r in drop_repeated_paragraphs(docs(spark, rows)).collect()}
    assert len(left) == 80
    assert all(prose(i, 40) in left[i].text and prose(700 + i, 30) in left[i].text and "short line" in left[i].text for i in range(80))
    assert left[0].text == rows[0][1] and left[8].text != rows[8][1] and left[8].n_chars == len(left[8].text)


def test_passages_inside_other_paragraphs(spark):
    shared = [prose(800 + i, 50 + 7 * i) for i in range(6)]
    rows = [(i, prose(i, 90) + "\n" + prose(100 + i, 20 + i) + " " + shared[i % 6] + " " + prose(200 + i, 33 - i) + "\nend") for i in range(24)]
    got = {r.doc_id: r for r in repeated_paragraphs(docs(spark, rows)).collect() if r.words is not None}
    assert set(got) == set(range(6, 24))
    for i, r in got.items():
        line = words(rows[i][1].split("\n")[1])
        piece = line[r.first : r.first + r.words]
        head = words(rows[r.cluster_doc][1].split("\n")[r.cluster_para])
        assert r.cluster_doc % 6 == i % 6 and r.cluster_doc < i and r.words >= 20 and any(head[k : k + r.words] == piece for k in range(len(head)))
    left = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs(spark, rows)).collect()}
    assert all(left[i] == rows[i][1] for i in range(6))
    for i in range(6, 24):
        assert prose(i, 90) in left[i] and prose(100 + i, 20 + i) in left[i] and prose(200 + i, 33 - i) in left[i] and left[i].endswith("\nend")
        assert len(words(rows[i][1])) - len(words(left[i])) == got[i].words


def test_marks_are_those_of_brute_force():
    from auditlake.llm.common import hash64
    from auditlake.llm.paragraphs import RUN, WINDOW, _marks

    r = random.Random(3)
    lengths = [20, 25, 60, 200, 51, 30]
    toks = [f"w{r.randrange(50)}" for _ in range(sum(lengths))]
    h = np.array([hash64(t) for t in toks], np.uint64)
    n = np.array(lengths)
    starts = np.cumsum(n) - n
    at, run = _marks(h, starts, n)
    inside = lambda i: any(s <= i and i + RUN <= s + k for s, k in zip(starts, n))
    assert all(inside(i) for i in at)
    for s, k in zip(starts, n):
        for lo in range(s, s + k - RUN - WINDOW + 2):
            assert any(lo <= i < lo + WINDOW for i in at)
    again, run2 = _marks(h[starts[3] :][:200], np.array([0]), np.array([200]))
    common = {i for i, x in zip(again, run2) if (i + starts[3], x) in set(zip(at, run))}
    assert all(any(lo <= i < lo + WINDOW for i in common) for lo in range(200 - RUN - WINDOW + 2))


def test_a_document_of_copies_only_goes(spark):
    p = prose(1, 50)
    left = drop_repeated_paragraphs(docs(spark, [(1, p), (2, p), (3, p + "\n" + prose(2, 50))])).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, p), (3, prose(2, 50))]


def test_awkward_rows(spark):
    d = docs(spark, awkward(), extra=True)
    got = {(r.doc_id, r.para, r.cluster_doc, r.kept) for r in repeated_paragraphs(d).collect()}
    assert got == {(7, 0, 7, True), (8, 0, 7, False)}
    left = drop_repeated_paragraphs(d)
    assert left.columns == d.columns and left.count() == len(awkward()) - 1


def test_one_id_with_two_texts_and_rows_without_id(spark):
    p, q, r = prose(1, 50), prose(2, 50), prose(3, 50)
    left = lambda rows: sorted((str(x.doc_id), x.text) for x in drop_repeated_paragraphs(docs(spark, rows)).collect())
    assert left([(1, p), (2, p), (2, q)]) == [("1", p), ("2", q)]
    assert left([(1, p + "\n" + q), (None, p + "\n" + r)]) == [("1", p + "\n" + q), ("None", r)]
    got = repeated_paragraphs(docs(spark, [(3, p), (3, q + "\n" + p), (None, p + " x")])).collect()
    assert len(got) == 3 and sum(x.kept for x in got) == 1 and {x.doc_id for x in got} == {3, None}


def test_words_between_shared_runs_stay(spark):
    a, b = prose(1, 20), prose(2, 20)
    rows = [(i, prose(1000 + i, 60) + " " + a + " " + prose(3000 + i, 11) + " " + b + " " + prose(5000 + i, 60)) for i in range(130)]
    assert {(r.doc_id, r.text) for r in drop_repeated_paragraphs(docs(spark, rows)).collect()} == set(rows)


def test_empty_table(spark):
    assert repeated_paragraphs(docs(spark, [])).count() == 0 and drop_repeated_paragraphs(docs(spark, [])).count() == 0


def _earlier(rows, across):
    """(doc, line, word) of all words in runs of 50 that occur earlier in another line, by brute force."""
    seen, out = {}, set()
    for doc, text in sorted(rows):
        lines = [[(w, doc, i, k) for k, w in enumerate(words(p))] for i, p in enumerate(text.split("\n"))]
        for seq in [sum(lines, [])] if across else lines:
            for k in range(len(seq) - 49):
                run = seq[k : k + 50]
                d, i, at = seen.setdefault(tuple(x[0] for x in run), (doc, run[0][2], k))
                if d != doc or i != run[0][2] and at + 50 <= k:
                    out.update(x[1:] for x in run)
    return out


def _removed(spark, rows):
    return {(r.doc_id, r.para, r.first + k) for r in repeated_paragraphs(docs(spark, rows)).where("words is not null").collect() for k in range(r.words)}


def test_passages_go_to_their_ends(spark):
    shared = [prose(800 + i, 50 + 3 * i) for i in range(12)]
    rows = [(i, prose(i, 90) + " " + shared[i % 12] + " " + prose(200 + i, 95)) for i in range(36)]
    rows += [(40 + i, prose(600 + i, 80) + " " + " ".join(shared[i].split()[: 50 + i]) + " " + prose(700 + i, 80)) for i in range(12)]
    rows.append((90, "İİ " + prose(900, 70) + " " + shared[3] + " " + prose(901, 70)))
    want = _earlier(rows, False)
    assert len(want) > 24 * 50 and _removed(spark, rows) == want
    left = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs(spark, rows)).collect()}
    assert left[90] == "İİ " + prose(900, 70) + "  " + prose(901, 70)


def test_passages_across_lines(spark):
    def wrapped(seed, n, width):
        w = prose(seed, n).split()
        return "\n".join(" ".join(w[k : k + width]) for k in range(0, n, width))

    rows = []
    for i in range(8):
        rows += [(i, prose(i, 30) + "\n" + wrapped(800 + i, 60 + i, 7) + "\n\n" + wrapped(100 + i, 40, 9))]
        rows += [(20 + i, wrapped(200 + i, 33, 5) + "\n\n" + prose(300 + i, 9) + " " + wrapped(800 + i, 60 + i, 11) + " " + prose(400 + i, 12) + "\nend")]
        rows += [(40 + i, prose(500 + i, 30) + "\n" + prose(800 + i, 60 + i) + " " + prose(600 + i, 70))]
    rows.append((60, prose(0, 30) + "\n" + wrapped(700, 30, 8)))  # a copied line
    want = _earlier(rows[:-1], True)
    assert len(want) >= 16 * 60 and _removed(spark, rows) == want
    left = {r.doc_id: r.text for r in drop_repeated_paragraphs(docs(spark, rows)).collect()}
    for i in range(8):
        assert left[i] == rows[3 * i][1]
        assert words(left[20 + i]) == words(" ".join([prose(200 + i, 33), prose(300 + i, 9), prose(400 + i, 12), "end"]))
        assert words(left[40 + i]) == words(prose(500 + i, 30) + " " + prose(600 + i, 70))
    assert left[60] == wrapped(700, 30, 8)


def test_texts_that_lose_a_line_are_shuffled_once_for_it(spark):
    rows = [(i, prose(i, 20_000, 10**6) + "\n" + prose(900, 60)) for i in range(20)]
    size, _ = shuffled(spark, lambda: drop_repeated_paragraphs(docs(spark, rows)).write.format("noop").mode("overwrite").save())
    assert size < 2.5 * sum(len(t) for _, t in rows)  # once for the lines' shingles, once to lose them


def test_marks_of_documents_that_lose_no_line_are_not_shuffled_whole(spark):
    rows = [(i, prose(i, 20_000, 10**6)) for i in range(20)] + [(90 + i, prose(900, 60)) for i in range(2)]
    size, _ = shuffled(spark, lambda: drop_repeated_paragraphs(docs(spark, rows)).write.format("noop").mode("overwrite").save())
    marks = sum(len(t.split()) for _, t in rows) // 16
    assert size < 40 * marks  # runs and their places, not the packed marks of each document before them


def test_runs_of_many_documents_travel_together_with_their_words_by_line():
    r = random.Random(5)
    rows = [(d, "\n".join(prose(1000 * d + i, r.choice([0, 1, 2, 5, 30, 120])) for i in range(8))) for d in range(60)]
    rows += [(60, prose(1, PASSAGE)), (61, prose(2, PASSAGE - 1)), (62, "")]
    each = {d: [(i, k) for i, p in enumerate(t.split("\n")) for k in range(len(words(p)))] for d, t in rows}
    gone = {d: [2, 5] if d % 3 == 0 else None for d, _ in rows}
    marks = {d: list(range(0, max(1, len(e) - 19), 7)) for d, e in each.items()}
    batch = pd.DataFrame({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "marks": [marks[d] for d, _ in rows], "gone": [gone[d] for d, _ in rows]})
    frames = list(_around([batch.iloc[:20], batch.iloc[20:]]))
    assert len(frames) == 1  # not one for each document
    want = {}
    for d, e in each.items():
        for at in range(len(e) - PASSAGE + 1):
            run = e[at : at + PASSAGE]
            if any(at <= m <= at + PASSAGE - 20 for m in marks[d]) and not {i for i, _ in run} & set(gone[d] or []):
                lines = sorted({i for i, _ in run})
                want[d, at] = [(i, min(k for x, k in run if x == i), sum(x == i for x, _ in run)) for i in lines]
    got = frames[0]
    assert [(r.doc_id, r.at) for r in got.itertuples()] == sorted(want)
    for r_ in got.itertuples():
        w = want[r_.doc_id, r_.at]
        assert (r_.line, r_.first) == w[0][:2] and (r_.parts is None) == (len(w) == 1)
        assert r_.parts is None or np.frombuffer(r_.parts, PART).tolist() == w
    for some in (got, got[got.parts.isna()], got[got.parts.notna()], got[:0]):
        flat = pd.concat(_parted([some.assign(head_doc=some.doc_id, head_line=some.line)]))
        assert list(flat[["doc_id", "at", "para", "first", "words"]].itertuples(index=False, name=None)) == [(d, at, *x) for d, at in zip(some.doc_id, some["at"]) for x in want[d, at]]
