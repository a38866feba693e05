import random

from auditlake.llm.common import words
from auditlake.llm.decontaminate import contaminated, decontaminate

from .tables import EXTRA, awkward, docs, prose


def items(spark, rows, extra=False):
    return spark.createDataFrame([(*r, None) if extra else r for r in rows], "item_id long, text string" + (", doc_id long" if extra else ""))


def brute(rows, its, share=0.6, n=5):
    out = {}
    for item, text in its:
        t = words(text)
        if not t:
            continue
        w = min(n, len(t))
        want = {tuple(t[i : i + w]) for i in range(len(t) - w + 1)}
        span, o = len(t) - w + 1, -(-len(want) * 6 // 10)
        for doc, body in rows:
            d = words(body)
            sh = [tuple(d[i : i + w]) for i in range(len(d) - w + 1)]
            best = max((len(want & set(sh[i : i + span])) for i in range(len(sh))), default=0)
            if best >= o:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def _case():
    r = random.Random(4)
    its = [(i, prose(900 + i, 12 + 9 * i)) for i in range(12)] + [(50, "two words"), (51, ""), (52, None), (53, prose(900, 12))]
    rows = [(i, prose(i, 200)) for i in range(40)]
    for i in range(60):
        w = its[i % 12][1].split()
        for _ in range(i // 12 * len(w) // 25):
            w[r.randrange(len(w))] = "changed"
        rows.append((100 + i, prose(300 + i, 30) + " " + " ".join(w).upper() + ", " + prose(400 + i, 40)))
    rows.append((400, "Has two, words."))
    return rows, its


def test_against_brute_force(spark):
    rows, its = _case()
    want = brute(rows, its)
    assert 20 < len(want) < 70
    for limit in (10**6, 0):  # broadcast and shuffled
        got = {(r.doc_id, r.item_id): r.matched for r in contaminated(docs(spark, rows), items(spark, its), broadcast_shingles=limit).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate(docs(spark, rows), items(spark, its)).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}


def test_a_scattered_item_is_no_match(spark):
    t = prose(1, 30).split()
    scattered = " ".join(" ".join(t[i : i + 6]) + " " + prose(70 + i, 200) for i in range(0, 30, 6))
    assert contaminated(docs(spark, [(1, scattered)]), items(spark, [(1, " ".join(t))])).count() == 0


def test_awkward_rows(spark):
    d, b = docs(spark, awkward(), extra=True), items(spark, [(1, prose(3, 80)), (2, None), (3, ""), (None, "word")], extra=True)
    assert {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()} == {(6, 1), (4, None)}
    out = decontaminate(d, b)
    assert out.columns == d.columns and out.count() == len(awkward()) - 3
    assert EXTRA.split()[0] in out.columns


def test_repeated_ids_and_rows_without_id(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 90)
    its = items(spark, [(1, a), (1, b), (2, a)])
    rows = [(5, a), (5, c), (None, c + " " + b), (None, c), (6, b), (6, b)]
    got = contaminated(docs(spark, rows), its).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("5", 1), ("5", 2), ("6", 1), ("None", 1)]
    assert sorted((str(r.doc_id), r.text) for r in decontaminate(docs(spark, rows), its).collect()) == [("5", c), ("None", c)]


def test_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(1, "a text of some words")])
    assert contaminated(none, items(spark, [(1, "a text")])).count() == 0
    assert contaminated(some, items(spark, [])).count() == 0
    assert decontaminate(some, items(spark, [])).count() == 1
