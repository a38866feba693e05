"""Small tables with the awkward cases: nulls, empty and very long texts, repeated rows, clashing column names."""

import random

EXTRA = "id long, fp string, block long, root long, a long, b long, ph string, band int, h long, w int, pos long, n long, host string, gone string, __gone string, k int, rid long, bucket int, shard string, group_id long, kept boolean"


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(n))


def docs(spark, rows, extra: bool = False, ids: str = "doc_id"):
    """Rows of (id, text), with the columns of documents; extra adds columns named like the operators' own."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    schema = f"{ids} long, text string, lang string, source string, n_chars long"
    if not extra:
        return spark.createDataFrame(full, schema)
    n = len(EXTRA.split(","))
    return spark.createDataFrame([r + (None,) * n for r in full], f"{schema}, {EXTRA}")


def awkward():
    """Null id, null text, empty text, blanks, one word, punctuation, repeated rows, a very long text."""
    long_ = prose(1, 30_000)
    return [(None, prose(2, 60)), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "?!"), (6, prose(3, 80)), (6, prose(3, 80)), (7, long_), (8, long_ + " tail"), (9, "naïve Ünïcode 文字 \U0001f600")]


def shuffled(spark, run):
    """(bytes, rows) that run() writes to shuffles, with no join by broadcast of a table for being small."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = context.statusStore().stageList(None, False, False, empty, spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteBytes(), s.shuffleWriteRecords()) for s in (found.apply(i) for i in range(found.size()))}

    key, before = "spark.sql.autoBroadcastJoinThreshold", set(stages())
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        run()
    finally:
        spark.conf.set(key, old)
    return tuple(map(sum, zip(*(v for k, v in stages().items() if k not in before))))
