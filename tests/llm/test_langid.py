import random

from auditlake.llm.langid import Classifier, identify, languages

from .tables import awkward, docs

WORDS = {
    "en": "the and of to in that was his with had which they from this have were their would there been".split(),
    "de": "der die und das nicht sich mit dem auf eine auch werden nach einen oder über durch zwischen gegen".split(),
    "fr": "les des est que dans une pour qui pas sur plus avec par sont mais comme nous leurs cette était".split(),
}


def text(lang, seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def rows(n):
    return [(100 * k + i, text(lang, 100 * k + i), lang) for k, lang in enumerate(WORDS) for i in range(n)]


def test_held_out_accuracy(spark):
    known = spark.createDataFrame(rows(60), "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in languages(known).collect()}
    right = sum(got[i] == lang for i, _, lang in rows(60))
    assert right >= 0.98 * len(got)


def test_smallest_wins_and_narrow_margins_are_rejected():
    import zstandard

    content = {k: text(k, 1, 500).encode() for k in WORDS}
    c = Classifier(content)
    t = text("de", 77)
    sizes = {k: len(zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.encode())) for k, v in content.items()}
    assert c.nearest(t.encode()) == min(sizes, key=sizes.get) == "de"
    assert c(t)[0] == "de" and c("12 34")[0] is None
    assert Classifier(content, margin=0.99)(t) == (None, "de", c(t)[2])


def test_the_whole_of_a_long_text_counts():
    content = {k: text(k, 1, 500).encode() for k in WORDS}
    t = text("en", 5, 100) + " " + text("de", 6, 40_000)
    assert Classifier(content)(t)[0] == "de"


def test_awkward_rows(spark):
    d = docs(spark, awkward(), extra=True)
    got = identify(d, {k: text(k, 1, 500).encode() for k in WORDS}).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(awkward()) and by[1].nearest is None and by[2].margin is None
    assert languages(d).count() == len(awkward())


def test_empty_table(spark):
    assert languages(docs(spark, [])).count() == 0


def test_every_sampled_text_is_in_its_dictionary(spark):
    from auditlake.llm.langid import DICTIONARY, PER_LANGUAGE, dictionaries

    rows = [(1000 * k + i, f"{lang}{i}x " + text(lang, i, 400 if i % 3 else 9), lang) for k, lang in enumerate(WORDS) for i in range(PER_LANGUAGE)]
    got = dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    there = [f"{lang}{i % 1000}x ".encode() in got[lang] for i, _, lang in rows]
    assert sum(there) == len(rows)
    assert all(DICTIONARY - 200 <= len(x) <= DICTIONARY for x in got.values())
