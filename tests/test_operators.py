"""Rules of single operators on small literal inputs."""

import re

from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.functions import vectors as V
from auditlake.operators import calibration, cases, discovery, exposure, fusion, handles, identity, images, pii, search
from auditlake.operators.ordering import cap, keep_first, keep_last, tasks
from auditlake.sources.tables import platforms
from auditlake.streaming import breaker


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", list: "array<double>", type(None): "string", bool: "boolean"}
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return d.select(column).first()[0]


def test_spans_are_those_of_the_text(spark):
    t = "call +1 415 555 0101 or 020 7946 0958, not 12"
    got = one(spark, T.spans(F.col("t"), T.PHONE), t=t)
    assert [(t[m.start - 1 : m.start - 1 + len(m.value)], m.value) for m in got] == [(m.group(), m.group()) for m in re.finditer(T.PHONE, t)]
    assert one(spark, T.spans(F.col("t"), T.PHONE), t=None) is None and one(spark, T.spans(F.col("t"), T.PHONE), t="") == []


def test_digits_after_a_letter_are_no_number(spark):
    t = "nation23129138 or \u00e923129138 lives here, call +1 415 555 0101; mobile:41555501, x5 020 7946 0958"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert [r.raw for r in pii.phones(d).orderBy("start").collect()] == ["+1 415 555 0101", "41555501", "020 7946 0958"]
    s = spark.createDataFrame([(1, "u1", "sam nation23129138 lives in Asia, works at X Labs; please call +1 415 555 0101 or write to a@b.example")], "doc_id long, url string, text string")
    who = spark.createDataFrame([(1, True)], "subject_id long, authorized boolean")
    assert [r.value for r in pii.findings(s, who).where("type = 'Phone'").collect()] == ["+1 415 555 0101"]


def test_numbers_that_are_dates_or_counters(spark):
    flag = lambda x: one(spark, T.date_or_counter(F.col("t")), t=x)
    assert flag("20240131") and flag("2024-01-31") and flag("11111111") and not flag("+1-415-555-0101") and not flag("41555501")


def test_urls(spark):
    assert one(spark, U.ensure_https(F.col("t")), t=" http://A.example/x ") == "https://A.example/x"
    assert one(spark, U.ensure_https(F.col("t")), t="a.example") == "https://a.example"
    assert one(spark, U.canonical_key(F.col("t")), t="https://A.example/P/?utm_source=x&k=V&ref=1#f") == "https://a.example/p/?k=v"
    assert one(spark, U.canonical_key(F.col("t")), t="https://A.example/P/?ref=1#f") == "https://a.example/p"
    assert one(spark, U.registrable_domain(F.col("t")), t="https://www.a.b.example.org:80/x") == "example.org"
    assert one(spark, U.unwrap_redirect(F.col("t")), t="https://s.example/l?x=1&uddg=https%3A%2F%2Fa.example%2Fb") == "https://a.example/b"
    assert one(spark, U.unwrap_redirect(F.col("t")), t="mailto:x") is None


def test_token_boundaries(spark):
    has = lambda t, k: one(spark, T.contains_token(F.col("t"), F.col("k")), t=t, k=k)
    assert has("I am Alex.", "alex") and not has("Alexander", "alex") and not has("x", "") and has("alex", "ALEX")


def test_order_decides(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("A", 1, "y"), ("b", 3, None), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(d, ["lower(k)"], ["o"]).collect()), key=str) == [("A", 1, "y"), ("b", 3, None)]
    assert sorted(map(tuple, keep_last(d, ["k"], ["o"]).collect()), key=str) == [("A", 1, "y"), ("a", 2, "x"), ("b", 3, None)]
    assert cap(d, ["k"], ["o"], 1).count() == 3 and cap(d.limit(0), ["k"], ["o"], 1).count() == 0


def test_personal_data(spark):
    d = spark.createDataFrame([(1, "Mail A@b.org, a@B.org; lives in New York and works at Acme Corp."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.value) for r in pii.emails(d).collect()] == [(1, "A@b.org")]
    assert {(r.type, r.value) for r in pii.places(d).collect()} == {("Location", "New York"), ("Organization", "Acme Corp")}
    assert pii.phones(d).count() == 0


IDENT = "subject_id long, full_name string, handles array<string>, aliases array<string>, emails array<string>, phones array<string>, organizations array<string>, locations array<string>, profile_urls array<string>"


def ident(spark, i=1, name="Jane Q. Doe", handles=("jd",), aliases=(), emails=(), phones=(), organizations=(), locations=(), urls=()):
    return spark.createDataFrame([(i, name, *map(list, (handles, aliases, emails, phones, organizations, locations, urls)))], IDENT)


def names_of(spark, d):
    return [(r.username, r.match) for r in identity.all_seeds(d).orderBy("ord").collect()]


def test_name_forms(spark):
    got = [u for u, _ in names_of(spark, ident(spark))]
    assert got[:6] == ["jd", "janedoe", "jane.doe", "jane_doe", "jane-doe", "doe.jane"] and "janeqdoe" in got and "jane.q.doe" in got
    assert names_of(spark, ident(spark, name="Solo", handles=())) == [("solo", "Exact")]
    assert names_of(spark, ident(spark, name=" ", handles=())) == []
    assert names_of(spark, ident(spark, name="", handles=("jane doe",))) == [("jane doe", "Exact"), ("jane_doe", "Underscore"), ("jane-doe", "Hyphen"), ("jane.doe", "Dot"), ("janedoe", "Exact")]
    assert names_of(spark, ident(spark, name="", handles=(), emails=("Jane.Doe+tag@x.org", "nomail"))) == [("jane.doe", "Exact"), ("jane_doe", "Underscore"), ("jane-doe", "Hyphen"), ("janedoe", "Exact"), ("jane", "Fuzzy"), ("doe", "Fuzzy")]


def test_candidates_of_single_names_are_few(spark):
    d = ident(spark, name="Solo", handles=())
    got = {(r.platform, round(r.confidence, 2)) for r in identity.candidates(identity.all_seeds(d), d, platforms(spark)).collect()}
    assert got == {("GitHub", 0.35), ("Reddit", 0.35)}
    s = identity.supplied(ident(spark, urls=("netflix.com/x", "https://nowhere.example/y")), platforms(spark)).collect()
    assert {(r.platform, r.confidence) for r in s} == {("X", 1.0), ("Website", 1.0)}


def test_index_score_without_contact_data(spark):
    hit = spark.createDataFrame([(1, 0, "a", "https://blog.example/x", "nothing", "at all", "q")], "subject_id long, ord int, source string, url string, title string, snippet string, query string")
    one_ = search.one_hit(hit)
    for d in (ident(spark), ident(spark, emails=("a@b.org",), phones=("+1 415 555 0101",))):
        assert round(search.index_score(one_, d).first()["index"], 6) == 0.0
    named = search.one_hit(hit.withColumn("title", F.lit("Jane Q. Doe")))
    assert round(search.index_score(named, ident(spark)).first()["index"], 6) == round(0.08 + 0.30 + 0.18, 6)


def test_one_hit_keeps_title_and_snippet_together(spark):
    rows = [(1, 0, "A", "https://x.example/p?ref=1", "long title here", "s", "q"), (1, 1, "B", "https://x.example/p", "t", "a much longer snippet than that", "q"), (1, 2, "A", "https://x.example/p/", "t", "x", "q")]
    r = search.one_hit(spark.createDataFrame(rows, "subject_id long, ord int, source string, url string, title string, snippet string, query string")).first()
    assert (r.title, r.snippet, r.sources, r.providers) == ("t", "a much longer snippet than that", "A+B", 2)


def test_direct_scores(spark):
    def score(text, url="https://x.example/p", **k):
        d = ident(spark, **k).withColumns({"page_url": F.lit(url), "text": F.lit(text)})
        r = search.direct_score(d).first()
        return round(r.direct, 2), r.ceiling, r.signals

    assert score("hello") == (0.0, 0.48, 0)
    assert score("by Jane Q. Doe") == (0.34, 0.60, 1)
    assert score("Doe and Jane met jd", url="https://x.example/JD/") == (round(0.50 + 0.14 + 0.24, 2), 0.95, 3)
    assert score("write a@b.org", emails=("A@b.org",)) == (0.72, 0.97, 1)
    assert score("x", url="https://www.x.example/me/", urls=("x.example/me",)) == (0.95, 0.99, 1)
    assert score("jdx and ajd") == (0.0, 0.48, 0)


def test_belonging(spark):
    def mine(text, username="other", url="https://x.example/other", **k):
        d = ident(spark, **k).withColumns({"username": F.lit(username), "url": F.lit(url), "text": F.lit(text)})
        return d.select(search.belongs(d, "username", "url", "text")).first()[0]

    assert mine("", username="JD") and mine("jane met doe") is True and mine("nobody") is False
    assert mine("", url="https://X.example/a", urls=("https://x.example/A",))
    assert mine("solo here", name="Solo", handles=()) is False and mine("solo here", name="Solo", handles=(), emails=("q@w.org",)) is True
    assert mine("", username="jane.doe99") and not mine("", username="jdoe")
    assert mine("in Paris", name="Solo", handles=(), locations=("Paris",)) is False and mine("in Paris", locations=("Paris",)) is True


def test_profile_urls(spark):
    def of(u):
        r = one(spark, P.resolved(F.col("u")), u=u)
        return r and (r["platform"], r["handle"])

    assert of("https://twitter.com/jack") == ("X", "jack") and of("http://www.github.com/@Octo/repo?x=1") == ("GitHub", "Octo")
    assert of("https://old.reddit.com/user/abc/comments") == ("Reddit", "abc") and of("https://github.com/settings") is None
    assert of("https://news.ycombinator.com/user?id=pg") == ("HackerNews", "pg") and of("https://www.youtube.com/@chan/videos") == ("YouTube", "chan")
    assert of("https://netflix.com/title") is None and of("https://github.com/") is None and of("nonsense") is None and of(None) is None
    assert one(spark, P.handle_in_url(F.col("u"), F.lit("ann")), u="https://x.example/joanna") is False
    assert one(spark, P.handle_in_url(F.col("u"), F.lit("Ann")), u="https://x.example/u?id=ann") is True


def test_mentions_and_pivots(spark):
    text = "also on twitch as samplecaster, reddit: @sampleuser and https://github.com/sampledev). Find me at https://x.example/me; mail me@users.noreply.github.com"
    pages = spark.createDataFrame([(1, "https://github.com/own", text)], "subject_id long, url string, text string")
    said = {(r.handle, r.platform) for r in handles.mentions(pages, ["subject_id"]).collect()}
    assert {("samplecaster", "Twitch"), ("sampleuser", "Reddit")} <= said
    none = spark.createDataFrame([(1, "https://www.twitch.tv/SAMPLECASTER")], "subject_id long, url string")
    got = {(r.platform, r.username, r.confidence) for r in handles.pivots(pages, none, platforms(spark)).collect()}
    assert ("GitHub", "sampledev", 0.7) in got and ("Reddit", "sampleuser", 0.6) in got and not any(p == "Twitch" and u.lower() == "samplecaster" for p, u, _ in got)


def test_image_hashes(spark):
    import numpy as np

    r = np.random.default_rng(1)
    img = r.integers(0, 256, (40, 60, 3)).astype(float)
    v = images.luma(images.scaled(img, 32, 32))
    low = [[sum(v[y, x] * np.cos((2 * x + 1) * u * np.pi / 64) * np.cos((2 * y + 1) * w * np.pi / 64) for y in range(32) for x in range(32)) * 0.25 * (2**-0.5 if u == 0 else 1) * (2**-0.5 if w == 0 else 1) for u in range(8)] for w in range(8)]
    flat = np.array(low).ravel()
    want = sum(1 << i for i, x in enumerate(flat) if i and x >= sorted(flat[1:])[31])
    assert images.perceptual_hash(img) & (1 << 64) - 1 == want
    assert abs(sum(images.color_histogram(img)) - 1) < 1e-9 and len(images.crops(img)) == 3 and len(images.crops(img[:, :40])) == 2
    px = lambda a: a.astype("uint8").tobytes()
    near = np.clip(img + r.integers(-3, 4, img.shape), 0, 255)
    d = spark.createDataFrame([(1, 60, 40, px(img)), (2, 60, 40, px(near)), (3, 60, 40, px(img)), (4, 60, 40, px(255 - img)), (5, 1, 1, b"x"), (6, 1, 1, None)], "id long, width int, height int, pixels binary")
    f = images.fingerprints(d).cache()
    got = {(x.query, x.id): x["class"] for x in images.copies(f.where("id = 1").withColumnRenamed("id", "query"), f).collect()}
    assert got[1, 3] == "exact" and got[1, 2] in ("near_exact", "strong") and (1, 4) not in got and (1, 5) not in got
    assert f.where("id in (5, 6)").selectExpr("max(size(variants))").first()[0] == 0


def test_vectors(spark):
    cos = lambda a, b: one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1 and cos([0.0], [1.0]) == 0 and cos([1.0], [1.0, 2.0]) == 0 and cos([], []) == 0
    assert one(spark, V.hash_similarity(F.col("a"), F.col("b")), a=0, b=-1) == 0


def test_threshold_against_brute_force(spark):
    scores = [round((i * 37 % 101) / 101, 4) for i in range(200)] + [0.5] * 20
    d = spark.createDataFrame([(s, False) for s in scores] + [(0.9, True)], "score double, same boolean")
    for rate in (0.0, 0.01, 0.1, 0.5, 1.0):
        allowed = int(rate * len(scores))
        want = -1.0 if allowed == len(scores) else min(s for s in scores if sum(x > s for x in scores) <= allowed)
        r = calibration.threshold(d, rate).first()
        assert (r.allowed, r.threshold) == (allowed, want)
    assert calibration.threshold(d.where("same"), 0.1).count() == 0


def test_calibration(spark):
    rows = [(i / 1000, False) for i in range(1000)] + [(0.5 + i / 2000, True) for i in range(1000)]
    d = spark.createDataFrame(rows, "score float, same boolean")
    r = calibration.calibrated(d, 0.05, 0.001).first()
    assert r.review_false <= 0.05 and r.high_false <= 0.001 and r.review_threshold > 0.949 and r.positives == r.negatives == 1000
    import numpy as np

    assert np.float32(r.high_threshold) == np.nextafter(np.float32(0.998), np.float32(2))
    for bad in ((0.01, 0.05), (2.0, 0.1)):
        try:
            calibration.calibrated(d, *bad)
            raise AssertionError
        except ValueError:
            pass
    got = calibration.rejections(spark.createDataFrame([("blurred",), (None,), ("blurred",), (None,)], "reason string")).first()
    assert (got.reason, got.pairs, got.share) == ("blurred", 2, 0.5)


def test_exposure(spark):
    f = spark.createDataFrame([(1, 1, "Email", "a", "u", 0.29, "High", "in a Breach", ""), (1, 2, "Phone", "b", None, 0.5, "Critical", None, "x"), (1, 3, "Email", "a", "u", 0.3, "Low", None, None)], "case_id long, ord long, type string, value string, url string, confidence float, risk string, snippet string, remediation string")
    c = spark.createDataFrame([(1,), (2,)], "case_id long")
    assert {(r.case_id, r.risk) for r in exposure.overall(f, c).collect()} == {(1, "Critical"), (2, "Low")}
    dims = {(r.case_id, r.dimension): (r.score, r.types) for r in exposure.dimensions(f, c).collect()}
    assert len(dims) == 12 and dims[1, "Contact"] == (100, 2) and dims[1, "Identity"] == (80, 1) and dims[2, "Contact"] == (0, 0)
    leaks = spark.createDataFrame([(2, 1, [])], "case_id long, records int, sources array<string>")
    assert {(r.dimension, r.score) for r in exposure.dimensions(f, c, leaks).where("case_id = 2 and score > 0").collect()} == {("Contact", 80), ("Identity", 80)}
    assert [r.key for r in exposure.top(f).collect()] == [10050, 8029, 2530]
    assert exposure.retained(f, 1).first()[1:] == (1, 1) and exposure.kept(f, 1).first().ord == 1
    assert {(r.case_id, r.tip) for r in exposure.tips(f, c).collect()} == {(1, "email"), (1, "phone"), (1, "credentials"), (2, "none")}
    assert [(r.type, r.fix) for r in exposure.items(f).orderBy("rank").collect()] == [("Phone", "x"), ("Email", exposure.ADVICE["Email"][1]), ("Email", exposure.ADVICE["Email"][1])]
    assert cases.diff(f, f).count() == 0 and cases.diff(f, f.limit(0)).where("change = 'removed'").count() == 3
    surer = f.withColumn("confidence", F.when(F.col("type") == "Phone", F.lit(0.6).cast("float")).otherwise(F.col("confidence")))
    assert [(r.type, r.change, r.delta) for r in cases.diff(f, surer).collect()] == [("Phone", "changed", 0)]
    assert cases.deltas(f, f.where("type = 'Email'"), "value").first()[:] == (1, 0, 1)


def test_paths(spark):
    """The person, an address and a breach; and a chain of ten."""
    v = [(1, "person:jane", "Person", "Jane", 0), (1, "email:j@x.org", "Email", "j@x.org", 1), (1, "breach:b", "Breach", "Alpha", 2), (2, "person:p", "Person", "P", 0)]
    v += [(2, f"profile:{i}", "Profile", f"N{i}", i) for i in range(1, 10)] + [(2, "breach:z", "Breach", "Z", 20), (2, "breach:far", "Breach", "Far", 21)]
    e = [(1, "person:jane", "email:j@x.org", "has_email", 0), (1, "breach:b", "email:j@x.org", "exposes", 1), (2, "person:p", "profile:1", "r", 0)]
    e += [(2, f"profile:{i}", f"profile:{i + 1}", "r", i) for i in range(1, 9)] + [(2, "profile:9", "breach:z", "r", 30)]
    vertices = spark.createDataFrame(v, "case_id long, id string, type string, label string, ord long")
    edges = spark.createDataFrame(e, "case_id long, src string, dst string, relation string, ord long")
    sure = spark.createDataFrame([(1, "person:jane", "email:j@x.org", "has_email", 0.65)], "case_id long, src string, dst string, relation string, score double")
    got = {(r.case_id, r.endpoint): (r.hops, r.steps) for r in fusion.attack_paths(edges, vertices, sure).collect()}
    assert set(got) == {(1, "Alpha"), (2, "Z")} and got[2, "Z"][0] == 10
    assert got[1, "Alpha"] == (2, "Jane -has_email-> j@x.org (0.65) | Alpha -exposes-> j@x.org")
    assert fusion.attack_paths(edges.limit(0), vertices, sure).count() == 0


def test_fusion_makes_a_page_once(spark):
    subjects = spark.createDataFrame([(1, "Jane")], "case_id long, label string")
    none = lambda s: spark.createDataFrame([], s)
    f = spark.createDataFrame([(1, 0, "Email", "a@b.org", "https://x.example/p", 0.5, "s"), (1, 1, "Phone", "12345678", "https://x.example/p", 0.4, None), (1, 2, "SensitiveSnippet", "n", None, 0.4, None)], "case_id long, ord long, type string, value string, url string, confidence float, snippet string")
    v, e = fusion.fused(subjects, none("case_id long, ord long, kind string, value string"), none("case_id long, ord long, url string, username string, platform string, title string, confidence float, there boolean, verified boolean, status string"), none("case_id long, ord long, type string, value string, confidence float, snippet string, of string"), f, none("case_id long, ord long, source string, target string, relation string, evidence string"), none("case_id long, ord long, type string, value string, url string, confidence float, snippet string"), spark.createDataFrame([(1, 0, "A@b.org", 2, ["Alpha"], None)], "case_id long, ord long, email string, records int, sources array<string>, note string"))
    assert {r.id for r in v.collect()} == {"person:jane", "profile:https://x.example/p", "email:a@b.org", "phone:12345678", "breach:a@b.org"}
    got = {(r.src, r.dst, r.relation) for r in e.collect()}
    assert ("person:jane", "profile:https://x.example/p", "related_profile") in got and ("profile:https://x.example/p", "phone:12345678", "mentions") in got and ("email:a@b.org", "breach:a@b.org", "exposed_in") in got
    assert len(got) == 7


def test_page_states(spark):
    state = lambda h: one(spark, discovery.page_state(F.col("h")), h=h)
    assert state("<p>Please solve the CAPTCHA</p>") == "blocked" and state("<p>Page not found</p>") == "not_found" and state("<p>x</p>") == "thin" and state("<p>" + "word " * 30) == "ok" and state(None) is None


def test_confusion(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "s boolean, t boolean")
    r = discovery.confusion(d, "s", "t").first()
    assert (r.precision, r.recall, r.specificity, r.f1) == (0.5, 0.5, 0.5, 0.5)
    assert discovery.confusion(d.limit(0), "s", "t").first().precision == 1.0


def test_breaker_and_stream(spark, tmp_path):
    rows = [(i, 1, f"2024-01-01 00:0{i}:00", k) for i, k in enumerate("FFFSFF")]
    d = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.streak for r in breaker.streaks(d, F.col("event_type") == "F").orderBy("event_id").collect()] == [1, 2, 3, 0, 1, 2]
    e = spark.createDataFrame([(i, "p", float(t), k == "F") for i, (t, k) in enumerate([(0, "F"), (1, "F"), (2, "F"), (50, "S"), (121, "F"), (122, "F"), (123, "S"), (124, "F")])], "event_id long, provider string, at double, failed boolean")
    got = [(r.failures, r.allowed) for r in breaker.breaker(e, "provider").orderBy("event_id").collect()]
    assert got == [(0, True), (1, True), (2, True), (3, False), (3, False), (0, True), (1, True), (0, True)]
    d.write.parquet(f"{tmp_path}/in")
    stream = breaker.windowed_counts(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("F", 5), ("S", 1)}
    delay = lambda a, r=None: one(spark, breaker.retry_delay(F.col("a"), F.lit(r)), a=a)
    assert delay(0) == 737 and delay(10) == 6000 and delay(-3) == 600 + -2 * 137 % 311 - 311 and delay(1, "5") == 5000 and delay(1, "600") == 60_000 and delay(1, "soon") == delay(1)


def test_what_identities_unfold_into_stays_in_tasks_of_bounded_size(spark):
    """Seeds and candidates of a subject are sorted where its identity lies, in tasks of 5000 identities; before, all lay in one task of few bytes, and candidates were shuffled."""
    d = spark.range(12_000).coalesce(1).selectExpr("id as subject_id", "concat('Jane Q', id, ' Doe') as full_name", "array(concat('u', id), concat('U', id)) as handles", *[f"cast(array() as array<string>) as {c}" for c in ("aliases", "emails", "phones", "organizations", "locations", "profile_urls")])
    assert tasks(d, 5_000) == 4 and tasks(d.limit(600), 5_000) == 2 and tasks(d.limit(0), 5_000) == 1 and tasks(d, 1_000) == 12
    seeds = identity.all_seeds(d)
    c = identity.capped(identity.candidates(seeds, d, platforms(spark)), 20)
    parts = c.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("subject_id").alias("n")).collect()
    assert sum(r.n for r in parts) == 12_000 and max(r.n for r in parts) <= 5_000
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of the identities, twice: none of what they unfold into
    assert seeds.where("subject_id = 7").count() == len(names_of(spark, d.where("subject_id = 7")))


def test_keys_that_are_columns_are_kept_as_they_are(spark):
    d = spark.createDataFrame([(None, 2, "x"), (None, 1, "y"), (1, 3, "z")], "k long, o int, v string")
    assert sorted(map(tuple, keep_first(d, ["k", "lower(v)"], ["o"]).collect()), key=str) == sorted([(None, 2, "x"), (None, 1, "y"), (1, 3, "z")], key=str)
    assert sorted(map(tuple, keep_first(d, ["k"], ["o"]).collect()), key=str) == sorted([(None, 1, "y"), (1, 3, "z")], key=str)
