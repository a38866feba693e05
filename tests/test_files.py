"""Sources, sinks and plugins."""

from pyspark.sql import functions as F

from auditlake.operators.plugins import Registry
from auditlake.sources import files, parsers


def test_ranges_and_catalogues(spark):
    d = spark.createDataFrame([("ABCDE", "00aa:3\r\nFFFF:12\nbad line\n:1"), ("00000", ""), ("11111", None)], "prefix string, body string")
    assert {tuple(r) for r in files.range_lines(d).collect()} == {("ABCDE", "00AA", 3), ("ABCDE", "FFFF", 12)}
    c = spark.createDataFrame([('[{"Name":"A","DataClasses":["Emails"]},{"Name":null}]',), ("no json",), (None,)], "body string")
    assert [(r.name, r.title, r.classes) for r in files.breach_catalogue(c).collect()] == [("A", "A", ["Emails"])]


def test_manifest(spark, tmp_path):
    head = "left,right,left_identity,right_identity,same_person,split,demographic_group,device_class"
    (tmp_path / "m.csv").write_text("\n".join([head, "a,b,i1,i1,true,test,g,d", "a,c,i1,i2,true,test,g,d", "a,d,i3,i4,false,calibration,g,d", "e,f,i5,i6,false,other,g,d"]))
    good, bad = files.pair_manifest(spark, str(tmp_path / "m.csv"))
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["identity against label", "unknown split"]
    assert files.shared_identities(good).count() == 0 and files.shared_identities(good.withColumn("left_identity", F.lit("x"))).count() == 1


def test_sealed_cases(spark, tmp_path):
    key, other = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    d = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "case_id long, payload string")
    s = files.sealed(d, key)
    assert "payload" not in s.columns
    s.write.parquet(f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert {(r.case_id, r.payload) for r in files.opened(back, key).collect()} == {(1, "one"), (2, ""), (3, None)}
    assert all(r.payload is None for r in files.opened(back, other).collect())
    files.save_case(d.where("case_id < 3"), str(tmp_path), "t")
    files.save_case(d.where("case_id = 1").withColumn("payload", F.lit("new")), str(tmp_path), "t")
    assert {(r.case_id, r.payload) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "new"), (2, "")}


def test_plugins(spark):
    r = Registry()
    s = spark.createDataFrame([(1, "a")], "id long, v string")
    assert r.run(s, ["id"], ["v"]) == (None, {})
    assert r.register("x", lambda d: d) and not r.register("x", lambda d: d.limit(0))
    r.register("y", lambda d: d.withColumn("v", F.lit("b")))
    r.register("z", lambda d: d.select("missing"))
    got, failed = r.run(s, ["id"], ["v"])
    assert [tuple(x) for x in got.collect()] == [(1, "a")] and list(failed) == ["z"]
    assert r.unregister("y") and not r.unregister("y") and r.ids() == ["x", "z"]


def _shape(e):
    return e if isinstance(e, str) else (e.tag, e.attrs, [_shape(x) for x in e.parts])


def test_plain_pages_have_the_library_parsers_tree():
    pages = ["<html><body><LI class='b x'><a HREF=\"/x?y\">A &amp; b</a><p>c<br>d</div></li></body></html>", "<!DOCTYPE html><p>a</p >b<p class=\"\">c", "", "text"]
    others = ["<script>a<b</script>", "a < b", "<p x=1>", "<a href='?a&copy=1'>", "<br/>", "<!-- c --><p>", "<p"]
    for html in pages + others:
        t = parsers._Tree()
        t.feed(html)
        t.close()
        assert _shape(parsers.tree(html)) == _shape(t.root), html
    assert all(parsers._plain_tree(x) is not None for x in pages) and all(parsers._plain_tree(x) is None for x in others)


def test_hits_ask_few_elements(monkeypatch):
    """Only elements that have a selector's class, attribute or tag are looked at: 60 results with 20 other elements each."""
    asked, plain = [0], parsers.matches

    def counted(e, step):
        asked[0] += 1
        return plain(e, step)

    monkeypatch.setattr(parsers, "matches", counted)
    html = "".join(f'<li class="b_algo"><h2><a href="/{i}">T{i}</a></h2>{"<i>w</i>" * 20}<p>s{i}</p></li>' for i in range(60))
    assert parsers.hits_of("Bing", html) == [(f"/{i}", f"T{i}", f"s{i}") for i in range(60)]
    assert asked[0] <= 60 * 10
