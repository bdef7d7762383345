from sparkwarden.sources import io

DIRTY = """domain,label,extra
a.com,1,x
b.com,0
c.com,1,x,y
,1,z
é.com,1.0,x
d.com,,x
NA,1,x
e.com,abc,x
f.com,nan,x
g.com,inf,x
h.com,-1.9,x
i.com,3000000000,x
j.com,NULL
"k,l.com",1,"x ""q"", y"
m.com,1,x,y,z
"""


def test_one_pass_three_outputs(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes(DIRTY.encode("latin-1"))
    rows, rejects, counts = io.load_labelled(spark, str(tmp_path / "u.csv"), f"{tmp_path}/out")
    assert sorted(map(tuple, rows.collect())) == [("a.com", 1), ("b.com", 0), ("h.com", -1), ("k,l.com", 1), ("é.com", 1)]
    got = sorted(map(tuple, rejects.collect()), key=repr)
    assert [g for g in got if g[0] == io.BAD_LABEL] == [(io.BAD_LABEL, "e.com", "abc"), (io.BAD_LABEL, "g.com", "inf"), (io.BAD_LABEL, "i.com", "3000000000")]
    assert [g for g in got if g[0] == io.TOO_LONG] == [(io.TOO_LONG, None, "c.com,1,x,y"), (io.TOO_LONG, None, "m.com,1,x,y,z")]
    assert sorted(g[1] or "" for g in got if g[0] == io.MISSING) == ["", "", "d.com", "f.com", "j.com"]
    assert counts == {"lines": 15, io.LOADED: 5, io.TOO_LONG: 2, io.MISSING: 5, io.BAD_LABEL: 3}


def test_what_loads_either_way_is_the_same(spark, tmp_path):
    good = "\n".join(x for x in DIRTY.splitlines() if not any(b in x for b in ("abc", "inf", "3000000000")))
    (tmp_path / "u.csv").write_bytes(good.encode("latin-1"))
    rows, skipped = io.labelled_urls(spark, str(tmp_path / "u.csv"))
    again, _, counts = io.load_labelled(spark, str(tmp_path / "u.csv"), f"{tmp_path}/out")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect())) and skipped.count() == counts[io.TOO_LONG] == 2


def test_only_a_header(spark, tmp_path):
    (tmp_path / "u.csv").write_text("label,domain\n")
    rows, rejects, counts = io.load_labelled(spark, str(tmp_path / "u.csv"), f"{tmp_path}/out")
    assert rows.count() == rejects.count() == 0 and set(counts.values()) == {0}


def test_requests_in_one_form(spark):
    raw = [('{"url": "HTTPS://EXAMPLE.com"}',), ('{"url": "https://bücher.de:443/"}',), ('{"url": " http://a.b/c d#é"}',), ('{"url": "ftp://a"}',), ('{"url": 5}',), ('{"x": 1}',), ("junk",), (None,), ('{"url": "http://a.b:x/"}',), ('{"url": "a.b"}',)]
    df = spark.createDataFrame(raw, "value string").withColumn("reason_", io.F.lit("kept"))
    good, bad = io.requests(df)
    assert [r.url for r in good.collect()] == ["https://example.com/", "https://xn--bcher-kva.de/", "http://a.b/c%20d#%C3%A9"] and good.columns == ["value", "reason_", "url"]
    assert sorted((r.reason, r.url or "") for r in bad.collect()) == [("missing", "")] * 3 + [("no scheme", "5"), ("no scheme", "a.b"), ("port", "http://a.b:x/"), ("scheme", "ftp://a")]


def test_reports_and_their_rejects(spark):
    texts = ['{"url": "not a url", "reported_label": 1}', '{"reported_label": 0, "url": ""}', '{"url": "a", "reported_label": "1"}', '{"url": "a", "reported_label": 1.0}', '{"url": "a", "reported_label": 2}', '{"url": "a"}', '{"url": null, "reported_label": 1}', '{"url": 7, "reported_label": 1}', '{"url": "a", "reported_label": 0.5}', '{"url": "a", "reported_label": true}', "[1]", "junk", "", None]
    good, bad = io.reports(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted((r.url, r.reported_label) for r in good.collect()) == [("", 0), ("a", 1), ("a", 1), ("not a url", 1)]
    reasons = [r.reason for r in bad.collect()]
    assert sorted(reasons) == ["json"] * 4 + ["label"] * 4 + ["url"] * 2 and {r.value for r in bad.collect()} == set(texts[4:])
