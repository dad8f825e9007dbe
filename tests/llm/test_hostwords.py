from lakeingest.llm import hostwords as h


def rows(spark, pages):
    return spark.createDataFrame(pages, "page_id int, url string, html string")


def test_urls_and_rules():
    assert h.split_url("HTTP://WWW.Example.COM/En/x?q#f") == ("www.example.com", "/En/x")
    assert h.split_url("x://h?q/://b") == ("h", "") and h.split_url("no host/") == ("", "") and h.split_url(None) == ("", "")
    assert h.split_url("a://É.com#/x") == ("É.com", "")
    of = h.Rules().of
    assert of("a.com", "/") == ("allow", "com/") and of("example.com", "/en/1") == ("block", "example.com/en/")
    assert of("a.example.com", "/en/") == ("block", "example.com/en/") and of("x.www.example.com", "/en/z") == ("allow", "www.example.com/en/")
    assert of("notexample.com", "/en/") == ("allow", "com/") and of("a.net", "/es/x") == ("block", "net/es/")
    assert of("a.net", "/en/") is None and of("a.com", "") is None and of("com", "/x") == ("allow", "com/") and of("", "") is None


def test_segmentation():
    s = h.Segmenter({"cheap": 50, "pills": 40, "the": 900, "there": 100, "rein": 20, "re": 60, "in": 400})
    assert s.split("cheappills") == ["cheap", "pills"] and s.split("therein") == ["there", "in"]
    assert s.split("") == [] and "".join(s.split("zzqx" * 30)) == "zzqx" * 30
    assert s.split("cheapqzqxw")[0] == "cheap"


def test_the_model_judges_what_rules_leave(spark):
    html = "<p>" + "cheap pills good news daily garden " * 40
    pages = [(i, f"http://cheappills{i}.example.com/en/{i}", html) for i in range(30)]
    pages += [(100 + i, f"http://goodnews{i}.com/de/{i}", html) for i in range(30)]
    pages += [(200, "http://pillscheap.org/x/1", html), (201, "http://dailygoodnews.org/de/2", html), (202, None, None), (None, "nothing", ""), (200, "http://pillscheap.org/x/1", html)]
    docs = rows(spark, pages).selectExpr("*", "'x' as host", "'x' as rule", "'x' as word")
    got = h.judge(docs).collect()
    assert len(got) == len(pages)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[200]["verdict"] == "block" and by_id[200]["rule"] is None and by_id[201]["verdict"] == "allow"
    assert (by_id[202]["host"], by_id[202]["path"], by_id[202]["rule"]) == ("", "", None)
    assert {r["verdict"] for r in got if r["page_id"] is not None and r["page_id"] < 100} == {"block"}


def test_without_rules_or_rows(spark):
    assert h.judge(rows(spark, [])).collect() == []
    assert {r["verdict"] for r in h.judge(rows(spark, [(1, "http://a.org/", "x"), (2, "http://b.org/y", None)])).collect()} == {"allow"}
