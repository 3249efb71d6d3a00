import numpy as np

from specframe.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("bad.org", "", "block"), ("com", "/", "block"),
         (None, "/", "block"), ("x.com", "no-slash", "block"), ("y.com", "/", "maybe")]


def judged(spark, rows, rules=RULES, **options):
    index = urls.build(spark, spark.createDataFrame(rules, "host string, path string, verdict string"), **options)
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, rule string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, index).collect()}


def test_rules(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/x?q#f"), (2, "http://example.com/de"), (3, "http://notexample.com"), (4, None), (5, "no scheme"),
            (6, "ftp://sub.bad.org?x"), (7, "http://a://b/c"), (8, ""), (9, "x://bad.orgs/"), (10, "http://Ä.com/É"), (11, "http://y.com/")]
    got = judged(spark, [(*r, "v", "r") for r in rows])
    assert got == {
        1: ("www.example.com", "/en/x", "example.com/en/", "block"), 2: ("example.com", "/de", "com/", "block"),
        3: ("notexample.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("sub.bad.org", "", "bad.org", "block"), 7: ("a:", "//b/c", None, "allow"), 8: ("", "", None, "allow"),
        9: ("bad.orgs", "/", None, "allow"), 10: ("Ä.com", "/É", "com/", "block"), 11: ("y.com", "/", "com/", "block")}


def test_many_parts_judge_like_one(spark):
    rules = [(f"h{i}.net", f"/{'p' * (i % 5)}", "block" if i % 2 else "allow") for i in range(300)]
    rows = [(i, f"http://w.h{i % 320}.net/pppp/{i}", "", "") for i in range(500)]
    assert judged(spark, rows, rules) == judged(spark, rows, rules, part_bytes=1000)


def test_no_rules_and_no_pages(spark):
    assert judged(spark, [(1, "http://a.com/", "", "")], [("a", None, "block")]) == {1: ("a.com", "/", None, "allow")}
    assert judged(spark, []) == {}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda text: len(text))
    urls.write_index(f"{tmp_path}/r", [("abc", "block"), ("abd", "allow"), ("zz", "block")])
    found = urls.find(f"{tmp_path}/r", ["abd", "abc", "xyz", "zz", "q", "long one"])
    assert np.array_equal(found >= 0, [True, True, False, True, False, False]) and found[0] != found[1]
