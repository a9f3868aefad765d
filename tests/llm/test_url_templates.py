"""URL rules and the template tree."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.llm import url_templates as U


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")


ODD = [None, "", "no scheme", "http://", "://", "http://A.Example.COM/DE/x", "http://x.net", "http://x.net/", "ftp://net/a?b#c",
       "http://example.net/en/1", "http://sub.example.net/en", "http://example.netx/en/", "http://notexample.com/de/1",
       "http://example.com/de/?q=/en/", "http://a.org/fr/1", "http://a.org/fr", "http://org/fr/x/y/z/w", "x://ÄB.org#://y",
       "http://h.com:80/p//q/", "http://u@h.org/fr/1", "a://b://c/d"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path, rules):
    hits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(hits, key=lambda r: (len(r.name), r.verdict == "block"), default=None)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in U.judge(pages(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        host, path = split(url)
        rule = ruled(host, path, U.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None), url
        assert got[i].verdict == (rule.verdict if rule else got[i].verdict) and got[i].verdict in ("allow", "block")


def test_equally_long_rules_block(spark):
    rules = (U.Rule("allow", "b.io", "/xx"), U.Rule("block", "a.b.io", "/"))
    row = U.judge(pages(spark, ["http://a.b.io/xx"]), rules).first()
    assert row.verdict == "block"


def labelled(spark, groups):
    """Pages and labels of [(url pattern, bad, good, unlabelled)]."""
    urls, marks = [], []
    for pattern, bad, good, none in groups:
        for mark, count in ((True, bad), (False, good), (None, none)):
            for _ in range(count):
                urls.append(pattern.format(i=len(urls)))
                marks.append((len(urls) - 1, mark))
    return pages(spark, urls), spark.createDataFrame([m for m in marks if m[1] is not None], "page_id bigint, bad boolean")


def verdicts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.template, set()).add(r.verdict)
    return out


def test_templates_follow_their_labels(spark):
    df, marks = labelled(spark, [("http://a.io/spam/{i}", 40, 0, 60), ("http://a.io/news/{i}.html", 0, 40, 60),
                                 ("http://a.io/rare/{i}", 1, 0, 5), ("http://b.io/news/{i}.html", 0, 0, 30)])
    got = verdicts(U.judge(df, (), marks))
    assert got["spam/*/"] == {"block"} and got["news/*.html/"] == {"allow"} and got["rare/*/"] == {"allow"}


def test_variable_segments_become_wildcards(spark):
    word = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    urls = [f"http://a.io/user/{word(i)}" for i in range(100)] + ["http://a.io/user/login"] * 50 + ["http://a.io/faq"] * 9
    got = {r.template for r in U.judge(pages(spark, urls), ()).collect()}
    assert got == {"user/*/", "user/login/", "faq//"}


def test_similar_branches_merge_unless_labels_differ(spark):
    both = [(f"http://a.io/{b}/{{i}}{end}", *counts) for b, counts in
            (("en", (0, 0, 90)), ("fr", (0, 0, 50)), ("de", (30, 0, 0))) for end in ("", ".html")]
    df, marks = labelled(spark, [*both, ("http://a.io/blog/{i}/edit", 0, 0, 60)])
    got = verdicts(U.judge(df, (), marks))
    assert set(got) == {"en/*/", "en/*.html/", "de/*/", "de/*.html/", "blog/*/edit"}
    assert got["de/*/"] == {"block"} and got["en/*/"] == {"allow"}


def test_repeated_and_empty(spark):
    df = pages(spark, ["http://a.io/x"] * 3).withColumn("page_id", F.lit(None).cast("bigint"))
    df = df.withColumn("verdict", F.lit("x")).withColumn("host", F.lit("x"))
    assert [r.verdict for r in U.judge(df).collect()] == ["allow"] * 3
    assert U.judge(pages(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sql(spark, seed):
    import random
    rng = random.Random(seed)
    urls = [rng.choice(ODD) for _ in range(40)]
    for _ in range(900):
        host = rng.choice(["a.example.net", "b.example.com", "c.org", "big.org", "big.org", "d.io"])
        path = "/".join(rng.choice(["en", "fr", "de", "p" + rng.choice("abcdefghijklmnopqrstuvwxyz") * 2, str(rng.randint(0, 99)),
                                    "x.html", ""]) for _ in range(rng.randint(0, 5)))
        urls.append(f"https://{host}/{path}" + rng.choice(["", "?a=1", "#t"]))
    tree = U.Tree(max_children=5)
    got = U.judge(pages(spark, urls), tree=tree).toPandas()
    con = duckdb.connect()
    table = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    con.register("pages", table)
    want = con.execute(U.oracle(tree=tree)).df()[list(got.columns)]
    key = ["page_id"]
    left, right = (x.sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for x in (got, want))
    for c in got.columns:
        if c == "purity":
            assert (left[c].astype(float) - right[c].astype(float)).abs().max() < 1e-5
        else:
            assert left[c].tolist() == right[c].tolist(), c


def test_no_python_on_the_main_path(spark):
    plan = U.judge(pages(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_whole_path_counts(spark):
    df, marks = labelled(spark, [("http://a.io/a/b/spam/{i}/2", 200, 0, 0), ("http://a.io/a/b/news/{i}/2", 0, 200, 0),
                                 ("http://a.io/a/b/c/d/e/f/bad/{i}", 60, 0, 0), ("http://a.io/a/b/c/d/e/f/fine/{i}", 0, 60, 0)])
    got = verdicts(U.judge(df, (), marks))
    assert got["a/b/spam/*/*"] == {"block"} and got["a/b/news/*/*"] == {"allow"}
    assert got["a/b/c/d/e/f/bad/*"] == {"block"} and got["a/b/c/d/e/f/fine/*"] == {"allow"}


def test_pages_without_labels_weigh_nothing(spark):
    """However many there are of them, and if all pages are repeated."""
    seen = set()
    for none in (1, 21, 2000):
        df, marks = labelled(spark, [("http://a.io/bad/{i}", 400, 0, 0), ("http://a.io/other/{i}", 0, 0, none)])
        rows = U.judge(df, (), marks).select("template", "purity", "verdict").distinct().collect()
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1
    groups = [("http://a.io/spam/{i}", 40, 0, 60), ("http://a.io/news/{i}.html", 0, 40, 60), ("http://a.io/q/x/{i}", 0, 0, 7)]
    once = verdicts(U.judge(*_with_marks(spark, groups, 1)))
    assert once == verdicts(U.judge(*_with_marks(spark, groups, 10))) == verdicts(U.judge(*_with_marks(spark, groups, 100)))


def _with_marks(spark, groups, times):
    df, marks = labelled(spark, [(p, times * b, times * g, times * n) for p, b, g, n in groups])
    return df, (), marks


def test_branches_alike_merge_at_every_level_beside_a_larger_unlike_one(spark):
    word = "abcdefghijklmnopqrst"
    urls = [f"http://a.io/static/{w}.css" for w in word for _ in range(30)]  # the largest branch
    for lang, pages_ in (("en", 40), ("fr", 30), ("de", 25)):
        urls += [f"http://a.io/{lang}/story/{i}" for i in range(pages_)] + [f"http://a.io/{lang}/tag/{i}" for i in range(pages_ // 2)]
    for year, pages_ in (("old", 30), ("new", 20)):  # alike one level further down
        urls += [f"http://b.io/x/{year}/post/{i}/view" for i in range(pages_)]
    urls += [f"http://b.io/x/shop/{w}" for w in word for _ in range(4)]
    got = {r.template for r in U.judge(pages(spark, urls), ()).collect()}
    assert {t for t in got if "story" in t or "tag" in t} == {"en/story/*"}  # languages, and the two alike parts of each
    assert {t for t in got if "post" in t} == {"x/old/post/*/view"}
    assert any(t.startswith("static/") for t in got) and any(t.startswith("x/shop/") for t in got)


def test_a_very_long_url(spark):
    long = "http://a.io/" + "/".join(f"s{'x' * (i % 9)}" for i in range(20_000))
    rows = U.judge(pages(spark, [long, long + "?q", "http://a.io/s"])).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3 and max(len(r.template) for r in rows) > 20_000
