import json

from newsloom.cli import run

NOW = "2026-01-24 00:00:00"


def test_index_search_and_tools(spark, tmp_path, capsys):
    day = tmp_path / "articles" / "tech" / "2026-01-23"
    day.mkdir(parents=True)
    for n in (1, 2):
        (day / f"a{n}.json").write_text(json.dumps({
            "title": f"Title {n}", "url": f"https://example.com/tech/s{n}?x=1", "category": "tech",
            "content": "Something happened here. " * 10, "published_at": "Jan. 23, 2026",
        }))
    (day / "bad.json").write_text("{")
    root, articles = str(tmp_path / "root"), str(tmp_path / "articles")
    assert run(spark, ["index", "--root", root, "--articles", articles, "--dry-run"]) == 0
    assert run(spark, ["index", "--root", root, "--articles", articles, "--asof", NOW]) == 1  # one file failed
    assert run(spark, ["index", "--root", root, "--articles", articles, "--asof", NOW]) == 0
    assert run(spark, ["index", "--root", root, "--clear-failed"]) == 0
    assert run(spark, ["index", "--root", root]) == 2
    assert "cleared 1 failed entries" in capsys.readouterr().out
    assert run(spark, ["search", "--root", root, "--asof", NOW, "something", "--k", "2"]) == 0
    assert "Title 1" in capsys.readouterr().out
    assert run(spark, ["tool", "--root", root, "--asof", NOW, "trend_analysis", "hours=48", "top_n=1"]) == 0
    assert "文章总数: 2 篇" in capsys.readouterr().out
    assert run(spark, ["backfill", "--articles", articles, "--today", "2026-01-25", "--origin", "https://e.com"]) == 0
    out = capsys.readouterr().out
    assert "https://e.com/news/archive/2026/01/25" in out and "2026/01/23" not in out
    assert run(spark, ["clean-urls", "--articles", articles, "--out", str(tmp_path / "x")]) == 0


def test_extract_writes_article_files(spark, tmp_path):
    html = "<article><h1>Head</h1>" + "".join(f"<p>{c * 60}</p>" for c in "abc") + "</article>"
    spark.createDataFrame([(1, "https://e.com/tech/x?y=1", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    assert run(spark, ["extract", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/out", "--day", "2026-01-24"]) == 0
    row = spark.read.json(f"{tmp_path}/out").first()
    assert row["title"] == "Head" and row["url"] == "https://e.com/tech/x" and row["category"] == "tech"


def test_links(spark, tmp_path):
    html = '<h3><a href="/tech/one?x=1">EXCLUSIVE A long enough title</a></h3><h3><a href="/tech/one">Same page once more</a></h3>'
    spark.createDataFrame([(1, "https://example.com/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    assert run(spark, ["links", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/links", "--origin", "https://example.com"]) == 0
    row = spark.read.parquet(f"{tmp_path}/links").collect()
    assert [(r["title"], r["priority"], r["clean_url"]) for r in row] == [("A long enough title", 0, "https://example.com/tech/one")]


def test_links_leave_out_known_ones_and_keep_to_the_quota(spark, tmp_path):
    link = '<h3><a href="/tech/{0}">{1}A title that is long enough {0}</a></h3>'
    html = "".join(link.format(f"n{k}", "EXCLUSIVE " if k == 7 else "") for k in range(9))
    pages = [(1, "https://example.com/", html), (2, "https://example.com/tech/?p=2", html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("https://example.com/tech/n0?seen",), ("https://example.com/tech/n3",)], "url string").write.parquet(f"{tmp_path}/known")
    asked = ["links", "--pages", f"{tmp_path}/pages", "--origin", "https://example.com", "--known", f"{tmp_path}/known"]
    assert run(spark, [*asked, "--out", f"{tmp_path}/some", "--home-cap", "3", "--cap", "2"]) == 0
    some = spark.read.parquet(f"{tmp_path}/some").orderBy("category", "turn").collect()
    assert [(r["category"], r["clean_url"][-2:]) for r in some] == [
        ("home", "n7"), ("home", "n1"), ("home", "n2"), ("tech", "n7"), ("tech", "n1")]
    assert run(spark, [*asked, "--out", f"{tmp_path}/all", "--no-quota"]) == 0
    assert spark.read.parquet(f"{tmp_path}/all").groupBy("category").count().orderBy("category").collect() == [("home", 7), ("tech", 7)]
