"""Golden values of the column functions."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions import chunking, dates, html as H, providers, render, replies, text as X, urls


def values(spark, inputs, expression):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string").coalesce(1)
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "https://wsite.com/tech/article?mod=nav": "https://wsite.com/tech/article",
        "https://wsite.com/tech/article#section": "https://wsite.com/tech/article",
        "https://wsite.com/tech/article/": "https://wsite.com/tech/article",
        "HTTPS://Host.com/A//": "https://Host.com/A",
        "https://h.com/a;p=1/b;q=2?x=1": "https://h.com/a;p=1/b",
        "https://h.com": "https://h.com",
        "/rel/path/?a=1": "/rel/path",
        "": "",
    }
    assert values(spark, cases, urls.normalize_url) == list(cases.values())
    once = values(spark, cases, urls.normalize_url)
    assert values(spark, once, urls.normalize_url) == once


def test_category_rules(spark):
    cases = {
        "https://x.com/world/china/a": "china",
        "https://x.com/world/americas/a": "world",
        "https://x.com/articles/a": "miscellaneous",
        "https://x.com/sports/a": "sports",
        "https://x.com/opinion/free-expression/x": "opinion",
        "https://x.com/US-News/a": "us",
        "https://x.com/a/b": "uncategorized",
    }
    assert values(spark, cases, urls.infer_category) == list(cases.values())


def test_article_url_rule(spark):
    check = lambda c: urls.is_article_url(c, "site.com")
    cases = {
        "https://www.site.com/tech/story": True,
        "https://notsite.com/tech/story": True,  # a suffix match, as documented
        "https://other.org/tech/story": False,
        "https://www.site.com/tech": False,
        "/tech/story": True,
        "https://www.site.com/tech/story?next=/video/x": False,
        "https://www.site.com/digital-print-edition-x/y": False,
    }
    assert values(spark, cases, check) == list(cases.values())


def test_slug(spark):
    cases = {
        "https://x.com/a/the-story_1!.html?x=1": "the-story_1html",
        "https://x.com/a/" + "y" * 90: "y" * 80,
        "https://x.com/a/über-straße/": "über-straße",
    }
    assert values(spark, cases, urls.slug) == list(cases.values())


def test_exclusive_prefix(spark):
    cases = {
        "EXCLUSIVE\nThe Best and Worst Airlines of 2025": "The Best and Worst Airlines of 2025",
        "EXCL: Someone Lists a House": "Someone Lists a House",
        "exclusive  lower": "lower",
        "Not EXCLUSIVE here": "Not EXCLUSIVE here",
    }
    assert values(spark, cases, urls.strip_exclusive_prefix) == list(cases.values())
    assert values(spark, cases, urls.link_priority) == [0, 0, 0, 1]


@pytest.mark.parametrize("written, expected", [
    ("Updated Jan. 23, 2026 4:39 pm ET", "2026-01-23T16:39:00"),
    ("Jan. 23, 2026", "2026-01-23T00:00:00"),
    ("January 23, 2026 at 4:39 pm ET", "2026-01-23T16:39:00"),
    ("2026-01-23T16:39:00Z", "2026-01-23T16:39:00"),
    ("2026-01-23T16:39:00-05:00", "2026-01-23T16:39:00"),
    ("2026-01-23T16:39", "2026-01-23T16:39:00"),
    ("2026-01-23T16:39:00.250000", "2026-01-23T16:39:00.250000"),
    ("23 Jan 2026", "2026-01-23T00:00:00"),
    ("Sept. 3 2025 12:05 AM EST", "2025-09-03T00:05:00"),
    ("Dec 31, 2025 12:05 pm", "2025-12-31T12:05:00"),
    ("May 5, 2025 9:00 am", "2025-05-05T09:00:00"),
    ("May. 5, 2025", None),
    ("Jan 5, 2025 13:05 pm", "2025-01-05T00:00:00"),  # 25 o'clock: date only
    ("Feb 30, 2025", None),
    ("7 hours ago", None),
    ("", None),
    (None, None),
])
def test_dates(spark, written, expected):
    assert values(spark, [written], lambda c: dates.iso_text(dates.parse_date(c))) == [expected]


def test_relative_days(spark):
    today = F.lit("2024-03-01").cast("date")
    asked = ["", "today", "今天", "Yesterday", "昨天", "2024-02-29", "2024-02-30", "soon"]
    day = dt.date
    assert values(spark, asked, lambda c: dates.resolve_day(c, today)) == [
        day(2024, 3, 1)] * 3 + [day(2024, 2, 29)] * 3 + [None, None]
    assert values(spark, ["2024-01-05"], lambda c: dates.display_day(c.cast("date"))) == ["2024年1月5日（星期五）"]


def test_sentences(spark):
    cases = ["One. Two!  Three?\nFour", "中文。没有空格！一句", "中文。 两句！ 好", "  ", "a.b c. d"]
    assert values(spark, cases, X.sentences) == [
        ["One.", "Two!", "Three?", "Four"], ["中文。没有空格！一句"], ["中文。", "两句！", "好"], [], ["a.b c.", "d"],
    ]
    assert values(spark, cases, lambda c: X.lead(c, 2)) == ["One. Two!", "中文。没有空格！一句", "中文。 两句！", "", "a.b c. d"]


def test_white_space(spark):
    cases = ["  a  b\x1f", "x", "\t\n", " a  b\n\nc "]
    assert values(spark, cases, X.strip) == [c.strip() for c in cases]
    assert values(spark, cases, X.squeeze) == [re.sub(r"\s+", " ", c.strip()) for c in cases]


def test_windows_and_sizes(spark):
    text = "abcdefghij"
    assert values(spark, [text, ""], lambda c: X.windows(c, 4, 1)) == [["abcd", "defg", "ghij", "j"], []]
    assert values(spark, [text], lambda c: X.windows(c, 2, 3)) == [[]]
    with pytest.raises(ValueError):
        X.windows(F.lit(""), 3, 3)
    assert values(spark, ["x" * 9, "", None], X.token_estimate) == [2, 0, 0]
    assert values(spark, ["x" * 9, "x" * 8], lambda c: X.truncate_tokens(c, 2)) == ["x" * 5 + "...", "x" * 8]
    assert values(spark, ["x" * 5, "x" * 3], lambda c: X.preview(c, 3)) == ["xxx...", "xxx"]


def test_stream_slices(spark):
    out = values(spark, ["a" * 25 + "\nb", ""], X.stream_slices)
    assert out == [["a" * 20, "a" * 5 + "\n", "b\n"], ["\n"]]
    assert "".join(out[0]) == "a" * 25 + "\nb\n"


def slow_chunks(sentences, size, overlap):
    """The packing rule written out with lists."""
    chunks, current, used = [], [], 0
    for s in sentences:
        if len(s) > size:
            if current:
                chunks.append(" ".join(current))
            current, used = [], 0
            at = 0
            while at < len(s):
                chunks.append(s[at:at + size])
                at += size - overlap
        else:
            if current and used + len(s) > size:
                chunks.append(" ".join(current))
                tail, room = [], 0
                while current and room + len(current[-1]) <= overlap:
                    last = current.pop()
                    tail.insert(0, last)
                    room += len(last) + 1
                current, used = tail, room
            current.append(s)
            used += len(s) + 1
    return chunks + ([" ".join(current)] if current else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(5, 50), st.integers(0, 30))
def test_chunks_follow_the_rule(lengths, size, overlap):
    overlap = min(overlap, size - 1)
    sentences = ["x" * (n - 1) + "." for n in lengths]
    chunks = chunking.chunk_text(" ".join(sentences), size, overlap)
    assert chunks == slow_chunks(sentences, size, overlap)
    for sentence in sentences:
        assert len(sentence) > size or any(sentence in chunk for chunk in chunks)


def test_chunk_defaults(spark):
    long = "word " * 1000 + "end."
    out = values(spark, [long, "  ", None, "Short one. Two."], chunking.chunks)
    assert [len(c) for c in out[0]] == [2048, 2048, 1308]
    assert out[1:] == [[], [], ["Short one. Two."]]
    assert values(spark, [long], lambda c: chunking.chunks(c, 0, 0)) == [out[0]]  # 0 means default


def test_embedding(spark):
    vector = providers.embed_text("market market news")
    assert abs(sum(v * v for v in vector) - 1) < 1e-6
    out = values(spark, ["market news market", " ", None, "the of"], providers.embedding)
    assert out[0] == vector  # word order does not matter
    assert out[1] is None and out[2] is None and set(out[3]) == {0.0}
    with pytest.raises(ValueError):
        providers.embed_text("  ")


def test_retrying_embedder():
    class Flaky(providers.WordHistogram):
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise OSError("down")
            return super().embed(texts)

    waits = []
    assert providers.Retrying(Flaky(), 3, 1.0, waits.append).embed(["a b"]).shape == (1, 64)
    assert waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        providers.Retrying(Flaky(), 2, 1.0, waits.append).embed(["a"])


def test_generated_summaries_survive_failures(spark):
    def generate(prompt):
        if "bad" in prompt:
            raise OSError("no")
        return "S"

    model = providers.GeneratedSummaries(generate)
    assert values(spark, ["good", "bad", " "], model.chunk) == ["S", None, ""]


def test_replies(spark):
    evaluation = lambda c: F.to_json(replies.parse_evaluation(c))
    out = values(spark, ['{"score": 9, "reason": "r"}', "```json\n{\"score\": 2}\n```", "nope", "text {\"score\": 4} more", '{"reason": "x"}'], evaluation)
    assert [re.search(r'"score":(\d)', o).group(1) for o in out] == ["5", "2", "3", "4", "3"]
    intent = lambda c: F.to_json(replies.parse_intent(c, F.lit("raw")))
    out = values(spark, ['{"search_query": "q", "mode": "recent", "hours_ago": 24}', "broken {"], intent)
    assert '"search_query":"q","mode":"recent"' in out[0] and '"hours_ago":24' in out[0]
    assert '"search_query":"raw","mode":"hybrid"' in out[1]
    angles = values(spark, ['{"angles": []}'], lambda c: F.size(replies.parse_angles(c, F.lit("t"))))
    assert angles == [4]
    assert values(spark, ["a, b ,,c", "a", "a,b,c,d,e"], replies.topic_list_error) == [None, "at least 2 topics", "at most 4 topics"]


PAGE = """<html><head><title>T &amp; x</title><script>var a="</p><h1>no</h1>";</script></head><body>
<div aria-label="exclusive tag"></div><h3><a href="/tech/one">EXCLUSIVE First long title</a></h3><h3><a href="https://x.com/tech/two">Second</a></h3>
<h1 data-testid="headline">Head &quot;line&quot;</h1><h2 data-testid="dek-block">Sub</h2><p data-testid="byline">By Ann B</p>
<time>Jan. 1, 2026</time><article><p data-type="paragraph">%s</p><p data-type="paragraph">Advertisement and more text here</p>
<p data-type="paragraph">%s<p data-type="paragraph">%s</article></body></html>""" % ("a" * 40, "b" * 30, "c" * 25)


def test_html_fields(spark):
    clean = H.without_noise(F.col("v"))
    take = lambda f: values(spark, [PAGE], lambda c: f(H.without_noise(c)))[0]
    assert take(H.title_tag) == "T & x"
    assert take(H.headline) == 'Head "line"'
    assert take(H.subtitle) == "Sub" and take(H.byline) == "Ann B" and take(H.timestamp_text) == "Jan. 1, 2026"
    assert take(H.is_exclusive) is True
    assert take(H.body_text) == "\n\n".join(["a" * 40, "b" * 30, "c" * 25])
    links = take(lambda h: H.anchors(h, "h3"))
    assert [(l["href"], l["text"]) for l in links] == [("/tech/one", "EXCLUSIVE First long title"), ("https://x.com/tech/two", "Second")]
    plain = "<article><p>%s</p><p>short</p><p>Write to %s</p><p>%s copyright</p></article>" % ("a" * 31, "b" * 40, "c" * 40)
    assert values(spark, [plain], H.body_text) == ["a" * 31]


def test_result_block(spark):
    row = spark.createDataFrame([("T", None, "2026", "", "c" * 501, "u", None, True)],
                                "title string, category string, published_at string, summary string, content string, url string, score double, is_exclusive boolean")
    block = row.select(render.result_text(F.col).alias("b")).first()["b"]
    assert block.split("\n") == ["Title: T [EXCLUSIVE]", "Category: N/A", "Published: 2026", "Summary: N/A",
                                 "Content: " + "c" * 500 + "...", "URL: u", "Relevance Score: N/A"]


def test_clamps_and_months():
    assert C.clamp("query_results", 99) == 20 and C.clamp("research_results", 0) == 3
    months = C.MONTH_NUMBERS
    assert months["sept."] == 9 and months["may"] == 5 and "may." not in months


def test_queries_over_texts_bound_their_batches(spark, sf):
    import __spark_entry__ as entry_point

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    entry_point.queries()["token_estimate"](spark, sf)
    assert int(spark.conf.get(name)) <= 1000
