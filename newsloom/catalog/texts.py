"""Queries over document text, dates and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.catalog import query, sql as Q
from newsloom.functions import dates, providers, render, replies, text as T
from newsloom.operators import enrich
from newsloom.sources import articles as A, fixtures as X


def _docs(spark, sf):
    return X.table(spark, sf, "documents")


@query("article_validate", f"""
WITH {Q.FILES}, e AS (SELECT path, {Q.ERROR} AS error FROM files)
SELECT path, error IS NULL AS is_valid, error FROM e""")
def article_validate(spark, sf):
    return A.validate(X.article_files(spark, sf))


@query("clean_articles", f"""
WITH {Q.ARTICLES} SELECT article_id, title, url, content, source, category, author, is_exclusive, published_at FROM articles""")
def clean_articles(spark, sf):
    return X.articles(spark, sf).drop("subtitle", "summary")


@query("author_clean", f"""
SELECT c_custkey, {Q.squeeze("regexp_replace(a, '(?i)^\\s*By\\s+', '')")} AS author
FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '  by ' ELSE '' END || c_name || chr(10) || '  and ' || c_mktsegment || ' ' AS a FROM customer)""")
def author_clean(spark, sf):
    raw = F.concat(F.when(F.col("c_acctbal") > 0, "  by ").otherwise(""), F.col("c_name"), F.lit("\n  and "), F.col("c_mktsegment"), F.lit(" "))
    return X.table(spark, sf, "customer").select("c_custkey", T.clean_author(raw).alias("author"))


@query("sentence_split", f"""
SELECT doc_id, len(s)::INT AS sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)""")
def sentence_split(spark, sf):
    rows = _docs(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("token_estimate", """
SELECT doc_id, (length("text") // 4)::INT AS tokens,
       CASE WHEN length("text") > 400 THEN substring("text", 1, 397) || '...' ELSE "text" END AS cut FROM documents""")
def token_estimate(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.truncate_tokens(F.col("text"), 100).alias("cut")
    )


@query("previews", """
SELECT doc_id,
  CASE WHEN length("text") > 500 THEN substring("text", 1, 500) || '...' ELSE "text" END AS result_preview,
  substring("text", 1, 500) AS summary_input,
  CASE WHEN length("text") > 400 THEN substring("text", 1, 400) || '...' ELSE "text" END AS compare_preview,
  substring("text", 1, 600) AS research_preview, substring("text", 1, 300) AS daily_preview,
  substring("text", 1, 150) || '...' AS latest_summary,
  CASE WHEN length("text") > 15000 THEN substring("text", 1, 15000) || '...' ELSE "text" END AS article_input
FROM documents""")
def previews(spark, sf):
    t = F.col("text")
    return X.table(spark, sf, "documents").select(
        "doc_id",
        T.preview(t, C.RESULT_PREVIEW_CHARS).alias("result_preview"),
        T.preview(t, C.SUMMARY_INPUT_CHARS, False).alias("summary_input"),
        T.preview(t, C.COMPARE_PREVIEW_CHARS).alias("compare_preview"),
        T.preview(t, C.RESEARCH_PREVIEW_CHARS, False).alias("research_preview"),
        T.preview(t, C.DAILY_PREVIEW_CHARS, False).alias("daily_preview"),
        F.concat(F.substring(t, 1, C.LATEST_SUMMARY_CHARS), F.lit("...")).alias("latest_summary"),
        T.preview(t, C.ARTICLE_SUMMARY_INPUT_CHARS).alias("article_input"),
    )


@query("hard_split_windows", f"""
SELECT doc_id, (i - 1)::INT AS pos, w[i] AS piece FROM (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT doc_id, {Q.windows('"text"', 2048, 200)} AS w FROM documents))""")
def hard_split_windows(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.windows(F.col("text"), 2048, 200)).alias("pos", "piece"))


@query("chunk_packing", f"WITH {Q.CHUNKS} SELECT article_id, chunk_index, content AS chunk FROM chunks")
def chunk_packing(spark, sf):
    return enrich.chunk_articles(X.articles(spark, sf)).select("article_id", "chunk_index", "chunk")


_SMALL = Q.packed(Q.sentences('"text"'), 160, 40)


@query("chunk_packing_small", f"""
WITH folded AS (SELECT doc_id, {_SMALL} AS f FROM documents),
lists AS (SELECT doc_id, list_concat(f.done, CASE WHEN len(f.cur) > 0 THEN [array_to_string(f.cur, ' ')] ELSE []::VARCHAR[] END) AS parts FROM folded)
SELECT doc_id, (i - 1)::INT AS chunk_index, parts[i] AS chunk FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM lists)""")
def chunk_packing_small(spark, sf):
    docs = _docs(spark, sf).withColumnRenamed("text", "content")
    return enrich.chunk_articles(docs, 40, 10).select("doc_id", "chunk_index", "chunk")


@query("document_sizes", f"""
WITH {Q.CHUNKS} SELECT article_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_content_length FROM chunks GROUP BY article_id""")
def document_sizes(spark, sf):
    chunks = enrich.chunk_articles(X.articles(spark, sf)).select("article_id", F.col("chunk").alias("content"))
    return enrich.document_sizes(chunks)


@query("summaries", f"""
SELECT doc_id, {Q.lead('"text"', 2)} AS chunk_summary,
  {Q.lead('"text"', 5)} AS article_summary FROM documents""")
def summaries(spark, sf):
    lead = providers.LeadSentences()
    return _docs(spark, sf).select(
        "doc_id", lead.chunk(F.col("text")).alias("chunk_summary"), lead.article(F.lit(""), F.col("text")).alias("article_summary")
    )


@query("word_vectors", f"""
WITH docs AS (SELECT doc_id::VARCHAR AS chunk_id, "text" AS content FROM documents){Q.vectors('docs')}
SELECT chunk_id, (i - 1)::INT AS bucket, round(v::DOUBLE, 6) AS weight FROM (
  SELECT chunk_id, unnest(range(1, 65)) AS i, content_vector[i] AS v FROM vectors) WHERE v > 0""")
def word_vectors(spark, sf):
    docs = _docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("chunk_id"), providers.embedding(F.col("text")).alias("v")
    )
    rows = docs.select("chunk_id", F.posexplode("v").alias("bucket", "weight"))
    return rows.filter("weight > 0").select("chunk_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query("embedding_inputs", f"""
SELECT count(*) AS texts, count(*) FILTER ({Q.strip('"text"')} <> '') AS embeddable FROM (
  SELECT "text" FROM documents UNION ALL SELECT "text" FROM conversations UNION ALL SELECT ' ' || chr(10) FROM nation)""")
def embedding_inputs(spark, sf):
    texts = X.table(spark, sf, "documents").select("text").unionByName(X.table(spark, sf, "conversations").select("text"))
    texts = texts.unionByName(X.table(spark, sf, "nation").select(F.lit(" \n").alias("text")))
    return texts.agg(F.count("*").alias("texts"), F.count_if(~T.is_blank(F.col("text"))).alias("embeddable"))


@query("stream_slices", """
WITH lines AS (SELECT conv_id, turn, unnest(string_split("text", chr(10))) || chr(10) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS n FROM conversations),
pieces AS (SELECT conv_id, turn, n, unnest(range(0, length(line), 20)) AS start_at, substring(line, (start_at + 1)::BIGINT, 20) AS piece FROM lines)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY n, start_at) - 1)::INT AS pos, piece FROM pieces""")
def stream_slices(spark, sf):
    return X.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(T.stream_slices(F.col("text"))).alias("pos", "piece")
    )


# orders rendered in the layouts a news site uses, one layout per priority
_RENDERED = """
rendered AS (
  SELECT o_orderkey, o_orderdate + to_minutes((o_custkey % 1440)::INT) AS moment, o_orderpriority AS p FROM orders),
written AS (
  SELECT o_orderkey, CASE
    WHEN p = '1-URGENT' THEN 'Updated ' || strftime(moment, '%b. %-d, %Y %-I:%M %p') || ' ET'
    WHEN p = '2-HIGH' THEN strftime(moment, '%B %-d, %Y at %-I:%M %p ET')
    WHEN p = '3-MEDIUM' THEN strftime(moment, '%Y-%m-%dT%H:%M:%SZ')
    WHEN p = '4-NOT SPECIFIED' THEN strftime(moment, '%-d %b %Y')
    ELSE strftime(moment, '%-H') || ' hours ago' END AS "text",
    CASE WHEN p = '1-URGENT' THEN CASE WHEN month(moment) = 5 THEN NULL ELSE moment END
    WHEN p IN ('2-HIGH', '3-MEDIUM') THEN moment
    WHEN p = '4-NOT SPECIFIED' THEN date_trunc('day', moment) END AS parsed
  FROM rendered)"""


def _written(spark, sf):
    moment = F.timestamp_add("MINUTE", F.pmod("o_custkey", F.lit(1440)), F.col("o_orderdate"))
    p = F.col("o_orderpriority")
    fmt = lambda pattern: F.date_format(moment, pattern)
    rendered = (
        F.when(p == "1-URGENT", F.concat(F.lit("Updated "), fmt("MMM. d, yyyy h:mm a"), F.lit(" ET")))
        .when(p == "2-HIGH", fmt("MMMM d, yyyy 'at' h:mm a 'ET'"))
        .when(p == "3-MEDIUM", fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(p == "4-NOT SPECIFIED", fmt("d MMM yyyy"))
        .otherwise(F.concat(fmt("H"), F.lit(" hours ago")))
    )
    return X.table(spark, sf, "orders").select("o_orderkey", rendered.alias("text"))


# "May." is no accepted spelling, so those dates stay unread, as the rules say
@query("date_parse", f"""
WITH {_RENDERED} SELECT o_orderkey, "text", date_trunc('minute', parsed)::TIMESTAMP AS published_at,
  strftime(date_trunc('minute', parsed), '%Y-%m-%dT%H:%M:%S') AS iso FROM written""")
def date_parse(spark, sf):
    rows = _written(spark, sf).withColumn("published_at", dates.parse_date(F.col("text")))
    return rows.select("o_orderkey", "text", "published_at", dates.iso_text(F.col("published_at")).alias("iso"))


@query("day_display", """
SELECT DISTINCT ts::DATE AS "day", year(ts) || '年' || month(ts) || '月' || day(ts) || '日（' ||
  (['星期一','星期二','星期三','星期四','星期五','星期六','星期日'])[isodow(ts)] || '）' AS shown FROM events""")
def day_display(spark, sf):
    days = X.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return days.select("day", dates.display_day(F.col("day")).alias("shown"))


@query("relative_day", """
SELECT event_id, CASE event_type WHEN 'click' THEN DATE '2024-01-31' WHEN 'view' THEN DATE '2024-01-30'
  WHEN 'purchase' THEN ts::DATE WHEN 'signup' THEN DATE '2024-01-31' END AS "day" FROM events""")
def relative_day(spark, sf):
    kind = F.col("event_type")
    asked = (
        F.when(kind == "click", "Today").when(kind == "view", "昨天")
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd")).when(kind == "signup", "").otherwise("2024-13-40")
    )
    today = F.lit("2024-01-31").cast("date")
    return X.table(spark, sf, "events").select("event_id", dates.resolve_day(asked, today).alias("day"))


@query("category_display", """
WITH names AS (SELECT * FROM (VALUES ('tech', '科技'), ('us-news', '美国'), ('sports', '体育')) t(category, name)),
c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'tech' WHEN 'MACHINERY' THEN 'us-news' WHEN 'AUTOMOBILE' THEN 'sports' ELSE lower(c_mktsegment) END AS category FROM customer)
SELECT c_custkey, coalesce(name, c.category) AS name FROM c LEFT JOIN names USING (category)""")
def category_display(spark, sf):
    s = F.col("c_mktsegment")
    category = F.when(s == "BUILDING", "tech").when(s == "MACHINERY", "us-news").when(s == "AUTOMOBILE", "sports").otherwise(F.lower(s))
    return X.table(spark, sf, "customer").select("c_custkey", render.category_name(category).alias("name"))


@query("result_text", f"""
WITH {Q.CHUNKS}, r AS (SELECT *, length(content)::DOUBLE / 7 AS score FROM chunks)
SELECT chunk_id, 'Title: ' || coalesce(nullif(title, ''), 'N/A') || CASE WHEN is_exclusive THEN ' [EXCLUSIVE]' ELSE '' END
  || chr(10) || 'Category: ' || coalesce(category, 'N/A') || chr(10) || 'Published: ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S')
  || chr(10) || 'Summary: ' || coalesce(nullif(article_summary, ''), nullif(chunk_summary, ''), 'N/A')
  || chr(10) || 'Content: ' || CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END
  || chr(10) || 'URL: ' || url || chr(10) || 'Relevance Score: ' || printf('%.4f', score) AS block FROM r""")
def result_text(spark, sf):
    rows = X.corpus(spark, sf).withColumn("score", F.length("content").cast("double") / 7)
    return rows.select("chunk_id", render.result_text(lambda name: {
        "published_at": dates.iso_text(F.col("published_at")),
        "summary": render.summary(F.col("article_summary"), F.col("chunk_summary")),
    }.get(name, F.col(name))).alias("block"))


@query("evaluation_parse", """
WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 3 ELSE greatest(1, least(5, k - 40)) END::INT AS score,
  CASE WHEN event_type = 'error' THEN '评估解析失败' ELSE event_type END AS reason,
  CASE WHEN event_type = 'click' THEN 'semantic' END AS suggested_mode FROM e""")
def evaluation_parse(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") - 40
    kind = F.col("event_type")
    body = F.to_json(F.struct(k.alias("score"), kind.alias("reason"), F.when(kind == "click", "semantic").alias("suggested_mode")))
    reply = (
        F.when(kind == "error", F.lit("no idea"))
        .when(kind == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    )
    return X.table(spark, sf, "events").select("event_id", replies.parse_evaluation(reply).alias("e")).select("event_id", "e.*")


@query("intent_parse", """
WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k, event_type AS t FROM events)
SELECT event_id, CASE WHEN t = 'error' THEN 'raw ' || t ELSE 'q ' || t END AS search_query,
  CASE WHEN t IN ('error', 'signup') THEN 'hybrid' ELSE 'recent' END AS mode,
  coalesce(t <> 'error' AND k > 50, false) AS exclusive_only, false AS needs_summary,
  CASE WHEN t = 'click' THEN 'tech' END AS category, CASE WHEN t = 'error' THEN NULL ELSE k END::INT AS hours_ago FROM e""")
def intent_parse(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    body = F.to_json(F.struct(
        F.concat(F.lit("q "), kind).alias("search_query"), F.when(kind != "signup", "recent").alias("mode"),
        (k > 50).alias("exclusive_only"), F.when(kind == "click", "tech").alias("category"), k.alias("hours_ago"),
    ))
    reply = F.when(kind == "error", F.lit("sorry {")).when(kind == "view", F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise(body)
    query_text = F.concat(F.lit("raw "), kind)
    return X.table(spark, sf, "events").select("event_id", replies.parse_intent(reply, query_text).alias("i")).select("event_id", "i.*")


@query("angles_parse", """
WITH e AS (SELECT event_id, event_type AS t, (props->>'$.k')::INT AS k FROM events),
a AS (SELECT event_id, unnest([0, 1, 2, 3]) AS pos, t, k FROM e)
SELECT event_id, pos::INT AS pos,
  CASE WHEN t = 'error' THEN (['核心动态', '市场影响', '政策与监管', '行业趋势'])[pos + 1] ELSE 'a' || pos END AS angle,
  CASE WHEN t = 'error' THEN trim(k || ' ' || (['', 'market impact economic implications', 'policy regulation government response', 'industry trend outlook future development'])[pos + 1])
    ELSE t || ' ' || pos END AS query
FROM a WHERE t = 'error' OR pos < 2""")
def angles_parse(spark, sf):
    kind = F.col("event_type")
    entry = lambda i: F.struct(F.lit(f"a{i}").alias("angle"), F.concat(kind, F.lit(f" {i}")).alias("query"))
    broken = F.struct(F.lit("only a name").alias("angle"), F.lit(None).cast("string").alias("query"))
    body = F.to_json(F.struct(F.array(entry(0), broken, entry(1)).alias("angles")))
    reply = F.when(kind == "error", F.lit('{"angles": []}')).when(kind == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    topic = F.get_json_object("props", "$.k")
    return X.table(spark, sf, "events").select(
        "event_id", F.posexplode(replies.parse_angles(reply, topic)).alias("pos", "a")
    ).select("event_id", "pos", "a.angle", "a.query")


@query("topic_list", """
WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ' , ') || CASE WHEN p_size > 25 THEN ',, ' || p_brand || ', x' ELSE '' END, ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM part)
SELECT p_partkey, array_to_string(t, '|') AS topics, CASE WHEN len(t) < 2 THEN 'at least 2 topics' WHEN len(t) > 4 THEN 'at most 4 topics' END AS error FROM p""")
def topic_list(spark, sf):
    raw = F.concat(
        F.replace("p_type", F.lit(" "), F.lit(" , ")),
        F.when(F.col("p_size") > 25, F.concat(F.lit(",, "), F.col("p_brand"), F.lit(", x"))).otherwise(""),
    )
    return X.table(spark, sf, "part").select(
        "p_partkey", F.array_join(replies.topic_list(raw), "|").alias("topics"), replies.topic_list_error(raw).alias("error")
    )


@query("argument_clamps", """
SELECT l_orderkey, l_linenumber, greatest(1, least(20, l_quantity::INT - 5)) AS query_results,
  greatest(1, least(720, l_quantity::INT * 20)) AS trend_hours, greatest(1, least(5, l_linenumber)) AS compare_per_topic,
  greatest(3, least(20, l_quantity::INT)) AS research_results FROM lineitem""")
def argument_clamps(spark, sf):
    quantity = F.col("l_quantity").cast("int")
    def clamp(name, value):
        low, high = C.CLAMPS[name]
        return F.greatest(F.lit(low), F.least(F.lit(high), value)).alias(name)
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", clamp("query_results", quantity - 5), clamp("trend_hours", quantity * 20),
        clamp("compare_per_topic", F.col("l_linenumber")), clamp("research_results", quantity),
    )


@query("summary_choice", f"""
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, ''), nullif(CASE WHEN n_chars < 500 THEN '' ELSE lang END, ''), '') AS summary FROM documents""")
def summary_choice(spark, sf):
    article = F.when(F.col("lang") == "en", "").otherwise(F.col("source"))
    chunk = F.when(F.col("n_chars") < 500, "").otherwise(F.col("lang"))
    return X.table(spark, sf, "documents").select("doc_id", render.summary(article, chunk).alias("summary"))


@query("generated_summaries", f"""
WITH d AS (SELECT doc_id, "text", length("text") + 36 AS size FROM documents)
SELECT doc_id, CASE WHEN {Q.strip('"text"')} = '' THEN '' WHEN size % 7 = 0 THEN NULL ELSE substring("text", 1, 30) END AS summary FROM d""")
def generated_summaries(spark, sf):
    """A summarizer that calls a function for each text; some calls fail and must not stop the rest."""
    def generate(prompt):
        if len(prompt) % 7 == 0:
            raise RuntimeError("no answer")
        return prompt.split("\n\n", 1)[1][:30]

    summaries = providers.GeneratedSummaries(generate)
    return X.table(spark, sf, "documents").select("doc_id", summaries.chunk(F.col("text")).alias("summary"))
