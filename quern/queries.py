"""Registered queries of the search engine over the driver's tables, with SQL.

Names begin with the survey's operator id. Every query reads whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import html, text, vectors
from quern.operators import boolean, evaluate, expand, ranking, rerank
from quern.operators import index as ix
from quern.operators import vectors as vs
from quern.operators.index import Index
from quern.plans.query import parse
from quern.search import Options, Search
from quern.session import scratch_path, spread
from quern.sources import dump, textindex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOK = r"""tok AS (SELECT doc_id, unnest(t) AS term, unnest(generate_series(0, len(t) - 1)) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents))"""
LEN = r"""lens AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS dl FROM documents),
stats AS (SELECT count(*) AS n, sum(dl) AS total, avg(dl) AS mean FROM lens)"""
POST = "post AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM tok GROUP BY ALL), terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term)"
BASE = f"WITH {TOK}, {LEN}, {POST}"
WORDS = ("ersh", "the", "of")
CLUSTERS = ((0, "size", "SMALL"), (0, "size", "MEDIUM"), (1, "offer", "PROMO"), (1, "offer", "ECONOMY"), (2, "other", "STANDARD"), (2, "other", "SMALL"))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def index_of(spark: SparkSession, sf: str, only=None) -> Index:
    return Index.build(docs_of(spark, sf), only=only)


_saved: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, sf: str) -> Index:
    """An index of ``documents`` in the shared folder, written once an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _saved:
        path = scratch_path(spark, "saved-index")
        index_of(spark, sf).save(path)
        _saved[key] = path
    return Index.load(spark, _saved[key])


def r6(c):
    return F.round(c, 6)


# index


@query(f"{BASE} SELECT term, doc_id, tf, array_to_string(ps, ',') AS positions FROM post")
def a1_postings(spark, sf):
    return index_of(spark, sf).postings.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"{BASE} SELECT term, df, cf::BIGINT AS cf FROM terms")
def a2_document_frequency(spark, sf):
    return index_of(spark, sf).terms


@query(f"{BASE} SELECT d.doc_id, coalesce(p.tf, 0) AS tf FROM documents d LEFT JOIN post p ON p.doc_id = d.doc_id AND p.term = 'the'")
def a3_term_frequency(spark, sf):
    docs = docs_of(spark, sf).select("doc_id")
    return docs.join(index_of(spark, sf, ["the"]).postings.select("doc_id", "tf"), "doc_id", "left").select("doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))


@query(f"WITH {LEN} SELECT n AS n_docs, total::BIGINT AS sum_length, round(mean, 6) AS avg_length FROM stats")
def a4_corpus_stats(spark, sf):
    return ix.stats_of(ix.doc_lengths(docs_of(spark, sf))).withColumn("avg_length", r6("avg_length"))


@query("SELECT source, min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars, min(doc_id) AS min_doc_id, max(doc_id) AS max_doc_id FROM documents GROUP BY source")
def a5_metadata_ranges(spark, sf):
    return ix.metadata_ranges(table(spark, sf, "documents"), ["n_chars", "doc_id"], ["source"])


@query("SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders")
def a6_global_ranges(spark, sf):
    return ix.metadata_ranges(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@query("SELECT min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, count(*) AS n FROM orders")
def a7_id_stats(spark, sf):
    return table(spark, sf, "orders").agg(F.min("o_orderkey").alias("min_id"), F.max("o_orderkey").alias("max_id"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
SELECT least(rank // greatest(n // 22, 1), 21)::INTEGER AS shard, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, count(*) AS n FROM r GROUP BY 1""")
def a9_shard_ranges(spark, sf):
    return ix.shard_ranges(table(spark, sf, "orders"), 22, "o_orderkey")


@query(f"{BASE} SELECT count(*) AS n FROM terms")
def a10_term_count(spark, sf):
    return ix.tokens(docs_of(spark, sf)).select("term").distinct().agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderkey, (sum(CASE WHEN rn % 500 = 1 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey))::BIGINT AS shard FROM r""")
def w2_running_shards(spark, sf):
    return ix.running_shards(table(spark, sf, "orders"), 500, "o_orderkey")


@query(f"""{BASE}, p AS (SELECT term, doc_id, ps FROM post)
SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS doc_delta,
  array_to_string(list_transform(ps, lambda x, i: x - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END), ',') AS position_deltas FROM p""")
def w3_delta_encoding(spark, sf):
    return ix.delta_encode(index_of(spark, sf).postings).withColumn("position_deltas", F.array_join(F.transform("position_deltas", lambda p: p.cast("string")), ","))


@query(f"{BASE} SELECT term, doc_id, array_to_string(ps, ',') AS positions FROM post")
def w4_delta_decoding(spark, sf):
    return ix.delta_decode(ix.delta_encode(index_of(spark, sf).postings)).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(f"{BASE} SELECT term, doc_id, tf::BIGINT AS tf FROM post")
def j20_merge_segments(spark, sf):
    docs = docs_of(spark, sf)
    short = F.length(F.coalesce("text", F.lit(""))) < 1000
    one = ix.unique_ids(docs)
    parts = [ix.doc_postings(docs.where(rows), unique=one) for rows in (short, ~short)]  # all rows, in two segments
    return ix.merge_segments(parts, disjoint=one).select("term", "doc_id", "tf")


@query(f"{BASE}, r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM post) SELECT term, doc_id FROM r WHERE n <= 3")
def t4_posting_prefix(spark, sf):
    return ix.posting_prefix(docs_of(spark, sf), 3)


@query(f"{BASE} SELECT term, df, cf::BIGINT AS cf FROM terms ORDER BY df DESC, term LIMIT (SELECT (count(*) * 0.005)::INTEGER FROM terms)".replace("(count(*) * 0.005)::INTEGER", "floor(count(*) * 0.005)::INTEGER"))
def t5_vocabulary(spark, sf):
    return index_of(spark, sf).vocabulary(0.005)


@query(f"{BASE} SELECT doc_id, sum(tf)::BIGINT AS tf, array_to_string(list(term ORDER BY term), ' ') AS terms FROM post WHERE starts_with(term, 'ersh') GROUP BY doc_id")
def f29_prefix(spark, sf):
    return index_of(spark, sf).by_prefix("ersh").withColumn("terms", F.array_join("terms", " "))


@query(f"{BASE} SELECT term, term || ':' || count(*) || chr(10) || string_agg(chr(9) || doc_id || ':' || array_to_string(ps, ','), chr(10) ORDER BY doc_id) AS value FROM post GROUP BY term")
def s22_text_export(spark, sf):
    return textindex.index_lines(index_of(spark, sf))


@query(f"{BASE} SELECT term, doc_id, tf::BIGINT AS tf, array_to_string(ps, ',') AS positions FROM post")
def s23_text_import(spark, sf):
    path = scratch_path(spark, "text-index")
    textindex.index_lines(index_of(spark, sf)).select("value").write.text(f"{path}/index")
    return textindex.read_index(spark, path).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(f"{BASE} SELECT term, doc_id, tf FROM post WHERE term IN ('ersh', 'the')")
def s13_saved_index(spark, sf):
    path = scratch_path(spark, "index")
    index_of(spark, sf).save(path, 16)
    return Index.load(spark, path).postings_for(["ersh", "the"]).select("term", "doc_id", "tf")


@query(f"{BASE} SELECT doc_id, array_to_string(list(term || '=' || array_to_string(ps, ',') ORDER BY term), ' ') AS terms FROM post GROUP BY doc_id")
def i_forward_index(spark, sf):
    line = F.transform("terms", lambda t: F.concat(t["term"], F.lit("="), F.array_join(F.transform(t["positions"], lambda p: p.cast("string")), ",")))
    return index_of(spark, sf).forward().withColumn("terms", F.array_join(line, " "))


# ranked retrieval

_BM = "idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / mean))"
_HITS = f"""{BASE}, q AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM terms, stats WHERE term IN {WORDS}),
ranked AS (SELECT term, idf, row_number() OVER (ORDER BY idf DESC, term) AS r FROM q),
hits AS (SELECT p.doc_id, r, {_BM.format(k1=1.2)} AS s FROM post p JOIN ranked USING (term) JOIN lens USING (doc_id), stats),
c1 AS (SELECT doc_id FROM hits WHERE r = 1),
b2 AS (SELECT doc_id FROM c1 WHERE doc_id IN (SELECT doc_id FROM hits WHERE r = 2)),
c2 AS (SELECT doc_id FROM c1 WHERE (SELECT count(*) FROM b2) <= 100 OR doc_id IN (FROM b2)),
b3 AS (SELECT doc_id FROM c2 WHERE doc_id IN (SELECT doc_id FROM hits WHERE r = 3)),
c3 AS (SELECT doc_id FROM c2 WHERE (SELECT count(*) FROM b3) <= 100 OR doc_id IN (FROM b3))"""


@query(f"{_HITS} SELECT doc_id, round(sum(s), 6) AS bm25_score FROM hits WHERE doc_id IN (FROM c3) GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 100000")
def bm_a_search(spark, sf):
    return ranking.search(index_of(spark, sf, WORDS), WORDS).withColumn("bm25_score", r6("bm25_score"))


@query(f"""{BASE}, q(term, times) AS (VALUES ('ersh', 1), ('the', 2), ('of', 1)),
h AS (SELECT doc_id, times * {_BM.replace('idf', 'ln(1 + (n - df + 0.5) / (0.5 + df))').format(k1=1.5)} AS s FROM post JOIN q USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), stats)
SELECT doc_id, round(sum(s), 6) AS bm25_score FROM h GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 50""")
def bm_b_search(spark, sf):
    words = ["ersh", "the", "of", "the"]
    return ranking.search_all(index_of(spark, sf, words), words).withColumn("bm25_score", r6("bm25_score"))


@query(f"""{BASE}, q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark),
w AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM terms, stats),
h AS (SELECT query_id, doc_id, {_BM.format(k1=1.2)} AS s FROM q JOIN w USING (term) JOIN post USING (term) JOIN lens USING (doc_id), stats),
t AS (SELECT query_id, doc_id, round(sum(s), 6) AS bm25_score FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS rank FROM t)
SELECT query_id, doc_id, bm25_score FROM r WHERE rank <= 10""")
def bm_many_queries(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.plain_terms(F.col("text"))).alias("term"))
    return ranking.search_many(index_of(spark, sf).stored(), q, 10, digits=6).select("query_id", "doc_id", "bm25_score")


@query(SQL["bm_a_search"])
def bm_a_saved(spark, sf):
    """The same search on an index that was saved before."""
    return ranking.search(saved_index(spark, sf), WORDS).withColumn("bm25_score", r6("bm25_score"))


@query(SQL["bm_many_queries"])
def bm_many_saved(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.plain_terms(F.col("text"))).alias("term"))
    return ranking.search_many(saved_index(spark, sf), q, 10, digits=6).select("query_id", "doc_id", "bm25_score")


# Boolean retrieval


@query(f"{BASE} SELECT doc_id, max(tf) FILTER (term = 'the') AS tf FROM post WHERE term IN {WORDS} GROUP BY doc_id HAVING count(*) = 3")
def j9_intersection(spark, sf):
    return boolean.intersection(index_of(spark, sf, WORDS), ["the", "of", "ersh"])


@query(f"{BASE} SELECT DISTINCT doc_id FROM post WHERE term IN {WORDS}")
def j10_union(spark, sf):
    return boolean.union(index_of(spark, sf, WORDS), WORDS)


@query(f"{BASE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'the')")
def j11_complement(spark, sf):
    i = index_of(spark, sf, ["the"])
    return boolean.complement(i, boolean.union(i, ["the"]))


@query(f"""{BASE}, a AS (SELECT doc_id FROM post WHERE term = 'the'), b AS (SELECT doc_id FROM a WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'of')), n AS (SELECT doc_id FROM b WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'ersh')),
x AS (SELECT doc_id FROM a WHERE (SELECT count(*) FROM b) <= 20 OR doc_id IN (FROM b)), y AS (SELECT doc_id FROM x WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'ersh'))
SELECT doc_id FROM x WHERE (SELECT count(*) FROM y) <= 1000000 OR doc_id IN (FROM y)""")
def u4_conditional_intersection(spark, sf):
    """The second set narrows (more than 20 remain), the third doesn't (not more than a million)."""
    i = index_of(spark, sf, ["the", "of", "ersh"]).stored()
    some = boolean.conditional_intersection([i.term("the"), i.term("of")], 20)
    return boolean.conditional_intersection([some, i.term("ersh")], 1_000_000)


def _has(t: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = '{t}')"


@query(f"{BASE} SELECT doc_id FROM documents WHERE ({_has('ersh')} AND NOT {_has('que')}) OR ({_has('und')} AND {_has('der')})")
def q_boolean(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["ersh", "que", "und", "der"])).run("(ersh AND NOT que) OR (und AND der)")


@query(f"{BASE} SELECT doc_id FROM documents WHERE NOT ({_has('the')} OR {_has('que')})")
def q_boolean_not(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["the", "que"])).run("NOT (the OR que)")


@query(f"{BASE} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'of'")
def q_phrase(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["of", "the"])).run('"of the of"')


@query(f"{BASE} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE ((a.term = 'of' AND b.term = 'the') OR (a.term = 'the' AND b.term = 'ersh')) AND {_has('of').replace('doc_id', 'a.doc_id', 1)} AND {_has('the').replace('doc_id', 'a.doc_id', 1)} AND {_has('ersh').replace('doc_id', 'a.doc_id', 1)}")
def q_phrase_any_pair(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["of", "the", "ersh"]), any_pair=True).run('"of the ersh"')


@query(f"{BASE} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 3 WHERE a.term = 'ersh' AND b.term = 'the'")
def q_proximity(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["ersh", "the"])).run("#3(ersh, the)")


@query(SQL["q_phrase"])
def q_phrase_saved(spark, sf):
    return boolean.Evaluator(saved_index(spark, sf)).run('"of the of"')


# analysis

_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query(rf"""WITH src AS (SELECT doc_id, strip_accents(replace(text, ' the ', ' www.a.b fooBarHTTPServer snake_case x1y2 don''t me@b.de ')) AS t FROM documents),
kept AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '' AND NOT regexp_matches(x, '^(https?://\S|www\.\S|[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-])')), ' ') AS t FROM src),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\w)''(\w)', '\1\2', 'g'), '[0-9]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '_+', ' ', 'g') AS t FROM kept),
camel AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g') AS t FROM cut),
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS l FROM camel),
rows AS (SELECT doc_id, unnest(l) AS raw, unnest(generate_series(0, len(l) - 1)) AS pos FROM toks)
SELECT lower(raw) AS term, count(*) AS n, sum(pos)::BIGINT AS places FROM rows WHERE NOT list_contains({_STOPS}, lower(raw)) GROUP BY 1""")
def f_analyzer(spark, sf):
    source = F.replace(F.col("text"), F.lit(" the "), F.lit(" www.a.b fooBarHTTPServer snake_case x1y2 don't me@b.de "))
    docs = docs_of(spark, sf).select("doc_id", source.alias("text"))
    return ix.tokens(docs, text.Analyzer(stemming=False)).groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query()
def f3_stemmed_terms(spark, sf):
    return ix.doc_terms(docs_of(spark, sf), text.Analyzer())


@query(r"SELECT page_id, array_to_string(regexp_extract_all(html, '[^\s(){}\[\];:,.<>=+\-*/%&|!^~?]+|[(){}\[\];:,.<>=+\-*/%&|!^~?]'), ' ') AS tokens FROM pages")
def f26_code_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.code_tokens(F.col("html")), " ").alias("tokens"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+|[0-9]|[^\sa-z0-9]'), ' ') AS tokens FROM documents")
def f28_pre_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.pre_tokens(F.col("text")), " ").alias("tokens"))


@query()
def s12_html_blocks(spark, sf):
    rows = html.with_blocks(table(spark, sf, "pages").select("page_id", "html")).select("page_id", F.explode("blocks").alias("b"))
    return rows.select("page_id", "b.block_id", "b.kind", "b.text", "b.text_size", F.array_join("b.flags", ",").alias("flags"), "b.href")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def s12_links(spark, sf):
    rows = html.with_blocks(table(spark, sf, "pages").select("page_id", "html")).select("page_id", F.explode("blocks").alias("b"))
    return rows.where("b.kind = 'link' AND b.href <> ''").select("page_id", "b.href")


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS ws FROM b),
c AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, coalesce(string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) FILTER (len(ws) > 0 AND before < 30), '') AS snippet FROM c GROUP BY doc_id""")
def p14_snippets(spark, sf):
    words = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda b: F.filter(F.split(b, r"\s+"), lambda w: w != ""))
    return table(spark, sf, "documents").select("doc_id", text.snippet(words).alias("snippet"))


_PAGE = r"""pg AS (SELECT page_id, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS i FROM (
  SELECT page_id, [url] || list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>[^<]*'), lambda x: regexp_replace(regexp_replace(x, '^<p[^>]*>', ''), '&(amp|lt|gt|quot);', '&', 'g')), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> '') AS parts FROM pages)),
pt AS (SELECT page_id, i, list_filter(regexp_split_to_array(lower(coalesce(part, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM pg),
po AS (SELECT page_id, ts, coalesce(sum(len(ts)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pt),
pw AS (SELECT page_id, unnest(ts) AS term, unnest(generate_series(0, len(ts) - 1)) + before AS pos FROM po WHERE len(ts) > 0)"""


def _pages(spark, sf) -> DataFrame:
    """Pages of their plain paragraphs, so that SQL can cut them as the parser does."""
    text = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>[^<]*"), F.lit(0)), lambda p: F.concat(p, F.lit("</p>"))), "<hr>")
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), text.alias("body"))


@query(f"WITH {_PAGE} SELECT page_id AS doc_id, term, pos::INTEGER AS pos FROM pw")
def w5_block_positions(spark, sf):
    return ix.block_tokens(_pages(spark, sf))


@query(f"WITH {_PAGE} SELECT term, page_id AS doc_id, count(*) AS tf, array_to_string(list(pos::INTEGER ORDER BY pos), ',') AS positions FROM pw GROUP BY term, page_id")
def a1_html_postings(spark, sf):
    pages = _pages(spark, sf)
    index = Index.of_tokens(ix.block_tokens(pages), pages.select("doc_id"))
    return index.postings.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query()
def w5_whole_pages(spark, sf):
    """Whole pages with all their blocks, links and code."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), F.col("html").alias("body"))
    return ix.block_tokens(pages, analyzer=text.Analyzer(stemming=False))


# relations


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_owner_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def j3_grouped_children(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    joined = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey")
    return joined.select("o_orderkey", F.array_join(F.transform("ls", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j4_semi_join(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(done, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def j5_union_of_people(spark, sf):
    a = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return a.union(table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def j7_either_join(spark, sf):
    ids = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return dump.either_join(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ids, ("l_partkey", "l_suppkey"))


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j8_orphans(spark, sf):
    return dump.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j8_repaired_parents(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return dump.repair_orphans(table(spark, sf, "orders"), "o_custkey", known, "c_custkey")


@query("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def s4_new_rows(spark, sf):
    have = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return dump.new_rows(table(spark, sf, "orders").select("o_custkey"), have, "o_custkey")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1_xml_round_trip(spark, sf):
    path = scratch_path(spark, "xml")
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    dump.write_xml(df, path)
    return dump.read_xml(spark, path, df.schema, "c_custkey")


@query("SELECT doc_id, text, lang FROM documents")
def s7_csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dump.write_csv(df, path, ["doc_id"])
    return dump.read_csv(spark, path, df.schema)


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_size > 25 AND p_retailprice > 950 AND p_name IS NOT NULL AND p_type IS NOT NULL AND p_brand <> 'Brand#1'")
def p3_quality_filter(spark, sf):
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_brand") == "Brand#1", 2).otherwise(1)
    posts = part.select(F.col("p_partkey").alias("id"), kind.alias("posttypeid"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.col("p_size").alias("score"), F.col("p_retailprice").alias("viewcount"))
    return dump.good_questions(posts, 25, 950).select("id", "title")


@query("SELECT item_id AS id, 'q ' || text AS text FROM benchmark WHERE coalesce(text, '') <> ''")
def s31_training_text(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("q").alias("title"), F.col("text").alias("body"))
    return dump.training_text(rows)


# ranking after retrieval

_NORM = "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END"
_META = """d AS (SELECT o_orderkey AS doc_id, o_totalprice AS score, greatest(c_acctbal, 0) AS viewcount, epoch(o_orderdate)::BIGINT AS creationdate, c_nationkey AS userreputation FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _meta(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), ix.clamp(F.col("c_acctbal")).alias("viewcount"), F.unix_timestamp("o_orderdate").alias("creationdate"), F.col("c_nationkey").alias("userreputation"))


@query(f"WITH {_META} SELECT doc_id, round(1.5 * {_NORM.format(c='score')} + 1.2 * {_NORM.format(c='viewcount')} + 1.5 * {_NORM.format(c='creationdate')} + 1.5 * {_NORM.format(c='userreputation')}, 6) AS metadata_score FROM d")
def f14_metadata_score(spark, sf):
    return rerank.add_metadata_score(_meta(spark, sf)).select("doc_id", r6("metadata_score").alias("metadata_score"))


@query(f"WITH {_META} SELECT doc_id, round(1.5 * (0 - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) + 1.2 * {_NORM.format(c='viewcount')} + 1.5 * {_NORM.format(c='creationdate')} + 1.5 * {_NORM.format(c='userreputation')}, 6) AS metadata_score FROM d")
def f14_metadata_score_compat(spark, sf):
    return rerank.add_metadata_score(_meta(spark, sf), ignore_score=True).select("doc_id", r6("metadata_score").alias("metadata_score"))


_PAIR = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END"


@query(f"SELECT o_orderkey AS doc_id, o_custkey AS query_id, round(0.6 * {_PAIR.format(c='o_orderkey')} + 0.4 * {_PAIR.format(c='o_totalprice')}, 6) AS final_score FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def a17_fused_scores(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("query_id"), F.lit(1.0).alias("bm25_score"), F.col("o_orderkey").cast("double").alias("lm_score"), F.col("o_totalprice").alias("metadata_score"))
    return rerank.fuse(rows, by=["query_id"]).select("doc_id", "query_id", r6("final_score").alias("final_score"))


_TAGS = ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in CLUSTERS)


def _tagged(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.join_tags(F.array("p_type", "p_brand")).alias("tags"))
    return rows, spark.createDataFrame(CLUSTERS, "cluster_id int, cluster string, tag string")


@query(f"WITH c(i, cluster, tag) AS (VALUES {_TAGS}), f AS (SELECT tag, arg_min(cluster, i) AS cluster FROM c GROUP BY tag) SELECT p_partkey AS doc_id, coalesce(f.cluster, '') AS cluster_tags FROM part LEFT JOIN f ON tag = p_type")
def j18_cluster_tags(spark, sf):
    rows, clusters = _tagged(spark, sf)
    return rerank.add_cluster_tags(rows, clusters).select("doc_id", F.array_join("cluster_tags", ",").alias("cluster_tags"))


@query("SELECT p_partkey AS doc_id FROM part WHERE p_type IN ('SMALL', 'MEDIUM')")
def p9_cluster_filter(spark, sf):
    rows, clusters = _tagged(spark, sf)
    return rerank.filter_clusters(rows, clusters, ["size"]).select("doc_id")


@query("SELECT o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rank FROM orders) WHERE rank >= 2 AND rank < 4")
def w9_pages(spark, sf):
    out = rerank.ranked_page(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 1, 2, ["o_custkey"])
    return out.select("o_orderkey", "rank")


@query(f"""WITH {_META}, x AS (SELECT doc_id, score, viewcount, creationdate, userreputation FROM d)
SELECT doc_id, round(1.5 * {_NORM.format(c='score')} + 1.2 * {_NORM.format(c='viewcount')} + 1.5 * {_NORM.format(c='creationdate')} + 1.5 * {_NORM.format(c='userreputation')}, 6) AS metadata_score FROM x""")
def s17_rescored_segments(spark, sf):
    """Three segments, scored each on its own, merged and scored again; the last
    repeats documents of the first, which had other values."""
    meta = _meta(spark, sf)
    low, high = meta.where("userreputation < 12"), meta.where("userreputation >= 12")
    old = low.withColumn("score", F.lit(-5.0))
    parts = [rerank.add_metadata_score(p) for p in (old, high, low)]
    return rerank.rescore(ix.merge_documents(parts)).select("doc_id", r6("metadata_score").alias("metadata_score"))


@query("""WITH best AS (SELECT o_orderkey AS doc_id, o_totalprice AS s FROM orders WHERE o_orderkey <= 12)
SELECT doc_id, s AS bm25_score FROM best UNION ALL SELECT NULL, NULL FROM generate_series(1, 20 - (SELECT count(*) FROM best)::INTEGER)""")
def t12_filled_result(spark, sf):
    """Which documents fill up a result is drawn; the check is on their number."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("bm25_score"))
    out = rerank.fill(rows.where("doc_id <= 12"), rows, 20)
    return out.select(F.when(F.col("bm25_score").isNotNull(), F.col("doc_id")).alias("doc_id"), "bm25_score")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def t6_date_page(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("creation_date"))
    return rerank.page(rerank.sort_by_date(rows, "newest"), 2, 10).select(F.col("doc_id").alias("o_orderkey"))


# vectors

_Q = [round(math.sin(i * 1.7) / 8, 6) for i in range(64)]
_QL = "[" + ", ".join(f"{x!r}" for x in _Q) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_QL}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_QL}) DESC, vec_id LIMIT 10")
def j17_nearest(spark, sf):
    return vs.nearest(table(spark, sf, "embeddings"), _Q, 10).withColumn("score", r6("score"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_QL}) ** 2, 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QL}), vec_id LIMIT 10")
def v4_nearest_l2(spark, sf):
    return vs.nearest(table(spark, sf, "embeddings"), _Q, 10, metric="l2").withColumn("score", r6("score"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def v5_nearest_many(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vs.nearest_many(e, q, 6).where("query_id <> vec_id")
    again = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return again.where("rank <= 5").select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query(f"""WITH s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], {_QL}) AS score FROM embeddings WHERE label = 1),
a AS (SELECT vec_id FROM embeddings WHERE label = 1 UNION SELECT 1000000 + c_custkey FROM customer WHERE c_nationkey = 3)
SELECT vec_id, round(coalesce(score, (SELECT min(score) FROM s) - 0.1, -1), 6) AS score FROM a LEFT JOIN s USING (vec_id)""")
def j16_filtered_nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    extra = table(spark, sf, "customer").where("c_nationkey = 3").select((F.col("c_custkey") + 1000000).alias("vec_id"))
    return vs.nearest_of(e, e.where("label = 1").select("vec_id").union(extra), _Q, 1 << 30).withColumn("score", r6("score"))


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), c AS (SELECT 'v' || vec_id AS term, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, q WHERE vec_id <> 7)
SELECT term, round(s, 6) AS similarity FROM c ORDER BY s DESC, term LIMIT 3""")
def v7_similar_terms(spark, sf):
    vocab = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("term"), "embedding")
    return expand.similar_terms(vocab, "v7", 3).withColumn("similarity", r6("similarity"))


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QL}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QL}) DESC, vec_id LIMIT 10")
def v3_inverted_file(spark, sf):
    return vs.InvertedFile.build(table(spark, sf, "embeddings"), 64).search(_Q, 10, 8).withColumn("score", r6("score"))


@query()
def v1_embedded_texts(spark, sf):
    return vs.embed_texts(table(spark, sf, "benchmark"), id_col="item_id").select("item_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("SELECT vec_id, label AS cluster, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings")
def s28_dumped_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    vs.dump_vectors(table(spark, sf, "embeddings"), path)
    return spark.read.parquet(path).join(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster")), "vec_id").select("vec_id", "cluster", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("SELECT DISTINCT vec_id FROM embeddings WHERE label < 6")
def s26_appended_vectors(spark, sf):
    path, e = scratch_path(spark, "batches"), table(spark, sf, "embeddings")
    for name, part in (("a", "label < 3"), ("b", "label BETWEEN 3 AND 5"), ("a", "label < 3")):  # the last is a replay
        vs.append_vectors(e.where(part), path, name)
    return spark.read.parquet(path).select("vec_id")


# evaluation

_DT = """dt AS (SELECT DISTINCT conv_id AS query_id, conv_id * 1000 + turn AS doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM conversations),
dn AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT conv_id AS query_id, conv_id * 1000 + turn AS doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM conversations) GROUP BY ALL)"""


def _turns(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.explode(text.plain_terms(F.col("text"))).alias("term"))
    return rows.groupBy("query_id", "doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"""{BASE}, {_DT}, c AS (SELECT query_id, term, sum(tf) AS n FROM dn GROUP BY ALL), p AS (SELECT query_id, term, n / sum(n) OVER (PARTITION BY query_id) AS p FROM c), t AS (SELECT sum(cf) AS total FROM terms)
SELECT query_id, round(sum(p * ln(p / (coalesce(cf::DOUBLE, 1e-12) / total))), 6) AS clarity FROM p LEFT JOIN terms USING (term), t GROUP BY query_id""")
def a12_clarity(spark, sf):
    corpus = ix.terms_of(ix.tokens(docs_of(spark, sf)).groupBy("term").agg(F.count("*").alias("tf"))).select("term", "cf")
    return evaluate.clarity(_turns(spark, sf).select("query_id", "term", "tf"), corpus).withColumn("clarity", r6("clarity"))


@query(f"{BASE}, b AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark) SELECT query_id, round(count(DISTINCT term) FILTER (term IN (SELECT term FROM terms)) / count(*), 6) AS overlap FROM b GROUP BY query_id")
def a13_overlap(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.plain_terms(F.col("text"))).alias("term"))
    return evaluate.collection_overlap(q, ix.tokens(docs_of(spark, sf))).withColumn("overlap", r6("overlap"))


@query(f"""WITH {_DT}, s AS (SELECT query_id, doc_id, list(term) AS ts FROM dt GROUP BY ALL)
SELECT a.query_id, round(avg(len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts))), 6) AS jaccard FROM s a JOIN s b ON a.query_id = b.query_id AND a.doc_id < b.doc_id GROUP BY a.query_id
UNION ALL SELECT query_id, NULL FROM s GROUP BY query_id HAVING count(*) = 1""")
def a14_mean_jaccard(spark, sf):
    return evaluate.mean_jaccard(_turns(spark, sf)).withColumn("jaccard", r6("jaccard"))


@query(f"""WITH {_DT}, l AS (SELECT doc_id, sum(tf) AS dl FROM dn GROUP BY doc_id), m AS (SELECT avg(dl) AS mean FROM l),
w AS (SELECT query_id, doc_id, term, tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS w FROM dn JOIN l USING (doc_id), m),
nn AS (SELECT query_id, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
d AS (SELECT a.query_id, a.doc_id AS x, b.doc_id AS y, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.query_id = b.query_id AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a.query_id, round(avg(coalesce(dot, 0) / (a.norm * b.norm)), 6) AS cosine FROM nn a JOIN nn b ON a.query_id = b.query_id AND a.doc_id < b.doc_id LEFT JOIN d ON d.x = a.doc_id AND d.y = b.doc_id AND d.query_id = a.query_id GROUP BY a.query_id
UNION ALL SELECT query_id, NULL FROM nn GROUP BY query_id HAVING count(*) = 1""")
def a14_mean_cosine(spark, sf):
    t = _turns(spark, sf)
    return evaluate.mean_cosine(t, t.groupBy("doc_id").agg(F.sum("tf").alias("doc_length"))).withColumn("cosine", r6("cosine"))


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS i, o_totalprice AS a, epoch(o_orderdate) AS b FROM orders),
k AS (SELECT x.q, sum(sign(x.a - y.a) * sign(x.b - y.b)) / nullif(sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))), 0) AS t FROM r x JOIN r y ON x.q = y.q AND x.i < y.i GROUP BY x.q),
g AS (SELECT q, rank() OVER (PARTITION BY q ORDER BY a) + (count(*) OVER (PARTITION BY q, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY q ORDER BY b) + (count(*) OVER (PARTITION BY q, b) - 1) / 2 AS rb FROM r),
s AS (SELECT q, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS c FROM g GROUP BY q)
SELECT q AS query_id, round(t, 6) AS kendall, round(c, 6) AS spearman FROM s LEFT JOIN k USING (q)""")
def a15_rank_correlation(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("a"), F.unix_timestamp("o_orderdate").cast("double").alias("b"))
    return evaluate.rank_correlation(rows).select("query_id", r6("kendall").alias("kendall"), r6(F.nanvl("spearman", F.lit(None).cast("double"))).alias("spearman"))


@query("""WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.e, b.e) AS d FROM u a, u b WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.5),
core AS MATERIALIZED (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4), l AS (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), lab AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
edge AS (SELECT p.a AS id, arg_min(lab.c, (d, lab.c)) AS c FROM p JOIN lab ON p.b = lab.id GROUP BY p.a)
SELECT vec_id, coalesce(lab.c, edge.c, -1)::BIGINT AS cluster FROM u LEFT JOIN lab ON lab.id = vec_id LEFT JOIN edge ON edge.id = vec_id""")
def a18_density_clusters(spark, sf):
    return evaluate.density_clusters(table(spark, sf, "embeddings"), 0.5, 4)


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, 64)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL),
f AS (SELECT label, vec_id, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c USING (label, i) GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM f GROUP BY label),
a AS (SELECT p.label AS x, q.label AS y, sqrt(sum((p.c - q.c) ** 2)) AS d FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY ALL),
w AS (SELECT a.x, max((u.s + v.s) / d) AS r FROM a JOIN s u ON u.label = a.x JOIN s v ON v.label = a.y GROUP BY a.x) SELECT round(avg(r), 6) AS davies_bouldin FROM w""")
def a18_davies_bouldin(spark, sf):
    e = table(spark, sf, "embeddings")
    return evaluate.davies_bouldin(e.select("vec_id", "embedding"), e.select("vec_id", F.col("label").alias("cluster"))).withColumn("davies_bouldin", r6("davies_bouldin"))


@query()
def a19_tag_clusters(spark, sf):
    return evaluate.tag_clusters(table(spark, sf, "embeddings"), 5, 20)


@query(f"""{BASE}, q(word) AS (VALUES ('tha'), ('oof'), ('tionn'), ('qqqqqq')), d AS (SELECT word, term, df, levenshtein(word, term) AS d FROM q, terms WHERE abs(length(term) - length(word)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, df DESC, term) AS r FROM d WHERE d <= 2) SELECT word, term AS corrected FROM q LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (word)""")
def f25_spelling(spark, sf):
    return expand.correct_spelling(index_of(spark, sf).terms, ["tha", "oof", "tionn", "qqqqqq"])


@query("SELECT p_partkey, array_to_string(list_filter(string_split('|' || p_type || '|' || p_brand || '|', '|'), lambda x: x <> ''), ' ') AS tags FROM part")
def f20_tags(spark, sf):
    tags = text.split_tags(text.join_tags(F.array("p_type", "p_brand")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tags, " ").alias("tags"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS ts FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts)), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id""")
def f17_jaccard(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(text.plain_terms(F.col("text"))).alias("ts"))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, F.col("a.item_id") < F.col("b.item_id"))  # all pairs are the result
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), r6(vectors.jaccard(F.col("a.ts"), F.col("b.ts"))).alias("jaccard"))


# further analysis


@query(r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\s+'), lambda x: x <> '') AS ws FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ws) AS term FROM t) GROUP BY term")
def f5_space_tokens(spark, sf):
    words = F.filter(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"), lambda w: w != "")
    docs = docs_of(spark, sf)
    if docs.where("doc_id IS NULL").isEmpty() and ix.unique_ids(docs):
        return ix.sum_terms(ix.row_runs(docs, words, "counts")).select("term", "cf", "df")
    return docs.select("doc_id", F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("cf"), F.countDistinct("doc_id").alias("df"))


@query(rf"{BASE} SELECT strip_accents(term) AS term, sum(cf)::BIGINT AS cf FROM terms GROUP BY 1")
def f4_ascii_terms(spark, sf):
    return index_of(spark, sf).terms.groupBy(text.to_ascii(F.col("term")).alias("term")).agg(F.sum("cf").alias("cf"))


@query(rf"{BASE} SELECT term, cf::BIGINT AS cf FROM terms WHERE NOT list_contains({_STOPS}, term)")
def p6_without_stop_words(spark, sf):
    return index_of(spark, sf).terms.where(~F.col("term").isin(list(text.STOP_WORDS))).select("term", "cf")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s]+'), lambda x: regexp_replace(strip_accents(x), '[^\p{L}\p{N}_\s]+', '', 'g') <> '')) AS n FROM documents")
def f10_punctuation_removed(spark, sf):
    config = text.Analyzer(links="keep", contractions="keep", digits="keep", punctuation="remove", snake="keep", camel="keep", stop_words=(), stemming=False)
    return table(spark, sf, "documents").select("doc_id", text.text_length(F.col("text"), config).alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(strip_accents(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, array_to_string(regexp_extract_all(strip_accents(coalesce(text, '')), '[^\p{L}\p{N}_\s]'), '') AS marks FROM documents")
def f10_punctuation_kept(spark, sf):
    config = text.Analyzer(links="keep", contractions="keep", digits="keep", punctuation="keep-split", snake="keep", camel="keep", stop_words=(), stemming=False)
    found = text.raw_tokens(F.col("text"), config)
    marks = F.filter(found, lambda t: t.rlike(r"^[^\p{L}\p{N}_\s]$"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).alias("n"), F.array_join(marks, "").alias("marks"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(replace(text, ' the ', ' snake_case ')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(ts) AS wholes, 2 * len(list_filter(ts, lambda x: x = 'snake_case')) AS parts FROM t""")
def f7_kept_variables(spark, sf):
    """Whole texts in which a word became a variable of two parts."""
    source = F.replace(F.col("text"), F.lit(" the "), F.lit(" snake_case "))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", source.alias("t"))
    config = text.Analyzer(links="keep", contractions="keep", digits="keep", snake="keep-split", camel="keep", stop_words=(), stemming=False)
    found = text.terms(F.col("t"), config)
    sizes = F.transform(F.array(found), lambda ts: F.struct(F.size(F.filter(ts, lambda x: x["pos"] >= 0)).alias("wholes"), F.size(F.filter(ts, lambda x: x["pos"] < 0)).alias("parts")))
    return docs.select("doc_id", F.inline(sizes))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]+"[^>]*>[^<]*<')) AS a FROM pages)
SELECT page_id, regexp_extract(a, '>([^<]*)<', 1) || ' ' || regexp_extract(a, 'href="([^"]*)"', 1) || ' ' AS link FROM l""")
def x1_link_text(spark, sf):
    rows = html.with_blocks(table(spark, sf, "pages").select("page_id", "html")).select("page_id", F.explode("blocks").alias("b")).where("b.kind = 'link' AND b.href <> ''")
    return rows.select("page_id", html.block_text(F.col("b")).alias("link"))


# further retrieval

_SHARDED = f"""{BASE}, p AS (SELECT post.doc_id, doc_id // 250 AS shard, term, tf, dl FROM post JOIN lens USING (doc_id) WHERE term IN {WORDS}),
f AS (SELECT shard, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean) AS mean FROM p, stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY idf DESC, term) AS r FROM f),
m AS (SELECT p.shard, p.doc_id, sum({_BM.format(k1=1.2)}) AS s, bit_or(1 << (r - 1)) AS m FROM p JOIN r ON p.shard = r.shard AND p.term = r.term GROUP BY ALL),
t AS (SELECT shard, max(r) AS k FROM r GROUP BY shard),
a AS (SELECT shard, CASE WHEN k >= 2 AND count(*) FILTER ((m & 3) = 3) > 20 THEN 3 ELSE 1 END AS need FROM m JOIN t USING (shard) GROUP BY shard, k),
c AS (SELECT m.shard, CASE WHEN k >= 3 AND count(*) FILTER ((m & (need | 4)) = (need | 4)) > 20 THEN need | 4 ELSE need END AS need FROM m JOIN a ON m.shard = a.shard JOIN t ON t.shard = m.shard GROUP BY m.shard, need, k)
SELECT doc_id, round(s, 6) AS bm25_score FROM m JOIN c ON m.shard = c.shard WHERE (m & need) = need"""


@query(_SHARDED)
def bm_a_by_shard(spark, sf):
    i = index_of(spark, sf, WORDS)
    i.docs = i.docs.withColumn("shard", F.floor(F.col("doc_id") / 250))
    return ranking.search_by_shard(i, WORDS, "shard", floor=20).withColumn("bm25_score", r6("bm25_score"))


@query(f"{BASE} SELECT doc_id FROM documents WHERE {_has('ersh')} OR {_has('und')}")
def q_boolean_last_operand(spark, sf):
    return boolean.Evaluator(index_of(spark, sf, ["the", "ersh", "und"])).run(parse("the ersh OR und", last_operand=True))


@query(f"{BASE} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'ersh' AND b.term = 're'")
def q_phrase_gap(spark, sf):
    config = text.Analyzer(links="keep", contractions="keep", digits="keep", snake="keep", camel="keep", stop_words=("the",), stemming=False, ascii=False)
    docs = docs_of(spark, sf).withColumn("text", F.array_join(text.plain_terms(F.col("text")), " "))
    return boolean.Evaluator(Index.build(docs, config, only=["ersh", "re"]), config).run('"ersh the re"')


@query(f"""{_HITS}, s AS (SELECT doc_id, sum(s) AS s FROM hits WHERE doc_id IN (FROM c3) GROUP BY doc_id ORDER BY round(sum(s), 9) DESC, doc_id LIMIT 10)
SELECT doc_id, round(s.s, 6) AS bm25_score, lang AS title, n_chars AS view_count FROM s JOIN documents USING (doc_id)""")
def e_search_page(spark, sf):
    base = index_of(spark, sf, WORDS)
    meta = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), F.col("n_chars").alias("viewcount"))
    found = Search(Index(base.docs.join(meta, "doc_id"), base.postings, base.terms, base.stats)).search(" ".join(WORDS), Options(0, 10))
    return found.rows.select("doc_id", r6("bm25_score").alias("bm25_score"), "title", "view_count")


@query(f"{BASE} SELECT doc_id FROM documents WHERE {_has('ersh')} AND NOT {_has('que')} ORDER BY doc_id LIMIT 10 OFFSET 10")
def e_advanced_page(spark, sf):
    found = Search(index_of(spark, sf, ["ersh", "que"])).advanced_search("ersh AND NOT que", Options(1, 10))
    return found.rows.select("doc_id")


@query("""WITH d AS (SELECT p_partkey AS doc_id, p_retailprice - CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS m FROM part) SELECT doc_id, round(m, 6) AS metadata_score FROM d ORDER BY m DESC, doc_id LIMIT 200""")
def t9_reranked_window(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("metadata_score"), F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name")).alias("title"))
    return rerank.rerank_metadata(rows).limit(rerank.DEPTH).select("doc_id", r6("metadata_score").alias("metadata_score"))


@query("""WITH a AS (SELECT vec_id, embedding FROM embeddings WHERE label < 5), b AS (SELECT vec_id, list_transform(embedding, lambda x: x * 2) AS embedding FROM embeddings WHERE label > 2)
SELECT vec_id, round((coalesce(b.embedding, a.embedding))[1]::DOUBLE, 6) AS x FROM a FULL JOIN b USING (vec_id)""")
def s29_merged_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    twice = e.where("label > 2").select("vec_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    return vs.merge_vectors(e.where("label < 5").select("vec_id", "embedding"), twice, "vec_id").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("""WITH n AS (SELECT o_orderkey AS doc_id, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT doc_id, o_totalprice AS bm25_score FROM n WHERE r <= 5 OR (r BETWEEN 11 AND 15)""")
def u9_backfill(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("bm25_score"))
    best = rows.orderBy(F.desc("bm25_score"), "doc_id")
    return rerank.backfill(best.limit(5), best.offset(10).limit(50), 10)


# further relations


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, (props ->> '$.k')::INTEGER AS k, greatest(0, value - 50) AS clamped FROM events")
def f18_event_values(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("seconds"), k.alias("k"), ix.clamp(F.col("value") - 50).alias("clamped"))


@query("SELECT s_suppkey, greatest(0, s_acctbal) AS clamped FROM supplier")
def f19_clamped(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", ix.clamp(F.col("s_acctbal")).alias("clamped"))


@query("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT item_id, text FROM benchmark")
def s30_train_and_test(spark, sf):
    a = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a.unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT 'orders' AS child, count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS missing FROM orders UNION ALL SELECT 'lineitem', count(DISTINCT l_partkey) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem")
def s5_reference_check(spark, sf):
    a = dump.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey").agg(F.count("*").alias("missing")).select(F.lit("orders").alias("child"), "missing")
    b = dump.orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part"), "p_partkey").agg(F.count("*").alias("missing")).select(F.lit("lineitem").alias("child"), "missing")
    return a.unionByName(b)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def t8_top_by_metadata(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT count(*) AS n FROM lineitem")
def a8_row_count(spark, sf):
    """At a share of 1 the estimate is the count, read from the files' footers' rows."""
    return ix.approximate_count(table(spark, sf, "lineitem"), 1.0)


@query("SELECT DISTINCT p_type AS tag FROM part WHERE p_type IS NOT NULL")
def s34_distinct_tags(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("tag")).dropna().distinct()
