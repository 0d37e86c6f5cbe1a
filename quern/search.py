"""The query surface: free-text, Boolean and semantic search over an index."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import PLAIN, Analyzer
from quern.operators import ranking, rerank
from quern.operators.boolean import Evaluator, analyse
from quern.operators.expand import boost, expand_query
from quern.operators.index import Index
from quern.operators.vectors import nearest
from quern.plans.query import FreeText

#: Rows of ranked results (16 bytes each) that a ``Search`` keeps for later pages.
CACHE_ROWS = 4_000_000


@dataclass
class Options:
    """What a request may ask for."""

    page: int = 0
    page_size: int = 10
    clusters: Sequence[str] = ()
    date: str | None = None  # newest or oldest
    rerank_metadata: bool = False
    rerank_lm: bool = False
    use_semantic: bool = False
    boost_terms: bool = False
    expansion: bool = False
    k_word_expansion: int = 3

    @staticmethod
    def of(request: Mapping) -> tuple[str, Options]:
        """Query string and options of a decoded request; text booleans are read
        as words, so "false" is false, and tags may be a comma list."""
        truth = lambda v: v.strip().lower() in ("1", "true", "yes") if isinstance(v, str) else bool(v)
        filters, options = dict(request.get("filters") or {}), dict(request.get("options") or {})
        flat = {**request, **filters, **options}
        tags = flat.get("tags") or ()
        tags = [t.strip() for t in tags.split(",") if t.strip()] if isinstance(tags, str) else list(tags)
        names = ("rerank_metadata", "rerank_lm", "use_semantic", "boost_terms", "expansion")
        return str(flat.get("query") or ""), Options(max(int(flat.get("page") or 0), 0), max(int(flat.get("page_size") or 10), 1), tags, flat.get("date"), *(truth(flat.get(n) or False) for n in names), int(flat.get("k_word_expansion") or 3))


@dataclass
class Result:
    """A page of rows, and what a caller shows around it."""

    rows: DataFrame
    total_results: int
    has_next: bool
    has_prev: bool
    query: str

    def to_json(self) -> str:
        rows = [json.loads(x) for x in self.rows.toJSON().collect()]  # one page
        return json.dumps({"results": rows, "total_results": self.total_results, "has_next": self.has_next, "has_prev": self.has_prev, "query": self.query})


@dataclass
class Search:
    index: Index
    analyzer: Analyzer | None = PLAIN
    clusters: DataFrame | None = None  # cluster_id, cluster, tag
    vectors: DataFrame | None = None  # doc_id, embedding
    vocabulary: DataFrame | None = None  # term, embedding
    embed: object = None  # texts -> matrix
    boosted: Sequence[str] = ()
    depth: int = rerank.DEPTH
    _cache: OrderedDict = field(default_factory=OrderedDict)

    def _words(self, query: str, o: Options) -> list[str]:
        spark = self.index.docs.sparkSession
        words = [t for t, _ in analyse(spark, [query], self.analyzer)[0]]
        if o.expansion and self.vocabulary is not None:
            words = expand_query(self.vocabulary, words, o.k_word_expansion)
        return boost(words, self.boosted) if o.boost_terms else words

    def _ranked(self, key: tuple, make) -> tuple[DataFrame, int]:
        """Ranked ids and their number, kept for the queries asked last."""
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        found = make().persist()
        self._cache[key] = found, found.count()
        while len(self._cache) > 1 and sum(n for _, n in self._cache.values()) > CACHE_ROWS:
            _, (old, _) = self._cache.popitem(last=False)
            old.unpersist()
        return self._cache[key]

    def search(self, query: str, options: Options = Options()) -> Result:
        """Ranked search. A semantic request is answered by vectors alone; a
        result shorter than a page is filled up with nearest neighbours."""
        o = options
        if o.use_semantic and self.vectors is not None and self.embed is not None:
            found = nearest(self.vectors, self.embed([query])[0], (o.page + 1) * o.page_size, "doc_id").withColumnRenamed("score", "lm_score")
            rows = rerank.format_results(rerank.page(found, o.page, o.page_size), self.index.docs, self.clusters).orderBy(F.desc("lm_score"), "doc_id")
            return Result(rows, found.count(), False, o.page > 0, query)
        words = FreeText.of(self._words(query, o))
        ranked, total = self._ranked(("free", words.words), lambda: ranking.search(self.index, words))
        out = self._post(ranked, total, query, o, True)
        if total < o.page_size and self.vectors is not None and self.embed is not None:
            near = nearest(self.vectors, self.embed([query])[0], o.page_size, "doc_id").select("doc_id", F.lit(None).cast("double").alias("bm25_score"))
            out.rows = rerank.backfill(out.rows, rerank.format_results(near, self.index.docs, self.clusters), o.page_size)
        return out

    def advanced_search(self, query: str, options: Options = Options()) -> Result:
        """Boolean search: unranked, by document id, without a limit."""
        ranked, total = self._ranked(("tree", query), lambda: Evaluator(self.index, self.analyzer).run(query).withColumn("bm25_score", F.lit(0.0)))
        return self._post(ranked, total, query, options, False)

    def _post(self, ranked: DataFrame, total: int, query: str, o: Options, may_use_lm: bool) -> Result:
        best = ranked.orderBy(F.desc("bm25_score"), "doc_id")
        first = o.page * o.page_size
        rows = None
        if first < self.depth and (o.rerank_metadata or o.rerank_lm):
            top = rerank.filter_clusters(rerank.format_results(best, self.index.docs, self.clusters), self.clusters, o.clusters) if o.clusters and self.clusters is not None else rerank.format_results(best.limit(self.depth), self.index.docs, self.clusters)
            top = top.orderBy(F.desc("bm25_score"), "doc_id").limit(self.depth)
            order = "metadata_score"
            if o.rerank_metadata:
                top = rerank.rerank_metadata(top)
            if o.rerank_lm and may_use_lm and self.vectors is not None and self.embed is not None:
                top = rerank.add_lm_score(top, self.vectors, self.embed([query])[0])
                order = "lm_score"
                if o.rerank_metadata:
                    top, order = rerank.fuse(top), "final_score"
            head = rerank.page(top.orderBy(F.desc(order), "doc_id"), o.page, o.page_size)
            tail = max(0, first + o.page_size - self.depth)
            rows = head
            if tail:  # the part of the page behind the re-ranked rows
                rest = rerank.format_results(best.offset(self.depth).limit(tail), self.index.docs, self.clusters)
                rows = head.unionByName(rest, allowMissingColumns=True)
        else:
            source = best if o.clusters and self.clusters is not None else best.offset(first).limit(o.page_size)
            rows = rerank.format_results(source, self.index.docs, self.clusters)
            if o.clusters and self.clusters is not None:
                rows = rerank.filter_clusters(rows, self.clusters, o.clusters)
            rows = rows.orderBy(F.desc("bm25_score"), "doc_id")
            if o.clusters and self.clusters is not None:
                rows = rerank.page(rows, o.page, o.page_size)
        return Result(rerank.sort_by_date(rows, o.date), total, first + o.page_size < total, o.page > 0, query)
