"""Boolean, phrase and proximity search: syntax trees to DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import PLAIN, Analyzer, terms
from quern.operators.index import Index
from quern.plans.query import And, Near, Not, Nothing, Or, Phrase, Term, leaves, parse


def analyse(spark, texts: Sequence[str], analyzer: Analyzer | None = PLAIN) -> list[list[tuple[str, int]]]:
    """Terms with positions of a few literal texts, in one small job."""
    if not texts:
        return []
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", terms(F.col("t"), analyzer).alias("x")).collect()
    found = {r["i"]: [(x["term"], x["pos"]) for x in r["x"]] for r in rows}
    return [found[i] for i in range(len(texts))]


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x + F.lit(by))


def chain_matches(positions: Sequence[Column], gaps: Sequence[int]) -> Column:
    """Whether one place has all words at their distances."""
    inside = [_shifted(p, -g) for p, g in zip(positions, gaps)]
    common = inside[0]
    for other in inside[1:]:
        common = F.array_intersect(common, other)
    return F.size(common) > 0


def any_pair_matches(positions: Sequence[Column], gaps: Sequence[int]) -> Column:
    """The looser test: any two neighbouring words stand at their distance."""
    out = F.lit(False)
    for (p, g), (q, h) in zip(zip(positions, gaps), list(zip(positions, gaps))[1:]):
        out = out | (F.size(F.array_intersect(_shifted(p, h - g), q)) > 0)
    return out


def near_matches(a: Column, b: Column, distance: int) -> Column:
    """Whether some occurrences are at most ``distance`` apart."""
    shifts = F.flatten(F.transform(a, lambda x: F.transform(F.sequence(F.lit(-distance), F.lit(distance)), lambda d: x + d)))
    return F.arrays_overlap(shifts, b)


class Evaluator:
    """Evaluates a tree over an index; every node is a set of document ids.

    The documents' term facts are collected once: one pass over the postings
    of all terms in the tree gives each document a map from term to positions,
    and the tree becomes one Boolean expression over that map. Only a tree that
    also matches documents without any of its terms touches the other ids.
    """

    def __init__(self, index: Index, analyzer: Analyzer | None = PLAIN, any_pair: bool = False):
        self.index, self.analyzer, self.any_pair = index, analyzer, any_pair

    def run(self, query) -> DataFrame:
        """(doc_id) of all matches. A term that the analyser removes matches
        nothing, as does an empty phrase."""
        tree = parse(query) if isinstance(query, str) else query
        spark = self.index.docs.sparkSession
        atoms = leaves(tree)
        texts = [t for a in atoms for t in ((a.left, a.right) if isinstance(a, Near) else (a.text,))]
        analysed = dict(zip(texts, analyse(spark, texts, self.analyzer)))
        wanted = sorted({t for ts in analysed.values() for t, _ in ts})
        if not wanted:
            hits = self._test(tree, analysed, None)
            return self.index.docs.where(hits).select("doc_id")
        places = any(isinstance(a, Near) or (isinstance(a, Phrase) and len(analysed[a.text]) > 1) for a in atoms)
        rows = self.index.postings_for(wanted)
        value = F.col("positions") if places else F.array().cast("array<int>")
        facts = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", value.alias("p")))).alias("facts"))
        if self._of_nothing(tree, analysed):  # documents with none of the terms match too
            facts = self.index.docs.select("doc_id").join(facts, "doc_id", "left").withColumn("facts", F.coalesce("facts", F.create_map().cast("map<string,array<int>>")))
        return facts.where(self._test(tree, analysed, F.col("facts"))).select("doc_id")

    def _of_nothing(self, tree, analysed) -> bool:
        if isinstance(tree, Not):
            return not self._of_nothing(tree.of, analysed)
        if isinstance(tree, And):
            return self._of_nothing(tree.left, analysed) and self._of_nothing(tree.right, analysed)
        if isinstance(tree, Or):
            return self._of_nothing(tree.left, analysed) or self._of_nothing(tree.right, analysed)
        return False

    def _test(self, tree, analysed, facts: Column | None) -> Column:
        has = lambda t: F.array_contains(F.map_keys(facts), t)
        at = lambda t: F.coalesce(F.try_element_at(facts, F.lit(t)), F.array().cast("array<int>"))
        if isinstance(tree, Not):
            return ~self._test(tree.of, analysed, facts)
        if isinstance(tree, And):
            return self._test(tree.left, analysed, facts) & self._test(tree.right, analysed, facts)
        if isinstance(tree, Or):
            return self._test(tree.left, analysed, facts) | self._test(tree.right, analysed, facts)
        if isinstance(tree, Nothing) or facts is None:
            return F.lit(False)
        if isinstance(tree, Near):
            a, b = analysed[tree.left], analysed[tree.right]
            return near_matches(at(a[0][0]), at(b[0][0]), tree.distance) if a and b else F.lit(False)
        found = analysed[tree.text]
        if not found:
            return F.lit(False)
        if isinstance(tree, Term) or len(found) == 1:
            return has(found[0][0])
        test = F.lit(True)
        for t, _ in found:
            test = test & has(t)
        match = any_pair_matches if self.any_pair else chain_matches
        return test & match([at(t) for t, _ in found], [p for _, p in found])


def intersection(index: Index, wanted: Sequence[str], positions: bool = False) -> DataFrame:
    """Documents that have all terms: (doc_id, tf of the first term), and with
    ``positions`` a map from term to positions. Empty terms are skipped."""
    own = [t for t in dict.fromkeys(wanted) if t]
    rows = index.postings_for(own)
    extra = [F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("positions")] if positions else []
    out = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("term") == (own[0] if own else ""), F.col("tf"))).alias("tf"), *extra)
    return out.where(F.col("n") == len(own)).drop("n")


def union(index: Index, wanted: Sequence[str]) -> DataFrame:
    """Documents that have any of the terms."""
    return index.postings_for([t for t in wanted if t]).select("doc_id").distinct()


def complement(index: Index, found: DataFrame) -> DataFrame:
    """Documents of the index that aren't in ``found``."""
    return index.docs.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def id_complement(found: DataFrame, low: int, high: int) -> DataFrame:
    """All integers of a range that aren't in ``found``, documents or not."""
    return found.sparkSession.range(low, high + 1).withColumnRenamed("id", "doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def conditional_intersection(sets: Sequence[DataFrame], floor: int = 100) -> DataFrame:
    """Narrow the first set by each next one only while more than ``floor``
    documents remain."""
    current = sets[0].select("doc_id").distinct()
    for s in sets[1:]:
        both = current.join(s.select("doc_id").distinct(), "doc_id", "left_semi")
        if both.limit(floor + 1).count() > floor:
            current = both
    return current
