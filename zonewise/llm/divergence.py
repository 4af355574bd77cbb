"""Source divergence audit over a frequent-pattern tree of term rows.

Per language, how far the smoothed term distributions of its sources lie from each other (``pair``), and which terms set a
source apart from its language (``term``). A term's row lists the sources that have it, in one order per language,
with the share each gives it. Pairs of sources start from the value they would have if neither had any term; a term then
corrects it. What depends on one source's share alone is summed up per distinct share. What depends on two
shares comes from the tree: rows go in source order with their multiplicities, equal beginnings share a path, and every node
meets each of its ancestors once, for all the terms that pass through both. Corrections are linear in the multiplicities, so
trees of parts of the rows add up, and rows are dealt out by range, which keeps equal beginnings together.

    f(p, q) = p0 part + (f(p, q0) - f(p0, q0)) + (f(p0, q) - f(p0, q0)) + [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

All numbers are integers, so every order of summation gives the same. The result names every pair of sources of a
language; a row of the tree is never longer than the number of sources of its language.

Defined cases: null text, lang and source are empty strings; a source without kept terms has the smoothed share of nothing;
a language without kept terms has pair values 0 and no term rows; repeated rows are documents of their own; texts of any
length are split in bounded blocks; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workset import Scratch, salted_join

LEAST_DOCUMENTS, TOP = 10, 10
# Shares are counted in parts of this; a term that a source lacks counts as PRIOR occurrences.
SCALE, PRIOR = 1_000_000_000, 2
# A task hands on its counts beyond so many entries, its tree beyond so many nodes; texts are split in blocks of bytes.
ENTRIES, NODES, BLOCK = 200_000, 200_000, 4 << 20
_SLICE = 500

# Terms: letters A to Z without case and all bytes beyond ASCII; every other byte parts them.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def _blocks(text: bytes):
    start = 0
    while len(text) - start > BLOCK:
        space = text.find(b" ", start + BLOCK)
        if space < 0:
            break
        yield text[start:space]
        start = space
    yield text[start:]


def terms_of(text: bytes) -> Counter:
    plain = text.translate(_LETTERS)
    if len(plain) <= BLOCK:
        return Counter(plain.split())
    out = Counter()
    for block in _blocks(plain):
        out.update(block.split())
    return out


def _count(batches):
    """Occurrences and documents per language, source and term, summed up within the task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    met: dict[tuple, tuple[Counter, Counter]] = {}

    def told():
        for (lang, source), (n, docs) in met.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), terms, list(n.values()), [docs[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for k in range(0, batch.num_rows, _SLICE):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(k, _SLICE).columns), strict=True):
                if (lang, source) not in met:
                    met[lang, source] = Counter(), Counter()
                n, docs = met[lang, source]
                found = terms_of(text)
                n.update(found)
                docs.update(found.keys())
            if sum(len(n) for n, _ in met.values()) > ENTRIES:
                yield from told()
                met.clear()
    yield from told()


def term_rows(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, at (source, n): the kept terms of every language and where they occur."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    counts = docs.select(*_group(), text).mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at")
    )
    return per_term.filter(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "total", "at")


def _group() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), without overflow."""
    return F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), (total + PRIOR * kept).cast("decimal(20,0)")
    ) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def sources(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, at (place in the order of its language), total, lang_total, kept, p0: one row per source that occurs."""
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    per_source = rows.select("lang", F.inline("at")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    every = docs.select(*_group()).distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    every = every.na.fill(0, ["total", "n_terms", "kept", "lang_total"])
    # sources of many terms stand first, where paths are shared most
    order = Window.partitionBy("lang").orderBy(F.desc("n_terms"), "source")
    nothing = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1)
    return every.select("lang", "source", (F.row_number().over(order) - 1).alias("place"), "total", "lang_total", "kept", nothing.alias("p0"))


class Tree:
    """Term rows by source order: a node per distinct beginning, with the number of terms that pass through it."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.below: dict[tuple, int] = {}
        self.parent, self.lang, self.place, self.p, self.p0, self.terms = ([] for _ in range(6))

    def insert(self, lang: str, places: list[int], shares: list[int], nothings: list[int], times: int) -> None:
        code = self.langs.setdefault(lang, len(self.langs))
        at = -1 - code
        for place, p, p0 in zip(places, shares, nothings, strict=True):
            node = self.below.get((at, place, p))
            if node is None:
                node = self.below[at, place, p] = len(self.parent)
                for column, value in zip((self.parent, self.lang, self.place, self.p, self.p0, self.terms), (max(at, -1), code, place, p, p0, 0), strict=True):
                    column.append(value)
            self.terms[node] += times
            at = node

    def corrections(self) -> tuple[np.ndarray, ...]:
        """lang code, place, later place, value: every node with each of its ancestors, summed up per pair of sources."""
        parent, lang, place, p, p0, terms = (np.array(c, np.int64) for c in (self.parent, self.lang, self.place, self.p, self.p0, self.terms))
        wide = place.max(initial=0) + 1
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node, over = np.arange(len(parent)), parent
        while len(node := node[over >= 0]):
            over = over[over >= 0]
            x, x0, y, y0 = p[node], p0[node], p[over], p0[over]
            value = terms[node] * (_apart(x, y) - _apart(x, y0) - _apart(x0, y) + _apart(x0, y0))
            found, value = _sums((lang[node] * wide + place[over]) * wide + place[node], value)
            keys.append(found)
            values.append(value)
            over = parent[over]
        key, value = _sums(np.concatenate(keys), np.concatenate(values))
        return key // wide // wide, key // wide % wide, key % wide, value


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(key, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, where, value)
    return found, out


def _corrections(batches):
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def told(tree):
        names, (lang, a, b, value) = np.array([*tree.langs], object), tree.corrections()
        return pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value)], schema=schema)

    tree = Tree()
    for batch in batches:
        for lang, path, times in zip(*(batch.column(c) for c in ("lang", "path", "times")), strict=True):
            items = path.values
            tree.insert(lang.as_py(), *(items.field(c).to_pylist() for c in ("place", "p", "p0")), times.as_py())
            if len(tree.parent) > NODES:
                yield told(tree)
                tree = Tree()
    if tree.langs:
        yield told(tree)


def audit(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank; the result reads tables of ``scratch``."""
    rows = scratch.settle(term_rows(docs, least))
    known = scratch.settle(sources(docs, rows))
    n_known = known.count()
    flat = rows.select("lang", "term", F.col("total").alias("everywhere"), F.inline("at"))
    flat = salted_join(flat, known, ["lang", "source"], "inner", F.col("term"), right_rows=n_known)
    flat = scratch.settle(
        flat.select(
            "lang", "term", "source", "place", "p0",
            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
            share(F.col("everywhere"), F.col("lang_total"), F.col("kept")).alias("q"),
        )
    )
    first = lambda c: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), c))
    marked = flat.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    marked = marked.withColumn("rank", first("item")).filter(F.col("rank") <= top)

    paths = flat.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "p0"))).alias("path"))
    paths = scratch.settle(paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")))
    together = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_corrections, "lang string, a int, b int, value long")

    other = known.select("lang", F.col("place").alias("b"), F.col("p0").alias("q0"), F.col("kept"))
    shares = paths.select("lang", "times", F.inline("path")).groupBy("lang", "place", "p", "p0").agg(F.sum("times").alias("times"))
    beside = lambda left, condition: salted_join(left, other, ["lang"], "inner", F.col("place"), condition, n_known)
    alone = beside(scratch.settle(shares), F.col("place") != F.col("b")).select(
        "lang",
        F.least("place", "b").alias("a"),
        F.greatest("place", "b").alias("b"),
        (F.col("times") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("value"),
    )
    start = beside(known.select("lang", "place", "p0"), F.col("place") < F.col("b")).select(
        "lang", F.col("place").alias("a"), "b", (F.col("kept") * apart(F.col("p0"), F.col("q0"))).alias("value")
    )
    pairs = start.unionByName(alone).unionByName(together).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = scratch.settle(pairs).select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    both = both.select("lang", "value", "x.a", "x.b")
    for place, name in (("a", "source"), ("b", "item")):
        names = known.select("lang", F.col("place").alias(place), F.col("source").alias(name))
        both = salted_join(both, names, ["lang", place], "inner", F.col("value"), right_rows=n_known)
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", first("item"))
    return both.unionByName(marked)
