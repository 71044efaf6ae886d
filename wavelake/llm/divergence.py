"""Source divergence audit: how far the word use of each source of a language lies from other sources and the language.

Each language keeps the terms that enough of its documents hold. A group is a (language, source). Smoothed shares of the
kept terms are whole numbers p (parts of SHARE), and two of them differ by f = floor((p - q)^2 / (p + q)); all arithmetic
is exact. f depends on the two counts alone, so nothing is worked out for each term:

* terms of a group are grouped to cells of equal (group count, language count), f is evaluated once a cell, cells of equal
  value are merged and ranked by their cumulative multiplicity, and only the cells that reach the wanted ranks are expanded
  to their terms, in UTF-8 order;
* the sum over all kept terms for two groups is V * f(0, 0), plus for each group its cells of a count against none, plus
  for the terms that both hold, in cells of both counts, what these differ from that.

Texts are counted in blocks before anything is shuffled, so a hot word, source or language is a row for each block and
then combined before its shuffle. No step holds the terms of a group together: windows are limited to the ranks asked for
before their shuffle, or run over the sources of a language, which the result lists in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, blocks, materialise, table, text_bytes

SHARE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, number of the text of each): runs of ASCII letters and all other characters beyond ASCII, lower-cased A-Z."""
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        some = offsets[:-1] < offsets[1:]
        a, z = offsets[:-1][some], offsets[1:][some] - 1
        first[a], last[z] = solid[a], solid[z]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    o = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=o[1:])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(o), pa.py_buffer(_LOWER[data[solid]])])
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of blocks of `docs` (lang, source, text, none null): occurrences and documents of a
    term, and for each group a row without a term."""

    def rows(batches):
        for block in blocks(batches):
            terms, of = _terms(*text_bytes(block))
            terms = terms.dictionary_encode()
            names, ids = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = pa.StructArray.from_arrays([block.column(c).combine_chunks() for c in ("lang", "source")], ["lang", "source"])
            keys: dict = {}
            of_doc = np.fromiter((keys.setdefault((g["lang"], g["source"]), len(keys)) for g in group.to_pylist()), np.int64, len(group))
            width = max(1, len(names))
            pair, n = np.unique(of * width + ids, return_counts=True)  # each term of each text once
            cell, back = np.unique(of_doc[pair // width] * width + pair % width, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64)  # whole numbers far below 2^53
            df = np.bincount(back, minlength=len(cell))
            who = np.append(cell // width, np.arange(len(keys)))
            what = pa.array(np.append(cell % width, np.zeros(len(keys), np.int64)), mask=np.append(np.zeros(len(cell), bool), np.ones(len(keys), bool)))
            langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
            none = np.zeros(len(keys), np.int64)
            term = names.take(what).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(who)), sources.take(pa.array(who)), term, pa.array(np.append(total, none)), pa.array(np.append(df, none))], names=["lang", "source", "term", "n", "df"])

    return docs.mapInArrow(rows, "lang string, source string, term string, n long, df long")


def _share(count: str, total: str, kept: str) -> Column:
    """p of a count: 1 + floor(SHARE * (count + 2) / (total + 2 * kept)), in decimals that no count overflows; null if no
    term is kept."""
    return F.expr(f"1 + cast(({SHARE}BD * (cast({count} as decimal(20, 0)) + 2)) div nullif(cast({total} as decimal(20, 0)) + 2 * {kept}, 0) as bigint)")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value long, rank int) of `docs` (text, lang, source).

    part `pair`: for each group each other source of its language, value the summed gap over all kept terms, all ranks;
    part `term`: the terms that the group uses more than its language, value their gap, up to `ranks`. least: the documents
    of a language that a kept term needs. Null texts, langs and sources are empty ones; groups without a term, and
    languages that keep none, have pairs of value 0 or of the shares of counts of 0; ties in value are ranked by the item's
    UTF-8 bytes; repeated rows are documents of their own; texts of any length are read whole; other columns, whatever
    their names, are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = _counted(plain).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = materialise(counts, "divergence-counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least)
    held = materialise(terms.drop("df").join(kept.drop("df").hint("merge"), ["lang", "term"]), "divergence-kept")

    # a row for each group: its total N, kept terms held; and its language's
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang = held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(lang, "lang", "left")
    groups = materialise(groups.na.fill(0, ["total", "kept", "lang_total"]), "divergence-groups")

    cells = held.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many"))
    cells = materialise(cells, "divergence-cells")
    out = _pairs(held, cells, groups).unionByName(_terms_ranked(held, cells, groups, ranks))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _terms_ranked(held: DataFrame, cells: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """Cells by value, merged where values are equal, as far as their cumulative multiplicity begins within `ranks`."""
    valued = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("lang_n", "lang_total", "kept"))
    valued = materialise(valued.where("p > q").withColumn("value", _gap("p", "q")).select("lang", "source", "n", "lang_n", "many", "value"), "divergence-values")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    top = merged.withColumn("nth", F.row_number().over(down)).where(F.col("nth") <= ranks)  # limited before its shuffle
    top = top.withColumn("before", F.coalesce(F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < ranks)
    reach = valued.drop("many").join(top.select("lang", "source", "value", "before").hint("merge"), ["lang", "source", "value"])
    items = held.join(reach.hint("merge"), ["lang", "source", "n", "lang_n"])
    by = Window.partitionBy("lang", "source", "value").orderBy("term")
    items = items.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= ranks)  # of many equal values the first terms only
    items = items.withColumn("rank", F.col("before") + F.col("nth")).where(F.col("rank") <= ranks)
    return items.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(held: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed gap of each two groups of a language, from cells of counts."""
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), "kept") for x in "ab")
    pairs = materialise(a.join(b.drop("kept"), "lang").where("a < b"), "divergence-pairs")

    def p(count: str, x: str) -> Column:
        return _share(count, f"total_{x}", "kept")

    def shares(df: DataFrame, **counts: str) -> DataFrame:
        return df.withColumns({f"p{k}": p(v, k[0]) for k, v in counts.items()})

    zero = shares(pairs, a0="0", b0="0").select("lang", "a", "b", F.coalesce(F.col("kept") * _gap("pa0", "pb0"), F.lit(0)).alias("part"))
    singles = cells.groupBy("lang", "source", "n").agg(F.sum("many").alias("many"))
    singles = materialise(singles, "divergence-singles")
    parts = [zero]
    for x, y in ("ab", "ba"):
        one = pairs.join(singles.withColumnRenamed("source", x), ["lang", x])
        one = shares(one, **{f"{x}": "n", f"{x}0": "0", f"{y}0": "0"})
        parts.append(one.select("lang", "a", "b", (F.col("many") * (_gap(f"p{x}", f"p{y}0") - _gap("pa0", "pb0"))).alias("part")))
    left, right = (held.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = left.join(right.hint("merge"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count("*").alias("many"))
    both = shares(both.join(pairs, ["lang", "a", "b"]), a="n_a", b="n_b", a0="0", b0="0")
    parts.append(both.select("lang", "a", "b", (F.col("many") * (_gap("pa", "pb") - _gap("pa", "pb0") - _gap("pa0", "pb") + _gap("pa0", "pb0"))).alias("part")))
    total = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    total = materialise(total, "divergence-sums")
    mirrored = total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return mirrored.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle(least: int = 10, ranks: int = 10) -> str:
    """The same rows by a row for each group and kept term."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {least}),
lang_size AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
x AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + {SHARE}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v) AS p, 1 + {SHARE}::HUGEINT * (kept.n + 2) // (lang_size.total + 2 * v) AS q
  FROM g JOIN kept USING (lang) JOIN lang_size USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM x a JOIN x b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM x WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= {ranks}"""
