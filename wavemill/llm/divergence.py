"""How far each source of a language departs from the other sources and from the language, by smoothed term shares.

Plain relational: matches of the term expression are exploded and counted, the
groups are crossed with their language's kept vocabulary so that zeros count,
the dense table is joined with itself on language and term, summed and ranked.
All numbers are whole and exact.

Nulls in text, language and source count as empty strings. An empty text adds its
group but no terms; a language without kept terms gives pairs of value 0. Ties are
ranked by the item's bytes; repeated rows are documents of their own. Columns beyond
text, lang and source are never read, whatever their names. An empty table gives no
rows. Texts of any length are read whole; a row's terms are held as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import broadcast_if_small, materialize

#: A term is a run of ASCII letters and characters beyond ASCII; terms stand between runs of the others.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCALE = 1_000_000_000


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, occurrences, documents); the empty term stands where a text has none, so that no group is lost.

    The matches of ``TERM`` are taken as what lies between the matches of its
    complement, which Spark does several times faster. Each row's terms are
    sorted and compared with the one before, so documents are counted in the
    same partial aggregation as occurrences.
    """
    said = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.sort_array(F.split(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER), BETWEEN)).alias("terms"),
    )
    before = F.concat(F.array(F.lit("")), F.slice("terms", 1, F.size("terms") - 1))
    each = said.select("lang", "source", F.explode_outer(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))).alias("x"))
    each = each.select("lang", "source", "x.term", (F.col("x.term") != F.col("x.before")).cast("long").alias("first"))
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("first").alias("documents"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + terms)), exact beyond 64 bits."""
    wide = [f"cast({c} as decimal(19,0))" for c in (count, total, terms)]
    return F.expr(f"1 + (cast({_SCALE} as decimal(10,0)) * ({wide[0]} + 1)) div ({wide[1]} + {wide[2]})")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, *, least_docs: int = 3, top_terms: int = 200, max_groups: int = 100_000, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and terms that a source uses more than its language.

    The dense table has sources x kept terms of a language, and its self-join
    sources x sources x kept terms, all summed where they are made. The list of
    groups is broadcast up to ``max_groups`` rows (counted), else joined by Spark.
    """
    counts = materialize(term_counts(docs, **columns))
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("occurrences").alias("all_count"), F.sum("documents").alias("df"))
    # numbers stand for terms and groups in the wide joins; they are written, so they stay as they are
    kept = materialize(vocabulary.where(F.col("df") >= least_docs).drop("df").withColumn("tid", F.monotonically_increasing_id()))
    named = materialize(counts.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()))
    mine = counts.join(kept.select("lang", "term", "tid"), ["lang", "term"]).join(broadcast_if_small(named, max_groups), ["lang", "source"])
    mine = materialize(mine.select("gid", "tid", "occurrences"))
    sizes = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_count").alias("all_total")))
    totals = mine.groupBy("gid").agg(F.sum("occurrences").alias("total"))
    groups = named.join(totals, "gid", "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", "gid", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms")])
    zero = F.when(F.col("terms") > 0, _share("0", "total", "terms"))  # the share of a term that a group lacks
    groups = materialize(groups.withColumn("p_zero", zero))
    small = broadcast_if_small(groups, max_groups)
    present = mine.join(small, "gid").select("tid", "gid", _share("occurrences", "total", "terms").alias("p_own"))
    shared = kept.join(broadcast_if_small(sizes, max_groups), "lang").select("lang", "tid", _share("all_count", "all_total", "terms").alias("q"))
    crossed = shared.join(small, "lang").select("tid", "gid", "q", "p_zero")
    dense = crossed.join(present, ["tid", "gid"], "left")
    dense = materialize(dense.select("tid", "gid", F.coalesce("p_own", "p_zero").alias("p"), "q", F.col("p_own").isNotNull().alias("present")))
    one, other = dense.select("tid", "gid", "p"), dense.select("tid", F.col("gid").alias("gid_other"), F.col("p").alias("p_other"))
    met = one.join(other, "tid").where("gid < gid_other")  # a term has one language; both directions of a pair are summed at once
    both = met.groupBy("gid", "gid_other").agg(F.sum(_distance("p", "p_other")).alias("there"), F.sum(_distance("p_other", "p")).alias("back"))
    there, back = (F.struct(F.col(g).alias("gid"), F.col(o).alias("item_gid"), F.col(v).alias("value")) for g, o, v in (("gid", "gid_other", "there"), ("gid_other", "gid", "back")))
    names = groups.select("gid", "lang", "source")
    sums = both.select(F.explode(F.array(there, back)).alias("x")).select("x.*").join(broadcast_if_small(names, max_groups), "gid")
    sums = sums.join(broadcast_if_small(names.select(F.col("gid").alias("item_gid"), F.col("source").alias("item")), max_groups), "item_gid").select("lang", "source", "item", "value")
    # languages without a kept term have no dense rows, yet pairs of value 0
    bare = groups.where("terms = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(zeros).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    over = dense.where("present and p > q").select("tid", "gid", _distance("p", "q").alias("value"))
    over = over.join(kept.select("tid", F.col("term").alias("item")), "tid").join(broadcast_if_small(names, max_groups), "gid")
    terms = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ts FROM documents),
one AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_count FROM one GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT g.lang, count(kept.term) AS v, coalesce(sum(all_count), 0) AS all_n FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS c FROM one GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.all_count, v.v, v.all_n,
                 CAST(sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS n
          FROM grp g JOIN kept k USING (lang) JOIN vs v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, c, CAST(1 + (1000000000 * CAST(c + 1 AS HUGEINT)) // (n + v) AS BIGINT) AS p,
             CAST(1 + (1000000000 * CAST(all_count + 1 AS HUGEINT)) // (all_n + v) AS BIGINT) AS q FROM dense),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS BIGINT) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
         GROUP BY ALL),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
               UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
