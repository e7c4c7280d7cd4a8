"""Source divergence audit: how far the sources of a language differ in the terms that they use, and in which.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as one). A language keeps
the terms of enough of its documents. Each kept term is one row with a vector of counts over the sources of
its language, in their order; higher-order functions turn counts into smoothed shares per billion and emit
what the term adds to each pair of sources, and sums that start in the tasks add that up.

Most terms are missing from most sources, and two sources that both lack a term always differ by the same
amount. So a term emits pairs with a source that has it only, as the difference to that amount, and the
amount itself is added once for all terms: the work follows the counts, not the square of the sources.
Shares and values are whole numbers and exact for up to 9 * 10**15 occurrences.

DataFrame functions only. Tables of a row per language are joined under salts, so that a language with most
terms is many tasks' work; whether they are broadcast is left to their size.

Defined cases: null text, language and source are empty strings; repeated rows are documents of their own; a
source without kept terms has the uniform share; a language without kept terms has pairs of value zero and no
terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagplane.llm.common import LOWER, UPPER, lower_ascii, table, written

#: What a term is, and what stands between terms.
TERM, OTHER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in; terms that are listed for each source.
LEAST_DOCS, TOP = 10, 10
BILLION = 1_000_000_000
SALTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of docs(text, lang, source).

    The terms of a document are sorted, so that the first of each run stands for the document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(lower_ascii(text))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.sort_array(F.split(lowered, OTHER)).alias("terms"))
    each = F.transform("terms", lambda x, i: F.struct(x.alias("term"), (~x.eqNullSafe(F.get("terms", i - 1))).cast("long").alias("first")))
    rows = named.select("lang", "source", F.explode(each).alias("t")).select("lang", "source", "t.term", "t.first").where("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def wide_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, cells: the kept terms with the count of each source that has them."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return kept.where(F.col("docs") >= least_docs).select("lang", "term", "cells")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / total), by long division where the product passes 64 bits."""
    a = count + 2
    div = lambda x, y: F.call_function("div", x, y)
    rest1 = (a * 1000) % total
    rest2 = (rest1 * 1000) % total
    long = div(a * 1000, total) * 1_000_000 + div(rest1 * 1000, total) * 1000 + div(rest2 * 1000, total)
    return F.when(a < 9 * BILLION, div(a * BILLION, total)).otherwise(long) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def languages(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, v, sources, totals, nothing, total of each language: kept terms, its sources in order with
    their totals over kept terms and their share of a term that they lack, and the whole total plus 2 * v."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = wide.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    sizes = wide.groupBy("lang").agg(F.count("*").alias("v"))
    each = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v"])
    rows = each.groupBy("lang", "v").agg(F.array_sort(F.collect_list(F.struct("source", (F.col("n") + 2 * F.col("v")).alias("d")))).alias("g"))
    nothing = F.transform("g.d", lambda d: F.when(d > 0, _share(F.lit(0).cast("long"), d)))
    sums = F.aggregate("g.d", F.lit(0).cast("long"), lambda s, d: s + d) - 2 * F.col("v") * (F.size("g") - 1)
    return rows.select("lang", "v", F.col("g.source").alias("sources"), F.col("g.d").alias("totals"), nothing.alias("nothing"), sums.alias("total"))


def shares(wide: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, term, sources, nothing, counts and p over the sources, q of the whole language."""
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = wide.withColumn("salt", salt).join(salted, ["lang", "salt"])
    held = met.withColumn("held", F.map_from_entries("cells"))
    dense = held.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long"))))
    p = F.transform(F.arrays_zip("counts", "totals"), lambda x: _share(x["counts"], x["totals"]))
    q = _share(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x), F.col("total"))
    return dense.select("lang", "term", "sources", "nothing", "counts", p.alias("p"), q.alias("q"))


def pair_values(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: each two sources of a language and how far they are apart, over all kept terms."""
    places = F.sequence(F.lit(0), F.size("counts") - 1)
    at = lambda c, k: F.get(F.col(c), k)

    def emitted(i: Column) -> Column:
        # Of two sources that both have the term the earlier one emits the pair.
        others = F.filter(places, lambda j: (j != i) & ((j > i) | (at("counts", j) == 0)))
        return F.transform(others, lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), (_apart(at("p", i), at("p", j)) - _apart(at("nothing", i), at("nothing", j))).alias("more")))

    pairs = F.flatten(F.transform(F.filter(places, lambda i: at("counts", i) > 0), emitted))
    more = vectors.select("lang", F.explode(pairs).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.more").alias("more"))
    first = langs.select("lang", "v", "sources", "nothing", F.posexplode("sources").alias("i", "source"))
    two = first.select("lang", "v", "i", "source", F.get("nothing", F.col("i")).alias("p"), "nothing", F.posexplode("sources").alias("j", "item")).where("i < j")
    same = F.when(F.col("v") > 0, F.col("v") * _apart(F.col("p"), F.get("nothing", F.col("j")))).otherwise(0)
    both = two.withColumn("same", same).join(more, ["lang", "i", "j"], "left").select("lang", "source", "item", (F.col("same") + F.coalesce("more", F.lit(0))).alias("value"))
    return both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def term_values(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms that a source uses more than its language does, and how far."""
    own = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    rows = vectors.select("lang", "term", "q", F.explode(own).alias("x"))
    return rows.select("lang", F.col("x.sources").alias("source"), F.col("term").alias("item"), _apart(F.col("x.p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per source all others of its language, and its ``top`` terms."""
    wide = written(wide_terms(term_counts(docs), least_docs), "wide-terms")
    langs = written(languages(docs, wide), "languages")
    vectors = shares(wide, langs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair_values(vectors, langs), "pair").unionByName(ranked(term_values(vectors), "term").where(F.col("rank") <= top))


def op13_wide_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_ORACLE = rf"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id, coalesce(text, '') as text from documents),
t as (select lang, source, id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct id) as docs from t group by all),
k as (select lang, term from c group by all having sum(docs) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by all),
cell as (select g.lang, g.source, k.term, cast(coalesce(n, 0) as hugeint) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + {BILLION} * (n + 2) // (sum(n) over (partition by lang, source) + 2 * v) as p from cell join v using (lang)),
whole as (select lang, term, 1 + {BILLION} * (s + 2) // (sum(s) over (partition by lang) + 2 * v) as q from (select lang, term, sum(n) as s from cell group by all) join v using (lang)),
pair as (select a.lang, a.source, b.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from g a join g b on b.lang = a.lang and b.source <> a.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term where x.term is null or y.term is not null group by all),
own as (select p.lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join whole using (lang, term) where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pair union all select lang, source, 'term', item, value from own),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {TOP}"""
