"""Filter interaction audit: what each order of five filters removes, and each filter's Shapley share, from counts per failure mask."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: A filter's letter and bit; a document's failure mask is the sum of the bits that it fails.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
MASKS = range(1 << len(FILTERS))
#: Documents counted three times over: all, those of quality 1, those marked toxic.
KINDS = ("n", "good", "toxic")
#: Orders of the filters; a multiple of every number of filters, so that shares times ORDERS are whole.
ORDERS = 120


def own_failures(text: Column) -> Column:
    """The bits of A to D that a text fails by itself; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    bit = lambda name, failed: F.when(failed, F.lit(FILTERS[name])).otherwise(F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    of_words = let(words(text), lambda w: bit("A", F.size(w) < 50) + bit("B", 100 * F.size(F.array_distinct(w)) < 65 * F.size(w)))
    return of_words + bit("C", 100 * capitals.cast("long") > 5 * F.length(text)) + bit("D", text.rlike(r"[#$%&*|]"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents per source and failure mask, from two passes of partial aggregation.

    Texts travel as digests only. A document fails E where the least doc_id of its digest is smaller than its own, so
    only (digest, doc_id) pairs are joined, never a group of copies with itself; equal rows are counted before that.
    """
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", own_failures(F.col("text")).alias("own"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")
    )
    rows = rows.groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marked = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(FILTERS["E"])).otherwise(F.lit(0))
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return rows.join(least, ["digest", "doc_id"], "left").join(marked, "doc_id", "left").groupBy("part", (F.col("own") + again).alias("mask")).agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def polynomials(counts: DataFrame) -> DataFrame:
    """part and, per kind, 32 coefficients of its survivors' polynomial, by the set of filters that a monomial multiplies.

    Filter i let in with chance x_i, a document of mask m survives with chance prod (1 - x_i) over m. Multiplied out, the
    monomial over a set T has (-1)^|T| times the documents whose mask holds T; at a corner (each x_i 0 or 1) the
    polynomial counts the survivors of the filters that are in.
    """
    sign = lambda t: -1 if t.bit_count() % 2 else 1
    holds = lambda t: F.col("mask").bitwiseAND(F.lit(t)) == t
    coefficients = [F.array(*[F.coalesce(F.sum(F.when(holds(t), F.col(k))), F.lit(0)) * sign(t) for t in MASKS]).alias(k) for k in KINDS]
    return counts.groupBy("part").agg(*coefficients)


def corner(coefficients: Column, filters: Column) -> Column:
    """The polynomial where just `filters` (a mask) are in: its monomials over subsets of them."""
    inside = lambda a, t: F.when(t.bitwiseAND(filters) == t, a).otherwise(F.lit(0))
    return F.aggregate(F.transform(coefficients, inside), F.lit(0).cast("long"), lambda s, a: s + a)


def shapley(coefficients: Column, bit: int) -> Column:
    """ORDERS times the integral, over t from 0 to 1, of the removal polynomial's derivative by one filter with all filters at t.

    Of a monomial over T that holds the filter, t^(|T|-1) is left, whose integral is 1/|T|; removals are the survivors' loss.
    """
    return reduce(lambda s, t: s - F.get(coefficients, F.lit(t)) * (ORDERS // t.bit_count()), (t for t in MASKS if t & bit), F.lit(0).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per source.

    Null sources and empty ones are one part, the empty string. Repeated rows count each; where a doc_id has several
    rows of one text, none of them repeats a smaller doc_id. A null doc_id neither repeats nor is repeated. A doc_id
    with several labels has quality 1 (toxic 1) where any of them says so. Labels without a document count nowhere.
    Without documents there are no rows.
    """
    steps = [(o, k + 1, FILTERS[c], sum(FILTERS[x] for x in o[:k])) for o in map("".join, permutations(FILTERS)) for k, c in enumerate(o)]
    relation = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(before).alias("before")) for o, k, b, before in steps])
    shares = F.create_map(*[x for b in FILTERS.values() for x in (F.lit(b), shapley(F.col("n"), b))])
    per = polynomials(mask_counts(docs, labels)).withColumn("shares", shares).select("*", F.explode(relation).alias("s")).select("part", *KINDS, "shares", "s.*")
    bit, before = F.col("bit"), F.col("before")
    after = before.bitwiseOR(bit)
    lost = lambda k: corner(F.col(k), before) - corner(F.col(k), after)
    fails = corner(F.col("n"), F.lit(0)) - corner(F.col("n"), bit)
    everything = F.lit(max(MASKS))
    alone = corner(F.col("n"), everything - bit) - corner(F.col("n"), everything)
    return per.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), corner(F.col("n"), after).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("shares", bit).alias("shapley"),
    )


#: The same from documents, by masks and orders, without polynomials.
AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
    e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(e.least < d.doc_id, false)] AS f,
        coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM d JOIN e ON e.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
    g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
    c AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    o AS (SELECT a.i AS a, b.i AS b, x.i AS x, y.i AS y, z.i AS z FROM c a JOIN c b ON b.i <> a.i JOIN c x ON x.i NOT IN (a.i, b.i) JOIN c y ON y.i NOT IN (a.i, b.i, x.i) JOIN c z ON z.i NOT IN (a.i, b.i, x.i, y.i)),
    s AS (SELECT concat(chr(64 + a), chr(64 + b), chr(64 + x), chr(64 + y), chr(64 + z)) AS filter_order, k.i AS step, [a, b, x, y, z] AS own FROM o CROSS JOIN c k),
    r AS (SELECT g.part, s.filter_order, s.step, s.own[s.step] AS own, g.n, g.good, g.toxic, g.f[s.own[s.step]] AS fails, list_contains([g.f[j] FOR j IN s.own[1:s.step]], true) AS gone, list_contains([g.f[j] FOR j IN s.own[1:s.step - 1]], true) AS earlier,
        len([j FOR j IN g.f IF j]) AS failed FROM g CROSS JOIN s),
    q AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND earlier), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE fails AND failed = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT earlier), 0) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q"""
