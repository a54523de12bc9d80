"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, words

#: Rates that get an adaptive upper threshold, in thousandths; mean word length, in hundredths, gets one on both sides.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate")
MEASURES = (*RATES, "word_length")
#: A sketch counts values in bins of this width, so a quantile is at most one bin off; sketches merge by adding counts.
BIN = 5
#: A threshold stands this many times the spread between median and upper (lower) quantile beyond the median, and
#: at least LEAST away from it.
FENCE, OUTER, LEAST = 4, 0.75, {"symbol_rate": 40, "dup_line_rate": 300, "repeat_rate": 300, "upper_rate": 250, "word_length": 300}
#: Sketches of groups with fewer documents are merged with their language's, then with all.
FEWEST = 100


def measures(text: Column) -> Column:
    """A struct of counts for one text: words, code points in words, symbols, lines that repeat, words in repeated 3-word windows."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")

    def repeats(w: Column, n: Column) -> Column:
        """Words that a 3-word window found twice or more covers: equal windows stand together once sorted by hash."""

        def covered(order: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(order, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(order, same), lambda x: x["i"]))
            gaps = lambda s: F.aggregate(F.transform(s, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - at, F.lit(3)))), F.lit(0), lambda a, g: a + g)
            return let(starts, gaps)

        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        found = lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))
        return F.when(n < 3, F.lit(0)).otherwise(let(windows, found))

    def count(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        sizes = lambda some: F.struct(F.size(some).alias("lines"), (F.size(some) - F.size(F.array_distinct(some))).alias("dup"))
        each = lambda n, own: F.struct(
            long(n).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
            long(own["dup"]).alias("n_dup_lines"), long(own["lines"]).alias("n_lines"), long(repeats(w, n)).alias("n_repeat_words"), long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
        )
        return let(F.size(w), lambda n: let(sizes(lines), lambda own: each(n, own)))

    return let(words(text), count)


def _rates(m: Column) -> dict[str, Column]:
    per = lambda a, b, k: F.when(m[b] > 0, F.floor(m[a] * k / m[b])).otherwise(0).cast("long")
    return {"symbol_rate": per("n_symbols", "word_chars", 1000), "dup_line_rate": per("n_dup_lines", "n_lines", 1000), "repeat_rate": per("n_repeat_words", "n_words", 1000), "upper_rate": per("n_upper", "word_chars", 1000), "word_length": per("word_chars", "n_words", 100)}


def measured(docs: DataFrame) -> DataFrame:
    """doc (the whole row), m (its counts), base_failed and one long column per rate."""
    df = docs.select(F.struct("*").alias("doc"), measures(F.col("text")).alias("m"))
    m = F.col("m")
    return df.select("doc", "m", ((m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed"), *[c.alias(k) for k, c in _rates(m).items()])


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: what a (language, source) group's documents count per bin, for those that pass the base rules."""
    bins = F.array(*[F.struct(F.lit(k).alias("measure"), F.floor(F.col(k) / BIN).cast("long").alias("bin")) for k in MEASURES])
    return rows.where(~F.col("base_failed")).select(F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), F.explode(bins).alias("b")).groupBy("lang", "source", "b.measure", "b.bin").agg(F.count("*").alias("n"))


def thresholds(found: DataFrame) -> DataFrame:
    """lang, source, measure, low, high from sketches; rows of bins, not of documents, are all that meets in a window.

    A group of fewer than FEWEST documents takes its language's merged sketch, and that of all where that is small too.
    """
    groups = found.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*[F.lit(k) for k in MEASURES])))

    def bounds(some: DataFrame, by: list[str]) -> DataFrame:
        some = some.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*by, "measure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = some.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "measure")))
        at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin") * BIN))
        return ranked.groupBy(*by, "measure").agg(F.max("all").alias("docs"), at(1 - OUTER).alias("lower"), at(0.5).alias("middle"), at(OUTER).alias("upper"))

    own = bounds(found, ["lang", "source"]).alias("o")
    tongue = bounds(found, ["lang"]).alias("t")
    every = bounds(found, []).alias("e")
    joined = groups.alias("g").join(every, F.col("g.measure") == F.col("e.measure")).join(tongue, F.col("g.lang").eqNullSafe(F.col("t.lang")) & (F.col("e.measure") == F.col("t.measure")))
    joined = joined.join(own, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")) & (F.col("e.measure") == F.col("o.measure")))
    pick = lambda c: F.when(F.col("o.docs") >= FEWEST, F.col(f"o.{c}")).when(F.col("t.docs") >= FEWEST, F.col(f"t.{c}")).otherwise(F.col(f"e.{c}"))
    least = F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])[F.col("e.measure")]
    one = joined.select("g.lang", "g.source", "e.measure", least.alias("least"), *[pick(c).alias(c) for c in ("lower", "middle", "upper")])
    high = F.col("middle") + F.greatest((F.col("upper") - F.col("middle")) * FENCE, F.col("least")) + BIN
    low = F.col("middle") - F.greatest((F.col("middle") - F.col("lower")) * FENCE, F.col("least"))
    return one.select("lang", "source", "measure", low.cast("long").alias("low"), high.cast("long").alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """doc, m, base_failed and kept for every row of docs.

    kept: the base rules hold, no rate is above its group's threshold, and the mean word length is within its group's.
    Null and empty texts fail the base rules; null languages and sources are groups like any other; repeated rows are
    judged alike; a group without a document that passes the base rules has no thresholds and keeps nothing.
    """
    return _judged(saved(measured(docs)))


def _judged(rows: DataFrame) -> DataFrame:
    """judged() of rows that are measured and written: filters would else be moved below the measures and take them twice."""
    found = saved(sketches(rows))
    flat = thresholds(found).groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col(b))).alias(f"{k}_{b}") for k in MEASURES for b in ("low", "high")])
    flat = saved(flat.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    ok = (F.col("word_length") >= F.col("word_length_low")) & (F.col("word_length") <= F.col("word_length_high"))
    for k in RATES:
        ok = ok & (F.col(k) <= F.col(f"{k}_high"))
    few = flat.count() <= 10_000  # rows of about 100 bytes
    joined = rows.join(F.broadcast(flat) if few else flat, F.col("doc.lang").eqNullSafe(F.col("_lang")) & F.col("doc.source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc", "m", "base_failed", (~F.col("base_failed") & F.coalesce(ok, F.lit(False))).alias("kept"))


def quality_table(docs: DataFrame) -> DataFrame:
    """The counts and the verdict for every row of docs."""
    rows = measured(docs.select("doc_id", "lang", "source", "text"))
    rows = saved(rows.withColumn("doc", F.struct("doc.doc_id", "doc.lang", "doc.source")))
    return _judged(rows).select("doc.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject; columns stay as they are."""
    return judged(docs).where("kept").select("doc.*")

_PER = lambda a, b, k: f"CASE WHEN {b} > 0 THEN ({a} * {k}) // {b} ELSE 0 END"
_UNPIVOT = "[" + ", ".join(f"{{'measure': '{k}', 'v': {k}, 'least': {LEAST[k]}}}" for k in MEASURES) + "]"
_PICK = lambda c: f"CASE WHEN o.docs >= {FEWEST} THEN o.{c} WHEN t.docs >= {FEWEST} THEN t.{c} ELSE e.{c} END AS {c}"
_BOUNDS = lambda by: f"""SELECT {by} measure, max(least) AS least, count(*) AS docs, quantile_disc(bin, {1 - OUTER}) * {BIN} AS lower, quantile_disc(bin, 0.5) * {BIN} AS middle, quantile_disc(bin, {OUTER}) * {BIN} AS upper FROM v GROUP BY {by} measure"""
QUALITY_SQL = rf"""
WITH a AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM a),
x AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k:k + 2]) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM x, (VALUES (0), (1), (2)) AS v(j) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_upper
  FROM a LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_PER('n_symbols', 'word_chars', 1000)} AS symbol_rate, {_PER('n_dup_lines', 'n_lines', 1000)} AS dup_line_rate,
    {_PER('n_repeat_words', 'n_words', 1000)} AS repeat_rate, {_PER('n_upper', 'word_chars', 1000)} AS upper_rate, {_PER('word_chars', 'n_words', 100)} AS word_length FROM c),
u AS (SELECT doc_id, lang, source, base_failed, unnest({_UNPIVOT}, recursive := true) FROM m),
v AS (SELECT *, v // {BIN} AS bin FROM u WHERE NOT base_failed),
o AS ({_BOUNDS('lang, source,')}), t AS ({_BOUNDS('lang,')}), e AS ({_BOUNDS('')}),
g AS (SELECT o.lang, o.source, e.measure, e.least, {_PICK('lower')}, {_PICK('middle')}, {_PICK('upper')}
  FROM o JOIN t ON o.lang IS NOT DISTINCT FROM t.lang AND o.measure = t.measure JOIN e ON e.measure = o.measure),
h AS (SELECT lang, source, measure, middle - greatest((middle - lower) * {FENCE}, least) AS low, middle + greatest((upper - middle) * {FENCE}, least) + {BIN} AS high FROM g),
b AS (SELECT u.doc_id, bool_and(u.v <= h.high AND (u.measure <> 'word_length' OR u.v >= h.low)) AS ok
  FROM u JOIN h ON u.lang IS NOT DISTINCT FROM h.lang AND u.source IS NOT DISTINCT FROM h.source AND u.measure = h.measure GROUP BY u.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept FROM m LEFT JOIN b USING (doc_id)
"""
