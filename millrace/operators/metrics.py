"""Metrics as text: counters, gauges and cumulative histograms with labels, from one pass over the rows they count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query


@dataclass(frozen=True)
class Family:
    """A metric: its kind, its labels (columns), and the column that is summed (None: rows are counted). A histogram has whole upper bounds besides."""

    name: str
    kind: str
    help: str
    labels: tuple[str, ...]
    value: str | None = None
    bounds: tuple[int, ...] = ()


def escaped(v: Column) -> Column:
    """A label's value: backslash, quote and line feed are escaped; a null is empty."""
    text = F.coalesce(v.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _with_labels(name: Column, pairs: list[Column]) -> Column:
    return F.concat(name, F.lit("{"), F.array_join(F.array(*pairs), ","), F.lit("}")) if pairs else name


def _pair(label: str, v: Column) -> Column:
    return F.concat(F.lit(f'{label}="'), v, F.lit('"'))


def samples(rows: DataFrame, families: list[Family]) -> DataFrame:
    """family, labels..., bound, n, total: what each family counts, by one aggregation over grouping sets.

    Every row goes once into each family's set (map-side, so what is shuffled is groups). bound is the number of the first
    bound of a histogram that the value is within, the number of bounds where it is beyond all.
    """
    labels = list(dict.fromkeys(x for f in families for x in f.labels))
    place = lambda f: F.lit(len(f.bounds)) if not f.bounds else F.coalesce(*[F.when(F.col(f.value) <= b, F.lit(i)) for i, b in enumerate(f.bounds)], F.lit(len(f.bounds)))
    each = [
        F.struct(F.lit(f.name).alias("family"), *[(F.col(x).cast("string") if x in f.labels else F.lit(None).cast("string")).alias(x) for x in labels], (place(f) if f.kind == "histogram" else F.lit(0)).alias("bound"), (F.col(f.value).cast("long") if f.value else F.lit(1).cast("long")).alias("value"))
        for f in families
    ]
    long = rows.select(F.explode(F.array(*each)).alias("s")).select("s.*").where("value IS NOT NULL")
    return long.groupBy("family", *labels, "bound").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rendered(rows: DataFrame, families: list[Family]) -> DataFrame:
    """family, place, line: the text form, in order of family and place; two lines of head per family, though nothing was counted.

    A counter or gauge has a line per group of labels. A histogram has, per group, a line per bound with what is at or
    below it, one for all, the sum and the count; bounds that met nothing are there as well.
    """
    order = {f.name: i for i, f in enumerate(families)}
    spark = rows.sparkSession
    heads = spark.createDataFrame([(f.name, i, f"# {what} {f.name} {said}") for f in families for i, (what, said) in enumerate((("HELP", f.help.replace("\\", "\\\\").replace("\n", "\\n")), ("TYPE", f.kind)))], "family string, place string, line string")
    counted = samples(rows, families)
    out = heads.withColumn("place", F.concat(F.lit("0/"), "place"))
    for f in families:
        own = counted.where(F.col("family") == f.name)
        pairs = [_pair(x, escaped(F.col(x))) for x in f.labels]
        if f.kind != "histogram":
            value = F.col("total") if f.value else F.col("n")
            line = F.concat(_with_labels(F.lit(f.name), pairs), F.lit(" "), value.cast("string"))
            part = own.select("family", line.alias("line"))
        else:
            counts = [F.coalesce(F.sum(F.when(F.col("bound") <= i, F.col("n"))), F.lit(0)) for i in range(len(f.bounds) + 1)]
            per = own.groupBy("family", *f.labels).agg(F.array(*counts).alias("upto"), F.sum("total").alias("total"))
            bounds = [*map(str, f.bounds), "+Inf"]
            lines = [F.concat(_with_labels(F.lit(f"{f.name}_bucket"), [*pairs, _pair("le", F.lit(b))]), F.lit(" "), F.get("upto", F.lit(i)).cast("string")) for i, b in enumerate(bounds)]
            lines += [F.concat(_with_labels(F.lit(f"{f.name}_sum"), pairs), F.lit(" "), F.col("total").cast("string")), F.concat(_with_labels(F.lit(f"{f.name}_count"), pairs), F.lit(" "), F.get("upto", F.lit(len(f.bounds))).cast("string"))]
            part = per.select("family", F.explode(F.array(*lines)).alias("line"))
        out = out.unionByName(part.select("family", F.lit("1").alias("place"), "line"))
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return out.select("family", F.concat(rank[F.col("family")].cast("string"), F.lit("/"), "place").alias("place"), "line")


#: What the exchange shows of its slices.
FAMILIES = [
    Family("slices_total", "counter", "Slices done, by workload and model.", ("job_type", "model")),
    Family("worker_busy_ms", "gauge", "Milliseconds that each worker was busy.", ("worker",), "duration_ms"),
    Family("slice_ms", "histogram", "Milliseconds of a slice.", ("job_type",), "duration_ms", (100, 10_000, 50_000, 100_000, 250_000)),
]


@query("""WITH d AS (SELECT job_type, concat('m\\', model_ref) AS model, concat('w"', worker_id, '"') AS worker, duration_ms FROM durations), b AS (SELECT unnest([100, 10000, 50000, 100000, 250000]) AS le),
    h AS (SELECT job_type, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total FROM d GROUP BY job_type)
    SELECT 'slices_total' AS family, '0/0/0' AS place, '# HELP slices_total Slices done, by workload and model.' AS line UNION ALL SELECT 'slices_total', '0/0/1', '# TYPE slices_total counter' UNION ALL SELECT 'worker_busy_ms', '1/0/0', '# HELP worker_busy_ms Milliseconds that each worker was busy.' UNION ALL SELECT 'worker_busy_ms', '1/0/1', '# TYPE worker_busy_ms gauge'
    UNION ALL SELECT 'slice_ms', '2/0/0', '# HELP slice_ms Milliseconds of a slice.' UNION ALL SELECT 'slice_ms', '2/0/1', '# TYPE slice_ms histogram'
    UNION ALL SELECT 'slices_total', '0/1', concat('slices_total{job_type="', job_type, '",model="', replace(model, '\\', '\\\\'), '"} ', count(*)) FROM d GROUP BY job_type, model
    UNION ALL SELECT 'worker_busy_ms', '1/1', concat('worker_busy_ms{worker="', replace(worker, '"', '\\"'), '"} ', CAST(sum(duration_ms) AS BIGINT)) FROM d GROUP BY worker
    UNION ALL SELECT 'slice_ms', '2/1', concat('slice_ms_bucket{job_type="', h.job_type, '",le="', b.le, '"} ', (SELECT count(*) FROM d WHERE d.job_type = h.job_type AND d.duration_ms <= b.le)) FROM h CROSS JOIN b
    UNION ALL SELECT 'slice_ms', '2/1', concat('slice_ms_bucket{job_type="', job_type, '",le="+Inf"} ', n) FROM h UNION ALL SELECT 'slice_ms', '2/1', concat('slice_ms_sum{job_type="', job_type, '"} ', total) FROM h UNION ALL SELECT 'slice_ms', '2/1', concat('slice_ms_count{job_type="', job_type, '"} ', n) FROM h""")
def snk_metrics_text(e: Exchange) -> DataFrame:
    """Slices as a counter, busy time as a gauge and durations as a histogram, in text form."""
    rows = e.durations.select("job_type", F.concat(F.lit("m\\"), "model_ref").alias("model"), F.concat(F.lit('w"'), F.col("worker_id").cast("string"), F.lit('"')).alias("worker"), "duration_ms")
    return rendered(rows, FAMILIES)
