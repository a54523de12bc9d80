"""Exchange entities derived from the input tables by arithmetic on keys, as SQL that Spark and DuckDB both run.

Times hang on AS_OF, never on a clock. Money is in whole micro-USD. TS(x) makes a timestamp of epoch seconds, EPOCH(x)
the reverse; each engine has its own spelling for the two.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00:00 UTC, in epoch seconds: the moment at which every query is asked.
AS_OF = 1_706_659_200

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ENTITIES = {
    "suppliers": """SELECT s_suppkey AS id, s_nationkey AS nation, CAST(((s_suppkey * 7919) % 1000) / 1000.0 AS DOUBLE) AS reputation, (s_suppkey * 131) % 6000 AS completed_tasks,
        CASE WHEN s_suppkey % 10 = 0 THEN 'suspended' WHEN s_suppkey % 17 = 3 THEN 'banned' ELSE 'active' END AS status, s_suppkey % 3 <> 0 AS payouts_enabled, s_suppkey * 13 % 1500 AS buyer_id FROM supplier""",
    "workers": f"""SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS supplier_id, CASE p_size % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'base' WHEN 2 THEN 'pro' ELSE 'max' END AS hw_class,
        CASE WHEN p_partkey % 3 = 0 THEN 'metal' ELSE 'cuda' END AS engine, concat('b', CAST(p_partkey % 5 AS STRING)) AS build_hash, CAST(p_size AS DOUBLE) AS memory_gb, CAST(p_size * 0.75 AS DOUBLE) AS effective_gb,
        p_retailprice / 10 AS tps, p_partkey % 17 = 0 AS throttled, p_partkey % 19 = 0 AS thermal_degraded, TS({AS_OF} - p_partkey % 120) AS last_seen_at FROM part""",
    "buyers": "SELECT c_custkey AS id, CAST(floor(greatest(c_acctbal, 0) * 1000) AS BIGINT) AS free_credit_micros, c_custkey % 4 <> 0 AS has_payment_method FROM customer",
    "models": """SELECT * FROM (VALUES ('all-minilm-l6-v2', 'embed', CAST(0.02 AS DOUBLE), CAST(2 AS DOUBLE)), ('llama-3.2-1b-instruct-q4', 'batch_infer', CAST(0.2 AS DOUBLE), CAST(4 AS DOUBLE))) AS m(id, job_type, price_per_1k, min_memory_gb)""",
    "jobs": f"""SELECT o_orderkey AS id, o_custkey AS buyer_id, CASE WHEN o_orderkey % 2 = 0 THEN 'embed' ELSE 'batch_infer' END AS job_type,
        CASE WHEN o_orderkey % 2 = 0 THEN 'all-minilm-l6-v2' ELSE 'llama-3.2-1b-instruct-q4' END AS model_ref,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'priority' WHEN o_orderpriority LIKE '2%' THEN 'express' ELSE 'batch' END AS tier,
        CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 31 = 0 THEN 'cancelled' ELSE 'complete' END WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'verifying' ELSE 'running' END ELSE 'queued' END AS status,
        TS({AS_OF} - (o_orderkey * 7919) % 2592000) AS created_at, CASE WHEN o_orderstatus = 'F' THEN TS({AS_OF} - (o_orderkey * 7919) % 2592000 + 600 + o_orderkey % 5000) END AS merged_at,
        CAST(floor(o_totalprice) AS BIGINT) AS estimated_micros, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice * 0.9) AS BIGINT) END AS actual_micros,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice * 0.8) AS BIGINT) END AS firm_max_micros, CASE WHEN o_orderkey % 4 = 1 THEN CAST(floor(o_totalprice * 0.5) AS BIGINT) END AS budget_micros,
        CASE WHEN o_orderkey % 6 = 0 THEN CAST(floor(o_totalprice * 0.15) AS BIGINT) ELSE 0 END AS sla_premium_micros, CASE WHEN o_orderkey % 6 = 0 THEN 300 + o_orderkey % 3000 END AS sla_secs,
        CASE o_orderkey % 9 WHEN 0 THEN 'not_attempted' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_payment_method' WHEN 3 THEN 'charged' ELSE 'deferred' END AS charge_status, o_orderkey % 6 AS charge_attempts,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 30 + o_orderkey % 900 END AS eta_secs, o_orderkey % 8 + 1 AS min_memory_gb, o_orderkey % 512 AS max_tokens FROM orders""",
    "tasks": f"""SELECT k.l_orderkey * 10 + k.l_linenumber AS id, k.l_orderkey AS job_id, CASE WHEN k.l_linenumber = 1 THEN NULL ELSE k.l_linenumber - 1 END AS chunk_index, k.part AS worker_id, k.supp AS supplier_id,
        CASE WHEN k.line = 'F' THEN CASE WHEN k.part % 23 = 0 THEN 'failed' ELSE 'complete' END WHEN k.part % 29 = 0 THEN 'verifying' WHEN k.flag = 'N' THEN 'queued' WHEN k.flag = 'A' THEN 'running' ELSE 'retrying' END AS status,
        k.part % 50 = 7 AS is_honeypot, k.part % 10 = 0 AS is_redundancy, CASE WHEN k.part % 37 = 0 AND k.l_linenumber > 1 THEN k.l_orderkey * 10 + 1 END AS hedged_from, k.part % 5 AS retry_count,
        concat('jobs/', CAST(k.l_orderkey AS STRING), '/', CAST(CAST(floor(k.l_linenumber / 2) AS BIGINT) AS STRING)) AS input_ref,
        TS({AS_OF} - (k.l_orderkey * 7919) % 2592000 + k.l_linenumber) AS created_at, CASE WHEN k.part % 3 = 0 THEN TS({AS_OF} - 300 + k.supp % 600) END AS visible_at,
        CASE WHEN k.line = 'F' OR k.flag = 'A' THEN TS({AS_OF} - (k.l_orderkey * 7919) % 2592000 + k.l_linenumber + k.part % 600) END AS claimed_at,
        CASE WHEN k.line = 'F' OR k.flag = 'A' THEN TS({AS_OF} - (k.l_orderkey * 7919) % 2592000 + k.l_linenumber + k.part % 600 + k.supp % 60 + 1) END AS started_at,
        CASE WHEN k.line = 'F' THEN TS({AS_OF} - (k.l_orderkey * 7919) % 2592000 + k.l_linenumber + k.part % 600 + k.supp % 60 + 1 + k.quantity * 7) END AS completed_at,
        k.price AS charge_micros, CAST(floor(k.price * 0.97) AS BIGINT) AS payout_micros
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(l_linestatus) AS line, CAST(min(l_quantity) AS BIGINT) AS quantity, CAST(floor(min(l_extendedprice)) AS BIGINT) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber) k""",
    "ledger": f"""SELECT t.id * 10 + v.n AS id, t.id AS task_id, t.job_id, CASE WHEN v.n = 1 THEN t.supplier_id END AS supplier_id, j.buyer_id,
        CASE v.n WHEN 0 THEN 'buyer_charge' WHEN 1 THEN 'supplier_credit' WHEN 2 THEN 'platform_take' ELSE 'clawback' END AS kind,
        CASE v.n WHEN 0 THEN -t.charge_micros WHEN 1 THEN t.payout_micros WHEN 2 THEN t.charge_micros - t.payout_micros ELSE -t.payout_micros END AS amount_micros, t.completed_at AS created_at,
        CASE WHEN v.n = 1 THEN CASE t.id % 7 WHEN 0 THEN 'released' WHEN 1 THEN 'ready' WHEN 2 THEN 'carried' WHEN 3 THEN 'sending' ELSE 'held' END END AS payout_status
        FROM tasks t JOIN jobs j ON t.job_id = j.id CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(n) WHERE t.status = 'complete' AND (v.n < 3 OR t.worker_id % 40 = 3)""",
    "durations": "SELECT event_id AS id, user_id AS worker_id, CASE WHEN event_id % 2 = 0 THEN 'embed' ELSE 'batch_infer' END AS job_type, CASE WHEN event_id % 2 = 0 THEN 'all-minilm-l6-v2' ELSE 'llama-3.2-1b-instruct-q4' END AS model_ref, CAST(round(value * 1000) AS BIGINT) AS duration_ms, ts AS created_at, event_id % 1500 AS job_id FROM events",
    "samples": "SELECT event_id AS id, user_id AS worker_id, value / 10 AS effective_gb, ts AS created_at FROM events WHERE event_type <> 'error'",
    "verifications": """SELECT e.event_id AS id, t.id AS task_id, t.job_id, t.supplier_id, coalesce(t.chunk_index, 0) AS chunk_index, e.ts AS created_at,
        CASE e.event_type WHEN 'view' THEN 'redundancy_match' WHEN 'signup' THEN 'honeypot_pass' WHEN 'purchase' THEN 'tiebreak_win' WHEN 'error' THEN 'redundancy_mismatch' ELSE 'honeypot_fail' END AS kind
        FROM events e JOIN tasks t ON t.job_id = e.event_id % 1500 AND coalesce(t.chunk_index, 0) = e.user_id % 7""",
    "benchmarks": f"""SELECT p_partkey * 2 + v.n AS id, p_partkey AS worker_id, CASE v.n WHEN 0 THEN 'embed' ELSE 'batch_infer' END AS job_type, CASE v.n WHEN 0 THEN 'all-minilm-l6-v2' ELSE 'llama-3.2-1b-instruct-q4' END AS model_ref,
        CASE v.n WHEN 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice / 20 END AS tps, CASE v.n WHEN 0 THEN CAST(p_retailprice AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS eps, p_size * 10 AS p99_ms, p_size % 5 * 1000 AS load_ms, TS({AS_OF} - p_partkey % 86400) AS created_at
        FROM part CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE (p_partkey + v.n) % 3 <> 0""",
    "model_state": f"SELECT p_partkey AS worker_id, CASE WHEN p_partkey % 2 = 0 THEN 'all-minilm-l6-v2' ELSE 'llama-3.2-1b-instruct-q4' END AS model_ref, TS({AS_OF} - (p_partkey * 7) % 180) AS last_warm_at FROM part WHERE p_partkey % 4 <> 1",
    "quotes": "SELECT o_orderkey * 3 AS id, o_orderkey AS job_id, CAST(floor(o_totalprice * 1.05) AS BIGINT) AS quoted_micros FROM orders WHERE o_orderkey % 5 <> 0",
    "refunds": f"SELECT o_orderkey AS job_id, CAST(floor(o_totalprice * 0.1) AS BIGINT) AS refund_micros, TS({AS_OF} - o_orderkey % 100000) AS created_at FROM orders WHERE o_orderkey % 12 = 0",
    "batches": f"SELECT c_custkey AS id, c_custkey AS buyer_id, c_custkey * 31 % 9000 + 101 AS fee_micros, CASE c_custkey % 3 WHEN 0 THEN 'charged' WHEN 1 THEN 'attempting' ELSE 'failed' END AS status, TS({AS_OF} - c_custkey * 61 % 400000) AS created_at, c_custkey % 7 AS attempts FROM customer",
    "webhooks": f"""SELECT o_orderkey * 2 + v.n AS id, o_orderkey AS job_id, o_custkey AS buyer_id, concat('https://hook.example/', CAST(o_custkey % 50 AS STRING)) AS url,
        CASE (o_orderkey + v.n) % 5 WHEN 0 THEN 'delivered' WHEN 1 THEN 'dead' ELSE 'pending' END AS state, (o_orderkey + v.n) % 9 AS attempts, TS({AS_OF} - (o_orderkey * 31 + v.n * 7) % 7200 + 1800) AS next_at FROM orders CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE o_orderkey % 3 = 0""",
    "job_events": "SELECT event_id AS id, event_id % 1500 AS job_id, event_type AS kind, ts AS created_at, props AS detail FROM events",
    "failures": "SELECT event_id AS id, (event_id % 1500) * 10 + 1 AS task_id, event_id % 1500 AS job_id, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'oom' WHEN 1 THEN 'timeout' WHEN 2 THEN 'bad_input' WHEN 3 THEN 'model_load' ELSE 'mystery' END AS class, user_id % 5 AS retries, ts AS created_at FROM events WHERE event_type = 'error'",
    "credentials": f"SELECT s_suppkey AS id, s_suppkey AS supplier_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey - 1 END AS rotated_from, s_suppkey % 6 = 0 AS revoked, TS({AS_OF} - s_suppkey * 977) AS created_at FROM supplier",
    "collections": "SELECT c_custkey AS id, concat('pi_', CAST(c_custkey AS STRING)) AS payment_intent, CAST(floor(greatest(c_acctbal, 0) * 100) AS BIGINT) AS received_cents, CAST(floor(greatest(c_acctbal, 0) * 100) AS BIGINT) * (c_custkey % 3) AS refunded_cents FROM customer",
    "disputes": "SELECT c_custkey * 2 + v.n AS id, concat('pi_', CAST(c_custkey AS STRING)) AS payment_intent, c_custkey % 900 + 50 AS amount_cents, CASE (c_custkey + v.n) % 4 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' ELSE 'needs_response' END AS status, 1000 + (c_custkey * 17 + v.n * 5) % 777 AS event_created FROM customer CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE c_custkey % 2 = 0",
    "fundings": "SELECT o_orderkey AS id, concat('pi_', CAST(o_custkey AS STRING)) AS payment_intent, CAST(floor(o_totalprice / 100) AS BIGINT) AS amount_cents, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'",
    "transitions": """SELECT * FROM (VALUES ('job', 'queued', 'running'), ('job', 'running', 'verifying'), ('job', 'verifying', 'complete'), ('job', 'verifying', 'running'), ('job', 'queued', 'cancelled'), ('job', 'running', 'failed'),
        ('task', 'queued', 'running'), ('task', 'running', 'verifying'), ('task', 'verifying', 'complete'), ('task', 'running', 'retrying'), ('task', 'retrying', 'running'), ('task', 'verifying', 'retrying'), ('task', 'running', 'failed')) AS t(entity, was, becomes)""",
}

def _closing(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    raise ValueError("no closing parenthesis")


def spelled(sql: str, engine: str) -> str:
    """sql with TS(x) and EPOCH(x) in the engine's own words."""
    forms = {"spark": {"TS": "CAST(timestamp_seconds({}) AS TIMESTAMP_NTZ)", "EPOCH": "(unix_micros(CAST({} AS TIMESTAMP)) / 1000000D)"}, "duckdb": {"TS": "make_timestamp(CAST(({}) AS BIGINT) * 1000000)", "EPOCH": "epoch({})"}}[engine]
    while m := re.search(r"\b(TS|EPOCH)\(", sql):
        end = _closing(sql, m.end() - 1)
        sql = sql[: m.start()] + forms[m[1]].format(sql[m.end() : end]) + sql[end + 1 :]
    return sql


def needed(sql: str) -> list[str]:
    """The entities that sql names, each after those it is made from."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in ENTITIES:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(ENTITIES[name])
                found.append(name)

    add(sql)
    return found


def oracle(sql: str) -> str:
    """sql for DuckDB, with the entities it needs in front."""
    head = ", ".join(f"{name} AS ({ENTITIES[name]})" for name in needed(sql))
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = (", " if head else "") + body[len("WITH RECURSIVE" if recursive else "WITH") :].lstrip()
        return spelled(f"WITH {'RECURSIVE ' if recursive else ''}{head}{body}", "duckdb")
    return spelled(f"WITH {head} {body}" if head else body, "duckdb")


class Exchange:
    """Lazy DataFrames of the entities over one folder of input tables: exchange.tasks, exchange.jobs, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in ENTITIES and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = ENTITIES[name]
                uses = [n for n in (*TABLES, *ENTITIES) if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]
                text = spelled(sql, "spark")
                for n in uses:
                    text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in uses})
        return self._made[name]

    @cached_property
    def as_of(self):
        """AS_OF as a timestamp without zone."""
        return F.timestamp_seconds(F.lit(AS_OF)).cast("timestamp_ntz")

    def ago(self, seconds: float):
        return F.timestamp_seconds(F.lit(AS_OF - seconds)).cast("timestamp_ntz")
