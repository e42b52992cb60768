"""The reference concepts over the driver's tables: DataFrames, and the same derivations as DuckDB CTEs.

Documents play chunks, customers patients, lineitem claim lines, suppliers providers, nations organizations, events the
call log, orders adjudications and appeals. All derivations are pure functions of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ["public", "employee", "care_team", "member_services", "appeals"]
PLAN_CODES = ["104", "105", "106", "10P", "11P", "12P"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def line_of_business(key: Column) -> Column:
    """PSHB for one id in five by the first 32 bits of its md5, else FEHB."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 5 == 0, "PSHB").otherwise("FEHB")


def money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(table(spark, sf_dir, "documents"))


def chunk_columns(documents: DataFrame) -> DataFrame:
    n = F.substring("source", 4, 3).cast("int")
    start = F.when(F.col("doc_id") % 37 == 5, None).otherwise(F.date_add(F.lit("2021-01-01").cast("date"), (F.col("doc_id") * 13 % 2000).cast("int")))
    return documents.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("source").alias("doc_type"),
        F.concat(F.lit("doc-"), "doc_id").alias("title"),
        pick(TIERS, F.col("doc_id") % 5).alias("acl_tag"),
        (2021 + F.col("doc_id") % 6).cast("int").alias("year"),
        F.when(F.col("doc_id") % 7 == 6, None).otherwise(pick(PLAN_CODES, F.col("doc_id") % 7)).alias("plan_code"),
        (n < 4).alias("versioned"),
        n.between(4, 6).alias("event"),
        n.between(7, 9).alias("member_scoped"),
        F.when(n.between(7, 9), F.col("doc_id") % 150).alias("member_key"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CP-"), F.col("doc_id") % 40)).alias("policy_id"),
        F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("High"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("Standard"), F.lit("High"))).when(F.col("doc_id") % 4 == 3, F.array().cast("array<string>")).alias("section_options"),
        start.alias("effective_from"),
        F.when(F.col("doc_id") % 2 == 1, F.date_add(start, 400)).alias("effective_to"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text AS content, source AS doc_type, 'doc-' || doc_id AS title,
         ['public','employee','care_team','member_services','appeals'][doc_id % 5 + 1] AS acl_tag,
         (2021 + doc_id % 6)::INTEGER AS year,
         CASE WHEN doc_id % 7 < 6 THEN ['104','105','106','10P','11P','12P'][doc_id % 7 + 1] END AS plan_code,
         substr(source, 4, 3)::INTEGER < 4 AS versioned, substr(source, 4, 3)::INTEGER BETWEEN 4 AND 6 AS event,
         substr(source, 4, 3)::INTEGER BETWEEN 7 AND 9 AS member_scoped,
         CASE WHEN substr(source, 4, 3)::INTEGER BETWEEN 7 AND 9 THEN doc_id % 150 END AS member_key,
         CASE WHEN doc_id % 3 = 0 THEN 'CP-' || doc_id % 40 END AS policy_id,
         CASE doc_id % 4 WHEN 1 THEN ['High'] WHEN 2 THEN ['Standard','High'] WHEN 3 THEN []::VARCHAR[] END AS section_options,
         CASE WHEN doc_id % 37 <> 5 THEN DATE '2021-01-01' + (doc_id * 13 % 2000)::INTEGER END AS effective_from,
         CASE WHEN doc_id % 2 = 1 AND doc_id % 37 <> 5 THEN DATE '2021-01-01' + (doc_id * 13 % 2000)::INTEGER + 400 END AS effective_to
  FROM documents)"""


def appeal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, document_title, kind): every denied order cites one title; kind alternates."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("doc-"), F.col("o_orderkey") % 997).alias("document_title"), F.when(F.col("o_orderkey") % 2 == 0, "clinical_note").otherwise("call_note").alias("kind"))


EVIDENCE = """evidence AS (
  SELECT o_orderkey AS case_id, 'doc-' || o_orderkey % 997 AS document_title,
         CASE WHEN o_orderkey % 2 = 0 THEN 'clinical_note' ELSE 'call_note' END AS kind
  FROM orders WHERE o_orderstatus = 'F')"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("member_id"),
        F.concat(F.lit("First"), k % 97).alias("first_name"),
        F.concat(F.lit("Last"), k % 211).alias("last_name"),
        F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0").alias("ssn"),
        F.lpad((k * 31 % 100000).cast("string"), 5, "0").alias("zip"),
        F.concat(F.lit("City"), "c_nationkey").alias("city"),
        F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 25000).cast("int")).alias("birthdate"),
        line_of_business(k).alias("line_of_business"),
    )


LOB = "CASE WHEN ('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % 5 = 0 THEN 'PSHB' ELSE 'FEHB' END"
PATIENTS = f"""patients AS (
  SELECT c_custkey AS member_id, 'First' || c_custkey % 97 AS first_name, 'Last' || c_custkey % 211 AS last_name,
         lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS ssn, lpad((c_custkey * 31 % 100000)::VARCHAR, 5, '0') AS zip,
         'City' || c_nationkey AS city, DATE '1940-01-01' + (c_custkey * 37 % 25000)::INTEGER AS birthdate,
         {LOB.format("c_custkey")} AS line_of_business
  FROM customer)"""


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cost = money(F.col("l_extendedprice"))
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.col("l_orderkey").alias("claim_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("o_custkey").alias("member_id"),
            F.col("l_suppkey").alias("provider_id"),
            F.to_date("l_shipdate").alias("service_date"),
            F.col("p_type").alias("description"),
            cost.alias("total_claim_cost"),
            money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payer_coverage"),
            line_of_business(F.col("o_custkey")).alias("line_of_business"),
        )
    )


CLAIM_LINES = f"""claim_lines AS (
  SELECT l_orderkey AS claim_id, l_linenumber AS line_number, o_custkey AS member_id, l_suppkey AS provider_id,
         l_shipdate::DATE AS service_date, p_type AS description, l_extendedprice::DECIMAL(12,2) AS total_claim_cost,
         (l_extendedprice * (1 - l_discount))::DECIMAL(12,2) AS payer_coverage, {LOB.format("o_custkey")} AS line_of_business
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("provider_id"),
        F.lpad((1000000000 + k * 8191 % 899999999).cast("string"), 10, "0").alias("npi"),
        F.col("s_name").alias("name"),
        pick(["CARDIOLOGY", "GENERAL PRACTICE", "PHYSICAL THERAPY", "RADIOLOGY"], k % 4).alias("speciality"),
        F.lpad((k * 53 % 100000).cast("string"), 5, "0").alias("zip"),
        F.col("s_nationkey").alias("organization_id"),
    )


PROVIDERS = """providers AS (
  SELECT s_suppkey AS provider_id, lpad((1000000000 + s_suppkey * 8191 % 899999999)::VARCHAR, 10, '0') AS npi, s_name AS name,
         ['CARDIOLOGY','GENERAL PRACTICE','PHYSICAL THERAPY','RADIOLOGY'][s_suppkey % 4 + 1] AS speciality,
         lpad((s_suppkey * 53 % 100000)::VARCHAR, 5, '0') AS zip, s_nationkey AS organization_id
  FROM supplier)"""


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("organization"))


def network(spark: SparkSession, sf_dir: str, rate: int = 900) -> DataFrame:
    """Every organization under every plan code; in network where a 32-bit hash modulo 1000 is below the rate."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("organization_id").cast("string"), "plan_code")), 1, 8), 16, 10).cast("bigint")
    pairs = organizations(spark, sf_dir).withColumn("plan_code", F.explode(F.array(*[F.lit(p) for p in PLAN_CODES])))
    return pairs.select("organization_id", "plan_code", (h % 1000 < rate).alias("in_network"))


NETWORK = """network AS (
  SELECT n_nationkey AS organization_id, plan_code,
         ('0x' || substr(md5(n_nationkey || '|' || plan_code), 1, 8))::BIGINT % 1000 < 900 AS in_network
  FROM nation, (SELECT unnest(['104','105','106','10P','11P','12P']) AS plan_code))"""


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per member and order year: a weighted option that holds until a year in which the member switches."""
    years = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("year")).distinct()
    from pyspark.sql import Window

    own = Window.partitionBy("member_id").orderBy("year")
    h = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("member_id").cast("string"), F.col("year").cast("string"))), 1, 8), 16, 10).cast("bigint")
    drawn = F.when(h("option") % 100 < 45, "10").when(h("option") % 100 < 80, "11").otherwise("12")
    switch = (F.row_number().over(own) == 1) | (h("switch") % 100 < 4)
    held = years.withColumn("_o", F.when(switch, drawn)).withColumn("option_code", F.last("_o", ignorenulls=True).over(own))
    plan = F.concat("option_code", F.when(line_of_business(F.col("member_id")) == "PSHB", "P").otherwise("4"))
    return held.select("member_id", "year", "option_code", plan.alias("plan_code"))


ENROLLMENT = f"""enrolled_years AS (SELECT DISTINCT o_custkey AS member_id, year(o_orderdate) AS year FROM orders),
drawn_options AS (
  SELECT member_id, year,
         CASE WHEN row_number() OVER (PARTITION BY member_id ORDER BY year) = 1
                OR ('0x' || substr(md5('switch|' || member_id || '|' || year), 1, 8))::BIGINT % 100 < 4
              THEN CASE WHEN ('0x' || substr(md5('option|' || member_id || '|' || year), 1, 8))::BIGINT % 100 < 45 THEN '10'
                        WHEN ('0x' || substr(md5('option|' || member_id || '|' || year), 1, 8))::BIGINT % 100 < 80 THEN '11' ELSE '12' END END AS o
  FROM enrolled_years),
enrollment AS (
  SELECT member_id, year::INTEGER AS year, last_value(o IGNORE NULLS) OVER (PARTITION BY member_id ORDER BY year) AS option_code,
         last_value(o IGNORE NULLS) OVER (PARTITION BY member_id ORDER BY year) || CASE WHEN {LOB.format("member_id")} = 'PSHB' THEN 'P' ELSE '4' END AS plan_code
  FROM drawn_options)"""


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("member_id"), F.col("ts").alias("called_at"), F.col("event_type").alias("reason"), F.round("value", 4).alias("duration"), F.get_json_object("props", "$.k").cast("bigint").alias("claim_id"))


CALLS = """calls AS (
  SELECT event_id AS call_id, user_id AS member_id, ts AS called_at, event_type AS reason, round(value, 4) AS duration,
         (props::JSON->>'$.k')::BIGINT AS claim_id FROM events)"""


def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims: F denied, P pending, else paid; reason and policy by hash, decided 20 days later."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "denied").when(F.col("o_orderstatus") == "P", "pending").otherwise("paid")
    return table(spark, sf_dir, "orders").select(
        k.alias("claim_id"),
        F.col("o_custkey").alias("member_id"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 20)).alias("decided_on"),
        F.when(F.col("o_orderstatus") == "F", pick(["not medically necessary", "out of network", "no prior authorization"], k % 3)).alias("reason"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("CP-"), k % 20)).alias("policy_id"),
        F.col("o_orderpriority").alias("priority"),
        F.to_date("o_orderdate").alias("service_date"),
    )


ADJUDICATION = """adjudication AS (
  SELECT o_orderkey AS claim_id, o_custkey AS member_id,
         CASE o_orderstatus WHEN 'F' THEN 'denied' WHEN 'P' THEN 'pending' ELSE 'paid' END AS status,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + 20 END AS decided_on,
         CASE WHEN o_orderstatus = 'F' THEN ['not medically necessary','out of network','no prior authorization'][o_orderkey % 3 + 1] END AS reason,
         CASE WHEN o_orderstatus = 'F' THEN 'CP-' || o_orderkey % 20 END AS policy_id, o_orderpriority AS priority, o_orderdate::DATE AS service_date
  FROM orders)"""


def appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudication(spark, sf_dir).where("status = 'denied' AND priority = '1-URGENT'").select(F.concat(F.lit("APL-"), "claim_id").alias("case_id"), "claim_id", "member_id", F.date_add("decided_on", 15).alias("filed_on"), "reason", "policy_id")


APPEALS = ADJUDICATION + """,
appeals AS (
  SELECT 'APL-' || claim_id AS case_id, claim_id, member_id, decided_on + 15 AS filed_on, reason, policy_id
  FROM adjudication WHERE status = 'denied' AND priority = '1-URGENT')"""
