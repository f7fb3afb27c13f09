"""Clauses that limit masses and name container types, against plans made of the cargo; evidence in conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clauses, retrieval
from . import clause_sql
from .tables import SQL_CARGO, cargo, table

#: Sentences with a figure each (a customer's number), and what stands after them. Every order gets one of each.
_SENTENCES = (
    "The gross mass of each loaded container shall not exceed {n} kg.", "Max. load per container {n} kg excluding tare.", "Crates sent in containers shall weigh no more than {n} kg each.", "Loaded containers heavier than {n} kg will not be accepted.",
    "Each container shall be set down by a crane rated {n} kg.", "No single lift, including slings and hooks, shall exceed {n} kg.", "The total mass of panels in every container is limited to {n} kg.", "Containers shall weigh at least {n} kg.",
    "Each delivery lorry shall not carry more than {n} kg gross and each A-frame shall not exceed 2 t.", "Any one crate, stillage or container shall not exceed {n} kg.", "Total cargo weight per 40 ft HQ not to exceed {n} lbs.", "每个集装箱毛重（含皮重）不应超过{n}公斤。",
    "The dead load of each panel shall not exceed {n} kg.", "Pay up to {n} pounds per container per day.", "Every 20GP shall not exceed {n} kg (MGW).", "The container weight shall exceed {n} kg; per crate: 2 t.", "每个托盘重量不超过{n}公斤，以便起重。",
)
_ENDS = ("", " Ship in 40HQ.", " 20GP containers are not accepted.", " Maximum weight per container: 26 t; per crate: 2 t.", " Containers: 40HQ only; the terminal accepts up to 32 t.", " Use 20GP or 40 ft high cube.", " Deliveries by truck (GVW 32 t max.) only.")


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """(clause_id, tender, clause): a clause for each order, a tender for each customer."""
    k = F.col("o_orderkey")
    pick = lambda xs, at: F.element_at(F.array(*(F.lit(x) for x in xs)), (at % len(xs) + 1).cast("int"))
    clause = F.concat(F.replace(pick(_SENTENCES, k), F.lit("{n}"), (1500 + F.col("o_custkey") * 977 % 30000).cast("string")), pick(_ENDS, F.floor(k / len(_SENTENCES))))
    return table(spark, d, "orders").select(k.alias("clause_id"), F.col("o_custkey").alias("tender"), clause.alias("clause"))


def _tenths(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.round(x * 10).cast("bigint").cast("string")), ",").alias(c)


def clause_mass_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whose limit each figure is, in tenths of a kg; what a person must read."""
    found = clauses.mass_limits(_clauses(spark, d))
    return found.select("clause_id", _tenths("container_kg"), "basis", _tenths("package_kg"), _tenths("vehicle_kg"), "unplaced")


def clause_container_decision(spark: SparkSession, d: str) -> DataFrame:
    """The container type of each customer's plan; every eleventh one requests one."""
    rows = _clauses(spark, d)
    types = clauses.named_types(rows).join(rows.select("clause_id", "tender"), "clause_id")
    k = F.col("c_custkey")
    tenders = table(spark, d, "customer").select(k.alias("tender"), F.when(k % 22 == 0, " 20gp").when(k % 11 == 0, "OT").alias("requested"))
    return clauses.container_decision(types, tenders, "tender")


def clause_mass_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each clause that limits containers against the heaviest shipment of its customer; every seventh plan doesn't fit."""
    rows = _clauses(spark, d)
    limits = clauses.mass_limits(rows).join(rows.select("clause_id", "tender"), "clause_id").withColumn("soft", F.col("tender") % 3 == 0)
    shipped = cargo(spark, d).groupBy("shipment_id").agg(F.sum("weight_kg").alias("kg")).join(rows, F.col("shipment_id") == F.col("clause_id"))
    plans = shipped.groupBy("tender").agg(F.max("kg").cast("double").alias("cargo_kg")).withColumn("fits", F.col("tender") % 7 != 0).withColumn("tare_kg", F.lit(3900.0))
    return clauses.mass_checks(limits, plans, "tender", unmodelled="soft")


def kb_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """The six best turns of all conversations for each benchmark text; a user's turn that repeats it comes last."""
    turns = table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk"), (F.col("role") == "user").alias("question"), "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.chunk_search(turns, queries, 6, "chunk").select("query", "chunk", "score", "rank")


_SQL = f"""WITH c AS (SELECT o_orderkey AS clause_id, o_custkey AS tender, replace([{clause_sql.listed(_SENTENCES)}][o_orderkey % {len(_SENTENCES)} + 1], '{{n}}', CAST(1500 + o_custkey * 977 % 30000 AS VARCHAR))
  || [{clause_sql.listed(_ENDS)}][o_orderkey // {len(_SENTENCES)} % {len(_ENDS)} + 1] AS clause FROM orders)"""
_TENTHS = ", ".join(f"array_to_string(list_transform({c}, lambda x: CAST(round(x * 10) AS BIGINT)), ',') AS {c}" for c in ("container_kg", "package_kg", "vehicle_kg"))

QUERIES = {f.__name__: f for f in (clause_mass_limits, clause_container_decision, clause_mass_checks, kb_chunk_search)}
SQL = {
    "kb_chunk_search": """WITH x AS (SELECT conv_id || '/' || turn AS chunk, role = 'user' AS question, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM conversations), t AS (SELECT chunk, len(ts) AS l, unnest(ts) AS term FROM x),
      i AS (SELECT term, chunk, count(*) AS tf, any_value(l) AS l FROM t GROUP BY 1, 2), m AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM x WHERE len(ts) > 0), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
      b AS (SELECT item_id AS query, lower(trim(text)) AS phrase, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]+'), 1) AS place FROM benchmark),
      q AS (SELECT query, phrase, term FROM (SELECT query, phrase, term, min(place) AS place FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY place) <= 160),
      s AS (SELECT query, phrase, chunk, count(*) AS n, round(sum(greatest(ln((m.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m.a))), 6) AS bm FROM q JOIN f USING (term) JOIN i USING (term), m GROUP BY ALL),
      c AS (SELECT s.*, question AND lower(trim(text)) = phrase AS repeated, contains(lower(text), phrase) AS whole FROM s JOIN x USING (chunk) QUALIFY row_number() OVER (PARTITION BY query ORDER BY question AND lower(trim(text)) = phrase, bm DESC, chunk) <= 240),
      r AS (SELECT query, chunk, round(n + CASE WHEN whole THEN 4 ELSE 0 END + least(bm, 5::DOUBLE) - CASE WHEN repeated THEN 1000 ELSE 0 END, 6) AS score FROM c)
      SELECT query, chunk, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) <= 6""",
    "clause_mass_limits": f"{_SQL} SELECT clause_id, {_TENTHS}, basis, unplaced FROM {clause_sql.mass_limits('c', 'clause_id', 'clause')}",
    "clause_container_decision": f"""{_SQL}, s AS (SELECT *, clause_id * 100000 + sentence_no AS sid, tender FROM ({clause_sql.sentences("c", "clause_id, tender", "clause")})), k AS ({clause_sql.container_codes("s", "sid", "sentence")}),
      m AS (SELECT clause_id, tender, code, max(sentence LIKE '%not accepted%') AS refused FROM s JOIN k USING (sid) WHERE code IS NOT NULL GROUP BY ALL),
      a AS (SELECT tender, count(DISTINCT code) FILTER (NOT refused) AS n, min(code) FILTER (NOT refused) AS code FROM m GROUP BY 1)
      SELECT c_custkey AS tender, CASE WHEN c_custkey % 22 = 0 THEN '20GP' WHEN c_custkey % 11 = 0 THEN NULL WHEN n IS NULL THEN '40HQ' WHEN n = 1 THEN code END AS type, CASE WHEN c_custkey % 11 = 0 THEN 'request' WHEN n IS NULL THEN 'default' ELSE 'tender_clause' END AS source
      FROM customer LEFT JOIN a ON tender = c_custkey""",
    "clause_mass_checks": f"""{_SQL}, {SQL_CARGO}, w AS (SELECT shipment_id, sum(weight_kg) AS kg FROM cargo GROUP BY 1), h AS (SELECT tender, max(kg)::DOUBLE AS kg FROM w JOIN c ON clause_id = shipment_id GROUP BY 1),
      x AS (SELECT clause_id, tender, kg, basis, container_kg[1] AS top, tender % 7 <> 0 AND kg IS NOT NULL AND len(container_kg) = 1 AS readable, CASE WHEN basis = 'cargo' THEN kg ELSE kg + 3900 END AS held FROM {clause_sql.mass_limits("c", "clause_id", "clause")} JOIN c USING (clause_id) LEFT JOIN h USING (tender) WHERE len(container_kg) > 0)
      SELECT clause_id, tender, CASE WHEN NOT readable THEN 'human_required' WHEN held > top THEN CASE WHEN basis = 'unstated' AND kg <= top THEN 'human_required' ELSE 'gap' END WHEN tender % 3 = 0 THEN 'partial' ELSE 'covered' END AS status, CASE WHEN readable THEN round(top - held, 1) END AS margin_kg FROM x""",
}
