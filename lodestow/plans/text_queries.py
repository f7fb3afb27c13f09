"""Sections, snippets, figures and tallies over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import passages
from . import clause_sql
from .tables import table


def kb_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: every fifth line is a heading."""
    line = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    found = passages.sections(docs, "doc_id", "text")
    return found.select("doc_id", F.col("section").cast("bigint").alias("section"), F.coalesce("heading", F.lit("-")).alias("heading"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


def kb_snippets(spark: SparkSession, d: str) -> DataFrame:
    """For each document the line that holds a word of its language's name or source."""
    words = F.array(F.lower("lang"), F.lower(F.substring("source", 1, 3)), F.lit("and the"))
    return table(spark, d, "documents").select("doc_id", passages.snippet(F.col("text"), words).alias("snippet"))


def kb_match_strings(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), "[ \\n]+").alias("words"))
    return items.select("item_id", passages.match_string(F.filter("words", lambda w: w.rlike("^[a-z0-9_]+$"))).alias("match"))


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """A clause for each order, with containers and masses as people write them."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 900 + 100).cast("string")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    clause = F.concat(F.lit("Ship in "), pick(*_BOXES), F.lit(", at most "), n, F.lit(" "), pick(*_UNITS), F.lit(" each or "), pick(*_MORE))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", clause.alias("clause"))


_BOXES = ("40HQ", "20 ft GP", "40' high cube", "45HC and 40-HQ", "20ft open top", "crates", "40 flat-rack", "a40HQ", "40HQs", "High-cube 40'", "OT or ot", "40’HQ", "开顶柜", "flat rack")
_UNITS = ("kg", "tonnes", "lbs", "short tons", "t", "long ton", "kN", "metric tons", "mt", "MT")
_MORE = (
    "1,250.5 kgs", "none", "20 MT", "3 pounds", "2 us tons", "20 t (44,092 lbs)", "a gross mass of 1 250 kg", "12 mt long panels", "pay 5,000 pounds per container per day", "a weight of 700 pounds",
    "26,000 kg / approx 57,320 lbs",
)
_PICK = lambda xs: f"[{clause_sql.listed(xs)}][o_orderkey % {len(xs)} + 1]"
_SQL_CLAUSES = f"""WITH c AS (SELECT *, 'Ship in ' || {_PICK(_BOXES)} || ', at most ' || (o_custkey % 900 + 100) || ' ' || {_PICK(_UNITS)} || ' each or ' || {_PICK(_MORE)} AS clause FROM orders)"""


def clause_containers(spark: SparkSession, d: str) -> DataFrame:
    found = _clauses(spark, d).select("o_orderkey", F.explode(passages.container_codes(F.col("clause"))).alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("orders"))


def clause_masses(spark: SparkSession, d: str) -> DataFrame:
    # Few bytes are much work here: they are dealt over all tasks. The words are a column of their own: each figure looks around in them, and would cut the sentence anew otherwise.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    worded = _clauses(spark, d).repartition(n, "o_orderkey").select("o_orderkey", "clause", passages.figure_words(F.col("clause")).alias("words"))
    masses = worded.select("o_orderkey", passages.masses_kg(F.col("clause"), F.col("words")).alias("kg"))
    return masses.select("o_orderkey", F.size("kg").cast("bigint").alias("n"), F.round(F.aggregate("kg", F.lit(0.0), lambda a, x: a + x), 3).alias("kg"))


def clause_ids(spark: SparkSession, d: str) -> DataFrame:
    """Score ids of the lines of an order: the second of a kind gets its number."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("score_"), "l_returnflag").alias("name"), "l_linenumber", "l_partkey", "l_suppkey")
    return passages.occurrence_ids(li, ["l_orderkey"], "name", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "id")


def fields_stated_twice(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders state a priority in several ways: rank and name of a priority are one amount."""
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.substring("o_orderpriority", 1, 1)).otherwise(F.col("o_orderpriority")).alias("value"), F.col("o_orderstatus").alias("origin"))
    return passages.stated_twice(o, "o_custkey", "value", "origin", F.regexp_extract("value", "^[0-9]", 0))


def response_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Status of each customer's requirements by their packing run, counted by status and owner."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 4)
    category = F.when(F.col("k") == 0, "transport").when(F.col("k") == 1, "packaging").otherwise("commercial")
    requirements = o.select("o_custkey", category.alias("category"), (F.col("o_orderkey") % 3 == 0).alias("addressed"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("owner"))
    runs = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("can_fit"))
    marked = passages.response_status(requirements, runs, "o_custkey").withColumn("nation", F.col("o_custkey") % 25)
    return passages.count_by(marked, "nation", "status", "owner")


def statement_tally(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "covered").when(F.col("l_returnflag") == "A", "partial").when(F.col("l_linestatus") == "O", "gap").otherwise("human_required")
    return passages.tally(li.select("l_orderkey", F.col("l_partkey").alias("clause"), status.alias("status")), "l_orderkey")


def kb_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one language and of sources that begin alike, by size: filters that reach the scan."""
    docs = table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 1000))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").cast("bigint").alias("longest"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("orders", "lineitem", "events", "documents", "conversations")
    counts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def token_runs(spark: SparkSession, d: str) -> DataFrame:
    """How often each language's texts hold words of each length."""
    each = table(spark, d, "documents").select("lang", F.explode(text.runs(F.col("text"))).alias("run"))
    return each.groupBy("lang", F.char_length("run").cast("bigint").alias("length")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        kb_sections, kb_snippets, kb_match_strings, clause_containers, clause_masses, clause_ids, fields_stated_twice, response_matrix, statement_tally, kb_filter, table_counts, token_runs,
    )
}

SQL = {
    "kb_sections": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), m AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN '## ' || x ELSE x END), chr(10)) AS t FROM l),
      s AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)^(#{1,6}\s)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM m), p AS (SELECT doc_id, CASE WHEN len(ps) > 1 AND ps[1] = '' THEN ps[2:] ELSE ps END AS ps FROM s),
      u AS (SELECT doc_id, unnest(ps) AS body, generate_subscripts(ps, 1) - 1 AS section FROM p)
      SELECT doc_id, section, CASE WHEN regexp_matches(split_part(body, chr(10), 1), '^#{1,6}\s') THEN left(trim(regexp_replace(split_part(body, chr(10), 1), '^#+', '')), 120) ELSE '-' END AS heading, sha256(body) AS body_sha256 FROM u""",
    "kb_snippets": """WITH l AS (SELECT doc_id, text, [lower(lang), lower(left(source, 3)), 'and the'] AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS ls FROM documents),
      f AS (SELECT *, list_filter(ls, lambda x: contains(lower(x), w[1]) OR contains(lower(x), w[2]) OR contains(lower(x), w[3])) AS h FROM l) SELECT doc_id, left(coalesce(h[1], ls[1], text), 280) AS snippet FROM f""",
    "kb_match_strings": """WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[ \\n]+'), 1) AS k FROM benchmark), f AS (SELECT item_id, w, min(k) AS k FROM w WHERE regexp_full_match(w, '[a-z0-9_]+') GROUP BY 1, 2)
      SELECT item_id, coalesce(string_agg('"' || w || '"', ' OR ' ORDER BY k), '') AS "match" FROM benchmark LEFT JOIN f USING (item_id) GROUP BY 1""",
    "clause_containers": f"{_SQL_CLAUSES} SELECT code, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders FROM ({clause_sql.container_codes('c', 'o_orderkey', 'clause')}) WHERE code IS NOT NULL GROUP BY 1",
    "clause_masses": f"{_SQL_CLAUSES} SELECT o_orderkey, coalesce(q.n, 0) AS n, round(coalesce(q.kg, 0), 3) AS kg FROM c LEFT JOIN ({clause_sql.masses('c', 'o_orderkey', 'clause')}) q USING (o_orderkey)",
    "clause_ids": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, 'score_' || l_returnflag || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id FROM n""",
    "fields_stated_twice": """WITH m AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 1) ELSE o_orderpriority END AS v, o_orderstatus AS s FROM orders) SELECT o_custkey, count(*) AS n_values, count(DISTINCT left(v, 1)) = 1 AS same FROM m GROUP BY 1 HAVING count(*) >= 2""",
    "response_matrix": """WITH r AS (SELECT o_custkey % 25 AS nation, CASE WHEN o_orderkey % 4 < 2 AND c_custkey IS NOT NULL THEN CASE WHEN c_acctbal <= 0 THEN 'gap' WHEN o_orderkey % 3 = 0 THEN 'covered' ELSE 'human_required' END ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS owner FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0)
      SELECT nation, 'status' AS name, status AS value, count(*) AS n FROM r GROUP BY 1, 3 UNION ALL SELECT nation, 'owner', owner, count(*) FROM r GROUP BY 1, 3""",
    "statement_tally": """SELECT l_orderkey, count(*) AS total, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS clauses_covered, count(*) FILTER (l_returnflag = 'R') AS covered, count(*) FILTER (l_returnflag = 'A') AS partial,
      count(*) FILTER (l_returnflag NOT IN ('R', 'A') AND l_linestatus = 'O') AS gap, count(*) FILTER (l_returnflag NOT IN ('R', 'A') AND l_linestatus <> 'O') AS human_required FROM lineitem GROUP BY 1""",
    "kb_filter": "SELECT source, count(*) AS n, CAST(max(n_chars) AS BIGINT) AS longest FROM documents WHERE lang = 'en' AND n_chars >= 1000 GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "events", "documents", "conversations")),
    "token_runs": "WITH r AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents) SELECT lang, CAST(length(w) AS BIGINT) AS length, count(*) AS n FROM r GROUP BY 1, 2",
}
