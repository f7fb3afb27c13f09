"""Ledger, event, retrieval, tender and schedule queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import events as ev
from ..operators import ledger, ranking, retrieval, schedule, tender
from .tables import SQL_CARGO, cargo, table

# --- ledger


def _packages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the ledger: a supplier's rows of a shipment share a package; some state no weight, some another."""
    rows = cargo(spark, d)
    net = F.when(F.col("part_no") % 50 != 0, F.when(F.col("part_no") % 7 == 0, F.col("supplier_id") * 10 + F.col("part_no") % 2).otherwise(F.col("supplier_id") * 10))
    return rows.select("shipment_id", "supplier_id", net.alias("net_kg"), (F.col("supplier_id") % 4 + 1).alias("package_count"))


def ledger_totals_poison(spark: SparkSession, d: str) -> DataFrame:
    totals = ledger.package_totals(_packages(spark, d), ["supplier_id"], ["shipment_id"], ["net_kg", "package_count"])
    return totals.withColumns({c: F.col(c).cast("double") for c in ("sum_net_kg", "sum_package_count")})


def ledger_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two revisions of each part's lines, told apart by the status of the line."""
    li = table(spark, d, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))
    return ledger.keyed_diff(side("F"), side("O"), ["l_partkey", "l_suppkey"], ["n", "qty"])


def conservation_check(spark: SparkSession, d: str) -> DataFrame:
    """Lines packed whole or in up to 29 parts a piece, some with a part lost or gained; most rows are split in two ways."""
    rows = cargo(spark, d)
    materials = rows.select("shipment_id", "row_id", F.col("qty").alias("quantity"))
    ways = F.col("part_no") % 28 + 2
    change = F.when(F.col("part_no") % 97 == 0, -1).when(F.col("part_no") % 89 == 0, 1).otherwise(0)
    whole = rows.select("shipment_id", "row_id", F.expr("qty DIV 2").alias("quantity"), F.lit(1).cast("bigint").alias("split_of"))
    split = rows.select("shipment_id", "row_id", ((F.col("qty") - F.expr("qty DIV 2") - 1) * ways + change).alias("quantity"), ways.alias("split_of"))
    last = rows.select("shipment_id", "row_id", (F.col("part_no") % 13 + 1).alias("quantity"), (F.col("part_no") % 13 + 1).alias("split_of"))
    return ledger.conservation(materials, whole.unionByName(split).unionByName(last), ["shipment_id", "row_id"])


# --- events


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("run_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_id")  # a number of its own: many small rows must not meet in few tasks
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")).cast("bigint")).withColumnRenamed("event_type", "type")


_EVENTS = """e AS (SELECT *, event_type AS type, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS seq FROM (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS run_id FROM events))"""


def event_first_per_run(spark: SparkSession, d: str) -> DataFrame:
    return ev.first_per(_events(spark, d), ["run_id"], F.desc("ts"), "event_id").select("run_id", "event_id", "type")


def event_merge_sources(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("run_id", F.when(F.col("event_id") % 5 != 0, F.col("seq")).alias("seq"), "type")
    a = e.withColumn("origin", F.lit("x"))
    b = e.where("seq IS NULL OR seq % 2 = 0").unionByName(e.where("type = 'click' AND seq IS NULL")).withColumn("origin", F.lit("x"))
    return ev.merge_events(a, b).groupBy("type", F.col("seq").isNull().alias("unnumbered")).agg(F.count("*").alias("n"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    session = F.when(F.col("user_id") % 11 != 0, F.col("user_id"))
    return _events(spark, d).groupBy("run_id", session.alias("session_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events"))


_RUNS = f"""{_EVENTS}, runs AS (SELECT run_id, CASE WHEN user_id % 11 <> 0 THEN user_id END AS session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events FROM e GROUP BY 1, 2)"""


def event_prune(spark: SparkSession, d: str) -> DataFrame:
    pruned = ev.prune(_runs(spark, d), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), 3)
    return pruned.groupBy(F.coalesce("session_id", F.lit(-1)).alias("session_id")).agg(F.count_if("archived").alias("n_archived"), F.count("*").alias("n_runs"))


def event_stale_anti(spark: SparkSession, d: str) -> DataFrame:
    sessions = _runs(spark, d).select("run_id", F.col("started_at").alias("saved_at"))
    return ev.stale(sessions, _events(spark, d), "purchase").select("run_id")


def runs_exists_semi(spark: SparkSession, d: str) -> DataFrame:
    errors = _events(spark, d).where("type = 'error'").select("run_id").distinct()
    return _runs(spark, d).join(errors, "run_id", "left_semi").select("run_id", "n_events")


def session_list_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 20 of runs, newest first: a page is the feature."""
    return _runs(spark, d).orderBy(F.desc("started_at"), "run_id").offset(40).limit(20).select("run_id", "n_events")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    changes = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(0).alias("version"))
    return ev.upsert_latest(o, changes, ["o_orderkey"], "version").groupBy("o_orderstatus", "version").agg(F.count("*").alias("n"))


def weekly_ppc(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    done = F.count_if(F.col("event_type") == "purchase")
    return e.groupBy(week.cast("string").alias("week_start")).agg(done.alias("done"), F.count_if(F.col("event_type") == "error").alias("missed"), F.count("*").alias("planned"), F.round(100 * done / F.count("*"), 4).alias("ppc"))


def kpi_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count("*") / 100, 4).alias("mean_value"), F.count_if(F.col("k") > 50).alias("k_high"))


def kpi_compare(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring days of one user whose number of events differs by 1 at most."""
    r = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    a, b = r.alias("a"), r.alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.day") == F.date_add("a.day", 1)))
    return met.where(F.abs(F.col("a.n") - F.col("b.n")) <= 1).groupBy("a.user_id").agg(F.count("*").alias("n_pairs"))


def memory_revisions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn", F.col("text").alias("value"))
    return ev.revisions(rows, ["conv_id", "role"], "turn", "value").select("conv_id", "role", "turn", "value", F.col("superseded_by").cast("double").alias("superseded_by"), "state")


# --- text


def kb_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("ts"))
    return docs.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ts", " ").cast("binary"), 256).alias("tokens_sha256"))


def kb_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each benchmark text."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(text.index_tokens(F.col("text")))).alias("term"))
    scored = ranking.bm25_nearest(table(spark, d, "documents"), queries, 10).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 10, "doc_id").select("query", "doc_id", "score", "rank")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.concat_ws("/", "lang", "source").alias("path"))


def kb_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents for each benchmark text by its tokens in title, body and path."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.tokens(F.col("text"))).alias("token"))
    scored = retrieval.keyword_top(_titled(spark, d), queries, 5, "title", "body", "path")
    return retrieval.top_k(scored, 5, "doc_id").select("query", "doc_id", "score", "rank")


def kb_best_paths(spark: SparkSession, d: str) -> DataFrame:
    """The three best paths for each conversation's first turn: documents of one source are one path."""
    first = table(spark, d, "conversations").where("turn = 1").select(F.col("conv_id").alias("query"), "text")
    queries = first.select("query", F.explode(F.array_distinct(text.index_tokens(F.col("text")))).alias("term"))
    layer = F.when(F.col("doc_id") % 3 == 0, "expert").when(F.col("doc_id") % 3 == 1, "category").otherwise("company")
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("path"), layer.alias("layer"))
    hits = ranking.bm25_best(docs, queries, ["path", "layer"], most=3).withColumn("score", F.round("score", 4))
    return retrieval.best_by_path(hits, 3)


def citation_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    cites = docs.select(F.col("doc_id").alias("cite_id"), (F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha"), F.concat(F.substring("text", 3, 20), F.when(F.col("doc_id") % 5 == 0, "~~").otherwise("")).alias("quote"))
    return retrieval.verify_citations(cites, docs)


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.char_length("t").cast("bigint").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


def requirement_rules(spark: SparkSession, d: str) -> DataFrame:
    found = tender.requirement_lines(table(spark, d, "documents"), [("licence", "(?i)licen[sc]e"), ("contact", "@[a-z0-9]+"), ("number", "[0-9]{3,}"), ("emphasis", "!!|\\*\\*\\*")])
    return found.groupBy("theme").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


def response_match_ngram(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "benchmark").select(F.col("item_id").alias("req"), "text")
    resp = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("resp"), "text")
    return tender.match_responses(req, resp)


def number_provenance(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("grp"), "text")
    drafts = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("grp"), F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string")).alias("text")).distinct()
    return tender.untraced_numbers(drafts, docs, "grp").distinct()


def eval_prf(spark: SparkSession, d: str) -> DataFrame:
    """A rule of marks and bars as a detector of bad quality, by language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.col("text").rlike("!!|&&&|[|]").alias("predicted"), (F.col("quality") == 0).alias("actual"))
    return tender.precision_recall(rows, "predicted", "actual", "lang")


def quantity_cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 8
    raw = F.when(k == 0, "").when(k == 1, "0").when(k == 2, "2.7").when(k == 3, "abc").when(k == 4, "-3").when(k == 5, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" EA"))).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    q = table(spark, d, "lineitem").select(numbers.quantity(raw).alias("q"))
    return q.groupBy("q.state").agg(F.count("*").alias("n"), F.coalesce(F.sum("q.qty"), F.lit(0)).alias("qty"))


def section_properties(spark: SparkSession, d: str) -> DataFrame:
    """Hollow sections, some higher than wide and some not; walls that leave no hollow have no section."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 40).cast("double").alias("b"), (F.col("p_partkey") % 60 + 30).cast("double").alias("h"), (F.col("p_partkey") % 25).cast("double").alias("t"))
    s = p.select("p_partkey", numbers.hollow_section(F.col("b"), F.col("h"), F.col("t")).alias("s")).where("s.area IS NOT NULL")
    return s.select("p_partkey", F.round("s.area", 3).alias("area"), F.round("s.inertia", 3).alias("inertia"), F.round("s.modulus", 3).alias("modulus"), F.round("s.radius", 5).alias("radius"))


# --- schedules and graphs


def calendar_workdays(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    holidays = table(spark, d, "events").select(F.date_sub(F.to_date("ts"), 365 * 26).alias("day")).distinct()
    days = schedule.workdays(spans, holidays)
    return days.groupBy("o_orderpriority").agg(F.count("*").alias("n_days"), F.max("day").cast("string").alias("last_day"), F.max("offset").cast("bigint").alias("last_offset"))


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Part k follows parts k / 2 and k / 3."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("duration"))
    links = parts.where("id >= 2").select(F.expr("id DIV 2").alias("before"), F.col("id").alias("after"), F.lit(0).cast("bigint").alias("lag"))
    return parts.where("id >= 1"), links.unionByName(parts.where("id >= 3").select(F.expr("id DIV 3").alias("before"), F.col("id").alias("after"), F.lit(1).cast("bigint").alias("lag")))


def cpm_critical(spark: SparkSession, d: str) -> DataFrame:
    return schedule.critical_path(*_tasks(spark, d))


def resource_sweep(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("start"), F.date_add("o_orderdate", 14).alias("end"), F.lit(1).alias("units"))
    loads = schedule.resource_load(o, "o_orderpriority")
    return loads.groupBy("o_orderpriority").agg(F.max("load").alias("peak"), F.count("*").alias("n_intervals"))


def wbs_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Earliest start, latest end and weighted progress of every level of region, nation, customer."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    done = F.sum((F.col("o_orderstatus") == "F").cast("bigint") * F.round("o_totalprice").cast("bigint")) / F.sum(F.round("o_totalprice").cast("bigint"))
    out = o.rollup("n_regionkey", "n_nationkey").agg(F.min("o_orderdate").cast("date").cast("string").alias("first_day"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"), F.round(done, 6).alias("progress"), F.count("*").alias("n"))
    return out.na.fill(-1, ["n_regionkey", "n_nationkey"])


def cpm_link_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same parts under links of all four kinds, with lags forwards and back."""
    tasks, links = _tasks(spark, d)
    kind = F.element_at(F.array(*(F.lit(k) for k in ("FS", "SS", "FF", "SF"))), (F.col("after") % 4 + 1).cast("int"))
    return schedule.schedule(tasks, links.select("before", "after", kind.alias("kind"), (F.col("after") % 5 - 1).alias("lag")))


def schedule_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a task: the plan of the open ones against that of the filled ones."""
    o = table(spark, d, "orders")
    plan = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    return schedule.compare_baseline(plan("F"), plan("O")).select("id", "status", F.col("days").cast("double").alias("days"))


def wbs_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All levels above each part in the tree that hangs part k under part k / 2, by depth."""
    parents = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey DIV 2")).alias("parent"))
    return schedule.ancestors(parents).groupBy("depth").agg(F.count("*").alias("n"), F.sum("ancestor").alias("ancestors"))


def route_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Distances from nation 0 over trade links: customers of one nation buy from suppliers of another; fewer deals, longer road."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("to"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from"))
    deals = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    scarce = F.expr("20000 DIV n")
    edges = deals.groupBy("from", "to").agg(F.count("*").alias("n")).select("from", "to", (scarce * scarce + F.col("to") * 7 + 1).alias("weight"))
    return schedule.shortest_routes(edges, 0).na.fill(-1, ["distance"])


QUERIES = {
    f.__name__: f
    for f in (
        ledger_totals_poison, ledger_diff, conservation_check, event_first_per_run, event_merge_sources, event_prune, event_stale_anti, runs_exists_semi, session_list_page, upsert_latest, weekly_ppc,
        kpi_by_type, kpi_compare, memory_revisions, kb_tokens, kb_bm25_topk, kb_score_topk, kb_best_paths, citation_verify, html_to_text, requirement_rules, response_match_ngram, number_provenance, eval_prf, quantity_cells,
        section_properties, calendar_workdays, cpm_critical, cpm_link_kinds, schedule_baseline, wbs_ancestors, resource_sweep, wbs_rollup, route_shortest,
    )
}

_PACKAGES = f"WITH {SQL_CARGO}, p AS (SELECT shipment_id, supplier_id, CASE WHEN part_no % 50 <> 0 THEN CASE WHEN part_no % 7 = 0 THEN supplier_id * 10 + part_no % 2 ELSE supplier_id * 10 END END AS net_kg, supplier_id % 4 + 1 AS package_count FROM cargo)"
_LINKS = "tasks AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS duration FROM part WHERE p_partkey >= 1), links AS (SELECT id // 2 AS b, id AS a, 0::BIGINT AS lag FROM tasks WHERE id >= 2 UNION ALL SELECT id // 3, id, 1::BIGINT FROM tasks WHERE id >= 3)"
SQL = {
    "ledger_totals_poison": f"""{_PACKAGES}, e AS (SELECT shipment_id, supplier_id, count(*) AS n, (count(net_kg) = 0 OR (count(net_kg) = count(*) AND min(net_kg) = max(net_kg))) AND min(package_count) = max(package_count) AS agreed, max(net_kg) AS net, max(package_count) AS pc FROM p GROUP BY 1, 2)
      SELECT shipment_id, count(*) AS n_packages, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (NOT agreed) AS n_conflicts, CASE WHEN bool_and(agreed AND net IS NOT NULL) THEN CAST(sum(net) AS DOUBLE) END AS sum_net_kg, CASE WHEN bool_and(agreed) THEN CAST(sum(pc) AS DOUBLE) END AS sum_package_count FROM e GROUP BY 1""",
    "ledger_diff": """WITH s AS (SELECT l_linestatus AS st, l_partkey, l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT * FROM s WHERE st = 'F'), b AS (SELECT * FROM s WHERE st = 'O'),
      j AS (SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.st AS sa, b.st AS sb, a.n AS na, b.n AS nb, a.qty AS qa, b.qty AS qb FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)
      SELECT l_partkey, l_suppkey, CASE WHEN sa IS NULL THEN 'new' WHEN sb IS NULL THEN 'withdrawn' WHEN na <> nb OR qa <> qb THEN 'changed' ELSE 'unchanged' END AS status,
        CASE WHEN sa IS NULL OR sb IS NULL THEN '' ELSE concat_ws(',', CASE WHEN na <> nb THEN 'n' END, CASE WHEN qa <> qb THEN 'qty' END) END AS changed FROM j""",
    # One fraction over the least common multiple of the splits.
    "conservation_check": f"""WITH {SQL_CARGO}, c AS (SELECT shipment_id, row_id, qty // 2 AS q, 1 AS s FROM cargo
        UNION ALL SELECT shipment_id, row_id, (qty - qty // 2 - 1) * (part_no % 28 + 2) + CASE WHEN part_no % 97 = 0 THEN -1 WHEN part_no % 89 = 0 THEN 1 ELSE 0 END, part_no % 28 + 2 FROM cargo
        UNION ALL SELECT shipment_id, row_id, part_no % 13 + 1, part_no % 13 + 1 FROM cargo),
      l AS (SELECT *, lcm(max(s) FILTER (s > 1 AND k = 1) OVER w, coalesce(max(s) FILTER (s > 1 AND k = 2) OVER w, 1)) AS m FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id, row_id, s > 1 ORDER BY s) AS k FROM c) WINDOW w AS (PARTITION BY shipment_id, row_id)),
      o AS (SELECT shipment_id, row_id, coalesce(max(m), 1) AS m, sum(q * (coalesce(m, 1) // s)) AS parts FROM l GROUP BY 1, 2)
      SELECT shipment_id, row_id, qty AS pieces_in, round(parts::DOUBLE / m::DOUBLE, 6) AS pieces_out, CASE WHEN qty * m > parts THEN 'pieces_lost' ELSE 'pieces_gained' END AS kind FROM cargo JOIN o USING (shipment_id, row_id) WHERE qty * m <> parts""",
    "event_first_per_run": f"WITH {_EVENTS} SELECT run_id, event_id, type FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id) = 1",
    "event_merge_sources": f"""WITH {_EVENTS}, x AS (SELECT run_id, CASE WHEN event_id % 5 <> 0 THEN seq END AS seq, type FROM e), c AS (SELECT run_id, type, count(*) AS n, CASE WHEN type = 'click' THEN 2 ELSE 1 END AS m FROM x WHERE seq IS NULL GROUP BY 1, 2)
      SELECT type, false AS unnumbered, count(*) AS n FROM (SELECT DISTINCT run_id, seq, type FROM x WHERE seq IS NOT NULL) GROUP BY 1 UNION ALL SELECT type, true, CAST(sum(n * m) AS BIGINT) FROM c GROUP BY 1""",
    "event_prune": f"""WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at, run_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM runs)
      SELECT coalesce(session_id, -1) AS session_id, count(*) FILTER (started_at < TIMESTAMP '2024-01-20' AND (session_id IS NULL OR r <= n - 2)) AS n_archived, count(*) AS n_runs FROM k GROUP BY 1""",
    "event_stale_anti": f"WITH {_RUNS} SELECT run_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND e.type = 'purchase' AND e.ts >= r.started_at)",
    "runs_exists_semi": f"WITH {_RUNS} SELECT run_id, n_events FROM runs r WHERE EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND e.type = 'error')",
    "session_list_page": f"WITH {_RUNS} SELECT run_id, n_events FROM runs ORDER BY started_at DESC, run_id LIMIT 20 OFFSET 40",
    "upsert_latest": "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS version, count(*) AS n FROM orders GROUP BY 1, 2",
    "weekly_ppc": "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS missed, count(*) AS planned, round(100 * count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*), 4) AS ppc FROM events GROUP BY 1",
    "kpi_by_type": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum, round(sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) / 100, 4) AS mean_value, count(*) FILTER (CAST(props->>'$.k' AS BIGINT) > 50) AS k_high FROM events GROUP BY 1",
    "kpi_compare": "WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.user_id, count(*) AS n_pairs FROM r a JOIN r b ON a.user_id = b.user_id AND b.day = a.day + 1 WHERE abs(a.n - b.n) <= 1 GROUP BY 1",
    "memory_revisions": """WITH r AS (SELECT conv_id, role, turn, text AS value FROM conversations), c AS (SELECT *, lag(value) OVER (PARTITION BY conv_id, role ORDER BY turn) AS p FROM r), k AS (SELECT * FROM c WHERE p IS NULL OR p <> value)
      SELECT conv_id, role, turn, value, CAST(lead(turn) OVER w AS DOUBLE) AS superseded_by, CASE WHEN lead(turn) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS state FROM k WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)""",
    "kb_bm25_topk": """WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM documents), t AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM x), i AS (SELECT term, doc_id, count(*) AS tf, any_value(l) AS l FROM t GROUP BY 1, 2),
      m AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM x WHERE len(ts) > 0), q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
      s AS (SELECT query, doc_id, round(sum(greatest(ln((m.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m.a))), 6) AS score FROM q JOIN f USING (term) JOIN i USING (term), m GROUP BY 1, 2)
      SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 10""",
    "citation_verify": """WITH c AS (SELECT doc_id AS cite_id, doc_id + CASE WHEN doc_id % 13 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN '0' ELSE sha256(text) END AS sha, substr(text, 3, 20) || CASE WHEN doc_id % 5 = 0 THEN '~~' ELSE '' END AS quote FROM documents)
      SELECT cite_id, c.doc_id, CASE WHEN d.text IS NULL THEN 'missing' WHEN sha256(d.text) <> sha THEN 'changed' WHEN NOT contains(d.text, quote) THEN 'misquoted' ELSE 'ok' END AS reason FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id""",
    "html_to_text": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
      b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM a) SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM b""",
    "requirement_rules": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), t AS (SELECT doc_id, CASE WHEN regexp_matches(x, '(?i)licen[sc]e') THEN 'licence' WHEN regexp_matches(x, '@[a-z0-9]+') THEN 'contact' WHEN regexp_matches(x, '[0-9]{3,}') THEN 'number' WHEN regexp_matches(x, '!!|\*\*\*') THEN 'emphasis' END AS theme FROM l)
      SELECT theme, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM t WHERE theme IS NOT NULL GROUP BY 1""",
    "response_match_ngram": """WITH a AS (SELECT DISTINCT item_id AS req, left(unnest(regexp_extract_all(lower(text), '[a-z]{5,}')), 6) AS s FROM benchmark), b AS (SELECT DISTINCT conv_id * 1000 + turn AS resp, left(unnest(regexp_extract_all(lower(text), '[a-z]{5,}')), 6) AS s FROM conversations)
      SELECT req, resp, count(*) AS shared FROM a JOIN b USING (s) GROUP BY 1, 2 HAVING count(*) >= 3""",
    "number_provenance": """WITH e AS (SELECT DISTINCT doc_id % 50 AS grp, CAST(round(TRY_CAST(unnest(regexp_extract_all(text, '[0-9]{1,12}(?:[.][0-9]{1,4})?')) AS DOUBLE) * 100) AS BIGINT) AS v FROM documents), f AS (SELECT grp, v FROM e UNION SELECT grp, CAST(round(v::DOUBLE / 100) AS BIGINT) * 100 FROM e UNION SELECT grp, v * 100 FROM e),
      d AS (SELECT DISTINCT l_orderkey % 50 AS grp, unnest([CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)]) AS raw FROM lineitem) SELECT grp, raw FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.grp = d.grp AND f.v = CAST(d.raw AS BIGINT) * 100)""",
    "eval_prf": """WITH r AS (SELECT lang, regexp_matches(text, '!!|&&&|[|]') AS p, quality = 0 AS a FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p) AS predicted, count(*) FILTER (a) AS actual FROM r GROUP BY 1), k AS (SELECT *, tp::DOUBLE / nullif(predicted, 0) AS pp, tp::DOUBLE / nullif(actual, 0) AS rr FROM s)
      SELECT lang, tp, predicted, actual, round(pp, 4) AS precision, round(rr, 4) AS recall, round(2 * pp * rr / nullif(pp + rr, 0), 4) AS f1 FROM k""",
    "quantity_cells": """SELECT CASE l_partkey % 8 WHEN 0 THEN 'missing' WHEN 1 THEN 'zero' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' ELSE 'ok' END AS state, count(*) AS n, CAST(sum(CASE WHEN l_partkey % 8 >= 5 THEN l_quantity ELSE 0 END) AS BIGINT) AS qty FROM lineitem GROUP BY 1""",
    "section_properties": """WITH p AS (SELECT p_partkey, b, h, b * h - (b - 2 * t) * (h - 2 * t) AS area, (b * h ** 3 - (b - 2 * t) * (h - 2 * t) ** 3) / 12 AS x, (h * b ** 3 - (h - 2 * t) * (b - 2 * t) ** 3) / 12 AS y
        FROM (SELECT p_partkey, (p_size + 40)::DOUBLE AS b, (p_partkey % 60 + 30)::DOUBLE AS h, (p_partkey % 25)::DOUBLE AS t FROM part) WHERE t > 0 AND b > 2 * t AND h > 2 * t)
      SELECT p_partkey, round(area, 3) AS area, round(greatest(x, y), 3) AS inertia, round(CASE WHEN x >= y THEN 2 * x / h ELSE 2 * y / b END, 3) AS modulus, round(sqrt(least(x, y) / area), 5) AS radius FROM p""",
    "calendar_workdays": """WITH s AS (SELECT o_orderpriority, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), h AS (SELECT DISTINCT CAST(ts AS DATE) - 9490 AS day FROM events), d AS (SELECT o_orderpriority, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
      SELECT o_orderpriority, count(*) AS n_days, CAST(max(day) AS VARCHAR) AS last_day, count(*) - 1 AS last_offset FROM d WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM h) GROUP BY 1""",
    "cpm_critical": f"""WITH RECURSIVE {_LINKS}, fw AS (SELECT id, 0::BIGINT AS es, 0 AS k FROM tasks UNION ALL SELECT a, max(es + duration + lag), k + 1 FROM (SELECT l.a, f.es, t.duration, l.lag, f.k FROM fw f JOIN links l ON l.b = f.id JOIN tasks t ON t.id = f.id) GROUP BY a, k),
      es AS (SELECT id, max(es) AS es FROM fw GROUP BY 1), bw AS (SELECT id, 0::BIGINT AS tail, 0 AS k FROM tasks UNION ALL SELECT b, max(tail + duration + lag), k + 1 FROM (SELECT l.b, f.tail, t.duration, l.lag, f.k FROM bw f JOIN links l ON l.a = f.id JOIN tasks t ON t.id = f.id) GROUP BY b, k),
      tl AS (SELECT id, max(tail) AS tail FROM bw GROUP BY 1), m AS (SELECT max(es + duration) AS span FROM es JOIN tasks USING (id))
      SELECT id, duration, es, span - tail - duration AS ls, span - tail - duration - es AS slack, span - tail - duration = es AS critical FROM es JOIN tl USING (id) JOIN tasks USING (id), m""",
    "resource_sweep": """WITH p AS (SELECT o_orderpriority, day, sum(d) AS d FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, 1 AS d FROM orders UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE) + 14, -1 FROM orders) GROUP BY 1, 2), s AS (SELECT o_orderpriority, sum(d) OVER (PARTITION BY o_orderpriority ORDER BY day) AS load, lead(day) OVER (PARTITION BY o_orderpriority ORDER BY day) AS nx FROM p)
      SELECT o_orderpriority, CAST(max(load) AS BIGINT) AS peak, count(*) AS n_intervals FROM s WHERE nx IS NOT NULL GROUP BY 1""",
    "wbs_rollup": """SELECT coalesce(n_regionkey, -1) AS n_regionkey, coalesce(n_nationkey, -1) AS n_nationkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, round(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END)::DOUBLE / sum(CAST(round(o_totalprice) AS BIGINT))::DOUBLE, 6) AS progress, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""",
    "route_shortest": """WITH RECURSIVE g AS (SELECT s_nationkey AS f, c_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT f, t, (20000 // n) * (20000 // n) + t * 7 + 1 AS w FROM g),
      r AS (SELECT 0 AS node, 0::BIGINT AS d, 0 AS k UNION ALL SELECT t, min(d + w), k + 1 FROM (SELECT e.t, r.d, e.w, r.k FROM r JOIN e ON e.f = r.node WHERE r.k < 25) GROUP BY t, k), b AS (SELECT node, min(d) AS distance FROM r GROUP BY 1)
      SELECT n.node, coalesce(CAST(distance AS BIGINT), -1) AS distance FROM (SELECT f AS node FROM e UNION SELECT t FROM e) n LEFT JOIN b USING (node)""",
    "kb_tokens": """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: len(x) >= 2 OR regexp_full_match(x, '[0-9]+')) AS ts FROM documents),
      u AS (SELECT doc_id, ts, unnest(ts) AS x, generate_subscripts(ts, 1) AS k FROM t), f AS (SELECT doc_id, x, min(k) AS k FROM u GROUP BY 1, 2), s AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS joined FROM f GROUP BY 1)
      SELECT doc_id, coalesce(n, 0) AS n_tokens, sha256(coalesce(joined, '')) AS tokens_sha256 FROM documents LEFT JOIN s USING (doc_id)""",
    "kb_score_topk": """WITH d AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS body, lower(lang || '/' || source) AS path, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM documents),
      q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: len(x) >= 2 OR regexp_full_match(x, '[0-9]+'))) AS token FROM benchmark), w AS (SELECT DISTINCT token FROM q),
      h AS (SELECT doc_id, token, 10 * list_contains(ts, token)::INT + 25 * contains(title, token)::INT + 8 * contains(body, token)::INT + 12 * contains(path, token)::INT AS p FROM d, w WHERE contains(body, token) OR contains(path, token)),
      s AS (SELECT query, doc_id, sum(p)::DOUBLE / 10 AS score FROM q JOIN h USING (token) GROUP BY 1, 2)
      SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 5""",
    "kb_best_paths": """WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM documents), t AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM x), i AS (SELECT term, doc_id, count(*) AS tf, any_value(l) AS l FROM t GROUP BY 1, 2),
      m AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM x WHERE len(ts) > 0), q AS (SELECT DISTINCT conv_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations WHERE turn = 1), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
      s AS (SELECT query, doc_id, round(sum(greatest(ln((m.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m.a))), 4) AS score FROM q JOIN f USING (term) JOIN i USING (term), m GROUP BY 1, 2),
      h AS (SELECT query, source || '/' || lang AS path, (['expert', 'category', 'company'])[doc_id % 3 + 1] AS layer, score FROM s JOIN documents USING (doc_id)),
      b AS (SELECT *, row_number() OVER (PARTITION BY query, path ORDER BY score DESC, layer <> 'expert', layer) AS k FROM h)
      SELECT query, path, layer, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, layer <> 'expert', path) AS INTEGER) AS rank FROM b WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, layer <> 'expert', path) <= 3""",
    "cpm_link_kinds": f"""WITH RECURSIVE {_LINKS}, w AS (SELECT b, a, a % 5 - 1 + CASE WHEN a % 4 IN (0, 2) THEN x.duration ELSE 0 END - CASE WHEN a % 4 IN (2, 3) THEN y.duration ELSE 0 END AS w FROM links JOIN tasks x ON x.id = b JOIN tasks y ON y.id = a),
      fw AS (SELECT id, 0::BIGINT AS es, 0 AS k FROM tasks UNION ALL SELECT a, greatest(0, max(es + w))::BIGINT, k + 1 FROM (SELECT w.a, f.es, w.w, f.k FROM fw f JOIN w ON w.b = f.id) GROUP BY a, k),
      bw AS (SELECT id, duration AS tail, 0 AS k FROM tasks UNION ALL SELECT b, max(tail + w)::BIGINT, k + 1 FROM (SELECT w.b, t.tail, w.w, t.k FROM bw t JOIN w ON w.a = t.id) GROUP BY b, k),
      e AS (SELECT id, max(es) AS es FROM fw GROUP BY 1), t AS (SELECT id, max(tail) AS tail FROM bw GROUP BY 1), j AS (SELECT tasks.id, duration, es, tail, max(es + duration) OVER () AS span FROM tasks JOIN e ON e.id = tasks.id JOIN t ON t.id = tasks.id)
      SELECT id, duration, es, span - tail AS ls, span - tail - es AS slack, span - tail = es AS critical FROM j""",
    "schedule_baseline": """WITH p AS (SELECT o_custkey AS id, o_orderstatus AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1, 2)
      SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'existing' END AS status, CAST(b.e - a.e AS DOUBLE) AS days FROM (SELECT * FROM p WHERE s = 'F') a FULL JOIN (SELECT * FROM p WHERE s = 'O') b ON a.id = b.id""",
    "wbs_ancestors": """WITH RECURSIVE a AS (SELECT p_partkey AS id, p_partkey // 2 AS anc, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT id, anc // 2, depth + 1 FROM a WHERE anc > 1) SELECT depth, count(*) AS n, CAST(sum(anc) AS BIGINT) AS ancestors FROM a GROUP BY 1""",
}
