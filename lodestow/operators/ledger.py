"""Ledger sums that an unknown poisons, keyed diffs, conservation of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisoned_sum(x: Column) -> Column:
    """The sum, or null if any value is unknown: a plain sum would pass over it."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def package_totals(rows: DataFrame, package: list[str], group: list[str], facts: list[str]) -> DataFrame:
    """Facts of a package count once. A package whose rows state different facts is a conflict and poisons every sum of its group."""
    keys = [*group, *(k for k in package if k not in group)]
    same = [((F.count(f) == 0) | ((F.count(f) == F.count(F.lit(1))) & (F.min(f) == F.max(f)))) for f in facts]
    agreed = same[0]
    for s in same[1:]:
        agreed &= s
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), agreed.alias("_agreed"), *(F.max(f).alias(f) for f in facts))
    known = [F.when(F.col("_agreed"), F.col(f)) for f in facts]
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("n_packages"), F.sum("_rows").alias("n_rows"), F.count_if(~F.col("_agreed")).alias("n_conflicts"), *(poisoned_sum(k).alias(f"sum_{f}") for k, f in zip(known, facts, strict=True)))


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """changed / unchanged / withdrawn / new for each key, with the names of the values that changed."""
    a = before.select(*keys, F.struct(*values).alias("old"))
    b = after.select(*keys, F.struct(*values).alias("new"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}")), F.lit(v)) for v in values)))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "withdrawn").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("changed"))


def conservation(materials: DataFrame, contents: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose pieces do not come out as they went in. contents(key, quantity, split_of): quantity parts of 1 / split_of piece each.

    Parts are summed for each split, whole pieces taken out, and the rests compared as whole numbers over the product of the
    splits that leave one: exact for any split, with up to 38 digits.
    """
    went_in = materials.groupBy(*key).agg(F.sum("quantity").cast("bigint").alias("pieces_in"))
    split = F.greatest(F.coalesce("split_of", F.lit(1)), F.lit(1)).cast("bigint")
    parts = contents.groupBy(*key, split.alias("split")).agg(F.sum("quantity").cast("bigint").alias("parts"))
    whole = F.floor(F.col("parts") / F.col("split")).cast("bigint")
    each = parts.withColumn("whole", whole).withColumn("rest", F.col("parts") - F.col("whole") * F.col("split"))
    rests = F.collect_list(F.when(F.col("rest") > 0, F.struct("rest", "split")))  # an entry for each split of one row
    came_out = each.groupBy(*key).agg(F.sum("whole").alias("whole"), rests.alias("rests"))
    number = lambda x: F.expr(f"cast({x} AS decimal(38, 0))")
    fraction = F.aggregate(
        "rests", F.struct(number("0").alias("n"), number("1").alias("d")),
        lambda f, r: F.struct((f["n"] * r["split"] + f["d"] * r["rest"]).cast("decimal(38,0)").alias("n"), (f["d"] * r["split"]).cast("decimal(38,0)").alias("d")),
    )
    both = went_in.join(came_out.withColumn("f", fraction), key, "full_outer").na.fill(0, ["pieces_in", "whole"])
    n, d = F.coalesce("f.n", number("0")), F.coalesce("f.d", number("1"))
    missing = F.col("pieces_in") - F.col("whole")
    both = both.withColumn("n", n).withColumn("d", d).where((missing * F.col("d")).cast("decimal(38,0)") != F.col("n"))
    out = F.col("whole") + F.col("n").cast("double") / F.col("d").cast("double")
    return both.select(*key, "pieces_in", F.round(out, 6).alias("pieces_out"), F.when(missing * F.col("d") > F.col("n"), "pieces_lost").otherwise("pieces_gained").alias("kind"))


# Spellings of one unit of count.
PIECES = ("pc", "pcs", "ea", "件", "个")


def unit_key(unit: Column) -> Column:
    """Spelling of a unit; null if it is not stated."""
    low = F.lower(F.trim(unit))
    return F.when(low.isin(*PIECES), "pcs").when((low == "") | (low == "unspecified"), None).otherwise(low)


def quantities_by_unit(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, unit, quantity): units never mix, and an unknown quantity makes the sum of its unit unknown."""
    return rows.withColumn("unit", unit_key(F.col("unit"))).groupBy(*keys, "unit").agg(poisoned_sum(F.col("quantity")).alias("quantity"))


def row_total(value: str) -> Column:
    """A weight of a row by its scope: package and item weights times their count, a row's as it is, null where scope or count are unknown."""
    return F.col(value) * F.when(F.col("weight_scope") == "package", F.col("package_count")).when(F.col("weight_scope") == "item", F.col("quantity")).when(F.col("weight_scope") == "row", 1)


def package_labels(rows: DataFrame, group: str) -> DataFrame:
    """(group, package_id, n_rows, n_containers, ambiguous): a label is local to its container, so one that is stated both with
    and without a container cannot be told to be one box or several. An unknown container counts as one."""
    stated = F.trim("container_id")
    cid = F.when(stated == "", None).otherwise(stated)
    found = rows.where("trim(package_id) <> ''").withColumn("cid", cid).groupBy(group, F.trim("package_id").alias("package_id"))
    known, lacking = F.count_distinct("cid"), F.max(F.col("cid").isNull().cast("int"))
    return found.agg(F.count("*").alias("n_rows"), (known + lacking).alias("n_containers"), ((known > 0) & (lacking > 0)).alias("ambiguous"))


_FACTS = ("package_count", "length_mm", "width_mm", "height_mm", "net_kg", "gross_kg")


def _sound(*scoped: Column) -> Column:
    """Do all rows of a group state package scopes, as counted by scoped, and equal facts?"""
    n = F.count(F.lit(1))
    sound = F.count("package_count") > 0
    for s in scoped:
        sound &= s == n
    for f in _FACTS:
        sound &= (F.count(f) == 0) | ((F.count(f) == n) & (F.min(f) == F.max(f)))
    return sound


def package_facts(rows: DataFrame, group: str) -> DataFrame:
    """One row for each package, or row without a label: (group, row_id, n_rows, conflict, package_count, net_kg, gross_kg).

    A package of several rows must state package scopes and equal facts and have one container; else it is a conflict and its
    facts are unknown. Weights are those of the whole package by its scope. row_id is its first row.
    """
    label = F.when(F.col(group).isNotNull() & (F.trim("package_id") != ""), F.trim("package_id"))
    marked = rows.withColumn("_p", label).withColumn("_c", F.coalesce(F.trim("container_id"), F.lit(""))).withColumn("_row", F.when(F.col("_p").isNull(), F.col("row_id")))
    first = lambda c, name: F.min_by(c, "row_id").alias(name)
    boxes = marked.groupBy(group, "_p", "_c", "_row").agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_rows"), ((F.count(F.lit(1)) > 1) & ~_sound(F.count_if(F.col("weight_scope") == "package"), F.count_if(F.col("dimension_scope") == "package"))).alias("conflict"),
        first("package_count", "count"), first(row_total("net_kg"), "net"), first(row_total("gross_kg"), "gross"),
    )
    # A label with and without a container is one package of two rows at least, whose containers differ: a conflict.
    of_label = Window.partitionBy(group, "_p")
    ambiguous = F.col("_p").isNotNull() & (F.min((F.col("_c") == "").cast("int")).over(of_label) < F.max((F.col("_c") == "").cast("int")).over(of_label))
    each = boxes.withColumn("_ambiguous", ambiguous).groupBy(group, "_p", F.when(F.col("_ambiguous"), "?").otherwise(F.col("_c")).alias("_where"), "_row").agg(
        F.min("row_id").alias("row_id"), F.sum("n_rows").alias("n_rows"), (F.max((F.col("conflict") | F.col("_ambiguous")).cast("int")) == 1).alias("conflict"), *(F.max(c).alias(c) for c in ("count", "net", "gross"))
    )
    sure = lambda c: F.when(~F.col("conflict"), F.col(c))
    return each.select(group, "row_id", "n_rows", "conflict", sure("count").alias("package_count"), sure("net").alias("net_kg"), sure("gross").alias("gross_kg"))


def _row_faults() -> list[tuple[Column, str, str, str]]:
    """(when, severity, code, field) of what may be wrong with one row."""
    numbers = ("quantity", "package_count", "units_per_package", "length_mm", "width_mm", "height_mm", "net_kg", "gross_kg")
    found = [(F.col(f).isNull(), "warning", f"missing_{f}", f) for f in ("name", "quantity", "package_count")]
    found += [(F.col(f) == 0, "warning", "zero_value", f) for f in numbers]
    found.append((F.col("quantity") != F.col("package_count") * F.col("units_per_package"), "error", "quantity_mismatch", "quantity"))
    found.append((F.col("gross_kg") < F.col("net_kg"), "error", "gross_below_net", "gross_kg"))
    sized = F.coalesce("length_mm", "width_mm", "height_mm").isNotNull()
    found.append((sized & F.col("dimension_scope").isNull(), "error", "unknown_scope", "dimension_scope"))
    found.append((F.coalesce("net_kg", "gross_kg").isNotNull() & F.col("weight_scope").isNull(), "error", "unknown_scope", "weight_scope"))
    return found


def row_issues(rows: DataFrame) -> DataFrame:
    """(keys of rows, severity, code, field) of each issue of one row."""
    issue = lambda when, severity, code, field: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field")))
    keys = [c for c in ("shipment_id", "row_id") if c in rows.columns]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*(issue(*x) for x in _row_faults())))).alias("i")).select(*keys, "i.*")


def ledger_issues(rows: DataFrame, group: str = "shipment_id") -> DataFrame:
    """(group, row_id, severity, code, field) of all issues of each document: those of rows, of packages and of units."""
    packages = package_facts(rows, group).where("conflict").select(group, "row_id", F.lit("error").alias("severity"), F.lit("package_group_conflict").alias("code"), F.lit("package_id").alias("field"))
    units = rows.groupBy(group).agg(F.count_distinct(unit_key(F.col("unit"))).alias("n"), F.max(unit_key(F.col("unit")).isNull().cast("int")).alias("unknown"))
    of_units = lambda when, code: units.where(when).select(group, F.lit(None).cast("bigint").alias("row_id"), F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit("unit").alias("field"))
    return row_issues(rows).unionByName(packages).unionByName(of_units("n + unknown > 1", "mixed_quantity_units")).unionByName(of_units("unknown = 1", "unknown_quantity_unit"))


def issue_counts(rows: DataFrame, group: str = "shipment_id", *sums: str) -> DataFrame:
    """(group, n_rows, errors, warnings, sums): how many of ledger_issues each document has, with sums of columns of its rows.

    No issue is made to be counted, and a document's rows meet once: first those of one label in one container, then those of a label, then all.
    """
    number = lambda severity: sum((F.when(when, 1).otherwise(0) for when, s, _, _ in _row_faults() if s == severity), F.lit(0)).cast("bigint")
    unit, label = unit_key(F.col("unit")), F.trim("package_id")
    rows = rows.withColumn("_unit", unit).withColumn("_other", ~F.col("_unit").eqNullSafe(F.first("_unit").over(Window.partitionBy(group))))
    rows = rows.select(
        group, F.when(label != "", label).alias("_p"), F.coalesce(F.trim("container_id"), F.lit("")).alias("_c"), F.when(F.coalesce(label, F.lit("")) == "", F.col("row_id")).alias("_row"), *_FACTS,
        (F.col("weight_scope").eqNullSafe("package") & F.col("dimension_scope").eqNullSafe("package")).alias("_scoped"), number("error").alias("_errors"), number("warning").alias("_warnings"),
        F.col("_other").cast("int").alias("_other"), F.col("_unit").isNull().cast("int").alias("_unknown"), *(F.col(c).alias(f"_sum_{c}") for c in sums),
    )
    kept = ("_errors", "_warnings", *(f"_sum_{c}" for c in sums))
    together = lambda: (*(F.sum(c).alias(c) for c in kept), F.max("_other").alias("_other"), F.max("_unknown").alias("_unknown"))
    n = F.count(F.lit(1))
    boxes = rows.groupBy(group, "_p", "_c", "_row").agg(n.alias("_n"), ((n > 1) & ~_sound(F.count_if("_scoped"))).cast("bigint").alias("_conflict"), *together())
    # A label with and without a container has two rows at least and is one package, a conflict.
    bare, stated = F.max((F.col("_c") == "").cast("int")), F.max((F.col("_c") != "").cast("int"))
    conflicts = F.when(F.col("_p").isNotNull() & (bare + stated == 2), F.lit(1)).otherwise(F.sum("_conflict")).cast("bigint")
    labels = boxes.groupBy(group, "_p").agg(F.sum("_n").alias("_n"), conflicts.alias("_conflict"), *together())
    found = labels.groupBy(group).agg(F.sum("_n").alias("n_rows"), F.sum("_conflict").alias("_conflict"), *together())
    warnings = F.col("_warnings") + F.col("_other") + F.col("_unknown")
    return found.select(group, "n_rows", (F.col("_errors") + F.col("_conflict")).alias("errors"), warnings.alias("warnings"), *(F.col(f"_sum_{c}").alias(c) for c in sums))


def compare_by_id(current: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, differs): rows meet by an explicit id only; an id that repeats on a side is ambiguous, rows without one are left out."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.first(F.struct(*fields)).alias(name))  # first counts where it is the only one

    both = side(current, "a").join(side(other, "b"), key, "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    status = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "ambiguous_duplicate").when(F.col("n_b").isNull(), "only_current").when(F.col("n_a").isNull(), "only_comparison")
    status = status.otherwise(F.when(F.size(differs) > 0, "different").otherwise("same"))
    return both.select(key, status.alias("status"), F.when(status == "different", F.array_join(differs, ",")).otherwise("").alias("differs"))
