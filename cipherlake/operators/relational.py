"""Relational work over findings: de-duplication, summaries, diffs, reviews, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cipherlake.functions.labels import annotation_level, basename, category_label, migrations, repository_path, sarif_level, severity_label, threat_label

#: A total order for rows that agree in the key of an operator.
TIES = ("algorithm", "l_suppkey", "l_quantity", "l_extendedprice", "l_orderkey", "created_at")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. [E1, E2]

    A ranking window is pruned to its first row before the shuffle (Spark's
    window group limit), so a hot key sends one row from each task.
    """
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def dedupe(findings: DataFrame, ties: tuple[str, ...] = TIES) -> DataFrame:
    """One finding per (file, line, rule), the most confident. [E1]"""
    return best_by(findings, ["file_path", "line_start", "rule_id"], [F.desc("confidence"), *[F.asc(c) for c in ties]])


def report_rows(findings: DataFrame, ties: tuple[str, ...] = TIES) -> DataFrame:
    """The report's rows: by severity, the first of each (file, line). [E2, F4]"""
    return best_by(findings, ["file_path", "line_start"], [F.asc("severity"), F.asc("rule_id"), *[F.asc(c) for c in ties]])


def rules_of(findings: DataFrame, ties: tuple[str, ...] = TIES) -> DataFrame:
    """The first finding of each rule, which describes the rule in a SARIF run. [G3]"""
    return best_by(findings, ["rule_id"], [F.asc("severity"), F.asc("file_path"), F.asc("line_start"), *[F.asc(c) for c in ties]])


def phase_union(phases: dict[str, DataFrame]) -> DataFrame:
    """Bag union of analysis phases, each row naming its own. [G1]"""
    out = None
    for name, df in phases.items():
        df = df.withColumn("phase", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, category, language, threat and in total, in one pass; no rows without findings. [D1]"""
    labelled = findings.select(severity_label(F.col("severity")).alias("severity"), category_label(F.col("category")).alias("category"), "language", threat_label(F.col("quantum_threat")).alias("threat"))
    grouped = labelled.groupingSets([["severity"], ["category"], ["language"], ["threat"], []], "severity", "category", "language", "threat").agg(F.count("*").alias("n"), F.grouping_id("severity", "category", "language", "threat").alias("g"))
    kind = F.when(F.col("g") == 7, "severity").when(F.col("g") == 11, "category").when(F.col("g") == 13, "language").when(F.col("g") == 14, "threat").otherwise("total")
    return grouped.select(kind.alias("kind"), F.coalesce("severity", "category", "language", "threat", F.lit("")).alias("label"), F.col("n").cast("long").alias("n"))


def risk(findings: DataFrame, *keys: str) -> DataFrame:
    """Risk score and readiness, 0 to 100; without findings 0 and 100. [D2]"""
    shor, grover, total = F.count_if(F.col("quantum_threat") == 0), F.count_if(F.col("quantum_threat") == 1), F.count("*")
    score = F.when(total == 0, F.lit(0.0)).otherwise(F.least((shor * F.lit(1.0) + grover * F.lit(0.4)) / F.greatest(total, F.lit(1)) * 100, F.lit(100.0)))
    out = findings.groupBy(*keys).agg(total.alias("total"), score.alias("risk_score"))
    return out.select(*keys, "total", F.round("risk_score", 6).alias("risk_score"), F.round(100 - F.col("risk_score"), 6).alias("readiness"))


def size_counts(findings: DataFrame) -> DataFrame:
    """Files and distinct lines with findings, and findings. [D3]"""
    return findings.agg(F.countDistinct("file_path").alias("files"), F.countDistinct("file_path", "line_start").alias("lines"), F.count("*").alias("findings"))


def fingerprint(kind: str) -> Column:
    """The identity of a finding for a diff: ``baseline`` or ``monitor``. [H7]"""
    if kind == "baseline":
        return F.concat_ws(":", basename(F.col("file_path")), F.col("line_start").cast("string"), "rule_id", "algorithm")
    return F.concat_ws(":", "rule_id", "file_path", F.col("line_start").cast("string"))


def difference(new: DataFrame, old: DataFrame, kind: str) -> DataFrame:
    """Distinct keys of ``new`` that ``old`` has not. [C3, G2]"""
    return new.select(fingerprint(kind).alias("key")).distinct().join(old.select(fingerprint(kind).alias("key")).distinct(), "key", "left_anti")


def diff_counts(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows (duplicates count) and fixed keys, as a terminal view counts them. [G2]"""
    n = new.select(fingerprint("monitor").alias("key"))
    o = old.select(fingerprint("monitor").alias("key"))
    added = n.join(o.distinct(), "key", "left_anti").agg(F.count("*").alias("new_rows"))
    fixed = o.distinct().join(n.distinct(), "key", "left_anti").agg(F.count("*").alias("fixed_keys"))
    return added.crossJoin(fixed)


def changed_file_comments(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in changed files (one column ``path``), as review comments. [C4]"""
    return findings.withColumn("path", repository_path(F.col("file_path"))).join(changed.select("path").distinct(), "path", "left_semi")


def check_run(findings: DataFrame) -> DataFrame:
    """Conclusion, title tail and counts of a check run. [D13]"""
    counts = findings.agg(*[F.count_if(F.col("severity") == i).alias(n) for i, n in enumerate(("critical", "high", "medium", "low"))], F.count("*").alias("total"))
    has = lambda c: F.col(c) > 0
    conclusion = F.when(has("critical") | has("high"), "failure").when(has("medium") | has("low"), "neutral").otherwise("success")
    title = F.when(has("critical"), F.concat(F.col("critical").cast("string"), F.lit(" critical quantum vulnerability findings"))).when(has("high"), F.concat(F.col("high").cast("string"), F.lit(" high-severity quantum vulnerability findings")))
    title = title.when(has("medium"), F.concat(F.col("medium").cast("string"), F.lit(" medium-severity findings"))).when(has("low"), F.concat(F.col("low").cast("string"), F.lit(" low-severity findings"))).otherwise("No quantum-vulnerable cryptography found")
    return counts.select("critical", "high", "medium", "low", "total", conclusion.alias("conclusion"), title.alias("title"))


def annotations(findings: DataFrame) -> DataFrame:
    return findings.select(repository_path(F.col("file_path")).alias("path"), F.col("line_start").alias("start_line"), annotation_level(F.col("severity")).alias("level"), F.concat(F.lit("Quantum-vulnerable: "), F.col("algorithm")).alias("title"))


def with_migration(findings: DataFrame) -> DataFrame:
    """Replacement and effort of the exact algorithm name, where the table has one. [B4, C2]"""
    m = F.broadcast(migrations(findings.sparkSession))
    return findings.join(m, "algorithm", "left")


def scans(findings: DataFrame) -> DataFrame:
    """One row per scan with its summary. [C5]"""
    base = risk(findings, "scan_id")
    more = findings.groupBy("scan_id").agg(F.min("scan_date").alias("started"), F.max("scan_date").alias("completed"), F.count_if(F.col("severity") == 0).alias("critical"), F.count_if(F.col("severity") == 1).alias("high"), F.countDistinct("file_path").alias("files"))
    return base.join(more, "scan_id")


def list_scans(scan_table: DataFrame, limit: int = 50) -> DataFrame:
    """The latest scans; a limit of 0 or less is 50. [F1]"""
    return scan_table.orderBy(F.desc("completed"), F.desc("scan_id")).limit(limit if limit > 0 else 50)


def trend(scan_table: DataFrame, now: str, days: int) -> DataFrame:
    """Scans completed within ``days`` before ``now``, oldest first. [J7]"""
    return scan_table.where(F.col("completed") >= F.date_sub(F.lit(now).cast("date"), days)).orderBy("completed", "scan_id")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the scans of ``new`` replaced. [K1]"""
    return stored.join(new.select("scan_id").distinct(), "scan_id", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def dashboard(findings: DataFrame) -> DataFrame:
    """Automatic and manual fixes, weeks at two confidences, and counts by concern. [D17]"""
    a, m = F.count_if(F.col("auto_fix")), F.count_if(~F.col("auto_fix"))
    weeks = lambda x, y: F.round(F.greatest((a * F.lit(x) + m * F.lit(y)) / F.lit(40.0), F.lit(0.1)), 6)
    return findings.agg(a.alias("auto"), m.alias("manual"), weeks(0.5, 4.0).alias("p50_weeks"), weeks(1.0, 8.0).alias("p90_weeks"), F.count_if((F.col("severity") == 0) & (F.col("quantum_threat") == 0)).alias("critical_shor"), F.count_if(F.col("in_dependency")).alias("dependency"), F.count_if(F.col("category") == 7).alias("certificate"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Flat SARIF results. [K5, H9]"""
    return findings.select("rule_id", sarif_level(F.col("severity")).alias("level"), F.concat(F.col("algorithm"), F.lit(": "), F.col("description")).alias("message"), F.col("file_path").alias("uri"), F.col("line_start").alias("start_line"))


def note_lines(findings: DataFrame) -> DataFrame:
    """Markdown table rows of a merge-request note, one per finding. [H25]"""
    cell = F.concat(F.lit("| "), severity_label(F.col("severity")), F.lit(" | `"), F.col("algorithm"), F.lit("` | "), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit(" |"))
    return findings.select(cell.alias("line"))


def note(lines: DataFrame, limit: int = 50_000) -> DataFrame:
    """The note's text, cut off past ``limit`` characters, as the forge's API demands. [H25]

    A line has ten characters or more, so a bounded number of first lines fills it.
    """
    return lines.orderBy("line").limit(limit // 10 + 1).agg(F.left(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit(limit)).alias("note"))
