"""Sinks: stored scans, baselines, and the exchange formats as JSON or CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.labels import category_label, migrations, sarif_level, severity_label, threat_label
from cipherlake.functions.storage import materialise
from cipherlake.operators import compliance as C, inventory as I, relational as R


def save_scans(findings: DataFrame, path: str) -> None:
    """Upsert by scan: the partitions of the scans at hand are replaced, all others stay. [K1]

    Dynamic partition overwrite commits a scan's files at once, so a repeated
    save leaves one copy.
    """
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def save_baseline(findings: DataFrame, path: str) -> None:
    """One JSON object per finding. [K2]"""
    findings.write.mode("overwrite").json(path)


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, with labels. [K3, H21]"""
    named = findings.withColumns({"severity_label": severity_label(F.col("severity")), "category_label": category_label(F.col("category")), "threat_label": threat_label(F.col("quantum_threat"))})
    return named.select(F.to_json(F.struct("*")).alias("json"))


#: Results of a SARIF run, about, and of equal ones that stay together; rules whose texts are broadcast at most.
RUN, LOT, MOST_RULES = 1000, 100, 20_000


def sarif(findings: DataFrame, tool: str = "cipherlake") -> DataFrame:
    """(rule_id, part, run): SARIF 2.1.0 runs of one rule each, its rule entry and about ``RUN`` of its results. [K5, G3]

    Every finding is a result of one run. A rule has as many runs as its results
    need, dealt by hash, so no row grows with the findings; the format allows any
    number of runs. Equal results are counted first and dealt in lots of ``LOT``.
    """
    result = F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.concat(F.col("algorithm"), F.lit(": "), F.col("description")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    equal = materialise(findings.select("rule_id", result.alias("result")).groupBy("rule_id", "result").agg(F.count("*").alias("n")), "results")
    entry = F.array(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription")))
    sizes = equal.groupBy(F.col("rule_id").alias("sized")).agg(F.ceil(F.sum("n") / RUN).alias("runs"))
    rules = R.rules_of(findings).select("rule_id", entry.alias("rules")).join(sizes, F.col("rule_id").eqNullSafe(F.col("sized")))
    rules = materialise(rules.select(F.col("rule_id").alias("rule"), "rules", "runs"), "rules")
    rules = F.broadcast(rules) if rules.count() <= MOST_RULES else rules
    own = F.col("rule_id").eqNullSafe(F.col("rule"))
    lots = equal.withColumn("lot", F.explode(F.expr(f"sequence(0L, (n - 1) div {LOT})"))).withColumn("n", F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("int"))
    dealt = lots.join(rules.select("rule", "runs"), own).select("rule_id", F.pmod(F.xxhash64("result", "lot"), "runs").alias("part"), F.struct("result", "n").alias("lot"))
    runs = dealt.groupBy("rule_id", "part").agg(F.sort_array(F.collect_list("lot")).alias("lots")).join(rules.select("rule", "rules"), own)
    results = F.flatten(F.transform("lots", lambda x: F.array_repeat(x["result"], x["n"]))).alias("results")
    named = F.struct(F.concat_ws("/", "rule_id", F.col("part").cast("string")).alias("id")).alias("automationDetails")
    return runs.select("rule_id", "part", F.to_json(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), named, results)).alias("run"))


def bill_of_materials(findings: DataFrame) -> DataFrame:
    """One CycloneDX 1.6 component per row, as JSON. [K6]"""
    c = I.components(findings)
    return c.select("algorithm", F.to_json(F.struct(
        F.lit("cryptographic-asset").alias("type"), F.col("algorithm").alias("name"),
        F.struct(F.lit("algorithm").alias("assetType"), F.struct("primitive", F.col("parameter").alias("parameterSetIdentifier"), F.col("classical_bits").alias("classicalSecurityLevel"), F.col("quantum_bits").alias("nistQuantumSecurityLevel")).alias("algorithmProperties"), "oid").alias("cryptoProperties"),
        F.struct("occurrences").alias("evidence"),
    )).alias("component"))


def compliance_json(findings: DataFrame) -> DataFrame:
    """One report per framework as JSON; the requirements of all five are 23 rows. [K7]"""
    r = C.requirements(findings).groupBy("framework").agg(F.array_sort(F.collect_list(F.struct("requirement", "deadline", "blocking", "status"))).alias("requirements"))
    return r.join(C.reports(findings), "framework").select("framework", F.to_json(F.struct("*")).alias("json"))


def table_report(findings: DataFrame) -> DataFrame:
    """The rows of the text report, most severe first. [K4, B29]"""
    short = F.concat_ws("/", F.slice(F.split("file_path", "/"), F.greatest(F.size(F.split("file_path", "/")) - 2, F.lit(1)), F.lit(3)))
    return R.report_rows(findings).orderBy("severity", "file_path", "line_start").select(severity_label(F.col("severity")).alias("severity"), "algorithm", F.concat(short, F.lit(":"), F.col("line_start").cast("string")).alias("location"), F.left("description", F.lit(60)).alias("description"))


def review_payload(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Comments and event of a pull-request review; nothing is posted. [K8]"""
    m = F.broadcast(migrations(findings.sparkSession))
    c = R.changed_file_comments(findings, changed).join(m, "algorithm", "left")
    body = F.concat(severity_label(F.col("severity")), F.lit(" "), F.col("algorithm"), F.lit(": "), F.col("description"), F.coalesce(F.concat(F.lit(" Replace with "), F.col("replacement"), F.lit(".")), F.lit("")))
    return c.select("path", F.col("line_start").alias("line"), body.alias("body"), F.when(F.col("severity") == 0, "REQUEST_CHANGES").otherwise("COMMENT").alias("event"))


def save_outbox(messages: DataFrame, tag: str = "outbox") -> DataFrame:
    """Messages for delivery by another process. [J3]"""
    return materialise(messages, tag)
