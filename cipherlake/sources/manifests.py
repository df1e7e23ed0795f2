"""Dependency manifests: rows (path, content) to rows (path, name, version, language, direct)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Version operators in the order in which they are looked for.
OPERATORS = ("===", "~=", "==", "!=", ">=", "<=", ">", "<")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("no", "raw")).withColumn("line", F.trim(F.translate("raw", "\t\r", "  ")))


def _field(line: Column, i: int) -> Column:
    return F.get(F.split(line, " +"), F.lit(i))


def go_mod(files: DataFrame) -> DataFrame:
    """Require blocks, single requires and the module line. [A9]

    Block membership is the last opening or closing line so far, by file.
    """
    line = F.col("line")
    opens, closes = line.startswith("require (") | line.startswith("require("), line == ")"
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = _lines(files).withColumn("inside", F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(before), F.lit(False)))
    single = line.startswith("require ") & ~line.contains("(")
    module = line.startswith("module ")
    inner = F.col("inside") & (line != "") & ~line.startswith("//") & ~closes & ~opens
    at = F.when(single | module, 1).otherwise(0)
    n = F.size(F.split(line, " +"))
    rows = rows.where((single & (n >= 3)) | (~single & inner & (n >= 2)) | (~single & module & (n >= 2)))
    version = F.when(module & ~F.col("inside"), "").otherwise(F.get(F.split(line, " +"), at + 1))
    return rows.select("path", F.get(F.split(line, " +"), at).alias("name"), version.alias("version"), F.lit("go").alias("language"), (~line.contains("// indirect")).alias("direct"))


def requirements_txt(files: DataFrame) -> DataFrame:
    """Names and versions, by the first operator in a fixed order that occurs. [A11]"""
    line = F.col("line")
    rows = _lines(files).where((line != "") & ~line.startswith("#") & ~line.startswith("-"))
    op = F.coalesce(*[F.when(F.instr(line, o) > 1, F.lit(o)) for o in OPERATORS])
    rows = rows.withColumn("op", op)
    name = F.trim(F.when(F.col("op").isNull(), line).otherwise(F.expr("substring(line, 1, instr(line, op) - 1)")))
    version = F.when(F.col("op").isNull(), "").otherwise(F.trim(F.expr("substring(line, instr(line, op) + length(op))")))
    rows = rows.select("path", name.alias("name"), version.alias("version"))
    plain = F.when(F.instr("name", "[") > 1, F.substring_index("name", "[", 1)).otherwise(F.col("name"))
    return rows.select("path", plain.alias("name"), "version", F.lit("python").alias("language"), F.lit(True).alias("direct")).where("name <> ''")


def package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies; the latter are not direct. [A10]"""
    parsed = files.select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    part = lambda c, direct: parsed.select("path", F.explode(f"p.{c}").alias("name", "version"), F.lit("javascript").alias("language"), F.lit(direct).alias("direct"))
    return part("dependencies", True).unionByName(part("devDependencies", False))


def pom_xml(files: DataFrame) -> DataFrame:
    """``group:artifact`` of each dependency; test scope is not direct. [A12]"""
    deps = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"))).alias("d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1))
    name = F.when(tag("artifactId") != "", F.concat_ws(":", tag("groupId"), tag("artifactId"))).otherwise(tag("groupId"))
    return deps.select("path", name.alias("name"), tag("version").alias("version"), F.lit("java").alias("language"), (tag("scope") != "test").alias("direct"))


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests by file name, one row per language and name, the first version in path order. [A13]"""
    name = F.element_at(F.split("path", "/"), -1)
    parts = [(go_mod, "go.mod"), (package_json, "package.json"), (requirements_txt, "requirements.txt"), (pom_xml, "pom.xml")]
    out = None
    for parse, base in parts:
        part = parse(files.where(name == base))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("language", "name").agg(F.min_by("version", F.struct("path", "version")).alias("version"), F.bool_or("direct").alias("direct"))
