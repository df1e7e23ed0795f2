"""Sources, sinks, detection and streaming on files written by the tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cipherlake.operators import access, calls, compliance, detect, inventory, relational as R, workflow
from cipherlake.sources import certificates, code_calls, files, manifests, samples, sinks
from cipherlake.sources.bridge import findings
from cipherlake.sources.sample_certificates import PEM
from cipherlake.streaming.monitor import Monitor, stream_table


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, (_, text) in samples.FILES.items():
        (root / path[1:]).parent.mkdir(parents=True, exist_ok=True)
        (root / path[1:]).write_text(text)
    for p, t in {"app/node_modules/x.js": "crypto.createHash('md5')", "app/notes.txt": "x", "app/certs/c.pem": PEM["/certs/rsa.pem"], "app/embed.go": f"const c = `{PEM['/certs/ec.pem']}`", "app/data.bin": "a\0b", "app/requirements.txt": "paramiko==3\n"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return f"file://{root}"


def test_walk(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: r.language for r in files.walk(spark, tree).collect()}
    assert got["keys.go"] == "go" and got["sshd_config"] == "config" and "x.js" not in got and "notes.txt" not in got
    only = {r.language for r in files.walk(spark, tree, languages=("python",)).collect()}
    assert only == {"python", "config"}
    assert "sign.py" not in {r.path.rsplit("/", 1)[1] for r in files.walk(spark, tree, exclude=("app",)).collect()}


def test_walk_reads_no_content(spark, tree):
    plan = files.walk(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_scan_of_files(spark, tree):
    found = detect.match_text_rules(detect.lines(files.texts(spark, tree)))
    rules = {(r.path.rsplit("/", 1)[1], r.rule_id) for r in found.collect()}
    assert {("keys.go", "QS-RSA-001"), ("sign.py", "QS-MD5-001"), ("Box.java", "QS-SHA1-001"), ("nginx.conf", "QS-TLS-001"), ("sshd_config", "QS-SSH-001")} <= rules
    assert not [r for r in rules if r[0] == "safe.go"]


def test_binary(spark, tree):
    rows = spark.createDataFrame([(bytearray(b"a\0"),), (bytearray(b"\x10\x01"),), (bytearray(),), (None,), (bytearray(b"x" * 600 + b"\0"),)], "b binary")
    assert [r.x for r in rows.select(files.is_binary(F.col("b")).alias("x")).collect()] == [True, False, False, False, False]


def test_certificates(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: r for r in certificates.certificates(files.certificate_files(spark, tree)).collect()}
    assert set(got) == {"c.pem", "embed.go"} and (got["c.pem"].key_algo, got["c.pem"].key_size, got["c.pem"].subject) == ("RSA", 2048, "rsa.example.org")
    assert len(got["c.pem"].dns_names) == 4 and got["c.pem"].not_after > dt.datetime(2030, 1, 1) and (got["embed.go"].key_algo, got["embed.go"].key_size, got["embed.go"].is_ca) == ("ECDSA", 384, False)
    assert certificates.read_certificates(b"junk") == [] and certificates.read_certificates(b"") == []
    found = certificates.certificate_findings(certificates.certificates(files.certificate_files(spark, tree))).collect()
    assert {(r.algorithm, r.late) for r in found} == {("RSA-2048", True), ("ECDSA-P384", False)}


def test_manifests(spark):
    rows = [("/a/go.mod", "module m\nrequire (\n\tx v1 // indirect\n)\nrequire y v2\n"), ("/a/package.json", '{"dependencies":{"node-rsa":"1"}}'), ("/b/package.json", "not json"), ("/a/pom.xml", "<project/>"), ("/a/requirements.txt", "")]
    got = {(r.language, r.name): (r.version, r.direct) for r in manifests.dependencies(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("go", "m"): ("", True), ("go", "x"): ("v1", False), ("go", "y"): ("v2", True), ("javascript", "node-rsa"): ("1", True)}


def test_go_tokens():
    text = 'package p\nimport r "crypto/rsa"\n// r.GenerateKey(x, 1)\nvar s = `r.GenerateKey(`\nfunc (t *T) f(a, b int, c map[string]int) (x, error) {\n\tif k, err := r.GenerateKey(rand.Reader,\n\t\t2048); err != nil {\n\t\tg(k, "a,b", h(1, 2))\n\t}\n}\n'
    rows = code_calls.go_rows("x.go", text)
    assert [r[9] for r in rows if r[1] == "func"] == [None] and [r[8] for r in rows if r[1] == "func"] == [["a", "b", "c"]]
    made = [(r[3], r[5], r[6], r[7], r[8]) for r in rows if r[1] == "call"]
    assert ("f", "r", "crypto/rsa", "GenerateKey", ["rand.Reader", "2048"]) in made and ("f", "", None, "g", ["k", '"a,b"', "h(1,2)"]) in made and len([m for m in made if m[3] == "GenerateKey"]) == 1
    assert code_calls.go_rows("x.go", "") == [] and code_calls.go_rows("x.go", "func ({[") is not None


def test_python_rows():
    rows = code_calls.python_rows("x.py", "import hashlib as h\nk = RSA.generate(2048, e=3)\nz = 'md5'\n")
    assert [(r[1], r[3]) for r in rows] == [("import", "hashlib"), ("assign", "k"), ("call", "RSA.generate"), ("assign", "z")] and rows[2][4] == ["2048"] and rows[2][5] == {"e": "3"}
    assert code_calls.python_rows("x.py", "def (") == []


def test_taint_depth(spark):
    text = "package p\nfunc f0(a int) {\n\tk := rsa.GenerateKey(r)\n\tf1(k)\n}\n" + "".join(f"func f{i}(a int) {{\n\tb := a\n\tf{i + 1}(b)\n}}\n" for i in range(1, 8)) + "func f8(a int) {\n\trsa.SignPSS(a)\n}\n"
    code = lambda t: code_calls.go_code(spark.createDataFrame([("/x.go", t)], "path string, content string"))
    assert calls.taint(code(text)).count() == 0
    short = calls.taint(code(text.replace("f4(b)", "f8(b)"))).first()
    assert short.confidence == pytest.approx(0.95 * 0.95**4) and short.sink == "rsa.SignPSS"


def test_workflow(spark):
    f = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0), ("b", dt.datetime(2024, 1, 1), 3)], "finding_id string, created_at timestamp_ntz, severity int")
    moves = [("a", dt.datetime(2024, 1, d), d, s) for d, s in enumerate(["triaged", "fixed", "assigned", "in_progress", "in_review", "fixed", "verified"], 1)]
    got = {r.finding_id: r for r in workflow.with_deadline(workflow.fold(f, spark.createDataFrame(moves, "finding_id string, ts timestamp_ntz, id long, to_status string"))).collect()}
    assert (got["a"].status, got["a"].moves, got["b"].status, got["a"].deadline) == ("verified", 6, "new", dt.datetime(2024, 1, 15))
    states = workflow.with_deadline(workflow.fold(f, spark.createDataFrame([], "finding_id string, ts timestamp_ntz, id long, to_status string")))
    assert [r.finding_id for r in workflow.breaches(states, "2024-02-01").collect()] == ["a"]
    assert spark.range(1).select(workflow.after_assignment(F.lit("new")).alias("s")).first().s == "assigned"


def test_store_round_trip(spark, sf, tmp_path):
    f = findings(spark, sf).where("scan_id like 'scan-1996-%'")
    path = f"{tmp_path}/store"
    sinks.save_scans(f, path)
    n = f.count()
    assert files.stored_scans(spark, path).count() == n
    one = f.where("scan_id = 'scan-1996-3'").limit(3)
    sinks.save_scans(one, path)
    again = files.stored_scans(spark, path)
    assert again.count() == n - f.where("scan_id = 'scan-1996-3'").count() + 3
    assert "PartitionFilters: [isnotnull(scan_id" in again.where("scan_id = 'scan-1996-3'")._jdf.queryExecution().executedPlan().toString()
    sinks.save_baseline(one.select("rule_id", "file_path"), f"{tmp_path}/base")
    assert files.baseline(spark, f"{tmp_path}/base", "rule_id string, file_path string").count() == 3 and files.baseline(spark, f"{tmp_path}/none", "rule_id string").count() == 0


def test_exchange_formats(spark, sf):
    f = findings(spark, sf)
    run = sinks.sarif(f).select(F.get_json_object("run", "$.tool.driver.rules[0].id").alias("id"), "rule_id").collect()
    assert run and all(r.id == r.rule_id for r in run)
    assert sinks.bill_of_materials(f).select(F.get_json_object("component", "$.cryptoProperties.oid").alias("oid")).where("oid is not null").count() > 3
    assert sinks.compliance_json(f).count() == 5 and sinks.table_report(f).columns == ["severity", "algorithm", "location", "description"]
    assert sinks.review_payload(f, spark.createDataFrame([("src/f1.go",)], "path string")).where("event = 'REQUEST_CHANGES'").count() >= 0


def test_sarif_runs_are_bounded(spark):
    """A rule's results come in several runs, equal ones and a null rule too, and none is lost."""
    kinds = "CASE WHEN id % 4 = 0 THEN 'R-1' WHEN id % 400 = 1 THEN NULL ELSE 'R-0' END AS rule_id"
    f = spark.range(20_000).selectExpr(kinds, "0 AS severity", "'RSA' AS algorithm", "'usage' AS description", "IF(id % 2 = 0, '/same', concat('/f', id)) AS file_path", "1 AS line_start", "0L AS l_suppkey", "0D AS l_quantity", "0D AS l_extendedprice", "id AS l_orderkey", "DATE'2020-01-01' AS created_at")
    uri = "transform(from_json(run, 'results array<struct<locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>').results, x -> x.locations[0].physicalLocation.artifactLocation.uri)"
    runs = sinks.sarif(f).selectExpr("rule_id", "part", f"{uri} AS uri").cache()
    assert runs.selectExpr("max(size(uri))").first()[0] <= 2 * sinks.RUN and runs.where("rule_id = 'R-0'").count() >= 10
    got = runs.select("rule_id", F.explode("uri").alias("file_path")).groupBy("rule_id", "file_path").count()
    want = f.groupBy("rule_id", "file_path").count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    runs.unpersist()


def test_empty_findings(spark, sf):
    none = findings(spark, sf).limit(0)
    assert compliance.reports(none).where("overall = 'compliant'").count() == 5
    assert R.risk(none).first().asDict() == {"total": 0, "risk_score": 0.0, "readiness": 100.0}
    assert R.check_run(none).first().conclusion == "success" and R.summary(none).count() == 0
    assert inventory.components(none).count() == 0 and R.dedupe(none).count() == 0


def test_dedupe_keeps_the_most_confident(spark):
    rows = [("/a", 1, "R", 0.5, "x"), ("/a", 1, "R", 0.9, "b"), ("/a", 1, "R", 0.9, "a"), ("/a", 2, "R", 0.1, "c")]
    got = R.dedupe(spark.createDataFrame(rows, "file_path string, line_start int, rule_id string, confidence double, algorithm string"), ties=("algorithm",)).collect()
    assert sorted((r.line_start, r.algorithm) for r in got) == [(1, "a"), (2, "c")]


def test_keys(spark):
    stored = access.hashed_keys(spark.createDataFrame([(1, "k_0123456789"), (2, "k_x")], "id int, plaintext string")).withColumn("expires_at", F.when(F.col("id") == 2, F.lit("2020-01-01").cast("timestamp")))
    shown = spark.createDataFrame([("k_0123456789",), ("k_x",), ("other",)], "plaintext string")
    assert [r.id for r in access.valid_keys(shown, stored, "2024-01-01").collect()] == [1]


def test_monitor_restarts(spark, tmp_path):
    """A monitor that is stopped and started again goes on from its state."""
    source, schema = f"{tmp_path}/in", "rule_id string, file_path string, line_start int"
    for n, keys in enumerate([["a", "b"], ["b", "c"], ["c"]]):
        spark.createDataFrame([(k, "/f", 1) for k in keys], schema).coalesce(1).write.mode("append").parquet(source)
        m = Monitor(spark, f"{tmp_path}/work")
        m.run(stream_table(spark, source, schema))
    got = {(r.batch, r.change, r.key) for r in m.outbox().collect()}
    assert got == {(0, "new", "a:/f:1"), (0, "new", "b:/f:1"), (1, "new", "c:/f:1"), (1, "fixed", "a:/f:1"), (2, "fixed", "b:/f:1")}
    m.step(m.outbox().limit(0).selectExpr("'x' AS rule_id", "'y' AS file_path", "1 AS line_start"), 2)


@pytest.mark.parametrize("regex,text", [("ab", "ab"), (r"a\.b\(", "a.b("), ("abc?d", "ab"), ("x*yz", "yz"), ("ab{2}cd", "cd"), ("(?:ab|cd)e", "e"), ("ab|cd", ""), (r"\bab\b", "ab"), ("[xy]ab.*c", "ab")])
def test_needed_literal(regex, text):
    assert detect.needed_literal(regex) == text


def test_rule_join_is_broadcast(spark):
    plan = detect.match_text_rules(detect.lines(samples.files(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "RLIKE" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 10 and {"file_path", "rule_id", "severity"} <= set(out.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
