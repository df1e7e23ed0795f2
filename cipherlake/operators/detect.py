"""Detection in source lines: text rules, ordered rules with context, diffs and fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cipherlake.functions.fixed_rules import JAVA_RULES, JS_RULES, KUBERNETES_RULES, TERRAFORM_RULES, TEXT_RULES
from cipherlake.functions.labels import CATEGORY_ORDINALS, migrations, portable_regex

_SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
_THREAT = {"broken_by_shor": 0, "weakened_by_grover": 1}


def lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no from 1, line) of rows (path, language, content). [A3]"""
    return files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", "language", (F.col("pos") + 1).alias("line_no"), "line")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\f"))


def is_noise(line: Column, language: Column) -> Column:
    """Blank lines, comments, and imports without a call. [B1]"""
    t = trimmed(line)
    comment = t.startswith("//") | t.startswith("/*") | t.startswith("*") | t.startswith("#")
    plain = t.startswith('"crypto/') | t.startswith("import ")
    python = (language == "python") & (t.startswith("from ") | t.startswith("import "))
    return (t == "") | comment | ((plain | python) & ~t.contains("("))


def text_rules(spark: SparkSession) -> DataFrame:
    """One row per rule and language: its alternatives folded into one expression. [A26, B30]"""
    rows = []
    for rule, name, severity, threat, category, replacement, _, groups in TEXT_RULES:
        sev = _SEVERITY.get(severity, 3)
        for language, message, patterns in groups:
            regex = "|".join(f"(?:{portable_regex(p)})" for p in patterns)
            rows.append((rule, name, sev, _THREAT.get(threat, 2), CATEGORY_ORDINALS.get(category, 0), replacement, "medium" if sev < 2 else "low", language, message, regex))
    return spark.createDataFrame(rows, "rule_id string, algorithm string, severity int, quantum_threat int, category int, replacement_algo string, migration_effort string, language string, description string, regex string")


def needed_literal(regex: str) -> str:
    """The longest text that every match of ``regex`` contains; empty if there is none that is plain to see."""
    best = run = ""
    i, depth = 0, 0
    while i < len(regex):
        c, n = regex[i], 1
        if c == "\\":
            n, c = 2, regex[i + 1] if not regex[i + 1].isalnum() else ""
        elif c == "[":
            n, c = regex.index("]", i + 2) - i + 1, ""
        elif c in "()":
            depth += 1 if c == "(" else -1
            c = ""
        elif c in "|":
            if not depth:
                return ""
            c = ""
        elif c in ".^$+":
            c = ""
        elif c in "*?{":
            n = regex.index("}", i) - i + 1 if c == "{" else 1
            run, c = run[:-1], ""
        if c and not depth:
            run += c
        else:
            best, run = max(best, run, key=len), ""
        i += n
    return max(best, run, key=len)


_RULE_COLUMNS = ("rule_id", "algorithm", "severity", "quantum_threat", "category", "replacement_algo", "migration_effort", "description")


def match_text_rules(source: DataFrame) -> DataFrame:
    """Findings of the text rules: each (rule, language) group fires once a line. [B2, B3, C1]

    The expressions are literals, compiled once; a line meets those of its
    language only. (Joined as a column, an expression would be compiled anew for
    every line and rule.) Matches then meet the 35 broadcast rule groups.
    """
    groups = [r.asDict() for r in text_rules(source.sparkSession).collect()]
    rules = F.broadcast(source.sparkSession.createDataFrame([(i, *[g[c] for c in _RULE_COLUMNS]) for i, g in enumerate(groups)], "rule int, rule_id string, algorithm string, severity int, quantum_threat int, category int, replacement_algo string, migration_effort string, description string"))
    texts = {(rule[0], g[0]): [needed_literal(p) for p in g[2]] for rule in TEXT_RULES for g in rule[7]}
    line, hits = F.col("line"), F.lit(None).cast("array<int>")
    for language in sorted({g["language"] for g in groups}):
        fired = []
        for i, g in enumerate(groups):
            if g["language"] == language:
                # a text that a match must contain is looked for first: it costs far less than the expression
                needed = texts[g["rule_id"], language]
                maybe = reduce(lambda a, b: a | b, [F.contains(line, F.lit(t)) for t in needed]) if all(needed) else F.lit(True)
                fired.append(F.when(maybe & line.rlike(g["regex"]), F.lit(i)))
        hits = F.when(F.col("language") == language, F.array_compact(F.array(*fired))).otherwise(hits)
    own = source.where(~is_noise(F.col("line"), F.col("language")))
    met = own.select("path", "line_no", "language", "line", F.explode_outer(hits).alias("rule")).where("rule is not null").join(rules, "rule")
    known = F.broadcast(migrations(source.sparkSession).select("algorithm", "replacement", "effort"))
    met = met.join(known, "algorithm", "left")
    return met.select("path", "line_no", "language", "rule_id", "severity", "quantum_threat", "category", "algorithm", "description", F.coalesce("replacement", "replacement_algo").alias("replacement_algo"), F.coalesce("effort", "migration_effort").alias("migration_effort"), trimmed(F.col("line")).alias("code_snippet"), F.lit(0.85).alias("confidence"))


def first_rule(line: Column, patterns: list[str]) -> Column:
    """The index of the first pattern that the line matches; null without one. [B8, B9, B12]

    Literal expressions in one ``coalesce`` are compiled once and stop at the
    first match, without a join.
    """
    return F.coalesce(*[F.when(line.rlike(portable_regex(p)), F.lit(i)) for i, p in enumerate(patterns)])


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(i, r[1], r[2], r[3], CATEGORY_ORDINALS[r[4]], r[5], r[6], r[7]) for i, r in enumerate(rules)]
    return F.broadcast(spark.createDataFrame(rows, "rule int, algorithm string, severity int, quantum_threat int, category int, rule_id string, description string, replacement_algo string"))


_OUT = ("path", "line_no", "rule_id", "algorithm", "severity", "quantum_threat", "category", "key_size", "replacement_algo", "confidence")

JAVA_ASSIGN = r'(?:String|var)\s+(\w+)\s*=\s*(?:.*\.getProperty\(|.*\.get\(|)"?(DES(?:ede)?|RSA|MD[25]|SHA-?1|AES|Blowfish|RC4|EC|DSA|DH)"?'
JAVA_USE = r"(?:Cipher|MessageDigest|KeyPairGenerator|KeyGenerator|Signature|KeyAgreement)\.getInstance\((\w+)"
JAVA_SIZE = r"\.initialize\((\d+)\)"


def value_at(rows: DataFrame, assigned: Column, value: Column, used: Column) -> DataFrame:
    """As-of lookup: for rows that use a variable, the last value assigned to it at or before the line. [B10, B13, C7]

    Assignments and uses of a variable meet in one partition of (path, name);
    the last value so far is a running window over their order.
    """
    sets = rows.where(assigned != "").select("path", assigned.alias("name"), "line_no", F.lit(0).alias("use"), value.alias("value"))
    uses = rows.where(used != "").select("path", used.alias("name"), "line_no", F.lit(1).alias("use"), F.lit(None).cast("string").alias("value"))
    w = Window.partitionBy("path", "name").orderBy("line_no", "use").rowsBetween(Window.unboundedPreceding, 0)
    met = sets.unionByName(uses).withColumn("value", F.last("value", ignorenulls=True).over(w))
    return met.where("use = 1 and value is not null").select("path", "name", "line_no", "value")


def java_findings(source: DataFrame) -> DataFrame:
    """Java: first rule by line, algorithm variables, and key sizes from nearby calls. [B9, B10, B11]"""
    spark, t = source.sparkSession, trimmed(F.col("line"))
    code = source.where(~(t.startswith("//") | t.startswith("/*") | t.startswith("*") | t.startswith("import ")))
    direct = code.withColumn("rule", first_rule(F.col("line"), [r[0] for r in JAVA_RULES])).where("rule is not null").join(_rule_table(spark, JAVA_RULES), "rule")
    direct = direct.select("path", "line_no", "rule_id", "algorithm", "severity", "quantum_threat", "category", "replacement_algo", F.lit(0.93).alias("confidence"))
    part = lambda regex, i: F.regexp_extract("line", regex, i)
    v = F.col("value")
    shor, digest = v.isin("RSA", "EC", "DSA", "DH"), v.isin("MD5", "MD2") | v.contains("SHA")
    tainted = value_at(code, part(JAVA_ASSIGN, 1), part(JAVA_ASSIGN, 2), part(JAVA_USE, 1)).select(
        "path", "line_no", F.lit("QS-JAVA-TAINT-001").alias("rule_id"), v.alias("algorithm"),
        F.when(shor | v.isin("DES", "DESede"), 0).otherwise(1).alias("severity"), F.when(shor, 0).otherwise(1).alias("quantum_threat"),
        F.when(shor, 0).when(digest, 4).otherwise(3).alias("category"), F.when(shor, "ML-KEM-768").when(digest, "SHA-256").otherwise("AES-256").alias("replacement_algo"), F.lit(0.85).alias("confidence"),
    )
    found = direct.unionByName(tainted)
    return with_nearby_size(found, source.select("path", "line_no", part(JAVA_SIZE, 1).alias("size")).where("size <> ''")).select(*_OUT)


def with_nearby_size(found: DataFrame, sizes: DataFrame, reach: int = 4) -> DataFrame:
    """Bounded range join: each size goes to the latest finding of its file within ``reach`` lines above. [B11, C8]

    The range is exploded to its few lines, so the join is an equi-join.
    """
    near = sizes.select("path", F.col("line_no").alias("at"), F.col("size").cast("int").alias("n"), F.explode(F.sequence(F.col("line_no") - reach, "line_no")).alias("line_no")).where("n > 0")
    met = near.join(found, ["path", "line_no"]).withColumn("k", F.row_number().over(Window.partitionBy("path", "at").orderBy(F.desc("line_no"), "confidence")))
    sized = met.where("k = 1").groupBy("path", "line_no", "rule_id").agg(F.max_by("n", "at").alias("key_size"), F.min_by("n", "at").alias("first_size"))
    out = found.join(sized, ["path", "line_no", "rule_id"], "left")
    named = F.when(F.col("key_size").isNotNull() & F.col("algorithm").isin("RSA", "DSA", "DH"), F.concat_ws("-", "algorithm", F.col("first_size").cast("string"))).otherwise(F.col("algorithm"))
    return out.withColumn("algorithm", named).withColumn("key_size", F.coalesce("key_size", F.lit(0)))


JS_ASSIGN = r"""(?:const|let|var)\s+(\w+)\s*=\s*['"](\w[\w-]*)['"]\s*;?"""
JS_SIZES = (r"modulusLength\s*:\s*(\d+)", r"new\s+NodeRSA\(\s*\{[^}]*b\s*:\s*(\d+)", r"forge\.pki\.rsa\.generateKeyPair\(\s*\{[^}]*bits\s*:\s*(\d+)")
JS_DH_SIZE = r"crypto\.createDiffieHellman\(\s*(\d+)\s*\)"
JS_CURVE = r"""namedCurve\s*:\s*['"]([^'"]+)['"]"""
JS_HASH, JS_CIPHER = r"crypto\.createHash\(\s*(\w+)\s*\)", r"crypto\.createCipher(?:iv)?\(\s*(\w+)\s*,"


def js_findings(source: DataFrame) -> DataFrame:
    """JavaScript: first rule by line, sizes and curves from the line and three below, weak algorithms by variable. [B12, B13, E11]"""
    spark, t = source.sparkSession, trimmed(F.col("line"))
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, 3)
    code = source.withColumn("block", F.array_join(F.collect_list("line").over(ahead), " ")).where(~(t.startswith("//") | t.startswith("/*") | t.startswith("*")))
    ruled = code.withColumn("rule", first_rule(F.col("line"), [r[0] for r in JS_RULES]))
    direct = ruled.where("rule is not null").join(_rule_table(spark, JS_RULES), "rule")
    number = lambda regex: F.nullif(F.regexp_extract("block", regex, 1).try_cast("int"), F.lit(0))
    rsa = F.col("rule_id").contains("RSA") | F.col("algorithm").contains("RSA")
    dh = F.col("rule_id").contains("DH-001")
    ec = F.col("rule_id").contains("ECDSA") | F.col("rule_id").contains("ECDH")
    size = F.when(rsa, F.coalesce(*[number(r) for r in reversed(JS_SIZES)])).when(dh, number(JS_DH_SIZE))
    curve = F.when(~rsa & ~dh & ec, F.nullif(F.regexp_extract("block", JS_CURVE, 1), F.lit("")))
    named = F.when(size.isNotNull(), F.concat(F.when(rsa, "RSA-").otherwise("DH-"), size.cast("string"))).when(curve.isNotNull(), F.concat_ws("-", "algorithm", curve)).otherwise(F.col("algorithm"))
    direct = direct.withColumn("key_size", F.coalesce(size, F.lit(0))).withColumn("algorithm", named).withColumn("confidence", F.lit(0.92)).select(*_OUT)
    free = ruled.where("rule is null").select("path", "line_no")
    part = lambda regex, i: F.regexp_extract("line", regex, i)
    low = F.lower("value")

    def by_variable(use, weak, rule, algorithm, category, replacement):
        met = value_at(code, part(JS_ASSIGN, 1), part(JS_ASSIGN, 2), part(use, 1)).where(weak).join(free, ["path", "line_no"], "left_semi")
        return met.select("path", "line_no", F.lit(rule).alias("rule_id"), algorithm.alias("algorithm"), F.lit(1).alias("severity"), F.lit(1).alias("quantum_threat"), F.lit(category).alias("category"), F.lit(0).alias("key_size"), F.lit(replacement).alias("replacement_algo"), F.lit(0.83).alias("confidence"))

    hashes = by_variable(JS_HASH, low.isin("md5", "sha1", "sha-1", "md4"), "QS-JS-TAINT-001", F.upper("value"), 4, "SHA-256")
    ciphers = by_variable(JS_CIPHER, low.contains("des") | low.contains("rc4") | low.contains("bf-"), "QS-JS-TAINT-002", F.col("value"), 3, "AES-256-GCM")
    return direct.unionByName(hashes).unionByName(ciphers)


RESOURCE = r'resource\s+"(\w+)"\s+"(\w+)"\s*\{'


def terraform_blocks(source: DataFrame) -> DataFrame:
    """Lines of Terraform files with the resource block they are in (null outside). [B14, E12]

    Blocks are numbered by a running count of their first lines; the running
    brace depth, and whether it has reached 0, are windows over one block.
    """
    t = trimmed(F.col("line"))
    code = source.withColumn("t", t).where(~(F.col("t").startswith("#") | F.col("t").startswith("//")))
    kind = F.regexp_extract("t", RESOURCE, 1)
    braces = F.length(F.regexp_replace("t", r"[^{]", "")) - F.length(F.regexp_replace("t", r"[^}]", ""))
    by_file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    code = code.withColumn("starts", kind != "").withColumn("block", F.sum(F.col("starts").cast("int")).over(by_file))
    code = code.withColumn("depth", F.sum(F.when(F.col("starts"), 1).otherwise(braces)).over(by_block))
    code = code.withColumn("least", F.min("depth").over(by_block)).withColumn("type", F.first(F.nullif(kind, F.lit(""))).over(by_block))
    inside = (F.col("block") > 0) & (F.col("least") > 0)
    closing = (F.col("block") > 0) & (F.col("depth") <= 0) & (F.coalesce(F.lag("least").over(Window.partitionBy("path", "block").orderBy("line_no")), F.lit(1)) > 0)
    return code.select("path", "line_no", "t", "starts", F.when(inside, F.col("type")).alias("type"), F.when(inside, F.col("depth")).alias("depth"), closing.alias("closing"))


def digits(c: Column) -> Column:
    """All digits of a string as one number; 0 without any. [H5]"""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(0))


def terraform_findings(source: DataFrame) -> DataFrame:
    """Terraform: rules of the enclosing resource, first match by line. [B14]"""
    rows = terraform_blocks(source).where("not starts and not closing")
    cases = [F.when(((F.col("type") == r[0]) | F.col("t").rlike(rf'resource\s+"{r[0]}"')) & F.col("t").rlike(r[1]), F.struct(F.lit(i).alias("rule"), F.regexp_extract("t", r[1], 1).alias("got"))) for i, r in enumerate(TERRAFORM_RULES)]
    hit = rows.withColumn("hit", F.coalesce(*cases)).where("hit is not null").select("path", "line_no", "hit.rule", "hit.got")
    met = hit.join(_rule_table(source.sparkSession, [r[1:] for r in TERRAFORM_RULES]), "rule")
    g = F.col("got")
    rsa, ecc, elb, plain = g.startswith("RSA_"), g.startswith("ECC_"), g.startswith("ELB"), g.isin("RSA", "ECDSA")
    named = F.when(rsa, F.concat(F.lit("RSA-"), F.expr("substring(got, 5)"))).when(ecc, F.concat(F.lit("EC-"), g)).when(elb | plain, g).otherwise(F.col("algorithm"))
    size = F.when(rsa | ~(ecc | elb | plain), digits(g)).otherwise(0)
    return met.select("path", "line_no", "rule_id", named.alias("algorithm"), "severity", "quantum_threat", "category", size.alias("key_size"), "replacement_algo", F.lit(0.90).alias("confidence"))


def kubernetes_findings(source: DataFrame) -> DataFrame:
    """Kubernetes manifests: first rule by line, sizes from the match. [B15]"""
    rows = source.where(~trimmed(F.col("line")).startswith("#"))
    patterns = [portable_regex(r[0]) for r in KUBERNETES_RULES]
    groups = [1 if "(2048" in r[0] or "(1" in r[0] else 0 for r in KUBERNETES_RULES]
    hit = rows.withColumn("rule", first_rule(F.col("line"), [r[0] for r in KUBERNETES_RULES])).where("rule is not null")
    got = F.coalesce(*[F.when(F.col("rule") == i, F.regexp_extract("line", p, 1)) for i, (p, g) in enumerate(zip(patterns, groups)) if g], F.lit(""))
    met = hit.withColumn("key_size", digits(got)).join(_rule_table(source.sparkSession, KUBERNETES_RULES), "rule")
    named = F.when((F.col("algorithm") == "RSA") & (F.col("key_size") > 0), F.concat(F.lit("RSA-"), F.col("key_size").cast("string"))).otherwise(F.col("algorithm"))
    return met.withColumn("algorithm", named).withColumn("confidence", F.lit(0.88)).select(*_OUT)


# What a diff line mentions, and post-quantum mentions that exempt it.
CRYPTO_PATTERNS = (r"\brsa\b", r"\becdsa\b", r"\becdh\b", r"\bmd5\b", r"\bsha1\b", r"\bsha-1\b", r"\baes\b", r"\bdes\b", r"\brc4\b", r"\btls\.", r"crypto/", r"crypto\.", r"\bGenerateKey\b", r"\bNewCipher\b", r"\bhashlib\b", r"\bMessageDigest\b", r"\bKeyPairGenerator\b")
PQC_PATTERNS = (r"\bmlkem\b", r"\bml-kem\b", r"\bmldsa\b", r"\bml-dsa\b", r"\bdilithium\b", r"\bkyber", r"\bpost.quantum\b", r"\bpqc\b")


def classify_diffs(diffs: DataFrame) -> DataFrame:
    """What each commit's diff does: introduces_safe, fixes_vuln, introduces_vuln, no_crypto_change. [B21]"""
    rows = diffs.select("sha", F.explode(F.split("diff", "\n")).alias("line"))
    meta = F.col("line").rlike(r"^(?:diff |index |--- |\+\+\+ |@@)")
    any_of = lambda ps: F.col("body").rlike(portable_regex("(?i)(?:" + "|".join(ps) + ")"))
    rows = rows.withColumn("body", F.expr("substring(line, 2)")).withColumn("sign", F.when(meta, "").otherwise(F.substring("line", 1, 1)))
    rows = rows.withColumn("pqc", any_of(PQC_PATTERNS)).withColumn("vulnerable", any_of(CRYPTO_PATTERNS) & ~F.col("pqc"))
    plus, minus = F.col("sign") == "+", F.col("sign") == "-"
    out = rows.groupBy("sha").agg(F.bool_or(plus & F.col("pqc")).alias("safe"), F.bool_or(plus & F.col("vulnerable")).alias("added"), F.bool_or(minus & F.col("vulnerable")).alias("removed"))
    return out.select("sha", F.when(F.col("safe"), "introduces_safe").when(F.col("removed") & ~F.col("added"), "fixes_vuln").when(F.col("added"), "introduces_vuln").otherwise("no_crypto_change").alias("action"))


# Fixed values, by language in the order of precedence: (language, substring of the line, new lines, description, confidence).
FIXES = (
    ("go", "rsa.GenerateKey", ("\t// MIGRATION: Replace RSA-2048 with ML-KEM-768 (Post-Quantum)", "\t// See: https://pkg.go.dev/crypto/mlkem", "\t// Hybrid approach: use ML-KEM-768 for key encapsulation alongside RSA during transition", "\tdecapsulationKey, err := mlkem.GenerateKey768()"), "Replace RSA key generation with ML-KEM-768 post-quantum key encapsulation", 0.7),
    ("go", "ecdsa.GenerateKey", ("\t// MIGRATION: Replace ECDSA-P256 with ML-DSA-65 (Post-Quantum Dilithium)", "\t// Hybrid approach recommended during transition period", "\tprivateKey, err := mldsa.GenerateKey65()"), "Replace ECDSA key generation with ML-DSA-65 post-quantum digital signature", 0.7),
    ("go", "md5.New()", ("\th := sha256.New()",), "Replace MD5 with SHA-256 (quantum-resistant hash)", 0.95),
    ("go", "sha1.New()", ("\th := sha256.New()",), "Replace SHA-1 with SHA-256 (quantum-resistant hash)", 0.95),
    ("go", "tls.VersionTLS12", ("\ttls.VersionTLS13",), "Upgrade minimum TLS version from 1.2 to 1.3", 0.95),
    ("go", "cipher.NewCBCEncrypter", ("\t// MIGRATION: Replace AES-CBC with AES-GCM (authenticated encryption)", "\t// AES-GCM provides both confidentiality and integrity", "\tblock, err := aes.NewCipher(key)", "\taesGCM, err := cipher.NewGCM(block)"), "Replace AES-CBC with AES-GCM authenticated encryption", 0.5),
    ("go", "des.", ("\t// MIGRATION: Replace DES with AES-256-GCM", "\t// DES is broken; use AES-256-GCM for symmetric encryption", "\tblock, err := aes.NewCipher(key) // use 32-byte key for AES-256", "\taesGCM, err := cipher.NewGCM(block)"), "Replace DES with AES-256-GCM", 0.5),
    ("go", "rc4.", ("\t// MIGRATION: Replace RC4 with AES-256-GCM", "\t// RC4 is broken; use AES-256-GCM for symmetric encryption", "\tblock, err := aes.NewCipher(key) // use 32-byte key for AES-256", "\taesGCM, err := cipher.NewGCM(block)"), "Replace RC4 with AES-256-GCM", 0.5),
    ("python", "rsa.generate_private_key(", ("    # MIGRATION: Replace RSA with ML-KEM (Post-Quantum)", "    # Install: pip install pqcrypto", "    # Hybrid approach: use ML-KEM for key encapsulation alongside RSA during transition", "    # from pqcrypto.kem.kyber768 import generate_keypair", "    # public_key, secret_key = generate_keypair()"), "Replace RSA key generation with ML-KEM post-quantum key encapsulation", 0.7),
    ("python", "hashlib.md5(", ("    hashlib.sha256(",), "Replace MD5 with SHA-256", 0.95),
    ("python", "hashlib.sha1(", ("    hashlib.sha256(",), "Replace SHA-1 with SHA-256", 0.95),
    ("javascript", "crypto.generateKeyPairSync('rsa'", ("  // MIGRATION: Replace RSA with Post-Quantum Cryptography", "  // Consider using liboqs-node or crystals-kyber npm package", "  // Hybrid approach: use ML-KEM for key encapsulation alongside RSA during transition", "  // const { publicKey, privateKey } = kyber.keypair();"), "Replace RSA key generation with PQC migration path", 0.7),
    ("javascript", "crypto.createHash('md5')", ("  crypto.createHash('sha256')",), "Replace MD5 with SHA-256", 0.95),
    ("javascript", "crypto.createHash('sha1')", ("  crypto.createHash('sha256')",), "Replace SHA-1 with SHA-256", 0.95),
    ("java", 'KeyPairGenerator.getInstance("RSA")', ("        // MIGRATION: Replace RSA with ML-KEM (Post-Quantum)", "        // Use Bouncy Castle PQC provider: bcprov-lts8on", '        // KeyPairGenerator kpg = KeyPairGenerator.getInstance("ML-KEM", "BCPQC");', "        // kpg.initialize(MLKEMParameterSpec.ml_kem_768);"), "Replace RSA key generation with ML-KEM post-quantum key encapsulation", 0.7),
    ("java", 'MessageDigest.getInstance("MD5")', ('        MessageDigest.getInstance("SHA-256")',), "Replace MD5 with SHA-256", 0.95),
    ("java", 'MessageDigest.getInstance("SHA-1")', ('        MessageDigest.getInstance("SHA-256")',), "Replace SHA-1 with SHA-256", 0.95),
)


def fixes(source: DataFrame) -> DataFrame:
    """The first applicable fix of every line that has one, with a unified diff of three context lines. [B26]"""
    rule = F.coalesce(*[F.when((F.lower("language") == f[0]) & F.contains("line", F.lit(f[1])), F.lit(i)) for i, f in enumerate(FIXES)])
    by_file = Window.partitionBy("path").orderBy("line_no")
    rows = source.withColumns({"before": F.collect_list("line").over(by_file.rowsBetween(-3, -1)), "after": F.collect_list("line").over(by_file.rowsBetween(1, 3))})
    rows = rows.withColumn("fix", rule).where("fix is not null")
    table = F.broadcast(source.sparkSession.createDataFrame([(i, list(f[2]), f[3], f[4]) for i, f in enumerate(FIXES)], "fix int, new_lines array<string>, description string, confidence double"))
    rows = rows.join(table, "fix")
    signed = lambda c, sign: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    first, old = F.col("line_no") - F.size("before"), F.size("before") + F.size("after") + 1
    head = F.format_string("@@ -%d,%d +%d,%d @@", first, old, first, old - 1 + F.size("new_lines"))
    body = F.concat(F.array(F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), head), signed("before", " "), F.array(F.concat(F.lit("-"), "line")), signed("new_lines", "+"), signed("after", " "))
    return rows.select("path", "line_no", "language", "description", "confidence", F.array_join("new_lines", "\n").alias("replacement"), F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("diff"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fix_outcomes(source: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, line_no, status, new_line) of each fix (path, line_no, diff): whether it can still be applied. [B28]

    ``applied`` if the source line (path, line_no, line) equals the diff's first
    removed line, blanks around both aside: its first added line takes the
    place, indented as before. Otherwise ``no diff`` (null or empty), ``out of
    range`` (no such line), ``unparsed`` (nothing removed or nothing added) or
    ``changed``, tested in this order, and no new line.
    """
    rows = F.split(F.col("diff"), "\n")
    signed = lambda sign: F.get(F.filter(rows, lambda x: x.startswith(sign) & ~x.startswith(3 * sign)), F.lit(0)).substr(F.lit(2), F.length("diff"))
    met = fixes.select("path", "line_no", "diff").join(source.select("path", "line_no", "line"), ["path", "line_no"], "left")
    met = met.withColumns({"old": signed("-"), "new": signed("+")})
    status = F.when(F.coalesce(F.length("diff"), F.lit(0)) == 0, "no diff").when(F.col("line").isNull(), "out of range").when(F.col("old").isNull() | F.col("new").isNull(), "unparsed").when(_bare(F.col("line")) != _bare(F.col("old")), "changed").otherwise("applied")
    line = F.concat(F.regexp_extract("line", r"^[ \t]*", 0), _bare(F.col("new")))
    return met.withColumn("status", status).select("path", "line_no", "status", F.when(F.col("status") == "applied", line).alias("new_line"))


def apply_fixes(source: DataFrame, fixes: DataFrame) -> DataFrame:
    """``source`` with the lines of all fixes that can be applied; of several for a line, the smallest text. [B28]"""
    new = fix_outcomes(source, fixes).where("status = 'applied'").groupBy("path", "line_no").agg(F.min("new_line").alias("new_line"))
    return source.join(new, ["path", "line_no"], "left").withColumn("line", F.coalesce("new_line", "line")).drop("new_line").select(*source.columns)


def verify_fixtures(source: DataFrame) -> DataFrame:
    """(name, before_file, fixes, passed) of fixture files ``<name>_before.<go, py, java, js>``. [B27]

    A fixture passes if some line of it that names an algorithm gets a fix.
    Nothing is compiled.
    """
    file = F.regexp_extract("path", r"[^/]*$", 0)
    language = F.coalesce(*[F.when(F.col("path").endswith("_before" + e), F.lit(v)) for e, v in ((".go", "go"), (".py", "python"), (".java", "java"), (".js", "javascript"))])
    rows = source.select("path", "line_no", "line").withColumn("language", language).where("language is not null")
    low = F.lower("line")
    named = low.rlike("rsa|ecdsa|md5|sha-?1") | (low.contains("des") & ~low.contains("describe"))
    fixed = fixes(rows).select("path", "line_no", F.lit(True).alias("fixed"))
    out = rows.join(fixed, ["path", "line_no"], "left").groupBy("path").agg(F.count_if(F.col("fixed") & named).alias("fixes"))
    return out.select(F.regexp_replace(file, r"_before\.\w+$", "").alias("name"), file.alias("before_file"), "fixes", (F.col("fixes") > 0).alias("passed"))


def context(findings: DataFrame, source: DataFrame, n: int = 2) -> DataFrame:
    """Source lines within ``n`` of each finding (path, line_no). [E18]"""
    near = findings.select("path", F.col("line_no").alias("at"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no")).distinct()
    return near.join(source.select("path", "line_no", "line"), ["path", "line_no"])
