"""Findings from parsed calls: Go, TLS configurations, Python, and taint along calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.storage import materialise

# Fixed values: (import path, function, algorithm, severity, category, threat, key size, usage).
GO_CALLS = (
    ("crypto/rsa", "GenerateKey", "RSA", 0, 0, 0, 0, "key-generation"),
    ("crypto/rsa", "EncryptOAEP", "RSA-OAEP", 0, 0, 0, 0, "encryption"),
    ("crypto/rsa", "DecryptOAEP", "RSA-OAEP", 0, 0, 0, 0, "decryption"),
    ("crypto/rsa", "EncryptPKCS1v15", "RSA-PKCS1v15", 0, 0, 0, 0, "encryption"),
    ("crypto/rsa", "DecryptPKCS1v15", "RSA-PKCS1v15", 0, 0, 0, 0, "decryption"),
    ("crypto/rsa", "SignPSS", "RSA-PSS", 0, 1, 0, 0, "signing"),
    ("crypto/rsa", "SignPKCS1v15", "RSA-PKCS1v15", 0, 1, 0, 0, "signing"),
    ("crypto/ecdsa", "GenerateKey", "ECDSA", 0, 1, 0, 0, "key-generation"),
    ("crypto/ecdsa", "Sign", "ECDSA", 0, 1, 0, 0, "signing"),
    ("crypto/ecdsa", "SignASN1", "ECDSA", 0, 1, 0, 0, "signing"),
    ("crypto/ecdsa", "Verify", "ECDSA", 0, 1, 0, 0, "verification"),
    ("crypto/ecdsa", "VerifyASN1", "ECDSA", 0, 1, 0, 0, "verification"),
    ("crypto/ecdh", "P256", "ECDH-P256", 0, 2, 0, 0, "key-exchange"),
    ("crypto/ecdh", "P384", "ECDH-P384", 0, 2, 0, 0, "key-exchange"),
    ("crypto/ecdh", "P521", "ECDH-P521", 0, 2, 0, 0, "key-exchange"),
    ("crypto/ecdh", "X25519", "ECDH-X25519", 1, 2, 0, 0, "key-exchange"),
    ("crypto/elliptic", "P256", "ECDSA-P256", 0, 1, 0, 0, "curve-instantiation"),
    ("crypto/elliptic", "P384", "ECDSA-P384", 0, 1, 0, 0, "curve-instantiation"),
    ("crypto/elliptic", "P521", "ECDSA-P521", 1, 1, 0, 0, "curve-instantiation"),
    ("crypto/aes", "NewCipher", "AES", 2, 3, 1, 0, "cipher-creation"),
    ("crypto/des", "NewTripleDESCipher", "3DES", 1, 3, 1, 168, "cipher-creation"),
    ("crypto/des", "NewCipher", "DES", 0, 3, 1, 56, "cipher-creation"),
    ("crypto/rc4", "NewCipher", "RC4", 0, 3, 1, 0, "cipher-creation"),
    ("crypto/md5", "New", "MD5", 1, 4, 1, 0, "hash-creation"),
    ("crypto/md5", "Sum", "MD5", 1, 4, 1, 0, "hashing"),
    ("crypto/sha1", "New", "SHA-1", 1, 4, 1, 0, "hash-creation"),
    ("crypto/sha1", "Sum", "SHA-1", 1, 4, 1, 0, "hashing"),
    ("crypto/hmac", "New", "HMAC", 1, 4, 1, 0, "mac-creation"),
    ("crypto/x509", "CreateCertificate", "X.509", 1, 7, 0, 0, "certificate-creation"),
)
_GO_KINDS = "import_path string, func string, algorithm string, severity int, category int, quantum_threat int, key_size int, usage string"

# Functions whose results, and literals that, name an algorithm; and functions that consume them.
TAINT_SOURCES = (
    ("rsa.GenerateKey", "RSA"), ("ecdsa.GenerateKey", "ECDSA"), ("ecdh.GenerateKey", "ECDH"), ("ecdh.P256", "ECDH-P256"), ("ecdh.P384", "ECDH-P384"), ("ecdh.X25519", "ECDH-X25519"),
    ("elliptic.P256", "ECDSA-P256"), ("elliptic.P384", "ECDSA-P384"), ("elliptic.P521", "ECDSA-P521"), ("aes.NewCipher", "AES"), ("des.NewCipher", "DES"), ("des.NewTripleDESCipher", "3DES"),
    ("rc4.NewCipher", "RC4"), ("md5.New", "MD5"), ("sha1.New", "SHA-1"), ("x509.CreateCertificate", "X.509"),
)
TAINT_LITERALS = (("DES", "DES"), ("DESede", "3DES"), ("3DES", "3DES"), ("RSA", "RSA"), ("DSA", "DSA"), ("MD5", "MD5"), ("MD2", "MD2"), ("SHA1", "SHA-1"), ("SHA-1", "SHA-1"), ("AES", "AES"), ("Blowfish", "Blowfish"), ("RC4", "RC4"))
TAINT_SINKS = ("cipher.NewGCM", "cipher.NewCBCEncrypter", "cipher.NewCBCDecrypter", "cipher.NewCFBEncrypter", "cipher.NewCFBDecrypter", "rsa.EncryptOAEP", "rsa.DecryptOAEP", "rsa.SignPSS", "rsa.SignPKCS1v15", "ecdsa.Sign", "ecdsa.SignASN1", "tls.NewListener", "tls.Dial", "x509.CreateCertificate", "hmac.New")
DECAY, DEPTH = 0.95, 5

# Fixed values, in the order of precedence: (functions, algorithm, severity, threat, category, rule id).
PYTHON_CALLS = (
    (("rsa.generate_private_key", "RSA.generate"), "RSA", 0, 0, 0, "QS-PY-RSA-001"),
    (("ec.generate_private_key",), "ECDSA", 0, 0, 1, "QS-PY-ECDSA-001"),
    (("dsa.generate_private_key",), "DSA", 0, 0, 1, "QS-PY-DSA-001"),
    (("dh.generate_parameters",), "DH", 0, 0, 2, "QS-PY-DH-001"),
    (("Fernet", "MultiFernet"), "AES-128 (Fernet)", 2, 1, 3, "QS-PY-FERNET-001"),
    (("hashlib.md5",), "MD5", 1, 1, 4, "QS-PY-MD5-001"),
    (("hashlib.sha1",), "SHA-1", 1, 1, 4, "QS-PY-SHA1-001"),
    (("RSA.generate", "RSA.construct"), "RSA", 0, 0, 0, "QS-PY-RSA-002"),
    (("DES.new", "DES3.new"), "DES", 0, 1, 3, "QS-PY-DES-001"),
    (("ARC4.new",), "RC4", 0, 1, 3, "QS-PY-RC4-001"),
)


def go_findings(code: DataFrame) -> DataFrame:
    """Go calls of weak functions, with key sizes from arguments and variables. [B5, B7]

    The rule table is broadcast and joined on (import path, function). AES sizes
    come from a literal ``make``, or from a variable of the function, or of the
    package, by two left joins.
    """
    rules = F.broadcast(code.sparkSession.createDataFrame(GO_CALLS, _GO_KINDS))
    calls = code.where("kind = 'call'").join(rules, ["import_path", "func"])
    made = r"^make\(\[\]byte,(\d+)"
    size = F.regexp_extract(F.get("args", F.lit(0)), made, 1).try_cast("int")
    sets = code.where("kind = 'assign'").select("path", "scope", F.get("targets", F.lit(0)).alias("var"), "line", F.regexp_extract(F.get("args", F.lit(0)), made, 1).try_cast("int").alias("n")).where("n is not null")
    last = sets.groupBy("path", "scope", "var").agg(F.max_by("n", "line").alias("n"))
    own = last.select("path", "scope", F.col("var").alias("v"), F.col("n").alias("n_own"))
    whole = last.where("scope = ''").select("path", F.col("var").alias("v"), F.col("n").alias("n_whole"))
    calls = calls.withColumn("v", F.get("args", F.lit(0))).join(own, ["path", "scope", "v"], "left").join(whole, ["path", "v"], "left")
    is_ = lambda p, f: (F.col("import_path") == p) & (F.col("func") == f)
    rsa, ecdsa, aes, hmac = is_("crypto/rsa", "GenerateKey"), is_("crypto/ecdsa", "GenerateKey"), is_("crypto/aes", "NewCipher"), F.col("import_path") == "crypto/hmac"
    bits = F.coalesce(F.get("args", F.lit(1)).try_cast("int"), F.lit(0))
    aes_bits = F.coalesce(size, "n_own", "n_whole", F.lit(0)) * 8
    key_size = F.when(rsa, bits).when(aes, aes_bits).otherwise(F.col("key_size"))
    curve = F.regexp_extract(F.get("args", F.lit(0)), r"^(?:elliptic|ecdh)\.(\w+)\(", 1)
    mac = F.when(F.get("args", F.lit(0)) == "sha1.New", "HMAC-SHA1").when(F.get("args", F.lit(0)) == "md5.New", "HMAC-MD5")
    name = F.when(rsa & (bits > 0), F.concat(F.lit("RSA-"), bits.cast("string"))).when(ecdsa & (curve != ""), F.concat(F.lit("ECDSA-"), curve)).when(aes & (aes_bits > 0), F.concat(F.lit("AES-"), aes_bits.cast("string"))).when(hmac, mac).otherwise(F.col("algorithm"))
    severity = F.when(rsa & (bits >= 4096), 1).when(aes & (aes_bits >= 192), 3).otherwise(F.col("severity"))
    out = calls.select("path", F.col("line").alias("line_no"), name.alias("algorithm"), severity.alias("severity"), "quantum_threat", "category", key_size.alias("key_size"), "usage", F.lit(0.95).alias("confidence"))
    return out.where("algorithm is not null").withColumn("rule_id", F.concat(F.lit("goast-"), F.lower(F.regexp_replace("algorithm", "[^A-Za-z0-9_-]", "-"))))


def tls_configurations(code: DataFrame) -> DataFrame:
    """TLS configuration literals: old versions, suites with classical key exchange, and those that set neither. [B6]"""
    rows = code.where("kind = 'literal' and import_path = 'crypto/tls' and func = 'Config'")
    rows = rows.withColumns({"version": F.try_element_at(F.filter("args", lambda a: a.startswith("MinVersion:")), F.lit(1)), "suites": F.try_element_at(F.filter("args", lambda a: a.startswith("CipherSuites:")), F.lit(1))})
    v = F.regexp_extract("version", r"\.(\w+)$", 1)
    what = F.when(F.col("version").isNull() & F.col("suites").isNull(), "TLS").when(v == "VersionTLS10", "TLS-1.0").when(v == "VersionTLS11", "TLS-1.1").when(v == "VersionTLS12", "TLS-1.2").when(F.col("suites").rlike("RSA|ECDHE"), "TLS-suites")
    severity = F.when(v.isin("VersionTLS10", "VersionTLS11"), 0).otherwise(1)
    return rows.select("path", F.col("line").alias("line_no"), what.alias("algorithm"), severity.alias("severity")).where("algorithm is not null")


def python_findings(code: DataFrame) -> DataFrame:
    """Python calls, the first rule that names the function; sizes from ``key_size`` or the first number. [B8]

    ``hashlib.new`` of a variable has the value that the variable is last given in its file.
    """
    name = F.col("name")
    rule = F.coalesce(*[F.when(name.isin(*fs), F.lit(i)) for i, (fs, *_) in enumerate(PYTHON_CALLS)], F.when(name.contains("paramiko") & name.contains("RSAKey"), F.lit(len(PYTHON_CALLS))))
    table = [(i, *r[1:]) for i, r in enumerate((*PYTHON_CALLS, ((), "SSH-RSA", 1, 0, 8, "QS-PY-SSH-RSA-001")))]
    rules = F.broadcast(code.sparkSession.createDataFrame(table, "rule int, algorithm string, severity int, quantum_threat int, category int, rule_id string"))
    calls = code.where("kind = 'call'").withColumn("rule", rule).where("rule is not null").join(rules, "rule")
    first = F.get("args", F.lit(0))
    by_name, by_place = F.try_element_at("kwargs", F.lit("key_size")).try_cast("int"), first.try_cast("int")
    size = F.coalesce(F.when(by_place.between(512, 16384), by_place), by_name, F.lit(0))
    curve = F.when(first.contains("SECP256R1") | first.contains("P256"), "ECDSA-P256").when(first.contains("SECP384R1") | first.contains("P384"), "ECDSA-P384")
    label = F.coalesce(curve, F.when(size > 0, F.concat_ws("-", "algorithm", size.cast("string"))), F.col("algorithm"))
    found = calls.select("path", F.col("line").alias("line_no"), "rule_id", label.alias("algorithm"), "severity", "quantum_threat", "category", size.alias("key_size"), F.lit(0.93).alias("confidence"))
    values = code.where("kind = 'assign'").groupBy("path", F.col("name").alias("variable")).agg(F.upper(F.regexp_extract(F.max_by(F.get("args", F.lit(0)), "line"), r'^"(.*)"$', 1)).alias("value")).where(F.col("value").isin("MD5", "SHA1", "SHA-1"))
    named = code.where("kind = 'call' and name = 'hashlib.new'").select("path", "line", F.get("args", F.lit(0)).alias("variable")).join(values, ["path", "variable"])
    weak = [F.lit(x).alias(c) for c, x in (("severity", 1), ("quantum_threat", 1), ("category", 4), ("key_size", 0), ("confidence", 0.85))]
    return found.unionByName(named.select("path", F.col("line").alias("line_no"), F.lit("QS-PY-TAINT-001").alias("rule_id"), F.col("value").alias("algorithm"), *weak))


def taint(code: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Values from weak functions or literals that reach a consuming call, through assignments and parameters. [B23, C9]

    Edges are (function, variable) to (function, variable): an assignment at no
    cost, a call's argument to the callee's parameter at one hop and
    ``DECAY`` of confidence. Reached states grow by joins, one hop at a time, and
    keep the best confidence of each (function, variable, algorithm).
    """
    spark = code.sparkSession
    fn = F.concat_ws(".", "pkg", "scope")
    ident = F.col("arg").rlike(r"^[A-Za-z_]\w*$")
    assigns = code.where("kind = 'assign' and scope <> ''").select(fn.alias("fn"), "path", "line", F.explode(F.arrays_zip(F.col("targets").alias("t"), F.col("args").alias("a"))).alias("p")).select("fn", "path", "line", F.col("p.t").alias("var"), F.col("p.a").alias("arg")).where("var is not null and arg is not null")
    sources = F.broadcast(spark.createDataFrame(TAINT_SOURCES, "call string, algorithm string"))
    literals = F.broadcast(spark.createDataFrame(TAINT_LITERALS, "text string, algorithm string"))
    from_call = assigns.withColumn("call", F.regexp_extract("arg", r"^(\w+\.\w+)\(", 1)).join(sources, "call").select("fn", "var", "algorithm", F.lit(0.95).alias("confidence"), F.lit(0).alias("hops"))
    from_text = assigns.withColumn("text", F.regexp_extract("arg", '^"([^"]*)"$', 1)).join(literals, "text").select("fn", "var", "algorithm", F.lit(0.90).alias("confidence"), F.lit(0).alias("hops"))
    calls = code.where("kind = 'call' and scope <> ''").select(fn.alias("fn"), "pkg", "path", "line", F.when(F.col("name") == "", F.concat_ws(".", "pkg", "func")).otherwise(F.concat_ws(".", "name", "func")).alias("callee"), F.posexplode("args").alias("place", "arg")).where(ident)
    parameters = code.where("kind = 'func'").select(F.concat_ws(".", "pkg", "name").alias("callee"), F.posexplode("args").alias("place", "to_var"))
    local = assigns.where(ident).select("fn", F.col("arg").alias("var"), F.col("fn").alias("to_fn"), F.col("var").alias("to_var"), F.lit(0).alias("hop"))
    passed = calls.join(parameters, ["callee", "place"]).select("fn", F.col("arg").alias("var"), F.col("callee").alias("to_fn"), "to_var", F.lit(1).alias("hop"))
    edges = materialise(local.union(passed).distinct(), "taint-edges")
    best = lambda df: df.groupBy("fn", "var", "algorithm").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops"))
    reached, mark = materialise(best(from_call.union(from_text)), "taint"), None
    # a copy within a function costs no hop, so rounds go on until nothing is new
    while mark != (mark := tuple(reached.agg(F.count("*"), F.sum(F.xxhash64("fn", "var", "algorithm", "confidence").cast("decimal(38,0)"))).first())):
        new = reached.join(edges, ["fn", "var"]).where(F.col("hops") + F.col("hop") <= depth)
        new = new.select(F.col("to_fn").alias("fn"), F.col("to_var").alias("var"), "algorithm", (F.col("confidence") * F.when(F.col("hop") == 1, DECAY).otherwise(1.0)).alias("confidence"), (F.col("hops") + F.col("hop")).alias("hops"))
        reached = materialise(best(reached.union(new)), "taint")
    met = calls.where(F.col("callee").isin(*TAINT_SINKS)).join(reached, (calls["fn"] == reached["fn"]) & (calls["arg"] == reached["var"]))
    out = met.groupBy("path", "line", "algorithm").agg(F.max("confidence").alias("confidence"), F.min("callee").alias("sink"))
    a = F.col("algorithm")
    weak = a.contains("MD5") | a.contains("SHA-1")
    severity = F.when(a.contains("AES"), 2).when(weak, 1).otherwise(0)
    threat = F.when(a.contains("AES") | weak | a.contains("DES") | a.contains("RC4"), 1).otherwise(0)
    category = F.when(a.contains("AES"), 3).when(weak, 4).when(a.contains("DES") | a.contains("RC4"), 3).otherwise(0)
    return out.select("path", F.col("line").alias("line_no"), "algorithm", severity.alias("severity"), threat.alias("quantum_threat"), category.alias("category"), F.round("confidence", 9).alias("confidence"), "sink")
