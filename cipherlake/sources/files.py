"""Files as rows: recursive walks, text, binary sniffing, audits exported by other tools, stored scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cipherlake.functions.labels import basename, extension

# Directories that are never entered, languages by extension, and names of configuration files.
PRUNED = ("vendor", "node_modules", ".git", ".svn", "dist", "build", "__pycache__", ".tox", ".venv", "venv", "target")
LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".java": "java", ".yaml": "config", ".yml": "config", ".toml": "config", ".conf": "config", ".cfg": "config", ".ini": "config"}
CONFIG_NAMES = ("nginx.conf", "sshd_config", "ssh_config", "apache.conf", "httpd.conf", "docker-compose.yml")
CERTIFICATE_EXTENSIONS = (".pem", ".crt", ".cer", ".der")
MARKER = b"BEGIN CERTIFICATE"


def language_of(path: Column) -> Column:
    """Language by extension, else config by name, else null. [A1, A2]"""
    by_ext = F.coalesce(*[F.when(extension(path) == e, F.lit(v)) for e, v in LANGUAGES.items()])
    return F.coalesce(by_ext, F.when(F.lower(basename(path)).isin(*CONFIG_NAMES), F.lit("config")))


def walk(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, language) of the files that a scan reads; a language filter never drops config. [A1]

    The content is not selected, so it is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    kept = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (*PRUNED, *exclude)]))).withColumn("language", language_of(F.col("path"))).where("language is not null")
    if languages:
        kept = kept.where(F.col("language").isin("config", *languages))
    return kept.select("path", "length", "language")


def texts(spark: SparkSession, root: str, **how) -> DataFrame:
    """(path, language, content) of the files of ``walk``. [A3]"""
    wanted = walk(spark, root, **how)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.decode("content", "utf-8").alias("content"))
    return wanted.select("path", "language").join(files, "path")


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 bytes; null and empty are not binary. [A4]"""
    return F.coalesce(F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00"), F.lit(False))


def certificate_files(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(path, content) of certificate files, and of sources that hold a certificate. [A5, A8]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most:
        files = files.where(F.col("length") <= most)
    certificate = F.lower(extension(F.col("path"))).isin(*CERTIFICATE_EXTENSIONS)
    return files.where(certificate | (language_of(F.col("path")).isNotNull() & F.contains("content", F.lit(MARKER)))).select("path", "content")


def entropy_files(spark: SparkSession, root: str, most: int = 10 << 20) -> DataFrame:
    """(id, data) of files from 1 byte to ``most``; lengths are pushed to the listing. [A19]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where((F.col("length") > 0) & (F.col("length") <= most))
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in (".git", "node_modules", "vendor")]))).select(F.col("path").alias("id"), F.col("content").alias("data"))


def commits(exported: DataFrame) -> DataFrame:
    """(sha, author, ts, files, diff) of exported log rows ``sha|author|date`` with files and diff; only scannable files stay. [A14, A15, B22]"""
    part = F.split("head", r"\|")
    scannable = F.array(*[F.lit(e) for e in (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".conf", ".yaml", ".yml", ".toml", ".pem", ".crt", ".cer", ".tf")])
    return exported.select(F.get(part, F.lit(0)).alias("sha"), F.get(part, F.lit(1)).alias("author"), F.get(part, F.lit(2)).try_cast("timestamp").alias("ts"), F.filter("files", lambda f: F.array_contains(scannable, F.lower(F.regexp_extract(f, r"(\.[^./]*)$", 1)))).alias("files"), "diff")


def tls_probes(captured: DataFrame) -> DataFrame:
    """Endpoint fields of captured handshake text (endpoint, output); empty where the text has none, a null size. [A20]"""
    at = lambda p: F.regexp_extract("output", p, 1)
    line = lambda p: F.trim(at(p))
    return captured.select("endpoint", at(r"Cipher\s*(?:is|:)\s*(\S+)").alias("cipher_suite"), at(r"Protocol\s*:\s*(\S+)").alias("tls_version"), at(r"Server public key is (\d+) bit").try_cast("int").alias("key_size"), at(r"Peer signing digest: (\S+)").alias("signing_digest"), at(r"Peer signature type: (\S+)").alias("signature"), line(r"subject=([^\r\n]+)").alias("subject"), line(r"issuer=([^\r\n]+)").alias("issuer"))


def kms_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key_id, spec) of exported key descriptions, whichever of two names the spec has. [A21]"""
    raw = spark.read.schema("KeyId string, KeySpec string, CustomerMasterKeySpec string").json(path)
    return raw.select(F.col("KeyId").alias("key_id"), F.coalesce(F.nullif("KeySpec", F.lit("")), "CustomerMasterKeySpec").alias("spec"))


def cloud_keys(described: DataFrame) -> DataFrame:
    """(provider, key_id, spec, usage, state) of rows (provider, json): described keys of aws, gcp and azure. [A21]

    An azure spec is the key type, with the curve where there is one. Fields
    that a description lacks are null, but gcp and azure keys count as enabled.
    Other providers and broken JSON have no key id.
    """
    at = lambda p: F.get_json_object("json", p)
    by = lambda aws, gcp, azure: F.when(F.col("provider") == "aws", aws).when(F.col("provider") == "gcp", gcp).when(F.col("provider") == "azure", azure)
    aws = F.coalesce(F.nullif(at("$.KeyMetadata.KeySpec"), F.lit("")), at("$.KeyMetadata.CustomerMasterKeySpec"))
    azure = F.concat(at("$.key.kty"), F.coalesce(F.concat(F.lit("-"), F.nullif(at("$.key.crv"), F.lit(""))), F.lit("")))
    usage = F.array_join(F.from_json(at("$.key.key_ops"), "array<string>"), ",")
    return described.select(
        "provider", by(at("$.KeyMetadata.KeyId"), at("$.name"), F.coalesce(at("$.key.kid"), at("$.kid"))).alias("key_id"), by(aws, at("$.versionTemplate.algorithm"), azure).alias("spec"),
        by(at("$.KeyMetadata.KeyUsage"), at("$.purpose"), usage).alias("usage"), by(at("$.KeyMetadata.KeyState"), F.lit("ENABLED"), F.lit("Enabled")).alias("state"),
    )


def stored_scans(spark: SparkSession, path: str) -> DataFrame:
    """A store written by ``sinks.save_scans``. [A22]"""
    return spark.read.parquet(path)


def stored_scans_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The same from a database; filters and columns are pushed to it. [A23]"""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def baseline(spark: SparkSession, path: str, schema) -> DataFrame:
    """A baseline written by ``sinks.save_baseline``; empty where there is none. [A25]"""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
