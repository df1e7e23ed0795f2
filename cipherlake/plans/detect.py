"""Queries on source lines: rules, context, blocks, diffs and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.functions.fixed_rules import JAVA_RULES, JS_RULES, KUBERNETES_RULES, TERRAFORM_RULES, TEXT_RULES
from cipherlake.functions.labels import CATEGORY_ORDINALS
from cipherlake.operators import detect as D
from cipherlake.sources import samples
from cipherlake.sources.bridge import table


def _t(text: str) -> str:
    """A SQL literal; control characters are spelled out."""
    out = "'" + text.replace("'", "''") + "'"
    for c in "\n\t":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return out


def lines_of(s, *suffixes):
    rows = D.lines(samples.files(s))
    return rows.where(F.col("path").rlike("(?:" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$")) if suffixes else rows


def edited(s):
    """The sample lines after an edit: JavaScript lines have grown, Python's odd lines are gone."""
    rows = lines_of(s).withColumn("line", F.when(F.col("path").endswith(".js"), F.concat("line", F.lit(" // edited"))).otherwise(F.col("line")))
    return rows.where(~F.col("path").endswith(".py") | (F.col("line_no") % 2 == 0))


def lines_cte(*suffixes) -> str:
    rows = [(p, lang, i, line) for p, (lang, text) in samples.FILES.items() if not suffixes or p.endswith(suffixes) for i, line in enumerate(text.split("\n"), 1)]
    return "l AS (SELECT *, trim(replace(line, chr(9), ' ')) AS t FROM (VALUES " + ", ".join(f"({_t(p)}, {_t(lang)}, {i}, {_t(line)})" for p, lang, i, line in rows) + ") AS v(path, language, line_no, line))"


_NOISE = "(t = '' OR starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR starts_with(t, '#') OR ((starts_with(t, '\"crypto/') OR starts_with(t, 'import ') OR (language = 'python' AND (starts_with(t, 'from ') OR starts_with(t, 'import ')))) AND NOT contains(t, '(')))"


def _groups():
    sev, thr = {"critical": 0, "high": 1, "medium": 2}, {"broken_by_shor": 0, "weakened_by_grover": 1}
    return [(r[0], g[0], sev.get(r[2], 3), thr.get(r[3], 2), CATEGORY_ORDINALS.get(r[4], 0), "|".join(f"(?:{p})" for p in g[2])) for r in TEXT_RULES for g in r[7]]


_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{lang}', {s}, {t}, {c}, {_t(rx)})" for a, lang, s, t, c, rx in _groups()) + ") AS v(rule_id, rule_language, severity, quantum_threat, category, regex))"


def _first(rules, column="line", at=0):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_t(r[at])}) THEN {i}" for i, r in enumerate(rules)) + " END"


def _table(name, rules):
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_t(r[1])}, {r[2]}, {r[3]}, {CATEGORY_ORDINALS[r[4]]}, {_t(r[5])})" for i, r in enumerate(rules)) + ") AS v(rule, algorithm, severity, quantum_threat, category, rule_id))"


def _x(column, regex, group=1):
    return f"regexp_extract({column}, {_t(regex)}, {group})"


_JAVA = f"""WITH {lines_cte('.java')}, {_table('r', JAVA_RULES)},
code AS (SELECT * FROM l WHERE NOT (starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR starts_with(t, 'import '))),
direct AS (SELECT path, line_no, rule_id, algorithm, severity, quantum_threat, category, CAST(0.93 AS DOUBLE) AS confidence FROM (SELECT *, {_first(JAVA_RULES)} AS rule FROM code) JOIN r USING (rule)),
sets AS (SELECT path, {_x('line', D.JAVA_ASSIGN)} AS name, line_no, {_x('line', D.JAVA_ASSIGN, 2)} AS value FROM code WHERE regexp_matches(line, {_t(D.JAVA_ASSIGN)})),
uses AS (SELECT path, {_x('line', D.JAVA_USE)} AS name, line_no FROM code WHERE regexp_matches(line, {_t(D.JAVA_USE)})),
met AS (SELECT u.path, u.line_no, s.value FROM uses u ASOF JOIN sets s ON u.path = s.path AND u.name = s.name AND u.line_no >= s.line_no),
tainted AS (SELECT path, line_no, 'QS-JAVA-TAINT-001' AS rule_id, value AS algorithm, CASE WHEN value IN ('RSA', 'EC', 'DSA', 'DH', 'DES', 'DESede') THEN 0 ELSE 1 END AS severity, CASE WHEN value IN ('RSA', 'EC', 'DSA', 'DH') THEN 0 ELSE 1 END AS quantum_threat,
  CASE WHEN value IN ('RSA', 'EC', 'DSA', 'DH') THEN 0 WHEN value IN ('MD5', 'MD2') OR contains(value, 'SHA') THEN 4 ELSE 3 END AS category, CAST(0.85 AS DOUBLE) AS confidence FROM met),
found AS (SELECT * FROM direct UNION ALL SELECT * FROM tainted),
sizes AS (SELECT path, line_no AS at_line, CAST({_x('line', D.JAVA_SIZE)} AS INT) AS n FROM l WHERE regexp_matches(line, {_t(D.JAVA_SIZE)})),
near AS (SELECT s.path, s.at_line, s.n, f.line_no, f.rule_id, row_number() OVER (PARTITION BY s.path, s.at_line ORDER BY f.line_no DESC, f.confidence) AS k FROM sizes s JOIN found f ON f.path = s.path AND s.at_line - f.line_no BETWEEN 0 AND 4),
sized AS (SELECT path, line_no, rule_id, arg_max(n, at_line) AS key_size, arg_min(n, at_line) AS first_size FROM near WHERE k = 1 GROUP BY 1, 2, 3)"""

_JS_SIZE = "CASE WHEN rsa THEN coalesce(" + ", ".join(f"nullif(TRY_CAST({_x('block', r)} AS INT), 0)" for r in reversed(D.JS_SIZES)) + f") WHEN dh THEN nullif(TRY_CAST({_x('block', D.JS_DH_SIZE)} AS INT), 0) END"
_JS = f"""WITH {lines_cte('.js')}, {_table('r', JS_RULES)},
ahead AS (SELECT *, array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), ' ') AS block FROM l),
code AS (SELECT *, {_first(JS_RULES)} AS rule FROM ahead WHERE NOT (starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*'))),
named AS (SELECT *, contains(rule_id, 'RSA') OR contains(algorithm, 'RSA') AS rsa, contains(rule_id, 'DH-001') AS dh, contains(rule_id, 'ECDSA') OR contains(rule_id, 'ECDH') AS ec FROM code JOIN r USING (rule)),
sized AS (SELECT *, {_JS_SIZE} AS size, CASE WHEN NOT rsa AND NOT dh AND ec THEN nullif({_x('block', D.JS_CURVE)}, '') END AS curve FROM named),
direct AS (SELECT path, line_no, rule_id, CASE WHEN size IS NOT NULL THEN CASE WHEN rsa THEN 'RSA-' ELSE 'DH-' END || size WHEN curve IS NOT NULL THEN algorithm || '-' || curve ELSE algorithm END AS algorithm, coalesce(size, 0) AS key_size FROM sized),
sets AS (SELECT path, {_x('line', D.JS_ASSIGN)} AS name, line_no, {_x('line', D.JS_ASSIGN, 2)} AS value FROM code WHERE regexp_matches(line, {_t(D.JS_ASSIGN)})),
uses AS (SELECT path, line_no, 1 AS kind, {_x('line', D.JS_HASH)} AS name FROM code WHERE rule IS NULL AND regexp_matches(line, {_t(D.JS_HASH)}) UNION ALL SELECT path, line_no, 2, {_x('line', D.JS_CIPHER)} FROM code WHERE rule IS NULL AND regexp_matches(line, {_t(D.JS_CIPHER)})),
met AS (SELECT u.path, u.line_no, u.kind, s.value, lower(s.value) AS low FROM uses u ASOF JOIN sets s ON u.path = s.path AND u.name = s.name AND u.line_no >= s.line_no)"""

_TF_HIT = "CASE " + " ".join(f"""WHEN (type = '{r[0]}' OR regexp_matches(t, {_t('resource' + chr(92) + 's+"' + r[0] + '"')})) AND regexp_matches(t, {_t(r[1])}) THEN {i}""" for i, r in enumerate(TERRAFORM_RULES)) + " END"
_TF_GOT = "CASE rule " + " ".join(f"WHEN {i} THEN {_x('t', r[1])}" for i, r in enumerate(TERRAFORM_RULES)) + " END"
_TF = f"""WITH {lines_cte('.tf')}, {_table('r', [r[1:] for r in TERRAFORM_RULES])},
code AS (SELECT *, {_x('t', D.RESOURCE)} AS kind, length(regexp_replace(t, '[^{{]', '', 'g')) - length(regexp_replace(t, '[^}}]', '', 'g')) AS d FROM l WHERE NOT (starts_with(t, '#') OR starts_with(t, '//'))),
b AS (SELECT *, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS block FROM code),
e AS (SELECT *, sum(CASE WHEN kind <> '' THEN 1 ELSE d END) OVER (PARTITION BY path, block ORDER BY line_no) AS depth, max(kind) OVER (PARTITION BY path, block) AS own FROM b),
m AS (SELECT *, min(depth) OVER (PARTITION BY path, block ORDER BY line_no) AS low, coalesce(min(depth) OVER (PARTITION BY path, block ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS low_before FROM e),
blocks AS (SELECT path, line_no, t, kind <> '' AS starts, CASE WHEN block > 0 AND low > 0 THEN own END AS type, CASE WHEN block > 0 AND low > 0 THEN CAST(depth AS BIGINT) END AS depth, block > 0 AND depth <= 0 AND low_before > 0 AS closing FROM m),
hit AS (SELECT *, {_TF_GOT} AS got FROM (SELECT *, {_TF_HIT} AS rule FROM blocks WHERE NOT starts AND NOT closing) WHERE rule IS NOT NULL)"""

_K8S_GOT = "CASE rule " + " ".join(f"WHEN {i} THEN {_x('line', r[0])}" for i, r in enumerate(KUBERNETES_RULES) if "(2048" in r[0] or "(1" in r[0]) + " ELSE '' END"
_DIGITS = "CASE WHEN regexp_replace({0}, '[^0-9]', '', 'g') = '' THEN 0 ELSE CAST(regexp_replace({0}, '[^0-9]', '', 'g') AS INT) END"
_ANY = lambda ps: _t("(?i)(?:" + "|".join(ps) + ")")

_FIX = "CASE " + " ".join(f"WHEN language = '{f[0]}' AND contains(line, {_t(f[1])}) THEN {i}" for i, f in enumerate(D.FIXES)) + " END"
_FIXES = f"""WITH {lines_cte()}, x AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_t(chr(10).join(f[2]))}, {len(f[2])}, {_t(f[3])}, CAST({f[4]} AS DOUBLE))" for i, f in enumerate(D.FIXES))}) AS v(fix, new, n, description, confidence)),
w AS (SELECT *, list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a, {_FIX} AS fix FROM l),
c AS (SELECT *, coalesce(b, []) AS bb, coalesce(a, []) AS aa FROM w JOIN x USING (fix))"""

QUERIES = {
    "q_scan_lines": (
        lambda s, d: D.lines(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))).groupBy("path").agg(F.max("line_no").alias("lines"), F.max(F.length("line")).alias("longest")),
        "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(list_max([length(x) for x in string_split(text, chr(10))]) AS INT) AS longest FROM documents",
    ),
    "q_noise_filter": (
        lambda s, d: lines_of(s).select("path", "line_no", D.is_noise(F.col("line"), F.col("language")).alias("noise")),
        f"WITH {lines_cte()} SELECT path, line_no, {_NOISE} AS noise FROM l",
    ),
    "q_rule_match": (
        lambda s, d: D.match_text_rules(lines_of(s)).select("path", "line_no", "rule_id", "severity", "quantum_threat", "category", "code_snippet"),
        f"WITH {lines_cte()}, {_RULES} SELECT path, line_no, rule_id, severity, quantum_threat, category, t AS code_snippet FROM l JOIN r ON l.language = rule_language AND regexp_matches(line, regex) WHERE NOT {_NOISE}",
    ),
    "q_rule_match_volume": (
        lambda s, d: D.match_text_rules(D.lines(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("python").alias("language"), F.concat("text", F.lit("\nhashlib.md5("), F.col("doc_id").cast("string"), F.lit(")")).alias("content")))).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths")),
        f"WITH l AS (SELECT path, 'python' AS language, unnest(string_split(content, chr(10))) AS line FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text || chr(10) || 'hashlib.md5(' || doc_id || ')' AS content FROM documents)), {_RULES} SELECT rule_id, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT *, trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) AS t FROM l) l JOIN r ON l.language = rule_language AND regexp_matches(line, regex) WHERE NOT {_NOISE} GROUP BY rule_id",
    ),
    "q_java_rules": (
        lambda s, d: D.java_findings(lines_of(s, ".java")).select("path", "line_no", "rule_id", "algorithm", "severity", "quantum_threat", "category", "key_size", "confidence"),
        f"{_JAVA} SELECT f.path, f.line_no, f.rule_id, CASE WHEN key_size IS NOT NULL AND algorithm IN ('RSA', 'DSA', 'DH') THEN algorithm || '-' || first_size ELSE algorithm END AS algorithm, severity, quantum_threat, category, coalesce(key_size, 0) AS key_size, confidence FROM found f LEFT JOIN sized s USING (path, line_no, rule_id)",
    ),
    "q_java_taint_asof": (
        lambda s, d: (lambda r: D.value_at(r, F.regexp_extract("line", D.JAVA_ASSIGN, 1), F.regexp_extract("line", D.JAVA_ASSIGN, 2), F.regexp_extract("line", D.JAVA_USE, 1)))(lines_of(s, ".java")).select("path", "line_no", "value"),
        f"{_JAVA} SELECT path, line_no, value FROM met",
    ),
    "q_java_keysize_range": (
        lambda s, d: D.java_findings(lines_of(s, ".java")).where("key_size > 0").select("path", "line_no", "key_size"),
        f"{_JAVA} SELECT path, line_no, key_size FROM sized",
    ),
    "q_js_rules": (
        lambda s, d: D.js_findings(lines_of(s, ".js")).select("path", "line_no", "rule_id", "algorithm", "key_size"),
        f"{_JS} SELECT * FROM direct UNION ALL SELECT path, line_no, 'QS-JS-TAINT-001', upper(value), 0 FROM met WHERE kind = 1 AND low IN ('md5', 'sha1', 'sha-1', 'md4') UNION ALL SELECT path, line_no, 'QS-JS-TAINT-002', value, 0 FROM met WHERE kind = 2 AND (contains(low, 'des') OR contains(low, 'rc4') OR contains(low, 'bf-'))",
    ),
    "q_js_lookahead": (
        lambda s, d: D.js_findings(lines_of(s, ".js")).where("key_size > 0").select("path", "line_no", "algorithm", "key_size"),
        f"{_JS} SELECT path, line_no, algorithm, key_size FROM direct WHERE key_size > 0",
    ),
    "q_tf_blocks": (lambda s, d: D.terraform_blocks(lines_of(s, ".tf")).select("path", "line_no", "starts", "type", F.col("depth").cast("long").alias("depth"), "closing"), f"{_TF} SELECT path, line_no, starts, type, depth, closing FROM blocks"),
    "q_tf_rules": (
        lambda s, d: D.terraform_findings(lines_of(s, ".tf")).select("path", "line_no", "rule_id", "algorithm", "severity", "category", "key_size"),
        f"{_TF} SELECT path, line_no, rule_id, CASE WHEN starts_with(got, 'RSA_') THEN 'RSA-' || substr(got, 5) WHEN starts_with(got, 'ECC_') THEN 'EC-' || got WHEN starts_with(got, 'ELB') OR got IN ('RSA', 'ECDSA') THEN got ELSE algorithm END AS algorithm, severity, category, CASE WHEN starts_with(got, 'ECC_') OR starts_with(got, 'ELB') OR got IN ('RSA', 'ECDSA') THEN 0 ELSE {_DIGITS.format('got')} END AS key_size FROM hit JOIN r USING (rule)",
    ),
    "q_k8s_rules": (
        lambda s, d: D.kubernetes_findings(lines_of(s, ".yaml")).select("path", "line_no", "rule_id", "algorithm", "key_size"),
        f"WITH {lines_cte('.yaml')}, {_table('r', KUBERNETES_RULES)}, h AS (SELECT *, {_K8S_GOT} AS got FROM (SELECT *, {_first(KUBERNETES_RULES)} AS rule FROM l WHERE NOT starts_with(t, '#')) WHERE rule IS NOT NULL), k AS (SELECT *, {_DIGITS.format('got')} AS key_size FROM h JOIN r USING (rule)) SELECT path, line_no, rule_id, CASE WHEN algorithm = 'RSA' AND key_size > 0 THEN 'RSA-' || key_size ELSE algorithm END AS algorithm, key_size FROM k",
    ),
    "q_diff_classify": (
        lambda s, d: D.classify_diffs(samples.diffs(s)),
        f"WITH x AS (SELECT sha, unnest(string_split(diff, chr(10))) AS line FROM (VALUES {', '.join(f'({_t(k)}, {_t(v)})' for k, v in samples.DIFFS.items())}) AS v(sha, diff)), y AS (SELECT sha, CASE WHEN regexp_matches(line, '^(?:diff |index |--- |\\+\\+\\+ |@@)') THEN '' ELSE left(line, 1) END AS sign, regexp_matches(substr(line, 2), {_ANY(D.PQC_PATTERNS)}) AS pqc, regexp_matches(substr(line, 2), {_ANY(D.CRYPTO_PATTERNS)}) AS crypto FROM x), z AS (SELECT sha, bool_or(sign = '+' AND pqc) AS safe, bool_or(sign = '+' AND crypto AND NOT pqc) AS added, bool_or(sign = '-' AND crypto AND NOT pqc) AS removed FROM y GROUP BY sha) SELECT sha, CASE WHEN safe THEN 'introduces_safe' WHEN removed AND NOT added THEN 'fixes_vuln' WHEN added THEN 'introduces_vuln' ELSE 'no_crypto_change' END AS action FROM z",
    ),
    "q_fix_strategy": (lambda s, d: D.fixes(lines_of(s)).select("path", "line_no", "description", "confidence"), f"{_FIXES} SELECT path, line_no, description, confidence FROM c"),
    "q_unified_diff": (
        lambda s, d: D.fixes(lines_of(s)).select("path", "line_no", "diff"),
        f"{_FIXES} SELECT path, line_no, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || (line_no - len(bb)) || ',' || (len(bb) + len(aa) + 1) || ' +' || (line_no - len(bb)) || ',' || (len(bb) + len(aa) + n) || ' @@' || chr(10) || array_to_string([' ' || z || chr(10) for z in bb], '') || '-' || line || chr(10) || array_to_string(['+' || z || chr(10) for z in string_split(new, chr(10))], '') || array_to_string([' ' || z || chr(10) for z in aa], '') AS diff FROM c",
    ),
    "q_fix_apply": (
        lambda s, d: D.fix_outcomes(edited(s), D.fixes(lines_of(s))),
        f"{_FIXES} SELECT path, line_no, CASE WHEN ends_with(path, '.py') AND line_no % 2 = 1 THEN 'out of range' WHEN ends_with(path, '.js') THEN 'changed' ELSE 'applied' END AS status, CASE WHEN ends_with(path, '.js') OR (ends_with(path, '.py') AND line_no % 2 = 1) THEN NULL ELSE regexp_extract(line, '^[ \\t]*') || regexp_replace(string_split(new, chr(10))[1], '^\\s+|\\s+$', '', 'g') END AS new_line FROM c",
    ),
    "q_fixed_source": (
        lambda s, d: D.apply_fixes(lines_of(s), D.fixes(lines_of(s))).select("path", "line_no", "line"),
        f"{_FIXES} SELECT l.path, l.line_no, CASE WHEN new IS NULL THEN l.line ELSE regexp_extract(l.line, '^[ \\t]*') || regexp_replace(string_split(new, chr(10))[1], '^\\s+|\\s+$', '', 'g') END AS line FROM l LEFT JOIN c USING (path, line_no)",
    ),
    "q_fixture_verify": (
        lambda s, d: D.verify_fixtures(lines_of(s).withColumn("path", F.regexp_replace("path", r"\.(\w+)$", r"_before.$1"))),
        f"{_FIXES}, g AS (SELECT l.path, count(*) FILTER (WHERE c.fix IS NOT NULL AND (regexp_matches(lower(l.line), 'rsa|ecdsa|md5|sha1|sha-1') OR (contains(lower(l.line), 'des') AND NOT contains(lower(l.line), 'describe')))) AS fixes FROM l LEFT JOIN c USING (path, line_no) WHERE regexp_matches(l.path, '\\.(go|py|java|js)$') GROUP BY 1) SELECT regexp_extract(path, '([^/.]*)\\.\\w+$', 1) AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.', '_before.') AS before_file, fixes, fixes > 0 AS passed FROM g",
    ),
    "q_source_context": (
        lambda s, d: D.context(D.fixes(lines_of(s)), lines_of(s)),
        f"{_FIXES} SELECT DISTINCT c.path, c.line_no AS at, l.line_no, l.line FROM c JOIN l ON l.path = c.path AND l.line_no BETWEEN c.line_no - 2 AND c.line_no + 2",
    ),
    "q_scan_pipeline": (
        lambda s, d: scan(s),
        f"WITH {lines_cte()}, {_RULES}, m AS (SELECT path, line_no, rule_id, severity, quantum_threat FROM l JOIN r ON l.language = rule_language AND regexp_matches(line, regex) WHERE NOT {_NOISE}) SELECT count(*) AS findings, count(DISTINCT path) AS files, round(least((count(*) FILTER (WHERE quantum_threat = 0) + count(*) FILTER (WHERE quantum_threat = 1) * CAST(0.4 AS DOUBLE)) / count(*) * 100, 100), 6) AS risk_score FROM (SELECT DISTINCT path, line_no, rule_id, quantum_threat FROM m)",
    ),
}


def scan(s):
    """The whole scan of the sample files: lines, rules, one finding per key, score."""
    from cipherlake.operators.relational import dedupe, risk

    found = D.match_text_rules(lines_of(s)).withColumnsRenamed({"path": "file_path", "line_no": "line_start"})
    best = dedupe(found, ties=("algorithm",))
    return risk(best).withColumn("findings", F.col("total")).crossJoin(best.agg(F.countDistinct("file_path").alias("files"))).select("findings", "files", "risk_score")
