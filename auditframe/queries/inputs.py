"""Inputs of the registered queries, derived from the given tables.

Each text is SQL that Spark and the checking engine both accept; ``@@name``
stands for a given table. No string backslashes are used (``chr`` instead).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators.findings import make_findings

# Raw findings: null and bogus levels, back slashes, vendored, data and test
# files, missing lines. A third of all rows belongs to one repository.
FINDINGS_RAW = """
SELECT l_orderkey AS repo_key, CAST(l_linenumber AS INT) AS seq,
 CASE WHEN l_orderkey % 3 = 0 THEN 'repo0' ELSE CONCAT('repo', CAST(l_suppkey AS STRING)) END AS repo,
 CASE (l_suppkey + l_orderkey) % 6 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'eslint' WHEN 2 THEN 'bandit'
  WHEN 3 THEN 'gitleaks' WHEN 4 THEN 'trufflehog' ELSE 'npm-audit' END AS tool,
 CASE WHEN l_partkey % 40 = 7 THEN 'B101 (assert_used)' ELSE CONCAT('R', CAST(l_partkey % 40 AS STRING)) END AS rule_id,
 CASE CAST(l_quantity AS INT) % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'error' WHEN 3 THEN 'moderate'
  WHEN 4 THEN 'warn' WHEN 5 THEN ' info ' WHEN 6 THEN 'bogus' ELSE NULL END AS severity_raw,
 CASE l_partkey % 6 WHEN 0 THEN 'injection' WHEN 1 THEN 'secrets' WHEN 2 THEN 'dependency-cve' WHEN 3 THEN 'insecure-jwt'
  WHEN 4 THEN 'cors-misconfig' ELSE 'not-a-category' END AS category_raw,
 CONCAT(CASE l_partkey % 7 WHEN 0 THEN CONCAT('.', chr(92), 'src', chr(92)) WHEN 1 THEN 'node_modules/pkg/' WHEN 2 THEN 'data/raw/'
   WHEN 3 THEN 'tests/' WHEN 4 THEN 'src/legacy/' WHEN 5 THEN '.venv/lib/' ELSE './src/' END,
  CASE l_partkey % 13 WHEN 5 THEN 'test_f' WHEN 6 THEN 'conf/deep/f' WHEN 7 THEN 'test_data/f' ELSE 'f' END, CAST(l_partkey % 4 AS STRING),
  CASE l_linenumber % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.py' WHEN 2 THEN '.csv' ELSE '.test.ts' END) AS file_raw,
 CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_orderkey % 15 AS STRING) END AS line_raw,
 CASE (l_suppkey + l_partkey) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' ELSE 'unset' END AS confidence_raw,
 CONCAT(' issue ', CAST(l_partkey % 10 AS STRING), ' ') AS message_raw,
 (l_partkey % 3 = 0) AS ai_relevant
FROM @@lineitem
"""

# Source text, five files per repository out of 24 templates. ~ is a line
# break, ^ a digit, # the number of the file before.
_TEMPLATES = [
    ("src/", ".js", 'const express = require("express");~const app = express();~app.post("/admin/drop^", (req, res) => {~  res.send("x");~});~app.get("/health", (req, res) => { res.send("ok"); });'),
    ("src/", ".js", 'app.get("/admin/list^", requireAuth, handler);~app.post("/login", doLogin);'),
    ("src/", ".py", 'import subprocess~from flask import Blueprint, request~shop = Blueprint("shop", __name__)~@shop.route("/invoices/^")~@login_required~def invoice():~    number = request.args["number"]~    label = "print " + number~    subprocess.call(label)~    return "printed"'),
    ("src/", ".py", 'from flask import Flask~@app.post("/signup^")~def signup():~    return "ok"'),
    ("src/", ".js", 'const tls = { rejectUnauthorized: false };~// audit-disable-next-line~eval(req.body.x^);'),
    ("src/", ".py", 'DEBUG = True~requests.get(feed, verify=False)  # audit-disable-line insecure-transport~paper = request.form["paper"]~paper = shlex.quote(paper)~subprocess.run("lpr " + paper)'),
    ("src/", ".js", 'const helmet = require("helmet");~app.use(helmet());~app.use(authGuard);~app.post("/orders/^", save);'),
    ("src/", ".js", 'const cp = require("child_process");~export function runCmd(input) {~  const text = "run " + input;~  cp.exec(text);~}~export const idle = (x) => {~  return x;~};'),
    ("src/", ".js", 'import { runCmd } from "./m#";~export function handle(req) {~  const cmd = req.query.cmd;~  runCmd(cmd);~  runCmd("fixed^");~}'),
    ("src/", ".js", 'const stock = (req) => {~  const wanted = encodeURIComponent(req.query.item);~  db.query("SELECT amount FROM stock WHERE item = " + wanted);~  let shelf = req.query.shelf;~  shelf = Number(shelf);~  db.query("SELECT item FROM stock WHERE shelf = " + shelf);~  let page = req.body.page;~  page = ^;~  db.query("SELECT item FROM stock LIMIT " + page);~};'),
    ("src/", ".js", 'app.post("/webhook/stripe^", (req, res) => {~  save(req.body);~  res.sendStatus(200);~});'),
    ("src/", ".js", 'app.post("/webhook/github", (req, res) => {~  const sig = req.headers["x-hub-signature"];~  if (!check(sig)) { return; }~  save(req.body);~});~app.post("/callback^", async (req, res) => {~  save(req.body);~});'),
    ("src/", ".js", '// ruleid: af-insecure-cookie-httponly-false~res.cookie("sid", v, { httpOnly: false });~// ok: af-insecure-cookie-httponly-false~res.cookie("sid", v, { httpOnly: true });~// ruleid: af-jwt-hardcoded-secret, af-jwt-algorithm-none~jwt.sign(p, "k^", { algorithm: "none" });~// ok: af-jwt-missing-expiration~jwt.sign(p, key, { expiresIn: "1h" });~// ruleid: af-cors-wildcard-origin~res.header("Access-Control-Allow-Origin", "*");'),
    ("src/", ".py", '# ruleid: af-flask-debug-true~app.run(debug=True)~# ok: af-flask-debug-true~app.run(debug=False)~# ruleid: af-requests-verify-false~requests.get(u^, verify=False)~# ruleid: af-ssl-unverified-context~ctx = ssl.create_default_context()~# ok: af-jwt-verify-disabled-python~jwt.decode(t, k, verify=False)'),
    ("src/", ".js", 'const rateLimit = require("express-rate-limit");~const limiter = rateLimit({ max: ^ });~app.post("/login", limiter, requireAuth, (req, res) => {~  res.send("ok");~});~app.use("/static", serveStatic);'),
    ("src/", ".py", '# audit-disable-file insecure-config, af-requests-verify-false~DEBUG = True~requests.post(u, verify=False)~x = 1  # audit-disable-line R^'),
    ("src/", ".py", '@app.route("/admin/x^")~~# note~@admin_required~async def a():~    pass~@cached~x = 2~def b():~    pass~@bp.post("/api/items")~def c():~    q = request.json["q"]~    cur.execute("select " + q)~    open(q)'),
    ("src/", ".js", 'import Koa from "koa";~res.setHeader("Content-Security-Policy", "default-src self");~res.set("Strict-Transport-Security", "max-age=^");'),
    ("src/", ".ts", 'const s = new ApolloServer({ introspection: true });~process.env.NODE_TLS_REJECT_UNAUTHORIZED = "0";~crypto.createHash("md5").update(password^);~bcrypt.encrypt(x);'),
    ("src/", ".js", 'const { save: store } = require("../src/./m#");~const d = require("./lib/util");~function up(req) {~  const { body } = req;~  store(req.body.name, body);~}~module.exports = { up, alias: up };'),
    ("src/", ".js", 'function save(rec, name) {~  fs.writeFile(name, rec^);~}~module.exports = { save };'),
    ("src/", ".js", 'const { save: store } = require("./m#");~const put = async (req) => {~  await store("x^", req.params.id);~};~exports.put = put;'),
    ("conf/", ".cfg", 'password = "abcdefgh1234567^"~id = AKIAABCDEFGHIJKLMNO^~name = "short"'),
    ("node_modules/x/", ".js", 'app.post("/admin/hidden^", (req, res) => { eval(req.body.x); });'),
]
N_TEMPLATES = len(_TEMPLATES)
FILES_PER_REPO = 5

CODE_FILES = (
    """
SELECT CONCAT('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo,
 CONCAT(t.dir, 'm', CAST(p_partkey AS STRING), t.ext) AS path,
 REPLACE(REPLACE(REPLACE(t.body, '~', chr(10)), '^', CAST(p_partkey % 7 AS STRING)), 'm#', CONCAT('m', CAST(p_partkey - 1 AS STRING))) AS content
FROM @@part JOIN (VALUES
"""
    + ",\n".join(f" ({i},'{d}','{e}','{b}')" for i, (d, e, b) in enumerate(_TEMPLATES))
    + "\n) AS t(k, dir, ext, body) ON p_partkey % 24 = t.k\n"
)

# Forms that only a scanner tells apart: comments that look like code, calls and values over lines, several calls on a
# line, broken brackets. ~ is a line break, ^ a digit, § a dollar sign (before a brace it would name a variable of the SQL).
_FORMS = [
    (".js", '// call it later,~res.cookie("sid", v, { // note~  httpOnly: false,~});~/* jwt.sign(p, "k") ( */ x = "// jwt.sign(p, \'k\')";'),
    (".py", '# call it once (~requests.get(u^, verify=False)~page = requests.get(~    u,  # verify=False)~    verify=False,~)'),
    (".js", '// routes,~app.post(`/admin/x^`, handler); app.get("/a", h).put("/b", guard("k"), h)~app.get(`/§{y}`, h)'),
    (".js", '/* app.get("/hidden", h)~*/ app.get(~  "/shown",~  requireAuth,~  (req, res) => { res.send(1); }~);~app.delete("/one")~app.use("/in", users.check, (q) => { next(); });'),
    (".js", 'const f = (req) => {~  for (const name of req.body.names) {~    cp.exec(~      name~    );~  }~  let q;~  if (req.ok) q = req.query.q;~  db.query("SELECT a; " + q); // eval(q)~  const late =~    req.params.id;~  eval(late);~  for (const k in req.query) eval(k);~};'),
    (".js", 'function hooks(app) {~  app.post("/webhook/a", (req, res) => { save(req.body); });~  app.post("/webhook/b", async (req, res) => {~    app.post("/stripe/in", function (q, r) { verify(q); });~  });~  app.post("/github", (q) => {~    go(q);~}'),
]

CODE_FORMS = (
    """
SELECT CONCAT('repo', CAST(p_partkey - p_partkey % 5 AS STRING)) AS repo, CONCAT('src/f', CAST(p_partkey AS STRING), t.ext) AS path,
 REPLACE(REPLACE(REPLACE(t.body, '~', chr(10)), '^', CAST(p_partkey % 7 AS STRING)), '§', chr(36)) AS content
FROM @@part JOIN (VALUES
"""
    + ",\n".join(f" ({i},'{e}','{b.replace(chr(39), chr(39) * 2)}')" for i, (e, b) in enumerate(_FORMS))
    + "\n) AS t(k, ext, body) ON p_partkey % 6 = t.k\n"
)

# Files the raw findings are about, some with directives.
DIRECTIVE_FILES = """
SELECT repo, path, REPLACE(CASE v
  WHEN 0 THEN 'a~b~c // audit-disable-line~d'
  WHEN 1 THEN '# audit-disable-next-line R1, secrets~x~y'
  WHEN 2 THEN '/* audit-disable injection */~x'
  WHEN 3 THEN 'x~<!-- audit-disable-file eslint -->'
  WHEN 4 THEN 'plain text~without any'
  ELSE 'x~y // audit-disable-line bandit~z // audit-disable-next-line gitleaks  secrets~w~-- AUDIT-DISABLE-line~a // audit-disable-line semgrep' END,
  '~', chr(10)) AS content
FROM (SELECT repo, REPLACE(REPLACE(file_raw, chr(92), '/'), './', '') AS path, MIN((repo_key + seq) % 6) AS v
 FROM (@@findings_raw) AS r GROUP BY repo, REPLACE(REPLACE(file_raw, chr(92), '/'), './', '')) AS f
"""

# One ignore list per repository.
IGNORE_LINES = """
SELECT CONCAT('repo', CAST(s_suppkey AS STRING)) AS repo, CAST(t.ord AS INT) AS ord, t.line AS line
FROM @@supplier JOIN (VALUES
 (0,1,'# old code'),(0,2,'src/legacy/**'),(0,3,'!src/legacy/f3.js'),(0,4,'rule:R1*'),(0,5,'f?.test.ts'),
 (1,1,'category: CORS-misconfig '),(1,2,''),(1,3,'/tests/'),(1,4,'!*.py'),(1,5,'rule:'),
 (2,1,'*.test.ts'),(2,2,'path: data/raw/f?.csv'),(2,3,'RULE: b101 (*)'),(2,4,'!data/raw/f1.csv'),(2,5,'data/**/f1*'),(2,6,'!f1.js')
) AS t(k, ord, line) ON s_suppkey % 3 = t.k
"""

# Call graph: layers L0 to L6 with cycles; nodes grow with the tables.
EDGES = """
SELECT DISTINCT CONCAT('L', CAST(l_partkey % 6 AS STRING), '_', CAST(l_suppkey AS STRING)) AS src,
 CONCAT('L', CAST(CASE WHEN l_linenumber = 7 AND l_partkey % 6 = 5 THEN 2 ELSE l_partkey % 6 + 1 END AS STRING), '_',
  CAST(CAST((l_partkey - l_partkey % 20) / 20 AS BIGINT) AS STRING)) AS dst,
 CAST((l_partkey - l_partkey % 20) / 20 AS BIGINT) % 7 = 0 AS sanitized
FROM @@lineitem
"""

# File listings for profiles.
REPO_LISTING = """
SELECT CONCAT('repo', CAST(p_partkey - p_partkey % 7 AS STRING)) AS repo,
 CONCAT(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'backend/' WHEN 2 THEN 'node_modules/a/' WHEN 3 THEN 'a/b/c/d/e/f/g/h/i/' ELSE '' END,
  CASE p_partkey % 17 WHEN 0 THEN 'package.json' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'app.py' WHEN 4 THEN 'Dockerfile' WHEN 5 THEN 'main.tf'
   WHEN 6 THEN 'deploy.yaml' WHEN 7 THEN 'config.yaml' WHEN 8 THEN 'pom.xml' WHEN 9 THEN 'app.csproj' WHEN 10 THEN 'index.TS' WHEN 11 THEN '.nvmrc'
   WHEN 12 THEN '.node-version' WHEN 13 THEN 'compose.yml' WHEN 14 THEN '.git/HEAD' WHEN 15 THEN 'dev.Dockerfile' ELSE 'notes.txt' END) AS path,
 CASE p_partkey % 17 WHEN 0 THEN CONCAT('{"engines": {"node": ">=', CAST(p_partkey % 9 + 12 AS STRING), '"}}')
   WHEN 6 THEN CONCAT('apiVersion: apps/v1', chr(10), 'kind: Deployment') WHEN 7 THEN 'name: x'
   WHEN 11 THEN CONCAT('v', CAST(18 + p_partkey % 4 AS STRING), chr(10)) WHEN 12 THEN CONCAT(chr(10), ' 20.', CAST(p_partkey % 3 AS STRING), chr(10), 'x') ELSE '' END AS content
FROM @@part
"""

# User configuration, some of it misspelt or invalid.
USER_CONFIG = """
SELECT CONCAT('repo', CAST(s_suppkey AS STRING)) AS repo, t.scope AS scope, t.name AS name, REPLACE(t.val, '^', CAST(s_suppkey % 5 AS STRING)) AS val
FROM @@supplier JOIN (VALUES
 (0,'','failOn','high'),(0,'taint','sinks','eval,run^'),(0,'taint','sink','eval'),
 (1,'','failOn','severe'),(1,'secrets','dataFiles','ignore'),(1,'','failon','low'),
 (2,'tools','disabled','trivy'),(2,'tools','enabled','bandit,made-up,semgrep'),(2,'checkers','sensitiveRoutePatterns','pin^'),(2,'trivy','mode','config'),(2,'','trivy','x'),
 (2,'','ignore','rule:R2*,!src/f1.js'),(3,'secrets','dataFiles','keep'),
 (3,'','toolTimeoutMs','^000'),(3,'secrets','files','keep')
) AS t(k, scope, name, val) ON s_suppkey % 4 = t.k
"""

# Lists of checkers and flows that some repositories set for themselves.
CHECK_CONFIG = """
SELECT CONCAT('repo', CAST(s_suppkey AS STRING)) AS repo, t.scope AS scope, t.name AS name, t.val AS val
FROM @@supplier JOIN (VALUES
 (0,'checkers','authMiddlewareNames','Handler,doList'),(0,'taint','sources','req.query,paper'),(0,'taint','sinks','store,cp.exec'),
 (1,'checkers','sensitivePathKeywords','health,invoices'),(1,'taint','sanitizers','exec'),(1,'checkers','sensitiveRoutePatterns','/orders')
) AS t(k, scope, name, val) ON CAST((s_suppkey - s_suppkey % 5) / 5 AS BIGINT) % 3 = t.k
"""

# Rule submissions of many teams for catalogue checks.
SUBMITTED_RULES = """
SELECT CONCAT('rule-', CAST(p_partkey % 1000 AS STRING), CASE WHEN p_partkey % 50 = 3 THEN '' ELSE CONCAT('-', CAST(p_partkey AS STRING)) END) AS rule_id,
 CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'ERROR' ELSE NULL END AS severity,
 CASE p_partkey % 5 WHEN 0 THEN 'injection' WHEN 1 THEN 'secrets' WHEN 2 THEN 'ssrf' WHEN 3 THEN 'other' ELSE 'misc' END AS category,
 (p_partkey % 4 <> 1) AS has_positive, (p_partkey % 3 <> 1) AS has_negative
FROM @@part
"""

# Advisory ids.
ADVISORIES = """
SELECT p_partkey AS part_key,
 CASE p_partkey % 5 WHEN 0 THEN CONCAT('CVE-2024-', CAST(p_partkey AS STRING)) WHEN 1 THEN CONCAT('GHSA-ab12-', CAST(p_partkey AS STRING), '-zz')
  WHEN 2 THEN CONCAT('PYSEC-2023-', CAST(p_partkey AS STRING)) WHEN 3 THEN CONCAT('osv-', CAST(p_partkey AS STRING)) ELSE CONCAT('X-', CAST(p_partkey AS STRING)) END AS id,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CONCAT('cve-2020-', CAST(p_partkey % 11 AS STRING)) END AS alias,
 CASE p_partkey % 3 WHEN 0 THEN CONCAT('https://x.test/advisories/ghsa-', CAST(p_partkey AS STRING), '-ab?x=1') WHEN 1 THEN 'https://x.test/none' ELSE NULL END AS url
FROM @@part
"""

_NAMED = {
    "findings_raw": FINDINGS_RAW,
    "code_files": CODE_FILES,
    "code_forms": CODE_FORMS,
    "directive_files": DIRECTIVE_FILES,
    "ignore_lines": IGNORE_LINES,
    "edges": EDGES,
    "repo_listing": REPO_LISTING,
    "user_config": USER_CONFIG,
    "check_config": CHECK_CONFIG,
    "submitted_rules": SUBMITTED_RULES,
    "advisories": ADVISORIES,
}

#: Inputs that hold a source text for each row of a table, and the column that it follows from.
_WRITES_TEXT = {"code_files": ("part", "p_partkey"), "code_forms": ("part", "p_partkey")}


def expand(sql: str) -> str:
    """Replace references to other inputs by their text."""
    return re.sub(r"@@(\w+)", lambda m: _NAMED.get(m.group(1), "@@" + m.group(1)), sql)


def checking_sql(name: str) -> str:
    """Text of an input for the checking engine, which knows the tables by name."""
    return re.sub(r"@@(\w+)", r"\1", expand(_NAMED[name]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read straight from its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    if name not in _NAMED:
        return _table(spark, sf_dir, name)
    sql = expand(_NAMED[name])
    used = {t: _table(spark, sf_dir, t) for t in set(re.findall(r"@@(\w+)", sql))}
    if name in _WRITES_TEXT:
        # Few bytes of keys become much text, which is slow to read: without this, one task would read all that
        # comes from one file of keys.
        table, key = _WRITES_TEXT[name]
        used[table] = used[table].select(key).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for table, df in used.items():
        df.createOrReplaceTempView(f"given_{table}")
    return spark.sql(re.sub(r"@@(\w+)", r"given_\1", sql))


def findings(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """The raw findings, normalised."""
    return make_findings(
        load(spark, sf_dir, "findings_raw"),
        keep,
        repo="repo",
        tool="tool",
        rule_id="rule_id",
        severity=S.normalize_severity("severity_raw"),
        category="category_raw",
        file="file_raw",
        line="line_raw",
        message="message_raw",
        confidence="confidence_raw",
        ai_relevant="ai_relevant",
        references=F.array(F.concat(F.lit("https://rules.test/"), F.col("rule_id"))),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "code_files")
