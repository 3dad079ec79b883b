import re
import time

import pytest
from pyspark.sql import functions as F

from auditlake.config import CATEGORIES, SEVERITIES, Config
from auditlake.operators import code, files, fixes, flow, markup, mask
from auditlake.rules import catalogue, crawl, dependencies, pages, scan, structure, styles

FILES = "file_id long, project string, relative_path string, content string, size long"


def described(spark, *rows):
    return files.describe(spark.createDataFrame([(i, "p", path, text, None if text is None else len(text)) for i, (path, text) in enumerate(rows)], FILES))


def ids(df):
    return sorted({r.rule_id for r in df.select("rule_id").collect()})


# --- catalogue


def test_catalogue_is_whole():
    for r in catalogue.RULES:
        assert re.fullmatch(r"[A-Z][A-Z0-9]*(-[A-Z0-9]+)*", r.id) and r.severity in SEVERITIES and r.category in CATEGORIES and r.title
        assert r.regex and (r.unless is None or r.silent_line) and (r.unless_file is None or r.silent_file)
    assert len({r.id for r in catalogue.RULES}) > 110


def test_no_rule_is_slow():
    sample = ("const value = compute(alpha, beta[3], 'text ' + gamma.delta) || { a: 1, b: [2, 3] };\n" * 60) + "a" * 3000 + "(" * 300
    for r in catalogue.RULES:
        began = time.perf_counter()
        list(r.regex.finditer(sample))
        assert time.perf_counter() - began < 0.5, r.id


POSITIVE = [
    ("SEC-EVAL", "a.js", "function f(x) { return eval(x); }"), ("SEC-FUNCTION-CTOR", "a.js", "new Function(code)"), ("SEC-EXEC-SHELL", "a.js", "exec(`ls ${dir}`)"), ("SEC-SHELL-TRUE", "a.py", "subprocess.run(cmd, shell=True)"),
    ("SEC-SQL-CONCAT", "a.js", 'db.query("SELECT a FROM t WHERE id=" + req.query.id)'), ("SEC-INNERHTML", "a.js", "function f(v) { el.innerHTML = v; }"), ("SEC-PICKLE", "a.py", "x = pickle.loads(data)"), ("SEC-WEAK-HASH", "a.py", "hashlib.md5(password)\nmd5(password)"),
    ("SEC-TLS-DISABLED", "a.py", "requests.get(u, verify=False)"), ("SEC-HTTP-URL", "a.js", 'fetch("http://shop.fr/x")'), ("SEC-CORS-WILDCARD", "a.js", "app.use(cors())"), ("SEC-CSRF-OFF", "a.py", "@csrf_exempt\ndef f(): pass"), ("SEC-COOKIE-FLAGS", "a.js", "cookie: { httpOnly: false }"),
    ("SEC-PERMISSIVE-PERMS", "a.sh", "chmod 777 /srv"), ("SEC-PATH-TRAVERSAL", "a.js", "fs.readFile(req.query.f, cb)"), ("SEC-SSRF", "a.js", "fetch(req.body.url)"), ("SEC-EMPTY-CATCH", "a.js", "try { f() } catch (e) {}"), ("SEC-REGEX-DOS", "a.js", "const r = new RegExp('(a+)+$')"),
    ("SEC-DOCKER-LATEST", "Dockerfile", "FROM node:latest\nUSER app"), ("SEC-DOCKER-ROOT", "Dockerfile", "FROM node:20\nRUN x"), ("SEC-ENV-COMMITTED", ".env", "A=1"), ("PERF-AWAIT-IN-LOOP", "a.js", "for (const x of xs) { await f(x); }"), ("PERF-SELECT-STAR", "a.py", 'q = "select * from t"'),
    ("PERF-MOMENT", "a.js", "import moment from 'moment'"), ("QUAL-TODO", "a.js", "// TODO later"), ("QUAL-FIXME", "a.py", "# FIXME"), ("DEAD-DEBUG-INSTRUCTION-DEBUGGER", "a.js", "f();\ndebugger;\n"), ("DEAD-DEBUG-POINT-D-ARRET", "a.py", "pdb.set_trace()"),
    ("DJANGO-SECRET-KEY-HARDCODED", "settings.py", "SECRET_KEY = 'abcdefgh'"), ("FLASK-SECRET-KEY-HARDCODED", "a.py", "app.secret_key = 'abcdef'"), ("ELECTRON-NODE-INTEGRATION", "a.js", "nodeIntegration: true"), ("EXPRESS-STATIC-DOTFILES", "a.js", "static('x', { dotfiles: 'allow' })"),
    ("RAILS-SQL-INTERPOLATION", "a.rb", 'User.where("name = #{n}")'), ("LARAVEL-GUARDED-EMPTY", "a.php", "protected $guarded = [];"), ("SPRING-ACTUATOR-EXPOSED", "application.properties", "management.endpoints.web.exposure.include=*"), ("SPRING-PERMIT-ALL", "A.java", "http.anyRequest().permitAll()"),
    ("NEXTJS-NO-HEADERS", "next.config.js", "module.exports = {}"), ("SVELTE-HTML-TAG", "a.svelte", "{@html x}"), ("TAURI-CSP-ABSENTE", "src-tauri/tauri.conf.json", '{"security": {"csp": null}}'), ("MOBILE-DEBUGGABLE", "AndroidManifest.xml", '<application android:debuggable="true"/>'),
    ("REACT-TOKEN-IN-STORAGE", "a.js", "localStorage.setItem('auth_token', t)"), ("ENV-PUBLIC-SECRET", "a.js", "process.env.NEXT_PUBLIC_API_SECRET"), ("FLUTTER-TLS-DESACTIVE", "a.dart", "client.badCertificateCallback = (c, h, p) => true;"), ("IOS-TROUSSEAU-TOUJOURS-ACCESSIBLE", "A.swift", "kSecAttrAccessibleAlways"),
    ("SEC-DONNEES-DANS-SCRIPT", "a.html", "<script>var x = {{ data|safe }};</script>"), ("LARAVEL-CSRF-MISSING", "a.blade.php", '<form method="post"><input></form>'), ("RN-STOCKAGE-NON-CHIFFRE", "a.js", "AsyncStorage.setItem('token', t)"), ("ANGULAR-BYPASS-SECURITY", "a.ts", "this.s.bypassSecurityTrustHtml(x)"),
]
SILENT = [
    ("SEC-EVAL", "a.js", "// eval(x)\nconst s = 'eval(x)'; obj.eval(x);"), ("SEC-INNERHTML", "a.js", "el.innerHTML = '';"), ("SEC-INNERHTML", "a.js", "el.innerHTML = '<b>fixed</b>';"), ("SEC-HTTP-URL", "a.js", 'x = "http://localhost:3000"'), ("SEC-DOCKER-ROOT", "Dockerfile", "FROM node:20\nUSER app"),
    ("SEC-ENV-COMMITTED", ".env.example", "A=1"), ("NEXTJS-NO-HEADERS", "next.config.js", "module.exports = { async headers() { return []; } }"), ("SEC-SQL-CONCAT", "a.js", 'log("select an item " + name)'), ("LARAVEL-CSRF-MISSING", "a.blade.php", '<form method="post">@csrf<input></form>'),
    ("DEAD-DEBUG-APPEL-CONSOLE", "a.js", "console.log(1)"), ("SEC-WEAK-RANDOM", "a.js", "const color = Math.random();"), ("SEC-EVAL", "node_modules/x/a.js", "eval(x)"), ("QUAL-TODO", "a.js", "// TODO x // audit-ignore"), ("EXPRESS-NO-BODY-LIMIT", "a.js", "express.json({ limit: '1mb' })"),
]

POSITIVE += [
    ("SEC-EXEC-SHELL", "a.py", 'os.system("ls " + name)'), ("SEC-EXEC-SHELL", "a.rb", 'system("ls #{dir}")'), ("SEC-EXEC-SHELL", "a.php", 'exec("ls $dir");'), ("SEC-EXEC-SHELL", "A.java", 'Runtime.getRuntime().exec("ls " + dir);'), ("SEC-SQL-CONCAT", "a.py", 'cur.execute(f"DELETE FROM t WHERE id={i}")'),
    ("SEC-SQL-CONCAT", "a.php", '$q = "UPDATE t SET a=1 WHERE id=" . $id;'), ("SEC-SQL-RAW", "a.js", "db.raw('select 1')"), ("SEC-NOSQL-WHERE", "a.js", "db.find({ $where: fn })"), ("SEC-PICKLE", "a.py", "yaml.load(text)"), ("SEC-JAVA-DESERIALIZE", "A.java", "Object o = in.readObject();"),
    ("SEC-JAVA-DESERIALIZE", "A.java", "x = new ObjectInputStream(s);"), ("SEC-PHP-UNSERIALIZE", "a.php", "unserialize($x);"), ("SEC-WEAK-CIPHER", "A.java", 'Cipher.getInstance("AES/ECB/PKCS5Padding")'), ("SEC-WEAK-RANDOM", "a.js", "const token = Math.random();"), ("SEC-WEAK-RANDOM", "A.java", "Random r = new Random();"),
    ("SEC-TLS-DISABLED", "a.js", "agent({ rejectUnauthorized: false })"), ("SEC-TLS-DISABLED", "a.js", "process.env['NODE_TLS_REJECT_UNAUTHORIZED'] = '0'"), ("SEC-TLS-DISABLED", "a.go", "InsecureSkipVerify: true,"), ("SEC-JWT-NONE", "a.js", "sign(x, { algorithm: 'none' })"), ("SEC-JWT-NONE", "a.py", "jwt.decode(t, k, verify=False)"),
    ("SEC-CORS-WILDCARD", "a.js", "res.set('Access-Control-Allow-Origin', '*')"), ("SEC-CORS-WILDCARD", "a.py", 'allow_origins=["*"]'), ("SEC-ALLOWED-HOSTS-WILDCARD", "a.py", "ALLOWED_HOSTS = ['a.fr', '*']"), ("SEC-SECURE-FLAG-OFF", "a.py", "SESSION_COOKIE_SECURE = False"), ("SEC-COOKIE-FLAGS", "a.js", "sameSite: 'none'"),
    ("SEC-SSRF", "a.py", "requests.get(request.args['u'])"), ("SEC-OPEN-REDIRECT", "a.js", "res.redirect(req.query.next)"), ("SEC-OPEN-REDIRECT", "a.php", "header('Location: ' . $_GET['u']);"), ("SEC-DEBUG-ON", "a.py", "app.run(debug=True)"), ("SEC-DEBUG-ON", "settings.py", "DEBUG = True"), ("SEC-BIND-ALL", "a.js", "app.listen(80, '0.0.0.0')"),
    ("SEC-PROTOTYPE-POLLUTION", "a.js", "target[req.body.k] = v"), ("SEC-PROTOTYPE-POLLUTION", "a.js", "Object.assign(o, JSON.parse(x))"), ("SEC-LOG-SENSITIVE", "a.js", "console.log(user.password)"), ("SEC-XXE", "a.py", "etree.parse(f)"), ("SEC-MASS-ASSIGNMENT", "a.js", "User.create(req.body)"), ("SEC-DOC-WRITE", "a.js", "document.write(x)"),
    ("SEC-TEMPLATE-AUTOESCAPE", "a.html", "{{ x | safe }}"), ("SEC-VUE-VHTML", "a.vue", '<p v-html="x">'), ("SEC-DANGEROUS-HTML", "a.js", "<p dangerouslySetInnerHTML={{ __html: x }} />"),
]
SILENT += [
    ("SEC-EXEC-SHELL", "a.js", "const m = /a+/g.exec('x' + y); nameRegex.exec(`a${b}`); spawnSync('ls', ['a' + b]);"), ("SEC-SHELL-TRUE", "a.py", "subprocess.run(cmd)\nrun(shell=True)"), ("SEC-PICKLE", "a.py", "yaml.load(text, Loader=yaml.SafeLoader)"), ("SEC-CORS-WILDCARD", "a.js", "cors({ origin: list })"),
    ("SEC-JWT-NONE", "a.py", "jwt.decode(t, k)"), ("SEC-SECURE-FLAG-OFF", "a.py", "SESSION_COOKIE_SECURE = False\nSESSION_COOKIE_SECURE = True"), ("SEC-PROTOTYPE-POLLUTION", "a.js", "target[index] = v; x = list[key];"), ("SEC-REGEX-DOS", "a.js", "re = new RegExp('(a+)(b)+')"), ("SEC-SQL-CONCAT", "a.js", "db.query('select a from t where id = ?', [id])"),
    ("SEC-ALLOWED-HOSTS-WILDCARD", "a.py", "ALLOWED_HOSTS = ['*.a.fr']"), ("SEC-DOCKER-LATEST", "Dockerfile", "FROM node:20\nUSER app"), ("SEC-MASS-ASSIGNMENT", "a.js", "create(req.body.name)"), ("SEC-OPEN-REDIRECT", "a.js", "res.redirect('/home')"), ("SEC-LOG-SENSITIVE", "a.js", "console.log('token')"),
]


def test_pattern_rules_fire(spark):
    rows = [(f"d{i}/{path}", text) for i, (_, path, text) in enumerate(POSITIVE)]
    found = {(r.file.split("/")[0], r.rule_id) for r in scan.pattern_findings(described(spark, *rows)).collect()}
    missing = [rule for i, (rule, _, _) in enumerate(POSITIVE) if (f"d{i}", rule) not in found]
    assert not missing


def test_pattern_rules_stay_silent(spark):
    rows = [(f"d{i}/{path}", text) for i, (_, path, text) in enumerate(SILENT)]
    found = {(r.file.split("/")[0], r.rule_id) for r in scan.pattern_findings(described(spark, *rows)).where("data['suppressed'] = 'false'").collect()}
    noisy = [rule for i, (rule, _, _) in enumerate(SILENT) if (f"d{i}", rule) in found]
    assert not noisy


def test_severity_falls_in_tests_and_examples(spark):
    text = "subprocess.run(c, shell=True)"
    got = {r.file: r.severity for r in scan.pattern_findings(described(spark, ("a.py", text), ("tests/test_a.py", text), ("examples/a.py", text))).collect()}
    assert got == {"a.py": "high", "tests/test_a.py": "low", "examples/a.py": "medium"}


def test_secrets_are_masked_and_told_once_a_file(spark):
    token = "ghp_" + "lC2nMTe0T2SWH2YniMNqEKG0nzrfv9AwJXW8"
    rows = scan.secret_findings(described(spark, ("a.js", f"x('{token}')\ny('{token}')"), ("b.js", "password = 'changeme-please'"), ("c.js", "// https://fonts.x/css?family=A:400@x"))).collect()
    assert [(r.rule_id, r.file, r.line) for r in rows] == [("SEC-SECRET-GITHUB-TOKEN", "a.js", 1)] and token not in rows[0].snippet and "****" in rows[0].snippet


# --- masking, flow


def test_masking_keeps_offsets_and_holes():
    js = "a = 'x//y'; // eval(1)\nb = `t ${eval(q)} u`; /* c */ r = /ab'c/g;"
    out = mask.mask(js, "js")
    assert len(out) == len(js) and "eval(q)" in out and "eval(1)" not in out and "x//y" not in out and "ab'c" not in out
    assert mask.mask('x = f"a {call(y)} b"  # z', "python").count("call(y)") == 1
    assert [js[a:b] for a, b in mask.comment_ranges(js, "js")] == ["// eval(1)", "/* c */"]
    assert mask.mask("unknown 'x'", "cobol") == "unknown 'x'"


def test_origins():
    js = "const a = 'lit';\nfunction f(p) {\n  const q = req.body.x;\n  let { r } = p;\n  use(a, p, q);\n}\n"
    scopes = flow.scopes_of(js, "js")
    at = js.index("use(")
    assert [flow.origin(scopes, n, at) for n in ("a", "p", "q", "zz")] == ["literal", "parameter", "external", "unknown"]
    py = "A = 1\ndef f(x):\n    y = request.args['k']\n    go(y)\n"
    scopes = flow.scopes_of(py, "python")
    assert [flow.origin(scopes, n, py.index("go(")) for n in ("A", "x", "y")] == ["literal", "parameter", "external"]
    assert flow.scopes_of("x", "ruby") is None


# --- markup and styles

PAGE = """<!doctype html><html><head><title>Short</title></head><body>
<h1>A</h1><h4>B</h4><p>unclosed<b>bold
<a href="/x" target="_blank">click here</a><a></a><img src="a.png"><script>var s = "</p>";</script>
<input type="email"><label for="q">Q</label><input id="q" type="text"><div onclick="go()">x</div><table><tr><td>1</td><td>2</td></tr></table>
</body></html>"""


def test_nodes_of_untidy_markup():
    nodes = markup.parse_nodes(PAGE)
    tags = [n["tag"] for n in nodes]
    assert tags.count("p") == 1 and tags.count("script") == 1 and next(n for n in nodes if n["tag"] == "script")["text"] == 'var s = "</p>";'
    assert next(n for n in nodes if n["tag"] == "h4")["parents"] == ["html", "body"]
    assert markup.attributes("A='1' b=2 c D=\"x>y\" a=3") == {"a": "3", "b": "2", "c": "", "d": "x>y"}
    assert markup.parse_nodes("") == [] and markup.decode_entities("&lt;&#65;&eacute;&nope;") == "<Ae&nope;"


def test_page_rules(spark):
    got = ids(pages.page_findings(described(spark, ("a.html", PAGE), ("b.html", PAGE), ("part.html", "<p>x</p>"))))
    wanted = "SEO-TITLE-SHORT SEO-DESC-MISSING SEO-LANG-MISSING SEO-VIEWPORT-MISSING SEO-CHARSET-MISSING SEO-CANONICAL-MISSING SEO-OG-MISSING SEO-STRUCTURED-DATA SEO-THIN-CONTENT SEO-FAVICON-MISSING SEO-HEADING-SKIP SEO-IMG-ALT-MISSING SEO-ANCHOR-GENERIC SEO-TITLE-DUPLICATED-PAGES ROUTE-TARGET-BLANK A11Y-INPUT-NO-LABEL UX-NO-AUTOCOMPLETE A11Y-CLICKABLE-DIV A11Y-TABLE-NO-HEADERS A11Y-NO-MAIN-LANDMARK A11Y-LINK-NO-HREF".split()
    assert not set(wanted) - set(got) and "SEO-TITLE-MISSING" not in got and "SEO-H1-MISSING" not in got


def test_style_rules(spark):
    css = "a{color:#999;background:#fff}\n.btn{height:20px}\n:focus{outline:none}\np{font-size:10px}\n" + "".join(f".z{i}{{z-index:{1000 + i}}}\n" for i in range(5))
    got = ids(styles.style_findings(described(spark, ("a.css", css), ("b.css", None))))
    assert {"A11Y-CONTRAST", "DESIGN-TAP-TARGET", "A11Y-FOCUS-REMOVED", "DESIGN-FONT-TOO-SMALL", "DESIGN-ZINDEX-CHAOS"} <= set(got)


# --- code


def test_functions_by_braces_indentation_and_end():
    js = "function big(a, b) {\n  if (a) { return 1; }\n}\nconst f = (x) => {\n  g();\n};\n"
    assert [(n, s, e) for n, s, e, _, _ in code.extract_functions(js, "js")] == [("big", 1, 3), ("f", 4, 6)]
    py = "def one(a,\n        b):\n    return 1\n\ndef two():\n    pass\n"
    assert [(n, s, e) for n, s, e, _, _ in code.extract_functions(py, "python")] == [("one", 1, 3), ("two", 5, 6)]


def test_imports_and_names():
    js = "import D, { a as b, c } from './x'\nimport * as N from \"y\"\nconst { q } = require('z')\nimport 'side'\nexport * from './w'\n"
    got = {(t, s, n, b) for t, s, n, b, _ in code.extract_imports(js, "js")}
    assert {("esm", "./x", "default", "D"), ("esm", "./x", "a", "b"), ("esm", "./x", "c", "c"), ("esm", "y", "*", "N"), ("cjs", "z", "q", "q"), ("side-effect", "side", "*", ""), ("reexport-all", "./w", "*", "*")} <= got
    py = "from a.b import (c as d,\n  e)\nimport os.path as p, sys\n"
    assert {(s, n, b) for _, s, n, b, _ in code.extract_imports(py, "python")} == {("a.b", "c", "d"), ("a.b", "e", "e"), ("os.path", "*", "p"), ("sys", "*", "sys")}


def test_dead_code(spark):
    f = described(spark, ("src/main.js", "import { used } from './lib/a';\nimport { gone } from './lib/a';\nused();\n"), ("lib/x.js", "\n"), ("src/lib/a.js", "export function used() {\n  return 1;\n  more();\n}\nexport function neverUsed() {}\n"), ("src/lonely.js", "const x = 1;\nx;\nfunction y() {}\n"), ("img/unused.png", None))
    rows = {(r.rule_id, r.file, r.snippet) for r in structure.deadcode_findings(f).collect()}
    rules = {(a, b) for a, b, _ in rows}
    assert ("DEAD-FILE", "src/lonely.js") in rules and ("DEAD-FILE", "src/lib/a.js") not in rules and ("DEAD-UNREACHABLE", "src/lib/a.js") in rules and ("DEAD-ASSET", "img/unused.png") in rules
    assert ("DEAD-EXPORT", "src/lib/a.js", "neverUsed") in rows and ("DEAD-EXPORT", "src/lib/a.js", "used") not in rows and ("DEAD-IMPORT", "src/main.js", "gone") in rows


def test_quality(spark):
    block = "".join(f"const value{i} = compute(alpha{i}, beta);\n" for i in range(8))
    deep = "def f(a, b, c, d, e, g):\n" + "".join("    " * (k + 1) + "if a:\n" for k in range(8)) + "    " * 9 + "pass\n"
    got = ids(structure.quality_findings(described(spark, ("a.js", block), ("b.js", block), ("c.py", deep), ("d.js", "x();\n" * 600), ("e.yml", 'a: "\\d"\n'))))
    assert {"QUAL-DUPLICATION", "QUAL-DEEP-NESTING", "QUAL-TOO-MANY-PARAMS", "QUAL-FILE-TOO-LONG", "QUAL-YAML-ECHAPPEMENT-INVALIDE"} <= set(got)


def test_loops_with_queries(spark):
    bad = "for x in xs:\n    y = x\n    Item.objects.get(pk=y)\n"
    good = "for x in xs:\n    y = x\nItem.objects.get(pk=1)\n"
    assert [(r.file, r.line) for r in structure.n_plus_one(described(spark, ("a.py", bad), ("b.py", good))).collect()] == [("a.py", 3)]


def test_routes_and_links(spark):
    f = described(
        spark,
        ("server.js", "app.get('/api/users', f);\napp.get('/api/users', g);\napp.get('/u/:id', h);\napp.get('/a//b', i);"),
        ("app.py", "@app.route('/search')\ndef s(): pass\n"),
        ("A.java", '@RequestMapping("/api")\npublic class A {\n@PostMapping("/users")\nvoid f() {} }'),
        ("index.html", '<!doctype html><html><body><a href="/u/7">a</a><a href="/missing-page">b</a><img src="/no.png"><a href="/about">c</a></body></html>'),
        ("about.html", "<!doctype html><html></html>"),
        ("orphan.html", "<!doctype html><html></html>"),
    )
    routes = code.routes(f)
    seen = {(r.framework, r.method, r.pattern) for r in routes.collect()}
    assert {("express", "GET", "/api/users"), ("flask", "GET", "/search"), ("spring", "POST", "/api/users"), ("static", "PAGE", "/about")} <= seen
    page = pages.pages_of(f)
    nodes = markup.nodes(page, "file_id", "content").join(page.select(F.col("file_id").alias("_p"), "project", "file"), F.col("file_id") == F.col("_p"))
    rows = {(r.rule_id, r.snippet) for r in structure.route_findings(routes, code.links(nodes, f), f).collect()}
    assert {("ROUTE-DUPLICATE", "GET /api/users"), ("ROUTE-DOUBLE-SLASH", "/a//b"), ("ROUTE-BROKEN-LINK", "/missing-page"), ("ROUTE-MISSING-ASSET", "/no.png"), ("ROUTE-ORPHAN", "/orphan")} <= rows
    assert not {("ROUTE-BROKEN-LINK", "/u/7"), ("ROUTE-BROKEN-LINK", "/about"), ("ROUTE-ORPHAN", "/about")} & rows


def test_mounted_routes(spark):
    mounts = spark.createDataFrame([("p", "root", "/blog/", "blog"), ("p", "blog", "old/", "archive")], "project string, module string, prefix string, included string")
    children = spark.createDataFrame([("p", "archive", "list"), ("p", "root", "home")], "project string, module string, pattern string")
    assert sorted(r.pattern for r in structure.mount_includes(mounts, children).collect()) == ["/blog/old/list", "/home"]


def test_projects_and_frameworks(spark):
    f = described(spark, *[(f"src/f{i}.js", "x()") for i in range(25)], ("package.json", '{"dependencies": {"react": "^18.0.0", "left": "*"}}'), ("index.html", "<!doctype html>"), ("robots.txt", "User-agent: *\nDisallow: /\n"))
    got = ids(structure.project_findings(f, code.routes(f)))
    assert {"QUAL-NO-README", "SEC-NO-GITIGNORE", "QUAL-NO-TESTS", "DEP-NO-LOCKFILE", "SEO-SPA-NO-SSR", "SEO-ROBOTS-BLOCK-ALL", "SEO-SITEMAP-MISSING", "QUAL-NO-TEST-SCRIPT", "PERF-NO-BUILD-STEP"} <= set(got)
    assert [r.framework for r in structure.detect_frameworks(f).collect()] == ["react"]


def test_dependencies(spark):
    f = described(spark, ("package.json", '{"dependencies": {"lodash": "^4.17.11", "request": "2.0.0", "never": "*"}}'), ("a.js", "import x from 'lodash'; require('request')"))
    installed = spark.createDataFrame([("p", "lodash", "4.17.11", "npm", True, True, None), ("p", "lodash", "^4.0.0", "npm", False, True, None), ("p", "safe", None, "npm", False, True, None)], "project string, name string, version string, ecosystem string, exact boolean, direct boolean, recorded_at timestamp")
    rows = dependencies.findings(f, installed).collect()
    assert {"DEP-DEPRECATED", "DEP-UNPINNED", "DEP-UNUSED", "DEP-VULNERABLE", "DEP-NO-OSV-SYNC", "PERF-HEAVY-DEPENDENCY"} <= {r.rule_id for r in rows}
    advisories = spark.createDataFrame([("A", "npm", "lodash", 9.8, None, None, None, [("0", "4.17.21", None)])], dependencies.ADVISORY)
    hit = dependencies.vulnerable(dependencies.resolved(installed), advisories).first()
    assert (hit.name, hit.severity, hit.fixed) == ("lodash", "critical", "4.17.21")


def test_crawl(spark):
    pages_ = spark.createDataFrame(
        [
            ("p", "http://s.fr/", "http://s.fr/", 0, 200, True, None, "text/html", 900.0, 90000, {"server": "nginx/1.2"}, [], [("http://x.fr/a", "link", True)], "T", "http://s.fr/other", "noindex", 0, 10),
            ("p", "http://s.fr/a", "http://s.fr/b", 1, 200, True, None, "text/html", 10.0, 10, {}, [("a", "b", 302), ("b", "c", 301)], [], "T", None, None, 1, 300),
            ("p", "http://s.fr/gone", "http://s.fr/gone", 1, 404, False, None, "text/html", 5.0, 1, {}, [], [], None, None, None, 0, 0),
            ("p", "http://s.fr/err", "http://s.fr/err", 1, 500, False, None, "text/html", 5.0, 1, {}, [], [], None, None, None, 0, 0),
        ],
        crawl.PAGE,
    )
    robots = spark.createDataFrame([("p", 200, "User-agent: *\nDisallow: /a\nAllow: /a/b\n")], crawl.ROBOTS)
    got = set(ids(crawl.page_findings(pages_, robots)))
    assert {"CRAWL-BROKEN-PAGE", "CRAWL-SERVER-ERROR", "CRAWL-REDIRECT-CHAIN", "CRAWL-TEMPORARY-REDIRECT", "CRAWL-EMPTY-HTML", "CRAWL-NOINDEX-LIVE", "CRAWL-CANONICAL-MISMATCH", "CRAWL-DUPLICATE-TITLE", "CRAWL-SLOW-RESPONSE", "CRAWL-NO-COMPRESSION", "CRAWL-HEADER-CONTENT-SECURITY-POLICY", "CRAWL-VERSION-DISCLOSURE", "CRAWL-NO-HTTPS", "CRAWL-ROBOTS-NO-SITEMAP", "CRAWL-ROBOTS-BLOCKED"} <= got
    assert crawl.crawl_summary(pages_).first().median_ttfb == 10.0
    links = spark.createDataFrame([("p", "http://s.fr/", "http://s.fr/a"), ("p", "http://s.fr/a", "http://s.fr/b#x"), ("p", "http://s.fr/b", "http://s.fr/")], "project string, source string, target string")
    reach = crawl.frontier(links, spark.createDataFrame([("p", "http://s.fr/")], "project string, url string"), depth=2)
    assert sorted((r.url, r.depth) for r in reach.collect()) == [("http://s.fr", 0), ("http://s.fr/a", 1), ("http://s.fr/b", 2)]


def test_loads(spark):
    m = spark.createDataFrame([("p", "/", False, 4100.0, 0.2, 900.0, 6 * 1024 * 1024, 90, [("/big.js", "js", 600 * 1024)]), ("p", "/ok", False, 0.0, 0.0, 0.0, 10, 1, [])], crawl.MEASUREMENT)
    got = {(r.rule_id, r.severity) for r in crawl.load_findings(m).collect()}
    assert got == {("PERF-LCP-LENT", "high"), ("PERF-CLS-INSTABLE", "medium"), ("PERF-TTFB-LENT", "low"), ("PERF-POIDS-TOTAL", "medium"), ("PERF-REQUETES-NOMBREUSES", "low"), ("PERF-RESSOURCE-LOURDE", "medium")}


def test_fixes(spark):
    html = '<html><head></head><body><a href="x" target="_blank">a</a><img src="1"><img src="2"><label>N</label><input name="email" type="email"></body></html>'
    f = described(spark, ("a.html", html), ("b.js", "f();\n  debugger;\ng();\n"), ("c.css", "@font-face { src: x }"))
    after = {r.file: r.after for r in fixes.fixed_files(f, fixes.plan(f)).collect()}
    assert 'rel="noopener"' in after["a.html"] and after["a.html"].count('loading="lazy"') == 1 and '<meta charset="utf-8">' in after["a.html"] and 'for="email"' in after["a.html"] and 'autocomplete="email"' in after["a.html"]
    assert after["b.js"] == "f();\ng();\n" and "font-display: swap" in after["c.css"]
    again = described(spark, *after.items())
    assert fixes.fixed_files(again, fixes.plan(again)).count() == 0


def test_overlapping_edits(spark):
    edits = "array(named_struct('start', 0, 'end', 2, 'order', 0, 'replacement', 'X'), named_struct('start', 1, 'end', 3, 'order', 0, 'replacement', 'Y'), named_struct('start', 4, 'end', 4, 'order', 0, 'replacement', '!'))"
    assert spark.range(1).select(fixes.apply_edits(F.lit("abcdef"), F.expr(edits)).alias("x")).first().x == "aYd!ef"


def test_empty_inputs(spark):
    f = described(spark)
    assert scan.pattern_findings(f).count() == pages.page_findings(f).count() == styles.style_findings(f).count() == structure.quality_findings(f, Config()).count() == 0
