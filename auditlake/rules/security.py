"""Security rules, one section a weakness class of the CWE list.

A rule is a place the manuals of a language or framework name (a call, a setting, a property) and a
test of what stands there: the arguments are parted at their commas and judged one by one, so a
command given as a list, a keyword of another call or a value inside a literal are told apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from auditlake.rules.rule import Rule
from auditlake.rules.sites import FROM_REQUEST, Site

SERVER = "js python php ruby jvm go"


def _any(names: Iterable[str]) -> str:
    return "|".join(re.escape(n) for n in names)


def function(*names: str) -> str:
    """A call of a function that is no method."""
    return rf"(?<![\w$.>:])(?:{_any(names)})\s*\("


def call(*names: str) -> str:
    """A call of a function or of a method of any receiver."""
    return rf"(?<![\w$])(?:{_any(names)})\s*\("


def method(*names: str) -> str:
    return rf"(?:\.|->)\s*(?:{_any(names)})\s*\("


def setting(names: Iterable[str], values: str, end: str = r"(?![\w.])") -> str:
    """A key with one of some values, as assignment, mapping entry, keyword or item of a configuration file."""
    return rf"(?<![\w$-])(?:{_any(names)})[\"']?\s*\]?\s*(?:=>|[:=])\s*(?:{values}){end}"


# --- CWE-94, CWE-95: code made from data

CODE = [
    Rule("SEC-EVAL", "high", "js python php ruby", function("eval"), "Dynamic evaluation of code", need=("eval",), flow=True),
    Rule("SEC-FUNCTION-CTOR", "high", "js", r"\bnew\s+Function\s*\(", "Function built from a string", need=("function",)),
]

# --- CWE-78: commands

#: Calls that hand a command line to a shell: Node child_process, Python os, PHP and Ruby core, Java Runtime.
SHELL_CALLS = ("exec", "execSync", "spawnSync", "system", "popen", "shell_exec", "passthru")


def _shell_line(site: Site) -> bool:
    # in JavaScript the expression object has a method of the same name
    expression = site.family == "js" and re.search(r"(?:/[a-z]*|(?i:re|regexp?|pattern)\w*)\.$", site.receiver)
    return not expression and site.first_is_built


COMMANDS = [
    Rule("SEC-EXEC-SHELL", "critical", SERVER, call(*SHELL_CALLS), "Shell command built from values", test=_shell_line, need=("exec", "system", "popen", "passthru", "spawnsync")),
    Rule("SEC-SHELL-TRUE", "high", "python", r"\bsubprocess\s*\.\s*\w+\s*\(", "Subprocess through a shell", test=lambda s: s.keyword("shell") == "True", need=("subprocess",)),
]

# --- CWE-89, CWE-943: queries

#: The word that makes a statement complete behind its first one.
STATEMENTS = {"select": "from", "insert": "into", "update": "set", "delete": "from"}
_OPENING = r"[\"'`](?=[^\"'`\n]*\b(?i:" + "|".join(STATEMENTS) + r")\b)"
_VERB = re.compile(r"\b(" + "|".join(STATEMENTS) + r")\b", re.I)
#: How a value enters: a closing quote with an operator and a value, a template hole, a format mark.
_ENTRY = re.compile(r"[\"'`]\s*(?:[+.]\s*[\w$(]|%\s*[\w(])|\$\{|%\(|%s|\|\||#\{")
#: Characters of a statement behind its second word within which a value must enter.
REACH = 200


def _query_built(site: Site) -> bool:
    m = _VERB.search(site.text, site.end, site.line_end)
    if not m:
        return False
    line = site.text[m.end() : site.line_end]
    second = re.search(rf"\b{STATEMENTS[m[1].lower()]}\b", line, re.I)
    if not second or re.search(r"[\"'`]", line[: second.start()]):
        return False
    tail = line[second.end() : second.end() + REACH]
    entry = _ENTRY.search(tail)
    template = re.search(r"(?<!\w)[fF][rR]?$", site.text[max(0, site.start - 3) : site.start]) and re.search(r"\{\w", tail)
    return bool(template or (entry and ";" not in tail[: entry.start()]))


QUERIES = [
    Rule("SEC-SQL-CONCAT", "critical", "*", _OPENING, "Query put together from values", raw=True, test=_query_built, need=tuple(STATEMENTS), flow=True),
    Rule("SEC-SQL-RAW", "medium", "*", method("raw", "rawQuery", "$executeRawUnsafe", "$queryRawUnsafe", "executeRawUnsafe", "queryRawUnsafe", "extra"), "Raw query", test=lambda s: s.first_is_literal, need=("raw", "extra"), confidence="tentative"),
    Rule("SEC-NOSQL-WHERE", "high", "js python", setting(["$where"], r"(?=\S)", ""), "Code in a document query", raw=True, need=("$where",), flow=True),
]

# --- CWE-79, CWE-116: output

MARKUP = [
    Rule("SEC-INNERHTML", "high", "js", r"\.\s*(?:inner|outer)HTML\s*\+?=(?!=)", "Markup assigned to an element", test=lambda s: s.assigned not in ("''", '""', "``"), need=("innerhtml", "outerhtml"), flow=True),
    Rule("SEC-DANGEROUS-HTML", "high", "js", r"\bdangerouslySetInnerHTML\b", "Raw markup in a component", need=("dangerouslysetinnerhtml",), flow=True),
    Rule("SEC-VUE-VHTML", "high", "js markup", r"(?<![\w-])v-html\s*=", "Raw markup in a template", raw=True, need=("v-html",)),
    Rule("SEC-DOC-WRITE", "medium", "js", r"\bdocument\s*\.\s*write(?:ln)?\s*\(", "Document rewritten by a script", need=("document",)),
    # one value put out as it is (Django and Jinja, Blade, PHP)
    Rule("SEC-TEMPLATE-AUTOESCAPE", "medium", "python php ruby markup", r"\|\s*safe\b|\{!!|(?<![\w.])mark_safe\s*\(|@php\s+echo\b", "Value put out without escaping", raw=True, need=("safe", "{!!", "@php")),
    # escaping off for a whole template or environment
    Rule("SEC-TEMPLATE-AUTOESCAPE", "high", "python php ruby markup", r"\bautoescape\s*(?:=\s*False\b|\s+(?:off|false)\b)", "Escaping switched off", raw=True, need=("autoescape",)),
]

# --- CWE-502: objects from bytes


def _yaml_unsafe(site: Site) -> bool:
    if not re.match(r"yaml", site.text[site.start : site.end]):
        return True
    return not re.search(r"\bC?(?:Safe|Base)Loader\b", site.text[site.end : site.close])


OBJECTS = [
    Rule("SEC-PICKLE", "critical", "python", r"(?<![\w.])(?:pickle|cPickle|marshal|yaml)\s*\.\s*loads?\s*\(", "Objects read from untrusted bytes", test=_yaml_unsafe, need=("pickle", "marshal", "yaml")),
    Rule("SEC-JAVA-DESERIALIZE", "critical", "jvm", r"(?<!\w)ObjectInputStream\s*\(", "Objects read from a stream", test=lambda s: s.receiver == "" and bool(s.spans), need=("objectinputstream",)),
    Rule("SEC-JAVA-DESERIALIZE", "critical", "jvm", method("readObject"), "Objects read from a stream", test=lambda s: not s.spans, need=("readobject",)),
    Rule("SEC-PHP-UNSERIALIZE", "critical", "php", function("unserialize"), "Objects read from a string", need=("unserialize",)),
]

# --- CWE-327, CWE-328, CWE-338: weak cryptography

#: Broken digests as they are called and as they are named to a factory.
DIGEST_CALLS, DIGEST_NAMES = ("md5", "sha1"), ("MD5", "SHA1", "SHA-1")
#: Ciphers with keys or blocks that are too short, and the mode that shows equal blocks.
SHORT_CIPHERS = ("DES", "3DES", "TripleDES", "DESede", "RC4", "Blowfish")
#: Generators that are seeded from the clock or whose state shows in their output.
GENERATORS = {"js": ("Math.random",), "python": ("random.random",), "php": ("rand", "mt_rand"), "ruby": ("rand",)}
# Words of a line that say the number guards nothing.
HARMLESS_RANDOM = "color colour anim delay jitter shuffle sample demo mock seed".split()

CRYPTO = [
    Rule("SEC-WEAK-HASH", "high", "*", rf"(?i)(?<!\w)(?:{_any(DIGEST_CALLS)})\s*\(|(?:[\"'])(?:{_any(DIGEST_NAMES)})[\"']", "Weak digest", raw=True, need=("md5", "sha1", "sha-1"), unless=r"(?i)gravatar|hashcode"),
    Rule("SEC-WEAK-CIPHER", "high", "*", rf"(?<!\w)(?:{_any(SHORT_CIPHERS)})(?!\w)|(?<!\w)MODE_ECB\b|(?i:\bAES(?:[-_/]\d{{3}})?[-_/]ECB\b)", "Weak cipher", raw=True, need=("des", "rc4", "blowfish", "ecb")),
    *[Rule("SEC-WEAK-RANDOM", "medium", family, function(*names), "Predictable random numbers", need=("rand",), unless="(?i)" + "|".join(HARMLESS_RANDOM), confidence="tentative") for family, names in GENERATORS.items()],
    Rule("SEC-WEAK-RANDOM", "medium", "jvm dotnet", r"\bnew\s+Random\s*\(", "Predictable random numbers", need=("random",), unless="(?i)" + "|".join(HARMLESS_RANDOM), confidence="tentative"),
]

# --- CWE-295, CWE-319, CWE-347: transport and signatures

#: Settings that switch the check of certificates off, with the value that does it.
UNCHECKED = (("rejectUnauthorized", "false"), ("verify", "False"), ("NODE_TLS_REJECT_UNAUTHORIZED", r"[\"']?0[\"']?"), ("InsecureSkipVerify", "true"))
#: Names that only serve to accept any host or certificate.
ACCEPTS_ALL = r"\bALLOW_ALL_HOSTNAME_VERIFIER\b|\bsetHostnameVerifier\s*\(|\bbadCertificateCallback\b"
#: Hosts that plain connections may name: this machine, private and reserved ranges (RFC 1918, RFC 2606).
LOCAL_HOSTS = re.compile(r"(?i)(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.0\.0\.0|\[|example\.|www\.example\.|.*\.(?:localhost|local|test|example|invalid|internal)$)")
#: Hosts whose addresses are names of schemas, never fetched.
SCHEMA_HOSTS = re.compile(r"(?i)(?:www\.)?w3\.org|schemas?\.|purl\.org|java\.sun\.com|xmlns\.")


def _plain_host(site: Site) -> bool:
    m = re.compile(r"[A-Za-z0-9][\w.-]*").match(site.text, site.end)
    return bool(m) and not LOCAL_HOSTS.match(m[0]) and not SCHEMA_HOSTS.match(m[0])


TRANSPORT = [
    Rule("SEC-TLS-DISABLED", "critical", "*", "|".join([setting([name], value) for name, value in UNCHECKED] + [ACCEPTS_ALL]), "Certificates not checked", raw=True, need=("rejectunauthorized", "verify", "node_tls", "insecureskip", "allow_all", "badcertificate", "sethostname")),
    Rule("SEC-HTTP-URL", "medium", "js python php ruby jvm go dart dotnet swift", r"[\"'`]http://", "Plain connection", raw=True, test=_plain_host, need=("http://",), unless=r"xmlns|DOCTYPE|namespace"),
    Rule("SEC-JWT-NONE", "critical", "*", "(?i:" + setting(["alg", "algorithm", "algorithms"], r"\[?\s*[\"']none[\"']") + ")|" + setting(["verify_signature"], "False|false"), "Signature of a token not checked", raw=True, need=("none", "verify_signature")),
    Rule("SEC-JWT-NONE", "critical", "python", r"\bjwt\s*\.\s*decode\s*\(", "Signature of a token not checked", test=lambda s: s.keyword("verify") == "False", need=("jwt",)),
]

# --- CWE-942, CWE-352, CWE-614, CWE-1004, CWE-1275: browsers

_STAR = r"\[?\s*[\"']\*[\"']"
#: Keys that list the origins a server admits.
ORIGINS = ("origin", "origins", "allow_origins", "allowedOrigins")


def _never_on(site: Site) -> bool:
    """Is the setting never switched on elsewhere in the file?"""
    name = re.match(r"\w+", site.text[site.start : site.end])
    return not re.search(rf"\b{name[0]}\s*=\s*True\b", site.text)


BROWSER = [
    Rule("SEC-CORS-WILDCARD", "high", "*", r"(?i:Access-Control-Allow-Origin)[\"']?\s*[,:=]\s*[\"']?\*|" + setting(ORIGINS, _STAR, "") + rf"|\b(?:{_any(ORIGINS)})\s*\(\s*[\"']\*[\"']", "Any origin allowed", raw=True, need=("origin",)),
    Rule("SEC-CORS-WILDCARD", "high", "js", function("cors"), "Any origin allowed", test=lambda s: not s.spans, need=("cors",)),
    Rule("SEC-CSRF-OFF", "high", "*", rf"(?i:{setting(['csrf', 'csrf_protection', 'csrfProtection'], 'false')})|@?\bcsrf_exempt\b|@CsrfExempt\b|\.csrf\s*\(\s*\)\s*\.\s*disable\s*\(|\bcsrf\s*\(\s*\w+\s*->\s*\w+\s*\.\s*disable\b", "Forgery protection switched off", need=("csrf",), unless=r"^\s*(?:import|from|use)\b"),
    Rule("SEC-ALLOWED-HOSTS-WILDCARD", "high", "python", r"\bALLOWED_HOSTS\s*\+?=\s*[\[(]", "Any host allowed", raw=True, test=lambda s: any(a.strip().strip("'\"") == "*" for a in s.text[s.end : s.close].split(",")), need=("allowed_hosts",)),
    Rule("SEC-SECURE-FLAG-OFF", "high", "python", setting([f"{p}_COOKIE_{n}" for p in ("SESSION", "CSRF") for n in ("SECURE", "HTTPONLY")], "False|0"), "Cookie setting switched off", raw=True, test=_never_on, need=("_cookie_",)),
    Rule("SEC-COOKIE-FLAGS", "medium", "*", "(?i:" + setting(("httpOnly", "http_only", "secure"), "false") + "|" + setting(("sameSite", "same_site"), r"[\"']?none") + ")", "Cookie without protection", raw=True, need=("httponly", "http_only", "secure", "samesite", "same_site")),
]

# --- CWE-732, CWE-22, CWE-918, CWE-601: resources

FILE_CALLS = ("readFile", "readFileSync", "createReadStream", "sendFile", "open", "file_get_contents", "fopen", "readfile", "include", "require", "File.read", "File.open", "Paths.get")
FETCH_CALLS = ("fetch", "axios", "got", "urlopen", "curl_init", "http.get", "https.get")
FETCH_OBJECTS = ("axios", "requests", "HttpClient", "RestTemplate")

RESOURCES = [
    Rule("SEC-PERMISSIVE-PERMS", "medium", "*", r"\bchmod\b(?=[^\n]{0,200}?(?<![\w.])0?o?777(?!\w))|\bFileMode\s*\(\s*0?o?777\b", "Files open to everyone", raw=True, need=("777",)),
    Rule("SEC-PATH-TRAVERSAL", "high", SERVER, call(*FILE_CALLS), "Path taken from the request", test=lambda s: s.takes_request, need=("req", "params", "$_", "ctx"), flow=True),
    Rule("SEC-SSRF", "high", SERVER, call(*FETCH_CALLS) + rf"|(?<![\w$])(?:{_any(FETCH_OBJECTS)})\s*\.\s*\w+\s*\(", "Address taken from the request", test=lambda s: s.takes_request, need=("req", "params", "$_", "ctx"), flow=True),
    Rule("SEC-OPEN-REDIRECT", "medium", "js python php ruby jvm", r"\b[rR]edirect\w*\s*\(|(?<![\w$])header\s*\(", "Redirect to an address of the request", test=lambda s: s.takes_request and (not s.text.startswith("header", s.start) or bool(re.match(r"[\"']location:", s.argument(0), re.I))), need=("redirect", "location")),
    Rule("SEC-OPEN-REDIRECT", "medium", "js", r"\blocation(?:\.href)?\s*=(?!=)", "Redirect to an address of the request", test=lambda s: bool(FROM_REQUEST.search(s.assigned)), need=("location",)),
]

# --- CWE-489, CWE-1327, CWE-532, CWE-390: operation

#: Calls that write a log.
LOG_CALLS = ("print", "println", "printf", "error_log", "NSLog", "debugPrint")
# Words in the name of a secret.
SECRET_NAMES = re.compile(r"(?i)passw(?:or)?d|secret|token|credential|api_?key")

OPERATION = [
    Rule("SEC-DEBUG-ON", "medium", "*", rf"{setting(['DEBUG'], 'True')}|{setting(['APP_DEBUG', 'debug'], 'true')}", "Debug mode", raw=True, need=("debug",), unless=r"(?i)//|test|mock|story", confidence="tentative"),
    Rule("SEC-DEBUG-ON", "medium", "python", method("run"), "Debug mode", test=lambda s: s.keyword("debug") == "True", need=("debug",), unless=r"(?i)//|test|mock|story", confidence="tentative"),
    Rule("SEC-BIND-ALL", "low", "*", setting(["host"], r"[\"']0\.0\.0\.0[\"']"), "Listens on every interface", raw=True, need=("0.0.0.0",), confidence="tentative"),
    Rule("SEC-BIND-ALL", "low", "js", method("listen"), "Listens on every interface", test=lambda s: s.argument(1).strip("'\"`") == "0.0.0.0", need=("0.0.0.0",), confidence="tentative"),
    Rule("SEC-LOG-SENSITIVE", "medium", "*", rf"\b(?:console|log|logger|logging)\s*\.\s*\w+\s*\(|{function(*LOG_CALLS)}", "Secret in a log", test=lambda s: bool(SECRET_NAMES.search(s.masked, s.end, s.close)), need=("password", "passwd", "secret", "token", "credential", "apikey", "api_key")),
    Rule("SEC-EMPTY-CATCH", "low", "js jvm php dart dotnet", r"\bcatch\s*(?:\([^(){}]*\)\s*)?\{\s*\}", "Error swallowed", raw=True, need=("catch",)),
]

# --- CWE-1321, CWE-915, CWE-611, CWE-1333: structures from outside

_OUTSIDE_KEY = re.compile(r"^(?:req|request|key|body|query|params|input)\b")


def _outside_key(site: Site) -> bool:
    close = site.pairs.get(site.end - 1)
    return close is not None and bool(_OUTSIDE_KEY.match(site.masked[site.end : close].strip())) and bool(re.compile(r"\s*=(?![=>])").match(site.masked, close + 1))


def _nested_repeat(site: Site) -> bool:
    """Is a group that ends in a repetition repeated as a whole? The bracket must be that of a group."""
    depth, at = 0, site.start
    while at >= 0 and site.text[at] != "\n":
        if site.text[at] in "()" and (at == 0 or site.text[at - 1] != "\\"):
            depth += 1 if site.text[at] == ")" else -1
            if depth == 0:
                return True
        at -= 1
    return False


_WHOLE_BODY = re.compile(r"(?:req|request)\s*\.\s*(?:body|data|POST)|\$?request\s*(?:\.|->)\s*all\s*\(\s*\)|params")

STRUCTURES = [
    Rule("SEC-PROTOTYPE-POLLUTION", "high", "js", r"(?<=[\w$)\]])\[", "Keys of an object from outside", test=_outside_key, need=("req", "key", "body", "query", "params", "input"), confidence="tentative"),
    Rule("SEC-PROTOTYPE-POLLUTION", "high", "js", r"\bObject\s*\.\s*assign\s*\(|" + call("merge", "extend"), "Keys of an object from outside", test=lambda s: bool(re.search(r"\breq\s*\.\s*body\b|\bJSON\s*\.\s*parse\b", s.masked[s.end : s.close])), need=("assign", "merge", "extend"), confidence="tentative"),
    Rule("SEC-MASS-ASSIGNMENT", "medium", "js php ruby python", call("create", "update", "updateOrCreate", "fill", "save", "new"), "Whole request stored", test=lambda s: any(_WHOLE_BODY.fullmatch(s.text[a:b].strip()) for a, b in s.spans), need=("req", "params")),
    Rule("SEC-XXE", "high", "jvm", r"\b(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\s*\.\s*newInstance\s*\(", "Parser that follows external entities", unless_file=r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING|SUPPORT_DTD|external-general-entities", need=("newinstance",), confidence="tentative"),
    Rule("SEC-XXE", "high", "php", r"(?<![\w$])simplexml_load_(?:file|string)\s*\(", "Parser that follows external entities", unless_file=r"libxml_disable_entity_loader", need=("simplexml",), confidence="tentative"),
    Rule("SEC-XXE", "high", "python", r"\betree\s*\.\s*(?:parse|fromstring)\s*\(", "Parser that follows external entities", unless_file=r"defusedxml|resolve_entities\s*=\s*False", need=("etree",), confidence="tentative"),
    Rule("SEC-XXE", "high", "dotnet", r"\bnew\s+XmlDocument\s*\(", "Parser that follows external entities", unless_file=r"XmlResolver\s*=\s*null|DtdProcessing\s*\.\s*Prohibit", need=("xmldocument",), confidence="tentative"),
    Rule("SEC-REGEX-DOS", "medium", "*", r"\)[*+](?!\?)(?<=[*+]\)[*+])", "Nested repetition in an expression", raw=True, test=_nested_repeat, only_file=r"RegExp|\bre\.\w+\s*\(|/[^/\n]+/[a-z]*|preg_|Pattern\.compile|Regex", need=("+)+", "*)*", "+)*", "*)+"), confidence="tentative"),
]

# --- images and committed settings

CONFIGURATION = [
    Rule("SEC-DOCKER-LATEST", "low", "docker", r"^[ \t]*FROM[ \t]+", "Image without a fixed version", raw=True, per="first", test=lambda s: s.text[s.end : s.line_end].split()[:1] != [] and s.text[s.end : s.line_end].split()[0].endswith(":latest"), need=("latest",), effort="rapide"),
    Rule("SEC-DOCKER-ROOT", "medium", "docker", r"^FROM\s+\S+", "Container runs as root", raw=True, per="first", need=("from",), unless_file=r"(?m)^USER\s+(?!root\b|0\b)\S+"),
    Rule("SEC-ENV-COMMITTED", "critical", "dotenv", r"^[^#\n=]*=\s*\S", "Environment file in the repository", raw=True, per="first", path=r"(^|/)\.env(?!.*\.(?:example|sample|template|dist|md|txt)$)[^/]*$", need=("=",)),
    Rule("SEC-GITIGNORE-ENV", "medium", "gitignore", r"\A", "Environment files not ignored", raw=True, per="first", unless_file=r"\.env"),
]

SECURITY = [*CODE, *COMMANDS, *QUERIES, *MARKUP, *OBJECTS, *CRYPTO, *TRANSPORT, *BROWSER, *RESOURCES, *OPERATION, *STRUCTURES]
