"""Credentials embedded in source code, configuration and reported snippets.

YAML, JSON, TOML, INI, properties and dotenv files are read as key paths and values by a stack of
what is open; every text is read line by line for literal values with the place of each: assignments, mappings,
attributes, dotenv and YAML lines, setter and define calls, name/value pairs, header and command
arguments, pieces joined on one line. A value is a credential when its key path ends in a
sensitive name and its shape is that of a secret, or when its own shape says so (provider tokens,
signed tokens, private keys, URLs and connection strings with a password). Redaction splices the
original text at those places and leaves every other character alone.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published token shapes of providers.
_PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:"
    r"A(?:KI|SI|RO)A[0-9A-Z]{16}(?![0-9A-Za-z*])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{30,}"
    r"|gl(?:pat|dt|rt|soat|ptt)-[A-Za-z0-9_\-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{16,}"
    r"|xapp-[A-Za-z0-9\-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|whsec_[A-Za-z0-9+/=]{16,}"
    r"|sk-(?:ant-|proj-|svcacct-|or-)?[A-Za-z0-9_\-]{24,}"
    r"|AIza[A-Za-z0-9_\-]{30,}"
    r"|ya29\.[A-Za-z0-9_\-]{20,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|key-[0-9a-f]{32}(?![0-9a-f])"
    r"|SK[0-9a-f]{32}(?![0-9a-f])"
    r"|hf_[A-Za-z0-9]{30,}|shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}|dop_v1_[0-9a-f]{60,}|pypi-[A-Za-z0-9_\-]{40,}|dckr_pat_[A-Za-z0-9_\-]{20,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")"
)
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL_LOGIN = re.compile(r"(?<![A-Za-z0-9+.\-])(?=[0-9+.\-]*[A-Za-z])[A-Za-z0-9+.\-]++://[^\s:/@\"'`<>]*:(?P<v>[^\s/\"'`<>]+?)@(?=[A-Za-z0-9\[_.${%\-])")
_CONNECTION = re.compile(r"(?i)(?:^|[;\"'`\s])(?:password|pwd|accountkey|sharedaccesskey)\s*=\s*(?P<v>[^;\"'`\s]+)(?=\s*[;\"'`])")
_HEADER = re.compile(r"(?i)\b(?P<k>bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/=_.\-~]{12,})(?P<cut>…|\.\.\.)?")
_SQL = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\S+\s+)?by|(?:with\s+)?(?:encrypted\s+)?password)\s*=?\s*'(?P<v>[^'\s]+)'")
_LOGIN_FLAG = re.compile(r"(?:^|\s)(?:-u|--user)[ =]?['\"]?[\w.\-]+:(?P<v>[^\s'\"]+)|(?:^|\s)--?(?:password|passwd|pass|token|api-key|secret)[ =]['\"]?(?P<w>[^\s'\"]+)")

#: Words that end the name of a secret, joined in lower case, in several languages.
SENSITIVE = (
    "password passwd passwort passphrase pass pwd pw secret token apikey accesskey privatekey secretkey authkey signingkey encryptionkey "
    "masterkey accountkey sharedkey authtoken accesstoken credential credentials contrasena contraseña clave motdepasse mdp kennwort "
    "senha parola wachtwoord haslo пароль 密码 密碼 パスワード 비밀번호"
).split()
_ENDS = re.compile(r"(?:" + "|".join(sorted(SENSITIVE, key=len, reverse=True)) + r")$")
#: A sensitive last word that is only a part of another word does not count: compass, bypass.
_WHOLE = {"pass", "pw", "token", "clave", "secret", "mdp"}
_WORDS = re.compile(r"[A-Z]+(?![a-zñ])|[A-Z]?[a-zñ]+|[^\W\d_A-Za-zñ]+")

#: What a line must hold at all, in lower case; one automaton finds them in one pass.
HINTS = (
    "pass secret token pwd mdp key credential contrase clave kennwort senha parola wachtwoord haslo пароль 密码 密碼 パスワード 비밀번호 "
    "bearer basic identified ://  akia asia aroa ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- gldt- glrt- glsoat- glptt- xox xapp- sk_live sk_test rk_live rk_test "
    "whsec_ sk- aiza ya29. sg. npm_ hf_ shp dop_v1 pypi- dckr_ eyj --user stringdata"
).split() + ["-u"]
_HINT = ahocorasick.Automaton()
for _word in [*HINTS, *SENSITIVE]:
    _HINT.add_word(_word, len(_word))
for _digit in "0123456789abcdef":
    _HINT.add_word("sk" + _digit, 3)
_HINT.make_automaton()


def _hints(text: str) -> list[int]:
    """Where hints end in the text and, with the glue between pieces left out, in what they make together."""
    ends = list(_ends(text))
    glue = [m.span() for m in _GLUE.finditer(text)]
    if not glue:
        return ends
    pieces, starts, shifts, at, out = [], [], [], 0, 0
    for a, b in [*glue, (len(text), len(text))]:
        pieces.append(text[at:a])
        starts.append(out)
        shifts.append(at - out)
        out += a - at
        at = b
    glued = (i + shifts[bisect_right(starts, i) - 1] for i in _ends("".join(pieces)))
    return sorted({*ends, *glued})


def _ends(text: str) -> Iterator[int]:
    """Where hints end; lower-casing that would move places (rare capitals) is done letter by letter."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for end, _ in _HINT.iter(low):
        yield end


#: A line longer than this (minified code) is read in windows around its hints, so its cost stays in proportion.
LONG_LINE, BEFORE, AFTER = 1_000, 200, 2_400
#: What a window is extended by at its end: the rest of a value without space, and pieces glued to it.
_REST = re.compile(r"(?:[^\s\"'`\\]|\\.)*+[\"'`]?(?:[ \t]*(?:\+|\.{1,2}|&|\|\||~)?[ \t]*[\"'`](?:[^\s\"'`\\]|\\.)*+[\"'`])*+")

_Q = r"(?:\"(?P<{0}d>(?:[^\"\\\n]|\\.)*)\"|'(?P<{0}s>(?:[^'\\\n]|\\.)*)'|`(?P<{0}b>[^`\n]*)`)"
_NAME = r"(?<![\w.\-])[$@]?[A-Za-z_\u00c0-\U0010ffff][\w\u00c0-\U0010ffff.\-]*+"
#: key, operator, quoted value; the key may be quoted, indexed or typed (``token: string = "…"``).
_PAIR = re.compile(
    r"(?P<k>" + _NAME + r")(?:\\?[\"'`]?\]?\)?\s*(?:\w*\s*:\s*[A-Za-z<>\[\]|? ]{1,24}?)?)\s*(?:=>|:=|\?\?=|\|\|=|===?|!==?|[:=,]|->|\bwas\b|\bis\b|\bnow\b)\s*(?:[brfuLR@]{1,2}(?=[\"']))?" + _Q.format("v")
)
_CALL = re.compile(r"(?P<k>" + _NAME + r")\s*\(\s*" + _Q.format("v") + r"\s*[,)]")
_ATTR = re.compile(r"(?i)\b(?:name|id|key)\s*=\s*[\"'](?P<k>[\w.\-]+)[\"'][^<>]*?\bvalue\s*=\s*" + _Q.format("v"))
_XML = re.compile(r"<(?P<k>[A-Za-z][\w.\-]*)>(?P<v>[^<>\s]+)</")
_BARE = re.compile(r"^\s*(?:-\s+)?(?:export\s+|set\s+|ENV\s+)?(?P<q>[\"']?)(?P<k>//[\w.\-/:]*:_?\w+|[A-Za-z_\u00c0-\U0010ffff][\w\u00c0-\U0010ffff.\-]*)(?P=q)\s*(?P<op>[:=])(?P<gap>\s*)(?P<v>[^\s\"'`][^\s\"'`]*)")
_PROSE = re.compile(r"(?i)(?P<k>" + _NAME + r")\s*(?::|=|\bis\b|\bwas\b)\s*(?P<v>[^\s\"'`<>,;)]{6,})")
_ENV_DEFAULT = re.compile(r"(?i)(?:getenv|environ(?:\.get)?|ENV(?:\.fetch)?|process\.env)\b[^;,|?]*?[\(\[.][\"']?(?P<k>\w+)[\"']?[\)\]]?\s*(?:,|\|\||\?\?|\bor\b)\s*" + _Q.format("v"))
_YAML_NAME = re.compile(r"^\s*-?\s*\"?(?:name|key)\"?\s*:\s*[\"']?(?P<k>[\w.\-]+)[\"']?\s*,?\s*$")
_YAML_VALUE = re.compile(r"^\s*\"?value\"?\s*:\s*(?:" + _Q.format("v") + r"|(?P<v>[^\s\"'#]+))")
_OPEN = re.compile(r"(?P<k>" + _NAME + r")[\"']?\s*(?::\s*[A-Za-z<>\[\]|? ]{1,24}\s*)?(?:=>|:=|[:=(])\s*(?:\\|\|-?|>-?|\()?\s*$")
_ALONE = re.compile(r"^\s*(?:[+.]\s*)?" + _Q.format("v"))
_ALONE_BARE = re.compile(r"^\s+(?P<v>[^\s\"'`]+)\s*$")
_GLUE = re.compile(r"(?P<q>[\"'`])\s*(?:\+|\.{1,2}|&|\|\||~)\s*(?P=q)|(?P<r>\"|')\s+(?P=r)(?=[A-Za-z0-9])")
_COMMENT = re.compile(r"^\s*(?:[-+>]\s+)?(?:\d+:\s*)?(?://|#|/\*|\*|<!--|--|;)")

_REFERENCE = re.compile(r"^\s*[$<{@%!&]|\$\{|\{\{|\$\(|\}\}|<%|^process\.|^(?:env|vault|secret|secrets|ref|ref\+\w+|arn|ssm|op|kms|aws-sm|gcp-sm|file|config|os|System|ENV|getenv)[:.\[(/]|\(\)$|^%\w+%$|^__\w+__$|^\[\w+\]$")
_MASKED = re.compile(r"\*{3}|[•●█]{2}|x{5}|X{5}|\.{3}$|…|^#+$|^-+$|^\?+$|^0+$")
#: Words of placeholders, in several languages.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:your|votre|vos|tu|su|ihr|dein|mein|my|the|some|il-tuo|seu)[-_ ]|change[-_]?me|replace[-_ ]?me|replace[-_ ]|to[-_]?do|fix[-_]?me|placeholder|example|exemple|beispiel"
    r"|dummy|insert[-_ ]|[-_ ]here$|redacted|masked|hidden|removed|set[-_ ]in|set[-_]by|fill[-_ ]?in|^(?:none|null|nil|undefined|true|false|yes|no|on|off|n/?a|tbd|empty|default|string|optional|required)$|sample|not[-_ ]set|goes[-_ ]here"
)
_LABEL = re.compile(r"^[a-zà-ÿ]+(?:[_\-. ][a-zà-ÿ]+)*$|^[A-Z]?[a-zà-ÿ]+(?:[A-Z][a-zà-ÿ]+)*$|^[A-Z]+(?:_[A-Z]+)*$|^[\w]+\[\w+\]$|^[A-ZÀ-Ý]?[^\W\d_]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5)[-:]")
_CODE_REF = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*[\[(;].*$|^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$]+)+$")
_PATH = re.compile(r"^(?:\.{0,2}/|[A-Za-z]:\\|~/)|^[a-z]+://[^@]*$")
_CONFIG = re.compile(r"(?i)(?:^|/)(?:\.env[\w.\-]*|\.npmrc|\.netrc|\.pgpass|\.htpasswd|dockerfile[\w.\-]*)$|\.(?:env|ya?ml|properties|ini|cfg|conf|toml|tf|tfvars|sh|bash|zsh|local|npmrc)$")


def sensitive(key: str) -> bool:
    """Does a key path end in the name of a secret? ``cargoMotDePasse`` does, ``token_type`` does not."""
    words = [w.lower() for w in _WORDS.findall(key)]
    if not words:
        return False
    joined = "".join(words[-4:])
    m = _ENDS.search(joined)
    if not m:
        return False
    if words[0] in ("public", "publishable") or any(w in ("public", "publishable") for w in words[-3:]):
        return False
    name = m[0]
    if name in _WHOLE:
        return words[-1] in (name, name + "s") or words[-1].endswith(("token", "secret"))
    if words[-1] in ("key", "keys"):
        return len(words) > 1
    return True


def secret_value(v: str, bare: bool = False) -> bool:
    """Has a literal the shape of a secret: not empty, masked, a placeholder, a reference or a label?"""
    v = v.strip()
    if len(v) < 5 or len(set(v)) < 4 or re.search(r"\s", v):
        return False
    if _REFERENCE.search(v) or _MASKED.search(v) or _PLACEHOLDER.search(v) or _UUID.match(v) or _DIGEST.match(v) or _PATH.match(v):
        return False
    if v.startswith("^") or "(?" in v or "://" in v and not _URL_LOGIN.search(v):
        return False
    if _LABEL.match(v) and not _random(v):
        return False
    return not (bare and _CODE_REF.match(v) and not re.search(r"\d", v))


# Passwords that published lists of the commonest ones begin with, and function words of phrases.
WEAK = frozenset(
    "1234 12345 123456 1234567 12345678 123456789 1234567890 111111 000000 123123 654321 666666 696969 987654321 abc123 abcd abcd1234 admin admin1 admin123 administrator azerty baseball batman dragon football freedom guest hello hunter hunter2 "
    "iloveyou jordan killer letmein login1 lovely master michael monkey mustang ninja passw0rd p@ssw0rd password1 password123 princess qazwsx qwerty qwerty123 qwertyuiop root shadow starwars sunshine superman toor trustno1 welcome welcome1 whatever zaq1zaq1 motdepasse1 passwort1".split()
)
_FUNCTION_WORDS = frozenset("a an and are at be can cannot does for from has have in is it least must may more most needs not of on only or required should than that the to was will with without your de la le les des du et est ne pas un une der die das ein eine ist nicht muss und zu el los las es no por para que il lo di da non".split())
_PASSWORDS = re.compile(r"(?:password|passwd|passwort|passphrase|pass|pwd|pw|contrasena|contraseña|motdepasse|mdp|kennwort|senha|parola|wachtwoord|haslo|пароль|密码|密碼|パスワード|비밀번호)$")


def _secret(key: str, v: str, bare: bool = False) -> bool:
    """Is a value under a sensitive key a secret? Passwords may be weak ones of the lists, passphrases words with spaces between."""
    if secret_value(v, bare):
        return True
    words = [w.lower() for w in _WORDS.findall(key)]
    if not _PASSWORDS.search("".join(words[-4:])):
        return False
    if v.lower() in WEAK:
        return True
    if _REFERENCE.search(v) or _MASKED.search(v) or _PLACEHOLDER.search(v):
        return False
    parts = v.split()
    return words[-1] in ("passphrase", "phrase") and len(parts) >= 3 and all(re.fullmatch(r"[a-zà-ÿ]{3,}|\d+", p) and p not in _FUNCTION_WORDS for p in parts)


def _random(v: str) -> bool:
    """Letters that no word would have: long and of changing case."""
    flips = sum(a.islower() != b.islower() for a, b in zip(v, v[1:], strict=False))
    return len(v) >= 10 and flips * 25 >= 9 * len(v)


def _body_ok(token: str) -> bool:
    body = re.sub(r"^[A-Za-z]+[-_.]", "", token)
    return len(set(body)) >= 6 and not _MASKED.search(token) and not _PLACEHOLDER.search(body)


def _basic_ok(v: str) -> bool:
    try:
        text = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    name, colon, password = text.partition(":")
    return bool(colon and len(password) >= 4 and not _MASKED.search(password) and not _REFERENCE.search(password))


def _value(m: re.Match, prefix: str = "v") -> tuple[int, int, str] | None:
    for kind in "dsb":
        if (v := m[prefix + kind]) is not None:
            return m.start(prefix + kind), m.end(prefix + kind), v
    return None


def _joined(line: str) -> tuple[str, list[int] | None]:
    """The line with the glue between literal pieces left out, and where each character stood."""
    if not _GLUE.search(line):
        return line, None
    out, places, at = [], [], 0
    for m in _GLUE.finditer(line):
        out.append(line[at : m.start()])
        places.extend(range(at, m.start()))
        at = m.end()
    out.append(line[at:])
    places.extend(range(at, len(line) + 1))
    return "".join(out), places


_ENTITY = re.compile(r"&(?:quot|apos|#39|#x27|#34|amp|lt|gt);")
_ENTITIES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#34;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}


def _unescaped(line: str) -> tuple[str, list[int] | None]:
    if "&" not in line or not _ENTITY.search(line):
        return line, None
    out, places, at = [], [], 0
    for m in _ENTITY.finditer(line):
        out.append(line[at : m.start()])
        places.extend(range(at, m.start()))
        out.append(_ENTITIES[m[0]])
        places.append(m.start())
        at = m.end()
    out.append(line[at:])
    places.extend(range(at, len(line) + 1))
    return "".join(out), places


def _in_line(line: str, config: bool, key_above: str | None) -> Iterator[tuple[int, int]]:
    """Places of the credentials of one line; ``key_above`` is the sensitive key a line above left open."""
    for m in _PROVIDER.finditer(line):
        if _body_ok(m[0]):
            yield m.span()
    for m in _URL_LOGIN.finditer(line):
        v = m["v"]
        if len(v) >= 3 and not (_REFERENCE.search(v) or _MASKED.search(v) or _PLACEHOLDER.search(v)) and not re.fullmatch(r"(?i)pass(?:word|wd)?|pwd|secret|token", v):
            yield m.span("v")
    if "=" in line:
        for m in _CONNECTION.finditer(line):
            if ";" in line[max(0, m.start() - 200) : m.end() + 1] and secret_value(m["v"]):
                yield m.span("v")
    for m in _HEADER.finditer(line):
        v = m["v"]
        if m["cut"] or _MASKED.search(v) or _PLACEHOLDER.search(v):
            continue
        kind = m["k"].lower()
        if (kind == "basic" and _basic_ok(v)) or (kind != "basic" and re.search(r"\d", v) and len(set(v)) >= 8 and (kind == "bearer" or len(v) >= 20)):
            yield m.span("v")
    for m in _SQL.finditer(line):
        if secret_value(m["v"]):
            yield m.span("v")
    for m in _LOGIN_FLAG.finditer(line):
        name = "v" if m["v"] else "w"
        if secret_value(m[name], True):
            yield m.span(name)
    for pattern in (_PAIR, _ATTR, _ENV_DEFAULT):
        at = 0
        while m := pattern.search(line, at):
            place = _value(m)
            at = m.end("k") + 1
            if place and sensitive(m["k"]) and _secret(m["k"], place[2]) and not (pattern is _PAIR and _DECLARES.search(line[: m.start()])):
                yield place[:2]
    for m in _CALL.finditer(line):
        place = _value(m)
        words = [w.lower() for w in _WORDS.findall(m["k"].rpartition(".")[2])]
        if place and words[:1] in (["set"], ["with"], ["use"]) and sensitive(m["k"]) and _secret(m["k"], place[2]):
            yield place[:2]
    for m in _XML.finditer(line):
        if sensitive(m["k"]) and _secret(m["k"], m["v"], True):
            yield m.span("v")
    m = _BARE.match(line)
    if m and sensitive(m["k"]) and "(" not in m["v"]:
        v = m["v"]
        if v[-1] in ";," and line[m.end() :].strip():
            v = v[:-1]  # more of the line follows: a statement's or a comment's separator
        dotenv = m["op"] == "=" and not m["gap"]
        mapping = m["op"] == ":" and m["gap"] and v and v[-1] not in ",;{["
        if v and (config or dotenv or mapping) and (dotenv or v[-1] not in ",;{[") and _secret(m["k"], v, True) and (re.search(r"\d|[^\w.]", v) or v.lower() in WEAK):
            yield m.start("v"), m.start("v") + len(v)
    if _COMMENT.match(line):
        for m in _PROSE.finditer(line):
            if sensitive(m["k"]) and "(" not in m["v"] and re.search(r"\d", m["v"]) and secret_value(m["v"], True):
                yield m.span("v")
    if key_above is not None:
        m = _YAML_VALUE.match(line) if key_above.startswith("=") else _ALONE.match(line)
        if m:
            place = _value(m) or ((*m.span("v"), m["v"]) if "v" in m.re.groupindex and m["v"] else None)
            if place and secret_value(place[2], "v" in m.re.groupindex and m["v"] is not None):
                yield place[:2]
        elif not key_above.startswith("=") and config and (m := _ALONE_BARE.match(line)) and secret_value(m["v"], True) and re.search(r"\d", m["v"]):
            yield m.span("v")


#: What stands before a name that is declared, not assigned: a parameter list of labels, a schema.
_DECLARES = re.compile(r"(?i)<label\b[^>]*$|<input\b[^>]*\btype=[\"']$")


_JSON = re.compile(r"(?i)\.(?:json|json5|jsonc|webmanifest)$")
_YAML = re.compile(r"(?i)\.ya?ml$")
_SECTIONS = re.compile(r"(?i)\.(?:toml|ini|cfg|conf|properties|env)$|(?:^|/)\.env[\w.\-]*$")
_JSON_TOKEN = re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|[{}\[\],:]|" + _Q.format("v") + r"|(?P<v>[^\s{}\[\],:\"'`/]+)")
_YAML_LINE = re.compile(r"(?P<in>[ ]*(?:-[ ]+)*)(?:(?P<q>[\"']?)(?P<k>[^\s\"'#:{\[-][^\"'#:{\[]*?)(?P=q)[ ]*:(?=[ \r]|$)[ ]*)?(?:[&!][^\s]*[ ]+)*(?P<rest>.*)$")
_SCALAR = re.compile(_Q.format("v") + r"|(?P<v>[^\s\"'`#{\[|>&*][^\s]*)\s*(?:\s[#;].*)?$")
_SECTION = re.compile(r"\s*\[\[?\s*(?P<k>[^\[\]]+?)\s*\]\]?\s*(?:[#;].*)?$")
_SETTING = re.compile(r"\s*(?:export\s+)?(?P<q>[\"']?)(?P<k>[\w.\-]+)(?P=q)\s*[=:]\s*(?P<rest>.*)$")
#: Members of a sensitive object that describe it and hold no secret.
_DESCRIBES = frozenset("name user username login email id uid type kind url uri host hostname port path file filename version integrity resolved scope scopes expires expiry ttl length min max label title description hint pattern regex format algorithm alg provider issuer audience region ref color colour date created updated rotated image tag digest".split())


def _json_values(text: str, base: int = 0, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], int, int, bool]]:
    """(key path, start, end, bare) of each scalar, by a stack of open objects and lists."""
    stack: list[tuple[str, ...]] = []
    path, key, last = above, None, None
    for m in _JSON_TOKEN.finditer(text):
        place = _value(m)
        c = m[0]
        if place or m["v"]:
            last = (*place, False) if place else (*m.span("v"), m["v"], True)
            if key is not None:
                yield (*path, key), base + last[0], base + last[1], last[3]
            elif stack:
                yield path, base + last[0], base + last[1], last[3]
        elif c == ":" and last:
            key = last[2]
        elif c in "{[":
            stack.append(path)
            path, key, last = (*path, key) if key is not None else path, None, None
        elif c in "}]":
            path = stack.pop() if stack else above
            key = last = None
        elif c == ",":
            key = last = None


def _yaml_values(text: str) -> Iterator[tuple[tuple[str, ...], int, int, bool]]:
    """The same of YAML, by indentation; each line of a block scalar is a value of its key."""
    stack: list[tuple[int, str]] = []
    block, at = None, 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        body = line.strip()
        depth = len(line) - len(line.lstrip(" "))
        if block is not None and body and depth <= block:
            block = None
        if not body or body[0] == "#" and block is None or body in ("---", "..."):
            continue
        if block is not None:
            a = begin + line.index(body)
            yield tuple(k for _, k in stack), a, a + len(body), True
            continue
        m = _YAML_LINE.match(line)
        depth = len(m["in"])
        listed = "-" in m["in"]
        while stack and (stack[-1][0] >= depth if m["k"] else stack[-1][0] >= depth and not listed):
            stack.pop()
        if m["k"]:
            stack.append((depth, m["k"]))
        path, rest, start = tuple(k for _, k in stack), m["rest"].strip(), begin + m.start("rest")
        if rest[:1] in ("|", ">"):
            block = len(line) - len(line.lstrip(" "))
        elif rest[:1] in ("{", "["):
            yield from _json_values(m["rest"], start, path)
        elif v := _SCALAR.match(m["rest"]):
            place = _value(v)
            a, b = place[:2] if place else v.span("v")
            yield path, start + a, start + b, place is None


def _section_values(text: str) -> Iterator[tuple[tuple[str, ...], int, int, bool]]:
    """The same of TOML, INI, properties and dotenv: the section's name, then the key's own."""
    section: tuple[str, ...] = ()
    at = 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if line.lstrip()[:1] in ("#", ";", "!"):
            continue
        if m := _SECTION.match(line):
            section = tuple(x.strip("\"' ") for x in m["k"].split("."))
        elif m := _SETTING.match(line):
            path, rest, start = (*section, *m["k"].split(".")), m["rest"], begin + m.start("rest")
            if rest[:1] in ("{", "["):
                # an inline table has = where an object has :
                yield from _json_values(re.sub(r"(?<=[\w\"'\s])=(?=\s*[\"'\d{\[])", ":", rest), start, path)
            elif v := _SCALAR.match(rest):
                place = _value(v)
                a, b = place[:2] if place else v.span("v")
                yield path, start + a, start + b, place is None


def _in_config(text: str, path: str) -> Iterator[tuple[int, int]]:
    """Places of the credentials that the key path tells: its end is sensitive, or an object above is.

    Below a sensitive object or section a member counts if it does not describe the secret and its
    value has letters and digits, as a value without a telling name of its own must.
    """
    values = _json_values(text) if _JSON.search(path) else _yaml_values(text) if _YAML.search(path) else _section_values(text) if _SECTIONS.search(path) else ()
    for keys, a, b, bare in values:
        v = text[a:b]
        if not keys or not _secret(keys[-1], v, bare):
            continue
        if sensitive(keys[-1]):
            if not bare or re.search(r"\d", v) or v.lower() in WEAK:
                yield a, b
        elif any(k == "stringData" or sensitive(k) and not re.search(r"[/@\s]", k) for k in keys[:-1]):
            words = [w.lower() for w in _WORDS.findall(keys[-1])]
            if len(v) >= 6 and re.search(r"\d", v) and re.search(r"[^\W\d_]", v) and not (words and words[-1] in _DESCRIBES) and not re.match(r"[\d.]+(?:ms|[smhdwy]|[kmg]i?b?|px|%)?$|v?\d+[.\d\-]+|#[0-9a-fA-F]{3,8}$", v):
                yield a, b


#: One line of a key block, quoted and glued or not: its own headers, or characters of base 64.
_KEY_LINE = re.compile(r"(?:[\s\"'`+.,>*#|]|\\[nrt]|//)*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}|=[A-Za-z0-9+/]{4}|…|\.\.\.)(?=\s|\\[nrt]|[\"'`,+-]|$)")
_KEY_END = re.compile(r"(?:[\s\"'`+.,>*#|]|\\[nrt]|//)*[A-Za-z0-9+/=]{0,80}?(?:[\s\"'`+.,>*#|]|\\[nrt])*-----END [^-\n]*-----")


def _key_end(text: str, at: int) -> int:
    """Where the key block whose BEGIN mark ends at ``at`` ends: behind its END mark, else with its last line of key."""
    while m := _KEY_LINE.match(text, at):
        at = m.end()
    m = _KEY_END.match(text, at)
    return m.end() if m else at


def find_credentials(text: str | None, path: str | None = None) -> list[tuple[int, int]]:
    """Places [start, end) of the credential values of a text, in order and without overlap.

    For a private key block the place runs from its BEGIN mark over the whole block. ``path`` tells
    whether unquoted values are literals (configuration) or code. Null and empty texts have none.
    """
    if not text:
        return []
    found: list[tuple[int, int]] = []
    hints = _hints(text)
    if not hints:
        return []
    for m in _PRIVATE_KEY.finditer(text):
        body = re.match(r"(?:\s|\\[nr]|[\"'`+.,\\])*(?P<b>[A-Za-z0-9+/=:\-, ]{16,})", text[m.end() : m.end() + 200])
        if body is None and m.end() < len(text) or body and (_MASKED.search(body["b"]) or len(set(body["b"])) < 8):
            continue
        found.append((m.start(), _key_end(text, m.end())))
    place = (path or "").strip().replace("\\", "/")
    config = bool(_CONFIG.search(place))
    found.extend(_in_config(text, place))
    seen_to = -1
    for hint in hints:
        if hint < seen_to:
            continue
        begin = text.rfind("\n", 0, hint) + 1
        end = text.find("\n", hint)
        end = len(text) if end < 0 else end
        if end - begin > LONG_LINE:
            begin, end = max(begin, hint - BEFORE), min(_REST.match(text, min(end, hint + AFTER), end).end(), end)
        seen_to = end - (BEFORE if end < len(text) and text[end] != "\n" else 0)
        line = text[begin:end]
        plain, escaped = _unescaped(line)
        glued, places = _joined(plain)
        for a, b in _in_line(glued, config, None):
            a, b = (a, b) if places is None else (places[a], places[b - 1] + 1)
            a, b = (a, b) if escaped is None else (escaped[a], escaped[b - 1] + 1)
            found.append((begin + a, begin + b))
        key = None
        m = _OPEN.search(line)
        if m and sensitive(m["k"]):
            key = m["k"]
        elif (m := _YAML_NAME.match(line)) and sensitive(m["k"]):
            key = "=" + m["k"]
        if key is not None and end < len(text):
            stop = text.find("\n", end + 1)
            stop = len(text) if stop < 0 else stop
            after, places = _joined(text[end + 1 : stop].rstrip("\r"))
            for a, b in _in_line(after, config, key):
                a, b = (a, b) if places is None else (places[a], places[b - 1] + 1)
                found.append((end + 1 + a, end + 1 + b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def redact(text: str | None, path: str | None = None) -> str | None:
    """The text with every credential's characters replaced by ``*``; length, line ends, quotes and glue stay."""
    if text is None:
        return None
    out, at = [], 0
    for a, b in find_credentials(text, path):
        out.append(text[at:a])
        value = text[a:b]
        if value.startswith("-----BEGIN"):
            head, body, end = re.match(r"(?s)(-----BEGIN [^-]*-----)(.*?)(-----END.*|\Z)", value).groups()
            value = head + re.sub(r"\\[nrt]|[A-Za-z0-9+/=]", lambda m: m[0] if m[0][0] == "\\" else "*", body) + end
            out.append(value)
        else:
            parts = re.split(r"([\"'`]\s*(?:\+|\.{1,2}|&|~|\|\|)?\s*[\"'`])", value)
            out.append("".join(p if i % 2 else re.sub(r"\S", "*", p) for i, p in enumerate(parts)))
        at = b
    return "".join([*out, text[at:]])


def credential_values(text: str | None) -> frozenset[str]:
    """The credential values of a snippet, pieces put together, for telling statements apart."""
    return frozenset(re.sub(r"[\"'`]\s*[+.&~]?\s*[\"'`]", "", text[a:b]) for a, b in find_credentials(text))


_FOUND = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines, starts, ends = [], [], [], []
        known: dict[tuple[str, str | None], list[tuple[int, int, int]]] = {}
        for row, text, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = (text, path)
            if key not in known:
                known[key] = [(text.count("\n", 0, a) + 1, a, b) for a, b in find_credentials(text, path)]
            for line, a, b in known[key]:
                ids.append(row)
                lines.append(line)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row_id", "line_no", "start", "end"])


def locate(rows: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """(row_id, line_no, start, end): a row per credential, places in code points, end exclusive.

    One automaton pass finds the lines worth reading; no shuffle. Null and empty texts give no row; a row id met twice gives its rows twice; other
    columns are ignored. Lines end at LF, the first is number 1.
    """
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col), path)
    return texts.toDF("row_id", "text", "path").mapInArrow(_scan, _FOUND)


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([redact(t, p) for t, p in zip(text.to_pylist(), path.to_pylist(), strict=True)], pa.string())


def redacted(rows: DataFrame, text_col: str, path_col: str | None = None, out: str = "redacted") -> DataFrame:
    """All rows and columns, and the text with the credentials masked; null texts stay null."""
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    return rows.withColumn(out, _redacted(F.col(text_col), path))
