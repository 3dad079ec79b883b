"""Pattern rules over source texts, as data: which families they read, what they match, what silences them."""

from __future__ import annotations

from auditlake.rules.rule import Rule
from auditlake.rules.security import CONFIGURATION, SECURITY

#: Words that name something secret in a key, for rules about storage and configuration.
SECRETISH = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api_?key|apikey|private_?key|credential|jwt|session_?id|pin_?code|auth)"


def _r(*args, **kw) -> Rule:
    return Rule(*args, **kw)


PERFORMANCE = [
    _r("PERF-AWAIT-IN-LOOP", "medium", "js", r"\bfor\s*(?:await\s*)?\([^)]*\)\s*\{[^}]{0,400}?\bawait\b", "Waits inside a loop", category="performance", per="file", need=("await",)),
    _r("PERF-NESTED-LOOP-QUERY", "high", "js php jvm", r"\b(?:for|foreach|while)\s*\([^)]*\)\s*\{[^}]{0,300}?(?:\.(?:find(?:One|All|By\w*)?|query|execute|findById|where|fetch(?:All)?)\s*\(|mysqli_query\s*\()", "Query inside a loop", category="performance", per="file", need=("find", "query", "execute", "where", "fetch")),
    _r("PERF-DOM-IN-LOOP", "medium", "js", r"\bfor\s*\([^)]*\)\s*\{[^}]{0,400}?\b(?:getElementById|querySelector(?:All)?|appendChild)\b", "Document touched inside a loop", category="performance", per="file", need=("getelementbyid", "queryselector", "appendchild")),
    _r("PERF-SYNC-IO", "medium", "js", r"(?<!function )\b(?:readFileSync|writeFileSync|execSync|existsSync)\s*\(", "Blocking file access", category="performance", per="file", path=r"^(?!.*(?:^|/)(?:bin|scripts?|tools?|config)(?:/|\.)).*$", tests=False, need=("sync",)),
    _r("PERF-SELECT-STAR", "low", "*", r"(?i)\bselect\s+\*\s+from\b", "All columns read", category="performance", raw=True, per="file", need=("select",)),
    _r("PERF-MOMENT", "low", "js", r"(?:from\s+|require\s*\(\s*|import\s+)[\"']moment[\"']", "Heavy date library", category="performance", raw=True, per="file", need=("moment",)),
    _r("PERF-FULL-LODASH", "low", "js", r"(?:from\s+|require\s*\(\s*)[\"']lodash[\"']", "Whole utility library imported", category="performance", raw=True, per="file", need=("lodash",)),
]

QUALITY = [
    _r("QUAL-FIXME", "medium", "*", r"\b(?:FIXME|XXX|HACK|BUG)\b", "Known defect left in the code", category="quality", raw=True, need=("fixme", "xxx", "hack", "bug"), effort="moyen"),
    _r("QUAL-TODO", "info", "*", r"\bTODO\b", "Work left to do", category="quality", raw=True, need=("todo",), effort="moyen"),
    _r("QUAL-DEPRECATED", "low", "*", r"@deprecated\b", "Deprecated code kept", category="quality", raw=True, need=("@deprecated",)),
]

DEBUG = [
    _r("DEAD-DEBUG-INSTRUCTION-DEBUGGER", "high", "js", r"^\s*debugger\s*;?\s*$", "Debugger statement", category="deadcode", per="file", need=("debugger",), effort="rapide"),
    _r("DEAD-DEBUG-APPEL-CONSOLE", "low", "js", r"\bconsole\.(?:log|debug|info|dir|table|trace)\s*\(", "Console output left in", category="deadcode", per="file", least=3, need=("console.",), tests=False, effort="rapide"),
    _r("DEAD-DEBUG-APPEL-PRINT", "info", "python", r"^\s*print\s*\(", "Print left in", category="deadcode", per="file", least=3, need=("print",), tests=False, effort="rapide"),
    _r("DEAD-DEBUG-DUMP-DE-DEBUG", "medium", "php", r"\b(?:var_dump|print_r|dd|dump)\s*\(", "Dump left in", category="deadcode", per="file", need=("dump", "print_r", "dd"), effort="rapide"),
    _r("DEAD-DEBUG-POINT-D-ARRET", "high", "python ruby", r"\b(?:pdb\.set_trace|breakpoint|binding\.pry|byebug)\b", "Breakpoint left in", category="deadcode", per="file", need=("set_trace", "breakpoint", "binding.pry", "byebug"), effort="rapide"),
    _r("DEAD-DEBUG-PRINTSTACKTRACE", "medium", "jvm", r"\.printStackTrace\s*\(", "Stack trace printed", category="deadcode", per="file", need=("printstacktrace",), effort="rapide"),
    _r("DEAD-DEBUG-DEBUGPRINT", "low", "dart", r"\bdebugPrint\s*\(", "Debug output left in", category="deadcode", per="file", least=3, need=("debugprint",), effort="rapide"),
]

FRAMEWORKS = [
    _r("ANDROID-TRUSTMANAGER-PERMISSIF", "critical", "jvm", r"\bcheckServerTrusted\s*\([^)]*\)[^{;]*\{\s*\}", "Trust manager accepts everything", need=("checkservertrusted",)),
    _r("ANDROID-HOSTNAME-NON-VERIFIE", "critical", "jvm", r"\bverify\s*\([^)]*\)[^{;]*\{\s*return\s+true|\bhostnameVerifier\s*\{[^}]*\btrue\s*\}", "Host names not checked", need=("verif",)),
    _r("ANDROID-WEBVIEW-ACCES-FICHIER", "high", "jvm", r"\b(?:setAllow(?:Universal)?(?:File)?Access(?:FromFileURLs)?\s*\(\s*true|allow(?:Universal)?(?:File)?Access(?:FromFileURLs)?\s*=\s*true)", "Web view reads files", need=("access",)),
    _r("ANDROID-PREFS-NON-CHIFFRE", "high", "jvm", r"\bput(?:String|Int|StringSet)\s*\(\s*[\"'][^\"']*(?i:" + SECRETISH + r")[^\"']*[\"']", "Secret in plain preferences", raw=True, unless_file=r"EncryptedSharedPreferences", only_file=r"[sS]haredPreferences", need=("sharedpreferences",)),
    _r("ANGULAR-BYPASS-SECURITY", "high", "js", r"\bbypassSecurityTrust(?:Html|Script)\s*\(", "Sanitizer bypassed", need=("bypasssecuritytrust",)),
    _r("ANGULAR-BYPASS-SECURITY", "medium", "js", r"\bbypassSecurityTrust(?:Url|ResourceUrl|Style)\s*\(", "Sanitizer bypassed", need=("bypasssecuritytrust",)),
    _r("ANGULAR-INNERHTML-BINDING", "medium", "js markup", r"\[innerHTML\]\s*=", "Markup bound to an element", raw=True, need=("[innerhtml]",), confidence="tentative"),
    _r("ASTRO-SET-HTML", "high", "astro", r"\bset:html\s*=", "Raw markup in a page", raw=True, need=("set:html",)),
    _r("ASTRO-CLIENT-ONLY", "medium", "astro", r"\bclient:only\b", "Component without server output", category="seo", raw=True, need=("client:only",)),
    _r("ASTRO-VITE-DEFINE-SECRET", "critical", "js", r"\bdefine\s*:\s*\{[^}]*\b\w*(?i:" + SECRETISH + r")\w*[\"']?\s*:", "Secret compiled into the pages", raw=True, path=r"(^|/)astro\.config\.\w+$", need=("define",)),
    _r("DJANGO-SECRET-KEY-HARDCODED", "critical", "python", r"^\s*SECRET_KEY\s*=\s*[\"'][^\"']{4,}[\"']", "Secret key in the code", raw=True, need=("secret_key",)),
    _r("DJANGO-CHARFIELD-NULL", "low", "python", r"\bmodels\.(?:Char|Text|Email|Slug|URL)Field\s*\([^)]*\bnull\s*=\s*True", "Text field that may be null", category="quality", need=("field",)),
    _r("ELECTRON-NODE-INTEGRATION", "critical", "js", r"\bnodeIntegration(?:InWorker|InSubFrames)?\s*:\s*true", "Node in a window", need=("nodeintegration",)),
    _r("ELECTRON-CONTEXT-ISOLATION", "critical", "js", r"\bcontextIsolation\s*:\s*false", "Contexts not isolated", need=("contextisolation",)),
    _r("ELECTRON-WEB-SECURITY", "high", "js", r"\bwebSecurity\s*:\s*false", "Same-origin rule switched off", need=("websecurity",)),
    _r("ELECTRON-SANDBOX", "high", "js", r"\bsandbox\s*:\s*false", "Sandbox switched off", need=("sandbox",)),
    _r("ELECTRON-CONTENU-NON-SUR", "high", "js", r"\ballowRunningInsecureContent\s*:\s*true", "Insecure content allowed", need=("allowrunninginsecurecontent",)),
    _r("ELECTRON-WEBVIEW-NODE", "critical", "js markup", r"<webview\b[^>]*\bnodeintegration", "Node in an embedded page", raw=True, need=("<webview",)),
    _r("ELECTRON-OPEN-EXTERNAL", "high", "js", r"\bshell\.openExternal\s*\(\s*(?![\"'`])[^)]+\)", "Any address opened outside", need=("openexternal",), unless_file=r"(?:startsWith|protocol\s*===?|includes)\s*\(?\s*[\"']https?:"),
    _r("ELECTRON-WINDOW-OPEN-HANDLER", "medium", "js", r"\bnew\s+BrowserWindow\s*\(", "New windows not restricted", per="first", need=("browserwindow",), unless_file=r"setWindowOpenHandler|new-window", confidence="tentative"),
    _r("EXPRESS-SESSION-COOKIE", "high", "js", r"(?<![\w.])session\s*\(\s*\{(?![\s\S]{0,400}?\bsecure\s*:)[\s\S]{0,400}?\}\s*\)", "Session cookie without protection", need=("session",), only_file=r"express-session|cookie-session"),
    _r("EXPRESS-SESSION-UNINITIALIZED", "low", "js", r"\bsaveUninitialized\s*:\s*true", "Empty sessions stored", category="performance", need=("saveuninitialized",)),
    _r("EXPRESS-STATIC-DOTFILES", "critical", "js", r"\bdotfiles\s*:\s*[\"']allow[\"']", "Hidden files served", raw=True, need=("dotfiles",)),
    _r("EXPRESS-STACK-LEAK", "high", "js", r"\.(?:json|send|end)\s*\([^;\n]*\b(?:err|error|e)\.stack\b", "Stack trace sent to the client", need=(".stack",)),
    _r("EXPRESS-NO-BODY-LIMIT", "medium", "js", r"\b(?:express|bodyParser)\.(?:json|urlencoded|raw|text)\s*\((?![^)]*\blimit\b)[^)]*\)", "Request size not limited", need=("express.", "bodyparser.")),
    _r("FASTAPI-CORS-CREDENTIALS", "critical", "python", r"\bCORSMiddleware\b(?=[\s\S]{0,400}?allow_origins\s*=\s*\[\s*[\"']\*)(?=[\s\S]{0,400}?allow_credentials\s*=\s*True)", "Credentials for any origin", raw=True, per="first", need=("corsmiddleware",)),
    _r("FASTAPI-NO-RESPONSE-MODEL", "medium", "python", r"^@\w+\.(?:get|post|put|patch)\s*\((?![^)\n]*response_model)[^)\n]*\)\s*\n(?:async\s+)?def\s+\w+[^\n]*\n(?:[ \t]+[^\n]*\n){0,20}?[ \t]+return\s+(?:db|session|await\s+\w+)\.", "Database object sent whole", need=("return",), confidence="tentative"),
    _r("FLASK-SECRET-KEY-HARDCODED", "critical", "python", r"\bapp\.(?:secret_key|config\[[\"']SECRET_KEY[\"']\])\s*=\s*[\"'][^\"']{4,}[\"']", "Secret key in the code", raw=True, need=("secret_key",)),
    _r("FLASK-SEND-FILE-TRAVERSAL", "high", "python", r"\bsend_(?:file|from_directory)\s*\([^)\n]*\brequest\.", "File chosen by the request", need=("send_f",)),
    _r("FLUTTER-PREFS-NON-CHIFFRE", "high", "dart", r"\b\w*[pP]refs?\w*\.set(?:String|Int|StringList)\s*\(\s*[\"'][^\"']*(?i:" + SECRETISH + r")", "Secret in plain preferences", raw=True, need=("prefs", "pref.")),
    _r("FLUTTER-TLS-DESACTIVE", "critical", "dart", r"\bbadCertificateCallback\s*=[^;]*(?:=>\s*true|return\s+true)", "Certificates not checked", raw=True, need=("badcertificatecallback",)),
    _r("IOS-USERDEFAULTS-SECRET", "high", "swift", r"\bUserDefaults\.standard\.set(?:Value)?\s*\([^)\n]*forKey:\s*\"[^\"]*(?i:" + SECRETISH + r")", "Secret in plain defaults", raw=True, need=("userdefaults",)),
    _r("IOS-TROUSSEAU-TOUJOURS-ACCESSIBLE", "medium", "swift objc", r"\bkSecAttrAccessibleAlways\w*", "Keychain always readable", need=("ksecattraccessiblealways",)),
    _r("IOS-TLS-NON-EVALUE", "critical", "swift objc", r"\bURLCredential\s*\(\s*trust:", "Server trust not evaluated", unless_file=r"SecTrustEvaluate", need=("urlcredential",)),
    _r("LARAVEL-ENV-OUTSIDE-CONFIG", "high", "php", r"(?<![\w>$])env\s*\(\s*[\"']", "Environment read outside the settings", raw=True, per="first", path=r"^(?!(?:.*/)?config/).*\.php$", need=("env",)),
    _r("LARAVEL-GUARDED-EMPTY", "high", "php", r"\$guarded\s*=\s*\[\s*\]", "Every field assignable", need=("$guarded",)),
    _r("LARAVEL-MODEL-NO-HIDDEN", "high", "php", r"\$fillable\s*=\s*\[[^\]]*[\"']\w*(?i:" + SECRETISH + r")\w*[\"']", "Secret field put out", raw=True, unless_file=r"\$hidden\b", need=("$fillable",)),
    _r("MOBILE-TRAFIC-EN-CLAIR", "high", "xml markup", r"android:usesCleartextTraffic\s*=\s*\"true\"", "Plain traffic allowed", raw=True, need=("cleartext",)),
    _r("MOBILE-DEBUGGABLE", "critical", "xml markup", r"android:debuggable\s*=\s*\"true\"", "Debuggable release", raw=True, need=("debuggable",)),
    _r("MOBILE-SAUVEGARDE-OUVERTE", "medium", "xml markup", r"android:allowBackup\s*=\s*\"true\"", "Backups allowed", raw=True, need=("allowbackup",)),
    _r("MOBILE-ATS-DESACTIVE", "high", "xml markup", r"<key>NSAllowsArbitraryLoads</key>\s*<true\s*/>", "Transport security switched off", raw=True, need=("nsallowsarbitraryloads",)),
    _r("NEXTJS-IGNORE-LINT", "medium", "js", r"\bignoreDuringBuilds\s*:\s*true", "Lint skipped in builds", category="quality", path=r"(^|/)next\.config\.\w+$", need=("ignoreduringbuilds",)),
    _r("NEXTJS-IGNORE-TYPES", "high", "js", r"\bignoreBuildErrors\s*:\s*true", "Type errors skipped in builds", category="quality", path=r"(^|/)next\.config\.\w+$", need=("ignorebuilderrors",)),
    _r("NEXTJS-IMAGE-WILDCARD", "high", "js", r"\b(?:domains\s*:\s*\[[^\]]*|hostname\s*:\s*)[\"']\*{1,2}[\"']", "Images of any host", raw=True, path=r"(^|/)next\.config\.\w+$", need=("*",)),
    _r("NEXTJS-NO-HEADERS", "medium", "js", r"\A", "No security headers set", per="first", raw=True, path=r"(^|/)next\.config\.\w+$", unless_file=r"\bheaders\s*\("),
    _r("NEXTJS-API-NO-METHOD-CHECK", "medium", "js", r"\bexport\s+default\s+(?:async\s+)?function\b", "Any method accepted", per="first", path=r"(^|/)(?:pages|app)/api/", unless_file=r"req\.method|export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)", need=("export",)),
    _r("NUXT-PUBLIC-RUNTIME-SECRET", "critical", "js", r"\bpublic\s*:\s*\{[^}]*\b\w*(?i:" + SECRETISH + r")\w*\s*:", "Secret in the public settings", path=r"(^|/)nuxt\.config\.\w+$", need=("public",)),
    _r("NUXT-SSR-DISABLED", "high", "js", r"\bssr\s*:\s*false", "No server output", category="seo", path=r"(^|/)nuxt\.config\.\w+$", need=("ssr",)),
    _r("NUXT-DEVTOOLS-ENABLED", "low", "js", r"\bdevtools\s*:\s*(?:true|\{\s*enabled\s*:\s*true)", "Developer tools on", path=r"(^|/)nuxt\.config\.\w+$", need=("devtools",)),
    _r("RAILS-CSRF-DISABLED", "high", "ruby", r"\bskip_before_action\s+:verify_authenticity_token(?!.*\b(?:only|except):)|:null_session", "Forgery protection switched off", raw=True, need=("verify_authenticity", "null_session")),
    _r("RAILS-CSRF-DISABLED", "medium", "ruby", r"\bskip_before_action\s+:verify_authenticity_token.*\b(?:only|except):", "Forgery protection partly off", raw=True, need=("verify_authenticity",)),
    _r("RAILS-PERMIT-ALL", "high", "ruby", r"\.permit!|\bparams\.to_unsafe_h\b", "Every parameter permitted", need=("permit!", "to_unsafe_h")),
    _r("RAILS-SQL-INTERPOLATION", "critical", "ruby", r"\.(?:where|order|group|having|joins|select|find_by_sql|pluck|exists\?)\s*\(?\s*\"[^\"\n]*#\{", "Values inside a query", raw=True, need=("#{",)),
    _r("RAILS-HTML-SAFE", "high", "ruby", r"\.html_safe\b|(?<![\w.])raw\s*\(", "Value put out without escaping", need=("html_safe", "raw")),
    _r("RN-STOCKAGE-NON-CHIFFRE", "high", "js", r"\b(?:AsyncStorage\.setItem|MMKV\w*\.set|storage\.set)\s*\(\s*[\"'`][^\"'`]*(?i:" + SECRETISH + r")", "Secret in plain storage", raw=True, unless_file=r"expo-secure-store|react-native-keychain|EncryptedStorage", need=("asyncstorage", "mmkv", "storage.set")),
    _r("RN-WEBVIEW-ACCES-FICHIER", "high", "js", r"\ballowFileAccess\w*\s*(?:=\s*\{\s*true\s*\}|:\s*true)", "Web view reads files", raw=True, need=("allowfileaccess",)),
    _r("REACT-TOKEN-IN-STORAGE", "high", "js", r"\b(?:local|session)Storage\.setItem\s*\(\s*[\"'`][^\"'`]*(?i:" + SECRETISH + r")", "Token in browser storage", raw=True, need=("storage.setitem",)),
    _r("REACT-LIST-NO-KEY", "medium", "js", r"\.map\s*\(\s*\(?[^)=\n]*\)?\s*=>\s*\(?\s*<(?![^>]*\bkey=)[A-Za-z][^>]*>", "List without keys", category="quality", raw=True, need=(".map",), only_file=r"from\s+[\"']react[\"']|require\([\"']react[\"']\)|\.jsx?$|<[A-Z]"),
    _r("REACT-DYNAMIC-HREF", "medium", "js", r"\bhref=\{[^}]*\b(?:props|data|user|params|query|item)\b[^}]*\}", "Link from data", raw=True, need=("href={",), confidence="tentative"),
    _r("SPRING-ACTUATOR-EXPOSED", "critical", "properties yaml", r"management\.endpoints\.web\.exposure\.include\s*=\s*\*|exposure:\s*\n\s+include:\s*[\"']?\*", "All management endpoints open", raw=True, need=("exposure",)),
    _r("SPRING-ACTUATOR-EXPOSED", "high", "properties yaml", r"(?:exposure\.include\s*=|exposure:\s*\n\s+include:)[^\n*]*\b(?:env|heapdump|threaddump|shutdown|configprops|loggers)\b", "Sensitive management endpoints open", raw=True, need=("exposure",)),
    _r("SPRING-H2-CONSOLE", "critical", "properties yaml", r"spring\.h2\.console\.enabled\s*=\s*true|h2:\s*\n\s+console:\s*\n\s+enabled:\s*true", "Database console open", raw=True, need=("h2",)),
    _r("SPRING-SHOW-SQL", "low", "properties yaml", r"spring\.jpa\.show-sql\s*=\s*true|show-sql:\s*true", "Queries logged", category="performance", raw=True, path=r"^(?!.*-(?:dev|test|local)\.).*$", need=("show-sql",)),
    _r("SPRING-PERMIT-ALL", "high", "jvm", r"\banyRequest\(\)\s*\.permitAll\(\)", "Everything permitted", need=("permitall",)),
    _r("SVELTE-HTML-TAG", "high", "svelte", r"\{@html\b", "Raw markup in a component", raw=True, need=("{@html",)),
    _r("SVELTEKIT-SERVER-DATA-LEAK", "critical", "js", r"\bload\b[\s\S]{0,300}?\breturn\s*\{[^}]*\b\w*(?i:" + SECRETISH + r")\w*\s*[:,}]", "Secret sent with the page", path=r"\+(?:page|layout)\.server\.\w+$", need=("load",)),
    _r("TAURI-ALLOWLIST-TOTALE", "critical", "json", r"\"allowlist\"\s*:\s*\{\s*(?:[^{}]*,\s*)?\"all\"\s*:\s*true", "Every native call allowed", raw=True, path=r"(^|/)tauri\.conf\.json$", need=("allowlist",)),
    _r("TAURI-SHELL-OUVERT", "critical", "json", r"\"shell\"\s*:\s*\{[^{}]*\"(?:all|execute)\"\s*:\s*true", "Shell open to pages", raw=True, path=r"(^|/)tauri\.conf\.json$", need=("shell",)),
    _r("TAURI-CSP-ABSENTE", "high", "json", r"\"csp\"\s*:\s*null", "No content policy", raw=True, path=r"(^|/)tauri\.conf\.json$", need=("csp",)),
    _r("TAURI-IPC-DISTANT", "critical", "json", r"\"dangerousRemoteDomainIpcAccess\"\s*:\s*\[\s*[^\]\s]", "Remote pages may call in", raw=True, path=r"(^|/)tauri\.conf\.json$", need=("dangerousremotedomainipcaccess",)),
    _r("TAURI-GLOBAL-EXPOSE", "medium", "json", r"\"withGlobalTauri\"\s*:\s*true", "Native calls on every page", raw=True, path=r"(^|/)tauri\.conf\.json$", need=("withglobaltauri",)),
    _r("ENV-PUBLIC-SECRET", "critical", "js dotenv", r"\b(?:NEXT_PUBLIC|VITE|REACT_APP|NUXT_PUBLIC|PUBLIC|EXPO_PUBLIC|GATSBY|VUE_APP)_(?!\w*(?:PUBLISHABLE|PUBLIC_KEY|SITE_KEY|ANON))\w*(?:SECRET|PASSWORD|PRIVATE_KEY|ACCESS_TOKEN|SERVICE_ROLE)\w*", "Secret published to browsers", raw=True, need=("public_", "vite_", "react_app_", "gatsby_", "vue_app_")),
    _r("APP-RESSOURCE-DISTANTE", "high", "markup", r"<script\b[^>]*\bsrc\s*=\s*[\"']https?://", "Installed app loads a remote script", raw=True, path=r"(^|/)(?:src-tauri|electron|desktop|android|ios|mobile)/", need=("<script",)),
    _r("APP-RESSOURCE-DISTANTE", "medium", "markup css", r"<link\b[^>]*rel\s*=\s*[\"']stylesheet[\"'][^>]*href\s*=\s*[\"']https?://|@import\s+(?:url\()?[\"']?https?://", "Installed app loads a remote style", raw=True, path=r"(^|/)(?:src-tauri|electron|desktop|android|ios|mobile)/", need=("stylesheet", "@import")),
    _r("PERF-FONT-DISPLAY", "medium", "css", r"@font-face\b", "Text hidden while fonts load", category="performance", raw=True, per="first", unless_file=r"font-display", need=("@font-face",)),
    _r("RAILS-MASTER-KEY-COMMITTED", "critical", "*", r"\A[0-9a-f]{32}\s*\Z", "Master key in the repository", raw=True, per="first", path=r"(^|/)config/(?:master\.key|credentials/\w+\.key)$"),
    _r("SEC-DONNEES-DANS-SCRIPT", "high", "markup", r"<script\b(?![^>]*\btype\s*=\s*[\"']application/(?:ld\+)?json)[^>]*>(?:(?!</script)[\s\S])*?(?:\|\s*(?:safe|raw)\b|<%==|\.html_safe|json_encode\s*\()", "Template value inside a script", raw=True, need=("<script",)),
    _r("SEC-DONNEES-DANS-SCRIPT", "medium", "markup", r"<script\b[^>]*\btype\s*=\s*[\"']application/(?:ld\+)?json[\"'][^>]*>(?:(?!</script)[\s\S])*?(?:\|\s*(?:safe|raw)\b|<%==|\.html_safe|json_encode\s*\()", "Template value inside a data script", raw=True, need=("<script",)),
    _r("LARAVEL-CSRF-MISSING", "high", "blade php", r"(?i)<form\b[^>]*method\s*=\s*[\"']post[\"'][^>]*>(?:(?!</form|@csrf|csrf_field|_token)[\s\S])*</form", "Form without a token", raw=True, path=r"\.blade\.php$", need=("<form",)),
    _r("DJANGO-CSRF-TOKEN-MISSING", "high", "markup", r"(?i)<form\b[^>]*method\s*=\s*[\"']post[\"'][^>]*>(?:(?!</form|csrf_token)[\s\S])*</form", "Form without a token", raw=True, only_file=r"\{%", need=("<form",)),
    _r("DJANGO-MODEL-NO-STR", "low", "python", r"^class\s+\w+\s*\([^)]*models\.Model[^)]*\)\s*:(?:\n(?:[ \t]+(?!def\s+__str__)[^\n]*|[ \t]*))+(?=\n\S|\Z)", "Model without a text form", category="quality", unless_file=r"def\s+__str__", per="first", need=("models.model",)),
]

RULES: tuple[Rule, ...] = tuple([*SECURITY, *CONFIGURATION, *PERFORMANCE, *QUALITY, *DEBUG, *FRAMEWORKS])
#: Declared, never run: it is scoped to routes and no scan evaluates that scope.
INACTIVE = ("SEC-NO-RATE-LIMIT",)
