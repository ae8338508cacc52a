"""Rule tables shared by the operators.

Everything here is data: pattern lists, word lists and limits.  Operators take
these tuples as default arguments, so a caller can pass another table.  The
patterns use no back-references and, of look-around, only "no name character
before"; with that and the possessive marks rewritten they run in RE2 too.
"""

from __future__ import annotations

# --- Fixed values: URL validation -----------------------------------------
SCHEMES = ("http", "https")
IPV4 = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
)
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
BLOCKED_HOSTS = (
    "localhost",
    "localhost.localdomain",
    "metadata.google.internal",
    "metadata",
    "169.254.169.254",
    "instance-data",
)
BLOCKED_RANGES = (
    r"^10\.",
    r"^172\.(1[6-9]|2[0-9]|3[0-1])\.",
    r"^192\.168\.",
    r"^127\.",
    r"^169\.254\.",
    r"^169\.254\.169\.254$",
    r"^metadata\.google\.internal$",
    r"^100\.100\.100\.200$",
    r"^100\.(6[4-9]|[7-9][0-9]|1[0-2][0-7])\.",
)

# --- Fixed values: API URL predicate --------------------------------------
NOT_API = (
    r"\.(?:js|css|png|jpg|jpeg|gif|svg|ico|woff|ttf|eot)$",
    r"^/static/",
    r"^/assets/",
    r"^/images/",
    r"^/fonts/",
    r"^#",
    r"^mailto:",
    r"^javascript:",
)
API_ANY_HOST = r"^(?:https?://[^/]+)?/(?:api|v\d+|graphql|rest|ws)"
API_NO_HOST = r"^/(?:api|v\d+|graphql|rest|auth|admin|user|public)"

# --- Fixed values: languages and files ------------------------------------
LANGUAGES = {
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "py": "python",
    "pyw": "python",
}
SOURCE_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "py")
SKIPPED_PATHS = ("node_modules", "__pycache__")
SCRIPT_CONTENT_TYPES = (
    "application/javascript",
    "text/javascript",
    "application/x-javascript",
    "application/ecmascript",
    "text/ecmascript",
)
SOURCE_MAP = r"//[#@]\s*sourceMappingURL=(.+?)(?:\s|$)"

# --- Fixed values: HTTP client names --------------------------------------
CLIENT_FUNCTIONS = (
    "fetch", "axios", "request", "ajax", "http",
    "get", "post", "put", "delete", "patch",
)
TYPESCRIPT_CLIENTS = ("httpClient",)
PYTHON_CLIENTS = (
    "requests.get", "requests.post", "requests.put", "requests.delete",
    "requests.patch", "httpx.get", "httpx.post", "httpx.put", "httpx.delete",
    "aiohttp.get", "aiohttp.post", "urllib.request.urlopen",
)
INFERRED_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")

# --- Fixed values: tags, parameters, GraphQL ------------------------------
TAG_PATTERNS = (
    (r"/users?/", "Users"),
    (r"/auth/", "Authentication"),
    (r"/admin/", "Admin"),
    (r"/orders?/", "Orders"),
    (r"/products?/", "Products"),
    (r"/payments?/", "Payments"),
    (r"/notifications?/", "Notifications"),
    (r"/settings?/", "Settings"),
    (r"/health", "Health"),
    (r"/metrics", "Metrics"),
    (r"/graphql", "GraphQL"),
)
DEFAULT_TAG = "Discovered"
SENSITIVE_PARAMS = (
    "admin", "debug", "test", "root", "super",
    "privilege", "role", "internal", "config",
    "verbose", "show_all", "trace", "source",
)
# field name -> lower-cased text of the value sent
SENSITIVE_FIELDS = (
    ("role", "admin"),
    ("is_admin", "true"),
    ("isAdmin", "true"),
    ("permissions", "['all', 'admin']"),
    ("groups", "['admin']"),
    ("access_level", "100"),
    ("plan", "premium"),
    ("subscription", "enterprise"),
)
GRAPHQL_WORDS = ("graphql", "gql", "query")
GRAPHQL_PATHS = (
    "/graphql",
    "/graphql/",
    "/api/graphql",
    "/api/v1/graphql",
    "/v1/graphql",
    "/query",
    "/gql",
)

# --- Fixed values: personal data and keys ---------------------------------
# (type, pattern, hint).  The hint is our own addition, a cheap test that holds
# wherever the pattern matches: words of which one occurs (lower-cased for a
# pattern that ignores case), or a short pattern.
PII_RULES = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ("@",)),
    ("phone", r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
     r"[0-9]{4}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", r"[0-9]-[0-9]"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"[0-9]{4}"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"[0-9]\.[0-9]"),
    ("api_key_stripe", r"\b(?:sk|pk)_(?:live|test)_[a-zA-Z0-9]{24,}\b", ("sk_", "pk_")),
    ("api_key_aws", r"\bAKIA[0-9A-Z]{16}\b", ("AKIA",)),
    ("api_key_github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,}\b",
     ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("api_key_google", r"\bAIza[0-9A-Za-z\-_]{35}\b", ("AIza",)),
    ("api_key_generic",
     r"(?i)\b(?:api[_-]?key|apikey|secret[_-]?key|auth[_-]?token|access[_-]?token)"
     r"[\"'\s:=]+([a-zA-Z0-9\-_]{32,})\b", ("key", "token")),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\b",
     ("Bearer",)),
    ("basic_auth", r"\bBasic\s+[A-Za-z0-9+/=]{20,}\b", ("Basic",)),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
     ("-----BEGIN ",)),
)
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
MIN_KEY_ENTROPY = 3.5

# --- Fixed values: response heuristics ------------------------------------
# (pattern, words that all occur in the lower-cased text of every match); the
# words are our own addition
STACK_TRACES = (
    (r"Traceback \(most recent call last\)", ("traceback (",)),
    (r"at [A-Za-z0-9_.$]+\([^)]*\)", ("at ", "(")),
    (r"File \"[^\"]+\", line \d+", ("file \"", "\", line ")),
    (r"#\d+ [^\n]+\n\s+at ", ("#", "at ")),
    (r"goroutine \d+ \[", ("goroutine ",)),
    (r"panic:", ("panic:",)),
    (r"Exception in thread", ("exception in thread",)),
    (r"System\..*Exception:", ("system.", "exception:")),
)
SENSITIVE_ERRORS = (
    (r"sql.*error|mysql.*error|postgres.*error", ("error",)),
    (r"mongodb.*error|redis.*error", ("error",)),
    (r"connection refused|connection reset", ("connection re",)),
    (r"permission denied|access denied", ("denied",)),
    (r"internal server error", ("internal server error",)),
    (r"null pointer|undefined is not", ("n",)),
)
DEPRECATION_WORDS = (
    "deprecated",
    "this api is deprecated",
    "will be removed",
    "end of life",
    "use v2 instead",
    "use v3 instead",
    "legacy",
    "obsolete",
)
COPYRIGHT = r"(?i)copyright\s*(?:©|\(c\))?\s*(\d{4})"
OLD_SERVERS = (
    (r"Apache/1\.", "Apache 1.x"),
    (r"nginx/0\.", "nginx 0.x"),
    (r"PHP/5\.[0-4]", "PHP 5.0-5.4"),
    (r"Python/2\.", "Python 2.x"),
)
STATUS_CATEGORIES = (
    (200, "active", None),
    (201, "active", "State-changing endpoint (201 Created)"),
    (204, "active", "No content response"),
    (301, "redirect", None),
    (302, "redirect", None),
    (400, "active", "Bad request - endpoint exists but rejected input"),
    (401, "protected", "Requires authentication"),
    (403, "protected", "Forbidden - ACL or WAF block"),
    (404, "dead", None),
    (405, "active", "Method not allowed - try different HTTP verb"),
    (429, "protected", "Rate limited"),
)

# --- Fixed values: findings report ----------------------------------------
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/"
    "sarif-schema-2.1.0.json"
)
SARIF_VERSION = "2.1.0"
# (id, name, short description, default level, tags)
SARIF_RULES = (
    ("SHADOW-API-001", "UndocumentedEndpoint",
     "An endpoint is in use that no specification lists", "warning", ("security", "api", "shadow")),
    ("SHADOW-API-002", "ZombieEndpoint",
     "An endpoint marked as deprecated still answers", "error",
     ("security", "api", "zombie", "deprecated")),
    ("SHADOW-API-003", "UnprotectedEndpoint",
     "An endpoint answers requests without credentials", "error",
     ("security", "api", "authentication")),
    ("SHADOW-API-004", "HardcodedSecret",
     "Source text holds a key, token or password", "error",
     ("security", "secrets", "credentials")),
    ("SHADOW-API-005", "GhostEndpoint",
     "A specification lists an endpoint that does not answer", "note", ("api", "documentation")),
)
RULE_OF_STATUS = (
    ("shadow", "SHADOW-API-001"),
    ("zombie", "SHADOW-API-002"),
    ("unprotected", "SHADOW-API-003"),
)
SECRET_RULE, GHOST_RULE = "SHADOW-API-004", "SHADOW-API-005"
# messages; the names in braces are columns
ENDPOINT_MESSAGE = "Discovered {status} endpoint: {method} {url}"
SECRET_MESSAGE = "Hardcoded {type} detected"
GHOST_MESSAGE = "Documented endpoint not responding: {method} {path}"
OPERATION_SUMMARY = "Discovered endpoint at {url}"
OPERATION_LINES = (
    "**Auto-discovered endpoint**",
    "",
    "- **URL**: `{url}`",
    "- **Found in**: `{file}:{line}`",
    "- **Verified status**: {http_status}",
    "- **Classification**: {status}",
    "",
    "> This endpoint was discovered automatically and may not be fully documented.",
)
AUDIT_CATEGORIES = ("documented", "shadow", "ghost", "zombie")

# --- Fixed values: limits -------------------------------------------------
ARCHIVE_MONTHS = 24
ARCHIVE_PREFIX = "https://web.archive.org/web/"
MAX_SCRIPT_MB = 10
MAX_VERSION = 5
RATE_LIMIT_TTL = 300
BACKOFF_MULTIPLIER = 2.0
BACKOFF_CAP = 60.0
CONTEXT_CHARS = 100
PREVIEW_ROWS = 10
FINDING_SEVERITIES = ("low", "medium", "high", "critical")

# --- Our own tables --------------------------------------------------------
# Secret rules: (name, pattern, severity, lowest entropy or None, hint).
# Group 1, where present, is the value.
_PII = {name: (pattern, hint) for name, pattern, hint in PII_RULES}
SECRET_RULES = (
    ("stripe_key", _PII["api_key_stripe"][0], "critical", None, _PII["api_key_stripe"][1]),
    ("aws_access_key", _PII["api_key_aws"][0], "critical", None, _PII["api_key_aws"][1]),
    ("github_token", _PII["api_key_github"][0], "critical", None, _PII["api_key_github"][1]),
    ("google_api_key", _PII["api_key_google"][0], "high", None, _PII["api_key_google"][1]),
    ("generic_api_key", _PII["api_key_generic"][0], "high", MIN_KEY_ENTROPY, ("key", "token")),
    ("token_assignment", r"\btoken\s*=\s*\"([0-9a-f]{40})\"", "medium",
     MIN_KEY_ENTROPY, ("token",)),
    ("bearer_token", _PII["bearer_token"][0], "high", None, _PII["bearer_token"][1]),
    ("basic_auth", _PII["basic_auth"][0], "medium", None, _PII["basic_auth"][1]),
    ("private_key", _PII["private_key"][0], "critical", None, _PII["private_key"][1]),
)

_NAME = r"[A-Za-z_$][\w$]*+"
_STR = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
_TEMPLATE = r"`[^`]*`"
_PYSTR = r"[rbufRBUF]{0,2}(?:\"[^\"\n]*\"|'[^'\n]*')"
_CONST_WORDS = r"[\w$]*(?i:api|endpoint|base_?url|host|server)[\w$]*"
_KEY_WORDS = r"[\w$]*(?i:url|endpoint|api|base_?url|host)[\w$]*"

# Source shapes: (kind, language family, pattern, verb group or 0, url group,
# texts of which one must occur).  The url group still carries its quotes.
SHAPES = (
    ("fetch", "js", r"\bfetch\(\s*(" + _STR + r")", 0, 1, ("fetch",)),
    ("fetch_template", "js", r"\bfetch\(\s*(" + _TEMPLATE + r")", 0, 1, ("fetch",)),
    ("axios_method", "js", r"\baxios\.(\w+)\(\s*(" + _STR + r")", 1, 2, ("axios.",)),
    ("xhr_open", "js", r"\.open\(\s*[\"'](\w+)[\"']\s*,\s*(" + _STR + r")", 1, 2, (".open",)),
    ("express_route", "js",
     r"\b(?:app|router|express)\.(get|post|put|delete|patch|use|all)\(\s*(" + _STR + r")",
     1, 2, ("app.", "router.", "express.")),
    ("url_constant", "js",
     r"\b(?:const|let|var)\s+" + _CONST_WORDS + r"\s*=\s*(" + _STR + r")", 0, 1,
     ("const", "let", "var")),
    ("url_property", "js",
     r"[{,\s]" + _KEY_WORDS + r"\s*:\s*(" + _STR + r")", 0, 1, (":",)),
    ("requests_call", "py",
     r"\brequests\.(get|post|put|delete|patch|head|options)\(\s*(" + _PYSTR + r")", 1, 2,
     ("requests.",)),
    ("httpx_call", "py",
     r"\bhttpx\.(get|post|put|delete|patch|head|options)\(\s*(" + _PYSTR + r")", 1, 2,
     ("httpx.",)),
    ("session_call", "py",
     r"[\w)\]]\.(get|post|put|delete|patch|head|options)\(\s*(" + _PYSTR + r")", 1, 2, (".",)),
    ("urllib_call", "py",
     r"\burllib\.request\.\w+\(\s*(" + _PYSTR + r")", 0, 1, ("urllib.",)),
    ("route_decorator", "py",
     r"@[\w.]+\.(get|post|put|delete|patch|route)\(\s*(" + _PYSTR + r")", 1, 2, ("@",)),
    ("django_url", "py",
     r"(?<![\w.])(?:path|re_path|url)\(\s*(" + _PYSTR + r")", 0, 1, ("path(", "url(")),
    ("url_constant", "py",
     r"(?:^|\n)[ \t]*" + _CONST_WORDS + r"\s*=\s*(" + _PYSTR + r")", 0, 1, ("=",)),
)

# Calls whose argument is a configuration object with a ``url``: (kind, call up to
# its bracket, texts of which one must occur).
CONFIG_CALLS = (
    ("axios_config", r"\baxios\s*\(", ("axios",)),
    ("jquery_ajax", r"(?:\$|\bjQuery)\.ajax\s*\(", (".ajax",)),
)
# a comment that is never closed goes on to the end; the second form does not step back
_COMMENT = r"//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*\z)"
_POSSESSIVE_COMMENT = r"//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
CONFIG_VALUE = r"url\s*:\s*(" + _STR + r")$"


def config_token(openings: list[str], *, possessive: bool = False) -> str:
    """Comments, literals, the given calls, ``url`` pairs and brackets of a script.

    A pair begins with the brace or comma before its name.  With ``possessive``
    (not every engine has it) long runs of comments do not recurse, and a slash
    where a value may begin opens a pattern literal.
    """
    comment = _POSSESSIVE_COMMENT if possessive else _COMMENT
    again = "*+" if possessive else "*"
    pattern = r"|/(?<=[=(,:;!&|?{}\[]\s{0,9}/)[^/*\n][^/\n]*+/" if possessive else ""
    return (r"(?:[{,](?:\s|" + comment + ")" + again + r"url\s*:\s*" + _STR + "|" + _STR + "|" + _TEMPLATE
            + "|" + comment + pattern + "|" + "|".join(openings) + r"|[{}()\[\]])")


# Lexical tokens of a source text: comments are consumed so that quotes inside
# them open no literal.  Escapes are masked before matching.
LITERALS = {
    "js": r"//[^\n]*|/\*[\s\S]*?\*/|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`",
    "py": r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'",
    "html": r"<!--[\s\S]*?-->|\"[^\"]*\"|'[^'\n]*'",
}

# Call sites: client function, then a literal, a name, a member or a `+` chain.
# Two safeguards for very long inputs: a name starts where no name character
# stands before it (no rescan from inside a long word), and repeated groups are
# possessive (Java matches those in a loop, not by recursion on the stack).
_ARGUMENT = (
    r"\s*\(\s*((?:\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[A-Za-z_$][\w$.]*)"
    r"(?:\s*\+\s*(?:\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[A-Za-z_$][\w$.]*))*+)"
)
CALL_SITES = {
    "js": r"(?<![\w$])((?i:" + "|".join(CLIENT_FUNCTIONS) + r"))" + _ARGUMENT,
    "ts": r"(?<![\w$])((?i:" + "|".join(CLIENT_FUNCTIONS + TYPESCRIPT_CLIENTS) + r"))" + _ARGUMENT,
    "py": r"(?<![\w.])(" + "|".join(PYTHON_CLIENTS).replace(".", r"\.") + r")" + _ARGUMENT,
}
# A call whose first argument is a name, a member or a chain: the file's
# definitions are needed.
_UNRESOLVED = r"\s*\(\s*(?:[A-Za-z_$]|(?:\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`)\s*\+)"
UNRESOLVED_CALLS = {
    "js": r"(?<![\w$])(?i:" + "|".join(CLIENT_FUNCTIONS) + r")" + _UNRESOLVED,
    "ts": r"(?<![\w$])(?i:" + "|".join(CLIENT_FUNCTIONS + TYPESCRIPT_CLIENTS) + r")" + _UNRESOLVED,
    "py": r"(?<![\w.])(?:" + "|".join(PYTHON_CLIENTS).replace(".", r"\.") + r")" + _UNRESOLVED,
}
OPERAND = r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[A-Za-z_$][\w$.]*"

# Definitions: (priority, pattern, name group, value group).
DEFINITIONS = (
    (0, r"\b(?:const|let|var)\s+(" + _NAME + r")\s*=\s*[\"']([^\"']+)[\"']"),
    (1, r"(?<![\w$])(" + _NAME + r")\s*=\s*[\"']([^\"']+)[\"']"),
    (2, r"\b(?:const|let|var)\s+(" + _NAME + r")\s*=\s*`([^`]+)`"),
    (3, r"(?<![\w$])(" + _NAME + r")\s*:\s*[\"']([^\"']+)[\"']"),
)
OBJECT_LITERAL = r"(?<![\w$])(" + _NAME + r")\s*=\s*\{([^}]*)\}"
OBJECT_PROPERTY = r"(?<![\w$])(" + _NAME + r")\s*:\s*[\"']([^\"']+)[\"']"

# A name given to another one, alone in its statement.
ALIAS = (r"(?:\b(?:const|let|var)\s+|(?m:^)[ \t]*)(" + _NAME + r")[ \t]*=[ \t]*(" + _NAME
         + r")[ \t]*(?:[;,]|\r?(?m:$))")
