"""Word lists and tables that results depend on."""

# Words that keyword extraction drops.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "out", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "just", "what", "which", "who",
)

# Code-level synonyms of natural-language query words.
SYNONYMS = {
    "authentication": ("auth", "login", "session", "jwt", "token", "credential", "signin", "signout"),
    "authorize": ("auth", "permission", "role", "access", "policy", "guard", "acl"),
    "authorization": ("auth", "permission", "role", "access", "policy", "guard", "acl"),
    "database": ("db", "query", "storage", "sql", "schema", "drizzle", "prisma", "orm", "repository"),
    "payment": ("payment", "billing", "stripe", "invoice", "checkout", "subscription", "charge"),
    "transaction": ("transaction", "tx", "payment", "transfer", "ledger"),
    "configuration": ("config", "settings", "env", "environment", "options"),
    "validation": ("validate", "schema", "zod", "yup", "check", "guard"),
    "error": ("error", "exception", "catch", "throw", "fail", "handler"),
    "testing": ("test", "spec", "mock", "fixture", "describe", "it"),
    "routing": ("route", "router", "path", "handler", "endpoint", "controller"),
    "middleware": ("middleware", "interceptor", "handler", "guard", "pipe"),
    "notification": ("notify", "notification", "alert", "email", "push", "webhook"),
    "upload": ("upload", "file", "storage", "blob", "multipart", "stream"),
    "caching": ("cache", "redis", "memo", "memoize", "ttl", "store"),
    "logging": ("log", "logger", "console", "trace", "debug", "audit"),
    "scheduling": ("schedule", "cron", "job", "task", "queue", "worker"),
    "search": ("search", "query", "filter", "find", "index", "fts"),
}

# Intents: the first whose condition holds. A condition is groups of words; each group needs one of its words.
INTENTS = (
    ((("how",), ("work", "flow")), "Understanding how something works"),
    ((("refactor", "change", "modify"),), "Planning a change or refactor"),
    ((("find", "search", "where"),), "Locating code or functionality"),
    ((("what", "explain", "describe"),), "Getting an explanation or overview"),
)
GENERAL_INTENT = "General context retrieval"

# Architectural layers by words in a path.
LAYERS = {
    "Presentation Layer": ("component", "view", "page", "ui", "render", "screen"),
    "Business Logic Layer": ("service", "usecase", "use-case", "domain", "business"),
    "Data Access Layer": ("repository", "dao", "database", "store", "persistence"),
    "API Layer": ("api", "route", "handler", "controller", "endpoint", "rest"),
    "Utility Layer": ("util", "helper", "common", "shared", "lib"),
    "Configuration Layer": ("config", "setting", "env", "constant"),
}

# Design patterns: id, name, how it is called in the description, words in a path.
PATTERNS = (
    ("pattern-factory", "Factory Pattern", "Factory pattern usage", ("factory",)),
    ("pattern-builder", "Builder Pattern", "Builder pattern usage", ("builder",)),
    ("pattern-observer", "Observer/Event Pattern", "Observer/Event-driven pattern", ("event", "observer", "listener")),
)

# Business domains by words in a module's path or name.
DOMAINS = ("auth", "user", "payment", "order", "product", "inventory", "notification", "billing", "subscription", "analytics", "search", "upload", "export", "import", "report")

# Extension -> language.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust"}
# Extensions that an import specifier may leave out, in order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")

NODE_COLOURS = {"file": "lightblue", "function": "lightgreen", "class": "lightsalmon", "type": "lightyellow"}
OTHER_COLOUR = "lightgray"
# Radii of nodes in drawings.
NODE_RADII = {"file": 6.0, "function": 3.5, "class": 5.0, "type": 4.0}
OTHER_RADIUS = 4.0

# Directory names that a scan skips, besides hidden ones.
SKIPPED_DIRECTORIES = ("node_modules", "dist")

CATEGORY_LABELS = {"naming": "Naming", "file-structure": "File Structure", "testing": "Testing", "imports": "Imports", "exports": "Exports", "directory": "Directory", "architecture": "Architecture"}
