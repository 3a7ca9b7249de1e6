"""Fixed values.

Word lists, lookup tables, constants, patterns and output formats that have to
keep exactly these values for results to be right. Nothing here is logic.
"""

# The five categories a commit can belong to.
MEMORY = "Memory Safety & Robustness"
CONCURRENCY = "Concurrency & Thread Safety"
LOGIC = "Logic & Correctness"
BUILD = "Build, Refactor & Internal"
FEATURE = "Feature & Value Add"
CATEGORIES = (MEMORY, CONCURRENCY, LOGIC, BUILD, FEATURE)

# Spellings accepted in hand-made labels (compared without case).
LABEL_ALIASES = {
    "Memory": MEMORY,
    "Memory Safety": MEMORY,
    "Concurrency": CONCURRENCY,
    "Thread Safety": CONCURRENCY,
    "Logic": LOGIC,
    "Logic Error": LOGIC,
    "Refactor": BUILD,
    "Build": BUILD,
    "Maintenance": BUILD,
    "Feature": FEATURE,
    "Feat": FEATURE,
}

# Needles looked for, in this order, in a category returned by a classifier.
PREDICTION_NEEDLES = (
    (MEMORY, ("memory", "segfault", "overflow", "safety", "security", "vuln", "crash")),
    (CONCURRENCY, ("concurren", "thread", "atomic", "race", "lock")),
    (FEATURE, ("feature", "value", "perf", "optimiz", "platform", "porting")),
    (BUILD, ("build", "refactor", "doc", "test", "tool", "ci", "style", "lint")),
)

# Truth words: hand-made labels, classifier answers, and R-style logicals.
LABEL_TRUE = ("TRUE", "1", "T", "YES", "Y")
PREDICTION_TRUE = ("true", "1")
LOGICAL_TRUE = ("T", "TRUE", "true", "True")
LOGICAL_FALSE = ("F", "FALSE", "false", "False")

# Words in a message that make a commit worth labelling, and the word looked for in its diff.
INTERESTING_WORDS = (
    "fix", "leak", "segfault", "feature", "refactor", "unsafe",
    "atomic", "race", "overflow", "panic", "unwrap",
)
INTERESTING_DIFF_WORD = "unsafe"
SAMPLE_FRACTION = 0.05
SAMPLE_CAP = 100

# Longest reasoning kept in a training example, in words.
REASONING_WORDS = 15

# Complexity score weights: complexity, files touched, lines changed.
WEIGHT_COMPLEXITY = 1.0
WEIGHT_FILES = 0.5
WEIGHT_LINES = 0.5

# Text patterns for counting changed lines in a raw diff.
ADDED_LINE = r"(?m)^\+(?!\+\+)(?!\s*@@).+"
REMOVED_LINE = r"(?m)^-(?!-)(?!\s*@@).+"

# Files whose content is never shown, by path suffix.
NOISE_SUFFIXES = (
    ".lock", ".svg", ".png", ".jpg", ".min.js", ".css", ".map",
    ".pdf", ".o", ".a", ".so", ".exe", ".dll", ".po", ".pot",
    ".ico", ".bmp", ".gif", ".ttf", ".woff", ".woff2", ".html",
    ".htm", ".xml", ".xsa", ".sgml", ".man", ".json", ".yaml", ".yml",
)
# Build and documentation files, by words in the path or its first folder.
ARTIFACT_WORDS = (
    "makefile", "cmakelists.txt", "configure.in", "cargo.toml",
    "news", "changelog", "readme", "authors", "license", "copying",
)
ARTIFACT_FOLDERS = ("doc/", "docs/", "man/")
LOG_WORDS = ("changelog", "news")

# Limits used when condensing a diff.
LONG_HUNK = 50
HUGE_HUNK = 200
SPARSE_CHANGES = 5
KEEP_LINES = 10
KEEP_REPETITIVE = 5
REPETITIVE_MIN_ADDED = 20
REPETITIVE_SHARE = 0.8
ARTIFACT_LINES = 3
MAX_DIFF_CHARS = 40000
MAX_BROKEN_CHARS = 1000

# Texts written into a condensed diff.
FILE_HEADER = "File: "
TAG_DELETED = " [DELETED]"
TAG_NEW = " [NEW]"
TAG_RENAMED = " [RENAMED]"
NOISE_NOTE = " (Binary/Asset - Content Skipped)"
ARTIFACT_NOTE = " (Build/Doc Artifact - %d lines added, %d lines removed)"
ARTIFACT_END = "   ... [REMAINING ARTIFACT SKIPPED] ..."
ARTIFACT_INDENT = "   "
SNIP_LOG = "   ... [SNIPPED %d LINES OF LOG] ..."
SNIP_REPETITIVE = "   ... [SNIPPED %d REPETITIVE LINES] ..."
SNIP_BODY = "   ... [SNIPPED %d LINES OF CONTEXT/BODY] ..."
TOO_LONG_END = "\n\n[...TRUNCATED DUE TO EXCESSIVE LENGTH...]"
BROKEN_END = "\n[...PARSE ERROR - TRUNCATED]"
EMPTY_DIFF = "No content changes (Metadata or binary only)."
FETCH_ERROR = "[Error fetching diff: %s]"
DEV_NULL = "/dev/null"

# Texts of classifier requests, keys and ids.
MODEL_INPUT = "Lang: %s Msg: %s\nDiff:\n%s"
SYNTHETIC_ID = "synth:%s:%s"
SYNTHETIC_ROWS = 20
UNKNOWN = "unknown"
UNKNOWN_AUTHOR = "<unknown>"
OTHER = "Other"
LIBRARY_LABEL = " / "

# Projects studied: final list, and the older list with its own names.
DOMAINS = {
    "libxml2": "XML Parsing",
    "quick-xml": "XML Parsing",
    "libcurl": "HTTP/Net",
    "hyper": "HTTP/Net",
    "openssl": "Crypto/TLS",
    "rustls": "Crypto/TLS",
    "sqlite": "Database",
    "limbo": "Database",
    "coreutils": "Utils",
}
PAIRS = (
    ("libxml2", "quick-xml"),
    ("libcurl", "hyper"),
    ("openssl", "rustls"),
    ("sqlite", "limbo"),
    ("coreutils", "coreutils"),
)

# File names of stored tables.
COMMIT_FILE_PREFIX = "full_commit_"
REQUEST_FILE_GLOB = "BATCH_input*.jsonl"

# Whitespace as Python's str.strip and str.split see it.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
