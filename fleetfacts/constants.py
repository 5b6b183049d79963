"""Word lists, file names and mappings that define results.

Nothing here is tuning; changing an entry changes the facts produced.
"""

# Directories whose content is never analysed.
VENDORED_DIRS = [
    ".git", "node_modules", ".venv", "venv",
    "dist", "build", "__pycache__", ".tox",
]

# Manifest and configuration file names flagged as important.
IMPORTANT_FILENAMES = [
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
    "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg",
    "pom.xml", "build.gradle", "go.mod", "go.sum",
    "Cargo.toml", "Cargo.lock",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    ".env.example",
]
WORKFLOW_PREFIX = ".github/workflows"

# Root manifests read by technology and dependency extraction.
ROOT_MANIFESTS = [
    "package.json", "pyproject.toml", "requirements.txt",
    "go.mod", "Cargo.toml", "Dockerfile",
]

# File extension -> language.
EXTENSION_LANGUAGES = {
    ".py": "Python",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
}
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]

# Python web frameworks found by requirement prefix, in test order.
PYTHON_FRAMEWORKS = [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask")]

# Words never used as search keywords.
STOP_WORDS = [
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "for", "of",
    "and", "or", "but", "not", "with", "this", "that", "are", "was",
    "be", "as", "by", "from", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "i",
    "we", "you", "he", "she", "they", "them", "their", "our", "my",
    "when", "where", "which", "what", "who", "how", "if", "then",
    "its", "into", "about", "also", "more", "than", "so", "up", "out",
    "there", "here", "after", "before", "just", "all", "any", "some",
]

# Issue labels read as signs of an approachable issue.
APPROACHABLE_LABELS = [
    "good first issue", "good-first-issue",
    "first contribution", "first-contribution",
    "beginner", "beginner friendly", "beginner-friendly",
    "easy", "starter", "up for grabs",
    "help wanted", "help-wanted",
    "documentation", "docs",
    "bug", "small", "minor", "trivial",
]
# Issue labels read as signs of a complex issue.
COMPLEX_LABELS = [
    "breaking change", "breaking-change",
    "rfc", "architecture", "security",
    "performance", "refactor", "major",
    "needs design", "blocked",
]
# Title words of a focused change.
FOCUSED_TITLE_WORDS = [
    "typo", "fix", "bug", "error", "crash", "wrong", "incorrect",
    "missing", "update", "add", "remove", "rename", "cleanup",
    "documentation", "docs", "readme", "comment",
]
# Body words of a complex topic, in reporting order.
COMPLEX_BODY_WORDS = [
    "architecture", "migration", "breaking", "refactor",
    "performance", "database schema", "security", "auth",
    "oauth", "design", "rewrite",
]
REPRODUCTION_WORDS = [
    "expected", "actual", "reproduce", "steps to reproduce", "expected behavior",
]
SMALL_SCOPE_LABELS = ["small", "minor", "trivial", "easy", "documentation", "docs", "typo"]
LARGE_SCOPE_LABELS = ["breaking change", "breaking-change", "architecture", "rfc", "major"]

# Issue type -> labels, and issue type -> title words, in test order.
TYPE_LABELS = [
    ("bug", ["bug", "fix", "crash", "error"]),
    ("docs", ["documentation", "docs", "readme"]),
    ("feature", ["feature", "enhancement", "feat", "request"]),
    ("refactor", ["refactor", "cleanup", "tech debt", "technical debt"]),
]
TYPE_TITLE_WORDS = [
    ("bug", ["fix", "bug", "error", "crash", "wrong"]),
    ("docs", ["doc", "readme", "comment", "typo"]),
    ("feature", ["add", "implement", "feature", "support"]),
    ("refactor", ["refactor", "clean", "rename", "move"]),
]
# Issue type -> commit type; anything else is "chore".
COMMIT_TYPES = {"bug": "fix", "docs": "docs", "feature": "feat", "refactor": "refactor"}

# Django field class -> column type.
DJANGO_TYPES = {
    "AutoField": "INTEGER",
    "BigAutoField": "BIGINT",
    "IntegerField": "INTEGER",
    "BigIntegerField": "BIGINT",
    "SmallIntegerField": "SMALLINT",
    "FloatField": "FLOAT",
    "DecimalField": "DECIMAL",
    "CharField": "VARCHAR",
    "TextField": "TEXT",
    "BooleanField": "BOOLEAN",
    "DateField": "DATE",
    "DateTimeField": "DATETIME",
    "TimeField": "TIME",
    "UUIDField": "UUID",
    "EmailField": "VARCHAR",
    "URLField": "VARCHAR",
    "SlugField": "VARCHAR",
    "JSONField": "JSON",
    "BinaryField": "BLOB",
    "ForeignKey": "INTEGER",
    "OneToOneField": "INTEGER",
}
# Django relation field class -> cardinality.
DJANGO_CARDINALITY = {
    "ForeignKey": "one_to_many",
    "OneToOneField": "one_to_one",
    "ManyToManyField": "many_to_many",
}
# Prisma scalar -> column type.
PRISMA_TYPES = {
    "String": "VARCHAR",
    "Int": "INTEGER",
    "BigInt": "BIGINT",
    "Float": "FLOAT",
    "Decimal": "DECIMAL",
    "Boolean": "BOOLEAN",
    "DateTime": "DATETIME",
    "Json": "JSON",
    "Bytes": "BLOB",
}

PROJECT_STATUSES = ["pending", "analyzing", "ready", "error"]
