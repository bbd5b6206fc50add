"""Fixed values of the text rules and profile detectors: names, patterns, labels, thresholds."""

from __future__ import annotations

import sys

# Fixed values. Path parts, file names and extensions that the scan leaves out or takes.
IGNORED_PARTS = [".git", ".next", ".turbo", ".cache", "node_modules", "vendor", "dist", "build", "coverage", "target", "__pycache__"]
LOCKFILES = ["Cargo.lock", "Gemfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock"]
TEXT_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".rb", ".php", ".java", ".kt", ".kts", ".cs", ".swift", ".sh", ".bash", ".zsh", ".ps1", ".sql", ".tf", ".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".md", ".txt"]
TEXT_NAMES = ["Dockerfile", "Makefile"]
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".rb", ".php", ".java", ".kt", ".kts", ".cs"]
COMMAND_SKIPPED = [".git", ".hg", ".svn", ".idea", ".vscode", ".turbo", ".next", ".cache", "node_modules", "vendor", "dist", "build", "coverage", "target", "out", "tmp", "__pycache__"]
LANGUAGE_SKIPPED = [".git", "node_modules", "vendor", "dist", "build", "target", ".next"]

# Fixed values. The rules in their order: name, pattern, flags, and the globs of files that the rule leaves out.
RULES = [
    ("placeholder", r"\b(TODO|FIXME|changeme|dummy[_ -]?key|your[_ -]?api[_ -]?key|lorem ipsum)\b", "i", []),
    ("swallowed_exception", r"except\s*:\s*pass|catch\s*\([^)]*\)\s*\{\s*\}", "is", []),
    ("sql_concatenation", r"(SELECT|INSERT|UPDATE|DELETE).*(\+|%s|f['\"]).*", "is", []),
    ("tls_disabled", r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED", "i", []),
    ("secret_logging", r"console\.log\(.*(token|secret|password|api[_-]?key)|logger\..*\b(token|secret|password|api[_-]?key)\b", "i", []),
    ("shell_injection_risk", r"(subprocess\.(run|Popen)\(|exec\(|spawn\(|os\.system\().*(\+|f['\"]|\$\{)", "is", []),
    ("hardcoded_ip", r"['\"](?:\d{1,3}\.){3}\d{1,3}['\"]", "", ["*.json", "*.yaml", "*.yml", "*.toml", "Dockerfile", "*.cfg"]),
    ("hardcoded_credential", r"\b(password|secret|api[_-]?key|access[_-]?key|token)\b\s*[:=]\s*['\"][^'\"]+['\"]", "i", ["*.example", "*.sample", "*.md"]),
    ("debug_print", r"console\.log\s*\(|\bprint\s*\(|fmt\.Print(?:f|ln)?\s*\(|System\.out\.print(?:ln)?\s*\(|\bdebugger\b", "", ["*test*", "*spec*", "**/scripts/**", "*.md"]),
    ("dead_code_marker", r"(//|#|/\*+)\s*(HACK|XXX|TEMP|REMOVEME)\b", "i", []),
    ("unsafe_eval", r"\beval\s*\(|new Function\s*\(|(?<!\.)\bexec\s*\(", "i", []),
    ("unhandled_promise", r"\.then\s*\((?:(?!\.catch|\.finally).)*\)(?!\s*\.(catch|finally))", "is", ["*test*"]),
    ("env_no_default", r"process\.env(?:\.[A-Z0-9_]+|\[['\"][A-Z0-9_]+['\"]\])(?!\s*(\|\||\?\?))|os\.environ\[['\"][A-Z0-9_]+['\"]\]", "i", ["*.d.ts", "*.md"]),
    ("unsafe_deserialization", r"pickle\.load\s*\(|yaml\.load\s*\((?![^)]*Loader\s*=)|Marshal\.load\s*\(|\bunserialize\s*\(", "is", []),
    ("broad_exception", r"catch\s*\(\s*(Exception|Error)\b|except\s+Exception\b|^\s*rescue\s*$", "im", []),
    ("hardcoded_url", r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|staging[\w.-]*|dev[\w.-]*|internal[\w.-]*|corp[\w.-]*|local[\w.-]*)", "i", ["*.md", "*.txt", "*.lock"]),
    ("magic_number", r"(?<![\w.])(1\d{3,}|[2-9]\d{3,})(?![\w.])", "", ["*.json", "*.yaml", "*.yml", "*.css", "*test*", "*.lock"]),
    ("empty_catch", r"catch\s*(?:\([^)]*\))?\s*\{\s*\}|except(?:\s+[A-Za-z0-9_., ()]+)?\s*:\s*pass", "is", []),
    ("python_mutable_default", r"^\s*(?:async\s+def|def)\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\}|set\(\))", "ms", []),
    ("go_blank_identifier_error", r"^\s*_\s*=\s*err\b|^\s*(?:_,\s*)+err\s*:=", "m", []),
    ("go_panic_recover_business_logic", r"\bpanic\s*\(|\brecover\s*\(", "i", []),
    ("csharp_throw_ex", r"\bthrow\s+ex\s*;", "i", []),
    ("sql_null_blind_not_equal", r"(?:!=|<>)\s*['\"][^'\"]+['\"](?![^;\n]*(?:IS\s+NULL|IS\s+NOT\s+NULL|COALESCE|IFNULL))", "i", []),
    ("sql_window_missing_frame", r"\bOVER\s*\((?=[^)]*\bORDER\s+BY\b)(?![^)]*\b(?:ROWS|RANGE|GROUPS)\b)[^)]*\)", "is", []),
    ("php_deprecated_mysql", r"\bmysql_(?:connect|query|fetch_|real_escape_string)", "i", []),
    ("robotic_function_name", r"\b(?:function\s+|def\s+|func\s+|public\s+\w+\s+|private\s+\w+\s+|protected\s+\w+\s+)?((?:calculate|process|handle)[A-Za-z0-9_]{32,})\s*\(", "i", []),
]

# Fixed values. Patterns and limits of the per-file detectors.
TODO_PATTERN, TODO_LIMIT = r"\b(TODO|FIXME)\b", 5
MAGIC_STRING_PATTERN, MAGIC_STRING_LIMIT = r"(['\"])([^'\"\n\\]{10,})\1", 4
AS_PATTERN, AS_LIMIT = r"\bas\s+(?:any|unknown|[A-Za-z_$][\w$]*(?:<[^>\n]+>)?)", 5
REFCELL_PATTERN, REFCELL_LIMIT = r"Rc\s*<\s*RefCell\s*<", 2
LONG_FUNCTION_LINES, LONG_DOCSTRING_LINES, SNIPPET = 80, 5, 140
JS_IMPORT_PATTERN = r"(?:import\s+(?:[^'\"\n]+?\s+from\s+)?|require\s*\()\s*['\"]([^'\"\n]+)['\"]"
PY_IMPORT_PATTERN = r"^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*))"
PY_DEF_PATTERN = r"^(\s*)(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
JS_START_PATTERN = (
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
    r"|^\s*(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{"
    r"|^\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{"
)
JS_BUILTINS = ["assert", "buffer", "child_process", "crypto", "events", "fs", "http", "https", "net", "os", "path", "process", "querystring", "stream", "timers", "url", "util", "zlib"]
JS_LOCAL_PREFIXES = [".", "/", "#", "@/", "node:"]
PY_ALLOWED = ["pytest", "django", "flask", "fastapi", "pydantic", "sqlalchemy", "requests", "numpy", "pandas"]
PY_STDLIB = sorted(sys.stdlib_module_names)

# Fixed values. Patterns of manifests and of names in code.
GO_REQUIRE_PATTERN, GO_VERSION_PATTERN = r"^\s*require\s+([^\s]+)", r"^\s*([^\s]+)\s+v[\w.+-]+\s*$"
GEM_PATTERN = r"^\s*gem\s+['\"]([^'\"]+)['\"]"
PNPM_ITEM_PATTERN = r"^\s*-\s*['\"]?([^'\"]+)['\"]?\s*$"
PY_NAME_PATTERN = r"^\s*(?:def|async\s+def)\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*([A-Za-z_][A-Za-z0-9_]*)\s*="
JS_NAME_PATTERN = r"\b(?:const|let|var|function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
COMPONENT_PATTERN = r"(?:export\s+default\s+function|export\s+function|const)\s+([A-Z][A-Za-z0-9]*)"

# Fixed values. Language of a file by its extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".sql": "sql",
    ".java": "java-csharp", ".cs": "java-csharp", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".h": "cpp", ".c": "cpp", ".php": "php",
}

# Fixed values. Library names, as substrings of dependency names, by category.
LIBRARIES = {
    "framework": ["react", "next", "vue", "nuxt", "svelte", "angular", "django", "flask", "fastapi", "express", "nestjs", "koa", "rails", "laravel", "spring", "gin", "fiber", "flutter"],
    "database": ["prisma", "sequelize", "typeorm", "drizzle", "knex", "mongoose", "sqlalchemy", "sqlmodel", "psycopg", "pg", "mysql", "postgres", "sqlite", "redis", "mongodb", "supabase"],
    "testing": ["jest", "vitest", "testing-library", "playwright", "cypress", "pytest", "rspec", "minitest", "unittest"],
    "http": ["axios", "requests", "httpx", "aiohttp", "faraday", "rest-client", "got"],
    "state_management": ["redux", "zustand", "mobx", "pinia", "recoil", "xstate"],
    "styling": ["tailwindcss", "styled-components", "emotion", "sass", "less", "bootstrap", "chakra-ui"],
    "auth": ["next-auth", "authjs", "passport", "clerk", "auth0", "firebase-auth", "devise"],
    "payments": ["stripe", "paypal", "braintree", "square"],
    "validation": ["zod", "yup", "joi", "pydantic", "marshmallow", "class-validator"],
}

# Fixed values. What a directory of a name holds.
DIRECTORY_LABELS = {
    "api": "API routes and handlers", "app": "application entry points and routes", "assets": "static assets", "auth": "authentication and authorization", "components": "UI components",
    "config": "runtime and build configuration", "controllers": "controller layer", "database": "database access and persistence", "db": "database access and persistence", "domains": "domain-oriented modules",
    "entities": "domain entities and models", "features": "feature modules", "hooks": "UI and state hooks", "lib": "shared utilities", "middleware": "middleware and request interception",
    "migrations": "database migrations", "models": "data models", "modules": "feature or domain modules", "pages": "page routes", "prisma": "database schema and migrations", "public": "public assets",
    "repositories": "repository layer", "routes": "routing layer", "scripts": "automation and tooling scripts", "services": "service layer", "src": "application source code", "store": "application state",
    "styles": "styling and design tokens", "test": "tests", "tests": "tests", "utils": "shared utilities", "views": "view layer",
}
OTHER_DIRECTORY = "application code"

# Fixed values. Globs of configuration files at a project's root.
CONFIG_GLOBS = [
    ".editorconfig", ".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yaml", ".eslintrc.yml", ".prettierrc", ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.json", ".prettierrc.yaml", ".prettierrc.yml",
    "eslint.config.js", "eslint.config.mjs", "eslint.config.ts", "next.config.js", "next.config.mjs", "next.config.ts", "prettier.config.js", "prettier.config.cjs", "prettier.config.mjs", "prettier.config.ts",
    "tailwind.config.js", "tailwind.config.cjs", "tailwind.config.mjs", "tailwind.config.ts", "tsconfig.json", "tsconfig.*.json", "ruff.toml", "pyproject.toml", "mypy.ini", "pyrightconfig.json",
    "Dockerfile", "Dockerfile.*", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", ".github/workflows/*.yml", ".github/workflows/*.yaml",
]

# Fixed values. Layout labels and the paths of which any one shows it.
LAYOUTS = {
    "mvc": ["models", "views", "controllers"],
    "component-based": ["components", "src/components"],
    "feature-based": ["features", "modules", "domains"],
    "layered": ["services", "repositories", "entities"],
    "pages-based": ["pages"],
    "app-router": ["app", "src/app"],
    "api-routes": ["api", "routes", "endpoints", "app/api", "pages/api"],
}
STRIPPED_SUFFIXES = [".d.ts", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".test.js", ".spec.js"]
ENTRY_POINTS = ["app/layout.tsx", "src/app/layout.tsx", "src/main.ts", "src/main.tsx", "src/main.js", "src/main.jsx", "main.go", "Program.cs", "__main__.py", "manage.py", "app.py"]
ENV_FILES = [".env.example", ".env.sample", ".env.template", ".env.defaults"]
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
REPO_MARKERS = ["package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "Gemfile", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts", "pubspec.yaml", "Package.swift"]
REPO_MARKER_GLOBS = ["*.sln", "*.csproj"]
COMMAND_KEYS = ["install", "lint", "typecheck", "test", "build", "format"]
MIGRATION_PATHS = ["migrations", "db/migrations", "supabase/migrations", "prisma/migrations"]
CRITICAL_PATHS = ["auth", "src/auth", "app/api", "pages/api", "supabase", "database", "db", "payments", "billing"]

# Fixed values. Review dimensions.
SEVERITIES = ["critical", "high", "medium", "low"]
RISK_MULTIPLIERS = {"security": 2.74, "error_handling": 2.0, "logic": 1.75, "readability_consistency_frequency": 3.0, "performance_io_frequency": 8.0, "concurrency": 2.0}
LAYERS = {
    "requirement_fidelity": ["prompt_mirroring", "business_rule_drift", "god_prompt_decay", "missing_negative_behavior"],
    "logic_edge_cases": ["silent_logic_failure", "boundary_condition", "null_empty_duplicate_state", "error_handling", "async_ordering", "mutable_state"],
    "api_dependency_integrity": ["hallucinated_api", "slopsquatting_dependency", "schema_hallucination", "version_signature_mismatch", "reinvented_internal_utility"],
    "security_patterns": ["auth_authz", "injection", "secret_exposure", "unsafe_deserialization", "permissive_config", "destructive_operation"],
    "system_awareness": ["cross_layer_inconsistency", "global_state_misuse", "architectural_violation", "multi_file_incompleteness", "observability_gap"],
    "test_quality": ["implementation_mirroring_test", "missing_edge_case", "missing_error_path", "unrealistic_fixture", "overmocking"],
}
LAYER_TITLES = ["Requirement Fidelity", "Logic and Edge Cases", "API and Dependency Integrity", "Security Patterns", "System Awareness", "Test Quality"]
CRITICAL_RISKS = ["auth", "authorization", "payments", "secrets", "migrations", "data_deletion", "public_api", "infra", "shell_execution", "pii"]
BUG_BUCKETS = {"semantic": 51.34, "build": 15.50, "analysis": 9.09, "compatibility": 7.49, "concurrency_and_config": 8.56}
