"""Tables and patterns that results depend on, as plain text."""

# query types by substrings of the lower-cased query, first list that matches wins
BROAD_SUMMARY = ["hepsini anlat", "genel bakış", "genel özet", "özetle", "tüm ", "summary", "overview", "list all", "hepsini listele", "tüm kurallar"]
CONFIG_LOOKUP = ["komut", "migration komutu", "dotnet ef", "npm run", "adım ", "nasıl kurulur", "setup", "install", "configuration", "appsettings", "env ", ".env", "environment variable", "port ", "docker", "dockerfile", "script ", "pipeline ", "çalıştır", "run ", "build ", "deploy"]
CODE_RELATION = ["çağırıyor", "bağımlılık", "dependency", "depends on", "implements", "extends", "inherits", "kullanıyor", "inject", "injects", "calls", "where is used", "nerede kullanılıyor", "callers of", "usages", "service that", "class that", "handler for", "repository of", "nasıl çalışıyor", "how does", "akış", "flow"]
TOP_K = {"factual_doc": 8, "code_relation": 10, "config_lookup": 5, "broad_summary": 12}
TECHNICAL = [r"\b[A-Z][a-zA-Z]+(?:Service|Controller|Repository|Handler|Middleware|Store|Manager)\b", r"\b(?:jwt|oauth|dto|api|http|sql|redis|qdrant|neo4j|grpc|rest|graphql)\b", r"\b(?:async|await|inject|interface|abstract|override|virtual)\b", r"\b[A-Za-z]+(?:Exception|Error|Result|Response|Request)\b"]
AMBIGUOUS = [r"\bneden\b", r"\bnasıl\b", r"\bniçin\b", r"\bgidiyor\b", r"\bdüşüyor\b", r"\bçalışmıyor\b", r"\bwhy\b", r"\bhow come\b", r"\bwhat happens\b"]
# token budgets by query type
TOKEN_BUDGET = {"config_lookup": 1200, "factual_doc": 1800, "code_relation": 2500, "broad_summary": 4000}
CHARS_PER_TOKEN = 4
# weights of the final score, and bonus points by chunk type
WEIGHTS = {"retrieval": 0.51, "rerank": 0.30, "centrality": 0.15, "recency": 0.04}
TYPE_POINTS = {"function": 6, "method": 5, "interface": 4, "class": 3, "file": 2, "module": 1}
WHOLE_FILE_TYPES = ["architecture_analysis", "broad_summary", "dependency_tracing"]
# query types that the graph augments
GRAPH_FIRST_TYPES = ["code_relation", "broad_summary"]
# complexity signals
ARCHITECTURE = ["refactor", "refaktör", "yeniden yaz", "rewrite", "mimari", "architecture", "tasarla", "design", "soyutla", "abstract", "katman", "layer", "güvenlik", "security", "vulnerability", "açık", "injection", "auth", "authentication", "authorization", "migration", "migrate", "şema", "schema", "performans", "performance", "optimize", "optimizasyon", "deadlock", "race condition", "concurrency", "dependency", "bağımlılık", "interface", "arayüz"]
STACK_TRACE = [r"(?i)traceback", r"at line \d+", r"(?i)exception:", r"(?i)error:", r"(?im)^\s+file \".*\", line \d+", r"(?i)caused by", r"(?i)stacktrace|stack trace"]
MULTI_FILE = [r"\b\w+\.\w{2,4}\b.*\b\w+\.\w{2,4}\b", r"(?i)\bve\b.+\bdosya", r"(?i)\band\b.+\bfile", r"(?i)(güncelle|update|değiştir|modify).+(ve|and)", r"(?i)tüm (dosyalar|projede|servislerde)", r"(?i)all (files|services|modules)"]
# task types by counts of substrings, first best wins
TASK_TYPES = {
    "bugfix": ["fix", "hata", "bug", "düzelt", "broken", "crash", "error", "exception", "fail", "çalışmıyor", "kırık"],
    "refactor": ["refactor", "refaktör", "yeniden yaz", "rewrite", "temizle", "clean", "reorganize", "soyutla", "abstract", "optimize"],
    "test": ["test", "unit test", "integration test", "coverage", "kapsam", "spec", "doğrula"],
    "security": ["security", "güvenlik", "vulnerability", "açık", "injection", "auth", "ssl", "xss", "csrf", "sanitize"],
    "docs": ["döküman", "document", "readme", "comment", "yorum", "açıkla", "docstring"],
    "feature": ["ekle", "add", "implement", "oluştur", "create", "yeni", "new", "geliştir", "develop"],
}
# security rules: id, severity, pattern
SECURITY_RULES = [
    ("SQL_INJECTION", "CRITICAL", r"(?i)(execute|query|raw)\s*\(\s*[\"'].*(%s|\{|format|f[\"'])"),
    ("HARDCODED_SECRET", "HIGH", r"(?i)(password|secret|api_key|token|passwd)\s*=\s*[\"'][^\"']{6,}[\"']"),
    ("EVAL_EXEC", "HIGH", r"(?i)\b(eval|exec)\s*\("),
    ("SHELL_INJECTION", "CRITICAL", r"(?i)(subprocess\.call|os\.system|os\.popen|shell=True)"),
    ("XSS_PATTERN", "MEDIUM", r"(?i)innerHTML\s*=|document\.write\s*\("),
    ("PATH_TRAVERSAL", "HIGH", r"\.\./|\.\.\\\\"),
    ("INSECURE_RANDOM", "MEDIUM", r"\brandom\.(random|randint|choice)\b"),
    ("PICKLE_DESERIALIZATION", "HIGH", r"\bpickle\.(load|loads)\b"),
]
SEVERITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
# role detectors
DTO_SUFFIXES = ["Dto", "DTO", "Model", "ViewModel", "Request", "Response", "Payload"]
DTO_PATHS = ["dtos/", "dto/", "models/", "viewmodels/"]
MIGRATION_PATHS = ["migrations/", "migrate/", "migration/"]
RULE_WORDS = ["rule", "policy", "validator", "validation", "constraint", "assertion"]
RULE_PATHS = ["/rules/", "/policies/", "/validators/", "/validations/"]
ENTITY_PATHS = ["/entities/", "/domain/"]
WRITE_WORDS = ["create", "insert", "update", "delete", "save", "remove", "mutate", "modify", "set", "add", "put", "patch"]
READ_WORDS = ["get", "find", "list", "search", "read", "fetch", "query", "select", "retrieve", "load"]
# document metadata by file name: layer, priority, required at session start
DOC_FILES = [
    ("security.md", "security", "critical", True), ("rules.md", "rules", "critical", True), ("backend.md", "backend", "high", False), ("frontend.md", "frontend", "high", False),
    ("entity-template.md", "entity", "high", False), ("init.md", "init", "high", False), ("state.md", "state", "normal", True), ("tasks.md", "state", "normal", True),
    ("context.md", "state", "normal", True), ("ai-rules.md", "rules", "normal", False), ("pr-checklist.md", "rules", "normal", False), ("multi-dbcontext.md", "backend", "normal", False),
]
# model class by task
ROUTES = {
    "classify": "local", "rerank": "local", "answerability": "local", "deduplicate": "local", "query_rewrite": "budget", "hyde": "budget", "memory_compact": "budget", "fact_extract": "budget",
    "summarize": "analysis", "explain": "analysis", "security": "analysis", "test_suggest": "analysis", "refactor": "analysis", "architecture": "reasoning", "broad_analysis": "reasoning", "execute_plan": "reasoning",
}
NODE_LABELS = ["Repository", "Module", "Package", "File", "Class", "Interface", "Function", "Method", "Endpoint", "Entity", "DTO", "Config", "Migration", "UIComponent", "BusinessRule", "Decision", "Owner"]
EDGE_TYPES = ["CONTAINS", "OWNS", "CALLS", "IMPLEMENTS", "DEPENDS_ON", "EXPOSES_ENDPOINT", "USES_CONFIG", "MUTATES_ENTITY", "READS_ENTITY", "RELATES_TO_RULE", "AFFECTS_MODULE", "SUPERSEDES_DECISION"]
# edge types that walks follow: expansion from entry points, callers (backwards), dependencies, communities
EXPAND_TYPES = ["CONTAINS", "OWNS", "CALLS"]
CALLER_TYPES = ["CALLS", "DEPENDS_ON", "OWNS", "AFFECTS_MODULE"]
DEPENDENCY_TYPES = ["CALLS", "DEPENDS_ON", "OWNS", "USES_CONFIG"]
COMMUNITY_TYPES = ["CALLS", "DEPENDS_ON"]
# formats of rendered text
MEMORY_HEAD = "## Bellek"
CONTEXT_CUT = "\n...[bağlam token bütçesi aşıldı, kırpıldı]"
RESULT_HEAD = "## '%s' için Sonuçlar (%d blok)"
LINES_WORD = "` satır "
IMPACT_HEAD = "Etkilenen %d dosya (yüksek risk: %d):"
IMPACT_LINE = "  %s → skor=%.2f risk=%s"
DOC_STRING_CUT = "  # ... (kısaltıldı)\n"
# licence head of a file, sought in its first 20 lines and cut if it begins before the fifth character
LICENSE_HEAD = r"(?:#.*copyright.*\n|#.*license.*\n|/\*.*copyright[\s\S]*?\*/\n?|<!--.*copyright[\s\S]*?-->\n?)"
# commands: parts that no command may hold, arguments, folders, programs by path, shell flags
DANGEROUS_PARTS = ["rm -rf /", "mkfs", "dd if=", "shutdown", ":(){ :|:& };:"]
BLOCKED_ARGUMENTS = ["-rf", "-fr", "--force", "--no-verify", "--delete", "--hard", "--no-gpg-sign", "--allow-unrelated-histories", "--mirror", "--delete-before", "-fdelete", "--force-delete"]
BLOCKED_FOLDERS = [".git", ".env", "node_modules", "__pycache__", ".pytest_cache"]
ALLOWED_PROGRAMS = ["/usr/bin/python3", "/usr/local/bin/python3", "/usr/bin/node", "/usr/local/bin/node", "/bin/bash", "/usr/bin/bash"]
SHELLS = ["/bin/bash", "/usr/bin/bash"]
BLOCKED_SHELL_FLAGS = ["-c", "-lc"]
# audit vocabulary, task states
AUDIT_EVENTS = ["retrieval_request", "execution_command", "approval_decision", "memory_write", "index_invalidation"]
TASK_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "SUSPENDED", "CANCELLED"]
# phases of a test-driven run
PHASES = ["SPEC", "TEST", "CONTEXT", "EDIT", "VERIFY", "IMPACT", "REFLECT", "COMMIT", "DONE"]
# languages of a profile by file extension, and the folders it leaves out
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript-react", ".js": "javascript", ".jsx": "javascript-react", ".cs": "csharp", ".go": "go", ".rs": "rust",
    ".java": "java", ".kt": "kotlin", ".swift": "swift", ".dart": "dart",
}
PROFILE_EXCLUDED = ["node_modules", "bin", "obj", "dist", ".next", "__pycache__", ".venv", "venv", "migrations", ".git"]
# files that are indexed, files that are analysed, and the folders left out by each
SOURCE_EXTENSIONS = [".py", ".ts", ".tsx", ".cs"]
SOURCE_EXCLUDED = ["node_modules", "bin", "obj", "dist", ".next", "__pycache__", ".venv", "venv", "migrations", ".git"]
ANALYSIS_EXTENSIONS = [".py", ".cs", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".dart", ".kt", ".swift", ".rb", ".php", ".rs"]
ANALYSIS_EXCLUDED = [".git", "bin", "obj", "node_modules", "__pycache__", ".idea", "dist", "build", ".vs", "out", "publish", "htmlcov", ".pytest_cache"]
DOCS_EXCLUDED = ["README.md", "CHANGELOG.md", "LICENSE.md"]
# marker files of frameworks: pattern, framework, package manager; entry files
MARKERS = [
    (r"\.slnx?$|(^|/)global\.json$", ".NET", "nuget"), (r"(^|/)package\.json$", "Node.js", "npm"), (r"(^|/)angular\.json$", "Angular", None),
    (r"(^|/)pubspec\.yaml$", "Flutter", "pub"), (r"(^|/)(requirements\.txt|pyproject\.toml)$", "Python", "pip"), (r"(^|/)(docker-compose\.yml|Dockerfile)$", "Docker", None),
]
ENTRY_FILES = ["Program.cs", "main.py", "manage.py", "app.py", "main.ts", "main.dart"]
# nodes of a task, in order
TASK_NODES = ["planner", "retriever", "explainer", "editor", "verifier", "reviewer", "summarizer"]
# words that are no symbols of a goal, and languages by file ending
SYMBOL_STOP = ["görev", "dosya", "proje", "kodda", "bunu", "için", "olan"]
# environment names and HTTP routes in code
PYTHON_ENV = [r"os\.getenv\([\"'](.*?)[\"']\)", r"os\.environ\[[\"'](.*?)[\"']\]"]
TYPESCRIPT_ENV = [r"process\.env\.([a-zA-Z0-9_]+)", r"process\.env\[[\"'](.*?)[\"']\]"]
CSHARP_ENV = [r"Configuration\[[\"'](.*?)[\"']\]", r"Environment\.GetEnvironmentVariable\([\"'](.*?)[\"']\)"]
# payload of a document chunk, with its defaults
DOC_PAYLOAD = {
    "chunk_id": "", "checksum": "", "relative_path": "", "content": "", "h1": "", "h2": "", "h3": "", "doc_priority": "normal", "required_on_session_start": False,
    "layer": "general", "source_type": "agent_doc", "schema_version": 1, "is_deleted": False, "updated_at": 0.0,
}
# texts of profiles and summaries, and of what is put for a missing part
PROFILE_SUMMARY = "%s projesi %d kaynak dosya içeriyor. Diller: %s. Frameworkler: %s. Öne çıkan modüller: %s."
PROFILE_TEXT = "Proje: %s\nKoleksiyon: %s\nPath: %s\nDiller: %s\nFrameworkler: %s\nPaket yöneticileri: %s\nEntrypoint'ler: %s\nÖzet: %s"
REPO_TEXT = "%s repository summary.\nModule roots: %s.\nBu proje için architecture, onboarding ve impact analysis sorgularında ilk bağlam olarak kullanılmalıdır."
MODULE_TEXT = "Modül yolu: %s\nProje: %s\nKoleksiyon: %s\nBu modül %s içinde önemli bir kök klasördür ve architecture sorgularında öncelikli bağlamdır."
UNKNOWN, NOT_FOUND, NOT_DETECTED, NONE = "bilinmiyor", "tespit edilemedi", "tespit edilmedi", "yok"
# texts of learning records, and the step of a plan without any
LEARNED_TITLE = "Başarılı Adım: "
LEARNED_TEXT = "Görev: %s\n\nAdım: %s\n\nSonuç: %s"
SOLVED_TITLE = "Başarılı çözüm: "
SOLVED_TEXT = "Görev '%s' başarıyla %s ile %d reflection sonrası çözüldü."
FAILED_TITLE = "Başarısız pattern [%s]"
FAILED_TEXT = "Pattern %s'da başarısız oldu (reflection=%d): %s"
DEFAULT_STEP = "Görevi analiz et"
# fixed patterns of HTTP routes in code: decorators with a path, decorators with a method, attributes of typed languages
ENDPOINT_PATH = r"@[\w.]+\(\s*[\"']([^\"']+)[\"']"
ENDPOINT_METHOD = r"@(?:api_view|require_http_methods)\(\s*\[?\s*[\"']([A-Z]+)[\"']"
ENDPOINT_ATTRIBUTE = r"[@\[](?:Get|Post|Put|Delete|Patch|HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\s*\(\s*[\"']?([^\"']*)[\"']?\s*\)"
# fixed patterns of what a goal names: files, capitalised names, other names
GOAL_FILE = r"\b[\w/.-]+\.(?:py|ts|tsx|js|go|java|rb|rs|cs|cpp|h)\b"
GOAL_NAME, GOAL_SYMBOL = r"\b[A-Z][a-zA-Z0-9]{2,}\b", r"\b[a-z][a-z0-9_]{2,}\b"
