"""Word lists, tables and patterns whose values are given.

Fixed values: results depend on exactly these, so they stand here together as plain text.
"""

from __future__ import annotations

# Words that are no identifiers.
KEYWORDS = """
function class const let var async await static return if else for while do switch case break
continue try catch finally throw new this super extends implements interface type enum export import
from default public private protected readonly abstract null undefined true false void never any
string number boolean object symbol bigint
""".split()

# Patterns whose first group is an identifier. An import clause names none by itself.
IDENTIFIER_PATTERNS = (
    r"\b(?:function|class|const|let|var|async|static|interface|type|enum)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    r"from\s+['\"]([^'\"]+)['\"]",
    r"(?m)(?:^|\s)([a-zA-Z_$][a-zA-Z0-9_$]*)\s*(?:=|:|\()",
)

# Words that name the same thing in code.
SYNONYMS = {
    "auth": ["authentication", "authorize", "login", "signin", "credential"],
    "authentication": ["auth", "authorize", "login", "signin", "credential"],
    "authorize": ["auth", "authentication", "permission", "access"],
    "db": ["database", "sql", "query", "storage"],
    "database": ["db", "sql", "query", "storage"],
    "api": ["endpoint", "route", "handler", "controller"],
    "handler": ["callback", "listener", "event", "api"],
    "config": ["configuration", "settings", "options", "env"],
    "cfg": ["config", "configuration", "settings", "options"],
    "configuration": ["config", "cfg", "settings", "options"],
    "settings": ["config", "cfg", "configuration", "options"],
    "error": ["exception", "err", "fail", "throw"],
    "exception": ["error", "err", "fail", "throw"],
    "err": ["error", "exception", "fail"],
    "test": ["spec", "testing", "unittest", "vitest", "jest"],
    "spec": ["test", "testing", "unittest"],
    "util": ["utility", "helper", "tool", "lib"],
    "utility": ["util", "helper", "tool"],
    "helper": ["util", "utility", "tool"],
    "async": ["asynchronous", "promise", "await", "callback"],
    "cb": ["callback", "handler", "listener"],
    "callback": ["cb", "handler", "listener", "async"],
    "http": ["request", "response", "fetch", "api"],
    "req": ["request", "http", "fetch"],
    "res": ["response", "http", "result"],
    "request": ["req", "http", "fetch"],
    "response": ["res", "http", "result"],
    "cache": ["cached", "memoize", "store", "memory"],
    "mem": ["memory", "cache", "buffer"],
    "memory": ["mem", "cache", "store"],
    "buf": ["buffer", "data", "bytes"],
    "buffer": ["buf", "data", "bytes"],
    "vector": ["embedding", "semantic", "similarity"],
    "embedding": ["vector", "semantic", "similarity"],
    "search": ["find", "query", "lookup", "match"],
    "index": ["indexed", "indices", "catalog", "directory"],
    "ctx": ["context", "scope", "env"],
    "context": ["ctx", "scope"],
    "msg": ["message", "payload", "data"],
    "message": ["msg", "payload", "event"],
    "str": ["string", "text", "chars"],
    "string": ["str", "text", "chars"],
    "num": ["number", "count", "int", "integer"],
    "number": ["num", "count", "int"],
    "len": ["length", "count", "size"],
    "length": ["len", "count", "size"],
    "val": ["value", "result", "data"],
    "value": ["val", "result", "data"],
    "idx": ["index", "position", "offset"],
    "ptr": ["pointer", "reference", "ref"],
    "ref": ["reference", "ptr", "pointer"],
    "init": ["initialize", "setup", "start", "bootstrap"],
    "initialize": ["init", "setup", "start"],
    "setup": ["init", "initialize", "configure"],
    "fn": ["function", "method", "handler"],
    "func": ["function", "method", "handler"],
    "function": ["fn", "func", "method"],
    "method": ["fn", "func", "function"],
    "conn": ["connection", "socket", "link"],
    "connection": ["conn", "socket", "link"],
    "pool": ["connection", "conn", "resources"],
}

# Weight of a file by the end of its name; any other end weighs 1.
FILE_TYPE_MULTIPLIERS = {
    "ts": 1.2,
    "tsx": 1.2,
    "mjs": 1.0,
    "cjs": 1.0,
    "js": 1.0,
    "jsx": 1.0,
    "py": 1.1,
    "pyi": 1.1,
    "java": 1.0,
    "kt": 1.1,
    "kts": 1.1,
    "scala": 1.0,
    "groovy": 1.0,
    "cs": 1.1,
    "fs": 1.0,
    "fsx": 1.0,
    "c": 1.0,
    "cpp": 1.1,
    "cc": 1.1,
    "cxx": 1.1,
    "h": 0.9,
    "hpp": 0.9,
    "hxx": 0.9,
    "go": 1.0,
    "rs": 1.1,
    "vue": 1.1,
    "svelte": 1.1,
    "astro": 1.0,
    "html": 0.8,
    "htm": 0.8,
    "css": 0.8,
    "scss": 0.9,
    "sass": 0.9,
    "less": 0.9,
    "rb": 1.0,
    "rake": 0.9,
    "erb": 0.8,
    "php": 1.0,
    "phtml": 0.8,
    "swift": 1.1,
    "m": 1.0,
    "mm": 1.0,
    "dart": 1.1,
    "ex": 1.0,
    "exs": 1.0,
    "erl": 1.0,
    "hrl": 0.9,
    "hs": 1.0,
    "lhs": 0.9,
    "ml": 1.0,
    "mli": 0.9,
    "lua": 1.0,
    "sh": 0.9,
    "bash": 0.9,
    "zsh": 0.9,
    "fish": 0.9,
    "ps1": 0.9,
    "psm1": 0.9,
    "json": 0.9,
    "jsonc": 0.9,
    "yaml": 0.8,
    "yml": 0.8,
    "toml": 0.9,
    "xml": 0.8,
    "md": 0.8,
    "mdx": 0.9,
    "rst": 0.8,
    "txt": 0.7,
    "tf": 0.9,
    "hcl": 0.9,
    "graphql": 1.0,
    "gql": 1.0,
    "prisma": 1.0,
    "proto": 1.0,
    "sql": 1.0,
}

# Words left out of variants of a name.
VARIANT_STOPWORDS = "by to from of the a an in on for".split()

# Lines at which a unit of code begins, by the end of the file's name.
_NAME = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
_WORD = r"[a-zA-Z_][a-zA-Z0-9_]*"
JS_FUNCTIONS = (
    rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{_NAME}\s*\(",
    rf"^\s*(?:export\s+)?(?:public|private|protected)?\s*(?:async\s+)?{_NAME}\s*\([^)]*\)\s*(?::\s*[^{{]+)?\s*\{{",
    rf"^\s*(?:export\s+)?const\s+{_NAME}\s*=\s*(?:async\s+)?(?:\([^)]*\)|{_NAME})\s*(?::\s*[^{{]+)?\s*=>\s*",
    rf"^\s*{_NAME}\s*:\s*(?:async\s+)?(?:function\s+)?\([^)]*\)\s*(?::\s*[^{{]+)?\s*\{{",
)
JS_CLASS = rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"
JS_INTERFACE = rf"^\s*(?:export\s+)?interface\s+{_NAME}"
JS_OTHER = (rf"^\s*(?:export\s+)?type\s+{_NAME}\s*=", rf"^\s*(?:export\s+)?enum\s+{_NAME}")
IMPORT = r"^\s*(?:import|export)\s+"
COMMENT = r"^\s*(?:\/\/|\/\*|\*|<!--)"
LANGUAGE_PATTERNS = {
    # ends: ((kind, pattern), ...) in order of trial
    ("py",): (("function", rf"^\s*(?:async\s+)?def\s+{_WORD}\s*\("), ("class", rf"^\s*class\s+{_WORD}\s*[:(]")),
    ("go",): (("function", rf"^\s*func\s+(?:\([^)]+\)\s+)?{_WORD}\s*\("),),
    ("rs",): (("function", rf"^\s*(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?fn\s+{_WORD}\s*[<(]"), ("class", rf"^\s*(?:pub(?:\([^)]+\))?\s+)?(?:impl|trait|struct|enum|mod)\s+{_WORD}")),
    ("cs", "java"): (
        ("class", rf"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|interface|struct|enum|record)\s+{_WORD}"),
        ("function", rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|new|sealed|partial|extern)\s+)+(?:[\w<>\[\]?]+\s+)+{_WORD}\s*\("),
    ),
    ("c", "cpp", "cc", "cxx"): (("function", rf"^\s*(?:static\s+|inline\s+|extern\s+)?(?:const\s+)?\w[\w\s*]+\s+{_WORD}\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$"),),
    ("rb",): (("function", r"^\s*def\s+(?:self\.)?[a-zA-Z_][a-zA-Z0-9_?!]*"), ("class", r"^\s*(?:class|module)\s+[A-Z][a-zA-Z0-9_]*")),
    ("php",): (("function", rf"^\s*(?:public|private|protected|static|abstract|\s)*function\s+{_WORD}\s*\("), ("class", rf"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait|enum)\s+{_WORD}")),
    ("swift",): (
        ("function", rf"^\s*(?:public|private|internal|fileprivate|open|\s)*(?:override\s+)?(?:static\s+|class\s+)?func\s+{_WORD}\s*[<(]"),
        ("class", rf"^\s*(?:public|private|internal|fileprivate|open|\s)*(?:class|struct|enum|protocol|extension|actor)\s+{_WORD}"),
    ),
    ("kt", "kts"): (
        ("function", rf"^\s*(?:public|private|protected|internal|override|suspend|\s)*fun\s+{_WORD}\s*[<(]"),
        ("class", rf"^\s*(?:public|private|protected|internal|abstract|sealed|data|open|\s)*(?:class|interface|object|enum\s+class)\s+{_WORD}"),
    ),
}
JS_ENDS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "")
DECLARATION = rf"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+{_NAME}"

# Parts of paths that are never indexed. The last one is the folder of this engine itself.
BLACKLIST = """
/.git/ /.svn/ /.hg/ /.bzr/
/.env .pem .key .p12 .pfx /secrets/ /.secrets/
/node_modules/ /vendor/ /bower_components/ /__pypackages__/ /.pnp/ /.yarn/cache/
/venv/ /.venv/ /env/ /__pycache__/ /.pytest_cache/ /.mypy_cache/ /.ruff_cache/ /.tox/ .egg-info/ /site-packages/
/dist/ /build/ /out/ /output/ /target/ /bin/ /obj/ /.next/ /.nuxt/ /.svelte-kit/ /_site/ /public/build/ /.turbo/ /.vercel/ /.netlify/
.min.js .min.css .map .pb.go _pb2.py .generated.ts .generated.js
/.idea/ /.vscode/ /.vs/
/.cache/ /tmp/ /temp/ /.temp/ /.tmp/
/coverage/ /.nyc_output/ /htmlcov/
/.terraform/ .tfstate
/.siltstone/
""".split()

# What is indexed unless told otherwise.
INCLUDE_ENDS = """
ts tsx js jsx mjs cjs py pyi go rs java kt kts scala groovy cs fs fsx c cpp cc cxx h hpp hxx
vue svelte astro html htm css scss sass less rb rake erb php phtml swift m mm dart ex exs erl hrl hs lhs ml mli lua
sh bash zsh fish ps1 psm1 sql json jsonc yaml yml toml xml md mdx rst txt tf hcl dockerfile
mk cmake graphql gql prisma proto
""".split()
INCLUDE_GLOBS = [f"**/*.{end}" for end in INCLUDE_ENDS] + ["**/Dockerfile", "**/Makefile", "**/CMakeLists.txt"]

# What is left out unless told otherwise.
EXCLUDE_GLOBS = """
.git/** .svn/** .hg/** .bzr/**
node_modules/** vendor/** bower_components/** __pypackages__/** .pnp/** .yarn/cache/**
venv/** .venv/** env/** .env/** __pycache__/** .pytest_cache/** .mypy_cache/** .ruff_cache/** .tox/** *.egg-info/** site-packages/**
dist/** build/** out/** output/** target/** bin/** obj/** .next/** .nuxt/** .svelte-kit/** _site/** public/build/** .turbo/** .vercel/** .netlify/**
*.class *.jar *.war *.aar .gradle/** gradle/**
*.min.js *.min.css *.map *.pb.go *_pb2.py *.generated.ts *.generated.js
*.lock package-lock.json yarn.lock pnpm-lock.yaml Pipfile.lock poetry.lock Cargo.lock go.sum Gemfile.lock composer.lock
.env .env.* *.pem *.key *.p12 *.pfx secrets/** .secrets/**
.idea/** .vscode/** .vs/** *.swp *.swo .project .classpath
.DS_Store Thumbs.db desktop.ini
.cache/** tmp/** temp/** .temp/** .tmp/**
coverage/** .nyc_output/** htmlcov/** .coverage
logs/** *.log
*.png *.jpg *.jpeg *.gif *.ico *.svg *.webp *.woff *.woff2 *.ttf *.eot *.otf *.mp4 *.mp3 *.webm
*.zip *.tar *.gz *.tgz *.bz2 *.7z *.rar
*.sqlite *.sqlite3 *.db
.terraform/** *.tfstate *.tfstate.backup
.siltstone/**
*.dll *.exe *.pdb *.nupkg packages/**
*.o *.a *.so *.dylib CMakeFiles/** cmake-build-*/**
*.xcodeproj/** *.xcworkspace/** DerivedData/** Pods/** .build/**
*.apk *.aab *.dex
.dart_tool/** .flutter-plugins .flutter-plugins-dependencies
.bundle/**
*.phar
_build/** .elixir_ls/** deps/**
.stack-work/** dist-newstyle/**
**/.cargo/registry/**
**/.gopath/**
*.pyc *.pyo *.beam *.hi
storybook-static/** .storybook/public/** __snapshots__/**
""".split()

# Ends of file names that make a command a search in code.
GREP_ENDS = "ts|tsx|js|jsx|mjs|cjs|py|pyi|go|rs|java|kt|kts|scala|cs|fs|c|cpp|cc|cxx|h|hpp|vue|svelte|astro|html|css|scss|rb|php|swift|dart|ex|exs|erl|hs|lua|sh|bash|sql|md|mdx|tf|graphql|proto"

# Patterns of a search in code and of its pattern.
GREP_FILE = rf"(?m)\.({GREP_ENDS})$"
QUOTED_GREP = r"(?m)^[^>]*grep\s+[^|]*['\"][^'\"]+['\"][^|]*$"
PIPED_GREP = r"\|\s*grep"
GREP_PATTERN = r"grep\s+(?:-[a-zA-Z]+\s+)*[\"']([^\"']+)[\"']"

# Patterns of commands that take files away, of breaks between arguments, of what is no argument.
DELETE_PATTERNS = (r"(?:^|\s)(?:rm|rmdir)\s+(?:-[rf]+\s+)?([^\n]+)", r"git\s+mv\s+([^\n]+)")
ARGUMENT_BREAK = r"[&|;\s]+"
NO_ARGUMENT = r"^[{}|$&<>`]"

# Characters that mean something in a keyword query, and how many terms a query has at most.
SPECIAL = r"""[:"()'*+\-^~]"""
MAX_QUERY_TERMS = 20
