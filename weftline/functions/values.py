"""Lists and patterns that results must agree on."""

from __future__ import annotations

# --- fixed values: path parts that a scan leaves out (globs on one path part) ---
EXCLUDE = """
.git node_modules __pycache__ .venv venv env .env build dist target .pytest_cache .mypy_cache .ruff_cache .coverage
htmlcov *.egg-info .tox .idea .vscode _archive .archive .weftline *.pyc *.pyo *.pyd *.so *.dll *.exe *.bin *.obj *.o *.a
*.lib *.jar *.war *.ear *.class .DS_Store Thumbs.db *.log *.tmp *.temp *.swp *.swo *~
""".split()

# --- fixed values: globs of test files, path parts that mark tests ---
TEST_GLOBS = """
test_*.py *_test.py tests/**/*.py test/**/*.py spec/**/*.js spec/**/*.ts *_spec.rb *_test.go *Test.java test_*.rs
*_test.cc *_test.cpp
""".split()
TEST_PARTS = ["test", "tests", "testing", "spec", "specs"]

# --- fixed values: globs of configuration files ---
CONFIG_GLOBS = """
*.yaml *.yml *.json *.toml *.ini *.cfg *.conf *.config pyproject.toml setup.py setup.cfg requirements*.txt Pipfile
Pipfile.lock poetry.lock Cargo.toml Cargo.lock go.mod go.sum pom.xml build.gradle package.json package-lock.json
yarn.lock tsconfig.json .eslintrc* .prettierrc* Dockerfile docker-compose*.yml Makefile CMakeLists.txt
""".split()

# --- fixed values: names of entry points ---
ENTRYPOINT_NAMES = """
main.py __main__.py app.py server.py cli.py run.py manage.py index.js index.ts main.js main.ts app.js app.ts server.js
server.ts main.rs main.go Main.java Program.cs
""".split()
ENTRYPOINT_STEMS = ["main", "app", "server", "cli", "run", "index", "manage", "start", "entry", "bootstrap", "launcher"]

# --- fixed values: languages with their extensions, and file name globs where there is no extension ---
LANGUAGES = """
python .py .pyw .pyi
javascript .js .jsx .mjs .cjs
typescript .ts .tsx .mts .cts
rust .rs
go .go
java .java
c .c .h
cpp .cpp .cc .cxx .c++ .hpp .hh .hxx .h++
csharp .cs
ruby .rb .rbw
php .php .phtml .php3 .php4 .php5 .phps
swift .swift
kotlin .kt .kts
scala .scala .sc
r .r
lua .lua
perl .pl .pm .pod .t
bash .sh .bash .zsh .fish
toml .toml
json .json .jsonc
yaml .yaml .yml
html .html .htm .xhtml
css .css .scss .sass .less
sql .sql
markdown .md .markdown .mdown .mkd
dockerfile Dockerfile dockerfile Dockerfile.*
make Makefile makefile GNUmakefile *.mk
cmake .cmake CMakeLists.txt
protobuf .proto
graphql .graphql .gql
vue .vue
svelte .svelte
matlab .m
julia .jl
rst .rst
"""
EXTENSIONS = {x: line.split()[0] for line in LANGUAGES.strip().splitlines() for x in line.split()[1:] if x.startswith(".")}
NAME_GLOBS = [(x, line.split()[0]) for line in LANGUAGES.strip().splitlines() for x in line.split()[1:] if not x.startswith(".")]

# --- fixed values: words that make a function look like an equation ---
EQUATION_WORDS = """
loss gradient optimizer backprop forward pid control matrix tensor eigen sigmoid softmax relu activation convolution
pooling attention kalman filter estimate predict integral derivative differential
""".split()

# --- fixed values: edge types that carry impact, and those that count as references ---
IMPACT_EDGES = ["CALLS", "USES", "DEPENDS_ON", "IMPORTS", "READS", "WRITES", "MODIFIES"]
REFERENCE_EDGES = ["IMPORTS", "CALLS", "USES", "READS", "DEPENDS_ON"]
DERIVED_EDGES = ["USES_EQUATION", "EQUATION_INPUT", "EQUATION_OUTPUT", "EQUATION_INTERMEDIATE", "EQUATION_DEPENDS_ON"]
#: Lists of an equation's analysis, the role of the variables they name, and the edge type.
EQUATION_LISTS = [
    ("inputs", "input", "EQUATION_INPUT"),
    ("outputs", "output", "EQUATION_OUTPUT"),
    ("intermediate_variables", "intermediate", "EQUATION_INTERMEDIATE"),
    ("constants", "constant", "EQUATION_DEPENDS_ON"),
]

#: Who made an edge: the static extraction or an analysis.
BY_EXTRACTION, BY_ANALYSIS = "static_locator", "llm_analyzer"

# --- fixed values: kinds of class-like definitions by the name of the query that finds them ---
CLASS_KINDS = """
classes class
structs struct
enums enum
interfaces interface
impls impl
traits trait
types type
"""

# --- fixed values: allowed words of analysis results ---
FILE_PURPOSES = "entrypoint core_logic utility configuration test data_model api_interface unknown".split()
SYMBOL_ROLES = "main_logic helper data_access business_rule validation transformation control_flow unknown".split()
EQUATION_KINDS = "control loss matrix optimization statistical physics mathematical algorithmic neural_network unknown".split()
VARIABLE_ROLES = "input output state parameter constant intermediate configuration unknown".split()
RISKS = "low medium high critical".split()

# --- fixed values: fields of analysis results; a text, flag or share without default is required ---
RESULT_FIELDS = {
    "file": """
purpose file_purposes unknown
summary text
is_core flag false
key_concepts texts
risk_notes texts
confidence share
suggested_queries texts
""",
    "symbol": """
responsibility text
role symbol_roles unknown
side_effects texts
preconditions texts
postconditions texts
complexity text unknown
confidence share
related_equations texts
data_flow pairs
""",
    "equation": """
equation_type equation_kinds unknown
name maybe
mathematical_meaning text
physical_meaning maybe
algorithmic_role text
inputs texts
outputs texts
intermediate_variables texts
constants texts
units pairs
assumptions texts
confidence share
evidence text
""",
    "variable": """
role variable_roles unknown
inferred_meaning text
unit maybe
shape maybe
confidence share
""",
    "dependency": """
depends_on texts
affects texts
data_flow_edges edges
confidence share
""",
    "impact": """
affected_files texts
affected_symbols texts
affected_equations texts
risk_level risks low
risk_summary text
suggested_test_files texts
suggested_order texts
confidence share
""",
    "delete": """
can_delete flag
risk_level risks low
references texts
dependents texts
orphaned_code texts
recommendation text
confidence share
""",
}
ALLOWED = {
    "file_purposes": FILE_PURPOSES,
    "symbol_roles": SYMBOL_ROLES,
    "equation_kinds": EQUATION_KINDS,
    "variable_roles": VARIABLE_ROLES,
    "risks": RISKS,
}

# --- fixed values: US dollars for a million tokens, in and out, by model, and where the model is not listed ---
MODEL_PRICES = {
    "claude-3-5-sonnet-20241022": (3.0, 15.0),
    "claude-3-opus-20240229": (15.0, 75.0),
    "gpt-4o": (5.0, 15.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gemini-1.5-pro": (3.5, 10.5),
}
DEFAULT_PRICES = (5.0, 15.0)
OUTPUT_TOKENS = 500

# --- fixed values: sections and titles of the manual, in order ---
MANUAL = """
overview Project Overview
query Querying Files
query Querying Symbols
query Querying Equations
safety Before Modifying
safety Before Deleting
recommendations Recommended Queries
"""
