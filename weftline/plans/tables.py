"""The graph's tables, projected from relational tables; the same SQL text serves Spark and the oracle."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.postings import Index
from weftline.sources.shared import shared_folder

#: Indexes that this process has opened.
OPENED: dict = {}

PROJECTIONS = {
    # polymorphic adjacency list; the reverse DEFINES edges prove edge-type filters
    "edges": """
SELECT DISTINCT source_type, source_id, target_type, target_id, edge_type FROM (
  SELECT 'nation' AS source_type, CAST(n_nationkey AS BIGINT) AS source_id, 'region' AS target_type, CAST(n_regionkey AS BIGINT) AS target_id, 'DEPENDS_ON' AS edge_type FROM {nation}
  UNION ALL SELECT 'customer', c_custkey, 'nation', CAST(c_nationkey AS BIGINT), 'USES' FROM {customer}
  UNION ALL SELECT 'supplier', s_suppkey, 'nation', CAST(s_nationkey AS BIGINT), 'USES' FROM {supplier}
  UNION ALL SELECT 'order', o_orderkey, 'customer', o_custkey, 'CALLS' FROM {orders}
  UNION ALL SELECT 'lineitem', l_orderkey, 'order', l_orderkey, 'IMPORTS' FROM {lineitem}
  UNION ALL SELECT 'region', CAST(n_regionkey AS BIGINT), 'nation', CAST(n_nationkey AS BIGINT), 'DEFINES' FROM {nation}) u""",
    "nodes": """
SELECT 'region' AS node_type, CAST(r_regionkey AS BIGINT) AS node_id, r_name AS name FROM {region}
UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM {nation}
UNION ALL SELECT 'customer', c_custkey, c_name FROM {customer}
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM {supplier}
UNION ALL SELECT 'order', o_orderkey, o_orderpriority FROM {orders}
UNION ALL SELECT 'lineitem', l_orderkey, min(l_returnflag) FROM {lineitem} GROUP BY l_orderkey""",
    "files": """
SELECT d.doc_id AS id,
  CASE WHEN d.doc_id % 11 = 0 THEN d.source || '/_archive' WHEN d.doc_id % 13 = 0 THEN '_archive/' || d.source
       WHEN d.doc_id % 17 = 0 THEN 'test/' || d.source ELSE d.source END
  || '/' || d.lang || '/' || CASE WHEN d.doc_id % 7 = 0 THEN 'test_' ELSE '' END || 'doc_' || CAST(d.doc_id AS VARCHAR(20))
  || CASE d.doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.rs' WHEN 3 THEN '.md' ELSE '.yaml' END AS path,
  CASE WHEN d.doc_id % 7 = 0 THEN 'test_' ELSE '' END || 'doc_' || CAST(d.doc_id AS VARCHAR(20))
  || CASE d.doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.rs' WHEN 3 THEN '.md' ELSE '.yaml' END AS filename,
  d.lang AS language, d.source AS purpose, d.n_chars AS size_bytes, d.text AS text,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.text END AS llm_summary,
  CAST(NULL AS VARCHAR(20)) AS key_concepts, CASE WHEN l.toxic = 1 THEN 'toxic' END AS risk_notes,
  CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'completed' END AS analysis_status,
  coalesce(l.quality, 0) = 1 AS is_core
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "records": """
SELECT doc_id * 2 AS id, 'file' AS target_type, doc_id AS target_id,
  CASE WHEN toxic = 1 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 0.0 ELSE CAST(doc_id % 10 AS DOUBLE) / 10 END AS confidence
FROM {labels}""",
    # turns of conversations as lines of a file: a user turn opens a function, or a class when its number divides by 4
    "symbols": """
SELECT id, file_id, CASE WHEN start_line % 4 = 0 THEN 'class' ELSE 'function' END AS symbol_type,
  'turn_' || CAST(start_line AS VARCHAR(20)) AS name, 'conv_' || CAST(file_id AS VARCHAR(20)) || '.turn_' || CAST(start_line AS VARCHAR(20)) AS qualified_name,
  start_line, coalesce(next_line - 1, start_line + 3) AS end_line
FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS file_id, turn AS start_line,
             lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_line
      FROM {conversations} WHERE role = 'user') u""",
    "calls": "SELECT conv_id * 1000 + turn AS id, conv_id AS file_id, turn AS line, 'turn_' || CAST(turn % 3 AS VARCHAR(20)) AS name FROM {conversations} WHERE role <> 'user'",
    "equations": """
SELECT p_partkey AS id, p_partkey % 100 AS file_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 100) * 1000 END AS symbol_id,
  'eq_' || CAST(p_partkey % 50 AS VARCHAR(20)) AS name, p_name AS expression, p_type AS equation_type, p_size AS start_line FROM {part}""",
    "variables": """
SELECT s_suppkey AS id, s_suppkey % 100 AS file_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 100) * 1000 END AS symbol_id,
  'k' || CAST(s_suppkey % 20 AS VARCHAR(20)) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'input' ELSE 'output' END AS role FROM {supplier}""",
    # analysis results as JSON text; every tenth is not valid JSON, every seventh no valid result
    "results": """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'symbol' ELSE 'equation' END AS target_type, event_id % 400 AS target_id,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'stale' ELSE 'completed' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN event_id % 9 = 1 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) / 10 END AS confidence,
  CASE WHEN event_id % 10 = 0 THEN '{{''inputs'': [''x'']}}'
       WHEN event_id % 7 = 0 THEN '{{"summary": 5, "confidence": 1.5}}'
       ELSE '{{"responsibility": "r", "related_equations": ["eq_' || CAST(event_id % 60 AS VARCHAR(20)) || '", "", "eq_' || CAST(event_id % 8 AS VARCHAR(20))
         || '"], "inputs": ["k' || CAST(user_id % 30 AS VARCHAR(20)) || '"], "outputs": ["out"], "constants": ["", "c' || CAST(event_id % 3 AS VARCHAR(20)) || '"], "confidence": 0.5}}' END AS output_json
FROM {events}""",
    # file dependencies: those of the edges, and a made cycle of two with something that depends on it
    "deps": """
SELECT DISTINCT source_type || ':' || CAST(source_id AS VARCHAR(20)) AS source, target_type || ':' || CAST(target_id AS VARCHAR(20)) AS target
FROM (
  SELECT 'nation' AS source_type, CAST(n_nationkey AS BIGINT) AS source_id, 'region' AS target_type, CAST(n_regionkey AS BIGINT) AS target_id FROM {nation}
  UNION ALL SELECT 'customer', c_custkey, 'nation', CAST(c_nationkey AS BIGINT) FROM {customer}
  UNION ALL SELECT 'order', o_orderkey, 'customer', o_custkey FROM {orders}
  UNION ALL SELECT 'region', CAST(0 AS BIGINT), 'cycle', CAST(0 AS BIGINT) FROM {region} WHERE r_regionkey = 0
  UNION ALL SELECT 'cycle', CAST(0 AS BIGINT), 'cycle', CAST(1 AS BIGINT) FROM {region} WHERE r_regionkey = 0
  UNION ALL SELECT 'cycle', CAST(1 AS BIGINT), 'cycle', CAST(0 AS BIGINT) FROM {region} WHERE r_regionkey = 0) u""",
    # a path is a user with the number in an event's properties; its hash is the type of its last event
    "snapshot_old": """
SELECT path, hash FROM (SELECT 'u' || CAST(user_id AS VARCHAR(20)) || '/k' || substring(props, 7, length(props) - 7) AS path, event_type AS hash,
  row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS place FROM {events} WHERE ts < TIMESTAMP '2024-01-16') u WHERE place = 1""",
    "snapshot_new": """
SELECT path, hash FROM (SELECT 'u' || CAST(user_id AS VARCHAR(20)) || '/k' || substring(props, 7, length(props) - 7) AS path, event_type AS hash,
  row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS place FROM {events} WHERE ts >= TIMESTAMP '2024-01-16') u WHERE place = 1""",
    # what is handed in for files, symbols and equations; some of it is not JSON, no object, or wrong in one field
    "submissions": """
SELECT id, kind || '_' || CAST(target AS VARCHAR(20)) AS task_id, kind AS target_type, output_json FROM (
  SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'symbol' ELSE 'equation' END AS kind,
    CASE event_id % 3 WHEN 1 THEN (event_id % 90) * 1000 + event_id % 4 ELSE event_id % 700 END AS target,
    CASE WHEN event_id % 10 = 9 THEN '{{"a": ' WHEN event_id % 23 = 0 THEN '["a"]' ELSE
      '{{"purpose": "' || CASE WHEN event_id % 11 = 0 THEN 'magic' ELSE 'utility' END || '", "summary": '
      || CASE WHEN event_id % 13 = 0 THEN '5' ELSE '"does é ' || event_type || '"' END
      || ', "is_core": ' || CASE WHEN event_id % 4 = 0 THEN 'true' WHEN event_id % 29 = 0 THEN '"often"' ELSE 'false' END
      || ', "key_concepts": [' || CASE WHEN event_id % 31 = 0 THEN '1' ELSE '"' || event_type || '", "b"' END || ']'
      || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', "risk_notes": ["n"]' END
      || ', "responsibility": ' || CASE WHEN event_id % 14 = 1 THEN 'null' ELSE '"r ' || event_type || '"' END
      || ', "role": "' || CASE WHEN event_id % 17 = 1 THEN 'boss' ELSE 'helper' END || '", "side_effects": ["io", "u' || CAST(user_id AS VARCHAR(20))
      || '"], "equation_type": "' || CASE WHEN event_id % 17 = 2 THEN 'sorcery' ELSE 'loss' END || '", "name": ' || CASE WHEN event_id % 5 = 2 THEN 'null' ELSE '"eq"' END
      || ', "mathematical_meaning": "m", "algorithmic_role": "a", "evidence": "e", "inputs": ["x"], "units": {{"m": ' || CASE WHEN event_id % 19 = 2 THEN '3' ELSE '"kg"' END || '}}'
      || CASE WHEN event_id % 37 < 2 THEN '' ELSE ', "confidence": ' || CASE WHEN event_id % 16 < 2 THEN '1.5' WHEN event_id % 16 = 2 THEN '[]' WHEN event_id % 16 = 3 THEN '1' ELSE '0.5' END END || '}}'
    END AS output_json FROM {events}) u""",
    # links of pages: what a page imports
    "imports": r"""
SELECT page_id AS file_id, link AS name, place AS place FROM (
  SELECT page_id, link, place FROM {links}) u""",
    # imports under the names of modules
    "named_imports": "SELECT file_id, 'doc_' || CAST(file_id * 5 AS VARCHAR(20)) AS name, place FROM {imports}",
}
LINKS_DUCKDB = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS place FROM pages"""


class Tables:
    """Raw and projected tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def index(self, name: str, source: str, build: Callable[[Index], object]) -> Index:
        """The stored index of that name over the table source, kept in the shared folder: built at its first use, and
        again when the table's file has changed."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{source}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        mark = hashlib.sha256(f"3 {path} {status.getLen()} {status.getModificationTime()}".encode()).hexdigest()[:20]
        place = f"{shared_folder(self.spark)}/weftline-{name}-{mark}"
        found = OPENED.setdefault((self.spark.sparkContext.applicationId, place), Index(self.spark, place))
        if not found.exists():
            build(found)
        return found

    def _make(self, name: str) -> DataFrame:
        if name == "links":
            return self.pages.selectExpr("page_id", "posexplode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as (at, link)").selectExpr("page_id", "link", "at + 1 as place")
        if name not in PROJECTIONS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = PROJECTIONS[name].replace("AS VARCHAR(20)", "AS STRING")
        used = set(re.findall(r"(?<!\{)\{(\w+)\}", text))
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def oracle(body: str, *projections: str) -> str:
    """body over the named projections, as SQL for the raw tables. A body may begin with a comma and further tables."""
    parts = []
    for name in projections:
        text = LINKS_DUCKDB if name == "links" else re.sub(r"(?<!\{)\{(\w+)\}", r"\1", PROJECTIONS[name]).replace("{{", "{").replace("}}", "}")
        parts.append(f"{name} AS ({text.replace('AS VARCHAR(20)', 'AS VARCHAR')})")
    return f"WITH {', '.join(parts)}{'' if body.startswith(', ') else ' '}{body}" if parts else body
