"""The registered queries of the corpus operators: each reads whole tables and derives its columns from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import read_table

SYNTHETIC = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import chat

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(SYNTHETIC).alias("text"))
    place = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    )
    log = rows.unionByName(own).withColumn("seq", F.row_number().over(place)).withColumns({"turn": F.col("seq"), "event": F.lit("message")})
    back = chat.read_back(chat.render(chat.reconstruct(log)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]') u),
escaped AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(s>|/s>|<SYS>>|</SYS>>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g') AS erole,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(s>|/s>|<SYS>>|</SYS>>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g') AS etext
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST] ' || erole || ' [/INST] ' || etext || '</s>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import urls

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT rid, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.rid = fits.rid AND place = 1
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import setsketch

    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import bpe

    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import langid

    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import sharding

    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import embed_dedup

    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import ann

    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import suffix

    return suffix.dedup_report(read_table(spark, sf_dir, "documents"), passage_words=suffix.PASSAGE_WORDS)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import merkle

    return merkle.audit(read_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import secrets

    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import spelling

    return spelling.variants(read_table(spark, sf_dir, "documents"))


#: The table of CRC-32's steps for a byte, made by its polynomial.
CRC_TABLE = """crc_step(n, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY n) AS tab FROM crc_step WHERE k = 8)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_sql(text: str) -> str:
    """The checksum of a text's UTF-8 bytes; wants CRC_TABLE and crc_table in the FROM clause."""
    byte = f"CAST(('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: {byte}), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
rows AS (SELECT doc_id, coalesce('s' || source, '-') AS tree, {leaf_sql("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf_sql("text")} END AS now FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
low(tree, level, pos, node, n) AS (SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, node, n) AS (SELECT 0, pos, node, n FROM subroots UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
root AS (SELECT node AS root FROM high WHERE n = 1),
near_low AS (SELECT tree, level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM low WHERE n > 1),
near_high AS (SELECT level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM high WHERE n > 1),
up(tree, leaf_pos, level, pos, proof, node) AS (SELECT tree, pos, 0, pos, '', now FROM placed
  UNION ALL SELECT u.tree, u.leaf_pos, u.level + 1, u.pos // 16, u.proof || x.l || x.r, sha256(x.l || u.node || x.r) FROM up u JOIN near_low x ON x.tree = u.tree AND x.level = u.level AND x.pos = u.pos),
out(tree, leaf_pos, level, pos, proof, node) AS (SELECT u.tree, u.leaf_pos, 0, s.pos, arg_max(u.proof, u.level), arg_max(u.node, u.level) FROM up u JOIN subroots s ON s.tree = u.tree GROUP BY u.tree, u.leaf_pos, s.pos
  UNION ALL SELECT u.tree, u.leaf_pos, u.level + 1, u.pos // 16, u.proof || x.l || x.r, sha256(x.l || u.node || x.r) FROM out u JOIN near_high x ON x.level = u.level AND x.pos = u.pos),
ends AS (SELECT tree, leaf_pos, sha256(arg_max(proof, level)) AS proof_sha256, arg_max(node, level) AS folded_root FROM out GROUP BY tree, leaf_pos)
SELECT p.doc_id, p.leaf, s.node AS subroot, root, e.proof_sha256, e.folded_root, e.folded_root = root AS verified
FROM placed p JOIN ends e ON e.tree = p.tree AND e.leaf_pos = p.pos JOIN subroots s ON s.tree = p.tree, root
"""


def found_sql(kind: int, text: str, pattern: str, value: int = 0) -> str:
    """Matches of a pattern, the texts between them, and the group that is the value."""
    group = f", {value}" if value else ""
    return f"SELECT rid, {kind} AS kind, text, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS hits, regexp_extract_all({text}, '{pattern}'{group}) AS vals FROM docs"


ASSIGN_SQL = """(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([a-z0-9+/_.=-]+)"""
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '-') AS owner, coalesce(text, '') AS text,
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
lists AS ({found_sql(0, "low", ASSIGN_SQL, 2)} UNION ALL {found_sql(1, "text", "AKIA[A-Z0-9]+")}
  UNION ALL {found_sql(2, "text", "[0-9a-f]{16,}")} UNION ALL {found_sql(3, "text", "[A-Za-z0-9+/_.=-]{20,}")}),
places AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM lists),
spans AS (SELECT rid, kind, text, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS start, length(hits[k]) AS size, length(vals[k]) AS n FROM places),
named AS (SELECT rid, kind, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, substr(text, CAST(start + size - n + 1 AS BIGINT), CAST(n AS BIGINT)) AS value FROM spans
  WHERE CASE kind WHEN 0 THEN n >= 12 WHEN 1 THEN n >= 18 ELSE true END),
kept AS (SELECT * FROM named x WHERE kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM named b WHERE b.rid = x.rid AND b.kind < 3 AND b.start < x.stop AND x.start < b.stop))),
letters AS (SELECT value, c, count(*) AS m FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM kept)) q GROUP BY value, c),
bits AS (SELECT value, -sum(m / length(value) * log2(m / length(value))) AS bits FROM letters GROUP BY value),
owned AS (SELECT k.value, count(DISTINCT owner) AS owners, bool_or(kind < 2) AS assigned FROM kept k JOIN docs USING (rid) GROUP BY k.value),
judged AS (SELECT k.*, CASE WHEN owners >= 3 THEN 'example' WHEN assigned OR (bits >= 3 AND regexp_matches(k.value, '[0-9]') AND regexp_matches(k.value, '[A-Za-z_]')) THEN 'live' ELSE 'plain' END AS class
  FROM kept k JOIN owned o ON o.value = k.value JOIN bits b ON b.value = k.value),
said AS (SELECT *, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || start || ':' || stop AS span FROM judged WHERE kind < 3 OR class = 'live')
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
  coalesce(string_agg(class, ',' ORDER BY start, kind), '') AS classes, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example
FROM docs d LEFT JOIN said s ON s.rid = d.rid GROUP BY d.rid, d.doc_id
"""

OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents) q WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) q),
near AS (SELECT x.word, y.word AS other, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.b UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.b),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT b.word, min(x.other) AS form, b.top AS form_n FROM best b JOIN words w ON w.word = b.word AND b.top >= 10 * w.n JOIN near x ON x.word = b.word AND x.n = b.top GROUP BY b.word, b.top),
chain(word, root, k) AS (SELECT word, form, 1 FROM form UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN form f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN form f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word LEFT JOIN best b ON b.word = w.word
"""

QUERIES = {
    "op11_manifest": op11_manifest,
    "op12_secrets": op12_secrets,
    "op13_spelling": op13_spelling,
    "op1_chat": op1_chat,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op8_nearest": op8_nearest,
    "op3_language": op3_language,
    "op10_sharding": op10_sharding,
    "op4_near_duplicates": op4_near_duplicates,
    "op6_packing": op6_packing,
    "op9_bpe": op9_bpe,
    "op7_urls": op7_urls,
}
SQL = {"op1_chat": OP1_SQL, "op7_urls": OP7_SQL, "op11_manifest": OP11_SQL, "op12_secrets": OP12_SQL, "op13_spelling": OP13_SQL}
