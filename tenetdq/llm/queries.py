"""The registered queries of the corpus operators, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetdq.llm import (
    alignment,
    chat_format,
    decontaminate,
    exact_dedup,
    lang_id,
    merkle,
    near_dedup,
    orc_tokens,
    packing,
    quality_rules,
    secret_scan,
    toxicity,
    url_filter,
)
from tenetdq.llm.common import table
from tenetdq.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _remainder(n: int) -> Column:
    """crc32 of the document id, as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


@query
def op3_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


@query
def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


@query
def op5_chat_formatting(spark, sf_dir):
    odd = F.lit("</s>[INST] ok [/INST]")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat_format.digests(chat_format.format_chats(rows.unionByName(extra)))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).drop("text_hash", "text_bytes")


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = lang_id.learn(docs.where(_remainder(3) != 1).select("text", "lang"))
    found = lang_id.predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("lang_pred"), "score").select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_orc_tokens(spark, sf_dir):
    path = scratch_path(spark, "orc-tokens")
    orc_tokens.write_ids(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=2)
    return orc_tokens.digests(spark, path)


@query
def op9_best_fit_packing(spark, sf_dir):
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0, capacity=2048, with_ids=False)
    return packing.pack(pieces, 2048)


@query
def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.select("doc_id", "text"), labels, _remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


@query
def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECE_BPE)


@query
def op12_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op13_merkle_manifest(spark, sf_dir):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    cut = F.when(_remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf(*[F.col(c) for c in fields]).alias("leaf"),
                         merkle.leaf(*[F.col(c) for c in fields[:-1]], cut).alias("claimed"))
    rows = merkle.manifest(leaves, keep=["claimed"])
    folded = merkle.fold(F.col("claimed"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op2_exact_dedup"] = r"""
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
named AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, body,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM bodies WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM named
"""

ORACLES["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN comp ON node = doc_id
"""

# A path without dot segments, a link's absolute form, and the links of a page, as SQL text.
_DOTS = """CASE WHEN {p} LIKE '/%' AND contains({p}, '/.') THEN '/' || array_to_string(list_concat(
    list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/')[2:], lambda s: [s])),
      lambda held, s: CASE WHEN s[1] = '.' THEN held WHEN s[1] = '..' THEN held[1:greatest(len(held) - 1, 0)] ELSE list_concat(held, s) END),
    CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END), '/') ELSE {p} END"""
_RESOLVED = """CASE WHEN regexp_matches({t}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {t} WHEN regexp_matches({t}, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
    WHEN {t} LIKE '//%' THEN 'x:' || {t}
    WHEN split_part({t}, '?', 1) = '' THEN 'x://' || {h} || {p} || CASE WHEN contains({t}, '?') THEN {t} ELSE {q} END
    WHEN {t} LIKE '/%' THEN 'x://' || {h} || {t}
    ELSE 'x://' || {h} || coalesce(nullif(regexp_extract({p}, '(?s)^(.*/)', 1), ''), '/') || {t} END"""
_URL = {"host": "(?s)^.*?://([^/?#]*)", "path": "(?s)^.*?://[^/?#]*([^?#]*)", "query": r"(?s)^.*?://[^?#]*(\?[^#]*)"}
_PARTS = ("translate(coalesce(regexp_extract({u}, '" + _URL["host"] + "', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
          "coalesce(regexp_extract({u}, '" + _URL["path"] + "', 1), '') AS path, coalesce(regexp_extract({u}, '" + _URL["query"] + "', 1), '') AS query")
_HREF = r"""\bhref\s*=\s*["'']?([^"''\s>]+)"""
_REL = r"""\brel\s*=\s*["'']?canonical\b"""
_TARGETS = "list_concat(" * 2 + ", ".join([r"regexp_extract_all(html, '(?is)<link\b[^>]*" + _REL + "[^>]*" + _HREF + "', 1)",
    r"regexp_extract_all(html, '(?is)<link\b[^>]*" + _HREF + "[^>]*" + _REL + "', 1))",
    r"""regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1))"""])

ORACLES["op3_url_filter"] = "WITH RECURSIVE named AS (SELECT page_id, url, html, " + _PARTS.format(u="url") + r""" FROM pages),
bases AS (
  SELECT host AS page_host, path AS page_path, query AS page_query, html,
    regexp_replace(replace(nullif(regexp_extract(html, '(?is)<base\b[^>]*HREF', 1), ''), '&amp;', '&'), '(?s)#.*$', '') AS t, host, path, query
  FROM named WHERE host <> ''),
based AS (
  SELECT page_host, page_path, page_query, html, coalesce(RESOLVED_BASE, 'x://' || host || path || query) AS u FROM bases),
found AS (
  SELECT page_host, page_path, page_query, host, DOTS_PATH AS path, query, raw
  FROM (SELECT page_host, page_path, page_query, PARTS_U, unnest(TARGETS) AS raw FROM based)),
links AS (
  SELECT page_host, page_path, page_query, host, path, query, regexp_replace(replace(raw, '&amp;', '&'), '(?s)#.*$', '') AS t FROM found),
targets AS (SELECT page_host || DOTS_PAGE || page_query AS a, RESOLVED_BASE AS u FROM links),
ends AS (SELECT a, PARTS_U FROM targets WHERE u IS NOT NULL),
edges AS (SELECT DISTINCT a, host || DOTS_PATH || query AS b FROM ends WHERE host <> ''),
""".replace("HREF", _HREF).replace("RESOLVED_BASE", _RESOLVED.format(t="t", h="host", p="path", q="query")).replace(
    "PARTS_U", _PARTS.format(u="u")).replace("TARGETS", _TARGETS).replace("DOTS_PAGE", _DOTS.format(p="page_path")).replace(
    "DOTS_PATH", _DOTS.format(p="path")) + r"""both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT a AS node, a AS other FROM both_ways
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
ruled AS (
  SELECT node, CASE
      WHEN regexp_matches(split_part(other, '/', 1), '(^|\.)www\.example\.com$') AND substr(other, strpos(other, '/')) LIKE '/en/%' THEN 'allow'
      WHEN regexp_matches(split_part(other, '/', 1), '(^|\.)example\.com$') AND substr(other, strpos(other, '/')) LIKE '/en/%' THEN 'block'
      WHEN regexp_matches(split_part(other, '/', 1), '(^|\.)net$') AND regexp_matches(substr(other, strpos(other, '/')), '^/(es|fr)/') THEN 'block'
      WHEN regexp_matches(split_part(other, '/', 1), '(^|\.)com$') AND strpos(other, '/') > 0 THEN 'allow' END AS said
  FROM reach),
aliases AS (
  SELECT node, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS decided
  FROM ruled GROUP BY node),
pages_ruled AS (
  SELECT page_id, host, path, host || DOTS_PATH || query AS node, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
  coalesce(CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END,
           decided, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN decided IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM pages_ruled p LEFT JOIN aliases a ON p.node = a.node AND p.host <> ''
""".replace("DOTS_PATH", _DOTS.format(p="path"))

ORACLES["op5_chat_formatting"] = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(regexp_replace(role, CONTROL, '\1\\\2\3', 'g')) + length(regexp_replace(text, CONTROL, '\1\\\2\3', 'g'))
      + 33 AS chars
  FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
""".replace("CONTROL", "'" + chat_format.CONTROL + "'")

# Nodes of both trees by recursion over levels ('s' within a source, 't' over sources), then each row's siblings, then the fold.
ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE plain AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN coalesce(strlen(cut) || ':' || cut, '-')
                        ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
  FROM plain),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos FROM leaves),
inner_tree AS (
  SELECT g, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM inner_tree WHERE n > 1 GROUP BY g, level, pos // 3),
subroots AS (SELECT g, node AS subroot, level AS height FROM inner_tree WHERE n = 1),
sources AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS place FROM subroots),
outer_tree AS (
  SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM sources
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM outer_tree WHERE n > 1 GROUP BY level, pos // 3),
runs AS (
  SELECT g, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM inner_tree WHERE n > 1 GROUP BY g, level, pos // 3
  UNION ALL
  SELECT NULL, level, pos // 3, list(node ORDER BY pos) FROM outer_tree WHERE n > 1 GROUP BY level, pos // 3),
steps AS (
  SELECT p.doc_id, p.g, p.pos, r.level AS step, r.nodes, (p.pos // pow(3, r.level)::BIGINT) % 3 AS slot
  FROM placed p JOIN runs r ON r.g = p.g AND r.run = p.pos // pow(3, r.level + 1)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.g, p.pos, s.height + r.level, r.nodes, (s.place // pow(3, r.level)::BIGINT) % 3
  FROM placed p JOIN sources s ON s.g = p.g JOIN runs r ON r.g IS NULL AND r.run = s.place // pow(3, r.level + 1)::BIGINT),
sides AS (
  SELECT g, pos, step, array_to_string(nodes[1:slot], '') AS l, array_to_string(nodes[slot + 2:], '') AS r FROM steps),
folded AS (
  SELECT g, pos, 0 AS step, claimed AS up FROM placed
  UNION ALL
  SELECT f.g, f.pos, f.step + 1, sha256(s.l || f.up || s.r)
  FROM folded f JOIN sides s ON s.g = f.g AND s.pos = f.pos AND s.step = f.step),
ends AS (SELECT g, pos, arg_max(up, step) AS folded_root FROM folded GROUP BY g, pos),
proofs AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM sides GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN sources USING (g) JOIN ends e USING (g, pos) LEFT JOIN proofs USING (g, pos),
  (SELECT node AS root FROM outer_tree WHERE n = 1)
"""
