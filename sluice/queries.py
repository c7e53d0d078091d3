"""The registered queries of the engine and their DuckDB equivalents.

The test tables hold few texts that match rules, so several queries add a text made from a rule to each row: the same
one in Spark and in SQL, by the row's id modulo the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import decode, identity, scan
from sluice.functions.body import read_body
from sluice.functions.normalize import normalize
from sluice.functions.rules import all_rules, atlas_rules, request_rules, response_rules, rules_table, secret_rules
from sluice.operators import metrics
from sluice.operators.requests import forwarded, inspect_requests, once, scan_texts, with_upstream_failures
from sluice.operators.responses import FLAGS_HEADER, STATUS_HEADER, inspect_responses
from sluice.operators.sse import scan_sse
from sluice.plans.gateway import run_gateway
from sluice.plans.oracle import hit_list, quote, string_list
from sluice.plans.seeds import seed_texts
from sluice.sources.exchanges import CHUNK, Options, chat_requests, delta_chunks, read_table, run_to_table, shared_folder, stream_exchanges
from sluice.streaming.sse import inspect_chunks, inspect_stream

QUERIES = {}
ORACLE_SQL = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(texts: list[str], key: Column) -> Column:
    return F.array(*map(F.lit, texts))[F.pmod(key, F.lit(len(texts))).cast("int")]


def _seeded(df: DataFrame, texts: list[str], key: str) -> DataFrame:
    return df.withColumn("text", F.concat("text", F.lit("\n"), _pick(texts, F.col(key))))


def _seeded_sql(table: str, texts: list[str], key: str) -> str:
    return f"(SELECT * REPLACE (text || chr(10) || {string_list(texts)}[CAST(({key}) % {len(texts)} AS BIGINT) + 1] AS text) FROM {table})"


_REQUEST, _SECRET, _RESPONSE, _ATLAS = request_rules(), secret_rules(), response_rules(), atlas_rules()
_REQUEST_SEEDS, _RESPONSE_SEEDS, _ATLAS_SEEDS = seed_texts(_REQUEST), seed_texts(_RESPONSE), seed_texts(_ATLAS)
_joined = lambda c: F.array_join(c, ",")


@_query(f"SELECT doc_id, unnest({hit_list('text', _SECRET)}) AS rule_id FROM documents")
def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(scan.hits(F.col("text"), _SECRET)).alias("rule_id"))


@_query(f"SELECT doc_id, array_to_string({hit_list('text', _REQUEST)}, ',') AS hits FROM {_seeded_sql('documents', _REQUEST_SEEDS, 'doc_id')}")
def request_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(_table(spark, sf_dir, "documents"), _REQUEST_SEEDS, "doc_id")
    return docs.select("doc_id", _joined(scan.hits(F.col("text"), _REQUEST)).alias("hits"))


@_query(f"SELECT page_id, array_to_string({hit_list('html', _REQUEST)}, ',') AS hits FROM pages")
def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", _joined(scan.hits(F.col("html"), _REQUEST)).alias("hits"))


@_query(f"SELECT item_id, array_to_string({hit_list('text', _REQUEST)}, ',') AS request_hits, array_to_string({hit_list('text', _ATLAS)}, ',') AS atlas_hits FROM benchmark")
def benign_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "benchmark").select("item_id", _joined(scan.hits(text, _REQUEST)).alias("request_hits"), _joined(scan.scan_atlas(text)).alias("atlas_hits"))


_ROT_FROM, _ROT_TO = decode._PLAIN, decode._ROTATED


@_query(f"""WITH d AS (SELECT doc_id, text, translate(text, '{_ROT_FROM}', '{_ROT_TO}') AS r FROM {_seeded_sql('documents', _REQUEST_SEEDS, 'doc_id')}),
h AS (SELECT doc_id, {hit_list('r', _REQUEST)} AS a, {hit_list('text', _REQUEST)} AS b FROM d)
SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS hits FROM h""")
def rot13_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(_table(spark, sf_dir, "documents"), _REQUEST_SEEDS, "doc_id")
    return docs.select("doc_id", _joined(scan.scan(decode.rot13(F.col("text")))).alias("hits"))


@_query(f"SELECT doc_id, sha256(translate(translate(text, '{_ROT_FROM}', '{_ROT_TO}'), '{_ROT_FROM}', '{_ROT_TO}')) AS text_sha256 FROM documents")
def rot13_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(decode.rot13(decode.rot13(F.col("text"))), 256).alias("text_sha256"))


_LONG_SEEDS = [t for t in _REQUEST_SEEDS if t.isascii() and len(t) >= 18]


@_query(f"""WITH s AS (SELECT doc_id, text, {string_list(_LONG_SEEDS)}[CAST(doc_id % {len(_LONG_SEEDS)} AS BIGINT) + 1] AS seed FROM documents),
e AS (SELECT doc_id, seed, text || chr(10) || 'see ' || to_base64(encode(seed)) AS text FROM s),
h AS (SELECT doc_id, {hit_list('text', _REQUEST)} AS a, {hit_list('seed', _REQUEST)} AS b, {hit_list(f"translate(text, '{_ROT_FROM}', '{_ROT_TO}')", _REQUEST)} AS c FROM e)
SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)), list_filter(c, lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x))), ',') AS hits FROM h""")
def base64_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoded payload after each document's whole text."""
    code = F.regexp_replace(F.base64(_pick(_LONG_SEEDS, F.col("doc_id")).cast("binary")), "\r\n", "")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nsee "), code).alias("text"))
    return scan_texts(docs).select("doc_id", _joined("dlp_hits").alias("hits"))


@_query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS s FROM documents)
SELECT doc_id, length(s) AS n_chars, sha256(CASE WHEN length(s) >= 18 THEN s ELSE '' END) AS decoded_sha256, sha256(CASE WHEN length(s) >= 18 THEN s ELSE '' END) AS wrapped_sha256 FROM s""")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded, in one run and wrapped at 76 characters where that makes three lines or more."""
    return base64_round_trips(_table(spark, sf_dir, "documents"))


def base64_round_trips(docs: DataFrame) -> DataFrame:
    docs = once(docs.select("doc_id", "text"), {"plain": F.regexp_replace("text", r"[^\x20-\x7E]+", "")})
    docs = once(docs, {"code": F.replace(F.base64(F.col("plain").cast("binary")), F.lit("\r\n"), F.lit(""))})
    lines = F.regexp_replace("code", "(.{76})(?=.)", "$1\n")
    last = lambda x: F.sha2(F.coalesce(F.try_element_at(decode.decoded_base64(x), F.lit(-1)), F.lit("")), 256)
    docs = once(docs, {"wrapped": F.when(F.length("code") > 152, lines).otherwise(F.col("code"))})
    return docs.select("doc_id", F.length("plain").cast("long").alias("n_chars"), last(F.col("code")).alias("decoded_sha256"), last(F.col("wrapped")).alias("wrapped_sha256"))


@_query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def normalize_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("text_sha256"))


@_query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def normalize_disguised(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("the"), F.lit("thе"))  # a Cyrillic letter in a Latin word
    text = F.replace(F.replace(text, F.lit("e"), F.lit("e̶")), F.lit("t"), F.lit("t​"))  # struck through; split
    text = F.translate(text, "0123456789", "".join(chr(0xFF10 + i) for i in range(10)))  # full width
    text = F.translate(text, "#$%&", "".join(chr(0xE0000 + ord(c)) for c in "#$%&"))  # tag characters
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(text), 256).alias("text_sha256"))


_ASSISTANT = f"(SELECT * FROM {_seeded_sql('conversations', _RESPONSE_SEEDS, 'conv_id * 8 + turn')} WHERE role = 'assistant')"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 8 + F.col("turn"))
    return _seeded(turns, _RESPONSE_SEEDS, "k").drop("k").where("role = 'assistant'")


@_query(f"SELECT conv_id, turn, array_to_string({hit_list('text', _RESPONSE)}, ',') AS hits FROM {_ASSISTANT}")
def response_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", _joined(scan.scan_response(F.col("text"))).alias("hits"))


@_query(f"""WITH h AS (SELECT conv_id, turn, text, array_to_string({hit_list('text', _RESPONSE)}, ',') AS hits FROM {_ASSISTANT})
SELECT conv_id, turn, CASE WHEN hits = '' THEN 'clean' END AS status_header, CASE WHEN hits <> '' THEN hits END AS flags_header,
CASE WHEN hits = '' THEN 200 ELSE 403 END AS response_status, CASE WHEN hits = '' THEN sha256(text) END AS body_sha256 FROM h""")
def response_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _answers(spark, sf_dir).withColumns({"upstream_body": F.col("text").cast("binary"), "upstream_status": F.lit(200)})
    out = inspect_responses(df, response_block=True)
    get = lambda name: F.try_element_at("response_headers", F.lit(name))
    return out.select("conv_id", "turn", get(STATUS_HEADER).alias("status_header"), get(FLAGS_HEADER).alias("flags_header"), "response_status", F.when(F.size("response_hits") == 0, F.sha2("response_body", 256)).alias("body_sha256"))


@_query(f"SELECT rule, count(*) AS count FROM (SELECT unnest({hit_list('text', _RESPONSE)}) AS rule FROM {_ASSISTANT}) GROUP BY rule")
def blocked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _answers(spark, sf_dir).withColumns({"upstream_body": F.col("text").cast("binary"), "upstream_status": F.lit(200)})
    return metrics.blocked_responses(inspect_responses(df, response_block=True))


@_query(f"SELECT doc_id, array_to_string({hit_list('text', _ATLAS)}, ',') AS hits FROM {_seeded_sql('documents', _ATLAS_SEEDS, 'doc_id')}")
def atlas_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(_table(spark, sf_dir, "documents"), _ATLAS_SEEDS, "doc_id")
    return docs.select("doc_id", _joined(scan.scan_atlas(F.col("text"))).alias("hits"))


_TACTICS = ", ".join(f"({quote(r.rule_id)}, {quote(r.tactic)})" for r in _ATLAS)


@_query(f"""WITH h AS (SELECT unnest({hit_list('text', _ATLAS)}) AS rule_id FROM {_seeded_sql('conversations', _ATLAS_SEEDS, 'conv_id * 8 + turn')}),
t(rule_id, tactic) AS (VALUES {_TACTICS})
SELECT tactic, count(*) AS hits FROM h JOIN t USING (rule_id) GROUP BY tactic""")
def atlas_hits_by_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _seeded(_table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 8 + F.col("turn")), _ATLAS_SEEDS, "k")
    scanned = turns.select(scan.scan_atlas(F.col("text")).alias("atlas_hits"))
    return metrics.tactic_counts(scanned, rules_table(spark))


@_query(f"""WITH h AS (SELECT unnest({hit_list('text', _REQUEST)}) AS rule_id FROM {_seeded_sql('documents', _REQUEST_SEEDS, 'doc_id')})
SELECT family, rule_id, count(*) AS count FROM (SELECT split_part(rule_id, '.', 1) AS family, rule_id FROM h) GROUP BY ROLLUP (family, rule_id)""")
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(_table(spark, sf_dir, "documents"), _REQUEST_SEEDS, "doc_id")
    return metrics.family_rollup(docs.select(scan.hits(F.col("text"), _REQUEST).alias("hits")), "hits")


_NAMED = ", ".join(f"({quote(r.rule_id)}, {quote(r.name)})" for r in _REQUEST + _ATLAS)


@_query(f"""WITH h AS (SELECT doc_id, unnest({hit_list('text', _REQUEST)}) AS rule_id FROM {_seeded_sql('documents', _REQUEST_SEEDS, 'doc_id')}
UNION ALL SELECT doc_id, unnest({hit_list('text', _ATLAS)}) FROM {_seeded_sql('documents', _REQUEST_SEEDS, 'doc_id')}),
n(rule_id, name) AS (VALUES {_NAMED}) SELECT doc_id, rule_id, name FROM h JOIN n USING (rule_id)""")
def named_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _seeded(_table(spark, sf_dir, "documents"), _REQUEST_SEEDS, "doc_id")
    both = F.concat(scan.scan_with_names(F.col("text")), scan.scan_atlas_with_names(F.col("text")))
    return docs.select("doc_id", F.explode(both).alias("h")).select("doc_id", F.col("h.id").alias("rule_id"), F.col("h.name").alias("name"))


_BOTH = {r.rule_id for r in _SECRET}
_RULE_ROWS = ", ".join(f"({i}, {quote(r.rule_id)}, {quote(r.name)}, {quote(r.family)}, {quote(r.tactic) if r.tactic else 'NULL'}, '{'technique' if r.family == 'AML' else 'response' if r.family == 'RES' else 'both' if r.rule_id in _BOTH else 'request'}')" for i, r in enumerate(all_rules()))


@_query(f"""WITH r(ord, rule_id, name, family, tactic, direction) AS (VALUES {_RULE_ROWS})
SELECT family, direction, count(*) AS rules, min(ord) AS first_ord, count(DISTINCT tactic) AS tactics FROM r GROUP BY family, direction""")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_table(spark).groupBy("family", "direction").agg(F.count("*").alias("rules"), F.min("ord").alias("first_ord"), F.countDistinct("tactic").alias("tactics"))


_TURNS = _seeded_sql("conversations", _REQUEST_SEEDS + ["note nothing", "note well"], "conv_id")
_PROMPTS = f"(SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM {_TURNS} GROUP BY conv_id)"
_ROT_TEXT = f"translate(text, '{_ROT_FROM}', '{_ROT_TO}')"
_DECIDED = f"""(SELECT conv_id, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS dlp, c AS atlas
FROM (SELECT conv_id, {hit_list('text', _REQUEST)} AS a, {hit_list(_ROT_TEXT, _REQUEST)} AS b, {hit_list('text', _ATLAS)} AS c FROM {_PROMPTS}))"""


def _requests(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    turns = _seeded(_table(spark, sf_dir, "conversations"), _REQUEST_SEEDS + ["note nothing", "note well"], "conv_id")
    return chat_requests(turns, stream)


@_query(f"SELECT conv_id, text FROM {_PROMPTS}")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("conv_id", read_body(F.col("body"))["text"].alias("text"))


@_query(f"""SELECT conv_id, CASE WHEN len(dlp) > 0 THEN 'block' ELSE 'allow' END AS decision, array_to_string(dlp, ',') AS rules, dlp[1] AS top_rule,
CASE WHEN len(dlp) > 0 THEN '403' END AS status, array_to_string(atlas, ',') AS atlas_hits, substr(sha256('sk-conv-' || conv_id), 1, 16) AS agent FROM {_DECIDED}""")
def request_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inspect_requests(_requests(spark, sf_dir))
    return out.select("conv_id", "decision", _joined("rules").alias("rules"), "top_rule", F.col("status").cast("string").alias("status"), _joined("atlas_hits").alias("atlas_hits"), "agent")


@_query(f"""SELECT conv_id, CASE WHEN len(r) > 0 THEN 'block' ELSE 'allow' END AS decision, array_to_string(r, ',') AS rules FROM (SELECT conv_id, list_concat(dlp, atlas) AS r FROM {_DECIDED})""")
def request_decision_atlas_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_requests(_requests(spark, sf_dir), atlas_block=True).select("conv_id", "decision", _joined("rules").alias("rules"))


@_query(f"SELECT CASE WHEN len(dlp) > 0 THEN 'block' ELSE 'allow' END AS decision, count(*) AS count FROM {_DECIDED} GROUP BY 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decision_counts(inspect_requests(_requests(spark, sf_dir)))


@_query(f"SELECT dlp[1] AS rule, count(*) AS count FROM {_DECIDED} WHERE len(dlp) > 0 GROUP BY 1")
def blocked_by_top_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.blocked_by_top_rule(inspect_requests(_requests(spark, sf_dir)))


@_query(f"""WITH d AS (SELECT * FROM {_DECIDED})
SELECT 'sluice_requests_total{{decision="' || CASE WHEN len(dlp) > 0 THEN 'block' ELSE 'allow' END || '"}} ' || count(*) AS line FROM d GROUP BY len(dlp) > 0
UNION ALL SELECT 'sluice_blocked_total{{rule="' || dlp[1] || '"}} ' || count(*) FROM d WHERE len(dlp) > 0 GROUP BY dlp[1]""")
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inspect_requests(_requests(spark, sf_dir))
    return metrics.exposition(metrics.decision_counts(out), metrics.blocked_by_top_rule(out)).where("line NOT LIKE '#%'")


@_query(f"""SELECT conv_id, substr(sha256('sk-conv-' || conv_id), 1, 16) AS agent, CASE WHEN len(dlp) > 0 THEN 'block' ELSE 'log' END AS action,
CASE WHEN len(dlp) > 0 THEN 'request' ELSE 'technique' END AS kind, array_to_string(CASE WHEN len(dlp) > 0 THEN dlp ELSE atlas END, ',') AS rules FROM {_DECIDED} WHERE len(dlp) > 0 OR len(atlas) > 0""")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.findings(inspect_requests(_requests(spark, sf_dir)), "conv_id").withColumn("rules", _joined("rules"))


@_query(f"""SELECT conv_id, 'Bearer gateway' AS authorization, 2 AS n_headers, CASE WHEN conv_id % 3 = 0 THEN '502' END AS status,
CASE WHEN conv_id % 3 = 0 THEN '{{"error":{{"message":"upstream unreachable: timed out","type":"upstream_error"}}}}' END AS error_body FROM {_DECIDED} WHERE len(dlp) = 0""")
def forwarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _requests(spark, sf_dir).withColumn("headers", F.map_concat("headers", F.create_map(F.lit("cookie"), F.lit("x"))))
    out = forwarded(inspect_requests(df), gateway_key="gateway").withColumn("upstream_error", F.when(F.col("conv_id") % 3 == 0, "timed out"))
    return with_upstream_failures(out).select("conv_id", F.col("headers")["authorization"].alias("authorization"), F.size("headers").alias("n_headers"), F.col("status").cast("string").alias("status"), "error_body")


# strict JSON: bodies around an event's properties, valid or broken by its id
_BODIES = (
    ('{{"prompt": {}, "stream": true}}', "true", "true"),
    ('{{"prompt": {}}} trailing', "false", "false"),
    ('{{"prompt": 1, "prompt": {}, "stream": "true"}}', "true", "false"),
    ('{{"prompt": {}, "n": 1e999}}', "false", "false"),
    ('{{"prompt": {}, "n": NaN}}', "false", "false"),
    ('{{"prompt": {}', "false", "false"),
    ('{{"prompt": {}, "x": "\\ud800"}}', "false", "false"),
    ("[" * 128 + "{}" + "]" * 128, "false", "false"),
    ("", "true", "false"),
)


@_query(
    "SELECT event_id, CASE event_id % 9 "
    + " ".join(f"WHEN {i} THEN {ok}" for i, (_, ok, _) in enumerate(_BODIES))
    + " END AS valid, CASE event_id % 9 "
    + " ".join(f"WHEN {i} THEN {s}" for i, (_, _, s) in enumerate(_BODIES))
    + " END AS stream, CASE WHEN event_id % 9 IN (0, 2) THEN event_type ELSE '' END AS text FROM events"
)
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [t.format("\x00") .split("\x00") for t, _, _ in _BODIES]
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    bodies = F.array(*[F.concat(F.lit(p[0]), quoted, F.lit(p[1])) if len(p) > 1 else F.lit(p[0]) for p in parts])
    df = _table(spark, sf_dir, "events").select("event_id", read_body(bodies[F.pmod("event_id", F.lit(len(parts))).cast("int")]).alias("b"))
    return df.select("event_id", "b.valid", "b.stream", "b.text")


_WINDOWED = f"""(SELECT *, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn), 500) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_ASSISTANT})"""
_TRIPS = f"(SELECT conv_id, turn, n, {hit_list('w', _RESPONSE)} AS hits FROM {_WINDOWED})"


@_query(f"""WITH t AS (SELECT * FROM {_TRIPS}), f AS (SELECT conv_id, min(n) AS hit_at FROM t WHERE len(hits) > 0 GROUP BY conv_id), c AS (SELECT conv_id, max(n) AS n FROM t GROUP BY conv_id)
SELECT CAST(c.conv_id AS VARCHAR) AS stream_id, CAST(coalesce(f.hit_at, c.n) AS INTEGER) AS scanned, CAST(f.hit_at AS INTEGER) AS hit_at, coalesce(array_to_string(t.hits, ','), '') AS hits
FROM c LEFT JOIN f USING (conv_id) LEFT JOIN t ON t.conv_id = c.conv_id AND t.n = f.hit_at""")
def sse_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = delta_chunks(_answers(spark, sf_dir))
    bodies = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("chunk").cast("string").alias("c")))), lambda x: x["c"]), "").alias("body"))
    out = scan_sse(bodies.withColumn("body", F.concat("body", F.lit("data: [DONE]\n\n"))))
    return out.select("stream_id", "sse.scanned", "sse.hit_at", _joined("sse.hits").alias("hits"))


_ACTIONS = f"""WITH t AS (SELECT * FROM {_TRIPS}), f AS (SELECT conv_id, min(n) AS hit_at FROM t WHERE len(hits) > 0 GROUP BY conv_id)
SELECT CAST(t.conv_id AS VARCHAR) AS stream_id, CAST(t.turn AS BIGINT) AS seq, CASE WHEN n = hit_at THEN 'withhold_and_terminate' WHEN n > hit_at THEN 'drop' ELSE 'forward' END AS action,
CASE WHEN n = hit_at THEN array_to_string(hits, ',') ELSE '' END AS hits FROM t LEFT JOIN f USING (conv_id)"""


@_query(_ACTIONS)
def sse_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_chunks(delta_chunks(_answers(spark, sf_dir)), block=True).drop("sent").withColumn("hits", _joined("hits"))


@_query(_ACTIONS)
def sse_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the streaming operator: chunks arrive as files, all of a stream's in order."""
    path = shared_folder(spark, "chunks")
    delta_chunks(_answers(spark, sf_dir)).write.parquet(path)
    live = inspect_stream(stream_exchanges(spark, path, schema=CHUNK), block=True, ttl=None)
    return run_to_table(live, "actions").drop("sent").withColumn("hits", _joined("hits"))


@_query(f"""SELECT stream_id, 2 * seq + p AS seq, CASE WHEN p = 0 AND action = 'withhold_and_terminate' THEN 'forward' ELSE action END AS action, CASE WHEN p = 1 THEN hits ELSE '' END AS hits
FROM ({_ACTIONS}) CROSS JOIN (VALUES (0), (1)) AS halves(p)""")
def sse_cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event comes in two chunks, cut inside its line: the second completes it."""
    whole = delta_chunks(_answers(spark, sf_dir)).withColumn("text", F.col("chunk").cast("string"))
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.substring("text", F.lit(1), half), F.substr("text", half + 1))
    cut = whole.select("stream_id", F.col("seq").alias("n"), F.posexplode(halves).alias("p", "part"))
    chunks = cut.select("stream_id", (F.col("n") * 2 + F.col("p")).alias("seq"), F.col("part").cast("binary").alias("chunk"))
    return inspect_chunks(chunks, block=True).drop("sent").withColumn("hits", _joined("hits"))


_ENDED = """'data: {"error": {"message": "Response blocked: streamed output matches an egress rule.", "type": "response_blocked", "code": "response_blocked"}, "inspection": {"rules": ["' || replace(hits, ',', '", "') || '"]}}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)"""


@_query(f"SELECT stream_id, seq, action, CASE action WHEN 'withhold_and_terminate' THEN {_ENDED} WHEN 'forward' THEN 'same' END AS sent FROM ({_ACTIONS})")
def sse_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callers of enforced streams get: forwarded chunks as they came, the terminating event, then nothing."""
    chunks = delta_chunks(_answers(spark, sf_dir))
    out = inspect_chunks(chunks, block=True).join(chunks, ["stream_id", "seq"])
    sent = F.when((F.col("action") == "forward") & (F.col("sent") == F.col("chunk")), "same").otherwise(F.col("sent").cast("string"))
    return out.select("stream_id", "seq", "action", sent.alias("sent"))


@_query(f"""WITH t AS ({_ACTIONS}), s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS stream_id, substr(sha256('sk-conv-' || conv_id), 1, 16) AS agent, dlp, atlas FROM {_DECIDED})
SELECT conv_id, agent, 'block' AS action, 'request' AS kind, array_to_string(dlp, ',') AS rules FROM s WHERE len(dlp) > 0
UNION ALL SELECT conv_id, agent, 'log', 'technique', array_to_string(atlas, ',') FROM s WHERE len(dlp) = 0 AND len(atlas) > 0
UNION ALL SELECT conv_id, agent, 'block', 'stream', hits FROM s JOIN t USING (stream_id) WHERE hits <> '' AND len(dlp) = 0 AND conv_id % 5 > 0""")
def gateway_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the whole flow over streamed exchanges, some of whose upstreams fail."""
    error = F.when(F.col("conv_id") % 5 == 0, "timed out")
    exchanges = _requests(spark, sf_dir, stream=True).withColumns({"stream_id": F.col("conv_id").cast("string"), "upstream_status": F.lit(200), "upstream_body": F.lit(None).cast("binary"), "upstream_error": error})
    out = run_gateway(exchanges, Options(response_block=True), delta_chunks(_answers(spark, sf_dir)), ids=("conv_id",))
    return out.findings.withColumn("rules", _joined("rules"))


@_query(f"""SELECT conv_id, CASE WHEN len(dlp) > 0 THEN '403' WHEN conv_id % 5 = 0 THEN '502' ELSE '200' END AS status,
CASE WHEN len(dlp) > 0 OR conv_id % 5 = 0 THEN '' ELSE 'text/event-stream,stream-enforced' END AS headers FROM {_DECIDED}""")
def gateway_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and headers with which each streamed exchange is answered."""
    error = F.when(F.col("conv_id") % 5 == 0, "timed out")
    kind = F.create_map(F.lit("content-type"), F.lit("text/event-stream"))
    exchanges = _requests(spark, sf_dir, stream=True).withColumns({"upstream_status": F.lit(200), "upstream_body": F.lit(None).cast("binary"), "upstream_error": error, "upstream_headers": kind})
    out = run_gateway(exchanges, Options(response_block=True))
    text = lambda c: F.col(c).cast("string").alias("status")
    begun = out.opened.select("conv_id", text("response_status"), F.array_join(F.map_values("response_headers"), ",").alias("headers"))
    ended = out.requests.where("decision = 'block'").select("conv_id", "status").unionByName(out.failures.select("conv_id", "status"))
    return begun.unionByName(ended.select("conv_id", text("status"), F.lit("").alias("headers")))


_KEYS = ("sk-proj-", "sk-ant-", "sk-", "hf_", "AIza", "gsk_", "dsk-", "xai-", "plain-")
_AGENTS = ("LangChain/0.3.1 py", "crewai 1.2", "OpenAI/Python 1.40.0", "Anthropic/JS", "autogen", "LlamaIndex", "ollama/0.1", "curl/8.0", "Cursor/1.0")


def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    key = F.concat(F.lit("Bearer "), _pick(list(_KEYS), u), u.cast("string"))
    some = lambda name, k, value: F.when(u % k == 0, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    headers = F.map_concat(
        F.create_map(F.lit("authorization"), key, F.lit("user-agent"), _pick(list(_AGENTS), F.floor(u / 9))),
        some("x-agent-tool", 2, F.lit("tool")), some("x-agent-host", 3, F.lit("host")), some("x-agent-user", 5, F.lit("ann")), some("x-api-key", 7, F.lit("k")), some("anthropic-version", 7, F.lit("v")),
    )
    return _table(spark, sf_dir, "events").select("event_id", "user_id", headers.alias("headers"))


def _case(tests: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in tests) + f" ELSE {otherwise} END"


_K = f"({string_list(_KEYS)}[CAST(user_id % 9 AS BIGINT) + 1] || user_id)"
_U = f"{string_list(_AGENTS)}[CAST((user_id // 9) % 9 AS BIGINT) + 1]"
_SHOWN = _case([(f"contains(lower({_U}), {quote(w)})", quote(d)) for words, _, _, d in identity.FRAMEWORKS for w in words], "'Unknown Agent'")


@_query(f"""SELECT event_id, substr(sha256({_K}), 1, 16) AS hash, CASE WHEN length({_K}) >= 8 THEN substr({_K}, 1, 8) || '...' END AS api_key_prefix,
{_case([(f"starts_with({_K}, {quote(p)})", quote(n)) for p, n, _ in identity.PROVIDERS])} AS provider, {_case([(f"starts_with({_K}, {quote(p)})", quote(t)) for p, _, t in identity.PROVIDERS])} AS key_type,
{_case([(f"contains(lower({_U}), {quote(w)})", quote(n)) for words, n, _, _ in identity.FRAMEWORKS for w in words])} AS framework,
{_case([(f"contains(lower({_U}), 'langchain')", "'0.3.1'"), (f"contains(lower({_U}), 'crewai')", "'1.2'")])} AS sdk_version,
CASE WHEN user_id % 7 = 0 THEN 'anthropic-native' ELSE 'openai-compatible' END AS api_type,
{_case([("user_id % 2 = 0 AND user_id % 3 = 0", "'tool / host'"), ("user_id % 2 = 0 AND user_id % 5 = 0", "'tool / ann'"), ("user_id % 2 = 0", "'tool Agent'"), ("user_id % 3 = 0 AND user_id % 5 = 0", "'ann''s host'"), ("user_id % 3 = 0", "'host'")], _SHOWN)} AS display_name,
{_case([("user_id % 2 = 0", "'tool'"), (f"contains({_U}, 'Cursor')", "'cursor'")])} AS agent_tool FROM events""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _callers(spark, sf_dir).withColumn("f", identity.fingerprint(F.col("headers")))
    return df.select("event_id", *[f"f.{c}" for c in ("hash", "api_key_prefix", "provider", "key_type", "framework", "sdk_version", "api_type", "display_name", "agent_tool")])


@_query("""WITH c AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS p, sum(CASE WHEN role = 'assistant' AND conv_id % 4 > 0 THEN length(text) ELSE 0 END) AS c, CASE WHEN conv_id % 11 = 0 THEN 'embeddings' ELSE 'chat' END AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN m = 'embeddings' THEN 'embedding' WHEN c = 0 THEN 'classification' WHEN CAST(p AS FLOAT) / CAST(greatest(c, 1) AS FLOAT) > 10 THEN 'rag-pipeline' WHEN CAST(p AS FLOAT) / CAST(greatest(c, 1) AS FLOAT) < 0.5 THEN 'code-generation' ELSE 'chat' END AS behavior FROM c""")
def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.col("role") == "assistant"
    n = F.length("text")
    sums = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(~mine, n).otherwise(0)).cast("int").alias("p"), F.sum(F.when(mine & (F.col("conv_id") % 4 > 0), n).otherwise(0)).cast("int").alias("c"))
    method = F.when(F.col("conv_id") % 11 == 0, "embeddings").otherwise("chat")
    return sums.select("conv_id", identity.behavior(F.col("p"), F.col("c"), method).alias("behavior"))


@_query(f"""WITH h AS (SELECT doc_id, len({hit_list('text', _REQUEST)}) > 0 AS flagged FROM documents)
SELECT toxic, flagged, count(*) AS count FROM h JOIN labels USING (doc_id) GROUP BY toxic, flagged""")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.size(scan.hits(F.col("text"), _REQUEST)) > 0).alias("flagged"))
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "flagged").agg(F.count("*").alias("count"))
