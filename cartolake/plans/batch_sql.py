"""The queries of ``batch`` in plain SQL over the same tables."""

from __future__ import annotations

from itertools import combinations

from cartolake.plans.batch import NEEDLE_NAMES, ROW_KEYS
from cartolake.operators import enrich
from cartolake.plans.oracle import EDGE, ORACLE, REAL, _LINK_EDGE, _catalog, _connections, lit

_STALE = """(k % 6 = 0 AND tbl = 'pages') OR (k % 8 = 0 AND tbl = 'orders') OR k % 13 = 0
  OR (k % 10 = 3 AND tbl IN (SELECT tbl FROM base WHERE typ = 'int'))"""


def _composite_keys() -> str:
    """Every set of columns, counted, without those that hold a smaller one that counts as many."""
    parts = []
    for table, spec in REAL.items():
        names = [c.split(":")[0] for c in spec.split() if c.split(":")[1] in "ist"]
        for size in range(1, len(names) + 1):
            for columns in combinations(names, size):
                listed, filled = ", ".join(columns), " AND ".join(f"{c} IS NOT NULL" for c in columns)
                parts.append(f"SELECT '{table}' AS tbl, {list(columns)} AS cols, (SELECT count(*) FROM {table}) AS rows, "
                             f"(SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {table} WHERE {filled})) AS n")
    sets = "\nUNION ALL ".join(parts)
    return f"""WITH sets AS MATERIALIZED ({sets}),
good AS (SELECT tbl, cols, rows FROM sets WHERE n = rows AND rows > 0)
SELECT tbl AS "table", array_to_string(cols, ',') AS columns, rows FROM good g
WHERE NOT EXISTS (SELECT 1 FROM good h WHERE h.tbl = g.tbl AND len(h.cols) < len(g.cols) AND list_has_all(g.cols, h.cols))"""


def _samples() -> str:
    parts = []
    for table, columns in ROW_KEYS.items():
        by = " || '|' || ".join(f"{c}::VARCHAR" for c in columns)
        key = " || '-' || ".join(f"{c}::VARCHAR" for c in columns)
        parts.append(f"SELECT '{table}' AS tbl, {key} AS k, row_number() OVER (ORDER BY md5({by})) AS rn FROM {table} "
                     f"QUALIFY row_number() OVER (ORDER BY md5({by})) <= 20")
    return "\nUNION ALL ".join(parts)


# Types of the given tables' columns: the letters of REAL, and the columns that differ from them.
_TYPES = {"i": "bigint", "f": "double", "s": "string", "t": "timestamp_ntz", "a": "float REPEATED"}
_INTS = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber", "label", "quality", "toxic"}
_NESTED = [
    ("o_orderkey", "bigint"), ("about", "RECORD<o_custkey bigint, price decimal(15,2)>"),
    ("lines", "RECORD<l_linenumber int, l_partkey bigint, l_quantity double, state RECORD<l_returnflag string, "
              "l_shipdate timestamp_ntz>> REPEATED"),
    ("status", "RECORD<key string, value string> REPEATED"), ("grid", "bigint REPEATED REPEATED"), ("closed", "date"), ("seal", "binary")]


def _typed(table: str) -> list[tuple[str, str]]:
    return [(c, "int" if c in _INTS else _TYPES[kind]) for c, kind in (x.split(":") for x in REAL[table].split())]


def _column_types() -> str:
    row = lambda schema, table, i, c, kind, keep, source: (
        f"SELECT '{schema}' AS \"schema\", '{table}' AS \"table\", {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS data_type, "
        f"true AS nullable, false AS unreadable, {keep} AS keep FROM {source}")
    parts = [row("main", t, i, c, kind, f"count({c}) > 0 OR count(*) = 0", t)
             for t in REAL for i, (c, kind) in enumerate(_typed(t), start=1)]
    parts += [row("lake", "nested", i, c, kind, f"count(*) = 0 OR {'false' if c in ('closed', 'seal') else 'count(*) > 0'}", "orders")
              for i, (c, kind) in enumerate(_NESTED, start=1)]
    parts.append("SELECT 'main', 'broken', NULL, NULL, NULL, NULL, true, NULL")
    return "\nUNION ALL ".join(parts)


def _prompts_with_samples() -> str:
    wide = [("lineitem", None), ("orders", "l_orderkey = o_orderkey"), ("customer", "o_custkey = c_custkey"),
            ("part", "l_partkey = p_partkey"), ("supplier", "l_suppkey = s_suppkey")]
    layout = {t: (_typed(t), ROW_KEYS[t], t) for t in REAL}
    layout["embeddings"] = ([(c, "int REPEATED" if c == "embedding" else k) for c, k in _typed("embeddings")], ["vec_id"],
                            "(SELECT vec_id, list_transform(embedding, lambda x: floor(x::FLOAT * 1000)::INTEGER) AS embedding, label FROM embeddings)")
    layout["sparse"] = ([("event_id", "bigint"), ("note", "string"), ("ts", "timestamp_ntz"), ("amount", "double"), ("even_user", "bigint")],
                        ["event_id"], "(SELECT event_id, NULL::VARCHAR AS note, ts, NULL::DOUBLE AS amount, "
                        "CASE WHEN event_id % 2 = 0 THEN user_id END AS even_user FROM events)")
    layout["order_lines"] = ([x for t, _ in wide for x in _typed(t)], ROW_KEYS["lineitem"], "(SELECT * FROM " + " ".join(
        f"JOIN {t} ON {on}" if on else t for t, on in wide) + ")")
    parts = []
    for table, (columns, key, source) in layout.items():
        by = " || '|' || ".join(f"{c}::VARCHAR" for c in key)
        text = {"string": "to_json({})::VARCHAR", "int REPEATED": "to_json({})::VARCHAR",
                "timestamp_ntz": "'\"' || strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 > 0 "
                                 "THEN '.' || lpad((microsecond({0}) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '\"'"}
        member = [f"CASE WHEN count({c}) OVER () > 0 THEN '\"{c}\":' || coalesce({text.get(kind, '{}::VARCHAR').format(c)}, 'null') END"
                  for c, kind in columns]
        gone = " + ".join(f"CASE WHEN count({c}) OVER () = 0 THEN 1 ELSE 0 END" for c, _ in columns)
        lines = "\n".join(f"  - {c}: {kind}, nullable=true, pk={'true' if c in key else 'false'}" for c, kind in columns)
        brief = enrich.WIDTH_GUIDANCE if len(columns) >= 30 else ""
        parts.append(f"""SELECT '{table}' AS tbl, {len(columns)} AS n, any_value(gone)::INTEGER AS gone,
  {lit(enrich.INSTRUCTIONS + f"{chr(10) * 2}Table: main.{table}{chr(10)}Columns:{chr(10)}{lines}{chr(10)}Sample rows (JSON")}
  || CASE WHEN any_value(gone) > 0 THEN ', without ' || any_value(gone) || ' empty columns' ELSE '' END || '):' || chr(10) || '['
  || string_agg('{{' || body || '}}', ',' ORDER BY rn) || ']' || chr(10) || {lit(brief + enrich.ANSWER_SHAPE)} AS prompt
FROM (SELECT rn, concat_ws(',', {', '.join(member)}) AS body, {gone} AS gone FROM (
  SELECT *, row_number() OVER (ORDER BY md5({by})) AS rn FROM {source} QUALIFY row_number() OVER (ORDER BY md5({by})) <= 5))""")
    listed = "\nUNION ALL ".join(parts)
    return f"""SELECT 'main' AS "schema", tbl AS "table", 0 AS part, n::BIGINT AS n_columns, n >= 30 AS is_wide, gone AS omitted_columns,
  length(prompt)::INTEGER AS prompt_length, md5(prompt) AS prompt_md5 FROM ({listed})"""


def _lists() -> str:
    def one(section: str, query: str, order: str, columns: list[str], texts: int) -> str:
        cells = [f"""'"{c}":' || """ + (f"""'"' || "{c}" || '"'""" if i < texts else f'"{c}"') for i, c in enumerate(columns)]
        payload = "'{' || " + " || ',' || ".join(cells) + " || '}'"
        return (f"SELECT '{section}' AS section, row_number() OVER (ORDER BY {order}) AS position, {payload} AS payload "
                f"FROM ({ORACLE[query]})")

    names = '"schema", "table"'
    return "\nUNION ALL ".join([
        one("tables", "o2_table_changes", f"change_type, {names}", ["change_type", "schema", "table"], 3),
        one("integrity", "s12_integrity", f"problem, {names}", ["problem", "schema", "table"], 3),
        one("breakdown", "a12_breakdown", names,
            ["schema", "table", "declared", "inferred_correct", "missed", "false_positive"], 2)])


_TABLES = [*REAL, "broken", "nowhere"]
_PAIRS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_partkey", "part_copy", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("lineitem", "l_suppkey", "supplier_new", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("orders", "o_custkey", "customer_old", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("customer_old", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("supplier_new", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
]
_DOUBLED = """customer_old AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), part_copy AS (SELECT * FROM part),
supplier_new AS (SELECT -s_suppkey - 1 AS s_suppkey, s_nationkey FROM supplier)"""
_CONTAINED = f"WITH {_DOUBLED}, contained AS (" + "\nUNION ALL ".join(
    f"SELECT 'main' AS source_schema, '{s}' AS source_table, '{a}' AS source_column, 'main' AS target_schema, "
    f"'{t}' AS target_table, '{b}' AS target_column, count(DISTINCT {a}) AS n_values, "
    f"count(DISTINCT CASE WHEN {a} IN (SELECT {b} FROM {t}) THEN {a} END) AS n_found FROM {s}" for s, a, t, b in _PAIRS) + ")"
_EDGE = "source_schema, source_table, source_column, target_schema, target_table, target_column"
_SHARE = "CASE WHEN n_values > 0 THEN n_found / CAST(n_values AS DOUBLE) ELSE 0 END"

BATCH_ORACLE: dict[str, str] = {
    "u4_describe_tables": _catalog("""SELECT sch AS "schema", tbl AS "table",
        CASE WHEN event IN ('ok', 'parse_retry') THEN 'Rows about ' || tbl END AS description, event,
        CASE event WHEN 'provider_error' THEN 'RuntimeError: busy' WHEN 'failed' THEN 'bad_json' END AS error_reason,
        CAST(CASE event WHEN 'provider_error' THEN 0 WHEN 'ok' THEN 1 ELSE 2 END AS BIGINT) AS accepted_calls,
        CAST(CASE event WHEN 'provider_error' THEN 3 WHEN 'ok' THEN 1 + lost ELSE 2 + lost END AS BIGINT) AS calls,
        CAST(CASE WHEN event IN ('ok', 'parse_retry') THEN width ELSE 0 END AS BIGINT) AS n_columns
        FROM (SELECT sch, tbl, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS lost, (SELECT count(*) FROM base b WHERE b.tbl = tabs.tbl) AS width,
          CASE WHEN k % 5 = 4 AND tbl = 'orders' THEN 'provider_error' WHEN tbl = 'pages' THEN 'failed'
            WHEN k % 8 = 6 THEN 'parse_retry' ELSE 'ok' END AS event FROM tabs)"""),
    "u9_progress": _catalog("""SELECT CAST(run AS INTEGER) AS run, CAST(request AS INTEGER) AS request, CAST(answered AS BIGINT) AS answered,
        CAST(total AS BIGINT) AS total, CAST(errors AS BIGINT) AS errors, true AS every_slice_ended FROM (
        SELECT 1 AS run, 1 AS request, count(*) FILTER (WHERE NOT never AND NOT late) AS answered, count(*) AS total,
          count(*) FILTER (WHERE never OR late) AS errors FROM asked
        UNION ALL SELECT 1, 2, count(*), count(*), 0 FROM asked WHERE unclear AND NOT never AND NOT late HAVING count(*) > 0
        UNION ALL SELECT 2, 1, count(*) FILTER (WHERE NOT never), count(*), 2 * count(*) FILTER (WHERE never)
          FROM asked WHERE never OR late HAVING count(*) > 0
        UNION ALL SELECT 2, 2, count(*), count(*), 0 FROM asked WHERE unclear AND late AND NOT never HAVING count(*) > 0
        UNION ALL SELECT 0, 1, count(*) FILTER (WHERE NOT never),
          count(*) + count(*) FILTER (WHERE late AND NOT never) + 2 * count(*) FILTER (WHERE never),
          count(*) FILTER (WHERE late AND NOT never) + 3 * count(*) FILTER (WHERE never) FROM asked
        UNION ALL SELECT 0, 2, count(*), count(*), 0 FROM asked WHERE unclear AND NOT never HAVING count(*) > 0)""", """asked AS (
        SELECT k % 5 = 4 AND tbl = 'orders' AS never, k % 3 = 1 AS late, tbl = 'pages' OR k % 8 = 6 AS unclear FROM tabs)"""),
    "u7_evaluate": _catalog("""SELECT sch AS "schema", tbl AS "table", CASE WHEN fine THEN 'ok' ELSE 'failed' END AS status,
        CASE WHEN fine THEN (1 + k % 5)::INTEGER END AS accuracy,
        CASE WHEN fine THEN least(length(tbl), 5)::INTEGER END AS specificity,
        CASE WHEN fine THEN greatest(k % 4, 1)::INTEGER END AS domain_inference,
        CASE WHEN fine THEN 'by name' END AS accuracy_reasoning,
        (CASE WHEN never THEN 3 WHEN k % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS calls
        FROM (SELECT *, NOT never AND tbl <> 'pages' AS fine FROM (
          SELECT k, sch, tbl, k % 5 = 4 AND tbl = 'orders' AS never FROM slot WHERE filled))"""),
    "u2_prompts_with_samples": _prompts_with_samples(),
    "p1_column_types": _column_types(),
    "r2_edge_report": _catalog(f"""SELECT row_number() OVER (ORDER BY kind, source_schema, source_table, cname NULLS FIRST, ord NULLS FIRST,
        source_column, target_schema, target_table, target_column) AS position, kind, {EDGE} FROM (
        SELECT {_LINK_EDGE}, 'declared' AS kind, cname, ord FROM links WHERE tsch IS NOT NULL
        UNION ALL SELECT {EDGE}, kind, NULL, NULL FROM rel WHERE kind = 'inferred')"""),
    "r3_report_lists": _lists(),
    "e3_merge": _catalog(f"""SELECT sch AS "schema", tbl AS "table",
        CASE WHEN filled THEN 'Rows about ' || tbl || CASE WHEN stale THEN ' v2' ELSE '' END END AS description,
        CAST(CASE WHEN filled THEN width ELSE 0 END AS BIGINT) AS n_columns,
        CAST(CASE WHEN filled AND stale THEN width ELSE 0 END AS BIGINT) AS n_new
        FROM (SELECT sch, tbl, (k + p) % 7 <> 0 AS filled, ({_STALE}) AS stale,
          (SELECT count(*) FROM base b WHERE b.tbl = tabs.tbl) AS width FROM tabs)"""),
    "j9_sample_requests": f"""WITH names AS (SELECT [{', '.join(map(lit, _TABLES))}] AS n),
picked AS ({_samples()}),
asked AS (
  SELECT c_custkey AS request_id, n[c_custkey % 16 + 1] AS tbl,
    coalesce(([NULL, 1, 5, 20, 21, 0, -3])[c_custkey % 7 + 1], 5)::INTEGER AS lim FROM customer, names),
decided AS (
  SELECT *, CASE WHEN lim < 1 THEN 'rejected_invalid_limit' WHEN lim > 20 THEN 'rejected_cap'
    WHEN tbl = 'nowhere' THEN 'rejected_unknown_table' WHEN tbl = 'broken' THEN 'db_error' ELSE 'ok' END AS outcome FROM asked),
answered AS (
  SELECT d.request_id, count(p.k) AS n, string_agg(p.k, ',' ORDER BY p.rn) AS keys
  FROM decided d LEFT JOIN picked p ON p.tbl = d.tbl AND p.rn <= d.lim AND d.outcome = 'ok' GROUP BY d.request_id)
SELECT d.request_id, 'sample' AS tool, 'main' AS "schema", d.tbl AS "table", outcome, lim AS limit_requested,
  CASE WHEN outcome = 'ok' THEN lim END AS limit_effective, CASE WHEN outcome = 'ok' THEN n END AS rows_returned,
  CASE WHEN outcome = 'ok' THEN coalesce(keys, '') END AS row_keys,
  CASE WHEN outcome = 'ok' THEN (CASE WHEN d.tbl = 'customer' THEN n ELSE 0 END)::INTEGER END AS names_hidden
FROM decided d JOIN answered USING (request_id)""",
    "r1_search_many": _catalog("""SELECT n.query_id, CAST(rnk AS INTEGER) AS rank, sch AS "schema", tbl AS "table",
        (['table_name', 'column_name', 'description_body'])[tier + 1] AS match_type
        FROM many n JOIN (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY tier, sch, tbl) AS rnk FROM (
          SELECT needle, sch, tbl, min(tier) AS tier FROM (SELECT DISTINCT needle FROM many WHERE needle <> '') JOIN (
            SELECT body, list({'sch': sch, 'tbl': tbl, 'tier': tier}) AS places FROM texts GROUP BY body) ON contains(body, needle),
            LATERAL (SELECT unnest(places) AS place), LATERAL (SELECT place.sch AS sch, place.tbl AS tbl, place.tier AS tier)
          GROUP BY needle, sch, tbl)) USING (needle) WHERE rnk <= 3""", f"""many AS (
  SELECT query_id, lower(CASE WHEN query_id % 11 = 0 THEN 'the ' || piece ELSE piece END) AS needle FROM (
    SELECT o_orderkey AS query_id, substring(([{', '.join(map(lit, NEEDLE_NAMES))}])[o_orderkey % {len(NEEDLE_NAMES)} + 1],
      (o_orderkey % 4 + 1)::INTEGER, (o_orderkey % 6)::INTEGER) AS piece FROM orders))"""),
    "a2_composite_keys": _composite_keys(),
    "e1_containment_all": f"{_CONTAINED} SELECT {_EDGE}, n_values, n_found, round({_SHARE}, 6) AS containment FROM contained",
    "e1_ties_all": f"""{_CONTAINED}, good AS (SELECT *, {_SHARE} AS share FROM contained WHERE {_SHARE} >= 0.5)
SELECT {_EDGE}, n_values, n_found, round(share, 6) AS containment FROM good g
WHERE share = (SELECT max(share) FROM good h WHERE h.source_table = g.source_table AND h.source_column = g.source_column)
  AND (SELECT count(*) FROM good h WHERE h.source_table = g.source_table AND h.source_column = g.source_column AND h.share = g.share) = 1""",
    "s10_versions": _catalog("""SELECT version, what, n FROM (
        SELECT CAST(v AS INTEGER) AS version, count(*) AS tables, count(*) FILTER (WHERE (k + p) % 7 <> 0) AS descriptions_present,
          count(*) FILTER (WHERE (k + p) % 7 = 0) AS descriptions_null,
          (SELECT count(*) FROM declared) AS relationships FROM tabs, (VALUES (1), (2)) w(v) WHERE v = 2 OR k % 2 = 0 GROUP BY v)
        UNPIVOT (n FOR what IN (tables, descriptions_present, descriptions_null, relationships))"""),
    "p7_scrub_known": _connections() + """, written AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 'p%40ss' || c ELSE 'pw' || c || 'x' END AS pw FROM labels_),
dsns AS (
  SELECT *, CASE form WHEN 'word' THEN scheme WHEN 'none' THEN '' WHEN 'bare' THEN scheme || '://host' || c || port || path
    ELSE scheme || '://user' || c || ':' || pw || '@Host' || (k % 9) || '.example.com' || port || path END AS dsn FROM written),
known AS (
  SELECT secret, min(mask) AS mask FROM (
    SELECT dsn AS secret, label AS mask FROM dsns WHERE form IN ('bare', 'full') AND id % 2 = 0
    UNION ALL SELECT pw, '***' FROM dsns WHERE form = 'full' AND id % 2 = 0
    UNION ALL SELECT 'p@ss' || c, '***' FROM dsns WHERE form = 'full' AND id % 2 = 0 AND k % 3 = 0) GROUP BY secret),
texts AS (
  SELECT id, 'connect to ' || dsn || ' failed: password ''p@ss' || c || ''' or ''pw' || c
    || 'x'' rejected by snowflake.errors; see ftp://bob:secret@files/x' AS message FROM dsns
  UNION ALL SELECT -doc_id - 1, text FROM documents),
-- No secret holds white space: it lies within one word.
words AS (SELECT id, unnest(list_distinct(regexp_split_to_array(message, '[[:space:]]+'))) AS word FROM texts),
places AS (SELECT DISTINCT word FROM words WHERE contains(word, '://') OR contains(word, 'pw') OR contains(word, 'ss')),
lengths AS (SELECT DISTINCT length(secret) AS n FROM known),
cuts AS (SELECT DISTINCT word, substring(word, i, n) AS secret FROM (
  SELECT word, n, unnest(range(1, length(word) - n + 2)) AS i FROM places, lengths WHERE length(word) >= n)),
hits AS (SELECT DISTINCT id, secret, mask FROM cuts JOIN known USING (secret) JOIN words USING (word)),
per_text AS (SELECT id, list({'s': secret, 'm': mask} ORDER BY length(secret) DESC, secret) AS found FROM hits GROUP BY id)
SELECT id, md5(CASE WHEN found IS NULL THEN message ELSE
  list_reduce([{'s': '', 'm': message}] || found, lambda a, x: {'s': '', 'm': replace(a.m, x.s, x.m)}).m END) AS text_md5
FROM texts LEFT JOIN per_text USING (id)""",
    "s16_audit_stream": _catalog("""SELECT request_id, 'sample' AS tool, sch AS "schema", name AS "table", outcome,
        asked AS limit_requested, CASE WHEN outcome = 'ok' THEN asked END AS limit_effective,
        CASE WHEN outcome = 'ok' AND row_count IS NOT NULL THEN least(row_count, asked) END AS rows_returned
        FROM (SELECT *, CASE WHEN asked < 1 THEN 'rejected_invalid_limit' WHEN asked > 20 THEN 'rejected_cap'
          WHEN k % 12 = 0 OR (request_id % 3 = 0 AND k % 2 = 1) THEN 'rejected_unknown_table' ELSE 'ok' END AS outcome FROM (
          SELECT k, k * 100 + p AS request_id, sch, tbl || CASE WHEN k % 12 = 0 THEN '_x' ELSE '' END AS name, row_count,
            coalesce(([NULL, 1, 5, 20, 21, 0, -3])[k % 7 + 1], 5) AS asked FROM counted))"""),
}
# The queries of ``batch`` register themselves beside the others; so does their SQL.
ORACLE.update(BATCH_ORACLE)
