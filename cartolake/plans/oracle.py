"""The registered queries in plain SQL over the same tables.

The SQL states the expected result in its own terms (direct comparisons, window
functions, recursive closure); it shares only fixed values with the library:
the catalog layout, word patterns and prompt texts.
"""

from __future__ import annotations

from cartolake.functions import classify as C
from cartolake.functions.jsonvalue import FLOAT_TEXT, INT_TEXT
from cartolake.functions.text import FENCE
from cartolake.operators import enrich, judge
from cartolake.operators.profile import EVIDENCE, EVIDENCE_SHARE
from cartolake.plans.tenants import BASE

# Columns of the given tables: i = integral, f = fractional, s = text, t = time, a = array.
REAL = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f "
                "l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:f props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
REAL_COLUMNS = [(t, o, c.split(":")[0], c.split(":")[1])
                for t, spec in REAL.items() for o, c in enumerate(spec.split(), start=1)]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    cell = lambda v: ("true" if v else "false") if isinstance(v, bool) else lit(v) if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _risk(table: str, column: str) -> str:
    name = f"lower(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    return (f"CASE WHEN regexp_matches({name}, {lit(C.HIGH)}) OR (regexp_matches({name}, {lit(C.PERSON_NAME)}) AND "
            f"regexp_matches(lower({table}), {lit(C.PEOPLE)})) THEN 'high' "
            f"WHEN regexp_matches({name}, {lit(C.MEDIUM)}) THEN 'medium' "
            f"WHEN regexp_matches({name}, {lit(C.LOW)}) THEN 'low' ELSE 'none' END")


def _semantic(column: str, kind: str, key: str) -> str:
    name = f"lower(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    return (f"CASE WHEN {key} OR regexp_matches({name}, {lit(C.KEY_NAME)}) THEN 'identifier' "
            f"WHEN regexp_matches(lower({kind}), {lit(C.NUMERIC_TYPE)}) AND regexp_matches({name}, {lit(C.MEASURE_NAME)}) "
            f"THEN 'measure' WHEN regexp_matches(lower({kind}), {lit(C.TEXT_TYPE)}) OR "
            f"regexp_matches(lower({kind}), {lit(C.NUMERIC_TYPE)}) THEN 'dimension' ELSE 'other' END")


def _rel(name: str, threshold: int, declared: bool = True) -> str:
    """CTEs for relationship mapping by direct comparison of names."""
    return f"""
{name}_cand AS (
  SELECT DISTINCT c.sch, c.tbl, c.col, p.ttbl, p.pk FROM npk c JOIN pk p ON c.sch = p.sch
   AND (c.col = p.pk OR (ends_with(c.col, '_' || p.pk) AND c.tbl <> p.ttbl))
  WHERE NOT EXISTS (SELECT 1 FROM press x WHERE x.sch = p.sch AND x.pk = p.pk AND x.n > {threshold})),
{name}_inf AS (
  SELECT sch AS source_schema, tbl AS source_table, col AS source_column, sch AS target_schema,
         min(ttbl) AS target_table, min(pk) AS target_column
  FROM {name}_cand GROUP BY sch, tbl, col HAVING count(*) = 1),
{name} AS (
  SELECT *, 'declared' AS kind FROM declared
  UNION ALL
  SELECT *, 'inferred' FROM {name}_inf i WHERE NOT EXISTS (
    SELECT 1 FROM declared d WHERE d.source_schema = i.source_schema AND d.source_table = i.source_table
     AND d.source_column = i.source_column))"""


# Shared tables of the derived catalog; a query pays only for those it names.
CATALOG = f"""WITH RECURSIVE
t AS (SELECT c_custkey AS k, 't' || c_custkey AS s FROM customer),
base(tbl, p, ord, col, kind, typ, is_pk, in_key) AS ({_values(BASE)}),
tabbase AS (SELECT DISTINCT tbl, p FROM base),
lay AS (SELECT t.k, t.s AS sch, base.* FROM t, base WHERE tbl <> 'attrs' OR k % 3 = 0),
tabs AS (SELECT t.k, t.s AS sch, tabbase.* FROM t, tabbase WHERE tbl <> 'attrs' OR k % 3 = 0),
stat AS (SELECT *, CAST(CASE WHEN k % 5 = 0 THEN -1 WHEN k % 5 = 2 THEN 0 WHEN k % 5 <> 1 THEN k * 10 + p END
                        AS BIGINT) AS raw_count FROM tabs),
counted AS (SELECT k, p, sch, tbl, CASE WHEN raw_count >= 0 THEN raw_count END AS row_count FROM stat),
info AS (SELECT *, CASE WHEN tbl = 'labels' AND k % 7 = 3 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM tabs),
pk AS (SELECT sch, tbl AS ttbl, min(col) AS pk FROM lay WHERE is_pk GROUP BY sch, tbl HAVING count(*) = 1),
npk AS (SELECT * FROM lay WHERE NOT is_pk),
press AS (SELECT p.sch, p.pk, count(*) AS n FROM npk c JOIN (SELECT DISTINCT sch, pk FROM pk) p ON c.sch = p.sch
           AND (c.col = p.pk OR ends_with(c.col, '_' || p.pk)) GROUP BY p.sch, p.pk),
declared AS (
  SELECT s AS source_schema, 'customer' AS source_table, 'nationkey' AS source_column, s AS target_schema,
         'nation' AS target_table, 'nationkey' AS target_column FROM t WHERE k % 2 = 0
  UNION ALL SELECT s, 'orders', 'custkey', s, 'customer', 'custkey' FROM t WHERE k % 2 = 0
  UNION ALL SELECT s, 'events', 'user_id', 'archive', 'users', 'user_id' FROM t WHERE k % 10 = 0),
{_rel("rel", 15)},
{_rel("rel30", 30)},
slot AS (
  SELECT k, p, sch, tbl, (k + p) % 7 <> 0 AS filled, 'Rows about ' || tbl AS descr, 'one row per ' || tbl AS grain,
         CASE WHEN k % 2 = 1 THEN ['sales', tbl] ELSE [tbl, 'sales'] END AS hints,
         CAST(0.5 AS DOUBLE) + CAST(k % 50 AS DOUBLE) / 100 AS conf FROM tabs),
cdesc AS (
  SELECT k, p, sch, tbl, ord, col, 'The ' || col AS descr, {_semantic("col", "typ", "is_pk")} AS sem,
         {_risk("tbl", "col")} AS risk, CAST(0.4 AS DOUBLE) + CAST(ord % 6 AS DOUBLE) / 10 AS conf
  FROM lay WHERE (k + p) % 7 <> 0),
links AS (
  SELECT k, s AS sch, 'customer_nation_fk' AS cname, 'customer' AS tbl, 'nationkey' AS col, 1 AS ord,
         s AS tsch, 'nation' AS ttbl, 'nationkey' AS tcol FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, s, 'orders_customer_fk', 'orders', 'custkey', 1, CASE WHEN k % 22 <> 0 THEN s END,
         CASE WHEN k % 22 <> 0 THEN 'customer' END, CASE WHEN k % 22 <> 0 THEN 'custkey' END FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, s, 'events_user_fk', 'events', 'user_id', 1, 'archive', 'users', 'user_id' FROM t WHERE k % 10 = 0
  UNION ALL SELECT k, s, 'attrs_conv_fk', 'attrs', 'a0_name', 1, s, 'conversations', 'turn' FROM t WHERE k % 3 = 0
  UNION ALL SELECT k, s, 'attrs_conv_fk', 'attrs', 'a1_name', 2, s, 'conversations', 'conv_id' FROM t WHERE k % 3 = 0),
ends AS (SELECT source_schema AS sch, source_table AS tbl FROM rel
         UNION ALL SELECT target_schema, target_table FROM rel),
texts AS (
  SELECT sch, tbl, 0 AS tier, lower(tbl) AS body FROM tabs
  UNION ALL SELECT sch, tbl, 1, lower(col) FROM lay
  UNION ALL SELECT sch, tbl, 2, lower(descr) FROM slot WHERE filled
  UNION ALL SELECT sch, tbl, 2, lower(grain) FROM slot WHERE filled
  UNION ALL SELECT sch, tbl, 2, lower(descr) FROM cdesc),
needles(query_id, query) AS (VALUES (1, 'order'), (2, 'KEY'), (3, 'name'), (4, 'doc'), (5, 'one row'),
  (6, 'rows about p'), (7, 'zzz'), (8, ''), (9, 'custkey'), (10, 'a1')),
hits AS (SELECT n.query_id, x.sch, x.tbl, min(x.tier) AS tier FROM needles n JOIN texts x
          ON n.query <> '' AND contains(x.body, lower(n.query)) GROUP BY n.query_id, x.sch, x.tbl),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, sch, tbl) AS rnk FROM hits)
            WHERE rnk <= 20),
expect AS (SELECT DISTINCT query_id, 't' || i || '.' || name AS item FROM (VALUES (1, 'orders'), (2, 'orders'),
  (2, 'lineitem'), (3, 'version'), (3, 'customer'), (4, 'documents'), (5, 'region'), (6, 'part'), (6, 'pages'),
  (7, 'orders'), (8, 'orders'), (9, 'customer'), (9, 'orders')) e(query_id, name), range(1, 6) r(i)),
scored AS (
  SELECT n.query_id, n.query, count(r.tbl) AS returned,
         (SELECT count(*) FROM expect e WHERE e.query_id = n.query_id) AS expected,
         count(e.item) AS hits, min(CASE WHEN e.item IS NOT NULL THEN r.rnk END) AS first_hit
  FROM needles n LEFT JOIN ranked r ON r.query_id = n.query_id
  LEFT JOIN expect e ON e.query_id = n.query_id AND e.item = r.sch || '.' || r.tbl GROUP BY n.query_id, n.query),
metrics AS (
  SELECT query_id, query, returned, expected, hits,
         CASE WHEN returned > 0 THEN hits / CAST(returned AS DOUBLE) ELSE 0 END AS prec,
         CASE WHEN expected > 0 THEN hits / CAST(expected AS DOUBLE) ELSE 0 END AS rec,
         CASE WHEN first_hit IS NOT NULL THEN 1 / CAST(first_hit AS DOUBLE) ELSE 0 END AS rr FROM scored),
objs AS (
  SELECT k, p, sch, tbl, ord, col,
         '{{"name":"' || CASE WHEN k % 8 = 2 AND ord = 1 THEN 'swapped' ELSE col END || '","description":"The ' || col
         || '","semantic_type":"' || {_semantic("col", "typ", "is_pk")} || '","pii_risk":"'
         || CASE WHEN k % 8 = 3 AND ord = 1 THEN 'PII' ELSE {_risk("tbl", "col")} END
         || '","confidence":' || CASE WHEN k % 8 = 5 THEN '"0.5"' ELSE '0.5' END || '}}' AS obj,
         count(*) OVER (PARTITION BY sch, tbl) AS n FROM lay),
answer AS (
  SELECT k, p, sch, tbl, '{{"description":"Rows about ' || tbl || '","grain":"one row per ' || tbl
         || '","domain_hints":["' || tbl || '","sales"],"columns":['
         || coalesce(string_agg(obj, ',' ORDER BY ord) FILTER (WHERE NOT (k % 8 = 1 AND ord = n)), '')
         || '],"confidence":' || CASE WHEN k % 8 = 4 THEN '"high"' ELSE '0.9' END || '}}' AS body
  FROM objs GROUP BY k, p, sch, tbl),
first_answer AS (
  SELECT k, p, sch, tbl, CASE WHEN k % 24 = 7 THEN 'I cannot describe this table.'
         WHEN k % 8 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
         WHEN k % 8 = 6 THEN left(body, length(body) - 10) ELSE body END AS raw FROM answer),
second_answer AS (
  SELECT k, p, sch, tbl, CASE WHEN k % 8 = 6 AND p % 2 = 1 THEN left(body, length(body) - 10) ELSE body END AS raw
  FROM answer),
judged_text AS (
  SELECT k, p, sch, tbl, CASE WHEN k % 6 = 1 THEN '9' WHEN k % 6 = 2 THEN '"4"' WHEN k % 6 = 3 THEN '4.7'
         ELSE CAST(1 + (k + p) % 5 AS VARCHAR) END AS sc,
         CASE WHEN k % 6 = 4 THEN '' ELSE ',"reasoning":"because"' END AS note FROM tabs),
judged_raw AS (
  SELECT k, p, sch, tbl, CASE WHEN k % 6 = 5 THEN 'The description is good.' ELSE
         '{{"accuracy":{{"score":' || sc || note || '}},"specificity":{{"score":3' || note
         || '}},"domain_inference":{{"score":' || sc || note || '}}}}' END AS raw FROM judged_text),
outcome AS (
  SELECT k, p, sch, tbl, CASE WHEN (k + p) % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'provider_error' END
         WHEN (k + p) % 5 = 0 THEN 'parse_retry' ELSE 'ok' END AS event FROM tabs)
"""


def _score(dim: str) -> str:
    value = f"json_extract(doc, '$.{dim}.score')"
    text = f"json_extract_string(doc, '$.{dim}.score')"
    return (f"CASE WHEN json_type(doc, '$.{dim}') = 'OBJECT' THEN "
            f"CASE WHEN json_type({value}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(CAST({text} AS DOUBLE)) "
            f"WHEN json_type({value}) = 'VARCHAR' AND regexp_matches({text}, {lit(INT_TEXT)}) "
            f"THEN CAST(trim({text}) AS DOUBLE) END END")


SCORES = f""", score_doc AS (SELECT k, p, sch, tbl, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS doc
  FROM judged_raw),
score_raw AS (SELECT k, p, sch, tbl, {", ".join(f"{_score(d)} AS s_{d}" for d in judge.DIMENSIONS)},
  {", ".join(f"coalesce(json_extract_string(doc, '$.{d}.reasoning'), '') AS r_{d}" for d in judge.DIMENSIONS)}
  FROM score_doc),
score AS (SELECT *, {" AND ".join(f"s_{d} IS NOT NULL" for d in judge.DIMENSIONS)} AS good FROM score_raw),
scores AS (SELECT k, p, sch, tbl, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status,
  {", ".join(f"CASE WHEN good THEN CAST(greatest(least(s_{d}, 5), 1) AS INTEGER) END AS {d}" for d in judge.DIMENSIONS)},
  {", ".join(f"CASE WHEN good THEN r_{d} END AS {d}_reasoning" for d in judge.DIMENSIONS)} FROM score)
"""


def _parsed(name: str, answers: str) -> str:
    """CTEs that check model answers: {name}_verdict and {name}_items."""
    number = lambda v, s: (
        f"(json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') OR "
        f"(json_type({v}) = 'VARCHAR' AND regexp_matches({s}, {lit(FLOAT_TEXT)})))")
    field = lambda n: f"json_extract(item, '$.{n}')"
    word = lambda n: f"json_extract_string(item, '$.{n}')"
    conf, conf_text = "json_extract(doc, '$.confidence')", "json_extract_string(doc, '$.confidence')"
    return f""", {name}_text AS (
  SELECT *, CASE WHEN regexp_matches(trim(raw, chr(10) || ' '), {lit(FENCE)})
    THEN regexp_extract(trim(raw, chr(10) || ' '), {lit(FENCE)}, 1) ELSE raw END AS body FROM {answers}),
{name}_doc AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS doc FROM {name}_text),
{name}_items AS (
  SELECT d.sch, d.tbl, c.ord, c.col, json_extract(d.doc, '$.columns[' || (c.ord - 1) || ']') AS item
  FROM {name}_doc d JOIN lay c ON c.sch = d.sch AND c.tbl = d.tbl WHERE d.doc IS NOT NULL),
{name}_checked AS (
  SELECT *, CASE WHEN {field("name")} IS NULL THEN 'missing_field'
    WHEN {word("name")} IS DISTINCT FROM col THEN 'column_name'
    WHEN {field("description")} IS NULL OR {field("semantic_type")} IS NULL THEN 'missing_field'
    WHEN {word("semantic_type")} NOT IN ('identifier', 'dimension', 'measure', 'other') THEN 'bad_enum'
    WHEN {field("pii_risk")} IS NULL THEN 'missing_field'
    WHEN {word("pii_risk")} NOT IN ('none', 'low', 'medium', 'high') THEN 'bad_enum'
    WHEN {field("confidence")} IS NULL THEN 'missing_field'
    WHEN NOT {number(field("confidence"), word("confidence"))} THEN 'bad_number' END AS problem
  FROM {name}_items),
{name}_verdict AS (
  SELECT d.k, d.p, d.sch, d.tbl, d.raw, d.doc, CASE WHEN d.doc IS NULL THEN 'bad_json'
    WHEN json_type(d.doc, '$.columns') IS DISTINCT FROM 'ARRAY' THEN 'missing_field'
    WHEN json_array_length(d.doc, '$.columns') <> (SELECT count(*) FROM lay c WHERE c.sch = d.sch AND c.tbl = d.tbl)
      THEN 'column_count'
    WHEN w.problem IS NOT NULL THEN w.problem
    WHEN json_extract(doc, '$.description') IS NULL OR json_extract(doc, '$.grain') IS NULL THEN 'missing_field'
    WHEN {conf} IS NULL THEN 'missing_field'
    WHEN NOT {number(conf, conf_text)} THEN 'bad_number' END AS reason
  FROM {name}_doc d LEFT JOIN (SELECT sch, tbl, arg_min(problem, ord) AS problem FROM {name}_checked
    WHERE problem IS NOT NULL GROUP BY sch, tbl) w ON w.sch = d.sch AND w.tbl = d.tbl)
"""


def _real_keys() -> str:
    """CTEs over the given tables: every column, and the chosen keys."""
    integral = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {o} AS ord, '{c}' AS col, count(*) AS n, count({c}) AS filled, "
        f"count(DISTINCT {c}) AS d FROM {t}" for t, o, c, f in REAL_COLUMNS if f == "i")
    listed = _values([(t, o, c, f) for t, o, c, f in REAL_COLUMNS])
    return f"""WITH col_stats AS ({integral}),
real_keys AS (SELECT tbl, min(ord) AS ord, arg_min(col, ord) AS col FROM col_stats
  WHERE n > 0 AND filled = n AND d = n GROUP BY tbl),
real_cols(tbl, ord, col, fam) AS ({listed}),
marked AS (SELECT c.*, k.col IS NOT NULL AS is_pk, regexp_replace(c.col, '^[a-z]_', '') AS nm
  FROM real_cols c LEFT JOIN real_keys k ON k.tbl = c.tbl AND k.col = c.col)"""


def _evidence() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{c}' AS col, '{kind}' AS kind, count({c}) AS filled, "
        f"count(*) FILTER (WHERE regexp_matches({c}, {lit(pattern)})) AS matched FROM {t}"
        for t, _, c, f in REAL_COLUMNS if f == "s" for kind, pattern in EVIDENCE.items())


def _prompt() -> str:
    line = "'  - ' || col || ': ' || typ || ', nullable=' || CASE WHEN is_pk THEN 'false' ELSE 'true' END " \
           "|| ', pk=' || CASE WHEN is_pk THEN 'true' ELSE 'false' END"
    return (f"prompts AS (SELECT sch, tbl, count(*) AS n, {lit(enrich.INSTRUCTIONS)} || chr(10) || chr(10) || 'Table: ' "
            f"|| sch || '.' || tbl || chr(10) || 'Columns:' || chr(10) || string_agg({line}, chr(10) ORDER BY ord) "
            f"|| chr(10) || 'Sample rows (JSON):' || chr(10) || '[]' || chr(10) || CASE WHEN count(*) >= 30 THEN "
            f"{lit(enrich.WIDTH_GUIDANCE)} ELSE '' END || {lit(enrich.ANSWER_SHAPE)} AS prompt, "
            f"string_agg({line}, chr(10) ORDER BY ord) AS lines FROM lay GROUP BY sch, tbl)")


KEY = 'sch AS "schema", tbl AS "table"'
EDGE = "source_schema, source_table, source_column, target_schema, target_table, target_column"
_LINK_EDGE = ("sch AS source_schema, tbl AS source_table, col AS source_column, tsch AS target_schema, "
              "ttbl AS target_table, tcol AS target_column")
_COMPARED = f"""compared AS (
  SELECT {EDGE}, CASE WHEN i = 0 THEN 'missed' WHEN d = 0 THEN 'false_positive' ELSE 'matched' END AS status
  FROM (SELECT {EDGE}, max(d) AS d, max(i) AS i FROM (
    SELECT *, 1 AS d, 0 AS i FROM declared UNION ALL SELECT *, 0, 1 FROM rel_inf) GROUP BY ALL))"""
_GRAPH = """nodepairs AS (
  SELECT DISTINCT source_schema || '.' || source_table AS a, target_schema || '.' || target_table AS b FROM rel
  UNION SELECT DISTINCT target_schema || '.' || target_table, source_schema || '.' || source_table FROM rel),
reach AS (SELECT sch || '.' || tbl AS start, sch || '.' || tbl AS node FROM tabs
  UNION SELECT r.start, e.b FROM reach r JOIN nodepairs e ON e.a = r.node),
comp AS (SELECT start, count(*) AS size, min(node) AS label FROM reach GROUP BY start)"""
_OTHER = """other_tabs AS (
  SELECT sch, tbl FROM tabs WHERE NOT (tbl = 'pages' AND k % 4 = 1)
  UNION ALL SELECT s, 'audit_log' FROM t WHERE k % 4 = 2),
oslot AS (
  SELECT k, p, sch, tbl, CASE WHEN k % 17 = 0 THEN false WHEN k % 19 = 0 THEN true ELSE filled END AS filled,
         descr || CASE WHEN k % 9 = 0 THEN ' v2' ELSE '' END AS descr,
         grain || CASE WHEN k % 13 = 0 THEN ' v2' ELSE '' END AS grain,
         CASE WHEN k % 8 = 0 THEN list_append(hints, 'extra') ELSE hints END AS hints, conf FROM slot),
tchange AS (
  SELECT 'table_added' AS change_type, sch, tbl FROM (SELECT sch, tbl FROM tabs EXCEPT SELECT sch, tbl FROM other_tabs)
  UNION ALL SELECT 'table_removed', sch, tbl FROM (SELECT sch, tbl FROM other_tabs EXCEPT SELECT sch, tbl FROM tabs)),
rchange AS (
  SELECT 'relationship_added' AS change_type, r.* FROM rel r ANTI JOIN rel30 o USING (""" + EDGE + """)
  UNION ALL SELECT 'relationship_removed', o.* FROM rel30 o ANTI JOIN rel r USING (""" + EDGE + """)),
dpair AS (
  SELECT coalesce(c.sch, o.sch) AS sch, coalesce(c.tbl, o.tbl) AS tbl, c.sch IS NOT NULL AS cur, o.sch IS NOT NULL AS oth,
         c.descr AS cd, o.descr AS od, c.grain AS cg, o.grain AS og, c.hints AS ch, o.hints AS oh, c.conf AS cc, o.conf AS oc
  FROM (SELECT * FROM slot WHERE filled) c FULL JOIN (SELECT * FROM oslot WHERE filled) o
    ON c.sch = o.sch AND c.tbl = o.tbl),
dchange AS (
  SELECT *, list_sort(list_filter(ch, lambda x: NOT list_contains(oh, x))) AS hadd,
         list_sort(list_filter(oh, lambda x: NOT list_contains(ch, x))) AS hrem FROM dpair),
changes AS (
  SELECT change_type, sch, tbl, NULL AS source_column, NULL AS target_schema, NULL AS target_table,
         NULL AS target_column, NULL AS kind, CAST(NULL AS BOOLEAN) AS text_changed, CAST(NULL AS BOOLEAN) AS grain_changed,
         CAST(NULL AS DOUBLE) AS confidence_delta, CAST(NULL AS VARCHAR) AS hints_added,
         CAST(NULL AS VARCHAR) AS hints_removed FROM tchange
  UNION ALL SELECT change_type, source_schema, source_table, source_column, target_schema, target_table,
         target_column, kind, NULL, NULL, NULL, NULL, NULL FROM rchange
  UNION ALL SELECT CASE WHEN NOT oth THEN 'description_added' ELSE 'description_removed' END, sch, tbl,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dchange WHERE NOT (cur AND oth)
  UNION ALL SELECT 'description_changed', sch, tbl, NULL, NULL, NULL, NULL, NULL, cd <> od, cg <> og,
         round(cc - oc, 6), array_to_string(hadd, '|'), array_to_string(hrem, '|') FROM dchange
    WHERE cur AND oth AND (cd <> od OR cg <> og OR cc - oc <> 0 OR len(hadd) > 0 OR len(hrem) > 0))"""
_PREV = """prev AS (
  SELECT sch, tbl, ord, col, CASE WHEN k % 10 = 3 AND typ = 'int' THEN 'smallint' ELSE typ END AS typ, is_pk, k
  FROM lay WHERE NOT (k % 6 = 0 AND col = 'url')
  UNION ALL SELECT s, 'orders', 7, 'clerk', 'string', false, k FROM t WHERE k % 8 = 0)"""


def _prints(name: str, source: str) -> str:
    return (f"{name} AS (SELECT sch, tbl, sha256(sha256(string_agg('{{\"column\":\"' || col || '\",\"data_type\":\"' || typ || '\",\"nullable\":' "
            f"|| (NOT is_pk)::VARCHAR || ',\"is_primary_key\":' || is_pk::VARCHAR || '}}', chr(10) ORDER BY ord))) AS fp FROM {source} GROUP BY sch, tbl)")


def _connections() -> str:
    """Log lines from their parts: the label and the passwords are known, nothing is parsed."""
    return """WITH parts AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS c, o_orderkey AS k,
    CASE WHEN o_orderkey % 4 = 0 THEN 'postgresql' WHEN o_orderkey % 4 = 1 THEN 'snowflake' ELSE 'duckdb' END AS scheme,
    CASE WHEN o_orderkey % 5 = 0 THEN ':5432' ELSE '' END AS port,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '/' ELSE '/db' || (o_orderkey % 10) END AS path,
    CASE o_orderkey % 11 WHEN 0 THEN 'word' WHEN 1 THEN 'bare' WHEN 2 THEN 'none' ELSE 'full' END AS form FROM orders),
labels_ AS (SELECT *, CASE form WHEN 'bare' THEN 'host' || c || port || CASE WHEN path = '/' THEN '' ELSE path END
    WHEN 'full' THEN 'user' || c || '@host' || (k % 9) || '.example.com' || port
      || CASE WHEN path = '/' THEN '' ELSE path END ELSE 'unknown' END AS label FROM parts)"""


def _host_label(url: str) -> str:
    host_port = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return (f"CASE WHEN {host_port} = '' THEN 'unknown' ELSE lower({host_port}) || "
            f"CASE WHEN {path} = '/' THEN '' ELSE {path} END END")


def _catalog(select: str, *ctes: str) -> str:
    extra = "".join(c if c.startswith(",") else ", " + c for c in ctes)
    return CATALOG + extra + "\n" + select


ORACLE: dict[str, str] = {
    "s1_discover_columns": _catalog(f"""SELECT l.sch AS "schema", l.tbl AS "table", ord AS ordinal, col AS "column",
        typ AS data_type, NOT is_pk AS nullable, is_pk AS is_primary_key, row_count
        FROM lay l JOIN info i ON i.sch = l.sch AND i.tbl = l.tbl AND i.table_type = 'BASE TABLE'
        JOIN counted c ON c.sch = l.sch AND c.tbl = l.tbl"""),
    "s2_snapshot": f"WITH c(\"table\", ordinal, \"column\") AS ({_values([(t, o, c) for t, o, c, _ in REAL_COLUMNS])}), n AS ("
                   + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in REAL)
                   + ") SELECT c.*, row_count FROM c JOIN n USING (\"table\")",
    "s3_list_schemas": _catalog("SELECT s AS \"schema\" FROM t UNION SELECT 'pgx' || k FROM t"),
    "s4_schema_scope": _catalog(f"SELECT {KEY}, table_type FROM info"),
    "s5_foreign_key_pairs": _catalog(
        f"SELECT {_LINK_EDGE}, cname AS constraint_name, ord AS ordinal FROM links WHERE tsch IS NOT NULL"),
    "s6_cross_database": _catalog(f"""SELECT {_LINK_EDGE}, cat AS target_database,
        coalesce(cat <> 'MAIN', false) OR tsch IS NULL AS dropped FROM (SELECT *, CASE WHEN k % 11 = 0 THEN NULL
        WHEN k % 6 = 0 THEN 'OTHER' ELSE 'MAIN' END AS cat FROM links)"""),
    "s6_cross_dataset": _catalog(f"""SELECT {_LINK_EDGE}, CASE WHEN tsch IS NULL THEN 'skipped'
        WHEN tsch <> sch THEN 'dropped' ELSE 'kept' END AS status FROM links"""),
    "s7_constraint_feed": _catalog(f"""SELECT 'FOREIGN KEY' AS constraint_type, {_LINK_EDGE},
        cname AS constraint_name, ord AS ordinal FROM links
        UNION ALL SELECT 'PRIMARY KEY', sch, tbl, col, NULL, NULL, NULL, tbl || '_pk', in_key FROM lay WHERE is_pk
        UNION ALL SELECT 'PRIMARY KEY', 'archive', 'users', 'user_id', NULL, NULL, NULL, 'users_pk', 1 FROM t WHERE k = 0"""),
    "s8_without_constraints": _catalog("""SELECT l.sch AS "schema", l.tbl AS "table", ord AS ordinal, col AS "column",
        typ AS data_type, NOT is_pk AS nullable, false AS is_primary_key, CAST(NULL AS BIGINT) AS row_count
        FROM lay l JOIN info i ON i.sch = l.sch AND i.tbl = l.tbl AND i.table_type = 'BASE TABLE'"""),
    "a6_fold_tables": _catalog("""SELECT l.sch AS "schema", l.tbl AS "table", 0 AS page, count(*) AS n_columns,
        max(row_count) AS row_count, string_agg(col || ' ' || typ, ', ' ORDER BY ord) AS listed
        FROM lay l JOIN info i ON i.sch = l.sch AND i.tbl = l.tbl AND i.table_type = 'BASE TABLE'
        JOIN counted c ON c.sch = l.sch AND c.tbl = l.tbl GROUP BY l.sch, l.tbl"""),
    "p3_dotted": _catalog("""SELECT sch AS "schema", tbl || CASE WHEN k % 12 = 0 THEN '.bak' ELSE '' END AS "table",
        k % 12 = 0 AS rejected FROM tabs"""),
    "p11_known_counts": _catalog(f"SELECT {KEY}, row_count FROM counted"),
    "a1_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in REAL),
    "a2_key_profile": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {o} AS ordinal, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS n_distinct, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"
        for t, o, c, _ in REAL_COLUMNS),
    "a2_choose_keys": _real_keys() + ' SELECT tbl AS "table", ord AS ordinal, col AS "column" FROM real_keys',
    "a2_discover_keys": _real_keys() + ' SELECT tbl AS "table", ord AS ordinal, col AS "column" FROM real_keys',
    "a5_pii_evidence": f"SELECT tbl AS \"table\", col AS \"column\", kind, filled, matched FROM ({_evidence()})",
    "p5_null_compaction": " UNION ALL ".join(
        [f"SELECT '{t}' AS \"table\", {o} AS ordinal, '{c}' AS \"column\", count({c}) > 0 OR count(*) = 0 AS keep FROM {t}"
         for t, o, c, _ in REAL_COLUMNS]
        + ["SELECT 'orders', 7, 'o_note', count(*) = 0 FROM orders",
           "SELECT 'events', 7, 'big', count(CASE WHEN value > 1e12 THEN value END) > 0 OR count(*) = 0 FROM events"]),
    "p12_classify_columns": _catalog(
        f"SELECT {KEY}, col AS \"column\", {_semantic('col', 'typ', 'is_pk')} AS semantic_type, "
        f"{_risk('tbl', 'col')} AS pii_risk FROM lay"),
    "p12_classify_real_columns": _real_keys() + f""", evidence AS ({_evidence()}),
seen AS (SELECT tbl, col, max(CASE WHEN kind = 'ipv4' THEN 2 ELSE 3 END) AS lvl FROM evidence
  WHERE filled > 0 AND matched / CAST(filled AS DOUBLE) >= {EVIDENCE_SHARE} GROUP BY tbl, col),
named AS (SELECT *, {_risk("tbl", "col")} AS risk, CASE fam WHEN 'i' THEN 'bigint' WHEN 'f' THEN 'double'
  WHEN 's' THEN 'string' WHEN 't' THEN 'timestamp_ntz' ELSE 'array' END AS typ FROM marked)
SELECT n.tbl AS "table", n.col AS "column", {_semantic("n.col", "typ", "is_pk")} AS semantic_type,
  (['none', 'low', 'medium', 'high'])[greatest(list_position(['none', 'low', 'medium', 'high'], risk),
    coalesce(lvl, 0) + 1)] AS pii_risk
FROM named n LEFT JOIN seen s ON s.tbl = n.tbl AND s.col = n.col""",
    "j3_profiled_tables": _real_keys() + """, rpk AS (SELECT tbl, min(nm) AS nm, min(col) AS col FROM marked WHERE is_pk
  GROUP BY tbl HAVING count(*) = 1),
rpress AS (SELECT p.nm, count(*) AS n FROM marked c JOIN (SELECT DISTINCT nm FROM rpk) p
  ON NOT c.is_pk AND (c.nm = p.nm OR ends_with(c.nm, '_' || p.nm)) GROUP BY p.nm),
rcand AS (SELECT DISTINCT c.tbl, c.col, p.tbl AS ttbl, p.col AS tcol FROM marked c JOIN rpk p ON NOT c.is_pk
  AND (c.nm = p.nm OR (ends_with(c.nm, '_' || p.nm) AND c.tbl <> p.tbl))
  WHERE p.nm NOT IN (SELECT nm FROM rpress WHERE n > 15))
SELECT 'main' AS source_schema, tbl AS source_table, col AS source_column, 'main' AS target_schema,
  min(ttbl) AS target_table, min(tcol) AS target_column, 'inferred' AS kind
FROM rcand GROUP BY tbl, col HAVING count(*) = 1""",
    "j3_map_relationships": _catalog(f"SELECT {EDGE}, kind FROM rel"),
    "j1_direct_matches": _catalog("""SELECT sch AS "schema", tbl AS "table", col AS "column", pk AS "key",
        CAST(least(count(*), 2) AS INTEGER) AS targets FROM rel_cand WHERE col = pk GROUP BY sch, tbl, col, pk"""),
    "j2_role_matches": _catalog("""SELECT sch AS "schema", tbl AS "table", col AS "column", pk AS "key",
        CAST(least(count(*), 2) AS INTEGER) AS targets FROM rel_cand WHERE col <> pk GROUP BY sch, tbl, col, pk"""),
    "j5_catch_all_keys": _catalog('SELECT sch AS "schema", pk AS "key", n FROM press WHERE n > 15'),
    "a3_single_pks": _catalog('SELECT sch AS "schema", pk AS "key", ttbl AS target_table FROM pk'),
    "a4_match_pressure": _catalog('SELECT sch AS "schema", pk AS "key", n FROM press'),
    "w4_ambiguous_candidates": _catalog("""SELECT sch AS source_schema, tbl AS source_table, col AS source_column,
        sch AS target_schema, target AS target_table, 'doc_id' AS target_column
        FROM lay, (VALUES ('documents'), ('documents_old')) v(target)
        WHERE k % 2 = 0 AND ((tbl = 'labels' AND col = 'doc_id') OR (tbl = 'review' AND col = 'source_doc_id'))"""),
    "e1_containment": " UNION ALL ".join(
        f"SELECT 'main' AS source_schema, '{st}' AS source_table, '{sc}' AS source_column, 'main' AS target_schema, "
        f"'{tt}' AS target_table, '{tc}' AS target_column, count(*) AS n_values, "
        f"count(*) FILTER (WHERE v IN (SELECT {tc} FROM {tt})) AS n_found, "
        f"round(count(*) FILTER (WHERE v IN (SELECT {tc} FROM {tt})) / CAST(count(*) AS DOUBLE), 6) AS containment "
        f"FROM (SELECT DISTINCT {sc} AS v FROM {st} WHERE {sc} IS NOT NULL)"
        for st, sc, tt, tc in [
            ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
            ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_suppkey", "supplier", "s_suppkey")]),
    "e1_overlap_tiebreak": """WITH v AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL),
pairs AS (
  SELECT 'customer' AS target_table, count(*) AS n_values,
         count(*) FILTER (WHERE v IN (SELECT c_custkey FROM customer)) AS n_found FROM v
  UNION ALL SELECT 'customer_old', count(*),
         count(*) FILTER (WHERE v IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) FROM v),
good AS (SELECT *, n_found / CAST(n_values AS DOUBLE) AS share FROM pairs WHERE n_found / CAST(n_values AS DOUBLE) >= 0.5)
SELECT 'main' AS source_schema, 'orders' AS source_table, 'o_custkey' AS source_column, 'main' AS target_schema,
  target_table, 'c_custkey' AS target_column, n_values, n_found, round(share, 6) AS containment FROM good
WHERE share = (SELECT max(share) FROM good) AND (SELECT count(*) FROM good WHERE share = (SELECT max(share) FROM good)) = 1""",
    "p9_discover": _catalog(f"SELECT {KEY}, row_count FROM counted"),
    # Every value follows from the tenant and the layout: one projection, no join.
    "j6_describe": _catalog("""SELECT sch AS "schema", tbl AS "table", ord AS ordinal, col AS "column",
        typ AS data_type, is_pk AS is_primary_key, CASE WHEN filled THEN 'The ' || col END AS description,
        CASE WHEN filled THEN sem END AS semantic_type, CASE WHEN filled THEN risk END AS pii_risk,
        CASE WHEN filled THEN round(CAST(0.4 AS DOUBLE) + CAST(ord % 6 AS DOUBLE) / 10, 6) END AS confidence,
        CAST(CASE WHEN k % 5 = 2 THEN 0 WHEN k % 5 IN (3, 4) THEN k * 10 + p END AS BIGINT) AS row_count,
        CASE WHEN filled THEN 'Rows about ' || tbl END AS table_description,
        CASE WHEN filled THEN 'one row per ' || tbl END AS grain,
        CASE WHEN filled THEN CASE WHEN k % 2 = 1 THEN 'sales|' || tbl ELSE tbl || '|sales' END END AS domain_hints,
        CASE WHEN filled THEN round(CAST(0.5 AS DOUBLE) + CAST(k % 50 AS DOUBLE) / 100, 6) END AS table_confidence
        FROM (SELECT t.k, t.s AS sch, b.*, (t.k + b.p) % 7 <> 0 AS filled FROM t, (
          SELECT *, """ + _semantic("col", "typ", "is_pk") + """ AS sem, """ + _risk("tbl", "col") + """ AS risk FROM base) b
          WHERE tbl <> 'attrs' OR k % 3 = 0)"""),
    "j7_incident": _catalog(f"""SELECT t.sch AS "schema", t.tbl AS "table", {EDGE}, kind FROM tabs t JOIN rel r
        ON (r.source_schema = t.sch AND r.source_table = t.tbl)
        UNION ALL SELECT t.sch, t.tbl, {EDGE}, kind FROM tabs t JOIN rel r
        ON r.target_schema = t.sch AND r.target_table = t.tbl
        WHERE NOT (r.source_schema = t.sch AND r.source_table = t.tbl)"""),
    "r1_search": _catalog("""SELECT query_id, CAST(rnk AS INTEGER) AS rank, sch AS "schema", tbl AS "table",
        (['table_name', 'column_name', 'description_body'])[tier + 1] AS match_type FROM ranked"""),
    "s9_sample": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 20""",
    "p2_coerce": """WITH rows_ AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS w, o_totalprice AS amount FROM orders
  UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), value FROM events)
SELECT id, strftime(w, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(w) % 1000000 <> 0
    THEN '.' || lpad(CAST(microsecond(w) % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS "at",
  strftime(w, '%Y-%m-%d') AS day, CAST(CAST(amount AS DECIMAL(14,2)) AS DOUBLE) AS amount, '<binary>' AS raw FROM rows_""",
    "p4_redacted_sample": """SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "j9_adjudicate": _catalog("""SELECT request_id, 'sample' AS tool, sch AS "schema", name AS "table", outcome,
        asked AS limit_requested, CASE WHEN outcome = 'ok' THEN asked END AS limit_effective,
        CASE WHEN outcome = 'ok' AND row_count IS NOT NULL THEN least(row_count, asked) END AS rows_returned
        FROM (SELECT *, CASE WHEN asked < 1 THEN 'rejected_invalid_limit' WHEN asked > 20 THEN 'rejected_cap'
          WHEN k % 12 = 0 THEN 'rejected_unknown_table' ELSE 'ok' END AS outcome FROM (
          SELECT k, k * 100 + p AS request_id, sch, tbl || CASE WHEN k % 12 = 0 THEN '_x' ELSE '' END AS name, row_count,
            coalesce(([NULL, 1, 5, 20, 21, 0, -3])[k % 7 + 1], 5) AS asked FROM counted))"""),
    "a7_quality": _catalog("""SELECT count(*) AS table_count, count(*) FILTER (WHERE linked) AS tables_with_relationships,
        count(*) FILTER (WHERE NOT linked) AS orphan_count, count(*) FILTER (WHERE filled) AS description_present,
        count(*) FILTER (WHERE NOT filled) AS description_null, (SELECT count(*) FROM rel) AS relationship_count,
        round(count(*) FILTER (WHERE filled) / CAST(count(*) AS DOUBLE), 6) AS description_coverage,
        round(count(*) FILTER (WHERE linked) / CAST(count(*) AS DOUBLE), 6) AS relationship_coverage
        FROM (SELECT *, (sch, tbl) IN (SELECT (sch, tbl) FROM ends) AS linked FROM slot)"""),
    "a8_orphans": _catalog(f"SELECT {KEY} FROM tabs WHERE (sch, tbl) NOT IN (SELECT (sch, tbl) FROM ends)"),
    "a8_incident_counts": _catalog("""SELECT t.sch AS "schema", t.tbl AS "table", count(e.sch) AS incident
        FROM tabs t LEFT JOIN ends e ON e.sch = t.sch AND e.tbl = t.tbl GROUP BY t.sch, t.tbl"""),
    "a9_pii_distribution": _catalog("""SELECT r AS pii_risk, count(d.risk) AS n FROM (VALUES ('none'), ('low'), ('medium'),
        ('high')) v(r) LEFT JOIN cdesc d ON d.risk = v.r GROUP BY r"""),
    "a10_confidence": _catalog("""SELECT 'table' AS level, round(avg(conf), 6) AS mean, round(min(conf), 6) AS minimum,
        round(max(conf), 6) AS maximum, count(*) AS n FROM slot WHERE filled
        UNION ALL SELECT 'column', round(avg(conf), 6), round(min(conf), 6), round(max(conf), 6), count(*) FROM cdesc"""),
    "o1_edge_status": _catalog(f"SELECT {EDGE}, status FROM compared", _COMPARED),
    "a11_edge_prf": _catalog("""SELECT d AS declared_count, i AS inferred_count, m AS matched_count,
        round(CASE WHEN d > 0 THEN m / CAST(d AS DOUBLE) END, 6) AS recall,
        round(CASE WHEN i > 0 THEN m / CAST(i AS DOUBLE) END, 6) AS precision,
        round(CASE WHEN m > 0 THEN 2 * (m / CAST(d AS DOUBLE)) * (m / CAST(i AS DOUBLE))
          / (m / CAST(d AS DOUBLE) + m / CAST(i AS DOUBLE)) END, 6) AS f1
        FROM (SELECT count(*) FILTER (WHERE status <> 'false_positive') AS d, count(*) FILTER (WHERE status <> 'missed') AS i,
          count(*) FILTER (WHERE status = 'matched') AS m FROM compared)""", _COMPARED),
    "a12_breakdown": _catalog("""SELECT source_schema AS "schema", source_table AS "table",
        count(*) FILTER (WHERE status <> 'false_positive') AS declared,
        count(*) FILTER (WHERE status = 'matched') AS inferred_correct, count(*) FILTER (WHERE status = 'missed') AS missed,
        count(*) FILTER (WHERE status = 'false_positive') AS false_positive
        FROM compared GROUP BY source_schema, source_table""", _COMPARED),
    "a13_search_metrics": _catalog("""SELECT query_id, query, returned, expected, hits, round(prec, 6) AS precision,
        round(rec, 6) AS recall, round(rr, 6) AS reciprocal_rank FROM metrics"""),
    "a13_search_summary": _catalog("""SELECT count(*) AS query_count, round(avg(rr), 6) AS mean_reciprocal_rank,
        round(avg(prec), 6) AS mean_precision, round(avg(rec), 6) AS mean_recall FROM metrics"""),
    "o2_table_changes": _catalog(f"SELECT change_type, {KEY} FROM tchange", _OTHER),
    "o3_diff": _catalog(f"SELECT change_type, {KEY}, * EXCLUDE (change_type, sch, tbl) FROM changes", _OTHER),
    "o3_diff_counts": _catalog("SELECT change_type, count(*) AS n FROM changes GROUP BY change_type", _OTHER),
    "w1_round_robin": _catalog("""SELECT sch AS "schema", tbl AS "table", CAST(rn AS INTEGER) AS round,
        CAST(row_number() OVER (ORDER BY rn, sch) AS INTEGER) AS position FROM (
        SELECT sch, tbl, row_number() OVER (PARTITION BY sch ORDER BY tbl) AS rn FROM slot WHERE filled)
        ORDER BY rn, sch LIMIT 500"""),
    "w1_round_robin_all": _catalog("""SELECT sch AS "schema", tbl AS "table",
        CAST(row_number() OVER (PARTITION BY sch ORDER BY tbl) AS INTEGER) AS round FROM slot WHERE filled"""),
    "g1_components": _catalog("""SELECT sch AS "schema", tbl AS "table", size AS component_size
        FROM tabs JOIN comp ON start = sch || '.' || tbl""", _GRAPH),
    "a16_graph_summary": _catalog("""SELECT count(DISTINCT label) AS components, max(size) AS largest_component_size,
        round(max(size) / CAST(count(*) AS DOUBLE), 6) AS largest_component_fraction,
        round(avg(size), 6) AS mean_reachable FROM comp""", _GRAPH),
    "u2_prompts": _catalog(f"SELECT {KEY}, 0 AS part, n AS n_columns, n >= 30 AS is_wide, prompt FROM prompts", _prompt()),
    "u3_parse_descriptions": _catalog(f"""SELECT {KEY}, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status,
        reason, CASE WHEN reason IS NOT NULL THEN left(raw, 500) END AS raw_start FROM a_verdict""",
                                      _parsed("a", "first_answer")),
    "u3_parsed_tables": _catalog(f"""SELECT {KEY}, json_extract_string(doc, '$.description') AS description,
        json_extract_string(doc, '$.grain') AS grain,
        array_to_string(CAST(json_extract(doc, '$.domain_hints') AS VARCHAR[]), '|') AS domain_hints,
        CAST(json_extract_string(doc, '$.confidence') AS DOUBLE) AS confidence FROM a_verdict WHERE reason IS NULL""",
                                 _parsed("a", "first_answer")),
    "u3_parsed_columns": _catalog("""SELECT i.sch AS "schema", i.tbl AS "table", i.col AS "column",
        json_extract_string(item, '$.description') AS description, json_extract_string(item, '$.semantic_type') AS semantic_type,
        json_extract_string(item, '$.pii_risk') AS pii_risk, CAST(json_extract_string(item, '$.confidence') AS DOUBLE)
        AS confidence FROM a_items i JOIN a_verdict v ON v.sch = i.sch AND v.tbl = i.tbl WHERE v.reason IS NULL""",
                                  _parsed("a", "first_answer")),
    "u4_retry_outcomes": _catalog("""SELECT a.sch AS "schema", a.tbl AS "table", CASE WHEN a.reason IS NULL THEN 'ok'
        WHEN b.reason IS NULL THEN 'parse_retry' ELSE 'failed' END AS event,
        CASE WHEN a.reason IS NOT NULL THEN b.reason END AS error_reason
        FROM a_verdict a JOIN b_verdict b ON b.sch = a.sch AND b.tbl = a.tbl""",
                                  _parsed("a", "first_answer"), _parsed("b", "second_answer")),
    "u1_generate": _catalog("""SELECT sch AS "schema", tbl AS "table", 'ok' AS outcome, 1 AS attempts,
        CAST(length('{"description":"Rows about ' || tbl || '","grain":"one row per ' || tbl || '","domain_hints":["' || tbl
          || '"],"columns":[' || string_agg('{"name":"' || col || '","description":"The ' || col || '","semantic_type":"'
          || CASE WHEN is_pk THEN 'identifier' ELSE 'other' END || '","pii_risk":"none","confidence":0.5}', ',' ORDER BY ord)
          || '],"confidence":0.5}') AS INTEGER) AS answer_length FROM lay GROUP BY sch, tbl"""),
    "u5_judge_prompts": _catalog(f"""SELECT s.sch AS "schema", s.tbl AS "table", {lit(judge.INSTRUCTIONS)} || chr(10)
        || chr(10) || 'Table: ' || s.sch || '.' || s.tbl || chr(10) || 'Schema:' || chr(10) || p.lines || chr(10)
        || 'Description (JSON):' || chr(10) || '{{"description":"' || s.descr || '","grain":"' || s.grain
        || '","domain_hints":["' || array_to_string(s.hints, '","') || '"],"columns":[' || d.cols || ']}}' || chr(10)
        || {lit(judge.ANSWER_SHAPE)} AS prompt
        FROM slot s JOIN prompts p ON p.sch = s.sch AND p.tbl = s.tbl JOIN (
          SELECT sch, tbl, string_agg('{{"name":"' || col || '","description":"' || descr || '","semantic_type":"' || sem
            || '","pii_risk":"' || risk || '"}}', ',' ORDER BY ord) AS cols FROM cdesc GROUP BY sch, tbl) d
        ON d.sch = s.sch AND d.tbl = s.tbl WHERE s.filled""", _prompt()),
    "u6_parse_scores": _catalog(f"SELECT {KEY}, * EXCLUDE (k, p, sch, tbl) FROM scores", SCORES),
    "a14_judge_summary": _catalog("""SELECT count(*) FILTER (WHERE status = 'ok') AS scored_count,
        count(*) FILTER (WHERE status <> 'ok') AS total_judge_failures,
        count(*) FILTER (WHERE status = 'ok' AND least(accuracy, specificity, domain_inference) < 3) AS flagged_count,
        (SELECT count(*) FROM slot WHERE NOT filled) AS skipped_null, """
                                  + ", ".join(f"round(coalesce(avg({d}), 0), 6) AS mean_{d}" for d in judge.DIMENSIONS)
                                  + " FROM scores", SCORES),
    "a14_flagged": _catalog(f"""SELECT {KEY}, accuracy, specificity, domain_inference FROM scores
        WHERE least(accuracy, specificity, domain_inference) < 3""", SCORES),
    "u8_prompt_hash": _catalog(f"""SELECT {KEY}, sha256(prompt) AS prompt_hash,
        sha256({lit(enrich.prompt_version())}) AS template_hash FROM prompts""", _prompt()),
    "a15_scan_summary": _catalog("""SELECT count(DISTINCT sch) AS schema_count, count(*) AS total,
        count(*) FILTER (WHERE event IN ('ok', 'parse_retry')) AS ok,
        count(*) FILTER (WHERE event = 'parse_retry') AS ok_after_retry,
        count(*) FILTER (WHERE event IN ('failed', 'provider_error')) AS failed,
        count(*) FILTER (WHERE event = 'provider_error') AS provider_errors FROM outcome"""),
    "a15_failed_tables": _catalog(f"""SELECT {KEY}, CASE event WHEN 'failed' THEN 'bad_json' ELSE 'timeout' END AS error_reason
        FROM outcome WHERE event IN ('failed', 'provider_error')"""),
    "s12_integrity": _catalog("""SELECT 'missing_description' AS problem, s AS "schema", 'region' AS "table" FROM t
        WHERE k % 50 = 0 UNION ALL SELECT 'orphan_description', s, 'ghost' FROM t WHERE k % 40 = 0"""),
    "s13_key_codec": _catalog("""SELECT k, p, CASE k % 6 WHEN 0 THEN tbl WHEN 1 THEN '.' || tbl WHEN 2 THEN sch || '.'
        WHEN 3 THEN sch || '.a.' || tbl ELSE sch || '.' || tbl END AS "key",
        CASE WHEN k % 6 < 3 THEN 'malformed' WHEN k % 6 = 3 THEN 'dotted_table' ELSE 'ok' END AS status,
        CASE WHEN k % 6 > 3 THEN sch END AS "schema", CASE WHEN k % 6 > 3 THEN tbl END AS "table" FROM tabs"""),
    "a17_bundle_counts": _catalog("""SELECT 'tables' AS what, count(*) AS n FROM tabs
        UNION ALL SELECT 'descriptions_present', count(*) FROM slot WHERE filled
        UNION ALL SELECT 'descriptions_null', count(*) FROM slot WHERE NOT filled
        UNION ALL SELECT 'relationships', count(*) FROM rel"""),
    "p7_scrub": _connections() + """ SELECT id, 'connect to ' || CASE form WHEN 'word' THEN scheme WHEN 'none' THEN ''
        ELSE label END || ' failed: password ''' || CASE WHEN form = 'full' AND k % 3 = 0 THEN '***' ELSE 'p@ss' || c END
        || ''' or ''' || CASE WHEN form = 'full' AND k % 3 <> 0 THEN '***' ELSE 'pw' || c || 'x' END
        || ''' rejected by snowflake.errors; see ftp://bob:***@files/x' AS message FROM labels_""",
    "p7_scrub_documents": r"SELECT doc_id, md5(regexp_replace(text, '(://[^:/@[:space:]]*):[^[:space:]]+@', '\1:***@', 'g')) AS text_md5 FROM documents",
    "p8_connection_label": _connections() + " SELECT id, label FROM labels_",
    "p8_page_label": f"SELECT page_id, {_host_label('url')} AS label FROM pages",
    "s15_envelope": _catalog("""SELECT 'quality' AS mode, 'tenants' AS bundle, 'metrics' AS section,
        '{"pii_risk":"' || r || '","n":' || n || '}' AS payload FROM (SELECT r, count(d.risk) AS n FROM (VALUES ('none'),
        ('low'), ('medium'), ('high')) v(r) LEFT JOIN cdesc d ON d.risk = v.r GROUP BY r)
        UNION ALL SELECT 'quality', 'tenants', 'orphan_table', '{"schema":"' || sch || '","table":"' || tbl || '"}'
        FROM tabs WHERE (sch, tbl) NOT IN (SELECT (sch, tbl) FROM ends)"""),
    "s14_artifact": _catalog(f"""SELECT 'descriptions' AS mode, 'tenants' AS bundle, 'run' AS section,
        '{{"schema_version":1,"run_timestamp":"2024-01-01T00:00:00Z","bundle":"tenants","generator_model":null,'
        || '"judge_model":"offline","prompt_version_hash":"' || sha256({lit(enrich.prompt_version())})
        || '","metrics":{{"scored_count":' || count(*) FILTER (WHERE status = 'ok') || ',"total_judge_failures":'
        || count(*) FILTER (WHERE status <> 'ok') || ',"flagged_count":'
        || count(*) FILTER (WHERE least(accuracy, specificity, domain_inference) < 3) || '}}}}' AS payload FROM scores
        UNION ALL SELECT 'descriptions', 'tenants', 'table', '{{"schema":"' || sch || '","table":"' || tbl || '","accuracy":'
        || accuracy || ',"specificity":' || specificity || ',"domain_inference":' || domain_inference || '}}'
        FROM scores WHERE status = 'ok'
        UNION ALL SELECT 'descriptions', 'tenants', 'evaluated', '{{"schema":"' || sch || '","table":"' || tbl || '"}}'
        FROM scores""", SCORES),
    "s17_ground_truth": _catalog("""SELECT k * 100 + p AS item_id,
        CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 <> 1 THEN tbl END AS query,
        CASE WHEN k % 9 < 2 THEN 'missing query' WHEN k % 7 < 2 THEN 'expected must be strings' END AS error FROM tabs"""),
    "e2_column_drift": _catalog("""SELECT CASE WHEN k % 6 = 0 AND col = 'url' THEN 'column_added' ELSE 'column_retyped' END
        AS change_type, sch AS "schema", tbl AS "table", col AS "column",
        CASE WHEN NOT (k % 6 = 0 AND col = 'url') THEN 'smallint' END AS old_type, typ AS new_type
        FROM lay WHERE (k % 6 = 0 AND col = 'url') OR (k % 10 = 3 AND typ = 'int')
        UNION ALL SELECT 'column_removed', s, 'orders', 'clerk', 'string', NULL FROM t WHERE k % 8 = 0"""),
    "e2_table_drift": _catalog("""SELECT CASE WHEN o.sch IS NULL THEN 'table_added' ELSE 'row_count_changed' END AS change_type,
        n.sch AS "schema", n.tbl AS "table", o.c AS old_count, n.row_count AS new_count,
        CASE WHEN o.sch IS NOT NULL THEN n.row_count - o.c END AS row_count_delta
        FROM counted n LEFT JOIN (SELECT sch, tbl, CASE WHEN k % 3 = 0 THEN k * 10 + p ELSE k END AS c FROM tabs
          WHERE NOT (k % 4 = 1 AND tbl = 'pages')) o ON o.sch = n.sch AND o.tbl = n.tbl
        WHERE o.sch IS NULL OR n.row_count <> o.c"""),
    "e3_fingerprints": _catalog(f"SELECT {KEY}, fp AS fingerprint FROM fps", _prints("fps", "lay")),
    "e3_incremental": _catalog("""SELECT n.sch AS "schema", n.tbl AS "table", CASE WHEN o.sch IS NULL THEN 'new_table'
        WHEN o.fp <> n.fp THEN 'columns_changed' WHEN n.k % 9 = 0 THEN 'model_changed' ELSE 'prompt_changed' END AS reason
        FROM (SELECT f.*, CAST(substr(sch, 2) AS BIGINT) AS k FROM fps f) n LEFT JOIN (
          SELECT * FROM ofps WHERE NOT (CAST(substr(sch, 2) AS BIGINT) % 5 = 4 AND tbl = 'part')) o
        ON o.sch = n.sch AND o.tbl = n.tbl WHERE o.sch IS NULL OR o.fp <> n.fp OR n.k % 9 = 0 OR n.k % 13 = 0""",
                               _prints("fps", "lay"), _PREV, _prints("ofps", "prev")),
    "e4_score_delta": _catalog("""SELECT a.sch AS "schema", a.tbl AS "table", a.s - b.s AS accuracy_delta,
        0 AS specificity_delta, a.s - b.s AS domain_inference_delta FROM (SELECT sch, tbl, accuracy AS s FROM scores
        WHERE status = 'ok') a JOIN (SELECT sch, tbl, CAST(CASE (k + 1) % 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 4
          ELSE 1 + (k + 1 + p) % 5 END AS INTEGER) AS s FROM tabs WHERE (k + 1) % 6 <> 5) b
        ON b.sch = a.sch AND b.tbl = a.tbl""", SCORES),
}
