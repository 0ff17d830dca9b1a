"""DuckDB SQL that gives the same rows as ``plans.queries``.

Parts (``p``) and orders (``o``) stand for blocks and sources until the last step,
which names them by their hashes.
"""

from __future__ import annotations

from blockmatch.plans.queries import COUNT, COUNTS, RANGE, REPOSITORY
from blockmatch.plans.tables import ALL, IN_A, IN_B



def _sets(in_a: str, in_b: str) -> str:
    return f"""
    a AS (SELECT l_partkey AS p, l_orderkey AS o, least(count(*), 65535) AS n FROM lineitem WHERE {in_a} GROUP BY ALL),
    b AS (SELECT l_partkey AS p, l_orderkey AS o, least(count(*), 65535) AS n FROM lineitem WHERE {in_b} GROUP BY ALL),
    ha AS (SELECT DISTINCT p, (p * 37) % 8001 AS k_entropy, CASE WHEN p % 10 = 0 THEN 'W' ELSE '' END AS block_label FROM a),
    hb AS (SELECT DISTINCT p, (p * 37) % 8001 + 10000 AS k_entropy, CASE WHEN p % 10 = 0 THEN 'H' ELSE '' END AS block_label FROM b),
    od AS (SELECT o_orderkey AS o, CAST(floor(o_totalprice) AS BIGINT) AS filesize, o_orderstatus AS file_type, o_custkey % 5 AS zero_count, o_orderkey % 7 AS nonprobative_count FROM orders),
    sa AS (SELECT * FROM od SEMI JOIN a USING (o)),
    sb AS (SELECT * REPLACE (filesize + 1000000 AS filesize) FROM od SEMI JOIN b USING (o)),
    rp AS (SELECT o_orderkey AS o, o_orderpriority AS repo FROM orders UNION SELECT o_orderkey, 'status_' || o_orderstatus FROM orders),
    na AS (SELECT o, repo, 'order_' || o AS f FROM rp SEMI JOIN a USING (o)),
    nb AS (SELECT o, repo, 'b_order_' || o AS f FROM rp SEMI JOIN b USING (o)),
    ca AS (SELECT p, CAST(least(sum(n), 4294967295) AS BIGINT) AS c FROM a GROUP BY p)
"""


_SETS, _ONE = _sets(IN_A, IN_B), _sets(ALL, ALL)
_A_ELSE_B = "SELECT * FROM sa UNION ALL SELECT * FROM sb ANTI JOIN sa USING (o)"
_B_ELSE_A = "SELECT * FROM sb UNION ALL SELECT * FROM sa ANTI JOIN sb USING (o)"
_H_A_ELSE_B = "SELECT * FROM ha UNION ALL SELECT * FROM hb ANTI JOIN ha USING (p)"
_H_B_ELSE_A = "SELECT * FROM hb UNION ALL SELECT * FROM ha ANTI JOIN hb USING (p)"
_ALL_NAMES = "SELECT * FROM na UNION SELECT * FROM nb"


def _flat(pairs: str, hashes: str, sources: str, names: str, sets: str = _SETS, more: str = "") -> str:
    return f"""WITH {sets}{more}, r AS ({pairs}), h AS ({hashes}), s AS ({sources}),
    m AS (SELECT o, count(*) AS n_names, min(f) AS first_name FROM ({names}) GROUP BY o),
    c AS (SELECT p, CAST(least(sum(n), 4294967295) AS BIGINT) AS c FROM r GROUP BY p)
    SELECT md5(CAST(p AS VARCHAR)) AS block_hash, md5(CAST(o AS VARCHAR)) AS file_hash, n AS sub_count, k_entropy, block_label, c AS count,
           filesize, file_type, zero_count, nonprobative_count, coalesce(n_names, 0) AS n_names, first_name
    FROM r JOIN h USING (p) JOIN c USING (p) JOIN s USING (o) LEFT JOIN m USING (o)"""


_SOURCE_JSON = """(SELECT o, md5(CAST(o AS VARCHAR)) AS fh, '{"file_hash":"' || md5(CAST(o AS VARCHAR)) || '","filesize":' || filesize || ',"file_type":"' || file_type || '","zero_count":' || zero_count
    || ',"nonprobative_count":' || nonprobative_count || ',"name_pairs":[' || coalesce(names, '') || ']}' AS js
    FROM sa LEFT JOIN (SELECT o, string_agg('"' || repo || '","' || f || '"', ',' ORDER BY repo, f) AS names FROM na GROUP BY o) USING (o))"""
_PAIRS_JSON = """string_agg('"' || md5(CAST(o AS VARCHAR)) || '",' || n, ',' ORDER BY md5(CAST(o AS VARCHAR)))"""
_HEAD = """'{"block_hash":"' || md5(CAST(p AS VARCHAR)) || '"'"""
_HASH_JSON = f"""(SELECT p, md5(CAST(p AS VARCHAR)) AS bh, {_HEAD} || ',"k_entropy":' || k_entropy || ',"block_label":"' || block_label || '","source_sub_counts":[' || x || ']}}' AS js
    FROM ha JOIN (SELECT p, {_PAIRS_JSON} AS x FROM a GROUP BY p) USING (p))"""


def _expanded(shown: str, more: str = "") -> str:
    """(p, js): JSON without the list id; ``shown``: which pairs (p, o) print their source, ``more``: a join that tells."""
    return f"""(SELECT p, {_HEAD} || ',"k_entropy":' || k_entropy || ',"block_label":"' || block_label || '","count":' || c || ',"sources":[' || coalesce(s, '') || '],"source_sub_counts":[' || x || ']}}' AS js
    FROM ha JOIN ca USING (p) JOIN (SELECT p, {_PAIRS_JSON} AS x, string_agg(js, ',' ORDER BY fh) FILTER (WHERE {shown}) AS s FROM a JOIN sj USING (o) {more} GROUP BY p) USING (p))"""


_BLOCKS = """d AS (SELECT 'doc_' || doc_id AS filename, lang, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    k AS (SELECT filename, lang, x, unnest(range(0, (length(x) // 2 + 511) // 512)) * 512 AS pos FROM d),
    bl AS (SELECT filename, lang, x, pos, rpad(substr(x, 2 * pos + 1, 1024), 1024, '0') AS b FROM k),
    z AS (SELECT filename, lang, x, pos, md5(unhex(b)) AS block_hash FROM bl WHERE b <> repeat('0', 1024))"""

_APPROX = "CASE " + " ".join(f"WHEN {{c}} + 5 < {20 * 5**e} THEN (({{c}} + 5) // {5**e}) * {5**e} - 5" for e in range(12)) + " END"
_CODE = "CASE " + " ".join(f"WHEN {{c}} + 5 < {20 * 5**e} THEN {16 * e} + greatest(({{c}} + 5) // {5**e} - 4, 0)" for e in range(12)) + " END"

SQL = {
    "q_scan_list_expanded": f"""WITH {_ONE}, sj AS {_SOURCE_JSON}, e AS {_expanded("true")}
        SELECT p_partkey AS line, p_brand AS label, md5(CAST(p_partkey AS VARCHAR)) AS block_hash, js AS json FROM part JOIN e ON p = p_partkey""",
    "q_scan_optimized": f"""WITH {_ONE}, sj AS {_SOURCE_JSON},
        l AS (SELECT l_orderkey * 8 + l_linenumber AS line, l_returnflag AS label, l_partkey AS p FROM lineitem),
        f AS (SELECT p, min(line) AS first FROM l SEMI JOIN ha USING (p) GROUP BY p),
        w AS (SELECT DISTINCT ON (o) o, p AS shown FROM a JOIN f USING (p) ORDER BY o, first, md5(CAST(p AS VARCHAR))),
        e AS {_expanded("p = shown", "JOIN w USING (o)")}
        SELECT line, label, md5(CAST(p AS VARCHAR)) AS block_hash, CASE WHEN line = first THEN js ELSE {_HEAD} || '}}' END AS json
        FROM l JOIN f USING (p) JOIN e USING (p)""",
    "q_scan_count": f"""WITH {_ONE} SELECT l_orderkey * 8 + l_linenumber AS line, l_returnflag AS label, md5(CAST(p AS VARCHAR)) AS block_hash,
        {_HEAD} || ',"count":' || c || '}}' AS json FROM lineitem JOIN ca ON p = l_partkey""",
    "q_scan_approx_count": f"""WITH {_ONE}, t AS (SELECT substr(md5(CAST(p AS VARCHAR)), 1, 14) AS x, max(c) AS c FROM ca GROUP BY ALL)
        SELECT l_orderkey * 8 + l_linenumber AS line, l_returnflag AS label, md5(CAST(l_partkey AS VARCHAR)) AS block_hash,
        '{{"block_hash":"' || md5(CAST(l_partkey AS VARCHAR)) || '","approximate_count":' || {_APPROX.format(c="c")} || '}}' AS json
        FROM lineitem JOIN t ON x = substr(md5(CAST(l_partkey AS VARCHAR)), 1, 14)""",
    "q_find_hash": f"""WITH {_ONE} SELECT md5(CAST(p AS VARCHAR)) AS block_hash, k_entropy, block_label, c AS count, n_sources, '[' || x || ']' AS source_sub_counts
        FROM ha JOIN ca USING (p) JOIN (SELECT p, count(*) AS n_sources, {_PAIRS_JSON} AS x FROM a GROUP BY p) USING (p) SEMI JOIN part ON p_partkey = p""",
    "q_find_source": f"WITH {_ONE} SELECT md5(CAST(o AS VARCHAR)) AS file_hash, filesize, file_type, zero_count, nonprobative_count FROM sa",
    "q_find_names": f"WITH {_ONE} SELECT md5(CAST(o AS VARCHAR)) AS file_hash, repo AS repository_name, f AS filename FROM na",
    "q_hash_table": f"WITH {_ONE} SELECT md5(CAST(p AS VARCHAR)) AS block_hash, k_entropy, block_label, c AS count, n AS sub_count FROM a JOIN ha USING (p) JOIN ca USING (p) WHERE o = 1",
    "q_duplicates": f"WITH {_ONE} SELECT md5(CAST(p AS VARCHAR)) AS block_hash, k_entropy, block_label, c AS count FROM ha JOIN ca USING (p) WHERE c = {COUNT}",
    "q_histogram": f"WITH {_ONE} SELECT c AS duplicates, count(*) AS distinct_hashes, c * count(*) AS total FROM ca GROUP BY c",
    "q_totals": f"WITH {_ONE} SELECT CAST(sum(c) AS BIGINT) AS total_hashes, count(*) FILTER (WHERE c = 1) AS total_distinct_hashes, count(*) AS n_distinct FROM ca",
    "q_size": f"""WITH {_ONE} SELECT (SELECT CAST(sum(CASE WHEN k = 1 THEN 1 ELSE k + 1 END) AS BIGINT) FROM (SELECT count(*) AS k FROM a GROUP BY p)) AS hash_data_store,
        (SELECT count(DISTINCT substr(md5(CAST(p AS VARCHAR)), 1, 14)) FROM a) AS hash_store, (SELECT count(*) FROM sa) AS source_data_store,
        (SELECT count(*) FROM sa) AS source_id_store, (SELECT count(*) FROM na) AS source_name_store""",
    "q_sources": f"WITH {_ONE} SELECT fh AS file_hash, js AS json FROM {_SOURCE_JSON}",
    "q_add": _flat("SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN sb USING (o)", _H_B_ELSE_A, _B_ELSE_A, "SELECT * FROM nb UNION SELECT * FROM na ANTI JOIN sb USING (o)"),
    "q_add_multiple": _flat("SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (p, o)", _H_A_ELSE_B, _B_ELSE_A, _ALL_NAMES),
    "q_add_repository": _flat(f"SELECT * FROM a SEMI JOIN (SELECT o FROM na WHERE repo = '{REPOSITORY}') USING (o)", "SELECT * FROM ha", "SELECT * FROM sa", f"SELECT * FROM na WHERE repo = '{REPOSITORY}'", sets=_ONE),
    "q_subtract_repository": _flat(f"SELECT * FROM a SEMI JOIN (SELECT o FROM na WHERE repo <> '{REPOSITORY}') USING (o)", "SELECT * FROM ha", "SELECT * FROM sa", f"SELECT * FROM na WHERE repo <> '{REPOSITORY}'", sets=_ONE),
    "q_add_range": _flat(f"SELECT * FROM a SEMI JOIN (SELECT p FROM ca WHERE c BETWEEN {COUNTS[0]} AND {COUNTS[1]}) USING (p)", "SELECT * FROM ha", "SELECT * FROM sa", "SELECT * FROM na", sets=_ONE),
    "q_intersect": _flat("SELECT * FROM a SEMI JOIN b USING (p, o)", "SELECT * FROM ha", _A_ELSE_B, _ALL_NAMES),
    "q_intersect_hash": _flat("SELECT * FROM a SEMI JOIN b USING (p) UNION ALL SELECT * FROM (SELECT * FROM b ANTI JOIN a USING (p, o)) SEMI JOIN a USING (p)", "SELECT * FROM ha", _A_ELSE_B, _ALL_NAMES),
    "q_subtract": _flat("SELECT * FROM a ANTI JOIN b USING (p, o)", "SELECT * FROM ha", _A_ELSE_B, _ALL_NAMES),
    "q_subtract_hash": _flat("SELECT * FROM a ANTI JOIN b USING (p)", "SELECT * FROM ha", _A_ELSE_B, _ALL_NAMES),
    "q_repository_kinds": f"WITH {_ONE} SELECT md5(CAST(o AS VARCHAR)) AS file_hash, bool_or(repo = '{REPOSITORY}') AS in_repository, bool_or(repo <> '{REPOSITORY}') AS in_other FROM na GROUP BY o",
    "q_export_hashes": f"WITH {_ONE} SELECT bh AS block_hash, js AS json FROM {_HASH_JSON}",
    "q_export_range": f"""WITH {_ONE}, hj AS {_HASH_JSON}, sj AS {_SOURCE_JSON}, i AS (SELECT * FROM hj WHERE bh >= '{RANGE[0]}' AND bh <= '{RANGE[1]}')
        SELECT 0 AS kind, bh AS key, js AS value FROM i UNION ALL SELECT 1, fh, js FROM sj WHERE o IN (SELECT o FROM a SEMI JOIN i USING (p))""",
    "q_import_json": _flat("SELECT * FROM a", "SELECT * FROM ha", "SELECT * FROM sa", "SELECT * FROM na", sets=_ONE),
    "q_merge": _flat("SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (p, o)", _H_A_ELSE_B, _B_ELSE_A, _ALL_NAMES),
    "q_insert": _flat("SELECT p, o, CAST(least(sum(n), 65535) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p, o", _H_A_ELSE_B, _B_ELSE_A, _ALL_NAMES),
    "q_import_tab": _flat(
        "SELECT l_partkey AS p, l_orderkey AS o, least(count(*), 65535) AS n FROM lineitem GROUP BY ALL",
        "SELECT DISTINCT l_partkey AS p, 0 AS k_entropy, '' AS block_label FROM lineitem",
        "SELECT DISTINCT l_orderkey AS o, 0 AS filesize, '' AS file_type, 0 AS zero_count, 0 AS nonprobative_count FROM lineitem",
        "SELECT DISTINCT l_orderkey AS o, 'lineitem.tab' AS f FROM lineitem",
    ),
    "q_import_whitelist": _flat(
        "SELECT l_partkey AS p, l_orderkey AS o, least(count(*), 65535) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o FROM sa) GROUP BY ALL",
        "SELECT DISTINCT l_partkey AS p, 0 AS k_entropy, CASE WHEN l_partkey IN (SELECT p FROM hb) THEN 'w' ELSE '' END AS block_label FROM lineitem",
        "SELECT DISTINCT l_orderkey AS o, 0 AS filesize, '' AS file_type, 0 AS zero_count, 0 AS nonprobative_count FROM lineitem",
        "SELECT DISTINCT l_orderkey AS o, 'lineitem.tab' AS f FROM lineitem",
    ),
    "q_change_counts": f"""WITH {_SETS} SELECT 0 AS hash_data_inserted, (SELECT count(*) FROM b ANTI JOIN a USING (p, o)) AS hash_data_merged,
        (SELECT count(*) FROM b SEMI JOIN a USING (p, o)) AS hash_data_merged_same, (SELECT count(*) FROM b SEMI JOIN a USING (p)) AS hash_data_mismatched_data_detected,
        (SELECT count(*) FROM b JOIN a USING (p, o) WHERE a.n <> b.n) AS hash_data_mismatched_sub_count_detected, (SELECT count(*) FROM hb ANTI JOIN ha USING (p)) AS hash_inserted,
        (SELECT count(*) FROM sb ANTI JOIN sa USING (o)) AS source_data_inserted, (SELECT count(*) FROM sb SEMI JOIN sa USING (o)) AS source_data_changed, 0 AS source_data_same,
        (SELECT count(*) FROM sb ANTI JOIN sa USING (o)) AS source_id_inserted,
        (SELECT count(*) FROM b) + (SELECT count(*) FROM sb) + (SELECT count(*) FROM nb) - (SELECT count(*) FROM sb ANTI JOIN sa USING (o)) AS source_id_already_present,
        (SELECT count(*) FROM nb) AS source_name_inserted, 0 AS source_name_already_present""",
    "q_blocks_md5": f"WITH {_BLOCKS} SELECT filename, CAST(pos AS BIGINT) AS \"offset\", md5(unhex(b)) AS block_hash FROM bl",
    "q_zero_blocks": """WITH d AS (SELECT 'doc_' || doc_id AS filename, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
        SELECT filename, (n + 1500 + 511) // 512 - (n + 511) // 512 AS zero_count, (n + 1500 + 511) // 512 AS blocks FROM d""",
    "q_ingest_documents": f"""WITH {_BLOCKS}, f AS (SELECT md5(unhex(x)) AS file_hash, length(any_value(x)) // 2 AS filesize, count(*) AS n_names, min(filename) AS first_name FROM d GROUP BY ALL),
        u AS (SELECT md5(unhex(x)) AS file_hash, filename, block_hash FROM z),
        r AS (SELECT block_hash, file_hash, count(*) AS n FROM u SEMI JOIN f ON u.file_hash = f.file_hash AND u.filename = f.first_name GROUP BY ALL)
        SELECT block_hash, file_hash, n AS sub_count, 0 AS k_entropy, '' AS block_label, CAST(sum(n) OVER (PARTITION BY block_hash) AS BIGINT) AS count,
               filesize, '' AS file_type, 0 AS zero_count, 0 AS nonprobative_count, n_names, first_name FROM r JOIN f USING (file_hash)""",
    "q_scan_documents": f"""WITH {_BLOCKS}, e AS (SELECT md5(unhex(x)) AS file_hash, min(filename) AS first FROM d WHERE lang = 'en' GROUP BY ALL),
        h AS (SELECT block_hash, count(*) AS c FROM z JOIN e ON filename = first GROUP BY block_hash)
        SELECT filename, CAST(pos AS VARCHAR) AS label, block_hash, '{{"block_hash":"' || block_hash || '","count":' || c || '}}' AS json FROM z JOIN h USING (block_hash)""",
    "q_hex_roundtrip": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN NULL ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS hex FROM orders",
    "q_prefix7": "SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 14) AS prefix FROM orders",
    "q_approx_code": f"WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders) SELECT o_orderkey, {_CODE.format(c='c')} AS code, {_APPROX.format(c='c')} AS approximate_count FROM t",
    "q_stream_scan": """WITH h AS (SELECT event_type, count(*) AS c FROM events GROUP BY ALL)
        SELECT CAST(event_id AS VARCHAR) AS label, md5(event_type) AS block_hash, '{"block_hash":"' || md5(event_type) || '","count":' || c || '}' AS json FROM events JOIN h USING (event_type)""",
    "q_stream_optimized": 'SELECT md5(event_type) AS block_hash, 1 AS "full", count(*) - 1 AS bare FROM events GROUP BY event_type',
}


def oracle_sql() -> dict[str, str]:
    return SQL
