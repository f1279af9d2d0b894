"""DuckDB text of the same SQL literals, used to write the oracle queries of the checked plans.

These strings are the independent re-statement of the dump format in another engine's SQL; they
are only ever run by DuckDB (the correctness gate), never by the library.
"""

from __future__ import annotations

# The same escape pairs as ``tablevault.functions.literals.SQL_ESCAPES``, written
# with chr() codes for DuckDB: (character code, escape text).
_DUCK_ESCAPES = [
    (92, "\\\\"),
    (0, "\\0"),
    (39, "\\'"),
    (34, '\\"'),
    (8, "\\b"),
    (10, "\\n"),
    (13, "\\r"),
    (26, "\\Z"),
]

INT_TYPES = {"int", "bigint", "smallint", "tinyint"}


def _sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duck_escape(expr: str) -> str:
    out = expr
    for code, esc in _DUCK_ESCAPES:
        out = f"replace({out}, chr({code}), {_sq(esc)})"
    return out


def duck_lit(col: str, typ: str) -> str:
    """DuckDB expression giving the compat-mode SQL literal of ``col`` (``NULL`` for null)."""
    c = f'"{col}"'
    if typ in INT_TYPES:
        e = f"CAST({c} AS VARCHAR)"
    elif typ == "double":
        e = f"printf('%f', {c})"
    elif typ == "string":
        e = f"'''' || {duck_escape(c)} || ''''"
    elif typ == "timestamp":
        e = f"'''' || strftime({c}, '%Y-%m-%d %H:%M:%S') || ''''"
    elif typ == "date":
        e = f"'''' || strftime({c}, '%Y-%m-%d') || ''''"
    elif typ == "json":
        e = f"'''' || {duck_escape(f'to_json({c})::VARCHAR')} || ''''"
    else:
        raise TypeError(typ)
    return f"coalesce({e}, 'NULL')"


def duck_tuple(cols: list[tuple[str, str]]) -> str:
    parts = ", ".join(duck_lit(n, t) for n, t in cols)
    return f"'(' || concat_ws(',', {parts}) || ')'"


def duck_prefix(table: str, cols: list[tuple[str, str]]) -> str:
    names = ", ".join(f"`{n}`" for n, _ in cols)
    return f"INSERT INTO `{table}` ({names}) VALUES "


def duck_insert(table: str, cols: list[tuple[str, str]]) -> str:
    return f"{_sq(duck_prefix(table, cols))} || {duck_tuple(cols)} || ';'"


# Column names and DuckDB-side types of the driver tables (FIXTURES.md section 5).
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "json"), ("label", "int")],
}


def duck_order(key: list[str]) -> str:
    """Spark's ascending order (nulls first) in DuckDB."""
    return ", ".join(f'"{k}" ASC NULLS FIRST' for k in key)


def duck_packed_whole(table: str, key: list[str], max_packet: int) -> str:
    """``(seq, stmt)``: one greedy packing pass over the whole table, without a per-row recursion.

    With ``g`` the running sum of ``tuple bytes + 1``, a statement starting at tuple ``s`` takes
    tuple ``i > s`` while ``g(i + 1) <= g(s) + max_packet - prefix + 1``. ``g`` only grows, so the
    next start after ``s`` is the number of tuples whose ``g(i + 1)`` is within that bound: one
    window over the sizes and bounds sorted together. The recursion then walks one step per
    statement, not per row.
    """
    cols = TABLE_COLUMNS[table]
    prefix = duck_prefix(table, cols)
    limit = max_packet - len(prefix.encode("utf-8")) + 1
    return f"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER (ORDER BY {duck_order(key)}) - 1 AS idx, {duck_tuple(cols)} AS tup
  FROM {table}
), c AS (
  SELECT idx, tup, count(*) OVER () AS n,
         sum(strlen(tup) + 1) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g1
  FROM src
), marks AS (
  SELECT g1 AS v, 0 AS kind, idx, n FROM c
  UNION ALL
  SELECT g1 - strlen(tup) - 1 + {limit}, 1, idx, n FROM c
), within AS (
  SELECT kind, idx, n,
         sum(1 - kind) OVER (ORDER BY v, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt
  FROM marks
), nxt AS (
  SELECT idx, CASE WHEN greatest(cnt, idx + 1) >= n THEN NULL ELSE greatest(cnt, idx + 1) END AS nb
  FROM within WHERE kind = 1
), chain(seq, s) AS (
  SELECT 0, 0
  UNION ALL
  SELECT chain.seq + 1, nxt.nb FROM chain JOIN nxt ON nxt.idx = chain.s WHERE nxt.nb IS NOT NULL
), member AS (
  SELECT c.idx, c.tup,
         sum(CASE WHEN chain.s IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY c.idx ROWS BETWEEN UNBOUNDED PRECEDING
                                                                AND CURRENT ROW) - 1 AS seq
  FROM c LEFT JOIN chain ON chain.s = c.idx
)
SELECT seq, {_sq(prefix)} || string_agg(tup, ',' ORDER BY idx) || ';' AS stmt, count(*) AS n FROM member GROUP BY seq
"""


# DuckDB column types -> the MySQL types the dump declares for the matching Spark types.
_DUCK_DDL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "TINYINT": "tinyint",
                   "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "tinyint(1)", "VARCHAR": "longtext",
                   "BLOB": "longblob", "DATE": "date", "TIMESTAMP": "datetime", "TIMESTAMP_NS": "datetime",
                   "TIMESTAMP_MS": "datetime", "TIMESTAMP_S": "datetime",
                   "TIMESTAMP WITH TIME ZONE": "timestamp NULL"}


def duck_table_pre(table: str, key: list[str] = (), charset: str = "utf8mb4", collation: str = "utf8mb4_0900_ai_ci") -> str:
    """Full-mode text before a table's rows (comments, DROP, CREATE from information_schema, LOCK)."""
    t = f"`{table}`"
    head = (f"\n--\n-- Table structure for table {t}\n--\n\nDROP TABLE IF EXISTS {t};\n"
            "/*!40101 SET @saved_cs_client     = @@character_set_client */;\n"
            f"/*!50503 SET character_set_client = {charset} */;\nCREATE TABLE {t} (\n")
    primary = f",\n  PRIMARY KEY ({','.join(f'`{k}`' for k in key)})" if key else ""
    tail = (f"{primary}\n) ENGINE=InnoDB DEFAULT CHARSET={charset} COLLATE={collation};\n"
            "/*!40101 SET character_set_client = @saved_cs_client */;\n\n"
            f"--\n-- Dumping data for table {t}\n--\n\nLOCK TABLES {t} WRITE;\n"
            f"/*!40000 ALTER TABLE {t} DISABLE KEYS */;")
    types = " ".join(f"WHEN {_sq(k)} THEN {_sq(v)}" for k, v in _DUCK_DDL_TYPES.items())
    return (f"(SELECT {_sq(head)} || string_agg('  `' || column_name || '` ' || CASE data_type {types} END, "
            f"',' || chr(10) ORDER BY ordinal_position) || {_sq(tail)} "
            f"FROM information_schema.columns WHERE table_name = {_sq(table)} AND table_schema = "
            f"(SELECT min(table_schema) FROM information_schema.columns WHERE table_name = {_sq(table)}))")
