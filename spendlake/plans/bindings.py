"""SQL text of the canonical tables, for the reference side of each check."""

RECEIPTS_AS_OF = "timestamp '2001-08-02 00:00:00'"
EVENTS_AS_OF = "timestamp '2024-01-31 00:00:00'"

CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Combustible' WHEN '2-HIGH' THEN 'Supermercado'
 WHEN '3-MEDIUM' THEN 'Comida' WHEN '5-LOW' THEN 'Retail' END"""
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'aceptada' WHEN 'O' THEN 'en_revision' WHEN 'P' THEN 'rechazada' END"
ORDER_TIME = "(o_orderdate + to_hours(cast(o_orderkey % 24 as int)))"

# name: (other bindings it builds on, SELECT)
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "receipts": ((), f"""
SELECT o_orderkey AS receipt_id, o_custkey AS user_id, 'Vendor ' || (o_orderkey % 40) AS company_name,
 'F' || o_orderkey AS folio_number, o_orderpriority AS description, {CATEGORY} AS category, {STATUS} AS status,
 {ORDER_TIME} AS date, {ORDER_TIME} AS created_at, cast(o_totalprice AS decimal(18,2)) AS total_amount FROM orders"""),
    "receipts_dup": (("receipts",), """
SELECT * FROM receipts
UNION ALL SELECT receipt_id + 10000000, user_id, company_name, folio_number, description, category, status,
 date + interval 30 minute, created_at, total_amount FROM receipts WHERE receipt_id % 50 = 0
UNION ALL SELECT receipt_id + 20000000, user_id, company_name, folio_number, description, category, status,
 date + interval 3 hour, created_at, cast(total_amount * 0.8 AS decimal(18,2)) FROM receipts WHERE receipt_id % 50 = 1"""),
    "categories": ((), f"""
SELECT o_orderkey AS receipt_id, o_custkey AS user_id, {CATEGORY} AS category, o_orderkey % 7 = 0 AS user_corrected,
 {ORDER_TIME} AS created_at FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'"""),
    "receipt_products": ((), """
SELECT l_orderkey AS receipt_id, l_linenumber AS line, p_name AS name, l_partkey AS sku, l_quantity AS quantity,
 cast(l_extendedprice AS decimal(18,2)) AS total_price, cast(p_retailprice AS decimal(18,2)) AS unit_price,
 1 - l_discount AS confidence, CASE l_returnflag WHEN 'A' THEN 'advanced_parser' WHEN 'N' THEN 'manual_entry'
 WHEN 'R' THEN 'manual_correction' END AS extraction_method, p_type AS category, l_shipdate AS created_at
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "approvals": ((), f"""
SELECT o_orderkey AS receipt_id, o_orderkey AS instance_id, o_custkey AS user_id, {STATUS} AS status,
 o_custkey % 20 AS approver_id, CASE o_custkey % 3 WHEN 0 THEN 'supervisor' WHEN 1 THEN 'manager' ELSE 'director' END AS approver_role,
 o_custkey % 4 AS workflow_id, {ORDER_TIME} AS created_at, {ORDER_TIME} + interval 3 day AS due_date,
 cast(o_orderkey % 3 AS int) AS escalation_count FROM orders"""),
    "locations": ((), f"""
SELECT o_orderkey AS receipt_id, o_custkey AS user_id, 'Vendor ' || (o_orderkey % 40) AS company_name, {ORDER_TIME} AS date,
 cast(o_totalprice AS decimal(18,2)) AS total_amount, {CATEGORY} AS category,
 cast(-33.45 AS double) + (c_nationkey - 12) * cast(0.4 AS double)
   + CASE WHEN o_orderkey % 9 = 0 THEN cast(0.5 AS double) ELSE cast(0.0 AS double) END AS lat,
 cast(-70.67 AS double) + (o_orderkey % 5) * cast(0.003 AS double) AS lng, 'City ' || c_nationkey AS address
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "engine_results": ((), f"""
SELECT o_orderkey AS receipt_id, 'tesseract' AS engine, cast(0.25 AS double) AS weight, 'Vendor ' || (o_orderkey % 40) AS vendor,
 cast(o_totalprice AS decimal(18,2)) AS total_amount,
 cast(0.62 AS double) + CASE WHEN o_orderkey % 2 = 0 THEN cast(0.1 AS double) ELSE 0 END AS confidence,
 strftime({ORDER_TIME}, '%Y-%m-%d') AS date FROM orders
UNION ALL SELECT o_orderkey, 'easyocr', cast(0.60 AS double), CASE o_orderkey % 7 WHEN 3 THEN 'VENDOR ' || (o_orderkey % 40) || '.' WHEN 5 THEN 'XQZW' ELSE 'VENDOR ' || (o_orderkey % 40) END,
 cast(cast(o_totalprice AS decimal(14,2)) * 1.01::decimal(3,2) AS decimal(18,2)),
 cast(0.68 AS double) + CASE WHEN o_orderkey % 2 = 0 THEN cast(0.1 AS double) ELSE 0 END,
 strftime({ORDER_TIME}, '%d/%m/%Y') FROM orders
UNION ALL SELECT o_orderkey, 'paddleocr', cast(0.15 AS double), substring('Vendor ' || (o_orderkey % 40), 2),
 cast(cast(o_totalprice AS decimal(14,2)) * CASE WHEN o_orderkey % 11 = 0 THEN 12 ELSE 1 END AS decimal(18,2)),
 cast(0.55 AS double) + CASE WHEN o_orderkey % 2 = 0 THEN cast(0.1 AS double) ELSE 0 END,
 strftime({ORDER_TIME}, '%Y-%m-%d') FROM orders"""),
    "users": ((), """
SELECT c_custkey AS user_id, cast(c_nationkey AS bigint) AS employer_id, 'employee' AS role, c_mktsegment AS department,
 c_name AS name, lower(c_name) || '@example.com' AS email FROM customer"""),
    "employers": ((), """
SELECT cast(n_nationkey AS bigint) AS employer_id, n_name AS company_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "spending_limits": ((), """
SELECT c_custkey || '-' || limit_type AS limit_id, c_custkey AS employee_id, limit_type,
 cast(cast(abs(c_acctbal) AS decimal(18,2)) * k AS decimal(18,2)) AS limit_amount, c_custkey % 3 = 0 AS retail_only,
 c_custkey % 10 <> 0 AS is_active, timestamp '2001-01-01' + to_hours(cast(c_custkey % 1000 AS int)) AS created_at
FROM customer, (VALUES ('monthly', 50), ('weekly', 15), ('yearly', 500)) kinds(limit_type, k)"""),
    "invitations": ((), """
SELECT c_custkey AS invitation_id, cast(c_nationkey AS bigint) AS employer_id,
 CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'expired' ELSE 'cancelled' END AS status,
 timestamp '2001-07-20' + to_hours(cast(c_custkey % 300 AS int)) AS created_at,
 timestamp '2001-07-20' + to_hours(cast(c_custkey % 300 AS int)) + interval 7 day AS expires_at FROM customer"""),
    "fuel_expenses": ((), """
SELECT (l_orderkey::bigint * 10 + l_linenumber) * 1000003 + (l_partkey::bigint * 31 + l_suppkey) % 1000003 AS expense_id,
 l_orderkey % 1000 AS user_id, l_quantity * 10 AS distance_km,
 CASE l_partkey % 3 WHEN 0 THEN 'economico' WHEN 1 THEN 'intermedio' ELSE 'suv' END AS vehicle_type,
 CASE l_suppkey % 4 WHEN 0 THEN 'gasolina_93' WHEN 1 THEN 'gasolina_95' WHEN 2 THEN 'gasolina_97' ELSE 'diesel' END AS fuel_type,
 'City ' || (l_suppkey % 10) AS origin, 'City ' || (l_partkey % 10) AS destination,
 CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'pending' END AS status, l_extendedprice AS noise,
 l_shipdate AS created_at FROM lineitem"""),
    "processing_metrics": ((), """
SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'tesseract' WHEN 'click' THEN 'google_vision' ELSE 'hybrid' END AS engine,
 least(value / 100, 1.0) AS confidence, value / 20 AS processing_time, event_id % 4 = 0 AS cache_hit,
 event_id % 5 = 0 AS fallback_used, event_type = 'click' AS paid_call, event_type = 'error' AS error,
 CASE WHEN event_type = 'error' THEN CASE cast(json_extract(props, '$.k') AS int) % 3 WHEN 0 THEN 'timeout'
  WHEN 1 THEN 'unreadable' ELSE 'network' END END AS error_type FROM events"""),
    "notifications": ((), """
SELECT event_id AS notification_id, user_id, event_type AS type,
 CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority, event_id % 2 = 0 AS is_read,
 ts AS created_at, props AS data FROM events"""),
    "receipt_texts": ((), f"""
SELECT o_orderkey AS receipt_id, total, n, {ORDER_TIME} AS date, concat_ws(chr(10),
 ['LIDER EXPRESS LTDA', 'COPEC PRONTO', 'FARMACIA CRUZ VERDE', 'FALABELLA CENTRO', 'COMERCIAL ANDINA'][o_orderkey % 5 + 1],
 'RUT: 76.' || lpad((o_orderkey % 1000)::varchar, 3, '0') || '.' || lpad((o_orderkey * 7 % 1000)::varchar, 3, '0') || '-'
  || CASE WHEN o_orderkey % 11 = 10 THEN 'K' ELSE (o_orderkey % 10)::varchar END,
 'SUC: ' || CASE WHEN o_orderkey % 4 = 0 THEN 'CALLE LOS AROMOS ' ELSE 'AV. PROVIDENCIA ' END || (o_orderkey % 900 + 100) || ', SANTIAGO',
 'FONO: +56 2 2' || lpad((o_orderkey % 1000)::varchar, 3, '0') || ' ' || lpad((o_orderkey * 3 % 10000)::varchar, 4, '0'),
 'BOL. ELECTRONICA: ' || lpad(o_orderkey::varchar, 10, '0'),
 'FECHA: ' || strftime({ORDER_TIME}, '%d/%m/%Y') || ' HORA: ' || strftime({ORDER_TIME}, '%H:%M:%S'),
 'CAJA: ' || lpad((o_orderkey % 90)::varchar, 4, '0'), body,
 'TOTAL $ ' || replace(format('{{:,}}', total), ',', '.'), 'SUBTOTAL ' || replace(format('{{:,}}', total), ',', '.'),
 'AFECTO ' || replace(format('{{:,}}', total - vat), ',', '.'),
 CASE WHEN o_orderkey % 3 = 1 THEN 'TOTAL IVA (19.0%)' || chr(10) ELSE 'IVA $ ' END || replace(format('{{:,}}', vat), ',', '.'),
 'TOTAL NUMERO DE ARTIC VEND = ' || n,
 ['EFECTIVO', 'DEBITO', 'CREDITO', 'TARJETA VISA XXXX 4321 AUTORIZACION: 998877', 'TRANSFERENCIA'][o_orderkey % 5 + 1],
 'VUELTO $ ' || (o_orderkey % 7 * 100), 'GRACIAS POR SU COMPRA') AS text
FROM orders JOIN (SELECT l_orderkey, cast(sum(amount) AS bigint) AS total, cast(sum(amount) AS bigint) * 19 // 119 AS vat, count(*) AS n,
 string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, amount) AS body FROM (
 SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN counted || ' ' || name || ' $' || price WHEN l_orderkey % 3 = 2 THEN bar || ' ' || name || ' $' || price
  WHEN l_partkey % 3 = 0 THEN counted || chr(10) || name || chr(10) || '$ ' || price WHEN l_partkey % 3 = 1 THEN bar || ' ' || name || chr(10) || '$ ' || price
  ELSE name || chr(10) || chr(10) || price END AS line FROM (
 SELECT *, q::varchar || 'X' || replace(format('{{:,}}', amount // q), ',', '.') AS counted, replace(format('{{:,}}', amount), ',', '.') AS price FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice) AS bigint) AS amount, cast(l_quantity AS int) AS q, upper(p_name) AS name,
 '78' || lpad(l_partkey::varchar, 11, '0') AS bar FROM lineitem JOIN part ON l_partkey = p_partkey))) GROUP BY 1) ON o_orderkey = l_orderkey"""),
    "noisy_names": ((), """
SELECT p_partkey AS sku, p_retailprice AS price, CASE p_partkey % 5 WHEN 0 THEN replace(base, 'o', '0') WHEN 1 THEN replace(base, 'l', '1')
 WHEN 2 THEN base || ' ' || upper(p_name) WHEN 3 THEN array_to_string(list_transform(string_split(base, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
 ELSE replace(base, 'a', '4') END AS name FROM (SELECT *, ['coca cola', 'pepsi', 'leche soprole', 'yogurt', 'pan hallulla', 'marraqueta', 'pollo',
 'lomo', 'tomate', 'paltas', 'platano', 'arroz grado 1', 'aceite oliva', 'azucar blanca', 'detergente', 'galletas'][p_partkey % 16 + 1] AS base FROM part)"""),
}


def r(expression: str) -> str:
    """A number in report form: double, six digits, exact halves upwards."""
    return f"round(cast({expression} AS double) + 1e-9, 6)"


def d(expression: str) -> str:
    """A timestamp in report form."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
