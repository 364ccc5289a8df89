"""The projections of ``quillmart.sources.tables`` as common table expressions, for the SQL checks."""

PANEL = """panel AS (
  SELECT s_nationkey AS district, n_regionkey AS district_type, p_type AS industry,
    CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS INTEGER) AS quarter,
    CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q,
    CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sales,
    CAST(count(*) AS BIGINT) AS txns, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS stores,
    CAST(sum(l_quantity) AS DOUBLE) AS traffic,
    CAST(1000 + (s_nationkey * 37 + (year(l_shipdate) * 4 + quarter(l_shipdate) - 1) * 53) % 400 AS DOUBLE) AS residents,
    CAST(500 + (s_nationkey * 91 + (year(l_shipdate) * 4 + quarter(l_shipdate) - 1) * 29) % 300 AS DOUBLE) AS workers,
""" + ",\n".join(f"    CAST(coalesce(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) FILTER (isodow(l_shipdate) = {i + 1}), 0) AS DOUBLE) AS d{i}" for i in range(7)) + """
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY s_nationkey, n_regionkey, p_type, year(l_shipdate), quarter(l_shipdate))"""

POS = """pos AS (
  SELECT l_orderkey AS transaction, CAST(o_orderdate AS DATE) AS day, CAST(l_orderkey % 24 AS INTEGER) AS hour, l_suppkey AS store,
    l_partkey AS product, p_type AS category, o_orderpriority AS channel, o_custkey AS customer, l_discount > 0.05 AS coupon,
    l_quantity AS qty, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS bill
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

DECISIONS = """decisions AS (
  SELECT o_orderkey AS decision_id, o_orderpriority AS arm, o_custkey AS cluster, c_mktsegment AS problem,
    CASE WHEN o_orderkey % 13 <> 0 THEN (1 + o_orderkey % 7) / 10.0::DOUBLE END AS propensity,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 100000.0::DOUBLE END AS reward,
    c_acctbal / 10000.0::DOUBLE AS x1, quarter(o_orderdate) / 4.0::DOUBLE AS x2, o_custkey % 10 / 10.0::DOUBLE AS x3,
    CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS quarter,
    CAST((year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + o_orderkey % 3) // 4 * 10 + (year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + o_orderkey % 3) % 4 + 1 AS INTEGER) AS treated_quarter,
    o_orderkey % 11 <> 0 AS eligible
  FROM orders JOIN customer ON o_custkey = c_custkey),
usable AS (SELECT * FROM decisions WHERE eligible AND propensity IS NOT NULL AND reward IS NOT NULL)"""

DISTRICTS = """districts AS (
  SELECT n_nationkey AS district, n_regionkey AS district_type, CAST(n_nationkey * 7919 % 10000 AS DOUBLE) AS x, CAST(n_nationkey * 104729 % 10000 AS DOUBLE) AS y,
    126.8::DOUBLE + n_nationkey % 5 * 0.1::DOUBLE AS lon, 37.4::DOUBLE + n_nationkey // 5 * 0.05::DOUBLE AS lat, 1.0e6 * (1 + n_nationkey) AS area
  FROM nation)"""

POINTS = """points AS (
  SELECT c_custkey AS point, c_mktsegment AS category, CAST(c_custkey * 7919 % 10000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 10000 AS DOUBLE) AS y,
    126.7::DOUBLE + c_custkey * 7919 % 1000 / 1000.0::DOUBLE * 0.6::DOUBLE AS lon, 37.35::DOUBLE + c_custkey * 104729 % 1000 / 1000.0::DOUBLE * 0.3::DOUBLE AS lat
  FROM customer)"""

HAPPENINGS = """happenings AS (
  SELECT o_orderkey AS event, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'close' END AS kind, o_orderpriority AS name,
    CAST(o_custkey * 7919 % 10000 AS DOUBLE) AS x, CAST(o_custkey * 104729 % 10000 AS DOUBLE) AS y, CAST(o_orderdate AS DATE) AS start,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 - 2 AS INTEGER) END AS "end"
  FROM orders),
periods AS (SELECT event, kind, name, x, y, start, CASE WHEN "end" IS NULL OR "end" < start THEN start ELSE "end" END AS "end" FROM happenings),
event_quarters AS (
  SELECT event, kind, name, x, y, start, "end", CAST(s // 4 * 10 + s % 4 + 1 AS INTEGER) AS quarter,
    date_diff('day', greatest(start, make_date(CAST(s // 4 AS INTEGER), CAST(s % 4 * 3 + 1 AS INTEGER), 1)),
      least("end", CAST(make_date(CAST(s // 4 AS INTEGER), CAST(s % 4 * 3 + 1 AS INTEGER), 1) + INTERVAL 3 MONTH AS DATE) - 1)) + 1 AS days
  FROM (SELECT *, unnest(generate_series(year(start) * 4 + quarter(start) - 1, year("end") * 4 + quarter("end") - 1)) AS s FROM periods))"""

RECEIPTS = """receipts AS (
  SELECT o_orderkey AS receipt, CAST(o_orderdate AS DATE) AS day, c_name AS vendor, c_mktsegment AS category, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey),
receipt_items AS (
  SELECT l_orderkey AS receipt, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey * 100 + l_suppkey % 100 AS line, p_name AS item,
    CASE WHEN p_size % 3 = 0 THEN 'kg' WHEN p_size % 3 = 1 THEN 'L' END AS unit, l_extendedprice / l_quantity AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SEARCHES = """counts AS (
  SELECT event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS item, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
days AS (SELECT item, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counts GROUP BY item),
searches AS (SELECT d.item, d.day, coalesce(c.value, 0.0) AS value FROM days d LEFT JOIN counts c ON d.item = c.item AND d.day = c.day)"""


RECEIPT_BOXES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS i FROM lineitem),
printed AS (SELECT l_orderkey AS receipt, i, p_type || CASE WHEN p_size % 9 = 0 THEN ' 원두' WHEN p_size % 5 = 0 THEN ' 박스' ELSE '' END AS name, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CASE WHEN l_discount >= 0.08 THEN CAST(floor(l_extendedprice) AS BIGINT) // 20 END AS off, i % 3 = 0 AS split, (l_orderkey + i) % 4 AS kind FROM numbered JOIN part ON l_partkey = p_partkey),
totals AS (SELECT receipt, CAST(sum(price) AS BIGINT) AS total, max(i) AS n FROM printed GROUP BY receipt),
heads AS (SELECT receipt, total, total // 11 AS vat, n, o_orderdate, r_name FROM totals JOIN orders ON receipt = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
boxes AS (
  SELECT receipt, CASE WHEN split THEN 3 + 3 * i ELSE 4 + 3 * i END AS slot, 0 AS place, 10.0 AS x0, 130.0 AS x1, name AS text FROM printed
  UNION ALL SELECT receipt, 4 + 3 * i, 1, 200, 220, CAST(qty AS VARCHAR) FROM printed
  UNION ALL SELECT receipt, 4 + 3 * i, 2, 300, 360, format('{:,}', price) || CASE WHEN kind = 0 AND price >= 1000 THEN '원' ELSE '' END FROM printed
  UNION ALL SELECT receipt, 5 + 3 * i, 0, 10, 50, '할인' FROM printed WHERE off IS NOT NULL
  UNION ALL SELECT receipt, 5 + 3 * i, 1, 300, 350, CASE kind WHEN 1 THEN format('{:,}', off) || '-' WHEN 2 THEN '(' || format('{:,}', off) || ')' ELSE '-' || format('{:,}', off) END FROM printed WHERE off IS NOT NULL
  UNION ALL SELECT receipt, 0, 0, 10, 160, '가게 ' || r_name FROM heads
  UNION ALL SELECT receipt, 1, 0, 100, 160, '영수증' FROM heads
  UNION ALL SELECT receipt, 2, 0, 10, 160, strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(receipt % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(receipt % 60 AS VARCHAR), 2, '0') FROM heads
  UNION ALL SELECT receipt, 3, 0, 10, 110, lpad(CAST(receipt % 1000 AS VARCHAR), 3, '0') || '-45-' || lpad(CAST(receipt % 100000 AS VARCHAR), 5, '0') FROM heads
  UNION ALL SELECT receipt, 5, 0, 10, 70, '상품명' FROM heads
  UNION ALL SELECT receipt, 6 + 3 * n + j, 0, 10, 10 + [80, 60, 80][j + 1], ['과세금액', '부가세', '합계금액'][j + 1] FROM heads, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT receipt, 6 + 3 * n + j, 1, 300, 360, format('{:,}', [total - vat, vat, total][j + 1]) FROM heads, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT receipt, 9 + 3 * n, 0, 10, 90, ['카카오페이', '신용카드', '현금결제'][receipt % 3 + 1] FROM heads),
placed AS (SELECT CAST(receipt AS VARCHAR) AS image, receipt, CAST(slot AS BIGINT) AS slot, place, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, text, receipt * 31 + slot * 17 + place * 7 AS turn,
  CAST(dense_rank() OVER (PARTITION BY receipt ORDER BY slot) - 1 AS BIGINT) AS row, CAST(row_number() OVER (PARTITION BY receipt, slot ORDER BY place) - 1 AS BIGINT) AS seat FROM boxes)"""
