"""DuckDB SQL equal in result to each registered query (tables are pre-registered views)."""

from __future__ import annotations

from spendlens.sources.testdata import TX_SQL

SEL = "sel AS (SELECT * FROM tx WHERE year IS NOT NULL AND month_name IS NOT NULL)"
EXP = "exp AS (SELECT * FROM sel WHERE amount_spent > 0)"
KIND = """kinded AS (
  SELECT *, CASE WHEN amount_spent > 0 THEN 'Expenses' ELSE 'Payments' END AS kind, abs(amount_spent) AS value
  FROM sel WHERE amount_spent <> 0
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([TX_SQL.strip(), *ctes]) + "\n"


TX_PRESENTED = """
  transaction_id, user_id, customer_id, f_name, l_name, address,
  CAST(transaction_date AS DATE) AS transaction_date, CAST(posting_date AS DATE) AS posting_date,
  activity_description, category, sub_category,
  CAST(amount_spent AS DOUBLE) AS amount_spent, CAST(credit_limit AS DOUBLE) AS credit_limit,
  CAST(available_credit AS DOUBLE) AS available_credit, is_subscription,
  month, day, month_name, day_of_week, year
"""


def _category_totals(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return _with(SEL, EXP) + f"""
SELECT {keys}category, CAST(s AS DOUBLE) AS total_spent, n_transactions,
       CAST(s AS DOUBLE) / CAST(sum(s) OVER ({part}) AS DOUBLE) AS share
FROM (SELECT {keys}category, sum(amount_spent) AS s, count(*) AS n_transactions
      FROM exp WHERE category IS NOT NULL GROUP BY {keys}category) g
"""


def _subcategory_top10(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return _with(SEL, EXP) + f"""
SELECT {keys}rank, sub_category, CAST(s AS DOUBLE) AS total_spent,
       CAST(s AS DOUBLE) / CAST(sum(s) OVER ({part}) AS DOUBLE) AS share
FROM (
  SELECT *, CAST(row_number() OVER ({part} ORDER BY s DESC, sub_category) AS INTEGER) AS rank
  FROM (SELECT {keys}sub_category, sum(amount_spent) AS s FROM exp
        WHERE sub_category IS NOT NULL GROUP BY {keys}sub_category) g
) r WHERE rank <= 10
"""


def _overview(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return _with(SEL) + f"""
SELECT {keys}active_days,
       CAST(spend AS DOUBLE) AS total_spending, CAST(pay AS DOUBLE) AS total_payments,
       CAST(spend - pay AS DOUBLE) AS balance,
       CASE WHEN active_days > 0 THEN CAST(spend AS DOUBLE) / active_days ELSE 0.0 END AS avg_daily_spend,
       CASE WHEN active_days > 0 THEN CAST(pay AS DOUBLE) / active_days ELSE 0.0 END AS avg_daily_payments
FROM (
  SELECT {keys}count(DISTINCT CAST(transaction_date AS DATE)) AS active_days,
         coalesce(sum(CASE WHEN amount_spent > 0 THEN amount_spent END), 0) AS spend,
         coalesce(sum(CASE WHEN amount_spent < 0 THEN -amount_spent END), 0) AS pay
  FROM sel {group}
) o
"""


def _money_text(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


OVERVIEW_CARDS = f"""
SELECT user_id,
  {_money_text('total_spending')} AS total_spending_text,
  {_money_text('total_payments')} AS total_payments_text,
  {_money_text('balance')} AS balance_text,
  CASE WHEN balance >= 0 THEN '+' ELSE '' END || {_money_text('balance')}
    || CASE WHEN balance > 0 THEN ' (Owing)' ELSE ' (Credit)' END AS balance_caption,
  {_money_text('avg_daily_spend')} AS avg_daily_spend_text,
  {_money_text('avg_daily_payments')} AS avg_daily_payments_text
FROM ({_overview('user_id')}) ov
"""


def _top10_transactions(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return _with(SEL, EXP) + f"""
SELECT {keys}rank, transaction_id, CAST(transaction_date AS DATE) AS transaction_date, activity_description,
       category, CAST(amount_spent AS DOUBLE) AS amount_spent,
       activity_description || ' (' || strftime(transaction_date, '%b %d') || ')' AS label
FROM (SELECT *, CAST(row_number() OVER ({part} ORDER BY amount_spent DESC, transaction_id) AS INTEGER) AS rank
      FROM exp) r
WHERE rank <= 10
"""


DAILY = _with(SEL) + """
SELECT CAST(transaction_date AS DATE) AS transaction_date,
       CAST(sum(CASE WHEN amount_spent > 0 THEN amount_spent END) AS DOUBLE) AS daily_spending,
       CAST(sum(CASE WHEN amount_spent < 0 THEN -amount_spent END) AS DOUBLE) AS daily_payments
FROM sel WHERE transaction_date IS NOT NULL
GROUP BY 1
HAVING daily_spending IS NOT NULL OR daily_payments IS NOT NULL
"""


def _monthly(by: str) -> str:
    keys = f"{by}, " if by else ""
    return _with(SEL, KIND) + f"""
SELECT {keys}kind, month AS month_no, month_name, CAST(sum(value) AS DOUBLE) AS total
FROM kinded WHERE month IS NOT NULL AND month_name IS NOT NULL
GROUP BY {keys}kind, month, month_name
"""


def _weekday(by: str) -> str:
    keys = f"{by}, " if by else ""
    return _with(SEL, KIND) + f"""
SELECT {keys}kind, CAST(dayofweek(transaction_date) + 1 AS INTEGER) AS dow_no, day_of_week,
       CAST(sum(value) AS DOUBLE) AS total
FROM kinded WHERE transaction_date IS NOT NULL AND day_of_week IS NOT NULL
GROUP BY {keys}kind, dayofweek(transaction_date), day_of_week
"""


def _top10_merchants(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return _with(SEL, EXP) + f"""
SELECT {keys}rank, merchant, transaction_count FROM (
  SELECT *, CAST(row_number() OVER ({part} ORDER BY transaction_count DESC, merchant) AS INTEGER) AS rank
  FROM (SELECT {keys}activity_description AS merchant, count(*) AS transaction_count
        FROM exp WHERE activity_description IS NOT NULL GROUP BY {keys}activity_description) g
) r WHERE rank <= 10
"""


def _subscriptions(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return _with(SEL, EXP) + f"""
SELECT {keys}row_number() OVER ({part} ORDER BY s DESC, activity_description) AS rank, activity_description,
       CAST(s AS DOUBLE) AS amount_spent
FROM (SELECT {keys}activity_description, sum(amount_spent) AS s FROM exp
      WHERE is_subscription AND activity_description IS NOT NULL GROUP BY {keys}activity_description) g
"""


ORACLE: dict[str, str] = {
    "category_totals": _category_totals(""),
    "category_totals_per_user": _category_totals("user_id"),
    "subcategory_top10": _subcategory_top10(""),
    "subcategory_top10_per_user": _subcategory_top10("user_id"),
    "overview_kpis": _overview(""),
    "overview_kpis_per_user": _overview("user_id"),
    "overview_cards_text": OVERVIEW_CARDS,
    "top10_transactions": _top10_transactions(""),
    "top10_transactions_per_user": _top10_transactions("user_id"),
    "daily_spend_vs_payments": DAILY,
    "monthly_totals": _monthly(""),
    "monthly_totals_per_user": _monthly("user_id"),
    "weekday_totals": _weekday(""),
    "weekday_totals_per_user": _weekday("user_id"),
    "top10_merchants": _top10_merchants(""),
    "top10_merchants_per_user": _top10_merchants("user_id"),
    "subscription_costs": _subscriptions(""),
    "subscription_costs_per_user": _subscriptions("user_id"),
    "available_years": _with(SEL) + (
        "SELECT CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS rank, year "
        "FROM (SELECT DISTINCT year FROM sel WHERE year IS NOT NULL) y"
    ),
    "available_months": _with(SEL) + (
        "SELECT DISTINCT month AS month_no, month_name FROM sel WHERE month IS NOT NULL AND month_name IS NOT NULL"
    ),
    "period_filter": _with() + f"SELECT {TX_PRESENTED} FROM tx "
    "WHERE year IN (1996, 1997) AND month_name IN ('January', 'March', 'December')",
    "period_filter_empty": _with() + f"SELECT {TX_PRESENTED} FROM tx WHERE false",
    "user_history": _with() + f"""
SELECT {TX_PRESENTED} FROM tx
WHERE user_id IN (SELECT user_id FROM tx
                  WHERE transaction_date >= (SELECT max(transaction_date) FROM tx) - INTERVAL 30 DAY)
""",
}


# --------------------------------------------------------------------------- cleaning, keys, dedup

CLEAN_TYPES = """
WITH src AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, o_orderpriority
  FROM orders
), parsed AS (
  SELECT k AS transaction_id,
    CASE k % 8 WHEN 3 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END
               WHEN 4 THEN NULL ELSE d
    END AS transaction_date,
    CASE k % 6 WHEN 0 THEN price WHEN 2 THEN price WHEN 4 THEN price WHEN 5 THEN -price END AS amount_spent,
    (k % 7) IN (0, 1, 3, 4) AS is_subscription,
    o_orderpriority AS activity_description
  FROM src
)
SELECT transaction_id, transaction_date, amount_spent, is_subscription, activity_description,
  CAST(month(transaction_date) AS INTEGER) AS month, CAST(day(transaction_date) AS INTEGER) AS day,
  monthname(transaction_date) AS month_name, dayname(transaction_date) AS day_of_week,
  CAST(year(transaction_date) AS INTEGER) AS year
FROM parsed
"""

DATE_FEATURES = """
SELECT event_id, CAST(ts AS DATE) AS event_date, CAST(year(ts) AS INTEGER) AS year,
  CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  monthname(ts) AS month_name, dayname(ts) AS day_of_week
FROM events
"""

DEDUP_KEYS = _with() + """
SELECT transaction_id,
  coalesce(strftime(transaction_date, '%Y-%m-%d'), 'no_date') || '-' ||
  coalesce(lower(trim(activity_description)), 'no_desc') || '-' ||
  coalesce(CAST(amount_spent AS VARCHAR), 'no_amount') AS dedup_key
FROM tx
"""

UPLOAD = """hist AS (SELECT * FROM tx WHERE transaction_date < TIMESTAMP '1998-01-01'),
inc AS (SELECT * FROM tx WHERE transaction_date >= TIMESTAMP '1997-01-01'),
flagged AS (
  SELECT i.*, EXISTS (
    SELECT 1 FROM hist h
    WHERE h.user_id = i.user_id
      AND CAST(h.transaction_date AS DATE) IS NOT DISTINCT FROM CAST(i.transaction_date AS DATE)
      AND lower(trim(h.activity_description)) IS NOT DISTINCT FROM lower(trim(i.activity_description))
      AND h.amount_spent IS NOT DISTINCT FROM i.amount_spent
  ) AS dup
  FROM inc i
)"""

INSERT_PRESENTED = """
  user_id, customer_id, f_name, l_name, address,
  CAST(transaction_date AS DATE) AS transaction_date, CAST(posting_date AS DATE) AS posting_date,
  {desc} AS activity_description, category, sub_category,
  CAST(amount_spent AS DOUBLE) AS amount_spent, CAST(credit_limit AS DOUBLE) AS credit_limit,
  CAST(available_credit AS DOUBLE) AS available_credit, is_subscription,
  month, day, month_name, day_of_week, year
"""

DEDUP_NEW_ROWS = _with(UPLOAD) + f"""
SELECT {INSERT_PRESENTED.format(desc='lower(activity_description)')} FROM flagged WHERE NOT dup
"""

DEDUP_REPORT = _with(UPLOAD) + """
SELECT user_id, count(*) AS incoming, count(*) FILTER (WHERE NOT dup) AS inserted,
       count(*) FILTER (WHERE dup) AS skipped
FROM flagged GROUP BY user_id
"""

APPEND_HISTORY = _with(UPLOAD) + f"""
SELECT {INSERT_PRESENTED.format(desc='activity_description')} FROM hist
UNION ALL
SELECT {INSERT_PRESENTED.format(desc='lower(activity_description)')} FROM flagged WHERE NOT dup
"""

USERS0 = """users0 AS (
  SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         c_name AS display_name, 'https://img.example.com/' || CAST(c_custkey AS VARCHAR) || '.png' AS picture_url
  FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
)"""

USER_UPSERT = "WITH " + USERS0 + """,
upd AS (
  SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         c_name || ' (' || o_orderpriority || ')' AS display_name,
         CASE WHEN o_orderstatus = 'P' THEN NULL
              ELSE 'https://img.example.com/' || CAST(c_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.png'
         END AS picture_url,
         row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderdate >= TIMESTAMP '1998-01-01'
),
latest AS (SELECT email, display_name, picture_url FROM upd WHERE rn = 1)
SELECT u.user_id, coalesce(u.email, n.email) AS email,
       CASE WHEN n.email IS NOT NULL THEN n.display_name ELSE u.display_name END AS display_name,
       CASE WHEN n.email IS NOT NULL THEN n.picture_url ELSE u.picture_url END AS picture_url,
       u.user_id IS NULL AS is_new
FROM users0 u FULL OUTER JOIN latest n ON u.email = n.email
"""

CONSTRAINTS = _with(USERS0, """txd AS (
  SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE transaction_id % 17 = 0
), t AS (
  SELECT CASE WHEN transaction_id % 19 <> 0 THEN transaction_id END AS transaction_id,
         CASE WHEN transaction_id % 11 <> 0 THEN user_id END AS user_id, customer_id, f_name, l_name,
         CASE WHEN transaction_id % 13 = 0 THEN repeat(address, 200) ELSE address END AS address,
         category, sub_category, month_name, day_of_week FROM txd
), ud AS (
  SELECT * FROM users0 UNION ALL SELECT * FROM users0 WHERE user_id % 5 = 0
), u AS (
  SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN email END AS email,
         CASE WHEN user_id % 3 = 0 THEN repeat(display_name, 20) ELSE display_name END AS display_name FROM ud
)""") + """
SELECT 'tx_null_user_id' AS check_name, count(*) FILTER (WHERE user_id IS NULL) AS violations FROM t
UNION ALL SELECT 'tx_null_transaction_id', count(*) FILTER (WHERE transaction_id IS NULL) FROM t
UNION ALL SELECT 'tx_customer_id_too_long', count(*) FILTER (WHERE length(customer_id) > 255) FROM t
UNION ALL SELECT 'tx_f_name_too_long', count(*) FILTER (WHERE length(f_name) > 100) FROM t
UNION ALL SELECT 'tx_l_name_too_long', count(*) FILTER (WHERE length(l_name) > 100) FROM t
UNION ALL SELECT 'tx_address_too_long', count(*) FILTER (WHERE length(address) > 500) FROM t
UNION ALL SELECT 'tx_category_too_long', count(*) FILTER (WHERE length(category) > 100) FROM t
UNION ALL SELECT 'tx_sub_category_too_long', count(*) FILTER (WHERE length(sub_category) > 100) FROM t
UNION ALL SELECT 'tx_month_name_too_long', count(*) FILTER (WHERE length(month_name) > 20) FROM t
UNION ALL SELECT 'tx_day_of_week_too_long', count(*) FILTER (WHERE length(day_of_week) > 20) FROM t
UNION ALL SELECT 'tx_duplicate_transaction_id', coalesce(sum(n), 0)
  FROM (SELECT transaction_id, count(*) AS n FROM t WHERE transaction_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'tx_orphan_user_id', count(*) FROM t WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM u)
UNION ALL SELECT 'users_null_email', count(*) FILTER (WHERE email IS NULL) FROM u
UNION ALL SELECT 'users_null_user_id', count(*) FILTER (WHERE user_id IS NULL) FROM u
UNION ALL SELECT 'users_email_too_long', count(*) FILTER (WHERE length(email) > 255) FROM u
UNION ALL SELECT 'users_display_name_too_long', count(*) FILTER (WHERE length(display_name) > 255) FROM u
UNION ALL SELECT 'users_duplicate_email', coalesce(sum(n), 0)
  FROM (SELECT email, count(*) AS n FROM u WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'users_duplicate_user_id', coalesce(sum(n), 0)
  FROM (SELECT user_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1)
"""

ORACLE.update(
    {
        "clean_types": CLEAN_TYPES,
        "date_features": DATE_FEATURES,
        "dedup_keys": DEDUP_KEYS,
        "dedup_new_rows": DEDUP_NEW_ROWS,
        "dedup_report": DEDUP_REPORT,
        "append_history": APPEND_HISTORY,
        "user_upsert": USER_UPSERT,
        "constraint_violations": CONSTRAINTS,
        "user_ids_by_email": "WITH " + USERS0 + """
SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_custkey AS user_id
FROM customer WHERE c_custkey IN (SELECT user_id FROM users0)
""",
        "one_user_history": _with() + f"SELECT {TX_PRESENTED} FROM tx WHERE user_id = (SELECT min(user_id) FROM tx)",
        "clean_padded_names": CLEAN_TYPES,
        "surrogate_ids": _with() + """
SELECT transaction_id AS old_id, (SELECT max(transaction_id) FROM tx)
       + row_number() OVER (ORDER BY transaction_date, transaction_id) AS transaction_id
FROM tx
""",
        "catalog_tables": _with(USERS0) + """
SELECT 'transactions' AS table_name, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM tx
UNION ALL SELECT 'users', count(*), count(DISTINCT user_id) FROM users0
""",
        "folder_documents": "SELECT item_id, text || '|' AS text FROM benchmark",
    }
)


# --------------------------------------------------------------------------- JSON and statement text

TX_INSERT_PRESENTED = _with() + f"SELECT {INSERT_PRESENTED.format(desc='activity_description')} FROM tx"


def _js(name: str, expr: str, quoted: bool) -> str:
    q = "'\"'" if quoted else "''"
    return f"'\"{name}\":' || {q} || {expr} || {q}"


_TS = "strftime({c}, '%Y-%m-%dT%H:%M:%S.000')"
_JSON_FIELDS = [
    ("transaction_id", "CAST(transaction_id AS VARCHAR)", False),
    ("user_id", "CAST(user_id AS VARCHAR)", False),
    ("customer_id", "customer_id", True),
    ("f_name", "f_name", True),
    ("l_name", "l_name", True),
    ("address", "address", True),
    ("transaction_date", _TS.format(c="transaction_date"), True),
    ("posting_date", _TS.format(c="posting_date"), True),
    ("activity_description", "activity_description", True),
    ("category", "category", True),
    ("sub_category", "sub_category", True),
    ("amount_spent", "CAST(amount_spent AS VARCHAR)", False),
    ("credit_limit", "CAST(credit_limit AS VARCHAR)", False),
    ("available_credit", "CAST(available_credit AS VARCHAR)", False),
    ("is_subscription", "CASE WHEN is_subscription THEN 'true' ELSE 'false' END", False),
    ("month", "CAST(month AS VARCHAR)", False),
    ("day", "CAST(day AS VARCHAR)", False),
    ("month_name", "month_name", True),
    ("day_of_week", "day_of_week", True),
    ("year", "CAST(year AS VARCHAR)", False),
]
JSON_EXPORT = _with() + (
    "SELECT transaction_id, user_id, '{' || "
    + " || ',' || ".join(_js(n, e, q) for n, e, q in _JSON_FIELDS)
    + " || '}' AS record FROM tx"
)

STATEMENT_EXTRACT = _with() + """
SELECT user_id, CAST(transaction_date AS DATE) AS transaction_date, CAST(posting_date AS DATE) AS posting_date,
       activity_description, CAST(amount_spent AS DOUBLE) AS amount_spent,
       CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(available_credit AS DOUBLE) AS available_credit
FROM tx
"""

STATEMENT_RECORDS = _with("""stm AS (
  SELECT *, CASE WHEN month <= 6 THEN 6 ELSE 12 END AS half FROM tx
)""") + """
SELECT user_id, 'customer_' || split_part(customer_id, '#', 2) AS customer_id, 'Customer' AS f_name,
       split_part(customer_id, '#', 2) AS l_name, '' AS address,
       CAST(transaction_date AS DATE) AS transaction_date, CAST(posting_date AS DATE) AS posting_date,
       activity_description, 'Other' AS category, 'Other' AS sub_category,
       CAST(amount_spent AS DOUBLE) AS amount_spent, CAST(credit_limit AS DOUBLE) AS credit_limit,
       CAST(first_value(available_credit) OVER w + sum(amount_spent) OVER w - first_value(amount_spent) OVER w AS DOUBLE)
         AS available_credit,
       false AS is_subscription, month, day, month_name, day_of_week, year
FROM stm
WINDOW w AS (PARTITION BY user_id, year, half ORDER BY transaction_date, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

STATEMENT_INGEST = _with(UPLOAD, """every AS (
  SELECT user_id, transaction_date, activity_description, amount_spent, false AS fresh FROM hist
  UNION ALL SELECT user_id, transaction_date, activity_description, amount_spent, true FROM flagged WHERE NOT dup
), rec AS (
  SELECT user_id, activity_description,
    count(DISTINCT date_trunc('month', transaction_date)) >= 3
      AND (max(amount_spent) - min(amount_spent)) * count(*) * 100 <= 5 * sum(amount_spent) AS is_rec
  FROM every WHERE amount_spent > 0 GROUP BY user_id, activity_description
)""") + """
SELECT e.user_id, CAST(transaction_date AS DATE) AS transaction_date, e.activity_description,
       CAST(amount_spent AS DOUBLE) AS amount_spent, coalesce(is_rec AND amount_spent > 0, false) AS is_subscription
FROM every e LEFT JOIN rec r ON e.user_id = r.user_id AND e.activity_description = r.activity_description
WHERE fresh
"""

ORACLE.update(
    {
        "json_extract": TX_INSERT_PRESENTED,
        "json_export_roundtrip": TX_INSERT_PRESENTED,
        "statement_pages": _with() + """
SELECT user_id, year AS statement_year, CASE WHEN month <= 6 THEN 6 ELSE 12 END AS statement_month,
       CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_body_pages, count(*) AS n_lines
FROM tx GROUP BY ALL
""",
        "statement_records": STATEMENT_RECORDS,
        "statement_ingest": STATEMENT_INGEST,
        "json_export": JSON_EXPORT,
        "statement_extract": STATEMENT_EXTRACT,
    }
)


# --------------------------------------------------------------------------- enrichment rules

# Expected values, written out: the merchant word behind each part name (by transaction_id mod 13)
# and the pair it must give. No part name holds a rule's word itself.
SHOPS = """shops AS (
  SELECT * FROM (VALUES
    (0, 'Grocery', 'Living Expenses', 'Groceries'),
    (1, '*COFFEE* 12', 'Living Expenses', 'Dining Out'),
    (2, 'uber eats', 'Living Expenses', 'Dining Out'),
    (3, 'Uber trip', 'Living Expenses', 'Transportation'),
    (4, 'gas  station', 'Living Expenses', 'Transportation'),
    (5, 'PARENT hub', 'Other', 'Other'),
    (6, 'SPRING', 'Other', 'Other'),
    (7, 'amazon coffee', 'Amazon', 'Amazon'),
    (8, '', 'Other', 'Other'),
    (9, 'monthly fee', 'Financial', 'Bank Fees'),
    (10, 'COFFEEHOUSE', 'Other', 'Other'),
    (11, 'Netflix', 'Subscriptions', 'Streaming'),
    (12, 'credit card payment', 'Financial', 'Credit Card Payments')
  ) v(k, word, c, s)
)"""
CATEGORISE = _with(SHOPS) + """
SELECT transaction_id, activity_description || ' ' || word AS activity_description, c AS category, s AS sub_category
FROM tx JOIN shops ON transaction_id % 13 = k
"""

# The category guide, written out in full.
GUIDE = """guide AS (
  SELECT * FROM (VALUES
    ('Living Expenses', 'Rent'), ('Living Expenses', 'Utilities'), ('Living Expenses', 'Groceries'),
    ('Living Expenses', 'Dining Out'), ('Living Expenses', 'Transportation'),
    ('Personal & Lifestyle', 'Clothing'), ('Personal & Lifestyle', 'Personal Care'),
    ('Personal & Lifestyle', 'Entertainment'), ('Personal & Lifestyle', 'Fitness'), ('Personal & Lifestyle', 'Travel'),
    ('Financial', 'Loan Payments'), ('Financial', 'Credit Card Payments'), ('Financial', 'Savings'),
    ('Financial', 'Insurance'), ('Financial', 'Bank Fees'),
    ('Healthcare', 'Doctor Visits'), ('Healthcare', 'Pharmacy'), ('Healthcare', 'Dental'), ('Healthcare', 'Vision'),
    ('Subscriptions', 'Streaming'), ('Subscriptions', 'Software'), ('Subscriptions', 'Memberships'),
    ('Amazon', 'Amazon'), ('Other', 'Other')
  ) v(c, s)
)"""
TAXONOMY_VIOLATIONS = _with(SHOPS, GUIDE) + """
SELECT category, sub_category, count(*) AS n_rows
FROM (SELECT CASE WHEN transaction_id % 3 = 0 THEN category ELSE c END AS category,
             CASE WHEN transaction_id % 3 = 0 THEN sub_category ELSE s END AS sub_category
      FROM tx JOIN shops ON transaction_id % 13 = k) m
WHERE NOT EXISTS (SELECT 1 FROM guide WHERE guide.c = m.category AND guide.s = m.sub_category)
GROUP BY category, sub_category
"""


CUSTOMER_IDS = """
SELECT c_custkey, split_part(c_name, '#', 1) AS f_name, split_part(c_name, '#', 2) AS l_name,
       lower(split_part(c_name, '#', 1) || '_' || split_part(c_name, '#', 2)) AS customer_id
FROM customer
"""

MERCHANT_NORMALISE = _with() + """
SELECT transaction_id,
  CASE transaction_id % 5
    WHEN 0 THEN activity_description || '* ' || address
    WHEN 1 THEN activity_description || ' #' || CAST(transaction_id AS VARCHAR)
    WHEN 2 THEN 'Amzn Mktp ' || activity_description
    WHEN 3 THEN activity_description || '*paypal'
    ELSE activity_description || '  ' || sub_category
  END AS raw_description,
  CASE transaction_id % 5 WHEN 2 THEN 'AMAZON' WHEN 3 THEN 'PAYPAL' ELSE activity_description END AS merchant
FROM tx
"""

RUNNING_CREDIT = _with() + """
SELECT transaction_id, user_id,
  CAST(first_value(available_credit) OVER w + sum(amount_spent) OVER w - first_value(amount_spent) OVER w AS DOUBLE)
    AS running_available_credit
FROM tx
WINDOW w AS (PARTITION BY user_id ORDER BY transaction_date, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

RUNNING_CREDIT_NULLS = _with() + """
SELECT transaction_id, user_id,
  CAST(first_value(available_credit) OVER w + sum(a) OVER w - first_value(a) OVER w AS DOUBLE) AS running_available_credit
FROM (SELECT *, CASE WHEN transaction_id % 7 = 0 THEN 0 ELSE amount_spent END AS a FROM tx) t
WINDOW w AS (PARTITION BY user_id ORDER BY transaction_date, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

RECURRING = _with() + """
SELECT user_id, activity_description AS merchant,
  count(DISTINCT date_trunc('month', transaction_date)) AS n_months, count(*) AS n_transactions,
  CAST(min(amount_spent) AS DOUBLE) AS min_amount, CAST(max(amount_spent) AS DOUBLE) AS max_amount,
  CAST(sum(amount_spent) AS DOUBLE) / count(*) AS avg_amount,
  count(DISTINCT date_trunc('month', transaction_date)) >= 3
    AND (max(amount_spent) - min(amount_spent)) * count(*) * 100 <= 5 * sum(amount_spent) AS is_recurring
FROM tx WHERE amount_spent > 0 AND activity_description IS NOT NULL
GROUP BY user_id, activity_description
"""

SPENDING_HABITS = _with(SEL, EXP) + """
SELECT user_id, category, sub_category, n_transactions, CAST(s AS DOUBLE) AS total_spent,
       CAST(s AS DOUBLE) / n_transactions AS avg_spent,
       CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY user_id) AS DOUBLE) AS share
FROM (SELECT user_id, category, sub_category, count(*) AS n_transactions, sum(amount_spent) AS s
      FROM exp WHERE category IS NOT NULL AND sub_category IS NOT NULL
      GROUP BY user_id, category, sub_category) g
"""

ORACLE.update(
    {
        "customer_ids": CUSTOMER_IDS,
        "merchant_normalise": MERCHANT_NORMALISE,
        "categorise": CATEGORISE,
        "categorise_many_rules": CATEGORISE,
        "taxonomy_violations": TAXONOMY_VIOLATIONS,
        "running_available_credit": RUNNING_CREDIT,
        "running_available_credit_nulls": RUNNING_CREDIT_NULLS,
        "recurring_merchants": RECURRING,
        "spending_habits": SPENDING_HABITS,
    }
)

INCREMENTAL_INGEST = """
SELECT user_id, 'user_' || CAST(user_id AS VARCHAR) AS customer_id, 'user' AS f_name,
  CAST(user_id AS VARCHAR) AS l_name, '' AS address,
  CAST(ts AS DATE) AS transaction_date, CAST(ts AS DATE) AS posting_date,
  upper(event_type) AS activity_description, 'Other' AS category, 'Other' AS sub_category,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount_spent,
  CAST(NULL AS DOUBLE) AS credit_limit, CAST(NULL AS DOUBLE) AS available_credit,
  event_type = 'purchase' AS is_subscription,
  CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  monthname(ts) AS month_name, dayname(ts) AS day_of_week, CAST(year(ts) AS INTEGER) AS year
FROM events
"""
ORACLE["incremental_ingest"] = INCREMENTAL_INGEST
ORACLE["ingest_same_bytes_two_users"] = (
    f"{INCREMENTAL_INGEST} UNION ALL SELECT * REPLACE (user_id + 1000000 AS user_id) FROM ({INCREMENTAL_INGEST})"
)
ORACLE["ingest_quarantine"] = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'stored' WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed'
                               ELSE CASE WHEN trim(text) = '' THEN 'empty' ELSE 'not_an_array' END END AS reason
FROM documents WHERE doc_id % 5 <> 1
"""

_RECORD = "'{' || " + " || ',' || ".join(_js(n, e, q) for n, e, q in _JSON_FIELDS) + " || '}'"

ORACLE.update(
    {
        "daily_spend_vs_payments_per_user": _with(SEL) + """
SELECT user_id, CAST(transaction_date AS DATE) AS transaction_date,
       CAST(sum(CASE WHEN amount_spent > 0 THEN amount_spent END) AS DOUBLE) AS daily_spending,
       CAST(sum(CASE WHEN amount_spent < 0 THEN -amount_spent END) AS DOUBLE) AS daily_payments
FROM sel WHERE transaction_date IS NOT NULL
GROUP BY 1, 2
HAVING daily_spending IS NOT NULL OR daily_payments IS NOT NULL
""",
        "adviser_payloads": _with(SEL) + f"""
SELECT user_id, n // 10000 AS part,
       '[' || string_agg({_RECORD}, ',' ORDER BY n) || ']' AS payload, count(*) AS n_records
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date, transaction_id) - 1 AS n FROM sel) s
GROUP BY user_id, n // 10000
""",
        "extraction_quarantine": r"""
SELECT doc_id,
  CASE doc_id % 7 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 4 THEN 'null_record'
    ELSE CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty'
              WHEN NOT regexp_matches(text, '^\s*[`json]*\s*\[') THEN 'not_an_array' ELSE 'malformed' END END AS reason
FROM documents
WHERE doc_id % 7 <> 5
""",
    }
)

ORACLE["recurring_flags"] = _with("""rec AS (
  SELECT user_id, activity_description,
    count(DISTINCT date_trunc('month', transaction_date)) >= 3
      AND (max(amount_spent) - min(amount_spent)) * count(*) * 100 <= 5 * sum(amount_spent) AS is_rec
  FROM tx WHERE amount_spent > 0 AND activity_description IS NOT NULL
  GROUP BY user_id, activity_description
)""") + """
SELECT t.transaction_id, t.user_id, t.activity_description,
       coalesce(r.is_rec AND t.amount_spent > 0, false) AS is_recurring
FROM tx t LEFT JOIN rec r ON t.user_id = r.user_id AND t.activity_description = r.activity_description
"""

ORACLE["typing_failures"] = """
SELECT 'transaction_date' AS column_name,
       count(*) FILTER (WHERE o_orderkey % 8 = 3 AND day(o_orderdate) > 12) AS failures
FROM orders
UNION ALL
SELECT 'amount_spent', count(*) FILTER (WHERE o_orderkey % 6 IN (1, 3)) FROM orders
"""

# Recurring charges over all rows, as if none had been stored before the others.
_ALL_RECURRING = """rec AS (
  SELECT user_id, activity_description,
    count(DISTINCT date_trunc('month', transaction_date)) >= 3
      AND (max(amount_spent) - min(amount_spent)) * count(*) * 100 <= 5 * sum(amount_spent) AS is_rec
  FROM tx WHERE amount_spent > 0 AND activity_description IS NOT NULL
  GROUP BY user_id, activity_description
)"""
ORACLE["statement_stream"] = _with(_ALL_RECURRING) + """
SELECT t.user_id, CAST(t.transaction_date AS DATE) AS transaction_date, t.activity_description,
       CAST(t.amount_spent AS DOUBLE) AS amount_spent, coalesce(r.is_rec AND t.amount_spent > 0, false) AS is_subscription
FROM tx t LEFT JOIN rec r ON t.user_id = r.user_id AND t.activity_description = r.activity_description
"""
ORACLE["recurring_state"] = RECURRING

# Expected names, written out.
ORACLE["merchant_tokens"] = _with() + """
SELECT transaction_id,
  CASE transaction_id % 7
    WHEN 0 THEN activity_description || ' ' || address
    WHEN 1 THEN lower(activity_description) || ' ' || address || ' ' || printf('%06d', transaction_id)
    WHEN 2 THEN 'Uber  trip ' || address
    WHEN 3 THEN 'Schubert Hall ' || address
    WHEN 4 THEN activity_description || '* ' || sub_category
    WHEN 5 THEN 'PayPal *' || activity_description
    ELSE 'Tuberia #' || CAST(transaction_id AS VARCHAR)
  END AS raw_description,
  CASE transaction_id % 7 WHEN 2 THEN 'UBER' WHEN 3 THEN 'SCHUBERT HALL' WHEN 5 THEN 'PAYPAL' WHEN 6 THEN 'TUBERIA'
                          ELSE activity_description END AS merchant
FROM tx
"""

ORACLE["emptied_tables"] = _with(USERS0) + """,
n AS (SELECT 'transactions' AS table_name, (SELECT count(*) FROM tx) AS n UNION ALL SELECT 'users', (SELECT count(*) FROM users0))
SELECT step, table_name, CASE WHEN step IN (1, 3) THEN 0 WHEN step < 5 THEN n END AS n_rows
FROM n, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
"""

ORACLE["constraint_ingest"] = """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id,
       ['stored', 'customer_id_too_long', 'out_of_range', 'null_user_id', 'unknown_user'][c_custkey % 5 + 1] AS outcome
FROM customer
"""

# From the rollup as from the rows.
ORACLE.update({f"rollup_{name}": ORACLE[key] for name, key in {
    "overview_per_user": "overview_kpis_per_user", "daily_series": "daily_spend_vs_payments", "monthly_totals": "monthly_totals",
    "weekday_totals_per_user": "weekday_totals_per_user", "top10_merchants_per_user": "top10_merchants_per_user",
}.items()})

ORACLE["user_store"] = ORACLE["user_upsert"]
