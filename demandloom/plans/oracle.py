"""DuckDB reference text: named CTEs over the star-schema views, written independently of Spark."""

from __future__ import annotations

# name -> (CTE names it reads, SQL)
CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs, sql.strip())


def rounded(value: str, digits: int) -> str:
    """Half to even on the scaled value."""
    return f"round_even({value} * 1e{digits}, 0) / 1e{digits}"


def with_ctes(needs: str, select: str) -> str:
    """``WITH RECURSIVE`` text holding all CTEs the query needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for inner in CTES[name][0].split():
                visit(inner)
            ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return select
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{select}"


# --- inputs --------------------------------------------------------------------------

cte(
    "sales_hourly",
    "",
    """
SELECT l_suppkey % 11 AS gln, l_partkey AS ean_code, CAST(l_shipdate AS DATE) AS date,
       l_linenumber AS from_hour, l_linenumber + 1 AS to_hour, l_quantity AS quantity,
       l_quantity * (4.6e0 + 1.5e0 * (l_partkey % 40)) * (1 - 2 * l_discount) AS net_sales,
       l_quantity * (4.6e0 + 1.5e0 * (l_partkey % 40)) * (1 - 2 * l_discount) * l_tax AS tax_amount,
       l_quantity * (4.6e0 + 1.5e0 * (l_partkey % 40)) * (1 - 2 * l_discount) * 0.3e0 AS gross_margin
FROM lineitem""",
)
cte("ean_map", "", "SELECT p_partkey AS ean_code, p_partkey % 40 AS gb_id FROM part")
cte(
    "campaign",
    "",
    """
SELECT p_partkey % 40 AS gb_id,
       DATE '1995-01-02' + CAST(p_partkey * 37 % 2400 AS INTEGER) AS from_date,
       DATE '1995-01-02' + CAST(p_partkey * 37 % 2400 + p_size % 14 AS INTEGER) AS to_date,
       -0.2e0 AS discount,
       4.6e0 + 1.5e0 * (p_partkey % 40) AS standard_price,
       (4.6e0 + 1.5e0 * (p_partkey % 40)) * 0.8e0 AS campaign_price
FROM part WHERE p_partkey < 120""",
)
cte(
    "markdown_periods",
    "",
    """
SELECT DATE '1995-01-02' + CAST(100 * n_nationkey AS INTEGER) AS from_date,
       DATE '1995-01-02' + CAST(100 * n_nationkey + 6 AS INTEGER) AS to_date, 1 AS kronemarked
FROM nation""",
)

# --- cleaning ------------------------------------------------------------------------

cte(
    "mapped",
    "sales_hourly ean_map",
    """
SELECT s.gln, m.gb_id, s.date, s.from_hour, s.to_hour,
       CAST(round_even(s.quantity, 0) AS BIGINT) AS quantity, s.net_sales, s.tax_amount, s.gross_margin
FROM (SELECT DISTINCT * FROM sales_hourly) s
JOIN (SELECT DISTINCT ean_code, gb_id FROM ean_map) m USING (ean_code)""",
)
cte(
    "hourly",
    "mapped",
    """
SELECT gln, gb_id, date, from_hour, to_hour, quantity, (round_even((net_sales) * 1e3, 0) / 1e3) AS net_sales,
       (round_even((tax_amount) * 1e3, 0) / 1e3) AS tax_amount, (round_even((gross_margin) * 1e3, 0) / 1e3) AS gross_margin,
       (round_even(((net_sales + tax_amount) / nullif(quantity, 0)) * 1e3, 0) / 1e3) AS unit_price
FROM (SELECT gln, gb_id, date, from_hour, to_hour, CAST(sum(quantity) AS BIGINT) AS quantity,
             CAST(sum(CAST(round_even(net_sales * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS net_sales, CAST(sum(CAST(round_even(tax_amount * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS tax_amount, CAST(sum(CAST(round_even(gross_margin * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS gross_margin
      FROM mapped GROUP BY ALL)""",
)
cte(
    "daily",
    "mapped",
    """
SELECT *, (round_even(((net_sales + tax_amount) / nullif(quantity, 0)) * 1e3, 0) / 1e3) AS unit_price
FROM (SELECT gln, gb_id, date, CAST(sum(quantity) AS BIGINT) AS quantity,
             (round_even((CAST(sum(CAST(round_even(net_sales * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6) * 1e3, 0) / 1e3) AS net_sales, (round_even((CAST(sum(CAST(round_even(tax_amount * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6) * 1e3, 0) / 1e3) AS tax_amount,
             (round_even((CAST(sum(CAST(round_even(gross_margin * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6) * 1e3, 0) / 1e3) AS gross_margin
      FROM mapped GROUP BY gln, gb_id, date)""",
)
cte(
    "dispersion",
    "hourly",
    """
SELECT gln, gb_id, date, (round_even((m) * 1e3, 0) / 1e3) AS mean_price, (round_even((s) * 1e3, 0) / 1e3) AS std_price, (round_even((s / m) * 1e3, 0) / 1e3) AS rel_diff
FROM (SELECT gln, gb_id, date, avg(unit_price) AS m, stddev_samp(unit_price) AS s
      FROM hourly GROUP BY gln, gb_id, date)
WHERE (round_even((s / m) * 1e3, 0) / 1e3) > 0.15e0""",
)
cte(
    "suspicious",
    "daily",
    """
SELECT * FROM daily
WHERE unit_price < 5 OR unit_price > 65 OR (quantity = 0 AND net_sales + tax_amount <> 0)""",
)

# --- prices and promotions -----------------------------------------------------------

cte(
    "priced",
    "daily",
    """
SELECT *, CASE WHEN price_error AND ref_price IS NOT NULL THEN ref_price ELSE unit_price END AS corrected_unit_price,
       price_error AND ref_price IS NOT NULL AS price_corrected_flag,
       CASE WHEN price_error AND ref_store_price IS NOT NULL THEN 'store_median'
            WHEN price_error AND ref_price IS NOT NULL THEN 'global_median'
            WHEN price_error THEN 'uncorrected_missing_reference' END AS price_correction_source
FROM (
  SELECT d.*, s.ref_store_price, g.ref_global_price,
         coalesce(s.ref_store_price, g.ref_global_price) AS ref_price,
         coalesce(d.unit_price < 5 OR d.unit_price > 65 OR (d.quantity = 0 AND d.net_sales + d.tax_amount <> 0),
                  FALSE) AS price_error
  FROM daily d
  LEFT JOIN (SELECT gln, gb_id, median(unit_price) AS ref_store_price FROM daily
             WHERE date >= (SELECT max(date) FROM daily) - 30 GROUP BY gln, gb_id) s USING (gln, gb_id)
  LEFT JOIN (SELECT gb_id, median(unit_price) AS ref_global_price FROM daily GROUP BY gb_id) g USING (gb_id))""",
)
cte(
    "numbered",
    "daily",
    """
SELECT gb_id, gln, date, unit_price, row_number() OVER (PARTITION BY gb_id ORDER BY date, gln) AS rn FROM daily""",
)
cte(
    "machine",
    "numbered",
    """
SELECT gb_id, rn, FALSE AS promo, unit_price AS std, 0e0 AS disc FROM numbered WHERE rn = 1
UNION ALL
SELECT n.gb_id, n.rn,
       CASE WHEN m.promo THEN n.unit_price / m.std <= 0.97e0 ELSE n.unit_price / m.std < 0.9e0 END,
       CASE WHEN m.promo AND n.unit_price / m.std > 0.97e0 THEN n.unit_price
            WHEN NOT m.promo AND n.unit_price / m.std >= 0.9e0 AND abs(n.unit_price / m.std - 1) > 0.05e0
            THEN n.unit_price ELSE m.std END,
       CASE WHEN m.promo AND n.unit_price / m.std <= 0.97e0 THEN n.unit_price / m.std - 1
            WHEN NOT m.promo AND n.unit_price / m.std < 0.9e0 THEN n.unit_price / m.std - 1 ELSE 0e0 END
FROM machine m JOIN numbered n ON n.gb_id = m.gb_id AND n.rn = m.rn + 1""",
)
cte(
    "promoted",
    "priced numbered machine",
    """
SELECT p.*, m.std AS standard_price, m.promo AS on_promotion,
       (round_even((CASE WHEN NOT m.promo OR abs(m.disc) < 1e-6 THEN 0e0 ELSE m.disc END) * 1e4, 0) / 1e4) AS discount
FROM priced p JOIN numbered n USING (gb_id, gln, date) JOIN machine m USING (gb_id, rn)""",
)
cte(
    "campaign_joined",
    "promoted campaign",
    """
SELECT s.*, coalesce(c.discount, 0e0) AS declared_discount,
       coalesce(c.standard_price, 0e0) AS declared_standard_price,
       coalesce(c.campaign_price, 0e0) AS declared_campaign_price,
       c.discount IS NOT NULL AS declared_promotion,
       coalesce(c.from_date, DATE '0001-01-01') AS c_from, coalesce(c.to_date, DATE '0001-01-01') AS c_to
FROM promoted s LEFT JOIN campaign c ON c.gb_id = s.gb_id AND s.date BETWEEN c.from_date AND c.to_date""",
)
cte(
    "joined",
    "campaign_joined markdown_periods",
    """
SELECT s.*, coalesce(CAST(k.kronemarked AS BOOLEAN), FALSE) AS kronemarked,
       coalesce(k.from_date, DATE '0001-01-01') AS k_from
FROM campaign_joined s LEFT JOIN markdown_periods k ON s.date BETWEEN k.from_date AND k.to_date""",
)
cte(
    "flagged",
    "joined",
    """
SELECT * REPLACE ((round_even((unit_price) * 1e2, 0) / 1e2) AS unit_price, (round_even((standard_price) * 1e2, 0) / 1e2) AS standard_price,
                  (round_even((declared_standard_price) * 1e2, 0) / 1e2) AS declared_standard_price),
       declared_promotion OR on_promotion AS promo_combined,
       (declared_promotion OR on_promotion)
         AND (round_even((standard_price) * 1e2, 0) / 1e2) IS DISTINCT FROM (round_even((declared_standard_price) * 1e2, 0) / 1e2) AS differs
FROM joined""",
)
cte(
    "reconciled",
    "flagged",
    """
SELECT * EXCLUDE (raw, differs, new_standard) REPLACE (
         new_standard AS standard_price,
         (round_even((CASE WHEN NOT promo_combined AND NOT coalesce(raw <= -0.01e0, FALSE) THEN 0e0 ELSE raw END) * 1e4, 0) / 1e4) AS discount),
       coalesce(raw <= -0.01e0, FALSE) AS on_promotion_recomputed,
       coalesce(abs((CASE WHEN NOT promo_combined AND NOT coalesce(raw <= -0.01e0, FALSE) THEN 0e0 ELSE raw END)
                    - declared_discount) > 0.05e0, FALSE) AS conflict
FROM (SELECT *, CASE WHEN abs((unit_price - new_standard) / nullif(new_standard, 0)) < 1e-6 THEN 0e0
                     ELSE (unit_price - new_standard) / nullif(new_standard, 0) END AS raw
      FROM (SELECT *, CASE WHEN differs AND unit_price < declared_standard_price THEN declared_standard_price
                           ELSE standard_price END AS new_standard FROM flagged))""",
)

# --- calendar ------------------------------------------------------------------------

cte(
    "easter",
    "daily",
    """
SELECT y, make_date(y, ((h + l - 7 * m + 114) // 31), ((h + l - 7 * m + 114) % 31) + 1) AS easter
FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m
      FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l
            FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h
                  FROM (SELECT *, (b - f + 1) // 3 AS g
                        FROM (SELECT y, y % 19 AS a, y // 100 AS b, (y // 100) // 4 AS d, (y // 100) % 4 AS e,
                                     (y // 100 + 8) // 25 AS f, (y % 100) // 4 AS i, (y % 100) % 4 AS k
                              FROM (SELECT unnest(range((SELECT year(min(date)) FROM daily),
                                                        (SELECT year(max(date)) FROM daily) + 1)) AS y))))))""",
)
cte(
    "holidays",
    "easter",
    """
SELECT holiday_date, array_to_string(list_sort(list(name)), '; ') AS holiday_name
FROM (
  SELECT make_date(y, 1, 1) AS holiday_date, 'Første nyttårsdag' AS name FROM easter
  UNION ALL SELECT make_date(y, 5, 1), 'Arbeidernes dag' FROM easter
  UNION ALL SELECT make_date(y, 5, 17), 'Grunnlovsdag' FROM easter
  UNION ALL SELECT make_date(y, 12, 25), 'Første juledag' FROM easter
  UNION ALL SELECT make_date(y, 12, 26), 'Andre juledag' FROM easter
  UNION ALL SELECT easter - 3, 'Skjærtorsdag' FROM easter
  UNION ALL SELECT easter - 2, 'Langfredag' FROM easter
  UNION ALL SELECT easter, 'Første påskedag' FROM easter
  UNION ALL SELECT easter + 1, 'Andre påskedag' FROM easter
  UNION ALL SELECT easter + 39, 'Kristi himmelfartsdag' FROM easter
  UNION ALL SELECT easter + 49, 'Første pinsedag' FROM easter
  UNION ALL SELECT easter + 50, 'Andre pinsedag' FROM easter)
GROUP BY holiday_date""",
)
cte(
    "holiday_types",
    "holidays",
    """
SELECT *, CASE WHEN regexp_matches(lower(holiday_name), 'påske|langfredag|skjærtorsdag') THEN 'Easter'
               WHEN lower(holiday_name) LIKE '%pinse%' THEN 'Pentecost'
               WHEN lower(holiday_name) LIKE '%jul%' THEN 'Christmas'
               WHEN lower(holiday_name) LIKE '%nyttår%' THEN 'NewYear'
               WHEN lower(holiday_name) LIKE '%grunnlov%' THEN 'NationalDay'
               WHEN lower(holiday_name) LIKE '%arbeider%' THEN 'LaborDay' ELSE 'Other' END AS holiday_type
FROM holidays""",
)
cte("dates", "daily", "SELECT DISTINCT date FROM daily")
cte(
    "closed",
    "holidays dates",
    """
SELECT holiday_date AS closed_date FROM holidays
UNION SELECT date FROM dates WHERE isodow(date) = 7 AND weekofyear(date) < 49""",
)
cte(
    "holiday_dim",
    "dates closed holiday_types",
    """
SELECT date,
  (SELECT count(*) FROM closed WHERE closed_date > date AND closed_date <= date + 3) AS closed_in_last_3_days,
  (SELECT count(*) FROM closed WHERE closed_date < date AND closed_date >= date - 4) AS closed_in_next_4_days,
  coalesce((SELECT arg_max(holiday_type, holiday_date) FROM holiday_types WHERE holiday_date <= date), 'None')
    AS last_holiday_type,
  coalesce((SELECT arg_min(holiday_type, holiday_date) FROM holiday_types WHERE holiday_date >= date), 'None')
    AS next_holiday_type,
  (SELECT min(abs(holiday_date - date)) FROM holiday_types) AS days_to_nearest_holiday,
  CASE WHEN date IN (SELECT holiday_date FROM holidays) THEN 1 ELSE 0 END AS is_holiday
FROM dates""",
)
CALENDAR = """
isodow(date) - 1 AS day_of_week_num, sin(2 * pi() * (isodow(date) - 1) / 7) AS sin_dow,
cos(2 * pi() * (isodow(date) - 1) / 7) AS cos_dow, dayofyear(date) AS day_of_year,
sin(2 * pi() * dayofyear(date) / 365) AS sin_day, cos(2 * pi() * dayofyear(date) / 365) AS cos_day,
month(date) AS month, quarter(date) AS quarter""".strip()

# --- features ------------------------------------------------------------------------

cte(
    "sales_daily",
    "reconciled holiday_dim",
    f"""
SELECT s.*, h.* EXCLUDE (date), dayname(s.date) AS day_of_week, {CALENDAR.replace('(date)', '(s.date)')},
  coalesce(p.promotion_count, 0) AS promotion_count,
  coalesce(avg(quantity) OVER past7, 0) AS avg_last_7_sales,
  coalesce(stddev_samp(quantity) OVER past7, 0) AS std_last_7_sales,
  coalesce(sum(CAST(on_promotion AS INTEGER)) OVER past7, 0) AS promotion_days_count_last_7,
  coalesce(avg(quantity) OVER weekday5, avg(quantity) OVER (PARTITION BY gln, gb_id)) AS rolling_mean,
  coalesce(sum(CAST(on_promotion AS INTEGER)) OVER weekday5, 0) AS promotion_days_count_rolling,
  coalesce(avg(quantity) OVER past5, avg(quantity) OVER (PARTITION BY gln, gb_id)) AS rolling_mean_all,
  coalesce(lag(CASE WHEN gb_id = 7 THEN quantity END) OVER
           (PARTITION BY gln ORDER BY s.date, gb_id, c_from, c_to, k_from), 0) AS gb_id_previous_day
FROM reconciled s
JOIN holiday_dim h ON h.date = s.date
LEFT JOIN (SELECT gln AS p_gln, date AS p_date, count(*) AS promotion_count FROM reconciled
           WHERE on_promotion GROUP BY gln, date) p ON p_gln = gln AND p_date = s.date
WINDOW past7 AS (PARTITION BY gln, gb_id ORDER BY s.date, c_from, c_to, k_from
                 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       past5 AS (PARTITION BY gln, gb_id ORDER BY s.date, c_from, c_to, k_from
                 ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
       weekday5 AS (PARTITION BY gln, gb_id, isodow(s.date) ORDER BY s.date, c_from, c_to, k_from
                    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
cte(
    "store_daily",
    "sales_daily",
    f"""
SELECT *, {CALENDAR}
FROM (SELECT gln, date, CAST(sum(quantity) AS BIGINT) AS quantity, avg(unit_price) AS unit_price,
             coalesce(avg(discount), 0) AS discount, avg(CAST(on_promotion AS INTEGER)) AS on_promotion,
             max(CAST(kronemarked AS INTEGER)) AS kronemarked, avg(CAST(promo_combined AS INTEGER)) AS promo_combined,
             coalesce(avg(promotion_count), 0) AS promotion_count,
             max(closed_in_last_3_days) AS closed_in_last_3_days, max(closed_in_next_4_days) AS closed_in_next_4_days,
             max(is_holiday) AS is_holiday, coalesce(min(days_to_nearest_holiday), 0) AS days_to_nearest_holiday
      FROM sales_daily GROUP BY gln, date)""",
)
cte(
    "total",
    "store_daily",
    """
SELECT *, coalesce(rn - max(CASE WHEN kronemarked > 0 THEN rn END) OVER (PARTITION BY gln ORDER BY date), 999)
         AS days_since_last_kronemarked,
       coalesce(rn - max(CASE WHEN on_promotion > 0 THEN rn END) OVER (PARTITION BY gln ORDER BY date), 999)
         AS days_since_last_promotion
FROM (SELECT *, row_number() OVER w AS rn, coalesce(lag(quantity, 1) OVER w, 0) AS sales_lag_1,
             coalesce(lag(quantity, 7) OVER w, 0) AS sales_lag_7,
             coalesce(avg(quantity) OVER p7, 0) AS rolling_mean_7, coalesce(stddev_samp(quantity) OVER p7, 0) AS rolling_std_7,
             coalesce(avg(quantity) OVER p30, 0) AS rolling_mean_30, coalesce(stddev_samp(quantity) OVER p30, 0) AS rolling_std_30
      FROM store_daily
      WINDOW w AS (PARTITION BY gln ORDER BY date),
             p7 AS (PARTITION BY gln ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
             p30 AS (PARTITION BY gln ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""",
)
cte(
    "store_means",
    "sales_daily",
    """
SELECT gln, date, avg(discount) AS store_mean_discount, avg(corrected_unit_price) AS store_mean_price,
       avg(CAST(on_promotion AS INTEGER)) AS store_promo_rate, CAST(sum(quantity) AS BIGINT) AS store_total
FROM sales_daily GROUP BY gln, date""",
)
cte(
    "relative",
    "sales_daily store_means",
    """
SELECT s.*, m.* EXCLUDE (gln, date), discount - store_mean_discount AS discount_relative,
       (corrected_unit_price - store_mean_price) / (store_mean_price + 1e-6) AS price_relative,
       CAST(on_promotion AS INTEGER) * discount AS promo_boost
FROM sales_daily s JOIN store_means m USING (gln, date)""",
)
cte(
    "share",
    "relative",
    """
SELECT *, greatest(CAST(quantity AS DOUBLE) / store_total, 0) AS target FROM relative WHERE store_total > 0""",
)

# --- evaluation frames ---------------------------------------------------------------

cte(
    "grid",
    "daily",
    """
SELECT g.gln, g.gb_id, CAST(g.day AS DATE) AS date, coalesce(d.quantity, 0) AS target
FROM (SELECT gln, gb_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day
      FROM daily GROUP BY gln, gb_id) g
LEFT JOIN daily d ON d.gln = g.gln AND d.gb_id = g.gb_id AND d.date = CAST(g.day AS DATE)""",
)
cte(
    "evaluation",
    "daily grid",
    """
SELECT d.gb_id || '_' || d.gln AS item_id, d.gln, d.gb_id, d.date,
       CAST(d.quantity AS DOUBLE) AS y_true, CAST(g.target AS DOUBLE) AS y_pred
FROM daily d JOIN grid g ON g.gln = d.gln AND g.gb_id = d.gb_id AND g.date = d.date - 7""",
)
