"""The registered queries as plain SQL, to compare results with another engine.

Written on its own, from the meaning of each query rather than from the operators: joins
at row level, DISTINCT counts, window ranks over whole tables.
"""

from __future__ import annotations

import re

VIEWS = {
    "v_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
            CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                ELSE 'canceled' END AS order_status,
            o_orderdate AS order_purchase_timestamp,
            CASE WHEN o_orderkey % 50 <> 0
                THEN o_orderdate + to_hours(CAST(o_orderkey % 31 AS int)) END AS order_approved_at,
            CASE WHEN o_orderstatus = 'F' AND o_orderkey % 41 <> 0
                THEN o_orderdate + to_days(CAST(o_orderkey % 120 AS int))
                    + to_hours(CAST(o_orderkey % 24 AS int)) END AS order_delivered_customer_date
        FROM orders""",
    "v_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
            l_suppkey AS seller_id, CAST(l_extendedprice AS decimal(18,2)) AS price,
            CAST(CAST(l_quantity AS decimal(10,2)) * CAST(l_tax AS decimal(10,2))
                AS decimal(18,2)) AS freight_value
        FROM lineitem""",
    "v_payments": """
        SELECT l_orderkey AS order_id, l_returnflag AS payment_type,
            sum(CAST(l_extendedprice AS decimal(18,2))) AS payment_value,
            count(*) AS payment_installments
        FROM lineitem GROUP BY l_orderkey, l_returnflag""",
    "v_customers": """
        SELECT c_custkey AS customer_id,
            CASE WHEN c_custkey % 97 <> 0 THEN c_mktsegment END AS customer_city,
            n_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_geolocation": """
        SELECT c_mktsegment AS geolocation_city, n_name AS geolocation_state,
            CASE WHEN n_nationkey < 20 THEN CAST(c_custkey % 180 AS double) - 90 END
                AS geolocation_lat,
            CASE WHEN n_nationkey < 20 THEN CAST((c_custkey * 7) % 360 AS double) - 180 END
                AS geolocation_lng
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_products": """
        SELECT p_partkey AS product_id,
            CASE WHEN p_partkey % 25 <> 0 THEN p_type END AS product_category_name,
            CAST(length(p_name) AS bigint) AS product_name_lenght,
            p_size AS product_photos_qty, p_retailprice AS product_weight_g
        FROM part""",
    "v_translation": """
        SELECT DISTINCT p_type AS product_category_name,
            lower(p_type) AS product_category_name_english
        FROM part WHERE p_type <> 'PROMO'""",
    "v_reviews": """
        SELECT o_orderkey * 2 + k AS review_id, o_orderkey AS order_id,
            CAST(CASE WHEN k = 0 THEN CAST(substring(o_orderpriority, 1, 1) AS int)
                ELSE 6 - CAST(substring(o_orderpriority, 1, 1) AS int) END AS int) AS review_score,
            CASE WHEN o_orderkey % 4 <> 0 THEN source END AS review_comment_title,
            text AS review_comment_message,
            o_orderdate + to_days(CAST(14 + k AS int)) AS review_creation_date
        FROM orders LEFT JOIN documents ON o_orderkey = doc_id
            JOIN (VALUES (0), (1)) AS copies(k) ON
                k = 0 AND NOT (o_orderstatus = 'P' AND doc_id IS NULL)
                OR k = 1 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
    "v_period": """
        SELECT *, strftime(order_purchase_timestamp, '%Y-%m') AS year_month FROM v_orders
        WHERE CAST(order_purchase_timestamp AS date)
            BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "v_previous": """
        SELECT * FROM v_orders WHERE CAST(order_purchase_timestamp AS date)
            BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    "v_period_payments": """
        SELECT * FROM v_period LEFT JOIN v_payments USING (order_id)""",
    "v_rfm": """
        SELECT customer_id,
            CAST(floor(date_diff('second', max(order_purchase_timestamp),
                (SELECT max(order_purchase_timestamp) FROM v_period)) / 86400) AS bigint)
                AS recency,
            count(DISTINCT order_id) AS frequency,
            CAST(coalesce(sum(payment_value), 0) AS double) AS monetary
        FROM v_period_payments WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "v_scores": """
        WITH ranked AS (
            SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
                count(*) OVER () AS total FROM v_rfm),
        edges AS (
            SELECT quantile_cont(CAST(recency AS double), [0.2, 0.4, 0.6, 0.8]) AS r,
                quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM v_rfm),
        scored AS (
            SELECT customer_id, recency, frequency, monetary,
                CAST(5 - len(list_filter(r, lambda e: e < recency)) AS int) AS R_score,
                CAST(1 + len(list_filter([0.2, 0.4, 0.6, 0.8],
                    lambda p: f_rank > 1 + (total - 1) * CAST(p AS double))) AS int) AS F_score,
                CAST(1 + len(list_filter(m, lambda e: e < monetary)) AS int) AS M_score
            FROM ranked, edges)
        SELECT *, concat(R_score, F_score, M_score) AS RFM_Score FROM scored""",
    # Segment of each score code.
    "v_segments": """
        SELECT *, CASE
            WHEN RFM_Score IN ('555','554','544','545','454','455','445') THEN 'Champions'
            WHEN RFM_Score IN ('543','444','435','355','354','345','344','335')
                THEN 'Loyal Customers'
            WHEN RFM_Score IN ('553','551','552','541','542','533','532','531','452','451')
                THEN 'Potential Loyalists'
            WHEN RFM_Score IN ('512','511','422','421','412','411','311') THEN 'New Customers'
            WHEN RFM_Score IN ('155','154','144','214','215','115','114') THEN 'At Risk'
            ELSE 'Others' END AS segment
        FROM v_scores""",
    "v_mix": """
        SELECT segment, count(*) AS n,
            CAST(count(*) AS double) / CAST(sum(count(*)) OVER () AS double) * 100 AS pct
        FROM v_segments GROUP BY segment""",
    "v_states": """
        SELECT customer_state, count(order_id) AS total_orders,
            CAST(coalesce(sum(payment_value), 0) AS double) AS total_revenue
        FROM v_period_payments LEFT JOIN v_customers USING (customer_id)
        WHERE customer_state IS NOT NULL GROUP BY customer_state""",
    "v_cities_geo": """
        SELECT customer_city, customer_state, total_orders, unique_customers,
            p.lat AS geolocation_lat, p.lng AS geolocation_lng
        FROM (
            SELECT customer_city, customer_state, count(DISTINCT order_id) AS total_orders,
                count(DISTINCT customer_id) AS unique_customers
            FROM v_period LEFT JOIN v_customers USING (customer_id)
            WHERE customer_city IS NOT NULL AND customer_state IS NOT NULL GROUP BY ALL)
        LEFT JOIN (
            SELECT geolocation_city, geolocation_state,
                min({'lat': geolocation_lat, 'lng': geolocation_lng}) AS p
            FROM v_geolocation WHERE geolocation_lat IS NOT NULL AND geolocation_lng IS NOT NULL
            GROUP BY ALL)
        ON customer_city = geolocation_city AND customer_state = geolocation_state""",
    "v_states_geo": """
        SELECT customer_state, total_orders, p.lat AS geolocation_lat, p.lng AS geolocation_lng
        FROM (
            SELECT customer_state, count(DISTINCT order_id) AS total_orders
            FROM v_period LEFT JOIN v_customers USING (customer_id)
            WHERE customer_state IS NOT NULL GROUP BY ALL)
        LEFT JOIN (
            SELECT geolocation_state, min({'lat': geolocation_lat, 'lng': geolocation_lng}) AS p
            FROM v_geolocation WHERE geolocation_lat IS NOT NULL AND geolocation_lng IS NOT NULL
            GROUP BY ALL)
        ON customer_state = geolocation_state""",
    "v_ltv": """
        SELECT customer_id, CAST(coalesce(sum(payment_value), 0) AS double) AS total_spent,
            count(DISTINCT order_id) AS order_count
        FROM v_period_payments WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "v_sold": """
        SELECT * FROM v_items LEFT JOIN v_products USING (product_id)
        WHERE order_id IN (SELECT order_id FROM v_period)""",
    "v_categories": """
        SELECT product_category_name AS category, count(order_item_id) AS total_items_sold,
            CAST(sum(price) AS double) AS total_revenue,
            count(DISTINCT product_id) AS unique_products
        FROM v_sold WHERE product_category_name IS NOT NULL GROUP BY product_category_name""",
    "v_funnel": """
        SELECT *, CAST(n_click AS double) / nullif(n_view, 0) AS click_rate,
            CAST(n_purchase AS double) / nullif(n_click, 0) AS purchase_rate,
            CAST(n_purchase AS double) / nullif(n_view, 0) AS overall_conversion
        FROM (
            SELECT CAST(ts AS date) AS day,
                count(DISTINCT user_id) FILTER (event_type = 'view') AS n_view,
                count(DISTINCT user_id) FILTER (event_type = 'click') AS n_click,
                count(DISTINCT user_id) FILTER (event_type = 'purchase') AS n_purchase
            FROM events WHERE event_type IN ('view', 'click', 'purchase') AND ts IS NOT NULL
            GROUP BY ALL)""",
    "v_delivered": """
        SELECT * EXCLUDE (year_month), CAST(floor(date_diff('second', order_approved_at,
            order_delivered_customer_date) / 86400) AS bigint) AS delivery_time
        FROM v_period WHERE order_status = 'delivered' AND order_approved_at IS NOT NULL
            AND order_delivered_customer_date IS NOT NULL""",
    "v_sellers": """
        SELECT seller_id,
            CAST(sum(delivery_time) AS double) / CAST(count(*) AS double) AS avg_delivery_time,
            count(DISTINCT order_id) AS order_volume
        FROM v_delivered JOIN v_items USING (order_id)
        WHERE seller_id IS NOT NULL GROUP BY seller_id HAVING count(DISTINCT order_id) >= 5""",
    "v_enriched": """
        SELECT * FROM v_reviews LEFT JOIN v_items USING (order_id)
            LEFT JOIN v_products USING (product_id)
            LEFT JOIN v_translation USING (product_category_name)""",
    "v_large": """
        SELECT * FROM v_enriched WHERE product_category_name_english = 'large'
            AND review_score IN (1, 2, 3, 4, 5)""",
    "v_product_sales": """
        SELECT product_id, count(order_item_id) AS sales_volume,
            sum(price) AS total_revenue
        FROM v_items WHERE order_id IN (SELECT order_id FROM v_period) GROUP BY product_id""",
    "v_quadrants": """
        SELECT *, CASE
            WHEN sales_volume <= x_cut AND total_revenue > y_cut THEN 'Quick Wins'
            WHEN sales_volume > x_cut AND total_revenue > y_cut THEN 'Strategic Projects'
            WHEN sales_volume <= x_cut THEN 'Fill-ins' ELSE 'Avoid' END AS quadrant
        FROM v_product_sales, (
            SELECT CAST(sum(sales_volume) AS double) / count(*) AS x_cut,
                CAST(sum(total_revenue) AS double) / count(*) AS y_cut FROM v_product_sales)""",
    "v_picks": """
        SELECT * FROM (
            SELECT product_id, sales_volume, total_revenue, quadrant, 1 AS pick,
                CAST(row_number() OVER (ORDER BY total_revenue DESC, product_id) AS int) AS rank
            FROM v_quadrants WHERE quadrant = 'Quick Wins') WHERE rank <= 3
        UNION ALL
        SELECT * FROM (
            SELECT product_id, sales_volume, total_revenue, quadrant, 2 AS pick,
                CAST(row_number() OVER (ORDER BY sales_volume DESC, product_id) AS int) AS rank
            FROM v_quadrants WHERE quadrant = 'Strategic Projects') WHERE rank <= 2""",
    "v_summary": """
        SELECT
            (SELECT CAST(sum(payment_value) AS double) FROM v_period_payments) AS total_revenue,
            (SELECT count(DISTINCT order_id) FROM v_period) AS total_orders,
            (SELECT count(DISTINCT customer_id) FROM v_period) AS total_customers,
            (SELECT CAST(sum(payment_value) AS double) / count(payment_value)
                FROM v_period_payments) AS avg_order_value,
            (SELECT CAST(count(*) AS double) / count(DISTINCT customer_id) FROM v_period
                WHERE customer_id IS NOT NULL) AS orders_per_customer,
            (SELECT category FROM v_categories ORDER BY total_items_sold DESC, category LIMIT 1)
                AS top_category,
            (SELECT max(total_revenue) FROM v_categories) AS category_revenue""",
    "v_roi": """
        SELECT *, CASE WHEN monthly_increase > 0 THEN 1000000.0::double / monthly_increase
                ELSE 'infinity'::double END AS payback_months,
            (annual_increase - 1000000.0::double) / 1000000.0::double * 100 AS roi_pct
        FROM (SELECT *, monthly_increase * 12 AS annual_increase FROM (
            SELECT scope, CASE WHEN revenue > 0 THEN revenue / 12 ELSE 1000000.0::double END
                * 0.25::double AS monthly_increase
            FROM (SELECT customer_state AS scope, total_revenue AS revenue FROM v_states
                  UNION ALL SELECT 'all', total_revenue FROM v_summary)))""",
}

HISTOGRAM = """
    SELECT b.bin, lo + (b.bin - 1) * ((hi - lo) / {bins}) AS lo,
        lo + b.bin * ((hi - lo) / {bins}) AS hi, coalesce(n, 0) AS n{extra}
    FROM (SELECT range AS bin FROM range(1, {bins} + 1)) b,
        (SELECT min(x) AS lo, max(x) AS hi FROM xs)
    LEFT JOIN (
        SELECT CASE WHEN hi > lo
            THEN least({bins}, 1 + CAST(floor((x - lo) * {bins} / (hi - lo)) AS bigint))
            ELSE 1 END AS bin, count(*) AS n
        FROM xs, (SELECT min(x) AS lo, max(x) AS hi FROM xs) GROUP BY ALL) c ON b.bin = c.bin"""

REVIEW_COLUMNS = """order_id, review_id, review_score, review_comment_title,
    review_comment_message, review_creation_date, product_category_name, product_id,
    order_item_id, seller_id, price, freight_value, product_name_lenght, product_photos_qty,
    product_weight_g, product_category_name_english"""

KPIS = """CAST(sum(review_score) AS double) / count(review_score) AS avg_rating,
    count(DISTINCT review_id) AS total_reviews,
    coalesce(CAST(count(*) FILTER (review_score >= 4) AS double)
        / nullif(count(DISTINCT review_id), 0) * 100, 0) AS positive_pct,
    CAST(sum(price) AS double) / count(price) AS avg_price"""

ROI_MONTHS = """SELECT scope AS customer_state, CAST(month AS int) AS month, monthly_increase,
    annual_increase, monthly_increase * month AS cumulative_revenue,
    1000000.0::double AS investment, monthly_increase * month - 1000000.0::double AS net_benefit,
    roi_pct, payback_months
    FROM v_roi, (SELECT range AS month FROM range(1, 13)) WHERE scope <> 'all'"""


def _comments(condition: str) -> str:
    return f"""SELECT concat(review_score, '/5') AS rating,
        coalesce(review_comment_title, '-') AS title,
        CASE WHEN length(review_comment_message) > 200
            THEN concat(substring(review_comment_message, 1, 200), '...')
            ELSE review_comment_message END AS comment,
        review_creation_date AS date
        FROM v_large WHERE review_comment_message IS NOT NULL AND {condition}
        ORDER BY review_id, order_id LIMIT 5"""


def _loaded(table: str, source: str, columns: str) -> str:
    values = " + ".join(f"count({c})" for c in columns.split())
    return f"""SELECT '{table}' AS "table", count(*) AS n_rows, {values} AS n_values
        FROM {source}"""


def _key_check(table: str, source: str, key: str) -> str:
    return f"""SELECT '{table}' AS "table",
        (SELECT count(*) FROM {source} WHERE {key} IS NULL) AS null_keys,
        (SELECT count(*) FROM (SELECT {key} FROM {source} WHERE {key} IS NOT NULL
            GROUP BY {key} HAVING count(*) > 1)) AS repeated_keys"""


QUERIES = {
    "q01_load_tables": " UNION ALL ".join((
        _loaded("orders", "v_orders", "order_id customer_id order_status "
                "order_purchase_timestamp order_approved_at order_delivered_customer_date"),
        _loaded("order_items", "v_items",
                "order_id order_item_id product_id seller_id price freight_value"),
        _loaded("order_payments", "v_payments",
                "order_id payment_type payment_value payment_installments"),
        _loaded("order_reviews", "v_reviews", "review_id order_id review_score "
                "review_comment_title review_comment_message review_creation_date"),
        _loaded("products", "v_products", "product_id product_category_name "
                "product_name_lenght product_photos_qty product_weight_g"),
        _loaded("product_cat", "v_translation",
                "product_category_name product_category_name_english"),
        _loaded("customers", "v_customers", "customer_id customer_city customer_state"),
        _loaded("sellers", "supplier", "s_suppkey s_name s_nationkey s_acctbal"),
        _loaded("geolocation", "v_geolocation", "geolocation_city geolocation_state "
                "geolocation_lat geolocation_lng"),
        _loaded("leads_qualified", "events", "event_id ts user_id event_type value props"),
        _loaded("leads_closed", "labels", "doc_id quality toxic"),
    )),
    "q01_key_violations": " UNION ALL ".join((
        _key_check("orders", "v_orders", "order_id"),
        _key_check("customers", "v_customers", "customer_id"),
        _key_check("products", "v_products", "product_id"),
        _key_check("product_cat", "v_translation", "product_category_name"),
    )),
    "q01_quarantined_rows": """
        SELECT 'order_items' AS "table", count(*) FILTER (order_id % 100 <> 0) AS n_rows,
            count(*) FILTER (order_id % 100 <> 0) * 2 + count(order_item_id) FILTER (order_id % 100 <> 0)
            + count(product_id) FILTER (order_id % 100 <> 0) + count(seller_id) FILTER (order_id % 100 <> 0)
            + count(price) FILTER (order_id % 100 <> 0) - count(*) FILTER (order_id % 100 <> 0 AND freight_value IS NULL) AS n_values,
            count(*) FILTER (order_id % 100 = 0) AS n_quarantined
        FROM v_items
        UNION ALL
        SELECT 'order_payments', count(*) FILTER (order_id % 100 <> 0),
            sum(1 + (payment_type IS NOT NULL)::int + (payment_value IS NOT NULL)::int + (payment_installments IS NOT NULL)::int)
                FILTER (order_id % 100 <> 0),
            count(*) FILTER (order_id % 100 = 0)
        FROM v_payments""",
    "q02_period_columns": """
        SELECT *, strftime(order_purchase_timestamp, '%Y-%m') AS month,
            CAST(year(order_purchase_timestamp) AS int) AS year,
            strftime(order_purchase_timestamp, '%Y-%m') AS year_month
        FROM v_orders""",
    "q03_orders_with_payments": "SELECT * FROM v_orders LEFT JOIN v_payments USING (order_id)",
    "q04_orders_with_items": "SELECT * FROM v_orders LEFT JOIN v_items USING (order_id)",
    "q05_period_bounds": """
        SELECT CAST(min(order_purchase_timestamp) AS date) AS min_date,
            CAST(max(order_purchase_timestamp) AS date) AS max_date FROM v_orders""",
    "q06_filter_period": "SELECT * EXCLUDE (year_month) FROM v_period",
    "q06_month_folders": "SELECT * EXCLUDE (year_month) FROM v_period",
    "q07_bucketed_items": """
        SELECT * FROM v_items WHERE order_id IN (SELECT order_id FROM v_period)""",
    "q07_restrict_to_orders": """
        SELECT * FROM v_items WHERE order_id IN (SELECT order_id FROM v_period)""",
    "q08_previous_period": "SELECT * FROM v_previous",
    "q08_previous_payments": """
        SELECT * FROM v_payments WHERE order_id IN (SELECT order_id FROM v_previous)""",
    "q09_period_kpis": """
        WITH sides AS (
            SELECT 'current' AS side, v_period.order_id, customer_id, payment_value
            FROM v_period LEFT JOIN v_payments USING (order_id)
            UNION ALL
            SELECT 'previous', v_previous.order_id, customer_id, payment_value
            FROM v_previous LEFT JOIN v_payments USING (order_id)),
        kpis AS (
            SELECT side, CAST(sum(payment_value) AS double) AS revenue,
                CAST(count(DISTINCT order_id) AS double) AS orders,
                CAST(count(DISTINCT customer_id) AS double) AS customers,
                CAST(sum(payment_value) AS double) / count(payment_value) AS avg_order_value
            FROM sides GROUP BY side),
        long AS (UNPIVOT kpis ON revenue, orders, customers, avg_order_value
            INTO NAME metric VALUE v),
        wide AS (
            SELECT metric, max(v) FILTER (side = 'current') AS current,
                max(v) FILTER (side = 'previous') AS previous FROM long GROUP BY metric),
        grown AS (
            SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous * 100 END
                AS growth_pct FROM wide)
        SELECT *, CASE WHEN growth_pct IS NULL THEN 'N/A'
            WHEN growth_pct < 999 THEN printf('%.1f%%', growth_pct)
            ELSE '999%+' END AS growth_label FROM grown""",
    "q10_growth": """
        WITH monthly AS (
            SELECT strftime(order_purchase_timestamp, '%Y-%m') AS year_month,
                CAST(coalesce(sum(payment_value), 0) AS double) AS revenue
            FROM v_orders LEFT JOIN v_payments USING (order_id) GROUP BY ALL),
        grown AS (
            SELECT m.year_month, m.revenue, p.revenue AS previous,
                CASE WHEN p.revenue > 0 THEN (m.revenue - p.revenue) / p.revenue * 100 END
                    AS growth_pct
            FROM monthly m LEFT JOIN monthly p ON p.year_month = concat(
                CAST(CAST(substring(m.year_month, 1, 4) AS int) - 1 AS varchar),
                substring(m.year_month, 5)))
        SELECT *, CASE WHEN growth_pct IS NULL THEN 'N/A'
            WHEN growth_pct < 999 THEN printf('%.1f%%', growth_pct)
            ELSE '999%+' END AS growth_label FROM grown""",
    "q11_monthly_orders_revenue": """
        SELECT year_month, count(DISTINCT order_id) AS orders,
            CAST(coalesce(sum(payment_value), 0) AS double) AS revenue
        FROM v_period_payments GROUP BY year_month""",
    "q12_orders_per_customer": """
        SELECT coalesce(CAST(count(DISTINCT order_id) AS double)
            / nullif(count(DISTINCT customer_id), 0) * 100, 0) AS value FROM v_period""",
    "q13_avg_items_per_order": """
        SELECT avg(n) AS value FROM (
            SELECT order_id, count(order_item_id) AS n
            FROM v_period LEFT JOIN v_items USING (order_id) GROUP BY order_id)""",
    "q14_top_payment_method": """
        SELECT payment_type, count(*) AS n FROM v_payments GROUP BY payment_type
        ORDER BY n DESC, payment_type LIMIT 1""",
    "q15_new_vs_returning": """
        WITH firsts AS (
            SELECT customer_id, min(order_purchase_timestamp) AS first FROM v_period
            GROUP BY customer_id)
        SELECT year_month, CASE WHEN year_month = strftime(first, '%Y-%m') THEN 'New'
            ELSE 'Returning' END AS customer_type, count(*) AS n
        FROM v_period JOIN firsts USING (customer_id) GROUP BY ALL""",
    "q16_state_orders_revenue": "SELECT * FROM v_states",
    "q16_top_states": """
        SELECT * FROM v_states ORDER BY total_orders DESC, customer_state LIMIT 5""",
    "q17_category_items_sold": """
        SELECT product_category_name AS Category, count(order_item_id) AS items_sold
        FROM v_items LEFT JOIN v_products USING (product_id)
        WHERE product_category_name IS NOT NULL GROUP BY product_category_name""",
    "q17_top_categories": """
        SELECT product_category_name AS Category, count(order_item_id) AS items_sold
        FROM v_items LEFT JOIN v_products USING (product_id)
        WHERE product_category_name IS NOT NULL GROUP BY product_category_name
        ORDER BY items_sold DESC, Category LIMIT 3""",
    "q18_rfm_base": "SELECT * FROM v_rfm",
    "q19_rfm_scores": "SELECT * FROM v_scores",
    "q20_rfm_segments": "SELECT * FROM v_segments",
    "q21_segment_mix": "SELECT * FROM v_mix",
    "q21_segment_summary": """
        SELECT segment AS top_segment, pct AS segment_pct,
            (SELECT count(*) FROM v_mix) AS total_segments
        FROM v_mix ORDER BY n DESC, segment LIMIT 1""",
    "q22_city_orders_geo": "SELECT * FROM v_cities_geo",
    "q22_top_cities": """
        SELECT * FROM v_cities_geo
        ORDER BY total_orders DESC, customer_city, customer_state LIMIT 10""",
    "q23_state_orders_geo": "SELECT * FROM v_states_geo",
    "q23_top_states_geo": """
        SELECT * FROM v_states_geo ORDER BY total_orders DESC, customer_state LIMIT 5""",
    "q24_customer_ltv": "SELECT * FROM v_ltv",
    "q25_ltv_summary": """
        SELECT CAST(sum(CAST(total_spent AS decimal(38,2))) AS double) / count(*) AS avg_clv,
            median(total_spent) AS median_clv, avg(order_count) AS avg_freq,
            count(*) FILTER (order_count > 1) AS repeat_customers,
            CAST(count(*) FILTER (order_count > 1) AS double) / count(*) * 100 AS repeat_rate
        FROM v_ltv""",
    "q26_ltv_histogram": "WITH xs AS (SELECT total_spent AS x FROM v_ltv)"
        + HISTOGRAM.format(bins=50, extra=""),
    "q26_order_count_histogram":
        "WITH xs AS (SELECT CAST(order_count AS double) AS x FROM v_ltv)"
        + HISTOGRAM.format(bins=20, extra=""),
    "q27_payment_mix": """
        SELECT payment_type, count(*) AS n,
            CAST(count(*) AS double) / CAST(sum(count(*)) OVER () AS double) * 100 AS pct
        FROM v_payments WHERE payment_type IS NOT NULL GROUP BY payment_type""",
    "q28_payment_trend": """
        SELECT year_month, payment_type, count(*) AS n FROM v_period_payments
        WHERE payment_type IS NOT NULL GROUP BY ALL""",
    "q29_top_state": """
        SELECT customer_state, count(*) AS n
        FROM v_period LEFT JOIN v_customers USING (customer_id)
        WHERE customer_state IS NOT NULL GROUP BY customer_state
        ORDER BY n DESC, customer_state LIMIT 1""",
    "q30_category_performance": "SELECT * FROM v_categories",
    "q30_top_categories": """
        SELECT * FROM v_categories ORDER BY total_revenue DESC, category LIMIT 3""",
    "q30_category_summary": """
        SELECT category AS top_category, total_revenue AS top_revenue,
            (SELECT count(*) FROM v_categories) AS total_categories
        FROM v_categories ORDER BY total_revenue DESC, category LIMIT 1""",
    "q31_product_rating_sales": """
        WITH sales AS (
            SELECT product_id, product_category_name AS category,
                count(order_item_id) AS sales_volume, CAST(sum(price) AS double) AS total_revenue
            FROM v_sold WHERE product_category_name IS NOT NULL GROUP BY ALL),
        ratings AS (
            SELECT product_id, CAST(sum(review_score) AS double) / nullif(count(review_score), 0)
                AS avg_rating
            FROM v_items LEFT JOIN v_reviews USING (order_id) GROUP BY product_id)
        SELECT product_id, category, sales_volume, total_revenue,
            product_name_lenght AS name_length, product_photos_qty AS photos_qty,
            product_weight_g AS weight_g, avg_rating
        FROM sales LEFT JOIN v_products USING (product_id) LEFT JOIN ratings USING (product_id)""",
    "q32_funnel_rates": "SELECT * FROM v_funnel",
    "q32_funnel_overall": """
        SELECT *, CAST(n_click AS double) / nullif(n_view, 0) AS click_rate,
            CAST(n_purchase AS double) / nullif(n_click, 0) AS purchase_rate,
            CAST(n_purchase AS double) / nullif(n_view, 0) AS overall_conversion
        FROM (
            SELECT count(DISTINCT user_id) FILTER (event_type = 'view') AS n_view,
                count(DISTINCT user_id) FILTER (event_type = 'click') AS n_click,
                count(DISTINCT user_id) FILTER (event_type = 'purchase') AS n_purchase
            FROM events)""",
    "q32_funnel_summary": """
        SELECT CAST(sum(n_view) AS bigint) AS total_view,
            CAST(sum(n_click) AS bigint) AS total_click,
            CAST(sum(n_purchase) AS bigint) AS total_purchase,
            round(avg(click_rate), 9) AS avg_click_rate,
            round(avg(purchase_rate), 9) AS avg_purchase_rate,
            round(avg(overall_conversion), 9) AS avg_overall_conversion
        FROM v_funnel""",
    "q33_top_funnel": """
        SELECT * FROM v_funnel ORDER BY purchase_rate DESC NULLS LAST, day LIMIT 10""",
    "q34_delivered_orders": "SELECT * FROM v_delivered",
    "q35_delivery_kpis": """
        SELECT coalesce((SELECT avg(delivery_time) FROM v_delivered), 0) AS avg_delivery_time,
            CAST(count(*) FILTER (order_status = 'delivered') AS double) / count(*) * 100
                AS delivery_rate
        FROM v_period""",
    "q36_delivery_quartiles": """
        SELECT quantile_cont(CAST(delivery_time AS double), 0.25) AS q25,
            quantile_cont(CAST(delivery_time AS double), 0.75) AS q75 FROM v_delivered""",
    "q37_freight_totals": """
        SELECT (SELECT CAST(sum(freight_value) AS double) FROM v_items) AS total_freight_cost,
            CAST(sum(f) AS double) / count(*) AS avg_freight_per_order
        FROM (SELECT order_id, sum(freight_value) AS f FROM v_items GROUP BY order_id)""",
    "q38_describe_freight": """
        SELECT count(freight_value) AS count,
            CAST(sum(freight_value) AS double) / count(freight_value) AS mean,
            round(stddev_samp(CAST(freight_value AS double)), 9) AS std,
            CAST(min(freight_value) AS double) AS min,
            quantile_cont(CAST(freight_value AS double), 0.25) AS q25,
            quantile_cont(CAST(freight_value AS double), 0.5) AS q50,
            quantile_cont(CAST(freight_value AS double), 0.75) AS q75,
            CAST(max(freight_value) AS double) AS max
        FROM v_items""",
    "q39_delivery_time_distribution":
        "WITH xs AS (SELECT CAST(delivery_time AS double) AS x FROM v_delivered"
        " WHERE delivery_time <= 100)"
        + HISTOGRAM.format(bins=30, extra=", (SELECT avg(x) FROM xs) AS avg_delivery_time"),
    "q40_freight_distribution": """
        WITH positive AS (
            SELECT CAST(freight_value AS double) AS x FROM v_items WHERE freight_value > 0),
        xs AS (
            SELECT x FROM positive WHERE x <= (SELECT quantile_cont(x, 0.95) FROM positive))"""
        + HISTOGRAM.format(bins=30, extra=", (SELECT median(x) FROM xs) AS median_freight"),
    "q41_seller_performance": "SELECT * FROM v_sellers",
    "q42_seller_sample": "SELECT * FROM v_sellers ORDER BY seller_id LIMIT 50",
    "q43_fastest_sellers": """
        SELECT seller_id, round_even(avg_delivery_time, 1) AS avg_delivery_time, order_volume
        FROM (SELECT * FROM v_sellers ORDER BY avg_delivery_time, seller_id LIMIT 10)""",
    "q43_slowest_sellers": """
        SELECT seller_id, round_even(avg_delivery_time, 1) AS avg_delivery_time, order_volume
        FROM (SELECT * FROM v_sellers ORDER BY avg_delivery_time DESC, seller_id LIMIT 10)""",
    "q44_payment_summary": """
        WITH top AS (
            SELECT payment_type, count(*) AS n FROM v_payments WHERE payment_type IS NOT NULL
            GROUP BY payment_type ORDER BY n DESC, payment_type LIMIT 1)
        SELECT (SELECT payment_type FROM top) AS top_payment,
            CAST((SELECT n FROM top) AS double) / count(*) * 100 AS payment_pct,
            CAST(sum(payment_value) AS double) / count(payment_value) AS avg_payment_value,
            avg(payment_installments) AS avg_installments
        FROM v_payments""",
    "q45_order_status_summary": """
        SELECT order_status, count(*) AS n, round_even(CAST(count(*) AS double)
            / CAST(sum(count(*)) OVER () AS double) * 100, 1) AS pct
        FROM v_period WHERE order_status IS NOT NULL GROUP BY order_status""",
    "q46_reviews_enriched": f"SELECT {REVIEW_COLUMNS} FROM v_enriched",
    "q47_review_categories": """
        SELECT DISTINCT product_category_name_english FROM v_enriched
        WHERE product_category_name_english IS NOT NULL""",
    "q48_filter_reviews": f"""
        SELECT {REVIEW_COLUMNS} FROM v_enriched
        WHERE product_category_name_english = 'large' AND review_score IN (4, 5)""",
    "q49_review_kpis": f"SELECT {KPIS} FROM v_large",
    "q49_review_kpis_by_category": f"""
        SELECT product_category_name_english, {KPIS} FROM v_enriched
        WHERE product_category_name_english IS NOT NULL GROUP BY product_category_name_english""",
    "q50_rating_distribution": """
        SELECT review_score, count(*) AS n FROM v_large WHERE review_score IS NOT NULL
        GROUP BY review_score""",
    "q51_sentiment_mix": """
        SELECT 'positive' AS sentiment, count(*) FILTER (review_score >= 4) AS n FROM v_large
        UNION ALL SELECT 'neutral', count(*) FILTER (review_score = 3) FROM v_large
        UNION ALL SELECT 'negative', count(*) FILTER (review_score <= 2) FROM v_large""",
    "q52_review_trend": """
        SELECT strftime(review_creation_date, '%Y-%m') AS year_month,
            count(review_id) AS n_reviews,
            CAST(sum(review_score) AS double) / count(review_score) AS avg_score,
            CAST(sum(review_score) AS double) / count(review_score) * 10 AS avg_score_x10
        FROM v_large WHERE review_creation_date IS NOT NULL GROUP BY ALL""",
    "q53_rating_by_calendar_month": """
        SELECT CAST(month(review_creation_date) AS int) AS month,
            strftime(review_creation_date, '%b') AS month_name,
            CAST(sum(review_score) AS double) / count(review_score) AS avg_score
        FROM v_large WHERE review_creation_date IS NOT NULL GROUP BY ALL""",
    "q54_rating_by_weekday": """
        SELECT dayname(review_creation_date) AS weekday,
            CAST(sum(review_score) AS double) / count(review_score) AS avg_score
        FROM v_large WHERE review_creation_date IS NOT NULL GROUP BY ALL""",
    "q55_positive_comments": _comments("review_score >= 4"),
    "q55_negative_comments": _comments("review_score <= 2"),
    "q56_search_reviews": f"""
        SELECT {REVIEW_COLUMNS} FROM v_enriched
        WHERE coalesce(regexp_matches(review_comment_title, 'licen[cs]e|un+g der', 'i'), false)
            OR coalesce(regexp_matches(review_comment_message, 'licen[cs]e|un+g der', 'i'), false)""",
    "q56_search_literal": f"""
        SELECT {REVIEW_COLUMNS} FROM v_enriched
        WHERE coalesce(contains(lower(review_comment_title), 'license'), false)
            OR coalesce(contains(lower(review_comment_message), 'license'), false)""",
    **{
        f"q57_sort_by_{by}": f"SELECT {REVIEW_COLUMNS} FROM v_large"
        for by in ("date", "score", "score_asc", "price", "price_asc")
    },
    "q57_review_page": """
        SELECT * FROM (
            SELECT row_number() OVER (ORDER BY review_score DESC NULLS LAST, review_id NULLS FIRST, order_id NULLS FIRST,
                order_item_id NULLS FIRST, product_id NULLS FIRST, seller_id NULLS FIRST) - 1 AS position,
                review_id, order_id, order_item_id, review_score, price
            FROM v_enriched)
        WHERE position BETWEEN 80 AND 99""",
    "q15_customers_by_month": """
        SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, count(DISTINCT customer_id) AS customers, true AS is_close
        FROM v_orders GROUP BY 1""",
    "q58_review_display": """
        SELECT concat('⭐ ', review_score, '/5') AS "Rating",
            coalesce(review_comment_title, '(Tanpa Judul)') AS "Judul Ulasan",
            CASE WHEN review_comment_message IS NULL THEN '(Tidak ada komentar)'
                WHEN length(review_comment_message) > 150
                THEN concat(substring(review_comment_message, 1, 150), '...')
                ELSE review_comment_message END AS "Isi Ulasan",
            review_creation_date AS "Tanggal",
            CASE WHEN price IS NULL THEN '-'
                ELSE format('€ {:,}.{:02d}', CAST(floor(price) AS bigint),
                    CAST(price * 100 AS bigint) % 100) END AS "Harga (€)"
        FROM v_enriched""",
    "q59_review_extremes": """
        SELECT count(*) FILTER (review_score = 5) AS excellent,
            count(*) FILTER (review_score <= 2) AS poor FROM v_large""",
    **{
        f"q60_export_{fmt}": """
            SELECT review_score, review_comment_title, review_comment_message,
                review_creation_date, price FROM v_enriched"""
        for fmt in ("csv", "json")
    },
    "q61_business_summary": "SELECT * FROM v_summary",
    "q62_quadrant_topk": "SELECT * FROM v_picks",
    "q63_roi_projection": ROI_MONTHS,
    "q64_report": """
        SELECT concat(
            '{"Current Performance":{"Total Revenue":"€ ',
            format('{:,}', CAST(round_even(total_revenue, 0) AS bigint)),
            '","Total Orders":"', format('{:,}', total_orders),
            '","Unique Customers":"', format('{:,}', total_customers),
            '","Average Order Value":"€ ',
            format('{:,}', CAST(round_even(avg_order_value, 0) AS bigint)),
            '"},"Top Recommendations":[',
            (SELECT string_agg(concat('{"product_id":', product_id, ',"sales_volume":',
                sales_volume, ',"total_revenue":', total_revenue, ',"quadrant":"', quadrant,
                '"}'), ',' ORDER BY pick, rank) FROM v_picks),
            '],"ROI Projections":{"Investment":"€ 1,000,000","Expected ROI":"',
            printf('%.1f', roi_pct), '%","Payback Period":"', printf('%.1f', payback_months),
            ' months","Annual Revenue Increase":"€ ',
            format('{:,}', CAST(round_even(annual_increase, 0) AS bigint)), '"}}') AS report
        FROM v_summary, (SELECT * FROM v_roi WHERE scope = 'all')""",
}


def oracle_sql() -> dict[str, str]:
    """Each query with the views it needs in front."""
    return {name: _with_views(sql) for name, sql in QUERIES.items()}


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    views = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    if sql.startswith("WITH "):
        return f"WITH {views}, {sql[5:]}"
    return f"WITH {views} {sql}"
