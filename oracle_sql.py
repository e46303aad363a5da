"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement builds the star from the raw TPC-H-like views (region, nation,
part, supplier, lineitem) and computes one analysis on it. Money is carried in
integer cents and every rounded decimal is computed with integer arithmetic
(``(2*num*10^d + den) // (2*den)`` is ``num/den`` rounded half up to ``d``
places for ``num >= 0, den > 0``), so the values equal Spark's exact decimals
after both sides are converted to DOUBLE.
"""

from __future__ import annotations

STAR = """
WITH dim_store AS (
    SELECT CAST(n.n_nationkey AS INTEGER) AS store_sk, n.n_name AS store_id, r.r_name AS region
    FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
), dim_product AS (
    SELECT CAST(MIN(p_partkey) AS BIGINT) AS product_sk, p_name AS product_id,
           split_part(p_name, ' ', 2) AS category
    FROM part GROUP BY p_name
), ship_days AS (
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem
), dim_date AS (
    SELECT CAST(year(day) * 10000 + month(day) * 100 + day(day) AS INTEGER) AS date_sk, day AS cal_date,
           CAST(year(day) AS INTEGER) AS cal_year, CAST(month(day) AS INTEGER) AS cal_month
    FROM ship_days
), line_rows AS (
    SELECT CAST(year(l.l_shipdate) * 10000 + month(l.l_shipdate) * 100 + day(l.l_shipdate) AS INTEGER) AS date_sk,
           CAST(s.s_nationkey AS INTEGER) AS store_sk, dp.product_sk,
           (l.l_orderkey * 7 + l.l_partkey * 13 + l.l_suppkey * 5 + l.l_linenumber * 31) % 97 AS h,
           CAST(l.l_quantity AS INTEGER) AS qty, l.l_linenumber, l.l_returnflag, l.l_discount, l.l_shipdate,
           p.p_retailprice
    FROM lineitem l
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    JOIN part p ON p.p_partkey = l.l_partkey
    JOIN dim_product dp ON dp.product_id = p.p_name
), fact AS (
    SELECT date_sk, store_sk, product_sk,
           CAST(MAX(CASE WHEN h < 6 THEN 0 ELSE h END) AS INTEGER) AS stock,
           CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE qty END) AS INTEGER) AS sold,
           CAST(MAX(p_retailprice) AS DECIMAL(10, 2)) AS price,
           CAST(SUM(qty + l_linenumber - 4) AS DECIMAL(10, 2)) AS forecast,
           CAST(MAX(l_discount) AS DECIMAL(4, 2)) AS discount,
           CAST(MAX(CASE WHEN month(l_shipdate) IN (11, 12) THEN 1 ELSE 0 END) AS INTEGER) AS promo
    FROM line_rows GROUP BY date_sk, store_sk, product_sk
), fx AS (
    SELECT f.*, d.cal_date, d.cal_year, d.cal_month,
           CAST(f.price * 100 AS BIGINT) AS price_c,
           CAST(f.forecast * 100 AS BIGINT) AS forecast_c,
           CAST(f.discount * 100 AS BIGINT) AS discount_c
    FROM fact f JOIN dim_date d ON d.date_sk = f.date_sk
), last_day AS (
    SELECT MAX(cal_date) AS d FROM dim_date
)
"""


def _half_up(num: str, den: str, digits: int) -> str:
    """``num / den`` rounded half up to ``digits`` places, as an exact integer scaled by 10^digits."""
    return f"((CAST({num} AS HUGEINT) * {2 * 10 ** digits} + ({den})) // (2 * CAST({den} AS HUGEINT)))"


def _dbl(scaled: str, digits: int) -> str:
    """Integer scaled by 10^digits -> DOUBLE."""
    return f"(CAST({scaled} AS DOUBLE) / {10 ** digits})"


Q = {}

Q["q01_stock_status_current"] = """
SELECT s.store_id AS Store_ID, s.region AS Region, p.product_id AS Product_ID, p.category AS Category,
       CAST(x.stock AS BIGINT) AS Current_Stock,
       CASE WHEN x.stock = 0 THEN 'OUT OF STOCK' WHEN x.stock <= 10 THEN 'CRITICAL LOW'
            WHEN x.stock <= 50 THEN 'LOW STOCK' ELSE 'ADEQUATE' END AS Stock_Status
FROM fx x JOIN dim_store s USING (store_sk) JOIN dim_product p USING (product_sk)
WHERE x.cal_date = (SELECT d FROM last_day)
"""

Q["q02_stock_by_region_category"] = """
SELECT s.region AS Region, p.category AS Category, CAST(COUNT(*) AS BIGINT) AS Total_SKUs,
       CAST(SUM(x.stock) AS BIGINT) AS Total_Stock_Units,
       CAST(SUM(x.stock) // COUNT(x.stock) AS BIGINT) AS Avg_Stock_Per_SKU,
       CAST(MIN(x.stock) AS BIGINT) AS Min_Stock, CAST(MAX(x.stock) AS BIGINT) AS Max_Stock
FROM fx x JOIN dim_store s USING (store_sk) JOIN dim_product p USING (product_sk)
WHERE x.cal_date = (SELECT d FROM last_day)
GROUP BY s.region, p.category
"""

_RANKED_LATEST = """
, ranked AS (
    SELECT x.*, row_number() OVER (PARTITION BY x.store_sk, x.product_sk ORDER BY x.cal_date DESC, x.date_sk DESC) AS pos
    FROM fx x
), newest AS (SELECT * FROM ranked WHERE pos = 1)
"""

Q["q03_latest_stock_by_location"] = _RANKED_LATEST + """
SELECT s.region AS Region, p.category AS Category, s.store_id AS Store_ID, p.product_id AS Product_ID,
       CAST(n.stock AS BIGINT) AS Current_Stock_Level
FROM newest n JOIN dim_store s USING (store_sk) JOIN dim_product p USING (product_sk)
"""

Q["q04_low_days_of_supply"] = _RANKED_LATEST + f"""
, speed AS (
    SELECT product_sk, {_half_up('SUM(sold)', 'COUNT(sold)', 6)} AS avg6
    FROM fx WHERE sold > 0 GROUP BY product_sk
)
SELECT s.region AS Region, p.category AS Category, p.product_id AS Product_ID,
       CAST(n.stock AS BIGINT) AS Inventory_Level, {_dbl('v.avg6', 6)} AS Avg_Daily_Sales,
       CASE WHEN v.avg6 > 0 THEN {_dbl(_half_up('n.stock * 1000000', 'v.avg6', 6), 6)} ELSE 9999.0 END AS Days_of_Supply
FROM newest n JOIN speed v USING (product_sk) JOIN dim_product p USING (product_sk) JOIN dim_store s USING (store_sk)
WHERE n.stock > 0 AND CAST(n.stock AS HUGEINT) * 1000000 < 7 * v.avg6
"""

_VALUE_BY_REGION = _RANKED_LATEST + """
SELECT s.region AS Region, p.category AS Category, CAST(SUM(n.stock * n.price_c) AS DOUBLE) / 100 AS {name}
FROM newest n JOIN dim_store s USING (store_sk) JOIN dim_product p USING (product_sk)
WHERE n.stock * n.price_c > 0
GROUP BY s.region, p.category
"""

Q["q05_inventory_value"] = _VALUE_BY_REGION.format(name="Total_Inventory_Value")

Q["q06_obsolete_stock"] = _RANKED_LATEST + """
, last_sale AS (SELECT product_sk, MAX(cal_date) AS last_day FROM fx WHERE sold > 0 GROUP BY product_sk),
held AS (SELECT product_sk, SUM(stock * price_c) AS value_c FROM newest GROUP BY product_sk)
SELECT p.product_id AS Product_ID, p.category AS Category, CAST(l.last_day AS VARCHAR) AS Last_Sale_Date,
       CAST(h.value_c AS DOUBLE) / 100 AS Obsolete_Value,
       CAST(DATE '2002-05-01' - l.last_day AS BIGINT) AS Days_Since_Last_Sale
FROM dim_product p JOIN held h USING (product_sk) LEFT JOIN last_sale l USING (product_sk)
WHERE h.value_c > 0 AND DATE '2002-05-01' - COALESCE(l.last_day, DATE '1900-01-01') > 180
"""

# CEILING(mean*7 + 2*sd) exactly: the smallest c with c*n - 7s >= 0 and (c*n - 7s)^2 (n-1) >= 4 n (n q - s^2).
Q["q07_reorder_point"] = f"""
, recent AS (
    SELECT product_sk, store_sk, CAST(SUM(sold) AS HUGEINT) AS s, CAST(COUNT(sold) AS HUGEINT) AS n,
           SUM(CAST(sold AS HUGEINT) * sold) AS q
    FROM fx WHERE cal_date >= (SELECT d FROM last_day) - 90 GROUP BY product_sk, store_sk
), guessed AS (
    SELECT r.*, CASE WHEN n >= 2 THEN CAST(CEIL(CAST(s AS DOUBLE) / n * 7
                     + 2 * SQRT(CAST(n * q - s * s AS DOUBLE) / (n * (n - 1)))) AS HUGEINT) END AS g
    FROM recent r
), reorder AS (
    SELECT x.*, CASE WHEN n = 1 THEN 7 * s
        WHEN (g - 1) * n - 7 * s >= 0
             AND ((g - 1) * n - 7 * s) * ((g - 1) * n - 7 * s) * (n - 1) >= 4 * n * (n * q - s * s) THEN g - 1
        WHEN g * n - 7 * s >= 0 AND (g * n - 7 * s) * (g * n - 7 * s) * (n - 1) >= 4 * n * (n * q - s * s) THEN g
        ELSE g + 1 END AS reorder_point
    FROM guessed x
)
SELECT p.product_id AS Product_ID, p.category AS Category, st.store_id AS Store_ID, st.region AS Region,
       {_dbl(_half_up('r.s', 'r.n', 2), 2)} AS Avg_Daily_Sales,
       CAST(r.reorder_point AS BIGINT) AS Suggested_Reorder_Point,
       CAST((14 * r.s + r.n - 1) // r.n AS BIGINT) AS Suggested_Max_Stock,
       CASE WHEN r.s > 10 * r.n THEN 'HIGH VELOCITY' WHEN r.s > 3 * r.n THEN 'MEDIUM VELOCITY'
            ELSE 'LOW VELOCITY' END AS Product_Velocity
FROM reorder r JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
WHERE r.s > 0
"""

Q["q08_inventory_turnover"] = f"""
, recent AS (
    SELECT product_sk, store_sk, SUM(sold) AS u, SUM(stock) AS ls, COUNT(stock) AS n,
           SUM(stock) // COUNT(stock) AS li
    FROM fx WHERE cal_date >= (SELECT d FROM last_day) - 90 GROUP BY product_sk, store_sk
)
SELECT p.product_id AS Product_ID, p.category AS Category, st.store_id AS Store_ID, st.region AS Region,
       CAST(r.u AS BIGINT) AS Units_Sold_90_Days,
       CAST({_half_up('r.ls', 'r.n', 0)} AS DOUBLE) AS Avg_Inventory_Level,
       CASE WHEN r.li > 0 THEN {_dbl(_half_up('r.u', 'r.li', 2), 2)} ELSE 0.0 END AS Turnover_Ratio,
       CASE WHEN r.li > 0 AND r.u > 2 * r.li THEN 'FAST MOVING'
            WHEN r.li > 0 AND 2 * r.u > r.li THEN 'MODERATE MOVING'
            WHEN r.li > 0 AND r.u > 0 THEN 'SLOW MOVING' ELSE 'NOT MOVING' END AS Movement_Category,
       CASE WHEN r.li > 0 AND r.u > 2 * r.li THEN 'INCREASE STOCK'
            WHEN r.li > 0 AND r.u > 0 AND 5 * r.u < r.li THEN 'REDUCE STOCK'
            ELSE 'MAINTAIN CURRENT LEVELS' END AS Recommendation
FROM recent r JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
WHERE r.ls > 0
"""

Q["q09_days_on_hand"] = f"""
, pairs AS (
    SELECT product_sk, store_sk, {_half_up('SUM(stock)', 'COUNT(stock)', 6)} AS avg6,
           SUM(sold) AS total_sold, COUNT(DISTINCT date_sk) AS days
    FROM fx GROUP BY product_sk, store_sk
)
SELECT st.region AS Region, p.category AS Category,
       {_dbl(_half_up('SUM(x.avg6 * x.days)', 'SUM(x.total_sold)', 0), 6)} AS Avg_Days_of_Inventory_on_Hand
FROM pairs x JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
WHERE x.total_sold > 0
GROUP BY st.region, p.category
"""

Q["q10_working_capital"] = _VALUE_BY_REGION.format(name="Working_Capital_In_Inventory")

Q["q11_month_end_inventory_value"] = """
, month_last AS (
    SELECT x.*, row_number() OVER (PARTITION BY x.product_sk, x.store_sk, x.cal_year, x.cal_month
                                   ORDER BY x.cal_date DESC, x.date_sk DESC) AS pos
    FROM fx x
)
SELECT CAST(cal_year AS BIGINT) AS Year, CAST(cal_month AS BIGINT) AS Month,
       CAST(SUM(CAST(stock AS BIGINT) * price_c) AS DOUBLE) / 100 AS Total_Inventory_Value
FROM month_last WHERE pos = 1
GROUP BY cal_year, cal_month
"""

Q["q12_turnover_by_region_category"] = f"""
, pairs AS (
    SELECT store_sk, product_sk, SUM(sold) AS units, {_half_up('SUM(stock)', 'COUNT(stock)', 6)} AS avg6
    FROM fx GROUP BY store_sk, product_sk
)
SELECT st.region AS Region, p.category AS Category,
       CASE WHEN SUM(x.avg6) = 0 THEN NULL
            ELSE {_dbl(_half_up('SUM(x.units) * 1000000', 'SUM(x.avg6)', 2), 2)} END AS Inventory_Turnover_Ratio
FROM pairs x JOIN dim_store st USING (store_sk) JOIN dim_product p USING (product_sk)
WHERE x.avg6 > 0
GROUP BY st.region, p.category
"""

Q["q13_sales_velocity"] = f"""
, speed AS (
    SELECT p.product_id, p.category, {_half_up('SUM(x.sold)', 'COUNT(x.sold)', 6)} AS avg6
    FROM fx x JOIN dim_product p USING (product_sk) GROUP BY p.product_id, p.category
)
SELECT product_id AS Product_ID, category AS Category, {_dbl('avg6', 6)} AS Avg_Daily_Sales,
       {_dbl('avg6 * 7', 6)} AS Estimated_Weekly_Sales, {_dbl('avg6 * 30', 6)} AS Estimated_Monthly_Sales
FROM speed
"""

Q["q14_revenue_by_region_category"] = """
SELECT st.region AS Region, p.category AS Category, CAST(SUM(x.sold) AS BIGINT) AS Total_Units_Sold,
       CAST(SUM(x.sold * x.price_c) AS DOUBLE) / 100 AS Total_Revenue
FROM fx x JOIN dim_store st USING (store_sk) JOIN dim_product p USING (product_sk)
GROUP BY st.region, p.category
"""

Q["q15_demand_trend_forecast"] = f"""
, bounds AS (
    SELECT CAST(d - INTERVAL 12 MONTH AS DATE) AS first_day,
           CAST(d - INTERVAL 3 MONTH AS DATE) AS recent_from,
           CAST(d - INTERVAL 6 MONTH AS DATE) AS prev_from,
           CAST(d - INTERVAL 4 MONTH AS DATE) AS prev_to
    FROM last_day
), months AS (
    SELECT product_sk, store_sk, cal_year, cal_month, make_date(cal_year, cal_month, 1) AS month_start,
           SUM(sold) AS m
    FROM fx WHERE cal_date >= (SELECT first_day FROM bounds)
    GROUP BY product_sk, store_sk, cal_year, cal_month
), flagged AS (
    SELECT m.*, m.month_start >= (SELECT recent_from FROM bounds) AS is_recent,
           m.month_start BETWEEN (SELECT prev_from FROM bounds) AND (SELECT prev_to FROM bounds) AS is_prev
    FROM months m
), trend AS (
    SELECT product_sk, store_sk, SUM(m) AS sm, COUNT(m) AS k, SUM(CAST(m AS HUGEINT) * m) AS qm,
           SUM(CASE WHEN is_recent THEN m END) // COUNT(CASE WHEN is_recent THEN m END) AS rec,
           SUM(CASE WHEN is_prev THEN m END) // COUNT(CASE WHEN is_prev THEN m END) AS prev
    FROM flagged GROUP BY product_sk, store_sk
), spread AS (  -- ROUND(STDEV(m), 0) exactly: largest r with (2r-1)^2 k(k-1) <= 4 (k qm - sm^2)
    SELECT t.*, 4 * (CAST(k AS HUGEINT) * qm - CAST(sm AS HUGEINT) * sm) AS v4,
           CAST(k AS HUGEINT) * (k - 1) AS kk,
           CASE WHEN k >= 2 THEN CAST(FLOOR(SQRT(CAST(4 * (k * qm - sm * sm) AS DOUBLE) / (k * (k - 1))) / 2 + 0.5)
                AS HUGEINT) END AS g
    FROM trend t
), volatility AS (
    SELECT x.*, CASE WHEN k < 2 THEN 0
        WHEN g > 0 AND (2 * g - 1) * (2 * g - 1) * kk > v4 THEN g - 1
        WHEN (2 * g + 1) * (2 * g + 1) * kk <= v4 THEN g + 1 ELSE g END AS sd_round
    FROM spread x
)
SELECT p.product_id AS Product_ID, p.category AS Category, st.store_id AS Store_ID, st.region AS Region,
       CAST({_half_up('t.sm', 't.k', 0)} AS DOUBLE) AS Avg_Monthly_Sales,
       CAST(t.sd_round AS DOUBLE) AS Sales_Volatility,
       CAST(COALESCE(t.rec, 0) AS BIGINT) AS Recent_3_Month_Avg,
       CAST(COALESCE(t.prev, 0) AS BIGINT) AS Previous_3_Month_Avg,
       CASE WHEN 10 * COALESCE(t.rec, 0) > 11 * COALESCE(t.prev, 0) THEN 'GROWING'
            WHEN 10 * COALESCE(t.rec, 0) < 9 * COALESCE(t.prev, 0) THEN 'DECLINING' ELSE 'STABLE' END AS Trend_Direction,
       CAST(CASE WHEN t.rec IS NOT NULL THEN (12 * t.rec + 5) // 10
                 ELSE (12 * t.sm + 5 * t.k) // (10 * t.k) END AS DOUBLE) AS Forecast_Next_Month
FROM volatility t JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
WHERE t.sm > 0
"""

Q["q16_holiday_promotion_impact"] = f"""
SELECT CASE WHEN x.promo = 1 THEN 'HOLIDAY/PROMOTION' ELSE 'REGULAR' END AS Day_Type, p.category AS Category,
       CAST(COUNT(*) AS BIGINT) AS Number_of_Days, CAST(SUM(x.sold) AS BIGINT) AS Total_Units_Sold,
       CAST(SUM(x.sold) // COUNT(x.sold) AS BIGINT) AS Avg_Daily_Sales,
       CAST(SUM(x.sold * x.price_c) AS DOUBLE) / 100 AS Total_Revenue,
       {_dbl(_half_up('SUM(x.price_c) * 10000', 'COUNT(x.price_c)', 0), 6)} AS Avg_Price
FROM fx x JOIN dim_product p USING (product_sk)
WHERE x.sold > 0
GROUP BY x.promo, p.category
"""

# Spark keeps |u - f| / u to 13 places; the mean of those is then rounded to 6 places.
Q["q17_forecast_mape"] = f"""
, errors AS (
    SELECT p.product_id, p.category,
           {_half_up('ABS(x.sold * 100 - x.forecast_c) * 100000000000', 'x.sold', 0)} AS ape13
    FROM fx x JOIN dim_product p USING (product_sk)
    WHERE x.sold > 0
)
SELECT product_id AS Product_ID, category AS Category,
       {_dbl(_half_up('SUM(ape13)', 'COUNT(ape13) * 100000', 0), 6)} AS MAPE
FROM errors GROUP BY product_id, category
HAVING COUNT(ape13) > 0
"""

Q["q18_forecast_unit_variance"] = """
SELECT p.category AS Category, st.region AS Region,
       CAST(SUM(x.forecast_c) AS DOUBLE) / 100 AS Total_Forecasted_Units,
       CAST(SUM(x.sold) AS BIGINT) AS Total_Sold_Units,
       CAST(SUM(x.forecast_c) - 100 * SUM(x.sold) AS DOUBLE) / 100 AS Unit_Variance
FROM fx x JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
GROUP BY p.category, st.region
"""

Q["q19_discount_impact"] = f"""
SELECT p.category AS Category,
       CAST(SUM(CASE WHEN x.discount_c > 0 THEN x.sold END) // COUNT(CASE WHEN x.discount_c > 0 THEN x.sold END)
            AS BIGINT) AS Avg_Sales_With_Discount,
       CAST(SUM(CASE WHEN x.discount_c = 0 THEN x.sold END) // COUNT(CASE WHEN x.discount_c = 0 THEN x.sold END)
            AS BIGINT) AS Avg_Sales_Without_Discount,
       CASE WHEN COUNT(CASE WHEN x.discount_c > 0 THEN 1 END) = 0 THEN NULL ELSE
       {_dbl(_half_up('SUM(CASE WHEN x.discount_c > 0 THEN x.discount_c END) * 10000',
                      'COUNT(CASE WHEN x.discount_c > 0 THEN 1 END)', 0), 6)} END AS Avg_Discount_Percent
FROM fx x JOIN dim_product p USING (product_sk)
GROUP BY p.category
"""

_ABC = """
, revenue AS (
    SELECT product_sk, SUM(sold * price_c) AS rev_c, SUM(sold) AS units, SUM(stock) // COUNT(stock) AS avg_stock
    FROM fx WHERE cal_date >= (SELECT d FROM last_day) - 90 AND sold > 0
    GROUP BY product_sk
), ordered AS (
    SELECT r.*, row_number() OVER (ORDER BY rev_c DESC, product_sk) AS rnk,
           COUNT(*) OVER () AS n_products, SUM(rev_c) OVER () AS total_c,
           SUM(rev_c) OVER (ORDER BY rev_c DESC) AS running_c
    FROM revenue r
), abc AS (
    SELECT o.*, (2 * CAST(running_c AS HUGEINT) * 1000000 + total_c) // (2 * CAST(total_c AS HUGEINT)) AS share6
    FROM ordered o
), classed AS (
    SELECT a.*, CASE WHEN share6 <= 800000 THEN 'A' WHEN share6 <= 950000 THEN 'B' ELSE 'C' END AS abc_class
    FROM abc a
)
"""

Q["q20_abc_classification"] = _ABC + """
SELECT CAST(product_sk AS BIGINT) AS Product_SK, CAST(rev_c AS DOUBLE) / 100 AS Total_Revenue,
       CAST(units AS BIGINT) AS Total_Units_Sold, CAST(avg_stock AS BIGINT) AS Avg_Inventory_Level,
       CAST(rnk AS BIGINT) AS Revenue_Rank, CAST(n_products AS BIGINT) AS Total_Products,
       CAST(total_c AS DOUBLE) / 100 AS Grand_Total_Revenue, CAST(running_c AS DOUBLE) / 100 AS Running_Revenue_Total,
       CAST(share6 AS DOUBLE) / 10000 AS Revenue_Cumulative_Percent, abc_class AS ABC_Class
FROM classed
"""

Q["q21_abc_product_report"] = _ABC + """
SELECT p.product_id AS Product_ID, p.category AS Category, c.abc_class AS ABC_Class,
       CAST(c.rev_c AS DOUBLE) / 100 AS Revenue_90_Days, CAST(c.units AS BIGINT) AS Total_Units_Sold,
       CAST(c.avg_stock AS BIGINT) AS Avg_Inventory,
       CAST((c.share6 + 50) // 100 AS DOUBLE) / 100 AS Cumulative_Revenue_Percent,
       CASE c.abc_class WHEN 'A' THEN 'TIGHT CONTROL - Daily monitoring, safety stock'
                        WHEN 'B' THEN 'MODERATE CONTROL - Weekly monitoring'
                        WHEN 'C' THEN 'LOOSE CONTROL - Monthly review, minimize stock' END AS Management_Strategy
FROM classed c JOIN dim_product p USING (product_sk)
"""

Q["q22_abc_summary"] = _ABC + f"""
, per_class AS (
    SELECT abc_class, COUNT(*) AS n, MAX(n_products) AS n_all, SUM(rev_c) AS rev_c, MAX(total_c) AS total_c
    FROM classed GROUP BY abc_class
)
SELECT abc_class AS ABC_Class, CAST(n AS BIGINT) AS Number_of_Products,
       {_dbl(_half_up('n * 100', 'n_all', 2), 2)} AS Percent_of_Products,
       CAST(rev_c AS DOUBLE) / 100 AS Total_Revenue,
       CAST(({_half_up('rev_c * 100', 'total_c', 6)} + 5000) // 10000 AS DOUBLE) / 100 AS Percent_of_Revenue
FROM per_class
"""

Q["q23_product_affinity"] = """
, basket AS (SELECT DISTINCT date_sk, store_sk, product_sk FROM fx WHERE sold > 0),
pair_counts AS (
    SELECT a.product_sk AS sk_a, b.product_sk AS sk_b, COUNT(*) AS together, COUNT(DISTINCT a.date_sk) AS days
    FROM basket a JOIN basket b ON a.date_sk = b.date_sk AND a.store_sk = b.store_sk AND a.product_sk < b.product_sk
    GROUP BY a.product_sk, b.product_sk
    HAVING COUNT(*) >= 5
), named AS (
    SELECT pa.product_id AS Product_A, pa.category AS Category_A, pb.product_id AS Product_B, pb.category AS Category_B,
           c.together, c.days, c.sk_a, c.sk_b
    FROM pair_counts c JOIN dim_product pa ON pa.product_sk = c.sk_a JOIN dim_product pb ON pb.product_sk = c.sk_b
    ORDER BY c.together DESC, c.sk_a, c.sk_b
    LIMIT 50
)
SELECT Product_A, Category_A, Product_B, Category_B, CAST(together AS BIGINT) AS Times_Sold_Together,
       CAST(days AS BIGINT) AS Days_Sold_Together,
       CASE WHEN together >= 20 THEN 'STRONG AFFINITY' WHEN together >= 10 THEN 'MODERATE AFFINITY'
            ELSE 'WEAK AFFINITY' END AS Affinity_Strength,
       CASE WHEN Category_A <> Category_B THEN 'Cross-Category Opportunity' ELSE 'Same Category Bundle' END AS Bundle_Type
FROM named
"""

Q["q24_regional_efficiency"] = f"""
, regional AS (
    SELECT st.region, COUNT(DISTINCT st.store_id) AS stores, COUNT(DISTINCT x.product_sk) AS products,
           SUM(x.stock) AS inv, SUM(x.sold) AS units, SUM(x.sold * x.price_c) AS rev_c,
           COUNT(CASE WHEN x.stock = 0 THEN 1 END) AS outs, COUNT(*) AS recs
    FROM fx x JOIN dim_store st USING (store_sk)
    WHERE x.cal_date >= (SELECT d FROM last_day) - 30
    GROUP BY st.region
), rates AS (
    SELECT r.*, CASE WHEN inv = 0 THEN NULL ELSE {_half_up('units', 'inv', 3)} END AS turn3,
           {_half_up('outs * 100', 'recs', 2)} AS out2,
           ({_half_up('rev_c', 'stores * 100', 6)} + 5000) // 10000 AS per_store2
    FROM regional r
)
SELECT region AS Region, CAST(stores AS BIGINT) AS Number_of_Stores, CAST(products AS BIGINT) AS Unique_Products,
       CAST(inv AS BIGINT) AS Total_Inventory_Units, CAST(units AS BIGINT) AS Total_Units_Sold,
       CAST(rev_c AS DOUBLE) / 100 AS Total_Revenue,
       CAST(turn3 AS DOUBLE) / 1000 AS Inventory_Turnover_Rate, CAST(out2 AS DOUBLE) / 100 AS Stockout_Rate_Percent,
       CAST(per_store2 AS DOUBLE) / 100 AS Revenue_Per_Store, CAST(inv // stores AS BIGINT) AS Avg_Inventory_Per_Store,
       CASE WHEN turn3 > 500 AND out2 < 500 THEN 'EXCELLENT' WHEN turn3 > 300 AND out2 < 1000 THEN 'GOOD'
            WHEN turn3 > 200 OR out2 < 1500 THEN 'AVERAGE' ELSE 'NEEDS IMPROVEMENT' END AS Performance_Rating,
       CAST(rank() OVER (ORDER BY turn3 DESC NULLS LAST) AS BIGINT) AS Turnover_Rank,
       CAST(rank() OVER (ORDER BY out2 ASC NULLS FIRST) AS BIGINT) AS Stockout_Rank
FROM rates
"""

Q["q25_action_plan"] = f"""
, items AS (
    SELECT product_sk, store_sk, {_half_up('SUM(stock)', 'COUNT(stock)', 18)} AS avg18,
           SUM(sold) AS s, COUNT(sold) AS n, SUM(stock) // COUNT(stock) AS li
    FROM fx WHERE cal_date >= (SELECT d FROM last_day) - 30 GROUP BY product_sk, store_sk
), labelled AS (
    SELECT i.*, CASE WHEN li = 0 AND s > 0 THEN 'URGENT_RESTOCK'
                     WHEN li * n < 3 * s THEN 'INCREASE_STOCK'
                     WHEN li * n > 10 * s AND s < 5 THEN 'REDUCE_STOCK'
                     WHEN s = 0 AND li > 20 THEN 'CONSIDER_DISCONTINUE'
                     ELSE 'MAINTAIN' END AS action
    FROM items i
)
SELECT l.action AS Action_Required, p.category AS Category, st.region AS Region,
       CAST(COUNT(*) AS BIGINT) AS Number_of_Items,
       {_dbl(_half_up('SUM(l.avg18)', '1000000000000', 0), 6)} AS Total_Current_Inventory,
       CAST(SUM(l.s) AS BIGINT) AS Total_Recent_Sales,
       CASE l.action WHEN 'URGENT_RESTOCK' THEN 'Order immediately to prevent lost sales'
                     WHEN 'INCREASE_STOCK' THEN 'Increase inventory levels to prevent stockouts'
                     WHEN 'REDUCE_STOCK' THEN 'Liquidate or transfer excess stock'
                     WHEN 'CONSIDER_DISCONTINUE' THEN 'Evaluate product viability for this location'
                     ELSE 'Current stock levels are appropriate' END AS Recommendation
FROM labelled l JOIN dim_product p USING (product_sk) JOIN dim_store st USING (store_sk)
GROUP BY l.action, p.category, st.region
"""

Q["q26_supplier_scorecard"] = f"""
, cat AS (
    SELECT p.category, COUNT(DISTINCT p.product_id) AS products, SUM(x.sold) AS units,
           SUM(x.sold * x.price_c) AS rev_c, {_half_up('SUM(x.price_c) * 10000', 'COUNT(x.price_c)', 0)} AS price6,
           {_half_up('SUM(CASE WHEN x.stock = 0 THEN 1 ELSE 0 END) * 100', 'COUNT(*)', 2)} AS out2
    FROM fx x JOIN dim_product p USING (product_sk)
    WHERE x.cal_date >= (SELECT d FROM last_day) - 90
    GROUP BY p.category
)
SELECT category AS Supplier_Category, CAST(products AS BIGINT) AS Products_Supplied,
       CAST(units AS BIGINT) AS Total_Units_Sold, CAST(rev_c AS DOUBLE) / 100 AS Revenue_Generated,
       CAST((price6 + 5000) // 10000 AS DOUBLE) / 100 AS Avg_Price_Point,
       CAST(out2 AS DOUBLE) / 100 AS Stockout_Rate_Percent,
       CASE WHEN out2 < 200 THEN 'EXCELLENT' WHEN out2 < 500 THEN 'GOOD' WHEN out2 < 1000 THEN 'NEEDS IMPROVEMENT'
            ELSE 'POOR' END AS Supplier_Rating,
       CASE WHEN out2 > 1000 THEN 'FIND ALTERNATIVE SUPPLIERS' WHEN out2 > 500 THEN 'NEGOTIATE BETTER TERMS'
            ELSE 'MAINTAIN RELATIONSHIP' END AS Action_Recommendation
FROM cat
"""

Q["star_integrity"] = """
, checks AS (
    SELECT 'fact_grain_duplicates' AS chk, COALESCE(SUM(c), 0) AS v
      FROM (SELECT COUNT(*) AS c FROM fact GROUP BY date_sk, store_sk, product_sk HAVING COUNT(*) > 1)
    UNION ALL SELECT 'store_key_duplicates', COALESCE(SUM(c), 0)
      FROM (SELECT COUNT(*) AS c FROM dim_store GROUP BY store_sk HAVING COUNT(*) > 1)
    UNION ALL SELECT 'product_key_duplicates', COALESCE(SUM(c), 0)
      FROM (SELECT COUNT(*) AS c FROM dim_product GROUP BY product_sk HAVING COUNT(*) > 1)
    UNION ALL SELECT 'date_key_duplicates', COALESCE(SUM(c), 0)
      FROM (SELECT COUNT(*) AS c FROM dim_date GROUP BY date_sk HAVING COUNT(*) > 1)
    UNION ALL SELECT 'fact_orphan_Store_SK', COUNT(*) FROM fact f WHERE f.store_sk NOT IN (SELECT store_sk FROM dim_store)
    UNION ALL SELECT 'fact_orphan_Product_SK', COUNT(*) FROM fact f
      WHERE f.product_sk NOT IN (SELECT product_sk FROM dim_product)
    UNION ALL SELECT 'fact_orphan_Date_SK', COUNT(*) FROM fact f WHERE f.date_sk NOT IN (SELECT date_sk FROM dim_date)
)
SELECT chk AS "check", CAST(v AS BIGINT) AS violations FROM checks
"""


def oracle_sql() -> dict[str, str]:
    return {key: STAR + body for key, body in Q.items()}
