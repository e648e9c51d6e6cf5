"""Plain SQL with the same results as the catalog queries, for checking them on the driver's tables."""

from __future__ import annotations

EDITIONS = """
editions AS (
  SELECT *, CAST(year(o_orderdate) AS DOUBLE) + CASE WHEN month(o_orderdate) >= 7 THEN 0.5 ELSE 0 END AS edition,
         CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN month(o_orderdate) >= 7 THEN '-11' ELSE '-06' END AS rank_year
  FROM orders)"""

CUSTOMERS = """
customers AS (
  SELECT c_custkey, c_name, c_mktsegment AS segment, n_name AS country, c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

INTENSITY = """
provider_a AS (
  SELECT n_name AS country, year(l_shipdate) AS year, month(l_shipdate) AS month,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1e4) AS intensity_a,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE)
           / (count(*) * 1e6) AS intensity_a_direct
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL),
provider_b AS (
  SELECT country, year(o_orderdate) AS year, month(o_orderdate) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 6e4) AS intensity_b
  FROM orders JOIN customers ON o_custkey = c_custkey
  GROUP BY ALL),
intensity AS (
  SELECT country, year, month, intensity_a, intensity_a_direct, intensity_b,
         intensity_a - intensity_b AS intensity_difference
  FROM provider_a FULL JOIN provider_b USING (country, year, month))"""

DATE_OF = """make_date(CAST(floor({e}) AS BIGINT), CASE WHEN {e} = floor({e}) THEN 1 ELSE 6 END, 1)"""

FLEET = f"""
fleet AS (
  SELECT o_custkey AS entity_id, CAST(edition * 2 AS BIGINT) * 1000000000000 + o_orderkey AS row_seq, o_orderkey,
         edition, {DATE_OF.format(e="edition")} AS year_month,
         CAST(year(o_orderdate) AS DOUBLE) AS installation_year, c.country, segment,
         o_orderstatus AS listing, o_totalprice AS metric,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(90 + CAST(floor(o_totalprice) AS BIGINT) % 200 AS DOUBLE) END AS cpu_tdp,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
              THEN CAST(250 + CAST(floor(o_totalprice) AS BIGINT) % 150 AS DOUBLE) END AS gpu_tdp,
         CAST(1 + o_orderkey % 64 AS DOUBLE) AS num_cpus, CAST(o_orderkey % 8 AS DOUBLE) AS num_gpus,
         intensity_a, intensity_b
  FROM editions JOIN customers c ON o_custkey = c_custkey
  LEFT JOIN intensity i ON lower(c.country) = lower(i.country)
       AND {DATE_OF.format(e="edition")} = make_date(i.year, i.month, 1))"""

THRESHOLDS = """
thresholds AS (
  SELECT edition - 0.5 AS final_edition, o_totalprice AS threshold
  FROM (SELECT edition, o_totalprice,
               row_number() OVER (PARTITION BY edition ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM editions WHERE o_orderstatus = 'O')
  WHERE rank = 100)"""

BASE = f"WITH {EDITIONS}, {CUSTOMERS}, {INTENSITY}, {FLEET}, {THRESHOLDS}"

IN_COUNTRY = "country = 'NATION_3'"
IN_SEGMENTS = "segment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"


def _known(column: str) -> str:
    return f"arg_min({column}, row_seq) FILTER (WHERE {column} IS NOT NULL) AS {column}"


def series(prefix: str, where: str = "TRUE", provider: str = "intensity_a", idle: str = "chip") -> str:
    """CTEs from systems to one row per (system, semester) and to the semester series, by brute force."""
    units = "1" if idle == "chip" else "num_{p}s"
    watts = ", ".join(
        f"coalesce({p}_tdp, 0) * 0.5 * {units.format(p=p)} AS {p}_idle, "
        f"coalesce({p}_tdp, 0) * coalesce(num_{p}s, 0) AS {p}_full"
        for p in ("cpu", "gpu")
    )
    gwh = ", ".join(
        f"CASE WHEN tau IS NULL THEN 0 ELSE 24 * (365.0 / 12) * ((1 - tau) * {p}_idle + tau * {p}_full) / 1e9 * 6 END AS {p}_gwh"
        for p in ("cpu", "gpu")
    )
    return f"""
{prefix}_first AS (
  SELECT entity_id, arg_min(metric, row_seq) AS metric, {_known("installation_year")}, {_known("cpu_tdp")},
         {_known("gpu_tdp")}, {_known("num_cpus")}, {_known("num_gpus")}, {_known(provider)}
  FROM fleet WHERE {where} GROUP BY entity_id),
{prefix}_systems AS (
  SELECT f.*, final_edition - installation_year
              + CASE WHEN metric < threshold THEN 2.0 ELSE 0 END AS life
  FROM {prefix}_first f
  JOIN (SELECT entity_id, max(edition) AS final_edition FROM fleet GROUP BY entity_id) USING (entity_id)
  LEFT JOIN thresholds USING (final_edition)
  WHERE final_edition < 2001.5),
{prefix}_grid AS (
  SELECT *, semester - installation_year AS age
  FROM (SELECT entity_id, installation_year, life, coalesce({provider}, 0) AS intensity, {watts} FROM {prefix}_systems)
  CROSS JOIN (SELECT CAST(1995 + i * 0.5 AS DOUBLE) AS semester FROM range(14) t(i))),
{prefix}_rows AS (
  SELECT *, cpu_gwh + gpu_gwh AS total_gwh, cpu_gwh > 0 OR gpu_gwh > 0 AS active
  FROM (SELECT entity_id, semester, intensity, {gwh}
        FROM (SELECT *, CAST(CASE WHEN age = 0 THEN 0.5 WHEN age = 0.5 THEN 0.65
                                  WHEN age >= 1 AND age < life THEN 0.8 END AS DOUBLE) AS tau FROM {prefix}_grid))),
{prefix}_states AS (
  SELECT *, coalesce(lag(active) OVER (PARTITION BY entity_id ORDER BY semester), FALSE) AS was FROM {prefix}_rows),
{prefix}_series AS (
  SELECT semester, {DATE_OF.format(e="semester")} AS year_month,
         sum(cpu_gwh) AS cpu_gwh, sum(gpu_gwh) AS gpu_gwh, sum(total_gwh) AS total_gwh,
         sum(cpu_gwh * intensity) AS cpu_carbon_t, sum(gpu_gwh * intensity) AS gpu_carbon_t,
         sum(total_gwh * intensity) AS total_carbon_t,
         count(*) FILTER (WHERE active AND NOT was) AS systems_added,
         count(*) FILTER (WHERE was AND NOT active) AS systems_removed,
         count(*) FILTER (WHERE active) AS active_systems, count(*) AS total_systems
  FROM {prefix}_states GROUP BY semester)"""


_ENERGY = ("cpu_gwh", "gpu_gwh", "total_gwh")
_CARBON = ("cpu_carbon_t", "gpu_carbon_t", "total_carbon_t")
_TURNOVER = "systems_added, systems_removed, active_systems, total_systems"


def _rounded(columns, divisor: str = "") -> str:
    by = f" / {divisor}" if divisor else ""
    return ", ".join(f"round({c}{by}, {10 if c.endswith('_gwh') else 4}) AS {c}" for c in columns)


_N_COUNTRIES = "(SELECT count(DISTINCT country) FROM fleet)"

COMPARISON = f"""{BASE}, {series("own", f"{IN_COUNTRY} AND {IN_SEGMENTS}")}, {series("world", IN_SEGMENTS)},
comparison AS (
  SELECT o.*, {", ".join(f"w.{c} / {_N_COUNTRIES} AS fleet_{c}" for c in (*_ENERGY, *_CARBON))}
  FROM own_series o JOIN world_series w USING (semester))"""

LINE_PARTS = "lineitem JOIN part ON l_partkey = p_partkey"

SYSTEMS = """
systems AS (
  SELECT p_partkey,
         CASE p_partkey % 5
           WHEN 0 THEN upper(p_name)
           WHEN 1 THEN replace(p_name, ' ', '') || ' ' || p_size || 'W'
           WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || p_type || ' ' || split_part(p_name, ' ', 1)
           WHEN 3 THEN translate(p_name, 'eo', 'o') || ' ' || p_size || 'W'
           ELSE p_name END AS processor
  FROM part)"""

SPECS = """
specs AS (
  SELECT p_name AS spec_name, CAST(max(p_size) AS DOUBLE) AS tdp, count(*) AS n_parts FROM part GROUP BY p_name)"""

def _lcs(name: str, pairs: str) -> str:
    """Recursive CTEs giving LCS lengths for the distinct (a, b) of ``pairs``."""
    return f"""
{name}_steps(a, b, i, row) AS (
  SELECT DISTINCT a, b, 0, list_transform(range(length(b) + 1), lambda z: 0) FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1,
         list_reduce(range(1, length(b) + 1),
                     lambda acc, j: list_append(acc, greatest(acc[j], row[j + 1],
                         row[j] + CASE WHEN b[j] = a[i + 1] THEN 1 ELSE 0 END)),
                     [CAST(0 AS BIGINT)])
  FROM {name}_steps WHERE i < length(a)),
{name} AS (SELECT a, b, list_last(row) AS lcs FROM {name}_steps WHERE i = length(a))"""


def _indel(distance: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * ({distance}) / ({total}) ELSE 100.0::DOUBLE END"


def _text(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


_PARTS = f"""
pairs AS (
  SELECT name, spec_name, {_text("lt")} AS ls, {_text("rt")} AS rs,
         {_text("list_filter(list_distinct(lt), lambda t: list_contains(rt, t))")} AS common,
         {_text("list_filter(list_distinct(lt), lambda t: NOT list_contains(rt, t))")} AS lo,
         {_text("list_filter(list_distinct(rt), lambda t: NOT list_contains(lt, t))")} AS ro
  FROM (SELECT DISTINCT processor AS name, string_split(processor, ' ') AS lt FROM systems)
  CROSS JOIN (SELECT spec_name, string_split(spec_name, ' ') AS rt FROM specs)),
texts AS (SELECT ls AS a, rs AS b FROM pairs UNION SELECT lo, ro FROM pairs)"""

_GAP = "(CASE WHEN length(common) > 0 THEN 1 ELSE 0 END)"
_LF = f"(length(common) + {_GAP} + length(lo))"
_RF = f"(length(common) + {_GAP} + length(ro))"

CANDIDATES = f"""WITH RECURSIVE {SYSTEMS}, {SPECS}, {_PARTS}, {_lcs("lcs_of", "texts")},
scored AS (
  SELECT name, spec_name, greatest(
      {_indel("length(ls) + length(rs) - 2 * s.lcs", "length(ls) + length(rs)")},
      CASE WHEN length(common) > 0 AND (length(lo) = 0 OR length(ro) = 0) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END,
      {_indel("length(lo) + length(ro) - 2 * d.lcs", f"{_LF} + {_RF}")},
      CASE WHEN length(common) > 0 THEN {_indel(f"{_GAP} + length(lo)", f"length(common) + {_LF}")} ELSE 0 END,
      CASE WHEN length(common) > 0 THEN {_indel(f"{_GAP} + length(ro)", f"length(common) + {_RF}")} ELSE 0 END) AS score
  FROM pairs JOIN lcs_of s ON s.a = ls AND s.b = rs JOIN lcs_of d ON d.a = lo AND d.b = ro),
candidates AS (
  SELECT name, spec_name, score
  FROM (SELECT *, max(score) OVER (PARTITION BY name) AS best FROM scored)
  WHERE score >= CASE WHEN best >= 99 THEN 99.0::DOUBLE ELSE best * 0.9::DOUBLE END)"""

ESTIMATES = f"""{CANDIDATES},
estimates AS (
  SELECT name, round(sum(w * tdp) / sum(w), 1) AS estimate,
         count(*) AS n_sources
  FROM (SELECT *, power(score / 100, 8) * 100 AS w FROM candidates JOIN specs USING (spec_name))
  GROUP BY name)"""


LISTED = f"""{EDITIONS}, {CUSTOMERS},
lead_parts AS (
  SELECT l_orderkey AS o_orderkey, min(p_brand) AS p_brand, min(p_type) AS p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 GROUP BY 1),
ranked AS (
  SELECT *, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS list_no,
         row_number() OVER (PARTITION BY edition, o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM editions),
listed AS (
  SELECT o_orderkey, o_custkey AS entity_id, edition, CASE list_no WHEN 0 THEN 'Top500' ELSE 'Green500' END AS listing, rank,
         o_totalprice AS metric, CAST(year(o_orderdate) AS DOUBLE) AS installation_year, c.country, nullif(c.segment, 'MACHINERY') AS segment,
         CASE WHEN o_orderkey % 4 = 1 THEN upper(p_brand) WHEN o_orderkey % 4 > 1 THEN p_brand END AS processor,
         CASE WHEN o_orderkey % 3 = 0 THEN p_type END AS accel_name, floor(o_totalprice) AS cores,
         CASE WHEN o_orderkey % 3 = 0 AND p_type IS NOT NULL THEN floor(o_totalprice / 2) END AS accel_cores,
         CAST(list_no AS BIGINT) * 1000000000000 + CAST(edition * 2 AS BIGINT) * 100000000 + rank AS seq
  FROM ranked LEFT JOIN lead_parts USING (o_orderkey) JOIN customers c ON o_custkey = c_custkey),
listed_history AS (
  SELECT entity_id, max(edition) AS final_edition, count(DISTINCT edition) AS n_editions, count(*) AS n_appearances FROM listed GROUP BY 1),
listed_limits AS (SELECT edition - 0.5 AS final_edition, metric AS threshold FROM listed WHERE listing = 'Top500' AND rank = 100),
computers AS (
  SELECT l.*, n_editions, n_appearances, final_edition, threshold, final_edition - installation_year AS lifespan,
         CASE WHEN final_edition >= 2001.5 THEN 'Active' WHEN metric < threshold THEN 'Dropped' ELSE 'Removed' END AS exit_reason
  FROM listed l JOIN listed_history USING (entity_id) LEFT JOIN listed_limits USING (final_edition))"""

LABELLED = """
SELECT o_orderkey, entity_id, edition, listing, rank, n_editions, n_appearances, final_edition, threshold, exit_reason,
       installation_year, lifespan, coalesce(segment, 'Unknown') AS segment, metric FROM computers"""


def _carried(column: str) -> str:
    """Forward, then backward fill within a system."""
    return f"""coalesce(
    last_value({column} IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({column} IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  ) AS {column}"""


def _with_chips(rows: str, missing: str) -> str:
    return f"""
named AS (SELECT {rows}.* EXCLUDE (processor, accel_name), {_carried("processor")}, {_carried("accel_name")} FROM {rows}),
cpus AS (SELECT upper(p_brand) AS name, CAST(max(p_size) AS DOUBLE) AS cpu_tdp, max(p_size) * 2 AS cpu_num_cores FROM part GROUP BY 1),
gpus AS (SELECT upper(p_type) AS name, max(p_size) * 10.0::DOUBLE AS gpu_tdp, max(p_size) * 100 AS n_shaders, max(p_size) AS n_sm
         FROM part WHERE p_type <> '{missing}' GROUP BY 1),
chips AS (
  SELECT n.*, cpu_tdp, cpu_num_cores, gpu_tdp, n_shaders, n_sm, NULL::DOUBLE AS second_gpu_tdp
  FROM named n LEFT JOIN cpus ON upper(processor) = cpus.name LEFT JOIN gpus ON upper(accel_name) = gpus.name)"""


ZONES = """
zone_readings AS (
  SELECT n_name || '-' || (s_suppkey % 3) AS zone_key, n_name AS country, year(l_shipdate) AS year, month(l_shipdate) AS month,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS life_cycle,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS direct
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
zone_list AS (
  SELECT n_name || '-' || (s_suppkey % 3) AS zone_key, min(s_suppkey) AS zone_order
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
country_zones AS (
  SELECT country, year, month, arg_min(life_cycle, zone_order) AS intensity_a, arg_min(direct, zone_order) AS intensity_a_direct,
         avg(life_cycle) AS mean_a, avg(direct) AS mean_direct
  FROM zone_readings JOIN zone_list USING (zone_key) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    both = (*_ENERGY, *_CARBON)
    sql: dict[str, str] = {}

    sql["q_edition_load"] = f"""WITH {EDITIONS}
SELECT o_orderkey, rank_year, edition, rank,
       CAST(CASE WHEN edition < 1997 THEN o_custkey ELSE o_orderkey END AS DOUBLE) AS cores,
       CASE WHEN edition < 1999 THEN o_totalprice ELSE o_totalprice * 1000 END AS rmax,
       md5(concat_ws('-', CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderpriority, '5-LOW'), 'nan'),
                     o_orderstatus, CAST(year(o_orderdate) AS VARCHAR))) AS entity_key,
       'orders' AS listing
FROM (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM editions)
WHERE rank <= 500"""

    sql["q_list_source"] = f"""WITH {EDITIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM editions)
SELECT CAST(year(o_orderdate) + 10 AS VARCHAR) || right(rank_year, 3) AS rank_year, edition + 10 AS edition, 'Top500' AS listing, rank, o_orderkey,
       CASE WHEN o_orderkey % 2 = 0 THEN 'United States of America' ELSE 'France' END AS country, year(o_orderdate) AS year, NULL AS nmax,
       o_orderpriority || ', "x"' AS processor, o_orderstatus AS segment, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'K20' END AS accel_name,
       o_orderkey % 3 = 0 AS accel_present, CAST(o_custkey AS DOUBLE) AS cores, o_totalprice AS rmax,
       CAST(CAST(o_totalprice AS VARCHAR) || '0' AS DOUBLE) AS rpeak
FROM placed WHERE rank <= 500 AND edition >= 1996.5"""

    sql["q_era_scale"] = """
SELECT l_orderkey, l_partkey, l_suppkey,
       CASE WHEN edition < 1997.5 THEN l_quantity
            WHEN edition < 2000 THEN l_extendedprice * 0.001::DOUBLE ELSE l_extendedprice * 1000 END AS speed
FROM (SELECT *, year(l_shipdate) + CASE WHEN month(l_shipdate) >= 7 THEN 0.5 ELSE 0 END AS edition FROM lineitem)"""

    sql["q_ratio_repair"] = """
SELECT l_orderkey, l_partkey, rpeak, l_extendedprice / rpeak AS perf_ratio,
       (rpeak - l_extendedprice) / rpeak AS relative_gap
FROM (SELECT *, CASE WHEN l_extendedprice / (l_quantity * 2000) > 1 THEN l_quantity * 20000
                     ELSE l_quantity * 2000 END AS rpeak FROM lineitem)"""

    sql["q_edition_topn"] = f"""WITH {EDITIONS}
SELECT edition, rank, o_orderkey, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM editions)
WHERE rank <= 500"""

    sql["q_nth_value"] = f"""WITH {EDITIONS},
placed AS (
  SELECT edition, o_orderstatus, o_totalprice,
         row_number() OVER (PARTITION BY edition, o_orderstatus ORDER BY o_totalprice DESC) AS place FROM editions)
SELECT * FROM placed WHERE place IN (500, 20000)"""

    sql["q_edition_union"] = """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS metric, c_mktsegment AS segment, 'customer' AS listing FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier"""

    sql["q_spec_union"] = """
SELECT p_partkey, CASE WHEN cpu THEN p_name END AS processor, CASE WHEN cpu THEN p_size END AS tdp,
       CASE WHEN cpu THEN 'CPU' ELSE 'GPU' END AS type,
       CASE WHEN NOT cpu THEN p_name END AS gpu_model, CASE WHEN NOT cpu THEN p_size END AS gpu_tdp
FROM (SELECT *, p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AS cpu FROM part)"""

    sql["q_spec_tables"] = """
SELECT p_partkey, p_name AS processor, p_brand AS manufacturer, p_size AS tdp FROM part"""

    line_columns = (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split()
    sql["q_headers"] = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, "
        + (f"count(nullif({c}, 'N'))" if c == "l_returnflag" else f"count({c})")
        + " AS n_values FROM lineitem"
        for i, c in enumerate(line_columns)
    )

    sql["q_regex_project"] = "SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem"

    sql["q_zone_intensity"] = """
SELECT event_id, event_type AS zone_key, CAST(ts AS DATE) AS reading_date, year(ts) AS year, month(ts) AS month,
       value AS life_cycle FROM events"""

    sql["q_zone_dim"] = """
SELECT n_name AS country, 'Z' || (s_suppkey % 3) AS zone_key, min(s_suppkey) AS zone_order
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 1000 GROUP BY 1, 2"""

    sql["q_long_filter"] = """
SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n, round(sum(l_extendedprice), 2) AS value
FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 GROUP BY 1, 2"""

    sql["q_sink_roundtrip"] = "SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS year FROM orders"

    sql["q_entity_hash"] = """
SELECT p_partkey, md5(p_name || '-' || p_brand || '-' || coalesce(nullif(p_type, 'PROMO'), 'nan') || '-' || p_size
                      || '-' || (p_partkey % 7)) AS entity_key FROM part"""

    sql["q_country_normalize"] = """
SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'First Nation' WHEN 'NATION_2' THEN 'NATION_20' ELSE n_name END AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

    sql["q_semester_parse"] = f"WITH {EDITIONS} SELECT o_orderkey, rank_year, edition FROM editions"

    sql["q_decimal_date"] = f"""WITH {EDITIONS}
SELECT o_orderkey, edition, {DATE_OF.format(e="edition")} AS edition_date FROM editions"""

    sql["q_null_defaults"] = """
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag IN ('N', 'A') THEN 'Unknown' ELSE l_returnflag END AS flag,
       CASE WHEN l_discount = 0.05::DOUBLE THEN 0 ELSE l_discount END AS discount, l_discount = 0.05::DOUBLE AS was_missing
FROM lineitem"""

    sql["q_accel_flag"] = """
SELECT l_linestatus, CASE WHEN l_returnflag = 'N' THEN 'No' ELSE 'Yes' END AS accelerator_present,
       count(*) AS n_rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2"""

    sql["q_presence_list"] = f"""WITH {EDITIONS},
counted AS (SELECT o_custkey, edition, count(*) AS n FROM editions GROUP BY 1, 2)
SELECT o_custkey, string_agg(CAST(edition AS VARCHAR), ',' ORDER BY edition) AS editions,
       string_agg(CAST(edition AS VARCHAR) || 'x' || n, ',' ORDER BY edition) AS appearances,
       CAST(sum(n) AS BIGINT) AS n_appearances, min(edition) AS first_edition, max(edition) AS final_edition,
       max(edition) - floor(min(edition)) AS lifespan
FROM counted GROUP BY o_custkey"""

    sql["q_list_turnover"] = f"""WITH {EDITIONS},
seen AS (SELECT DISTINCT o_custkey, edition FROM editions),
spans AS (SELECT CAST(1995 + i * 0.5 AS DOUBLE) AS edition FROM range(14) t(i)),
came AS (SELECT s.edition, count(*) AS listed, count(*) FILTER (WHERE b.edition IS NULL) AS entered
         FROM seen s LEFT JOIN seen b ON b.o_custkey = s.o_custkey AND b.edition = s.edition - 0.5 GROUP BY 1),
went AS (SELECT b.edition + 0.5 AS edition, count(*) AS gone
         FROM seen b LEFT JOIN seen s ON b.o_custkey = s.o_custkey AND b.edition = s.edition - 0.5 WHERE s.edition IS NULL GROUP BY 1)
SELECT edition, coalesce(listed, 0) AS listed, coalesce(entered, 0) AS entered, coalesce(gone, 0) AS left
FROM spans LEFT JOIN came USING (edition) LEFT JOIN went USING (edition)"""

    sql["q_exit_reason"] = f"""WITH {EDITIONS}, {THRESHOLDS},
history AS (SELECT o_custkey, max(edition) AS final_edition, count(DISTINCT edition) AS n_editions FROM editions GROUP BY 1)
SELECT o_orderkey, o_custkey, edition, n_editions, final_edition, threshold,
       CASE WHEN o_totalprice < threshold THEN 'Dropped' ELSE 'Removed' END AS exit_reason
FROM editions JOIN history USING (o_custkey) LEFT JOIN thresholds USING (final_edition)
WHERE final_edition < 2001.5"""

    sql["q_exit_reason_gaps"] = f"""WITH {EDITIONS}, {THRESHOLDS},
kept AS (SELECT * FROM editions WHERE edition NOT BETWEEN 1996 AND 1999 OR o_orderkey % 3 = 0),
history AS (SELECT o_custkey, max(edition) AS final_edition FROM kept GROUP BY 1),
limits AS (SELECT * FROM thresholds WHERE final_edition < 1995.5 OR final_edition >= 1999),
later AS (
  SELECT o_custkey, h.final_edition, arg_min(threshold, l.final_edition) AS threshold
  FROM history h LEFT JOIN limits l ON l.final_edition >= h.final_edition GROUP BY 1, 2)
SELECT o_orderkey, o_custkey, edition, final_edition, threshold,
       CASE WHEN o_totalprice < threshold THEN 'Dropped' ELSE 'Removed' END AS exit_reason
FROM kept JOIN later USING (o_custkey) WHERE final_edition < 2001.5"""

    gappy = """
gappy AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN value END AS reading,
         CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS processor FROM events)"""
    sql["q_first_nonnull"] = f"""WITH {gappy}
SELECT user_id, arg_min(reading, event_id) FILTER (WHERE reading IS NOT NULL) AS reading,
       arg_min(processor, event_id) FILTER (WHERE processor IS NOT NULL) AS processor
FROM gappy GROUP BY user_id"""

    def filled(column: str) -> str:
        return f"""coalesce(
    last_value({column} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({column} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ) AS {column}"""

    sql["q_group_fill"] = f"""WITH {gappy}
SELECT event_id, user_id, {filled("reading")}, {filled("processor")} FROM gappy"""

    sql["q_minimal_view"] = f"""{BASE}
SELECT entity_id, array_to_string(list_transform(list_sort(list_distinct(list(edition))), lambda e: CAST(e AS VARCHAR)), ',') AS editions,
       arg_min(country, row_seq) AS country,
       {", ".join(f"coalesce(arg_min({c}, row_seq) FILTER (WHERE {c} IS NOT NULL), 0) AS {c}" for c in ("cpu_tdp", "gpu_tdp", "intensity_a", "intensity_b"))}
FROM fleet GROUP BY entity_id"""

    sql["q_casefold_join"] = f"""WITH {SPECS}
SELECT l_orderkey, l_partkey, l_suppkey, processor, tdp, n_parts
FROM (SELECT l_orderkey, l_partkey, l_suppkey,
             CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || ' x' END AS processor
      FROM {LINE_PARTS})
LEFT JOIN specs ON lower(processor) = lower(spec_name)"""

    sql["q_fuzzy_match"] = f"{CANDIDATES} SELECT name, spec_name, round(score, 6) AS score FROM candidates"
    sql["q_best_match"] = f"""{CANDIDATES}
SELECT name, min(spec_name) AS spec_name, round(max(score), 6) AS score
FROM (SELECT *, max(score) OVER (PARTITION BY name) AS best FROM candidates) WHERE score = best GROUP BY name"""
    sql["q_spec_estimate"] = f"{ESTIMATES} SELECT name, estimate, n_sources FROM estimates"
    sql["q_estimate_sources"] = f"""{CANDIDATES}
SELECT name, spec_name, tdp, CAST(round(power(score / 100, 8) * 100) AS INTEGER) AS weight FROM candidates JOIN specs USING (spec_name)"""
    sql["q_spec_fill"] = f"""{ESTIMATES}
SELECT p_partkey, processor, coalesce(s.tdp, estimate, 200.0) AS tdp
FROM systems LEFT JOIN specs s ON lower(processor) = lower(spec_name) LEFT JOIN estimates ON processor = name"""

    sql["q_unit_counts"] = f"""
WITH lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, floor(l_extendedprice) AS cores,
         CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice / 2) ELSE 0 END AS accel_cores,
         p_size % 8 * 8 AS cpu_num_cores, p_size % 11 AS cpu_tdp,
         CASE WHEN p_size % 3 <> 0 THEN p_size * 10 ELSE 0 END AS n_shaders, p_size % 4 AS n_sm,
         CASE WHEN l_returnflag = 'R' THEN p_size ELSE 0 END AS gpu_tdp
  FROM {LINE_PARTS}),
counted AS (
  SELECT *, CASE WHEN cpu_num_cores > 0 THEN (cores - accel_cores) / cpu_num_cores ELSE 0 END AS cpus,
         CASE WHEN n_shaders > 0 THEN accel_cores / n_shaders * n_sm ELSE 0 END AS gpus FROM lines)
SELECT l_orderkey, l_partkey, l_suppkey,
       CASE WHEN cpu_tdp > 0 AND cpus = 0 THEN 1 ELSE cpus END AS num_cpus,
       CASE WHEN gpu_tdp > 0 AND gpus = 0 THEN 1 ELSE gpus END AS num_gpus
FROM counted"""

    def gwh(tau: str) -> str:
        return f"round(sum(24 * (365.0::DOUBLE / 12) * ((1 - {tau}::DOUBLE) * p_size * 5 + {tau}::DOUBLE * p_size * 10 * l_quantity) / 1e9 * 6), 9)"

    sql["q_power_use"] = f"""
SELECT p_brand, {gwh("0.5")} AS low_gwh, {gwh("0.65")} AS mid_gwh, {gwh("0.8")} AS high_gwh FROM {LINE_PARTS} GROUP BY p_brand"""

    values = f"""
line_values AS (
  SELECT p_name, CASE WHEN l_returnflag <> 'A' THEN p_size ELSE 0 END AS cpu_tdp,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS gpu_tdp, l_linenumber % 4 AS second_gpu_tdp
  FROM {LINE_PARTS})"""
    tdps = ("cpu_tdp", "gpu_tdp", "second_gpu_tdp")
    sql["q_missing_audit"] = f"""WITH {values}
SELECT p_name, count(*) AS n_rows, {", ".join(f"count(*) FILTER (WHERE {c} = 0) AS {c}_missing" for c in tdps)}
FROM line_values GROUP BY p_name HAVING {" OR ".join(f"count(*) FILTER (WHERE {c} = 0) > 0" for c in tdps)}"""
    sql["q_missing_rate"] = f"""WITH {values}
SELECT count(*) AS n_rows, {", ".join(f"count(*) FILTER (WHERE {c} = 0) / count(*) AS {c}_missing_rate" for c in tdps)}
FROM line_values"""

    sql["q_provider_outer"] = f"""WITH {CUSTOMERS}, {INTENSITY}
SELECT country, year, month, intensity_a, intensity_a_direct, intensity_b,
       intensity_difference FROM intensity"""

    sql["q_intensity_join"] = f"""WITH {CUSTOMERS}, {INTENSITY}
SELECT o_orderkey, upper(c.country) AS country, CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month,
       intensity_a, intensity_b
FROM orders JOIN customers c ON o_custkey = c_custkey
LEFT JOIN intensity i ON c.country = i.country AND year(o_orderdate) = year AND month(o_orderdate) = month"""

    sql["q_yearly_compare"] = f"""WITH {CUSTOMERS}, {INTENSITY}
SELECT year, round(avg(intensity_b), 6) AS intensity_b, round(avg(intensity_a), 6) AS intensity_a,
       round(avg(intensity_a_direct), 6) AS intensity_a_direct
FROM intensity WHERE {IN_COUNTRY} AND year >= 1997 GROUP BY year"""

    sql["q_filter_slice"] = f"""{BASE}
SELECT entity_id, o_orderkey, country, segment, edition, metric FROM fleet WHERE {IN_COUNTRY} AND {IN_SEGMENTS}"""

    sql["q_distinct_options"] = "SELECT DISTINCT n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey"

    sql["q_semester_expand"] = f"""{BASE}, {series("all")}
SELECT entity_id, semester, {", ".join(_ENERGY)}, total_gwh * intensity AS total_carbon_t
FROM all_rows WHERE active"""

    sql["q_energy_series"] = f"""{BASE}, {series("all")}
SELECT semester, year_month, {_rounded(_ENERGY)}, {_TURNOVER} FROM all_series"""

    sql["q_carbon_series"] = f"""{BASE}, {series("all")}
SELECT semester, year_month, {_rounded(both)}, {_TURNOVER} FROM all_series"""

    sql["q_carbon_series_b"] = f"""{BASE}, {series("all", "listing = 'F'", "intensity_b", "system")}
SELECT semester, year_month, {_rounded(both)}, {_TURNOVER} FROM all_series"""

    sql["q_impact_country"] = f"""{BASE}, {series("own", f"{IN_COUNTRY} AND {IN_SEGMENTS}")}
SELECT semester, year_month, {_rounded(both)}, {_TURNOVER} FROM own_series"""

    sql["q_computers"] = f"WITH {LISTED} {LABELLED} WHERE final_edition < 2001.5"
    sql["q_exit_active"] = f"WITH {LISTED} {LABELLED}"
    sql["q_chips"] = f"""WITH {LISTED}, {_with_chips("listed", "PROMO")}
SELECT o_orderkey, entity_id, processor, accel_name, cpu_tdp, cpu_num_cores, gpu_tdp, n_shaders, n_sm, second_gpu_tdp FROM chips"""
    gpu_systems = """
systems AS (
  SELECT o_orderkey AS p_partkey, accel_name AS base,
         CASE o_orderkey % 9 WHEN 0 THEN accel_name WHEN 3 THEN accel_name || ' X' || (o_orderkey % 7)
              ELSE 'MARK ' || translate(accel_name, 'AE', 'E') || ' ' || (o_orderkey % 5) END AS processor FROM listed)"""
    gpu_specs = """
specs AS (SELECT p_type AS spec_name, CAST(100 + count(*) % 397 AS DOUBLE) AS tdp FROM part WHERE p_type <> 'PROMO' GROUP BY p_type)"""
    sql["q_gpu_fill"] = f"""{ESTIMATES.replace(SYSTEMS, f"{LISTED}, {gpu_systems}").replace(SPECS, gpu_specs).replace("FROM systems)", "FROM systems WHERE base IS NOT NULL)")}
SELECT p_partkey AS o_orderkey, processor AS accel_name,
       CASE WHEN base = 'ECONOMY' AND p_partkey % 9 = 0 THEN 55.0::DOUBLE ELSE estimate END AS gpu_tdp
FROM systems LEFT JOIN estimates ON processor = name"""
    sql["q_country_intensity"] = f"""WITH {ZONES}
SELECT country, year, month, {", ".join(f"round({c}, 6) AS {c}" for c in ("intensity_a", "intensity_a_direct", "mean_a", "mean_direct"))}
FROM country_zones"""
    sql["q_build_fleet"] = f"""WITH {LISTED}, {_with_chips("computers", "")}, {ZONES}, {INTENSITY.partition("provider_b AS")[1]}{INTENSITY.partition("provider_b AS")[2].partition("intensity AS")[0].rstrip().rstrip(",")}
SELECT o_orderkey, entity_id, edition, final_edition, exit_reason, lifespan, processor, accel_name,
       CASE WHEN cpu_units = 0 THEN 1 ELSE cpu_units END AS num_cpus,
       CASE WHEN gpu_units = 0 AND gpu_tdp > 0 THEN 1 ELSE gpu_units END AS num_gpus,
       coalesce(cpu_tdp, 200) AS cpu_tdp, gpu_tdp,
       round(z.intensity_a, 6) AS intensity_a, round(z.intensity_a_direct, 6) AS intensity_a_direct, round(b.intensity_b, 6) AS intensity_b
FROM (SELECT *, coalesce((cores - coalesce(accel_cores, 0)) / nullif(cpu_num_cores, 0), 0) AS cpu_units,
             coalesce(coalesce(accel_cores, 0) / nullif(n_shaders, 0) * n_sm, 0) AS gpu_units FROM chips) c
LEFT JOIN country_zones z ON c.country = z.country AND {DATE_OF.format(e="edition")} = make_date(z.year, z.month, 1)
LEFT JOIN provider_b b ON c.country = b.country AND {DATE_OF.format(e="edition")} = make_date(b.year, b.month, 1)
WHERE final_edition < 2001.5"""

    sql["q_carbon_by_semester"] = f"""{BASE}, {series("all")},
homes AS (SELECT DISTINCT entity_id, country FROM fleet),
each AS (
  SELECT r.*, coalesce(i.intensity_a, 0) AS now FROM all_rows r JOIN homes h USING (entity_id)
  LEFT JOIN intensity i ON h.country = i.country AND {DATE_OF.format(e="semester")} = make_date(i.year, i.month, 1)),
carbon AS (
  SELECT semester, sum(cpu_gwh * now) AS cpu_carbon_t, sum(gpu_gwh * now) AS gpu_carbon_t, sum(total_gwh * now) AS total_carbon_t
  FROM each GROUP BY semester)
SELECT s.semester, year_month, {_rounded(_ENERGY)}, {", ".join(f"round(c.{x}, 4) AS {x}" for x in _CARBON)}, {_TURNOVER}
FROM all_series s JOIN carbon c USING (semester)"""

    # one order in five under another segment
    moved = f"""{BASE.replace("fleet AS (", "home AS (", 1)},
fleet AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN 'MACHINERY' ELSE segment END AS segment) FROM home)"""
    slices = {
        "all": "TRUE",
        "country": IN_COUNTRY,
        "filled": "segment = 'MACHINERY' AND listing = 'F'",
        "mixed": f"{IN_COUNTRY} AND {IN_SEGMENTS}",
        "mixed open": "segment IN ('BUILDING', 'MACHINERY') AND listing = 'O'",
    }
    ctes = ", ".join(series(f"s{i}", where) for i, where in enumerate(slices.values()))
    answers = " UNION ALL ".join(
        f"SELECT '{name}' AS slice, semester, year_month, {_rounded(both)}, {_TURNOVER} FROM s{i}_series" for i, name in enumerate(slices)
    )
    sql["q_impact_cube"] = f"{moved}, {ctes} {answers}"

    of_region = "country = (SELECT min(n_name) FROM nation WHERE n_regionkey = {r}) AND segment = 'MACHINERY'"
    ctes = ", ".join(series(f"r{r}", of_region.format(r=r)) for r in range(5))
    answers = " UNION ALL ".join(
        f"SELECT (SELECT min(n_name) FROM nation WHERE n_regionkey = {r}) AS name, o.*, "
        f"{', '.join(f'w.{c} / {_N_COUNTRIES} AS fleet_{c}' for c in both)} FROM r{r}_series o JOIN world_series w USING (semester)"
        for r in range(5)
    )
    world = series("world", "segment = 'MACHINERY'")
    sql["q_impact_sql"] = f"""{moved}, {ctes}, {world}, calls AS ({answers})
SELECT name, semester, year_month, {_rounded(both)}, {_TURNOVER}, {_rounded([f"fleet_{c}" for c in both])} FROM calls"""

    sql["q_churn"] = f"""{BASE}, {series("all")}
SELECT semester, systems_added, systems_removed, active_systems FROM all_series"""

    sql["q_fleet_average"] = f"""{BASE}, {series("world", IN_SEGMENTS)}
SELECT semester, year_month, {_rounded(both, _N_COUNTRIES)} FROM world_series"""

    sql["q_entity_vs_fleet"] = f"""{COMPARISON}
SELECT semester, year_month, {_rounded(both)}, {_TURNOVER}, {_rounded([f"fleet_{c}" for c in both])} FROM comparison"""

    sql["q_kpi_summary"] = f"""{COMPARISON},
bounds AS (SELECT min(year_month) AS lo, max(year_month) AS hi FROM comparison WHERE total_gwh > 0),
totals AS (
  SELECT min(year_month) AS first_month, max(year_month) AS last_month,
         year(max(year_month)) - year(min(year_month)) + 1 AS n_years, max(total_systems) AS n_systems,
         sum(total_gwh) AS energy_gwh, sum(total_carbon_t) AS carbon_t,
         sum(fleet_total_gwh) AS fleet_energy_gwh, sum(fleet_total_carbon_t) AS fleet_carbon_t
  FROM comparison, bounds WHERE year_month BETWEEN lo AND hi)
SELECT first_month, last_month, n_years, n_systems,
       {_rounded(["energy_gwh", "carbon_t", "fleet_energy_gwh", "fleet_carbon_t"])},
       round(energy_gwh / fleet_energy_gwh, 6) AS energy_ratio, round(carbon_t / fleet_carbon_t, 6) AS carbon_ratio
FROM totals"""

    def long(source: str, metric: str) -> str:
        column = metric if source == "entity" else f"fleet_{metric}"
        measure = "energy" if "gwh" in metric else "carbon"
        return (
            f"SELECT year_month, '{source}' AS source, '{metric}' AS metric, round({column}, {10 if measure == 'energy' else 4}) AS value, "
            f"'{measure}' AS measure, '{metric.split('_')[0]}' AS component FROM comparison"
        )

    sql["q_unpivot_long"] = COMPARISON + " UNION ALL ".join(
        long(s, m) for s in ("entity", "fleet_average") for m in both
    )

    sql["q_zscore_outliers"] = """
WITH lines AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS price FROM lineitem),
moments AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM lines)
SELECT l_orderkey, l_partkey, price FROM lines, moments WHERE price IS NULL OR abs((price - m) / s) < 1.5"""

    sql["q_growth_models"] = f"""WITH {EDITIONS},
steps AS (SELECT CAST((edition - 1995) * 2 AS BIGINT) AS step, max(o_totalprice) AS rmax FROM editions GROUP BY 1)
SELECT step, rmax, round((SELECT rmax FROM steps WHERE step = 0) * power(2.0::DOUBLE, step / 4.0::DOUBLE), 4) AS doubling_4,
       round((SELECT rmax FROM steps WHERE step = 2) * power(2.0::DOUBLE, (step - 2) / 3.0::DOUBLE), 4) AS doubling_3,
       round(2 * power(exp(CAST(step AS DOUBLE)), 0.25::DOUBLE), 4) AS exponential
FROM steps"""

    sql["q_sample"] = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), '7')), o_orderkey LIMIT 10"""

    sql["q_preview"] = """
WITH top AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5)
SELECT CAST(o_orderkey AS BIGINT) AS row_id, 'o_orderkey' AS column_name, CAST(o_orderkey AS VARCHAR) AS value FROM top
UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM top
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM top"""
    sql["q_exit_reason_hot"] = sql["q_exit_reason"]
    sql["q_group_fill_hot"] = sql["q_group_fill"]
    return sql
