"""Independent SQL (DuckDB dialect) of the preparation chain, as CTE blocks.

Used only to check the Spark operators: every registered query has an SQL
twin built from these blocks.  The SQL is written from the semantics, not
from the Spark plan (plain joins and windows, quantile_cont, NOT IN).
"""

from __future__ import annotations

from cohortlens.schema import MEASURES, MEASURE_LABELS, MODEL_NAMES
from cohortlens.sources.lookups import values_sql
from cohortlens.sources.measures import KEY_MEASURES_RAW_SQL

M = MEASURES


def u_sql(key: str, salt: str) -> str:
    return f"((CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{salt}'), 1, 15) AS BIGINT) >> 7) / 9007199254740992.0)"


REDUCED = """
km AS (
  SELECT person_id, org_id_provider, care_contacts, referrals, length_care, average_daily_contacts,
         contact_prop_aft_midpoint,
         TRY_CAST(trim(team_input_count) AS DOUBLE) AS team_input_count,
         COALESCE(TRY_CAST(trim(intermittent_care_periods) AS DOUBLE), 0.0) AS intermittent_care_periods,
         specialist_contact_prop, remote_contact_prop,
         TRY_CAST(trim(avg_contact_duration) AS DOUBLE) AS avg_contact_duration,
         COALESCE(TRY_CAST(trim(acute_admissions_2223) AS DOUBLE), 0.0) AS acute_admissions_2223
  FROM key_measures_raw),
reduced AS (
  SELECT * FROM km
  WHERE person_id NOT IN (SELECT person_id FROM key_measures_raw GROUP BY person_id HAVING count(*) > 1))
"""


def _draw_block(value: str, salt: str, by_org: bool) -> str:
    org_part = ""
    if by_org:
        org_part = f"""
{value}_org AS (
  SELECT org_id_provider AS grp, {value} AS field, count(*) AS n
  FROM reduced WHERE {value} IS NOT NULL GROUP BY org_id_provider, {value}),"""
    org_union = ""
    if by_org:
        org_union = f"""
  UNION ALL
  SELECT 'org', grp, field,
         sum(n) OVER (PARTITION BY grp ORDER BY field) - n,
         sum(n) OVER (PARTITION BY grp ORDER BY field),
         sum(n) OVER (PARTITION BY grp)
  FROM {value}_org"""
    pick_join = ""
    scope = "'all'"
    grp = "''"
    total = "a.total"
    if by_org:
        pick_join = f"LEFT JOIN (SELECT DISTINCT grp, total FROM {value}_cum WHERE scope = 'org') o ON o.grp = r.org_id_provider"
        scope = "CASE WHEN o.total IS NULL THEN 'all' ELSE 'org' END"
        grp = "CASE WHEN o.total IS NULL THEN '' ELSE o.grp END"
        total = "COALESCE(o.total, a.total)"
    return f"""{org_part}
{value}_all AS (
  SELECT {value} AS field, count(*) AS n FROM reduced WHERE {value} IS NOT NULL GROUP BY {value}),
{value}_cum AS (
  SELECT 'all' AS scope, '' AS grp, field,
         sum(n) OVER (ORDER BY field) - n AS lo,
         sum(n) OVER (ORDER BY field) AS hi,
         sum(n) OVER () AS total
  FROM {value}_all{org_union}),
{value}_pick AS (
  SELECT r.person_id, {scope} AS scope, {grp} AS grp,
         floor({u_sql('r.person_id', salt)} * CAST({total} AS DOUBLE)) AS rk
  FROM reduced r {pick_join}
  CROSS JOIN (SELECT DISTINCT total FROM {value}_cum WHERE scope = 'all') a
  WHERE r.{value} IS NULL),
{value}_draw AS (
  SELECT p.person_id, c.field AS drawn
  FROM {value}_pick p JOIN {value}_cum c
    ON c.scope = p.scope AND c.grp = p.grp AND p.rk >= c.lo AND p.rk < c.hi)"""


def _imputed_select() -> str:
    cols = []
    for c in ["org_id_provider", *M]:
        if c == "team_input_count":
            cols.append("COALESCE(r.team_input_count, t.drawn) AS team_input_count")
        elif c == "avg_contact_duration":
            cols.append("COALESCE(r.avg_contact_duration, d.drawn) AS avg_contact_duration")
        else:
            cols.append(f"r.{c}")
    return ", ".join(cols)


IMPUTED = (_draw_block("team_input_count", "team", True) + "," + _draw_block("avg_contact_duration", "duration", False)
           + f""",
imputed AS (
  SELECT r.person_id, {_imputed_select()}
  FROM reduced r
  LEFT JOIN team_input_count_draw t ON t.person_id = r.person_id
  LEFT JOIN avg_contact_duration_draw d ON d.person_id = r.person_id)
""")

QUANT = "q99 AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.99) AS q_{c}" for c in M) + " FROM imputed)"

TRIMMED = (QUANT + ",\ntrimmed AS (SELECT i.person_id, " + ", ".join(f"i.{c}" for c in M)
           + " FROM imputed i CROSS JOIN q99 WHERE NOT ("
           + " OR ".join(f"i.{c} > q99.q_{c}" for c in M) + "))")

SCALED = ("mom AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in M)
          + " FROM trimmed),\nscaled AS (SELECT t.person_id, "
          + ", ".join(f"(t.{c} - mom.m_{c}) / mom.s_{c} AS {c}" for c in M)
          + " FROM trimmed t CROSS JOIN mom)")

LOOKUP_LABELS = values_sql(MEASURE_LABELS, ["variable", "variable_clean"])
LOOKUP_MODELS = values_sql(MODEL_NAMES, ["model", "model_name"])


def chain(stage: str) -> str:
    """WITH-clause body up to the named stage (raw, reduced, imputed, trimmed, scaled)."""
    parts = [KEY_MEASURES_RAW_SQL.strip()]
    order = ["reduced", "imputed", "trimmed", "scaled"]
    blocks = {"reduced": REDUCED, "imputed": IMPUTED, "trimmed": TRIMMED, "scaled": SCALED}
    if stage != "raw":
        for s in order:
            parts.append(blocks[s].strip())
            if s == stage:
                break
    return "WITH " + ",\n".join(parts) + "\n"


def unpivot_sql(table: str, id_col: str, cols=M, value: str = "value") -> str:
    return " UNION ALL ".join(
        f"SELECT {id_col}, '{c}' AS name, {c} AS {value} FROM {table}" for c in cols)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
