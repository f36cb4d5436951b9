"""The raw per-person measure table, derived from the order tables.

The study's 11 measures arrive ready-made; here they are derived from
``orders`` / ``lineitem`` / ``customer`` so that the whole analysis runs over
tables whose size grows with the scale factor.  One row per customer that
has line items (``person_id`` = customer key), the organisation is the
customer's nation, and "contacts" are line items on their ship dates.

Missing values and duplicated persons are made by data rules (segment,
account balance), so that imputation and de-duplication have work to do:

* team_input_count  NULL for the HOUSEHOLD segment and for nation 0
  (so one organisation has no distribution at all);
* intermittent_care_periods NULL when there is no gap, or balance < 0;
* avg_contact_duration NULL for the AUTOMOBILE segment;
* acute_admissions_2223 NULL when there is no urgent order;
* persons with balance > 9900 appear twice.

The four nullable measures come as text (like the original CSV extract),
with the literal ``NULL`` for missing values.

Plan shape: the line items are joined to their orders once and reduced to
one row per (person, ship date, supplier), which is written once; per-day,
per-person and distinct-supplier figures all come from that table. The per-person
figures are written once more, and every later join is on the person key.
The windows run per person over distinct ship dates only, which the
calendar bounds, so a very active person does not make a huge window group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import write_stage
from cohortlens.sources.tables import read_table

GAP_DAYS = 90
URGENT = "1-URGENT"


def _text(c):
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def key_measures_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    li = read_table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
        F.to_date("l_shipdate").alias("ship_date"))
    od = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = read_table(spark, data_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")

    lines = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("person_id"), "l_suppkey", "ship_date", "l_quantity",
        (F.col("l_returnflag") == "R").cast("int").alias("is_r"),
        (F.col("l_linestatus") == "F").cast("int").alias("is_f"))

    # The only pass over the line items: one join, one aggregation to
    # (person, date, supplier), written once; every branch below reads it.
    pds = write_stage(lines.groupBy("person_id", "ship_date", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
        F.sum("is_r").alias("nr"), F.sum("is_f").alias("nf")), "contacts")

    per_day = pds.groupBy("person_id", "ship_date").agg(
        F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.sum("nr").alias("nr"), F.sum("nf").alias("nf"))

    # first and last contact come from the person's window, so a task sorts the days once and joins none of them
    person = Window.partitionBy("person_id")
    day = (per_day.withColumn("gap", F.datediff("ship_date", F.lag("ship_date").over(person.orderBy("ship_date"))))
           .withColumns({"first_contact": F.min("ship_date").over(person), "last_contact": F.max("ship_date").over(person)}))
    late = 2 * F.datediff("ship_date", "first_contact") > F.datediff("last_contact", "first_contact")
    # written: its sorts give back their memory before the joins take theirs
    span = write_stage(day.groupBy("person_id").agg(
        F.min("first_contact").alias("first_contact"), F.max("last_contact").alias("last_contact"),
        F.sum("n").alias("n_lines"), F.sum("qty").alias("qty"),
        F.sum("nr").alias("nr"), F.sum("nf").alias("nf"),
        F.sum(F.when(F.col("gap") > GAP_DAYS, 1).otherwise(0)).alias("n_gaps"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_after")), "persons")

    supp = pds.groupBy("person_id").agg(F.countDistinct("l_suppkey").alias("n_supp"))

    ords = od.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum((F.col("o_orderpriority") == URGENT).cast("int")).alias("n_urgent"))

    p = (span.join(supp, "person_id").join(ords, "person_id")
         .join(cu, F.col("person_id") == F.col("c_custkey")))

    length = F.datediff("last_contact", "first_contact")
    contacts = F.col("n_lines").cast("double")
    team = F.when((F.col("c_mktsegment") == "HOUSEHOLD") | (F.col("c_nationkey") == 0), None) \
        .otherwise(F.col("n_supp").cast("double"))
    gaps = F.when((F.col("n_gaps") == 0) | (F.col("c_acctbal") < 0), None) \
        .otherwise(F.col("n_gaps").cast("double"))
    duration = F.when(F.col("c_mktsegment") == "AUTOMOBILE", None) \
        .otherwise(F.round(F.col("qty") / contacts, 0))
    acute = F.when(F.col("n_urgent") == 0, None).otherwise(F.col("n_urgent").cast("double"))

    persons = p.select(
        F.col("person_id").cast("bigint").alias("person_id"),
        F.concat(F.lit("ORG"), F.col("c_nationkey").cast("string")).alias("org_id_provider"),
        "first_contact", "last_contact",
        F.date_add("first_contact", F.floor(length / 2).cast("int")).alias("care_mid_date"),
        contacts.alias("care_contacts"),
        F.col("n_orders").cast("double").alias("referrals"),
        length.cast("double").alias("length_care"),
        (contacts / (length + 1).cast("double")).alias("average_daily_contacts"),
        (F.col("n_after").cast("double") / contacts).alias("contact_prop_aft_midpoint"),
        _text(team).alias("team_input_count"),
        _text(gaps).alias("intermittent_care_periods"),
        (F.col("nr").cast("double") / contacts).alias("specialist_contact_prop"),
        (F.col("nf").cast("double") / contacts).alias("remote_contact_prop"),
        _text(duration).alias("avg_contact_duration"),
        _text(acute).alias("acute_admissions_2223"),
        F.explode(F.when(F.col("c_acctbal") > 9900, F.array(F.lit(1), F.lit(2)))
                  .otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    # Duplicated persons come from one pass (explode), not a union that
    # would evaluate the whole derivation twice.
    return persons.drop("_copy")


KEY_MEASURES_RAW_SQL = """
lines AS (
  SELECT o.o_custkey AS person_id, l.l_suppkey, CAST(l.l_shipdate AS DATE) AS ship_date, l.l_quantity,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_r,
         CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS is_f
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
per_day AS (
  SELECT person_id, ship_date, count(*) AS n, sum(l_quantity) AS qty, sum(is_r) AS nr, sum(is_f) AS nf
  FROM lines GROUP BY person_id, ship_date),
span AS (
  SELECT person_id, min(ship_date) AS first_contact, max(ship_date) AS last_contact,
         sum(n) AS n_lines, sum(qty) AS qty, sum(nr) AS nr, sum(nf) AS nf
  FROM per_day GROUP BY person_id),
shape AS (
  SELECT d.person_id,
         sum(CASE WHEN d.gap > 90 THEN 1 ELSE 0 END) AS n_gaps,
         sum(CASE WHEN 2 * date_diff('day', s.first_contact, d.ship_date)
                       > date_diff('day', s.first_contact, s.last_contact) THEN d.n ELSE 0 END) AS n_after
  FROM (SELECT person_id, ship_date, n,
               date_diff('day', lag(ship_date) OVER (PARTITION BY person_id ORDER BY ship_date), ship_date) AS gap
        FROM per_day) d
  JOIN span s ON s.person_id = d.person_id
  GROUP BY d.person_id),
supp AS (SELECT person_id, count(DISTINCT l_suppkey) AS n_supp FROM lines GROUP BY person_id),
ords AS (
  SELECT o_custkey AS person_id, count(*) AS n_orders,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent
  FROM orders GROUP BY o_custkey),
persons AS (
  SELECT CAST(s.person_id AS BIGINT) AS person_id,
         'ORG' || CAST(c.c_nationkey AS VARCHAR) AS org_id_provider,
         s.first_contact, s.last_contact,
         s.first_contact + CAST(floor(date_diff('day', s.first_contact, s.last_contact) / 2) AS INTEGER) AS care_mid_date,
         CAST(s.n_lines AS DOUBLE) AS care_contacts,
         CAST(o.n_orders AS DOUBLE) AS referrals,
         CAST(date_diff('day', s.first_contact, s.last_contact) AS DOUBLE) AS length_care,
         CAST(s.n_lines AS DOUBLE) / CAST(date_diff('day', s.first_contact, s.last_contact) + 1 AS DOUBLE) AS average_daily_contacts,
         CAST(h.n_after AS DOUBLE) / CAST(s.n_lines AS DOUBLE) AS contact_prop_aft_midpoint,
         COALESCE(CAST(CASE WHEN c.c_mktsegment = 'HOUSEHOLD' OR c.c_nationkey = 0 THEN NULL
                            ELSE CAST(p.n_supp AS DOUBLE) END AS VARCHAR), 'NULL') AS team_input_count,
         COALESCE(CAST(CASE WHEN h.n_gaps = 0 OR c.c_acctbal < 0 THEN NULL
                            ELSE CAST(h.n_gaps AS DOUBLE) END AS VARCHAR), 'NULL') AS intermittent_care_periods,
         CAST(s.nr AS DOUBLE) / CAST(s.n_lines AS DOUBLE) AS specialist_contact_prop,
         CAST(s.nf AS DOUBLE) / CAST(s.n_lines AS DOUBLE) AS remote_contact_prop,
         COALESCE(CAST(CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN NULL
                            ELSE round(s.qty / CAST(s.n_lines AS DOUBLE), 0) END AS VARCHAR), 'NULL') AS avg_contact_duration,
         COALESCE(CAST(CASE WHEN o.n_urgent = 0 THEN NULL
                            ELSE CAST(o.n_urgent AS DOUBLE) END AS VARCHAR), 'NULL') AS acute_admissions_2223,
         c.c_acctbal
  FROM span s
  JOIN shape h ON h.person_id = s.person_id
  JOIN supp p ON p.person_id = s.person_id
  JOIN ords o ON o.person_id = s.person_id
  JOIN customer c ON c.c_custkey = s.person_id),
key_measures_raw AS (
  SELECT * EXCLUDE (c_acctbal) FROM persons
  UNION ALL
  SELECT * EXCLUDE (c_acctbal) FROM persons WHERE c_acctbal > 9900)
"""
