"""Views that give the star-schema tables the shape of clinical data.

Each view exists twice, as a DataFrame and as the SQL text of a CTE. The tables hold no
NULL, so the views put some in. Every view covers all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_like, drop_bracket_prefix
from ..operators.events import EventColumns, Events, Milestones, milestones
from ..operators.skew import skew_join
from .registry import Tables

# Events of two sources. A person (`master`) can own several records (`person`).
COLUMNS = EventColumns(person="master", record="person", time="ts", text="txt", source="source", order=("eid",))
INDEX, OUTCOME, EXCLUDED = ("%sign%up%",), ("%err%: 91%", "%purch%: 5%1%"), ("%signup%: 33%",)
_PERSON_SQL = "user_id // 2 AS master"
# In this variant some events of every fifth record belong to another person.
SHARED_PERSON_SQL = "CASE WHEN user_id % 5 = 0 AND event_id % 3 = 0 THEN 1000000 + user_id ELSE user_id // 2 END AS master"

EVENTS_SQL = """v AS (
  SELECT event_id AS eid, CASE WHEN event_id % 2 = 0 THEN 'out' ELSE 'in' END AS source,
         user_id AS person, user_id // 2 AS master, event_type || ' ' || props AS txt,
         CASE WHEN event_id % 41 <> 0 THEN ts END AS ts,
         CASE WHEN user_id % 23 <> 0 THEN TIMESTAMP '1960-03-01' + to_days(CAST(user_id * 97 AS INTEGER)) END AS birthday
  FROM events)"""


def events(t: Tables, shared_records: bool = False) -> Events:
    eid, user = F.col("event_id"), F.col("user_id")
    born = F.lit("1960-03-01").cast("timestamp_ntz") + F.make_dt_interval((user * 97).cast("int"))
    frame = t.events.select(
        eid.alias("eid"),
        F.when(eid % 2 == 0, F.lit("out")).otherwise(F.lit("in")).alias("source"),
        user.alias("person"),
        F.when(F.lit(shared_records) & (user % 5 == 0) & (eid % 3 == 0), 1000000 + user).otherwise(F.shiftright(user, 1)).alias("master"),
        F.concat_ws(" ", "event_type", "props").alias("txt"),
        F.when(eid % 41 != 0, F.col("ts")).alias("ts"),
        F.when(user % 23 != 0, born).alias("birthday"),
    )
    return Events(frame, ("out", "in"), COLUMNS)


def cohort_milestones(t: Tables, shared_records: bool = False) -> Milestones:
    txt = F.col("txt")
    return milestones(
        events(t, shared_records),
        {"index": any_like(txt, INDEX), "outcome": any_like(txt, OUTCOME),
         "excluded": any_like(txt, EXCLUDED), "contact": None},
        latest=["contact"],
    )


# First index events, first outcomes, excluded persons and last contacts in SQL.
INDEX_SQL = """idx AS (
  SELECT * FROM (
    SELECT *, rank() OVER (PARTITION BY master ORDER BY ts) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY source, master ORDER BY ts ASC NULLS FIRST, eid) AS rn
      FROM v WHERE txt LIKE '%sign%up%') WHERE rn = 1 AND ts IS NOT NULL) WHERE rk = 1)"""
OUTCOME_SQL = """outc AS (
  SELECT * FROM (
    SELECT *, rank() OVER (PARTITION BY master ORDER BY ts) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY source, person, master ORDER BY ts ASC NULLS FIRST, eid) AS rn
      FROM v WHERE txt LIKE '%err%: 91%' OR txt LIKE '%purch%: 5%1%') WHERE rn = 1 AND ts IS NOT NULL) WHERE rk = 1)"""
EXCLUDED_SQL = "ex AS (SELECT DISTINCT master FROM v WHERE txt LIKE '%signup%: 33%')"
CONTACT_SQL = """lc AS (
  SELECT DISTINCT master, ts, txt FROM (
    SELECT *, rank() OVER (PARTITION BY master ORDER BY ts DESC) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY source, person, master ORDER BY ts DESC NULLS LAST, eid DESC) AS rn
      FROM v) WHERE rn = 1 AND ts IS NOT NULL) WHERE rk = 1)"""
COHORT_SQL = f"""{EVENTS_SQL}, {INDEX_SQL}, {OUTCOME_SQL}, {EXCLUDED_SQL}, {CONTACT_SQL}, joined AS (
  SELECT i.master, i.ts AS index_time, i.txt AS index_text, i.birthday, o.ts AS o_time, o.txt AS o_text
  FROM idx i LEFT JOIN outc o ON i.master = o.master
  WHERE i.master NOT IN (SELECT master FROM ex)
    AND i.master NOT IN (SELECT master FROM idx WHERE birthday IS NULL)),
cohort AS (
  SELECT j.master, index_time, index_text, birthday,
         coalesce(o_time, l.ts) AS end_time, coalesce(o_text, l.txt) AS end_text, o_time IS NOT NULL AS observed,
         CAST(date_diff('day', CAST(index_time AS DATE), CAST(coalesce(o_time, l.ts) AS DATE)) AS INTEGER) AS gap_days,
         CASE WHEN date_diff('day', CAST(index_time AS DATE), CAST(coalesce(o_time, l.ts) AS DATE)) < 1
              THEN -1 ELSE 1 END AS label
  FROM joined j LEFT JOIN lc l ON j.master = l.master AND j.o_time IS NULL)"""

SHARED_COHORT_SQL = COHORT_SQL.replace(_PERSON_SQL, SHARED_PERSON_SQL)

# Charges of coded items: line items are charges, orders visits, customers person records.
CODES_SQL = """codes AS (
  SELECT p_name, CASE WHEN min(p_partkey) % 4 = 0 THEN 'N' ELSE 'C' END
                 || lpad(CAST(min(p_partkey) % 50 AS VARCHAR), 2, '0') || 'AA ' AS code
  FROM part GROUP BY p_name)"""
CHARGES_SQL = """charges AS (
  SELECT l_orderkey AS reg_id, p_name AS item, l_linestatus AS source,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS charge_time
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EXPOSED_SQL = f"""{CODES_SQL}, {CHARGES_SQL}, exposed AS (
  SELECT c_custkey // 2 AS master, charge_time, item, code, source
  FROM codes JOIN charges ON p_name = item JOIN orders ON reg_id = o_orderkey
       JOIN customer ON o_custkey = c_custkey
  WHERE code LIKE 'C%')"""


def codes(t: Tables) -> DataFrame:
    first = F.min("p_partkey")
    letter = F.when(first % 4 == 0, F.lit("N")).otherwise(F.lit("C"))
    code = F.concat(letter, F.lpad((first % 50).cast("string"), 2, "0"), F.lit("AA "))
    return t.part.groupBy(F.col("p_name").alias("item")).agg(code.alias("code"))


def charges(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return skew_join(t.lineitem, parts, "l_partkey").select(
        F.col("l_orderkey").alias("reg_id"),
        F.col("p_name").alias("item"),
        F.col("l_linestatus").alias("source"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("charge_time"),
    )


def lines_with_orders(t: Tables) -> DataFrame:
    """Line items with the columns of their order."""
    orders = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return skew_join(t.lineitem, orders, "l_orderkey", spread_by=["l_partkey", "l_linenumber"])


# Two sources that number their visits alike: orders are outpatient visits of their customer, and
# under the same numbers inpatient visits of another one.
TWO_SOURCES_SQL = f"""{CODES_SQL}, {CHARGES_SQL}, two_visits AS (
  SELECT 'O' AS source, o_orderkey AS reg_id, o_custkey // 2 AS master FROM orders
  UNION ALL SELECT 'F', o_orderkey, 1000000 + o_custkey // 3 FROM orders WHERE o_orderkey % 4 <> 0),
exposed AS (
  SELECT master, charge_time, item, code, source
  FROM codes JOIN charges ON p_name = item JOIN two_visits USING (source, reg_id) WHERE code LIKE 'C%')"""


def charges_by_source(t: Tables) -> dict[str, DataFrame]:
    rows = charges(t)
    return {s: rows.filter(F.col("source") == s).drop("source") for s in ("O", "F")}


def visit_persons_by_source(t: Tables) -> dict[str, DataFrame]:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return {
        "O": t.orders.select(order.alias("reg_id"), F.shiftright(customer, 1).alias("master")),
        "F": t.orders.filter(order % 4 != 0).select(order.alias("reg_id"), (1000000 + F.floor(customer / 3)).alias("master")),
    }


def visits(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("reg_id"), F.col("o_custkey").alias("person_id"))


def persons(t: Tables) -> DataFrame:
    """Person records; the real person is text, the old key column is replaced by it."""
    return t.customer.select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_name").alias("MASTER_INDEX"),
        F.shiftright("c_custkey", 1).cast("string").alias("MASTER_INDEX2"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_nationkey") != 3, F.lit("1960-03-01").cast("timestamp_ntz")).alias("birthday"),
    )


# Diagnoses for the three-table link.
DIAGNOSES_SQL = """diag AS (
  SELECT l_orderkey AS reg_id, l_returnflag || ' ' || l_linestatus || ' ' || CAST(l_linenumber AS VARCHAR) AS disease,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS diag_time,
         l_linenumber, l_partkey, l_suppkey
  FROM lineitem),
pers AS (SELECT c_custkey AS person_id, c_custkey // 2 AS MASTER_INDEX, c_mktsegment AS segment FROM customer)"""


def diagnoses(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("reg_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("disease"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("diag_time"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


# Diagnoses, visits and persons of two sources for the whole study: line items by status, with
# orders as visits of both sources.
STUDY_COLUMNS = EventColumns(
    person="MASTER_INDEX", record="person_id", time="diag_time", text="disease", source="source",
    order=("l_linenumber", "l_partkey", "l_suppkey", "reg_id"),
)
STUDY_INDEX, STUDY_OUTCOME, STUDY_EXCLUDED = ("R%small%",), ("%A%red%r%", "N%hot anvil%"), ("A%new ring 5%",)
_STUDY_LIKE = {
    "idx": "disease LIKE 'R%small%'",
    "outc": "(disease LIKE '%A%red%r%' OR disease LIKE 'N%hot anvil%')",
}


def _first_sql(name: str, group: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, rank() OVER (PARTITION BY MASTER_INDEX ORDER BY diag_time) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY source, {group}
        ORDER BY diag_time ASC NULLS FIRST, l_linenumber, l_partkey, l_suppkey, reg_id) AS rn
      FROM ev WHERE {_STUDY_LIKE[name]}) WHERE rn = 1 AND diag_time IS NOT NULL) WHERE rk = 1)"""


STUDY_SQL = f"""ev AS (
  SELECT l_orderkey AS reg_id, l_returnflag || ' ' || p_name || ' ' || CAST(l_linenumber AS VARCHAR) AS disease,
         CASE WHEN l_linenumber <> 7 OR l_tax > 0.01 THEN l_shipdate END AS diag_time, l_linestatus AS source,
         l_linenumber, l_partkey, l_suppkey, c_custkey AS person_id, c_custkey // 2 AS MASTER_INDEX, c_mktsegment AS segment,
         CASE WHEN c_nationkey <> 3 THEN TIMESTAMP '1960-03-01' END AS birthday
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey),
{_first_sql("idx", "MASTER_INDEX")}, {_first_sql("outc", "person_id")},
ex AS (SELECT DISTINCT MASTER_INDEX FROM ev WHERE disease LIKE 'A%new ring 5%'),
lc AS (
  SELECT DISTINCT MASTER_INDEX, diag_time, disease FROM (
    SELECT *, rank() OVER (PARTITION BY MASTER_INDEX ORDER BY diag_time DESC) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY source, person_id ORDER BY diag_time DESC NULLS LAST,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC, reg_id DESC) AS rn
      FROM ev) WHERE rn = 1 AND diag_time IS NOT NULL) WHERE rk = 1),
joined AS (
  SELECT i.MASTER_INDEX, i.person_id, i.segment, i.birthday, i.diag_time AS index_time, i.disease AS index_text,
         o.diag_time AS o_time, o.disease AS o_text
  FROM idx i LEFT JOIN outc o ON i.MASTER_INDEX = o.MASTER_INDEX
  WHERE i.MASTER_INDEX NOT IN (SELECT MASTER_INDEX FROM ex)
    AND i.MASTER_INDEX NOT IN (SELECT MASTER_INDEX FROM idx WHERE birthday IS NULL)),
ended AS (
  SELECT j.MASTER_INDEX, person_id, segment, birthday, index_time, index_text,
         coalesce(o_time, l.diag_time) AS end_time, coalesce(o_text, l.disease) AS end_text, o_time IS NOT NULL AS observed
  FROM joined j LEFT JOIN lc l ON j.MASTER_INDEX = l.MASTER_INDEX AND j.o_time IS NULL),
cohort AS (
  SELECT *, CAST(date_diff('day', CAST(index_time AS DATE), CAST(end_time AS DATE)) AS INTEGER) AS gap_days,
         CASE WHEN date_diff('day', CAST(index_time AS DATE), CAST(end_time AS DATE)) < 1 THEN -1 ELSE 1 END AS label
  FROM ended)"""


def study_diagnoses(t: Tables) -> DataFrame:
    """Diagnoses of both sources in one frame."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    dated = (F.col("l_linenumber") != 7) | (F.col("l_tax") > 0.01)
    return skew_join(t.lineitem, parts, "l_partkey").select(
        F.col("l_orderkey").alias("reg_id"),
        F.concat_ws(" ", "l_returnflag", "p_name", F.col("l_linenumber").cast("string")).alias("disease"),
        F.when(dated, F.col("l_shipdate")).alias("diag_time"),
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("source"),
    )


def study_visits(t: Tables) -> dict[str, DataFrame]:
    return {s: visits(t) for s in ("O", "F")}


# Raw item names of two sources, and a dictionary with repeated names and outer blanks.
FEES_SQL = """fees AS (
  SELECT '(' || p_type || ')' || CASE WHEN p_type = 'PROMO' THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END
         || ' x' AS item, p_type AS category, CASE WHEN p_size <= 25 THEN 'out' ELSE 'in' END AS source
  FROM part),
names AS (
  SELECT regexp_replace(item, '^[(（].*?[)）]+', '') AS item
  FROM (SELECT DISTINCT item FROM fees WHERE category LIKE '%AR%' OR category LIKE '%O%'))"""
DICTIONARY_SQL = """common AS (
  SELECT p_name AS common_name FROM part GROUP BY p_name
  HAVING avg(p_size) >= (SELECT avg(p_size) FROM part)),
dictionary AS (
  SELECT CASE WHEN p_size > 40 THEN ' ' || p_name || ' ' ELSE p_name END AS medical_name,
         p_brand AS atc, p_partkey AS ord
  FROM part JOIN common ON p_name = common_name),
words AS (
  SELECT trim(medical_name) AS word, min(ord) AS ord FROM dictionary GROUP BY medical_name),
paths AS (SELECT DISTINCT word AS path, word FROM words),
word_codes AS (SELECT trim(medical_name) AS word, arg_max(atc, ord) AS code FROM dictionary GROUP BY 1),
prefixes AS (
  SELECT list(DISTINCT substr(path, 1, CAST(i AS INTEGER))) AS ps FROM paths, range(1, 40) r(i) WHERE i <= length(path)),
walked AS (
  SELECT item, list_reduce(string_split(item, ''),
           lambda acc, ch: CASE WHEN list_contains(ps, acc || ch) THEN acc || ch ELSE acc END, '') AS node, ps
  FROM names, prefixes),
stepped AS (
  SELECT item, CASE WHEN node NOT IN (SELECT path FROM paths) AND list_contains(ps, node || 't')
               THEN node || 't' ELSE node END AS node FROM walked),
standardised AS (
  SELECT item, p.word AS standard, c.code AS code FROM stepped
  LEFT JOIN paths p ON node = p.path LEFT JOIN word_codes c ON p.word = c.word)"""
SUFFIX = "t"
CATEGORIES = ("%AR%", "%O%")


def fees(t: Tables) -> list[DataFrame]:
    name = F.when(F.col("p_type") == "PROMO", F.expr("substring(p_name, 1, length(p_name) - 1)")).otherwise(
        F.col("p_name")
    )
    rows = t.part.select(
        F.concat(F.lit("("), "p_type", F.lit(")"), name, F.lit(" x")).alias("item"),
        F.col("p_type").alias("category"),
        "p_size",
    )
    return [rows.filter("p_size <= 25").drop("p_size"), rows.filter("p_size > 25").drop("p_size")]


def common_names(t: Tables) -> DataFrame:
    """Part names whose mean size reaches the mean of all parts."""
    part = t.part
    mean = part.agg(F.avg("p_size")).scalar()
    return part.groupBy("p_name").agg(F.avg("p_size").alias("size")).filter(F.col("size") >= mean).select("p_name")


def dictionary(t: Tables) -> DataFrame:
    padded = F.when(F.col("p_size") > 40, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return skew_join(t.part, common_names(t), "p_name").select(
        padded.alias("medical_name"), F.col("p_brand").alias("atc"), F.col("p_partkey").alias("ord")
    )


# A catalogue with missing codes, and rules made of the words of part names.
CATALOG_ONLY_SQL = """catalog AS (
  SELECT p_partkey, p_name AS item, CASE WHEN p_size <= 17 THEN p_brand END AS code, CAST(NULL AS VARCHAR) AS std
  FROM part)"""
CATALOG_SQL = CATALOG_ONLY_SQL + """,
word_rows AS (SELECT unnest(string_split(p_name, ' ')) AS word, p_type, p_brand, p_size FROM part),
rules AS (
  SELECT word, p_type || '/' || word AS ord, min(p_brand) AS code, upper(word) AS std FROM word_rows
  GROUP BY word, p_type HAVING avg(p_size) >= (SELECT avg(p_size) FROM part)),
first_rule AS (
  SELECT item, arg_min(r.code, r.ord) AS code, arg_min(r.std, r.ord) AS std
  FROM (SELECT DISTINCT item FROM catalog WHERE code IS NULL) n JOIN rules r ON contains(n.item, r.word)
  GROUP BY item),
filled AS (
  SELECT c.p_partkey, c.item, coalesce(c.code, f.code) AS code,
         CASE WHEN c.code IS NULL AND f.code IS NOT NULL THEN f.std ELSE c.std END AS std,
         c.code IS NULL AND f.code IS NOT NULL AS changed
  FROM catalog c LEFT JOIN first_rule f ON c.item = f.item)"""


def catalog(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.col("p_name").alias("item"),
        F.when(F.col("p_size") <= 17, F.col("p_brand")).alias("code"),
        F.lit(None).cast("string").alias("std"),
    )


def rules(t: Tables) -> DataFrame:
    part = t.part
    mean = part.agg(F.avg("p_size")).scalar()
    words = part.select(F.explode(F.split("p_name", " ")).alias("word"), "p_type", "p_brand", "p_size")
    return (
        words.groupBy("word", "p_type")
        .agg(F.min("p_brand").alias("rule_code"), F.avg("p_size").alias("size"))
        .filter(F.col("size") >= mean)
        .select("word", F.concat_ws("/", "p_type", "word").alias("ord"), "rule_code", F.upper("word").alias("rule_std"))
    )


def raw_names(t: Tables) -> DataFrame:
    """All cleaned item names, one row per charge line of the part table."""
    out, inside = fees(t)
    return out.unionByName(inside).select(drop_bracket_prefix(F.col("item")).alias("item"))
