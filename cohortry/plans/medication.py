"""Queries on exposures, item names and code tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.collation import collated_like, plain_text, under_collation
from ..functions.labels import fill_missing
from ..functions.text import ascii_brackets, clean_label, excluded_code
from ..functions.fixed_values import MISSING_NAME, WHITE_SPACE
from ..operators.cohort import frequency
from ..operators.exposures import exposures, first_exposure, first_exposure_of_charges
from ..operators.linking import canonical_person, visit_persons
from ..operators.names import dictionary_table, distinct_clean_names, match_ratio, standardise
from ..operators.rules import AUTOMATON_LIMIT, changed_rows, fill_by_automaton, fill_by_pattern, fill_from_names
from ..operators.sets import first_per_key
from ..operators.skew import BroadcastLimit, lookup_join, skew_join
from ..sources.shared import shared_folder
from ..sources.records import read_records
from ..sources.tables import query as run_sql
from ..sources.tables import read_csv, read_csv_checked, read_table, write_csv, write_table
from ..sources.updates import Updated, update_in_place
from . import fixtures as fx
from .registry import Tables, query


def _visit_person(t: Tables):
    people = canonical_person(fx.persons(t)).select("person_id", F.col("MASTER_INDEX").alias("master"))
    return visit_persons(fx.visits(t), people, "reg_id", "person_id")


def _exposed(t: Tables):
    rows = exposures(
        fx.charges(t), fx.codes(t), _visit_person(t), item="item", code="code", visit="reg_id", spread_by=["charge_time"]
    )
    return rows.select(
        "master", "charge_time", "item", "code", "source"
    )


query("exposures", f"WITH {fx.EXPOSED_SQL} SELECT * FROM exposed")(_exposed)


@query(
    "first_exposure",
    f"""WITH {fx.EXPOSED_SQL} SELECT master, min(charge_time) AS charge_time FROM exposed
    WHERE charge_time IS NOT NULL AND NOT contains(substr(trim(code), 1, 3), '1') GROUP BY master""",
)
def first_exposures(t):
    return first_exposure_of_charges(
        fx.charges(t), fx.codes(t), _visit_person(t),
        item="item", code="code", visit="reg_id", person="master", time="charge_time",
    )


@query(
    "first_exposure_all_codes",
    f"""WITH {fx.EXPOSED_SQL} SELECT master, min(charge_time) AS charge_time FROM exposed
    WHERE charge_time IS NOT NULL GROUP BY master""",
)
def first_exposures_all_codes(t):
    return first_exposure(_exposed(t), person="master", time="charge_time", code="code", excluded_marker=None)


def _exposed_by_source(t: Tables):
    rows = exposures(
        fx.charges_by_source(t), fx.codes(t), fx.visit_persons_by_source(t), item="item", code="code", visit=["reg_id"]
    )
    return rows.select("master", "charge_time", "item", "code", "source")


query("exposures_two_sources", f"WITH {fx.TWO_SOURCES_SQL} SELECT * FROM exposed")(_exposed_by_source)


@query(
    "first_exposure_two_sources",
    f"""WITH {fx.TWO_SOURCES_SQL} SELECT master, min(charge_time) AS charge_time FROM exposed
    WHERE charge_time IS NOT NULL AND NOT contains(substr(trim(code), 1, 3), '1') GROUP BY master""",
)
def first_exposures_two_sources(t):
    return first_exposure_of_charges(
        fx.charges_by_source(t), fx.codes(t), fx.visit_persons_by_source(t),
        item="item", code="code", visit=["reg_id"], person="master", time="charge_time",
    )


@query(
    "lookup_names",
    """SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n
    ON c_nationkey = n_nationkey""",
)
def lookup_names(t):
    """A code table maps keys to names; keys it does not know become NULL."""
    known = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup_join(t.customer.select("c_custkey", "c_nationkey"), known, "c_nationkey").select("c_custkey", "n_name")


@query(
    "code_head_filter",
    f"WITH {fx.CODES_SQL} SELECT p_name AS item, code FROM codes WHERE NOT contains(substr(trim(code), 1, 3), '1')",
)
def code_head_filter(t):
    return fx.codes(t).filter(~excluded_code(F.col("code")))


@query("distinct_clean_names", f"WITH {fx.FEES_SQL} SELECT item FROM names")
def clean_names(t):
    return distinct_clean_names(fx.fees(t), "item", "category", fx.CATEGORIES)


def _standardised(t: Tables, names=None):
    names = clean_names(t) if names is None else names
    return standardise(names, fx.dictionary(t), name="item", suffix=fx.SUFFIX)


@query("standardise_names", f"WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL} SELECT item, standard, code FROM standardised")
def standardise_names(t):
    return _standardised(t)


@query(
    "standardise_names_by_joins",
    f"""WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL}, every AS (
      SELECT regexp_replace(item, '^[(（].*?[)）]+', '') AS item FROM fees),
    once AS (SELECT DISTINCT item FROM every), w AS (
      SELECT item, list_reduce(string_split(item, ''),
        lambda acc, ch: CASE WHEN list_contains(ps, acc || ch) THEN acc || ch ELSE acc END, '') AS node, ps
      FROM once, prefixes),
    s AS (SELECT item, CASE WHEN node NOT IN (SELECT path FROM paths) AND list_contains(ps, node || '{fx.SUFFIX}')
      THEN node || '{fx.SUFFIX}' ELSE node END AS node FROM w),
    r AS (SELECT item, p.word AS standard, c.code AS code FROM s LEFT JOIN paths p ON node = p.path
      LEFT JOIN word_codes c ON p.word = c.word)
    SELECT standard, code, count(*) AS n FROM every JOIN r USING (item) GROUP BY standard, code""",
)
def standardise_names_by_joins(t):
    """The path for dictionaries that are too large to broadcast."""
    rows = standardise(
        fx.raw_names(t), fx.dictionary(t), name="item", suffix=fx.SUFFIX, limit=BroadcastLimit(rows=0)
    )
    return rows.groupBy("standard", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "match_ratio",
    f"""WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL} SELECT count(*) AS n_rows, count(standard) AS n_matched,
      round(count(standard) / count(*), 9) AS ratio FROM standardised""",
)
def matched(t):
    return match_ratio(_standardised(t)).withColumn("ratio", F.round("ratio", 9))


@query(
    "dictionary_codes",
    f"WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL} SELECT path, word, code FROM paths JOIN word_codes USING (word)",
)
def dictionary_codes(t):
    return dictionary_table(fx.dictionary(t), "medical_name", "atc", "ord")


@query(
    "dictionary_codes_raw",
    f"""WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL}, raw_codes AS (
      SELECT medical_name AS word, arg_max(atc, ord) AS code FROM dictionary GROUP BY 1)
    SELECT path, p.word, code FROM paths p LEFT JOIN raw_codes r ON p.word = r.word""",
)
def dictionary_codes_raw(t):
    return dictionary_table(fx.dictionary(t), "medical_name", "atc", "ord", code_match="raw")


@query(
    "dedup_first",
    f"""WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL} SELECT medical_name, atc, ord FROM dictionary
    QUALIFY row_number() OVER (PARTITION BY medical_name ORDER BY ord) = 1""",
)
def dedup_first(t):
    return first_per_key(fx.dictionary(t), "medical_name", F.col("ord"))


def _filled(t: Tables):
    return fill_by_pattern(
        fx.catalog(t), fx.rules(t), name="item", code="code", standard="std",
        rule_pattern="word", rule_code="rule_code", rule_standard="rule_std", order="ord",
    )


query("fill_by_pattern", f"WITH {fx.CATALOG_SQL} SELECT * FROM filled")(_filled)


@query(
    "collated_names",
    """WITH typed AS (SELECT lower(p_name) AS name, p_brand, p_size FROM part), brands AS (
      SELECT lower(p_name) AS name, min(p_brand) AS first_brand FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT name, first_brand, count(*) AS n, sum(p_size) AS size, bool_or(name LIKE '%d%a%' OR name LIKE 'r%') AS matches
    FROM typed LEFT JOIN brands USING (name) GROUP BY name, first_brand""",
)
def collated_names(t):
    """Names in various cases, some with blanks at the end, grouped, joined and matched under one collation."""
    name = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.initcap("p_name")).otherwise(F.col("p_name"))
    typed = t.part.select(F.concat(name, F.repeat(F.lit(" "), F.col("p_size") % 4)).alias("name"), "p_brand", "p_size")
    typed = under_collation(typed, ["name"])
    brands = typed.filter("p_size > 25").groupBy("name").agg(F.min("p_brand").alias("first_brand"))
    joined = skew_join(typed, brands, "name", "left")
    found = joined.groupBy("name", "first_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), F.bool_or(collated_like(F.col("name"), ["%D%A%", "R%"])).alias("matches")
    )
    return plain_text(found, ["name"]).withColumn("name", F.lower(F.rtrim("name")))


@query("fill_by_pattern_changed", f"WITH {fx.CATALOG_SQL} SELECT count(*) FILTER (WHERE changed) AS n_changed FROM filled")
def filled_count(t):
    return changed_rows(_filled(t))


def _filled_by_automaton(t: Tables, limit: BroadcastLimit = AUTOMATON_LIMIT):
    return fill_by_automaton(
        fx.catalog(t), fx.rules(t), name="item", code="code", standard="std",
        rule_pattern="word", rule_code="rule_code", rule_standard="rule_std", order="ord", limit=limit,
    )


@query("fill_by_automaton", f"WITH {fx.CATALOG_SQL} SELECT * FROM filled")
def filled_by_automaton(t):
    """All rules at once, each name read once."""
    return _filled_by_automaton(t)


@query("fill_by_automata", f"WITH {fx.CATALOG_SQL} SELECT * FROM filled")
def filled_by_automata(t):
    """Rules that are too many for one automaton."""
    return _filled_by_automaton(t, BroadcastLimit(rows=100))


def _stored_catalog(t: Tables) -> str:
    """A catalogue as a table partitioned by brand, some of whose brands have nothing to fill."""
    path = f"{shared_folder(t.spark)}/catalog-{uuid.uuid4().hex}"
    stored = fx.catalog(t).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    write_table(stored.withColumn("code", F.when(~F.col("p_brand").endswith("1"), F.col("code")).otherwise("K")), path, partition_by=["p_brand"])
    return path


def _update_stored(t: Tables, path: str) -> Updated:
    def fill(table):
        return fill_by_automaton(
            table, fx.rules(t), name="item", code="code", standard="std",
            rule_pattern="word", rule_code="rule_code", rule_standard="rule_std", order="ord",
        )

    return update_in_place(t.spark, path, fill, ["p_brand"])


_UPDATED = f"""{fx.CATALOG_SQL}, updated AS (
      SELECT p_partkey, p_brand, CASE WHEN p_brand LIKE '%1' THEN 'K' ELSE f.code END AS code,
        CASE WHEN p_brand LIKE '%1' THEN c.std ELSE f.std END AS std, p_brand NOT LIKE '%1' AND f.changed AS changed
      FROM filled f JOIN catalog c USING (p_partkey) JOIN part USING (p_partkey))"""


@query("update_in_place", f"WITH {_UPDATED} SELECT p_partkey, p_brand, code, std FROM updated")
def updated_table(t):
    """A stored table after the missing codes were filled in place."""
    path = _stored_catalog(t)
    _update_stored(t, path)
    return read_table(t.spark, path).select("p_partkey", "p_brand", "code", "std")


@query(
    "update_in_place_twice",
    f"""WITH {_UPDATED}, brands AS (SELECT p_brand FROM updated GROUP BY p_brand HAVING bool_or(changed))
    SELECT 1 AS run, count(*) FILTER (WHERE changed) AS n_changed, count(*) FILTER (WHERE p_brand IN (FROM brands)) AS n_rewritten,
      (SELECT count(*) FROM brands) AS n_partitions FROM updated
    UNION ALL SELECT 2, 0, 0, 0""",
)
def updated_twice(t):
    """What an update does, and that the same update has nothing to do afterwards."""
    path = _stored_catalog(t)
    runs = [(i, u.changed, u.rewritten, u.partitions) for i in (1, 2) for u in [_update_stored(t, path)]]
    return t.spark.createDataFrame(runs, "run int, n_changed bigint, n_rewritten bigint, n_partitions bigint")


_CHAIN = f"""{fx.FEES_SQL}, {fx.DICTIONARY_SQL}, {fx.CATALOG_ONLY_SQL},
    chained AS (
      SELECT c.p_partkey, c.code AS old, arg_min(s.code, s.item) AS new, arg_min(s.standard, s.item) AS std
      FROM (SELECT p_partkey, code, p_name || ' x ' || p_brand AS item FROM catalog JOIN part USING (p_partkey)) c
      LEFT JOIN (SELECT DISTINCT item, standard, code FROM standardised WHERE code IS NOT NULL) s
        ON c.code IS NULL AND contains(c.item, s.item)
      GROUP BY c.p_partkey, c.code)"""


def _chain(t: Tables):
    """Clean names, standardise them, turn them into ordered rules and fill a catalogue."""
    catalog = fx.catalog(t).join(
        t.part.select("p_partkey", F.concat(F.lit(" x "), "p_brand").alias("tail")), "p_partkey"
    ).select("p_partkey", F.concat("item", "tail").alias("item"), "code", "std")
    return fill_from_names(catalog, _standardised(t), name="item", code="code", standard="std", item="item")


@query("name_chain", f"WITH {_CHAIN} SELECT p_partkey, coalesce(old, new) AS code, std, old IS NULL AND new IS NOT NULL AS changed FROM chained")
def name_chain(t):
    return _chain(t).select("p_partkey", "code", "std", "changed")


@query("name_chain_changed", f"WITH {_CHAIN} SELECT count(*) FILTER (WHERE old IS NULL AND new IS NOT NULL) AS n_changed FROM chained")
def name_chain_changed(t):
    return changed_rows(_chain(t))


@query(
    "standardise_missing_names",
    f"""WITH {fx.FEES_SQL}, {fx.DICTIONARY_SQL} SELECT item, standard, code FROM standardised
    UNION ALL SELECT NULL, '{MISSING_NAME}', NULL""",
)
def standardise_missing(t):
    """A name that is missing gets the marker."""
    names = clean_names(t)
    names = names.unionByName(names.select(F.lit(None).cast("string").alias("item")).limit(1))
    return standardise(names, fx.dictionary(t), name="item", suffix=fx.SUFFIX, missing=MISSING_NAME)


_ROUND_TRIP = """SELECT p_partkey, p_brand, '"' || p_name || '", a\\' || p_type || '\\' || chr(10) || 'ö ""' || p_brand || ',' AS note,
      lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS previous FROM part"""


def _notes(t: Tables):
    note = F.concat(F.lit('"'), "p_name", F.lit('", a\\'), "p_type", F.lit('\\\nö ""'), "p_brand", F.lit(","))
    return t.part.select("p_partkey", "p_brand", note.alias("note"))


@query("csv_round_trip", _ROUND_TRIP)
def csv_round_trip(t):
    """Quotes, separators, backslashes and line breaks, a byte-order mark, and the order of rows."""
    path = f"{shared_folder(t.spark)}/notes-{uuid.uuid4().hex}"
    notes = _notes(t)
    write_csv(notes.orderBy("p_partkey"), path, mark=True)
    rows = read_csv(t.spark, path, notes.schema, order="ord", line_breaks=True)
    previous = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("ord"))
    return rows.select("p_partkey", "p_brand", "note", previous.alias("previous"))


class _StoredRows:
    """Stands for a server: a connection and cursor that answer from a stored table, for a range of keys.

    It reads files where pyarrow finds them; a real connection would not.
    """

    description = None

    def cursor(self):
        return self

    def execute(self, table, args):
        from pyarrow import parquet

        column, low, high = args
        found = parquet.read_table(table, filters=[(column, ">=", low), (column, "<", high)])
        self.description = [(name.upper(), None) for name in found.column_names]
        self._rows = (tuple(r.values()) for batch in found.to_batches(1000) for r in batch.to_pylist())

    def fetchmany(self, n):
        return [row for _, row in zip(range(n), self._rows)]

    def close(self):
        pass


@query("records_source", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def records_source(t):
    """A table read through a cursor, one task for each range of keys, columns named by its description."""
    low, high = t.part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    step = -(-(high - low + 1) // 8)
    ranges = [("p_partkey", at, at + step) for at in range(low, high + 1, step)]
    wanted = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").schema
    return read_records(t.spark, _StoredRows, f"{t.folder}/part.parquet", wanted, ranges)


_LINES = """lines AS (
      SELECT p_partkey, p_name, p_size, CASE
        WHEN p_partkey % 11 = 0 THEN p_partkey || ',"' || p_name || ', x",' || p_size || ',more'
        WHEN p_partkey % 13 = 0 THEN 'no ' || p_partkey || ',' || p_name || ',' || p_size
        WHEN p_partkey % 17 = 0 THEN p_partkey || ',' || p_name END AS misfit FROM part)"""


@query(
    "csv_bad_rows",
    f"""WITH {_LINES} SELECT CASE WHEN misfit IS NULL THEN p_partkey END AS p_partkey, CASE WHEN misfit IS NULL THEN p_name END AS p_name,
      CASE WHEN misfit IS NULL THEN p_size END AS p_size, misfit, (SELECT count(*) FROM lines) AS n_rows, (SELECT count(misfit) FROM lines) AS n_misfits
    FROM lines""",
)
def csv_bad_rows(t):
    """Lines with too many fields, a field of another type or too few fields, beside those that fit; counted by the write."""
    key, fields = F.col("p_partkey"), F.concat_ws(",", "p_partkey", "p_name", "p_size")
    line = (
        F.when(key % 11 == 0, F.concat(key, F.lit(',"'), F.col("p_name"), F.lit(', x",'), F.col("p_size"), F.lit(",more")))
        .when(key % 13 == 0, F.concat(F.lit("no "), fields))
        .when(key % 17 == 0, F.concat_ws(",", "p_partkey", "p_name"))
        .otherwise(fields)
    )
    path = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    t.part.select(line.alias("p_partkey,p_name,p_size")).write.options(header=True, sep="\x01", escapeQuotes=False).csv(path)
    rows = read_csv_checked(t.spark, path, t.part.select("p_partkey", "p_name", "p_size").schema)
    kept = f"{path}-fitting"
    write_table(rows.fitting, kept)
    n_rows, n_misfits = rows.counts()
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.fitting.schema.fields]
    both = read_table(t.spark, kept).withColumn("misfit", F.lit(None).cast("string")).union(rows.misfits.select(*none, "text"))
    return both.select("*", F.lit(n_rows).cast("bigint").alias("n_rows"), F.lit(n_misfits).cast("bigint").alias("n_misfits"))


@query("table_round_trip", "SELECT l_returnflag, l_orderkey, l_linenumber, l_shipdate, l_tax FROM lineitem")
def table_round_trip(t):
    path = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_tax", "l_returnflag")
    write_table(lines, path, partition_by=["l_returnflag"])
    return read_table(t.spark, path).select("l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate", "l_tax")


@query(
    "missing_name_marker",
    f"""WITH {fx.CATALOG_SQL} SELECT p_partkey, CASE WHEN code IS NULL THEN '{MISSING_NAME}' ELSE code END AS code
    FROM catalog""",
)
def missing_name_marker(t):
    code = F.col("code")
    return fx.catalog(t).select("p_partkey", fill_missing(code, code, MISSING_NAME).alias("code"))


@query(
    "clean_text",
    f"""SELECT doc_id, translate(trim(U&'\\3000' || ' ' || text || ' ?' || U&'\\ff1f\\00a0', '{WHITE_SPACE}'), '?？', '') AS text
    FROM documents""".replace("U&'\\3000'", "'　'").replace("U&'\\ff1f\\00a0'", "'？ '"),
)
def clean_text(t):
    padded = F.concat(F.lit("　 "), "text", F.lit(" ?？ "))
    return t.documents.select("doc_id", clean_label(padded).alias("text"))


@query(
    "ascii_brackets",
    "SELECT p_partkey, translate('（' || p_type || '）' || p_name, '（）', '()') AS item FROM part",
)
def brackets(t):
    return t.part.select(
        "p_partkey", ascii_brackets(F.concat(F.lit("（"), "p_type", F.lit("）"), "p_name")).alias("item")
    )


@query("item_frequency", "SELECT p_name AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def item_frequency(t):
    return frequency(fx.charges(t), "item")


@query(
    "bound_sql",
    "SELECT p_type, count(*) AS n FROM part WHERE p_size >= 10 AND p_name LIKE '%ring%' GROUP BY p_type",
)
def bound_sql(t):
    text = "SELECT p_type, count(*) AS n FROM {part} WHERE p_size >= :low AND p_name LIKE :like GROUP BY p_type"
    return run_sql(t.spark, text, {"low": 10, "like": "%ring%"}, part=t.part)
