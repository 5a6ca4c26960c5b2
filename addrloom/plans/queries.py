"""Registered queries of the address engine and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, text, vocab
from ..functions.vocab import PARTS
from ..operators import blocking, dataset, evaluate, feedback, quality, ranking, stage1
from ..operators import reference as refs
from . import fixtures

Q: dict = {}
S: dict[str, str] = {}


def _query(sql: str | None = None, recursive: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fixtures.SQL}\n{sql.strip()}"
        return f

    return add


def _ref(spark, d) -> DataFrame:
    raw = fixtures.reference(spark, d)
    return refs.prepare(raw, F.col("ref_ord"))


def _raw_ref(spark, d) -> DataFrame:
    return fixtures.reference(spark, d)


def _qry(spark, d) -> DataFrame:
    return fixtures.queries(spark, d)


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


# ---- SQL pieces -------------------------------------------------------------


def _ws(*cols: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


def _standard(p: str = "") -> str:
    left, place = _ws(*(p + c for c in PARTS[:7])), _ws(*(p + c for c in PARTS[7:]))
    return f"CASE WHEN {place} = '' THEN {left} ELSE trim({left} || ', ' || {place}, ', ') END"


def _signature(p: str = "") -> str:
    return _ws(*(p + c for c in ("predir", "street_name", "street_type", "suffixdir")))


def _core(p: str = "") -> str:
    return _ws(*(p + c for c in ("predir", "street_name", "suffixdir")))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(upper({x}), '/-.,', '    '), '''', ''), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '([A-Z0-9#]+)'))"


def _jaccard(a: str, b: str) -> str:
    x, y = _tokens(a), _tokens(b)
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({x}) + len({y}) - {both}) END"


def _soundex(x: str) -> str:
    letters = f"regexp_replace(upper({x}), '[^A-Z]+', '', 'g')"
    digits = f"translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{text._DIGITS}')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE substr(rpad(substr({letters}, 1, 1) || replace(substr({digits}, 2), '0', ''), 4, '0'), 1, 4) END"


def _canonical(p: str = "") -> str:
    unit = f"CASE WHEN {p}unit_type <> '' AND {p}unit_value <> '' THEN ', ' || {p}unit_type || ' ' || {p}unit_value ELSE '' END"
    return f"upper(regexp_replace(trim(regexp_replace(replace({_ws(*(p + c for c in PARTS[:5]))} || {unit} || ', ' || {_ws(p + 'city', p + 'state', p + 'zip_code')}, ',', ' , '), '\\s+', ' ', 'g')), ' ,', ',', 'g'))"


# ---- normalization and similarity -------------------------------------------


@_query(f"SELECT query_id, {_norm('query_address')} AS normalized FROM qry")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return _qry(spark, d).select("query_id", text.normalize_text("query_address").alias("normalized"))


@_query(f"SELECT address_id, {_standard()} AS standardized, {_signature()} AS signature, {_core()} AS core FROM ref")
def standardize(spark, d):
    return _raw_ref(spark, d).select("address_id", text.standardize().alias("standardized"), text.street_signature().alias("signature"), text.street_core().alias("core"))


@_query("SELECT query_id, trim(upper(replace(regexp_replace(trim(regexp_replace(replace(query_address, ',', ' , '), '\\s+', ' ', 'g')), ' ,', ',', 'g'), ',', ''))) AS query_key FROM qry")
def query_key(spark, d):
    return _qry(spark, d).select("query_id", text.query_key("query_address").alias("query_key"))


@_query(f"SELECT address_id, {_canonical()} AS canonical FROM ref")
def render_canonical(spark, d):
    return _raw_ref(spark, d).select("address_id", text.canonical_line().alias("canonical"))


@_query(f"SELECT q.query_id, round({_jaccard(_norm('q.query_address'), _norm(_standard('r.')))}, 6) AS overlap FROM qry q JOIN ref r ON q.true_match_id = r.address_id")
def token_jaccard(spark, d):
    r = _raw_ref(spark, d).select(F.col("address_id").alias("true_match_id"), text.standardize().alias("standard"))
    q = _qry(spark, d).select("query_id", "true_match_id", "query_address").join(r, "true_match_id")
    return q.select("query_id", _r(text.jaccard(text.normalize_text("query_address"), text.normalize_text("standard"))).alias("overlap"))


@_query(f"SELECT DISTINCT w AS word, {_soundex('w')} AS code FROM (SELECT unnest(string_split(street_name || ' ' || city, ' ')) AS w FROM qry)")
def soundex_code(spark, d):
    words = _qry(spark, d).select(F.explode(F.split(F.concat_ws(" ", "street_name", "city"), " ")).alias("word")).distinct()
    return words.select("word", text.soundex_code(F.col("word")).alias("code"))


@_query(f"SELECT street_name, array_to_string(list_filter(list_transform(regexp_extract_all(street_name, '([A-Z0-9#]+)'), lambda w: {_soundex('w')}), lambda x: x <> ''), ' ') AS signature FROM (SELECT DISTINCT street_name FROM qry)")
def phonetic_signature(spark, d):
    return _qry(spark, d).select("street_name").distinct().select("street_name", text.phonetic_signature("street_name").alias("signature"))


@_query("SELECT q.query_id, round(CASE WHEN q.house_number = r.house_number THEN 1.0 ELSE greatest(0.0, 1 - least(abs(q.house_number::BIGINT - r.house_number::BIGINT), 25) / 25.0) END::DOUBLE, 6) AS similarity FROM qparts q JOIN ref r ON q.true_match_id = r.address_id")
def numeric_similarity(spark, d):
    r = _raw_ref(spark, d).select(F.col("address_id").alias("true_match_id"), F.col("house_number").alias("other"))
    q = _qry(spark, d).join(r, "true_match_id")
    return q.select("query_id", _r(text.number_gap_similarity(F.col("house_number"), F.col("other"))).alias("similarity"))


# ---- cleaning of source values ----------------------------------------------

_HOUSE_RAW = "case l_orderkey % 7 when 0 then cast(l_partkey as string) || '.0' when 1 then ' ' || cast(l_partkey as string) || ' a ' when 2 then '000' when 3 then 'N/A' when 4 then cast(l_partkey as string) || ',' when 5 then 'LOT' else cast(l_suppkey + 1 as string) end"


@_query(f"""
, raw AS (SELECT DISTINCT {_HOUSE_RAW} AS value FROM lineitem),
c AS (SELECT value, regexp_replace(upper(CASE WHEN upper(trim(value)) IN ('', 'N/A') THEN '' ELSE trim(value) END), '\\s+', '', 'g') AS x FROM raw)
SELECT value, CASE WHEN NOT regexp_matches(regexp_replace(x, '\\D+', '', 'g'), '[1-9]') THEN '' WHEN regexp_full_match(x, '\\d+(\\.0)?') THEN (x::DOUBLE)::BIGINT::VARCHAR ELSE substr(trim(x, ',;'), 1, 24) END AS house FROM c
""")
def house_clean(spark, d):
    raw = fixtures.table(spark, d, "lineitem").selectExpr(f"{_HOUSE_RAW} AS value").distinct()
    return raw.select("value", cleaning.house_number(F.col("value")).alias("house"))


_ZIP_RAW = "case o_orderkey % 5 when 0 then ' ' || cast(38600 + o_custkey % 1300 as string) when 1 then cast(39000 + o_custkey % 1500 as string) || '-1234' when 2 then 'MS ' || cast(40000 + o_custkey as string) when 3 then 'NULL' else '123' end"


@_query(f"""
, raw AS (SELECT DISTINCT {_ZIP_RAW} AS value FROM orders), z AS (SELECT value, coalesce(regexp_extract(value, '\\d{{5}}'), '') AS zip_code FROM raw)
SELECT value, zip_code, zip_code = '' OR substr(zip_code, 1, 3) BETWEEN '386' AND '397' AS fits_state FROM z
""")
def zip_state_filter(spark, d):
    raw = fixtures.table(spark, d, "orders").selectExpr(f"{_ZIP_RAW} AS value").distinct()
    zips = raw.select("value", cleaning.zip_code(F.col("value")).alias("zip_code"))
    return zips.select("*", cleaning.zip_fits_state(F.col("zip_code"), F.lit("MS")).alias("fits_state"))


def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{x}')" for k, x in table.items()) + ")"


_STATE_NAMES = {**vocab.STATE_CODES, **{n.replace(" ", ""): a for a, n in vocab.STATES.items()}}
_TYPE_RAW = "lower(street_type) || case o_orderkey % 4 when 0 then '.' when 1 then ' ' else '' end"


@_query(f"""
, raw AS (SELECT DISTINCT w AS value FROM (SELECT unnest(string_split(street_name || ' ' || lower(street_type) || '. ' || case noise_kind when 0 then 'Boulevard' when 1 then 'avenue,' else 'xing' end, ' ')) AS w FROM qparts) WHERE w <> '')
SELECT value, coalesce(code, '') AS code FROM raw LEFT JOIN {_values(vocab.STREET_TYPE_CODES)} t(word, code) ON word = regexp_replace(upper(value), '[^A-Z0-9]+', '', 'g')
""")
def street_type_canonical(spark, d):
    line = "concat(street_name, ' ', lower(street_type), '. ', case noise_kind when 0 then 'Boulevard' when 1 then 'avenue,' else 'xing' end)"
    raw = _qry(spark, d).select(F.explode(F.split(F.expr(line), " ")).alias("value")).where("value != ''").distinct()
    return raw.select("value", cleaning.street_type(F.col("value")).alias("code"))


@_query(f"""
, raw AS (SELECT DISTINCT case c_custkey % 6 when 0 then 'ms' when 1 then 'Mississippi' when 2 then 'new york' when 3 then 'Kentucky' when 4 then 'XX' else 'W. Virginia' end AS value FROM customer)
SELECT value, coalesce(code, '') AS state FROM raw LEFT JOIN {_values(_STATE_NAMES)} t(word, code) ON word = regexp_replace(upper(value), '[^A-Z0-9]+', '', 'g')
""")
def state_canonical(spark, d):
    raw = fixtures.table(spark, d, "customer").selectExpr("case c_custkey % 6 when 0 then 'ms' when 1 then 'Mississippi' when 2 then 'new york' when 3 then 'Kentucky' when 4 then 'XX' else 'W. Virginia' end AS value").distinct()
    return raw.select("value", cleaning.state(F.col("value")).alias("state"))


_DESCRIPTOR_RAW = "case ref_ord % 7 when 0 then 'N OF ' || street_name when 1 then 'REAR ' || street_name when 2 then 'Lot on ' || street_name when 3 then 'CORNER OF ' || street_name when 4 then street_name || ' DOD 1/12' when 5 then 'N/S ' || street_name else street_name end"


@_query(f"""
, raw AS (SELECT DISTINCT {_DESCRIPTOR_RAW} AS value FROM ref)
SELECT value, regexp_matches(upper(value), '^(N OF|REAR |LOT ON|CORNER OF)') OR regexp_matches(upper(value), '\\bDOD\\b') AS is_descriptor FROM raw
""")
def descriptor_filter(spark, d):
    raw = _raw_ref(spark, d).selectExpr(f"{_DESCRIPTOR_RAW} AS value").distinct()
    return raw.select("value", cleaning.is_descriptor(F.col("value")).alias("is_descriptor"))


# ---- sources ----------------------------------------------------------------

#: Two sources: all reference rows, then every third again with other case, some rows broken on purpose.
_SOURCE = """SELECT 0 AS source_ord, 0 AS file_ord, ref_ord AS row_ord, house_number AS "NUMBER", trim(predir || ' ' || street_name || ' ' || street_type) AS "STREET",
  case when unit_type = '' then '' else unit_type || ' ' || unit_value end AS "UNIT", city AS "CITY", 'MS' AS "REGION", zip_code AS "POSTCODE" FROM ref
UNION ALL SELECT 1, 0, ref_ord, case ref_ord % 5 when 0 then '0' else house_number end, lower(trim(predir || ' ' || street_name || ' ' || street_type)),
  case when unit_type = '' then '' else lower(unit_type) || ' ' || unit_value end, lower(city), case ref_ord % 7 when 0 then 'AL' else 'Mississippi' end, case ref_ord % 11 when 0 then '10001' else zip_code end FROM ref WHERE ref_ord % 3 = 0"""


def _sources(spark, d) -> list[tuple[DataFrame, str]]:
    ref = _raw_ref(spark, d)
    unit = lambda t: F.when(F.col("unit_type") == "", "").otherwise(F.concat_ws(" ", t, "unit_value"))
    line = F.trim(F.concat_ws(" ", "predir", "street_name", "street_type"))
    one = ref.select(F.lit(0).alias("file_ord"), F.col("ref_ord").alias("row_ord"), F.col("house_number").alias("NUMBER"), line.alias("STREET"), unit(F.col("unit_type")).alias("UNIT"), F.col("city").alias("CITY"), F.lit("MS").alias("REGION"), F.col("zip_code").alias("POSTCODE"))
    two = ref.where("ref_ord % 3 = 0").select(
        F.lit(0).alias("file_ord"), F.col("ref_ord").alias("row_ord"), F.expr("case ref_ord % 5 when 0 then '0' else house_number end").alias("NUMBER"), F.lower(line).alias("STREET"), unit(F.lower("unit_type")).alias("UNIT"),
        F.lower("city").alias("CITY"), F.expr("case ref_ord % 7 when 0 then 'AL' else 'Mississippi' end").alias("REGION"), F.expr("case ref_ord % 11 when 0 then '10001' else zip_code end").alias("POSTCODE"),
    )
    return [(one, "openaddresses"), (two, "openaddresses")]


_JUDGED = f"""
, src AS ({_SOURCE}),
judged AS (SELECT *, CASE WHEN "REGION" = 'AL' THEN 'state_mismatch' WHEN "POSTCODE" <> '' AND substr("POSTCODE", 1, 3) NOT BETWEEN '386' AND '397' THEN 'non_ms_zip'
  WHEN "NUMBER" = '0' THEN 'missing_or_invalid_house_number' ELSE '' END AS reject,
  upper("NUMBER" || ' ' || "STREET" || CASE WHEN "UNIT" = '' THEN '' ELSE ' ' || "UNIT" END || ' ' || "CITY" || ' MS ' || "POSTCODE") AS k FROM src),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_ord, k ORDER BY file_ord, row_ord) AS inside, row_number() OVER (PARTITION BY k ORDER BY source_ord, file_ord, row_ord) AS across FROM judged WHERE reject = '')
"""


@_query(_JUDGED + "SELECT source_ord::INT AS source_ord, row_ord, k AS dedupe_key FROM ranked WHERE across = 1")
def source_union_dedupe(spark, d):
    from ..sources.formats import load

    return load(_sources(spark, d))[0].select("source_ord", "row_ord", "dedupe_key")


@_query(_JUDGED + """
SELECT source_ord::INT AS source_ord, reason, count(*) AS rows FROM (SELECT source_ord, CASE WHEN inside > 1 THEN 'duplicate' WHEN across > 1 THEN 'duplicate_across_sources' ELSE 'loaded' END AS reason FROM ranked
UNION ALL SELECT source_ord, reject FROM judged WHERE reject <> '') GROUP BY 1, 2
""")
def reject_reasons(spark, d):
    from ..sources.formats import load

    return load(_sources(spark, d))[1]


@_query(_JUDGED + "SELECT source_ord::INT AS source_ord, count(*) AS rows, count(*) FILTER (across = 1) AS net_new, count(*) FILTER (across > 1) AS duplicates FROM ranked WHERE inside = 1 GROUP BY 1")
def net_new_by_source(spark, d):
    from ..sources.formats import project

    both = None
    for i, (rows, kind) in enumerate(_sources(spark, d)):
        own = project(rows, kind, "MS", ["file_ord", "row_ord"]).where("reject = ''").dropDuplicates(["dedupe_key"]).withColumn("source_ord", F.lit(i))
        both = own if both is None else both.unionByName(own)
    return quality.net_new(both, ["file_ord", "row_ord"])


_HALF_CITY = "CASE WHEN ref_ord % 4 = 0 THEN '' WHEN ref_ord % 500 = 1 THEN 'OTHERTOWN' ELSE city END"


def _half(spark, d) -> DataFrame:
    return _raw_ref(spark, d).withColumn("city", F.expr(_HALF_CITY))


_CONSENSUS = f"""
, half AS (SELECT * REPLACE ({_HALF_CITY} AS city) FROM ref), given AS (SELECT * FROM half WHERE city <> '' AND zip_code <> ''),
counts AS (SELECT zip_code, city, count(*) AS n, min(ref_ord) AS first, sum(count(*)) OVER (PARTITION BY zip_code) AS total FROM given GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY n DESC, first) AS r FROM counts),
consensus AS (SELECT zip_code, city FROM top WHERE r = 1 AND total >= 10 AND n / total >= 0.9)
"""


@_query(_CONSENSUS + "SELECT zip_code, city FROM consensus")
def zip_city_consensus(spark, d):
    return quality.zip_city_consensus(_half(spark, d), ["ref_ord"], least=10, share=0.9)


@_query(_CONSENSUS + f"""
, filled AS (SELECT h.* REPLACE (c.city AS city) FROM half h JOIN consensus c ON h.zip_code = c.zip_code WHERE h.city = ''),
keyed AS (SELECT *, replace({_canonical()}, ',', '') AS k FROM filled), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ref_ord) AS n FROM keyed)
SELECT address_id, city, k AS dedupe_key FROM ranked WHERE n = 1 AND k NOT IN (SELECT replace({_canonical()}, ',', '') FROM half)
""")
def zip_city_enrich(spark, d):
    return quality.zip_city_enrichment(_half(spark, d), ["ref_ord"], least=10, share=0.9).select("address_id", "city", "dedupe_key")


@_query("SELECT state, count(*) AS records, count(DISTINCT city) AS city_count, count(DISTINCT zip_code) AS zip_count, count(*) FILTER (city = '') AS blank_city_records, count(*) FILTER (zip_code = '') AS blank_zip_records FROM ref GROUP BY state")
def record_summary(spark, d):
    return quality.record_summary(_raw_ref(spark, d), ["state"])


# ---- reference --------------------------------------------------------------


@_query("SELECT city AS city_key, arg_max(city, ref_ord) AS city FROM ref WHERE city <> '' GROUP BY city")
def city_lookup_last_wins(spark, d):
    return refs.city_lookup(_ref(spark, d))


_STATES = "CASE WHEN ref_ord % 25 = 3 THEN 'AL' ELSE state END"


@_query(f", s AS (SELECT city, {_STATES} AS state FROM ref) SELECT city, min(state) AS state FROM s WHERE city <> '' AND state <> '' GROUP BY city HAVING count(DISTINCT state) = 1")
def states_by_city_unique(spark, d):
    return refs.only_states(_raw_ref(spark, d).withColumn("state", F.expr(_STATES)))


@_query("SELECT city, state, zip_code, count(*) AS n, max(ref_ord) AS last FROM ref GROUP BY 1, 2, 3")
def place_counts(spark, d):
    return refs.place_counts(_ref(spark, d))


_EXTRA = "CASE WHEN ref_ord % 2 = 0 THEN house_number || 'B' ELSE house_number END"


@_query(f"""
, extra AS (SELECT * REPLACE ({_EXTRA} AS house_number, ref_ord + 1000000 AS ref_ord) FROM ref WHERE ref_ord % 3 = 0),
both_ AS (SELECT 0 AS side, * FROM ref UNION ALL SELECT 1, * FROM extra),
r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(PARTS)} ORDER BY side, ref_ord, address_id) AS n FROM both_)
SELECT count(*) FILTER (side = 0) AS primary_rows, count(*) FILTER (side = 1) AS extra_rows, count(*) FILTER (side = 1 AND n = 1) AS added_rows,
  count(*) FILTER (side = 1 AND n > 1) AS duplicate_rows, count(*) FILTER (n = 1) AS total_rows, count(*) FILTER (side = 1 AND n = 1) AS renamed_ids FROM r
""")
def augment_reference(spark, d):
    ref = _ref(spark, d)
    extra = refs.prepare(_raw_ref(spark, d).where("ref_ord % 3 = 0").withColumn("house_number", F.expr(_EXTRA)), F.col("ref_ord") + 1_000_000)
    return refs.augment(ref, extra)[1]


# ---- stage 1 ----------------------------------------------------------------

_RULE_SQL = [
    ("{s}", None), ("house_number, zip_code, {g}", "zip_code <> ''"), ("house_number, zip_code, street_name", "zip_code <> ''"), ("house_number, zip_code, {c}", "zip_code <> ''"),
    ("house_number, substr(zip_code, 1, 3), {g}", "zip_code <> ''"), ("house_number, substr(zip_code, 1, 3), street_name", "zip_code <> ''"),
    ("house_number, city, state, {g}", None), ("house_number, city, state, street_name", None), ("house_number, city, state, {c}", None),
]


def _keys_sql(table: str, keep: str) -> str:
    one = lambda i, key, guard: f"SELECT {keep}, {i} AS rule, concat_ws(chr(31), '{i}', {key.format(s=_standard(), g=_signature(), c=_core())}) AS key FROM {table}" + (f" WHERE {guard}" if guard else "")
    return " UNION ALL ".join(one(i, key, guard) for i, (key, guard) in enumerate(_RULE_SQL))


_UNIQUE = f", keys AS ({_keys_sql('ref', 'address_id')}), uniq AS (SELECT key, min(address_id) AS address_id FROM keys GROUP BY key HAVING count(*) = 1)"


@_query(_UNIQUE + " SELECT key, address_id FROM uniq")
def unique_match(spark, d):
    return stage1.unique_keys(stage1.prepared(_raw_ref(spark, d)))


@_query(f"SELECT q.query_id, min(r.address_id) AS address_id FROM qparts q JOIN ref r ON {_standard('q.')} = {_standard('r.')} GROUP BY q.query_id, {_standard('q.')} HAVING count(*) = 1")
def stage1_exact(spark, d):
    r = _raw_ref(spark, d).select("address_id", text.standardize().alias("standard"))
    only = r.groupBy("standard").agg(F.count(F.lit(1)).alias("n"), F.min("address_id").alias("address_id")).where("n = 1")
    return _qry(spark, d).select("query_id", text.standardize().alias("standard")).join(only, "standard").select("query_id", "address_id")


def _reading(why: str, changes: dict[str, str], when: str, order: str) -> str:
    return f"SELECT query_id, {order} AS i, '{why}' AS reason, " + ", ".join(f"{changes.get(p, p)} AS {p}" for p in PARTS) + f" FROM {'qconf' if why == 'type_confusion' else 'qparts'} WHERE {when}"


_CONFUSIONS = ", ".join(f"('{t}', {i}, '{o}')" for t, others in vocab.STREET_TYPE_CONFUSIONS.items() for i, o in enumerate(others))
_VARIANTS = f"""
, qconf AS (SELECT q.*, c.i AS ci, c.other FROM qparts q JOIN (VALUES {_CONFUSIONS}) c(t, i, other) ON c.t = q.street_type),
readings AS ({_reading('original', {}, 'true', '0')} UNION ALL {_reading('drop_unit', {'unit_type': "''", 'unit_value': "''"}, "unit_type <> '' OR unit_value <> ''", '1')}
 UNION ALL {_reading('drop_type', {'street_type': "''"}, "street_type <> ''", '2')} UNION ALL {_reading('type_confusion', {'street_type': 'other'}, 'true', '3 + ci')}
 UNION ALL {_reading('zip_prefix', {'zip_code': 'substr(zip_code, 1, 3)'}, 'length(zip_code) >= 4', '9')}),
firsts AS (SELECT query_id, {', '.join(PARTS)}, min(i) AS i, arg_min(reason, i) AS reason FROM readings GROUP BY query_id, {', '.join(PARTS)}),
variants AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INT AS variant, reason, {', '.join(PARTS)} FROM firsts)
"""


@_query(_VARIANTS + f"SELECT query_id, variant, reason, {_standard()} AS standardized FROM variants")
def stage1_variants(spark, d):
    v = stage1.plain_variants(_qry(spark, d), "query_id")
    return v.select("query_id", "variant", "reason", text.standardize().alias("standardized"))


@_query(_VARIANTS + _UNIQUE + f"""
, vkeys AS ({_keys_sql('variants', 'query_id, variant')}), hits AS (SELECT query_id, variant, rule, address_id FROM vkeys JOIN uniq USING (key)),
best AS (SELECT query_id, arg_min(struct_pack(v := variant, r := rule, a := address_id), variant * 100 + rule) AS m FROM hits GROUP BY query_id)
SELECT query_id, m.v AS variant, m.r::INT AS rule, m.a AS address_id FROM best
""")
def stage1_rule_cascade(spark, d):
    ref = stage1.prepared(_raw_ref(spark, d))
    hits = stage1.rule_hits(stage1.prepared(stage1.plain_variants(_qry(spark, d).withColumnRenamed("query_id", "raw"))), ref)
    best = hits.groupBy("raw").agg(F.min_by(F.struct("variant", "rule", "address_id"), F.struct("variant", "rule")).alias("m"))
    return best.select(F.col("raw").alias("query_id"), "m.*")


# ---- blocking and ranking ---------------------------------------------------

_LIST = {"token": "len3(street_name)", "sound": "sounds", "city_token": "len3(city)"}


def _block_sql(table: str, keep: str) -> str:
    parts = []
    for name, (cols, _, _) in refs.BLOCKS.items():
        fixed = ["substr(zip_code, 1, 3)" if c == "zip3" else _signature() if c == "signature" else c for c in cols if c not in _LIST]
        many = next((c for c in cols if c in _LIST), None)
        long_ = lambda c: f"list_filter({_tokens(c)}, lambda t: length(t) >= 3)"
        each = {"token": long_("street_name"), "city_token": long_("city"), "sound": f"list_filter(list_transform({long_('street_name')}, lambda w: {_soundex('w')}), lambda x: x <> '')"}
        given = " AND ".join(f"{c} <> ''" for c in fixed) or "true"
        last = f", unnest({each[many]})" if many else ""
        parts.append(f"SELECT DISTINCT {keep}, '{name}' AS block, concat_ws(chr(31), '{name}'{''.join(', ' + c for c in fixed)}{last}) AS key FROM {table} WHERE {given}")
    return " UNION ALL ".join(parts)


_WEIGHTS = ", ".join(f"('{n}', {w}, {m or 1 << 60})" for n, (_, w, m) in refs.BLOCKS.items())
_BLOCKED = f"""
, bw AS (SELECT * FROM (VALUES {_WEIGHTS}) b(block, weight, most)),
posted AS (SELECT p.*, row_number() OVER (PARTITION BY key ORDER BY ref_ord, address_id) AS n FROM ({_block_sql('ref', 'address_id, ref_ord')}) p),
postings AS (SELECT key, address_id FROM posted JOIN bw USING (block) WHERE n <= most),
qkeys AS ({_block_sql('qparts', 'query_id')}),
summed AS (SELECT query_id, address_id, round(sum(weight)::DOUBLE, 4) AS block_score FROM qkeys JOIN bw USING (block) JOIN postings USING (key) GROUP BY 1, 2)
"""


_SUM_SQL = "SELECT query_id, count(*) AS candidates, round(sum(block_score), 2) AS total, max(block_score) AS best FROM summed GROUP BY query_id"
_TOP_SQL = "SELECT query_id, address_id, n::INT AS pool FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY block_score DESC, ref_ord, s.address_id) AS n FROM summed s JOIN ref r ON s.address_id = r.address_id) WHERE n <= 10"


def _asked(spark, d) -> DataFrame:
    return _qry(spark, d).withColumn("variant", F.lit(0)).withColumnRenamed("query_id", "raw")


def _weighted_sum(spark, d, asked: DataFrame) -> DataFrame:
    found = blocking.sums(asked.withColumn("signature", text.street_signature()), _ref(spark, d))
    return found.select(F.col("raw").alias("query_id"), "candidates", F.round("total", 2).alias("total"), "best")


def _topk(spark, d, asked: DataFrame) -> DataFrame:
    return ranking.blocked(asked, _ref(spark, d), most=10).select(F.col("raw").alias("query_id"), "address_id", "pool")


@_query(_BLOCKED + _SUM_SQL)
def blocking_weighted_sum(spark, d):
    return _weighted_sum(spark, d, _asked(spark, d))


@_query(_BLOCKED + _TOP_SQL)
def blocking_topk(spark, d):
    return _topk(spark, d, _asked(spark, d))


_TRUE = "qparts q JOIN ref r ON q.true_match_id = r.address_id"


def _true_pairs(spark, d) -> DataFrame:
    r = _raw_ref(spark, d)
    return _qry(spark, d).join(r.select(F.col("address_id").alias("true_match_id"), *(F.col(c).alias(f"r_{c}") for c in (*PARTS, "source_quality"))), "true_match_id")


#: Features that need no matching blocks, as columns of (query, true row); the others are 0 here.
_NATIVE = {
    "bias": "1", "house_similarity": "CASE WHEN q.house_number = r.house_number THEN 1 ELSE greatest(0, 1 - least(abs(q.house_number::BIGINT - r.house_number::BIGINT), 25) / 25.0) END",
    "street_signature_overlap": _jaccard(_signature("q."), _signature("r.")), "zip_exact": "(q.zip_code <> '' AND q.zip_code = r.zip_code)::INT", "zip_prefix": "(q.zip_code <> '' AND substr(q.zip_code, 1, 3) = substr(r.zip_code, 1, 3))::INT",
    "type_exact": "(q.street_type <> '' AND q.street_type = r.street_type)::INT", "type_missing": "(q.street_type = '')::INT", "predir_exact": "(q.predir = r.predir)::INT", "suffixdir_exact": "(q.suffixdir = r.suffixdir)::INT",
    "unit_exact": "(q.unit_type <> '' AND q.unit_type = r.unit_type AND q.unit_value = r.unit_value)::INT", "unit_missing": "(q.unit_type = '' AND q.unit_value = '')::INT", "state_exact": "(q.state <> '' AND q.state = r.state)::INT",
    "house_exact": "(q.house_number <> '' AND q.house_number = r.house_number)::INT", "street_exact": "(q.street_name <> '' AND q.street_name = r.street_name)::INT", "city_similarity": "(q.city = r.city)::INT",
    "missing_city": "(q.city = '')::INT", "missing_state": "(q.state = '')::INT", "missing_zip": "(q.zip_code = '')::INT", "source_quality": "r.source_quality",
}
_WEIGHT = {n: round(0.1 + 0.07 * i - 0.9 * (i % 3 == 2), 3) for i, n in enumerate(vocab.FEATURES)}


def _native_values(spark, d) -> DataFrame:
    p = _true_pairs(spark, d)
    given = lambda c: ((F.col(c) != "") & (F.col(c) == F.col(f"r_{c}"))).cast("double")
    same = lambda c: (F.col(c) == F.col(f"r_{c}")).cast("double")
    blank = lambda *cs: F.expr(" AND ".join(f"{c} = ''" for c in cs)).cast("double")
    own = {
        "bias": F.lit(1.0), "house_similarity": text.number_gap_similarity(F.col("house_number"), F.col("r_house_number")), "street_signature_overlap": text.jaccard(text.street_signature(), text.street_signature(lambda c: F.col(f"r_{c}"))),
        "zip_exact": given("zip_code"), "zip_prefix": ((F.col("zip_code") != "") & (F.substring("zip_code", 1, 3) == F.substring("r_zip_code", 1, 3))).cast("double"), "type_exact": given("street_type"), "type_missing": blank("street_type"),
        "predir_exact": same("predir"), "suffixdir_exact": same("suffixdir"), "unit_exact": given("unit_type") * same("unit_value"), "unit_missing": blank("unit_type", "unit_value"), "state_exact": given("state"),
        "house_exact": given("house_number"), "street_exact": given("street_name"), "city_similarity": same("city"), "missing_city": blank("city"), "missing_state": blank("state"), "missing_zip": blank("zip_code"), "source_quality": F.col("r_source_quality"),
    }
    values = F.array(*(own.get(n, F.lit(0.0)).cast("double") for n in vocab.FEATURES))
    return p.select("query_id", values.alias("values"), (F.col("street_name") != "").alias("has_street"), (F.col("house_number") != "").alias("has_house"))


_VALUES_SQL = f", vals AS (SELECT q.query_id, q.street_name, q.house_number, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _NATIVE.items())}, {', '.join(f'0::DOUBLE AS {n}' for n in vocab.FEATURES if n not in _NATIVE)} FROM {_TRUE})"
_SCORE_SQL = " + ".join(f"{n} * {w}::DOUBLE" for n, w in _WEIGHT.items())


@_query(_VALUES_SQL + " SELECT query_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NATIVE) + " FROM vals")
def features_native(spark, d):
    v = _native_values(spark, d)
    return v.select("query_id", *(_r(ranking.value(n)).alias(n) for n in _NATIVE))


@_query(_VALUES_SQL + f" SELECT query_id, round({_SCORE_SQL}, 6) AS score, round(1 / (1 + exp(-({_SCORE_SQL}))), 6) AS probability FROM vals")
def linear_score(spark, d):
    z = ranking.linear_score(list(_WEIGHT.values()))
    return _native_values(spark, d).select("query_id", _r(z).alias("score"), _r(ranking.sigmoid(z)).alias("probability"))


_RANK_SQL = f"""
, e AS (SELECT *, 1 / (1 + exp(-({_SCORE_SQL}))) AS p, greatest(street_name_similarity, street_signature_overlap) AS txt, greatest(street_name_similarity, street_signature_overlap, 0.9 * street_phonetic_similarity) AS ev,
  greatest(city_similarity, zip_exact, zip_prefix, state_exact, city_state_exact) AS place FROM vals),
ranks AS (SELECT *, greatest(0, least(1, CASE WHEN place >= 0.86 AND ev >= 0.66 AND txt >= 0.58 THEN greatest(p, least(0.93, 0.42 * ev + 0.18 * city_similarity + 0.08 * state_exact + 0.08 * zip_city_consistency + 0.08 * source_quality + 0.12 * house_similarity + 0.04 * type_exact))
  WHEN place >= 0.86 AND txt < 0.58 THEN least(p, 0.20 + 0.30 * txt + 0.08 * place + 0.12 * house_similarity) ELSE p END)) AS rank_score FROM e)
"""


@_query(_VALUES_SQL + _RANK_SQL + "SELECT query_id, round(rank_score, 6) AS rank_score FROM ranks")
def rank_score(spark, d):
    return _native_values(spark, d).select("query_id", _r(ranking.rank_score(list(_WEIGHT.values()))).alias("rank_score"))


_TREE = {
    "leaf": False, "feature_idx": 13, "threshold": 0.9, "left": {"leaf": False, "feature_idx": 4, "threshold": 0.5, "left": {"leaf": True, "probability": 0.03, "count": 1}, "right": {"leaf": True, "probability": 0.37, "count": 1}},
    "right": {"leaf": False, "feature_idx": 2, "threshold": 0.7, "left": {"leaf": True, "probability": 0.55, "count": 1}, "right": {"leaf": True, "probability": 0.97, "count": 1}},
}
_TREE_SQL = "CASE WHEN rank_score <= 0.9 THEN CASE WHEN house_similarity <= 0.5 THEN 0.03 ELSE 0.37 END ELSE CASE WHEN street_signature_overlap <= 0.7 THEN 0.55 ELSE 0.97 END END::DOUBLE"


@_query(_VALUES_SQL + _RANK_SQL + f"""
, t AS (SELECT *, {_TREE_SQL} AS tree FROM ranks)
SELECT query_id, tree, CASE WHEN (house_similarity < 0.45 AND ev >= 0.66 AND place >= 0.86) OR (house_exact > 0 AND txt < 0.55 AND place >= 0.86) THEN least(tree, 0.39) ELSE tree END::DOUBLE AS guarded FROM t
""")
def tree_decision(spark, d):
    v = _native_values(spark, d).withColumn("rank_score", ranking.rank_score(list(_WEIGHT.values()))).withColumn("margin", F.lit(0.0))
    tree = v.withColumn("tree", ranking.decision_score(_TREE))
    return tree.select("query_id", "tree", ranking.guarded(F.col("tree")).alias("guarded"))


# ---- combining, evaluation, thresholds --------------------------------------

_ANSWERS = """
SELECT query_id, true_match_id, (noise_kind <> 6)::INT AS label, CASE WHEN noise_kind = 4 THEN '' WHEN ord % 13 = 5 THEN 'REF_0000001' ELSE true_match_id END AS a_id, ((ord % 97) / 100.0)::DOUBLE AS a_conf, ord % 5 = 0 AS a_rev,
  CASE WHEN ord % 9 = 2 THEN '' WHEN ord % 17 = 3 THEN 'REF_0000002' ELSE true_match_id END AS b_id, ((ord * 7 % 100) / 100.0)::DOUBLE AS b_conf, ord % 4 = 1 AS b_rev FROM (SELECT *, substr(query_id, 3)::BIGINT AS ord FROM qparts)
"""
_COMBINED = f"""
, ans AS ({_ANSWERS}), pick AS (SELECT *, CASE WHEN a_id = '' THEN true WHEN b_id = '' THEN false WHEN a_id = b_id AND b_conf > a_conf THEN true ELSE a_rev AND NOT b_rev AND b_conf >= a_conf END AS second FROM ans),
comb AS (SELECT query_id, CASE WHEN label = 1 THEN true_match_id ELSE '' END AS true_match_id, label, CASE WHEN second THEN b_id ELSE a_id END AS predicted_match_id, CASE WHEN second THEN b_conf ELSE a_conf END AS confidence, CASE WHEN second THEN b_rev ELSE a_rev END AS needs_review,
  CASE WHEN second THEN 'stage2_model_original' ELSE 'stage1_original_exact' END AS stage FROM pick)
"""


def _answers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = _qry(spark, d).withColumn("ord", F.expr("cast(substr(query_id, 3) as long)"))
    keep = q.select("query_id", F.when(F.col("noise_kind") != 6, F.col("true_match_id")).otherwise("").alias("true_match_id"), (F.col("noise_kind") != 6).cast("int").alias("label"))
    one = q.selectExpr("query_id", "case when noise_kind = 4 then '' when ord % 13 = 5 then 'REF_0000001' else true_match_id end AS predicted_match_id", "(ord % 97) / 100.0D AS confidence", "ord % 5 = 0 AS needs_review", "'stage1_original_exact' AS stage", "'' AS standardized_query_address")
    two = q.selectExpr("query_id", "case when ord % 9 = 2 then '' when ord % 17 = 3 then 'REF_0000002' else true_match_id end AS predicted_match_id", "(ord * 7 % 100) / 100.0D AS confidence", "ord % 4 = 1 AS needs_review", "'stage2_model_original' AS stage", "'' AS standardized_query_address")
    two = two.withColumn("top_candidates", F.array(F.struct(F.col("predicted_match_id").alias("reference_id"), F.col("confidence").alias("score"))))
    return keep, one, two


def _combined(spark, d) -> DataFrame:
    keep, one, two = _answers(spark, d)
    return ranking.combine(one, two, "query_id").join(keep, "query_id")


@_query(_COMBINED + "SELECT query_id, predicted_match_id, confidence, needs_review, stage FROM comb")
def combine_stages(spark, d):
    return _combined(spark, d).select("query_id", "predicted_match_id", "confidence", "needs_review", "stage")


def _metrics_sql(source: str, name: str) -> str:
    right = "(CASE WHEN label = 1 THEN predicted_match_id = true_match_id ELSE predicted_match_id = '' END)"
    share = lambda a, b: f"round(coalesce({a}::DOUBLE / nullif({b}, 0), 0), 4)"
    n, pred, pos, acc, tp = "count(*)", "count(*) FILTER (predicted_match_id <> '')", "count(*) FILTER (label = 1)", "count(*) FILTER (NOT needs_review)", "count(*) FILTER (label = 1 AND predicted_match_id = true_match_id)"
    return f"""SELECT '{name}' AS name, {share(f'count(*) FILTER {right}', n)} AS accuracy, {share(tp, pos)} AS top3_accuracy, {share(tp, pred)} AS precision, {share(tp, pos)} AS recall, {pred} AS resolved_count, {n} - {pred} AS unresolved_count,
  {share(pred, n)} AS resolved_rate, {share(acc, n)} AS coverage, {share(f'count(*) FILTER (NOT needs_review AND {right})', acc)} AS accepted_accuracy, {share("count(*) FILTER (stage LIKE 'stage1%')", n)} AS stage1_share, {share("count(*) FILTER (stage NOT LIKE 'stage1%')", n)} AS stage2_share FROM {source}"""


@_query(_COMBINED + _metrics_sql("comb", "combined"))
def eval_metrics(spark, d):
    return evaluate.metrics(_combined(spark, d).drop("top_candidates"), "combined")


_ONE = ", one AS (SELECT query_id, CASE WHEN label = 1 THEN true_match_id ELSE '' END AS true_match_id, label, a_id AS predicted_match_id, a_conf AS confidence, a_rev AS needs_review, 'stage1_original_exact' AS stage FROM ans)"


@_query(_COMBINED + _ONE + f", a AS ({_metrics_sql('comb', 'c')}), b AS ({_metrics_sql('one', 'o')}) SELECT 'combined_vs_stage1' AS name, " + ", ".join(f"round(a.{m} - b.{m}, 4) AS {m}_delta" for m in evaluate.METRICS) + ", " + ", ".join(f"a.{m} >= b.{m} AS {m}_gte_baseline" for m in ("accuracy", "recall", "precision", "accepted_accuracy")) + ", a.accuracy >= b.accuracy AND a.recall >= b.recall AS overall_better_or_equal FROM a, b")
def metric_deltas(spark, d):
    keep, one, _ = _answers(spark, d)
    return evaluate.deltas(evaluate.metrics(_combined(spark, d).drop("top_candidates"), "c"), evaluate.metrics(one.join(keep, "query_id"), "o"), "combined_vs_stage1")


@_query(_COMBINED + """
, s AS (SELECT label, CASE WHEN label = 1 THEN true_match_id ELSE '' END AS t, b_id AS c, b_conf AS score FROM ans), steps AS (SELECT unnest(range(25, 98)) AS k)
SELECT k / 100.0::DOUBLE AS threshold, round(count(*) FILTER (CASE WHEN label = 1 THEN CASE WHEN score >= k / 100.0::DOUBLE THEN c ELSE '' END = t ELSE score < k / 100.0::DOUBLE OR c = '' END)::DOUBLE / count(*), 6) AS accuracy FROM s, steps GROUP BY k
""".replace("ELSE score < k / 100.0::DOUBLE OR c = '' END", "ELSE score < k / 100.0::DOUBLE END"))
def accept_threshold_sweep(spark, d):
    keep, _, two = _answers(spark, d)
    scored = two.join(keep, "query_id").select("label", "true_match_id", F.col("predicted_match_id").alias("candidate_id"), F.col("confidence").alias("score"))
    return evaluate.accept_threshold(scored).select("threshold", _r(F.col("accuracy")).alias("accuracy"))


@_query(_COMBINED + """
, steps AS (SELECT unnest(range(60, 100)) AS k), g AS (SELECT k, count(*) AS n, count(*) FILTER (CASE WHEN label = 1 THEN predicted_match_id = true_match_id ELSE predicted_match_id = '' END) AS ok FROM comb, steps WHERE confidence >= k / 100.0::DOUBLE GROUP BY k)
SELECT k / 100.0::DOUBLE AS threshold, round(n::DOUBLE / (SELECT count(*) FROM comb), 6) AS coverage, round(ok::DOUBLE / n, 6) AS accuracy FROM g WHERE ok::DOUBLE / n >= 0.5 ORDER BY n DESC, k LIMIT 1
""")
def review_threshold_sweep(spark, d):
    best = evaluate.review_threshold(_combined(spark, d), target=0.5)
    return best.select("threshold", _r(F.col("coverage")).alias("coverage"), _r(F.col("accuracy")).alias("accuracy"))


@_query(_COMBINED + """
, c AS (SELECT b_conf AS v, count(*) AS n, sum((b_id = true_match_id)::INT) AS pos FROM ans GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS k, sum(n) OVER (ORDER BY v) AS ln, sum(pos) OVER (ORDER BY v) AS lp, sum(n) OVER () AS nn, sum(pos) OVER () AS pp, count(*) OVER () AS d FROM c),
g AS (SELECT *, 1 - (lp / ln) ** 2 - (1 - lp / ln) ** 2 AS gl, 1 - ((pp - lp) / (nn - ln)) ** 2 - (1 - (pp - lp) / (nn - ln)) ** 2 AS gr, 1 - (pp / nn) ** 2 - (1 - pp / nn) ** 2 AS gp FROM r WHERE k > 0 AND k < d - 1 AND k % greatest(1, d // 12) = 0)
SELECT v AS threshold, round((gp - ln / nn * gl - (nn - ln) / nn * gr)::DOUBLE, 6) AS gain FROM g
""")
def gini_split_best(spark, d):
    keep, _, two = _answers(spark, d)
    q = _qry(spark, d).select("query_id", F.col("true_match_id").alias("own"))
    rows = two.join(q, "query_id").select("confidence", (F.col("predicted_match_id") == F.col("own")).cast("int").alias("y"))
    return evaluate.gini_splits(rows, "confidence", "y").select("threshold", _r(F.col("gain")).alias("gain"))


# ---- feedback, datasets -----------------------------------------------------

_LOG = {
    "row_ord": "cast(substr(query_id, 3) as bigint)", "feedback_type": "case noise_kind when 0 then 'correct' when 1 then 'correction' when 2 then 'wrong' when 3 then 'correction' when 4 then 'correct' else '' end", "input_address": "query_address",
    "standardized_address": "query_address", "predicted_match_id": "case when noise_kind = 4 then 'GONE' else true_match_id end", "predicted_canonical_address": "''", "correct_address": "''", "correct_reference_id": "case when noise_kind = 1 then true_match_id else '' end",
    "correct_canonical_address": "case when noise_kind = 3 then 'NOWHERE' else '' end",
}


def _log(spark, d) -> DataFrame:
    return _qry(spark, d).selectExpr(*(f"{e} AS {n}" for n, e in _LOG.items()))


_LOG_SQL = ", log AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _LOG.items()) + " FROM qry)"


@_query(_LOG_SQL + f"""
, k AS (SELECT row_ord, {_norm('input_address')} AS key, CASE feedback_type WHEN 'correct' THEN predicted_match_id ELSE correct_reference_id END AS id FROM log WHERE feedback_type IN ('correct', 'correction'))
SELECT key, arg_max(id, row_ord) AS reference_id FROM k JOIN ref ON id = address_id GROUP BY key
""")
def feedback_overrides(spark, d):
    return feedback.overrides(_log(spark, d), _ref(spark, d))


@_query(_LOG_SQL + f"""
, k AS (SELECT *, CASE feedback_type WHEN 'correct' THEN predicted_match_id WHEN 'correction' THEN correct_reference_id ELSE '' END AS id FROM log WHERE feedback_type <> ''),
f AS (SELECT k.*, address_id FROM k LEFT JOIN ref ON id = address_id)
SELECT row_ord, (address_id IS NOT NULL AND feedback_type <> 'wrong')::INT AS label, CASE WHEN feedback_type <> 'wrong' THEN coalesce(address_id, '') ELSE '' END AS true_match_id FROM f WHERE NOT (feedback_type = 'correction' AND address_id IS NULL)
""")
def feedback_labels(spark, d):
    return feedback.labelled_queries(_log(spark, d), _ref(spark, d))[0].select("row_ord", "label", "true_match_id")


_POOL = "CASE WHEN ref_ord % 2 = 0 THEN cast(cast(house_number as int) + 4 as string) ELSE house_number END"
_NEIGHBOUR_KEYS = {"same_house_city": ("house_number", "city", "state"), "same_street_city": ("predir", "street_name", "street_type", "suffixdir", "city", "state"), "same_house_zip": ("house_number", "zip_code"), "same_street_zip": ("predir", "street_name", "street_type", "suffixdir", "zip_code")}
_LOOSE = [(i, r, k, [c for c in k if c not in ("predir", "street_type", "suffixdir")]) for i, (r, k) in enumerate(_NEIGHBOUR_KEYS.items())]
_NEIGHBOURS = " UNION ALL ".join(f"SELECT {i} AS i, '{r}' AS reason, p.address_id AS candidate, r.address_id AS neighbour FROM pool p JOIN ref r ON {' AND '.join(f'p.{c} = r.{c}' for c in k)} WHERE {' AND '.join(f'''p.{c} <> '' ''' for c in given)}" for i, r, k, given in _LOOSE)


def _neighbours_sql(where: str) -> str:
    return f", pool AS (SELECT * REPLACE ({_POOL} AS house_number) FROM ref{where}), pairs AS ({_NEIGHBOURS}) SELECT candidate, neighbour, arg_min(reason, i) AS reason FROM pairs GROUP BY 1, 2"


def _neighbours(pool: DataFrame, ref: DataFrame) -> DataFrame:
    pool = pool.withColumn("house_number", F.expr(_POOL)).withColumn("canonical_address", F.col("address_id"))
    pairs = dataset.neighbours(pool, ref, strict=False)
    return pairs.select(F.col("address_id").alias("candidate"), F.col("n_id").alias("neighbour"), "reason")


@_query(_neighbours_sql(""))
def adversarial_neighbors(spark, d):
    ref = _raw_ref(spark, d)
    return _neighbours(ref, ref)


_TAGS = "concat_ws('|', case when noise_kind % 2 = 0 then 'drop_zip' else 'lowercase' end, case when noise_kind > 3 then 'city_typo' else 'kind_' || cast(noise_kind as string) end)"
_DATA = {"split": "case when noise_kind < 5 then 'train' else 'test' end", "label": "cast(case when noise_kind = 6 then 0 else 1 end as int)", "difficulty": "case noise_kind % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end", "source": "case when noise_kind = 6 then 'holdout_no_match' else 'reference_variant' end", "noise_tags": _TAGS}


@_query(", data AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DATA.items()) + """ FROM qparts), tags AS (SELECT unnest(string_split(noise_tags, '|')) AS key FROM data)
SELECT 'split_label' AS kind, split || '|' || label AS key, count(*) AS n FROM data GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM data GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM data GROUP BY 2
UNION ALL SELECT 'source_difficulty', source || '|' || difficulty, count(*) FROM data GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'tag', key, count(*) AS n FROM tags GROUP BY 2 ORDER BY n DESC, key LIMIT 15)
""")
def dataset_summary(spark, d):
    return dataset.summary(_qry(spark, d).selectExpr(*(f"{e} AS {n}" for n, e in _DATA.items())))


@_query(_COMBINED + """
SELECT query_id, CASE WHEN predicted_match_id = '' THEN 'NO_MATCH' ELSE predicted_match_id END AS predicted_match_id, printf('%.4f', confidence) AS confidence, CASE WHEN needs_review THEN 'True' ELSE 'False' END AS needs_review,
  stage AS resolution_stage, CASE WHEN (CASE WHEN label = 1 THEN predicted_match_id = true_match_id ELSE predicted_match_id = '' END) THEN 'True' ELSE 'False' END AS correct FROM comb
""")
def predictions_table(spark, d):
    rows = _combined(spark, d).withColumns({"split": F.lit("test"), "query_address": F.lit(""), "predicted_canonical_address": F.lit("")})
    return evaluate.predictions(rows).select("query_id", "predicted_match_id", "confidence", "needs_review", "resolution_stage", "correct")


# ---- without SQL: free-form reading, similarities, noise, the whole plan -----


def model() -> ranking.Model:
    """A plain ranker for derived tables: evidence of house, street and place counts, no tree."""
    w = {"bias": -6.0, "full_similarity": 3.0, "street_name_similarity": 2.0, "house_exact": 2.5, "street_exact": 1.0, "city_similarity": 1.0, "zip_exact": 1.0, "rough": 2.0, "house_mismatch_strong_context": -2.0, "source_quality": 0.2}
    return ranking.Model([w.get(n, 0.0) for n in vocab.FEATURES], None, 0.55, 0.9)


@_query()
def resolve_end_to_end(spark, d):
    from .resolve import resolve

    q = _qry(spark, d).select("query_id", "true_match_id", "query_address")
    return resolve(q, _ref(spark, d), model()).drop("top_candidates")


@_query()
def noise_corrupt(spark, d):
    ref = _raw_ref(spark, d)
    made = dataset.noisy(dataset.variants(ref, 17, "positive", 2), dataset.cities_by_state(ref))
    return made.select("address_id", "variant", "query_address", "difficulty", "noise_tags")


@_query()
def split_blake2b(spark, d):
    return _raw_ref(spark, d).select("address_id", dataset.stable_split("address_id").alias("split"))


from . import core_queries  # noqa: E402, F401  (registers further queries)
