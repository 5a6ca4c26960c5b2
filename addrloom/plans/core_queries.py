"""Queries on the core of the address engine with SQL that computes similarities, features and decisions anew."""

from __future__ import annotations

import difflib
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import noise, text, vocab
from ..functions.similarity import similarities
from ..functions.vocab import FEATURES, PARTS
from ..operators import dataset, evaluate, quality, ranking, reading, service, stage1
from ..operators import reference as refs
from ..sources import formats
from ..storage import stored
from .queries import (
    _COMBINED, _JUDGED, _POOL, _TRUE, _UNIQUE, _VARIANTS, _canonical, _combined, _core, _jaccard, _keys_sql, _metrics_sql, _neighbours_sql, _qry, _query, _r, _raw_ref, _ref, _signature, _soundex, _sources, _standard, _true_pairs, model,
)

# ---- matching blocks in SQL ----------------------------------------------------

#: Twice the matched characters over all, of every (a, b) in ``strings``: the longest common block (the first in a, then in b)
#: and, left and right of it, the same again.
_RATIO = """
work AS (
  SELECT DISTINCT a, b, 1 AS al, length(a) + 1 AS ah, 1 AS bl, length(b) + 1 AS bh FROM strings WHERE a <> b AND a <> '' AND b <> ''
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN al ELSE best[1] + best[3] END AS al, CASE side WHEN 0 THEN best[1] ELSE ah END AS ah, CASE side WHEN 0 THEN bl ELSE best[2] + best[3] END AS bl, CASE side WHEN 0 THEN best[2] ELSE bh END AS bh
  FROM (SELECT a, b, al, ah, bl, bh, arg_max([i, j, k], k * 1000000 - i * 1000 - j) AS best FROM work, unnest(range(al, ah)) AS x(i), unnest(range(bl, bh)) AS y(j), unnest(range(1, least(ah - i, bh - j) + 1)) AS z(k)
    WHERE substr(a, i, k) = substr(b, j, k) GROUP BY ALL), (VALUES (0), (1)) AS s(side)
),
matched AS (SELECT a, b, sum(m) AS m FROM (SELECT a, b, al, bl, max(k) AS m FROM work, unnest(range(al, ah)) AS x(i), unnest(range(bl, bh)) AS y(j), unnest(range(1, least(ah - i, bh - j) + 1)) AS z(k) WHERE substr(a, i, k) = substr(b, j, k) GROUP BY a, b, al, ah, bl, bh) GROUP BY a, b),
ratios AS (SELECT DISTINCT s.a, s.b, CASE WHEN s.a = s.b THEN 1.0 WHEN s.a = '' OR s.b = '' THEN 0.0 ELSE 2.0 * coalesce(m, 0) / (length(s.a) + length(s.b)) END::DOUBLE AS ratio FROM strings s LEFT JOIN matched USING (a, b))
"""


def _sound(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({x}, '([A-Z0-9#]+)'), lambda w: {_soundex('w')}), lambda x: x <> ''), ' ')"


def _blended(a: str, b: str, ratio: str) -> str:
    overlap = _jaccard(a, b)
    return f"CASE WHEN {a} = '' OR {b} = '' OR {a} = {b} THEN ({a} = {b})::INT::DOUBLE WHEN ({overlap}) < 0.92 AND (({overlap}) >= 0.45 OR least(length({a}), length({b})) <= 8) THEN greatest({overlap}, {ratio}) ELSE {overlap} END"


_PAIRS = "streets AS (SELECT DISTINCT q.street_name, r.street_name AS r_street_name FROM qparts q JOIN ref r ON q.true_match_id = r.address_id)"


@_query(f"""
, {_PAIRS}, sounds AS (SELECT *, {_sound('street_name')} AS sa, {_sound('r_street_name')} AS sb FROM streets),
strings AS (SELECT street_name AS a, r_street_name AS b FROM streets UNION SELECT sa, sb FROM sounds), {_RATIO}
SELECT s.street_name, s.r_street_name, round(x.ratio, 6) AS ratio, round({_blended('s.street_name', 's.r_street_name', 'x.ratio')}, 6) AS blended, round(y.ratio, 6) AS phonetic
FROM sounds s JOIN ratios x ON x.a = s.street_name AND x.b = s.r_street_name JOIN ratios y ON y.a = s.sa AND y.b = s.sb
""", recursive=True)
def sequence_ratio(spark, d):
    p = _true_pairs(spark, d).select("street_name", "r_street_name").distinct()
    sim = similarities({"s": (F.col("street_name"), F.col("r_street_name"), ("ratio", "blended", "phonetic"))})
    return p.withColumn("sim", sim).select("street_name", "r_street_name", *(_r(F.col(f"sim.s_{m}")).alias(m) for m in ("ratio", "blended", "phonetic")))


# ---- features of true pairs -----------------------------------------------------

#: What the ratio of whole lines comes to, by what a text lacks against its row: a piece left out, two letters swapped, or another house of three
#: digits (whose matched digits are a table of fixed values).
_HOUSES = {str(100 + k * 7): sum(b.size for b in difflib.SequenceMatcher(None, str(102 + k * 7), str(100 + k * 7)).get_matching_blocks()) for k in range(37)}
_HOUSE_MAP = "MAP {" + ", ".join(f"'{h}': {m}" for h, m in _HOUSES.items()) + "}"
_FULL = f"""CASE WHEN qs = rs THEN 1.0 WHEN noise_kind IN (1, 2, 3, 7) THEN 2.0 * length(qs) / (length(qs) + length(rs)) WHEN noise_kind = 5 THEN (length(qs) - 1.0) / length(qs)
  ELSE 2.0 * (length(rs) - length(r_house_number) + {_HOUSE_MAP}[r_house_number]) / (length(qs) + length(rs)) END::DOUBLE"""


def _read(spark, d) -> DataFrame:
    """Structured queries in the shape of read texts, one reading each."""
    return _qry(spark, d).select(F.col("query_id").alias("raw"), F.array(F.struct(F.lit("original").alias("reason"), *PARTS)).alias("stage2"))


def _scored(spark, d) -> DataFrame:
    pairs = _qry(spark, d).select(F.col("query_id").alias("raw"), F.col("true_match_id").alias("address_id"))
    return ranking.features(pairs.withColumn("cand_ord", F.lit(1)), _read(spark, d), _ref(spark, d))


def _d(x: str) -> str:
    return f"({x})::INT::DOUBLE"


_SAME = lambda c: f"{c} = r_{c}"
_GIVEN = lambda c: f"{c} <> '' AND {c} = r_{c}"
_FEATURE_SQL = {
    "bias": "1.0::DOUBLE", "full_similarity": "full_ratio", "street_name_similarity": "greatest(street_ratio, 0.95 * sig_ratio)", "street_signature_overlap": "sig_overlap", "city_similarity": "city_ratio", "house_similarity": "house",
    "zip_exact": _d(_GIVEN("zip_code")), "zip_prefix": _d("zip_code <> '' AND substr(zip_code, 1, 3) = substr(r_zip_code, 1, 3)"), "type_exact": _d(_GIVEN("street_type")), "type_missing": _d("street_type = ''"),
    "predir_exact": _d(_SAME("predir")), "suffixdir_exact": _d(_SAME("suffixdir")), "unit_exact": _d(f"{_GIVEN('unit_type')} AND unit_value = r_unit_value"), "unit_missing": _d("unit_type = '' AND unit_value = ''"), "state_exact": _d(_GIVEN("state")),
    "city_state_exact": _d(f"city_ratio = 1 AND {_GIVEN('state')}"), "house_exact": _d(_GIVEN("house_number")), "street_exact": _d(_GIVEN("street_name")), "locality_corrected": "0.0::DOUBLE", "missing_city": _d("city = ''"), "missing_state": _d("state = ''"), "missing_zip": _d("zip_code = ''"),
    "rough": f"0.28 * house + 0.24 * street_blended + 0.14 * sig_overlap + 0.12 * city_blended + 0.10 * {_d(_GIVEN('zip_code'))} + 0.06 * {_d('''zip_code <> '' AND substr(zip_code, 1, 3) = substr(r_zip_code, 1, 3)''')} + 0.06 * {_d(_GIVEN('state'))}",
    "street_phonetic_similarity": "greatest(street_phonetic, sig_phonetic)", "city_phonetic_similarity": "city_phonetic",
    "zip_city_consistency": "CASE WHEN own IS NOT NULL THEN list_contains(own, r_city || chr(9) || r_state)::INT WHEN r_zip_code <> '' AND city <> '' AND state <> '' THEN list_contains(theirs, city || chr(9) || state)::INT ELSE 0.5 END::DOUBLE",
    "house_mismatch_strong_context": _d("house_number <> r_house_number AND greatest(street_ratio, 0.95 * sig_ratio, street_phonetic, sig_phonetic) >= 0.88 AND (city_ratio >= 0.86 OR (zip_code <> '' AND zip_code = r_zip_code))"), "source_quality": "r_source_quality",
}
_SIMS = f"""
, pairs AS (SELECT query_id, noise_kind, {', '.join(f'q.{c}' for c in PARTS)}, {', '.join(f'r.{c} AS r_{c}' for c in (*PARTS, 'source_quality'))}, {_signature('q.')} AS sig, {_signature('r.')} AS r_sig, {_standard('q.')} AS qs, {_standard('r.')} AS rs FROM {_TRUE}),
heard AS (SELECT *, {_sound('street_name')} AS hs, {_sound('r_street_name')} AS r_hs, {_sound('sig')} AS hg, {_sound('r_sig')} AS r_hg, {_sound('city')} AS hc, {_sound('r_city')} AS r_hc FROM pairs),
strings AS (SELECT street_name AS a, r_street_name AS b FROM heard UNION SELECT sig, r_sig FROM heard UNION SELECT city, r_city FROM heard UNION SELECT hs, r_hs FROM heard UNION SELECT hg, r_hg FROM heard UNION SELECT hc, r_hc FROM heard), {_RATIO},
places AS (SELECT zip_code, list(DISTINCT city || chr(9) || state) AS at FROM ref WHERE zip_code <> '' GROUP BY 1),
sims AS (SELECT h.*, s.ratio AS street_ratio, g.ratio AS sig_ratio, c.ratio AS city_ratio, xs.ratio AS street_phonetic, xg.ratio AS sig_phonetic, xc.ratio AS city_phonetic, {_FULL} AS full_ratio,
  {_jaccard('sig', 'r_sig')} AS sig_overlap, {_blended('street_name', 'r_street_name', 's.ratio')} AS street_blended, {_blended('city', 'r_city', 'c.ratio')} AS city_blended,
  CASE WHEN house_number = r_house_number THEN 1.0 ELSE 1 - least(abs(house_number::BIGINT - r_house_number::BIGINT), 25) / 25.0 END::DOUBLE AS house, p.at AS own, t.at AS theirs
  FROM heard h JOIN ratios s ON s.a = street_name AND s.b = r_street_name JOIN ratios g ON g.a = sig AND g.b = r_sig JOIN ratios c ON c.a = city AND c.b = r_city JOIN ratios xs ON xs.a = hs AND xs.b = r_hs JOIN ratios xg ON xg.a = hg AND xg.b = r_hg
  JOIN ratios xc ON xc.a = hc AND xc.b = r_hc LEFT JOIN places p ON p.zip_code = h.zip_code LEFT JOIN places t ON t.zip_code = h.r_zip_code),
vals AS (SELECT *, {', '.join(f'{e} AS f_{n}' for n, e in _FEATURE_SQL.items())} FROM sims)
"""


@_query(_SIMS + "SELECT query_id, " + ", ".join(f"round(f_{n}, 6) AS {n}" for n in FEATURES) + " FROM vals", recursive=True)
def ranking_features(spark, d):
    """The features that the ranker uses, of every text and its true row."""
    return _scored(spark, d).select(F.col("raw").alias("query_id"), *(_r(ranking.value(n)).alias(n) for n in FEATURES))


_TEXT, _EV = "greatest(f_street_name_similarity, f_street_signature_overlap)", "greatest(f_street_name_similarity, f_street_signature_overlap, 0.9 * f_street_phonetic_similarity)"
_PLACE = "greatest(f_city_similarity, f_zip_exact, f_zip_prefix, f_state_exact, f_city_state_exact)"
_GENERATION = f"""
, gen AS (SELECT *, greatest(street_blended, street_ratio, sig_ratio, sig_overlap) AS g_text, greatest(city_blended, f_state_exact, f_zip_exact, f_zip_prefix) AS g_place FROM vals),
gen2 AS (SELECT *, greatest(g_text, 0.9 * street_phonetic, 0.9 * sig_phonetic) AS g_street FROM gen)
"""


@_query(_SIMS + _GENERATION + """
SELECT query_id, round(CASE WHEN street_name = '' THEN f_rough WHEN g_place >= 0.86 AND g_street >= 0.66 AND g_text >= 0.58 THEN greatest(f_rough, 0.34 + 0.30 * g_street + 0.10 * city_blended + 0.05 * f_state_exact + 0.05 * f_zip_exact + 0.04 * f_zip_prefix + 0.08 * house)
  WHEN g_place >= 0.86 AND house_number <> '' THEN least(f_rough, 0.22 + 0.35 * g_text + 0.08 * g_place + 0.10 * house) ELSE f_rough END, 6) AS score, round(f_rough, 6) AS rough FROM gen2
""", recursive=True)
def candidate_generation_score(spark, d):
    """The score by which candidates are kept, of every text and its true row."""
    pairs = _qry(spark, d).select(F.col("query_id").alias("raw"), F.col("true_match_id").alias("address_id"))
    needed = ("house_number", "street_name", "signature", "city", "state", "zip_code")
    each = pairs.join(ranking._rows(_ref(spark, d), needed), "address_id").join(ranking.stage2_variants(_read(spark, d)), "raw").withColumn("sim", ranking._similar(False))
    return each.select(F.col("raw").alias("query_id"), _r(ranking.generation_score()).alias("score"), _r(ranking.rough_score()).alias("rough"))


_W = model().weights
_Z = " + ".join(f"f_{n} * {w!r}::DOUBLE" for n, w in zip(FEATURES, _W))
_RANKED = f"""
, e AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p, {_TEXT} AS txt, {_EV} AS ev, {_PLACE} AS place FROM vals),
ranks AS (SELECT *, CASE WHEN street_name = '' THEN p ELSE greatest(0, least(1, CASE WHEN place >= 0.86 AND ev >= 0.66 AND txt >= 0.58 THEN greatest(p, least(0.93, 0.42 * ev + 0.18 * f_city_similarity + 0.08 * f_state_exact + 0.08 * f_zip_city_consistency + 0.08 * f_source_quality + 0.12 * f_house_similarity + 0.04 * f_type_exact))
  WHEN place >= 0.86 AND txt < 0.58 THEN least(p, 0.20 + 0.30 * txt + 0.08 * place + 0.12 * f_house_similarity) ELSE p END)) END AS rank_score FROM e),
plain AS (SELECT *, greatest(0, least(1, {' + '.join(f'{w!r} * f_{n}' for n, w in ranking.PLAIN_DECISION.items())} + 0.01 * rank_score + 0.01 * greatest(0, rank_score))) AS raw_score FROM ranks),
held AS (SELECT *, CASE WHEN (house_number <> '' AND f_house_similarity < 0.45 AND ev >= 0.66 AND place >= 0.86) OR (street_name <> '' AND f_house_exact > 0 AND txt < 0.55 AND place >= 0.86) THEN least(raw_score, 0.39) ELSE raw_score END AS score FROM plain)
"""


@_query(_SIMS + _RANKED + f"""
SELECT query_id, CASE WHEN score >= {model().accept} THEN address_id ELSE '' END AS predicted_match_id, round(CASE WHEN score >= {model().accept} THEN score ELSE greatest(0, least(1, 1 - score)) END, 6) AS confidence,
  CASE WHEN score >= {model().accept} THEN score < {model().review} ELSE greatest(0, least(1, 1 - score)) < {model().review} END AS needs_review, CASE WHEN score >= {model().accept} THEN 'stage2_model_original' ELSE 'stage2_no_match' END AS stage, qs AS standardized_query_address, round(rank_score, 6) AS rank_score
FROM held JOIN (SELECT query_id, true_match_id AS address_id FROM qparts) USING (query_id)
""", recursive=True)
def stage2_decision(spark, d):
    """Rank score and decision of the plain blend, for every text with its true row as the only candidate."""
    ranks = ranking.ranked(_scored(spark, d), _W)
    read = _read(spark, d).withColumn("parts", F.get("stage2", F.lit(0)))
    made = ranking.decide(ranks, read, model())
    return made.join(ranks.select("raw", "rank_score"), "raw").select(F.col("raw").alias("query_id"), "predicted_match_id", _r(F.col("confidence")).alias("confidence"), "needs_review", "stage", "standardized_query_address", _r(F.col("rank_score")).alias("rank_score"))


# ---- rendering and style edits ---------------------------------------------------

_FLAG_SQL = {
    "full_directions": "ref_ord % 2 = 1", "full_street_type": "ref_ord % 3 = 1", "full_unit_type": "ref_ord % 5 = 2", "hash_unit": "ref_ord % 4 = 0", "unit_first": "ref_ord % 7 = 0", "with_unit": "ref_ord % 13 <> 1", "with_zip": "ref_ord % 3 <> 0",
    "commas": "ref_ord % 4 <> 1", "lower": "ref_ord % 6 = 2", "upper": "ref_ord % 6 = 3", "wide": "ref_ord % 8 = 5", "house_last": "ref_ord % 8 = 4", "order": "cast(case when ref_ord % 9 = 5 then 1 + ref_ord % 6 else 0 end as int)",
}


def _coded(part: str, table: dict[str, str], flag: str) -> str:
    cases = " ".join(f"WHEN '{code}' THEN '{word}'" for code, word in table.items())
    return f"CASE WHEN {flag} THEN CASE {part} {cases} ELSE {part} END ELSE {part} END"


def _spaced(x: str) -> str:
    return f"replace(trim(regexp_replace(replace({x}, ',', ' , '), '\\s+', ' ', 'g')), ' ,', ',')"


def _render_sql(source: str) -> str:
    """The rendered text of rows with parts and flags."""
    kind = _coded("unit_type", vocab.UNIT_TYPES, "full_unit_type")
    words = lambda *names: "array_to_string(list_filter([" + ", ".join(names) + "], lambda x: x <> ''), ' ')"
    named = {"house": "house_number", "predir": "p", "street_name": "street_name", "street_type": "t", "suffixdir": "sd", "unit": "u", "city": "city", "state": "state", "zip": "z"}
    orders = " ".join(f"WHEN {i} THEN {words(*(named[k] for k in (*keys, *(k for k in named if k not in keys))))}" for i, keys in enumerate(noise.ORDERS, 1))
    street = f"CASE WHEN house_last THEN {words('p', 'street_name', 'house_number', 't', 'sd')} ELSE {words('house_number', 'p', 'street_name', 't', 'sd')} END"
    glue = "CASE WHEN commas THEN ', ' ELSE ' ' END"
    return f"""named AS (SELECT *, {_coded('predir', vocab.DIRECTIONS, 'full_directions')} AS p, {_coded('suffixdir', vocab.DIRECTIONS, 'full_directions')} AS sd, {_coded('street_type', vocab.STREET_TYPES, 'full_street_type')} AS t,
  CASE WHEN NOT with_unit OR unit_type = '' OR unit_value = '' THEN '' WHEN hash_unit AND unit_type = 'APT' THEN '#' || unit_value ELSE {kind} || ' ' || unit_value END AS u, CASE WHEN with_zip THEN zip_code ELSE '' END AS z FROM {source}),
lined AS (SELECT *, {street} AS street, {words('city', 'state', 'z')} AS place FROM named),
raw_text AS (SELECT *, {_spaced(f'''CASE "order" {orders} ELSE CASE WHEN u = '' THEN street WHEN unit_first THEN u || {glue} || street ELSE street || {glue} || u END || {glue} || place END''')} AS line FROM lined),
rendered AS (SELECT *, CASE WHEN upper THEN upper(line) WHEN lower THEN lower(line) ELSE array_to_string(list_transform(string_split(line, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN upper(w) WHEN w = upper(w) AND w <> lower(w) AND length(w) <= 5 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') END AS query_address FROM raw_text)"""


@_query(", styled AS (SELECT *, " + ", ".join(f'{e} AS "{f}"' for f, e in _FLAG_SQL.items()) + " FROM ref), " + _render_sql("styled") + " SELECT address_id, query_address FROM rendered")
def render_address(spark, d):
    styled = _raw_ref(spark, d).selectExpr("*", *(f"{e} AS `{f}`" for f, e in _FLAG_SQL.items()))
    return styled.select("address_id", noise.render(F.col).alias("query_address"))


#: Edits whose outcome no draw decides: tag -> (condition, parts and flags).
_SURE = {
    "expand_street_type": ("true", {"full_street_type": "true"}), "expand_directional": ("predir <> '' OR suffixdir <> ''", {"full_directions": "true"}), "expand_unit_type": ("unit_type <> ''", {"full_unit_type": "true"}),
    "hash_unit": ("unit_type = 'APT' AND unit_value <> ''", {"hash_unit": "true"}), "unit_first": ("unit_type <> ''", {"unit_first": "true"}), "drop_zip": ("true", {"with_zip": "false"}), "drop_unit": ("unit_type <> ''", {"with_unit": "false"}),
    "remove_commas": ("true", {"commas": "false"}), "lowercase": ("true", {"lower": "true"}), "extra_spaces": ("true", {"wide": "true"}), "house_after_street_name": ("house_number <> '' AND street_name <> ''", {"house_last": "true", "commas": "false"}),
    "drop_city": ("city <> ''", {"city": "''"}), "drop_state": ("state <> ''", {"state": "''"}), "zip_truncate": ("length(zip_code) = 5", {"zip_code": "substr(zip_code, 1, 4)"}), "drop_directional": ("(predir <> '') <> (suffixdir <> '')", {"predir": "''", "suffixdir": "''"}),
    "merge_tokens": ("(street_name LIKE '% %') <> (city LIKE '% %')", {"street_name": "replace(street_name, ' ', '')", "city": "replace(city, ' ', '')"}), "strip_unit_zero": ("unit_value LIKE '0%' AND ltrim(unit_value, '0') <> ''", {"unit_value": "ltrim(unit_value, '0')"}),
}
_TAGGED = " UNION ALL ".join(
    f"SELECT address_id, '{tag}' AS tag, ({when}) AS done, " + ", ".join(f"CASE WHEN {when} THEN {sets[n]} ELSE {n} END AS \"{n}\"" if n in sets else f'"{n}"' for n in (*PARTS, *noise.FLAGS)) + " FROM plain" for tag, (when, sets) in _SURE.items()
)
_PLAIN = ", plain AS (SELECT address_id, " + ", ".join(PARTS) + ", " + ", ".join(f'{str(x).lower()} AS "{f}"' for f, x in noise.FLAGS.items()) + " FROM ref)"


@_query(f"{_PLAIN}, tagged AS ({_TAGGED}), {_render_sql('tagged')} SELECT address_id, tag, done, query_address FROM rendered")
def style_ops(spark, d):
    """Each edit that no draw decides, alone, on every row."""
    names, tags = (*PARTS, *noise.FLAGS), list(_SURE)
    kind = "array<struct<tag: string, done: boolean, " + ", ".join(f"`{n}`: {'string' if n in PARTS else 'int' if n == 'order' else 'boolean'}" for n in names) + ">>"

    @F.pandas_udf(kind)
    def each(parts: pd.DataFrame) -> pd.Series:
        out = []
        for own in parts.to_dict("records"):
            rows = []
            for tag in tags:
                state = {**own, **noise.FLAGS, "cities": [], "tags": []}
                # two of them draw among parts where more than one has the matter: not here
                both = (tag == "drop_directional" and own["predir"] and own["suffixdir"]) or (tag == "merge_tokens" and " " in own["street_name"] and " " in own["city"])
                done = bool(not both and noise._BY_TAG[tag].apply(state, random.Random(0)))
                rows.append({"tag": tag, "done": done, **{n: state[n] for n in names}})
            out.append(rows)
        return pd.Series(out)

    rows = _raw_ref(spark, d).withColumn("_e", F.explode(each(F.struct(*PARTS)))).select("address_id", "_e.*")
    return rows.select("address_id", "tag", "done", noise.render(F.col).alias("query_address"))


# ---- service ---------------------------------------------------------------------

_ZIP_TIERS = ", ".join(f"z{i} AS (SELECT {', '.join(_signature() + ' AS sig' if k == 'signature' else k for k in key)}, min(zip_code) AS low, max(zip_code) AS high FROM ref GROUP BY ALL)" for i, key in enumerate((("house_number", "city", "state", "signature"), ("house_number", "city", "state", "street_name"), ("city", "state", "street_name", "street_type"))))


@_query(f"""
, {_ZIP_TIERS}, asked AS (SELECT *, {_signature()} AS sig FROM qparts),
tiers AS (SELECT a.query_id, a.zip_code, a.city, a.state, CASE WHEN z0.low IS NOT NULL THEN CASE WHEN z0.low = z0.high THEN z0.low ELSE '' END END AS t0, CASE WHEN z1.low IS NOT NULL THEN CASE WHEN z1.low = z1.high THEN z1.low ELSE '' END END AS t1,
  CASE WHEN z2.low IS NOT NULL THEN CASE WHEN z2.low = z2.high THEN z2.low ELSE '' END END AS t2 FROM asked a LEFT JOIN z0 USING (house_number, city, state, sig) LEFT JOIN z1 ON z1.house_number = a.house_number AND z1.city = a.city AND z1.state = a.state AND z1.street_name = a.street_name
  LEFT JOIN z2 ON z2.city = a.city AND z2.state = a.state AND z2.street_name = a.street_name AND z2.street_type = a.street_type)
SELECT query_id, CASE WHEN zip_code <> '' THEN zip_code WHEN city = '' OR state = '' THEN '' ELSE coalesce(t0, t1, t2, '') END AS inferred_zip FROM tiers
""")
def infer_zip(spark, d):
    return service.inferred_zips(_qry(spark, d).select("query_id", *PARTS), _ref(spark, d)).select("query_id", "inferred_zip")


# ---- stage 1 as a whole, with its fuzzy street ------------------------------------

_RULE_NAMES = [*stage1.RULES, stage1.FUZZY[0]]
_CONFIDENCE = [c for c, _, _ in stage1.RULES.values()] + [stage1.FUZZY[1]]
_HERE = "CASE WHEN city <> '' AND state <> '' THEN r_city = city AND r_state = state WHEN city <> '' THEN r_city = city WHEN zip_code <> '' THEN substr(r_zip_code, 1, 3) = substr(zip_code, 1, 3) ELSE true END"


@_query(_VARIANTS + _UNIQUE + f"""
, vkeys AS ({_keys_sql('variants', 'query_id, variant')}), hits AS (SELECT query_id, variant, rule, address_id FROM vkeys JOIN uniq USING (key)),
first_hit AS (SELECT query_id, min(variant) AS first FROM hits GROUP BY query_id),
asked AS (SELECT v.*, {_core('v.')} AS core, CASE WHEN city <> '' AND state <> '' THEN 1 WHEN city <> '' THEN 2 WHEN zip_code <> '' THEN 3 WHEN state <> '' THEN 4 END AS kind FROM variants v LEFT JOIN first_hit USING (query_id) WHERE (first IS NULL OR variant < first) AND house_number <> '' AND street_name <> ''),
rr AS (SELECT address_id, house_number AS r_house, street_name AS r_street_name, street_type AS r_street_type, {_core()} AS r_core, city AS r_city, state AS r_state, zip_code AS r_zip_code FROM ref),
by_city AS (SELECT r_house, r_city, r_state, count(*) AS n FROM rr GROUP BY ALL), by_zip AS (SELECT r_house, substr(r_zip_code, 1, 3) AS zip3, count(*) AS n FROM rr GROUP BY ALL),
by_state AS (SELECT r_house, r_state, count(*) AS n FROM rr GROUP BY ALL), by_house AS (SELECT r_house, count(*) AS n FROM rr GROUP BY ALL),
sized AS (SELECT a.*, CASE kind WHEN 1 THEN c.n WHEN 3 THEN z.n WHEN 4 THEN s.n END AS n_own, h.n AS n_house FROM asked a LEFT JOIN by_city c ON c.r_house = a.house_number AND c.r_city = a.city AND c.r_state = a.state
  LEFT JOIN by_zip z ON z.r_house = a.house_number AND z.zip3 = substr(a.zip_code, 1, 3) LEFT JOIN by_state s ON s.r_house = a.house_number AND s.r_state = a.state LEFT JOIN by_house h ON h.r_house = a.house_number),
small AS (SELECT *, city <> '' OR zip_code <> '' AS strong FROM sized WHERE coalesce(n_own, n_house, 0) > 0 AND coalesce(n_own, n_house) <= CASE WHEN city <> '' OR zip_code <> '' THEN 80 ELSE 12 END),
pairs AS (SELECT s.*, r.* FROM small s JOIN rr r ON r.r_house = s.house_number AND (n_own IS NULL OR CASE kind WHEN 1 THEN r_city = city AND r_state = state WHEN 3 THEN substr(r_zip_code, 1, 3) = substr(zip_code, 1, 3) ELSE r_state = state END)),
strings AS (SELECT DISTINCT street_name AS a, r_street_name AS b FROM pairs), {_RATIO},
streets AS (SELECT p.*, greatest({_blended('street_name', 'r_street_name', 'x.ratio')}, x.ratio) AS street FROM pairs p JOIN ratios x ON x.a = street_name AND x.b = r_street_name),
scored AS (SELECT *, 0.58 * street + 0.22 * {_jaccard('core', 'r_core')} + 0.10 * (street_type = '' OR street_type = r_street_type)::INT + 0.10 * ({_HERE})::INT AS score FROM streets),
ranked AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS ahead FROM scored WINDOW w AS (PARTITION BY query_id, variant ORDER BY score DESC, address_id DESC)),
fuzzy AS (SELECT query_id, variant, {len(stage1.RULES)} AS rule, address_id FROM ranked WHERE k = 1 AND ((strong AND street >= 0.62 AND (street_type = '' OR street_type = r_street_type) AND ahead >= 0.16) OR (score >= 0.88 AND ahead >= 0.08))),
best AS (SELECT query_id, arg_min(struct_pack(v := variant, r := rule, a := address_id), variant * 100 + rule) AS m FROM (FROM hits UNION ALL FROM fuzzy) GROUP BY query_id),
named AS (SELECT b.query_id, m.a AS id, reason, {_standard('v.')} AS standard, [{', '.join(map(repr, _RULE_NAMES))}][m.r + 1] AS rule_name, [{', '.join(map(str, _CONFIDENCE))}][m.r + 1]::DOUBLE AS c FROM best b JOIN variants v ON v.query_id = b.query_id AND v.variant = m.v),
done AS (SELECT *, CASE WHEN reason = 'original' THEN c ELSE greatest(0.88, c - 0.03) END AS confidence FROM named)
SELECT q.query_id, coalesce(id, '') AS predicted_match_id, coalesce(standard, {_standard('q.')}) AS standardized_query_address, round(coalesce(confidence, 0), 6) AS confidence, coalesce(confidence, 0) < 0.97 AS needs_review, coalesce('stage1_' || reason || '_' || rule_name, 'stage1_unresolved') AS stage
FROM qparts q LEFT JOIN done d USING (query_id)
""", recursive=True)
def stage1_resolution(spark, d):
    """Stage 1 from variants to answers, the fuzzy street included."""
    variants = stage1.plain_variants(_qry(spark, d).withColumnRenamed("query_id", "raw"))
    out = stage1.resolve(stored(variants), stored(_ref(spark, d)))
    return out.select(F.col("raw").alias("query_id"), "predicted_match_id", "standardized_query_address", _r(F.col("confidence")).alias("confidence"), "needs_review", "stage")


# ---- reading ----------------------------------------------------------------------

#: What the reader makes of the derived texts. Units aren't in the texts. A street that lost its type and ends in PLATE has one of its own (PL, place); a name
#: that begins with NEW reads as the direction NW without its second letter; a city with swapped letters is corrected, unless its last word is a direction.
_READ = {
    "house_number": "q.house_number", "predir": "CASE WHEN nw THEN 'NW' ELSE q.predir END", "street_name": "CASE WHEN plate THEN substr(q.street_name, 1, length(q.street_name) - 6) WHEN nw THEN substr(q.street_name, 4) WHEN lost THEN q.street_name || ' ' || string_split(q.city, ' ')[1] ELSE q.street_name END",
    "street_type": "CASE WHEN plate THEN 'PL' ELSE q.street_type END", "suffixdir": "CASE WHEN lost THEN string_split(q.city, ' ')[-1] ELSE '' END", "unit_type": "''", "unit_value": "''", "city": "CASE WHEN lost THEN '' WHEN noise_kind = 5 THEN r.city ELSE q.city END", "state": "q.state", "zip_code": "q.zip_code",
}


@_query(f"""
, told AS (SELECT *, noise_kind = 2 AND street_name LIKE '% PLATE' AS plate, noise_kind = 3 AND predir = '' AND street_name LIKE 'NW %' AS nw, noise_kind = 5 AND string_split(city, ' ')[-1] IN ('N', 'S', 'E', 'W', 'NE', 'NW', 'SE', 'SW') AS lost FROM qparts)
SELECT query_id, {', '.join(f'{e} AS {p}' for p, e in _READ.items())} FROM told q JOIN ref r ON q.true_match_id = r.address_id
""")
def parse_freeform(spark, d):
    """Every text read, with its city and context settled."""
    ref, q = _ref(spark, d), _qry(spark, d)
    read = reading.read_all(q.select(F.col("query_address").alias("raw")), ref, refs.places(ref), stored)
    return q.select("query_id", F.col("query_address").alias("raw")).join(read.select("raw", "parts.*"), "raw").drop("raw")


# ---- near misses and checks of datasets ---------------------------------------------

_GAP = "CASE WHEN regexp_matches(p.house_number, '^[0-9]+$') AND regexp_matches(r.house_number, '^[0-9]+$') THEN abs(p.house_number::BIGINT - r.house_number::BIGINT) ELSE 999 END"
_STREET_SAME = " AND ".join(f"p.{c} = r.{c}" for c in ("predir", "street_name", "street_type", "suffixdir"))


_KEPT = _neighbours_sql("").replace(" SELECT candidate, neighbour, arg_min(reason, i) AS reason FROM pairs GROUP BY 1, 2", ", kept AS (SELECT candidate, neighbour, arg_min(reason, i) AS reason FROM pairs GROUP BY 1, 2),\n")


@_query(_KEPT + f"""both_ AS (SELECT k.*, upper(r.street_name) AS a, upper(p.street_name) AS b, p.house_number = r.house_number AS house, {_STREET_SAME} AS street, (p.city = r.city AND p.state = r.state AND r.city <> '') OR (p.zip_code = r.zip_code AND r.zip_code <> '') AS near, {_GAP} AS gap
  FROM kept k JOIN pool p ON p.address_id = k.candidate JOIN ref r ON r.address_id = k.neighbour),
strings AS (SELECT DISTINCT a, b FROM both_), {_RATIO}
SELECT candidate, neighbour, reason, round(greatest(CASE WHEN house AND near THEN 0.68 + 0.25 * ratio ELSE 0 END, CASE WHEN street AND near AND gap BETWEEN 1 AND 20 THEN 0.76 + 0.20 * (1 - least(gap, 20) / 20.0) ELSE 0 END,
  CASE WHEN reason IN ('same_house_city', 'same_house_zip') THEN CASE WHEN ratio >= 0.45 THEN 0.55 + 0.35 * ratio ELSE 0 END ELSE CASE WHEN gap BETWEEN 1 AND 30 THEN 0.58 + 0.30 * (1 - least(gap, 30) / 30.0) ELSE 0 END END)::DOUBLE, 6) AS score FROM both_ JOIN ratios USING (a, b)
""", recursive=True)
def neighbor_scores(spark, d):
    """How easily every row, some with a changed house, is taken for each of its neighbours."""
    ref = _raw_ref(spark, d)
    pool = ref.withColumn("house_number", F.expr(_POOL)).withColumn("canonical_address", F.col("address_id"))
    scored = dataset.neighbour_score(dataset.neighbours(pool, ref, strict=False))
    return scored.select(F.col("address_id").alias("candidate"), F.col("n_id").alias("neighbour"), "reason", _r(F.col("score")).alias("score"))


_TABLES = {
    "reference": ("address_id", "true"), "negatives": ("CASE WHEN ref_ord % 14 = 0 THEN address_id ELSE 'NEG_' || address_id END", "ref_ord % 7 = 0"), "adversarial": ("'ADV_' || cast(ref_ord % 30 as string)", "ref_ord % 10 = 0"),
}
_ASKED = {
    "query_id": "case when noise_kind = 1 then 'Q_1' else query_id end", "label": "cast(case when noise_kind = 6 then 0 else 1 end as int)", "base_address_id": "true_match_id", "split": "case when noise_kind = 2 then 'test' else 'train' end",
    "true_match_id": "case when noise_kind = 0 then 'REF_0000001' when noise_kind = 6 then '' else true_match_id end", "query_address": "query_address",
}
_KEY = lambda x: f"trim(upper(replace(regexp_replace(trim(regexp_replace(replace({x}, ',', ' , '), '\\s+', ' ', 'g')), ' ,', ',', 'g'), ',', '')))"


@_query(", lines AS (SELECT *, " + _canonical() + " AS canonical_address FROM ref), ids AS (" + " UNION ALL ".join(f"SELECT {i} AS address_id, canonical_address FROM lines WHERE {w}" for i, w in _TABLES.values()) + "), data AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ASKED.items()) + f""" FROM qry),
wrong AS (SELECT 1 FROM data q JOIN lines r ON {_KEY('q.query_address')} = {_KEY('r.canonical_address')} WHERE q.label = 0 OR r.address_id <> q.true_match_id)
SELECT 'repeated_id' AS "check", count(*) AS violations FROM (SELECT 1 FROM ids GROUP BY address_id HAVING count(*) > 1) UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM ids GROUP BY canonical_address HAVING count(*) > 1)
UNION ALL SELECT 'unsafe_label', count(*) FROM wrong UNION ALL SELECT 'split_bases', count(*) FROM (SELECT 1 FROM data GROUP BY base_address_id HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'repeated_query_id', count(*) FROM (SELECT 1 FROM data GROUP BY query_id HAVING count(*) > 1)
""")
def validate_counts(spark, d):
    """The checks of a dataset, on one that breaks all of them."""
    lines = _raw_ref(spark, d).withColumn("canonical_address", text.canonical_line())
    made = {n: lines.where(w).withColumn("address_id", F.expr(i)) for n, (i, w) in _TABLES.items()}
    made["queries"] = _qry(spark, d).selectExpr(*(f"{e} AS {n}" for n, e in _ASKED.items()))
    return dataset.problems(made)


@_query("SELECT query_id, least(40, 28 + 4 * ((house_number = '')::INT + (street_name = '')::INT + (city = '')::INT + (state = '')::INT + (zip_code = '')::INT) + CASE WHEN zip_code = '' THEN 4 ELSE 0 END + CASE WHEN city = '' OR house_number = '' THEN 2 ELSE 0 END)::INT AS k FROM qparts")
def candidate_limits(spark, d):
    return _qry(spark, d).select("query_id", ranking.candidate_limit().cast("int").alias("k"))


@_query(_COMBINED + _metrics_sql("(SELECT c.*, q.noise_kind FROM comb c JOIN qparts q USING (query_id))", "by_kind").replace("SELECT ", "SELECT noise_kind, ", 1) + " GROUP BY noise_kind")
def eval_by_kind(spark, d):
    """The metrics by kind of noise, as by split or stage."""
    rows = _combined(spark, d).drop("top_candidates").join(_qry(spark, d).select("query_id", "noise_kind"), "query_id")
    return evaluate.metrics(rows, "by_kind", ["noise_kind"])


@_query(_JUDGED + """
, own AS (SELECT source_ord, count(*) FILTER (inside = 1) AS rows_loaded, count(*) FILTER (across = 1) AS net_new, count(DISTINCT upper("CITY")) FILTER (across = 1 AND "CITY" <> '') AS city_count, count(DISTINCT "POSTCODE") FILTER (across = 1 AND "POSTCODE" <> '') AS zip_count,
  count(*) FILTER (across = 1 AND "CITY" = '') AS blank_city_records, count(*) FILTER (across = 1 AND "POSTCODE" = '') AS blank_zip_records FROM ranked GROUP BY 1),
seen AS (SELECT source_ord, count(*) AS rows_seen FROM judged GROUP BY 1)
SELECT source_ord::INT AS source_ord, rows_seen, net_new, rows_loaded, net_new AS records, city_count, zip_count, blank_city_records, blank_zip_records FROM seen JOIN own USING (source_ord)
""")
def source_audit(spark, d):
    records, stats = formats.load(_sources(spark, d))
    return quality.audit(records, stats).drop("reasons")
