"""The address engine in a session."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from addrloom.functions.vocab import FEATURES, PARTS
from addrloom.operators import dataset, evaluate, feedback, ranking, reading, reference, stage1, training
from addrloom.plans.queries import model
from addrloom.plans.resolve import resolve
from addrloom.sources import conform, connectors, files, formats
from addrloom.storage import stored

REF = [
    ("R1", "101", "", "Candace", "ST", "", "", "", "Newton", "MS", "39345"), ("R2", "102", "", "Candace", "ST", "", "", "", "Newton", "MS", "39345"), ("R3", "306", "", "Clark", "AVE", "", "", "", "Newton", "MS", "39345"),
    ("R4", "385", "", "College View", "DR", "", "", "", "Starkville", "MS", "39759"), ("R5", "419", "", "West", "PL", "", "", "", "Madison", "MS", "39110"), ("R6", "34", "", "John Henry", "LN", "", "", "", "Starkville", "MS", "39759"),
    ("R7", "821", "", "Myrtle", "AVE", "", "", "", "Natchez", "MS", "39120"), ("R8", "268", "", "Maxine", "DR", "", "", "", "Pearl", "MS", "39208"),
]
QUERIES = [
    ("Q1", 1, "R1", "101 candoose st newtooon MS"), ("Q2", 1, "R2", "102 candace st newton ms"), ("Q3", 1, "R3", "306 clarke ave newton"), ("Q4", 1, "R4", "385 colage view drive starkvile"), ("Q5", 1, "R5", "419 west pl madison MS"),
    ("Q6", 1, "R6", "34 john henry ln starkvilee ms"), ("Q7", 0, "", "999 missing rd newton ms"), ("Q8", 0, "", "1 fake plaza starkville ms"), ("Q9", 0, "", None), ("Q10", 0, "", "101"),
]


@pytest.fixture(scope="module")
def ref(spark):
    return stored(reference.prepare(spark.createDataFrame(REF, "address_id string, " + ", ".join(f"{p} string" for p in PARTS))))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id string, label int, true_match_id string, query_address string")


def test_demo_queries_find_their_rows(asked, ref):
    for both in (True, False):
        out = {r.query_id: r for r in resolve(asked, ref, model(), both=both).collect()}
        assert len(out) == len(QUERIES)
        assert {q: out[q].predicted_match_id for q, label, *_ in QUERIES if label} == {q: t for q, label, t, _ in QUERIES if label}
        assert not any(out[q].predicted_match_id for q in ("Q7", "Q8", "Q9", "Q10"))
        assert out["Q9"].stage in ("stage2_no_candidates",) and out["Q9"].confidence == 1.0
        assert out["Q1"].predicted_canonical_address == "101 CANDACE ST, NEWTON MS 39345"


def test_street_context_moves_words_to_the_city(spark, ref):
    raw = spark.createDataFrame([("101 candace newtn ms",), ("clark 306 nweton ms",)], "raw string")
    out = {r.raw: r.parts for r in reading.read_all(raw, ref, reference.places(ref), stored).collect()}
    assert (out["101 candace newtn ms"].street_name, out["101 candace newtn ms"].city) == ("CANDACE", "NEWTON")


def test_unique_match_needs_one_row(spark, ref):
    twice = ref.unionByName(ref.where("address_id = 'R1'").withColumn("address_id", F.lit("R1b")))
    parts = ref.where("address_id IN ('R1', 'R2')").select(F.col("address_id").alias("raw"), F.lit(0).alias("variant"), F.lit("original").alias("reason"), *PARTS)
    out = {r.raw: r for r in stage1.resolve(parts, twice).collect()}
    assert out["R2"].stage == "stage1_original_exact" and out["R2"].confidence == 0.99 and not out["R2"].needs_review
    assert out["R1"].predicted_match_id == "" and out["R1"].stage == "stage1_unresolved" and out["R1"].needs_review


def test_models_keep_their_shape():
    m = ranking.Model([1.0] * 23, {"leaf": True, "probability": 0.5}, 0.42, 0.98)
    assert len(m.weights) == len(FEATURES) and m.weights[23:] == [0.0] * 5
    again = ranking.Model.from_json(m.to_json())
    assert (again.weights, again.tree, again.accept, again.review) == (m.weights, m.tree, 0.42, 0.98)
    with pytest.raises(ValueError):
        ranking.Model([0.0] * 29)


def test_training_ranks_true_rows_first(spark, asked, ref):
    good = asked.where("query_address IS NOT NULL")
    read = reading.read_all(good.select(F.col("query_address").alias("raw")), ref, reference.places(ref), stored)
    m = training.fit(good, read, ref, stored)
    assert len(m.weights) == len(FEATURES) and m.tree["leaf"] and 0.25 <= m.accept <= 0.97
    featured = training.featured_candidates(good, read, ref, keep=stored).withColumn("s", ranking.rank_score(m.weights))
    best = {r.query_id: r.address_id for r in featured.where("label = 1").groupBy("query_id").agg(F.max_by("address_id", F.struct("s", -F.col("cand_ord"))).alias("address_id")).collect()}
    assert best == {q: t for q, label, t, _ in QUERIES if label}


def test_trees_split_where_labels_change():
    import numpy as np

    x = np.linspace(0, 1, 400)[:, None]
    tree = training.fit_tree(x, (x[:, 0] > 0.5).astype(int), 4, 30)
    assert not tree["leaf"] and abs(tree["threshold"] - 0.5) < 0.1


def test_combining(spark):
    row = "raw string, predicted_match_id string, standardized_query_address string, confidence double, needs_review boolean, stage string"
    one = spark.createDataFrame([("a", "", "", 0.0, True, "s1"), ("b", "X", "", 0.9, True, "s1"), ("c", "X", "", 0.9, True, "s1"), ("d", "X", "", 0.9, True, "s1"), ("e", "X", "", 0.9, False, "s1")], row)
    two = spark.createDataFrame([("a", "Y", "", 0.5, True, "s2"), ("b", "", "", 0.9, False, "s2"), ("c", "X", "", 0.95, True, "s2"), ("d", "Y", "", 0.9, False, "s2"), ("e", "Y", "", 0.99, False, "s2")], row)
    two = two.withColumn("top_candidates", F.array().cast("array<struct<reference_id:string,score:double>>"))
    assert {r.raw: r.stage for r in ranking.combine(one, two).collect()} == {"a": "s2", "b": "s1", "c": "s2", "d": "s2", "e": "s1"}


def test_metrics(spark):
    rows = [("A", 1, "A", 0.9, False, "stage1_x"), ("B", 1, "C", 0.8, True, "stage2_x"), ("", 0, "", 1.0, False, "stage2_x"), ("", 0, "D", 0.7, False, "stage2_x")]
    df = spark.createDataFrame([(t, y, p, c, r, s) for t, y, p, c, r, s in rows], "true_match_id string, label int, predicted_match_id string, confidence double, needs_review boolean, stage string")
    m = evaluate.metrics(df, "n").first()
    assert (m.accuracy, m.precision, m.recall, m.coverage, m.accepted_accuracy, m.stage1_share) == (0.5, 0.3333, 0.5, 0.75, 0.6667, 0.25)
    assert evaluate.review_threshold(df, 0.97).first().threshold == 0.8 + 0.01 or evaluate.review_threshold(df, 0.97).first().coverage == 0.5


def dbf(rows, fields):
    head = 33 + 32 * len(fields)
    width = 1 + sum(n for _, n in fields)
    out = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), head, width)
    for name, n in fields:
        out += name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([n]) + bytes(15)
    return out + b"\r" + b"".join((b"*" if gone else b" ") + b"".join(str(v).encode("latin1").ljust(n) for v, (_, n) in zip(values, fields)) for gone, values in rows)


def test_files_of_all_kinds(spark, tmp_path):
    fields = [("NUMBER", 6), ("STREET", 20), ("CITY", 10), ("POSTCODE", 6)]
    raw = dbf([(False, ("1", "Main St", "Newton", "39345")), (True, ("2", "Gone St", "Newton", "39345")), (False, ("3", "Été Rd", "Newton", "39345"))], fields)
    (tmp_path / "b.dbf").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.csv", "﻿number,STREET,CITY,POSTCODE\n5,Oak St,Pearl,39208\n")
        z.writestr("x.dbf", raw)
        z.writestr("skip.md", "no")
    (tmp_path / "c.csv").write_bytes("NUMBER,STREET,CITY,POSTCODE\n7,Élm St,Pearl,39208\n".encode("latin-1"))
    rows = files.columns(files.read_files(spark, [str(tmp_path)]))
    got = [(r.NUMBER, r.STREET) for r in rows.orderBy("file_ord", "row_ord").collect()]
    assert got == [("5", "Oak St"), ("1", "Main St"), ("3", "Été Rd"), ("1", "Main St"), ("3", "Été Rd"), ("7", "Élm St")]
    records, stats = formats.load([(rows, "auto")])
    assert records.count() == 4 and {(r.reason, r.rows) for r in stats.collect()} == {("loaded", 4), ("duplicate", 2)}
    with pytest.raises(FileNotFoundError):
        files.discover([str(tmp_path / "none")])


def rows_of(spark, *rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n, "") for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize("row,kind,canonical", [
    ({"NUMBER": "101", "STREET": "N Candace Street", "UNIT": "Apt 4", "CITY": "City of Newton", "REGION": "Mississippi", "POSTCODE": "39345-1234"}, "openaddresses", "101 N CANDACE ST, APT 4, NEWTON MS 39345"),
    ({"NUMBER": "", "STREET": "12 Oak Rd", "CITY": "Pearl", "REGION": "", "POSTCODE": ""}, "openaddresses", "12 OAK RD, PEARL MS"),
    ({"State": "MS", "Add_Number": "7", "St_PreDir": "West", "St_Name": "Clark", "St_PosTyp": "Avenue", "Post_City": "Newton", "Zip_Code": "39345", "Unit": "", "Room": "Rm 2"}, "nad", "7 W CLARK AVE, RM 2, NEWTON MS 39345"),
    ({"STNUM": "9", "NAME": "Holly Drive", "TYPE": "", "CITY": "Laurel", "ZIP": "39440"}, "maris", "9 HOLLY DR, LAUREL MS 39440"),
    ({"SITEADD": "44 E Pine St", "SCITY": "Laurel County", "SSTATE": "MS", "SZIP": "39440"}, "maris_parcels", "44 E PINE ST, LAUREL MS 39440"),
    ({"full_address": "5 Elm St, Pearl, MS 39208"}, "generic", "5 ELM ST, PEARL MS 39208"),
    ({"house_number": "1.01E2", "street_name": "Main", "street_type": "st", "state": "ms", "city": "Pearl"}, "address_record", "101 MAIN ST, PEARL MS"),
    ({"NUMBER": "8", "STREET": "Clarke Ave", "CITY": "Newton", "REGION": "MS", "POSTCODE": "39345"}, "openaddresses", "8 CLARK AVE, NEWTON MS 39345"),
])
def test_formats(spark, row, kind, canonical):
    df = rows_of(spark, row)
    assert formats.detect(df.columns) == kind
    out = formats.project(df, kind).first()
    assert (out.reject, out.canonical_address) == ("", canonical)


@pytest.mark.parametrize("row,reason", [
    ({"NUMBER": "1", "STREET": "A St", "CITY": "X", "REGION": "AL", "POSTCODE": ""}, "state_mismatch"), ({"NUMBER": "1", "STREET": "A St", "CITY": "X", "REGION": "MS", "POSTCODE": "10001"}, "non_ms_zip"),
    ({"NUMBER": "1", "STREET": "A St", "CITY": "Rural", "REGION": "MS", "POSTCODE": ""}, "missing_locality"), ({"NUMBER": "0", "STREET": "A St", "CITY": "X", "REGION": "MS", "POSTCODE": ""}, "missing_or_invalid_house_number"),
    ({"NUMBER": "5", "STREET": "Corner of A St", "CITY": "X", "REGION": "MS", "POSTCODE": ""}, "parcel_location_descriptor"), ({"NUMBER": "5", "STREET": "N/A", "CITY": "X", "REGION": "MS", "POSTCODE": ""}, "missing_street"),
])
def test_reject_reasons(spark, row, reason):
    assert formats.project(rows_of(spark, row), "openaddresses").first().reject == reason


def test_conform(spark):
    df = rows_of(spark, {"num": "12", "ADDR": "12 Oak Rd", "Town": "Pearl", "zip5": "39208 x", "note": "id=77;"})
    spec = {"number": {"function": "prefixed_number", "field": "addr"}, "street": {"function": "postfixed_street", "field": "ADDR"}, "city": "town", "postcode": ["zip5"], "id": {"function": "regexp", "field": "note", "pattern": "id=(\\d+)", "replace": "n$1"}}
    r = conform.normalize(df, spec, "src", {"state": "ms"}).first()
    assert (r.NUMBER, r.STREET, r.CITY, r.POSTCODE, r.REGION, r.SOURCE_ID, r.LOCALITY_STATUS) == ("12", "Oak Rd", "Pearl", "39208", "MS", "n77", "situs_locality")
    bare = {"number": "num", "street": {"function": "postfixed_street", "field": "ADDR"}}
    assert conform.county_only(bare, {"state": "ms", "county": "Lee"}) and not conform.has_locality(bare, {})
    assert conform.normalize(df, bare, "s", {"state": "ms", "county": "Lee"}).count() == 0
    assert conform.normalize(df, bare, "s", {"state": "ms", "county": "Lee"}, True).first().LOCALITY_STATUS == "county_only_situs"


def test_failed_batches_are_halved():
    calls = []

    def get(url, params):
        ids = [int(i) for i in params["objectIds"].split(",")]
        calls.append(len(ids))
        if 13 in ids:
            raise OSError
        return json.dumps({"features": [{"attributes": {"id": i}} for i in ids]}).encode()

    found, lost = connectors.features("u", list(range(16)), get=get)
    assert sorted(f["attributes"]["id"] for f in found) == [i for i in range(16) if i != 13] and lost == 1
    with pytest.raises(RuntimeError):
        connectors.read_json("u", get=lambda u, p: b'{"error": {"code": 1}}')
    layers = {"coverage": {}, "layers": {"addresses": [{"protocol": "ESRI", "conform": {"city": "c"}}, {"protocol": "FTP"}, {"protocol": "http", "conform": {}}]}}
    assert [s for _, s in connectors.plan_layers(layers, "x")] == ["fetched", "skipped_protocol", "skipped_locality"]
    assert {s for _, s in connectors.plan_layers(layers, "statewide-east")} == {"skipped_statewide"}


LOG = "row_ord long, feedback_type string, input_address string, standardized_address string, predicted_match_id string, predicted_canonical_address string, confidence string, stage string, correct_address string, correct_reference_id string, correct_canonical_address string, top_candidates string, created_at string"


def log_rows(spark, *rows):
    names = [c.split()[0] for c in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, i if n == "row_ord" else "") for n in names) for i, r in enumerate(rows)], LOG)


def test_feedback(spark, ref):
    log = log_rows(
        spark, {"feedback_type": "correct", "input_address": "a st", "predicted_match_id": "R1"}, {"feedback_type": "correction", "input_address": "A ST", "correct_reference_id": "R2"},
        {"feedback_type": "correction", "input_address": "b st", "correct_address": "306 Clark Ave, Newton MS 39345"}, {"feedback_type": "wrong", "input_address": "c st", "predicted_match_id": "R1"},
        {"feedback_type": "correct", "input_address": "d st", "predicted_match_id": "GONE"}, {"feedback_type": "correction", "input_address": "e st", "correct_address": "nowhere"}, {"feedback_type": "noise", "input_address": "f"},
    )
    assert {r.key: r.reference_id for r in feedback.overrides(log, ref).collect()} == {"A ST": "R2", "B ST": "R3"}
    queries, counts = feedback.labelled_queries(log, ref)
    assert {(r.query_address, r.label, r.true_match_id) for r in queries.collect()} == {("a st", 1, "R1"), ("A ST", 1, "R2"), ("b st", 1, "R3"), ("c st", 0, ""), ("d st", 0, "")}
    c = counts.first()
    assert (c.rows_seen, c.rows_skipped, c.queries_added, c.positive_queries_added, c.negative_queries_added, c.missing_reference_rows) == (7, 1, 5, 3, 2, 1)


def test_feedback_stream(spark, ref, tmp_path):
    from addrloom.streaming import feedback as stream

    log, out, runs = str(tmp_path / "log"), str(tmp_path / "out"), []
    one = log_rows(spark, {"feedback_type": "correct", "input_address": "a st", "predicted_match_id": "R1"})
    two = log_rows(spark, {"feedback_type": "correction", "input_address": "a st", "correct_reference_id": "R2"}, {"feedback_type": "correct", "input_address": "b st", "predicted_match_id": "R3"})
    for rows in (one, two):
        stream.append(rows, log)
        q = stream.follow(spark, log, ref, out, str(tmp_path / "cp"), lambda df, n: runs.append(n))
        q.awaitTermination()
    assert {r.key: r.reference_id for r in stream.current(spark, out).collect()} == {"A ST": "R2", "B ST": "R3"} and runs == [0, 1]


def test_streamed_overrides_are_those_of_the_whole_log(spark, ref, tmp_path):
    """A random log, cut at random: corrections without an id come last of all, whatever the batch."""
    import random

    from addrloom.streaming import feedback as stream

    rng = random.Random(3)
    kinds = (
        lambda: {"feedback_type": "correct", "predicted_match_id": rng.choice(("R1", "R2", "GONE"))}, lambda: {"feedback_type": "correction", "correct_reference_id": rng.choice(("R3", "R4"))},
        lambda: {"feedback_type": "correction", "correct_address": rng.choice(("306 Clark Ave, Newton MS 39345", "419 West Pl, Madison MS 39110"))}, lambda: {"feedback_type": "wrong", "predicted_match_id": "R1"},
    )
    rows = [{**rng.choice(kinds)(), "input_address": f"{rng.choice('abcdef')} st"} for _ in range(40)]
    log = stored(log_rows(spark, *rows))
    expected = {r.key: r.reference_id for r in feedback.overrides(log, ref).collect()}
    for k, cuts in enumerate(([40], sorted(rng.sample(range(1, 40), 3)) + [40])):
        at, out, start = str(tmp_path / f"log{k}"), str(tmp_path / f"out{k}"), 0
        for end in cuts:
            stream.append(log.where(f"row_ord >= {start} AND row_ord < {end}"), at)
            stream.follow(spark, at, ref, out, str(tmp_path / f"cp{k}")).awaitTermination()
            start = end
        assert {r.key: r.reference_id for r in stream.current(spark, out).collect()} == expected
        stream.compact(spark, out, f"{out}-one")
        assert {r.key: r.reference_id for r in stream.current(spark, f"{out}-one").collect()} == expected


def test_datasets(spark, tmp_path):
    pool = spark.range(240).selectExpr(
        "concat('P', id) AS address_id", "cast(100 + id % 60 as string) AS house_number", "'' AS predir", "concat('Street', char(65 + cast(id / 60 as int)), 'land') AS street_name", "'ST' AS street_type", "'' AS suffixdir", "'' AS unit_type", "'' AS unit_value",
        "case when id % 2 = 0 then 'Newton' else 'Jackson' end AS city", "'MS' AS state", "'39345' AS zip_code",
    )
    made = {k: stored(v) for k, v in dataset.build(pool, 60, 10, 10, per=3).items()}
    assert made["queries"].count() == 60 * 3 + 20 and {r.violations for r in dataset.problems(made).collect()} == {0}
    again = dataset.build(pool.repartition(5), 60, 10, 10, per=3)["queries"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made["queries"].collect()))
    meta = dataset.export(made, str(tmp_path / "d"))
    assert meta["rows"]["queries"] == 200 and (tmp_path / "d" / "metadata").exists()
    with pytest.raises(ValueError):
        dataset.build(pool, 1000, 0, 0)
    assert io.StringIO().read() == ""


def test_queries_agree_with_their_sql(spark):
    """Every registered query with SQL, on the smallest tables."""
    import duckdb

    from addrloom.plans import queries as q

    con = duckdb.connect()
    for t in "customer nation part orders lineitem supplier".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in q.S.items():
        own = q.Q[name](spark, "/root/testdata/sf0.001").toPandas()
        columns = sorted(own.columns)
        other = con.sql(sql).df()
        assert sorted(other.columns) == columns, name
        other = other[columns].sort_values(columns).reset_index(drop=True)
        own = own[columns].sort_values(columns).reset_index(drop=True)
        assert len(own) == len(other), name
        for c in columns:
            if own[c].dtype.kind == "f":
                assert (abs(own[c] - other[c].astype(float)) < 1e-9).all(), (name, c)
            else:
                assert own[c].astype(str).tolist() == other[c].astype(own[c].dtype).astype(str).tolist(), (name, c)


def test_all_texts_are_blocked(spark):
    """Clean texts and every kind of noise get candidates, those without a zip, type or city too."""
    from addrloom.plans import fixtures, queries as q

    d = "/root/testdata/sf0.001"
    kinds = fixtures.queries(spark, d).where("street_name <> ''").select("query_id", "noise_kind")
    every = {(r.query_id, r.noise_kind) for r in kinds.collect()}
    assert {k for _, k in every} >= {0, 1, 2, 3, 4, 5, 6, 7}
    for name in ("blocking_weighted_sum", "blocking_topk"):
        assert {r.query_id for r in q.Q[name](spark, d).select("query_id").distinct().collect()} == {i for i, _ in every}, name


def test_every_row_is_looked_up_for_neighbours(spark):
    """Brute force over all pairs; a fifth of the rows is part of it."""
    from addrloom.plans import fixtures, queries as q

    d = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in fixtures.reference(spark, d).collect()]
    keys = {"same_house_city": ("house_number", "city", "state"), "same_street_city": ("predir", "street_name", "street_type", "suffixdir", "city", "state"), "same_house_zip": ("house_number", "zip_code"), "same_street_zip": ("predir", "street_name", "street_type", "suffixdir", "zip_code")}
    expected = set()
    for r in rows:
        p = r | {"house_number": str(int(r["house_number"]) + 4) if r["ref_ord"] % 2 == 0 else r["house_number"]}
        for n in rows:
            reason = next((k for k, cs in keys.items() if all(p[c] == n[c] and (p[c] or c in ("predir", "street_type", "suffixdir")) for c in cs)), None)
            if reason:
                expected.add((r["address_id"], n["address_id"], reason))
    found = {(x.candidate, x.neighbour, x.reason) for x in q.Q["adversarial_neighbors"](spark, d).collect()}
    assert found == expected and {a for a, *_ in found} == {r["address_id"] for r in rows}


def test_both_stages_get_every_text(spark, monkeypatch):
    from addrloom.plans import fixtures, queries as q, resolve as plan

    class Asked(Exception):
        pass

    def second(read, *_):
        raise Asked(read.select("raw").distinct().count())

    monkeypatch.setattr(plan, "second_stage", second)
    d = "/root/testdata/sf0.001"
    with pytest.raises(Asked) as asked:
        q.Q["resolve_end_to_end"](spark, d)
    assert asked.value.args[0] == fixtures.queries(spark, d).select("query_address").distinct().count()


def _shuffled(spark, df) -> tuple[int, int]:
    """Rows of ``df`` and the records that its run shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return len(df.collect()), written() - before


def test_pairs_of_neighbours_are_not_shuffled(spark):
    """Sixty rows of one house and city are 3,600 pairs; a repeated id or line still counts once a pair, under its first reason."""
    from addrloom.operators import dataset

    parts = dict(predir="", street_type="ST", suffixdir="", unit_type="", unit_value="", city="NEWTON", state="MS", zip_code="39345")
    made = lambda i, **new: {"address_id": f"A{i}", "canonical_address": f"L{i}", "house_number": "1", "street_name": f"S{i % 7}", **parts, **new}
    table = lambda rows: spark.createDataFrame(rows, "address_id string, canonical_address string, house_number string, " + ", ".join(f"{c} string" for c in ("street_name", *parts)))
    rows = [made(i) for i in range(60)]
    found = dataset.neighbours(table(rows), table(rows))
    n, moved = _shuffled(spark, found)
    assert n == 3600 and moved < 2000
    assert {r.reason for r in found.select("reason").distinct().collect()} == {"same_house_city"}
    twice = [made(0, city="", house_number="2"), made(0), made(1)]
    got = dataset.neighbours(table(twice), table([made(0), made(0, house_number="9"), made(2, zip_code="1", city="", street_name="S0")]))
    assert sorted((r.canonical_address, r.n_id, r.reason) for r in got.collect()) == [("L0", "A0", "same_house_city"), ("L1", "A0", "same_house_city")]


def test_stage_1_broadcasts_nothing_that_grows(spark):
    """Files of texts and rows look small: no table of them may pass through the driver. A later variant's hit and a repeated reading stay right."""
    from addrloom.operators import reference, stage1
    from addrloom.plans import fixtures, queries as q
    from addrloom.storage import stored

    d = "/root/testdata/sf0.001"
    variants = stored(stage1.plain_variants(fixtures.queries(spark, d).withColumnRenamed("query_id", "raw")))
    out = stage1.resolve(variants, stored(reference.prepare(fixtures.reference(spark, d))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {"original", "drop_type"} <= {r.reason for r in variants.select("reason").distinct().collect()}
    assert out.count() == variants.where("variant = 0").count() == variants.select("raw").distinct().count()
    assert variants.groupBy("raw", *q.PARTS).count().where("count > 1").count() == 0


def test_hits_of_blocking_are_not_shuffled(spark):
    """Sums over the hits of all texts, as hits would give them; far more hits than records are shuffled."""
    from pyspark.sql import functions as F

    from addrloom.operators import blocking, reference as refs
    from addrloom.plans import fixtures, queries as q

    d = "/root/testdata/sf0.001"
    ref = refs.prepare(fixtures.reference(spark, d), F.col("ref_ord")).cache()
    asked = fixtures.queries(spark, d).withColumn("variant", F.lit(0)).withColumnRenamed("query_id", "raw").withColumn("signature", F.expr("concat_ws(' ', nullif(predir, ''), nullif(street_name, ''), nullif(street_type, ''), nullif(suffixdir, ''))")).cache()
    weights = F.create_map(*(x for n, (_, w, _) in refs.BLOCKS.items() for x in (F.lit(n), F.lit(w))))
    hits = refs.block_keys(asked, "raw").distinct().join(refs.postings(ref).drop("block"), "key")
    each = hits.groupBy("raw", "address_id").agg(F.round(F.sum(weights[F.col("block")]), 4).alias("s"))
    expected = {r.raw: (r.n, round(r.t, 2), r.m) for r in each.groupBy("raw").agg(F.count("s").alias("n"), F.sum("s").alias("t"), F.max("s").alias("m")).collect()}
    found = blocking.sums(asked, ref)
    assert {r.raw: (r.candidates, round(r.total, 2), r.best) for r in found.collect()} == expected
    n, moved = _shuffled(spark, q.Q["blocking_weighted_sum"](spark, d))
    assert n == len(expected) and moved < hits.count() / 2


def test_pools_over_several_readings_and_groups(spark, monkeypatch):
    """Weights of all readings add up, ties go by the order of insertion, however small the groups and the sums held at once are."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from addrloom.operators import blocking, ranking, reference as refs, stage1
    from addrloom.plans import fixtures, queries as q

    d = "/root/testdata/sf0.001"
    ref = refs.prepare(fixtures.reference(spark, d), F.col("ref_ord")).cache()
    texts = fixtures.queries(spark, d).where("noise_kind IN (1, 3, 5, 7)").withColumnRenamed("query_id", "raw").withColumn("street_name", F.expr("case when raw like '%3' then '' else street_name end"))
    variants = stage1.plain_variants(texts).cache()
    monkeypatch.setattr(blocking, "SUMS", 500)
    monkeypatch.setattr(blocking.grouped, "__defaults__", (40,))
    found = {(r.raw, r.pool): (r.address_id, r.block_score, r.k, r.ref_ord) for r in ranking.blocked(variants, ref, most=30).collect()}
    weights = F.create_map(*(x for n, (_, w, _) in refs.BLOCKS.items() for x in (F.lit(n), F.lit(w))))
    keys = refs.block_keys(variants.withColumn("signature", ranking._joined("predir", "street_name", "street_type", "suffixdir")), "raw").join(variants.where("street_name <> ''").select("raw").distinct(), "raw")
    summed = keys.join(refs.postings(ref).drop("block"), "key").groupBy("raw", "address_id").agg(F.round(F.sum(weights[F.col("block")]), 6).alias("s"))
    limits = variants.where("variant = 0").select("raw", ranking.candidate_limit().alias("k"))
    w = Window.partitionBy("raw").orderBy(F.desc("s"), "ref_ord", "address_id")
    pools = summed.join(ref.select("address_id", "ref_ord"), "address_id").join(limits, "raw").withColumn("pool", F.row_number().over(w)).where("pool <= 30")
    assert found == {(r.raw, r.pool): (r.address_id, r.s, r.k, r.ref_ord) for r in pools.collect()} and found
    n, moved = _shuffled(spark, q.Q["blocking_topk"](spark, d))
    assert moved < 120 * n / 10  # a text has some 130 rows in its pool


def test_pools_are_scored_where_they_meet(spark, monkeypatch):
    """The candidates are those of whole pools, scored by the plan's columns; pools never leave their groups."""
    from pyspark.sql.window import Window

    from addrloom.operators import blocking, reference as refs
    from addrloom.plans import fixtures

    d = "/root/testdata/sf0.001"
    ref = stored(refs.prepare(fixtures.reference(spark, d), F.col("ref_ord")))
    texts = fixtures.queries(spark, d).withColumnRenamed("query_id", "raw").withColumn("street_name", F.expr("case when raw like '%3' then '' else street_name end"))
    readings = stage1.plain_variants(texts).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("variant", "reason", *PARTS))).alias("stage2"))
    read = stored(texts.select("raw", F.struct(*PARTS).alias("parts")).join(readings, "raw").withColumn("stage2", F.transform("stage2", lambda v: v.dropFields("variant"))))
    monkeypatch.setattr(blocking, "SUMS", 500)
    monkeypatch.setattr(blocking.grouped, "__defaults__", (40,))
    variants = stored(ranking.stage2_variants(read))
    pool = stored(ranking.blocked(variants, ref))
    needed = ("house_number", "street_name", "signature", "city", "state", "zip_code")
    each = pool.join(ranking._rows(ref, needed), "address_id").join(variants.select("raw", *needed), "raw").withColumn("sim", ranking._similar(False)).withColumn("score", ranking.generation_score())
    best = each.groupBy("raw", "address_id", "ref_ord", "block_score", "k").agg(F.max("score").alias("score"))
    w = Window.partitionBy("raw").orderBy(F.desc("score"), F.desc("block_score"), "ref_ord", "address_id")
    expected = best.withColumn("cand_ord", F.row_number().over(w)).where("cand_ord <= k").select("raw", "address_id", "cand_ord", "score", "block_score")
    found = ranking.candidates(read, ref)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()} and expected.count() == found.count() > 1000
    n, moved = _shuffled(spark, blocking.scored(variants, ref, ranking.candidate_limit(), 240, 8, ranking.generation_score))
    assert n == found.count() and moved < pool.count()


def test_first_ranks_are_those_of_all_candidates(spark, monkeypatch):
    """Ranks, margins and features of the first rows are those of all candidates by the plan's columns; texts that hit nothing are ranked too."""
    from addrloom.operators import blocking, reference as refs
    from addrloom.plans import fixtures

    d = "/root/testdata/sf0.001"
    raw = fixtures.reference(spark, d).withColumn("zip_code", F.expr("case when ref_ord % 7 = 0 then '' else zip_code end"))
    ref = stored(refs.prepare(raw, F.col("ref_ord")))
    texts = fixtures.queries(spark, d).withColumnRenamed("query_id", "raw").withColumn("street_name", F.expr("case when raw like '%3' then '' when raw like '%17' then 'QX' else street_name end"))
    texts = texts.withColumns({c: F.expr(f"case when street_name = 'QX' then '' else {c} end") for c in ("house_number", "city", "state", "zip_code")})
    other = lambda reason, **new: F.struct(F.lit(reason).alias("reason"), *((F.lit(new[p]) if p in new else F.col(p)).alias(p) for p in PARTS))
    read = stored(texts.select("raw", F.struct(*PARTS).alias("parts"), F.array(other("original"), other("drop_type", street_type=""), other("x", city="BRAZIL")).alias("stage2")))
    monkeypatch.setattr(blocking, "SUMS", 500)
    monkeypatch.setattr(blocking.grouped, "__defaults__", (40,))
    weights = model().weights
    columns = ("raw", "address_id", "cand_ord", "rank", "n_ranked", "reason", "standardized", "has_house", "has_street", "rank_score", "values")
    every = stored(ranking.ranked(ranking.features(ranking.candidates(read, ref), read, ref), weights))
    found = stored(ranking.first_ranks(read, ref, weights, keep=stored))
    told = lambda df, most: sorted((*r[:-1], tuple(r.values)) for r in df.where(F.col("rank") <= most).select(*columns).collect())
    assert told(found, 5) == told(every, 5) and found.where("raw like '%17'").count() >= 10
    margins = lambda df: {r.raw: r.margin for r in df.where("rank = 1").select("raw", "margin").collect()}
    assert margins(found) == margins(every) and found.count() < every.count() / 2


def _repeated(spark):
    """Texts without their units, thrice under new ids, and other houses of their streets."""
    from addrloom.plans import fixtures

    own = fixtures.queries(spark, "/root/testdata/sf0.001").withColumn("variant", F.lit(0)).withColumn("signature", F.expr("concat_ws(' ', nullif(predir, ''), nullif(street_name, ''), nullif(street_type, ''), nullif(suffixdir, ''))"))
    copies = own.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("copy"))
    return copies.withColumns({"raw": F.concat_ws("-", "query_id", "copy"), "house_number": F.expr("case when copy = 3 then cast(100 + (cast(house_number as int) % 37) * 7 as string) else house_number end")})


def test_sums_of_equal_texts_and_of_a_street_are_found_once(spark, monkeypatch):
    """Equal texts are one, and what they share with their street is one more; sums are those of the hits, however small the groups are."""
    from addrloom.operators import blocking, reference as refs
    from addrloom.plans import fixtures

    ref = stored(refs.prepare(fixtures.reference(spark, "/root/testdata/sf0.001"), F.col("ref_ord")))
    asked = stored(_repeated(spark))
    monkeypatch.setattr(blocking, "CLASSES", 50)
    weights = F.create_map(*(x for n, (_, w, _) in refs.BLOCKS.items() for x in (F.lit(n), F.lit(w))))
    each = refs.block_keys(asked, "raw").distinct().join(refs.postings(ref).drop("block"), "key").groupBy("raw", "address_id").agg(F.round(F.sum(weights[F.col("block")]), 4).alias("s"))
    expected = {r.raw: (r.n, round(r.t, 2), r.m) for r in each.groupBy("raw").agg(F.count("s").alias("n"), F.sum("s").alias("t"), F.max("s").alias("m")).collect()}
    assert {r.raw: (r.candidates, round(r.total, 2), r.best) for r in blocking.sums(asked, ref).collect()} == expected
    classes = blocking._classes(blocking._read(asked), F.lit(0))
    assert classes.count() == asked.select(*blocking._PARTS).distinct().count() < asked.count() / 2
    assert classes.select("street").distinct().count() == asked.select("street_name", "city", "state", "zip_code", "signature").distinct().count() < classes.count()


def test_first_rows_of_equal_texts_are_found_once(spark, monkeypatch):
    """The first rows of pools by sum, then order of insertion, for equal texts and texts of one street; a row is named once a group."""
    from pyspark.sql.window import Window

    from addrloom.operators import blocking, reference as refs
    from addrloom.plans import fixtures

    ref = stored(refs.prepare(fixtures.reference(spark, "/root/testdata/sf0.001"), F.col("ref_ord")))
    asked = stored(_repeated(spark))
    weights = F.create_map(*(x for n, (_, w, _) in refs.BLOCKS.items() for x in (F.lit(n), F.lit(w))))
    each = refs.block_keys(asked, "raw").join(refs.postings(ref).drop("block"), "key").groupBy("raw", "address_id").agg(F.round(F.sum(weights[F.col("block")]), 6).alias("s"))
    w = Window.partitionBy("raw").orderBy(F.desc("s"), "ref_ord", "address_id")
    pools = each.join(ref.select("address_id", "ref_ord"), "address_id").withColumn("pool", F.row_number().over(w)).where("pool <= 10")
    expected = {(r.raw, r.pool): (r.address_id, r.s) for r in pools.collect()}
    monkeypatch.setattr(blocking, "CLASSES", 50)
    monkeypatch.setattr(blocking, "SUMS", 6000)
    found = ranking.blocked(asked, ref, most=10)
    assert {(r.raw, r.pool): (r.address_id, r.block_score) for r in found.collect()} == expected
    n, moved = _shuffled(spark, found.select("raw", "address_id", "pool"))
    assert n == len(expected) and moved < n / 2  # rows are not shuffled for their names


def test_resolution_broadcasts_no_texts_and_no_rows(spark, monkeypatch):
    """No join of the whole plan sends texts, readings or rows through the driver, however small their files look; answers are of every query."""
    from addrloom.operators import blocking, reading, ranking as ranks, reference as refs
    from addrloom.plans import fixtures, resolve as plan
    from addrloom import storage

    d = "/root/testdata/sf0.001"
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    ref = stored(refs.prepare(fixtures.reference(spark, d), F.col("ref_ord")))
    asked = stored(fixtures.queries(spark, d).select("query_id", "query_address"))
    for m in (blocking, stage1, storage):
        monkeypatch.setattr(m, "stored", kept)
    out = plan.resolve(asked, ref, model(), keep=kept)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    small = ("zip_code", "_place", "rowpart", "row_part")  # zips with their places, groups of a place, ranges of numbers
    assert [line for line in sent if not any(f"[{c}#" in line for c in small) and "shiftright" not in line] == [] and len(plans) > 8
    assert out.count() == asked.count()
