"""What the service does: zips, verified addresses, reports, answers, feedback, training runs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from addrloom.functions.vocab import PARTS
from addrloom.operators import evaluate, feedback, reference, service
from addrloom.plans.queries import model
from addrloom.plans.resolve import resolve, resolve_upload
from addrloom.sources import batch, files
from addrloom.storage import numbered, stored
from tests.test_engine import QUERIES, REF

SCHEMA = "address_id string, " + ", ".join(f"{p} string" for p in PARTS)


@pytest.fixture(scope="module")
def ref(spark):
    more = [("REF_0000007", "12", "", "Oak", "ST", "", "", "", "Newton", "MS", "39345"), ("REF_x", "14", "", "Oak", "ST", "", "", "", "Newton", "MS", "39346")]
    return stored(reference.prepare(spark.createDataFrame(REF + more, SCHEMA)))


@pytest.fixture(scope="module")
def answered(spark, ref):
    asked = spark.createDataFrame([(i, q, label, t, text) for i, (q, label, t, text) in enumerate(QUERIES)], "row_ord long, query_id string, label int, true_match_id string, query_address string")
    log = spark.createDataFrame([(1, "correct", "999 missing rd newton ms", "R1")], "row_ord long, feedback_type string, input_address string, predicted_match_id string")
    for c in feedback.COLUMNS:
        log = log if c in log.columns else log.withColumn(c, F.lit(""))
    return stored(resolve(asked, ref, model(), over=stored(feedback.overrides(log, ref)), stages=True))


def test_inferred_zips(spark, ref):
    rows = [("a", "101", "", "CANDACE", "ST", "", "", "", "NEWTON", "MS", ""), ("b", "500", "", "CANDACE", "ST", "", "", "", "NEWTON", "MS", ""), ("c", "500", "", "OAK", "ST", "", "", "", "NEWTON", "MS", ""),
            ("d", "12", "N", "OAK", "ST", "", "", "", "NEWTON", "MS", ""), ("e", "101", "", "CANDACE", "ST", "", "", "", "NEWTON", "", ""), ("f", "1", "", "X", "", "", "", "", "", "", "39001"), ("g", "1", "", "ELM", "ST", "", "", "", "NEWTON", "MS", "")]
    out = {r.address_id: r.inferred_zip for r in service.inferred_zips(spark.createDataFrame(rows, SCHEMA), ref).collect()}
    assert out == {"a": "39345", "b": "39345", "c": "", "d": "39345", "e": "", "f": "39001", "g": ""}


def test_verified_addresses(spark, ref, tmp_path):
    asked = spark.createDataFrame(
        [(1, "101 Candace St, Newton MS 39345"), (2, "500 Candace St, Newton MS"), (3, "500 candace street newton ms 39345"), (4, "7 Elm St, Newton MS"), (5, "9 Elm St, Mobile AL 36601"), (6, "Newton MS 39345"), (7, "77 New Rd, Newton MS 39345"), (8, None)],
        "row_ord long, address string",
    )
    added = stored(service.add_verified(asked, ref, "by  phone"))
    out = {r.row_ord: r for r in added.collect()}
    assert {k: r.status for k, r in out.items()} == {1: "existing", 2: "added", 3: "existing", 4: "failed", 5: "failed", 6: "failed", 7: "added", 8: "failed"}
    assert out[1].address_id == "R1" and out[2].address_id == out[3].address_id == "REF_0000008" and out[7].address_id == "REF_0000009"
    assert (out[2].manual_id, out[7].manual_id, out[2].source_note) == ("MANUAL_MS_000001", "MANUAL_MS_000002", "by phone row:2") and out[2].zip_code == "39345"
    assert "zip" in out[4].error and out[5].error and out[6].error and out[8].error
    said = service.outcome(added)
    assert (said["row_count"], said["added_count"], said["existing_count"], said["failed_count"]) == (8, 2, 2, 4) and len(said["failed"]) == 4
    path = str(tmp_path / "ref")
    spark.createDataFrame([("R1", "x", "0.900")], "address_id string, house_number string, source_quality string").coalesce(1).write.option("header", True).csv(path)
    service.append(service.reference_rows(added), path)
    kept = spark.read.option("header", True).csv(path)
    assert kept.columns == ["address_id", "house_number", "source_quality"] and {tuple(r) for r in kept.collect()} == {("R1", "x", "0.900"), ("REF_0000008", "500", "1.000"), ("REF_0000009", "77", "1.000")}
    assert {r.street_name for r in service.manual_rows(added).collect()} == {"Candace", "New"}
    bigger = service.added_reference(ref, added)
    assert bigger.count() == ref.count() + 2
    again = service.add_verified(asked.where("row_ord IN (2, 7)"), stored(bigger), manual=service.manual_rows(added))
    assert {r.status for r in again.collect()} == {"existing"}
    with pytest.raises(ValueError):
        service.added_reference(bigger, added)
    assert service.next_number(service.manual_rows(added), "MANUAL_MS_") == 3 and service.next_number(ref) == 8
    titles = spark.createDataFrame([("o'neil SAINT-marys 2nd",)], "t string").select(service.titled(F.col("t")).alias("t")).first().t
    assert titles == "O'Neil Saint-Marys 2Nd" == "o'neil SAINT-marys 2nd".title()


def test_metadata():
    meta = {"rows_seen": 5, "sources": [{"source_format": "nad"}], "source_format": "nad"}
    out = service.metadata_with(meta, 2, "m.csv")
    assert out["rows_seen"] == 7 and out["reference_records"] == 2 and out["source_format"] == "nad+address_record" and out["input_paths"] == ["m.csv"] and out["sources"][1]["rows_loaded"] == 2
    assert service.metadata_with(out, 1, "m.csv")["sources"][1]["rows_seen"] == 3 and service.metadata_with(meta, 0, "m") == meta and meta["rows_seen"] == 5


def test_answers_and_variants(answered, ref):
    found = {r.query_id: json.loads(r.answer) for r in service.answers(answered, ref, "query_id").collect()}
    assert found["Q2"]["predicted_match_id"] == "R2" and found["Q2"]["stage1"]["predicted_match_id"] in ("", "R2") and found["Q2"]["top_candidates"][0]["canonical_address"]
    assert found["Q7"]["stage"] == "feedback_override" and found["Q7"]["confidence"] == 1.0 and found["Q9"]["predicted_match_id"] == ""
    each, apart = evaluate.compare_variants(answered.where("query_id != 'Q7'"))
    assert {r.name for r in each.collect()} == {"stage1", "stage2", "combined"} and {r.name for r in apart.collect()} == {"combined_vs_stage1", "combined_vs_stage2"}
    assert {r.name: r.accuracy for r in each.collect()}["combined"] == 1.0


def test_batch_report(spark, ref):
    content = "Record ID,Mailing Address\n7,101 Candace St Newton MS\n\n8,999 missing rd newton ms\n".encode()
    name, book, n = resolve_upload(spark, "My list!.csv", content, ref, model())
    rows = files.sheet_rows(book)
    assert (name, n, rows[0]) == ("My_list_resolved.xlsx", 2, list(service.REPORT)) and [r[:3] for r in rows[1:]] == [["2", "7", "101 Candace St Newton MS"], ["3", "8", "999 missing rd newton ms"]]
    assert rows[1][7] == "R1" and rows[1][6] in ("yes", "no") and len(rows[1]) >= 10 and batch.upload_rows("x.xlsx", book)[0] == list(service.REPORT)
    assert service.report_name("") == "addresses_resolved.xlsx" and service.report_name("../a b.csv") == "a_b_resolved.xlsx"


def test_feedback_rows(spark, answered, ref):
    said = spark.createDataFrame([(1, "102 candace st newton ms", "correct", ""), (6, "999 missing rd newton ms", "correction", "999 Missing Rd, Newton MS 39345")], "row_ord long, query_address string, feedback_type string, correct_address string")
    added = service.add_verified(said.where("correct_address != ''").select("row_ord", F.col("correct_address").alias("address")), ref)
    log = stored(service.feedback_rows(said, answered, added, "2026-01-01T00:00:00"))
    assert set(feedback.COLUMNS) < set(log.columns) and {r.row_ord: r.correct_reference_id for r in log.collect()} == {1: "", 6: "REF_0000008"}
    whole = stored(service.added_reference(ref, stored(added)))
    assert {r.key: r.reference_id for r in feedback.overrides(log, whole).collect()}["999 MISSING RD NEWTON MS"] == "REF_0000008"
    with pytest.raises(ValueError):
        service.feedback_rows(said.withColumn("feedback_type", F.lit("maybe")), answered, None, "x")
    told = service.health(ref, model(), feedback.overrides(log, whole), log, dataset="d")
    assert told["reference_count"] == 10 and told["feedback_row_count"] == 2 and told["dataset"] == "d"


def test_numbers_go_on_across_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    out = numbered(rows, ["k"], "n")
    assert sorted((r.k, r.n) for r in out.collect()) == [(i, i + 1) for i in range(1000)] and numbered(rows.limit(0), ["k"], "n").count() == 0


def test_training_runs_one_at_a_time(tmp_path):
    from addrloom.training_job import TrainingJob

    path, runs = tmp_path / "model.json", []

    def train(target, say):
        runs.append(target)
        say(f"run {len(runs)}")
        time.sleep(0.3)
        if len(runs) == 3:
            raise RuntimeError("no luck")
        with open(target, "w") as f:
            f.write(str(len(runs)))

    job = TrainingJob(train, str(path))
    assert job.status()["state"] == "idle"
    job.request("first")
    while not runs:
        time.sleep(0.01)
    for reason in ("second", "third"):
        job.request(reason)
    job.wait()
    assert len(runs) == 2 and path.read_text() == "2" and job.status()["state"] == "done" and job.status()["reason"] == "third" and job.status()["log"][-1] == "run 2"
    job.request("again")
    job.wait()
    assert job.status()["state"] == "failed" and "no luck" in job.status()["error"] and path.read_text() == "2" and list(tmp_path.iterdir()) == [path]


def test_routes(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from addrloom.http import Service, server

    path, model_path = str(tmp_path / "ref"), tmp_path / "model.json"
    lines = [("R1", "101", "", "Candace", "ST", "", "", "", "Newton", "MS", "39345"), ("R2", "102", "", "Candace", "ST", "", "", "", "Newton", "MS", "39345")]
    spark.createDataFrame(lines, SCHEMA).coalesce(1).write.option("header", True).csv(path)
    model_path.write_text(model().to_json())
    own = server(Service(spark, path, str(model_path), str(tmp_path / "log"), supplement_path=str(tmp_path / "more")))
    threading.Thread(target=own.serve_forever, daemon=True).start()

    def ask(route, data=None, kind="application/json"):
        request = urllib.request.Request(f"http://127.0.0.1:{own.server_address[1]}{route}", data if data is None or isinstance(data, bytes) else json.dumps(data).encode(), {"Content-Type": kind})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        health = json.loads(ask("/api/health")[1])
        assert health.get("reference_count") == 2, health
        assert json.loads(ask("/api/training")[1])["state"] == "idle" and ask("/../secret")[0] == 404
        assert ask("/api/resolve", {"address": " "})[0] == 400 and ask("/api/resolve", b"no json")[0] == 400 and ask("/api/feedback", {"address": "x", "feedback_type": "maybe"})[0] == 400
        assert json.loads(ask("/api/resolve", {"address": "101 candace st newton ms"})[1])["predicted_match_id"] == "R1"
        assert json.loads(ask("/api/add-address", {"address": "500 Candace St, Newton MS"})[1]) == {"already_exists": False, "reference_id": "REF_0000001", "canonical_address": "500 CANDACE ST, NEWTON MS 39345", "reference_count": 3}
        assert json.loads(ask("/api/feedback", {"address": "101 candase st", "feedback_type": "correction", "correct_address": "102 Candace St, Newton MS"})[1])["recorded"]
        assert json.loads(ask("/api/resolve", {"address": "101 Candase ST"})[1])["stage"] == "feedback_override"
        form = b'--b\r\nContent-Disposition: form-data; name="file"; filename="l.csv"\r\n\r\nid,address\n1,101 Candace St Newton MS\n\r\n--b\r\nContent-Disposition: form-data; name="id_column"\r\n\r\nid\r\n--b--\r\n'
        assert json.loads(ask("/api/batch-columns", form, "multipart/form-data; boundary=b")[1])["address_column"] == 1
        book = ask("/api/batch-resolve", form, "multipart/form-data; boundary=b")
        assert book[0] == 200 and files.sheet_rows(book[1])[1][7] == "R1" and ask("/api/batch-columns", form, "text/plain")[0] == 400
    finally:
        own.shutdown()


def test_command_line(spark, tmp_path):
    from addrloom import cli

    (tmp_path / "Newton_addresses.csv").write_text('full_address\n"101 Candace St, Newton, MS 39345"\n"102 Candace St, Newton, MS 39345"\n"101 Candace St, Newton, MS 39345"\n"no number, Newton, MS 39345"\n')
    source = str(tmp_path / "Newton_addresses.csv")
    cli.main(["load", "--inputs", source, "--out", str(tmp_path / "ref")])
    kept = spark.read.option("header", True).csv(str(tmp_path / "ref"))
    assert {(r.address_id, r.house_number, r.city) for r in kept.collect()} == {("REF_0000001", "101", "Newton"), ("REF_0000002", "102", "Newton")}
    meta = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "ref-metadata")).collect()))
    assert (meta["rows_seen"], meta["reference_records"], meta["duplicate_rows"], meta["covered_counties"]) == (4, 2, 1, ["newton"])
    cli.main(["audit", "--inputs", source, "--baseline", "1", "--out", str(tmp_path / "audit.json")])
    told = json.loads((tmp_path / "audit.json").read_text())
    assert told["summary"]["beats_baseline"] and told["summary"]["rows_skipped"] == 1 and told["sources"][0]["city_count"] == 1
    (tmp_path / "up.csv").write_text("address\n500 Candace St Newton MS\n")
    cli.main(["verify", "--reference", str(tmp_path / "ref"), "--upload", str(tmp_path / "up.csv"), "--supplement", str(tmp_path / "more")])
    assert spark.read.option("header", True).csv(str(tmp_path / "ref")).count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "more")).first().address_id == "MANUAL_MS_000001"
    (tmp_path / "model.json").write_text(model().to_json())
    cli.main(["report", "--reference", str(tmp_path / "ref"), "--model", str(tmp_path / "model.json"), "--upload", str(tmp_path / "up.csv"), "--out", str(tmp_path / "out.xlsx")])
    assert files.sheet_rows((tmp_path / "out.xlsx").read_bytes())[1][7] == "REF_0000003"
