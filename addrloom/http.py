"""The service's routes over a Spark session: JSON in and out, uploads up to 32 MB, 400 on bad input and 500 on other errors."""

from __future__ import annotations

import json
import threading
import time
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import feedback, ranking, reading, reference, service, training
from .plans.resolve import resolve, resolve_upload
from .sources import batch, files
from .storage import stored
from .streaming import feedback as log_stream
from .training_job import TrainingJob

MOST_UPLOAD_BYTES = 32 << 20
_BOOK = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


class Service:
    """One reference, one model, one feedback log. Reads run side by side; what changes the reference waits its turn."""

    def __init__(self, spark: SparkSession, reference_path: str, model_path: str, log_path: str, queries_path: str | None = None, supplement_path: str | None = None):
        self.spark, self.reference_path, self.model_path, self.log_path, self.supplement_path, self.queries_path = spark, reference_path, model_path, log_path, supplement_path, queries_path
        self.lock = threading.RLock()
        self.ref = stored(reference.prepare(files.read_csv(spark, reference_path), F.col("row_ord")))
        self.over: DataFrame | None = None
        self.job = TrainingJob(self._train, model_path, self._load_model)
        self._load_model()
        self._load_log()

    def _load_model(self) -> None:
        with open(self.model_path, encoding="utf-8") as f:
            self.model = ranking.Model.from_json(f.read())

    def _log(self) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.log_path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(log_stream.SCHEMA).parquet(self.log_path) if there else None

    def _load_log(self) -> None:
        log = self._log()
        self.over = None if log is None else stored(feedback.overrides(log, self.ref))

    def _train(self, path: str, say) -> None:
        if self.queries_path is None:
            raise ValueError("there are no labelled queries to train on")
        q = files.read_csv(self.spark, self.queries_path).where("split = 'train'").select("query_id", F.expr("coalesce(try_cast(label AS int), 0)").alias("label"), "true_match_id", "query_address")
        log = self._log()
        if log is not None:
            own = feedback.labelled_queries(log, self.ref)[0]
            q = q.unionByName(own.select(F.format_string("AL_%07d", "row_ord").alias("query_id"), "label", "true_match_id", "query_address"))
        q = stored(q)
        say(f"{q.count()} queries")
        read = reading.read_all(q.select(F.col("query_address").alias("raw")), self.ref, reference.places(self.ref), stored)
        made = training.fit(q, read, self.ref, stored)
        made.review = self.model.review
        with open(path, "w", encoding="utf-8") as f:
            f.write(made.to_json())
        say(f"accept {made.accept}")

    def resolved(self, texts: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(texts)), "row_ord long, query_address string")
        return stored(resolve(asked, self.ref, self.model, over=self.over, stages=True))

    def resolve(self, text: str) -> dict:
        return json.loads(service.answers(self.resolved([_needed(text, "address")]), self.ref, "row_ord").first().answer)

    def add(self, rows: list[tuple[int, str]], note: str) -> dict:
        with self.lock:
            asked = self.spark.createDataFrame(rows, "row_ord long, address string")
            supplement = files.read_csv(self.spark, self.supplement_path) if self.supplement_path and self._exists(self.supplement_path) else None
            added = stored(service.add_verified(asked, self.ref, note, supplement))
            if added.where("status = 'added'").limit(1).count():
                service.append(service.reference_rows(added), self.reference_path)
                if self.supplement_path:
                    service.append(service.manual_rows(added), self.supplement_path)
                self.ref = stored(service.added_reference(self.ref, added))
            self.last_added = added
            return {**service.outcome(added), "reference_count": self.ref.count()}

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def add_one(self, text: str, note: str) -> dict:
        out = self.add([(1, _needed(text, "address"))], note)
        if out["failed"]:
            raise ValueError(out["failed"][0]["error"])
        row = (out["added"] or out["existing"])[0]
        return {"already_exists": not out["added"], "reference_id": row["address_id"], "canonical_address": row["canonical_address"], "reference_count": out["reference_count"]}

    def feedback(self, text: str, kind: str, correct: str) -> dict:
        with self.lock:
            given, added = self.resolved([_needed(text, "address")]), None
            if kind == "correction":
                self.add_one(correct, "feedback")
                added = self.last_added.withColumn("row_ord", F.lit(0).cast("long"))
            said = self.spark.createDataFrame([(0, text, kind, correct or "")], "row_ord long, query_address string, feedback_type string, correct_address string")
            rows = service.feedback_rows(said, given, added, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
            log = self._log()
            last = -1 if log is None else log.agg(F.coalesce(F.max("row_ord"), F.lit(-1))).first()[0]
            log_stream.append(rows.withColumn("row_ord", F.lit(last + 1).cast("long")), self.log_path)
            self._load_log()
        return {"recorded": True, "training": self.job.request(kind) if self.queries_path else self.job.status()}

    def health(self) -> dict:
        return service.health(self.ref, self.model, self.over, self._log(), training_state=self.job.status()["state"], reference_path=self.reference_path, model_path=self.model_path)


def _needed(text, name: str) -> str:
    if not isinstance(text, str) or not text.strip():
        raise ValueError(f"{name} is needed")
    return text.strip()


def form(content_type: str, body: bytes) -> dict[str, tuple[str, bytes]]:
    """Fields of a multipart form: name -> (file name, content)."""
    if not content_type.startswith("multipart/form-data"):
        raise ValueError("send the file as multipart/form-data")
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    return {p.get_param("name", header="content-disposition"): (p.get_filename() or "", p.get_payload(decode=True) or b"") for p in message.iter_parts()}


class _Handler(BaseHTTPRequestHandler):
    service: Service

    def log_message(self, *args) -> None:
        pass

    def _send(self, status: int, body: bytes, kind: str, **headers: str) -> None:
        self.send_response(status)
        for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body)

    def _json(self, found, status: int = 200) -> None:
        self._send(status, json.dumps(found).encode(), "application/json; charset=utf-8")

    def _body(self) -> bytes:
        n = int(self.headers.get("Content-Length") or 0)
        if not 0 < n <= MOST_UPLOAD_BYTES:
            raise ValueError("the body is empty or above 32 MB")
        return self.rfile.read(n)

    def _fields(self) -> dict:
        found = json.loads(self._body())
        if not isinstance(found, dict):
            raise ValueError("send a JSON object")
        return found

    def _upload(self) -> tuple[str, bytes, dict[str, str]]:
        fields = form(self.headers.get("Content-Type", ""), self._body())
        if not fields.get("file", ("", b""))[1]:
            raise ValueError("file is needed")
        return *fields["file"], {k: v.decode("utf-8", "replace").strip() for k, (_, v) in fields.items() if k != "file"}

    def _run(self, routes: dict) -> None:
        try:
            route = routes.get(self.path.split("?")[0])
            if route is None:
                self._json({"error": "no such route"}, 404)
            else:
                route()
        except (ValueError, UnicodeDecodeError) as e:
            self._json({"error": str(e)}, 400)
        except Exception as e:  # the server goes on
            self._json({"error": f"{type(e).__name__}: {e}"}, 500)

    def do_GET(self) -> None:
        s = self.service
        self._run({"/": lambda: self._send(200, b"<!doctype html><title>addrloom</title><p>POST /api/resolve {&quot;address&quot;: ...}", "text/html; charset=utf-8"), "/api/health": lambda: self._json(s.health()), "/api/training": lambda: self._json(s.job.status())})

    def do_POST(self) -> None:
        self._run({
            "/api/resolve": self._resolve, "/api/add-address": self._add, "/api/add-addresses": self._import, "/api/feedback": self._feedback, "/api/training/start": lambda: self._json(self.service.job.request("manual")),
            "/api/batch-columns": self._columns, "/api/batch-resolve": self._batch,
        })

    def _resolve(self) -> None:
        self._json(self.service.resolve(self._fields().get("address")))

    def _add(self) -> None:
        f = self._fields()
        self._json(self.service.add_one(f.get("address"), str(f.get("note", ""))))

    def _feedback(self) -> None:
        f = self._fields()
        self._json(self.service.feedback(f.get("address"), f.get("feedback_type"), f.get("correct_address", "")))

    def _import(self) -> None:
        name, content, f = self._upload()
        rows = batch.addresses(batch.upload_rows(name, content), f.get("address_column", ""))
        self._json(self.service.add([(k, text) for k, _, text in rows], f"{f.get('note', '')} import:{name or 'uploaded file'}".strip()))

    def _columns(self) -> None:
        name, content, _ = self._upload()
        self._json(batch.inspect(batch.upload_rows(name, content)))

    def _batch(self) -> None:
        name, content, f = self._upload()
        s = self.service
        book_name, book, _ = resolve_upload(s.spark, name, content, s.ref, s.model, s.over, f.get("address_column", ""), f.get("id_column", ""))
        self._send(200, book, _BOOK, Content_Disposition=f'attachment; filename="{book_name}"')


def server(own: Service, port: int = 0) -> ThreadingHTTPServer:
    """A server of the routes on this machine; port 0 takes a free one."""
    return ThreadingHTTPServer(("127.0.0.1", port), type("Handler", (_Handler,), {"service": own}))
