"""Command line: build datasets and references, train, predict, audit, serve a batch.

Every command is a Spark job; the number of parallel tasks is the session's.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset, evaluate, feedback, quality, ranking, reading, reference, service, training
from .plans.resolve import resolve, resolve_upload
from .sources import batch, downloads, files, formats, manifest
from .storage import numbered, stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="addrloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, **flags) -> None:
        own = sub.add_parser(name, help=text)
        for flag, how in flags.items():
            own.add_argument("--" + flag.replace("_", "-"), **how)

    need, many = {"required": True}, {"action": "append", "default": []}
    command("load", "sources to one reference table", inputs=many, manifest=many, format={"default": "auto"}, state={"default": "MS"}, limit={"type": int}, out=need, all_counties={"action": "store_true"}, enrich={"action": "store_true"})
    command("audit", "what each source adds", inputs=many, manifest=many, format={"default": "auto"}, state={"default": "MS"}, baseline={"type": int}, out=need)
    command("download", "public sources to a folder", kind={"required": True, "choices": ["archives", "layers", "points", "parcels"]}, folder=need, configs={}, refresh={"action": "store_true"}, statewide={"action": "store_true"}, limit={"type": int})
    command("generate", "a labelled noisy dataset", reference=need, size={"type": int, "default": 5000}, no_match={"type": float, "default": 0.5}, adversarial={"type": float, "default": 0.5}, per={"type": int, "default": 3}, seed={"type": int, "default": 4633}, out=need)
    command("train", "a ranker from labelled queries", reference=need, queries=need, feedback={}, model=need)
    command("predict", "answers for queries", reference=need, queries=need, model=need, extra_reference={}, feedback={}, limit={"type": int}, fast={"action": "store_true"}, compare={"action": "store_true"}, out=need)
    command("report", "a workbook of answers for an uploaded list", reference=need, model=need, upload=need, address_column={"default": ""}, id_column={"default": ""}, out={})
    command("verify", "add an uploaded list of verified addresses", reference=need, upload=need, address_column={"default": ""}, note={"default": ""}, supplement={})
    command("serve", "the service's routes", reference=need, model=need, log=need, queries={}, supplement={}, port={"type": int, "default": 8000})
    return p


def _tables(spark: SparkSession, args) -> tuple[list[tuple[DataFrame, str]], list[str]]:
    specs = [manifest.Source(p, p, args.format) for p in args.inputs] + [s for m in args.manifest for s in manifest.read_manifest(m)]
    if not specs:
        raise SystemExit("no sources given")
    found = [p for s in specs for p in files.discover([s.path])]
    return [(files.columns(files.read_files(spark, [s.path])), s.format) for s in specs], found


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return files.read_csv(spark, path)


def load(spark: SparkSession, args) -> None:
    tables, found = _tables(spark, args)
    if args.all_counties and (missing := manifest.missing_counties(found)):
        raise SystemExit("no source covers: " + ", ".join(missing))
    order = ["source_ord", "file_ord", "row_ord"]
    records, stats = (stored(x) for x in formats.load(tables, args.state, limit=args.limit))
    rows = records.withColumn("_added", F.lit(0))
    if args.enrich:
        rows = rows.unionByName(quality.zip_city_enrichment(records, order).withColumn("_added", F.lit(1)), allowMissingColumns=True)
    # ids follow the order of the sources
    out = numbered(rows, ["_added", *order], "_k").select(F.format_string("REF_%07d", "_k").alias("address_id"), *reference.PARTS, "canonical_address", F.format_string("%.3f", "source_quality").alias("source_quality"))
    out.write.mode("overwrite").option("header", True).csv(args.out)
    audited = [r.asDict(recursive=True) for r in quality.audit(records, stats).orderBy("source_ord").collect()]  # a row a source
    meta = quality.audit_summary(audited, manifest.counties_in(found), manifest.missing_counties(found)) | {"reference_records": spark.read.option("header", True).csv(args.out).count(), "sources": audited, "input_paths": found}
    spark.createDataFrame([(json.dumps(meta, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out.rstrip('/')}-metadata")


def audit(spark: SparkSession, args) -> None:
    tables, found = _tables(spark, args)
    records, stats = (stored(x) for x in formats.load(tables, args.state))
    rows = [r.asDict(recursive=True) for r in quality.audit(records, stats).orderBy("source_ord").collect()]  # a row a source
    report = {"sources": rows, "summary": quality.audit_summary(rows, manifest.counties_in(found), manifest.missing_counties(found), args.baseline)}
    with open(args.out, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)


def download(spark: SparkSession, args) -> None:
    made = {
        "archives": lambda: downloads.archives(args.folder), "points": lambda: downloads.point_addresses(args.folder), "parcels": lambda: downloads.parcels(spark, args.folder, limit=args.limit, refresh=args.refresh),
        "layers": lambda: downloads.layers(spark, args.folder, args.configs or f"{args.folder}/configs", args.refresh, args.refresh, args.statewide),
    }[args.kind]()
    print(json.dumps(made, indent=2))


def generate(spark: SparkSession, args) -> None:
    pool = _csv(spark, args.reference)
    made = {k: stored(v) for k, v in dataset.build(pool, args.size, round(args.size * args.no_match * (1 - args.adversarial)), round(args.size * args.no_match * args.adversarial), args.per, args.seed).items()}
    broken = [r.check for r in dataset.problems(made).where("violations > 0").collect()]
    if broken:
        raise SystemExit("the dataset breaks: " + ", ".join(broken))
    dataset.export(made, args.out, vars(args))


def _queries(spark: SparkSession, path: str) -> DataFrame:
    q = _csv(spark, path)
    return q.withColumn("label", F.coalesce(F.expr("try_cast(label AS int)"), F.lit(0)) if "label" in q.columns else F.lit(0))


def train(spark: SparkSession, args) -> None:
    ref = stored(reference.prepare(_csv(spark, args.reference)))
    q = _queries(spark, args.queries).where("split = 'train'").select("query_id", "label", "true_match_id", "query_address")
    if args.feedback:
        own = feedback.labelled_queries(_csv(spark, args.feedback), ref)[0]
        q = q.unionByName(own.select(F.format_string("AL_%07d", "row_ord").alias("query_id"), "label", "true_match_id", "query_address"))
    q = stored(q)
    model = training.fit(q, reading.read_all(q.select(F.col("query_address").alias("raw")), ref, reference.places(ref), stored), ref, stored)
    held = stored(_queries(spark, args.queries).where("split = 'validation'"))
    if held.limit(1).count():
        model.review = evaluate.review_threshold(resolve(held, ref, model)).first().threshold
    with open(args.model, "w", encoding="utf-8") as f:
        f.write(model.to_json())


def predict(spark: SparkSession, args) -> None:
    ref = reference.prepare(_csv(spark, args.reference), F.struct(F.lit(0).alias("t"), F.col("row_ord").alias("k")))
    if args.extra_reference:
        ref = reference.augment(ref, reference.prepare(_csv(spark, args.extra_reference), F.struct(F.lit(1).alias("t"), F.col("row_ord").alias("k"))))[0]
    ref = stored(ref)
    with open(args.model, encoding="utf-8") as f:
        model = ranking.Model.from_json(f.read())
    q = _queries(spark, args.queries)
    q = q.orderBy("row_ord").limit(args.limit) if args.limit else q
    over = stored(feedback.overrides(_csv(spark, args.feedback), ref)) if args.feedback else None
    out = stored(resolve(q, ref, model, both=args.compare, over=over, stages=args.compare))
    evaluate.write_predictions(out.drop("stage1", "stage2"), f"{args.out}/predictions")
    if args.compare:
        each, apart = evaluate.compare_variants(out)
        each.write.mode("overwrite").json(f"{args.out}/evaluation")
        apart.write.mode("overwrite").json(f"{args.out}/comparison")
        for name, rows in list(evaluate.stage_variants(out).items())[:2]:
            empty = F.array().cast("array<struct<reference_id:string,score:double>>")
            evaluate.write_predictions(rows.join(q.select("query_id", "query_address"), "query_id").withColumn("top_candidates", empty), f"{args.out}/predictions_{name}")
    elif not args.fast:
        evaluate.metrics(out, "combined").write.mode("overwrite").json(f"{args.out}/evaluation")


def report(spark: SparkSession, args) -> None:
    """An uploaded list to a workbook."""
    ref = stored(reference.prepare(_csv(spark, args.reference), F.col("row_ord")))
    with open(args.model, encoding="utf-8") as f:
        model = ranking.Model.from_json(f.read())
    with open(args.upload, "rb") as f:
        name, book, _ = resolve_upload(spark, args.upload, f.read(), ref, model, address=args.address_column, id_=args.id_column)
    with open(args.out or name, "wb") as f:
        f.write(book)


def verify(spark: SparkSession, args) -> None:
    """Add an uploaded list of verified addresses to the reference and the supplement."""
    ref = stored(reference.prepare(_csv(spark, args.reference), F.col("row_ord")))
    with open(args.upload, "rb") as f:
        rows = batch.addresses(batch.upload_rows(args.upload, f.read()), args.address_column)
    asked = spark.createDataFrame([(k, text) for k, _, text in rows], "row_ord long, address string")
    added = stored(service.add_verified(asked, ref, args.note))
    service.append(service.reference_rows(added), args.reference)
    if args.supplement:
        service.append(service.manual_rows(added), args.supplement)
    print(json.dumps(service.outcome(added), indent=2))


def serve(spark: SparkSession, args) -> None:
    from .http import Service, server

    server(Service(spark, args.reference, args.model, args.log, args.queries, args.supplement), args.port).serve_forever()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"addrloom {args.command}").getOrCreate()
    globals()[args.command](spark, args)


if __name__ == "__main__":
    main()
