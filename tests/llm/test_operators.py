"""Operators of the corpus subpackage in a session: edge cases, and queries against brute force."""

import base64
import collections
import hashlib
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.llm import embed_dedup, huffman, jaccard_join, langid, licenses, mixing, packing, quality_classifier, quality_rules, queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
#: Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns.
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 1), (4, "same text of five words", "en", "b", 1), (5, "same text of five words", "en", "b", 1),
    (5, "same text of five words", "en", "b", 1), (None, "no id here at all", "de", "c", 1), (6, "!!! ... 123", "de", "c", 1), (7, "   \n\t ", None, "c", 1), (8, "été à la plage", "fr", None, 1),
]
CLASHES = ("score", "length", "size", "_size", "rep", "id", "tree", "ids", "sequence_id", "offset", "digest", "_copies", "kept", "words", "lang_pred")


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def tokenizer():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path()


def ids_of(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer()).encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_edge_cases(edge, none):
    out = packing.pack_documents(edge.drop("length", "offset", "sequence_id"), tokenizer()).collect()
    texts = {(r[0], r[1] or "") for r in EDGE}
    assert len({r.doc_id for r in out}) == 9
    assert sum(r.length for r in out if r.doc_id == 3) == len(ids_of([LONG])[0]) + 1
    pieces = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 3)
    assert all(x[2] == 2048 for x in pieces[1:]) and pieces[0][2] <= 2048
    assert [r.length for r in out if r.doc_id == 1] == [1] and len(texts) == 9
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge.select(F.lit(0).alias("length"), "doc_id"), 8, ["doc_id"])


def test_packing_query_by_brute_force(spark, docs):
    out = {(r.doc_id, r.piece): r for r in queries.op1_best_fit_packing(spark, SF).collect()}
    rows = docs.collect()
    total = 0
    for row, ids in zip(rows, ids_of(r.text or "" for r in rows)):
        ids = [*ids, 0]
        total += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [first, *range(first + 2048, len(ids) + 1, 2048)])):
            r = out.pop((row.doc_id, piece))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, crc(ids[a:b]))
    assert not out


def test_license_scan(spark, none):
    mit = next(t for n, t in licenses.LICENSES if n == "MIT")
    rows = [(1, "Copyright (c) 2020 A B\n\n" + mit.upper().replace(",", " ;")), (2, None), (3, ""), (4, mit + " but not quite"), (5, "LICENCED under cc by-nc 4.0"), (5, "Licensed under CC BY-NC 4.0."), (None, "(c) only a copyright line")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = collections.Counter((r.doc_id, r.license_id) for r in out)
    assert found == {(1, "MIT"): 1, (2, None): 1, (3, None): 1, (4, None): 1, (5, "CC-BY-NC-4.0"): 2, (None, None): 1}
    assert licenses.scan(none).count() == 0
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=(("X", "no such text"),)).where("license_id is not null").count() == 0


def test_license_scan_of_entire_licences(spark):
    """Whole licences wrapped anew, titles, reserved rights, and texts on the line of their copyright statement."""
    texts = dict(reversed(licenses.LICENSES))
    mit, isc, bsd = next(t for n, t in licenses.LICENSES if n == "MIT"), texts["ISC"], texts["BSD-3-Clause"]
    whole = dict(reversed(licenses.all_texts()))
    flat = lambda t: " ".join(t.split())
    rows = [
        ("MIT", "Copyright (c) 2020 Jane Doe " + flat(mit)), ("MIT", "MIT License Copyright (c) 2020 Jane Doe " + flat(mit)), ("ISC", "ISC License\n\nCopyright 2020 A B\n\n" + isc), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A B\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", "Copyright (c) 2020, A B. All rights reserved.\n\n" + bsd.replace("above copyright", "above\ncopyright")), ("Apache-2.0", whole["Apache-2.0"]), ("MPL-2.0", "\n".join(textwrap.wrap(whole["MPL-2.0"], 60))),
        *((n, whole[n]) for n in ("GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "CC0-1.0")), (None, "All rights reserved."), (None, "Copyright (c) 2020 Jane Doe"), (None, bsd + " Except on Sundays."), (None, whole["GPL-2.0-only"][:9000]),
    ]
    rows += [("ISC", "Copyright (c) 2020 A\nCopyright 2021 B C\n\n" + "\r\n".join(textwrap.wrap(isc, 78))), ("ISC", "\n".join(textwrap.wrap(isc, 44))), ("ISC", isc.replace("that the above copyright", "that the above\ncopyright")), ("MIT", "© 2020 Jane Doe\n" + mit)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    expected = {i: n for i, (n, _) in enumerate(rows)}
    assert {r.doc_id: r.license_id for r in licenses.scan(docs).collect()} == expected
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.sql(licenses.sql()).fetchall()) == sorted(tuple(r) for r in licenses.scan(docs).collect())


def test_language_edge_cases(spark, edge, none, docs):
    out = langid.identify(edge).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {1, 2, 6, 7}
    assert langid.identify(none).count() == 0
    nothing = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    one = langid.identify(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in one.collect()} == {"en"}


def test_language_is_right_on_the_held_out_fold(spark, docs):
    out = queries.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count() > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in queries.op3_language_id(spark, SF).collect())


def test_warc_edge_cases(spark, tmp_path):
    big = "é" * 3000 + "\r\n\r\n" * 50 + "x\r\n"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "v", "lonely"), (5, "u", "\r\n\r\n"), (6, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("sha", "copy", "chunk", "salt", "data", "refers_to")})
    path = str(tmp_path / "warc")
    warc.write(pages, path, chunk_bytes=100)
    parts = warc.read(spark, path, with_data=True).collect()
    assert max(len(r.data) for r in parts) <= 100
    whole = {}
    for r in sorted(parts, key=lambda r: (str(r.page_id), r.copy, r.chunk)):
        whole[r.page_id, r.copy] = whole.get((r.page_id, r.copy), b"") + r.data
    assert whole[1, 1].decode() == big and whole[None, 1] == b"lonely" and whole[5, 1] == b"\r\n\r\n"
    out = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in parts if r["last"])
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    size = lambda t: len((t or "").encode())
    expected = [(1, "response", None, big), (2, "revisit", 1, big), (2, "revisit", 1, big), (3, "response", None, None), (4, "revisit", 3, ""), (None, "response", None, "lonely"), (5, "response", None, "\r\n\r\n"), (6, "response", None, "WARC/1.1\r\n\r\n")]
    assert out == sorted((str(p), k, f, size(t), sha(t)) for p, k, f, t in expected)
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10).where("payload_bytes < 10").collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_files_are_warc(spark, tmp_path):
    """A warcinfo record a file, records framed by their length, a gzip member a record."""
    import zlib

    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>")], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    kinds = []
    for f in sorted((tmp_path / "w").glob("*.warc.gz")):
        rest = f.read_bytes()
        while rest:
            member = zlib.decompressobj(31)
            raw = member.decompress(rest)
            assert member.eof
            rest = member.unused_data
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
            assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
            kinds.append(fields["WARC-Type"])
    assert sorted(k for k in kinds if k != "warcinfo") == ["response", "revisit"] and kinds[0] == "warcinfo"


def test_warc_payloads_end_in_any_line_breaks(spark, tmp_path):
    """Every payload of up to six CR and LF, alone in a file, last in one, and repeated."""
    from itertools import product

    ends = ["".join(x) for n in range(7) for x in product("\r\n", repeat=n)]
    pages = spark.createDataFrame([(i, "u", "<p>a" * (i % 2) + e) for i, e in enumerate(ends)] + [(1000 + i, "u", ends[9]) for i in range(20)], "page_id long, url string, html string")
    expected = {r.page_id: r.html.encode() for r in pages.collect()}
    for k, parts in enumerate((1, 40)):
        path = str(tmp_path / f"w{k}")
        with_roles = pages.repartition(parts)
        warc.write(with_roles, path, chunk_bytes=4)
        got, kind = collections.defaultdict(bytes), {}
        for r in sorted(warc.read(spark, path, with_data=True).collect(), key=lambda r: (r.page_id, r.chunk)):
            got[r.page_id] += r.data
            kind[r.page_id] = r.record_type
        assert {i: x for i, x in got.items() if kind[i] == "response"} == {i: expected[i] for i in kind if kind[i] == "response"} and got.keys() == expected.keys()
    for e in ("<p>a\r\n", "\r\n", "\r\n\r\n\r\n"):
        one = warc.round_trip(pages.where("page_id = 0").withColumn("html", F.lit(e))).collect()
        assert [(r.payload_bytes, r.record_type) for r in one] == [(len(e), "response")]


def test_mixing(spark, edge, none, docs):
    mixed = mixing.mix(edge.withColumns({c: F.lit("clash") for c in ("_before", "_source", "_class", "_key", "_salt", "_row", "key", "before", "c0", "copies")}))
    out = mixed.collect()
    assert len(out) == len(EDGE) and all(0 <= r._mix.copies <= 3 for r in out)
    assert set(mixed.columns) == {*edge.columns, "_before", "_source", "_class", "_key", "_salt", "_row", "key", "before", "c0", "copies", "_mix"} and all(r._size == r._before == r.c0 == "clash" for r in out)
    targets = {r.source: (r._mix.source_size, r._mix.target) for r in out}
    assert all(t <= 3 * s + 1e-9 for s, t in targets.values())
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values()))
    emitted = mixing.emit(mixed)
    assert emitted.count() == sum(r._mix.copies for r in out) and emitted.columns == mixed.columns[:-1]
    assert mixing.mix(none).count() == 0
    a, b = (sorted((r.doc_id, r._mix.copies) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7))
    assert a == b
    own = F.col("_mix")
    taken = mixing.mix(docs).groupBy("source").agg((F.sum(own.copies * own["size"]) / F.first(own.target)).alias("r"), F.max(own["size"]).alias("m"), F.first(own.target).alias("t")).collect()
    assert all(abs(r.r - 1) * r.t <= 2 * r.m for r in taken)


def test_ranks_with_clashing_names(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "length long, doc_id long").withColumns({c: F.lit("clash") for c in ("_salt", "_row", "_before", "_n")})
    ranked, own = packing.ranked(rows, "length", ["doc_id"])
    got = collections.defaultdict(list)
    for r in ranked.collect():
        got[r.length].append(r[own])
        assert r._salt == r._row == r._before == r._n == "clash"
    assert all(sorted(x) == list(range(len(x))) for x in got.values())


def test_stratified_samples_are_whole(spark):
    from addrloom.llm import common

    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, "few").when(F.col("id") % 7 != 0, "many").alias("key"))
    got = collections.Counter(r.key for r in common.stratified_sample(rows, "key", "id", 500).collect())
    assert got == {"few": 500, "many": 500}
    assert common.stratified_sample(rows.limit(20), "key", "id", 500).count() == rows.limit(20).where("key is not null").count()
    again = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")], "id long, key string")
    assert common.stratified_sample(again, "key", "id", 10).count() == 11
    for n in (10**4, 10**10, 10**15):  # shares of any number of rows
        share = (common.share_limit(n, 300) + 2**63) / 2**64
        assert share * n == pytest.approx(300, rel=0.01)
    assert common.share_limit(300, 300) == 2**63 - 1


def test_quality_rules_edge_cases(edge, none, docs, labels):
    crf = quality_rules.fit(docs, labels)
    out = {r.doc_id: r for r in quality_rules.judge(edge, crf).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and not out[1].kept
    assert out[3].n_words == 30_000 and out[3].n_repeat_words == 30_000 and out[3].base_failed
    assert quality_rules.judge(none, None).count() == 0
    assert quality_rules.fit(none, labels) is None
    kept = quality_rules.judge(docs, crf).join(labels, "doc_id").where("NOT base_failed")
    good, bad = kept.where("quality = 1"), kept.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("NOT kept").count() >= 0.6 * bad.count()


def test_quality_rules_train_on_all_lines(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(quality_rules, "train", lambda found: rows.extend(found))
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} of a long document" for i in range(150))), (2, "buy now\nbuy now")], "doc_id long, text string")
    quality_rules.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert sorted(len(x) for x, _ in rows) == [2, 150] and all(len(x) == len(y) for x, y in rows)


def test_embedding_edge_cases(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v * 3 + 0.05 * rng.standard_normal(8)).tolist()) for i, v in enumerate(base)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("inf")] + [0.0] * 7), (205, []), (206, [1.0]), (207, [2.0]), (None, [1.0] * 8), (0, base[0].tolist()), (300, base[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rep", "v", "bucket", "label", "copies", "id")})
    out = collections.defaultdict(set)
    for r in embed_dedup.dedup(df, block=4).collect():
        out[r.vec_id].add((r.n_links, r.component_id, r.kept))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = collections.Counter(), collections.defaultdict(set)
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    for k, (i, _) in enumerate(good):
        n[i] = max(n[i], len(links[k]))
    assert {i: next(iter(s))[0] for i, s in out.items() if i is not None} == {i: n[i] for i in {r[0] for r in rows} - {None}}
    assert out[100] == {(n[100], 0, False)} and out[None] == {(0, None, True)} and out[201] == {(0, 201, True)}
    assert embed_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_query_by_brute_force(spark):
    """The registered query on its own table, and planted pairs just above the threshold: recall of at least 0.99, no link below."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table if r.embedding is not None]
    for k in range(400):
        x, y = (embed_dedup.unit(rng.standard_normal((1, 64)))[0] for _ in range(2))
        y = embed_dedup.unit((y - (x @ y) * x)[None])[0]
        c = rng.uniform(0.9, 0.93)
        rows += [(100_000 + 2 * k, x.tolist()), (100_001 + 2 * k, (c * x + (1 - c * c) ** 0.5 * y).tolist())]
    cosines = embed_dedup.unit(np.array([v for _, v in rows]))
    cosines = cosines @ cosines.T
    near = cosines >= 0.9
    np.fill_diagonal(near, False)
    for block in (4000, 60):  # all in one bucket; many signs a bucket
        got = {r.vec_id: r for r in embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
        found = np.array([got[i].n_links for i, _ in rows])
        assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum()
    query = {r.vec_id: r.n_links for r in queries.op7_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    own = near[: len(table), : len(table)].sum(axis=1)
    assert [query[i] for i, _ in rows[: len(table)]] == own.tolist()


def brute_links(rows):
    """n_links and class of (id, text) rows by whole comparison."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for shingle in x:
            holders[shingle].append(i)
    common = collections.Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            n[a] += 1
            n[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return n, [find(i) for i in range(len(rows))]


def test_jaccard_join_by_brute_force(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    words = " ".join(f"w{i}" for i in range(60)).split()
    for k in range(40):  # a group of near copies that needs several cells
        rows.append((10_000 + k, " ".join([*words[:58], f"x{k}", f"y{k}"]) if k % 3 else " ".join(words)))
    n, root = brute_links(rows)
    got = {r.doc_id: r for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert [got[i].n_links for i, _ in rows] == n
    assert [got[i].class_id for i, _ in rows] == [rows[k][0] for k in root]


def test_jaccard_query_by_brute_force(spark):
    """The registered query on its own table; links at and just above the threshold are planted besides."""
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    n, root = brute_links(rows)
    got = {r.doc_id: r for r in queries.op10_ngram_jaccard_join(spark, sf).collect()}
    assert [got[i].n_links for i, _ in rows] == n and [got[i].class_id for i, _ in rows] == [rows[k][0] for k in root]
    planted = []
    for k in range(300):  # up to 11 of 104 words changed at the end: similarity 1 to 89 / 111, about 0.8
        words = [f"k{k}w{i}" for i in range(104)]
        planted += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 104 - k % 12] + [f"k{k}x{i}" for i in range(k % 12)]))]
    n, _ = brute_links(planted)
    got = {r.doc_id: r.n_links for r in jaccard_join.join(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    assert all(got[i] <= m for (i, _), m in zip(planted, n)) and sum(got.values()) >= 0.99 * sum(n)


def test_jaccard_edge_cases(edge, none):
    out = collections.defaultdict(set)
    for r in jaccard_join.join(edge).collect():
        out[r.doc_id].add((r.class_id, r.n_links, r.kept))
    assert out[1] == {(1, 0, True)} and out[2] == {(2, 0, True)} and out[7] == {(7, 0, True)} and out[None] == {(None, 0, True)}
    assert out[4] == {(4, 2, True)} and out[5] == {(4, 2, False)}
    assert jaccard_join.join(none).count() == 0


def test_components(spark):
    from addrloom.llm.components import components

    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files_edge_cases(spark, edge, none, tmp_path):
    out = huffman.round_trip(edge, tokenizer()).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    at = 0
    texts = {i: t or "" for i, t, *_ in EDGE}
    for r in out:
        ids = [*ids_of([texts[r.doc_id]])[0], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert huffman.round_trip(none, tokenizer()).count() == 0
    stored = spark.createDataFrame([(i, b"\x02" + np.full(5, i, "<u2").tobytes()) for i in range(50)], "doc_id long, ids binary")
    huffman.write(stored, str(tmp_path / "h"), block_ids=20)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman.read(spark, str(tmp_path / "h")).collect()} == {i: [i] * 5 for i in range(50)}


def test_token_query_by_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op8_token_output(spark, SF).collect()}
    rows, at = sorted(docs.collect(), key=lambda r: r.doc_id), 0
    for row, ids in zip(rows, ids_of(r.text or "" for r in rows)):
        ids = [*ids, 2]
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_quality_classifier(spark, edge, none, docs, labels):
    out = queries.op9_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.9
    few = labels.sparkSession.createDataFrame([(3, 0), (4, 1), (None, 1), (8, None), (8, 1)], "doc_id long, quality int")
    scored = quality_classifier.classify(edge.drop("score"), few).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert {r.score for r in quality_classifier.classify(edge.drop("score"), few.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none.drop("score"), few).count() == 0


def test_queries_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        own = queries.QUERIES[name](spark, SF).toPandas()
        columns = sorted(own.columns)
        other = con.sql(sql).df()[columns].sort_values(columns).reset_index(drop=True)
        own = own[columns].sort_values(columns).reset_index(drop=True)
        assert own.astype(str).equals(other.astype(own.dtypes.to_dict()).astype(str)), name
