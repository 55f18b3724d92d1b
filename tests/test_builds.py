"""Permutations, alias draws, catalogues, manifests, exports, pages and replies against plain Python."""

import datetime
import decimal
import gzip
import json
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import alias, draws, permute
from ledgerspark.operators import catalogue, labels, manifest, pages, replies
from ledgerspark.operators.selection import Selection, UnsupportedConstraint
from ledgerspark.plans import extensions
from ledgerspark.sources import export
from ledgerspark.sources.shards import Sink

D = decimal.Decimal

# -- permutations and draws


def test_every_value_once(spark):
    sizes = [1, 2, 3, 5, 16, 17, 97, 360, 450, 1152, 3200]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    got = rows.select("size", "n", permute.permuted(F.col("n"), F.col("size"), permute.round_keys("run", "test", F.col("size"))).alias("p")).collect()
    for s in sizes:
        place = [r.p for r in sorted((r for r in got if r.size == s), key=lambda r: r.n)]
        assert sorted(place) == list(range(s))
        assert s < 97 or place != list(range(s))


def test_keys_give_other_orders_and_ranges_are_held(spark):
    one = lambda k: [r[0] for r in spark.range(500).select(permute.permuted(F.col("id"), F.lit(500).cast("long"), permute.round_keys("run", k, F.lit(1)))).collect()]
    assert one("a") != one("b") and one("a") == one("a")
    with pytest.raises(Exception, match="asked of"):
        spark.range(1).select(permute.permuted(F.lit(7).cast("long"), F.lit(7).cast("long"), permute.round_keys("run", "x"))).collect()


@pytest.mark.parametrize("weights", [[1], [0, 1], [5, 5, 5], [1, 2, 3, 94], [50_000 * 100, *[100_000] * 5, *[195_000] * 100], [0, 0, 7, 0], [3**k for k in range(30)]])
def test_alias_tables_are_exact(weights):
    n, total, held = len(weights), sum(weights), [0] * len(weights)
    for i, (keep, other) in enumerate(alias.alias_table(weights)):
        assert 0 <= keep <= total
        held[i] += keep
        held[other] += total - keep
    assert held == [n * w for w in weights]


def test_bad_weights():
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            alias.alias_table(bad)


def test_roster_shares(spark):
    roster = catalogue.seed_roster(spark)
    assert roster.count() == 106 and roster.where("company_id = 'anchor'").first().weight == 50_000 * 100
    n = 60_000
    got = {r.company_id: r.n for r in alias.drawn(spark.range(n), "t", F.col("id"), roster, "company_id", "weight").groupBy("company_id").agg(F.count("*").alias("n")).collect()}
    for r in roster.collect():
        p = r.weight / 25_000_000
        assert abs(got.get(r.company_id, 0) - n * p) < 6 * math.sqrt(n * p * (1 - p)) + 1
    plan = alias.drawn(spark.range(10), "t", F.col("id"), roster, "company_id", "weight")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_over_many_keys(spark):
    rng = random.Random(3)
    weights = [(k, rng.choice([0, 1, 5, 10_000])) for k in rng.sample(range(100_000), 3_000)]
    frame = spark.createDataFrame(weights, "k long, w long")
    got = {r.k: (r.lo, r.hi, r.total) for r in draws.cumulative(frame, "k", "w").collect()}
    at, want = 0, {}
    for k, w in sorted(weights):
        want[k] = (at, at + w, sum(x for _, x in weights))
        at += w
    assert got == want
    points = spark.range(2_000).withColumn("p", (F.col("id") * 7_919) % at)
    drawn = {r.id: r.k for r in draws.weighted_draw(points.select("id"), F.col("id") * 7_919, draws.cumulative(frame, "k", "w"), at).collect()}
    assert all(want[k][0] <= i * 7_919 % at < want[k][1] for i, k in drawn.items()) and len(drawn) == 2_000


# -- catalogue


def test_space_and_families(spark):
    families = {r.family: r.combinations for r in catalogue.shelves(catalogue.vocabulary(spark)).collect()}
    assert len(families) == 18 and sum(families.values()) == 23_493 and families == {f: math.prod(s) for f, s in catalogue.SIZES.items()}


def test_whole_families_without_repeats(spark):
    firms = catalogue.companies(spark, 0, 40)
    narrow = firms.where(F.col("product_category").isin("software subscriptions", "telecom services", "AI platform usage"))
    made = catalogue.products(spark, narrow, 360).cache()
    assert made.groupBy("company_no").agg(F.countDistinct("combination").alias("n"), F.countDistinct("description").alias("d"), F.countDistinct("family").alias("f")).where("n <> 360 or d <> 360 or f <> 1").count() == 0
    assert made.groupBy("company_no").count().count() == narrow.count()
    assert made.where("price_low <= 0 or price_high < price_low").count() == 0
    with pytest.raises(Exception, match="asked of"):
        catalogue.products(spark, narrow, 361).collect()
    with pytest.raises(ValueError):
        catalogue.products(spark, firms, 5_000)
    plan = made._jdf.queryExecution().optimizedPlan().toString() + catalogue.products(spark, narrow, 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian|Window", plan)


def test_own_words(spark):
    words = [("telecom services", s, i, f"{s}{i}", None if s == "pack" else f"fr-{s}{i}") for s in catalogue.SLOTS for i in range(3)]
    firms = catalogue.companies(spark, 0, 10).where("business_type = 'telecom'")
    got = catalogue.products(spark, firms, 81, catalogue.vocabulary(spark, words)).collect()
    assert len({r.description for r in got}) == 81
    assert all(re.fullmatch(r"material\d form\d, variant\d \(pack\d\)", r.description) and re.fullmatch(r"fr-form\d fr-material\d, fr-variant\d \(pack\d\)", r.description_fr) for r in got)
    assert {r.slot: r.missing for r in catalogue.untranslated(catalogue.vocabulary(spark, words)).collect()} == {"pack": "pack0|pack1|pack2"}


def test_any_range_gives_the_same_companies(spark):
    whole = {tuple(r) for r in catalogue.companies(spark, 0, 300).collect()}
    assert {tuple(r) for r in catalogue.companies(spark, 100, 200).collect()} == {r for r in whole if 100 <= r[0] < 200}
    by_type = {}
    for r in catalogue.companies(spark, 0, 1_500).collect():
        by_type.setdefault(r.business_type, set()).add(r.product_category)
        assert r.product_category in catalogue.FAMILIES[r.business_type] and r.niche.startswith(r.product_category)
    assert len(by_type["retail"]) == 9 and len(by_type["telecom"]) == 1


# -- manifests


def written(spark, folder, texts, unit=3):
    """A run's documents as frames: what a manifest lists and the blobs themselves."""
    blobs = spark.createDataFrame([(f"documents/{i:04d}.txt", t, i // unit) for i, t in enumerate(texts)], "key string, content string, unit_index long")
    listed = blobs.select("unit_index", "key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    shards = listed.groupBy("unit_index").agg(F.count("*").alias("rows")).select("unit_index", F.lit("invoices").alias("table"), F.format_string("golden/invoices/unit-%06d.jsonl.gz", "unit_index").alias("key"), F.sha2(F.col("unit_index").cast("string"), 256).alias("sha256"), F.lit(10).alias("bytes"), "rows")
    return blobs, listed, shards


def test_manifest(spark, tmp_path):
    texts = [f"text {i}" for i in range(40)]
    blobs, listed, shards = written(spark, tmp_path, texts)
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        manifest.read_manifest(spark, path)
    root = manifest.write_manifest(path, "r1", listed, shards, 14, fan=3, pack="invoice")
    first = (tmp_path / "run/manifest.json").read_bytes()
    assert root["total_documents"] == 40 and root["table_rows"] == {"invoices": 40} and root["levels"] == 4 and root["pack"] == "invoice"
    assert manifest.is_complete(spark, path) and manifest.read_manifest(spark, path) == root
    assert manifest.document_keys(spark, path).count() == 40
    manifest.write_manifest(path, "r1", listed.repartition(5), shards.repartition(3), 14, fan=3, pack="invoice")
    assert (tmp_path / "run/manifest.json").read_bytes() == first
    assert manifest.verify(spark, path)["ok"]
    docs = blobs.select("key", "content").unionByName(shards.select("key", F.col("unit_index").cast("string").alias("content")))
    deep = manifest.verify(spark, path, docs)
    assert deep["ok"] and deep["blobs_checked"] == 54
    # a document that changes or goes is named by the deep check only
    broken = docs.where("key <> 'documents/0003.txt'").withColumn("content", F.when(F.col("key") == "documents/0008.txt", "other").otherwise(F.col("content")))
    found = manifest.verify(spark, path, broken)
    assert not found["ok"] and found["part_problems"].count() == 0
    assert {tuple(r) for r in found["blob_problems"].collect()} == {(1, "documents/0003.txt", "missing blob"), (2, "documents/0008.txt", "altered blob")}
    # an altered part is named by the shallow one
    kept = spark.read.parquet(f"{path}/manifest/entries").withColumn("bytes", F.when(F.col("key") == "documents/0030.txt", F.lit(1)).otherwise(F.col("bytes"))).collect()
    spark.createDataFrame(kept, "unit_index long, kind string, table string, key string, sha256 string, bytes long, rows long").write.mode("overwrite").parquet(f"{path}/manifest/entries")
    shallow = manifest.verify(spark, path)
    assert not shallow["ok"] and not shallow["digest_matches"] and [tuple(r) for r in shallow["part_problems"].collect()] == [(10, "altered part")]


def test_gaps_are_refused(spark, tmp_path):
    _, listed, shards = written(spark, tmp_path, [f"t{i}" for i in range(12)])
    with pytest.raises(ValueError, match=r"missing \[1\]"):
        manifest.write_manifest(str(tmp_path / "a"), "r", listed.where("unit_index <> 1"), shards.where("unit_index <> 1"), 4)
    with pytest.raises(ValueError, match="foreign 1"):
        manifest.write_manifest(str(tmp_path / "b"), "r", listed, shards, 3)
    assert not manifest.is_complete(spark, str(tmp_path / "a")) and not manifest.is_complete(spark, str(tmp_path / "b"))


def test_later_versions_are_refused(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 99}))
    with pytest.raises(ValueError, match="99"):
        manifest.read_manifest(spark, str(tmp_path))


# -- exports


def shards_of(spark, root):
    invoices = spark.createDataFrame([(i, f"inv-{i}", D(i) / 7 if i % 3 else None, datetime.date(2026, 1, 1 + i % 28), i % 2 == 0, 0.5 * i, None) for i in range(50)], "unit_index long, invoice_id string, total decimal(20,4), day date, paid boolean, wear double, nothing string").withColumn("unit_index", F.col("unit_index") % 4)
    lines = invoices.select("unit_index", "invoice_id", F.lit(2).cast("long").alias("line_no"), F.lit(D("12345678901234567890.123456")).cast("decimal(38,6)").alias("amount"))
    export.write_unit_shards(invoices, root, "r1", "invoices")
    export.write_unit_shards(lines, root, "r1", "line_items")
    return invoices, lines


def test_tables_are_discovered(spark, tmp_path):
    root = str(tmp_path / "store")
    invoices, lines = shards_of(spark, root)
    for stray in ("r1/manifest/unit-000000.json.gz", "r1/documents/unit-000000/a.json.gz"):
        p = pathlib.Path(root, stray)
        p.parent.mkdir(parents=True)
        p.write_bytes(gzip.compress(b'{"x": 1}\n'))
    sink = Sink(spark, f"view:{tmp_path}/golden")
    assert export.export_run(spark, "unknown", root, sink) == {}
    assert export.export_run(spark, "r1", root, sink) == {"invoices": 50, "line_items": 50}
    back = spark.read.parquet(f"{sink.path}/invoices")
    assert dict(back.dtypes) == {"invoice_id": "string", "total": "decimal(18,4)", "day": "date", "paid": "boolean", "wear": "double", "nothing": "string", "run_id": "string"}
    assert sorted(map(tuple, back.select("invoice_id", "total", "day", "paid", "wear", "nothing").collect())) == sorted(tuple(r)[1:] for r in invoices.collect())
    assert dict(spark.table("line_items").dtypes)["amount"] == "decimal(26,6)" and spark.table("line_items").select("amount").distinct().first()[0] == D("12345678901234567890.123456")
    # again, in place of the first time
    assert export.export_run(spark, "r1", root, sink)["invoices"] == 50 and spark.read.parquet(f"{sink.path}/invoices").count() == 50


def test_damaged_shards_are_named(spark, tmp_path):
    root = str(tmp_path / "store")
    shards_of(spark, root)
    folder = pathlib.Path(root, "r1/golden/invoices")
    cut, odd = (next(folder.glob(f"unit=unit-00000{n}/*.gz")) for n in (1, 2))
    rows = gzip.decompress(odd.read_bytes()).splitlines()
    lost = len(gzip.decompress(cut.read_bytes()).splitlines())
    for p in folder.rglob(".*.crc"):
        p.unlink()
    noise = random.Random(1)
    long = gzip.compress(b"".join(json.dumps({"invoice_id": f"x{i}", "note": noise.randbytes(200).hex()}).encode() + b"\n" for i in range(2_000)))
    cut.write_bytes(long[: len(long) // 2])
    odd.write_bytes(gzip.compress(b"\n".join([*rows, b"{broken", b"[1]"]) + b"\n"))
    report = {r.shard: r for r in export.shard_report(spark, root, "r1").collect()}
    broken = {s: r for s, r in report.items() if r.error}
    assert len(report) == 8 and len(broken) == 2
    by = {s.split("/")[1]: r for s, r in broken.items()}
    assert "breaks off" in by["unit=unit-000001"].error and 0 < by["unit=unit-000001"].rows < 2_000
    assert by["unit=unit-000002"].bad_rows == 2 and by["unit=unit-000002"].rows == len(rows)
    totals = {r.table: r for r in export.build_totals(export.shard_report(spark, root, "r1")).collect()}
    assert totals["invoices"].damaged == 2 and len(totals["invoices"].damaged_shards) == 2 and totals["line_items"].damaged == 0
    assert totals["invoices"].rows == 50 - lost + by["unit=unit-000001"].rows
    with pytest.raises(ValueError, match="damaged shards"):
        export.export_run(spark, "r1", root, Sink(spark, str(tmp_path / "g")))
    assert export.export_run(spark, "r1", root, Sink(spark, str(tmp_path / "g")), damaged="skip")["line_items"] == 50


def test_mixed_columns_raise(spark, tmp_path):
    folder = tmp_path / "s/r/golden/t"
    folder.mkdir(parents=True)
    (folder / "unit-000000.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": "x"}\n'))
    with pytest.raises(ValueError, match="column 'a'"):
        export.export_run(spark, "r", str(tmp_path / "s"), Sink(spark, str(tmp_path / "g")))


# -- build report


def test_report_is_counted_while_writing(spark, tmp_path):
    rows = [(i, f"Plain item {i}, size 4", [None, "", "  ", f"Steel bolt {i}, M8 x 40mm", "Sure, here is one"][i % 5], i % 4 == 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "no long, description string, reply string, fits boolean")
    judged = extensions.judged(frame, "description", "reply", F.col("fits"))
    want = extensions.build_report(judged).first().asDict()
    got = extensions.write_with_report(judged, str(tmp_path / "out"))
    assert got == want | {"llm_fraction": 0.2} and float(want["llm_fraction"]) == 0.2
    assert got["llm_filled"] == 20 and got["rejected_descriptions"] == 20 and got["bad_price_bands"] == 15 and got["procedural_fallback"] == 80
    back = {r.no: r.description for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back[3] == "Steel bolt 3, M8 x 40mm" and back[4] == "Plain item 4, size 4"
    assert extensions.write_with_report(judged.where("false"), str(tmp_path / "none"))["llm_fraction"] == 0.0


# -- pages


def laid_out(rows, size):
    """Sections in first-seen order with a heading each, row after row."""
    order, held = [], {}
    for _, section, amount in sorted(rows, key=lambda r: r[0]):
        if section not in held:
            order.append(section)
            held[section] = []
        held[section].append(amount)
    at, out = 0, []
    for s in order:
        top, at = at, at + 1 + len(held[s])
        out.append((s, len(held[s]), sum(held[s]), top // size + 1, (at - 1) // size + 1))
    return out, at


def fit(content, size):
    """The scale that spares a nearly empty last page."""
    count = math.ceil(content / size)
    if count == 1 or (content - (count - 1) * size) / size >= 0.25:
        return 1.0
    return max(round((count - 1) * size / content, 4), 0.8)


@pytest.mark.parametrize("size", [54, 7])
def test_pages(spark, size):
    rng = random.Random(size)
    docs = {k: [(n + 1, rng.choice(["a", "b", None, "c"]), D(rng.randint(1, 999)) / 100) for n in range(rng.choice([1, 5, 53, 54, 55, 60, 130, 400]))] for k in range(30)}
    frame = spark.createDataFrame([(k, *r) for k, rows in docs.items() for r in rows], "doc long, line_no long, section string, amount decimal(18,2)")
    sections = {}
    for r in pages.sections(frame, "doc", "section", ["line_no"], "amount", rows_per_page=size).orderBy("doc", "section_no").collect():
        sections.setdefault(r.doc, []).append((r.section, r.rows, r.subtotal, r.first_page, r.last_page, r.spans))
    whole = {r.doc: r for r in pages.pages(frame, "doc", "section", ["line_no"], rows_per_page=size).collect()}
    for k, rows in docs.items():
        want, content = laid_out(rows, size)
        assert sections[k] == [(*s, s[3] < s[4]) for s in want]
        got = whole[k]
        assert (got.printed, got.content_rows, got.pages, got.spanning) == (len(rows), content, math.ceil(content / size), sum(s[3] < s[4] for s in want))
        assert got.last_page_rows == content - size * (got.pages - 1) and abs(float(got.scale) - fit(content, size)) < 1.01e-4


# -- replies


def read_reply(text):
    """The items of a reply, in plain Python."""
    bare = re.sub(r"^```(?:json)?|```$", "", (text or "").strip(), flags=re.MULTILINE).strip()
    try:
        data = json.loads(bare)
    except ValueError:
        return []
    out = []
    for place, e in enumerate(data if isinstance(data, list) else []):
        if not isinstance(e, dict):
            continue
        name = e.get("name") or e.get("nom") or e.get("description")
        low, high = e.get("min", e.get("low")), e.get("max", e.get("high"))
        if isinstance(name, str) and name.strip():
            out.append((place, name.strip(), None if low is None else str(low), None if high is None else str(high)))
    return out


def test_replies(spark):
    texts = [
        None, "", "no json", "{}", "[]", "[1, null, \"x\", []]", '{"name": "x"}', '[{"name": "A", "min": 1, "max": 2}]', '```json\n[{"nom": "B", "low": "1.5", "high": 2.25}]\n```', '```\n[{"description": " C "}]\n```',
        '[{"name": "", "nom": "D"}, {"name": 0, "description": "E"}, {"name": 7, "nom": "no"}, {"name": ["x"]}, {"name": "  "}, {"name": "0"}, {"name": "false", "min": null, "low": 3}]', '  [{"name": "é 😀 \\"q\\"", "min": -1, "max": "x"}]  ', '[{"name": "cut', '[{"name": {"a": 1}}, {"name": false, "nom": "F"}, {"nom": null, "description": "G", "max": 3}]',
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "no long, reply string")
    got = {}
    for r in replies.items(frame, "reply").orderBy("no", "place").collect():
        got.setdefault(r.no, []).append((r.place, r.name, r.low, r.high))
    assert got == {n: v for n, t in enumerate(texts) if (v := read_reply(t))}


# -- printed vocabulary


def test_label_tables_are_checked(spark):
    known = labels.Labels.built_in(spark)
    known.validate()
    assert known.problems().count() == 0 and known.languages().count() == 3
    more = spark.createDataFrame([("de", "total", "Summe"), ("de", "subtotal", "  "), ("de", "extra", "x"), ("fr-FR", "surplus", "y")], "language string, key string, shown string")
    odd = labels.Labels(known.labels.unionByName(more), known.headers.where("language <> 'fr-CA' or vocabulary <> 'standard'"))
    got = {(r.language, r.problem): r["keys"] for r in odd.problems().collect()}
    assert got == {("de", "missing"): "bill_to, discount, due_date, invoice, issue_date, tax_total", ("de", "unexpected"): "extra", ("fr-FR", "unexpected"): "surplus", ("de", "blank"): "subtotal", ("de", "no headers"): "", ("fr-CA", "no standard headers"): ""}
    with pytest.raises(ValueError, match="de: missing bill_to"):
        odd.validate()
    with pytest.raises(ValueError, match="reference language"):
        labels.Labels(known.labels, known.headers, "it").validate()


def test_labels_are_looked_up(spark):
    known = labels.Labels.built_in(spark)
    rows = spark.createDataFrame([("en", "caps"), ("fr-FR", "caps"), ("fr-CA", "minimal")], "lang string, vocabulary string")
    got = {r.lang: r for r in known.column_headers(known.shown(rows, F.col("lang"), F.lit("discount")), F.col("lang"), F.col("vocabulary")).collect()}
    assert [got[k].shown for k in ("en", "fr-CA", "fr-FR")] == ["Discount", "Rabais", "Remise"]
    assert [h.shown for h in got["en"].headers] == ["DESCRIPTION", "QUANTITY", "UNIT PRICE", "AMOUNT"] and not got["en"].fell_back
    assert [h.shown for h in got["fr-FR"].headers] == ["Désignation", "Quantité", "Prix unitaire HT", "Montant HT"] and got["fr-FR"].fell_back
    assert [(h.key, h.shown) for h in got["fr-CA"].headers] == [("description", "Description"), ("amount", "Montant")]
    with pytest.raises(Exception, match="no label nothing"):
        known.shown(rows, F.col("lang"), F.lit("nothing")).collect()
    with pytest.raises(Exception, match="no vocabulary for language it"):
        known.column_headers(rows, F.lit("it"), F.col("vocabulary")).collect()


def test_handwriting_pins_no_typeset_page():
    assert Selection.of({"conditions": "handwritten", "templates": "handwritten-form-01"}).templates == ("handwritten-form-01",)
    with pytest.raises(UnsupportedConstraint, match="fullbleed-05"):
        Selection.of({"conditions": ["clean", "handwritten"], "templates": ["fullbleed-05"]})
