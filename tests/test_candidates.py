import struct
import zlib

import pytest
from pyspark.sql import functions as F

from larder.operators import candidates


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_contract_and_route(spark):
    found = one(spark, candidates.contract(F.lit('["서울우유", {"display_name":"두부","score":"0.84","category":"가공식품"}, " ", {"name":"x","confidence":"bad"}]')))
    assert [(c.display_name, c.normalized_name, c.category, c.confidence) for c in found] == [("서울우유", "서울우유", None, 0.0), ("두부", "두부", "가공식품", 0.84), ("x", "x", None, 0.0)]
    assert one(spark, candidates.contract(F.lit("12"))) == [] and one(spark, candidates.contract(F.lit('"a"')))[0].display_name == "a"
    nested = one(spark, candidates.route_fields(F.lit('{"route":{"type":"raw_ingredient","confidence":0.9,"needsReview":false,"probabilities":{"a":1.0}}}')))
    flat = one(spark, candidates.route_fields(F.lit('{"route":"packaged_food","confidence":0.4}')))
    assert (nested.route, nested.confidence, nested.needs_review, nested.probabilities) == ("raw_ingredient", 0.9, False, {"a": 1.0})
    assert (flat.route, flat.confidence, flat.needs_review, flat.probabilities) == ("packaged_food", 0.4, True, {})


def test_stages(spark):
    c = lambda *p: F.array(*[F.struct(F.lit(x).alias("confidence")) for x in p]) if p else F.array().cast("array<struct<confidence:double>>")
    stage = lambda r, o, w, d: one(spark, candidates.stage(F.lit(r), c(*o), c(*w), c(*d))).stage
    assert stage("packaged_food", [], [], []) == "packaged_food_ocr" and stage("packaged_food", [], [0.86], []) == "raw_ingredient_classifier_override"
    assert stage("raw_ingredient", [0.5], [0.95, 0.1], []) == "raw_ingredient_classifier" and stage("raw_ingredient", [0.5], [0.95, 0.9], []) == "packaged_food_ocr_fallback_from_raw"
    assert stage("x", [0.5], [], [0.98]) == "yolo_master_topk" and stage("x", [0.5], [], [0.5]) == "packaged_food_ocr_fallback_from_direct_master" and stage("x", [0.5], [], []) == "unsupported_route"


def test_labels(spark):
    new = spark.createDataFrame
    labels = new([("ing_00007", "사과 D", "사과", "과일", 7), ("red_apple", "R", "r", "", None)], "key string, display_name string, normalized_name string, category string, ingredient_id long")
    top = new([(1, 0, "ING_7", 0.5), (1, 1, "Red__Apple", 0.3), (1, 2, "old", 0.1), (1, 3, "zzz", 0.1)], "image long, place int, label string, p double")
    remap, vocabulary = new([("old", "ing_7")], "old string, new string"), new([("사과",), ("zzz",)], "name string")
    rows = candidates.resolved_labels(top, labels, remap, vocabulary).orderBy("place").collect()
    assert [(r.normalized_name, r.ingredient_id, r.resolved) for r in rows] == [("사과", 7, None), ("r", None, None), ("사과", 7, "ing_7"), ("zzz", None, None)]
    assert candidates.resolved_labels(top, labels, remap, vocabulary, policy="skip", enforce=True).count() == 2
    reference = new([("ing_00008", "E", "e", 0)], "key string, display_name string, normalized_name string, ingredient_id long")
    named = candidates.named_classes(new([(1, "ing_00007", 0.5), (1, "ing_00008", 0.2), (1, "q", 0.1)], "image long, class string, p double"), labels, reference)
    assert sorted((r["class"], r.normalized_name, r.ingredient_id) for r in named.collect()) == [("ing_00007", "사과", 7), ("ing_00008", "e", None), ("q", "q", None)]
    assert candidates.overlay([labels, labels.limit(1).withColumn("display_name", F.lit("new"))], "key").filter("display_name = 'new'").count() == 1
    assert sorted(map(tuple, candidates.claimed_names(new([("b", "x", "y"), ("a", "x", None)], "c string, n1 string, n2 string"), "c", ["n1", "n2"]).collect())) == [("x", "a", False), ("x", "b", True), ("y", "b", False)]
    files = new([("train/Red Apple/a.jpg",), ("q/b.jpg",), ("Fruits/red-apple/x/c.jpg",)], "path string")
    mapping = new([("red_apple", "raw"), ("fruits", "other")], "folder string, value string")
    assert {r.path: r.value for r in candidates.source_class(files, "path", mapping).collect()} == {"train/Red Apple/a.jpg": "raw", "q/b.jpg": None, "Fruits/red-apple/x/c.jpg": "raw"}
    key = lambda *k: new([(x,) for x in k], "key string")
    proposal = candidates.packaged_proposal(new([("a", "소스"), ("b", "소스"), ("c", "x"), ("d", None)], "key string, category string"), key("c"), key("b"))
    assert {r.key: r.proposal for r in proposal.collect()} == {"a": "proposed", "b": "borderline", "c": "proposed", "d": None}
    table = candidates.class_reference(new([(0, "ing_7", " a "), (1, "ING_00007", "b")], "line_no long, `﻿class_folder` string, ` display_name` string"))
    assert [(r.key, r.display_name) for r in table.collect()] == [("ing_00007", "b")]
    manifest = new([("사과", "d"), ("", "e")], "normalized_name string, source_dir string")
    assert [r["class"] for r in candidates.verified_folders(manifest, labels).collect()] == ["ing_00007"]
    with pytest.raises(Exception, match="unknown name"):
        candidates.verified_folders(manifest.withColumn("normalized_name", F.lit("q")), labels).collect()


def test_images(spark, tmp_path):
    rows = b"".join(b"\x00" + bytes([200 if (x + y) % 2 else 0 for x in range(5) for _ in range(3)]) for y in range(5))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    found = {r.origin.rpartition("/")[2]: r for r in candidates.image_statistics(spark.read.format("image").option("dropInvalid", False).load(str(tmp_path))).collect()}
    level = 200 / 255
    assert found["b.png"].variance is None and found["a.png"].luminance == pytest.approx(12 / 25 * level)
    inner = [(4 * level if (x + y) % 2 == 0 else -4 * level) for x in range(1, 4) for y in range(1, 4)]
    mean = sum(inner) / 9
    assert found["a.png"].variance == pytest.approx(sum((v - mean) ** 2 for v in inner) / 9)
