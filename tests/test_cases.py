"""Segments, brands, image index, reviews and reports on literal rows, against plain Python where order matters."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import brands, images, links, reports, review, segments, similarity

SCHEMA = "case_id string, group_id string, pair_id string, split string, label string, label_source string, reviewer string, permission string, notes string, status string, scope string, synthetic boolean, texts map<string,string>"


def case(i, **new):
    row = {"case_id": i, "group_id": i, "pair_id": "", "split": "train", "label": "Fraud", "label_source": "s", "reviewer": "r", "permission": "p", "notes": "n", "status": "reviewed", "scope": "content", "synthetic": False, "texts": {"dom": f"text {i}"}}
    return tuple({**row, **new}.values())


def test_segment_effects(spark):
    cases = spark.createDataFrame([(1, ["a bad", " ", "good", "bad bad"]), (2, ["only"]), (3, [])], "id int, segments array<string>")
    score = F.size(F.split("text", "bad")).cast("double") - 1
    scored = segments.deletions(cases).withColumn("score", score)
    got = segments.effects(scored)
    assert [(r.id, r["index"], r.delta, r["rank"]) for r in got.orderBy("id", "rank").collect()] == [(1, 2, 2.0, 1), (1, 0, 1.0, 2), (1, 1, 0.0, 3), (2, 0, 0.0, 1)]
    pairs = segments.pair_deletions(cases, got, 2)
    assert [(r.first, r.second, r.singles, r.text) for r in pairs.orderBy("second", "first").collect()] == [(0, 2, 3.0, "good"), (1, 2, 2.0, "a bad")]
    assert {r.nonadditivity for r in segments.pair_effects(pairs.withColumn("score", score), scored).collect()} == {0.0}
    n = spark.createDataFrame([(0,), (1,), (10,), (3,)], "n int").coalesce(1)
    assert [r[0] for r in n.select(segments.tested_indices(F.col("n"), 4)).collect()] == [[], [0], [0, 3, 6, 9], [0, 1, 2]]


def test_brands(spark):
    rows = [(1, ["shopee.evil.top"], "shopee.evil.top", "", "anchor", True), (2, ["shopee.tw"], "shopee.tw", "蝦皮", "anchor", False), (3, [], "other.example", "蝦皮 賣場", "anchor", False), (4, ["7-ll.com.tw"], "7-ll.com.tw", "7-11 取貨", "screenshot_text", False), (5, [], "plain.example", None, "anchor", False)]
    df = spark.createDataFrame(rows, "id int, hosts array<string>, host string, context string, source string, odd boolean")
    df = df.withColumn("b", brands.brand_of_link(F.col("hosts"), F.col("host"), F.col("context"))).withColumn("f", brands.brand_flag(F.col("b"), F.col("host"), F.col("source"), F.col("odd")))
    got = {r.id: (r.b and r.b.brand, r.f and (r.f.signal, r.f.level)) for r in df.collect()}
    assert got[1] == ("蝦皮", ("brand_impersonation", "high")) and got[2] == (None, None) and got[5] == (None, None)
    assert got[3] == ("蝦皮", ("brand_impersonation", "medium")) and got[4] == ("7-ELEVEN", ("ocr_misread", "low"))
    m = spark.createDataFrame([("ACME sale", ["x.example", "t.co"]), ("acme", ["t.co"]), ("acme", ["shop.acme.example"])], "t string, d array<string>").coalesce(1)
    assert [r[0] for r in m.select(brands.brand_mismatch(F.col("t"), F.col("d"), {"Acme": ["acme.example"]}, ["t.co"])).collect()] == [["Acme"], [], []]


@pytest.mark.parametrize("most", [100_000, 1])
def test_image_index_is_the_greedy_one(spark, monkeypatch, most):
    monkeypatch.setattr(images, "BLOCK", most)
    rng = random.Random(5)
    seeds = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(6)]
    near = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(63), k))
    fraud = [(i, near(p, rng.randint(0, 3)), near(d, rng.randint(0, 3))) for i, (p, d) in enumerate(rng.choices(seeds, k=60))]
    normal = [(near(seeds[0][0], 8),), (None,)]
    want = []
    for r in fraud:
        apart = lambda a, b: (a ^ b).bit_count()
        if all(apart(r[1], n[0]) > 12 for n in normal[:1]) and not any(apart(r[1], k[1]) <= 4 and apart(r[2], k[2]) <= 4 for k in want):
            want.append(r)
    got = images.build_index(spark.createDataFrame(fraud, "ref int, phash long, dhash long"), spark.createDataFrame(normal, "phash long"))
    assert sorted(tuple(r) for r in got.collect()) == want and 5 <= len(want) < 60
    empty = spark.createDataFrame([], "ref int, phash long, dhash long")
    assert images.build_index(empty, spark.createDataFrame(normal, "phash long")).count() == 0


def test_nearest_image_takes_the_least_sum_before_the_limits(spark):
    index = spark.createDataFrame([("a", (1 << 11) - 1, 0), ("b", 0, (1 << 12) - 1)], "ref string, phash long, dhash long")
    probe = spark.createDataFrame([(1, 0, 0), (2, 0, (1 << 12) - 1)], "id int, phash long, dhash long")
    assert [(r.id, r.ref, r.p, r.d) for r in similarity.nearest_image(probe, index).collect()] == [(2, "b", 0, 0)]


def test_review(spark, tmp_path):
    good = spark.createDataFrame([case("a"), case("b", label="Normal", split="test")], SCHEMA)
    assert review.violations(good).count() == 0
    bad = spark.createDataFrame([case("a", group_id="both"), case("b", group_id="both", split="test"), case("c", texts={"dom": "Same TEXT"}), case("d", label="Normal", texts={"dom": "same  text"}), case("e", notes=" "), case("f", texts={}), case("g", synthetic=None), case("h", texts={"dom": ""})], SCHEMA)
    got = {(r.case_id, r.problem) for r in review.violations(bad).collect()}
    assert got == {("a", "group_id_leakage"), ("b", "group_id_leakage"), ("c", "text_in_two_splits_or_labels"), ("d", "text_in_two_splits_or_labels"), ("e", "missing_notes"), ("f", "invalid_texts"), ("g", "not_a_real_content_review"), ("h", "empty_text")}
    queue = spark.createDataFrame([case("a", label="Unresolved", status="pending"), case("b", status="pending")], SCHEMA)
    answers = spark.createDataFrame([("a", 1, "Normal", "x"), ("a", 2, " Fraud ", "x")], "case_id string, reviewed_at int, label string, group_id string").selectExpr("*", "'train' split", "'r' reviewer", "'s' label_source", "'p' permission", "'n' notes", "'' pair_id")
    done = review.with_reviews(queue, answers)
    assert {(r.case_id, r.label, r.status) for r in done.collect()} == {("a", "Fraud", "reviewed"), ("b", "Fraud", "pending")}
    assert review.build_corpus(done, str(tmp_path / "c")) == 1
    with pytest.raises(Exception):
        review.build_corpus(done, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        review.build_corpus(bad, str(tmp_path / "d"))


def test_reports(spark):
    rows = [("blocked", "High", None, None), ("incomplete", None, "modality_conflict", None), ("success", "Low", None, "OCR_ERROR")]
    df = spark.createDataFrame(rows, "status string, level string, basis string, image string").coalesce(1)
    c = F.col
    got = df.select(reports.execution(c("status")).alias("e"), reports.decision_state(c("level")).alias("d"), reports.title(c("status"), c("level")).alias("t"), reports.incomplete_message(c("basis"), c("image"), F.lit("Fraud"), F.lit(None)).alias("m"), reports.settled_status(c("status"), F.lit("SUCCESS"), F.lit(None)).alias("s")).collect()
    assert [(r.e, r.d, r.s) for r in got] == [("stopped", "risk_signal_only", "blocked"), ("completed", "needs_review", "success"), ("completed", "risk_signal_only", "success")]
    assert got[0].t == reports.BLOCKED_TITLE and got[1].t == reports.TITLES["Unknown"] and "Fraud" in got[1].m and got[2].m == reports.INCOMPLETE["OCR_ERROR"]
    box = spark.createDataFrame([([[10.0, 20.0, 30.0, 40.0], [20.0, 20.0, 60.0, 30.0]],)], "b array<array<double>>")
    assert tuple(box.select(reports.percent_region(c("b"), F.lit(100), F.lit(200)).alias("r")).first().r) == (10.0, 10.0, 50.0, 10.0)
    small = spark.createDataFrame([("a|b", 0.5), (None, 2.0)], "k string, v double").coalesce(1)
    assert reports.markdown_table(small, 1).splitlines() == ["| k | v |", "| --- | --- |", "| a\\|b | 0.5 |", "| – | 2.0 |"]
    assert reports.splice("x <a> old <b> y", "new", "<a>", "<b>") == "x <a>\nnew\n<b> y"
    assert reports.csv_with_mark(small) == "﻿k,v\r\na|b,0.5\r\n,2.0\r\n"


def test_investment_page_flag(spark):
    df = spark.createDataFrame([("飆股 老師 名單",), ("老師 節快樂",), (None,)], "t string").coalesce(1)
    no, host = F.lit(False), F.lit("plain.example")
    flags = links.link_flags(F.array(host), host, host, status=F.lit("success"), path=F.lit("/"), text=F.col("t"), listed=no, lookalike=no, reason=F.lit(None).cast("string"))
    assert [[(x.signal, x.level) for x in r[0]] for r in df.select(flags).collect()] == [[("investment_landing", "medium")], [], []]
