"""Rule tables on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import stats, text, urls
from sievework.operators import dataset, decision, fusion, links, metrics, signals, similarity
from sievework.sources import files
from sievework.streaming import cases


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_web_urls(spark):
    rows = [("example.com",), ("http://a.b.example.com:8080/x?q=1#f",), ("https://user:pw@example.com/",), ("ftp://example.com",), ("",), ("a b.com",), ("https://bücher.example/",), ("http://example.com:0/",), ("localhost",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").coalesce(1).select(urls.parse_web_url("url")).collect()]
    assert [g.ok for g in got] == [True, True, True, False, False, False, True, False, False, False]
    assert got[0].url == "https://example.com/" and got[1].port == 8080 and got[2].credentials and got[6].host == "xn--bcher-kva.example"


def test_domain_assessment(spark):
    rows = [(1, "https://www.instagram.com/x"), (2, "https://instagrarn.com/login"), (3, "http://shop.bad.example/"), (4, "https://threadless.com/"), (5, "https://facebook-login.example.com"), (6, "https://airlines.com")]
    listed = spark.createDataFrame([("bad.example", "11508")], "domain string, listed_since string")
    got = {r.id: r for r in urls.assess_domains(spark.createDataFrame(rows, "id int, url string"), listed).collect()}
    assert got[1].status == "official" and got[1].capture_allowed
    assert got[2].impersonates == "Instagram" and got[2].risk_level == "High" and got[2].block_reason == "lookalike"
    assert got[3].risk_score == 95 and got[3].listed_since == "11508" and got[3].block_reason == "listed"
    assert got[4].status == "unverified" and got[6].status == "unverified" and got[5].impersonates == "Facebook"


def test_suffixes_and_registrable(spark):
    df = spark.createDataFrame([("a.b.com.tw",), ("x.org",), ("one",)], "h string").coalesce(1)
    got = df.select(urls.suffixes(F.col("h")), urls.registrable(F.col("h"))).collect()
    assert got[0][0] == ["a.b.com.tw", "b.com.tw", "com.tw"] and got[0][1] == "b.com.tw"
    assert got[1][0] == ["x.org"] and got[2][0] == [] and got[2][1] == "one"
    u = "https://l.instagram.com/?u=https%3A%2F%2Fevil.shop%2Fa&e=1"
    assert one(spark, urls.unwrap_click(F.col("u")), u, schema="u string") == "https://evil.shop/a"


def test_text_functions(spark):
    assert one(spark, text.magnitude_number(F.col("t")), "12.3萬 followers", schema="t string") == 123000
    assert one(spark, text.title_of(F.col("t")), "Re: [ask] a longer title\nbody", schema="t string") == "a longer title"
    assert one(spark, text.fold_confusables(F.col("t")), "f4c3b00k", schema="t string") == "facebook"
    assert one(spark, text.squash_confusables(F.col("t")), "Til-o", schema="t string") == "7110"
    assert one(spark, text.verified_quotes(F.col("q"), F.col("t")), ["Pay now!", "nope"], "please, pay now.", schema="q array<string>, t string") == ["Pay now!"]
    assert one(spark, text.windows_of(F.col("a"), 4, 1), list(range(9)), schema="a array<int>") == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8]]
    assert one(spark, text.matching_blocks_ratio("a", "b"), "abcd", "bcde", schema="a string, b string") == 0.75


def test_signals(spark):
    s = one(spark, signals.pattern_signals(F.col("t")), "加 LINE id: abcd1234 保證獲利 限時", schema="t string")
    assert {x.signal for x in s} == {"off_platform_contact", "guaranteed_return", "urgency"} and sum(x.weight for x in s) == 4.5
    p = one(spark, signals.profile_signals(F.col("f"), F.col("p"), F.col("h")), 3.0, None, "abc123456", schema="f double, p double, h string")
    assert [x.signal for x in p] == ["throwaway_profile", "random_digit_handle"]
    lines = spark.createDataFrame([("See more",), ("12,3k",), ("a",), ("real sentence here",), (" · ",)], "l string").coalesce(1)
    assert [r[0] for r in lines.select(signals.screen_line_reason(F.col("l"), ["seemore"])).collect()] == ["ui_lexicon", "bare_number", "too_short", None, "empty"]


def test_decisions(spark):
    rows = [(["low", "medium"], "medium"), (["medium"], "low"), (["medium", "medium"], "medium"), (["high"], "high"), ([], "none")]
    got = spark.createDataFrame(rows, "l array<string>, want string").select(decision.link_risk(F.col("l")), "want").collect()
    assert all(a == b for a, b in got)
    page = [("t", "body", "https://x", 200, False, None), ("t", "b", "https://x", 404, False, "http_error"), ("Access denied", "b", "https://x", 200, False, "load_error"), ("t", "b", "https://x/login", 200, False, "login_wall"), ("t", " ", "https://x", 200, None, "empty_page"), ("t", "b", "u", None, None, "http_error")]
    df = spark.createDataFrame(page, "t string, b string, u string, s int, p boolean, want string")
    assert all(a == b for a, b in df.select(decision.page_problem(F.col("t"), F.col("b"), F.col("u"), F.col("s"), F.col("p"), ["access denied"]), "want").collect())
    label = lambda *e: one(spark, dataset.timeline_label(F.col("e")), list(e), schema="e array<string>")
    assert label("確認，這是詐騙") == "Fraud" and label("並非詐騙", "確認為詐騙") == "Normal" and label("處理中") is None


def test_link_flags(spark):
    f = links.link_flags(F.col("h"), F.col("f"), F.col("s"), status=F.lit("success"), path=F.lit("/ti/g/x"), text=F.lit("限時 特價 下單"), listed=F.lit(False), lookalike=F.lit(False), reason=F.lit(None).cast("string"))
    got = {x.signal: x.level for x in one(spark, f, ["bit.ly", "a1b2.shop", "line.me"], "line.me", "bit.ly", schema="h array<string>, f string, s string")}
    assert got == {"shortener": "low", "multi_hop": "medium", "private_chat": "medium", "one_page_shop": "medium"}
    assert one(spark, links.urls_in_text(F.col("t")), "mail a@b.com, see evil.shop/x. and http://q.top", schema="t string") == ["https://evil.shop/x", "http://q.top"]


def test_calibration_maps(spark):
    iso = spark.createDataFrame([(-2.0, 0), (-1.0, 1), (0.0, 0), (1.0, 1)], "z double, y int")
    assert fusion.fit_isotonic(iso, "z", "y") == ([-2.0, -1.0, 0.0, 1.0], [0.0, 0.5, 0.5, 1.0])
    slope, bias = fusion.fit_platt(spark.createDataFrame([(float(z), int(z > 0)) for z in range(-20, 21)], "z double, y int"), "z", "y")
    assert slope > 0.1 and abs(bias) < 0.2
    slope, _ = fusion.fit_platt(spark.createDataFrame([(float(z), int(z < 0)) for z in range(-20, 21)], "z double, y int"), "z", "y")
    assert slope == pytest.approx(0, abs=1e-6)
    scores = metrics.calibration_scores(spark.createDataFrame([(1, 0.8), (0, 0.2)], "y int, p double"), "y", "p").first()
    assert scores.brier == 0.04 and scores.ece == 0.2


def test_hashes_and_images(spark):
    rng = np.random.default_rng(2)
    img = rng.random(1024) * 255
    rows = [(1, img.tolist(), rng.random(72).tolist())]
    rows.append((2, (img + rng.normal(size=1024)).tolist(), rows[0][2]))
    rows.append((3, (rng.random(1024) * 255).tolist(), rng.random(72).tolist()))
    h = spark.createDataFrame(rows, "id int, g array<double>, d array<double>").select("id", stats.perceptual_hash("g").alias("phash"), stats.difference_hash("d").alias("dhash")).cache()
    near = similarity.nearest_image(h.where("id > 1"), h.where("id = 1").withColumnRenamed("id", "ref")).collect()
    assert [(r.id, r.ref) for r in near] == [(2, 1)]


def test_boxes(spark):
    chars = [("a", [0.0, 0.0, 2.0, 2.0]), ("b", [50.0, 0.0, 52.0, 2.0])]
    got = one(spark, similarity.align_marks(F.col("c"), F.col("b")), chars, [[0.0, 0.0, 10.0, 10.0], [40.0, 0.0, 60.0, 9.0]], schema="c array<struct<ch:string,box:array<double>>>, b array<array<double>>")
    assert got == ["a", "b"]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"1","v":1}\nbroken\n{"id":"1","v":2}\n{"id":"2","v":3}\n')
    got = files.keyed_json_lines(spark, str(tmp_path / "in"), "id string, v int", "id").where("id is not null")
    assert sorted((r.id, r.v) for r in got.collect()) == [("1", 2), ("2", 3)]
    assert files.tolerant_json_lines(spark, str(tmp_path / "in"), "id string, v int").count() == 3
    queue = str(tmp_path / "queue")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "id string, v int")
    assert files.enqueue(new, queue, ["id"]) == 2 and files.enqueue(new, queue, ["id"]) == 0
    (tmp_path / "t.csv").write_bytes("﻿網域,x\na.com,1\n".encode())
    assert files.csv_in_either(spark, str(tmp_path / "t.csv"), ["網域"]).count() == 1
    (tmp_path / "b.csv").write_bytes("民國年月,網域\n11508,壞.tw\n".encode("cp950"))
    assert files.csv_in_either(spark, str(tmp_path / "b.csv"), ["網域"]).first()["網域"] == "壞.tw"
    with pytest.raises(ValueError):
        files.checked_csv(spark, str(tmp_path / "t.csv"), ["nope"])
    stream = cases.case_stream(spark, str(tmp_path / "in"), "id string, v int").where("id is not null")
    for _ in range(2):
        cases.to_queue(stream, str(tmp_path / "q2"), ["id", "v"], str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "q2")).count() == 3


def test_progress_states(spark):
    rows = [("r", "a", 1, "running"), ("r", "a", 2, "done"), ("r", "b", 3, "running"), ("r", "c", 1, "waiting"), ("r", "all", 9, "stopped")]
    got = {r.step: r.state for r in cases.latest_states(spark.createDataFrame(rows, "run string, step string, at int, state string"), "run", "step", "at", "state").collect()}
    assert (got["a"], got["b"], got["c"]) == ("done", "warning", "skipped")
