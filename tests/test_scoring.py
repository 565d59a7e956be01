"""Scorers, calibration, jobs, experiments: on small tables against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sievework import jobs
from sievework.functions import text, urls
from sievework.models import scorer
from sievework.operators import brands, calibration, evidence, experiment, screen
from sievework.runtime import clean_up, new_folder, stored


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    good, bad = ["meeting notes for monday", "the weather is fine", "read this book"], ["send money to win a prize", "guaranteed profit today", "transfer cash now"]
    rows = [(f"c{i}", " ".join(rng.choices(bad if i % 2 else good, k=3)), i % 2) for i in range(80)]
    return scorer.HashedNgramScorer(buckets=4096, size=64, overlap=8).fit(spark.createDataFrame(rows, "k string, t string, y int"), "k", "t", "y")


def test_scorer_scores_chunks_and_empty_texts(spark, trained):
    rows = spark.createDataFrame([("a", "guaranteed profit, send money"), ("b", "notes for the meeting on monday"), ("c", ""), ("d", None), ("e", "guaranteed profit today " * 20)], "k string, t string")
    got = {r.key: r.result for r in trained.score(rows, "k", "t").collect()}
    assert got["a"].prediction == "Fraud" and got["b"].prediction == "Normal" and got["e"].num_chunks > 5
    assert got["c"].status == got["d"].status == "SKIPPED_TEXT_EMPTY" and got["c"].fraud_confidence is None
    assert got["a"].fraud_confidence == pytest.approx(1 / (1 + math.exp(-got["a"].logit_difference)))
    assert got["a"].fraud_confidence + got["a"].normal_confidence == pytest.approx(1)
    parts = trained.attributions(rows.where("k = 'b'"), "k", "t").agg(F.sum("value")).first()[0]
    assert parts + trained.identity["bias"] == pytest.approx(got["b"].logit_difference, abs=1e-6)
    hints = scorer.process_text(trained, spark.createDataFrame([("a", "保證獲利 guaranteed profit")], "k string, t string"), "k", "t").first()
    assert hints.rule_signals == ["guaranteed_return_claim"] and hints.result.status == "SUCCESS"


def test_explanations_and_regions(spark, trained):
    rows = spark.createDataFrame([("x", "dom", ["guaranteed profit today", "the weather is fine", "send money to win a prize"]), ("x", "ocr", ["read this book"])], "case_id string, source string, segments array<string>")
    singles, pairs = scorer.explain_report(trained, rows)
    dom = {r['index']: r.delta for r in singles.where("source = 'dom'").collect()}
    assert len(dom) == 3 and max(dom, key=dom.get) in (0, 2) and dom[1] <= max(dom.values())
    assert pairs.where("source = 'dom'").count() == 3 and pairs.where("source = 'ocr'").count() == 0
    boxes = F.array(F.array(*[F.lit(float(x)) for x in (0, 0, 10, 10)]))
    point = lambda x: [[x, 1.0], [x + 2, 1.0], [x + 2, 3.0], [x, 3.0]]
    reads = spark.createDataFrame([("x", [("send money", True, point(2.0)), ("the weather", True, point(90.0)), ("no", False, point(2.0)), ("odd", True, [[1.0, 1.0]])])], "case_id string, r array<struct<text:string,accepted:boolean,bbox:array<array<double>>>>")
    covered = reads.select("case_id", screen.spatial_coverage(boxes, F.col("r"), F.lit(1.0)).alias("coverage"))
    assert [(x.place, x.kind) for x in covered.first().coverage] == [(0, "matched"), (1, "unmatched"), (3, "unlocated")]
    got = {r.region: r.text for r in scorer.compare_regions(trained, covered, trained.identity).collect()}
    assert got == {"matched": "send money", "unmatched": "the weather"}
    with pytest.raises(ValueError):
        scorer.compare_regions(trained, covered, {})


def test_rescore_keeps_what_it_cannot_score(spark, trained):
    base = spark.createDataFrame([("a", ("SUCCESS", "Normal", 0.1, -2.0)), ("b", ("SUCCESS", "Normal", 0.2, -1.0))], f"case_id string, text_model {evidence.MODEL_RESULT}")
    texts = spark.createDataFrame([("a", "guaranteed profit send money"), ("b", ""), ("z", "unknown")], "case_id string, text string")
    got = {r.case_id: r.text_model.prediction for r in scorer.rescore(trained, base, texts).collect()}
    assert got == {"a": "Fraud", "b": "Normal"}


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_artifact(spark, method):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        z = rng.gauss(0, 2)
        rows.append(("dom", "test" if i % 3 == 0 else "calibration", f"g{i % 200}", "Fraud" if rng.random() < 1 / (1 + math.exp(-z / 2)) else "Normal", z, json.dumps({"f": 1})))
    rows += [("ocr", "test", "h", "Fraud", 1.0, json.dumps({"f": 1}))]
    frame = spark.createDataFrame(rows, "source string, split string, group_id string, label string, z double, model string")
    out = calibration.fit_candidates(frame, {"f": 1}, method)
    assert set(out["sources"]) == {"dom"} and set(out["skipped_sources"]) == {"ocr"}
    assert out["sources"]["dom"]["test_calibrated"]["brier"] <= out["sources"]["dom"]["test_raw"]["brier"] + 0.02
    result = spark.createDataFrame([(("SUCCESS", "Fraud", 0.9, 2.2),), (("FAILED", None, None, None),)], f"r {evidence.MODEL_RESULT}")
    got = [r[0] for r in result.select(calibration.apply_candidate(F.col("r"), "dom", out, {"f": 1})).collect()]
    assert 0 < got[0].calibrated_fraud_score < 1 and got[1].calibrated_fraud_score is None
    with pytest.raises(ValueError):
        calibration.apply_candidate(F.col("r"), "dom", out, {"f": 2})
    with pytest.raises(ValueError):
        calibration.fit_candidates(frame.withColumn("model", F.lit("other")), {"f": 1})


def test_dataset_job_builds_a_manifest(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    cases = [{"case_id": f"{i}", "text": words(12), "image_path": None, "label": "Fraud" if i % 2 else "Normal", "label_source": "t", "source_url": "u", "category": "c", "platforms": ["FB" if i % 3 else "Threads"], "reported_at": f"2025/01/{10 + i % 20}"} for i in range(40)]
    cases += [dict(cases[1], case_id="again", reported_at="2026/01/01"), dict(cases[2], case_id="near", text=cases[2]["text"] + " tail"), dict(cases[3], case_id="gone", text="詐騙訊息，已通知平台移除")]
    posts = [{"case_id": f"p{i}", "text": f"[ask] a question {i}\nbody", "label": "Normal", "board": "Salary" if i % 2 else "Stock", "group_id": "g", "source_url": f"u{i}"} for i in range(6)]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(c, ensure_ascii=False) for c in cases), encoding="utf-8")
    (tmp_path / "p.json").write_text("\n".join(json.dumps(c) for c in posts))
    jobs.dataset_job(spark, jobs.parser().parse_args(["dataset", "--cases", str(tmp_path / "c.json"), "--posts", str(tmp_path / "p.json"), "--output", str(tmp_path / "out")]))
    got = {r.case_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert "fb-again" in got and "fb-1" not in got and "fb-gone" not in got and "p1-title" in got
    assert got["fb-near"].group_id == got["fb-2"].group_id and got["fb-near"].split == got["fb-2"].split
    assert got["p1"].split == "test" and got["p0"].split == "train" and {r.split for r in got.values()} <= {"train", "calibration", "test"}


def test_other_jobs(spark, tmp_path):
    reports = spark.createDataFrame([("url_gov", "Low"), ("url_lookalike", "Low")], "name string, level string")
    got = {r.name: r.passed for r in jobs.scenario_report(reports).collect()}
    assert got["url_gov"] and not got["url_lookalike"] and not got["img_blank"] and len(got) == len(jobs.SCENARIOS)
    jobs.write_document({"a": "é"}, str(tmp_path / "x" / "r.json"))
    assert evidence.read_model(str(tmp_path / "x" / "r.json")) == {"a": "é"} and evidence.read_model(str(tmp_path / "none")) is None
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["r.json"]
    assert scorer.model_card(None)["status"] == "unavailable"


def test_statement_cache(spark):
    cases = spark.createDataFrame([("a", "a text that is long enough"), ("b", "another text, long enough"), ("c", "short")], "case_id string, text string")
    answers = cases.where("case_id = 'a'").select(evidence.statement_key("m", "v1", F.col("text")).alias("key"), F.lit("{}").alias("answer"))
    got = {r.case_id: (r.answer, r.pending) for r in evidence.with_statements(cases, answers, "m", "v1").collect()}
    assert got == {"a": ("{}", False), "b": (None, True), "c": (None, False)}
    other = {r.case_id: r.pending for r in evidence.with_statements(cases, answers, "m", "v2").collect()}
    assert other == {"a": True, "b": True, "c": False}


def test_behavioural_cases_are_padded_and_filtered(spark):
    tests = spark.createDataFrame([("trap", "Normal", ["real words of a post"], ["Home", "Search", "More", "Help", "About"]), ("plain", "Fraud", ["x y z w", "q r s t"], None)], "type string, expect string, texts array<string>, padding array<string>")
    got = sorted((r.type, r.raw, r.text) for r in experiment.behavioural_cases(tests).collect())
    assert got == [("plain", "q r s t", "q r s t"), ("plain", "x y z w", "x y z w"), ("trap", "Home\nSearch\nMore\nHelp\nreal words of a post\nAbout", "real words of a post")]


def test_landmarks_and_regions(spark):
    items = [("Log in now", "nav", [[0.0, 0.0, 50.0, 10.0]]), ("加line領取", "button", [[0.0, 20.0, 50.0, 30.0]]), ("First line\nSecond line", None, [[10.0, 40.0, 60.0, 90.0], [10.0, 50.0, 70.0, 95.0]])]
    df = spark.createDataFrame([(items, [("Second line", 0.4), ("absent", 0.1), ("First line", None)])], "i array<struct<text:string,region:string,boxes:array<array<double>>>>, s array<struct<text:string,delta:double>>")
    f = df.select(screen.filtered(screen.landmark_reasons(F.col("i"))).alias("f")).first().f
    assert f.text == "加line領取\nFirst line\nSecond line" and [x.reason for x in f.removed] == ["landmark:nav"]
    r = df.select(screen.segment_regions(F.col("s"), F.col("i"), F.lit(100.0), F.lit(200.0)).alias("r")).first().r
    assert [(x.text, x.left, x.top, x.width, x.height) for x in r] == [("Second line", 10.0, 20.0, 60.0, 27.5)]


def test_brands_misread_from_pictures(spark):
    df = spark.createDataFrame([("賣貨便 now", ["7-1l.c0m.tw"]), ("賣貨便 now", ["evil.shop"]), ("賣貨便 now", ["7-11.com.tw"]), ("賣貨便 now", ["bit.ly"]), (None, None)], "t string, d array<string>")
    got = [r[0] for r in df.select(brands.brand_mismatch(F.col("t"), F.col("d"))).collect()]
    assert got == [[], ["賣貨便"], [], [], []]


def test_text_rules(spark):
    one = lambda c, *v, schema: spark.createDataFrame([v], schema).coalesce(1).select(c).first()[0]
    assert one(text.clean_text(F.col("t")), "受害者2： 你好\n  客服:  hello。\n\r\tx", schema="t string") == "你好 hello x"
    assert one(text.clean_text(F.col("t"), ("们", "們")), "他们", schema="t string") == "他們"
    assert one(text.html_to_text(F.col("t")), "<p>caf&eacute; &#x27;x&#39;&nbsp;&amp;</p>", schema="t string") == "café 'x' &"
    assert one(text.changed_share(F.col("t"), "们"), "们" * 5 + "甲" * 20, schema="t string") == pytest.approx(0.2)
    assert one(evidence.editor_tag(F.col("m")), {"Software": "Adobe Photoshop 25"}, schema="m map<string,string>") == "photoshop"
    assert one(urls.public_address(F.col("h"), F.lit(False)), "10.1.2.3", schema="h string") == "not_public"
    assert one(urls.public_address(F.col("h"), F.lit(False)), "8.8.8.8", schema="h string") is None


def test_folders_are_removed(spark):
    import os

    clean_up(spark)
    kept = stored(spark.range(5), "few")
    folder = new_folder(spark, "none")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(path) and folder != path
    assert clean_up(spark) == 2 and not os.path.exists(path)


def test_training_job(spark, tmp_path):
    rng = random.Random(5)
    good, bad = ["meeting notes for monday", "the weather is fine", "read this book"], ["send money to win a prize", "guaranteed profit today", "transfer cash now"]
    rows = [{"case_id": f"c{i}", "group_id": f"g{i // 2}", "split": ["train", "train", "calibration", "test"][i // 4 % 4], "label": "Fraud" if i % 2 else "Normal", "label_source": "s", "reviewer": "r", "source_url": "u", "texts": {"dom": " ".join(rng.choices(bad if i % 2 else good, k=3))}} for i in range(64)]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(r) for r in rows))
    jobs.main(["train", "--corpus", str(tmp_path / "c.json"), "--output", str(tmp_path / "out")])
    made = spark.read.json(str(tmp_path / "out" / "manifest")).collect()
    assert len(made) == 64 and sum(r.result.prediction == r.label for r in made) >= 60
    report = json.loads((tmp_path / "out" / "provenance.json").read_text())
    assert report["provenance"]["cases"] == 64 and set(report["training"]["losses"]) == {"0.1", "1.0", "10.0"}
    (tmp_path / "d.json").write_text("\n".join(json.dumps(dict(r, label="Fraud")) for r in rows))
    with pytest.raises(ValueError):
        jobs.main(["train", "--corpus", str(tmp_path / "d.json"), "--output", str(tmp_path / "out2")])


def test_reports_replies_and_choices(spark, tmp_path):
    from sievework.operators import parsing, reports
    from sievework.sources import files

    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"level": "High"}')
    (tmp_path / "r/b.json").write_text("broken")
    documents = files.json_documents(spark, str(tmp_path / "r"), "level string")
    cases = spark.createDataFrame([("1", "reports/a.json"), ("2", "reports/b.json"), ("3", "c.json")], "case_id string, report_path string")
    got = {r.case_id: r.doc and r.doc.level for r in experiment.reports_of(cases, documents).collect()}
    assert got == {"1": "High", "2": None, "3": None}
    page = '<span class="f3 push-content">: good <b>idea</b></span><span class="f3 push-content">: see &lt;this&gt; http://x</span>'
    replies = parsing.reply_lines(spark.createDataFrame([("p", page)], "post string, html string"), "post", "html").orderBy("order").collect()
    assert [r.text for r in replies] == ["good idea", "see <this> http://x"]
    one = lambda c, *v, schema: spark.createDataFrame([v], schema).coalesce(1).select(c).first()[0]
    top = one(reports.top_reasons(F.col("c"), 2), [("text_logit", 1.7), ("unheard_of", -0.6), ("urgency", 0.1)], schema="c array<struct<name:string,value:double>>")
    assert [(x.label, x.strength) for x in top] == [("MacBERT（帳號文字）", "strong"), ("unheard_of", "medium")]
    view = "struct<text:string,viewport:struct<width:int>,items:array<string>,truncated:boolean>"
    states = [(("t", (9,), ["a"], False), ("t", (9,), ["a"], None), True), (("t", (9,), ["a"], False), ("t", (9,), ["b"], False), False), (("t", (9,), None, True), ("t", (9,), None, False), False)]
    df = spark.createDataFrame(states, f"a {view}, b {view}, want boolean")
    assert all(r[0] == r.want for r in df.select(screen.stable_viewport(F.col("a"), F.col("b")), "want").collect())
    assert evidence.choose_model("m", "m", str(tmp_path / "none"), "w2", "w1") == ("m", "w1")
    (tmp_path / "adapted").mkdir()
    (tmp_path / "adapted/config.json").write_text("{}")
    (tmp_path / "w2.json").write_text("{}")
    chosen = (str(tmp_path / "adapted"), str(tmp_path / "w2.json"))
    assert evidence.choose_model("m", "m", *chosen, "w1") == chosen and evidence.choose_model("other", "m", *chosen, "w1") == ("other", "w1")
    (tmp_path / "l.json").write_text('{"id":"1","label":"Fraud"}\n{"id":"2","label":"Odd"}\nbroken\n')
    assert files.tolerant_json_lines(spark, str(tmp_path / "l.json"), "id string, label string", ["Fraud", "Normal"]).count() == 1


def test_decisions_fall_back_to_the_agreement(spark):
    model = {"feature_names": evidence.feature_names(["text"]), "weights": [2.0, 0.0], "bias": 0.0, "conformal": {"q_fraud": 0.6, "q_normal": 0.6}}
    rows = [(("SUCCESS", "Fraud", 0.95, None), ("Unknown", "modality_conflict")), (("FAILED", None, None, None), ("Normal", "modalities_agree"))]
    df = spark.createDataFrame(rows, f"t {evidence.MODEL_RESULT}, a struct<prediction:string,basis:string>").withColumn("o", F.lit(None).cast(evidence.MODEL_RESULT))
    none = F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<int>")
    for fitted, want in ((model, [("Fraud", "conformal_singleton"), ("Normal", "modalities_agree")]), (None, [r[1] for r in rows])):
        got = df.select(evidence.decide_content(F.col("t"), F.col("o"), *none, F.col("a"), fitted).alias("d")).collect()
        assert [(r.d.prediction, r.d.basis) for r in got] == want
    assert evidence.sign_bounds(["urgency", "llm_missing", "large_audience"]) == (["urgency"], ["large_audience"])
