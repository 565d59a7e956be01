"""Jobs from the command line: python -m sievework.jobs JOB --option value. Each reads tables and writes tables; they share no state."""

from __future__ import annotations

import argparse
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.functions.text import nfkc, shingles, word_key
from sievework.models.training import score_corpus, train_scorer
from sievework.operators import dataset, experiment, parsing, review, similarity
from sievework.operators.evidence import decide, read_model
from sievework.runtime import cut, session
from sievework.sources import files

CASE = "case_id string, source string, text string, image_path string, label string, label_kind string, label_source string, source_url string, category string, platforms array<string>, reported_at string"
POST = "case_id string, text string, label string, board string, group_id string, source_url string"
# Scenarios by name, with the risk levels that are right for each.
SCENARIOS = {
    "url_dcard_ig": ["Low", "Unknown", "Medium"],
    "url_165_listed": ["High"],
    "url_lookalike": ["High"],
    "url_gov": ["Low", "Unknown", "Medium"],
    "url_unresolvable": ["Unknown"],
    "img_myship_fake": ["High"],
    "img_myship_real": ["Low", "Unknown", "Medium"],
    "img_listed_165": ["High"],
    "img_line_chat": ["Low", "Unknown"],
    "img_blank": ["Unknown"],
}


def build_manifest(cases: DataFrame, posts: DataFrame | None = None, replies: DataFrame | None = None, max_fraud: int = 900, max_per_group: int = 10, per_board: int = 80, seed: int = 0) -> DataFrame:
    """Cases without reposts, capped per platform and group, split by groups; posts, their titles and replies beside them, split by boards."""
    key = word_key(nfkc("text"))
    rows = dataset.latest_of_reposts(cases, key, [F.desc("reported_at"), F.col("case_id")])
    platform = parsing.first_platform(F.col("platforms"))
    fraud = dataset.first_n_per(rows.where("label = 'Fraud'").withColumn("platform", platform), ["platform"], max_fraud, [F.desc("reported_at"), F.col("case_id")])
    rows = cut(fraud.unionByName(rows.where("label = 'Normal'").withColumn("platform", platform)))
    keys = rows.select(F.col("case_id").alias("case"), F.explode(parsing.identity_keys(F.col("case_id"), F.col("text"))).alias("key"))
    sets = rows.select(F.col("case_id").alias("id"), word_key(nfkc("text")).alias("k")).select("id", shingles(F.col("k")).alias("items"))
    equal = similarity.equal_sets(sets.where(F.size("items") > 0)).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    near = similarity.jaccard_pairs(sets).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(equal)
    grouped = rows.join(dataset.key_groups(keys, near).select(F.col("case").alias("case_id"), F.substring(F.sha1(F.col("group").cast("binary")), 1, 12).alias("group_id")), "case_id")
    capped = cut(dataset.hash_capped(grouped, ["group_id"], max_per_group, "case_id", seed))
    splits = dataset.stratified_split(capped.select(F.col("group_id").alias("group"), F.concat_ws("/", "label", "platform").alias("stratum")), seed=seed)
    parts = [capped.join(splits.withColumnRenamed("group", "group_id"), "group_id")]
    if posts is not None:
        held = parsing.board_split(F.col("board"))
        more = [posts.withColumn("label_kind", F.lit("presumed_normal_hard_negative")), parsing.title_cases(posts).withColumn("label_kind", F.lit("presumed_normal_hard_negative_title"))]
        if replies is not None:
            more.append(dataset.hash_capped(replies, ["board"], per_board, "case_id", seed).withColumn("label_kind", F.lit("presumed_normal_hard_negative_chat")))
        parts += [m.withColumn("source", F.lit("ptt")).withColumn("weight_group", F.col("source_url")).withColumn("split", held) for m in more]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Cases by source, split and label, and official cases by platform, label and split, in one pass."""
    manifest.createOrReplaceTempView("sw_manifest")
    return manifest.sparkSession.sql("SELECT source, platform, split, label, count(*) AS cases, count(DISTINCT group_id) AS groups FROM sw_manifest GROUP BY GROUPING SETS ((source, split, label), (platform, label, split))")


def scenario_report(reports: DataFrame, expected: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, level, passed) for every scenario; one without a report fails."""
    expected = expected or SCENARIOS
    want = reports.sparkSession.createDataFrame(list(expected.items()), "name string, levels array<string>")
    return F.broadcast(want).join(reports.select("name", "level"), "name", "left").select("name", "level", F.coalesce(F.array_contains("levels", F.col("level")), F.lit(False)).alias("passed"))


def write_document(value: dict, path: str) -> None:
    """A JSON document, whole or not at all: written beside its place and then moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_name(f".{target.name}.tmp")
    temp.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    temp.replace(target)


def dataset_job(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = files.keyed_json_lines(spark, a.cases, CASE, "case_id")
    posts = files.keyed_json_lines(spark, a.posts, POST, "case_id") if a.posts else None
    replies = files.keyed_json_lines(spark, a.replies, POST, "case_id") if a.replies else None
    manifest = cut(build_manifest(parsing.official_cases(raw), posts, replies, a.max_fraud, a.max_per_group, seed=a.seed))
    files.write_json_lines(manifest, a.output)
    manifest_counts(manifest).show(200, False)


def domains_job(spark: SparkSession, a: argparse.Namespace) -> None:
    listed = files.commented_table(spark, a.blocklist) if a.blocklist else None
    hosts = files.commented_list(spark, a.hosts)
    files.write_json_lines(urls.assess_domains(hosts.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url")), listed), a.output)


def decide_job(spark: SparkSession, a: argparse.Namespace) -> None:
    model = read_model(a.model)
    if model is None:
        raise SystemExit("no model to read")
    rows = spark.read.parquet(a.features)
    rows.select("case_id", decide(F.col("features"), model).alias("decision")).write.mode("overwrite").parquet(a.output)


def review_job(spark: SparkSession, a: argparse.Namespace) -> None:
    queue = review.with_reviews(spark.read.json(a.queue), spark.read.json(a.reviews))
    print(review.build_corpus(queue, a.output), "rows")


def train_job(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train the default scorer on a reviewed corpus, and score the corpus with it."""
    rows = spark.read.json(a.corpus, schema="case_id string, group_id string, split string, label string, label_source string, reviewer string, source_url string, texts map<string,string>")
    text = F.array_join(F.map_values("texts"), "\n")
    scorer, report = train_scorer(rows.withColumn("text", text))
    manifest, provenance = score_corpus(rows, scorer)
    manifest.write.mode("errorifexists").json(f"{a.output}/manifest")
    write_document({"training": report, "provenance": provenance}, f"{a.output}/provenance.json")


def metrics_job(spark: SparkSession, a: argparse.Namespace) -> None:
    experiment.method_metrics(spark.read.parquet(a.predictions), a.methods).write.mode("overwrite").json(a.output)


def scenarios_job(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = scenario_report(spark.read.json(a.reports)).collect()
    for r in rows:
        print("PASS" if r.passed else "FAIL", r.name, r.level)
    if not all(r.passed for r in rows):
        raise SystemExit(1)


JOBS = {
    "dataset": (dataset_job, {"cases": ..., "posts": None, "replies": None, "output": ..., "max_fraud": 900, "max_per_group": 10, "seed": 0}),
    "domains": (domains_job, {"hosts": ..., "blocklist": None, "output": ...}),
    "decide": (decide_job, {"features": ..., "model": ..., "output": ...}),
    "review": (review_job, {"queue": ..., "reviews": ..., "output": ...}),
    "train": (train_job, {"corpus": ..., "output": ...}),
    "metrics": (metrics_job, {"predictions": ..., "methods": [], "output": ...}),
    "scenarios": (scenarios_job, {"reports": ...}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework.jobs", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name, (_, options) in JOBS.items():
        j = jobs.add_parser(name)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if isinstance(default, list):
                j.add_argument(flag, nargs="+", required=True)
            elif isinstance(default, int):
                j.add_argument(flag, type=int, default=default)
            else:
                j.add_argument(flag, required=default is ..., default=None)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    JOBS[a.job][0](session(f"sievework-{a.job}"), a)


if __name__ == "__main__":
    main()
