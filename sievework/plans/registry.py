"""Queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import stats, text, urls
from sievework.operators import dataset, decision, fusion, images, links, metrics, segments, signals, similarity
from sievework.operators.components import connected_components
from sievework.runtime import cut, spread, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def docs(spark, d):
    return spread(table(spark, d, "documents"))


def labelled(spark, d):
    """Labelled documents as cases with a score that SQL can make too."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    p = F.round((F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(101)) + F.col("toxic") * 40) / 141.0, 6)
    return rows.select("doc_id", "source", "lang", F.col("toxic").alias("y"), F.when(F.col("toxic") == 1, "Fraud").otherwise("Normal").alias("label"), p.alias("p"))


LABELLED = "l AS (SELECT doc_id, source, lang, toxic AS y, CASE WHEN toxic = 1 THEN 'Fraud' ELSE 'Normal' END AS label, round(((n_chars * 37 + doc_id * 11) % 101 + toxic * 40) / 141.0, 6) AS p FROM documents JOIN labels USING (doc_id))"
HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)"
KEY = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')"


def flagship(spark, sf_dir):
    """Pages by domain risk, with how much text they show."""
    return host_risk(spark, sf_dir)


@query(f"""
WITH u AS (SELECT page_id, lower(split_part(url, ':', 1)) AS scheme, {HOST} AS host FROM pages),
s AS (SELECT page_id, scheme, host, CASE WHEN scheme = 'http' THEN 15 ELSE 0 END + CASE WHEN host LIKE '%xn--%' THEN 15 ELSE 0 END AS score FROM u)
SELECT host, count(*) AS pages, max(score) AS risk_score, CASE WHEN max(score) >= 60 THEN 'High' WHEN max(score) >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level FROM s GROUP BY host
""")
def host_risk(spark, d):
    p = table(spark, d, "pages").select("page_id", urls.parts(F.col("url")).alias("p")).select("page_id", "p.*")
    score = urls.domain_risk(F.lit(False), F.lit(False), F.col("scheme"), F.col("host"), F.col("credentials"), F.col("port"))
    out = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.max(score).alias("risk_score"))
    return out.withColumn("risk_level", urls.risk_level(F.col("risk_score")))


@query()
def domain_assessment(spark, d):
    listed = spark.createDataFrame([("example.org", "11501")], "domain string, listed_since string")
    return urls.assess_domains(table(spark, d, "pages").select("page_id", "url"), listed)


@query(f"""
WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages), l AS (SELECT host, string_split(host, '.') AS ls FROM h),
s AS (SELECT host, ls, unnest(range(0, greatest(len(ls) - 1, 0))) AS depth FROM l)
SELECT array_to_string(ls[depth + 1:], '.') AS domain, count(*) AS hosts, min(depth) AS least_depth FROM s GROUP BY 1
""")
def parent_domains(spark, d):
    h = table(spark, d, "pages").select(urls.parts(F.col("url"))["host"].alias("host")).distinct()
    walked = h.select("host", F.posexplode(urls.suffixes(F.col("host"))).alias("depth", "domain"))
    return walked.groupBy("domain").agg(F.count(F.lit(1)).alias("hosts"), F.min("depth").cast("long").alias("least_depth"))


@query(f"SELECT regexp_extract({HOST}, '([^.]+)$', 1) AS tld, count(*) AS pages FROM pages GROUP BY 1 ORDER BY pages DESC, tld LIMIT 10")
def tld_topk(spark, d):
    tld = urls.top_label(urls.parts(F.col("url"))["host"]).alias("tld")
    return table(spark, d, "pages").groupBy(tld).agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "tld").limit(10)


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY href) AS rank FROM (SELECT DISTINCT page_id, href FROM h)) WHERE rank <= 4
""")
def page_links_ranked(spark, d):
    hrefs = spread(table(spark, d, "pages")).select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("href"))
    return hrefs.withColumn("rank", rank.cast("long")).where("rank <= 4")


@query()
def links_in_pages(spark, d):
    p = spread(table(spark, d, "pages")).withColumn("page_host", urls.parts(F.col("url"))["host"])
    found = p.select(F.col("page_id").alias("page"), "page_host", F.explode(links.urls_in_text(text.html_to_text(F.col("html")))).alias("url"), F.lit("text").alias("source"))
    return links.rank_links(found)


@query(f"SELECT doc_id, length({KEY}) AS key_chars, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum, md5({KEY}) AS key_md5 FROM documents")
def norm_text_stats(spark, d):
    t = docs(spark, d).withColumn("text", text.nfkc("text"))
    return t.select("doc_id", F.length(text.word_key(F.col("text"))).cast("long").alias("key_chars"), text.alnum_count(F.col("text")).cast("long").alias("alnum"), F.md5(text.word_key(F.col("text"))).alias("key_md5"))


@query(f"SELECT doc_id, substr(k, 1, 120) AS key FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY substr(k, 1, 120) ORDER BY doc_id DESC) AS n FROM (SELECT doc_id, {KEY} AS k FROM documents)) WHERE n = 1 OR k = ''")
def exact_repost_dedup(spark, d):
    keyed = docs(spark, d).select("doc_id", text.word_key(text.nfkc("text")).alias("k"))
    return dataset.latest_of_reposts(keyed, F.col("k"), [F.desc("doc_id")]).select("doc_id", F.substring("k", 1, 120).alias("key"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 50")
def platform_cap(spark, d):
    return dataset.first_n_per(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 50, [F.desc("doc_id")])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS n FROM documents) WHERE n <= 20")
def hash_group_cap(spark, d):
    return dataset.hash_capped(table(spark, d, "documents").select("doc_id", "source"), ["source"], 20, "doc_id")


@query(f"""
WITH {LABELLED}, g AS (SELECT DISTINCT doc_id % 50 AS g, label || coalesce('/' || lang, '') AS s FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('0|' || g), g) AS i, count(*) OVER (PARTITION BY s) AS n FROM g)
SELECT g AS "group", arg_min(CASE WHEN i <= round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.8::DOUBLE, 0) THEN 'calibration' ELSE 'test' END, s) AS split FROM n GROUP BY g
""")
def group_split(spark, d):
    g = labelled(spark, d).select((F.col("doc_id") % 50).alias("group"), F.concat_ws("/", "label", "lang").alias("stratum"))
    return dataset.stratified_split(g)


@query(f"WITH {LABELLED} SELECT source, label, lang, count(*) AS n FROM l GROUP BY GROUPING SETS ((source, label), (lang, label), (label))")
def grouping_sets_counts(spark, d):
    labelled(spark, d).createOrReplaceTempView("sw_labelled")
    return spark.sql("SELECT source, label, lang, count(*) AS n FROM sw_labelled GROUP BY GROUPING SETS ((source, label), (lang, label), (label))")


@query(f"""
WITH {LABELLED}, w AS (SELECT doc_id, label, 1.0 / count(*) OVER (PARTITION BY source) AS w FROM l),
t AS (SELECT label, sum(w) AS c FROM w GROUP BY label)
SELECT doc_id, round(w * (SELECT sum(c) FROM t) / ((SELECT count(*) FROM t) * c), 6) AS weight FROM w JOIN t USING (label)
""")
def class_balanced_weights(spark, d):
    w = dataset.balanced_weights(labelled(spark, d), "source", "label")
    return w.select("doc_id", F.round("weight", 6).alias("weight"))


PREDICTED = "CASE WHEN p >= 0.6 THEN 'Fraud' WHEN p <= 0.4 THEN 'Normal' ELSE 'Unknown' END"


@query(f"""
WITH {LABELLED}, q AS (SELECT *, {PREDICTED} AS g FROM l),
c AS (SELECT lang, count(*) FILTER (label = 'Fraud' AND g = 'Fraud') AS tp, count(*) FILTER (label = 'Normal' AND g = 'Fraud') AS fp, count(*) FILTER (label = 'Normal' AND g = 'Normal') AS tn, count(*) FILTER (label = 'Fraud' AND g <> 'Fraud') AS fn, count(*) FILTER (g = 'Unknown') AS unknown, count(*) AS n FROM q GROUP BY lang)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + tn) / n, 6) AS accuracy, round(unknown / n, 6) AS unknown_rate FROM c
""")
def confusion_metrics(spark, d):
    p = F.when(F.col("p") >= 0.6, "Fraud").when(F.col("p") <= 0.4, "Normal").otherwise("Unknown")
    return metrics.confusion(labelled(spark, d).withColumn("prediction", p), by=["lang"])


@query(f"WITH {LABELLED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT p FROM l WHERE y = 1) a, (SELECT p FROM l WHERE y = 0) b")
def auc_ties(spark, d):
    return metrics.auc(labelled(spark, d), "y", "p")


@query(f"WITH {LABELLED} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share FROM l GROUP BY 1")
def reliability_bins(spark, d):
    return metrics.reliability(labelled(spark, d), "y", "p")


@query(f"""
WITH {LABELLED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS w, sum(y) AS wy, sum(p) AS wp, sum((p - y) * (p - y)) AS b, sum(-(y * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, p))))) AS l FROM l GROUP BY 1)
SELECT round(sum(b) / sum(w), 6) AS brier, round(sum(l) / sum(w), 6) AS log_loss, round(sum(abs(wp - wy)) / sum(w), 6) AS ece FROM b
""")
def ece_brier(spark, d):
    return metrics.calibration_scores(labelled(spark, d), "y", "p")


@query(f"""
WITH {LABELLED}, s AS (SELECT y AS label, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s) AS i, count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT label, max(n) AS n, round(coalesce(max(s) FILTER (i = ceil(round((n + 1) * 0.9, 9))), 1.0), 6) AS q FROM r GROUP BY label
""")
def conformal_quantiles(spark, d):
    return metrics.conformal_quantiles(labelled(spark, d), "y", "p")


@query(f"""
WITH {LABELLED}, s AS (SELECT doc_id, p, 1 - p <= 0.7 AS f, p <= 0.8 AS n FROM l)
SELECT doc_id, CASE WHEN (f AND n) OR (f AND NOT n AND p <= 0.5) OR (n AND NOT f AND p > 0.5) THEN 'Fraud,Normal' WHEN f THEN 'Fraud' WHEN n THEN 'Normal' ELSE '' END AS members FROM s
""")
def conformal_sets(spark, d):
    return labelled(spark, d).select("doc_id", F.array_join(metrics.conformal_set(F.col("p"), F.lit(0.7), F.lit(0.8)), ",").alias("members"))


@query(f"""
WITH {LABELLED}, g AS (SELECT range AS i, 0.25 + range * 0.05 AS t FROM range(156)),
z AS (SELECT y, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z FROM l),
n AS (SELECT i, t, avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-z / t))))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-z / t))))))) AS nll FROM z, g GROUP BY i, t)
SELECT round(t::DOUBLE, 6) AS temperature, round(nll, 6) AS nll FROM n ORDER BY round(nll, 9), i LIMIT 1
""")
def temperature_grid(spark, d):
    return metrics.best_temperature(labelled(spark, d), "y", "p")


POISSON = list(accumulate(exp(-1) / factorial(k) for k in range(8)))  # shares of draws of at most 0 to 7


@query(f"""
WITH {LABELLED}, p AS (SELECT source, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM l GROUP BY source),
u AS (SELECT *, ('0x' || substr(md5('7|' || rep || coalesce('|' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p, (SELECT range AS rep FROM range(1000))),
k AS (SELECT *, {" + ".join(f"(u > {c})::INT" for c in POISSON)} AS k FROM u),
f AS (SELECT rep, sum(tp * k) AS tp, sum(fp * k) AS fp, sum(fn * k) AS fn FROM k GROUP BY rep), s AS (SELECT list_sort(list(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE)) AS a FROM f)
SELECT round(a[24 + 1], 6) AS low, round(a[974 + 1], 6) AS high FROM s
""")
def bootstrap_interval(spark, d):
    p = F.when(F.col("p") >= 0.5, "Fraud").otherwise("Normal")
    parts = metrics.confusion(labelled(spark, d).withColumn("prediction", p), by=["source"])
    return metrics.cluster_bootstrap(parts, "source", reps=1000)


@query(f"WITH {LABELLED} SELECT doc_id, round(1 / (1 + exp(-(ln(greatest(1e-9, least(1 - 1e-9, p)) / (1 - greatest(1e-9, least(1 - 1e-9, p)))) + ln(0.05 / 0.95) - ln(0.5 / 0.5)))), 6) AS p FROM l")
def prior_shift(spark, d):
    return labelled(spark, d).select("doc_id", F.round(stats.prior_shift(F.col("p"), 0.5, 0.05), 6).alias("p"))


SIGNAL_SQL = {"mail_contact": "[a-z0-9._-]+@[a-z0-9-]+\\.[a-z]+", "address_literal": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "phone_like": "[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}", "token_assignment": "(?:token|password|api_key) ?[=:]", "rights_notice": "all rights reserved|copyright"}


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN 1 ELSE 0 END AS {n}" for n, p in SIGNAL_SQL.items()) + ", round(" + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w} ELSE 0 END" for p, w in zip(SIGNAL_SQL.values(), (2.0, 1.5, 1.0, 2.0, -1.0))) + ", 6)::DOUBLE AS rule_score FROM documents")
def signal_flags(spark, d):
    s = docs(spark, d).select("doc_id", signals.pattern_signals(F.col("text"), signals.LATIN_PATTERNS).alias("s"))
    flags = [F.array_contains(F.transform("s", lambda x: x["signal"]), n).cast("int").alias(n) for n in signals.LATIN_PATTERNS]
    return s.select("doc_id", *flags, F.round(signals.rule_score(F.col("s")), 6).alias("rule_score"))


@query("""
WITH c AS (SELECT a.doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(a.text), '[^\\p{L}\\p{N}_]+', '', 'g'), ''), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}_]+', '', 'g'), ''), lambda x: x <> '')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS overlap FROM c
""")
def char_overlap_jaccard(spark, d):
    a, b = docs(spark, d).alias("a"), table(spark, d, "documents").alias("b")
    both = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return both.select(F.col("a.doc_id").alias("doc_id"), F.round(text.char_jaccard(F.col("a.text"), F.col("b.text")), 6).alias("overlap"))


@query('SELECT o_orderkey AS "case", min(o_orderkey) OVER (PARTITION BY o_custkey) AS "group" FROM orders')
def shared_key_groups(spark, d):
    return dataset.key_groups(table(spark, d, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_custkey").alias("key")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey + 1000000 AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT a, a FROM e UNION ALL SELECT b, b FROM e),
r AS (SELECT DISTINCT u, u AS c, 0 AS i FROM s UNION ALL SELECT s.u, min(r.c), r.i + 1 FROM r JOIN s ON s.v = r.u WHERE r.i < 12 GROUP BY s.u, r.i)
SELECT u AS node, c AS component FROM r WHERE i = 12
""")
def components_of_parts(spark, d):
    """Parts and suppliers that lines connect. The SQL twin takes twelve steps from every node, which is beyond the width of these graphs."""
    return connected_components(table(spark, d, "lineitem").select((F.col("l_partkey") + 1000000).alias("src"), F.col("l_suppkey").alias("dst")))


def gram_classes(spark, d):
    return similarity.gram_members(docs(spark, d).select(F.col("doc_id").alias("id"), text.nfkc("text").alias("t")).select("id", text.word_key(F.col("t")).alias("key")))


@query()
def near_dup_pairs(spark, d):
    """Pairs of classes by their least documents; near_dup_members says which documents a class has."""
    _, classes = gram_classes(spark, d)
    return similarity.gram_pairs(classes).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def near_dup_members(spark, d):
    """(id, rep, links): each document with shingles, its class, and how many other documents are near it or equal in shingles."""
    members, classes = gram_classes(spark, d)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    near = similarity.gram_links(classes)
    links = sizes.join(near, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(links, "rep").select("id", "rep", "links")


@query("""
WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS ws FROM documents), b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS ws FROM benchmark),
x AS (SELECT doc_id, unnest(ws) AS i FROM w), y AS (SELECT item_id, unnest(ws) AS i FROM b)
SELECT doc_id AS id, item_id AS other, count(*) AS shared FROM x JOIN y USING (i) GROUP BY ALL HAVING count(*) >= 12
""")
def benchmark_overlap(spark, d):
    words = lambda t, key, name: t.select(F.col(key).alias("id"), F.split("text", " ").alias("items"))
    return similarity.shared_items(words(docs(spark, d), "doc_id", "id"), words(table(spark, d, "benchmark"), "item_id", "other"), least=12)


@query("""
WITH k AS (SELECT conv_id, turn, text FROM conversations WHERE length(text) >= 4 AND NOT contains(text, 'http')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM k)
SELECT conv_id, i // 3 AS "window", string_agg(text, chr(10) ORDER BY i) AS text FROM n WHERE i < 12 GROUP BY 1, 2 HAVING count(*) = 3
""")
def chat_windows(spark, d):
    return dataset.chat_windows(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(f"WITH {LABELLED}, s AS (SELECT source, CASE WHEN doc_id % 7 < 4 OR source = 'web' THEN 'train' ELSE 'test' END AS split FROM l) SELECT source, count(DISTINCT split) AS splits FROM s GROUP BY source HAVING count(DISTINCT split) > 1")
def leakage_violations(spark, d):
    return dataset.leaks(labelled(spark, d).withColumn("split", F.when((F.col("doc_id") % 7 < 4) | (F.col("source") == "web"), "train").otherwise("test")), "source")


@query(f"WITH {LABELLED}, x AS (SELECT doc_id, greatest(-8.0, least(8.0, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))))) / 4 AS a, least(doc_id % 7, 4) / 2 AS b FROM l) SELECT doc_id, round(1 / (1 + exp(-(0.9 * a + 0.4 * b - 0.3))), 6) AS score FROM x")
def fusion_score(spark, d):
    z, _ = fusion.score_features(F.col("p"))
    x = F.array(z, fusion.capped_half((F.col("doc_id") % 7).cast("double")))
    return labelled(spark, d).select("doc_id", F.round(fusion.linear_score(x, [0.9, 0.4], -0.3), 6).alias("score"))


@query(f"""
WITH {LABELLED}, s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Unavailable' WHEN p = 0.5 THEN 'Uncertain' WHEN p < 0.5 THEN 'Normal' ELSE 'Fraud' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'Unavailable' WHEN 1 - p = 0.5 OR doc_id % 4 = 1 THEN 'Uncertain' WHEN doc_id % 2 = 0 THEN 'Normal' ELSE 'Fraud' END AS b FROM l)
SELECT doc_id, CASE WHEN a = 'Unavailable' AND b = 'Unavailable' THEN 'Unknown/no_usable_model_evidence' WHEN a NOT IN ('Fraud', 'Normal') AND b NOT IN ('Fraud', 'Normal') THEN 'Unknown/tied_or_invalid_scores' WHEN a IN ('Fraud', 'Normal') AND b IN ('Fraud', 'Normal') AND a <> b THEN 'Unknown/modality_conflict' WHEN a = 'Unavailable' THEN b || '/single_modality' WHEN b = 'Unavailable' THEN a || '/single_modality' WHEN a = 'Uncertain' OR b = 'Uncertain' THEN 'Unknown/tied_or_invalid_source' ELSE a || '/modalities_agree' END AS decision FROM s
""")
def source_fusion(spark, d):
    ok = lambda c: F.when(c, "SUCCESS").otherwise("FAILED")
    a = decision.source_decision(ok(F.col("doc_id") % 5 != 0), F.lit("Fraud"), F.col("p"))
    q = F.when((1 - F.col("p") == 0.5) | (F.col("doc_id") % 4 == 1), 0.5).when(F.col("doc_id") % 2 == 0, 0.1).otherwise(0.9)
    b = decision.source_decision(ok(F.col("doc_id") % 3 != 0), F.lit("Normal"), q)
    both = labelled(spark, d).select("doc_id", a.alias("a"), b.alias("b")).withColumn("f", decision.fuse_sources(F.col("a"), F.col("b")))
    return both.select("doc_id", F.concat_ws("/", "f.prediction", "f.basis").alias("decision"))


@query(f"""
WITH {LABELLED}, r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'High/domain_rule' WHEN doc_id % 7 = 0 THEN 'Unknown/page_unusable' WHEN doc_id % 5 = 0 THEN 'Unknown/insufficient_evidence' WHEN p > 0.5 THEN 'Medium/content_model_signal' WHEN doc_id % 3 = 0 THEN 'Unknown/normal_with_rule_signal' WHEN doc_id % 2 = 0 THEN 'Low/limited_content_evidence' ELSE 'Unknown/single_modality_normal_insufficient' END AS r FROM l)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 AND r NOT LIKE 'High%' THEN 'High/redirect_rule' WHEN doc_id % 6 = 0 AND (r LIKE 'Low%' OR r LIKE 'Unknown%') THEN 'Medium/redirect_heuristic' ELSE r END AS risk FROM r
""")
def decision_chain(spark, d):
    i = F.col("doc_id")
    base = decision.base_risk(F.when(i % 11 == 0, 80).otherwise(15), i % 11 != 0, F.when(i % 7 == 0, "unusable").otherwise("success"), F.when(i % 5 == 0, "FAILED").otherwise("SUCCESS"), F.when(F.col("p") > 0.5, "Fraud").otherwise("Normal"), F.when(i % 2 == 0, "modalities_agree").otherwise("single_modality"), i % 3 == 0)
    no = F.lit(False)
    raised = decision.escalate(F.col("r"), worst_link=F.when(i % 13 == 0, "high").otherwise("none"), risky_links=F.when(i % 6 == 0, 1).otherwise(0), blocked_shots=no, brand_mismatch=no, image_only=no, shown_chars=F.lit(100), concrete=no, exact_image=no)
    return labelled(spark, d).select("doc_id", base.alias("r")).select("doc_id", raised.alias("r")).select("doc_id", F.concat_ws("/", "r.level", "r.basis").alias("risk"))


@query("""
WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS c FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(list_append(c, 'end'), lambda x, i: i = 1 OR x <> list_append(c, 'end')[i - 1]), '>') AS chain FROM e
""")
def chain_dedup(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("c"))
    return e.select("user_id", decision.squash_chain(F.col("c"), F.lit("end")).alias("c")).select("user_id", F.array_join("c", ">").alias("chain"))


@query("SELECT doc_id AS id, 'document' AS kind, lang AS platform, n_chars FROM documents UNION ALL SELECT item_id, 'benchmark', NULL, NULL FROM benchmark UNION ALL SELECT page_id, 'page', NULL, NULL FROM pages")
def manifest_union(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("lang").alias("platform"), "n_chars")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"))
    c = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("""
WITH v AS (SELECT vec_id, [embedding[i]::DOUBLE for i in range(1, 65)] AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_sum([(y - 0.1) * (y - 0.1) / 0.5 for y in x])), 6) AS distance FROM v
""")
def ood_distance(spark, d):
    import numpy as np

    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return fusion.distance(v, "x", [0.1] * 64, np.eye(64).tolist(), [0.5] * 64, "d").select("vec_id", F.round("d", 6).alias("distance"))


@query()
def ood_fit(spark, d):
    v = table(spark, d, "embeddings")
    mean, comps, var, threshold = fusion.fit_distance(v.where("label < 8"), "embedding", 8)
    out = fusion.distance(v, "embedding", mean, comps, var, "d")
    return out.select("vec_id", F.round("d", 6).alias("distance"), (F.col("d") > threshold).alias("flagged"))


@query()
def bounded_fit(spark, d):
    rows = dataset.balanced_weights(labelled(spark, d), "source", "label").withColumn("x1", F.col("p") - 0.5).withColumn("x2", (F.col("doc_id") % 9) / 9.0)
    weights, bias = fusion.fit_bounded(rows, ["x1", "x2"], "y", "weight", positive=["x1"])
    return rows.select("doc_id", F.round(fusion.linear_score(F.array("x1", "x2"), weights, bias), 4).alias("score"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM s GROUP BY user_id
""")
def event_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    return table(spark, d, "events").select("user_id", opens.alias("o")).groupBy("user_id").agg(F.sum("o").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query("SELECT n_name, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_returns(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.count(F.lit(1)).alias("lines"), F.sum("r").alias("r"))
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    out = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy("n_name").agg(F.sum("returned").alias("returned"), F.sum("lines").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.095 AND l_quantity > 45)")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_discount > 0.095 AND l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return dataset.resume(table(spark, d, "supplier").select("s_suppkey"), done, "s_suppkey")


@query("""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
i AS (SELECT doc_id, s, unnest(list_transform(range(least(64, len(s))), lambda i: round_even(i * (len(s) - 1) / greatest(1, least(64, len(s)) - 1), 0)::INT)) AS place FROM s WHERE len(s) > 0)
SELECT doc_id, place, length(regexp_replace(s[place + 1], '[^0-9]', '', 'g'))::DOUBLE AS delta FROM i
""")
def segment_effects(spark, d):
    """Digits as the score: what lines of each document carry, by leaving each out of the whole text."""
    cases = docs(spark, d).select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("segments"))
    scored = segments.deletions(cases).select("id", "index", F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("score"))
    return segments.effects(scored).select(F.col("id").alias("doc_id"), F.col("index").alias("place"), "delta")


@query()
def image_index(spark, d):
    """Sign and slope bits of vectors as image hashes: label 0 stands for what normal cases show."""
    code = lambda cond: F.expr(f"aggregate(sequence(0, 63), 0L, (a, i) -> shiftleft(a, 1) | if({cond}, 1L, 0L))")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), "label", code("get(embedding, i) > 0").alias("phash"), code("get(embedding, i + 1) > get(embedding, i)").alias("dhash"))
    return images.build_index(v.where("label > 0"), v.where("label = 0"))
