"""Queries of composed jobs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendloom.functions import chat, text
from mendloom.operators import metrics, rewards, selection
from mendloom.plans import derive, pipelines
from mendloom.plans.derive import say, table
from mendloom.plans.registry import query
from mendloom.sources import folders
from mendloom.sources.scratch import scratch

DOC, EVT = "documents", "events"


@query("g1_docstring_tasks", "SELECT p_partkey AS file_id, concat('f', p_partkey % 7) AS function_name FROM part WHERE p_partkey % 5 = 0")
def _(spark, d):
    return pipelines.docstring_tasks(derive.source_files(table(spark, d, "part"))).select("file_id", "function_name")


@query("g2_stack_dataset", "SELECT p_partkey AS file_id, true AS has_answer, 'user' AS last_role FROM part WHERE p_partkey % 5 = 0")
def _(spark, d):
    files = derive.source_files(table(spark, d, "part"))
    tasks = pipelines.docstring_tasks(files, whole=True)
    return pipelines.stack_dataset(tasks, "file_id").select("file_id", F.contains("answer", F.lit("SEARCH")).alias("has_answer"), F.element_at("prompt", -1)["role"].alias("last_role"))


@query("g3_vulnerability_repair", "SELECT md5(CAST(a.doc_id // 2 AS VARCHAR)) AS hash, concat('<<<<<<< SEARCH\nf', a.doc_id, '()\n=======\nf', b.doc_id, '()\n>>>>>>> REPLACE') AS answer FROM documents a JOIN documents b ON a.doc_id // 2 = b.doc_id // 2 AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 WHERE a.doc_id // 2 % 5 <> 4")
def _(spark, d):
    return pipelines.vulnerability_repair(derive.vulnerabilities(table(spark, d, DOC))).select("hash", "answer")


@query("g4_mono_repair", "SELECT p_partkey, concat('<<<<<<< SEARCH\nb ', p_brand, '\n=======\nb ', p_size, '\n>>>>>>> REPLACE') AS answer, md5(concat(p_partkey, '#42')) AS shuffled FROM part")
def _(spark, d):
    code = lambda x: say("a\nb ", x, "\nc")
    pairs = table(spark, d, "part").select("p_partkey", code(F.col("p_brand")).alias("before_code"), code(F.col("p_size").cast("string")).alias("after_code"), F.col("p_name").alias("description"))
    return pipelines.repair_dataset(pairs, "p_partkey").select("p_partkey", "answer", "shuffled")


@query("g5_classification", "SELECT doc_id, lang AS answer, md5(concat(doc_id, '#42')) AS shuffled FROM documents")
def _(spark, d):
    rows = table(spark, d, DOC).select("doc_id", F.coalesce("source", F.lit("s")).alias("code"), F.col("lang").alias("label"), F.lit(None).cast("string").alias("description"))
    return pipelines.classification_dataset(rows, "doc_id").select("doc_id", "answer", "shuffled")


@query("g6_detection", "SELECT md5(CAST(doc_id // 2 AS VARCHAR)) AS hash, concat('CWE-', doc_id // 2 % 12) AS answer FROM documents WHERE doc_id % 2 = 0 AND doc_id // 2 % 5 <> 4 AND doc_id // 2 % 12 < 9")
def _(spark, d):
    return pipelines.vulnerability_detection(derive.vulnerabilities(table(spark, d, DOC)), [f"CWE-{i}" for i in range(9)]).select("hash", "answer")


@query("g7_holdout", "SELECT doc_id, 'Dummy' AS prompt FROM documents WHERE md5(CAST(doc_id AS VARCHAR)) < '40000000000000000000000000000000'")
def _(spark, d):
    return selection.hash_split(table(spark, d, DOC).select("doc_id"), "doc_id", 0.25, True).withColumn("prompt", F.lit("Dummy"))


@query("g8_multilingual_mix", "WITH a AS (SELECT doc_id AS id, source AS repo FROM documents ORDER BY 1 LIMIT 750), b AS (SELECT page_id AS id, NULL AS repo FROM pages ORDER BY 1 LIMIT 250) SELECT id, repo, md5(concat(id, '#42')) AS shuffled FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE repo IS DISTINCT FROM 'src1'")
def _(spark, d):
    a = table(spark, d, DOC).select(F.col("doc_id").alias("id"), F.col("source").alias("repo"))
    return pipelines.multilingual_mix(a, table(spark, d, "pages").select(F.col("page_id").alias("id")), "id", 750, 250, "src1")


_CURATED = """WITH n AS (SELECT doc_id // 8 AS p, count(*) FILTER (doc_id % 4 <> 3) AS o, count(*) FILTER (doc_id % 4 <> 0) AS g, count(*) FILTER (doc_id % 4 IN (1, 2)) AS b, count(*) FILTER (doc_id % 4 = 1) AS t FROM documents GROUP BY 1),
    r AS (SELECT p, r, CASE WHEN r = 0 THEN b ELSE o END AS hit, CASE WHEN r = 0 THEN g ELSE o END AS given, o, t FROM n, range(2) x(r) WHERE (p + r) % 5 <> 0),
    s AS (SELECT CAST(p AS VARCHAR) AS instance_id, r AS rollout_no, round(CASE WHEN greatest(o, given) = 0 THEN 1 ELSE hit / greatest(o, given) END, 6) AS f, round(hit / greatest(o, given, 1), 6) AS s, round(t / greatest(t, given, 1), 6) AS ts FROM r)
    SELECT instance_id, rollout_no, round(0.2 * f + 0.4 * s + 0.4 * ts, 6) AS reward FROM s"""


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("instance_id", F.col("rollout_no").cast("long").alias("rollout_no"), "reward")


def _curated(spark, d) -> DataFrame:
    return _scored(pipelines.curate(derive.rollouts(table(spark, d, DOC))))


@query("g9_curation", _CURATED)
def _(spark, d):
    return _curated(spark, d)


@query("g9_repeated_rollouts", f"WITH c AS ({_CURATED}) SELECT c.* FROM c CROSS JOIN range(3)")
def _(spark, d):
    rows = derive.rollouts(table(spark, d, DOC))
    return _scored(pipelines.curate(rows.unionAll(rows).unionAll(rows)))


_RECOVERED = "SELECT event_id, 2 AS messages, CAST(-1.0 AS DOUBLE) AS reward, concat('fix ', user_id) AS problem_statement FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 AND date_trunc('second', ts) > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR"


def _folders(events: DataFrame) -> DataFrame:
    """A history folder for each event: (dir, metadata, diff, messages, tools)."""
    k = F.col("event_id")
    name = F.when(k % 7 == 0, "broken").otherwise(say(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "-", k.cast("string")))
    talk = say('{"role":"user","content":"fix ', F.col("user_id").cast("string"), '"}\n\n{"role":"assistant","content":"ok"}\n{bad\n{"role":"user","content":"late"}')
    return events.select(name.alias("dir"), F.lit('{"model":"m1"}').alias("metadata"), F.when(k % 3 == 0, " ").otherwise("d").alias("diff"), talk.alias("messages"), F.lit("[]").alias("tools"))


@query("g10_recovery", _RECOVERED)
def _(spark, d):
    events = table(spark, d, EVT)
    found, latest = _folders(events), events.agg(F.max("ts").alias("as_of"))
    made = pipelines.recover(found.crossJoin(F.broadcast(latest)), F.col("as_of"), 240, "m1")
    return made.select(F.substring_index("dir", "-", -1).cast("long").alias("event_id"), F.size("messages").alias("messages"), "reward", "problem_statement")


@query("g10_recovery_from_disk", "SELECT conv_id, count(*) AS messages, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS problem_statement FROM conversations WHERE conv_id % 100 > 50 AND conv_id % 3 <> 0 AND conv_id % 2 = 1 AND (conv_id % 5 <> 0 OR turn < 2) GROUP BY 1")
def _(spark, d):
    # A folder for each conversation, named by an hour: the message log is its turns, with a bad line in every fifth one.
    turns, at, k = table(spark, d, "conversations"), scratch(spark, "history"), F.col("conv_id")
    hour = F.lit("2025-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=(k % 100).cast("int"))
    dir_ = say(F.date_format(hour, "yyyy-MM-dd'T'HH.mm.ss"), "-", k.cast("string")).alias("dir")
    bad = (k % 5 == 0) & (F.col("turn") == 2)
    log = turns.select(dir_, F.lit("messages.jsonl").alias("name"), "turn", F.when(bad, "{bad").otherwise(F.to_json(F.struct("role", F.col("text").alias("content")))).alias("value"))
    rest = {"metadata.json": say('{"model":"m', (k % 2).cast("string"), '"}'), "diff.txt": F.when(k % 3 == 0, " ").otherwise("d"), "tools.json": F.lit("[]")}
    small = turns.select("conv_id").distinct().select(dir_, F.explode(F.create_map(*(x for n, v in rest.items() for x in (F.lit(n), v)))).alias("name", "value"))
    made = log.unionByName(small.withColumn("turn", F.lit(0).cast("long")))
    folders.write_files(made.where("dir is not null"), at, ["turn"])
    got = pipelines.recover_from(spark, at, F.lit("2025-01-05 04:00:00").cast("timestamp"), 50, "m1")
    return got.select(F.substring_index("dir", "-", -1).cast("long").alias("conv_id"), F.size("messages").cast("long").alias("messages"), "problem_statement")


@query("g11_training_selection", f"WITH c AS ({_CURATED}) SELECT * FROM c WHERE reward > 0.5")
def _(spark, d):
    return pipelines.select_for_training(_curated(spark, d), 0.5)


@query("g12_task_scoring", "SELECT doc_id, round(0.7 * (doc_id % 5 IN (0, 1, 3))::INT + 0.1 * 0 + 0.2 * 0, 6)::DOUBLE AS reward FROM documents")
def _(spark, d):
    scorers = {"reasoning": (lambda _: text.reasoning_tags("completion"), 0.1), "strict": (lambda _: text.strict_reasoning("completion"), 0.2), "label": (lambda _: rewards.categorical("completion", "answer"), 0.7)}
    return pipelines.score_task(derive.tagged(table(spark, d, DOC)), "doc_id", scorers)


@query("g13_predictions", "SELECT d.doc_id AS instance_id, 'agent-m' AS model_name_or_path, CASE WHEN quality = 1 THEN 'patch' ELSE '' END AS model_patch FROM (SELECT doc_id FROM documents ORDER BY 1 LIMIT 490 OFFSET 10) d LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    results = table(spark, d, "labels").select(F.col("doc_id").alias("instance_id"), F.when(F.col("quality") == 1, "patch").otherwise("").alias("generated_diff"))
    return pipelines.predictions(table(spark, d, DOC).select(F.col("doc_id").alias("instance_id")), results, "m", spec="10:500")


@query("g14_shard_merge", "WITH p AS (SELECT user_id AS instance_id, event_id % 12 * 1000000000 + event_id AS k, event_type FROM events), g AS (SELECT instance_id, arg_max(event_type, k) AS event_type, min(k) AS f FROM p GROUP BY 1) SELECT instance_id, event_type, row_number() OVER (ORDER BY f) - 1 AS place FROM g")
def _(spark, d):
    lines = table(spark, d, EVT).select(F.col("user_id").alias("instance_id"), (F.col("event_id") % 12).alias("shard"), F.col("event_id").alias("line"), "event_type")
    return pipelines.merge_shards(lines, "last").select("instance_id", "event_type", "place")


@query("m1_solve_rate", "SELECT round(avg(quality), 6) AS solve_rate FROM labels")
def _(spark, d):
    return metrics.solve_rate(table(spark, d, "labels"), "quality")


@query("m2_pass_at_k", "WITH n AS (SELECT doc_id // 8 AS p, quality, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i FROM labels) SELECT round(avg(hit), 6) AS pass_at_k FROM (SELECT max(quality) AS hit FROM n WHERE i <= 2 GROUP BY p)")
def _(spark, d):
    rows = table(spark, d, "labels").withColumn("problem", F.floor(F.col("doc_id") / 8))
    return metrics.pass_at(rows, "problem", "doc_id", "quality", 2)


@query("m3_mean_similarity", "WITH n AS (SELECT round(count(*) FILTER (doc_id % 4 IN (1, 2)) / greatest(count(*) FILTER (doc_id % 4 <> 3), count(*) FILTER (doc_id % 4 <> 0)), 6) AS s FROM documents GROUP BY doc_id // 8) SELECT round(avg(s), 6) AS mean_similarity FROM n")
def _(spark, d):
    return rewards.patch_similarity(derive.patches(table(spark, d, DOC)), "problem").agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"))


@query("m4_actions_per_solve", "SELECT median(value)::DOUBLE AS actions_per_solve FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return metrics.actions_per_solve(table(spark, d, EVT).withColumn("solved", F.col("event_type") == "purchase"), "solved", "value")


@query("m5_command_shares", "SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2")
def _(spark, d):
    return metrics.command_shares(table(spark, d, EVT), "user_id", "event_type")


@query("m5_shares_over_time", "WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM c), g AS (SELECT s.bucket, e.event_type, coalesce(c.n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT event_type FROM c) e LEFT JOIN c ON c.bucket = s.bucket AND c.event_type = e.event_type) SELECT epoch(bucket)::BIGINT AS bucket, event_type, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY bucket), 0), 0), 6) AS share FROM g")
def _(spark, d):
    shares = metrics.shares_over_time(table(spark, d, EVT), "ts", "event_type")
    return shares.withColumn("bucket", F.unix_timestamp("bucket"))


@query("m6_advantages", "SELECT event_id, round((e.v - avg(e.v) OVER w) / (coalesce(stddev_samp(e.v) OVER w, 0) + 0.0001), 6) AS advantage FROM (SELECT event_id, user_id, event_id % 10 AS v FROM events) e WINDOW w AS (PARTITION BY user_id)")
def _(spark, d):
    rows = table(spark, d, EVT).select("event_id", "user_id", (F.col("event_id") % 10).alias("v"))
    return metrics.advantages(rows, "user_id", "v").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("m7_loss_mask", "SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY turn, role, text) AS mask, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS masked_chars FROM conversations GROUP BY 1")
def _(spark, d):
    c = chat.conversations(table(spark, d, "conversations"))
    learned = F.filter("messages", lambda m: m["role"] == "assistant")
    return c.select("conv_id", F.array_join(F.transform(chat.loss_mask("messages"), lambda b: b.cast("int").cast("string")), "").alias("mask"), F.aggregate(learned, F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"])).alias("masked_chars"))
