"""Queries of scans, sinks, projections, filters, selection, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendloom.functions import chat, prompts, text
from mendloom.operators import evaluation, rewards, selection, transcripts
from mendloom.plans import derive
from mendloom.plans.derive import by_modulus, say, table
from mendloom.plans.registry import query
from mendloom.sources import folders, io
from mendloom.sources.scratch import scratch

DOC, EVT = "documents", "events"


# Scans and sinks


@query("s1_split_fallback", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    docs, at = table(spark, d, DOC).select("doc_id", "lang"), scratch(spark, "split")
    docs.where("doc_id < 0").write.parquet(f"{at}/train")
    docs.write.parquet(f"{at}/test")
    return io.scan_split(spark, at, "doc_id long, lang string")


@query("s2_prefix_scan", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return selection.first_rows(table(spark, d, DOC).select("doc_id", "n_chars"), ["doc_id"], 100)


def _lines(events: DataFrame) -> DataFrame:
    good = F.to_json(F.struct(say("u", F.col("user_id").cast("string")).alias("instance_id"), F.col("event_id").alias("v")))
    bad = {0: "{bad", 1: " ", 2: "[1]", 3: '{"x":1}', 4: '{"instance_id":""}'}
    line = good
    for k, v in bad.items():
        line = F.when(F.col("event_id") % 10 == k, F.lit(v)).otherwise(line)
    return events.select((F.col("event_id") % 12).alias("shard"), "event_id", line.alias("value"))


@query("s3_tolerant_jsonl", "SELECT concat('u', user_id) AS instance_id, event_id AS v FROM events WHERE event_id % 10 > 4")
def _(spark, d):
    at = scratch(spark, "jsonl")
    _lines(table(spark, d, EVT)).select("value").write.text(at)
    good, _ = io.scan_predictions(io.numbered_lines(spark, at))
    return good.select("instance_id", F.get_json_object("line", "$.v").cast("long").alias("v"))


@query("s3_rejects", "SELECT CASE WHEN event_id % 10 IN (0, 2) THEN 'not an object' ELSE 'no instance_id' END AS reason, count(*) AS n FROM events WHERE event_id % 10 IN (0, 2, 3, 4) GROUP BY 1")
def _(spark, d):
    lines = _lines(table(spark, d, EVT)).select(F.col("shard").alias("file"), F.col("event_id").alias("line_no"), F.col("value").alias("line"))
    return io.scan_predictions(lines)[1].groupBy("reason").agg(F.count("*").alias("n"))


#: JSON values as ids of predictions, and whether Python takes each for true.
_IDS = [('"0"', True), ('"false"', True), ('"null"', True), ("[]", False), ("0.0", False), ("0", False), ("{}", False), ("null", False), ("false", False), ("true", True), ("-1", True), ("[0]", True), ('{"a":0}', True), ('" "', True), ('""', False), ("1e-3", True)]


@query("s3_typed_ids", "SELECT event_id, event_id % 16 IN (" + ", ".join(str(i) for i, (_, ok) in enumerate(_IDS) if ok) + ") AS taken FROM events")
def _(spark, d):
    k = F.col("event_id")
    lines = table(spark, d, EVT).select(k, say('{"instance_id": ', by_modulus(k, *(F.lit(v) for v, _ in _IDS)), "}").alias("line"))
    good, bad = io.scan_predictions(lines)
    return good.select("event_id", F.lit(True).alias("taken")).unionAll(bad.select("event_id", F.lit(False)))


def _logs(spark, d) -> str:
    """A folder with a message log for every twelfth of the events, some lines of which are bad."""
    at, k = scratch(spark, "logs"), F.col("event_id")
    lines = table(spark, d, EVT).select((k % 12).alias("file"), k, F.when(k % 97 == 50, say("{bad ", k.cast("string"))).otherwise(F.to_json(F.struct(k.alias("id")))).alias("line"))
    lines.repartition(12, "file").sortWithinPartitions("file", "event_id").select("file", "line").write.partitionBy("file").text(at)
    return f"{at}/*/*"


@query("s4_until_bad_line", "WITH b AS (SELECT event_id % 12 AS shard, min(event_id) FILTER (event_id % 97 = 50) AS bad FROM events GROUP BY 1) SELECT event_id % 12 AS file, event_id AS line_no FROM events JOIN b ON b.shard = event_id % 12 WHERE bad IS NULL OR event_id < bad")
def _(spark, d):
    lines = io.until_bad(io.numbered_lines(spark, _logs(spark, d)))
    return lines.select(F.regexp_extract("file", r"file=(\d+)/", 1).cast("long").alias("file"), F.get_json_object("line", "$.id").cast("long").alias("line_no"))


@query("s5_shard_discovery", "WITH p AS (SELECT DISTINCT event_id % 13 AS s FROM events), q AS (SELECT CASE WHEN s = 12 THEN 'r/shard_x/preds.jsonl' WHEN s = 11 THEN 'r/shard-11/preds.jsonl' ELSE concat('r/shard_', s, '/preds.jsonl') END AS path, CASE WHEN s = 12 THEN 1000000000 ELSE s END AS number FROM p) SELECT path, number, row_number() OVER (ORDER BY number, path) AS place FROM q")
def _(spark, d):
    s = (F.col("event_id") % 13).cast("string")
    path = F.when(s == "12", "r/shard_x/preds.jsonl").when(s == "11", "r/shard-11/preds.jsonl").otherwise(say("r/shard_", s, "/preds.jsonl"))
    found = table(spark, d, EVT).select(path.alias("path")).distinct().withColumn("number", io.shard_number(F.col("path")))
    return selection.numbered(found, ["number", "path"]).select("path", "number", (F.col("row_no") + 1).alias("place"))


_TREE = {0: "shard_2", 1: "shard_10", 2: "shard-11", 3: "stray"}


@query("s5_tree_on_disk", "SELECT CASE doc_id % 4 WHEN 0 THEN 'shard_2' WHEN 1 THEN 'shard_10' WHEN 2 THEN 'shard-11' ELSE 'stray' END AS folder, doc_id % 4 + 1 AS place, count(*) AS lines, sum(doc_id)::BIGINT AS total FROM documents GROUP BY ALL")
def _(spark, d):
    at, docs = scratch(spark, "tree"), table(spark, d, DOC)
    for k, folder in _TREE.items():
        docs.where(F.col("doc_id") % 4 == k).select(F.col("doc_id").cast("string")).write.text(f"{at}/runs/{folder}")
    docs.select("doc_id").write.json(f"{at}/runs/shard_3")  # no prediction files
    found = io.discovered_lines(spark, at, "*.txt").groupBy("folder").agg(F.min("place").alias("first"), F.count("*").alias("lines"), F.sum(F.col("line").cast("long")).alias("total"))
    return selection.numbered(found, ["first"], "place").select("folder", (F.col("place") + 1).alias("place"), "lines", "total")


def _history(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    names = F.create_map(*(F.lit(x) for kv in {0: "metadata.json", 1: "diff.txt", 2: "messages.jsonl", 3: "tools.json"}.items() for x in kv))
    value = F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 9 == 0, "{bad").otherwise(say('{"model":"m', (F.col("conv_id") % 3).cast("string"), '"}'))).otherwise(F.col("role"))
    return c.where("turn < 4").select(F.col("conv_id").alias("dir"), names[F.col("turn").cast("int")].alias("name"), value.alias("value"))


@query("s6_history_folders", "SELECT conv_id AS dir, max(role) FILTER (turn = 1) AS diff, max(role) FILTER (turn = 3) AS tools FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) FILTER (turn < 4) = 4")
def _(spark, d):
    at, wide = scratch(spark, "history"), F.coalesce(F.col("dir").cast("string"), F.lit("none")).alias("dir")
    folders.write_files(_history(spark, d).where("name is not null").groupBy(wide, "name").agg(F.max("value").alias("value")), at, ["value"])
    bare = lambda c: F.regexp_replace(c, r"\n\z", "").alias(c)
    return io.history(spark, at).select(F.expr("try_cast(dir AS long)").alias("dir"), bare("diff"), bare("tools"))


@query("s7_json_documents", "SELECT DISTINCT conv_id AS dir, concat('m', conv_id % 3) AS model FROM conversations WHERE turn = 0 AND conv_id % 9 <> 0")
def _(spark, d):
    meta = _history(spark, d).where("name = 'metadata.json'").distinct()
    return meta.where(F.try_parse_json("value").isNotNull()).select("dir", F.from_json("value", "model string")["model"].alias("model"))


@query("s8_declared_schema", "SELECT CAST(doc_id AS VARCHAR) AS instance_id, source AS repo, n_chars FROM documents")
def _(spark, d):
    return table(spark, d, DOC).select(F.col("doc_id").alias("instance_id"), F.col("source").alias("repo"), "n_chars").transform(evaluation.declared, "instance_id string, repo string, n_chars long")


@query("s9_result_tree", "SELECT DISTINCT concat(coalesce(source, 's'), '__run', doc_id % 3) AS run_id, coalesce(source, 's') AS model FROM documents")
def _(spark, d):
    path = say("results/", F.coalesce("source", F.lit("s")), "__run", (F.col("doc_id") % 3).cast("string"), "/preds.jsonl")
    return evaluation.result_tree(table(spark, d, DOC).select(path.alias("path")))


@query("k1_table_write", "SELECT doc_id, source, n_chars FROM documents")
def _(spark, d):
    at = scratch(spark, "table")
    io.write_table(table(spark, d, DOC).select("doc_id", "source", "n_chars"), at)
    return spark.read.parquet(at)


_VERSIONED = "SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents"


def _versioned(spark, d, as_json: bool) -> DataFrame:
    docs, root = table(spark, d, DOC).select("doc_id", "lang", "n_chars"), scratch(spark, "datasets")
    for version, order in (("v2", ["doc_id"]), ("v10", ["n_chars", "doc_id"])):
        io.write_version(docs, root, "some/documents", version, order, as_json)
    return io.read_version(spark, root, "some/documents", "doc_id long, lang string, n_chars long", as_json=as_json)


@query("k1_versions", _VERSIONED)
def _(spark, d):
    return _versioned(spark, d, False)


@query("k3_jsonl_versions", _VERSIONED)
def _(spark, d):
    return _versioned(spark, d, True)


@query("k2_dataset_card", "SELECT 'labelled documents' AS description, '20' AS threshold, count(*) AS rows FROM labels")
def _(spark, d):
    made = io.card(table(spark, d, "labels"), "labelled documents", threshold="20")
    return made.select("description", F.col("parameters")["threshold"].alias("threshold"), "rows")


@query("k3_jsonl_write", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, d):
    at = scratch(spark, "jsonl")
    io.write_jsonl(table(spark, d, DOC).select("doc_id", "lang", "n_chars"), ["doc_id"], at)
    return spark.read.schema("doc_id long, lang string, n_chars long").json(at)


# Projections


@query("p1_constant_prompt", "SELECT doc_id, 'Dummy' AS prompt FROM documents")
def _(spark, d):
    return evaluation.constant_prompt(table(spark, d, DOC).select("doc_id"))


@query("p2_docstring_task", "SELECT p_partkey, p_name AS before_code, concat('Write the body of `f', p_size, '` (lines ', p_size, '-', p_size + 3, '):\n', p_brand) AS description FROM part")
def _(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("before_code"), prompts.docstring_description(say("f", size.cast("string")), size, size + 3, "p_brand").alias("description"))


@query("p3_vulnerability_description", "SELECT concat('f', doc_id, '()') AS func, concat('Type: [''', CASE WHEN doc_id // 2 % 5 = 4 THEN 'Other' ELSE concat('CWE-', doc_id // 2 % 12) END, ''']\nDescription: weakness ', doc_id // 2) AS description FROM documents")
def _(spark, d):
    return derive.vulnerabilities(table(spark, d, DOC)).select("func", prompts.vulnerability_description("cwe", "cwe_description").alias("description"))


_REPAIR_SQL = "concat(CASE WHEN coalesce(source, '') <> '' AND doc_id % 3 > 0 THEN concat('Issue:\n', source, '\n\n') ELSE '' END, 'Code:\n```\n', doc_id, '\n```\n\n{0}')"


def _described():
    return F.when(F.col("doc_id") % 3 > 0, F.col("source"))


@query("p4_repair_prompt", f"SELECT doc_id, {_REPAIR_SQL.format(prompts.REPAIR_TASK)} AS user_prompt FROM documents")
def _(spark, d):
    return table(spark, d, DOC).select("doc_id", prompts.repair_prompt(F.col("doc_id").cast("string"), _described()).alias("user_prompt"))


@query("p5_classification_prompt", f"SELECT doc_id, {_REPAIR_SQL.format(prompts.CLASSIFY_TASK)} AS user_prompt FROM documents")
def _(spark, d):
    return table(spark, d, DOC).select("doc_id", prompts.classification_prompt(F.col("doc_id").cast("string"), _described()).alias("user_prompt"))


@query("p6_chat_prompt", f"SELECT doc_id, 'system' AS r0, '{prompts.REPAIR_SYSTEM}' AS c0, 'user' AS r1, source AS c1, lang AS answer FROM documents")
def _(spark, d):
    made = table(spark, d, DOC).select("doc_id", prompts.chat(prompts.REPAIR_SYSTEM, "source").alias("p"), F.col("lang").alias("answer"))
    return made.select("doc_id", *(F.col("p")[i][f].alias(f[0] + str(i)) for i in (0, 1) for f in ("role", "content")), "answer")


@query("p7_prompt_completion", "SELECT conv_id, least(count(*), 2) AS prompt_turns, greatest(count(*) - 2, 0) AS completion_turns, coalesce(string_agg(role, ',' ORDER BY turn, role, text) FILTER (turn > 1), '') AS completion_roles FROM conversations GROUP BY 1")
def _(spark, d):
    head, tail = chat.head_and_tail("messages")
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", F.size(head).cast("long").alias("prompt_turns"), F.size(tail).cast("long").alias("completion_turns"), F.array_join(F.transform(tail, lambda m: m["role"]), ",").alias("completion_roles"))


@query("p8_padding", "WITH c AS (SELECT conv_id, count(*) FILTER (turn < conv_id % 4) AS n, coalesce(string_agg(role, ',' ORDER BY turn, role, text) FILTER (turn < conv_id % 4), '') AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN n = 0 THEN 'user,assistant' WHEN n = 1 THEN concat(roles, ',user,assistant') WHEN n = 2 THEN concat(roles, ',assistant') ELSE roles END AS roles FROM c")
def _(spark, d):
    short = chat.conversations(table(spark, d, "conversations")).withColumn("messages", F.slice("messages", F.lit(1), (F.col("conv_id") % 4).cast("int")))
    return short.select("conv_id", F.array_join(F.transform(chat.padded("messages", F.lit("p")), lambda m: m["role"]), ",").alias("roles"))


@query("p9_curated_row", "SELECT conv_id, count(*) AS turns, string_agg(text, '|' ORDER BY turn, role, text) AS contents FROM conversations GROUP BY 1")
def _(spark, d):
    head, tail = chat.head_and_tail("messages")
    joined = chat.conversations(table(spark, d, "conversations")).select("conv_id", F.concat(head, tail).alias("messages"))
    return joined.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("contents"))


@query("p10_recovered_row", "SELECT doc_id, CAST(-1.0 AS DOUBLE) AS reward, coalesce(source, '') AS problem_statement FROM documents")
def _(spark, d):
    return table(spark, d, DOC).select("doc_id", F.lit(-1.0).alias("reward"), F.coalesce("source", F.lit("")).alias("problem_statement"))


@query("p11_first_user", "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS problem_statement FROM conversations GROUP BY 1")
def _(spark, d):
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", chat.first_user("messages").alias("problem_statement"))


@query("p12_first_patch", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 2 THEN 'd' ELSE '' END AS model_patch FROM (SELECT doc_id, coalesce(lang, CASE WHEN doc_id % 4 = 0 THEN source END, 'm') AS lang, coalesce(source, 'm') AS source FROM documents)")
def _(spark, d):
    k = F.col("doc_id") % 4
    docs = table(spark, d, DOC)
    return docs.select("doc_id", text.first_full(F.when(k == 0, F.coalesce("lang", "source", F.lit("m"))), F.when(k == 1, F.coalesce("source", F.lit("m"))).otherwise(""), F.when(k == 2, "d"), F.lit(None).cast("string")).alias("model_patch"))


@query("p13_prediction", "SELECT CAST(doc_id AS VARCHAR) AS instance_id, concat('agent-', source) AS model_name_or_path, lang AS model_patch FROM documents")
def _(spark, d):
    return table(spark, d, DOC).select(F.col("doc_id").cast("string").alias("instance_id"), say("agent-", F.col("source")).alias("model_name_or_path"), F.col("lang").alias("model_patch"))


@query("p14_eval_input", "SELECT doc_id AS instance_id, coalesce(source, '') AS repo, coalesce(lang, '') AS version FROM documents")
def _(spark, d):
    none = {c: F.lit("") for c in ("base_commit", "problem_statement", "patch", "test_patch")}
    problems = table(spark, d, DOC).select(F.col("doc_id").alias("instance_id"), F.coalesce("source", F.lit("")).alias("repo"), F.col("lang").alias("version")).withColumns(none)
    return evaluation.eval_inputs(problems).select("instance_id", "repo", "version")


@query("p15_run_tag", "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(concat('/', p_name, '/', p_brand, ' '), '/', '__'), ' ', '_'), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '_') AS tag FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.run_tag(say("/", F.col("p_name"), "/", F.col("p_brand"), " ")).alias("tag"))


@query("p15_adapter_tag", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'org_base' ELSE concat('org_base__lora__', replace(coalesce(lang, 'l'), ' ', '_'), '_', doc_id) END AS tag FROM documents")
def _(spark, d):
    adapter = F.when(F.col("doc_id") % 2 == 1, say("runs/x/", F.coalesce("lang", F.lit("l")), " ", F.col("doc_id").cast("string"), "/"))
    return table(spark, d, DOC).select("doc_id", evaluation.adapter_tag(F.lit("org/base"), adapter).alias("tag"))


@query("p16_dataset_names", "SELECT doc_id, concat('me/SFT-', coalesce(source, 's'), '-', CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'm1' END) AS name FROM documents")
def _(spark, d):
    model = F.when(F.col("doc_id") % 2 == 0, "").otherwise("org/m1")
    return table(spark, d, DOC).select("doc_id", evaluation.dataset_name("me", say("org/", F.coalesce("source", F.lit("s"))), model).alias("name"))


@query("p16_names", "SELECT doc_id, concat('https://github.com/', source, '/', lang, '.git') AS repo_url, lower(concat('eval.x86_64.', source, '_1776_', doc_id)) AS image, left(md5(CAST(doc_id AS VARCHAR)), 7) AS short_commit FROM documents")
def _(spark, d):
    k = F.col("doc_id").cast("string")
    return table(spark, d, DOC).select("doc_id", evaluation.repo_url("source", "lang").alias("repo_url"), evaluation.image_uri(say(F.col("source"), "__", k)).alias("image"), evaluation.short_commit(F.md5(F.encode(k, "UTF-8"))).alias("short_commit"))


@query("p17_run_id", "SELECT doc_id, concat(coalesce(source, 's'), '__', coalesce(lang, 'l')) AS run_id FROM documents")
def _(spark, d):
    path = say(F.coalesce("source", F.lit("s")), "__", F.coalesce("lang", F.lit("l")), "__", F.col("doc_id").cast("string"))
    return table(spark, d, DOC).select("doc_id", evaluation.run_id(path).alias("run_id"))


# Filters


@query("f1_rejection_sampling", "SELECT doc_id, quality FROM labels WHERE quality > 0.2")
def _(spark, d):
    return table(spark, d, "labels").where(F.col("quality") > 0.2).select("doc_id", "quality")


_HEAD = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 01 Jan 2025\n\n" + prompts.REPAIR_SYSTEM + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
_TAIL = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"


@query("f2_prompt_length", rf"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(concat('{_HEAD}', source, ' ', repeat('x ', doc_id % 50), '{_TAIL}'), '\w+|[^\w\s]')) AS tokenized_length FROM documents WHERE source IS NOT NULL) WHERE tokenized_length <= 120")
def _(spark, d):
    docs = table(spark, d, DOC).select("doc_id", say(F.col("source"), " ", F.expr("repeat('x ', cast(doc_id % 50 as int))")).alias("user_prompt"))
    return prompts.by_length(docs, prompts.REPAIR_SYSTEM, 120).select("doc_id", F.col("tokenized_length").cast("long").alias("tokenized_length"))


_VUL_SQL = "SELECT concat('f', doc_id, '()') AS func FROM documents WHERE "


@query("f3_exclude_other", _VUL_SQL + "doc_id // 2 % 5 <> 4")
def _(spark, d):
    return derive.vulnerabilities(table(spark, d, DOC)).where(~F.array_contains("cwe", "Other")).select("func")


TOP_CWES = [f"CWE-{i}" for i in range(9)]


@query("f4_allow_list", _VUL_SQL + "doc_id % 2 = 0 AND doc_id // 2 % 5 <> 4 AND doc_id // 2 % 12 < 9")
def _(spark, d):
    return derive.vulnerabilities(table(spark, d, DOC)).where(F.col("is_vulnerable") & F.get("cwe", 0).isin(TOP_CWES)).select("func")


@query("f5_block_list", "SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")
def _(spark, d):
    return table(spark, d, DOC).where(~F.col("source").eqNullSafe("src1")).select("doc_id")


@query("f6_recency", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND date_trunc('second', ts) > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR")
def _(spark, d):
    events = table(spark, d, EVT)
    latest = events.agg(F.max("ts").alias("as_of"))
    name = F.when(F.col("event_id") % 7 == 0, "broken-name").otherwise(say(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "-", F.col("event_id").cast("string")))
    return events.crossJoin(F.broadcast(latest)).where(selection.recent(name, F.col("as_of"), 240)).select("event_id")


@query("f7_model_filter", "SELECT doc_id FROM documents WHERE contains(coalesce(source, ''), 'c1')")
def _(spark, d):
    return table(spark, d, DOC).where(F.contains(F.coalesce("source", F.lit("")), F.lit("c1"))).select("doc_id")


@query("f8_non_empty_diff", "SELECT doc_id FROM documents WHERE doc_id % 3 = 2")
def _(spark, d):
    return table(spark, d, DOC).where(F.length(text.strip(by_modulus(F.col("doc_id"), F.lit(""), F.lit(" \n\t"), F.lit(" x ")))) > 0).select("doc_id")


@query("f9_non_empty_messages", "SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') > 0")
def _(spark, d):
    c = chat.conversations(table(spark, d, "conversations"))
    return c.where(F.size(F.filter("messages", lambda m: m["role"] == "system")) > 0).select("conv_id")


_FAILED_SQL = "((doc_id // 8) + r) % 5 = 0"


@query("f12_failed_rollouts", f"SELECT DISTINCT CAST(doc_id // 8 AS VARCHAR) AS instance_id, r AS rollout_no FROM documents, range(2) t(r) WHERE NOT {_FAILED_SQL}")
def _(spark, d):
    return derive.rollouts(table(spark, d, DOC)).where("status = 'ok'").select("instance_id", F.col("rollout_no").cast("long").alias("rollout_no"))


@query("f13_pair_check", "SELECT md5(CAST(doc_id // 2 AS VARCHAR)) AS hash FROM documents WHERE doc_id % 11 <> 0 GROUP BY doc_id // 2 HAVING count(*) = 1")
def _(spark, d):
    return selection.unpaired(derive.vulnerabilities(table(spark, d, DOC).where("doc_id % 11 <> 0")), "hash", "is_vulnerable")


# Selection


@query("r1_hash_split", "SELECT doc_id, 'holdout' AS part FROM documents WHERE md5(CAST(doc_id AS VARCHAR)) < '40000000000000000000000000000000' UNION ALL SELECT doc_id, 'train' FROM documents WHERE md5(CAST(doc_id AS VARCHAR)) >= '40000000000000000000000000000000'")
def _(spark, d):
    docs = table(spark, d, DOC).select("doc_id")
    return docs.withColumn("part", F.when(selection.in_holdout(F.col("doc_id"), 0.25), "holdout").otherwise("train"))


@query("r2_first_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 750")
def _(spark, d):
    return selection.first_rows(table(spark, d, DOC).select("doc_id"), ["doc_id"], 750)


@query("r3_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 90 OFFSET 10")
def _(spark, d):
    return selection.sliced(table(spark, d, DOC).select("doc_id"), ["doc_id"], "10:100")


@query("r4_task_slices", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS task_id FROM documents")
def _(spark, d):
    return selection.task_slices(table(spark, d, DOC).select("doc_id"), ["doc_id"], 500).select("doc_id", "task_id")


@query("r5_shards", "SELECT doc_id, ntile(20) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")
def _(spark, d):
    return selection.sharded(table(spark, d, DOC).select("doc_id"), ["doc_id"], 20).select("doc_id", "shard")


@query("r5_strided_shards", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 20 AS shard FROM documents")
def _(spark, d):
    return selection.sharded(table(spark, d, DOC).select("doc_id"), ["doc_id"], 20, contiguous=False).select("doc_id", "shard")


@query("r6_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '#42')), doc_id) - 1 AS row_no FROM documents")
def _(spark, d):
    keyed = table(spark, d, DOC).select("doc_id", selection.shuffle_key(F.col("doc_id"), 42).alias("at"))
    return selection.numbered(keyed, ["at", "doc_id"]).select("doc_id", "row_no")


@query("r7_overlap", "SELECT count(*) AS shared FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def _(spark, d):
    return selection.overlap(table(spark, d, DOC), table(spark, d, "labels"), "doc_id")


_PREDS = "SELECT user_id, event_id % 12 AS shard, event_id AS line, event_type, value FROM events"


def _predictions(spark, d):
    return table(spark, d, EVT).select("user_id", (F.col("event_id") % 12).alias("shard"), F.col("event_id").alias("line"), "event_type", "value")


@query("r8_first_seen_order", f"WITH p AS ({_PREDS}), f AS (SELECT user_id, min(shard * 1000000000 + line) AS k FROM p GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY k) - 1 AS row_no FROM f")
def _(spark, d):
    seen = selection.keep_one(_predictions(spark, d), "user_id", ["shard", "line"])
    return selection.numbered(seen.select("user_id", "first_seen"), ["first_seen"]).select("user_id", "row_no")


# Joins


@query("j1_pair_join", "SELECT md5(CAST(a.doc_id // 2 AS VARCHAR)) AS hash, concat('f', a.doc_id, '()') AS before_code, concat('f', b.doc_id, '()') AS after_code FROM documents a JOIN documents b ON a.doc_id // 2 = b.doc_id // 2 AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def _(spark, d):
    met = selection.pairs_by_hash(derive.vulnerabilities(table(spark, d, DOC)), "hash", "is_vulnerable")
    return met.select("hash", F.col("vulnerable.func").alias("before_code"), F.col("fixed.func").alias("after_code"))


@query("j1_rank_pairs", "WITH p AS (SELECT lang AS hash, doc_id % 2 = 0 AS v, doc_id, row_number() OVER (PARTITION BY lang, doc_id % 2 ORDER BY doc_id) AS r FROM documents WHERE lang IS NOT NULL) SELECT a.hash, a.doc_id AS vulnerable, b.doc_id AS fixed FROM p a JOIN p b ON a.hash = b.hash AND a.r = b.r AND a.v AND NOT b.v")
def _(spark, d):
    met, _left = selection.rank_pairs(table(spark, d, DOC).select("lang", "doc_id", (F.col("doc_id") % 2 == 0).alias("v")), "lang", "v", ["doc_id"])
    return met.select(F.col("lang").alias("hash"), F.col("vulnerable.doc_id").alias("vulnerable"), F.col("fixed.doc_id").alias("fixed"))


@query("j2_file_join", "SELECT doc_id // 8 AS problem, concat('f', doc_id, '.py') AS filename, doc_id % 4 <> 3 AS in_oracle, doc_id % 4 <> 0 AS in_generated FROM documents")
def _(spark, d):
    p = derive.patches(table(spark, d, DOC))
    o, g = rewards.last_by_name(p, "patch", "problem").withColumnRenamed("part", "o"), rewards.last_by_name(p, "generated_diff", "problem").withColumnRenamed("part", "g")
    return o.join(g, ["problem", "filename"], "full_outer").select("problem", "filename", F.col("o").isNotNull().alias("in_oracle"), F.col("g").isNotNull().alias("in_generated"))


@query("j3_expand_rollouts", "SELECT doc_id, r AS rollout_no FROM documents, range(4) t(r)")
def _(spark, d):
    return selection.expand(table(spark, d, DOC).select("doc_id"), 4).select("doc_id", F.col("rollout_no").cast("long").alias("rollout_no"))


_KIND = "CASE WHEN event_type IN ('view', 'click') THEN 'call' ELSE 'response' END"


@query("j4_first_response", f"WITH e AS (SELECT user_id, event_id AS pos, event_type, {_KIND} AS kind FROM events), c AS (SELECT user_id, pos, event_type AS cmd FROM e WHERE kind = 'call'), r AS (SELECT user_id, pos, event_type FROM e WHERE kind = 'response') SELECT c.user_id, c.pos, cmd, r.event_type AS response FROM c ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.pos < r.pos")
def _(spark, d):
    e = table(spark, d, EVT).select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type").isin("view", "click"), "call").otherwise("response").alias("kind"), F.col("event_type").alias("value"))
    return transcripts.first_response(e, "user_id")


_CHAIN = "SELECT s.session FROM (SELECT session, min(pos) AS p FROM c WHERE e = 'click' AND pos <= 10 GROUP BY 1) s JOIN c ON c.session = s.session AND c.e = 'purchase' AND c.pos > s.p"


@query("j5_search_then_read", f"WITH c AS ({derive.CALLS_SQL}) SELECT DISTINCT session FROM ({_CHAIN})")
def _(spark, d):
    return transcripts.chained(transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session"), "session")


@query("j6_completion_answer", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def _(spark, d):
    return evaluation.with_answers(table(spark, d, DOC).select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("j7_block_zip", "SELECT p_partkey, i AS block_no, CASE WHEN i < 1 + p_partkey % 2 THEN p_name ELSE '' END AS a_search, CASE WHEN i < 1 + p_partkey % 3 THEN p_brand ELSE '' END AS b_search FROM part, range(3) t(i) WHERE i < 1 + greatest(p_partkey % 2, p_partkey % 3)")
def _(spark, d):
    part = table(spark, d, "part")
    some = lambda c, n: F.transform(F.sequence(F.lit(0), F.pmod("p_partkey", F.lit(n)).cast("int")), lambda i: derive.block(F.col(c), "r"))
    made = part.select("p_partkey", some("p_name", 2).alias("a"), some("p_brand", 3).alias("b"))
    return rewards.block_pairs(made, "a", "b", "p_partkey").select("p_partkey", F.col("block_no").cast("long").alias("block_no"), "a_search", "b_search")


@query("j8_complete_folders", "SELECT conv_id AS dir FROM conversations WHERE turn < 4 GROUP BY 1 HAVING count(DISTINCT turn) = 4")
def _(spark, d):
    return io.complete_history(_history(spark, d)).select("dir")


@query("j9_missing_shards", "SELECT DISTINCT event_id // 5 AS shard FROM events WHERE event_id // 5 NOT IN (SELECT event_id // 5 FROM events WHERE event_type = 'purchase')")
def _(spark, d):
    e = table(spark, d, EVT).select(F.floor(F.col("event_id") / 5).cast("long").alias("shard"), "event_type")
    return evaluation.missing_shards(e, e.where("event_type = 'purchase'"), "shard")


@query("j10_inputs_results", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return table(spark, d, DOC).select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


# Aggregates, windows, sets


@query("a1_keep_last", f"WITH p AS ({_PREDS}) SELECT user_id, arg_max(event_type, shard * 1000000000 + line) AS event_type, min(shard * 1000000000 + line) AS first_seen FROM p GROUP BY 1")
def _(spark, d):
    kept = selection.keep_one(_predictions(spark, d), "user_id", ["shard", "line"], "last")
    return kept.select("user_id", "event_type", (F.col("first_seen.shard") * 1000000000 + F.col("first_seen.line")).alias("first_seen"))


_MATCH = "SELECT doc_id // 8 AS problem, round(count(*) FILTER (doc_id % 4 IN (1, 2)) / greatest(count(*) FILTER (doc_id % 4 <> 3), count(*) FILTER (doc_id % 4 <> 0)), 6) AS {0} FROM documents GROUP BY 1"


@query("a2_set_overlap", _MATCH.format("overlap"))
def _(spark, d):
    return derive.patches(table(spark, d, DOC)).select("problem", rewards.file_match("patch", "generated_diff").alias("overlap"))


@query("a3_ratio_sum", _MATCH.format("similarity"))
def _(spark, d):
    return rewards.patch_similarity(derive.patches(table(spark, d, DOC)), "problem")


@query("a4_mean_of_blocks", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS similarity FROM part")
def _(spark, d):
    made = derive.coded(table(spark, d, "part"))
    return rewards.block_similarity(made.select("p_partkey", "blocks", F.slice("blocks", 1, 1).alias("first")), "blocks", "first", "p_partkey")


@query("a5_last_by_name", "SELECT doc_id // 8 AS problem, concat('f', doc_id % 3, '.py') AS filename, max(doc_id) AS last FROM documents GROUP BY 1, 2")
def _(spark, d):
    k = F.col("doc_id")
    parts = F.array_sort(F.collect_list(F.struct(k.alias("k"), say("diff --git a/f", (k % 3).cast("string"), ".py b/x\n+", k.cast("string"), "\n").alias("t"))))
    p = table(spark, d, DOC).groupBy(F.floor(k / 8).alias("problem")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("patch"))
    return rewards.last_by_name(p, "patch", "problem").select("problem", "filename", F.regexp_extract("part", r"\+([0-9]+)", 1).cast("long").alias("last"))


@query("a6_filter_counts", "SELECT count(*) AS before, count(*) FILTER (n_chars <= 1000) AS after FROM documents")
def _(spark, d):
    return evaluation.filter_counts(table(spark, d, DOC), F.col("n_chars") <= 1000)


@query("a10_recovery_summary", "SELECT count(*) AS recovered, round(avg(n), 6) AS mean_messages, round(avg(chars), 6) AS mean_diff FROM (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1)")
def _(spark, d):
    made = chat.conversations(table(spark, d, "conversations")).withColumn("generated_diff", F.array_join(F.transform("messages", lambda m: m["content"]), ""))
    return evaluation.recovery_summary(made)


@query("a11_patch_count", "SELECT count(*) FILTER (doc_id % 3 = 0) AS with_patch, count(*) AS total FROM documents")
def _(spark, d):
    return evaluation.patch_count(table(spark, d, DOC).select(F.when(F.col("doc_id") % 3 == 0, "p").otherwise("").alias("model_patch")))


@query("a12_curation_summary", f"SELECT count(*) AS attempted, count(DISTINCT p) AS problems, count(*) FILTER (f) AS failed FROM (SELECT DISTINCT doc_id // 8 AS p, r, {_FAILED_SQL} AS f FROM documents, range(2) t(r))")
def _(spark, d):
    return evaluation.curation_summary(derive.rollouts(table(spark, d, DOC)))


@query("a13_weighted_mix", "SELECT doc_id, round(0.1 * quality + 0.9 * (1 - toxic), 6) AS reward FROM labels")
def _(spark, d):
    scores = table(spark, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("clean"), (1 - F.col("toxic")).cast("double"))).alias("name", "score"))
    return rewards.weighted(scores, {"quality": 0.1, "clean": 0.9}, "doc_id")


@query("a14_curation_reward", "SELECT doc_id, round(0.2 * (doc_id % 2) + 0.4 * (doc_id % 3) / 2 + 0.4 * (doc_id % 5) / 4, 6) AS reward FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    return table(spark, d, DOC).select("doc_id", rewards.curation_reward((k % 2).cast("double"), (k % 3) / 2, (k % 5) / 4).alias("reward"))


@query("w1_rank_frames", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("w1_frames", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY n) FILTER (n <= 2), '') AS head, coalesce(string_agg(role, ',' ORDER BY n) FILTER (n > 2), '') AS tail FROM c GROUP BY 1")
def _(spark, d):
    roles = lambda m: F.array_join(F.transform(m, lambda x: x["role"]), ",")
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", roles(evaluation.frames("messages", 0, 2)).alias("head"), roles(evaluation.frames("messages", 2, None)).alias("tail"))


@query("w2_repeated_failure", f"WITH c AS ({derive.CALLS_SQL}), g AS (SELECT session, pos, e, lag(e) OVER (PARTITION BY session ORDER BY pos) AS b FROM c) SELECT session, pos FROM g WHERE e = 'error' AND b = 'error'")
def _(spark, d):
    found = transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session")
    order = Window.partitionBy("session").orderBy("pos")
    marked = found.select("session", "pos", "ok", "cmd", F.lag("ok").over(order).alias("ok_before"), F.lag("cmd").over(order).alias("cmd_before"))
    return marked.where("not ok and not ok_before and cmd = cmd_before").select("session", F.col("pos").cast("long").alias("pos"))


@query("w3_duplicates", f"WITH c AS ({derive.CALLS_SQL}) SELECT session, e, count(*) AS n FROM c WHERE pos <= 10 GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    found = transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session").where("pos <= 10")
    kind = F.create_map(*(F.lit(x) for k, (c, _) in derive.COMMANDS.items() for x in (c, k)))[F.col("cmd")]
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("session", "cmd")))
    return counted.where("n > 1").select("session", kind.alias("e"), "n").distinct()


@query("w4_first_bad", "SELECT event_id % 12 AS shard, min(event_id) AS first_bad FROM events WHERE event_id % 97 = 50 GROUP BY 1")
def _(spark, d):
    bad = io.numbered_lines(spark, _logs(spark, d)).where(F.try_parse_json("line").isNull())
    first = bad.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where("nth = 1")
    return first.select(F.regexp_extract("file", r"file=(\d+)/", 1).cast("long").alias("shard"), F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("first_bad"))


@query("u1_concatenate", "SELECT doc_id AS id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def _(spark, d):
    a = table(spark, d, DOC).select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), allowMissingColumns=True)


@query("u2_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, DOC).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))
