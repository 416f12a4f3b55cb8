"""Queries of text functions, search/replace diffs, rewards, mining and the reward registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendloom.functions import chat, diffs, text
from mendloom.operators import evaluation, mining, rewards, transcripts
from mendloom.plans import derive
from mendloom.plans.derive import by_modulus, say, table
from mendloom.plans.registry import query

DOC, EVT = "documents", "events"
_S = "coalesce(text, 's')"
_ANSWER = "CASE doc_id % 5 WHEN 2 THEN 'N/A' WHEN 4 THEN 'xx' ELSE coalesce(lang, 'en') END"


@query("x1_answer_tag", f"SELECT doc_id, {_ANSWER} AS answer FROM documents")
def _(spark, d):
    return derive.tagged(table(spark, d, DOC)).select("doc_id", text.answer_tag("completion").alias("answer"))


@query("x2_fenced_block", f"SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN concat('no ', {_S}) ELSE concat({_S}, '\n') END AS block FROM documents")
def _(spark, d):
    return derive.fenced(table(spark, d, DOC)).select("doc_id", text.fenced("completion").alias("block"))


@query("x3_all_fenced_blocks", f"SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN concat('no ', {_S}) WHEN 1 THEN concat({_S}, '\n|x\n') ELSE concat({_S}, '\n') END AS blocks FROM documents")
def _(spark, d):
    return derive.fenced(table(spark, d, DOC)).select("doc_id", F.array_join(text.all_fenced("completion"), "|").alias("blocks"))


@query("x4_split_files", "SELECT doc_id // 8 AS problem, count(*) FILTER (doc_id % 4 <> 3) AS files FROM documents GROUP BY 1")
def _(spark, d):
    return derive.patches(table(spark, d, DOC)).select("problem", F.size(text.file_diffs("patch")).cast("long").alias("files"))


@query("x5_filenames", "SELECT doc_id // 8 AS problem, coalesce(string_agg(concat('f', doc_id, '.py'), ',' ORDER BY doc_id) FILTER (doc_id % 4 <> 3), '') AS names FROM documents GROUP BY 1")
def _(spark, d):
    return derive.patches(table(spark, d, DOC)).select("problem", F.array_join(F.transform(text.file_diffs("patch"), text.diff_filename), ",").alias("names"))


_TAGS = "CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.997 WHEN 2 THEN 0.5 ELSE 0.995 END::DOUBLE"


def _tag_scores(spark, d) -> DataFrame:
    return derive.reasoned(table(spark, d, DOC))


@query("x6_reasoning_tags", f"SELECT doc_id, {_TAGS} AS score FROM documents")
def _(spark, d):
    return _tag_scores(spark, d).select("doc_id", F.round(text.reasoning_tags("completion"), 6).alias("score"))


@query("q1_partial_reasoning", f"SELECT doc_id, {_TAGS} AS reward FROM documents")
def _(spark, d):
    return rewards.registered(_tag_scores(spark, d), reasoning=("completion",)).select("doc_id", F.round("reasoning", 6).alias("reward"))


@query("q2_strict_reasoning", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM documents")
def _(spark, d):
    return _tag_scores(spark, d).select("doc_id", text.strict_reasoning("completion").alias("reward"))


@query("q3_categorical", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM documents")
def _(spark, d):
    return derive.tagged(table(spark, d, DOC)).select("doc_id", rewards.categorical("completion", "answer").alias("reward"))


@query("x7_tool_calls", f"WITH c AS ({derive.CALLS_SQL}) SELECT session, pos, e, e <> 'error' AS ok FROM c")
def _(spark, d):
    kind = F.create_map(*(F.lit(x) for k, (c, _) in derive.COMMANDS.items() for x in (c, k)))[F.col("cmd")]
    return transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session").select("session", F.col("pos").cast("long").alias("pos"), kind.alias("e"), "ok")


@query("x8_command_classes", "SELECT event_id, event_type = 'view' AS lists, event_type IN ('click', 'error') AS searches, event_type = 'purchase' AS reads, event_type = 'purchase' AS reads_precisely, event_type IN ('click', 'error', 'purchase') AS scopes FROM events")
def _(spark, d):
    cmd = F.create_map(*(F.lit(x) for k, (c, _) in derive.COMMANDS.items() for x in (k, c)))[F.col("event_type")]
    return table(spark, d, EVT).select("event_id", text.command_classes(cmd).alias("k")).select("event_id", "k.*")


@query("x9_path_tokens", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'py|' ELSE 'md' END AS tokens FROM events")
def _(spark, d):
    said = F.when(F.col("event_type") == "click", "see src/a.py and src/lib here").otherwise("README.md")
    return table(spark, d, EVT).select("event_id", F.array_join(text.path_tokens(said), "|").alias("tokens"))


@query("x10_failed_output", "SELECT event_id, event_type <> 'error' AS ok FROM events")
def _(spark, d):
    out = F.create_map(*(F.lit(x) for k, (_, r) in derive.COMMANDS.items() for x in (k, r)))[F.col("event_type")]
    return table(spark, d, EVT).select("event_id", text.succeeded(out).alias("ok"))


_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "x11_header_chat",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
    SELECT conv_id, concat('<|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 01 Jan 2025\n\n',
        coalesce(max({_STRIP}) FILTER (n = 1 AND role = 'system'), ''), '<|eot_id|>',
        coalesce(string_agg(concat('<|start_header_id|>', role, '<|end_header_id|>\n\n', {_STRIP}, '<|eot_id|>'), '' ORDER BY n) FILTER (NOT (n = 1 AND role = 'system')), '')) AS rendered
    FROM c GROUP BY 1""",
)
def _(spark, d):
    return chat.conversations(table(spark, d, "conversations")).select("conv_id", chat.header_format("messages", "01 Jan 2025").alias("rendered"))


@query(
    "x12_bracket_chat",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS many, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r0, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t0 FROM conversations),
    m AS (SELECT *, n - CASE WHEN r0 = 'system' THEN 1 ELSE 0 END AS i FROM c),
    g AS (SELECT conv_id, coalesce(bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) FILTER (i > 0), true) AS is_valid,
        concat('<s>', coalesce(string_agg(CASE WHEN role = 'user' THEN concat('[INST] ', CASE WHEN r0 = 'system' AND n = many THEN concat(t0, '\n\n') ELSE '' END, text, '[/INST]') ELSE concat(' ', text, '</s>') END, '' ORDER BY n) FILTER (i > 0), '')) AS t FROM m GROUP BY 1)
    SELECT conv_id, is_valid, CASE WHEN is_valid THEN t END AS rendered FROM g""",
)
def _(spark, d):
    shown = chat.conversations(table(spark, d, "conversations")).select("conv_id", chat.bracket_format("messages").alias("b"))
    return shown.select("conv_id", F.col("b.is_valid").alias("is_valid"), F.col("b.text").alias("rendered"))


# Search/replace diffs


def _flat(blocks):
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["search"], F.lit("=>"), b["replace"])), "|")


@query("d1_parse_blocks", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '=>size ', p_size) WHEN 1 THEN 'name=>title|brand=>maker' ELSE concat('=>size ', p_size) END AS blocks FROM part")
def _(spark, d):
    shown = derive.coded(table(spark, d, "part")).withColumn("shown", diffs.render_blocks("blocks"))
    return shown.select("p_partkey", _flat(diffs.parse_blocks("shown")).alias("blocks"))


@query("d1_parse_malformed", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '=>size ', p_size) WHEN 3 THEN concat('=>', p_name) WHEN 4 THEN '' ELSE concat(p_brand, '=>', p_name) END AS blocks FROM part")
def _(spark, d):
    b, n = F.col("p_brand"), F.col("p_name")
    shown = by_modulus(
        F.col("p_partkey"),
        say("<<<<<<< SEARCH\n", b, "\n=======\nsize ", F.col("p_size").cast("string"), "\n>>>>>>> REPLACE"),
        say("<<<<<<< SEARCH\n", b, "\n", n, "\n>>>>>>> REPLACE\n"),
        say("<<<<<< SEARCH\n", b, "\n======\n", n, "\n>>>>>> REPLACE"),
        say("<<<< SEARCH\n===\n", n, "\n>>>> REPLACE"),
        say("SEARCH without ", b),
    )
    return table(spark, d, "part").select("p_partkey", _flat(diffs.parse_blocks(shown, "compat")).alias("blocks"))


@query("d1_marker_lines", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat(p_name, chr(10), '=====', chr(10), p_brand, '=>new') WHEN 1 THEN concat(p_brand, '=>new') WHEN 2 THEN concat(p_brand, '=>', p_name) WHEN 3 THEN '' WHEN 4 THEN concat(p_brand, '=>', chr(10)) ELSE concat('=>', p_name, chr(10), '=======') END AS blocks FROM part")
def _(spark, d):
    b, n = F.col("p_brand"), F.col("p_name")
    shown = by_modulus(
        F.col("p_partkey"),
        say("<<<<<<< SEARCH\n", n, "\n=====\n", b, "\n=======\nnew\n>>>>>>> REPLACE"),
        say("<<<<<<< SEARCH\nunclosed\n<<<<<<< SEARCH\n", b, "\n=======\nnew\n>>>>>>> REPLACE\n<<<<<<< SEARCH\nmore\n=======\n"),
        say("=======\n>>>>>>> REPLACE\n<<<<< SEARCH\n", b, "\n===== middle\n", n, "\n>>>>> REPLACE"),
        say("<<<<<<< SEARCH\n", b, "\n>>>>>>> REPLACE\n=======\n", n, "\n>>>>>>> REPLACE"),
        say("<<<<<<< SEARCH\n", b, "\n=======\n\n\n>>>>>>> REPLACE"),
        say("<<<<<<< SEARCH\n=======\n", n, "\n=======\n>>>>>>> REPLACE"),
    )
    return table(spark, d, "part").select("p_partkey", _flat(diffs.parse_blocks(shown)).alias("blocks"))


@query("d1_last_cut", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN concat(p_brand, '=>', p_name, ' =====;') ELSE '' END AS blocks FROM part")
def _(spark, d):
    b, n = F.col("p_brand"), F.col("p_name")
    shown = by_modulus(F.col("p_partkey"), say("REPLACE> ", b, " <SEARCH ", n, " =====;"), say("REPLACE> ===== <SEARCH"))
    return table(spark, d, "part").select("p_partkey", _flat(diffs.parse_blocks(shown, "compat")).alias("blocks"))


@query("d2_generate_blocks", "SELECT p_partkey, concat('b ', p_brand, '=>b ', p_size) AS blocks FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    code = lambda x: say("a\nb ", x, "\nc")
    made = part.select("p_partkey", diffs.diff_blocks(code(F.col("p_brand")), code(F.col("p_size").cast("string")), 0).alias("blocks"))
    return made.select("p_partkey", _flat(F.col("blocks")).alias("blocks"))


@query("d3_apply_blocks", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(c, p_brand, concat('size ', p_size)) WHEN 1 THEN replace(replace(c, 'name', 'title'), 'brand', 'maker') ELSE c END AS code FROM (SELECT *, concat('name = ''', p_name, '''\nbrand = ''', p_brand, '''') AS c FROM part)")
def _(spark, d):
    return derive.coded(table(spark, d, "part")).select("p_partkey", diffs.apply_blocks("code", "blocks").alias("code"))


@query("d4_render_blocks", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('<<<<<<< SEARCH\n', p_brand, '\n=======\nsize ', p_size, '\n>>>>>>> REPLACE') WHEN 1 THEN '<<<<<<< SEARCH\nname\n=======\ntitle\n>>>>>>> REPLACE\n\n<<<<<<< SEARCH\nbrand\n=======\nmaker\n>>>>>>> REPLACE' ELSE concat('<<<<<<< SEARCH\n\n=======\nsize ', p_size, '\n>>>>>>> REPLACE') END AS shown FROM part")
def _(spark, d):
    return derive.coded(table(spark, d, "part")).select("p_partkey", diffs.render_blocks("blocks").alias("shown"))


_QUALITY = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.45 WHEN 3 THEN 0.2 WHEN 4 THEN 0.65 ELSE 0.45 END::DOUBLE AS {0} FROM part"


def _formats(spark, d) -> DataFrame:
    one = lambda s: say("<<<<<<< SEARCH\n", s, "\n=======\nnew\n>>>>>>> REPLACE")
    b = F.col("p_brand")
    plain = by_modulus(F.col("p_partkey"), one(b), say(one(b), "\n\n", one(F.col("p_name"))), say("SEARCH only ======= ", b), say("nothing of ======= ", b), say("<<<< SEARCH\n", b, "\n=======\nnew\n>>>> REPLACE"), say("<<<<<< SEARCH\n", b, "\n======\nnew\n>>>>>> REPLACE"))
    return table(spark, d, "part").select("p_partkey", plain.alias("shown"))


@query("d5_format_quality", _QUALITY.format("quality"))
def _(spark, d):
    return _formats(spark, d).select("p_partkey", diffs.format_quality("shown").alias("quality"))


@query("q4_diff_format", _QUALITY.format("reward"))
def _(spark, d):
    return _formats(spark, d).select("p_partkey", rewards.diff_format(say("<answer>", F.col("shown"), "</answer>")).alias("reward"))


@query("d6_block_similarity", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS similarity FROM part")
def _(spark, d):
    b = lambda s, r: F.array(derive.block(s, r))
    same = b(F.col("p_name"), "x")
    made = table(spark, d, "part").select("p_partkey", same.alias("a"), by_modulus(F.col("p_partkey"), same, b(say(F.col("p_name"), "\nmore\nlines"), "x"), diffs.no_blocks()).alias("b"))
    return rewards.block_similarity(made, "a", "b", "p_partkey")


@query("q5_diff_similarity", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS similarity FROM part")
def _(spark, d):
    one = lambda s, r: say("<<<<<<< SEARCH\n", s, "\n=======\n", r, "\n>>>>>>> REPLACE")
    b = F.col("p_brand")
    given = by_modulus(F.col("p_partkey"), say("<answer>```\n", one(b, "new"), "\n```</answer>"), say("<answer>\n", one(b, "old"), "\n</answer>"), F.lit("no answer"))
    return rewards.diff_similarity(table(spark, d, "part").select("p_partkey", given.alias("completion"), one(b, "new").alias("diffs")), "p_partkey")


@query("d7_hunks", "SELECT doc_id, concat(' same\nold ', doc_id, '=> same\nnew ', doc_id) AS blocks FROM documents")
def _(spark, d):
    k = F.col("doc_id").cast("string")
    hunk = say("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@ def f\n  same\n-old ", k, "\n+new ", k, "\n@@ -9,1 +9,1 @@\n same\n")
    return table(spark, d, DOC).select("doc_id", _flat(diffs.hunk_blocks(hunk)).alias("blocks"))


@query("d8_sequence_ratio", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE 0.8 END::DOUBLE AS ratio FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    a = by_modulus(k, F.coalesce("source", F.lit("s")), F.lit(""), F.lit("ab"), F.lit("abcd"))
    b = by_modulus(k, F.coalesce("source", F.lit("s")), F.lit("x"), F.lit("bc"), F.lit("abcdef"))
    return table(spark, d, DOC).select("doc_id", F.round(diffs.sequence_ratio(a, b), 6).alias("ratio"))


_MATCH = "SELECT doc_id // 8 AS problem, round(count(*) FILTER (doc_id % 4 IN (1, 2)) / greatest(count(*) FILTER (doc_id % 4 <> 3), count(*) FILTER (doc_id % 4 <> 0)), 6) AS {0} FROM documents GROUP BY 1"


@query("q6_patch_similarity", _MATCH.format("similarity"))
def _(spark, d):
    return rewards.patch_similarity(derive.patches(table(spark, d, DOC)), "problem")


@query("q7_test_similarity", "SELECT doc_id // 8 AS problem, round(coalesce(count(*) FILTER (doc_id % 4 = 1) / greatest(count(*) FILTER (doc_id % 4 <> 0), 1), 0), 6) AS similarity FROM documents GROUP BY 1")
def _(spark, d):
    return rewards.patch_similarity(derive.patches(table(spark, d, DOC)), "problem", "test_patch")


@query("q8_file_match", _MATCH.format("reward"))
def _(spark, d):
    return rewards.registered(derive.patches(table(spark, d, DOC)), file_match=("patch", "generated_diff")).select("problem", F.col("file_match").alias("reward"))


@query("q9_terminal_habits", f"WITH c AS ({derive.CALLS_SQL}) SELECT session, round(0.3 * max((e = 'view' AND pos <= 2)::INT) + 0.4 * max((e = 'click' AND pos <= 10)::INT) + 0.3 * max((e = 'purchase' AND pos > 2)::INT), 6) AS habits FROM c GROUP BY 1")
def _(spark, d):
    return transcripts.habits(transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session"), "session")


_CHAIN = "SELECT DISTINCT s.session FROM (SELECT session, min(pos) AS p FROM c WHERE e = 'click' AND pos <= 10 GROUP BY 1) s JOIN c ON c.session = s.session AND c.e = 'purchase' AND c.pos > s.p"


@query(
    "q10_exploration_depth",
    f"""WITH c AS ({derive.CALLS_SQL}), ch AS ({_CHAIN}),
    l AS (SELECT *, lag(e) OVER (PARTITION BY session ORDER BY pos) AS b FROM c),
    dup AS (SELECT DISTINCT session FROM (SELECT session, e FROM c WHERE pos <= 10 GROUP BY 1, 2 HAVING count(*) > 1)),
    s AS (SELECT session, count(*) AS n, count(*) FILTER (pos <= 6 AND e <> 'error') AS ok6, bool_or(e = 'purchase') AS precise, bool_or(e = 'click' AND pos <= 10) AS scoped,
        bool_or(pos <= 10 AND e = 'error' AND b = 'error') AS again, bool_or(pos <= 10 AND e = 'signup') AS cut FROM l GROUP BY 1),
    t AS (SELECT s.*, s.session IN (SELECT session FROM ch) AS chain, s.session IN (SELECT session FROM dup) AS dup FROM s)
    SELECT session, round(greatest(0, least(1, CASE WHEN chain THEN 0.25 ELSE 0.2 * precise::INT + 0.15 * scoped::INT END + CASE WHEN n >= 6 THEN 0.2 * ok6 / 6 ELSE 0 END
        - least(0.2, 0.07 * dup::INT + 0.07 * coalesce(again, false)::INT + CASE WHEN cut AND (chain OR NOT precise) THEN 0.1 ELSE 0 END))), 6)::DOUBLE AS depth FROM t""",
)
def _(spark, d):
    return transcripts.depth(transcripts.calls_by_window(derive.transcripts(table(spark, d, EVT)), "session"), "session")


# Mining


def _mined(spark, d) -> DataFrame:
    return mining.mine(derive.source_files(table(spark, d, "part")))


_N_VARS = "CASE p_partkey % 5 WHEN 2 THEN 18 WHEN 3 THEN 3 ELSE 4 END"


@query("t1_mine_functions", f"SELECT p_partkey AS file_id, concat('f', p_partkey % 7) AS function_name, 4 AS start_line, CASE p_partkey % 5 WHEN 2 THEN 28 WHEN 3 THEN 13 WHEN 4 THEN 9 ELSE 14 END AS end_line, CASE p_partkey % 5 WHEN 2 THEN 18 WHEN 3 THEN 3 ELSE 4 END AS n_body, {_N_VARS} AS n_vars FROM part")
def _(spark, d):
    return _mined(spark, d).select("file_id", "function_name", "start_line", "end_line", "n_body", "n_vars")


@query("t1_mine_forms", "SELECT p_partkey AS file_id, CASE p_partkey % 2 WHEN 0 THEN 3 ELSE 5 END AS n_vars, 3 AS start_line, 9 AS end_line, false AS has_return FROM part")
def _(spark, d):
    one = derive.odd_sources(table(spark, d, "part"))
    return mining.mine(one).select("file_id", "n_vars", "start_line", "end_line", F.contains("implementation", F.lit("\r")).alias("has_return"))


@query("t2_mask_span", "SELECT p_partkey, concat('a\n# MASKED: f function (lines 2-3)\n', p_name) AS masked FROM part")
def _(spark, d):
    part = table(spark, d, "part").withColumns({"content": say("a\n", F.col("p_brand"), "\nc\n", F.col("p_name"), "\n"), "start": F.lit(2), "end": F.lit(3)})
    return part.select("p_partkey", mining.mask_span("content", F.lit("f"), "start", "end").alias("masked"))


@query("f10_docstring_quality", "SELECT p_partkey AS file_id FROM part WHERE p_partkey % 5 <> 4")
def _(spark, d):
    return _mined(spark, d).where(mining.good_docstring()).select("file_id")


@query("f11_code_quality", "SELECT p_partkey AS file_id, CASE p_partkey % 5 WHEN 1 THEN 'sql' WHEN 2 THEN 'variables' WHEN 3 THEN 'simple' END AS reason FROM part")
def _(spark, d):
    return _mined(spark, d).select("file_id", mining.code_reject().alias("reason"))


@query("a7_task_statistics", "SELECT count(*) AS tasks, round(avg(96 + length(CAST(p_partkey AS VARCHAR))), 6) AS docstring_length, round(avg(184 + length(CAST(p_partkey AS VARCHAR))), 6) AS implementation_length FROM part WHERE p_partkey % 5 = 0")
def _(spark, d):
    return mining.task_statistics(_mined(spark, d).where(mining.good_docstring() & mining.code_reject().isNull()))


@query("a8_common_names", "SELECT concat('f', p_partkey % 7) AS function_name, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 5")
def _(spark, d):
    return mining.common_names(_mined(spark, d), "file_id")


@query("a9_quality_funnel", "SELECT count(*) AS files, count(*) FILTER (p_partkey % 5 = 0) AS files_accepted, count(*) FILTER (p_partkey % 5 = 1) AS skipped_sql, count(*) FILTER (p_partkey % 5 = 2) AS skipped_variables, count(*) FILTER (p_partkey % 5 = 3) AS skipped_simple, round(count(*) FILTER (p_partkey % 5 = 0) / count(*), 6) AS share_accepted FROM part")
def _(spark, d):
    return mining.funnel(_mined(spark, d), derive.source_files(table(spark, d, "part")))


@query("v1_reward_registry", "SELECT doc_id, round(0.7 * CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 1 ELSE 0 END, 6)::DOUBLE AS reward FROM documents")
def _(spark, d):
    return rewards.registered(derive.tagged(table(spark, d, DOC)), categorical=("completion", "answer"), reasoning=("completion",)).select("doc_id", "reward")


@query("v2_batch_function", "SELECT doc_id, doc_id * 2 AS doubled FROM documents WHERE doc_id % 2 = 0")
def _(spark, d):
    even = evaluation.filter_batches(table(spark, d, DOC).select("doc_id"), lambda b: b.doc_id % 2 == 0)
    return evaluation.map_batches(even, lambda b: b.assign(doubled=b.doc_id * 2), "doc_id long, doubled long")
