"""Text functions, search/replace diffs and sequence ratios on single cases."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendloom.functions import diffs, text
from mendloom.operators import rewards


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given_", "expected"), [("<answer> a \n</answer>", "a"), ("x<answer>b", "b"), ("none", "N/A"), ("<answer></answer>", "")])
def test_answer_tag(spark, given_, expected):
    assert one(spark, text.answer_tag("t"), t=given_) == expected


@pytest.mark.parametrize(("given_", "expected"), [("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""])])
def test_lines_are_those_of_splitlines(spark, given_, expected):
    assert given_.splitlines() == expected
    assert one(spark, text.lines("t"), t=given_) == expected


def test_blocks_of_a_diff_with_blank_lines_and_an_empty_search(spark):
    shown = "<<<<<<< SEARCH\na\n\n  b\n=======\nc\n>>>>>>> REPLACE\n\n<<<<< SEARCH\n=====\nnew\n>>>>> REPLACE"
    found = one(spark, diffs.parse_blocks("t"), t=shown)
    assert [(b.search, b.replace) for b in found] == [("a\n\n  b", "c"), ("", "new")]
    assert one(spark, diffs.parse_blocks("t"), t="nothing") == []


def test_format_quality_of_one_two_and_no_blocks(spark):
    block = "<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE"
    assert one(spark, diffs.format_quality("t"), t=block) == 1.0
    assert one(spark, diffs.format_quality("t"), t=f"{block}\n\n{block}") == 0.8
    assert one(spark, diffs.format_quality("t"), t="") == 0.0


def test_blocks_by_paragraphs(spark):
    block = "<<<<<<< SEARCH\n  a\n=======\nb\n>>>>>>> REPLACE"
    found = lambda t: [(b.search, b.replace) for b in one(spark, diffs.parse_blocks("t", "compat"), t=t)]
    assert found(block) == [("a", "b")] and found(f"{block}\n\n{block}") == [] and found("=======\nREPLACE") == []
    assert one(spark, diffs.format_quality("t", "compat"), t=f"{block}\n\n{block}") == 0.6


@pytest.mark.parametrize(("before", "after"), [("a\nb\nc", "a\nx\nc"), ("a\nb", "a\nb\nc"), ("a\nb\nc", "a\nc"), ("", "a"), ("a", ""), ("same", "same")])
def test_generated_blocks_lead_from_before_to_after(spark, before, after):
    blocks = diffs.changed_blocks(before, after, 1)
    assert one(spark, diffs.apply_blocks("c", F.from_json("b", diffs.BLOCKS)), c=before, b=__import__("json").dumps(blocks)) == after


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta"]), min_size=2, max_size=6, unique=True), st.integers(0, 5))
def test_round_trip_of_rendered_blocks(spark, words, at):
    before, after = "\n".join(words), "\n".join("new" if i == at % len(words) else w for i, w in enumerate(words))
    frame = spark.createDataFrame([(before, after)], "b string, a string").withColumn("d", diffs.render_blocks(diffs.diff_blocks("b", "a", 1)))
    assert frame.select(diffs.apply_blocks("b", diffs.parse_blocks("d")).alias("x")).first().x == after


@pytest.mark.parametrize(("a", "b"), [("tide", "diet"), ("diet", "tide"), ("abc", ""), ("", ""), ("x" * 300 + "y", "y" + "x" * 300)])
def test_ratio_is_that_of_difflib(spark, a, b):
    want = difflib.SequenceMatcher(None, a, b).ratio()
    assert one(spark, diffs.sequence_ratio("a", "b"), a=a, b=b) == pytest.approx(want)


def _patch(*files):
    return "".join(f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n@@ -1 +1 @@\n-old\n+{body}\n" for f, body in files)


@pytest.mark.parametrize(
    ("oracle", "made", "match", "similar"),
    [
        (_patch(("a", "x"), ("b", "y")), _patch(("b", "y"), ("a", "x")), 1.0, 1.0),
        (_patch(("a", "x"), ("b", "y"), ("c", "z")), _patch(("a", "x"), ("b", "y")), 2 / 3, 2 / 3),
        (_patch(("a", "x")), _patch(("a", "x"), ("n", "y")), 0.5, 0.5),
        ("", "", 1.0, 0.0),
        ("", _patch(("a", "x")), 0.0, 0.0),
    ],
)
def test_patch_rewards(spark, oracle, made, match, similar):
    frame = spark.createDataFrame([(1, oracle, made)], "id long, patch string, generated_diff string")
    assert frame.select(rewards.file_match("patch", "generated_diff").alias("x")).first().x == pytest.approx(match, abs=1e-6)
    assert rewards.patch_similarity(frame, "id").first().similarity == pytest.approx(similar, abs=1e-6)


def test_run_tag(spark):
    assert one(spark, text.run_tag("t"), t="Org/Model 8B!") == "Org_Model_8B"


def quality(spark, text):
    from mendloom.functions import diffs

    return spark.createDataFrame([(text,)], "x string").select(diffs.format_quality("x").alias("q")).first().q


def test_quality_of_malformed_markers(spark):
    six = "<<<<<< SEARCH\ndef hello():\n    print('hello')\n======\ndef hello():\n    print('hello world')\n>>>>>> REPLACE"
    assert quality(spark, six) == 0.45
    assert quality(spark, "<<<< SEARCH\na\n=======\nb\n>>>> REPLACE") == 0.65
    assert quality(spark, None) == quality(spark, "") == 0.0


def test_malformed_blocks_by_paragraphs(spark):
    from mendloom.functions import diffs

    texts = [
        "<<<<<<< SEARCH\ndef hello():\n    print('hello')\ndef hello():\n    print('hello world')\n>>>>>>> REPLACE\ndef hello():\n",
        "<<<< SEARCH\n===\nnew\n>>>> REPLACE",
        "<<<<<<< SEARCH \na\n=====  \nb\n>>>>>>> REPLACE \n",
        "SEARCH\na\nDIVIDER\nb\nREPLACE",
        "no block",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [[(b.search, b.replace) for b in r.b] for r in frame.select("i", diffs.parse_blocks("x", "compat").alias("b")).orderBy("i").collect()]
    assert got[0] == [("def hello():\n    print('hello')", "def hello():\n    print('hello world')")]
    assert got[1:] == [[("", "new")], [("a", "b")], [("", "")], [], []]  # the loosest pattern keeps the place of a block alone
    assert all(not r.b for r in frame.where("i in (0, 4, 5)").select(diffs.parse_blocks("x").alias("b")).collect())
