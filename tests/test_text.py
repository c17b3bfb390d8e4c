import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("Run the Linter, then push!", ["run", "the", "linter", "then", "push"]),
        ("提交代码", ["提交代码", "提交", "交代", "代码"]),
        ("推 code", ["推", "code"]),
        ("ranking ranked ranks class", ["rank", "rank", "rank", "class"]),
        ("", []),
        ("go go", ["go", "go"]),
    ],
)
def test_tokenize(spark, text, terms):
    assert one(spark, X.tokenize(F.lit(text))) == terms


def test_tokenize_null_and_long(spark):
    assert one(spark, X.tokenize(F.lit(None).cast("string"))) is None
    assert one(spark, F.size(X.tokenize(F.repeat(F.lit("ab "), 50_000)))) == 50_000


@pytest.mark.parametrize(("a", "b", "s"), [("PNPM over npm", "pnpm over NPM", 1.0), ("a b c", "b c d", 0.5), ("", "a", 0.0), ("x", "y", 0.0)])
def test_similarity(spark, a, b, s):
    assert one(spark, X.similarity(X.tokenize(F.lit(a)), X.tokenize(F.lit(b)))) == pytest.approx(s)


def test_split_cue(spark):
    cue = "Do this:\n1. apply the ranking\n2) enter the units\n- ok\n• line up slots"
    assert one(spark, X.split_cue(F.lit(cue))) == ["apply the ranking", "enter the units", "line up slots"]
    assert one(spark, X.split_cue(F.lit("1. only one part here"))) == []


@pytest.mark.parametrize(("text", "yes"), [("Actually, minutes", True), ("no, not that", True), ("Nothing wrong", False), ("scratch that please", True), ("we actually did", False), ("No way", False)])
def test_is_correction(spark, text, yes):
    assert one(spark, X.is_correction(F.lit(text))) is yes


def test_topic_terms(spark):
    assert one(spark, X.topic_terms(X.tokenize(F.lit("actually, switch it to minutes instead, minutes!")))) == ["minute"]


@pytest.mark.parametrize(
    ("text", "claims"),
    [
        ("I prefer tabs over spaces. Never force-push a shared branch!", [("preference", "tabs over spaces"), ("constraint", "force-push a shared branch")]),
        ("I never got the email", []),
        ("我更喜欢简短的队列，不要太长。", [("preference", "简短的队列，不要太长")]),
        ("请不要删除日志", [("constraint", "删除日志")]),
        ("", []),
    ],
)
def test_stated_claims(spark, text, claims):
    assert [(c["type"], c["subject"]) for c in one(spark, X.stated_claims(F.lit(text)))] == claims


def test_tool_digest_takes_the_first_described_argument(spark):
    assert one(spark, X.tool_digest(F.lit('{"path":"a/b","query":"find\\nme"}'), 10)) == "find"
    assert one(spark, X.tool_digest(F.lit('{"command":"abcdefghijkl"}'), 5)) == "abcde…"
    assert one(spark, X.tool_digest(F.lit('{"other":1}'), 5)) is None
    assert one(spark, X.tool_digest(F.lit("not json"), 5)) is None


@pytest.mark.parametrize(("term", "h"), [("", 2166136261), ("a", 0xE40C292C), ("foobar", 0xBF9CF968)])
def test_fnv1a(spark, term, h):
    assert one(spark, X.fnv1a(F.lit(term))) == h


def test_visible_text(spark, rows):
    df = rows("content array<struct<type:string,text:string>>", ([("text", " a"), ("reasoning", "x"), ("text", "b ")],), ([],))
    assert [r[0] for r in df.select(X.visible_text("content")).collect()] == ["a\nb", ""]
