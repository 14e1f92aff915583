import random
import pytest
from pyspark.sql import functions as F

from postmatch.functions import numbers, text
from postmatch.options import MatchOptions


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, ""),
        ("A  \tB ", "a b"),
        ("  Ä\x1c\x85b　", "ä b"),
        ("line\r\n one\n\n", "line one"),
        (" \n ", ""),
    ],
)
def test_normalise(one, given, expected):
    assert one(text.normalise(F.col("x")), x=given) == expected
    assert one(text.normalise(text.normalise(F.col("x"))), x=given) == expected


def test_squeeze_keeps_case(one):
    assert one(text.squeeze(F.col("x")), x=" Ab \n C ") == "Ab C"


def test_strip_cuts_only_the_ends(one):
    assert one(text.strip(F.col("x")), x="\n a  b\t") == "a  b"


def test_tokens(one):
    found = one(text.tokens(F.col("x")), x="c++ c# node.js, agile. ci/cd 3d")
    assert found == ["c++", "c#", "node.js", "agile.", "ci/cd", "d"]


def test_content_words_are_the_content_tokens_of_the_tokens(one):
    rng = random.Random(1)
    for _ in range(40):
        x = "".join(rng.choices("abz09+#./- \n,é𝒳_", k=60)) + " the and with"
        assert one(text.content_words(F.col("x"), ["the", "with"]), x=x) == one(
            text.content_tokens(text.tokens(F.col("x")), ["the", "with"]), x=x)


def test_content_tokens(one):
    words = text.content_tokens(text.tokens(F.col("x")), ["with", "it's"])
    assert one(words, x="go with it is java java") == ["java", "java"]
    assert one(text.content_tokens(text.tokens(F.col("x")), []), x="and a") == ["and"]


@pytest.mark.parametrize(
    "given, default, expected",
    [(" Yes ", False, True), ("no", True, False), (None, True, True), (None, False, False),
     ("ON", False, True), ("1", False, True), ("2", True, False), ("", True, False)],
)
def test_flag(one, given, default, expected):
    assert one(text.flag(F.col("x"), default), x=given) is expected


def test_escape(one):
    assert one(text.escape_html(F.col("x")), x="<a \"b\" 'c'&>") == (
        "&lt;a &quot;b&quot; &#x27;c&#x27;&amp;&gt;"
    )


def test_contained_terms_are_substrings(one):
    terms = text.contained_terms(F.col("x"), ["api", "it's", "java", "sql"])
    assert one(terms, x="fastapi, javascript; it's mysql") == ["api", "it's", "java", "sql"]
    assert one(text.contained_terms(F.col("x"), []), x="abc") == []


@pytest.mark.parametrize(
    "value, expected",
    [("NULL", 0.0), ("double('NaN')", 0.0), ("-3D", 0.0), ("140D", 100.0), ("3.125D", 3.12),
     ("3.135D", 3.14), ("double('Infinity')", 100.0), ("100D", 100.0)],
)
def test_bounded_percentage(one, value, expected):
    assert one(numbers.bounded_percentage(F.expr(f"cast({value} as double)"))) == expected


@pytest.mark.parametrize(
    "part, whole, expected",
    [("3", "7", 42.86), ("1", "0", 0.0), ("1", "NULL", 0.0), ("2", "1", 100.0), ("0", "4", 0.0)],
)
def test_percentage(one, part, whole, expected):
    column = numbers.percentage(F.expr(part), F.expr(f"cast({whole} as int)"))
    assert one(column) == expected


@pytest.mark.parametrize(
    "a, b, expected",
    [("1,0", "1,0", 100.0), ("1,0", "-1,0", 0.0), ("0,0", "1,0", 0.0), ("1,1", "1,0", 70.71)],
)
def test_cosine(one, a, b, expected):
    vector = "cast(array({}) as array<float>)".format
    column = numbers.cosine_percentage(F.expr(vector(a)), F.expr(vector(b)))
    assert one(column) == expected


def test_cosine_of_nothing_or_nan_is_zero(one):
    v = F.expr("array(1f, 2f)")
    assert one(numbers.cosine_percentage(F.expr("cast(null as array<float>)"), v)) == 0.0
    assert one(numbers.cosine_percentage(F.expr("array(float('NaN'), 1f)"), v)) == 0.0
    assert one(numbers.cosine_percentage(F.expr("array(1f)"), v)) == 0.0


def test_options_from_environment():
    options = MatchOptions.from_env(
        {"JOB_TITLE_TARGET": "Tester", "USER_EXPERIENCE_YEARS": "4.5"}, top_matches=3
    )
    assert (options.keyword, options.location) == ("Tester", "")
    assert (options.experience_years, options.top_matches) == (4.5, 3)
    assert sum(options.weights.values()) == pytest.approx(1.0)
