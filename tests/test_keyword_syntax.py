"""The classic query syntax against a plain evaluation of the same queries by hand."""

from __future__ import annotations

import pytest

from millrace.registry import PropertyError

TEXTS = {
    1: "The quick brown fox", 2: "quick fox, brown dog", 3: "a lazy dog sleeps", 4: "roam the foam", 5: "3.14 and 2.71", 6: "don't stop", 7: "你好 world", 8: "fxo", 9: None, 10: "", 11: "brown quick", 12: "apple banana cherry",
}
CASES = [
    ("quick", {1, 2, 11}), ("quick AND dog", {2}), ("quick dog", {1, 2, 3, 11}), ("+quick -dog", {1, 11}), ("quick NOT dog", {1, 11}), ("NOT dog", set()), ("quick && !fox", {11}),
    ('"quick brown"', {1}), ('"quick fox"', {2}), ('"quick fox"~1', {1, 2}), ('"quick brown"~2', {1, 2, 11}), ('"quick brown"~1', {1, 2}), ('"brown quick"~2', {1, 11}),
    ("fo?", {1, 2}), ("fo*", {1, 2, 4}), ("roam~", {4}), ("foam~1", {4}), ("fox~1", {1, 2, 8}), ("fxo~1", {1, 2, 8}), ("roam~0.8", {4}), ("dig~1", {2, 3}),
    ("[apple TO banana]", {12}), ("{apple TO banana}", set()), ("[ba TO bb}", {12}), ("[x TO y]", set()), ("[w TO *]", {7}), ("/d[ou]g/", {2, 3}), ("(quick OR lazy) AND dog", {2, 3}),
    ("text:quick", {1, 2, 11}), ("other:quick", set()), ("text:(lazy OR foam)", {3, 4}), ("*:*", {1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12}), ("quick^2", {1, 2, 11}), ("quick^0", set()), ("+quick^0 dog", {2}), ("3.14", {5}),
    ("don't", {6}), ("你", {7}), ("你们", {7}), ('"你们"', set()), ("\\+quick", {1, 2, 11}), ("@", set()), ("_!@,-", set()), ("quick-dog", {1, 2, 3, 11}), ('"quick-dog"', set()),
]


def test_queries(spark, op):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    for query, want in CASES:
        assert {r.id for r in op("KeywordSearch", df, attribute="text", keyword=query).collect()} == want, query


@pytest.mark.parametrize("query", ["(a", "a)", "a AND", "OR a", "a AND OR b", '"a', "+", "[a TO", "/~a/", "a:"])
def test_unreadable_queries_are_refused(spark, op, query):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    with pytest.raises(PropertyError):
        op("KeywordSearch", df, attribute="text", keyword=query)


def test_a_text_is_cut_into_tokens_once(spark, op):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    plan = op("KeywordSearch", df, attribute="text", keyword='"quick brown" AND (fox OR dog*) AND NOT "lazy dog"')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
