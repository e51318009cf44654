"""The URL vocabulary as a parameter: weights, scripts, overlapping terms, clashing columns."""

import pytest

from quern.llm import url_filter as U


def verdicts(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, n_soft int")
    return [r.verdict for r in U.judge(df, rules=[], **options).sort("page_id").collect()]


def test_weights_from_a_table(spark):
    rows = [("Alpha", 0.4), ("beta", 0.4), ("gamma", 0.2), ("gamma", 0.1), ("hard", 1.0), ("", 1.0), (None, 1.0), ("none", None), ("over", 0.6), ("over me", 0.6)]
    v = U.Vocabulary.table(spark.createDataFrame(rows, "term string, weight double"))
    assert v.weights == {"alpha": 0.4, "beta": 0.4, "gamma": 0.2, "hard": 1.0, "over": 0.6, "over me": 0.6}
    urls = ["http://a/alpha/beta", "http://a/alpha/beta/GAMMA", "http://a/alpha/alpha/alpha", "http://a/hard", "http://a/harder", "http://a/over me", None, ""]
    assert verdicts(spark, urls, vocabulary=v) == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow"]


def test_too_long_a_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(U, "TERMS", 2)
    with pytest.raises(ValueError):
        U.Vocabulary.table(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "term string, weight double"))


def test_scripts_and_boundaries(spark):
    v = U.Vocabulary.of(["порно", "赌博", "straße"], ["ставки", "gratis"], 2)
    urls = ["http://пример.рф/порно", "http://пример.рф/порнох", "http://a.cn/在线赌博网", "http://a.de/Straße/1", "http://a.de/Hauptstraße", "http://a/ставки-gratis", "http://a/éгratis/ставки", "http://a/%D0%BF%D0%BE%D1%80%D0%BD%D0%BE"]
    assert verdicts(spark, urls, vocabulary=v) == ["block", "allow", "block", "block", "allow", "block", "allow", "allow"]
    assert verdicts(spark, urls[-1:], vocabulary=U.Vocabulary(v.weights, decode=True)) == ["block"]


def test_empty_vocabulary(spark):
    assert verdicts(spark, ["http://a/porn"], vocabulary=U.Vocabulary({})) == ["allow"]
