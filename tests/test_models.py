from filingloom.operators import models


def test_text_sentiment(spark):
    def classifier():
        return lambda texts: [{"neutral": 0.2, "negative": 0.1 if "good" in t else 0.7, "positive": 0.7 if "good" in t else 0.1} for t in texts]

    rows = [(1, "good " * 600), (2, "bad " * 30), (3, "short"), (4, None), (5, " ")]
    got = {r.id: r for r in models.text_sentiment(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", classifier).collect()}
    assert round(got[1].compound, 9) == 0.6 and got[1].chunks == 2 and round(got[2].compound, 9) == -0.6
    assert all((got[i].compound, got[i].chunks, round(got[i].neutral, 3)) == (0.0, 0, 0.333) for i in (3, 4, 5))


def test_replies(spark):
    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if "busy" in prompt and seen[prompt] < 3:
                raise models.Busy
            if "broken" in prompt:
                raise ValueError
            return '{"outlook": "bullish", "confidence": "high"}'

        return call

    df = spark.createDataFrame([(1, "fine"), (2, "busy"), (3, "broken"), (4, None)], "id int, t string")
    got = {r.id: r.reply for r in models.ask(df, "t", "reply", client, wait=0.01).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] is None
    scored = {r.id: r.outlook.score for r in models.outlook_scores(df.withColumn("u", df.t), "t", "u", client).where("id <> 2").collect()}
    assert scored == {1: 0.24, 3: 0.0, 4: 0.24}


def test_softmax_and_provider():
    p = models.softmax([1000.0, 1000.0, 0.0])
    assert p[:2] == [0.5, 0.5] and p[2] == 0.0 and models.softmax([]) == []
    one, two = (lambda: str), (lambda: repr)
    assert models.provider("auto", {"a": None, "b": one, "c": two}) == ("b", one) and models.provider("C", {"b": one, "c": two}) == ("c", two)
    assert models.provider("x", {"b": one}) is None and models.provider("auto", {}) is None


def test_anomaly_notes(spark):
    df = spark.createDataFrame([(1, "AB", "spike", "Debt", "up", ["one", "two"]), (2, None, None, "broken", None, None)], "id int, ticker string, type string, title string, description string, contexts array<string>")
    client = lambda: lambda prompt: 1 / 0 if "broken" in prompt else " " + prompt
    args = ("ticker", "type", "title", "description", "contexts")
    got = {r.id: r.explanation for r in models.anomaly_notes(df, *args, client).collect()}
    assert "one; two" in got[1] and "AB" in got[1] and got[2] == "LLM analysis unavailable."
    assert {r.explanation for r in models.anomaly_notes(df, *args, None).collect()} == {None}
