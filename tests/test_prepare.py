from spendlens.fields import Fields
from spendlens.operators.prepare import PrepareObservation, keep_first, prepare_texts, text_funnel

F_ = Fields()


def test_keep_first_file_order(spark):
    # FIXTURES §3.2: texts a,b,a,<blank>,b with codes null,2,1,9,3 in order
    rows = [("a", None, 0), ("b", "2", 1), ("a", "1", 2), (" ", "9", 3), ("b", "3", 4)]
    df = spark.createDataFrame(rows, "LongDescription string, PurposeCode string, ord long")
    out = {r.text: r.PurposeCode for r in prepare_texts(df, F_, order=["ord"]).collect()}
    assert out == {"a": None, "b": "2"}


def test_keep_first_unique_min_ordinal(spark):
    rows = [(i % 7, i) for i in range(100)][::-1]
    df = spark.createDataFrame(rows, "k int, o int")
    got = {r.k: r.o for r in keep_first(df, "k", "o").collect()}
    assert got == {k: k for k in range(7)}


def test_funnel_counts_and_observation(spark):
    rows = [("a", 0), ("b", 1), ("a", 2), ("", 3), ("  ", 4), ("c", 5)]
    df = spark.createDataFrame(rows, "LongDescription string, ord long")
    obs = PrepareObservation("t1")
    out = prepare_texts(df, F_, order=["ord"], observation=obs)
    assert sorted(r.text for r in out.collect()) == ["a", "b", "c"]
    m = obs.get()
    # blanks collapse to one text by dedup first, so at most one is removed as blank
    assert m == {"n_start": 6, "n_duplicates": 2, "n_blank": 1, "n_end": 3}
    from spendlens.operators.prepare import with_activity_text

    f = text_funnel(with_activity_text(df, F_), F_.key, F_.text).first().asDict()
    assert f == {"n_start": 6, "n_duplicates": 2, "n_blank": 1, "n_end": 3}


def test_missing_columns_default_to_null(spark):
    df = spark.createDataFrame([("Title only", 1)], "ProjectTitle string, ord long")
    out = prepare_texts(df, F_, order=["ord"]).first()
    assert out.text == "Title only" and out.PurposeCode is None


def test_prepare_counts_activities_per_text(spark):
    rows = [("a", 0), ("b", 1), ("a", 2), ("a", 3)]
    df = spark.createDataFrame(rows, "LongDescription string, ord long")
    got = {r.text: (r.ord, r.n_activities) for r in prepare_texts(df, F_, order=["ord"]).collect()}
    assert got == {"a": (0, 3), "b": (1, 1)}


def test_repeated_texts_are_reduced_before_any_sort(spark):
    # one text under two codes, NULL ordinals, and a text that only blank rows carry
    rows = [("a", "2", 5), ("a", "1", 3), ("a", "2", None), ("b", None, None), ("a", "1", 9), (None, "7", 1), ("", "8", 0)]
    df = spark.createDataFrame(rows, "LongDescription string, PurposeCode string, ord long")
    out = prepare_texts(df, F_, order=["ord"])
    assert {r.text: (r.PurposeCode, r.ord, r.n_activities) for r in out.collect()} == {"a": ("1", 3, 4), "b": (None, None, 1)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # below the sorted limit, whose rows may spill, there is a hash aggregation with the texts as keys
    below = plan[plan.rindex("WindowGroupLimit"):]
    assert "HashAggregate(keys=[text_key" in below and "min(ord" in below


def test_first_rows_by_two_columns_and_by_text(spark):
    rows = [("a", "x", 2, 1), ("a", "y", 1, 2), ("a", "z", 1, 3), ("b", "w", 3, 0)]
    df = spark.createDataFrame(rows, "LongDescription string, PurposeCode string, yr int, ord long")
    got = {r.text: r.PurposeCode for r in prepare_texts(df, F_, order=["yr", "ord"]).collect()}
    assert got == {"a": "y", "b": "w"}
    assert {r.text: r.PurposeCode for r in prepare_texts(df, F_, order=["PurposeCode"]).collect()} == {"a": "x", "b": "w"}
