from loamwork.llm import mixing


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text {i}", "big") for i in range(400)] + [(None, f"rare {i}", "rare") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    big = {r.text for r in got if r.source == "big"}
    assert 0 < len(big) < 400
    rate = next(r.rate for r in got if r.source == "big")
    assert abs(sum(r.source == "big" for r in got) - 400 * rate) < 80


def test_columns_that_clash_with_working_names_stay(spark):
    docs = spark.createDataFrame([(i, "s", -i, f"n{i}", 0.5, [1.0]) for i in range(50)], "doc_id bigint, source string, __u int, __N string, __rate double, __cdf array<double>")
    got = mixing.mix(docs, total=100).collect()
    assert got and all((r["__u"], r["__N"], r["__rate"], r["__cdf"]) == (-r.doc_id, f"n{r.doc_id}", 0.5, [1.0]) for r in got)
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((r.doc_id, r.copy) for r in mixing.mix(docs.select("doc_id", "source"), total=100).collect())
