from loamwork.plans import email


def _documents(spark, path):
    long = [f"w{j}" for j in range(200)]
    texts = [
        " ".join(long),
        " ".join(["other", *long[1:]]),  # near copy, differs at the start
        " ".join(long),  # exact copy
        "Dear all, this is the common opening of " + " ".join(f"x{j}" for j in range(50)),
        "Dear all, this is the common opening of " + " ".join(f"y{j}" for j in range(50)),
        "",
        "",
    ]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")


def test_clusters_come_from_whole_texts(spark, tmp_path):
    _documents(spark, str(tmp_path))
    got = {r.id: (r.root, r.kept) for r in email.eml_14(spark, str(tmp_path)).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (0, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True)}
    report = {r.kind: (r.groups, r.threads, r.dropped) for r in email.eml_16(spark, str(tmp_path)).collect()}
    assert report == {"clustered": (1, 3, 2), "single": (4, 4, 0)}
