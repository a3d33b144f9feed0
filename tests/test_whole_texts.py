import difflib

from loamwork.plans import models, qa, rewards


def test_whole_texts_are_compared(spark, tmp_path):
    opening = "one two three four five six seven eight nine ten eleven twelve thirteen"
    body = " ".join(f"w{j}" for j in range(100))
    texts = [f"{opening} {body}", f"{opening} and other words", f"new start here {body}", "lone words only", f"{opening} {body}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    grams = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    share = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    near = {i: max((share(i, j) for j in (0, 2, 4))) for i in (1, 3)}
    got = {r.id: r.similarity for r in qa.qaf_24(spark, str(tmp_path)).collect()}
    assert got == {i: round(s, 6) for i, s in near.items() if s >= 0.7}
    lead = {}
    for i in range(len(texts)):
        lead[i] = min((j for j in range(i) if lead[j] == j and share(i, j) >= 0.7), default=i)
    got = {r.id: r.leader for r in models.qaf_25(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 2: 0, 4: 0} == {i: j for i, j in lead.items() if i in got} and all(lead[i] == i for i in (1, 3))


def test_character_overlap_takes_whole_texts(spark, tmp_path):
    text = "abcdefghij klmnop " * 20 + "tail of the text, beyond the cut " * 12
    spark.createDataFrame([(2, 1, "assistant", text), (3, 1, "assistant", text[::-1])], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    completion = {2: text, 3: f"{text[::-1][:80]} [Source: s1] [source:  s2 ]<Answer> {text[::-1][:20]}</answer>"}
    for r in rewards.rwd_01(spark, str(tmp_path)).collect():
        x = text if r.conv_id == 2 else text[::-1]
        assert r.share == round(sum(m.size for m in difflib.SequenceMatcher(None, x, completion[r.conv_id]).get_matching_blocks()) / len(x), 6)
