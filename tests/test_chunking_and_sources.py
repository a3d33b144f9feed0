import pytest
from pyspark.sql import functions as F

from loamwork.operators import chunking as op
from loamwork.sources import files, providers


def test_mdx_keeps_fenced_code(spark):
    text = "import A from 'a'\n\n\n\nText <!-- gone -->here\n```js\nimport B from 'b'\n<Box />\n```\n<Box kind=\"x\" />\n<Wrap>\n\n</Wrap>\nend <br /> x\n"
    got = spark.createDataFrame([(text,)], "t string").select(op.clean_mdx(F.col("t")).alias("t")).first().t
    assert "import A" not in got and "gone" not in got and "Wrap" not in got
    assert "```js\nimport B from 'b'\n<Box />\n```" in got and "<br />" in got and "\n\n\n" not in got


def test_sections_carry_headers():
    text = "intro\n# One\na\n## Two\nb\n```\n# not a header\n```\n# Three\nc"
    assert [m for _, m in op.sections(text)] == [{}, {"h1": "One"}, {"h1": "One", "h2": "Two"}, {"h1": "Three"}]
    assert op.sections(text)[2][0].startswith("## Two") and "# not a header" in op.sections(text)[2][0]


def test_fuse_reaches_a_fixpoint():
    parts = [("a" * 10, {"h1": "x"}), ("b" * 10, {"h1": "y", "h2": "z"}), ("c" * 90, {}), ("d" * 5, {})]
    got = op.fuse(parts, 30, 60)
    assert [len(t) for t, _ in got] == [22, 90, 5] and got[0][1] == {"h1": "x", "h2": "z"}
    assert op.fuse(got, 30, 60) == got


def test_split_bounds_and_coverage():
    text = "Para one. " * 30 + "\n\n" + "x" * 500 + "\n\n" + "word " * 100
    got = op.split_text(text, 120, 20)
    assert all(0 < len(p) <= 120 for p in got)
    assert "".join(text.split()) in "".join("".join(got).split()) or set("".join(text.split())) <= set("".join(got))
    assert op.split_text("  ", 10, 2) == []


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a.md", "# T\n" + "text. " * 900), ("b.md", ""), ("c.md", None)], "file string, text string")
    rows = op.chunk_markdown(df).collect()
    assert {r.file for r in rows} == {"a.md"} and [r.idx for r in rows] == list(range(len(rows))) and all(len(r.content) <= 2048 and r.h1 == "T" for r in rows)
    assert len({r.hash for r in rows}) == len(rows)


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "sub" / "b.mdx").write_text("é")
    (tmp_path / "c.txt").write_text("no")
    got = {r.file: r.text for r in files.markdown_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# A\nx", "sub/b.mdx": "é"}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\nbad\n')
    (tmp_path / "_skip.jsonl").write_text('{"id": 9}\n')
    assert {r.id for r in files.lenient_jsonl(spark, str(tmp_path), "id int").collect()} == {1, 2, 3}
    assert files.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.strict_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def test_mbox(spark, tmp_path):
    mail = "From x\nMessage-ID: <1@x>\nFrom: =?utf-8?q?Ann_=C3=A9?= <a@x.org>\nSubject: Re: Plan\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nHello  there\n\nFrom y\nMessage-ID: <2@x>\nReferences: <1@x>\nSubject: Re: Plan\nDate: bad\nContent-Type: text/html\n\n<p>Hi</p><b>Bob</b>\n"
    (tmp_path / "m.mbox").write_text(mail)
    rows = files.mbox_folder(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.id, r.body, r.date) for r in rows] == [("1@x", "Hello there", "2024-01-01T10:00:00+00:00"), ("2@x", "Hi Bob", "")]
    assert rows[0].sender == "Ann é <a@x.org>" and rows[0].thread_id.startswith("thread_") and rows[0].thread_id != rows[1].thread_id


def test_mailboxes_are_split_between_mails(spark, tmp_path):
    raw = b"".join(b"From a@b Mon\r\nMessage-ID: <%d@x>\r\nTo: =?utf-8?q?B=C3=B6?= <bo@x.org>, bo2@x.org, =?utf-8?q?B=C3=B6?= <bo@x.org>\r\nCc: \r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9 %d\r\n>From here\r\n\r\n" % (i, i) for i in range(300))
    (tmp_path / "big.mbox").write_bytes(raw + b"From z\nSubject: none\nContent-Type: text/plain; charset=odd\n\nend")
    (tmp_path / "empty.mbox").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.mbox_folder(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.idx) for r in rows[:-1]] == [(f"{i}@x", i) for i in range(300)] and rows[-1].id.endswith("big.mbox#300") and rows[-1].body == "end"
    assert rows[7].body == "café 7 >From here" and [tuple(a) for a in rows[7].to] == [("Bö", "bo@x.org"), ("", "bo2@x.org")] and rows[7].cc == []


def test_content_address_ignores_order(spark):
    df = spark.range(20).withColumn("t", F.col("id") % 3)
    assert files.content_address(df).first() == files.content_address(df.repartition(5).select("t", "id")).first()
    assert files.content_address(df).first() != files.content_address(df.where("id > 0")).first()


def test_write_split(spark, tmp_path):
    df = spark.range(10).withColumn("part", F.when(F.col("id") < 7, "train").otherwise("eval")).withColumn("x", F.lit(None).cast("string"))
    assert files.write_split(df, str(tmp_path / "out")) == {"train": 7, "eval": 3}
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "x", "part"]


def test_trace_source_pages(spark, monkeypatch):
    def page(options, after, size):
        start = int(after) + 1 if after is not None else 0
        return [(f"{i:06d}", "r", "2024", options["project"]) for i in range(start, min(start + size, 2500))]

    monkeypatch.setitem(providers.PROVIDERS, "fake", page)
    reader = providers.TraceReader({"projects": "a,b"}, page)
    parts = reader.partitions()
    assert [p.value for p in parts] == ["a", "b"] and len(list(reader.read(parts[0]))) == 2500
    with pytest.raises(ValueError, match="fake"):
        providers.provider("other")


def test_safe_urls():
    assert providers.safe_url("https://api.example.com/x")
    for bad in ("http://api.example.com", "https://localhost", "https://10.0.0.1", "https://169.254.169.254/x", "https://x.internal", "https://"):
        assert not providers.safe_url(bad)
