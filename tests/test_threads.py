import random

from loamwork.operators import threads as op

SCHEMA = "thread string, pos bigint, id string, parent string, date string, subject string, body string, sender struct<name:string,email:string>, to array<struct<name:string,email:string>>, cc array<struct<name:string,email:string>>"


def plain_compacted(paths, order, shared, context):
    """Each path against every kept one, newest first."""
    out = []
    for _, path in sorted(zip(order, paths), reverse=True):
        best = 0
        for kept in out:
            n = 0
            while n < min(len(kept), len(path)) and kept[n] == path[n]:
                n += 1
            best = max(best, n)
        out.append(path[max(0, best - context) :] if best > shared else path)
    return out


def test_compaction_matches_pairwise_comparison():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 25)
        up = [None] + [rng.randint(max(0, k - 3), k - 1) for k in range(1, n)]
        leaves = [k for k in range(n) if k not in up]
        paths = [op._upwards(k, up) for k in leaves]
        shared, context = rng.randint(0, 5), rng.randint(0, 3)
        assert op._compacted(paths, leaves, shared, context) == plain_compacted(paths, leaves, shared, context)


def test_paths_of_odd_threads():
    key = lambda d: (1, d)
    rows = [(0, "a", "", key("1")), (1, "b", "a", key("2")), (2, "c", "b", key("4")), (3, "d", "b", key("3")), (4, "x", "y", key("1")), (5, "y", "x", key("9")), (6, "", "nowhere", key("5")), (7, "a", "b", key("0")), (8, "self", "self", key("1"))]
    got = op.thread_paths(rows, compact=False)
    assert got == [("leaf_path", 0, [0, 1, 2]), ("leaf_path", 0, [0, 1, 3]), ("leaf_path", 0, [0, 1, 7]), ("leaf_path", 1, [6]), ("orphan_component", 2, [8]), ("cycle_component", 3, [4, 5])]
    got = op.thread_paths(rows, shared=1, context=1)
    assert [p for *_, p in got][:3] == [[0, 1, 2], [1, 3], [1, 7]]
    assert op.thread_paths([]) == []


def test_a_long_thread_is_one_path():
    rows = [(k, str(k), str(k - 1), (1, f"{k:06d}")) for k in range(20_000)]
    assert op.thread_paths(rows) == [("leaf_path", 0, list(range(20_000)))]


def plain_windows(blocks, most_mails, most_chars, overlap):
    """All windows from every start, then those that a reader who goes on by the overlap needs."""
    out, start = [], 0
    while start < len(blocks):
        size, end = 0, start
        for k in range(start, min(len(blocks), start + most_mails)):
            n = blocks[k][1] if k == start and blocks[k][0] > most_chars else blocks[k][0]
            if k > start and size + n + 2 > most_chars:
                break
            size, end = size + n + 2, k
        if out and end <= out[-1][1]:
            start = out[-1][1] + 1
            continue
        out.append((start, end))
        if end == len(blocks) - 1:
            break
        start += max(1, end - start + 1 - overlap)
    return out


def test_windows_match_a_plain_walk(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(60):
        blocks = [(n := rng.choice([5, 20, 40, 90, 300]), min(n, 110)) for _ in range(rng.randint(1, 14))]
        rows += [(f"t{t}", 0, k + 1, a, b) for k, (a, b) in enumerate(blocks)]
        want[f"t{t}"] = [(a + 1, b + 1) for a, b in plain_windows(blocks, 4, 100, 2)]
    df = spark.createDataFrame(rows, "thread string, path int, place int, length int, short int").repartition(3)
    got = {}
    for r in op.windows(df, 4, 100, 2).orderBy("thread", "window").collect():
        got.setdefault(r.thread, []).append((r["first"], r["last"]))
    assert got == want


def test_chunk_rows(spark):
    ann, bob = ("Ann", "ann@x.org"), ("", "bob.k@x.org")
    rows = [
        ("t", 0, "a", None, "2024-01-02T10:00:00", "Hello", " one \n", ann, [bob, ann], None),
        ("t", 1, "b", "a", "2024-01-03", None, "w" * 100, bob, [ann], [("Cy", ""), ("Di", ""), ("Ed", "")]),
        ("u", 0, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two, odd = op.thread_chunks(df, most_mails=10, most_chars=80, overlap=0).orderBy("thread", "idx").collect()
    assert one.content == "Subject: Hello\nDate: 2024-01-02 to 2024-01-02\nParticipants: Ann, bob k x org\n\n[msg #1 | 2024-01-02 | Ann <ann@x.org> -> bob.k@x.org; Ann <ann@x.org>]\none"
    assert (one.chunk_id, one.parent_chunk_id, one.child_chunk_ids, one.thread_message_count) == ("t-0-1", "", ["t-0-2"], 2)
    assert two.content.endswith("cc: Cy; Di; Ed]\n" + "w" * 80 + " [truncated]") and "Participants: bob k x org, Ann, Cy (+2 more)" in two.content
    assert (two.idx, two.parent_chunk_id, two.child_chunk_ids, two.participants) == (1, "t-0-1", [], ["bob k x org", "ann", "cy", "di", "ed"])
    assert odd.content == "Subject: unknown\nDate: unknown\nParticipants: unknown\n\n[msg #1 | unknown date | unknown -> ]\n"
    assert op.thread_chunks(df.limit(0)).count() == 0
