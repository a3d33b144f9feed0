import random
import re

from loamwork.llm import licenses


def plain(text, threshold=0.8):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    split = lambda s: [w for w in re.split(licenses.SEPARATORS, s) if w]
    words, base, labels, best, n = split(low), [], set(), 0.0, 0
    for p, label in licenses.PHRASES.items():
        p = p.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    for line in low.split("\n"):
        own = set(split(line))
        for label, texts in licenses.TEMPLATES.items():
            for t in texts:
                need = set(licenses.tokens(t))
                share = len(own & need) / len(need)
                if share >= threshold - 1e-12:
                    labels.add(label)
                    best, n = max(best, share), n + 1
    at = [i for i, _ in base]
    mine = {x for _, x in base}
    join = lambda x: ",".join(sorted(x))
    return len(words), len(base), min(at, default=None), max(at, default=None), join(mine), join(mine | labels), 1.0 if base else best, n


def test_scan_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [w for texts in licenses.TEMPLATES.values() for t in texts for w in t.split()] + ["éa", "zz", "mit license", "MIT\nLicense", "General-Public license"]
    texts = [None, "", "...", "mit", "the MIT license. x APACHE (License) mit License"]
    for label, notices in licenses.TEMPLATES.items():
        for t in notices:
            texts += [t, f"éx {label}\n# {t.upper()} #\nmore", t.replace(" ", "\n"), " ".join(t.split()[: -len(t.split()) // 4])]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(40)] + ["the license " * 30_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string").repartition(3)
    for r in licenses.scan(docs, windows=False).collect():
        assert tuple(r)[1:] == plain(texts[r.doc_id]), texts[r.doc_id][:200]


def test_empty_table_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "mit license"), (1, "Licensed under CC BY-NC 4.0."), (1, "x")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.labels, r.score) for r in licenses.scan(docs).collect())
    assert got == [(-1, "mit", 1.0), (1, "", 0.0), (1, "cc-by-nc", 1.0)]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates={}).count() == 3
