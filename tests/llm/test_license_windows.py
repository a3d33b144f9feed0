import random
import re
import textwrap

from loamwork.llm import licenses


def plain(text, threshold=0.8):
    words = [w for w in re.split(licenses.SEPARATORS, text.lower()) if w]
    labels, best, n = set(), 0.0, 0
    for label, texts in licenses.TEMPLATES.items():
        others = {w for x, ts in licenses.TEMPLATES.items() if x != label for t in ts for w in licenses.tokens(t)}
        for t in texts:
            need, size = set(licenses.tokens(t)), 8
            while size < len([w for w in re.split(licenses.SEPARATORS, t.lower()) if w]):
                size *= 2
            for at in range(0, max(len(words), 1), size):
                own = set(words[at : at + 2 * size]) & need
                if len(own) / len(need) >= threshold - 1e-12 and (len(need) > licenses.SHORT or own - others):
                    labels.add(label)
                    best, n = max(best, len(own) / len(need)), n + 1
    return labels, best, n


def test_wrapped_notices_are_found(spark):
    rng = random.Random(8)
    filler = [f"zz{j}" for j in range(40)]
    cases = [(label, " ".join(rng.choices(filler, k=lead)) + " " + t) for label, texts in licenses.TEMPLATES.items() for t in texts for lead in (0, 5, 17, 61)]
    texts = [textwrap.fill(t, w, initial_indent=" * ", subsequent_indent=" * ") for _, t in cases for w in (20, 72)]
    pool = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 150))) for _ in range(30)] + ["", "under the license it is released"]
    texts += ["released " + "zz " * 400 + "under the " + "zz " * 400 + "license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r for r in licenses.scan(docs, phrases={}).collect()}
    for k, (label, _) in enumerate(cases):
        assert label in got[2 * k].labels.split(",") and label in got[2 * k + 1].labels.split(",")
    for i, t in enumerate(texts):
        labels, best, n = plain(t)
        assert (got[i].labels, got[i].score, got[i].n_blocks) == (",".join(sorted(labels)), best, n), t
    assert got[len(texts) - 1].labels == got[len(texts) - 2].labels == ""


def test_phrases_given_are_found_whatever_their_words(spark):
    rows = [(1, "It was Released into\nthe PUBLIC domain. public-domain domain public"), (2, "publi\u212a domain"), (3, "p\u00c9 \u00c9p"), (4, "p\u00e9 a"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(docs, phrases={"Public Domain": "pd", "domain": "d"}, templates={}).collect()}
    assert got == {1: (5, 5, 9, "d,pd"), 2: (1, 1, 1, "d"), 3: (0, None, None, ""), 4: (0, None, None, ""), 5: (0, None, None, "")}
    got = {r.doc_id: r.n_base for r in licenses.scan(docs, phrases={"p\u00c9": "e", "public domain": "k"}, templates={"x": ["p\u00e9 a"]}).collect()}
    assert got == {1: 2, 2: 0, 3: 1, 4: 0, 5: 0}
