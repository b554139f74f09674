import hashlib
import random
import re

from strainshift.llm.decontaminate import contamination, cut_spans, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def naive(text, items):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for s in range(max(len(b) - 13, 0) + 1 if b else 0):
            win = b[s:s + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "Étude", "x1", "aa", "bb", "cc", "longer", "K", "ſ"]
    sent = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, sent(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(25)] + [(7, sent(20)), (None, "null id here"), (99, None), (100, "  ")]
    docs = []
    for i in range(150):
        parts = [sent(rng.randint(0, 40))] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))] + [sent(rng.randint(0, 20))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(900, None), (901, ""), (902, "!!"), (None, items[3][1] or "x"), (903, "zz " * 30000 + (items[0][1] or "")), (903, "other"), (5, docs[5][1])]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, anchor string, n_words int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, win int")
    named = [("null" if i is None else i, t) for i, t in items]
    report = contamination(d, b)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report.collect())
    want = sorted((str(i), *naive(t, named)) for i, t in set(docs))
    assert got == want
    kept = drop_contaminated(d, report)
    assert kept.columns == d.columns
    assert kept.count() == sum(not naive(t, named)[4] for _, t in docs if t is not None) + 1
    for r in cut_spans(d, report).collect():
        texts = [t for i, t in docs if i == r.doc_id]
        if all(naive(t, named)[1] == 0 for t in texts):
            assert r.text in texts
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_cut_spans_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "- keep, These Words; go away!")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "these words")], "item_id bigint, text string")
    assert cut_spans(d, contamination(d, b)).first().text == "- keep, go away!"
