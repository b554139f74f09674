import itertools
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check  # noqa: E402
from strainshift.llm.catalog import ORACLES, QUERIES  # noqa: E402
from strainshift.llm.rule_ledger import MEASURES, POLICIES, RULES, ablation, failed_rules, fails, ledger, mask, policy_counts  # noqa: E402

TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z\r\n", "one two one two one two",
         "é ü\x0bß\x0c😀 # $ |", "LOUD " * 60, "12 34 " * 40, "word " * 20000, "\n" * 50 + "same\n" * 60, " lead and trail \n"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=sum(c in "#*$%&|<>" for c in text),
                n_capitals=len(re.findall("[A-Z]", text)), n_digits=len(re.findall("[0-9]", text)), n_lines=len(lines),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered))


@pytest.fixture(scope="module")
def rows(spark):
    texts = TEXTS + [" ".join(p) for p in itertools.product("ab", repeat=7)]
    data = [(i if i % 7 else None, t, "clash", i % 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_words string, source int")
    return texts, docs, ledger(docs, keep=("source",)).cache()


def test_measurements_equal_plain_counts(rows):
    texts, docs, led = rows
    want = sorted(tuple(plain(t)[m] for m in MEASURES) for t in texts)
    assert sorted(tuple(r[m] for m in MEASURES) for r in led.collect()) == want
    assert [c for c in led.columns if c not in MEASURES] == ["doc_id", "source", "fail_bits"]
    assert ledger(docs.limit(0)).count() == 0


def test_bits_follow_the_rules(rows):
    for r in rows[2].select("*", failed_rules(rows[2].fail_bits).alias("names"), fails("base-1").alias("base")).collect():
        m = {k: r[k] for k in MEASURES}
        want = [n for n, rule in RULES.items() if eval(rule, {}, m)]  # the rules are plain comparisons
        assert r.names == want and r.fail_bits == mask(tuple(want))
        assert r.base == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_ablation_equals_removing_each_rule(rows):
    led = rows[2]
    for policy, by in itertools.product(POLICIES, ((), ("source",))):
        data = led.collect()
        got = {(tuple(r[b] for b in by), r.rule): r for r in ablation(led, policy, by).collect()}
        groups = {tuple(r[b] for b in by) for r in data}
        assert set(got) == {(g, n) for g in groups for n in POLICIES[policy]}
        for (group, rule), r in got.items():
            mine = [x.fail_bits for x in data if tuple(x[b] for b in by) == group]
            rest = mask(tuple(n for n in POLICIES[policy] if n != rule))
            assert r.n_docs == len(mine) and r.n_kept == sum(b & mask(policy) == 0 for b in mine)
            assert r.n_kept_without == sum(b & rest == 0 for b in mine) and r.n_alone == r.n_kept_without - r.n_kept
            assert r.n_failed == sum(b & mask((rule,)) != 0 for b in mine)
    assert ablation(led.limit(0), "base-1").count() == 0


def test_policies_from_one_pass(rows):
    bits = [r.fail_bits for r in rows[2].collect()]
    got = {r.policy: (r.n_docs, r.n_kept) for r in policy_counts(rows[2]).collect()}
    assert got == {p: (len(bits), sum(b & mask(p) == 0 for b in bits)) for p in POLICIES}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = check.connect(sf)
    df = QUERIES["op11_rule_ledger"](spark, sf)
    cur = con.execute(ORACLES["op11_rule_ledger"])
    names = [d[0] for d in cur.description]
    assert check.table_of(df.columns, [tuple(r) for r in df.collect()]) == check.table_of(names, cur.fetchall())


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in QUERIES["op11_rule_ledger"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [kept[r.doc_id] for r in labels if r.quality == 1]
    assert sum(k for k, base in clean if not base) >= 0.999 * sum(not base for _, base in clean)
    junk = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(not k for k, _ in junk) >= 0.8 * len(junk)
