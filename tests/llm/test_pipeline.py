import public_tokenizers
from test_decontaminate import naive as naive_hits
from test_secrets import naive as naive_spans
from test_set_join import naive as naive_components

import corpus_pipeline
from strainshift.llm.piece_sampling import Vocabulary, decode_ids
from strainshift.llm.q_quality import op8_factor_machine
from strainshift.llm.secrets_scan import redact


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    good = {r.doc_id for r in op8_factor_machine(spark, sf).collect() if r.predicted}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in good]
    first = {d for d, _, c in naive_components(docs) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: redact(t or "", naive_spans(t or "")) for d, t in docs if d in first and not naive_hits(t, items)[4]}
    assert 0 < len(want) < len(docs)
    rows = corpus_pipeline.run(spark, sf).collect()
    vocabulary = Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert {(r.doc_id, r["sample"]) for r in rows} >= {(d, 1) for d in want}
    assert {r.doc_id for r in rows} == set(want) and len({(r.doc_id, r["sample"]) for r in rows}) == len(rows)
    for r in rows:
        assert r.exact and decode_ids(r.ids, vocabulary) == want[r.doc_id]


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 5), (2, text.upper(), None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None), (None, "only one", None, None, 8),
            (3, None, None, None, None), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, "x" * 50000 + " token=abcdef123", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    kept = corpus_pipeline.near_copies(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept) == [("1", "word0"), ("3", ""), ("4", ""), ("5", "xxxxx"), ("None", ""), ("None", "only ")]
    assert corpus_pipeline.decontaminate(spark, docs, sf).count() == len(rows)
    clean = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, sf).collect() if r.doc_id == 5}[5]
    assert clean.text.endswith(" [SECRET]") and clean.n_chars == len(clean.text)
    assert corpus_pipeline.pieces(spark, docs.limit(0), sf).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"term{i}" for i in range(60))
    rows = [(5, text + " end", "en", "s", 1), (3, text, "en", "s", 1), (5, other, "en", "s", 2), (5, other, "de", "s", 2), (7, other, "en", "s", 2),
            (None, other, "en", "s", 2), (9, None, "en", "s", 0), (9, "", "en", "s", 0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
        kept = {tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
        assert kept == {(3, text, "en", "s", 1), (5, other, "de", "s", 2), (9, None, "en", "s", 0), (9, "", "en", "s", 0)}
