"""The pipeline's stages against plain-Python versions, each on its own input."""

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import quality


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in rows[name]} == {i for i in before if verdict[i]}
        elif name == "exact_dedup":
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert {r.doc_id for r in rows[name]} == set(last.values())
        elif name == "simhash_near_dedup":
            roots = brute.linked({i: brute.simhash_fp(r.text) for i, r in before.items()})
            assert {r.doc_id for r in rows[name]} == set(roots.values())
        elif name == "secret_scan":
            assert {r.doc_id for r in rows[name]} == set(before)
            for r in rows[name]:
                had = brute.base_secrets(before[r.doc_id].text)
                assert brute.base_secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text)
                assert sum(had[:3]) > 0 or r.text == before[r.doc_id].text or "[SECRET]" in r.text
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            library.no_truncation()
            library.no_padding()
            ids = {i: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for i, r in before.items()}
            brute.check_pieces([r.asDict() for r in rows[name]], ids)
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, rows["packing"]))


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for k, docs in enumerate((odd, empty)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert docs.columns[0] == "doc_id"
