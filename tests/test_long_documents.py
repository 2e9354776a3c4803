"""Searches and entities over documents that are longer than one chunk."""

from vidimus.plans import adapters as A
from vidimus.plans import queries as Q
from vidimus.sources.files import BUDGET


def tables(spark, folder):
    tail = "zebra quartz lantern opens the violet harbour"
    filler = "\n\n".join(" ".join(f"w{k}x{n}" for n in range(100)) for k in range(40))
    docs = [(1, f"{filler}\n\n{tail} where Grace Hopper and Alan Turing met", "en", "src1", 0), (2, f"zebra quartz lantern and nothing else {filler}", "en", "src1", 0), (3, None, "en", "src2", 0), (4, " \n ", "en", "src2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, tail), (8, "words that no text holds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_pieces_hold_whole_texts(spark, tmp_path):
    folder, docs = tables(spark, tmp_path)
    got = {}
    for r in A.document_pieces(spark, folder).orderBy("id").collect():
        assert len(r.text) <= BUDGET and r.id.startswith(f"{r.item_id}:document:")
        got.setdefault(r.item_id, []).extend(r.text.split())
    assert got == {f"doc-{i}": t.split() for i, t, *_ in docs if t and t.strip()}


def test_tails_are_searched(spark, tmp_path):
    folder, _ = tables(spark, tmp_path)
    hits = Q.lexical_search_hits(spark, folder).collect()
    assert {(r.query_id, r.item_id) for r in hits} == {(7, "doc-1")} and hits[0].unit_id != "doc-1:unit:000000"
    answers = {r.query_id: r for r in Q.extractive_answers(spark, folder).collect()}
    assert answers[7].citations == [hits[0].unit_id] and answers[8].citations == []
    assert Q.hit_facets(spark, folder).count() > 0
    assert {"grace-hopper", "alan-turing"} <= {r.entity for r in Q.entity_summary(spark, folder).collect()}
