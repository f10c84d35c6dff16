"""The pipeline: every stage works on what the one before kept, and its decisions take effect."""

import corpus_pipeline
from auditframe.llm.common import stored, table
from tests.llm.test_decontaminate import words
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_near_dup import brute as plain_groups
from tests.llm.test_packing import check


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, sf_dir), "test")
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = {n: [(r.doc_id, r.text) for r in pair[0].collect()] for n, pair in kept.items()}
    after = {n: pair[1] for n, pair in kept.items()}

    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    left = {r.doc_id for r in after["quality_classifier"].collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in left for d in clean) > 0.95 * len(clean)

    got = sorted(((r.doc_id, r.text or "") for r in after["line_dedup"].collect()), key=str)
    assert got == sorted(((i, t) for i, _, _, t in plain_lines(texts["line_dedup"])), key=str)

    left = {r.doc_id for r in after["near_dedup"].collect()}
    assert left == {d for d, n, c in plain_groups(texts["near_dedup"], 2) if d == c or not n}

    items = [" ".join(words(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    holds = {d for d, t in texts["decontamination"] if any(f" {i} " in f" {' '.join(words(t))} " for i in items)}
    left = {r.doc_id for r in after["decontamination"].collect()}
    assert not holds & left and len(left) >= 0.97 * (len(texts["decontamination"]) - len(holds))

    check(after["best_fit_packing"].collect(), texts["best_fit_packing"])


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_odd_documents_pass_every_stage(spark, sf_dir):
    """Nulls, empty and very long texts, ties and repeated rows go through all stages, and so does an empty table."""
    shared = "a passage that many of these documents have in common with each other and with nobody else"
    odd = [(i, None, None, None, None) for i in (1, 1, None)] + [(2, "", "en", "web", 0), (3, " \n\t\n", "en", None, 4)]
    odd += [(4, "word " * 60_000, None, "web", 300_000), (5, "x" * 200_000, "de", "web", None)]
    odd += [(10 + i, f"{shared}\nline number {i} of its own, which is long enough to be told apart\n{shared}", "en", "web", 200) for i in range(6)]
    odd += [(20, "one text that is there again and again, word for word and to the very last letter", "en", "web", 80)] * 4
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            before = left
            left = stored(stage(spark, before, sf_dir), "test")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert left.columns == docs.columns and left.count() <= before.count()
        out = left.collect()
    assert out == []
