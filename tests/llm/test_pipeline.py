"""The pipeline's stages take effect, and every operator of the list is registered."""

import os

import pytest
from llm_data import prose

import corpus_pipeline
from civicledger.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]


def write(spark, folder, docs, items, labels=()):
    docs = [(k, t, "en", "s", len(t or "")) for k, t in docs]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", list(labels), "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    clean = [(k, "\n".join(prose(100 * k + j, 40, words=900) for j in range(3))) for k in range(12)]
    words = clean[0][1].replace("\n", " ").split()
    words[60] = "changed"
    near = (100, " ".join(words))  # other lines, nearly the same shingles
    passage = prose(7777, 12)
    docs = clean + [near, (101, clean[1][1]), (102, prose(1, 60) + " " + passage + " " + prose(2, 60)), (103, "too short"), (104, None), (105, "repeat it " * 100),
                    (106, clean[2][1].split("\n")[0] + "\n" + prose(3, 70)), (None, prose(4, 80))]
    folder = write(spark, tmp_path, docs, [(1, passage)])
    now, kept = table(spark, folder, "documents"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, folder), f"test-{name}")
        assert now.columns == columns
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    ids = {k for k, _ in clean}
    assert kept["quality_rules"].keys() == ids | {100, 101, 102, 106, None}
    assert kept["line_dedup"].keys() == ids | {100, 102, 106, None}
    assert kept["line_dedup"][106]["text"] == prose(3, 70) and kept["line_dedup"][106]["n_chars"] == len(prose(3, 70))
    assert kept["ngram_jaccard_join"].keys() == ids | {102, 106, None}
    assert kept["decontamination"].keys() == ids | {106, None}
    assert all(kept["decontamination"][k]["text"] == t for k, t in clean)
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == ids | {106, None}


def test_rows_without_ids_and_with_shared_ones(spark, tmp_path):
    """Each row is decided on its own; the texts tell the rows apart."""
    clean = [prose(8000 + k, 80, words=900) for k in range(4)]
    near = [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(3)]  # one long line each; a change makes another line
    passage = prose(7777, 12)
    leak = lambda k: f"{prose(8100 + k, 60)} {passage} {prose(8200 + k, 60)}"
    docs = [(1, clean[0]), (1, "too short"), (2, clean[1]), (2, leak(1)), (None, clean[2]), (None, "junk"), (None, leak(2)), (5, clean[3])]
    folder, now = write(spark, tmp_path / "a", docs, [(1, passage)]), None
    now = table(spark, folder, "documents")
    now = corpus_pipeline.quality_rules(spark, now, folder)
    assert sorted(r["text"] for r in now.collect()) == sorted([*clean, leak(1), leak(2)])
    now = corpus_pipeline.decontamination(spark, now, folder)
    assert sorted(r["text"] for r in now.collect()) == sorted(clean)
    copies = [(None, near[0]), (9, near[0]), (9, near[1]), (9, near[1] + " more"), (None, near[2]), (None, near[2]), (10, near[0] + " more"), (None, None), (None, "")]
    kept = corpus_pipeline.one_of_each_group(spark, table(spark, write(spark, tmp_path / "b", copies, []), "documents"), folder).collect()
    got = sorted(((r["doc_id"] or 0, (r["text"] or "").removesuffix(" more")) for r in kept))
    assert got == sorted([(9, near[0]), (9, near[1]), (0, near[2]), (0, ""), (0, "")])


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    whole = table(spark, FOLDER, "pages" if name.startswith("op10") else "documents").count()
    assert rows.count() >= (1 if name.startswith("op8") else whole)
