import corpus_pipeline as P
import test_decontamination
import test_line_dedup
import test_minhash_forest
from pyspark.sql import functions as F

from textloom.llm import sentencepiece_sampling as S
from textloom.llm.pieces import Pieces, read_vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    rows = lambda d: {r.doc_id: r for r in d.collect()}

    one = stages["toxicity"](spark, docs, SF).cache()
    assert one.columns == COLUMNS and 0.5 * docs.count() < one.count() <= docs.count()
    before = rows(one)

    two = stages["line_dedup"](spark, one, SF).cache()
    after = rows(two)
    assert two.columns == COLUMNS and after.keys() == before.keys()
    for (i, text), gone in test_line_dedup.plain([(i, r.text) for i, r in before.items()]).items():
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert after[i].text == kept and (not gone or after[i].n_chars == len(kept))

    three = stages["near_dedup"](spark, two, SF).cache()
    want = {i for i, (_, c) in test_minhash_forest.plain([(i, r.text) for i, r in after.items()]).items() if i == c}
    assert three.columns == COLUMNS and rows(three).keys() == want

    four = stages["decontamination"](spark, three, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = test_decontamination.plain([(i, r.text) for i, r in rows(three).items()], items)
    assert four.columns == COLUMNS and rows(four).keys() == {i for i, x in found.items() if not x[3]}

    five = stages["sentencepiece"](spark, four, SF)
    pieces, texts = Pieces(read_vocabulary()), rows(four)
    assert five.columns == ["doc_id", "ids", "n_pieces", "lossless"]
    last = rows(five)
    assert last.keys() == texts.keys() and all(S.decode(pieces, r.ids) == texts[i].text for i, r in last.items() if r.ids is not None)
    assert rows(P.run(spark, SF)) == last


def test_odd_rows_and_clashing_names(spark, odd, nothing, clashing, tmp_path):
    spark.createDataFrame([(5, 1, 0), (6, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the same row twice, with some more words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, clashing, nothing):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            kept = out.count()
            assert kept <= docs.count()
            if "dkey" in docs.columns:
                assert out.where((F.col("dkey") == "own dkey") & (F.col("rejected") == "own rejected") & (F.col("_row") == "own _row")).count() == kept
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_near_dedup_links_from_four_fifths_on(spark):
    """85 of 103 shingles in common (0.825), and 69 of 119 (0.58)."""
    w = [f"w{i}" for i in range(200)]
    one, near, far = (" ".join(w[a : a + 98]) for a in (0, 9, 25))
    docs = spark.createDataFrame([(1, one), (2, near), (3, " ".join(f"x{i}" for i in range(90)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, docs, SF).collect()) == [1, 3]
    apart = spark.createDataFrame([(1, one), (2, far)], "doc_id long, text string")
    assert dict(P.STAGES)["near_dedup"](spark, apart, SF).count() == 2
