import corpus_pipeline as cp
from basketmine.llm import chosen_path, mixing, ordinal, pieces, pii
from basketmine.llm.queries import KEEP_TAIL, quality_model
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n_chars long, node string, size int, _note string"


def test_stages_and_contract():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mixture", "tokens"]
    assert cp.ORACLE_SQL is None


def test_every_stage_on_awkward_rows(spark):
    prose = "the tion and ing of ther ened onor inst reha " * 8
    rows = [(1, prose + "first", "en", "a"), (2, prose + "first", "en", "b"), (3, None, "en", "a"), (4, "", None, None),
            (None, prose + "mail a.bc@d.example.com", "en", "a"), (6, "x " * 20_000, "en", "a"),
            (1, prose + "first", "en", "a"), (7, prose.upper(), None, "ä")]
    docs = spark.createDataFrame([r + (0, "clash", 1, "n") for r in rows], COLS)
    for name, stage in cp.STAGES:
        for frame in (docs, docs.filter("doc_id = 999")):
            out = stage(spark, frame, D)
            if name != "tokens":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            n = len(out.collect())
            assert n == 0 if frame is not docs else n > 0
    left = cp.near_duplicates(spark, docs, D).collect()
    assert sorted((str(r.doc_id) for r in left)) == ["1", "3", "4", "6", "7", "None"]
    assert "a.bc@d.example.com" not in "".join(r.text or "" for r in cp.pseudonyms(spark, docs, D).collect())
    assert all(r.n_chars == len(r.text or "") for r in cp.pseudonyms(spark, docs, D).collect())


def test_run_equals_its_operators_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality_model(spark, docs, D)
    tail = {r.doc_id: r.t for r in docs.select("doc_id", ordinal.grade_column(F.col("text"), model)["tail"].alias("t")).collect()}
    kept = docs.filter(F.col("doc_id").isin([i for i, t in tail.items() if t >= KEEP_TAIL]))
    first = [r.doc_id for r in chosen_path.join(kept).filter("first").collect()]
    secret, codec = pii.Pseudonyms(), pieces.Codec(pieces.Vocabulary.load(pieces.MODEL_FILE))
    rows = [(r.doc_id, secret.rewrite(r.text)[0], r.source) for r in kept.collect() if r.doc_id in set(first)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "text"))
    want = sorted((r.doc_id, tuple(codec.encode(r.text))) for r in mixed.collect() for _ in range(r.copies))
    got = cp.run(spark, D).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.round_trip for r in got)
