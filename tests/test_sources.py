"""Readers and writers: block and raw rating files, file selection, text round trips."""

import pytest
from pyspark.sql import functions as F

from basketmine.sinks import text as sinks
from basketmine.sources import blocks
from basketmine.sources import text as readers
from conftest import f1_text

F1_ROWS = {(1, 101), (1, 102), (1, 103), (1, 104), (2, 101), (2, 102), (2, 103),
           (3, 101), (3, 102), (3, 105), (7, 106), (10, 101), (10, 102), (10, 104)}


def pairs(df):
    return {(r["item_id"], r["user_id"]) for r in df.select("item_id", "user_id").collect()}


@pytest.mark.parametrize("final_newline", [True, False])
def test_block_and_raw_readers_agree(spark, write_text, final_newline):
    norm = write_text({"a.txt": f1_text(normalised=True, final_newline=final_newline)})
    raw = write_text({"a.txt": f1_text(normalised=False, final_newline=final_newline)})
    assert pairs(blocks.read_rating_blocks(spark, norm)) == F1_ROWS
    assert pairs(blocks.read_raw_ratings(spark, raw)) == F1_ROWS
    # the raw reader also reads normalised files
    assert pairs(blocks.read_raw_ratings(spark, norm)) == F1_ROWS


def test_block_reader_splits_records_with_several_movies(spark, write_text):
    # A raw file read as blocks is one record; headers inside it start blocks.
    path = write_text({"a.txt": f1_text(normalised=False)})
    assert pairs(blocks.read_rating_blocks(spark, path)) == F1_ROWS


def test_raw_reader_across_tiny_splits(spark, write_text):
    raw = write_text({"a.txt": f1_text(), "b.txt": "20:\n201,1,2005-02-01\n21:\n22:\n202,2,2005-02-02"})
    expected = F1_ROWS | {(20, 201), (22, 202)}
    for size in ("7", "16"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert pairs(blocks.read_raw_ratings(spark, raw)) == expected
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rating_fields_are_parsed(spark, write_text):
    raw = write_text({"a.txt": "5:\n 11 ,4,2005-03-04\n"})
    row = blocks.read_raw_ratings(spark, raw).collect()[0]
    assert (row["item_id"], row["user_id"], row["rating"], str(row["rated_on"])) == \
        (5, 11, 4, "2005-03-04")


def test_malformed_rows_are_skipped(spark, write_text):
    text = ("1:\n101,3,2005-01-01\nx102,4,2005-01-02\n\n"
            "a2:\n101,3,2005-01-01\n\n"
            "3:\n\n"
            " 4 :\n 104 ,2,2005-01-04\n")
    got = pairs(blocks.read_rating_blocks(spark, write_text({"a.txt": text})))
    assert got == {(1, 101), (4, 104)}


def test_fail_mode_raises(spark, write_text):
    path = write_text({"a.txt": "1:\nx102,4,2005-01-02\n"})
    with pytest.raises(Exception):
        blocks.read_rating_blocks(spark, path, mode="fail").collect()


def test_ragged_lines_are_kept(spark, write_text):
    text = "1:\n101\n102,4\n103,4,2005-01-03\n104,4,2005-01-04,extra\n105,4,\n"
    want = {(1, 101, None), (1, 102, 4), (1, 103, 4), (1, 104, 4), (1, 105, 4)}
    for reader in (blocks.read_rating_blocks, blocks.read_raw_ratings):
        for mode in ("skip", "fail"):
            rows = reader(spark, write_text({"a.txt": text}), mode).collect()
            assert {(r["item_id"], r["user_id"], r["rating"]) for r in rows} == want


def test_crlf_files_read_like_lf_files(spark, write_text):
    for normalised in (True, False):
        path = write_text({"a.txt": f1_text(normalised=normalised).replace("\n", "\r\n")})
        for reader in (blocks.read_rating_blocks, blocks.read_raw_ratings):
            assert pairs(reader(spark, path, "fail")) == F1_ROWS


def test_file_without_a_header_raises(spark, write_text):
    path = write_text({"a.txt": "1:\n101,3,2005-01-01\n", "b.txt": "101,3,2005-01-01\n"})
    with pytest.raises(Exception, match="no header line"):
        blocks.read_raw_ratings(spark, path).collect()
    # an empty file is no fault
    assert pairs(blocks.read_raw_ratings(spark, write_text({"a.txt": "1:\n7\n", "b.txt": "\n"}))) == {(1, 7)}


def test_lines_without_a_header_of_their_own(spark, write_text):
    early = write_text({"a.txt": "99,1\n1:\n101,3\n"})
    assert pairs(blocks.read_raw_ratings(spark, early)) == {(1, 101)}
    loose = write_text({"a.txt": "1:\n101,3\n\n102,3\n\n2:\n103,1\n"})
    assert pairs(blocks.read_rating_blocks(spark, loose)) == {(1, 101), (2, 103)}
    for path, reader in ((early, blocks.read_raw_ratings), (loose, blocks.read_rating_blocks)):
        with pytest.raises(Exception, match="bad item id"):
            reader(spark, path, "fail").collect()


def test_raw_reader_fails_on_a_bad_header(spark, write_text):
    path = write_text({"a.txt": "1:\n101,3\nx2:\n102,3\n"})
    assert pairs(blocks.read_raw_ratings(spark, path)) == {(1, 101)}
    with pytest.raises(Exception, match="bad item id"):
        blocks.read_raw_ratings(spark, path, "fail").collect()


def test_rows_survive_a_change_of_the_split_size(spark, write_text):
    text = "".join(f"{i}:\n" + "".join(f"{1000 * i + j},3,2005-01-01\n" for j in range(20)) for i in range(1, 119))
    path = write_text({"a.txt": text})
    for before, after in (("4096", "9000"), ("300", "100000"), ("100000", "70")):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            rows = blocks.read_raw_ratings(spark, path)
            spark.conf.set("spark.sql.files.maxPartitionBytes", after)
            assert pairs(rows) == {(i, 1000 * i + j) for i in range(1, 119) for j in range(20)}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_items_keep_their_blanks_and_separators_are_refused(spark, tmp_path):
    sets = spark.createDataFrame([(1, [" pad "], 1, 0.5)], "k int, items array<string>, freq long, support double")
    sinks.write_itemsets_text(sets, str(tmp_path / "pad"))
    assert readers.read_itemsets_text(spark, str(tmp_path / "pad")).first()["items"] == [" pad "]
    with pytest.raises(Exception, match="separator"):
        sinks.write_itemsets_text(sets.withColumn("items", F.array(F.lit("a,b"))), str(tmp_path / "bad"))


def test_same_movie_in_two_files_and_duplicates(spark, write_text):
    path = write_text({"combined_data_1.txt": "1:\n101,3,2005-01-01\n101,3,2005-01-01\n",
                       "combined_data_2.txt": "1:\n102,3,2005-01-01\n"})
    rows = blocks.read_raw_ratings(spark, path)
    assert rows.count() == 3 and pairs(rows) == {(1, 101), (1, 102)}


def test_file_selection_has_no_end_anchor(spark, write_text):
    path = write_text({"combined_data_1.txt": "1:\n101,3,2005-01-01\n",
                       "combined_data_2.txt.bak": "2:\n102,3,2005-01-01\n",
                       "combined_data_x.txt": "3:\n103,3,2005-01-01\n",
                       "notes.txt": "4:\n104,3,2005-01-01\n"})
    names = {r["file_name"] for r in blocks.select_rating_files(spark, path).collect()}
    assert names == {"combined_data_1.txt", "combined_data_2.txt.bak"}
    got = blocks.read_raw_ratings(spark, path, name_regex=blocks.RATING_FILE_REGEX,
                                  path_glob=blocks.RATING_FILE_GLOB)
    assert pairs(got) == {(1, 101), (2, 102)}


@pytest.mark.parametrize("raw", [False, True])
def test_block_writer_round_trip_splits_hot_items(spark, f1_ratings, tmp_path, raw):
    out = str(tmp_path / ("raw" if raw else "norm"))
    sinks.write_rating_blocks(f1_ratings, out, raw=raw, max_block_rows=2)
    reader = blocks.read_raw_ratings if raw else blocks.read_rating_blocks
    back = reader(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f1_ratings.collect()))
    n_blocks = spark.read.option("lineSep", "\n\n").text(out).count() if not raw else None
    if n_blocks is not None:
        assert n_blocks > 5          # items with more than 2 ratings were split


def test_block_writer_writes_one_block_per_item(spark, f1_ratings, tmp_path):
    sinks.write_rating_blocks(f1_ratings, str(tmp_path / "whole"))
    headers = [r["value"].split(":")[0] for r in
               spark.read.option("lineSep", "\n\n").text(str(tmp_path / "whole")).collect()]
    assert sorted(headers) == ["1", "10", "2", "3", "7"]


def test_an_item_of_ten_million_rows(spark, tmp_path):
    """No item is one value: its lines are rows, spread over the files, each under a header."""
    out = str(tmp_path / "hot")
    ratings = spark.range(10_000_000).selectExpr("7L as item_id", "id as user_id", "cast(id % 5 as int) as rating",
                                                 "cast(null as date) as rated_on")
    sinks.write_rating_blocks(ratings, out, raw=True)
    lines = spark.read.text(out).select("value", F.col("_metadata.file_name").alias("f"))
    per = lines.groupBy("f").agg(F.count_if(F.col("value") == "7:").alias("heads"), F.count(F.lit(1)).alias("n"),
                                 F.max(F.length("value")).alias("longest")).collect()
    assert len(per) > 4 and all(r["heads"] >= 1 and r["longest"] < 20 for r in per)
    assert sum(r["n"] - r["heads"] for r in per) == 10_000_000
    assert max(r["n"] for r in per) < 5_000_000


def test_outputs_are_evaluated_once(spark, f1_ratings, tmp_path):
    """The text forms and the candidate count come from the written tables."""
    from basketmine import mine
    from basketmine.operators.recommend import recommend
    from basketmine.plans.run import all_candidates
    res = mine(f1_ratings.select("user_id", F.col("item_id").cast("string").alias("item_id")), 0.3, max_user=200)
    out = str(tmp_path / "out")
    sinks.write_outputs(res, out, candidates=all_candidates(res), recommendations=recommend(res))
    back = sinks.read_outputs(spark, out)
    for name, want in (("itemsets", res.itemsets()), ("baskets", res.baskets()), ("rules", res.rules()),
                       ("stats", res.stats()), ("candidates", all_candidates(res)), ("recommendations", recommend(res))):
        cols = sorted(want.columns)
        assert sorted(map(str, back[name].select(cols).collect())) == sorted(map(str, want.select(cols).collect())), name
    rules = readers.read_rules_text(spark, f"{out}/text/rules")
    assert rules.count() == back["rules"].count() > 0


def test_text_round_trips(spark, f1_ratings, tmp_path):
    from basketmine import mine
    from basketmine.operators.candidates import generate_candidates
    res = mine(f1_ratings.select("user_id", F.col("item_id").cast("string").alias("item_id")),
               0.3, max_user=200)
    sinks.write_itemsets_text(res.itemsets(), str(tmp_path / "sets"))
    back = readers.read_itemsets_text(spark, str(tmp_path / "sets"))
    want = {(tuple(r["items"]), r["support"]) for r in res.itemsets().collect()}
    assert {(tuple(r["items"]), r["support"]) for r in back.collect()} == want
    sinks.write_baskets_text(res.baskets(), str(tmp_path / "baskets"))
    got = {(r["user_id"], tuple(r["items"]))
           for r in readers.read_baskets_text(spark, str(tmp_path / "baskets")).collect()}
    assert got == {(r["user_id"], tuple(r["items"])) for r in res.baskets().collect()}
    cands = generate_candidates(res.level(2).table, 3)
    sinks.write_candidates_text(cands, str(tmp_path / "cands"))
    lines = spark.read.text(str(tmp_path / "cands")).collect()
    # ids are ordered as strings in the candidate file: "10" before "2"
    assert "1,10,2" in {r["value"] for r in lines}
    sinks.write_rules_text(res.rules(), str(tmp_path / "rules"))
    texts = {r["value"] for r in spark.read.text(str(tmp_path / "rules")).collect()}
    assert "[1, 10] -> 2\t0.6666666666666666" in texts


def test_malformed_text_records_are_dropped(spark, write_text):
    path = write_text({"a": "1,2\t0.5\nonlyone\n1\t2\t3\n\n3\t0.25\n"})
    got = {(tuple(r["items"]), r["support"]) for r in readers.read_itemsets_text(spark, path).collect()}
    assert got == {(("1", "2"), 0.5), (("3",), 0.25)}


def test_owners_are_found_across_pieces_and_tasks(spark, write_text, monkeypatch):
    """A file is cut into pieces of few lines, so that no task sorts a whole split."""
    monkeypatch.setattr(blocks, "PIECE_ROWS", 3)
    monkeypatch.setattr(blocks, "TASK_ROWS", 4)
    wanted, files = set(), {}
    for f in (1, 2):
        lines = []
        for item in range(f * 100, f * 100 + 5):
            users = range(1, 1 + item % 100 * 4)
            lines += [f"{item}:", *[f"{u},3,2005-01-01" for u in users]]
            wanted |= {(item, u) for u in users}
        files[f"combined_data_{f}.txt"] = "\n".join(lines) + "\n"
    for read in (blocks.read_raw_ratings, blocks.read_rating_blocks):
        got = read(spark, write_text(files))
        rows = [(r["item_id"], r["user_id"]) for r in got.collect()]
        assert len(rows) == len(wanted) and set(rows) == wanted
        assert got.rdd.getNumPartitions() == 23         # of 90 lines
    # An empty line ends a block of the normalised form, also in an earlier piece.
    text = "1:\n" + "\n".join(f"{u},3," for u in range(1, 6)) + "\n\n" + "\n".join(f"{u},3," for u in range(6, 20))
    got = blocks.read_rating_blocks(spark, write_text({"combined_data_1.txt": text}))
    assert sorted(r["user_id"] for r in got.collect()) == [1, 2, 3, 4, 5]
