from pyspark.sql import functions as F

from weakloom import schemas
from weakloom.operators import retrieval
from weakloom.plans import standins as sd
from weakloom.plans.labeling import fit_labels
from weakloom.session import broadcast_if_small, fits
from weakloom.sources import files
from weakloom.streaming.labels import start_labeling


def test_retrieval_csv_round_trip(spark, tmp_path):
    rows = [("1", "A, B", "12", 'Says "yes", **3**', 0.45, "line\nbreak", "3"), ("2", "C", "12", " lead", 0.41, "x", "4")]
    frame = spark.createDataFrame(rows, schemas.RETRIEVAL)
    files.write_csv(frame, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_csv_in_pieces(spark, tmp_path):
    """Without newlines in fields a file is read by many tasks."""
    rows = [(str(i), f"name, {i}", "12", 'a "quoted" text ' * 20, i / 7, "x" * 50, "3") for i in range(2000)]
    files.write_csv(spark.createDataFrame(rows, schemas.RETRIEVAL).coalesce(1), str(tmp_path / "csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        split = files.read_csv(spark, str(tmp_path / "csv"), multi_line=False)
        assert split.rdd.getNumPartitions() > 4 and sorted(map(tuple, split.collect())) == sorted(rows)
        assert files.read_csv(spark, str(tmp_path / "csv")).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_folders_are_bounded(spark, tmp_path):
    frame = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), F.col("id").alias("para_id"),
                                     F.concat(F.lit("a\tb "), F.col("id").cast("string")).alias("text")).repartition(5)
    files.write_texts(frame, str(tmp_path / "out"), folders=4)
    assert len(list((tmp_path / "out").glob("folder=*"))) == 4
    back = files.read_text_folders(spark, str(tmp_path / "out"))
    assert sorted((int(r.doc), r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in frame.collect())
    for folder in (tmp_path / "out").glob("folder=*"):
        lines = [line.split("\t", 1) for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]
        seen = [(int(doc), int(text.split(" ")[1])) for doc, text in lines]
        assert seen == sorted(seen)


def test_texts_are_not_shuffled(spark, sf_dir):
    """Votes and picked keys meet the labels; the texts stay where they are read."""
    from weakloom.plans import queries
    for name in ("row_preview", "noisy_labels"):
        plan = queries.all_queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan =="):]
        below = [line for line in physical.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        assert not any("text#" in line for line in below)
        for line in physical.splitlines():
            assert not ("Exchange" in line and "RoundRobin" in line)


def test_inputs_and_texts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("one\ntwo")
    assert [r.length for r in files.list_inputs(spark, str(tmp_path)).collect()] == [1]
    assert [r.text for r in files.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]


def test_text_sink_keeps_order(spark, tmp_path):
    frame = spark.range(500).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("para_id"), F.col("id").cast("string").alias("text")).repartition(5)
    files.write_texts(frame, str(tmp_path / "out"))
    for doc in (0, 1):
        lines = [line for part in sorted((tmp_path / "out" / f"doc_id={doc}").glob("part-*")) for line in part.read_text().split()]
        assert lines == [str(i) for i in range(doc, 500, 2)]


def test_matrix_and_country_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, [0.1, 0.9], "X"), (2, [1.0, 0.0], "Y")], "id int, proba array<double>, country string")
    files.write_matrix(frame, str(tmp_path / "m"), "id", "proba")
    assert files.read_matrix(spark, str(tmp_path / "m")).count() == 2
    files.write_by_country(frame, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("country = 'X'").count() == 1


def test_letters_and_corrections(spark):
    frame = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id int, class int")
    fixed = retrieval.correct_labels(frame, spark.createDataFrame([(2, 3)], "id int, class int"), "id", "class")
    assert sorted(map(tuple, fixed.collect())) == [(1, 1), (2, 3), (3, 3)]
    letters = frame.select(retrieval.letter_of_class(F.col("class")).alias("l")).collect()
    assert [r.l for r in letters] == ["n", None, "i"]


def test_positional_join_cuts_to_the_shorter(spark):
    a, b = spark.range(5, 15).withColumnRenamed("id", "a"), spark.range(3).select((F.col("id") * 100).alias("b"))
    rows = retrieval.positional_join(a, b, "a", "b").orderBy("position").collect()
    assert [(r.position, r.a, r.b) for r in rows] == [(0, 5, 0), (1, 6, 100), (2, 7, 200)]


def test_broadcast_is_size_checked(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)
    assert broadcast_if_small(spark.range(11), 10)[1] is False


def test_labels_on_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    gold = sd.gold_documents(spark, sf_dir).select("doc_id", F.col("text").alias("sentences"), "class")
    fitted = fit_labels(gold, groups=sd.PHRASES, stem=False)
    assert fitted.summary.count() == 35
    source = gold.select("doc_id", "sentences")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    start_labeling(stream, "sentences", fitted, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination(120)
    batch = fitted.apply(source, "sentences")
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.count() == batch.count()
    columns = ["doc_id", "votes", "predicted"]
    assert streamed.select(*columns).exceptAll(batch.select(*columns)).count() == 0
