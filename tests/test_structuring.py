import pytest
from plain import document
from pyspark.sql import functions as F

from weakloom.functions import text as tx
from weakloom.operators import scan, structuring as st

HAND_WRITTEN = {
    1: ["a.\nb"],
    2: ["Title.\nkept line."],
    3: ["", "", "Head\nx y.\n\nNext Head\nz\nand more", "Title B\ncontinued.\ntail without end"],
    4: ["open", "still open", "closed at last.\nTitle\nnew", "Title\n.", ""],
    5: ["One.", "Two\nthree.", "Four\n", "Five\nsix.\nseven"],
    6: ["no end anywhere", "nor here"],
    7: ["  spaces \t here .\n" + "X" * 50 + "\n" + "Y" * 51 + ".\nend."],
    8: ["a (b] c. [d\ne) f. It's Done, \"now\".\nx."],
}


def pages_frame(spark, docs):
    return spark.createDataFrame(
        [(d, p, t) for d, pages in docs.items() for p, t in enumerate(pages)],
        "doc_id long, page int, text string").repartition(7)


@pytest.fixture(scope="module")
def conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    docs = {}
    for r in rows:
        docs.setdefault(r.conv_id + 1000, []).append(r.text)
    return {**HAND_WRITTEN, **docs}


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_page_operators_match_plain_python(spark, conversations, chunk):
    frame = pages_frame(spark, conversations)
    want = {d: document(p) for d, p in conversations.items()}
    lines = {(r.doc_id, r.line_no): (r.page, r.line) for r in st.numbered_lines(frame, chunk=chunk).collect()}
    assert lines == {(d, i): l for d, w in want.items() for i, l in enumerate(w["lines"])}
    kept = {(r.doc_id, r.line_no): (r.page, r.line) for r in st.lines_without_titles(frame, chunk=chunk).collect()}
    assert kept == {(d, i): l for d, w in want.items() for i, l in enumerate(w["kept"])}
    counts = {r.doc_id: r.n_titles for r in st.title_counts(frame, chunk=chunk).collect()}
    assert counts == {d: w["n_titles"] for d, w in want.items()}
    got = st.page_paragraphs(frame, chunk=chunk).collect()
    assert len({(r.doc_id, r.para_id) for r in got}) == len(got)
    assert {(r.doc_id, r.para_id): (r.first_page, r.text) for r in got} == \
        {(d, i): p for d, w in want.items() for i, p in enumerate(w["paragraphs"])}


def test_headers_across_pages(spark):
    docs = {1: ["The Big Green Book\nsome text The Big", "Green Book more. and The Big Green Book end.\nx."],
            2: ["Nothing here Two Words.\nend."]}
    paths = {1: "../data/raw/The Big Green Book.pdf", 2: "../data/raw/Two Words.pdf"}
    frame = pages_frame(spark, docs).withColumn(
        "path", F.when(F.col("doc_id") == 1, paths[1]).otherwise(paths[2]))
    got = st.page_paragraphs(frame, path="path", cleaned=True).collect()
    want = {d: document(p, {1: ["The", "Big", "Green", "Book"], 2: ["Two", "Words"]}[d])["clean"] for d, p in docs.items()}
    assert {(r.doc_id, r.para_id): r.text for r in got} == {(d, i): t for d, w in want.items() for i, t in enumerate(w)}


def test_whole_documents_match_plain_python(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.array_join(F.slice(F.split("text", " ", -1), 1, 5), " ").alias("path"))
    rows = frame.collect()
    want = {}
    for r in rows:
        title = [w.replace(".pdf", "") for w in r.path.replace("/", " ").split(" ") if w not in ("..", "data", "raw")]
        for i, t in enumerate(document([r.text], title)["clean"]):
            want[r.doc_id, i] = t
    got = {(r.doc_id, r.para_id): r.text for r in st.document_paragraphs(frame, path="path").collect()}
    assert got == want
    same = st.document_paragraphs(frame, cleaned=False).exceptAll(
        st.page_paragraphs(frame.withColumn("page", F.lit(0))).select("doc_id", F.col("para_id").cast("int"), "text"))
    assert same.count() == 0


def test_null_text_counts_as_empty(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 1, "x.")], "doc_id long, page int, text string")
    assert [(r.para_id, r.text) for r in st.page_paragraphs(frame).collect()] == [(0, "x.")]
    assert st.numbered_lines(frame).count() == 2


def test_cleaning_steps(spark):
    row = spark.range(1).select(
        tx.strip_brackets(F.lit("a (b] c")).alias("brackets"),
        tx.collapse_blanks(F.lit("  a\x1c\tb \n c ")).alias("blanks"),
        tx.strip_punctuation(F.lit("a-b  c!’d_")).alias("punctuation"),
        tx.title_words(F.lit("../data/raw/Some Act.pdf")).alias("words"),
        tx.title_ngrams(F.array(*[F.lit(x) for x in "ABCD"])).alias("grams"),
        tx.title_ngrams(F.array(F.lit("A"), F.lit("B"))).alias("few"),
        tx.first_words(F.lit("a  b c"), 3).alias("first"),
        tx.replace_in_path(F.lit("../data/raw/raw a.pdf")).alias("path")).first()
    assert row.brackets == "a  c"
    assert row.blanks == "a b c"
    assert row.punctuation == "ab  c’d"
    assert row.words == ["Some", "Act"]
    assert row.grams == ["A B C D", "A B C", "B C D"]
    assert row.few == []
    assert row["first"] == "a  b"
    assert row.path == "../data/processed/processed a.txt"


def test_row_numbers(spark):
    ids = [0, 1, 5, 6, 7, 40, 41, 999, 1000, 5000]
    frame = spark.createDataFrame([(c, i) for c in "BA" for i in ids], "country string, id long").repartition(5)
    got = {(r.country, r.id): r.n for r in scan.row_numbers(frame, "id", "n", ["country"]).collect()}
    assert got == {k: n for n, k in enumerate(sorted((c, i) for c in "AB" for i in ids))}
    plain = scan.row_numbers(frame.where("country = 'A'"), "id", "n")
    assert [r.id for r in plain.orderBy("n").collect()] == ids


def test_row_numbers_of_hashed_ids(spark):
    frame = spark.range(5000).select(F.xxhash64("id").alias("id"), F.lit("x").alias("text")).repartition(3)
    got = scan.row_numbers(frame, "id", "n").orderBy("n").collect()
    assert [r.id for r in got] == sorted(r.id for r in frame.collect()) and [r.n for r in got] == list(range(5000))


def test_hot_document_is_cut_into_chunks(spark):
    frame = spark.range(3000).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"),
        F.concat(F.lit("line "), F.col("id"), F.when(F.col("id") % 3 == 2, ".").otherwise("")).alias("text"))
    got = st.page_paragraphs(frame, chunk=64)
    assert got.count() == 1000
    assert got.where("para_id = 500").first().text == "line 1500 line 1501 line 1502."
