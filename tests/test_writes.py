"""Cards and the write side: cases that the tables don't hold."""

import __spark_entry__ as entry
import oracle
from marlstone.functions import text as X
from marlstone.operators import cards as K
from marlstone.operators import ingest as M
from marlstone.operators import writes as W
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_spaced_capitals(spark):
    cases = {"R E P O R T for  A B C": "REPORT for A B C", "xA B C D": "xA B C D", "A B C D": "ABCD", "": "", "A B C D E  F": "ABCDE F", "éA B C D": "éA B C D"}
    assert {k: one(spark, k, X.squeezed) for k in cases} == cases


def test_squeezed_text_follows_its_sql(spark, tmp_path):
    texts = ["A B C D", "x  R E P O R T.A B C D  y", "one. two", "A  B", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.connect(str(tmp_path))
    assert oracle.differences(spark, con, str(tmp_path), entry.queries()["squeezed_text"], entry.oracle_sql()["squeezed_text"]) == ""


def test_keep_extension(spark):
    rows = [("new.json", "a.pdf", "new.pdf"), ("new", "a.tar.gz", "new.gz"), (" x.md ", "plain", "x.md"), (None, "a.pdf", "a.pdf"), ("", "a.pdf", "a.pdf"), (".hidden", "a.b", ".hidden.b")]
    df = spark.createDataFrame(rows, "s string, f string, want string")
    assert df.where(~X.keep_extension(F.col("s"), F.col("f")).eqNullSafe(F.col("want"))).count() == 0


def test_suggestion_and_page(spark):
    assert one(spark, "  Tax_Return 2024! ", X.suggestion) == "tax return 2024"
    assert one(spark, "one two three four", X.suggestion) == "one two three" and one(spark, "a b c d e", X.suggestion) == "" and one(spark, "!!", X.suggestion) == ""
    assert one(spark, "PAGE 12 image 3", X.page_of) == 12 and one(spark, "rows 1-5", X.page_of) is None


def test_signals(spark):
    assert one(spark, "a.XLSX", K.format_signal) == "spreadsheet" and one(spark, "noext", K.format_signal) is None
    assert one(spark, r"C:\Work\ Receipts \a.pdf", K.path_prior) == "receipt" and one(spark, "/invoicesx/a", K.path_prior) is None


def test_free_destinations(spark):
    plan = spark.createDataFrame([(1, "/a/x.pdf"), (2, "/a/x.pdf"), (3, "/a/x.pdf"), (4, "/a/y"), (5, "/a/y"), (6, "/b/z.pdf")], "file_id long, to_path string")
    there = spark.createDataFrame([("/a/x (2).pdf",), ("/a/y",), ("/a/y (2)",)], "path string")
    got = {r.file_id: r.to_path for r in W.free_destinations(plan, there).collect()}
    assert got == {1: "/a/x.pdf", 2: "/a/x (3).pdf", 3: "/a/x (4).pdf", 4: "/a/y (3)", 5: "/a/y (4)", 6: "/b/z.pdf"}
    # a destination that itself ends in a number meets the listing by its whole name
    plan = spark.createDataFrame([(1, "/a/x (2).pdf")], "file_id long, to_path string")
    assert W.free_destinations(plan, there).first().to_path == "/a/x (2) (2).pdf"


def test_edits(spark):
    files = spark.createDataFrame([(1, "h1")], "file_id long, content_hash string")
    none = spark.createDataFrame([], "file_id long, field string, value string, edited_at int, content_hash string")
    new = spark.createDataFrame([(1, "document_type", "cv", 1), (1, "document_type", None, 2), (1, "path", "x", 1), (9, "document_type", "x", 1), (1, "key_facts.", "x", 1)], "file_id long, field string, value string, edited_at int")
    assert [tuple(r) for r in W.set_edits(none, new, files).collect()] == [(1, "document_type", None, 2, "h1")]
    assert W.refused(new, files).count() == 3
    assert W.edit_dump(W.set_edits(none, new, files)).first().edits == '[{"field":"document_type","value":null}]'


def test_enqueue_keeps_attempts(spark):
    schema = "path string, event_type string, queued_at timestamp, status string, attempts int, last_error string, priority int, recency double"
    queue = spark.createDataFrame([("a", "created", None, "failed", 3, "x", 0, 1.0)], schema)
    change = queue.select("path", F.lit("modified").alias("kind"), "queued_at", "priority", "recency")
    kept, reset = M.enqueue(queue, change).first(), M.enqueue(queue, change, reset_attempts=True).first()
    assert (kept.status, kept.attempts, kept.last_error) == ("pending", 3, None) and reset.attempts == 0


def test_summary_text(spark):
    budget = 2000
    chunks = [f"{k:03d} " + "w" * 400 for k in range(40)]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(chunks)] + [(2, 0, "short")], "file_id long, chunk_index int, text string")
    got = {r.file_id: r.text for r in K.summary_text(df, budget).collect()}
    picks = [1 + round(i * 38 / 3) for i in range(4)]
    want = K.GAP.join(["\n\n".join(chunks[:12])[:1000]] + [chunks[k][:250] for k in picks])[: budget + 64]
    assert got == {1: want, 2: "short"}


def test_entity_facts(spark):
    rows = [(1, "money", "$5", "$5"), (1, "money", "5", "5"), (1, "person", "#1", "#1"), (1, "person", "Ann Lee", "Ann Lee"), (1, "date", "x", "3 May 2024"), (1, "date", "y", "soon"), (1, "email", "a@b.co", "A@b.co"), (1, "email", "a@b.co", "a@B.co"), (1, "other", "z", "z")]
    got = K.entity_facts(spark.createDataFrame(rows, "file_id long, entity_type string, entity_value string, entity_raw string"))
    assert {(r.fact_type, r.value_text, r.value_number, r.value_date) for r in got.collect()} == {("money", "$5", 5.0, None), ("person", "Ann Lee", None, None), ("date", "3 May 2024", None, "2024-05-03"), ("email", "a@b.co", None, None)}
