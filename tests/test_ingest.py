"""Files to vectors and questions to answers."""

from pyspark.sql import functions as F

from quillstream.functions import answer
from quillstream.plans import ingest
from quillstream.streaming.ingest import last_turns


def test_files_to_answers(spark):
    files = [("d1", "a.md", b"# Solar\n\nPanels turn light into power.\n\n- cheap\n- clean\n"), ("d2", "b.txt", "1. Wind energy is taken from moving air masses\nBlades turn.".encode()), ("d3", "c.pdf", b"%PDF-1.4")]
    df = spark.createDataFrame([(i, n, bytearray(b)) for i, n, b in files], "doc_id string, name string, content binary")
    elements, rejects = ingest.routed(df)
    assert [tuple(r) for r in rejects.collect()] == [("d3", "c.pdf", "rejected")]
    cut = ingest.chunks(None, elements=elements)
    texts = {(r["doc_id"], r["chunk_index"]): r["text"] for r in cut.collect()}
    assert texts[("d1", 0)].startswith("# Solar Panels") or texts[("d1", 0)].startswith("# Solar")
    rows = ingest.vectors(cut, F.lit("kb"), F.lit("u"), F.lit("text"), F.lit("2024-01-01").cast("timestamp"))
    other = rows.withColumn("knowledge_base_id", F.lit("other"))
    asked = spark.createDataFrame([(1, "what is solar power from panels?", "kb"), (2, "anything", "absent")], "query_id long, question string, kb string")
    got = {r["query_id"]: r for r in ingest.ask(asked, rows.unionByName(other)).collect()}
    assert "Panels" in got[1]["answer"] and got[1]["n_citations"] > 0 and "[1]" in got[1]["user_prompt"]
    assert got[2]["answer"] == answer.NOT_FOUND and got[1]["answer"].startswith(answer.FOUND[0]) and "（无可用参考资料）" in got[2]["user_prompt"] and got[2]["n_citations"] == 0


def test_last_turns(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(c, t, "user", "x") for c in (1, 2) for t in range(25 if c == 1 else 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = last_turns(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM kept").collect()) == [(1, 20, 24), (2, 3, 2)]
