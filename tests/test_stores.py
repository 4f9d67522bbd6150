"""Stores, streams and text rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import chunk, embedding, filetype, text
from quillstream.operators import vector
from quillstream.sources.stores import VectorStore, appended, binary_files, chunk_store, clash_free, text_files, vector_rows
from quillstream.streaming import ingest as streaming


def rows(spark, items):
    return spark.createDataFrame([(i, [float(i)] * 3, f"t{i}", "d", i, "text", "", "u", 1, None, None, None, kb) for i, kb in items], "n int, embedding array<float>, document string, document_id string, chunk_index int, source_type string, source_info string, uploader_id string, version int, ts timestamp, bbox string, custom_metadata string, knowledge_base_id string").withColumn("id", F.col("n").cast("string")).drop("n")


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    assert store.count() == 0
    store.add(rows(spark, [(1, "a"), (2, "a"), (3, "b")]))
    store.add(rows(spark, [(2, "a"), (4, "a"), (4, "a")]))
    assert (store.count("a"), store.count("b"), store.count("none")) == (3, 1, 0)
    with pytest.raises(ValueError):
        store.add(rows(spark, [(9, "a")]), dimension=4)
    store.delete("a", where=F.col("chunk_index") == 1)
    assert sorted(r["id"] for r in store.read("a").collect()) == ["2", "4"]
    assert store.count("b") == 1
    store.drop("b")
    assert store.count() == 2
    with pytest.raises(ValueError):
        store.delete("a")


def test_vector_store_deletes_all(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    store.add(rows(spark, [(1, "a"), (2, "a"), (3, "b")]))
    store.delete("a", where=F.lit(True))
    assert (store.count("a"), store.count("b")) == (0, 1)
    store.add(rows(spark, [(7, "a")]))
    store.delete("a", ids=spark.createDataFrame([("7",), ("8",)], "id string"))
    store.delete("absent", where=F.lit(True))
    assert (store.count("a"), store.count()) == (0, 1)


def test_vector_store_keeps_one_dimension(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    mixed = rows(spark, [(1, "a")]).unionByName(rows(spark, [(2, "a")]).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    null = rows(spark, [(4, "a")]).withColumn("embedding", F.lit(None).cast("array<float>"))
    for bad in (mixed, null, rows(spark, [(1, "a")]).withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            store.add(bad)
    assert store.count() == 0 and store.dimension("a") is None
    store.add(rows(spark, [(1, "a")]))
    with pytest.raises(ValueError):
        store.add(rows(spark, [(5, "a")]).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4)))
    store.add(rows(spark, [(5, "b")]).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4)))
    assert (store.dimension("a"), store.dimension("b"), store.count()) == (3, 4, 2)


@pytest.mark.parametrize("names", [["a.txt", "a.txt", "a_1.txt"], ["a_1.txt", "a.txt", "a.txt", "a.txt"], ["a", "a", "a_1", "a_1_1", "a_1"], [".env", ".env", "x.tar.gz", "x.tar.gz"], ["a_1.txt", "a_1.txt", "a.txt", "a_1_1.txt"]])
def test_free_names_are_probed(spark, names):
    taken, want = set(), []
    for name in names:
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        free, n = name, 1
        while free in taken:
            free, n = f"{stem}_{n}{dot}{ext}", n + 1
        taken.add(free)
        want.append(free)
    df = spark.createDataFrame([(g, i, n) for g in (1, 2) for i, n in enumerate(names)], "group_id long, i int, name string")
    got = {(r["group_id"], r["i"]): r["stored"] for r in clash_free(df).collect()}
    assert [got[1, i] for i in range(len(names))] == [got[2, i] for i in range(len(names))] == want


def test_custom_metadata_is_kept(spark):
    c = spark.createDataFrame([("d", 0, "t", [1.0], {"a": "1"})], "document_id string, chunk_index int, text string, embedding array<float>, custom_metadata map<string,string>")
    c = c.withColumns({"structure_path": F.array(F.lit("x"), F.lit("y")), "bbox": F.array(*[F.lit(i) for i in range(4)]), "source_type": F.lit("t"), "uploader_id": F.lit("u"), "knowledge_base_id": F.lit("k")})
    r = vector_rows(c, F.current_timestamp()).first()
    assert (r["custom_metadata"], r["source_info"], r["bbox"]) == ('{"a":"1"}', "x > y", "0,1,2,3")
    assert vector_rows(c.withColumn("custom_metadata", F.to_json("custom_metadata")), F.current_timestamp()).first()["custom_metadata"] == '{"a":"1"}'


def test_nearest_takes_odd_vectors(spark):
    v = [(1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, 1.0, 1.0], 1), (6, [], 1), (7, [float("nan"), 0.0], 1), (None, [0.0, 0.0], 1), (8, [0.0, 3.0], None), (9, [2.0, 0.0], 1), (10, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(v, "id long, embedding array<double>, kb int")
    q = df.withColumnRenamed("id", "query_id").where("query_id IN (1, 2, 4, 5)")
    for size in (1, 100):
        got = sorted((r["query_id"], r["rank"], r["id"], r["raw_distance"]) for r in vector.nearest(q, df, 2, shard=size, group=size).collect())
        assert got == [(1, 1, 1, 0.0), (1, 2, 3, 2.0), (5, 1, 5, 0.0)]


def test_append_keeps_ids_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "id long, text string")
    assert sorted(map(tuple, appended(old, new).collect())) == [(1, "a"), (2, "b"), (3, "y")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r["text"] for r in text_files(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo\n"]


def test_chunk_store_and_binary_files(spark, tmp_path):
    (tmp_path / "k.json").write_text('[{"id": "a", "text": "one", "metadata": {"x": "1"}}, {"id": "b", "text": "two"}]')
    assert [tuple(r) for r in chunk_store(spark, str(tmp_path / "k.json")).orderBy("id").collect()] == [("a", "one", {"x": "1"}), ("b", "two", None)]
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [(r["length"], bytes(r["content"])) for r in binary_files(spark, str(tmp_path / "x.bin")).collect()] == [(3, b"abc")]


def test_chunkers_and_cleaners_of_ones_own(spark):
    chunk.register_chunker("Halves", lambda c: F.array(F.left(c, F.lit(2)), F.substring(c, F.lit(3), F.length(c))))
    try:
        df = spark.createDataFrame([("halves", "abcdef"), ("other", "ab cd")], "kind string, t string")
        assert [r["c"] for r in df.select(chunk.by_element(F.col("t"), F.col("kind")).alias("c")).collect()] == [["ab", "cdef"], ["ab cd"]]
        assert [r["c"] for r in df.select(text.clean(F.col("t"), F.upper).alias("c")).collect()] == ["ABCDEF", "AB CD"]
    finally:
        del chunk.CHUNKERS["halves"]


def test_models_by_name():
    assert embedding.model_config("bge-m3").longest == 8192 and embedding.model_config("none") is None
    embedding.register_model(embedding.ModelConfig("own", "/m"))
    assert embedding.model_config("own").batch_size == 32


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").write.parquet(str(src))
    run = lambda: streaming.ingest(spark, str(src), "id long, text string", lambda df: df.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3), (2, 1)]


def test_cleaning_is_idempotent(spark):
    c = text.clean(F.col("t"))
    df = spark.createDataFrame([(t,) for t in ("  ａ　ｂ ", "x\u001c\u0085y", "“q”…", "", None)], "t string").select(c.alias("t"))
    assert [r["t"] for r in df.collect()] == [r["t"] for r in df.select(text.clean(F.col("t")).alias("t")).collect()]


def test_signature_cases(spark):
    for body, mime in ((b"\x89PNG\r\n\x1a\nx", "image/png"), (b"PK\x03\x04x", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (b"RIFFxxxxAVI ", None), (b"RIFF", "image/webp"), (b"\x1f\x8bx", "application/gzip"), (b"<HTML>", "text/html")):
        df = spark.createDataFrame([(bytearray(body),)], "b binary")
        assert df.select(filetype.mime_by_signature(F.col("b"))).first()[0] == mime


def test_embedder(spark):
    r = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string").select(embedding.hashed(8)("t").alias("e")).collect()
    assert r[0] == r[1] and len(r[0]["e"]) == 8 and not any(r[2]["e"]) and not any(r[3]["e"])
