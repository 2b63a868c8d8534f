from lattica.streaming.edges import running_degrees, stream_edges


def test_degrees_follow_the_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("# c\n0 1 2\n1 2\n")
    degrees = running_degrees(stream_edges(spark, str(folder)))
    query = degrees.writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert {r.id: r.degree for r in spark.table("degrees").collect()} == {0: 2.0, 1: 3.0, 2: 1.0}
        (folder / "b").write_text("2 2 5\n")
        query.processAllAvailable()
        assert {r.id: (r.degree, r.degree_unweighted) for r in spark.table("degrees").collect()} == {0: (2.0, 1), 1: (3.0, 2), 2: (11.0, 3)}
    finally:
        query.stop()
