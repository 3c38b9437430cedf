"""The tail of growing files over restarts: appended lines, lines that are not finished, replaced files."""

from collections import Counter

from chronotape.sources import growing


def follow(spark, folder, state, table):
    query = (
        growing.growing_lines(spark, str(folder)).writeStream.format("parquet")
        .option("path", str(table)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return Counter((r["file"], r["value"]) for r in spark.read.schema("file string, value string").parquet(str(table)).collect())


def test_append_partial_line_and_replacement(spark, tmp_path):
    folder, state, table = tmp_path / "runs", tmp_path / "state", tmp_path / "out"
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo\nthr")
    (folder / "b.jsonl").write_text("é😀\r\n\nlast\n")
    (folder / "_hidden").write_text("no\n")
    want = Counter([("a.jsonl", "one"), ("a.jsonl", "two"), ("b.jsonl", "é😀"), ("b.jsonl", ""), ("b.jsonl", "last")])
    assert follow(spark, folder, state, table) == want
    # Nothing new, then the rest of a line and a new file.
    assert follow(spark, folder, state, table) == want
    with (folder / "a.jsonl").open("a") as file:
        file.write("ee\nfour\nfi")
    (folder / "c.jsonl").write_text("first\n")
    want += Counter([("a.jsonl", "three"), ("a.jsonl", "four"), ("c.jsonl", "first")])
    assert follow(spark, folder, state, table) == want
    # Another file under the name, longer than before; and a shorter one with the same first line.
    (folder / "a.jsonl").write_text("new run\n" + "step\n" * 30)
    (folder / "b.jsonl").write_text("é😀\r\n")
    want += Counter({("a.jsonl", "new run"): 1, ("a.jsonl", "step"): 30, ("b.jsonl", "é😀"): 1})
    assert follow(spark, folder, state, table) == want


def test_large_files_are_read_in_spans(tmp_path, monkeypatch):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(500)]
    (tmp_path / "big").write_text("\n".join(lines) + "\nunfinished")
    reader = growing.GrowingReader(str(tmp_path))
    for task, block in ((100, 7), (33, 64), (1 << 20, 1 << 16), (1, 50)):
        monkeypatch.setattr(growing, "TASK_BYTES", task)
        monkeypatch.setattr(growing, "BLOCK_BYTES", block)
        spans = reader.partitions({}, reader.latestOffset())
        assert [v for s in spans for _, v in reader.read(s)] == lines
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    assert growing.GrowingReader(str(tmp_path / "none")).latestOffset() == {}
