"""Source files with bytes that aren't UTF-8."""

from gleaner.sources import files


def test_invalid_bytes_are_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"# caf\xe9 \xc3\xa9\r\n@app.get('/x')\n")
    (got,) = files.source_files(spark, str(tmp_path)).collect()
    assert got["content"] == "# caf é\n@app.get('/x')\n" and got["length"] == 26
