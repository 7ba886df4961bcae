"""What results cost on disk."""

from redgreen.sources import results as rs


def test_json_lines_are_written_compressed_and_read_as_they_are(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('https://ci.example/job/', id) url", "id % 7 = 0 flaky")
    rs.write_json(rows, str(tmp_path / "rows"))
    files = list((tmp_path / "rows").glob("part-*"))
    plain = sum(len(r) + 1 for r in rows.toJSON().collect())
    assert files and sum(f.stat().st_size for f in files) < plain / 3
    back = rs.read_json(spark, str(tmp_path / "rows"), "id bigint, url string, flaky boolean")
    assert sorted(back.collect()) == sorted(rows.collect())
