from hubwarden.streaming.watch import watch

SCHEMA = (
    "target string, relpath string, name string, depth int, size long, is_file boolean, is_symlink boolean, content binary"
)


def _row(relpath, text):
    data = text.encode()
    return ("t", relpath, relpath.rsplit("/", 1)[-1], relpath.count("/"), len(data), True, False, data)


def test_stream_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "landed")
    first = [_row("a.json", "[SYSTEM OVERRIDE]"), _row("s.py", "import subprocess"), _row("x.json", "y" * 200)]
    second = [_row(".env", "HF_TOKEN=123456789"), _row("d/Dockerfile", "USER root")]
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(landed)
    batch = {(r.check, r.file) for r in watch(spark.read.parquet(landed), 100).collect()}
    query = (
        watch(spark.readStream.schema(SCHEMA).parquet(landed), 100)
        .writeStream.format("memory")
        .queryName("watched")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    query.stop()
    stream = {(r.check, r.file) for r in spark.table("watched").collect()}
    assert stream == batch == {
        ("poisoning_trigger_pattern", "a.json"),
        ("suspicious_import", "s.py"),
        ("file_too_large", "x.json"),
        ("exposed_secret", ".env"),
        ("root_deployment", "d/Dockerfile"),
    }
