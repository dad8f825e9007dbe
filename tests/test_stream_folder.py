from lakeingest import IngestOptions
from lakeingest.streaming.dropfolder import stream_folder


def test_files_are_taken_once(spark, drop):
    options = IngestOptions(continue_on_error=True, hash_sources=False)
    counts = []
    for files in ({"a.csv": "k,v\n1,2\n", "b.jsonl": '{"k":5}\n{bad\n'}, {}, {"dir/c.csv": "k,v\n3,4\n"}):
        for name, text in files.items():
            drop(name, text)
        stream_folder(spark, drop.root, drop.out, drop.out + "/ck", options).awaitTermination()
        counts.append(spark.read.parquet(drop.out + "/auditoria").count())
    assert counts == [2, 2, 3]
    data = spark.read.parquet(drop.out + "/dados")
    assert sorted(r.k for r in data.collect()) == [1, 3, 5]
    assert spark.read.parquet(drop.out + "/quarentena").count() == 1
