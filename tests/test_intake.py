import pytest
from pyspark.sql import functions as F

from sheaf.operators import codec, intake
from sheaf.schema import TASK


def test_every_request_is_valid_or_rejected(spark):
    raws = [
        '{"url":"u","headers":{"a":"b"},"scrape_type":"HTML"}', "{", "[1]", "null", "", None,
        '{"url":1,"headers":{}}', '{"url":"u","headers":[]}', '{"url":"u","headers":{"a":1}}',
        '{"url":"u","headers":{},"scrape_type":"FTP"}', '{"url":"u","headers":{},"scrape_type":"API"}',
        '{"url":"u","headers":{},"method":"GET","body":{"k":1}}', '{"url":"u","headers":{},"method":"GET","body":{"k":"v"}}',
        '{"url":"u","headers":{},"method":"GET","body":""}', '{"url":"u","headers":{},"params":[1]}',
        '{"url":"u","headers":{},"params":{"a":2}}', '{"url":"u","headers":{}}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    valid, rejected = intake.validate_requests(intake.parse_requests(df, "raw"))
    types = {r.i: r.scrape_type for r in valid.collect()}
    reasons = {r.i: r.reason for r in rejected.collect()}
    assert len(types) + len(reasons) == len(raws)
    assert types == {0: "HTML", 12: "API", 13: "API", 16: "HTML"}
    assert reasons[1] == reasons[2] == reasons[3] == reasons[4] == reasons[5] == "object expected"
    assert reasons[6] == "url: string expected"
    assert reasons[7] == "headers: object expected"
    assert reasons[8] == "headers: string{k:string} expected"
    assert reasons[9].startswith("scrape_type") and reasons[10].startswith("method")
    assert reasons[11] == "body: string{k:string} expected"
    assert reasons[14] == "params: object expected" and reasons[15] == "params: string{k:string} expected"


def test_empty_text_body_is_an_empty_object(spark):
    df = spark.createDataFrame([('{"url":"u","headers":{},"method":"GET","body":"","scrape_type":"API"}',)], "raw string")
    assert intake.validate_requests(intake.parse_requests(df, "raw"))[0].first().body == "{}"


def test_ids_are_stable_and_distinct(spark):
    df = spark.range(1000).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    ids = [r.job_id for r in intake.assign_job_ids(df, "ts", ["id"]).collect()]
    again = [r.job_id for r in intake.assign_job_ids(df, "ts", ["id"]).collect()]
    assert ids == again and len(set(ids)) == 1000
    assert all(i[14] == "7" and i[19] == "8" and len(i) == 36 for i in ids)


def test_unknown_type_is_an_error(spark):
    df = spark.createDataFrame([("FTP",)], "scrape_type string")
    assert intake.route(df, strict=False).first().topic is None
    with pytest.raises(Exception, match="unknown scrape type"):
        intake.route(df).collect()


def task(**given):
    row = {"job_id": "", "url": "", "method": "", "headers": {}, "params": {}, "body": ""}
    return tuple({**row, **given}[f] for f in row)


TASKS = [
    task(),
    task(job_id="j", url="https://example.com/é?q=1#f", method="GET", headers={"b": "2", "a": "ü"}, params={"": "", "x": ""}),
    task(body="x" * 127), task(body="x" * 128), task(body="é" * 10_000), task(body="y" * 3_000_000),
    task(job_id="big", headers={"k" * 200: "v" * 20_000}),
]


def test_messages_equal_the_protobuf_library(spark):
    make = codec._message_class()
    sent = codec.encode_tasks(spark.createDataFrame(TASKS, TASK)).collect()
    for r in sent:
        message = make()
        message.ParseFromString(bytes(r.value))
        assert message == make(job_id=r.job_id, url=r.url, method=r.method, headers=r.headers, params=r.params, body=r.body)


def test_decode_gives_back_what_was_encoded(spark):
    df = spark.createDataFrame(TASKS, TASK)
    tasks, rejected = codec.decode_tasks(codec.encode_tasks(df).select("value"))
    def key(r):
        return (r.job_id, r.url, r.method, sorted(r.headers.items()), sorted(r.params.items()), r.body)
    assert sorted(map(key, tasks.collect())) == sorted(map(key, df.collect()))
    assert rejected.count() == 0


def test_ten_megabytes(spark):
    df = spark.createDataFrame([task(job_id="big")], TASK).withColumn("body", F.repeat(F.lit("x"), 10_000_000))
    tasks, _ = codec.decode_tasks(codec.encode_tasks(df).select("value"))
    assert tasks.select(F.length("body")).first()[0] == 10_000_000


def test_decode_of_odd_bytes(spark):
    repeated = bytes.fromhex("0A0161" "0A0162" "22060A016B120131" "22060A016B120132" "5A0178")
    rows = [(0, b"some_message_bytes"), (1, None), (2, b""), (3, repeated), (4, b"\x0a\x01\xff")]
    got = {r.i: r for r in codec.decode(spark.createDataFrame(rows, "i int, value binary")).collect()}
    assert got[0].error and got[4].error and not got[0].cancel
    assert got[1].cancel and got[1].error is None
    assert got[2].error is None and got[2].job_id == "" and got[2].headers == {}
    assert got[3].job_id == "b" and got[3].headers == {"k": "2"}


def test_cut_blobs_are_rejected(spark):
    df = codec.encode_tasks(spark.createDataFrame(TASKS, TASK)).withColumn("batch", F.lit(1)).withColumn(
        "n", F.monotonically_increasing_id())
    blob = codec.join_delimited(df, ["batch"], "n")
    rows, rejected = codec.split_delimited(blob, "blob")
    assert rows.count() == len(TASKS) and rejected.count() == 0
    cut = blob.withColumn("blob", F.expr("substring(blob, 1, octet_length(blob) - 1)"))
    rows, rejected = codec.split_delimited(cut, "blob")
    assert rows.count() == 0 and rejected.count() == 1
