"""Checks of intake and codec operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import codec, intake
from sheaf.plans.check import check
from sheaf.plans.fixtures import Inputs


@check("intake_valid", """
select request_id, json_extract_string(raw,'$.url') as url,
 json_extract_string(raw,'$.headers."User-Agent"') as agent, json_extract_string(raw,'$.method') as method,
 json_extract_string(raw,'$.body.k') as body_k, json_extract_string(raw,'$.params.p') as param_p,
 json_extract_string(raw,'$.scrape_type') as scrape_type
from fx_requests where request_id%20 not in (0,4,8,12)""")
def intake_valid(fx: Inputs) -> DataFrame:
    valid, _ = intake.validate_requests(intake.parse_requests(fx.view("fx_requests"), "raw"))
    return valid.select(
        "request_id", "url", F.col("headers")["User-Agent"].alias("agent"), "method",
        F.get_json_object("body", "$.k").alias("body_k"), F.try_element_at("params", F.lit("p")).alias("param_p"),
        "scrape_type")


@check("intake_rejected", """
select request_id, case request_id%20 when 0 then 'object expected' when 4 then 'url: string expected'
 when 8 then 'method: one of GET, POST, PUT, DELETE, PATCH expected' else 'headers: object expected' end as reason
from fx_requests where request_id%20 in (0,4,8,12)""")
def intake_rejected(fx: Inputs) -> DataFrame:
    _, rejected = intake.validate_requests(intake.parse_requests(fx.view("fx_requests"), "raw"))
    return rejected.select("request_id", "reason")


@check("job_ids", "select page_id, job_id from fx_tasks")
def job_ids(fx: Inputs) -> DataFrame:
    tasks = fx.view("fx_tasks").drop("job_id")
    return intake.assign_job_ids(tasks, "enqueued_at", ["url"]).select("page_id", "job_id")


@check("routed", """
select topic, topic as channel, count(*) as n from (
 select case scrape_type when 'API' then 'scrape.input.api' when 'HTML' then 'scrape.input.browser.html'
  else 'scrape.input.browser.webdriver' end as topic from fx_tasks) group by topic""")
def routed(fx: Inputs) -> DataFrame:
    return intake.route(fx.view("fx_tasks")).groupBy("topic", "channel").agg(F.count("*").alias("n"))


@check("payload", """
select page_id, job_id, url, method, agent, param_p, body, cast(null as varchar) as scrape_type from fx_tasks""")
def payload(fx: Inputs) -> DataFrame:
    p = intake.to_payload(fx.tasks())

    def field(path: str):
        return F.get_json_object("payload", path)

    return p.select(
        "page_id", field("$.job_id").alias("job_id"), field("$.url").alias("url"), field("$.method").alias("method"),
        field("$.headers.User-Agent").alias("agent"), field("$.params.p").alias("param_p"),
        field("$.body").alias("body"), field("$.scrape_type").alias("scrape_type"))


LOOSE = """case {0} % 6
 when 0 then concat('{{"jobId":', {0}, ',"url":"', url, '"}}')
 when 1 then concat('{{"jobId":"', job_id, '","headers":["', agent, '"]}}')
 when 2 then concat('{{"jobId":"', job_id, '","url":"', url, '","params":{{"p":', {0}, '}}}}')
 when 3 then concat('{{"url":"', url, '","body":', body, '}}')
 when 4 then concat('{{"jobId":"', job_id, '","url":"', url, '","method":true,"headers":{{"n":1.5}},"body":"x"}}')
 else concat('{{"jobId":"', job_id, '","url":"', url, '","headers":{{"a":"', agent, '"}},"params":{{}},"body":"x"}}') end
"""


@check("verified", """
select page_id, case page_id%6 when 0 then 'jobId: string expected' when 1 then 'headers: object expected'
 when 2 then 'params: string{k:string} expected' when 3 then 'body: string expected'
 when 4 then 'method: string expected' end as reason from fx_tasks""")
def verified(fx: Inputs) -> DataFrame:
    loose = fx.view("fx_tasks").withColumn("json", F.expr(LOOSE.format("page_id")))
    return intake.verify_tasks(loose, "json").select("page_id", "reason")


@check("coerced", """
select page_id, case when page_id%6=0 then cast(page_id as varchar) when page_id%6=3 then '' else job_id end as job_id,
 case when page_id%6=1 then '' else url end as url, case when page_id%6=4 then 'true' else '' end as method,
 case page_id%6 when 4 then '{"n":"1.5"}' when 5 then concat('{"a":"',agent,'"}') else '{}' end as headers,
 case when page_id%6=2 then concat('{"p":"',page_id,'"}') else '{}' end as params,
 case page_id%6 when 3 then body when 4 then 'x' when 5 then 'x' else '' end as body,
 case when page_id%6=1 then 'headers: object expected' end as reason from fx_tasks""")
def coerced(fx: Inputs) -> DataFrame:
    loose = fx.view("fx_tasks").select("page_id", F.expr(LOOSE.format("page_id")).alias("json"))
    return intake.coerced(loose, "json").withColumn("headers", F.to_json("headers")).withColumn(
        "params", F.to_json("params")).drop("json")


@check("export_json", """
select page_id, job_id as id, url, nullif(method,'') as method, agent, param_p, body, method<>'' as has_method
from fx_tasks""")
def export_json(fx: Inputs) -> DataFrame:
    j = intake.export_tasks(fx.tasks())

    def field(path: str):
        return F.get_json_object("json", path)

    return j.select(
        "page_id", field("$.jobId").alias("id"), field("$.url").alias("url"), field("$.method").alias("method"),
        field("$.headers.User-Agent").alias("agent"), field("$.params.p").alias("param_p"), field("$.body").alias("body"),
        F.contains("json", F.lit('"method":')).alias("has_method"))


@check("export_json_defaults", """
select page_id, method, '{}' as params from fx_tasks""")
def export_json_defaults(fx: Inputs) -> DataFrame:
    bare = fx.tasks().withColumn("params", F.create_map().cast("map<string,string>"))
    j = intake.export_tasks(bare, defaults=True)
    return j.select("page_id", F.get_json_object("json", "$.method").alias("method"),
                    F.get_json_object("json", "$.params").alias("params"))


@check("envelopes", """
select job_id, url, concat('{"User-Agent":"',agent,'"}') as headers, cast(epoch(enqueued_at) as bigint) as timestamp,
 true as has_data from fx_tasks""")
def envelopes(fx: Inputs) -> DataFrame:
    e = intake.envelope(codec.encode_tasks(fx.tasks()), "enqueued_at")
    return e.select("job_id", "url", "headers", "timestamp", (F.octet_length("data") > 0).alias("has_data"))


@check("codec_roundtrip", """
select page_id, job_id, url, method, concat('{"User-Agent":"',agent,'"}') as headers,
 concat('{"p":"',param_p,'"}') as params, body from fx_tasks""")
def codec_roundtrip(fx: Inputs) -> DataFrame:
    sent = codec.encode_tasks(fx.tasks()).select("page_id", "value")
    tasks, _ = codec.decode_tasks(sent)
    return tasks.select("page_id", "job_id", "url", "method", F.to_json("headers").alias("headers"),
                        F.to_json("params").alias("params"), "body")


@check("codec_rejected", """
select page_id, case page_id%4 when 1 then 'rejected' when 2 then 'cancel' else 'task' end as state,
 case when page_id%4 in (1,2) then '' else job_id end as job_id from fx_tasks""")
def codec_rejected(fx: Inputs) -> DataFrame:
    value, kind = F.col("value"), F.pmod("page_id", F.lit(4))
    cut = F.substring(value, F.lit(1), F.octet_length(value) - 3)
    sent = codec.encode_tasks(fx.tasks()).select(
        "page_id", F.when(kind == 1, cut).when(kind != 2, value).alias("value"))
    state = F.when(F.col("error").isNotNull(), "rejected").when(F.col("cancel"), "cancel").otherwise("task")
    return codec.decode(sent).select("page_id", state.alias("state"), "job_id")


@check("delimited", """
select scrape_type, page_id//100 as batch, row_number() over (partition by scrape_type, page_id//100 order by page_id)-1 as pos,
 job_id from fx_tasks""")
def delimited(fx: Inputs) -> DataFrame:
    sent = codec.encode_tasks(fx.tasks()).select(
        "scrape_type", F.floor(F.col("page_id") / 100).alias("batch"), "page_id", "value")
    blobs = codec.join_delimited(sent, ["scrape_type", "batch"], "page_id")
    rows, _ = codec.split_delimited(blobs, "blob")
    tasks, _ = codec.decode_tasks(rows)
    return tasks.select("scrape_type", "batch", F.col("pos").cast("long").alias("pos"), "job_id")


@check("json_values", """
select msg_id, json_valid(payload) as ok,
 case when json_valid(payload) then json_extract_string(payload,'$.k') end as k from fx_stream""")
def json_values(fx: Inputs) -> DataFrame:
    log = fx.view("fx_stream").select("msg_id", F.col("payload").cast("binary").alias("value"))
    good, bad = codec.decode_values(log, "json")
    return good.select("msg_id", F.lit(True).alias("ok"), F.try_variant_get("doc", "$.k", "string").alias("k")).unionByName(
        bad.select("msg_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("k")))


@check("text_values", """
select page_id, page_id%5<>0 as ok, case when page_id%5<>0 then length(html) end as chars from pages""")
def text_values(fx: Inputs) -> DataFrame:
    raw = F.col("html").cast("binary")
    broken = F.concat(raw, F.lit(b"\xff"))
    log = fx.table("pages").select("page_id", F.when(F.col("page_id") % 5 == 0, broken).otherwise(raw).alias("value"))
    good, bad = codec.decode_values(log, "text")
    return good.select("page_id", F.lit(True).alias("ok"), F.length("text").cast("long").alias("chars")).unionByName(
        bad.select("page_id", F.lit(False).alias("ok"), F.lit(None).cast("long").alias("chars")))
