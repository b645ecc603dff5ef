"""Test inputs derived from the source tables, as SQL for Spark and DuckDB.

They are put into queries as common table expressions, so nothing is registered in the session.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ["pages", "events", "part"]

VIEWS = {
    "fx_tasks": {
        "spark": """
select page_id, concat(substr(h,1,8),'-',substr(h,9,4),'-7',substr(m,1,3),'-8',substr(m,4,3),'-',substr(m,7,12)) as job_id,
 url, case cast(floor(page_id/3) as int)%7 when 0 then 'GET' when 1 then 'post' when 2 then '' when 3 then 'PUT' when 4 then 'DELETE' when 5 then 'PATCH' else 'TRACE' end as method,
 concat('bot/',cast(page_id%4 as string)) as agent, concat('v',cast(page_id as string)) as param_p, concat('{"k":"',cast(page_id as string),'"}') as body,
 case page_id%3 when 0 then 'API' when 1 then 'HTML' else 'WEBDRIVER' end as scrape_type,
 timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,page_id*600) as enqueued_at
from (select page_id, url, md5(url) m, lpad(lower(hex(1704067200000+page_id*600000)),12,'0') h from pages)
""",
        "duckdb": """
select page_id, concat(substr(h,1,8),'-',substr(h,9,4),'-7',substr(m,1,3),'-8',substr(m,4,3),'-',substr(m,7,12)) as job_id,
 url, case cast(floor(page_id/3) as int)%7 when 0 then 'GET' when 1 then 'post' when 2 then '' when 3 then 'PUT' when 4 then 'DELETE' when 5 then 'PATCH' else 'TRACE' end as method,
 concat('bot/',cast(page_id%4 as varchar)) as agent, concat('v',cast(page_id as varchar)) as param_p, concat('{"k":"',cast(page_id as varchar),'"}') as body,
 case page_id%3 when 0 then 'API' when 1 then 'HTML' else 'WEBDRIVER' end as scrape_type,
 timestamp '2024-01-01 00:00:00' + to_seconds(page_id*600) as enqueued_at
from (select page_id, url, md5(url) m, printf('%012x',1704067200000+page_id*600000) h from pages)
""",
    },
    "fx_requests": {
        "both": """
select page_id as request_id, enqueued_at as received_at,
 case when page_id%20=0 then concat('{"url":"',url,'","headers":')
  when page_id%20=4 then concat('{"headers":{"User-Agent":"',agent,'"},"scrape_type":"HTML"}')
  when page_id%20=8 then concat('{"url":"',url,'","headers":{},"method":"TRACE","body":{},"scrape_type":"API"}')
  when page_id%20=12 then concat('{"url":"',url,'","scrape_type":"WEBDRIVER"}')
  when scrape_type='API' then concat('{"url":"',url,'","headers":{"User-Agent":"',agent,'"},"method":"PUT","body":',body,',"params":{"p":"',param_p,'"},"scrape_type":"API"}')
  else concat('{"url":"',url,'","headers":{"User-Agent":"',agent,'"},"scrape_type":"',scrape_type,'"}') end as raw
from fx_tasks
""",
    },
    "fx_log": {
        "both": """
select 'kafka' as path, page_id*4 as seq, job_id, scrape_type, url, enqueued_at, false as tombstone from fx_tasks
union all select 'redis', page_id*4+1, job_id, scrape_type, url, enqueued_at, false from fx_tasks where page_id%10<>9
union all select 'kafka', page_id*4+2, job_id, scrape_type, url, enqueued_at, false from fx_tasks where page_id%25=0
union all select 'kafka', page_id*4+3, job_id, scrape_type, cast(null as string), enqueued_at, true from fx_tasks where page_id%40=7
""",
    },
    "fx_stream": {
        "both": """
select case user_id%3 when 0 then 'scrape.input.api' when 1 then 'scrape.input.browser.html' else 'scrape.input.browser.webdriver' end as channel,
 event_id as msg_id, ts, event_type, case when event_id%10=0 then substr(props,1,4) else props end as payload from events
""",
    },
    "fx_deliveries": {
        "both": """
select 'scrape-all' as grp, channel, msg_id, concat('worker-',channel) as consumer, ts as delivered_at from fx_stream where msg_id%2=0
""",
    },
    "fx_acks": {
        "both": """
select 'scrape-all' as grp, channel, msg_id from fx_stream where msg_id%2=0 and event_type<>'error'
""",
    },
    "fx_scores": {
        "both": """
select event_type as set_name, concat('{"user": ',user_id,'}') as member, value as score, event_id as seq from events
""",
    },
    "fx_attempts": {
        "both": """
select user_id as job, event_id as attempt_id, ts as attempt_at,
 case event_type when 'view' then 200 when 'click' then 200 when 'purchase' then 404 when 'error' then 503 end as status,
 case when event_type='signup' then 'ConnectionError' end as error, props as body from events
""",
    },
    "fx_objects": {
        "spark": """
select concat(case when page_id%2=0 then 'anon' else 'team' end,'/',date_format(enqueued_at,'yyyy/MM/dd'),'/',job_id,'/data.html') as object_key, t.job_id, p.html from fx_tasks t join pages p using (page_id)
""",
        "duckdb": """
select concat(case when page_id%2=0 then 'anon' else 'team' end,'/',strftime(enqueued_at,'%Y/%m/%d'),'/',job_id,'/data.html') as object_key, t.job_id, p.html from fx_tasks t join pages p using (page_id)
""",
    },
    "fx_completions": {
        "both": """
select t.job_id, o.object_key, 1704067200 + page_id*600 + 30 as score from fx_tasks t join fx_objects o on o.job_id=t.job_id where page_id%4<>3
""",
    },
    "fx_items": {
        "both": """
select p_partkey as id, p_name as name, p_type as description, p_retailprice as price from part
""",
    },
    "fx_changes": {
        "both": """
select event_id as seq, case when event_id%11=0 then user_id+1000000 else user_id end as id,
 case event_type when 'signup' then 'PUT' when 'purchase' then 'PATCH' when 'click' then 'POST' else 'DELETE' end as op,
 concat('n',event_id) as name, case when event_id%2=0 then concat('d',event_id) end as description, value as price
from events where event_type in ('signup','purchase','click') or (event_type='error' and event_id%7=0)
""",
    },
    "fx_model_output": {
        "both": """
select msg_id as job, payload as answer from fx_stream
""",
    },
}


def _body(name: str, dialect: str) -> str:
    view = VIEWS[name]
    return view.get("both") or view[dialect]


def _needed(sql: str, dialect: str) -> list[str]:
    """Views a query uses, directly or through others, in dependency order."""
    used = set(re.findall(r"\bfx_\w+", sql))
    grown = True
    while grown:
        more = {n for v in used for n in re.findall(r"\bfx_\w+", _body(v, dialect))} - used
        used, grown = used | more, bool(more)
    return [v for v in VIEWS if v in used]


def with_views(sql: str, dialect: str, first: list[str] = ()) -> str:
    """The query behind a WITH list of the views it uses."""
    parts = [*first, *(f"{v} as ({_body(v, dialect)})" for v in _needed(sql, dialect))]
    if not parts:
        return sql
    own = re.match(r"\s*with\s+", sql, re.I)
    rest = ",\n" + sql[own.end():] if own else "\n" + sql
    return "with " + ",\n".join(parts) + rest


class Inputs:
    """The source tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        tables = [f"{t} as (select * from parquet.`{self.folder}/{t}.parquet`)" for t in SOURCES]
        return self.spark.sql(with_views(f"select * from {name}", "spark", tables))

    def tasks(self) -> DataFrame:
        """fx_tasks with its headers and params as maps."""
        return (self.view("fx_tasks")
                .withColumn("headers", F.create_map(F.lit("User-Agent"), "agent"))
                .withColumn("params", F.create_map(F.lit("p"), "param_p")))

    def objects(self) -> DataFrame:
        return self.view("fx_objects").withColumn("content", F.col("html").cast("binary"))
