"""Checks of the object store, results, polling, whole runs and the keyed table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import changes, objects
from sheaf.operators.codec import encode_tasks
from sheaf.operators.extract import extract_records
from sheaf.operators.html import parse_html
from sheaf.operators.requests import latest_captures
from sheaf.plans import collect, items, results
from sheaf.plans.check import check
from sheaf.plans.checks_html import NAV_LINKS, inner, plain
from sheaf.plans.fixtures import Inputs
from sheaf.session import scratch
from sheaf.sources import log as logs
from sheaf.sources import objectstore
from sheaf.streaming.collect import run_stream, settled_results


@check("object_keys", """
select page_id, concat('anon/',strftime(enqueued_at,'%Y/%m/%d'),'/',job_id,'/data.json') as object_key from fx_tasks""")
def object_keys(fx: Inputs) -> DataFrame:
    return objects.object_keys(fx.view("fx_tasks"), "enqueued_at").select("page_id", "object_key")


def _writes(fx: Inputs) -> DataFrame:
    return fx.objects().select("object_key", "content", F.lit("text/html").alias("content_type"), F.lit(0).cast("long").alias("seq"))


def _second(fx: Inputs) -> DataFrame:
    """Later writes: all objects of one prefix again, and one more object per job under its bare id."""
    again = _writes(fx).filter(F.col("object_key").startswith("team/")).withColumn("content", F.lit(b"second"))
    bare = fx.view("fx_objects").select(
        F.col("job_id").alias("object_key"), F.encode("job_id", "UTF-8").alias("content"),
        F.lit("text/plain").alias("content_type"), F.lit(0).cast("long").alias("seq"))
    return again.withColumn("seq", F.lit(1).cast("long")).unionByName(bare)


def _store(fx: Inputs) -> str:
    path = scratch(fx.spark, "objects")
    objectstore.put_objects(fx.spark, path, _writes(fx))
    objectstore.put_objects(fx.spark, path, _second(fx))
    return path


STORE = """
select object_key, case when object_key like 'team/%' then 'second' else html end as content, 'text/html' as content_type from fx_objects
union all select job_id, job_id, 'text/plain' from fx_objects"""


@check("put_objects", f"""
select object_key, content_type, md5(content) as digest, cast(octet_length(encode(content)) as bigint) as length from ({STORE})""")
def put_objects(fx: Inputs) -> DataFrame:
    stored = objectstore.live_objects(fx.spark, _store(fx))
    return stored.select("object_key", "content_type", F.md5("content").alias("digest"), "length")


@check("removed_objects", f"""
select object_key, md5(content) as digest from ({STORE}) where object_key not like 'anon/%'""")
def removed_objects(fx: Inputs) -> DataFrame:
    path = _store(fx)
    gone = fx.view("fx_objects").filter(F.col("object_key").startswith("anon/"))
    objectstore.remove_objects(fx.spark, path, gone)
    return objectstore.live_objects(fx.spark, path).select("object_key", F.md5("content").alias("digest"))


@check("list_objects", "select object_key from fx_objects where starts_with(object_key,'anon')")
def list_objects(fx: Inputs) -> DataFrame:
    return objects.list_objects(fx.view("fx_objects"))


@check("get_objects", """
select object_key, md5(html) as digest from fx_objects
union all select concat('none/',job_id), md5('') from fx_objects""")
def get_objects(fx: Inputs) -> DataFrame:
    there = fx.objects()
    asked = there.select("object_key").unionByName(
        there.select(F.concat(F.lit("none/"), "job_id").alias("object_key")))
    return objects.get_objects(asked, there).select("object_key", F.md5("content").alias("digest"))


@check("preview", """
with cut as (select object_key, hex(encode(html))[1:1000] as h from fx_objects)
select object_key, coalesce(try(decode(unhex(h))), h) as preview from cut""")
def preview(fx: Inputs) -> DataFrame:
    return objects.preview(fx.objects()).select("object_key", "preview")


@check("delete_objects", "select object_key from fx_objects where object_key not like 'team/%'")
def delete_objects(fx: Inputs) -> DataFrame:
    there = fx.objects()
    return objects.delete_objects(there, there.filter(F.col("object_key").startswith("team/"))).select("object_key")


@check("results", """
select scrape_type, strftime(enqueued_at,'%Y-%m-%d') as day, unnest(['raw','structured']) as kind, count(*) as n
from fx_tasks group by 1, 2, 3""")
def stored_results(fx: Inputs) -> DataFrame:
    path = scratch(fx.spark, "results")
    day = F.date_format("enqueued_at", "yyyy-MM-dd").alias("day")
    raw = fx.tasks().join(fx.table("pages").select("page_id", "html"), "page_id").select("job_id", "scrape_type", day, "page_id", "html")
    keep = ("job_id", "scrape_type", "day")
    records = extract_records(parse_html(raw, keep=keep), collect.PAGE_RECORD, keep=keep)
    results.store_results(raw, records, path)
    read = results.results_by_kind(results.read_results(raw, path, "raw"), results.read_results(records, path, "structured"))
    return read.groupBy("scrape_type", "day", "kind").agg(F.count("*").alias("n"))


@check("completions", """
select t.job_id, o.object_key, cast(epoch(t.enqueued_at)+30 as bigint) as score
from fx_tasks t join fx_objects o using (job_id)""")
def completions(fx: Inputs) -> DataFrame:
    done = fx.view("fx_tasks").join(fx.view("fx_objects").select("job_id", "object_key"), "job_id")
    twice = done.withColumn("at", F.col("enqueued_at") + F.expr("interval 30 seconds")).unionByName(
        done.withColumn("at", F.col("enqueued_at")).withColumn("object_key", F.lit("earlier")))
    return results.completions(twice, "at").withColumn("score", F.col("score").cast("long"))


@check("poll", """
select t.job_id, c.job_id is not null as available, case when c.job_id is null then 'Results not yet available' end as message,
 c.object_key, octet_length(encode(o.html)) as bytes
from fx_tasks t left join fx_completions c on c.job_id=t.job_id left join fx_objects o on o.object_key=c.object_key""")
def poll(fx: Inputs) -> DataFrame:
    answer = results.poll(fx.view("fx_tasks"), fx.view("fx_completions"), fx.objects())
    return answer.withColumn("bytes", F.octet_length("content").cast("long")).drop("content")


def task_log(fx: Inputs) -> DataFrame:
    """fx_log as a topic log: encoded tasks keyed by job, null values as cancels."""
    tasks = encode_tasks(fx.tasks()).select("job_id", "value")
    rows = fx.view("fx_log").join(tasks, "job_id")
    topic = F.col("topic")
    return logs.entries(
        rows.withColumn("topic", _topic()), topic, F.col("job_id"),
        F.when(~F.col("tombstone"), F.col("value")), F.col("seq"), F.col("enqueued_at"))


def _topic():
    from sheaf.operators.intake import topic_of

    return topic_of(F.col("scrape_type"))


RUN = f"""
with live as (select * from fx_tasks where job_id not in (select job_id from fx_log where tombstone)),
bad as (select job_id from live where scrape_type='API' and method='TRACE'),
ok as (select t.*, p.html from live t join pages p using (page_id) where t.job_id not in (select job_id from bad))
"""
RUN_FIELDS = f"""concat('anon/',strftime(enqueued_at,'%Y/%m/%d'),'/',job_id,'/data.html') as object_key,
 {plain(inner('title'))} as title, nullif({plain(inner('h1'))},'') as heading,
 regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, {plain(f"({NAV_LINKS.format(1)})[1]")} as first_link,
 cast(len(regexp_extract_all(html, '<a ')) as bigint) as links"""


@check("collect_batch", RUN + f"""
select job_id, scrape_type, url, 'ok' as outcome, {RUN_FIELDS} from ok
union all select l.job_id, l.scrape_type, l.url, 'Unsupported HTTP method.', null, null, null, null, null, null
from live l join bad using (job_id)""")
def collect_batch(fx: Inputs) -> DataFrame:
    return collect.run_batch(task_log(fx), fx.table("pages")).outcomes.drop("finished_at")


@check("collect_objects", RUN + """
select concat('anon/',strftime(enqueued_at,'%Y/%m/%d'),'/',job_id,'/data.html') as object_key, md5(html) as digest from ok""")
def collect_objects(fx: Inputs) -> DataFrame:
    made = collect.run_batch(task_log(fx), fx.table("pages"))
    return made.objects.select("object_key", F.md5("content").alias("digest"))


@check("collect_profile", RUN + """
select scrape_type, count(*) as n from ok where scrape_type in ('API','HTML') group by scrape_type""")
def collect_profile(fx: Inputs) -> DataFrame:
    made = collect.run_batch(task_log(fx), fx.table("pages"), "scrape-non-webdriver")
    return made.records.groupBy("scrape_type").agg(F.count("*").alias("n"))


@check("collect_stream", RUN + f"select job_id, scrape_type, url, {RUN_FIELDS} from ok")
def collect_stream(fx: Inputs) -> DataFrame:
    """The continuous run over a file log, run to the log's end."""
    spark, path = fx.spark, scratch(fx.spark, "collect")
    logs.produce(task_log(fx), f"{path}/log")
    latest_captures(fx.table("pages")).write.parquet(f"{path}/captures")
    run_stream(spark, f"{path}/log", spark.read.parquet(f"{path}/captures"), f"{path}/out", "30 days", available_now=True)
    made = settled_results(spark.read.parquet(f"{path}/out/records"), logs.read_log(spark, f"{path}/log"))
    return made.select("job_id", "scrape_type", "url", "object_key", *collect.PAGE_RECORD)


NEW_IDS = """
news as (select c.*, (select max(id)+1 from fx_items) + row_number() over (order by seq)-1 as new_id from fx_changes c where op='POST')"""


@check("items_create", f"""
with {NEW_IDS} select seq, new_id as id, name, coalesce(description,'') as description, price from news""")
def items_create(fx: Inputs) -> DataFrame:
    posts = fx.view("fx_changes").filter("op = 'POST'").drop("id")
    made = changes.create_items(posts, changes.following_id(fx.view("fx_items")))
    return made.select("seq", "id", "name", "description", "price")


@check("items_all", "select id, name, description, price from fx_items")
def items_all(fx: Inputs) -> DataFrame:
    """The whole table, from storage: half of it folded, and half appended since."""
    path, rows = scratch(fx.spark, "items"), fx.view("fx_items")
    items.store_items(rows.filter("id % 2 = 0"), path)
    items.compact_items(fx.spark, path)
    items.store_items(rows.filter("id % 2 = 1"), path)
    return items.stored_items(fx.spark, path)


@check("items_get", """
select a.id, i.name, i.description, i.price, case when i.id is null then 404 else 200 end as status
from (select distinct id from fx_changes) a left join fx_items i on i.id=a.id""")
def items_get(fx: Inputs) -> DataFrame:
    return changes.get_items(fx.view("fx_items"), fx.view("fx_changes"))


FOLD = f"""
with {NEW_IDS},
born as (select id, -1 as seq from fx_items union all select new_id, seq from news),
life as (select b.id, b.seq as born, (select min(c.seq) from fx_changes c where c.id=b.id and c.op='DELETE' and c.seq>b.seq) as closed
 from born b),
judged as (select c.*, l.id is not null and c.seq>l.born and (l.closed is null or c.seq<=l.closed) as live
 from fx_changes c left join life l on l.id=c.id where c.op<>'POST'),
sets as (select id, -1 as seq, name, description, price, false as patch from fx_items
 union all select new_id, seq, name, coalesce(description,''), price, false from news
 union all select id, seq, name, case when op='PUT' then coalesce(description,'') else description end, price, op='PATCH'
  from judged where live and op in ('PUT','PATCH'))
"""


@check("items_status", FOLD + """
select seq, op, id, case when live then 200 else 404 end as status from judged
union all select seq, op, new_id, 201 from news""")
def items_status(fx: Inputs) -> DataFrame:
    _, statuses = changes.apply_changes(fx.view("fx_items"), fx.view("fx_changes"))
    return statuses


@check("items_apply", FOLD + """
select id, arg_max(name, seq) as name, arg_max(description, seq) filter (description is not null) as description,
 arg_max(price, seq) as price from sets where id not in (select id from life where closed is not null) group by id""")
def items_apply(fx: Inputs) -> DataFrame:
    table, _ = changes.apply_changes(fx.view("fx_items"), fx.view("fx_changes"))
    return table
