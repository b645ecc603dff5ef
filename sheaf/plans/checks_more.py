"""Checks of edges, of runs that repeat or resume, and of reads from a real store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ranking import quantiles
from sheaf.operators import attempts, changes, codec, groups, html, intake, intervals, requests, zset
from sheaf.operators.extract import Field, extract_records
from sheaf.operators.html import parse_html
from sheaf.plans import collect, items, results
from sheaf.plans.check import check
from sheaf.plans.checks_fetch import CLASS, METHOD, REQUEST_URL, _fake_session
from sheaf.plans.checks_results import FOLD, RUN, RUN_FIELDS, _store, _writes, task_log
from sheaf.plans.fixtures import Inputs
from sheaf.session import scratch, settled
from sheaf.sources import log as logs
from sheaf.sources import commits, objectstore, zsets
from sheaf.streaming.attempts import retry_stream
from sheaf.streaming.collect import captured_records, dedup_stream, run_stream, run_two_streams, settled_results
from sheaf.streaming.depth import change_stream, depth_of


def _with_own(fields, *own: str):
    """JSON text of the given fields (texts and columns) behind the page's own ones, named as in ``own`` ("column as name")."""
    fields = [F.lit(x) if isinstance(x, str) else x for x in fields]
    return F.concat(F.regexp_replace(F.to_json(F.struct(*[F.expr(x) for x in own])), r"\}$", ","), *fields, F.lit("}"))


@check("text_spaces", """
select page_id, 'td' as tag, chr(160) as text from pages
union all select page_id, 'pre', concat('x', page_id, '  ', chr(10), ' c') from pages""")
def text_spaces(fx: Inputs) -> DataFrame:
    """A no-break space is text, and any open ``pre`` keeps white space."""
    text = F.concat("html", F.lit("<td>&nbsp;</td><pre>x"), "page_id", F.lit("<b>  \n </b>c</pre>"))
    trees = settled(parse_html(fx.table("pages").withColumn("html", text)))
    return html.find_all(trees, "td").unionByName(html.find_all(trees, "pre")).select("page_id", "tag", "text")


@check("verified_nulls", """
select page_id, case page_id%3 when 1 then 'jobId: string expected' when 2 then 'params: string{k:string} expected' end as reason from pages""")
def verified_nulls(fx: Inputs) -> DataFrame:
    raw = F.when(F.col("page_id") % 3 == 0, _with_own(['"jobId":null,"headers":null'], "url", "html as body")).when(
        F.col("page_id") % 3 == 1, _with_own(['"jobId":5'], "url", "html as body")).otherwise(_with_own(['"body":null,"params":{"a":1}'], "url", "html as jobId"))
    return intake.verify_tasks(fx.table("pages").select("page_id", raw.alias("raw")), "raw").select("page_id", "reason")


@check("coerced_falsy", "select page_id, case page_id%3 when 2 then 'headers: object expected' end as reason from pages")
def coerced_falsy(fx: Inputs) -> DataFrame:
    own = "url", "html as body"
    raw = F.when(F.col("page_id") % 3 == 0, _with_own(['"headers":false,"params":""'], *own)).when(
        F.col("page_id") % 3 == 1, _with_own(['"headers":0,"params":null'], *own)).otherwise(_with_own(['"headers":"x"'], *own))
    return intake.coerced(fx.table("pages").select("page_id", raw.alias("raw")), "raw").select("page_id", "reason")


@check("requests_repeated_keys", "select page_id, concat('v',page_id) as url, cast(null as string) as reason from pages")
def requests_repeated_keys(fx: Inputs) -> DataFrame:
    raw = _with_own(['"headers":{},"url":"v', F.col("page_id").cast("string"), '"'], "url", "html as note")
    parsed = intake.parse_requests(fx.table("pages").select("page_id", raw.alias("raw")), "raw")
    return intake.with_reason(parsed).select("page_id", "url", "reason")


@check("cancelled_order", "select job_id from fx_tasks where page_id%4 in (0,3)")
def cancelled_order(fx: Inputs) -> DataFrame:
    """Time decides over partitions, whose offsets say nothing about each other: an early tombstone and a copy behind one."""
    sent = codec.encode_tasks(fx.tasks()).select("page_id", "job_id", "value", "scrape_type", F.col("enqueued_at").cast("timestamp").alias("at"))
    kind, none = F.col("page_id") % 4, F.lit(None).cast("binary")

    def entry(partition, offset, hours, value):
        return F.struct(F.lit(partition).alias("partition"), F.lit(offset).cast("long").alias("offset"),
                        (F.col("at") + F.make_dt_interval(hours=F.lit(hours))).alias("timestamp"), value.alias("value"))

    first, again = entry(0, 5, 0, F.col("value")), entry(0, 2, 2, F.col("value"))
    early, late = entry(1, 9, -1, none), entry(1, 1, 1, none)
    rows = F.when(kind == 0, F.array(first, early)).when(kind == 1, F.array(first, late)).when(
        kind == 2, F.array(first, late, again)).otherwise(F.array(first))
    log = sent.select(intake.topic_of(F.col("scrape_type")).alias("topic"), F.col("job_id").cast("binary").alias("key"), F.inline(rows))
    return collect.tasks_of(log, "scrape-all")[0].select("job_id")


@check("records_count", "select page_id, cast(len(regexp_extract_all(html,'<li><a ')) as bigint) as n, cast(0 as bigint) as none from pages")
def records_count(fx: Inputs) -> DataFrame:
    spec = {"n": Field("nav li > a", count=True), "none": Field("footer a", count=True)}
    return extract_records(parse_html(fx.table("pages")), spec)


@check("dequeue_twice", """
select queue, seq from (select channel as queue, msg_id as seq, row_number() over (partition by channel order by msg_id) as rn from fx_stream)
where rn between 6 and 10""")
def dequeue_twice(fx: Inputs) -> DataFrame:
    items = logs.enqueue(fx.view("fx_stream"), F.col("channel"), F.col("payload"), F.col("msg_id"))
    _, rest = groups.take(items, 5)
    return groups.take(rest, 5)[0].select("queue", "seq")


@check("delimited_cut", """
select scrape_type, (rn-1)//7 as blob_no, count(*) as n from (
 select scrape_type, row_number() over (partition by scrape_type order by page_id) as rn from fx_tasks) group by 1, 2""")
def delimited_cut(fx: Inputs) -> DataFrame:
    sent = codec.encode_tasks(fx.tasks()).select("scrape_type", "page_id", "value")
    rows, _ = codec.split_delimited(codec.join_delimited(sent, ["scrape_type"], "page_id", most=7), "blob")
    return rows.groupBy("scrape_type", "blob_no").agg(F.count("*").alias("n"))


@check("on_error_null", f"select job, attempt_id, case when {CLASS}='ok' then body end as body from fx_attempts")
def on_error_null(fx: Inputs) -> DataFrame:
    made = attempts.classify(fx.view("fx_attempts")).withColumn("error", F.when(F.col("outcome") != "ok", F.col("outcome")))
    return requests.on_error(made, "body", "error", "null").select("job", "attempt_id", "body")


@check("ensure_twice", "select id, name from fx_items")
def ensure_twice(fx: Inputs) -> DataFrame:
    """Making a table that is there already changes nothing."""
    path, rows = scratch(fx.spark, "ensured"), fx.view("fx_items").select("id", "name")
    objectstore.ensure_table(fx.spark, path, rows.schema)
    rows.write.mode("append").parquet(path)
    objectstore.ensure_table(fx.spark, path, rows.schema)
    return fx.spark.read.schema(rows.schema).parquet(path)


@check("fetch_resumed", f"""
with req as (select job_id, {REQUEST_URL} as request_url, page_id%3 as made from fx_tasks where {METHOD}<>'TRACE'),
tries as (select *, unnest([1,2,3]) as attempt from req),
judged as (select *, case when contains(request_url,'#') then 503 when contains(request_url,'/en/') and attempt=made+1 then null else 200 end as status
 from tries where attempt>made)
select job_id, attempt, status from judged
where contains(request_url,'#') or attempt=made+1 or (attempt=made+2 and contains(request_url,'/en/'))""")
def fetch_resumed(fx: Inputs) -> DataFrame:
    """Jobs that had no, one or two failed attempts before; three are the most in all."""
    before = fx.tasks().select("job_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int"))).alias("attempt"), F.lit(503).alias("status"))
    made = requests.fetch(requests.build_requests(fx.tasks()), _fake_session, before.filter("attempt > 0"), wait=0)
    return made.select("job_id", "attempt", "status")


@check("store_late_write", """
select object_key, case when object_key like 'team/%' then md5('newer') else md5(html) end as digest from fx_objects""")
def store_late_write(fx: Inputs) -> DataFrame:
    """A write that comes late, with a lower seq, does not replace a newer one."""
    path, first = scratch(fx.spark, "objects"), _writes(fx)
    team = first.filter(F.col("object_key").startswith("team/"))
    for rows, seq, text in ((first, 5, None), (team, 9, b"newer"), (team, 3, b"older")):
        content = F.lit(text) if text else F.col("content")
        objectstore.put_objects(fx.spark, path, rows.withColumns({"seq": F.lit(seq).cast("long"), "content": content}))
    return objectstore.live_objects(fx.spark, path).select("object_key", F.md5("content").alias("digest"))


@check("store_get", """
select job_id as object_key, md5(job_id) as digest from fx_objects union all select concat('none/',job_id), md5('') from fx_objects""")
def store_get(fx: Inputs) -> DataFrame:
    bare = fx.view("fx_objects").select(F.col("job_id").alias("object_key"))
    asked = bare.unionByName(bare.select(F.concat(F.lit("none/"), "object_key").alias("object_key")))
    return objectstore.get_stored(fx.spark, _store(fx), asked).select("object_key", F.md5("content").alias("digest"))


@check("store_list", "select object_key from fx_objects where starts_with(object_key,'team/')")
def store_list(fx: Inputs) -> DataFrame:
    return objectstore.list_stored(fx.spark, _store(fx), "team/")


@check("store_poll", """
select t.job_id, c.object_key, case when c.object_key like 'team/%' then 6 else octet_length(encode(o.html)) end as bytes
from fx_tasks t left join fx_completions c on c.job_id=t.job_id left join fx_objects o on o.object_key=c.object_key""")
def store_poll(fx: Inputs) -> DataFrame:
    found = results.poll_stored(fx.view("fx_tasks"), fx.view("fx_completions"), _store(fx))
    return found.select("job_id", "object_key", F.octet_length("content").cast("long").alias("bytes"))


@check("results_twice", """
select scrape_type, unnest(['raw','structured']) as kind, count(*) as n from fx_tasks group by 1, 2""")
def results_twice(fx: Inputs) -> DataFrame:
    """Storing a run again changes nothing."""
    path = scratch(fx.spark, "results")
    rows = fx.tasks().select("job_id", "scrape_type", F.date_format("enqueued_at", "yyyy-MM-dd").alias("day"), "page_id")
    for _ in range(2):
        results.store_results(rows, rows.drop("page_id"), path)
    read = results.results_by_kind(results.read_results(rows, path, "raw"), results.read_results(rows.drop("page_id"), path, "structured"))
    return read.groupBy("scrape_type", "kind").agg(F.count("*").alias("n"))


@check("completions_merged", """
select t.job_id, case when t.page_id%2=0 then 'new' else c.object_key end as object_key,
 1704067200 + t.page_id*600 + case when t.page_id%2=0 then 60 else 30 end as score
from fx_tasks t left join fx_completions c using (job_id) where t.page_id%2=0 or c.job_id is not null""")
def completions_merged(fx: Inputs) -> DataFrame:
    new = fx.tasks().filter("page_id % 2 = 0").select(
        "job_id", F.lit("new").alias("object_key"), (F.col("enqueued_at") + F.expr("interval 60 seconds")).alias("at"))
    return results.completions(new, "at", fx.view("fx_completions")).withColumn("score", F.col("score").cast("long"))


@check("items_two_runs", """
select 'DELETE' as op, max(id) as id, 200 as status from fx_items
union all select 'POST', (select max(id) from fx_items) + row_number() over (order by id), 201 from fx_items""")
def items_two_runs(fx: Inputs) -> DataFrame:
    """The highest id is deleted in one run, and not given again in the next."""
    base = fx.view("fx_items")
    next_id = changes.following_id(base)
    last = base.filter(F.col("id") == next_id - 1).select(F.lit(1).cast("long").alias("seq"), "id", F.lit("DELETE").alias("op"), "name", "description", "price")
    table, first = changes.apply_changes(base, last, next_id)
    posts = base.select(F.col("id").alias("seq"), "id", F.lit("POST").alias("op"), "name", "description", "price")
    _, second = changes.apply_changes(table, posts, changes.id_after(next_id, last))
    return first.unionByName(second).select("op", "id", "status")


def _broken(fx: Inputs) -> DataFrame:
    """The task log and, for some tasks, an entry more whose bytes are no task."""
    log = task_log(fx)
    bad = log.filter((F.col("offset") % 44 == 20) & F.col("value").isNotNull()).withColumn("offset", F.col("offset") + 1_000_000_000)
    return log.unionByName(bad.withColumn("value", F.lit(b"\x0a\xff\x01")))


BROKEN = "select job_id, seq from fx_log where seq%44=20 and not tombstone"


@check("collect_rejected", f"select job_id as key, seq+1000000000 as \"offset\" from ({BROKEN})")
def collect_rejected(fx: Inputs) -> DataFrame:
    made = collect.run_batch(_broken(fx), fx.table("pages"))
    return made.rejected.select(F.col("key").cast("string").alias("key"), "offset")


def _some_captured(fx: Inputs) -> DataFrame:
    """All pages but every fifth."""
    return fx.table("pages").filter("page_id % 5 <> 0")


LATE = "case when scrape_type='API' and method='TRACE' then 'Unsupported HTTP method.' when page_id%5=0 then 'transport_error' else 'ok' end"


def _streamed(fx: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, outcomes, rejected) of a continuous run over a log with broken entries and missing captures."""
    spark, path = fx.spark, scratch(fx.spark, "collect")
    logs.produce(_broken(fx), f"{path}/log")
    requests.latest_captures(_some_captured(fx)).write.parquet(f"{path}/captures")
    run_stream(spark, f"{path}/log", spark.read.parquet(f"{path}/captures"), f"{path}/out", "30 days", available_now=True)
    log = logs.read_log(spark, f"{path}/log")
    return log, settled_results(spark.read.parquet(f"{path}/out/raw"), log), spark.read.parquet(f"{path}/out/rejected")


@check("collect_late", RUN + f"select job_id, {LATE} as outcome from live union all select job_id, 'rejected' from ({BROKEN})")
def collect_late(fx: Inputs) -> DataFrame:
    """Every job of a continuous run has an outcome, and every broken entry is kept."""
    _, outcomes, rejected = _streamed(fx)
    return outcomes.select("job_id", "outcome").unionByName(
        rejected.select(F.col("key").cast("string").alias("job_id"), F.lit("rejected").alias("outcome")))


@check("collect_catch_up", RUN + f"""
select job_id, case when {LATE}='transport_error' then 'ok' else {LATE} end as outcome from live where {LATE}<>'ok'""")
def collect_catch_up(fx: Inputs) -> DataFrame:
    """Once all pages are captured, the jobs without a result get theirs."""
    log, outcomes, _ = _streamed(fx)
    return collect.catch_up(log, outcomes, fx.table("pages")).outcomes.select("job_id", "outcome")


@check("collect_resumed", RUN + "select job_id, 'ok' as outcome from ok where page_id%2=1 union all select job_id, 'Unsupported HTTP method.' from live join bad using (job_id) where page_id%2=1")
def collect_resumed(fx: Inputs) -> DataFrame:
    done = fx.tasks().filter("page_id % 2 = 0").select("job_id")
    return collect.run_batch(task_log(fx), fx.table("pages"), finished=done).outcomes.select("job_id", "outcome")


HOT = "(select min(url) from pages)"


@check("collect_hot_url", f"""
with hot as (select job_id, scrape_type, method, enqueued_at, case when page_id%3=0 then {HOT} else url end as url from fx_tasks),
latest as (select url, max(page_id) as page_id from pages group by url)
select concat('anon/',strftime(enqueued_at,'%Y/%m/%d'),'/',job_id,'/data.html') as object_key, md5(html) as digest
from hot join latest using (url) join pages using (page_id) where not (scrape_type='API' and method='TRACE')""")
def collect_hot_url(fx: Inputs) -> DataFrame:
    """A third of the tasks ask for one URL; the spreading of such URLs is on at any size."""
    url = F.when(F.col("page_id") % 3 == 0, F.lit(fx.table("pages").agg(F.min("url")).first()[0])).otherwise(F.col("url"))
    sent = codec.encode_tasks(fx.tasks().withColumn("url", url))
    log = logs.entries(sent, intake.topic_of(F.col("scrape_type")), F.col("job_id"), F.col("value"), F.col("page_id"), F.col("enqueued_at"))
    made = collect.run_batch(log, fx.table("pages"), hot_above=0)
    return made.objects.select("object_key", F.md5("content").alias("digest"))


@check("group_next_after", """
select channel, msg_id from (select channel, msg_id, row_number() over (partition by channel order by msg_id) as rn from fx_stream
 where msg_id>(select max(msg_id)//2 from fx_stream) and msg_id not in (select msg_id from fx_deliveries where grp='scrape-all'))
where rn<=3""")
def group_next_after(fx: Inputs) -> DataFrame:
    """Reading on from the position up to which a group has all."""
    log = fx.view("fx_stream")
    half = log.agg(F.max("msg_id")).first()[0] // 2
    after = {c: half for c in groups.profile_channels("scrape-all")}
    return groups.read_group(log, fx.view("fx_deliveries"), "scrape-all", 3, after).select("channel", "msg_id")


@check("collect_fetched", RUN + f""",
asked as (select * replace (case when scrape_type='API' then method else 'GET' end as method) from live),
made as (select job_id, page_id, {METHOD}='TRACE' as bad, {REQUEST_URL} as request_url from asked)
select job_id, case when bad then 'Unsupported HTTP method.' when contains(request_url,'#') then 'http_error' else 'ok' end as outcome,
 cast(case when bad then 0 when contains(request_url,'#') then 3 when contains(request_url,'/en/') then 2 else 1 end as bigint)
  + case when page_id%3=1 and not bad and not contains(request_url,'#') then 1 else 0 end as attempts,
 case when bad or contains(request_url,'#') then null else md5(request_url) end as digest from made""")
def collect_fetched(fx: Inputs) -> DataFrame:
    """A run that calls out; every third job had one failed attempt before."""
    at = F.col("enqueued_at").cast("timestamp").alias("attempted_at")
    before = fx.tasks().filter("page_id % 3 = 1").select("job_id", F.lit(1).alias("attempt"), at, F.lit(503).alias("status"))
    made = collect.run_fetched(task_log(fx), _fake_session, before, wait=0)
    contents = made.objects.select("object_key", F.md5("content").alias("digest"))
    return made.outcomes.join(contents, "object_key", "left").select("job_id", "outcome", "attempts", "digest")


GROWN = """select object_key, case when object_key like 'team/%' then md5('second') else md5(html) end as digest from fx_objects
union all select job_id, md5(case when page_id%3=0 then 'again' else job_id end) from fx_objects join fx_tasks using (job_id) where page_id%5<>0"""


def _grown(fx: Inputs) -> str:
    """A store folded twice, with puts and removals between and after; its files grow from one folding to the next."""
    path, bare = _store(fx), fx.tasks().select(F.col("job_id").alias("object_key"), "page_id")
    objectstore.compact_objects(fx.spark, path)
    again = bare.filter("page_id % 3 = 0").select(
        "object_key", F.lit(b"again").alias("content"), F.lit("text/plain").alias("content_type"), F.lit(1).cast("long").alias("seq"))
    objectstore.put_objects(fx.spark, path, again)
    objectstore.remove_objects(fx.spark, path, bare.filter("page_id % 10 = 0"))
    objectstore.compact_objects(fx.spark, path)
    objectstore.remove_objects(fx.spark, path, bare.filter("page_id % 10 = 5"))
    return path


@check("store_compacted", f"select * from ({GROWN})")
def store_compacted(fx: Inputs) -> DataFrame:
    """Folding changes no result, and nothing that was replaced comes back once it is deleted."""
    path = _grown(fx)
    objectstore.compact_objects(fx.spark, path)
    commits.vacuum(fx.spark, path, older_than=0)
    return objectstore.live_objects(fx.spark, path).select("object_key", F.md5("content").alias("digest"))


@check("store_grown", f"select * from ({GROWN}) union all select concat('none/',job_id), md5('') from fx_objects")
def store_grown(fx: Inputs) -> DataFrame:
    """Gets from a store in part folded, of keys that are there and keys that are not."""
    path, names = _grown(fx), fx.view("fx_objects").select("object_key", "job_id")
    kept = fx.tasks().filter("page_id % 5 <> 0").select(F.col("job_id").alias("object_key"))
    asked = names.select("object_key").unionByName(kept).unionByName(names.select(F.concat(F.lit("none/"), "job_id").alias("object_key")))
    return objectstore.get_stored(fx.spark, path, asked).select("object_key", F.md5("content").alias("digest"))


@check("store_two_writers", """
select object_key, md5(html) as digest from fx_objects union all select concat('b/',job_id), md5(job_id) from fx_objects
union all select 'both', md5('second')""")
def store_two_writers(fx: Inputs) -> DataFrame:
    """Two puts, each written before the other is committed, and a folding that began before either: all is kept."""
    spark, path = fx.spark, scratch(fx.spark, "objects")
    first = _writes(fx)
    bare = fx.view("fx_objects").select(
        F.concat(F.lit("b/"), "job_id").alias("object_key"), F.encode("job_id", "UTF-8").alias("content"), F.lit("t").alias("content_type"),
        F.lit(0).cast("long").alias("seq"))
    both = spark.createDataFrame([("both", b"first", "t", 0), ("both", b"second", "t", 1)], "object_key string, content binary, content_type string, seq long")
    written = []
    for rows in (first.unionByName(both.filter("seq = 1")), bare.unionByName(both.filter("seq = 0"))):
        at = commits.unfinished(path)
        rows.withColumn("length", F.octet_length("content").cast("long")).write.parquet(at)
        written.append(at)
    for at in written:
        commits.finish(spark, at, path, commits.PUT)
    return objectstore.live_objects(spark, path).select("object_key", F.md5("content").alias("digest"))


@check("results_moved_day", """
select job_id, scrape_type, case when page_id%2=0 then '2030-01-01' else strftime(enqueued_at,'%Y-%m-%d') end as day, unnest(['raw','structured']) as kind
from fx_tasks""")
def results_moved_day(fx: Inputs) -> DataFrame:
    """Every second job is stored again on another day: its first row is gone, also once the table is folded."""
    path = scratch(fx.spark, "results")
    rows = fx.tasks().select("job_id", "scrape_type", F.date_format("enqueued_at", "yyyy-MM-dd").alias("day"), "page_id")
    moved = rows.filter("page_id % 2 = 0").withColumn("day", F.lit("2030-01-01"))
    for made in (rows, moved):
        results.store_results(made, made.drop("page_id"), path)
    results.compact_results(rows, path, "raw")
    return results.results_by_kind(results.read_results(rows, path, "raw"), results.read_results(rows.drop("page_id"), path, "structured"))


def _sets(fx: Inputs, path: str) -> None:
    """Scores of the first half folded; then those of the second half, and members removed and one of them added again."""
    scores, names = fx.view("fx_scores"), fx.view("fx_scores").select("set_name", "member").distinct()
    half = scores.agg(F.max("seq")).first()[0] // 2
    zsets.zadd_stored(fx.spark, path, scores.filter(F.col("seq") <= half))
    zsets.fold_sets(fx.spark, path)
    zsets.zadd_stored(fx.spark, path, scores.filter(F.col("seq") > half))
    zsets.zremove_stored(fx.spark, path, names.filter("member like '%7}'"))
    zsets.zadd_stored(fx.spark, path, names.filter("member like '%17}'").select("set_name", "member", F.lit(50.0).alias("score"), F.lit(0).alias("seq")))


SETS = """
with kept as (select set_name, member, arg_max(score, seq) as score from fx_scores where member not like '%7}' group by 1, 2
 union all select distinct set_name, member, 50.0 from fx_scores where member like '%17}'),
placed as (select *, row_number() over (partition by set_name order by score, member)-1 as rank, count(*) over (partition by set_name) as size from kept)
"""


@check("zrange_stored", SETS + "select set_name, member, score, rank from placed where rank between 4 and 12")
def zrange_stored(fx: Inputs) -> DataFrame:
    """A window in the middle of stored sets, before the changes are folded in."""
    path = scratch(fx.spark, "sets")
    _sets(fx, path)
    return zsets.zrange_stored(fx.spark, path, 4, 12)


@check("zrange_stored_desc", SETS + "select set_name, member, score, size-1-rank as rank from placed where size-1-rank between 2 and size-3")
def zrange_stored_desc(fx: Inputs) -> DataFrame:
    """All but a few members in reverse, once all changes are folded in."""
    path = scratch(fx.spark, "sets")
    _sets(fx, path)
    zsets.fold_sets(fx.spark, path)
    return zsets.zrange_stored(fx.spark, path, 2, -3, desc=True)


@check("group_next_intervals", """
select channel, msg_id, payload from (select s.*, row_number() over (partition by channel order by msg_id) as rn
 from fx_stream s anti join fx_deliveries d using (channel, msg_id)) where rn<=6""")
def group_next_intervals(fx: Inputs) -> DataFrame:
    """Two reads of three entries a channel, the second one from the first one's state."""
    log = fx.view("fx_stream")
    state = settled(intervals.as_intervals(fx.view("fx_deliveries"), log))
    first, after = intervals.read_group_intervals(log, state, "scrape-all", 3)
    second, _ = intervals.read_group_intervals(log, settled(after), "scrape-all", 3)
    return first.unionByName(second).select("channel", "msg_id", "payload")


@check("pending_intervals", """
select d.grp, d.channel, d.msg_id from fx_deliveries d
 left join fx_acks a on a.grp=d.grp and a.channel=d.channel and a.msg_id=d.msg_id where a.msg_id is null""")
def pending_intervals(fx: Inputs) -> DataFrame:
    """The entries of what is left of the delivered intervals once the acknowledged ones are taken out."""
    log = fx.view("fx_stream")
    delivered, acked = (settled(intervals.as_intervals(fx.view(v), log)) for v in ("fx_deliveries", "fx_acks"))
    return intervals.entries_in(log, intervals.pending_intervals(delivered, acked))


def _run(stream: DataFrame, path: str, name: str) -> None:
    """Runs a stream to the end of what is there, into ``path/name``."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoints/{name}").trigger(availableNow=True).start(
        f"{path}/{name}").awaitTermination()


TRIES = """
with tries as (select concat('job-',attempt_id//3) as job, attempt_id, attempt_at, status, attempt_id%3 as k from fx_attempts where attempt_id//3%4<>attempt_id%3),
"""


@check("stream_retries", TRIES + f"""
judged as (select *, row_number() over (partition by job order by attempt_id) as rn, {CLASS} as outcome from tries),
firsts as (select job, min(rn) filter (outcome='ok') as good, max(rn) as n from judged where rn<=3 group by job),
said as (select job, coalesce(good, n) as rn, case when good is not null then 'done' when n>=3 then 'failed' else 'due' end as state from firsts)
select job, state, rn as attempts, outcome, status from said join judged using (job, rn)""")
def stream_retries(fx: Inputs) -> DataFrame:
    """The last word on each job of a stream that is stopped in the middle and started again."""
    spark, path = fx.spark, scratch(fx.spark, "retries")
    n, at = F.col("attempt_id"), F.timestamp_seconds(F.col("attempt_id") * 60)
    tries = fx.view("fx_attempts").filter(F.floor(n / 3) % 4 != n % 3).select(
        F.concat(F.lit("job-"), F.floor(n / 3)).alias("job"), "attempt_id", at.alias("at"), F.col("status").cast("int").alias("status"))
    half = F.lit(quantiles(tries, n, [0.5])[0]).cast("long")
    last = tries.agg(F.max("attempt_id")).first()[0]
    end = spark.range(1).select(F.lit("end").alias("job"), F.lit(0).cast("long").alias("attempt_id"), F.timestamp_seconds(F.lit(last * 60 + 7200)).alias("at"),
                                F.lit(200).alias("status"))
    parts = (tries.filter(n <= half), tries.filter(n > half), end, end.withColumn("at", F.col("at") + F.expr("interval 2 hours")))
    for part in parts:
        part.write.mode("append").parquet(f"{path}/tries")
        read = spark.readStream.schema(tries.schema).parquet(f"{path}/tries")
        _run(retry_stream(attempts.classify(read), "job", "attempt_id", "at", "1 hour"), path, "said")
    said = spark.read.parquet(f"{path}/said").filter("job <> 'end'")
    rank = F.struct(F.col("state") != "due", "attempts")
    last = said.groupBy("job").agg(F.max_by(F.struct("state", "attempts", "outcome", "status"), rank).alias("r"))
    return last.select("job", "r.state", F.col("r.attempts").cast("long").alias("attempts"), "r.outcome", F.col("r.status").cast("long").alias("status"))


@check("depth_stream", """
with changes as (select channel, time_bucket(interval 1 hour, ts) as w, 1 as d from fx_stream
 union all select channel, time_bucket(interval 1 hour, ts), -1 from fx_stream where msg_id%3=0),
slots as (select channel, w, sum(d) as change from changes group by 1, 2),
runs as (select *, sum(change) over (partition by channel order by w) as depth from slots)
select channel, cast(w as timestamp) as window_start, cast(change as bigint) as change, cast(depth as bigint) as depth,
 cast(ceil(greatest(depth,0)/10) as bigint) as workers from runs""")
def depth_stream(fx: Inputs) -> DataFrame:
    """Entries and acknowledgements in two runs, where those of the second are mostly older than those of the first."""
    spark, path = fx.spark, scratch(fx.spark, "depth")
    log = fx.view("fx_stream").select("channel", "msg_id", F.col("ts").cast("timestamp").alias("ts"))
    acks = log.filter("msg_id % 3 = 0").withColumnRenamed("ts", "acked_at")
    late = F.col("msg_id") % 2 == 0
    middle = F.timestamp_seconds(F.lit(quantiles(log, F.unix_timestamp("ts"), [0.5])[0]))
    for first in (True, False):
        for rows, name, at in ((log, "log", "ts"), (acks, "acks", "acked_at")):
            new = (F.col(at) >= middle) | late
            rows.filter(new if first else ~new).write.mode("append").parquet(f"{path}/{name}")
        arrivals, done = (spark.readStream.schema(f"channel string, msg_id long, {at} timestamp").parquet(f"{path}/{n}") for n, at in (("log", "ts"), ("acks", "acked_at")))
        _run(change_stream(arrivals, done, "1 hour"), path, "changes")
    made = depth_of(spark.read.parquet(f"{path}/changes"), 10)
    return made.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@check("dedup_late", "select job_id, scrape_type, url from fx_log where not tombstone group by job_id, scrape_type, url")
def dedup_late(fx: Inputs) -> DataFrame:
    """Three runs: the newer half of the log, the older one, whose first copies come behind any watermark, and the newer half once more."""
    spark, path = fx.spark, scratch(fx.spark, "dedup")
    tasks = fx.view("fx_log").filter(~F.col("tombstone")).withColumn("at", F.col("enqueued_at").cast("timestamp"))
    half = quantiles(tasks, F.col("seq"), [0.5])[0]
    for part in (F.col("seq") > half, F.col("seq") <= half, F.col("seq") > half):
        tasks.filter(part).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(tasks.schema).parquet(f"{path}/log")
        _run(dedup_stream(stream, "at", None).select("job_id", "scrape_type", "url"), path, "out")
    return spark.read.parquet(f"{path}/out")


@check("collect_two_streams", RUN + f"""
select job_id, scrape_type, url, 'ok' as outcome, {RUN_FIELDS} from ok
union all select l.job_id, l.scrape_type, l.url, 'Unsupported HTTP method.', null, null, null, null, null, null
from live l join bad using (job_id)""")
def collect_two_streams(fx: Inputs) -> DataFrame:
    """Tasks and captures as two streams, in two runs: a third of the pages is captured only after its tasks were read."""
    spark, path = fx.spark, scratch(fx.spark, "collect")
    log, pages = task_log(fx), requests.latest_captures(fx.table("pages"))
    times = fx.tasks().select("page_id", (F.col("enqueued_at").cast("timestamp") + F.expr("interval 1 hour")).alias("captured_at"))
    captures = pages.join(times, "page_id").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "captured_at")
    late = F.col("page_id") % 3 == 0
    for first in (True, False):
        if first:
            logs.produce(log, f"{path}/log")
        captures.filter(~late if first else late).write.mode("append").parquet(f"{path}/captures")
        run_two_streams(spark, f"{path}/log", f"{path}/captures", f"{path}/out", "400 days", "1 day", "400 days", available_now=True)
    # an entry and a capture far ahead close the time of jobs that no capture answers
    far = F.expr("interval 2000 days")
    logs.produce(log.filter(F.col("value").isNotNull()).limit(1).withColumn("timestamp", F.col("timestamp") + far), f"{path}/log")
    captures.limit(1).withColumns({"captured_at": F.col("captured_at") + far, "url": F.lit("none"), "page_id": F.lit(-1).cast("long")}).write.mode(
        "append").parquet(f"{path}/captures")
    for _ in range(2):
        run_two_streams(spark, f"{path}/log", f"{path}/captures", f"{path}/out", "400 days", "1 day", "400 days", available_now=True)
    made = captured_records(spark.read.parquet(f"{path}/out/raw"), spark.read.parquet(f"{path}/out/pages"))
    return settled_results(made, logs.read_log(spark, f"{path}/log")).select(
        "job_id", "scrape_type", "url", "outcome", "object_key", *collect.PAGE_RECORD)


def _changed(fx: Inputs, path: str) -> DataFrame:
    """The statuses of all changes, applied to a stored table in three runs; the table is folded between them."""
    base, rows = fx.view("fx_items"), fx.view("fx_changes")
    items.store_items(base, path)
    items.compact_items(fx.spark, path)
    next_id, cuts = changes.following_id(base), quantiles(rows, F.col("seq"), [0.3, 0.6])
    said = []
    for part in (F.col("seq") <= cuts[0], (F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1]), F.col("seq") > cuts[1]):
        said.append(items.apply_stored(fx.spark, path, rows.filter(part), next_id))
        next_id = changes.id_after(next_id, rows.filter(part))
        if len(said) == 2:
            items.compact_items(fx.spark, path)
    return said[0].unionByName(said[1]).unionByName(said[2])


@check("items_incremental", FOLD + """
select id, arg_max(name, seq) as name, arg_max(description, seq) filter (description is not null) as description,
 arg_max(price, seq) as price from sets where id not in (select id from life where closed is not null) group by id""")
def items_incremental(fx: Inputs) -> DataFrame:
    path = scratch(fx.spark, "items")
    _changed(fx, path)
    return items.stored_items(fx.spark, path)


@check("items_incremental_status", FOLD + """
select seq, op, id, case when live then 200 else 404 end as status from judged
union all select seq, op, new_id, 201 from news""")
def items_incremental_status(fx: Inputs) -> DataFrame:
    return _changed(fx, scratch(fx.spark, "items"))


@check("items_get_stored", """
select a.id, i.name, i.description, i.price, case when i.id is null then 404 else 200 end as status
from (select distinct id from fx_changes) a left join fx_items i on i.id=a.id""")
def items_get_stored(fx: Inputs) -> DataFrame:
    path = scratch(fx.spark, "items")
    items.store_items(fx.view("fx_items"), path)
    items.compact_items(fx.spark, path)
    return items.get_stored_items(fx.spark, path, fx.view("fx_changes"))


@check("log_from_offsets", """
select 'batch' as kind, job_id, seq as "offset" from fx_log where seq>(select max(seq)//2 from fx_log)
union all select 'stream', job_id, seq from fx_log where seq>(select max(seq)//2 from fx_log)""")
def log_from_offsets(fx: Inputs) -> DataFrame:
    """A batch and a stream that start behind a position of each partition."""
    spark, path = fx.spark, scratch(fx.spark, "log")
    whole = task_log(fx)
    half = whole.agg(F.max("offset")).first()[0] // 2
    logs.produce(whole.filter(F.col("offset") <= half), path)
    after = logs.positions(logs.read_log(spark, path))
    logs.produce(whole.filter(F.col("offset") > half), path)
    _run(logs.read_log(spark, path, stream=True, after=after), f"{path}-out", "read")
    read = {"batch": logs.read_log(spark, path, after=after), "stream": spark.read.parquet(f"{path}-out/read")}
    batch, stream = (df.select(F.lit(k).alias("kind"), F.col("key").cast("string").alias("job_id"), "offset") for k, df in read.items())
    return batch.unionByName(stream)


@check("collect_from", RUN + """
select job_id, 'ok' as outcome from ok union all select job_id, 'Unsupported HTTP method.' from live join bad using (job_id)""")
def collect_from(fx: Inputs) -> DataFrame:
    """Two batches, the second from the positions that the first one reached; cancels that came late count at the end."""
    spark, path = fx.spark, scratch(fx.spark, "collect")
    whole = task_log(fx)
    half = whole.agg(F.max("offset")).first()[0] // 2
    logs.produce(whole.filter(F.col("offset") <= half), f"{path}/log")
    first, reached = collect.collect_from(spark, f"{path}/log", fx.table("pages"))
    kept = settled(first.outcomes)
    logs.produce(whole.filter(F.col("offset") > half), f"{path}/log")
    second, _ = collect.collect_from(spark, f"{path}/log", fx.table("pages"), reached, kept)
    log = logs.read_log(spark, f"{path}/log")
    cancels = log.filter(F.col("value").isNull()).select(F.col("key").cast("string").alias("job_id")).distinct()
    return kept.unionByName(second.outcomes).join(cancels, "job_id", "left_anti").select("job_id", "outcome")


@check("search_kept", """
select t.job_id, c.job_id is not null as found, case when c.job_id is not null then t.url end as url
from fx_tasks t left join fx_completions c using (job_id)""")
def search_kept(fx: Inputs) -> DataFrame:
    """A search of members that were decoded when they were added."""
    path, tasks = scratch(fx.spark, "members"), fx.tasks()
    done = codec.encode_tasks(tasks).join(fx.view("fx_completions").select("job_id", "score"), "job_id").select(F.col("value").alias("member"), "score")
    zset.with_tasks(done.unionByName(done.withColumn("member", F.lit(b"\xff")).limit(5))).write.parquet(path)
    return zset.search(fx.spark.read.parquet(path), tasks).select("job_id", "found", "url")


@check("delimited_bytes", "select scrape_type, count(*) as n, sum(page_id) as ids from fx_tasks group by scrape_type")
def delimited_bytes(fx: Inputs) -> DataFrame:
    """Blobs cut by bytes, each within its bound but for its last message, and taken apart again."""
    sent = codec.encode_tasks(fx.tasks()).select("scrape_type", "page_id", "value")
    blobs = codec.join_delimited(sent, ["scrape_type"], "page_id", most_bytes=2000)
    rows, _ = codec.split_delimited(blobs.filter("octet_length(blob) < 3000"), "blob")
    tasks, _ = codec.decode_tasks(rows, "value")
    return tasks.groupBy("scrape_type").agg(F.count("*").alias("n"), F.sum(F.substring(F.col("params")["p"], 2, 20).cast("long")).alias("ids"))
