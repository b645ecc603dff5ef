"""Checks of request, fetch and retry operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import attempts, html, requests
from sheaf.plans.check import check
from sheaf.plans.fixtures import Inputs

METHOD = "coalesce(nullif(upper(method),''),'GET')"
REQUEST_URL = f"""case when {METHOD}='GET' then concat(regexp_extract(url,'^([^#]*)',1),
 case when contains(regexp_extract(url,'^([^#]*)',1),'?') then '&' else '?' end,'p=',param_p,regexp_extract(url,'(#.*)$',1))
 when {METHOD} in ('POST','PUT','DELETE','PATCH') then url end"""


@check("build_requests", f"""
select job_id, {METHOD} as http_method, {REQUEST_URL} as request_url,
 case when {METHOD} in ('POST','PUT','DELETE','PATCH') then body end as request_body,
 case when {METHOD}='TRACE' then 'Unsupported HTTP method.' end as request_error from fx_tasks""")
def build_requests(fx: Inputs) -> DataFrame:
    return requests.build_requests(fx.tasks()).select(
        "job_id", "http_method", "request_url", "request_body", "request_error")


def _fake_session():
    """A fetch function for tests: no network, its answer follows from the URL and the attempt."""
    seen = {}

    def send(request, timeout):
        job = request["job_id"]
        seen[job] = seen.get(job, 0) + 1
        if "#" in request["request_url"]:
            return 503, b""
        if "/en/" in request["request_url"] and seen[job] == 1:
            raise ConnectionError
        return 200, request["request_url"].encode()

    return send


@check("fetch_fake", f"""
with req as (select job_id, {REQUEST_URL} as request_url from fx_tasks where {METHOD}<>'TRACE'),
tries as (select *, unnest([1,2,3]) as attempt from req),
made as (select *, case when contains(request_url,'#') then 503 when contains(request_url,'/en/') and attempt=1 then null
  else 200 end as status from tries)
select job_id, attempt, status, case when status is null then 'ConnectionError' end as error,
 case when status=200 then request_url when status=503 then '' end as content from made
where contains(request_url,'#') or attempt=1 or (attempt=2 and contains(request_url,'/en/'))""")
def fetch_fake(fx: Inputs) -> DataFrame:
    asked = requests.build_requests(fx.tasks())
    return requests.fetch(asked, _fake_session, wait=0).select(
        "job_id", "attempt", "status", "error", F.col("content").cast("string").alias("content"))


@check("fetch_captured", """
select t.job_id, case when t.page_id%9=0 then null else p.page_id end as page_id,
 case when t.page_id%9=0 then null else length(p.html) end as chars
from fx_tasks t join pages p using (page_id)""")
def fetch_captured(fx: Inputs) -> DataFrame:
    pages = fx.table("pages")
    older = pages.withColumn("page_id", F.col("page_id") - 1_000_000_000).withColumn("html", F.lit("old"))
    missing = F.concat("url", F.lit("?not-captured"))
    tasks = fx.tasks().drop("page_id").withColumn("url", F.when(fx_missing(), missing).otherwise(F.col("url")))
    found = requests.fetch_captured(tasks, pages.unionByName(older))
    return found.select("job_id", "page_id", F.length("html").cast("long").alias("chars"))


def fx_missing():
    """Tasks whose page was never captured: every ninth slot of ten minutes."""
    slot = (F.unix_timestamp(F.col("enqueued_at").cast("timestamp")) - 1704067200) / 600
    return slot.cast("long") % 9 == 0


CLASS = "case when status is null then 'transport_error' when status>=400 then 'http_error' else 'ok' end"


@check("attempt_class", f"""
select job, attempt_id, {CLASS} as outcome, {CLASS}<>'ok' as retryable from fx_attempts""")
def attempt_class(fx: Inputs) -> DataFrame:
    return attempts.classify(fx.view("fx_attempts")).select("job", "attempt_id", "outcome", "retryable")


@check("attempt_class_json", f"""
select outcome, count(*) as n from (
 select case when {CLASS}='ok' and not json_valid(s.payload) then 'bad_json' else {CLASS} end as outcome
 from fx_attempts a join fx_stream s on s.msg_id=a.attempt_id) group by outcome""")
def attempt_class_json(fx: Inputs) -> DataFrame:
    bodies = fx.view("fx_stream").select(F.col("msg_id").alias("attempt_id"), "payload")
    made = fx.view("fx_attempts").drop("body").join(bodies, "attempt_id")
    return attempts.classify(made, "payload").groupBy("outcome").agg(F.count("*").alias("n"))


@check("resolve_attempts", f"""
with numbered as (select *, {CLASS} as outcome, row_number() over (partition by job order by attempt_id) as rn from fx_attempts),
per as (select job, count(*) as attempts, arg_min(attempt_id, attempt_id) filter (outcome='ok') as good,
 max(attempt_id) as last from numbered where rn<=3 group by job)
select p.job, p.attempts, case when good is not null then 'done' when p.attempts>=3 then 'failed' else 'open' end as state,
 a.attempt_id, a.outcome, a.status, a.error from per p join numbered a on a.attempt_id=coalesce(p.good,p.last)""")
def resolve_attempts(fx: Inputs) -> DataFrame:
    done = attempts.resolve_attempts(attempts.classify(fx.view("fx_attempts")), "job", "attempt_id")
    return done.select("job", "attempts", "state", "attempt_id", "outcome", "status", "error")


def _daily(fx: Inputs) -> DataFrame:
    """Attempts of one user on one day as a job of its own, so that many jobs have few attempts."""
    job = F.concat_ws("/", "job", F.date_format("attempt_at", "MM-dd"))
    return attempts.classify(fx.view("fx_attempts").withColumn("job", job))


DAILY = f"""
with per as (select concat(job,'/',strftime(attempt_at,'%m-%d')) as job, count(*) as attempts, max(attempt_at) as last_at,
 bool_or({CLASS}='ok') as good from fx_attempts group by 1)
"""


@check("due_retries", DAILY + """
select job, attempts, epoch_us(last_at) as last_at, epoch_us(last_at)+2000000 as due_at from per
where not good and attempts<3 and last_at + interval 2 seconds <= timestamp '2024-01-15 00:00:00'""")
def due_retries(fx: Inputs) -> DataFrame:
    daily = _daily(fx).withColumn("attempt_at", F.col("attempt_at").cast("timestamp"))
    due = attempts.due_retries(daily, "job", "attempt_at", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return due.select("job", "attempts", F.unix_micros("last_at").alias("last_at"), F.unix_micros("due_at").alias("due_at"))


@check("failed_queue", DAILY + """
select job, attempts, epoch_us(last_at) as last_at from per where not good and attempts>=3""")
def failed_queue(fx: Inputs) -> DataFrame:
    failed = attempts.failed_queue(_daily(fx), "job", "attempt_at")
    return failed.withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


@check("response_json", """
select msg_id, cast(json_extract_string(payload,'$.k') as bigint) as k from fx_stream where json_valid(payload)""")
def response_json(fx: Inputs) -> DataFrame:
    parsed, _ = requests.response_json(fx.view("fx_stream"), "payload")
    return parsed.select("msg_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@check("require_element", """
select page_id, case when contains(html,'<h1>') then length(html) end as with_h1, cast(null as bigint) as with_main from pages""")
def require_element(fx: Inputs) -> DataFrame:
    trees = html.parse_html(fx.table("pages").withColumn("page", F.col("html")), keep=("page",))
    h1 = html.require_element(trees, "page", "h1").withColumnRenamed("content", "h1")
    both = html.require_element(h1, "page", "main")
    return both.select("page_id", F.length("h1").cast("long").alias("with_h1"),
                       F.length("content").cast("long").alias("with_main"))
