"""Usage, cost, quota, audit, metrics and policy over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators import governance as g, tables as tb
from agentlake.plans.relations import ACTIVITY, PRICE_SQL, PRICES, USAGE, activity, table, usage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _prices(spark):
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


COSTED = f"{USAGE}, {PRICE_SQL}, costed as (select u.*, input_tokens / 1e6::double * coalesce(price_in, 0) + output_tokens / 1e6::double * coalesce(price_out, 0) as cost from usage u left join prices p on p.model = split_part(u.model, '/', 2))"


def _costed(spark, d):
    return g.with_cost(usage(spark, d), _prices(spark))


@query(f"with {COSTED} select event_id, round(cost, 9) as cost from costed")
def usage_cost(spark, d):
    return _costed(spark, d).select("event_id", F.round("cost", 9).alias("cost"))


@query("with p as (select model, price_in, price_out from (values ('m0', 2.0::double, 6.0::double), ('m1', 0.5::double, 1.5::double), ('m2', 10.0::double, 30.0::double), ('m3', 0.25::double, 1.0::double)) t(model, price_in, price_out)), o as (select 'm' || (s_suppkey % 7) as model, min(s_acctbal) as price_in, case when (s_suppkey % 7) % 2 = 0 then max(s_acctbal) end as price_out from supplier group by s_suppkey % 7), w as (select * from o where price_in is not null and price_out is not null) select * from p where model not in (select model from w) union all select * from w")
def price_overrides(spark, d):
    k = F.col("s_suppkey") % 7
    o = table(spark, d, "supplier").groupBy(k.alias("k")).agg(F.min("s_acctbal").alias("price_in"), F.max("s_acctbal").alias("most"))
    overrides = o.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), "price_in", F.when(F.col("k") % 2 == 0, F.col("most")).alias("price_out"))
    return g.price_table(_prices(spark), overrides)


MONTHLY = "select user_id, month, model, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) as calls, round_even(sum(cost), 4) as cost from costed group by all"


@query(f"with {COSTED}, per as ({MONTHLY}), total as (select user_id, month, round(sum(cost), 4) as total_cost, sum(input_tokens + output_tokens)::bigint as total_tokens from per group by all) select * from per join total using (user_id, month)")
def usage_monthly(spark, d):
    return g.usage_monthly(_costed(spark, d))


@query(f"with {COSTED} select month, user_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) as calls, round_even(sum(cost), 4) as cost from costed group by all")
def usage_by_user(spark, d):
    return g.usage_by_user(_costed(spark, d))


@query(f"with {USAGE}, calendar as (select distinct strftime(o_orderdate, '2024-01-%d') as day from orders), days as (select day, sum(input_tokens)::bigint as i, sum(output_tokens)::bigint as o, count(*) as c from usage group by 1) select day, coalesce(i, 0) as input_tokens, coalesce(o, 0) as output_tokens, coalesce(c, 0) as calls from calendar left join days using (day)")
def usage_daily(spark, d):
    calendar = table(spark, d, "orders").select(F.date_format("o_orderdate", "'2024-01-'dd").alias("day")).distinct()
    return g.usage_daily(usage(spark, d), calendar)


@query(f"with {USAGE}, users as (select distinct user_id, case when user_id % 4 = 0 then 0 else user_id * 100 end as quota from events), used as (select user_id, month, sum(input_tokens + output_tokens)::bigint as used from usage group by all) select user_id, month, used, case when quota > 0 then quota else 1000000 end::bigint as quota, used < case when quota > 0 then quota else 1000000 end as allowed from used join users using (user_id)")
def quota_status(spark, d):
    users = table(spark, d, "events").select("user_id").distinct().withColumn("quota", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("user_id") * 100))
    return g.quota_status(usage(spark, d), users)


@query(f"with {USAGE}, running as (select *, sum(input_tokens + output_tokens) over (partition by user_id, month order by ts, event_id rows unbounded preceding)::bigint as used from usage) select user_id, month, event_id, used from running where used >= 500 and used - input_tokens - output_tokens < 500")
def quota_crossings(spark, d):
    return g.quota_crossings(usage(spark, d), 500)


CALLS = f"{ACTIVITY}, calls as (select *, event_type as tool, value as latency from activity where event = 'tool_call')"


def _calls(spark, d):
    return activity(spark, d).where("event = 'tool_call'").withColumns({"tool": F.col("event_type"), "latency": F.col("value")})


@query(f"with {CALLS} select run_id, count(*) as calls, count(*) filter (where not ok) as errors, round(avg(latency), 6) as mean_latency from calls group by 1")
def tool_stats_by_run(spark, d):
    return g.tool_stats(_calls(spark, d), ("run_id",))


@query(f"with {CALLS} select tool, ok, count(*) as calls, count(*) filter (where not ok) as errors, round(avg(latency), 6) as mean_latency from calls group by all")
def tool_stats_by_tool(spark, d):
    return g.tool_stats(_calls(spark, d), ("tool", "ok"))


@query(f"with {ACTIVITY}, bounds as (select * from (values (0.5::double, '0.5'), (1.0::double, '1.0'), (2.0::double, '2.0'), (5.0::double, '5.0'), (10.0::double, '10.0'), (30.0::double, '30.0'), (60.0::double, '60.0'), (120.0::double, '120.0'), (300.0::double, '300.0'), (600.0::double, '600.0'), ('infinity'::double, '+Inf')) t(b, le)) select event_type, le, count(*) filter (where value <= b) as count, round(sum(value), 4) as sum from activity cross join bounds where value is not null group by all")
def run_histogram(spark, d):
    return g.histogram(activity(spark, d), "value", g.RUN_BOUNDS, ("event_type",))


@query(f"with {ACTIVITY} select event, event_type, count(*) as n from activity group by all")
def counters(spark, d):
    return g.counters(activity(spark, d), ("event", "event_type"))


@query(f'with {ACTIVITY}, near as (select event_type as "from", lead(event_type) over (partition by user_id order by ts, event_id) as "to" from activity) select "from", "to", count(*) as n from near where "to" is not null and "to" <> "from" group by all')
def fallback_transitions(spark, d):
    return g.transitions(activity(spark, d), "user_id", "event_type", "ts", "event_id")


PLACED = f"{ACTIVITY}, placed as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as place, count(*) over (partition by event_type) as n from activity where value is not null)"


@query(f"with {PLACED} select event_type, p, value from placed, (values (0.1::double), (0.5::double), (0.9::double), (0.99::double)) t(p) where place = least(n - 1, floor(n * p)::bigint)")
def rank_percentiles(spark, d):
    return g.rank_percentiles(activity(spark, d), "value", "event_type", (0.1, 0.5, 0.9, 0.99))


@query(f"with {PLACED} select event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as max, max(value) filter (where place = least(n - 1, floor(n * 0.5::double)::bigint)) as p50, max(value) filter (where place = least(n - 1, floor(n * 0.95::double)::bigint)) as p95, max(value) filter (where place = least(n - 1, floor(n * 0.99::double)::bigint)) as p99 from placed group by event_type".replace("count(*) as n, round", "count(*) as n_rows, round"))
def latency_report(spark, d):
    return g.latency_report(activity(spark, d), "value", "event_type").withColumnRenamed("n", "n_rows")


@query(f"with {ACTIVITY} select event_type, (user_id % 3 + 200) as code, count(*) as n from activity group by all")
def status_counts(spark, d):
    return g.status_counts(activity(spark, d).withColumn("code", F.col("user_id") % 3 + 200), "event_type", "code")


@query("select c_custkey as user_id, c_name from customer order by 1 limit 200")
def first_users(spark, d):
    """A listing of 200."""
    return tb.first_users(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"))


@query(f"with {ACTIVITY} select event_id, day from activity where day is null or day::date >= date '2024-01-30' - interval 7 day")
def audit_retention(spark, d):
    return g.retained(activity(spark, d), 7, "2024-01-30").select("event_id", "day")


@query(f"with {ACTIVITY} select event_id, day, user_id from activity where event_type = 'error' order by ts desc, event_id desc limit 500")
def audit_newest(spark, d):
    return g.audit_query(activity(spark, d), 1000, event_type="error").select("event_id", "day", "user_id")


@query(f"with {ACTIVITY} select event_id, substr('login', 1, 16) as action, substr('user-' || user_id, 1, 64) as username, substr(coalesce(props, ''), 1, 45) as ip, substr(coalesce(props, ''), 1, 200) as ua, substr(coalesce(case when not ok then repeat(event_type, 9) end, ''), 1, 32) as reason, substr(repeat(event_type, 99), 1, 400) as result_preview from activity")
def audit_columns(spark, d):
    rows = activity(spark, d).select("event_id", F.lit("login").alias("action"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"), F.col("props").alias("ip"), F.col("props").alias("ua"), F.when(~F.col("ok"), F.repeat("event_type", 9)).alias("reason"), F.repeat("event_type", 99).alias("result_preview"))
    return g.audit_columns(rows)


@query(f"with {ACTIVITY}, a as (select ts, event, user_id, case when event = 'tool_call' then event_type end as tool from activity where event_id % 3 <> 0), b as (select ts, event, user_id, case when event = 'tool_call' then event_type end as tool from activity where event_id % 2 = 0 or event_id % 3 = 0) select event, user_id, tool, count(*) as n from (select * from a union all select * from b where not exists (select 1 from a where a.ts is not distinct from b.ts and a.event is not distinct from b.event and a.user_id is not distinct from b.user_id and a.tool is not distinct from b.tool)) group by all")
def merge_audit(spark, d):
    """Two stores that share a part of all events."""
    rows = activity(spark, d).withColumn("tool", F.when(F.col("event") == "tool_call", F.col("event_type")))
    copy = lambda c: rows.where(c).select("ts", "event", "user_id", "tool")
    return g.merge_audit(copy("event_id % 3 <> 0"), copy("event_id % 2 = 0 or event_id % 3 = 0")).groupBy("event", "user_id", "tool").agg(F.count(F.lit(1)).alias("n"))


POLICY = {"deny_tools": ("signup",), "deny_capabilities": ("network",), "allow_capabilities": ("read", "write"), "deny_commands": (r"rm\s+-rf",), "path_sandbox": True}


@query("""with calls as (select event_id, case when event_type = 'click' then 'bash' else event_type end as tool, [['read'], ['read', 'write'], ['network'], [], ['read', 'admin']][event_id % 5 + 1]::varchar[] as capabilities,
  case when event_id % 10 = 1 then 'rm  -rf x' else 'ls' end as command, ['/work/u/a/../b', 'x/y', '/etc/passwd', '../up', '/work/u'][event_id % 7 % 5 + 1] as path from events)
select event_id, case when tool = 'signup' then 'tool' when list_contains(capabilities, 'network') then 'capability' when len(capabilities) = 0 then 'no capabilities' when list_contains(capabilities, 'admin') then 'allow list'
  when tool = 'bash' and regexp_matches(command, 'rm\\s+-rf') then 'command' when path in ('/etc/passwd', '../up') then 'path' end as reason from calls""")
def policy_decisions(spark, d):
    e = table(spark, d, "events")
    pick = lambda xs, i: F.element_at(F.array(*xs), (i + 1).cast("int"))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    calls = e.select(
        "event_id", F.when(F.col("event_type") == "click", "bash").otherwise(F.col("event_type")).alias("tool"),
        pick([strings(x) for x in (("read",), ("read", "write"), ("network",), (), ("read", "admin"))], F.col("event_id") % 5).alias("capabilities"),
        F.when(F.col("event_id") % 10 == 1, "rm  -rf x").otherwise("ls").alias("command"),
        F.array(pick([F.lit(x) for x in ("/work/u/a/../b", "x/y", "/etc/passwd", "../up", "/work/u")], F.col("event_id") % 7 % 5)).alias("paths"), F.lit("/work/u").alias("cwd"),
    )
    return g.evaluate_policy(calls, POLICY).select("event_id", "reason")


@query("""with recursive ordered as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
chain as (select user_id, event_id, us, i, us as start, 1 as place from ordered where i = 1
  union all select o.user_id, o.event_id, o.us, o.i, case when o.us - c.start >= 86400000000 then o.us else c.start end, case when o.us - c.start >= 86400000000 then 1 else c.place + 1 end from chain c join ordered o on o.user_id = c.user_id and o.i = c.i + 1)
select user_id, event_id, start, place::bigint as place, place <= 3 as allowed from chain""")
def rate_windows(spark, d):
    """Windows of a day, as the events are sparse."""
    return g.rate_windows(activity(spark, d), 86_400.0, 3)


@query("with docs as (select o_orderkey as doc, case o_orderstatus when 'P' then 'pending' when 'O' then 'ready' else 'pending' end as status, o_orderdate as updated from orders) select case when status = 'pending' and epoch(timestamp '1998-01-01') - epoch(updated) > 86400 * 1000 then 'failed' else status end as status, count(*) as n from docs group by 1")
def stale_sweep(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated"))
    return g.stale_to_failed(docs, "1998-01-01", 86_400 * 1000).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ACTIVITY} select count(distinct user_id) as users, count(distinct run_id) as sessions from activity")
def fleet_counts(spark, d):
    return activity(spark, d).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("run_id").alias("sessions"))


BEFORE, AFTER = "o_orderkey % 10 <> 0", "o_orderkey % 10 <> 1"


@query("with b as (select o_orderkey as key, md5(o_comment) as hash from orders where o_orderkey % 10 <> 0), a as (select o_orderkey as key, md5(case when o_orderkey % 10 = 2 then o_comment || '!' else o_comment end) as hash from orders where o_orderkey % 10 <> 1) select key, case when b.hash is null then 'added' when a.hash is null then 'deleted' when a.hash = b.hash then 'unchanged' else 'modified' end as change from b full join a using (key)".replace("o_comment", "o_orderpriority"))
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    before = o.where(BEFORE).select(F.col("o_orderkey").alias("key"), F.md5("o_orderpriority").alias("hash"))
    changed = F.when(F.col("o_orderkey") % 10 == 2, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    return tb.snapshot_diff(before, o.where(AFTER).select(F.col("o_orderkey").alias("key"), F.md5(changed).alias("hash")))


@query("""select event_id, case when event_type = 'view' then '/w/' || user_id when event_type = 'click' then 'a"b|/k/' || regexp_extract(props, '[0-9]+') || '|/w/' || user_id || '|/e' else '' end as paths from events""")
def path_args(spark, d):
    """A file tool's path, nested arguments of another tool around the row's own props, with quotes inside and an escaped key, and no JSON."""
    path, own = F.concat(F.lit("/w/"), F.col("user_id").cast("string")), F.concat(F.lit('{"dir":"/k/'), F.get_json_object("props", "$.k"), F.lit('"}'))
    single = F.concat(F.lit('{"x":{"file":"no"}, "path":"'), path, F.lit('","k":'), F.col("props"), F.lit("}"))
    nested = F.concat(F.lit('{"a": [{"file":"'), path, F.lit(r'","b":{"dir":"a\"b", "k":'), own, F.lit(r'},"url":"u","c":"\"path\":\"z\"","p\u0061th":"/e"}]}'))
    kind = F.col("event_type")
    text = F.when(kind == "view", single).when(kind == "click", nested).otherwise(F.concat(F.lit('{"path":"/broken", '), F.col("props")))
    return table(spark, d, "events").select("event_id", F.array_join(g.path_args(F.when(kind == "view", "read").otherwise("mcp"), text), "|").alias("paths"))


@query(f"with {ACTIVITY}, s as (select run_id, max(ts) as at_, count(*) as n from activity group by 1) select run_id, n from s order by at_ desc, run_id desc limit 50")
def newest_sessions(spark, d):
    """A listing of 50."""
    s = activity(spark, d).groupBy("run_id").agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
    return tb.newest(s, 50, "at", "run_id").select("run_id", "n")
