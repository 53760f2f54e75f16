"""Runs, training sets and memories over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from agentlake.functions import text as tx
from agentlake.operators import flywheel as fw, memory as m, retrieval as r, tables as tb, trajectory as t
from agentlake.plans.relations import ACTIVITY, activity, table
from agentlake.plans.retrieval import HASHED_OF
from agentlake.sources.staging import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# A user's day is a run; views are model calls, clicks and errors tool calls, a sign-up its start.
LOG = f"""{ACTIVITY}, log as (select event_id, run_id, user_id, ts, row_number() over (partition by run_id order by ts, event_id) as pos, case event_type when 'view' then 'LlmCall' when 'signup' then 'RunStarted' when 'purchase' then 'RunFinished' else 'ToolCall' end as type,
  floor(value)::bigint as input_tokens, floor(value / 2)::bigint as output_tokens, floor(value / 4)::bigint as cache_hit, floor(value)::bigint - floor(value / 4)::bigint as cache_miss, round(value / 100, 4) as cost, event_type = 'error' as denied, floor(value)::bigint as latency_ms, 'tool' || (event_id % 3) as name, event_type = 'error' as is_error,
  'c' || (event_id % 4) as call_id, coalesce(props, '') as props from activity)"""


def _log(spark, d):
    e = activity(spark, d)
    kind = F.when(F.col("event_type") == "view", "LlmCall").when(F.col("event_type") == "signup", "RunStarted").when(F.col("event_type") == "purchase", "RunFinished").otherwise("ToolCall")
    floor = lambda n: F.floor(F.col("value") / n)
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    name = lambda prefix, n: F.concat(F.lit(prefix), (F.col("event_id") % n).cast("string"))
    return e.select(
        "event_id", "run_id", "user_id", "ts", pos.alias("pos"), kind.alias("type"), floor(1).alias("input_tokens"), floor(2).alias("output_tokens"), floor(4).alias("cache_hit"), (floor(1) - floor(4)).alias("cache_miss"), F.round(F.col("value") / 100, 4).alias("cost"),
        (F.col("event_type") == "error").alias("denied"), floor(1).alias("latency_ms"), name("tool", 3).alias("name"), (F.col("event_type") == "error").alias("is_error"), name("c", 4).alias("call_id"), F.coalesce("props", F.lit("")).alias("props"),
    )


@query(f"with {LOG} select run_id, coalesce(sum(input_tokens) filter (where type = 'LlmCall'), 0)::bigint as input_tokens, coalesce(sum(output_tokens) filter (where type = 'LlmCall'), 0)::bigint as output_tokens, count(*) filter (where type = 'LlmCall') as turns, round(coalesce(sum(cache_hit) filter (where type = 'LlmCall') / nullif(sum(cache_hit + cache_miss) filter (where type = 'LlmCall'), 0)::double, 0), 6) as cache_hit_rate from log group by 1")
def run_totals(spark, d):
    return t.run_totals(_log(spark, d))


@query(f"with {LOG}, s as (select run_id, pos, round(sum(cost) over (partition by run_id order by pos rows unbounded preceding), 6) as spent from log) select run_id, min(pos) as pos, arg_min(spent, pos) as spent from s where spent > 0.5 group by 1")
def budget_cut(spark, d):
    return t.budget_cut(_log(spark, d), 0.5)


@query(f"with {LOG}, i as (select run_id, pos, denied, row_number() over (partition by run_id order by pos) - row_number() over (partition by run_id, denied order by pos) as island from log) select run_id, min(pos) as first, max(pos) as last, count(*) as length, count(*) >= 2 as alert from i where denied group by run_id, island")
def denial_streaks(spark, d):
    return t.denial_streaks(_log(spark, d), 2)


@query(f"with {LOG} select run_id, pos, coalesce(sum(greatest(latency_ms, 1)::double) over (partition by run_id order by pos rows between unbounded preceding and 1 preceding), 0) as start, greatest(latency_ms, 1)::double as width from log")
def timeline_duration(spark, d):
    return t.timeline(_log(spark, d), "duration")


@query(f"with {LOG} select run_id, pos, (epoch_us(ts) - first_value(epoch_us(ts)) over (partition by run_id order by pos)) / 1000::double as start, greatest(latency_ms, 1)::double as width from log")
def timeline_clock(spark, d):
    return t.timeline(_log(spark, d), "clock")


@query(f"with {LOG} select run_id, pos, (pos - 1)::double as start, 1.0::double as width from log")
def timeline_sequence(spark, d):
    return t.timeline(_log(spark, d), "sequence")


@query(f"with {LOG} select run_id, count(*) as n, md5(string_agg(case type when 'RunStarted' then 'user' when 'LlmCall' then 'assistant' else 'tool' end || ':' || props || ':' || case when type = 'ToolCall' then call_id else '' end, '|' order by pos)) as digest from log where type <> 'RunFinished' group by 1")
def run_messages(spark, d):
    messages = t.to_messages(_log(spark, d).withColumnRenamed("props", "text"))
    told = F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"], F.coalesce(x["tool_call_id"], F.lit("")))), "|")
    return messages.select("run_id", F.size("messages").cast("long").alias("n"), F.md5(told).alias("digest"))


@query(f"with {LOG}, asked as (select run_id, pos as asked_at, 'c' || (event_id % 4) as call_id from log where type = 'LlmCall') select l.run_id, l.pos, l.call_id, coalesce(asked_at, 0) as asked_at, asked_at is not null as matched from log l left join asked a using (run_id, call_id) where type = 'ToolCall'")
def paired_tool_calls(spark, d):
    return t.pair_tool_calls(_log(spark, d).withColumn("call_ids", F.array("call_id"))).fillna(0, ["asked_at"])


@query(f"""with {LOG}, typed as (select *, case (event_id // 3) % 3 when 0 then '1' when 1 then '"1"' else '1.0' end as v from log where type = 'ToolCall' and not denied and event_id % 7 <> 0 and event_id % 11 <> 0),
k as (select *, name || ':{{"a":true,"z":{{"a":' || v || ',"q":[{{"m":' || replace(props, ' ', '') || '}},null]}}}}' as key from typed)
select run_id, name, count(*) as entries, max(pos) as last, md5(string_agg(key, '|' order by key)) as digest from (select *, row_number() over (partition by run_id, key order by pos desc) as nth from k) where nth = 1 group by run_id, name""")
def tool_ledger(spark, d):
    """Every row's props three levels deep, beside a number, a string or a decimal that look alike, with keys in either order."""
    value = F.when(F.floor(F.col("event_id") / 3) % 3 == 0, "1").when(F.floor(F.col("event_id") / 3) % 3 == 1, '"1"').otherwise("1.0")
    one = F.concat(F.lit('{"z": {"q": [{"m":'), F.col("props"), F.lit('}, null], "a": '), value, F.lit('}, "\\u0061": true}'))
    other = F.concat(F.lit('{"a":true,"z":{"a":'), value, F.lit(',"q":[{"m":'), F.col("props"), F.lit("},null]}}"))
    log = _log(spark, d).withColumns({"arguments": F.when(F.floor(F.col("event_id") / 9) % 2 == 0, one).otherwise(other), "result": F.col("props"), "unknown": F.col("event_id") % 7 == 0, "crashed": F.col("event_id") % 11 == 0})
    keys = F.md5(F.array_join(F.array_sort(F.collect_list("key")), "|"))
    return t.tool_ledger(log).groupBy("run_id", F.substring_index("key", ":", 1).alias("name")).agg(F.count(F.lit(1)).alias("entries"), F.max("pos").alias("last"), keys.alias("digest"))


@query(f"with {LOG}, runs as (select run_id, user_id, min(ts) as created_at, 'm' || min(event_id) % 5 as model from log group by all), placed as (select *, row_number() over w as nth, first_value(model) over w as session_model from runs window w as (partition by user_id order by created_at, run_id)) select user_id as session_id, row_number() over (partition by user_id order by nth, pos) - 1 as spot, log.run_id, pos, session_model from log join placed using (run_id, user_id)")
def session_timeline(spark, d):
    log = _log(spark, d)
    runs = log.groupBy("run_id", F.col("user_id").alias("session_id")).agg(F.min("ts").alias("created_at"), F.concat(F.lit("m"), (F.min("event_id") % 5).cast("string")).alias("model"))
    return t.session_timeline(runs, log.select("run_id", "pos")).withColumnRenamed("at", "spot")


MESSAGES = "messages as (select conv_id as session_id, turn as idx, role, coalesce(text, '') as text from conversations)"


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("text"))


@query(f"with {MESSAGES}, p as (select *, row_number() over (partition by session_id order by idx) - 1 as spot, greatest(count(*) over (partition by session_id) - 3, 0) as start from messages) select session_id, coalesce(max(spot) filter (where spot <= start and role <> 'assistant'), 0)::bigint as cut, count(*) as n from p group by 1")
def compaction_cut(spark, d):
    """The last three messages, beginning with no answer."""
    return t.compaction_cut(_messages(spark, d), 3, "assistant")


COMPACTED = "compactions as (select session_id, idx as covered_upto_idx, idx as created_at, 'summary ' || idx as summary from messages where idx % 3 = 1 and session_id % 2 = 0)"


@query(f"with {MESSAGES}, {COMPACTED}, latest as (select * from compactions qualify row_number() over (partition by session_id order by created_at desc) = 1) select m.session_id, idx, role, md5(text) as digest from messages m left join latest using (session_id) where idx > coalesce(covered_upto_idx, -1) union all select session_id, -1, 'summary', md5(summary) from latest")
def session_context(spark, d):
    rows = _messages(spark, d)
    done = rows.where("idx % 3 = 1 and session_id % 2 = 0").select("session_id", F.col("idx").alias("covered_upto_idx"), F.col("idx").alias("created_at"), F.concat(F.lit("summary "), F.col("idx").cast("string")).alias("summary"))
    return t.session_context(rows, done).select("session_id", "idx", "role", F.md5("text").alias("digest"))


@query(f"with {MESSAGES} select session_id, max(idx) as idx, arg_max(role, idx) as role from messages group by 1")
def latest_message(spark, d):
    return tb.latest_by(_messages(spark, d), ("session_id",), "idx").select("session_id", "idx", "role")


@query(f"with {MESSAGES}, old as (select * from messages where idx < 2), had as (select session_id, count(*) as had from old group by 1) select session_id, idx as was, coalesce(had, 0) + row_number() over (partition by session_id order by idx) - 1 as idx from messages left join had using (session_id) where messages.idx >= 2")
def assign_idx(spark, d):
    rows = _messages(spark, d)
    new = rows.where("idx >= 2").select("session_id", F.col("idx").alias("was"))
    return tb.assign_idx(new, rows.where("idx < 2"), "session_id", "was")


@query("select conv_id, sum(length(coalesce(text, '')))::bigint as size, md5(string_agg('[' || role || '] ' || substr(coalesce(text, ''), 1, 2000), chr(10) order by turn)) as transcript from conversations group by 1")
def transcripts(spark, d):
    """Each turn is one text block of its message."""
    block = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("name"), F.lit("").alias("arguments"), F.lit("").alias("content"), F.lit("").alias("tool_use_id"), F.lit(False).alias("is_error"))
    one = table(spark, d, "conversations").select("conv_id", "turn", F.array(block).alias("blocks"), "role")
    told = one.select("conv_id", "turn", tx.conversation_size(F.col("blocks")).alias("size"), tx.transcript(F.col("role"), F.col("blocks")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return told.groupBy("conv_id").agg(F.sum("size").alias("size"), F.md5(F.array_join(lines, "\n")).alias("transcript"))


# A run is a sample; its tests are its events, and what failed are the errors; every fifth run was judged.
SAMPLES = f"""{LOG}, samples as (select run_id, min(event_id) as sample_no, any_value(user_id) % 40 as task_id, case when min(event_id) % 5 = 0 then 'judge' else 'tests' end as scorer, round_even(case when min(event_id) % 5 = 0 then case when min(event_id) % 10 = 0 then 1.0::double else 0.5::double end else count(*) filter (where not is_error) / count(*)::double end, 4) as reward,
  count(*) filter (where type = 'ToolCall') as tool_calls, count(*) filter (where type = 'ToolCall' and is_error) as tool_errors, count(*) as total, string_agg(type || name || is_error, ',' order by pos) as content from log group by run_id),
once as (select * from samples qualify row_number() over (partition by task_id, content order by sample_no) = 1), clean as (select *, reward >= 1 and tool_errors > 0 as recovered from once where reward >= 1 or (tool_calls > 0 and tool_errors < tool_calls)),
chosen as (select *, row_number() over (partition by task_id, recovered order by case when recovered then 0 else -reward end, sample_no) as nth from clean), kept as (select *, row_number() over (partition by task_id order by recovered desc, nth) as place from chosen where recovered or nth <= 2 qualify row_number() over (partition by task_id order by recovered desc, nth) <= 4)"""


def _samples(spark, d):
    log = _log(spark, d)
    events = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "name", "is_error", "latency_ms"))), lambda e: e.dropFields("pos"))
    s = log.groupBy("run_id").agg(F.min("event_id").alias("sample_no"), (F.first("user_id") % 40).alias("task_id"), F.min("ts").alias("started_at"), F.count_if(~F.col("is_error")).alias("passed_count"), F.count(F.lit(1)).alias("total_count"), events.alias("events"))
    judged = F.col("sample_no") % 5 == 0
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("run_id").alias("content")))
    return s.withColumns({"trajectory": F.struct("run_id", "started_at", "events"), "scorer": F.when(judged, "judge").otherwise("tests"), "score": F.when(F.col("sample_no") % 10 == 0, 1.0).otherwise(0.5), "passed": F.col("passed_count") == F.col("total_count"), "messages": message})


@query(f"with {SAMPLES} select sample_no, scorer, reward, tool_calls, tool_errors from samples")
def rewards(spark, d):
    return fw.with_tool_counts(fw.with_reward(_samples(spark, d))).select("sample_no", "scorer", "reward", F.col("tool_calls").cast("long").alias("tool_calls"), F.col("tool_errors").cast("long").alias("tool_errors"))


@query(f"with {SAMPLES} select task_id, sample_no, reward, recovered, place from kept")
def rejection_sample(spark, d):
    return fw.build_training_sets(_samples(spark, d), "be brief")[0].select("task_id", "sample_no", "reward", "recovered", "place")


@query(f"""with {SAMPLES} select sample_no, '{{"messages":[{{"role":"system","content":"be brief"}},{{"role":"user","content":"' || run_id || '"}}]}}' as line from kept where reward >= 1""")
def export_sft(spark, d):
    return fw.build_training_sets(_samples(spark, d), "be brief")[1]["sft"]


@query(f"with {SAMPLES} select sample_no, task_id from kept where scorer <> 'judge'")
def export_rlvr(spark, d):
    return fw.build_training_sets(_samples(spark, d), "be brief")[1]["rlvr"].select("sample_no", F.get_json_object("line", "$.task_id").cast("long").alias("task_id"))


@query(f"with {SAMPLES} select sample_no, task_id from kept where scorer = 'judge'")
def export_judge(spark, d):
    return fw.build_training_sets(_samples(spark, d), "be brief")[1]["judge"].select("sample_no", F.get_json_object("line", "$.task_id").cast("long").alias("task_id"))


TASKS = "tasks as (select doc_id, source as category, quality = 1 as passed, toxic = 0 as calm from labels join documents using (doc_id))"
REPORT_SQL = "select category, count(*) as total, count(*) filter (where {0}) as passed, round(avg(({0})::int), 6) as rate from tasks group by grouping sets ((), (category))".format


def _tasks(spark, d, verdict):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("category")), "doc_id").withColumn("passed", verdict)


@query(f"with {TASKS} {REPORT_SQL('passed')}")
def pass_report(spark, d):
    return fw.pass_report(_tasks(spark, d, F.col("quality") == 1))


@query(f"with {TASKS}, a as ({REPORT_SQL('passed')}), b as ({REPORT_SQL('calm')}) select coalesce(a.category, 'all') as category, a.rate as rate_a, b.rate as rate_b, round(b.rate - a.rate, 6) as delta from a join b on a.category is not distinct from b.category")
def pass_delta(spark, d):
    return fw.pass_delta(*(fw.pass_report(_tasks(spark, d, v)) for v in (F.col("quality") == 1, F.col("toxic") == 0)))


MEMORIES = "memories as (select conv_id * 1000 + turn as id, conv_id % 7 as user_id, text, case when turn = 0 and conv_id % 5 = 0 then conv_id * 1000 + 1 end as superseded_by from conversations)"


def memories(spark, d):
    old = F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 == 0), F.col("conv_id") * 1000 + 1)
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 7).alias("user_id"), "text", old.alias("superseded_by"))


TERMS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'))".format


CLASSES = f"{MEMORIES}, s as (select user_id, id, list_sort({TERMS('text')}) as t from memories), m as (select user_id, id, t, min(id) over (partition by user_id, t) as class_id from s where len(t) > 0)"


@query(f"with {CLASSES} select user_id, id, class_id from m")
def memory_classes(spark, d):
    return m.memory_classes(memories(spark, d))


@query(f"with {CLASSES}, p as (select a.user_id, a.id as older, b.id as newer, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::double as score from m a join m b on a.user_id = b.user_id and a.id < b.id where a.id = a.class_id and b.id = b.class_id) select user_id, older, newer, round(score, 6) as score from p where score >= 0.25")
def jaccard_pairs(spark, d):
    """Pairs of classes of equal term sets; ``memory_classes`` has their members."""
    return m.jaccard_pairs(memories(spark, d), 0.25)


def written(threshold: float, cap: int) -> str:
    """SQL of the order-dependent write: a walk over each user's later turns."""
    return f"""with recursive {MEMORIES}, sets as (select user_id, id, {TERMS('text')} as t from memories),
near as (select b.user_id, b.id, list(a.id) as olds from sets a join sets b on a.user_id = b.user_id and a.id < b.id and len(a.t) > 0 and len(b.t) > 0 and b.id % 1000 >= 2 where len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::double >= {threshold} group by all),
later as (select m.user_id, m.id, coalesce(olds, []) as olds, row_number() over (partition by m.user_id order by m.id) as n from memories m join sets s on s.id = m.id left join near on near.id = m.id where m.id % 1000 >= 2 and len(s.t) > 0),
walk as (select user_id, 0 as n, list(id) filter (where id % 1000 < 2) as kept from memories group by 1 union all select w.user_id, l.n, case when list_has_any(kept, olds) then kept else list_append(kept, l.id) end from walk w join later l on l.user_id = w.user_id and l.n = w.n + 1),
ended as (select user_id, arg_max(kept, n) as kept from walk group by 1)
select id, user_id from (select user_id, unnest(kept) as id from ended) qualify row_number() over (partition by user_id order by id desc) <= {cap}"""


@query(written(0.25, 500))
def apply_memories(spark, d):
    """The order-dependent write of every later turn."""
    rows = memories(spark, d)
    return m.apply_memories(rows.where("id % 1000 < 2").withColumn("superseded_by", F.lit(None).cast("long")), rows.where("id % 1000 >= 2"), 500, 0.25).select("id", "user_id")


@query(f"with {MEMORIES} select id, user_id from memories qualify row_number() over (partition by user_id order by id desc) <= 20")
def memory_cap(spark, d):
    return m.enforce_cap(memories(spark, d), 20).select("id", "user_id")


@query(f"with {MEMORIES} select id, user_id, nth from (select id, user_id, row_number() over (partition by user_id order by id desc) as nth from memories where superseded_by is null) where nth <= 500")
def current_memories(spark, d):
    return m.current(memories(spark, d)).select("id", "user_id", "nth")


@query(f"with {MEMORIES} select id, coalesce(superseded_by, id) as latest, (superseded_by is not null)::int as steps from memories")
def memory_history(spark, d):
    return m.history(memories(spark, d))


def _asked(spark, d):
    """Every row whose id is divisible by 100, against all."""
    return table(spark, d, "conversations").where("(conv_id * 1000 + turn) % 100 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 7).alias("user_id"), "text", (F.col("conv_id") % 4 == 3).alias("embed_failed"))


ASKED = "asked as (select conv_id * 1000 + turn as query_id, conv_id % 7 as user_id, text, conv_id % 4 = 3 as embed_failed from conversations where (conv_id * 1000 + turn) % 100 = 0)"
RECALLED = f"{MEMORIES}, {ASKED}, scored as (select query_id, id, round(len(list_intersect({TERMS('a.text')}, {TERMS('m.text')})) / greatest(len({TERMS('a.text')}), 1)::double, 6) as score from asked a join memories m using (user_id) where superseded_by is null), ranked as (select *, row_number() over (partition by query_id order by score desc, id desc) as rank from scored where score > 0)"


@query(f"with {RECALLED} select query_id, id, score, rank from ranked where rank <= 3")
def lexical_recall(spark, d):
    return m.lexical_recall(_asked(spark, d), memories(spark, d))


def NEAR(asked: str) -> str:  # noqa: N802
    """The user's memories by the cosine of hashed vectors, for the questions that ``asked`` holds of."""
    return f"""{RECALLED}, {HASHED_OF("select 0 as kind, id, text from memories union all select 1, query_id, text from asked")},
products as (select q.id as query_id, v.id, sum(q.w * v.w) as score from unit q join unit v on q.kind = 1 and v.kind = 0 and q.bucket = v.bucket group by all),
near as (select a.query_id, m.id, row_number() over (partition by a.query_id order by round(coalesce(score, 0), 6) desc, m.id) as rank from asked a join memories m using (user_id) left join products p on p.query_id = a.query_id and p.id = m.id
  where {asked} and a.query_id in (select id from unit where kind = 1) and m.id in (select id from unit where kind = 0))"""


def _near(asked, rows, k):
    """(query_id, id, rank) by hashed vectors."""
    own = lambda df, key: staged(df.select(key, "user_id").join(r.hashed_embedding(df, key), key))
    return r.vector_topk(own(asked, "query_id"), own(rows, "id").withColumnRenamed("id", "chunk_id"), k).withColumnRenamed("chunk_id", "id")


@query(f"""with {NEAR("not embed_failed and a.query_id % 300 <> 0")}, vec as (select query_id, id, rank from near where rank <= 3 and id in (select id from memories where superseded_by is null))
select query_id, id, rank, 'vector_hit' as outcome from vec union all select a.query_id, coalesce(id, 0), coalesce(rank, 0), case when embed_failed then 'embed_failed' when id is not null then 'lexical_fallback' else 'no_hits' end from asked a left join (select * from ranked where rank <= 3) r using (query_id) where a.query_id not in (select query_id from vec)""")
def memory_recall(spark, d):
    """By vectors of hashed terms; every fourth conversation's questions could not be embedded, and every third question finds no vectors."""
    asked, rows = _asked(spark, d), memories(spark, d)
    hits = _near(asked.where("not embed_failed and query_id % 300 <> 0"), rows, 3)
    return m.recall(asked, rows, hits).fillna(0, ["id", "rank"])


PAIRED = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]') || list_transform(range(1, length(k)), lambda i: substr(k, i, 2)))"
KEPT = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\x{4e00}-\\x{9fff}]+', '', 'g') as k"


@query(f"with {MEMORIES} select id, user_id from memories where regexp_matches(lower(coalesce(text, '')), '[a-z0-9_]|[\\x{{4e00}}-\\x{{9fff}}]')")
def searchable_memories(spark, d):
    return m.has_terms(memories(spark, d)).select("id", "user_id")


@query(f"""with {MEMORIES}, {ASKED}, alive as (select * from memories where superseded_by is null), terms as (select user_id, id, unnest({PAIRED}) as term from (select *, {KEPT} from alive)),
n as (select user_id, count(*) as n from alive group by 1), df as (select user_id, term, count(*) as df from terms group by all), q as (select query_id, user_id, unnest({PAIRED}) as term from (select *, {KEPT} from asked)),
scored as (select query_id, id, round(sum(ln((n + 1) / (1 + df)::double)), 6) as score from q join terms using (user_id, term) join df using (user_id, term) join n using (user_id) group by all)
select query_id, id, score from scored where score > 0""")
def entity_recall(spark, d):
    return m.entity_scores(_asked(spark, d), memories(spark, d))


@query(f"with {NEAR('true')}, every as (select query_id, id, 0 as channel, rank from ranked where rank <= 8 union all select query_id, id, 1, rank from near where rank <= 8), once as (select query_id, id, min((channel, rank)) as spot from every group by all) select query_id, id, row_number() over (partition by query_id order by spot) as place from once qualify place <= 12")
def candidate_union(spark, d):
    """The best overlaps, then the nearest by hashed vectors."""
    asked, rows = _asked(spark, d), memories(spark, d)
    return m.candidate_union(m.lexical_recall(asked, rows, 8), _near(asked, rows, 8))
