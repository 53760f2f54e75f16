"""Usage, cost, quota, audit, metrics, policy and rate windows over whole event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.functions import scoring
from agentlake.functions.text import canonical_json
from agentlake.sources.staging import discard, staged

DEFAULT_QUOTA = 1_000_000
# Upper bounds of the histograms of run seconds, call seconds and counts.
RUN_BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
CALL_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
COUNT_BOUNDS = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 40.0)
LABELS = ("status", "model", "direction", "outcome", "route", "tool", "event_type", "event")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost by the model's name without its provider; unknown models cost nothing."""
    named = usage.withColumn("bare", F.substring_index("model", "/", -1))
    p = prices.select(F.col("model").alias("bare"), "price_in", "price_out")
    return named.join(p, "bare", "left").withColumn("cost", scoring.cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"))).drop("bare", "price_in", "price_out")


def price_table(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides win where both of their prices are there."""
    whole = overrides.where("price_in is not null and price_out is not null")
    return base.join(whole, "model", "left_anti").unionByName(whole)


def usage_monthly(costed: DataFrame) -> DataFrame:
    """By user, month and model, with the user's month in all; totals add up the costs as rounded per model."""
    per = costed.groupBy("user_id", "month", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"), F.bround(F.sum("cost"), 4).alias("cost"))
    total = per.groupBy("user_id", "month").agg(F.sum("cost").alias("total_cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))
    return per.join(total.withColumn("total_cost", F.round("total_cost", 4)), ["user_id", "month"])


def usage_by_user(costed: DataFrame) -> DataFrame:
    return costed.groupBy("month", "user_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"), F.bround(F.sum("cost"), 4).alias("cost"))


def usage_daily(usage: DataFrame, calendar: DataFrame) -> DataFrame:
    """Totals of each day of the calendar, 0 where nothing happened."""
    days = usage.groupBy("day").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))
    return calendar.join(days, "day", "left").fillna(0, ["input_tokens", "output_tokens", "calls"])


def quota_status(usage: DataFrame, users: DataFrame) -> DataFrame:
    """used, quota and allowed (strictly below) of each user and month; a quota of 0 or less is the default."""
    used = usage.groupBy("user_id", "month").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("used"))
    quota = F.when(F.coalesce("quota", F.lit(0)) > 0, F.col("quota")).otherwise(DEFAULT_QUOTA).cast("long")
    return used.join(users.select("user_id", quota.alias("quota")), "user_id").withColumn("allowed", F.col("used") < F.col("quota"))


def quota_crossings(usage: DataFrame, quota: int) -> DataFrame:
    """The event of each user and month that first reaches the quota."""
    w = Window.partitionBy("user_id", "month").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("input_tokens") + F.col("output_tokens")
    running = usage.withColumn("used", F.sum(tokens).over(w)).withColumn("before", F.col("used") - tokens)
    return running.where((F.col("used") >= quota) & (F.col("before") < quota)).select("user_id", "month", "event_id", "used")


def tool_stats(calls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg("latency"), 6).alias("mean_latency"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: tuple[str, ...]) -> DataFrame:
    """Cumulative buckets: one row per group and bound, +Inf at the end, with the group's sum.

    Each row is counted in its own bucket before the shuffle; running sums over the few buckets make them cumulative.
    """
    edges = F.array(*map(F.lit, bounds))
    first = F.size(F.filter(edges, lambda e: e < F.col(value)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, first.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    groups = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sum("s").alias("sum"))
    rows = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    upto = F.aggregate(F.sequence(F.lit(0), F.col("at")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.try_element_at("m", i), F.lit(0)))
    le = F.when(F.col("at") < len(bounds), F.try_element_at(edges, F.col("at") + 1).cast("string")).otherwise("+Inf")
    return rows.select(*by, le.alias("le"), upto.alias("count"), F.round("sum", 4).alias("sum"))


def counters(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts by bounded labels; identities are not labels."""
    if bad := set(by) - set(LABELS):
        raise ValueError(f"not a bounded label: {sorted(bad)}")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def transitions(df: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """How often a key's state is followed by another one."""
    later = df.withColumn("to", F.lead(state).over(Window.partitionBy(key).orderBy(*order)))
    return later.where(F.col("to").isNotNull() & (F.col("to") != F.col(state))).groupBy(F.col(state).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))


def rank_percentiles(df: DataFrame, value: str, by: str, shares: tuple[float, ...], ranges: int = 256, count: str | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at place min(n - 1, int(n p)), exact; with ``count``, a row stands for so many.

    Equal values are counted first.  Approximate quantiles cut each group into ``ranges``, whose counts tell which range
    holds a place; only the values of that range are sorted, so no group is sorted as a whole.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(by, value).agg((F.sum(count) if count else F.count(F.lit(1))).alias("c")))
    edges = counts.groupBy(by).agg(F.array_distinct(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 4 * ranges)).alias("edges"))
    ranged = counts.join(edges, by).withColumn("range", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    w = Window.partitionBy(by)
    sums = ranged.groupBy(by, "range").agg(F.sum("c").alias("own")).withColumn("upto", F.sum("own").over(w.orderBy("range"))).withColumn("n", F.sum("own").over(w))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("p")))
    asked = sums.withColumn("p", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", place).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("own")))
    inside = ranged.join(asked.select(by, "range", "p", (F.col("place") - F.col("upto") + F.col("own")).alias("place")), [by, "range"])
    until = F.sum("c").over(Window.partitionBy(by, "p").orderBy(value))
    return inside.withColumn("until", until).where((F.col("place") < F.col("until")) & (F.col("place") >= F.col("until") - F.col("c"))).select(by, "p", F.col(value).alias("value"))


def latency_report(df: DataFrame, value: str, by: str) -> DataFrame:
    p = rank_percentiles(df, value, by, (0.5, 0.95, 0.99)).groupBy(by).agg(*(F.max(F.when(F.abs(F.col("p") - s) < 1e-9, F.col("value"))).alias(n) for s, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max")).join(p, by)


def status_counts(df: DataFrame, by: str, status: str) -> DataFrame:
    """The report's other half: how often each status came."""
    return df.groupBy(by, status).agg(F.count(F.lit(1)).alias("n"))


def retained(df: DataFrame, days: int, as_of: str, day: str = "day") -> DataFrame:
    """Rows of the last ``days`` days; 0 keeps all, and rows without a day stay."""
    return df if days <= 0 else df.where(F.col(day).isNull() | (F.to_date(day) >= F.date_sub(F.lit(as_of).cast("date"), days)))


def audit_query(audit: DataFrame, limit: int, **equal: str) -> DataFrame:
    """Newest first, at most 500 rows: a report, so the limit is the feature."""
    for column, value in equal.items():
        audit = audit.where(F.col(column) == value)
    return audit.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(min(limit, 500))


def audit_columns(rows: DataFrame) -> DataFrame:
    """Fields of a sign-in record cut to their widths, missing ones empty."""
    # The widths of the stored columns.
    widths = (("action", 16), ("username", 64), ("ip", 45), ("ua", 200), ("reason", 32), ("result_preview", 400))
    return rows.select("event_id", *(F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in widths))


def merge_audit(primary: DataFrame, secondary: DataFrame, key: tuple[str, ...] = ("ts", "event", "user_id", "tool")) -> DataFrame:
    """The primary copy, and what only the secondary one has; null keys are equal."""
    same = [primary[c].eqNullSafe(secondary[c]) for c in key]
    return primary.unionByName(secondary.join(primary, same, "left_anti"))


def evaluate_policy(calls: DataFrame, policy: dict) -> DataFrame:
    """allowed and the first reason: denied tool, denied capability, not on the allow-list, command, path.

    calls has tool, capabilities, command, paths, cwd; paths are resolved by name only.
    """
    tools, deny, allow, patterns = policy.get("deny_tools", ()), policy.get("deny_capabilities", ()), policy.get("allow_capabilities", ()), policy.get("deny_commands", ())
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    caps = F.coalesce("capabilities", F.array().cast("array<string>"))
    reason: Column = F.when(F.array_contains(strings(tools), F.col("tool")), "tool").when(F.arrays_overlap(caps, strings(deny)), "capability")
    if allow:
        reason = reason.when(F.size(caps) == 0, "no capabilities").when(F.size(F.array_except(caps, strings(allow))) > 0, "allow list")
    for pattern in patterns:
        reason = reason.when((F.col("tool") == "bash") & F.regexp_like(F.coalesce("command", F.lit("")), F.lit(pattern)), "command")
    if policy.get("path_sandbox"):
        base = normal_path(F.col("cwd"))
        whole = lambda p: normal_path(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.col("cwd"), F.lit("/"), p)))
        inside = lambda p: (whole(p) == base) | F.startswith(whole(p), F.concat(base, F.lit("/")))
        reason = reason.when(F.exists(F.coalesce("paths", F.array().cast("array<string>")), lambda p: ~inside(p)), "path")
    return calls.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


# Argument names that hold paths, and tools whose one path is their ``path`` argument.
PATH_KEYS = ("path", "file", "dir")
FILE_TOOLS = ("read", "write", "edit", "ls", "find", "grep")


def path_args(tool: Column, arguments: Column) -> Column:
    """Path-like values of a call's JSON arguments: strings under path, file or dir at any depth; of file tools, ``path`` alone.

    They are read from the canonical text, in the order of its sorted keys: there a quote begins or ends a string unless a
    backslash stands before it, and no key hides behind escapes.  Arguments that are no JSON have none.
    """
    whole = canonical_json(arguments)
    pair = rf'(?<!\\)"(?:{"|".join(PATH_KEYS)})":("(?:[^"\\]|\\.)++")'
    deep = F.transform(F.regexp_extract_all(F.coalesce(whole, F.lit("")), F.lit(pair), F.lit(1)), lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))
    own = F.get_json_object(whole, "$.path")
    return F.when(tool.isin(*FILE_TOOLS), F.array_compact(F.array(F.when(~own.isin("", "0", "false", "[]", "{}"), own)))).otherwise(deep)


def normal_path(path: Column) -> Column:
    """An absolute path without ., .. and empty parts."""
    empty = F.array().cast("array<string>")
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


#: Times of an island whose windows are found by one fold; longer islands go by jump pointers.
FOLD = 256


def rate_windows(events: DataFrame, seconds: float = 60.0, limit: int = 20, fold: int = FOLD) -> DataFrame:
    """Each event's window, anchored at the first event that the window before doesn't reach, its place there, and allowed.

    A gap of a window or more always opens a window, so such gaps part a user's times into islands that know nothing of each
    other.  Starts are a window or more apart: each cell of that length of a user has one at most, and an event's start lies
    in its cell or the one before.  So no user needs to stand in one task: gaps, starts and places are found per cell and joined.
    Where an island begins is handed on from cell to cell by one row per cell.  Times of a short island are folded into its starts in an
    expression; those of long ones point to the first time that is a window later, and pointers are doubled until all starts
    are reached.  Events of no user, or no time, have no window and are left out.
    """
    width = int(seconds * 1e6)
    rows = events.where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros("ts").alias("us")).withColumn("cell", F.floor(F.col("us") / width))
    rows = staged(rows)
    times = rows.select("user_id", "cell", "us").distinct()
    cells = times.groupBy("user_id", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    walk = Window.partitionBy("user_id").orderBy("cell")
    # One row per cell: whether its first time opens an island, and if not, where the island began is known further back.
    opened = F.coalesce(F.col("first") - F.lag("last").over(walk) >= width, F.lit(True))
    heads = cells.withColumn("opens", opened).withColumn("head", F.last(F.when(F.col("opens"), F.col("first")), True).over(walk))
    # Inside a cell no gap reaches a window, so all times of a cell share its island.
    islands = times.join(heads.select("user_id", "cell", "head"), ["user_id", "cell"])
    sizes = islands.groupBy("user_id", "head").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("end"))
    single = sizes.where(F.col("end") - F.col("head") < width).select("user_id", F.col("head").alias("start"))
    several = staged(islands.join(sizes.where(F.col("end") - F.col("head") >= width), ["user_id", "head"]))
    short = several.where(F.col("n") <= fold).groupBy("user_id", "head").agg(F.array_sort(F.collect_list("us")).alias("times"))
    step = lambda starts, us: F.when(us - F.element_at(starts, -1) >= width, F.concat(starts, F.array(us))).otherwise(starts)
    folded = short.select("user_id", F.explode(F.aggregate("times", F.array(F.col("head")), step)).alias("start"))
    starts = single.unionByName(folded).unionByName(_jumped(several.where(F.col("n") > fold), width))
    placed = starts.withColumn("cell", F.floor(F.col("start") / width))
    near = placed.select("user_id", "cell", F.col("start").alias("own")), placed.select("user_id", (F.col("cell") + 1).alias("cell"), F.col("start").alias("before"))
    found = rows.join(near[0], ["user_id", "cell"], "left").join(near[1], ["user_id", "cell"], "left")
    found = found.withColumn("start", F.when(F.col("own") <= F.col("us"), F.col("own")).otherwise(F.col("before")))
    place = F.row_number().over(Window.partitionBy("user_id", "start").orderBy("us", "event_id"))
    return found.select("user_id", "event_id", "start", place.cast("long").alias("place")).withColumn("allowed", F.col("place") <= limit)


def _jumped(times: DataFrame, width: int) -> DataFrame:
    """user_id, start: the window starts of islands, from their times (user_id, cell, us, head, end), by doubled pointers."""
    longest = times.agg(F.max(F.col("end") - F.col("head"))).first()[0]
    if longest is None:
        return times.select("user_id", F.col("us").alias("start")).limit(0)
    # The first time at or after us + width lies in the next cell, or is the first of the one behind it.
    probes = times.select("user_id", "head", (F.col("cell") + 1).alias("cell"), F.col("us").alias("probe"), (F.col("us") + width).alias("at"), F.lit(0).alias("kind"))
    seen = times.select("user_id", "head", "cell", F.lit(None).cast("long").alias("probe"), F.col("us").alias("at"), F.lit(1).alias("kind"))
    later = F.last(F.when(F.col("kind") == 1, F.col("at")), True).over(Window.partitionBy("user_id", "cell", "head").orderBy(F.desc("at"), F.desc("kind")))
    firsts = times.groupBy("user_id", "head", (F.col("cell") - 1).alias("cell")).agg(F.min("us").alias("behind"))
    to = probes.unionByName(seen).withColumn("later", later).where("kind = 0").join(firsts, ["user_id", "head", "cell"], "left")
    jumps = staged(to.select("user_id", F.col("probe").alias("us"), F.coalesce("later", "behind").alias("to")).where("to is not null"))
    reached = staged(times.select("user_id", F.col("head").alias("us")).distinct())
    rounds = max(1, int(longest // width).bit_length())
    for k in range(rounds):
        was, old = reached, jumps
        reached = staged(was.unionByName(was.join(old, ["user_id", "us"]).select("user_id", F.col("to").alias("us"))))
        if k < rounds - 1:
            further = old.select("user_id", F.col("us").alias("to"), F.col("to").alias("further"))
            jumps = staged(old.join(further, ["user_id", "to"]).select("user_id", "us", F.col("further").alias("to")))
        discard(was)
        discard(old)
    return reached.select("user_id", F.col("us").alias("start"))


def stale_to_failed(docs: DataFrame, now: str, seconds: int) -> DataFrame:
    """Documents pending for too long become failed."""
    late = (F.col("status") == "pending") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated") > seconds)
    return docs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))
