"""Document preparation over documents and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.operators import chunks as ch, corpus as c, tables as tb
from agentlake.operators.retrieval import hashed_embedding
from agentlake.plans.relations import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _gated(spark, d):
    return _docs(spark, d).withColumns({"pages": F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 40 + 1), "scannable": F.col("doc_id") % 2 == 0})


BARE = r"'[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]'"
GATED = f"""d as (select doc_id, coalesce(text, '') as text, case when doc_id % 3 = 0 then doc_id % 40 + 1 end as pages, doc_id % 2 = 0 as scannable from documents),
m as (select *, len(regexp_extract_all(text, {BARE})) / greatest(length(text), 1)::double as ratio, length(text) / pages::double as density, regexp_replace(text, '\\s+', '', 'g') = '' as empty from d),
gated as (select doc_id, round_even(case when empty then 0 when ratio > 0.3 then 1 - ratio when coalesce(pages, 0) > 0 and density < 50 then least(1, density / 50) else 1 - ratio end, 3) as quality,
  case when empty or ratio > 0.3 then scannable else coalesce(pages, 0) > 0 and density < 50 end as needs_heavy_parser, case when empty then 'empty' when ratio > 0.3 then 'garbled' when coalesce(pages, 0) > 0 and density < 50 then 'thin' else '' end as reason from m)"""


@query(f"with {GATED} select * from gated")
def quality_gate(spark, d):
    return c.quality_gate(_gated(spark, d)).select("doc_id", "quality", "needs_heavy_parser", "reason")


@query("select doc_id, case when least(cjk, latin) > 0 and least(cjk, latin) / greatest(cjk, latin)::double > 0.2 then 'mixed' when cjk > latin then 'zh' else 'en' end as script from (select doc_id, len(regexp_extract_all(substr(text, 1, 5000), '[\\x{4e00}-\\x{9fff}]')) as cjk, len(regexp_extract_all(substr(text, 1, 5000), '[A-Za-z]')) as latin from documents)")
def script(spark, d):
    return _docs(spark, d).select("doc_id", tx.script(F.col("text")).alias("script"))


SPLIT = "lines as (select doc_id, (i - 1) as place, l[i] as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i))"


@query(f"with {SPLIT} select doc_id, place + 1 as line_no, substr(line, 1, 400) as line from lines where regexp_matches(line, '[A-Za-z0-9._]+@[a-z0-9.]+') order by doc_id, line_no limit 1000")
def grep(spark, d):
    return c.grep(_docs(spark, d), r"[A-Za-z0-9._]+@[a-z0-9.]+", 1000)


def _paged(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return lines.withColumn("page", F.floor(F.col("at") / 3))


REPEATED = f"""{SPLIT}, rows as (select doc_id, place // 3 as page, place, trim(line) as line, lower(regexp_replace(regexp_replace(trim(line), '\\d+', '#', 'g'), '\\s+', '', 'g')) as fp from lines where trim(line) <> ''),
pages as (select doc_id, count(distinct place // 3) as pages, sum(length(line)) + count(*) - count(distinct place // 3) as chars from lines group by 1),
repeated as (select doc_id, fp, count(distinct page) as hits, sum(length(line)) as chars, any_value(pages) as pages from rows join pages using (doc_id) where pages >= 3 group by doc_id, fp
  having (length(fp) >= 4 and count(distinct page) >= greatest(2, floor(any_value(pages) * 0.4::double))) or (fp <> '' and not regexp_matches(fp, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]') and count(distinct page) >= greatest(2, floor(any_value(pages) * 0.6::double))))"""


@query(f"with {REPEATED} select doc_id, page, place, line from rows where not exists (select 1 from repeated r where r.doc_id = rows.doc_id and r.fp = rows.fp)")
def repeated_lines(spark, d):
    return c.strip_repeated_lines(_paged(spark, d)).select("doc_id", "page", F.col("at").alias("place"), "line")


@query(f"with {REPEATED}, gone as (select doc_id, sum(chars) as gone from repeated group by 1) select doc_id, round(coalesce(gone, 0) / greatest(pages.chars, 1)::double, 6) as ratio from pages left join gone using (doc_id)")
def contamination_ratio(spark, d):
    return c.contamination_ratio(_paged(spark, d))


def _redacting(text: str) -> str:
    """SQL has no lookaround: signs beside a number are taken along and put back, twice, as neighbours share them."""
    for pattern, mark in tx.SECRETS:
        beside = pattern.startswith("(?<!")
        plain = pattern.replace(r"(?<!\d)", "(^|[^0-9])(?:").replace(r"(?!\d)", ")($|[^0-9])").replace("'", "''")
        new = rf"\1{mark}\2" if beside else mark.replace("$", "\\")
        for _ in range(2 if beside else 1):
            text = f"regexp_replace({text}, '{plain}', '{new}', 'g')"
    return text


REDACTED = _redacting("coalesce(text, '')")


@query(f"select doc_id, md5(t) as digest, len(regexp_extract_all(t, '\\[REDACTED'))::int as marks from (select doc_id, {REDACTED} as t from documents)")
def redacted_texts(spark, d):
    new = tx.redacted(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", F.md5(new).alias("digest"), F.regexp_count(new, F.lit(r"\[REDACTED")).alias("marks"))


TOLD = "'password: ' || coalesce(text, '')"


@query(f"select conv_id, turn, md5({REDACTED}) as text, md5(coalesce(text, '')) as arguments, md5({_redacting(TOLD)}) as content from conversations")
def redacted_messages(spark, d):
    """Each turn as a block that has its text, the same as arguments, and a result that begins like a secret."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array(F.struct(t.alias("text"), t.alias("arguments"), F.concat(F.lit("password: "), t).alias("content"))).alias("blocks"))
    return rows.select("conv_id", "turn", F.explode(tx.redacted_blocks(F.col("blocks"))).alias("b")).select("conv_id", "turn", *(F.md5(f"b.{c}").alias(c) for c in ("text", "arguments", "content")))


@query("select doc_id, md5(case when coalesce(source, '') <> '' then source || chr(10) || chr(10) || coalesce(text, '') else coalesce(text, '') end) as digest from documents")
def embed_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.embed_text(F.col("source"), F.coalesce("text", F.lit("")))).alias("digest"))


CUT = "regexp_replace(regexp_replace(coalesce(text, ''), '([。！？；!?;])', '\\1' || chr(1), 'g'), '[.]\\s+', '.' || chr(1), 'g')"


@query(f"select doc_id, len(s)::int as n, md5(array_to_string(s, '|')) as digest from (select doc_id, list_filter(string_split({CUT}, chr(1)), lambda x: trim(x, ' ') <> '') as s from documents)")
def sentence_splits(spark, d):
    return _docs(spark, d).select("doc_id", tx.sentences(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("select doc_id, case when doc_id % 4 <> 3 then doc_id % 90 else -1 end::int as passed, case when doc_id % 4 = 0 then doc_id % 90 when doc_id % 4 < 3 then doc_id % 90 + doc_id % 7 + 2 else -1 end::int as total from documents")
def test_summaries(spark, d):
    """Every text around the summary line of a test run with and without failures, errors and the word passed; -1 for what is null."""
    n, bad = (F.col("doc_id") % 90).cast("string"), (F.col("doc_id") % 7).cast("string")
    told = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("== "), n, F.lit(" passed in 3.2s =="))).when(F.col("doc_id") % 4 == 3, F.concat(n, F.lit(" failed"))).otherwise(F.concat(F.lit("== "), bad, F.lit(" failed, "), n, F.lit(" passed, 2 errors in 1s ==")))
    return _docs(spark, d).select("doc_id", tx.test_summary(F.concat_ws("\n", "text", told, "text")).alias("s")).select("doc_id", "s.*").fillna(-1)


@query("select doc_id, case when doc_id % 3 < 2 then md5(text || '|b') end as items from (select doc_id, coalesce(text, '') as text from documents)")
def json_answers(spark, d):
    """Every text in a fenced array, in an array between words with a second one behind it, and in one that never closes."""
    array = F.to_json(F.array(F.coalesce("text", F.lit("")), F.lit("b")))
    told = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: "), array, F.lit(" and [1]"))).otherwise(F.concat(F.lit("so "), F.substr(array, F.lit(1), F.least(F.length(array) - 1, F.lit(40)))))
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(tx.json_array(told), "|")).alias("items"))


@query("select page_id, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', '\\1user:***@') as url from pages")
def masked_urls(spark, d):
    """Every page's URL with a made-up password."""
    with_secret = F.regexp_replace("url", "^([A-Za-z][A-Za-z0-9+.-]*://)", "$1user:hunter2@")
    return table(spark, d, "pages").select("page_id", tx.masked_url(with_secret).alias("url"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) as digest from (select doc_id, coalesce(text, '') as text from documents)")
def squeezed_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.squeezed(F.col("text"))).alias("digest"))


THOUGHT = "(select doc_id, case doc_id % 3 when 0 then substr(text, 1, 50) || '<think>' || substr(text, 51, 100) || '</think>' || substr(text, 151) when 1 then substr(text, 1, 60) || '<think>' || substr(text, 61) else text || '</think>' end as t from (select doc_id, coalesce(text, '') as text from documents))"


@query(f"select doc_id, md5(array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '')) as thinking, md5(regexp_replace(t, '(?s)<think>.*?(?:</think>|$)', '', 'g')) as visible from {THOUGHT}")
def reasoning_spans(spark, d):
    t = F.coalesce("text", F.lit(""))
    rest = F.substr(t, F.lit(151), F.length(t))
    case = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(t, 1, 50), F.lit("<think>"), F.substring(t, 51, 100), F.lit("</think>"), rest)).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(t, 1, 60), F.lit("<think>"), F.substr(t, F.lit(61), F.length(t)))).otherwise(F.concat(t, F.lit("</think>")))
    rows = _docs(spark, d).select("doc_id", case.alias("t"))
    return rows.select("doc_id", F.md5(tx.thinking(F.col("t"))).alias("thinking"), F.md5(tx.visible(F.col("t"))).alias("visible"))


@query("select page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 200) as key, coalesce(nullif(substr(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9._\\x{4e00}-\\x{9fff}-]', '_', 'g'), 1, 200), ''), 'document') as doc_key from pages")
def safe_keys(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_key(F.col("url")).alias("key"), tx.document_key(F.col("url")).alias("doc_key"))


# Elements by name, as this SQL's patterns know no back references.
ELEMENTS = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "tr"))
PLAIN = r"replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')".replace(r"\"", '"').format


@query(rf"""with bare as (select page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') as html from pages),
found as (select page_id, regexp_extract_all(html, '(?is){ELEMENTS}') as r from bare), rows as (select page_id, i - 1 as spot, r[i] as raw, lower(regexp_extract(r[i], '^<([A-Za-z0-9]+)', 1)) as tag from found, unnest(range(1, len(r) + 1)) as u(i)),
cells as (select *, regexp_replace(regexp_replace(raw, '(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>', ' | ', 'g'), '(?s)<[^>]+>', ' ', 'g') as c from rows),
shown as (select *, case when tag = 'pre' then regexp_replace(raw, '(?s)<[^>]+>', '', 'g') else trim(regexp_replace({PLAIN('c')}, '\s+', ' ', 'g'), ' ') end as text from cells)
select page_id, spot as block, case when tag[1] = 'h' then 'heading' when tag = 'li' then 'list' when tag = 'pre' then 'code' when tag = 'tr' then 'table' else 'paragraph' end as kind, case when tag[1] = 'h' then substr(tag, 2, 1)::int else 0 end as level, md5(text) as digest from shown where trim(text, ' ') <> ''""")
def page_blocks(spark, d):
    return c.page_blocks(table(spark, d, "pages")).select("page_id", "block", "kind", "level", F.md5("text").alias("digest"))


def _marked(spark, d):
    """Every document's lines in turn as headings, list items, table rows, fenced code, markup and plain lines."""
    line, n = F.col("line"), (F.col("doc_id") + F.col("at")) % 12
    form = (
        F.when(n == 0, F.concat(F.lit("## "), line)).when(n == 1, F.concat(F.lit("- "), line)).when(n == 2, F.concat(F.lit("  2) "), line)).when(n == 3, F.concat(F.lit("| "), line, F.lit(" | x |"))).when(n == 4, F.concat(F.lit("```\n# "), line, F.lit("\n- in  code\n```")))
        .when(n == 5, F.concat(F.lit("<b>"), line, F.lit("</b> a &amp; b<br>**bold** `code`  __under__"))).when(n == 6, F.concat(F.lit("   \n"), line, F.lit("\r\n"))).when(n == 7, F.concat(F.lit("```\n"), line)).otherwise(line)
    )
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return lines.withColumn("form", form).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]), "\n").alias("text"))


MARKED = r"""src as (select doc_id, i - 1 as spot, l[i] as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i)),
formed as (select doc_id, spot, case (doc_id + spot) % 12 when 0 then '## ' || line when 1 then '- ' || line when 2 then '  2) ' || line when 3 then '| ' || line || ' | x |' when 4 then '```' || chr(10) || '# ' || line || chr(10) || '- in  code' || chr(10) || '```'
  when 5 then '<b>' || line || '</b> a &amp; b<br>**bold** `code`  __under__' when 6 then '   ' || chr(10) || line || chr(13) || chr(10) when 7 then '```' || chr(10) || line else line end as form from src),
marked as (select doc_id, regexp_replace(string_agg(form, chr(10) order by spot), '\r\n?', chr(10), 'g') as t from formed group by 1)"""
STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({}, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&amp;', '&'), '(?s)\*\*(.+?)\*\*', '\1', 'g'), '(?s)__(.+?)__', '\1', 'g'), '`([^`\n]+)`', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')".format


@query(rf"""with {MARKED}, lines as (select doc_id, i - 1 as spot, l[i] as line, regexp_matches(l[i], '^\s*```') as fence from (select doc_id, string_split(t, chr(10)) as l from marked), unnest(range(1, len(l) + 1)) as u(i)),
fenced as (select *, coalesce(sum(fence::int) over (partition by doc_id order by spot rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from lines),
kinds as (select *, case when inside or fence then 'code' when trim(line, ' ') = '' then 'blank' when regexp_matches(line, '^#{{1,6}}\s') then 'heading' when regexp_matches(line, '^\s*\|') then 'table' when regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s') then 'list' else 'paragraph' end as kind from fenced),
begun as (select *, coalesce(lag(kind) over (partition by doc_id order by spot) <> kind, true) or kind = 'heading' or (fence and not inside) as begins from kinds),
runs as (select *, sum(begins::int) over (partition by doc_id order by spot) as run from begun),
blocks as (select doc_id, run, kind, max(case when kind = 'heading' then length(regexp_extract(line, '^(#{{1,6}})\s', 1)) else 0 end) as level, coalesce(string_agg(line, chr(10) order by spot) filter (where not fence), '') as t from runs where kind <> 'blank' group by all),
shown as (select doc_id, run, kind, level, case when kind = 'code' then t else {STRIPPED(r"regexp_replace(t, '^#{1,6}\s+', '')")} end as text from blocks)
select doc_id, row_number() over (partition by doc_id order by run) - 1 as block, kind, level, md5(text) as digest from shown where trim(text, ' ') <> ''""")
def text_blocks(spark, d):
    return c.text_blocks(_marked(spark, d)).select("doc_id", "block", "kind", "level", F.md5("text").alias("digest"))


@query()
def chunks(spark, d):
    """Pages as chunks with their heading paths."""
    blocks = c.page_blocks(table(spark, d, "pages")).withColumnRenamed("page_id", "doc_id")
    return ch.chunk(blocks)


@query()
def ingest_status(spark, d):
    """With vectors of hashed terms, which a chunk of no terms doesn't get."""
    return _ingested(spark, d).select("doc_id", "status", "chunks", "vectors", "quality")


def _ingested(spark, d):
    def embed(chunks):
        keyed = chunks.select(F.struct("doc_id", "seq").alias("key"), F.col("embed_text").alias("text"))
        return hashed_embedding(keyed, "key").select("key.*", "embedding")

    return ch.ingest(_gated(spark, d), embed)[0]


HOOKED = f"""{GATED}, ended as (select g.doc_id, case when needs_heavy_parser and doc_id % 4 <> 0 then 'needs_heavy_parser' when regexp_replace(d.text, '\\s+', '', 'g') = '' and not needs_heavy_parser then 'failed' when doc_id % 5 = 0 then 'index_pending' else 'ready' end as status from gated g join d using (doc_id))"""


def _hooked(spark, d):
    """A parser that reads every fourth of what the gate refuses, and an embedder that leaves out every fifth document."""
    parse = lambda refused: refused.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("<p>read: "), F.col("doc_id").cast("string"), F.lit("</p>")).alias("text"))
    embed = lambda chunks: chunks.where("doc_id % 5 <> 0").select("doc_id", "seq", F.array(F.lit(1.0)).alias("embedding"))
    return ch.ingest(_gated(spark, d), embed, parse)[0]


@query(f"with {HOOKED} select doc_id, status from ended")
def hooked_ingest(spark, d):
    return _hooked(spark, d).select("doc_id", "status")


@query(f"with {HOOKED} select status, count(*) as docs, status in ('ready', 'index_pending') as has_chunks, status = 'ready' as has_vectors from ended group by 1")
def ingest_summary(spark, d):
    told = c.ingest_summary(_hooked(spark, d))
    return told.select("status", "docs", ((F.col("stored") >= F.col("docs")) & (F.col("tokens") > 0)).alias("has_chunks"), ((F.col("indexed") == F.col("stored")) & (F.col("indexed") > 0)).alias("has_vectors"))


@query("select page_id, md5('x ' || page_id || ' ≥ ' || page_id || ' unit' || chr(10) || '| ' || page_id || ' | b & c |' || chr(10) || 'end') as digest from pages")
def layout_texts(spark, d):
    """Every page's id inside math, a table with an empty cell, and entities."""
    made = F.concat(F.lit("<div>x $ "), F.col("page_id"), F.lit(r" \geq "), F.col("page_id"), F.lit(r"\ \unit$</div>"), F.lit("\n<table><tr><td>"), F.col("page_id"), F.lit("</td><td> </td><td>b &amp; <b>c</b></td></tr><tr></tr></table>\n<p>e&#110;&#x64;</p>"))
    return table(spark, d, "pages").select("page_id", F.md5(c.layout_cleaned(made)).alias("digest"))


@query("""with b as (select s_suppkey, concat_ws('; ', 's_name: ' || s_name, 's_nationkey: ' || s_nationkey) as line from supplier)
select (row_number() over (order by s_suppkey) - 1) // 20 + 1 as block, line, s_suppkey as k from b""".join(("select block, string_agg(line, chr(10) order by k) as text from (", ") group by 1 union all select 0, 'columns(2): s_name, s_nationkey; rows: ' || count(*) from supplier")))
def table_blocks(spark, d):
    return tb.table_blocks(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")


@query("""with l as (select o_orderdate as d, concat_ws('; ', 'o_orderkey: ' || o_orderkey, case when o_orderstatus <> 'P' then 'status: ' || o_orderstatus end) as line from orders where o_orderkey % 7 <> 3),
placed as (select (row_number() over (order by d, line) - 1) // 20 + 1 as block, d, line from l)
select block, string_agg(line, chr(10) order by d, line) as text from placed group by 1 union all select 0, 'columns(2): o_orderkey, status; rows: ' || count(*) from l""")
def dated_table_blocks(spark, d):
    """Blocks of rows, not of key values: the dates have gaps and ties."""
    orders = table(spark, d, "orders").where("o_orderkey % 7 <> 3").select("o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus")).alias("status"))
    return tb.table_blocks(orders, "o_orderdate")


BASE = "base as (select o_orderkey as doc, o_orderpriority as title, o_orderstatus as status, o_orderdate as created_at from orders where o_orderkey % 3 <> 0), new as (select o_orderkey as doc, o_orderpriority || '+' as title, 'R' as status, o_orderdate + interval 1 day as created_at from orders where o_orderkey % 3 <> 1)"


def _base(spark, d):
    o = table(spark, d, "orders")
    base = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    new = o.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("doc"), F.concat("o_orderpriority", F.lit("+")).alias("title"), F.lit("R").alias("status"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("created_at"))
    return base, new


@query(f"with {BASE} select doc, case when n.doc is not null then n.title else b.title end as title, case when n.doc is not null then n.status else b.status end as status, strftime(coalesce(b.created_at, n.created_at), '%Y-%m-%d') as created from base b full join new n using (doc)")
def upsert_docs(spark, d):
    base, new = _base(spark, d)
    return tb.upsert(base, new, ("doc",)).select("doc", "title", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("with new as (select * from lineitem where l_orderkey % 5 = 0 and l_linenumber = 1) select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select l_orderkey from new) union all select l_orderkey, l_linenumber, l_quantity from new")
def replace_chunks(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return tb.replaced(lines, lines.where("l_orderkey % 5 = 0 and l_linenumber = 1"), ("l_orderkey",))


@query("select l_orderkey, case when o_orderstatus = 'F' then 0 else sum(l_quantity) end as quantity, case when o_orderstatus = 'F' then count(*) else 0 end as gone from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, o_orderstatus")
def delete_docs(spark, d):
    """What stays of every order, and how many rows of the finished ones go."""
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left, gone = tb.deleted(table(spark, d, "lineitem"), finished, ("l_orderkey",))
    return left.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).join(gone.select("l_orderkey", F.col("rows").alias("gone")), "l_orderkey", "full").fillna(0, ["quantity", "gone"])


@query("select vec_id as chunk_id, round(list_sum(embedding::double[]), 6) as total from embeddings where vec_id % 4 <> 0 union all select vec_id, round(-list_sum(embedding::double[]), 6) from embeddings where vec_id % 4 = 0")
def upsert_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    new = v.where("chunk_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return tb.upsert_vectors(v, new, 64).select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("with f as (select doc_id as file_id, doc_id % 10 as user_id, sha256(coalesce(text, '')) as h from documents), new as (select *, min(file_id) over (partition by user_id, h) as first from f where file_id % 2 = 1), known as (select user_id, h, min(file_id) as known from f where file_id % 2 = 0 group by all) select user_id, file_id, coalesce(known, first) as uses from new left join known using (user_id, h)")
def dedupe_files(spark, d):
    files = _docs(spark, d).select(F.col("doc_id").alias("file_id"), (F.floor(F.col("doc_id") / 2) % 10).alias("half"), (F.col("doc_id") % 10).alias("user_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return tb.dedupe_files(files.where("file_id % 2 = 1").drop("half"), files.where("file_id % 2 = 0"))


@query("with c as (select o_orderkey as k, count(*) as chunks from orders join lineitem on l_orderkey = o_orderkey group by 1), v as (select l_orderkey as k, count(*) as vectors from lineitem where l_linenumber <= 3 group by 1) select o_orderkey as doc_key, 3 as expected, coalesce(chunks, 0) as chunks, coalesce(vectors, 0) as vectors, coalesce(chunks, 0) = 3 and coalesce(vectors, 0) = 3 as complete from orders left join c on c.k = o_orderkey left join v on v.k = o_orderkey")
def completeness(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_key"), "l_linenumber")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_key"), F.lit(3).alias("expected"))
    return tb.completeness(lines, docs, lines.where("l_linenumber <= 3"))


VERSIONS = "snap as (select o_custkey as session, v as version, o_orderkey as path, md5(case when (o_orderkey + v) % 5 = 0 then 'x' || v else 'same' end) as hash from orders, (values (1), (2), (3)) t(v) where (o_orderkey + v) % 4 <> 0)"


@query(f"""with {VERSIONS}, vs as (select session, version, lead(version) over (partition by session order by version) as next from (select distinct session, version from snap)),
pairs as (select coalesce(a.session, b.session) as session, coalesce(b.version, vs.next) as version, coalesce(a.path, b.path) as path, a.hash as h1, b.hash as h2 from vs join snap a on a.session = vs.session and a.version = vs.version left join snap b on b.session = vs.session and b.version = vs.next and b.path = a.path where vs.next is not null
  union all select b.session, b.version, b.path, null, b.hash from vs join snap b on b.session = vs.session and b.version = vs.next where not exists (select 1 from snap a where a.session = b.session and a.version = vs.version and a.path = b.path))
select session, version, path, case when h1 is null then 'added' when h2 is null then 'deleted' when h1 = h2 then 'unchanged' else 'modified' end as change from pairs""")
def manifest_diff(spark, d):
    snap = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"), F.col("o_orderkey").alias("path")).where("(path + version) % 4 <> 0")
    mark = F.when((F.col("path") + F.col("version")) % 5 == 0, F.concat(F.lit("x"), F.col("version").cast("string"))).otherwise("same")
    return tb.manifest_diff(snap.withColumn("hash", F.md5(mark)))
