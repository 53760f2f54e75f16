"""Text functions as Column expressions, so that Catalyst sees them."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

CJK = r"一-鿿"
TOKEN = rf"[a-z0-9_]+|[{CJK}]"


def tokens(text: Column) -> Column:
    """Words, single CJK characters, and pairs of CJK characters that follow each other as tokens; repeats stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    joined = F.regexp_replace(low, rf"[^a-z0-9_{CJK}]+", "")
    pairs = F.regexp_extract_all(joined, F.lit(rf"(?=([{CJK}][{CJK}]))"), F.lit(1))
    singles = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    return F.when(F.regexp_like(low, F.lit(f"[{CJK}]")), F.concat(singles, pairs)).otherwise(singles)


def embedding_terms(text: Column) -> Column:
    """Tokens, and each single CJK character (but the first of its range) joined to whatever token follows it."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.when((F.length(a) == 1) & (a > "一"), F.concat(a, b)))
    return F.concat(t, F.array_compact(pairs))


def term_set(text: Column) -> Column:
    """Distinct words and CJK characters, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def entity_terms(text: Column) -> Column:
    """Distinct single terms and pairs of neighbouring kept characters, separators dropped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kept = F.regexp_replace(low, rf"[^a-z0-9_{CJK}]+", "")
    pairs = F.regexp_extract_all(kept, F.lit(rf"(?=([a-z0-9_{CJK}]{{2}}))"), F.lit(1))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), pairs))


def squeezed(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends; case stays."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def line_fingerprint(line: Column) -> Column:
    """Numbers as #, white space dropped, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, r"(?U)\d+", "#"), r"(?U)\s+", ""))


def index_text(title_path: Column, text: Column) -> Column:
    """What the lexical channel and the reranker see: the heading path before the text, unless it is in it."""
    return F.when((F.coalesce(title_path, F.lit("")) != "") & ~F.contains(text, title_path), F.concat_ws("\n", title_path, text)).otherwise(text)


def embed_text(title_path: Column, text: Column) -> Column:
    return F.when(F.coalesce(title_path, F.lit("")) != "", F.concat_ws("\n\n", title_path, text)).otherwise(text)


def chunk_key(doc_key: Column, seq: Column) -> Column:
    return F.concat(doc_key, F.lit("#"), seq.cast("string"))


def script(text: Column) -> Column:
    """zh, en or mixed, by the first 5,000 characters; mixed from a fifth of the rarer kind."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 5000)
    cjk, latin = F.regexp_count(head, F.lit(f"[{CJK}]")), F.regexp_count(head, F.lit("[A-Za-z]"))
    mixed = (cjk > 0) & (latin > 0) & (F.least(cjk, latin) / F.greatest(cjk, latin) > 0.2)
    return F.when(mixed, "mixed").when(cjk > latin, "zh").otherwise("en")


def thinking(text: Column) -> Column:
    """What stands inside <think> spans; an unclosed span lasts to the end."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)(?:</think>|$)"), F.lit(1)), "")


def visible(text: Column) -> Column:
    """What stands outside <think> spans; a stray closing tag stays."""
    return F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|$)", "")


# The secret patterns and their marks, in the order they apply.
SECRETS = (
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED:api_key]"),
    (r"\bLTAI[A-Za-z0-9]{8,}\b", "[REDACTED:aliyun_ak]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:aws_ak]"),
    (r"\bghp_[A-Za-z0-9]{20,}\b", "[REDACTED:github_token]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED:slack_token]"),
    (r"(?i)\b(api[_-]?key|secret|token|password|passwd|credential)\s*[:=]\s*[^\s'\"]{8,}", "$1=[REDACTED]"),
    (r"(?<!\d)\d{17}[\dXx](?!\d)", "[REDACTED:id_number]"),
    (r"(?<!\d)1[3-9]\d{9}(?!\d)", "[REDACTED:mobile]"),
    (r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "[REDACTED:internal_ip]"),
)


def redacted(text: Column) -> Column:
    for pattern, mark in SECRETS:
        text = F.regexp_replace(text, f"(?U){pattern}", mark)
    return text


def masked_url(url: Column) -> Column:
    """The password of a URL as ***, also behind a bare user name; what has no user goes through the secret patterns."""
    user = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#@:]*)(?::[^/?#]*)?@"
    return F.when(F.regexp_like(url, F.lit(user)), F.regexp_replace(url, user, "$1$2:***@")).otherwise(redacted(url))


def redacted_blocks(blocks: Column) -> Column:
    """Text and results of message blocks masked; arguments of tool calls stay."""
    return F.transform(blocks, lambda b: b.withField("text", redacted(b["text"])).withField("content", redacted(b["content"])))


def conversation_size(blocks: Column) -> Column:
    """Characters of text, or name and arguments, or result of each block."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    one = lambda b: F.when(b["type"] == "text", n(b["text"])).when(b["type"] == "tool_call", n(b["name"]) + n(b["arguments"])).when(b["type"] == "tool_result", n(b["content"])).otherwise(0)
    return F.aggregate(blocks, F.lit(0), lambda s, b: s + one(b))


def transcript(role: Column, blocks: Column, cut: int = 2000) -> Column:
    """One line per block: who speaks, and the block's body, cut."""
    body = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, cut)
    status = lambda b: F.when(F.coalesce(b["is_error"], F.lit(False)), "error").otherwise("ok")
    told = lambda b: (
        F.when(b["type"] == "text", F.concat(F.lit("["), role, F.lit("] "), body(b["text"])))
        .when(b["type"] == "tool_call", F.concat(F.lit("[assistant->tool:"), b["name"], F.lit("] "), body(b["arguments"])))
        .otherwise(F.concat(F.lit("[tool:"), b["tool_use_id"], F.lit(" "), status(b), F.lit("] "), body(b["content"])))
    )
    return F.array_join(F.transform(blocks, told), "\n")


def _sign(code: Column) -> Column:
    """The character of a code point; the replacement sign for what is none."""
    good = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(65).cast("long"))), 8, "0")), "UTF-32")).otherwise("\ufffd")


def entities(text: Column) -> Column:
    """Named and numeric character references that end in a semicolon as their characters; unknown ones stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(&#?[A-Za-z0-9]{1,31};|[^&]+|&)"), F.lit(1))
    names = F.create_map(*(x for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (F.lit(name), F.lit(chr(code)))))
    inner = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    decimal = lambda p: _sign(F.coalesce(F.substring(inner(p), 2, 31).try_cast("long"), F.lit(-1).cast("long")))
    hexa = lambda p: _sign(F.coalesce(F.conv(F.substring(inner(p), 3, 31), 16, 10).try_cast("long"), F.lit(-1).cast("long")))
    one = lambda p: (
        F.when(F.regexp_like(p, F.lit("^&#[0-9]+;$")), decimal(p)).when(F.regexp_like(p, F.lit("^&#[xX][0-9A-Fa-f]+;$")), hexa(p))
        .when(F.regexp_like(p, F.lit("^&[A-Za-z0-9]+;$")), F.coalesce(F.try_element_at(names, inner(p)), p)).otherwise(p)
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def markup_stripped(text: Column) -> Column:
    """Inline markup out: <br> to a new line, tags, entities, bold and code signs, runs of blanks, in this order."""
    # Fixed patterns, before and behind the entities.
    before = ((r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""))
    behind = ((r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?s)__(.+?)__", "$1"), (r"`([^`\n]+)`", "$1"), (r"[ \t\x{00A0}]{2,}", " "))
    for pattern, new in before:
        text = F.regexp_replace(text, pattern, new)
    text = entities(text)
    for pattern, new in behind:
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Cut behind full-width and plain sentence ends, and at white space after a full stop; blank parts drop out."""
    return F.filter(F.split(text, r"(?<=[。！？；!?;])|(?<=[.])\s+"), lambda s: F.trim(s) != "")


def safe_key(name: Column, limit: int = 200) -> Column:
    """A file name as object key: each sign but letters, digits, dot, dash, underscore as underscore, cut."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), 1, limit)


def document_key(name: Column, limit: int = 200) -> Column:
    """The last part of a path as document key; CJK stays, and nothing left is "document"."""
    last = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(last, f"[^A-Za-z0-9._{CJK}-]", "_"), 1, limit), F.lit("")), F.lit("document"))


def test_summary(out: Column) -> Column:
    """passed and total of a test run's summary line, null without "passed"."""
    passed = F.regexp_extract(out, r"(\d+)\s+passed", 1)
    bad = F.aggregate(F.regexp_extract_all(out, F.lit(r"(\d+)\s+(?:failed|errors|error)"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    ok = F.nullif(passed, F.lit("")).cast("int")
    return F.struct(ok.alias("passed"), (ok + bad).alias("total"))


def json_array(text: Column) -> Column:
    """The JSON array of a model's answer, fences taken off: the whole, else the first bracketed part that closes; null if neither parses."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*\s*$", ""))
    tail = F.regexp_extract(bare, r"(?s)(\[.*)$", 1)
    step = lambda s, c: F.struct(
        (s["at"] + 1).alias("at"),
        (s["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("depth"),
        F.when(s["end"].isNull() & (c == "]") & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"]).alias("end"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    shape = "array<string>"
    return F.coalesce(F.from_json(F.when(F.startswith(bare, F.lit("[")), bare), shape), F.from_json(F.substr(tail, F.lit(1), end), shape))


def canonical_json(text: Column) -> Column:
    r"""A JSON text with the keys of every object sorted and no blanks between tokens; null for what is no JSON.

    Parsing to a Variant sorts keys at every depth and drops spelling (escapes, blanks), but joins 1 and 1.0 and rounds long numbers, so
    numbers pass through it as strings with a mark (U+0001; a mark of the text's own is doubled) and keep the digits they
    were written with.  An object that has a key twice is no JSON here.
    """
    literal = r'("(?:[^"\\]|\\.)*+")|(-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)'
    own = F.replace(text, F.lit(r"\u0001"), F.lit(r"\u0001\u0001"))
    parted = F.replace(F.regexp_replace(own, literal, "$1\u0002$2\u0002"), F.lit("\u0002\u0002"), F.lit(""))
    marked = F.regexp_replace(parted, "\u0002([^\u0002]*)\u0002", r'"\\u0001$1"')
    ordered = F.to_json(F.try_parse_json(marked))
    return F.replace(F.regexp_replace(ordered, r'"\\u0001([-+.eE0-9]++)"', "$1"), F.lit(r"\u0001\u0001"), F.lit(r"\u0001"))
