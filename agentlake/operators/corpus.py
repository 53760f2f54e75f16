"""Document preparation: quality gate, scripts, repeated page lines, search, markup, blocks of text and of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.functions import text as tx

# Characters that tell a bad extraction: replacement signs, private use, control characters.
GARBLED = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"
# The gate's bounds, and the shares of pages, length and pages from which a line repeats.
MAX_GARBLED, MIN_DENSITY = 0.30, 50.0
HEADER_SHARE, NUMBER_SHARE, HEADER_LENGTH, MIN_PAGES = 0.4, 0.6, 4, 3


def quality_gate(docs: DataFrame, min_density: float = MIN_DENSITY, max_garbled: float = MAX_GARBLED) -> DataFrame:
    """quality (0 to 1, three digits), needs_heavy_parser, reason.  docs has text, pages (null: none), scannable."""
    text = F.coalesce("text", F.lit(""))
    ratio = F.regexp_count(text, F.lit(GARBLED)) / F.greatest(F.length(text), F.lit(1))
    density = F.length(text) / F.col("pages")
    empty, garbled, thin = F.regexp_replace(text, r"(?U)\s+", "") == "", ratio > max_garbled, (F.coalesce("pages", F.lit(0)) > 0) & (density < min_density)
    quality = F.when(empty, 0.0).when(garbled, 1 - ratio).when(thin, F.least(F.lit(1.0), density / min_density)).otherwise(1 - ratio)
    return docs.withColumns({
        "quality": F.bround(quality, 3), "needs_heavy_parser": F.when(empty | garbled, F.col("scannable")).otherwise(thin),
        "reason": F.when(empty, "empty").when(garbled, "garbled").when(thin, "thin").otherwise(""),
    })


def grep(docs: DataFrame, pattern: str, limit: int, cut: int = 400) -> DataFrame:
    """doc_id, line number from 1, and the line, of lines that match: the first ``limit``, as a search result."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return lines.where(F.regexp_like("line", F.lit(pattern))).select("doc_id", (F.col("at") + 1).alias("line_no"), F.substring("line", 1, cut).alias("line")).orderBy("doc_id", "line_no").limit(limit)


def strip_repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, at, line) without page headers and footers; blank lines go too.

    A fingerprint repeats if it is on enough pages of a document of three or more: 40 % for text, 60 % for digits and
    signs.  Pages count whether or not they hold a line that isn't blank, so an empty page has a row with an empty line.
    """
    rows = _printed(lines)
    return rows.join(repeated_lines(rows, page_counts(lines)).select("doc_id", "fp"), ["doc_id", "fp"], "left_anti")


def _printed(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, without white space at their ends, and their fingerprint."""
    return lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''").withColumn("fp", tx.line_fingerprint(F.col("line")))


def page_counts(lines: DataFrame) -> DataFrame:
    """doc_id, pages, and chars with the line ends in between, of every document."""
    return lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), (F.sum(F.length("line")) + F.count(F.lit(1)) - F.countDistinct("page")).alias("chars"))


def repeated_lines(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, fp, hits (pages), gone (characters) of fingerprints that are headers or footers."""
    hits = rows.groupBy("doc_id", "fp").agg(F.countDistinct("page").alias("hits"), F.sum(F.length("line")).alias("gone"))
    over = lambda share: F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))
    header = (F.length("fp") >= HEADER_LENGTH) & over(HEADER_SHARE)
    number = (F.col("fp") != "") & ~F.regexp_like("fp", F.lit("[一-鿿A-Za-z]")) & over(NUMBER_SHARE)
    return hits.join(pages.select("doc_id", "pages").where(F.col("pages") >= MIN_PAGES), "doc_id").where(header | number)


def contamination_ratio(lines: DataFrame) -> DataFrame:
    """Per document, the share of characters in repeated page lines."""
    pages = page_counts(lines)
    gone = repeated_lines(_printed(lines), pages).groupBy("doc_id").agg(F.sum("gone").alias("gone"))
    return pages.join(gone, "doc_id", "left").select("doc_id", F.round(F.coalesce("gone", F.lit(0)) / F.greatest(F.col("chars"), F.lit(1)), 6).alias("ratio"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Plain text and markdown as blocks: doc_id, block, kind, level, text.

    Lines in fences are code, whatever they look like; runs of one kind make a block, headings stand alone, and blank lines part.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("at", "line"))
    fence = F.regexp_like("line", F.lit(r"^\s*```"))
    fenced = lines.withColumn("fence", fence).withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    kind = (
        F.when(F.col("inside") | F.col("fence"), "code").when(F.trim("line") == "", "blank").when(F.regexp_like("line", F.lit(r"^#{1,6}\s")), "heading")
        .when(F.regexp_like("line", F.lit(r"^\s*\|")), "table").when(F.regexp_like("line", F.lit(r"^\s*(?:[-*+]|\d+[.)])\s")), "list").otherwise("paragraph")
    )
    kinds = fenced.withColumn("kind", kind)
    was = F.lag("kind").over(order)
    begins = was.isNull() | (was != F.col("kind")) | (F.col("kind") == "heading") | (F.col("fence") & ~F.col("inside"))
    runs = kinds.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    parts = F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("at", "line"))))
    blocks = runs.where("kind <> 'blank'").groupBy("doc_id", "run", "kind").agg(F.max(F.when(F.col("kind") == "heading", level).otherwise(0)).alias("level"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))
    shown = F.when(F.col("kind") == "code", F.col("text")).otherwise(tx.markup_stripped(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return blocks.withColumn("text", shown).where(F.trim("text") != "").select("doc_id", numbered.alias("block"), "kind", "level", "text")


def page_blocks(pages: DataFrame) -> DataFrame:
    """Web pages as blocks in order: headings, paragraphs, list items, preformatted text, table rows; no scripts or styles.

    By patterns, so broken or nested markup is only approximated.
    """
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)(<(h[1-6]|p|li|pre|tr)\b[^>]*>.*?</\2\s*>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "raw")).withColumn("tag", F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1)))
    cells = F.regexp_replace(F.regexp_replace("raw", r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | "), r"(?s)<[^>]+>", " ")
    text = F.when(F.col("tag") == "pre", F.regexp_replace("raw", r"(?s)<[^>]+>", "")).otherwise(tx.squeezed(tx.entities(cells)))
    kind = F.when(F.startswith("tag", F.lit("h")), "heading").when(F.col("tag") == "li", "list").when(F.col("tag") == "pre", "code").when(F.col("tag") == "tr", "table").otherwise("paragraph")
    level = F.when(F.startswith("tag", F.lit("h")), F.substring("tag", 2, 1).cast("int")).otherwise(0)
    return rows.select("page_id", F.col("at").alias("block"), kind.alias("kind"), level.alias("level"), text.alias("text")).where(F.trim("text") != "")


# Fixed patterns of tables in markup.
TABLE, ROW, CELL = r"(?is)<table\b[^>]*>.*?</table>", r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>"


def table_grid(html: Column) -> Column:
    """An HTML table as lines of cells between bars; spans are one cell, empty cells and rows drop out."""
    rows = F.regexp_extract_all(html, F.lit(ROW), F.lit(1))
    cell = lambda c: tx.squeezed(F.regexp_replace(tx.entities(F.regexp_replace(c, r"(?s)<[^>]+>", "")), r"\\[nr]", " "))
    cells = lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), cell), lambda c: c != "")
    lines = F.transform(F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.array_join(lines, "\n")


def grids_in(text: Column) -> Column:
    """``text`` with each of its HTML tables as a grid, and what stands around them."""
    around, tables = F.split(text, TABLE, -1), F.transform(F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)), table_grid)
    return F.array_join(F.zip_with(around, tables, lambda a, t: F.concat(a, F.coalesce(t, F.lit("")))), "")


# The signs of inline math commands, in the order they apply.
SYMBOLS = (
    (r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\delta", "δ"), (r"\epsilon", "ε"), (r"\varepsilon", "ε"), (r"\zeta", "ζ"), (r"\eta", "η"), (r"\theta", "θ"), (r"\iota", "ι"),
    (r"\kappa", "κ"), (r"\lambda", "λ"), (r"\mu", "μ"), (r"\nu", "ν"), (r"\xi", "ξ"), (r"\pi", "π"), (r"\rho", "ρ"), (r"\sigma", "σ"), (r"\tau", "τ"), (r"\upsilon", "υ"), (r"\phi", "φ"),
    (r"\chi", "χ"), (r"\psi", "ψ"), (r"\omega", "ω"), (r"\Gamma", "Γ"), (r"\Delta", "Δ"), (r"\Theta", "Θ"), (r"\Lambda", "Λ"), (r"\Pi", "Π"), (r"\Sigma", "Σ"), (r"\Phi", "Φ"), (r"\Omega", "Ω"),
    (r"\geq", "≥"), (r"\ge", "≥"), (r"\leq", "≤"), (r"\le", "≤"), (r"\neq", "≠"), (r"\ne", "≠"), (r"\approx", "≈"), (r"\equiv", "≡"), (r"\pm", "±"), (r"\mp", "∓"), (r"\times", "×"),
    (r"\div", "÷"), (r"\cdot", "·"), (r"\cdots", "…"), (r"\ldots", "…"), (r"\rightarrow", "→"), (r"\to", "→"), (r"\leftarrow", "←"), (r"\leftrightarrow", "↔"), (r"\Rightarrow", "⇒"),
    (r"\Leftarrow", "⇐"), (r"\infty", "∞"), (r"\propto", "∝"), (r"\sim", "~"), (r"\in", "∈"), (r"\notin", "∉"), (r"\subset", "⊂"), (r"\supset", "⊃"), (r"\cup", "∪"), (r"\cap", "∩"),
    (r"\forall", "∀"), (r"\exists", "∃"), (r"\partial", "∂"), (r"\nabla", "∇"), (r"\degree", "°"), (r"\deg", "°"),
)


def math_to_text(text: Column) -> Column:
    """Spans between dollar signs: commands before a brace go, symbols become their sign, other commands keep their name; no braces, carets or underscores stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\$[^$]+\$|[^$]+|\$)"), F.lit(1))

    def plain(p: Column) -> Column:
        body = F.regexp_replace(F.substr(p, F.lit(2), F.length(p) - 2), r"\\[a-zA-Z]+\s*\{", "{")
        signs = body
        for name, sign in SYMBOLS:
            signs = F.replace(signs, F.lit(name), F.lit(sign))
        bare = F.regexp_replace(F.when(F.contains(body, F.lit("\\")), signs).otherwise(body), r"[\^_{}\\]", "")
        return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")

    return F.when(F.contains(text, F.lit("$")), F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"(?s)^\$[^$]+\$$")), plain(p)).otherwise(p)), "")).otherwise(text)


def layout_cleaned(text: Column) -> Column:
    """Output of a layout parser: math, tables as grids, other tags, entities, runs of empty lines, in this order."""
    bare = tx.entities(F.regexp_replace(grids_in(math_to_text(text)), r"<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with their heading path: a heading replaces its level and everything deeper; skipped levels are left out."""
    order = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))
    at = lambda c: F.last(F.when(c, F.struct("block", F.trim("text").alias("text"))), ignorenulls=True).over(order)
    own = blocks.withColumns({f"h{n}": at(heading & (level == n)) for n in range(1, 7)} | {f"s{n}": at(heading & (level < n)) for n in range(1, 7)})
    part = lambda n: F.when(F.col(f"h{n}").isNotNull() & (F.coalesce(F.col(f"s{n}")["block"], F.lit(-1)) < F.col(f"h{n}")["block"]) & (F.col(f"h{n}")["text"] != ""), F.col(f"h{n}")["text"])
    return own.withColumn("title_path", F.concat_ws(" > ", *map(part, range(1, 7)))).select(*blocks.columns, "title_path")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("docs"), F.sum("chunks").alias("stored"), F.sum("vectors").alias("indexed"), F.sum("tokens").alias("tokens"))
