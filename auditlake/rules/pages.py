"""Checks on pages: search, sharing, accessibility and critical path, from elements and one row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.functions.text import visible_words
from auditlake.operators import markup
from auditlake.schema import check, emit, union

# Link texts that say nothing, in French and English.
GENERIC_ANCHORS = ("cliquez ici", "cliquer ici", "ici", "en savoir plus", "lire la suite", "plus", "click here", "here", "read more", "learn more", "more")
OPEN_GRAPH = ("og:title", "og:description", "og:image", "og:url", "og:type")
HTML_LIKE = ("html", "blade", "twig", "handlebars", "ejs", "jinja", "pug")
_TEMPLATED = r"\{\{|\{%|<\?|<%|\$\{"
#: Error pages are spared by these rules.
ERROR_PAGE_EXEMPT = ("SEO-DESC-MISSING", "SEO-DESC-SHORT", "SEO-CANONICAL-MISSING", "SEO-OG-MISSING", "SEO-OG-INCOMPLETE", "SEO-STRUCTURED-DATA", "SEO-THIN-CONTENT")


def attr(name: str) -> Column:
    return F.element_at("attrs", F.lit(name))


def has(name: str) -> Column:
    return F.map_contains_key("attrs", F.lit(name))


def pages_of(files: DataFrame) -> DataFrame:
    """Described files that hold markup."""
    return files.where(F.col("language").isin(*HTML_LIKE) & F.col("content").isNotNull() & ~F.col("is_vendored")).select("file_id", "project", "file", "content")


def summaries(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a page with all that page checks ask: counts, texts of the head, visible words."""
    tag = F.col("tag")
    meta = lambda n: (tag == "meta") & (F.lower(attr("name")) == n)
    link = lambda r: (tag == "link") & F.lower(attr("rel")).rlike(rf"(^|\s){r}(\s|$)")
    first = lambda cond, value: F.min_by(value, F.when(cond, F.col("idx")))
    per_page = nodes.groupBy("file_id").agg(
        F.max((tag == "body").cast("int")).alias("has_body"),
        F.max((tag == "html").cast("int")).alias("has_html"),
        F.max(((tag == "html") & (F.trim(attr("lang")) != "")).cast("int")).alias("has_lang"),
        F.max(((tag == "head") | (tag == "html")).cast("int")).alias("full"),
        F.count_if(tag == "title").alias("titles"),
        first(tag == "title", F.col("text")).alias("title"),
        first(meta("description"), attr("content")).alias("description"),
        first(meta("viewport"), attr("content")).alias("viewport"),
        first(meta("robots"), attr("content")).alias("robots"),
        F.max(((tag == "meta") & (has("charset") | (F.lower(attr("http-equiv")) == "content-type"))).cast("int")).alias("has_charset"),
        first(link("canonical"), attr("href")).alias("canonical"),
        F.max(link("(?:shortcut )?icon").cast("int")).alias("has_icon"),
        F.count_if(link("stylesheet")).alias("sheets"),
        F.max(link("(?:preconnect|dns-prefetch)").cast("int")).alias("has_preconnect"),
        F.count_if(tag == "h1").alias("h1s"),
        F.collect_set(F.when((tag == "meta") & F.lower(attr("property")).isin(*OPEN_GRAPH), F.lower(attr("property")))).alias("og"),
        F.max(((tag == "script") & (F.lower(attr("type")) == "application/ld+json") | has("itemscope") | has("itemtype")).cast("int")).alias("has_data"),
        F.max(((tag == "main") | (F.lower(attr("role")) == "main")).cast("int")).alias("has_main"),
        F.min(F.when(tag == "body", F.col("start"))).alias("body_start"),
        F.size(F.collect_set(F.when(F.coalesce(attr("src"), F.when(link("stylesheet"), attr("href"))).rlike(r"^(https?:)?//"), F.regexp_extract(F.coalesce(attr("src"), attr("href")), r"^(?:https?:)?//([^/?#]+)", 1)))).alias("origins"),
        F.max(((tag == "a") & F.lower("text").rlike(r"skip|aller au contenu|passer au contenu")).cast("int")).alias("has_skip"),
    )
    # the words of a page are those of its outermost elements
    from auditlake.functions.text import strip_tags

    words = pages.select("file_id", "project", "file", visible_words(strip_tags(F.col("content"))).alias("words"), F.col("content").rlike(r"(?i)<html\b|<!doctype|<head\b").alias("whole"))
    return words.join(per_page, "file_id", "left").where("whole")


def page_checks(summary: DataFrame, config: Config) -> DataFrame:
    c = config.seo
    title, desc = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    og = F.size(F.coalesce("og", F.array().cast("array<string>")))
    found = emit(
        summary,
        [
            check("SEO-TITLE-MISSING", "critical", title == "", "The page has no title"),
            check("SEO-TITLE-SHORT", "medium", (title != "") & (F.length(title) < c.title_min), F.format_string("Title of %d characters", F.length(title)), "Title too short"),
            check("SEO-TITLE-LONG", "low", F.length(title) > c.title_max, F.format_string("Title of %d characters", F.length(title)), "Title too long"),
            check("SEO-TITLE-DUPLICATE", "medium", zero("titles") > 1, "Several titles in one page"),
            check("SEO-DESC-MISSING", "high", desc == "", "No description"),
            check("SEO-DESC-SHORT", "low", (desc != "") & (F.length(desc) < c.desc_min), "Description too short"),
            check("SEO-DESC-LONG", "info", F.length(desc) > c.desc_max + 20, "Description too long"),
            check("SEO-LANG-MISSING", "high", (zero("has_html") == 1) & (zero("has_lang") == 0), "Language of the page not told"),
            check("SEO-VIEWPORT-MISSING", "high", F.col("viewport").isNull(), "No viewport"),
            check("SEO-VIEWPORT-NOZOOM", "medium", F.lower("viewport").rlike(r"user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0*)?(?![0-9.])"), "Zoom switched off"),
            check("SEO-CHARSET-MISSING", "medium", zero("has_charset") == 0, "Character set not told"),
            check("SEO-CANONICAL-MISSING", "medium", F.col("canonical").isNull(), "No canonical address"),
            check("SEO-CANONICAL-RELATIVE", "low", F.col("canonical").isNotNull() & ~F.col("canonical").rlike(r"^https?://") & ~F.col("canonical").rlike(_TEMPLATED), "Canonical address is relative"),
            check("SEO-NOINDEX", "high", F.lower("robots").contains("noindex"), "Page kept out of search"),
            check("SEO-H1-MISSING", "high", zero("h1s") == 0, "No main heading"),
            check("SEO-H1-MULTIPLE", "low", zero("h1s") > 1, "Several main headings"),
            check("SEO-OG-MISSING", "medium", og == 0, "No sharing data"),
            check("SEO-OG-INCOMPLETE", "low", (og > 0) & (og < len(OPEN_GRAPH)), F.concat(F.lit("Missing: "), F.array_join(F.array_except(F.array(*[F.lit(x) for x in OPEN_GRAPH]), F.col("og")), ", ")), "Sharing data incomplete"),
            check("SEO-STRUCTURED-DATA", "medium", zero("has_data") == 0, "No structured data"),
            check("SEO-THIN-CONTENT", "low", (F.col("words") > 0) & (F.col("words") < c.min_words), F.format_string("%d words", F.col("words")), "Little content"),
            check("SEO-FAVICON-MISSING", "info", zero("has_icon") == 0, "No icon"),
        ],
        "seo",
        effort="rapide",
    )
    spared = F.col("file").rlike(r"(?i)(^|/)(404|500|50x|error|erreur|not-?found)[^/]*$") & F.col("rule_id").isin(*ERROR_PAGE_EXEMPT)
    others = union(
        [
            found.where(~spared),
            emit(summary, [check("A11Y-NO-MAIN-LANDMARK", "medium", (zero("has_body") == 1) & (zero("has_main") == 0), "No main landmark"), check("A11Y-NO-SKIP-LINK", "low", (zero("has_body") == 1) & (zero("has_skip") == 0), "No way to skip the navigation")], "design"),
            emit(summary, [check("PERF-TOO-MANY-CSS", "low", zero("sheets") > 4, F.format_string("%d style sheets", zero("sheets")), "Many style sheets"), check("PERF-NO-PRECONNECT", "info", (zero("origins") >= 2) & (zero("has_preconnect") == 0), "No early connection to other hosts")], "performance"),
        ]
    )
    return others


def element_checks(nodes: DataFrame, summary: DataFrame) -> DataFrame:
    """Rules that a single element breaks."""
    tag, text = F.col("tag"), F.trim("text")
    type_ = F.lower(F.coalesce(attr("type"), F.lit("text")))
    named = has("aria-label") | has("title") | has("aria-labelledby")
    templated = F.concat_ws(" ", F.map_values("attrs"), text).rlike(_TEMPLATED)
    handler = F.coalesce(attr("onclick"), attr("@click"), attr("v-on:click"), attr("(click)"), attr("on:click"), attr("ng-click"))
    neutral = F.forall(F.filter(F.split(F.regexp_replace(F.coalesce(handler, F.lit("")), r"\s", ""), ";"), lambda s: s != ""), lambda s: s.rlike(r"^(?:\$?e(?:vent|vt)?\.)?(?:stopPropagation|preventDefault|stopImmediatePropagation)\(\)$"))
    seo = emit(
        nodes,
        [
            check("SEO-IMG-ALT-MISSING", "medium", (tag == "img") & ~has("alt"), "Image without alternative text"),
            check("SEO-IMG-NO-DIMENSIONS", "low", (tag == "img") & ~(has("width") & has("height")), "Image without dimensions"),
            check("SEO-IMG-NO-LAZY", "info", (tag == "img") & ~has("loading") & ~has("fetchpriority"), "Image loaded at once"),
            check("SEO-ANCHOR-GENERIC", "low", (tag == "a") & F.lower(text).isin(*GENERIC_ANCHORS), F.concat(F.lit("Link text: "), text), "Link text says nothing"),
            check("SEO-JSONLD-INVALID", "medium", (tag == "script") & (F.lower(attr("type")) == "application/ld+json") & (text != "") & ~text.rlike(_TEMPLATED) & F.try_parse_json(text).isNull(), "Structured data can't be read"),
            check(
                "SEO-JSONLD-INCOMPLETE",
                "low",
                (tag == "script") & (F.lower(attr("type")) == "application/ld+json") & F.try_parse_json(text).isNotNull() & ~text.startswith("[") & ~(text.contains('"@context"') & (text.contains('"@type"') | text.contains('"@graph"'))),
                "Structured data without context or type",
            ),
        ],
        "seo",
        effort="rapide",
    )
    rel = F.lower(F.coalesce(attr("rel"), F.lit("")))
    routes = emit(nodes, [check("ROUTE-TARGET-BLANK", "medium", (tag == "a") & (F.lower(attr("target")) == "_blank") & ~rel.rlike("noopener|noreferrer"), "New window keeps a hold on this one")], "routes", effort="rapide")
    field = tag.isin("input", "select", "textarea") & ~((tag == "input") & type_.isin("hidden", "submit", "button", "reset", "image"))
    labels = nodes.where((tag == "label") & has("for")).select("file_id", F.element_at("attrs", F.lit("for")).alias("_for")).distinct()
    unlabelled = nodes.where(field & ~named & ~F.array_contains("parents", "label")).withColumn("_el", F.coalesce(attr("id"), F.lit("")))
    unlabelled = unlabelled.join(labels.withColumnRenamed("file_id", "_lf"), (F.col("file_id") == F.col("_lf")) & (F.col("_el") == F.col("_for")), "left_anti")
    design = emit(
        nodes,
        [
            check("A11Y-NO-ACCESSIBLE-NAME", "high", tag.isin("button", "a") & (text == "") & ~named & ~templated & (has("href") | (tag == "button")), "Control without a name"),
            check("A11Y-LINK-NO-HREF", "medium", (tag == "a") & ~has("href") & ~templated & ~has("name") & ~has("id"), "Link without a target"),
            check("UX-NO-AUTOCOMPLETE", "low", (tag == "input") & type_.isin("email", "tel", "password") & ~has("autocomplete"), "Field that browsers can't fill"),
            check("A11Y-CLICKABLE-DIV", "medium", tag.isin("div", "span", "li", "td") & handler.isNotNull() & ~has("role") & ~has("tabindex") & ~neutral, "Click without a keyboard way"),
            check("A11Y-POSITIVE-TABINDEX", "medium", attr("tabindex").try_cast("int") > 0, "Order of focus changed"),
            check("DESIGN-INLINE-STYLE", "info", (F.length(attr("style")) > 60) & ~attr("style").rlike(_TEMPLATED), "Long inline style"),
            check("A11Y-IFRAME-NO-TITLE", "medium", (tag == "iframe") & ~has("title"), "Frame without a title"),
            check("UX-AUTOFOCUS", "low", has("autofocus"), "Focus taken at load"),
        ],
        "design",
        effort="rapide",
    )
    fields = emit(unlabelled, [check("A11Y-INPUT-NO-LABEL", "high", F.lit(True), "Field without a label")], "design", effort="rapide")
    cells = nodes.where(tag.isin("td", "th")).select(F.col("file_id").alias("_cf"), F.col("start").alias("_cs"), F.col("tag").alias("_ct"))
    tables = nodes.where((tag == "table") & ~has("role"))
    inside = tables.join(cells, (F.col("file_id") == F.col("_cf")) & (F.col("_cs") > F.col("start")) & (F.col("_cs") < F.col("close_start")))
    bare = inside.groupBy("file_id", "project", "file", "idx", "line").agg(F.count_if(F.col("_ct") == "td").alias("_td"), F.count_if(F.col("_ct") == "th").alias("_th")).where("_th = 0 AND _td >= 2")
    headless = emit(bare, [check("A11Y-TABLE-NO-HEADERS", "medium", F.lit(True), "Table without headers")], "design")
    scripts = nodes.where((tag == "script") & has("src") & ~has("async") & ~has("defer") & (F.coalesce(F.lower(attr("type")), F.lit("")) != "module"))
    heads = summary.select(F.col("file_id").alias("_bf"), "body_start")
    blocking = scripts.join(heads, F.col("file_id") == F.col("_bf")).where(F.col("start") < F.coalesce("body_start", F.lit(2**31 - 1)))
    perf = emit(blocking, [check("PERF-BLOCKING-SCRIPT", "medium", F.lit(True), "Script that blocks the page")], "performance", effort="rapide")
    return union([seo, routes, design, fields, headless, perf])


def heading_skips(nodes: DataFrame) -> DataFrame:
    """The first heading of a page that is more than a level below the one before it."""
    order = Window.partitionBy("file_id").orderBy("idx")
    heads = nodes.where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substring("tag", 2, 1).cast("int")).withColumn("before", F.lag("level").over(order))
    first = heads.where(F.col("level") > F.col("before") + 1).groupBy("file_id", "project", "file").agg(F.min_by(F.struct("line", "level", "before"), F.col("idx")).alias("_h"))
    rows = first.select("file_id", "project", "file", "_h.line", "_h.level", "_h.before")
    return emit(rows, [check("SEO-HEADING-SKIP", "low", F.lit(True), F.format_string("h%d follows h%d", F.col("level"), F.col("before")), "Heading level skipped")], "seo", effort="rapide")


def duplicated_meta(summary: DataFrame) -> DataFrame:
    """Titles and descriptions that several pages of a project share; templated ones are left out."""
    parts = []
    for column, rule, severity, what in (("title", "SEO-TITLE-DUPLICATED-PAGES", "medium", "title"), ("description", "SEO-DESC-DUPLICATED-PAGES", "low", "description")):
        value = F.trim(column)
        groups = summary.where((value != "") & ~value.rlike(_TEMPLATED)).groupBy("project", value.alias("snippet")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
        parts.append(emit(groups.where("n > 1"), [check(rule, severity, F.lit(True), F.format_string("%d pages share one " + what, F.col("n")), f"Shared {what}")], "seo"))
    return union(parts)


def page_findings(files: DataFrame, config: Config | None = None) -> DataFrame:
    """All page rules of described files; elements and summaries are derived once."""
    config = config or Config()
    pages = pages_of(files)
    nodes = markup.nodes(pages, "file_id", "content").join(pages.select(F.col("file_id").alias("_p"), "project", "file"), F.col("file_id") == F.col("_p")).drop("_p").persist()
    summary = summaries(pages, nodes).persist()
    return union([page_checks(summary, config), element_checks(nodes, summary), heading_skips(nodes), duplicated_meta(summary)])
