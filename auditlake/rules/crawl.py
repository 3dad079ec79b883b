"""Checks on crawled pages and on load measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import paths
from auditlake.operators.ranking import upper_median
from auditlake.schema import check, emit, union

PAGE = (
    "project string, url string, final_url string, depth int, status int, ok boolean, error string, content_type string, ttfb double, bytes bigint, headers map<string,string>, "
    "redirects array<struct<`from`: string, `to`: string, status: int>>, links array<struct<url: string, type: string, external: boolean>>, title string, canonical string, robots string, h1 int, words int"
)
ROBOTS = "project string, status int, text string"
MEASUREMENT = "project string, url string, mobile boolean, lcp double, cls double, ttfb double, bytes bigint, requests int, heavy array<struct<url: string, type: string, bytes: bigint>>"
#: Headers with severity.
HEADERS = (("content-security-policy", "high"), ("strict-transport-security", "medium"), ("x-content-type-options", "low"), ("referrer-policy", "low"), ("x-frame-options", "medium"))


def header(name: str) -> Column:
    return F.element_at("headers", F.lit(name))


def parse_robots(robots: DataFrame, agent: str = "auditlake") -> DataFrame:
    """(project, type, path): allow and disallow rules of the groups for everyone or for this agent; ``sitemap`` rows too."""
    lines = robots.select("project", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("n", "line"))
    clean = lines.select("project", "n", F.lower(F.trim(F.substring_index(F.regexp_replace("line", "#.*$", ""), ":", 1))).alias("key"), F.trim(F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"^[^:]*:(.*)$", 1)).alias("value")).where("key IN ('user-agent', 'allow', 'disallow', 'sitemap')")
    order = Window.partitionBy("project").orderBy("n")
    # a group: agent lines in a row, then its rules
    begins = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    grouped = clean.withColumn("g", F.sum(begins.cast("int")).over(order))
    mine = F.max(((F.col("key") == "user-agent") & (F.lower("value").isin("*", agent))).cast("int")).over(Window.partitionBy("project", "g"))
    kept = grouped.withColumn("mine", mine)
    rules = kept.where("key IN ('allow', 'disallow') AND mine = 1 AND value <> ''").select("project", F.col("key").alias("type"), F.col("value").alias("path"))
    return rules.unionByName(kept.where("key = 'sitemap'").select("project", F.col("key").alias("type"), F.col("value").alias("path")))


def disallowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages that robots.txt keeps crawlers from: the longest rule that fits decides, allow on a tie."""
    r = rules.where("type <> 'sitemap'").select(F.col("project").alias("_p"), "type", "path")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("path", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*"))
    hits = pages.withColumn("_path", paths.url_path(F.col("url"))).join(r, F.col("project") == F.col("_p")).where(F.regexp_like("_path", pattern))
    best = hits.groupBy("project", "url").agg(F.max_by("type", F.struct(F.length("path"), F.when(F.col("type") == "allow", 1).otherwise(0))).alias("type"))
    return best.where("type = 'disallow'").select("project", "url")


def frontier(links: DataFrame, seeds: DataFrame, depth: int = 4, most: int | None = None) -> DataFrame:
    """(project, url, depth) reached from the seeds through internal links in at most ``depth`` steps, each address once.

    ``links``: (project, source, target). ``most`` keeps the nearest pages of each project: the crawl
    budget is the feature. Addresses are compared without fragment, tracking and trailing slash.
    """
    from auditlake.session import checkpointed

    edges = links.select(F.col("project").alias("_p"), paths.normal_url(F.col("source")).alias("_s"), paths.normal_url(F.col("target")).alias("_t")).distinct()
    seen = checkpointed(seeds.select("project", paths.normal_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct())
    for level in range(1, depth + 1):
        step = seen.where(F.col("depth") == level - 1).join(edges, (F.col("project") == F.col("_p")) & (F.col("url") == F.col("_s"))).select("project", F.col("_t").alias("url")).distinct()
        new = step.join(seen, ["project", "url"], "left_anti").withColumn("depth", F.lit(level))
        seen = checkpointed(seen.unionByName(new))
    if most is not None:
        place = Window.partitionBy("project").orderBy("depth", "url")
        seen = seen.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")
    return seen


def page_findings(pages: DataFrame, robots: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """All rules about a crawl."""
    html = F.col("content_type").contains("html")
    rows = pages.withColumn("file", F.col("url"))
    weight_kib = F.col("bytes") / 1024
    first_redirect = F.get(F.filter("redirects", lambda r: r["status"].isin(302, 307)), F.lit(0))
    mixed = F.size(F.filter("links", lambda x: (x["type"] != "link") & x["url"].startswith("http://")))
    security = emit(rows, [check("CRAWL-MIXED-CONTENT", "high", html & F.col("final_url").startswith("https://") & (mixed > 0), F.format_string("%d insecure resources", mixed), "Insecure resources in a secure page", confidence="certain")], "security")
    routes_ = emit(
        rows,
        [
            check("CRAWL-UNREACHABLE", "high", F.col("error").isNotNull(), F.col("error"), "Page can't be reached", confidence="certain"),
            check("CRAWL-SERVER-ERROR", "critical", F.col("status") >= 500, F.format_string("Status %d", F.col("status")), "Server error", confidence="certain"),
            check("CRAWL-BROKEN-PAGE", F.when(F.col("status") == 404, "high").otherwise("medium"), F.col("status").between(400, 499), F.format_string("Status %d", F.col("status")), "Broken page", confidence="certain"),
            check("CRAWL-REDIRECT-CHAIN", "medium", F.size("redirects") > 1, F.format_string("%d redirects", F.size("redirects")), "Chain of redirects", confidence="certain"),
            check("CRAWL-TEMPORARY-REDIRECT", "low", first_redirect.isNotNull(), "Temporary redirect", confidence="certain"),
        ],
        "routes",
    )
    good = F.coalesce(F.col("ok"), F.lit(False)) & html
    canonical = paths.comparable_url(F.when(F.col("canonical").rlike("^https?://"), F.col("canonical")).otherwise(F.concat(F.regexp_extract("final_url", r"^(https?://[^/]+)", 1), F.col("canonical"))))
    seo = emit(
        rows,
        [
            check("CRAWL-EMPTY-HTML", "high", good & (F.col("words") < 50) & (F.col("h1") == 0), "Page without content before scripts run", confidence="certain"),
            check("CRAWL-NOINDEX-LIVE", "critical", good & F.lower("robots").contains("noindex"), "Live page kept out of search", confidence="certain"),
            check("CRAWL-CANONICAL-MISMATCH", "medium", good & F.col("canonical").isNotNull() & (canonical != paths.comparable_url(F.col("final_url"))), "Canonical address is another page", confidence="certain"),
        ],
        "seo",
    )
    twins = rows.where(good & (F.trim("title") != "")).groupBy("project", F.trim("title").alias("snippet")).agg(F.count_distinct("url").alias("n"), F.min("url").alias("file")).where("n > 1")
    titles = emit(twins, [check("CRAWL-DUPLICATE-TITLE", "medium", F.lit(True), F.format_string("%d pages", F.col("n")), "Title of several pages", confidence="certain")], "seo")
    speed = rows.groupBy("project").agg(
        F.max("ttfb").alias("worst"), F.max_by("url", "ttfb").alias("file"), F.count_if(F.col("ttfb") > 800).alias("slow"),
        F.count_if(html & (weight_kib > 50) & ~F.coalesce(F.lower(header("content-encoding")), F.lit("")).rlike("gzip|br|deflate|zstd")).alias("plain"),
        F.count_if(F.col("url").rlike(r"\.(css|js|png|jpe?g|webp|svg|woff2?)(\?|$)") & header("cache-control").isNull()).alias("uncached"),
    )
    performance = emit(
        speed,
        [
            check("CRAWL-SLOW-RESPONSE", F.when(F.col("worst") > 2000, "high").otherwise("medium"), F.col("slow") > 0, F.format_string("%d slow pages", F.col("slow")), "Slow answers", confidence="certain"),
            check("CRAWL-NO-COMPRESSION", "medium", F.col("plain") > 0, F.format_string("%d pages", F.col("plain")), "Pages sent uncompressed", confidence="certain"),
            check("CRAWL-NO-CACHE-HEADER", "low", F.col("uncached") > 0, F.format_string("%d resources", F.col("uncached")), "Resources without a cache time", confidence="certain"),
        ],
        "performance",
    )
    first = rows.where(good).groupBy("project").agg(F.min_by(F.struct("url", "final_url", "headers"), F.struct("depth", "url")).alias("_f")).select("project", F.col("_f.url").alias("file"), "_f.final_url", "_f.headers")
    secure = F.col("final_url").startswith("https://")
    missing = []
    for name, severity in HEADERS:
        absent = header(name).isNull()
        if name == "strict-transport-security":
            absent = absent & secure
        if name == "x-frame-options":
            absent = absent & ~F.coalesce(header("content-security-policy"), F.lit("")).contains("frame-ancestors")
        missing.append(check("CRAWL-HEADER-" + name.upper(), severity, absent, f"Header {name} missing", confidence="certain"))
    version = F.coalesce(header("x-powered-by"), header("x-aspnet-version"), F.when(header("server").rlike(r"\d"), header("server")))
    heads = emit(first, [*missing, check("CRAWL-VERSION-DISCLOSURE", "low", version.isNotNull(), version, "Server tells its version", confidence="certain"), check("CRAWL-NO-HTTPS", "critical", ~secure, "No secure connection", confidence="certain")], "security")
    rules = parse_robots(robots)
    counts = rules.groupBy(F.col("project").alias("_p")).agg(F.max(((F.col("type") == "disallow") & (F.col("path") == "/")).cast("int")).alias("all"), F.count_if(F.col("type") == "sitemap").alias("maps"))
    told = robots.join(counts, F.col("project") == F.col("_p"), "left")
    found = emit(
        told,
        [
            check("CRAWL-NO-ROBOTS", "medium", F.col("status").isNull() | (F.col("status") == 404), "No robots.txt", confidence="certain"),
            check("CRAWL-ROBOTS-BLOCKS-ALL", "critical", F.col("all") == 1, "Whole site kept from search", confidence="certain"),
            check("CRAWL-ROBOTS-NO-SITEMAP", "low", (F.col("status") == 200) & (F.coalesce("maps", F.lit(0)) == 0), "robots.txt without a sitemap", confidence="certain"),
        ],
        "seo",
    )
    blocked = emit(disallowed(pages, rules).withColumn("file", F.col("url")), [check("CRAWL-ROBOTS-BLOCKED", "medium", F.lit(True), "Linked page kept from crawlers", confidence="certain")], "routes")
    parts = [security, routes_, seo, titles, performance, heads, found, blocked]
    if routes is not None:
        reached = pages.select(F.col("project").alias("_p"), F.regexp_replace(paths.url_path(F.col("url")), r"[?].*$|/$", "").alias("_a")).distinct()
        crawled = reached.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        static = routes.where("NOT dynamic AND kind IN ('page', 'client')").withColumn("_b", F.regexp_replace("pattern", "/$", ""))
        lost = static.join(crawled, F.col("project") == F.col("_q"), "left_semi").join(reached, (F.col("project") == F.col("_p")) & (F.col("_b") == F.col("_a")), "left_anti")
        parts.append(emit(lost.withColumn("snippet", F.col("pattern")), [check("CRAWL-ROUTE-NOT-REACHED", "low", F.lit(True), "Route the crawl didn't reach", confidence="tentative")], "routes"))
    return union(parts)


def external_findings(checks: DataFrame) -> DataFrame:
    """External addresses that don't answer: ``checks`` has (project, url, status, ok, error, sources)."""
    rows = checks.where(~F.coalesce("ok", F.lit(False))).withColumn("file", F.get("sources", F.lit(0))).withColumn("snippet", F.col("url"))
    return emit(rows, [check("CRAWL-EXTERNAL-DEAD", "low", F.lit(True), F.concat(F.lit("No answer: "), F.col("url")), "External link without an answer")], "routes")


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Pages, failures, redirects and the upper median of the time to the first byte, per project."""
    counts = pages.groupBy("project").agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.count_if(F.size("redirects") > 0).alias("redirected"), F.max("depth").alias("depth"))
    middle = upper_median(pages, "project", "ttfb").select(F.col("project").alias("_p"), F.col("median").alias("median_ttfb"))
    return counts.join(middle, F.col("project") == F.col("_p"), "left").select("project", "pages", "failed", "redirected", "median_ttfb", "depth")


def outbound_domains(pages: DataFrame) -> DataFrame:
    """External links by domain: links, pages that hold them, three examples."""
    out = pages.select("project", "url", F.explode("links").alias("l")).where("l.external")
    domain = F.regexp_replace(F.lower(F.regexp_extract("l.url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#:]+)", 1)), r"^www\.", "")
    return out.groupBy("project", domain.alias("domain")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("url").alias("pages"), F.slice(F.array_sort(F.collect_set("l.url")), 1, 3).alias("examples"))


def load_findings(measurements: DataFrame) -> DataFrame:
    """Rules about measured page loads; zeros are no measurement."""
    m = measurements.withColumn("file", F.col("url"))
    by_limit = lambda c, low, high, a, b: F.when(F.col(c) > high, b).when(F.col(c) > low, a)
    lcp, cls, ttfb = by_limit("lcp", 2500, 4000, "medium", "high"), by_limit("cls", 0.1, 0.25, "medium", "high"), by_limit("ttfb", 800, 1800, "low", "medium")
    mib = 1024 * 1024
    total = F.when(F.col("bytes") > 5 * mib, "medium").when(F.col("bytes") > 2 * mib, "low")
    by_type = F.aggregate(F.coalesce("heavy", F.array().cast("array<struct<url:string,type:string,bytes:bigint>>")), F.lit(""), lambda acc, h: F.concat(acc, F.lit(" "), h["type"], F.lit(":"), h["bytes"].cast("string")))
    pages = emit(
        m,
        [
            check("PERF-LCP-LENT", lcp, lcp.isNotNull(), F.format_string("%.0f ms", F.col("lcp")), "Largest content comes late", confidence="certain"),
            check("PERF-CLS-INSTABLE", cls, cls.isNotNull(), F.format_string("%.2f", F.col("cls")), "Layout moves", confidence="certain"),
            check("PERF-TTFB-LENT", ttfb, ttfb.isNotNull(), F.format_string("%.0f ms", F.col("ttfb")), "Server answers late", confidence="certain"),
            check("PERF-POIDS-TOTAL", total, total.isNotNull(), F.trim(by_type), "Page too heavy", confidence="certain"),
            check("PERF-REQUETES-NOMBREUSES", "low", F.col("requests") > 80, F.format_string("%d requests", F.col("requests")), "Many requests", confidence="certain"),
        ],
        "performance",
    )
    worst = F.slice(F.reverse(F.array_sort(F.transform(F.filter("heavy", lambda h: h["bytes"] >= 200 * 1024), lambda h: F.struct(h["bytes"].alias("bytes"), h["url"].alias("url"))))), 1, 3)
    single = m.select("project", "file", F.explode(worst).alias("h"))
    heavy = emit(single.withColumn("snippet", paths.short_name(F.col("h.url"))), [check("PERF-RESSOURCE-LOURDE", F.when(F.col("h.bytes") > 500 * 1024, "medium").otherwise("low"), F.lit(True), F.concat(paths.short_name(F.col("h.url")), F.lit(": "), (F.col("h.bytes") / 1024).cast("int").cast("string"), F.lit(" KiB")), "Heavy resource", confidence="certain")], "performance")
    return union([pages, heavy])
