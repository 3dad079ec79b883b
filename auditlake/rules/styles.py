"""Style rules: contrast, focus, sizes, and the design system of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.functions import color
from auditlake.operators import markup
from auditlake.schema import check, emit, union


def _d(name: str) -> Column:
    return F.element_at("declarations", F.lit(name))


def rules_of(files: DataFrame) -> DataFrame:
    sheets = files.where((F.col("family") == "css") & F.col("content").isNotNull() & ~F.col("is_vendored")).select("file_id", "project", "file", "content")
    return markup.style_rules(sheets, "file_id", "content").join(sheets.select(F.col("file_id").alias("_s"), "project", "file"), F.col("file_id") == F.col("_s")).drop("_s")


def rule_checks(rules: DataFrame, config: Config) -> DataFrame:
    """What a single block breaks."""
    c = config.design
    background = F.coalesce(_d("background-color"), F.regexp_extract(_d("background"), r"(#[0-9a-fA-F]{3,8}\b|(?:rgb|hsl)a?\([^)]*\)|^[a-z]+$)", 1))
    fg, bg = color.parse_color(_d("color")), color.parse_color(background)
    size = color.to_pixels(_d("font-size"))
    bold = _d("font-weight").rlike(r"^(bold|bolder|[7-9]00)$")
    with_ratio = rules.withColumn("ratio", color.contrast(fg, bg)).withColumn("wanted", F.when((size >= 24) | ((size >= 18.66) & bold), 3.0).otherwise(F.lit(c.min_contrast)))
    height = F.coalesce(color.to_pixels(_d("height")), color.to_pixels(_d("min-height")))
    interactive = F.lower("selector").rlike(r"(^|[\s,>+~])(button|a|input|select)\b|\.(btn|button|link|tab|chip)\b|\[role=.?button") & ~F.lower("selector").rlike(r":(hover|before|after|:before|:after)")
    return emit(
        with_ratio.withColumn("snippet", F.col("selector")),
        [
            check("A11Y-CONTRAST", F.when(F.col("ratio") < 3, "high").otherwise("medium"), F.col("ratio") < F.col("wanted"), F.concat(F.lit("Contrast "), F.col("ratio").cast("string"), F.lit(":1, wanted "), F.col("wanted").cast("string"), F.lit(":1")), "Contrast too low"),
            check("A11Y-FOCUS-REMOVED", "high", F.col("selector").contains(":focus") & _d("outline").rlike(r"^(none|0)\b") & _d("box-shadow").isNull() & _d("border").isNull() & _d("outline-offset").isNull(), "Focus made invisible"),
            check("DESIGN-FONT-TOO-SMALL", "medium", (size > 0) & (size < c.min_font_px), "Text too small"),
            check("DESIGN-TAP-TARGET", "medium", interactive & (height > 0) & (height < c.min_tap_px), "Target too small for a finger"),
            check("DESIGN-NO-SELECT", "low", F.lower("selector").rlike(r"^(body|html|\*)$") & (_d("user-select") == "none"), "Text can't be selected"),
        ],
        "design",
    )


def sheet_checks(rules: DataFrame) -> DataFrame:
    """What a style sheet as a whole breaks."""
    values = F.map_values("declarations")
    per_file = rules.groupBy("file_id", "project", "file").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size(F.filter(values, lambda v: v.contains("!important")))).alias("important"),
        F.count_if(_d("z-index").try_cast("int") > 999).alias("high_z"),
    )
    return emit(
        per_file,
        [
            check("DESIGN-IMPORTANT-OVERUSE", "low", (F.col("important") > 15) & (F.col("important") > 0.15 * F.col("n")), F.format_string("%d times !important", F.col("important")), "Precedence forced too often"),
            check("DESIGN-ZINDEX-CHAOS", "low", F.col("high_z") > 3, "Stacking order out of hand"),
        ],
        "design",
    )


def tokens(rules: DataFrame) -> DataFrame:
    """(project, kind, value, n, token): colours, font sizes, spacings, families and custom properties in use."""
    entries = rules.select("project", F.explode(F.map_entries("declarations")).alias("e")).select("project", F.col("e.key").alias("name"), F.lower("e.value").alias("value"))
    is_token = F.col("name").rlike(r"^(--|\$)")
    colours = entries.select("project", F.lit("colour").alias("kind"), is_token.alias("token"), F.explode(F.regexp_extract_all("value", F.lit(r"(#[0-9a-f]{3,8}\b|(?:rgb|hsl)a?\([^)]*\))"), F.lit(1))).alias("value"))
    sizes = entries.where("name = 'font-size'").select("project", F.lit("size").alias("kind"), is_token.alias("token"), "value")
    space = entries.where(F.col("name").rlike(r"^(margin|padding|gap)(-|$)")).select("project", F.lit("space").alias("kind"), is_token.alias("token"), F.explode(F.regexp_extract_all("value", F.lit(r"(\d+(?:\.\d+)?)px"), F.lit(1))).alias("value"))
    families = entries.where("name = 'font-family'").select("project", F.lit("family").alias("kind"), is_token.alias("token"), F.trim(F.regexp_replace(F.substring_index("value", ",", 1), "[\"']", "")).alias("value"))
    variables = entries.where(is_token).select("project", F.lit("variable").alias("kind"), F.lit(True).alias("token"), F.col("name").alias("value"))
    motion = entries.where(F.col("name").rlike("^(animation|transition)")).select("project", F.lit("motion").alias("kind"), is_token.alias("token"), F.lit("yes").alias("value"))
    all_ = colours.unionByName(sizes).unionByName(space).unionByName(families).unionByName(variables).unionByName(motion)
    return all_.groupBy("project", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("token").alias("token"))


def system_checks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """What the styles of a whole project say."""
    t = tokens(rules)
    kind = F.col("kind")
    stats = t.groupBy("project").agg(
        F.count_if(kind == "colour").alias("colours"),
        F.count_if((kind == "colour") & F.col("token")).alias("token_colours"),
        F.count_if(kind == "size").alias("sizes"),
        F.count_if(kind == "space").alias("spaces"),
        F.count_if((kind == "space") & (F.col("value").cast("double") > 2) & (F.col("value").cast("double") % 4 != 0)).alias("odd"),
        F.count_if(kind == "family").alias("families"),
        F.count_if(kind == "variable").alias("variables"),
        F.count_if(kind == "motion").alias("motion"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(kind == "colour", F.struct((-F.col("n")).alias("n"), F.col("value"))))), lambda x: x["value"]), 1, 8).alias("top"),
    )
    sheets = files.where((F.col("family") == "css") & F.col("content").isNotNull() & ~F.col("is_vendored"))
    texts = sheets.groupBy("project").agg(
        F.max(F.col("content").rlike(r"prefers-color-scheme|\[data-theme|\.dark\b").cast("int")).alias("dark"),
        F.max(F.col("content").contains("prefers-reduced-motion").cast("int")).alias("reduced"),
        F.sum(F.length("content")).alias("chars"),
        F.size(F.collect_set(F.when(F.col("content").rlike(r"@media[^{]*width"), F.regexp_extract("content", r"@media[^{]*width\s*:\s*([0-9.]+\w+)", 1)))).alias("sheets_with_width"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all("content", F.lit(r"@media[^{]*?width\s*:\s*([0-9.]+\w+)"), F.lit(1)))))).alias("breakpoints"),
        F.max(F.col("content").rlike(r"@tailwind|@import\s+[\"']tailwindcss").cast("int")).alias("tailwind"),
        F.max(F.col("content").rlike(r"(?<![-\w])(?:min-)?width\s*:\s*[0-9]{4,}px").cast("int")).alias("fixed"),
    )
    rows = stats.join(texts, "project").withColumn("file", F.lit(None).cast("string"))
    return emit(
        rows,
        [
            check("DESIGN-COLOR-SPRAWL", "medium", F.col("colours") - F.col("token_colours") > 30, F.concat(F.lit("Most used: "), F.array_join("top", ", ")), "Too many colours"),
            check("DESIGN-TYPE-SCALE", "low", F.col("sizes") > 12, F.format_string("%d font sizes", F.col("sizes")), "Too many font sizes"),
            check("DESIGN-SPACING-SCALE", "low", (F.col("spaces") > 8) & (F.col("odd") > 0.4 * F.col("spaces")), "Spacing without a scale"),
            check("DESIGN-NO-TOKENS", "medium", (F.col("variables") == 0) & (F.col("colours") > 8), "No design variables"),
            check("DESIGN-TOO-MANY-FONTS", "low", F.col("families") > 3, "Too many fonts"),
            check("DESIGN-NO-DARK-MODE", "info", F.col("dark") == 0, "No dark mode"),
            check("A11Y-NO-REDUCED-MOTION", "low", (F.col("motion") > 0) & (F.col("reduced") == 0), "Motion can't be reduced"),
            check("DESIGN-NO-BREAKPOINTS", "high", (F.col("breakpoints") == 0) & (F.col("chars") > 3000) & (F.col("tailwind") == 0), "No layout for small screens"),
            check("DESIGN-TOO-MANY-BREAKPOINTS", "info", F.col("breakpoints") > 8, "Too many breakpoints"),
            check("DESIGN-FIXED-WIDTH", "medium", F.col("fixed") == 1, "Fixed width wider than screens"),
        ],
        "design",
    )


def style_findings(files: DataFrame, config: Config | None = None) -> DataFrame:
    """All style rules of described files."""
    config = config or Config()
    rules = rules_of(files).persist()
    return union([rule_checks(rules, config), sheet_checks(rules), system_checks(files, rules)])
